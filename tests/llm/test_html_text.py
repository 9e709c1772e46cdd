"""Main text of pages: markup, the longest common subsequence, and differencing against a brute-force version."""

import random
import re
import time

import pytest

from tallyspark.llm import html_text


def main(page):
    return "\n\n".join(line for line, _ in html_text.lines(page))


def test_structure():
    page = """<html><head><title>T</title></head><body class="has-sidebar"><header><h1>Site</h1></header><nav><a>x</a></nav><div id="cookie-notice">c</div>
      <main><article class="post"><header><h1>Head &amp; more</h1><p>by me</p></header><p>one<br>two <b>three</b>four</p><form><p>mail</p></form><div style="display: none">z</div><ol class="commentlist"><li>hm</li></ol><pre> a
      b </pre><section class="comments"><article class="comment"><p>nice</p></article></section><p>end &lt;x&gt; &copy;</article></main><aside>s</aside><footer>f</footer><script>"<p>"</script>"""
    assert main(page) == "Head & more\n\none two threefour\n\na b\n\nend <x> ©"
    assert main("<head><title>t</title><body><p>no end of the head</p>") == "no end of the head"
    assert main("<p>a<svg><text>b</text></svg>c <!-- > d --> e<!--->f<svg>g</p><script>h") == "ac efg"
    assert main("<p>1 < 2 and 3 <b>x</b><p class='open>y</p>z") == "1 < 2 and 3 x\n\ny\n\nz"
    for odd in (None, "", "<", "<p", "</p>", "<!-- open", "<script>x", "a<b>c", "<p class='ad>x</p>", "</", "<!", "<svg"):
        html_text.lines(odd)


def test_sentences_of_main_text_stay_whole():
    wrap = lambda x: main(f"<body><article>{x}</article></body>")
    assert wrap('<p>see <span class="ad-hoc">ad hoc</span> text</p>') == "see ad hoc text"
    assert wrap('<p>a <a class="social" id="share">linked</a> word <em class="promo">here</em></p>') == "a linked word here"
    assert wrap('<p>one</p><section class="related-work"><h2>Related</h2><p>body</p></section>') == "one\n\nRelated\n\nbody"
    assert wrap('<div class="social-science"><p>text</p></div><p>b</p>') == "text\n\nb"
    assert wrap('<p>one</p><div class="share-buttons"><p>x</p></div><div class="ad"><p>y</p></div><ul class="related posts"><li>z</li></ul>') == "one"
    assert wrap("<p>left <script>x()</script>right<noscript>n</noscript> end<style>p{}</style>.</p>") == "left right end."
    assert wrap('<p>a<span style="display: none">b</span>c</p>') == "ac"


def test_labelled_blocks_of_an_article_are_open():
    found = dict(html_text.lines('<article><p>a</p><section class="related-work"><h2>h</h2><div class="x"><p>b</p></div></section></article>'))
    assert found == {"a": False, "h": True, "b": True}


@pytest.mark.parametrize("piece", ["<script ", '<p class="x ', "<a ", "<!--", '<a x=">" ', "</", "<", "<svg>", "<p id='", "&", "<div>", "</x>", '<a href=">'])
def test_reading_takes_linear_time(piece):
    page = "<div>" * 20_000 + piece * (1_000_000 // len(piece))
    start = time.perf_counter()
    html_text.lines(page)
    assert time.perf_counter() - start < 5


def length(a, b):
    rows = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            rows[i + 1][j + 1] = rows[i][j] + 1 if x == y else max(rows[i][j + 1], rows[i + 1][j])
    return rows[-1][-1]


def test_common_subsequence_is_a_longest_one():
    rng = random.Random(1)
    for _ in range(500):
        a, b = ([rng.randrange(rng.choice([2, 5, 30])) for _ in range(rng.randint(0, 25))] for _ in range(2))
        places, rest = html_text.shared(a, b), iter(b)
        assert places == sorted(set(places)) and len(places) == length(a, b) and all(a[i] in rest for i in places)
    a, b = ([rng.randrange(4000) for _ in range(15_000)] for _ in range(2))
    assert len(html_text.shared(a, b)) == len(html_text.shared(b, a)) > 100  # by halves


def site(rng):
    """Rows of pages: hosts with a common frame, runs of exact and near copies, marked pages, urls without a host."""
    words = "ba be bi bo bu da de di do du".split()
    say = lambda n: " ".join(rng.choices(words, k=n))
    rows, n = [], 0
    for h in range(5):
        frame = [f"home of host {h}", "call us today", "all rights kept here"]
        for _ in range(rng.randint(1, 12)):
            story = [say(rng.randint(4, 30)) for _ in range(rng.randint(1, 6))]
            for copy in range(rng.choice([1, 1, 1, 4])):
                near = [*story[:-1], story[-1] + " x"] if copy == 2 else story
                if rng.random() < 0.3:
                    page = f"<article><p>{'</p><p>'.join(near)}</p><div class=bar>{frame[1]}</div><p>{frame[2]}</p></article>"
                else:
                    page = f"<div>{frame[0]}</div><p>{'</p><p>'.join(near)}</p>" + "".join(f"<div>{x}</div>" for x in frame[1 : rng.choice([2, 3])])
                rows.append((n, f"https://Host{h}.example/{rng.choice('abc')}/{rng.randint(1, 40):02d}?q={n}", page))
                n += 1
    return [*rows, (n, None, "<p>x</p><p>call us today</p>"), (n + 1, "mailto:x", None), rows[0], (None, rows[3][1], rows[3][2])]


def brute(rows, copy_share=0.1):
    """Texts by a walk over each host."""
    hosts = {}
    for i, url, page in rows:
        m = re.match(r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)([^?#]*)", url or "")
        found = tuple(html_text.lines(page))
        if m and m[1]:
            key = hosts.setdefault(m[1].lower(), {})
            place = (m[2], -1 if i is None else i)
            key[found] = min(key.get(found, place), place)
    texts = {}
    for host, classes in hosts.items():
        order = sorted(classes, key=lambda c: classes[c])
        runs = []
        for c in order:
            if runs:
                a, b = [t for t, _ in runs[-1][-1]], [t for t, _ in c]
                same = sum(len(a[i]) for i in html_text.shared(a, b))
                total = sum(map(len, a)) + sum(map(len, b))
            if runs and total - 2 * same < copy_share * total:
                runs[-1].append(c)
            else:
                runs.append([c])
        for r, run in enumerate(runs):
            near = ([runs[r - 1][-1]] if r else []) + ([runs[r + 1][0]] if r + 1 < len(runs) else [])
            for c in run:
                gone = {i for x in near for i in html_text.shared([t for t, _ in c], [t for t, _ in x])}
                texts[host, c] = "\n\n".join(t for i, (t, is_open) in enumerate(c) if not (is_open and i in gone))
    out = []
    for i, url, page in rows:
        m = re.match(r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)([^?#]*)", url or "")
        out.append((i, url, texts[m[1].lower(), tuple(html_text.lines(page))] if m and m[1] else main(page)))
    return sorted(out, key=str)


@pytest.mark.parametrize("parts", [1, 6, 24])
def test_differencing_against_brute_force_in_any_partitioning(spark, parts):
    rows = site(random.Random(3))
    pages = spark.createDataFrame([(*r, "extra") for r in rows], "page_id long, url string, html string, text string").repartition(parts)
    kept = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", str(parts))
        got = sorted(((r["page_id"], r["url"], r["text"]) for r in html_text.extract(pages, broadcast_rows=0 if parts == 6 else 1000).collect()), key=str)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", kept)
    assert got == brute(rows)
    assert sum("call us today" in t for *_, t in got) < len(rows) / 4 and sum("home of host" in t for *_, t in got) < len(rows) / 4


def test_lines_that_articles_share_stay(spark):
    page = "<article><h1>{0}</h1><p>{0} story</p><p>licence of all</p><div class='bar'>print this</div></article>"
    rows = [(i, f"https://h.example/a/{i}", page.format("one two three four"[i * 3 : i * 3 + 9])) for i in range(4)] + [(9, "https://lone.example/x", "<p>alone</p>")]
    got = {r["page_id"]: r for r in html_text.op2_html_text(spark.createDataFrame(rows, "page_id int, url string, html string")).collect()}
    assert all("licence of all" in got[i]["text"] and "print this" not in got[i]["text"] for i in range(4))
    assert got[9]["text"] == "alone" and got[9]["n_chars"] == 5


def test_empty_table(spark):
    assert html_text.op2_html_text(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []
