"""Main text of web pages: what the markup decides, and nearest-URL page differencing for the rest.

A page is cut into lines (blocks of text). Three kinds of lines:

* lines in parts that are never main text (menus, headers, footers, sidebars, notices, adverts, forms, reader comments, scripts, styles) go by their markup;
* prose inside an article or main element stays: headings, and blocks without a class or id of their own. Articles of one site share such lines too (licences, quotations), and they are
  still the article's;
* all other lines are open: every line of a page that marks no article or main element, and, inside of one that does, blocks with a class or id, and all that a block holds whose class has
  a word of such a part among others (``related-work``). Elements in a line are never left out for their class.

Differencing decides the open lines. Pages are paired by URL: inside a host, in order of path, each page meets the nearest page before it and after it that is not a copy. The lines of
both are aligned by a longest common subsequence, and open lines that are shared are the site's, not the page's, and go. Pages that differ in less than ``copy_share`` of their characters are
copies of each other (the same article with another date): a run of them meets the pages before and after the run.

Scale: pages are parsed once, without a shuffle. Neighbours are found on hashes of lines only, 8 bytes a line: equal pages of a host are one class, classes get a rank in one global order of
(host, path, id), and neighbours are equi-joins on ranks; no task holds a host, whatever its share of the pages. Only hosts with open lines take part, and only pages that lose a line are
written again. Results do not depend on partitions.

Defined cases: null html gives the empty text; broken markup (unclosed or stray tags, comments, quotes) is read on as browsers do, a truncated page up to its end; after an attribute quote
that is never closed, tags end at their first ``>``; reading takes linear time. Urls that are null or name no host are not paired; repeated rows are each returned; an empty table gives an empty
result; extra columns are not touched.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import released, running, scratch, stored

# What HTML elements and common class names mean.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Their content is no markup: it ends at their end tag or at the end of the page.
RAW = frozenset("script style textarea title iframe xmp noembed noframes".split())
#: Left out with all they hold, if they end at all.
LEFT_OUT = frozenset("noscript template svg math object canvas audio video select".split())
SKIPPED = frozenset("head nav header footer aside form menu dialog button datalist fieldset".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split()
)
MAIN = frozenset(["article", "main"])
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
BAD_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense adslot banner sponsor sponsored sponsors promo promotion promoted sidebar sidebars menu menus nav navbar navigation "
    "navigate breadcrumb breadcrumbs header masthead topbar footer cookie cookies consent gdpr notice notices notification notifications popup popover modal overlay newsletter subscribe subscription signup "
    "login share sharing social related recommended recommendations comment comments reply replies disqus respond widget widgets toolbar pagination pager copyright "
    "skip outbrain taboola topnav sidenav mainnav subnav commentlist commentsection cookiebar adbox adbanner sharebar announcement announcements disclaimer alert alerts".split()
)
BAD_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar".split())
#: Words that go with the above in names of such parts. Inside of main text a block is left out for its class only if all words of a name are of these two kinds; others are open.
PART_WORDS = frozenset(
    "area bar block body bottom box btn button buttons card center col collapse column container content desktop drop entry fixed float form group head icon icons id img image inline inner item items label left "
    "link links list main mobile module nav new news outer page pages panel part parts post posts primary region right row rows secondary section side site slot small tag text title tool tools top unit view "
    "wrap wrapper zone article articles story stories media more on in by to the our us you facebook twitter google disclosure el js ui".split()
)
STARTS_OF_STATES = frozenset("has with no not is without show hide".split())
#: Elements that are never left out for their class: they wrap whole pages.
WRAPPERS = frozenset(["html", "body", "main"])
#: An end tag of these does not reach out of an article.
WITHIN_ARTICLE = frozenset("p b i a span em strong li ul ol".split())

_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_STOP = re.compile(r"[>\"']")
_ATTRIBUTE = re.compile(r"([^\s\"'>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")
_COMMENT_END = re.compile(r"--!?>")
_ENDS = {name: re.compile(rf"</{name}(?=[\s/>])[^>]*>", re.I) for name in RAW | LEFT_OUT}
SEEN_ATTRIBUTES = frozenset(["class", "id", "role", "style", "aria-hidden", "hidden"])


def tokens(page: str) -> Iterator[tuple[int, int, str, str, str]]:
    """(start, end, kind, name, attributes) of each piece of markup: kind is "start", "end" or "other". One pass, forwards only."""
    at, quotes, unended = 0, True, set()
    while (start := page.find("<", at)) >= 0:
        after = page[start + 1 : start + 2]
        if page.startswith("<!--", start):
            short = next((n for n in (">", "->") if page.startswith(n, start + 4)), None)
            found = None if short else _COMMENT_END.search(page, start + 4)
            at = start + 4 + len(short) if short else found.end() if found else len(page)
            yield start, at, "other", "", ""
            continue
        closing = after == "/"
        name = _NAME.match(page, start + 1 + closing)
        if not name:
            if after not in ("!", "?", "/") or not after:
                at = start + 1
                continue
            end = page.find(">", start)
            at = end + 1 if end >= 0 else len(page)
            yield start, at, "other", "", ""
            continue
        end = pos = name.end()
        if quotes:
            while True:
                stop = _STOP.search(page, pos)
                if not stop:
                    end = -1
                    break
                if stop[0] == ">":
                    end = stop.start()
                    break
                pos = page.find(stop[0], stop.end()) + 1
                if not pos:
                    end = -1
                    break
            quotes = end >= 0
        if not quotes:
            end = page.find(">", name.end())
        if end < 0:
            # A tag that the page breaks off in.
            yield start, len(page), "other", "", ""
            return
        tag, at = name[0].lower(), end + 1
        if closing:
            yield start, at, "end", tag, ""
            continue
        if tag in _ENDS and tag not in unended:
            found = None if page[end - 1] == "/" else _ENDS[tag].search(page, at)
            if page[end - 1] == "/":
                yield start, at, "other", tag, ""
                continue
            if not found and tag in LEFT_OUT:
                unended.add(tag)
                yield start, at, "other", tag, ""
                continue
            at = found.end() if found else len(page)
            yield start, at, "other", tag, ""
            continue
        yield start, at, "start", tag, page[name.end() : end]


def attributes(rest: str) -> dict[str, str]:
    """The attributes that say what an element is for; the first of a name counts."""
    out: dict[str, str] = {}
    if rest and not rest.isspace():
        for m in _ATTRIBUTE.finditer(rest):
            if (key := m[1].lower()) in SEEN_ATTRIBUTES:
                out.setdefault(key, m[2] or m[3] or m[4] or "")
    return out


def unwanted(name: str, found: dict[str, str], inside: bool = False) -> bool:
    """Whether an element is left out for its class, id, role or style. inside: of main text. Elements in a line are never left out for their class: they are parts of sentences."""
    if not found or name in WRAPPERS:
        return False
    if "hidden" in found and name not in INLINE or "display:none" in found.get("style", "").replace(" ", "").lower():
        return True
    if name in INLINE:
        return False
    if found.get("role", "").strip().lower() in BAD_ROLES:
        return True
    for one in f"{found.get('class', '')} {found.get('id', '')}".split():
        parts = [w.lower() for w in _WORDS.findall(one)]
        if parts and parts[0] not in STARTS_OF_STATES and not BAD_WORDS.isdisjoint(parts) and not (inside and any(w not in BAD_WORDS and w not in PART_WORDS and not w.isdigit() for w in parts)):
            return True
    return False


def _only_header(found: dict[str, str]) -> bool:
    """Whether the class names a header and nothing else that is left out: inside an article its headings stay."""
    said = {w.lower() for x in found.values() for w in _WORDS.findall(x)}
    return said & BAD_WORDS <= {"header"}


def lines(page: str | None) -> list[tuple[str, bool]]:
    """(text, whether it is open) of the lines that the markup does not leave out, in page order, decoded, with single spaces. Where the page marks main text that holds a line, only main text."""
    if not page:
        return []
    out: list[tuple[str, bool, bool]] = []  # text, open, inside of main
    # Open elements: name, and (skip, main, heading, labelled, suspect) before it. skip: 0 nothing, 1 for a class or a tag that may hold the article by mistake, 2 surely; 3 keeps headings only.
    # suspect: inside of a block of main text whose class says that it may be none, without being sure.
    stack: list[tuple[str, int, bool, bool, bool, bool]] = []
    places: dict[str, list[int]] = {}
    mains: list[int] = []
    skip, main, heading, labelled, suspect = 0, False, False, False, False
    held: list[str] = []
    at = 0

    def flush() -> None:
        if held:
            line = " ".join(html.unescape("".join(held)).split())
            held.clear()
            if line:
                out.append((line, not main or suspect or labelled and not heading, main))

    def text(part: str) -> None:
        if part and (not skip or skip == 3 and heading):
            held.append(part)

    for start, end, kind, name, rest in tokens(page):
        text(page[at:start])
        at = end
        if kind == "other":
            if name == "xmp":
                flush()
            continue
        if name not in INLINE:
            flush()
        elif name == "br" and held:
            held.append(" ")
        if kind == "end":
            mine = places.get(name)
            if mine and not (name in WITHIN_ARTICLE and mains and mains[-1] > mine[-1]):
                place = mine[-1]
                _, skip, main, heading, labelled, suspect = stack[place]
                for gone, *_ in stack[place:]:
                    places[gone].pop()
                    if gone in MAIN:
                        mains.pop()
                del stack[place:]
            continue
        if name in VOID:
            continue
        places.setdefault(name, []).append(len(stack))
        if name in MAIN:
            mains.append(len(stack))
        stack.append((name, skip, main, heading, labelled, suspect))
        if name == "body":
            skip = 0
        found = attributes(rest)
        if name in HEADINGS:
            heading = True
        if name not in INLINE:
            labelled = name not in MAIN and ("class" in found or "id" in found)
        bad = unwanted(name, found, main)
        suspect = suspect or main and not bad and unwanted(name, found)
        if name in MAIN and not bad and (skip < 2 or skip == 3):
            skip, main = 0, True
        elif not skip:
            if name == "header" and main or bad and main and _only_header(found):
                skip = 3
            elif name in SKIPPED:
                skip = 2 if name in ("aside", "footer") else 1
            elif bad:
                skip = 2 if name in MAIN else 1
    text(page[at:])
    flush()
    marked = any(inside for *_, inside in out)
    return [(line, is_open) for line, is_open, inside in out if inside or not marked]


def shared(a: list, b: list) -> list[int]:
    """Places in a of a longest common subsequence of a and b, in order. Exact; memory is bounded by 16 MB and the lines, time by the product of the lengths over the machine's word."""
    both = set(a) & set(b)
    places = [i for i, x in enumerate(a) if x in both]
    return [places[i] for i in _common([a[i] for i in places], [x for x in b if x in both])]


def _rows(a: list, b: list) -> Iterator[int]:
    """For each beginning of a, the places of b as bits of a number: 0 where one more place of b makes the common subsequence longer (Hyyrö's recurrence)."""
    where: dict = {}
    for j, x in enumerate(b):
        where.setdefault(x, []).append(j)
    # Lines that occur often are kept as bits, few as they are; others are put together when met.
    masks = {x: sum(1 << j for j in js) for x, js in where.items() if len(js) > 32}
    row = full = (1 << len(b)) - 1
    for x in a:
        mask = masks.get(x)
        if mask is None:
            mask = 0
            for j in where.get(x, ()):
                mask |= 1 << j
        hit = row & mask
        row = (row + hit | row - hit) & full
        yield row


def _counts(row: int, n: int) -> np.ndarray:
    """How many of the first 0, 1, .. n bits are 0."""
    bits = np.unpackbits(np.frombuffer(row.to_bytes(n // 8 + 1, "little"), np.uint8), bitorder="little")[:n]
    return np.concatenate([[0], np.cumsum(1 - bits.astype(np.int64))])


def _common(a: list, b: list) -> list[int]:
    if not a or not b:
        return []
    if len(a) * len(b) > 1 << 27 and len(a) > 1:
        # By halves of a: b is cut where the lengths of both sides add up to most.
        half = len(a) // 2
        for front in _rows(a[:half], b):
            pass
        for back in _rows(a[half:][::-1], b[::-1]):
            pass
        cut = int(np.argmax(_counts(front, len(b)) + _counts(back, len(b))[::-1]))
        return [*_common(a[:half], b[:cut]), *(half + i for i in _common(a[half:], b[cut:]))]
    rows = [(1 << len(b)) - 1, *_rows(a, b)]
    out, j = [], len(b)
    for i in range(len(a), 0, -1):
        below = (1 << j) - 1
        now = ~rows[i] & below
        if now.bit_count() > (~rows[i - 1] & below).bit_count():
            out.append(i - 1)
            j = now.bit_length() - 1
    return out[::-1]


def is_copy(a: np.ndarray, a_sizes: np.ndarray, b: np.ndarray, b_sizes: np.ndarray, copy_share: float) -> bool:
    """Whether two pages differ in less than copy_share of their characters. Lines as hashes, with their sizes."""
    total = int(a_sizes.sum() + b_sizes.sum())
    same = int(a_sizes[shared(a.tolist(), b.tolist())].sum())
    return total - 2 * same < copy_share * total


PAGE = "page_id long, url string, host string, path string, text string, lines array<string>, open binary, hashes binary, sizes binary"


def read_pages(pages: DataFrame) -> DataFrame:
    """One row a page: its lines as one text, and, if any is open, as a list; hashes (8 bytes), sizes (4 bytes) and openness (1 byte) of the lines."""
    pattern = r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)([^?#]*)"
    placed = pages.select(
        F.col("page_id").cast("long").alias("page_id"), "url", F.lower(F.regexp_extract("url", pattern, 1)).alias("host"), F.regexp_extract("url", pattern, 2).alias("path"), "html"
    )
    kinds = [pa.string(), pa.list_(pa.string()), pa.binary(), pa.binary(), pa.binary()]
    names = ["page_id", "url", "host", "path", "text", "lines", "open", "hashes", "sizes"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            begin, size = 0, 0
            columns: list[list] = [[] for _ in kinds]
            for i, page in enumerate(whole.column(4)):
                found = lines(page.as_py())
                texts, is_open = [t for t, _ in found], [o for _, o in found]
                text = "\n\n".join(texts)
                hashes = np.fromiter((xxhash.xxh3_64_intdigest(t.encode("utf-8", "surrogatepass")) for t in texts), np.uint64, len(texts))
                row = (text, texts if any(is_open) else None, bytes(is_open), hashes.tobytes(), np.array([len(t) for t in texts], "<i4").tobytes())
                for column, x in zip(columns, row, strict=True):
                    column.append(x)
                size += len(text)
                if size > 4_000_000 or i + 1 == whole.num_rows:
                    arrays = [whole.column(c).slice(begin, i + 1 - begin) for c in range(4)]
                    yield pa.RecordBatch.from_arrays([*arrays, *(pa.array(x, k) for x, k in zip(columns, kinds, strict=True))], names=names)
                    begin, size = i + 1, 0
                    for column in columns:
                        column.clear()

    return placed.mapInArrow(released(run), PAGE)


def lost_lines(read: DataFrame, copy_share: float) -> DataFrame:
    """host, digest, kept (one boolean a line): of each class of equal pages that loses open lines to the nearest pages before and after it. read: rows of ``read_pages`` with a digest."""
    place = F.min(F.struct("path", F.coalesce("page_id", F.lit(-1)).alias("page_id"))).alias("place")
    rest = [F.first(c).alias(c) for c in ("hashes", "sizes", "open")]
    classes = read.where("host <> ''").groupBy("host", "digest").agg(place, *rest).select("host", "digest", "place.*", "hashes", "sizes", "open")
    ranked = stored(running(classes, ["host", "path", "page_id", "digest"], "page-order", rank=F.lit(1).cast("long")), "page-ranks")

    def as_numbers(column: pa.Array, kind: str) -> list[np.ndarray]:
        return [np.frombuffer(x.as_buffer(), kind) if x.is_valid else np.zeros(0, kind) for x in column]

    @F.arrow_udf("boolean")
    def copies(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        for a, a_sizes, b, b_sizes in batches:
            rows = zip(as_numbers(a, "<u8"), as_numbers(a_sizes, "<i4"), as_numbers(b, "<u8"), as_numbers(b_sizes, "<i4"), strict=True)
            yield pa.array([is_copy(*row, copy_share) for row in rows], pa.bool_())

    @F.arrow_udf("array<boolean>")
    def keeps(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        for own, is_open, before, after in batches:
            out = []
            for mine, o, *sides in zip(as_numbers(own, "<u8"), as_numbers(is_open, "u1"), as_numbers(before, "<u8"), as_numbers(after, "<u8"), strict=True):
                kept = np.ones(len(mine), bool)
                for side in sides:
                    kept[shared(mine.tolist(), side.tolist())] = False
                kept |= o == 0
                out.append(None if kept.all() else kept.tolist())
            yield pa.array(out, pa.list_(pa.bool_()))

    # A run of copies begins where a class is no copy of the class before it on its host.
    former = ranked.select((F.col("rank") + 1).alias("rank"), F.col("host").alias("_host"), F.col("hashes").alias("_hashes"), F.col("sizes").alias("_sizes"))
    met = ranked.select("rank", "host", "hashes", "sizes").join(former, "rank", "left")
    same_host = F.coalesce(F.col("host") == F.col("_host"), F.lit(False))
    first = met.where(~same_host).select("rank", F.lit(True).alias("begins"))
    later = met.where(same_host).select("rank", (~copies("hashes", "sizes", "_hashes", "_sizes")).alias("begins"))
    begins = stored(first.unionByName(later).withColumn("block", F.floor(F.col("rank") / 4096)), "page-runs")
    # The beginning of the own run and of the next, by blocks of ranks.
    start, blocks = F.when(F.col("begins"), F.col("rank")), Window.orderBy("block")
    carried = begins.groupBy("block").agg(F.min(start).alias("low"), F.max(start).alias("high")).select(
        F.col("block").alias("_block"),
        F.max("high").over(blocks.rowsBetween(Window.unboundedPreceding, -1)).alias("_own"),
        F.min("low").over(blocks.rowsBetween(1, Window.unboundedFollowing)).alias("_next"),
    )
    inside = Window.partitionBy("block").orderBy("rank")
    bounds = begins.join(carried, F.col("block") == F.col("_block")).select(
        "rank",
        (F.coalesce(F.max(start).over(inside.rowsBetween(Window.unboundedPreceding, 0)), "_own") - 1).alias("before"),
        F.coalesce(F.min(start).over(inside.rowsBetween(1, Window.unboundedFollowing)), "_next").alias("after"),
    )

    def side(name: str) -> DataFrame:
        return ranked.select(F.col("rank").alias(name), F.col("host").alias(f"_{name}_host"), F.col("hashes").alias(f"_{name}"))

    def lines_of(name: str):
        return F.when(F.col("host") == F.col(f"_{name}_host"), F.col(f"_{name}"))

    wanted = ranked.where(F.instr(F.hex("open"), "01") > 0).join(bounds, "rank").join(side("before"), "before", "left").join(side("after"), "after", "left")
    return wanted.select("host", "digest", keeps(F.col("hashes"), F.col("open"), lines_of("before"), lines_of("after")).alias("kept")).where("kept is not null")


def extract(pages: DataFrame, copy_share: float = 0.1, broadcast_rows: int = 100_000) -> DataFrame:
    """page_id, url, text of each row."""
    with scratch(pages.sparkSession) as keep:
        read = keep(read_pages(pages).withColumn("digest", F.md5(F.concat("hashes", F.lit(b"|"), "open"))), "pages")
        if not read.where("lines is not null and host <> ''").limit(1).count():
            return read.select("page_id", "url", "text")
        lost = keep(lost_lines(read, copy_share), "page-losses")
    lost = lost.withColumnsRenamed({"host": "_host", "digest": "_digest"})
    if lost.count() <= broadcast_rows:
        lost = F.broadcast(lost)
    some = read.where("lines is not null").join(lost, (F.col("host") == F.col("_host")) & (F.col("digest") == F.col("_digest")), "left")
    left = F.array_join(F.filter("lines", lambda line, i: F.get("kept", i)), "\n\n")
    some = some.select("page_id", "url", F.when(F.col("kept").isNull(), F.col("text")).otherwise(left).alias("text"))
    return read.where("lines is null").select("page_id", "url", "text").unionByName(some)


def op2_html_text(pages: DataFrame) -> DataFrame:
    return extract(pages).withColumn("n_chars", F.length("text").cast("long"))
