"""Operators that compare documents with others: brute-force versions on small tables, and odd inputs."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict
from functools import lru_cache

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tallyspark.llm import chat_format, decontamination, mixing, near_dup, quality
from tallyspark.llm.components import components
from tallyspark.llm.wordhash import each_text

WORDS = [a + b for a in "the on er in at re an th st ha".split() for b in ("", "ing", "ed", "ly", "or")]


def text(rng, n):
    return " ".join(rng.choices(WORDS, k=n))


def edited(rng, t, n):
    w = t.split()
    for _ in range(n):
        w[rng.randrange(len(w))] = rng.choice(WORDS)
    return " ".join(w)


def brute_components(rows, k):
    sets = {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b]:
                n = len(sets[a] & sets[b])
                if 100 * n >= 80 * (len(sets[a]) + len(sets[b]) - n):
                    x, y = find(a), find(b)
                    root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


def near_copies(rng, n_groups=12):
    rows, i = [], 0
    for g in range(n_groups):
        base = text(rng, rng.choice([3, 30, 80, 200]))
        for c in range(rng.randint(1, 9)):
            rows.append((i, base if c == 1 else edited(rng, base, rng.randint(0, max(1, len(base.split()) // 12)))))
            i += 1
    return rows + [(i, None), (i + 1, ""), (i + 2, " \n"), (i + 3, "one"), (i + 4, "ONE"), (i + 5, "one two"), (i + 6, "x " * 9000)]


@pytest.mark.parametrize("how", [{}, {"node_limit": 3, "block_shingles": 300}])
def test_near_duplicates_against_brute_force(docs, how):
    rows = near_copies(random.Random(5))
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_dup.near_duplicates(docs(rows), k=2, **how).collect()}
    assert got == brute_components(rows, 2)


def test_recall_of_near_duplicates(docs):
    """Pairs just at the threshold, each in a cluster of its own: all links must be found."""
    rng, rows, pairs = random.Random(21), [], 0
    for i in range(150):
        n = rng.randint(20, 120)
        base = [f"w{i}x{j}" for j in range(n)]
        grown = base + [f"w{i}y{j}" for j in range(int((n - 1) / 0.8) - (n - 1))]  # Jaccard of word pairs: (n - 1) / (len(grown) - 1)
        rows += [(2 * i, " ".join(base)), (2 * i + 1, " ".join(grown))]
        pairs += 100 * (n - 1) >= 80 * (len(grown) - 1)
    got = {r["doc_id"]: r["component_id"] for r in near_dup.near_duplicates(docs(rows), k=2).collect()}
    assert pairs == 150 and sum(got[2 * i + 1] == 2 * i for i in range(150)) == pairs


def test_stored_tables_go(spark, docs):
    from pathlib import Path

    from tallyspark.llm import common

    common.clear(spark)
    folder = Path(common.shared_dir(spark)) / "tallyspark"
    near_dup.op10_near_dup(docs(near_copies(random.Random(3), 4))).count()
    assert len(list(folder.iterdir())) == 2
    common.clear(spark)
    assert not list(folder.iterdir())


def test_near_duplicates_odd_tables(docs):
    assert near_dup.op10_near_dup(docs([(1, "a b")]).limit(0)).collect() == []
    rows = near_dup.op10_near_dup(docs([(7, "a b c"), (7, "a b c"), (None, "a b c"), (9, None), (9, "")])).collect()
    assert sorted((r["doc_id"] or 0, r["component_id"]) for r in rows) == [(0, 7), (7, 7), (7, 7), (9, 9), (9, 9)]
    assert {(r["doc_id"], r["kept"]) for r in rows} == {(None, False), (7, True), (9, True)}
    kept = near_dup.keep_one(docs([(1, "a b c d e f"), (2, "a b c d e f"), (3, "g"), (None, "a b c d e f")]))
    assert sorted(r["doc_id"] or 0 for r in kept.collect()) == [1, 3] and kept.columns[-1] == "size"


def kept_by_row(rows, k=5):
    """keep_one by brute force: rows get numbers of their own, components are those of the numbers."""
    of = brute_components([(n, t) for n, (_, t, *_) in enumerate(rows)], k)
    groups = defaultdict(list)
    for n, (i, t, *rest) in enumerate(rows):
        groups[of[n][1] if of[n][0] else -1 - n].append((i is None, i or 0, hashlib.md5((t or "").encode()).hexdigest(), *rest, t))
    return Counter((None if none else i, t) for none, i, _, *_, t in (min(g, key=lambda x: x[:-1]) for g in groups.values()))


@pytest.mark.parametrize("seed", range(3))
def test_keep_one_decides_by_row(docs, seed):
    rng = random.Random(seed)
    rows = near_copies(rng, 14)
    # Ids that repeat over different texts, equal rows, and rows without an id.
    rows = [(rng.choice([i, i, i // 3, 5, None]), t, rng.choice("st")) for i, t in rows]
    rows += [(1, text(rng, 40), "s"), (5, text(rng, 40), "s"), (5, rows[0][1], "s"), *rows[:6], *rows[:2], (None, rows[3][1], "t"), (None, rows[3][1], "t")]
    got = near_dup.keep_one(docs(rows))
    assert Counter((r["doc_id"], r["text"]) for r in got.collect()) == kept_by_row(rows) and got.columns[-1] == "size"


def test_unique_text_of_a_repeated_id_stays(docs):
    one, other = "x y z a b c d", "nobody else has this text at all"
    assert sorted((r["doc_id"], r["text"]) for r in near_dup.keep_one(docs([(1, one), (5, one), (5, other), (7, other + " more"), (7, other + " more")])).collect()) == [(1, one), (5, other), (7, other + " more")]


def test_words_that_collide_in_polynomial_hashes():
    thue = "a"
    while len(thue) < 2048:
        thue += thue.translate(str.maketrans("ab", "ba"))
    for n in (256, 1024, 2048):
        a, b = thue[:n], thue[:n].translate(str.maketrans("ab", "ba"))
        hashes = [h for *_, h in each_text(pa.array([f"{a} {b} {a}", a[::-1]]))]
        assert hashes[0][0] == hashes[0][2] != hashes[0][1] and len({*hashes[0].tolist(), *hashes[1].tolist()}) >= 2


def test_word_hashes_know_words_only():
    rng = random.Random(8)
    words = ["".join(rng.choice("abAB\u00e9") for _ in range(rng.randint(1, 6))) for _ in range(4000)]
    seen = {}
    for *_, h in each_text(pa.array([" ".join(words), "  ".join(words[::-1]), None, "", " "])):
        for x, w in zip(h.tolist(), words if len(seen) == 0 else words[::-1], strict=False):
            assert seen.setdefault(x, lowered(w)) == lowered(w)
    assert len(seen) == len({lowered(w) for w in words})


def lowered(w):
    return "".join(c.lower() if c.isascii() else c for c in w)


def test_components(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(1000 + i, 1001 + i) for i in range(60)]
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    got = {r["id"]: r["root"] for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {x: find(x) for e in edges for x in e if e[0] != e[1] or find(x) != x or x in got}
    assert components(spark.createDataFrame([], "u long, v long")).collect() == []
    with pytest.raises(RuntimeError, match="settle"):
        components(spark.createDataFrame(edges, "u long, v long"), most_steps=1)


def benchmark(spark, rows):
    return spark.createDataFrame(rows, "item_id long, text string")


def plain_words(t):
    return tuple(re.findall(r"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (t or "").lower()))


@lru_cache(maxsize=4000)
def masked(words, mask):
    """Where each choice of words by the mask stands."""
    out = defaultdict(list)
    for at in range(len(words) - max(mask)):
        out[tuple(words[at + i] for i in mask)].append(at)
    return out


def plain_overlap(doc, item):
    """(marked words, item words) of an item in a document, by trying every mask at every place; None if not enough."""
    n = len(item)
    masks = [tuple(range(n))] if n <= 4 else decontamination.MASKS
    lines = sorted({at - place for m in masks for key, places in masked(item, m).items() for at in masked(doc, m).get(key, ()) for place in places}) if n else []
    groups = []
    for s in lines:
        if groups and s - groups[-1][-1] <= max(4, n // 4):
            groups[-1].append(s)
        else:
            groups.append([s])
    best = 0
    for group in groups:
        marked = set()
        for s in group:
            on = [i for i in range(n) if 0 <= s + i < len(doc)]
            same = {i for i in on if doc[s + i] == item[i]}
            marked |= {i for i in same if (2 * len(same) > len(on) if len(on) <= 5 else sum(j in same for j in range(i - 2, i + 3)) >= 3)}
        best = max(best, len(marked))
    return (best, n) if best and best >= 0.5 * n else None


@pytest.mark.parametrize("block", [8_000_000, 300])
def test_decontamination(spark, docs, block):
    rng = random.Random(9)
    items = [(i, text(rng, rng.randint(14, 60))) for i in range(12)] + [(50, None), (51, ""), (52, "rare short item")]
    items += [(60 + i, f"the very same phrase here {text(rng, 20)} {i}") for i in range(20)] + [(3, items[3][1]), (None, items[5][1])]
    fill = lambda: text(rng, 60)
    w = items[3][1].split()
    rows = [
        (1, f"{fill()} {items[0][1]} {fill()}"), (2, f"{fill()} {items[1][1].upper()}, {fill()}"), (3, items[2][1]), (4, f"{fill()} {edited(rng, items[4][1], 3)} {fill()}"),
        (5, f"{fill()} {' '.join(w[:6] + ['inserted'] + w[6:])} {fill()}"), (6, "a rare, short item and"), (7, "a rare short item and"), (8, None), (9, ""), (10, fill()), (11, fill()), (1, fill()),
        (None, items[6][1]), (12, "the very same phrase here " * 40), (13, f"{text(rng, 3000)} {items[62 - 45][1]} é {text(rng, 3000)}"), (14, "x " * 20_000),
    ] + [(100 + i, f"{fill()} {' '.join(items[i % 12][1].split()[: rng.randint(4, 40)])} {fill()}") for i in range(40)]
    found = decontamination.overlaps(docs(rows), benchmark(spark, items), block_chars=block).collect()
    expected = Counter()
    for i, t in rows:
        for k, x in items:
            if held := plain_overlap(plain_words(t), plain_words(x)):
                expected[i, k, *held] += 1
    assert Counter((r["doc_id"], r["item_id"], r["matched"], r["item_words"]) for r in found) == expected
    assert {(1, 0), (2, 1), (3, 2), (4, 4), (5, 3), (6, 52), (7, 52)} <= {x[:2] for x in expected} and not {8, 9, 10, 11, 14} & {x[0] for x in expected}
    flagged = decontamination.contaminated(docs(rows).withColumn("contaminated", F.lit("old")), benchmark(spark, items), block_chars=block).collect()
    bad = {t for i, t in rows for k, x in items if plain_overlap(plain_words(t), plain_words(x))}
    assert Counter((r["doc_id"], r["text"], r["contaminated"]) for r in flagged) == Counter((i, t, t in bad) for i, t in rows)
    assert decontamination.overlaps(docs(rows), benchmark(spark, [])).count() == 0
    assert decontamination.overlaps(docs(rows).limit(0), benchmark(spark, items), block_chars=block).count() == 0


def test_decontamination_of_long_items(spark, docs):
    rng = random.Random(2)
    long = text(rng, 200)
    rows, items = [(1, " ".join(long.split()[20:60])), (2, " ".join(long.split()[20:130]))], benchmark(spark, [(1, long)])
    assert {r["doc_id"] for r in decontamination.overlaps(docs(rows), items).collect()} == {2}
    assert {r["doc_id"] for r in decontamination.overlaps(docs(rows), items, least_words=25).collect()} == {1, 2}


def labelled(rng, n):
    rows, labels = [], []
    for i in range(n):
        good = rng.random() < 0.7
        t = text(rng, rng.randint(20, 200)) + "."
        if not good:
            t = rng.choice([lambda: " ".join(x + "$$$" for x in t.split()), lambda: t.upper().replace(" ", "!! "), lambda: t.replace(" ", " | "), lambda: ("spam " * 40)])()
        rows.append((i, t))
        labels.append((i, int(good), 0))
    return rows, labels


def test_quality_on_held_out_rows(spark, docs):
    rows, labels = labelled(random.Random(4), 400)
    table = spark.createDataFrame([*labels, (None, 1, 0), (3, None, 0)], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r for r in quality.op7_quality(docs([*rows, (900, None), (901, "")]), table).collect()}
    out = [i for i, _ in rows if got[i]["held_out"]]
    assert all(got[i]["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) for i, _ in rows) and len(out) > 50
    assert np.mean([got[i]["predicted"] == labels[i][1] for i in out]) > 0.95
    assert 0 <= got[900]["score"] <= 1 and got[900]["score"] == got[901]["score"]
    kept = {r["doc_id"] for r in quality.keep_good(docs(rows), table).collect()}
    assert kept == {i for i, _ in rows if got[i]["predicted"]}
    held = {i for i, _, _ in labels if zlib.crc32(str(i).encode()) % 5 == 0}
    flipped = spark.createDataFrame([(i, 1 - q if i in held else q, t) for i, q, t in labels], "doc_id long, quality int, toxic int")
    again = {r["doc_id"]: r["score"] for r in quality.op7_quality(docs(rows), flipped).collect()}
    assert all(again[i] == pytest.approx(got[i]["score"], abs=1e-9) for i, _ in rows)


def test_quality_against_plain_formulas(spark, docs):
    rows, labels = labelled(random.Random(14), 300)
    rows.append((3, rows[10][1]))  # a repeated id counts by row
    table = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    stats = {t: quality.column_statistics(pa.array([t]))[0] for _, t in rows}
    quality_of = {i: q for i, q, _ in labels}
    train = [(stats[t], quality_of[i]) for i, t in rows if i in quality_of and zlib.crc32(str(i).encode()) % 5]
    classes = [np.array([x for x, q in train if q == c]) for c in (0, 1)]
    own = [np.cov(x.T) for x in classes]
    pooled = sum(c * (len(x) - 1) for c, x in zip(own, classes, strict=True)) / (len(train) - 2)
    logs = []
    for x, c in zip(classes, own, strict=True):
        cov = 0.7 * c + 0.3 * pooled
        cov = 0.7 * cov + 0.3 * np.diag(np.diag(cov)) + 1e-3 * np.eye(len(cov))
        gaps = np.array([stats[t] for _, t in rows]) - x.mean(axis=0)
        logs.append(-0.5 * np.einsum("ij,jk,ik->i", gaps, np.linalg.inv(cov), gaps) - 0.5 * np.linalg.slogdet(cov)[1])
    expected = 1 / (1 + np.exp(-np.clip(0.25 * (logs[1] - logs[0]) + math.log(len(classes[1]) / len(classes[0])), -500, 500)))
    for few in (1000, 0):
        got = quality.scored(docs(rows), table, broadcast_labels=few).collect()
        assert sorted((r["doc_id"], round(r["score"], 6)) for r in got) == sorted((i, round(float(x), 6)) for (i, _), x in zip(rows, expected, strict=True))


def test_quality_odd_tables(spark, docs):
    table = spark.createDataFrame([(1, 1, 0), (2, 0, 0), (3, 1, 0), (4, 0, 0)], "doc_id long, quality int, toxic int")
    assert quality.op7_quality(docs([(1, "a")]).limit(0), table).collect() == []
    got = quality.op7_quality(docs([(1, "a b"), (2, "c"), (3, "word " * 50_000), (4, None), (None, "x")]), table).collect()
    assert len(got) == 5 and all(0 <= r["score"] <= 1 for r in got)
    kept = quality.keep_good(docs([(1, "a b"), (2, "c")]).withColumn("quality", F.lit("clash")), table)
    assert kept.columns[-1] == "quality"


def test_quality_without_or_with_one_label(spark, docs):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r["score"] for r in quality.op7_quality(docs([(1, "a"), (2, None)]), none).collect()} == {0.5}
    one = spark.createDataFrame([(1, 1, 0), (2, 1, 0), (3, 1, 0)], "doc_id long, quality int, toxic int")
    assert {r["score"] for r in quality.op7_quality(docs([(1, "a"), (2, None), (3, "b")]), one).collect()} == {1.0}


def duck(name, df, sql):
    con = duckdb.connect()
    con.register("t", df.toPandas())
    con.execute(f"create view {name} as select * from t")
    return con.execute(sql).fetchall()


def mixture(rng):
    rows = [(i, text(rng, rng.randint(0, 40)), rng.choice(["a", "b", "c", "d", None])) for i in range(300)]
    rows += [(400 + i, text(rng, 30), "hot") for i in range(200)] + [(900, None, "a"), (901, "", "empty"), (5, "again here", "b"), (None, "no id here", "c")]
    rows += [(950, text(rng, n), "a") for n in (400, 300, 300, 110)] + [(None, "the same row", "d")] * 30 + [(None, text(rng, 9), None) for _ in range(20)]
    return rows


def twin(table):
    plain = table.select("doc_id", "text", "source")
    typed = "FROM (SELECT doc_id::bigint AS doc_id, text, source FROM documents)"
    return duck("documents", plain, mixing.ORACLE.replace("FROM documents", typed))


def by_hand(rows, weights=(3, 1, 2), share=1.5, most=2):
    """The mix as a queue that is served turn by turn: Counter of (id, text, source, copies)."""
    sizes = Counter()
    for _, t, s in rows:
        sizes[s] += len((t or "").encode().split())
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    open_, left, target = [s for s in order if sizes[s]], share * sum(sizes.values()), {}
    while open_:
        level = left / sum(weight[s] for s in open_)
        full = [s for s in open_ if level * weight[s] > most * sizes[s]]
        for s in full or open_:
            target[s] = float(most * sizes[s]) if full else level * weight[s]
            left -= target[s] if full else 0
        open_ = [s for s in open_ if s not in target]
    line = []
    for s in target:
        served = 0
        for k in range(most):
            for key, i in sorted((hashlib.md5(f"{'' if d is None else d}\x1f{t or ''}".encode()).hexdigest(), i) for i, (d, t, x) in enumerate(rows) if x == s and (t or "").split()):
                served += len(rows[i][1].encode().split())
                line.append((served / target[s], key, i))
    total, times = 0, Counter()
    for _, _, i in sorted(line):
        total += len(rows[i][1].encode().split())
        if total > share * sum(sizes.values()):
            break
        times[i] += 1
    return Counter((*rows[i], n) for i, n in times.items())


def test_mixing(docs):
    rows = mixture(random.Random(8))
    table = docs(rows)
    got = mixing.op1_mixing(table)
    order = lambda x: tuple((v is None, v) for v in x)
    mine = sorted(((r["doc_id"], r["size"], r["source_size"], round(r["target"], 4), r["taken"]) for r in got.collect()), key=order)
    assert mine == sorted(((r[0], r[1], r[2], round(r[3], 4), r[4]) for r in twin(table)), key=order)
    per = defaultdict(lambda: [0, 0.0, 0, 0])
    for _, size, whole, target, taken in mine:
        assert taken in (0, size, 2 * size)
        p = per[whole, target]
        p[0], p[1], p[2], p[3] = p[0] + taken, target, max(p[2], size), whole
    assert all(abs(p[0] - p[1]) <= p[2] + 1 and p[1] <= 2 * p[3] for p in per.values())
    # Queue, mix and a mix by hand agree on every row, repeated ids and equal rows too.
    expected = by_hand(rows)
    lined = mixing.queue(table).where("copies > 0").groupBy("doc_id", "source", "size", "copies").count().collect()
    counted = Counter()
    for (i, t, s, n), k in expected.items():
        counted[i, s, len(t.split()), n] += k
    assert {(r["doc_id"], r["source"], r["size"], r["copies"]): r["count"] for r in lined} == counted
    for in_order in (False, True):
        mixed = mixing.mix(table.withColumn("_key", F.lit("clash")), in_order=in_order)
        assert Counter((r["doc_id"], r["text"], r["source"], r["copies"]) for r in mixed.collect()) == expected and "_key" in mixed.columns
    assert sum(len(t.split()) * n * k for (_, t, _, n), k in expected.items()) <= 1.5 * sum(r[1] for r in mine)


def test_mixing_equal_rows_at_the_cut(docs):
    rows = [(None, "three words here", "a")] * 50 + [(i, "one", "b") for i in range(9)]
    table = docs(rows)
    assert Counter((r["doc_id"], r["text"], r["source"], r["copies"]) for r in mixing.mix(table).collect()) == by_hand(rows)
    assert mixing.op1_mixing(table).agg(F.sum("taken")).first()[0] == sum(len(t.split()) * n * k for (_, t, _, n), k in by_hand(rows).items())


def test_mixing_odd_tables(docs):
    assert mixing.op1_mixing(docs([(1, "a b", "x")]).limit(0)).collect() == [] and mixing.mix(docs([(1, "a b", "x")]).limit(0)).collect() == []
    assert mixing.op1_mixing(docs([(1, "", "x"), (2, None, "y")])).agg(F.sum("taken")).first()[0] == 0
    assert mixing.mix(docs([(1, "", "x")])).collect() == []
    assert mixing.mix(docs([(1, "w " * 30_000, "x"), (2, "w", "y")])).count() >= 1


def chats(rng):
    rows = []
    for c in range(60):
        turns = [(t, rng.choice(["user", "assistant", None]), rng.choice(["hi", "yes", None, "", text(rng, 4)])) for t in range(rng.randint(1, 5))]
        rows += [(c, *t) for t in turns]
        if rng.random() < 0.5:
            rows += [(100 + c, *t) for t in turns[: rng.randint(1, len(turns))]]
    rows += [(300, t, "user", f"t{t}") for t in range(2500)] + [(301, t, "user", f"t{t}") for t in range(2100)]
    rows += [(303, None, "user", f"u{t}") for t in range(1500)] + [(304, 7, "user", f"v{t}") for t in range(1100)] + [(305, 1, "user", "again")] * 500
    return rows + [(None, 0, "user", "x"), (302, None, "user", "late"), (302, 1, "user", "early"), (306, 0, "user", "w" * 200_000), rows[0]]


def test_chat_format(spark):
    rows = chats(random.Random(6))
    table = spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, cell string").repartition(5)
    mine = sorted((r["conv_id"] if r["conv_id"] is not None else -1, r["n_turns"], r["rendered"]) for r in chat_format.op8_chat_format(table).collect())
    typed = "(SELECT conv_id::bigint AS conv_id, turn::bigint AS turn, role, text FROM conversations)"
    theirs = duck("conversations", table.drop("cell"), chat_format.ORACLE.replace("FROM conversations", f"FROM {typed}"))
    assert mine == sorted((-1 if r[0] is None else r[0], r[1], r[2]) for r in theirs)
    whole = {i: rendered for i, _, rendered in mine}
    assert len(whole) == len(mine) and 301 not in whole and {300, 303, 304, 305, 306} <= set(whole)
    parts = defaultdict(str)
    for r in sorted(chat_format.formatted(table, 1000).collect(), key=lambda r: r["segment"]):
        parts[-1 if r["conv_id"] is None else r["conv_id"]] += r["rendered"]
    assert parts == whole
    assert chat_format.formatted(table, 10).where("conv_id = 303").count() == 150
    assert chat_format.op8_chat_format(table.limit(0)).collect() == []
