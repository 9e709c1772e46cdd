import random
import re
from collections import Counter

import duckdb
import pytest

from tallyspark.llm import divergence

LOWER = {c: c + 32 for c in range(65, 91)}
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, term string, value string, p long"


def by_hand(rows, least_docs=10, top=10):
    """Every term against every pair."""
    docs = [(lang or "", source or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(LOWER))) for _, text, lang, source, *_ in rows]
    out = set()
    for lang in {x[0] for x in docs}:
        df, all_n = Counter(), Counter()
        for at, _, terms in docs:
            if at == lang:
                df.update(set(terms))
                all_n.update(terms)
        kept = sorted(t for t in df if df[t] >= least_docs)
        v = len(kept)

        def shares(n, v=v, kept=kept):
            total = sum(n[t] for t in kept)
            return {t: 1 + 1_000_000_000 * (n[t] + 2) // (total + 2 * v) for t in kept}

        counts = {s: Counter(t for a, b, ts in docs if (a, b) == (lang, s) for t in ts) for s in {b for a, b, _ in docs if a == lang}}
        p, q = {s: shares(n) for s, n in counts.items()}, shares(all_n)
        cost = lambda a, b: (a - b) * (a - b) // (a + b)
        for s in counts:
            pairs = [(sum(cost(p[s][t], p[o][t]) for t in kept), o) for o in counts if o != s]
            terms = [(cost(p[s][t], q[t]), t) for t in kept if counts[s][t] > 0 and p[s][t] > q[t]]
            for part, found, most in (("pair", pairs, None), ("term", terms, top)):
                for rank, (value, item) in enumerate(sorted(found, key=lambda x: (-x[0], x[1].encode()))[:most], 1):
                    out.add((lang, s, part, item, value, rank))
    return out


def table(spark, rows):
    return spark.createDataFrame([(i, t, lang, s, 0, "t", "v", 7) for i, t, lang, s in rows], COLUMNS).repartition(3)


@pytest.fixture
def rows():
    rng = random.Random(11)
    words = ["Alpha", "beta", "GAMMA", "naïve", "中文", "Σigma", "x1y", "it's", "A", "État", "d_e", "rare"]
    out = [(i, " ".join(rng.choice(words[: rng.randint(2, 12)]) for _ in range(rng.randrange(30))), rng.choice(["en", "de"]), rng.choice(["s0", "s0", "s1", "s2", "é"])) for i in range(150)]
    out += [(200 + i, "only here only", "fr", "lone") for i in range(12)]
    out += [(300, None, "en", "silent"), (301, "", "en", "silent"), (302, "alpha", None, None), (303, "beta", None, "s1"), (304, "12 -- !", "it", "s0"), (305, "few", "it", "s1"), (None, "alpha beta", "en", "s1")]
    return out + out[:5]


def test_against_every_term_and_pair(spark, rows):
    got = [tuple(r) for r in divergence.op12_divergence(table(spark, rows)).collect()]
    assert len(got) == len(set(got)) and set(got) == by_hand(rows)


def test_small_batches_of_counts(spark, rows, monkeypatch):
    monkeypatch.setattr(divergence, "HELD", 3)
    got = divergence.divergence(table(spark, rows), least_docs=2, top=3, broadcast_terms=0)
    assert {tuple(r) for r in got.collect()} == by_hand(rows, 2, 3)


def test_terms_are_the_pattern_s():
    text = "".join(map(chr, range(1, 0x250))) + "中Z\U0001f600_a\x7fB"
    assert [t.decode() for t in divergence.terms(text.encode())] == re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text.translate(LOWER))


def test_counts_too_large_for_a_product(spark):
    big = spark.sql("SELECT 30000000000 AS n, 70000000001 AS total").select(divergence._share(divergence.F.col("n"), divergence.F.col("total")).alias("p")).first()
    assert big.p == 1 + 1_000_000_000 * 30_000_000_002 // 70_000_000_001


def test_sql(spark, rows):
    con = duckdb.connect()
    con.register("documents", table(spark, rows).toPandas())
    assert {tuple(r) for r in con.sql(f"SELECT lang, source, part, item, value, rank FROM ({divergence.ORACLE})").fetchall()} == by_hand(rows)


def test_empty_table(spark):
    got = divergence.op12_divergence(table(spark, [(1, "a", "b", "c")]).limit(0))
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"] and got.count() == 0
