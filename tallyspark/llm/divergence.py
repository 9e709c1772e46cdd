"""Divergence of the sources of a language, priced by inclusion-exclusion over their supports.

Every pair of sources is compared over all kept terms of their language, of which most occur in one of them or in none. So the sum is split: a term that one source has and the
other has not costs what its count says, for which a histogram of counts a source is enough, not its terms; terms that both have are met by a join of postings, which
puts the exact value in place of the two one-sided ones; and all terms that neither has cost the same, so their number, by inclusion-exclusion, times a constant is
enough. The work is that of the postings that two sources share, not of sources x sources x vocabulary.

Counts are added up where the texts are read, so a source with a third of all documents is a table of its terms like any other. All arithmetic is in whole numbers.

Defined cases: null texts, languages and sources are empty texts; a source without terms is a group whose terms all have count 0; a language whose terms are all rare has no kept
terms, and 0 for each pair; a language with one source has no pairs; repeated rows count each; ties rank by the item's bytes; empty tables give empty results; other columns
are not looked at.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded_batches, released, stored
from .wordhash import text_bytes

SCALE, LEAST_DOCS, TOP = 1_000_000_000, 10, 10
#: What each byte of a text becomes: A-Z their lower case, other ASCII than letters a space; bytes of longer characters stay.
TERM_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
#: Distinct terms that a task holds before it hands its counts on.
HELD = 300_000
COUNTS = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.binary()), ("n", pa.int64()), ("docs", pa.int64())])


def terms(text: bytes) -> list[bytes]:
    return text.translate(TERM_BYTES).split()


def term_counts(docs: DataFrame) -> DataFrame:
    """lang, source, term (UTF-8), n occurrences, docs that hold it. Each group has one more row whose term is null, with its number of documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, str], tuple[Counter[bytes], Counter[bytes]]] = {}
        size = 0

        def flush() -> pa.RecordBatch:
            rows = [(*group, None, 0, counts[1].pop(b"", 0)) for group, counts in held.items()]
            rows += [(*group, term, n, counts[1][term]) for group, counts in held.items() for term, n in counts[0].items()]
            held.clear()
            columns = list(zip(*rows, strict=True)) if rows else [[]] * len(COUNTS)
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, COUNTS, strict=True)], schema=COUNTS)

        for batch in batches:
            data, offsets = text_bytes(batch.column(2))
            for i, group in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)):
                n, docs_of = held.setdefault(group, (Counter(), Counter()))
                before = len(n)
                found = Counter(terms(data[offsets[i] : offsets[i + 1]].tobytes()))
                for term, times in found.items():
                    n[term] += times
                docs_of.update(found.keys())
                docs_of[b""] += 1
                size += len(n) - before
                if size >= HELD:
                    yield flush()
                    size = 0
        if held:
            yield flush()

    bounded_batches(docs.sparkSession)
    empty = F.lit("")
    chosen = docs.select(F.coalesce("lang", empty).alias("lang"), F.coalesce("source", empty).alias("source"), F.coalesce("text", empty).alias("text"))
    counts = chosen.mapInArrow(released(run), "lang string, source string, term binary, n long, docs long")
    return counts.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def _share(n: Column, total: Column) -> Column:
    """1 + floor(1000000000 * (n + 2) / total), exact for counts of any size that occur (the product would not fit a long)."""
    wide = (n + 2).cast("decimal(20,0)") * F.lit(SCALE).cast("decimal(10,0)")
    return F.lit(1) + F.call_function("div", wide, total.cast("decimal(20,0)"))


def _cost(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), p + q)


def divergence(docs: DataFrame, least_docs: int = LEAST_DOCS, top: int = TOP, broadcast_terms: int = 300_000) -> DataFrame:
    """lang, source, part, item, value, rank: part ``pair`` is the divergence from each other source of the language, part ``term`` the terms that set a source apart most."""
    counts = stored(term_counts(docs), "term-counts")
    of_lang = counts.where("term is not null").groupBy("lang", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    kept = stored(of_lang.where(F.col("docs") >= least_docs).select("lang", "term", "n"), "kept-terms")
    langs = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("v"), F.sum("n").alias("n_lang"))

    known = kept.select("lang", "term", F.col("n").alias("all_n"))
    if kept.count() <= broadcast_terms:
        known = F.broadcast(known)

    # A row for each group, with its number of kept occurrences and terms; groups without any are there too.
    rows = counts.where("n > 0").select("lang", "source", "term", "n").join(known, ["lang", "term"])
    own = rows.groupBy("lang", "source").agg(F.sum("n").alias("n_group"), F.count(F.lit(1)).alias("terms"))
    groups = counts.where("term is null").select("lang", "source").join(own, ["lang", "source"], "left").join(langs, "lang", "left")
    groups = groups.na.fill(0, ["n_group", "terms", "v", "n_lang"])
    total, nothing = F.col("n_group") + 2 * F.col("v"), F.lit(0)
    # p0 is the share of a term that the group hasn't; without kept terms no share is used.
    groups = groups.withColumn("total", total).withColumn("p0", F.when(F.col("v") > 0, _share(nothing, F.col("total"))).otherwise(1))
    groups = stored(groups, "groups")

    joined = rows.join(groups.select("lang", "source", "total", "p0", "v", "n_lang"), ["lang", "source"])
    postings = joined.withColumn("p", _share(F.col("n"), F.col("total"))).withColumn("q", _share(F.col("all_n"), F.col("n_lang") + 2 * F.col("v")))
    postings = stored(postings.select("lang", "source", "term", "n", "p", "q", "p0"), "postings")

    return _pairs(groups, postings).unionByName(_top_terms(postings, top))


def _ranked(df: DataFrame, part: str, most: int | None = None) -> DataFrame:
    order = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), F.col("item").asc())
    ranked = df.withColumn("rank", F.row_number().over(order))
    ranked = ranked.where(F.col("rank") <= most) if most else ranked
    return ranked.select("lang", "source", F.lit(part).alias("part"), "item", "value", "rank")


def _top_terms(postings: DataFrame, top: int) -> DataFrame:
    more = postings.where("p > q").select("lang", "source", F.col("term").cast("string").alias("item"), _cost(F.col("p"), F.col("q")).alias("value"))
    return _ranked(more, "term", top)


def _pairs(groups: DataFrame, postings: DataFrame) -> DataFrame:
    # One-sided: each distinct count of a group, priced against the share of absent terms of each other group.
    histogram = postings.groupBy("lang", "source", "p").agg(F.count(F.lit(1)).alias("times"))
    absent = groups.groupBy("lang", "p0").agg(F.count(F.lit(1)).alias("_n")).select("lang", F.col("p0").alias("other_p0"))
    price = _cost(F.col("p"), F.col("other_p0"))
    one_sided = histogram.join(absent, "lang").groupBy("lang", "source", "other_p0").agg(F.sum(F.col("times") * price).alias("one_sided"))

    # Both: the exact value instead of the two one-sided ones, for terms that both groups have; each pair once.
    left = postings.select("lang", "term", F.col("source").alias("a"), F.col("p").alias("pa"), F.col("p0").alias("a0"))
    right = postings.select("lang", "term", F.col("source").alias("b"), F.col("p").alias("pb"), F.col("p0").alias("b0"))
    both = left.join(right, ["lang", "term"]).where("a < b")
    right_price = _cost(F.col("pa"), F.col("pb")) - _cost(F.col("pa"), F.col("b0")) - _cost(F.col("a0"), F.col("pb"))
    shared = both.groupBy("lang", "a", "b").agg(F.sum(right_price).alias("change"), F.count(F.lit(1)).alias("shared"))
    shared = shared.unionByName(shared.select("lang", F.col("b").alias("a"), F.col("a").alias("b"), "change", "shared"))

    one = groups.select("lang", F.col("source").alias("a"), F.col("p0").alias("a0"), F.col("terms").alias("a_terms"), "v")
    other = groups.select("lang", F.col("source").alias("b"), F.col("p0").alias("b0"), F.col("terms").alias("b_terms"))
    pairs = one.join(other, "lang").where("a <> b")
    side = one_sided.withColumnRenamed("other_p0", "b0").withColumnRenamed("source", "a").withColumnRenamed("one_sided", "a_side")
    back = one_sided.withColumnRenamed("other_p0", "a0").withColumnRenamed("source", "b").withColumnRenamed("one_sided", "b_side")
    priced = pairs.join(side, ["lang", "a", "b0"], "left").join(back, ["lang", "b", "a0"], "left").join(shared, ["lang", "a", "b"], "left")
    priced = priced.na.fill(0, ["a_side", "b_side", "change", "shared"])
    neither = F.col("v") - F.col("a_terms") - F.col("b_terms") + F.col("shared")
    value = F.col("a_side") + F.col("b_side") + F.col("change") + neither * _cost(F.col("a0"), F.col("b0"))
    return _ranked(priced.select("lang", F.col("a").alias("source"), F.col("b").alias("item"), value.alias("value")), "pair")


def op12_divergence(docs: DataFrame) -> DataFrame:
    return divergence(docs)


ORACLE = """
WITH docs AS (
  SELECT row_number() OVER () AS doc, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents
), words AS (
  SELECT doc, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM docs
), kept AS (
  SELECT lang, term, count(*) AS n FROM words GROUP BY lang, term HAVING count(DISTINCT doc) >= 10
), langs AS (
  SELECT lang, count(*) AS v, sum(n) AS n FROM kept GROUP BY lang
), groups AS (
  SELECT DISTINCT lang, source FROM docs
), counted AS (
  SELECT g.lang, g.source, k.term, k.n AS all_n, coalesce(w.n, 0) AS n
  FROM groups g JOIN kept k ON g.lang = k.lang
  LEFT JOIN (SELECT lang, source, term, count(*) AS n FROM words GROUP BY ALL) w ON w.lang = g.lang AND w.source = g.source AND w.term = k.term
), shares AS (
  SELECT c.*, 1 + (1000000000 * (c.n + 2)::HUGEINT) // (sum(c.n) OVER (PARTITION BY c.lang, c.source) + 2 * l.v)::HUGEINT AS p,
    1 + (1000000000 * (c.all_n + 2)::HUGEINT) // (l.n + 2 * l.v)::HUGEINT AS q
  FROM counted c JOIN langs l ON c.lang = l.lang
), both_shares AS (
  SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) AS value
  FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
), pairs AS (
  SELECT a.lang, a.source, b.source AS item, coalesce(s.value, 0) AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN both_shares s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
), terms AS (
  SELECT lang, source, term AS item, ((p - q) * (p - q)) // (p + q) AS value FROM shares WHERE n > 0 AND p > q
), ranked AS (
  SELECT lang, source, 'pair' AS part, item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS rank FROM pairs
  UNION ALL
  SELECT lang, source, 'term' AS part, item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS rank FROM terms
)
SELECT lang, source, part, item, value::BIGINT AS value, rank::INTEGER AS rank FROM ranked WHERE part = 'pair' OR rank <= 10
"""
