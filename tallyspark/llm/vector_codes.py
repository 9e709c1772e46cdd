"""Vector codes: a product quantiser in whole numbers, whose nearest entries are found by segment-mean lower bounds.

A vector becomes integers, floor(4096 x), and is cut into equal parts; each part position has a codebook of a few entries. The squared distance of a part and an entry is at
least what their block means and the norms of what the means leave over differ by: for blocks of b components with sums S and T, and residual norms R and Q,
(S - T)^2 / b added up over blocks, plus (R - Q)^2. Blocks go from coarse (the whole part) to fine (halves, down to two components): each level drops entries whose bound
is above the exact distance of the entry that looks best, so the nearest entry always survives. The bounds are floating-point numbers and made smaller by more than their rounding error; survivors get exact
integer distances, and the least distance, then the lowest index, wins.

Rounds: each task assigns its rows and hands on sums and counts of each entry; Spark adds them up, and the driver gets the codebooks alone (parts x entries). Sums are decimals,
so they do not overflow. The integer vectors are stored once and read in each round.

Defined cases: rows whose vector is null, or holds null, NaN or infinite components, are dropped, as the contract says; so are those whose length is not that of most
kept rows (ties: the longer), or is no multiple of the number of parts, since they cannot be cut into the same parts. Fewer kept rows than entries make smaller
codebooks; rows without an id start no codebook as long as others do; of rows with the same id the one with the lesser integers comes first; repeated rows count each. Components up
to 2**100 are exact (larger ones raise): where 64-bit integers do not hold the distances, Python's integers are used; an error beyond a long is null. Empty tables give empty results; other columns are kept by ``encode``, and not looked at
by the query.
"""

from __future__ import annotations

import decimal
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import free_name, released, stored

SCALE, PARTS, ENTRIES, ROUNDS = 4096, 8, 16, 6
#: Integers up to this size have squared distances of parts of up to 2**10 components that 64 bits hold.
SMALL = 1 << 25
#: Components from this size on are refused: decimals don't hold their sums.
LARGEST = 2.0**100
#: Rows looked at in one step.
STEP = 4096

Codebooks = np.ndarray


def _levels(width: int) -> list[int]:
    """Block sizes, coarse to fine."""
    sizes, size = [], width
    while size > 1:
        sizes.append(size)
        if size % 2:
            break
        size //= 2
    return sizes


def _sketch(x: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(sums of blocks divided by the root of their size, norm of what the means leave over) of each row."""
    blocks = x.reshape(len(x), -1, size).astype(np.float64)
    sums = blocks.sum(axis=2)
    rest = (blocks - sums[:, :, None] / size).reshape(len(x), -1)
    return sums / np.sqrt(size), np.sqrt((rest * rest).sum(axis=1))


def nearest(x: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """For each row of x (integers): index of and exact squared distance to the nearest entry, ties to the lower index; and how many exact distances that took."""
    n, k = len(x), len(entries)
    if not x.shape[1]:
        return np.zeros(n, np.int64), np.zeros(n, np.int64), 0

    def exact(rows: np.ndarray, at: np.ndarray) -> np.ndarray:
        d = x[rows] - entries[at]
        return (d * d).sum(axis=1)

    rows, at, best = np.repeat(np.arange(n), k), np.tile(np.arange(k), n), None
    for size in _levels(x.shape[1]):
        means, norms = _sketch(x, size)
        entry_means, entry_norms = _sketch(entries, size)
        if best is None:
            # All entries at once at the coarsest level; the one with the least bound gives the distance to beat.
            bound = ((means[:, None, :] - entry_means[None, :, :]) ** 2).sum(axis=2) + (norms[:, None] - entry_norms[None, :]) ** 2
            best = exact(np.arange(n), bound.argmin(axis=1))
            bound = bound.ravel()
        else:
            bound = ((means[rows] - entry_means[at]) ** 2).sum(axis=1) + (norms[rows] - entry_norms[at]) ** 2
        # Rounding: sums of squares of doubles differ from the true ones by far less than this share of the norms.
        scale = norms * norms + (means * means).sum(axis=1)
        entry_scale = entry_norms * entry_norms + (entry_means * entry_means).sum(axis=1)
        slack = 1e-9 * (scale[rows] + entry_scale[at]) + 1e-6
        stay = bound - slack <= best[rows].astype(np.float64)
        rows, at = rows[stay], at[stay]
    distance = exact(rows, at)
    begins = np.searchsorted(rows, np.arange(n))
    least = np.minimum.reduceat(distance, begins) if n else distance
    hit = np.flatnonzero(distance == least[rows])
    # Survivors are in order of row, then index: the first hit of a row is the lowest index.
    first = hit[np.searchsorted(rows[hit], np.arange(n))]
    return at[first], least, len(rows)


def _ints(column: pa.Array, width: int) -> np.ndarray:
    """Stored integer vectors as rows; 64-bit where distances then fit."""
    flat = column.flatten()
    if flat.type == pa.int64():
        return flat.to_numpy(zero_copy_only=False).reshape(-1, width)
    wide = np.array([int(x) for x in flat.to_pylist()], dtype=object)
    return wide.reshape(-1, width)


def _fit(x: np.ndarray, books: list[np.ndarray]) -> tuple[np.ndarray, list[np.ndarray]]:
    """x and codebooks in one integer type that holds exact distances."""
    most = max([int(abs(x).max()) if x.size else 0, *[int(abs(b).max()) if b.size else 0 for b in books]])
    if most <= SMALL and x.shape[1] // max(len(books), 1) <= 1 << 10:
        return x.astype(np.int64), [b.astype(np.int64) for b in books]
    return x.astype(object), [b.astype(object) for b in books]


def _assigned(x: np.ndarray, books: list[np.ndarray]) -> tuple[np.ndarray, list[np.ndarray]]:
    """Code of each part and row, and the distances, part by part."""
    x, books = _fit(x, books)
    width = x.shape[1] // len(books)
    codes, distances = np.empty((len(x), len(books)), np.int64), []
    for p, book in enumerate(books):
        found = [nearest(x[i : i + STEP, p * width : (p + 1) * width], book)[:2] for i in range(0, len(x), STEP)]
        codes[:, p] = np.concatenate([c for c, _ in found])
        distances.append(np.concatenate([d for _, d in found]))
    return codes, distances


def with_ints(rows: DataFrame, vector: str, parts: int, scale: int = SCALE) -> tuple[DataFrame, int]:
    """(rows that can be cut, with ``_ints``: floor(scale * component); number of components)."""
    v = F.col(vector)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    kept = rows.where(v.isNotNull() & F.coalesce(finite, F.lit(False)))
    common = kept.where(F.size(v) % parts == 0).groupBy(F.size(v).alias("d")).count().orderBy(F.col("count").desc(), F.col("d").desc()).first()
    width = common["d"] if common else 0
    kept = kept.where(F.size(v) == width)
    large = kept.agg(F.max(F.array_max(F.transform(v, lambda x: F.abs(x.cast("double")))))).first()[0]
    # The product is exact: 4096 is a power of two.
    if large is None or large * scale < 2.0**62:
        return kept.withColumn("_ints", F.transform(v, lambda x: F.floor(x.cast("double") * scale))), width
    if large >= LARGEST:
        raise ValueError(f"components must be below {LARGEST} in size, one is {large}")
    step = 2.0**62

    def wide(x: Column) -> Column:
        y = x.cast("double") * scale
        high = F.floor(y / step)
        return (high.cast("decimal(19,0)") * F.lit(1 << 62).cast("decimal(19,0)") + F.floor(y - high.cast("double") * step).cast("decimal(19,0)")).cast("decimal(38,0)")

    return kept.withColumn("_ints", F.transform(v, wide)), width


def first_codebooks(ints: DataFrame, vec_id: str, width: int, parts: int, entries: int) -> list[np.ndarray]:
    order = [F.col(vec_id).asc_nulls_last(), F.col("_ints").asc()]
    first = ints.select(vec_id, "_ints").orderBy(*order).limit(entries).collect()
    rows = np.array([[int(x) for x in r["_ints"]] for r in first], dtype=object).reshape(len(first), width)
    part = width // parts
    return [rows[:, p * part : (p + 1) * part] for p in range(parts)]


def next_codebooks(ints: DataFrame, books: list[np.ndarray], width: int) -> list[np.ndarray]:
    """One round: every part goes to its nearest entry, then each entry becomes the floor of the mean of its parts; entries without parts stay."""
    part = width // len(books)
    fields = [pa.field("part", pa.int32()), pa.field("entry", pa.int32()), pa.field("n", pa.int64()), *[pa.field(f"s{i}", pa.decimal128(38, 0)) for i in range(part)]]
    schema = pa.schema(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = [np.zeros(len(b), np.int64) for b in books]
        sums = [np.zeros(b.shape, dtype=object) for b in books]
        for batch in batches:
            x = _ints(batch.column(0), width)
            codes, _ = _assigned(x, books)
            for p in range(len(books)):
                counts[p] += np.bincount(codes[:, p], minlength=len(counts[p]))
                own = x[:, p * part : (p + 1) * part]
                for e in np.unique(codes[:, p]).tolist():
                    sums[p][e] += own[codes[:, p] == e].sum(axis=0).astype(object)
        rows = [(p, e, int(counts[p][e]), sums[p][e]) for p in range(len(books)) for e in range(len(books[p])) if counts[p][e]]
        with decimal.localcontext(prec=40):
            of = [pa.array([decimal.Decimal(int(r[3][i])) for r in rows], pa.decimal128(38, 0)) for i in range(part)]
        made = [pa.array([r[j] for r in rows], f.type) for j, f in enumerate(fields[:3])]
        yield pa.RecordBatch.from_arrays([*made, *of], schema=schema)

    columns = ", ".join(["part int", "entry int", "n long", *[f"s{i} decimal(38,0)" for i in range(part)]])
    partial = ints.select("_ints").mapInArrow(released(run), columns)
    found = partial.groupBy("part", "entry").agg(F.sum("n").alias("n"), *[F.sum(f"s{i}").alias(f"s{i}") for i in range(part)])
    books = [b.copy() for b in books]
    for row in found.collect():
        books[row["part"]][row["entry"]] = [int(row[f"s{i}"]) // row["n"] for i in range(part)]
    return books


def fingerprint(books: list[np.ndarray]) -> str:
    return hashlib.sha256(",".join(str(int(x)) for b in books for x in b.ravel()).encode()).hexdigest()


def fit(ints: DataFrame, vec_id: str, width: int, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> list[np.ndarray]:
    """Codebooks, one array (entries, components) a part position, from integer vectors."""
    books = first_codebooks(ints, vec_id, width, parts, entries)
    for _ in range(rounds if len(books[0]) else 0):
        books = next_codebooks(ints, books, width)
    return books


def encode(ints: DataFrame, books: list[np.ndarray], width: int) -> DataFrame:
    """ints without ``_ints``, and code, error: indexes in part order as two hex digits each, and the squared distances added up."""
    names = [c for c in ints.columns if c != "_ints"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _ints(batch.column(batch.num_columns - 1), width)
            codes, distances = _assigned(x, books)
            digits = [bytes(row).hex() for row in codes.astype(np.uint8).tolist()]
            errors = [int(e) if e < 1 << 63 else None for e in sum(d.astype(object) for d in distances)] if len(x) else []
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(digits, pa.string()), pa.array(errors, pa.int64())], names=[*names, "code", "error"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ints.schema if f.name != "_ints")
    return ints.select(*names, "_ints").mapInArrow(released(run), f"{schema}, code string, error long")


def with_label_errors(coded: DataFrame, label: str, broadcast_rows: int = 100_000) -> DataFrame:
    """coded and label_error, the errors added up over equal labels, nulls together."""
    key, total = free_name(coded.columns, "_label"), free_name(coded.columns, "_total")
    whole = F.when(F.count("error") == F.count(F.lit(1)), F.sum(F.col("error").cast("decimal(38,0)")))
    sums = stored(coded.groupBy(F.col(label).alias(key)).agg(whole.alias(total)), "label-errors")
    if sums.count() <= broadcast_rows:
        sums = F.broadcast(sums)
    joined = coded.join(sums, F.col(label).eqNullSafe(F.col(key)))
    fits = F.col(total) <= F.lit((1 << 63) - 1).cast("decimal(38,0)")
    return joined.withColumn("label_error", F.when(fits, F.col(total).cast("long"))).drop(key, total)


def compress(spark: SparkSession, rows: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label") -> tuple[DataFrame, list[np.ndarray]]:
    """(rows without their vector, with code, error and label_error; the codebooks)."""
    ints, width = with_ints(rows, vector, PARTS)
    ints = stored(ints.drop(vector), "vectors")
    books = fit(ints, vec_id, width)
    coded = stored(encode(ints, books, width), "codes")
    return with_label_errors(coded, label), books


def op13_vector_codes(spark: SparkSession, embeddings: DataFrame) -> DataFrame:
    coded, books = compress(spark, embeddings.select("vec_id", "embedding", "label"))
    return coded.select("vec_id", "code", "error", "label_error", F.lit(fingerprint(books)).alias("codebooks_sha256"))


def oracle(width: int = 64, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> str:
    """DuckDB SQL of the same rows for vectors of any length that parts divides; each round is a step of its own."""
    part = f"len(i) // {parts}"
    steps = [
        f"""ints AS (
  SELECT vec_id, label, [floor(x::DOUBLE * {SCALE})::BIGINT FOR x IN embedding] AS i FROM embeddings
  WHERE embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
), rows_ AS (
  SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, i) AS r, vec_id, label, i FROM ints
), comps AS (
  SELECT r, p, k, i[p * ({part}) + k + 1] AS x FROM rows_, range({parts}) t(p), LATERAL (SELECT unnest(range({part})) AS k)
), b0 AS (
  SELECT p, r - 1 AS e, k, x AS y FROM comps WHERE r <= {entries}
)"""
    ]
    for n in range(rounds + 1):
        steps.append(f"""d{n} AS (
  SELECT r, p, e, sum((x - y) * (x - y)) AS d FROM comps JOIN b{n} USING (p, k) GROUP BY r, p, e
), a{n} AS (
  SELECT r, p, arg_min(e, (d, e)) AS e, min(d) AS d FROM d{n} GROUP BY r, p
)""")
        if n < rounds:
            steps.append(f"""m{n} AS (
  SELECT p, e, k, sum(x) AS s, count(*) AS c FROM comps JOIN a{n} USING (r, p) GROUP BY p, e, k
), b{n + 1} AS (
  SELECT b.p, b.e, b.k, CASE WHEN m.c IS NULL THEN b.y ELSE (s - ((s % c) + c) % c) // c END::BIGINT AS y FROM b{n} b LEFT JOIN m{n} m USING (p, e, k)
)""")
    last = rounds
    steps.append(f"""coded AS (
  SELECT r, string_agg(printf('%02x', e), '' ORDER BY p) AS code, sum(d)::BIGINT AS error FROM a{last} GROUP BY r
), labelled AS (
  SELECT vec_id, label, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error FROM coded JOIN rows_ USING (r)
)""")
    return "WITH " + ", ".join(steps) + f"""
SELECT vec_id, code, error, label_error, (SELECT sha256(string_agg(y::VARCHAR, ',' ORDER BY p, e, k)) FROM b{last}) AS codebooks_sha256 FROM labelled"""


ORACLE = oracle()
