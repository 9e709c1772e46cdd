import hashlib
import random

import duckdb
import numpy as np
import pytest

from tallyspark.llm import vector_codes as V

SCHEMA = "vec_id long, embedding array<float>, label int, code string, error string"


def by_hand(rows):
    """The contract in Python's integers: each entry against each part."""
    kept = []
    for vec_id, vector, label in rows:
        if vector is not None and not any(x is None or not np.isfinite(x) for x in vector):
            kept.append((vec_id, [int(np.floor(float(np.float32(x)) * 4096)) if abs(x) < 1e15 else int(float(np.float32(x)) * 4096) for x in vector], label))
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    width = len(kept[0][1]) // 8
    parts = [[r[1][p * width : (p + 1) * width] for r in kept] for p in range(8)]
    books = [[list(x) for x in own[:16]] for own in parts]

    def assign():
        return [[min((sum((a - b) ** 2 for a, b in zip(x, e, strict=True)), i) for i, e in enumerate(books[p])) for x in parts[p]] for p in range(8)]

    for _ in range(6):
        at = assign()
        for p in range(8):
            for e in range(len(books[p])):
                own = [x for x, (_, i) in zip(parts[p], at[p], strict=True) if i == e]
                if own:
                    books[p][e] = [sum(c) // len(own) for c in zip(*own, strict=True)]
    at = assign()
    sha = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    errors = [sum(at[p][i][0] for p in range(8)) for i in range(len(kept))]
    of_label = {}
    for r, e in zip(kept, errors, strict=True):
        of_label[r[2]] = of_label.get(r[2], 0) + e
    long = lambda x: x if x < 1 << 63 else None
    return sorted([(r[0], "".join(f"{at[p][i][1]:02x}" for p in range(8)), long(errors[i]), long(of_label[r[2]]), sha) for i, r in enumerate(kept)], key=str)


def run(spark, rows):
    table = spark.createDataFrame([(*r, "c", "e") for r in rows], SCHEMA).repartition(3)
    return sorted([tuple(r) for r in V.op13_vector_codes(spark, table).collect()], key=str)


def vectors(n, width, seed=1, ids=None):
    rng = random.Random(seed)
    centres = [[rng.gauss(0, 0.2) for _ in range(width)] for _ in range(9)]
    return [(ids[i] if ids else i * 7 % n, [c + rng.gauss(0, 0.03) for c in rng.choice(centres)], rng.choice([0, 1, 2, None])) for i in range(n)]


@pytest.mark.parametrize("width", [8, 16, 24, 64])
def test_against_plain_integers(spark, width):
    rows = vectors(120, width)
    assert run(spark, rows) == by_hand(rows)


def test_odd_rows(spark):
    rows = vectors(60, 16, seed=4)
    rows += [rows[3], rows[3], (rows[5][0], rows[6][1], None), (None, rows[7][1], 2), (None, rows[8][1], None)]
    odd = [(900, None, 1), (901, [None] + [0.1] * 15, 1), (902, [float("nan")] * 16, 1), (903, [float("inf")] + [0.0] * 15, None), (904, [float("-inf")] * 16, 3)]
    assert run(spark, rows + odd) == by_hand(rows)
    # What cannot be cut into the same parts is dropped like a null vector.
    assert run(spark, [*rows, (-5, [0.5] * 15, 1), (-6, [], 1), (-7, [0.5] * 24, 1)]) == by_hand(rows)


def test_ties_and_equal_vectors(spark):
    rows = [(i, [0.25] * 8, 1) for i in range(40)] + [(100 + i, [0.25 + (i % 2) / 4096] * 8, None) for i in range(9)]
    got = run(spark, rows)
    assert got == by_hand(rows) and all(code == "00" * 8 for i, code, *_ in got if i < 40)


def test_few_rows(spark):
    rows = vectors(5, 16, seed=9)
    assert run(spark, rows) == by_hand(rows)


def test_large_components_are_exact(spark):
    rows = [(i, [float(np.float32(x * 10.0 ** (i % 12))) for x in v], l) for i, v, l in vectors(50, 16, seed=2)]
    assert run(spark, rows) == by_hand(rows)
    huge = [(i, [float(np.float32(x * 1e25)) for x in v], l) for i, v, l in vectors(30, 8, seed=3)]
    assert run(spark, huge) == by_hand(huge)


@pytest.mark.parametrize("width", [1, 2, 3, 6, 8, 12])
@pytest.mark.parametrize("dtype", [np.int64, object])
def test_nearest_is_exact_and_drops_entries(width, dtype):
    rng = np.random.default_rng(width)
    entries = rng.integers(-3000, 3000, (16, width)).astype(dtype)
    entries[5] = entries[2]
    x = np.concatenate([entries[rng.integers(0, 16, 300)] + rng.integers(-40, 40, (300, width)), rng.integers(-5000, 5000, (100, width))]).astype(dtype)
    at, distance, looked = V.nearest(x, entries)
    full = ((x[:, None, :] - entries[None, :, :]) ** 2).sum(axis=2)
    assert (distance == full.min(axis=1)).all() and (at == np.array([list(r).index(min(r)) for r in full])).all()
    assert looked <= len(x) * 16
    if width >= 6:
        assert looked < len(x) * 6


def test_labels_beyond_the_broadcast(spark):
    rows = vectors(40, 8, seed=6)
    coded = spark.createDataFrame([(i, i * 3, label) for i, (_, _, label) in enumerate(rows)], "vec_id long, error long, label int")
    want = {tuple(r) for r in V.with_label_errors(coded, "label").collect()}
    assert {tuple(r) for r in V.with_label_errors(coded, "label", broadcast_rows=0).collect()} == want and len(want) == 40


def test_sql(spark):
    rows = [*vectors(60, 16, seed=8), (77, None, 1), (78, [float("nan")] * 16, 1)]
    con = duckdb.connect()
    con.sql("CREATE TABLE embeddings (vec_id BIGINT, embedding FLOAT[], label INTEGER)")
    con.executemany("INSERT INTO embeddings VALUES (?, ?, ?)", [list(r) for r in rows])
    assert sorted([tuple(r) for r in con.sql(V.ORACLE).fetchall()], key=str) == by_hand(rows[:60])


def test_empty_tables(spark):
    assert run(spark, [(1, None, 2)]) == []
    assert V.op13_vector_codes(spark, spark.createDataFrame([], SCHEMA)).columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
