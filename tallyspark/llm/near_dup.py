"""Near-duplicate components by a chosen-path set similarity join (Christiani & Pagh; Christiani, Pagh & Sivertsen 2018).

A document is the set of its k-word shingles. Documents with equal sets are one class from the start, so copies cost nothing later. Each class gets 128
minwise values. A tree sends a class down a path: at a node, the path so far picks which coordinates to branch on, and the class goes on to the children
named by its values there, so that similar classes share paths. With branching (1, 1, 2) a pair at similarity 0.8 shares a leaf of one tree with probability
0.8*0.8*(1-0.2**2) = 0.61; 16 independent trees miss it with probability 2.7e-7.

Leaves of at most ``node_limit`` classes are compared exhaustively on the minwise values (an estimate of at least threshold - 0.14, four standard
errors, passes) and give a spanning forest, never all pairs. Larger leaves branch on; what stays large at the last level is linked
as a star, since classes that agree on that many minwise values belong together anyway. The forest's components are the clusters within which sets are confirmed: every
class of a cluster is reached from its similar classes by breadth-first search on full sets, which compares each reached class with all unreached ones, so the
result is exact within the cluster. Clusters beyond ``block_shingles`` are compared in pairs of blocks of bounded size instead.

Defined cases: null, empty and blank texts have no set, are linked with nothing and are their own component; texts with fewer than k words are one shingle;
repeated rows are equal sets; null ids never win a minimum (a row without an id is kept only where no row of its component has one); ids must be
numbers; empty tables give empty results. Extra columns are not touched. ``keep_one`` decides by row, not by id: rows of one id and different texts are decided each for itself, and
of rows with equal id and text in a component one stays.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, free_name, released, scratch, stored, text_key
from .components import components
from .wordhash import U, each_text, mix, shingles

COORDS = 128
BRANCHING = (1, 1, 2)
DEEPER = (2, 2)


def _multipliers() -> np.ndarray:
    return mix(np.arange(1, COORDS + 1, dtype=U) * U(0x9E3779B97F4A7C15)) | U(1)


def minwise(values: np.ndarray) -> np.ndarray:
    """128 minwise values of a set of hashes, 16 bits each."""
    m, best = _multipliers(), np.full(COORDS, U(0xFFFFFFFFFFFFFFFF))
    for i in range(0, len(values), 2048):
        np.minimum(best, (values[i : i + 2048, None] * m[None, :]).min(axis=0), out=best)
    return (mix(best) >> U(48)).astype("<u2")


def set_id(values: np.ndarray) -> bytes:
    return hashlib.blake2b(values.astype("<u8").tobytes(), digest_size=16).digest()


def with_sets(docs: DataFrame, k: int) -> DataFrame:
    """doc_id, text_key, n_shingles, sid (null without words), sig: one row a document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, sids, sigs = [], [], []
            for _, _, _, _, hashes in each_text(batch.column(2)):
                values = shingles(hashes, k)
                n.append(len(values))
                sids.append(set_id(values) if len(values) else None)
                sigs.append(minwise(values).tobytes() if len(values) else None)
            made = [pa.array(n, pa.int64()), pa.array(sids, pa.binary()), pa.array(sigs, pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *made], names=["doc_id", "text_key", "n_shingles", "sid", "sig"])

    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_key().alias("text_key"), "text")
    return keyed.mapInArrow(released(run), "doc_id long, text_key string, n_shingles long, sid binary, sig binary")


def _branch(sigs: np.ndarray, paths: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Paths one level down: (rows, new paths). The path picks the coordinates by hashing, the class's values there name the children."""
    rows = np.arange(len(paths))
    out_rows, out_paths = [], []
    for b in range(width):
        coord = (mix(paths + U(0x51ED270B * (2 * b + 1))) % U(COORDS // width)).astype(np.int64) + b * (COORDS // width)
        out_rows.append(rows)
        out_paths.append(mix(mix(paths + U(b + 1)) + (coord.astype(U) << U(16)) + sigs[rows, coord].astype(U)))
    return np.concatenate(out_rows), np.concatenate(out_paths)


def _paths(classes: DataFrame, trees: int, levels: tuple[int, ...], start: str | None = None) -> DataFrame:
    """(key, sid): the nodes each class reaches, from the roots of all trees or from the node named in column start."""
    schema = pa.schema([("key", pa.int64()), ("sid", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 2048):
                batch = whole.slice(at, 2048)
                sigs = np.frombuffer(b"".join(batch.column("sig").to_pylist()), "<u2").reshape(-1, COORDS)
                if not len(sigs):
                    continue
                if start:
                    paths, rows = batch.column(start).to_numpy().astype(np.int64).view(U), np.arange(len(sigs))
                else:
                    paths = np.repeat(mix(np.arange(1, trees + 1, dtype=U)), len(sigs))
                    rows = np.tile(np.arange(len(sigs)), trees)
                for width in levels:
                    picked, paths = _branch(sigs[rows], paths, width)
                    rows = rows[picked]
                yield pa.RecordBatch.from_arrays([pa.array(paths.view(np.int64)), batch.column("sid").take(pa.array(rows))], schema=schema)

    wanted = ["sid", "sig"] + ([start] if start else [])
    return classes.select(*wanted).mapInArrow(released(run), "key long, sid binary")


def _runs(batches: Iterator[pa.RecordBatch], key_columns: list[str]) -> Iterator[pa.Table]:
    """Whole groups from batches sorted by the key columns."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = list(zip(*[batch.column(c).to_pylist() for c in key_columns], strict=True))
        begin = 0
        for i in range(len(keys)):
            if keys[i] != last:
                if i > begin:
                    held.append(batch.slice(begin, i - begin))
                if held:
                    yield pa.Table.from_batches(held)
                held, begin, last = [], i, keys[i]
        held.append(batch.slice(begin))
    if held:
        yield pa.Table.from_batches(held)


def _sketch_forest(least_equal: int):
    schema = pa.schema([("u", pa.binary()), ("v", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        us, vs = [], []
        for group in _runs(batches, ["key"]):
            sids = group.column("sid").to_pylist()
            sigs = np.frombuffer(b"".join(group.column("sig").to_pylist()), "<u2").reshape(-1, COORDS)
            left = np.arange(len(sids))
            while len(left) > 1:
                reached, left = [left[0]], left[1:]
                while reached and len(left):
                    x = reached.pop()
                    near = np.concatenate([(sigs[left[i : i + 8192]] == sigs[x]).sum(axis=1) for i in range(0, len(left), 8192)]) >= least_equal
                    for y in left[near]:
                        us.append(sids[x])
                        vs.append(sids[y])
                        reached.append(y)
                    left = left[~near]
            if len(us) > 50_000:
                yield pa.RecordBatch.from_arrays([pa.array(us, pa.binary()), pa.array(vs, pa.binary())], schema=schema)
                us, vs = [], []
        yield pa.RecordBatch.from_arrays([pa.array(us, pa.binary()), pa.array(vs, pa.binary())], schema=schema)

    return run


def candidate_edges(classes: DataFrame, threshold: float, trees: int, node_limit: int, deeper_rounds: int = 2) -> DataFrame:
    """Edges (u, v) between classes whose components cover every pair at the threshold that shares a node."""
    paths, parts = stored(_paths(classes, trees, BRANCHING), "paths"), []
    sigs = classes.select("sid", "sig")
    for rounds in range(deeper_rounds + 1):
        sizes = stored(paths.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "nodes")
        rows = paths.join(sizes, "key")
        small = rows.where(F.col("n") <= node_limit).select("key", "sid").join(sigs, "sid")
        small = small.select("key", "sid", "sig").repartition("key").sortWithinPartitions("key", "sid")
        parts.append(small.mapInArrow(released(_sketch_forest(int((threshold - 0.14) * COORDS))), "u binary, v binary").distinct())
        large = rows.where(F.col("n") > node_limit).select("key", "sid")
        if sizes.where(F.col("n") > node_limit).limit(1).count() == 0:
            break
        if rounds == deeper_rounds:
            hubs = large.groupBy("key").agg(F.min("sid").alias("v"))
            parts.append(large.join(hubs, "key").select(F.col("sid").alias("u"), "v").where("u <> v").distinct())
        else:
            paths = stored(_paths(large.join(sigs, "sid"), trees, DEEPER, start="key").distinct(), "paths")
    edges = parts[0]
    for part in parts[1:]:
        edges = edges.unionByName(part)
    return edges


def _confirm(k: int, percent: int):
    """Within a group (one cluster, or two blocks of one), the spanning forest of confirmed links by breadth-first search on full sets."""
    schema = pa.schema([("u", pa.binary()), ("v", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _runs(batches, ["root", "part"]):
            sids, us, vs = group.column("sid").to_pylist(), [], []
            sets = [np.frombuffer(x, "<u8") for x in group.column("shingles").to_pylist()]
            sizes = np.array([len(x) for x in sets])
            flat = np.concatenate(sets)
            values, ids = np.unique(flat, return_inverse=True)
            begins = np.concatenate([[0], np.cumsum(sizes)])
            mark = np.zeros(len(values), bool)
            left = np.argsort(-sizes, kind="stable")
            while len(left) > 1:
                reached, left = [left[0]], left[1:]
                while reached and len(left):
                    x = reached.pop()
                    mark[ids[begins[x] : begins[x + 1]]] = True
                    # Only sets of a size that can reach the threshold are looked at.
                    fit = left[(100 * np.minimum(sizes[left], sizes[x]) >= percent * np.maximum(sizes[left], sizes[x]))]
                    both = np.array([np.count_nonzero(mark[ids[begins[y] : begins[y + 1]]]) for y in fit], dtype=np.int64)
                    near = fit[100 * both >= percent * (sizes[fit] + sizes[x] - both)] if len(fit) else fit
                    mark[ids[begins[x] : begins[x + 1]]] = False
                    if len(near):
                        us += [sids[x]] * len(near)
                        vs += [sids[y] for y in near]
                        reached += near.tolist()
                        left = left[~np.isin(left, near)]
            yield pa.RecordBatch.from_arrays([pa.array(us, pa.binary()), pa.array(vs, pa.binary())], schema=schema)

    return run


def confirmed_edges(docs: DataFrame, sets: DataFrame, clusters: DataFrame, k: int, percent: int, block_shingles: int, broadcast_rows: int = 1_000_000) -> DataFrame:
    """Edges (u, v) that span the components of confirmed links. clusters: sid, root; sets: sid, n_shingles and the doc_id and text_key of one row, one row a class."""
    members = stored(sets.join(clusters, "sid").select("sid", "root", "n_shingles", "doc_id", "text_key"), "members")
    weights = members.groupBy("root").agg(F.ceil(F.sum("n_shingles") / F.lit(block_shingles)).cast("int").alias("blocks"))
    # One row of each class; where that very row repeats, its copies go before shingles are made.
    chosen = members.select(F.col("doc_id").alias("_doc"), F.col("text_key").alias("_text"))
    if members.count() <= broadcast_rows:
        chosen = F.broadcast(chosen)
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_key().alias("text_key"), "text")
    keyed = keyed.join(chosen, (F.col("text_key") == F.col("_text")) & F.col("doc_id").eqNullSafe(F.col("_doc")), "left_semi")
    wanted = keyed.groupBy("text_key").agg(F.first("text").alias("text"))

    def sets_batch(sids: list[bytes], sets: list[bytes]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(sids, pa.binary()), pa.array(sets, pa.binary())], names=["sid", "shingles"])

    members = members.join(weights, "root").withColumn("block", F.pmod(F.xxhash64("sid"), F.col("blocks")).cast("int"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sids, sets, size = [], [], 0
            for _, _, _, _, hashes in each_text(batch.column(0)):
                found = shingles(hashes, k)
                if len(found):
                    sids.append(set_id(found))
                    sets.append(found.astype("<u8").tobytes())
                    size += len(sets[-1])
                # A set takes more room than its text: batches are cut by bytes.
                if size > 4 << 20:
                    yield sets_batch(sids, sets)
                    sids, sets, size = [], [], 0
            yield sets_batch(sids, sets)

    full = wanted.select("text").mapInArrow(released(run), "sid binary, shingles binary")
    # One block a cluster as a rule; else block i meets each block j >= i (and itself) in a group of its own.
    low, high = F.least(F.col("block"), F.col("other")), F.greatest(F.col("block"), F.col("other"))
    placed = members.select("sid", "root", "block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")).select("sid", "root", F.concat_ws("-", low, high).alias("part"))
    grouped = placed.join(full, "sid").repartition("root", "part").sortWithinPartitions("root", "part", "sid")
    return grouped.select("root", "part", "sid", "shingles").mapInArrow(released(_confirm(k, percent)), "u binary, v binary")


def _found(docs: DataFrame, k: int, percent: int, trees: int, node_limit: int, block_shingles: int) -> tuple[DataFrame, DataFrame]:
    """(sets: doc_id, text_key, n_shingles, sid of each row; named: _sid, component_id and root, the least class of the component), both stored."""
    bounded_batches(docs.sparkSession)
    with scratch(docs.sparkSession) as keep:
        sets = keep(with_sets(docs, k), "sets")
        first = F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col("text_key"))
        one = F.min_by(F.struct("doc_id", "text_key", "n_shingles", "sig"), first).alias("one")
        classes = sets.where("sid is not null").groupBy("sid").agg(one).select("sid", "one.*")
        classes = stored(classes, "classes")
        clusters = components(candidate_edges(classes, percent / 100, trees, node_limit)).withColumnsRenamed({"id": "sid"})
        links = components(confirmed_edges(docs, classes.drop("sig"), clusters, k, percent, block_shingles))
        links = links.join(classes.select(F.col("sid").alias("id"), "doc_id"), "id")
        least = links.groupBy("root").agg(F.min("doc_id").alias("component_id"))
        found = links.join(least, "root").select(F.col("id").alias("sid"), "root", "component_id")
        alone = classes.select("sid", F.col("doc_id").alias("class_id")).join(found, "sid", "left")
        named = alone.select(F.col("sid").alias("_sid"), F.coalesce("root", "sid").alias("root"), F.coalesce("component_id", "class_id").alias("component_id"))
        return sets, keep(named, "named")


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80, trees: int = 16, node_limit: int = 4096, block_shingles: int = 2_000_000) -> DataFrame:
    """doc_id, n_shingles, component_id: the least doc_id reachable over links with Jaccard similarity of at least percent / 100."""
    sets, named = _found(docs, k, percent, trees, node_limit, block_shingles)
    return sets.join(named, F.col("sid") == F.col("_sid"), "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


def keep_one(docs: DataFrame, k: int = 5, percent: int = 80, trees: int = 16, node_limit: int = 4096, block_shingles: int = 2_000_000) -> DataFrame:
    """One row of each component of docs: that of least id (null last), then of least text key; rows without words all stay."""
    sets, named = _found(docs, k, percent, trees, node_limit, block_shingles)
    row = F.struct(F.col("doc_id").isNull().alias("no_id"), F.col("doc_id"), F.col("text_key"))
    # Rows of equal id and text are counted before components are, so neither is one task's work.
    rows = sets.where("sid is not null").groupBy("sid", "doc_id", "text_key").agg(F.count(F.lit(1)).alias("rows"))
    chosen = rows.join(named, F.col("sid") == F.col("_sid")).groupBy("root").agg(F.min_by(F.struct("doc_id", "text_key", "rows"), row).alias("one"))
    wordless = sets.where("sid is null").select("doc_id", "text_key", F.lit(1).cast("long").alias("rows")).distinct()
    chosen = stored(chosen.select("one.*").unionByName(wordless), "kept-rows")

    names = {c: free_name(docs.columns, c) for c in ("_doc", "_text", "_rows")}
    keys = chosen.select(F.col("doc_id").alias(names["_doc"]), F.col("text_key").alias(names["_text"]), F.col("rows").alias(names["_rows"]))
    same = (text_key() == F.col(names["_text"])) & F.col("doc_id").cast("long").eqNullSafe(F.col(names["_doc"]))
    once = docs.join(keys.where(F.col(names["_rows"]) == 1), same, "left_semi")
    repeated = keys.where(F.col(names["_rows"]) > 1)
    if not repeated.limit(1).count():
        return once
    # Of rows that repeat one: equal in what decides, so the least of their other columns, as far as these have an order.
    ordered = [f.name for f in docs.schema if f.dataType.typeName() not in ("map", "variant")]
    more = docs.join(repeated, same, "left_semi")
    one = F.min_by(F.struct(*docs.columns), F.struct(*ordered)).alias("_one")
    return once.unionByName(more.groupBy(text_key().alias("_k"), F.col("doc_id").alias("_d")).agg(one).select("_one.*"))


def op10_near_dup(docs: DataFrame) -> DataFrame:
    return near_duplicates(docs, k=2).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
