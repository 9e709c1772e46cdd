"""Benchmark decontamination by spaced-seed hashing.

Texts are lower-cased and cut into words at all but letters and digits. A mask picks some positions of a span of words and ignores the others; the hash of the picked words is a
seed. Every seed of every document is looked up among the seeds of the benchmark, so a substituted word spoils only the seeds that pick it. Around each hit
the document is laid over the item, without gaps, and words that agree are marked on the item; marks of several hits add up, so a passage with a word put in or
left out counts too. A document is contaminated by an item when ``least_share`` of the item's words are marked; ``least_words``, where it is given, also takes so many words of a long item.

Scale: the documents are read once. A benchmark of at most ``block_chars`` characters is indexed and broadcast, and nothing is shuffled. A larger one is never held as a whole: its seeds are
a table; documents are scanned with a bitmap of these seeds (16 MB, whatever the benchmark's size), and those with a hit are joined with the seeds by hash, which says in which blocks
of the benchmark to look. Blocks meet their documents in groups of bounded size, so that neither a popular block nor a passage in a third of all documents makes a large task. Both ways find the same.

Defined cases: null and empty texts and items match nothing; items shorter than the shortest mask match only where the whole item occurs word for word; repeated rows
are each reported; copies of an item are reported under each item id; empty tables give empty results. Ids must be numbers. Extra columns are kept by ``contaminated`` (one that has the name of its output is replaced), and not
looked at by ``overlaps``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, free_name, released, scratch, stored, text_key
from .wordhash import U, each_text, mix

#: Positions looked at in a span of words; each ignores other places.
MASKS = ((0, 1, 2, 3, 4), (0, 1, 3, 5, 6), (0, 2, 3, 6, 7), (0, 1, 4, 7, 9))
#: ASCII bytes that end a word: all but digits and letters. Bytes of longer characters belong to words.
BREAKS = bytes(x for x in range(128) if not chr(x).isalnum())
#: Bits of the filters of an index and of a benchmark in blocks.
BITMAP, FILTER = 22, 27
#: Words compared at a time.
AT_ONCE = 1 << 20


def seeds(hashes: np.ndarray, mask: tuple[int, ...]) -> np.ndarray:
    n = len(hashes) - mask[-1]
    if n <= 0:
        return np.zeros(0, U)
    x = np.full(n, U(len(mask) * 1000 + sum(mask)))
    for at in mask:
        x = mix(x * U(0x9E3779B97F4A7C15) + hashes[at : at + n])
    return x


def item_masks(n: int) -> list[tuple[int, ...]]:
    """The masks of an item of n words: the whole item where it is shorter than a span."""
    return [tuple(range(n))] if n <= MASKS[0][-1] else list(MASKS)


def _spread(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(owner, number within its owner) of so many entries for each owner."""
    owner = np.repeat(np.arange(len(counts)), counts)
    return owner, np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)


class Index:
    """Items with their seeds: for each mask sorted hashes with the item and place of each, and a bitmap before them."""

    def __init__(self, ids: list[int], items: list[np.ndarray]):
        self.ids, self.sizes = ids, np.array([len(h) for h in items], np.int64)
        self.begins = np.cumsum(self.sizes) - self.sizes
        self.flat = np.concatenate([*items, np.zeros(0, U)])
        found: dict[tuple[int, ...], list[tuple[np.ndarray, int]]] = {}
        for k, h in enumerate(items):
            for mask in item_masks(len(h)) if len(h) else []:
                found.setdefault(mask, []).append((seeds(h, mask), k))
        self.tables = {mask: self._table(x) for mask, x in found.items()}

    @staticmethod
    def of_texts(items: list[tuple[int, str | None]]) -> Index:
        lowered = pc.utf8_lower(pa.array([t for _, t in items], pa.string()))
        return Index([i for i, _ in items], [h.copy() for *_, h in each_text(lowered, BREAKS)])

    @staticmethod
    def _table(found: list[tuple[np.ndarray, int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        h = np.concatenate([s for s, _ in found])
        item = np.concatenate([np.full(len(s), k, np.int64) for s, k in found])
        place = np.concatenate([np.arange(len(s)) for s, _ in found])
        order = np.argsort(h, kind="stable")
        bits = np.zeros(1 << BITMAP, bool)
        bits[(h >> U(64 - BITMAP)).astype(np.int64)] = True
        return h[order], item[order], place[order], bits

    def _lines(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(item, word of the document that the item's first word lies on) of all hits, each once, in this order."""
        items, starts = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for mask, (keys, item, place, bits) in self.tables.items():
            h = seeds(hashes, mask)
            maybe = np.flatnonzero(bits[(h >> U(64 - BITMAP)).astype(np.int64)])
            if not len(maybe):
                continue
            low, high = np.searchsorted(keys, h[maybe], "left"), np.searchsorted(keys, h[maybe], "right")
            owner, number = _spread(high - low)
            at = low[owner] + number
            items.append(item[at])
            starts.append(maybe[owner] - place[at])
        k, s = np.concatenate(items), np.concatenate(starts)
        order = np.lexsort((s, k))
        k, s = k[order], s[order]
        new = np.ones(len(k), bool)
        new[1:] = (k[1:] != k[:-1]) | (s[1:] != s[:-1])
        return k[new], s[new]

    def overlaps(self, hashes: np.ndarray, least_share: float, least_words: int | None = None) -> list[tuple[int, int, int, int]]:
        """(item id, marked words, item words, first word in the document) of each item that the words hold enough of."""
        k, s = self._lines(hashes)
        if not len(k):
            return []
        n = self.sizes[k]
        # Starts that differ by fewer words than the item has can be one passage with words put in or left out.
        opens = np.ones(len(k), bool)
        opens[1:] = (k[1:] != k[:-1]) | (s[1:] - s[:-1] > np.maximum(4, n[1:] // 4))
        group = np.cumsum(opens) - 1
        a, b = np.maximum(0, -s), np.minimum(n, len(hashes) - s)
        longest, marks = int(n.max()), []
        cuts = np.searchsorted(np.cumsum(b - a), np.arange(AT_ONCE, int((b - a).sum()) + AT_ONCE, AT_ONCE))
        for low, high in zip([0, *(cuts[:-1] + 1)], cuts + 1, strict=True):
            part = slice(low, min(high, len(k)))
            owner, number = _spread((b - a)[part])
            owner += low
            place = a[owner] + number
            same = self.flat[self.begins[k[owner]] + place] == hashes[s[owner] + place]
            # On its line a stretch counts where most of the words around agree; single words that agree by chance do not.
            size = (b - a)[owner]
            upto = np.concatenate([[0], np.cumsum(same)])
            begin = np.arange(len(owner)) - number
            short = size <= 5
            left = np.where(short, begin, np.maximum(begin, begin + number - 2))
            right = np.where(short, begin + size, np.minimum(begin + size, begin + number + 3))
            around = upto[right] - upto[left]
            good = same & np.where(short, 2 * around > size, around >= 3)
            marks.append(np.unique(group[owner[good]] * longest + place[good]))
        marked = np.bincount(np.unique(np.concatenate(marks)) // longest, minlength=int(group[-1]) + 1)
        heads = np.flatnonzero(opens)
        out: dict[int, tuple[int, int]] = {}
        for item, words, first in zip(k[heads].tolist(), marked.tolist(), s[heads].tolist(), strict=True):
            if item not in out or words > out[item][0]:
                out[item] = words, first
        least = {item: least_share * int(self.sizes[item]) for item in out}
        if least_words is not None:
            least = {item: min(x, least_words) for item, x in least.items()}
        return [(self.ids[i], words, int(self.sizes[i]), max(0, first)) for i, (words, first) in out.items() if words >= least[i]]


FOUND = "doc_id long, item_id long, matched long, item_words long, share double, first_word long"
_FOUND = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.int64()]


def _found(rows: list[tuple], id_type: pa.DataType = _FOUND[0]) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [()] * len(_FOUND)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [id_type, *_FOUND[1:]], strict=True)], names=[f.split()[0] for f in FOUND.split(", ")])


def _items(benchmark: DataFrame) -> tuple[DataFrame, int]:
    """(items with a text, their characters)."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").where("text is not null")
    return items, items.agg(F.sum(F.length("text")).alias("n")).first()["n"] or 0


def _small_index(items: DataFrame):
    """Broadcast index of items that are known to be few."""
    rows = sorted(((r[0], r[1]) for r in items.collect()), key=lambda x: (x[0] is None, x))
    return items.sparkSession.sparkContext.broadcast(Index.of_texts(rows))


def overlaps(docs: DataFrame, benchmark: DataFrame, least_share: float = 0.5, least_words: int | None = None, block_chars: int = 8_000_000) -> DataFrame:
    """doc_id, item_id, matched, item_words, share, first_word: one row for each document and item that it holds."""
    items, chars = _items(benchmark)
    bounded_batches(docs.sparkSession)
    light = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    if chars > block_chars:
        return _overlaps_in_blocks(light, items, least_share, least_words, -(-chars // block_chars))
    index = _small_index(items)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, ids = [], batch.column(0)
            for i, _, _, _, hashes in each_text(pc.utf8_lower(batch.column(1)), BREAKS):
                rows += [(ids[i].as_py(), item, words, n, words / n, at) for item, words, n, at in index.value.overlaps(hashes, least_share, least_words)]
            yield _found(rows)

    return light.mapInArrow(released(run), FOUND)


def _overlaps_in_blocks(docs: DataFrame, items: DataFrame, least_share: float, least_words: int | None, blocks: int, group_bytes: int = 64_000_000) -> DataFrame:
    """The same for a benchmark of any size. docs: doc_id (long, or a text key), text."""
    spark = docs.sparkSession
    id_kind = docs.schema["doc_id"].dataType.simpleString()
    by_text = id_kind == "string"

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes = [h.tobytes() for *_, h in each_text(pc.utf8_lower(batch.column("text")), BREAKS)]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("block"), pa.array(hashes, pa.binary())], names=["id", "block", "words"])

    def seeded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [np.frombuffer(w, U) for w in batch.column("words").to_pylist()]
            rows = [np.concatenate([seeds(h, m) for m in item_masks(len(h))]) if len(h) else h for h in found]
            owner, _ = _spread(np.array([len(r) for r in rows], np.int64))
            flat = np.concatenate([*rows, np.zeros(0, U)]).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(flat), batch.column("block").take(pa.array(owner))], names=["seed", "block"])

    with scratch(spark) as keep:
        placed = items.select(F.col("item_id").alias("id"), "text", F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)).cast("long").alias("block"))
        known = keep(placed.mapInArrow(released(hashed), "id long, block long, words binary"), "leak-items")
        sown = stored(known.select("block", "words").mapInArrow(released(seeded), "seed long, block long").distinct(), "leak-seeds")
        short = [r[0] for r in known.select((F.octet_length("words") / 8).cast("int").alias("n")).where(f"n between 1 and {MASKS[0][-1]}").distinct().collect()]
        # The filter: a bit for each value of the first bits of a seed, 4 KB a row.
        bit = F.shiftrightunsigned("seed", 64 - FILTER) + 1
        maps = sown.groupBy(F.bitmap_bucket_number(bit).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(bit)).alias("bits")).collect()
        bits = np.zeros((1 << FILTER) // 8, np.uint8)
        for r in maps:
            bits[(r["bucket"] - 1) * 4096 : r["bucket"] * 4096] = np.frombuffer(r["bits"], np.uint8)
        may = spark.sparkContext.broadcast(bits)
        masks = [*MASKS, *(tuple(range(n)) for n in sorted(short))]

        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            filter_ = may.value
            for batch in batches:
                rows, words, hits = [], [], []
                for i, _, _, _, hashes in each_text(pc.utf8_lower(batch.column("text")), BREAKS):
                    h = np.concatenate([seeds(hashes, m) for m in masks])
                    first = h >> U(64 - FILTER)
                    h = np.unique(h[filter_[first >> U(3)] >> (first & U(7)).astype(np.uint8) & 1 > 0])
                    if len(h):
                        rows.append(i)
                        words.append(hashes.tobytes())
                        hits.append(h.view(np.int64))
                at = pa.array(rows, pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [batch.column("row").take(at), batch.column("doc_id").take(at), pa.array(words, pa.binary()), pa.array(hits, pa.list_(pa.int64()))], names=["row", "doc_id", "words", "hits"]
                )

        numbered = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text")
        hit = keep(numbered.mapInArrow(released(scan), f"row long, doc_id {id_kind}, words binary, hits array<long>"), "leak-hits")
        pairs = stored(hit.select("row", F.octet_length("words").alias("bytes"), F.explode("hits").alias("seed")).join(sown, "seed").select("row", "bytes", "block").distinct(), "leak-pairs")
        groups = pairs.groupBy("block").agg(F.ceil(F.sum("bytes") / F.lit(group_bytes)).cast("long").alias("groups"))
        groups = keep(groups, "leak-groups")
        dealt = keep(pairs.join(groups, "block").select("row", "block", F.pmod(F.xxhash64("row"), F.col("groups")).alias("part")), "leak-dealt")
    sides = known.join(groups, "block").select("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("groups") - 1)).alias("part"), F.lit(0).alias("side"), F.col("id").cast("string").alias("id"), "words")
    sides = sides.unionByName(hit.select("row", F.col("doc_id").cast("string").alias("id"), "words").join(dealt, "row").select("block", "part", F.lit(1).alias("side"), "id", "words"))

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple | None = None
        ids: list = []
        items: list[np.ndarray] = []
        index = None
        for batch in batches:
            rows = []
            for block, part, side, i, words in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if held != (block, part):
                    held, ids, items, index = (block, part), [], [], None
                if i is not None and not (side and by_text):
                    i = int(i)
                if not side:
                    ids.append(i)
                    items.append(np.frombuffer(words, U))
                    continue
                index = index or Index(ids, items)
                rows += [(i, item, n_words, n, n_words / n, at) for item, n_words, n, at in index.overlaps(np.frombuffer(words, U), least_share, least_words)]
            yield _found(rows, pa.string() if by_text else pa.int64())

    return sides.repartition("block", "part").sortWithinPartitions("block", "part", "side").mapInArrow(released(look), FOUND.replace("doc_id long", f"doc_id {id_kind}"))


def contaminated(
    docs: DataFrame, benchmark: DataFrame, least_share: float = 0.5, least_words: int | None = None, block_chars: int = 8_000_000, out: str = "contaminated"
) -> DataFrame:
    """docs with a boolean column."""
    bounded_batches(docs.sparkSession)
    items, chars = _items(benchmark)
    if chars > block_chars:
        # What a text holds does not depend on its row: texts are looked up by their hash.
        key = free_name(docs.columns, "_text_key")
        keyed = docs.select(text_key().alias("doc_id"), "text")
        held = _overlaps_in_blocks(keyed, items, least_share, least_words, -(-chars // block_chars)).select(F.col("doc_id").alias(key)).distinct()
        marked = docs.drop(out).join(held.withColumn(out, F.lit(True)), text_key() == F.col(key), "left").drop(key)
        return marked.withColumn(out, F.coalesce(out, F.lit(False)))
    index = _small_index(items)

    @F.arrow_udf("boolean")
    def holds(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array([bool(index.value.overlaps(h, least_share, least_words)) for *_, h in each_text(pc.utf8_lower(batch), BREAKS)], pa.bool_())

    return docs.withColumn(out, holds(F.col("text")))


def op9_decontamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    return overlaps(docs, benchmark)
