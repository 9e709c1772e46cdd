"""Packing pieces of token sequences into as few training sequences as possible, by exact complements.

Only the length of a piece matters for where it goes, so the plan is made for the counts of lengths: at most ``limit`` numbers, whatever the corpus' size. Sums of one, two and
three lengths are indexed by their total, by hashing on it. From the longest length down, each opens sequences whose gap is looked up: a single length, a pair or a triple that
fills it exactly is consumed as often as the counts allow, all at once. Counts only fall, so a total that has no combination never gets one, and what the index
holds is looked for again only once it has been used up. What is left is packed by best fit: the gap of the open sequence takes an exact combination where there is
one, else the length that leaves the least room, until nothing fits.

The plan is a list of patterns (lengths, how many sequences). Pieces then find their place from their rank among the pieces of their length: ranks come from the counts of
each part of the table, so no length, however common, is numbered in one task.

``token_pieces`` encodes word by word: the tokenizer cuts at white space before anything else, so the ids of a text are those of its words, and words repeat. A word
of plain letters, digits and marks is cut by the tokenizer's own pattern and goes to its model; all others go through the whole tokenizer. Words are kept
up to a bound. Tests hold the ids against the library's on whole texts.

Defined cases: null and empty texts are the end id alone; very long texts are read in stretches of about a megabyte that end at white space; repeated rows are pieces
of their own, and interchangeable; null ids stay; empty tables give empty results; other columns are not looked at.
"""

from __future__ import annotations

import json
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded_batches, released, stored
from .wordhash import text_bytes

Pattern = tuple[int, tuple[int, ...]]

PIECES = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])
#: Characters that neither normalisation nor a library's Unicode version treats in a special way: printable ASCII, Latin-1 and Latin Extended-A letters without the dotted I.
PLAIN = re.compile(r"[!-~À-ÖØ-öø-įı-ſ]+")
#: The cuts of the tokenizer's own pattern, for such words in lower case.
CUTS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zÀ-ÖØ-öø-ſ]+|[0-9]|[^a-z0-9À-ÖØ-öø-ſ]+")
BLANK = re.compile(rb"[\x20\x09-\x0d]")
#: The normaliser and the pre-tokeniser for which texts may be encoded word by word. With any other, whole texts go through the library.
FORM = (
    {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
    {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
)
#: Words and parts of words that a worker keeps.
KEPT = 400_000


@lru_cache(maxsize=1)
def _byte_letters() -> dict[int, str]:
    """Byte-level vocabularies write printable bytes as themselves and give the others the code points from 256 on, in order."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in printable]
    return {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(others)}


class _Words(dict):
    """Word (UTF-8) -> its ids as little-endian 32-bit numbers; made when first asked for."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        self.model, self.parts = self.tokenizer.model, {}
        # Added tokens are found in a text as it stands.
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        form = json.loads(self.tokenizer.to_str())
        self.known_form = (form["normalizer"], form["pre_tokenizer"]) == FORM

    def __missing__(self, word: bytes) -> bytes:
        text = word.decode("utf-8", "replace")
        if len(text) <= 64 and PLAIN.fullmatch(text) and not any(x in text for x in self.added):
            found = b"".join([self._part(x) for x in CUTS.findall(text.lower())])
        else:
            found = np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        if len(word) <= 64:
            if len(self) >= KEPT:
                self.clear()
            self[word] = found
        return found

    def _part(self, part: str) -> bytes:
        found = self.parts.get(part)
        if found is None:
            letters = part if part.isascii() else part.encode().decode("latin-1").translate(_byte_letters())
            found = np.array([t.id for t in self.model.tokenize(letters)], "<u4").tobytes()
            if len(self.parts) >= KEPT:
                self.parts.clear()
            self.parts[part] = found
        return found


@lru_cache(maxsize=1)
def _words(path: str) -> _Words:
    return _Words(path)


def ids(data: bytes, path: str, stretch: int = 1 << 20) -> Iterator[bytes]:
    """The token ids of a UTF-8 text, stretch by stretch, as little-endian 32-bit numbers."""
    known, begin = _words(path), 0
    if not known.known_form:
        yield np.array(known.tokenizer.encode(data.decode("utf-8", "replace"), add_special_tokens=False).ids, "<u4").tobytes()
        return
    while begin < len(data):
        found = BLANK.search(data, begin + stretch)
        end = found.start() if found else len(data)
        yield b"".join(map(known.__getitem__, data[begin:end].split()))
        begin = end


def token_pieces(docs: DataFrame, path: str, limit: int = 4096, end_id: int = 1) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32: the ids of each text and the end id, cut where they are more than limit."""
    bounded_batches(docs.sparkSession)
    width, end = 4 * limit, int(end_id).to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_bytes(batch.column(1))
            rows: list[tuple[int, int, int, int, int]] = []
            for i, (a, b) in enumerate(pairwise(offsets.tolist())):
                held, piece = bytearray(), 0
                for more in ids(data[a:b].tobytes(), path):
                    held += more
                    # At least one id must be left to end with.
                    while len(held) >= width:
                        rows.append((i, piece, piece * limit, limit, zlib.crc32(memoryview(held)[:width])))
                        held, piece = held[width:], piece + 1
                held += end
                rows.append((i, piece, piece * limit, len(held) // 4, zlib.crc32(held)))
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 5
            made = [batch.column(0).take(pa.array(columns[0], pa.int64()))]
            yield pa.RecordBatch.from_arrays([*made, *[pa.array(c, f.type) for c, f in zip(columns[1:], list(PIECES)[1:], strict=True)]], schema=PIECES)

    chosen = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return chosen.mapInArrow(released(run), "doc_id long, piece int, start long, length long, ids_crc32 long")


class _Sums:
    """Which lengths add up to a total: an index by total of single lengths, pairs and triples, under counts that only fall."""

    def __init__(self, counts: np.ndarray):
        self.counts = counts
        self.no_pair: set[int] = set()
        self.no_triple: set[int] = set()
        self.pairs: dict[int, tuple[int, int]] = {}
        self.triples: dict[int, tuple[int, int, int]] = {}

    def times(self, lengths: tuple[int, ...]) -> int:
        """How many sequences of these lengths the counts allow."""
        return min(int(self.counts[x]) // k for x, k in Counter(lengths).items())

    def _all_pairs(self, total: int, most: int) -> np.ndarray:
        """The larger lengths of pairs with this total, from most down."""
        low, high = -(-total // 2), min(total - 1, most)
        if low > high:
            return np.zeros(0, np.int64)
        larger = np.arange(high, low - 1, -1)
        return larger[(self.counts[larger] > 0) & (self.counts[total - larger] > 0)]

    def pair(self, total: int, beside: tuple[int, ...]) -> tuple[int, int] | None:
        known = self.pairs.get(total)
        if known and self.times((*beside, *known)):
            return known
        if total in self.no_pair:
            return None
        larger = self._all_pairs(total, total)
        if not len(larger):
            self.no_pair.add(total)
        for a in larger.tolist():
            if self.times((*beside, a, total - a)):
                self.pairs[total] = (a, total - a)
                return a, total - a
        return None

    def triple(self, total: int, beside: tuple[int, ...]) -> tuple[int, int, int] | None:
        known = self.triples.get(total)
        if known and self.times((*beside, *known)):
            return known
        if total in self.no_triple:
            return None
        largest = np.arange(total - 2, -(-total // 3) - 1, -1)
        any_pair = False
        for a in largest[self.counts[largest] > 0].tolist():
            if total - a in self.no_pair:
                continue
            for b in self._all_pairs(total - a, a).tolist():
                any_pair = True
                if self.times((*beside, a, b, total - a - b)):
                    self.triples[total] = (a, b, total - a - b)
                    return a, b, total - a - b
        if not any_pair:
            self.no_triple.add(total)
        return None

    def exact(self, gap: int, beside: tuple[int, ...]) -> tuple[int, ...] | None:
        """One to three lengths that fill the gap, and are still there beside what the sequence has."""
        if gap < 1:
            return () if gap == 0 else None
        if self.counts[gap] and self.times((*beside, gap)):
            return (gap,)
        return self.pair(gap, beside) or self.triple(gap, beside)

    def largest(self, gap: int, beside: tuple[int, ...]) -> int | None:
        """The length that leaves the least room in the gap."""
        for x in (np.flatnonzero(self.counts[1 : gap + 1])[::-1] + 1).tolist():
            if self.times((*beside, x)):
                return x
        return None

    def consume(self, lengths: tuple[int, ...]) -> Pattern:
        times = self.times(lengths)
        for x in lengths:
            self.counts[x] -= times
        return times, lengths


def plan(counts: np.ndarray, limit: int) -> list[Pattern]:
    """(how many sequences, lengths in order) such that every piece is used once. counts[n]: pieces of length n, n from 0 (unused) to limit."""
    sums, patterns = _Sums(counts.astype(np.int64).copy()), []
    for length in range(limit, 0, -1):
        while sums.counts[length]:
            rest = sums.exact(limit - length, (length,))
            if rest is None:
                break
            patterns.append(sums.consume((length, *rest)))
    for length in range(limit, 0, -1):
        while sums.counts[length]:
            made, gap = (length,), limit - length
            while gap:
                rest = sums.exact(gap, made)
                if rest is None:
                    best = sums.largest(gap, made)
                    if best is None:
                        break
                    rest = (best,)
                made, gap = (*made, *rest), gap - sum(rest)
            patterns.append(sums.consume(made))
    return patterns


def runs(patterns: list[Pattern]) -> np.ndarray:
    """Rows (length, first rank, first sequence, offset, copies): the pieces of a length from a rank on go to sequences from the first on, so many copies to each, from the offset on."""
    used: Counter[int] = Counter()
    rows, sequence = [], 0
    for times, lengths in patterns:
        offset = 0
        for length, copies in Counter(lengths).items():
            rows.append((length, used[length], sequence, offset, copies))
            used[length] += times * copies
            offset += length * copies
        sequence += times
    return np.array(sorted(rows), np.int64).reshape(-1, 5)


#: Ranks lie below this in a key of length and rank.
RANKS = 1 << 50


def pack(items: DataFrame, limit: int = 4096) -> DataFrame:
    """items (with ``length``, 1 to limit) and two more columns: sequence_id and offset, the piece's place there. Existing columns of these names are replaced.

    Rows equal in all columns are interchangeable.
    """
    items = items.drop("sequence_id", "offset")
    names = items.columns
    kept = stored(items.withColumn("_part", F.spark_partition_id()), "pieces")
    of_part = kept.groupBy("_part", "length").agg(F.count(F.lit(1)).alias("_n"))
    histogram = np.zeros(limit + 1, np.int64)
    for row in of_part.groupBy("length").agg(F.sum("_n").alias("n")).collect():
        histogram[row["length"]] = row["n"]
    table = runs(plan(histogram, limit))
    keys = table[:, 0] * RANKS + table[:, 1]

    before = Window.partitionBy("length").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    begins = of_part.select(F.col("_part").alias("_p"), F.col("length").alias("_l"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    nth = F.row_number().over(Window.partitionBy("_part", "length").orderBy(*[c for c in names if c != "length"]))
    ranked = kept.withColumn("_nth", nth).join(begins, (F.col("_part") == F.col("_p")) & (F.col("length") == F.col("_l")))
    ranked = ranked.select(*names, (F.col("_before") + F.col("_nth") - 1).alias("_rank"))
    at, rank = names.index("length"), len(names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths, ranks = batch.column(at).to_numpy().astype(np.int64), batch.column(rank).to_numpy()
            row = table[np.searchsorted(keys, lengths * RANKS + ranks, "right") - 1]
            place = ranks - row[:, 1]
            made = [pa.array(row[:, 2] + place // row[:, 4]), pa.array(row[:, 3] + place % row[:, 4] * lengths)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:rank], *made], names=[*names, "sequence_id", "offset"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in items.schema)
    return ranked.mapInArrow(run, f"{schema}, sequence_id long, offset long")


def op11_packing(docs: DataFrame, path: str) -> DataFrame:
    return pack(token_pieces(docs, path))
