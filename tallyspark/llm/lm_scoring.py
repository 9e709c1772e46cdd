"""Language-model scoring by a subword lattice.

A word (with the space mark before it) is any sequence of pieces of an existing vocabulary whose strings add up to it, bytes of the word being pieces too. Each
piece has a probability; the probability of a word is the sum over all its segmentations, and that of a text the product over its words and one end. The sum
is a forward recursion over the word's bytes in log space. No tokenizer is trained: the vocabulary is given, its own scores (ranks of merges) set the
first probabilities by the rank-frequency law, and expectation maximisation over the counted words of the training documents re-weighs them. ``score`` is by the re-weighed
probabilities, ``file_score`` by the first ones.

The base score is the add-one unigram model over training words.

Scale: words of the whole corpus are counted per task before one shuffle; the lattice runs once per distinct word, not per occurrence. What the driver gets is one
number per vocabulary piece and the ``head``: at most so many of the most frequent words, each by a key of at most ``KEY`` bytes, which are broadcast and scored where the text is read. Every other
word, being rarer than all of these, goes through a join on the word; all words are exact, and no frequent word of any length is a key of the join.

Defined cases: null and empty texts have one token, the end; repeated rows score alike; held-out documents teach nothing; with no training documents N and V are 0, a word's
base probability is 1 in 1, and the first probabilities stay; very long words are one lattice of their own length; an empty table gives an empty result. Ids must be numbers. Extra columns are not looked at.
"""

from __future__ import annotations

import hashlib
import math
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import crc_mod, released, scratch, stored, words

MARK = "▁"
#: Stands for the mark before a word inside a lattice; no UTF-8 text holds this byte.
START = b"\xff"
#: Rows a task holds before it hands on its counts.
FLUSH = 200_000
#: Words of so many bytes or more are known by their digest, which has so many bytes.
KEY = 32


def key_of(word: bytes) -> bytes:
    return word if len(word) < KEY else hashlib.sha256(word).digest()


def word_key() -> Column:
    return F.when(F.octet_length("word") < KEY, F.col("word")).otherwise(F.unhex(F.sha2("word", 256)))


@lru_cache(maxsize=2)
def vocabulary(path: str) -> tuple[tuple[bytes, ...], tuple[float, ...]]:
    """(pieces as UTF-8, first natural-log probabilities); bytes come first and make every word possible."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces: dict[bytes, float] = {bytes([b]): -20_000.0 for b in range(256) if b != START[0]}
    for i in range(sp.vocab_size()):
        if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i)):
            piece = sp.id_to_piece(i).encode()
            if piece.lower() == piece and not piece.strip(MARK.encode()) == b"" or piece == MARK.encode():
                pieces[piece] = max(pieces.get(piece, -1e9), sp.get_score(i))
    weight = {p: 1 / (2 - s) for p, s in pieces.items()}
    total = sum(weight.values())
    return tuple(pieces), tuple(math.log(weight[p] / total) for p in pieces)


class Lattice:
    """Pieces as a trie; works on all words of one length together. Probabilities of pieces are natural logs, in the order of the pieces."""

    def __init__(self, pieces: tuple[bytes, ...]):
        nodes: dict[bytes, int] = {b"": 0}
        edges, here = [], [-1]
        for k, piece in enumerate(pieces):
            text = START + piece[len(MARK.encode()) :] if piece.startswith(MARK.encode()) else piece
            for i in range(len(text)):
                part = text[: i + 1]
                if part not in nodes:
                    nodes[part] = len(nodes)
                    edges.append((nodes[text[:i]] << 8 | text[i], nodes[part]))
                    here.append(-1)
            here[nodes[text]] = k
        edges.sort()
        self.keys, self.to = (np.array(x, np.int64) for x in zip(*edges, strict=True))
        self.piece = np.array(here, np.int64)

    @staticmethod
    def groups(words: list[bytes], most: int = 1 << 20) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(places, byte matrix with the start mark) of words of one length, of bounded size."""
        sizes = np.array([len(w) for w in words])
        order = np.argsort(sizes, kind="stable")
        cuts = np.flatnonzero(np.diff(sizes[order])) + 1
        for same in np.split(order, cuts):
            if len(same):
                n = int(sizes[same[0]])
                step = max(1, most // (n + 1))
                for i in range(0, len(same), step):
                    part = same[i : i + step]
                    yield part, np.frombuffer(b"".join(START + words[x] for x in part), np.uint8).reshape(len(part), n + 1)

    def arcs(self, m: np.ndarray) -> list[list[tuple[int, np.ndarray, np.ndarray]]]:
        """For each end, (begin, rows, pieces) of the pieces that end there."""
        n = m.shape[1]
        out: list[list[tuple[int, np.ndarray, np.ndarray]]] = [[] for _ in range(n + 1)]
        for i in range(n):
            rows, node = np.arange(len(m)), np.zeros(len(m), np.int64)
            for j in range(i, n):
                key = node << 8 | m[rows, j]
                at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
                alive = self.keys[at] == key
                rows, node = rows[alive], self.to[at[alive]]
                if not len(rows):
                    break
                k = self.piece[node]
                ends = k >= 0
                if ends.any():
                    out[j + 1].append((i, rows[ends], k[ends]))
        return out

    @staticmethod
    def forward(arcs: list, count: int, logs: np.ndarray) -> np.ndarray:
        """Log of the probability of each beginning of each word, all segmentations together."""
        a = np.full((len(arcs), count), -np.inf)
        a[0] = 0.0
        for j in range(1, len(arcs)):
            for i, rows, k in arcs[j]:
                a[j, rows] = np.logaddexp(a[j, rows], a[i, rows] + logs[k])
        return a

    def score(self, words: list[bytes], *models: np.ndarray) -> np.ndarray:
        """log10 of each word's probability by each model, one row a model."""
        out = np.zeros((len(models), len(words)))
        for places, m in self.groups(words):
            arcs = self.arcs(m)
            for row, logs in zip(out, models, strict=True):
                row[places] = self.forward(arcs, len(m), logs)[-1] / math.log(10)
        return out

    def expect(self, words: list[bytes], counts: np.ndarray, logs: np.ndarray) -> np.ndarray:
        """Expected uses of each piece in so many copies of each word."""
        uses = np.zeros(len(logs))
        for places, m in self.groups(words):
            arcs = self.arcs(m)
            a = self.forward(arcs, len(m), logs)
            b = np.full_like(a, -np.inf)
            b[-1] = 0.0
            ids, weights, c = [], [], counts[places]
            for j in range(len(arcs) - 1, 0, -1):
                for i, rows, k in arcs[j]:
                    t = b[j, rows] + logs[k]
                    ids.append(k)
                    weights.append(c[rows] * np.exp(a[i, rows] + t - a[-1, rows]))
                    b[i, rows] = np.logaddexp(b[i, rows], t)
            uses += np.bincount(np.concatenate(ids), np.concatenate(weights), len(uses))
        return uses


def word_counts(docs: DataFrame) -> DataFrame:
    """word, n (all documents), c (training documents): every distinct word of the corpus, summed per task first."""
    schema = pa.schema([("word", pa.binary()), ("n", pa.int64()), ("c", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = (Counter(), Counter())

        def out() -> pa.RecordBatch:
            keys = list(held[0].keys() | held[1].keys())
            c = [held[1][w] for w in keys]
            batch = pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array([held[0][w] + x for w, x in zip(keys, c, strict=True)], pa.int64()), pa.array(c, pa.int64())], schema=schema)
            held[0].clear()
            held[1].clear()
            return batch

        for batch in batches:
            for text, train in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                held[train].update(words(text.as_py()))
                if len(held[0]) + len(held[1]) > FLUSH:
                    yield out()
        yield out()

    counted = docs.select("text", (crc_mod(F.col("doc_id"), 7) != 2).alias("train")).mapInArrow(released(run), "word binary, n long, c long")
    return counted.groupBy("word").agg(F.sum("n").alias("n"), F.sum("c").alias("c"))


def reweigh(counts: DataFrame, lattice: Broadcast, logs: np.ndarray, ends: int, smooth: float = 0.1) -> np.ndarray:
    """One step of expectation maximisation: new natural-log probabilities of the pieces, and last that of the end."""
    size = len(logs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        uses = np.zeros(size)
        for batch in batches:
            if batch.num_rows:
                uses += lattice.value.expect(batch.column(0).to_pylist(), batch.column(1).to_numpy(), logs)
        at = np.flatnonzero(uses)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(uses[at])], names=["piece", "uses"])

    rows = counts.where("c > 0").select("word", "c").mapInArrow(released(run), "piece long, uses double").groupBy("piece").agg(F.sum("uses").alias("uses")).collect()
    uses = np.full(size + 1, smooth)
    for r in rows:
        uses[r["piece"]] += r["uses"]
    uses[size] += ends
    return np.log(uses / uses.sum())


def most_frequent(weighed: DataFrame, head: int) -> DataFrame:
    """The words that occur more often than some bound, which is the least that leaves no more than ``head`` words."""
    # One row for each frequency; few, and only those with a word more frequent than 1 in so many.
    often = weighed.groupBy("n").agg(F.count(F.lit(1)).alias("words")).orderBy(F.desc("n")).limit(head).collect()
    total, bound = 0, None
    for r in often:
        total += r["words"]
        if total > head:
            break
        bound = r["n"]
    return weighed.where(F.col("n") >= bound) if bound is not None else weighed.limit(0)


def _base(c: int, total: int, distinct: int) -> float:
    return math.log10((c + 1) / (total + 1 * (distinct + 1)))


PART = "row long, doc_id long, key binary, tf long, n_tokens long, n_known long, base_score double, score double, file_score double"
_PART = [pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64()]
SUMS = ("n_tokens", "n_known", "base_score", "score", "file_score")


def _batch(rare: list[tuple], whole: list[tuple]) -> pa.RecordBatch:
    """Rows without scores, then rows with."""
    zeros = [np.zeros(len(rare), np.int64)] * 2 + [np.zeros(len(rare))] * 3
    columns = [*(list(zip(*rare, strict=True)) if rare else [()] * 4), *zeros]
    both = zip(columns, zip(*whole, strict=True) if whole else [()] * len(_PART), _PART, strict=True)
    arrays = [pa.concat_arrays([pa.array(a, t), pa.array(b, t)]) for a, b, t in both]
    return pa.RecordBatch.from_arrays(arrays, names=[f.split()[0] for f in PART.split(", ")])


def text_parts(docs: DataFrame, known: Broadcast, end: tuple[int, float, float, float]) -> DataFrame:
    """Rows of PART: for each text one without a key, which sums up the end (seen, and its scores) and the words that are known, and one for each other distinct word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get = known.value.get
        rare: list[tuple] = []
        whole: list[tuple] = []
        for batch in batches:
            for row, doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                n, (seen, base, log, file_log) = 1, end
                for word, k in Counter(words(text.as_py())).items():
                    n += k
                    found = get(word) if len(word) < KEY else get(key_of(word))
                    if found:
                        seen += k * found[0]
                        base += k * found[1]
                        log += k * found[2]
                        file_log += k * found[3]
                    else:
                        rare.append((row, doc, key_of(word), k))
                whole.append((row, doc, None, 0, n, seen, base, log, file_log))
                if len(rare) + len(whole) > FLUSH:
                    yield _batch(rare, whole)
                    rare.clear()
                    whole.clear()
        yield _batch(rare, whole)

    return docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(released(run), PART)


def score(docs: DataFrame, path: str, steps: int = 3, head: int = 100_000) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, file_score of each row."""
    spark = docs.sparkSession
    with scratch(spark) as keep:
        counts = stored(word_counts(docs), "word-counts")
        totals = counts.agg(F.sum("c").alias("n"), F.count(F.when(F.col("c") > 0, 1)).alias("v")).first()
        ends = docs.where(crc_mod(F.col("doc_id"), 7) != 2).count()
        total, distinct = (totals["n"] or 0) + ends, totals["v"] + (ends > 0)
        pieces, first = vocabulary(path)
        lattice = spark.sparkContext.broadcast(Lattice(pieces))
        file_logs = np.array([*(np.array(first) + math.log(0.9)), math.log(0.1)])
        logs = file_logs
        for _ in range(steps if ends else 0):
            logs = reweigh(counts, lattice, logs[:-1], ends)
        models = (logs[:-1], file_logs[:-1])

        def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                base = pa.array([_base(c, total, distinct) for c in batch.column("c").to_pylist()], pa.float64())
                scores = lattice.value.score(batch.column("word").to_pylist(), *models)
                yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("n"), batch.column("seen"), base, *map(pa.array, scores)], names=["key", "n", "seen", "base", "log", "file_log"])

        rows = counts.select("word", word_key().alias("key"), "n", "c", (F.col("c") > 0).cast("int").alias("seen"))
        weighed = keep(rows.mapInArrow(released(weigh), "key binary, n long, seen int, base double, log double, file_log double"), "word-scores")
        top = most_frequent(weighed, head).drop("n").toPandas()
        known = spark.sparkContext.broadcast({bytes(key): tuple(x) for key, *x in zip(*(top[c].tolist() for c in top.columns), strict=True)})
        end = (int(bool(ends)), _base(ends, total, distinct), float(logs[-1]) / math.log(10), float(file_logs[-1]) / math.log(10))
        parts = keep(text_parts(docs, known, end), "text-parts")
    tf = F.col("tf")
    rare = parts.where("key is not null").select("row", "doc_id", "key", "tf").join(weighed, "key")
    rare = rare.select(
        "row", "doc_id", F.lit(0).cast("long").alias("n_tokens"), (tf * F.col("seen")).alias("n_known"), (tf * F.col("base")).alias("base_score"), (tf * F.col("log")).alias("score"),
        (tf * F.col("file_log")).alias("file_score"),
    )
    whole = parts.where("key is null").select("row", "doc_id", *SUMS).unionByName(rare).groupBy("row", "doc_id").agg(*[F.sum(c).alias(c) for c in SUMS])
    return whole.select("doc_id", (crc_mod(F.col("doc_id"), 7) == 2).alias("held_out"), "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), "base_score", "score", "file_score")


def op5_lm_scoring(docs: DataFrame, path: str) -> DataFrame:
    return score(docs, path)
