"""Token counts: texts are encoded in Arrow batches and only lengths come back.

Batches for the library are balanced by bytes, not rows, so one very long text never shares a call with many others.
A long text is cut at single spaces between two other characters. Such a cut is safe if no vocabulary piece has
the space mark after another character, which is checked on the vocabulary itself: no merge can then cross the cut, and the mark that
the library puts before each text stands for the space dropped there. Null and empty texts have 0 tokens.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The library's space mark, a fixed value of its file format.
MARK = "▁"


@lru_cache(maxsize=2)
def _model(path: str):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    inner = any(MARK in sp.id_to_piece(i).lstrip(MARK) for i in range(sp.vocab_size()))
    plain = sp.encode("a b", out_type=str) == [f"{MARK}a", f"{MARK}b"]
    return sp, plain and not inner


def cut(text: str, most: int) -> Iterator[str]:
    """Pieces of at least most characters, cut at the first safe place after them; whole if there is none."""
    start, size, blank = 0, len(text), (" ", MARK)
    while size - start > most:
        at = text.find(" ", start + most)
        while 0 < at < size - 1 and (text[at - 1] in blank or text[at + 1] in blank):
            at = text.find(" ", at + 1)
        if at <= start or at >= size - 1:
            break
        yield text[start:at]
        start = at + 1
    yield text[start:]


def lengths(texts: list[str | None], path: str, long_chars: int = 16_384, batch_bytes: int = 1 << 20) -> list[int]:
    """Tokens of each text."""
    sp, safe = _model(path)
    out, pieces, owners, held = [0] * len(texts), [], [], 0

    def flush() -> None:
        for i, ids in zip(owners, sp.encode(pieces, num_threads=1), strict=True):
            out[i] += len(ids)
        pieces.clear()
        owners.clear()

    for i, text in enumerate(texts):
        for piece in cut(text, long_chars) if safe and text and len(text) > long_chars else [text or ""]:
            if piece:
                pieces.append(piece)
                owners.append(i)
                held += len(piece.encode("utf-8", "surrogatepass"))
                if held >= batch_bytes:
                    flush()
                    held = 0
    if pieces:
        flush()
    return out


def token_count(text: Column, path: str, long_chars: int = 16_384, batch_bytes: int = 1 << 20) -> Column:
    """Number of tokens of a text column (long)."""

    @F.arrow_udf("long")
    def count(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array(lengths(batch.to_pylist(), path, long_chars, batch_bytes), pa.int64())

    return count(text)


def with_token_counts(docs: DataFrame, path: str, text: str = "text", out: str = "n_tokens", **limits: int) -> DataFrame:
    """docs and one more column; an existing column of that name is replaced."""
    return docs.withColumn(out, token_count(F.col(text), path, **limits))


def op6_token_counts(docs: DataFrame, path: str) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    counted = docs.select("doc_id", F.octet_length(text).cast("long").alias("n_bytes"), token_count(F.col("text"), path).alias("n_tokens"))
    return counted.withColumn("over_limit", F.col("n_tokens") > 4096)
