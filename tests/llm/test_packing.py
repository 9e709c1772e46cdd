import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tallyspark.llm import packing
from tallyspark.llm.common import read

PATH = public_tokenizers.path("word_bpe_49k.json")
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(PATH)


def by_library(tokenizer, text):
    return tokenizer.encode(text or "", add_special_tokens=False).ids


def of_text(text, **how):
    return np.frombuffer(b"".join(packing.ids(text.encode(), PATH, **how)), "<u4").tolist()


def test_ids_are_those_of_the_library(tokenizer):
    odd = [
        "", " ", "Don't I'LL it's 'this 've'd", "a<|endoftext|>b <|startoftext|> <|endoftext", "café café İstanbul STRASSE straße ΣΣ σς", "x y z　w\x1cq\x0b\x0cr",
        "12345 a1b2 3.14% _under_score_ $$$!!!''''", "中文字符 \U0001f600\U0001f468‍\U0001f469 ภาษา", "ŉ ſ µ × ÷ ª º ½ ²", "w" * 300, "\x00\x01 \x7f", "a\n\n\tb  c ",
    ]
    for text in odd:
        assert of_text(text) == by_library(tokenizer, text), text
    rng = random.Random(5)
    letters = "abcXYZ'0189.,-_ \n\téßİ́Éſ中 <|endoftext|>"
    for _ in range(300):
        text = "".join(rng.choice(letters) for _ in range(rng.randrange(60)))
        assert of_text(text, stretch=7) == by_library(tokenizer, text), text


def test_ids_of_a_table(spark, tokenizer):
    for row in read(spark, SF, "documents").select("text").limit(40).collect():
        assert of_text(row.text or "") == by_library(tokenizer, row.text)


def test_other_forms_go_through_the_library_as_a_whole(tokenizer, tmp_path):
    other = Tokenizer.from_file(PATH)
    from tokenizers import normalizers

    other.normalizer = normalizers.NFC()
    other.save(str(tmp_path / "other.json"))
    text = "Don't  SHOUT"
    assert np.frombuffer(b"".join(packing.ids(text.encode(), str(tmp_path / "other.json"))), "<u4").tolist() == other.encode(text, add_special_tokens=False).ids
    packing._words.cache_clear()


def test_words_are_kept_up_to_a_bound(tokenizer, monkeypatch):
    monkeypatch.setattr(packing, "KEPT", 5)
    packing._words.cache_clear()
    text = " ".join(f"word{i % 9} other{i}" for i in range(50))
    assert of_text(text) == by_library(tokenizer, text)
    assert len(packing._words(PATH)) <= 5
    packing._words.cache_clear()


def held(rows, limit=4096):
    """Sequences are gapless from 0 and not beyond the limit; their number."""
    of = defaultdict(list)
    for r in rows:
        of[r.sequence_id].append((r.offset, r.length))
    for places in of.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at and length > 0
            at += length
        assert at <= limit
    return len(of)


def best_fit_decreasing(lengths, limit):
    gaps = []
    for x in sorted(lengths, reverse=True):
        fit = [i for i, g in enumerate(gaps) if g >= x]
        if fit:
            at = min(fit, key=lambda i: gaps[i])
            gaps[at] -= x
        else:
            gaps.append(limit - x)
    return len(gaps)


@pytest.mark.parametrize("seed", range(8))
def test_plan_uses_each_piece_once_and_is_no_worse_than_best_fit(seed):
    rng = random.Random(seed)
    limit = rng.choice([17, 64, 200])
    high = rng.choice([limit, limit // 2, 5])
    lengths = [rng.randint(1, high) for _ in range(rng.choice([1, 50, 400]))]
    counts = np.bincount(lengths, minlength=limit + 1)
    patterns = packing.plan(counts, limit)
    used = Counter()
    for times, made in patterns:
        assert times > 0 and sum(made) <= limit
        for x in made:
            used[x] += times
    assert used == Counter(lengths)
    n = sum(times for times, _ in patterns)
    assert -(-sum(lengths) // limit) <= n <= best_fit_decreasing(lengths, limit) + 1


def test_exact_complements_of_one_two_and_three():
    counts = np.zeros(101, np.int64)
    for x in (70, 30, 80, 13, 7, 90, 5, 3, 2, 100):
        counts[x] += 1
    patterns = packing.plan(counts, 100)
    assert sorted(sorted(p) for _, p in patterns) == [[2, 5, 13, 80], [3, 7, 90], [30, 70], [100]]


def test_plan_is_made_in_bulk():
    counts = np.zeros(4097, np.int64)
    counts[4096], counts[3000], counts[1096], counts[1] = 10**12, 10**11, 10**11, 10**9
    patterns = packing.plan(counts, 4096)
    assert len(patterns) < 10 and sum(t for t, _ in patterns) == 10**12 + 10**11 + -(-(10**9) // 4096)


def test_rows_against_the_library(docs, tokenizer):
    rng = random.Random(3)
    long = " ".join(rng.choice(["alpha", "Beta,", "naïve", "42", "don't"]) for _ in range(9000))
    texts = [None, "", "   ", "one", "one", long, long + " end", "x" * 5000, *[" ".join("word" for _ in range(rng.randrange(1, 900))) for _ in range(60)]]
    rows = [(i, t) for i, t in enumerate(texts)] + [(3, "one"), (None, "no id"), (4095, " ".join(["word"] * 4095)), (4096, " ".join(["word"] * 4096))]
    got = packing.op11_packing(docs(rows), PATH).collect()
    want = Counter()
    for doc_id, text in rows:
        ids = [*by_library(tokenizer, text), 1]
        for piece, start in enumerate(range(0, len(ids), 4096)):
            part = ids[start : start + 4096]
            want[doc_id, piece, start, len(part), zlib.crc32(np.array(part, "<u4").tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    total = sum(r.length for r in got)
    assert held(got) <= best_fit_decreasing([r.length for r in got], 4096)
    assert held(got) <= -(-total // 4096) + 1


def test_whole_table_is_packed_near_the_least(spark):
    got = packing.op11_packing(read(spark, SF, "documents"), PATH).collect()
    assert held(got) <= -(-sum(r.length for r in got) // 4096) + 1


def test_hot_length_over_many_parts(spark):
    items = spark.range(20_000).selectExpr("id", "cast(if(id % 3 = 0, 5, 1 + id % 7) as long) as length", "'x' as offset").repartition(13)
    got = packing.pack(items, limit=16).collect()
    assert len(got) == 20_000 and len({r.id for r in got}) == 20_000
    assert held(got, 16) <= 1.01 * sum(r.length for r in got) / 16


def test_empty_table(docs):
    got = packing.op11_packing(docs([]).limit(0), PATH)
    assert got.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"] and got.count() == 0
