"""Operators that work text by text: exact values, round trips and brute-force versions."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from tallyspark.llm import lm_scoring, pii, token_counts
from tallyspark.llm.wordhash import each_text, shingles

P = pytest.importorskip("public_tokenizers")
PIECES = P.path("piece_bpe_32k.model")
ODD = [None, "", " ", "\n\t", "a", "é", "a\x00b", "x" * 5000, "a b " * 3000, "▁ ▁a  b", "日本語 テキスト", "Ünï cödé　x"]


def test_word_boundaries_follow_the_byte_rule():
    texts = [*ODD, "A B c\x0bd\x1ce"]
    for i, data, starts, ends, hashes in each_text(pa.array(texts)):
        expected = (texts[i] or "").encode().lower().split()
        assert [bytes(data[a:b]).lower() for a, b in zip(starts, ends, strict=True)] == expected
        assert len(set(hashes.tolist())) == len(set(expected))


def test_chunks_do_not_change_hashes():
    texts = [" ".join(random.Random(i).choices("the of and on in a".split(), k=50)) for i in range(40)]
    small = [h.tolist() for *_, h in each_text(pa.array(texts), chunk=64)]
    assert small == [h.tolist() for *_, h in each_text(pa.array(texts))]


@pytest.mark.parametrize("k", [2, 5])
def test_shingles_count(k):
    for _, data, _, _, hashes in each_text(pa.array([t for t in ODD if t])):
        w = bytes(data).lower().split()
        expected = {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())
        assert len(shingles(hashes, k)) == len(expected)


def test_token_counts_match_the_library_across_cuts():
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    rng = random.Random(1)
    long = " ".join("".join(rng.choices("abcdeé▁<s>", k=rng.randint(1, 9))) for _ in range(4000)) + "   end  of text "
    texts = [*ODD, long, "<s> </s> <unk>", "\n".join(["a b"] * 3000)]
    expected = [len(sp.encode(t or "")) for t in texts]
    assert token_counts.lengths(texts, PIECES, long_chars=50, batch_bytes=200) == expected
    assert token_counts.lengths(texts, PIECES) == expected


def test_token_count_query(spark, docs):
    rows = token_counts.op6_token_counts(docs([(1, "a b"), (2, None), (None, ""), (3, "word " * 5000), (1, "a b")]), PIECES).collect()
    assert sorted((r["doc_id"] or 0, r["n_bytes"], r["n_tokens"] > 0, r["over_limit"]) for r in rows) == [
        (0, 0, False, False), (1, 3, True, False), (1, 3, True, False), (2, 0, False, False), (3, 25000, True, True),
    ]


def test_token_counts_on_odd_tables(docs):
    assert token_counts.op6_token_counts(docs([(1, "a")]).limit(0), PIECES).collect() == []
    got = token_counts.with_token_counts(docs([(1, "a b"), (2, None)]), PIECES, out="size")
    assert got.columns.count("size") == 1 and {r["doc_id"]: r["size"] > 0 for r in got.collect()} == {1: True, 2: False}


EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def plain_spans(text):
    digits = lambda x: re.sub("[^0-9]", "", x)

    def luhn(d):
        return sum(v if i % 2 == 0 else (v * 2 - 9 if v > 4 else v * 2) for i, v in enumerate(map(int, reversed(d)))) % 10 == 0

    out = [("email", *m.span()) for m in EMAIL.finditer(text)]
    out += [("ip", *m.span()) for m in IP.finditer(text) if all(int(x) <= 255 for x in m[0].split("."))]
    out += [("card", *m.span()) for m in CARD.finditer(text) if 16 <= len(digits(m[0])) <= 19 and luhn(digits(m[0]))]
    return out + [("phone", *m.span()) for m in PHONE.finditer(text) if 8 <= len(digits(m[0])) <= 15]


def test_base_spans_against_the_patterns():
    rng = random.Random(7)
    for _ in range(20_000):
        text = "".join(rng.choice("a.@1234 -+(0)5%é") for _ in range(rng.randint(0, 40)))
        assert pii.base_spans(text) == plain_spans(text), text
    for text in ["4111 1111 1111 1111", "1.2.3.4.5.6.7.8.9", "a@b@c.d e@f.g", "+1 (988) 555-2485", "0" * 2000 + ".1.2.3", "@a.b", "x" * 3000 + "@a.b"]:
        assert pii.base_spans(text) == plain_spans(text)


def test_pii_terms_are_generalised_or_removed(docs):
    rows = [(i, f"filler{i} alpha reaches zorblatt at joe@site.org {c} today") for i, c in enumerate(["one", "two", "three", "four"])]
    rows += [(100 + i, f"plain text number {chr(97 + i % 26)} says alpha today") for i in range(60)] + [(200, None), (201, ""), (0, rows[0][1])]
    found = {(r["doc_id"], r["spans"]) for r in pii.op4_pii(docs(rows)).collect()}
    spans = dict(found)
    text = rows[1][1]
    at = text.index("zorblatt")
    assert f"removed:{at}:{at + 8}" in spans[1] and spans[1].startswith("email:")
    assert spans[200] == spans[201] == "" and all(not spans[100 + i] for i in range(60))
    clean = {r["doc_id"]: r for r in pii.sanitise(docs(rows)).collect()}
    assert "zorblatt" not in clean[1]["text"] and "[EMAIL]" in clean[1]["text"] and clean[105]["text"] == rows[9][1]
    assert clean[200]["text"] is None and clean[201]["text"] == "" and clean[1]["size"] == "x"


def test_pii_identical_signatures_count_by_document(docs):
    signed = "sincerely zorblatt joe@site.org"
    rows = [(i, f"{'a b c d e f g h i'.replace(' ', chr(65 + i) + ' ')} {signed}") for i in range(3)] + [(10 + i, signed) for i in range(2)]
    rows += [(20, "alone vroomfondel ann@site.org")] + [(100 + i, "plain text") for i in range(60)]
    clean = {r["doc_id"]: r["text"] for r in pii.sanitise(docs(rows)).collect()}
    assert all("zorblatt" not in clean[i] and "[EMAIL]" in clean[i] for i in (0, 1, 2, 10, 11))
    assert clean[20] == "alone vroomfondel [EMAIL]" and clean[100] == "plain text"


def test_pii_terms_of_whole_documents(docs):
    far = " ".join(["common words of all the texts"] * 4)
    rows = [(i, f"Zorblatt {'x' * 400} lives. {far} {chr(65 + i)}only joe@site.org {far} so said zorblatt, Qi, and joe") for i in range(3)]
    rows += [(100 + i, f"{far} so said and lives") for i in range(60)] + [(200, "joe and ann@site.org")]
    got = {r["doc_id"]: r["text"] for r in pii.sanitise(docs(rows)).collect()}
    for i in range(3):
        assert got[i] == f"  lives. {far} {chr(65 + i)}only [EMAIL] {far} so said , , and [*]"  # joe: 3 of its 4 documents, 0.91, and no other term begins like it
    assert got[200] == "joe and [EMAIL]" and got[100] == rows[3][1]
    spans = {r["doc_id"]: r["spans"] for r in pii.op4_pii(docs(rows), broadcast_terms=1).collect()}
    places = [m.span() for m in re.finditer("(?i)zorblatt|x{400}|qi|joe$", rows[0][1])]
    assert [x for x in spans[0].split(",") if x[:1] in "rg"] == [f"{'generalised' if x == 'joe' else 'removed'}:{a}:{b}" for a, b in places for x in [rows[0][1][a:b]]] and spans[100] == ""


def brute_terms(rows, generalise=0.8, remove=0.95):
    """(removed, class) of each disclosing term of each text, by counting documents."""
    plain = {t: ({(k, plain_value(k, t[a:b])) for k, a, b in plain_spans(t)}, terms_outside(t)) for _, t in rows if t is not None}
    docs = {(i, t) for i, t in rows if t is not None}
    total, out = len(rows), {}
    for e in {e for es, _ in plain.values() for e in es}:
        holders = [t for _, t in rows if t is not None and e in plain[t][0]]
        distinct = [t for _, t in docs if e in plain[t][0]]
        share = lambda match, holders=holders: (
            math.log2(sum(match(plain[t][1]) for t in holders) * total / (len(holders) * sum(t is not None and match(plain[t][1]) for _, t in rows))) / math.log2(total / len(holders))
        )
        if len(distinct) < 2 or len(holders) == total:
            continue
        for x in {x for t in holders for x in plain[t][1]}:
            if sum(x in plain[t][1] for t in distinct) > 1 and (s := share(lambda ts, x=x: x in ts)) >= generalise:
                heads = [x[:k] for k in (3, 2, 1) if k < len(x)]
                fit = [h for h in heads if share(lambda ts, h=h: any(y.startswith(h) and len(y) > len(h) for y in ts)) < generalise]
                for t in holders:
                    if x in plain[t][1]:
                        was = out.setdefault(t, {}).get(x)
                        new = (s >= remove, "" if s >= remove else (fit or [""])[0])
                        out[t][x] = new if was is None else (was[0] or new[0], min(was[1], new[1]))
    return out


def plain_value(kind, value):
    return value.lower() if kind == "email" else value if kind == "ip" else re.sub("[^0-9]", "", value)


def terms_outside(t):
    spans = [(a, b) for _, a, b in plain_spans(t)]
    return {m[0].lower() for m in re.finditer(r"[^\W\d_]+", t) if not any(a < m.end() and m.start() < b for a, b in spans)}


def test_pii_terms_against_counting(docs):
    rng = random.Random(11)
    words = [c + v + w for c in "bdgk" for v in "aeiou" for w in ("", "ra", "ri", "lo")]
    people = {f"{x}@site.org": rng.sample(words, 3) for x in "pqrst"}
    rows = [(i, " ".join(rng.choices(words, k=12))) for i in range(120)] + [(500, None), (501, "")]
    for i, (mail, own) in enumerate(people.items()):
        for k in range(2 + i):
            rows.append((200 + 10 * i + k, " ".join([*rng.choices(words, k=5), *(own[: rng.randint(1, 3)]), f"name{chr(97 + i)}", mail, *rng.choices(words, k=2)])))
    rows += [(600 + i, f"{' '.join(rng.choices(words, k=9))} name{'abcde'[i % 5]}") for i in range(10)]
    rows += [rows[-11], (300, rows[-11][1]), (301, f"{'x ' * 30_000}namee")]
    expected = brute_terms(rows)
    got = {r["text"]: r["terms"] for r in pii.with_terms(docs(rows), pii.disclosed(docs(rows), 0.8, 0.95, 1000), "_k", "terms", 1000).collect() if r["terms"]}
    assert {t: {x["term"]: (x["removed"], "" if x["removed"] else x["class"]) for x in xs} for t, xs in got.items()} == {
        t: {x: (r, "" if r else c) for x, (r, c) in xs.items()} for t, xs in expected.items()
    }
    assert any(not r for xs in expected.values() for r, _ in xs.values()) and any(c for xs in expected.values() for _, c in xs.values())
    assert pii.op4_pii(docs(rows).limit(0)).collect() == [] and pii.sanitise(docs(rows).limit(0)).collect() == []


def test_pii_without_terms(docs):
    rows = {r["doc_id"]: r["text"] for r in pii.sanitise(docs([(1, "mail a@b.cd now"), (2, None)])).collect()}
    assert rows == {1: "mail [EMAIL] now", 2: None}


def test_lattice_against_all_segmentations():
    pieces, logs = lm_scoring.vocabulary(PIECES)
    lattice, at = lm_scoring.Lattice(pieces), {p: i for i, p in enumerate(pieces)}
    logs = np.array(logs)

    def ways(text):
        """Every cut of the text into pieces, as lists of piece numbers."""
        if not text:
            yield []
        for j in range(1, len(text) + 1):
            if text[:j] in at:
                for rest in ways(text[j:]):
                    yield [at[text[:j]], *rest]

    words = [b"the", b"on", b"heres", "é1".encode(), b"zq"]
    every = {w: list(ways(lm_scoring.MARK.encode() + w)) for w in words}
    for w in words:
        expected = math.log10(sum(math.exp(logs[cut].sum()) for cut in every[w]))
        assert lattice.score([w], logs, logs - 1)[0][0] == pytest.approx(expected, abs=1e-9)
    # Expected uses: each cut's pieces, weighted by the cut's share of the word's probability.
    counts, expected = np.array([2.0, 1.0, 5.0, 1.0, 3.0]), np.zeros(len(pieces))
    for w, n in zip(words, counts, strict=True):
        weight = np.array([math.exp(logs[cut].sum()) for cut in every[w]])
        for cut, x in zip(every[w], weight / weight.sum(), strict=True):
            np.add.at(expected, cut, n * x)
    assert lattice.expect(words, counts, logs) == pytest.approx(expected, abs=1e-9)
    assert lattice.score([b"x" * 3000], logs)[0][0] < -1000


def test_lm_step_raises_the_likelihood(spark, docs):
    pieces, first = lm_scoring.vocabulary(PIECES)
    rows = docs([(i, "the thing is on the heath " * (i % 3 + 1)) for i in range(30)])
    score = [sum(r["score"] for r in lm_scoring.score(rows, PIECES, steps=n).where("not held_out").collect()) for n in (0, 1, 2)]
    assert score[0] < score[1] < score[2]


def test_lm_query(docs):
    rng = random.Random(3)
    texts = [(i, " ".join(rng.choices("The of ON and in a zyx".split(), k=rng.randint(0, 30)))) for i in range(40)]
    texts += [(50, None), (51, ""), (3, "The the"), (52, "ñandú " * 3), (None, "of no id"), (53, ("y" * 700 + " ") * 4), (54, "z" * 32), (55, "w" * 31)]
    train = [t for i, t in texts if zlib.crc32(str("" if i is None else i).encode()) % 7 != 2]
    counts = Counter(w for t in train for w in [*(t or "").encode().lower().split(), None])
    n, v = sum(counts.values()), len(counts)
    got = lm_scoring.score(docs(texts), PIECES, steps=1, head=3).collect()
    expected = []
    for i, t in texts:
        w = [*(t or "").encode().lower().split(), None]
        held = zlib.crc32(str("" if i is None else i).encode()) % 7 == 2
        expected.append((i, held, len(w), sum(counts[x] > 0 for x in w), n, round(sum(math.log10((counts[x] + 1) / (n + v + 1)) for x in w), 6)))
    key = lambda x: (x[0] or -1, x[2], x[5])
    assert sorted(((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in got), key=key) == sorted(expected, key=key)
    # Text scores are sums of word scores by the two models, whatever the size of the head.
    pieces, first = lm_scoring.vocabulary(PIECES)
    logs, lattice = np.array(first) + math.log(0.9), lm_scoring.Lattice(pieces)
    trained = Counter(w for t in train for w in (t or "").encode().lower().split())
    uses = np.append(lattice.expect(list(trained), np.array(list(trained.values()), float), logs) + 0.1, len(train) + 0.1)
    better = np.log(uses / uses.sum())
    by_id = {i: (t or "").encode().lower().split() for i, t in texts if i != 3}
    for head in (3, 1000):
        for r in lm_scoring.score(docs(texts), PIECES, steps=1, head=head).where("doc_id <> 3").collect():
            w = by_id[r["doc_id"]]
            assert r["score"] == pytest.approx(better[-1] / math.log(10) + lattice.score(w, better[:-1])[0].sum(), rel=1e-9)
            assert r["file_score"] == pytest.approx(-1 + lattice.score(w, logs)[0].sum(), rel=1e-9)


def test_lm_odd_tables(docs):
    assert lm_scoring.op5_lm_scoring(docs([(1, "a")]).limit(0), PIECES).collect() == []
    held = [i for i in range(60) if zlib.crc32(str(i).encode()) % 7 == 2]
    rows = lm_scoring.op5_lm_scoring(docs([(i, "some words") for i in held]), PIECES).collect()
    assert {(r["held_out"], r["train_tokens"], r["n_known"], r["base_score"]) for r in rows} == {(True, 0, 0, 0.0)} and len({r["score"] for r in rows}) == 1
