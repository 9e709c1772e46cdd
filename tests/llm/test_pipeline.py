"""The pipeline against a brute-force version of each stage, on a small corpus."""

import random
from collections import Counter

import duckdb
from test_corpus_operators import edited, kept_by_row, labelled, text
from test_text_operators import plain_spans

import corpus_pipeline
from tallyspark.llm import mixing, quality


def corpus(spark, root):
    rng = random.Random(12)
    rows, labels = labelled(rng, 250)
    items = [(i, text(rng, 30)) for i in range(4)]
    good = [t for (i, t), (_, q, _) in zip(rows, labels, strict=True) if q]
    n = len(rows)
    rows += [(n + i, edited(rng, t, 1)) for i, t in enumerate(good[:40])]
    rows += [(n + 100 + i, f"{text(rng, 40)} {items[i % 4][1]} {text(rng, 40)}") for i in range(8)]
    rows += [(n + 200 + i, f"{text(rng, 40)} mail me{i}@host{i}.example.org or +1 (555) 555-01{i:02d} {text(rng, 40)}") for i in range(10)]
    rows += [(n + 300, None), (n + 301, ""), (n + 302, good[0]), (None, text(rng, 50))]
    full = [(i, t, "en", f"s{(i or 0) % 5}" if i != 7 else None, len(t or "")) for i, t in rows]
    spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{root}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{root}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{root}/benchmark.parquet")
    return items


def plain_rewrite(t):
    spans = sorted((a, -b, k) for k, a, b in plain_spans(t or ""))
    out, last = [], 0
    for a, b, k in spans:
        if a >= last:
            out += [t[last:a], f"[{k.upper()}]"]
        last = max(last, -b)
    return t if not spans else "".join([*out, t[last:]])


def test_stages(spark, tmp_path):
    root = str(tmp_path)
    items = corpus(spark, root)
    docs = spark.read.parquet(f"{root}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_classifier", "minhash_near_dedup", "benchmark_decontamination", "pii_sanitisation", "source_mixing"]
    frames = [docs]
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, frames[-1], root).write.parquet(f"{root}/{name}")
        frames.append(spark.read.parquet(f"{root}/{name}"))
    assert all(f.columns == list(corpus_pipeline.COLUMNS) for f in frames[1:-1])
    rows = [[(r["doc_id"], r["text"]) for r in f.collect()] for f in frames]
    key = lambda x: (x[0] is None, x[0] or 0, x[1] or "")

    scores = {r["doc_id"]: r["predicted"] for r in quality.op7_quality(docs, spark.read.parquet(f"{root}/labels.parquet")).collect()}
    assert sorted(rows[1], key=key) == sorted((x for x in rows[0] if scores[x[0]]), key=key) and len(rows[1]) < len(rows[0])

    assert Counter(rows[2]) == kept_by_row(rows[1]) and len(rows[2]) < len(rows[1])

    held = [x for x in rows[2] if any(t in (x[1] or "") for _, t in items)]
    assert len(held) == 8 and sorted(rows[3], key=key) == sorted((x for x in rows[2] if x not in held), key=key)

    assert sorted(rows[4], key=key) == sorted(((i, plain_rewrite(t)) for i, t in rows[3]), key=key)
    assert not any(plain_spans(t or "") for _, t in rows[4]) and sum("[EMAIL]" in (t or "") for _, t in rows[4]) >= 9

    con = duckdb.connect()
    con.register("t", frames[4].toPandas())
    typed = "(SELECT doc_id::bigint AS doc_id, text, source FROM t)"
    taken = con.execute(mixing.ORACLE.replace("FROM documents", f"FROM {typed}")).fetchall()
    assert {r["doc_id"]: r["copies"] for r in frames[5].collect()} == {r[0]: r[4] // r[1] for r in taken if r[4]}
    assert sorted(map(str, corpus_pipeline.run(spark, root).collect())) == sorted(map(str, frames[5].collect()))


def test_stages_on_odd_tables(spark, tmp_path):
    root = str(tmp_path)
    corpus(spark, root)
    kinds = "doc_id long, text string, lang string, source string, n_chars long, copies int, _text_key string"
    odd = [(1, None, None, None, None, 9, "x"), (None, None, "en", "s", 0, 9, "x"), (2, "", "en", "s", 0, 9, "x"), (3, "word " * 30_000, "en", "s", 1, 9, "x"), (3, "word " * 30_000, "en", "s", 1, 9, "x"),
           (None, "a b c d e f g", "en", None, 3, 9, "x")]
    for rows in ([], odd):
        docs = spark.createDataFrame(rows, kinds).coalesce(2)
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, root)
            wanted = [*corpus_pipeline.COLUMNS, "copies"] if name == "source_mixing" else list(corpus_pipeline.COLUMNS)
            assert out.columns == wanted
            # Quality rejects none of these without labels of its kind; equal rows of a text with words are one, empty ones stay; nothing holds a benchmark passage or personal data.
            got = Counter((r["doc_id"], r["text"]) for r in out.collect())
            given = Counter((r[0], r[1]) for r in rows)
            if name == "minhash_near_dedup":
                assert got == Counter({k: 1 if (k[1] or "").strip() else n for k, n in given.items()})
            elif name in ("benchmark_decontamination", "pii_sanitisation"):
                assert got == given
            else:
                assert not got - given
    for name in ("labels", "benchmark"):
        empty = spark.read.parquet(f"{root}/{name}.parquet").limit(0)
        empty.write.parquet(f"{root}/empty/{name}.parquet")
    docs = spark.createDataFrame(odd, kinds)
    assert corpus_pipeline.quality_classifier(spark, docs, f"{root}/empty").count() == len(odd)
    assert corpus_pipeline.benchmark_decontamination(spark, docs, f"{root}/empty").count() == len(odd)
