"""The pipeline against its stages by brute force, and its rules for odd rows."""

import hashlib

import corpus_pipeline as P
import numpy as np
import public_tokenizers
from corpora import corpus, frame
from lodestone.llm import decontaminate as D, quality_rules as Q, sentencepieces
from pyspark.sql import functions as F
from test_dedup import bytes_brute, simhash_brute
from test_text import distances_brute


def cut(raw, rows, i, width=50):
    """Text i without the bytes of strings that documents of smaller ids hold."""
    least = set()
    for r in rows:
        if r[0] < rows[i][0]:
            b = r[1].encode()
            least.update(b[k : k + width] for k in range(len(b) - width + 1))
    gone = [False] * len(raw)
    for k in range(len(raw) - width + 1):
        if raw[k : k + width] in least:
            gone[k : k + width] = [True] * width
    return bytes(x for x, g in zip(raw, gone, strict=True) if not g).decode("utf-8", "ignore")


def leaks(text, items):
    raw = text.encode()
    words = D.words_of(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))[0].tolist()
    for item in items:
        m, own = len(item.words), set(item.words.tolist())
        for a in range(0, max(1, len(words) - m + 1)):
            part = words[a : a + m]
            if sum(w in own for w in part) >= 0.7 * m and D.common_subsequence(item.words.tolist(), part) >= 0.9 * m:
                return True
    return False


def test_run_is_the_brute_force_pipeline(spark, sf):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars").collect()]
    cutoff = Q.chi2_quantile(1 - Q.TAIL, Q.FEATURES)
    rows = [r for r, d in distances_brute(docs).items() if d is None or d <= cutoff]
    first = {(d, c) for d, _, c in simhash_brute(rows)}
    rows = [r for r in rows if (r[0], r[0]) in first]
    rows = [(r[0], cut(r[1].encode(), rows, i), *r[2:]) for i, r in enumerate(rows)]
    items = D.read_items([r.asDict() for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()])
    rows = [r for r in rows if not leaks(r[1], items)]
    model = sentencepieces.Viterbi(public_tokenizers.path("piece_bpe_32k.model"))
    want = {}
    for r in rows:
        ids, _ = model.encode([r[1]])
        want[r[0]] = (len(r[1].encode()), len(ids), hashlib.sha256(r[1].encode()).hexdigest(), True, ids.tolist())
    got = {r["doc_id"]: (r["n_bytes"], r["n_tokens"], r["decoded_sha256"], r["round_trip"], r["ids"]) for r in P.run(spark, sf).collect()}
    assert got == want and 0 < len(got) < len(docs)


def test_stages_keep_the_columns_and_odd_rows(spark, sf):
    docs = frame(spark, corpus())
    kept = [docs]
    for _, stage in P.STAGES[:-1]:
        out = stage(spark, kept[-1], sf)
        assert out.columns == docs.columns and [f.dataType for f in out.schema] == [f.dataType for f in docs.schema]
        rows = out.collect()
        assert rows
        kept.append(spark.createDataFrame(rows, docs.schema))
        none = stage(spark, docs.limit(0), sf)
        assert none.columns == docs.columns and none.count() == 0
    assert P.STAGES[-1][1](spark, docs.limit(0), sf).count() == 0
    found = P.repeated_strings(spark, docs, sf)
    assert found.count() == docs.count()
    want = {(r[0], r[2]) for r in bytes_brute([tuple(r)[:2] for r in docs.collect()], 50) if r[2]}
    changed = {r["doc_id"] for r in found.join(docs.select("doc_id", F.col("text").alias("t")).distinct(), "doc_id").where("text <> t").collect()}
    assert changed <= {d for d, _ in want}


def test_rows_that_share_a_doc_id_go_each_by_its_own_text(spark, sf):
    item = spark.read.parquet(f"{sf}/benchmark.parquet").first()["text"]
    text = lambda n: " ".join(f"w{n}x{i}" for i in range(80))
    rows = [(1, text(1), "en", "s", 1), (2, text(1), "en", "s", 1), (2, text(2), "en", "s", 1), (3, text(3) + " " + item, "en", "s", 1), (3, text(4), "en", "s", 1), (None, text(5) + " " + item, "en", "s", 1)]
    docs = frame(spark, rows)
    assert sorted((r["doc_id"], r["text"]) for r in P.near_duplicates(spark, docs.where("doc_id < 3"), sf).collect()) == [(1, text(1)), (2, text(2))]
    assert sorted((r["doc_id"], r["text"]) for r in P.benchmark_leaks(spark, docs, sf).collect()) == [(1, text(1)), (2, text(1)), (2, text(2)), (3, text(4))]
