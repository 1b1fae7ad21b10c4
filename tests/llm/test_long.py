"""Very long texts pass every operator whole: what stands at their ends counts."""

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from corpora import SCHEMA, WORDS, prose
from lodestone.llm import decontaminate as D, language_id as L, license_scan as C, quality_rules as Q, sentencepieces, simhash_dedup as S, token_store as T
from lodestone.llm.substring_dedup import substring_dedup
from lodestone.llm.suffix_dedup import suffix_array_dedup
from lodestone.llm.token_counts import token_counts
from test_dedup import simhash_brute
from test_text import base_brute
from tokenizers import Tokenizer

PIECES = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def rows():
    """A text of 3 MB, a copy of it, one with a single word of 200,000 letters, and short ones between."""
    rng = random.Random(14)
    word = lambda: rng.choice(WORDS) + rng.choice(WORDS) + rng.choice("abcdefgh")
    item = " ".join(word() for _ in range(30))
    long = " ".join(word() for _ in range(350_000)) + " " + C.TEMPLATES["MIT"] + " " + item
    single = "y" * 200_000 + " " + prose(rng, 60)
    return item, [(1, prose(rng, 100), "en", "s", 0), (2, long, "en", "s", 0), (3, long, "en", "s", 0), (4, single, "en", "s", 0), (5, prose(rng, 100), "en", "s", 0)]


def test_long_texts(spark, rows):
    item, rows = rows
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    size = {r[0]: len(r[1].encode()) for r in rows}
    by = lambda df: {r["doc_id"]: r for r in df.collect()}
    assert {(r["doc_id"], r["license_id"], r["containment"]) for r in C.license_scan(docs).collect()} == {(2, "MIT", 1.0), (3, "MIT", 1.0)}
    prints = by(S.simhash_near_dedup(docs))
    assert {i: (r["fingerprint"], r["component_id"]) for i, r in prints.items()} == {i: (p, c) for i, p, c in simhash_brute(rows)}
    bench = spark.createDataFrame([(9, item)], "item_id bigint, text string")
    assert {(r["doc_id"], r["item_id"], r["lcs_share"]) for r in D.decontaminate(docs, bench).collect()} == {(2, 9, 1.0), (3, 9, 1.0)}
    words, chars = by(substring_dedup(docs)), by(suffix_array_dedup(docs))
    assert words[3]["n_removed"] == words[3]["n_words"] > 350_000 and words[2]["n_removed"] == 0
    assert (chars[3]["n_removed"], chars[3]["n_spans"], chars[3]["n_bytes"]) == (size[3], 1, size[3]) and chars[2]["n_removed"] == 0 == chars[4]["n_removed"]
    library = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    ids = {r[0]: library.encode(r[1]) for r in rows}
    assert {i: (r["n_bytes"], r["n_tokens"], r["over_limit"]) for i, r in by(token_counts(docs, PIECES)).items()} == {i: (size[i], len(x), len(x) > 4096) for i, x in ids.items()}
    coded = by(sentencepieces.encode(docs, PIECES, digests=True))
    assert all(coded[i]["ids"] == x and coded[i]["round_trip"] for i, x in ids.items())
    judged = {r["row"]["doc_id"]: r for r in Q.judge(docs).collect()}
    assert all(tuple(judged[r[0]][c] for c in Q.COUNTS) == base_brute(r[1]) for r in rows)
    assert set(by(L.language_id(docs))) == {1, 2, 3, 4, 5}


def test_long_texts_in_the_store(spark, rows):
    _, rows = rows
    path = public_tokenizers.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    want = {r[0]: zlib.crc32(np.array([*library.encode(r[1], add_special_tokens=False).ids, 1], "<u4").tobytes()) for r in rows}
    assert {r["doc_id"]: r["ids_crc32"] for r in T.token_store(spark.createDataFrame(rows, SCHEMA), path).collect()} == want
