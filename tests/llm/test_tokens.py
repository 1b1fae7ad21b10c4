"""Token counts, the token store and the Viterbi codec against the libraries."""

import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.parquet
import pytest
import sentencepiece
from corpora import SCHEMA, corpus, frame, key
from lodestone.llm import pretokens, sentencepieces, token_counts as counts, token_store as T
from lodestone.llm.token_counts import token_counts
from sentencepiece import sentencepiece_model_pb2
from tokenizers import Tokenizer

PIECES, WORDS = public_tokenizers.path("piece_bpe_32k.model"), public_tokenizers.path("word_bpe_49k.json")
ALPHABET = "ab  \n\t▁é{};)\r\n漢<s>🙂'x0\x00　ﬁAßÀ×÷ſİΣ9_|.,ll \x1c\x85\xa0́"


def noise(n, seed):
    rng = random.Random(seed)
    return ["".join(rng.choice(ALPHABET) for _ in range(rng.randint(0, 40))) for _ in range(n)] + ["<s>", "</s> a", " ", "  ", "\n", " \n ", "", "<|endoftext|>a", "a<|startoftext|> b", "don't we'll"]


def test_counts_are_the_library_s(spark):
    model = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    rows = corpus() + [(10_000 + i, t, None, None, 0) for i, t in enumerate(noise(2000, 1))]
    got = sorted(map(tuple, token_counts(frame(spark, rows), PIECES, 50).collect()), key=lambda r: (key(r[0]), r[1:]))
    want = sorted(((r[0], len((r[1] or "").encode()), n := len(model.encode(r[1] or "")), n > 50) for r in rows), key=lambda r: (key(r[0]), r[1:]))
    assert got == want
    assert token_counts(spark.createDataFrame([], SCHEMA), PIECES).count() == 0


def test_counts_over_many_packs(spark, monkeypatch):
    rows = corpus()
    want = sorted(map(tuple, token_counts(frame(spark, rows), PIECES, 50).collect()), key=str)
    for name, value in (("PACKS", 2), ("BATCH", 7), ("PACK_BYTES", 3000), ("BUCKET_BYTES", 900)):
        monkeypatch.setattr(counts, name, value)
    assert sorted(map(tuple, token_counts(frame(spark, rows), PIECES, 50).collect()), key=str) == want


@pytest.fixture(scope="module")
def unigram(tmp_path_factory):
    """The model with its pieces declared a unigram model, so that the library searches as we do."""
    proto = sentencepiece_model_pb2.ModelProto()
    proto.ParseFromString(open(PIECES, "rb").read())
    proto.trainer_spec.model_type = 1
    for piece in proto.pieces:
        piece.score = max(piece.score, -40_000.0)  # the library adds 32-bit floats, which 1e9 would swallow
    path = tmp_path_factory.mktemp("m") / "unigram.model"
    path.write_bytes(proto.SerializeToString())
    return str(path)


def test_viterbi_is_the_library_s_unigram_search(unigram):
    library, ours = sentencepiece.SentencePieceProcessor(model_file=unigram), sentencepieces.Viterbi(unigram)
    texts = [t for t in noise(5000, 2) + [r[1] or "" for r in corpus()] if "▁" not in t]
    ids, ends = ours.encode(texts)
    for i, t in enumerate(texts):
        assert ids[ends[i] : ends[i + 1]].tolist() == library.encode(t), t


def test_viterbi_is_brute_force(unigram):
    v = sentencepieces.Viterbi(unigram)
    model = pretokens.load(unigram)
    score = {model.id_to_piece(i).replace("▁", " "): model.get_score(i) for i in range(259, model.get_piece_size())}
    for word in ["hello", "teouheth", "abé", "thetheofthe", "a"]:
        text = " " + word
        best = [0.0] + [-np.inf] * len(text)
        for j in range(1, len(text) + 1):
            best[j] = max(best[i] + score.get(text[i:j], v.unknown if j == i + 1 else -np.inf) for i in range(max(0, j - 16), j))
        ids, _ = v.encode([word])
        assert sum(model.get_score(int(i)) for i in ids) == best[-1]


def test_viterbi_is_the_library_s_merging(sf):
    """The bundled BPE model: ids of all texts of the table, of joined pieces, of few letters, and of noise."""
    library, ours = sentencepiece.SentencePieceProcessor(model_file=PIECES), sentencepieces.viterbi(PIECES)
    rng, pieces = random.Random(1), [library.id_to_piece(i).replace("▁", " ") for i in range(259, library.get_piece_size())]
    texts = ["".join(rng.choice(pieces) for _ in range(rng.randint(1, 6))) for _ in range(20_000)]
    texts += ["".join(rng.choice("etaoinshr") for _ in range(rng.randint(1, 25))) for _ in range(20_000)] + ["x" * 3000, "ab" * 1000, "a " * 500, "=" * 777]
    texts += [t for t in noise(5000, 2) + [r[1] or "" for r in corpus()] + pa.parquet.read_table(f"{sf}/documents.parquet")["text"].to_pylist() if t and "▁" not in t]
    ids, ends = ours.encode(texts)
    for i, want in enumerate(library.encode(texts, num_threads=1)):
        assert ids[ends[i] : ends[i + 1]].tolist() == want, texts[i]


def test_pairs_beyond_the_table(monkeypatch):
    monkeypatch.setattr(sentencepieces, "PAIRS", 50)
    ours, texts = sentencepieces.Viterbi(PIECES), noise(300, 5)
    ids, _ = ours.encode(texts)
    assert ids.tolist() == sentencepieces.viterbi(PIECES).encode(texts)[0].tolist()


def test_round_trip(spark):
    rows = corpus() + [(10_000 + i, t, None, None, 0) for i, t in enumerate(noise(2000, 3))]
    both = sentencepieces.encode(frame(spark, rows), PIECES, digests=True)
    got = both.collect()
    assert all(r["round_trip"] for r in got) and len(got) == len(rows)
    assert all(r["n_tokens"] == len(r["ids"]) and r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes()) for r in got)
    back = sentencepieces.decode(both, PIECES).collect()
    assert sorted((key(r["doc_id"]), r["text"]) for r in back) == sorted((key(r[0]), r[1] or "") for r in rows)
    assert sentencepieces.encode(spark.createDataFrame([], SCHEMA), PIECES).count() == 0


def test_word_encoder():
    library, ours = Tokenizer.from_file(WORDS), T.WordEncoder(WORDS)
    texts = noise(5000, 4) + [r[1] or "" for r in corpus()]
    ids, ends = ours.encode(texts, 1)
    for i, e in enumerate(library.encode_batch_fast(texts, add_special_tokens=False)):
        assert ids[ends[i] : ends[i + 1]].tolist() == [*e.ids, 1], texts[i]


def test_store(spark, tmp_path):
    rows = corpus()
    folder = str(tmp_path / "store")
    T.write_store(frame(spark, rows), WORDS, folder, docs_per_part=20)
    got = sorted(map(tuple, T.read_store(spark, folder).collect()), key=lambda r: r[1])
    library = Tokenizer.from_file(WORDS)
    ids = {t: [*library.encode(t, add_special_tokens=False).ids, 1] for t in {r[1] or "" for r in rows}}
    want = sorted((key(r[0]), zlib.crc32(np.array(ids[r[1] or ""], "<u4").tobytes()), len(ids[r[1] or ""])) for r in rows)
    assert [(key(d), n) for d, _, n, _ in got] == [(d, n) for d, _, n in want] and sorted((key(d), c) for d, _, _, c in got) == sorted((d, c) for d, c, _ in want)
    start = 0
    for _, s, n, _ in got:
        assert s == start
        start += n
    lists = {(r["doc_id"], r["start"]): r["ids"] for r in T.load_ids(spark, folder).collect()}
    assert all(zlib.crc32(np.array(lists[d, s], "<u4").tobytes()) == c for d, s, _, c in got)
    assert T.token_store(spark.createDataFrame([], SCHEMA), WORDS).count() == 0


def test_store_finds_damage(spark, tmp_path):
    folder = str(tmp_path / "store")
    T.write_store(frame(spark, corpus()), WORDS, folder)
    recipes = T.read_recipes(spark, folder)
    changed = recipes.selectExpr("part", "doc_id", "start", "n_tokens + 1 as n_tokens", "digests", "root").collect()
    spark.createDataFrame(changed, recipes.schema).write.mode("overwrite").parquet(f"{folder}/recipes")
    with pytest.raises(Exception, match="damaged"):
        T.read_store(spark, folder).collect()


def test_cuts_and_checksums():
    rng = np.random.default_rng(0)
    ids, ends = rng.integers(0, 5, 50_000).astype(np.uint32), np.array([0, 10, 10_000, 10_001, 50_000])
    last = T.cut(ids, ends)
    assert set(ends[1:]) <= set(last.tolist()) and np.diff(last, prepend=0).max() <= T.MAX_CHUNK and (np.diff(last, prepend=0) > 0).all()
    for n in (0, 1, 3, 70_000, 1 << 20):
        a, b = b"some bytes", bytes(n)
        assert int(T.shift_crc(np.array([zlib.crc32(a)]), np.array([n]))[0]) ^ zlib.crc32(b) == zlib.crc32(a + b)
    assert T.merkle([]) != T.merkle([b"x" * 16]) == b"x" * 16
