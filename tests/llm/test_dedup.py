"""Substring, suffix-array and SimHash dedup against brute force."""

import hashlib
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from corpora import SCHEMA, corpus, frame
from lodestone.llm import bwt, graph, kernel as K, simhash_dedup as S, substring_dedup as X, suffix_dedup as Z
from lodestone.llm.simhash_dedup import simhash_near_dedup
from lodestone.llm.substring_dedup import substring_dedup
from lodestone.llm.suffix_dedup import suffix_array_dedup, window_minima

BIG = 2**63


def rank(doc_id):
    return BIG if doc_id is None else doc_id


def windows_brute(rows, width):
    """Removed words of each row; rows with one doc_id don't see one another."""
    words = [re.findall(rb"[^\x20\x09-\x0D]+", (r[1] or "").encode()) for r in rows]
    least = {}
    for r, w in zip(rows, words, strict=True):
        for i in range(len(w) - width + 1):
            k = tuple(w[i : i + width])
            least[k] = min(least.get(k, BIG + 1), rank(r[0]))
    out = []
    for r, w in zip(rows, words, strict=True):
        gone, seen = [False] * len(w), set()
        for i in range(len(w) - width + 1):
            k = tuple(w[i : i + width])
            if least[k] < rank(r[0]) or k in seen:
                gone[i : i + width] = [True] * width
            seen.add(k)
        kept = b" ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out.append((r[0], len(w), sum(gone), hashlib.sha256(kept).hexdigest()))
    return out


def bytes_brute(rows, width):
    raws = [(r[1] or "").encode() for r in rows]
    least = {}
    for r, b in zip(rows, raws, strict=True):
        for i in range(len(b) - width + 1):
            k = b[i : i + width]
            least[k] = min(least.get(k, BIG + 1), rank(r[0]))
    out = []
    for r, b in zip(rows, raws, strict=True):
        gone = [False] * len(b)
        for i in range(len(b) - width + 1):
            if least[b[i : i + width]] < rank(r[0]):
                gone[i : i + width] = [True] * width
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        out.append((r[0], len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("seed", [3, 4, 6])
def test_substring_dedup(spark, seed):
    rows = corpus(seed)
    got = substring_dedup(frame(spark, rows), 20)
    assert Counter(tuple(r)[:4] for r in got.collect()) == Counter(windows_brute(rows, 20))


@pytest.mark.parametrize("seed", [3, 4, 6])
def test_suffix_array_dedup(spark, seed):
    rows = corpus(seed)
    got = suffix_array_dedup(frame(spark, rows), 50)
    assert Counter(tuple(r)[:5] for r in got.collect()) == Counter(bytes_brute(rows, 50))


def test_empty_tables(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert substring_dedup(none).count() == suffix_array_dedup(none).count() == simhash_near_dedup(none).count() == 0


def test_hot_anchors_go_as_single_windows(spark, monkeypatch):
    """A passage with another text around it in each document, among the odd rows, with every shared anchor hot, or some."""
    rng = np.random.default_rng(5)
    text = lambda n: "".join(chr(c) for c in rng.integers(97, 123, n))
    passage, rows = text(300), corpus(6, 30)
    rows += [(1000 + i, text(40 + i) + passage[i % 7 :] + text(30), "en", "s", 0) for i in range(60)]
    want = Counter(bytes_brute(rows, 50))
    shared = Z._shared_anchors

    def hotter(rows):  # by value, with the constant below
        Z.HOT = 40
        return shared(rows)

    for hot in (4096, 40):
        monkeypatch.setattr(Z, "HOT", hot)
        if hot == 40:
            monkeypatch.setattr(Z, "_shared_anchors", hotter)
        assert Counter(tuple(r)[:5] for r in suffix_array_dedup(frame(spark, rows), 50).collect()) == want
    keys = np.array([5, 9], np.uint64)
    block = lambda counts: K.pack(Z.planes(keys), K.narrow(np.array(counts)))
    answer = shared(pa.table({"bucket": pa.array([0, 0], pa.int32()), "pack": ["a", "b"], "block": [block([1, 61]), block([1, 60])]}))
    raw, flags = K.unpack(answer["block"][0].as_py())
    assert Z.from_planes(raw).tolist() == [5, 9] and np.unpackbits(flags, count=2).tolist() == [0, 1]


def test_slices_change_no_word(monkeypatch):
    rng = np.random.default_rng(9)
    texts = [bytes(rng.choice(np.frombuffer(b"abc \n\t", np.uint8), n)) for n in (0, 5, 300, 0, 2000)] + [b"x" * 500, b" " * 90, b"a" + b" " * 200 + b"b"]
    data, offsets = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)])
    whole = X.word_hashes(data, offsets)
    block = K.pack(np.arange(len(texts)), np.ones(len(texts), np.uint8), K.narrow(np.diff(offsets)), data, np.empty(0, np.uint8))
    kept = [b.to_pydict() for b in X._remove(3, True)("p", block, [])]
    assert np.diff(whole[1]).tolist() == [len(t.split()) for t in texts]
    for size in (1, 7, 64):
        monkeypatch.setattr(X, "SLICE", size)
        for a, b in zip(X.word_hashes(data, offsets), whole, strict=True):
            assert np.array_equal(a, b)
        assert [b.to_pydict() for b in X._remove(3, True)("p", block, [])] == kept


def test_slices_change_no_window(monkeypatch):
    rng = np.random.default_rng(8)
    texts = [bytes(rng.integers(97, 101, n, dtype=np.uint8)) for n in (0, 49, 50, 51, 2000, 0, 349, 1000, 7)]
    data, offsets = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)])

    def windows():
        begin, count, keys, docs = Z.segments(data, offsets, 50)
        return sorted((int(b) + k, int(key), int(d)) for b, n, key, d in zip(begin, count, keys, docs) for k in range(n))

    whole = windows()
    assert [(w, d) for w, _, d in whole] == [(int(offsets[d]) + k, d) for d, t in enumerate(texts) for k in range(len(t) - 49)]
    for size in (1, 64, 300):
        monkeypatch.setattr(Z, "SLICE", size)
        assert windows() == whole


def test_columns_are_files_of_any_store(tmp_path):
    for place in (str(tmp_path), f"file:{tmp_path}"):
        column = bwt.Column(place)
        for values in (np.arange(9, dtype=np.uint8), np.arange(3, dtype=np.uint32), np.empty(0, np.uint16)):
            column.write(values)
            assert np.array_equal(column.read(), values) and column.read().dtype == values.dtype
        column.close()
        assert not list(tmp_path.iterdir())


def test_bwt_of_random_collections(tmp_path):
    rng = np.random.default_rng(0)
    for trial in range(30):
        texts = [bytes(rng.integers(97, 99 + trial % 4, int(rng.integers(1, 40)), dtype=np.uint8)) for _ in range(int(rng.integers(1, 40)))]
        if trial == 7:
            texts = [b"\xff\xff", b"\xff", b"a\xff"]
        length = np.array([len(t) for t in texts])
        data, begin = np.frombuffer(b"".join(texts), np.uint8), np.cumsum(length) - length
        got, lcp = bwt.build(data, begin, length, str(tmp_path))
        order = sorted((t[len(t) - k :], i, k) for i, t in enumerate(texts) for k in range(len(t) + 1))
        stop = 65535 if got.dtype == np.uint16 else 255
        want = [texts[i][len(texts[i]) - k - 1] if k < len(texts[i]) else stop for _, i, k in order]
        assert got.tolist() == want
        shared = [0] + [next((n for n, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b))) for (a, _, _), (b, _, _) in zip(order, order[1:], strict=False)]
        assert lcp.tolist() == shared
        docs = rng.integers(0, 5, len(texts))
        least = {}
        for t, d in zip(texts, docs, strict=True):
            for i in range(len(t) - 4):
                least[t[i : i + 5]] = min(least.get(t[i : i + 5], 99), d)
        long = length >= 5
        if long.any():
            flat = window_minima(data, begin[long], length[long], docs[long], 5, str(tmp_path))
            assert flat.tolist() == [least[t[i : i + 5]] for t in texts if len(t) >= 5 for i in range(len(t) - 4)]


def simhash_brute(rows, distance=4, shingle=4):
    prints = []
    for r in rows:
        w = re.findall(rb"[^\x20\x09-\x0D]+", bytes(c + 32 if 65 <= c <= 90 else c for c in (r[1] or "").encode()))
        parts = [b" ".join(w[i : i + shingle]) for i in range(len(w) - shingle + 1)] if len(w) >= shingle else [b" ".join(w)] if w else []
        hashes = [xxhash.xxh64_intdigest(p, 42) for p in parts]
        prints.append(sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)))
    group = list(range(len(rows)))
    for _ in rows:
        for i, a in enumerate(prints):
            for j, b in enumerate(prints):
                if (a ^ b).bit_count() <= distance:
                    group[i] = group[j] = min(group[i], group[j])
    least = {}
    for r, g in zip(rows, group, strict=True):
        if r[0] is not None:
            least[g] = min(least.get(g, BIG), r[0])
    return [(r[0], f"{p:016x}", least.get(g)) for r, p, g in zip(rows, prints, group, strict=True)]


def test_simhash(spark):
    rows = corpus(5, 40)
    got = simhash_near_dedup(frame(spark, rows))
    assert Counter(map(tuple, got.collect())) == Counter(simhash_brute(rows))


def test_links_equal_brute_force_on_random_fingerprints(spark):
    rng = np.random.default_rng(1)
    base = rng.integers(0, 2**63, 300, dtype=np.uint64)
    near = [int(b) ^ sum(1 << int(k) for k in rng.choice(64, int(rng.integers(0, 9)), replace=False)) for b in base for _ in range(4)]
    fps = np.unique(np.array(near, np.uint64))
    for distance in (2, 4):
        nodes = spark.createDataFrame([(int(x),) for x in fps.view(np.int64)], "fp bigint").repartition(4)
        links = S.near_links(nodes, distance).collect()
        index = {int(x): i for i, x in enumerate(fps.view(np.int64))}
        got = K.components(len(fps), np.array([index[r["u"]] for r in links], int), np.array([index[r["v"]] for r in links], int))
        u, v = np.nonzero(np.triu(np.bitwise_count(fps[:, None] ^ fps[None, :]) <= distance, 1))
        want = K.components(len(fps), u, v)
        assert (np.bitwise_count(fps[[index[r["u"]] for r in links]] ^ fps[[index[r["v"]] for r in links]]) >= 0).all()
        pairs = {(a, b) for a, b in zip(got.tolist(), want.tolist(), strict=True)}
        assert len(pairs) == len(set(got.tolist())) == len(set(want.tolist()))


def test_large_groups_are_searched_like_small_ones(spark, monkeypatch):
    rng = np.random.default_rng(7)
    ball = [int(c) ^ sum(1 << int(k) for k in rng.choice(20, int(rng.integers(0, 8)), replace=False)) for c in rng.integers(0, 2**63, 6, dtype=np.uint64) for _ in range(400)]
    fps = np.unique(np.array([*ball, *rng.integers(0, 2**63, 500, dtype=np.uint64)], np.uint64))
    u, v = np.nonzero(np.triu(np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 4, 1))
    want = K.components(len(fps), u, v)
    a, b = S._search_large(fps, 4)
    assert (np.bitwise_count(a ^ b) <= 4).all() and len(a) == len(fps) - len(np.unique(want))
    assert K.components(len(fps), np.searchsorted(fps, a), np.searchsorted(fps, b)).tolist() == want.tolist()
    monkeypatch.setattr(S, "LARGE", 3)
    monkeypatch.setattr(S, "PAIR_BLOCK", 1000)
    table = S._links(4)
    nodes = spark.createDataFrame([(int(x),) for x in fps.view(np.int64)], "fp bigint")
    monkeypatch.setattr(S, "_links", lambda distance: table)
    index = {int(x): i for i, x in enumerate(fps.view(np.int64))}
    links = S.near_links(nodes, 4).collect()
    assert K.components(len(fps), np.array([index[r["u"]] for r in links]), np.array([index[r["v"]] for r in links])).tolist() == want.tolist()


def test_thresholds_keep_the_pigeonhole():
    rng = np.random.default_rng(2)
    fps = rng.integers(0, 2**63, 500, dtype=np.uint64)
    for parts in (2, 3, 4, 5):
        groups = S.bit_groups(np.eye(64) * 250 + 125, 500, parts)
        assert sorted(b for g in groups for b in g) == list(range(64))
        values = S.part_values(fps, groups)
        sketches = np.ones((parts, 2**S.SKETCH_BITS))
        radii = S.allot(values, [len(g) for g in groups], sketches, 500, 4)
        assert (radii.sum(axis=1) == 5).all() and radii.max() <= 3


def test_components(spark):
    rng = np.random.default_rng(3)
    u, v = rng.integers(0, 400, 300), rng.integers(0, 400, 300)
    chain = np.arange(1000, 1060)
    u, v = np.concatenate([u, chain[:-1], np.full(50, 5000)]), np.concatenate([v, chain[1:], np.arange(6000, 6050)])
    got = {r["node"]: r["root"] for r in graph.components(spark.createDataFrame(list(zip(u.tolist(), v.tolist(), strict=True)), "u bigint, v bigint")).collect()}
    want = K.components(7000, u, v)
    for x in set(u.tolist()) | set(v.tolist()):
        assert got.get(x, x) == want[x]
