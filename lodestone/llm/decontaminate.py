"""Benchmark decontamination: latent semantic retrieval, then common subsequences and answer checks.

1. Fit. Passages of 64 words become term vectors over 2**14 hashed words. One pass over all
   passages of the corpus counts the document frequencies and sums Y = A'A W for a random test
   matrix W; Y gives the leading right singular vectors of the TF-IDF matrix (a randomised SVD of
   its Gram matrix, single view). What a task sends has a fixed size.
2. Search. Every window of 16, 32, 64 words, one at every eighth word, is projected on the
   singular vectors but the first few (common words), divided by the singular values, and compared by cosine with the
   items (in blocks of at most ``BLOCK`` items): each item with windows of the size that fits it, longer
   items in parts. Windows above the threshold that no neighbour exceeds are candidates.
   Beside the threshold, whatever the cosine: a passage that reaches ``lcs`` lacks fewer words of the item than the item
   has keys (its rarest words, one more than may be missing), so the places where a key occurs give all such passages.
3. Verification. A candidate passage, as long as the whole item and placed by the offset of the part that was met, with
   room on both sides, must hold enough words of the item in any order; then the
   longest common subsequence of words must reach ``lcs`` of the item. If it does not reach
   ``sure``, the passage must also hold ``answer`` of the words of the item's answer, its last sentence, in order.

Words are runs of letters and digits, ASCII case folded. At scale: two passes over the texts and no
shuffle of them; the items are a stated query set, never a join: one pass meets up to ``PASS`` of them, in blocks of ``BLOCK``,
so what a pass sends to the tasks is bounded, and a larger benchmark takes more passes. The sums of the fit meet in a tree.
A text of any length is met in slices of its windows.

Defined cases: a null text or item, and one without a word, matches nothing; an item of under 4 words has no vector worth
comparing and matches where all its words stand one after another; of equal passages of a document the first is
reported; repeated rows and items are matched each; a null doc_id or item_id is reported as null; empty tables
give no rows; other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..session import materialize, ship, size_estimate
from . import kernel as K

TERMS, SKIP, RANK, TEST = 1 << 14, 8, 72, 80
PASSAGE, STEP, SIZES = 64, 8, (16, 32, 64)
SLICES, BLOCK, PASS, LEAST_WORDS = 16, 2048, 16 * 2048, 4
#: Scores of windows and item parts that are held at a time.
SCORES = 1 << 23
FAN = 64
#: Passages that are added at a time, as bits; terms that occur more often in them go through dense matrices, some at a time.
PASSAGE_BITS, RARE, DENSE = 11, 32, 256
_FOLD = np.arange(256, dtype=np.uint8)
for _c in range(128):
    _FOLD[_c] = ord(chr(_c).lower()) if chr(_c).isalnum() else 32


def words_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words and, for each text, the number of its first word (one more at the end)."""
    folded = _FOLD[data]
    starts, ends, first = K.word_spans(folded, offsets)
    return K.span_hashes(folded, starts, ends), first


def _terms(words: np.ndarray) -> np.ndarray:
    return (words >> np.uint64(50)).astype(np.uint16)


def _runs(first: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts of runs of up to ``size`` words, none across texts, and for each text its first run (one more at the end)."""
    count = -(-np.diff(first) // size)
    begin = np.concatenate([[0], np.cumsum(count)])
    return np.repeat(first[:-1], count) + (np.arange(begin[-1]) - np.repeat(begin[:-1], count)) * size, begin


def test_matrix() -> np.ndarray:
    return np.random.default_rng(11).standard_normal((TERMS, TEST)).astype(np.float32)


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of the passages of a task: Y and the document frequencies, in slices, and their number."""
    w, y, df, passages = test_matrix(), np.zeros((TERMS, TEST)), np.zeros(TERMS), 0
    for batch in batches:
        data, offsets = K.utf8(batch.column(0))
        for i, j in K.cuts(offsets, 1 << 19):
            words, first = words_of(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
            if not len(words):
                continue
            starts, _ = _runs(first, PASSAGE)
            terms, bounds = _terms(words), np.append(starts, len(words))
            passages += len(starts)
            for p in range(0, len(starts), 1 << PASSAGE_BITS):  # a text may be long
                begin = bounds[p : p + (1 << PASSAGE_BITS) + 1]
                _add_passages(y, df, w, terms[begin[0] : begin[-1]], begin - begin[0])
    size = TERMS // SLICES
    for s in range(SLICES):
        part = slice(s * size, (s + 1) * size)
        yield pa.record_batch([pa.array([s], pa.int32()), pa.array([y[part].astype(np.float32).tobytes()], pa.binary()), pa.array([df[part].tobytes()], pa.binary()), pa.array([passages if s == 0 else 0], pa.int64())], names=["slice", "y", "df", "passages"])


def _add_passages(y: np.ndarray, df: np.ndarray, w: np.ndarray, terms: np.ndarray, bounds: np.ndarray) -> None:
    """Adds passages, the words between ``bounds``, to y and df."""
    size = np.diff(bounds)
    sums = _sums_of_runs(w, terms, bounds[:-1], size)
    pairs = terms.astype(np.uint32) << np.uint32(PASSAGE_BITS) | np.repeat(np.arange(len(size), dtype=np.uint32), size)
    pairs.sort()
    term, passage = pairs >> np.uint32(PASSAGE_BITS), pairs & np.uint32((1 << PASSAGE_BITS) - 1)
    df += np.bincount(term[np.concatenate([[True], pairs[1:] != pairs[:-1]])], minlength=TERMS)
    heads = np.flatnonzero(np.concatenate([[True], term[1:] != term[:-1]]))
    count = np.diff(np.append(heads, len(term)))
    rare = count <= RARE
    y[term[heads[rare]]] += _sums_of_runs(sums, passage, heads[rare], count[rare])
    often, head, count = passage[np.repeat(~rare, count)], heads[~rare], count[~rare]
    begin = np.concatenate([[0], np.cumsum(count)])
    for a in range(0, len(head), DENSE):  # frequent terms: a dense matrix of how often each passage has each
        part = count[a : a + DENSE]
        cells = np.repeat(np.arange(len(part)) * len(size), part) + often[begin[a] : begin[a + len(part)]]
        y[term[head[a : a + DENSE]]] += np.bincount(cells, minlength=len(part) * len(size)).reshape(len(part), -1).astype(np.float32) @ sums


def _sums_of_runs(rows: np.ndarray, picks: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """For each run of ``picks``, none empty, the sum of the rows it picks: one place of all runs at a time, longest runs first."""
    order = np.argsort(-size, kind="stable")
    begin, size = begin[order], size[order]
    out = rows.take(picks[begin], axis=0)
    longer = np.searchsorted(-size, -np.arange(1, size.max(initial=1)))  # how many runs have a further place
    for i, n in enumerate(longer.tolist(), 1):
        out[:n] += rows.take(picks[begin[:n] + i], axis=0)
    back = np.empty_like(order)
    back[order] = np.arange(len(order))
    return out.take(back, axis=0)


def _add(rows: pa.Table) -> pa.Table:
    """The sums of some rows of one slice, one row after another. A task sends 32-bit sums, a group 64-bit ones."""
    y, df = np.zeros(TERMS // SLICES * TEST), np.zeros(TERMS // SLICES)
    for part, counts in zip(rows["y"], rows["df"], strict=True):
        raw = part.as_buffer()
        y += np.frombuffer(raw, np.float32 if raw.size == 4 * len(y) else np.float64)
        df += np.frombuffer(counts.as_buffer(), np.float64)
    own = [pa.array([rows[c][0].as_py()], pa.int32()) for c in ("slice", "group")]
    return pa.table([own[0], pa.array([y.tobytes()], pa.binary()), pa.array([df.tobytes()], pa.binary()), pa.array([int(np.sum(rows["passages"].to_numpy()))], pa.int64()), own[1]], names=["slice", "y", "df", "passages", "group"])


@dataclass
class Latent:
    """Term weights: a window's vector is the sum of the rows of its words. And how many passages have each term."""

    rows: np.ndarray
    df: np.ndarray

    def run_sums(self, terms: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Vectors of runs of up to STEP words."""
        return _sums_of_runs(self.rows, terms, starts, np.diff(np.append(starts, len(terms))))

    def units(self, sums: np.ndarray) -> np.ndarray:
        norm = np.sqrt(np.einsum("ij,ij->i", sums, sums))
        return sums / np.maximum(norm, 1e-9)[:, None].astype(sums.dtype)


def _tasks(docs: DataFrame) -> int:
    """How many tasks read ``docs``, by Spark's own estimate of its size."""
    return max(1, size_estimate(docs) >> 27)


def fit(docs: DataFrame) -> Latent:
    """The latent space of all passages of (text)."""
    ship(docs.sparkSession)
    kind = "slice int, y binary, df binary, passages bigint"
    parts = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(_sums, kind)
    parts, left = parts.withColumn("group", F.spark_partition_id()), _tasks(docs)
    while True:  # a tree: FAN sums meet in a group
        parts = parts.withColumn("group", F.floor(F.col("group") / FAN).cast("int")).groupBy("slice", "group").applyInArrow(_add, kind + ", group int")
        left = -(-left // FAN)
        if left <= FAN:
            break
    summed = parts.withColumn("group", F.lit(0)).groupBy("slice").applyInArrow(_add, kind + ", group int").collect()  # 16 rows, 10 MB
    y, df, passages = np.zeros((TERMS, TEST)), np.zeros(TERMS), 0
    size = TERMS // SLICES
    for r in summed:
        part = slice(r["slice"] * size, (r["slice"] + 1) * size)
        y[part] = np.frombuffer(r["y"], np.float64).reshape(size, TEST)
        df[part] = np.frombuffer(r["df"], np.float64)
        passages += r["passages"]
    idf = np.log((1 + passages) / (1 + df))
    gram = test_matrix().astype(np.float64).T @ y
    gram = (gram + gram.T) / 2
    values, vectors = np.linalg.eigh(gram)
    good = values > max(values.max(initial=0), 0) * 1e-10
    if not good.any():  # no passages
        return Latent(np.zeros((TERMS, RANK), np.float32), df)
    factor = (idf[:, None] * y) @ (vectors[:, good] / np.sqrt(values[good]))
    u, s, _ = np.linalg.svd(factor, full_matrices=False)
    k = int((s > s[0] * 1e-6).sum())
    skip = SKIP if k > 2 * SKIP else 0
    rows = np.zeros((TERMS, RANK), np.float32)
    rows[:, : min(RANK, k - skip)] = (idf[:, None] * u[:, skip:k] / s[skip:k] * s[0])[:, :RANK]
    return Latent(rows, df)


@dataclass
class Item:
    item_id: int | None
    words: np.ndarray
    answer: np.ndarray


def read_items(rows: list) -> list[Item]:
    """Items of (item_id, text) rows; the answer is the last sentence with a word."""
    out = []
    for r in rows:
        raw = (r["text"] or "").encode()
        words, _ = words_of(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
        sentences = [s for s in raw.replace(b"?", b".").replace(b"!", b".").split(b".") if words_of(np.frombuffer(s, np.uint8), np.array([0, len(s)]))[0].size]
        last = sentences[-1] if sentences else b""
        out.append(Item(r["item_id"], words, words_of(np.frombuffer(last, np.uint8), np.array([0, len(last)]))[0]))
    return [i for i in out if len(i.words)]


def common_subsequence(a: list[int], b: list[int]) -> int:
    """Length of the longest common subsequence, by bits of one integer for ``a``."""
    at: dict[int, int] = {}
    for i, x in enumerate(a):
        at[x] = at.get(x, 0) | 1 << i
    full = (1 << len(a)) - 1
    v = full
    for x in b:
        u = v & at.get(x, 0)
        if u:
            v = ((v + u) | (v - u)) & full
    return len(a) - v.bit_count()


def _targets(items: list[Item], latent: Latent) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each window size: unit vectors of the item parts of that size, their items, and their offsets in the items."""
    out: dict[int, tuple[list, list, list]] = {s: ([], [], []) for s in SIZES}
    for n, item in enumerate(items):
        if len(item.words) < LEAST_WORDS:
            continue
        size = next((s for s in SIZES if len(item.words) <= s), SIZES[-1])
        for a in range(0, max(1, len(item.words) - size // 2), size // 2) if len(item.words) > size else (0,):
            out[size][0].append(latent.rows[_terms(item.words[a : a + size])].sum(axis=0))
            out[size][1].append(n)
            out[size][2].append(a)
    return {s: (latent.units(np.array(v, np.float32)), np.array(n), np.array(a)) for s, (v, n, a) in out.items() if n}


def _keys(items: list[Item], df: np.ndarray, vocabulary: np.ndarray, lcs: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Items and offsets of their keys by place in the vocabulary, and for each place its first key (one more at the end)."""
    place, of, offset = [], [], []
    for n, item in enumerate(items):
        least = max(1, math.ceil(lcs * len(item.words) - 1e-9))
        rarest = np.argsort(df[_terms(item.words)], kind="stable")[: len(item.words) - least + 1]
        place.append(np.searchsorted(vocabulary, item.words[rarest]))
        of.append(np.full(len(rarest), n))
        offset.append(rarest)
    place, of, offset = (np.concatenate(x) for x in (place, of, offset))
    order = np.argsort(place, kind="stable")
    return of[order], offset[order], np.searchsorted(place[order], np.arange(len(vocabulary) + 2))


def _met(place: np.ndarray, first: np.ndarray, keys: tuple[np.ndarray, np.ndarray, np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(text, item, where the item would begin) of all places where a key of an item occurs, each once, some 2**18 keys at a time."""
    of, offset, begin = keys
    count = np.diff(begin)[place]
    at = np.flatnonzero(count)
    block = np.cumsum(count[at]) >> 18
    for part in np.split(at, np.flatnonzero(block[1:] != block[:-1]) + 1):
        own = count[part]
        key = np.repeat(begin[place[part]] - (np.cumsum(own) - own), own) + np.arange(int(own.sum()))
        where = np.repeat(part, own)
        text = np.searchsorted(first, where, side="right") - 1
        met = np.unique(np.stack([text, of[key], where - offset[key]], axis=1), axis=0)
        yield met[:, 0], met[:, 1], met[:, 2]


def _peaks(sums: np.ndarray, ends: np.ndarray, vectors: np.ndarray, latent: Latent, text: np.ndarray, cosine: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(window, item part, score) arrays, some thousands at a time, where the score reaches the threshold and no neighbouring window of the text exceeds it."""
    n, size = len(ends), max(1, SCORES // len(vectors))
    for a in range(0, n, size):
        lo, hi = max(0, a - 1), min(n, a + size + 1)  # with a neighbour on both sides
        scores = latent.units(sums[ends[lo:hi]] - sums[lo:hi]) @ vectors.T
        at, part = np.divmod(np.flatnonzero(scores[a - lo : min(n, a + size) - lo] >= cosine), len(vectors))
        at += a - lo
        here, own = scores[at, part], text[lo:hi]
        last, following = np.maximum(at - 1, 0), np.minimum(at + 1, len(own) - 1)
        top = ((own[last] != own[at]) | (scores[last, part] <= here)) & ((own[following] != own[at]) | (scores[following, part] <= here))
        at, part, here = at[top] + lo, part[top], here[top]
        for i in range(0, len(at), 1 << 13):
            yield at[i : i + (1 << 13)], part[i : i + (1 << 13)], here[i : i + (1 << 13)]


def _held(n: np.ndarray, lo: np.ndarray, hi: np.ndarray, place: np.ndarray, block: _Block) -> np.ndarray:
    """How many words of each passage, none empty, its item has, each at most as often as the item: no common subsequence is longer."""
    out, size, width = np.zeros(len(n), np.int64), hi - lo, len(block.vocabulary)
    group = np.cumsum(size) >> 20  # some 2**20 words at a time
    for part in np.split(np.arange(len(n)), np.flatnonzero(group[1:] != group[:-1]) + 1):
        own = size[part]
        begin = np.cumsum(own) - own
        at = np.repeat(lo[part] - begin, own) + np.arange(int(own.sum()))
        pair = np.repeat(n[part] * width, own) + place[at]
        known = block.holds.reshape(-1).take(pair)
        near = np.flatnonzero(np.add.reduceat(known, begin, dtype=np.int32) >= block.lcs * block.length[n[part]] - 1e-9)
        if not len(near):
            continue
        at = np.flatnonzero(known & np.repeat(np.isin(np.arange(len(part)), near), own))
        passage, pair = np.repeat(np.arange(len(part)), own)[at], pair[at]
        order = np.lexsort((pair, passage))
        passage, pair = passage[order], pair[order]
        heads = np.flatnonzero(np.concatenate([[True], (pair[1:] != pair[:-1]) | (passage[1:] != passage[:-1])]))
        count = np.diff(np.append(heads, len(pair)))
        most = block.times[np.searchsorted(block.pairs, pair[heads])]
        out[part] = np.bincount(passage[heads], np.minimum(count, most), minlength=len(part))
    return out


def _verify(found: dict, d: int, n: int, some: list[int], lists: list, answers: list, score: float, at: int, lcs: float, sure: float, answer: float) -> None:
    """Keeps the best verified passage of document d, the words of it that item n has, for item n."""
    share = common_subsequence(lists[n], some) / len(lists[n])
    if share < lcs:
        return
    held = common_subsequence(answers[n], some) / max(1, len(answers[n]))
    if share < sure and held < answer:
        return
    row = (share, held, score, at)
    if row[:3] > found.get((d, n), (0,))[:3]:
        found[d, n] = row


class _Block:
    """Some items, ready to be met: targets, words, and which words each has."""

    def __init__(self, latent: Latent, items: list[Item], lcs: float) -> None:
        self.latent, self.items, self.lcs = latent, items, lcs
        self.targets = _targets(items, latent)
        self.lists, self.answers = [i.words.tolist() for i in items], [i.answer.tolist() for i in items]
        self.length = np.array([len(x) for x in self.lists])
        self.vocabulary = np.unique(np.concatenate([i.words for i in items]))
        self.holds = np.zeros((len(items), len(self.vocabulary)), bool)
        pairs = np.concatenate([n * len(self.vocabulary) + np.searchsorted(self.vocabulary, item.words) for n, item in enumerate(items)])
        self.pairs, self.times = np.unique(pairs, return_counts=True)  # of items and their words, and how often each has each
        self.holds.reshape(-1)[self.pairs] = True
        self.keys = _keys(items, latent.df, self.vocabulary, lcs)
        self.units = latent.units(np.array([latent.rows[_terms(i.words)].sum(axis=0) for i in items], np.float32))

    def meet(self, found: dict, base: int, words: np.ndarray, first: np.ndarray, starts: np.ndarray, begin: np.ndarray, sums: np.ndarray, cosine: float, sure: float, answer: float) -> None:
        """Adds to ``found`` the items that some texts, numbered from ``base``, hold."""
        latent, lcs, length, holds, lists, answers = self.latent, self.lcs, self.length, self.holds, self.lists, self.answers
        text = np.repeat(np.arange(len(first) - 1), np.diff(begin))
        stop = begin[1:][text]
        place = np.minimum(np.searchsorted(self.vocabulary, words), len(self.vocabulary) - 1)
        shared = self.vocabulary[place] == words  # words that some item has; passages are judged by these alone
        inside, some = place[shared], words[shared]
        before = np.concatenate([[0], np.cumsum(shared)])
        place = np.where(shared, place, len(self.vocabulary))

        def near(n: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> Iterator[tuple[int, list[int]]]:
            """Passages that hold enough words of their item, and these words."""
            lo, hi = before[lo], before[hi]
            likely = np.flatnonzero((hi - lo >= lcs * length[n] - 1e-9) & (hi > lo))
            for c in likely[_held(n[likely], lo[likely], hi[likely], inside, self) / length[n[likely]] >= lcs].tolist():
                yield c, some[lo[c] : hi[c]][holds[n[c], inside[lo[c] : hi[c]]]].tolist()

        for size, (vectors, of, offset) in self.targets.items():
            ends = np.minimum(np.arange(len(starts)) + size // STEP, stop)
            for w, p, score in _peaks(sums, ends, vectors, latent, text, cosine):
                n, d = of[p], text[w]
                room = np.maximum(STEP, length[n] // 4)
                whole = starts[w] - offset[p]  # where the item begins if the window is its part
                lo = np.maximum(first[d], whole - room)
                hi = np.minimum(first[d + 1], np.maximum(starts[w] + size, whole + length[n]) + room)
                for c, known in near(n, lo, hi):
                    _verify(found, base + int(d[c]), int(n[c]), known, lists, answers, float(score[c]), int(starts[w[c]] - first[d[c]]), lcs, sure, answer)
        for d, n, whole in _met(place, first, self.keys):
            lo = np.maximum(first[d], whole - length[n] // 4)
            hi = np.minimum(first[d + 1], whole + length[n] + length[n] // 4)
            for c, known in near(n, lo, hi):
                if found.get((base + int(d[c]), int(n[c])), (0, 0))[:2] >= (1, 1):
                    continue
                score = float(latent.units(latent.rows[_terms(words[lo[c] : hi[c]])].sum(axis=0, keepdims=True))[0] @ self.units[n[c]])
                _verify(found, base + int(d[c]), int(n[c]), known, lists, answers, score, int(max(whole[c], first[d[c]]) - first[d[c]]), lcs, sure, answer)


def _search(latent: Latent, blocks: list[list[Item]], cosine: float, lcs: float, sure: float, answer: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ready = [_Block(latent, items, lcs) for items in blocks if items]
        for batch in batches:
            ids = batch.column(0).to_pylist()
            data, offsets = K.utf8(batch.column(1))
            found: list[dict[tuple[int, int], tuple]] = [{} for _ in ready]
            for i, j in K.cuts(offsets, 1 << 18):
                words, first = words_of(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                if not len(words) or not ready:
                    continue
                starts, begin = _runs(first, STEP)
                sums = np.zeros((len(starts) + 1, latent.rows.shape[1]), np.float32)
                np.cumsum(latent.run_sums(_terms(words), starts), axis=0, out=sums[1:])
                for block, own in zip(ready, found, strict=True):
                    block.meet(own, i, words, first, starts, begin, sums, cosine, sure, answer)
            rows = [(ids[d], block.items[n].item_id, *row) for block, own in zip(ready, found, strict=True) for (d, n), row in sorted(own.items())]
            cols = list(zip(*rows, strict=True)) or [()] * 6
            kinds = (pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64(), pa.int64())
            yield pa.record_batch([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["doc_id", "item_id", "lcs_share", "answer_share", "cosine", "at_word"])

    return run


RESULT = "doc_id bigint, item_id bigint, lcs_share double, answer_share double, cosine double, at_word bigint"


def decontaminate(docs: DataFrame, benchmark: DataFrame, cosine: float = 0.35, lcs: float = 0.7, sure: float = 0.9, answer: float = 0.5) -> DataFrame:
    """doc_id, item_id, lcs_share, answer_share, cosine, at_word of each document and item whose text it holds."""
    latent = fit(docs)
    plain = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out, held = plain.mapInArrow(_nothing, RESULT).limit(0), []
    rows = benchmark.select(F.col("item_id").cast("bigint").alias("item_id"), F.col("text").cast("string").alias("text")).toLocalIterator()
    for r in rows:
        held.append(r)
        if len(held) == PASS:  # a pass is run before the next items are drawn, so only its own are held
            out, held = out.unionByName(materialize(_pass(plain, latent, held, cosine, lcs, sure, answer))), []
    return out.unionByName(_pass(plain, latent, held, cosine, lcs, sure, answer)) if held else out


def _pass(plain: DataFrame, latent: Latent, rows: list, cosine: float, lcs: float, sure: float, answer: float) -> DataFrame:
    blocks = [read_items(rows[i : i + BLOCK]) for i in range(0, len(rows), BLOCK)]
    return plain.mapInArrow(_search(latent, blocks, cosine, lcs, sure, answer), RESULT)


def _nothing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for _ in batches:
        pass
    yield pa.RecordBatch.from_pylist([], schema=pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("lcs_share", pa.float64()), ("answer_share", pa.float64()), ("cosine", pa.float64()), ("at_word", pa.int64())]))
