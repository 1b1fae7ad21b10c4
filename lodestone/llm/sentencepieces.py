"""SentencePiece encoding and decoding by a batched Viterbi search in numpy.

Texts are cut into pre-tokens; new pre-tokens are grouped by length, and all words of one length advance together,
one character a step. Every substring up to the longest piece is hashed, the hashes probe the sorted piece keys, and
a maximum over the 16 possible last pieces stores the backpointers. What the maximum is taken of follows the model's kind:

* Unigram: the best total of the pieces' scores (of equal ones the longest last piece).
* BPE: a sequence is what the merges make of a text exactly if they leave each two neighbours of it apart, so
  of the pieces that can come last, one follows the best sequence before it so; that is the maximum. Whether the merges
  leave two pieces apart is worked out once for a pair, from the order in which their edges are merged.

Both give the ids of the library. Characters that no piece covers become byte pieces, so decode(encode(text)) is
the text, always.

Defined cases: a null or empty text has no ids and decodes to an empty text; repeated rows are encoded
each; a null doc_id stays null; an empty table gives no rows; null ids decode to an empty text; a long text is a list of
pre-tokens, and a long pre-token takes a step for each character.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from sentencepiece import sentencepiece_model_pb2

from ..session import ship
from . import kernel as K
from . import pretokens

TABLE, BATCH_CHARS, PAIRS = 400_000, 120_000, 1 << 19
NEVER = np.iinfo(np.int32).max
_PLACES = np.uint64((1 << 19) - 1)
_STEP = 0x9E3779B97F4A7C15 | 1
UNKNOWN_PENALTY = 10.0


class Viterbi:
    """The pieces of one model, their keys, and the ids of the pre-tokens met so far."""

    def __init__(self, path: str) -> None:
        model = pretokens.load(path)
        normal, scores, blobs, self.byte_id = {}, [], [], {}
        for i in range(model.get_piece_size()):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                self.byte_id[int(piece[3:5], 16)] = i
                blobs.append(bytes([int(piece[3:5], 16)]))
            elif model.is_unknown(i) or model.is_control(i) or model.is_unused(i):
                blobs.append(b"")
            else:
                normal[piece.replace("▁", " ")] = i
                scores.append(model.get_score(i))
                blobs.append(piece.replace("▁", " ").encode())
        self.longest = max(map(len, normal))
        self.unknown = min(scores) - UNKNOWN_PENALTY
        ids, scores = np.array(list(normal.values()), np.int32), np.array(scores)
        keys = np.empty(len(normal), np.uint64)
        for i, piece in enumerate(normal):
            codes = self._codes([piece])
            keys[i] = K.mix((codes * K.powers(_STEP, len(codes))).sum(dtype=np.uint64, keepdims=True))[0]
        order = np.argsort(keys)
        self.keys, self.ids, self.scores = keys[order], ids[order], scores[order]
        if len(self.keys) > 1 and (self.keys[1:] == self.keys[:-1]).any():
            raise ValueError("two pieces have one key")
        # A table by low bits: the rank of a key there (-1: none), and whether several keys share the place.
        at = (self.keys & _PLACES).astype(np.int64)
        self.place, self.crowded = np.full(int(_PLACES) + 1, -1, np.int32), np.bincount(at, minlength=int(_PLACES) + 1) > 1
        self.place[at] = np.arange(len(at))
        self.piece_bytes = np.frombuffer(b"".join(blobs), np.uint8)
        self.piece_size = np.array([len(b) for b in blobs], np.int64)
        self.piece_at = np.cumsum(self.piece_size) - self.piece_size
        proto = sentencepiece_model_pb2.ModelProto()
        proto.ParseFromString(model.serialized_model_proto())
        self.merges = proto.trainer_spec.model_type == proto.trainer_spec.BPE
        self.pairs, self.n_pairs = K.Slots(PAIRS if self.merges else 1), 0
        if self.merges:
            self._read_merges([p for p, _ in sorted(normal.items(), key=lambda e: (-model.get_score(e[1]), e[1]))], normal)
        self.forget()

    def _read_merges(self, pieces: list[str], ids: dict[str, int]) -> None:
        """For each piece (by its order of merging): how its edges come about, and which pieces the merges can make at all.

        ``edges[side]`` has for each id the ids that stand at its right (or left) end, characters first, and when each comes about.
        """
        order = {p: i for i, p in enumerate(pieces)}
        if any(c not in ids for p in pieces for c in p):
            raise ValueError("a character of a piece is no piece")
        top = max(ids.values()) + 1
        made: dict[str, tuple[str, str] | None] = {}
        for piece in pieces:
            parts, last = list(piece), None
            while len(parts) > 1:
                best, at = min((order.get(parts[i] + parts[i + 1], NEVER), i) for i in range(len(parts) - 1))
                if best == NEVER:
                    break
                last = parts[at], parts[at + 1]
                parts[at : at + 2] = ["".join(last)]
            if len(parts) == 1:
                made[piece] = last
        self.reached = np.zeros(top, bool)
        self.reached[[ids[p] for p in made]] = True
        self.when = np.full(top + 1, NEVER, np.int32)  # when a piece comes about; characters are there before all merges
        self.raw, self.chars = np.zeros(top, np.uint64), np.zeros(top, np.int64)
        longest = max(map(len, pieces))
        self.edges = np.full((2, top, longest + 1), top, np.int32)  # filled up with a place that never comes about
        for piece, i in ids.items():
            codes = self._codes([piece])
            self.raw[i], self.chars[i] = (codes * K.powers(_STEP, len(codes))).sum(dtype=np.uint64), len(piece)
            self.when[i] = -1 if len(piece) == 1 else order[piece]
        for side in (0, 1):
            for piece in made:
                chain, p = [ids[piece]], piece
                while made[p]:
                    p = made[p][1 - side]
                    chain.append(ids[p])
                self.edges[side, ids[piece], : len(chain)] = chain[::-1]

    def _apart(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        """Whether the merges leave each pair of pieces (ids) apart: no two pieces that meet at their seam are merged there before one is merged away."""
        out, open_ = np.zeros(len(first), bool), np.arange(len(first))
        i, j = np.zeros(len(first), np.int64), np.zeros(len(first), np.int64)
        while len(open_):
            own, other = first[open_], second[open_]
            a, b = self.edges[0, own, i], self.edges[1, other, j]
            next_a, next_b = self.when[self.edges[0, own, i + 1]], self.when[self.edges[1, other, j + 1]]
            rank = self._probe(K.mix(self.raw[a] + self.raw[b] * K.powers(_STEP, 2 * self.longest)[self.chars[a]]))
            seam = np.where(rank >= 0, self.when[self.ids[rank]], NEVER)
            at = np.maximum(seam, np.maximum(self.when[a], self.when[b]))
            merged = (seam < NEVER) & (at < next_a) & (at <= next_b)  # of two equal merges the left one comes first
            ended = ~merged & (next_a == NEVER) & (next_b == NEVER)
            out[open_[ended]] = True
            left = next_a <= next_b
            i, j = i + left, j + ~left
            on = ~(merged | ended)
            open_, i, j = open_[on], i[on], j[on]
        return out

    def _known_apart(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        """_apart() by a table of the pairs met so far."""
        keys = K.mix(first.astype(np.uint64) * np.uint64(1 << 32) + second.astype(np.uint64) + np.uint64(1))
        found = self.pairs.find(keys)
        lost = np.flatnonzero(found < 0)
        if len(lost):
            fresh, at, back = np.unique(keys[lost], return_index=True, return_inverse=True)
            value = self._apart(first[lost[at]], second[lost[at]]).astype(np.int32)
            if self.n_pairs + len(fresh) > PAIRS:
                self.pairs, self.n_pairs = K.Slots(PAIRS), 0
            for part in range(0, len(fresh), PAIRS):
                if part:
                    self.pairs = K.Slots(PAIRS)
                self.pairs.add(fresh[part : part + PAIRS], value[part : part + PAIRS])
            self.n_pairs += min(len(fresh), PAIRS)
            found[lost] = value[back]
        return found > 0

    @staticmethod
    def _codes(words: list[str]) -> np.ndarray:
        """A 64-bit value for each character. Pieces are held with a space for their space mark, so a mark in a text is unknown."""
        points = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)
        return K.mix(points.astype(np.uint64) + np.uint64(1)) | np.uint64(1)

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.pool, self.size, self.at = np.empty(0, np.int32), np.empty(0, np.int64), np.empty(0, np.int64)

    def _probe(self, keys: np.ndarray) -> np.ndarray:
        """Rank of each key among the pieces, or -1."""
        at = (keys & _PLACES).astype(np.int64)
        found = self.place[at]
        wrong = (found >= 0) & (self.keys[found] != keys)
        if wrong.any():
            who = np.nonzero(wrong)
            again = self.crowded[at[who]]
            found[who] = -1
            who = tuple(w[again] for w in who)
            asked = keys[who]
            rank = np.minimum(np.searchsorted(self.keys, asked), len(self.keys) - 1)
            found[who] = np.where(self.keys[rank] == asked, rank, -1)
        return found

    def _search(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids, one word after another, and their number for each of some words of one length. -1 - c: character c is unknown."""
        b, n = len(words), len(words[0])
        points = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64).reshape(b, n)
        codes = self._codes(words).reshape(b, n)
        w = self.longest
        score, ids = np.full((b, n, w), -np.inf), np.zeros((b, n, w), np.int32)
        total, step = np.zeros((b, n), np.uint64), K.powers(_STEP, w)
        for size in range(1, min(w, n) + 1):
            total = total[:, : n - size + 1] + codes[:, size - 1 :] * step[size - 1]
            rank = self._probe(K.mix(total))
            has = rank >= 0
            value, which = np.where(has, self.scores[rank], -np.inf), np.where(has, self.ids[rank], 0)
            if size == 1:
                value, which = np.where(has, value, self.unknown), np.where(has, which, -1 - points)
            score[:, size - 1 :, w - size] = value  # by the last character; the longest piece first
            ids[:, size - 1 :, w - size] = which
        back = self._backpointers(score, ids)
        out, count, left, t = np.zeros((b, n), np.int32), np.zeros(b, np.int64), np.full(b, n), 0
        while True:
            who = np.flatnonzero(left > 0)
            if not len(who):
                break
            choice = back[who, left[who] - 1]
            t += 1
            out[who, n - t] = ids[who, left[who] - 1, choice]
            count[who] += 1
            left[who] -= w - choice
        return out[np.arange(n) >= (n - count)[:, None]], count

    def _backpointers(self, score: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """For each place of each word which of the pieces that end there comes last; a score of -inf is no piece."""
        b, n, w = score.shape
        back, every = np.empty((b, n), np.int16), np.arange(b)
        if not self.merges:
            best = np.full((b, n + w), -np.inf)
            best[:, w - 1] = 0
            for end in range(n):
                candidates = best[:, end : end + w] + score[:, end]
                choice = candidates.argmax(axis=1)
                back[:, end] = choice
                best[:, end + w] = candidates[every, choice]
            return back
        last = np.full((b, n + w), -1, np.int64)  # the last piece of each beginning; none (-1) and unknown characters are met by any piece
        is_piece = (score > -np.inf) & ((ids < 0) | self.reached[np.maximum(ids, 0)])
        for end in range(n):
            fits = is_piece[:, end].copy()
            fits[:, : max(0, w - end - 1)] = False  # would begin before the word
            row, col = np.nonzero(fits)
            before, piece = last[row, end + col], ids[row, end, col].astype(np.int64)
            asked = np.flatnonzero((before >= 0) & (piece >= 0))
            ok = np.ones(len(row), bool)
            ok[asked] = self._known_apart(before[asked], piece[asked])
            fits[row, col] = ok
            choice = fits.argmax(axis=1)
            if not fits[every, choice].all():
                raise ValueError("the model's merges do not follow the order of its pieces")
            back[:, end] = choice
            last[:, end + w] = ids[every, end, choice]
        return back

    def _bytes_for_unknown(self, ids: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not (ids < 0).any():
            return ids, count
        lost = np.flatnonzero(ids < 0)
        raw = [np.array([self.byte_id[c] for c in chr(-1 - i).encode("utf-8", "surrogatepass")], np.int32) for i in ids[lost].tolist()]
        more = np.ones(len(ids), np.int64)
        more[lost] = [len(r) for r in raw]
        word, out = np.repeat(np.arange(len(count)), count), np.repeat(ids, more)
        out[np.repeat(ids < 0, more)] = np.concatenate(raw)
        return out, np.bincount(word, weights=more, minlength=len(count)).astype(np.int64)

    def learn(self, words: list[str]) -> None:
        """Adds the ids of new pre-token keys."""
        words = sorted(words, key=lambda k: len(pretokens.stretch(k)))
        marked = [pretokens.stretch(k) for k in words]
        pools, counts, i = [self.pool], [self.size], 0
        while i < len(words):
            n, j = len(marked[i]), i
            while j < len(words) and len(marked[j]) == n and (j - i) * n < BATCH_CHARS:
                j += 1
            ids, count = self._bytes_for_unknown(*self._search(marked[i:j]))
            pools.append(ids)
            counts.append(count)
            i = j
        self.known.update(zip(words, range(len(self.size), len(self.size) + len(words)), strict=True))
        self.pool, self.size = np.concatenate(pools), np.concatenate(counts).astype(np.int64)
        self.at = np.cumsum(self.size) - self.size

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the texts, one after another, and offsets."""
        parts = [pretokens.keys(t) for t in texts]
        new = set().union(*parts).difference(self.known) if parts else set()
        if len(new) + len(self.known) > TABLE:
            self.forget()
            new = set().union(*parts)
        if new:
            self.learn(list(new))
        lengths = np.array([len(p) for p in parts], np.int64)
        which = np.fromiter(map(self.known.__getitem__, chain.from_iterable(parts)), np.int64, int(lengths.sum()))
        size = self.size[which]
        ids = spans(self.pool, self.at[which], size)
        ends = np.concatenate([[0], np.cumsum(size)])[np.concatenate([[0], np.cumsum(lengths)])]
        return ids, ends

    def decode(self, ids: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of the texts, one after another, and offsets; the implied first space is dropped."""
        size = self.piece_size[ids]
        first = offsets[:-1][np.diff(offsets) > 0]
        skip = np.zeros(len(ids), np.int64)
        skip[first] = self.piece_bytes[self.piece_at[ids[first]]] == 32
        raw = spans(self.piece_bytes, self.piece_at[ids] + skip, size - skip)
        return raw, np.concatenate([[0], np.cumsum(size - skip)])[offsets]


def spans(values: np.ndarray, begin: np.ndarray, length: np.ndarray) -> np.ndarray:
    """values[b : b + n] of all spans, one after another."""
    return values[np.arange(int(length.sum())) + np.repeat(begin - (np.cumsum(length) - length), length)]


_models: dict[str, Viterbi] = {}


def viterbi(path: str) -> Viterbi:
    """The model of this Python worker."""
    if path not in _models:
        _models[path] = Viterbi(path)
    return _models[path]


def _encode(path: str, digests: bool, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = viterbi(path)
        for batch in batches:
            for i, j, texts in pretokens.texts(batch, 1, 2 << 20):
                ids, ends = model.encode(texts)
                names, columns = ["doc_id"], [batch.column(0).slice(i, j - i)]
                if digests:
                    raw, edges = model.decode(ids, ends)
                    raw, wide = raw.tobytes(), ids.astype("<u4").tobytes()
                    source = [t.encode("utf-8", "surrogatepass") for t in texts]
                    back = [raw[a:b] for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)]
                    names += ["n_bytes", "n_tokens", "ids_crc32", "decoded_sha256", "round_trip"]
                    columns += [
                        pa.array([len(s) for s in source], pa.int64()),
                        pa.array(np.diff(ends), pa.int64()),
                        pa.array([zlib.crc32(wide[4 * a : 4 * b]) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)], pa.int64()),
                        pa.array([hashlib.sha256(x).hexdigest() for x in back], pa.string()),
                        pa.array([x == y for x, y in zip(source, back, strict=True)], pa.bool_()),
                    ]
                if with_ids:
                    names.append("ids")
                    columns.append(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids, pa.int32())))
                yield pa.record_batch(columns, names=names)
        K.trim()

    return run


def _decode(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = viterbi(path)
        for batch in batches:
            lists = batch.column(1).fill_null([])
            ids = lists.flatten().to_numpy(zero_copy_only=False)
            ends = np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))]).astype(np.int64)
            raw, edges = model.decode(ids, ends)
            raw = raw.tobytes()
            yield pa.record_batch([batch.column(0), pa.array([raw[a:b].decode("utf-8", "replace") for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)], pa.string())], names=["doc_id", "text"])

    return run


DIGESTS = ", n_bytes bigint, n_tokens bigint, ids_crc32 bigint, decoded_sha256 string, round_trip boolean"


def encode(docs: DataFrame, model_path: str, digests: bool = False, with_ids: bool = True) -> DataFrame:
    """doc_id and ids (without begin or end) of each row of (doc_id, text).

    digests: also n_bytes, n_tokens, ids_crc32 (of little-endian 32-bit ids), and what decoding the ids
    gives: decoded_sha256 and round_trip (it is the text).
    """
    ship(docs.sparkSession)
    plain = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return plain.mapInArrow(_encode(model_path, digests, with_ids), "doc_id bigint" + DIGESTS * digests + ", ids array<int>" * with_ids)


def decode(encoded: DataFrame, model_path: str) -> DataFrame:
    """doc_id and text of each row of (doc_id, ids)."""
    ship(encoded.sparkSession)
    plain = encoded.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("ids").cast("array<int>").alias("ids"))
    return plain.mapInArrow(_decode(model_path), "doc_id bigint, text string")
