"""Language identification: averaged hashed subword embeddings and a linear softmax.

A text's subwords are the 3- and 4-byte grams of its words, lower-cased, with one
boundary on either side; digits, ASCII punctuation and white space are boundaries. Each gram is hashed to one of
``BUCKETS`` rows of an embedding table; a text is the mean of its rows, and a linear layer with
softmax names the language. Both are trained by stochastic gradient descent in numpy, on a
bounded sample; one fifth of the sample sets the softmax temperature and the rejection threshold.

For prediction the embedding and the linear layer are multiplied out to one logit row for a
bucket, so a whole text costs one table look-up and one sum for each gram and language.

Training sample: for every language there is, up to ``per_language`` rows, those with the smallest hash of doc_id, and no more
than ``sample`` rows for all languages together (but 8 for each, however many there are); only
rows with a language whose crc32(doc_id) modulo 5 is not 0. lang, source and doc_id are never features. All rows are
predicted, in one pass without a shuffle.

Defined cases: a null text or one without a letter is ``und`` with score 0 (so is any text if no
row has a language); of equal scores the alphabetically first language wins; a null doc_id is not
held out, never trained on, and predicted; repeated rows are predicted each; a text of any length is summed whole, in the
memory that its batch takes; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import ship
from . import kernel as K

BUCKETS, DIM, GRAMS, LEAST_STEPS = 1 << 15, 16, (3, 4), 300
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[:128] = 32
_FOLD[97:123] = _FOLD[65:91] = np.arange(97, 123)


def gram_buckets(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the subwords of several texts, one text after another, and how many each text has."""
    n, texts = len(data), len(offsets) - 1
    padded = np.full(n + texts + 1, 32, np.uint8)  # a boundary before each text and at the end
    where = np.repeat(np.arange(texts), np.diff(offsets))
    padded[np.arange(n) + where + 1] = _FOLD[data]
    word = padded != 32
    wide = padded.astype(np.uint32)
    starts = offsets[:-1] + np.arange(texts)
    out, of = [], []
    for size in GRAMS:
        m = len(padded) - size + 1
        if m <= 0:
            continue
        hashes, inner = np.zeros(m, np.uint32), word[1 : 1 + m].copy()
        for i in range(size):
            hashes = hashes * np.uint32(0x01000193) ^ wide[i : i + m]
        for i in range(2, size - 1):
            inner &= word[i : i + m]
        at = np.flatnonzero(inner)
        hashes = hashes[at] * np.uint32(0x9E3779B1)
        out.append((hashes >> np.uint32(32 - 15)).astype(np.int32))
        of.append(np.searchsorted(at, np.append(starts, len(padded))))
    if not out:
        return np.empty(0, np.int32), np.zeros(texts, np.int64)
    counts = [np.diff(o) for o in of]
    total = sum(counts)
    if len(out) == 1:
        return out[0], total
    begin = np.cumsum(total) - total
    both = np.empty(int(total.sum()), np.int32)
    for k, (buckets, count) in enumerate(zip(out, counts, strict=True)):
        shift = begin + (counts[0] if k else 0) - (np.cumsum(count) - count)
        both[np.arange(len(buckets)) + np.repeat(shift, count)] = buckets
    return both, total


@dataclass
class Model:
    """Languages (ascending), one logit row for each bucket, bias, temperature and rejection threshold."""

    languages: list[str]
    logits: np.ndarray
    bias: np.ndarray
    temperature: float = 1.0
    threshold: float = 0.0

    def scores(self, buckets: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Class probabilities of each text; rows without grams get the bias alone."""
        raw = np.empty((len(counts), len(self.languages)))
        begin = np.cumsum(counts) - counts
        for k in range(len(self.languages)):
            total = np.zeros(len(counts))
            has = counts > 0
            if has.any():
                total[has] = np.add.reduceat(self.logits[k][buckets], begin[has], dtype=np.float64)
            raw[:, k] = total / np.maximum(counts, 1) + self.bias[k]
        return _softmax(raw / self.temperature)


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def train(features: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, languages: list[str], epochs: int = 8, rate: float = 0.5, seed: int = 7) -> Model:
    """features: (bucket, count) arrays of each sampled text."""
    rng = np.random.default_rng(seed)
    kinds = len(languages)
    embedding = rng.normal(0, 0.3, (BUCKETS, DIM)).astype(np.float32)
    layer, bias = np.zeros((DIM, kinds), np.float32), np.zeros(kinds, np.float32)
    order = rng.permutation(len(labels))
    held = order[: len(order) // 5]
    order = order[len(order) // 5 :] if len(order) >= 5 else order
    batch = 64

    def rows(who: np.ndarray) -> np.ndarray:
        x = np.zeros((len(who), BUCKETS), np.float32)
        for i, w in enumerate(who):
            at, count = features[w]
            x[i, at] = count / max(1, count.sum())
        return x

    rounds = -(-len(order) // batch)
    epochs = max(epochs, -(-max(LEAST_STEPS, 8 * kinds) // max(1, rounds)))  # a small sample, and one of many classes, is read more often
    steps, done = max(1, epochs * rounds), 0
    for _ in range(epochs):
        rng.shuffle(order)
        for i in range(0, len(order), batch):
            who = order[i : i + batch]
            x = rows(who)
            mean = x @ embedding
            p = _softmax(mean @ layer + bias)
            p[np.arange(len(who)), labels[who]] -= 1
            p /= len(who)
            now = rate * 20 * (1 - done / steps)
            back = p @ layer.T
            layer -= now * (mean.T @ p).astype(np.float32)
            bias -= now * 0.05 * p.sum(axis=0).astype(np.float32)
            embedding -= now * 20 * (x.T @ back).astype(np.float32)
            done += 1
    model = Model(languages, np.ascontiguousarray((embedding @ layer).T), bias)
    if len(held):  # calibration on rows the descent did not see
        raw = np.concatenate([rows(held[i : i + batch]) @ model.logits.T for i in range(0, len(held), batch)]) + bias
        truth = labels[held]
        loss = {t: -np.log(np.maximum(_softmax(raw / t)[np.arange(len(held)), truth], 1e-12)).mean() for t in np.geomspace(0.05, 20, 60)}
        model.temperature = float(min(loss, key=loss.get))
        p = _softmax(raw / model.temperature)
        right = p.max(axis=1)[p.argmax(axis=1) == truth]
        model.threshold = float(np.quantile(right, 0.01)) if len(right) else 0.0
    return model


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = K.utf8(batch.column(2))
        buckets, counts = gram_buckets(data, offsets)
        ends, blocks = np.cumsum(counts), []
        for a, z in zip((ends - counts).tolist(), ends.tolist(), strict=True):
            at, n = np.unique(buckets[a:z], return_counts=True)
            blocks.append(K.pack(at, n))
        yield pa.record_batch([batch.column(0), batch.column(1), pa.array(blocks, pa.binary())], names=["draw", "lang", "block"])


def held_out(doc_id: Column) -> Column:
    """crc32 of the decimal text of doc_id modulo 5 is 0."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def training_rows(docs: DataFrame, per_language: int, sample: int) -> DataFrame:
    """(draw, lang, text) of the bounded sample: labelled rows of (doc_id, text, lang) that are not held out."""
    own = docs.where(F.col("doc_id").isNotNull() & F.col("text").isNotNull() & F.col("lang").isNotNull() & ~held_out(F.col("doc_id")))
    counts = own.groupBy("lang").count().collect()  # one row for each class, as the model itself has
    most = min(per_language, max(8, sample // max(1, len(counts))))
    # Rows that can be among the first are told by their draw alone, so that few texts move; the ranking then bounds them.
    share = F.create_map(*[x for r in counts for x in (F.lit(r["lang"]), F.lit(min(1.0, (1.5 * most + 50) / r["count"])))]) if counts else F.create_map(F.lit(""), F.lit(0.0))
    draw = F.pmod(F.xxhash64(F.col("doc_id"), F.lit("sample")), F.lit(1 << 30))
    drawn = own.select(draw.alias("draw"), "lang", "text").where(F.col("draw") < share[F.col("lang")] * (1 << 30))
    ranked = drawn.withColumn("place", F.row_number().over(Window.partitionBy("lang").orderBy("draw", F.xxhash64("text"))))
    return ranked.where(F.col("place") <= most).drop("place")


def fit(docs: DataFrame, per_language: int = 1000, sample: int = 400_000) -> Model:
    """A model of all languages of the labelled rows of (doc_id, text, lang) that are not held out."""
    ship(docs.sparkSession)
    rows = training_rows(docs, per_language, sample).mapInArrow(_features, "draw bigint, lang string, block binary").collect()
    if not rows:
        return Model([], np.zeros((0, BUCKETS), np.float32), np.zeros(0))
    rows.sort(key=lambda r: (r["draw"], r["lang"], bytes(r["block"])))
    languages = sorted({r["lang"] for r in rows})
    index = {name: i for i, name in enumerate(languages)}
    return train([tuple(K.unpack(bytes(r["block"]))) for r in rows], np.array([index[r["lang"]] for r in rows], np.int64), languages)


def _predict(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = K.utf8(batch.column(1))
            names, values, rejected = [], [], []
            letters = batch.column(2).to_pylist()
            for i, j in K.cuts(offsets, 1 << 20):
                p = model.scores(*gram_buckets(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])) if model.languages else None
                for k in range(i, j):
                    if p is None or not letters[k]:
                        names.append("und")
                        values.append(0.0)
                        rejected.append(True)
                    else:
                        best = int(p[k - i].argmax())
                        names.append(model.languages[best])
                        values.append(float(p[k - i, best]))
                        rejected.append(values[-1] < model.threshold)
            yield pa.record_batch([batch.column(0), batch.column(3), pa.array(names, pa.string()), pa.array(values, pa.float64()), pa.array(rejected, pa.bool_())], names=["doc_id", "held_out", "lang_pred", "score", "rejected"])

    return run


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, lang_pred, score, rejected (the score is below the calibrated threshold) of each row of (doc_id, text)."""
    ship(docs.sparkSession)
    letter = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))
    plain = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    plain = plain.select("doc_id", "text", letter.alias("letter"), held_out(F.col("doc_id")).alias("held_out"))
    return plain.mapInArrow(_predict(model), "doc_id bigint, held_out boolean, lang_pred string, score double, rejected boolean")


def language_id(docs: DataFrame, per_language: int = 1000, sample: int = 400_000) -> DataFrame:
    """Fits on the labelled rows and predicts all rows of (doc_id, text, lang)."""
    return predict(docs, fit(docs.select("doc_id", "text", "lang"), per_language, sample))
