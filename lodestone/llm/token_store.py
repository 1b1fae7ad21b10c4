"""Token ids in a content-addressed store of chunks, with document recipes and Merkle manifests.

Write: texts become ids; a rolling hash over the last ids cuts each document's stream where its low bits are zero, so equal
passages give equal chunks. Chunks go to the bucket of their digest, where each is kept
once; documents go along as recipes (their chunk digests). Recipes are then laid out in
ascending doc_id order, a range of them in each part, and each part gets a manifest.

Format (a folder)::

    data/set=chunks/  bucket, block   digests (16 bytes each), sizes, ids of the unique chunks of a bucket
    recipes/          part, doc_id, start (ids before it in its part), n_tokens, digests, root   ascending by part, doc_id
    manifest/         part, before (ids of all parts before it), first_doc, last_doc, n_docs, n_tokens, root

A document's root is the Merkle root of its chunk digests, a part's that of its documents' roots.

Read: every chunk block is read back, each chunk is hashed again and compared with its
digest; recipes meet the chunks by digest; the checksum of a document is put together from those of its
chunks (a CRC of a concatenation is a linear function of theirs), so ids are not moved a second
time. Roots are worked out anew and compared with the manifests. ``load_ids`` rebuilds id lists.

At scale: ids are shuffled once, compressed, before they are stored; hot chunks are
collapsed by the task that cuts them. Parts and buckets grow in number with the corpus, without a limit, so their sizes stay.
Recipes are range-partitioned once; any number of rows with one doc_id, or with none, is split over parts. A manifest is made of roots alone.

Defined cases: a null or empty text holds the end id alone; rows that repeat a doc_id are stored each, by
(doc_id, recipe); a null doc_id comes after all others; a long text is cut into chunks of ``MAX_CHUNK`` ids at most, and its recipe has
16 bytes for each; an empty table gives an empty store. Other columns are not read.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F
from tokenizers import Tokenizer, pre_tokenizers

from ..session import remove, shared_dir, ship
from . import kernel as K
from .sentencepieces import spans

TABLE = 1_000_000
SPAN, CUT_BITS, MAX_CHUNK = 16, 9, 4096
FLUSH_IDS = 3_000_000
# Texts of white space, ASCII without the apostrophe and "<|", and Latin-1 letters are lower-cased and cut
# into runs in numpy: letters, single digits, others. That is the tokenizer's own rule on such
# texts. In other texts the words that are not of this kind go to the library whole.
_PLAIN = bytes(c for c in range(256) if 9 <= c <= 13 or 32 <= c <= 126 and c != 39 or c >= 192 and c not in (215, 247))
_RUN = re.compile(r"[a-zß-öø-ÿ]+|[0-9]|[^a-z0-9ß-öø-ÿ\t-\r ]+")
_WHITE = re.compile(r"[\t-\r ]+")
_LETTER, _DIGIT, _OTHER, _GAP = 1, 2, 3, 0
_KIND = np.full(256, _OTHER, np.uint8)
_KIND[K.SPACE] = _GAP
_KIND[48:58] = _DIGIT
_KIND[65:91] = _KIND[97:123] = _KIND[128:] = _LETTER
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Bytes that no plain text holds; 195 leads the Latin-1 letters.
_STRANGE = np.ones(256, bool)
_STRANGE[[*range(9, 14), *range(32, 39), *range(40, 127), *range(128, 192), 195]] = False


def _is_plain(text: str) -> bool:
    try:
        return not text.encode("latin-1").translate(None, _PLAIN) and "<|" not in text
    except UnicodeEncodeError:
        return False


def plain_runs(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(whether each text is plain, lower-cased bytes, starts and ends of runs, each text's first run and one more)."""
    n, texts = len(data), len(offsets) - 1
    if not n:
        none = np.empty(0, np.int64)
        return np.ones(texts, bool), data, none, none, np.zeros(texts + 1, np.int64)
    led = np.zeros(n, bool)
    led[1:] = data[:-1] == 195
    tail = (data >= 128) & (data < 192)
    strange = _STRANGE[data] | (tail & ~led) | (led & ((data == 151) | (data == 183)))
    strange[1:] |= (data[1:] == 124) & (data[:-1] == 60)
    at = np.searchsorted(np.flatnonzero(strange), offsets)
    plain = at[1:] == at[:-1]
    low = _LOWER[data]
    low[led & (data < 159)] += 32
    kind = _KIND[data]
    first = np.zeros(n, bool)
    first[offsets[:-1][offsets[:-1] < n]] = True
    new = first.copy()
    new[0] = True
    new[1:] |= (kind[1:] != kind[:-1]) | (kind[1:] == _DIGIT)
    begin = np.flatnonzero(new)
    end = np.append(begin[1:], n)
    held = kind[begin] != _GAP
    begin, end = begin[held], end[held]
    return plain, low, begin, end, np.searchsorted(begin, offsets)


class WordEncoder:
    """Ids of texts for a tokenizer whose tokens never span white space, by a table of runs (and odd words), by 64-bit hash."""

    def __init__(self, path: str) -> None:
        self.library = Tokenizer.from_file(path)
        self.runs = Tokenizer(self.library.model)  # takes runs, one a line, without normalising them again
        self.runs.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.Split("\n", "removed"), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        self.ends = np.zeros(self.library.get_vocab_size() + 1, bool)
        self.ends[[i for t, i in self.library.get_vocab().items() if t.endswith("</w>")]] = True
        self.forget()

    def forget(self) -> None:
        self.known = K.Slots(2 * TABLE)
        self.pool, self.size, self.at = np.empty(0, np.uint32), np.empty(0, np.int64), np.empty(0, np.int64)

    @staticmethod
    def keys(text: str) -> list[str]:
        """Runs and odd words of any text."""
        return [r for w in _WHITE.split(text) if w for r in (_RUN.findall(w.lower()) if _is_plain(w) else (w,))]

    def _learn(self, new: list[str], odd: bool) -> None:
        """Ids of keys, to the end of the pool. Runs go many at a time; the last id of each has the word-end mark."""
        pools, sizes = [self.pool], [self.size]
        if odd:
            lists = [e.ids for e in self.library.encode_batch_fast(new, add_special_tokens=False)]
            pools.append(np.array([x for part in lists for x in part], np.uint32))
            sizes.append(np.array([len(x) for x in lists], np.int64))
        else:
            for i in range(0, len(new), 1000):
                some = new[i : i + 1000]
                ids = np.array(self.runs.encode_batch_fast(["\n".join(some)], add_special_tokens=False)[0].ids, np.uint32)
                size = np.diff(np.flatnonzero(self.ends[ids]), prepend=-1)
                if len(size) != len(some):
                    raise ValueError("a run is not one word of the tokenizer")
                pools.append(ids)
                sizes.append(size)
        self.pool, self.size = np.concatenate(pools), np.concatenate(sizes)
        self.at = np.cumsum(self.size) - self.size

    def _numbers(self, low: np.ndarray, begin: np.ndarray, end: np.ndarray, odd: bool) -> np.ndarray:
        """Numbers of the keys low[begin:end], learning new ones. Odd words have hashes of their own."""
        hashes = K.span_hashes(low, begin, end)
        hashes = (~hashes if odd else hashes) | np.uint64(1)
        out = self.known.find(hashes)
        lost = np.flatnonzero(out < 0)
        if len(lost):
            fresh, first, back = np.unique(hashes[lost], return_index=True, return_inverse=True)
            raw, at = low.tobytes(), lost[first]
            base = len(self.size)
            self._learn([raw[a:z].decode() for a, z in zip(begin[at].tolist(), end[at].tolist(), strict=True)], odd)
            numbers = np.arange(base, base + len(fresh), dtype=np.int32)
            self.known.add(fresh, numbers)
            out[lost] = numbers[back]
        return out

    def encode_bytes(self, data: np.ndarray, offsets: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of UTF-8 texts with the end id after each, and offsets."""
        texts = len(offsets) - 1
        if len(self.size) > TABLE:
            self.forget()
        plain, low, begin, end, first = plain_runs(data, offsets)
        count = np.where(plain, np.diff(first), 0)
        if not plain.all():
            own = np.repeat(plain, np.diff(first))
            begin, end = begin[own], end[own]
        which = self._numbers(low, begin, end, False)
        if not plain.all():
            raw = data.tobytes()
            some = np.flatnonzero(~plain)
            parts = [self.keys(raw[offsets[i] : offsets[i + 1]].decode()) for i in some.tolist()]
            flat = [k for p in parts for k in p]
            blobs = [k.encode() for k in flat]
            sizes = np.array([len(x) for x in blobs], np.int64)
            stop = np.cumsum(sizes)
            joined = np.frombuffer(b"".join(blobs), np.uint8)
            odd = np.array([not _is_plain(k) for k in flat], bool)
            more = np.empty(len(flat), np.int32)
            for kind in (False, True):
                who = np.flatnonzero(odd == kind)
                more[who] = self._numbers(joined, (stop - sizes)[who], stop[who], kind)
            at = np.cumsum(count) - count  # where each text's keys lie in the two lists put together
            lengths = np.array([len(p) for p in parts], np.int64)
            at[some], count[some] = len(which) + np.cumsum(lengths) - lengths, lengths
            which = spans(np.concatenate([which, more]), at, count)
        size = self.size[which]
        ends = np.concatenate([[0], np.cumsum(size)])[np.concatenate([[0], np.cumsum(count)])]
        out = np.full(int(size.sum()) + texts, end_id, np.uint32)
        keep = np.ones(len(out), bool)
        keep[ends[1:] + np.arange(texts)] = False
        out[keep] = spans(self.pool, self.at[which], size)
        return out, ends + np.arange(texts + 1)

    def encode(self, texts: list[str], end_id: int) -> tuple[np.ndarray, np.ndarray]:
        data, offsets = K.utf8(pa.array(texts, pa.large_string()))
        return self.encode_bytes(data, offsets, end_id)


_encoders: dict[str, WordEncoder] = {}


#: A 64-bit value for each id (ids beyond share them).
_CODES = K.mix(np.arange(1, (1 << 16) + 1, dtype=np.uint64))


def cut(ids: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Chunk ends of streams: where a hash of the last SPAN ids says so, at MAX_CHUNK, and at the stream's end."""
    hashes = K.rolling(_CODES[ids & np.uint32(len(_CODES) - 1)], SPAN)
    here = np.flatnonzero((hashes & np.uint64((1 << CUT_BITS) - 1)) == 0) + SPAN
    begin = ends[np.searchsorted(ends, here - 1, "right") - 1]
    here = np.union1d(here[here - begin >= SPAN], ends[1:])  # only windows inside one stream count
    gap = np.diff(here, prepend=0)
    extra = [np.arange(h - g + MAX_CHUNK, h, MAX_CHUNK) for h, g in zip(here[gap > MAX_CHUNK].tolist(), gap[gap > MAX_CHUNK].tolist(), strict=True)]
    return np.union1d(here, np.concatenate(extra)) if extra else here


def merkle(digests: list[bytes]) -> bytes:
    """Root of a Merkle tree; an odd node is carried up; the root of nothing is the digest of nothing."""
    if not digests:
        return hashlib.blake2b(b"", digest_size=16).digest()
    while len(digests) > 1:
        digests = [hashlib.blake2b(b"\x01" + digests[i] + digests[i + 1], digest_size=16).digest() if i + 1 < len(digests) else digests[i] for i in range(0, len(digests), 2)]
    return digests[0]


def _digests(raw: np.ndarray) -> list[bytes]:
    return [raw[i : i + 16].tobytes() for i in range(0, len(raw), 16)]


SENT = "bucket int, doc_id bigint, n_tokens bigint, block binary"


def _write(path: str, end_id: int, buckets: int):
    """Rows of chunks (doc_id null, n_tokens null) and of recipes (n_tokens not null)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if path not in _encoders:
            _encoders[path] = WordEncoder(path)
        encoder = _encoders[path]
        held: dict[bytes, np.ndarray] = {}
        size = 0

        def flush() -> pa.RecordBatch:
            names = sorted(held, key=lambda d: (int.from_bytes(d[:4], "big") % buckets, d))
            to = np.array([int.from_bytes(d[:4], "big") % buckets for d in names])
            edges, blocks = np.searchsorted(to, np.arange(buckets + 1)), []
            for b in np.flatnonzero(np.diff(edges)):
                some = names[edges[b] : edges[b + 1]]
                chunks = [held[d] for d in some]
                blocks.append((int(b), K.pack(np.frombuffer(b"".join(some), np.uint8), K.narrow(np.array([len(c) for c in chunks])), K.narrow(np.concatenate(chunks)))))
            none = pa.nulls(len(blocks), pa.int64())
            return pa.record_batch([pa.array([b for b, _ in blocks], pa.int32()), none, none, pa.array([x for _, x in blocks], pa.binary())], names=["bucket", "doc_id", "n_tokens", "block"])

        for batch in batches:
            data, offsets = K.utf8(batch.column(1))
            for i, j in K.cuts(offsets, 1 << 20):
                ids, ends = encoder.encode_bytes(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], end_id)
                last = cut(ids, ends)
                wide = ids.astype("<u4")
                raw = wide.tobytes()
                recipe = []
                for a, z in zip(np.concatenate([[0], last[:-1]]).tolist(), last.tolist(), strict=True):
                    d = hashlib.blake2b(raw[4 * a : 4 * z], digest_size=16).digest()
                    recipe.append(d)
                    if d not in held:
                        held[d] = ids[a:z].copy()
                        size += z - a
                at = np.searchsorted(last, ends, "left") + 1
                at[0] = 0
                lists = [b"".join(recipe[a:z]) for a, z in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
                spread = pa.array([int.from_bytes(r[-4:], "big") % buckets for r in lists], pa.int32())
                yield pa.record_batch([spread, batch.column(0).slice(i, j - i), pa.array(np.diff(ends), pa.int64()), pa.array(lists, pa.binary())], names=["bucket", "doc_id", "n_tokens", "block"])
                if size >= FLUSH_IDS:
                    yield flush()
                    held, size = {}, 0
        if held:
            yield flush()

    return run


def _unique(rows: pa.Table) -> pa.Table:
    """Of one bucket: its recipes as they are, and one block with each of its chunks once."""
    known = np.asarray(rows["n_tokens"].is_valid())
    recipes = rows.filter(pa.array(known)).select(["bucket", "doc_id", "n_tokens", "block"])
    blocks = [K.unpack(block.as_py()) for block in rows.filter(pa.array(~known))["block"]]
    if not blocks:
        return recipes
    names = np.concatenate([raw for raw, _, _ in blocks]).reshape(-1, 16)
    size = np.concatenate([sizes.astype(np.int64) for _, sizes, _ in blocks])
    ids = np.concatenate([ids for _, _, ids in blocks])
    order = np.lexsort(np.ascontiguousarray(names).view(">u8").T[::-1])
    new = np.append(True, (names[order[1:]] != names[order[:-1]]).any(axis=1))
    order = order[new]
    block = K.pack(names[order].reshape(-1), K.narrow(size[order]), K.narrow(spans(ids, (np.cumsum(size) - size)[order], size[order])))
    chunk = pa.table([pa.array([rows["bucket"][0].as_py()], pa.int32()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.array([block], pa.binary())], names=["bucket", "doc_id", "n_tokens", "block"])
    return pa.concat_tables([recipes.cast(chunk.schema), chunk])


RECIPES = "part int, doc_id bigint, start bigint, n_tokens bigint, digests binary, root binary"
MANIFEST = "part int, first_doc bigint, last_doc bigint, n_docs bigint, n_tokens bigint, root binary"


def _roots(digests: pa.Array) -> pa.Array:
    return pa.array([merkle([b[i : i + 16] for i in range(0, len(b), 16)]) for b in digests.to_pylist()], pa.binary())


def _lay(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One part, in order: each document's start in it, and its root."""
    before = 0
    for batch in batches:
        n = batch.column("n_tokens").to_numpy(zero_copy_only=False)
        start = before + np.cumsum(n) - n
        before += int(n.sum())
        columns = [batch.column("part"), batch.column("doc_id"), pa.array(start, pa.int64()), batch.column("n_tokens"), batch.column("digests"), _roots(batch.column("digests"))]
        yield pa.record_batch(columns, names=["part", "doc_id", "start", "n_tokens", "digests", "root"])


def _roots_again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.record_batch([*[batch.column(c) for c in ("part", "doc_id", "start", "n_tokens")], _roots(batch.column("digests"))], names=["part", "doc_id", "start", "n_tokens", "root"])


def _manifest(rows: pa.Table) -> pa.Table:
    """Of one part: its manifest row, over the roots of its documents in file order."""
    rows = rows.sort_by([("start", "ascending")])
    ids = rows["doc_id"]
    total = int(np.sum(rows["n_tokens"].to_numpy()))
    root = merkle([hashlib.blake2b(r + n.to_bytes(8, "little"), digest_size=16).digest() for r, n in zip(rows["root"].to_pylist(), rows["n_tokens"].to_pylist(), strict=True)])
    return pa.table([pa.array([rows["part"][0].as_py()], pa.int32()), pa.array([ids[0].as_py()], pa.int64()), pa.array([ids[-1].as_py()], pa.int64()), pa.array([len(rows)], pa.int64()), pa.array([total], pa.int64()), pa.array([root], pa.binary())], names=["part", "first_doc", "last_doc", "n_docs", "n_tokens", "root"])


def write_store(docs: DataFrame, tokenizer_path: str, folder: str, end_id: int = 1, docs_per_part: int = 20_000) -> None:
    """Writes the ids of (doc_id, text), the end id after each document, as a store in ``folder``."""
    spark = docs.sparkSession
    ship(spark)
    plain = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    raw = plain.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    sent = plain.mapInArrow(_write(tokenizer_path, end_id, max(16, raw >> 22)), SENT)
    both = sent.groupBy("bucket").applyInArrow(_unique, SENT).withColumn("set", F.when(F.col("n_tokens").isNull(), "chunks").otherwise("unordered"))
    both.write.partitionBy("set").option("compression", "uncompressed").parquet(f"{folder}/data")
    found = spark.read.schema(SENT + ", set string").parquet(f"{folder}/data").where("set = 'unordered'")
    key = F.coalesce("doc_id", F.lit(2**63 - 1))
    # Equal rows are told apart by their place in the files, so that a range bound can fall between them.
    recipes = found.select(key.alias("key"), F.monotonically_increasing_id().alias("place"), "doc_id", "n_tokens", F.col("block").alias("digests"))
    parts = max(1, found.count() // docs_per_part)
    ranged = recipes.repartitionByRange(parts, "key", "digests", "place").sortWithinPartitions("key", "digests", "place")
    laid = ranged.select(F.spark_partition_id().alias("part"), "doc_id", "n_tokens", "digests").mapInArrow(_lay, RECIPES)
    laid.write.parquet(f"{folder}/recipes")
    made = read_recipes(spark, folder).drop("digests").groupBy("part").applyInArrow(_manifest, MANIFEST)
    upto = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each part, that is for 20,000 documents
    made.withColumn("before", F.coalesce(F.sum("n_tokens").over(upto), F.lit(0))).write.parquet(f"{folder}/manifest")
    remove(spark, [f"{folder}/data/set=unordered"])


def read_recipes(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(RECIPES).parquet(f"{folder}/recipes")


def read_manifest(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(MANIFEST + ", before bigint").parquet(f"{folder}/manifest")


def _placed(spark: SparkSession, folder: str) -> DataFrame:
    """Recipes with their start in the whole stream."""
    before = read_manifest(spark, folder).select("part", "before")
    return read_recipes(spark, folder).drop("root").join(before, "part", "left").withColumn("start", F.coalesce("before", F.lit(0)) + F.col("start")).drop("before")


def _chunk_blocks(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(SENT + ", set string").parquet(f"{folder}/data").where("set = 'chunks'").select("block")


def _check_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(digest, n, crc) of every stored chunk; a chunk that is not what its digest says is an error."""
    for batch in batches:
        for block in batch.column(0):
            raw, sizes, ids = K.unpack(block.as_py())
            ends = np.cumsum(sizes.astype(np.int64))
            wide, names, crcs = ids.astype("<u4").tobytes(), _digests(raw), []
            for d, a, z in zip(names, (ends - sizes).tolist(), ends.tolist(), strict=True):
                chunk = wide[4 * a : 4 * z]
                if hashlib.blake2b(chunk, digest_size=16).digest() != d:
                    raise ValueError(f"chunk {d.hex()} is damaged")
                crcs.append(zlib.crc32(chunk))
            yield pa.record_batch([pa.array(names, pa.binary()), pa.array(sizes.astype(np.int64)), pa.array(crcs, pa.int64())], names=["digest", "n", "crc"])


def _times_x8() -> list[np.ndarray]:
    """Tables that append 2**k zero bytes to a checksum: for each k four tables by byte of the checksum."""

    def column(k: int) -> np.ndarray:
        zeros = bytes(1 << k)
        return np.array([zlib.crc32(zeros, 1 << b) ^ zlib.crc32(zeros, 0) for b in range(32)], np.uint32)

    out, col = [], None
    for k in range(34):
        if k <= 16:
            col = column(k)
        else:  # twice as many zeros: the map applied to its own columns
            col = np.array([np.bitwise_xor.reduce(col[np.flatnonzero((int(c) >> np.arange(32)) & 1)], initial=np.uint32(0)) for c in col], np.uint32)
        table = np.zeros((4, 256), np.uint32)
        for byte in range(4):
            for v in range(256):
                acc = 0
                for b in range(8):
                    if v >> b & 1:
                        acc ^= int(col[8 * byte + b])
                table[byte, v] = acc
        out.append(table)
    return out


_shift_tables: list[np.ndarray] = []


def shift_crc(crc: np.ndarray, zeros: np.ndarray) -> np.ndarray:
    """What each checksum adds to that of a longer stream, if so many bytes follow it."""
    if not _shift_tables:
        _shift_tables.extend(_times_x8())
    crc, zeros = crc.astype(np.uint32).copy(), zeros.astype(np.int64)
    for k, table in enumerate(_shift_tables):
        who = np.flatnonzero((zeros >> k) & 1)
        if len(who):
            c = crc[who]
            crc[who] = table[0][c & 255] ^ table[1][(c >> 8) & 255] ^ table[2][(c >> 16) & 255] ^ table[3][c >> 24]
    return crc


def _shifted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        crc, after = batch.column("crc").to_numpy(zero_copy_only=False), batch.column("after").to_numpy(zero_copy_only=False)
        yield pa.record_batch([batch.column("start"), pa.array(shift_crc(crc, after * 4).astype(np.int64)), batch.column("n")], names=["start", "crc", "n"])


def read_store(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the files alone.

    Chunks are checked against their digests, documents against their sizes, parts against the manifests; damage raises.
    """
    recipes = _placed(spark, folder)
    rows = F.expr("transform(sequence(0, length(digests) div 16 - 1), i -> struct(i as i, substring(digests, i * 16 + 1, 16) as digest))")
    used = recipes.select("start", F.explode(rows).alias("c")).select("start", "c.i", "c.digest")
    chunks = _chunk_blocks(spark, folder).mapInArrow(_check_chunks, "digest binary, n bigint, crc bigint")
    found = used.join(chunks, "digest", "left")
    later = Window.partitionBy("start").orderBy(F.col("i").desc()).rowsBetween(Window.unboundedPreceding, -1)
    placed = found.select("start", "crc", "n", F.coalesce(F.sum("n").over(later), F.lit(0)).alias("after"))
    sums = placed.mapInArrow(_shifted, "start bigint, crc bigint, n bigint").groupBy("start").agg(F.bit_xor("crc").alias("ids_crc32"), F.sum("n").alias("got"))
    again = read_recipes(spark, folder).mapInArrow(_roots_again, "part int, doc_id bigint, start bigint, n_tokens bigint, root binary")
    now = again.groupBy("part").applyInArrow(_manifest, MANIFEST)
    then = read_manifest(spark, folder)
    ok = now.alias("a").join(then.alias("b"), "part", "full").select("part", F.coalesce(F.expr("a.root = b.root and a.n_tokens = b.n_tokens and a.n_docs = b.n_docs"), F.lit(False)).alias("intact"))
    out = recipes.join(sums, "start", "left").join(ok, "part", "left")
    sound = F.col("intact") & (F.col("got") == F.col("n_tokens"))
    return out.select("doc_id", "start", "n_tokens", F.when(F.coalesce(sound, F.lit(False)), F.col("ids_crc32")).otherwise(F.raise_error(F.lit("the store is damaged")).cast("bigint")).alias("ids_crc32"))


def load_ids(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start and the id list of every document, put together from its chunks."""

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in batch.column(0):
                raw, sizes, ids = K.unpack(block.as_py())
                ends = np.concatenate([[0], np.cumsum(sizes.astype(np.int64))])
                yield pa.record_batch([pa.array(_digests(raw), pa.binary()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids.astype(np.int32)))], names=["digest", "ids"])

    rows = F.expr("transform(sequence(0, length(digests) div 16 - 1), i -> struct(i as i, substring(digests, i * 16 + 1, 16) as digest))")
    used = _placed(spark, folder).select("doc_id", "start", F.explode(rows).alias("c")).select("doc_id", "start", "c.i", "c.digest")
    parts = used.join(_chunk_blocks(spark, folder).mapInArrow(chunks, "digest binary, ids array<int>"), "digest")
    return parts.groupBy("doc_id", "start").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("i", "ids"))), lambda s: s["ids"])).alias("ids"))


def token_store(docs: DataFrame, tokenizer_path: str, end_id: int = 1) -> DataFrame:
    """Writes a store to the shared folder and returns read_store() of it."""
    folder = shared_dir(docs.sparkSession)
    write_store(docs, tokenizer_path, folder, end_id)
    return read_store(docs.sparkSession, folder)
