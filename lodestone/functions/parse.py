"""The five-context reader of token streams, as a plain function, as Arrow UDFs that read a batch at once, and as table functions.

A parsed value is (kind, text, value, symbol): kind ``number`` (value), ``word`` (text),
``operator`` (symbol), ``command`` (symbol) or ``record``. Neighbouring words are one word, empty
ones are dropped. A checksum's payload token is skipped, whatever its code.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import ArrayType, DecimalType, IntegerType, MapType, StringType, StructField, StructType

from . import tokens as T

PARSED = ArrayType(StructType([StructField("kind", StringType()), StructField("text", StringType()), StructField("value", DecimalType(38, 0)), StructField("symbol", StringType())]))
_ALPHABETS = (None, T.UPPER, T.LOWER, T.PUNCTUATION)
_SYMBOLS = {code: symbol for symbol, code in T.SYMBOL_CODE.items()}


def _digit(code: int) -> int | None:
    return code if code <= 9 else 16 - code if 17 <= code <= 25 else None


def parse(codes: Iterable[int]) -> list[tuple]:
    """The parsed values of a stream; a code that its context does not know raises ValueError."""
    out: list[tuple] = []
    word, number, digits, depth, skip = "", 0, 0, 0, False

    def close_number() -> None:
        nonlocal number, digits
        if digits:
            out.append(("number", None, number, None))
            number = digits = 0

    def close_word() -> None:
        nonlocal word
        if word:
            out.append(("word", word, None, None))
            word = ""

    for code in map(int, codes):
        if skip:  # the payload of a checksum
            skip = False
        elif code in (T.RECORD, T.CHECKSUM):
            close_number()
            if code == T.RECORD:
                close_word()
                out.append(("record", None, None, None))
            depth, skip = 0, code == T.CHECKSUM
        elif code == T.START:
            close_number()
            depth = min(depth + 1, 4)
        elif code == T.END:
            close_number()
            depth = max(depth - 1, 0)
        elif depth == 0:
            digit = _digit(code)
            close_word()
            if digit is None:
                close_number()
                out.append(("operator", None, None, _SYMBOLS[code]))
            else:
                number, digits = number * 10 + digit, digits + 1
        elif depth < 4:
            word += _ALPHABETS[depth][code]
        elif code < len(T.COMMANDS):
            close_word()
            out.append(("command", None, None, T.COMMANDS[code]))
        else:
            raise ValueError(f"code {code} is no command")
    close_number()
    close_word()
    return out


def resolve_scales(parsed: list[tuple]) -> list[tuple]:
    """number S number becomes one (``scaled``, None, numerator, scale); a negative scale raises."""
    out: list[tuple] = []
    i = 0
    while i < len(parsed):
        three = parsed[i : i + 3]
        if len(three) == 3 and three[0][0] == three[2][0] == "number" and three[1][3] == "S":
            if three[2][2] < 0:
                raise ValueError("negative scale")
            out.append(("scaled", None, three[0][2], str(three[2][2])))
            i += 3
        else:
            out.append(parsed[i])
            i += 1
    return out


def all_text(parsed: list[tuple]) -> str:
    """All words and numbers, joined."""
    return "".join(t if k == "word" else str(v) if k == "number" else "" for k, t, v, _ in parsed)


def by_labels(parsed: list[tuple]) -> dict[str, str]:
    """Label name to text. Labels may stand before their values one by one, or all before all values."""
    names: dict[int, str] = {}
    values: dict[int, str] = {}
    at, reading, pending, order = 0, False, "", []
    loose: list[str] = []
    for kind, text, value, symbol in parsed:
        if kind == "command":
            reading, pending = symbol == "LABEL", ""
        elif reading and kind == "word":
            pending = text
        elif reading and kind == "number":
            reading, at = False, int(value)
            names[at] = pending
            order.append(at)
        elif kind in ("word", "number"):
            piece = text if kind == "word" else str(value)
            values[at] = values.get(at, "") + piece
            loose.append(piece)
    ahead = len(names) > 1 and set(values) <= {at} and len(loose) > 1
    if ahead:  # all labels came first: values follow in the order of positions
        return {names[p]: v for p, v in zip(sorted(names), loose, strict=False)} | {names[p]: "" for p in sorted(names)[len(loose) :]}
    return {n: values.get(p, "") for p, n in names.items()}


KINDS = ("number", "word", "operator", "command", "record")
_LETTER = np.array([[0] * 32] + [[ord(a[c]) if c < len(a) else 0 for c in range(32)] for a in _ALPHABETS[1:]], np.uint8)
_DIGIT = np.array([d if (d := _digit(c)) is not None else 0 for c in range(32)], np.int64)
_IS_DIGIT = np.array([_digit(c) is not None for c in range(32)])
_TEN = 10 ** np.arange(19, dtype=np.int64)


def controls(codes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which codes of some streams (``first``: where each begins, and the end) are a checksum's payload, and which CHECKSUMs are not."""
    mark = codes == T.CHECKSUM
    new = mark.copy()  # where a run of CHECKSUMs begins: every other one of a run is the payload of the one before
    new[1:] &= ~mark[:-1]
    begins = first[:-1][first[:-1] < len(codes)]
    new[begins] = mark[begins]
    run = np.maximum.accumulate(np.where(new, np.arange(len(codes)), 0)) if len(codes) else np.empty(0, np.int64)
    control = mark & ((np.arange(len(codes)) - run) % 2 == 0)
    payload = np.zeros(len(codes), bool)
    payload[1:] = control[:-1]
    payload[begins] = False
    return payload, control


def read_streams(codes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, pa.StructArray]:
    """parse() of many streams at once: where each stream's values begin (and the end), and all values."""
    if len(codes) and (codes.min() < 0 or codes.max() > 31):
        raise ValueError("a code has five bits")
    payload, check = controls(codes, first)
    if payload.any():
        stays = ~payload
        codes, check = codes[stays], check[stays]
        first = np.concatenate([[0], np.cumsum(stays)])[first]
    n, at = len(codes), np.arange(len(codes))
    record = codes == T.RECORD
    up, down = codes == T.START, codes == T.END
    # The depth before each code: a walk that stops at 0, and begins anew with every stream and after RECORD and CHECKSUM.
    fresh = np.zeros(n + 1, bool)
    fresh[first] = True
    fresh[1:] |= record | check
    part = np.cumsum(fresh[:-1])
    walk = np.cumsum(up.astype(np.int64) - down) - part * (4 * n + 4)  # later parts lie below earlier ones
    begin = np.maximum.accumulate(np.where(fresh[:-1], at, 0))
    zero = (walk - (up.astype(np.int64) - down))[begin] if n else walk
    low = np.minimum(np.minimum.accumulate(walk), zero)
    after = walk - low
    depth = np.where(fresh[:-1], 0, np.concatenate([[0], after[:-1]])) if n else walk
    high = after > 4
    if high.any():  # deeper than any context: the walk also stops at 4, code by code
        for p in np.unique(part[high]):
            lo, hi = np.searchsorted(part, [p, p + 1])
            d = 0
            for i in range(lo, hi):
                depth[i] = d
                d = min(d + 1, 4) if up[i] else max(d - 1, 0) if down[i] else d
    stop = record | check | up | down
    plain = ~stop & (depth == 0)
    digit, letter, command = plain & _IS_DIGIT[codes], ~stop & (depth > 0) & (depth < 4), ~stop & (depth == 4)
    if (codes[command] >= len(T.COMMANDS)).any():
        raise ValueError(f"code {codes[command].max()} is no command")
    operator = plain & ~digit
    stream = np.repeat(np.arange(len(first) - 1), np.diff(first))

    def runs(member: np.ndarray, breaks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Members, and which of them begin a run: runs end at a break or with the stream."""
        who = np.flatnonzero(member)
        key = np.cumsum(breaks)[who] + stream[who] * (n + 1)
        return who, np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(who) else who

    numbers, number_at = runs(digit, stop | operator)
    letters, word_at = runs(letter, plain | command | record)
    starts = [numbers[number_at], letters[word_at], np.flatnonzero(operator), np.flatnonzero(command), np.flatnonzero(record)]
    order = np.argsort(np.concatenate(starts), kind="stable")
    kind = np.repeat(np.arange(5), [len(x) for x in starts])
    counts = np.searchsorted(np.concatenate(starts)[order], first)

    size = np.diff(np.append(number_at, len(numbers)))
    place = np.repeat(number_at + size, size) - np.arange(len(numbers)) - 1  # of each digit, from the last
    small = np.add.reduceat(_DIGIT[codes[numbers]] * _TEN[np.minimum(place, 18)], number_at) if len(numbers) else np.empty(0, np.int64)
    value = pa.array(small, pa.int64()).cast(pa.decimal128(38, 0))
    long = np.flatnonzero(size > 18)
    if len(long):
        exact = value.to_pylist()
        for i in long.tolist():
            total = 0
            for d in _DIGIT[codes[numbers[number_at[i] : number_at[i] + size[i]]]].tolist():
                total = total * 10 + d
            exact[i] = Decimal(total)
        value = pa.array(exact, pa.decimal128(38, 0))
    edges = np.append(word_at, len(letters)).astype(np.int32)
    text = pa.StringArray.from_buffers(len(word_at), pa.py_buffer(edges), pa.py_buffer(_LETTER[depth[letters], codes[letters]].tobytes()))
    symbols = pa.array([_SYMBOLS[c] for c in codes[operator].tolist()] + [T.COMMANDS[c] for c in codes[command].tolist()], pa.string())

    def column(values: pa.Array, before: int) -> pa.Array:
        """The values of the kinds from ``before`` on, in stream order, null for the others."""
        index = order - before
        return values.take(pa.array(index, mask=(index < 0) | (index >= len(values))))

    columns = [pa.array(KINDS).take(pa.array(kind[order])), column(text, len(size)), column(value, 0), column(symbols, len(size) + len(word_at))]
    return counts, pa.StructArray.from_arrays(columns, ["kind", "text", "value", "symbol"])


def _flat(streams: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Codes of a list column, and where each stream begins (and the end); a null stream is empty."""
    sizes = streams.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    return streams.flatten().to_numpy(zero_copy_only=False).astype(np.int64), np.concatenate([[0], np.cumsum(sizes)])


def _batch(streams: pa.Array | pa.ChunkedArray) -> tuple[pa.Array, np.ndarray, pa.StructArray]:
    streams = streams.combine_chunks() if isinstance(streams, pa.ChunkedArray) else streams
    return streams, *read_streams(*_flat(streams))


def _each(streams: pa.Array) -> Iterator[list[tuple] | None]:
    """The values of each stream as parse() gives them; None for a null one."""
    streams, first, values = _batch(streams)
    flat = list(zip(*[values.field(i).to_pylist() for i in range(4)], strict=True))
    for known, a, z in zip(streams.is_valid().to_pylist(), first[:-1].tolist(), first[1:].tolist(), strict=True):
        yield [(k, t, None if v is None else int(v), s) for k, t, v, s in flat[a:z]] if known else None


@F.arrow_udf(PARSED)
def parsed(codes: pa.Array) -> pa.Array:
    """array of parsed values of each stream: a batch is read at once, in numpy."""
    streams, first, values = _batch(codes)
    return pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), values, mask=streams.is_null())


@F.arrow_udf(MapType(StringType(), StringType()))
def labelled(codes: pa.Array) -> pa.Array:
    """Label names and texts of each stream."""
    return pa.array([None if v is None else list(by_labels(v).items()) for v in _each(codes)], pa.map_(pa.string(), pa.string()))


@F.arrow_udf(StringType())
def evaluated(codes: pa.Array) -> pa.Array:
    """Value, as text, of each stream that holds an infix expression. Of ``number S number``, a number with a scale, the first counts: a scale is an annotation."""
    from .arith import evaluate

    def items(values: list[tuple]) -> list:
        return [s if k == "operator" else v for k, _, v, s in resolve_scales(values) if k in ("number", "operator", "scaled")]

    return pa.array([None if v is None else str(evaluate(items(v))) for v in _each(codes)], pa.string())


SCALED = ArrayType(StructType([StructField("numerator", DecimalType(38, 0)), StructField("scale", IntegerType())]))


@F.arrow_udf(SCALED)
def scaled_values(codes: pa.Array) -> pa.Array:
    """The numbers of each stream with their scales (``number S number``; 0 without one), for arith.add() and the like."""
    rows = [None if v is None else [(Decimal(n), int(s or 0)) for k, _, n, s in resolve_scales(v) if k in ("number", "scaled")] for v in _each(codes)]
    return pa.array([r if r is None else [{"numerator": n, "scale": s} for n, s in r] for r in rows], pa.list_(pa.struct([("numerator", pa.decimal128(38, 0)), ("scale", pa.int32())])))


def text_of(values: Column) -> Column:
    """all_text() of parsed values, without Python."""
    return F.array_join(F.transform(values, lambda p: F.coalesce(p["text"], p["value"].cast("string"))), "")


def value_vector(values: Column) -> Column:
    """The numbers among parsed values, in order."""
    return F.transform(F.filter(values, lambda p: p["kind"] == "number"), lambda p: p["value"].cast("bigint"))


def digit_vector(codes: Column) -> Column:
    """All signed digits of a record of numbers."""
    return F.transform(F.filter(codes, lambda t: (t <= 9) | t.between(17, 25)), lambda t: F.when(t <= 9, t).otherwise(16 - t))


def fields(values: Column, names: list[str]) -> Column:
    """struct of texts by position: words and numbers meet the names in order; missing ones are null, more are dropped."""
    plain = F.filter(values, lambda p: p["kind"].isin("word", "number"))
    return F.struct(*[F.coalesce(F.get(plain, F.lit(i))["text"], F.get(plain, F.lit(i))["value"].cast("string")).alias(n) for i, n in enumerate(names)])


def split_records(codes: list[int]) -> Iterator[tuple[int, int, list[int]]]:
    """(record_idx, bit_offset, tokens) of each record that ends with RECORD; checksum payloads don't end one."""
    begin, index, skip = 0, 0, False
    for i, code in enumerate(codes):
        if skip:
            skip = False
        elif code == T.CHECKSUM:
            skip = True
        elif code == T.RECORD:
            yield index, begin * 5, list(codes[begin : i + 1])
            begin, index = i + 1, index + 1


def unpack_bytes(content: bytes, pad: int = 0) -> list[int]:
    """Codes of packed bytes: eight of them in every five bytes."""
    count = max(0, (8 * len(content) - pad) // 5)
    bits = np.unpackbits(np.frombuffer(content, np.uint8))[: 5 * count].reshape(-1, 5)
    return (bits @ np.array([16, 8, 4, 2, 1], np.uint8)).tolist()


def records_of(blobs: DataFrame) -> DataFrame:
    """(path, record_idx, bit_offset, tokens) of (path, tokens) rows; a batch of streams is cut at once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes, first = _flat(batch.column(1))
            payload, _ = controls(codes, first)
            ends = np.flatnonzero((codes == T.RECORD) & ~payload) + 1
            count = np.diff(np.searchsorted(ends, first, "right"))
            before = np.concatenate([[0], ends[:-1]]) if len(ends) else ends
            stream = np.repeat(np.arange(len(count)), count)
            begin = np.maximum(before, first[stream])
            index = np.arange(len(ends)) - np.repeat(np.cumsum(count) - count, count)
            size = ends - begin
            kept = codes[np.arange(int(size.sum())) + np.repeat(begin - (np.cumsum(size) - size), size)]
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(size)]), pa.int32()), pa.array(kept, pa.int32()))
            yield pa.record_batch([batch.column(0).take(pa.array(stream)), pa.array(index, pa.int64()), pa.array((begin - first[stream]) * 5, pa.int64()), lists], names=["path", "record_idx", "bit_offset", "tokens"])

    return blobs.select("path", F.col("tokens").cast("array<int>").alias("tokens")).mapInArrow(run, "path string, record_idx bigint, bit_offset bigint, tokens array<int>")


def checksums_of(blobs: DataFrame) -> DataFrame:
    """(path, segment, expected, computed, passed) of the checksums in (path, tokens) rows; one without payload has expected -1 and fails."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes, first = _flat(batch.column(1))
            payload, control = controls(codes, first)
            at = np.flatnonzero(control)
            stream = np.searchsorted(first, at, "right") - 1
            has = (at + 1 < len(codes)) & (at + 1 < first[stream + 1])
            total = np.concatenate([[0], np.cumsum(codes)])
            same = np.concatenate([[False], stream[1:] == stream[:-1]]) if len(at) else np.empty(0, bool)
            begin = np.where(same, np.roll(at, 1) + 2, first[stream])
            segment = np.arange(len(at)) - np.maximum.accumulate(np.where(same, 0, np.arange(len(at)))) if len(at) else at
            expected = np.where(has, codes[np.minimum(at + 1, len(codes) - 1)], -1) if len(at) else at
            computed = (total[at] - total[begin]) % 32
            columns = [pa.array(x, pa.int32()) for x in (segment, expected, computed)]
            yield pa.record_batch([batch.column(0).take(pa.array(stream)), *columns, pa.array(has & (expected == computed))], names=["path", "segment", "expected", "computed", "passed"])

    return blobs.select("path", F.col("tokens").cast("array<int>").alias("tokens")).mapInArrow(run, "path string, segment int, expected int, computed int, passed boolean")


@F.udtf(returnType="segment int, expected int, computed int, passed boolean")
class ScanChecksums:
    """One row for each checksum of a stream; one without payload has expected -1 and fails."""

    def eval(self, codes: list[int]):
        begin, i, n = 0, 0, 0
        while i < len(codes):
            if codes[i] != 29:
                i += 1
                continue
            own = sum(codes[begin:i]) % 32
            has = i + 1 < len(codes)
            expected = codes[i + 1] if has else -1
            yield n, expected, own, has and expected == own
            n, i = n + 1, i + 1 + has
            begin = i


@F.udtf(returnType="pos int, kind string, text string, value string, symbol string")
class ParseTokens:
    """One row for each parsed value of a stream."""

    def eval(self, codes: list[int]):
        for i, (kind, text, value, symbol) in enumerate(parse(codes)):
            yield i, kind, text, None if value is None else str(value), symbol


def register(spark) -> None:
    """Names for SQL: parse_tokens, scan_checksums (table functions), parsed, labelled, evaluated."""
    from ..session import ship

    ship(spark)
    spark.udtf.register("parse_tokens", ParseTokens)
    spark.udtf.register("scan_checksums", ScanChecksums)
    for name, f in (("parsed", parsed), ("labelled", labelled), ("evaluated", evaluated)):
        spark.udf.register(name, f)
