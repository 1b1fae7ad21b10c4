"""Encode, pack and inspect token streams as Column expressions: no Python runs on the executors.

A token stream is an ``array<int>`` of codes, packed five bits each, most significant bit first, zero padded to whole
bytes. A code is a digit to base 32, so eight tokens, a number of 40 bits, change to ten hexadecimal digits and back.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F

from . import tokens as T


def _codes(*values: int) -> Column:
    return F.array(*[F.lit(v) for v in values])


def _repeat(value: int, times: Column) -> Column:
    return F.array_repeat(F.lit(value), F.greatest(times, F.lit(0)))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with the value worked out once. An expression used twice would be inlined, and inside a lambda worked out for every element.

    No lambda inside the body may use the value: Spark does not take a Python UDF over such an expression out of a projection.
    """
    return F.transform(F.array(value), body)[0]


def _characters(text: Column) -> Column:
    """The characters of a text; none of an empty one."""
    return F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(text, ""))


_DIGITS32 = "0123456789ABCDEFGHIJKLMNOPQRSTUV"  # a code is a digit to base 32
_NEGATIVE = _DIGITS32[17:26]  # the codes of the digits -1 to -9


def _from_digits32(text: Column) -> Column:
    """The codes that the characters of a text stand for."""
    return F.transform(_characters(text), lambda c: F.instr(F.lit(_DIGITS32), c) - 1)


def encode_integer(value: Column) -> Column:
    """Signed-digit codes of an integer (BIGINT or DECIMAL(38,0)) and END; null stays null."""
    text = value.cast("string")
    return _from_digits32(F.concat(F.when(value < 0, F.translate(text, "123456789-", _NEGATIVE)).otherwise(text), F.lit(_DIGITS32[T.END])))


def encode_digits(digits: Column, end: bool = True) -> Column:
    """Codes of an array of digits -9..9, with END if asked."""
    body = F.transform(digits, lambda d: F.when(d < 0, 16 - d).otherwise(d).cast("int"))
    return F.concat(body, _codes(T.END)) if end else body


_LETTERS = T.UPPER + T.LOWER + T.PUNCTUATION + T.DIGITS
_SIZE = len(T.UPPER)  # the first three alphabets have as many characters


def encode_word(text: Column, strict: bool = True) -> Column:
    """START, the characters with their context switches, END; null stays null.

    A character outside the four alphabets raises, or gives null if not strict.
    """
    # A character is its place in the four alphabets: level * size + code; level 0 upper, 1 lower, 2 punctuation, 3 digit.
    places = F.transform(_characters(text), lambda c: F.instr(F.lit(_LETTERS), c) - 1)
    level = lambda p: F.least(F.floor(p / _SIZE), F.lit(3)).cast("int")
    depth = lambda p: F.when(p >= 3 * _SIZE, F.lit(0)).otherwise(F.floor(p / _SIZE).cast("int"))  # noqa: E731  # the level that stands open after a character

    def emit(own: Column, last: Column) -> Column:
        code, before = F.array((own - level(own) * _SIZE).cast("int")), depth(last)
        digit = F.concat(_repeat(T.END, before), _codes(T.END), code, _codes(T.START))
        down = F.concat(_repeat(T.END, before - level(own)), _repeat(T.START, level(own) - before), code)
        return F.when(own >= 3 * _SIZE, digit).otherwise(down)

    def word(own: Column) -> Column:
        before = F.concat(F.array(F.lit(0)), F.slice(own, F.lit(1), F.greatest(F.size(own) - 1, F.lit(0))))
        body = F.flatten(F.zip_with(own, F.slice(before, F.lit(1), F.size(own)), emit))
        last = F.when(F.size(own) == 0, F.lit(0)).otherwise(depth(F.element_at(own, F.greatest(F.size(own), F.lit(1)))))
        known = F.coalesce(F.array_min(own), F.lit(0)) >= 0
        return F.when(known, F.concat(_codes(T.START), F.when(known, body), _repeat(T.END, last), _codes(T.END)))

    out = let(places, word)
    if strict:
        out = F.coalesce(out, F.when(text.isNotNull(), F.raise_error(F.concat(F.lit("cannot be encoded: "), text)).cast("array<int>")))
    return F.when(text.isNotNull(), out)


def encode_operator(symbol: str) -> Column:
    """The code of one of ``+ - * / = ( ) ^ S``."""
    if symbol not in T.SYMBOL_CODE:
        raise ValueError(f"unknown operator {symbol!r}")
    return _codes(T.SYMBOL_CODE[symbol])


def encode_expression(*items: int | str | list[int] | Column) -> Column:
    """Codes of an infix expression of numbers (or integer columns), digit lists and operators."""
    parts = []
    for item in items:
        if isinstance(item, str):
            parts.append(encode_operator(item))
        elif isinstance(item, list):
            parts.append(encode_digits(F.array(*[F.lit(d) for d in item])))
        else:
            parts.append(encode_integer(item if isinstance(item, Column) else F.lit(item)))
    return F.concat(*parts)


def encode_record(*values: Column, kinds: list[str] | None = None) -> Column:
    """Codes of several values and RECORD. kinds: ``int``, ``word`` or ``codes`` for each (default: int)."""
    how = {"int": encode_integer, "word": encode_word, "codes": lambda c: c}
    return F.concat(*[how[k](v) for v, k in zip(values, kinds or ["int"] * len(values), strict=True)], _codes(T.RECORD))


def encode_command(name: str, argument: Column) -> Column:
    """A control command with its integer argument."""
    return F.concat(_codes(*[T.START] * 4, T.COMMANDS.index(name), *[T.END] * 4), encode_integer(argument), _codes(T.END))


def encode_label(position: Column, label: Column) -> Column:
    """A label for the value at a position."""
    return F.concat(_codes(*[T.START] * 4, T.COMMANDS.index("LABEL"), *[T.END] * 5), encode_word(label), _codes(T.END), encode_integer(position))


def encode_bytes(content: Column) -> Column:
    """Each byte as a number."""
    pairs = F.regexp_extract_all(F.hex(content), F.lit(".{2}"), F.lit(0))
    return _from_digits32(F.array_join(F.transform(pairs, lambda h: F.concat(F.conv(h, 16, 10), F.lit(_DIGITS32[T.END]))), ""))


def bits(codes: Column, gap: str = "") -> Column:
    """The codes as text of five binary digits each."""
    return F.array_join(F.transform(codes, lambda t: F.lpad(F.bin(t), 5, "0")), gap)


def pack(codes: Column) -> Column:
    """The codes packed to bytes."""
    text = F.array_join(F.transform(codes, lambda t: F.substr(F.lit(_DIGITS32), t + 1, F.lit(1))), "")
    eights = F.regexp_extract_all(F.concat(text, F.lit("0" * 7)), F.lit(".{8}"), F.lit(0))  # a rest of under eight zeros is dropped
    hexed = F.array_join(F.transform(eights, lambda e: F.lpad(F.conv(e, 32, 16), 10, "0")), "")
    return F.unhex(F.substr(hexed, F.lit(1), (F.floor((F.size(codes) * 5 + 7) / 8) * 2).cast("int")))


def pad_bits(codes: Column) -> Column:
    """Zero bits that pack() adds."""
    return F.pmod(-5 * F.size(codes), F.lit(8))


def pack_hex(codes: Column) -> Column:
    return F.lower(F.hex(pack(codes)))


def unpack(content: Column, pad: Column | int = 0, count: Column | None = None) -> Column:
    """The codes in packed bytes, without the padding; at most ``count`` of them."""
    n = F.floor((8 * F.octet_length(content) - pad) / 5).cast("int")
    n = F.when(n < 0, F.lit(0)).otherwise(n)
    n = n if count is None else F.when(n < count, n).otherwise(count)
    fives = F.regexp_extract_all(F.concat(F.hex(content), F.lit("0" * 9)), F.lit(".{10}"), F.lit(0))
    text = F.array_join(F.transform(fives, lambda e: F.lpad(F.conv(e, 16, 32), 8, "0")), "")
    return F.slice(_from_digits32(text), F.lit(1), n)


def unpack_hex(text: Column, pad: Column | int = 0) -> Column:
    return unpack(F.unhex(text), pad)


def read_at(codes: Column, bit_offset: Column, count: Column) -> Column:
    """``count`` codes from a bit offset, which must be a multiple of five."""
    ok = F.pmod(bit_offset, F.lit(5)) == 0
    return F.when(ok, F.slice(codes, (bit_offset / 5).cast("int") + 1, count)).otherwise(F.raise_error(F.lit("the offset is inside a token")).cast("array<int>"))
