"""Integer expressions with exact rules, and decimals whose scale belongs to the value."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, functions as F

BIG = "decimal(38,0)"


LONG = "bigint"


def floor_div(a: Column, b: Column, kind: str = LONG) -> Column:
    """Integer division that rounds down; a zero divisor raises. DECIMAL quotients of over 32 digits are null."""
    a, b = a.cast(kind), b.cast(kind)
    checked = F.when(b == 0, F.raise_error(F.lit("division by zero")).cast(kind)).otherwise(b)
    rest = a % checked
    rest = F.when((rest != 0) & ((rest < 0) != (checked < 0)), rest + checked).otherwise(rest)
    if kind == LONG:
        return ((a - rest).cast("decimal(20,0)") / checked.cast("decimal(19,0)")).cast(kind)
    return F.try_divide((a - rest).cast(BIG), checked).cast(kind)


TOO_LARGE = "a number is too large"


def power(a: Column, b: Column, kind: str = LONG) -> Column:
    """a to the power of a non-negative integer, exact; a negative exponent raises, and so does a power that does not fit."""
    return F.coalesce(_power(a, b, kind), F.when(a.isNotNull() & b.isNotNull(), F.raise_error(F.lit(TOO_LARGE)).cast(kind)))


def _power(a: Column, b: Column, kind: str) -> Column:
    """power() by multiplication in DECIMAL; null if it does not fit."""
    times = F.when(b < 0, F.raise_error(F.lit("negative exponent")).cast("int")).otherwise(F.when(b > 128, 128 + b % 2).otherwise(b).cast("int"))  # beyond, only 0, 1 and -1 have a power that fits
    product = F.aggregate(F.array_repeat(a.cast(BIG), times), F.lit(1).cast(BIG), lambda p, x: F.try_multiply(p, x).cast(BIG))
    return product.try_cast(kind)


#: Precedence and whether the operator groups to the right.
RULES = {"=": (0, True), "+": (1, False), "-": (1, False), "*": (2, False), "/": (2, False), "^": (3, True)}


def postfix(items: Sequence) -> list:
    """Operands and operators of an infix sequence in postfix order; unbalanced parentheses raise."""
    out, stack = [], []
    for item in items:
        if not isinstance(item, str):
            out.append(item)
        elif item == "(":
            stack.append(item)
        elif item == ")":
            while stack and stack[-1] != "(":
                out.append(stack.pop())
            if not stack:
                raise ValueError("unbalanced parentheses")
            stack.pop()
        elif item in RULES:
            rank, right = RULES[item]
            while stack and stack[-1] != "(" and (RULES[stack[-1]][0] > rank or RULES[stack[-1]][0] == rank and not right):
                out.append(stack.pop())
            stack.append(item)
        else:
            raise ValueError(f"unknown operator {item!r}")
    while stack:
        if stack[-1] == "(":
            raise ValueError("unbalanced parentheses")
        out.append(stack.pop())
    return out


def expression(items: Sequence[int | str | Column], wide: bool = False) -> Column:
    """An infix expression of integers, columns and ``+ - * / ^ = ( )`` as one Column, compiled for code generation.

    Numbers have 64 bits, or 38 digits if ``wide`` or if a constant needs it. A result or a step that does not fit raises; null operands give null.
    """
    given = [i for i in items if isinstance(i, Column)]
    wide = wide or any(isinstance(i, int) and not -(2**63) <= i < 2**63 for i in items)
    kind = BIG if wide else LONG
    apply = {
        "+": lambda a, b: F.try_add(a, b).cast(kind),
        "-": lambda a, b: F.try_subtract(a, b).cast(kind),
        "*": lambda a, b: F.try_multiply(a, b).cast(kind),
        "/": lambda a, b: floor_div(a, b, kind),
        "^": lambda a, b: _power(a, b, kind),
        "=": lambda a, b: (a == b).cast("int").cast(kind),
    }
    stack: list[Column] = []
    for item in postfix(items):
        if isinstance(item, str):
            if len(stack) < 2:
                raise ValueError("an operator lacks an operand")
            b, a = stack.pop(), stack.pop()
            stack.append(apply[item](a, b))
        else:
            stack.append(item.cast(kind) if isinstance(item, Column) else F.lit(str(item)).cast(kind))
    if len(stack) > 1:
        raise ValueError("operands without an operator")
    if not stack:
        return F.lit(0).cast(kind)
    known = reduce(lambda a, b: a & b, (g.isNotNull() for g in given), F.lit(True))
    return F.coalesce(stack[0], F.when(known, F.raise_error(F.lit(TOO_LARGE)).cast(kind)))


def evaluate(items: Sequence[int | str]) -> int:
    """The same rules on Python integers of any size."""
    apply = {"+": int.__add__, "-": int.__sub__, "*": int.__mul__, "/": int.__floordiv__, "^": _int_power, "=": lambda a, b: int(a == b)}
    stack: list[int] = []
    for item in postfix(items):
        if isinstance(item, str):
            if len(stack) < 2:
                raise ValueError("an operator lacks an operand")
            b, a = stack.pop(), stack.pop()
            stack.append(apply[item](a, b))
        else:
            stack.append(item)
    if len(stack) > 1:
        raise ValueError("operands without an operator")
    return stack[0] if stack else 0


def _int_power(a: int, b: int) -> int:
    if b < 0:
        raise ValueError("negative exponent")
    return a**b


def scaled(numerator: Column, scale: Column) -> Column:
    """The value numerator / 10**scale; a negative scale raises."""
    ok = F.when(scale < 0, F.raise_error(F.lit("negative scale")).cast("int")).otherwise(scale.cast("int"))
    return F.struct(numerator.cast(BIG).alias("numerator"), ok.alias("scale"))


def _raised(value: Column, scale: Column) -> Column:
    """The numerator at a larger scale. Powers of ten come from a text, so they stay exact."""
    ten = F.concat(F.lit("1"), F.repeat(F.lit("0"), scale - value["scale"])).cast(BIG)
    return (value["numerator"] * ten).cast(BIG)


def add(a: Column, b: Column) -> Column:
    top = F.greatest(a["scale"], b["scale"])
    return F.struct((_raised(a, top) + _raised(b, top)).cast(BIG).alias("numerator"), top.alias("scale"))


def subtract(a: Column, b: Column) -> Column:
    top = F.greatest(a["scale"], b["scale"])
    return F.struct((_raised(a, top) - _raised(b, top)).cast(BIG).alias("numerator"), top.alias("scale"))


def multiply(a: Column, b: Column) -> Column:
    return F.struct((a["numerator"] * b["numerator"]).cast(BIG).alias("numerator"), (a["scale"] + b["scale"]).alias("scale"))


def from_double(value: Column, most: int = 9) -> Column:
    """The value cut (not rounded) after at most ``most`` decimals, trailing zeros dropped."""
    text = F.format_string(f"%.{most + 6}f", value.cast("double"))
    cut = F.regexp_extract(text, rf"^(-?[0-9]+\.[0-9]{{{most}}})", 1)
    short = F.regexp_replace(F.regexp_replace(cut, "0+$", ""), r"\.$", "")
    scale = F.when(F.instr(short, ".") > 0, F.length(short) - F.instr(short, ".")).otherwise(F.lit(0))
    return F.struct(F.regexp_replace(short, r"\.", "").cast(BIG).alias("numerator"), scale.cast("int").alias("scale"))


def as_double(value: Column) -> Column:
    return value["numerator"].cast("double") / F.pow(F.lit(10.0), value["scale"])
