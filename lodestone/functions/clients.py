"""Typed clients from a table's schema: the text of a Python dataclass or a TypeScript interface."""

from __future__ import annotations

import keyword
import re

from pyspark.sql.types import ArrayType, BinaryType, BooleanType, DataType, FractionalType, IntegralType, MapType, StringType, StructType

_PYTHON = ((BooleanType, "bool"), (IntegralType, "int"), (FractionalType, "float"), (StringType, "str"), (BinaryType, "bytes"))
_TYPESCRIPT = ((BooleanType, "boolean"), (IntegralType, "number"), (FractionalType, "number"), (StringType, "string"), (BinaryType, "Uint8Array"))


def _kind(of: DataType, names: tuple, many: str, by_name: str, other: str) -> str:
    if isinstance(of, ArrayType):
        return many.format(_kind(of.elementType, names, many, by_name, other))
    if isinstance(of, MapType):
        return by_name.format(_kind(of.valueType, names, many, by_name, other))
    return next((text for kind, text in names if isinstance(of, kind)), other)


def _class_name(table: str) -> str:
    return "".join(p.capitalize() for p in re.split(r"[^0-9A-Za-z]+", table) if p) or "Row"


def python_client(schema: StructType, table: str) -> str:
    """A dataclass with a field for each column whose name Python allows."""
    fields = [f"    {f.name}: {_kind(f.dataType, _PYTHON, 'list[{}]', 'dict[str, {}]', 'object')}{' | None = None' if f.nullable else ''}" for f in sorted(schema.fields, key=lambda f: f.nullable) if f.name.isidentifier() and not keyword.iskeyword(f.name)]
    return "\n".join(["from dataclasses import dataclass", "", "", "@dataclass", f"class {_class_name(table)}:", *(fields or ["    pass"]), ""])


def typescript_client(schema: StructType, table: str) -> str:
    """An interface with a property for each column."""
    fields = [f'  "{f.name}"{"?" if f.nullable else ""}: {_kind(f.dataType, _TYPESCRIPT, "{}[]", "Record<string, {}>", "unknown")};' for f in schema.fields]
    return "\n".join([f"export interface {_class_name(table)} {{", *fields, "}", ""])
