"""Scalar functions on identifiers and symbol names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def style_key(name: Column) -> Column:
    """camelCase, kebab-case and snake_case to one key: ASCII words in lower
    case, joined by underscores."""
    spaced = F.regexp_replace(name, "(?<=[a-z0-9])(?=[A-Z])", "_")
    joined = F.regexp_replace(spaced, "[^A-Za-z0-9]+", "_")
    return F.translate(F.regexp_replace(joined, "^_+|_+$", ""), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def remove_signature(name: Column) -> Column:
    return F.when(F.contains(name, F.lit("(")), F.trim(F.split_part(name, F.lit("("), F.lit(1)))).otherwise(name)


def qualified_tail(name: Column) -> Column:
    """What follows the last of . : # $"""
    return F.trim(F.regexp_extract(F.trim(name), "([^.:#$]*)$", 1))


def last_identifier(name: Column) -> Column:
    return F.regexp_extract(name, "([A-Za-z0-9_]+)[^A-Za-z0-9_]*$", 1)


def method_base(name: Column) -> Column:
    return last_identifier(remove_signature(name))


def canonical(name: Column, case_sensitive: bool = False) -> Column:
    plain = F.regexp_replace(F.trim(name), "::|#|\\$", ".")
    base = F.split_part(plain, F.lit("("), F.lit(1))
    return base if case_sensitive else F.lower(base)


def display_name(symbol: Column) -> Column:
    """Last non-empty piece of a symbol string."""
    return F.element_at(F.filter(F.split(symbol, "[ /#.():`]+"), lambda p: p != ""), -1)


def document_symbol_key(symbol: Column, path: Column) -> Column:
    """Local symbols are only unique within their file."""
    return F.when(F.startswith(symbol, F.lit("local ")), F.concat(path, F.lit("#"), symbol)).otherwise(symbol)


def coordinate(path: Column, line: Column, name: Column) -> Column:
    return F.concat(path, F.lit(":"), line.cast("string"), F.lit("#"), name)


# Symbol roles as bits.
ROLES = {"definition": 1, "import": 2, "write": 4, "read": 8, "generated": 16, "test": 32, "forward_definition": 64}


def has_role(mask: Column, role: str) -> Column:
    return mask.bitwiseAND(F.lit(ROLES[role])) != 0


# Rank of each kind of result and of each level of reliability.
KIND_RANK = {
    "struct": 0,
    "class": 0,
    "trait": 0,
    "enum": 0,
    "interface": 0,
    "type": 0,
    "record": 0,
    "annotation": 0,
    "function": 1,
    "method": 1,
    "constructor": 1,
    "module": 2,
    "field": 3,
    "property": 3,
    "parameter": 4,
    "variable": 4,
    "import": 4,
}
RELIABILITY_RANK = {"precise_fact": 0, "parser_fact": 1, "source_fact": 2, "inferred_candidate": 3}


def _ranked(value: Column, table: dict[str, int], otherwise: int) -> Column:
    pairs = F.create_map(*[F.lit(v) for item in table.items() for v in item])
    return F.coalesce(F.element_at(pairs, value), F.lit(otherwise))


def kind_rank(kind: Column) -> Column:
    return _ranked(kind, KIND_RANK, 5)


def reliability_rank(reliability: Column) -> Column:
    return _ranked(reliability, RELIABILITY_RANK, 4)


def like_escaped(text: str) -> str:
    """A text for LIKE with backslash as escape character, wildcards taken literally."""
    return text.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_")


def method_like(identifier: str) -> str | None:
    """LIKE pattern of the signatures of a method; none if it has one already."""
    return None if not identifier or "(" in identifier else like_escaped(identifier) + "(%"


# Numbers of symbol kinds in index files.
KIND_NUMBERS = {7: "class", 8: "constant", 9: "constructor", 11: "enum", 15: "field", 17: "function", 21: "interface", 26: "method", 29: "module", 37: "parameter", 41: "property", 49: "struct", 53: "trait", 55: "type_alias", 58: "type_parameter", 61: "variable"}


def kind_of_number(number: Column) -> Column:
    """Name of a numeric symbol kind, "symbol" for others."""
    table = F.create_map(*[F.lit(v) for item in KIND_NUMBERS.items() for v in item])
    return F.coalesce(F.element_at(table, number.cast("int")), F.lit("symbol"))
