"""Symbol strings, descriptor kinds and offset conversion."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Descriptor suffix by kind of symbol.
SUFFIX = {
    "function": "().",
    "method": "().",
    "constructor": "().",
    "class": "#",
    "struct": "#",
    "interface": "#",
    "enum": "#",
    "trait": "#",
    "type_alias": "#",
    "module": "/",
    "namespace": "/",
    "import_alias": ":",
}


def escaped(name: Column) -> Column:
    """Simple identifiers as they are, others between backticks."""
    return F.when(F.rlike(name, F.lit(r"^[A-Za-z0-9_+$-]+$")), name).otherwise(F.concat(F.lit("`"), F.replace(name, F.lit("`"), F.lit("``")), F.lit("`")))


def package_component(value: Column) -> Column:
    return F.when(F.coalesce(value, F.lit("")) == "", ".").otherwise(F.replace(value, F.lit(" "), F.lit("  ")))


def descriptor(name: Column, kind: Column) -> Column:
    own = F.element_at(F.create_map(*[F.lit(v) for item in SUFFIX.items() for v in item]), kind)
    plain = F.concat(escaped(name), F.coalesce(own, F.lit(".")))
    return F.when(kind == "parameter", F.concat(F.lit("("), escaped(name), F.lit(")"))).when(kind == "type_parameter", F.concat(F.lit("["), escaped(name), F.lit("]"))).otherwise(plain)


def symbol_string(scheme: str, manager: Column, package: Column, version: Column, descriptors: Column) -> Column:
    """scheme manager package version descriptors; null where a name is missing."""
    made = F.concat_ws(" ", F.lit(scheme), package_component(manager), package_component(package), package_component(version), F.array_join(descriptors, ""))
    return F.when((F.size(descriptors) > 0) & ~F.exists(descriptors, lambda d: d.isNull()), made)


def utf16_to_utf8(text: Column, units: Column) -> Column:
    """Byte offset in UTF-8 of an offset in UTF-16 units; stays in the JVM."""
    head = F.substring(F.encode(text, "UTF-16BE"), F.lit(1), units * 2)
    return F.octet_length(F.decode(head, "UTF-16BE"))
