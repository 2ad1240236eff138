"""Occurrence index files in protobuf wire format, decoded in tasks.

Only the fields an occurrence store needs are read; the format's own field
numbers are fixed values.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.identifiers import KIND_NUMBERS
from tessera.sources.occurrences import from_documents

# Field numbers of the messages.
INDEX_DOCUMENT = 2
DOCUMENT = {"relative_path": 1, "occurrences": 2, "symbols": 3, "language": 4}
OCCURRENCE = {"range": 1, "symbol": 2, "symbol_roles": 3}
SYMBOL = {"symbol": 1, "kind": 5, "display_name": 6}

_DOCUMENTS = """relative_path string, language string, symbols array<struct<symbol:string,display_name:string,kind:string>>,
    occurrences array<struct<symbol:string,range:array<int>,symbol_roles:int>>"""


def varint(data: memoryview, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        byte = data[at]
        value |= (byte & 127) << shift
        at, shift = at + 1, shift + 7
        if byte < 128:
            return value, at
        if shift > 63:
            raise ValueError("a number of the message is too long")


def fields(data: memoryview) -> Iterator[tuple[int, int | memoryview]]:
    """(number, value) of a message's fields: numbers, or bytes."""
    at = 0
    while at < len(data):
        key, at = varint(data, at)
        kind = key & 7
        if kind == 0:
            value, at = varint(data, at)
        elif kind in (1, 5):
            size = 8 if kind == 1 else 4
            value, at = int.from_bytes(data[at : at + size], "little"), at + size
        elif kind == 2:
            size, at = varint(data, at)
            if at + size > len(data):
                raise ValueError("the message ends early")
            value, at = data[at : at + size], at + size
        else:
            raise ValueError(f"unknown wire type {kind}")
        yield key >> 3, value


def _text(value: memoryview) -> str:
    return bytes(value).decode("utf-8", "replace")


def _numbers(value: int | memoryview) -> list[int]:
    """A repeated number, packed or not."""
    if isinstance(value, int):
        return [value]
    out, at = [], 0
    while at < len(value):
        number, at = varint(value, at)
        out.append(number)
    return out


def _occurrence(data: memoryview) -> dict:
    found = {"symbol": "", "range": [], "symbol_roles": 0}
    for number, value in fields(data):
        if number == OCCURRENCE["range"]:
            found["range"] += _numbers(value)
        elif number == OCCURRENCE["symbol"]:
            found["symbol"] = _text(value)
        elif number == OCCURRENCE["symbol_roles"]:
            found["symbol_roles"] = value
    return found


def _symbol(data: memoryview) -> dict:
    found = {"symbol": "", "display_name": None, "kind": "symbol"}
    for number, value in fields(data):
        if number == SYMBOL["symbol"]:
            found["symbol"] = _text(value)
        elif number == SYMBOL["kind"]:
            found["kind"] = KIND_NUMBERS.get(value, "symbol")
        elif number == SYMBOL["display_name"]:
            found["display_name"] = _text(value) or None
    return found


def documents_of(data: bytes) -> Iterator[tuple[str, str, list[dict], list[dict]]]:
    """(relative_path, language, symbols, occurrences) of each document of an index."""
    for number, value in fields(memoryview(data)):
        if number != INDEX_DOCUMENT:
            continue
        path, language, symbols, occurrences = "", "", [], []
        for part, inner in fields(value):
            if part == DOCUMENT["relative_path"]:
                path = _text(inner)
            elif part == DOCUMENT["language"]:
                language = _text(inner).lower()
            elif part == DOCUMENT["occurrences"]:
                occurrences.append(_occurrence(inner))
            elif part == DOCUMENT["symbols"]:
                symbols.append(_symbol(inner))
        yield path, language, symbols, occurrences


def read_wire(spark: SparkSession, path: str) -> DataFrame:
    """Documents of index files: relative_path, language, symbols, occurrences."""
    read = spark.read.format("binaryFile").load(path).select("content")
    kinds = [
        pa.string(), pa.string(), pa.list_(pa.struct([("symbol", pa.string()), ("display_name", pa.string()), ("kind", pa.string())])),
        pa.list_(pa.struct([("symbol", pa.string()), ("range", pa.list_(pa.int32())), ("symbol_roles", pa.int32())])),
    ]

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for content in part.column(0).to_pylist():
                for row in documents_of(content):
                    yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds)], ["relative_path", "language", "symbols", "occurrences"])

    return read.mapInArrow(run, _DOCUMENTS)


def import_wire(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(occurrences, symbol mentions) of index files."""
    return from_documents(read_wire(spark, path))


def occurrence_store(occurrences: DataFrame, mentions: DataFrame, files: DataFrame) -> dict[str, DataFrame]:
    """The tables of an occurrence store: distinct occurrences, one row a symbol
    with its match keys, and the hashes of the files they were found in."""
    from tessera.operators import symbols

    distinct = symbols.distinct_occurrences(occurrences)
    hashes = files.join(distinct.select("path").distinct(), "path", "left_semi").select("path", "hash")
    return {"occurrences": distinct, "symbols": symbols.with_match_keys(symbols.upsert_symbols(mentions)), "proofs": hashes.withColumn("line_offsets", F.lit(None).cast("array<int>"))}
