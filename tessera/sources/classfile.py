"""Symbols of JVM class files and of archives that hold them, read in tasks."""

from __future__ import annotations

import io
import struct
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

SYMBOLS = "archive string, entry string, owner string, fact string, name string, type string, parameters array<string>, access int"
MAGIC = 0xCAFEBABE
#: Caps on archives: entries, and bytes of one entry and of all.
MAX_ENTRIES, MAX_ENTRY_BYTES, MAX_BYTES = 200_000, 10 << 20, 1 << 30

# Sizes of constants by tag, and names of primitive types in descriptors.
_SIZES = {3: 4, 4: 4, 5: 8, 6: 8, 7: 2, 8: 2, 9: 4, 10: 4, 11: 4, 12: 4, 15: 3, 16: 2, 17: 4, 18: 4, 19: 2, 20: 2}
_TYPES = {"B": "byte", "C": "char", "D": "double", "F": "float", "I": "int", "J": "long", "S": "short", "Z": "boolean", "V": "void"}


def type_of(text: str, at: int = 0) -> tuple[str, int]:
    """Name of the type that begins at a place of a descriptor, and where it ends."""
    depth = 0
    while text[at] == "[":
        depth, at = depth + 1, at + 1
    if text[at] == "L":
        end = text.index(";", at)
        name, at = text[at + 1 : end].replace("/", "."), end + 1
    else:
        name, at = _TYPES[text[at]], at + 1
    return name + "[]" * depth, at


def signature(descriptor: str) -> tuple[list[str], str]:
    """(parameter types, return type) of a method's descriptor."""
    parameters, at = [], 1
    while descriptor[at] != ")":
        name, at = type_of(descriptor, at)
        parameters.append(name)
    return parameters, type_of(descriptor, at + 1)[0]


class _Input:
    def __init__(self, data: bytes):
        self.data, self.at = data, 0

    def take(self, form: str) -> int:
        (value,) = struct.unpack_from(">" + form, self.data, self.at)
        self.at += struct.calcsize(form)
        return value

    def skip(self, count: int) -> None:
        if self.at + count > len(self.data):
            raise ValueError("the class file ends early")
        self.at += count


def symbols_of(data: bytes) -> Iterator[tuple]:
    """(owner, fact, name, type, parameters, access): the class, its supertypes,
    fields and methods."""
    source = _Input(data)
    if source.take("I") != MAGIC:
        raise ValueError("no class file")
    source.skip(4)
    texts: dict[int, str] = {}
    classes: dict[int, int] = {}
    count, n = source.take("H"), 1
    while n < count:
        tag = source.take("B")
        if tag == 1:
            size = source.take("H")
            texts[n] = data[source.at : source.at + size].decode("utf-8", "replace")
            source.skip(size)
        elif tag == 7:
            classes[n] = source.take("H")
        elif tag in _SIZES:
            source.skip(_SIZES[tag])
        else:
            raise ValueError(f"unknown constant {tag}")
        n += 2 if tag in (5, 6) else 1
    named = lambda k: texts[classes[k]].replace("/", ".")
    access, own, parent = source.take("H"), source.take("H"), source.take("H")
    owner = named(own)
    kind = "annotation" if access & 0x2000 else "enum" if access & 0x4000 else "interface" if access & 0x200 else "class"
    yield owner, "type", owner, kind, None, access
    if parent and kind in ("class", "enum"):
        yield owner, "supertype", named(parent), "extends", None, 0
    for _ in range(source.take("H")):
        yield owner, "supertype", named(source.take("H")), "implements", None, 0
    for fact in ("field", "method"):
        for _ in range(source.take("H")):
            access, name, form = source.take("H"), texts[source.take("H")], texts[source.take("H")]
            for _ in range(source.take("H")):
                source.skip(2)
                source.skip(source.take("I"))
            if not access & 0x1000 and name != "<clinit>":  # neither synthetic nor the class's own start
                if fact == "field":
                    yield owner, fact, name, type_of(form)[0], None, access
                else:
                    parameters, result = signature(form)
                    yield owner, fact, name, result, parameters, access


def class_files(name: str, data: bytes) -> Iterator[tuple[str, bytes]]:
    """(entry, content) of a class file or of an archive's class files, within the caps."""
    if data[:4] == MAGIC.to_bytes(4, "big"):
        yield name.rsplit("/", 1)[-1], data
        return
    with zipfile.ZipFile(io.BytesIO(data)) as archive:
        entries = archive.infolist()
        if len(entries) > MAX_ENTRIES or sum(e.file_size for e in entries) > MAX_BYTES:
            raise ValueError(f"{name} is too large")
        for entry in entries:
            if entry.filename.endswith(".class") and not entry.filename.startswith("META-INF/versions/") and entry.file_size <= MAX_ENTRY_BYTES:
                yield entry.filename, archive.read(entry)


def read_classpath(spark: SparkSession, path: str) -> DataFrame:
    """SYMBOLS of class files and archives below a path; a file that can't be read
    gives one row with fact "unreadable"."""
    read = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{class,jar,zip}").load(path).select("path", "content")

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [*[pa.string()] * 6, pa.list_(pa.string()), pa.int32()]
        for part in parts:
            rows: list[tuple] = []
            for name, content in zip(*(c.to_pylist() for c in part.columns)):
                try:
                    rows += [(name, entry, *row) for entry, data in class_files(name, content) for row in symbols_of(data)]
                except (ValueError, KeyError, IndexError, struct.error, zipfile.BadZipFile):
                    rows.append((name, None, None, "unreadable", None, None, None, 0))
            columns = list(zip(*rows)) or [[]] * 8
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], [f.split()[0] for f in SYMBOLS.split(", ")])

    return read.mapInArrow(run, SYMBOLS)
