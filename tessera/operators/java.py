"""Facts of Java sources and what is resolved from them: packages, imports, types,
fields, methods, calls with the types of receiver and arguments, qualified names,
and the edges of a type-aware call graph."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators.calls import Call, Token, calls, closing, scan

FACTS = "path string, fact string, owner string, name string, kind string, type string, parameters array<string>, arguments array<string>, receiver string, receiver_type string, line int"

# Words of the language that are no types or names.
MODIFIERS = set("public private protected static final abstract native synchronized transient volatile strictfp default sealed".split())
TYPE_WORDS = ("class", "interface", "enum", "record")
NOT_CALLS = set("if for while switch catch return new super this throw synchronized try assert else do case".split())
PRIMITIVES = set("int long short byte char boolean float double void".split())


def erased(tokens: list[Token]) -> str:
    """A type without annotations, modifiers, generic arguments and spaces."""
    out, depth, inside, skip = [], 0, 0, False
    for t in tokens:
        if t.text in "()":  # arguments of an annotation
            inside += 1 if t.text == "(" else -1
        elif inside:
            continue
        elif t.text == "@":
            skip = True
        elif skip:
            skip = False
        elif t.text == "<":
            depth += 1
        elif t.text == ">":
            depth -= 1
        elif not depth and t.text not in MODIFIERS:
            out.append(t.text)
    return "".join(out)


def _split(tokens: list[Token]) -> list[list[Token]]:
    """Pieces between commas outside brackets of any kind."""
    pieces, piece, depth = [], [], 0
    for t in tokens:
        depth += (t.text in "(<[{") - (t.text in ")>]}") if t.kind == "mark" else 0
        if t.text == "," and not depth:
            pieces.append(piece)
            piece = []
        else:
            piece.append(t)
    return [p for p in [*pieces, piece] if p]


class _Reader:
    def __init__(self, text: str):
        self.text, self.tokens = text, scan(text, "java")
        self.close, self.rows, self.fields = closing(self.tokens), [], {}
        self.calls = {c.start: c for c in calls(self.tokens)}
        self.breaks = [i for i, c in enumerate(text) if c == "\n"]

    def line(self, at: int) -> int:
        from bisect import bisect_left

        return bisect_left(self.breaks, self.tokens[at].start) + 1

    def add(self, at: int, fact: str, owner: str | None, name: str, kind: str | None = None, type_: str | None = None, parameters=None, arguments=None, receiver=None, receiver_type=None) -> None:
        self.rows.append((fact, owner, name, kind, type_, parameters, arguments, receiver, receiver_type, self.line(at)))

    def unit(self) -> list[tuple]:
        i = 0
        while i < len(self.tokens):
            word = self.tokens[i].text
            if word in ("package", "import"):
                end = next((k for k in range(i, len(self.tokens)) if self.tokens[k].text == ";"), len(self.tokens))
                self.add(i, word, None, "".join(t.text for t in self.tokens[i + 1 : end] if t.text != "static"))
                i = end
            elif word in TYPE_WORDS and i + 1 < len(self.tokens) and self.tokens[i + 1].kind == "name":
                i = self.type(i, None)
            i += 1
        return self.rows

    def type(self, at: int, outer: str | None) -> int:
        """A type that begins at its keyword; returns where its body ends."""
        name = f"{outer}.{self.tokens[at + 1].text}" if outer else self.tokens[at + 1].text
        self.add(at + 1, "type", outer, name, "annotation" if self.tokens[at - 1].text == "@" else self.tokens[at].text)
        brace = at + 2
        while brace < len(self.tokens) and self.tokens[brace].text not in ("{", ";"):
            if self.tokens[brace].text == "(" and self.tokens[at].text == "record":
                for part in _split(self.tokens[brace + 1 : self.close.get(brace, brace)]):
                    self.field(name, brace, part[:-1], part[-1].text)
            brace = self.close.get(brace, brace) + 1
        head, word, piece = self.tokens[at + 2 : brace], None, []
        for t in [*head, Token("name", "implements", 0, 0)]:
            if t.text in ("extends", "implements", "permits"):
                for part in _split(piece) if word in ("extends", "implements") else []:
                    self.add(at, "supertype", name, erased(part), word)
                word, piece = t.text, []
            else:
                piece.append(t)
        end = self.close.get(brace, len(self.tokens) - 1)
        self.members(name, brace + 1, end, self.tokens[at].text == "enum")
        return end

    def field(self, owner: str, at: int, kind: list[Token], name: str) -> None:
        self.fields.setdefault(owner, {})[name] = erased(kind)
        self.add(at, "field", owner, name, "field", erased(kind))

    def members(self, owner: str, at: int, end: int, constants: bool) -> None:
        bodies = []
        if constants:  # up to the first semicolon
            at = next((k + 1 for k in range(at, end) if self.tokens[k].text == ";"), end)
        first = at
        while at < end:
            t = self.tokens[at]
            if t.text in TYPE_WORDS and self.tokens[at + 1].kind == "name" and self.tokens[at - 1].text != ".":
                at = first = self.type(at, owner) + 1
            elif t.text == "@" and at + 2 < end and self.tokens[at + 2].text == "(":
                at = self.close.get(at + 2, at + 2) + 1
            elif t.text == "(" and self.tokens[at - 1].kind == "name":
                shut = self.close.get(at, at)
                stop = next((k for k in range(shut, end) if self.tokens[k].text in ("{", ";")), end)
                name, kind = self.tokens[at - 1].text, erased(self.tokens[first : at - 1])
                made = not kind and name == owner.rpartition(".")[2]
                parameters = [(p[-1].text, erased(p[:-1]).replace("...", "[]")) for p in _split(self.tokens[at + 1 : shut])]
                self.add(at - 1, "method", owner, "<init>" if made else name, "constructor" if made else "method", None if made else kind, [k for _, k in parameters])
                if stop < end and self.tokens[stop].text == "{":
                    bodies.append((f"{owner}.{'<init>' if made else name}", owner, stop, self.close.get(stop, end), dict(parameters)))
                    stop = self.close.get(stop, end)
                at = first = stop + 1
            elif t.text == "{":
                at = first = self.close.get(at, end) + 1
            elif t.text in ("=", ";"):
                stop = next((k for k in self._outside(at, end) if self.tokens[k].text == ";"), end)
                parts = _split(self.tokens[first:stop])
                for k, part in enumerate(parts):
                    names = part[: next((n for n, x in enumerate(part) if x.text == "="), len(part))]
                    if k == 0:
                        kind = names[:-1]
                    if names and names[-1].kind == "name" and erased(kind):
                        self.field(owner, first, kind, names[-1].text)
                at = first = stop + 1
            else:
                at += 1
        for body in bodies:
            self.body(*body)

    def _outside(self, at: int, end: int) -> Iterator[int]:
        while at < end:
            yield at
            at = self.close.get(at, at) + 1

    def body(self, method: str, owner: str, at: int, end: int, known: dict[str, str]) -> None:
        known = {**self.fields.get(owner, {}), **known}
        for k in range(at + 1, end):
            t, before = self.tokens[k], self.tokens[k - 1]
            if t.kind == "name" and self.tokens[k + 1].text in ("=", ";", ":") and (before.kind == "name" and before.text not in NOT_CALLS or before.text == ">"):
                a = k - 1
                while before.text == ">" and a > at and self.tokens[a].text != "<":
                    a -= 1
                a -= before.text == ">"
                known[t.text] = self.tokens[a].text
            call = self.calls.get(t.start)
            if call and t.kind == "name" and not call.marked:
                self.call(method, owner, k, call, known)

    def call(self, method: str, owner: str, at: int, call: Call, known: dict[str, str]) -> None:
        arguments = [self.guess(a, owner, known) for a in call.args]
        if at and self.tokens[at - 1].text == "new":
            self.add(at, "call", method, "<init>", "constructor", None, None, arguments, "new", call.name)
        elif call.name not in NOT_CALLS:
            receiver = call.receiver
            tail = receiver.removeprefix("this.")
            kind = owner if receiver in ("", "this") else known.get(tail) or (tail if tail[:1].isupper() else None)
            self.add(at, "call", method, call.name, "method", None, None, arguments, receiver or None, kind)

    def guess(self, arg: list[Token], owner: str, known: dict[str, str]) -> str | None:
        first = arg[0]
        if first.kind == "string":
            return "char" if first.text[0] == "'" else "String"
        if first.text == "new" and len(arg) > 1:
            return arg[1].text
        if len(arg) == 1:
            simple = {"true": "boolean", "false": "boolean", "this": owner}
            if first.text.isdigit():
                return "int"
            return simple.get(first.text) or known.get(first.text)
        return None


def facts_of(text: str) -> list[tuple]:
    """Rows of FACTS without the path, in source order of types and members."""
    return _Reader(text).unit()


def extract_java(files: DataFrame) -> DataFrame:
    """FACTS of Java files (path, language, content)."""
    wanted = files.where("language = 'java'").select("path", "content")

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = pa.list_(pa.string())
        kinds = [*[pa.string()] * 6, words, words, pa.string(), pa.string(), pa.int32()]
        for part in parts:
            rows = [(path, *row) for path, text in zip(*(c.to_pylist() for c in part.columns)) for row in facts_of(text or "")]
            columns = list(zip(*rows)) or [[]] * 11
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], [f.split()[0] for f in FACTS.split(", ")])

    return wanted.mapInArrow(run, FACTS)


def members(facts: DataFrame) -> DataFrame:
    """(owner, name, arity, kind, overloads): a type's fields, and its methods by
    name and number of parameters with how many there are of each."""
    found = facts.where(F.col("fact").isin("field", "method"))
    arity = F.when(F.col("fact") == "method", F.size("parameters"))
    return found.groupBy("owner", "name", arity.alias("arity"), "kind").agg(F.count(F.lit(1)).alias("overloads"))


# -- names of types


def erase_generics(name: Column) -> Column:
    """A type without what stands in angle brackets, and without spaces."""
    return F.regexp_replace(F.regexp_replace(name, "<.*>", ""), r"\s+", "")


def simple_type(name: Column) -> Column:
    """Last identifier of an erased type."""
    return F.regexp_extract(erase_generics(name), r"([A-Za-z_$][\w$]*)[\[\].]*$", 1)


# Types that need no import.
ALWAYS_THERE = ["Object", "String", "Integer", "Long", "Boolean", "Double", "Float", "Short", "Byte", "Character", "Number", "Math", "System", "Thread", "Runnable", "Iterable", "Comparable", "Exception", "RuntimeException", "Override"]


def qualify(uses: DataFrame, imports: DataFrame, packages: DataFrame) -> DataFrame:
    """Adds qualified to uses (path, type): the single import (path, name) that ends
    in the type's simple name, else java.lang, else the package (path, name) of the
    file, else the simple name.  Dotted and primitive types stay as they are."""
    simple = simple_type(F.col("type"))
    named = imports.where("name NOT LIKE '%*'").select("path", F.substring_index("name", ".", -1).alias("__s"), F.col("name").alias("__i")).groupBy("path", "__s").agg(F.min("__i").alias("__i"))
    own = packages.groupBy("path").agg(F.min("name").alias("__p"))
    found = uses.withColumn("__s", simple).join(named, ["path", "__s"], "left").join(own, "path", "left")
    plain = erase_generics(F.col("type"))
    whole = F.when(F.contains(plain, F.lit(".")) | plain.isin(sorted(PRIMITIVES)), plain).when(F.col("__i").isNotNull(), F.col("__i"))
    whole = whole.when(F.col("__s").isin(ALWAYS_THERE), F.concat(F.lit("java.lang."), "__s")).when(F.col("__p").isNotNull(), F.concat_ws(".", "__p", "__s")).otherwise(F.col("__s"))
    return found.withColumn("qualified", whole).drop("__s", "__i", "__p")


# -- edges


def remap_symbols(symbols: DataFrame, precise: DataFrame) -> DataFrame:
    """symbols (symbol, path, name, start_line, ...) under the ids of precise rows
    (symbol, path, name, start_line) at the same place; others keep their own."""
    p = precise.groupBy("path", "name", "start_line").agg(F.min("symbol").alias("__p"))
    joined = symbols.join(p, ["path", "name", "start_line"], "left")
    return joined.withColumns({"remapped": F.col("__p").isNotNull(), "symbol": F.coalesce("__p", "symbol")}).drop("__p")


def incoming(edges: DataFrame, callees: DataFrame, possible: DataFrame) -> DataFrame:
    """Edges (edge_id, callee_id, ...) that reach the matched nodes (id), directly or
    as one of the possible callees (edge_id, callee_id) of a virtual call."""
    wanted = callees.select(F.col("id").alias("callee_id"))
    through = possible.join(wanted, "callee_id", "left_semi").select("edge_id")
    direct = edges.join(wanted, "callee_id", "left_semi").select("edge_id")
    return edges.join(direct.unionByName(through).distinct(), "edge_id", "left_semi")


def callers_by_name(edges: DataFrame, names: DataFrame) -> DataFrame:
    """Unresolved edges (callee_id null) whose raw target is one of the names (name)."""
    return edges.where(F.col("callee_id").isNull()).join(names.select(F.col("name").alias("target")), "target", "left_semi")


def with_overrides(edges: DataFrame, possible: DataFrame) -> DataFrame:
    """Edges and, for each, one edge more to every other possible callee."""
    more = edges.join(possible.select("edge_id", F.col("callee_id").alias("__c")), "edge_id").where(~F.col("__c").eqNullSafe(F.col("callee_id")))
    return edges.unionByName(more.withColumn("callee_id", F.col("__c")).drop("__c")).distinct()
