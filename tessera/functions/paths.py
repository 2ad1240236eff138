"""Predicates and projections on slash-separated paths."""

from __future__ import annotations

import re

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Languages by extension and by file name.
LANGUAGE_BY_EXTENSION = {
    "go": "go",
    "rs": "rust",
    "py": "python",
    "java": "java",
    "kt": "kotlin",
    "kts": "kotlin",
    "swift": "swift",
    "ts": "typescript",
    "tsx": "typescript",
    "js": "javascript",
    "jsx": "javascript",
    "mjs": "javascript",
    "cjs": "javascript",
    "rb": "ruby",
    "rake": "ruby",
    "gemspec": "ruby",
    "md": "markdown",
    "markdown": "markdown",
    "json": "json",
    "xml": "xml",
    "toml": "toml",
    "yaml": "yaml",
    "yml": "yaml",
    "html": "html",
    "htm": "html",
    "css": "css",
}
LANGUAGE_BY_NAME = {"Gemfile": "ruby", "Rakefile": "ruby"}
# Directories that hold no sources of the project.
STORE_DIRECTORIES = [".git", ".tessera"]
BUILD_DIRECTORIES = ["target", "node_modules", "dist", ".next"]
GENERATED_DIRECTORIES = ["gen", "generated", "__generated__", "dist"]


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def extension(path: Column) -> Column:
    """Text after the last dot of the name; none for ".env" or "Makefile"."""
    return F.regexp_extract(path, r"[^/]\.([^./]+)$", 1)


def parent(path: Column) -> Column:
    """Directory of a path, "." at the root."""
    return F.when(F.contains(path, F.lit("/")), F.regexp_extract(path, "^(.*)/[^/]*$", 1)).otherwise(".")


def top_directory(path: Column) -> Column:
    first = F.element_at(F.split(path, "/"), 1)
    return F.when(first == "", ".").otherwise(first)


def depth(path: Column) -> Column:
    return F.size(F.split(path, "/"))


def _mapped(key: Column, table: dict[str, str]) -> Column:
    pairs = F.create_map(*[F.lit(v) for item in table.items() for v in item])
    return F.element_at(pairs, key)


def language_of(path: Column) -> Column:
    return F.coalesce(_mapped(file_name(path), LANGUAGE_BY_NAME), _mapped(extension(path), LANGUAGE_BY_EXTENSION), F.lit("text"))


def in_directories(path: Column, directories: list[str]) -> Column:
    """Any of the directories holds the path; "" and "." hold everything."""
    wanted = [d.strip("/") for d in directories]
    if not wanted or any(d in ("", ".") for d in wanted):
        return F.lit(True)
    return any_of([(path == d) | path.startswith(d + "/") for d in wanted])


def has_extension(path: Column, extensions: list[str]) -> Column:
    if not extensions:
        return F.lit(True)
    return F.lower(extension(path)).isin([e.lstrip(".").lower() for e in extensions])


def substring_scope(path: Column, include: list[str], exclude: list[str]) -> Column:
    """Some include pattern occurs in the path (or there is none), no exclude does."""
    wanted = any_of([F.contains(path, F.lit(p)) for p in include]) if include else F.lit(True)
    return wanted & ~any_of([F.contains(path, F.lit(p)) for p in exclude])


def language_scope(language: Column, languages: list[str]) -> Column:
    return F.lower(language).isin([v.lower() for v in languages]) if languages else F.lit(True)


def _has_component(path: Column, names: list[str]) -> Column:
    return F.arrays_overlap(F.split(path, "/"), F.array(*map(F.lit, names)))


def is_skipped(path: Column, no_ignore: bool = False) -> Column:
    """The path lies in a store directory, or in a build directory unless ``no_ignore``."""
    return _has_component(path, STORE_DIRECTORIES + ([] if no_ignore else BUILD_DIRECTORIES))


def generated_reason(path: Column) -> Column:
    low = F.lower(path)
    name = file_name(low)
    marked = F.contains(name, F.lit(".generated.")) | F.contains(name, F.lit(".gen."))
    return F.when(_has_component(low, GENERATED_DIRECTORIES), "generated_path").when(marked, "generated_filename")



def ignore_regex(directory: str, line: str) -> tuple[str, bool] | None:
    """(regex of the paths that a line of an ignore file in a directory means,
    whether it takes them back); none for blank lines and comments."""
    text = line.rstrip()
    if not text or text.startswith("#"):
        return None
    back, text = text.startswith("!"), text.removeprefix("!").removeprefix("\\")
    only_directories, text = text.endswith("/"), text.rstrip("/")
    anchored, text = "/" in text, text.lstrip("/")
    out, at = "", 0
    while at < len(text):
        if text.startswith("**/", at):
            out, at = out + "(?:.*/)?", at + 3
        elif text.startswith("/**", at) and at + 3 == len(text):
            out, at = out + "/.*", at + 3
        elif text[at] == "*":
            out, at = out + "[^/]*", at + 1
        elif text[at] == "?":
            out, at = out + "[^/]", at + 1
        elif text[at] == "[" and (end := text.find("]", at + 2)) > 0:
            body = text[at + 1 : end]
            out, at = out + "[" + ("^" + body[1:] if body[0] in "!^" else body).replace("\\", "\\\\").replace("[", "\\[") + "]", end + 1
        else:
            out, at = out + re.escape(text[at]), at + 1
    prefix = "" if directory in ("", ".") else re.escape(directory.strip("/")) + "/"
    return f"^{prefix}{'' if anchored else '(?:.*/)?'}{out}{'/.*' if only_directories else '(?:/.*)?'}$", back


def is_ignored(path: Column, ignore_files: list[tuple[str, str]]) -> Column:
    """Whether ignore files, as (directory, text), leave a path out: the last line
    that means it decides, those of deeper directories later."""
    ignored = F.lit(False)
    for directory, text in sorted(ignore_files, key=lambda f: (f[0].count("/") + (f[0] not in ("", ".")), f[0])):
        for line in text.splitlines():
            if rule := ignore_regex(directory, line):
                ignored = F.when(F.rlike(path, F.lit(rule[0])), not rule[1]).otherwise(ignored)
    return ignored
