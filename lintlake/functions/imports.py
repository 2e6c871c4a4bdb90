"""External modules a source file imports, computed inside the file's row."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed_values as V
from .text import first_match, let, trim_ws

_QUOTED = r"""[^'"]*['"]([^'"]*)['"]"""


def _first_quoted(text: Column) -> Column:
    return first_match(text, "(?s)^" + _QUOTED)


def package_root(module: Column) -> Column:
    """Installable root: '@scope/pkg' keeps two segments, anything else one."""
    scoped = F.startswith(module, F.lit("@"))
    return F.when(scoped, F.substring_index(module, "/", 2)).otherwise(
        F.substring_index(module, "/", 1)
    )


def _rust(line: Column) -> Column:
    rest = trim_ws(first_match(line, r"(?s)^(?:pub )?use (.*)\z"))
    head = trim_ws(F.substring_index(rest, ":", 1))
    head = trim_ws(F.rtrim(F.rtrim(head, F.lit(";")), F.lit("{")))
    return let(head, lambda h: F.when(~h.isin(V.RUST_LOCAL_HEADS), h))


def _javascript(line: Column) -> Column:
    quoted = F.coalesce(
        first_match(line, "(?s)^.*?from " + _QUOTED),
        first_match(line, r"(?s)^.*?require\(" + _QUOTED),
        F.when(F.startswith(line, F.lit("import ")), _first_quoted(line)),
    )
    return let(
        quoted,
        lambda q: F.when(
            ~F.startswith(q, F.lit(".")) & ~F.startswith(q, F.lit("/")), package_root(q)
        ),
    )


def _python(line: Column) -> Column:
    source = first_match(line, r"(?s)^from (.*)\z")
    listed = first_match(line, r"(?s)^import (.*)\z")
    head = F.coalesce(
        F.substring_index(trim_ws(source), " ", 1),
        F.substring_index(F.substring_index(trim_ws(listed), ",", 1), " ", 1),
    )
    return trim_ws(F.substring_index(head, ".", 1))


def _go(line: Column) -> Column:
    return let(
        _first_quoted(line),
        lambda path: F.when(F.contains(F.substring_index(path, "/", 1), F.lit(".")), path),
    )


def _java(line: Column) -> Column:
    rest = first_match(line, r"(?s)^import (?:static )?(.*)\z")
    return let(
        trim_ws(F.rtrim(trim_ws(rest), F.lit(";"))),
        lambda path: F.when(
            ~F.startswith(path, F.lit("java.")) & ~F.startswith(path, F.lit("javax.")),
            F.substring_index(path, ".", 2),
        ),
    )


def _ruby(line: Column) -> Column:
    return F.when(
        F.startswith(line, F.lit("require ")), let(_first_quoted(line), package_root)
    )


def imported_modules(language: Column, lines: Column) -> Column:
    """Sorted distinct external modules of a file, given its array of lines.

    Works inside the row: a file's imports never need a shuffle to be de-duplicated.
    Lines that cannot be an import are dropped before the per-language patterns run.
    """

    def extract(candidate_pattern, rule):
        wanted = F.filter(lines, lambda x: x.rlike(candidate_pattern))
        found = F.transform(F.transform(wanted, trim_ws), rule)
        return F.sort_array(F.array_distinct(F.filter(found, lambda m: m != "")))

    ws = r"^[\p{IsWhite_Space}]*"
    return (
        F.when(language == "Rust", extract(ws + "(?:pub )?use ", _rust))
        .when(
            language.isin("JavaScript", "TypeScript"),
            extract(r"from |require\(|" + ws + "import ", _javascript),
        )
        .when(language == "Python", extract(ws + "(?:from|import) ", _python))
        .when(language == "Go", extract(r"""['"]""", _go))
        .when(language == "Java", extract(ws + "import ", _java))
        .when(language == "Ruby", extract(ws + "require ", _ruby))
        .otherwise(F.array().cast("array<string>"))
    )


def path_idents(content: Column) -> Column:
    """Distinct identifiers written as 'name::' at an identifier boundary."""
    return F.array_distinct(
        F.regexp_extract_all(content, F.lit(r"(?<![\p{IsAlphabetic}\p{N}_])([A-Za-z0-9_]+)::"), F.lit(1))
    )
