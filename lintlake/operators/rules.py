"""Scan rules: the built-in set, the switches, and the extension registry."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed_values as V
from ..functions.codelines import (
    marker_note,
    marker_on,
    marker_severity,
    may_hold_marker,
    may_hold_sink,
    sink_label,
)
from ..functions.secrets import may_hold_secret, secret_kind
from ..functions.text import let, split_lines
from ..schemas import FINDING_COLUMNS, FINDINGS
from ..sources.corpus import explode_lines
from .duplicates import REPEATS, with_repeats


@dataclass(frozen=True)
class ScanConfig:
    """Rule switches and sizes; everything is on by default."""

    secret_detection: bool = True
    dangerous_commands: bool = True
    large_files: bool = True
    todo_tracker: bool = True
    duplicate_code: bool = True
    large_file_threshold: int = V.LARGE_FILE_LINES
    block_size: int = V.DUPLICATE_BLOCK
    ignore: tuple[str, ...] = ()
    extra_rules: tuple[str, ...] = ()


# What one rule reports inside a file's row.
_HIT = (
    "struct<rule: string, title: string, category: string, severity: string, line_no: int, "
    "message: string, suggestion: string, lines: int>"
)
_HITS = f"array<{_HIT}>"

# User rules: name -> function from the ``files`` table to a findings table.
_REGISTRY: dict[str, Callable[[DataFrame], DataFrame]] = {}


def register_rule(name: str, rule: Callable[[DataFrame], DataFrame]) -> None:
    """Make a rule available to ``ScanConfig(extra_rules=(name,))``."""
    if name in V.RULES or name in _REGISTRY:
        raise ValueError(f"rule {name!r} already exists")
    _REGISTRY[name] = rule


def unregister_rule(name: str) -> None:
    _REGISTRY.pop(name, None)


def rule_ids() -> list[str]:
    """Built-in scan rules in order, then registered ones."""
    return [r for r in V.RULES if r != "race-condition"] + list(_REGISTRY)


def _hit(
    rule: str, severity: Column, message: Column, line_no: Column, title: Column | None = None
) -> Column:
    fixed_title, category, suggestion = V.RULES[rule]
    return F.struct(
        F.lit(rule).alias("rule"),
        (title if title is not None else F.lit(fixed_title)).alias("title"),
        F.lit(category).alias("category"),
        severity.alias("severity"),
        line_no.alias("line_no"),
        message.alias("message"),
        F.lit(suggestion).cast("string").alias("suggestion"),
        F.lit(None).cast("int").alias("lines"),
    )


def _secret_hit(text, language, line_no):
    return let(
        secret_kind(text, language),
        lambda kind: F.when(
            kind.isNotNull(),
            _hit("hardcoded-secret", F.lit("CRITICAL"), F.concat(kind, F.lit(V.SECRET_MESSAGE)), line_no),
        ),
    )


def _command_hit(text, language, line_no):
    return let(
        sink_label(text, language),
        lambda sink: F.when(
            sink.isNotNull(),
            _hit("dangerous-command", F.lit("HIGH"), F.concat(sink, F.lit(V.COMMAND_MESSAGE)), line_no),
        ),
    )


def _marker_hit(text, line_no):
    def message(marker):
        return let(
            marker_note(text, marker),
            lambda note: F.when(note == "", F.concat(marker, F.lit(" marker"))).otherwise(
                F.concat(marker, F.lit(": "), note)
            ),
        )

    return let(
        marker_on(text),
        lambda marker: F.when(
            marker.isNotNull(),
            _hit(
                "todo-tracker", marker_severity(marker), message(marker), line_no,
                F.concat(marker, F.lit(" comment")),
            ),
        ),
    )


def _large_file_hit(large, lines, limit):
    message = F.concat(
        lines.cast("string"), F.lit(f" lines (threshold {limit}{V.LARGE_FILE_MESSAGE}")
    )
    return F.when(large, _hit("large-file", F.lit("WARNING"), message, F.lit(0)))


def _duplicate_hits(repeats, size):
    def hit(r):
        message = F.concat(
            F.lit(f"{size}-line block duplicates one starting at line "),
            r["first_line"].cast("string"),
            F.lit(V.DUPLICATE_MESSAGE),
        )
        return _hit("duplicate-code", F.lit("INFO"), message, r["line_no"])

    return F.transform(repeats, hit)


def _one_pass(files: DataFrame, config: ScanConfig, file_rows: bool) -> DataFrame:
    """All built-in rules in one pass over the corpus, without a shuffle.

    Each file becomes one row per line plus a row 0 that stands for the whole file and
    carries its repeated blocks. Substring tests drop most lines first; the regular
    expressions run on the rest. Disabled rules never enter the plan. With
    ``file_rows`` every file also yields a row without a rule that holds its line count.
    """
    text, language, line_no = F.col("text"), F.col("language"), F.col("line_no")
    guards, hits, lists = [], [], []
    if config.secret_detection:
        guards.append(may_hold_secret(text))
        hits.append(_secret_hit(text, language, line_no))
    if config.dangerous_commands:
        guards.append(may_hold_sink(text, language))
        hits.append(_command_hit(text, language, line_no))
    if config.large_files:
        limit = max(config.large_file_threshold, 1)
        large = (line_no == 0) & (F.col("lines") > limit)
        guards.append(large)
        hits.append(_large_file_hit(large, F.col("lines"), limit))
    if config.todo_tracker:
        guards.append(may_hold_marker(text))
        hits.append(_marker_hit(text, line_no))
    content = F.col("content")
    if config.duplicate_code:
        size = max(config.block_size, 2)
        files = with_repeats(files, size)
        whole = F.struct(F.lit("").alias("text"), F.col("repeats"))
        nothing = F.lit(None).cast(REPEATS).alias("repeats")
        parts = F.concat(
            F.array(whole), F.transform(split_lines(content), lambda t: F.struct(t.alias("text"), nothing))
        )
        guards.append(F.col("repeats").isNotNull())
        lists.append(F.coalesce(_duplicate_hits(F.col("repeats"), size), F.array().cast(_HITS)))
    else:
        parts = F.concat(F.array(F.lit("")), split_lines(content))
    if file_rows:
        guards.append(line_no == 0)
        file_row = F.from_json(F.lit("{}"), _HIT).withField("lines", F.col("lines"))
        hits.append(F.when(line_no == 0, file_row))
    if not guards:
        return files.sparkSession.createDataFrame([], f"{FINDINGS}, lines INT")

    # Every file has row 0. The outer form only keeps the optimizer from computing the array twice, once to test its size.
    parted = F.posexplode_outer(parts).alias("line_no", "part")
    rows = files.select("project", "path", "language", "lines", parted)
    if config.duplicate_code:
        rows = rows.select("project", "path", "language", "lines", "line_no", "part.*")
    else:
        rows = rows.withColumnRenamed("part", "text")
    found = F.concat(F.array_compact(F.array(*hits)) if hits else F.array().cast(_HITS), *lists)
    hit = rows.where(reduce(lambda a, b: a | b, guards)).select("project", "path", F.inline_outer(found))
    return hit.where(F.col("rule").isNotNull() | F.col("lines").isNotNull())


def line_findings(files: DataFrame, config: ScanConfig = ScanConfig()) -> DataFrame:
    """Findings of the enabled rules except duplicate blocks; also works on a stream."""
    return _one_pass(files, replace(config, duplicate_code=False), False).select(*FINDING_COLUMNS)


def scan_rows(files: DataFrame, config: ScanConfig = ScanConfig()) -> DataFrame:
    """Findings of all enabled rules, and one row per file with its line count.

    The file rows have no rule; scores and statistics come out of this one pass.
    """
    rows = _one_pass(files, config, True)
    columns = [*FINDING_COLUMNS, "lines"]
    return _with_extra_rules(rows.select(*columns), files, config)


def _with_extra_rules(rows: DataFrame, files: DataFrame, config: ScanConfig) -> DataFrame:
    for name in config.extra_rules:
        extra = _REGISTRY[name](files).select(*FINDING_COLUMNS)
        rows = rows.unionByName(extra, allowMissingColumns=True)
    return rows


def scan_findings(files: DataFrame, config: ScanConfig = ScanConfig()) -> DataFrame:
    """All findings of the enabled built-in and registered rules."""
    found = _one_pass(files, config, False).select(*FINDING_COLUMNS)
    return _with_extra_rules(found, files, config)


def line_rule(
    name: str, title: str, category: str, severity: str,
    hits: Callable[[Column, Column], Column], message: Callable[[Column], Column], suggestion: str | None = None,
) -> Callable[[DataFrame], DataFrame]:
    """A rule on single lines made of Columns, the fast path: no line leaves the JVM and none is shuffled.

    ``hits(text, language)`` tells whether a line is reported, ``message(text)`` what with. A NULL is no hit.
    """

    def rule(files: DataFrame) -> DataFrame:
        text = F.col("text")
        return explode_lines(files).where(hits(text, F.col("language"))).select(
            "project", F.lit(name).alias("rule"), F.lit(title).alias("title"), F.lit(category).alias("category"),
            F.lit(severity).alias("severity"), "path", "line_no", message(text).alias("message"),
            F.lit(suggestion).cast("string").alias("suggestion"),
        )

    return rule


def python_rule(check: Callable[[str, str, str], Iterable[dict]]) -> Callable[[DataFrame], DataFrame]:
    """Turn a per-file Python function into a rule.

    ``check(path, language, content)`` yields dicts with the finding columns except
    project and path; a missing ``suggestion`` is NULL. It becomes a table function of the
    declared schema, joined laterally to the files where they are, so a custom rule needs no
    shuffle either. Rules that Columns can express are faster as ``line_rule``.
    """
    own = [c for c in FINDING_COLUMNS if c not in ("project", "path")]
    schema = ", ".join(part for part in FINDINGS.split(", ") if part.split()[0] in own)

    class Check:
        def eval(self, path: str, language: str, content: str):
            for found in check(path, language, content):
                yield tuple(found.get(c) for c in own)

    findings = F.udtf(Check, returnType=schema, useArrow=True)

    def rule(files: DataFrame) -> DataFrame:
        inputs = [F.col(c).outer() for c in ("path", "language", "content")]
        placed = files.select("project", "path", "language", "content")
        return placed.lateralJoin(findings(*inputs)).select(*FINDING_COLUMNS)

    return rule
