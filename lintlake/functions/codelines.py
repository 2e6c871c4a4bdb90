"""Line heuristics: command sinks, markers, shared-state updates, injection."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed_values as V
from .text import (
    ascii_lower,
    contains_any,
    is_comment,
    let,
    lower_contains_any,
    rtrim_ws,
    trim_ws,
)


def may_hold_sink(text: Column, language: Column) -> Column:
    """Cheap test with only the needles that apply to the file's language."""
    by_language: dict[str | None, list[str]] = {}
    for needle, lang, _ in V.SINKS:
        by_language.setdefault(lang, []).append(needle)
    out = contains_any(text, by_language.pop(None))
    for lang, needles in by_language.items():
        out = out | ((language == lang) & contains_any(text, needles))
    return out


def sink_label(text: Column, language: Column) -> Column:
    """Label of the first dangerous call on a non-comment line, or NULL."""
    chain = None
    for needle, lang, label in V.SINKS:
        cond = F.contains(text, F.lit(needle))
        if lang is not None:
            cond = (language == lang) & cond
        chain = F.when(cond, F.lit(label)) if chain is None else chain.when(cond, F.lit(label))
    return F.when(~is_comment(text, language), chain)


def _marker_pattern(marker: str) -> str:
    return f"(?<![A-Za-z0-9]){marker}(?![A-Za-z0-9])"


def may_hold_marker(text: Column) -> Column:
    return contains_any(text, [marker for marker, _ in V.MARKERS])


def marker_on(text: Column) -> Column:
    """First leftover marker that stands alone on the line, or NULL."""
    chain = None
    for marker, _ in V.MARKERS:
        cond = F.contains(text, F.lit(marker)) & text.rlike(_marker_pattern(marker))
        chain = F.when(cond, F.lit(marker)) if chain is None else chain.when(cond, F.lit(marker))
    return chain


def marker_severity(marker: Column) -> Column:
    chain = None
    for name, severity in V.MARKERS:
        cond = marker == name
        chain = F.when(cond, F.lit(severity)) if chain is None else chain.when(cond, F.lit(severity))
    return chain


def marker_note(text: Column, marker: Column) -> Column:
    """Text after the marker, without leading ': -)' and surrounding white space."""
    chain = None
    for name, _ in V.MARKERS:
        note = F.regexp_extract(text, "(?s)" + _marker_pattern(name) + r"[: \-)]*(.*)\z", 1)
        cond = marker == name
        chain = F.when(cond, note) if chain is None else chain.when(cond, note)
    return trim_ws(chain)


def trailing_name(text: Column) -> Column:
    """Identifier that ends the text ('' when none).

    Reversed so that the match is anchored and linear.
    """
    return F.reverse(F.regexp_extract(F.reverse(rtrim_ws(text)), "^[A-Za-z0-9_]+", 0))


def _compound_target(low: Column) -> Column:
    tries = [
        F.when(
            F.contains(low, F.lit(op)),
            let(
                trailing_name(F.substring_index(low, op, 1)),
                lambda name: F.when(name.isin(V.STATEFUL_NAMES), name),
            ),
        )
        for op in V.COMPOUND_OPS
    ]
    return F.coalesce(*tries)


def _plain_target(low: Column) -> Column:
    def judged(left: Column) -> Column:
        right = F.substr(low, F.length(left) + 2)
        changes = F.contains(right, F.lit("-")) | F.contains(right, F.lit("+"))
        return let(
            trailing_name(left),
            lambda name: F.when(
                name.isin(V.STATEFUL_NAMES) & F.contains(right, name) & changes, name
            ),
        )

    return let(F.regexp_extract(low, r"(?s)^(.*?)(?<![=!<>+\-*/])=(?!=)", 1), judged)


def unguarded_update(text: Column) -> Column:
    """Name of a shared-state variable the line updates without a guard, or NULL."""

    def judged(low: Column) -> Column:
        touches = contains_any(low, V.STATEFUL_NAMES) & ~contains_any(low, V.SYNC_WORDS)
        return F.when(touches, F.coalesce(_compound_target(low), _plain_target(low)))

    return F.when(F.contains(text, F.lit("=")), let(ascii_lower(text), judged))


def reads_input(low: Column) -> Column:
    return contains_any(low, V.INPUT_WORDS)


def builds_string(low: Column) -> Column:
    return contains_any(low, V.DYNAMIC_STRING_WORDS)


def reaches_sink(low: Column) -> Column:
    """Untrusted data may reach a sink on this (lower-cased) line."""
    return reads_input(low) | builds_string(low)


def is_sanitized(low: Column) -> Column:
    return contains_any(low, V.SANITIZER_WORDS)


def leaks_sql_error(body: Column) -> Column:
    return lower_contains_any(body, V.SQL_ERROR_WORDS)


def exposes_file(body: Column) -> Column:
    return lower_contains_any(body, [w.lower() for w in V.EXPOSED_FILE_WORDS])


def is_traversal(payload: Column) -> Column:
    return lower_contains_any(payload, V.TRAVERSAL_WORDS)

