"""Hard-coded secret detection on a single line."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed_values as V
from .text import any_word_pattern, contains_any, is_comment, let, trim_ws

# Text before the first assignment operator. "::" pairs, "==" runs and "=" after
# one of "=!<>" are stepped over; possessive, so it never backtracks.
_ASSIGNED = r"^((?:::|[^=:]++|=(?==)|(?<=[=!<>])=)*+)[=:]"

# First quoted literal of a text; the closing quote must match the opening one.
_LITERAL = r"(?s)^[^\"'`]*+([\"'`])((?:\\.|(?!\1)[^\\])*+)\1"

_SECRET_WORD = any_word_pattern(V.SECRET_WORDS, ignore_case=True)
# Every secret word contains one of these; six scans of a line instead of fourteen.
SECRET_STEMS = ["key", "secret", "passw", "pwd", "token", "credential"]
_PLACEHOLDER = "^" + any_word_pattern(V.PLACEHOLDERS, ignore_case=True) + r"\z"


def provider_token(text: Column) -> Column:
    """Label of the first known token format on the line, or NULL."""
    begin, end = V.PRIVATE_KEY_PARTS
    hits = [
        (F.contains(text, F.lit(probe)) & text.rlike(pattern), label)
        for probe, pattern, label in V.PROVIDER_TOKENS
    ]
    hits.append((F.contains(text, F.lit(begin)) & F.contains(text, F.lit(end)), V.PRIVATE_KEY_LABEL))
    first, label = hits[0]
    out = F.when(first, F.lit(label))
    for cond, label in hits[1:]:
        out = out.when(cond, F.lit(label))
    return out


def assigned_name(text: Column) -> Column:
    """Everything left of the first assignment operator ('' when there is none)."""
    return F.regexp_extract(text, _ASSIGNED, 1)


def assigned_literal(text: Column) -> Column:
    """First quoted literal right of the assignment operator ('' when none)."""
    return F.regexp_extract(F.substr(text, F.length(assigned_name(text)) + 1), _LITERAL, 2)


def looks_real(value: Column) -> Column:
    """Whether a literal is plausible as a secret rather than a placeholder."""
    return let(trim_ws(value), _trimmed_looks_real)


def _trimmed_looks_real(t: Column) -> Column:
    lookup = reduce(lambda a, b: a | b, [F.contains(t, F.lit(w)) for w in V.LOOKUP_FRAGMENTS])
    return (
        (F.octet_length(t) >= V.MIN_SECRET_BYTES)
        & ~t.rlike(_PLACEHOLDER)
        & ~lookup
        & ~F.startswith(t, F.lit("$"))
        & ((F.octet_length(t) >= V.LONG_SECRET_BYTES) | t.rlike(r"[0-9]|[^A-Za-z0-9\p{IsWhite_Space}]"))
    )


def may_hold_secret(text: Column) -> Column:
    """Cheap superset of the lines that can hold a secret: substring tests only."""
    begin, _ = V.PRIVATE_KEY_PARTS
    token = contains_any(text, [probe for probe, _, _ in V.PROVIDER_TOKENS] + [begin])
    quoted = F.contains(text, F.lit('"')) | F.contains(text, F.lit("'")) | F.contains(text, F.lit("`"))
    worded = F.exists(F.array(F.lower(text)), lambda low: contains_any(low, SECRET_STEMS))
    return token | (quoted & worded)


def secret_kind(text: Column, language: Column) -> Column:
    """What secret the line holds, or NULL. Provider tokens win over assignments.

    Comment lines are searched for provider tokens only.
    """
    assigned = (
        ~is_comment(text, language)
        & assigned_name(text).rlike(_SECRET_WORD)
        & looks_real(assigned_literal(text))
    )
    return F.coalesce(provider_token(text), F.when(assigned, F.lit(V.GENERIC_SECRET)))
