"""String helpers with exact ASCII, byte-length and line-splitting semantics."""

from __future__ import annotations

import re
import string
from collections.abc import Callable, Iterable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .fixed_values import MIN_SIGNIFICANT_BYTES, WHITESPACE


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once per row and hand it to ``body`` as a variable.

    The optimizer would otherwise copy the expression to every place that uses it.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def exploded(df: DataFrame, kept: Sequence[str], array: Column, *names: str, numbered: bool = False) -> DataFrame:
    """``kept`` columns with a row per element of ``array``: its number from 0 if wanted, then its value or fields.

    The last of ``names`` is never NULL in an element. The optimizer tests the size of the array of a plain ``explode``
    in a filter below it, and so computes the array twice; it does not for the outer form, whose empty rows go here.
    """
    if numbered:
        made = F.posexplode_outer(array).alias(*names)
    elif len(names) > 1:
        made = F.inline_outer(array)
    else:
        made = F.explode_outer(array).alias(*names)
    return df.select(*kept, made).where(F.col(names[-1]).isNotNull())


def literal_array(values: Iterable[str]) -> Column:
    """Array of string literals, parsed in one call instead of one per value."""
    quoted = (v.replace("\\", "\\\\").replace("'", "\\'") for v in values)
    return F.expr("array(" + ", ".join(f"'{v}'" for v in quoted) + ")")


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z only.

    ``lower`` is Unicode-aware, which would let a Kelvin sign match "k"; it is
    used only where the text is pure ASCII (byte length = character length),
    because ``translate`` walks code points and is far slower.
    """
    return F.when(F.octet_length(c) == F.length(c), F.lower(c)).otherwise(
        F.translate(c, string.ascii_uppercase, string.ascii_lowercase)
    )


def trim_ws(c: Column) -> Column:
    """Strip Unicode white space on both ends."""
    return F.btrim(c, F.lit(WHITESPACE))


def ltrim_ws(c: Column) -> Column:
    return F.ltrim(c, F.lit(WHITESPACE))


def rtrim_ws(c: Column) -> Column:
    return F.rtrim(c, F.lit(WHITESPACE))


def contains_any(c: Column, words: Iterable[str]) -> Column:
    """True when any word is a substring. Words covered by a shorter one are dropped."""
    words = list(dict.fromkeys(words))
    needed = [w for w in words if not any(o != w and o in w for o in words)]
    return reduce(lambda a, b: a | b, [F.contains(c, F.lit(w)) for w in needed])


def lower_contains_any(c: Column, words: Iterable[str]) -> Column:
    """``contains_any`` on the ASCII lower-cased text, which is made only once."""
    return F.exists(F.array(ascii_lower(c)), lambda low: contains_any(low, words))


def any_word_pattern(words: Iterable[str], ignore_case: bool = False) -> str:
    body = "|".join(re.escape(w) for w in words)
    return f"(?i)(?:{body})" if ignore_case else f"(?:{body})"


def first_match(c: Column, pattern: str, group: int = 1) -> Column:
    """Group of an anchored pattern, NULL (not '') when it does not match. One pass."""
    return F.get(F.regexp_extract_all(c, F.lit(pattern), F.lit(group)), F.lit(0))


def split_lines(content: Column) -> Column:
    """Lines of a text: LF or CRLF ends a line, a final empty segment is dropped.

    A bare CR on the last, unterminated line stays.
    """
    unix = F.replace(content, F.lit("\r\n"), F.lit("\n"))
    body = F.when(F.endswith(unix, F.lit("\n")), F.left(unix, F.length(unix) - 1)).otherwise(unix)
    return F.when(content == "", F.array().cast("array<string>")).otherwise(F.split(body, "\n"))


def count_lines(content: Column) -> Column:
    """Number of lines without building them."""
    newlines = F.octet_length(content) - F.octet_length(F.replace(content, F.lit("\n"), F.lit("")))
    open_tail = (content != "") & ~F.endswith(content, F.lit("\n"))
    return (newlines + open_tail.cast("int")).cast("int")


def is_comment(text: Column, language: Column) -> Column:
    """Comment-only line for the file's language. Blank lines are not comments."""
    t = ltrim_ws(text)
    hashed = F.startswith(t, F.lit("#"))
    slashed = F.startswith(t, F.lit("//")) | F.startswith(t, F.lit("*")) | F.startswith(t, F.lit("/*"))
    return F.when(language.isin("Python", "Ruby", "Shell"), hashed).otherwise(slashed)


def is_any_comment(text: Column) -> Column:
    """Comment-only line in any comment style; what user rules skip."""
    t = ltrim_ws(text)
    return (
        F.startswith(t, F.lit("#"))
        | F.startswith(t, F.lit("//"))
        | F.startswith(t, F.lit("*"))
        | F.startswith(t, F.lit("/*"))
    )


def is_significant(trimmed: Column) -> Column:
    """A trimmed line that counts toward duplicate blocks."""
    return (F.octet_length(trimmed) >= MIN_SIGNIFICANT_BYTES) & trimmed.rlike(
        r"[\p{IsAlphabetic}\p{N}]"
    )


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def normalize_name(name: Column) -> Column:
    """Package or module name as it is compared: ASCII lower case, '_' as '-'."""
    return F.translate(ascii_lower(name), "_", "-")


def slug(c: Column) -> Column:
    return F.regexp_replace(c, r"[^A-Za-z0-9]", "-")


def escape_html(c: Column) -> Column:
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        c = F.replace(c, F.lit(raw), F.lit(safe))
    return c
