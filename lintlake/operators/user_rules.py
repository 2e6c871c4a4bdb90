"""User-defined line rules: needles, sinks and missing sanitisation.

A line can only satisfy a rule if it holds every piece of the rule's clauses. So each rule is indexed under one
piece of up to PIECE characters, the rarest of its clauses. What pieces there are is condensed into a runtime
filter of fixed size: the characters that stand at each place of a piece, and a bit for each piece's hash. A line gives
only those of its pieces that pass the filter, these meet the rules in an equi-join, and each pair is verified on
the whole line. One plan serves any number of rules.
"""

from __future__ import annotations

from collections import Counter

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.codelines import is_sanitized, reaches_sink
from ..functions.text import ascii_lower, exploded, is_any_comment
from .scoring import severity_of_word

#: Characters of an indexed piece; clauses that are shorter are pieces themselves.
PIECE = 3
#: Bits of the filter of pieces, in words of 64.
FILTER_WORDS = 1024
#: Lines, and characters of each, on which the frequency of pieces is estimated. Only the choice of pieces rests on it.
SAMPLE_LINES = 2000
SAMPLE_CHARACTERS = 120


def _prepared(rules: DataFrame) -> DataFrame:
    """Lower-cased clauses; a rule without needles and without a sink is skipped."""
    needles = F.transform(F.coalesce("contains", F.array().cast("array<string>")), ascii_lower)
    return (
        rules.where((F.size(F.coalesce("contains", F.array().cast("array<string>"))) > 0) | F.col("reaches").isNotNull())
        .select(
            F.col("name").alias("rule"),
            needles.alias("needles"),
            ascii_lower(F.col("reaches")).alias("sink"),
            (F.size(F.coalesce("without", F.array().cast("array<string>"))) > 0).alias("needs_unsanitized"),
            F.coalesce(severity_of_word(F.col("severity")), F.lit("HIGH")).alias("severity"),
            F.coalesce("report", "name").alias("message"),
        )
    )


def _matches(low: Column) -> Column:
    return (
        F.forall("needles", lambda n: F.contains(low, n))
        & (F.col("sink").isNull() | (F.contains(low, F.col("sink")) & reaches_sink(low)))
        & (~F.col("needs_unsanitized") | ~is_sanitized(low))
    )


def code_lines(lines: DataFrame) -> DataFrame:
    """project, path, line_no and the lower-cased text of the lines that aren't comments."""
    return lines.where(~is_any_comment(F.col("text"))).select(
        "project", "path", "line_no", ascii_lower(F.col("text")).alias("low")
    )


def piece_counts(lines: DataFrame) -> DataFrame:
    """piece, seen: how often pieces occur in the first few lines; of bounded size, whatever the corpus."""
    heads = code_lines(lines).select(F.left("low", F.lit(SAMPLE_CHARACTERS)).alias("head")).take(SAMPLE_LINES)
    seen = Counter(r["head"][i : i + n] for r in heads for n in range(1, PIECE + 1) for i in range(len(r["head"]) - n + 1))
    columns = {"piece": pa.array(seen.keys(), pa.string()), "seen": pa.array(seen.values(), pa.int64())}
    return lines.sparkSession.createDataFrame(pa.table(columns))


def rule_index(rules: DataFrame, counts: DataFrame) -> DataFrame:
    """The rules, each under one piece: the rarest of its clauses, of several the longest."""
    clauses = F.array_compact(F.concat("needles", F.array("sink")))
    grams = F.flatten(
        F.transform(
            clauses,
            lambda c: F.when(F.length(c) <= PIECE, F.array(c)).otherwise(
                F.transform(F.sequence(F.lit(1), F.length(c) - (PIECE - 1)), lambda i: F.substr(c, i, F.lit(PIECE)))
            ),
        )
    )
    numbered = _prepared(rules).withColumn("number", F.monotonically_increasing_id())
    choice = numbered.select("*", F.explode(F.array_distinct(grams)).alias("piece")).join(counts, "piece", "left")
    rank = F.struct(F.coalesce("seen", F.lit(0)).alias("seen"), (-F.length("piece")).alias("length"), F.col("piece"))
    rule = F.struct("rule", "needles", "sink", "needs_unsanitized", "severity", "message")
    return choice.groupBy("number").agg(F.min(rank)["piece"].alias("piece"), F.first(rule).alias("r")).select("piece", "r.*")


def _word(piece: Column) -> Column:
    return F.pmod(F.xxhash64(piece), F.lit(FILTER_WORDS)).cast("int")


def _place(piece: Column) -> Column:
    return F.pmod(F.shiftright(F.xxhash64(piece), 32), F.lit(64)).cast("int")


def piece_filter(index: DataFrame) -> DataFrame:
    """One row for the pieces of an index: a pattern for each length, and a bit for each hash."""
    patterns = [F.lit(r"\A()") if n == 0 else _pattern(n) for n in range(PIECE + 1)]
    held = [F.when(F.count_if(F.length("piece") == n) > 0, p).otherwise("(?!)").alias(f"pattern{n}") for n, p in enumerate(patterns)]
    words = index.groupBy(_word(F.col("piece")).alias("word")).agg(
        F.bit_or(F.call_function("shiftleft", F.lit(1).cast("bigint"), _place(F.col("piece")))).alias("bits")
    )
    table = F.map_from_entries(F.collect_list(F.struct("word", "bits")))
    bits = words.agg(F.transform(F.sequence(F.lit(0), F.lit(FILTER_WORDS - 1)), lambda i: F.coalesce(table[i], F.lit(0))).alias("bits"))
    return index.agg(*held).select("*", bits.scalar().alias("bits"))


def _pattern(length: int) -> Column:
    """A pattern whose group takes every text whose characters stand at these places of some piece."""

    def at(place: int) -> Column:
        character = F.when(F.length("piece") == length, F.substr("piece", F.lit(place), F.lit(1)))
        code = F.when(character.isNotNull(), F.concat(F.lit(r"\x{"), F.hex(F.ascii(character)), F.lit("}")))
        return F.concat(F.lit("["), F.array_join(F.array_sort(F.collect_set(code)), ""), F.lit("]"))

    return F.concat(F.lit("(?s)(?=("), *(at(i) for i in range(1, length + 1)), F.lit("))"))


def _with_pieces(code: DataFrame, found: DataFrame) -> DataFrame:
    """The lines with a row for each distinct piece that passes the filter."""
    once = found.select(F.struct("*")).scalar()
    every = [F.regexp_extract_all("low", once[f"pattern{n}"], F.lit(1)) for n in range(PIECE + 1)]
    rows = exploded(code, ["*"], F.array_distinct(F.concat(*every)), "piece")
    word = F.get(once["bits"], _word(F.col("piece")))
    return rows.where(F.call_function("shiftright", word, _place(F.col("piece"))).bitwiseAND(F.lit(1)) == 1)


def user_rule_findings(lines: DataFrame, rules: DataFrame, counts: DataFrame | None = None) -> DataFrame:
    """Lines that satisfy a rule: project, rule, severity, path, line_no, message.

    ``counts`` (piece, seen) tells how frequent pieces are; without it the first lines of the corpus do. It
    steers which piece a rule is indexed under and never what is found. Repeated rules and lines
    are reported as often as they occur; no rules, or no lines, give no rows.
    """
    index = rule_index(rules, piece_counts(lines) if counts is None else counts)
    found = piece_filter(index)
    matched = _with_pieces(code_lines(lines), found).join(index, "piece").where(_matches(F.col("low")))
    return matched.select("project", "rule", "severity", "path", "line_no", "message")
