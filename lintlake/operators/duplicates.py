"""Repeated blocks of consecutive significant lines inside one file."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import fixed_values as V
from ..functions.text import is_significant, let, split_lines, trim_ws


REPEATS = T.ArrayType(T.StructType().add("line_no", "integer").add("first_line", "integer"))


def _kept_lines(content: Column) -> Column:
    """Significant lines as a struct of three parallel arrays: line_no and two hashes."""
    numbered = F.transform(
        split_lines(content), lambda t, i: F.struct((i + 1).alias("line_no"), trim_ws(t).alias("t"))
    )
    return let(
        F.filter(numbered, lambda x: is_significant(x["t"])),
        lambda kept: F.struct(
            F.transform(kept, lambda x: x["line_no"]).alias("line_no"),
            F.transform(kept, lambda x: F.xxhash64(x["t"])).alias("a"),
            F.transform(kept, lambda x: F.xxhash64(F.lit(7), x["t"])).alias("b"),
        ),
    )


def _windows(kept: Column, size: int) -> Column:
    """Start lines and 128-bit signatures of all runs of ``size`` kept lines, in order.

    NULL for a file in which no run occurs twice, which is nearly every file.
    """

    def signatures(hashes: Column) -> Column:
        return F.transform(
            F.sequence(F.lit(0), F.greatest(F.size(hashes) - size, F.lit(0))),
            lambda i: F.xxhash64(*[F.get(hashes, i + k) for k in range(size)]),
        )

    repeated = let(
        signatures(kept["a"]), lambda a: F.when(F.size(F.array_distinct(a)) < F.size(a), a)
    )
    return let(
        F.when(F.size(kept["a"]) >= 2 * size, repeated),
        lambda a: F.when(
            a.isNotNull(),
            F.struct(
                F.slice(kept["line_no"], F.lit(1), F.size(a)).alias("line_no"),
                a.alias("a"),
                signatures(kept["b"]).alias("b"),
            ),
        ),
    )


def _first_places(windows: Column) -> Column:
    """Runs that occurred before, as (line_no, first_line) in line order.

    Sorting brings equal signatures together; each stretch of them starts with the earliest.
    """

    def of_stretches(ordered: Column) -> Column:
        starts = F.filter(
            F.sequence(F.lit(0), F.size(ordered) - 1),
            lambda k: (k == 0)
            | (F.get(ordered, k)["a"] != F.get(ordered, k - 1)["a"])
            | (F.get(ordered, k)["b"] != F.get(ordered, k - 1)["b"]),
        )
        later = let(
            starts,
            lambda start: F.transform(
                start,
                lambda s, j: let(
                    F.get(ordered, s)["line_no"],
                    lambda first: F.transform(
                        F.slice(ordered, s + 2, F.coalesce(F.get(start, j + 1), F.size(ordered)) - s - 1),
                        lambda x: F.struct(x["line_no"].alias("line_no"), first.alias("first_line")),
                    ),
                ),
            ),
        )
        return F.sort_array(F.flatten(later))

    signed = F.transform(
        windows["a"],
        lambda a, i: F.struct(
            a.alias("a"), F.get(windows["b"], i).alias("b"), F.get(windows["line_no"], i).alias("line_no")
        ),
    )
    return let(F.sort_array(signed), of_stretches)


def _spaced(found: Column, size: int) -> Column:
    """Of ``found``, in line order, those at least ``size`` lines after the last one kept.

    That choice depends on all earlier ones, but not across a gap of ``size`` lines: the run after
    such a gap is always kept. From a run the next one kept is at most ``size`` places away, so the
    choice is a chain of jumps. Each round doubles their length and the number of runs reached,
    so n runs take log n rounds and no list grows step by step.
    """

    def jump(i: Column) -> Column:
        far = [
            F.when(F.get(found, i + k)["line_no"] - F.get(found, i)["line_no"] >= size, i + k)
            for k in range(1, size + 1)
        ]
        return F.coalesce(*far)

    places = F.sequence(F.lit(0), F.size(found) - 1)
    islands = F.filter(
        places,
        lambda i: (i == 0) | (F.get(found, i)["line_no"] - F.get(found, i - 1)["line_no"] >= size),
    )

    def within(start: Column, end: Column) -> Column:
        """Places kept of one island, those from ``start`` to before ``end``."""
        state = F.struct(
            F.transform(
                F.sequence(start, end - 1), lambda i: let(jump(i), lambda j: F.when(j < end, j - start))
            ).alias("next"),
            F.array(F.lit(0)).alias("kept"),
        ).cast("struct<next: array<int>, kept: array<int>>")
        rounds = F.sequence(F.lit(1), F.ceil(F.log2((end - start).cast("double"))).cast("int"))
        reached = F.aggregate(
            rounds,
            state,
            lambda s, _: F.struct(
                F.transform(s["next"], lambda i: F.get(s["next"], i)).alias("next"),
                F.concat(
                    s["kept"],
                    F.filter(F.transform(s["kept"], lambda i: F.get(s["next"], i)), lambda i: i.isNotNull()),
                ).alias("kept"),
            ).cast("struct<next: array<int>, kept: array<int>>"),
            lambda s: s["kept"],
        )
        return F.transform(reached, lambda i: i + start)

    kept = let(
        islands,
        lambda start: F.flatten(
            F.transform(
                start,
                lambda s, j: let(
                    F.coalesce(F.get(start, j + 1), F.size(found)),
                    lambda end: F.when(end - s == 1, F.array(s)).otherwise(within(s, end)),
                ),
            )
        ),
    )
    return F.transform(kept, lambda i: F.get(found, i))


def with_repeats(files: DataFrame, block_size: int = V.DUPLICATE_BLOCK) -> DataFrame:
    """``files`` with ``repeats``: the reported repeats of each file, NULL if it has none.

    All of it stays in the file's row and in the JVM: nothing is shuffled, no text goes to Python.
    """
    size = max(block_size, 2)
    windows = let(_kept_lines(F.col("content")), lambda kept: _windows(kept, size))
    repeats = let(
        windows,
        lambda w: F.when(
            w.isNotNull(),
            let(_first_places(w), lambda found: F.when(F.size(found) > 0, _spaced(found, size))),
        ),
    )
    return files.withColumn("repeats", repeats.cast(REPEATS))


def duplicate_blocks(files: DataFrame, block_size: int = V.DUPLICATE_BLOCK) -> DataFrame:
    """Repeats of every file: project, path, line_no of the repeat, first_line of the block."""
    # ``inline`` would test its array in a filter below it, and so compute the array twice.
    found = with_repeats(files, block_size).select("project", "path", F.inline_outer("repeats"))
    return found.where(F.col("line_no").isNotNull())
