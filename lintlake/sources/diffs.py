"""Added lines with their new line numbers, from unified diff text.

Which file and line a row of a diff stands for depends on all rows before it. That is a prefix scan in two passes:
each range of rows is read on its own, as if nothing came before it, and leaves one row with the state at its
end; these are carried on from range to range, and what a range takes over is added to its rows.
A range is a split of a file as Spark reads it, or a run of rows of a text in a table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import split_lines

#: Rows of a range where a diff is a text in a table.
RANGE_ROWS = 4096


def read_diffs(spark: SparkSession, path: str, project: str | Column) -> DataFrame:
    """Rows of the diff files below a path, of any size: project, diff_id (the file name), range, pos, text.

    A file is read in splits by as many tasks as it takes, and no task sees more than its own; ``range`` is
    the split's first byte, ``pos`` rises with the rows of a split. ``project`` is a name, or a column of
    the path (as of ``project=x`` folders). A CR before the line end is dropped.
    """
    lines = spark.read.option("lineSep", "\n").option("recursiveFileLookup", isinstance(project, str)).text(path)
    return lines.select(
        (F.lit(project) if isinstance(project, str) else project).alias("project"),
        F.col("_metadata.file_name").alias("diff_id"),
        F.col("_metadata.file_block_start").alias("range"),
        F.monotonically_increasing_id().alias("pos"),
        F.when(F.endswith("value", F.lit("\r")), F.left("value", F.length("value") - 1)).otherwise(F.col("value")).alias("text"),
    )


def diff_rows(diffs: DataFrame, range_rows: int = RANGE_ROWS) -> DataFrame:
    """Rows of diffs that are texts in a table (project, diff_id, diff): project, diff_id, range, pos, text."""
    rows = diffs.select("project", "diff_id", F.posexplode(split_lines(F.col("diff"))).alias("pos", "text"))
    return rows.withColumn("range", F.floor(F.col("pos") / range_rows))


def added_lines(rows: DataFrame) -> DataFrame:
    """Added lines (project, diff_id, path, line_no, text) of diff rows (project, diff_id, range, pos, text).

    The state at the end of a range is its last file header, its last hunk start and the advance since then.
    Any line that starts with '+++ ' is a file header, even inside a hunk.
    """
    text = F.col("text")
    header = F.startswith(text, F.lit("+++ "))
    hunk_start = F.when(
        ~header & F.startswith(text, F.lit("@@")),
        F.regexp_extract(text, r"^[^+]*\+([0-9]+)", 1),
    )
    file = F.when(
        header & (text != "+++ /dev/null"),
        F.substring_index(F.regexp_replace(F.substr(text, F.lit(5)), "^b/", ""), "\t", 1),
    )
    kind = (
        F.when(header, F.lit("file"))
        .when(F.startswith(text, F.lit("--- ")) | F.startswith(text, F.lit("diff --git")), F.lit("skip"))
        .when(hunk_start.isNotNull(), F.when(hunk_start != "", F.lit("hunk")).otherwise(F.lit("skip")))
        .when(F.startswith(text, F.lit("+")), F.lit("add"))
        .when(F.startswith(text, F.lit(" ")), F.lit("keep"))
        .otherwise(F.lit("skip"))
    )
    marked = rows.select(
        "project",
        "diff_id",
        "pos",
        "range",
        kind.alias("kind"),
        # STRUCT(path) so that "no file" (/dev/null) is a value and not an absence
        F.when(header, F.struct(file.alias("path"))).alias("file"),
        F.when(kind == "hunk", hunk_start.try_cast("bigint")).alias("start"),
        F.when(kind == "add", F.substr(text, F.lit(2))).alias("added"),
    ).where("kind <> 'skip'")

    range_key = ["project", "diff_id", "range"]
    so_far = Window.partitionBy(*range_key).orderBy("pos").rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    # File in force inside the range; NULL struct = none seen in this range yet.
    local = marked.withColumns(
        {
            "file_here": F.last("file", ignorenulls=True).over(so_far),
            "hunk_here": F.count("start").over(so_far),
        }
    )
    carry_order = Window.partitionBy("project", "diff_id").orderBy("range").rowsBetween(
        Window.unboundedPreceding, -1
    )
    file_carry = (
        local.groupBy(*range_key)
        .agg(F.max_by("file", F.when(F.col("file").isNotNull(), F.col("pos"))).alias("range_file"))
        .withColumn("file_before", F.last("range_file", ignorenulls=True).over(carry_order))
        .select(*range_key, "file_before")
    )
    # The counter moves only while a file is in force.
    placed = (
        local.join(file_carry, range_key)
        .withColumn("path", F.coalesce("file_here", "file_before")["path"])
        .withColumn(
            "moves", (F.col("kind").isin("add", "keep") & F.col("path").isNotNull()).cast("bigint")
        )
    )
    in_hunk = Window.partitionBy(*range_key, "hunk_here").orderBy("pos").rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    counted = placed.withColumns(
        {
            "start_here": F.first("start", ignorenulls=True).over(in_hunk),
            "moved": F.sum("moves").over(in_hunk),
        }
    )
    line_carry = (
        counted.groupBy(*range_key)
        .agg(
            F.max("hunk_here").alias("hunks"),
            F.max_by(
                F.coalesce(F.col("start_here"), F.lit(0)) + F.col("moved"), F.col("pos")
            ).alias("end_value"),
        )
        # Ranges without a hunk only add to the counter; one with a hunk resets it.
        .withColumn("era", F.sum((F.col("hunks") > 0).cast("int")).over(
            Window.partitionBy("project", "diff_id").orderBy("range")
        ))
        .withColumn(
            "line_before",
            F.sum("end_value").over(
                Window.partitionBy("project", "diff_id", "era").orderBy("range")
            ),
        )
        .withColumn(
            "line_before",
            F.lag("line_before", 1, 0).over(
                Window.partitionBy("project", "diff_id").orderBy("range")
            ),
        )
        .select(*range_key, "line_before")
    )
    return (
        counted.join(line_carry, range_key)
        .where((F.col("kind") == "add") & F.col("path").isNotNull())
        .select(
            "project",
            "diff_id",
            "path",
            (F.coalesce("start_here", "line_before") + F.col("moved") - 1).cast("int").alias("line_no"),
            F.col("added").alias("text"),
        )
    )
