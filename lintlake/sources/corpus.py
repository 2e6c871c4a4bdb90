"""Load a corpus of text files into the ``files`` table."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fixed_values as V
from ..functions.text import ascii_lower, basename, count_lines, exploded, literal_array, split_lines


def language_of(path: Column) -> Column:
    """Language by file extension; a name that only starts with '.' has none."""
    ext = ascii_lower(F.regexp_extract(basename(path), r"(?s)^.+\.([^.]*)\z", 1))
    chain = None
    for name, extensions in V.LANGUAGES:
        cond = ext.isin(extensions)
        chain = F.when(cond, F.lit(name)) if chain is None else chain.when(cond, F.lit(name))
    return chain.otherwise(F.lit(V.OTHER_LANGUAGE))


def language_rank(language: Column) -> Column:
    names = [name for name, _ in V.LANGUAGES]
    return F.array_position(literal_array(names), language)


def is_skipped_path(path: Column, ignore: Sequence[str] = ()) -> Column:
    """Whether a root-relative path is pruned.

    Skipped directory names apply to directories only, dot names to any component,
    and user patterns to the whole path, a leading path or any one component.
    """
    parts = F.split(path, "/")
    dirs = F.slice(parts, F.lit(1), F.size(parts) - 1)
    cond = F.arrays_overlap(dirs, literal_array(V.SKIPPED_DIRS))
    cond = cond | F.startswith(path, F.lit(".")) | F.contains(path, F.lit("/."))
    for pattern in ignore:
        pattern = pattern.strip("/")
        if pattern:
            cond = cond | matches_ignore(path, pattern)
    return cond


def matches_ignore(path: Column, pattern: str) -> Column:
    pattern = pattern.strip("/")
    if not pattern:
        return F.lit(False)
    return (
        (path == pattern)
        | F.startswith(path, F.lit(pattern + "/"))
        | F.array_contains(F.split(path, "/"), pattern)
    )


def read_corpus(
    spark: SparkSession, root: str, project: str | None = None, ignore: Sequence[str] = (),
    max_file_bytes: int | None = None,
) -> DataFrame:
    """Files below ``root``, of any size unless ``max_file_bytes`` is given.

    Such a limit is applied before any byte is read. With no ``project`` name the first directory below the root names the project.
    """
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    return corpus_from_binary(raw, root, project, ignore, max_file_bytes)


def corpus_from_binary(
    raw: DataFrame, root: str, project: str | None = None, ignore: Sequence[str] = (),
    max_file_bytes: int | None = None,
) -> DataFrame:
    """``files`` from (path, length, content BINARY) rows, batch or streaming."""
    small = raw if max_file_bytes is None else raw.where(F.col("length") <= max_file_bytes)
    placed = _placed(small, root, project).where(F.col("rel").isNotNull())
    picked = placed.where(_unread(F.col("rel"), F.col("length"), F.col("content"), ignore, max_file_bytes).isNull())
    text = F.make_valid_utf8(F.col("content").cast("string"))
    return as_files(picked, F.col("project"), F.col("rel"), text)


def skipped_files(
    raw: DataFrame, root: str, project: str | None = None, ignore: Sequence[str] = (),
    max_file_bytes: int | None = None,
) -> DataFrame:
    """project, path, bytes and reason (path, size or binary) of what ``corpus_from_binary`` leaves out."""
    reason = _unread(F.col("rel"), F.col("length"), F.col("content"), ignore, max_file_bytes)
    placed = _placed(raw, root, project)
    return placed.select(
        "project", F.col("rel").alias("path"), F.col("length").alias("bytes"), reason.alias("reason")
    ).where(F.col("reason").isNotNull())


def _unread(
    path: Column, size: Column, content: Column, ignore: Sequence[str], max_file_bytes: int | None
) -> Column:
    """Why a file is left out, or NULL. A NUL byte among the first ones marks a file as binary."""
    binary = F.contains(F.substring(content, 1, V.SNIFF_BYTES), F.lit(b"\x00"))
    large = F.lit(False) if max_file_bytes is None else size > max_file_bytes
    return (
        F.when(is_skipped_path(path, ignore), F.lit("path"))
        .when(large, F.lit("size"))
        .when(binary, F.lit("binary"))
    )


def _placed(raw: DataFrame, root: str, project: str | None) -> DataFrame:
    """The rows with ``project`` and ``rel``, the path below it."""
    base = re.sub(r"^file:/*", "/", root).rstrip("/")
    full = F.regexp_replace(F.col("path"), r"^file:/*", "/")
    rel = F.substr(full, F.lit(len(base) + 2))
    if project is None:
        owner, path = F.substring_index(rel, "/", 1), F.regexp_replace(rel, r"^[^/]*/", "")
    else:
        owner, path = F.lit(project), rel
    return raw.withColumns({"project": owner, "rel": path})


def corpus_from_table(
    df: DataFrame,
    project: Column,
    path: Column,
    content: Column,
    ignore: Sequence[str] = (),
    max_file_bytes: int | None = None,
) -> DataFrame:
    """``files`` from a table that already holds text, with the same filters."""
    picked = df.select(project.alias("project"), path.alias("rel"), content.alias("text"))
    unread = _unread(
        F.col("rel"), F.octet_length("text"), F.col("text").cast("binary"), ignore, max_file_bytes
    )
    return as_files(picked.where(F.col("rel").isNotNull() & F.col("text").isNotNull() & unread.isNull()), F.col("project"), F.col("rel"), F.col("text"))


def as_files(df: DataFrame, project: Column, path: Column, content: Column) -> DataFrame:
    return df.select(
        project.alias("project"),
        path.alias("path"),
        content.alias("content"),
        count_lines(content).alias("lines"),
        language_of(path).alias("language"),
    )


def explode_lines(files: DataFrame) -> DataFrame:
    """One row per numbered line; ``line_no`` starts at 1. No shuffle."""
    rows = exploded(
        files, ["project", "path", "language"], split_lines(F.col("content")), "pos", "text", numbered=True
    )
    return rows.select("project", "path", "language", (F.col("pos") + 1).alias("line_no"), "text")


def corpus_stats(files: DataFrame) -> DataFrame:
    """Files, lines and recognised languages (in report order) per project.

    The language set holds at most ten names, so it may be collected.
    """
    known = F.when(
        F.col("language") != V.OTHER_LANGUAGE,
        F.struct(language_rank(F.col("language")).alias("rank"), F.col("language").alias("name")),
    )
    return files.groupBy("project").agg(
        F.count("*").alias("files"),
        F.sum("lines").cast("bigint").alias("lines_of_code"),
        F.transform(F.sort_array(F.collect_set(known)), lambda x: x["name"]).alias("languages"),
    )
