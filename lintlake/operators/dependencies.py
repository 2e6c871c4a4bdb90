"""Dependency inventory: what is declared, and what is imported."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed_values as V
from ..functions.imports import imported_modules, path_idents
from ..functions.text import exploded, normalize_name, split_lines
from ..plans.sizing import computed_once
from ..sources.manifests import declared_dependencies


def file_imports(files: DataFrame) -> DataFrame:
    """Files that import something, with their sorted distinct modules. No shuffle."""
    imports = imported_modules(F.col("language"), split_lines(F.col("content")))
    made = computed_once(
        files, project=F.col("project"), path=F.col("path"), language=F.col("language"), imports=imports
    )
    return made.where(F.size("imports") > 0)


def import_edges(files: DataFrame) -> DataFrame:
    """One row per file and imported module."""
    imports = imported_modules(F.col("language"), split_lines(F.col("content")))
    return exploded(files, ["project", "path"], imports, "module")


def usage_index(files: DataFrame) -> DataFrame:
    """What the corpus uses, by (project, key): importing files, and the spellings written as a path.

    The key is the normalised name, which a module and a 'name::' path of a Rust file have in common;
    ``files`` counts each file once for every module of the key, ``idents`` holds the key's different
    spellings. Both come out of one pass over the corpus and shrink inside each task before the shuffle.
    """
    nothing = F.lit(None).cast("string")
    modules = F.transform(
        imported_modules(F.col("language"), split_lines(F.col("content"))),
        lambda m: F.struct(normalize_name(m).alias("key"), nothing.alias("ident")),
    )
    idents = F.transform(
        F.when(
            (F.col("language") == "Rust") & F.contains("content", F.lit("::")),
            path_idents(F.col("content")),
        ).otherwise(F.array().cast("array<string>")),
        lambda m: F.struct(normalize_name(m).alias("key"), m.alias("ident")),
    )
    return (
        files.select("project", F.inline(F.concat(modules, idents)))
        .groupBy("project", "key")
        .agg(F.count_if(F.col("ident").isNull()).alias("files"), F.collect_set("ident").alias("idents"))
    )


def with_usage(named: DataFrame, usage: DataFrame, relevant: Column | None = None) -> DataFrame:
    """``named`` (project, name) rows with ``files`` and ``pathed``, by one join on (project, key).

    Rows that aren't ``relevant`` have no key. They are dealt out under keys of their own that nothing has, so
    that they don't meet in one task.
    """
    key = normalize_name(F.col("name"))
    if relevant is not None:
        spare = F.concat(F.lit("\x00"), F.xxhash64(*named.columns).cast("string"))
        key = F.when(relevant, key).otherwise(spare)
    joined = named.withColumn("key", key).join(usage, ["project", "key"], "left").drop("key")
    pathed = F.array_contains(F.coalesce("idents", F.array().cast("array<string>")), F.translate("name", "-", "_"))
    return joined.withColumns({"files": F.coalesce("files", F.lit(0)), "pathed": pathed}).drop("idents")


def dependency_inventory(
    files: DataFrame, declared: DataFrame | None = None, usage: DataFrame | None = None
) -> DataFrame:
    """Declared dependencies with ``used``: true, false, or NULL where it cannot be told.

    The look-up is one equi-join with ``usage_index``; the corpus is read for it once
    instead of being searched once per dependency. ``declared`` and ``usage`` can be
    passed in where a caller has already written them to a table.
    """
    declared = declared if declared is not None else declared_dependencies(files)
    usage = usage if usage is not None else usage_index(files)
    detectable = F.col("ecosystem").isin(V.USAGE_ECOSYSTEMS)
    # Only a Cargo package can be used through its path.
    is_cargo = F.col("ecosystem") == V.ECOSYSTEMS["Cargo.toml"]
    seen = (F.col("files") > 0) | (is_cargo & F.col("pathed"))
    return with_usage(declared, usage, detectable).select(
        "project", "path", "manifest", "ecosystem", "name", "version", "dev", F.when(detectable, seen).alias("used")
    )


def unused_dependencies(inventory: DataFrame) -> DataFrame:
    """Declared but never imported; 'cannot tell' is not unused."""
    return inventory.where(~F.col("used"))


def dependency_totals(inventory: DataFrame) -> DataFrame:
    return inventory.groupBy("project").agg(
        F.count("*").alias("total"),
        F.count_if(~F.col("dev")).alias("production"),
        F.count_if("dev").alias("development"),
        F.count_if(~F.col("used")).alias("unused"),
        F.count_if(F.col("used").isNull()).alias("unknown"),
    )


def ecosystem_counts(declared: DataFrame) -> DataFrame:
    """Packages per ecosystem, most first."""
    return (
        declared.groupBy("project", "ecosystem")
        .agg(F.count("*").alias("packages"))
        .orderBy("project", F.desc("packages"), "ecosystem")
    )


def version_conflicts(declared: DataFrame) -> DataFrame:
    """One row per version of a package declared at more than one distinct version.

    Packages are matched by name across ecosystems and missing versions are ignored.
    The versions stay rows: a popular package may have too many to put in one array.
    """
    versions = declared.where(F.col("version").isNotNull()).groupBy("project", "name", "version").agg(
        F.count("*").alias("declarations")
    )
    several = (
        versions.groupBy("project", "name")
        .agg(F.count("*").alias("n_versions"))
        .where("n_versions > 1")
    )
    return versions.join(several, ["project", "name"]).select(
        "project", "name", "version", "declarations", "n_versions"
    )
