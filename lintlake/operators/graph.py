"""Import graph: modules, importing files, and how dependencies are used."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed_values as V
from ..sources.manifests import declared_dependencies
from .dependencies import file_imports, usage_index, with_usage


def module_counts(edges: DataFrame) -> DataFrame:
    """Importing files per module. An edge is distinct per file, so a count is enough."""
    return edges.groupBy("project", "module").agg(F.count("*").alias("files"))


def top_modules(edges: DataFrame, limit: int = 10) -> DataFrame:
    """Most-imported modules per project; ties by name. The rank is cut before the shuffle."""
    order = Window.partitionBy("project").orderBy(F.desc("files"), "module")
    return (
        module_counts(edges)
        .withColumn("position", F.row_number().over(order))
        .where(F.col("position") <= limit)
    )


def import_hotspots(files: DataFrame, limit: int = 5) -> DataFrame:
    """Files with the most external imports per project; ties by path."""
    order = Window.partitionBy("project").orderBy(F.desc("n_imports"), "path")
    return (
        file_imports(files)
        .select("project", "path", F.size("imports").alias("n_imports"))
        .withColumn("position", F.row_number().over(order))
        .where(F.col("position") <= limit)
    )


def graph_summary(edges: DataFrame) -> DataFrame:
    """Edges, distinct modules and importing files per project.

    Both distinct counts are taken by grouping first, which stays flat when one
    project holds most edges.
    """
    modules = edges.groupBy("project", "module").agg(F.count("*").alias("n")).groupBy("project").agg(
        F.sum("n").alias("edges"), F.count("*").alias("modules")
    )
    files = edges.groupBy("project", "path").agg(F.lit(1).alias("one")).groupBy("project").agg(
        F.count("*").alias("importing_files")
    )
    return modules.join(files, "project")


def dependency_nodes(
    files: DataFrame, declared: DataFrame | None = None, usage: DataFrame | None = None
) -> DataFrame:
    """Declared dependencies of the graph: one row per project, name and manifest kind.

    Of several declarations the one with the smallest path is kept. ``importing_files``
    adds up the files of every module that normalises to the package name, so a file
    that imports both 'a_b' and 'a-b' counts twice. Here a 'name::' path counts for
    every ecosystem, unlike in the inventory.
    """
    declared = declared if declared is not None else declared_dependencies(files)
    graphed = declared.where(F.col("ecosystem").isin(V.USAGE_ECOSYSTEMS))
    # An aggregate, not a ranking: many copies of one package shrink before the shuffle.
    nodes = graphed.groupBy("project", "name", "manifest").agg(
        F.min_by("dev", F.struct("path", "dev")).alias("dev")
    )
    return with_usage(nodes, usage if usage is not None else usage_index(files)).select(
        "project",
        "name",
        "manifest",
        "dev",
        F.col("files").alias("importing_files"),
        ((F.col("files") > 0) | F.col("pathed")).alias("used"),
    )


def node_totals(nodes: DataFrame) -> DataFrame:
    """Declared, used and possibly unused packages per project."""
    return nodes.groupBy("project").agg(
        F.count("*").alias("declared"),
        F.count_if("used").alias("used"),
        F.count_if(~F.col("used")).alias("unused"),
    )
