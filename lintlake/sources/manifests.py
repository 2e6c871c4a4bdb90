"""Declared dependencies from six manifest formats, parsed inside the file's row."""

from __future__ import annotations

import tomllib

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed_values as V
from ..functions.text import basename, ltrim_ws, split_lines, trim_ws
from ..schemas import DECLARED


def ecosystem_of(path: Column) -> Column:
    """Ecosystem label by manifest basename, NULL for other files."""
    base = basename(path)
    chain = None
    for name, label in V.ECOSYSTEMS.items():
        cond = base == name
        chain = F.when(cond, F.lit(label)) if chain is None else chain.when(cond, F.lit(label))
    return chain.when(F.endswith(base, F.lit(V.CSPROJ_SUFFIX)), F.lit(V.CSPROJ_ECOSYSTEM))


def _declared(name: Column, version: Column, dev: Column) -> Column:
    return F.struct(name.alias("name"), version.alias("version"), dev.alias("dev"))


def _trimmed_lines(content: Column) -> Column:
    return F.transform(split_lines(content), trim_ws)


@F.pandas_udf(DECLARED)
def parse_cargo(content: pd.Series) -> pd.Series:
    """TOML needs a real parser; this is the only Python step in the inventory."""

    def one(text):
        if text is None:
            return []
        try:
            doc = tomllib.loads(text)
        except (tomllib.TOMLDecodeError, RecursionError):
            return []
        rows = []
        for table in ("dependencies", "dev-dependencies", "build-dependencies"):
            section = doc.get(table)
            for name, spec in section.items() if isinstance(section, dict) else ():
                version = spec.get("version") if isinstance(spec, dict) else spec
                rows.append(
                    {
                        "name": name,
                        "version": version if isinstance(version, str) else None,
                        "dev": table != "dependencies",
                    }
                )
        return rows

    return content.map(one)


def parse_npm(content: Column) -> Column:
    """Names and string versions of both tables; invalid JSON yields none."""
    doc = F.try_parse_json(content)

    def table(key, dev):
        entries = F.map_entries(
            F.try_variant_get(doc, f"$.{key}", "map<string,variant>")
        )
        return F.coalesce(
            F.transform(
                entries,
                lambda e: _declared(
                    e["key"],
                    F.when(
                        F.schema_of_variant(e["value"]) == "STRING",
                        F.try_variant_get(e["value"], "$", "string"),
                    ),
                    F.lit(dev),
                ),
            ),
            F.array().cast(DECLARED),
        )

    return F.concat(table("dependencies", False), table("devDependencies", True))


def parse_requirements(content: Column) -> Column:
    name = r"^[A-Za-z0-9_.\-]+"
    kept = F.filter(_trimmed_lines(content), lambda x: ~F.startswith(x, F.lit("-")) & x.rlike(name))

    def version(line):
        rest = ltrim_ws(F.regexp_replace(line, name, ""))
        rest = ltrim_ws(F.regexp_replace(rest, r"(?s)^\[[^\]]*\]", ""))
        return F.when(rest != "", rest)

    return F.transform(
        kept, lambda x: _declared(F.regexp_extract(x, name, 0), version(x), F.lit(False))
    )


def parse_go_mod(content: Column) -> Column:
    """Single 'require x v' lines and the lines of 'require ( ... )' blocks."""
    text = F.array_join(_trimmed_lines(content), "\n")
    block = r"(?dm)^require \([^\n]*(?:\n|\z)((?s:.*?))(?:^\)$|\z)"
    inside = F.flatten(
        F.transform(F.regexp_extract_all(text, F.lit(block), F.lit(1)), lambda b: F.split(b, "\n"))
    )
    inside = F.filter(inside, lambda x: ~F.startswith(x, F.lit("require (")))
    outside = F.filter(
        F.split(F.regexp_replace(text, block, ""), "\n"), lambda x: F.startswith(x, F.lit("require "))
    )
    specs = F.concat(inside, F.transform(outside, lambda x: F.regexp_replace(x, "^require ", "")))
    words = F.transform(
        specs, lambda x: F.split(trim_ws(x), r"[\p{IsWhite_Space}]+")
    )
    return F.transform(
        F.filter(words, lambda w: F.get(w, F.lit(0)) != ""),
        lambda w: _declared(F.get(w, F.lit(0)), F.get(w, F.lit(1)), F.lit(False)),
    )


def _tag(block: Column, tag: str) -> Column:
    return trim_ws(
        F.get(F.regexp_extract_all(block, F.lit(f"(?s)<{tag}>(.*?)</{tag}>"), F.lit(1)), F.lit(0))
    )


def parse_pom(content: Column) -> Column:
    blocks = F.regexp_extract_all(content, F.lit("(?s)<dependency>(.*?)</dependency>"), F.lit(1))
    named = F.filter(blocks, lambda b: _tag(b, "artifactId").isNotNull())
    return F.transform(
        named,
        lambda b: _declared(
            F.concat_ws(":", _tag(b, "groupId"), _tag(b, "artifactId")),
            _tag(b, "version"),
            F.coalesce(_tag(b, "scope").isin(V.POM_DEV_SCOPES), F.lit(False)),
        ),
    )


def parse_csproj(content: Column) -> Column:
    """PackageReference elements; a missing version attribute is looked up in a child.

    The child search runs to the next closing tag, as in the format we mirror, so a
    self-closing element without a version takes the next element's one.
    """
    element = r"(?s)<PackageReference([^>]*)>(?:(?=(.*?)</PackageReference>))?"
    heads = F.regexp_extract_all(content, F.lit(element), F.lit(1))
    bodies = F.regexp_extract_all(content, F.lit(element), F.lit(2))

    def attribute(head, name):
        return F.get(F.regexp_extract_all(head, F.lit(f'{name}="([^"]*)"'), F.lit(1)), F.lit(0))

    found = F.zip_with(
        heads,
        bodies,
        lambda h, b: _declared(
            attribute(h, "Include"),
            F.coalesce(attribute(h, "Version"), _tag(b, "Version")),
            F.lit(False),
        ),
    )
    return F.filter(found, lambda d: d["name"].isNotNull())


def declared_dependencies(files: DataFrame) -> DataFrame:
    """One row per declaration: project, path, manifest, ecosystem, name, version, dev.

    Only manifests pass the first filter, and only Cargo text reaches a Python worker.
    """
    eco, content = F.col("ecosystem"), F.col("content")
    manifests = files.select(
        "project", "path", "content", ecosystem_of(F.col("path")).alias("ecosystem")
    ).where(eco.isNotNull())
    cargo = parse_cargo(F.when(eco == V.ECOSYSTEMS["Cargo.toml"], content))
    declared = (
        F.when(eco == V.ECOSYSTEMS["package.json"], parse_npm(content))
        .when(eco == V.ECOSYSTEMS["requirements.txt"], parse_requirements(content))
        .when(eco == V.ECOSYSTEMS["go.mod"], parse_go_mod(content))
        .when(eco == V.ECOSYSTEMS["pom.xml"], parse_pom(content))
        .when(eco == V.CSPROJ_ECOSYSTEM, parse_csproj(content))
        .otherwise(F.col("cargo"))
    )
    return (
        manifests.withColumn("cargo", cargo)
        .select("project", "path", "ecosystem", F.inline(declared))
        .withColumn("manifest", basename(F.col("path")))
        .select("project", "path", "manifest", "ecosystem", "name", "version", "dev")
    )
