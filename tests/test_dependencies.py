import pytest
from pyspark.sql import functions as F

from lintlake.functions.imports import imported_modules, package_root, path_idents
from lintlake.functions.text import split_lines
from lintlake.operators import dependencies as DE
from lintlake.operators import graph as GR
from lintlake.sources.manifests import declared_dependencies, ecosystem_of


def declared(make_files, path, text):
    rows = declared_dependencies(make_files((path, text))).collect()
    return [(r.name, r.version, r.dev) for r in rows]


def test_cargo(make_files):
    text = ('[dependencies]\nserde = "1.0"\nanyhow = { version = "1" }\nlocal = { path = "x" }\n'
            '[dependencies.tokio]\nversion = "1.3"\n[dev-dependencies]\ntempfile = "3"\n[build-dependencies]\ncc = "1"\n'
            '[package]\nname = "x"\n')
    assert sorted(declared(make_files, "a/Cargo.toml", text), key=str) == sorted(
        [("serde", "1.0", False), ("anyhow", "1", False), ("local", None, False), ("tokio", "1.3", False),
         ("tempfile", "3", True), ("cc", "1", True)], key=str)
    assert declared(make_files, "Cargo.toml", "[dependencies\nbroken") == []


def test_npm(make_files):
    text = '{"dependencies": {"react": "^18.2.0", "odd": 3, "obj": {"a": 1}}, "devDependencies": {"jest": "^29"}}'
    assert sorted(declared(make_files, "package.json", text), key=str) == sorted(
        [("react", "^18.2.0", False), ("odd", None, False), ("obj", None, False), ("jest", "^29", True)], key=str)
    assert declared(make_files, "package.json", "{broken") == []
    assert declared(make_files, "package.json", '{"dependencies": ["a"], "devDependencies": "x"}') == []
    assert declared(make_files, "package.json", "[1]") == []


def test_requirements(make_files):
    text = "flask>=2.0\nrequests[security]==2.28\n# comment\n-r other.txt\n\n  plain  \nbad[unclosed==1\n==1\nz ; python_version<'3'\n"
    assert declared(make_files, "requirements.txt", text) == [
        ("flask", ">=2.0", False), ("requests", "==2.28", False), ("plain", None, False),
        ("bad", "[unclosed==1", False), ("z", "; python_version<'3'", False)]


def test_go_mod(make_files):
    text = ("module m\nrequire one.org/a v1.0\nrequire (\n\tgithub.com/gin v1.9.0 // indirect\n\n  require (\n\tx.org/y\n)\n"
            "require two.org/b v2\nrequired x y\nrequire (\n last.org/z v3")
    names = {r[0]: r[1] for r in declared(make_files, "go.mod", text)}
    assert names == {"one.org/a": "v1.0", "github.com/gin": "v1.9.0", "x.org/y": None, "two.org/b": "v2", "last.org/z": "v3"}


def test_pom(make_files):
    text = ("<dependencies><dependency><groupId>com.google.guava</groupId><artifactId>guava</artifactId>"
            "<version> 32.0 </version></dependency>\n<dependency>\n<artifactId>junit</artifactId><scope>test</scope>"
            "</dependency><dependency><groupId>only</groupId></dependency><dependency><artifactId>cut")
    assert declared(make_files, "pom.xml", text) == [("com.google.guava:guava", "32.0", False), ("junit", None, True)]


def test_csproj(make_files):
    text = ('<PackageReference Include="Newtonsoft.Json" Version="13.0.1" />\n<PackageReference Include="Dapper">\n'
            '<Version>3.0.0</Version></PackageReference><PackageReference Update="x" /><PackageReference Include="Last" />')
    assert declared(make_files, "src/App.csproj", text) == [
        ("Newtonsoft.Json", "13.0.1", False), ("Dapper", "3.0.0", False), ("Last", None, False)]


def test_ecosystems(values):
    paths = ["a/Cargo.toml", "x.csproj", "cargo.toml", "deep/er/go.mod", "pom.xml.bak"]
    assert values(ecosystem_of, paths) == ["Rust (Cargo)", "C# (NuGet)", None, "Go (modules)", None]


@pytest.mark.parametrize(
    "language, text, want",
    [
        ("Rust", "use serde::Serialize;\npub use tokio::sync;\nuse std::fs;\nuse crate::x;\n  use anyhow;\nextern crate old;\nuse {a, b};",
         ["anyhow", "serde", "tokio", "{a, b}"]),
        ("JavaScript", "import React from 'react';\nconst m = require('lodash/merge');\nimport './a.css';\nimport \"@scope/pkg/sub\";\nexport * from \"../x\"\nrequire('')",
         ["@scope/pkg", "lodash", "react"]),
        ("TypeScript", "import x from ''\nimport 'side'", ["side"]),
        ("Python", "import os.path as p, sys\nfrom numpy.linalg import norm\nfrom . import x\nimport  django\nimporter = 1",
         ["django", "numpy", "os"]),
        ("Go", 'import (\n\t"fmt"\n\t"github.com/gin-gonic/gin"\n)\nx := "example.com/not/import"', ["example.com/not/import", "github.com/gin-gonic/gin"]),
        ("Java", "import com.google.common.io.Files;\nimport static org.junit.Assert.x;\nimport java.util.List;\nimport javax.x.Y;\nimport Single;",
         ["Single", "com.google", "org.junit"]),
        ("Ruby", "require 'rails/all'\nrequire_relative 'x'\nrequire \"json\"", ["json", "rails"]),
        ("C", "#include <stdio.h>", []),
        ("Other", "import x", []),
    ],
)
def test_imports(spark, language, text, want):
    df = spark.createDataFrame([(language, text)], "language STRING, content STRING")
    got = df.select(imported_modules(F.col("language"), split_lines(F.col("content")))).first()[0]
    assert got == want


def test_package_root(values):
    assert values(package_root, ["@s/p/x", "@s", "a/b", "a"]) == ["@s/p", "@s", "a", "a"]


def test_path_idents(values):
    assert values(path_idents, ["serde_json::to_string(x); my_serde::foo(); éa::b; a::c::d"]) == [
        ["serde_json", "my_serde", "a", "c"]]


def inventory(make_files, *rows):
    return {r.name: r for r in DE.dependency_inventory(make_files(*rows)).collect()}


def test_inventory_usage(make_files):
    got = inventory(
        make_files,
        ("Cargo.toml", '[dependencies]\nserde = "1"\nunused_dep = "1"\npretty-env-logger = "0.5"\nserde_json = "1"\n'
                       '[dev-dependencies]\ntempfile = "3"\n'),
        ("src/a.rs", "use serde::Serialize;\nuse pretty_env_logger;\nserde_json::to_string(x);\nmy_tempfile::x();"),
        ("x.csproj", '<PackageReference Include="Dapper" Version="2" />'),
    )
    assert {n: r.used for n, r in got.items()} == {
        "serde": True, "unused_dep": False, "pretty-env-logger": True, "serde_json": True, "tempfile": False, "Dapper": None}
    assert got["tempfile"].dev


def test_totals_unused_conflicts(make_files):
    files = make_files(
        ("a/package.json", '{"dependencies": {"react": "18.2.0"}}'), ("b/package.json", '{"dependencies": {"react": "18.3.1"}}'),
        ("x.csproj", '<PackageReference Include="Dapper" />'), ("i.js", "import 'react'"),
        ("Cargo.toml", '[dev-dependencies]\nreact = "18.2.0"\n'),
    )
    inv = DE.dependency_inventory(files)
    t = DE.dependency_totals(inv).first()
    assert (t.total, t.production, t.development, t.unused, t.unknown) == (4, 3, 1, 0, 1)
    assert DE.unused_dependencies(inv).count() == 0
    rows = sorted((r.name, r.version, r.declarations, r.n_versions) for r in DE.version_conflicts(declared_dependencies(files)).collect())
    assert rows == [("react", "18.2.0", 2, 2), ("react", "18.3.1", 1, 2)]
    counts = [(r.ecosystem, r.packages) for r in DE.ecosystem_counts(declared_dependencies(files)).collect()]
    assert counts == [("Node (npm)", 2), ("C# (NuGet)", 1), ("Rust (Cargo)", 1)]


def test_projects_do_not_mix(make_files):
    got = inventory(make_files, ("one", "requirements.txt", "flask\n"), ("two", "a.py", "import flask\n"))
    assert got["flask"].used is False


def test_graph(make_files):
    files = make_files(
        ("a.py", "import a_b\nimport numpy\n"), ("b.py", "from numpy import x\n"), ("c.js", "require('a-b')\n"),
        ("requirements.txt", "numpy\na_b\n"), ("sub/requirements.txt", "numpy\nlost\n"), ("m.rs", "lost::x()"),
    )
    edges = DE.import_edges(files)
    assert [(r.module, r.files) for r in GR.top_modules(edges, 2).orderBy("position").collect()] == [("numpy", 2), ("a-b", 1)]
    assert [(r.path, r.n_imports) for r in GR.import_hotspots(files, 1).collect()] == [("a.py", 2)]
    s = GR.graph_summary(edges).first()
    assert (s.edges, s.modules, s.importing_files) == (4, 3, 3)
    totals = GR.node_totals(GR.dependency_nodes(files)).first()
    assert (totals.declared, totals.used, totals.unused) == (3, 3, 0)
    nodes = {r.name: (r.importing_files, r.used) for r in GR.dependency_nodes(files).collect()}
    assert nodes == {"numpy": (2, True), "a_b": (2, True), "lost": (0, True)}
