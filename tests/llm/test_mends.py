"""Odd pages, ids and columns that once lost data, hung or crashed; components of long chains."""

import time

import numpy as np
from pyspark.sql import functions as F

from lintlake.llm import components, decontamination, line_rules, near_duplicates, pages, private_data


def texts(page):
    return pages.Page(page).blocks


def test_quotes_out_of_place():
    assert texts("<p title=don't>It isn't here. <b>x</b></p>") == ["It isn't here. x"]
    assert texts('<p class="a>one</p><p class="b">two</p>') == ["one", "two"]
    assert texts("<p class='a>one</p><p>it's two</p>") == ["one", "it's two"]
    assert texts('<p title="a < b" class=x>one</p><p data-x=\'<i>\'>two</p><p a = "x>y" b>three</p>') == ["one", "two", "three"]
    assert texts('<p class="">one</p><p "x">two</p><br/><p/>three') == ["one", "two", "three"]
    assert texts("a < b <3 <p>one") == ["a < b <3", "one"]


def test_pages_that_never_close_a_tag():
    for page in ("<a " * 300_000, '<a x="' * 100_000, "<a x='" * 100_000, "<!" * 300_000, '<a x="b ' * 100_000, "<p " * 100_000 + "text"):
        start = time.time()
        texts(page)
        assert time.time() - start < 20


def test_leaks_of_rows_without_an_id(spark):
    item = " ".join(f"q{i}" for i in range(30))
    clean, leaky = " ".join(f"c{i}" for i in range(40)), f"before {item} after"
    rows = [(None, leaky), (None, clean), (None, None), (1, leaky), (1, clean), (2, ""), (2, clean)]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, leaked string")
    benchmark = spark.createDataFrame([(7, item), (8, None)], "item_id long, text string")
    left = decontamination.without_leaks(docs, benchmark)
    assert sorted(map(tuple, left.collect()), key=str) == sorted([(*r, "x") for r in rows if r[1] != leaky], key=str)
    assert decontamination.without_leaks(docs.limit(0), benchmark).count() == 0


def test_columns_with_the_names_used_inside(spark):
    schema = "doc_id long, text string, source string, lang string, n_chars long, host string, gone string, gone_id long, found string, __id string, __cls int, __merged int, place int"
    docs = spark.createDataFrame([(i, f"menu of the site\nmail a{i}@b.co of {i}", "s", "en", 5, "h", "g", 1, "f", "x", 2, 3, 4) for i in range(12)], schema)
    cut = line_rules.without_frequent_lines(docs, 5, 0.1)
    assert cut.columns == docs.columns and {r.text for r in cut.collect()} == {f"mail a{i}@b.co of {i}" for i in range(12)}
    red = private_data.redact(docs, rows=40)
    assert red.columns == docs.columns and {r.text for r in red.collect()} == {f"menu of the site\nmail [EMAIL] of {i}" for i in range(12)}
    assert near_duplicates.one_of_each(docs).columns == docs.columns


def test_components_of_a_long_chain(spark, monkeypatch):
    """A path in random order, which once took a round for nearly every node."""
    written = []
    keep = components.stored
    monkeypatch.setattr(components, "stored", lambda df, name: written.append(name) or keep(df, name))
    order = np.random.default_rng(1).permutation(2000).tolist()
    edges = [*zip(order, order[1:]), (5000, 5001), (5001, 5000), (6000, 6000), (7001, 7000), (7000, 7001)]
    got = {r.node: r.label for r in components.components(spark.createDataFrame(edges, "x long, y long")).collect()}
    assert got == {**dict.fromkeys(order, 0), 5000: 5000, 5001: 5000, 6000: 6000, 7000: 7000, 7001: 7000}
    assert (len(written) - 2) / 3 < 16
    assert components.components(spark.createDataFrame([], "x long, y long")).count() == 0
