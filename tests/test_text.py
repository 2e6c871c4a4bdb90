from pyspark.sql import functions as F

from lintlake.functions import fixed_values as V
from lintlake.functions import text as T
from lintlake.functions.secrets import SECRET_STEMS


def test_split_lines(values):
    texts = ["a\r\nb\n\nc\n", "", "\n", "q\r", "x\r\r\ny", "\n\n"]
    assert values(T.split_lines, texts) == [["a", "b", "", "c"], [], [""], ["q\r"], ["x\r", "y"], ["", ""]]
    assert values(T.count_lines, texts) == [4, 0, 1, 1, 2, 2]


def test_ascii_lower_leaves_other_letters(values):
    assert values(T.ascii_lower, ["TOKEN", "ÀB", "KEY"]) == ["token", "Àb", "Key"]


def test_trim_covers_unicode_white_space(values):
    assert values(T.trim_ws, [" 　 a b ", "\x1fa"]) == ["a b", "\x1fa"]


def test_significant_lines(values):
    assert values(T.is_significant, ["});", "abc", "abcd", "----", "éa", "ééé"]) == [
        False, False, True, False, False, True,
    ]


def test_comment_tests(spark):
    rows = [("# x", "Python", True), ("  // x", "Rust", True), ("# x", "Rust", False), ("", "Go", False),
            ("\t* x", "Java", True), ("/* x", "C", True), ("// x", "Ruby", False)]
    df = spark.createDataFrame(rows, "t STRING, lang STRING, want BOOLEAN")
    got = df.select((T.is_comment(F.col("t"), F.col("lang")) == F.col("want")).alias("ok")).collect()
    assert all(r.ok for r in got)


def test_any_comment(values):
    assert values(T.is_any_comment, ["# a", " //", "*", "/*", "a # b", ""]) == [True, True, True, True, False, False]


def test_names_and_slugs(values):
    assert values(T.normalize_name, ["My_Pkg", "a-b"]) == ["my-pkg", "a-b"]
    assert values(T.slug, ["a/b é1"]) == ["a-b--1"]
    assert values(T.escape_html, ['<a href="x">&']) == ["&lt;a href=&quot;x&quot;&gt;&amp;"]


def test_contains_any_drops_only_redundant_words(values):
    words = ["token", "auth_token", "pwd"]
    assert values(lambda c: T.contains_any(c, words), ["auth_token", "a pwd", "tok"]) == [True, True, False]


def test_secret_stems_cover_every_word():
    assert all(any(stem in word for stem in SECRET_STEMS) for word in V.SECRET_WORDS)


def test_literal_array(spark):
    texts = ["it's", "a\\n", 'q"', "\t", "é"]
    assert spark.range(1).select(T.literal_array(texts)).first()[0] == texts
