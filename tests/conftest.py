import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from lintlake.session import build_session  # noqa: E402
from lintlake.sources.corpus import as_files  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session(
        "lintlake-tests",
        "local[8]",
        **{
            "spark.sql.shuffle.partitions": "4",
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            "spark.driver.memory": "4g",
        },
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def make_files(spark):
    """files table from (path, content) or (project, path, content) tuples."""
    from pyspark.sql import functions as F

    def make(*rows):
        full = [r if len(r) == 3 else ("p", *r) for r in rows]
        df = spark.createDataFrame(full, "project STRING, path STRING, content STRING")
        return as_files(df, F.col("project"), F.col("path"), F.col("content"))

    return make


@pytest.fixture(scope="session")
def values(spark):
    """Evaluate a Column function over a list of strings, in order."""
    from pyspark.sql import functions as F

    def run(fn, texts, **constants):
        df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i INT, t STRING")
        return [r[0] for r in df.select(fn(F.col("t")).alias("v"), "i").orderBy("i").select("v").collect()]

    return run


SF = "/root/testdata/sf0.001"
