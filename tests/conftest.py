import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[8]")
        .appName("siftline-tests")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "6g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("checkpoints")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def corpus(spark):
    def make(*contents, ext=".py"):
        rows = [(f"f{i}{ext}", c, "python") for i, c in enumerate(contents)]
        return spark.createDataFrame(rows, "path string, content string, language string")

    return make


@pytest.fixture
def findings(spark):
    columns = "file string, line_number int, severity string, type string, message string, stage string, seq bigint"

    def make(*rows):
        return spark.createDataFrame(list(rows), columns)

    return make


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())
