import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    builder = (
        SparkSession.builder.master("local[4]").appName("tests")
        .config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
    )
    session = builder.getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    yield session
    from gradewell.workspace import clear_scratch

    clear_scratch(session)
    session.stop()


@pytest.fixture(scope="session")
def lines(spark):
    """The modelling table at the smallest scale, written once."""
    from catalog.fixture import scored_lines
    from gradewell.workspace import staged

    return staged(scored_lines(spark, SMALL), "test-lines")


@pytest.fixture(scope="session")
def lines_pd(lines):
    return lines.toPandas()
