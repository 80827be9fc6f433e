import pytest

from gradewell import workspace
from gradewell.operators.checks import row_shape
from gradewell.sources import (
    append_report, chunked_export, jdbc_options, jdbc_scan, jdbc_url, parquet_scan, parquet_sink, run_report,
)
from gradewell.sources.report import metric_rows
from gradewell.workspace import clear_scratch, scratch_path, shared_folder


def test_jdbc_addresses():
    assert jdbc_url("sqlserver", "host", "db", 1433, windows_auth=True, trust_certificate=True) == (
        "jdbc:sqlserver://host:1433;databaseName=db;integratedSecurity=true;trustServerCertificate=true"
    )
    assert jdbc_url("sqlserver", "host\\inst", "db") == "jdbc:sqlserver://host\\inst;databaseName=db"
    assert jdbc_url("db2", "host", "db", "50000") == "jdbc:db2://host:50000/db"
    for bad in (("oracle", "h", "d"), ("db2", "h", "d", None, True)):
        with pytest.raises(ValueError):
            jdbc_url(*bad)


def test_jdbc_options():
    plain = jdbc_options("u", "select 1", driver="d", user="me", password="p")
    assert plain == {"url": "u", "dbtable": "(select 1) query", "fetchsize": "10000", "driver": "d", "user": "me", "password": "p"}
    split = jdbc_options("u", "select 1", split=("id", 0, 100, 8))
    assert (split["partitionColumn"], split["lowerBound"], split["upperBound"], split["numPartitions"]) == ("id", "0", "100", "8")
    with pytest.raises(ValueError):
        jdbc_options("u", "q", split=("id", 0, 1, 0))


class Reader:
    """Stands in for spark.read: records what it is asked for."""

    def __init__(self):
        self.read = self
        self.asked = {}

    def format(self, name):
        self.asked["format"] = name
        return self

    def options(self, **options):
        self.asked.update(options)
        return self

    def load(self):
        return self.asked

    def jdbc(self, url, table, predicates, properties):
        return {"url": url, "table": table, "predicates": predicates, **properties}


def test_jdbc_scan_passes_everything_on():
    got = jdbc_scan(Reader(), "u", "select 1", properties={"encrypt": "true"}, user="me", password="p", split=("id", 1, 9, 2))
    assert got["format"] == "jdbc" and got["encrypt"] == "true" and got["numPartitions"] == "2" and got["user"] == "me"
    got = jdbc_scan(Reader(), "u", "select 1", predicates=["id < 5", "id >= 5"], user="me")
    assert got == {"url": "u", "table": "(select 1) query", "predicates": ["id < 5", "id >= 5"], "fetchsize": "10000", "user": "me", "password": ""}


def test_export_in_chunks(spark):
    path = scratch_path(spark, "chunks")
    chunked_export(spark.range(2500).coalesce(1), path, rows=1000)
    batches = parquet_scan(spark, path)
    assert len(batches.inputFiles()) == 3 and batches.count() == 2500
    chunked_export(spark.range(10), path)  # overwrites
    assert parquet_scan(spark, path).count() == 10


def test_sink_by_part(spark):
    path = scratch_path(spark, "parts")
    parquet_sink(spark.range(10).selectExpr("id", "if(id < 9, 'train', 'test') as split"), path, "split")
    assert {tuple(r) for r in row_shape(parquet_scan(spark, path), "split").collect()} == {("train", 9, 1), ("test", 1, 1)}
    assert parquet_scan(spark, path, spark.read.parquet(path).schema).where("split = 'test'").count() == 1


def test_scratch_is_cleared(spark):
    class Own:
        """This session under an application id of its own."""

        conf = spark.conf

        class sparkContext:
            applicationId = "test-clear"
            master = spark.sparkContext.master
            _jvm = spark.sparkContext._jvm
            _jsc = spark.sparkContext._jsc

    path = scratch_path(Own, "gone")
    spark.range(3).write.parquet(path)
    kept = scratch_path(spark, "kept")
    spark.range(3).write.parquet(kept)
    clear_scratch(Own)
    assert spark.read.parquet(kept).count() == 3
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        spark.read.parquet(path)


def test_report(spark):
    path = scratch_path(spark, "report")
    append_report(run_report(spark, "r1", {"gini": 0.5}, {"C": 10}, [
        {"level": "INFO", "message": "done", "logger": "train", "function": "fit", "line": 7}
    ]), path)
    append_report(metric_rows(spark.range(3).selectExpr("count(*) as n"), "r2", ["n"]), path)
    assert {tuple(r) for r in spark.read.parquet(path).collect()} == {
        ("r1", "metric", "gini", "0.5"), ("r1", "param", "C", "10"), ("r1", "log.info", "train:fit:7", "done"), ("r2", "metric", "n", "3"),
    }


def test_shared_folder_comes_from_the_session(spark, monkeypatch):
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        assert shared_folder(spark) == folder.rstrip("/")

    class Session:
        class conf:
            get = staticmethod(lambda key, default: None)

        class sparkContext:
            master = "yarn"

    with pytest.raises(RuntimeError):
        shared_folder(Session)
    Session.sparkContext.master = "local[2]"
    assert shared_folder(Session) == workspace._local_folder()
