from gradewell.sources.jdbc import jdbc_options, jdbc_scan, jdbc_url
from gradewell.sources.parquet import chunked_export, parquet_scan, parquet_sink
from gradewell.sources.report import append_report, run_report

__all__ = [
    "jdbc_options", "jdbc_scan", "jdbc_url", "chunked_export", "parquet_scan", "parquet_sink",
    "append_report", "run_report",
]
