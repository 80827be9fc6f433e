"""Database scans over JDBC, split into parallel reads.

Addresses and secrets come from the caller; nothing is stored here.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession

DRIVERS = {
    "sqlserver": "com.microsoft.sqlserver.jdbc.SQLServerDriver",
    "db2": "com.ibm.db2.jcc.DB2Driver",
}


def jdbc_url(dialect: str, server: str, database: str, port: int | str | None = None, windows_auth: bool = False,
             trust_certificate: bool = False) -> str:
    """The JDBC address of a SQL Server or DB2 database. trust_certificate turns
    the check of a SQL Server's certificate off."""
    place = f"{server}:{port}" if port else server
    if dialect == "sqlserver":
        login = ";integratedSecurity=true" if windows_auth else ""
        trust = ";trustServerCertificate=true" if trust_certificate else ""
        return f"jdbc:sqlserver://{place};databaseName={database}{login}{trust}"
    if dialect == "db2":
        if windows_auth:
            raise ValueError("windows_auth is for SQL Server")
        return f"jdbc:db2://{place}/{database}"
    raise ValueError(f"unknown dialect {dialect!r}")


def jdbc_options(url: str, query: str, driver: str | None = None, user: str | None = None, password: str | None = None,
                 fetch_size: int = 10_000, split: tuple[str, object, object, int] | None = None) -> dict[str, str]:
    """Reader options. `split` = (column, lower, upper, partitions) reads ranges
    of a column in parallel; Spark takes it with a table expression only, so
    the query is wrapped as one in both forms."""
    options = {"url": url, "dbtable": f"({query}) query", "fetchsize": str(fetch_size)}
    if driver:
        options["driver"] = driver
    if user is not None:
        options |= {"user": user, "password": password or ""}
    if split:
        column, lower, upper, partitions = split
        if partitions < 1:
            raise ValueError("partitions must be positive")
        options |= {
            "partitionColumn": column, "lowerBound": str(lower), "upperBound": str(upper), "numPartitions": str(partitions),
        }
    return options


def jdbc_scan(spark: SparkSession, url: str, query: str, predicates: Sequence[str] | None = None,
              properties: Mapping[str, str] | None = None, **options) -> DataFrame:
    """The result of a query as a DataFrame; filters and columns chosen later are
    pushed into it. One read per predicate if `predicates` are given (for keys
    too uneven for ranges), otherwise as `split` says, otherwise a single read."""
    settings = jdbc_options(url, query, **options)
    if predicates:
        extra = {k: v for k, v in settings.items() if k not in ("url", "dbtable")} | dict(properties or {})
        return spark.read.jdbc(url, settings["dbtable"], predicates=list(predicates), properties=extra)
    return spark.read.format("jdbc").options(**settings, **dict(properties or {})).load()
