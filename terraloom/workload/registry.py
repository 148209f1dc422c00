"""Named queries, the fixture views they read, and the SQL that checks them.

A fixture is one SQL text used by both engines. Placeholders: ``{table}`` names a driver table,
``{each:name:1,2,3}`` repeats every row per listed value, ``{epoch:col}`` is whole seconds since 1970.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..session import scratch_root

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()

FIXTURES: dict[str, str] = {}
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def fixture(name: str, sql: str) -> None:
    FIXTURES[name] = sql


def query(name: str, oracle: str | None = None):
    """Register ``fn(fx)`` where ``fx(view_name)`` gives a fixture or driver table as a DataFrame."""

    def register(fn: Callable[[Callable[[str], DataFrame]], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(Reader(spark, sf_dir))

        run.__name__ = name
        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        if oracle is not None:
            ORACLES[name] = oracle_text(oracle)
        return fn

    return register


class Reader:
    """Opens driver tables and fixture views for one scale directory."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir

    def __call__(self, name: str) -> DataFrame:
        if name in TABLES:
            return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        sql = _spark_text(FIXTURES[name])
        sql = re.sub(r"\bfx_\w+", r"{\g<0>}", sql)
        used = sorted(set(re.findall(r"\{(\w+)\}", sql)))
        return self.spark.sql(sql, **{table: self(table) for table in used})


def scratch(fx: Reader, name: str) -> str:
    """A new path in the shared scratch folder."""
    return f"{scratch_root(fx.spark)}/{name}-{uuid.uuid4().hex}"


def scratch_database(fx: Reader) -> str:
    """A new database in the shared scratch folder."""
    name = f"terraloom_{uuid.uuid4().hex[:12]}"
    fx.spark.sql(f"CREATE DATABASE {name} LOCATION '{scratch_root(fx.spark)}/{name}'")
    return name


def _spark_text(sql: str) -> str:
    sql = re.sub(r"\{each:(\w+):([^}]*)\}", r"LATERAL VIEW explode(array(\2)) each_\1 AS \1", sql)
    return re.sub(
        r"\{epoch:([\w.]+)\}", r"timestampdiff(SECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', CAST(\1 AS TIMESTAMP_NTZ))", sql
    )


def _oracle_fixture(sql: str) -> str:
    sql = re.sub(r"\{each:(\w+):([^}]*)\}", r"CROSS JOIN (SELECT unnest([\2]) AS \1) each_\1", sql)
    sql = re.sub(r"\{epoch:([\w.]+)\}", r"CAST(floor(epoch(\1)) AS BIGINT)", sql)
    return re.sub(r"\{(\w+)\}", r"\1", sql)


def oracle_text(sql: str) -> str:
    """Check SQL with the fixtures it mentions (also through other fixtures) as common table expressions."""
    order: list[str] = []

    def visit(text: str) -> None:
        for name in re.findall(r"\bfx_\w+", text):
            if name in FIXTURES and name not in order:
                visit(FIXTURES[name])
                order.append(name)

    visit(sql)
    recursive = bool(re.match(r"\s*WITH\s+RECURSIVE", sql, re.I))
    head = ",\n".join(f"{name} AS ({_oracle_fixture(FIXTURES[name])})" for name in order)
    body = re.sub(r"^\s*WITH\s+(RECURSIVE\s+)?", ",\n", sql, count=1, flags=re.I) if re.match(r"\s*WITH\b", sql, re.I) else "\n" + sql
    if not head:
        return sql
    return f"WITH {'RECURSIVE ' if recursive else ''}{head}{body}"
