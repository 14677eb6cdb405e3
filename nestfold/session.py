"""The engine: a catalog of files, SQL with parameters, prepared statements and temporary keyspaces."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession

from nestfold.sources import catalog


class Engine:
    """SQL over a Spark session; the session's own settings stay as they are."""

    def __init__(self, spark: SparkSession, root: str | None = None, only: set[str] | None = None):
        self.spark = spark
        self.prepared: dict[str, str] = {}
        self.temporary: dict[str, DataFrame] = {}
        if root:
            catalog.register(spark, catalog.discover(root, only))

    def bind(self, name: str, path: str) -> None:
        """Late binding: the name stands for other files from now on."""
        catalog.register(self.spark, {name: path})

    def sql(self, text: str, args: dict | list | None = None) -> DataFrame:
        """One statement. Beside Spark's: PREPARE n AS q, EXECUTE n, CREATE [OR REPLACE] TEMP KEYSPACE n AS q,
        DROP TEMP KEYSPACE [IF EXISTS] n, INSERT INTO 'path' [mode] q, EXPLAIN q."""
        text = text.strip().rstrip(";")
        if m := re.match(r"PREPARE\s+(\w+)\s+(?:AS|FROM)\s+(.+)$", text, re.IGNORECASE | re.DOTALL):
            self.prepared[m[1]] = m[2]
            return self.spark.createDataFrame([(m[1],)], "prepared string")
        if m := re.match(r"EXECUTE\s+(\w+)$", text, re.IGNORECASE):
            return self.sql(self.prepared[m[1]], args)
        if m := re.match(r"CREATE\s+(OR\s+REPLACE\s+)?TEMP\s+KEYSPACE\s+(\w+)\s+AS\s+(.+)$", text, re.IGNORECASE | re.DOTALL):
            return self.temp_keyspace(m[2], self.sql(m[3], args), bool(m[1]))
        if m := re.match(r"DROP\s+TEMP\s+KEYSPACE\s+(IF\s+EXISTS\s+)?(\w+)$", text, re.IGNORECASE):
            return self.drop_keyspace(m[2], bool(m[1]))
        if m := re.match(r"INSERT\s+INTO\s+'([^']+)'(?:\s+(NEW|APPEND|OVERWRITE))?\s+(.+)$", text, re.IGNORECASE | re.DOTALL):
            return catalog.insert_into(self.sql(m[3], args), m[1], (m[2] or "new").lower())
        return self.spark.sql(text, args=args) if args else self.spark.sql(text)

    def temp_keyspace(self, name: str, df: DataFrame, replace: bool = False) -> DataFrame:
        if name in self.temporary:
            if not replace:
                raise ValueError(f"{name} exists")
            self.temporary[name].unpersist()
        self.temporary[name] = df.persist(StorageLevel.MEMORY_AND_DISK)
        self.temporary[name].createOrReplaceTempView(name)
        return self.temporary[name]

    def drop_keyspace(self, name: str, if_exists: bool = False) -> DataFrame:
        if name not in self.temporary and not if_exists:
            raise ValueError(f"no such keyspace: {name}")
        if df := self.temporary.pop(name, None):
            df.unpersist()
            self.spark.catalog.dropTempView(name)
        return self.spark.createDataFrame([(name,)], "dropped string")

    def explain(self, text: str, args: dict | list | None = None) -> str:
        return self.sql(text, args)._jdf.queryExecution().toString()

    def schema(self, name: str) -> str:
        return self.spark.table(name).schema.simpleString()

    def register(self, name: str, function: Callable, kind: str) -> None:
        """A Python scalar function by name; names of built-in functions are refused."""
        if self.spark.catalog.functionExists(name):
            raise ValueError(f"{name} is a built-in function")
        self.spark.udf.register(name, function, kind)

    def cancel(self) -> None:
        self.spark.sparkContext.cancelAllJobs()
