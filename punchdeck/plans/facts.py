"""Small tables stated once and given to Spark and to SQL alike."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


class Facts:
    """A small table with its schema: ``df(spark)``, and the same rows as an SQL expression."""

    def __init__(self, schema: str, *rows: tuple):
        self.schema, self.rows = schema, rows
        self.names = [c.split()[0] for c in schema.split(", ")]

    def df(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(list(self.rows), self.schema)

    def __str__(self) -> str:
        types = {"long": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "boolean": "BOOLEAN", "array<long>": "BIGINT[]", "array<string>": "VARCHAR[]"}

        def said(v, t: str) -> str:
            if v is None:
                text = "NULL"
            elif isinstance(v, list):
                text = "[" + ", ".join(said(x, t[6:-1]) for x in v) + "]"
            else:
                text = "'" + v.replace("'", "''") + "'" if isinstance(v, str) else str(v)
            return f"{text}::{types[t]}"

        kinds = [c.split(" ")[1] for c in self.schema.split(", ")]
        return "(SELECT * FROM (VALUES " + ", ".join("(" + ", ".join(said(v, t) for v, t in zip(r, kinds, strict=True)) + ")" for r in self.rows) + f") v({', '.join(self.names)}))"
