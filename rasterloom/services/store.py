"""Stored graphs and services in a Parquet table; the newest row of an id counts."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rasterloom.errors import NotFound, ProcessParameterInvalid
from rasterloom.plans.graph import validate

SCHEMA = "id string, user_id string, document string, version long, deleted boolean"


class GraphStore:
    """Documents of users.  Writes append a row; reads take each id's largest version."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def _rows(self) -> DataFrame:
        try:
            return self.spark.read.schema(SCHEMA).parquet(self.path)
        except Exception as e:  # the table isn't there before the first write
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return self.spark.createDataFrame([], SCHEMA)

    def _current(self, user_id: str) -> DataFrame:
        w = Window.partitionBy("id").orderBy(F.col("version").desc())
        rows = self._rows().where(F.col("user_id") == user_id).withColumn("_n", F.row_number().over(w))
        return rows.where("_n = 1 and not deleted").drop("_n")

    def _append(self, user_id: str, id_: str, document: str | None, deleted: bool) -> None:
        last = self._rows().where((F.col("user_id") == user_id) & (F.col("id") == id_)).agg(F.max("version")).first()[0]
        self.spark.createDataFrame([(id_, user_id, document, (last or 0) + 1, deleted)], SCHEMA).write.mode("append").parquet(self.path)

    def put(self, user_id: str, id_: str, graph: dict) -> None:
        """Check and store; a graph with errors is refused."""
        errors = validate(graph)
        if errors:
            raise ProcessParameterInvalid("; ".join(e["message"] for e in errors))
        self._append(user_id, id_, json.dumps(graph), False)

    def get(self, user_id: str, id_: str) -> dict:
        row = self._current(user_id).where(F.col("id") == id_).first()
        if row is None:
            raise NotFound(f"there is no graph {id_}")
        return json.loads(row["document"])

    def delete(self, user_id: str, id_: str) -> None:
        self.get(user_id, id_)
        self._append(user_id, id_, None, True)

    def list(self, user_id: str) -> DataFrame:
        return self._current(user_id).select("id", "document").orderBy("id")
