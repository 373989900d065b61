"""Who works on which map tile: steps over a table of assignments.

The table is ``service_id, user_id, x, y, z, stage, data``.  A step takes a table and returns the new
one; a store writes it.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from typing import Any

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rasterloom.errors import NoTileAvailable, ProcessParameterInvalid, TileAlreadyLocked, TileNotAssigned

SCHEMA = "service_id string, user_id string, x int, y int, z int, stage string, data string"


def empty(frame: DataFrame) -> DataFrame:
    return frame.sparkSession.createDataFrame([], SCHEMA)


def available(state: DataFrame, service_id: str, zoom: int, x_range: tuple[int, int], y_range: tuple[int, int]) -> DataFrame:
    """``(x, y)`` of the inclusive ranges that nobody holds."""
    spark = state.sparkSession
    w, h = x_range[1] - x_range[0] + 1, y_range[1] - y_range[0] + 1
    cells = spark.range(max(0, w) * max(0, h)).select((F.col("id") % w + x_range[0]).cast("int").alias("x"), (F.expr(f"id div {max(w, 1)}") + y_range[0]).cast("int").alias("y"))
    held = state.where((F.col("service_id") == service_id) & (F.col("z") == zoom)).select("x", "y")
    return cells.join(held, ["x", "y"], "left_anti")


def tile_of(state: DataFrame, service_id: str, user_id: str) -> dict | None:
    row = state.where((F.col("service_id") == service_id) & (F.col("user_id") == user_id)).first()
    return row.asDict() if row else None


def claim(state: DataFrame, service_id: str, user_id: str, zoom: int, x_range: tuple[int, int], y_range: tuple[int, int], seed: int = 0) -> tuple[DataFrame, dict]:
    """The user's tile, or a free one: the first in an order that user and seed decide."""
    own = tile_of(state, service_id, user_id)
    if own:
        return state, own
    free = available(state, service_id, zoom, x_range, y_range)
    pick = free.orderBy(F.xxhash64(F.lit(user_id), F.lit(seed), "x", "y"), "x", "y").first()
    if pick is None:
        raise NoTileAvailable(f"no tile of {service_id} is free")
    row = {"service_id": service_id, "user_id": user_id, "x": pick["x"], "y": pick["y"], "z": zoom, "stage": "claimed", "data": None}
    return state.unionByName(state.sparkSession.createDataFrame([tuple(row.values())], SCHEMA)), row


def _own(state: DataFrame, service_id: str, user_id: str) -> dict:
    tile = tile_of(state, service_id, user_id)
    if tile is None:
        raise TileNotAssigned(f"{user_id} holds no tile of {service_id}")
    return tile


def _is(service_id: str, user_id: str):
    return (F.col("service_id") == service_id) & (F.col("user_id") == user_id)


def release(state: DataFrame, service_id: str, user_id: str, force: bool = False) -> tuple[DataFrame, dict]:
    """Give a tile back; a submitted one only by force."""
    tile = _own(state, service_id, user_id)
    if tile["stage"] == "submitted" and not force:
        raise TileAlreadyLocked("the tile is submitted")
    return state.where(~_is(service_id, user_id)), tile | {"stage": "released"}


def submit(state: DataFrame, service_id: str, user_id: str) -> tuple[DataFrame, dict]:
    tile = _own(state, service_id, user_id)
    if tile["stage"] == "submitted":
        raise TileAlreadyLocked("the tile is submitted")
    return state.withColumn("stage", F.when(_is(service_id, user_id), "submitted").otherwise(F.col("stage"))), tile | {"stage": "submitted"}


def update(state: DataFrame, service_id: str, user_id: str, data: str) -> tuple[DataFrame, dict]:
    """Store a document with the tile, in place of an earlier one."""
    tile = _own(state, service_id, user_id)
    return state.withColumn("data", F.when(_is(service_id, user_id), F.lit(data)).otherwise(F.col("data"))), tile | {"data": data}


def tile_assignment(state: DataFrame, zoom: int, x_range: tuple[int, int], y_range: tuple[int, int], stage: str, service_id: str, user_id: str, data: str | None = None, seed: int = 0) -> tuple[DataFrame, dict]:
    """One step by the name of its stage."""
    steps: dict[str, Any] = {
        "claim": lambda: claim(state, service_id, user_id, zoom, x_range, y_range, seed),
        "release": lambda: release(state, service_id, user_id),
        "submit": lambda: submit(state, service_id, user_id),
        "force-release": lambda: release(state, service_id, user_id, force=True),
        "update": lambda: update(state, service_id, user_id, data or "{}"),
    }
    if stage not in steps:
        raise ProcessParameterInvalid(f"no stage is named {stage!r}")
    return steps[stage]()


def tiles_summary(state: DataFrame, service_id: str) -> DataFrame:
    """All tiles of a service."""
    return state.where(F.col("service_id") == service_id).select("x", "y", "z", "stage", "user_id", "data")


class Assignments:
    """The table of assignments as a Parquet folder for each version; the newest is read.

    A step writes the version after the one that it read and fails if another writer has made
    that version meanwhile.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def _read(self) -> tuple[int, DataFrame]:
        try:
            last = self.spark.read.parquet(self.path).agg(F.max("version")).first()[0]
        except AnalysisException as e:  # nothing is written before the first step
            if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
                raise
            last = None
        if last is None:
            return 0, self.spark.createDataFrame([], SCHEMA)
        return last, self.spark.read.schema(SCHEMA).parquet(f"{self.path}/version={last}").where("service_id is not null")

    def state(self) -> DataFrame:
        return self._read()[1]

    def step(self, zoom: int, x_range: tuple[int, int], y_range: tuple[int, int], stage: str, service_id: str, user_id: str, data: str | None = None, seed: int = 0) -> dict:
        """One ``tile_assignment``; the table is written only if the step changes it."""
        version, before = self._read()
        after, tile = tile_assignment(before, zoom, tuple(x_range), tuple(y_range), stage, service_id, user_id, data, seed)
        if after is not before:
            # a row of nulls shows the version of a table that is empty otherwise
            marked = after.unionByName(self.spark.createDataFrame([(None,) * 7], SCHEMA))
            marked.write.mode("error").parquet(f"{self.path}/version={version + 1}")
        return tile


def tile_processes(store: Assignments, service_id: str, user_id: str) -> dict[str, Callable]:
    """The processes of a graph that a user runs for a service."""

    def assign(zoom: int, x_range: list, y_range: list, stage: str, data: Any = None) -> dict:
        return store.step(zoom, x_range, y_range, stage, service_id, user_id, None if data is None else data if isinstance(data, str) else json.dumps(data))

    return {"tile_assignment": assign, "tiles_summary": lambda: tiles_summary(store.state(), service_id)}
