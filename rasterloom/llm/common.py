"""Shared pieces: scratch tables that cut lineage, group streaming, components."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Token pattern of the word-based operators: a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"

_local_scratch: dict[str, str] = {}


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder for intermediate tables.

    It is ``spark.checkpoint.dir`` of the session.  Only where that is unset and Spark
    runs in one JVM (tests) does a temporary folder stand in for it.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        return shared.rstrip("/")
    sc = spark.sparkContext
    if not sc.master.startswith("local[") and sc.master != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if sc.applicationId not in _local_scratch:
        _local_scratch[sc.applicationId] = tempfile.mkdtemp(prefix="scratch-")
    return _local_scratch[sc.applicationId]


def cut(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    The plan that follows starts at the files, so lost executors cost no recomputation of
    what came before, and a table used twice is computed once.
    """
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def lower_ascii(text: Column) -> Column:
    """Lower-case A-Z only."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def valid_vector(vec: Column) -> Column:
    """True where a vector is neither null, empty nor zero and all its parts are finite."""
    finite = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(vec.isNotNull() & finite & F.exists(vec, lambda x: x != 0), F.lit(False))


def matrix(column: pa.Array | pa.ChunkedArray, rows: int) -> np.ndarray:
    """A list column whose lists are all of one length, as a float64 matrix."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.astype(np.float64).reshape(rows, -1)


def grouped(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Whole groups of rows that follow one another, out of a sorted stream of batches.

    Yields a table and the positions where its groups start and end.  Key columns hold
    integers without nulls.  What is held at a time is one batch and the group that
    reaches beyond it.
    """
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        changed = np.zeros(batch.num_rows, dtype=bool)
        for key in keys:
            values = batch.column(key).to_numpy(zero_copy_only=False)
            changed[1:] |= values[1:] != values[:-1]
            if held:
                last = held[-1].column(key)
                changed[0] |= last[len(last) - 1].as_py() != values[0]
        starts = np.flatnonzero(changed)
        if not len(starts):
            held.append(batch)
            continue
        if held or starts[-1] > 0:
            head = [*held, batch.slice(0, starts[-1])]
            before = sum(b.num_rows for b in held)
            bounds = np.concatenate([[0], starts[:-1] + before, [before + starts[-1]]])
            yield pa.Table.from_batches([b for b in head if b.num_rows]), np.unique(bounds)
        held = [batch.slice(starts[-1])]
    if held:
        table = pa.Table.from_batches(held)
        yield table, np.array([0, table.num_rows])


def roots(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """For nodes 0..n-1 and undirected edges (a, b): the smallest node each one reaches."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        while not np.array_equal(again := new[new], new):
            new = again
        if np.array_equal(new, label):
            return label
        label = new


def connected_components(edges: DataFrame, label: str) -> DataFrame:
    """``(node, component)`` for the nodes of undirected ``edges(a, b)`` of longs.

    Alternating large-star and small-star steps (Kiveris et al., 2014): each is a minimum
    per node, aggregated before the shuffle, and a join that Spark may split where a hub
    is hot.  A step's edges are written before the next one reads them; the steps end
    when the edges are stars.  ``component`` is
    the smallest node reached.  Edges with a null end are ignored.
    """
    spark = edges.sparkSession
    e = cut(
        edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(),
        f"{label}-edges",
    )
    while True:
        ends = e.select(F.col("u").alias("x"), "v", F.lit(True).alias("leaf")).union(e.select("v", F.lit(None).cast("long"), F.lit(False)))
        role = ends.groupBy("x").agg((F.min("v") != F.max("v")).alias("two"), (F.max("leaf") != F.min("leaf")).alias("inner"))
        if not role.agg(F.count_if(F.col("two") | F.col("inner"))).first()[0]:
            break  # every node hangs on one root
        both = e.union(e.select("v", "u"))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(down, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = cut(small.union(down.select("u", F.col("m").alias("v"))).distinct(), f"{label}-star")
    top = e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(top)


def column_names(df: DataFrame, n: int, stem: str = "_t") -> list[str]:
    """Names that ``df`` does not have yet."""
    taken, out, i = {c.lower() for c in df.columns}, [], 0
    while len(out) < n:
        if f"{stem}{i}".lower() not in taken:
            out.append(f"{stem}{i}")
        i += 1
    return out


__all__ = [
    "WORD",
    "column_names",
    "connected_components",
    "cut",
    "grouped",
    "lower_ascii",
    "matrix",
    "roots",
    "scratch_dir",
    "valid_vector",
]
