"""Near-duplicate vectors by Euclidean p-stable hashing with exact cosine checks.

A normalised vector's bucket in a table is the tuple of ``floor((a . x + b) / w)`` over some
Gaussian directions ``a``.  ``plan`` takes so many directions that about ``MATES`` unrelated vectors
share a bucket, whatever the number of vectors, and so many tables that a pair at the threshold
shares none of their buckets with probability ``MISS`` at most: 13 directions and 43 tables for 50,000 vectors and
cosine 0.9, 26 and 338 for 50 million.  Nearer pairs are missed far less often: at
cosine 0.95, 43 tables of 13 miss one in 200,000.

Equal vectors are one row from the first step on.  A bucket of more than ``BLOCK`` rows is
dealt into blocks, and a unit of work compares two blocks.  Rows first travel with 128 sign bits of
random planes; only those with a partner within the bits that the threshold makes likely (6.3
standard deviations) are given their vectors and compared exactly.  A pair that shares buckets in
several tables counts in the first of them only, so link counts need no list of pairs; for
components a unit emits a star for each component that it sees.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rasterloom.llm.common import connected_components, cut, grouped, matrix, roots, valid_vector
from rasterloom.llm.minhash import mix

#: Unrelated vectors in a bucket, and the chance that a pair at the threshold is missed.
MATES = 32
MISS = 0.002
#: Directions of a table at least.
LEAST_HASHES = 12
WIDTH = 2.5
BLOCK = 1024
#: A unit of work: a bucket and two of its blocks, the smaller times ``SIDES`` plus the larger; ``one`` tells
#: the rows of the smaller.
UNIT = ["key", "unit"]
SIDES = 1 << 31
#: Sign bits of a sketch.
BITS = 128
#: Whole numbers of this fineness stand for parts of vectors and directions.
SCALE = float(1 << 20)


def collision(distance: float, width: float = WIDTH) -> float:
    """The chance that one rounded projection of two vectors at a distance is the same."""
    x = width / max(distance, 1e-9)
    return math.erf(x / math.sqrt(2)) - 2 / (math.sqrt(2 * math.pi) * x) * (1 - math.exp(-x * x / 2))


def plan(n: int, threshold: float) -> tuple[int, int]:
    """Tables and directions in each for ``n`` vectors; unrelated ones are at right angles."""
    hashes = max(LEAST_HASHES, math.ceil(math.log(max(n, 1) / MATES) / -math.log(collision(math.sqrt(2))))) if n > MATES else LEAST_HASHES
    near = collision(math.sqrt(max(0.0, 2 - 2 * threshold))) ** hashes
    return math.ceil(math.log(MISS) / math.log1p(-min(near, 1 - 1e-9))), hashes


def unit_rows(x: np.ndarray) -> np.ndarray:
    """Rows divided by their lengths, in double precision."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def bucket_keys(u: np.ndarray, seed: int, tables: int, hashes: int, width: float = WIDTH) -> np.ndarray:
    """One key per row and table.  A row's keys don't depend on the rows beside it.

    Vectors and directions are rounded to integers before they are multiplied, so sums are exact
    in whatever order they are made.
    """
    rng = np.random.default_rng([seed, u.shape[1]])
    a = np.rint(rng.standard_normal((u.shape[1], tables * hashes)) * SCALE)
    b = rng.uniform(0, width, tables * hashes)
    out = np.empty((len(u), tables), dtype=np.uint64)
    for s in range(0, len(u), 512):
        dots = np.rint(u[s : s + 512] * SCALE) @ a / (SCALE * SCALE)
        cell = np.floor((dots + b) / width).astype(np.int64).view(np.uint64).reshape(-1, tables, hashes)
        key = np.full((len(cell), tables), u.shape[1], dtype=np.uint64) + np.arange(tables, dtype=np.uint64)
        for j in range(hashes):
            key = mix(key * np.uint64(0x9E3779B97F4A7C15) + cell[:, :, j])
        out[s : s + 512] = key
    return out


def sketches(u: np.ndarray, seed: int) -> np.ndarray:
    """Two words of sign bits per row: on which sides of ``BITS`` random planes it lies."""
    a = np.random.default_rng([seed, u.shape[1], BITS]).standard_normal((u.shape[1], BITS))
    return np.packbits(u @ a > 0, axis=1).view(np.int64)


def most_bits(threshold: float) -> int:
    """Differing bits of two sketches that a pair at the threshold exceeds in 6.3 standard deviations only."""
    p = float(np.arccos(np.clip(threshold, -1, 1)) / np.pi)
    return int(BITS * p + 6.3 * np.sqrt(BITS * p * (1 - p))) + 1


def _hash(seed: int, tables: int, hashes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            lens = np.diff(batch.column("vec").offsets.to_numpy())
            keys, bits = np.empty((batch.num_rows, tables), dtype=np.uint64), np.empty((batch.num_rows, 2), dtype=np.int64)
            for d in np.unique(lens):
                rows = np.flatnonzero(lens == d)
                u = unit_rows(matrix(batch.column("vec").take(pa.array(rows)), len(rows)))
                keys[rows], bits[rows] = bucket_keys(u, seed, tables, hashes), sketches(u, seed)
            at = np.arange(0, keys.size + 1, tables, dtype=np.int32)
            lists = pa.ListArray.from_arrays(at, pa.array(keys.reshape(-1).view(np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column("id"), lists, pa.array(bits[:, 0]), pa.array(bits[:, 1])], names=["id", "keys", "s0", "s1"])

    return run


def _sieve(most: int):
    """Rows of units, sorted: those that have a partner whose sketch differs in few bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, at in grouped(batches, UNIT):
            unit, one_side = rows["unit"].to_numpy(), rows["one"].to_numpy()
            inner = unit % SIDES == unit // SIDES
            s0, s1 = (rows[c].to_numpy().view(np.uint64) for c in ("s0", "s1"))
            end = np.repeat(at[1:], np.diff(at))
            near, step, one = np.zeros(rows.num_rows, dtype=bool), 1, np.arange(rows.num_rows)
            while len(one := one[one + step < end[one]]):
                two = one + step
                bits = np.bitwise_count(s0[one] ^ s0[two]) + np.bitwise_count(s1[one] ^ s1[two])
                hit = (bits <= most) & (inner[one] | (one_side[one] != one_side[two]))
                near[one[hit]] = near[two[hit]] = True
                step += 1
            kept = np.flatnonzero(near)
            if len(kept):
                yield from rows.select([*UNIT, "one", "id"]).take(pa.array(kept)).combine_chunks().to_batches()

    return run


def _first_meeting(a: np.ndarray, b: np.ndarray, keys: np.ndarray, table: int) -> np.ndarray:
    """True for pairs that share no bucket of an earlier table."""
    left = np.arange(len(a))
    for t in range(table):
        if not len(left):
            break
        left = left[keys[a[left], t] != keys[b[left], t]]
    out = np.zeros(len(a), dtype=bool)
    out[left] = True
    return out


def _compare(threshold: float, seed: int, tables: int, hashes: int):
    """Rows of units, sorted: for each row the weight of new links and a node of its component."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, at in grouped(batches, UNIT):
            n = rows.num_rows
            lens = np.diff(rows["vec"].combine_chunks().offsets.to_numpy())
            if lens.min() != lens.max():
                parts = [(rows.slice(s, e - s), np.array([0, e - s])) for s, e in zip(at[:-1], at[1:], strict=True)]
            else:
                parts = [(rows, at)]
            for part, bounds in parts:
                n = part.num_rows
                u = unit_rows(matrix(part["vec"], n))
                ids, weight, key, unit, one_side = (part[c].to_numpy() for c in ("id", "weight", "key", "unit", "one"))
                inner = unit % SIDES == unit // SIDES
                left, right = [], []
                for s, e in zip(bounds[:-1], bounds[1:], strict=True):
                    if e - s < 2:
                        continue
                    if inner[s]:
                        one = two = np.arange(s, e)
                    else:
                        one, two = (s + np.flatnonzero(one_side[s:e] == x) for x in (True, False))
                    p, q = np.nonzero(u[one] @ u[two].T >= threshold)
                    p, q = one[p], two[q]
                    if inner[s]:
                        p, q = p[p < q], q[p < q]
                    left.append(p)
                    right.append(q)
                if not left or not sum(map(len, left)):
                    continue
                a, b = np.concatenate(left), np.concatenate(right)
                met, back = np.unique(np.r_[a, b], return_inverse=True)
                keys = bucket_keys(u[met], seed, tables, hashes)
                table = (keys == key[met].view(np.uint64)[:, None]).argmax(axis=1)
                a, b = back[: len(a)], back[len(a) :]
                count = np.zeros(len(met), dtype=np.int64)
                for t in np.unique(table):
                    mine = table[a] == t
                    new = np.flatnonzero(mine)[_first_meeting(a[mine], b[mine], keys, int(t))]
                    np.add.at(count, a[new], weight[met[b[new]]])
                    np.add.at(count, b[new], weight[met[a[new]]])
                top = roots(a, b, len(met))
                yield pa.RecordBatch.from_arrays([pa.array(ids[met]), pa.array(ids[met[top]]), pa.array(count)], names=["id", "other", "links"])

    return run


def near_vectors(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", threshold: float = 0.9, seed: int = 7) -> DataFrame:
    """Links between vectors of cosine ``threshold`` or more, in double precision.

    Returns ``id, n_links, component_id, kept`` for every row: how many other rows it links
    with directly, the smallest id it reaches, and whether that is its own.  Vectors that
    are null, empty, zero or hold null or non-finite parts link with nothing; vectors of
    different lengths don't link.  Rows that share an id are one node; their vectors are
    counted as the rows they are.  A row with a null id has neither links nor component.
    A cosine equal to the threshold links; an empty table gives an empty result.  Other columns play no part.
    """
    kind = "array<float>" if df.select(F.col(f"`{vec_col}`")).dtypes[0][1] == "array<float>" else "array<double>"
    rows = df.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{vec_col}`").cast(kind).alias("vec"))
    usable = rows.where(valid_vector(F.col("vec")) & F.col("id").isNotNull())
    one = usable.groupBy("vec").agg(F.min("id").alias("id"), F.count("*").alias("weight"))
    # two different vectors may share an id, so distinct vectors get numbers of their own
    one = cut(one.select("id", "weight", "vec", F.monotonically_increasing_id().alias("rep")), "vectors")
    tables, hashes = plan(one.count(), threshold)
    keyed = cut(one.select(F.col("rep").alias("id"), "vec").mapInArrow(_hash(seed, tables, hashes), "id long, keys array<long>, s0 long, s1 long"), "buckets")
    entries = keyed.select("id", "s0", "s1", F.explode("keys").alias("key"))
    large = cut(entries.groupBy("key").agg(F.count("*").alias("size")).where(F.col("size") > BLOCK), "large")
    parts = F.coalesce(F.ceil(F.col("size") / BLOCK), F.lit(1)).cast("long")
    side = F.pmod(F.xxhash64("id"), F.col("parts"))
    units = entries.join(large, "key", "left").withColumn("parts", parts).withColumn("side", side)
    units = units.withColumn("o", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    number = F.least("side", "o") * SIDES + F.greatest("side", "o")
    units = units.select("key", number.alias("unit"), (F.col("side") <= F.col("o")).alias("one"), "id", "s0", "s1")
    units = units.repartition(*UNIT).sortWithinPartitions(*UNIT)
    # vectors join only rows of a unit that have a likely partner there
    likely = cut(units.mapInArrow(_sieve(most_bits(threshold)), "key long, unit long, one boolean, id long"), "likely")
    work = likely.join(one.select(F.col("rep").alias("id"), "weight", "vec"), "id")
    work = work.repartition(*UNIT).sortWithinPartitions(*UNIT, "id")
    found = cut(work.mapInArrow(_compare(threshold, seed, tables, hashes), "id long, other long, links long"), "links")

    counts = found.groupBy("id").agg(F.sum("links").alias("links"))
    per = one.join(counts.withColumnRenamed("id", "rep"), "rep", "left").select("rep", "id", "vec", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n"))
    per = cut(per, "counted")
    number = per.select("rep", F.col("id").alias("first"))
    edges = found.where("id <> other").select("id", "other").distinct()
    edges = edges.join(number.withColumnRenamed("rep", "id").withColumnRenamed("first", "a"), "id")
    edges = edges.join(number.withColumnRenamed("rep", "other").withColumnRenamed("first", "b"), "other").select("a", "b")
    row = usable.join(per.select("vec", "n", F.col("id").alias("first")), "vec").select("id", "n", "first")
    same = row.where("id <> first").select(F.col("id").alias("a"), F.col("first").alias("b"))
    # copies hang on the first id of their vector; only ids that stand for several vectors need more edges
    labels = connected_components(edges, "components")
    shared = row.groupBy("id").agg(F.count_distinct("first").alias("k")).where("k > 1").select("id")
    if not shared.isEmpty():
        labels = connected_components(edges.union(same.join(shared.withColumnRenamed("id", "a"), "a", "left_semi")), "components")
    tied = row.join(labels.select(F.col("node").alias("first"), "component"), "first", "left")
    tied = tied.groupBy("id").agg(F.max("n").alias("n"), F.min(F.coalesce("component", "first")).alias("component"))
    out = rows.select("id").join(tied, "id", "left")
    root = F.coalesce("component", "id")
    return out.select("id", F.coalesce("n", F.lit(0)).alias("n_links"), root.alias("component_id"), F.coalesce(F.col("id") == root, F.lit(False)).alias("kept"))
