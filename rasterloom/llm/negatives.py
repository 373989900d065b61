"""Hard negatives by maximum inner product, searched in buckets of falling norm.

Anchors are dealt into blocks and candidates into shards.  A task meets one block with one
shard, whose rows come by falling norm and are taken in buckets.  By Cauchy and Schwarz no
row of a bucket scores more than the anchor's norm times that of the bucket's first row: an
anchor leaves as soon as that is below the lower limits of all its windows or below the kth
score that it already has in each.  The lists of an anchor's shards are merged afterwards.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rasterloom.llm.common import cut, matrix

#: Anchors that a task holds; candidates stream past them.
BLOCK = 65536
#: Candidates of a bucket, and anchors multiplied with them at a time.
BUCKET, ROWS = 1024, 2048
#: Scaled components and scores are held within these bounds.
PART, LOW, HIGH = 2.0**62, -(2**63) + 2, 2**63 - 1
#: Products below this are exact in double precision.
EXACT = 2.0**53

_KEYS = ["grp", "size", "block", "shard"]
_STREAM = [*_KEYS, "role", "norm", "row", "id", "label", "vec", "low", "high"]


def quantised(vec: Column, scale: int) -> Column:
    """Whole numbers floor(scale * x) of the components, as doubles; huge ones end at 2^62."""
    return F.transform(vec, lambda x: F.floor(F.greatest(F.least(x.cast("double") * scale, F.lit(PART)), F.lit(-PART))).cast("double"))


class _Best:
    """The best k candidates in each window of each anchor of a block."""

    def __init__(self, anchors: pa.Table, k: int, same: bool) -> None:
        n = anchors.num_rows
        self.same = same
        self.row, self.id, self.label, self.norm = (anchors[c].to_numpy() for c in ("row", "id", "label", "norm"))
        self.vec = matrix(anchors["vec"], n)
        self.low, self.high = (np.array(anchors[c].to_pylist(), dtype=np.int64).reshape(n, -1) for c in ("low", "high"))
        self.score = np.full((*self.low.shape, k), LOW, dtype=np.int64)
        self.found = np.full((*self.low.shape, k), HIGH, dtype=np.int64)
        self.alive = np.arange(n)

    def _need(self, rows: np.ndarray) -> np.ndarray:
        """The least score that can still enter one of the windows of these anchors."""
        need = np.maximum(self.low[rows], self.score[rows, :, -1])
        return np.where(self.low[rows] <= self.high[rows], need, HIGH).min(axis=1)

    def meet(self, rows: pa.RecordBatch) -> None:
        """Take candidates, which come by falling norm."""
        norm, id_, label = (rows.column(c).to_numpy() for c in ("norm", "id", "label"))
        vec = None
        for s in range(0, rows.num_rows, BUCKET):
            bound = self.norm[self.alive] * norm[s] * (1 + 1e-9)
            self.alive = self.alive[bound >= self._need(self.alive)]
            if not len(self.alive):
                return
            vec = matrix(rows.column("vec"), rows.num_rows) if vec is None else vec
            e = s + BUCKET
            for a in range(0, len(self.alive), ROWS):
                self._score(self.alive[a : a + ROWS], vec[s:e], norm[s], id_[s:e], label[s:e])

    def _score(self, rows: np.ndarray, vec: np.ndarray, norm: float, id_: np.ndarray, label: np.ndarray) -> None:
        left = self.vec[rows]
        if self.norm[rows].max() * norm < EXACT:
            score = np.rint(left @ vec.T).astype(np.int64)
        else:
            whole = [[[int(x) for x in r] for r in m.tolist()] for m in (left, vec)]
            score = np.array([[min(max(sum(p * q for p, q in zip(a, c, strict=True)), LOW + 1), HIGH - 1) for c in whole[1]] for a in whole[0]], dtype=np.int64)
        fit = (self.label[rows][:, None] == label) == self.same
        if self.same:
            fit &= self.id[rows][:, None] != id_
        for w in range(self.low.shape[1]):
            least = np.maximum(self.low[rows, w], self.score[rows, w, -1])
            hit = fit & (score >= least[:, None]) & (score <= self.high[rows, w][:, None])
            r, c = np.nonzero(hit)
            if len(r):
                self._merge(w, rows[r], score[r, c], id_[c])

    def _merge(self, w: int, rows: np.ndarray, score: np.ndarray, id_: np.ndarray) -> None:
        k = self.score.shape[2]
        met = np.unique(rows)
        r = np.r_[np.repeat(met, k), rows]
        s = np.r_[self.score[met, w].ravel(), score]
        i = np.r_[self.found[met, w].ravel(), id_]
        order = np.lexsort((i, -s, r))
        take = order[np.searchsorted(r[order], met)[:, None] + np.arange(k)]
        self.score[met, w], self.found[met, w] = s[take], i[take]

    def lists(self) -> Iterator[pa.RecordBatch]:
        r, w, k = np.nonzero(self.score > LOW)
        if len(r):
            cols = [self.row[r], w.astype(np.int32), self.found[r, w, k], self.score[r, w, k]]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["row", "win", "found", "score"])


def _search(k: int, same: bool):
    """Over a sorted stream of rows of (group, size, block, shard): anchors first, then candidates by falling norm."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, anchors, best = None, [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.stack([batch.column(c).to_numpy() for c in (*_KEYS, "role")], axis=1)
            starts = np.r_[0, 1 + np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)), batch.num_rows]
            for s, e in zip(starts[:-1], starts[1:], strict=True):
                part, (*key, role) = batch.slice(s, e - s), keys[s].tolist()
                if key != now:
                    if best is not None:
                        yield from best.lists()
                    now, anchors, best = key, [], None
                if role == 0:
                    anchors.append(part)
                elif anchors:
                    best = best or _Best(pa.Table.from_batches(anchors), k, same)
                    best.meet(part)
        if best is not None:
            yield from best.lists()

    return run


def _meet(anchors: DataFrame, items: DataFrame, on: list[str], k: int, same: bool) -> DataFrame:
    """``row, win, found, score``: the best ``k`` candidates of every window of every anchor."""
    some = anchors.groupBy(*on).agg(F.count("*").alias("n_anchors"))
    plan = some.join(items.groupBy(*on).agg(F.count("*").alias("n_items")), on)
    blocks = F.ceil(F.col("n_anchors") / BLOCK).cast("long")
    # shards grow as the square root of the candidates, so that copies of anchors don't outgrow them
    shards = F.ceil(F.sqrt("n_items") / 8).cast("long")
    plan = cut(plan.select(*on, blocks.alias("blocks"), shards.alias("shards")), "plan")

    def dealt(df: DataFrame, own: str, other: str, role: int) -> DataFrame:
        own_part = F.pmod(F.xxhash64("row"), F.col(f"{own}s")).alias(own)
        all_parts = F.explode(F.sequence(F.lit(0).cast("long"), F.col(f"{other}s") - 1)).alias(other)
        grp = F.col("label").cast("long") if "label" in on else F.lit(0).cast("long")
        return df.join(plan, on).select("*", own_part, all_parts, grp.alias("grp"), F.lit(role).cast("long").alias("role")).select(*_STREAM)

    none = F.lit(None).cast("array<long>")
    stream = dealt(anchors, "block", "shard", 0).unionByName(dealt(items.withColumn("low", none).withColumn("high", none), "shard", "block", 1))
    stream = stream.repartition(*_KEYS).sortWithinPartitions(*_KEYS, "role", F.desc("norm"), "id")
    lists = stream.mapInArrow(_search(k, same), "row long, win int, found long, score long")
    order = Window.partitionBy("row", "win").orderBy(F.desc("score"), "found")
    return lists.withColumn("n", F.row_number().over(order)).where(F.col("n") <= k)


def hard_negatives(
    df: DataFrame,
    is_anchor: Column,
    id_col: str = "vec_id",
    vec_col: str = "embedding",
    label: Column | str = "label",
    positives: int = 5,
    negatives: int = 10,
    low: int = 30,
    high: int = 90,
    scale: int = 256,
) -> DataFrame:
    """For every anchor and each of its positives, rows of other labels that score nearly as much.

    Scores are whole numbers: inner products of floor(``scale`` * x).  An anchor's positives are its best ``positives``
    rows of its own label and another id; for each, the best ``negatives`` rows of another label whose score lies
    between ``low`` and ``high`` percent of the positive's.  Returns ``anchor_id, positive_id, positive_rank,
    rank, negative_id, positive_score, negative_score``; higher scores come first, ties by smaller id.

    Rows with a null id, label or vector, or a null or non-finite component, take no part; zero vectors do.
    Vectors of different lengths never meet.  Equal rows are one row; rows that share an id but not the rest
    stand for themselves.  A positive of negative score has no negatives.  Scaled components end at 2^62
    and scores at the ends of a long.  An empty table, or one without anchors, gives an empty result; other columns play no part.
    """
    vec = F.col(f"`{vec_col}`")
    name = F.col(f"`{label}`") if isinstance(label, str) else label
    rows = df.select(F.col(f"`{id_col}`").cast("long").alias("id"), name.cast("long").alias("label"), vec.alias("raw"), F.coalesce(is_anchor, F.lit(False)).alias("anchor"))
    finite = F.forall("raw", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = rows.where(F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("raw").isNotNull() & F.coalesce(finite, F.lit(False)))
    rows = rows.select("id", "label", "anchor", quantised(F.col("raw"), scale).alias("vec")).dropDuplicates(["id", "label", "vec"])
    norm = F.sqrt(F.aggregate("vec", F.lit(0.0), lambda a, x: a + x * x))
    items = cut(rows.select(F.monotonically_increasing_id().alias("row"), "id", "label", F.size("vec").cast("long").alias("size"), norm.alias("norm"), "vec", "anchor"), "items")
    whole = F.array(F.lit(LOW + 1).cast("long")), F.array(F.lit(HIGH - 1).cast("long"))
    anchors = items.where("anchor").drop("anchor")
    items = items.drop("anchor")

    near = _meet(anchors.withColumn("low", whole[0]).withColumn("high", whole[1]), items, ["label", "size"], positives, True)
    near = cut(near.select("row", F.col("n").alias("positive_rank"), F.col("found").alias("positive_id"), F.col("score").alias("positive_score")), "positives")

    # low * score <= 100 * s <= high * score in whole numbers; of a negative score there are none
    tens, rest = F.expr("positive_score div 100"), F.expr("positive_score % 100")
    least, most = low * tens + F.ceil(low * rest / 100), high * tens + F.floor(high * rest / 100)
    some = F.col("positive_score") >= 0
    side = F.struct("positive_rank", F.when(some, least).otherwise(1).alias("low"), F.when(some, most).otherwise(0).alias("high"))
    sides = near.groupBy("row").agg(F.array_sort(F.collect_list(side)).alias("sides"))
    empty = {c: F.array_repeat(F.lit(v).cast("long"), positives) for c, v in (("low", 1), ("high", 0))}
    padded = [F.slice(F.concat(F.col(f"sides.{c}"), fill), 1, positives).alias(c) for c, fill in empty.items()]
    asking = anchors.join(sides, "row").select(*anchors.columns, *padded)
    hard = _meet(asking, items, ["size"], negatives, False)
    hard = hard.select("row", (F.col("win") + 1).alias("positive_rank"), F.col("n").alias("rank"), F.col("found").alias("negative_id"), F.col("score").alias("negative_score"))
    out = hard.join(near, ["row", "positive_rank"]).join(anchors.select("row", F.col("id").alias("anchor_id")), "row")
    return out.select("anchor_id", "positive_id", "positive_rank", "rank", "negative_id", "positive_score", "negative_score")
