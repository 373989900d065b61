import math

import numpy as np
from pyspark.sql import functions as F

from rasterloom.llm import negatives
from rasterloom.llm.negatives import hard_negatives

SCHEMA = "vec_id long, embedding array<double>, label long, rank string"


def plain(rows, anchor, positives=5, negs=10, low=30, high=90, scale=256):
    good = {}
    for i, v, c, *_ in rows:
        if i is not None and c is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            good[i, c, tuple(v)] = [math.floor(max(min(x * scale, 2.0**62), -(2.0**62))) for x in v]
    out = []
    for (i, c, raw), v in good.items():
        if not anchor(i):
            continue
        scored = [(-max(min(sum(a * b for a, b in zip(v, w)), 2**63 - 2), -(2**63) + 3), j, d) for (j, d, r), w in good.items() if len(w) == len(v)]
        own = sorted(s[:2] for s in scored if s[2] == c and s[1] != i)[:positives]
        for k, (p, j) in enumerate(own):
            fit = sorted(s[:2] for s in scored if s[2] != c and low * -p <= -100 * s[0] <= high * -p)[:negs]
            out += [(i, j, k + 1, n + 1, m, -p, -s) for n, (s, m) in enumerate(fit)]
    return sorted(out)


def rows_of(n, dim, seed, spread=1.0):
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((n, dim)) * rng.exponential(spread, (n, 1))
    x[: n // 10] = x[0]
    return [(i, [float(a) for a in v], int(rng.integers(4)) if i % 3 else 0, "r") for i, v in enumerate(x)]


def run(spark, rows, every=10, **more):
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    return sorted(tuple(r) for r in hard_negatives(df, F.col("vec_id") % every == 0, **more).collect())


def test_against_all_products(spark):
    odd = [(900, None, 1, ""), (910, [1.0] * 8, None, ""), (920, [float("nan")] * 8, 1, ""), (930, [1.0, None] * 4, 1, ""), (940, [0.0] * 8, 1, ""), (950, [], 2, "")]
    odd += [(960, [1.0, 2.0], 1, ""), (961, [1.0, 2.0], 1, ""), (962, [0.5, 1.0], 2, ""), (None, [1.0] * 8, 1, ""), (970, [2.0] * 8, 1, ""), (970, [-2.0] * 8, 1, ""), (971, [float("inf")] * 8, 1, "")]
    rows = rows_of(300, 8, 1) + odd
    rows += rows[:5]
    assert run(spark, rows) == plain(rows, lambda i: i % 10 == 0)


def test_blocks_buckets_and_pruning(spark, monkeypatch):
    monkeypatch.setattr(negatives, "BLOCK", 7)
    monkeypatch.setattr(negatives, "BUCKET", 5)
    monkeypatch.setattr(negatives, "ROWS", 3)
    rows = rows_of(400, 6, 2, 3.0)
    assert run(spark, rows, positives=3, negatives=4, low=50, high=100) == plain(rows, lambda i: i % 10 == 0, 3, 4, 50, 100)


def test_huge_components_are_exact_or_end_at_a_long(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in rng.standard_normal(3) * 10.0 ** (i % 4 * 5)], i % 2, "") for i in range(60)]
    rows += [(100, [1e30, 1e-30, 5.0], 0, ""), (101, [1e30, 0.0, 5.0], 0, ""), (102, [1e300, 2.0, 5.0], 1, "")]
    assert run(spark, rows, 20) == plain(rows, lambda i: i % 20 == 0)


def test_anchors_leave_when_no_bucket_can_reach_them():
    import pyarrow as pa

    def table(norms):
        n = len(norms)
        return {
            "row": pa.array(range(n)), "id": pa.array(range(n)), "label": pa.array([0] * n), "norm": pa.array([float(x) for x in norms]),
            "vec": pa.array([[float(x)] for x in norms]), "low": pa.array([[400]] * n), "high": pa.array([[negatives.HIGH - 1]] * n),
        }

    best = negatives._Best(pa.table(table([10, 20])), 2, True)
    cand = table([50, 30, 3, 2])
    cand["id"] = pa.array([7, 8, 9, 10])
    batch = pa.RecordBatch.from_pydict(cand)
    best.meet(batch.slice(0, 2))
    assert len(best.alive) == 2
    best.meet(batch.slice(2, 2))
    assert len(best.alive) == 0 and best.score.tolist() == [[[500, negatives.LOW]], [[1000, 600]]]


def test_empty(spark):
    rows = rows_of(20, 3, 4)
    df = spark.createDataFrame(rows, SCHEMA)
    assert hard_negatives(df.limit(0), F.col("vec_id") % 10 == 0).count() == 0
    assert hard_negatives(df, F.lit(False)).count() == 0
    assert hard_negatives(df.withColumn("label", F.lit(1)), F.col("vec_id") == 0).count() == 0
