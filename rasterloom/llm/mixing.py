"""Mixing sources to target weights along a time-varying curriculum.

Targets: sources in code-point order (null last) take turns at ``weights`` and share
``budget`` times all words; a target stops at ``repeats`` times its source's size, and the
excess goes to the others by weight until none is above its own stop.

Order: a source's documents follow one another by a hash of their ids.  Its words are
taken in that order, from the start again when the source is used up, until the target
is reached; the last document is taken in part.

Positions: a schedule (knots of time and weight, joined by lines) says how fast a source is
consumed over the training time 0..1.  Its integral, scaled to the target, is the source's
cumulative demand; a copy's position is the time at which the demand reaches its first word.

Everything is DataFrame expressions.  Prefix sums within a source run over buckets of its
hash range, so that no task holds a whole source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rasterloom.llm.common import WORD, column_names, cut

WEIGHTS = (3.0, 1.0, 2.0)
BUDGET = 1.5
REPEATS = 2
#: Schedules in turn: (time, relative weight) knots from time 0 to 1.
SCHEDULES = (((0.0, 1.0), (1.0, 1.0)), ((0.0, 0.5), (1.0, 1.5)), ((0.0, 1.5), (0.5, 1.0), (1.0, 0.5)))
#: Rows of a bucket, in expectation.
BUCKET_ROWS = 2_000


def targets(sizes: DataFrame, weights=WEIGHTS, budget: float = BUDGET, repeats: float = REPEATS) -> DataFrame:
    """``sizes(source, source_size, n)`` with ``turn``, ``weight`` and ``target``.

    The stop of source i binds while stop_i / weight_i is at most what a unit of weight gets
    from the rest, so one pass in the order of that ratio settles all.  The windows here run
    over one row per source.
    """
    turn = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.col("turn") % len(weights) + 1).cast("int"))
    s = sizes.withColumn("turn", turn).withColumn("weight", w).withColumn("stop", F.lit(float(repeats)) * F.col("source_size"))
    by_ratio = Window.orderBy(F.col("stop") / F.col("weight"), "turn")
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    after = by_ratio.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy()
    s = s.withColumn("left", F.lit(float(budget)) * F.sum("source_size").over(everything) - F.coalesce(F.sum("stop").over(before), F.lit(0.0)))
    s = s.withColumn("level", F.col("left") / F.sum("weight").over(after))
    free = F.when(F.col("stop") / F.col("weight") > F.col("level"), F.col("level"))
    s = s.withColumn("per", F.first(free, ignorenulls=True).over(by_ratio.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    target = F.least(F.col("stop"), F.coalesce(F.col("per") * F.col("weight"), F.col("stop")))
    return s.select("source", "source_size", "n", "turn", target.alias("target"))


def _segments(knots) -> tuple[list[tuple[float, ...]], float]:
    out, area = [], 0.0
    for (t0, w0), (t1, w1) in zip(knots[:-1], knots[1:], strict=True):
        a = (t1 - t0) * (w0 + w1) / 2
        out.append((t0, t1, w0, w1, area, area + a))
        area += a
    return [(t0, t1, w0, w1, a0 / area, a1 / area) for t0, t1, w0, w1, a0, a1 in out], area


def position(share: Column, turn: Column, schedules=SCHEDULES) -> Column:
    """The time at which a source has given ``share`` (0..1) of its target."""
    out = F.lit(None).cast("double")
    for k, knots in enumerate(schedules):
        parts, area = _segments(knots)
        at = F.lit(float(parts[-1][1]))
        for t0, t1, w0, w1, a0, a1 in reversed(parts):
            need = (share - a0) * area
            slope = (w1 - w0) / (t1 - t0)
            if slope:
                step = (F.sqrt(F.greatest(F.lit(w0 * w0) + need * (2 * slope), F.lit(0.0))) - w0) / slope
            else:
                step = need / w0
            at = F.when(share < a1, F.lit(t0) + step).otherwise(at)
        out = F.when(turn % len(schedules) == k, at).otherwise(out)
    return out


def plan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights=WEIGHTS, budget: float = BUDGET, repeats: int = REPEATS, schedules=SCHEDULES) -> DataFrame:
    """What the mix takes of every row, sorted by training position over the partitions.

    Returns ``id, source, size, source_size, target, taken, position, lead, turn``: words of
    the text (0 for null), of the source, the source's target, the words taken with repeats
    (at most ``repeats`` times the size), the position of the first copy (null if nothing is
    taken), the words of the source that come before.  Null sources are one source, the
    last.  Rows with the same id follow one another; a null id is hashed like an empty one.
    Other columns play no part.  The same rows give the same plan again.
    """
    src = docs.select(
        F.col(f"`{id_col}`").alias("id"),
        F.col(f"`{source_col}`").alias("source"),
        F.coalesce(F.regexp_count(F.col(f"`{text_col}`"), F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
    )
    rows = cut(src, "sizes")
    t = cut(targets(rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n")), weights, budget, repeats), "targets")
    mark = F.md5(F.concat_ws("/", F.coalesce(F.col("id").cast("string"), F.lit("")), F.col("size").cast("string")))
    span = F.conv(F.substring("mark", 1, 8), 16, 10).cast("double") / float(1 << 32)
    d = rows.join(t, rows["source"].eqNullSafe(t["source"])).drop(t["source"]).withColumn("mark", mark)
    d = d.withColumn("bucket", F.floor(span * F.ceil(F.col("n") / BUCKET_ROWS)).cast("long"))
    sums = d.groupBy("turn", "bucket").agg(F.sum("size").alias("in_bucket"))
    run = Window.partitionBy("turn").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("turn", "bucket", F.coalesce(F.sum("in_bucket").over(run), F.lit(0)).alias("off"))
    within = Window.partitionBy("turn", "bucket").orderBy("mark", "id").rowsBetween(Window.unboundedPreceding, -1)
    d = d.join(sums, ["turn", "bucket"]).withColumn("lead", F.col("off") + F.coalesce(F.sum("size").over(within), F.lit(0)))
    goal = F.floor(F.col("target") + 0.5).cast("long")
    whole = F.when(F.col("source_size") > 0, F.floor(goal / F.col("source_size"))).otherwise(0).cast("long")
    rest = F.least(F.greatest(goal - whole * F.col("source_size") - F.col("lead"), F.lit(0)), F.col("size"))
    d = d.withColumn("taken", whole * F.col("size") + rest)
    share = F.when(F.col("taken") > 0, F.col("lead") / F.greatest(F.col("target"), F.lit(1.0)))
    d = d.withColumn("position", position(share, F.col("turn"), schedules))
    return d.select("id", "source", "size", "source_size", "target", "taken", "position", "lead", "turn").orderBy("position", "turn", "lead", "id")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", schedules=SCHEDULES, **how) -> DataFrame:
    """The mixed documents, copies and all, sorted by training position.

    Returns the columns of ``docs``; a document taken in part keeps its first words, blanks
    between.  Rows that share an id and a source are told apart by size; equal ones
    are treated alike.  A null text has no words, so it is not taken; a null source is one of its own; rows without an
    id are taken as others are.  Equal positions are ordered by source, place in it and copy, so reruns agree.  An empty table gives an
    empty result.
    """
    decided = plan(docs, id_col, text_col, source_col, schedules=schedules, **how).where("taken > 0")
    decided = cut(decided.groupBy("id", "source", "size").agg(*[F.max(c).alias(c) for c in ("taken", "lead", "turn", "source_size", "target")]), "plan")
    names = docs.columns
    # columns of the plan get names that the documents don't have
    free = dict(zip([*decided.columns, "words", "copy", "position"], column_names(docs, len(decided.columns) + 3), strict=True))
    right = decided.withColumnsRenamed({c: free[c] for c in decided.columns})
    c = {name: F.col(other) for name, other in free.items()}
    text = F.col(f"`{text_col}`")
    left = docs.withColumn(free["words"], F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long"))
    both = left.join(right, F.col(f"`{id_col}`").eqNullSafe(c["id"]) & F.col(f"`{source_col}`").eqNullSafe(c["source"]) & (c["words"] == c["size"]))
    both = both.withColumn(free["copy"], F.explode(F.sequence(F.lit(0), (F.ceil(c["taken"] / c["words"]) - 1).cast("int"))))
    part = c["taken"] - c["copy"] * c["words"]
    cut_text = F.array_join(F.slice(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), 1, part.cast("int")), " ")
    both = both.withColumn(text_col, F.when(part < c["words"], cut_text).otherwise(text))
    share = (c["lead"] + c["copy"] * c["source_size"]) / F.greatest(c["target"], F.lit(1.0))
    both = both.withColumn(free["position"], position(share, c["turn"], schedules))
    return both.orderBy(c["position"], c["turn"], c["lead"], c["copy"]).select(*[F.col(f"`{name}`") for name in names])
