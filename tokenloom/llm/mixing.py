"""Mixing sources to target weights along a time-varying curriculum.  DataFrame functions only."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tokenloom.llm._common import WORD, materialise

#: Documents of a slice, on average, if all were of one source.  Sources are cut into slices by hash; running sums are made within
#: a slice and over slices, so no source goes to one task.  Places of slices that are broadcast at most.
SLICE, BROADCAST_PLACES = 5_000, 200_000
#: A schedule: knots (time from 0 to 1, relative weight) with straight lines between them.
Schedule = Sequence[tuple[float, float]]
RISING: Schedule = ((0.0, 0.5), (1.0, 1.5))
FALLING: Schedule = ((0.0, 1.5), (1.0, 0.5))


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sources: DataFrame, weights: Sequence[float], share: float, most: float) -> DataFrame:
    """(source, source_size) to (source, source_size, rank, weight, target).

    Sources by code point, null last, take ``weights`` in turn and divide ``share`` times all sizes; none gets more than
    ``most`` times its size, what is above being divided anew by weight.  In order of size over weight the sources that end
    at their cap come first, so running sums find the level in one pass.  The table has a row per source.
    """
    ordered = Window.orderBy(F.col("source").asc_nulls_last())
    ranked = sources.withColumn("rank", F.row_number().over(ordered) - 1)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    total = Window.partitionBy()
    rows = ranked.withColumn("weight", weight).withColumn("cap", most * F.col("source_size").cast("double")).withColumn("whole", share * F.sum("source_size").over(total).cast("double"))
    by = Window.orderBy(F.col("cap") / F.col("weight"), "rank")
    before = by.rowsBetween(Window.unboundedPreceding, -1)
    after = by.rowsBetween(0, Window.unboundedFollowing)
    rows = rows.withColumn("level", (F.col("whole") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(after))
    free = F.col("level") <= F.col("cap") / F.col("weight")
    rows = rows.withColumn("first", F.min(F.when(free, F.struct((F.col("cap") / F.col("weight")).alias("r"), "rank", "level"))).over(total))
    capped = F.col("first").isNull() | (F.struct((F.col("cap") / F.col("weight")).alias("r"), "rank") < F.struct(F.col("first.r").alias("r"), F.col("first.rank").alias("rank")))
    return rows.select("source", "source_size", "rank", "weight", F.when(capped, F.col("cap")).otherwise(F.col("first.level") * F.col("weight")).alias("target"))


def invert(schedule: Schedule, share: Column) -> Column:
    """The time by which a schedule has demanded ``share`` (0 to 1) of its whole: the integral of straight lines, inverted."""
    knots = sorted((float(t), float(w)) for t, w in schedule)
    areas = [(b[0] - a[0]) * (a[1] + b[1]) / 2 for a, b in zip(knots, knots[1:], strict=False)]
    whole = sum(areas)
    if len(knots) < 2 or knots[0][0] != 0 or knots[-1][0] != 1 or min(w for _, w in knots) < 0 or whole <= 0:
        raise ValueError("a schedule runs from 0 to 1 and has a positive integral")
    want, out, done = F.greatest(F.lit(0.0), F.least(F.lit(1.0), share)) * whole, F.lit(1.0), whole
    for (t, w), (u, v), area in reversed(list(zip(knots, knots[1:], areas, strict=False))):
        done -= area
        left, slope = F.greatest(F.lit(0.0), want - done), (v - w) / (u - t)
        # w x + slope x^2 / 2 = left, in the form that also holds for a slope of 0
        root = F.sqrt(F.greatest(F.lit(0.0), w * w + 2 * slope * left))
        x = F.when(root + w > 0, 2 * left / (root + w)).otherwise(0.0)
        out = F.when(want <= done + area, F.least(F.lit(u), t + x)).otherwise(out)
    return out


def _sized(docs: DataFrame, id_col: str, text_col: str, source_col: str, *more: Column) -> DataFrame:
    return docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"), F.xxhash64(F.col(id_col), F.col(text_col)).alias("h"), *more)


def _walked(rows: DataFrame, base: DataFrame, weights: Sequence[float], share: float, most: float, schedules: Sequence[Schedule], named: Mapping[str, Schedule] | None) -> DataFrame:
    """rows, as ``_sized`` makes them, with source_size, target, taken and positions; base: the same, written, to be summed up."""
    number = max(1, -(-base.count() // SLICE))
    slice_of = F.pmod("h", F.lit(number)).alias("slice")
    slices = base.groupBy("source", slice_of).agg(F.sum("size").alias("slice_size"))
    sums = slices.withColumn("before", F.sum("slice_size").over(Window.partitionBy("source").orderBy("slice").rowsBetween(Window.unboundedPreceding, 0)) - F.col("slice_size"))
    goal = targets(base.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, most)
    level = goal.withColumnRenamed("source", "goal_source")
    place = materialise(sums.join(level, F.expr("source <=> goal_source")).select(F.col("source").alias("of"), F.col("slice").alias("at"), "before", "source_size", "rank", "target"), "places")
    known = F.broadcast(place) if place.count() <= BROADCAST_PLACES else place
    joined = rows.withColumn("slice", slice_of).join(known, F.expr("source <=> of AND slice = at"))
    within = Window.partitionBy("source", "slice").orderBy("h", "doc_id").rowsBetween(Window.unboundedPreceding, 0)
    start, walk, whole = (F.col(x) for x in ("start", "walk", "source_size"))
    placed = joined.withColumn("start", F.col("before") + F.sum("size").over(within) - F.col("size")).withColumn("walk", F.round("target").cast("long"))
    rounds, rest = F.floor(walk / whole), walk % whole
    taken = F.when(whole > 0, rounds * F.col("size") + F.least(F.col("size"), F.greatest(F.lit(0), rest - start))).otherwise(0).cast("long")

    def time(passed: Column) -> Column:
        by_rank = [invert(s, passed) for s in schedules]
        out = by_rank[-1]
        for k, x in enumerate(by_rank[:-1]):
            out = F.when(F.col("rank") % len(by_rank) == k, x).otherwise(out)
        for name, schedule in (named or {}).items():
            out = F.when(F.col("source") == name, invert(schedule, passed)).otherwise(out)
        return out

    passes = F.sequence(F.lit(0), F.lit(max(1, math.ceil(most)) - 1))
    each = F.transform(passes, lambda p: F.when(start + p * whole < walk, time((start + p * whole) / walk)))
    positions = F.when(F.col("taken") > 0, F.filter(each, lambda x: x.isNotNull())).otherwise(F.array().cast("array<double>"))
    return placed.withColumn("taken", taken).withColumn("positions", positions)


def mix(docs: DataFrame, weights: Sequence[float] = (3, 1, 2), share: float = 1.5, most: float = 2.0, schedules: Sequence[Schedule] = (RISING, FALLING), named: Mapping[str, Schedule] | None = None, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """doc_id, size, source_size, target, taken, positions, position, source and key (the hash) of every document.

    Each source's documents lie on a line in the order of a hash of id and text; the line is walked ``target`` words far,
    round and round.  ``taken`` is what the walk passes of a document, repeats counted: ``target`` rounded down or up for
    each source, at most ``most`` times the size for each document.  ``positions`` (0 to 1) has a time for each pass over the
    document: that by which the source's weight schedule has demanded all the words that the walk passes before.  So the copies
    of a document lie a whole pass apart.  ``position`` is the first, null where nothing is taken.  ``schedules`` are dealt to
    sources by rank, ``named`` overrides them.  Null texts have size 0; null sources form one source.  Repeated rows with
    equal id and text lie side by side; which of them comes first is left open, what they take together is not.
    """
    base = materialise(_sized(docs, id_col, text_col, source_col), "sizes")
    rows = _walked(base, base, weights, share, most, schedules, named)
    return rows.select("doc_id", "size", "source_size", "target", "taken", "positions", F.get("positions", F.lit(0)).alias("position"), "source", F.col("h").alias("key"))


def by_position(mixed: DataFrame) -> DataFrame:
    """Range-sorts documents by training position; those that aren't taken come last."""
    parts = int(mixed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return mixed.repartitionByRange(parts, F.col("position").asc_nulls_last(), "doc_id").sortWithinPartitions(F.col("position").asc_nulls_last(), "doc_id")


def resample(docs: DataFrame, weights: Sequence[float] = (3, 1, 2), share: float = 1.5, most: float = 2.0, schedules: Sequence[Schedule] = (RISING, FALLING), named: Mapping[str, Schedule] | None = None, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The rows of docs, each as often as the mix takes it, range-sorted by the training position of each copy; all columns stay.

    ``taken`` over size, rounded, is how often, at the first so many positions; texts without words stay once, at the end.
    Rows are moved twice: to their slices, where running sums are made, and to their positions.
    """
    base = materialise(_sized(docs, id_col, text_col, source_col), "sizes")
    rows = _sized(docs, id_col, text_col, source_col, F.struct(*(F.col(c) for c in docs.columns)).alias("row"))
    walked = _walked(rows, base, weights, share, most, schedules, named)
    times = F.floor((F.col("taken") + F.col("size") / 2) / F.col("size")).cast("int")
    copies = F.when(F.col("size") > 0, F.slice("positions", F.lit(1), times)).otherwise(F.array(F.lit(None).cast("double")))
    out = walked.select("row", "doc_id", F.explode(copies).alias("position"))
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    by = F.col("position").asc_nulls_last(), F.col("doc_id")
    return out.repartitionByRange(parts, *by).sortWithinPartitions(*by).select("row.*")
