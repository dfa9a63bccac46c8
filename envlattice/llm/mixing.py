"""Mixing of sources to target weights that vary over training: a curriculum."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import n_words

#: Weights at equally spaced points of training, for the sources in order of code point, again and again. Their means
#: are the sources' weights: the first kind comes early, the second evenly, the third late.
SCHEDULES = [[4.5, 1.5], [1.0, 1.0], [1.0, 3.0]]
#: Rows of a source and bucket that are numbered together, on average.
BUCKET_ROWS = 2_000


def mean_weight(schedule: list[float]) -> float:
    """The integral over training, from 0 to 1, of the line through the schedule's points."""
    if len(schedule) < 2 or min(schedule) < 0 or max(schedule) <= 0:
        raise ValueError("a schedule has two points or more, none below zero and one above")
    return sum(a + b for a, b in zip(schedule, schedule[1:], strict=False)) / 2 / (len(schedule) - 1)


def _cycle(values: list, rank: Column) -> Column:
    at = F.pmod(rank - 1, F.lit(len(values)))
    return F.element_at(F.array(*(v if isinstance(v, Column) else F.lit(v) for v in values)), (at + 1).cast("int"))


def targets(totals: DataFrame, share: float, most: float, schedules: list[list[float]] = SCHEDULES) -> DataFrame:
    """Adds to (source, key, source_size) rows, one a source: rank, weight, target and schedule.

    The targets are in proportion to the weights and sum to ``share`` of all sizes, but none is above ``most`` times its
    source's size: what is above is reshared by weight. Sources in order of the size that a unit of weight can get
    reach their limit one after the other, so the level at which the rest stand follows from running sums. They need all
    sources in one order, so one task has a row of each source, of six numbers; the rows of documents are not there.
    """
    of_all = Window.orderBy(F.col("source").isNull(), "source")
    ranked = totals.withColumn("rank", F.row_number().over(of_all))
    ranked = ranked.withColumn("weight", _cycle([mean_weight(s) for s in schedules], F.col("rank")))
    ranked = ranked.withColumn("limit", F.col("source_size") * F.lit(float(most)))
    by_ratio = Window.orderBy(F.col("limit") / F.col("weight"), "rank")
    before = F.coalesce(F.sum("limit").over(by_ratio.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    rest = F.sum("weight").over(by_ratio.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    everything = F.sum("source_size").over(Window.partitionBy())
    ranked = ranked.withColumn("level", (F.lit(float(share)) * everything - before) / rest)
    open_ = F.col("limit") > F.col("level") * F.col("weight")
    level = F.min(F.when(open_, F.struct(F.col("limit") / F.col("weight"), "rank", "level"))).over(Window.partitionBy())
    target = F.least(F.col("limit"), F.coalesce(level["level"] * F.col("weight"), F.col("limit")))
    points = _cycle([F.array(*(F.lit(float(x)) for x in s)) for s in schedules], F.col("rank"))
    return ranked.select("source", "key", "source_size", "rank", "weight", target.alias("target"), points.alias("schedule"))


def when(fraction: Column, schedule: Column) -> Column:
    """The time, from 0 to 1, by which a source has met a fraction of its demand: its running integral, inverted."""
    step = F.lit(1.0) / (F.size(schedule) - 1)
    area = lambda i: (F.get(schedule, i) + F.get(schedule, i + 1)) / 2 * step
    pieces = F.transform(F.sequence(F.lit(0), F.size(schedule) - 2), lambda i: F.struct(i.alias("i"), area(i).alias("area")))
    whole = F.aggregate(pieces, F.lit(0.0), lambda s, p: s + p["area"])
    wanted = fraction * whole
    # walks the pieces: (area before, the piece in which the wanted area ends)
    start = F.struct(F.lit(0.0).alias("before"), F.lit(-1).alias("i"), F.lit(0.0).alias("left"))
    last = F.size(schedule) - 2

    def walk(s: Column, p: Column) -> Column:
        ends = (s["i"] < 0) & ((s["before"] + p["area"] >= wanted) | (p["i"] == last))
        return F.struct(
            (s["before"] + p["area"]).alias("before"),
            F.when(ends, p["i"]).otherwise(s["i"]).alias("i"),
            F.when(ends, F.greatest(wanted - s["before"], F.lit(0.0))).otherwise(s["left"]).alias("left"),
        )

    def solve(s: Column) -> Column:
        a, b, c = F.get(schedule, s["i"]), F.get(schedule, s["i"] + 1), s["left"]
        root = F.sqrt(F.greatest(a * a + 2 * c * (b - a) / step, F.lit(0.0)))
        return s["i"] * step + F.when(c > 0, F.least(2 * c / (a + root), step)).otherwise(0.0)

    return F.aggregate(pieces, start, walk, solve)


def plan(
    docs: DataFrame,
    id_col: str = "doc_id",
    source_col: str = "source",
    size: Column | None = None,
    keep: list[str] | None = None,
    share: float = 1.5,
    most: float = 2.0,
    schedules: list[list[float]] = SCHEDULES,
) -> DataFrame:
    """(row, id, size, source_size, target, taken, offset, schedule) of every row; ``row`` is a struct of ``keep``.

    Within a source, rows stand in order of the MD5 of their id and size, ``offset`` words after its first; the mix runs
    through them again and again until the target is met, so ``taken`` sums to the whole part of the target and no row is
    taken more than ``most`` times. Rows that share an id, or have none, are dealt by their sizes; those of one id and size are
    interchangeable. Null sources are a source of their own, the last; null texts and texts without words have size 0 and are
    never taken. Columns of any name are only carried along, and an empty table gives none.

    The running sums of a source are taken by bucket of the MD5 and then over buckets, so that one task never numbers a
    source, however large. Rows are shuffled once, by source and bucket.
    """
    size = n_words(F.col("text")) if size is None else size
    keep = docs.columns if keep is None else keep
    order = F.md5(F.concat_ws("/", F.col(id_col).cast("string"), F.lit(""), size.cast("string")))
    rows = docs.select(
        (F.struct(*keep) if keep else F.lit(None).cast("string")).alias("row"),
        F.col(id_col).alias("id"),
        F.col(source_col).alias("source"),
        F.coalesce(F.concat(F.lit("="), F.col(source_col).cast("string")), F.lit("null")).alias("key"),
        size.alias("size"),
        order.alias("order"),
    )
    narrow = rows.drop("row")
    largest = narrow.groupBy("key").count().agg(F.max("count")).first()[0] or 0
    digits = next(d for d in range(1, 16) if largest <= BUCKET_ROWS * 16 ** (d - 1) or d == 15)
    bucket = F.substring("order", 1, digits)
    buckets = narrow.groupBy("source", "key", bucket.alias("bucket")).agg(F.sum("size").alias("bucket_size"))
    totals = buckets.groupBy("source", "key").agg(F.sum("bucket_size").alias("source_size"))
    sources = targets(totals, share, most, schedules).drop("source")
    so_far = Window.partitionBy("key").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = buckets.select("key", "bucket", F.coalesce(F.sum("bucket_size").over(so_far), F.lit(0)).alias("start"))
    starts = starts.join(sources, "key")
    inside = Window.partitionBy("key", "bucket").orderBy("order", "id", "size").rowsBetween(Window.unboundedPreceding, -1)
    numbered = rows.withColumn("bucket", bucket).withColumn("inside", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    found = numbered.join(starts, ["key", "bucket"]).withColumn("offset", F.col("start") + F.col("inside"))
    words = F.floor("target")
    taken = F.lit(0).cast("long")
    for turn in range(-int(-most // 1)):
        left = words - F.lit(turn) * F.col("source_size") - F.col("offset")
        taken = taken + F.greatest(F.lit(0).cast("long"), F.least(F.col("size"), left))
    return found.select("row", "id", "size", "source_size", "target", taken.alias("taken"), "offset", "schedule")


def position(turn: Column | int = 0) -> Column:
    """When a row of ``plan`` is due for the turn-th time, as a part of training: demand met up to it, inverted."""
    turn = F.lit(turn) if isinstance(turn, int) else turn
    met = (turn * F.col("source_size") + F.col("offset")).cast("double") / F.col("target")
    return when(F.when(F.col("target") > 0, F.least(met, F.lit(1.0))).otherwise(0.0), F.col("schedule"))


def mix(planned: DataFrame) -> DataFrame:
    """The rows that a plan takes, a row for each time, whole, in order of their training position (a range sort).

    (row, turn, position): the row at a target's end is given whole, though only some of its words are due.
    """
    per_turn = F.col("source_size") * F.col("turn") + F.col("offset") < F.floor("target")
    turns = F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil(F.col("target") / F.col("source_size")).cast("int") - 1))
    due = planned.where("taken > 0").withColumn("turn", F.explode(turns)).where(per_turn)
    return due.select("row", "turn", position(F.col("turn")).alias("position"), "id").orderBy("position", "id", "turn").drop("id")

