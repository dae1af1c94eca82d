"""Mixing sources to target weights by capped water-filling and seeded whole and fractional repetitions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

#: Cells of the seeded order at either of its two levels (three hexadecimal digits each).
CELLS = 4096
#: Sources up to which the plan (one short row each) is broadcast; beyond it the join shuffles.
BROADCAST_SOURCES = 50_000

WORDS = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    return F.when(F.length(text) > 0, F.regexp_count(text, F.lit(WORDS))).otherwise(0).cast("long")


def _digits(doc_id: Column, seed: int, at: int) -> Column:
    key = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("null"))))
    return F.conv(F.substring(key, at, 3), 16, 10).cast("int")


def _narrow(docs: DataFrame, seed: int) -> DataFrame:
    """source, size and the row's two places in the seeded order; no other column is read."""
    return docs.select(F.col("source").alias("mx_source"), word_count(F.col("text")).alias("mx_size"), _digits(F.col("doc_id"), seed, 1).alias("mx_cell"), _digits(F.col("doc_id"), seed, 4).alias("mx_part"))


def fill(sizes: DataFrame, weights: Sequence[float], share: float, max_epochs: float) -> DataFrame:
    """Targets of sources (``mx_source``, ``source_size``) that share ``share`` of all sizes by weight.

    Sources in code point order, null last, take ``weights`` in turn. In the order of cap over weight, sources are
    clamped one after another until the common level of the rest lies below the next cap: the fixed point of
    clamping and resharing the excess. One short row for each source passes through one task and may spill.
    """
    order = Window.orderBy(F.col("mx_source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.row_number().over(order) - 1) % len(weights) + 1)
    ranked = sizes.withColumn("mx_weight", weight).withColumn("mx_cap", F.col("source_size") * F.lit(float(max_epochs)))
    fill_order = Window.orderBy((F.col("mx_cap") / F.col("mx_weight")).asc(), F.col("mx_source").asc_nulls_last())
    before, everything = fill_order.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    level = (F.sum("source_size").over(everything) * F.lit(float(share)) - F.coalesce(F.sum("mx_cap").over(before), F.lit(0.0))) / (F.sum("mx_weight").over(everything) - F.coalesce(F.sum("mx_weight").over(before), F.lit(0.0)))
    levels = ranked.withColumn("mx_level", level)
    # the first source in this order that the level of the rest does not clamp sets the level for all after it
    free = F.min(F.when(F.col("mx_level") * F.col("mx_weight") <= F.col("mx_cap"), F.struct(F.col("mx_cap") / F.col("mx_weight"), F.col("mx_level")))).over(everything)
    target = F.least(F.col("mx_cap"), F.coalesce(free["mx_level"] * F.col("mx_weight"), F.col("mx_cap")))
    return levels.select("mx_source", "source_size", target.alias("target"))


def _cut(cells: DataFrame, place: str) -> DataFrame:
    """Of each source the first cell where the sizes so far exceed what is left, and what is left before it."""
    so_far = Window.partitionBy("mx_source").orderBy(place).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    run = cells.withColumn("mx_run", F.sum("mx_size").over(so_far))
    first = F.min(F.when(F.col("mx_run") > F.col("mx_left"), F.struct(place, F.col("mx_run"), F.col("mx_size")))).alias("mx_at")
    return run.groupBy("mx_source").agg(first, F.first("mx_left").alias("mx_left")).select("mx_source", F.col(f"mx_at.{place}").alias(place), F.greatest(F.lit(0.0), F.col("mx_left") - (F.col("mx_at.mx_run") - F.col("mx_at.mx_size"))).alias("mx_left"), F.col("mx_at.mx_size").alias("mx_size"))


def plan(docs: DataFrame, weights: Sequence[float] = (3, 1, 2), share: float = 1.5, max_epochs: float = 2.0, seed: int = 0) -> DataFrame:
    """One row for each source: its target, whole repetitions, and where its seeded order is cut.

    Rows stand in the order of a seeded hash of doc_id, as 4096 x 4096 cells. The cell in which the rest of the target
    ends is found from sizes summed by cell, then again inside that cell; a source's rows never meet in one task.
    """
    rows = common.materialize(_narrow(docs, seed), "mix-sizes")
    sizes = rows.groupBy("mx_source").agg(F.sum("mx_size").alias("source_size"))
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("int")
    targets = fill(sizes, weights, share, max_epochs).withColumn("mx_whole", whole)
    targets = common.materialize(targets.withColumn("mx_left", F.col("target") - F.col("mx_whole") * F.col("source_size")), "mix-targets")
    cells = rows.groupBy("mx_source", "mx_cell").agg(F.sum("mx_size").alias("mx_size"))
    same = lambda a, b: a["mx_source"].eqNullSafe(b["mx_source"])
    first = _cut(cells.join(targets.select(F.col("mx_source").alias("mx_s"), "mx_left"), F.col("mx_source").eqNullSafe(F.col("mx_s"))).drop("mx_s"), "mx_cell")
    first = common.materialize(first.select(F.col("mx_source").alias("mx_s"), F.col("mx_cell").alias("mx_c"), "mx_left"), "mix-cells")
    inner = rows.join(F.broadcast(first) if first.count() <= BROADCAST_SOURCES else first, F.col("mx_source").eqNullSafe(F.col("mx_s")) & (F.col("mx_cell") == F.col("mx_c")))
    second = _cut(inner.groupBy("mx_source", "mx_part", "mx_left").agg(F.sum("mx_size").alias("mx_size")), "mx_part")
    second = second.select(F.col("mx_source").alias("mx_t"), F.col("mx_part").alias("mx_cut_part"), F.when(F.col("mx_size") > 0, F.col("mx_left") / F.col("mx_size")).otherwise(0.0).alias("mx_fraction"))
    out = targets.join(first.drop("mx_left"), F.col("mx_source").eqNullSafe(F.col("mx_s")), "left").join(second, F.col("mx_source").eqNullSafe(F.col("mx_t")), "left")
    return common.materialize(out.select("mx_source", "source_size", "target", "mx_whole", F.col("mx_c").alias("mx_cut_cell"), "mx_cut_part", "mx_fraction"), "mix-plan")


#: Names that ``mix`` adds.
OUTPUTS = ("mx_size", "mx_source_size", "mx_target", "mx_reps", "mx_taken")


def mix(docs: DataFrame, weights: Sequence[float] = (3, 1, 2), share: float = 1.5, max_epochs: float = 2.0, seed: int = 0) -> DataFrame:
    """Every row of ``docs`` with mx_size, mx_source_size, mx_target, mx_reps (whole plus fractional repetitions), mx_taken (words).

    Reads doc_id, text and source; a null text has size 0, a null source is a source of its own, an empty table gives
    an empty result, a text of any length is counted whole. Rows before the cut of their source's seeded order are taken
    once more, rows at the cut for a fraction; repeated rows stand at the same place and share it. All columns of ``docs``
    stay, but one named as an output gives way to it.
    """
    return _mixed(docs, weights, share, max_epochs, seed).select("mx_row.*", *OUTPUTS)


def _mixed(docs: DataFrame, weights: Sequence[float], share: float, max_epochs: float, seed: int, but: Sequence[str] = OUTPUTS) -> DataFrame:
    """mx_row (the row of ``docs``, without columns named in ``but``) and the columns of OUTPUTS."""
    p = plan(docs, weights, share, max_epochs, seed)
    small = p.count() <= BROADCAST_SOURCES
    rows = docs.select(common.row_of(docs, but).alias("mx_row"), F.col("source").alias("mx_of"), word_count(F.col("text")).alias("mx_size"), _digits(F.col("doc_id"), seed, 1).alias("mx_cell"), _digits(F.col("doc_id"), seed, 4).alias("mx_part"))
    p = p.withColumnsRenamed({"mx_source": "mx_s", "source_size": "mx_source_size", "target": "mx_target"})
    joined = rows.join(F.broadcast(p) if small else p, F.col("mx_of").eqNullSafe(F.col("mx_s")), "left")
    cell, part = F.col("mx_cell"), F.col("mx_part")
    fraction = (
        F.when(F.col("mx_cut_cell").isNull() | (cell > F.col("mx_cut_cell")), 0.0)
        .when(cell < F.col("mx_cut_cell"), 1.0)
        .when(F.col("mx_cut_part").isNull() | (part > F.col("mx_cut_part")), 0.0)
        .when(part < F.col("mx_cut_part"), 1.0)
        .otherwise(F.col("mx_fraction"))
    )
    out = joined.withColumn("mx_part_taken", fraction)
    taken = F.least(F.col("mx_whole") * F.col("mx_size") + F.floor(F.col("mx_size") * F.col("mx_part_taken") + 0.5), F.floor(F.col("mx_size") * F.lit(float(max_epochs)))).cast("long")
    return out.select("mx_row", "mx_size", "mx_source_size", "mx_target", (F.col("mx_whole") + F.col("mx_part_taken")).alias("mx_reps"), taken.alias("mx_taken"))


def repeat_rows(docs: DataFrame, weights: Sequence[float] = (3, 1, 2), share: float = 1.5, max_epochs: float = 2.0, seed: int = 0) -> DataFrame:
    """The mix as rows: each row as often as its repetitions, a fraction rounded half up; columns of ``docs``, whatever their names.

    Nulls, repeated rows, long texts and empty tables as for ``mix``.
    """
    rows = _mixed(docs, weights, share, max_epochs, seed, ())
    times = F.floor(F.col("mx_reps") + 0.5).cast("int")
    return rows.where(times > 0).select("mx_row", F.explode(F.array_repeat(F.lit(1), times))).select("mx_row.*")
