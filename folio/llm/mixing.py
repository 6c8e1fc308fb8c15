"""Mixing sources to target weights by entropy balancing, in DataFrame functions only.

Every source gets a target in words. Within a source the rates of the documents are exponentially
tilted, ``rate = min(cap, exp(lambda * size))``: of all rates up to the cap that meet the source's word constraint,
those nearest to one in relative entropy. ``lambda`` solves ``sum(size * rate) = target``, the gradient
of a convex dual, by Newton steps kept inside a bracket.

Documents of equal source and size have equal rates, so the iterations run on the grouped counts of
(source, size), whose number is bounded by sources times distinct sizes: the first grouping is
pre-aggregated before its shuffle and a hot source is only a few thousand cells. Rates become whole
copies by systematic rounding along the sizes, and for a few rounds the cell that comes nearest to what
is still missing moves by as many copies as fit. Inside a cell the copies go to documents in the order of a hash of
id and text, so that the layout of the table doesn't matter, in slices of about ``SLICE`` documents, so no
window ever holds a hot cell. Documents of size 0 meet no window.

Defined cases: null text has size 0; documents of size 0 are taken 0 times; very long texts are cells of their own; a
null source is a source of its own, ranked last; repeated rows are documents of their own, ties among them broken by
row number; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, cut, text_of, with_row

WEIGHTS = (5.0, 2.0, 1.0)
#: Documents of one cell whose copies are dealt in one window.
SLICE = 1000
#: Jobs of so many Newton steps each at most, and the relative residual at which they stop.
STEPS, TOGETHER, CLOSE = 30, 3, 1e-9


def targets(totals: DataFrame, share: float, cap: float, weights: tuple[float, ...] = WEIGHTS) -> DataFrame:
    """Adds ``target`` to ``totals(source, source_size)``, one row for each source.

    The water level: with sources in the order of cap over weight, the first k stop at their caps and
    the rest share what remains by weight; at the right k nobody in the rest is above.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    cycle = F.array(*map(F.lit, weights))
    t = totals.withColumn("w", F.element_at(cycle, (F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1).cast("int")))
    t = t.withColumn("top", F.lit(cap) * F.col("source_size"))
    order = Window.orderBy((F.col("top") / F.col("w")).asc(), F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    onward = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    every = Window.partitionBy()
    left = F.lit(share) * F.sum("source_size").over(every) - F.coalesce(F.sum("top").over(before), F.lit(0.0))
    t = t.withColumn("level", left / F.sum("w").over(onward))
    # the level rises while sources above their caps leave and falls once others do: the answer is its peak
    t = t.withColumn("level", F.max("level").over(every))
    return t.select("source", "source_size", F.least(F.col("top"), F.col("level") * F.col("w")).alias("target"))


def _rate(lam: Column, size: Column, cap: float) -> Column:
    return F.least(F.lit(cap), F.exp(lam * size))


def solve(cells: DataFrame, goals: DataFrame, cap: float) -> DataFrame:
    """``(source, lam, target)``: the dual solution of each source.

    ``cells(source, size, n)``; ``goals(source, target)``. Each step is one pre-aggregated grouping of the
    cells, ``TOGETHER`` of them to a job; only whether sources are left that aren't settled comes back.
    """
    state = cut(goals.select("source", "target", F.lit(0.0).alias("lam"), F.lit(-800.0).alias("lo"), F.lit(math.log(cap) + 0.01).alias("hi"), F.lit(False).alias("done")))
    for _ in range(STEPS):
        for _ in range(TOGETHER):
            s = state.alias("s")
            rate = _rate(F.col("lam"), F.col("size"), cap)
            words = F.col("n") * F.col("size")
            slope = F.when(F.col("lam") * F.col("size") < math.log(cap), words * F.col("size") * rate).otherwise(0.0)
            sums = (
                cells.alias("c")
                .join(s, F.col("c.source").eqNullSafe(F.col("s.source")))
                .select(F.col("s.source").alias("source"), (words * rate).alias("got"), slope.alias("slope"))
                .groupBy("source")
                .agg(F.sum("got").alias("got"), F.sum("slope").alias("slope"))
            )
            b = state.alias("b").join(sums.alias("m"), F.col("b.source").eqNullSafe(F.col("m.source")), "left")
            miss = F.coalesce(F.col("got"), F.lit(0.0)) - F.col("target")
            lo, hi = F.when(miss < 0, F.col("lam")).otherwise(F.col("lo")), F.when(miss > 0, F.col("lam")).otherwise(F.col("hi"))
            step = F.col("lam") - F.try_divide(miss, F.col("slope"))
            nxt = F.when((step > lo) & (step < hi), step).otherwise((lo + hi) / 2)
            # a step that moves nothing is at the end of what doubles can tell
            settled = (F.abs(miss) <= F.col("target") * CLOSE) | (hi - lo < 1e-15) | (nxt == F.col("lam")) | F.col("got").isNull()
            state = b.select(
                F.col("b.source").alias("source"), "target",
                F.when(F.col("done") | settled, F.col("lam")).otherwise(nxt).alias("lam"),
                lo.alias("lo"), hi.alias("hi"), (F.col("done") | settled).alias("done"),
            )
        state = cut(state)
        if state.where("not done").limit(1).count() == 0:
            return state.select("source", "lam", "target")
    raise RuntimeError("the rates of a source did not settle")


def round_cells(cells: DataFrame, solved: DataFrame, cap: float, corrections: int = 6) -> DataFrame:
    """``(source, size, n, copies)``: whole copies of each cell, between 0 and cap * n."""
    c = cells.alias("c").join(solved.alias("s"), F.col("c.source").eqNullSafe(F.col("s.source")))
    c = c.select("c.source", "size", "n", "target", (F.col("n") * _rate(F.col("lam"), F.col("size"), cap)).alias("want"))
    upto = F.sum("want").over(Window.partitionBy("source").orderBy("size").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    c = c.withColumn("upto", upto)
    copies = F.floor(F.col("upto") + 0.5) - F.floor(F.col("upto") - F.col("want") + 0.5)
    limit = F.col("n") * int(cap)
    c = cut(c.select("source", "size", "n", "target", F.least(copies, limit).cast("long").alias("copies")))
    for _ in range(corrections):
        left = c.groupBy("source").agg((F.first("target") - F.sum(F.col("copies") * F.col("size"))).alias("left"))
        j = c.alias("c").join(left.alias("l"), F.col("c.source").eqNullSafe(F.col("l.source"))).select("c.*", "left")
        room = F.when(F.col("left") > 0, limit - F.col("copies")).otherwise(F.col("copies"))
        gap = F.abs("left")
        move = F.least(room, F.greatest(F.floor(gap / F.col("size")), F.lit(1)))
        j = j.where("size > 0").withColumns({"move": move, "after": F.abs(gap - move * F.col("size"))}).where((F.col("move") > 0) & (F.col("after") < gap))
        best = j.groupBy("source").agg(F.min_by(F.struct("size", (F.col("move") * F.signum("left")).cast("long").alias("move")), F.struct("after", "size")).alias("best"))
        m = c.alias("j").join(best.alias("b"), F.col("j.source").eqNullSafe(F.col("b.source")), "left")
        step = F.when(F.col("size") == F.col("best.size"), F.col("best.move"))
        c = cut(m.select("j.source", "size", "n", "target", (F.col("copies") + F.coalesce(step, F.lit(0))).alias("copies")))
    return c.drop("target")


def mix(docs: DataFrame, share: float = 1.5, cap: float = 2.0, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", row_col: str | None = None) -> DataFrame:
    """``(_row, doc_id, size, source_size, target, copies, taken)`` for every row of ``docs``."""
    row = [docs[row_col].alias("_row")] if row_col else []
    d = docs.select(
        *row, docs[id_col].alias("doc_id"), docs[source_col].alias("source"),
        F.regexp_count(text_of(docs, text_col), F.lit(WORD)).cast("long").alias("size"),
        F.xxhash64(docs[id_col], docs[text_col]).alias("h"),
    )
    d = cut(d if row_col else with_row(d))
    cells = d.groupBy("source", "size").agg(F.count(F.lit(1)).alias("n"))
    totals = cut(cells.groupBy("source").agg(F.sum(F.col("n") * F.col("size")).alias("source_size")))
    goals = cut(targets(totals, share, cap))
    cells = cut(cells.where("size > 0"))
    rounded = round_cells(cells, solve(cells, goals, cap), cap)

    some = d.where("size > 0").alias("d").join(rounded.alias("r"), F.col("d.source").eqNullSafe(F.col("r.source")) & (F.col("d.size") == F.col("r.size")))
    some = some.select("_row", "doc_id", "d.source", "d.size", "n", "copies", "h")
    some = some.withColumn("part", F.pmod(F.xxhash64("h"), F.ceil(F.col("n") / SLICE)))
    part = Window.partitionBy("source", "size", "part")
    some = some.withColumns({"rank": F.row_number().over(part.orderBy("h", "_row")), "here": F.count(F.lit(1)).over(part)})
    base = F.floor(F.col("copies") / F.col("n"))
    more = F.col("here") * F.pmod("copies", "n") / F.col("n")
    # one slice: exactly the rest; several: the expected rest, rounded by the slice's own hash
    dither = F.when(F.col("n") <= SLICE, F.lit(1e-6)).otherwise(F.pmod(F.xxhash64("source", "size", "part"), F.lit(1 << 20)) / float(1 << 20))
    copies = (base + F.when(F.col("rank") <= F.floor(more + dither), 1).otherwise(0)).cast("long")
    out = some.select("_row", "doc_id", "source", "size", copies.alias("copies"))
    out = out.unionByName(d.where("size = 0").select("_row", "doc_id", "source", "size", F.lit(0).cast("long").alias("copies")))
    out = out.alias("d").join(goals.alias("g"), F.col("d.source").eqNullSafe(F.col("g.source")))
    return out.select("_row", "doc_id", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))
