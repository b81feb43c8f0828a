"""Mixing sources to target weights by entropy balancing."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import stable
from .tables import small_side

WEIGHTS = (3, 1, 2)
SHARE = 1.5
CAP = 2
STEPS = 60
CLOSE = 1e-6
FINE = 18
SWEEPS = 3
EQUAL_PARTS = 1000
EQUAL_ROWS = 16


def _count_words(text: Column) -> Column:
    """Runs of anything but ASCII white space."""
    return F.coalesce(F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)).cast("long")


def source_targets(
    totals: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = SHARE, cap: int = CAP
) -> DataFrame:
    """(source, source_size, target) from (source, source_size), one row per source.

    Sources by code point, null last, take the weights in turn and divide ``share`` of all sizes. A target stops at
    ``cap`` times its source's size. What is left over is shared again by weight, which comes to one level ``t``
    with target ``min(weight * t, cap * size)``: with sources in order of ``cap * size / weight`` the first ``t``
    that leaves the next source below its stop is the one.
    """
    turn = F.expr(f"element_at(array({', '.join(map(str, weights))}), cast(pos % {len(weights)} as int) + 1)")
    by_name = Window.orderBy(F.col("source").isNull(), F.col("source"))
    s = totals.withColumn("pos", F.row_number().over(by_name) - 1).withColumn("w", turn)
    s = s.withColumn("stop", F.col("source_size") * cap).withColumn("ratio", F.col("stop") / F.col("w"))
    everything = Window.partitionBy()
    by_ratio = Window.orderBy("ratio", "pos")
    below = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    s = s.withColumn("rest", F.sum("source_size").over(everything) * share - F.coalesce(F.sum("stop").over(below), F.lit(0)))
    s = s.withColumn("t", F.col("rest") / F.sum("w").over(by_ratio.rowsBetween(0, Window.unboundedFollowing)))
    s = s.withColumn("level", F.min(F.when(F.col("t") <= F.col("ratio"), F.struct("ratio", "pos", "t"))).over(everything))
    target = F.least(F.col("stop").cast("double"), F.col("w") * F.coalesce(F.col("level.t"), F.lit(float("inf"))))
    return s.select("source", "source_size", target.alias("target"))


def _rate(cap: int) -> Column:
    """Rate of a document: base rate 1 tilted exponentially in its size, with odds against the cap."""
    return cap / (1 + (cap - 1) * F.exp(-F.col("lam") * F.col("x")))


def balance(groups: DataFrame, targets: DataFrame, cap: int = CAP, steps: int = STEPS) -> DataFrame:
    """(source, mean, lam): the multiplier of each source's token constraint.

    ``groups`` has (source, size, n). Among rates ``r`` in (0, cap) the one nearest to 1 in relative entropy with
    ``sum(r * size) = target`` is ``cap / (1 + (cap - 1) * exp(-lam * x))``, x the size over the source's mean
    size; ``lam`` minimises the convex dual ``sum(cap * log(1 + exp(lam * x) / (cap - 1))) - lam * target / mean``.
    All sources take a Newton step per pass over the groups, kept inside a bracket of the root; each pass is one
    aggregation by source, written out, and the driver sees the largest remaining error only. Targets at the cap
    have no finite multiplier and get infinity, targets of 0 minus infinity.
    """
    same = F.col("g.source").eqNullSafe(F.col("s.source"))
    counts = groups.groupBy("source").agg(F.sum("n").alias("docs"))
    inf = F.lit(float("inf"))
    share = F.col("target") / F.col("source_size")
    even = F.log((cap - 1) * share / (cap - share))  # right if all sizes were equal
    state = (
        targets.alias("g").join(counts.alias("s"), same).select("g.*", "docs")
        .withColumn("mean", F.greatest(F.col("source_size") / F.col("docs"), F.lit(1.0)))
        .withColumn("lam", F.when(F.col("target") >= cap * F.col("source_size"), inf)
                    .when(F.col("target") <= 0, -inf).otherwise(even))
        .withColumn("low", -inf).withColumn("high", inf)
        .select("source", "source_size", "target", "mean", "lam", "low", "high")
    )
    state = stable(state)
    small = small_side(state)
    for _ in range(steps):
        here = groups.alias("g").join(small(state).alias("s"), same).where(F.abs("lam") < inf)
        here = here.select("s.*", "size", "n").withColumn("x", F.col("size") / F.col("mean"))
        here = here.withColumn("r", _rate(cap))
        sums = here.groupBy("source").agg(
            F.sum(F.col("n") * F.col("x") * F.col("r")).alias("grad"),
            F.sum(F.col("n") * F.col("x") * F.col("x") * F.col("r") * (cap - F.col("r")) / cap).alias("curve"),
        )
        nxt = state.alias("g").join(sums.alias("s"), same, "left").select("g.*", "grad", "curve")
        over = F.col("grad") - F.col("target") / F.col("mean")
        nxt = nxt.withColumn("over", over)
        nxt = nxt.withColumn("low", F.when(F.col("over") < 0, F.col("lam")).otherwise(F.col("low")))
        nxt = nxt.withColumn("high", F.when(F.col("over") > 0, F.col("lam")).otherwise(F.col("high")))
        newton = F.col("lam") - F.col("over") / F.col("curve")
        outside = F.isnan(newton) | newton.isNull() | (newton <= F.col("low")) | (newton >= F.col("high"))
        middle = (
            F.when(F.col("high") == inf, F.greatest(F.col("low") * 2, F.col("low") + 1))
            .when(F.col("low") == -inf, F.least(F.col("high") * 2, F.col("high") - 1))
            .otherwise((F.col("low") + F.col("high")) / 2)
        )
        settled = F.col("grad").isNull() | (F.abs("over") * F.col("mean") <= CLOSE * F.col("target"))
        moved = F.when(settled, F.col("lam")).when(outside, middle).otherwise(newton)
        error = F.when(settled, F.lit(0.0)).otherwise(F.abs("over") * F.col("mean") / F.col("target"))
        nxt = nxt.withColumn("lam2", moved).withColumn("error", error)
        kept = ["source", "source_size", "target", "mean", F.col("lam2").alias("lam"), "low", "high", "error"]
        state = stable(nxt.select(*kept))
        worst = state.agg(F.max("error")).first()[0]
        state = state.drop("error")
        if not worst:
            break
    # sums of doubles depend on their order in the last bits; the multiplier should not
    return stable(state.select("source", "source_size", "target", "mean", F.round("lam", 6).alias("lam")))


def mix_sources(
    docs: DataFrame,
    weights: Sequence[int] = WEIGHTS,
    share: float = SHARE,
    cap: int = CAP,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
) -> DataFrame:
    """``docs`` with ``size``, ``source_size``, ``target``, ``copies`` and ``taken`` (``copies * size``).

    The rates of :func:`balance` are rounded to whole copies. Each document's fraction competes with a number that
    its id and text decide: a source takes one copy more of its documents in that order while they fit into the target, and
    goes through the order again with the documents that still fit, the last of ``SWEEPS`` times also with those that
    have got theirs but are below the cap. Where to stop is found on
    sums over bins of the key, level by level, so a source of any length is never sorted or gathered. Texts are never shuffled or stored: sizes and ids decide, and the last pass
    applies the numbers of each source to the rows as they are read. Reruns give the same copies.

    A null text has size 0 (copies of it take nothing), a null source is a source, an empty table gives no rows. Rows
    equal in id and text share their rounding; where there are more than ``EQUAL_ROWS`` of them, and they hold so many of
    the source's words that a target could fall among them, they are told apart by their places in the input, so which of
    these equal rows is taken may change with the input's order. Missing and repeated ids are no matter otherwise. Columns of ``docs`` that are called like a new one are replaced.
    """
    made = ("size", "source_size", "target", "copies", "taken")
    kept = [c for c in docs.columns if c not in made]
    size, same_row = _count_words(F.col(text_col)), F.xxhash64(F.col(id_col), F.col(text_col), F.lit(23))
    place = F.monotonically_increasing_id()
    rows = stable(docs.select(F.col(source_col).alias("source"), size.alias("size"), same_row.alias("draw"), place.alias("place")))
    groups = stable(rows.groupBy("source", "size").agg(F.count(F.lit(1)).alias("n")))
    totals = groups.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"))
    state = balance(groups, source_targets(totals, weights, share, cap), cap)
    same = F.col("d.source").eqNullSafe(F.col("s.source"))

    small = small_side(state)
    many = stable(_many_equal_rows(rows, totals))
    rated = _told_apart(rows, many).alias("d").join(small(state).alias("s"), same).select("d.*", "target", *_rounding(cap))
    floors = rated.groupBy("source").agg((F.max("target") - F.sum(F.col("base") * F.col("size"))).alias("room"))
    cuts = floors.select("source", "room", F.array().cast("array<struct<key:bigint,size:double>>").alias("cuts"))
    cuts = stable(cuts)
    open_rows = rated.where(F.col("base") < cap).select("source", "size", "key", "base")
    for sweep in range(SWEEPS):
        # who comes next among those that still fit: two levels of bins of the key, then a new cut
        had = F.col("base") if sweep == SWEEPS - 1 else F.lit(cap - 1)
        lines = cuts.withColumns({"line": F.lit(0).cast("long"), "limit": F.col("room")})
        for level in (1, 0):
            width = 1 << (FINE * level)
            near = open_rows.alias("d").join(small(lines).alias("s"), same)
            near = near.where((F.col("key") >= F.col("line")) & (F.col("key") < F.col("line") + (width << FINE)))
            near = near.where((had + _taken(1, SWEEPS - 1) < cap) & (F.col("size") <= F.col("limit")))
            bins = near.groupBy(F.col("d.source").alias("source"), "room", F.expr(f"(key - line) div {width}").alias("bin"))
            bins = bins.agg(F.sum("size").alias("words"))
            bins = bins.withColumn("run", F.sum("words").over(Window.partitionBy("source").orderBy("bin")))
            fits = F.col("run") <= F.col("room")
            cut = bins.groupBy("source").agg(
                F.max(F.when(fits, F.col("run"))).alias("used"), F.min(F.when(~fits, F.col("bin"))).alias("next")
            )
            left = F.col("room") - F.coalesce("used", F.lit(0))
            line = F.col("line") + F.coalesce("next", F.lit(1 << FINE)) * width
            lines = lines.alias("d").join(cut.alias("s"), same, "left")
            lines = lines.select("d.source", "cuts", left.alias("room"), line.alias("line"), "limit")
            lines = stable(lines)
        made_cut = F.array(F.struct(F.col("line").alias("key"), F.col("limit").alias("size")))
        cuts = lines.select("source", "room", F.concat("cuts", made_cut).alias("cuts"))
    known = stable(state.alias("d").join(cuts.alias("s"), same).select("d.*", "cuts"))
    own = docs.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("row"), F.col(source_col).alias("source"),
                      size.alias("size"), same_row.alias("draw"), place.alias("place"))
    out = _told_apart(own, many).alias("d").join(small(known).alias("s"), same).select("row", "size", "source_size", "target", "cuts",
                                                                    *_rounding(cap))
    once = F.col("base") + F.when(F.col("base") < cap, _taken(1, SWEEPS - 1)).otherwise(0)
    out = out.withColumn("copies", once)
    out = out.withColumn("copies", F.col("copies") + F.when(F.col("copies") < cap, _taken(SWEEPS, 1)).otherwise(0))
    return out.select("row.*", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def _many_equal_rows(rows: DataFrame, totals: DataFrame) -> DataFrame:
    """``draw`` of many rows equal in id and text that hold more than one part in ``EQUAL_PARTS`` of their source's words.

    A source has fewer than ``EQUAL_PARTS`` of such draws.
    """
    same = F.col("g.source").eqNullSafe(F.col("s.source"))
    equal = rows.groupBy("source", "draw").agg(F.sum("size").alias("words"), F.count(F.lit(1)).alias("n")).where((F.col("n") > EQUAL_ROWS) & (F.col("words") > 0))
    found = equal.alias("g").join(small_side(totals)(totals).alias("s"), same)
    return found.where(F.col("words") * EQUAL_PARTS > F.col("source_size")).select("draw").distinct()


def _told_apart(rows: DataFrame, many: DataFrame) -> DataFrame:
    """``rows`` with a draw of their own, from their ``place``, for those among ``many``."""
    own = rows.join(small_side(many)(many.withColumn("_many", F.lit(True))), "draw", "left")
    draw = F.when(F.col("_many"), F.xxhash64("draw", "place")).otherwise(F.col("draw"))
    return own.withColumn("draw", draw).drop("_many", "place")


def _taken(first: int, n: int) -> Column:
    """1 if a document lies before one of ``n`` cuts from the ``first`` on among the documents small enough, else 0."""
    cuts = F.slice("cuts", first, n)
    return F.exists(cuts, lambda c: (F.col("key") < c["key"]) & (F.col("size") <= c["size"])).cast("long")


def _rounding(cap: int) -> list[Column]:
    """``base``, the whole copies of a document, and ``key``, its place in the queue for one more, below 2**36."""
    rate = (
        F.when(F.col("lam") == float("inf"), F.lit(float(cap)))
        .when(F.col("lam") == float("-inf"), F.lit(0.0))
        .otherwise(cap / (1 + (cap - 1) * F.exp(-F.col("lam") * F.col("size") / F.col("mean"))))
    )
    base = F.least(F.floor(rate), F.lit(cap)).cast("long")
    unit = F.shiftrightunsigned(F.col("draw"), 11) / F.lit(float(1 << 53))
    spread = F.least((unit + 1 - (rate - F.floor(rate))) / 2, F.lit(1 - 2.0**-40))
    return [base.alias("base"), F.floor(spread * float(1 << (2 * FINE))).cast("long").alias("key")]
