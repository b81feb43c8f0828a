"""Generalized sequential patterns as level-wise DataFrame joins.

A match is the leftmost one: every element is found at the first event after the previous element's
event. That is a "next occurrence" lookup, done for all candidates and customers of a level at once as
a running minimum over (sequence, element) groups, linear in lookups and occurrences and safe for a
customer with very many baskets. The match of a pattern starts from the stored match of its prefix.

Where only supports are asked for, no match is stored: tasks count them over whole sequences
(:mod:`.counting`). Joins remain for sequences that are too long for one task and for very many patterns.
"""

from __future__ import annotations

import functools
import time
from collections.abc import Sequence
from dataclasses import dataclass
from datetime import timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ...functions import MAX_GROUP_ROWS, by_group_size, rnd, scan, stable, stored
from . import counting
from . import pattern as P
from .build import min_basket_customers, occurrences

_GLUE = "\u0001"


@dataclass(frozen=True)
class TimeLimits:
    """Limits on the leftmost match; None or zero switches one off."""

    max_span: timedelta | None = None
    min_gap: timedelta | None = None
    max_gap: timedelta | None = None

    def __bool__(self) -> bool:
        return bool(self.max_span or self.min_gap or self.max_gap)

    def given(self) -> dict[str, timedelta]:
        return {k: v for k in ("max_span", "min_gap", "max_gap") if (v := getattr(self, k))}

    def accept_gap(self, gap: Column) -> Column:
        ok = F.lit(True)
        if self.min_gap:
            ok = ok & (gap >= F.lit(self.min_gap))
        if self.max_gap:
            ok = ok & (gap <= F.lit(self.max_gap))
        return ok

    def accept_span(self, span: Column) -> Column:
        return span <= F.lit(self.max_span) if self.max_span else F.lit(True)


def _element_key(element: Column) -> Column:
    return F.array_join(element, _GLUE)


def _element_occurrences(elements: DataFrame, occ: DataFrame) -> DataFrame:
    """(seq_id, ekey, pos, ts) for each element of ``elements`` (ekey, element): all its items together."""
    single = occ.select("seq_id", F.col("item").alias("ekey"), "pos", "ts").join(
        elements.where(F.size("element") == 1).select("ekey"), "ekey", "left_semi"
    )
    several = elements.where(F.size("element") > 1)
    parts = several.select("ekey", F.size("element").alias("need"), F.explode("element").alias("item"))
    together = (
        occ.join(parts, "item")
        .groupBy("seq_id", "ekey", "need", "pos", "ts")
        .agg(F.count(F.lit(1)).alias("have"))
        .where("have = need")
    )
    cols = ["seq_id", "ekey", "pos", "ts"]
    return single.select(*cols).unionByName(together.select(*cols))


def _next_occurrence(asked: DataFrame, elem_occ: DataFrame, max_group_rows: int, hot: bool) -> DataFrame:
    """``asked`` (seq_id, ekey, after, pattern, ...) with the first later event (pos, ts), where one exists."""
    extra = [c for c in asked.columns if c not in ("seq_id", "ekey", "after")]
    ask = asked.select(
        "seq_id",
        "ekey",
        (-F.col("after")).alias("_down"),
        F.lit(0).alias("_kind"),
        P.text(F.col("pattern")).alias("_who"),
        F.lit(None).cast("long").alias("_pos"),
        F.lit(None).cast(dict(elem_occ.dtypes)["ts"]).alias("_ts"),
        F.struct(*extra).alias("_ask"),
    )
    have = elem_occ.select(
        "seq_id",
        "ekey",
        (-F.col("pos")).alias("_down"),
        F.lit(1).alias("_kind"),
        F.lit("").alias("_who"),
        F.col("pos").alias("_pos"),
        F.col("ts").alias("_ts"),
        F.lit(None).cast(ask.schema["_ask"].dataType).alias("_ask"),
    )
    # from late to early; at one position a lookup comes before the event, which it must not find
    order = ["_down", "_kind", "_who"]
    keys = ["seq_id", "ekey"]

    def step(d: DataFrame) -> DataFrame:
        return scan(d, keys, order, {"_npos": ("min", "_pos"), "_nts": ("min", "_ts")})

    both = ask.unionByName(have)
    found = by_group_size(both, keys, order, step, max_group_rows) if hot else step(both)
    found = found.where("_kind = 0 and _npos is not null")
    return found.select("seq_id", "_ask.*", F.col("_npos").alias("pos"), F.col("_nts").alias("ts"))


def _has_hot(occ: DataFrame, max_group_rows: int) -> bool:
    counts = occ.groupBy("seq_id", "item").agg(F.count(F.lit(1)).alias("n"))
    return not counts.where(F.col("n") > max_group_rows).isEmpty()


def _advance(
    targets: DataFrame, states: DataFrame | None, occ: DataFrame, limits: TimeLimits, max_group_rows: int, hot: bool
) -> DataFrame:
    """Leftmost matches of ``targets`` (pattern) from the matches ``states`` of their prefixes.

    A state row is (pattern, seq_id, pos, ts, places, times): last matched event and all of them.
    """
    t = targets.select(
        "pattern",
        P.head(F.col("pattern")).alias("prefix"),
        F.element_at("pattern", -1).alias("element"),
        _element_key(F.element_at("pattern", -1)).alias("ekey"),
    )
    elem_occ = _element_occurrences(t.select("ekey", "element").distinct(), occ)
    first = (
        elem_occ.join(t.where(F.size("prefix") == 0).select("pattern", "ekey"), "ekey")
        .groupBy("pattern", "seq_id")
        .agg(F.min("pos").alias("pos"), F.min("ts").alias("ts"))
        .select(
            "pattern", "seq_id", "pos", "ts", F.array("pos").alias("places"), F.array("ts").alias("times")
        )
    )
    if states is None:
        return first
    asked = (
        states.withColumnRenamed("pattern", "prefix")
        .join(t.where(F.size("prefix") > 0).select("pattern", "prefix", "ekey"), "prefix")
        .select("seq_id", "ekey", F.col("pos").alias("after"), "pattern", F.col("ts").alias("before"), "places", "times")
    )
    nxt = _next_occurrence(asked, elem_occ, max_group_rows, hot)
    ok = limits.accept_gap(F.col("ts") - F.col("before")) & limits.accept_span(F.col("ts") - F.col("times")[0])
    more = nxt.where(ok).select(
        "pattern",
        "seq_id",
        "pos",
        "ts",
        F.concat("places", F.array("pos")).alias("places"),
        F.concat("times", F.array("ts")).alias("times"),
    )
    return first.unionByName(more)


def match_patterns(
    patterns: DataFrame, occ: DataFrame, limits: TimeLimits = TimeLimits(), max_group_rows: int | None = None
) -> DataFrame:
    """(pattern, seq_id, places, times): the accepted leftmost match of each pattern in each sequence.

    Patterns are processed by prefix, so shared beginnings are matched once.
    """
    max_rows = max_group_rows or MAX_GROUP_ROWS
    pats = stable(patterns.select("pattern").distinct())
    longest = pats.agg(F.max(F.size("pattern"))).first()[0] or 0
    hot = _has_hot(occ, max_rows)
    states, out = None, None
    for n in range(1, longest + 1):
        part = pats.where(F.size("pattern") >= n).select(F.slice("pattern", 1, n).alias("pattern")).distinct()
        states = stable(_advance(part, states, occ, limits, max_rows, hot))
        done = states.join(pats.where(F.size("pattern") == n), "pattern", "left_semi")
        out = done if out is None else out.unionByName(done)
    if out is None:
        out = _advance(pats, None, occ, limits, max_rows, hot)
    return out.select("pattern", "seq_id", "places", "times")


def _by_length(occ: DataFrame, max_group_rows: int) -> tuple[DataFrame, DataFrame | None]:
    """Occurrences of sequences that one task can hold, and those of longer ones, if there are any."""
    long = occ.groupBy("seq_id").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > max_group_rows).select("seq_id")
    if long.isEmpty():
        return occ, None
    long = stable(long)
    return occ.join(long, "seq_id", "left_anti"), stable(occ.join(long, "seq_id", "left_semi"))


def _counts(
    patterns: DataFrame, light: DataFrame, heavy: DataFrame | None, limits: TimeLimits, max_group_rows: int
) -> DataFrame:
    """(pattern, support_count) of the distinct ``patterns`` that match; the driver sees ``MAX_PATTERNS`` at most."""

    def joined(occ: DataFrame) -> DataFrame:
        matches = match_patterns(patterns, occ, limits, max_group_rows)
        return matches.groupBy("pattern").agg(F.count(F.lit(1)).alias("support_count"))

    few = patterns.limit(counting.MAX_PATTERNS + 1).collect()
    if len(few) > counting.MAX_PATTERNS:
        return joined(light if heavy is None else light.unionByName(heavy))
    found = counting.count_in_tasks(light, [r["pattern"] for r in few if r["pattern"]], limits.given())
    if heavy is None:
        return found
    both = found.unionByName(joined(heavy))
    return both.groupBy("pattern").agg(F.sum("support_count").alias("support_count"))


def n_sequences(occ: DataFrame) -> int:
    return occ.agg(F.count_distinct("seq_id")).first()[0]


def _supported(states: DataFrame, n: int, min_sup: float, compat_rounding: bool) -> DataFrame:
    counts = states.groupBy("pattern").agg(F.count(F.lit(1)).alias("support_count"))
    return _with_support(counts, n).where(_threshold(min_sup, compat_rounding))


def _with_support(counts: DataFrame, n: int) -> DataFrame:
    return counts.select(
        "pattern",
        P.n_items(F.col("pattern")).alias("n_items"),
        F.size("pattern").alias("n_elements"),
        "support_count",
        (F.col("support_count") / F.lit(float(n))).alias("support"),
    )


def _threshold(min_sup: float, compat_rounding: bool) -> Column:
    """``compat_rounding`` compares the support rounded to two decimals, as the published runs did."""
    value = rnd("support", 2) if compat_rounding else F.col("support")
    return value >= F.lit(float(min_sup))


def support(
    patterns: DataFrame, occ: DataFrame, limits: TimeLimits = TimeLimits(), max_group_rows: int | None = None
) -> DataFrame:
    """Support of given patterns; patterns without a match have support 0."""
    max_rows = max_group_rows or MAX_GROUP_ROWS
    n = n_sequences(occ)
    every = stable(patterns.select("pattern").distinct())
    counts = _counts(every, *_by_length(occ, max_rows), limits, max_rows)
    return _with_support(every.join(counts, "pattern", "left").na.fill(0, ["support_count"]), n)


def frequent_items(occ: DataFrame, min_sup: float, compat_rounding: bool = False) -> DataFrame:
    """Level 1: single items and their support."""
    singles = occ.select("seq_id", F.array(F.array("item")).alias("pattern")).distinct()
    return _supported(singles, n_sequences(occ), min_sup, compat_rounding)


def pair_counts(occ: DataFrame) -> DataFrame:
    """(pattern, support_count) of all two-item patterns that occur.

    An ordered pair needs only the first place of one and the last place of the other item per
    sequence, so what meets is (sequence, item) totals, not events.
    """
    ends = occ.groupBy("seq_id", "item").agg(F.min("pos").alias("lo"), F.max("pos").alias("hi"))
    a = ends.select("seq_id", F.col("item").alias("a"), "lo")
    b = ends.select("seq_id", F.col("item").alias("b"), "hi")
    ordered = a.join(b, "seq_id").where("lo < hi").groupBy("a", "b").agg(F.count(F.lit(1)).alias("support_count"))
    x = occ.select("seq_id", "pos", F.col("item").alias("a"))
    y = occ.select("seq_id", "pos", F.col("item").alias("b"))
    together = (
        x.join(y, ["seq_id", "pos"])
        .where("a < b")
        .groupBy("a", "b", "seq_id")
        .agg(F.lit(1).alias("_one"))
        .groupBy("a", "b")
        .agg(F.count(F.lit(1)).alias("support_count"))
    )
    return ordered.select(F.array(F.array("a"), F.array("b")).alias("pattern"), "support_count").unionByName(
        together.select(F.array(F.array("a", "b")).alias("pattern"), "support_count")
    )


def candidates(frequent: DataFrame) -> DataFrame:
    """Level k from level k-1 (k >= 3): join where one without its first item equals one without its last."""
    left = frequent.select(F.col("pattern").alias("s1"), P.drop_first_item(F.col("pattern")).alias("core"))
    right = frequent.select(F.col("pattern").alias("s2"), P.drop_last_item(F.col("pattern")).alias("core"))
    return left.join(right, "core").select(P.join_candidates(F.col("s1"), F.col("s2")).alias("pattern")).distinct()


def prune(cands: DataFrame, frequent: DataFrame, timed: bool = False) -> DataFrame:
    """Candidates whose one-item deletions are all frequent; only contiguous ones count when timed."""
    subs = P.contiguous_subsequences if timed else P.direct_subsequences
    parts = cands.select("pattern", F.explode(F.array_distinct(subs(F.col("pattern")))).alias("part"))
    known = frequent.select(F.col("pattern").alias("part"))
    bad = parts.join(known, "part", "left_anti").select("pattern")
    return cands.join(bad, "pattern", "left_anti")


def gsp_matches(
    occ: DataFrame,
    min_sup: float,
    limits: TimeLimits = TimeLimits(),
    compat_rounding: bool = False,
    max_group_rows: int | None = None,
) -> tuple[DataFrame, DataFrame | None]:
    """The result of :func:`gsp`, and the written matches of its patterns of two and more items as
    :func:`match_patterns` returns them; None without such patterns."""
    max_rows = max_group_rows or MAX_GROUP_ROWS
    n = n_sequences(occ)
    level = stable(frequent_items(occ, min_sup, compat_rounding))
    result = level
    items = level.select(F.col("pattern")[0][0].alias("item"))
    occ = stable(occ.join(items, "item", "left_semi").select("seq_id", "pos", "ts", "item"))
    if level.isEmpty():
        return result, None
    hot = _has_hot(occ, max_rows)
    # unconstrained pair support bounds the constrained one, so rare pairs are never matched
    pairs = stable(_with_support(pair_counts(occ), n).where(_threshold(min_sup, compat_rounding)))
    if pairs.isEmpty():
        return result, None
    states = [stable(_advance(level, None, occ, limits, max_rows, hot))]
    cands = pairs
    while True:
        known = states[0]
        for s in states[1:]:
            known = known.unionByName(s)
        found = stable(_advance(cands, known, occ, limits, max_rows, hot))
        level = stable(_supported(found, n, min_sup, compat_rounding))
        if level.isEmpty():
            return result, _matches(states)
        result = result.unionByName(level)
        states.append(stable(found.join(level, "pattern", "left_semi")))
        cands = stable(prune(candidates(level), level, bool(limits)))
        if cands.isEmpty():
            return result, _matches(states)


def _matches(states: list[DataFrame]) -> DataFrame | None:
    several = [s.select("pattern", "seq_id", "places", "times") for s in states[1:]]
    return functools.reduce(DataFrame.unionByName, several) if several else None


def gsp(
    occ: DataFrame,
    min_sup: float,
    limits: TimeLimits = TimeLimits(),
    compat_rounding: bool = False,
    max_group_rows: int | None = None,
) -> DataFrame:
    """All frequent patterns: (pattern, n_items, n_elements, support_count, support).

    Level 1 is unconstrained. The driver sees a level's candidates if they are few enough for every task, else only
    whether there are any.
    """
    max_rows = max_group_rows or MAX_GROUP_ROWS
    n = n_sequences(occ)
    level = stable(frequent_items(occ, min_sup, compat_rounding))
    result = level
    items = level.select(F.col("pattern")[0][0].alias("item"))
    occ = stored(occ.join(items, "item", "left_semi").select("seq_id", "pos", "ts", "item"))
    # unconstrained pair support bounds the constrained one, so rare pairs are never matched
    cands = stable(_with_support(pair_counts(occ), n).where(_threshold(min_sup, compat_rounding)))
    if cands.isEmpty():
        return result
    light, heavy = _by_length(occ, max_rows)
    while not cands.isEmpty():
        counts = _counts(cands.select("pattern"), light, heavy, limits, max_rows)
        level = stable(_with_support(counts, n).where(_threshold(min_sup, compat_rounding)))
        result = result.unionByName(level)
        cands = stable(prune(candidates(level), level, bool(limits)))
    return result


# ---- sweeps ---------------------------------------------------------------------------------------


def mining_sweep(
    lines: DataFrame,
    min_sups: Sequence[float] = (0.4, 0.35, 0.3, 0.25, 0.2, 0.15),
    min_baskets: Sequence[int] = (20, 10, 5, 3, 2),
    item: str = "prod_id",
    compat_rounding: bool = False,
) -> DataFrame:
    """Result sizes per setting. Each min_baskets is mined once, at the lowest support; the others are
    filters of that result. ``seconds`` is the mining time of that one run."""
    out = []
    for n in min_baskets:
        occ = stable(occurrences(min_basket_customers(lines, n), item).select("seq_id", "pos", "ts", "item"))
        start = time.time()
        found = stable(gsp(occ, min(min_sups), compat_rounding=compat_rounding))
        seconds = time.time() - start
        sizes = found.agg(
            *[
                F.struct(
                    F.count_if(_threshold(s, compat_rounding)).alias("n_patterns"),
                    F.count_if(_threshold(s, compat_rounding) & (F.col("n_items") >= 2)).alias("n_two_or_more"),
                    F.count_if(_threshold(s, compat_rounding) & P.has_repeats(F.col("pattern"))).alias("n_with_repeats"),
                ).alias(f"s{i}")
                for i, s in enumerate(min_sups)
            ]
        ).first()
        for i, s in enumerate(min_sups):
            out.append((int(n), float(s), float(seconds), *map(int, sizes[f"s{i}"])))
    schema = "min_baskets int, min_sup double, seconds double, n_patterns long, n_two_or_more long, n_with_repeats long"
    return lines.sparkSession.createDataFrame(out, schema)


def constraint_sweep(
    occ: DataFrame,
    param: str,
    values: Sequence[timedelta],
    min_sup: float,
    compat_rounding: bool = False,
    max_group_rows: int | None = None,
) -> DataFrame:
    """(value_days, n_patterns): patterns of 2 and 3 items left by each value of one time limit.

    The leftmost match does not depend on the limit, so the unconstrained result is mined at ``min_sup``, and each value
    filters the matches that the mining has written; levels are then pruned on the small pattern table.
    """
    n = n_sequences(occ)
    _, matches = gsp_matches(occ, min_sup, compat_rounding=compat_rounding, max_group_rows=max_group_rows)
    spark = occ.sparkSession
    vals = [(int(v.total_seconds() // 86400), v) for v in values]
    grid = F.array(*[F.struct(F.lit(d).alias("value_days"), F.lit(v).alias("limit")) for d, v in vals])
    if matches is None:
        return spark.createDataFrame([(d, 0) for d, _ in vals], "value_days int, n_patterns long").orderBy("value_days")
    gaps = F.transform(
        F.sequence(F.lit(1), F.size("times") - 1), lambda i: F.get("times", i) - F.get("times", i - 1)
    )
    gaps = F.when(F.size("times") > 1, gaps)
    # days as exact intervals; a single event has neither gap nor span
    facts = matches.select(
        "pattern",
        F.array_min(gaps).alias("min_gap"),
        F.array_max(gaps).alias("max_gap"),
        (F.element_at("times", -1) - F.element_at("times", 1)).alias("max_span"),
    )
    off = F.col("limit") == F.lit(timedelta(0))
    keep = {
        "min_gap": F.col("min_gap") >= F.col("limit"),
        "max_gap": F.col("max_gap") <= F.col("limit"),
        "max_span": F.col("max_span") <= F.col("limit"),
    }[param]
    counts = (
        facts.withColumn("g", F.explode(grid))
        .select("pattern", "min_gap", "max_gap", "max_span", "g.*")
        .where(off | F.coalesce(keep, F.lit(True)))
        .groupBy("value_days", "pattern")
        .agg(F.count(F.lit(1)).alias("support_count"))
    )
    left = stable(
        counts.withColumn("support", F.col("support_count") / F.lit(float(n)))
        .where(_threshold(min_sup, compat_rounding))
        .select("value_days", "pattern", P.n_items(F.col("pattern")).alias("n_items"))
    )
    deepest = left.agg(F.max("n_items")).first()[0] or 1
    below = left.where("n_items = 2")  # their parts are single items, which are never constrained
    kept = below
    for k in range(3, deepest + 1):
        level = left.where(F.col("n_items") == k)
        parts = level.select(
            "value_days",
            "pattern",
            F.explode(F.array_distinct(P.contiguous_subsequences(F.col("pattern")))).alias("part"),
        )
        known = below.select("value_days", F.col("pattern").alias("part"))
        bad = parts.join(known, ["value_days", "part"], "left_anti").select("value_days", "pattern")
        below = stable(level.join(bad, ["value_days", "pattern"], "left_anti"))
        kept = kept.unionByName(below)
    sizes = kept.where("n_items <= 3").groupBy("value_days").agg(F.count(F.lit(1)).alias("n_patterns"))
    every = spark.createDataFrame([(d,) for d, _ in vals], "value_days int")
    return every.join(sizes, "value_days", "left").na.fill(0, ["n_patterns"]).orderBy("value_days")
