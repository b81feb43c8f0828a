"""Column expressions on patterns, ``array<array<string>>`` with sorted elements."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def n_items(pattern: Column) -> Column:
    return F.size(F.flatten(pattern))


def text(pattern: Column) -> Column:
    """``[A,B][C]`` form."""
    return F.array_join(F.transform(pattern, lambda e: F.concat(F.lit("["), F.array_join(e, ","), F.lit("]"))), "")


def has_repeats(pattern: Column) -> Column:
    flat = F.flatten(pattern)
    return F.size(flat) > F.size(F.array_distinct(flat))


def head(pattern: Column) -> Column:
    """Everything but the last element."""
    return F.slice(pattern, F.lit(1), F.size(pattern) - 1)


def _tail(pattern: Column) -> Column:
    return F.slice(pattern, F.lit(2), F.size(pattern))


def drop_first_item(pattern: Column) -> Column:
    first = pattern[0]
    rest = F.slice(first, F.lit(2), F.size(first))
    return F.when(F.size(first) == 1, _tail(pattern)).otherwise(F.concat(F.array(rest), _tail(pattern)))


def drop_last_item(pattern: Column) -> Column:
    last = F.element_at(pattern, -1)
    rest = F.slice(last, F.lit(1), F.size(last) - 1)
    return F.when(F.size(last) == 1, head(pattern)).otherwise(F.concat(head(pattern), F.array(rest)))


def join_candidates(left: Column, right: Column) -> Column:
    """``left`` extended by the last item of ``right``, as its own element or inside the last one."""
    last = F.element_at(right, -1)
    wider = F.concat(F.element_at(left, -1), F.array(F.element_at(last, -1)))
    return F.when(F.size(last) == 1, F.concat(left, F.array(last))).otherwise(F.concat(head(left), F.array(wider)))


def _without(pattern: Column, i: Column, j: Column) -> Column:
    shorter = F.transform(
        pattern, lambda e, at: F.when(at == i, F.filter(e, lambda _, pos: pos != j)).otherwise(e)
    )
    return F.filter(shorter, lambda e: F.size(e) > 0)


def direct_subsequences(pattern: Column) -> Column:
    """All patterns with exactly one item deleted, one entry per deletion."""
    return F.flatten(
        F.transform(pattern, lambda e, i: F.transform(e, lambda _, j: _without(pattern, i, j)))
    )


def contiguous_subsequences(pattern: Column) -> Column:
    """One-item deletions that keep the time structure: from elements with several items, or a
    single-item element at either end."""
    n = F.size(pattern)

    def of_element(e: Column, i: Column) -> Column:
        allowed = (F.size(e) > 1) | (i == 0) | (i == n - 1)
        cut = F.transform(e, lambda _, j: _without(pattern, i, j))
        return F.when(allowed, cut).otherwise(F.slice(cut, 1, 0))

    return F.flatten(F.transform(pattern, of_element))
