"""Supports of many patterns, counted where the sequences lie.

A task takes whole sequences and walks all patterns through them by shared prefixes, a few thousand sequences at a time;
it returns one count per pattern. Matches are neither written nor shuffled, so what moves is the occurrences, once.
The patterns (at most ``MAX_PATTERNS``) are all that every task holds.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass
from datetime import timedelta

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_PATTERNS = 50_000
_ROWS = 1 << 17  # occurrences worked on together
_STEPS = 1 << 19  # lookups worked on together
_NO_TIME = np.iinfo(np.int64).max

Pattern = Sequence[Sequence[str]]


@dataclass
class _Level:
    """Prefixes of one length, in the order of their own prefixes; prefix i is continued by ``first[i]:first[i + 1]``."""

    element: np.ndarray
    pattern: np.ndarray  # the pattern that ends here, or -1
    first: np.ndarray


class _Prefixes:
    """The patterns as a tree of elements; items and elements are numbered."""

    def __init__(self, patterns: Sequence[Pattern]):
        # an element without an item is found where the item is the empty text, as its key is
        spelled = [[tuple("" if len(e) == 1 and i is None else i for i in e) for e in p] for p in patterns]
        elements = list(dict.fromkeys(e for p in spelled for e in p))
        self.items = list(dict.fromkeys(i for e in elements for i in e if i is not None))
        code = {item: i for i, item in enumerate(self.items)}
        # single items keep their number, elements of several follow; what holds no item or a null is found nowhere
        self.several = [tuple(code[i] for i in e) for e in elements if len(e) > 1 and None not in e]
        number = {(i,): n for i, n in code.items()}
        for e in elements:
            if len(e) > 1 and None not in e:
                number[e] = len(number)
        self.n_elements = len(number)
        found = [(n, tuple(number.get(e, -1) for e in p)) for n, p in enumerate(spelled)]
        ends = {p: n for n, p in found if p and -1 not in p}
        self.levels: list[_Level] = []
        before: list[tuple[int, ...]] = [()]
        for size in range(1, max(map(len, ends), default=0) + 1):
            here = sorted({p[:size] for p in ends if len(p) >= size})
            place = {p: i for i, p in enumerate(before)}
            parents = np.array([place[p[:-1]] for p in here], dtype=np.int64)
            if self.levels:
                self.levels[-1].first = np.searchsorted(parents, np.arange(len(before) + 1))
            self.levels.append(
                _Level(
                    np.array([p[-1] for p in here], dtype=np.int64),
                    np.array([ends.get(p, -1) for p in here], dtype=np.int64),
                    np.zeros(len(here) + 1, dtype=np.int64),
                )
            )
            before = here


def _ramps(start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """start[0], start[0] + 1, ... (n[0] of them), start[1], ..."""
    ends = np.cumsum(n)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(start - (ends - n), n)


def _parts(work: np.ndarray, most: int) -> Iterator[slice]:
    """Consecutive runs of rows with about ``most`` of ``work`` each."""
    total = np.cumsum(work)
    cuts = np.unique(np.searchsorted(total, np.arange(most, total[-1] if len(total) else 0, most)) + 1)
    for lo, hi in zip([0, *cuts], [*cuts, len(work)], strict=True):
        if lo < hi:
            yield slice(lo, hi)


class _Events:
    """Occurrences of all elements in a block of whole sequences, sorted by element and event."""

    def __init__(self, tree: _Prefixes, seq: np.ndarray, pos: np.ndarray, item: np.ndarray, ts: np.ndarray | None):
        by = np.lexsort((pos, seq))
        seq, pos, item = seq[by], pos[by], item[by]
        new = np.ones(len(seq), dtype=bool)
        new[1:] = (seq[1:] != seq[:-1]) | (pos[1:] != pos[:-1])
        event = np.cumsum(new) - 1
        self.seq_of = seq[new]
        self.n = len(self.seq_of)
        by_item = np.argsort(item, kind="stable")
        element, event = item[by_item], event[by_item]
        ts = None if ts is None else ts[by][by_item]
        keys = element * self.n + event
        where = self._together(tree, element, event, keys)
        self.element = np.concatenate([element, *[e for e, _ in where]])
        rows = np.concatenate([np.arange(len(element)), *[r for _, r in where]])
        self.event = event[rows]
        self.keys = self.element * self.n + self.event
        self.ts = None if ts is None else self._least_from_here(ts[rows])

    def _together(self, tree, element, event, keys) -> list[tuple[np.ndarray, np.ndarray]]:
        """(element, row of one of its items) for elements of several items, where all of them are found."""
        bounds = np.searchsorted(element, np.arange(len(tree.items) + 1))
        held = np.diff(bounds)
        out = []
        sizes = np.array([len(e) for e in tree.several], dtype=np.int64)
        for size in np.unique(sizes):
            which = np.flatnonzero(sizes == size)
            parts = np.array([tree.several[i] for i in which], dtype=np.int64)
            rarest = parts[np.arange(len(parts)), np.argmin(held[parts], axis=1)]
            for some in _parts(held[rarest], _STEPS):
                n = held[rarest[some]]
                rows = _ramps(bounds[rarest[some]], n)
                at = np.repeat(np.arange(len(n)), n)
                for j in range(size):
                    want = parts[some][at, j] * self.n + event[rows]
                    place = np.minimum(np.searchsorted(keys, want), len(keys) - 1)
                    ok = keys[place] == want
                    rows, at = rows[ok], at[ok]
                out.append((len(tree.items) + which[some][at], rows))
        if out:
            # sizes were taken one after the other
            e, r = np.concatenate([e for e, _ in out]), np.concatenate([r for _, r in out])
            by = np.argsort(e, kind="stable")
            out = [(e[by], r[by])]
        return out

    def _least_from_here(self, ts: np.ndarray) -> np.ndarray:
        """The least time of this and all later occurrences of the element in the sequence."""
        ts = ts.copy()
        seq = self.seq_of[self.event]
        step = 1
        while step < len(ts):
            same = (self.element[step:] == self.element[:-step]) & (seq[step:] == seq[:-step])
            if not same.any():
                break
            ts[:-step] = np.where(same, np.minimum(ts[:-step], ts[step:]), ts[:-step])
            step *= 2
        return ts

    def firsts(self) -> np.ndarray:
        """Rows of each element's first occurrence in each sequence."""
        seq = self.seq_of[self.event]
        new = np.ones(len(seq), dtype=bool)
        new[1:] = (self.element[1:] != self.element[:-1]) | (seq[1:] != seq[:-1])
        return np.flatnonzero(new)

    def after(self, element: np.ndarray, event: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Whether the element occurs later in the event's sequence, and the row of its next occurrence."""
        row = np.searchsorted(self.keys, element * self.n + event, side="right")
        row = np.minimum(row, len(self.keys) - 1)
        found = self.event[row]
        return (self.element[row] == element) & (found > event) & (self.seq_of[found] == self.seq_of[event]), row


@dataclass
class _Micros:
    """Time limits in microseconds; None is no limit."""

    max_span: int | None
    min_gap: int | None
    max_gap: int | None

    def accept(self, now: np.ndarray, before: np.ndarray, start: np.ndarray) -> np.ndarray:
        ok = (now != _NO_TIME) & (before != _NO_TIME)
        if self.max_span is not None:
            ok &= (start != _NO_TIME) & (np.where(ok, now - np.where(ok, start, 0), 0) <= self.max_span)
        gap = np.where(ok, now - np.where(ok, before, 0), 0)
        if self.min_gap is not None:
            ok &= gap >= self.min_gap
        if self.max_gap is not None:
            ok &= gap <= self.max_gap
        return ok


def _walk(tree: _Prefixes, ev: _Events, limits: _Micros | None, counts: np.ndarray) -> None:
    """Add the block's matching sequences to ``counts``."""

    def add(level: _Level, node: np.ndarray) -> None:
        hit = level.pattern[node]
        counts[:] += np.bincount(hit[hit >= 0], minlength=len(counts))

    def go(depth: int, node: np.ndarray, event: np.ndarray, ts: np.ndarray | None, start: np.ndarray | None) -> None:
        level = tree.levels[depth]
        add(level, node)
        if depth + 1 == len(tree.levels):
            return
        below = tree.levels[depth + 1]
        fan = level.first[node + 1] - level.first[node]
        for some in _parts(fan, _STEPS):
            child = _ramps(level.first[node[some]], fan[some])
            of = np.repeat(np.arange(some.start, some.stop), fan[some])
            ok, row = ev.after(below.element[child], event[of])
            child, of, row = child[ok], of[ok], row[ok]
            if limits is not None:
                ok = limits.accept(ev.ts[row], ts[of], start[of])
                child, of, row = child[ok], of[ok], row[ok]
            if len(child):
                go(depth + 1, child, ev.event[row], None if ts is None else ev.ts[row], None if ts is None else start[of])

    rows = ev.firsts()
    node_of = np.full(tree.n_elements, -1)
    node_of[tree.levels[0].element] = np.arange(len(tree.levels[0].element))
    rows = rows[node_of[ev.element[rows]] >= 0]
    ts = None if ev.ts is None else ev.ts[rows]
    go(0, node_of[ev.element[rows]], ev.event[rows], ts, ts)


def _blocks(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of whole sequences and each row's sequence, from rows that come sequence by sequence."""
    kept: list[pa.RecordBatch | pa.Table] = []
    rows, least = 0, _ROWS

    def joined() -> tuple[pa.Table, np.ndarray]:
        table = pa.concat_tables([pa.Table.from_batches([k]) if isinstance(k, pa.RecordBatch) else k for k in kept])
        ids = table.column("seq_id").combine_chunks()
        return table, np.asarray(pc.dictionary_encode(ids, null_encoding="encode").indices, dtype=np.int64)

    for batch in batches:
        kept.append(batch)
        rows += batch.num_rows
        if rows < least:
            continue
        table, seq = joined()
        last = np.flatnonzero(seq != seq[-1])
        cut = last[-1] + 1 if len(last) else 0
        if cut:
            yield table.slice(0, cut), seq[:cut]
        kept, rows = [table.slice(cut)], table.num_rows - cut
        least = max(_ROWS, 2 * rows)
    if rows:
        yield joined()


def count_in_tasks(occ: DataFrame, patterns: Sequence[Pattern], limits: dict[str, timedelta] | None) -> DataFrame:
    """(pattern, support_count) of those ``patterns`` that match in some sequence of ``occ``.

    A sequence passes through one task as a whole. ``limits`` holds the time limits that are set.
    """
    micros = {k: v // timedelta(microseconds=1) for k, v in (limits or {}).items()}
    micros = _Micros(*[micros.get(k) for k in ("max_span", "min_gap", "max_gap")]) if micros else None
    timed = micros is not None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree = _Prefixes(patterns)
        if not tree.levels:
            return
        counts = np.zeros(len(patterns), dtype=np.int64)
        for table, seq in _blocks(batches):
            item = table.column("item").combine_chunks()
            code = pc.index_in(item, value_set=pa.array(tree.items, item.type)).fill_null(-1)
            code = np.asarray(code, dtype=np.int64)
            known = code >= 0
            if not known.any():
                continue
            pos = np.asarray(table.column("pos").combine_chunks(), dtype=np.int64)
            ts = table.column("ts").combine_chunks().cast(pa.int64()).fill_null(_NO_TIME) if timed else None
            ts = np.asarray(ts)[known] if timed else None
            _walk(tree, _Events(tree, seq[known], pos[known], code[known], ts), micros, counts)
        seen = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([patterns[i] for i in seen], pa.list_(pa.list_(pa.string()))),
                pa.array(counts[seen], pa.int64()),
            ],
            names=["pattern", "n"],
        )

    # differences of times are those of the session's local time, as in SQL
    ts = [F.col("ts").cast("timestamp_ntz").alias("ts")] if timed else []
    rows = occ.select("seq_id", "pos", "item", *ts).repartition("seq_id").sortWithinPartitions("seq_id")
    each = rows.mapInArrow(run, "pattern array<array<string>>, n long")
    return each.groupBy("pattern").agg(F.sum("n").alias("support_count"))
