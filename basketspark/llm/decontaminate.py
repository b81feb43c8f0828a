"""Benchmark decontamination by greedy string tiling.

Words are runs of letters and digits in lower case. Matches of ``MIN_TILE`` words or more consist of five-word
seeds which the item has too, so a document shrinks to its runs of such seeds before anything is shuffled: a bit map of
fixed size, set from all seeds of the benchmark, finds them, and a join on the seed's hash tells which items they
belong to. Each (document, item) pair is then tiled: the longest common stretch of words that no tile covers yet
is found by hashing all stretches of one length with a running Karp-Rabin hash, marked on both sides, and so
on down to ``MIN_TILE`` words. Tiles may lie in any order, so reordered passages count fully.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import stable
from .near_dedup import runs
from .tables import broadcast_if_small
from .words import Splitter, Words, odd_numbers, shingles

MIN_TILE = 5
COVERAGE = 0.5
MAP_BITS = 23


def _long_seeds(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Seeds of a slice's texts and the word each begins at; texts shorter than a seed have none."""
    seeds, bounds = shingles(words, MIN_TILE)
    n = np.diff(words.first)
    begin = np.repeat(words.first[:-1] - bounds[:-1], np.diff(bounds)) + np.arange(len(seeds))
    long = np.repeat(n >= MIN_TILE, np.diff(bounds))
    return seeds[long], begin[long]


def _item_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    split = Splitter("letters")
    for batch in batches:
        for w in split.slices(batch.column(1)):
            seeds, begin = _long_seeds(w)
            cut = np.searchsorted(begin, w.first).astype(np.int32)
            lists = [
                pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(x.view(np.int64)))
                for at, x in ((w.first, w.hash), (cut, seeds))
            ]
            ids = batch.column(0).slice(w.rows.start, len(w.rows))
            yield pa.RecordBatch.from_arrays([ids, *lists], names=["item", "words", "seeds"])


def _runs_of_seeds(bitmap: np.ndarray):
    """Stretches of a document whose every five words may be a seed: (doc, doc_id, at, words, seeds)."""
    mask = np.uint64((1 << MAP_BITS) - 1)

    def hit(h: np.ndarray) -> np.ndarray:
        found = np.ones(len(h), bool)
        for shift in (0, 20, 40):
            slot = (h >> np.uint64(shift)) & mask
            found &= (bitmap[(slot >> np.uint64(6)).astype(np.int64)] >> (slot & np.uint64(63))) & np.uint64(1) == 1
        return found

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split = Splitter("letters")
        for batch in batches:
            for w in split.slices(batch.column(2)):
                seeds, begin = _long_seeds(w)
                kept = hit(seeds)
                seeds, begin = seeds[kept], begin[kept]
                if not len(seeds):
                    continue
                text = np.searchsorted(w.first, begin, "right") - 1
                new = np.concatenate(([True], (np.diff(begin) != 1) | (np.diff(text) != 0)))
                lo = np.flatnonzero(new)
                hi = np.append(lo[1:], len(begin))
                words = [w.hash[begin[a] : begin[b - 1] + MIN_TILE].view(np.int64) for a, b in zip(lo, hi, strict=True)]
                rows = pa.array(w.rows.start + text[lo])
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(rows),
                        batch.column(1).take(rows),
                        pa.array(begin[lo] - w.first[text[lo]]),
                        pa.array(words, pa.list_(pa.int64())),
                        pa.array([seeds[a:b].view(np.int64) for a, b in zip(lo, hi, strict=True)], pa.list_(pa.int64())),
                    ],
                    names=["doc", "doc_id", "at", "words", "seeds"],
                )

    return run


def _stretches(words: np.ndarray, marked: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of all unmarked stretches of ``size`` words and their running hashes."""
    base = odd_numbers(1, 29)[0]
    power = np.cumprod(np.full(len(words) + 1, base, np.uint64))
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(words * power[:-1])))
    used = np.concatenate(([0], np.cumsum(marked)))
    at = np.flatnonzero(used[size:] == used[:-size])
    # multiplied up to a common power, since the hash at place i carries the base to the power i
    return at, (total[at + size] - total[at]) * power[len(words) - at]


def tiles(item: np.ndarray, text: np.ndarray, least: int = MIN_TILE) -> list[tuple[int, int, int]]:
    """(place in item, place in text, length) of greedy tiles, longest first; both are arrays of word hashes."""
    done_item, done_text = np.zeros(len(item), bool), np.zeros(len(text), bool)
    pad = max(len(item), len(text))
    item, text = (np.concatenate((x, np.zeros(pad - len(x), np.uint64))) for x in (item, text))
    done_item, done_text = (np.concatenate((x, np.ones(pad - len(x), bool))) for x in (done_item, done_text))
    found = []

    def common(size: int):
        a, ha = _stretches(item, done_item, size)
        b, hb = _stretches(text, done_text, size)
        return a, ha, b, hb, np.isin(ha, hb)

    top = pad
    while top >= least:
        low, high = least - 1, top  # a common stretch of n words has one of n - 1 words in it
        while low < high:
            middle = (low + high + 1) // 2
            if common(middle)[4].any():
                low = middle
            else:
                high = middle - 1
        if low < least:
            break
        a, ha, b, hb, both = common(low)
        order = np.argsort(hb, kind="stable")
        a, ha, b, hb = a[both], ha[both], b[order], hb[order]
        first, last = np.searchsorted(hb, ha, "left"), np.searchsorted(hb, ha, "right")
        for p, lo, hi in zip(a, first, last, strict=True):
            for t in b[lo:hi]:
                if done_item[p : p + low].any():
                    break
                if not done_text[t : t + low].any() and np.array_equal(item[p : p + low], text[t : t + low]):
                    done_item[p : p + low] = done_text[t : t + low] = True
                    found.append((int(p), int(t), int(low)))
        top = low - 1 if low > least else 0
    return found


def _tile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    gap = np.zeros(1, np.uint64)
    for pair in runs(batches, 2):
        item = np.array(pair.column("item_words")[0].as_py(), np.int64).view(np.uint64)
        parts = [np.array(x, np.int64).view(np.uint64) for x in pair.column("words").to_pylist()]
        text = np.concatenate([y for x in parts for y in (x, gap)])
        got = tiles(item, text)
        yield pa.RecordBatch.from_arrays(
            [
                pair.column("doc").combine_chunks()[:1],
                pair.column("item").combine_chunks()[:1],
                pa.array([len(item)], pa.int64()),
                pa.array([sum(n for _, _, n in got)], pa.int64()),
                pa.array([len(got)], pa.int64()),
            ],
            names=["doc", "item", "n_words", "n_covered", "n_tiles"],
        )


def contaminated_texts(
    docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE, id_col: str = "doc_id", text_col: str = "text",
    item_text_col: str = "text",
) -> tuple[DataFrame, DataFrame]:
    """Pairs of texts, named by their hash, with ``coverage`` of the item's words tiled, and ids of texts with seeds.

    The first is (doc, item, n_words, n_covered, n_tiles, coverage), the second (doc, doc_id). Copies of a text are
    tiled once. A text's hash is ``xxhash64`` of it.
    """
    items = benchmark.select(F.xxhash64(item_text_col).alias("item"), F.col(item_text_col).alias("text"))
    items = items.where("text IS NOT NULL").dropDuplicates(["item"])
    items = stable(items.mapInArrow(_item_words, "item long, words array<long>, seeds array<long>"))
    seeds = stable(items.select("item", F.explode("seeds").alias("seed")).distinct())
    slots = F.explode(F.expr(f"transform(array(0, 20, 40), k -> shiftrightunsigned(seed, k) & {(1 << MAP_BITS) - 1}L)"))
    bits = seeds.select(slots.alias("slot")).groupBy(F.expr("slot div 64").alias("at"))
    bits = bits.agg(F.expr("bit_or(shiftleft(1L, cast(slot % 64 as int)))").alias("word"))
    bitmap = np.zeros(1 << (MAP_BITS - 6), np.int64)
    for row in bits.collect():  # at most 2**17 rows, however large the benchmark
        bitmap[row["at"]] = row["word"]
    texts = docs.select(
        F.xxhash64(text_col).alias("doc"), F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")
    )
    found = stable(
        texts.mapInArrow(
            _runs_of_seeds(bitmap.view(np.uint64)), "doc long, doc_id long, at long, words array<long>, seeds array<long>"
        )
    )
    parts = stable(found.select("doc", "at", "words", "seeds").dropDuplicates(["doc", "at"]))
    named = parts.select("doc", "at", F.explode("seeds").alias("seed")).join(broadcast_if_small(seeds), "seed")
    named = named.select("doc", "at", "item").distinct()
    pairs = named.join(parts.select("doc", "at", "words"), ["doc", "at"])
    pairs = pairs.join(broadcast_if_small(items.select("item", F.col("words").alias("item_words")), 1000), "item")
    # few bytes but much work a row: keep the tasks that adaptive execution would merge
    tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = pairs.select("doc", "item", "at", "words", "item_words").repartition(tasks, "doc", "item")
    tiled = dealt.sortWithinPartitions("doc", "item", "at").mapInArrow(
        _tile, "doc long, item long, n_words long, n_covered long, n_tiles long"
    )
    tiled = tiled.withColumn("coverage", F.col("n_covered") / F.col("n_words")).where(F.col("coverage") >= coverage)
    return stable(tiled), found.select("doc", "doc_id")


def contaminated(
    docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE, id_col: str = "doc_id", text_col: str = "text",
    item_col: str = "item_id", item_text_col: str = "text",
) -> DataFrame:
    """(doc_id, item_id, n_words, n_covered, n_tiles, coverage) of pairs with ``coverage`` of the item's words tiled.

    Null and empty texts match nothing, and neither do items of fewer than ``MIN_TILE`` words. Every text is searched
    for on its own, whether its id is null or has other texts too: one row for each different text of an id, on both
    sides, and one for all rows that repeat id and text. Other columns are ignored; an empty table on either side
    gives no rows.
    """
    pairs, ids = contaminated_texts(docs, benchmark, coverage, id_col, text_col, item_text_col)
    names = benchmark.select(F.xxhash64(item_text_col).alias("item"), F.col(item_col).cast("long").alias("item_id"))
    ids = ids.join(broadcast_if_small(pairs.select("doc").distinct()), "doc", "left_semi").distinct()
    names = names.join(broadcast_if_small(pairs.select("item").distinct()), "item", "left_semi").distinct()
    named = ids.join(broadcast_if_small(pairs), "doc").join(broadcast_if_small(names), "item")
    return named.select("doc_id", "item_id", "n_words", "n_covered", "n_tiles", "coverage")
