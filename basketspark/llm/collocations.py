"""Phrases of two or more words that occur together more often than their parts would by chance.

Only the longest windows are counted: each word with the words that follow it in its piece as further columns, padded
with nulls at the piece's end. A ROLLUP over the window's columns then sums ever shorter prefixes, so one table of
windows yields the counts of all phrase lengths.

Most words, pairs and triples are rare, and no phrase with a rare one in it can be frequent. Three rounds before therefore
find the frequent ones, and windows end before a rare one. Tasks know the frequent ones by a bitmap
of hashes, whose size is fixed: where two hashes fall on one bit, windows are longer than they need be, and no count
changes. Tasks count equal windows of some megabytes of text before they are shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.broadcast import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from basketspark.functions import stable, stored

from .tables import broadcast_within

NO_LANGUAGE = "und"
CHUNK_BYTES = 4 << 20  # texts split at a time, longer ones alone
GATHERED_WORDS = 4_000_000  # words counted together
KEPT_WORDS = 1_000_000  # different words that a task numbers before it starts anew
ROUNDS = 3  # windows of up to so many words are known to be frequent or rare before full ones are counted
FILTER_BITS = 26  # a bitmap has two to the power of this bits: eight megabytes

_FOLD = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ.,;:!?\x0b\x0c\r\t", b"abcdefghijklmnopqrstuvwxyz" + b"\n" * 9 + b" ")
_END = 1  # the number of a piece's end; 0 is the empty word between two spaces


def _columns(length: int) -> list[str]:
    return [f"w{i}" for i in range(1, length + 1)]


def _mix(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit values over all bits."""
    with np.errstate(over="ignore"):
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return x ^ (x >> np.uint64(31))


class _Words(dict):
    """Numbers for words as they come; ``hashes`` and ``names`` are in the order of the numbers."""

    def __init__(self) -> None:
        super().__init__({b"": 0, b"\n": _END})
        self.names = [b"", b"\n"]
        self.hashes = [0, 0]

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self.names)
        self.names.append(word)
        self.hashes.append(xxhash.xxh64_intdigest(word))
        return n


def _numbers(texts: list[str], words: _Words) -> np.ndarray:
    """The texts' words as numbers, with an end after each piece."""
    text = "\n".join(texts).encode().translate(_FOLD).replace(b"\n", b" \n ")
    found = np.fromiter(map(words.__getitem__, text.split(b" ")), dtype=np.int32)
    return found[found != 0]


def _in(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    at = hashes & np.uint64(len(bits) * 64 - 1)
    return (bits[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1) == 1


def _runs(ok: np.ndarray, length: int) -> np.ndarray:
    """How many of the next ``length`` entries hold without a break, for each place."""
    out = np.zeros(len(ok), dtype=np.int64)
    going = np.ones(len(ok), dtype=bool)
    for i in range(length):
        going &= np.append(ok[i:], np.zeros(min(i, len(ok)), dtype=bool))
        out += going
    return out


def _count(lang: str, w: np.ndarray, words: _Words, length: int, filters: list[np.ndarray]) -> pa.RecordBatch:
    """Equal windows of one language, counted: words without ``filters``, hashes while they are shorter than ``length`` or
    have no filter of their own yet, and the windows' columns once all filters are there."""
    own = np.uint64(xxhash.xxh64_intdigest(lang))
    with np.errstate(over="ignore"):
        # a word's hash in this language, once for each number
        by_word = _mix(np.array(words.hashes, dtype=np.uint64) ^ (own * np.uint64(0x9E3779B97F4A7C15)))
    if not filters:
        n = np.bincount(w[w != _END], minlength=len(words.names))
        at = np.flatnonzero(n)
        names = pa.array([words.names[i] for i in at.tolist()], pa.binary()).cast(pa.string())
        return pa.RecordBatch.from_pydict(
            {"lang": pa.array([lang] * len(at), pa.string()), "w1": names, "h": pa.array(by_word[at].view(np.int64)), "n": pa.array(n[at])}
        )
    known = _in(filters[0], by_word)
    known[_END] = False
    word = by_word[w]
    # places where a window of 1, 2, ... words is frequent, as far as the bitmaps tell
    oks, h = [known[w]], word
    for size in range(2, len(filters) + 2):
        if size > min(length, ROUNDS):
            break
        shorter = oks[-1]
        ok = shorter[:-1] & shorter[1:]
        with np.errstate(over="ignore"):
            h = _mix(h[: len(ok)] * np.uint64(0xD1B54A32D192ED03) + word[size - 1 : size - 1 + len(ok)])
        if size > len(filters):
            value, n = np.unique(h[ok], return_counts=True)
            return pa.RecordBatch.from_pydict({"h": pa.array(value.view(np.int64)), "n": pa.array(n)})
        ok[ok] = _in(filters[size - 1], h[ok])
        oks.append(ok)
    start = np.flatnonzero(oks[1])
    # words after the first that a window has: each size known, and then as far as the longest known goes on
    more = np.ones(len(start), dtype=np.int64)
    if len(oks) > 2:
        more += _runs(np.append(oks[2], np.zeros(len(oks[1]) - len(oks[2]), dtype=bool)), length - 2)[start]
    cols = [w[start]] + [np.where(more >= i, w[np.minimum(start + i, len(w) - 1)], 0) for i in range(1, length)]
    order = np.lexsort(cols[::-1])
    cols = [c[order] for c in cols]
    new = np.zeros(len(start), dtype=bool)
    new[:1] = True
    for c in cols:
        new[1:] |= c[1:] != c[:-1]
    first = np.flatnonzero(new)
    n = np.diff(np.append(first, len(start)))
    used, place = np.unique(np.stack([c[first] for c in cols]), return_inverse=True)
    names = pa.array([None if i == 0 else words.names[i] for i in used.tolist()], pa.binary()).cast(pa.string())
    place = place.reshape(length, -1)
    return pa.RecordBatch.from_pydict(
        {"lang": pa.array([lang] * len(first), pa.string()), **{c: names.take(pa.array(place[i])) for i, c in enumerate(_columns(length))}, "n": pa.array(n)}
    )


def _schema(length: int, rounds: int) -> str:
    if not rounds:
        return "lang string, w1 string, h long, n long"
    if rounds < min(length, ROUNDS):
        return "h long, n long"
    return "lang string, " + "".join(f"{c} string, " for c in _columns(length)) + "n long"


def windows(docs: DataFrame, length: int, filters: list[Broadcast]) -> DataFrame:
    """Counts of the windows of every word and the ``length`` - 1 words after it, in parts to be summed.

    The words that follow are read from the piece itself, so no word is shuffled to meet its neighbours. ``filters`` are
    bitmaps of the frequent windows of 1, 2, ... words. Without any, the words are returned with their hashes; with fewer
    than ``ROUNDS``, the hashes of windows one word longer; then the windows that begin with a frequent pair, with nulls
    from the first word on that makes a rare pair or triple.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, bits = _Words(), [f.value for f in filters]
        waiting: dict[str, list[str]] = {}
        found: dict[str, list[np.ndarray]] = {}
        size = held = 0

        def numbered() -> None:
            nonlocal size, held
            for lang, texts in waiting.items():
                found.setdefault(lang, []).append(_numbers(texts, words))
                held += len(found[lang][-1])
            waiting.clear()
            size = 0

        def counted() -> Iterator[pa.RecordBatch]:
            nonlocal words, held
            for lang in list(found):
                yield _count(lang, np.concatenate(found.pop(lang)), words, length, bits)
            held = 0
            if len(words) > KEPT_WORDS:
                words = _Words()

        for batch in batches:
            for lang, text in zip(*(c.to_pylist() for c in batch.columns)):
                if size and size + len(text) > CHUNK_BYTES:
                    numbered()
                    if held > GATHERED_WORDS or len(words) > KEPT_WORDS:
                        yield from counted()
                waiting.setdefault(lang, []).append(text)
                size += len(text)
        numbered()
        yield from counted()

    texts = docs.where("text is not null").select(F.coalesce("lang", F.lit(NO_LANGUAGE)).alias("lang"), "text")
    return texts.mapInArrow(run, _schema(length, len(filters)))


def bitmap(hashes: DataFrame) -> Broadcast:
    """The column ``h`` as a bitmap of two to the power of ``FILTER_BITS`` bits, put together by the tasks."""
    at = F.col("h").bitwiseAND((1 << FILTER_BITS) - 1)
    bit = F.expr("shiftleft(1L, cast(at & 63 AS int))")
    rows = hashes.select(at.alias("at")).groupBy(F.shiftright("at", 6).alias("block")).agg(F.bit_or(bit).alias("bits")).toPandas()
    bits = np.zeros(1 << (FILTER_BITS - 6), dtype=np.uint64)
    bits[rows["block"].to_numpy(dtype=np.int64)] = rows["bits"].to_numpy(dtype=np.int64).view(np.uint64)
    return hashes.sparkSession.sparkContext.broadcast(bits)


def prefix_counts(counted: DataFrame, length: int, min_count: int) -> DataFrame:
    """(lang, phrase, size, f): sums over all prefixes of the windows in ``counted`` (lang, w1.., n) with f >= ``min_count``."""
    cols = _columns(length)
    # bits of the grouping id are set for columns that are summed over, the last ones first
    size = (length - F.bit_count(F.grouping_id())).cast("int")
    sums = counted.rollup("lang", *cols).agg(F.sum("n").alias("f"), size.alias("size"))
    phrase = F.concat_ws(" ", *cols)
    whole = F.size(F.array_compact(F.array(*cols))) == F.col("size")  # else the prefix ends in padding
    return sums.where((F.col("f") >= min_count) & (F.col("size") > 0) & whole).select("lang", phrase.alias("phrase"), "size", "f")


def phrase_counts(docs: DataFrame, max_words: int, min_count: int) -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, size, f) of all phrases of up to ``max_words`` words with f >= ``min_count``, and (lang, n)."""
    words = stored(windows(docs, 1, []).groupBy("lang", "w1").agg(F.sum("n").alias("n"), F.max("h").alias("h")))
    totals = words.groupBy("lang").agg(F.sum("n").alias("n"))
    often = words.where(F.col("n") >= min_count)
    one = often.select("lang", F.col("w1").alias("phrase"), F.lit(1).alias("size"), F.col("n").alias("f"))
    if max_words < 2:
        return one, totals
    filters = [bitmap(often)]
    while len(filters) < min(max_words, ROUNDS):
        known = windows(docs, max_words, filters).groupBy("h").agg(F.sum("n").alias("n"))
        filters.append(bitmap(known.where(F.col("n") >= min_count)))
    counted = windows(docs, max_words, filters).groupBy("lang", *_columns(max_words)).agg(F.sum("n").alias("n"))
    longer = prefix_counts(counted, max_words, min_count).where("size > 1")
    return one.unionByName(longer), totals


def exact_score() -> Column:
    """floor(1000 a n / (l r)) of the columns a, n, l, r as a long; with 17 digits each, no product passes 38."""
    wide = {c: f"cast({c} AS decimal(17,0))" for c in "anlr"}
    return F.expr("(1000BD * {a} * {n}) div ({l} * {r})".format(**wide))


def collocations(docs: DataFrame, max_words: int = 5, min_count: int = 100, cover: int = 100, top: int = 2000) -> DataFrame:
    """The ``top`` phrases of 2 to ``max_words`` words of each language: lang, rank, phrase, a, l, r, n, score.

    ``docs`` has text and lang; null texts are empty, a null lang is ``und``, other columns are not read, repeated rows
    count as often as they are there. A phrase of a >= ``min_count`` occurrences is cut into a first part with l and a
    rest with r occurrences; its score is floor(1000 a n / (l r)) at the lowest-scoring cut, the first on ties, n being
    all word occurrences of the language. Phrases inside a longer one with at least ``cover`` percent of their
    occurrences are left out. Ties in score go to the larger a, then to the phrase's bytes. Sums and products are exact.
    """
    counts, totals = phrase_counts(docs, max_words, min_count)
    counts = stable(counts)
    known = broadcast_within(counts.select("lang", "phrase", "f"))
    words = F.split("phrase", " ")
    phrases = counts.where("size > 1").select("lang", "phrase", "size", F.col("f").alias("a"), words.alias("w"))

    cuts = phrases.select("*", F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k")).select(
        "lang", "phrase", "a", "k",
        F.array_join(F.slice("w", F.lit(1), F.col("k")), " ").alias("left"),
        F.array_join(F.slice("w", F.col("k") + 1, F.col("size") - F.col("k")), " ").alias("right"),
    )
    cuts = cuts.join(known.withColumnsRenamed({"phrase": "left", "f": "l"}), ["lang", "left"])
    cuts = cuts.join(known.withColumnsRenamed({"phrase": "right", "f": "r"}), ["lang", "right"])
    cuts = cuts.join(broadcast_within(totals), "lang")
    worst = F.min(F.struct(exact_score().alias("score"), "k", "l", "r", "n")).alias("cut")
    scored = cuts.groupBy("lang", "phrase", "a").agg(worst)

    span = F.explode(F.sequence(F.lit(2), F.col("size") - 1)).alias("m")
    inside = phrases.where("size > 2").select("lang", "w", "size", "a", span)
    inside = inside.select("lang", "w", "a", "m", F.explode(F.expr("sequence(1, size - m + 1)")).alias("at"))
    inside = inside.select("lang", F.array_join(F.slice("w", F.col("at"), F.col("m")), " ").alias("phrase"), "a")
    inside = inside.groupBy("lang", "phrase").agg(F.max("a").alias("most"))
    left = scored.join(inside, ["lang", "phrase"], "left").where(F.expr(f"most is null or 100 * most < {int(cover)} * a"))

    order = Window.partitionBy("lang").orderBy(F.desc("cut.score"), F.desc("a"), "phrase")
    ranked = left.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "cut.l", "cut.r", "cut.n", "cut.score")
