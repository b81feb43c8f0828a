"""Quality classifier: logistic regression on hashed word n-grams, trained by FTRL-proximal updates."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import stable
from .tables import broadcast_if_small
from .words import Splitter, Words, mix, odd_numbers

SLOTS = 1 << 18
TRAIN_ROWS = 20_000
EPOCHS = 20
UPDATES = 80_000
PARTS = 4
ALPHA, BETA, L1, L2 = 0.5, 1.0, 0.01, 1e-4


def text_features(words: Words, i: int, slot: np.ndarray, pair: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Slots and values of one text: logs of word and word-pair counts at length one, and a constant in slot 0."""
    a, b = words.first[i], words.first[i + 1]
    own, n = np.unique(np.concatenate((slot[a:b], pair[a : max(a, b - 1)])), return_counts=True)
    value = np.log1p(n)
    if len(value):
        value /= np.sqrt((value * value).sum())
    return np.concatenate(([0], own)), np.concatenate(([1.0], value))


def hashed(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Slots of each word of a slice and of the pair it opens; pairs across texts are never used.

    A word that comes again next, or next but one, opens the pair "same": stuttering texts share it.
    """
    f = odd_numbers(2, 37)
    nxt, after = (np.append(words.hash[k:], np.zeros(min(k, len(words.hash)), np.uint64)) for k in (1, 2))
    both = mix(words.hash * f[0] + nxt * f[1])
    both[(words.hash == nxt) | (words.hash == after)] = f[0]
    return tuple((x % np.uint64(SLOTS - 1)).astype(np.int64) + 1 for x in (words.hash, both))


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    split = Splitter("both", fold=False)
    for batch in batches:
        for w in split.slices(batch.column(1)):
            both = hashed(w)
            rows = [text_features(w, i, *both) for i in range(len(w.rows))]
            key = [batch.column(k).slice(w.rows.start, len(w.rows)) for k in (0, 2)]
            idx = pa.array([x.astype(np.int32) for x, _ in rows], pa.list_(pa.int32()))
            val = pa.array([v.astype(np.float32) for _, v in rows], pa.list_(pa.float32()))
            yield pa.RecordBatch.from_arrays([*key, idx, val], names=["k", "label", "idx", "val"])


def weights(z: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The weights a state stands for: zero where the gradients so far don't outweigh L1."""
    return np.where(np.abs(z) <= L1, 0.0, -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2))


def _epoch(z0: np.ndarray, n0: np.ndarray):
    def run(part: pd.DataFrame) -> pd.DataFrame:
        z, n = z0.copy(), n0.copy()
        for idx, val, y in part.sort_values("k")[["idx", "val", "label"]].itertuples(index=False):
            w = weights(z[idx], n[idx])
            p = 1 / (1 + np.exp(-np.clip(w @ val, -35, 35)))
            g = (p - y) * val
            sigma = (np.sqrt(n[idx] + g * g) - np.sqrt(n[idx])) / ALPHA
            z[idx] += g - sigma * w
            n[idx] += g * g
        at = np.flatnonzero((z != z0) | (n != n0))
        return pd.DataFrame({"slot": at, "z": z[at] - z0[at], "n": n[at] - n0[at]})

    return run


def learn_quality(
    docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS, epochs: int = EPOCHS,
    id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
) -> np.ndarray:
    """Weights per slot from about ``train_rows`` of the labelled rows, chosen by a hash of the id, whole texts.

    Epochs go on to about ``UPDATES`` row updates, ``epochs`` at most. Each passes over ``PARTS`` parts of the sample independently, from the averaged state of the last one;
    the driver sees the states' sums, at most ``SLOTS`` rows. Labels that are null count as none.
    """
    named = labels.select(F.col(id_col).cast("long").alias("k"), F.col(label_col).cast("int").alias("label"))
    named = named.where("k IS NOT NULL AND label IN (0, 1)").dropDuplicates(["k"])
    share = train_rows / max(train_rows, named.count())
    draw = F.pmod(F.xxhash64("k", F.lit(41)), F.lit(1 << 20)) / float(1 << 20)
    rows = docs.select(F.col(id_col).cast("long").alias("k"), F.col(text_col).alias("text"))
    rows = rows.join(broadcast_if_small(named.where(draw < share)), "k").select("k", "text", "label")
    data = rows.mapInArrow(_features, "k long, label int, idx array<int>, val array<float>")
    data = stable(data.withColumn("part", F.pmod(F.xxhash64("k", F.lit(43)), F.lit(PARTS))))
    z, n = np.zeros(SLOTS), np.zeros(SLOTS)
    for _ in range(min(epochs, -(-UPDATES // max(1, data.count())))):
        moves = data.groupBy("part").applyInPandas(_epoch(z, n), "slot long, z double, n double")
        z, n = z.copy(), n.copy()
        for r in moves.groupBy("slot").agg(F.sum("z").alias("z"), F.sum("n").alias("n")).collect():
            z[r["slot"]] += r["z"] / PARTS
            n[r["slot"]] += r["n"] / PARTS
    return weights(z, n)


def _score(w: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split = Splitter("both", fold=False)
        for batch in batches:
            out = np.empty(batch.num_rows)
            for s in split.slices(batch.column(1)):
                both = hashed(s)
                for i, row in enumerate(s.rows):
                    idx, val = text_features(s, i, *both)
                    out[row] = w[idx] @ val
            cols = [batch.column(0), pa.array(1 / (1 + np.exp(-np.clip(out, -35, 35))))]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "score"])

    return run


def score_quality(docs: DataFrame, w: np.ndarray, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score, predicted) per row of ``docs``; ``score`` is the probability of label 1.

    A null or empty text has the constant alone. Repeated rows get the same score, null ids are carried, other
    columns are ignored.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    scored = rows.mapInArrow(_score(w), "doc_id long, score double")
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
