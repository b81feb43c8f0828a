"""Near-duplicate documents by b-bit MinHash.

Two documents are linked if ``100 * |A & B| >= percent * |A | B|`` for their sets of five-word shingles. Steps:

1. One pass over the text makes, per document, the size and a 128-bit fingerprint of its set, the minima of 128
   hash functions, 25 band keys of 5 minima each, and a signature of the low 2 bits of all minima (32 bytes).
   Equal fingerprints are one class: copies never meet each other again.
2. Classes sharing a band key are candidates. Only keys with two classes or more are followed; buckets beyond
   ``BLOCK`` members are cut into blocks and every pair of blocks is one unit of work.
3. Inside a unit the similarity of all pairs is estimated from equal 2-bit fields, counted with bit operations and
   corrected for chance. Pairs at ``percent / 100 - MARGIN`` or more join a candidate group; a spanning forest
   of them leaves the task, never the pairs.
4. Candidate groups (connected components of the forests) get the texts of their classes, blocks of them if a
   group is large. Inside a unit, links are confirmed on full sets; a pair whose ends are connected already is
   skipped. Again a forest leaves the task, and its components are the result.

A pair at exactly 0.85 shares no band with probability 7e-7 and is estimated below the margin with 3e-6; both
fall quickly above. No pair is dropped by a cap. A group whose members all differ costs all its pairs, in blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import stable
from ..operators.graph import connected_components
from .tables import broadcast_if_small
from .words import Splitter, distinct_sets, mix, odd_numbers, shingles

SHINGLE = 5
HASHES, BANDS, ROWS = 128, 25, 5
BITS = 2
MARGIN = 0.17
BLOCK = 1024
BLOCK_BYTES = 16 << 20
CHUNK = 1 << 15

_SIGNED = "doc_id long, n_shingles long, fp_a long, fp_b long, sig binary, bands array<long>"


def minima(values: np.ndarray, bounds: np.ndarray, hashes: int) -> np.ndarray:
    """(texts, hashes) minima of ``hashes`` multiplicative hash functions; texts without values get zeros."""
    out = np.zeros((len(bounds) - 1, hashes), np.uint64)
    full = np.flatnonzero(np.diff(bounds))
    factors = odd_numbers(hashes, 11)
    lo = 0
    while lo < len(full):  # chunks of whole texts that stay in the processor's cache
        hi = max(lo + 1, int(np.searchsorted(bounds[full + 1], bounds[full[lo]] + CHUNK, "right")))
        begin = bounds[full[lo]]
        part, at = values[begin : bounds[full[hi - 1] + 1]], bounds[full[lo:hi]] - begin
        for k in range(hashes):
            out[full[lo:hi], k] = np.minimum.reduceat(part * factors[k], at)
        lo = hi
    return out


def pack(low: np.ndarray) -> np.ndarray:
    """(texts, hashes) values as rows of bytes holding ``BITS`` low bits each, one bit plane after the other."""
    planes = [(low >> np.uint64(b)) & np.uint64(1) for b in range(BITS)]
    return np.packbits(np.concatenate(planes, axis=1).astype(np.uint8), axis=1)


def similarity(one: np.ndarray, many: np.ndarray) -> np.ndarray:
    """Estimated Jaccard similarity of signatures: equal fields by bit count, corrected for equal by chance."""
    differ = np.bitwise_xor(many, one).reshape(len(many), BITS, -1)
    unequal = np.bitwise_or.reduce(differ, axis=1)
    same = 1 - np.bitwise_count(unequal).sum(axis=1) / HASHES
    chance = 0.5**BITS
    return (same - chance) / (1 - chance)


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    split = Splitter()
    for batch in batches:
        ids, texts = batch.column(0), batch.column(1)
        for words in split.slices(texts):
            values, bounds = distinct_sets(*shingles(words, SHINGLE))
            low = mix(minima(values, bounds, HASHES))
            keys = np.zeros((len(low), BANDS), np.uint64)
            factors = odd_numbers(ROWS, 13)
            for b in range(BANDS):
                keys[:, b] = mix((low[:, b * ROWS : (b + 1) * ROWS] * factors).sum(axis=1) + np.uint64(b))
            size = np.diff(bounds)
            prints = []
            for seed in (17, 19):
                total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix(values * odd_numbers(1, seed)[0]))))
                prints.append(mix(total[bounds[1:]] - total[bounds[:-1]] + size.astype(np.uint64)).view(np.int64))
            lists = pa.ListArray.from_arrays(
                pa.array(np.arange(len(low) + 1, dtype=np.int32) * BANDS), pa.array(keys.view(np.int64).ravel())
            )
            sig = pa.array([x.tobytes() for x in pack(low)], pa.binary())
            own = ids.slice(words.rows.start, len(words.rows))
            yield pa.RecordBatch.from_arrays(
                [own, pa.array(size), *map(pa.array, prints), sig, lists],
                names=["doc_id", "n_shingles", "fp_a", "fp_b", "sig", "bands"],
            )


def runs(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """Consecutive rows that agree in the first ``keys`` columns, from batches sorted by them."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(keys)]
        change = np.zeros(batch.num_rows, bool)
        for c in cols:
            change[1:] |= c[1:] != c[:-1]
        change[0] = last is not None and last != tuple(c[0] for c in cols)
        last = tuple(c[-1] for c in cols)
        lo = 0
        for cut in np.flatnonzero(change).tolist():
            if cut > lo:
                held.append(batch.slice(lo, cut - lo))
            yield pa.Table.from_batches(held)
            held, lo = [], cut
        held.append(batch.slice(lo))
    if held:
        yield pa.Table.from_batches(held)


def forest(sig: np.ndarray, least: float, confirm, sides: np.ndarray | None) -> tuple[list[int], list[int]]:
    """Edges joining all rows that are connected by pairs of estimate ``least`` or more which ``confirm`` accepts.

    ``sides`` (0 or 1) restricts to pairs across the two sides. ``confirm(i, others)`` returns a mask or None.
    """
    n = len(sig)
    label = np.arange(n)
    left, right = [], []
    for i in range(n):
        others = np.arange(i + 1, n)
        others = others[label[others] != label[i]]
        if sides is not None:
            others = others[sides[others] != sides[i]]
        if len(others):
            others = others[similarity(sig[i], sig[others]) >= least]
        if len(others) and confirm is not None:
            others = others[confirm(i, others)]
        for j in others.tolist():
            if label[j] != label[i]:
                label[label == label[j]] = label[i]
                left.append(i)
                right.append(j)
    return left, right


def _signatures(column: pa.ChunkedArray) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), -1)


def _edges(ids: np.ndarray, left: list[int], right: list[int]) -> pa.RecordBatch:
    a, b = ids[left] if left else ids[:0], ids[right] if right else ids[:0]
    return pa.RecordBatch.from_arrays(
        [pa.array(np.maximum(a, b), pa.int64()), pa.array(np.minimum(a, b), pa.int64())], names=["u", "v"]
    )


def _sides(unit: pa.Table) -> np.ndarray | None:
    """Which block of its two each row of a unit is in; None in a unit of one block, where all pairs count."""
    hi, lo = unit.column("hi")[0].as_py(), unit.column("lo")[0].as_py()
    return None if hi == lo else unit.column("block").to_numpy() == hi


def _candidates(least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for unit in runs(batches, 3):
            if unit.num_rows > 1:
                sig = _signatures(unit.column("sig"))
                found = forest(sig, least, None, _sides(unit))
                if found[0]:
                    yield _edges(unit.column("doc_id").to_numpy(), *found)

    return run


def _confirmed(percent: int, least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split = Splitter()
        for unit in runs(batches, 3):
            if unit.num_rows < 2:
                continue
            sets: list[np.ndarray] = []
            for words in split.slices(unit.column("text")):
                values, bounds = distinct_sets(*shingles(words, SHINGLE))
                sets += np.split(values, bounds[1:-1])
            size = np.array([len(s) for s in sets])

            def confirm(i: int, others: np.ndarray, sets=sets, size=size) -> np.ndarray:
                own, ok = sets[i], np.zeros(len(others), bool)
                for lo in range(0, len(others), 256):
                    part = others[lo : lo + 256]
                    values = np.concatenate([sets[j] for j in part])
                    place = np.minimum(np.searchsorted(own, values), len(own) - 1)
                    begin = np.concatenate(([0], np.cumsum(size[part])[:-1]))
                    both = np.add.reduceat((own[place] == values).astype(np.int64), begin)
                    ok[lo : lo + 256] = 100 * both >= percent * (size[i] + size[part] - both)
                return ok

            found = forest(_signatures(unit.column("sig")), least, confirm, _sides(unit))
            if found[0]:
                yield _edges(unit.column("doc_id").to_numpy(), *found)

    return run


def _units(members: DataFrame, key: str, blocks) -> DataFrame:
    """One row per member and unit: (key, hi, lo) names a pair of blocks, (key, b, b) a block by itself."""
    own = F.pmod(F.xxhash64("doc_id"), F.col("n_blocks"))
    pairs = F.expr(
        "transform(sequence(0L, n_blocks - 1), x -> named_struct('hi', greatest(x, block), 'lo', least(x, block)))"
    )
    rest = [c for c in members.columns if c not in (key, "doc_id")]
    return (
        members.withColumn("n_blocks", blocks)
        .withColumn("block", own)
        .select(key, "doc_id", "block", *rest, F.explode(pairs).alias("unit"))
        .select(key, "unit.hi", "unit.lo", "doc_id", "block", *rest)
    )


def _in_units(units: DataFrame, key: str, step) -> DataFrame:
    """Deal units to tasks, sorted so that a task holds one unit at a time."""
    dealt = units.repartition(F.col(key), F.col("hi"), F.col("lo")).sortWithinPartitions(key, "hi", "lo", "doc_id")
    return dealt.mapInArrow(step, "u long, v long")


def near_groups(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 85, block: int = BLOCK
) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) per row of ``docs``; ``component_id`` is the smallest id reachable.

    Ids name documents. Null and empty texts have no shingles and no links. A row repeated with its id counts once
    and gets the same result each time; rows with one id and different texts get the id's smallest component. A
    row without an id has links to nothing, a null component, and is kept. Other columns are ignored.
    """
    least = percent / 100 - MARGIN
    text = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    signed = stable(text.mapInArrow(_sign, _SIGNED))
    prints = ["fp_a", "fp_b", "n_shingles"]
    linkable = signed.where("n_shingles > 0 AND doc_id IS NOT NULL")
    classes = linkable.groupBy(*prints).agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("n"))
    classes = stable(classes.where("n > 1").drop("n"))  # as a table of its own the join can split a hot class
    rep = F.coalesce("rep", "doc_id").alias("rep")
    members = stable(linkable.select("doc_id", *prints).join(classes, prints, "left").select("doc_id", rep))
    # one row for each class: that of its smallest id
    reps = stable(
        linkable.join(members.where("doc_id = rep").select("doc_id").distinct(), "doc_id", "left_semi")
        .select("doc_id", "sig", "bands")
        .dropDuplicates(["doc_id", "sig"])
    )
    hits = reps.select("doc_id", F.explode("bands").alias("band"))
    shared = hits.groupBy("band").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    followed = hits.join(shared, "band").join(reps.select("doc_id", "sig"), "doc_id")
    units = _units(followed, "band", F.ceil(F.col("n") / block))
    close = _in_units(units.drop("n"), "band", _candidates(least)).distinct()
    close = stable(close)
    ends = close.select(F.col("u").alias("v")).union(close.select("v")).distinct()
    groups = connected_components(ends, close).select(F.col("v").alias("doc_id"), F.col("root").alias("grp"))
    bodies = (
        text.join(groups, "doc_id")
        .join(reps.select("doc_id", "sig"), "doc_id")
        .select("doc_id", "grp", "sig", "text")
    )
    sizes = groups.join(signed.select("doc_id", "n_shingles"), "doc_id").groupBy("grp")
    sizes = sizes.agg(F.count(F.lit(1)).alias("n"), F.sum("n_shingles").alias("total"))
    bodies = bodies.join(sizes, "grp")
    blocks = F.greatest(F.ceil(F.col("n") / block), F.ceil(F.col("total") * 8 / BLOCK_BYTES))
    units = _units(bodies, "grp", blocks).drop("n", "total")
    links = stable(_in_units(units, "grp", _confirmed(percent, least)).distinct())
    linked = links.select(F.col("u").alias("v")).union(links.select("v")).distinct()
    # a table of its own, so that the join can split a class of very many copies
    roots = stable(connected_components(linked, links).select(F.col("v").alias("rep"), "root"))
    named = members.join(broadcast_if_small(roots), "rep", "left").select("doc_id", F.coalesce("root", "rep").alias("component_id"))
    named = named.groupBy("doc_id").agg(F.min("component_id").alias("component_id"))
    out = signed.select("doc_id", "n_shingles").join(named, "doc_id", "left")
    component = F.coalesce("component_id", "doc_id")
    return out.select(
        "doc_id",
        "n_shingles",
        component.alias("component_id"),
        F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"),
    )
