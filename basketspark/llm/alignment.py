"""Tokens of two vocabularies laid over one text, in groups that end where tokens of both end.

Texts are cut into units, a space or line end with what follows it or the marks after a word, at which neither
vocabulary has a token across.
A unit's groups don't depend on its neighbours, so each task aligns a unit once and looks it up from then on. Within
units, the character offsets of one tokenizer and the byte spans of the other give coarse cuts; where tokens end inside
a character (byte tokens of both kinds) the bytes of the decoded tokens refine them.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketspark.functions import stored

TOKENIZERS = "/opt/tokenizers"
BYTE_BPE, PIECE_BPE = "byte_bpe_50k.json", "piece_bpe_32k.model"

CHUNK_CHARS = 4_000_000  # texts handled at a time, longer ones alone
KEPT_UNITS = 600_000  # units that a task remembers before it starts anew
WIDE_GROUP = 4096  # links; above, equal ids of a group are counted before they are paired
HOT_PAIRS = 200_000  # at most so many pairs' counts are broadcast

_SHIFT = 20  # a pair is one number: the first id, shifted, and the second
_DOC_BITS = 26  # a chunk has fewer texts than two to the power of this
_STARTER = " a"  # stands before the units, so that none of them is the first of the text
_SPACED = re.compile(r"\s[ \n]")
_LETTER, _MARKS = r"[^\W\d_²]", ",.;:!?"  # no piece has a mark right after a letter
_UNITS = re.compile(rf"[ \n]{_LETTER}+(?=[{_MARKS}]*(?:[ \n]|\Z))|[{_MARKS}]+|[ \n][^ \n]+")
_STARTS = re.compile(r"(?<!\s)[ \n]")

_SCHEMA = (
    "chunk long, at int, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, "
    "pair long, n_docs long, docs array<int>, links array<long>"
)


def byte_alphabet() -> dict[str, int]:
    """The characters that stand for bytes in a byte-level vocabulary: printable ones for themselves, then from U+0100."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


def _flat(parts: list[bytes]) -> np.ndarray:
    return np.array([len(p) for p in parts], dtype=np.int64)


class Vocabularies:
    """Both tokenizers with the bytes of every token, built from the contents of their files."""

    def __init__(self, byte_bpe: bytes, piece_bpe: bytes) -> None:
        import sentencepiece
        import tokenizers

        self.first = tokenizers.Tokenizer.from_str(byte_bpe.decode())
        self.first.encode_special_tokens = True
        alphabet = byte_alphabet()
        names = {i: t for t, i in self.first.get_vocab(with_added_tokens=False).items()}
        self.first_bytes = [
            bytes(alphabet[c] for c in names[i]) if i in names and all(c in alphabet for c in names[i]) else b""
            for i in range(max(names) + 1)
        ]
        self.second = sentencepiece.SentencePieceProcessor(model_proto=piece_bpe)
        pieces = [self.second.id_to_piece(i) for i in range(self.second.vocab_size())]
        self.second_bytes = [
            bytes([int(p[3:5], 16)]) if self.second.is_byte(i) else b"" if self.second.is_control(i) or self.second.is_unknown(i)
            else p.replace("▁", " ").encode()
            for i, p in enumerate(pieces)
        ]
        self.first_sizes, self.second_sizes = _flat(self.first_bytes), _flat(self.second_bytes)
        across = re.compile(rf"{_LETTER}[{_MARKS}]|\n|[^▁]▁")
        if any(across.search(p) for p in pieces):
            raise ValueError("units begin with a space, a line end or a mark after a letter, and a piece of this vocabulary goes on across one")

    def first_tokens(self, text: str, raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids, coarse byte ends from the character offsets, and whether the token ends between characters."""
        found = self.first.encode(text, add_special_tokens=False)
        spans = np.fromiter(chain.from_iterable(found.offsets), dtype=np.int64).reshape(-1, 2)
        starts = np.flatnonzero((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)
        place = np.append(starts, len(raw)) if len(starts) < len(raw) else np.arange(len(raw) + 1)
        clean = np.append(spans[1:, 0] >= spans[:-1, 1], True)[: len(spans)]
        return np.array(found.ids, dtype=np.int64), place[spans[:, 1]], clean

    def second_tokens(self, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The same from the spans, which are bytes of the text without the space that the model puts before it."""
        pieces = self.second.encode(text[1:], return_type="proto", num_threads=1).pieces
        ids = np.fromiter([p.id for p in pieces], dtype=np.int64, count=len(pieces))
        ends = np.fromiter([p.end for p in pieces], dtype=np.int64, count=len(pieces))
        # spans follow one another: one that ends where the one before does is empty
        return ids, ends + 1, np.diff(ends, prepend=0) > 0

    def joined(self, first: list[int], second: list[int]) -> tuple[bytes, bytes]:
        return b"".join(map(self.first_bytes.__getitem__, first)), b"".join(map(self.second_bytes.__getitem__, second))


def common_ends(
    a: tuple[np.ndarray, np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray, np.ndarray], a_sizes: np.ndarray, b_sizes: np.ndarray
) -> np.ndarray:
    """Byte offsets where tokens of both end: the coarse cuts, and those found by decoded bytes between them."""
    size = int(a_sizes.sum()) + 1
    coarse = _both(a[1][a[2]], b[1][b[2]], size)
    # the first kind's coarse end is at or after the true one; the second kind's, an empty span, lies before it
    spots = np.concatenate([a[1][~a[2]], b[1][~b[2]] + 1])
    if not len(spots):
        return coarse
    # segments between coarse cuts that hold a token ending inside a character
    open_ = np.zeros(len(coarse) + 1, dtype=bool)
    open_[np.searchsorted(coarse, spots)] = True
    ends = [e[open_[np.searchsorted(coarse, e)]] for e in (np.cumsum(a_sizes), np.cumsum(b_sizes))]
    return np.union1d(coarse, _both(*ends, size))


def _both(a: np.ndarray, b: np.ndarray, size: int) -> np.ndarray:
    """Offsets below ``size`` that are in both ascending lists."""
    there = np.zeros(size, dtype=bool)
    there[a] = True
    return b[there[b]]


def _pairs(a: np.ndarray, b: np.ndarray, a_cut: np.ndarray, b_cut: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(group, pair, links) for all groups; ``a_cut`` and ``b_cut`` hold where each group's tokens begin, and the end."""
    na, nb = np.diff(a_cut), np.diff(b_cut)
    links = na * nb
    plain = np.flatnonzero(links <= WIDE_GROUP)
    n = links[plain]
    group = np.repeat(plain, n)
    at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    left = a[a_cut[group] + at // nb[group]]
    right = b[b_cut[group] + at % nb[group]]
    out = [(group, left << _SHIFT | right, np.ones(len(group), dtype=np.int64))]
    for g in np.flatnonzero(links > WIDE_GROUP):
        x, nx = np.unique(a[a_cut[g] : a_cut[g + 1]], return_counts=True)
        y, ny = np.unique(b[b_cut[g] : b_cut[g + 1]], return_counts=True)
        out.append((np.full(len(x) * len(y), g), (x[:, None] << _SHIFT | y[None]).ravel(), (nx[:, None] * ny[None]).ravel()))
    return tuple(np.concatenate(c) for c in zip(*out))


class Units:
    """Alignments of the units met so far: counts, link pairs, and the groups as text."""

    def __init__(self, vocabularies: Vocabularies) -> None:
        self.v = vocabularies
        self.names = list(map(str, range(max(len(vocabularies.first_bytes), len(vocabularies.second_bytes)))))
        self.clear()

    def clear(self) -> None:
        self.place: dict[str, int] = {}
        self.texts: list[str] = []
        self.odd: set[int] = set()  # units whose tokens don't spell them
        self.counts: list[np.ndarray] = []  # rows of n_a, n_b, n_groups, n_links
        self.pairs: list[np.ndarray] = []
        self.links: list[np.ndarray] = []
        self.sizes: list[np.ndarray] = []  # pairs of each unit

    def flat(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        for name in ("counts", "pairs", "links", "sizes"):
            parts = getattr(self, name)
            if len(parts) > 1:
                setattr(self, name, [np.concatenate(parts)])
        sizes = self.sizes[0]
        return self.counts[0], self.pairs[0], self.links[0], np.append(0, np.cumsum(sizes))

    def learn(self, units: list[str]) -> None:
        """Align units not met yet, most of them in one text; those that need a letter before them, or end in white space, each in its own."""
        apart = [u for u in units if u[-1].isspace() or u[0] in _MARKS]
        together = [u for u in units if not (u[-1].isspace() or u[0] in _MARKS)]
        if together and not self._add(together):
            apart += together  # some unit has tokens that don't spell it
        for u in apart:
            if not self._add([u]):
                self.odd.add(len(self.place))
                self._record([u], np.zeros((1, 4), np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(1, np.int64), [""])

    def _record(self, units, counts, pairs, links, sizes, texts) -> None:
        self.place.update(zip(units, range(len(self.place), len(self.place) + len(units))))
        self.texts += texts
        self.counts.append(counts)
        self.pairs.append(pairs)
        self.links.append(links)
        self.sizes.append(sizes)

    def _add(self, units: list[str]) -> bool:
        text = _STARTER + "".join(units)
        raw = text.encode()
        a, b = self.v.first_tokens(text, raw), self.v.second_tokens(text)
        a_ids, b_ids = a[0].tolist(), b[0].tolist()
        if self.v.joined(a_ids, b_ids) != (raw, raw):
            return False
        a_sizes, b_sizes = self.v.first_sizes[a[0]], self.v.second_sizes[b[0]]
        cuts = common_ends(a, b, a_sizes, b_sizes)
        sizes = [len(u) for u in units] if len(text) == len(raw) else [len(u.encode()) for u in units]
        ends = np.cumsum([len(_STARTER), *sizes])
        if (cuts[np.minimum(np.searchsorted(cuts, ends), len(cuts) - 1)] != ends).any():
            return False
        a_cut = np.searchsorted(np.cumsum(a_sizes), cuts) + 1
        b_cut = np.searchsorted(np.cumsum(b_sizes), cuts) + 1
        first = int(np.searchsorted(cuts, len(_STARTER)))  # the starter's groups come before
        cuts, a_cut, b_cut = cuts[first:], a_cut[first:], b_cut[first:]
        group, pair, links = _pairs(a[0], b[0], a_cut, b_cut)
        unit_of_group = np.searchsorted(ends, cuts[1:]) - 1
        # equal pairs of a unit as one row
        order = np.lexsort((pair, unit_of_group[group]))
        unit, pair, links = unit_of_group[group][order], pair[order], links[order]
        new = np.append(True, (unit[1:] != unit[:-1]) | (pair[1:] != pair[:-1]))
        links = np.add.reduceat(links, np.flatnonzero(new))
        unit, pair = unit[new], pair[new]
        n = len(units)
        last = np.searchsorted(unit_of_group, np.arange(n + 1))
        counts = np.stack(
            [np.diff(a_cut[last]), np.diff(b_cut[last]), np.diff(last), np.bincount(unit, links, n).astype(np.int64)], axis=1
        )
        ta, tb = list(map(self.names.__getitem__, a_ids)), list(map(self.names.__getitem__, b_ids))
        ia, ib = a_cut.tolist(), b_cut.tolist()
        # most groups have one token of each
        groups = [
            f"{ta[i]}|{tb[j]}" if k == i + 1 and m == j + 1 else f"{','.join(ta[i:k])}|{','.join(tb[j:m])}"
            for i, k, j, m in zip(ia, ia[1:], ib, ib[1:])
        ]
        at = last.tolist()
        texts = [";".join(groups[i:j]) for i, j in zip(at, at[1:])]
        self._record(units, counts, pair, links, np.bincount(unit, minlength=n), texts)
        return True


def units_of(text: str) -> list[str]:
    """Cut ``text``, which begins with a space, before spaces and line ends that follow no white space, and before the
    marks that end a word of letters."""
    if not _SPACED.search(text) and text[-1] not in " \n":
        return _UNITS.findall(text)
    starts = [m.start() for m in _STARTS.finditer(text)]
    return [text[i:j] for i, j in zip(starts, [*starts[1:], None])]


def _align(texts: list[str | None], ids: list, chunk: int, memory: Units) -> Iterator[pa.RecordBatch]:
    """A row for each text, and a row for each pair of the chunk with the texts that link it."""
    lists = [units_of(" " + t) if t else [] for t in texts]
    if len(memory.place) > KEPT_UNITS:
        memory.clear()
    new = list(set().union(*lists) - memory.place.keys())
    for s in range(0, len(new), 20_000):
        memory.learn(new[s : s + 20_000])
    n = len(texts)
    place, told_of = memory.place.__getitem__, memory.texts.__getitem__
    numbers = [list(map(place, units)) for units in lists]
    told = [bool(x) for x in numbers]
    if memory.odd:
        told = [bool(x) and memory.odd.isdisjoint(x) for x in numbers]
    sha = [hashlib.sha256(";".join(map(told_of, x)).encode()).hexdigest() if ok else "" for x, ok in zip(numbers, told)]
    doc = np.repeat(np.arange(n), [len(x) if ok else 0 for x, ok in zip(numbers, told)])
    totals = np.zeros((n, 4), dtype=np.int64)
    rows = None
    if len(doc):
        unit = np.fromiter(chain.from_iterable(x for x, ok in zip(numbers, told) if ok), dtype=np.int64, count=len(doc))
        counts, pairs, links, starts = memory.flat()
        for c in range(4):
            totals[:, c] = np.bincount(doc, counts[unit, c], n).astype(np.int64)
        # each unit of a text once, with how often it is there
        key, times = np.unique(doc << 32 | unit, return_counts=True)
        doc, unit = key >> 32, key & 0xFFFFFFFF
        size = starts[unit + 1] - starts[unit]
        at = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(starts[unit], size)
        pair, weight, doc = pairs[at], links[at] * np.repeat(times, size), np.repeat(doc, size)
        key = pair << _DOC_BITS | doc
        order = np.argsort(key)
        key = key[order]
        begin = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        weight = np.add.reduceat(weight[order], begin)
        pair, doc = key[begin] >> _DOC_BITS, key[begin] & ((1 << _DOC_BITS) - 1)
        first = np.flatnonzero(np.append(True, pair[1:] != pair[:-1]))
        rows = pair[first], first, doc, weight
    yield pa.RecordBatch.from_pydict(
        {
            "chunk": pa.array([chunk] * n, pa.int64()), "at": pa.array(range(n), pa.int32()), "doc_id": pa.array(ids, pa.int64()),
            **{c: pa.array(totals[:, i]) for i, c in enumerate(("n_a", "n_b", "n_groups", "n_links"))},
            "groups_sha256": pa.array(sha, pa.string()), "pair": pa.nulls(n, pa.int64()), "n_docs": pa.nulls(n, pa.int64()),
            "docs": pa.nulls(n, pa.list_(pa.int32())), "links": pa.nulls(n, pa.list_(pa.int64())),
        }
    )
    if rows is None:
        return
    pair, first, doc, weight = rows
    ends = np.append(first, len(doc))
    for s in range(0, len(pair), 200_000):
        e = min(s + 200_000, len(pair))
        m = e - s
        offsets = (ends[s : e + 1] - ends[s]).astype(np.int32)
        part = slice(ends[s], ends[e])

        def lists_of(values: np.ndarray, kind: type) -> pa.Array:
            return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values[part].astype(kind)))

        yield pa.RecordBatch.from_pydict(
            {
                "chunk": pa.array(np.full(m, chunk)), "at": pa.nulls(m, pa.int32()), "doc_id": pa.nulls(m, pa.int64()),
                **{c: pa.nulls(m, pa.int64()) for c in ("n_a", "n_b", "n_groups", "n_links")},
                "groups_sha256": pa.nulls(m, pa.string()), "pair": pa.array(pair[s:e]), "n_docs": pa.array(np.diff(ends[s : e + 1])),
                "docs": lists_of(doc, np.int32), "links": lists_of(weight, np.int64),
            }
        )


def aligned(docs: DataFrame, folder: str = TOKENIZERS) -> DataFrame:
    """The stored table of :func:`_align`: rows with ``at`` are texts, rows with ``pair`` are links of a chunk's texts."""
    contents = []
    for name in (BYTE_BPE, PIECE_BPE):
        with open(f"{folder}/{name}", "rb") as f:
            contents.append(f.read())
    shared = docs.sparkSession.sparkContext.broadcast(contents)  # both files, about two megabytes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory = None
        texts, ids, start, size = [], [], None, 0
        for batch in batches:
            for row, doc_id, text in zip(*(c.to_pylist() for c in batch.columns)):
                length = len(text or "")
                if texts and (size + length > CHUNK_CHARS or len(texts) + 1 >= 1 << _DOC_BITS):
                    memory = memory or Units(Vocabularies(*shared.value))
                    yield from _align(texts, ids, start, memory)
                    texts, ids, size = [], [], 0
                if not texts:
                    start = row
                texts.append(text)
                ids.append(doc_id)
                size += length
        if texts:
            yield from _align(texts, ids, start, memory or Units(Vocabularies(*shared.value)))

    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    return stored(rows.mapInArrow(run, _SCHEMA))


def pair_counts(table: DataFrame) -> DataFrame:
    """(pair, a, b, n, best): in how many documents a pair is linked, and whether no other pair of its first id is in more."""
    n = stored(table.where("pair is not null").groupBy("pair").agg(F.sum("n_docs").alias("n")))
    n = n.withColumns({"a": F.shiftright("pair", _SHIFT), "b": F.col("pair").bitwiseAND((1 << _SHIFT) - 1)})
    # one row for each id of the first vocabulary
    most = n.groupBy("a").agg(F.max("n").alias("most"))
    return n.join(F.broadcast(most), "a").select("pair", "a", "b", "n", (F.col("n") == F.col("most")).alias("best"))


def align_tokens(docs: DataFrame, folder: str = TOKENIZERS) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256 of every document.

    ``docs`` has doc_id and text; other columns are not read, repeated rows and ids stay and count as documents of their
    own. Texts that are null or empty, or whose tokens' joined bytes are not a space and the text, have no tokens: zeros
    and an empty digest. ``n_best`` counts the links whose pair is linked in as many documents as any pair of its first
    id, ``count_sum`` adds the documents of each link's pair.

    Pairs are counted over chunks of documents first. Counts of frequent pairs, whose number is bounded by the sum of all
    counts, are broadcast; only the rare pairs' rows are shuffled to theirs.
    """
    table = aligned(docs, folder)
    counts = stored(pair_counts(table))
    total = counts.agg(F.sum("n")).first()[0] or 0
    limit = max(1, total // HOT_PAIRS)  # fewer than total / limit pairs can be above it
    linked = table.where("pair is not null").select("pair", "chunk", "docs", "links")
    hot = F.broadcast(counts.where(F.col("n") > limit).select("pair", "n", "best"))
    cold = counts.where(F.col("n") <= limit).select("pair", "n", "best")
    known = linked.join(hot, "pair").unionByName(linked.join(hot, "pair", "left_anti").join(cold, "pair"))
    each = known.select("chunk", "n", "best", F.explode(F.arrays_zip("docs", "links")).alias("d"))
    sums = each.groupBy("chunk", F.col("d.docs").alias("at")).agg(
        F.sum(F.when(F.col("best"), F.col("d.links")).otherwise(0)).cast("long").alias("n_best"),
        F.sum(F.col("n") * F.col("d.links")).alias("count_sum"),
    )
    texts = table.where("at is not null").drop("pair", "n_docs", "docs", "links").join(sums, ["chunk", "at"], "left")
    zero = [F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("n_best", "count_sum")]
    return texts.select("doc_id", "n_a", "n_b", "n_groups", "n_links", *zero, "groups_sha256")
