"""Language identification by unigram pieces, summed over all segmentations.

Each language has a probability for every piece of a fixed public vocabulary (a SentencePiece model whose byte pieces
can spell anything). A word, written with a leading space and in lower case for ASCII letters, has the probability
of all its segmentations together, which a forward pass over its bytes adds up; a text has the product over its
words. Piece probabilities are fitted by expectation-maximisation on the word counts of all labelled documents.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import stable
from .words import Splitter, Words

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
TRAIN_WORD = 1024  # bytes; longer words are scored, but teach nothing
MAX_LANGS = 200
EM_STEPS = 3
DENSE = 12
RESCALE = 16
LONE_WORD = 1024
SMOOTH = 0.01
SCALE = 32.0
UNKNOWN = "und"
COUNTED = 100_000  # different words that a task counts before it passes them on
SLICE = 1 << 20
CACHE_BYTES = 16 << 20


def read_pieces(path: str = VOCABULARY) -> list[bytes]:
    """The vocabulary's pieces as lower-case bytes, single bytes first; none with a space inside, as no word has one."""
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = dict.fromkeys(bytes([b]) for b in range(256))
    for i in range(model.get_piece_size()):
        if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i)):
            piece = model.id_to_piece(i).replace("▁", " ").encode().lower()
            if b" " not in piece[1:]:
                pieces[piece] = None
    return list(pieces)


class Lattice:
    """The pieces at every place of a set of words, and sums over the paths through them."""

    def __init__(self, pieces: list[bytes]):
        self.n = len(pieces)
        self.length = np.array([len(p) for p in pieces] + [1])
        nodes, edges, ends = {b"": 0}, [], [self.n]  # a trie; its edges are found by binary search
        for k, piece in sorted((len(p), p) for p in pieces):
            for i in range(1, k + 1):
                if piece[:i] not in nodes:
                    nodes[piece[:i]] = len(nodes)
                    edges.append((nodes[piece[: i - 1]] * 256 + piece[i - 1], nodes[piece[:i]]))
                    ends.append(self.n)
        for i, piece in enumerate(pieces):
            ends[nodes[piece]] = i
        edges.sort()
        self.edge = np.array([e for e, _ in edges], np.int64)
        self.child = np.array([c for _, c in edges], np.int64)
        self.ends = np.array(ends, np.int64)
        self.longest = int(self.length.max())

    def lay(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> None:
        """Take words (byte ranges of ``data``) of any length, longest first, a space before each.

        Pieces of up to ``DENSE`` bytes are held by the place where they begin, the few longer ones as a list.
        """
        size = end - start + 1
        self.order = np.argsort(-size, kind="stable")
        size, start = size[self.order], start[self.order]
        self.size, self.base = size, np.concatenate(([0], np.cumsum(size + 1)[:-1])).astype(np.int64)  # one state more than bytes
        total = int(size.sum() + len(size))
        self.inside = np.arange(total) - np.repeat(self.base, size + 1)
        self.left = np.repeat(size, size + 1) - self.inside
        text = np.full(total, 32, np.uint8)
        here = np.flatnonzero((self.inside > 0) & (self.left > 0))
        text[here] = data[np.repeat(start, size + 1)[here] + self.inside[here] - 1]
        self.piece = np.full((min(DENSE, self.longest), total), self.n, np.int32)
        wide: list[tuple[np.ndarray, ...]] = []
        at, node = np.flatnonzero(self.left > 0), 0
        for k in range(self.longest):
            key = node * 256 + text[at + k]
            place = np.minimum(np.searchsorted(self.edge, key), len(self.edge) - 1)
            hit = self.edge[place] == key
            at, node = at[hit], self.child[place[hit]]
            ends = self.ends[node]
            if k < len(self.piece):
                self.piece[k, at] = ends
            else:
                there = np.flatnonzero(ends < self.n)
                wide.append((at[there], at[there] + k + 1, ends[there]))
            more = self.left[at] > k + 1
            at, node = at[more], node[more]
            if not len(at):
                break
        none = np.zeros(0, np.int64)
        self.wide = tuple(np.concatenate(c) for c in zip(*wide, strict=True)) if wide else (none, none, none)
        # long pieces by the byte of the word that they end at
        steps = self.inside[self.wide[1]]
        by = np.argsort(steps, kind="stable")
        self.wide = tuple(c[by] for c in self.wide)
        self.wide_at = np.searchsorted(steps[by], np.arange(int(size[0]) + 2 if len(size) else 1))

    def _active(self, t: int) -> np.ndarray:
        return self.base[: np.searchsorted(-self.size, -t, "right")]

    def _rescale(self, values: np.ndarray, states: np.ndarray, scale: np.ndarray, done: np.ndarray) -> None:
        """Divide the states that later ones can reach by their largest value, and note the logarithm."""
        most = values[states].max(axis=1)
        most = np.where(most > 0, most, 1)
        values[states] /= most[:, None]
        done += np.log(most)
        scale[states] = done[:, None]

    def forward(self, prob: np.ndarray, lone: bool = True) -> tuple[np.ndarray, np.ndarray]:
        """States x languages: the probability of all segmentations of what lies before each place, and the logarithm of
        the factor taken out of it. Long words would leave the range of doubles, so the last states are rescaled along
        the way. With ``lone``, words beyond ``LONE_WORD`` bytes are left to :meth:`_alone`."""
        alpha = np.zeros((len(self.left), prob.shape[1]))
        alpha[self.base] = 1
        longest = int(self.size[0]) if len(self.size) else 0
        scale = np.zeros_like(alpha) if longest > 2 * RESCALE else np.zeros((1, 1))
        done = np.zeros((len(self.size), prob.shape[1]))
        first = 0
        if lone:
            first = int(np.searchsorted(-self.size, -LONE_WORD, "left"))
            longest = int(self.size[first]) if first < len(self.size) else 0
        for t in range(1, longest + 1):
            to = self._active(t)[first:] + t
            for k in range(min(len(self.piece), t)):
                ids = self.piece[k, to - k - 1]
                own = np.flatnonzero(ids < self.n)
                alpha[to[own]] += alpha[to[own] - k - 1] * prob[ids[own]]
            lo, hi = self.wide_at[t], self.wide_at[t + 1]
            if hi > lo:
                np.add.at(alpha, self.wide[1][lo:hi], alpha[self.wide[0][lo:hi]] * prob[self.wide[2][lo:hi]])
            if len(scale) > 1:
                now = done[first : first + len(to)]
                scale[to] = now
                if t % RESCALE == 0:
                    back = np.arange(min(t, self.longest) + 1)
                    self._rescale(alpha, to[:, None] - back[None], scale, now)
        for i in range(first):
            self._alone(i, prob, alpha, scale)
        return alpha, scale

    def _alone(self, i: int, prob: np.ndarray, alpha: np.ndarray, scale: np.ndarray) -> None:
        """The forward pass of one long word, byte by byte instead of word beside word."""
        base, size = int(self.base[i]), int(self.size[i])
        here = slice(base, base + size)
        length, at = np.nonzero(self.piece[:, here] < self.n)
        wide = np.flatnonzero((self.wide[0] >= base) & (self.wide[0] < base + size))
        begin = np.concatenate((at, self.wide[0][wide] - base))
        end = np.concatenate((at + length + 1, self.wide[1][wide] - base))
        ids = np.concatenate((self.piece[length, at + base], self.wide[2][wide]))
        by = np.argsort(begin, kind="stable")
        begin, end, ids = begin[by], (end[by] + base).tolist(), ids[by]
        use = prob[ids]
        first = np.searchsorted(begin, np.arange(size + 1)).tolist()
        done = np.zeros(prob.shape[1])
        for t in range(size):
            if t and t % RESCALE == 0:
                ahead = slice(base + t, min(base + t + self.longest, base + size) + 1)
                most = alpha[ahead].max(axis=0)
                most = np.where(most > 0, most, 1)
                alpha[ahead] /= most
                done += np.log(most)
            state = alpha[base + t]
            for j in range(first[t], first[t + 1]):
                alpha[end[j]] += state * use[j]
        scale[base + size] = done

    def words(self, prob: np.ndarray) -> np.ndarray:
        """Words x languages, in the order given to ``lay``: log probabilities."""
        out = np.empty((len(self.size), prob.shape[1]))
        alpha, scale = self.forward(prob)
        last = self.base + self.size
        more = scale[last] if len(scale) > 1 else 0
        out[self.order] = np.log(alpha[last]) + more - self.size[:, None] * np.log(SCALE)
        return out

    def expected(self, prob: np.ndarray, count: np.ndarray) -> np.ndarray:
        """Expected number of uses of each piece in the words, weighted by ``count``; ``prob`` has one language."""
        alpha, up = self.forward(prob, lone=False)
        alpha = alpha[:, 0]
        last = self.base + self.size
        beta = np.zeros((len(alpha), 1))
        beta[last] = 1
        down = np.zeros_like(beta)
        done = np.zeros((len(self.size), 1))
        wide_from = np.argsort(self.left[self.wide[0]], kind="stable")
        begin, end, ids_of = (c[wide_from] for c in self.wide)
        wide_at = np.searchsorted(self.left[begin], np.arange(int(self.size[0]) + 2 if len(self.size) else 1))
        for back in range(1, int(self.size[0]) + 1 if len(self.size) else 0):
            at = self._active(back)
            at = at + self.size[: len(at)] - back
            for k in range(min(len(self.piece), back)):
                ids = self.piece[k, at]
                own = np.flatnonzero(ids < self.n)
                beta[at[own]] += beta[at[own] + k + 1] * prob[ids[own]]
            lo, hi = wide_at[back], wide_at[back + 1]
            if hi > lo:
                np.add.at(beta, begin[lo:hi], beta[end[lo:hi]] * prob[ids_of[lo:hi]])
            if len(up) > 1:
                now = done[: len(at)]
                down[at] = now
                if back % RESCALE == 0:
                    self._rescale(beta, at[:, None] + np.arange(min(back, self.longest) + 1)[None], down, now)
        beta = beta[:, 0]
        # the part that each state's word has in the counts, without the word's probability
        share = np.repeat(count[self.order] / alpha[last], self.size + 1)
        gone = np.repeat(up[last, 0], self.size + 1) if len(up) > 1 else None

        def weight(start: np.ndarray, to: np.ndarray, ids: np.ndarray) -> np.ndarray:
            w = alpha[start] * prob[ids, 0] * beta[to] * share[start]
            return w if gone is None else w * np.exp(up[start, 0] + down[to, 0] - gone[start])

        uses = np.zeros(self.n + 1)
        uses += np.bincount(self.wide[2], weight(*self.wide), self.n + 1).astype(float)
        for k in range(len(self.piece)):
            at = np.flatnonzero(self.piece[k] < self.n)
            ids = self.piece[k, at]
            uses += np.bincount(ids, weight(at, at + k + 1, ids), self.n + 1)
        return uses[: self.n]


def scaled(lattice: Lattice, prob: np.ndarray) -> np.ndarray:
    """Probabilities with a factor per byte, so that products over a word stay in range longer, and a last row of zeros."""
    prob = np.vstack([prob, np.zeros((1, prob.shape[1]))])
    return prob * SCALE ** lattice.length[:, None]


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    split, counts = Splitter("letters"), Counter()

    def out():
        langs, words = zip(*counts, strict=True)
        cols = [pa.array(langs, pa.string()), pa.array(words, pa.binary()), pa.array(counts.values(), pa.int64())]
        counts.clear()
        return pa.RecordBatch.from_arrays(cols, names=["lang", "word", "n"])

    for batch in batches:
        langs = batch.column(0).to_pylist()
        for w in split.slices(batch.column(1)):
            if not len(w.start):
                continue
            # equal words of a language are found by their hashes, so only different ones are looked up
            names = {name: i for i, name in enumerate(dict.fromkeys(langs[r] for r in w.rows))}
            of = np.repeat([names[langs[r]] for r in w.rows], np.diff(w.first))
            order = np.lexsort((w.hash, of))
            new = np.concatenate(([True], np.diff(of[order]) != 0))
            new[1:] |= w.hash[order][1:] != w.hash[order][:-1]
            at = np.flatnonzero(new)
            n, one = np.diff(np.append(at, len(order))), order[at]
            low, names = split.low[w.data].tobytes(), list(names)
            for k, s, e, m in zip(of[one].tolist(), w.start[one].tolist(), w.end[one].tolist(), n.tolist(), strict=True):
                if e - s <= TRAIN_WORD:
                    counts[names[k], low[s:e]] += m
            if len(counts) > COUNTED:
                yield out()
    if counts:
        yield out()


def _expect(pieces: list[bytes], langs: list[str], prob: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = Lattice(pieces)
        use = scaled(lattice, prob)
        total = np.zeros_like(prob)
        for batch in batches:
            lang = np.array(batch.column(0).to_pylist(), object)
            for k, name in enumerate(langs):
                part = batch.filter(pa.array(lang == name))
                for lo in range(0, part.num_rows, 1 << 15):
                    some = part.slice(lo, 1 << 15)
                    words = some.column(1).to_pylist()
                    end = np.cumsum([len(x) for x in words])
                    data = np.frombuffer(b"".join(words), np.uint8)
                    lattice.lay(data, np.concatenate(([0], end[:-1])), end)
                    total[:, k] += lattice.expected(use[:, k : k + 1], some.column(2).to_numpy().astype(float))
        for k in range(len(langs)):
            at = np.flatnonzero(total[:, k])
            cols = [pa.array(np.full(len(at), k), pa.int64()), pa.array(at), pa.array(total[at, k])]
            yield pa.RecordBatch.from_arrays(cols, names=["lang", "piece", "uses"])

    return run


def learn_languages(
    docs: DataFrame, train_docs: int | None = None, steps: int = EM_STEPS, vocabulary: str = VOCABULARY,
    id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
) -> tuple[list[bytes], list[str], np.ndarray, np.ndarray]:
    """(pieces, languages, piece probabilities, log priors) from the labelled rows of ``docs``.

    All rows give the priors, and all their words of up to ``TRAIN_WORD`` bytes the piece probabilities; with ``train_docs``,
    the words of about so many documents a language, chosen by a hash of id and text. The ``MAX_LANGS`` most frequent values are
    learned, so the driver gets a bounded table: one number per language and piece of the vocabulary.
    """
    pieces = read_pieces(vocabulary)
    rows = docs.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"), F.col(id_col).alias("k"))
    rows = rows.where("lang IS NOT NULL AND text IS NOT NULL")
    most = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "lang").limit(MAX_LANGS)
    sizes = {r["lang"]: r["n"] for r in most.collect()}
    langs = sorted(sizes)
    prior = np.log(np.array([sizes[x] for x in langs], float) / max(1, sum(sizes.values())))
    prob = np.full((len(pieces), len(langs)), 1 / len(pieces))
    if not langs:
        return pieces, langs, prob, prior
    taught = rows.where(F.col("lang").isin(langs))
    if train_docs is not None:
        share = F.create_map(*[x for name in langs for x in (F.lit(name), F.lit(min(1.0, train_docs / sizes[name])))])
        draw = F.pmod(F.xxhash64("k", "text", F.lit(31)), F.lit(1 << 20)) / float(1 << 20)
        taught = taught.where(draw < F.element_at(share, F.col("lang")))
    words = taught.select("lang", "text").mapInArrow(_count_words, "lang string, word binary, n long")
    words = stable(words.groupBy("lang", "word").agg(F.sum("n").alias("n")))
    for _ in range(steps):
        uses = words.mapInArrow(_expect(pieces, langs, prob), "lang long, piece long, uses double")
        total = np.zeros_like(prob)
        for r in uses.groupBy("lang", "piece").agg(F.sum("uses").alias("uses")).collect():
            total[r["piece"], r["lang"]] = r["uses"]
        prob = (total + SMOOTH) / (total.sum(axis=0) + SMOOTH * len(pieces))
    return pieces, langs, prob, prior


def _predict(text_col: str, pieces: list[bytes], langs: list[str], prob: np.ndarray, prior: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice, split = Lattice(pieces), Splitter("letters")
        use = scaled(lattice, prob)
        known, value = np.zeros(0, np.uint64), np.zeros((0, len(langs)))
        for batch in batches:
            texts = batch.column(text_col)
            lang, score = [UNKNOWN] * len(texts), np.zeros(len(texts))
            fit, size = np.zeros(len(texts)), np.zeros(len(texts), np.int64)
            letter = pc.fill_null(pc.match_substring_regex(texts, r"\p{L}"), False).to_numpy(zero_copy_only=False)
            for w in split.slices(texts, SLICE) if langs else ():
                own, first, word = np.unique(w.hash, return_index=True, return_inverse=True)
                place = np.searchsorted(known, own)
                old = np.zeros(len(own), bool)
                old[place < len(known)] = known[place[place < len(known)]] == own[place < len(known)]
                logs = np.empty((len(own), len(langs)))
                logs[old] = value[place[old]]
                new = np.flatnonzero(~old)
                low = split.low[w.data]
                for lo in range(0, len(new), 1 << 14):
                    some = new[lo : lo + (1 << 14)]
                    lattice.lay(low, w.start[first[some]], w.end[first[some]])
                    logs[some] = lattice.words(use)
                if value.nbytes + known.nbytes < CACHE_BYTES:  # common words come early
                    order = np.argsort(np.concatenate((known, own[new])))
                    known = np.concatenate((known, own[new]))[order]
                    value = np.concatenate((value, logs[new]))[order]
                total = np.concatenate((np.zeros((1, len(langs))), np.cumsum(logs[word], axis=0)))
                whole = total[w.first[1:]] - total[w.first[:-1]]
                length = np.concatenate(([0], np.cumsum(w.end - w.start + 1)))[w.first]
                post = whole + prior
                post = np.exp(post - post.max(axis=1, keepdims=True))
                post /= post.sum(axis=1, keepdims=True)
                best = post.argmax(axis=1)
                for i, row in enumerate(w.rows):
                    if letter[row]:
                        lang[row], score[row] = langs[best[i]], post[i, best[i]]
                        size[row] = length[i + 1] - length[i]
                        fit[row] = whole[i, best[i]] / size[row] if size[row] else 0.0
            cols = [*batch.columns, pa.array(lang, pa.string()), pa.array(score), pa.array(fit), pa.array(size)]
            yield pa.RecordBatch.from_arrays(cols, names=[*batch.schema.names, "lang_pred", "score", "fit", "fit_bytes"])

    return run


def predict_languages(
    docs: DataFrame, model: tuple[list[bytes], list[str], np.ndarray, np.ndarray], text_col: str = "text"
) -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score``, the posterior probability of the prediction.

    ``und`` with score 0 if the text is null or has no letter, or if nothing was learned. Repeated rows get the same
    result; columns of ``docs`` that are called like a new one are replaced. Words are runs of letters, digits and
    non-ASCII bytes, of any length. ``fit`` is the log probability a byte of the text's words (with the space before
    each) in that language, ``fit_bytes`` their bytes; 0 without words. Nothing is shuffled.
    """
    made = {"lang_pred": T.StringType(), "score": T.DoubleType(), "fit": T.DoubleType(), "fit_bytes": T.LongType()}
    rows = docs.drop(*made)
    kinds = T.StructType([*rows.schema, *[T.StructField(c, t) for c, t in made.items()]])
    return rows.mapInArrow(_predict(text_col, *model), kinds)


def usual_fit(told: DataFrame) -> DataFrame:
    """(lang, mean, spread): log probability a byte that texts of a language have in it, and its variance times the bytes.

    ``told`` is what :func:`predict_languages` returns for labelled rows; all that are predicted as labelled count.
    """
    told = told.where((F.col("lang") == F.col("lang_pred")) & (F.col("fit_bytes") > 0)).select("lang", "fit", "fit_bytes")
    mean = told.groupBy("lang").agg((F.sum(F.col("fit") * F.col("fit_bytes")) / F.sum("fit_bytes")).alias("mean"))
    gap = F.col("fit") - F.col("mean")
    # one row a learned language
    return told.join(F.broadcast(mean), "lang").groupBy("lang", "mean").agg(F.avg(gap * gap * F.col("fit_bytes")).alias("spread"))


def held_out(id_col: str = "doc_id", folds: int = 4, fold: int = 2):
    """Whether crc32 of the id as text leaves ``fold``; false for a null id."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % folds == fold, F.lit(False))
