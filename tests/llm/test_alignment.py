"""Token groups, links and counts of two vocabularies against whole-text loops."""

import hashlib
import random
from collections import Counter, defaultdict

import pytest

from basketspark.llm import alignment as al

PARTS = [
    " ", "  ", "\n", "\t", "a", "the", "é", "😀", "𝒳", "中文", "▁", "<s>", "<|endoftext|>", "\x00", " ", "​", "\x85", "\x1c", "ﬁ", "é",
    "123", "-", "...", "'s", "\r\n", "日本", "עברית", "<0x41>", "==", "hello", "World",
]


@pytest.fixture(scope="module")
def both():
    return al.Vocabularies(*[open(f"{al.TOKENIZERS}/{n}", "rb").read() for n in (al.BYTE_BPE, al.PIECE_BPE)])


def loop(v, text):
    """Groups of the whole text from the bytes of its tokens; none if they don't spell it."""
    if not text:
        return []
    whole = " " + text
    a, b = v.first.encode(whole, add_special_tokens=False).ids, v.second.encode(text)
    ends = []
    for ids, table in ((a, v.first_bytes), (b, v.second_bytes)):
        if b"".join(table[i] for i in ids) != whole.encode():
            return []
        at, out = 0, []
        for i in ids:
            at += len(table[i])
            out.append(at)
        ends.append(out)
    groups, i, j = [], 0, 0
    for cut in sorted(set(ends[0]) & set(ends[1])):
        x, y = ends[0].index(cut, i) + 1, ends[1].index(cut, j) + 1
        groups.append((a[i:x], b[j:y]))
        i, j = x, y
    return groups


def loop_rows(v, rows):
    groups = [loop(v, t) for _, t in rows]
    linked = [Counter((p, q) for x, y in g for p in x for q in y) for g in groups]
    n = Counter(pair for c in linked for pair in c)
    most = defaultdict(int)
    for (a, _), k in n.items():
        most[a] = max(most[a], k)
    out = []
    for (doc, _), g, c in zip(rows, groups, linked):
        told = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in g)
        sha = hashlib.sha256(told.encode()).hexdigest() if g else ""
        best = sum(k for p, k in c.items() if n[p] == most[p[0]])
        out.append((doc, sum(len(x) for x, _ in g), sum(len(y) for _, y in g), len(g), sum(c.values()), best, sum(k * n[p] for p, k in c.items()), sha))
    return sorted(out, key=str)


def odd_texts(n, seed=1):
    r = random.Random(seed)
    return ["".join(r.choice(PARTS) for _ in range(r.randint(1, 30))) for _ in range(n)]


def found(spark, rows, parts=3):
    docs = spark.createDataFrame([(d, t, "x", 1, 2) for d, t in rows], "doc_id long, text string, pair string, at int, n_a int")
    return sorted((tuple(r) for r in al.align_tokens(docs.repartition(parts)).collect()), key=str)


def rows_of():
    texts = odd_texts(250) + ["", None, " ", "\n", "﻿a", "a ", "= " * 50, "=" * 300, " " * 70, "a" * 5000, "😀" * 300, "the cat", "the cat", "the cat"]
    texts += ["the quick brown fox " * 4000, "\n".join(["line of words, and more."] * 500)]
    return [(i % 200, t) for i, t in enumerate(texts)] + [(None, "the cat"), (None, None)]


def test_against_whole_texts(spark, both):
    rows = rows_of()
    want = loop_rows(both, rows)
    assert sum(w[1] > 0 for w in want) > 100 and sum(w[1] == 0 for w in want) > 10
    assert found(spark, rows) == want


def test_small_chunks_memory_and_broadcast(spark, both, monkeypatch):
    for name, value in (("CHUNK_CHARS", 400), ("KEPT_UNITS", 50), ("HOT_PAIRS", 4), ("WIDE_GROUP", 2)):
        monkeypatch.setattr(al, name, value)
    rows = [(i, t) for i, t in enumerate(odd_texts(120, 5) + ["the cat sat"] * 40 + [None, ""])]
    assert found(spark, rows) == loop_rows(both, rows)


def test_characters_cut_by_both(both):
    texts = ["𝒳𝒴𝒵", "a𝒳b", "😀😃", "ꙮꙮ x", "𝒳 𝒳\n𝒳", "é𝒳é"]
    memory = al.Units(both)
    rows = next(iter(al._align(texts, list(range(len(texts))), 0, memory))).to_pylist()
    for text, row in zip(texts, rows):
        assert row["n_groups"] == len(loop(both, text)) > 0
    a, b = both.first_tokens(" 𝒳", " 𝒳".encode()), both.second_tokens(" 𝒳")
    assert not a[2].all() and not b[2].all()  # both have tokens that end inside the character


def test_groups_without_common_ends_count_equal_ids_once():
    import numpy as np

    a, b = np.array([5] * 90 + [6] * 10), np.array([7] * 60 + [8])
    group, pair, links = al._pairs(a, b, np.array([0, 100]), np.array([0, 61]))
    assert len(pair) == 4 and links.sum() == 100 * 61 and set(group) == {0}
    assert dict(zip(pair.tolist(), links.tolist()))[5 << 20 | 7] == 90 * 60


def test_empty_tables(spark):
    assert found(spark, []) == []
    assert found(spark, [(1, None), (1, "")]) == [(1, 0, 0, 0, 0, 0, 0, "")] * 2
