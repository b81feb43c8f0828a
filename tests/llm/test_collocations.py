"""Phrase counts, scores and ranks against plain loops."""

import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from basketspark.llm import collocations as co

DOCS = "doc_id long, text string, lang string, n long, phrase string, words string, w1 string"


def docs_of(spark, rows, parts=3):
    return spark.createDataFrame([(1, t, g, 7, "clash", "clash", "clash") for t, g in rows], DOCS).repartition(parts)


def loop_counts(rows, max_words):
    f, n = defaultdict(Counter), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split("[.,;:!?\n-\r]", low):
            w = re.findall("[^ \t]+", piece)
            n[lang] += len(w)
            for k in range(1, max_words + 1):
                for i in range(len(w) - k + 1):
                    f[lang][tuple(w[i : i + k])] += 1
    return f, n


def loop(rows, max_words=5, min_count=100, cover=100, top=2000):
    f, n = loop_counts(rows, max_words)
    out = []
    for lang in f:
        c = {p: a for p, a in f[lang].items() if len(p) > 1 and a >= min_count}
        covered = set()
        for p, a in c.items():
            for m in range(2, len(p)):
                for i in range(len(p) - m + 1):
                    if 100 * a >= cover * c[p[i : i + m]]:
                        covered.add(p[i : i + m])
        scored = []
        for p, a in c.items():
            if p not in covered:
                cuts = [(1000 * a * n[lang] // (f[lang][p[:k]] * f[lang][p[k:]]), k) for k in range(1, len(p))]
                s, k = min(cuts)
                scored.append((-s, -a, " ".join(p).encode(), a, f[lang][p[:k]], f[lang][p[k:]]))
        for i, (s, _, p, a, x, y) in enumerate(sorted(scored)[:top], 1):
            out.append((lang, i, p.decode(), a, x, y, n[lang], -s))
    return sorted(out)


def found(spark, rows, **how):
    return sorted(tuple(r) for r in co.collocations(docs_of(spark, rows), **how).collect())


def prose(seed, n, kinds):
    r = np.random.default_rng(seed)
    w = [f"W{int(x)}" for x in np.minimum(r.geometric(0.12, n), kinds)]
    ends = r.random(n)
    return "".join(x + (". " if e < 0.05 else "\n" if e < 0.08 else "\t " if e < 0.1 else " ") for x, e in zip(w, ends))


def rows_of():
    rows = [(prose(s, 300, 30), ["en", "fr", None][s % 3]) for s in range(24)]
    rows += [("a b c d e f g h", "en")] * 9 + [("É É É é é é. x x x x", "fr")] * 8 + [(None, "en"), ("", None), (" \t ", "fr"), ("..,,", "de")]
    rows += [("one", "es"), ("the the " * 3000, "it"), (prose(99, 20_000, 9).replace("\n", " ").replace(".", " "), "pt")]
    return rows


@pytest.mark.parametrize("how", [{"min_count": 8}, {"min_count": 3, "cover": 60, "top": 25}, {"min_count": 2, "max_words": 3}, {"min_count": 6, "max_words": 2}])
def test_phrases_against_a_loop(spark, how):
    rows = rows_of()
    want = loop(rows, **how)
    assert len(want) > 30 and found(spark, rows, **how) == want


def test_without_broadcast(spark, monkeypatch):
    monkeypatch.setattr(co, "broadcast_within", lambda df: df)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert found(spark, rows_of(), min_count=8) == loop(rows_of(), min_count=8)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


@pytest.mark.parametrize("bits", [6, 9])
def test_full_bitmaps_change_no_count(spark, monkeypatch, bits):
    monkeypatch.setattr(co, "FILTER_BITS", bits)
    monkeypatch.setattr(co, "CHUNK_BYTES", 3000)
    monkeypatch.setattr(co, "KEPT_WORDS", 40)
    monkeypatch.setattr(co, "GATHERED_WORDS", 500)
    rows = rows_of()
    f, n = loop_counts(rows, 4)
    counts, totals = co.phrase_counts(docs_of(spark, rows), 4, 7)
    got = {(r.lang, r.phrase): (r["size"], r.f) for r in counts.collect()}
    assert got == {(lang, " ".join(p)): (len(p), k) for lang in f for p, k in f[lang].items() if k >= 7}
    assert {r.lang: r.n for r in totals.collect()} == {lang: k for lang, k in n.items() if k}


def test_nothing_to_find(spark):
    for rows in ([], [(None, None)], [("a b", "en")] * 99):
        assert found(spark, rows) == []
    assert found(spark, [("a b", None)] * 100) == [("und", 1, "a b", 100, 100, 100, 200, 2000)]


def test_scores_past_64_bits(spark):
    big = [(10**9 + 7, 10**13 + 1, 10**10 + 3, 3 * 10**9 + 1), (100, 10**14, 100, 100), (7, 20, 7, 9), (10**15 - 1, 10**16 - 1, 10**15, 10**15 - 1)]
    got = spark.createDataFrame(big, "a long, n long, l long, r long").select("a", co.exact_score().alias("s")).collect()
    assert {r.a: r.s for r in got} == {a: 1000 * a * n // (x * y) for a, n, x, y in big}
    assert got[0].s.__class__ is int
