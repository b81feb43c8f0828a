"""The operators on texts against plain loops, on small tables with nulls, empty and long texts, ties and repeats."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from basketspark.llm import (
    chat_format,
    decontaminate,
    html_text,
    language,
    licences,
    line_rules,
    mixing,
    near_dedup,
    quality_model,
    sharding,
)
from basketspark.llm.words import Splitter, shingles

SF = "/root/testdata/sf0.001"
WORD = re.compile("[^\x20\x09-\x0d]+")
DOCS = "doc_id long, text string, lang string, source string, size string, kept string"


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def prose(seed, n, vocabulary=4000):
    r = np.random.default_rng(seed)
    return " ".join(f"w{x}" for x in r.integers(0, vocabulary, n))


def near_copy(text, seed, edits):
    r = np.random.default_rng(seed)
    w = text.split(" ")
    for at in r.choice(len(w), edits, replace=False):
        w[at] = f"x{seed}_{at}"
    return " ".join(w)


def family():
    base = prose(1, 300)
    texts = [base, base, base.upper(), "", None, "one two", "One  TWO", "  \n ", prose(2, 3000), "é ü\x85ß", base + " more"]
    texts += [near_copy(base, s, 1 + s % 5) for s in range(40)]
    texts += [near_copy(prose(s, 60), 1, 2) for s in range(20)] + [prose(s, 60) for s in range(20)]
    return texts


def table(spark, texts, schema=DOCS):
    rows = [(100 + i, t, "en" if i % 3 else None, f"s{i % 3}" if i % 7 else None, "clash", "clash") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, schema)


def brute_components(ids, texts, percent=85):
    sets = []
    for t in texts:
        w = words(t)
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= percent * len(a | sets[j]):
                x, y = find(ids[i]), find(ids[j])
                root[max(x, y)] = min(x, y)
    return {i: (len(s), find(i)) for i, s in zip(ids, sets, strict=True)}


@pytest.mark.parametrize("block", [1024, 7])
def test_near_groups_equal_all_pairs(spark, block):
    texts = family()
    docs = table(spark, texts)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dedup.near_groups(docs, block=block).collect()}
    assert got == brute_components([100 + i for i in range(len(texts))], texts)


def test_near_groups_edge_rows(spark):
    docs = spark.createDataFrame([(5, "a b c d e f"), (5, "a b c d e f"), (None, "a b c d e f"), (7, None)], "doc_id long, text string")
    got = sorted((r.doc_id or 0, r.component_id, r.kept) for r in near_dedup.near_groups(docs).collect())
    assert got == [(0, None, True), (5, 5, True), (5, 5, True), (7, 7, True)]
    assert near_dedup.near_groups(docs.limit(0)).count() == 0


def test_similarity_estimate_is_corrected_for_chance():
    r = np.random.default_rng(0)
    a = r.integers(0, 2**63, (1, near_dedup.HASHES)).astype(np.uint64)
    b = r.integers(0, 2**63, (400, near_dedup.HASHES)).astype(np.uint64)
    sig = near_dedup.pack(np.vstack([a, b]))
    assert near_dedup.similarity(sig[0], sig[:1])[0] == 1
    assert abs(near_dedup.similarity(sig[0], sig[1:]).mean()) < 0.01
    b[:, :64] = a[:, :64]
    assert abs(near_dedup.similarity(sig[0], near_dedup.pack(b)).mean() - 0.5) < 0.01


def test_shingles_of_slices_do_not_depend_on_neighbours():
    texts = [None, "", "a b", "A B c d e f", "x" * 300_000 + " b c d e", "a b c d e f"]
    whole = []
    for w in Splitter().slices(pa.array(texts), 64):
        values, bounds = shingles(w, 5)
        whole += np.split(values, bounds[1:-1])
    assert [len(x) for x in whole] == [0, 0, 1, 2, 1, 2]
    assert (whole[3] == whole[5]).all()


def test_licences_against_all_windows(spark):
    text = "free words here\nReleased under\nthe MIT License.\n\nother text of the day\nLicensed under CC BY-NC 4.0.\n"
    texts = [text, None, "", "one", "Released under the MIT License.", licences.TEMPLATES["MIT"].replace(". ", ".\n") + "\nend of it", prose(3, 2000)]
    got = {(r.doc_id, r.licence): (round(r.dice, 9), r.line_from, r.line_to, r.n_bigrams) for r in licences.scan_licences(table(spark, texts)).collect()}

    def tokens(s):
        return re.findall("[a-z0-9]+", s.lower())

    want = {}
    for i, t in enumerate(texts):
        lines = (t or "").split("\n")
        for name, template in licences.TEMPLATES.items():
            a, best = Counter(zip(tokens(template), tokens(template)[1:], strict=False)), None
            for x in range(len(lines)):
                for y in range(x, len(lines)):
                    if not tokens(lines[x]) or not tokens(lines[y]):
                        continue
                    w = tokens("\n".join(lines[x : y + 1]))
                    b = Counter(zip(w, w[1:], strict=False))
                    n = sum(a.values()) + sum(b.values())
                    dice = 2 * sum((a & b).values()) / n
                    if dice >= licences.THRESHOLD and (best is None or dice > best[0]):
                        best = (dice, x, y, sum(b.values()))
            if best:
                want[100 + i, name] = (round(best[0], 9), *best[1:])
    assert got == want and len(want) >= 4
    assert licences.scan_licences(table(spark, texts).limit(0)).count() == 0


def test_licences_inside_longer_lines(spark):
    named = ["MIT", "BSD-2-Clause", "BSD-3-Clause", "Unlicense", "AGPL-3.0-notice", "LGPL-3.0-notice", "CC0-1.0-notice", "Apache-2.0", "GPL-3.0", "MPL-2.0"]
    texts = ["Copyright 2020 X. Released under the MIT License."]
    texts += [f"{prose(1, 300)} {' '.join(licences.TEMPLATES[n].split())} {prose(2, 400)}" for n in named]
    got = {(r.doc_id, r.licence): (r.dice, r.line_from, r.line_to) for r in licences.scan_licences(table(spark, texts)).collect()}
    assert got[100, "MIT-line"] == (1, 0, 0)
    assert all(got[101 + i, n] == (1, 0, 0) for i, n in enumerate(named))


def test_best_licence_window_equals_all_windows():
    r = np.random.default_rng(8)
    for _ in range(40):
        vocabulary = "a b c d e".split()
        template = " ".join(r.choice(vocabulary, r.integers(3, 9)))
        scanner = licences.Scanner({"t": template}, 0.6)
        w = list(r.choice([*vocabulary, "x"], 25))
        (cut,) = scanner.split.slices(pa.array([" ".join(w)]))
        line = np.arange(len(w))
        got = scanner.best(licences._bigrams(cut.hash), line, scanner.bags[0])
        a, best = Counter(zip(template.split(), template.split()[1:], strict=False)), None
        for x in range(len(w) - 1):
            for y in range(x + 1, len(w)):
                b = Counter(zip(w[x:y], w[x + 1 : y + 1], strict=True))
                dice = 2 * sum((a & b).values()) / (sum(a.values()) + y - x)
                if dice >= 0.6 and (best is None or dice > best[0]):
                    best = (dice, x, y, y - x)
        assert got == best


def test_mixing_hits_targets_and_repeats_itself(spark):
    r = np.random.default_rng(4)
    rows = [(i, prose(i, int(n)), s) for i, (n, s) in enumerate(zip(r.integers(0, 120, 600), r.choice(["a", "b", "c", None], 600, p=[0.6, 0.2, 0.1, 0.1]), strict=True))]
    rows += [(1000, None, "a"), (1001, "", None), (None, "x y", "b"), (3, rows[3][1], rows[3][2])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("target", F.lit("clash"))
    once = mixing.mix_sources(docs).drop("text")
    got = once.toPandas()
    again = mixing.mix_sources(docs.repartition(3)).drop("text").toPandas()
    key = ["source", "doc_id", "size"]
    assert got.sort_values(key).reset_index(drop=True).equals(again.sort_values(key).reset_index(drop=True))
    got["source"] = got.source.fillna("~")
    by = got.groupby("source").agg(size=("size", "sum"), told=("source_size", "max"), target=("target", "max"), taken=("taken", "sum"))
    assert (by["size"] == by.told).all() and (got.taken <= 2 * got["size"]).all()
    weight = dict(zip(sorted(by.index), [3, 1, 2, 3], strict=True))
    left, free, target = 1.5 * by["size"].sum(), set(by.index), {}
    while free:  # share, stop those above, share the rest again
        level = left / sum(weight[s] for s in free)
        above = {s for s in free if weight[s] * level > 2 * by["size"][s]}
        for s in above or free:
            target[s] = 2 * by["size"][s] if above else weight[s] * level
        left -= sum(target[s] for s in above)
        free -= above or free
    for s in by.index:
        assert by.target[s] == pytest.approx(target[s])
        assert abs(by.taken[s] - target[s]) <= max(3, 0.01 * target[s])
    assert mixing.mix_sources(docs.limit(0)).count() == 0


def test_balance_solves_the_constraint(spark):
    groups = spark.createDataFrame([("a", 10, 5), ("a", 100, 3), ("b", 7, 10)], "source string, size long, n long")
    targets = spark.createDataFrame([("a", 350, 200.0), ("b", 70, 140.0)], "source string, source_size long, target double")
    got = {r.source: r for r in mixing.balance(groups, targets).collect()}
    a = got["a"]
    total = sum(n * s * 2 / (1 + np.exp(-a.lam * s / a.mean)) for s, n in ((10, 5), (100, 3)))
    assert total == pytest.approx(200, rel=1e-4) and got["b"].lam == float("inf")


def test_line_rules_drop_depleted_documents_only(spark):
    host = [(i, f"{prose(i, 30)}\nShared  LINE of this host here\n{prose(1000 + i, 20)}", "h") for i in range(60)]
    poor = [(100 + i, f"shared line of this host here\nword{i} a b c d", "h") for i in range(30)]
    more = [(200, None, "h"), (201, "", None), (202, prose(5, 40), None), (203, " ".join(["a b c d e"] * 9), "h")]
    docs = spark.createDataFrame(host + poor + more + host[:1], "doc_id long, text string, source string")
    got = {r.doc_id: r for r in line_rules.line_quality(docs, min_kept=0.5).collect()}
    assert all(got[i].kept for i in range(60)) and not any(got[100 + i].kept for i in range(30))
    assert not any(got[100 + i].base_failed for i in range(30))
    assert (got[200].n_words, got[200].kept, got[202].kept) == (0, False, True)
    assert (got[203].n_words, got[203].n_repeat_words, got[203].base_failed) == (45, 45, True)
    assert line_rules.line_quality(docs.limit(0)).count() == 0


def test_chats_round_trip(spark):
    odd = ["<|end|>\n<|user|>\n", "\\", "\\<|", "\\\\<|x|>", "a|>b", "<", "", None, "é<|" * 50, prose(1, 3000)]
    rows = [(1, i, ("user", "assistant", "a|b\\<|")[i % 3], t, "x") for i, t in enumerate(odd)]
    rows += [(2, 0, "system", prose(2, 20), "x")] + [(2, i, ("user", "assistant")[i % 2], prose(i, 60), "x") for i in range(1, 40)]
    rows += [(None, None, None, "t", "x"), (3, 0, "user", "same", "x"), (3, 0, "user", "same", "x")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, window string")
    made = chat_format.format_chats(turns, budget=200, history=50)
    got = {r.conv_id: r for r in chat_format.chat_digest(made).collect()}
    by = defaultdict(list)
    for c, n, role, text, _ in rows:
        by[c].append((n or 0, role or "", text or ""))
    assert set(got) == set(by)
    for c, turns_of in by.items():
        turns_of.sort()
        said = "".join(f"{r}\n{t}\n" for _, r, t in turns_of)
        loss = "".join(t for _, r, t in turns_of if r == "assistant")
        assert got[c].n_turns == len(turns_of) and got[c].turns_sha256 == hashlib.sha256(said.encode()).hexdigest()
        assert (got[c].loss_chars, got[c].loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    for r in made.where("conv_id = 2").collect():  # budget, system turn first, some history
        seen = chat_format.parse(r.text)
        assert sum(len(t.split()) + 1 for _, t, _, _ in seen) <= 200 and seen[0][0] == "system"
        assert r.repeated == 0 if r.window == 0 else r.repeated >= 1
    assert chat_format.chat_digest(chat_format.format_chats(turns.limit(0))).count() == 0


PAGE = (
    "<html><head><title>t</title><script>var a='<p>no</p>';</script></head><body><div id=top>Site name</div>"
    "<nav><ul><li><a href=x>menu {i}</a></ul></nav><div class='side-bar ad'>buy {i}</div>{body}"
    "<div class=legal>All rights reserved</div><div id=comments><article><p>me too {i}</p></article></div>"
    "<footer>foot</footer></body></html>"
)


def test_page_templates_and_main_text(spark):
    article = "<article><h1>Head&nbsp;{i}</h1><p>Tom &amp; Jerry <b>bo</b>ld<br>next &#233;<p>\n two\t words <!-- no --></p></article>"
    plain = "<div><p>first {i}</p><p>second {i}</p></div>"
    rows = [(i, f"https://h.example/{i}", PAGE.replace("{body}", article if i % 2 else plain).replace("{i}", str(i)), "x") for i in range(8)]
    rows += [(50, None, rows[1][2], "x"), (51, "u", None, "x"), (52, "http://z.example/", "<p>open <b>text<div cla", "x"), rows[0]]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, host string")
    got = {r.page_id: r for r in html_text.extract_text(pages).collect()}
    for i in range(8):
        want = f"Head {i} Tom & Jerry bold next é two words" if i % 2 else f"first {i} second {i}"
        assert (got[i].text, got[i].n_chars) == (want, len(want))
    assert got[50].text == got[1].text and got[51].text == "" and got[52].text == "open text"
    template = {r.path for r in html_text.page_templates(pages).collect()}
    assert "/html/body/div/#" in template and not any("article" in p and "h1" in p for p in template)
    assert html_text.extract_text(pages.limit(0)).count() == 0


def test_template_slots_decide():
    page = "<body><div>Site</div><article><p>text {i}</p></article><p>Rights</p>{more}</body>"
    own = "<main><p>own {i}</p></main>"
    found = [html_text._sequence(page.replace("{more}", "").replace("{i}", str(i)))[0] for i in range(3)]
    shared = [t for t, _ in found[0] if all(t in dict(f) for f in found[1:])]
    template = [{"cls": 1, "token": t, "place": i} for i, t in enumerate(shared)]
    odd = page.replace("{more}", own).replace("{i}", "9")
    # the article is the slot of the template; without one the page's own articles count
    assert html_text.main_text(odd, template) == "text 9" and html_text.main_text(odd, []) == "text 9 own 9"
    plain = "<body><div>Site</div><div><p>a</p><p>b</p></div><p>Rights</p></body>"
    tokens = [t for t, _ in html_text._sequence(plain)[0]]
    both = [{"cls": 1, "token": t, "place": i} for i, t in enumerate(dict.fromkeys(tokens)) if t in shared]
    assert html_text.main_text(plain, both) == "a b" and html_text.main_text(plain, []) == "Site a b Rights"


def test_one_page_with_two_articles_leaves_the_host_whole(spark):
    page = "<html><body><div>Site</div><article><h1>Head {i}</h1><p>first {i}</p><p>second {i}</p></article>{more}</body></html>"
    card = "<article><h2>Card</h2></article>"
    rows = [(i, f"https://h.example/{i}", page.replace("{more}", card if i == 4 else "").replace("{i}", str(i))) for i in range(9)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r.text for r in html_text.extract_text(pages).collect()}
    assert got == {i: f"Head {i} first {i} second {i}" + " Card" * (i == 4) for i in range(9)}
    assert "/html/body/article" in {r.path for r in html_text.page_templates(pages).collect()}
    # a template that has only the headline still tells where the article is
    found = [t for t, path in html_text._sequence(rows[0][2])[0] if path.endswith(("/html", "/body", "/h1"))]
    template = [{"cls": 1, "token": t, "place": i} for i, t in enumerate(found)]
    assert html_text.main_text(rows[0][2], template) == got[0]


def test_notices_repeated_inside_the_article_are_template(spark):
    page = "<html><body><div>Site</div><main><p>Read us daily</p><h1>Head {i}</h1><p>text {i}</p><p>All rights kept</p></main></body></html>"
    copy = "<html><body><div>Own {i}</div><main><h1>Same</h1><p>one text</p></main></body></html>"
    rows = [(i, f"https://h.example/{i}", page.replace("{i}", str(i))) for i in range(6)]
    rows += [(10 + i, f"https://copies.example/{i}", copy.replace("{i}", str(i))) for i in range(4)]
    got = {r.page_id: r.text for r in html_text.extract_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {i: f"Head {i} text {i}" for i in range(6)} | {10 + i: "Same one text" for i in range(4)}


def test_tiles_are_greedy_and_longest_first():
    r = np.random.default_rng(3)
    for _ in range(60):
        a, b = (r.integers(1, 4, n).astype(np.uint64) for n in r.integers(1, 40, 2))
        da, db, want = set(), set(), []
        while True:
            best = 0
            for i in range(len(a)):
                for j in range(len(b)):
                    k = 0
                    while i + k < len(a) and j + k < len(b) and a[i + k] == b[j + k] and i + k not in da and j + k not in db:
                        k += 1
                    if k > best:
                        best, at = k, (i, j)
            if best < 5:
                break
            want.append(best)
            da |= set(range(at[0], at[0] + best))
            db |= set(range(at[1], at[1] + best))
        got = decontaminate.tiles(a, b)
        assert [n for _, _, n in got] == want
        assert all((a[i : i + n] == b[j : j + n]).all() for i, j, n in got)


def test_contaminated_documents(spark):
    item = prose(9, 40, 10**6)
    half = item.split()
    moved = " ".join(half[20:] + ["gap"] + half[:20])
    texts = [f"{prose(1, 50)} {item}, {prose(2, 50)}", f"start {moved.upper()}", " ".join(half[:15]), prose(3, 4000), None, "", item]
    bench = spark.createDataFrame([(1, item), (2, "a b"), (3, None), (4, prose(77, 20, 10**6))], "item_id long, text string")
    got = {(r.doc_id, r.item_id): (r.n_covered, r.n_tiles) for r in decontaminate.contaminated(table(spark, texts), bench).collect()}
    assert got == {(100, 1): (40, 1), (101, 1): (40, 2), (106, 1): (40, 1)}
    assert decontaminate.contaminated(table(spark, texts).limit(0), bench).count() == 0
    assert decontaminate.contaminated(table(spark, texts), bench.limit(0)).count() == 0


def test_contamination_with_repeated_and_missing_ids(spark, tmp_path):
    a, b, c = (prose(k, 30, 10**6) for k in (91, 92, 93))
    bench = spark.createDataFrame([(1, a), (1, b), (1, b), (None, c)], "item_id long, text string")
    texts = [(5, a), (5, f"{prose(1, 20)} {b}"), (5, prose(2, 60)), (None, c), (None, prose(3, 60)), (7, c), (7, c)]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    got = [(r.doc_id or 0, r.item_id or 0, r.n_covered, r.n_tiles) for r in decontaminate.contaminated(docs, bench).collect()]
    assert sorted(got) == [(0, 0, 30, 1), (5, 1, 30, 1), (5, 1, 30, 1), (7, 0, 30, 1)]
    bench.write.parquet(f"{tmp_path}/benchmark.parquet")
    left = corpus_pipeline.drop_contaminated(spark, docs, str(tmp_path))
    assert left.columns == docs.columns and {tuple(r) for r in left.collect()} == {texts[2], texts[4]}


def test_quality_is_learned(spark):
    docs, labels = (spark.read.parquet("/root/testdata/sf0.01/" + t + ".parquet") for t in ("documents", "labels"))
    apart = language.held_out("doc_id", 3, 1)
    w = quality_model.learn_quality(docs, labels.where(~apart))
    got = quality_model.score_quality(docs, w).join(labels, "doc_id").where(apart).toPandas()
    good, bad = (got.score[got.quality == q].to_numpy() for q in (1, 0))
    assert (good[:, None] > bad).mean() > 0.97 and (got.predicted == got.quality).mean() > 0.9
    odd = spark.createDataFrame([(1, None), (1, None), (None, ""), (2, "x " * 200_000)], "doc_id long, text string")
    scores = [r.score for r in quality_model.score_quality(odd, w).collect()]
    assert len(scores) == 4 and all(0 <= s <= 1 for s in scores) and scores[0] == scores[1]
    nothing = quality_model.learn_quality(docs, labels.limit(0))
    assert quality_model.score_quality(odd, nothing).where("score = 0.5").count() == 4


def test_all_segmentations_are_summed():
    pieces = [bytes([b]) for b in range(256)] + [b" a", b"ab", b"bc", b" abc", b"abc"]
    p = np.random.default_rng(1).random((len(pieces), 2)) / 50
    lattice = language.Lattice(pieces)
    known = dict(zip(pieces, p, strict=True))

    def total(s):
        return np.ones(2) if not s else sum(known[s[:k]] * total(s[k:]) for k in range(1, len(s) + 1) if s[:k] in known)

    spelled = [b"abc", b"", b"c", b"abcabc", b"ab"]
    end = np.cumsum([len(x) for x in spelled])
    lattice.lay(np.frombuffer(b"".join(spelled), np.uint8), np.concatenate(([0], end[:-1])), end)
    got = lattice.words(language.scaled(lattice, p))
    assert np.allclose(got, [np.log(total(b" " + x)) for x in spelled])
    one = language.scaled(lattice, p[:, :1])
    uses = lattice.expected(one, np.ones(len(spelled)))
    # every segmentation spells its word: expected bytes are the bytes there are
    assert uses @ lattice.length[:-1] == pytest.approx(sum(len(x) + 1 for x in spelled))


def test_long_words_and_pieces_are_not_cut(monkeypatch):
    from fractions import Fraction

    r = np.random.default_rng(5)
    letters = [b"a", b"b", "é".encode()]
    pieces = [bytes([b]) for b in range(256)] + [b" a", b"ab", b"ba", b"aab", b"abab" * 4, b"ba" * 11, "éa".encode()]
    p = r.random((len(pieces), 2)) / 40
    known = {s: [Fraction(float(v)) for v in row] for s, row in zip(pieces, p, strict=True)}
    spelled = [b"".join(letters[i] for i in r.integers(0, 3, n)) for n in (3, 30, 31, 33, 70, 200, 600)] + [b"abab" * 60, b"ba" * 90]

    def total(s, k):
        sums = [Fraction(1)]
        for i in range(1, len(s) + 1):
            sums.append(sum((sums[j] * known[s[j:i]][k] for j in range(max(0, i - 22), i) if s[j:i] in known), Fraction(0)))
        return sums[-1]

    def log(x):
        return math.log(x.numerator) - math.log(x.denominator)

    want = np.array([[log(total(b" " + s, k)) for k in (0, 1)] for s in spelled])
    lattice = language.Lattice(pieces)
    end = np.cumsum([len(x) for x in spelled])
    for lone in (1024, 100):
        monkeypatch.setattr(language, "LONE_WORD", lone)
        lattice.lay(np.frombuffer(b"".join(spelled), np.uint8), np.concatenate(([0], end[:-1])), end)
        assert np.allclose(lattice.words(language.scaled(lattice, p)), want, rtol=1e-11)
    uses = lattice.expected(language.scaled(lattice, p[:, 1:]), np.ones(len(spelled)))
    assert uses @ lattice.length[:-1] == pytest.approx(sum(len(x) + 1 for x in spelled))
    # one step of the EM update against every segmentation of a short word, listed
    lattice.lay(np.frombuffer(b"abaab", np.uint8), np.array([0]), np.array([5]))
    parts, by_hand = [[]], np.zeros(len(pieces))
    every = []
    while parts:
        part = parts.pop()
        done = len(b"".join(part))
        if done == 6:
            every.append(part)
        parts += [[*part, x] for x in pieces if b" abaab"[done:].startswith(x)]
    weight = np.array([np.prod([p[pieces.index(x), 0] for x in part]) for part in every])
    for part, w in zip(every, weight / weight.sum(), strict=True):
        for x in part:
            by_hand[pieces.index(x)] += w
    assert np.allclose(lattice.expected(language.scaled(lattice, p[:, :1]), np.ones(1)), by_hand)


def test_languages_are_learned(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = language.learn_languages(docs.where(~language.held_out()), train_docs=60)
    got = language.predict_languages(docs, model).where(language.held_out())
    assert got.where("lang = lang_pred").count() >= 0.98 * got.count()
    odd = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (3, "12 -- 3", "x"), (None, "ß", "x"), (4, "the " + "é" * 9000, "x")], "doc_id long, text string, score string")
    told = {r.doc_id: r for r in language.predict_languages(odd, model).collect()}
    assert [told[i].lang_pred for i in (1, 2, 3)] == ["und"] * 3 and told[None].lang_pred != "und"
    assert all(0 <= r.score <= 1 for r in told.values())
    nothing = language.learn_languages(docs.limit(0))
    assert language.predict_languages(odd, nothing).where("lang_pred = 'und'").count() == 5


def test_all_labelled_documents_teach(spark):
    """The same words in many documents or in a few of them teach the same."""
    kinds = "doc_id long, text string, lang string"
    rare = [(-1 - i, "zigzag quartz", "x") for i in range(3)]
    many = spark.createDataFrame([(i, "the water is cold", "x") for i in range(6000)] + [(i, "der Wald ist alt", "y") for i in range(40)] + rare, kinds)
    few = spark.createDataFrame([(i, "the water is cold " * 100, "x") for i in range(60)] + [(1, "der Wald ist alt " * 40, "y")] + rare, kinds)
    (_, langs, many_prob, _), (_, _, few_prob, _) = language.learn_languages(many), language.learn_languages(few)
    assert langs == ["x", "y"] and np.allclose(many_prob, few_prob, rtol=1e-9)


def test_usual_fit_takes_all_documents(spark):
    r = np.random.default_rng(2)
    rows = [("x", "x", float(f), int(n)) for f, n in zip(r.normal(-2, 0.1, 5000), r.integers(1, 90, 5000))]
    more = [("x", "y", -9.0, 50), ("y", "y", -3.0, 10), ("x", "x", 0.0, 0), (None, "x", -9.0, 50)]
    told = spark.createDataFrame(rows + more, "lang string, lang_pred string, fit double, fit_bytes long")
    got = {g["lang"]: g for g in language.usual_fit(told).collect()}
    fit, n = np.array([x[2] for x in rows]), np.array([x[3] for x in rows])
    mean = (fit * n).sum() / n.sum()
    assert set(got) == {"x", "y"} and got["x"].mean == pytest.approx(mean)
    assert got["x"].spread == pytest.approx(((fit - mean) ** 2 * n).mean())


def test_shards_against_a_sorted_list(spark):
    texts = family() + ["hot"] * 60 + [prose(7, 9000)]
    docs = table(spark, texts).unionByName(table(spark, [None, "hot"])).repartition(5)
    rows = sharding.byte_shards(docs, 9, carry=["doc_id", "text"]).withColumn("h", F.xxhash64(F.coalesce("text", F.lit(""))))
    rows = [r.asDict() for r in rows.collect()]
    assert len(rows) == docs.count()
    rows.sort(key=lambda r: (r["h"], r["doc_id"]))
    total, start, at = sum(r["size"] for r in rows), 0, Counter()
    group = Counter()
    for r in rows:
        raw = (r["text"] or "").encode()
        assert (r["size"], r["text_crc32"]) == (len(raw) + 16, zlib.crc32(raw))
        r["own"] = (2 * start + r["size"]) * 9 // (2 * total)
        start += r["size"]
        group[r["h"]] += r["size"]
    first = {}
    for r in rows:
        first.setdefault(r["h"], r["own"])
        whole = group[r["h"]] * 9 <= total * sharding.WHOLE_GROUP
        want = first[r["h"]] if whole else r["own"]
        assert r["shard"] == want
        at[want] += 1
    for s, n in at.items():
        assert sorted(r["slot"] for r in rows if r["shard"] == s) == list(range(n))
    assert sharding.byte_shards(docs.limit(0), 9).count() == 0


def test_pipeline_stages_do_what_they_say(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    odd = [(10**6, None, None, None, 0), (10**6 + 1, "123 456", None, "src0", 7), (None, docs.first().text, None, None, 1)]
    docs = docs.unionByName(spark.createDataFrame(odd, docs.schema))
    texts = {r.doc_id: r.text for r in docs.collect()}
    kept = [docs.columns]
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, stage(spark, docs, SF).cache()
        kept.append((name, docs.columns))
        if name == "language":
            gone = set(texts) - {r.doc_id for r in docs.collect()}
            assert {10**6, 10**6 + 1} <= gone and len(gone) < 6
        if name == "near_dedup":
            had = before.where("doc_id IS NOT NULL").collect()
            comps = brute_components([r.doc_id for r in had], [r.text for r in had])
            # the row without an id is a copy of the first document
            assert {r.doc_id for r in docs.collect()} == {i for i, (_, c) in comps.items() if c == i}
        if name == "decontamination":
            assert {r.doc_id for r in before.collect()} > {r.doc_id for r in docs.collect()}
        if name == "mixing":
            assert docs.groupBy("doc_id").count().agg(F.max("count")).first()[0] <= 2
        if name != "sharding":
            assert docs.columns == kept[0]
    assert docs.count() == before.count() and docs.agg(F.max("shard")).first()[0] < corpus_pipeline.SHARDS
    assert {"pipeline", *(n for n in entry.queries() if re.match(r"op\d+_", n))} <= set(entry.queries())


def test_registered_queries_have_their_columns(spark):
    want = {
        "op1": "doc_id n_shingles component_id kept",
        "op3": "doc_id size source_size target taken",
        "op4": "doc_id n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed kept",
        "op5": "conv_id n_turns turns_sha256 loss_chars loss_sha256 formatted_chars",
        "op6": "page_id url text n_chars",
        "op8": "doc_id held_out score predicted",
        "op9": "doc_id size text_crc32 law shard slot grown_shard",
        "op10": "doc_id held_out lang_pred score",
        "op11": "page_id host path rule verdict",
        "op12": "lang rank phrase a l r n score",
        "op13": "doc_id n_a n_b n_groups n_links n_best count_sum groups_sha256",
    }
    found = {n.split("_")[0]: n for n in entry.queries() if re.match(r"op\d+_", n)}
    assert set(found) == {f"op{n}" for n in range(1, 14)}
    for op, columns in want.items():
        if op in ("op3", "op9"):
            assert set(columns.split()) <= set(entry.queries()[found[op]](spark, SF).columns)


def test_pipeline_keeps_one_row_of_each_text_and_no_text_is_lost(spark):
    t, other, near = prose(71, 80), prose(72, 80), near_copy(prose(73, 200), 1, 2)
    rows = [(1, t), (1, t), (None, t), (None, t), (2, t), (9, t), (9, other), (None, prose(73, 200)), (4, near), (5, near), (6, None), (6, None), (7, "")]
    docs = spark.createDataFrame([(i, x, "en", "s", 1) for i, x in rows], "doc_id long, text string, lang string, source string, n_chars long")
    kept = corpus_pipeline.keep_one_of_each(spark, docs.repartition(3), SF)
    assert kept.columns == docs.columns
    got = sorted((str(r.doc_id), r.text or "") for r in kept.collect())
    assert got == sorted([("1", t), ("9", other), ("4", near), ("6", ""), ("6", ""), ("7", "")])
    assert corpus_pipeline.keep_one_of_each(spark, docs.limit(0), SF).count() == 0


@pytest.mark.parametrize("text", ["w " * 10, None])
def test_mixing_a_source_without_ids(spark, text):
    own = [text or f"{i} " * 10 for i in range(500)]
    rows = [(None, x, "b") for x in own] + [(i, "w " * (5 + i % 9), "a") for i in range(400)] + [(7, "v " * 10, "c")] * 300
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)
    out = mixing.mix_sources(docs).collect()
    by = defaultdict(lambda: [0, 0])
    for r in out:
        assert 0 <= r.taken <= 2 * r["size"]
        by[r.source] = [by[r.source][0] + r.taken, r.target]
    for taken, target in by.values():
        assert taken == pytest.approx(target, rel=0.01)


def extracted(spark, rows):
    return {r.page_id: r.text for r in html_text.extract_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}


def test_headings_and_labels_that_all_pages_share_stay(spark):
    page = (
        "<article><p>Our kitchen</p><h1>Dish {i}</h1><h2>Ingredients</h2><p>salt {i}</p><p>Serves:</p><p>{i} people</p><h2>Method</h2>"
        "<p>stir {i}</p><table><tr><th>Time</th><td>{i} min</td></tr></table><p>Subscribe now</p></article>"
    )
    plain = "<body><div><p>Home</p></div><div><h1>Dish {i}</h1><h2>Method</h2><p>stir {i}</p></div><div><h2>About us</h2><p>Since 1900</p></div></body>"
    rows = [(i, f"https://a.example/{i}", page.replace("{i}", str(i))) for i in range(8)]
    rows += [(20 + i, f"https://b.example/{i}", plain.replace("{i}", str(i))) for i in range(8)]
    want = {i: f"Dish {i} Ingredients salt {i} Serves: {i} people Method stir {i} Time {i} min" for i in range(8)}
    assert extracted(spark, rows) == want | {20 + i: f"Dish {i} Method stir {i}" for i in range(8)}


def test_classes_alone_separate_the_article(spark, monkeypatch):
    for lists in ("_DROPPED", "_ROLES", "_MAIN"):
        monkeypatch.setattr(html_text, lists, frozenset())
    page = (
        "<body><nav><ul><li>Home<li>News</ul></nav><article><h1>Head {i}</h1><p>text {i}</p><p>more {i}</p></article>"
        "<div class=sidebar><p>Buy this</p></div><footer><p>Imprint</p></footer></body>"
    )
    rows = [(i, f"https://h.example/{i}", page.replace("{i}", str(i))) for i in range(6)]
    assert extracted(spark, rows) == {i: f"Head {i} text {i} more {i}" for i in range(6)}
    assert extracted(spark, rows[:2])[0] == "Home News Head 0 text 0 more 0 Buy this Imprint"  # too few pages for classes


def test_templates_against_a_loop_over_all_pages(spark):
    r = np.random.default_rng(12)
    bits = ["<div><p>Home</p></div>", "<div><p>News</p><p>Shop</p></div>", "<h2>Twice</h2><h2>Twice</h2>", "<section><p>Rare</p></section>", "<p>x {i}</p>", "<article><p>own {i}</p></article>"]
    rows = []
    for i in range(40):
        body = "".join(b for b, p in zip(bits, (0.95, 0.8, 0.9, 0.3, 1, 0.7)) if r.random() < p)
        rows.append((i, f"http://h{i % 3}.example/{i}", f"<html><body>{body}</body></html>".replace("{i}", str(i))))
    rows += rows[:5] + [(99, "http://few.example/", rows[0][2])]
    got = defaultdict(lambda: defaultdict(set))
    for t in html_text.page_templates(spark.createDataFrame(rows, "page_id long, url string, html string")).collect():
        got[t.host][t.cls].add(t.token)
    for host in {u.split("/")[2] for _, u, _ in rows}:
        pages = sorted({h for _, u, h in rows if u.split("/")[2] == host})
        found = [html_text._sequence(p)[0] for p in pages]
        counts, paths = [Counter(t for t, _ in f) for f in found], {t: path for f in found for t, path in f}
        vectors = defaultdict(set)
        for token in paths:
            vector = tuple(c[token] for c in counts)
            here, article = sum(v > 0 for v in vector), paths[token].endswith("/article")
            if len(pages) >= 3 and here >= 3 and here >= 0.6 * len(pages) and (max(vector) == 1 or article):
                vectors[vector].add(token)
        want = {frozenset(c) for c in vectors.values() if len(c) > 1 or any(paths[t].endswith("/article") for t in c)}
        assert {frozenset(c) for c in got[host].values()} == want


def test_long_pages(spark):
    long = "<article>" + "".join(f"<p>word {i}</p>" for i in range(60_000)) + "</article>"
    text = extracted(spark, [(1, "http://h.example/", long), (2, "http://h.example/2", "<p>" * 50_000 + "end")])
    assert text[1] == " ".join(f"word {i}" for i in range(60_000)) and text[2] == "end"


def test_pipeline_rejects_strange_languages_and_keeps_known_ones(spark):
    import base64

    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    r = np.random.default_rng(1)
    strange = [
        "".join(r.choice(list("asdfghjklqwertyuiopzxcvbnm    "), 600)),
        base64.b64encode(r.bytes(600)).decode(),
        "Kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan. Heille on annettu järki ja omatunto. " * 4,
        "123 456",
        "",
        None,
    ]
    short = ["the and of", "de la", "The quick brown fox jumps over the lazy dog and runs away into the forest."]
    more = [(10**7 + i, t, None, "odd", 1) for i, t in enumerate(strange + short)]
    kinds = "doc_id long, text string, lang string, source string, n_chars long"
    whole = docs.select(*[c.split()[0] for c in kinds.split(", ")]).unionByName(spark.createDataFrame(more, kinds))
    kept = {r.doc_id for r in corpus_pipeline.keep_known_languages(spark, whole, SF).select("doc_id").collect()}
    assert not kept & {10**7 + i for i in range(len(strange))}
    assert {10**7 + len(strange) + i for i in range(len(short))} <= kept
    assert len(kept) - len(short) >= 0.98 * docs.count()
