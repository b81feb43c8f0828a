"""Small frames for the rules that are easy to get wrong."""

import ast
import random
from datetime import datetime, timedelta
from decimal import Decimal
from itertools import pairwise

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from basketspark.operators import cleaning, features, quality, rollups, stats
from basketspark.operators.classify import models, neighbours, scores
from basketspark.operators.sequences import build, mining
from basketspark.operators.sequences import pattern as P
from basketspark.sources import io

RAW = "basket_id string, basket_ts timestamp_ntz, sale string, customer_id double, country string, prod_id string, prod_descr string, qta int"


def day(n):
    return datetime(2011, 1, 1) + timedelta(days=n)


def raw(spark, rows):
    return spark.createDataFrame(rows, RAW)


def test_cleaning_rules(spark):
    df = raw(
        spark,
        [
            ("1", day(0), "2,55", 7.0, "UK", "a1", "  Zed\t", 5),
            ("1", day(0), "2,55", 7.0, "UK", "A1", "alpha longer", 2),
            ("C2", day(1), "2,55", 7.0, "UK", "a1", "zed", -3),
            ("3", day(2), "0,001", 7.0, "UK", "b", "cheap", 1),
            ("A4", day(2), "-11062,06", 7.0, "UK", "B", "debt", 1),
            ("5", day(2), "1,0", None, "UK", "b", "no customer", 1),
            ("6", day(2), "1,0", 8.0, "UK", "b", "damaged", 1),
            ("7", day(2), "1,0", 8.0, "UK", "b", None, 1),
        ],
    )
    got = {(r["basket_id"], r["prod_id"]): r for r in cleaning.clean(df).collect()}
    assert set(got) == {(1, "A1"), (2, "A1"), (7, "B")}
    assert got[1, "A1"]["qta"] == 7 and got[1, "A1"]["sale"] == Decimal("2.5500")
    assert got[1, "A1"]["prod_descr"] == "ZED" and got[7, "B"]["prod_descr"] is None
    longest = cleaning.canonical_description(cleaning.normalise_text(df.where("basket_id = '1'")), "longest")
    assert {r["prod_descr"] for r in longest.collect()} == {"ALPHA LONGER"}


@pytest.mark.parametrize("limit", [None, 20])
def test_unmatched_returns_equal_the_loop(spark, limit):
    rnd = random.Random(1)
    rows = [
        (b, rnd.choice("ppqr"), rnd.choice([1, 1, 1, 2]), day(b // 3), rnd.randint(-5, 5)) for b in range(200)
    ]
    rows += [(900 + i, "M", 1, day(i), -4) for i in range(3)]
    df = spark.createDataFrame(rows, "basket_id int, prod_id string, customer_id int, basket_ts timestamp_ntz, qta int")
    df = df.withColumn("sale", F.lit(1))
    got = cleaning.flag_unmatched_returns(df, max_group_rows=limit)
    flagged = {r["basket_id"] for r in got.where("unmatched").collect()}
    want, running = set(), {}
    for b, prod, cust, _, q in sorted(rows, key=lambda r: (r[3], r[0])):
        if prod == "M":
            continue
        total = running.get((cust, prod), 0) + q
        if total < 0:
            want.add(b)
            total = 0
        running[cust, prod] = total
    assert flagged == want and got.count() == len(rows)


def test_quality_findings(spark):
    df = raw(
        spark,
        [
            ("1", day(0), "1,234", 7.0, "UK", "A", "x", 2),
            ("1", day(0), "1,0", 7.0, "UK", "B", "X", 1),
            ("C2", day(1), "1,234", 7.0, "UK", "A", "x", -2),
            ("C2", day(1), "1,0", 7.0, "UK", "B", "X", -1),
            ("A3", day(1), "1,0", 9.0, "FR", "D", None, -1),
            ("A3", day(1), "1,0", 9.0, "FR", "D", None, -1),
        ],
    )
    m = quality.match_cancellations(df).first()
    assert (m["basket_id"], m["n_matches"], m["first_match"]) == ("C2", 1, "1")
    assert quality.match_cancellations(df, compare="raw").isEmpty()
    assert tuple(quality.cancel_sign_check(df).first()) == (2, 0, 2)
    assert [r[0] for r in quality.odd_basket_ids(df).collect()] == ["A3"]
    assert quality.duplicate_row_count(df).first()[0] == 1
    assert quality.excess_decimals(df).count() == 2
    # a key without any description violates the rule as well
    assert {r["prod_id"]: r["n_distinct"] for r in quality.fd_violations(df, "prod_id", "prod_descr").collect()} == {"D": 0}
    assert tuple(quality.pair_cardinality(df, "basket_id", "customer_id").first()) == (3, 3)
    assert quality.duplicate_products(df).isEmpty()  # the repeated rows hold nulls


def test_qcut_merges_equal_edges(spark):
    df = spark.createDataFrame([(x,) for x in [1, 1, 1, 2, 3, 4, 5, 6]], "x int")
    got = [(r["x"], r["bin"]) for r in features.qcut(df, "x", 4, "bin").orderBy("x").collect()]
    assert got == [(1, 0), (1, 0), (1, 0), (2, 0), (3, 1), (4, 1), (5, 2), (6, 2)]


def test_scaling_of_a_constant_column(spark):
    df = spark.createDataFrame([(1.0, 5.0), (3.0, 5.0)], "a double, b double")
    got = features.min_max_scale(df, ["a", "b"], 0.01, 0.99).orderBy("a").collect()
    assert [tuple(r) for r in got] == [(0.01, 0.01), (0.99, 0.01)]


def test_histogram_keeps_empty_bins(spark):
    df = spark.createDataFrame([(0.0,), (1.0,), (10.0,)], "x double")
    assert [r["n"] for r in stats.histogram(df, "x", 5).orderBy("bin").collect()] == [2, 0, 0, 0, 1]


def test_percent_of_total(spark):
    df = spark.createDataFrame([("a", 1), ("b", 3)], "k string, v int")
    assert {r["k"]: r["v"] for r in rollups.percent_of_total(df, ["v"]).collect()} == {"a": 25.0, "b": 75.0}


def test_scores_with_a_class_never_predicted(spark):
    df = spark.createDataFrame([(0, 0), (0, 1), (1, 1), (2, 1)], "label int, prediction int")
    per = {r["class"]: r for r in scores.class_scores(df).collect()}
    assert per[2]["precision"] == 0 and per[2]["f1"] == 0 and per[2]["support"] == 1
    assert scores.classification_scores(df).first()["accuracy"] == 0.5
    assert {r["label"]: r["pred_1"] for r in scores.confusion_matrix(df).collect()} == {0: 1, 1: 1, 2: 1}


def test_smote_balances_and_stays_between(spark):
    rnd = random.Random(2)
    rows = [(i, rnd.random(), 0) for i in range(40)] + [(100 + i, 5 + rnd.random(), 1) for i in range(9)]
    rows += [(200 + i, 9.0, 2) for i in range(8)]  # copies only
    df = spark.createDataFrame(rows, "customer_id long, x double, label int")
    got = neighbours.smote(df, ["x"]).toPandas()
    assert got.groupby("label").size().tolist() == [40, 40, 40]
    assert got[got["label"] == 1]["x"].between(5, 6).all() and (got[got["label"] == 2]["x"] == 9).all()


DB = [
    [["tea"], ["jam", "oil"], ["tea", "oil"], ["rye"]],
    [["jam"], ["tea"], ["jam", "oil"], ["rye"], ["tea"]],
    [["rye", "tea"], ["jam"], ["jam", "oil"]],
    [["tea"], ["rye"], ["jam", "oil"], ["oil"], ["fig"]],
    [["fig"], ["tea", "jam"], ["oil"]],
]


def occ_of(spark, db):
    rows = [(s, p, day(p), items) for s, seq in enumerate(db) for p, items in enumerate(seq)]
    return build.from_events(spark.createDataFrame(rows, "seq_id long, pos long, ts timestamp_ntz, items array<string>"))


def subsequence(seq, pat):
    i = 0
    for e in pat:
        while i < len(seq) and not set(e) <= set(seq[i]):
            i += 1
        if i == len(seq):
            return False
        i += 1
    return True


def all_patterns(db, least):
    """Supports of every pattern that at least ``least`` sequences contain, grown item by item."""
    items = sorted({x for seq in db for e in seq for x in e})
    level, out = [[[x]] for x in items], {}
    while level:
        good = {str(p): (p, n) for p in level if (n := sum(subsequence(s, p) for s in db)) >= least}
        out |= {t: n for t, (_, n) in good.items()}
        level = [[*p, [x]] for p, _ in good.values() for x in items]
        level += [[*p[:-1], [*p[-1], x]] for p, _ in good.values() for x in items if x > p[-1][-1]]
    return out


@pytest.mark.parametrize("least", [2, 3, 5])
def test_gsp_finds_all_patterns(spark, least):
    got = {str(r["pattern"]): r["support_count"] for r in mining.gsp(occ_of(spark, DB), least / 5, max_group_rows=2).collect()}
    want = all_patterns(DB, least)
    assert got == want
    assert least > 2 or (str([["tea"], ["jam", "oil"], ["rye"]]) in got and str([["jam", "oil"]]) in got)


def test_sweep_mines_at_its_own_support(spark):
    got = {r["value_days"]: r["n_patterns"] for r in mining.constraint_sweep(occ_of(spark, DB), "min_gap", [timedelta(0), timedelta(days=90)], 0.4).collect()}
    sizes = [sum(len(e) for e in ast.literal_eval(p)) for p in all_patterns(DB, 2)]
    assert got[0] == sum(n in (2, 3) for n in sizes) and sum(n == 3 for n in sizes) > 3
    assert got[90] == sum(1 for p in all_patterns(DB, 2) if len(ast.literal_eval(p)) == 1 < sum(len(e) for e in ast.literal_eval(p)) < 4)


def test_stored_configurations_do_not_touch_each_other(spark, tmp_path):
    found = mining.gsp(occ_of(spark, DB), 0.5)
    store = io.PatternStore(spark, str(tmp_path / "patterns"))
    store.write(found, 10, 0.5)
    store.write(found.where("n_items = 1"), 10, 0.5, {"min_gap": 0})
    assert store.read(10, 0.5).count() == found.count()
    assert store.read(10, 0.5, {"min_gap": 0}).count() == found.where("n_items = 1").count()
    store.write(found.limit(0), 10, 0.5)
    assert store.read(10, 0.5).count() == 0
    assert [tuple(r) for r in store.sweep("min_gap", 10, 0.5).collect()] == [(0, 0)]


def test_priors_belong_to_labels(spark):
    rows = [(i, float(x), y) for i, (x, y) in enumerate([(0, 0), (1, 0), (0, 2), (1, 2)])]
    data = spark.createDataFrame(rows, "customer_id long, x double, label int")
    for priors in ([0.1, 0.8, 0.1], {0: 0.1, 2: 0.1}):
        scores = [r["scores"] for r in models.gaussian_nb(data, data, ["x"], priors).collect()]
        assert all(a == pytest.approx(b) for a, b in scores)
    with pytest.raises(ValueError, match="2"):
        models.gaussian_nb(data, data, ["x"], [0.5, 0.5])


def test_unreadable_numbers_fail(spark):
    odd = spark.createDataFrame([("C12", "2,5"), (None, None)], "basket_id string, sale string")
    assert cleaning.parse_price(cleaning.basket_to_long(odd)).first()["basket_id"] == 12
    for column, step in (("basket_id", cleaning.basket_to_long), ("sale", cleaning.parse_price)):
        with pytest.raises(Exception, match="cannot be read: A2"):
            step(odd.withColumn(column, F.lit("A2"))).collect()


def test_rows_without_a_product_stay(spark):
    rows = [(1, None, 5, day(0), 1, 1.0), (1, None, -2, day(1), 2, 1.0), (1, "M", -9, day(1), 3, 1.0)]
    schema = "customer_id long, prod_id string, qta int, basket_ts timestamp_ntz, basket_id long, sale double"
    assert cleaning.drop_unmatched_returns(spark.createDataFrame(rows, schema)).count() == 3


def test_absent_classes_have_a_row_and_single_rows_an_error(spark):
    df = spark.createDataFrame([(0, 0), (0, 2)], "label int, prediction int")
    got = {r["label"]: tuple(r)[1:] for r in scores.confusion_matrix(df).collect()}
    assert got == {0: (1, 0, 1), 1: (0, 0, 0), 2: (0, 0, 0)}
    train = spark.createDataFrame([(1, 0.0, 0), (2, 1.0, 0), (3, 5.0, 1)], "customer_id long, x double, label int")
    with pytest.raises(ValueError, match="class 1"):
        neighbours.smote(train, ["x"])


def test_leftmost_match_is_not_retried(spark):
    rows = [(1, 0, day(0), ["a"]), (1, 1, day(1), ["b"]), (1, 2, day(10), ["a"]), (1, 3, day(12), ["b"])]
    occ = build.from_events(spark.createDataFrame(rows, "seq_id long, pos long, ts timestamp_ntz, items array<string>"))
    pat = spark.createDataFrame([([["a"], ["b"]],)], "pattern array<array<string>>")
    count = lambda **kw: mining.support(pat, occ, mining.TimeLimits(**kw)).first()["support_count"]
    assert count(min_gap=timedelta(days=2)) == 0
    assert count(max_span=timedelta(days=1)) == 1
    assert count(min_gap=timedelta(0)) == 1


def test_candidates_keep_long_ids_whole(spark):
    df = spark.createDataFrame([([["A1", "B2"]],), ([["B2", "C3"]],)], "pattern array<array<string>>")
    assert [r[0] for r in mining.candidates(df).collect()] == [[["A1", "B2", "C3"]]]


def test_subsequences(spark):
    df = spark.createDataFrame([([["a"], ["b", "c"], ["d"]],)], "pattern array<array<string>>")
    row = df.select(
        P.direct_subsequences(F.col("pattern")).alias("d"), P.contiguous_subsequences(F.col("pattern")).alias("c")
    ).first()
    every = [[["b", "c"], ["d"]], [["a"], ["c"], ["d"]], [["a"], ["b"], ["d"]], [["a"], ["b", "c"]]]
    assert row["d"] == every and row["c"] == every
    df = spark.createDataFrame([([["a"], ["b"], ["c"]],)], "pattern array<array<string>>")
    assert df.select(P.contiguous_subsequences(F.col("pattern"))).first()[0] == [[["b"], ["c"]], [["a"], ["b"]]]


def test_sources_and_pattern_store(spark, tmp_path):
    path = tmp_path / "raw.tsv"
    path.write_text(
        "\tBasketID\tBasketDate\tSale\tCustomerID\tCustomerCountry\tProdID\tProdDescr\tQta\n"
        "0\tC12\t2011-01-02 10:00:00\t2,55\t17850.0\tUK\ta1\tfoo\t-3\n"
    )
    r = io.read_raw_lines(spark, str(path)).first()
    assert (r["basket_id"], r["sale"], r["customer_id"], r["qta"]) == ("C12", "2,55", 17850.0, -3)
    found = mining.gsp(occ_of(spark, DB), 0.5)
    store = io.PatternStore(spark, str(tmp_path / "patterns"))
    store.write(found, 10, 0.5)
    store.write(found.where("n_items = 1"), 10, 0.5, {"min_gap": 3})
    store.write(found, 10, 0.5, {"min_gap": 12})
    assert store.read(10, 0.5).count() == found.count()
    assert store.read(10, 0.5, {"min_gap": 3}).count() == found.where("n_items = 1").count()
    sweep = [tuple(x) for x in store.sweep("min_gap", 10, 0.5).collect()]
    assert [s[0] for s in sweep] == [3, 12] and sweep[0][1] == 0 and sweep[1][1] > 0
    metrics = str(tmp_path / "metrics")
    io.append_run_metrics(spark, metrics, 10, 0.5, 1.5, found)
    io.append_run_metrics(spark, metrics, 10, 0.5, 1.5, found)
    assert spark.read.parquet(metrics).count() == 2


def test_supports_counted_in_tasks_equal_joined_ones(spark, monkeypatch):
    r = random.Random(7)
    events = []
    for seq in [*range(40), None]:
        # times fall now and then, and some are missing
        days = [r.choice([None, *range(30)]) if r.random() < 0.2 else 2 * p for p in range(r.randint(1, 12))]
        events += [
            (seq, p, None if d is None else day(d), r.sample("abcde", r.randint(1, 4))) for p, d in enumerate(days)
        ]
    schema = "seq_id long, pos long, ts timestamp_ntz, items array<string>"
    occ = build.from_events(spark.createDataFrame(events, schema)).cache()
    element = lambda: sorted(r.sample("abcdex", r.choice([1, 1, 2, 3])))
    pats = [([element() for _ in range(r.randint(1, 4))],) for _ in range(150)] + [([["a"], [None]],), ([[None]],)]
    pats = spark.createDataFrame(pats, "pattern array<array<string>>")
    monkeypatch.setattr(mining.counting, "_ROWS", 50)
    monkeypatch.setattr(mining.counting, "_STEPS", 7)
    every = [{}, {"min_gap": timedelta(days=3)}, {"max_gap": timedelta(days=5), "max_span": timedelta(days=9)}]
    for limits in every:
        limits = mining.TimeLimits(**limits)
        want = mining.match_patterns(pats, occ, limits).groupBy("pattern").count().collect()
        want = {str(x["pattern"]): x["count"] for x in want}
        assert len(want) > 50
        for longest in (None, 12):  # with 12, sequences of more occurrences are joined
            got = mining.support(pats, occ, limits, longest).collect()
            assert {str(x["pattern"]): x["support_count"] for x in got if x["support_count"]} == want
            assert len(got) == pats.distinct().count()
    # blocks of whole sequences, whatever the size of what arrives
    ids = [0] * 70 + [1] * 3 + [2] * 200 + [None] * 60
    batch = pa.table({"seq_id": pa.array(ids, pa.int64())}).to_batches(max_chunksize=20)
    blocks = [t["seq_id"].to_pylist() for t, _ in mining.counting._blocks(batch)]
    assert sum(blocks, []) == ids and len(blocks) > 2 and not any(set(a) & set(b) for a, b in pairwise(blocks))


def test_supports_write_no_matches(spark, monkeypatch):
    def refuse(*_):
        raise AssertionError("matches were stored")

    monkeypatch.setattr(mining, "_advance", refuse)
    assert mining.gsp(occ_of(spark, DB), 0.4).count() == len(all_patterns(DB, 2))
    occ = occ_of(spark, DB)
    assert mining.support(mining.pair_counts(occ), occ).where("support_count = 0").count() == 0
