import random

import pytest

from lavra.operators import quality

LOADS = "load_id bigint, previous_load_id bigint, row_count bigint, column_count int"
FORMS = "column_name string, kind string, pattern string, min_value bigint, max_value bigint"


def forms(spark):
    return spark.createDataFrame([("c", "category", None, None, None), ("k", "code", "^[A-Z]{2}$", None, None), ("n", "number", None, 0, 10)], FORMS)


def make(spark, loads):
    rows = [(i, *r, "extra", 1, "q") for i, part in loads.items() for r in part]
    return spark.createDataFrame(rows, "load_id bigint, c string, k string, n int, value string, side int, finding string")


def brute(loads, told, declared):
    out = set()
    for i, previous, rows, columns in told:
        part = loads.get(i, [])
        if rows != len(part):
            out.add((i, "*", "row_count"))
        if columns != sum(any(r[j] is not None for r in part) for j in range(3)):
            out.add((i, "*", "column_count"))
        before = loads.get(previous)
        for j, name in enumerate("ckn"):
            v = [r[j] for r in part if r[j] is not None]
            if name == "k" and v and sum(not (len(x) == 2 and x.isupper()) for x in v) / len(v) >= 0.05:
                out.add((i, name, "pattern"))
            if name == "n" and any(x < 0 or x > 10 for x in v):
                out.add((i, name, "range"))
            if before and part:
                w = [r[j] for r in before if r[j] is not None]
                if round(abs(len(w) / len(before) - len(v) / len(part)), 6) > 0.15:
                    out.add((i, name, "null_shift"))
                if name == "c" and len(v) >= 50 and len(w) >= 50:
                    if round(sum(abs(v.count(x) / len(v) - w.count(x) / len(w)) for x in {*v, *w}) / 2, 6) > 0.25:
                        out.add((i, name, "value_shift"))
    for i, name, rate, k in declared:
        part = loads.get(i)
        if part:
            v = [r["ckn".index(name)] for r in part]
            if round(abs(rate - sum(x is None for x in v) / len(v)), 6) > 0.02:
                out.add((i, name, "null_rate"))
            if k != len({x for x in v if x is not None}):
                out.add((i, name, "cardinality"))
    return out


@pytest.mark.parametrize("big", [False, True])
def test_findings_equal_brute_force(spark, big):
    rng = random.Random(5)
    size = lambda i: 9000 if big and i == 3 else rng.randint(90, 160)

    def row(shift, nulls):
        c = rng.choice("abc" if not shift else "abcddd") if rng.random() > nulls else None
        return c, rng.choice(["AB", "CD", "EF"]) if rng.random() > 0.04 * shift else "x\n", rng.choice([1, 5, None]) if rng.random() > 0.001 else 11

    loads = {i: [row(i in (2, 3), 0.4 if i == 4 else 0.05) for _ in range(size(i))] for i in range(1, 6)}
    loads[5] = [(None, None, 3)] * 60
    told = [(i, i - 1 if i > 1 else None, len(loads.get(i, [])) + (i == 2), 3 if i < 5 else 2) for i in range(1, 7)]
    declared = [(1, "c", 0.05, 3), (2, "c", 0.05, 4), (3, "k", 0.5, 3), (9, "c", 0.0, 0)]
    got = quality.findings(make(spark, loads), spark.createDataFrame(told, LOADS), spark.createDataFrame(declared, "load_id bigint, column_name string, null_rate double, cardinality bigint"), forms(spark))
    assert {tuple(r) for r in got.collect()} == brute(loads, told, declared)
    assert got.count() == got.distinct().count()


def two_sample(spark, loads, told):
    data = make(spark, loads)
    return {r.column_name: r for r in quality.two_sample(data, quality.value_counts(data, ["c", "k", "n"]), told, forms(spark)).collect()}


def test_empty_tables(spark):
    none = make(spark, {})
    loads = spark.createDataFrame([], LOADS)
    declared = spark.createDataFrame([], "load_id bigint, column_name string, null_rate double, cardinality bigint")
    assert quality.findings(none, loads, declared, forms(spark)).count() == 0
    told = spark.createDataFrame([(1, None, 5, 3)], LOADS)
    assert {tuple(r) for r in quality.findings(none, told, declared, forms(spark)).collect()} == {(1, "*", "row_count"), (1, "*", "column_count")}


def test_two_sample_tells_shifted_columns(spark):
    rng = random.Random(1)
    loads = {1: [(rng.choice("abc"), "AB", 1) for _ in range(400)], 2: [(rng.choice("cde"), "AB", 1) for _ in range(400)]}
    told = spark.createDataFrame([(2, 1, 400, 3)], LOADS)
    got = two_sample(spark, loads, told)
    assert got["c"].auc > 0.75 and got["c"].ablation > 0.2 and got["c"].value_cross > 0.2
    assert abs(got["k"].ablation) < 0.05 and got["k"].value_fit == 0


def test_a_shift_of_few_values_in_large_loads_is_found(spark):
    shares = {1: ["a"] * 30 + ["b"] * 30, 2: ["a"] * 48 + ["b"] * 12}
    loads = {i: [(c, "AB", 1) for c in v] + [(None, "AB", 1)] * 29_940 for i, v in shares.items()}
    told = [(1, None, 30_000, 3), (2, 1, 30_000, 3)]
    told, declared = spark.createDataFrame(told, LOADS), spark.createDataFrame([], "load_id bigint, column_name string, null_rate double, cardinality bigint")
    assert {tuple(r) for r in quality.findings(make(spark, loads), told, declared, forms(spark)).collect()} == {(2, "c", "value_shift")}
    got = two_sample(spark, loads, told)
    assert got["c"].value_fit == pytest.approx(0.15) and got["c"].null_fit == pytest.approx(0)


@pytest.mark.parametrize("chunk", [2048, 16])
def test_the_joint_model_tells_columns_in_one_chunk_or_many_and_ignores_file_layout(spark, monkeypatch, chunk):
    monkeypatch.setattr(quality, "CHUNK", chunk)
    rng = random.Random(3)
    loads = {1: [(rng.choice("abc"), rng.choice(["AB", "CD"]), rng.randint(0, 9)) for _ in range(6000)], 2: [(rng.choice("abcc"), rng.choice(["AB", "CD"]), rng.randint(0, 9)) for _ in range(9000)]}
    told = spark.createDataFrame([(2, 1, 9000, 3)], LOADS)
    got = two_sample(spark, loads, told)
    # the best score ranks c above a and b: 1/2 of the later rows against 2/3 of the earlier, ties count half
    assert got["c"].auc == pytest.approx(7 / 12, abs=0.02) and got["c"].ablation > 0.05 and abs(got["k"].ablation) < 0.02 and abs(got["n"].ablation) < 0.02
    again = two_sample(spark, {k: sorted(v, key=str) for k, v in loads.items()}, told)
    assert all(got[c].auc == pytest.approx(again[c].auc) and got[c].ablation == pytest.approx(again[c].ablation) for c in "ckn")


def test_repeated_rows_weigh_as_often_as_they_occur(spark):
    loads = {1: [("a", "AB", 1)] * 5000 + [("b", "AB", 1)] * 5000, 2: [("a", "AB", 1)] * 9000 + [("b", "AB", 1)] * 1000}
    got = two_sample(spark, loads, spark.createDataFrame([(2, 1, 1, 1)], LOADS))
    assert got["c"].value_fit == pytest.approx(0.2) and got["c"].n == 20_000


def test_no_table_of_loads_is_broadcast(spark, monkeypatch):
    plans = []

    def ran(df):
        rows = df.collect()
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return rows

    written = quality.materialize
    monkeypatch.setattr(quality, "CHUNK", 16)
    monkeypatch.setattr(quality, "materialize", lambda df, *a: (ran(df), written(df, *a))[1])
    loads = {i: [("abcd"[j % (2 * i)], "AB", j) for j in range(60)] for i in (1, 2)}
    told = spark.createDataFrame([(1, None, 60, 3), (2, 1, 60, 3)], LOADS)
    declared = spark.createDataFrame([(1, "c", 0.0, 9)], "load_id bigint, column_name string, null_rate double, cardinality bigint")
    got = {tuple(r) for r in ran(quality.findings(make(spark, loads), told, declared, forms(spark)))}
    assert {(1, "c", "cardinality"), (2, "c", "value_shift"), (2, "n", "range")} <= got
    assert sum(p.count("SortMergeJoin") for p in plans) >= 10 and not [p for p in plans if "Broadcast" in p]
