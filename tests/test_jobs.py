import json

import pytest
from pyspark.sql import functions as F

from lavra.__main__ import parse
from lavra.operators import evaluation, retrieval, statistics
from lavra.plans import benchmark, build
from lavra.sources.registry import Registry


def registry(spark, **tables):
    r = Registry(spark)
    for name, df in tables.items():
        r.add(f"sql.{name}", (lambda d: lambda: d)(df))
    return r


def test_build_is_incremental_and_keeps_manual_text(spark, tmp_path):
    a = spark.createDataFrame([(1, "x"), (2, None)], "id bigint, name string")
    first = build.build(registry(spark, a=a), keys={"sql.a": ("id",)})
    assert first.columns.where("column_name = 'id'").first().is_pk and first.samples.count() == 2
    build.save(first, str(tmp_path / "catalog"))
    stored = build.load(spark, str(tmp_path / "catalog"))
    stored.sources = stored.sources.withColumn("description", F.lit("people wrote this"))
    r = registry(spark, a=a.union(a), b=a)
    r.add("sql.bad", lambda: spark.table("no_such_table"))
    lazy, forced = build.build(r, stored), build.build(r, stored, force=True)
    rows = lambda c: {x.source_id: (x.row_count, x.description) for x in c.sources.collect()}
    assert rows(lazy) == {"sql.a": (2, "people wrote this"), "sql.b": (2, "[MANUAL]")} and set(lazy.errors) == {"sql.bad"}
    assert rows(forced) == {"sql.a": (4, "people wrote this"), "sql.b": (2, "[MANUAL]")}
    assert forced.columns.count() == 4
    with pytest.raises(FileNotFoundError):
        build.load(spark, str(tmp_path / "none"))


DOCS = ["contratos de fornecimento e prazos", "saldo de estoque por deposito", "enlaces satelitais e torres", "viaturas e rotas de entrega"]


def gold(spark):
    rows = [(i, "quero saber " + DOCS[i % 4].split()[0] + " " + DOCS[i % 4].split()[-1], "ab"[i % 2], "k", [str(i % 4)], [], []) for i in range(20)]
    return spark.createDataFrame(rows, "query_id bigint, query string, difficulty string, cluster string, expected_primary array<string>, expected_complement array<string>, must_not_include array<string>")


def test_cross_validated_models(spark):
    docs = spark.createDataFrame(list(enumerate(DOCS)), "source_id bigint, doc string")
    g = gold(spark)
    dense = benchmark.dense_scores(g, docs, benchmark.HashedEncoder(docs), 4)
    cut = retrieval.cut(dense, retrieval.Cut("score_gap", 3, 0.0, 4)).withColumn("source_id", F.col("source_id").cast("string"))
    run = benchmark.cross_validate("hashed", cut, g)
    cv = run["cv_metrics"].first()
    assert cv.f1 > 0.95 and cv.f1_std < 0.1 and run["results"].count() == 20 and run["fold_metrics"].count() == 5
    flat = benchmark.cross_validate("flat", cut, g, calibrate=False, floor=2.0)["cv_metrics"].first()
    assert flat.recall == 0.0
    answers = g.select("query_id", F.when(F.col("query_id") % 2 == 0, F.lit('{"sources": ["sql.0", "sql.9"]}')).otherwise("?").alias("answer"))
    got = benchmark.selector_results(answers, g.withColumn("expected_primary", F.array(F.lit("sql.0"))), spark.createDataFrame([("sql.0",)], "source_id string"))
    assert {(r.query_id % 2, r.precision, r.recall) for r in got.collect()} == {(0, 1.0, 1.0), (1, 0.0, 0.0)}


def results(spark):
    rows = [(m, v, q, (w + (q * 7 % 10) / 20) * (1 if v == "v1" else 0.9)) for m, w in (("x", 0.4), ("y", 0.2), ("z", 0.1)) for v in ("v1", "v2") for q in range(30)]
    return spark.createDataFrame(rows, "model string, version string, query_id int, f1 double")


def test_comparisons(spark):
    r = results(spark)
    one = r.where("version = 'v1'")
    table = {x.comparison: x for x in benchmark.compare_models(one, n_boot=500).collect()}
    assert set(table) == {"x vs y", "x vs z", "y vs z"} and table["x vs y"].significant and abs(table["x vs z"].estimate - 0.3) < 1e-9
    assert {x.comparison for x in benchmark.compare_models(one, vs_best=True, n_boot=200).collect()} == {"x vs y", "x vs z"}
    assert {x.comparison for x in benchmark.compare_versions(r, ["v1", "v2"], n_boot=200).collect()} == {"x: v1 vs v2", "y: v1 vs v2", "z: v1 vs v2"}
    listed = benchmark.compare_listed(one, {"f": [("x", "y")], "g": [("y", "z"), ("x", "z")]}, n_boot=200).collect()
    assert {(x.family, x.comparison) for x in listed} == {("f", "x vs y"), ("g", "y vs z"), ("g", "x vs z")}
    banded = spark.createDataFrame([(q, ["baixa", "media", "alta"][q % 3], q / 30) for q in range(30)], "query_id int, band string, overlap double")
    assert benchmark.compare_by_band(one, banded, "z", n_boot=200).count() == 6
    assert {x.family for x in benchmark.interactions(one, banded, "z", n_boot=200).collect()} == {"slope", "difference of differences"}
    assert benchmark.ranking_table([evaluation.means(one.where(f"model = '{m}'"), ["model"], ("f1",)) for m in "zx"]).first().model == "x"


def test_command_line_checks(tmp_path):
    assert parse(["compare", "a", "b", "--vs-best"]).vs_best
    for bad in (["map", "a", "b", "c", "d", "--similarity-threshold", "2"], ["map", "a", "b", "c", "d", "--max-suggestions", "0"], ["other"]):
        with pytest.raises(SystemExit):
            parse(bad)


def test_selectors(spark):
    docs = spark.createDataFrame(list(enumerate(DOCS)), "source_id bigint, doc string")
    q = spark.createDataFrame([(1, "saldo de estoque"), (2, "zzz")], "query_id bigint, query string")
    for s in (benchmark.Selector(), benchmark.Selector("hashed"), benchmark.Selector("hashed", "threshold", 1, 0.2), benchmark.Selector(reranker=retrieval.token_overlap_score, top_k=1)):
        got = {}
        for r in s.select(q, docs).collect():
            got.setdefault(r.query_id, set()).add(r.source_id)
        assert got == {1: {1}, 2: {0, 1, 2, 3}}
    assert benchmark.Selector("e5-base").cut().floor == 0.79 and benchmark.Selector(window=5).cut().window == 5
    for bad in ({"model": "gpt"}, {"strategy": "x"}, {"top_k": 0}):
        with pytest.raises(ValueError):
            benchmark.Selector(**bad)


def test_intermediate_tables_are_discarded(spark):
    import os

    from lavra.session import discard, materialize, shared_dir

    df = materialize(spark.range(3).selectExpr("id", "id % 2 as part"), "kept", ["part"])
    assert df.count() == 3 and df.columns == ["id", "part"]
    folder = shared_dir(spark).removeprefix("file://").removeprefix("file:")
    assert any(n.startswith("kept-") for n in os.listdir(folder))
    assert discard(spark) >= 1 and not any(n.startswith("kept-") for n in os.listdir(folder))
