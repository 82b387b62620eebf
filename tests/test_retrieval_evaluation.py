import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lavra.functions import text as X
from lavra.operators import evaluation, retrieval, statistics
from lavra.plans.queries import QUERIES
from lavra.session import table


def ranking(spark, scores):
    rows = [(q, f"s{i}", s) for q, of in scores.items() for i, s in enumerate(of)]
    return retrieval.ranked(spark.createDataFrame(rows, "query_id int, source_id string, score double"))


@pytest.mark.parametrize("window,want", [(4, 1), (5, 4)])
def test_gap_window_decides(spark, window, want):
    r = ranking(spark, {1: [0.9, 0.8, 0.75, 0.7, 0.3]})
    got = retrieval.cut(r, retrieval.Cut("score_gap", 4, 0.0, window)).count()
    assert got == want


def test_first_gap_wins_and_floor_empties(spark):
    r = ranking(spark, {1: [0.75, 0.5, 0.25], 2: [0.2, 0.1], 3: [0.9]})
    got = {(x.query_id, x.source_id) for x in retrieval.cut(r, retrieval.Cut("score_gap", 3, 0.30, 4)).collect()}
    assert got == {(1, "s0"), (3, "s0")}
    sources = spark.createDataFrame([("a",), ("b",)], "source_id string")
    queries = spark.createDataFrame([(1,), (2,), (3,)], "query_id int")
    full = retrieval.fallback(retrieval.cut(r, retrieval.Cut()), queries, sources)
    assert {x.source_id for x in full.where("query_id = 2").collect()} == {"a", "b"}


def test_ties_keep_source_order(spark):
    assert [r.source_id for r in ranking(spark, {1: [0.5, 0.5, 0.5]}).orderBy("rank").collect()] == ["s0", "s1", "s2"]


def test_strategy_is_checked():
    with pytest.raises(ValueError):
        retrieval.Cut("best")


def test_cosine_equals_numpy(spark):
    rng = np.random.default_rng(1)
    v = rng.normal(size=(60, 8)).astype(np.float32)
    v[7] = 0
    df = spark.createDataFrame([(i, [float(x) for x in v[i]], "x") for i in range(60)] + [(99, None, "x")], "vec_id bigint, embedding array<float>, rank string")
    got = {(r.query_id, r.rank): r.source_id for r in retrieval.cosine_top_k(df.where("vec_id % 20 = 0"), df, 3).collect()}
    n = v.astype(float) / np.maximum(np.linalg.norm(v.astype(float), axis=1, keepdims=True), 1e-30)
    for q in (0, 20, 40):
        best = np.lexsort((np.arange(60), -(n @ n[q]).round(12)))[:3]
        assert [got[(q, k + 1)] for k in range(3)] == list(best)


def test_keyword_rules(spark):
    rules = spark.createDataFrame([(1, ["Saldo"], ["sql.a"], ["api.b"]), (2, ["[MANUAL]"], ["sql.z"], None)], "rule_id int, trigger_keywords array<string>, include_sources array<string>, complement_with array<string>")
    sources = spark.createDataFrame([("sql.a",), ("api.b",), ("sql.c",)], "source_id string")
    q = spark.createDataFrame([(1, "Qual o SALDO?"), (2, "outra"), (3, None)], "query_id int, query string")
    got = {}
    for r in retrieval.keyword_route(q, rules, sources).collect():
        got.setdefault(r.query_id, set()).add(r.source_id)
    assert got == {1: {"sql.a", "api.b"}, 2: {"sql.a", "api.b", "sql.c"}, 3: {"sql.a", "api.b", "sql.c"}}


def test_selection_lists_by_type_or_score(spark):
    s = spark.createDataFrame([(1, "api.x", 1), (1, "sql.y", 2)], "query_id int, source_id string, rank int")
    assert retrieval.selection_lists(s).first().selected == ["sql.y", "api.x"]
    assert retrieval.selection_lists(s, "score").first().selected == ["api.x", "sql.y"]


def test_metrics_by_hand(spark):
    df = spark.createDataFrame([(1, ["a", "c", "x"], ["a", "b"], ["c"], ["x"]), (2, [], ["a"], [], []), (3, ["q"], [], [], None), (4, None, None, None, None)], "i int, selected array<string>, expected_primary array<string>, expected_complement array<string>, must_not_include array<string>")
    r = {x.i: x for x in evaluation.metrics(df).collect()}
    dcg = 2 + 1 / math.log2(3)
    best = 2 + 2 / math.log2(3) + 1 / math.log2(4)
    assert (r[1].precision, r[1].recall, r[1].top1_acc, r[1].error_rate, r[1].ndcg) == (0.6667, 0.5, 1.0, 1.0, round(dcg / best, 4))
    assert (r[2].precision, r[2].recall, r[2].f1) == (0.0, 0.0, 0.0)
    assert (r[3].precision, r[3].recall, r[4].recall, r[4].ndcg) == (0.0, 1.0, 1.0, 0.0)


def test_folds_are_balanced(spark):
    q = spark.createDataFrame([(i, "abc"[i % 3]) for i in range(47)], "query_id int, difficulty string")
    for r in evaluation.fold_distribution(evaluation.folds(q)).collect():
        assert r.queries in (3, 4)


def test_holm_by_hand(spark):
    t = spark.createDataFrame([("f", 0.01), ("f", 0.04), ("f", 0.03), ("g", 0.2)], "family string, p_raw double")
    got = {(r.family, r.p_raw): (round(r.p_holm, 6), r.significant) for r in statistics.holm(t, ["family"]).collect()}
    assert got == {("f", 0.01): (0.03, True), ("f", 0.03): (0.06, False), ("f", 0.04): (0.06, False), ("g", 0.2): (0.2, False)}


@pytest.mark.parametrize("name", ["bootstrap_ranking", "bootstrap_interaction", "ablation_steps"])
def test_paired_tests_take_all_queries_and_resamples(spark, data, monkeypatch, name):
    made, real = [], statistics._bootstrap
    monkeypatch.setattr(statistics, "_bootstrap", lambda stat, n_boot, seed: made.append(n_boot) or real(stat, n_boot, seed))
    rows = QUERIES[name](spark, data).collect()
    every = table(spark, data, "benchmark_queries").count()
    assert set(made) == {10_000} and rows and (name == "bootstrap_interaction" or {r.n for r in rows} == {every})


def test_bootstrap_repeats_and_signs(spark):
    rows = [("x", i, 0.5 + i / 100, 0.4 + i / 100) for i in range(20)] + [("y", i, float(i % 2), float((i + 1) % 2)) for i in range(20)]
    pairs = spark.createDataFrame(rows, "comparison string, key int, a double, b double")
    one, two = (sorted(map(tuple, statistics.bootstrap(pairs, "mean", 500).collect())) for _ in range(2))
    assert one == two and one[0][3] == 0.0 and abs(one[0][2] - 0.1) < 1e-9 and one[1][3] > 0.5


def test_pairing_needs_equal_ids(spark):
    a, b = spark.createDataFrame([(1, 0.5)], "k int, v double"), spark.createDataFrame([(2, 0.5)], "k int, v double")
    with pytest.raises(ValueError):
        statistics.paired(a, b, "k", "v")


def test_bands_share_ties(spark):
    df = spark.createDataFrame([(x,) for x in (0.0, 0.0, 0.0, 0.5, 0.5, 1.0)] + [(None,)], "v double")
    edges = statistics.band_edges(df, "v")
    got = {r.v: r.b for r in df.select("v", statistics.band(F.col("v"), edges).alias("b")).collect()}
    assert got[None] is None and len({got[0.0], got[1.0]}) == 2


def test_version_steps():
    assert statistics.version_steps(["a", "b", "c"]) == [("a", "b"), ("b", "c"), ("a", "c")] and statistics.version_steps(["a", "b"]) == [("a", "b")]


def test_text_functions(spark):
    df = spark.createDataFrame([("Situação  das\tInformações",)], "t string")
    assert df.select(X.normalize_text(F.col("t"))).first()[0] == "situacao das informacoes"
    assert df.select(X.bm25_tokens(F.col("t"))).first()[0] == ["situação", "das", "informações"]
    assert df.select(X.content_tokens(F.col("t"), stem=True)).first()[0] == ["situacao", "informao"]
    stems = {w: df.select(X.light_stem(F.lit(w))).first()[0] for w in ("terminais", "papeis", "distribuicoes", "bens", "casas", "mas", "oes")}
    assert stems == {"terminais": "terminal", "papeis": "papel", "distribuicoes": "distribuiao", "bens": "bens", "casas": "casa", "mas": "mas", "oes": "oes"}
    answers = ['{"sources": ["sql.a"]}', 'é {"sources": ["api.b"]} sim', "uso sql.a e sql.a e api.b_c", "nada"]
    got = [r[0] for r in spark.createDataFrame([(a,) for a in answers], "a string").select(X.parse_source_list(F.col("a"))).collect()]
    assert got == [["sql.a"], ["api.b"], ["sql.a", "api.b_c"], []]


def test_blocks_meet_by_key_as_in_one_pass(spark, monkeypatch):
    import random

    rng = random.Random(9)
    df = spark.createDataFrame([(i, [rng.gauss(0, 1) for _ in range(4)]) for i in range(300)] + [(300, [0.0] * 4), (301, None)], "vec_id bigint, embedding array<double>")
    asked = df.where("vec_id % 20 = 0")
    rows = lambda t: {(r.query_id, r.rank, r.source_id) for r in t.collect()}
    whole = rows(retrieval.cosine_top_k(asked, df, 3))
    for name, value in (("BROADCAST_CELLS", 0), ("QUERY_BLOCK", 5), ("VECTOR_PART", 40)):
        monkeypatch.setattr(retrieval, name, value)
    assert rows(retrieval.cosine_top_k(asked, df, 3)) == whole and len(whole) == 16 * 3
    assert retrieval.cosine_scores(asked, df).count() == 16 * 301


def test_prefixes_and_catalog_texts(spark):
    from lavra.operators import statistics
    from lavra.plans import benchmark

    assert benchmark.Selector("e5-base").prefixes() == ("query: ", "passage: ") and benchmark.Selector("e5-large-instruct", task="T").prefixes() == ("Instruct: T\nQuery: ", "passage: ")
    sources = spark.createDataFrame([("sql.t", "h", "d", "", None), ("sql.t", "h", "d", "", None)], "source_id string, embedding_hint string, description string, business_role string, when_to_use string")
    columns = spark.createDataFrame([("sql.t", "b", 1, "dois"), ("sql.t", "a", 0, None)], "source_id string, column_name string, ordinal int, description string")
    assert [tuple(r) for r in statistics.catalog_texts(sources, columns).collect()] == [("sql.t", "h d a b dois")]


def test_dictionary_in_blocks_reads_as_one(spark, monkeypatch):
    from lavra.operators import mapping

    refs = mapping.lookup(spark.createDataFrame([(f"nome {c}", c, i) for i, c in enumerate("abcdefgh")], "key string, code string, ord bigint"))
    values = spark.createDataFrame([("nome a",), ("nomes c",), ("nome",), (None,)], "value string")
    rows = lambda: {tuple(r) for r in mapping.fuzzy(values, refs, 2).collect()}
    whole = rows()
    monkeypatch.setattr(mapping, "REFERENCE_ROWS", 3)
    assert rows() == whole and len(whole) == 6


@pytest.mark.parametrize("words,parts", [(3, 1), (40, 1), (400, 7)])
def test_best_pairs_equal_all_pairs_scored(spark, monkeypatch, words, parts):
    import random

    rng = random.Random(words)
    text = lambda n: " ".join(f"w{int(words * rng.random() ** 3)}" for _ in range(rng.randrange(n)))
    docs = spark.createDataFrame([(f"s{i}", text(12) or None) for i in range(200)], "source_id string, doc string")
    asked = spark.createDataFrame([(i, text(9) + " unknown") for i in range(60)] + [(60, None)], "query_id bigint, query string")
    nine = lambda t: {(r.query_id, r.rank, r.source_id, round(r.normalized, 6)) for r in retrieval.ranked(t.withColumn("r9", F.round("normalized", 9)), "r9", 4).collect()}
    monkeypatch.setattr(retrieval, "DOC_PART", -(-200 // parts))
    monkeypatch.setattr(retrieval, "ASKED_BLOCK", 25)
    assert nine(retrieval.bm25_top_k(asked, docs, 4)) == nine(retrieval.bm25_scores(asked, *retrieval.bm25_index(docs)))


@pytest.mark.parametrize("name", ["bm25_selected", "bm25_top", "rerank"])
def test_every_question_is_answered(spark, data, name):
    docs = table(spark, data, "catalog_sources").groupBy("source_uid").agg(F.max("embedding_hint").alias("h"), F.max("description").alias("t"))
    known = docs.select(F.explode(X.bm25_tokens(F.coalesce("h", "t", F.lit("")))).alias("w")).distinct()
    asked = table(spark, data, "benchmark_queries").select("query_uid", F.explode(X.bm25_tokens(F.col("query"))).alias("w"))
    want = {r[0] for r in asked.join(known, "w").select("query_uid").distinct().collect()}
    assert {r.query_id for r in QUERIES[name](spark, data).collect()} == want and len(want) > 2


def test_hashed_draws_are_those_of_the_sql_and_no_rows(spark):
    import hashlib

    rng = np.random.default_rng(3)
    of = {"x": rng.normal(size=1200), "y": rng.normal(size=1200), "z": rng.normal(size=7)}
    rows = [(name, i, float(v), None if name == "y" and i % 5 == 0 else 0.0) for name, d in of.items() for i, v in enumerate(d)]
    got = statistics.bootstrap_sql(spark.createDataFrame(rows, "comparison string, key int, a double, b double"), 120)
    assert "md5" not in got._jdf.queryExecution().toString().lower()
    told = {r.comparison: r for r in got.collect()}
    for name, d in of.items():
        d = np.where(np.arange(len(d)) % 5 == 0, np.nan, d) if name == "y" else d
        at = [[int(hashlib.md5(f"42|{b}|{s}".encode()).hexdigest()[:8], 16) % len(d) for s in range(len(d))] for b in range(120)]
        low, high = np.quantile([np.nanmean(d[i]) for i in at], [0.025, 0.975])
        assert told[name].n == len(d) and abs(told[name].ci_low - low) < 1e-12 and abs(told[name].ci_high - high) < 1e-12
