import math
from collections import Counter

import pytest

from lavra.llm import distinctive, queries
from tests.compare import connect, same


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_equals_sql(spark, data, name):
    same(queries.QUERIES[name](spark, data), connect(data), queries.SQL[name])


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.SQL)))
def test_query_runs_without_repeated_rows(spark, data, name):
    df = queries.QUERIES[name](spark, data)
    rows = df.collect()
    assert rows and (not name.endswith("_found") or len(rows) == len(set(rows)))


def test_weights_by_hand(spark):
    texts = {1: "Ação ação b-c b-c d", 2: "acao b-c e", 3: None, 4: " ", 5: "e f"}
    df = spark.createDataFrame([(k, t, "clash", 1) for k, t in texts.items()] + [(1, texts[1], "clash", 2)], "uid bigint, t string, term string, tf int")
    got = {(r.record_uid, r.term): r.weight for r in distinctive.weights(distinctive.records(df, "k", "uid", ["t"]), mu=10.0).collect()}
    tokens = {1: ["acao", "acao", "b-c", "b-c", "d"], 2: ["acao", "b-c", "e"], 5: ["e", "f"]}
    total, ctf = 10, Counter(x for t in tokens.values() for x in t)
    want = {}
    for k, t in tokens.items():
        for x, n in Counter(t).items():
            if sum(x in u for u in tokens.values()) >= 2:
                pc = ctf[x] / total
                pd = (n + 10 * pc) / (len(t) + 10)
                want[(k, x)] = pd * math.log2(pd / pc)
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in got)


def test_empty_collection(spark):
    none = spark.createDataFrame([], "uid bigint, t string")
    assert distinctive.weights(distinctive.records(none, "k", "uid", ["t"])).count() == 0


def test_hot_terms_are_complete(spark, monkeypatch):
    monkeypatch.setattr(distinctive, "HOT", 5)
    df = spark.createDataFrame([(i, "comum raro%d raro%d" % (i // 2, i // 2)) for i in range(200)], "uid bigint, t string")
    w = distinctive.weights(distinctive.records(df, "k", "uid", ["t"]))
    assert w.where("term = 'comum'").count() == 200 and w.count() == 400
    assert distinctive.typical(w).count() == 200
