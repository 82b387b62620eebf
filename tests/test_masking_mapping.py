import datetime
import hashlib
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from lavra.operators import mapping, masking
from lavra.operators.numbering import number_rows


def test_numbering_equals_row_number(spark):
    df = spark.createDataFrame([(i % 3 if i % 7 else None, (i * 37) % 101, i) for i in range(100)], "g int, o int, i int")
    got = {(r.g, r.i): r.n for r in number_rows(df, ["g"], ["o", "i"]).collect()}
    groups = {}
    for i in range(100):
        groups.setdefault(i % 3 if i % 7 else None, []).append(((i * 37) % 101, i))
    assert got == {(g, i): n + 1 for g, rows in groups.items() for n, (_, i) in enumerate(sorted(rows))}


def test_codes_are_shared_and_first_seen(spark):
    a = spark.createDataFrame([(1, " b "), (2, "a"), (3, None), (4, ""), (5, "b")], "id bigint, name string")
    b = spark.createDataFrame([(1, "c"), (2, "a")], "id bigint, other string")
    e = masking.Entity("fabricante")
    codes = masking.dictionary([(a, "id", {"name": e}), (b, "id", {"other": e})])
    assert {r.key: r.code for r in codes.collect()} == {"b": "FAB001", "a": "FAB002", "c": "FAB003"}
    assert [r.name for r in masking.mask(a, {"name": e}, codes).orderBy("id").collect()] == ["FAB001", "FAB002", None, "", "FAB001"]


def test_codes_outgrow_their_width(spark):
    df = spark.createDataFrame([(i, f"v{i}") for i in range(120)], "id bigint, s string")
    codes = masking.dictionary([(df, "id", {"s": masking.Entity("subsistema")})])
    assert {r.code for r in codes.collect()} == {f"SUB{i:02d}" for i in range(1, 121)}


def test_counters_texts_values_dates(spark):
    df = spark.createDataFrame([(1, 7.0, " x\n", "10.5", datetime.date(2024, 2, 28), "2024-01-01"), (2, None, None, "n/a", None, "then"), (3, 7.0, " ", "", None, None)], "id bigint, k double, t string, v string, d date, s string")
    rules = {"k": masking.Counter(), "t": "texto_livre", "v": "valor", "d": "data", "s": "data", "gone": "valor"}
    with pytest.warns(UserWarning):
        rows = masking.mask(df, rules, masking.dictionary([(df, "id", rules)]), "id", 2).orderBy("id").collect()
    assert [r.k for r in rows] == ["1", None, "1"]
    assert [r.t for r in rows] == ["TXT_" + hashlib.md5(b"x").hexdigest()[:8].upper(), None, " "]
    assert abs(float(rows[0].v) / 10.5 - 1) <= 0.051 and rows[1].v == "n/a" and rows[2].v == ""
    assert rows[0].d == datetime.date(2024, 3, 1) and rows[0].s.startswith("2024-01-03") and rows[1].s == "then"


def test_unknown_rule_keeps_column(spark):
    with pytest.warns(UserWarning):
        assert masking.mask(spark.createDataFrame([(1,)], "a int"), {"a": "other"}).collect() == [(1,)]


MAPPING = [("Rádio Base", "R1", 1), ("radio base", "R2", 2), ("Antena", "R3", 3), (" ", "R4", 4), ("Antena", "R5", 5)]


def test_cascade(spark):
    m = spark.createDataFrame(MAPPING, "key string, code string, ord bigint")
    values = ["Rádio Base", "radio base", "RÁDIO  BASE", "Antenna", "zzz-21", "ZZZ-21", None, "", " "]
    rows = spark.createDataFrame([(i, v, "clash") for i, v in enumerate(values)], "id bigint, item string, stage string")
    got = {r.value: (r.code, r.stage) for r in mapping.cascade(rows, "item", "id", m, mapping.FuzzyRule(0.8), ("CTR", 3, True)).collect()}
    assert got == {"Rádio Base": ("R1", "exact"), "radio base": ("R2", "exact"), "RÁDIO  BASE": ("R1", "normalized"), "Antenna": ("R3", "similarity"), "zzz-21": ("CTR001-21", "generated"), "ZZZ-21": ("CTR001-21", "generated")}


def test_fuzzy_equals_brute_force(spark):
    words = [f"{a} {b}" for a in ("radio", "antena", "modem", "painel") for b in ("naval", "fixo", "portatil", "modular")]
    m = spark.createDataFrame([(w, f"C{i}", i) for i, w in enumerate(words)], "key string, code string, ord bigint")
    asked = ["radioo naval", "antna fixo", "x", "modem", "painel modulr", "radio"]
    got = {(r.value, r.place): (r.ref, round(r.score, 9)) for r in mapping.fuzzy(spark.createDataFrame([(a,) for a in asked], "value string"), mapping.lookup(m), 2, 0.3).collect()}
    want = {}
    for a in asked:
        scored = sorted(((-SequenceMatcher(None, a, w).ratio(), i, w) for i, w in enumerate(words)))
        for n, (s, _, w) in enumerate([x for x in scored if -x[0] >= 0.3][:2]):
            want[(a, n + 1)] = (w, round(-s, 9))
    assert got == want


def test_reports_on_empty_tables(spark):
    m = spark.createDataFrame(MAPPING, "key string, code string, ord bigint")
    none = spark.createDataFrame([], "id bigint, item string, ctx string")
    resolved = mapping.cascade(none, "item", "id", m)
    assert mapping.coverage(resolved, "item").collect()[0].pct_mapped == 0
    assert mapping.unmapped(resolved).count() == 0 and mapping.contexts(none, "item", "ctx", resolved).count() == 0


def test_feedback_and_next_number(spark):
    m = spark.createDataFrame([("a", "INV007", 1), ("b", "INV003-21", 2)], "key string, code string, ord bigint")
    assert mapping.next_number(m, "INV", 3) == 8
    rows = spark.createDataFrame([(1, "new"), (2, "other")], "id bigint, invoice string")
    out = mapping.feedback(m, mapping.cascade(rows, "invoice", "id", m, None, ("INV", 3, False)))
    assert [(r.key, r.code) for r in out.orderBy("ord").collect()][2:] == [("new", "INV008"), ("other", "INV009")]


def test_remap_keeps_unknown(spark):
    codes = spark.createDataFrame([("1", "A")], "key string, code string")
    df = spark.createDataFrame([(1, 1), (2, 2), (3, None)], "id int, fk int")
    assert [r.fk for r in masking.remap(df, "fk", codes).orderBy("id").collect()] == ["A", "2", None]


def test_thresholds_include_or_not(spark):
    df = spark.createDataFrame([(0.9,)], "s double")
    assert df.select(mapping.passes(F.col("s"), mapping.FuzzyRule(0.9, True))).first()[0] and not df.select(mapping.passes(F.col("s"), mapping.FuzzyRule(0.9))).first()[0]
