import json
import zipfile

import pytest
from pyspark.sql import functions as F

from lavra.operators import catalog, profile, synthesis
from lavra.plans import agent, guard, providers, render
from lavra.sources import files, registry, rest


@pytest.mark.parametrize("sql,ok", [("select 1", True), ("WITH a AS (SELECT 1) SELECT * FROM a", True), ("select 'drop' x", True), ("drop table a", False), ("select 1; delete from a", False), ("show tables", False), ("", False), ("replace x", False)])
def test_guard(spark, sql, ok):
    assert guard.check(spark, sql).allowed is ok


def test_guard_strict_refuses_literals():
    assert not guard.check_words("select 'UPDATE'", strict=True).allowed


def plan(*steps):
    return [agent.Step(i, f"step {i}", s, agent.SourceType.SQL, agent.Operation.LIST, d, q) for i, s, d, q in steps]


def test_agent_runs_in_order_and_reports(spark):
    t = spark.createDataFrame([(1,), (2,)], "a int")
    a = agent.Agent(spark, {"sql.t": t}, lambda q: ["sql.none"], lambda q, chosen: plan((2, "sql.t", [1], "select * from sql_t where a > 5"), (1, "sql.t", [], "select * from sql_t"), (3, "sql.gone", [], None), (4, "sql.t", [], "select nothing from sql_t")))
    r = a.query("?")
    assert [x.status.value for x in r.results] == ["empty", "success", "error", "error"]
    assert r.cited == ["sql.t"] and r.has_unanswered_steps and "step 1" in r.display()
    assert a.selected("?") == ["sql.t"]


def test_agent_retries_once_with_the_error(spark):
    seen = []

    def write(step, before, error):
        seen.append(error)
        return "select a from sql_t2" if error else "select b from sql_t2"

    a = agent.Agent(spark, {"sql.t2": spark.createDataFrame([(1,)], "a int")}, lambda q: [], lambda q, c: plan((1, "sql.t2", [], None)), write)
    assert a.query("?").results[0].status is agent.Status.SUCCESS and seen[0] is None and seen[1]


def test_plan_text_is_typed():
    text = 'ok {"steps": [{"id": 1, "description": "d", "source_id": "s", "source_type": "excel", "operation": "filter", "depends_on": 0}]}'
    step = agent.parse_plan(text)[0]
    assert step.source_type is agent.SourceType.SPREADSHEETS and step.depends_on == []
    with pytest.raises(ValueError):
        agent.parse_plan(text.replace("filter", "write"))
    with pytest.raises(KeyError):
        agent.parse_plan('{"steps": [{"id": 1}]}')
    with pytest.raises(ValueError):
        agent.in_order(plan((1, "a", [2], None), (2, "a", [1], None)))


def test_merge_keeps_manual_text(spark):
    old = spark.createDataFrame([("sql", "a", "people wrote this", 1), ("sql", "b", "[MANUAL]", 1), ("sql", "c", None, 1)], "source_type string, source_key string, description string, row_count bigint")
    new = spark.createDataFrame([("sql", "a", "x", 5, None), ("sql", "b", "y", 6, None), ("sql", "d", "z", 7, None), ("sql", "c", "w", 9, "failed")], "source_type string, source_key string, description string, row_count bigint, error string")
    got = {r.source_key: (r.description, r.row_count) for r in catalog.merge(old, new).collect()}
    assert got == {"a": ("people wrote this", 5), "b": ("y", 6), "c": (None, 1), "d": ("z", 7)}


def test_documents_use_hint_or_parts(spark):
    s = spark.createDataFrame([("s1", "n_a", "hint", "d", "r"), ("s2", "n_b", "[MANUAL]", "d", None), ("s3", "n_c", None, None, "")], "source_id string, name string, embedding_hint string, description string, business_role string")
    c = spark.createDataFrame([("s2", "ID", 1), ("s2", "col", 2)], "source_id string, column_name string, ordinal int")
    got = {r.source_id: r.doc for r in catalog.source_documents(s, c).collect()}
    assert got == {"s1": "hint", "s2": "n_b\nd\nn b\ncol", "s3": "n_c\nn c\nn c"}


def test_json_types(spark):
    df = spark.createDataFrame([(1, '{"a": 1, "b": 1.5, "c": true, "d": "2024-01-01", "e": "http://x", "f": "AB-1", "g": "some text", "h": null, "i": [1, 2], "j": {"k": 1}}'), (2, "broken"), (3, None)], "id int, p string")
    got = {r.field: r.type for r in catalog.json_fields(df, "id", "p").collect()}
    assert got == {"a": "integer", "b": "float", "c": "boolean", "d": "date_string (ISO 8601)", "e": "url_string", "f": "code_identifier", "g": "string", "h": "null|unknown", "i": "array[bigint]", "j": "object"}
    shapes = spark.createDataFrame([('{"count": 3, "next": null, "results": [{"a": 1}]}',), ("[1]",), ("{}",), ("x",)], "p string").select(catalog.response_shape(F.col("p")), catalog.paginated(F.col("p")).alias("g")).collect()
    assert [r[0] for r in shapes] == ["paginated", "array", "object", "unknown"] and shapes[0].g["count"] == 3 and json.loads(shapes[0].g.first_item) == {"a": 1}


def test_profile_of_empty_and_nan(spark):
    empty = spark.createDataFrame([], "a int, b string")
    assert {(r.column_name, r.row_count, r.null_rate, r.is_unique_key) for r in profile.profile(empty).collect()} == {("a", 0, 0.0, False), ("b", 0, 0.0, False)}
    r = profile.profile(spark.createDataFrame([(float("nan"),), (1.0,), (2.0,)], "v double")).first()
    assert (r.null_rate, r.cardinality, r.min_v, r.max_v, r.mean_v) == (0.3333, 2, 1.0, 2.0, 1.5)
    big = profile.profile(spark.range(1000), exact_limit=100).first()
    assert big.cardinality_kind == "approximate" and abs(big.cardinality - 1000) < 150


def test_keys_of_large_tables_are_keys_in_the_catalog(spark):
    r = catalog.catalog_columns("sql.big", spark.range(150_000)).first()
    assert r.cardinality == 150_000 and r.is_unique_key
    assert profile.profile(spark.range(1000), exact_limit=100).first().is_unique_key is None


def test_semantic_types(spark):
    df = spark.createDataFrame([(i, i % 2, f"2024-01-{i % 28 + 1:02d}", "AB-12", "12.345.678/0001", "free text", None, 1.5, True) for i in range(60)], "id int, flag int, d string, code string, doc string, t string, n string, f double, b boolean")
    got = {r.column_name: r.semantic_type for r in profile.semantic_types(df, ["id"]).collect()}
    assert got == {"id": "integer", "flag": "boolean_integer", "d": "date_string", "code": "code_identifier", "doc": "document_number", "t": "string", "n": "string", "f": "float", "b": "boolean"}


def workbook(path, sheets):
    with zipfile.ZipFile(path, "w") as z:
        ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
        listed = "".join(f'<sheet name="{n}" sheetId="{i}" r:id="rId{i}"/>' for i, n in enumerate(sheets, 1))
        z.writestr("xl/workbook.xml", f'<workbook {ns} xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets>{listed}</sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", "<Relationships>" + "".join(f'<Relationship Id="rId{i}" Target="worksheets/s{i}.xml"/>' for i in range(1, len(sheets) + 1)) + "</Relationships>")
        z.writestr("xl/sharedStrings.xml", f"<sst {ns}><si><t>shared</t></si></sst>")
        for i, rows in enumerate(sheets.values(), 1):
            body = "".join("<row>" + "".join(f'<c r="{chr(65 + c)}{r}" t="{t}">' + (f"<is><t>{v}</t></is>" if t == "inlineStr" else f"<v>{v}</v>") + "</c>" for c, t, v in cells) + "</row>" for r, cells in enumerate(rows, 1))
            z.writestr(f"xl/worksheets/s{i}.xml", f"<worksheet {ns}><sheetData>{body}</sheetData></worksheet>")


def test_workbooks(spark, tmp_path):
    s = "inlineStr"
    workbook(tmp_path / "w.xlsx", {"one": [[(0, s, "a"), (1, s, "b")], [(0, "n", "1"), (1, "s", "0")], [(1, s, "y")]], "two": [[(0, s, "a"), (1, s, "c")], [(1, "n", "2.5")]]})
    got = {(r._sheet, r._row, r.a, r.b, r.c) for r in files.read_workbook(spark, str(tmp_path / "*.xlsx")).collect()}
    assert got == {("one", 1, "1", "shared", None), ("one", 2, None, "y", None), ("two", 1, None, None, "2.5")}
    assert set(files.read_any(spark, str(tmp_path / "w.xlsx"))) == {"one", "two"}
    with pytest.raises(ValueError):
        files.read_any(spark, "a.ods")


def test_csv_text_keeps_empty_cells(spark, tmp_path):
    (tmp_path / "a.csv").write_text('﻿x,y\n1,\n"",NA\n', encoding="utf-8")
    rows = files.read_csv_text(spark, str(tmp_path / "a.csv"))
    assert rows.columns == ["x", "y"] and {tuple(r) for r in rows.collect()} == {("1", ""), ("", "NA")}
    files.write_csv(rows.limit(0), str(tmp_path / "out"))


def test_results_and_filters(spark, tmp_path):
    (tmp_path / "results_m1.json").write_text(json.dumps({"all_results": [{"id": "Q1", "f1": 0.5, "difficulty": "x", "cluster": "k"}, {"id": "Q1", "f1": 0.7, "difficulty": "x", "cluster": "k"}, {"id": "Q2", "f1": 1.0, "difficulty": "y", "cluster": "k"}]}))
    r = files.read_results(spark, str(tmp_path / "results_*.json"))
    assert {tuple(x) for x in files.per_query_metric(r, "f1").collect()} == {("m1", "Q1", 0.7), ("m1", "Q2", 1.0)}
    with pytest.raises(ValueError):
        files.per_query_metric(r, "f1", difficulty="none")


def test_rest_pages_and_template(spark, tmp_path):
    (tmp_path / "api_a_1.json").write_text('{"count": 1}')
    got = {(r.path, r.page): r.status for r in rest.read_rest(spark, f"file:{tmp_path}/", ["/api/a/"], pages=2).collect()}
    assert got == {("/api/a/", 1): "ok", ("/api/a/", 2): "offline"}


def test_registry(spark):
    r = registry.Registry(spark)
    r.add("sql.a", lambda: spark.range(2))
    r.add("sql.bad", lambda: spark.table("missing_table"))
    good, bad = r.load_all()
    assert set(good) == {"sql.a"} and set(bad) == {"sql.bad"} and r.ids(["sql.bad"]) == ["sql.a"]
    assert registry.connection_url("x", {"DB_URL": "u", "DB_URL_X": "v"}) == "v"
    with pytest.raises(KeyError):
        registry.connection_url("x", {})
    assert set(registry.demo_tables(spark)) == {"fabricantes", "materiais", "unidades", "movimentacoes"}


def test_synthesis_keeps_shape(spark):
    df = spark.createDataFrame([(i, float(i % 50), 2.0 * (i % 50) + 1, "ab"[i % 2], None if i % 4 == 0 else i) for i in range(400)], "id bigint, x double, y double, c string, n bigint")
    out = synthesis.synthesize(df, 1000, key="id")
    r = out.agg(F.count("*"), F.countDistinct("id"), F.corr("x", "y"), F.avg("x"), F.avg(F.col("n").isNull().cast("int"))).first()
    assert r[0] == r[1] == 1000 and r[2] > 0.95 and abs(r[3] - 24.5) < 2 and abs(r[4] - 0.25) < 0.06
    assert out.dtypes == df.dtypes and {x.c for x in out.select("c").distinct().collect()} == {"a", "b"}
    assert synthesis.synthesize(df.limit(0)).count() == 0


def test_rare_values_are_scored_and_drawn(spark, monkeypatch):
    monkeypatch.setattr(synthesis, "TOP_VALUES", 20)
    names = [f"v{i:02d}" for i in range(60) for _ in range(40 if i < 5 else 4)] + [None] * 60
    df = spark.createDataFrame([(i, x, float(i)) for i, x in enumerate(names)], "id bigint, c string, y double")
    out = synthesis.synthesize(df, 4000, key="id")
    share = {r.c: r.n / 4000 for r in out.groupBy("c").agg(F.count("*").alias("n")).collect()}
    assert set(share) == set(names) and out.dtypes == df.dtypes
    assert all(abs(share[x] - names.count(x) / len(names)) < 0.03 for x in share)


def test_synthetic_children_have_parents(spark):
    p = spark.createDataFrame([(i, f"p{i}") for i in range(1, 51)], "pk bigint, name string")
    c = spark.createDataFrame([(i, 1 if i % 3 == 0 else i % 50 + 1, 1.0 * i) for i in range(1, 301)], "ck bigint, pk bigint, v double")
    made, dropped = synthesis.synthesize_database({"c": c, "p": p}, {"c": "ck", "p": "pk"}, [("c", "pk", "p", "pk"), ("p", "pk", "c", "ck")])
    assert dropped == [("p", "c")] and made["c"].count() == 300 and made["c"].join(made["p"], "pk", "left_anti").count() == 0
    assert made["c"].groupBy("pk").count().agg(F.max("count")).first()[0] > 60


def test_rendering(spark):
    s = spark.createDataFrame([("sql.a", "d", "[MANUAL]", None, None, None, None, None, None), ("api.b", None, None, None, None, "/b", "GET", 1200, "h" * 200)], "source_id string, description string, business_role string, when_to_use string, when_not_to_use string, path string, method string, row_count bigint, embedding_hint string")
    text = render.context("q", render.source_blocks(s))
    assert "### sql.a" in text and "**Linhas:** ?" in text and "1,200" in text and "MANUAL" not in text and text.endswith("2 fontes")
    assert "h" * 130 in render.system_prompt(render.compressed_lines(s)) and "h" * 131 not in render.system_prompt(render.compressed_lines(s))


def test_workbook_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, "a & <b>"), (2, None)], "id int, t string")
    files.write_workbook({"one": df, "two": df.limit(0)}, str(tmp_path / "out.xlsx"))
    assert {(r.id, r.t) for r in files.read_workbook(spark, str(tmp_path / "out.xlsx"), "one").collect()} == {("1", "a & <b>"), ("2", None)}
    assert files.read_workbook(spark, str(tmp_path / "out.xlsx"), "two").count() == 0


def test_folder_and_metadata(spark, tmp_path):
    spark.range(3).write.parquet(str(tmp_path / "a.parquet"))
    assert registry.folder(spark, str(tmp_path))["sql.a"].count() == 3
    p, c = spark.createDataFrame([(1,)], "pk int"), spark.createDataFrame([(1, 1, "x")], "ck int, pk int, s string")
    made = synthesis.metadata({"p": p, "c": c}, [("p", "pk"), ("c", "ck")], [("c", "pk", "p", "pk"), ("p", "pk", "c", "ck"), ("c", "no", "p", "pk")])
    assert (made["applied"], made["invalid"]) == (1, 2) and made["tables"]["c"]["columns"] == {"ck": "id", "pk": "id", "s": "categorical"}
    synthesis.save_metadata(made, str(tmp_path / "m.json"))
    assert json.loads((tmp_path / "m.json").read_text())["relationships"][0]["parent"] == "p"


def test_providers_drive_an_agent(spark):
    from lavra.plans import providers

    calls = []

    def opener(request, timeout):
        body = json.loads(request.data)
        calls.append(body)
        if len(calls) == 1:
            raise OSError("down")
        system = body["messages"][0]["content"]
        text = {providers.PLAN_PROMPT: '{"steps": [{"id": 1, "description": "d", "source_id": "sql.t3", "source_type": "sql", "operation": "list"}]}', providers.SQL_PROMPT: "```sql\nselect a from sql_t3\n```", providers.ANSWER_PROMPT: "há um"}[system]
        return json.dumps({"message": {"content": text}, "eval_count": 2, "prompt_eval_count": 3}).encode()

    p = providers.HttpProvider("ollama", "http://localhost/api/chat", "m", pause=0.0, opener=opener)
    describe = lambda s: render.schema_prompt(s, spark.createDataFrame([(1,)], "a int"))
    a = agent.Agent(spark, {"sql.t3": spark.createDataFrame([(1,)], "a int")}, lambda q: [], providers.planner(p, describe), providers.sql_writer(p, describe), providers.answerer(p))
    r = a.query("quantos?")
    assert r.answer == "há um" and r.results[0].rows == [{"a": 1}] and p.tokens == 15 and len(calls) == 4
    with pytest.raises(ValueError):
        providers.HttpProvider("other", "u", "m")


def _plan(kind):
    return agent.parse_plan(json.dumps({"steps": [{"id": 1, "description": "all", "source_id": f"{kind}.t", "source_type": kind, "operation": "list"}]}))


def test_steps_without_an_executor_end_with_an_error(spark):
    t = spark.range(3)
    a = agent.Agent(spark, {"sql.t": t, "api.t": t}, lambda q: ["api.t"], lambda q, chosen: _plan("api"))
    r = a.query("?").results[0]
    assert r.status is agent.Status.ERROR and "api" in r.error and not r.rows
    b = agent.Agent(spark, {"api.t": t}, lambda q: ["api.t"], lambda q, chosen: _plan("api"), executable=frozenset(agent.SourceType))
    assert b.query("?").results[0].row_count == 3


def test_display_has_three_layers(spark):
    a = agent.Agent(spark, {"sql.t": spark.range(3)}, lambda q: ["sql.t"], lambda q, chosen: _plan("sql") + [agent.Step(2, "none", "sql.gone", agent.SourceType.SQL, agent.Operation.LIST)])
    shown = a.query("quantos?").display()
    assert "- sql.t" in shown and "SELECT * FROM sql_t" in shown and "linhas: 3" in shown and "erro: unknown source sql.gone" in shown and "Fontes consultadas: sql.t" in shown


def test_json_mode_and_gemini():
    sent = []

    def opener(request, timeout):
        sent.append((dict(request.header_items()), json.loads(request.data)))
        return json.dumps({"candidates": [{"content": {"parts": [{"text": '{"a": 1}'}]}}], "usageMetadata": {"totalTokenCount": 5}, "message": {"content": 'x {"a": 2} y'}, "choices": [{"message": {"content": '{"a": 3}'}}]}).encode()

    g = providers.HttpProvider("gemini", "http://localhost/g", "m", key="k", opener=opener)
    assert g.chat_json("s", "u") == {"a": 1} and g.tokens == 5 and sent[-1][1]["generationConfig"] == {"responseMimeType": "application/json"} and sent[-1][1]["contents"][0]["parts"][0]["text"] == "s\n\nu"
    o = providers.HttpProvider("ollama", "http://localhost/o", "m", opener=opener)
    assert o.chat_json("s", "u", {"type": "object"}) == {"a": 2} and sent[-1][1]["format"] == {"type": "object"}
    z = providers.HttpProvider("azure", "http://localhost/z", "m", key="k", opener=opener)
    assert z.chat_json("s", "u") == {"a": 3} and sent[-1][1]["response_format"] == {"type": "json_object"}
    with pytest.raises(ValueError):
        providers.HttpProvider("gemini", "u", "m", key="")


def test_declared_keys_without_excluded_tables(spark):
    tables = spark.createDataFrame([("b",), ("a",), ("sec_users",)], "t string")
    pk = spark.createDataFrame([("a", "id"), ("sec_users", "id")], "t string, c string")
    fk = spark.createDataFrame([("b", "a_id", "a", "id"), ("b", "u", "sec_users", "id"), ("auth_group", "x", "a", "id")], "t string, c string, rt string, rc string")
    run = lambda q: tables if ".tables" in q else fk if "referenced_table_name" in q else pk
    assert registry.base_tables(run) == ["a", "b"] and len(registry.EXCLUDED_TABLES) == 21
    keys, refs = registry.declared_keys(run)
    assert [tuple(r) for r in keys.collect()] == [("a", "id")] and [tuple(r) for r in refs.collect()] == [("b", "a_id", "a", "id")]
    told = registry.with_keys(registry.columns_of(spark.createDataFrame([], "id bigint, a_id bigint")), "b", keys, refs)
    assert {(r.column_name, r.is_pk, r.references) for r in told.collect()} == {("id", False, None), ("a_id", False, "a.id")}


def test_workbooks_that_fail_stop_no_others(spark, tmp_path):
    good, broken, old = (str(tmp_path / n) for n in ("g.xlsx", "b.xlsx", "o.xls"))
    files.write_workbook({"um": spark.range(2), "dois": spark.range(3)}, good)
    for p in (broken, old):
        with open(p, "wb") as f:
            f.write(b"no archive")
    tables, errors = files.read_workbooks(spark, [good, broken, old, str(tmp_path / "gone.xlsx")])
    assert {k: t.count() for k, t in tables.items()} == {(good, "um"): 2, (good, "dois"): 3}
    assert set(errors) == {(broken, ""), (old, ""), (str(tmp_path / "gone.xlsx"), "")}


def test_sinks_and_dictionary(spark, tmp_path):
    df = spark.createDataFrame([("á", None), ("b", 2)], "nome string, n int")
    files.write_csv(df, f"file://{tmp_path}/c", mark=True)
    text = "".join(p.read_text(encoding="utf-8") for p in (tmp_path / "c").glob("*.csv"))
    assert text.startswith("\ufeffnome,n") and files.read_csv(spark, f"file://{tmp_path}/c").columns == ["nome", "n"]
    files.write_json_array(df, str(tmp_path / "a.json"))
    assert json.loads((tmp_path / "a.json").read_text(encoding="utf-8")) == [{"nome": "á", "n": None}, {"nome": "b", "n": 2}]
    (tmp_path / "d.json").write_text(json.dumps({"sigla": {"x": "S1", "y": "S2"}, "_counter_sigla": 2}), encoding="utf-8")
    assert {tuple(r) for r in files.read_dictionary(spark, str(tmp_path / "d.json")).collect()} == {("sigla", "x", "S1", 0), ("sigla", "y", "S2", 1)}


def test_index_is_stored_until_the_catalog_changes(spark, tmp_path):
    made = []

    def make():
        made.append(1)
        return spark.createDataFrame([("sql.t", [1.0, 2.0])], "source_id string, vector array<double>")

    path = f"file://{tmp_path}/index"
    for text, count in (("a", 1), ("a", 1), ("b", 2)):
        assert files.cached_index(spark, path, text, make).count() == 1 and len(made) == count


def test_blocks_of_endpoints_and_workbooks_and_footer(spark):
    sources = spark.createDataFrame([("api.e", "um", "/x"), ("spreadsheets.f", "dois", None)], "source_id string, description string, path string")
    for c in ("business_role", "when_to_use", "when_not_to_use", "method"):
        sources = sources.withColumn(c, F.lit(None).cast("string"))
    sources = sources.withColumn("row_count", F.lit(None).cast("bigint"))
    fields = spark.createDataFrame([("api.e", 0, "k", "string", "y" * 40)], "source_id string, ordinal int, column_name string, native_type string, example string")
    sheets = spark.createDataFrame([("spreadsheets.f", 0, "Plan1", 1200, ["a", "b"])], "source_id string, ordinal int, sheet string, row_count bigint, columns array<string>")
    blocks = render.full_blocks(sources, None, fields, sheets)
    got = {r.source_id: r.block for r in blocks.collect()}
    assert "| k | string | " + "y" * 30 + "... |" in got["api.e"] and "- **Plan1** (1,200 linhas): a, b" in got["spreadsheets.f"]
    text = render.context("q?", blocks, ["api.e"], [("r1", "tem endpoint")])
    assert "1 de 2 fontes" in text and "- r1: tem endpoint" in text and "spreadsheets.f" not in text
    assert "### api.e" in render.system_prompt(blocks)


def test_draws_are_even_and_free_of_their_neighbours():
    import numpy as np

    u = synthesis.uniform(np.arange(20_000), 4, 42)
    assert abs(u.mean() - 0.5) < 0.01 and abs(u.std() - 12**-0.5) < 0.01 and u.min() >= 0 and u.max() < 1
    c = np.corrcoef(np.concatenate([u, np.roll(u, 1, axis=0)], axis=1).T)
    assert np.abs(c - np.eye(8)).max() < 0.03
    assert (synthesis.uniform(np.array([7]), 4, 42) == u[7]).all() and not (synthesis.uniform(np.array([7]), 4, 43) == u[7]).any()
