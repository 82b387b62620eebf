"""Queries of the core, by name, and the SQL that gives the same rows where SQL can."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lavra.operators import nested, quality
from lavra.plans import queries as plans
from lavra.session import materialize, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = dict(plans.QUERIES)
SQL: dict[str, str] = dict(plans.SQL)


def query(name: str, sql: str | None = None):
    def register(f):
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return register


# ---------------------------------------------------------------- problem 1
@query("p1_found")
def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return nested.found(nested.flatten(table(spark, d, "catalog_raw")))


@query("p1_tables")
def p1_tables(spark: SparkSession, d: str) -> DataFrame:
    """Rows, documents, different keys and children without a parent of every flat table."""
    tables = nested.flatten(table(spark, d, "catalog_raw"))
    parents = reduce(DataFrame.unionByName, [tables[tag].select(F.col("pk").alias("parent_pk")) for tag in ("record", "source", "sheet", "column")])
    each = reduce(DataFrame.unionByName, [t.select(F.lit(tag).alias("tag"), "record_id", "pk", "parent_pk") for tag, t in tables.items()])
    lost = each.where("tag != 'record'").join(parents, "parent_pk", "left_anti").groupBy("tag").agg(F.count("*").alias("orphans"))
    rows = each.groupBy("tag").agg(F.count("*").alias("rows"), F.countDistinct("record_id").alias("documents"), F.countDistinct("pk").alias("keys"))
    return rows.join(F.broadcast(lost), "tag", "left").select("tag", "rows", "documents", "keys", F.coalesce("orphans", F.lit(0)).alias("orphans"))


# ---------------------------------------------------------------- problem 2
def _quality_inputs(spark: SparkSession, d: str) -> list[DataFrame]:
    return [table(spark, d, n) for n in ("materiais", "catalog_loads", "catalog_columns", "column_formats")]


_FORM = "codigo codigo_unidade codigo_catalogo sn situacaopartim motivopatrimonial situacaofisic motivoindisp homologar acautelado motivocautelado omcautelado obs statusdescarga docreferencia datadescarga datainclusaocarga conferido conferidoem dependencia pt team estadomaterial parecer destinomaterial boletimregional excluirmaterial justificmaterial autorizado dataautorizado homologado ultimaatualizacao motivoexcluir motivoreprovacao nec_mnt prioridade usuario_decisao_id".split()
_CELLS = " union all ".join(f"select load_id, '{c}' as column_name, cast({c} as varchar) as v from materiais" for c in _FORM)
_P2_SQL = f"""
with cells as ({_CELLS}), f as (select * from column_formats),
prof as (select load_id, column_name, count(*) as n, count(v) as m, count(distinct v) as k from cells group by all),
rates as (select *, 1 - m / n as nulls from prof),
form as (select c.load_id, c.column_name, avg(case when f.pattern is not null and not regexp_full_match(c.v, f.pattern) then 1.0 else 0.0 end) as misfit,
  max(case when try_cast(c.v as double) < f.min_value or try_cast(c.v as double) > f.max_value then 1 else 0 end) as beyond from cells c join f using (column_name) where c.v is not null group by all),
pairs as (select distinct load_id, previous_load_id from catalog_loads where previous_load_id is not null),
cat as (select load_id, column_name, v, count(*) as n from cells join f using (column_name) where kind = 'category' and v is not null group by all),
tot as (select load_id, column_name, sum(n) as t from cat group by all),
sides as (select p.load_id, c.column_name, c.v, c.n / t.t as a, 0.0 as b from pairs p join cat c on c.load_id = p.load_id join tot t on t.load_id = c.load_id and t.column_name = c.column_name where t.t >= 50
  union all select p.load_id, c.column_name, c.v, 0.0, c.n / t.t from pairs p join cat c on c.load_id = p.previous_load_id join tot t on t.load_id = c.load_id and t.column_name = c.column_name where t.t >= 50),
tv as (select load_id, column_name, sum(abs(a - b)) / 2 as d, max(sa) as sa, max(sb) as sb from (select load_id, column_name, v, sum(a) as a, sum(b) as b, max(case when a > 0 then 1 else 0 end) as sa, max(case when b > 0 then 1 else 0 end) as sb from sides group by all) group by 1, 2)
select l.load_id, '*' as column_name, 'row_count' as finding from catalog_loads l left join (select load_id, max(n) as n from prof group by 1) p using (load_id) where l.row_count <> coalesce(p.n, 0)
union select l.load_id, '*', 'column_count' from catalog_loads l left join (select load_id, count(*) filter (where m > 0) as k from prof group by 1) p using (load_id) where l.column_count <> coalesce(p.k, 0)
union select d.load_id, d.column_name, 'null_rate' from catalog_columns d join rates r using (load_id, column_name) where round(abs(d.null_rate - r.nulls), 6) > 0.02
union select d.load_id, d.column_name, 'cardinality' from catalog_columns d join rates r using (load_id, column_name) where d.cardinality <> r.k
union select load_id, column_name, 'pattern' from form where round(misfit, 6) >= 0.05
union select load_id, column_name, 'range' from form where beyond = 1
union select p.load_id, r.column_name, 'null_shift' from pairs p join rates r on r.load_id = p.load_id join rates q on q.load_id = p.previous_load_id and q.column_name = r.column_name where round(abs(r.nulls - q.nulls), 6) > 0.15
union select load_id, column_name, 'value_shift' from tv where sa = 1 and sb = 1 and round(d, 6) > 0.25
"""


@query("p2_found", _P2_SQL)
def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return quality.findings(*_quality_inputs(spark, d))


def _two_sample(spark: SparkSession, d: str) -> DataFrame:
    data, loads, _, formats = _quality_inputs(spark, d)
    counts = quality.value_counts(data, [r["column_name"] for r in formats.select("column_name").collect()])
    return quality.two_sample(data, counts, loads, formats)


@query("p2_two_sample")
def p2_two_sample(spark: SparkSession, d: str) -> DataFrame:
    return _two_sample(spark, d).select("load_id", "column_name", *[F.round(c, 6).alias(c) for c in ("auc", "ablation", "value_cross", "null_cross")])


_CATEGORIES = "column_name in (select column_name from column_formats where kind in ('category', 'flag'))"


@query("p2_distances", f"""with cells as ({_CELLS}), n as (select load_id, column_name, count(*) as n, count(v) as m from cells group by all),
pairs as (select distinct l.load_id, l.previous_load_id from catalog_loads l where l.load_id in (select load_id from n) and l.previous_load_id in (select load_id from n)),
cat as (select load_id, column_name, v, count(*) as k from cells where v is not null and {_CATEGORIES} group by all),
pr as (select p.load_id, p.previous_load_id, a.column_name, a.m as m1, b.m as m0, abs(a.m / a.n - b.m / b.n) as null_gap from pairs p join n a on a.load_id = p.load_id join n b on b.load_id = p.previous_load_id and b.column_name = a.column_name),
sides as (select b.load_id, b.column_name, c.v, c.k / b.m1 as s from pr b join cat c on c.load_id = b.load_id and c.column_name = b.column_name
  union all select b.load_id, b.column_name, c.v, -c.k / b.m0 from pr b join cat c on c.load_id = b.previous_load_id and c.column_name = b.column_name),
d as (select load_id, column_name, sum(abs(s)) / 2 as gap from (select load_id, column_name, v, sum(s) as s from sides group by all) group by 1, 2)
select load_id, column_name, round(null_gap, 6) as null_gap, round(case when m1 > 0 and m0 > 0 then coalesce(gap, 0) else 0 end, 6) as value_gap from pr left join d using (load_id, column_name) where {_CATEGORIES}""")  # fmt: skip
def p2_distances(spark: SparkSession, d: str) -> DataFrame:
    """Distances between successive loads as the one-column models give them: twice their fit."""
    formats = table(spark, d, "column_formats").where("kind in ('category', 'flag')").select("column_name")
    test = _two_sample(spark, d).join(F.broadcast(formats), "column_name")
    return test.select("load_id", "column_name", F.round(2 * F.col("null_fit"), 6).alias("null_gap"), F.round(2 * F.col("value_fit"), 6).alias("value_gap"))
