"""Queries over the catalog, masking, mapping, retrieval, evaluation, statistics, plan, synthesis and streaming operators, with their SQL."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lavra.functions import text as X
from lavra.operators import catalog, evaluation, mapping, masking, profile, retrieval, statistics, synthesis
from lavra.plans import agent, guard, render
from lavra.session import materialize, shared_dir, table
from lavra.sources import registry
from lavra.streaming import windows

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(f):
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return register


# ================================================================ profiles
LINEITEM = "l_orderkey l_partkey l_suppkey l_linenumber l_quantity l_extendedprice l_discount l_tax l_returnflag l_linestatus l_shipdate".split()
_FRACTIONS = {"l_quantity", "l_extendedprice", "l_discount", "l_tax"}
_NUMBERS = set(LINEITEM[:8])


def _profile_sql(t: str, columns: list[str]) -> str:
    part = "select '{c}' as column_name, cast(count(*) as bigint) as row_count, round(avg(case when {c} is null then 1.0 else 0.0 end), 4) as null_rate, cast(count(distinct {c}) as bigint) as cardinality, count(*) > 0 and count(distinct {c}) = count(*) as is_unique_key from {t}"
    return " union all ".join(part.format(c=c, t=t) for c in columns)


@query("profile_lineitem", _profile_sql("lineitem", LINEITEM))
def profile_lineitem(spark: SparkSession, d: str) -> DataFrame:
    return profile.profile(table(spark, d, "lineitem")).select("column_name", "row_count", "null_rate", "cardinality", "is_unique_key")


@query("profile_ranges", " union all ".join(f"select '{c}' as column_name, cast(min({c}) as double) as min_v, cast(max({c}) as double) as max_v, {f'round(avg({c}), 2)' if c in _FRACTIONS else 'cast(null as double)'} as mean_v from lineitem" for c in LINEITEM if c in _NUMBERS))
def profile_ranges(spark: SparkSession, d: str) -> DataFrame:
    return profile.profile(table(spark, d, "lineitem").select(*LINEITEM[:8])).select("column_name", "min_v", "max_v", "mean_v")


_UNIDADES = "codigo codloc sigla regiao area divisao cidadeestado tipo unidade_superior endereco cep nivel id codregra cidade estado latitude longitude".split()


@query("profile_unidades", _profile_sql("unidades", _UNIDADES))
def profile_unidades(spark: SparkSession, d: str) -> DataFrame:
    return profile.profile(table(spark, d, "unidades")).select("column_name", "row_count", "null_rate", "cardinality", "is_unique_key")


@query("profile_dates", "select 'o_orderdate' as column_name, cast(min(o_orderdate) as timestamp) as date_min, cast(max(o_orderdate) as timestamp) as date_max, cast(0 as bigint) as unparsed from orders")
def profile_dates(spark: SparkSession, d: str) -> DataFrame:
    got = profile.date_ranges(table(spark, d, "orders"), ["o_orderdate"])
    return got.select("column_name", F.col("date_min").cast("timestamp_ntz").alias("date_min"), F.col("date_max").cast("timestamp_ntz").alias("date_max"), F.coalesce("unparsed", F.lit(0)).alias("unparsed"))


_CODE = r"'^[A-Z0-9\-_/]+$'"
_SEMANTIC = """select '{c}' as column_name, case when count(*) = 0 then 'string' when max(length(v)) <= 20 and avg(case when regexp_matches(v, {code}) then 1.0 else 0.0 end) > 0.8 then 'code_identifier' else 'string' end as semantic_type
from (select {c} as v from unidades where {c} is not null order by codigo limit 50)"""


@query("semantic_types", " union all ".join(_SEMANTIC.format(c=c, code=_CODE) for c in ("sigla", "regiao", "area", "divisao", "tipo", "endereco", "cep", "cidade", "estado")))
def semantic_types(spark: SparkSession, d: str) -> DataFrame:
    names = ["sigla", "regiao", "area", "divisao", "tipo", "endereco", "cep", "cidade", "estado"]
    return profile.semantic_types(table(spark, d, "unidades").select("codigo", *names), ["codigo"]).where("column_name != 'codigo'")


@query("sample_records", "select cast(row_number() over (order by r_regionkey) as int) as row_no, to_json(struct_pack(r_regionkey := r_regionkey, r_name := r_name))::varchar as row_json from region order by r_regionkey limit 3")
def sample_records(spark: SparkSession, d: str) -> DataFrame:
    return profile.sample_records(table(spark, d, "region"), ["r_regionkey"])


@query("datetime_normalized", "select cast(count(*) as bigint) as rows, cast(count(t) as bigint) as parsed, cast(sum(case when s is not null and trim(s) <> '' and t is null then 1 else 0 end) as bigint) as coerced from (select datadescarga as s, case when regexp_matches(trim(datadescarga), '^\\d{4}-\\d{2}-\\d{2}$') then try_strptime(trim(datadescarga), '%Y-%m-%d') when regexp_matches(trim(datadescarga), '^\\d{2}/\\d{2}/\\d{4}$') then try_strptime(trim(datadescarga), '%d/%m/%Y') end as t from materiais)")
def datetime_normalized(spark: SparkSession, d: str) -> DataFrame:
    df = table(spark, d, "materiais").select("datadescarga")
    out, lost = profile.normalize_datetimes(df, ["datadescarga"], ("yyyy-MM-dd", "dd/MM/yyyy"))
    return out.agg(F.count("*").alias("rows"), F.count("datadescarga").alias("parsed")).join(F.broadcast(lost.select("coerced")))


@query("fk_coverage", "select cast(count(*) as bigint) as rows, cast(sum(case when o_orderkey is null then 1 else 0 end) as bigint) as orphans, round(1 - sum(case when o_orderkey is null then 1.0 else 0.0 end) / count(*), 4) as coverage from lineitem left join orders on l_orderkey = o_orderkey where l_orderkey is not null")
def fk_coverage(spark: SparkSession, d: str) -> DataFrame:
    return profile.fk_coverage(table(spark, d, "lineitem"), "l_orderkey", table(spark, d, "orders"), "o_orderkey")


# ================================================================ catalog
_OLD = "(select source_type, source_key, max(description) as description, max(row_count) as row_count from catalog_sources where source_uid % 3 <> 0 group by 1, 2)"
_NEW = "(select source_type, source_key, concat('[MANUAL] ', source_key) as description, max(coalesce(row_count, 0)) + 1 as row_count from catalog_sources where source_uid % 2 = 0 group by 1, 2)"


def _old_new(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    s = table(spark, d, "catalog_sources")
    keys = ["source_type", "source_key"]
    old = s.where("source_uid % 3 != 0").groupBy(*keys).agg(F.max("description").alias("description"), F.max("row_count").alias("row_count"))
    new = s.where("source_uid % 2 = 0").groupBy(*keys).agg((F.max(F.coalesce("row_count", F.lit(0))) + 1).alias("row_count")).withColumn("description", F.concat(F.lit("[MANUAL] "), F.col("source_key")))
    return old, new


@query("catalog_merge", f"""select coalesce(n.source_type, o.source_type) as source_type, coalesce(n.source_key, o.source_key) as source_key,
  coalesce(case when o.description is not null and not contains(o.description, '[MANUAL]') then o.description end, n.description, o.description) as description,
  case when n.source_key is not null then n.row_count else o.row_count end as row_count
from {_OLD} o full join {_NEW} n on o.source_type = n.source_type and o.source_key = n.source_key""")  # fmt: skip
def catalog_merge(spark: SparkSession, d: str) -> DataFrame:
    return catalog.merge(*_old_new(spark, d))


@query("catalog_incremental", f"select n.source_type, n.source_key from {_NEW} n where not exists (select 1 from {_OLD} o where o.source_type = n.source_type and o.source_key = n.source_key)")
def catalog_incremental(spark: SparkSession, d: str) -> DataFrame:
    old, new = _old_new(spark, d)
    return catalog.needs_extraction(new, old).select("source_type", "source_key")


_DISTINCT_SOURCES = "(select distinct source_uid, source_id, source_key, name, description, business_role, embedding_hint from catalog_sources)"


@query("catalog_hints", f"select source_uid, source_id, coalesce(embedding_hint, concat('[MANUAL] ', source_key)) as embedding_hint from {_DISTINCT_SOURCES}")
def catalog_hints(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "catalog_sources").select("source_uid", "source_id", "source_key", "name", "description", "business_role", "embedding_hint").distinct()
    return catalog.with_hint_placeholders(s).select("source_uid", "source_id", "embedding_hint")


def _text_sql(c: str) -> str:
    return f"case when {c} is null or {c} = '' or contains({c}, '[MANUAL]') then replace(name, '_', ' ') else trim({c}, ' ') end"


_DOCS = f"""(select source_id, case when embedding_hint is not null and not contains(embedding_hint, '[MANUAL]') and trim(embedding_hint, ' ') <> '' then trim(embedding_hint, ' ')
  else concat_ws(chr(10), name, {_text_sql('description')}, {_text_sql('business_role')}) end as doc from {_DISTINCT_SOURCES})"""


def _source_docs(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "catalog_sources").select("source_uid", "source_id", "source_key", "name", "description", "business_role", "embedding_hint").distinct()
    return catalog.source_documents(s)


@query("source_documents", f"select source_id, doc from {_DOCS}")
def source_documents(spark: SparkSession, d: str) -> DataFrame:
    return _source_docs(spark, d)


@query("json_fields", "select event_id, k as field, case when json_type(props, '$.' || k) in ('UBIGINT', 'BIGINT') then 'integer' when json_type(props, '$.' || k) = 'DOUBLE' then 'float' when json_type(props, '$.' || k) = 'BOOLEAN' then 'boolean' else 'string' end as type, json_extract_string(props, '$.' || k) as example from (select event_id, props, unnest(json_keys(props)) as k from events)")
def json_fields(spark: SparkSession, d: str) -> DataFrame:
    return catalog.json_fields(table(spark, d, "events"), "event_id", "props")


@query("response_shapes", "select case when json_valid(payload) then case when json_type(payload) = 'OBJECT' then 'object' when json_type(payload) = 'ARRAY' then 'array' else 'unknown' end else 'unknown' end as shape, count(*) as records from catalog_raw group by 1")
def response_shapes(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "catalog_raw").groupBy(F.coalesce(catalog.response_shape(F.col("payload")), F.lit("unknown")).alias("shape")).agg(F.count("*").alias("records"))


# ================================================================ masking
def _codes_sql(values: str, prefix: str, digits: int) -> str:
    return f"(select k, n, concat('{prefix}', case when length(n::varchar) >= {digits} then n::varchar else lpad(n::varchar, {digits}, '0') end) as code from (select k, row_number() over (order by pos, k) as n from (select k, min(pos) as pos from ({values}) where k is not null and k <> '' group by k)))"


@query("mask_entity", f"select p_partkey, m.code as p_name from part left join {_codes_sql('select trim(p_name) as k, p_partkey as pos from part', 'EQP', 3)} m on trim(p_name) = m.k")
def mask_entity(spark: SparkSession, d: str) -> DataFrame:
    part = table(spark, d, "part")
    rules = {"p_name": masking.Entity("equipamento")}
    codes = materialize(masking.dictionary([(part, "p_partkey", rules)]), "codes")
    return masking.mask(part, rules, codes).select("p_partkey", "p_name")


_SHARED = "select trim(s_name) as k, 0 * 1000000000000 + s_suppkey as pos from supplier union all select trim(c_name), 1000000000000 + c_custkey from customer union all select trim(c_mktsegment), 2000000000000 + c_custkey from customer"


@query("mask_shared_dictionary", f"select k as key, cast(n as bigint) as ordinal, code from {_codes_sql(_SHARED, 'FAB', 3)}")
def mask_shared_dictionary(spark: SparkSession, d: str) -> DataFrame:
    e = masking.Entity("fabricante")
    return masking.dictionary([(table(spark, d, "supplier"), "s_suppkey", {"s_name": e}), (table(spark, d, "customer"), "c_custkey", {"c_name": e, "c_mktsegment": e})]).select("key", "ordinal", "code")


@query("mask_counter", "select o_orderkey, cast(m.n as varchar) as o_orderpriority from orders left join (select k, row_number() over (order by pos, k) as n from (select trim(o_orderpriority) as k, min(o_orderkey) as pos from orders group by 1)) m on trim(o_orderpriority) = m.k")
def mask_counter(spark: SparkSession, d: str) -> DataFrame:
    orders = table(spark, d, "orders").select("o_orderkey", "o_orderpriority")
    rules = {"o_orderpriority": masking.Counter()}
    return masking.mask(orders, rules, materialize(masking.dictionary([(orders, "o_orderkey", rules)]), "codes"))


@query("mask_text", "select load_id, codigo, case when obs is null then null when regexp_replace(obs, '^[\\s\\x{00A0}]+|[\\s\\x{00A0}]+$', '', 'g') = '' then obs else concat('TXT_', upper(substr(md5(regexp_replace(obs, '^[\\s\\x{00A0}]+|[\\s\\x{00A0}]+$', '', 'g')), 1, 8))) end as obs from materiais")
def mask_text(spark: SparkSession, d: str) -> DataFrame:
    return masking.mask(table(spark, d, "materiais").select("load_id", "codigo", "obs"), {"obs": "texto_livre"})


@query("mask_value", "select o_orderkey, round(o_totalprice * 1.0 * (1 + (2 * (cast(concat('0x', substr(md5(concat_ws('|', '42', 'o_totalprice', o_orderkey::varchar)), 1, 8)) as ubigint) / 4294967296.0) - 1) * 0.05), 2) as o_totalprice from orders")
def mask_value(spark: SparkSession, d: str) -> DataFrame:
    return masking.mask(table(spark, d, "orders").select("o_orderkey", "o_totalprice"), {"o_totalprice": "valor"}, row_key="o_orderkey")


@query("mask_date", "select o_orderkey, o_orderdate + interval 365 day as o_orderdate from orders")
def mask_date(spark: SparkSession, d: str) -> DataFrame:
    return masking.mask(table(spark, d, "orders").select("o_orderkey", "o_orderdate"), {"o_orderdate": "data"})


@query("mask_composite", "select dist_id, concat(contrato, '_MASK-', right(year(data_distribuicao)::varchar, 2)) as code from distribuicao_d_sup where contrato is not null and data_distribuicao is not null")
def mask_composite(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "distribuicao_d_sup")
    return t.select("dist_id", masking.composite_code(F.col("contrato"), F.year("data_distribuicao")).alias("code")).where("code is not null")


@query("fk_remap", f"select l_orderkey, l_linenumber, l_partkey::varchar as before, coalesce(m.n::varchar, l_partkey::varchar) as l_partkey, l_extendedprice from lineitem left join (select p_partkey::varchar as k, row_number() over (order by p_partkey) as n from part where p_partkey % 3 <> 0) m on l_partkey::varchar = m.k")
def fk_remap(spark: SparkSession, d: str) -> DataFrame:
    part = table(spark, d, "part").where("p_partkey % 3 != 0")
    codes = materialize(masking.dictionary([(part, "p_partkey", {"p_partkey": masking.Counter()})]), "codes")
    line = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_partkey").cast("string").alias("before"), "l_partkey", "l_extendedprice")
    return masking.remap(line, "l_partkey", codes)


@query("distinct_before_after", "select cast(count(distinct p_name) as bigint) as before, cast(count(distinct trim(p_name)) as bigint) as after from part")
def distinct_before_after(spark: SparkSession, d: str) -> DataFrame:
    masked = mask_entity(spark, d)
    return table(spark, d, "part").agg(F.countDistinct("p_name").alias("before")).join(F.broadcast(masked.agg(F.countDistinct("p_name").alias("after"))))


# ================================================================ dictionary mapping
_NORM = "lower(strip_accents(regexp_replace(regexp_replace(lower({c}), '[\\s\\x{{00A0}}]+', ' ', 'g'), '^ | $', '', 'g')))"


def _norm_sql(c: str) -> str:
    return _NORM.format(c=c)


_REFS = "(select canonical as key, {n} as norm, concat('SUB', lpad(n::varchar, 2, '0')) as code, n as ord from (select canonical, row_number() over (order by ref_id) as n from ref_entries where campo = 'subsistema'))".format(n=_norm_sql("canonical"))


def _subsystems(spark: SparkSession, d: str) -> DataFrame:
    refs = table(spark, d, "ref_entries").where("campo = 'subsistema'").select(F.col("canonical").alias("key"), F.col("ref_id").alias("at"), F.lit(0).alias("g"))
    from lavra.operators.numbering import number_rows

    numbered = number_rows(refs, ["g"], ["at"], "ord")
    return numbered.select("key", X.zero_padded_code("SUB", F.col("ord"), 2).alias("code"), "ord")


_CELLS = "(select subsistema as value, min(dist_id) as first_at, count(*) as occurrences from distribuicao_d_sup where subsistema is not null and regexp_replace(subsistema, '^[\\s\\x{00A0}]+|[\\s\\x{00A0}]+$', '', 'g') <> '' group by 1)"
_EXACT = f"""(select v.value, v.first_at, v.occurrences, coalesce(a.code, b.code) as code, case when a.code is not null then 'exact' when b.code is not null then 'normalized' else 'unmapped' end as stage
  from {_CELLS} v left join {_REFS} a on regexp_replace(v.value, '^[\\s\\x{{00A0}}]+|[\\s\\x{{00A0}}]+$', '', 'g') = a.key left join {_REFS} b on {_norm_sql('v.value')} = b.norm)"""


@query("map_exact", f"select value, cast(first_at as bigint) as first_at, cast(occurrences as bigint) as occurrences, code, stage from {_EXACT}")
def map_exact(spark: SparkSession, d: str) -> DataFrame:
    return mapping.cascade(table(spark, d, "distribuicao_d_sup"), "subsistema", "dist_id", _subsystems(spark, d), None).select("value", "first_at", "occurrences", "code", "stage")


@query("map_coverage", f"select 'subsistema' as column_name, cast(sum(occurrences) as bigint) as non_empty, cast(sum(case when stage <> 'unmapped' then occurrences else 0 end) as bigint) as mapped, cast(sum(case when stage = 'unmapped' then occurrences else 0 end) as bigint) as unmapped, round(100.0 * sum(case when stage <> 'unmapped' then occurrences else 0 end) / sum(occurrences), 2) as pct_mapped from {_EXACT}")
def map_coverage(spark: SparkSession, d: str) -> DataFrame:
    resolved = mapping.cascade(table(spark, d, "distribuicao_d_sup"), "subsistema", "dist_id", _subsystems(spark, d), None)
    return mapping.coverage(resolved, "subsistema").select("column_name", "non_empty", "mapped", "unmapped", "pct_mapped")


@query("map_unmapped", f"select value, cast(occurrences as bigint) as occurrences from {_EXACT} where stage = 'unmapped'")
def map_unmapped(spark: SparkSession, d: str) -> DataFrame:
    return mapping.unmapped(mapping.cascade(table(spark, d, "distribuicao_d_sup"), "subsistema", "dist_id", _subsystems(spark, d), None))


@query("map_contexts", f"""select value, string_agg(concat(ctx, ' (', n::varchar, ')'), ' | ' order by n desc, ctx) as contexts from (
  select subsistema as value, case when contrato is null or regexp_replace(contrato, '^[\\s\\x{{00A0}}]+|[\\s\\x{{00A0}}]+$', '', 'g') = '' then '[vazio]' else regexp_replace(contrato, '^[\\s\\x{{00A0}}]+|[\\s\\x{{00A0}}]+$', '', 'g') end as ctx, count(*) as n
  from distribuicao_d_sup where subsistema in (select value from {_EXACT} where stage = 'unmapped') group by 1, 2) group by value""")  # fmt: skip
def map_contexts(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "distribuicao_d_sup")
    resolved = materialize(mapping.cascade(rows, "subsistema", "dist_id", _subsystems(spark, d), None), "resolved")
    return mapping.contexts(rows, "subsistema", "contrato", resolved)


@query("map_generated", f"""select value, concat('CTR', case when length(n::varchar) >= 3 then n::varchar else lpad(n::varchar, 3, '0') end, regexp_extract(trim(first_value), '(-\\d{{2}})$', 1)) as code from (
  select value, norm, dense_rank() over (order by first_norm, norm) as n, first_value(value) over (partition by norm order by first_at, value) as first_value from (
  select value, norm, first_at, min(first_at) over (partition by norm) as first_norm from (select contrato as value, {_norm_sql('contrato')} as norm, min(dist_id) as first_at from distribuicao_d_sup where contrato is not null and regexp_replace(contrato, '^[\\s\\x{{00A0}}]+|[\\s\\x{{00A0}}]+$', '', 'g') <> '' group by 1, 2)))""")  # fmt: skip
def map_generated(spark: SparkSession, d: str) -> DataFrame:
    empty = spark.createDataFrame([], "key string, code string, ord bigint")
    return mapping.cascade(table(spark, d, "distribuicao_d_sup"), "contrato", "dist_id", empty, None, ("CTR", 3, True)).select("value", "code")


@query("map_cascade")
def map_cascade(spark: SparkSession, d: str) -> DataFrame:
    """All stages with the column's own similarity rule; checked against brute force in the tests."""
    return mapping.cascade(table(spark, d, "distribuicao_d_sup"), "subsistema", "dist_id", _subsystems(spark, d), mapping.FUZZY_RULES["subsistema"]).select("value", "occurrences", "code", "stage", "score")


@query("map_suggestions")
def map_suggestions(spark: SparkSession, d: str) -> DataFrame:
    refs = _subsystems(spark, d)
    resolved = materialize(mapping.cascade(table(spark, d, "distribuicao_d_sup"), "subsistema", "dist_id", refs, mapping.FUZZY_RULES["subsistema"]), "resolved")
    return mapping.suggestions(resolved, refs)


def _mapping_job(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    """The whole plan over the dictionaries that ref_entries gives; categories without entries are reported missing."""
    named = F.create_map(*[F.lit(x) for pair in (("item", "equipamento"), ("nomenclatura_sigelog", "equipamento"), ("om_destino", "sigla"), ("subsistema", "subsistema")) for x in pair])
    refs = table(spark, d, "ref_entries").select(named[F.col("campo")].alias("category"), F.col("canonical").alias("key"), F.concat(F.lit("R"), F.col("ref_id").cast("string")).alias("code"), F.col("ref_id").alias("ord"))
    return mapping.run_plan(table(spark, d, "distribuicao_d_sup"), "dist_id", mapping.MAPPING_PLAN, refs)


@query("map_plan_report")
def map_plan_report(spark: SparkSession, d: str) -> DataFrame:
    return _mapping_job(spark, d)["report"]


@query("map_similarity_hits")
def map_similarity_hits(spark: SparkSession, d: str) -> DataFrame:
    return _mapping_job(spark, d)["similar"]


# ================================================================ text functions
@query("content_tokens", "select query_uid, len(list_distinct(list_filter(regexp_extract_all(lower(strip_accents(lower(coalesce(query, '')))), '[\\p{L}\\p{N}]+'), lambda t: length(t) > 1 and not list_contains([" + ", ".join(f"'{s}'" for s in sorted(set(X.STOPWORDS))) + "], t)))) as n_tokens, len(regexp_extract_all(lower(coalesce(query, '')), '[\\p{L}\\p{N}_]+')) as n_words from benchmark_queries")
def content_tokens(spark: SparkSession, d: str) -> DataFrame:
    q = F.coalesce("query", F.lit(""))
    return table(spark, d, "benchmark_queries").select("query_uid", F.size(X.content_tokens(q)).cast("bigint").alias("n_tokens"), F.size(X.bm25_tokens(q)).cast("bigint").alias("n_words"))


@query("normalized_text", f"select source_uid, {_norm_sql('description')} as norm from (select distinct source_uid, description from catalog_sources where description is not null)")
def normalized_text(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "catalog_sources").where("description is not null").select("source_uid", "description").distinct().select("source_uid", X.normalize_text(F.col("description")).alias("norm"))


# ================================================================ retrieval
_RULES = [
    (["contrato", "fornecimento"], ["sql.contratos"], ["spreadsheets.plano"]),
    (["saldo", "estoque"], ["sql.estoque"], []),
    (["enlace", "satelit"], ["api.monitoramento"], ["sql.estoque"]),
    (["[MANUAL]"], ["sql.nunca"], []),
]
_ALL_IDS = ["sql.contratos", "sql.estoque", "api.monitoramento", "spreadsheets.plano"]


def _rules_sql() -> str:
    parts = []
    for keys, inc, comp in _RULES[:3]:
        cond = " or ".join(f"contains(lower(query), '{k}')" for k in keys)
        parts += [f"select query_uid as query_id, '{s}' as source_id from benchmark_queries where {cond}" for s in inc + comp]
    hit = " union ".join(parts)
    every = " union all ".join(f"select '{s}' as source_id" for s in _ALL_IDS)
    return f"with hit as ({hit}) select * from hit union all select q.query_uid, s.source_id from benchmark_queries q cross join ({every}) s where q.query_uid not in (select query_id from hit)"


@query("keyword_routing", _rules_sql())
def keyword_routing(spark: SparkSession, d: str) -> DataFrame:
    rules = spark.createDataFrame([(i, *r) for i, r in enumerate(_RULES)], "rule_id int, trigger_keywords array<string>, include_sources array<string>, complement_with array<string>")
    sources = spark.createDataFrame([(s,) for s in _ALL_IDS], "source_id string")
    return retrieval.keyword_route(table(spark, d, "benchmark_queries").select(F.col("query_uid").alias("query_id"), "query"), rules, sources)


def _bm25_inputs(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    s = table(spark, d, "catalog_sources").groupBy("source_uid").agg(F.max("embedding_hint").alias("h"), F.max("description").alias("t"))
    docs = s.select(F.col("source_uid").alias("source_id"), F.coalesce("h", "t", F.lit("")).alias("doc"))
    return table(spark, d, "benchmark_queries").select(F.col("query_uid").alias("query_id"), "query"), docs


_BM25 = """
with docs as (select source_uid as source_id, coalesce(max(embedding_hint), max(description), '') as doc from catalog_sources group by 1),
toks as (select source_id, regexp_extract_all(lower(doc), '[\\p{L}\\p{N}_]+') as t from docs),
post as (select source_id, dl, term, count(*) as tf from (select source_id, len(t) as dl, unnest(t) as term from toks) group by all),
tot as (select count(*) as n, avg(len(t)) as avgdl from toks),
idf0 as (select term, ln(n - df + 0.5) - ln(df + 0.5) as raw from (select term, count(*) as df from post group by 1) cross join tot),
idf as (select term, case when raw < 0 then 0.25 * m else raw end as idf from idf0 cross join (select avg(raw) as m from idf0)),
q as (select query_uid as query_id, term, count(*) as qtf from (select query_uid, unnest(regexp_extract_all(lower(coalesce(query, '')), '[\\p{L}\\p{N}_]+')) as term from benchmark_queries) group by all),
sc as (select query_id, source_id, sum(qtf * idf * tf * 2.5 / (tf + 1.5 * (1 - 0.75 + 0.75 * dl / avgdl))) as score from q join idf using (term) join post using (term) cross join tot group by all),
nm as (select *, score / (case when max(score) over (partition by query_id) > 0 then max(score) over (partition by query_id) else 1 end) as normalized from sc),
rk as (select *, row_number() over (partition by query_id order by round(normalized, 9) desc, source_id) as rank from nm)
"""


def _bm25_ranked(spark: SparkSession, d: str, keep: int) -> DataFrame:
    queries, docs = _bm25_inputs(spark, d)
    return retrieval.ranked(retrieval.bm25_top_k(queries, docs, keep).withColumn("r9", F.round("normalized", 9)), "r9", keep)


@query("bm25_top", _BM25 + "select query_id, source_id, cast(rank as int) as rank, round(normalized, 4) as score from rk where rank <= 10")
def bm25_top(spark: SparkSession, d: str) -> DataFrame:
    return _bm25_ranked(spark, d, 10).select("query_id", "source_id", "rank", F.round("normalized", 4).alias("score"))


_GAP = """, g as (select *, r9 - lead(r9) over (partition by query_id order by rank) as gap from (select *, round(normalized, 9) as r9 from rk) where rank <= 4),
c as (select query_id, arg_min(rank, struct_pack(a := -gap, b := rank)) as cut_after from g where gap is not null group by 1)
select g.query_id, g.source_id, cast(g.rank as int) as rank from g left join c using (query_id) where g.rank <= least(coalesce(c.cut_after, 1), 3) and g.r9 >= 0.30"""


@query("bm25_selected", _BM25 + _GAP)
def bm25_selected(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.cut(_bm25_ranked(spark, d, 5), retrieval.Cut("score_gap", 3, 0.30, 4), "r9").select("query_id", "source_id", "rank")


_COS = """
with v as (select vec_id, list_transform(embedding, lambda x: x::double) as e from embeddings),
q as (select vec_id as query_id, e as qe from v where vec_id % 20 = 0),
s as (select query_id, vec_id as source_id, list_dot_product(qe, e) / (sqrt(list_dot_product(qe, qe)) * sqrt(list_dot_product(e, e))) as score from q cross join v),
r as (select *, row_number() over (partition by query_id order by score desc, source_id) as rank from s)
"""


def _cosine(spark: SparkSession, d: str, k: int) -> DataFrame:
    e = table(spark, d, "embeddings")
    return retrieval.cosine_top_k(e.where("vec_id % 20 = 0"), e, k)


@query("cosine_top", _COS + "select query_id, source_id, cast(rank as int) as rank, round(score, 6) as score from r where rank <= 5")
def cosine_top(spark: SparkSession, d: str) -> DataFrame:
    return _cosine(spark, d, 5).select("query_id", "source_id", "rank", F.round("score", 6).alias("score"))


@query("cosine_threshold", _COS + "select query_id, source_id, cast(rank as int) as rank from r where rank <= 5 and score >= 0.5")
def cosine_threshold(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.cut(_cosine(spark, d, 5), retrieval.Cut("threshold", 5, 0.5)).select("query_id", "source_id", "rank")


@query("gap_positions", _COS + ", g as (select *, score - lead(score) over (partition by query_id order by rank) as gap from r where rank <= 5) select query_id, cast(arg_min(rank, struct_pack(a := -gap, b := rank)) as int) as cut_after, round(max(gap), 6) as largest_gap from g where gap is not null group by 1")
def gap_positions(spark: SparkSession, d: str) -> DataFrame:
    got = retrieval.gap_positions(_cosine(spark, d, 5), retrieval.Cut(window=5))
    return got.select("query_id", "cut_after", F.round("largest_gap", 6).alias("largest_gap"))


@query("similarity_report", _COS + "select query_id, source_id, cast(rank as int) as rank, score >= 0.5 as passes from r")
def similarity_report(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings")
    return retrieval.similarity_report(retrieval.cosine_scores(e.where("vec_id % 20 = 0"), e), 0.5).select("query_id", "source_id", "rank", "passes")


@query("rerank", _BM25 + """, p as (select rk.query_id, rk.source_id, list_distinct(regexp_extract_all(lower(coalesce(b.query, '')), '[\\p{L}\\p{N}_]+')) as qt, list_distinct(t.t) as dt from rk join benchmark_queries b on b.query_uid = rk.query_id join toks t using (source_id) where rank <= 5),
o as (select query_id, source_id, case when len(qt) > 0 then len(list_intersect(qt, dt)) / len(qt) else 0 end as score from p),
x as (select *, row_number() over (partition by query_id order by score desc, source_id) as rank from o)
select query_id, source_id, cast(rank as int) as rank, round(score, 6) as rerank_score from x where rank <= 3""")  # fmt: skip
def rerank(spark: SparkSession, d: str) -> DataFrame:
    queries, docs = _bm25_inputs(spark, d)
    got = retrieval.rerank(_bm25_ranked(spark, d, 5), queries, docs, retrieval.token_overlap_score, 3)
    return got.select("query_id", "source_id", "rank", F.round("rerank_score", 6).alias("rerank_score"))


# ================================================================ evaluation
_CHOSEN = """chosen as (select query_uid as query_id, coalesce(expected_primary, []) as p, coalesce(expected_complement, []) as c, coalesce(must_not_include, []) as n, coalesce(difficulty, 'unknown') as difficulty, coalesce(cluster, 'unknown') as cluster,
  list_slice(list_concat(case when query_uid % 3 = 0 then list_slice(coalesce(must_not_include, []), 1, 1) else [] end, list_concat(list_slice(coalesce(expected_complement, []), 1, 1), coalesce(expected_primary, []))), 1, case when query_uid % 5 = 0 then 0 else 3 end) as s from benchmark_queries)"""
_METRICS = f"""with {_CHOSEN},
m0 as (select *, case when len(s) > 0 then len(list_filter(s, lambda x: list_contains(p, x) or list_contains(c, x))) / len(s) else 0 end as pr,
  case when len(list_distinct(p)) > 0 then len(list_filter(list_distinct(p), lambda x: list_contains(s, x))) / len(list_distinct(p)) else 1 end as rc,
  list_concat(list_transform(p, lambda x: 2.0), list_transform(list_filter(c, lambda x: not list_contains(p, x)), lambda x: 1.0)) as ideal from chosen),
m as (select query_id, difficulty, cluster, round(pr, 4) as "precision", round(rc, 4) as recall, round(case when pr + rc > 0 then 2 * pr * rc / (pr + rc) else 0 end, 4) as f1,
  case when len(s) > 0 and list_contains(p, s[1]) then 1.0 else 0.0 end as top1_acc, case when len(list_filter(s, lambda x: list_contains(n, x))) > 0 then 1.0 else 0.0 end as error_rate,
  round(case when len(ideal) > 0 then coalesce(list_sum(list_transform(list_slice(s, 1, 5), lambda x, i: (case when list_contains(p, x) then 2.0 when list_contains(c, x) then 1.0 else 0.0 end) / log2(i + 1))), 0) / list_sum(list_transform(list_slice(ideal, 1, 5), lambda g, i: g / log2(i + 1))) else 0 end, 4) as ndcg from m0)
"""


def _results(spark: SparkSession, d: str) -> DataFrame:
    b = table(spark, d, "benchmark_queries")
    none = F.array().cast("array<string>")
    forbidden = F.when(F.col("query_uid") % 3 == 0, F.slice(F.coalesce("must_not_include", none), 1, 1)).otherwise(none)
    listed = F.concat(forbidden, F.slice(F.coalesce("expected_complement", none), 1, 1), F.coalesce("expected_primary", none))
    chosen = b.withColumn("selected", F.when(F.col("query_uid") % 5 == 0, none).otherwise(F.slice(listed, 1, 3)))
    return evaluation.metrics(chosen.select(F.col("query_uid").alias("query_id"), F.coalesce("difficulty", F.lit("unknown")).alias("difficulty"), F.coalesce("cluster", F.lit("unknown")).alias("cluster"), "selected", "expected_primary", "expected_complement", "must_not_include"))


_NAMES = '"precision", recall, f1, top1_acc, error_rate, ndcg'


@query("retrieval_metrics", _METRICS + f"select query_id, {_NAMES} from m")
def retrieval_metrics(spark: SparkSession, d: str) -> DataFrame:
    return _results(spark, d).select("query_id", *evaluation.METRICS)


_AVG = ", ".join(f'round(avg("{m}"), 4) as "{m}"' for m in evaluation.METRICS)


@query("metrics_by_field", _METRICS + f"select 'difficulty' as field, difficulty as value, count(*) as n, {_AVG} from m group by 1, 2 union all select 'cluster', cluster, count(*), {_AVG} from m group by 1, 2")
def metrics_by_field(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.means_by_field(_results(spark, d), ["difficulty", "cluster"])


@query("metrics_macro", _METRICS + 'select round(avg("precision"), 4) as macro_precision, round(avg(recall), 4) as macro_recall, round(2 * avg("precision") * avg(recall) / (avg("precision") + avg(recall)), 4) as macro_f1 from m')
def metrics_macro(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.macro(_results(spark, d))


_FOLDS = "(select query_uid as query_id, coalesce(difficulty, 'unknown') as difficulty, cast((row_number() over (partition by coalesce(difficulty, 'unknown') order by md5(concat_ws('|', '42', query_uid::varchar)), query_uid) - 1) % 5 as int) as fold from benchmark_queries)"


@query("stratified_folds", f"select * from {_FOLDS}")
def stratified_folds(spark: SparkSession, d: str) -> DataFrame:
    b = table(spark, d, "benchmark_queries").select(F.col("query_uid").alias("query_id"), F.coalesce("difficulty", F.lit("unknown")).alias("difficulty"))
    return evaluation.folds(b)


@query("fold_distribution", f"select fold, difficulty, count(*) as queries from {_FOLDS} group by 1, 2")
def fold_distribution(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.fold_distribution(stratified_folds(spark, d))


@query("metrics_across_folds", _METRICS + f", fm as (select fold, {_AVG} from m join {_FOLDS} f using (query_id) group by 1) select " + ", ".join(f'round(avg("{m}"), 4) as "{m}", round(coalesce(stddev_samp("{m}"), 0), 4) as "{m}_std"' for m in evaluation.METRICS) + " from fm")
def metrics_across_folds(spark: SparkSession, d: str) -> DataFrame:
    per = evaluation.means(_results(spark, d).join(stratified_folds(spark, d).select("query_id", "fold"), "query_id"), ["fold"])
    return evaluation.across_folds(per, [])


def _calibration(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    e = table(spark, d, "embeddings")
    top = _cosine(spark, d, 6).where("query_id != source_id").withColumn("source_id", F.col("source_id").cast("string"))
    hundred = F.floor(F.col("vec_id") / 100).alias("hundred")
    asked = e.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "label", hundred)
    # a question's gold are the vectors of its label among its own hundred ids: no list grows with the table
    same = asked.join(e.select(F.col("vec_id").alias("other"), "label", hundred), ["label", "hundred"], "left").withColumn("other", F.when(F.col("other") != F.col("query_id"), F.col("other")))
    gold = same.groupBy("query_id", "label").agg(F.array_sort(F.collect_list(F.col("other").cast("string"))).alias("expected_primary"))
    gold = gold.select("query_id", F.col("label").cast("string").alias("difficulty"), "expected_primary", F.array().cast("array<string>").alias("expected_complement"), F.array().cast("array<string>").alias("must_not_include"))
    tried = materialize(evaluation.at_thresholds(top.select("query_id", "source_id", "rank", F.round("score", 9).alias("score")), gold), "tried")
    folded = materialize(evaluation.folds(gold.select("query_id", "difficulty")), "folded")
    return tried, folded, materialize(evaluation.calibrate(tried, folded), "calibrated")


_CALIBRATION = _COS + """, top as (select query_id, source_id, rank, round(score, 9) as score from r where rank <= 6 and query_id <> source_id),
gold as (select a.vec_id as query_id, cast(a.label as varchar) as difficulty, list(b.vec_id) filter (where b.vec_id <> a.vec_id) as p from embeddings a join embeddings b on a.label = b.label and a.vec_id // 100 = b.vec_id // 100 where a.vec_id % 20 = 0 group by a.vec_id, a.label),
grid as (select round(0.20 + 0.05 * range, 2) as threshold from range(16)),
sel as (select threshold, g.query_id, any_value(g.p) as p, list(t.source_id) filter (where t.source_id is not null) as s from gold g cross join grid left join top t on t.query_id = g.query_id and t.score >= threshold group by 1, 2),
prc as (select threshold, query_id, case when len(coalesce(s, [])) > 0 then len(list_intersect(s, coalesce(p, []))) / len(s) else 0 end as pr, case when len(coalesce(p, [])) > 0 then len(list_intersect(p, coalesce(s, []))) / len(p) else 1 end as rc from sel),
m as (select threshold, query_id, round(case when pr + rc > 0 then 2 * pr * rc / (pr + rc) else 0 end, 4) as f1 from prc),
fold as (select query_id, cast((row_number() over (partition by difficulty order by md5(concat_ws('|', '42', query_id::varchar)), query_id) - 1) % 5 as int) as fold from gold),
mean as (select t.fold, m.threshold, round(avg(m.f1), 10) as f from m join fold using (query_id) join (select range as fold from range(5)) t on t.fold <> fold.fold group by 1, 2)
"""


@query("calibrated_thresholds", _CALIBRATION + "select cast(fold as int) as fold, arg_max(threshold, struct_pack(f := f, neg := -threshold)) as threshold, round(max(f), 4) as train_f1 from mean group by 1")
def calibrated_thresholds(spark: SparkSession, d: str) -> DataFrame:
    return _calibration(spark, d)[2]


@query("cross_validated")
def cross_validated(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.means(evaluation.cross_validated(*_calibration(spark, d)), ["fold", "threshold"])


# ================================================================ statistics
_TESTS = "(select campo as family, ref_id as test_id, (ref_id * 37 % 997) / 20000.0 as p_raw from ref_entries)"


@query("holm", f"""select family, test_id, p_raw, least(1.0, max(p_raw * (m - rn + 1)) over (partition by family order by p_raw, test_id rows unbounded preceding)) as p_holm,
  least(1.0, max(p_raw * (m - rn + 1)) over (partition by family order by p_raw, test_id rows unbounded preceding)) <= 0.05 as significant
  from (select *, row_number() over (partition by family order by p_raw, test_id) as rn, count(*) over (partition by family) as m from {_TESTS})""")  # fmt: skip
def holm(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "ref_entries").select(F.col("campo").alias("family"), F.col("ref_id").alias("test_id"), ((F.col("ref_id") * 37 % 997) / F.lit(20000.0)).alias("p_raw"))
    return statistics.holm(t, ["family"])


_TOK = "list_distinct(list_filter(regexp_extract_all(lower(strip_accents(lower(coalesce({c}, '')))), '[\\p{{L}}\\p{{N}}]+'), lambda t: length(t) > 1 and not list_contains([" + ", ".join(f"'{s}'" for s in sorted(set(X.STOPWORDS))) + "], t)))"
_TEXTS = "select source_id, concat_ws(' ', nullif(max(embedding_hint), ''), nullif(max(description), ''), nullif(max(business_role), ''), nullif(max(when_to_use), '')) as text from catalog_sources group by 1"
_OVERLAP = f"""with src as ({_TEXTS}),
st as (select source_id, {_TOK.format(c='text')} as d from src),
q as (select query_uid as query_id, {_TOK.format(c='query')} as q, unnest(coalesce(expected_primary, [])) as gid from benchmark_queries),
j as (select query_id, q, d from q join st on trim(string_split(gid, ',')[1]) = st.source_id),
o as (select query_id, any_value(q) as q, list_distinct(flatten(list(d))) as u from j group by 1),
ov as (select query_id, case when len(q) > 0 then len(list_intersect(q, u)) / len(q) else 0 end as overlap from o)
"""


def _overlaps(spark: SparkSession, d: str) -> DataFrame:
    src = statistics.catalog_texts(table(spark, d, "catalog_sources"))
    q = table(spark, d, "benchmark_queries").select(F.col("query_uid").alias("query_id"), "query", F.col("expected_primary").alias("gold"))
    return statistics.overlaps(q, src).where("overlap is not null")


@query("lexical_overlap", _OVERLAP + "select query_id, round(overlap, 6) as overlap from ov")
def lexical_overlap(spark: SparkSession, d: str) -> DataFrame:
    return _overlaps(spark, d).select("query_id", F.round("overlap", 6).alias("overlap"))


@query("catalog_texts", _TEXTS)
def catalog_texts(spark: SparkSession, d: str) -> DataFrame:
    return statistics.catalog_texts(table(spark, d, "catalog_sources"))


@query("overlap_by_difficulty", _OVERLAP + "select coalesce(difficulty, 'unknown') as difficulty, count(*) as n, round(avg(overlap), 6) as mean_overlap from ov join benchmark_queries on query_uid = query_id group by 1")
def overlap_by_difficulty(spark: SparkSession, d: str) -> DataFrame:
    labels = table(spark, d, "benchmark_queries").select(F.col("query_uid").alias("query_id"), F.coalesce("difficulty", F.lit("unknown")).alias("difficulty"))
    return statistics.mean_by_label(_overlaps(spark, d).join(labels, "query_id"), "difficulty")


_BANDS = ", e as (select quantile_cont(overlap, [1/3, 2/3]) as e from ov), b as (select query_id, overlap, ['baixa', 'media', 'alta'][1 + (overlap >= e[1])::int + (overlap >= e[2])::int] as band from ov cross join e)"


def _banded(spark: SparkSession, d: str) -> DataFrame:
    o = materialize(_overlaps(spark, d), "overlaps")
    return o.withColumn("band", statistics.band(F.col("overlap"), statistics.band_edges(o, "overlap")))


@query("overlap_bands", _OVERLAP + _BANDS + "select band, count(*) as n, round(avg(overlap), 4) as mean, round(stddev_pop(overlap), 4) as std from b group by 1")
def overlap_bands(spark: SparkSession, d: str) -> DataFrame:
    return statistics.band_profile(_banded(spark, d), "overlap")


@query("five_numbers", "select round(min(o_totalprice), 6) as \"min\", round(quantile_cont(o_totalprice, 0.25), 6) as q25, round(quantile_cont(o_totalprice, 0.5), 6) as median, round(quantile_cont(o_totalprice, 0.75), 6) as q75, round(max(o_totalprice), 6) as \"max\" from orders")
def five_numbers(spark: SparkSession, d: str) -> DataFrame:
    return statistics.five_numbers(table(spark, d, "orders"), "o_totalprice")


@query("slopes", "select l_returnflag, count(*) as n, round(coalesce(regr_slope(l_extendedprice, l_quantity), 0), 6) as slope from lineitem group by 1")
def slopes(spark: SparkSession, d: str) -> DataFrame:
    return statistics.slope(table(spark, d, "lineitem"), ["l_returnflag"], "l_extendedprice", "l_quantity").select("l_returnflag", "n", F.round("slope", 6).alias("slope"))


def _model_results(spark: SparkSession, d: str) -> DataFrame:
    b = table(spark, d, "benchmark_queries").select(F.col("query_uid").alias("query_id"))
    draw = lambda m: masking.uniform(F.lit(m), F.col("query_id"))
    models = F.explode(F.array(*[F.struct(F.lit(m).alias("model"), (draw(m) * w).alias("f1")) for m, w in (("a", 1.0), ("b", 0.9), ("c", 0.7))]))
    return b.select("query_id", models.alias("m")).select("query_id", "m.model", "m.f1")


def _draw_sql(m: str, w: float) -> str:
    return f"select query_uid as query_id, '{m}' as model, {w} * (cast(concat('0x', substr(md5(concat_ws('|', '{m}', query_uid::varchar)), 1, 8)) as ubigint) / 4294967296.0) as f1 from benchmark_queries"


_MODELS = " union all ".join(_draw_sql(m, w) for m, w in (("a", 1.0), ("b", 0.9), ("c", 0.7)))


@query("model_pairs", f"with r as ({_MODELS}) select concat(x.model, ' vs ', y.model) as comparison, count(*) as n, round(avg(x.f1 - y.f1), 6) as diff from r x join r y using (query_id) where x.model < y.model group by 1")
def model_pairs(spark: SparkSession, d: str) -> DataFrame:
    p = statistics.model_pairs(_model_results(spark, d))
    return p.groupBy("comparison").agg(F.count("*").alias("n"), F.round(F.avg(F.col("a") - F.col("b")), 6).alias("diff"))


@query("bootstrap_sql", f"""with r as ({_MODELS}), p as (select concat(x.model, ' vs ', y.model) as comparison, x.query_id as key, x.f1 - y.f1 as d from r x join r y using (query_id) where x.model < y.model),
o as (select comparison, d, row_number() over (partition by comparison order by key) - 1 as i from p), z as (select comparison, count(*) as n, avg(d) as estimate from o group by 1),
w as (select comparison, n, b, slot from z cross join (select range as b from range(10000)) cross join lateral (select range as slot from range(n))),
h as (select comparison, b, cast(concat('0x', substr(md5(concat_ws('|', '42', b::varchar, slot::varchar)), 1, 8)) as ubigint)::bigint % n as i from w),
m as (select comparison, b, avg(d) as m from h join o using (comparison, i) group by 1, 2)
select comparison, any_value(n) as n, round(any_value(estimate), 6) as estimate, round(least(1.0, 2 * least(avg((m >= 0)::int), avg((m <= 0)::int))), 6) as p_raw, round(quantile_cont(m, 0.025), 6) as ci_low, round(quantile_cont(m, 0.975), 6) as ci_high from m join z using (comparison) group by 1""")  # fmt: skip
def bootstrap_sql(spark: SparkSession, d: str) -> DataFrame:
    got = statistics.bootstrap_sql(statistics.model_pairs(_model_results(spark, d)), statistics.RESAMPLES)
    return got.select("comparison", "n", *[F.round(c, 6).alias(c) for c in ("estimate", "p_raw", "ci_low", "ci_high")])


@query("bootstrap_ranking")
def bootstrap_ranking(spark: SparkSession, d: str) -> DataFrame:
    return statistics.holm(statistics.bootstrap(statistics.model_pairs(_model_results(spark, d))).withColumn("family", F.lit("ranking")), ["family"])


@query("bootstrap_interaction")
def bootstrap_interaction(spark: SparkSession, d: str) -> DataFrame:
    """Slope of the advantage over the overlap, and low band against high band."""
    pairs = statistics.model_pairs(_model_results(spark, d)).join(_banded(spark, d).withColumnRenamed("query_id", "key"), "key")
    slopes = statistics.bootstrap(pairs.withColumn("x", F.col("overlap")), "slope").withColumn("test", F.lit("slope"))
    ends = pairs.where("band in ('baixa', 'alta')").withColumn("low", F.col("band") == "baixa")
    both = ends.groupBy("comparison").agg(F.countDistinct("low").alias("k")).where("k = 2").select("comparison")
    did = statistics.bootstrap(ends.join(both, "comparison"), "did").withColumn("test", F.lit("did"))
    return statistics.holm(slopes.unionByName(did), ["test"])


@query("ablation_steps")
def ablation_steps(spark: SparkSession, d: str) -> DataFrame:
    r = _model_results(spark, d)
    versions = ["v1", "v2", "v3"]
    v = r.select("query_id", "model", "f1", F.explode(F.array(*[F.lit(x) for x in versions])).alias("version")).withColumn("f1", F.col("f1") * masking.uniform(F.col("version"), F.col("query_id")))
    return statistics.bootstrap(statistics.ablation_pairs(v, versions), "mean")


# ================================================================ plans
@query("op_filter", "select o_orderkey, o_totalprice from orders where o_orderstatus = 'F' and o_totalprice > 100000")
def op_filter(spark: SparkSession, d: str) -> DataFrame:
    return agent.op_filter(table(spark, d, "orders"), "o_orderstatus = 'F' and o_totalprice > 100000").select("o_orderkey", "o_totalprice")


@query("op_aggregation", "select l_returnflag, l_linestatus, round(sum(l_quantity), 2) as quantity, round(sum(l_extendedprice * (1 - l_discount)), 2) as revenue, count(*) as n from lineitem group by 1, 2")
def op_aggregation(spark: SparkSession, d: str) -> DataFrame:
    revenue = F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2)
    return agent.op_aggregation(table(spark, d, "lineitem"), ["l_returnflag", "l_linestatus"], {"quantity": F.round(F.sum("l_quantity"), 2), "revenue": revenue, "n": F.count("*")})


@query("op_lookup", "select c_custkey, n_name, r_name from customer left join nation on c_nationkey = n_nationkey left join region on n_regionkey = r_regionkey")
def op_lookup(spark: SparkSession, d: str) -> DataFrame:
    nation = table(spark, d, "nation").withColumnRenamed("n_nationkey", "c_nationkey")
    region = table(spark, d, "region").withColumnRenamed("r_regionkey", "n_regionkey")
    found = agent.op_lookup(table(spark, d, "customer"), nation, ["c_nationkey"], ["n_name", "n_regionkey"])
    return agent.op_lookup(found, region, ["n_regionkey"], ["r_name"]).select("c_custkey", "n_name", "r_name")


@query("op_comparison", "select coalesce(a.k, b.k) as l_suppkey, coalesce(a.v, 0) as expected, coalesce(b.v, 0) as existing, coalesce(b.v, 0) - coalesce(a.v, 0) as difference, coalesce(b.v, 0) - coalesce(a.v, 0) < 0 as deficit from (select l_suppkey as k, sum(l_quantity) as v from lineitem where l_returnflag = 'N' group by 1) a full join (select l_suppkey as k, sum(l_quantity) as v from lineitem where l_returnflag = 'R' group by 1) b on a.k = b.k")
def op_comparison(spark: SparkSession, d: str) -> DataFrame:
    line = table(spark, d, "lineitem")
    side = lambda f: line.where(F.col("l_returnflag") == f).groupBy("l_suppkey").agg(F.sum("l_quantity").alias("v"))
    return agent.op_comparison(side("N"), side("R"), ["l_suppkey"], "v")


@query("op_list", "select distinct p_brand, p_type from part order by p_brand, p_type limit 20")
def op_list(spark: SparkSession, d: str) -> DataFrame:
    return agent.op_list(table(spark, d, "part"), ["p_brand", "p_type"], ["p_brand", "p_type"], 20)


_STATEMENTS = ["SELECT 1", "with x as (select 1) select * from x", "DROP TABLE t", "select 'UPDATE' as w", "insert into t values (1)", "SHOW TABLES", "SELECT * FROM t; DELETE FROM t", "(select 1) union (select 2)", "selec 1"]


@query("guard", "select * from (values " + ", ".join(f"({i}, {str(ok).lower()})" for i, ok in enumerate([True, True, False, True, False, False, False, True, False])) + ") t(statement, allowed)")
def guarded(spark: SparkSession, d: str) -> DataFrame:
    return spark.createDataFrame([(i, guard.check(spark, s).allowed) for i, s in enumerate(_STATEMENTS)], "statement int, allowed boolean")


@query("agent_answer", "select n_name as label, cast(count(*) as bigint) as n from customer join nation on c_nationkey = n_nationkey group by 1 order by n desc, label limit 5")
def agent_answer(spark: SparkSession, d: str) -> DataFrame:
    """A two-step plan through selection, guard and views; the second step's rows."""
    sources = {"sql.customer": table(spark, d, "customer"), "sql.nation": table(spark, d, "nation")}
    plan = json.dumps({"steps": [
        {"id": 2, "description": "customers by nation", "source_id": "sql.customer", "source_type": "sql", "operation": "aggregation", "depends_on": 1, "sql": "SELECT n_name AS label, count(*) AS n FROM sql_customer JOIN sql_nation ON c_nationkey = n_nationkey GROUP BY 1 ORDER BY n DESC, label LIMIT 5"},
        {"id": 1, "description": "nations", "source_id": "sql.nation", "source_type": "sql", "operation": "list"},
    ]})
    a = agent.Agent(spark, sources, lambda q: ["sql.customer", "sql.unknown"], lambda q, chosen: agent.parse_plan(plan))
    rows = a.query("quantos clientes por país?").results[0].rows
    return spark.createDataFrame([(r["label"], r["n"]) for r in rows], "label string, n bigint")


@query("source_blocks", f"select source_uid, concat('- ', source_id, ': ', substr(coalesce(case when trim(embedding_hint, ' ') <> '' then trim(embedding_hint, ' ') end, description, ''), 1, 130)) as line from {_DISTINCT_SOURCES}")
def source_blocks(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "catalog_sources").select("source_uid", "source_id", "source_key", "name", "description", "business_role", "embedding_hint").distinct()
    keyed = s.withColumn("source_id", F.concat_ws("|", F.col("source_uid").cast("string"), "source_id"))
    parts = F.regexp_extract("line", r"(?s)^- (\d+)\|(.*)$", 1), F.regexp_extract("line", r"(?s)^- (\d+)\|(.*)$", 2)
    return render.compressed_lines(keyed).select(parts[0].cast("bigint").alias("source_uid"), F.concat(F.lit("- "), parts[1]).alias("line"))


# ================================================================ synthesis and streams
@query("synthetic_table")
def synthetic_table(spark: SparkSession, d: str) -> DataFrame:
    return synthesis.synthesize(table(spark, d, "customer"), key="c_custkey")


@query("synthetic_database")
def synthetic_database(spark: SparkSession, d: str) -> DataFrame:
    """Rows and dangling references of synthetic customers and orders."""
    tables = {t: table(spark, d, t) for t in ("customer", "orders")}
    made, _ = synthesis.synthesize_database(tables, {"customer": "c_custkey", "orders": "o_orderkey"}, [("orders", "o_custkey", "customer", "c_custkey")])
    kept = {t: materialize(df, f"synthetic-{t}") for t, df in made.items()}
    return render.synthesis_report(tables, kept).join(F.broadcast(profile.fk_coverage(kept["orders"], "o_custkey", kept["customer"], "c_custkey").select("orphans")))


@query("constraints_left", " union all ".join(f"select '{t}' as table_name, '{c}' as column_name where exists (select 1 from {t} where {w})" for t, c, w in (("customer", "c_custkey", "true"), ("orders", "o_orderkey", "true"), ("part", "p_partkey", "false"))))
def constraints_left(spark: SparkSession, d: str) -> DataFrame:
    tables = {"customer": table(spark, d, "customer"), "orders": table(spark, d, "orders"), "part": table(spark, d, "part").limit(0)}
    pk = spark.createDataFrame([("customer", "c_custkey"), ("orders", "o_orderkey"), ("part", "p_partkey")], "TABLE_NAME string, COLUMN_NAME string")
    fk = spark.createDataFrame([("orders", "o_custkey", "customer", "c_custkey")], "TABLE_NAME string, COLUMN_NAME string, REFERENCED_TABLE_NAME string, REFERENCED_COLUMN_NAME string")
    return registry.surviving_constraints(tables, pk, fk)[1].select(F.col("TABLE_NAME").alias("table_name"), F.col("COLUMN_NAME").alias("column_name"))


@query("stream_windows", "select time_bucket(interval 1 day, ts) as window_start, event_type, count(*) as n, round(sum(value), 4) as total from events group by 1, 2")
def stream_windows(spark: SparkSession, d: str) -> DataFrame:
    """The events read as a stream of files, counted by day and type, and read back."""
    import glob
    import uuid

    source = f"{d}/events.parquet"
    schema = T.StructType(table(spark, d, "events").schema.fields)
    out = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    path = source if glob.glob(f"{source}/*.parquet") else f"{d}/events*.parquet"
    arriving = windows.event_time(windows.read_stream(spark, path, schema))
    counted = windows.windowed(arriving, ["event_type"], size="1 day", late="7 days")

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/result/batch={number}")  # a batch that is run again replaces itself

    q = counted.writeStream.outputMode("update").option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).foreachBatch(keep).start()
    q.awaitTermination()
    last = F.max_by(F.struct("n", "total"), "batch").alias("s")
    back = spark.read.parquet(f"{out}/result").groupBy("window_start", "event_type").agg(last).select("window_start", "event_type", "s.*")
    return back.select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "event_type", "n", F.round("total", 4).alias("total"))


@query("sessions", "select user_id, min(ts) as session_start, max(ts) + interval 30 minute as session_end, count(*) as n from (select *, sum(fresh) over (partition by user_id order by ts, event_id rows unbounded preceding) as s from (select *, case when ts >= lag(ts) over (partition by user_id order by ts, event_id) + interval 30 minute or lag(ts) over (partition by user_id order by ts, event_id) is null then 1 else 0 end as fresh from events)) group by user_id, s")
def sessions(spark: SparkSession, d: str) -> DataFrame:
    got = windows.sessions(windows.event_time(table(spark, d, "events")), ["user_id"])
    return got.select("user_id", F.col("session_start").cast("timestamp_ntz").alias("session_start"), F.col("session_end").cast("timestamp_ntz").alias("session_end"), "n")
