"""Queries of the operators for training-data text, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lavra.llm import canonical, distinctive, leakage, packing, residue, sentences
from lavra.session import materialize, spread, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(f):
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return register


# ---------------------------------------------------------------- problem 4
_TERMS = r"""
with records as (
  select 'query' as record_kind, query_uid as record_uid, coalesce(query, '') as text from benchmark_queries
  union select distinct 'source', source_uid, concat_ws(chr(10), description, embedding_hint) from catalog_sources),
tokens as (select record_kind, record_uid, unnest(regexp_extract_all(lower(strip_accents(lower(text))), '[\p{L}\p{N}]+(?:-[\p{L}\p{N}]+)*')) as term from records),
postings as (select record_kind, record_uid, term, count(*) as tf from tokens group by all),
stats as (select term, count(*) as df, sum(tf) as ctf from postings group by term),
lengths as (select record_kind, record_uid, sum(tf) as len from postings group by all),
scored as (select p.record_kind, p.record_uid, p.term, p.tf, s.df,
  (p.tf + 200 * s.ctf / t.total) / (l.len + 200) as p_d, s.ctf / t.total as p_c
  from postings p join stats s using (term) join lengths l using (record_kind, record_uid) cross join (select cast(sum(tf) as double) as total from postings) t)
"""


def _collection(spark: SparkSession, d: str) -> DataFrame:
    asked = distinctive.records(table(spark, d, "benchmark_queries"), "query", "query_uid", ["query"])
    return asked.unionByName(distinctive.records(table(spark, d, "catalog_sources"), "source", "source_uid", ["description", "embedding_hint"]))


@query("p4_found", _TERMS + "select record_kind, record_uid, term from scored where tf >= 2 and df between 2 and 5")
def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return distinctive.typical(distinctive.weights(_collection(spark, d))).select("record_kind", "record_uid", "term")


@query("p4_weights", _TERMS + "select record_kind, record_uid, term, cast(tf as bigint) as tf, cast(df as bigint) as df, round(p_d * log2(p_d / p_c), 6) as weight from scored where df >= 2")
def p4_weights(spark: SparkSession, d: str) -> DataFrame:
    return distinctive.weights(_collection(spark, d)).select("record_kind", "record_uid", "term", "tf", "df", F.round("weight", 6).alias("weight"))


# ---------------------------------------------------------------- problem 6
@query("p6_pack")
def p6_pack(spark: SparkSession, d: str) -> DataFrame:
    counts = materialize(packing.token_counts(table(spark, d, "documents")), "token-counts")
    return packing.pack(counts, table(spark, d, "container_specs"))


@query("p6_fill")
def p6_fill(spark: SparkSession, d: str) -> DataFrame:
    return packing.fill(p6_pack(spark, d))


# ---------------------------------------------------------------- problem 7
@query("p7_found")
def p7_found(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    return leakage.search(leakage.build_index(docs), docs, leakage.prepare_items(table(spark, d, "eval_items"))).select("doc_id", "item_id").distinct()


# ---------------------------------------------------------------- problem 8
@query("p8_found")
def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return sentences.sentences(spread(table(spark, d, "documents")))


# ---------------------------------------------------------------- problem 5
@query("p5_found")
def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return residue.flagged(residue.evidence(table(spark, d, "catalog_sources")))


@query("p5_evidence")
def p5_evidence(spark: SparkSession, d: str) -> DataFrame:
    """Fields by strength of the sign and by what record and host say; flagged counts what is reported."""
    told = residue.evidence(table(spark, d, "catalog_sources"))
    kinds = ["campo", "sign", (F.col("shared") > 0).alias("names_itself"), (F.col("terms") <= residue.LOW_INFORMATION).alias("says_little"), (F.col("same") >= residue.DUPLICATED).alias("repeated")]
    return told.groupBy(*kinds).agg(F.count("*").alias("fields"))


# ---------------------------------------------------------------- problem 3
@query("p3_found")
def p3_found(spark: SparkSession, d: str) -> DataFrame:
    rows, entries = table(spark, d, "distribuicao_d_sup"), table(spark, d, "ref_entries")
    resolved = materialize(canonical.resolve(canonical.distinct_values(rows, canonical.FIELDS, entries), entries), "resolved")
    return canonical.map_cells(rows, resolved, "dist_id", canonical.FIELDS)


@query("p3_unmatched")
def p3_unmatched(spark: SparkSession, d: str) -> DataFrame:
    """Values that name no entry, with how often each occurs."""
    rows, entries = table(spark, d, "distribuicao_d_sup"), table(spark, d, "ref_entries")
    values = canonical.distinct_values(rows, canonical.FIELDS, entries)
    resolved = materialize(canonical.resolve(values, entries), "resolved")
    cells = rows.select(*canonical.FIELDS).unpivot([], list(canonical.FIELDS), "campo", "value").groupBy("campo", "value").agg(F.count("*").alias("rows"))
    return cells.join(resolved.where("ref_id = 0"), ["campo", "value"]).select("campo", "value", "rows")


@query("p3_stages")
def p3_stages(spark: SparkSession, d: str) -> DataFrame:
    """Distinct values by the stage that named their entry."""
    rows, entries = table(spark, d, "distribuicao_d_sup"), table(spark, d, "ref_entries")
    return canonical.resolve(canonical.distinct_values(rows, canonical.FIELDS, entries), entries).groupBy("campo", "stage").agg(F.count("*").alias("values"))
