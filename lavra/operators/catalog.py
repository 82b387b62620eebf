"""The relational catalog: reading, incremental building, merging, documents of its sources (JN-09, PRJ-14, CAT-*, RET-02, ARR-*)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lavra.functions.text import manual_placeholder
from lavra.operators.profile import profile

#: Fields that people fill in and an extraction must not overwrite, and the mark of an unfilled one.
MANUAL_FIELDS = ("description", "business_role", "when_to_use", "when_not_to_use", "embedding_hint")
UNFILLED = "[MANUAL]"
#: Columns that say nothing about a source, and how many others describe it.
GENERIC_COLUMNS = ("CODIGO", "ID", "id", "ULTIMAATUALIZACAO", "created_at", "updated_at", "DATAINCLUSAOCARGA", "usuario_decisao_id")
DOCUMENT_COLUMNS = 8
CONFIDENCE = {"sql": 0.95, "api": 0.9, "spreadsheets": 0.75}


def filled(c: Column) -> Column:
    return c.isNotNull() & ~c.contains(UNFILLED)


def needs_extraction(config: DataFrame, catalog: DataFrame, keys: tuple[str, ...] = ("source_type", "source_key"), force: bool = False) -> DataFrame:
    """Configured sources that the catalog lacks, or all of them if forced (PRJ-14)."""
    return config if force else config.join(catalog.select(*keys).distinct(), list(keys), "left_anti")


def merge(old: DataFrame, new: DataFrame, keys: tuple[str, ...] = ("source_type", "source_key"), manual: tuple[str, ...] = MANUAL_FIELDS) -> DataFrame:
    """Upsert: extracted rows replace stored ones, filled-in manual fields stay, rows of one side only stay (JN-09).

    Failed extractions, with an `error` that is not null, do not replace anything. Columns that one side lacks are null there.
    """
    if "error" in new.columns:
        new = new.where("error is null").drop("error")
    columns = list(dict.fromkeys([*old.columns, *new.columns]))
    o, n = old.alias("o"), new.alias("n")
    both = o.join(n, [F.col(f"o.{k}").eqNullSafe(F.col(f"n.{k}")) for k in keys], "full_outer")
    arrived = F.coalesce(*[F.col(f"n.{k}").isNotNull() for k in keys])

    def pick(c: str) -> Column:
        if c not in new.columns:
            return F.col(f"o.{c}")
        if c not in old.columns:
            return F.col(f"n.{c}")
        if c in keys:
            return F.coalesce(F.col(f"n.{c}"), F.col(f"o.{c}"))
        if c in manual:
            return F.coalesce(F.when(filled(F.col(f"o.{c}")), F.col(f"o.{c}")), F.col(f"n.{c}"), F.col(f"o.{c}"))
        return F.when(arrived, F.col(f"n.{c}")).otherwise(F.col(f"o.{c}"))

    return both.select(*[pick(c).alias(c) for c in columns])


def with_hint_placeholders(sources: DataFrame) -> DataFrame:
    """An explicit unfilled mark only where the hint is missing (CAT-03)."""
    return sources.withColumn("embedding_hint", F.coalesce("embedding_hint", F.concat(F.lit(UNFILLED + " "), F.col("source_key"))))


def catalog_columns(source_id: str, table: DataFrame, exact_limit: int | None = None, pk: tuple[str, ...] = ()) -> DataFrame:
    """Catalog rows for the columns of one table (CAT-04)."""
    return profile(table, exact_limit).select(F.lit(source_id).alias("source_id"), "ordinal", "column_name", "native_type", "nullable", F.col("column_name").isin(*pk).alias("is_pk") if pk else F.lit(False).alias("is_pk"), "is_unique_key", "null_rate", "cardinality", "min_v", "max_v", "mean_v")


def source_documents(sources: DataFrame, columns: DataFrame | None = None) -> DataFrame:
    """(source_id, doc): the filled hint, else name, description, role and at most eight telling columns (RET-02, PRJ-11)."""
    text = lambda c: manual_placeholder(F.col(c), F.col("name"))
    hint = filled(F.col("embedding_hint")) & (F.trim("embedding_hint") != "")
    if columns is not None:
        from pyspark.sql import Window

        telling = columns.where(~F.col("column_name").isin(*GENERIC_COLUMNS)).withColumn("rn", F.row_number().over(Window.partitionBy("source_id").orderBy("ordinal", "column_name"))).where(F.col("rn") <= DOCUMENT_COLUMNS)
        named = telling.groupBy("source_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rn", "column_name"))), lambda x: x["column_name"]), ", ").alias("cols"))
        sources = sources.join(named, "source_id", "left")
    else:
        sources = sources.withColumn("cols", F.lit(None).cast("string"))
    described = F.concat_ws("\n", F.col("name"), text("description"), text("business_role"), F.col("cols"))
    return sources.select("source_id", F.when(hint, F.trim("embedding_hint")).otherwise(described).alias("doc"))


def catalog_json(sources: DataFrame) -> DataFrame:
    """One document: {source_type: {source_key: {...}}} as JSON text, for catalogs small enough to be one file (SNK-06)."""
    body = F.struct(*[F.col(c) for c in sources.columns if c not in ("source_type", "source_key")])
    per = sources.groupBy("source_type").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col("source_key").alias("key"), F.to_json(body).alias("value"))))).alias("entries"))
    return per.agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col("source_type").alias("key"), F.col("entries").alias("value")))))).alias("document"))


# ---------------------------------------------------------------- types in JSON (ARR-02..05)
def json_type(text: Column) -> Column:
    """Name of the type of one JSON value; strings are told apart by their look, arrays by their first element."""
    kind = F.schema_of_variant(F.try_parse_json(text))
    inner = F.trim(F.regexp_replace(text, '^\\s*"|"\\s*$', ""))
    look = (
        F.when(inner.rlike(r"^\d{4}-\d{2}-\d{2}"), "date_string (ISO 8601)")
        .when(inner.rlike(r"^https?://"), "url_string")
        .when(inner.rlike(r"^[A-Z0-9\-_]{2,20}$"), "code_identifier")
        .otherwise("string")
    )
    return (
        F.when(kind.isNull() | (kind == "VOID"), "null|unknown")
        .when(kind == "BOOLEAN", "boolean")
        .when(kind.rlike(r"^(BIGINT|INT|SMALLINT|TINYINT|DECIMAL\(\d+,0\))$"), "integer")
        .when(kind.rlike(r"^(DECIMAL|DOUBLE|FLOAT)"), "float")
        .when(kind.startswith("ARRAY"), F.concat(F.lit("array["), F.lower(F.regexp_extract(kind, r"^ARRAY<(.*)>$", 1)), F.lit("]")))
        .when(kind.startswith("OBJECT"), "object")
        .otherwise(look)
    )


def json_fields(df: DataFrame, key: str, payload: str) -> DataFrame:
    """(key, field, type, example) of every top-level field of each object; examples are cut at 80 characters (ARR-03)."""
    entries = df.select(key, F.explode(F.from_json(payload, T.MapType(T.StringType(), T.StringType()))).alias("field", "raw"))
    quoted = F.when(F.try_parse_json("raw").isNull(), F.to_json(F.array("raw"))).otherwise(F.concat(F.lit("["), F.col("raw"), F.lit("]")))
    value = F.regexp_replace(quoted, r"^\[|\]$", "")
    return entries.select(key, "field", json_type(value).alias("type"), F.substring("raw", 1, 80).alias("example"))


def response_shape(payload: Column) -> Column:
    """paginated, array, object or unknown (ARR-04)."""
    v = F.try_parse_json(payload)
    kind = F.schema_of_variant(v)
    return F.when(kind.startswith("OBJECT") & F.try_variant_get(v, "$.results", "variant").isNotNull(), "paginated").when(kind.startswith("ARRAY"), "array").when(kind.startswith("OBJECT"), "object").otherwise("unknown")


def paginated(payload: Column) -> Column:
    """(count, has_next, first_item) of a paginated response (ARR-05)."""
    v = F.try_parse_json(payload)
    return F.struct(F.try_variant_get(v, "$.count", "bigint").alias("count"), F.try_variant_get(v, "$.next", "string").isNotNull().alias("has_next"), F.to_json(F.try_variant_get(v, "$.results[0]", "variant")).alias("first_item"))
