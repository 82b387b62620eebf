"""Column profiles of any table: counts, null rates, distinct values, ranges, semantic types, samples (AGG-01..09, ARR-01, SRT-03)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lavra.functions.text import strip

EXACT_LIMIT = 100_000
NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)
#: The date spellings that make a text column a date column.
DATE_FORMATS = ("yyyy-MM-dd", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss", "dd/MM/yyyy", "dd/MM/yyyy HH:mm:ss", "yyyy/MM/dd")


def _long(df: DataFrame, wide: dict[str, dict[str, Column]], fields: list[tuple[str, str]]) -> DataFrame:
    """One pass over df: every aggregate of every column at once, then one row for each column."""
    aggs = [c.alias(f"{i}__{k}") for i, (_, of) in enumerate(wide.items()) for k, c in of.items()]
    row = df.agg(*aggs)
    rows = [F.struct(F.lit(i + 1).alias("ordinal"), F.lit(name).alias("column_name"), *[F.col(f"{i}__{k}").cast(kind).alias(k) for k, kind in fields]) for i, name in enumerate(wide)]
    return row.select(F.inline(F.array(*rows)))


def _present(c: str, kind: T.DataType) -> Column:
    """Null where null or NaN."""
    return F.when(F.isnan(c), None).otherwise(F.col(c)) if isinstance(kind, (T.FloatType, T.DoubleType)) else F.col(c)


def distinct_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """Exact distinct non-null values of each column: (column, value) groups are combined before the shuffle, so no value or column fills one task."""
    cells = df.select(*[F.col(c).cast("string").alias(c) for c in columns]).unpivot([], columns, "column_name", "value")
    return cells.where("value is not null").groupBy("column_name", "value").agg(F.lit(1).alias("one")).groupBy("column_name").agg(F.sum("one").alias("cardinality"))


def profile(df: DataFrame, exact_limit: int | None = None, decimals: int = 4) -> DataFrame:
    """(ordinal, column_name, native_type, row_count, null_rate, nullable, cardinality, cardinality_kind, is_unique_key, min_v, max_v, mean_v).

    Distinct values are exact up to exact_limit rows (None: always) and a sketch beyond, as cardinality_kind says; whether a
    sketched column is a key is not known, so null. An empty table has null rate 0 and no ranges; NaN counts as null; means are given for fractional columns only.
    """
    kinds = {f.name: f.dataType for f in df.schema.fields}
    flat = {c: k for c, k in kinds.items() if not isinstance(k, (T.ArrayType, T.MapType, T.StructType, T.BinaryType))}
    wide = {}
    sketch = exact_limit is not None and df.count() > exact_limit
    for c, k in flat.items():
        v = _present(c, k)
        number = v.cast("double") if isinstance(k, NUMERIC) else F.lit(None).cast("double")
        wide[c] = {
            "row_count": F.count(F.lit(1)),
            "nulls": F.coalesce(F.sum(v.isNull().cast("long")), F.lit(0)),
            "min_v": F.min(number),
            "max_v": F.max(number),
            "mean_v": F.round(F.avg(number), 2) if isinstance(k, (T.FloatType, T.DoubleType, T.DecimalType)) else F.lit(None).cast("double"),
            "sketched": F.approx_count_distinct(v) if sketch else F.max(F.lit(None).cast("long")),
        }
    base = _long(df, wide, [("row_count", "bigint"), ("nulls", "bigint"), ("min_v", "double"), ("max_v", "double"), ("mean_v", "double"), ("sketched", "bigint")])
    types = F.create_map(*[x for c, k in flat.items() for x in (F.lit(c), F.lit(k.simpleString()))])
    if sketch:
        counted = base.withColumn("cardinality", F.col("sketched"))
    else:
        counted = base.join(distinct_counts(df.select(*[_present(c, k).alias(c) for c, k in flat.items()]), list(flat)), "column_name", "left").withColumn("cardinality", F.coalesce("cardinality", F.lit(0)))
    rate = F.when(F.col("row_count") > 0, F.round(F.col("nulls") / F.col("row_count"), decimals)).otherwise(0.0)
    return counted.select(
        "ordinal", "column_name", types[F.col("column_name")].alias("native_type"), "row_count", rate.alias("null_rate"), (F.col("nulls") > 0).alias("nullable"), "cardinality",
        F.lit("approximate" if sketch else "exact").alias("cardinality_kind"), (F.lit(None).cast("boolean") if sketch else (F.col("nulls") == 0) & (F.col("row_count") > 0) & (F.col("cardinality") == F.col("row_count"))).alias("is_unique_key"), "min_v", "max_v", "mean_v",
    )


def parse_date(c: Column, formats: tuple[str, ...] = DATE_FORMATS) -> Column:
    """Timestamp in the first format that fits, else null."""
    return F.coalesce(*[F.try_to_timestamp(c, F.lit(f)) for f in formats])


def date_ranges(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(column_name, date_min, date_max, unparsed) of date, timestamp and text columns (AGG-08)."""
    kinds = {f.name: f.dataType for f in df.schema.fields}
    chosen = columns or [c for c, k in kinds.items() if isinstance(k, (T.DateType, T.TimestampType, T.TimestampNTZType))]
    wide = {}
    for c in chosen:
        at = parse_date(F.col(c)) if isinstance(kinds[c], T.StringType) else F.col(c).cast("timestamp")
        wide[c] = {"date_min": F.min(at), "date_max": F.max(at), "unparsed": F.sum((F.col(c).isNotNull() & at.isNull()).cast("long"))}
    return _long(df, wide, [("date_min", "timestamp"), ("date_max", "timestamp"), ("unparsed", "bigint")]).drop("ordinal")


def semantic_types(df: DataFrame, order_by: list[str], sample: int = 50) -> DataFrame:
    """(column_name, semantic_type): what the first non-null values of each column look like (ARR-01).

    Integer columns with exactly two values are boolean_integer. Text columns are date_string if all of the first `sample`
    values are dates, code_identifier if they are short and more than 80 % are capital codes, document_number if more than
    half begin like one, else string. All-null columns are string. The sample is the least `sample` rows by order_by.
    """
    kinds = {f.name: f.dataType for f in df.schema.fields}
    ints = [c for c, k in kinds.items() if isinstance(k, (T.ByteType, T.ShortType, T.IntegerType, T.LongType))]
    texts = [c for c, k in kinds.items() if isinstance(k, T.StringType)]

    def fixed(c: str) -> str:
        k = kinds[c]
        if isinstance(k, (T.DateType, T.TimestampType, T.TimestampNTZType)):
            return "datetime"
        if isinstance(k, (T.FloatType, T.DoubleType, T.DecimalType)):
            return "float"
        return "boolean" if isinstance(k, T.BooleanType) else k.simpleString()

    rest = [c for c in kinds if c not in ints and c not in texts]
    parts = []
    if rest:
        parts.append(df.limit(0).sparkSession.createDataFrame([(c, fixed(c)) for c in rest], "column_name string, semantic_type string"))
    if ints:
        two = distinct_counts(df, ints)
        names = df.sparkSession.createDataFrame([(c,) for c in ints], "column_name string")
        parts.append(names.join(two, "column_name", "left").select("column_name", F.when(F.col("cardinality") == 2, "boolean_integer").otherwise("integer").alias("semantic_type")))
    for c in texts:
        head = df.where(F.col(c).isNotNull()).orderBy(*order_by).select(F.col(c).alias("v")).limit(sample)
        looks = head.agg(
            F.count("*").alias("n"), F.bool_and(parse_date(F.col("v")).isNotNull()).alias("dates"), F.max(F.length("v")).alias("longest"),
            F.avg(F.col("v").rlike(r"^[A-Z0-9\-_/]+$").cast("double")).alias("codes"), F.avg(F.col("v").rlike(r"^\d{2,3}\.\d{3}\.\d{3}").cast("double")).alias("documents"),
        )
        kind = F.when(F.col("n") == 0, "string").when(F.col("dates"), "date_string").when((F.col("longest") <= 20) & (F.col("codes") > 0.8), "code_identifier").when(F.col("documents") > 0.5, "document_number").otherwise("string")
        parts.append(looks.select(F.lit(c).alias("column_name"), kind.alias("semantic_type")))
    return reduce(DataFrame.unionByName, parts)


def sample_records(df: DataFrame, order_by: list[str], n: int = 3) -> DataFrame:
    """(row_no, row_json) of the first n rows in a stated order (SRT-03, ARR-07)."""
    body = F.to_json(F.struct(*[F.col(c) for c in df.columns]), {"ignoreNullFields": "false"})
    from pyspark.sql import Window

    top = df.orderBy(*order_by).limit(n)
    return top.select(F.row_number().over(Window.orderBy(*order_by)).alias("row_no"), body.alias("row_json"))


def sample_values(df: DataFrame, order_by: list[str], n: int = 3) -> DataFrame:
    """(column_name, samples): different values of each column in the first n rows, first seen first; columns without any are left out (AGG-24)."""
    top = df.orderBy(*order_by).limit(n).select(F.struct(*order_by).alias("at"), *[F.col(c).cast("string").alias(c) for c in df.columns])
    listed = top.agg(*[F.array_distinct(F.filter(F.transform(F.array_sort(F.collect_list(F.struct("at", F.col(c).alias("v")))), lambda x: x["v"]), lambda v: v.isNotNull())).alias(c) for c in df.columns])
    return listed.unpivot([], df.columns, "column_name", "samples").where(F.size("samples") > 0)


def normalize_datetimes(df: DataFrame, columns: list[str], formats: tuple[str, ...] = DATE_FORMATS) -> tuple[DataFrame, DataFrame]:
    """df with text columns parsed, blanks and unreadable ones null, and (column_name, coerced) counts (DAT-02, AGG-27)."""
    parsed = {c: parse_date(F.nullif(strip(F.col(c)), F.lit("")), formats) for c in columns}
    lost = _long(df, {c: {"coerced": F.sum(((strip(F.col(c)) != "") & parsed[c].isNull()).cast("long"))} for c in columns}, [("coerced", "bigint")]).select("column_name", F.coalesce("coerced", F.lit(0)).alias("coerced"))
    return df.withColumns(parsed), lost


def fk_coverage(child: DataFrame, column: str, parent: DataFrame, key: str) -> DataFrame:
    """(rows, orphans, coverage) of a declared foreign key; null references are not orphans."""
    keys = parent.select(F.col(key).alias("__key")).distinct()
    joined = child.where(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("n")).join(keys, F.col(column) == F.col("__key"), "left")
    return joined.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), F.coalesce(F.sum(F.when(F.col("__key").isNull(), F.col("n"))), F.lit(0)).alias("orphans")).withColumn("coverage", F.when(F.col("rows") > 0, F.round(1 - F.col("orphans") / F.col("rows"), 4)).otherwise(1.0))
