"""Building a catalog from configured sources (CAT-01..05, SRC-08, PRJ-14, SNK-06, SNK-12)."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lavra.operators import catalog, profile
from lavra.sources.registry import Registry

SOURCES = "source_type string, source_key string, source_id string, name string, path string, method string, filename string, description string, business_role string, when_to_use string, when_not_to_use string, embedding_hint string, row_count bigint, column_count int, confidence_base double, error string"
COLUMNS = "source_id string, ordinal int, column_name string, native_type string, nullable boolean, is_pk boolean, is_unique_key boolean, null_rate double, cardinality bigint, min_v double, max_v double, mean_v double"


@dataclass
class Catalog:
    """The relational catalog: sources, their columns, a few records of each, and what could not be read."""

    sources: DataFrame
    columns: DataFrame
    samples: DataFrame
    errors: dict[str, str] = field(default_factory=dict)


def build(registry: Registry, existing: Catalog | None = None, force: bool = False, refresh_stats: bool = False, exact_limit: int | None = None, sample: int = 3, keys: dict[str, tuple[str, ...]] | None = None) -> Catalog:
    """Profile the registered sources that the catalog lacks, all of them if forced, and merge them in.

    refresh_stats also recounts the rows of sources that stay. A source that fails is reported and leaves its old entry.
    keys: primary key columns by source id; also the order of the sampled records, else the first column.
    """
    keys = keys or {}
    ids = registry.ids()
    if not ids:
        raise ValueError("no sources are registered")
    first = registry[ids[0]].sparkSession if existing is None else existing.sources.sparkSession
    known = {r["source_id"] for r in existing.sources.select("source_id").collect()} if existing is not None else set()
    wanted = [s for s in ids if force or refresh_stats or s not in known]
    tables, errors = registry.load_all(wanted)
    entries, columns, samples = [], [], []
    for sid, df in tables.items():
        kind, key = sid.split(".", 1)
        try:
            rows = df.count()
        except Exception as e:
            errors[sid] = str(e).split("\n")[0]
            continue
        hint = f"{catalog.UNFILLED} {key}"
        entries.append((kind, key, sid, key.replace("_", " "), None, "GET" if kind == "api" else None, f"{key}.xlsx" if kind == "spreadsheets" else None, catalog.UNFILLED, catalog.UNFILLED, catalog.UNFILLED, catalog.UNFILLED, hint, rows, len(df.columns), catalog.CONFIDENCE.get(kind), None))
        columns.append(catalog.catalog_columns(sid, df, exact_limit, keys.get(sid, ())))
        order = list(keys.get(sid, ())) or df.columns[:1]
        samples.append(profile.sample_records(df, order, sample).select(F.lit(sid).alias("source_id"), "row_no", "row_json"))
    new = first.createDataFrame(entries, SOURCES)
    made = Catalog(new.drop("error"), _union(columns, first, COLUMNS), _union(samples, first, "source_id string, row_no int, row_json string"), errors)
    if existing is None:
        return made
    fresh = made.sources.select("source_id")
    return Catalog(
        catalog.merge(existing.sources, made.sources),
        existing.columns.join(fresh, "source_id", "left_anti").unionByName(made.columns),
        existing.samples.join(fresh, "source_id", "left_anti").unionByName(made.samples),
        errors,
    )


def _union(parts: list[DataFrame], spark, schema: str) -> DataFrame:
    return reduce(DataFrame.unionByName, parts) if parts else spark.createDataFrame([], schema)


def save(made: Catalog, path: str) -> None:
    """The three frames as parquet, stamped with the time of writing; the document form is catalog.catalog_json."""
    made.sources.withColumn("updated_at", F.current_timestamp()).write.mode("overwrite").parquet(f"{path}/sources")
    made.columns.write.mode("overwrite").parquet(f"{path}/columns")
    made.samples.write.mode("overwrite").parquet(f"{path}/samples")


def load(spark, path: str) -> Catalog:
    """A saved catalog; a missing one raises FileNotFoundError."""
    try:
        return Catalog(spark.read.parquet(f"{path}/sources").drop("updated_at"), spark.read.parquet(f"{path}/columns"), spark.read.parquet(f"{path}/samples"))
    except Exception as e:
        raise FileNotFoundError(path) from e
