"""Connections and tables by name (SRC-01..08, SRC-16, SRC-24)."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def connection_url(key: str, env: dict[str, str] | None = None) -> str:
    """DB_URL_<KEY>, else DB_URL, else MYSQL_URI; credentials never live in code (SRC-24)."""
    env = os.environ if env is None else env
    for name in (f"DB_URL_{key.upper()}", "DB_URL", "MYSQL_URI"):
        if env.get(name):
            return env[name]
    raise KeyError(f"no connection for {key}")


def jdbc_table(spark: SparkSession, url: str, table: str, split: tuple[str, int, int, int] | None = None, **options: str) -> DataFrame:
    """A table over JDBC; split = (column, lower, upper, partitions) reads it in parallel (SRC-01)."""
    if split is None:
        return spark.read.jdbc(url, table, properties=options)
    column, lower, upper, n = split
    return spark.read.jdbc(url, table, column=column, lowerBound=lower, upperBound=upper, numPartitions=n, properties=options)


#: Tables of the applications around a database that are no data.
EXCLUDED_TABLES = (
    "sc_log sc_log_contratos sec_application sec_users sec_users_groups sec_groups sec_users_applications sec_groups_applications sec_apps sec_groups_apps sec_users_apps django_migrations django_session django_admin_log "
    "django_content_type auth_group auth_group_permissions auth_permission users_perfil users_perfil_user_permissions users_perfil_groups"
).split()


def base_tables(run: Callable[[str], DataFrame], exclude: Iterable[str] = EXCLUDED_TABLES) -> list[str]:
    """Base tables of the current database in order of their names, without the excluded (SRC-04). run: query text -> table."""
    rows = run("SELECT table_name FROM information_schema.tables WHERE table_schema = DATABASE() AND table_type = 'BASE TABLE'")
    return sorted({r[0] for r in rows.collect()} - set(exclude))


def declared_keys(run: Callable[[str], DataFrame], exclude: Iterable[str] = EXCLUDED_TABLES) -> tuple[DataFrame, DataFrame]:
    """(primary keys, foreign keys) that the current database declares; foreign keys with either end excluded are left out (SRC-05, SRC-06)."""
    out = list(exclude)
    usage = "information_schema.key_column_usage WHERE table_schema = DATABASE()"
    pk = run(f"SELECT table_name, column_name FROM {usage} AND constraint_name = 'PRIMARY'").toDF("TABLE_NAME", "COLUMN_NAME")
    fk = run(f"SELECT table_name, column_name, referenced_table_name, referenced_column_name FROM {usage} AND referenced_table_name IS NOT NULL")
    fk = fk.toDF("TABLE_NAME", "COLUMN_NAME", "REFERENCED_TABLE_NAME", "REFERENCED_COLUMN_NAME")
    return pk.where(~F.col("TABLE_NAME").isin(out)), fk.where(~F.col("TABLE_NAME").isin(out) & ~F.col("REFERENCED_TABLE_NAME").isin(out))


def over_jdbc(spark: SparkSession, url: str, **options: str) -> Callable[[str], DataFrame]:
    """The `run` of a database reached over JDBC."""
    return lambda query: spark.read.format("jdbc").options(url=url, query=query, **options).load()


def with_keys(columns: DataFrame, table: str, pk: DataFrame, fk: DataFrame, defaults: DataFrame | None = None) -> DataFrame:
    """columns_of() with default, is_pk and references of one table (SRC-07). defaults: TABLE_NAME, COLUMN_NAME, COLUMN_DEFAULT."""
    of = lambda df: df.where(F.col("TABLE_NAME") == table)
    keys = of(pk).select(F.col("COLUMN_NAME").alias("column_name"), F.lit(True).alias("is_pk")).distinct()
    refs = of(fk).groupBy(F.col("COLUMN_NAME").alias("column_name")).agg(F.min(F.concat_ws(".", "REFERENCED_TABLE_NAME", "REFERENCED_COLUMN_NAME")).alias("references"))
    out = columns.join(keys, "column_name", "left").join(refs, "column_name", "left")
    if defaults is not None:
        out = out.join(of(defaults).select(F.col("COLUMN_NAME").alias("column_name"), F.col("COLUMN_DEFAULT").alias("default_value")), "column_name", "left")
    else:
        out = out.withColumn("default_value", F.lit(None).cast("string"))
    return out.select("ordinal", "column_name", "native_type", "nullable", "default_value", F.coalesce("is_pk", F.lit(False)).alias("is_pk"), "references")


class Registry:
    """Sources by id, read lazily and once; reload() forgets them (SRC-16)."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self._makers: dict[str, Callable[[], DataFrame]] = {}
        self._made: dict[str, DataFrame] = {}

    def add(self, source_id: str, make: Callable[[], DataFrame]) -> None:
        self._makers[source_id] = make

    def add_parquet(self, source_id: str, path: str) -> None:
        self.add(source_id, lambda: self.spark.read.parquet(path))

    def __getitem__(self, source_id: str) -> DataFrame:
        if source_id not in self._made:
            if source_id not in self._makers:
                raise KeyError(source_id)
            self._made[source_id] = self._makers[source_id]()
        return self._made[source_id]

    def ids(self, exclude: Iterable[str] = ()) -> list[str]:
        """All ids but the excluded (SRC-04)."""
        return [s for s in self._makers if s not in set(exclude)]

    def reload(self) -> None:
        self._made.clear()

    def load_all(self, ids: Iterable[str] | None = None) -> tuple[dict[str, DataFrame], dict[str, str]]:
        """(tables, errors): a table that fails is reported and the others go on (SRC-02, SRC-08)."""
        good, bad = {}, {}
        for s in ids if ids is not None else self._makers:
            try:
                good[s] = self[s]
            except Exception as e:
                bad[s] = str(e).split("\n")[0]
        return good, bad


def columns_of(df: DataFrame) -> DataFrame:
    """(ordinal, column_name, native_type, nullable) of a table's schema (SRC-07)."""
    rows = [(i + 1, f.name, f.dataType.simpleString(), f.nullable) for i, f in enumerate(df.schema.fields)]
    return df.sparkSession.createDataFrame(rows, "ordinal int, column_name string, native_type string, nullable boolean")


def surviving_constraints(tables: dict[str, DataFrame], pk: DataFrame, fk: DataFrame) -> tuple[dict[str, DataFrame], DataFrame, DataFrame]:
    """Tables with rows, primary keys of those, foreign keys whose two ends have rows (PRJ-05)."""
    kept = {n: df for n, df in tables.items() if not df.isEmpty()}
    names = list(kept)
    both = F.col("TABLE_NAME").isin(names) & F.col("REFERENCED_TABLE_NAME").isin(names) if names else F.lit(False)
    return kept, pk.where(F.col("TABLE_NAME").isin(names) if names else F.lit(False)), fk.where(both)


def demo_tables(spark: SparkSession) -> dict[str, DataFrame]:
    """Four small invented tables with repeats, blanks and nulls, for demonstrations of masking (SRC-23)."""
    makers = [(1, "Fábrica Um", "00.000.000/0001-00", "Rua A, 1", "Alto Tamandua"), (2, "Fábrica Dois", "00.000.000/0002-00", "Rua B, 2", "Baia Mansa"), (3, "Fábrica Um", None, "", "Colina Rasa"), (4, "Fábrica Três", "00.000.000/0004-00", "Rua D, 4", None), (5, "Fábrica Dois", "00.000.000/0002-00", "Rua B, 2", "Baia Mansa")]
    goods = [(i, f"Rádio {i % 3}", i % 5 + 1, f"lote {i}", 10.5 * i, f"2024-0{i % 9 + 1}-15") for i in range(1, 8)]
    units = [(i, f"Unidade {i}", f"U{i}", "Foz Escura", -20.0 - i, -45.0 - i) for i in range(1, 6)]
    moves = [(i, i % 7 + 1, i % 5 + 1, (i + 1) % 5 + 1, 100 + i % 3, 5 * i, 50 * i, "ok" if i % 2 else "", None if i % 4 == 0 else "obs") for i in range(1, 11)]
    return {
        "fabricantes": spark.createDataFrame(makers, "id bigint, nome string, cnpj string, endereco string, cidade string"),
        "materiais": spark.createDataFrame(goods, "id bigint, nome string, cod_fabricante bigint, descricao string, preco double, data_cadastro string"),
        "unidades": spark.createDataFrame(units, "id bigint, nome string, sigla string, cidade string, latitude double, longitude double"),
        "movimentacoes": spark.createDataFrame(moves, "id bigint, id_material bigint, origem bigint, destino bigint, usuario bigint, quantidade bigint, valor bigint, status string, observacoes string"),
    }


def all_strings(schema: T.StructType) -> T.StructType:
    return T.StructType([T.StructField(f.name, T.StringType()) for f in schema.fields])


def folder(spark: SparkSession, path: str, kind: str = "sql") -> Registry:
    """A registry of every parquet table in a local folder (SRC-03, SRC-13)."""
    found = Registry(spark)
    for name in sorted(os.listdir(path)):
        if name.endswith(".parquet"):
            found.add_parquet(f"{kind}.{name.removesuffix('.parquet')}", os.path.join(path, name))
    return found
