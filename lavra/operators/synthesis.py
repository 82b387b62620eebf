"""Synthetic tables with the marginals, correlations and keys of real ones (SYN-01..04, JN-14)."""

from __future__ import annotations

from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lavra.operators.numbering import number_rows
from lavra.session import materialize

QUANTILES = 1000
#: Text columns of more values than this are drawn from a written table instead of the model.
TOP_VALUES = 10_000


def topological(tables: list[str], edges: list[tuple[str, str]]) -> tuple[list[str], list[tuple[str, str]]]:
    """(parents before children, edges left out as cyclic or dangling); edges are (child, parent)."""
    kept, dropped, up = [], [], {t: set() for t in tables}

    def reaches(a: str, b: str) -> bool:
        seen, todo = set(), [a]
        while todo:
            x = todo.pop()
            if x == b:
                return True
            if x not in seen:
                seen.add(x)
                todo += up[x]
        return False

    for child, parent in edges:
        if child not in up or parent not in up or reaches(parent, child):
            dropped.append((child, parent))
        else:
            up[child].add(parent)
            kept.append((child, parent))
    order: list[str] = []
    while len(order) < len(tables):
        order += [t for t in tables if t not in order and up[t] <= set(order)]
    return order, dropped


def _numeric(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType))]


def _number(c: str, kind: T.DataType) -> Column:
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return F.col(c).cast("timestamp").cast("double")
    return F.col(c).cast("double")


class Copula:
    """Gaussian copula of one table, fitted with distributed quantiles, value counts and correlations.

    Model size is bounded: QUANTILES knots for a numeric or time column, the values of a text column up to TOP_VALUES, and
    one correlation matrix over the columns. Where a text column has more values, they are written as a table, numbered
    among those of equal count, and the model keeps one entry for each count; all are scored and drawn by joins.
    """

    def __init__(self, df: DataFrame, skip: tuple[str, ...] = (), accuracy: int = 10_000):
        self.schema = [f for f in df.schema.fields if f.name not in skip]
        self.numbers = [f.name for f in self.schema if f.name in _numeric(df) or isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType, T.DateType))]
        self.texts = [f.name for f in self.schema if isinstance(f.dataType, (T.StringType, T.BooleanType))]
        kinds = {f.name: f.dataType for f in self.schema}
        self.kinds = kinds
        shares = [i / QUANTILES for i in range(QUANTILES + 1)]
        total = F.count(F.lit(1)).alias("__n")
        aggs = [F.percentile_approx(_number(c, kinds[c]), shares, accuracy).alias(f"q_{i}") for i, c in enumerate(self.numbers)]
        nulls = [F.avg(F.col(f.name).isNull().cast("double")).alias(f"z_{i}") for i, f in enumerate(self.schema)]
        row = df.agg(total, *aggs, *nulls).first()
        self.rows = row["__n"]
        self.knots = {c: np.array(row[f"q_{i}"] or [0.0]) for i, c in enumerate(self.numbers)}
        self.nulls = {f.name: row[f"z_{i}"] or 0.0 for i, f in enumerate(self.schema)}
        self.values, self.large = {}, {}
        for c in self.texts:
            counts = df.where(F.col(c).isNotNull()).groupBy(c).agg(F.count("*").alias("n"))
            top = counts.orderBy(F.desc("n"), c).limit(TOP_VALUES + 1).collect()
            if len(top) > TOP_VALUES:
                written = materialize(number_rows(counts.select(F.col(c).alias("value"), "n"), ["n"], ["value"], "place"), "values")
                self.large[c] = (written, _Counts(written.groupBy("n").agg(F.count("*").alias("values")).orderBy(F.desc("n")).collect()))
                continue
            n = np.array([r["n"] for r in top], dtype=float)
            self.values[c] = ([r[c] for r in top], np.cumsum(n) / n.sum() if len(n) else n)
        self.columns = [*self.numbers, *[c for c in self.texts if c in self.large or self.values[c][0]]]
        self.matrix = self._correlation(df)

    def _scores(self, c: str):
        if c in self.knots:
            knots = self.knots[c]

            @F.pandas_udf("double")
            def of_number(v: pd.Series) -> pd.Series:
                left, right = np.searchsorted(knots, v, "left"), np.searchsorted(knots, v, "right")
                u = np.clip((left + right) / (2 * len(knots)), 1e-4, 1 - 1e-4)
                z = np.array([_INVERSE(x) for x in u]) if len(u) < 64 else np.interp(u, _GRID, _NORMAL)
                return pd.Series(np.where(v.isna(), 0.0, z))

            return of_number(_number(c, self.kinds[c]))
        if c in self.large:
            counts = self.large[c][1]

            @F.pandas_udf("double")
            def of_place(n: pd.Series, place: pd.Series) -> pd.Series:
                u = np.where(n.isna(), 0.5, counts.middle(n.fillna(1).to_numpy(float), place.fillna(1).to_numpy(float)))
                return pd.Series(np.interp(np.clip(u, 1e-4, 1 - 1e-4), _GRID, _NORMAL))

            return of_place(F.col(f"__n_{self.texts.index(c)}"), F.col(f"__place_{self.texts.index(c)}"))
        values, upto = self.values[c]
        middle = dict(zip(values, (np.concatenate([[0], upto[:-1]]) + upto) / 2))

        @F.pandas_udf("double")
        def of_value(v: pd.Series) -> pd.Series:
            u = np.clip(v.map(middle).fillna(0.5).to_numpy(float), 1e-4, 1 - 1e-4)
            return pd.Series(np.interp(u, _GRID, _NORMAL))

        return of_value(F.col(c))

    def _correlation(self, df: DataFrame) -> np.ndarray:
        k = len(self.columns)
        if k < 2 or not self.rows:
            return np.eye(max(k, 1))
        for c, (written, _) in self.large.items():
            i = self.texts.index(c)
            df = df.join(written.select(F.col("value").alias(c), F.col("n").alias(f"__n_{i}"), F.col("place").alias(f"__place_{i}")), c, "left")
        scored = df.select(*[self._scores(c).alias(f"s{i}") for i, c in enumerate(self.columns)])
        pairs = [(i, j) for i in range(k) for j in range(i)]
        row = scored.agg(*[F.corr(f"s{i}", f"s{j}").alias(f"c{i}_{j}") for i, j in pairs]).first()
        m = np.eye(k)
        for i, j in pairs:
            v = row[f"c{i}_{j}"]
            m[i, j] = m[j, i] = 0.0 if v is None or np.isnan(v) else v
        w, q = np.linalg.eigh(m)
        m = q @ np.diag(np.maximum(w, 1e-6)) @ q.T
        d = np.sqrt(np.diag(m))
        return m / np.outer(d, d)

    def sample(self, spark, n: int, seed: int = 42, key: str | None = None, numbered: bool = False) -> DataFrame:
        """n synthetic rows made where they are stored: every row depends on its number (column __row, if numbered) and the seed only."""
        root = np.linalg.cholesky(self.matrix)
        columns, knots, values, nulls, kinds = self.columns, self.knots, self.values, self.nulls, self.kinds
        counts = {c: of for c, (_, of) in self.large.items()}
        places = {c: (f"__n_{self.texts.index(c)}", f"__place_{self.texts.index(c)}") for c in counts}
        fields = [f for f in self.schema if f.name in columns or f.name == key]
        out = T.StructType([T.StructField("__row", T.LongType()), *[T.StructField(c, T.DoubleType() if c in knots else (T.BooleanType() if isinstance(kinds[c], T.BooleanType) else T.StringType())) for c in columns if c not in counts], *[T.StructField(x, T.LongType()) for pair in places.values() for x in pair]])

        def make(batches):
            for pdf in batches:
                ids = pdf["id"].to_numpy()
                z = np.interp(uniform(ids, len(columns), seed), _PHI, _Z)
                miss = uniform(ids, len(columns), seed + 1)
                u = np.interp(z @ root.T, _NORMAL, _GRID)
                p = np.interp(z @ root.T, _Z, _PHI)  # up to the ends, so that rare values are drawn too
                made = {"__row": ids}
                for j, c in enumerate(columns):
                    if c in knots:
                        v = np.interp(u[:, j], np.linspace(0, 1, len(knots[c])), knots[c])
                        made[c] = np.where(miss[:, j] < nulls[c], np.nan, v)
                    elif c in counts:
                        n, place = counts[c].find(p[:, j])
                        made[places[c][0]], made[places[c][1]] = np.where(miss[:, j] < nulls[c], 0, n), place
                    else:
                        names, upto = values[c]
                        at = np.minimum(np.searchsorted(upto, p[:, j]), len(names) - 1)
                        made[c] = [None if miss[r, j] < nulls[c] else names[a] for r, a in enumerate(at)]
                yield pd.DataFrame(made)

        raw = spark.range(n).mapInPandas(make, out)
        for c, (written, _) in self.large.items():
            raw = raw.join(written.select(F.col("value").alias(c), F.col("n").alias(places[c][0]), F.col("place").alias(places[c][1])), list(places[c]), "left")

        def typed(f: T.StructField) -> Column:
            if f.name == key:
                return (F.col("__row") + 1).cast(f.dataType).alias(f.name)
            v = F.when(F.isnan(f.name), None).otherwise(F.col(f.name)) if f.name in knots else F.col(f.name)
            if isinstance(f.dataType, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
                v = F.round(v)
            if isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType, T.DateType)):
                v = v.cast("timestamp")
            return v.cast(f.dataType).alias(f.name)

        return raw.select(*[typed(f) for f in fields], *(["__row"] if numbered else []))


def uniform(ids: np.ndarray, columns: int, seed: int) -> np.ndarray:
    """A number in [0, 1) for every row and column from the row's number and the seed alone, a whole batch at a time (SplitMix64)."""
    with np.errstate(over="ignore"):
        # fixed values: the increment and the two multipliers of SplitMix64
        x = ids.astype(np.uint64)[:, None] * np.uint64(columns + 1) + np.arange(1, columns + 1, dtype=np.uint64) + np.uint64(seed % 2**32) * np.uint64(2**32 + 15)
        x = x * np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        x = x ^ (x >> np.uint64(31))
    return (x >> np.uint64(11)).astype(np.float64) * 2.0**-53


class _Counts:
    """The counts of a written table of values, from the highest: cumulated rows, and places among values of equal count."""

    def __init__(self, rows: list):
        self.n, self.values = (np.array([r[k] for r in rows], dtype=float) for k in ("n", "values"))
        self.upto = np.cumsum(self.n * self.values)
        self.start = self.upto - self.n * self.values

    def middle(self, n: np.ndarray, place: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(-self.n, -n), len(self.n) - 1)
        return (self.start[at] + (place - 0.5) * n) / self.upto[-1]

    def find(self, u: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.minimum(np.searchsorted(self.upto, u * self.upto[-1], "right"), len(self.n) - 1)
        place = np.floor((u * self.upto[-1] - self.start[at]) / self.n[at]) + 1
        return self.n[at].astype(np.int64), np.clip(place, 1, self.values[at]).astype(np.int64)


_INVERSE = NormalDist().inv_cdf
_GRID = np.linspace(1e-4, 1 - 1e-4, 4001)
_NORMAL = np.array([_INVERSE(x) for x in _GRID])
_Z = np.linspace(-8, 8, 16_001)
_PHI = np.array([NormalDist().cdf(x) for x in _Z])


def synthesize(df: DataFrame, rows: int | None = None, seed: int = 42, key: str | None = None, numbered: bool = False) -> DataFrame:
    """Synthetic rows like df, as many as df has unless told otherwise (SYN-01). An empty table gives an empty one."""
    model = Copula(df)
    if not model.rows:
        return df.limit(0).withColumn("__row", F.lit(0)) if numbered else df.limit(0)
    return model.sample(df.sparkSession, model.rows if rows is None else rows, seed, key, numbered)


def _along(x: np.ndarray, y: np.ndarray):
    """The broken line through (x, y) as a function of a column; as many points as there are different child counts."""

    @F.pandas_udf("double")
    def of(u: pd.Series) -> pd.Series:
        return pd.Series(np.interp(u, x, y))

    return of


def synthesize_database(tables: dict[str, DataFrame], primary: dict[str, str], foreign: list[tuple[str, str, str, str]], scale: float = 1.0, seed: int = 42) -> tuple[dict[str, DataFrame], list[tuple[str, str]]]:
    """(synthetic tables, foreign keys left out): keys are numbered anew and children point to synthetic parents (SYN-02).

    foreign: (child, column, parent, key). How many children a parent has follows the real table: a child draws its parent
    by the quantile of the real parents' ranks, so parents with many children stay as frequent as they are.
    """
    order, dropped = topological(list(tables), [(c, p) for c, _, p, _ in foreign])
    made: dict[str, DataFrame] = {}
    sizes = {t: df.count() for t, df in tables.items()}
    for i, t in enumerate(order):
        df = tables[t]
        spark = df.sparkSession
        out = synthesize(df, max(0, round(sizes[t] * scale)), seed + i, primary.get(t), numbered=True)
        for child, column, parent, key in foreign:
            if child != t or (child, parent) in dropped:
                continue
            n = max(1, round(sizes[parent] * scale))
            per = df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("n")).groupBy("n").agg(F.count("*").alias("parents")).orderBy(F.desc("n")).collect()
            total = sum(r["n"] * r["parents"] for r in per) or 1
            upto, at, real = [0.0], [0.0], max(1, sum(r["parents"] for r in per))
            for r in per:
                upto.append(upto[-1] + r["n"] * r["parents"] / total)
                at.append(at[-1] + r["parents"] / real)
            share = min(1.0, real / max(1, sizes[parent]))
            u = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(f"{seed}|{column}"), F.col("__row").cast("string"))), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)
            place = _along(np.array(upto), np.array(at))(u)
            out = out.withColumn(column, (F.floor(place * share * n) + 1).cast(df.schema[column].dataType))
        made[t] = out.select(*[c for c in df.columns if c in out.columns])
    return made, dropped


def metadata(tables: dict[str, DataFrame], pk: list[tuple[str, str]], fk: list[tuple[str, str, str, str]]) -> dict:
    """Column kinds, keys and relationships of a database, with how many relationships hold and how many were left out (SYN-03, JN-14).

    pk: (table, column), of several for a table the last counts. fk: (child, column, parent, key). A relationship is left out
    if an end is missing or it would close a cycle.
    """
    kinds = {"string": "categorical", "boolean": "boolean", "date": "datetime", "timestamp": "datetime", "timestamp_ntz": "datetime"}
    out = {"tables": {t: {"columns": {f.name: kinds.get(f.dataType.simpleString(), "numerical") for f in df.schema.fields}} for t, df in tables.items()}}
    for t, c in pk:
        if t in tables and c in tables[t].columns:
            out["tables"][t]["primary_key"] = c
            out["tables"][t]["columns"][c] = "id"
    usable = [e for e in fk if e[0] in tables and e[2] in tables and e[1] in tables[e[0]].columns and e[3] in tables[e[2]].columns]
    dropped = set(topological(list(tables), [(c, p) for c, _, p, _ in usable])[1])
    kept = [e for e in usable if (e[0], e[2]) not in dropped]
    for child, column, _, _ in kept:
        out["tables"][child]["columns"][column] = "id"
    out["relationships"] = [dict(zip(("child", "column", "parent", "key"), e)) for e in kept]
    return out | {"applied": len(kept), "invalid": len(fk) - len(kept)}


def save_metadata(made: dict, path: str) -> None:
    """The metadata as one JSON file, replacing an older one (SNK-12)."""
    import json

    with open(path, "w", encoding="utf-8") as f:
        json.dump(made, f, ensure_ascii=False, indent=1)
