"""Problem 2: column-level quality profile of loads, with a classifier two-sample test between successive loads.

Exact base aggregates: (load, column, value) groups are counted once, combined before the shuffle, and written; rows, nulls,
distinct values, pattern and range violations of every (load, column) come from them, so neither a large load nor a
frequent value ends in one task.

Two-sample test: logistic regressions tell the rows of a load from those of the load before it.

* The joint model sees all columns. Equal rows are one weighted row, dealt to the two folds by a draw from its hash; rows of
  a pair go by their hash to chunks of at most about 2 * CHUNK rows. Each chunk fits its rows, the weights of a feature are averaged over all chunks of the pair by
  how many rows have it, and every chunk scores its rows with the averaged model of the other fold. Reported are the
  cross-fitted AUC of the pair and, for each column, what the AUC loses without it (ablation). A pair of any size is spread
  over the cluster, all its rows count, and folds and chunks depend on the rows alone.
* One-column models are fitted on (load, column, feature) counts of the whole pair. Their features exclude each other, so
  the optimum is closed: the balanced accuracy less one half on training rows (fit) is half the distance between the
  shares at any size; the same model judged on the other fold is `cross`.

A column is suspected where its own model's fit reaches SCREEN of what the wanted distance would give, which cannot lose a
case, or where the joint model tells the loads apart and misses the column; the exact difference of suspects decides.

Defined results: only SQL nulls are null, blanks are values; repeated rows count; a load without rows has no rates;
rows of a null load_id belong to no load; columns that are absent from the data count as wholly null; further columns are ignored.

Every table here grows with the number of loads, so none is broadcast: the driver would have to build it.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lavra.session import materialize

CHUNK = 2048
#: Share of the half distance that a column's own model must reach to be checked exactly.
SCREEN = 0.8
#: Discrimination of the pair and loss without the column from which the joint model names a suspect.
TELLS_APART, MISSED = 0.6, 0.01
RATE_BITS = 26


def _text(data: DataFrame, c: str) -> Column:
    return F.col(c).cast("string") if c in data.columns else F.lit(None).cast("string")


def _meet(a: DataFrame, b: DataFrame, on: str | list[str], how: str = "inner") -> DataFrame:
    """Join by merging. Files of a few MB may hold a million loads, so their size must not make it a broadcast."""
    return a.join(b.hint("merge"), on, how)


def _half(n: Column, at: Column) -> Column:
    """How many of n equal rows go to fold 0: a binomial draw from the hash `at`, the same wherever the rows lie."""
    few = F.bit_count(at.bitwiseAND(F.expr("shiftrightunsigned(-1L, 64 - cast(least(n, 64) as int))")))
    many = F.round(n / 2 + (F.bit_count(at) - 32) / 8 * F.sqrt(n)).cast("bigint")
    return F.when(n <= 64, few.cast("bigint")).otherwise(F.least(n, F.greatest(F.lit(0).cast("bigint"), many)))


def value_counts(data: DataFrame, columns: list[str]) -> DataFrame:
    """(load_id, column_name, value as text, n) as a written table. Nulls are values here."""
    texts = data.where(F.col("load_id").isNotNull()).select("load_id", *[_text(data, c).alias(c) for c in columns])
    cells = texts.unpivot("load_id", columns, "column_name", "value")
    return materialize(cells.groupBy("load_id", "column_name", "value").agg(F.count("*").alias("n")), "value-counts")


def profile(counts: DataFrame, formats: DataFrame) -> DataFrame:
    """Exact aggregates of every (load, column).

    formats: column_name, kind, pattern, min_value, max_value; one row for each column, so its size is that of a schema.
    """
    rules = formats.select("column_name", "kind", "pattern", "min_value", "max_value").collect()
    named, value = F.col("column_name"), F.col("value")

    def by_column(put: dict[str, Column], otherwise: Column) -> Column:
        # literals, so that every pattern is compiled once
        out = F.when(F.lit(False), otherwise)
        for c, v in put.items():
            out = out.when(named == c, v)
        return out.otherwise(otherwise) if put else otherwise

    number = F.expr("try_cast(value as double)")
    numeric = [r["column_name"] for r in rules if r["kind"] == "number" or r["min_value"] is not None or r["max_value"] is not None]
    fits = by_column({r["column_name"]: value.rlike(f"(?s)\\A(?:{r['pattern']})\\z") for r in rules if r["pattern"] is not None}, F.lit(True))
    low = by_column({r["column_name"]: F.lit(float(r["min_value"])) for r in rules if r["min_value"] is not None}, F.lit(None).cast("double"))
    high = by_column({r["column_name"]: F.lit(float(r["max_value"])) for r in rules if r["max_value"] is not None}, F.lit(None).cast("double"))
    has, n = value.isNotNull(), F.col("n")
    read = counts.select("load_id", "column_name", "value", "n", F.when(named.isin(numeric), number).alias("v"))
    beyond = has & F.coalesce((F.col("v") < low) | (F.col("v") > high), F.lit(False))
    lengths = F.when(has, F.length("value"))
    return read.groupBy("load_id", "column_name").agg(
        F.sum("n").alias("row_count"),
        F.sum(F.when(has, n).otherwise(0)).alias("non_null"),
        F.sum(F.when(has, 1).otherwise(0)).alias("cardinality"),
        F.sum(F.when(has & ~fits, n).otherwise(0)).alias("misfits"),
        F.sum(F.when(beyond, n).otherwise(0)).alias("out_of_range"),
        F.min("v").alias("min_v"),
        F.max("v").alias("max_v"),
        F.min(lengths).alias("min_length"),
        F.max(lengths).alias("max_length"),
    ).withColumn("null_rate", 1 - F.col("non_null") / F.col("row_count"))


# ---------------------------------------------------------------- the joint model
def _descend(codes: np.ndarray, y: np.ndarray, weight: np.ndarray, n: int, steps: int = 40) -> np.ndarray:
    w, flat, k = np.zeros(n), codes.ravel(), codes.shape[1]
    h = (0.25 * np.bincount(flat, np.repeat(weight, k), n) + 1.0) * (k / 2.0)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(w[codes].sum(1), -30, 30)))
        w += (np.bincount(flat, np.repeat((y - p) * weight, k), n) - 0.05 * w) / h
    return w


def _auc(score: np.ndarray, y: np.ndarray, n: np.ndarray) -> float:
    """Chance that a row of the later load scores higher, ties half; n: how often each row occurs."""
    score = np.round(score, 9)
    order = np.argsort(score)
    s, one = score[order], np.where(y[order] == 1, n[order], 0).astype(float)
    zero = n[order] - one
    starts = np.flatnonzero(np.r_[True, s[1:] != s[:-1]])
    ones, zeros = np.add.reduceat(one, starts), np.add.reduceat(zero, starts)
    below = np.cumsum(zeros) - zeros
    both = ones.sum() * zeros.sum()
    return float((ones * (below + zeros / 2)).sum() / both) if both else 0.5


class _Rows:
    """The rows of one chunk as arrays."""

    def __init__(self, t: pa.Table):
        t = t.combine_chunks()
        tokens = t.column("tokens").combine_chunks() if t.num_rows else None
        self.k = len(tokens) and len(tokens.values if isinstance(tokens, pa.FixedSizeListArray) else tokens.flatten()) // len(tokens)
        self.tokens = tokens.flatten().to_numpy(zero_copy_only=False).reshape(len(tokens), self.k)
        self.y, self.fold, self.n = (t.column(c).to_numpy() for c in ("side", "fold", "n"))
        self.uniq, codes = np.unique(self.tokens, return_inverse=True)
        self.codes = codes.reshape(self.tokens.shape)

    def fit(self) -> np.ndarray:
        """Weights of every token, a row for each fold: row f is trained without fold f."""
        ones, zeros = (self.n[self.y == side].sum() or 1.0 for side in (1, 0))
        each = np.where(self.y == 1, 0.5 / ones, 0.5 / zeros) * self.n.sum() * self.n
        out = np.zeros((2, len(self.uniq)))
        for f in (0, 1):
            kept = self.fold != f
            if kept.any():
                out[f] = _descend(self.codes[kept], self.y[kept], each[kept], len(self.uniq))
        return out

    def judge(self, weights: np.ndarray) -> tuple[float, list[float]]:
        """Cross-fitted AUC, and its loss without each column."""
        parts = weights[self.fold[:, None], self.codes]
        whole = parts.sum(1)
        full = _auc(whole, self.y, self.n)
        return full, [full - _auc(whole - parts[:, j], self.y, self.n) if parts[:, j].any() else 0.0 for j in range(self.k)]


_JUDGED = "load_id bigint, n double, column_name string, auc double, ablation double"


def _judged(load_id: int, rows: _Rows, weights: np.ndarray, columns: list[str]) -> pa.Table:
    auc, ablation = rows.judge(weights)
    return pa.table({"load_id": pa.array([load_id] * len(columns), pa.int64()), "n": [float(rows.n.sum())] * len(columns), "column_name": columns, "auc": [auc] * len(columns), "ablation": ablation})


def _alone(columns: list[str]):
    def run(key: tuple, t: pa.Table) -> pa.Table:
        rows = _Rows(t)
        return _judged(key[0].as_py(), rows, rows.fit(), columns)

    return run


def _fit_chunk(key: tuple, t: pa.Table) -> pa.Table:
    rows = _Rows(t)
    w, m = rows.fit(), np.bincount(rows.codes.ravel(), np.repeat(rows.n, rows.k), len(rows.uniq))
    return pa.table({"load_id": pa.array([key[0].as_py()] * len(m), pa.int64()), "chunk": pa.array([key[1].as_py()] * len(m), pa.int64()), "token": rows.uniq, "w0": w[0], "w1": w[1], "m": m})


def _score_chunk(columns: list[str]):
    def run(key: tuple, t: pa.Table, fitted: pa.Table) -> pa.Table:
        rows = _Rows(t)
        fitted = fitted.sort_by("token")
        return _judged(key[0].as_py(), rows, np.array([fitted.column(c).to_numpy() for c in ("w0", "w1")]), columns)

    return run


def _dealing(rows: DataFrame, pairs: DataFrame) -> DataFrame:
    """(load_id, own, side, chunks, copies, total): how the different rows of both loads of a pair go to chunks."""
    sizes = rows.groupBy("own").agg(F.count("*").alias("k"), F.sum("n").alias("total"))
    of = lambda own, name: sizes.select(F.col("own").alias(own), F.col("k").alias(f"k{name}"), F.col("total").alias(f"total{name}"))
    both = _meet(_meet(pairs, of("load_id", 1), "load_id"), of("previous_load_id", 0), "previous_load_id")
    both = both.withColumn("chunks", F.ceil(F.greatest("k1", "k0") / F.lit(CHUNK)))

    def copies(k: str) -> Column:  # the smaller load's rows go to as many chunks as fill them
        return F.greatest(F.lit(1), F.least("chunks", F.floor(F.col("chunks") * CHUNK / F.col(k)))).cast("int").alias("copies")

    sides = [both.select("load_id", F.col(own).alias("own"), F.lit(side).alias("side"), "chunks", copies(f"k{side}"), F.col(f"total{side}").alias("total")) for own, side in (("load_id", 1), ("previous_load_id", 0))]
    return materialize(sides[0].unionByName(sides[1]), "sides")


def _joint(data: DataFrame, pairs: DataFrame, columns: list[str], kinds: dict[str, str]) -> DataFrame:
    """(load_id, column_name, n, auc, ablation) of every pair."""

    def token(j: int, c: str) -> Column:
        low = F.when(F.col(c).isNull(), 0).otherwise(1 + F.pmod(F.xxhash64(_feature(F.col(c), kinds[c])), F.lit((1 << RATE_BITS) - 1)))
        return F.lit(j << RATE_BITS).cast("bigint") + low

    texts = data.where(F.col("load_id").isNotNull()).select(F.col("load_id").alias("own"), *[_text(data, c).alias(c) for c in columns])
    rows = texts.select("own", F.array(*[token(j, c) for j, c in enumerate(columns)]).alias("tokens"))
    rows = materialize(rows.groupBy("own", "tokens").agg(F.count("*").alias("n")), "rows")
    sides = _dealing(rows, pairs)
    # a row that is a large part of its load goes to every chunk with its share of the weight, others to `copies` chunks
    start, every = F.pmod(F.xxhash64("tokens"), F.col("chunks")), F.col("n") * CHUNK >= F.col("total")
    halved = _meet(rows, sides, "own").withColumn("f0", _half(F.col("n"), F.xxhash64("own", "tokens"))).withColumn("to", F.when(every, F.col("chunks")).otherwise(F.col("copies")).cast("int"))
    weight = lambda n: F.when(every, n / F.col("chunks")).otherwise(n.cast("double"))
    folds = F.array(*[F.struct(F.lit(f).alias("fold"), weight(n).alias("n")) for f, n in ((0, F.col("f0")), (1, F.col("n") - F.col("f0")))])
    chunks = F.explode(F.transform(F.sequence(F.lit(0), F.col("to") - 1), lambda i: F.pmod(start + i, F.col("chunks")))).alias("chunk")
    dealt = halved.select("load_id", "side", "tokens", "chunks", chunks, folds.alias("folds")).select("load_id", "side", "tokens", "chunks", "chunk", F.inline("folds")).where("n > 0")
    each = dealt.where("chunks = 1").drop("chunks").groupBy("load_id").applyInArrow(_alone(columns), _JUDGED)
    if sides.where("chunks > 1").head(1):  # none of these is a job less, not another result
        many = materialize(dealt.where("chunks > 1").drop("chunks"), "dealt")
        fitted = materialize(many.groupBy("load_id", "chunk").applyInArrow(_fit_chunk, "load_id bigint, chunk bigint, token bigint, w0 double, w1 double, m double"), "fitted")
        mean = lambda c: (F.sum(F.col(c) * F.col("m")) / F.sum("m")).alias(c)
        averaged = _meet(fitted.select("load_id", "chunk", "token"), fitted.groupBy("load_id", "token").agg(mean("w0"), mean("w1")), ["load_id", "token"])
        scored = many.groupBy("load_id", "chunk").cogroup(averaged.groupBy("load_id", "chunk")).applyInArrow(_score_chunk(columns), _JUDGED)
        each = each.unionByName(scored)
    mean = lambda c: (F.sum(F.col(c) * F.col("n")) / F.sum("n")).alias(c)
    return each.groupBy("load_id", "column_name").agg(F.round(F.sum("n")).cast("bigint").alias("n"), mean("auc"), mean("ablation"))


# ---------------------------------------------------------------- one-column models
def _feature(v: Column, kind: str) -> Column:
    """What a model sees of a value given as text: categories themselves, the magnitude of numbers, else the length."""
    if kind in ("category", "flag"):
        return v
    if kind == "number":
        d = v.try_cast("double")
        return F.coalesce(F.concat(F.signum(d), F.floor(F.log2(1 + F.abs(d)))), F.lit("?"))
    return F.least(F.length(v), F.lit(64)).cast("string")


def _own_models(counts: DataFrame, sides: DataFrame, name: str) -> DataFrame:
    """(load_id, column_name, <name>_fit, <name>_cross): advantage of the one-column models, on training rows and cross-fitted.

    counts: own, column_name, seen, n. Features of a column exclude each other, so the balanced model's optimum is the
    difference of their shares. 0 where a side has no rows with a feature.
    """
    f0 = _half(F.col("n"), F.xxhash64("own", "column_name", "seen"))
    counts = counts.select("own", "column_name", "seen", "n", f0.alias("f0"), (F.col("n") - f0).alias("f1"))
    totals = counts.groupBy("own", "column_name").agg(F.sum("n").alias("total"))
    share = lambda c: (F.col(c) / F.col("total") * (2 * F.col("side") - 1)).alias(f"s_{c}")
    signed = _meet(_meet(counts, totals, ["own", "column_name"]), sides, "own").select("load_id", "column_name", "seen", "side", share("n"), share("f0"), share("f1"))
    gaps = signed.groupBy("load_id", "column_name", "seen").agg(F.sum("s_n").alias("g"), F.sum("s_f0").alias("g0"), F.sum("s_f1").alias("g1"), F.max("side").alias("one"), F.min("side").alias("zero"))
    fit, cross = F.abs("g"), F.signum("g1") * F.col("g0") + F.signum("g0") * F.col("g1")
    both = (F.max("one") == 1) & (F.min("zero") == 0)
    return gaps.groupBy("load_id", "column_name").agg(*[F.when(both, F.sum(v) / 4).otherwise(0.0).alias(f"{name}_{what}") for what, v in (("fit", fit), ("cross", cross))])


def two_sample(data: DataFrame, counts: DataFrame, loads: DataFrame, formats: DataFrame) -> DataFrame:
    """Discrimination between each load and the one before it, for every column.

    counts: value_counts() of data. loads: load_id, previous_load_id. Loads without a predecessor that has rows are left out.
    """
    kinds = {r["column_name"]: r["kind"] for r in formats.select("column_name", "kind").collect()}
    columns = list(kinds)
    step = loads.select("load_id", "previous_load_id").where("previous_load_id is not null and load_id is not null").distinct()
    have = counts.select("load_id").distinct()
    pairs = materialize(_meet(_meet(step, have, "load_id"), have.withColumnRenamed("load_id", "previous_load_id"), "previous_load_id").select("load_id", "previous_load_id"), "pairs")
    sides = pairs.select("load_id", F.col("load_id").alias("own"), F.lit(1).alias("side")).unionByName(pairs.select("load_id", F.col("previous_load_id").alias("own"), F.lit(0).alias("side")))
    joint = _joint(data, pairs, columns, kinds)
    shape = F.lit(None).cast("string")
    for kind in ("category", "number", "code"):
        own = [c for c in columns if ("category" if kinds[c] == "flag" else kinds[c] if kinds[c] in ("category", "number") else "code") == kind]
        shape = F.when(F.col("column_name").isin(own), _feature(F.col("value"), kind)).otherwise(shape)
    seen = counts.select(F.col("load_id").alias("own"), "column_name", F.when(F.col("value").isNotNull(), shape).alias("seen"), "n")
    seen = materialize(seen.groupBy("own", "column_name", "seen").agg(F.sum("n").alias("n")), "feature-counts")
    nulls = seen.groupBy("own", "column_name", F.col("seen").isNull().alias("seen")).agg(F.sum("n").alias("n"))
    own = _meet(_own_models(nulls, sides, "null"), _own_models(seen.where("seen is not null"), sides, "value"), ["load_id", "column_name"], "left")
    ranks = _meet(joint, own, ["load_id", "column_name"], "left")
    return ranks.select("load_id", "column_name", "n", "auc", "ablation", *[F.coalesce(c, F.lit(0.0)).alias(c) for c in ("value_fit", "null_fit", "value_cross", "null_cross")])


def category_distances(counts: DataFrame, wanted: DataFrame) -> DataFrame:
    """(load_id, column_name, n1, n0, distance): half the summed share differences among non-null values.

    wanted: load_id, previous_load_id, column_name. Only the counts of these are read on.
    """
    sides = wanted.select("load_id", "column_name", F.col("load_id").alias("own"), F.lit(1).alias("side")).unionByName(wanted.select("load_id", "column_name", F.col("previous_load_id").alias("own"), F.lit(0).alias("side")))
    told = counts.where("value is not null").select(F.col("load_id").alias("own"), "column_name", "value", "n")
    sided = _meet(told, sides, ["own", "column_name"])
    by_value = sided.groupBy("load_id", "column_name", "value").agg(F.sum(F.col("n") * F.col("side")).alias("a"), F.sum(F.col("n") * (1 - F.col("side"))).alias("b"))
    totals = by_value.groupBy("load_id", "column_name").agg(F.sum("a").alias("n1"), F.sum("b").alias("n0"))
    shares = _meet(by_value, totals, ["load_id", "column_name"])
    gap = F.abs(F.when(F.col("n1") > 0, F.col("a") / F.col("n1")).otherwise(0.0) - F.when(F.col("n0") > 0, F.col("b") / F.col("n0")).otherwise(0.0))
    return shares.groupBy("load_id", "column_name").agg(F.first("n1").alias("n1"), F.first("n0").alias("n0"), (F.sum(gap) / 2).alias("distance"))


def findings(
    data: DataFrame, loads: DataFrame, declared: DataFrame, formats: DataFrame, null_rate: float = 0.02, misfit: float = 0.05, null_shift: float = 0.15, value_shift: float = 0.25, least: int = 50
) -> DataFrame:
    """(load_id, column_name, finding) where the data contradict what was declared, break their form, or differ from the load before."""
    columns = [r["column_name"] for r in formats.select("column_name").collect()] or ["load_id"]
    counts = value_counts(data, columns)
    prof = materialize(profile(counts, formats), "profile")
    sizes = prof.groupBy("load_id").agg(F.max("row_count").alias("row_count"), F.sum((F.col("non_null") > 0).cast("int")).alias("column_count"))
    say = lambda df, what, column=None: df.select("load_id", (F.lit("*") if column is None else F.col(column)).alias("column_name"), F.lit(what).alias("finding"))
    six = lambda c: F.round(c, 6)

    told = _meet(loads.select("load_id", F.col("row_count").alias("d_rows"), F.col("column_count").alias("d_columns")), sizes, "load_id", "left")
    parts = [
        say(told.where(F.col("d_rows") != F.coalesce("row_count", F.lit(0))), "row_count"),
        say(told.where(F.col("d_columns") != F.coalesce("column_count", F.lit(0))), "column_count"),
    ]
    said = _meet(declared.select("load_id", "column_name", F.col("null_rate").alias("d_null"), F.col("cardinality").alias("d_cardinality")), prof, ["load_id", "column_name"])
    parts += [
        say(said.where(six(F.abs(F.col("d_null") - F.col("null_rate"))) > null_rate), "null_rate", "column_name"),
        say(said.where(F.col("d_cardinality") != F.col("cardinality")), "cardinality", "column_name"),
        say(prof.where((F.col("misfits") > 0) & (six(F.col("misfits") / F.col("non_null")) >= misfit)), "pattern", "column_name"),
        say(prof.where("out_of_range > 0"), "range", "column_name"),
    ]
    pairs = loads.select("load_id", "previous_load_id").where("load_id is not null and previous_load_id is not null").distinct()
    test = materialize(two_sample(data, counts, loads, formats), "two-sample")
    told_apart = (F.col("auc") >= TELLS_APART) & (F.col("ablation") >= MISSED)
    before = prof.select(F.col("load_id").alias("previous_load_id"), "column_name", F.col("null_rate").alias("p_null"))
    now = _meet(_meet(prof.select("load_id", "column_name", "null_rate"), pairs, "load_id"), before, ["previous_load_id", "column_name"])
    shifted = _meet(test.where(told_apart | (F.col("null_fit") >= SCREEN * null_shift / 2)).select("load_id", "column_name"), now, ["load_id", "column_name"])
    parts.append(say(shifted.where(six(F.abs(F.col("null_rate") - F.col("p_null"))) > null_shift), "null_shift", "column_name"))
    categories = [r["column_name"] for r in formats.where("kind = 'category'").select("column_name").collect()]
    suspects = _meet(test.where(F.col("column_name").isin(categories) & (told_apart | (F.col("value_fit") >= SCREEN * value_shift / 2))).select("load_id", "column_name"), pairs, "load_id")
    far = category_distances(counts, suspects)
    parts.append(say(far.where((F.col("n1") >= least) & (F.col("n0") >= least) & (six(F.col("distance")) > value_shift)), "value_shift", "column_name"))
    return reduce(DataFrame.unionByName, parts).distinct()
