"""Retrieval metrics, folds, calibration and their aggregates (MTH-07..13, WIN-03, AGG-15..25, RET-10..14)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lavra.operators.numbering import number_rows

METRICS = ("precision", "recall", "f1", "top1_acc", "error_rate", "ndcg")
#: Thresholds tried, gains of primary and complementary sources, depth of the gain.
GRID = tuple(round(0.20 + 0.05 * i, 2) for i in range(16))
PRIMARY_GAIN, COMPLEMENT_GAIN, DEPTH = 2.0, 1.0, 5


def _none(c: Column) -> Column:
    return F.coalesce(c, F.array().cast("array<string>"))


def precision(selected: Column, primary: Column, complement: Column) -> Column:
    """Selected sources that are primary or complementary; 0 for an empty selection (MTH-07)."""
    good = F.array_union(primary, complement)
    return F.when(F.size(selected) > 0, F.size(F.filter(selected, lambda s: F.array_contains(good, s))) / F.size(selected)).otherwise(0.0)


def recall(selected: Column, primary: Column) -> Column:
    """Primary sources that were selected; 1 where none is wanted (MTH-08)."""
    want = F.array_distinct(primary)
    return F.when(F.size(want) > 0, F.size(F.array_intersect(want, selected)) / F.size(want)).otherwise(1.0)


def f1(p: Column, r: Column) -> Column:
    return F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0)


def ndcg(selected: Column, primary: Column, complement: Column, k: int = DEPTH) -> Column:
    """Discounted gain of the first k against the best possible order; 0 where nothing is wanted (MTH-12)."""
    gain = lambda s: F.when(F.array_contains(primary, s), PRIMARY_GAIN).when(F.array_contains(complement, s), COMPLEMENT_GAIN).otherwise(0.0)
    add = lambda a, x: a + x
    dcg = F.aggregate(F.transform(F.slice(selected, 1, k), lambda s, i: gain(s) / F.log2(i + F.lit(2))), F.lit(0.0), add)
    ideal = F.concat(F.transform(primary, lambda s: F.lit(PRIMARY_GAIN)), F.transform(F.filter(complement, lambda s: ~F.array_contains(primary, s)), lambda s: F.lit(COMPLEMENT_GAIN)))
    best = F.aggregate(F.transform(F.slice(ideal, 1, k), lambda g, i: g / F.log2(i + F.lit(2))), F.lit(0.0), add)
    return F.when(best > 0, dcg / best).otherwise(0.0)


def metrics(df: DataFrame, selected: str = "selected", primary: str = "expected_primary", complement: str = "expected_complement", forbidden: str = "must_not_include") -> DataFrame:
    """df with the six metrics, rounded to four digits; null lists count as empty (MTH-13)."""
    s, p, c, n = (_none(F.col(x)) for x in (selected, primary, complement, forbidden))
    pr, rc = precision(s, p, c), recall(s, p)
    return df.withColumns({
        "precision": F.round(pr, 4), "recall": F.round(rc, 4), "f1": F.round(f1(pr, rc), 4), "top1_acc": F.coalesce(F.array_contains(p, F.try_element_at(s, F.lit(1))), F.lit(False)).cast("double"),
        "error_rate": F.coalesce(F.arrays_overlap(s, n), F.lit(False)).cast("double"), "ndcg": F.round(ndcg(s, p, c), 4),
    })


def folds(queries: DataFrame, n_folds: int = 5, seed: int = 42, stratum: str = "difficulty", key: str = "query_id") -> DataFrame:
    """queries with a fold number: dealt round within each stratum in the order of a seeded hash (WIN-03). No stratum is one task."""
    order = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(key).cast("string")))
    numbered = number_rows(queries.withColumn("__order", order), [stratum], ["__order", key], "__n")
    return numbered.select(*queries.columns, ((F.col("__n") - 1) % n_folds).cast("int").alias("fold"))


def fold_distribution(folded: DataFrame, stratum: str = "difficulty") -> DataFrame:
    return folded.groupBy("fold", stratum).agg(F.count("*").alias("queries"))


def means(results: DataFrame, by: list[str], names: tuple[str, ...] = METRICS) -> DataFrame:
    """Means rounded to four digits by the given columns; those of total_tokens too, where it is there (AGG-15, AGG-18)."""
    names = tuple(names) + tuple(c for c in ("total_tokens",) if c in results.columns and c not in names)
    return results.groupBy(*by).agg(F.count("*").alias("n"), *[F.round(F.avg(m), 4).alias(m) for m in names])


def means_by_field(results: DataFrame, fields: list[str], names: tuple[str, ...] = METRICS) -> DataFrame:
    """(field, value, n, metrics) for each field in one pass over the results; missing values count as unknown (AGG-16)."""
    names = tuple(names) + tuple(c for c in ("total_tokens",) if c in results.columns and c not in names)
    long = results.select(*names, F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.coalesce(F.col(f), F.lit("unknown")).alias("value")) for f in fields])).alias("g"))
    return means(long.select(*names, "g.field", "g.value"), ["field", "value"], names)


def across_folds(fold_means: DataFrame, by: list[str], names: tuple[str, ...] = METRICS) -> DataFrame:
    """Mean and sample deviation of rounded fold means, 0 for a single fold (AGG-17)."""
    return fold_means.groupBy(*by).agg(*[x for m in names for x in (F.round(F.avg(m), 4).alias(m), F.round(F.coalesce(F.stddev_samp(m), F.lit(0.0)), 4).alias(f"{m}_std"))])


def macro(results: DataFrame) -> DataFrame:
    """Macro precision and recall and the F1 of the two (AGG-23)."""
    m = results.agg(F.avg("precision").alias("p"), F.avg("recall").alias("r"))
    return m.select(F.round("p", 4).alias("macro_precision"), F.round("r", 4).alias("macro_recall"), F.round(f1(F.col("p"), F.col("r")), 4).alias("macro_f1"))


def at_thresholds(candidates: DataFrame, gold: DataFrame, grid: tuple[float, ...] = GRID) -> DataFrame:
    """(threshold, query_id, metrics): selections and metrics of every threshold, from scores computed once.

    candidates: query_id, source_id, rank, score, already cut to what could be selected.
    """
    tried = candidates.select("query_id", "source_id", "rank", F.explode(F.filter(F.array(*[F.lit(t) for t in grid]), lambda t: F.col("score") >= t)).alias("threshold"))
    lists = tried.groupBy("threshold", "query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "source_id"))), lambda x: x["source_id"]).alias("selected"))
    every = gold.withColumn("threshold", F.explode(F.array(*[F.lit(t) for t in grid])))
    return metrics(every.join(lists, ["threshold", "query_id"], "left"))


def calibrate(tried: DataFrame, folded: DataFrame, n_folds: int = 5) -> DataFrame:
    """(fold, threshold, train_f1): the threshold with the best mean F1 on the other folds, the lowest of equals (RET-10, SET-09)."""
    of = tried.join(folded.select("query_id", "fold"), "query_id")
    train = of.select("threshold", "f1", F.explode(F.filter(F.array(*[F.lit(i) for i in range(n_folds)]), lambda i: i != F.col("fold"))).alias("test_fold"))
    mean = train.groupBy("test_fold", "threshold").agg(F.avg("f1").alias("m"))
    best = mean.groupBy(F.col("test_fold").alias("fold")).agg(F.max(F.struct(F.round("m", 10).alias("m"), (-F.col("threshold")).alias("neg"))).alias("b"))
    return best.select("fold", (-F.col("b.neg")).alias("threshold"), F.round("b.m", 4).alias("train_f1"))


def cross_validated(tried: DataFrame, folded: DataFrame, calibrated: DataFrame) -> DataFrame:
    """Metrics of each test query at its fold's threshold (RET-11, RET-13)."""
    return tried.join(folded.select("query_id", "fold"), "query_id").join(F.broadcast(calibrated.select("fold", "threshold")), ["fold", "threshold"])
