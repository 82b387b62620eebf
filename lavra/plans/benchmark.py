"""Whole benchmark runs: retrieval models over folds, selectors' answers, and the comparisons between them (RET-04, RET-11..14, STA-03..12, SNK-08..10)."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.ml.feature import IDF, HashingTF, Normalizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lavra.functions.text import bm25_tokens, parse_source_list
from lavra.operators import evaluation, retrieval, statistics
from lavra.session import materialize

DIMENSIONS = 1024
COMPARISON = ["comparison", "family", "n", "estimate", "p_raw", "p_holm", "ci_low", "ci_high", "significant"]


class HashedEncoder:
    """Encoder without a model: hashed term counts, inverse document frequency fitted on the documents, unit length (RET-04)."""

    def __init__(self, docs: DataFrame, text: str = "doc", dimensions: int = DIMENSIONS):
        self.tf = HashingTF(inputCol="t", outputCol="tf", numFeatures=dimensions)
        self.idf = IDF(inputCol="tf", outputCol="idf").fit(self.tf.transform(docs.select(bm25_tokens(F.coalesce(F.col(text), F.lit(""))).alias("t"))))
        self.unit = Normalizer(inputCol="idf", outputCol="unit", p=2.0)

    def encode(self, df: DataFrame, text: str, prefix: str = "") -> DataFrame:
        """df with a column `vector` of doubles."""
        tokens = df.withColumn("t", bm25_tokens(F.concat(F.lit(prefix), F.coalesce(F.col(text), F.lit("")))))
        return self.unit.transform(self.idf.transform(self.tf.transform(tokens))).withColumn("vector", vector_to_array("unit")).drop("t", "tf", "idf", "unit")


def dense_scores(queries: DataFrame, docs: DataFrame, encoder: HashedEncoder, k: int, prefixes: tuple[str, str] = ("", "")) -> DataFrame:
    """(query_id, source_id, score, rank) of the k best documents for each query; ids are bigint row keys. prefixes: of queries and documents."""
    q = encoder.encode(queries, "query", prefixes[0]).select(F.col("query_id").alias("vec_id"), F.col("vector").alias("embedding"))
    d = encoder.encode(docs, "doc", prefixes[1]).select(F.col("source_id").alias("vec_id"), F.col("vector").alias("embedding"))
    return retrieval.cosine_top_k(q, d, k)


@dataclass(frozen=True)
class Selector:
    """One way to select sources, checked when made (RET-03, RET-05..08, RET-15): bm25, hashed, or a named encoder's settings.

    floor None takes the model's own. window None takes top_k + 1, as BM25 and the first dense version look for the gap;
    the later dense version looks one rank further. reranker: a function (query, doc) -> score, or None.
    """

    model: str = "bm25"
    strategy: str = "score_gap"
    top_k: int = 3
    floor: float | None = None
    window: int | None = None
    reranker: Callable | None = None
    reranker_top_k: int = 5
    task: str = "Given a question, retrieve the data sources that answer it"

    def __post_init__(self):
        if self.model not in ("bm25", "hashed", *retrieval.ENCODERS):
            raise ValueError(f"unknown model {self.model}")
        self.cut()

    def prefixes(self) -> tuple[str, str]:
        """What the encoder puts before queries and documents; an instruction holds the task."""
        query, doc, _ = retrieval.ENCODERS.get(self.model, ("", "", 0.0))
        return query.replace("{task}", self.task), doc

    def cut(self) -> retrieval.Cut:
        floor = self.floor if self.floor is not None else retrieval.ENCODERS[self.model][2] if self.model in retrieval.ENCODERS else 0.30
        k = self.reranker_top_k if self.reranker else self.top_k
        return retrieval.Cut(self.strategy, k, floor, self.window or k + 1)

    def candidates(self, queries: DataFrame, docs: DataFrame, encoder: HashedEncoder | None = None) -> DataFrame:
        """(query_id, source_id, rank, score) as the cut leaves them. queries: query_id, query. docs: source_id, doc; ids are bigint."""
        how = self.cut()
        if self.model == "bm25":
            postings, terms = retrieval.bm25_index(docs)
            scored = retrieval.bm25_scores(queries, postings, terms).select("query_id", "source_id", F.col("normalized").alias("score"))
            ranking = retrieval.ranked(scored, "score", how.window + 1)
        else:
            ranking = dense_scores(queries, docs, encoder or HashedEncoder(docs), how.window + 1, self.prefixes())
        return retrieval.cut(ranking, how)

    def select(self, queries: DataFrame, docs: DataFrame, encoder: HashedEncoder | None = None) -> DataFrame:
        """(query_id, source_id) of the selection, all sources where it is empty (SET-02)."""
        chosen = self.candidates(queries, docs, encoder)
        if self.reranker:
            chosen = retrieval.rerank(chosen, queries, docs, self.reranker, self.top_k)
        return retrieval.fallback(materialize(chosen.select("query_id", "source_id"), "chosen"), queries, docs)


def cross_validate(model: str, candidates: DataFrame, gold: DataFrame, n_folds: int = 5, seed: int = 42, calibrate: bool = True, floor: float = 0.30) -> dict[str, DataFrame]:
    """results, fold_metrics, cv_metrics, by_field and thresholds of one model.

    candidates: query_id, source_id, rank, score, as the model's cut leaves them. gold: query_id, difficulty, cluster and the
    expected lists. Without calibration every fold uses the floor.
    """
    folded = materialize(evaluation.folds(gold, n_folds, seed), "folded")
    grid = evaluation.GRID if calibrate else (floor,)
    tried = materialize(evaluation.at_thresholds(candidates, gold, grid), "tried")
    if calibrate:
        thresholds = materialize(evaluation.calibrate(tried, folded, n_folds), "thresholds")
    else:
        thresholds = folded.select("fold").distinct().select("fold", F.lit(floor).alias("threshold"), F.lit(None).cast("double").alias("train_f1"))
    results = materialize(evaluation.cross_validated(tried, folded, thresholds).withColumn("model", F.lit(model)), "results")
    per_fold = evaluation.means(results, ["model", "fold"])
    return {"results": results, "fold_metrics": per_fold, "cv_metrics": evaluation.across_folds(per_fold, ["model"]), "by_field": evaluation.means_by_field(results, [c for c in ("difficulty", "cluster") if c in results.columns]), "thresholds": thresholds}


def selector_results(answers: DataFrame, gold: DataFrame, sources: DataFrame) -> DataFrame:
    """Metrics of a selector that answers in text: query_id, answer, optional total_tokens; unreadable answers select nothing (RET-14)."""
    ids = F.coalesce(parse_source_list(F.col("answer")), F.array().cast("array<string>"))
    named = answers.select("query_id", F.posexplode(ids).alias("at", "source_id")).join(sources.select("source_id").distinct(), "source_id")
    chosen = named.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "source_id"))), lambda x: x["source_id"]).alias("selected"))
    none = F.array().cast("array<string>")
    lists = answers.drop("answer").join(chosen, "query_id", "left").withColumn("selected", F.coalesce("selected", none))
    return evaluation.metrics(gold.join(lists, "query_id", "left"))


def ranking_table(cv: list[DataFrame]) -> DataFrame:
    """Models by falling F1 (SRT-07)."""
    return reduce(DataFrame.unionByName, cv).orderBy(F.desc("f1"), "model")


def _tested(pairs: DataFrame, family: Callable | str, stat: str, n_boot: int) -> DataFrame:
    tests = statistics.bootstrap(pairs, stat, n_boot).withColumn("family", F.lit(family) if isinstance(family, str) else family(F.col("comparison")))
    return statistics.holm(tests, ["family"]).select(*COMPARISON)


def compare_models(results: DataFrame, metric: str = "f1", vs_best: bool = False, n_boot: int = statistics.RESAMPLES) -> DataFrame:
    """All pairs of models, or the best against the others, corrected as one family (STA-03)."""
    return _tested(statistics.model_pairs(results, value=metric, vs_best=vs_best), "ranking", "mean", n_boot)


def compare_versions(results: DataFrame, versions: list[str], metric: str = "f1", n_boot: int = statistics.RESAMPLES) -> DataFrame:
    """Each model in successive versions, corrected as one family (STA-04)."""
    return _tested(statistics.ablation_pairs(results, versions, value=metric), "ablation", "mean", n_boot)


def compare_listed(results: DataFrame, families: dict[str, list[tuple[str, str]]], metric: str = "f1", n_boot: int = statistics.RESAMPLES) -> DataFrame:
    """Named pairs of models in named families, corrected within each (STA-05)."""
    rows = [(f, a, b) for f, pairs in families.items() for a, b in pairs]
    wanted = results.sparkSession.createDataFrame(rows, "family string, ma string, mb string")
    side = lambda m, v: results.select(F.col("query_id").alias("key"), F.col("model").alias(m), F.col(metric).alias(v))
    pairs = side("ma", "a").join(F.broadcast(wanted), "ma").join(side("mb", "b"), ["mb", "key"])
    named = pairs.select(F.concat_ws("\u0001", "family", F.concat_ws(" vs ", "ma", "mb")).alias("comparison"), "key", "a", "b")
    out = _tested(named, lambda c: F.substring_index(c, "\u0001", 1), "mean", n_boot)
    return out.withColumn("comparison", F.substring_index("comparison", "\u0001", -1))


def compare_by_band(results: DataFrame, banded: DataFrame, baseline: str, metric: str = "f1", n_boot: int = statistics.RESAMPLES) -> DataFrame:
    """Every model against a baseline inside each overlap band, corrected within the band (STA-09). banded: query_id, band."""
    base = results.where(F.col("model") == baseline).select("query_id", F.col(metric).alias("b"))
    pairs = results.where(F.col("model") != baseline).join(base, "query_id").join(banded.select("query_id", "band"), "query_id").where("band is not null")
    named = pairs.select(F.format_string(f"[%s] %s vs {baseline}", "band", "model").alias("comparison"), F.col("query_id").alias("key"), F.col(metric).alias("a"), "b")
    return _tested(named, lambda c: F.regexp_extract(c, r"^\[([^\]]*)\]", 1), "mean", n_boot)


def interactions(results: DataFrame, banded: DataFrame, baseline: str, low: str = "baixa", high: str = "alta", metric: str = "f1", n_boot: int = statistics.RESAMPLES) -> DataFrame:
    """Slope of the advantage over the overlap and low band against high band, for every model against a baseline (STA-12)."""
    base = results.where(F.col("model") == baseline).select("query_id", F.col(metric).alias("b"))
    pairs = results.where(F.col("model") != baseline).join(base, "query_id").join(banded.select("query_id", "band", "overlap"), "query_id")
    named = pairs.select(F.format_string(f"%s vs {baseline}", "model").alias("comparison"), F.col("query_id").alias("key"), F.col(metric).alias("a"), "b", F.col("overlap").alias("x"), "band")
    ends = named.where(F.col("band").isin(low, high)).withColumn("low", F.col("band") == low)
    both = ends.groupBy("comparison").agg(F.countDistinct("low").alias("k")).where("k = 2").select("comparison")
    return _tested(named.where("x is not null"), "slope", "slope", n_boot).unionByName(_tested(ends.join(both, "comparison"), "difference of differences", "did", n_boot))
