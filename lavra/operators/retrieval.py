"""Selecting the sources for a question: keyword rules, BM25, cosine, gap and threshold cuts, reranking, fallback (RET-*, WIN-02, SRT-01..06, MTH-03..05)."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lavra.functions.text import bm25_tokens
from lavra.session import materialize

K1, B, EPSILON = 1.5, 0.75, 0.25
#: Prefix of queries and documents, and similarity floor, of each encoder.
ENCODERS = {"minilm": ("", "", 0.30), "e5-base": ("query: ", "passage: ", 0.79), "e5-large": ("query: ", "passage: ", 0.79), "bge-m3": ("", "", 0.50), "e5-large-instruct": ("Instruct: {task}\nQuery: ", "passage: ", 0.79), "serafim": ("", "", 0.50)}
#: Queries of a block, vectors of a part, and numbers that all broadcast blocks may hold together.
QUERY_BLOCK, VECTOR_PART, BROADCAST_CELLS = 1024, 65_536, 4_000_000
#: Source ids of a block of the fallback.
SOURCE_BLOCK = 1024
#: Documents that a BM25 task holds, most queries that it answers with them, and queries that are worth a task.
DOC_PART, ASKED_BLOCK, ASKED_LEAST = 500_000, 25_000, 250
#: Common words, from one in so many documents on, that are kept as rows of a matrix, queries multiplied by it at once, and documents of a stretch.
DENSE_WORDS, DENSE_SHARE, ASKED_AT_ONCE, STRETCH = 32, 32, 16, 256
TYPE_ORDER = ("sql", "api", "spreadsheets")


@dataclass(frozen=True)
class Cut:
    """How a ranking becomes a selection. window: how many ranks the gap is looked for in (top_k + 1, or top_k + 2)."""

    strategy: str = "score_gap"
    top_k: int = 3
    floor: float = 0.30
    window: int = 4

    def __post_init__(self):
        if self.strategy not in ("score_gap", "threshold"):
            raise ValueError(f"unknown strategy {self.strategy}")
        if self.top_k < 1 or self.window < 1:
            raise ValueError("top_k and window start at 1")


# ---------------------------------------------------------------- keyword rules (RET-01, JN-13)
def keyword_route(queries: DataFrame, rules: DataFrame, sources: DataFrame) -> DataFrame:
    """(query_id, source_id) of every rule with a keyword inside the lower-cased query, all sources where no rule applies (SET-01, SET-02).

    queries: query_id, query. rules: rule_id, trigger_keywords, include_sources, complement_with; a short list written by
    hand, so it is folded into one expression. Keywords marked unfilled never match.
    """
    listed = rules.select("trigger_keywords", "include_sources", "complement_with").collect()
    low = F.lower("query")
    hits = []
    for r in listed:
        keys = [k.lower() for k in r["trigger_keywords"] or [] if "[MANUAL]" not in k]
        named = [*(r["include_sources"] or []), *(r["complement_with"] or [])]
        if keys and named:
            any_key = low.contains(F.lit(keys[0]))
            for k in keys[1:]:
                any_key = any_key | low.contains(F.lit(k))
            hits.append(F.when(any_key, F.array(*[F.lit(s) for s in named])).otherwise(F.array().cast("array<string>")))
    picked = F.array_distinct(F.flatten(F.array(*hits))) if hits else F.array().cast("array<string>")
    routed = queries.select("query_id", picked.alias("s"))
    chosen = routed.select("query_id", F.explode("s").alias("source_id"))
    return chosen.unionByName(with_all(routed.where(F.size("s") == 0).select("query_id"), sources))


def with_all(queries: DataFrame, sources: DataFrame) -> DataFrame:
    """Every given query with all sources, as the fallback wants; queries are a stated set that found nothing.

    Sources meet the queries in blocks of about SOURCE_BLOCK ids by an equal key, so neither side is broadcast whole.
    """
    ids = sources.select("source_id").distinct()
    blocks = max(1, -(-ids.count() // SOURCE_BLOCK))
    dealt = ids.groupBy(F.pmod(F.xxhash64("source_id"), F.lit(blocks)).alias("block")).agg(F.collect_list("source_id").alias("all"))
    asked = queries.select("query_id", F.explode(F.expr(f"sequence(0L, {blocks - 1}L)")).alias("block"))
    return asked.join(dealt, "block").select("query_id", F.explode("all").alias("source_id"))


# ---------------------------------------------------------------- BM25 (MTH-05, RET-08, AGG-26)
def bm25_index(docs: DataFrame, key: str = "source_id", text: str = "doc") -> tuple[DataFrame, DataFrame]:
    """(postings, terms): (key, term, tf, dl) and (term, df, idf). Negative idf becomes EPSILON times the mean idf."""
    tokens = docs.select(F.col(key).alias("doc_key"), bm25_tokens(F.coalesce(F.col(text), F.lit(""))).alias("t"))
    sized = tokens.select("doc_key", F.size("t").alias("dl"), F.explode("t").alias("term"))
    postings = materialize(sized.groupBy("doc_key", "dl", "term").agg(F.count("*").alias("tf")), "bm25-postings")  # the texts are read once
    n_docs = docs.count()
    totals = postings.agg(F.lit(n_docs).alias("n_docs"), (F.coalesce(F.sum("tf"), F.lit(0)) / F.lit(max(n_docs, 1))).alias("avgdl"))
    df = postings.groupBy("term").agg(F.count("*").alias("df"))
    raw = df.join(F.broadcast(totals)).withColumn("raw", F.log(F.col("n_docs") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5))
    mean = raw.agg(F.avg("raw").alias("mean_idf"))
    terms = raw.join(F.broadcast(mean)).select("term", "df", "avgdl", F.when(F.col("raw") < 0, EPSILON * F.col("mean_idf")).otherwise(F.col("raw")).alias("idf"))
    return postings, terms


def bm25_scores(queries: DataFrame, postings: DataFrame, terms: DataFrame) -> DataFrame:
    """(query_id, source_id, score, normalized) of every pair that shares a term; normalized by the query's best (1 if none is positive)."""
    asked = queries.select("query_id", F.explode(bm25_tokens(F.coalesce("query", F.lit("")))).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("qtf"))
    weighted = asked.join(terms, "term")
    part = F.col("qtf") * F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    scored = weighted.join(postings, "term").groupBy("query_id", F.col("doc_key").alias("source_id")).agg(F.sum(part).alias("score"))
    best = scored.groupBy("query_id").agg(F.max("score").alias("best"))
    return scored.join(best, "query_id").select("query_id", "source_id", "score", (F.col("score") / F.when(F.col("best") > 0, F.col("best")).otherwise(1.0)).alias("normalized"))


class _Postings:
    """Documents in the order of their ids, with the saturated counts of their words by document and by word."""

    def __init__(self, words: np.ndarray, lengths: np.ndarray, dl: np.ndarray, avgdl: float):
        doc = np.repeat(np.arange(len(lengths), dtype=np.int32), lengths)
        first = np.ones(len(words), dtype=bool)
        first[1:] = (words[1:] != words[:-1]) | (doc[1:] != doc[:-1])
        at = np.flatnonzero(first)
        tf = np.diff(at, append=len(words))
        self.word, doc = words[at], doc[at]
        self.by_doc = tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl[doc] / avgdl))
        self.doc_at = np.concatenate([[0], np.cumsum(np.bincount(doc, minlength=len(lengths)))])
        n_words = int(words.max(initial=-1)) + 1
        order = np.argsort(self.word, kind="stable")
        self.doc, self.by_word = doc[order], self.by_doc[order]
        self.word_at = np.concatenate([[0], np.cumsum(np.bincount(self.word, minlength=n_words))])
        self.most = np.zeros(n_words)
        np.maximum.at(self.most, self.word, self.by_doc)
        self.partial, self.weight = np.zeros(len(lengths)), np.zeros(n_words)
        common = np.argsort(-np.diff(self.word_at), kind="stable")[:DENSE_WORDS]
        common = common[np.diff(self.word_at)[common] * DENSE_SHARE > len(lengths)]
        self.row, self.dense = np.full(n_words, -1), np.zeros((len(common), -(-len(lengths) // STRETCH) * STRETCH), dtype=np.float32)
        self.row[common] = np.arange(len(common))
        self.product = np.empty((ASKED_AT_ONCE, self.dense.shape[1]), dtype=np.float32)
        for i, w in enumerate(common):
            at = slice(self.word_at[w], self.word_at[w + 1])
            self.dense[i, self.doc[at]] = self.by_word[at]

    def scores(self, docs: np.ndarray) -> np.ndarray:
        """Whole scores under self.weight, for documents that have a posting, each summed in the order of its words."""
        n = self.doc_at[docs + 1] - self.doc_at[docs]
        ends = np.cumsum(n)
        at = np.arange(ends[-1]) + np.repeat(self.doc_at[docs] - ends + n, n)
        return np.add.reduceat(self.weight[self.word[at]] * self.by_doc[at], ends - n)

    def top(self, words: np.ndarray, weights: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Every document that can be among the k best after rounding to nine digits, ties by id, with its score.

        Rare words come first. What is left of a query bounds the documents that no word has met so far; once the k-th
        partial score is beyond that, the common words are looked up for the documents in reach only.
        """
        there = words < len(self.most)
        words, weights = words[there], weights[there]
        starts, ends = self.word_at[words], self.word_at[words + 1]
        order = np.lexsort((ends - starts, weights >= 0))
        order = order[(ends > starts)[order]]
        bounds = np.maximum(weights * self.most[words], 0)[order]
        left = np.concatenate([np.cumsum(bounds[::-1])[::-1], [0.0]])
        slack = 2e-9 * max(left[0], 1.0)
        floor, pool, met, rest = -np.inf, np.zeros(0, dtype=np.int32), [], 0.0
        for i, j in enumerate(order):
            if weights[j] >= 0 and floor - slack > left[i]:
                rest = left[i]
                break
            docs = self.doc[starts[j] : ends[j]]
            now = self.partial[docs] + weights[j] * self.by_word[starts[j] : ends[j]]
            self.partial[docs] = now
            met.append(docs)
            if len(docs) > k:  # the k best of the documents that a word has met are among the k best of some word
                high = np.flatnonzero(now >= floor)
                docs = docs[high if len(high) <= k else high[np.argpartition(now[high], -k)[-k:]]]
            pool = np.union1d(pool, docs)
            if len(pool) >= k:
                floor = np.partition(self.partial[pool], -k)[-k]
                if weights[j] < 0:
                    floor = -np.inf
        reach = [docs[self.partial[docs] >= floor - slack - rest] for docs in met]
        for docs in met:
            self.partial[docs] = 0
        return self.chosen(words, weights, np.unique(np.concatenate(reach)) if reach else pool, k, slack)

    def chosen(self, words: np.ndarray, weights: np.ndarray, docs: np.ndarray, k: int, slack: float) -> tuple[np.ndarray, np.ndarray]:
        """Of candidates in the order of their ids, those that top() returns."""
        if not len(docs):
            return docs, np.zeros(0)
        self.weight[words] = weights
        scores = self.scores(docs)
        self.weight[words] = 0
        if len(docs) > k:
            near = scores >= np.partition(scores, -k)[-k] - slack
            docs, scores = docs[near], scores[near]
            order = np.lexsort((docs, -scores))
            docs, scores = docs[order], scores[order]
            fresh = np.concatenate([[True], scores[1:] != scores[:-1]])
            place = np.arange(len(docs)) - np.maximum.accumulate(np.where(fresh, np.arange(len(docs)), 0))
            docs, scores = docs[place < k], scores[place < k]
        return docs, scores


    def tops(self, asked: list[tuple[np.ndarray, np.ndarray]], k: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """top() of several queries: common words by one product in single precision, the others added to it; what comes near the best is scored again.

        The k-th best of the stretches' best scores bounds the k-th best score. Where that bound does not tell documents
        with a word from those without, or weights are negative, top() goes from word to word.
        """
        asked = [(words[there], weights[there]) for words, weights in asked for there in (words < len(self.most),)]
        factors, product = np.zeros((len(asked), len(self.dense)), dtype=np.float32), self.product[: len(asked)]
        for i, (words, weights) in enumerate(asked):
            row = self.row[words]
            factors[i, row[row >= 0]] = weights[row >= 0]
        np.matmul(factors, self.dense, out=product)
        stretch = STRETCH
        while stretch > 1 and product.shape[1] // stretch < 16 * k:
            stretch //= 2
        for (words, weights), near in zip(asked, product):
            bounds = np.abs(weights * self.most[words]).sum()
            error, slack, floor = (len(words) + 8) * 2.4e-7 * bounds, 2e-9 * max(bounds, 1.0), 0.0
            if (weights >= 0).all() and product.shape[1] // stretch >= k:
                for w, weight in zip(words, weights):
                    if self.row[w] < 0:
                        at = slice(self.word_at[w], self.word_at[w + 1])
                        near[self.doc[at]] += (weight * self.by_word[at]).astype(np.float32)
                high = near.reshape(-1, stretch).max(1)
                floor = float(np.partition(high, -k)[-k]) - 2 * error - slack
            if floor > error:
                at = np.flatnonzero(high >= np.float32(floor))
                of, to = np.nonzero(near.reshape(-1, stretch)[at] >= np.float32(floor))
                yield self.chosen(words, weights, at[of] * stretch + to, k, slack)
            else:
                yield self.top(words, weights, k)


def _bm25_block(k: int, avgdl: float, names: list[str]):
    def flat(parts: list[pa.Array]) -> tuple[np.ndarray, np.ndarray]:
        whole = pa.concat_arrays(parts)
        return whole.flatten().to_numpy(zero_copy_only=False), whole.value_lengths().to_numpy(zero_copy_only=False)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, index, ids = [], None, None
        for batch in batches:
            asked = batch.column("asked")
            n_docs = len(asked) - asked.true_count
            if n_docs:
                held.append(batch.slice(0, n_docs))
            if n_docs == len(asked) or not held:
                continue
            if index is None:
                ids = pa.concat_arrays([b.column("source_id") for b in held])
                words, lengths = flat([b.column("words") for b in held])
                index = _Postings(words, lengths, np.concatenate([b.column("dl").to_numpy(zero_copy_only=False) for b in held]), avgdl)
                held = [held[0].slice(0, 0)]
            rows = batch.slice(n_docs)
            words, lengths = flat([rows.column("words")])
            idf, at = flat([rows.column("idf")])[0], np.concatenate([[0], np.cumsum(lengths)])
            found, of, scores = [], [], []
            for low in range(0, len(rows), ASKED_AT_ONCE):
                asked = []
                for i in range(low, min(low + ASKED_AT_ONCE, len(rows))):
                    own, first, times = np.unique(words[at[i] : at[i + 1]], return_index=True, return_counts=True)
                    asked.append((own, times * idf[at[i] : at[i + 1]][first]))
                for i, (docs, s) in enumerate(index.tops(asked, k), low):
                    found.append(docs)
                    of.append(np.full(len(docs), i))
                    scores.append(s)
            yield pa.RecordBatch.from_arrays([rows.column("query_id").take(pa.array(np.concatenate(of))), ids.take(pa.array(np.concatenate(found))), pa.array(np.concatenate(scores))], names=names)

    return run


def bm25_top_k(queries: DataFrame, docs: DataFrame, k: int, key: str = "source_id", text: str = "doc") -> DataFrame:
    """bm25_scores of the pairs that can be among each query's k best, by score in nine digits and then by source; the rest is never made.

    docs: one row for each key. Blocks of queries meet parts of the documents in a task each, which holds the part's
    postings and answers query by query; only a few rows over k for each query and part leave it. So shuffled are the
    words of the documents once for each block of queries and those of the queries once for each part.
    """
    spark = docs.sparkSession
    tokens = materialize(docs.select(F.col(key).alias("source_id"), bm25_tokens(F.coalesce(F.col(text), F.lit(""))).alias("t")), "bm25-tokens")
    size = tokens.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.size("t")), F.lit(0)).alias("words")).first()
    n_docs, avgdl, n_asked = size["n"], size["words"] / max(size["n"], 1), queries.count()
    df = tokens.select(F.explode(F.array_distinct("t")).alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    raw = materialize(df.select("term", (F.log(F.lit(n_docs) - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)).alias("raw")), "bm25-terms")
    mean = raw.agg(F.avg("raw")).first()[0] or 0.0
    asked = queries.select("query_id", F.explode(bm25_tokens(F.coalesce("query", F.lit("")))).alias("term"))
    dealt = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    number = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)) * dealt + F.spark_partition_id()  # close to consecutive
    common = raw.join(asked.select("term").distinct(), "term").repartition(dealt, "term")
    known = materialize(common.select("term", F.when(F.col("raw") < 0, F.lit(EPSILON * mean)).otherwise(F.col("raw")).alias("idf"), number.cast("int").alias("word")), "bm25-known")

    held = tokens.select("source_id", F.size("t").alias("dl"), F.explode("t").alias("term")).join(known, "term").groupBy("source_id", "dl").agg(F.sort_array(F.collect_list("word")).alias("words"))
    put = asked.join(known, "term").groupBy("query_id").agg(F.collect_list(F.struct("word", "idf")).alias("w"))
    n_parts = max(1, -(-n_docs // DOC_PART))
    n_blocks = max(1, -(-n_asked // ASKED_BLOCK), min(2 * spark.sparkContext.defaultParallelism, -(-n_asked // ASKED_LEAST)))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    kinds = {"query_id": queries.schema["query_id"].dataType, "source_id": tokens.schema["source_id"].dataType}
    left = held.select(every(n_blocks).alias("block"), F.pmod(F.xxhash64("source_id"), F.lit(n_parts)).cast("int").alias("part"), F.lit(False).alias("asked"), F.lit(None).cast(kinds["query_id"]).alias("query_id"), "source_id", "dl", "words", F.lit(None).cast("array<double>").alias("idf"))
    right = put.select(F.pmod(F.xxhash64("query_id"), F.lit(n_blocks)).cast("int").alias("block"), every(n_parts).alias("part"), F.lit(True).alias("asked"), "query_id", F.lit(None).cast(kinds["source_id"]).alias("source_id"), F.lit(0).alias("dl"), F.col("w.word").alias("words"), F.col("w.idf").alias("idf"))
    met = left.unionByName(right).repartitionById(n_blocks * n_parts, F.col("block") * n_parts + F.col("part")).sortWithinPartitions("asked", "source_id")
    schema = T.StructType([*(T.StructField(c, t) for c, t in kinds.items()), T.StructField("score", T.DoubleType())])
    found = materialize(met.drop("block", "part").mapInArrow(_bm25_block(k, avgdl, schema.names), schema), "bm25-best")
    best = F.max("score").over(Window.partitionBy("query_id"))
    return found.withColumn("best", best).select("query_id", "source_id", "score", (F.col("score") / F.when(F.col("best") > 0, F.col("best")).otherwise(1.0)).alias("normalized"))


# ---------------------------------------------------------------- cosine (MTH-03, MTH-04, RET-05)
def l2_normalized(c: Column) -> Column:
    """The vector over its length; a zero vector stays (MTH-04)."""
    d = F.transform(c, lambda x: x.cast("double"))
    norm = F.sqrt(F.aggregate(d, F.lit(0.0), lambda a, x: a + x * x))
    return F.transform(d, lambda x: F.when(norm > 0, x / norm).otherwise(x))


def _unit(flat: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(flat, axis=1, keepdims=True)
    return flat / np.where(norm > 0, norm, 1)


def _matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    flat = (column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column).flatten()
    return flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


class _Best:
    """The k best sources of every query so far, ties by id."""

    def __init__(self, ids: np.ndarray, matrix: np.ndarray, k: int | None):
        self.ids, self.matrix, self.k = ids, matrix, k
        self.scores, self.sources = np.full((len(ids), 0), -np.inf), np.zeros((len(ids), 0), dtype=np.int64)

    def see(self, keys: np.ndarray, vectors: np.ndarray) -> None:
        s = self.matrix @ vectors.T
        scores, sources = np.concatenate([self.scores, s], 1), np.concatenate([self.sources, np.broadcast_to(keys, s.shape)], 1)
        order = np.lexsort((sources, -scores), axis=1)[:, : self.k]
        self.scores, self.sources = np.take_along_axis(scores, order, 1), np.take_along_axis(sources, order, 1)

    def rows(self) -> list[pa.Array]:
        return [pa.array(np.repeat(self.ids, self.scores.shape[1])), pa.array(self.sources.ravel()), pa.array(self.scores.ravel())]


_SCORED = ["query_id", "source_id", "score"]


def _one_pass(blocks: list[tuple[np.ndarray, np.ndarray]], k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = [_Best(ids, matrix, k) for ids, matrix in blocks]
        for batch in batches:
            if batch.num_rows:
                keys, vectors = batch.column(0).to_numpy(zero_copy_only=False), _unit(_matrix(batch.column(1)))
                for b in best:
                    b.see(keys, vectors)
        for b in best:
            yield pa.RecordBatch.from_arrays(b.rows(), names=_SCORED)

    return run


def _pair_of_blocks(k: int | None):
    def run(asked: pa.Table, vectors: pa.Table) -> pa.Table:
        if not asked.num_rows or not vectors.num_rows:
            return pa.table({"query_id": pa.array([], pa.int64()), "source_id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        best = _Best(asked.column("q").to_numpy(), _matrix(asked.column("v")), k)
        best.see(vectors.column("source_id").to_numpy(), _unit(_matrix(vectors.column("v"))))
        return pa.table(best.rows(), names=_SCORED)

    return run


def cosine_top_k(queries: DataFrame, vectors: DataFrame, k: int, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, source_id, score, rank): the exact k nearest of every query of a stated set, ties by id.

    While all queries hold at most BROADCAST_CELLS numbers, they go to every scan task in blocks and the vectors are read
    once; beyond that blocks of queries and parts of the vectors meet by key, each pair in a task of its own. Either way
    only k rows for each query and task are shuffled, and the driver never holds more than that bound.
    """
    asked = queries.where(F.col(vector).isNotNull()).select(F.col(key).cast("bigint").alias("q"), l2_normalized(F.col(vector)).alias("v"))
    rows = vectors.where(F.col(vector).isNotNull()).select(F.col(key).cast("bigint").alias("source_id"), F.col(vector).alias("v"))
    schema = "query_id bigint, source_id bigint, score double"
    size = asked.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.size("v")), F.lit(0)).alias("cells")).first()
    if size["cells"] <= BROADCAST_CELLS:
        held = asked.collect()
        blocks = [(np.array([r["q"] for r in held[at : at + QUERY_BLOCK]], dtype=np.int64), np.array([r["v"] for r in held[at : at + QUERY_BLOCK]])) for at in range(0, len(held), QUERY_BLOCK)]
        parts = rows.mapInArrow(_one_pass(blocks, k), schema)
    else:
        n_blocks, n_parts = -(-size["n"] // QUERY_BLOCK), max(1, -(-rows.count() // VECTOR_PART))
        span = lambda n, name: F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias(name)
        left = asked.select("q", "v", F.pmod(F.xxhash64("q"), F.lit(n_blocks)).cast("int").alias("block"), span(n_parts, "part"))
        right = rows.select("source_id", "v", F.pmod(F.xxhash64("source_id"), F.lit(n_parts)).cast("int").alias("part"), span(n_blocks, "block"))
        parts = left.groupBy("block", "part").cogroup(right.groupBy("block", "part")).applyInArrow(_pair_of_blocks(k), schema)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "source_id"))
    return parts.withColumn("rank", rank).where(F.col("rank") <= k)


def cosine_scores(queries: DataFrame, vectors: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, source_id, score) of every query of a stated set against every vector, for reports; blocks meet by key."""
    asked = queries.where(F.col(vector).isNotNull()).select(F.col(key).cast("bigint").alias("q"), l2_normalized(F.col(vector)).alias("v"))
    rows = vectors.where(F.col(vector).isNotNull()).select(F.col(key).cast("bigint").alias("source_id"), F.col(vector).alias("v"))
    n_blocks, n_parts = max(1, -(-asked.count() // QUERY_BLOCK)), max(1, -(-rows.count() // QUERY_BLOCK))
    span = lambda n, name: F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias(name)
    left = asked.select("q", "v", F.pmod(F.xxhash64("q"), F.lit(n_blocks)).cast("int").alias("block"), span(n_parts, "part"))
    right = rows.select("source_id", "v", F.pmod(F.xxhash64("source_id"), F.lit(n_parts)).cast("int").alias("part"), span(n_blocks, "block"))
    return left.groupBy("block", "part").cogroup(right.groupBy("block", "part")).applyInArrow(_pair_of_blocks(None), "query_id bigint, source_id bigint, score double")


# ---------------------------------------------------------------- cuts (WIN-02, SRT-01, SRT-02, PRJ-08)
def ranked(scores: DataFrame, score: str = "score", keep: int | None = None) -> DataFrame:
    """rank within the query: by falling score, ties by source (SRT-01)."""
    out = scores.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc(score), "source_id")))
    return out if keep is None else out.where(F.col("rank") <= keep)


def cut(rankings: DataFrame, how: Cut, score: str = "score") -> DataFrame:
    """The selected rows of rankings (query_id, source_id, rank, score): up to the first largest gap in the window, at most top_k, above the floor."""
    if how.strategy == "threshold":
        return rankings.where((F.col("rank") <= how.top_k) & (F.col(score) >= how.floor))
    window = rankings.where(F.col("rank") <= how.window)
    w = Window.partitionBy("query_id").orderBy("rank")
    gaps = window.withColumn("gap", F.col(score) - F.lead(score).over(w))
    at = gaps.where("gap is not null").groupBy("query_id").agg(F.max(F.struct(F.col("gap"), (-F.col("rank")).alias("neg"))).alias("m")).select("query_id", (-F.col("m.neg")).alias("cut_after"), F.col("m.gap").alias("largest_gap"))
    kept = window.join(at, "query_id", "left").where(F.col("rank") <= F.least(F.coalesce("cut_after", F.lit(1)), F.lit(how.top_k)))
    return kept.where(F.col(score) >= how.floor).drop("cut_after", "largest_gap")


def gap_positions(rankings: DataFrame, how: Cut, score: str = "score") -> DataFrame:
    """(query_id, cut_after, largest_gap): the first largest gap in each query's window."""
    w = Window.partitionBy("query_id").orderBy("rank")
    gaps = rankings.where(F.col("rank") <= how.window).withColumn("gap", F.col(score) - F.lead(score).over(w)).where("gap is not null")
    return gaps.groupBy("query_id").agg(F.max(F.struct("gap", (-F.col("rank")).alias("neg"))).alias("m")).select("query_id", (-F.col("m.neg")).alias("cut_after"), F.col("m.gap").alias("largest_gap"))


def fallback(selected: DataFrame, queries: DataFrame, sources: DataFrame) -> DataFrame:
    """Selections, and all sources for queries that have none (SET-02)."""
    empty = queries.select("query_id").distinct().join(selected.select("query_id"), "query_id", "left_anti")
    return selected.select("query_id", "source_id").unionByName(with_all(empty, sources))


def rerank(selected: DataFrame, queries: DataFrame, docs: DataFrame, score: Callable[[Column, Column], Column], top_k: int) -> DataFrame:
    """(query_id, source_id, rank): candidates in the order of score(query, doc), cut to top_k; nothing is added (SRT-06, RET-07)."""
    pairs = selected.select("query_id", "source_id").join(queries, "query_id").join(docs, "source_id")
    return ranked(pairs.withColumn("rerank_score", score(F.col("query"), F.col("doc"))), "rerank_score", top_k).select("query_id", "source_id", "rank", "rerank_score")


def token_overlap_score(query: Column, doc: Column) -> Column:
    """Offline stand-in for a cross-encoder: share of the query's words that the document has."""
    q, d = F.array_distinct(bm25_tokens(query)), F.array_distinct(bm25_tokens(doc))
    return F.when(F.size(q) > 0, F.size(F.array_intersect(q, d)) / F.size(q)).otherwise(0.0)


def similarity_report(scores: DataFrame, threshold: float, score: str = "score") -> DataFrame:
    """Every scored source with its rank and whether it reaches the threshold, whatever the cut says (RET-09)."""
    return ranked(scores, score).withColumn("passes", F.col(score) >= threshold)


def selection_lists(selected: DataFrame, order: str = "type") -> DataFrame:
    """(query_id, selected): ids in the fixed order of their types, or by score (RET-12, Q1). selected: query_id, source_id, rank."""
    kind = F.substring_index("source_id", ".", 1)
    at = F.coalesce(F.array_position(F.array(*[F.lit(t) for t in TYPE_ORDER]), kind), F.lit(0))
    first = at if order == "type" else F.lit(0)
    return selected.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct(first.alias("t"), "rank", "source_id"))), lambda x: x["source_id"]).alias("selected"))
