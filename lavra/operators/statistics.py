"""Paired tests, corrections, overlap bands and interaction tests (STA-*, WIN-05..07, MTH-06, SET-07)."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lavra.functions.text import content_tokens, first_label, set_overlap
from lavra.session import parallelism

RESAMPLES, SEED, ALPHA = 10_000, 42, 0.05
#: Resamples of a block, and values that a block holds at once.
BLOCK, CELLS = 500, 1_000_000
#: Draws that are hashed at once, so that their words stay in a core's cache.
DRAWS = 16_384
BANDS = ("baixa", "media", "alta")


def holm(tests: DataFrame, family: list[str], p: str = "p_raw", alpha: float = ALPHA) -> DataFrame:
    """tests with p_holm and significant: step-down correction within each family (STA-02, WIN-05). Families are lists of tests, so small."""
    inside = Window.partitionBy(*family)
    ordered = inside.orderBy(p)
    step = F.col(p) * (F.count("*").over(inside) - F.row_number().over(ordered) + 1)
    stepped = tests.withColumn("__step", step)
    running = F.max("__step").over(ordered.rowsBetween(Window.unboundedPreceding, 0))
    capped = stepped.withColumn("p_holm", F.least(F.lit(1.0), running)).drop("__step")
    return capped.withColumn("significant", F.col("p_holm") <= alpha)


def paired(a: DataFrame, b: DataFrame, key: str, value: str) -> DataFrame:
    """(key, a, b) of two result sets that must hold the same ids, else an error (JN-07, SET-06)."""
    both = a.select(F.col(key), F.col(value).alias("a")).join(b.select(F.col(key), F.col(value).alias("b")), key, "full_outer")
    lonely = both.where("a is null or b is null").select(key).limit(5).collect()
    if lonely:
        raise ValueError(f"ids in one result set only, such as {[r[0] for r in lonely]}")
    return both


def _slope(u: np.ndarray, v: np.ndarray) -> np.ndarray:
    c = u - u.mean(-1, keepdims=True)
    below = (c * c).sum(-1)
    return np.where(below > 0, (c * (v - v.mean(-1, keepdims=True))).sum(-1) / np.where(below > 0, below, 1), 0.0)


def _bootstrap(stat: str, n_boot: int, seed: int):
    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        name, block = key
        rng = np.random.default_rng([seed, int(block)])
        pdf = pdf.sort_values("key", kind="stable")
        d = (pdf["a"] - pdf["b"]).to_numpy(float)
        pick = lambda v, k: v[rng.integers(0, len(v), (k, len(v)))]
        if stat == "mean":
            observed, draw = d.mean(), lambda k: pick(d, k).mean(1)
        elif stat == "slope":
            x = pdf["x"].to_numpy(float)
            observed = float(_slope(x[None], d[None])[0])

            def draw(k: int) -> np.ndarray:
                at = pick(np.arange(len(d)), k)
                return _slope(x[at], d[at])
        else:
            low = pdf["low"].to_numpy(bool)
            lo, hi = d[low], d[~low]
            observed, draw = lo.mean() - hi.mean(), lambda k: pick(lo, k).mean(1) - pick(hi, k).mean(1)
        left, step = min(BLOCK, n_boot - int(block) * BLOCK), max(1, CELLS // len(d))
        boot = np.concatenate([draw(min(step, left - i)) for i in range(0, left, step)])
        return pd.DataFrame({"comparison": name, "n": len(d), "estimate": observed, "boot": boot})

    return run


def bootstrap(pairs: DataFrame, stat: str = "mean", n_boot: int = RESAMPLES, seed: int = SEED) -> DataFrame:
    """(comparison, n, estimate, p_raw, ci_low, ci_high) of paired results (STA-01), of the slope over x (STA-10), or of low against high (STA-11).

    pairs: comparison, key, a, b and, by stat, x or low. One comparison holds the questions of a benchmark, so one task
    can hold it; resamples are drawn in blocks, each a task with its own generator, CELLS values at a time. Two-sided p is
    twice the smaller tail, at most 1. Difference is a minus b.
    """
    blocks = pairs.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit((n_boot - 1) // BLOCK))))
    drawn = blocks.groupBy("comparison", "block").applyInPandas(_bootstrap(stat, n_boot, seed), "comparison string, n bigint, estimate double, boot double")
    tails = drawn.groupBy("comparison").agg(
        F.max("n").alias("n"), F.max("estimate").alias("estimate"), F.avg((F.col("boot") >= 0).cast("double")).alias("up"), F.avg((F.col("boot") <= 0).cast("double")).alias("down"),
        F.percentile("boot", F.array(F.lit(0.025), F.lit(0.975))).alias("ci"),
    )
    return tails.select("comparison", "n", "estimate", F.least(F.lit(1.0), 2 * F.least("up", "down")).alias("p_raw"), F.col("ci")[0].alias("ci_low"), F.col("ci")[1].alias("ci_high"))


_MD5_K = [int(abs(math.sin(i + 1)) * 2**32) for i in range(64)]
_MD5_S = ((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21))
_MD5_G = (lambda i: i, lambda i: (5 * i + 1) % 16, lambda i: (3 * i + 5) % 16, lambda i: 7 * i % 16)


def _md5_head(words: list[int | np.ndarray], n: int) -> np.ndarray:
    """The first eight hexadecimal digits, as numbers, of the MD5 of n messages of one block, given as 16 words each: equal ones as a number.

    Only the first word of the digest is made, which is known after 61 of the 64 steps.
    """
    a, b, c, d = (np.full(n, x, dtype=np.uint32) for x in (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476))
    f, t = np.empty(n, dtype=np.uint32), np.empty(n, dtype=np.uint32)
    for i in range(61):
        kind = i // 16
        if kind == 0:
            np.bitwise_xor(c, d, out=f)
            np.bitwise_and(f, b, out=f)
            np.bitwise_xor(f, d, out=f)
        elif kind == 1:
            np.bitwise_xor(b, c, out=f)
            np.bitwise_and(f, d, out=f)
            np.bitwise_xor(f, c, out=f)
        elif kind == 2:
            np.bitwise_xor(b, c, out=f)
            np.bitwise_xor(f, d, out=f)
        else:
            np.invert(d, out=f)
            np.bitwise_or(f, b, out=f)
            np.bitwise_xor(f, c, out=f)
        np.add(f, a, out=f)
        w, k, s = words[_MD5_G[kind](i)], _MD5_K[i], _MD5_S[kind][i % 4]
        if isinstance(w, np.ndarray):
            np.add(f, w, out=f)
        else:
            k = (k + w) & 0xFFFFFFFF
        np.add(f, np.uint32(k), out=f)
        np.left_shift(f, np.uint32(s), out=t)
        np.right_shift(f, np.uint32(32 - s), out=f)
        np.bitwise_or(f, t, out=f)
        np.add(f, b, out=a)
        a, b, c, d = d, a, b, c
    return (b + np.uint32(0x67452301)).byteswap()


def _slot_words(slots: np.ndarray, before: int) -> tuple[int, np.ndarray, np.ndarray]:
    """The message words that hold the slots' digits and the end mark behind `before` bytes: number of the first, words, bits of the messages."""
    digits = np.char.mod("%d", slots).astype("S")
    n = np.char.str_len(digits)
    width = digits.dtype.itemsize
    if before + width > 55:
        raise ValueError("a seed of so many digits does not fit into one block")
    first, lead = before // 4, before % 4
    text = np.zeros((len(slots), -(-(lead + width + 1) // 4) * 4), dtype=np.uint8)
    text[:, lead : lead + width] = digits.view(np.uint8).reshape(len(slots), width)
    text[np.arange(len(slots)), lead + n] = 0x80
    return first, np.ascontiguousarray(text.view("<u4").T), ((before + n) * 8).astype(np.uint32)


def _drawn_means(values: list[np.ndarray], resamples: range, seed: int) -> np.ndarray:
    """Means of every resample of each of the values, arrays of one length whose NaN do not count: (values, resamples)."""
    n, there = len(values[0]), [~np.isnan(v) for v in values]
    whole, zero = [t.all() for t in there], [np.where(t, v, 0.0) for t, v in zip(there, values)]
    sums, counts = np.zeros((len(values), len(resamples))), np.zeros((len(values), len(resamples)))
    span, rows = min(n, DRAWS), max(1, DRAWS // n)
    tables: dict[tuple[int, int], tuple] = {}
    at, of = 0, 0
    while at < len(resamples):
        starts = [f"{seed}|{b}|".encode() for b in resamples[at : at + rows]]
        starts = [x for x in starts if len(x) == len(starts[0])]
        size = len(starts[0])
        if size != of:
            tables, of = {}, size
        heads = np.array([np.frombuffer(x.ljust(-(-size // 4) * 4, b"\0"), dtype="<u4") for x in starts])
        for low in range(0, n, span):
            if low not in tables:
                tables[low] = _slot_words(np.arange(low, min(low + span, n)), size)
            first, tail, bits = tables[low]
            k = len(bits)
            flat = (lambda x: x) if len(starts) == 1 else lambda x: np.tile(x, len(starts))
            words: list = [0] * 16
            for g in range(heads.shape[1]):
                words[g] = int(heads[0, g]) if len(starts) == 1 else np.repeat(heads[:, g], k)
            for g in range(len(tail)):
                words[first + g] = flat(tail[g]) if first + g >= heads.shape[1] else flat(tail[g]) | (np.uint32(words[first + g]) if len(starts) == 1 else words[first + g])
            words[14] = flat(bits)
            hashed = _md5_head(words, k * len(starts))
            if n < 2**32:
                hashed -= hashed // np.uint32(n) * np.uint32(n)
            hashed = hashed.astype(np.int64)
            for j, v in enumerate(zero):
                sums[j, at : at + len(starts)] += v.take(hashed).reshape(len(starts), k).sum(1)
                counts[j, at : at + len(starts)] += k if whole[j] else there[j].take(hashed).reshape(len(starts), k).sum(1)
        at += len(starts)
    return np.where(counts > 0, sums / np.maximum(counts, 1), np.nan)


def _drawn(n_boot: int, n_blocks: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                block, told = batch.column("block")[i].as_py(), batch.column("told")[i].values
                d = told.field("d")
                at = d.offsets.to_numpy()
                values = d.values.to_numpy(zero_copy_only=False)
                resamples = range(n_boot * block // n_blocks, n_boot * (block + 1) // n_blocks)
                means = _drawn_means([values[x:y] for x, y in zip(at, at[1:])], resamples, seed)
                for name, m in zip(told.field("comparison").to_pylist(), means):
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(m), pa.string()), pa.array(m, mask=np.isnan(m))], names=["comparison", "m"])

    return run


def bootstrap_sql(pairs: DataFrame, n_boot: int = 200, seed: int = SEED) -> DataFrame:
    """The mean bootstrap whose draws are hashes of (seed, resample, position), so any engine repeats them.

    A comparison is one array, as in bootstrap(). Draws hang on its length only, so comparisons of one length share them;
    blocks of resamples, each a task, hash and look up a cacheful of draws at a time. Draws are neither shuffled nor written.
    """
    told = pairs.select("comparison", F.struct("key", (F.col("a") - F.col("b")).alias("d")).alias("o"))
    sizes = told.groupBy("comparison").agg(F.count("*").alias("n"), F.avg("o.d").alias("estimate"))
    packed = told.groupBy("comparison").agg(F.transform(F.array_sort(F.collect_list("o")), lambda x: x["d"]).alias("d"))
    n_blocks = min(n_boot, 2 * parallelism(pairs.sparkSession))
    blocks = packed.groupBy(F.size("d").alias("n")).agg(F.collect_list(F.struct("comparison", "d")).alias("told")).select("told", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))).alias("block"))
    means = blocks.repartitionById(n_blocks, F.col("block")).mapInArrow(_drawn(n_boot, n_blocks, seed), "comparison string, m double")
    tails = means.groupBy("comparison").agg(F.avg((F.col("m") >= 0).cast("double")).alias("up"), F.avg((F.col("m") <= 0).cast("double")).alias("down"), F.percentile("m", F.array(F.lit(0.025), F.lit(0.975))).alias("ci"))
    return tails.join(sizes, "comparison").select("comparison", "n", "estimate", F.least(F.lit(1.0), 2 * F.least("up", "down")).alias("p_raw"), F.col("ci")[0].alias("ci_low"), F.col("ci")[1].alias("ci_high"))


def slope(df: DataFrame, by: list[str], y: str, x: str) -> DataFrame:
    """Least-squares slope by group, 0 where x does not vary (MTH-06)."""
    return df.groupBy(*by).agg(F.count("*").alias("n"), F.coalesce(F.regr_slope(y, x), F.lit(0.0)).alias("slope"))


def model_pairs(results: DataFrame, model: str = "model", key: str = "query_id", value: str = "f1", vs_best: bool = False) -> DataFrame:
    """(comparison, key, a, b) of all unordered pairs of models, or of the best model against each other one (SET-07, SRT-08).

    The best model has the highest mean; of equals the first by name. Results meet by question, so each row joins only the
    other models' rows of the same question.
    """
    a = results.select(F.col(key).alias("key"), F.col(model).alias("ma"), F.col(value).alias("a"))
    b = results.select(F.col(key).alias("key"), F.col(model).alias("mb"), F.col(value).alias("b"))
    if vs_best:
        best = results.groupBy(model).agg(F.avg(value).alias("m")).orderBy(F.desc("m"), model).limit(1).select(F.col(model).alias("ma"))
        return a.join(F.broadcast(best), "ma").join(b, "key").where("ma != mb").select(F.concat_ws(" vs ", "ma", "mb").alias("comparison"), "key", "a", "b")
    return a.join(b, "key").where("ma < mb").select(F.concat_ws(" vs ", "ma", "mb").alias("comparison"), "key", "a", "b")


def common_models(results: DataFrame, versions: list[str], model: str = "model", version: str = "version") -> DataFrame:
    """Models that have results in every version (JN-08)."""
    return results.where(F.col(version).isin(versions)).groupBy(model).agg(F.countDistinct(version).alias("v")).where(F.col("v") == len(versions)).select(model)


def version_steps(versions: list[str]) -> list[tuple[str, str]]:
    """Successive versions, and first against last where that is another pair (WIN-06)."""
    steps = list(zip(versions, versions[1:]))
    ends = (versions[0], versions[-1]) if len(versions) > 2 else None
    return steps + ([ends] if ends and ends not in steps else [])


def ablation_pairs(results: DataFrame, versions: list[str], model: str = "model", version: str = "version", key: str = "query_id", value: str = "f1") -> DataFrame:
    """(comparison, key, a, b) of the same model in two versions (STA-04)."""
    kept = results.join(common_models(results, versions, model, version), model)
    steps = F.explode(F.array(*[F.struct(F.lit(x).alias("va"), F.lit(y).alias("vb")) for x, y in version_steps(versions)]))
    a = kept.select(F.col(model).alias("m"), F.col(key).alias("key"), F.col(version).alias("va"), F.col(value).alias("a"))
    b = kept.select(F.col(model).alias("m"), F.col(key).alias("key"), F.col(version).alias("vb"), F.col(value).alias("b"))
    named = a.withColumn("s", steps).where("s.va = va").select("m", "key", "a", "va", "s.vb")
    return named.join(b, ["m", "key", "vb"]).select(F.format_string("%s: %s vs %s", "m", "va", "vb").alias("comparison"), "key", "a", "b")


# ---------------------------------------------------------------- lexical overlap (STA-06..09)
#: The fields of a source that its catalog text joins, in this order.
TEXT_FIELDS = ("embedding_hint", "description", "business_role", "when_to_use")


def catalog_texts(sources: DataFrame, columns: DataFrame | None = None) -> DataFrame:
    """(source_id, text): four fields, then the names of the source's columns and their descriptions (ARR-11).

    columns: source_id, column_name, ordinal, description. Of repeated sources the greatest value of each field counts.
    """
    one = sources.groupBy("source_id").agg(*[F.max(c).alias(c) for c in TEXT_FIELDS if c in sources.columns])
    parts = [F.when(F.col(c) != "", F.col(c)) for c in TEXT_FIELDS if c in sources.columns]
    if columns is not None:
        listed = F.array_sort(F.collect_list(F.struct("ordinal", "column_name", "description")))
        told = columns.groupBy("source_id").agg(listed.alias("c"))
        names = F.array_join(F.transform("c", lambda x: x["column_name"]), " ")
        said = F.array_join(F.filter(F.transform("c", lambda x: x["description"]), lambda d: d.isNotNull() & (d != "")), " ")
        one = one.join(told.select("source_id", names.alias("__names"), F.when(said != "", said).alias("__said")), "source_id", "left")
        parts += [F.col("__names"), F.col("__said")]
    return one.select("source_id", F.concat_ws(" ", *parts).alias("text"))


def mean_by_label(df: DataFrame, label: str, value: str = "overlap") -> DataFrame:
    """(label, n, mean) of the non-null values in ascending order of the mean (AGG-21)."""
    kept = df.where(F.col(value).isNotNull())
    return kept.groupBy(label).agg(F.count("*").alias("n"), F.round(F.avg(value), 6).alias(f"mean_{value}")).orderBy(f"mean_{value}", label)


def overlaps(queries: DataFrame, texts: DataFrame, metric: str = "containment", gold: str = "union", stem: bool = False) -> DataFrame:
    """(query_id, overlap, unresolved): how much of each question the text of its gold sources says (STA-06, JN-10, AGG-11).

    queries: query_id, query, gold (array of source ids). texts: source_id, text. Compound ids count as their first part;
    ids that are not found are tried as `xlsx.` for `spreadsheets.`; overlap is null where none is found.
    """
    tokens = texts.select("source_id", content_tokens(F.coalesce("text", F.lit("")), stem=stem).alias("d"))
    asked = queries.select("query_id", content_tokens(F.coalesce("query", F.lit("")), stem=stem).alias("q"), F.explode_outer(F.transform("gold", first_label)).alias("gid"))
    other = F.regexp_replace("gid", r"^spreadsheets\.", "xlsx.")
    direct = asked.join(tokens.withColumnRenamed("source_id", "gid"), "gid", "left")
    either = direct.join(tokens.select(F.col("source_id").alias("__o"), F.col("d").alias("d2")), other == F.col("__o"), "left").withColumn("d", F.coalesce("d", "d2"))
    per = either.groupBy("query_id").agg(
        F.first("q").alias("q"), F.array_distinct(F.flatten(F.collect_list("d"))).alias("u"), F.count("d").alias("n"), F.max(set_overlap(F.col("q"), F.col("d"), metric)).alias("mx"),
        F.avg(F.when(F.col("d").isNotNull(), set_overlap(F.col("q"), F.col("d"), metric))).alias("mn"), F.sum((F.col("gid").isNotNull() & F.col("d").isNull()).cast("int")).alias("unresolved"),
    )
    value = {"union": set_overlap(F.col("q"), F.col("u"), metric), "max": F.col("mx"), "mean": F.col("mn")}[gold]
    return per.select("query_id", F.when(F.col("n") > 0, value).alias("overlap"), "unresolved")


def band_edges(df: DataFrame, value: str, n_bins: int = 3, fixed: list[float] | None = None) -> list[float]:
    """Inner edges of the bands: given ones, or quantiles of the non-null values (linear interpolation)."""
    if fixed is not None:
        return list(fixed)
    shares = [(i + 1) / n_bins for i in range(n_bins - 1)]
    return list(df.agg(F.percentile(value, F.array(*[F.lit(s) for s in shares])).alias("e")).first()["e"] or [])


def band(c: Column, edges: list[float], names: tuple[str, ...] = BANDS) -> Column:
    """Name of the band: as many edges at or below the value; equal values share a band (WIN-07, STA-07). Null stays null."""
    at = F.lit(0)
    for e in edges:
        at = at + (c >= e).cast("int")
    labels = list(names) if len(edges) + 1 == len(names) else [f"b{i + 1}" for i in range(len(edges) + 1)]
    return F.when(c.isNotNull(), F.element_at(F.array(*[F.lit(x) for x in labels]), at + 1))


def band_profile(df: DataFrame, value: str = "f1", by: str = "band") -> DataFrame:
    """(band, n, mean, population deviation) (AGG-20)."""
    return df.where(F.col(by).isNotNull()).groupBy(by).agg(F.count("*").alias("n"), F.round(F.avg(value), 4).alias("mean"), F.round(F.stddev_pop(value), 4).alias("std"))


def five_numbers(df: DataFrame, value: str) -> DataFrame:
    """Least, quartiles and greatest, interpolated (AGG-22)."""
    p = F.percentile(value, F.array(*[F.lit(x) for x in (0.0, 0.25, 0.5, 0.75, 1.0)]))
    return df.agg(p.alias("p")).select(*[F.round(F.col("p")[i], 6).alias(n) for i, n in enumerate(("min", "q25", "median", "q75", "max"))])
