"""Problem 4: how distinctive a term is of a record.

Each term's share of the relative entropy between the record's Dirichlet-smoothed language model and the model of the
whole collection: p_d(t) = (tf + mu * p_c(t)) / (|d| + mu), weight = p_d(t) * log2(p_d(t) / p_c(t)).
Terms that fewer than `min_df` records hold are cut off after all counts are taken.

Defined results: null and blank texts count as empty; a record without terms yields no rows; repeated rows of the same
record and texts count once; rows of one record with different texts are joined. An empty collection yields no rows.

Skew: counts are pre-aggregated, and the terms that more than 1/HOT of all postings name (HOT of them at most, a proven
bound) meet their postings by broadcast, all others by an equi-join on the term.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lavra.functions.text import hyphen_terms
from lavra.session import materialize

HOT = 2000


def records(frame: DataFrame, kind: str, uid: str, texts: list[str]) -> DataFrame:
    """(record_kind, record_uid, text), one row for each different text set of a record."""
    text = F.concat_ws("\n", *[F.col(c) for c in texts])
    return frame.select(F.lit(kind).alias("record_kind"), F.col(uid).cast("bigint").alias("record_uid"), text.alias("text")).distinct()


def weights(collection: DataFrame, mu: float = 200.0, min_df: int = 2) -> DataFrame:
    """(record_kind, record_uid, term, tf, df, ctf, weight) of every term of every record of (record_kind, record_uid, text)."""
    tokens = collection.select("record_kind", "record_uid", F.explode(hyphen_terms(F.col("text"))).alias("term"))
    postings = materialize(tokens.groupBy("record_kind", "record_uid", "term").agg(F.count("*").alias("tf")), "postings")
    totals = postings.agg(F.count("*").alias("n"), F.coalesce(F.sum("tf"), F.lit(0)).alias("total")).first()
    stats = postings.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("ctf")).where(F.col("df") >= min_df)
    lengths = postings.groupBy("record_kind", "record_uid").agg(F.sum("tf").alias("len"))
    bar = max(1, totals["n"] // HOT)
    hot = stats.where(F.col("df") > bar)
    cold = stats.where(F.col("df") <= bar)
    scored = postings.join(F.broadcast(hot), "term").unionByName(postings.join(cold, "term"))
    key = [scored["record_kind"].eqNullSafe(lengths["record_kind"]), scored["record_uid"].eqNullSafe(lengths["record_uid"])]
    p_c = F.col("ctf") / F.lit(float(totals["total"] or 1))
    p_d = (F.col("tf") + mu * p_c) / (F.col("len") + mu)
    return scored.join(lengths, key).select(scored["record_kind"], scored["record_uid"], "term", "tf", "df", "ctf", (p_d * F.log2(p_d / p_c)).alias("weight"))


def typical(weighted: DataFrame, min_tf: int = 2, min_df: int = 2, max_df: int = 5) -> DataFrame:
    """Terms that are frequent in the record and shared with few others, by the counts that the weights are made of.

    The weight itself ranks terms of a record and sets no bar here, as none is wanted beside these counts.
    """
    return weighted.where((F.col("tf") >= min_tf) & F.col("df").between(min_df, max_df))
