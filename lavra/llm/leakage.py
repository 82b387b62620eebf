"""Problem 7: held-out items that leaked into documents, found with a positional inverted index.

Index: one posting (term, next term, doc_id, pos) for every word of every document, in folders by a hash of the term and
sorted by term, with a dictionary of how often each term occurs. It is written once and may be opened again; a search reads
only the folders of the terms that it asks for. Frequent terms of a folder are spread over SPREAD files by document.

Search, for every item at once:

1. Anchors: of every window of `run` words the rarest term (a passage of `run` words holds it), and of every item the rarest
   terms of which a copy must hold some: a copy keeps all words but a `1 - keep` share, so of that many and `need` more
   it holds `need`. Rare means few postings times few items, by the dictionary.
2. One pass over the postings of the anchors. Postings of a window's rarest term, adjusted by its place in the item, give the
   lines (document, item, offset) where the next word agrees as well; rare terms are counted by stretches of the document.
3. Of documents with a line or with `need` rare terms in one stretch the words are laid beside the item's: `run` equal
   words running at the line's offset are a passage, a chain of words in order within `slack` times the item's length
   a reworded copy.

Defined results: null and blank texts have no words, rows without an id are left out; items shorter than `run` words can only
match by copy; an opening sentence that several items share is an instruction and left aside for copies; repeated documents
are reported each.

Scale: no list is collected whole, and a long document is judged by stretches of the item's size. Anchors meet postings by
broadcast only while there are at most BROADCAST_ROWS of them, otherwise by a shuffled join.
"""

from __future__ import annotations

import math
import uuid
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lavra.functions.text import strip_accents
from lavra.session import materialize, parallelism, remember, shared_dir

BROADCAST_ROWS = 200_000
BUCKETS, SPREAD = 64, 4


@dataclass
class Index:
    """postings: bucket, term, next, doc_id, pos. dictionary: term, n."""

    postings: DataFrame
    dictionary: DataFrame


def item_words(c):
    """Runs of letters and digits without case or accents; compatibility forms such as the ordinal sign are spelled out."""
    return F.regexp_extract_all(F.lower(strip_accents(F.lower(c), compatibility=True)), F.lit(r"[\p{L}\p{N}]+"), 0)


def _bucket(term: str | Column) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(BUCKETS)).cast("int")


def build_index(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", path: str | None = None) -> Index:
    """The index of all documents, written to path, or to a folder of its own in the shared one."""
    spark = docs.sparkSession
    if path is None:
        path = f"{shared_dir(spark)}/index-{uuid.uuid4().hex}"
        remember(spark, path)
    split = docs.select(F.col(id_column).cast("bigint").alias("doc_id"), item_words(F.col(text_column)).alias("term")).where("doc_id is not null and size(term) > 0")
    after = F.concat(F.slice("term", F.lit(2), F.size("term")), F.array(F.lit("")))
    placed = split.withColumn("next", after).select("doc_id", F.posexplode(F.arrays_zip("term", "next")).alias("pos", "w")).select(_bucket("w.term").alias("bucket"), "w.term", "w.next", "doc_id", "pos")
    dealt = placed.repartition(parallelism(spark), "bucket", F.pmod(F.xxhash64("doc_id"), F.lit(SPREAD))).sortWithinPartitions("bucket", "term", "doc_id", "pos")
    dealt.write.partitionBy("bucket").parquet(f"{path}/postings")
    postings = open_index(spark, path, dictionary=False).postings
    postings.groupBy("term").agg(F.count("*").alias("n")).write.parquet(f"{path}/dictionary")
    return open_index(spark, path)


def open_index(spark: SparkSession, path: str, dictionary: bool = True) -> Index:
    postings = spark.read.schema("term string, next string, doc_id bigint, pos int, bucket int").parquet(f"{path}/postings")
    return Index(postings, spark.read.schema("term string, n bigint").parquet(f"{path}/dictionary") if dictionary else None)


def prepare_items(items: DataFrame, id_column: str = "item_id", text_column: str = "text") -> DataFrame:
    """(item_id, words, skip): the item's words and how many of them are a shared opening instruction."""
    first = F.regexp_extract(F.col(text_column), r"(?s)^\s*([^.!?:]+[.!?:])\s+\S", 1)
    base = items.where(F.col(text_column).isNotNull()).select(F.col(id_column).cast("bigint").alias("item_id"), item_words(F.col(text_column)).alias("words"), item_words(first).alias("opening"))
    shared = base.where(F.size("opening") > 0).groupBy("opening").agg(F.countDistinct("item_id").alias("n")).where("n > 1")
    return base.join(shared, "opening", "left").select("item_id", "words", F.when(F.col("n") > 1, F.size("opening")).otherwise(0).alias("skip")).where(F.size("words") > 0)


def _anchor_rows(run: int, extra: int, keep: float, slack: float):
    def anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for item, skip, places in zip(*(c.to_pylist() for c in batch.columns)):
                seq = sorted(places, key=lambda p: p["ipos"])
                lines: set[int] = set()
                for i in range(len(seq) - run + 1):  # the last word of a window has its next outside
                    lines.add(min((p["cost"], p["ipos"]) for p in seq[i : i + run - 1])[1])
                body = sorted((p["cost"], p["ipos"]) for p in seq if p["ipos"] >= skip)
                least = math.ceil(keep * len(body) - 1e-9)
                need = min(extra, least)
                few = {p for _, p in body[: len(body) - least + need]}
                reach = max(1, int(slack * len(body) + 1e-9))
                out += [(item, p["term"], p["next"], p["ipos"], p["ipos"] in lines, p["ipos"] in few, need, reach) for p in seq if p["ipos"] in lines or p["ipos"] in few]
            cols = list(zip(*out)) if out else [[]] * 8
            types = (pa.int64(), pa.string(), pa.string(), pa.int32(), pa.bool_(), pa.bool_(), pa.int32(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], ["item_id", "term", "next", "ipos", "is_line", "is_rare", "need", "reach"])

    return anchors


def _chain(pairs: list[tuple[int, int]], least: int, span: int) -> int:
    """Longest in-order chain of item words within span document words, as far as least; 0 where no window can hold least of them."""
    pairs = sorted(pairs, key=lambda p: (p[1], -p[0]))
    best, lo, distinct = 0, 0, Counter()
    starts: list[tuple[int, int]] = []
    for hi, (i, d) in enumerate(pairs):
        distinct[i] += 1
        while pairs[lo][1] <= d - span:
            distinct[pairs[lo][0]] -= 1
            if not distinct[pairs[lo][0]]:
                del distinct[pairs[lo][0]]
            lo += 1
        if len(distinct) >= least:
            starts.append((lo, hi + 1))
    widest: dict[int, int] = {}
    for a, b in starts:
        widest[a] = b
    for a, b in widest.items():
        tails: list[int] = []
        for i, _ in pairs[a:b]:
            at = bisect_left(tails, i)
            if at == len(tails):
                tails.append(i)
            else:
                tails[at] = i
        best = max(best, len(tails))
        if best >= least:
            break
    return best


def _verify(keep: float, slack: float):
    def run_over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc, item, body, stretch in zip(*(c.to_pylist() for c in batch.columns)):
                at: dict[str, list[int]] = {}
                for i, w in enumerate(body):
                    at.setdefault(w, []).append(i)
                least = math.ceil(keep * len(body) - 1e-9)
                if _chain([(i, d) for d, w in enumerate(stretch) for i in at.get(w, ())], least, int(slack * len(body) + 1e-9)) >= least:
                    rows.append((doc, item))
            cols = list(zip(*rows)) if rows else [[], []]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["doc_id", "item_id"])

    return run_over


def search(index: Index, docs: DataFrame, items: DataFrame, run: int = 12, keep: float = 0.75, slack: float = 1.3, extra: int = 8, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, item_id, how) of every document that holds a passage of run words, or a reworded copy, of an item.

    index: build_index() of docs. items: prepare_items().
    """
    after = F.concat(F.slice("words", F.lit(2), F.size("words")), F.array(F.lit("")))
    zipped = F.posexplode(F.arrays_zip(F.col("words").alias("term"), after.alias("next")))
    items = materialize(items.where(F.size("words") > F.col("skip")), "items")
    places = items.select("item_id", "skip", zipped.alias("ipos", "w")).select("item_id", "skip", "ipos", F.col("w.term").alias("term"), F.col("w.next").alias("next"))
    in_items = places.groupBy("term").agg(F.countDistinct("item_id").alias("items"))
    costs = index.dictionary.join(in_items, "term").select("term", (F.col("n") * F.col("items")).alias("cost"))
    known = F.struct("term", "next", "ipos", F.coalesce("cost", F.lit(0)).alias("cost"))
    placed = places.join(costs, "term", "left").groupBy("item_id", "skip").agg(F.collect_list(known).alias("places"))
    anchors = materialize(placed.mapInArrow(_anchor_rows(run, extra, keep, slack), "item_id bigint, term string, next string, ipos int, is_line boolean, is_rare boolean, need int, reach int"), "anchors")
    hint = F.broadcast if anchors.count() <= BROADCAST_ROWS else (lambda x: x)

    # one pass over the folders of the anchors
    folders = [r[0] for r in anchors.select(_bucket("term").alias("b")).distinct().collect()]
    asked = anchors.groupBy("term").agg(F.collect_set(F.when(F.col("is_line"), F.col("next"))).alias("nexts"), F.max("is_rare").alias("rare"))
    met = index.postings.where(F.col("bucket").isin(folders)).select("term", "next", "doc_id", "pos").join(hint(asked), "term")
    hits = materialize(met.where(F.col("rare") | F.array_contains("nexts", F.col("next"))).select("term", "next", "doc_id", "pos"), "hits")
    lines = hits.join(hint(anchors.where("is_line").select("item_id", "term", "next", "ipos")), ["term", "next"])
    lines = lines.select("doc_id", "item_id", (F.col("pos") - F.col("ipos")).alias("start"), "ipos")
    # whatever spans at most `reach` words lies within a stretch of two times that
    rare = hits.select("term", "doc_id", "pos").join(hint(anchors.where("is_rare").select("item_id", "term", "ipos", "need", "reach")), "term")
    stretch = F.floor(F.col("pos") / F.col("reach")).cast("int")
    near = rare.select("doc_id", "item_id", "ipos", "need", "reach", F.explode(F.array(stretch, stretch - 1)).alias("k")).where("k >= 0")
    near = near.groupBy("doc_id", "item_id", "need", "reach", "k", "ipos").agg(F.lit(1).alias("one")).groupBy("doc_id", "item_id", "need", "reach", "k").agg(F.count("*").alias("n"))
    near = near.where("n >= need").select("doc_id", "item_id", (F.col("k") * F.col("reach")).alias("start"), (2 * F.col("reach")).alias("size"))
    lines, near = materialize(lines, "lines"), materialize(near, "near")

    # the words of the documents met, beside those of the items
    found = lines.select("doc_id").unionByName(near.select("doc_id")).distinct()
    texts = docs.select(F.col(id_column).cast("bigint").alias("doc_id"), F.col(text_column).alias("text")).join(found, "doc_id", "left_semi")
    held = materialize(texts.select("doc_id", item_words(F.col("text")).alias("held")), "held")
    words = items.select("item_id", "words", "skip")
    # only the words that a passage around the anchor can reach are compared
    first = F.greatest(F.lit(0), F.col("ipos") - (run - 1), -F.col("start"))
    own = F.slice("words", first + 1, F.col("ipos") + run - first)
    laid = F.slice("held", F.col("start") + first + 1, F.col("ipos") + run - first)
    equal = F.array_join(F.zip_with(own, laid, lambda x, y: F.when(x == y, "1").otherwise("0")), "")
    at = F.col("start") + F.col("ipos")
    beside = (F.get("held", at + 2) == F.get("words", F.col("ipos") + 2)) | (F.get("held", at - 1) == F.get("words", F.col("ipos") - 1))
    tasks = 2 * parallelism(docs.sparkSession)  # rows are few and small, the work on each is not
    met = lines.repartition(tasks, "doc_id").join(held, "doc_id").join(hint(words), "item_id").where(beside)
    passages = met.where(equal.contains("1" * run)).select("doc_id", "item_id").distinct()
    body = F.slice("words", F.col("skip") + 1, F.size("words"))
    copies = near.repartition(tasks, "doc_id").join(held, "doc_id").join(hint(words), "item_id").select("doc_id", "item_id", body.alias("body"), F.slice("held", F.col("start") + 1, F.col("size")).alias("stretch"))
    wanted = F.array_distinct("body")
    lost = F.floor((1 - keep) * F.size("body") + 1e-9)
    copies = copies.where(F.size(F.array_intersect(wanted, F.col("stretch"))) >= F.size(wanted) - lost)
    copies = copies.mapInArrow(_verify(keep, slack), "doc_id bigint, item_id bigint")
    return passages.withColumn("how", F.lit("passage")).unionByName(copies.withColumn("how", F.lit("copy")))
