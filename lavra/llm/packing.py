"""Problem 6: documents, measured in tokens, go into containers of fixed capacity.

Bounded-space online best fit: a packer keeps at most `open_bins` containers open, as a bitset keyed by free space. An
item goes to the open container that it fills best, the lowest set bit at or above its size; if none has room a new
container opens, and where that is one too many the fullest open one closes first.

Items are dealt to lanes by hash, about LANE_ITEMS to a lane, and each lane is packed by its own packer as a stream, so
no task holds more than its open containers; a lane leaves at most `open_bins` containers part-filled.

Defined results: a text longer than the capacity is cut into full containers and one rest, which is packed like an item;
no other text is cut. Null and empty texts have no tokens and yield no rows. Repeated documents are packed each.
Capacities below one and null capacities are left out.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lavra.session import spread

TOKENIZER = os.environ.get("LAVRA_TOKENIZER", "/opt/tokenizers/byte_bpe_multi_50k.tiktoken")
#: Fixed value: the public splitting pattern of byte-level BPE vocabularies.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
OPEN_BINS = 64
LANE_ITEMS = 50_000
SCHEMA = "spec_id int, capacity int, container string, doc_id bigint, part int, parts int, start_token bigint, end_token bigint"
_ARROW = pa.schema([("spec_id", pa.int32()), ("capacity", pa.int32()), ("container", pa.string()), ("doc_id", pa.int64()), ("part", pa.int32()), ("parts", pa.int32()), ("start_token", pa.int64()), ("end_token", pa.int64())])


@lru_cache(maxsize=2)
def tokenizer(path: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("lavra", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_counts(docs: DataFrame, path: str = TOKENIZER, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, n_tokens) of every document whose text is not null, whole texts, no shuffle."""

    docs.sparkSession.sparkContext.addFile(path)  # the vocabulary goes with the job; executors need no file of their own

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = tokenizer(SparkFiles.get(os.path.basename(path))).encode_ordinary
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(encode(t)) for t in batch.column(1).to_pylist()], pa.int64())], ["doc_id", "n_tokens"])

    narrow = docs.where(F.col(text_column).isNotNull()).select(F.col(id_column).cast("bigint").alias("doc_id"), F.col(text_column).alias("text"))
    return spread(narrow).mapInArrow(count, "doc_id bigint, n_tokens bigint")


class Packer:
    """Bounded-space best fit for one capacity."""

    def __init__(self, capacity: int, open_bins: int = OPEN_BINS):
        self.capacity, self.limit, self.bits, self.made, self.open = capacity, open_bins, 0, 0, 0
        self.by_free: dict[int, list[int]] = {}

    def _take(self, free: int) -> int:
        bins = self.by_free[free]
        name = bins.pop()
        if not bins:
            del self.by_free[free]
            self.bits &= ~(1 << free)
        self.open -= 1
        return name

    def put(self, size: int) -> int:
        """Number of the container that the item goes to; 0 < size <= capacity."""
        fitting = self.bits >> size
        if fitting:
            free = size + (fitting & -fitting).bit_length() - 1
            name = self._take(free)
        else:
            if self.open >= self.limit:
                self._take((self.bits & -self.bits).bit_length() - 1)
            free, name = self.capacity, self.made
            self.made += 1
        left = free - size
        if left:
            self.by_free.setdefault(left, []).append(name)
            self.bits |= 1 << left
            self.open += 1
        return name


def _pack(open_bins: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lane, packer, full = None, None, 0
        for batch in batches:
            rows: list[tuple] = []
            for spec, capacity, number, doc, size in zip(*(c.to_pylist() for c in batch.columns)):
                if (spec, number) != lane:
                    lane, packer, full = (spec, number), Packer(capacity, open_bins), 0
                whole, rest = divmod(size, capacity)
                parts = whole + (rest > 0)
                for k in range(whole):
                    rows.append((spec, capacity, f"{number}-f{full}", doc, k, parts, k * capacity, (k + 1) * capacity))
                    full += 1
                if rest:
                    rows.append((spec, capacity, f"{number}-{packer.put(rest)}", doc, whole, parts, whole * capacity, size))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows), _ARROW)], schema=_ARROW)

    return run


def pack(counts: DataFrame, specs: DataFrame, open_bins: int = OPEN_BINS, lane_items: int = LANE_ITEMS) -> DataFrame:
    """One row for each part of each document and capacity: its container and token range.

    counts: doc_id, n_tokens. specs: spec_id, capacity_tokens, a short list of container kinds.
    """
    kinds = [(r[0], r[1]) for r in specs.where("capacity_tokens > 0").select("spec_id", "capacity_tokens").distinct().orderBy("spec_id").collect()]
    kind = F.array(*[F.struct(F.lit(s).cast("int").alias("spec_id"), F.lit(c).cast("int").alias("capacity")) for s, c in kinds])
    if not kinds:
        kind = kind.cast("array<struct<spec_id:int,capacity:int>>")
    sized = counts.where("n_tokens > 0")
    lanes = max(1, -(-sized.count() // lane_items))
    dealt = sized.select(F.inline(kind), F.pmod(F.xxhash64("doc_id"), F.lit(lanes)).cast("int").alias("lane"), "doc_id", "n_tokens")
    ordered = dealt.repartition(max(1, lanes * len(kinds)), "spec_id", "lane").sortWithinPartitions("spec_id", "lane", "doc_id")
    return ordered.select("spec_id", "capacity", "lane", "doc_id", "n_tokens").mapInArrow(_pack(open_bins), SCHEMA)


def fill(packed: DataFrame) -> DataFrame:
    """Containers, tokens and share of unused room by capacity."""
    each = packed.groupBy("spec_id", "capacity", "container").agg(F.sum(F.col("end_token") - F.col("start_token")).alias("used"))
    return each.groupBy("spec_id", "capacity").agg(
        F.count("*").alias("containers"), F.sum("used").alias("tokens"), F.max("used").alias("fullest"), F.round(1 - F.sum("used") / F.sum("capacity"), 6).alias("unused_share")
    )
