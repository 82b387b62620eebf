import random

import pytest
from hypothesis import given
from hypothesis import strategies as st

from lavra.llm import packing


@given(st.integers(1, 60), st.integers(1, 6), st.lists(st.integers(1, 60), max_size=120))
def test_packer_is_bounded_best_fit(capacity, limit, sizes):
    packer, free, open_bins = packing.Packer(capacity, limit), {}, []
    for size in (s for s in sizes if s <= capacity):
        fits = [b for b in open_bins if free[b] >= size]
        got = packer.put(size)
        if fits:
            assert free[got] == min(free[b] for b in fits) and got in fits
        else:
            assert got not in free
            if len(open_bins) == limit:
                least = min(free[b] for b in open_bins)
                closed = [b for b in open_bins if free[b] == least]
                open_bins.remove(closed[-1] if len(closed) == 1 else next(b for b in closed if b not in [x for v in packer.by_free.values() for x in v]))
            free[got] = capacity
            open_bins.append(got)
        free[got] -= size
        if not free[got] and got in open_bins:
            open_bins.remove(got)
        assert packer.open == len(open_bins) <= limit


def check(rows, sizes, capacities):
    for spec, capacity in capacities.items():
        own = [r for r in rows if r.spec_id == spec]
        used, parts = {}, {}
        for r in own:
            used[r.container] = used.get(r.container, 0) + r.end_token - r.start_token
            parts.setdefault(r.doc_id, []).append((r.start_token, r.end_token, r.part, r.parts))
        assert max(used.values(), default=0) <= capacity
        assert set(parts) == {d for d, n in sizes.items() if n}
        for d, p in parts.items():
            p.sort()
            assert p[0][0] == 0 and p[-1][1] == sizes[d] and all(a[1] == b[0] for a, b in zip(p, p[1:]))
            assert len(p) == p[0][3] == -(-sizes[d] // capacity)


def test_pack_covers_every_token(spark):
    rng = random.Random(2)
    sizes = {i: rng.choice([0, 1, 5, 40, 99, 100, 101, 350]) for i in range(300)}
    counts = spark.createDataFrame(list(sizes.items()), "doc_id bigint, n_tokens bigint")
    specs = spark.createDataFrame([(1, 100, "x"), (2, 256, "x"), (3, None, "x"), (4, 0, "x")], "spec_id int, capacity_tokens int, lane string")
    rows = packing.pack(counts, specs, lane_items=70).collect()
    check(rows, sizes, {1: 100, 2: 256})
    assert packing.pack(counts.limit(0), specs).count() == 0 and packing.pack(counts, specs.limit(0)).count() == 0


def test_little_room_is_unused(spark, data):
    counts = packing.token_counts(spark.read.parquet(f"{data}/documents.parquet"))
    rng = random.Random(1)
    packer = packing.Packer(512)
    sizes = [rng.randint(1, 512) for _ in range(20_000)]
    for s in sizes:
        packer.put(s)
    assert packer.made * 512 / sum(sizes) < 1.05 and counts.count() > 0


def test_counts_equal_the_tokenizer(spark):
    texts = ["olá mundo", "", None, "<|endoftext|>", "a" * 200_000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    enc = packing.tokenizer(packing.TOKENIZER)
    assert {r.doc_id: r.n_tokens for r in packing.token_counts(df).collect()} == {i: len(enc.encode_ordinary(t)) for i, t in enumerate(texts) if t is not None}


@pytest.mark.parametrize("capacity", [512, 2048, 8192, 32768])
def test_little_room_stays_unused(capacity):
    rng = random.Random(capacity)
    packer, used = packing.Packer(capacity), 0
    for _ in range(50_000):
        size = min(capacity, int(rng.lognormvariate(5, 1)) + 1)
        packer.put(size)
        used += size
    assert 1 - used / (packer.made * capacity) < 0.02
