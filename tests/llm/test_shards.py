"""Sharding: the three laws, whole rows, and a fair shuffle."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tidemark.llm import shards
from tidemark.session import scratch_dir

SCHEMA = "doc_id long, text string, shard string, bucket int, number long, `a.b` int"


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(8)
    out = [(None, None), (0, ""), (1, "é" * 9000)]
    out += [(i if i % 3 else None, "x" * rng.randint(0, 300)) for i in range(2, 900)]
    return out + [(7, "the same")] * 450


def table(spark, rows, parts=5):
    return spark.createDataFrame([(i, t, "s", 1, 2, 3) for i, t in rows], SCHEMA).coalesce(parts)


def written(spark, rows, **how):
    return shards.write_shards(table(spark, rows), scratch_dir(spark, "shards"), bucket_bytes=8000, **how)


@pytest.mark.parametrize("law", shards.LAWS)
def test_laws(spark, rows, law):
    df = written(spark, rows, law=law)
    assert df.columns == ["doc_id", "text", "shard", "bucket", "number", "a.b", "size", "law", "slot", "grown_shard"]
    got = df.collect()
    assert Counter((r["doc_id"], r["text"]) for r in got) == Counter(rows)
    assert all(r["size"] == len((r["text"] or "").encode()) + 1 and r["law"] == law and r["a.b"] == 3 for r in got)
    by = {}
    for r in got:
        by.setdefault(r["shard"], []).append(r)
    assert sorted(by) == list(range(8))
    assert all(sorted(r["slot"] for r in mine) == list(range(len(mine))) for mine in by.values())
    counts, sizes = [len(m) for m in by.values()], [sum(r["size"] for r in m) for m in by.values()]
    if law == "rows":
        assert max(counts) - min(counts) <= 1
    if law == "bytes":
        assert max(sizes) - min(sizes) < 2 * max(r["size"] for r in got)
    if law == "key":
        again = {(r["doc_id"], r["shard"], r["grown_shard"]) for r in got}
        assert len(again) == len({r["doc_id"] for r in got})
        assert all(g in (s, 8) for _, s, g in again) and 30 < sum(g == 8 for *_, g in again) < 110
        more = {(r["doc_id"], r["shard"]) for r in written(spark, rows, law="key", shards=9).collect()}
        assert more == {(i, g) for i, _, g in again}
    else:
        assert {r["grown_shard"] for r in got} == {None}


def test_shuffled_and_repeatable(spark, rows):
    one = [tuple(r) for r in written(spark, rows).orderBy("shard", "slot").collect()]
    assert one == [tuple(r) for r in written(spark, rows).orderBy("shard", "slot").collect()]
    assert one != [tuple(r) for r in written(spark, rows, seed=14).orderBy("shard", "slot").collect()]
    copies = Counter(r[2] for r in one if r[1] == "the same")
    assert len(copies) == 8 and max(copies.values()) < 90  # 56 a shard on average
    places = [k for k, r in enumerate(one) if r[1] == "the same"]
    assert sum(b == a + 1 for a, b in zip(places, places[1:])) < 220  # 150 by chance


def test_files_hold_slots_in_order(spark, rows):
    path = scratch_dir(spark, "shards")
    shards.write_shards(table(spark, rows), path, bucket_bytes=8000)
    read = spark.read.parquet(path).select("slot", F.input_file_name().alias("f"), F.monotonically_increasing_id().alias("k"))
    by = {}
    for r in sorted(read.collect(), key=lambda r: r["k"]):
        by.setdefault(r["f"], []).append(r["slot"])
    assert len(by) >= 8 and all(m == sorted(m) for m in by.values())


def test_fisher_yates_is_fair():
    assert Counter(tuple(shards.fisher_yates(3, (s,)).tolist()) for s in range(6000)).keys() == set(__import__("itertools").permutations(range(3)))
    counts = Counter(tuple(shards.fisher_yates(3, (s,)).tolist()) for s in range(6000))
    assert max(counts.values()) < 1150 and min(counts.values()) > 850
    assert shards.fisher_yates(0, (1,)).tolist() == [] and shards.fisher_yates(1, (1,)).tolist() == [0]


@pytest.mark.parametrize("law", shards.LAWS)
def test_few_rows(spark, law):
    assert written(spark, [], law=law).collect() == []
    got = written(spark, [(1, None), (1, None)], law=law).collect()
    assert [r["size"] for r in got] == [1, 1]


def test_unknown_law(spark):
    with pytest.raises(ValueError):
        written(spark, [], law="size")
