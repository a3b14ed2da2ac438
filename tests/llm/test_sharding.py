"""Virtual slots: balance, gapless places, edits of the map, odd rows."""

import zlib
from collections import defaultdict

from skytally.llm import queries, sharding
from skytally.llm.common import scratch_path


def check(rows, texts, slack):
    loads, slots = defaultdict(int), defaultdict(list)
    for r in rows:
        text = (texts[r["doc_id"]] or "").encode()
        assert r["size"] == len(text) + 1 and r["text_crc32"] == zlib.crc32(text)
        loads[r["shard"]] += r["size"]
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(loads.values()) - min(loads.get(k, 0) for k in range(8)) <= slack


def test_query(spark, folder):
    texts = {r["doc_id"]: r["text"] for r in queries.documents(spark, folder).collect()}
    rows = queries.op2_sharding(spark, folder).collect()
    assert len(rows) == len(texts) and {r["law"] for r in rows} == {"bytes"} and all(r["grown_shard"] is None for r in rows)
    check(rows, texts, slack=sum(r["size"] for r in rows) * 0.02)


def test_odd_rows(spark):
    rows = [(None, None), (None, "b"), (1, ""), (2, "é" * 50), (2, "é" * 50), (3, "x" * 100_000)]
    docs = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, shard int, size int")
    out = sharding.shard(docs).collect()
    assert sorted(r["size"] for r in out) == [1, 1, 2, 101, 101, 100_001]
    per = defaultdict(list)
    for r in out:
        per[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in per.values())
    assert sharding.shard(docs.limit(0)).collect() == []


def test_many_equal_rows(spark):
    """Half of all rows are one row, and a quarter have neither id nor text."""
    rows = [(7, "y" * 200)] * 2000 + [(i, "x" * (180 + i % 40)) for i in range(1000, 2000)] + [(None, None)] * 1000
    out = sharding.shard(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    loads, slots, per_slot = defaultdict(int), defaultdict(list), defaultdict(int)
    for r in out:
        loads[r["shard"]] += r["size"]
        slots[r["shard"]].append(r["slot"])
        per_slot[r["virtual_slot"]] += 1
    assert len(out) == 4000 and all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(loads.values()) - min(loads.get(k, 0) for k in range(8)) < 0.02 * sum(loads.values()) / 8
    assert max(r["size"] for r in out if r["doc_id"] == 7) == 201 and sum(r["doc_id"] == 7 for r in out) == 2000
    places = defaultdict(int)
    for r in out:
        places[r["virtual_slot"]] += r["doc_id"] == 7
    assert max(places.values()) < 20


def test_edits_move_only_what_they_must(spark, folder):
    sizes = sharding.slot_sizes(sharding.hashed(queries.documents(spark, folder), 512), 512).cache()
    path = scratch_path(spark, "map")
    first = sharding.save_map(sharding.first_map(spark, 8, 512), path, 1)
    second = sharding.save_map(sharding.rebalanced(sizes, first, 8), path, 2)
    third = sharding.save_map(sharding.grown(sizes, second, 8), path, 3)
    maps = [{r["virtual_slot"]: r["shard"] for r in sharding.read_map(spark, path, v).collect()} for v in (1, 2, 3)]
    assert all(sorted(m) == list(range(512)) for m in maps)
    assert all(new in (old, 8) for old, new in zip([maps[1][k] for k in range(512)], [maps[2][k] for k in range(512)], strict=True))
    weight = {r["virtual_slot"]: r["bytes"] for r in sizes.collect()}
    moved = sum(weight[k] for k in range(512) if maps[0][k] != maps[1][k])
    assert moved < 0.5 * sum(weight.values())
    total = defaultdict(int)
    for k, s in maps[2].items():
        total[s] += weight[k]
    assert set(total) == set(range(9)) and third.count() == 512
