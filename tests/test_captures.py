"""Captures by byte ranges: any cut gives the whole; a growing file as a stream; files of many tasks."""

import random
import tempfile
import uuid
from collections import Counter

import pytest
from pyspark.sql import functions as F

from skytally.sinks import to_wire
from skytally.sources import read_capture_stream, read_captures, write_captures
from skytally.sources.captures import _files, parse_capture, read_range

STARTED = "2024-01-01 00:00:00"


def record(draw):
    body = bytes(draw.choices([0x1A, 0x32, 0x33, 0xE3, 0, 255], k=draw.choice((14, 21))))
    return b"\x1a" + (b"2" if len(body) == 14 else b"3") + body.replace(b"\x1a", b"\x1a\x1a"), body


def noisy(draw, n):
    """Whole records between junk, cut records, receiver identities and runs of escape bytes."""
    data, frames = bytearray(), []
    for _ in range(n):
        wire, body = record(draw)
        kind = draw.randrange(6)
        if kind == 0:
            data += bytes(draw.choices([0, 0x32, 0x99], k=draw.randrange(5)))
        elif kind == 1:
            cut = wire[: draw.randrange(2, len(wire) - 1)]
            data += cut + b"\x1a" * ((len(cut) - len(cut.rstrip(b"\x1a"))) % 2)
        elif kind == 2:
            data += b"\x1a\xe3" + bytes(8)
        elif kind == 3:
            data += b"\x1a\x1a" * draw.randrange(200)
        data += wire
        frames.append(body[7:].hex().upper())
    return bytes(data), frames


@pytest.mark.parametrize("seed", range(8))
def test_ranges_give_the_whole_file(seed):
    draw = random.Random(seed)
    data, frames = noisy(draw, 150)
    path = tempfile.mkdtemp(prefix="capture-") + "/a.bin"
    with open(path, "wb") as f:
        f.write(data)
    whole = list(parse_capture(data))
    assert Counter(frames) - Counter(r[1] for r in whole) == Counter()  # no record is lost beside noise
    for size in (1, 2, 7, 45, 333, len(data) // 10 + 1, len(data)):
        assert [r for at in range(0, len(data), size) for r in read_range(path, at, min(at + size, len(data)))] == whole


def test_random_bytes_by_ranges():
    draw = random.Random(5)
    for _ in range(30):
        data = bytes(draw.choices([0x1A, 0x32, 0x33, 0xE3, 7], [6, 1, 1, 1, 5], k=600))
        path = tempfile.mkdtemp(prefix="capture-") + "/a.bin"
        with open(path, "wb") as f:
            f.write(data)
        cuts = [0, *sorted(draw.sample(range(1, 600), 9)), 600]
        assert [r for a, b in zip(cuts, cuts[1:]) for r in read_range(path, a, b)] == list(parse_capture(data))


def test_ten_ranges_are_ten_tasks(spark):
    data, _ = noisy(random.Random(1), 400)
    folder = tempfile.mkdtemp(prefix="capture-")
    with open(f"{folder}/a.bin", "wb") as f:
        f.write(data)
    out = read_captures(spark, folder, STARTED, range_bytes=len(data) // 10 + 1)
    assert out.rdd.getNumPartitions() == 10
    assert [tuple(r) for r in out.orderBy("position").select("position", "frame", "ts12", "signal").collect()] == list(parse_capture(data))


def test_odd_folders(spark):
    folder = tempfile.mkdtemp(prefix="capture-")
    assert read_captures(spark, folder, STARTED).count() == 0
    for name in ("empty.bin", "_hidden.bin"):
        with open(f"{folder}/{name}", "wb") as f:
            f.write(b"" if name == "empty.bin" else b"\x1a2" + bytes(14))
    assert read_captures(spark, folder, STARTED).count() == 0
    assert [f[0] for f in _files(f"file:{folder}/e*.bin")] == [f"{folder}/empty.bin"]
    with pytest.raises(Exception, match="FileNotFoundError"):
        read_captures(spark, folder + "/none", STARTED).count()


def test_written_files_of_many_tasks(spark):
    rows = spark.range(3000).selectExpr(
        "if(id % 10 = 9, null, concat('r ', id % 3)) AS receiver", "lpad(hex(id * 1713371), if(id % 2 = 0, 14, 28), '1A') AS frame", "id * 26 AS ts12",
        "double(id % 250 + 1) AS signal").repartition(5)
    path = f"{tempfile.mkdtemp(prefix='capture-')}/new"
    write_captures(to_wire(rows), path, order=["ts12"])
    write_captures(to_wire(rows).limit(0), path)
    out = read_captures(spark, path, STARTED, range_bytes=1000)
    names = F.split("receiver", "-part-")[0]
    got = Counter((r[0], r[1], r[2]) for r in out.select(names, "frame", "ts12").collect())
    assert got == Counter((("unnamed" if r[0] is None else r[0].replace(" ", "_")), r[1], r[2]) for r in rows.select("receiver", "frame", "ts12").collect())
    assert out.select("receiver").distinct().count() == 20
    within = out.withColumn("ahead", F.expr("lag(ts12) OVER (PARTITION BY path ORDER BY position)"))
    assert within.where("ahead > ts12").count() == 0


def test_growing_file_as_a_stream(spark):
    data, _ = noisy(random.Random(3), 300)
    folder, base = tempfile.mkdtemp(prefix="capture-"), f"{tempfile.mkdtemp(prefix='stream-')}/{uuid.uuid4().hex}"

    def go():
        out = read_capture_stream(spark, folder, STARTED, range_bytes=500).select("receiver", "position", "frame", "ts12", "signal", "ts")
        run = out.writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start()
        run.awaitTermination()
        return spark.read.schema(out.schema).parquet(f"{base}/out")

    def append(name, part):
        with open(f"{folder}/{name}", "ab") as f:
            f.write(part)

    half = len(data) // 2
    append("a.bin", data)
    append("b.bin", data[:half])
    first = go().count()
    append("b.bin", data[half:half + 3])
    go()
    append("b.bin", data[half + 3:])
    append("c.bin", data)
    rows = go()
    want = list(parse_capture(data))
    assert first < rows.count() == 3 * len(want)
    for name in ("a.bin", "b.bin", "c.bin"):
        assert [tuple(r) for r in rows.where(F.col("receiver") == name).orderBy("position").select("position", "frame", "ts12", "signal").collect()] == want
    assert go().count() == 3 * len(want)  # nothing new
