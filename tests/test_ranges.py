"""Byte ranges: files cut anywhere, pruned columns and pushed conditions, containers read by offsets."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.sources import containers, generators, ranges


@pytest.fixture
def split(spark):
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(64 << 10))
    yield
    spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_a_file_without_newlines_is_cut_into_many_partitions(spark, split, tmp_path):
    data = np.random.default_rng(0).integers(11, 256, 3_000_001, np.uint8)  # no byte 0x0A
    data.tofile(tmp_path / "one.bin")
    (tmp_path / "empty.bin").write_bytes(b"")
    (tmp_path / "small.bin").write_bytes(b"abc")
    (tmp_path / "_hidden").write_bytes(b"x")
    blocks = ranges.read_ranges(spark, f"file://{tmp_path}", block=16 << 10)
    assert blocks.rdd.getNumPartitions() >= 3_000_001 // (64 << 10)
    rows = sorted(blocks.collect(), key=lambda r: (r["file"], r["start"]))
    assert b"".join(r["content"] for r in rows if r["file"].endswith("one.bin")) == data.tobytes()
    assert [(r["start"], r["length"], bytes(r["content"])) for r in rows if r["file"].endswith("small.bin")] == [(0, 3, b"abc")]
    assert {r["file"].rsplit("/", 1)[1] for r in rows} == {"one.bin", "small.bin"}
    assert max(r["length"] for r in rows) == 16 << 10
    with pytest.raises(Exception, match="FileNotFound"):
        ranges.read_ranges(spark, f"{tmp_path}/none").collect()


def test_conditions_choose_what_is_scheduled(spark, split, tmp_path):
    (tmp_path / "a.bin").write_bytes(bytes(500_000))
    (tmp_path / "b.bin").write_bytes(bytes(500_000))
    some = ranges.read_ranges(spark, str(tmp_path), block=32 << 10).where(F.col("file").endswith("b.bin") & (F.col("start") >= 400_000))
    assert "content" not in some.select("start").schema.names and some.rdd.getNumPartitions() <= 3
    assert sorted(r["start"] for r in some.collect()) == [s for s in range(0, 500_000, 32 << 10) if s >= 400_000]
    planned = ranges.RangeReader(some.schema, {"path": str(tmp_path), "bytes": 64 << 10, "block": 32 << 10})
    assert sum(len(p.parts) for p in planned.partitions()) == 16


def test_without_content_nothing_is_opened(spark, tmp_path):
    (tmp_path / "a.bin").write_bytes(b"12345")
    got = ranges.read_ranges(spark, str(tmp_path), columns="file string, size long").collect()
    assert [(r["file"].rsplit("/", 1)[1], r["size"]) for r in got] == [("a.bin", 5)]


def test_ranged_file_reads_what_is_asked(tmp_path):
    data = bytes(range(256)) * 4000
    (tmp_path / "f").write_bytes(data)
    file = ranges.RangedFile(str(tmp_path / "f"), window=1000)
    assert file[5:9] == data[5:9] and file[900:1000] == data[900:1000] and file.bytes_read == 1000
    assert len(file) == len(data) and file[len(data) - 3 : len(data) + 10] == data[-3:] and file[7] == 7 and file[10:5] == b""
    part = file.part(300, 5000)
    assert part[0:10] == data[300:310] and len(part) == 4700 and part[4690:9999] == data[4990:5000]
    assert ranges.sha256(part) == ranges.sha256(data[300:5000])


def test_containers_by_range_equal_whole_ones(spark, tmp_path):
    rng = np.random.default_rng(1)
    kept = {}
    for i in range(6):
        pages = [bytes(rng.integers(0, 256, int(rng.integers(0, 3000)), np.uint8)) for _ in range(40)]
        kept[f"{i}"] = generators.container(pages)
    kept["cut"] = kept["0"][:700]
    kept["short"] = kept["1"][:-100]
    kept["other"] = b"no container at all"
    for name, data in kept.items():
        (tmp_path / name).write_bytes(data)
    whole = containers.read_pages(spark.createDataFrame([(k, bytearray(v)) for k, v in kept.items()], "source string, content binary"))
    by_range = containers.read_pages_by_range(spark, str(tmp_path), range_bytes=8 << 10)
    rows = lambda df, name: sorted(repr([r[c] if c != "source" else name(r[c]) for c in df.columns]) for r in df.collect())
    assert rows(whole, str) == rows(by_range.select(*whole.columns), lambda s: s.rsplit("/", 1)[1])


def test_a_large_container_is_read_in_parts(tmp_path):
    """The reader of one page reads the index and that page, not the file."""
    pages = [bytes(1 << 20) for _ in range(40)]
    (tmp_path / "large").write_bytes(generators.container(pages))
    file = ranges.RangedFile(str(tmp_path / "large"))
    family, at, rows = containers.page_index(file)
    page = containers._page(file, family, at, rows.nbytes, rows[17], 17, containers.Limits())
    assert page["text_sha256"] == ranges.sha256(pages[17]) and file.bytes_read <= 200 << 10
