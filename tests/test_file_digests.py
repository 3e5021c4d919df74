"""Digests of files read line by line against hashlib."""

import bz2
import gzip
import hashlib
import os

import pytest
from pyspark.sql import functions as F

from lexgauge.sources.json_files import file_checksums, ingestion_log

MARK = b"\xef\xbb\xbf"
EVERY_BYTE = bytes(range(256))
FILES = {
    "ended.txt": b"a\r\nb\r\r\n\n",
    "open.txt": b"a\r\nb\r\r\n\nc",
    "ends.txt": b"\n\n\n\n",
    "mark.txt": MARK,
    "marks.txt": MARK + MARK,
    "marked.txt": MARK + b"abc\n",
    "marked_open.txt": MARK + b"\n" + MARK + b"\nab",
    "mark_inside.txt": b"\nabc" + MARK,
    "one_line.json": b'{"agencies":[{"name":"a"},{"name":"b"}]}',
    "commas.json": MARK + b"1\n,2,,",
    "every_byte.parquet": EVERY_BYTE * 60_000,
    "packed.json.gz": gzip.compress(EVERY_BYTE * 50),
    "packed.bz2": bz2.compress(EVERY_BYTE * 50),
    "not_packed.snappy": b"x\ny" * 9,
    "no_extension": b"1\n2\n3",
    "two words.t x t": b"1\n2\n3",
    "two words.txt": b"1\n2\n3",
}


@pytest.fixture
def folder(tmp_path):
    for name, data in FILES.items():
        (tmp_path / name).write_bytes(data)
    return tmp_path


@pytest.mark.parametrize("whole_bytes", [0, 10, 1 << 20])
def test_digests(spark, folder, whole_bytes):
    rows = file_checksums(spark, str(folder), whole_bytes=whole_bytes).collect()
    assert sorted((r.file_bytes, r.file_checksum) for r in rows) == sorted(
        (len(data), hashlib.sha256(data).hexdigest()) for data in FILES.values()
    )
    before = file_checksums(spark, str(folder), whole_bytes=1 << 40).collect()
    assert sorted(rows) == sorted(before)


def test_paths_that_overlap(spark, folder):
    paths = [str(folder), str(folder / "ended.txt")]
    rows = [r for r in file_checksums(spark, paths, whole_bytes=0).collect() if r.source_file == "ended.txt"]
    assert [r.file_checksum for r in rows] == [hashlib.sha256(FILES["ended.txt"]).hexdigest()] * 2


@pytest.fixture
def large(spark, tmp_path):
    """Files over the reader's limit, which stands for the memory of a task."""
    data = {f"{n}.parquet": os.urandom((17 + n) << 20) + b"\n" * n for n in range(3)} | {"small.parquet": b"1"}
    for name, content in data.items():
        (tmp_path / name).write_bytes(content)
    limit = "spark.sql.sources.binaryFile.maxLength"
    spark.conf.set(limit, 16 << 20)
    yield str(tmp_path), {name: hashlib.sha256(content).hexdigest() for name, content in data.items()}
    spark.conf.unset(limit)


def test_files_larger_than_a_value(spark, large):
    folder, digests = large
    rows = file_checksums(spark, folder, "*.parquet").collect()
    assert sorted((r.source_file, r.file_checksum) for r in rows) == sorted(digests.items())


def test_log_of_large_files(spark, large):
    folder, digests = large
    files = file_checksums(spark, folder, "*.parquet")
    counts = files.select("file_path", F.lit(7).cast("bigint").alias("record_count"))
    rows = ingestion_log(counts, files).collect()
    assert sorted(map(tuple, rows)) == sorted((name, 7, digest, "success") for name, digest in digests.items())


def test_lines_that_miss_bytes(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes(b"one\ntwo\nthree\n")
    files = file_checksums(spark, str(tmp_path), whole_bytes=0)
    files.collect()
    (tmp_path / "a.txt").write_bytes(b"one\n")
    with pytest.raises(Exception, match="3 of 14 bytes"):
        files.collect()
