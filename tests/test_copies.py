"""Copies by ranges, compared."""

import os

import pytest

from lumaframe.sinks import copies


def test_files_and_folders(spark, tmp_path):
    data = os.urandom(1_000_001)
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "b").mkdir()
    (tmp_path / "a" / "x.bin").write_bytes(data)
    (tmp_path / "a" / "b" / "empty").write_bytes(b"")
    assert copies.plan(spark, str(tmp_path / "a"), str(tmp_path / "t"), 300_000).count() == 5
    (tmp_path / "t").mkdir()
    (tmp_path / "t" / "x.bin").write_bytes(data * 2)  # longer, and to be overwritten
    assert copies.copy(spark, str(tmp_path / "a"), str(tmp_path / "t"), 300_000) == len(data)
    assert (tmp_path / "t" / "x.bin").read_bytes() == data and (tmp_path / "t" / "b" / "empty").read_bytes() == b""
    assert copies.copy(spark, str(tmp_path / "a" / "x.bin"), str(tmp_path / "y.bin")) == len(data)
    with pytest.raises(FileNotFoundError):
        copies.copy(spark, str(tmp_path / "none"), str(tmp_path / "z"))


def test_broken_range_is_found_and_copied_again(spark, tmp_path):
    data = os.urandom(1_000_000)
    (tmp_path / "x").write_bytes(data)
    done = copies.put(copies.plan(spark, str(tmp_path / "x"), str(tmp_path / "y"), 100_000)).persist()
    assert done.count() == 10 and copies.broken(done).count() == 0
    with open(tmp_path / "y.part", "r+b") as file:
        file.seek(345_678)
        file.write(bytes([data[345_678] ^ 1]))
    (bad,) = copies.broken(done).collect()
    assert (bad.offset, bad.size, bad.problem) == (300_000, 100_000, "other bytes")
    before = os.stat(tmp_path / "y.part").st_mtime_ns
    again = copies.put(copies.broken(done))
    assert again.count() == 1 and copies.broken(again).count() == 0 and os.stat(tmp_path / "y.part").st_mtime_ns > before
    assert (tmp_path / "y.part").read_bytes() == data


def test_tries_end(spark, tmp_path):
    (tmp_path / "x").write_bytes(b"12345")
    (tmp_path / "file").write_bytes(b"")
    waits = []
    with pytest.raises(OSError, match="could not be copied"):
        copies.copy(spark, str(tmp_path / "x"), str(tmp_path / "file" / "below"), tries=3, wait=lambda n: waits.append(n) or 0.0)
    assert waits == [1, 2]
