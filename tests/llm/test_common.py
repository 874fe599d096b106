import os
import random

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from fileloom.llm import common


def test_tables_go_when_they_are_dropped(spark):
    a, b = (common.materialize(spark.range(n), "test") for n in (3, 4))
    folder = a._fileloom_path.removeprefix("file:")
    assert os.path.isdir(folder) and a.count() == 3
    common.dropped(a)
    assert not os.path.isdir(folder) and b.count() == 4
    common.dropped(b)


def test_tables_are_written_without_files_of_checksums(spark):
    """Each file of checksums costs a process of its own, besides the file's."""
    own = common.materialize(spark.range(8).repartition(2), "test")
    names = os.listdir(own._fileloom_path.removeprefix("file:"))
    assert [n for n in names if n.endswith(".parquet")] and not [n for n in names if n.endswith(".crc")]
    assert sorted(r.id for r in own.collect()) == list(range(8))
    common.dropped(own)


class Session:
    """As much of a session as the choice of the shared folder asks."""

    def __init__(self, master, setting=None, own=None):
        self.conf, self.sparkContext, self.master, self.setting, self.own = self, self, master, setting, own

    def get(self, key, default=None):
        assert key == "spark.checkpoint.dir"
        return self.setting or default

    def getCheckpointDir(self):
        return self.own

    def setCheckpointDir(self, folder):
        self.own = folder


def test_no_machine_local_folder_on_a_cluster():
    """A session that is not local must say where its shared folder is; a local one gets a folder and keeps it."""
    for master in ("spark://host:7077", "yarn", "local-cluster[3,2,1000]"):
        with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
            common.shared_dir(Session(master))
        assert common.shared_dir(Session(master, "s3a://shared/folder")) == "s3a://shared/folder"
        assert common.shared_dir(Session(master, None, "hdfs://host/own")) == "hdfs://host/own"
    local = Session("local[4]")
    assert os.path.isdir(common.shared_dir(local)) and common.shared_dir(local) == local.own


def test_slice_hashes():
    """Equal slices have equal hashes wherever they stand, others differ; long ones are XXH64."""
    rng = random.Random(1)
    parts = [bytes(rng.choices(b"ab", k=rng.choice([0, 1, 7, 8, 9, 16, 40, 255, 256, 257, 900]))) for _ in range(2000)]
    data = b"x".join(parts)
    ends = np.cumsum([len(p) + 1 for p in parts]) - 1
    starts = ends - np.array([len(p) for p in parts])
    got = common.slice_hashes(np.frombuffer(data, np.uint8), starts, ends)
    seen = {}
    for p, h in zip(parts, got.tolist(), strict=True):
        assert seen.setdefault(p, h) == h
        assert len(p) <= common.LONG_SLICE or h == xxhash.xxh64_intdigest(p)
    assert len(set(seen.values())) == len(seen)
    assert len(common.slice_hashes(np.zeros(0, np.uint8), np.zeros(0, int), np.zeros(0, int))) == 0


def test_chunks_cover_all_rows():
    texts = ["a" * n for n in (0, 5, 3, 0, 20, 1)] + [None, "é"]
    for kind in (pa.string(), pa.large_string(), pa.string_view()):
        column = pa.array(["skipped", *texts], kind)[1:]
        got = [bytes(data[b:e]).decode() for _, _, data, offsets in common.chunks(column, 8) for b, e in zip(offsets[:-1], offsets[1:], strict=True)]
        assert got == [t or "" for t in texts]
