import os

from fileloom.plans import batch
from fileloom.sources import files
from fileloom.streaming import drop_folder


def fill(folder):
    os.makedirs(folder / "deep", exist_ok=True)
    (folder / "a.csv").write_text("x\n1\n")
    (folder / "b.Md").write_text("# T")
    (folder / "deep" / "c.html").write_text("<p>x</p>")
    (folder / "d.bin").write_bytes(b"\0\1")


def test_scan_and_save(spark, tmp_path):
    fill(tmp_path / "in")
    rows = files.scan(spark, str(tmp_path / "in"))
    assert sorted(r.name for r in rows.collect()) == ["a.csv", "b.Md", "c.html"]
    assert "content:binary" not in rows.select("name")._jdf.queryExecution().executedPlan().toString().split("ReadSchema")[1]
    assert files.scan(spark, str(tmp_path / "in"), any_format=True).count() == 4
    done = batch.convert_all(batch.ingest(rows))
    for folder in (str(tmp_path / "plain"), f"file://{tmp_path}/uri"):
        assert files.save(done, folder) == files.save(done, folder) == 3
    for folder in ("plain", "uri"):
        names = sorted(n.split("-", 1)[1] for n in os.listdir(tmp_path / folder))
        assert names == ["a.json", "b.html", "c.md"]


def test_large_files_are_error_rows(spark, tmp_path, monkeypatch):
    fill(tmp_path / "in")
    monkeypatch.setattr(files, "MAX_FILE_BYTES", 5)
    rows = files.scan(spark, str(tmp_path / "in"))
    assert {r.name: (r.content is None, r.error) for r in rows.collect()} == {"a.csv": (False, None), "b.Md": (False, None), "c.html": (True, "File too large: 8 bytes")}
    done = batch.convert_all(batch.ingest(rows))
    assert {r.name: (r.status, r.size) for r in done.collect()} == {"a.csv": ("done", 4), "b.Md": ("done", 3), "c.html": ("error", 8)}
    assert batch.summary(done).first().all_done


def test_stores_that_hadoop_names_otherwise():
    assert files.arrow_uri("s3a://bucket/out") == "s3://bucket/out"
    assert files.arrow_uri("abfss://c@account/out") == "abfs://c@account/out"
    assert [files.arrow_uri(x) for x in ("hdfs://host/out", "file:///out", "/out")] == ["hdfs://host/out", "file:///out", "/out"]


def test_pack_converts_once(spark, tmp_path):
    """The sum of the sizes and the packing read the same outputs: a conversion leaves one mark for each file."""
    from pyspark.sql import functions as F

    marks = str(tmp_path)

    @F.udf("binary")
    def marked(name):
        import uuid

        open(f"{marks}/{uuid.uuid4().hex}", "w").close()
        return name.encode()

    rows = spark.range(20).select("id", F.lit("done").alias("status"), F.lit("txt").alias("target"), F.concat(F.lit("f"), "id").alias("name"), marked(F.col("id").cast("string")).alias("output"))
    assert sum(r.n_entries for r in batch.pack(rows, "zip").collect()) == 20
    assert len(os.listdir(tmp_path)) == 20


def test_drop_folder(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for n in range(5):
        (tmp_path / "in" / f"{n}.csv").write_text(f"x\n{n}\n")
    (tmp_path / "in" / "bad.png").write_text("no")

    def run():
        q = drop_folder.convert_arrivals(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "check"), available_now=True)
        q.awaitTermination(120)
        return spark.read.parquet(str(tmp_path / "out"))

    assert {r.status: r["count"] for r in run().groupBy("status").count().collect()} == {"done": 5, "error": 1}
    (tmp_path / "in" / "late.csv").write_text("x\n9\n")
    rows = run()
    assert rows.count() == 7 and rows.select("id").distinct().count() == 7
