"""Landing folders by content: what is read, extracted and deleted."""

import hashlib
import os

from pyspark.sql import functions as F

from lectern.plans import lake
from lectern.sources import changes
from lectern.sources.landing import landing_reader



def files_of(spark, folder):
    return landing_reader(spark.read, str(folder)).select("path", "modificationTime", "length", "content")


def put(folder, name, text, time=None):
    (folder / name).write_text(text)
    if time:
        os.utime(folder / name, (time, time))


def kinds(df):
    return {(r.path.rsplit("/", 1)[1], r.kind, r.was and r.was.rsplit("/", 1)[1]) for r in df.collect()}


def test_kinds_of_changes(spark, tmp_path):
    nothing = spark.createDataFrame([], changes.MANIFEST)
    for name in "abcde":
        put(tmp_path, f"{name}.pptx", f"text {name}", 1_700_000_000)
    put(tmp_path, "same.pptx", "text a", 1_700_000_000)
    first = changes.current_files(files_of(spark, tmp_path), nothing).cache()
    assert {r.sha256 for r in first.collect()} == {hashlib.sha256(f"text {n}".encode()).hexdigest() for n in "abcde"}
    assert kinds(changes.scan_changes(first, nothing)) == {(f"{n}.pptx", "added", None) for n in (*"abcde", "same")}
    assert changes.scan_changes(changes.current_files(files_of(spark, tmp_path), first), first).isEmpty()

    os.utime(tmp_path / "a.pptx")  # touched, not changed
    put(tmp_path, "b.pptx", "other")
    (tmp_path / "c.pptx").rename(tmp_path / "z.pptx")
    (tmp_path / "d.pptx").unlink()
    put(tmp_path, "copy.pptx", "text e")
    now = changes.current_files(files_of(spark, tmp_path), first).cache()
    got = changes.scan_changes(now, first)
    assert kinds(got) == {("b.pptx", "changed", None), ("z.pptx", "renamed", "c.pptx"), ("d.pptx", "vanished", None), ("copy.pptx", "added", None)}
    extracted = spark.createDataFrame([(hashlib.sha256(b"text e").hexdigest(),)], "sha256 string")
    assert [r.path.rsplit("/", 1)[1] for r in changes.contents_to_extract(got, extracted).collect()] == ["b.pptx"]


def test_untouched_files_keep_their_hash_unread(spark, tmp_path):
    put(tmp_path, "a.pptx", "text", 1_700_000_000)
    row = files_of(spark, tmp_path).select("path", "length", F.col("modificationTime").alias("modified"), F.lit("known").alias("sha256"))
    assert changes.current_files(files_of(spark, tmp_path), row).first().sha256 == "known"


def test_ingestion_follows_the_folder(spark, tmp_path):
    folder, root = tmp_path / "landing", str(tmp_path / "lake")
    folder.mkdir()
    text = "Loops repeat their body until the condition no longer holds, says chapter {}."
    for n in range(4):
        put(folder, f"p_s_{n}.pptx", text.format(n))
    run = lambda: lake.ingest_changes(spark, files_of(spark, folder), root, {"pptx": lambda content: [content.decode()]})

    def indexed():
        rows = lake.read_index(spark, f"{root}/index").filter("length(document) > 0").collect()
        return {(r.path.rsplit("/", 1)[1], r.document.split("chapter ")[1][0]) for r in rows}

    assert run() == {"added": 4} and indexed() == {(f"p_s_{n}.pptx", str(n)) for n in range(4)}
    loads = len(os.listdir(f"{root}/index/increments"))
    assert run() == {} and len(os.listdir(f"{root}/index/increments")) == loads  # nothing new is no work

    (folder / "p_s_0.pptx").rename(folder / "q_s_0.pptx")
    (folder / "p_s_1.pptx").unlink()
    put(folder, "p_s_2.pptx", text.format(7))
    assert run() == {"renamed": 1, "vanished": 1, "changed": 1}
    assert indexed() == {("q_s_0.pptx", "0"), ("p_s_2.pptx", "7"), ("p_s_3.pptx", "3")}
    assert spark.read.parquet(f"{root}/texts").count() == 5  # the renamed file was not extracted again

    put(folder, "p_s_2.pptx", text.format(2))  # a content that was there before
    assert run() == {"changed": 1} and ("p_s_2.pptx", "2") in indexed()
    assert spark.read.parquet(f"{root}/texts").count() == 5
