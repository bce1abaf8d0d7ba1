import datetime as dt
import io
import os
import zipfile

import pytest
from pyspark.sql import functions as F

from checks.ingest import presentation
from lectern.config import Settings
from lectern.plans import lake
from lectern.schemas import CHUNK_INDEX, GOLD, GOLD_WITH_TEXT, conform
from lectern.sources import landing, layers
from lectern.sources.landing import pptx_slides
from lectern.sources.upsert import newest_per_key, replace_documents, upsert
from lectern.streaming.landing import watch_landing

LINE = "Une boucle répète le corps tant que la condition est vraie et que les données sont là."


def deck(lines):
    return presentation([[line] for line in lines])


@pytest.fixture
def landing_dir(tmp_path):
    root = tmp_path / "landing"
    (root / "sub").mkdir(parents=True)
    (root / "Smith_Python_Ch1.pptx").write_bytes(deck([LINE, "", "Fin & <suite> du cours."]))
    (root / "sub" / "Doe_Maths_Ch2.PPTX").write_bytes(deck([LINE]))
    (root / "sub" / "broken.pptx").write_bytes(b"not a package")
    (root / "notes.txt").write_text("ignored")
    return str(root)


def test_scan_lists_accepted_files_only(spark, landing_dir, tmp_path):
    rows = landing.scan_landing(spark, landing_dir).collect()
    assert sorted(r["filename"] for r in rows) == ["Doe_Maths_Ch2.PPTX", "Smith_Python_Ch1.pptx", "broken.pptx"]
    (tmp_path / "empty").mkdir()
    assert landing.scan_landing(spark, str(tmp_path / "empty")).count() == 0


def test_extraction(spark, landing_dir):
    rows = {r["filename"]: r for r in landing.extract_documents(landing.read_landing(spark, landing_dir)).collect()}
    assert rows["Smith_Python_Ch1.pptx"]["raw_text"] == f"[Slide 1]\n{LINE}\n\n[Slide 3]\nFin & <suite> du cours."
    assert rows["Smith_Python_Ch1.pptx"]["error"] is None
    assert rows["broken.pptx"]["raw_text"].startswith("[PPTX extraction failed: BadZipFile")
    assert rows["broken.pptx"]["error"].startswith("BadZipFile")


def test_extractors_plug_in(spark):
    files = spark.createDataFrame(
        [("d/a.pdf", bytearray(b"one\x0cbad\x0c  two   words ")), ("d/b.odt", bytearray(b"x"))],
        "path string, content binary",
    )

    def pages(content):
        return [None if p == "bad" else p for p in content.decode().split("\x0c")]

    rows = {r["path"]: r["raw_text"] for r in landing.extract_documents(files, {"pdf": pages}).collect()}
    assert rows == {"d/a.pdf": "[Page 1]\none\n\n[Page 3]\ntwo words", "d/b.odt": ""}


def test_pipeline_and_index(spark, landing_dir, tmp_path):
    root, index = str(tmp_path / "lake"), str(tmp_path / "index")
    counts = lake.run_pipeline(spark, landing_dir, root, settings=Settings(chunk_size=60, chunk_overlap=10))
    assert counts["documents"] == 3 and counts["failed_documents"] == 1
    gold = layers.read_layer(spark, f"{root}/gold", GOLD)
    assert counts["chunks"] == counts["embedded_chunks"] == gold.count() > 2
    assert gold.filter("filename = 'broken.pptx'").count() == 0
    row = gold.filter("filename = 'Doe_Maths_Ch2.PPTX'").first()
    assert (row["professor"], row["subject"], row["chapter"], row["language"], row["doc_type"]) == (
        "Doe", "Maths", "Ch2", "fr", "pptx",
    )
    first = lake.index_load(spark, f"{root}/gold", index)
    again = lake.index_load(spark, f"{root}/gold", index)
    ids = [sorted(r["chunk_id"] for r in t.select("chunk_id").collect()) for t in (first, again)]
    assert ids[0] == ids[1] and len(ids[0]) == counts["chunks"]
    assert layers.newest_version(spark, index) is None  # loads are increments until they are folded
    assert sorted(r["chunk_id"] for r in lake.compact_index(spark, index).collect()) == ids[0]
    assert layers.newest_version(spark, index).seq == 0 and lake.compact_index(spark, index).count() == len(ids[0])
    assert first.select("metadata.subject").distinct().count() == 2


def test_gold_can_repeat_the_text(spark, landing_dir, tmp_path):
    lake.run_pipeline(spark, landing_dir, str(tmp_path), keep_text=True)
    gold = layers.read_layer(spark, f"{tmp_path}/gold", GOLD_WITH_TEXT)
    assert gold.filter(F.col("raw_text").contains(LINE)).count() == gold.count() > 0


def test_empty_landing_is_a_no_op(spark, tmp_path):
    (tmp_path / "landing").mkdir()
    counts = lake.run_pipeline(spark, str(tmp_path / "landing"), str(tmp_path / "lake"))
    assert set(counts.values()) == {0} and not os.path.exists(tmp_path / "lake")


def index_rows(spark, rows):
    df = spark.createDataFrame(rows, "chunk_id long, path string, document string, load_ts timestamp")
    return conform(df, CHUNK_INDEX)


def plain(df):
    return sorted((r["chunk_id"], r["document"]) for r in df.collect())


def test_upsert(spark):
    t = [dt.datetime(2024, 1, d) for d in (1, 2, 3)]
    old = index_rows(spark, [(1, "a", "x", t[0]), (2, "a", "y", t[0]), (3, "b", "z", t[0])])
    new = index_rows(spark, [(1, "a", "x2", t[1]), (1, "a", "x3", t[2]), (4, "c", "n", t[1])])
    merged = upsert(old, new, ["chunk_id"])
    assert plain(merged) == [(1, "x3"), (2, "y"), (3, "z"), (4, "n")]
    assert plain(upsert(merged, new, ["chunk_id"])) == plain(merged)
    assert plain(upsert(old, new, ["chunk_id"], broadcast_rows=0)) == plain(merged)
    assert plain(replace_documents(old, new, broadcast_rows=0)) == plain(replace_documents(old, new))
    assert plain(replace_documents(old, new)) == [(1, "x3"), (3, "z"), (4, "n")]


def test_increments_are_merged_on_read_and_compacted(spark, tmp_path):
    path, t = str(tmp_path / "index"), dt.datetime(2024, 1, 1)
    assert lake.read_index(spark, path).count() == 0
    marks = [lake.index_mark(spark, path)]
    layers.publish(index_rows(spark, [(1, "a", "old", t), (2, "a", "gone", t), (3, "b", "kept", t)]), path)
    layers.write_increment(index_rows(spark, [(1, "a", "one", t)]), path, 0)
    layers.write_increment(index_rows(spark, [(1, "a", "two", t), (9, "c", "new", t)]), path, 1)
    want = [(1, "two"), (3, "kept"), (9, "new")]
    assert plain(lake.read_index(spark, path)) == want
    assert plain(lake.compact_index(spark, path)) == want
    assert plain(lake.read_index(spark, path)) == want
    layers.write_increment(index_rows(spark, [(3, "b", "newer", t)]), path, 2)
    assert plain(lake.read_index(spark, path)) == [(1, "two"), (3, "newer"), (9, "new")]
    marks.append(lake.index_mark(spark, path))
    lake.compact_index(spark, path)
    marks.append(lake.index_mark(spark, path))
    assert len(set(marks)) == 3


def test_newest_load_of_a_document_wins(spark, tmp_path):
    path, t = str(tmp_path / "index"), dt.datetime(2024, 1, 1)
    hour = dt.timedelta(hours=1)
    layers.write_increment(index_rows(spark, [(1, "a", "streamed", t + hour), (2, "a", "streamed too", t + hour)]), path, 0)
    layers.write_increment(index_rows(spark, [(1, "a", "later", t + 2 * hour)]), path, 0, source="load-x")
    layers.write_increment(index_rows(spark, [(1, "a", "late arrival", t)]), path, 0, source="load-y")
    assert plain(lake.read_index(spark, path)) == [(1, "later")]
    assert plain(lake.compact_index(spark, path)) == [(1, "later")]
    layers.write_increment(index_rows(spark, [(1, "a", "older", t)]), path, 1)
    assert plain(lake.read_index(spark, path)) == [(1, "later")]
    two = index_rows(spark, [(5, "b", "v1", t), (6, "b", "v1", t), (5, "b", "v2", t + hour)])
    layers.write_increment(two, path, 2)
    assert plain(lake.read_index(spark, path)) == [(1, "later"), (5, "v2")]


def test_watch_landing(spark, landing_dir, tmp_path):
    root, state = str(tmp_path / "live"), str(tmp_path / "state")

    def poll():
        watch_landing(spark, landing_dir, root, state).awaitTermination()
        return lake.read_index(spark, f"{root}/index")

    first = poll()
    assert sorted({r["path"].rsplit("/", 1)[1] for r in first.collect()}) == ["Doe_Maths_Ch2.PPTX", "Smith_Python_Ch1.pptx"]
    assert poll().count() == first.count()  # nothing new, nothing done
    with open(f"{landing_dir}/Roe_Physics_Ch3.pptx", "wb") as out:
        out.write(deck([LINE]))
    after = poll()
    assert after.count() == first.count() + 1
    assert after.filter("metadata.subject = 'Physics'").count() == 1


def test_conform_defaults(spark):
    df = spark.createDataFrame([("1", None)], "chunk_id string, path string")
    row = conform(df, CHUNK_INDEX, {"path": ""}).first()
    assert row["chunk_id"] == 1 and row["path"] == "" and row["document"] is None


def test_scan_corpus(spark):
    df = spark.createDataFrame([(1, "x"), (2, ""), (3, None)], "chunk_id long, chunk_text string")
    rows = layers.scan_corpus(df.withColumn("more", F.lit(1)))
    assert [tuple(r) for r in rows.collect()] == [(1, "x")]


def test_slides_are_read_without_opening_each(monkeypatch):
    lines = [[f"slide {i} of <many>", "and more"] for i in range(300)]
    made, opened = presentation(lines), []
    packed = io.BytesIO()
    with zipfile.ZipFile(io.BytesIO(made)) as given, zipfile.ZipFile(packed, "w", zipfile.ZIP_DEFLATED) as out:
        assert given.testzip() is None
        for name in given.namelist():
            out.writestr(name, given.read(name))
    read = zipfile.ZipFile.open
    monkeypatch.setattr(zipfile.ZipFile, "open", lambda self, name, *a, **k: opened.append(name) or read(self, name, *a, **k))
    for content in (made, packed.getvalue()):
        assert pptx_slides(content) == ["\n".join(x) for x in lines]
    assert len(opened) <= 4  # the lists of the two packages


def test_damaged_slides_still_fail():
    content = presentation([["a line that is long enough"], ["another"]])
    with pytest.raises(zipfile.BadZipFile):
        pptx_slides(content.replace(b"long enough", b"long enougg"))


def test_more_slides_than_a_plain_package_holds():
    assert pptx_slides(presentation([["x"]] * 65_540)) == ["x"] * 65_540


def test_only_rows_with_a_rival_are_hashed_as_a_whole(spark):
    rows = [(1, 10, "a", [1.0]), (1, 10, "b", [2.0]), (1, 9, "c", [3.0]), (2, 5, "d", None), (None, 1, "e", [1.0]), (None, 2, None, [1.0])]
    df = spark.createDataFrame(rows, "chunk_id long, load_ts long, document string, embedding array<float>")
    newest = newest_per_key(df, ["chunk_id"])
    tie = F.xxhash64(F.col("document").cast("string"), F.col("embedding").cast("string"))
    want = df.orderBy("chunk_id", F.col("load_ts").desc(), tie).collect()
    first = {r.chunk_id: r for r in reversed(want)}
    assert sorted(newest.collect(), key=str) == sorted(first.values(), key=str)
    plan = newest._jdf.queryExecution().optimizedPlan().toString()
    assert "xxhash64" in plan and all("_rivals" in line for line in plan.splitlines() if "xxhash64" in line)
