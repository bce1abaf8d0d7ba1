import datetime as dt
import json
import os
import subprocess
import sys

from checks.ingest import presentation
from lectern import jobs
from lectern.sources import logs

TEXT = "A loop repeats its body while the test holds and stops when it fails."


def test_files_to_answers_and_scores(spark, tmp_path, capsys):
    landing, lake, out = tmp_path / "landing", str(tmp_path / "lake"), str(tmp_path / "out")
    landing.mkdir()
    (landing / "Doe_Python_Ch1.pptx").write_bytes(presentation([[TEXT], ["A tuple never changes after it has been made once."]]))
    jobs.main(["ingest", "--landing", str(landing), "--lake", lake])
    assert "'chunks': 1" in capsys.readouterr().out
    jobs.main(["index", "--lake", lake])
    (tmp_path / "q.json").write_text(json.dumps({"question_id": 1, "question": "loop repeats body"}) + "\n")
    jobs.main(["ask", "--lake", lake, "--questions", str(tmp_path / "q.json"), "--out", out])
    row = spark.read.json(out).first()
    assert row["grade"] == "correct" and row["sources"][0]["subject"] == "Python" and TEXT in row["context"]
    asked = [
        {"question": "A loop repeats", "category": "in_scope", "expected_verdict": "correct"},
        {"question": "zebra", "category": "out_of_scope", "expected_verdict": "incorrect"},
    ]
    (tmp_path / "eval.json").write_text(json.dumps(asked))
    jobs.main(["evaluate", "--lake", lake, "--questions", str(tmp_path / "eval.json"), "--out", f"{out}-eval"])
    assert spark.read.json(f"{out}-eval/summary").first()["concordance_matches"] == 2
    (tmp_path / "eval2.json").write_text(json.dumps([*asked, asked[0]]))
    (tmp_path / "rewrites.json").write_text(json.dumps({"question": "A loop repeats", "raw_rewrites": "How does a loop repeat its body?"}) + "\n")
    more = ["--rewrites", str(tmp_path / "rewrites.json")]
    jobs.main(["evaluate", "--lake", lake, "--questions", str(tmp_path / "eval2.json"), "--out", f"{out}-eval2", *more])
    assert spark.read.json(f"{out}-eval2/per_question").count() == 3
    jobs.main(["compact", "--lake", lake])
    jobs.main(["watch", "--landing", str(landing), "--lake", lake])


def test_jobs_start_as_a_file_and_as_a_module(tmp_path):
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    for command, folder in (([f"{root}/lectern/jobs.py"], tmp_path), (["-m", "lectern.jobs"], root)):
        done = subprocess.run([sys.executable, *command, "--help"], cwd=folder, capture_output=True, text=True, timeout=120)
        assert done.returncode == 0 and "compact" in done.stdout, done.stderr


def test_report(spark, tmp_path):
    now = dt.datetime.now(dt.timezone.utc).replace(tzinfo=None)
    turns = [(1, "s", "user", "q", now - dt.timedelta(minutes=5)), (2, "s", "assistant", "pas couvert", now - dt.timedelta(minutes=4))]
    logs.append_turns(spark.createDataFrame(turns, "id long, session_id string, role string, content string, created_at timestamp"), f"{tmp_path}/history")
    found = spark.createDataFrame(
        [("s", "q", now, [("7", "text", "Maths")])],
        "session_id string, query string, retrieved_at timestamp, sources array<struct<chunk_id: string, chunk_text: string, subject: string>>",
    )
    logs.append_retrievals(found, f"{tmp_path}/retrievals")
    jobs.main(["report", "--logs", str(tmp_path), "--out", f"{tmp_path}/report"])
    assert spark.read.json(f"{tmp_path}/report/summary").first()["confusion_rate"] == 100.0
    assert spark.read.json(f"{tmp_path}/report/confusion").first()["subject"] == "Maths"
    assert spark.read.json(f"{tmp_path}/report/top_chunks").first()["chunk_id"] == "7"
