"""Streams that are stopped and go on: two outputs of each micro-batch, keyed state with timers."""

import json
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from folio.streaming import jobs

START = datetime(2024, 5, 1, 12)


def test_two_outputs_go_on_from_the_checkpoint(spark, tmp_path):
    folder, out = tmp_path / "in", f"file://{tmp_path}/out"
    folder.mkdir()
    (folder / "a.json").write_text(json.dumps({"image_path": "a.png", "text": "one", "regions": []}))
    (folder / "b.xml").write_text('<document image="b.png"><text_region><coords/><text>two</text></text_region></document>')
    (folder / "c.txt").write_text("other")
    good, bad = jobs.halves_to_end(jobs.stream_ground_truth(spark, str(folder), 1), out)
    assert {r["image_path"] for r in good.collect()} == {"a.png", "b.png"} and [r["reason"] for r in bad.collect()] == ["not an annotation"]
    (folder / "d.json").write_text("{")
    (folder / "e.JSON").write_text(json.dumps({"image_path": "e.png", "text": "three"}))
    good, bad = jobs.halves_to_end(jobs.stream_ground_truth(spark, str(folder), 1), out)
    assert sorted(r["image_path"] for r in good.collect()) == ["a.png", "b.png", "e.png"]
    assert sorted(r["reason"] for r in bad.collect()) == ["not an annotation", "unreadable"]
    # a micro-batch whose commit was lost is repeated and replaces what it wrote
    last = max((tmp_path / "out" / "checkpoint" / "commits").glob("[0-9]*"), key=lambda p: int(p.name))
    last.unlink()
    last.with_name(f".{last.name}.crc").unlink(missing_ok=True)
    again, _ = jobs.halves_to_end(jobs.stream_ground_truth(spark, str(folder), 1), out)
    assert sorted(r["image_path"] for r in again.collect()) == ["a.png", "b.png", "e.png"]


def test_lines_that_are_no_annotations(spark, tmp_path):
    (tmp_path / "in").mkdir()
    region = {"box": [[0.0, 0.0]] * 4, "text": "r", "confidence": 7.0}
    (tmp_path / "in" / "x.json").write_text("\n".join([json.dumps({"image_path": "a", "text": "t", "regions": [region]}), "", "{oops", json.dumps({"image_path": "b"})]))
    good, bad = jobs.halves_to_end(jobs.stream_annotations(spark, str(tmp_path / "in")), f"file://{tmp_path}/out")
    assert [(r["image_path"], r["full_text"], r["n_regions"], r["n_faults"]) for r in good.collect()] == [("a", "r", 1, 1)]
    assert {(r["reason"], r["raw"]) for r in bad.collect()} == {("unreadable", "{oops"), ("text missing", json.dumps({"image_path": "b"}))}


def test_job_states_across_a_restart(spark, tmp_path):
    """Late events don't take the status back, silent jobs expire, state is there again after a restart."""

    def arrive(name, rows):
        at = [(j, START + timedelta(minutes=m), seq, status, p) for j, m, seq, status, p in rows]
        spark.createDataFrame(at, "job_id string, ts timestamp, seq long, status string, progress double").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in/{name}")

    def run():
        stream = spark.readStream.schema("job_id string, ts timestamp, seq long, status string, progress double").parquet(f"{tmp_path}/in/*")
        out = jobs.run_to_end(jobs.job_states(stream, "10 minutes", 1800), f"file://{tmp_path}/out", "update")
        last = out.groupBy("job_id").agg(F.max(F.struct("epoch", "status", "progress", "expired")).alias("l")).collect()
        return {r["job_id"]: (r["l"]["status"], r["l"]["progress"], r["l"]["expired"]) for r in last}

    arrive("1", [("a", 0, 1, "queued", 0.0), ("a", 5, 2, "running", 0.5), ("a", 5, 3, "paused", 0.4), ("b", 4, 4, "running", 0.1)])
    assert run() == {"a": ("paused", 0.5, False), "b": ("running", 0.1, False)}
    arrive("2", [("a", 3, 9, "late", 0.9), ("b", 20, 5, "done", 1.0)])
    assert run() == {"a": ("paused", 0.9, False), "b": ("done", 1.0, False)}
    arrive("3", [("c", 50, 6, "running", 0.0)])
    assert run() == {"a": ("paused", 0.9, True), "b": ("done", 1.0, False), "c": ("running", 0.0, False)}


def test_jobs_of_one_group(spark, tmp_path):
    """Thousands of jobs cost a few calls of Python, not one each; in a group some change, some expire beside them, some are taken up again."""

    def arrive(name, rows):
        at = [(j, START + timedelta(minutes=m), seq, status, p) for j, m, seq, status, p in rows]
        spark.createDataFrame(at, "job_id long, ts timestamp, seq long, status string, progress double").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in/{name}")

    def run(groups):
        stream = spark.readStream.schema("job_id long, ts timestamp, seq long, status string, progress double").parquet(f"{tmp_path}/in/*")
        out = jobs.run_to_end(jobs.job_states(stream, "10 minutes", 1800, groups=groups), f"file://{tmp_path}/out{groups}", "update")
        return {r["job_id"]: tuple(r["l"])[1:] for r in out.groupBy("job_id").agg(F.max(F.struct("epoch", "status", "seq", "progress", "expired", "ts")).alias("l")).collect()}

    big = 2**62 + 1
    arrive("1", [(None, 0, 1, "queued", None), (big, 0, big, "queued", 0.2), (big + 1, 1, 2, None, 0.1), (3, 2, 3, "a", None), (3, 2, 3, "b", 0.3)] + [(n, 1, n, "run", 0.5) for n in range(10, 3000)])
    first = {g: run(g) for g in (1, 7)}
    assert first[1] == first[7] and len(first[1]) == 2994
    assert first[1][None] == ("queued", 1, None, False, START) and first[1][big][:4] == ("queued", big, 0.2, False) and first[1][3][:4] == ("a", 3, 0.3, False)
    arrive("2", [(big, 35, 1, "done", 0.1), (3, 45, 1, "late", 0.0), (10, 45, 0, "late", 0.9)])
    arrive("3", [(4, 46, 1, "new", 0.0)])
    for g in (1, 7):
        last = run(g)
        assert last[big][:4] == ("done", 1, 0.2, False) and last[3][:4] == ("late", 1, 0.3, False) and last[10][:4] == ("late", 0, 0.9, False) and last[4][3] is False
        assert all(last[j] == (*first[1][j][:3], True, first[1][j][4]) for j in (None, big + 1, 11, 2999))
