"""Paged sources and scheduled runs: cycles, changed records, late pages, killed and repeated runs."""

import json

import pytest

from pitwise.sources import paging
from pitwise.streaming import scheduled


def page(at, cursor, following, *rows):
    (at / f"page-{cursor}.jsonl").write_text("\n".join([json.dumps({"next": following}), *(json.dumps(r) for r in rows)]) + "\n")


@pytest.mark.parametrize("prefix", ["", "file://"])
def test_records_of_all_pages(spark, tmp_path, prefix):
    page(tmp_path, "0", "x", {"id": "a", "v": 1}, {"id": 7, "v": 3})
    page(tmp_path, "x", "1", {"id": "b", "v": "é" * 70_000}, {"id": "a", "v": 1})
    page(tmp_path, "1", None)
    got = {r.key: (r.copies, json.loads(r.record)["v"]) for r in paging.records(spark, f"{prefix}{tmp_path}", "id").collect()}
    assert got == {"a": (2, 1), "7": (1, 3), "b": (1, "é" * 70_000)}
    assert spark.read.format("paged").option("folder", str(tmp_path)).option("key", "id").load().rdd.getNumPartitions() == 3


def test_circles_changes_and_missing_pages(spark, tmp_path):
    with pytest.raises(Exception, match="no first page"):
        paging.records(spark, str(tmp_path), "id").collect()
    page(tmp_path, "0", "1", {"id": "a", "v": 1})
    page(tmp_path, "1", "0", {"id": "b", "v": 2})
    with pytest.raises(Exception, match="circle at 0"):
        paging.records(spark, str(tmp_path), "id").collect()
    page(tmp_path, "1", None, {"id": "a", "v": 2})
    with pytest.raises(Exception, match="record a came again changed"):
        paging.records(spark, str(tmp_path), "id").collect()


def test_stream_goes_on_where_pages_appear(spark, tmp_path):
    pages, out, state = tmp_path / "pages", f"file://{tmp_path}/out", f"file://{tmp_path}/state"
    pages.mkdir()
    spark.dataSource.register(paging.PagedSource)

    def drained():
        s = spark.readStream.format("paged").option("folder", str(pages)).option("key", "id").load()
        s.writeStream.format("parquet").option("path", out).option("checkpointLocation", state).trigger(once=True).start().awaitTermination()
        return sorted(r.key for r in spark.read.parquet(out).collect())

    page(pages, "0", "1", {"id": "a"})
    page(pages, "1", "2", {"id": "b"})
    assert drained() == ["a", "b"]
    page(pages, "2", None, {"id": "c"}, {"id": "d"})
    assert drained() == ["a", "b", "c", "d"]


def test_killed_and_repeated_run_gives_the_same_table(spark, tmp_path):
    root, source = f"file://{tmp_path}/root", f"file://{tmp_path}/in"
    for i in range(4):
        spark.range(i * 10, i * 10 + 10).coalesce(1).write.mode("append").parquet(source)
    stream = lambda: spark.readStream.schema("id bigint").option("maxFilesPerTrigger", 1).parquet(source)
    calls = []

    def killed(number):
        calls.append(number)
        if len(calls) == 3:
            raise RuntimeError("killed")

    with pytest.raises(Exception, match="killed"):
        scheduled.run(stream(), root, "k", "one", "2026-01-01 10:00:00", killed)
    assert [r.status for r in scheduled.runs(spark, root).collect()] == ["running"]
    assert not scheduled.due(spark, root, "k", "2026-01-01 13:00:00")  # one is active
    assert scheduled.run(stream(), root, "k", "two", "2026-01-01 11:00:00") == "one"
    assert scheduled.run(stream(), root, "k", "three", "2026-01-01 12:00:00") is None
    assert sorted(r.id for r in scheduled.data(spark, root, "id bigint").collect()) == list(range(40))
    assert {r.run_id: r.status for r in scheduled.runs(spark, root).collect()} == {"one": "cancelled", "two": "success", "three": "success"}
    assert not scheduled.due(spark, root, "k", "2026-01-01 13:29:00") and scheduled.due(spark, root, "k", "2026-01-01 13:31:00")


def test_only_the_newest_running_run_of_a_kind_is_closed_and_once(spark, tmp_path):
    root = f"file://{tmp_path}"
    assert scheduled.close_interrupted(spark, root, "k", "2026-01-01 09:00:00") is None and scheduled.due(spark, root, "k", "2026-01-01 09:00:00")
    for run, kind, hour in (("a", "k", 10), ("b", "k", 11), ("c", "other", 12)):
        scheduled.record(spark, root, run, kind, "running", f"2026-01-01 {hour}:00:00")
    assert scheduled.close_interrupted(spark, root, "k", "2026-01-01 13:00:00", note="deadline") == "b"
    assert scheduled.close_interrupted(spark, root, "k", "2026-01-01 14:00:00") is None
    scheduled.record(spark, root, "b", "k", "success", "2026-01-01 15:00:00")  # too late: its end holds
    assert {r.run_id: (r.status, r.note) for r in scheduled.runs(spark, root).collect()} == {"a": ("running", None), "b": ("cancelled", "deadline"), "c": ("running", None)}
