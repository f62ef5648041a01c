"""Paged sources with cursors and as streams; files fetched in two phases."""

from __future__ import annotations

import hashlib
import json

import pytest

from brightloom.sources import acquire, paged


def page(folder, name, ids, following=None):
    (folder / name).write_text("﻿" + json.dumps({"results": [{"id": str(i), "title": f"t{i}", "year": 2000} for i in ids], "next": following}), encoding="utf-8")


def test_cursors_are_followed(spark, tmp_path):
    page(tmp_path, "b.json", [1, 2, 3], "z.json")
    page(tmp_path, "z.json", [4], "a.json")
    page(tmp_path, "a.json", [5, 6], "b.json")  # and back
    page(tmp_path, "other.json", [9], "b.json")
    found = paged.pages(spark, str(tmp_path))
    assert [(r.n, r.id, r.page) for r in paged.followed(found, "b.json").orderBy("n").collect()] == [(1, "1", "b.json"), (2, "2", "b.json"), (3, "3", "b.json"), (4, "4", "z.json"), (5, "5", "a.json"), (6, "6", "a.json")]
    for most in (0, 3, 5, 9):
        assert [r.id for r in paged.followed(found, "b.json", most).orderBy("n").collect()] == list("123456")[:most]
    page(tmp_path, "z.json", [], "a.json")
    assert [r.id for r in paged.followed(paged.pages(spark, str(tmp_path)), "b.json").orderBy("n").collect()] == list("123")
    assert paged.followed(found, "none.json").collect() == []


def test_a_restarted_stream_reads_each_record_once(spark, tmp_path):
    folder, out, state = tmp_path / "pages", str(tmp_path / "out"), str(tmp_path / "state")
    folder.mkdir()

    def run():
        query = paged.stream(spark, str(folder), 1).writeStream.format("parquet").option("checkpointLocation", state).trigger(availableNow=True).start(out)
        query.awaitTermination()

    page(folder, "1.json", [1, 2])
    page(folder, "2.json", [3])
    run()
    run()
    page(folder, "3.json", [4, 5])
    (folder / "4.json").write_text("no page")
    run()
    assert sorted(r.id for r in spark.read.parquet(out).collect()) == list("12345")


def files(tmp_path, n):
    made = []
    for i in range(n):
        (tmp_path / f"source{i}").write_bytes(b"%PDF-" + bytes([i]) * (i * 1000))
        made.append((f"file:{tmp_path}/source{i}", f"f{i}.pdf", "pdf", i * 1000 + 5, hashlib.sha256(b"%PDF-" + bytes([i]) * (i * 1000)).hexdigest()))
    return made


SCHEMA = "url string, name string, kind string, size long, sha256 string"


def test_files_are_fetched_whole(spark, tmp_path):
    made = files(tmp_path, 6)
    target = tmp_path / "target"
    target.mkdir()
    (target / "f4.pdf.part").write_bytes((tmp_path / "source4").read_bytes()[:1234])  # of an earlier job
    (target / "f5.pdf.part").write_bytes(b"other bytes")
    acquire.acquire(spark.createDataFrame(made, SCHEMA), str(target))
    assert {p.name: p.read_bytes() for p in target.iterdir() if not p.name.startswith(".")} == {f"f{i}.pdf": (tmp_path / f"source{i}").read_bytes() for i in range(6)}
    acquire.acquire(spark.createDataFrame([(f"{tmp_path}/source1", "f2.pdf")], "url string, name string"), f"file://{target}")
    assert (target / "f2.pdf").read_bytes() == (tmp_path / "source1").read_bytes()


@pytest.mark.parametrize("wrong", [("file:/none", "x.pdf", None, None, None), ("{0}/source1", "x.zip", "zip", None, None), ("{0}/source1", "x.pdf", None, 3, None), ("{0}/source1", "../x", None, None, None)])
def test_a_failed_job_shows_nothing_and_the_next_goes_on(spark, tmp_path, wrong):
    made = files(tmp_path, 4)
    target = tmp_path / "target"
    bad = [*made, (wrong[0].format(tmp_path), *wrong[1:])]
    with pytest.raises(Exception):  # noqa: B017
        acquire.acquire(spark.createDataFrame(bad, SCHEMA).coalesce(1), str(target), tries=2, wait=0)
    assert all(p.name.endswith(".part") for p in target.iterdir())
    acquire.acquire(spark.createDataFrame(made, SCHEMA), str(target))
    assert {p.name: p.read_bytes() for p in target.iterdir()} == {f"f{i}.pdf": (tmp_path / f"source{i}").read_bytes() for i in range(4)}


def test_packed_pages_are_those_of_single_files(spark, tmp_path):
    """Records along cursors and as a stream, from a file for each page and from packed ones."""
    single, folder = tmp_path / "single", tmp_path / "packed"
    single.mkdir()
    for i in range(7):
        page(single, f"c{i}.json", [] if i == 5 else range(10 * i, 10 * i + i), f"c{i + 1}.json")
    (single / "no.json").write_text("no page")
    found = paged.pages(spark, str(single))
    paged.pack(found.coalesce(1), str(folder), 3)
    assert len(list(folder.glob("*.json"))) == 3
    (folder / "broken.json").write_text('no page\n{"page": "x.json"}\n')
    got = paged.packed(spark, str(folder))
    assert sorted((r.page, r.next, r.results) for r in got.where("page LIKE 'c%'").collect()) == sorted((r.page, r.next, r.results) for r in found.where("page LIKE 'c%'").collect())
    for most in (None, 4):
        assert sorted(paged.followed(got, "c1.json", most).collect()) == sorted(paged.followed(found, "c1.json", most).collect())
    out, state = str(tmp_path / "out"), str(tmp_path / "state")
    for more in (None, "d.json"):
        if more:
            (folder / more).write_text(json.dumps({"page": more, "results": [{"id": "99"}]}))
        for _ in range(2):
            paged.stream(spark, str(folder), 1, packed=True).writeStream.format("parquet").option("checkpointLocation", state).trigger(availableNow=True).start(out).awaitTermination()
    assert sorted(int(r.id) for r in spark.read.parquet(out).collect()) == sorted([10 * i + j for i in range(7) if i != 5 for j in range(i)] + [99])


def test_pages_of_conversations_need_no_file_each(spark, sf_dir, monkeypatch):
    from brightloom.plans import processes
    from brightloom.plans.base import Tables

    def refused(*_):
        raise AssertionError("a file for each page")

    monkeypatch.setattr(processes, "_named_files", refused)
    t = Tables(spark, sf_dir)
    assert processes.followed_pages(t).count() == min(100, t.conversations.count())
    assert processes.streamed_pages(t).groupBy().sum("n").first()[0] == t.conversations.count()
