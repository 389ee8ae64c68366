from __future__ import annotations

import hashlib

import pytest

from tallyforge.sinks import publish as p
from tallyforge.streaming import intake


def test_documents_are_created_once(tmp_path):
    root = str(tmp_path)
    docs = {"a/x.json": p.document_bytes({"b": 1, "a": "é"}), "y.json": b"y"}
    assert p.publish_documents(root, docs) == {"a/x.json": "written", "y.json": "written"}
    assert p.publish_documents(root, docs) == {"a/x.json": "unchanged", "y.json": "unchanged"}
    with pytest.raises(p.Refused):
        p.publish_documents(root, {"y.json": b"other", "z.json": b"new"})
    assert not (tmp_path / "z.json").exists() and (tmp_path / "y.json").read_bytes() == b"y"
    with pytest.raises(p.Refused):
        p.publish_documents(root, {"../out.json": b""})


def test_tables_are_compared_by_rows(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, None)], "i int, s string")
    path = str(tmp_path / "t")
    assert p.publish_tables({path: df}) == {path: "written"}
    assert p.publish_tables({path: df.repartition(3).orderBy("s")}) == {path: "unchanged"}
    other = str(tmp_path / "u")
    with pytest.raises(p.Refused):
        p.publish_tables({path: df.union(df), other: df})
    assert not (tmp_path / "u").exists()
    assert p.with_hash(df, ["s", "i"]).filter("i = 1").first().sha256 == hashlib.sha256(b'{"i":1,"s":"a"}').hexdigest()


def test_copy_is_whole_or_nothing(tmp_path):
    (tmp_path / "src" / "d").mkdir(parents=True)
    (tmp_path / "src" / "d" / "f").write_text("x")
    good = hashlib.sha256(b"x").hexdigest()
    with pytest.raises(p.Refused):
        p.copy_verified(str(tmp_path / "src"), str(tmp_path / "dst"), {"d/f": "0" * 64})
    assert not (tmp_path / "dst").exists()
    assert p.copy_verified(str(tmp_path / "src"), str(tmp_path / "dst"), {"d/f": good}) == 1
    with pytest.raises(p.Refused):
        p.copy_verified(str(tmp_path / "src"), str(tmp_path / "dst"), {"d/f": good})


def test_intake_is_incremental(spark, tmp_path):
    line = "R{},E,1,2024-01-01,t,1.00,0.00,POSTED"
    write = lambda rows, name: spark.createDataFrame(rows, intake.LINES).coalesce(1).write.parquet(str(tmp_path / "in" / name))
    import datetime

    at = datetime.datetime(2024, 1, 1)
    write([(1, "f", 2, line.format(1), at), (2, "f", 3, "bad", at), (3, "f", 2, line.format(1), at)], "a")
    run = lambda: intake.start(intake.once(intake.lines(spark, str(tmp_path / "in" / "*"))), str(tmp_path / "rows"), str(tmp_path / "bad"), str(tmp_path / "cp")).awaitTermination(120)
    run()
    assert spark.read.parquet(str(tmp_path / "rows")).count() == 1
    write([(4, "f", 4, line.format(2), at), (5, "f", 2, line.format(1), at)], "b")
    run()
    rows = spark.read.parquet(str(tmp_path / "rows")).collect()
    assert sorted(r.source_row_id for r in rows) == ["R1", "R2"]
    assert [r.reason for r in spark.read.parquet(str(tmp_path / "bad")).collect()] == ["column_count"]
