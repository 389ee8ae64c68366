from __future__ import annotations

import io
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from tallyforge.operators import malformed
from tallyforge.sinks import packages, publish
from tallyforge.sources import artifacts, carriers


def test_workbook_is_whole():
    data = packages.workbook(["a", "b<"], [("x & \r\n<y>", 1.5), (None, None), ("", -2)], {"c": ("B{r}*2", [3, None, "t"])})
    cells = {c["cell"]: c for c in artifacts._cells("p", data)}
    assert cells["A2"]["value"] == "x & \r\n<y>" and cells["B2"]["value"] == "1.5" and "A3" not in cells and cells["A4"]["value"] == ""
    assert (cells["C2"]["formula"], cells["C2"]["value"], cells["C3"]["value"], cells["C4"]["kind"]) == ("B2*2", "3", None, "str")
    assert artifacts.inspected("xlsx", data)["tables"] == 1 and packages.workbook(["a"], []) == packages.workbook(["a"], [])
    bare = {c["cell"]: c for c in artifacts._cells("p", packages.without_caches(data))}
    assert {k: c["formula"] for k, c in bare.items()} == {k: c["formula"] for k, c in cells.items()} and all(c["value"] is None for c in bare.values() if c["formula"])
    with pytest.raises(ValueError, match="capacity"):
        packages.workbook(["a"], [(1,)] * 3, capacity=2)
    assert [packages.letters(n) for n in (1, 26, 27, 702, 703)] == ["A", "Z", "AA", "ZZ", "AAA"]


def test_workbooks_hold_every_row_once(spark):
    df = spark.range(1000).select("id", F.when(F.col("id") % 7 == 0, None).otherwise(F.concat(F.lit("\0v"), F.col("id"))).alias("v"), (F.col("id") * 2).alias("twice"), F.lit(1).alias("path"))
    books = packages.workbooks(df.repartition(3), ["id", "v"], {"twice": "A{r}*2"}, capacity=90)
    files = books.collect()
    assert sum(b.rows for b in files) == 1000 and max(b.rows for b in files) <= 90 and len({b.path for b in files}) == len(files)
    cells = artifacts.workbook_cells(spark.createDataFrame([(b.path, bytes(b.content)) for b in files], "path string, content binary"))
    ids = [int(r.value) for r in cells.filter("cell like 'A%' and cell <> 'A1'").collect()]
    assert sorted(ids) == list(range(1000))
    assert packages.workbooks(df.limit(0), ["id"]).count() == 0


@pytest.mark.parametrize("text", ["", "a", "x\n\ny", "tabs\tand <b>&amp;</b>\r\nend", "é \U0001f600", "w " * 100_000])
def test_documents_and_mail_keep_their_text(text):
    d = artifacts.inspected("docx", packages.document(text.split("\n")))
    assert d["paragraphs"] == text.count("\n") + 1 and d["characters"] == len(text.replace("\n", ""))
    m = artifacts.inspected("eml", packages.mail("s\nt", "1@x", text, {"a.txt": text}))
    assert m["missing_headers"] == [] and m["message_id"] == "<1@x>" and [a["name"] for a in m["attachments"]] == ["a.txt"] and m["attachments"][0]["binary"] is False


def test_archives_are_alike_for_alike_parts():
    a = packages.zipped({"x": "1", "y": b"2"})
    assert a == packages.zipped({"x": "1", "y": b"2"}) and zipfile.ZipFile(io.BytesIO(a)).read("y") == b"2"


def test_built_is_null_for_null(spark):
    df = spark.createDataFrame([("a",), (None,)], "t string")
    assert [r.c is None for r in df.select(packages.built(lambda t: t.encode(), F.col("t")).alias("c")).collect()] == [False, True]


HEADER = [f.name for f in malformed.SOURCE_ROW]


def test_lines_of_files_are_split_and_classified(spark, tmp_path):
    good = "R{},E,A,2024-01-01,t,1.00,0.00,OPEN"
    (tmp_path / "a.csv").write_text("\ufeff" + ",".join(HEADER) + "\r\n" + "\r\n".join(good.format(i) for i in range(5000)) + "\r\n\r\nshort,row\r\n")
    (tmp_path / "b.csv").write_text("other,header\n" + good.format(1) + "\n")
    (tmp_path / "c.txt").write_text("x")
    size = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        lines = carriers.lines(spark, str(tmp_path), HEADER)
        done = malformed.classify(lines, "raw_line")
        assert lines.rdd.getNumPartitions() > 2
        counts = {r.file: (r.n, r.bad) for r in done.groupBy(F.substring_index("path", "/", -1).alias("file")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.size("reasons") > 0).alias("bad")).collect()}
        assert counts == {"a.csv": (5001, 1), "b.csv": (2, 1)}
        assert [(r.path[-5:], r["first"]) for r in carriers.first_lines(spark, str(tmp_path), HEADER).collect()] == [("b.csv", "other,header")]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)


def test_toml_documents(spark):
    rows = [("a", b"v = 1\n[t]\nd = 2024-01-01\n"), ("b", b"= nope"), ("c", b"\xff"), ("d", None), ("e", b"")]
    got = {r.path: r for r in carriers.toml_documents(spark.createDataFrame(rows, "path string, content binary")).collect()}
    assert json.loads(got["a"].document) == {"v": 1, "t": {"d": "2024-01-01"}} and got["e"].document == "{}"
    assert [got[k].problem for k in "abcde"] == [None, "unreadable", "unreadable", "unreadable", None]


def test_links_are_found(tmp_path):
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "f").write_text("x")
    assert carriers.links(str(tmp_path)) == []
    (tmp_path / "d" / "l").symlink_to(tmp_path / "d" / "f")
    (tmp_path / "e").symlink_to(tmp_path / "d")
    assert [p[len(str(tmp_path)) :] for p in carriers.links(str(tmp_path))] == ["/d/l", "/e"] and carriers.links(str(tmp_path / "e"))[0] == str(tmp_path / "e")


def test_a_copy_never_replaces(tmp_path, monkeypatch):
    import hashlib

    (tmp_path / "s").mkdir()
    (tmp_path / "s" / "f").write_text("x")
    manifest = {"f": hashlib.sha256(b"x").hexdigest()}
    real = publish.shutil.copyfile

    def late(a, b):  # the target comes to exist while the copy is made
        (tmp_path / "t").mkdir()
        return real(a, b)

    monkeypatch.setattr(publish.shutil, "copyfile", late)
    with pytest.raises(publish.Refused):
        publish.copy_verified(str(tmp_path / "s"), str(tmp_path / "t"), manifest)
    assert list((tmp_path / "t").iterdir()) == []
    monkeypatch.setattr(publish.shutil, "copyfile", real)
    assert publish.copy_verified(str(tmp_path / "s"), str(tmp_path / "u"), manifest) == 1 and (tmp_path / "u" / "f").read_text() == "x"
