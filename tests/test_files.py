import pytest

from fernglass.sources import files


def test_json_array_quarantine(spark, tmp_path):
    (tmp_path / "a.json").write_text('[{"id": 1, "t": "x"}, {"id": 2, "t": "y"}]')
    (tmp_path / "b.json").write_text('[{"id": 3, "t": ')
    good, bad = files.read_json_array(spark, str(tmp_path), "id long, t string")
    assert sorted(r.id for r in good.collect()) == [1, 2] and bad.count() == 1


def test_json_lines(spark, tmp_path):
    (tmp_path / "l.jsonl").write_text('{"id": 1}\nbroken\n{"id": 2}\n')
    assert sorted(r.id for r in files.read_json_lines(spark, str(tmp_path), "id long").collect()) == [1, 2]
    with pytest.raises(Exception):
        files.read_json_lines(spark, str(tmp_path), "id long", strict=True).collect()
    out = str(tmp_path / "log")
    files.append_json_lines(spark.range(3), out)
    files.append_json_lines(spark.range(3), out)
    assert spark.read.json(out).count() == 6


def test_csv_import(spark, tmp_path):
    (tmp_path / "e.csv").write_text('﻿title,desc,areas,extras,extra_a,extra:b\nT,"d ""q""",x,"{""a"": ""1"", ""c"": ""2""}",9,\n,no title,x,,,\n', encoding="utf-8")
    r = files.import_entries_csv(spark, str(tmp_path / "e.csv")).collect()
    assert len(r) == 1 and r[0].category == "other" and r[0].extras == {"a": "9", "c": "2"} and r[0].desc == 'd "q"'


def test_texts_listing_and_checksums(spark, tmp_path):
    (tmp_path / "c" / "p1").mkdir(parents=True)
    (tmp_path / "c" / "p1" / "a.txt").write_bytes("﻿héllo\r\nx".encode())
    (tmp_path / "c" / "p1" / "b.txt").write_bytes("日本".encode("utf-16"))
    got = {r.file: (r.part, r.text) for r in files.read_texts(spark, str(tmp_path / "c")).collect()}
    assert got == {"a.txt": ("p1", "héllo\nx"), "b.txt": ("p1", "日本")}
    listing = files.list_files(spark, str(tmp_path / "c"))
    assert files.folder_totals(listing).first().files == 2
    before = files.checksums(spark, str(tmp_path / "c")).collect()
    manifest = spark.createDataFrame(before)
    (tmp_path / "c" / "p1" / "a.txt").write_text("changed")
    (tmp_path / "c" / "p1" / "b.txt").unlink()
    assert sorted(r.problem for r in files.broken_files(manifest, files.checksums(spark, str(tmp_path / "c"))).collect()) == ["changed", "missing"]


def test_exports_and_versions(spark, tmp_path):
    rows = spark.createDataFrame([(1, 'a "b"\nc')], "id long, t string")
    files.export_csv(rows, str(tmp_path / "csv"))
    text = "".join(p.read_text() for p in (tmp_path / "csv").glob("part-*"))
    assert '"a ""b""\\nc"' in text
    path = str(tmp_path / "table")
    assert files.publish(spark, path) is None
    old = files.publish(spark, path, spark.range(2))
    new = files.publish(spark, path, spark.range(5))
    assert (old.count(), new.count(), files.publish(spark, path).count()) == (2, 5, 5)
    files.export_text(spark.createDataFrame([("T", ["x"], ["y"], "body")], "t string, g array<string>, a array<string>, b string"), str(tmp_path / "txt"), title="t", tags="g", areas="a", body="b")
    assert "".join(p.read_text() for p in (tmp_path / "txt").glob("part-*")) == "T\nx\ny\n\nbody\n"


def test_newer_files_and_saved_entries(spark, tmp_path):
    import pytest

    from fernglass.operators import catalogue

    ts = lambda n: f"2024-01-0{n} 00:00:00"
    kind = "name string, mtime string"
    source = spark.createDataFrame([("a", ts(1)), ("b", ts(3)), ("c", ts(2))], kind)
    target = spark.createDataFrame([("a", ts(1)), ("b", ts(2))], kind)
    assert sorted(r.name for r in files.newer_files(source, target).collect()) == ["b", "c"]
    rows = spark.createDataFrame([(1, "Town  Hall", ["x"], "a"), (2, "town hall", ["y"], "bb")], "ord long, title string, areas array<string>, desc string")
    path = str(tmp_path / "entries")
    saved = catalogue.saved(rows, path, title="title", order="ord", modal=["desc"], lists=["areas"]).collect()
    assert [(r.ord, r.n, r.desc, r.areas) for r in saved] == [(1, 2, "bb", ["x", "y"])]
    with pytest.raises(ValueError):
        catalogue.saved(rows.withColumn("title", rows.desc.substr(9, 1)), path, title="title", order="ord")
    assert files.publish(spark, path).count() == 1
