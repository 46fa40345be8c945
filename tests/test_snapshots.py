"""Texts of any encoding, and the cycle of saving, backing up, checking and bringing back, stopped between its steps."""

import pytest

from fernglass.sources import files, snapshots


def rows(tables):
    return {name: sorted(map(tuple, df.collect())) for name, df in tables.items()}


def test_encodings_of_a_mixed_folder(spark, tmp_path):
    folder = tmp_path / "texts" / "north"
    folder.mkdir(parents=True)
    text = "教会とカフェ\r\n2"
    written = {"a.txt": ("utf-8-sig", text), "b.txt": ("utf-8", text), "c.txt": ("cp932", text + "①"), "d.txt": ("shift_jis", text), "e.txt": ("utf-16", "é日本")}
    for name, (encoding, t) in written.items():
        (folder / name).write_bytes(t.encode(encoding))
    (folder / "f.txt").write_bytes(b"\x81\xff\xfe\xa0 odd")
    (folder / "g.txt").write_bytes(b"")
    got = {r.file: (r.encoding, r.text) for r in files.read_any_texts(spark, str(tmp_path / "texts"), glob="*.txt").collect()}
    assert got["a.txt"] == ("utf-8-sig", text)
    assert got["b.txt"] == ("utf-8-sig", text)  # the first that reads it; without a mark they are the same
    assert got["c.txt"] == ("cp932", text + "①") and got["d.txt"] == ("cp932", text)
    assert got["e.txt"] == files.decoded("é日本".encode("utf-16"))[::-1]
    assert got["f.txt"][0] in ("utf-16", "cp932(replace)") and "g.txt" not in got
    assert files.decoded("é日本".encode("utf-16"), ("utf-8", "utf-16")) == ("é日本", "utf-16")
    assert files.decoded(b"\x81\xff\xfe", ("utf-8",)) == (b"\x81\xff\xfe".decode("cp932", "replace"), "cp932(replace)")
    assert files.decoded(None) == (None, None)


def test_csv_of_several_encodings(spark, tmp_path):
    table = 'title,desc,areas,category,extras,extra_tel,extra:fax\n教会,"古い\n教会",北の島, ,"{""tel"": ""1"", ""x"": ""2""}",9,\n,no title,a,b,,,\nカフェ,d,a,food,not json,,7\n'
    for name, encoding in (("a.csv", "utf-8-sig"), ("b.csv", "cp932"), ("c.csv", "utf-8")):
        (tmp_path / name).write_bytes(table.encode(encoding))
    (tmp_path / "empty.csv").write_bytes(b"")
    got = files.import_any_csv(spark, str(tmp_path)).collect()
    one = [("カフェ", "d", "food", {"fax": "7"}), ("教会", "古い\n教会", "other", {"x": "2", "tel": "9"})]
    assert sorted(((r.title, r.desc, r.category, r.extras) for r in got), key=lambda r: r[0]) == sorted(one * 3, key=lambda r: r[0])
    assert sorted(r.encoding for r in got) == ["cp932"] * 2 + ["utf-8-sig"] * 4


@pytest.fixture
def tables(spark):
    return lambda n: {"entries": spark.createDataFrame([(i, f"t{i}") for i in range(n)], "id int, title string"), "notes": spark.createDataFrame([(n,)], "n int")}


def test_cycle(spark, tmp_path, tables):
    base = str(tmp_path / "set")
    assert snapshots.load(spark, base) == {}
    with pytest.raises(snapshots.SnapshotError):
        snapshots.create(spark, base)
    names = []
    for n in (1, 2, 3):
        snapshots.save(spark, base, tables(n))
        names.append(snapshots.create(spark, base, notes=f"n{n}", keep=2))
    assert snapshots.latest(spark, base) == names[2]
    assert {r.snapshot for r in snapshots.manifest(spark, base).collect()} == set(names[1:])  # the first was pruned, with its files
    assert not (tmp_path / "set" / names[0]).exists()
    snapshots.note(spark, base, names[1], "keep me")
    assert {r.notes for r in snapshots.entry(spark, base, names[1]).collect()} == {"keep me"}
    assert snapshots.problems(spark, base).isEmpty()
    seen = []
    assert snapshots.restore(spark, base, names[1], before=lambda t: seen.append(t["entries"].count())) == names[1]
    assert seen == [2] and rows(snapshots.load(spark, base)) == rows(tables(2))
    part = next((tmp_path / "set" / names[2] / "entries").glob("part-*"))
    part.write_bytes(b"broken")
    part.with_name(f".{part.name}.crc").unlink(missing_ok=True)  # the local file system's own check
    assert [r.problem for r in snapshots.problems(spark, base, names[2]).collect()] == ["changed"]
    with pytest.raises(snapshots.SnapshotError, match="changed"):
        snapshots.restore(spark, base)
    assert rows(snapshots.load(spark, base)) == rows(tables(2))
    with pytest.raises(snapshots.SnapshotError):
        snapshots.restore(spark, base, names[0])


@pytest.mark.parametrize("stop", range(4))
def test_a_writer_that_stops(spark, tmp_path, tables, monkeypatch, stop):
    """The n-th thing that is published, or deleted, fails: readers have the old set and the backups they had."""
    base = str(tmp_path / "set")
    snapshots.save(spark, base, tables(1))
    first = snapshots.create(spark, base)
    before = rows(snapshots.load(spark, base)), snapshots.latest(spark, base)
    real, calls = snapshots.publish, []

    def failing(s, path, new=None):
        if new is not None:
            calls.append(path)
            if len(calls) > (0, 0, 0, 1)[stop]:
                raise OSError("stopped")
        return real(s, path, new)

    monkeypatch.setattr(snapshots, "publish", failing)
    with pytest.raises(OSError):
        if stop == 0:
            snapshots.save(spark, base, tables(5))
        elif stop == 1:
            snapshots.create(spark, base)
        elif stop == 2:
            snapshots.restore(spark, base)
        else:
            snapshots.create(spark, base, keep=1)  # the new backup is in the manifest, pruning stops
    monkeypatch.setattr(snapshots, "publish", real)
    assert rows(snapshots.load(spark, base)) == before[0]
    if stop == 3:
        assert {r.snapshot for r in snapshots.manifest(spark, base).collect()} >= {first} and snapshots.problems(spark, base).isEmpty()
    else:
        assert snapshots.latest(spark, base) == before[1]
    assert snapshots.restore(spark, base, first) == first


def test_a_refused_set_is_not_published(spark, tmp_path, tables):
    base = str(tmp_path / "set")
    snapshots.save(spark, base, tables(1))
    with pytest.raises(ValueError):
        snapshots.save(spark, base, tables(2), before=lambda t: (_ for _ in ()).throw(ValueError("refused")))
    assert rows(snapshots.load(spark, base)) == rows(tables(1))
