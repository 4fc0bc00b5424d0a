from datetime import datetime
from pathlib import Path

import pytest

from colloquy.plans import batch
from colloquy.schema import BatchOptions, ConfigurationError, DirectoryNotFoundError, InvalidFilterError
from colloquy.sources import config, discovery, reader


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    top = tmp_path_factory.mktemp("files")
    (top / "file1.txt").write_text("A: hi")
    (top / "File2.txt").write_text("x" * 800)
    (top / "file3.json").write_text("{}")
    (top / "empty.txt").write_text("")
    (top / "subdir").mkdir()
    (top / "subdir/file4.txt").write_text("B: there\nA: you")
    (top / "subdir/file5").write_text("")
    (top / "link.txt").symlink_to(top / "file1.txt")
    return top


def names(df):
    return [r["path"].rsplit("/", 1)[1] for r in df.collect()]


def test_find(spark, folder):
    f, top = discovery.FileFilter, str(folder)
    assert sorted(names(discovery.find_files(spark, top))) == ["File2.txt", "empty.txt", "file1.txt"]
    assert len(names(discovery.find_files(spark, top, f(recursive=True)))) == 4
    assert names(discovery.find_files(spark, top, f(min_size=100))) == ["File2.txt"]
    assert names(discovery.find_files(spark, top, f(min_size=800, max_size=800))) == ["File2.txt"]
    assert names(discovery.find_files(spark, top, order=discovery.SortOrder.NAME)) == ["empty.txt", "file1.txt", "File2.txt"]
    assert names(discovery.find_files(spark, top, order=discovery.SortOrder.SIZE_DESC))[0] == "File2.txt"
    assert "link.txt" in names(discovery.find_files(spark, top, follow_symlinks=True))
    assert len(names(discovery.find_transcript_files(spark, top))) == 5
    assert len(names(discovery.discover_files(spark, top, "*.json"))) == 1


def test_scan_prunes_content_and_pushes_sizes(spark, folder):
    found = discovery.scan(spark, str(folder), discovery.FileFilter(min_size=100))
    assert names(found) == ["File2.txt"]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(length,100)" in plan
    assert "content" not in plan.split("ReadSchema")[1]


def test_sizes_and_extensions(spark, folder):
    files = discovery.find_files(spark, str(folder), discovery.FileFilter(pattern="*", recursive=True))
    assert discovery.total_size(files).first()["total_size"] == 5 + 800 + 2 + 15
    assert {r["extension"]: r["n"] for r in discovery.count_by_extension(files).collect()} == {".txt": 4, ".json": 1, "(no extension)": 1}


def test_refusals(spark, folder):
    for bad in ({"min_size": -1}, {"min_size": 5, "max_size": 1}, {"after_date": datetime(2025, 2, 1), "before_date": datetime(2025, 1, 1)}):
        with pytest.raises(InvalidFilterError):
            discovery.FileFilter(**bad)
    for path in (folder / "none", folder / "file1.txt"):
        with pytest.raises(DirectoryNotFoundError):
            discovery.find_files(spark, str(path))
    with pytest.raises(ConfigurationError):
        BatchOptions(parser="other")


def test_directory_to_transcripts(spark, folder):
    found = batch.process_directory(spark, str(folder), recursive=True)
    rows = {r["doc_id"].rsplit("/", 1)[1]: r for r in found.transcripts.collect()}
    assert set(rows) == {"file1.txt", "File2.txt", "empty.txt", "file4.txt"}
    assert (rows["empty.txt"]["segment_count"], rows["empty.txt"]["duration_seconds"]) == (0, 0.1)
    assert rows["file4.txt"]["speakers"] == ["A", "B"]
    single = batch.process_single(spark, str(folder / "file1.txt")).transcripts.first()
    assert single["content"] == "hi"


def test_names_are_no_patterns(spark, tmp_path):
    top = tmp_path / "calls {x} [1]"
    top.mkdir()
    for name in ("a.txt", "b[1].txt", "c 100%.txt", "d{e}.txt", "f*.txt", ".hidden.txt", "none.txt", "ü.txt"):
        (top / name).write_text("" if name == "none.txt" else "A: hi")
    expected = {"a.txt", "b[1].txt", "c 100%.txt", "d{e}.txt", "f*.txt", "none.txt", "ü.txt"}
    last = lambda df: {r["doc_id"].rsplit("/", 1)[1] for r in df.collect()}
    found = batch.process_directory(spark, str(top))
    assert last(found.transcripts) == expected
    assert last(found.errors) == {".hidden.txt"}
    assert last(batch.process_directory(spark, str(top), exact=False).status) == expected - {"none.txt"}
    assert last(batch.process_directory(spark, str(top), "b[[]1].txt").transcripts) == {"b[1].txt"}
    listed = batch.process_files(spark, [str(top / n) for n in (*sorted(expected), "gone.txt")])
    assert last(listed.transcripts) == expected
    assert last(listed.errors) == {"gone.txt"}
    for missing in (top / "none", top / "a.txt"):
        with pytest.raises(DirectoryNotFoundError):
            batch.process_directory(spark, str(missing))


def test_directory_with_filter_and_order(spark, folder):
    where = discovery.FileFilter(pattern="*.txt", recursive=True, min_size=6)
    found = batch.process_directory(spark, str(folder), where=where)
    files = batch.discover(spark, str(folder), where)
    for order, expected in ((discovery.SortOrder.NAME, ["File2.txt", "file4.txt"]), (discovery.SortOrder.SIZE, ["file4.txt", "File2.txt"]), (discovery.SortOrder.NAME_DESC, ["file4.txt", "File2.txt"])):
        assert [r["doc_id"].rsplit("/", 1)[1] for r in batch.in_order(found.transcripts, files, order).collect()] == expected


def test_encodings(spark, tmp_path):
    korean, french = "갑: 안녕하세요 반갑습니다", "Élodie: déjà vu, à bientôt"
    for name, text, encoding in (("k.txt", korean, "cp949"), ("e.txt", korean, "euc-kr"), ("f.txt", french, "windows-1252"), ("u.txt", korean, "utf-8")):
        (tmp_path / name).write_bytes(text.encode(encoding))
    for options in (BatchOptions(), BatchOptions(max_concurrent=2)):
        found = {r["doc_id"].rsplit("/", 1)[1]: r["text"] for r in batch.process_directory(spark, str(tmp_path), options=options).texts.collect()}
        assert found == {"k.txt": korean, "e.txt": korean, "f.txt": french, "u.txt": korean}
    told = batch.process_directory(spark, str(tmp_path), "k.txt", options=BatchOptions(encoding="CP949")).texts.first()
    assert (told["text"], told["encoding"]) == (korean, "cp949")
    rows = spark.createDataFrame([(str(tmp_path / "k.txt"), 9, "euc-kr"), (str(tmp_path / "u.txt"), 9, None), (str(tmp_path / "f.txt"), 9, "no such")], "path string, length long, encoding string")
    by = {r["doc_id"].rsplit("/", 1)[1]: (r["text"], r["error"]) for r in reader.read_texts(spark, rows).collect()}
    assert by == {"k.txt": (korean, None), "u.txt": (korean, None), "f.txt": (None, "unknown encoding no such")}
    with pytest.raises(ConfigurationError):
        batch.process_directory(spark, str(tmp_path), options=BatchOptions(encoding="no such"))


def test_legacy_charset(spark, tmp_path):
    (tmp_path / "k.txt").write_bytes("갑: 안녕".encode("euc-kr"))
    assert reader.read_texts(spark, [str(tmp_path / "k.txt")], "euc-kr").first()["text"] == "갑: 안녕"


def test_config(tmp_path, spark):
    path = tmp_path / "c.yaml"
    path.write_text("colloquy:\n  version: '2'\n  speakers:\n  - {id: s, name: Ann, aliases: [A]}\n  - {id: t, name: Bob, aliases: [A]}\n  analysis_period: {start: 2025-06-01, end: 2025-12-31}\n  depth: {x: 3}\n")
    found = config.load(path)
    assert found.speaker_by_name("A").id == "s"
    assert found.speaker_by_name("a") is None
    assert (found.get("analysis_period.end"), found.get("depth.x"), found.get("none.x", 7)) == ("2025-12-31", 3, 7)
    assert found.speaker_table(spark).count() == 2
    assert config.load(tmp_path / "missing.yaml") == config.Configuration()
    assert config.current(path) is config.current(path)
    before = config.current(path)
    path.write_text("version: '3'")
    assert config.current(path) is before and config.reload(path).version == "3"
    path.write_text("analysis_period: {start: 2025-13-01, end: 2025-12-31}")
    with pytest.raises(ConfigurationError):
        config.load(path)


def test_long_lists_of_paths_are_read_in_turns(spark, tmp_path, monkeypatch):
    """No read gets more paths than the driver is to hold; files, missing ones and empty ones come out as from one list."""
    from pyspark.sql import DataFrameReader

    from colloquy.sources import reader

    paths = [str(tmp_path / f"{i} [x]{{y}}.txt") for i in range(23)]
    for i, path in enumerate(paths):
        if i % 5 < 4:
            Path(path).write_text(f"text {i}" if i % 7 else "")
    at_once = {tuple(r) for r in reader.read_texts(spark, paths).collect()}
    asked, load = [], DataFrameReader.load
    monkeypatch.setattr(DataFrameReader, "load", lambda self, path=None, *a, **k: asked.append(len(path)) or load(self, path, *a, **k))
    monkeypatch.setattr(reader, "PATHS", 4, raising=False)
    assert {tuple(r) for r in reader.read_texts(spark, paths).collect()} == at_once
    assert len(asked) > 1 and max(asked) <= 4
    assert {r[4] is not None for r in at_once} == {True, False} and len(at_once) == 23
