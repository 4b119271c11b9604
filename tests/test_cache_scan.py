"""Cache folders are looked into by the tasks, each for itself."""

from corpusforge.sources import caches


def test_a_folder_has_its_own_files_only(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(caches, "FOLDERS_A_TASK", 2)
    for name in ("a", "a/b", "b", "c", "d", "e"):
        (tmp_path / name).mkdir()
    (tmp_path / "a/b/meta.json").write_text('{"workspace": "/nested"}')
    (tmp_path / "c/meta.json").write_text('{"workspace": "/usr", "filesIndexed": 3}')
    (tmp_path / "c/server.lock.json").write_text('{"pid": 7}')
    (tmp_path / "d/meta.json").write_bytes(b'{"workspace": "\xff"}')
    (tmp_path / "d/server.lock.json").write_text('{"pid": 8}')
    (tmp_path / "file").write_text("no folder")
    rows = {r["cache_id"]: r for r in caches.scan_caches(spark, f"file://{tmp_path}/", lambda pid: pid == 7).collect()}
    assert sorted(rows) == ["a", "b", "c", "d", "e"]
    assert [n for n, r in rows.items() if r["has_meta"]] == ["c"]
    assert [n for n, r in rows.items() if r["is_active"]] == ["c"]
    assert (rows["c"]["workspace"], rows["c"]["files_indexed"], rows["c"]["workspace_exists"]) == ("/usr", 3, True)
    assert rows["e"]["last_activity_ms"] == rows["e"]["dir_mtime_ms"] == (tmp_path / "e").stat().st_mtime_ns // 1_000_000
