import os

import pytest
from pyspark.sql import functions as F

from parenlake.sources import corpus as C
from parenlake.sources import walk as K


def laid(root, *paths):
    for path in paths:
        target = root / path
        target.parent.mkdir(parents=True, exist_ok=True)
        target.write_text(f"(file {path})")


def rows(found, root):
    return {(os.path.relpath(r.path, root), r.kind, r.skipped) for r in found.collect() if r.kind == "file" or r.skipped}


@pytest.mark.parametrize("budget", [1, 10_000])
def test_a_walk_skips_and_counts(spark, tmp_path, budget):
    laid(tmp_path, "a.lisp", "b.txt", ".hid.lisp", ".cfg/x.lisp", "build/y.lisp", "out/z.lisp", "old/deep/w.lisp", "older/v.scm", "p/q/r/s.clj")
    os.symlink(tmp_path / "out", tmp_path / "link")
    os.symlink(tmp_path / "a.lisp", tmp_path / "link.lisp")
    os.mkfifo(tmp_path / "pipe.lisp")
    found = K.walked(spark, [str(tmp_path)], exclude=(f"{tmp_path}/old", f"{tmp_path}/old/deep"), budget=budget)
    assert rows(found, tmp_path) == {
        ("a.lisp", "file", None), ("b.txt", "file", "unknown"), (".hid.lisp", "file", "hidden"), (".cfg", "folder", "hidden"), ("build", "folder", "generated"), ("out/z.lisp", "file", None),
        ("old", "folder", "excluded"), ("older/v.scm", "file", None), ("p/q/r/s.clj", "file", None), ("link", "symlink", "symlink"), ("link.lisp", "symlink", "symlink"),
    }
    # Skipped folders are never listed.
    assert {os.path.relpath(r.path, tmp_path) for r in found.filter("entries IS NOT NULL").collect()} == {".", "out", "older", "p", "p/q", "p/q/r"}
    told = K.walk_summary(found).first()
    assert (told.files, told.skipped_unknown, told.skipped_hidden, told.skipped_generated, told.skipped_symlink, told.skipped_excluded) == (4, 1, 2, 1, 2, 1)
    assert told.entries == 12 + 1 + 1 + 1 + 1 + 1 and told.bytes == sum(len(f"(file {p})") for p in ("a.lisp", "out/z.lisp", "older/v.scm", "p/q/r/s.clj"))
    texts = {os.path.relpath(r.path, tmp_path): r.text for r in K.contents(found).collect()}
    assert texts == {p: f"(file {p})" for p in ("a.lisp", "out/z.lisp", "older/v.scm", "p/q/r/s.clj")}


def test_roots_and_depths(spark, tmp_path):
    laid(tmp_path, "a.lisp", "in/b.lisp", "in/in/c.lisp")
    os.symlink(tmp_path / "in", tmp_path / "way")
    names = lambda *roots, **more: sorted(os.path.relpath(r.path, tmp_path) for r in K.walked(spark, [str(tmp_path / r) for r in roots], **more).filter("kind = 'file' AND skipped IS NULL").collect())
    assert names(".") == names(".", "in", "in/in", "./") == ["a.lisp", "in/b.lisp", "in/in/c.lisp"]
    assert [names(".", max_depth=d) for d in range(3)] == [[], ["a.lisp"], ["a.lisp", "in/b.lisp"]]
    assert names(".", "in", max_depth=1) == ["a.lisp", "in/b.lisp"] and names(".", "in", max_depth=2) == ["a.lisp", "in/b.lisp", "in/in/c.lisp"]
    assert names("a.lisp") == ["a.lisp"] and names("way") == [] and names("way", "in") == ["in/b.lisp", "in/in/c.lisp"]
    assert rows(K.walked(spark, [str(tmp_path / "way")]), tmp_path) == {("way", "symlink", "symlink")}
    with pytest.raises(FileNotFoundError):
        K.walked(spark, [str(tmp_path / "none")])
    files = spark.createDataFrame([("w/a.lisp", "common-lisp", "1"), ("w/in/b.lisp", "common-lisp", "2")], "path string, dialect string, text string")
    assert {r.path for r in C.discovered(files, "w", max_depth=1).collect()} == {"w/a.lisp"}


def test_files_are_written_below_their_folder_and_bounded(spark, tmp_path):
    files = spark.createDataFrame([("x/a.lisp", "(ä)\r\n"), ("b.el", None)], "path string, text string")
    K.write_files(files, str(tmp_path))
    K.write_files(files, str(tmp_path))
    found = K.walked(spark, [str(tmp_path)])
    assert {(os.path.relpath(r.path, tmp_path), r.dialect, r.text) for r in K.contents(found).collect()} == {("x/a.lisp", "common-lisp", "(ä)\r\n"), ("b.el", "emacs-lisp", "")}
    with pytest.raises(Exception, match="more than 3 bytes"):
        K.contents(found, max_file_bytes=3).collect()
    with pytest.raises(Exception, match="outside"):
        K.write_files(files.limit(1).replace("x/a.lisp", "../a.lisp"), str(tmp_path))
    listed = C.admitted(found.filter("kind = 'file' AND skipped IS NULL").select("path", "bytes"), max_files=1)
    assert {(os.path.basename(r.path), r.status) for r in listed.collect()} == {("b.el", "admitted"), ("a.lisp", "breaks-limit")}


def test_an_excluded_folder_is_found_by_its_components(tmp_path):
    index = K.exclude_index((f"{tmp_path}/a/b", f"{tmp_path}/a/b/c", f"{tmp_path}/a/d"))
    said = {p: K.excluded(index, f"{tmp_path}/{p}") for p in ("a", "a/b", "a/b/x/y", "a/bc", "a/d", "z")}
    assert said == {"a": False, "a/b": True, "a/b/x/y": True, "a/bc": False, "a/d": True, "z": False}
    assert not K.excluded({}, "/a")


def test_files_of_one_folder_are_dealt_out(spark, tmp_path):
    """One task lists a folder; several write and read its files, many at a time."""
    made = spark.range(400).coalesce(1).select(F.concat(F.lit("x/"), "id", F.lit(".lisp")).alias("path"), F.concat(F.lit("(f "), "id", F.lit(")")).alias("text"))
    K.write_files(made, str(tmp_path))
    read = K.contents(K.walked(spark, [str(tmp_path)]))
    assert {(os.path.relpath(r.path, tmp_path), r.text) for r in read.collect()} == {(f"x/{k}.lisp", f"(f {k})") for k in range(400)}
    assert read.select(F.spark_partition_id().alias("p")).distinct().count() > 1
