import os
import random

import pytest
from pyspark.sql import functions as F

from parenlake.functions.hashing import fnv1a64, fnv1a64_all
from parenlake.operators import rewrites as W
from parenlake.sources import versions as V

FILES = "file_id long, path string, dialect string, text string"


def corpus(spark, **texts):
    return spark.createDataFrame([(k, name, "common-lisp", text) for k, (name, text) in enumerate(texts.items())], FILES)


def texts(df):
    return {r.path: r.text for r in df.collect()}


def test_versions_change_remove_and_roll_back(spark, tmp_path):
    root = f"file://{tmp_path}/corpus"
    assert V.latest(spark, root) == 0 and V.history(spark, root).count() == 0
    with pytest.raises(ValueError, match="no version"):
        V.read(spark, root)
    assert V.commit(corpus(spark, a="(tide 1)", b="(tide 2)", c="(tide 3)"), root, 0) == 1
    assert V.commit(corpus(spark, b="(ebb 2)", d="(ebb 4)"), root, 1, removed=spark.createDataFrame([("c",)], "path string")) == 2
    assert texts(V.read(spark, root)) == {"a": "(tide 1)", "b": "(ebb 2)", "d": "(ebb 4)"}
    assert texts(V.read(spark, root, 1)) == {"a": "(tide 1)", "b": "(tide 2)", "c": "(tide 3)"}
    assert V.commit(corpus(spark, c="(flood 3)"), root, 2) == 3
    assert texts(V.read(spark, root))["c"] == "(flood 3)"
    assert V.roll_back(spark, root, 1, 3) == 4 and texts(V.read(spark, root)) == texts(V.read(spark, root, 1))
    assert V.commit(corpus(spark, e="()"), root, 4, whole=True) == 5 and texts(V.read(spark, root)) == {"e": "()"}
    told = {r.version: (r.changed, r.removed, r.tables) for r in V.history(spark, root).collect()}
    assert told == {1: (3, 0, 1), 2: (2, 1, 2), 3: (1, 0, 3), 4: (3, 0, 1), 5: (1, 0, 1)}


def test_of_two_writers_one_wins(spark, tmp_path, monkeypatch):
    root = f"file://{tmp_path}/corpus"
    V.commit(corpus(spark, a="1"), root, 0)
    V.commit(corpus(spark, a="2"), root, 1)
    with pytest.raises(V.Stale):  # known before anything is written
        V.commit(corpus(spark, a="3"), root, 1)
    # A writer that saw version 1 as the last one until it published.
    monkeypatch.setattr(V, "latest", lambda spark, root: 1)
    with pytest.raises(V.Stale):
        V.commit(corpus(spark, a="3"), root, 1)
    monkeypatch.undo()
    assert texts(V.read(spark, root)) == {"a": "2"} and V.latest(spark, root) == 2
    assert len(os.listdir(tmp_path / "corpus/data")) == 2
    assert sorted(n for n in os.listdir(tmp_path / "corpus/records") if not n.startswith(".")) == ["000000000001", "000000000002"]


def test_a_writer_lost_before_it_publishes_changes_nothing(spark, tmp_path, monkeypatch):
    root = f"file://{tmp_path}/corpus"
    V.commit(corpus(spark, a="1"), root, 0)

    def lost(*_):
        raise KeyboardInterrupt

    monkeypatch.setattr(V, "_publish", lost)
    with pytest.raises(KeyboardInterrupt):
        V.commit(corpus(spark, a="2"), root, 1)
    monkeypatch.undo()
    assert V.latest(spark, root) == 1 and texts(V.read(spark, root)) == {"a": "1"}
    assert V.commit(corpus(spark, a="3"), root, 1) == 2 and texts(V.read(spark, root)) == {"a": "3"}


def test_paths_of_a_commit_differ(spark, tmp_path):
    root = f"file://{tmp_path}/corpus"
    for bad in (corpus(spark, a="1").unionByName(corpus(spark, a="2")), corpus(spark, a="1").withColumn("path", F.lit(None).cast("string"))):
        with pytest.raises(ValueError, match="null or comes twice"):
            V.commit(bad, root, 0)
    assert V.latest(spark, root) == 0


def test_a_manifest_is_committed_against_its_version(spark, tmp_path):
    root = f"file://{tmp_path}/corpus"
    V.commit(corpus(spark, a="(defun haul (x) x) (haul 1)", b="(print 2)"), root, 0)
    manifest = W.preview(V.read(spark, root), "rename-symbol", from_="haul", to="tow")
    assert W.commit_manifest(manifest, root, 1) == 2
    assert texts(V.read(spark, root)) == {"a": "(defun tow (x) x) (tow 1)", "b": "(print 2)"}
    assert V.history(spark, root).filter("version = 2").first().changed == 1
    with pytest.raises(ValueError, match="preview-again"):  # its texts have changed since
        W.commit_manifest(manifest, root, 2)


def test_many_edits_of_one_text(spark):
    rng = random.Random(8)
    text = "".join(rng.choice("aä∘ \n") for _ in range(20_000)).encode()
    whole = [k for k in range(len(text) + 1) if k == len(text) or text[k] & 0xC0 != 0x80]
    at = sorted(rng.sample(whole, 4000))
    edits = [(1, a, b, rng.choice(["", "x", "ü", None])) for a, b in zip(at[::2], at[1::2])] + [(1, 0, 0, "first ")]
    want, done = b"", 0
    for _, a, b, new in sorted(edits, key=lambda e: e[1:3]):
        want, done = want + text[done:a] + (new or "").encode(), b
    sources = spark.createDataFrame([(1, "a", "unknown", text.decode()), (2, "b", "unknown", "(left)"), (3, "c", "unknown", None)], FILES)
    got = W.apply_edits(sources, spark.createDataFrame(edits, "file_id long, start long, end long, replacement string"))
    assert got.columns == sources.columns
    assert texts(got) == {"a": (want + text[done:]).decode(), "b": "(left)", "c": None}


def test_hashes_of_many_texts():
    rng = random.Random(9)
    for n in (0, 1, 15, 16, 40, 300):
        some = [rng.randbytes(rng.choice([0, 1, 7, 100, 900])) for _ in range(n)]
        assert fnv1a64_all(some) == [fnv1a64(t) for t in some]
    assert fnv1a64(b"") == "fnv1a64:cbf29ce484222325" and fnv1a64(b"a") == "fnv1a64:af63dc4c8601ec8c"
