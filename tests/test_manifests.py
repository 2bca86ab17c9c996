from __future__ import annotations

import subprocess

import pytest
from pyspark.sql import functions as F

from gritstone.sources import manifests as M
from gritstone.sources import readers


def test_remotes_and_modules(spark):
    urls = {"https://github.com/a/b.git": ("github.com", "a/b"), "git@GitLab.com:g/sub/p.git": ("gitlab.com", "g/sub/p"), "ssh://git@h.x:22/a/b/": ("h.x", "a/b"), "https://u:p@h/a/b": ("h", "a/b"), "host:a/b": ("host", "a/b"), "/local/path": None, "https://h/a/../b": None, "https://h": None, "": None}
    rows = spark.createDataFrame([(u,) for u in urls], "u string").select("u", M.remote_name(F.col("u")).alias("r")).collect()
    assert {r.u: r.r and tuple(r.r) for r in rows} == urls
    mods = spark.createDataFrame([("a/go.mod", "// x\nmodule example.com/m\n\ngo 1.20\n"), ("go.mod", 'module "q"\n'), ("b/go.mod", "go 1\n")], "p string, t string")
    assert [r.x and tuple(r.x) for r in mods.select(M.go_module(F.col("p"), F.col("t")).alias("x")).collect()] == [("example.com/m", "a"), ("q", ""), None]
    assert M.cargo_crate("c/Cargo.toml", '[package]\nname = "my-crate"\n') == ("my_crate", "c/src/lib.rs") and M.cargo_crate("Cargo.toml", '[package]\nname="a"\n[lib]\nname = "b"\npath = "x.rs"\n') == ("b", "x.rs")
    assert M.cargo_crate("Cargo.toml", "[workspace]\n") is None and M.cargo_crate("Cargo.toml", "= broken") is None


def test_project_files():
    assert M.ignored_globs("ignore:\n  - 'a/** '\n", "f") == ["a/**"] and M.ignored_globs(None, "f") == [] and M.scan_types("scan_types: [ Defect, lint]", "f") == ["defect", "lint"] and M.scan_types("", "f") is None
    for bad in ("ignore: a", "ignore: [1]", "- a"):
        with pytest.raises(ValueError):
            M.ignored_globs(bad, "f")
    with pytest.raises(ValueError):
        M.scan_types("scan_types: x", "f")
    assert M.settings('a = "1" # x\n\n# c\nb = \'2\'\n', ["a", "b", "c"], {"b": "9", "z": "0", "c": ""}) == {"a": "1", "b": "9"}
    for bad in ("a = 1", 'z = "1"', 'a = ""', 'a = "1"\na = "2"'):
        with pytest.raises(ValueError):
            M.settings(bad, ["a"])


def test_hits_and_nodes(spark):
    lines = spark.createDataFrame([("3\ta::b::t1",), ("3\ta::b::t1",), ("4\tc::t2",), ("5\tx::dup",), ("bad",), ("6\tnone",)], "line string")
    names = spark.createDataFrame([("f::b::t1", "b::t1"), ("g::t1", "t1"), ("h::t2", "t2"), ("i", "dup"), ("j", "dup")], "test string, name string")
    assert {(r.id, r.test) for r in M.switch_hits(lines, names).collect()} == {("3", "f::b::t1"), ("4", "h::t2")}
    cases = spark.createDataFrame([("tests.unit.test_a.TestX", "test_b"), ("tests.unit.test_a", "test_c"), ("gone.x", "t")], "classname string, name string")
    tree = spark.createDataFrame([("tests/unit/test_a.py",), ("tests/unit.py",)], "path string")
    assert {r.node for r in M.case_node(cases, tree).collect()} == {"tests/unit/test_a.py::TestX::test_b", "tests/unit/test_a.py::test_c"}


def test_git_in_tasks(spark, tmp_path):
    root = str(tmp_path)
    run = lambda *a: subprocess.run(["git", "-C", root, *a], check=True, capture_output=True)
    run("init", "-q")
    for i in range(300):
        (tmp_path / f"f{i} é.txt").write_text(f"text {i}\n")
    run("add", ".")
    run("-c", "user.name=x", "-c", "user.email=x@y", "commit", "-qm", "m")
    tree = readers.git_tree(spark, root)
    assert tree.count() == 300 and {(r.path, r.text) for r in readers.git_blobs(tree, root).collect()} == {(f"f{i} é.txt", f"text {i}\n") for i in range(300)}
    gone = tree.limit(1).withColumn("sha", F.lit("0" * 40))
    assert [r.text for r in readers.git_blobs(gone, root).collect()] == [None]
    with pytest.raises(RuntimeError):
        readers.git_tree(spark, root, "nowhere")
    assert readers.blob_size(b"abc blob 12\n") == 12
    for bad in (b"abc tree 1\n", b"abc blob 99999999999999999999\n", b""):
        with pytest.raises(ValueError):
            readers.blob_size(bad)
