from __future__ import annotations

from gritstone.operators import selection
from gritstone.sources import changes as C

DIFF = """diff --git a/a.py b/a.py
index 1..2 100644
--- a/a.py
+++ b/a.py
@@ -1,5 +1,6 @@ head
 one
-two
+TWO
+more
 three
 four
 five
@@ -20,3 +21,2 @@
 x
--- not a header
 y
diff --git a/old.py b/new.py
--- a/old.py
+++ b/new.py
@@ -3 +3 @@
-a
+b
\\ No newline at end of file
diff --git a/gone.py b/gone.py
--- a/gone.py
+++ /dev/null
@@ -1,2 +0,0 @@
-a
-b
diff --git a/add.py b/add.py
--- /dev/null
+++ "b/\\303\\244 x.py"
@@ -0,0 +1,2 @@
+a
+b
"""


def test_hunks():
    got = C.hunks_of(DIFF)
    assert [r[:8] for r in got] == [("a.py", "a.py", 0, 1, 5, 1, 6, [2, 3]), ("a.py", "a.py", 1, 20, 3, 21, 2, [22]), ("new.py", "old.py", 0, 3, 1, 3, 1, [3]), ("ä x.py", None, 0, 0, 0, 1, 2, [1, 2])]
    assert got[1][8].endswith("--- not a header\n y") and got[2][8].endswith("end of file") and C.hunks_of(None) == [] and C.hunks_of("") == []
    assert C.hunks_of("--- a/x\n+++ b/x\n@@ -4,2 +3,0 @@\n-a\n-b\n")[0][7] == [4]


def test_units_of_a_change(spark):
    found = C.hunks(spark.createDataFrame([("c1", DIFF), ("c2", None)], "change string, diff string"))
    assert {(r.path, r.old_path, r.added, r.lines) for r in C.changed_files(found).collect()} == {("a.py", "a.py", False, 3), ("new.py", "old.py", False, 1), ("ä x.py", None, True, 2)}
    units = [("f", "a.py", 1, 2, None), ("g", "a.py", 4, 21, None), ("h", "a.py", 22, 500, None), ("top", "a.py", 1, 500, [1, 21]), ("top2", "a.py", 1, 500, [2]), ("n", "new.py", 3, 3, None), ("z", "zz.py", 1, 9, None)]
    df = spark.createDataFrame(units, "id string, path string, line int, end_line int, own array<int>")
    assert {r.id for r in C.changed_units(found, df).collect()} == {"f", "h", "top2", "n"}
    assert {(r.path, r.first, r.last) for r in C.before_window(found).collect()} == {("a.py", 1, 26), ("new.py", 1, 7), ("ä x.py", 1, 3)}


def test_files_by_manifest_and_attribute(spark):
    paths = ["web/x.csproj", "web/bin/a.cs", "web/src/bin/a.cs", "bin/a.cs", "web/obj/deep/b.cs", "mix.exs", "deps/a.ex", "sub/deps/a.ex", "game/ProjectSettings/ProjectVersion.txt", "game/Library/a.cs", "Library/a.cs", "env/pyvenv.cfg", "env/lib/a.py", "node_modules/p/x.csproj", "node_modules/p/bin/q", "a.min.js", "pkg/bin"]
    rows = [("r", p, None, None) for p in paths] + [("s", "web/bin/a.cs", None, None)]
    df = spark.createDataFrame(rows, "repo string, path string, source string, received_at timestamp")
    want = {("r", p) for p in ("web/x.csproj", "web/src/bin/a.cs", "bin/a.cs", "mix.exs", "sub/deps/a.ex", "game/ProjectSettings/ProjectVersion.txt", "Library/a.cs", "pkg/bin")} | {("s", "web/bin/a.cs")}
    assert {(r.repo, r.path) for r in selection.select_files(df).collect()} == want
    said = [("r", ".gitattributes", "web/bin/** -linguist-vendored\nmix.exs linguist-generated\n", None)]
    both = df.union(spark.createDataFrame(said, df.schema))
    got = {(r.repo, r.path) for r in selection.select_files(both).collect()}
    assert got == (want - {("r", "mix.exs")}) | {("r", "web/bin/a.cs"), ("r", ".gitattributes")}
