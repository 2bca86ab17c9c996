from __future__ import annotations

from gritstone.functions import parsing
from gritstone.operators import resolution


def test_candidates():
    assert parsing.python_candidates("a/b/c.py", "..x.y") == ["a/x/y.py", "a/x/y/__init__.py"] and parsing.python_candidates("c.py", "...x") == []
    assert "src/p/q.py" in parsing.python_candidates("c.py", "p.q")
    assert parsing.script_candidates("a/b.js", "../x")[:2] == ["x", "x.js"] and parsing.script_candidates("a.js", "react") == [] and "y.ts" in parsing.script_candidates("a.js", "./y.js")


SOURCES = {
    "pkg/a.py": "from .b import helper as h, Tool\nimport pkg.c as c\nimport os\n\nclass A:\n    def run(self):\n        self.step()\n        h()\n        c.deep()\n        Tool.make()\n        os.remove('x')\n        local()\n    def step(self):\n        self.step()\n\ndef local():\n    def inner():\n        pass\n    inner()\n",
    "pkg/b.py": "def helper():\n    pass\n\nclass Tool:\n    def make():\n        pass\n",
    "pkg/c.py": "def deep():\n    pass\n",
    "pkg/__init__.py": "",
}


def test_cascade(spark):
    files = spark.createDataFrame([(i, p, s) for i, (p, s) in enumerate(SOURCES.items())], "file_id long, path string, source string")
    paths = files.select("file_id", "path")
    methods = parsing.python_methods(files).join(paths, "file_id").select("id", "path", "qualified_name")
    calls = parsing.python_calls(files).join(paths, "file_id")
    imports = resolution.resolve_imports(parsing.python_imports(files), paths, parsing.module_candidates("python"))
    got = {(r.caller, r.name): (r.target, r.how) for r in resolution.resolve_calls(methods, calls, imports).collect()}
    run = "pkg/a.py::A.run"
    assert got == {
        (run, "self.step"): ("pkg/a.py::A.step", "file"), (run, "h"): ("pkg/b.py::helper", "import"), (run, "c.deep"): ("pkg/c.py::deep", "import"), (run, "Tool.make"): ("pkg/b.py::Tool.make", "import"),
        (run, "os.remove"): (None, "external"), (run, "local"): ("pkg/a.py::local", "file"), ("pkg/a.py::local", "inner"): ("pkg/a.py::local.inner", "file"),
    }


def test_overrides_and_marks(spark):
    methods = spark.createDataFrame([("A.f", "A", "f"), ("B.f", "B", "f"), ("C.f", "C", "f"), ("C.g", "C", "g")], "id string, owner string, name string")
    bases = spark.createDataFrame([("B", "A"), ("C", "B"), ("A", "C")], "child string, base string")
    assert ("A.f", "C.f") in {tuple(r) for r in resolution.overrides(methods, bases).collect()}
    units = spark.createDataFrame([("p", 1, 4, "covered"), ("p", 2, 3, "gap")], "path string, line int, end_line int, state string")
    assert {(r.line, r.state) for r in resolution.line_marks(units).collect()} == {(1, "covered"), (2, "gap"), (3, "gap"), (4, "covered")}
    pairs = spark.createDataFrame([(1, "a"), (1, "a"), (2, "a"), (2, "b")], "k int, v string")
    assert [tuple(r) for r in resolution.unique_match(pairs, "k", "v").collect()] == [(1, "a")]
