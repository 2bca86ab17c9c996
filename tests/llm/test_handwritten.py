from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from gritstone.llm import handwritten as H

SCHEMA = "file_id long, repo string, path string, language string, source string, received_at timestamp, kind string"
HAND = "import os\n\ndef load(path):\n    total = 0\n    for row in open(path):\n        total += len(row)\n    return total\n\ndef store(rows, path):\n    with open(path, 'w') as out:\n        out.writelines(rows)\n"


def body(seed):
    r = random.Random(seed)
    name = lambda: "_".join("".join(r.choice("bdklmnrst") + r.choice("aeiou") for _ in range(3)) for _ in range(2))
    return "\n\n".join(f"def {name()}({name()}, limit):\n    kept = [x for x in {name()} if x > {r.randint(1, 99)}]\n    return {name()}(kept)[:limit + {r.randint(1, 99)}]" for _ in range(6)) + "\n"


def kinds(spark, rows, **how):
    df = spark.createDataFrame([(*r, None, "") for r in rows], SCHEMA)
    return {r.file_id: r.kind for r in H.classify_files(df, **how).collect()}


GENERATED = "".join(f"def get_field_{i}(m):\n    return m[0] if m[0] is not None else {i * 37}\n\n" for i in range(12))
MINIFIED = "var a=1;" + "function b(c,d){return c>d?c*2:b(c+1,d-1)}" * 30
NAMES = ["".join(random.Random(i).choices("bcdfglmnrstaeiou", k=9)) for i in range(80)]
TABLE = "X = {\n" + "".join(f'    "{NAMES[i]}": [{i * 7}, "{NAMES[i + 40]}"],\n' for i in range(40)) + "}\n"
DATA = "X = (\n" + "\n".join(f'    "{random.Random(i).getrandbits(360):090x}"' for i in range(20)) + "\n)\n"


@pytest.mark.parametrize(
    ("path", "source", "kind"),
    [
        ("a.py", HAND, "hand-written"), ("vendor/generated.min.py", HAND, "hand-written"), ("a.py", "# Code generated by x. DO NOT EDIT.\n" + HAND, "generated"), ("a.py", GENERATED, "generated"),
        ("a.py", "# Reads what the code generator writes; edit freely.\n" + HAND, "hand-written"), ("a.py", "X = '# Code generated by x. DO NOT EDIT.'\n" + HAND, "hand-written"), ("a.js", MINIFIED, "minified"),
        ("a.js", "const q = '" + "select a from b where c " * 40 + "';\n" + "function f(a) {\n  return a;\n}\n" * 3, "hand-written"), ("a.py", DATA, "data"), ("a.py", "", "hand-written"), ("a.c", "static int t[] = {" + "0x1f, " * 400 + "1};\n", "data"),
        ("a.py", "# Copied verbatim from foo 1.2.\n" + HAND, "vendored"), ("a.rb", "#\n" * 60 + "# @generated\nputs 'x'\n", "generated"), ("a.py", TABLE, "data"), ("a.py", TABLE + HAND, "hand-written"), ("a.py", "X = [1, 2]\n", "hand-written"),
    ],
)
def test_one_file(path, source, kind):
    g, m, d, v, _, _ = H.file_traits(source, __import__("gritstone.functions.lexing", fromlist=["x"]).language_of(None, path))
    assert ("generated" if g else "minified" if m else "data" if d else "vendored" if v else "hand-written") == kind


def test_unmarked_copies_and_hand_copies(spark):
    lib, own = body(1), body(2)
    mark = "# Vendored from the foo project.\n"
    rows = [(1, "r1", "x/foo.py", "python", mark + lib), (2, "r2", "src/bar.py", "python", lib.replace("\n", "\r\n")), (3, "r1", "a.py", "python", own), (4, "r2", "b.py", "python", own), (5, "r3", "c.py", "python", own + "\n\n" + lib.split("\n\n")[0])]
    assert kinds(spark, rows) == {1: "vendored", 2: "vendored", 3: "hand-written", 4: "hand-written", 5: "hand-written"}


def test_common_paragraphs_make_no_copy(spark):
    common = "def shared_helper_of_everyone(value):\n    return [value for _ in range(value) if value]\n"
    mark = "# Vendored from the foo project.\n"
    rows = [(0, "r", "x.py", "python", mark + common + "\n" + body(3))] + [(i, "r", f"y{i}.py", "python", common + "\n" + body(10 + i)) for i in range(1, 12)] + [(20, "r", "z.py", "python", common)]
    got = kinds(spark, rows)
    assert got.pop(0) == "vendored" and set(got.values()) == {"hand-written"}


def test_attribute_files(spark):
    rows = [
        (90, "r", ".gitattributes", None, "gen/** linguist-generated\n*.lock linguist-vendored=true # x\nlib/*.py linguist-vendored\n"), (91, "r", "gen/keep/.gitattributes", None, "*.py -linguist-generated\n/b.py linguist-generated=true\n"),
        (1, "r", "gen/a.py", "python", HAND), (2, "r", "gen/keep/a.py", "python", GENERATED), (3, "r", "gen/keep/b.py", "python", HAND), (4, "other", "gen/a.py", "python", HAND), (5, "r", "lib/z.py", "python", body(7)), (6, "other", "own/z.py", "python", body(7)),
    ]
    assert kinds(spark, rows) == {1: "generated", 2: "hand-written", 3: "generated", 4: "hand-written", 5: "vendored", 6: "vendored"}


def test_dirty_rows(spark):
    rows = [(1, None, None, None, None), (2, "r", "x.unknown", "cobol", "MOVE A TO B."), (None, "r", "a.py", "python", GENERATED), (3, "r", "a.py", "python", HAND), (3, "r", "a.py", "python", HAND), (4, "r", "b.py", None, "value = 100\n" * 100_000)]
    assert kinds(spark, rows) == {1: "hand-written", 2: "hand-written", 3: "hand-written", 4: "generated"}
    assert kinds(spark, []) == {}


def test_many_unmarked_copies_of_one_file(spark):
    lib = body(21)
    rows = [(0, "r", "x/foo.py", "python", "# Vendored from the foo project.\n" + lib)] + [(i, f"r{i}", "foo.py", "python", lib) for i in range(1, 31)] + [(40, "r", "own.py", "python", body(22))]
    assert kinds(spark, rows) == {i: "vendored" for i in range(31)} | {40: "hand-written"}


LICENCE = "# Permission is granted to use and change this text.\n" * 60
LONG = "".join(map(body, range(30, 34)))


@pytest.mark.parametrize(
    ("language", "source", "generated", "vendored"),
    [
        ("python", LICENCE + "# Code generated by x. DO NOT EDIT.\n" + HAND, True, False), ("python", LONG + "# This file was generated by x.\n", True, False), ("c", "/*\n" + " * Permission is granted.\n" * 60 + " * Automatically generated by x.\n */\nint a;\n", True, False),
        ("python", LICENCE + "# Vendored from the foo project.\n" + HAND, False, True), ("python", LONG + "# Reads tokens generated by the lexer.\n", False, False), ("python", LONG + "    x = 1  # generated by the caller\n", False, False),
        ("python", LONG + "X = '''\n# Code generated by x. DO NOT EDIT.\n'''\n", False, False), (None, "      * Code generated by x. DO NOT EDIT.\n       MOVE A TO B.\n", True, False), (None, LONG + "      * Code generated by x. DO NOT EDIT.\n", True, False),
        (None, "; foo 1.2 - vendored from the foo project\n", False, True), (None, "DISPLAY 'Code generated by x'.\n", False, False),
    ],
)
def test_marks_anywhere(language, source, generated, vendored):
    g, _, _, v, _, _ = H.file_traits(source, language)
    assert (g, v) == (generated, vendored)


def test_attributes_of_the_latest_delivery(spark):
    rows = [
        (90, "r", ".gitattributes", None, "a.py linguist-generated\n", 1), (91, "r", ".gitattributes", None, '[attr]made linguist-generated\n"b c.py" made\nd.py linguist-vendored\nd.py !linguist-vendored\n', 2),
        (1, "r", "a.py", "python", HAND, 1), (2, "r", "b c.py", "python", HAND, 1), (3, "r", "d.py", "python", HAND, 1), (4, "r", "b", "python", HAND, 1),
    ]
    df = spark.createDataFrame(rows, "file_id long, repo string, path string, language string, source string, n int").withColumn("received_at", F.col("n").cast("timestamp"))
    assert {r.file_id: r.kind for r in H.classify_files(df).collect()} == {1: "hand-written", 2: "generated", 3: "hand-written", 4: "hand-written"}


def declaring():
    """Three repositories that declare, two that do not; what lies under ``gen/`` or ends in ``_pb2.py`` is generated, ``deps/`` vendored."""
    rows = [(900 + r, f"r{r}", ".gitattributes", None, "gen/** linguist-generated\n*_pb2.py linguist-generated\ndeps/** linguist-vendored\n") for r in range(3)]
    near = "".join(f"def get_{NAMES[i]}(m):\n    return m.{NAMES[i + 20]} or {i}\n\n" + f"def field_{i}(m):\n    return m[{i}]\n\n" for i in range(20))
    for r in range(5):
        for k, (path, source) in enumerate((("gen/a.py", body(100 + r)), ("x/b_pb2.py", body(200 + r)), ("deps/lib.py", body(300 + r)), ("own/c.py", body(400 + r)), ("own/d.py", body(500 + r)), ("gen/near.py", near))):
            rows.append((r * 10 + k, f"r{r}", path, "python", source))
    return rows


def test_path_patterns_mined_from_repositories_that_declare(spark):
    got = kinds(spark, declaring(), names_decide=True)
    want = {0: "generated", 1: "generated", 2: "vendored", 3: "hand-written", 4: "hand-written", 5: "generated"}
    assert got == {r * 10 + k: kind for r in range(5) for k, kind in want.items()}


def test_a_mined_name_alone_is_no_case(spark):
    got = kinds(spark, declaring())
    assert all(got[r * 10 + k] == "hand-written" for r in (3, 4) for k in range(5))
    # the text is repetitive, less than would decide by itself
    assert H._text_traits(declaring()[8][4], "python")[2] > H.DISTINCT_SHARE and got[35] == got[45] == "generated"
    assert {got[r * 10] for r in range(3)} == {"generated"} and {got[r * 10 + 2] for r in range(3)} == {"vendored"}


def test_marks_mined_from_what_travels(spark):
    """Libraries are copied to several repositories, some copies under a mark no list knows; it tells a library seen once."""
    mark = "# Kept as delivered from the attic; lib {}.\n\n"
    rows = [(i * 10 + r, f"r{r}", f"p{i}.py", "python", mark.format(NAMES[i]) + body(600 + i)) for i in range(18) for r in range(3)]
    rows += [(1100, "r9", "one.py", "python", mark.format("rare") + body(700)), (1101, "r8", "copy.py", "python", body(601)), (1102, "r8", "own.py", "python", "# Kept in order.\n\n" + body(701))]
    got = kinds(spark, rows)
    assert got.pop(1102) == "hand-written" and set(got.values()) == {"vendored"} and len(got) == 56
