from __future__ import annotations

import pytest

from gritstone.functions import lexical as L

CASES = {
    "javascript": ("// it('no')\nconst s = \"it('no')\";\ndescribe('x', () => {\n  it('adds', () => {});\n  test.only(`b ${c}`, f);\n  exit('no');\n  test.each([[1, (2)]])(\"each\", f);\n});\n", ["adds", "b ${c}", "each"]),
    "python": ('"""\ndef test_no(): pass\n"""\ndef test_a():\n    pass\nclass T:\n    async def test_b(self): pass\n# def test_c():\n', ["test_a", "test_b"]),
    "go": ("package a\n\nfunc TestAdd(t *testing.T) {}\nfunc Testing() {}\nfunc BenchmarkX(b *testing.B) {}\nvar s = `\nfunc TestNo(t) {}\n`\n", ["TestAdd", "BenchmarkX"]),
    "rust": ('#[test]\nfn one() {}\n#[tokio::test]\n#[ignore]\nasync fn two() {}\nfn three() {}\nlet s = r#"\n#[test]\nfn no() {}"#;\n', ["one", "two"]),
    "java": ("class A {\n  @Test\n  @DisplayName(\"x\")\n  void adds() {}\n  // @Test void no() {}\n  @ParameterizedTest(name = \"a(b)\") public static void each(int a) {}\n  @Before void b() {}\n}\n", ["adds", "each"]),
    "kotlin": ("@Test fun `adds up`() {}\n@Test\nprivate fun b() {}\n", ["adds up", "b"]),
    "scala": ('test("one") { }\n"a list" should "be" in { }\n"two" in { }\n', ["one", "a list", "two"]),
    "groovy": ("def \"adds #a\"() { }\n@Test\nvoid b() {}\n", ["adds #a", "b"]),
    "c": ("void test_add(void) {\n}\nvoid test_no(void);\nSTART_TEST(check_it)\n{\n}\n", ["test_add", "check_it"]),
    "cpp": ("TEST(Suite, Adds) {}\nTEST_F(Suite, Subs) {}\nTEST_CASE(\"free\") {}\n/* TEST(A, No) {} */\n", ["Adds", "Subs", "free"]),
    "c_sharp": ("[Fact]\npublic void A() {}\n[Theory, InlineData(1)]\n[Trait(\"a\", \"b\")]\npublic async Task<int> B(int x) {}\n", ["A", "B"]),
    "ruby": ("it 'adds' do\nend\n# it 'no' do\ndef test_b\nend\nspecify(\"c\") { }\nobj.it 'no' do\n", ["adds", "test_b", "c"]),
    "php": ("<?php\npublic function testA() {}\n#[Test]\npublic function b(): void {}\nit('c', function () {});\n", ["testA", "b", "c"]),
    "lua": ("it('adds', function() end)\n-- it('no', function() end)\n", ["adds"]),
    "swift": ("func testA() {}\n@Test(\"x\") func b() {}\nfunc helper() {}\n", ["testA", "b"]),
    "zig": ("test \"adds\" {\n}\ntest name {\n}\n", ["adds", "name"]),
    "solidity": ("contract T {\n function testA() public {}\n function invariant_b() public {}\n function c() public {}\n}\n", ["testA", "invariant_b"]),
    "bash": ("@test \"adds\" {\n  run x\n}\n# @test \"no\" {\n", ["adds"]),
}
IMPORTS = {
    "javascript": ("import a from 'x';\nimport { b,\n c } from \"./y\";\nconst z = require('z');\n// import q from 'q'\nexport * from 'w';\nimport 'side';\nconst l = await import('lazy');\n", ["x", "./y", "z", "w", "side", "lazy"]),
    "python": ("import a.b as c\nfrom . import d\nfrom .e import f\n'''\nimport no\n'''\n", ["a.b", ".", ".e"]),
    "go": ('package a\n\nimport "fmt"\n\nimport (\n\tx "a/b"\n\t"c"\n)\n', ["fmt", "a/b", "c"]),
    "rust": ("use a::b;\npub use c::{d, e};\nuse f as g;\nmod h;\n// use no;\n", ["a::b", "c::{d, e}", "f", "h"]),
    "java": ("import a.B;\nimport static c.D.*;\n/* import no.X; */\n", ["a.B", "c.D.*"]),
    "c": ('#include <stdio.h>\n# include "own.h"\n// #include <no.h>\n', ["stdio.h", "own.h"]),
    "c_sharp": ("using A.B;\nusing X = C.D;\nusing static E;\n", ["A.B", "C.D", "E"]),
    "ruby": ("require 'a'\nrequire_relative(\"b\")\n# require 'no'\n", ["a", "b"]),
    "php": ("use A\\B as C;\nrequire_once 'x.php';\n", ["A\\B", "x.php"]),
    "lua": ("local a = require('b')\nrequire \"c\"\n", ["b", "c"]),
    "swift": ("@testable import A\nimport B.C\n", ["A", "B.C"]),
    "zig": ('const s = @import("std");\n', ["std"]),
    "solidity": ('import "./a.sol";\nimport {B} from "b.sol";\n', ["./a.sol", "b.sol"]),
    "kotlin": ("import a.b as c\nimport d.*\n", ["a.b", "d.*"]), "scala": ("import a.b.{c, d}\nimport e._\n", ["a.b.{c, d}", "e._"]), "bash": ("source ./a.sh\n. b.sh\n", ["./a.sh", "b.sh"]), "groovy": ("import a.B\n", ["a.B"]),
}


@pytest.mark.parametrize("language", sorted(CASES))
def test_cases_of(language):
    source, names = CASES[language]
    got = L.test_cases(source, language)
    assert [n for _, n in got] == names
    assert all(n.split("\n")[0][:4] in source.split("\n")[line - 1] for line, n in got)
    assert L.test_cases(source.replace("\n", "\r\n"), language) == got and L.test_cases(None, language) == [] and L.test_cases("", language) == []


@pytest.mark.parametrize("language", sorted(IMPORTS))
def test_imports_of(language):
    source, modules = IMPORTS[language]
    assert [m for _, m, _ in L.imports(source, language)] == modules


def test_aliases_and_calls():
    assert L.imports("import a.b as c\n", "python") == [(1, "a.b", "c")] and L.imports('import (\n\tx "a"\n)\n', "go") == [(2, "a", "x")]
    source = "def f(a):\n    # g(1)\n    if (h(a.b.c(2))): return 'k(3)'\n    return self.m (\n        1)\n"
    assert L.calls(source, "python") == [(3, "h"), (3, "a.b.c"), (4, "self.m")]
    assert L.calls("func (t *T) f() { g(); x.Y() }\n", "go") == [(1, "g"), (1, "x.Y")] and L.calls("fn a() { b::c(); d!(); }", "rust") == [(1, "b::c"), (1, "d!")]


def test_tables(spark):
    rows = [(1, "a.kt", None, CASES["kotlin"][0]), (1, "a.kt", None, CASES["kotlin"][0]), (2, "b", "C#", "using A;\n"), (3, "c.txt", None, "it('x')"), (None, "d.py", None, "def test_a(): pass"), (4, "e.py", "Python", None), (5, "f.h", "cpp", "TEST(A, b) { run(1); }" + " " * 100_000)]
    df = spark.createDataFrame(rows, "file_id long, path string, language string, source string")
    assert sorted((r.file_id, r.line, r.name) for r in L.file_test_cases(df).collect()) == [(1, 1, "adds up"), (1, 3, "b"), (5, 1, "b")]
    assert [(r.file_id, r.module, r.alias) for r in L.file_imports(df).collect()] == [(2, "A", None)]
    assert ("run" in {r.name for r in L.file_calls(df).collect()}) and L.file_calls(df.limit(0)).collect() == []
