from __future__ import annotations

import ast

import pytest
from pyspark.sql import functions as F

from gritstone.llm import grammars, peg, syntax

VALID = {
    "python": ["", "x = 1", "\ufeffx = 1\r\n", "def f(a, /, b: int = 3, *c, d=4, **e) -> int:\n  '''doc'''\n  return a if b else [i async for i in c]\n", "with (open(a) as f, b):\n\tpass", "match x:\n  case {'a': [1, *r], **k} if k: pass\n  case A(b=1) | None: y = 2", "@a.b(1)\nclass X(Y, z=1):\n  x: int\n  y: str = 'a' 'b'", "print(f'{x!r:>{w}}', end='')", "lambda *a, k=1: (yield)", "try:\n  a\nexcept* E as e:\n  b\nelse:\n  c\nfinally:\n  d", "x = [\n  1,  # one\n]\nif x: y; z"],
    "javascript": ["", "#!/usr/bin/env node\nlet a = /[/]\\//g, b = `x${a ? `y${b}` : '}'}z`", "export default async function* f({a, b: [c] = [], ...d}, ...e) { for await (const x of y) yield* x }", "class A extends B { static #x = 1; get y() { return this.#x } async *[z](a = 1) {} }", "label: for (;;) { break label }\nvar a = b\n++c", "x?.y?.[1]?.(2) ?? z ** 2", "if (a) b; else if (c) d\nelse { }", "import a, { b as c } from 'd'; export * as e from \"f\"", "new Foo.Bar(1)(2), (a, b) => ({ c: a })", "switch (a) { case 1: default: b() }"],
    "typescript": ["function f<T extends A = B>(this: X, a?: number, ...b: T[]): a is string { return a as any }", "interface A<T> extends B, C<T> { readonly [k: string]: T; f?(x: number): void; new (x: T): A<T> }", "type A = { [K in keyof B]?: C<K> } | (new () => D) & [a: string, ...b: E[]]", "abstract class A implements B { constructor(private readonly x: number) { super() } abstract f(): void; declare y: string }", "enum A { B = 1, 'C' }\ndeclare module 'x' { export const y: number }", "const a = <T,>(x: T): T => x!; let b = c satisfies D", "export type { A } from './a'; import type B from './b'"],
    "java": ["", "package a.b; import static c.D.*; @A(b = {1, 2}) public final class X<T extends Y & Z> extends W implements V { int[] a = {1, 2}, b[]; X() throws E { this(1); } <U> U f(final int... x) { return (U) x; } }", "record P(int x, String... y) { P { } static int z = 1; }", "enum E implements I { A(1) { void f() { } }, B; E(int... x) { } }", "class A { void f() { for (int i = 0, j = 1; i < j; i++) { } for (var x : y) { } Runnable r = () -> { }; Object o = a > b ? (x) -> x : B::new; switch (o) { case String s when s.isEmpty() -> { } default -> throw new E(); } } }", "interface I { default int f() { return 1 >>> 2; } @interface J { String v() default \"\"; } }", 'class A { String s = """\n  "x" \\""" y\n  """; char c = \'\\\'\'; }'],
    "go": ["package a\n", "package a\n\nimport (\n\t\"b\"\n\tc \"d\"\n)\n\nfunc (r *R[T]) F(a, b int, c ...string) (x int, err error) {\n\tif v, ok := m[a]; ok {\n\t\treturn v, nil\n\t} else if a > b {\n\t\tdefer func() { recover() }()\n\t}\n\tfor i := range 10 {\n\t\tgo f(i)\n\t}\n\treturn\n}\n", "package a\ntype A struct {\n\tB\n\tc, d int `json:\"c\"`\n}\nvar x = []A{{1, 2}, A{c: 3}}\nconst (\n\ta = iota\n\tb\n)\n", "package a\nfunc f() {\n\tswitch x := y.(type) {\n\tcase int, *T:\n\tdefault:\n\t}\n\tselect {\n\tcase v := <-c:\n\t\t_ = v\n\t}\nL:\n\tfor {\n\t\tbreak L\n\t}\n}\n", "package a\nfunc M[K comparable, V int | ~string](m map[K]V) chan<- V { return nil }"],
    "rust": ["", "#![allow(x)]\nuse a::{b, c::*, self as d};\npub(crate) struct A<'a, T: B + 'a>(pub T, &'a str) where T: C;\nimpl<'a, T> D for A<'a, T> { type E = F; const G: u8 = b'x'; fn h(&mut self, (a, b): (i32, u8)) -> Result<T, Box<dyn E>> { let Some(x) = y else { return Err(z)? }; Ok(x) } }", "fn f() { match x { A::B { c, .. } if c > 1 => {} 1..=2 | 3 => (), _ => unreachable!(), } }", "fn f() { let v = vec![1; 2]; let c = move |a: i32, _| -> i32 { a + 1 }; 'o: loop { break 'o; } for i in 0..n { x.y::<u8>()[i] += 1 } if let Some(a) = b && c { } }", "macro_rules! m { ($a:expr) => { $a }; }\nm! { x y }\nstatic S: &str = r#\"a \"b\" c\"#;", "pub enum A { B(u8), C { d: u8 } = 2 }\nunsafe extern \"C\" { fn f(a: *const u8, ...); }", "/* a /* b */ c */ const A: [u8; 2] = [0x1f, 1_000u8];"],
    "c": ["", "#include <a.h>\n#define X(a) \\\n  ((a) + 1)\nstatic inline const char *f(int a, char **b, ...) { return a ? b[0] : \"x\" \"y\"; }", "struct A { int x : 3; union { long y; } z; } a = { .x = 1, .z = { .y = 2 } };\ntypedef int (*F)(void *, size_t);\nenum E { P = 1, Q };", "int main(void) { for (int i = 0; i < 3; i++) { if (!x->y[i]) continue; } do { z(); } while (0); switch (a) { case 1: b = (long) c; break; default: ; } goto out; out: return sizeof(int) + sizeof x; }", "long f(a, b) int a; long b; { return a; }", "T *x, y[3] = {[0] = 1}; __attribute__((noreturn)) void g(void);"],
    "ruby": ["", "# frozen_string_literal: true\nrequire \"json\"\nmodule A\n  class B < C::D\n    attr_reader :x, :y\n    def initialize(a, b = 1, *c, d:, e: 2, **f, &g)\n      @x = a if b\n    rescue E, F => e\n      raise \"no #{e.message}\" unless g\n    ensure\n      z\n    end\n  end\nend\n", "x = [1, 2].map { |a, (b, c)| a + b }.select do |y|\n  y > 1 && !y.nil?\nend", "case x\nwhen 1, 2 then :a\nelse\n  y ? 'b' : \"c\"\nend", "a, *b = c\nh = { a: 1, 'b' => 2, **d }\nputs h[:a], x unless y\nwhile i < 3\n  i += 1\nend", "s = <<~EOS\n  text #{x}\nEOS\nt = %w[a b]\nr = x =~ /a.b/i", "def self.f = 1\ndef ==(o)\n  o\nend\nfoo.bar&.baz\n  .qux(1)\n-> (x) { x }"],
}
BROKEN = {
    "python": ["def f(:\n  pass", "x = (1", "if x:\npass", "<<<<<<< HEAD\nx = 1\n=======\nx = 2\n>>>>>>> a\n", "x = 'a", "def f():\n  x\n   y", "x = 1 +", "function f() { }", "a b", "x = \x01"],
    "javascript": ["function f( { }", "let x: number = 1", "a b", "if (x { }", "x = 'a", "class A { x y }", "def f(a):\n  return a", "{ \"a\": 1, \"b\": 2 }", "f(1,,2)", "`a"],
    "typescript": ["function f(a: ) { }", "interface A { x: }", "let x = ;", "pub fn f() { }", "class A { f(a: number)): void { } }"],
    "java": ["class A { void f( { } }", "int f() { return 1; }", "class A { int x = ; }", "class A {", "package a\nimport \"log\"", "class A { void f() { x y z; } }"],
    "go": ["package a\nfunc f( {\n}\n", "func f() { }", "package a\nfunc f() {\n\tx := \n}\n", "package a;\nclass A { }", "package a\nvar x = \"a\n"],
    "rust": ["fn f( { }", "fn f() { let x = ; }", "struct A { x }", "package a;", "fn f() -> { }", "fn f() { x y }"],
    "c": ["int f( { }", "int x = ;", "int f(void) { return 1 }", "## Title", "package a;\nimport b.c;", "int f(void) {", "def f(a):\n  return a"],
    "ruby": ["def f(\n  1\nend", "class A\n  def b\n  end", "x = [1, 2", "x = 1 +", "<html></html>", "end", "if x\n  y"],
}


@pytest.mark.parametrize(("language", "source"), [(k, s) for k, v in VALID.items() for s in v])
def test_valid(language, source):
    assert grammars.check_source(source, language) is None
    if language == "python":
        ast.parse(source.removeprefix("\ufeff"))


@pytest.mark.parametrize(("language", "source"), [(k, s) for k, v in BROKEN.items() for s in v])
def test_broken(language, source):
    failure = grammars.check_source(source, language)
    assert failure is not None and failure[1] >= 1
    if language == "python":
        with pytest.raises((SyntaxError, ValueError)):
            ast.parse(source)


def test_line_ends_are_no_errors():
    for language, sources in VALID.items():
        for s in sources:
            assert grammars.check_source(s.replace("\n", "\r\n"), language) is None
            assert grammars.check_source("\ufeff" + s.removeprefix("\ufeff"), language) is None or language == "javascript" and s.startswith("#!")


def test_causes_and_lines():
    assert grammars.check_source("x = 1\n<<<<<<< a\ny = 2\n=======\n", "python")[:2] == ("merge conflict", 2)
    assert grammars.check_source("int f(void) {\n  return 1;\n", "c")[0] == "truncated"
    cause, line, message = grammars.check_source("a = 1\nb = = 2\n", "python")
    assert (cause, line) == ("unexpected token", 2) and "'='" in message


def test_content_memo_changes_nothing():
    """A stretch known from another text is taken over only where nothing behind it was looked at."""
    lexer, grammar, fix = grammars.parser_of("javascript")
    one, two = "function f(a) { return a; }\n", "function f(a) { return a; }\n.x"
    for _ in range(3):
        assert grammars.check_source(one * 3, "javascript") is None
        assert grammars.check_source("let y = function f(a) { return a; }\n.x", "javascript") is None
        assert grammars.check_source(two, "javascript") is not None


def test_peg_by_hand():
    g = peg.Grammar("File <- List EOF  List <- '(' Item* ')'  Item <- List / ID", peg.Kinds("", "( )"))
    assert g.parse("(i(i)i)") is None and g.parse("(i(i)") == (5, {"(", ")", "id"})
    with pytest.raises(ValueError):
        peg.Grammar("File <- Nothing", peg.Kinds("", ""))


def test_verdicts_and_rates(spark):
    rows = [(1, "r", "a.py", None, "x = (", "2025-01-01", 5), (1, "r", "a.py", "py", "x = 1", "2025-02-01", 5), (2, "r", "b.js", "JavaScript", "let x = ;", None, 5), (3, "r", "c.unknown", None, "(", None, 5), (4, "r", "d.go", "go", None, None, 5), (5, "r", "e.c", "c", "", None, 5), (None, "r", "f.c", "c", "(", None, 5)]
    df = spark.createDataFrame(rows, "file_id long, repo string, path string, language string, source string, received_at string, valid int").withColumn("received_at", F.to_timestamp("received_at"))
    got = {r.file_id: r.valid for r in syntax.syntax_verdicts(df).collect()}
    assert got == {1: True, 2: False, 3: None, 4: None, 5: True}
    rates = {(r.language): (r.files, r.broken, r.share) for r in syntax.syntax_rates(syntax.syntax_verdicts(df)).collect()}
    assert rates == {"python": (1, 0, 0.0), "javascript": (1, 1, 1.0), "c": (1, 0, 0.0)}
    assert syntax.syntax_verdicts(df.limit(0)).count() == 0


def test_long_text():
    assert grammars.check_source("x = [" + "1, " * 200_000 + "]", "python") is None
    assert grammars.check_source("x = " + "(" * 3000 + ")" * 3000, "python") is None


@pytest.mark.parametrize(
    ("language", "form"),
    [("javascript", "x = {}1{};\n()"), ("typescript", "x = {}1{};\n[]"), ("java", "class A {{ int x = {}1{}; }}\n()"), ("go", "package a\nvar x = {}1{}\n()"), ("rust", "fn f() {{ let x = {}1{}; }}\n()"), ("c", "int x = {}1{};\n()"), ("python", "x = {}1{}\n[]"), ("ruby", "x = {}1{}\n[]")],
)
def test_deep_nesting(language, form):
    form, opens, closes = form[:-2], form[-2], form[-1]
    for n in (100, 5000):
        assert grammars.check_source(form.format(opens * n, closes * n), language) is None
        assert grammars.check_source(form.format(opens * n, closes * (n - 1)), language) is not None


def test_too_deep_is_unknown(spark, monkeypatch):
    monkeypatch.setattr(grammars.Grammar, "_run", lambda self: self._run())
    rows = [r for r in syntax._judge([__import__("pandas").DataFrame([{"file_id": 1, "repo": "r", "path": "a.go", "language": "go", "source": "package a\n", "received_at": None}])])]
    assert rows[0].valid.tolist() == [None] and rows[0].cause.tolist() == ["too deep"]


@pytest.mark.parametrize("depth", [1, 3, 5, 40])
def test_nested_templates(depth):
    t = "`a${b}\n`"
    for _ in range(depth):
        t = "`x${f(" + t + ", {k: '`'}, /`/)} y`"
    assert grammars.check_source(f"const a = {t};\nlet b = 2;\n", "typescript") is None
    cause, line, _ = grammars.check_source(f"const a = {t};\nlet b = = 2;\n", "typescript")
    assert (cause, line) == ("unexpected token", 3)
    assert grammars.check_source(f"const a = {t[:-2]};\nlet b = 2;\n", "typescript") is not None
