"""Parse-time tables that need no syntax tree: test cases, suites, imports and called names of source files in many languages.

One regular expression per language walks a text: comments and literals are consumed whole, so that nothing inside them counts,
and the forms sought are tried before literals, as the name of a test often is one.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache

import pandas as pd
from pyspark.sql import DataFrame

from gritstone.functions import lexing, text

_DQ, _SQ, _BQ = r'"(?:[^"\\\n]|\\[\s\S])*"', r"'(?:[^'\\\n]|\\[\s\S])*'", r"`(?:[^`\\]|\\[\s\S])*`"
_BLOCK, _LINE, _HASH, _DASH = r"/\*(?:[^*]|\*(?!/))*\*/", r"//[^\n]*", r"\#[^\n]*", r"--(?:\[\[[\s\S]*?\]\]|[^\n]*)"
_TRIPLE = r'"""[\s\S]*?"""|\'\'\'[\s\S]*?\'\'\''
_STRING = f"(?:{_DQ}|{_SQ}|{_BQ})"

# Comments and literals by language.
_COMMENTS = {"python": _HASH, "ruby": rf"^=begin\b[\s\S]*?^=end\b|{_HASH}", "bash": _HASH, "lua": _DASH}
_LITERALS = {"python": f"{_TRIPLE}|{_DQ}|{_SQ}", "go": f"{_DQ}|`[^`]*`", "rust": f'r(?P<h>\\#*)"[\\s\\S]*?"(?P=h)|{_DQ}', "zig": f"{_DQ}|\\\\\\\\[^\\n]*", "kotlin": f"{_TRIPLE}|{_DQ}", "scala": f"{_TRIPLE}|{_DQ}", "java": f"{_TRIPLE}|{_DQ}", "groovy": f"{_TRIPLE}|{_DQ}|{_SQ}"}

_MODIFIERS = r"(?:(?:public|private|protected|internal|open|override|static|final|virtual|async|suspend|abstract|synchronized|unsafe)\s+)*"
_NOTES = r"(?:\s*@[\w.]+(?:\((?:[^()]|\([^()]*\))*\))?)*"
_JUNIT = rf"@(?:[\w.]+\.)?(?:Test|ParameterizedTest|RepeatedTest|TestFactory|TestTemplate)\b(?:\((?:[^()]|\([^()]*\))*\))?{_NOTES}\s*{_MODIFIERS}"

# Test cases by language: ``name`` is a word or a literal. Forms of public test frameworks.
_CASES = {
    "javascript": rf"(?<![\w.$])(?:it|test|specify)(?:\.(?:only|skip|concurrent|failing|todo|each\((?:[^()]|\([^()]*\))*\)))*\(\s*(?P<name>{_STRING})",
    "python": r"^[ \t]*(?:async[ \t]+)?def[ \t]+(?P<name>test\w*)[ \t]*\(",
    "go": r"^func\s+(?P<name>(?:Test|Benchmark|Example|Fuzz)(?![a-z])\w*)\s*\(",
    "rust": r"\#\[(?:\w+::)*(?:test|rstest|test_case)(?:\([^\]]*\))?\](?:\s*\#\[[^\]]*\])*\s*(?:pub(?:\([^)]*\))?\s+)?(?:async\s+)?fn\s+(?P<name>\w+)",
    "java": rf"{_JUNIT}(?:<[^>]*>\s*)?[\w.<>\[\], ?]+\s+(?P<name>\w+)\s*\(",
    "kotlin": rf"{_JUNIT}fun\s+(?P<name>\w+|`[^`\n]+`)\s*\(",
    "scala": rf"\b(?:test|it|they)\s*\(\s*(?P<name>{_DQ})|(?P<name2>{_DQ})\s+(?:in|should\s+{_DQ}\s+in)\s*\{{|{_JUNIT}def\s+(?P<name3>\w+)",
    "groovy": rf"\bdef\s+(?P<name>{_DQ}|{_SQ})\s*\(\s*\)|{_JUNIT}(?:void|def)\s+(?P<name2>\w+)\s*\(",
    "c": r"\bvoid\s+(?P<name>test_?\w+)\s*\([^;{]*\)\s*\{|\b(?:START_TEST|Test|TEST)\s*\(\s*(?P<name2>\w+)\s*(?:,\s*\w+\s*)?\)\s*\{?",
    "cpp": rf"\b(?:TEST|TEST_F|TEST_P|TYPED_TEST|TYPED_TEST_P)\s*\(\s*\w+\s*,\s*(?P<name>\w+)\s*\)|\b(?:TEST_CASE|SCENARIO|TEST_CASE_METHOD\s*\(\s*\w+\s*,|BOOST_AUTO_TEST_CASE)\s*\(?\s*(?P<name2>{_DQ}|\w+)",
    "c_sharp": rf"\[(?:\w+\.)*(?:Fact|Theory|Test|TestMethod|DataTestMethod|TestCase)\b(?:\((?:[^()]|\([^()]*\))*\))?[^\]]*\](?:\s*\[[^\]]*\])*\s*{_MODIFIERS}[\w.<>\[\]?]+\s+(?P<name>\w+)\s*\(",
    "ruby": rf"(?<![\w.:])(?:it|specify|example|scenario|test|should)[ \t(]+(?P<name>{_DQ}|{_SQ})[^\n]*?(?:\bdo\b|\{{)|^[ \t]*def[ \t]+(?P<name2>test_\w+[?!]?)",
    "php": rf"\bfunction\s+(?P<name>test\w+)\s*\(|\#\[Test\b[^\]]*\]\s*{_MODIFIERS}function\s+(?P<name2>\w+)|(?<![\w>$:])(?:it|test)\s*\(\s*(?P<name3>{_DQ}|{_SQ})",
    "lua": rf"(?<![\w.:])(?:it|test|spec)\s*\(?\s*(?P<name>{_DQ}|{_SQ})\s*,\s*function",
    "swift": rf"\bfunc\s+(?P<name>test\w*)\s*\(|@Test\b(?:\((?:[^()]|\([^()]*\))*\))?\s*{_MODIFIERS}func\s+(?P<name2>\w+)",
    "zig": rf"^[ \t]*test\s+(?P<name>{_DQ}|\w+)\s*\{{",
    "solidity": r"\bfunction\s+(?P<name>(?:test|invariant|statefulFuzz)\w*)\s*\(",
    "bash": rf"^[ \t]*@test[ \t]+(?P<name>{_DQ}|{_SQ})[ \t]*\{{",
}
_CASES["typescript"] = _CASES["tsx"] = _CASES["javascript"]

# Imports by language: ``module`` and, where it is written, ``alias``.
_IMPORTS = {
    "javascript": rf"(?:^[ \t]*(?:import|export)\b(?:[^'\";()]*?\bfrom)?\s*|\b(?:require|import)\s*\(\s*)(?P<module>{_DQ}|{_SQ})",
    "python": r"^[ \t]*(?:from[ \t]+(?P<module>\.*[\w.]*)[ \t]+import\b|import[ \t]+(?P<module2>[\w.]+)(?:[ \t]+as[ \t]+(?P<alias>\w+))?)",
    "go": rf"(?:^import[ \t]+|^\t+)(?:(?P<alias>[\w.]+)[ \t]+)?(?P<module>{_DQ})[ \t]*$",
    "rust": r"^[ \t]*(?:pub(?:\([^)]*\))?[ \t]+)?(?:use[ \t]+(?P<module>[\w:]+(?:::\{[^}]*\}|::\*)?)(?:[ \t]+as[ \t]+(?P<alias>\w+))?|mod[ \t]+(?P<module2>\w+))[ \t]*;",
    "java": r"^[ \t]*import[ \t]+(?:static[ \t]+)?(?P<module>[\w.]+(?:\.\*)?)[ \t]*;",
    "kotlin": r"^[ \t]*import[ \t]+(?P<module>\w+(?:\.\w+)*(?:\.\*)?)(?:[ \t]+as[ \t]+(?P<alias>\w+))?",
    "scala": r"^[ \t]*import[ \t]+(?P<module>\w+(?:\.\w+)*(?:\.\{[^}]*\}|\._)?)",
    "c": r"^[ \t]*\#[ \t]*include[ \t]*(?P<module>[<\"][^>\"\n]+[>\"])",
    "c_sharp": r"^[ \t]*(?:global[ \t]+)?using[ \t]+(?:static[ \t]+)?(?:(?P<alias>\w+)[ \t]*=[ \t]*)?(?P<module>[\w.]+)[ \t]*;",
    "ruby": rf"^[ \t]*(?:require|require_relative|load|autoload)[ \t(]+(?P<module>{_DQ}|{_SQ})",
    "php": rf"^[ \t]*use[ \t]+(?P<module>[\w\\]+)(?:[ \t]+as[ \t]+(?P<alias>\w+))?[ \t]*;|\b(?:require|include)(?:_once)?[ \t(]+(?:__DIR__[ \t]*\.[ \t]*)?(?P<module2>{_DQ}|{_SQ})",
    "lua": rf"\brequire[ \t(]+(?P<module>{_DQ}|{_SQ})",
    "swift": r"^[ \t]*(?:@testable[ \t]+)?import[ \t]+(?P<module>[\w.]+)",
    "zig": rf"@import[ \t]*\([ \t]*(?P<module>{_DQ})",
    "solidity": rf"^[ \t]*import\b[^;'\"]*(?P<module>{_DQ}|{_SQ})",
    "bash": r"^[ \t]*(?:source|\.)[ \t]+(?P<module>[\"']?[\w./${}-]+[\"']?)",
}
_IMPORTS["cpp"] = _IMPORTS["c"]
_IMPORTS["typescript"] = _IMPORTS["tsx"] = _IMPORTS["javascript"]
_IMPORTS["groovy"] = _IMPORTS["java"].replace("[ \\t]*;", "")

# Words before a bracket that call nothing. Public keywords.
_KEYWORDS = frozenset(
    "if for while switch catch return function def fn func elif else match with in not and or assert del lambda print except sizeof new throw await yield typeof instanceof do case select defer go when until unless super this self synchronized using lock foreach let var const".split()
)
_CALL = r"(?P<name>[^\W\d][\w]*(?:(?:\.|::|->)[^\W\d]\w*)*[?!]?)\s*\("
_DECLARED = re.compile(r"\b(?:def|fn|func|function|class|interface|struct|enum)[ \t]+(?:\([^)]*\)[ \t]*)?$")

ROW = "file_id long, line int, name string"
IMPORT = "file_id long, line int, module string, alias string"


def language_of(language: str | None, path: str | None) -> str | None:
    """The language by its name, however spelt, else by the path's extension."""
    name = (language or "").strip().lower().lstrip(".").replace("#", "_sharp").replace("++", "pp")
    name = lexing.SPELLINGS.get(name, name)
    if name in _CASES:
        return name
    base = (path or "").rsplit("/", 1)[-1]
    return text.EXTENSIONS.get(base.rsplit(".", 1)[-1].lower()) if "." in base else None


@cache
def _walker(language: str, forms: str) -> re.Pattern:
    comments = _COMMENTS.get(language, f"{_LINE}|{_BLOCK}" + (f"|{_HASH}" if language == "php" and "Test" not in forms else ""))
    if language in ("c", "cpp", "rust"):
        comments = f"{_LINE}|{_BLOCK}"
    return re.compile(f"(?P<comment>{comments})|(?P<form>{forms})|(?P<literal>{_LITERALS.get(language, f'{_DQ}|{_SQ}|{_BQ}')})", re.M)


def _bare(name: str) -> str:
    return name[1:-1] if len(name) > 1 and name[0] in "\"'`<" and name[-1] in "\"'`>" else name


def _found(source: str, language: str, forms: str) -> Iterator[tuple[int, re.Match]]:
    body = lexing.clean(source)
    line, at = 1, 0
    for m in _walker(language, forms).finditer(body):
        if m["form"] is None:
            continue
        groups = [g for g, v in m.groupdict().items() if v is not None and g.startswith(("name", "module"))]
        start = m.start(groups[0]) if groups else m.start()
        line += body.count("\n", at, start)
        at = start
        yield line, m


def _first(m: re.Match, group: str) -> str | None:
    held = m.groupdict()
    return next((held[g] for g in (group, f"{group}2", f"{group}3") if held.get(g) is not None), None)


def test_cases(source: str | None, language: str | None) -> list[tuple[int, str]]:
    """``(line, name)`` of every test case of a source, in order."""
    if not source or language not in _CASES:
        return []
    return [(line, _bare(_first(m, "name") or "")) for line, m in _found(source, language, _CASES[language])]


test_cases.__test__ = False


def imports(source: str | None, language: str | None) -> list[tuple[int, str, str | None]]:
    """``(line, module, alias)`` of every import of a source, in order."""
    if not source or language not in _IMPORTS:
        return []
    return [(line, _bare(_first(m, "module") or ""), m.groupdict().get("alias")) for line, m in _found(source, language, _IMPORTS[language])]


def calls(source: str | None, language: str | None) -> list[tuple[int, str]]:
    """``(line, name)`` of every called name of a source, keywords and declarations left out."""
    if not source or language not in _CASES:
        return []
    body = lexing.clean(source)
    out = []
    for line, m in _found(source, language, _CALL):
        name = m["name"]
        before = body[max(0, m.start() - 200) : m.start()]
        if name not in _KEYWORDS and not _DECLARED.search(before.rsplit("\n", 1)[-1]):
            out.append((line, name))
    return out


def _table(function, schema: str):
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(file_id, *row) for file_id, path, language, source in zip(pdf.file_id, pdf.path, pdf.language, pdf.source) for row in function(source, language_of(language, path))]
            yield pd.DataFrame(rows, columns=names)

    return run


def _files(files: DataFrame) -> DataFrame:
    return files.where("file_id IS NOT NULL AND source IS NOT NULL").select("file_id", "path", "language", "source")


def file_test_cases(files: DataFrame) -> DataFrame:
    """``(file_id, line, name)``: the test cases of ``files`` (``file_id``, ``path``, ``language``, ``source``), once each."""
    return _files(files).mapInPandas(_table(test_cases, ROW), ROW).distinct()


def file_imports(files: DataFrame) -> DataFrame:
    """``(file_id, line, module, alias)``: the imports of ``files``, once each."""
    return _files(files).mapInPandas(_table(imports, IMPORT), IMPORT).distinct()


def file_calls(files: DataFrame) -> DataFrame:
    """``(file_id, line, name)``: the called names of ``files``, once per line."""
    return _files(files).mapInPandas(_table(calls, ROW), ROW).distinct()
