"""Table functions over Python sources by the interpreter's own syntax tree: methods, calls, tests, and mutants."""

from __future__ import annotations

import ast
import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gritstone.functions import lexing

# What an operator becomes in a mutant; fixed values.
BOUNDARY = {ast.Lt: "<=", ast.LtE: "<", ast.Gt: ">=", ast.GtE: ">", ast.Eq: "!=", ast.NotEq: "=="}
ARITHMETIC = {ast.Add: "-", ast.Sub: "+", ast.Mult: "/", ast.Div: "*", ast.Mod: "*", ast.FloorDiv: "*"}
WRITTEN = {ast.Lt: "<", ast.LtE: "<=", ast.Gt: ">", ast.GtE: ">=", ast.Eq: "==", ast.NotEq: "!=", ast.Add: "+", ast.Sub: "-", ast.Mult: "*", ast.Div: "/", ast.Mod: "%", ast.FloorDiv: "//", ast.And: "and", ast.Or: "or"}

METHODS = "file_id long, id string, name string, qualified_name string, line int, end_line int, params array<string>, decorators array<string>, test boolean, hash string, complexity int, nesting int"
CALLS = "file_id long, caller string, name string, line int"
MUTANTS = "file_id long, method string, mutant string, line int, col int, kind string, original string, mutated string"

_FUNC = (ast.FunctionDef, ast.AsyncFunctionDef)
_BRANCH = (ast.If, ast.For, ast.AsyncFor, ast.While, ast.ExceptHandler, ast.IfExp, ast.comprehension, ast.match_case)


def _tree(source: str | None):
    try:
        return ast.parse((source or "").removeprefix("﻿"))
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return None


def _functions(tree: ast.AST):
    """``(qualified name, node, class names)`` in order of the text; a name met again gets a number."""
    seen: dict[str, int] = {}
    todo: list[tuple[ast.AST, str, tuple[str, ...]]] = [(tree, "", ())]
    found = []
    while todo:
        node, prefix, classes = todo.pop()
        for child in ast.iter_child_nodes(node):
            if isinstance(child, ast.ClassDef):
                todo.append((child, f"{prefix}{child.name}.", (*classes, child.name)))
            elif isinstance(child, _FUNC):
                found.append((child.lineno, child.col_offset, f"{prefix}{child.name}", child, classes))
                todo.append((child, f"{prefix}{child.name}.", classes))
            else:
                todo.append((child, prefix, classes))
    for _, _, name, node, classes in sorted(found, key=lambda x: x[:3]):
        seen[name] = seen.get(name, 0) + 1
        yield name if seen[name] == 1 else f"{name}#{seen[name]}", node, classes


def _own(node: ast.AST):
    """The nodes of a function without those of functions in it."""
    todo = list(ast.iter_child_nodes(node))
    while todo:
        n = todo.pop()
        yield n
        if not isinstance(n, _FUNC):
            todo.extend(ast.iter_child_nodes(n))


def _nesting(node: ast.AST, depth: int = 0) -> int:
    best = depth
    for child in ast.iter_child_nodes(node):
        if isinstance(child, _FUNC):
            continue
        deeper = isinstance(child, (ast.If, ast.For, ast.AsyncFor, ast.While, ast.Try, ast.With, ast.AsyncWith, ast.Match))
        chained = isinstance(node, ast.If) and isinstance(child, ast.If) and node.orelse == [child]
        best = max(best, _nesting(child, depth + (deeper and not chained)))
    return best


def methods_of(file_id: int, path: str, source: str | None) -> list[tuple]:
    """Rows of ``METHODS``; a text that does not parse has none. A test is a module-level ``test*`` function of a test file, or a
    ``test*`` method of a class that is a test case by name or base."""
    tree = _tree(source)
    if tree is None:
        return []
    lines = (source or "").split("\n")
    cases = {n.name for n in ast.walk(tree) if isinstance(n, ast.ClassDef) and (n.name.startswith("Test") or any("TestCase" in ast.unparse(b) for b in n.bases))}
    base = path.rsplit("/", 1)[-1]
    test_file = base.startswith("test_") or base.removesuffix(".py").endswith("_test")
    rows = []
    for name, node, classes in _functions(tree):
        a = node.args
        params = [p.arg for p in (*a.posonlyargs, *a.args, *([a.vararg] if a.vararg else []), *a.kwonlyargs, *([a.kwarg] if a.kwarg else []))]
        test = node.name.startswith("test") and (bool(classes and classes[-1] in cases) or (not classes and test_file and "." not in name))
        body = "\n".join(lines[node.lineno - 1 : node.end_lineno])
        own = list(_own(node))
        complexity = 1 + sum(isinstance(n, _BRANCH) for n in own) + sum(len(n.values) - 1 for n in own if isinstance(n, ast.BoolOp))
        rows.append((file_id, f"{path}::{name}", node.name, name, node.lineno, node.end_lineno, params, [ast.unparse(d) for d in node.decorator_list], test, hashlib.sha256(body.encode()).hexdigest(), complexity, _nesting(node)))
    return rows


def calls_of(file_id: int, path: str, source: str | None) -> list[tuple]:
    """Rows of ``CALLS``: dotted names called in each function, dynamic targets as ``<dynamic>``."""
    tree = _tree(source)
    rows = []
    for name, node, _ in _functions(tree) if tree else ():
        for n in _own(node):
            if isinstance(n, ast.Call):
                target = ast.unparse(n.func)
                rows.append((file_id, f"{path}::{name}", target if target.replace(".", "").isidentifier() else "<dynamic>", n.lineno))
    return rows


#: Functions of the module for regular expressions whose first argument is one.
_REGEX_CALLS = frozenset(f"re.{n}" for n in "compile match fullmatch search sub subn split findall finditer".split())
_FLIPPED = {c: c.swapcase() for c in "dDwWsS"}


def regex_edits(pattern: str) -> list[str]:
    """What a regular expression can become by one edit, in the order of place: an anchor or a boundary dropped, a quantifier loosened
    or tightened, a class turned into its complement."""
    out = [pattern[1:]] if pattern.startswith("^") else []
    escaped_end = (len(pattern) - len(pattern[:-1].rstrip("\\"))) % 2 == 0 if pattern.endswith("$") else False
    if pattern.endswith("$") and not escaped_end:
        out.append(pattern[:-1])
    at = 0
    while at < len(pattern):
        c, before, after = pattern[at], pattern[at - 1] if at else "", pattern[at + 1 : at + 2]
        edit = None
        if c == "\\" and after:
            edit = (at + 1, 1, _FLIPPED[after]) if after in _FLIPPED else (at, 2, "") if after == "b" else None
            width = 2
        else:
            edit = (at, 1, "*") if c == "+" else (at, 1, "+") if c == "*" else (at, 1, "") if c == "?" and at and before not in "(+*?}" else (at + 1, 1, "") if c == "[" and after == "^" else None
            width = 1
        if edit:
            out.append(pattern[: edit[0]] + edit[2] + pattern[edit[0] + edit[1] :])
        at += width
    return out


def _emptied(node: ast.AST) -> str | None:
    """A literal collection that holds something, without it."""
    if isinstance(node, (ast.List, ast.Tuple, ast.Set)) and node.elts and isinstance(getattr(node, "ctx", ast.Load()), ast.Load):
        return {ast.List: "[]", ast.Tuple: "()", ast.Set: "set()"}[type(node)]
    return "{}" if isinstance(node, ast.Dict) and node.keys else None


def _text_of(body: list[ast.stmt]) -> str:
    return "\n".join(map(ast.unparse, body))


def _does_something(body: list[ast.stmt]) -> bool:
    return any(not isinstance(n, ast.Pass) for n in body)


def mutants_of(file_id: int, path: str, source: str | None) -> list[tuple]:
    """Rows of ``MUTANTS``: edits of operators, conditions, literals, collections, regular expressions, lambdas, returns, blocks and
    bodies, each named by its place, kind and edit."""
    tree = _tree(source)
    rows, seen = [], set()
    for name, node, _ in _functions(tree) if tree else ():
        docs = {id(n.value) for n in ast.walk(node) if isinstance(n, ast.Expr) and isinstance(n.value, ast.Constant)}

        def add(kind: str, at: ast.AST, original: str, mutated: str) -> None:
            key = (at.lineno, at.col_offset, kind, original, mutated)
            if original != mutated and key not in seen:
                seen.add(key)
                digest = hashlib.sha1(f"{original}>{mutated}".encode()).hexdigest()[:8]
                rows.append((file_id, f"{path}::{name}", f"{at.lineno}:{at.col_offset + 1}:{kind}:{digest}", at.lineno, at.col_offset + 1, kind, original, mutated))

        own_body = node.body[1:] if node.body and isinstance(node.body[0], ast.Expr) and id(node.body[0].value) in docs else node.body
        if own_body and _does_something(own_body):
            add("body", own_body[0], _text_of(own_body), "pass")
        for n in _own(node):
            if (empty := _emptied(n)) is not None:
                add("collection", n, ast.unparse(n), empty)
            elif isinstance(n, ast.Lambda):
                add("lambda", n.body, ast.unparse(n.body), "None")
            elif isinstance(n, ast.Call) and ast.unparse(n.func) in _REGEX_CALLS and n.args and isinstance(n.args[0], ast.Constant) and isinstance(n.args[0].value, str):
                for edit in regex_edits(n.args[0].value):
                    add("regex", n.args[0], n.args[0].value, edit)
            for body in (n.body, getattr(n, "orelse", [])) if isinstance(n, (ast.If, ast.For, ast.AsyncFor, ast.While, ast.With, ast.AsyncWith)) else ():
                chained = isinstance(n, ast.If) and len(body) == 1 and isinstance(body[0], ast.If) and body is not n.body
                if body and not chained and _does_something(body):
                    add("block", body[0], _text_of(body), "pass")
            if isinstance(n, ast.Compare):
                for op in n.ops:
                    if type(op) in BOUNDARY:
                        add("boundary", n, WRITTEN[type(op)], BOUNDARY[type(op)])
            elif isinstance(n, ast.BoolOp):
                add("logic", n, WRITTEN[type(n.op)], "or" if isinstance(n.op, ast.And) else "and")
            elif isinstance(n, ast.BinOp) and type(n.op) in ARITHMETIC:
                add("arithmetic", n, WRITTEN[type(n.op)], ARITHMETIC[type(n.op)])
            elif isinstance(n, ast.AugAssign) and type(n.op) in ARITHMETIC:
                add("update", n, f"{WRITTEN[type(n.op)]}=", f"{ARITHMETIC[type(n.op)]}=")
            elif isinstance(n, ast.UnaryOp) and isinstance(n.op, ast.Not):
                add("not", n, ast.unparse(n), ast.unparse(n.operand))
            elif isinstance(n, ast.UnaryOp) and isinstance(n.op, ast.USub):
                add("negative", n, ast.unparse(n), ast.unparse(n.operand))
            elif isinstance(n, ast.Constant) and id(n) not in docs:
                if isinstance(n.value, bool):
                    add("boolean", n, str(n.value), str(not n.value))
                elif isinstance(n.value, int):
                    add("number", n, str(n.value), str({0: 1, 1: 0}.get(n.value, n.value + 1)))
                elif isinstance(n.value, str):
                    add("string", n, repr(n.value), "''" if n.value else "'changed'")
            if isinstance(n, (ast.If, ast.IfExp)):
                for value in ("True", "False"):
                    add("condition", n.test, ast.unparse(n.test), value)
            elif isinstance(n, ast.While):
                add("condition", n.test, ast.unparse(n.test), "False")
            elif isinstance(n, ast.Return) and n.value is not None and not (isinstance(n.value, ast.Constant) and n.value.value is None):
                add("return", n, ast.unparse(n.value), "None")
            elif isinstance(n, ast.Expr) and isinstance(n.value, ast.Call):
                add("removal", n, ast.unparse(n.value), "pass")
    return sorted(rows, key=lambda r: (r[3], r[4], r[5], r[7]))


def _table(files: DataFrame, function, schema: str) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [row for i, p, s in zip(pdf.file_id, pdf.path, pdf.source) for row in function(i, p or "", s)]
            if rows:
                yield pd.DataFrame(rows, columns=[c.strip().split()[0] for c in schema.split(", ")])

    return files.where("path LIKE '%.py' AND file_id IS NOT NULL").select(F.col("file_id").cast("long").alias("file_id"), "path", "source").mapInPandas(run, schema)


def python_methods(files: DataFrame) -> DataFrame:
    return _table(files, methods_of, METHODS)


def python_calls(files: DataFrame) -> DataFrame:
    return _table(files, calls_of, CALLS)


def python_mutants(files: DataFrame) -> DataFrame:
    """Mutants of every Python file; an edit inside nested functions belongs to the smallest."""
    rows = _table(files, mutants_of, MUTANTS)
    w = Window.partitionBy("file_id", "mutant").orderBy(F.length("method").desc(), "method")
    return rows.withColumn("n", F.row_number().over(w)).where("n = 1").drop("n")


IMPORTS = "file_id long, path string, alias string, module string, name string"


def imports_of(file_id: int, path: str, source: str | None) -> list[tuple]:
    """Rows of ``IMPORTS``: what each alias of a file stands for; relative modules keep their leading dots."""
    tree = _tree(source)
    rows = []
    for n in ast.walk(tree) if tree else ():
        if isinstance(n, ast.Import):
            rows += [(file_id, path, a.asname or a.name.split(".")[0], a.name if a.asname else a.name.split(".")[0], None) for a in n.names]
        elif isinstance(n, ast.ImportFrom):
            module = "." * n.level + (n.module or "")
            rows += [(file_id, path, a.asname or a.name, module, a.name) for a in n.names if a.name != "*"]
    return rows


def python_imports(files: DataFrame) -> DataFrame:
    return _table(files, imports_of, IMPORTS)


def python_candidates(path: str, module: str) -> list[str]:
    """Files a module may be, the likeliest first: a package or a module, from the root or ``src``, or relative to its importer."""
    dots = len(module) - len(module.lstrip("."))
    parts = [p for p in module.lstrip(".").split(".") if p]
    if dots:
        base = path.split("/")[:-1]
        if dots - 1 > len(base):
            return []
        roots = [base[: len(base) - (dots - 1)]]
    else:
        roots = [[], ["src"], path.split("/")[:-1]]
    out = []
    for root in roots:
        stem = "/".join([*root, *parts])
        out += [f"{stem}.py", f"{stem}/__init__.py"] if parts else [f"{stem}/__init__.py" if stem else "__init__.py"]
    return list(dict.fromkeys(out))


def script_candidates(path: str, module: str) -> list[str]:
    """Files a relative module of a script may be: itself, with an extension, or an index; others belong to packages."""
    if not module.startswith("."):
        return []
    parts = path.split("/")[:-1]
    for p in module.split("/"):
        if p == "..":
            if not parts:
                return []
            parts = parts[:-1]
        elif p not in (".", ""):
            parts = [*parts, p]
    stem = "/".join(parts)
    ends = ("js", "ts", "tsx", "jsx", "mjs", "cjs")
    bare = stem.rsplit(".", 1)[0] if stem.rsplit(".", 1)[-1] in ("js", "mjs", "cjs") else stem
    return list(dict.fromkeys([stem, *(f"{stem}.{e}" for e in ends), *(f"{bare}.{e}" for e in ("ts", "tsx")), *(f"{stem}/index.{e}" for e in ends)]))


def module_candidates(language: str):
    """A column function of an importer's path and a module that gives its candidate files."""
    pick = {"python": python_candidates, "javascript": script_candidates, "typescript": script_candidates}[language]

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def candidates(path: pd.Series, module: pd.Series) -> pd.Series:
        return pd.Series([pick(p, m) if p and m else [] for p, m in zip(path, module)])

    return candidates


TABLES = "file_id long, received_at timestamp, kind string, path string, id string, qualified_name string, name string, line int, alias string, module string"


def python_tables(files: DataFrame) -> DataFrame:
    """The methods, calls and imports of the latest delivery of every Python file, from one parse, told apart by ``kind``: ``file`` (one
    per file of any language), ``method``, ``call`` (``id`` is the caller) and ``import``. ``files`` has ``file_id``, ``path``, ``language``, ``source``
    and ``received_at``; no text is shuffled. A file is Python by its language, however spelt, else by its extension."""
    names = [c.split()[0] for c in TABLES.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for file_id, path, language, source, at in zip(pdf.file_id, pdf.path, pdf.language, pdf.source, pdf.received_at):
                at = None if at is pd.NaT else at
                rows.append((file_id, at, "file", path, None, None, None, None, None, None))
                if path is None or source is None or lexing.language_of(language, path) != "python":
                    continue
                rows += [(file_id, at, "method", path, r[1], r[3], r[2], r[4], None, None) for r in methods_of(file_id, path, source)]
                rows += [(file_id, at, "call", path, r[1], None, r[2], r[3], None, None) for r in calls_of(file_id, path, source)]
                rows += [(file_id, at, "import", path, None, None, r[4], None, r[2], r[3]) for r in imports_of(file_id, path, source)]
            out = pd.DataFrame(rows, columns=names)
            out["line"] = out["line"].astype("Int32")
            yield out

    rows = files.where("file_id IS NOT NULL").select(F.col("file_id").cast("long").alias("file_id"), "path", "language", "source", "received_at").mapInPandas(run, TABLES)
    newest = F.max("received_at").over(Window.partitionBy("file_id"))
    return rows.withColumn("newest", newest).where(F.col("received_at").eqNullSafe(F.col("newest"))).drop("newest", "received_at").distinct()
