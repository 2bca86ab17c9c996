"""Functions paired with their documentation.

A lexer turns every source into rows: one per comment line, decorator line and docstring, and one per declaration. The rest
is SQL over those rows: gaps and islands join adjacent comment lines into blocks, lag windows attach to a declaration the
block that ends directly above its signature or above its decorators, a lead window the docstring. Where a declaration
has no ``end_line``, a running sum of nesting tells where its body closes.

Defined cases: a null source or path, or a language that is not known, gives no pair; a file delivered more than once counts
by its latest ``received_at`` (null is the oldest), equal ones once; a declaration without an id or a line gives no pair, one
repeated in a file one pair; an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import accumulate

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gritstone.functions import lexing

ROW = "file_id long, received_at timestamp, first int, last int, kind string, text string, delta int, id string, name string, params string, end_line int, qualified string, code string"

_DECORATOR = {"python": "@", "javascript": "@", "typescript": "@", "java": "@", "rust": "#[", "c": "[["}
_OPEN = str.maketrans({"[": "(", "{": "(", "]": ")", "}": ")"})


def _python_levels(lines: list[str], wanted: set[int]) -> tuple[list[int], list[int]]:
    """Per line the number of its logical line's first line, and the change of indentation level after it. A declared
    signature starts a logical line even where an earlier bracket was never closed."""
    head, delta = list(range(len(lines))), [0] * len(lines)
    stack, depth, last = [0], 0, -1
    for i, line in enumerate(lines):
        code = line.replace(lexing.COMMENT, "").rstrip()
        if i and (code.startswith(lexing.CONTINUED) or (depth > 0 and i + 1 not in wanted)):
            head[i] = head[i - 1]
            last = i
        elif code.strip():
            depth = 0
            indent = len(code) - len(code.lstrip())
            if last >= 0:
                if indent > stack[-1]:
                    stack.append(indent)
                    delta[last] += 1
                while indent < stack[-1]:
                    stack.pop()
                    delta[last] -= 1
            last = i
        flat = code.translate(_OPEN)
        depth = max(0, depth + flat.count("(") - flat.count(")"))
        if code.endswith("\\") and not depth:
            depth = 0
    if last >= 0:
        delta[last] -= len(stack) - 1
    return head, delta


_STRIP_QUOTES = re.compile(r"""^[rRuU]?("{3}|'{3}|"|')([\s\S]*?)\1?$""")
_BRACKET = re.compile(r"[(){}\[\]]")
_INDENT = re.compile(r"\s*")
_PY_STRING = re.compile(r"""[rRuU]?(?:\"{3}(?:[^"\\]|\\[\s\S]|"(?!""))*\"{3}|'{3}(?:[^'\\]|\\[\s\S]|'(?!''))*'{3}|"(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)*')""")


def _docstring(text: str, at: int) -> str | None:
    """The docstring that begins on the line that starts at ``at``, or None."""
    m = _PY_STRING.match(text, _INDENT.match(text, at).end())
    if not m:
        return None
    return _STRIP_QUOTES.sub(r"\2", m[0])


def _one_liners(lines: list[str], wanted: set[int], head: list[int] | None, delta: list[int] | None) -> dict[int, int]:
    """Where a declaration ends that opens no nesting beyond its own lines: a body on the signature's line, a prototype."""
    ends = {}
    for line in wanted:
        i = line - 1
        if not 0 <= i < len(lines):
            continue
        if head is not None:
            last = i
            while last + 1 < len(lines) and head[last + 1] == head[i]:
                last += 1
            if delta[last] <= 0 and lines[last].strip():
                ends[line] = last + 1
            continue
        for last in range(i, len(lines)):
            if last > i and last + 1 in wanted:
                break
            if "{" in lines[last]:
                if lines[last].count("{") <= lines[last].count("}"):
                    ends[line] = last + 1
                break
            if lines[last].rstrip(" \t\x01").endswith(";"):
                ends[line] = last + 1
                break
    return ends


def lex_rows(source: str, language: str, wanted: set[int], ends: dict[int, int] | None = None, heads: dict[int, str] | None = None) -> list[tuple]:
    """Rows ``(first, last, kind, text, delta)`` of one source. Kinds: ``comment`` (one per line), ``decorator``, ``doc`` (a statement
    that is a string; first is the line of the statement before it, which it documents if that is a declaration), ``code`` (only
    where the nesting changes). ``ends`` is filled with the ends of declarations that open no nesting, ``heads`` with their
    signatures."""
    text = lexing.clean(source)
    raw = text.split("\n")
    lines = lexing.mask(text, language).split("\n")
    rows: list[tuple] = []
    mark = _DECORATOR.get(language)
    held = 0
    python = language == "python"
    if python:
        head, delta = _python_levels(lines, wanted)
        starts = list(accumulate((len(x) + 1 for x in raw), initial=0))
    if ends is not None:
        ends.update(_one_liners(lines, wanted, head if python else None, delta if python else None))
    if heads is not None:
        heads.update((line, _signature(raw, lines, line - 1, wanted)) for line in wanted if 0 < line <= len(lines))
    before = 0
    for i, line in enumerate(lines):
        bare = line.strip()
        if not bare:
            continue
        if bare[0] == "\x01" and not bare.strip("\x01 \t"):
            rows.append((i + 1, i + 1, "comment", raw[i].strip(), 0))
            continue
        if held > 0 or (mark and bare.startswith(mark) and not bare.startswith("@interface")):
            flat = bare.translate(_OPEN)
            held = max(0, held + flat.count("(") - flat.count(")"))
            # a decorator on the signature's own line is part of the signature
            if i + 1 not in wanted:
                rows.append((i + 1, i + 1, "decorator", None, 0))
                continue
            held = 0
        if python:
            if before and head[i] != head[before - 1] and bare[0] in "\x02rRuU" and bare.lstrip("rRuU")[:1] == "\x02":
                doc = _docstring(text, starts[i])
                if doc is not None:
                    # under the first line of the statement before it
                    rows.append((head[before - 1] + 1, head[before - 1] + 1, "doc", doc, 0))
            before = i + 1
            change = delta[i]
        else:
            change = bare.count("{") - bare.count("}")
        if change:
            rows.append((i + 1, i + 1, "code", None, change))
    return rows


def _known(number) -> bool:
    """Whether an integer of a nested field is there; beside nulls pandas makes them floats."""
    return number is not None and number == number


def _signature(raw: list[str], lines: list[str], at: int, wanted: set[int]) -> str:
    """The signature that starts on this line: to the end of the line on which its parentheses close, without the body. What is
    open is told from the masked lines; where nothing closes, the next declaration ends it."""
    taken, depth = [], 0
    for i in range(at, len(raw)):
        if i > at and i + 1 in wanted:
            break
        body, braces = None, 0
        for c in _BRACKET.findall(lines[i]):
            if c == "{":
                if depth <= 0:
                    body = braces
                    break
                braces += 1
            depth += 1 if c in "([{" else -1
        if body is not None:
            taken.append("{".join(raw[i].split("{")[: body + 1]))
            break
        taken.append(raw[i])
        if depth <= 0:
            break
    return " ".join(taken)


def _code(raw: list[str], line: int, end: int | None, changes: dict[int, int]) -> str:
    """The lines of a declaration, from its own on: to its end where that is known, else to the line on which
    its nesting is closed, which is as far as any end that is found for it."""
    if end is None:
        depth, end, opened = 0, line, False
        for at in range(line, len(raw) + 1):
            depth += changes.get(at, 0)
            opened = opened or depth > 0
            if opened and depth <= 0 or depth < 0:
                end = at
                break
        else:
            end = len(raw)
    return "\n".join(raw[line - 1 : max(end, line)])


def _lexer(nesting: bool, with_text: bool = False):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out: list[tuple] = []
            for file_id, path, language, source, declarations, at in zip(pdf.file_id, pdf.path, pdf.language, pdf.source, pdf.declarations, pdf.received_at):
                at = None if at is pd.NaT else at
                out.append((file_id, at, 0, 0, "file", None, 0, None, None, None, None, None, None))
                name = lexing.language_of(language, path)
                if name is None or source is None or declarations is None or not len(declarations):
                    continue
                wanted = {int(d["line"]) for d in declarations if _known(d["line"])}
                ends: dict[int, int] | None = {} if nesting else None
                heads: dict[int, str] = {}
                rows = lex_rows(source, name, wanted, ends, heads)
                for first, last, kind, text, delta in rows:
                    if nesting or kind != "code":
                        out.append((file_id, at, first, last, kind, text, delta, None, None, None, None, None, None))
                if with_text:
                    raw = lexing.clean(source).split("\n")
                    changes = {r[0]: r[4] for r in rows if r[2] == "code"}
                    # what could document a declaration: a string below it, a comment or a decorator directly above
                    told = {r[0] for r in rows if r[2] == "doc"} | {r[1] + 1 for r in rows if r[2] in ("comment", "decorator")}
                for d in declarations:
                    if d["id"] is None or not _known(d["line"]) or int(d["line"]) not in heads:
                        continue
                    line = int(d["line"])
                    end = int(d["end_line"]) if _known(d["end_line"]) else (ends or {}).get(line)
                    code = _code(raw, line, end, changes) if with_text and line in told else None
                    out.append((file_id, at, line, line, "decl", None, 0, d["id"], d["name"], heads[line], end, d["qualified_name"], code))
            held = pd.DataFrame(out, columns=[c.split()[0] for c in ROW.split(", ")])
            held["end_line"] = held["end_line"].astype("Int32")
            yield held

    return run


# --- what makes a documentation trivial: fixed values -------------------------------------------------------------------
#: Notes for tools, at the start of a line.
TOOL_NOTES = (
    "noqa", "eslint", "prettier-ignore", "clang-format", "pylint:", "nolint", "rubocop:", "region", "endregion", "#region", "#endregion", "type:",
    "istanbul", "ts-ignore", "@ts-", "tslint:", "jshint", "jscs:", "nosonar", "pragma", "go:", "+build", "checkstyle", "@formatter:", "fmt:", "yapf:",
    "isort:", "flake8", "mypy:", "pyright:", "coverage:", "cspell", "spell-checker", "codespell", "shellcheck", "stylelint", "biome-ignore", "deno-lint",
    "ktlint", "detekt", "cppcheck", "nolint", "spdx-license", "-*-", "vim:", "frozen_string_literal", "c8 ignore", "v8 ignore", "webpack", "@flow", "lint:",
    "suppress", "sourcemappingurl", "black:", "ruff:", "semgrep", "nosec", "bandit:", "sorbet", "typed:", "clippy::", "rustfmt",
)
#: Placeholders: alone on a line they say nothing.
PLACEHOLDERS = re.compile(
    r"^(?:(?:todo|fixme|xxx|hack|tbd|tba|wip|placeholder)\b.*|n/?a|none|empty|see (?:above|below|source|code|name)|same as above|auto[- ]?(?:added|generated) (?:stub|comment|documentation|doc|docs|method stub)"
    r"|(?:no |missing |add |insert |write )?(?:docs?|documentation|docstring|description|comments?)(?: missing| needed| here| pending| goes here| to come| to be added| yet| available| comment)*|stub|undocumented|not documented|self[- ]explanatory"
    r"|\{?@?inheritdoc\}?|deprecated|internal|private|public|helper|utility|lorem ipsum.*)$",
    re.I,
)
#: Words that say nothing of their own beside a name.
FILLER = frozenset(
    "a an the this that these those it its is are be was were used use uses using to of for from in on at by with and or as into do does did done make makes made "
    "function functions method methods procedure routine class constructor object helper utility member operation implementation implements description describe describes documentation "
    "return returns returned returning get gets got getter set sets setter value values result results given param params parameter parameters argument arguments arg args input output "
    "type types number numbers string boolean void null none default new current specified self me cls all any one some each which when what perform performs handle handles call calls called".split()
)

_DECORATION = re.compile(r"^[\s/*#!|=~<>+\-_.:;]*|[\s/*#=~|\-_]*$")
_TAG = re.compile(r"^[@:\\]\s*[a-zA-Z]+")
_HTML = re.compile(r"</?[a-zA-Z][^<>]*>")
_CODE = re.compile(
    r"^(?=.*[=(\[{<>+]).*[;{}]\s*$|^[\w.]+;$|^(?:if|for|while|switch|return|else|elif|let|const|var|auto|int|long|def|func|fn|import|from|use|print\w*|assert|raise|throw|yield|await|break|continue)\b[^.!?]*[(=;{}+*:]"
    r"|^[\w.\[\]>*-]+\s*(?:[-+*/|&^%]|<<|>>|:)?=(?!=)\s*\S+|^[\w.]+(?:->|::)?\w*\([^()]*\)\s*[;,)]*$|^return\s+[\w.]+(?:\s*[-+*/%<>=!&|]+\s*[\w.]+)*;?$|^(?:end|pass|break|continue|else:?|try:?|begin|do|done|fi|\}|\)|\]);?$"
)
_WORD = re.compile(r"[^\W\d_]+")
_CAMEL = re.compile(r"(?<=[a-z0-9])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])")


def _parts(text: str) -> list[str]:
    return _WORD.findall(_CAMEL.sub(" ", text).lower())


def _stem(word: str) -> str:
    for end in ("ies", "ing", "es", "ed", "s", "e"):
        if word.endswith(end) and len(word) - len(end) > 2:
            return word[: -len(end)]
    return word[:-1] if word.endswith("y") and len(word) > 3 else word


def documentation_text(text: str | None) -> str:
    """A comment's or docstring's own words: without comment marks, tags, notes for tools, separators, placeholders and
    commented-out code."""
    kept: list[str] = []
    for line in (text or "").split("\n"):
        line = _HTML.sub(" ", line)
        tagged = re.sub(r"^\s*(?:/\*+!?|\*+/|\*+|//+[!<]?|#+!?|=begin|=end)?\s*", "", line)
        tagged = re.sub(r"\s*\*+/\s*$", "", tagged).strip()
        if not tagged or _TAG.match(tagged):
            continue
        low = tagged.lower()
        if low.startswith(TOOL_NOTES):
            continue
        bare = _DECORATION.sub("", tagged).strip()
        if not bare or not _WORD.search(bare):
            continue
        if PLACEHOLDERS.match(bare.rstrip(".!: ")):
            continue
        if _CODE.search(tagged):
            continue
        kept.append(tagged)
    return "\n".join(kept)


def is_trivial(text: str | None, name: str | None, signature: str | None = None) -> bool:
    """Whether documentation tells nothing beyond the name and the parameters: fewer than two words of its own are left."""
    own = documentation_text(text)
    if not own:
        return True
    known = {_stem(w) for w in _parts(f"{name or ''} {signature or ''}")}
    spoken = [w for w in _parts(own) if w not in FILLER]
    told = {w for w in spoken if _stem(w) not in known and not any(k.startswith(w) or w.startswith(k) for k in known if min(len(k), len(w)) > 3)}
    return len(told) < 2


@F.pandas_udf(T.BooleanType())
def _tells(text: pd.Series, name: pd.Series, signature: pd.Series) -> pd.Series:
    return pd.Series([not is_trivial(t, n, s) for t, n, s in zip(text, name, signature)])


def _blocks(rows: DataFrame) -> DataFrame:
    """The rows of each file's latest delivery, once each, with adjacent comment lines and decorator lines joined to blocks."""
    rows = rows.withColumn("newest", F.max("received_at").over(Window.partitionBy("file_id")))
    rows = rows.where(F.col("received_at").eqNullSafe(F.col("newest")) & (F.col("kind") != "file"))
    # gaps and islands: among lines of a kind that follow each other, line number less rank is the same; rows of equal deliveries
    # rank alike, and are one from here on
    island = F.col("first") - F.dense_rank().over(Window.partitionBy("file_id", "kind").orderBy("first"))
    rows = rows.withColumn("island", F.when(F.col("kind").isin("comment", "decorator"), island).otherwise(F.col("first")))
    ordered = F.array_sort(F.collect_set(F.when(F.col("text").isNotNull(), F.struct("first", "text"))))
    once = ["delta", "name", "params", "end_line", "qualified", *(["code"] if "code" in rows.columns else [])]
    return rows.groupBy("file_id", "kind", "island", "id").agg(
        F.min("first").alias("first"), F.max("last").alias("last"), F.array_join(F.transform(ordered, lambda x: x["text"]), "\n").alias("text"), *(F.first(c).alias(c) for c in once)
    )


def _with_docs(blocks: DataFrame) -> DataFrame:
    """Each declaration with the text above it and its docstring."""
    place = F.when(F.col("kind") == "decl", 1).when(F.col("kind") == "code", 2).otherwise(0)
    so_far = Window.partitionBy("file_id").orderBy("last", place).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    comment = F.when(F.col("kind") == "comment", F.struct("first", "last", "text"))
    rows = blocks.withColumn("c", F.last(comment, ignorenulls=True).over(so_far))
    decorator = F.when(F.col("kind") == "decorator", F.struct("first", "last", "c"))
    rows = rows.withColumn("d", F.last(decorator, ignorenulls=True).over(so_far)).withColumn("depth", F.sum("delta").over(so_far))
    rows = rows.withColumn("docstring", F.max(F.when(F.col("kind") == "doc", F.col("text"))).over(Window.partitionBy("file_id", "first")))
    above = F.when(F.col("c.last") == F.col("first") - 1, F.col("c.text"))
    top = F.when(above.isNotNull(), F.col("c.first")).otherwise(F.col("first"))
    over = F.when((F.col("d.last") == top - 1) & (F.col("d.c.last") == F.col("d.first") - 1), F.col("d.c.text"))
    return rows.withColumn("doc", F.concat_ws("\n", over, above, F.col("docstring")))


def documented(files: DataFrame, with_code: bool = False, with_text: bool = False) -> DataFrame:
    """``(file_id, decl_id, name, qualified_name, line, doc)`` for every declaration of ``files`` (the columns of
    source_analysis) whose documentation is not trivial; ``with_code`` adds ``end_line``, computed where it was missing, and
    ``with_text`` the declaration's lines as ``code``, cut where the text is read, so that no text is shuffled but theirs."""
    narrow = F.transform("declarations", lambda d: F.struct(*(d[c].alias(c) for c in ("id", "name", "qualified_name", "line", "end_line"))))
    wanted = files.where("file_id IS NOT NULL").select(F.col("file_id").cast("long").alias("file_id"), "path", "language", "source", narrow.alias("declarations"), "received_at")
    lexed = wanted.mapInPandas(_lexer(with_code or with_text, with_text), ROW)
    rows = _with_docs(_blocks(lexed if with_text else lexed.drop("code")))
    keep = ["file_id", F.col("id").alias("decl_id"), "name", F.col("qualified").alias("qualified_name"), F.col("first").alias("line"), "doc"]
    if with_code or with_text:
        # a line that closes nesting closes each level down to the one it leaves; a declaration waits for its own level
        levels = F.when(F.col("kind") == "decl", F.array("depth")).when(F.col("delta") < 0, F.sequence("depth", F.col("depth") - F.col("delta") - 1))
        rows = rows.withColumn("level", F.explode(levels))
        later = Window.partitionBy("file_id", "level").orderBy("last", F.when(F.col("kind") == "decl", 0).otherwise(1)).rowsBetween(1, Window.unboundedFollowing)
        closes = F.first(F.when(F.col("kind") == "code", F.col("last")), ignorenulls=True).over(later)
        rows = rows.withColumn("end_line", F.coalesce("end_line", closes, "first"))
        keep.append("end_line")
    if with_text:
        keep.append(F.array_join(F.slice(F.split("code", "\n"), 1, F.greatest(F.col("end_line") - F.col("first") + 1, F.lit(1))), "\n").alias("code"))
    return rows.where((F.col("kind") == "decl") & (F.trim("doc") != "")).where(_tells("doc", "name", "params")).select(*keep)


@F.pandas_udf(T.StringType())
def _own_words(doc: pd.Series) -> pd.Series:
    return doc.map(documentation_text)


def code_doc_pairs(files: DataFrame) -> DataFrame:
    """``(file_id, decl_id, qualified_name, code, documentation)``: each documented function's lines and its documentation."""
    pairs = documented(files, with_text=True)
    return pairs.select("file_id", "decl_id", "qualified_name", "code", _own_words("doc").alias("documentation"))
