"""Lexical view of source text in eight languages: where comments and literals are, so that what stands inside them is not
taken for code. Plain functions over Python strings, used inside Arrow-batched operators."""

from __future__ import annotations

import re

LANGUAGES = ("python", "javascript", "typescript", "java", "go", "rust", "c", "ruby")

#: File extensions and other spellings of a language's name.
SPELLINGS = {
    "py": "python", "pyi": "python", "python3": "python", "js": "javascript", "mjs": "javascript", "cjs": "javascript", "node": "javascript",
    "ts": "typescript", "mts": "typescript", "cts": "typescript", "golang": "go", "rs": "rust", "h": "c", "rb": "ruby",
}


def language_of(language: str | None, path: str | None) -> str | None:
    """The language as one of ``LANGUAGES``: by its name however spelt, else by the path's extension, else None."""
    name = (language or "").strip().lower().lstrip(".")
    name = SPELLINGS.get(name, name)
    if name in LANGUAGES:
        return name
    base = (path or "").rsplit("/", 1)[-1]
    if "." not in base:
        return None
    name = base.rsplit(".", 1)[-1].lower()
    name = SPELLINGS.get(name, name)
    return name if name in LANGUAGES else None


_DQ = r'"(?:[^"\\\n]|\\[\s\S])*(?:"|(?=\n)|\Z)'
_SQ = r"'(?:[^'\\\n]|\\[\s\S])*(?:'|(?=\n)|\Z)"
_BLOCK = r"/\*(?:[^*]|\*(?!/))*(?:\*/|\Z)"
_LINE = r"//[^\n]*"
_CHAR = r"'(?:[^'\\\n]|\\[^\n]{1,10}?)'"
_REGEX = r"(?:(?<=[(,=:\[!&|?{};+~>])[ \t]*|(?<=\breturn)[ \t]*)/(?![*/])(?:[^/\\\[\n]|\\.|\[(?:[^\]\\\n]|\\.)*\])+/[a-z]*"

_PATTERNS = {
    "python": rf'(?P<c>\#[^\n]*)|(?P<s>"""(?:[^"\\]|\\[\s\S]|"(?!""))*(?:"""|\Z)|\'\'\'(?:[^\'\\]|\\[\s\S]|\'(?!\'\'))*(?:\'\'\'|\Z)|{_DQ}|{_SQ})',
    "javascript": rf"(?P<c>{_LINE}|{_BLOCK})|(?P<s>{_DQ}|{_SQ}|`(?:[^`\\]|\\[\s\S])*(?:`|\Z)|{_REGEX})",
    "java": rf'(?P<c>{_LINE}|{_BLOCK})|(?P<s>"""(?:[^"\\]|\\[\s\S]|"(?!""))*(?:"""|\Z)|{_DQ}|{_CHAR})',
    "go": rf"(?P<c>{_LINE}|{_BLOCK})|(?P<s>{_DQ}|`[^`]*(?:`|\Z)|{_CHAR})",
    "rust": rf'(?P<c>{_LINE}|{_BLOCK})|(?P<s>\bb?r(?P<h>\#*)"[\s\S]*?(?:"(?P=h)|\Z)|"(?:[^"\\]|\\[\s\S])*(?:"|\Z)|{_CHAR})',
    "c": rf"(?P<c>//(?:[^\n\\]|\\[\s\S])*|{_BLOCK})|(?P<s>{_DQ}|{_CHAR})",
    "ruby": rf"(?P<c>^=begin\b[\s\S]*?(?:^=end\b[^\n]*|\Z)|\#[^\n]*)|(?P<s>{_DQ}|{_SQ})",
}
_PATTERNS["typescript"] = _PATTERNS["javascript"]
_SCAN = {k: re.compile(v, re.M) for k, v in _PATTERNS.items()}

#: Marks that stand for a comment, a literal, and a literal's further lines in a masked text.
COMMENT, STRING, CONTINUED = "\x01", "\x02", "\x04"


def clean(text: str | None) -> str:
    """Without a byte order mark, and with every kind of line end as one newline."""
    text = (text or "").removeprefix("﻿")
    if "\r" in text:
        text = text.replace("\r\n", "\n").replace("\r", "\n")
    return text


def mask(text: str, language: str) -> str:
    """``text`` with comments and literals blanked out, line by line: a line keeps its number, and its first and last mark
    tell whether it holds a comment or a literal. Strings keep no length, comments no text."""

    def blank(m: re.Match) -> str:
        mark = COMMENT if m.lastgroup == "c" or m["c"] is not None else STRING
        lines = m[0].count("\n")
        return mark if not lines else mark + ("\n" + (mark if mark == COMMENT else CONTINUED)) * lines

    return _SCAN[language].sub(blank, text)
