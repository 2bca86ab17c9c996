"""Git attribute files: which attributes a path has. Plain functions over Python strings, used inside Arrow-batched operators."""

from __future__ import annotations

import re
from collections.abc import Iterable

from gritstone.functions import globs, lexing

_FIELD = re.compile(r'\s*("(?:[^"\\]|\\.)*"|\S+)')
_ESCAPES = {"n": "\n", "t": "\t", "r": "\r", "a": "\a", "b": "\b", "f": "\f", "v": "\v"}
#: What git knows without being told, a fixed value.
BUILT_IN = {"binary": {"diff": False, "merge": False, "text": False}}


def _unquoted(field: str) -> str:
    if len(field) < 2 or field[0] != '"' or field[-1] != '"':
        return field
    return re.sub(r"\\([0-7]{3}|.)", lambda m: chr(int(m[1], 8)) if len(m[1]) == 3 else _ESCAPES.get(m[1], m[1]), field[1:-1])


def _state(field: str) -> tuple[str, bool | str | None]:
    """An attribute's name and its state: set, unset, a value, or None for unspecified."""
    if field[0] in "-!":
        return field[1:], False if field[0] == "-" else None
    name, equals, value = field.partition("=")
    return name, value if equals else True


def parse(path: str, text: str | None) -> tuple[list[tuple[str, list[tuple[str, bool | str | None]]]], dict[str, list]]:
    """``(lines, macros)`` of the attribute file at ``path``: each line's pattern as a regular expression of whole paths with the
    states it sets, and macros by name, which only the top directory's file may define."""
    directory = path.rsplit("/", 1)[0] if "/" in path else ""
    lines, macros = [], {}
    for line in lexing.clean(text).split("\n"):
        fields = _FIELD.findall(line)
        if not fields or fields[0].startswith("#"):
            continue
        states = [_state(f) for f in fields[1:] if f.lstrip("-!")]
        if fields[0].startswith("[attr]"):
            if not directory:
                macros[fields[0][6:]] = states
            continue
        regex = globs.attribute_regex(directory, _unquoted(fields[0]))
        if regex and states:
            lines.append((regex, states))
    return lines, macros


class Attributes:
    """The attribute files of one repository. In the deepest directory the last line that speaks of an attribute decides; a macro
    that is set stands for what it is defined as; ``!`` takes an attribute back to unspecified."""

    def __init__(self, files: Iterable[tuple[str, str | None]]):
        self.macros = {k: list(v.items()) for k, v in BUILT_IN.items()}
        self.files = []
        for path, text in sorted(files, key=lambda f: (f[0].count("/"), f[0])):
            lines, macros = parse(path, text)
            self.macros |= macros
            self.files.append((path.rsplit("/", 1)[0] + "/" if "/" in path else "", [(re.compile(r), s) for r, s in lines]))

    def _set(self, found: dict, name: str, state, within: frozenset = frozenset()) -> None:
        found[name] = state
        if state is True and name in self.macros and name not in within:
            for inner, value in self.macros[name]:
                self._set(found, inner, value, within | {name})

    def states(self, path: str) -> dict[str, bool | str]:
        """The attributes that are specified for ``path``."""
        found: dict = {}
        for directory, lines in self.files:
            if path.startswith(directory):
                for regex, states in lines:
                    if regex.match(path):
                        for name, state in states:
                            self._set(found, name, state)
        return {k: v for k, v in found.items() if v is not None}

    def of(self, path: str) -> dict[str, bool]:
        """The attributes that are specified for ``path``, as flags: a value counts as set unless it says otherwise."""
        return {k: v if isinstance(v, bool) else v.lower() not in ("false", "0", "no", "off") for k, v in self.states(path).items()}
