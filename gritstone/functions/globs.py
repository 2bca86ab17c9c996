"""Path patterns compiled to anchored regular expressions that both Java and Python read alike."""

from __future__ import annotations

import re

#: More alternatives than this from one pattern are an error.
MAX_ALTERNATIVES = 256


def expand_braces(glob: str) -> list[str]:
    """``a{b,c}`` as ``ab`` and ``ac``, nested too; a brace that is never closed stands for itself."""
    done: list[str] = []
    todo = [glob]
    while todo:
        pattern = todo.pop(0)
        at = -1
        while (at := pattern.find("{", at + 1)) >= 0:
            depth, cuts = 0, [at]
            for i in range(at, len(pattern)):
                if pattern[i] == "{":
                    depth += 1
                elif pattern[i] == "}":
                    depth -= 1
                    if not depth:
                        cuts.append(i)
                        break
                elif pattern[i] == "," and depth == 1:
                    cuts.append(i)
            if depth == 0:
                parts = [pattern[a + 1 : b] for a, b in zip(cuts, cuts[1:])]
                todo = [pattern[:at] + part + pattern[cuts[-1] + 1 :] for part in parts] + todo
                break
        else:
            done.append(pattern)
        if len(done) + len(todo) > MAX_ALTERNATIVES:
            raise ValueError(f"{glob!r} stands for more than {MAX_ALTERNATIVES} patterns")
    return list(dict.fromkeys(done))


def glob_regex(glob: str) -> str:
    """A path glob: ``*`` stays within one name, ``**/`` is any directories or none, a last ``**`` everything below; ``?`` and
    brackets stand for themselves."""
    forms = []
    for one in expand_braces(glob):
        # several in a row say no more than one, and would be tried in every combination
        while "**/**/" in one:
            one = one.replace("**/**/", "**/")
        out, i = "", 0
        while i < len(one):
            if one.startswith("**/", i) and (i == 0 or one[i - 1] == "/"):
                out += r"(?:[^/]+/)*"
                i += 3
            elif one[i:] == "**" and (i == 0 or one[i - 1] == "/"):
                out += r"(?:[^/]+/)*[^/]+"
                i += 2
            elif one[i] == "*":
                while i < len(one) and one[i] == "*":
                    i += 1
                out += r"[^/]*"
            else:
                out += re.escape(one[i]) if not one[i].isalnum() and one[i] not in "_/" else one[i]
                i += 1
        forms.append(out)
    return "^(?:" + "|".join(forms) + ")$"


def attribute_regex(directory: str, pattern: str) -> str | None:
    """A pattern of a git attribute file in ``directory``: with a slash it is anchored there, else it matches a name at any
    depth below. None for a pattern that matches no file (a directory pattern, a negated one)."""
    if pattern.startswith("!") or pattern.endswith("/"):
        return None
    anchored = "/" in pattern
    pattern = pattern.removeprefix("/")
    out, i = "", 0
    while i < len(pattern):
        c = pattern[i]
        if pattern.startswith("**/", i):
            out, i = out + r"(?:[^/]+/)*", i + 3
        elif pattern[i:] == "**":
            out, i = out + r".*", i + 2
        elif c == "*":
            out, i = out + r"[^/]*", i + 1
        elif c == "?":
            out, i = out + r"[^/]", i + 1
        elif c == "[" and (end := pattern.find("]", i + 2)) > 0:
            inside = pattern[i + 1 : end]
            inside = "^" + inside[1:] if inside[0] in "!^" else inside
            out, i = out + "[" + inside.replace("\\", "\\\\").replace("[", "\\[") + "]", end + 1
        elif c == "\\" and i + 1 < len(pattern):
            out, i = out + re.escape(pattern[i + 1]), i + 2
        else:
            out, i = out + (re.escape(c) if not c.isalnum() and c not in "_/" else c), i + 1
    base = re.escape(directory.strip("/")) + "/" if directory.strip("/") else ""
    return f"^{base}{'' if anchored else '(?:[^/]+/)*'}{out}$"
