"""Packrat parsing of token strings by parsing-expression grammars.

A lexer turns a source into a string with one character per token kind; a grammar is a set of PEG rules over those. Rules
are memoised by position within a text, as packrat parsing has it, and rules marked ``@`` also by content: what a rule
made of a stretch of tokens without looking past its end holds for every equal stretch of any text, so functions and
statements of the same shape are parsed once per worker. The furthest failure tells where a text that is not accepted
went wrong, and which kinds could have stood there.
"""

from __future__ import annotations

import re
from collections.abc import Callable

#: Contents remembered per grammar; beyond it the memory is emptied and filled anew.
CONTENT_ENTRIES = 150_000
#: Longest stretch of tokens remembered by content.
CONTENT_LENGTH = 4_000

#: Kinds that no token text stands for.
ID, NUM, STR, TPL, NL, INDENT, DEDENT, BAD, END = "i", "n", "s", "t", "\n", "\x0e", "\x0f", "\x00", "\x03"
NAMED = {"ID": ID, "NUM": NUM, "STR": STR, "TPL": TPL, "NL": NL, "INDENT": INDENT, "DEDENT": DEDENT, "EOF": END}


class Kinds:
    """One character per keyword and operator of a language; single punctuation stands for itself."""

    def __init__(self, words: str, operators: str):
        self.char: dict[str, str] = {}
        for n, token in enumerate(dict.fromkeys(words.split() + operators.split())):
            self.char[token] = token if len(token) == 1 and not token.isalnum() else chr(0xE000 + n)
        self.words = tuple(dict.fromkeys(words.split()))
        self.name = {c: t for t, c in self.char.items()} | {c: n.lower() for n, c in NAMED.items()}


_GRAMMAR = re.compile(r"\s*(?:(?P<q>'[^']+')|\{(?P<set>\S+?(?: \S+?)*?)\}(?=[\s*+?)]|$)|(?P<name>[A-Za-z_]\w*)|(?P<op><-|[@/*+?!&()]))")


class Grammar:
    """A PEG as text: ``Name <- expression`` per rule, with sequence, ``/``, ``*``, ``+``, ``?``, ``!``, ``&`` and parentheses;
    ``'x'`` is a token, ``{x y}`` one of several, ``ID NUM STR TPL NL INDENT DEDENT EOF`` are kinds, ``ANYWORD`` a name or keyword.
    ``skip`` lets every token but ``NL`` stand behind line ends. The first rule must accept the whole text."""

    def __init__(self, text: str, kinds: Kinds, skip: bool = False, guess: Callable[[Grammar, int], list[int]] | None = None):
        self.kinds, self.skip = kinds, skip
        self.tokens = [m for m in _GRAMMAR.finditer(text)]
        self.at = 0
        #: text, furthest position examined, position whose expected kinds are gathered, those kinds
        self.state: list = ["", -1, -2, set()]
        self.memos: list[dict[int, tuple[int, int]]] = []
        self.rules: dict[str, list] = {}
        self.content: dict[str, dict[str, int]] = {}
        self.match: dict[int, int] = {}
        self.guess = guess or Grammar.bracket_guess
        first = None
        while self.at < len(self.tokens):
            by_content = self._take("@")
            name = self._next()["name"]
            assert self._take("<-"), name
            first = first or name
            self.refers = False
            body = self._choice()
            # a rule of tokens alone is as cheap as its memo
            self.rules.setdefault(name, [None])[0] = self._rule(name, body, by_content) if self.refers or by_content else body
        missing = [n for n, r in self.rules.items() if r[0] is None]
        if missing:
            raise ValueError(f"rules without a definition: {missing}")
        self.start = self.rules[first][0]
        del self.tokens

    # --- reading the grammar
    def _peek(self):
        return self.tokens[self.at] if self.at < len(self.tokens) else None

    def _next(self):
        self.at += 1
        return self.tokens[self.at - 1]

    def _take(self, op: str) -> bool:
        m = self._peek()
        if m and m["op"] == op:
            self.at += 1
            return True
        return False

    def _choice(self):
        options = [self._sequence()]
        while self._take("/"):
            options.append(self._sequence())
        if len(options) == 1:
            return options[0]
        options = tuple(options)

        def choice(p):
            for option in options:
                q = option(p)
                if q >= 0:
                    return q
            return -1

        return choice

    def _starts_rule(self) -> bool:
        m = self._peek()
        if m["op"] == "@":
            return True
        return bool(m["name"]) and self.at + 1 < len(self.tokens) and self.tokens[self.at + 1]["op"] == "<-"

    def _sequence(self):
        parts = []
        while (m := self._peek()) and not (m["op"] in ("/", ")") or self._starts_rule()):
            parts.append(self._suffix())
        if len(parts) == 1:
            return parts[0]
        if len(parts) == 2:
            a, b = parts

            def pair(p):
                q = a(p)
                return b(q) if q >= 0 else -1

            return pair
        parts = tuple(parts)

        def sequence(p):
            for part in parts:
                p = part(p)
                if p < 0:
                    return -1
            return p

        return sequence

    def _suffix(self):
        m = self._peek()
        if m["op"] in ("!", "&"):
            self.at += 1
            inner, wanted, state = self._suffix(), m["op"] == "&", self.state

            def look(p):
                q = inner(p)
                if q > state[1] + 1:
                    state[1] = q - 1  # examined, though not consumed
                return p if (q >= 0) is wanted else -1

            return look
        part = self._primary()
        while (m := self._peek()) and m["op"] in ("*", "+", "?"):
            self.at += 1
            part = self._repeat(part, m["op"])
        return part

    @staticmethod
    def _repeat(part, op):
        if op == "?":

            def maybe(p):
                q = part(p)
                return q if q >= 0 else p

            return maybe

        def star(p):
            while True:
                q = part(p)
                if q <= p:
                    return p
                p = q

        if op == "*":
            return star

        def plus(p):
            p = part(p)
            return star(p) if p >= 0 else -1

        return plus

    def _primary(self):
        m = self._next()
        if m["q"]:
            return self._token(self.kinds.char[m["q"][1:-1]])
        if m["set"]:
            return self._token(*(self.kinds.char[t] for t in m["set"].split()))
        if m["name"] in NAMED:
            return self._token(NAMED[m["name"]])
        if m["name"] == "ANYWORD":
            return self._token(ID, *(self.kinds.char[w] for w in self.kinds.words))
        if m["name"]:
            self.refers = True
            cell = self.rules.setdefault(m["name"], [None])
            return lambda p: cell[0](p)
        assert m["op"] == "(", m[0]
        inner = self._choice()
        assert self._take(")")
        return inner

    def _token(self, *chars: str):
        state, one, many = self.state, chars[0] if len(chars) == 1 else None, frozenset(chars)
        skip = self.skip and NL not in many

        def token(p):
            c = state[0][p]
            if skip:
                while c == NL:
                    p += 1
                    c = state[0][p]
            if c == one or (one is None and c in many):
                return p + 1
            if p > state[1]:
                state[1] = p
            if p == state[2]:
                state[3].update(many)
            return -1

        return token

    def _rule(self, name: str, body, by_content: bool):
        memo: dict[int, tuple[int, int]] = {}
        self.memos.append(memo)
        state = self.state
        known = self.content[name] = {}

        def rule(p):
            held = memo.get(p)
            if held is not None:
                if held[1] > state[1]:
                    state[1] = held[1]
                return held[0]
            before = state[1]
            state[1] = -1
            q = body(p)
            far = state[1]
            memo[p] = (q, far)
            if before > far:
                state[1] = before
            return q

        if not by_content:
            return rule

        def rule_by_content(p):
            if p in memo:
                return rule(p)
            s = state[0]
            ends = self.guess(self, p)
            for at in ends:
                if 0 < at - p <= CONTENT_LENGTH and s[p:at] in known:
                    memo[p] = (at, -1)
                    return at
            q = rule(p)
            # the rule looked at nothing at or past its end: it holds for this content in any text
            if q in ends and memo[p][1] < q and q - p <= CONTENT_LENGTH:
                if len(known) >= CONTENT_ENTRIES:
                    known.clear()
                known[s[p:q]] = 1
            return q

        return rule_by_content

    # --- parsing
    _BRACKETS = re.compile(r"[(){}\[\]\x0e\x0f]")
    _STOPS = re.compile(r"[({\[;)\]}\x03]")

    def bracket_guess(self, p: int) -> list[int]:
        """Where a declaration or statement that starts here may end: behind its first brace outside other brackets, and behind
        its first semicolon."""
        s, match, ends = self.state[0], self.match, []
        while True:
            m = self._STOPS.search(s, p)
            if m is None:
                return ends
            i, c = m.start(), m[0]
            if c == ";":
                ends.append(i + 1)
                return ends
            if c not in "({[":
                return ends
            end = match.get(i, -1)
            if end < 0:
                return ends
            if c == "{" and not ends:
                ends.append(end + 1)
            elif c == "{":
                return ends
            p = end + 1

    def parse(self, kinds: str) -> tuple[int, set[str]] | None:
        """None if the whole token string is accepted, else the furthest failure: its index and the kinds expected there. What
        nests deeper than the interpreter's frames go raises RecursionError: nothing is known of it."""
        s = kinds + END
        match: dict[int, int] = {}
        stack: list[int] = []
        for m in self._BRACKETS.finditer(s):
            if m[0] in "([{\x0e":
                stack.append(m.start())
            elif stack:
                match[stack.pop()] = m.start()
        self.match = match
        state = self.state
        state[:] = [s, -1, -2, set()]
        if self._run() == len(s):
            return None
        at = max(state[1], 0)
        state[:] = [s, -1, at, set()]
        self._run()
        return at, {self.kinds.name.get(c, c) for c in state[3]}

    def _run(self) -> int:
        for memo in self.memos:
            memo.clear()
        return self.start(0)
