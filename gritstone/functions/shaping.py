"""Column functions that shape source lines, scores and mutants for a question or a report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gritstone.functions.text import token_estimate

# How kinds are shown where that differs from their name, bands by expected level, and prices of models per million tokens:
# fixed values.
KIND_LABELS = {
    "boundary": "off_by_one", "missing_null_handling": "unhandled_null", "wrong_return": "wrong_return_value", "swallowed_error": "error_ignored", "state_mutation": "bad_state_change", "ordering": "wrong_order",
    "resource_leak": "leak", "inverted_condition": "inverted_condition", "wrong_lookup": "wrong_lookup", "other": "other_defect", "split": "too_big", "flatten": "too_nested", "simplify_conditions": "tangled_conditions",
    "deduplicate": "duplicated_logic", "rename": "misnamed", "remove_dead_code": "dead_code", "none": "none",
}
BANDS = ("P3", "P2", "P1", "P0")
#: What stands for lines that are read elsewhere, a fixed value.
ELSEWHERE = "... (read on its own)"
_COMMENT = r"""^\s*(//|/\*|\*|#|\"\"\"|''')"""


def _map(table: dict[str, str]) -> Column:
    return F.create_map(*(F.lit(x) for pair in table.items() for x in pair))


# --- lines
def numbered(lines: Column, start: Column | int = 1) -> Column:
    """Lines, each behind its number."""
    first = start if isinstance(start, Column) else F.lit(start)
    return F.array_join(F.transform(lines, lambda x, i: F.concat(F.lit("L"), (i + first).cast("string"), F.lit("| "), x)), "\n")


def limited(text: Column, limit: int = 6000) -> Column:
    """``(source, partial)``: a text's first ``limit`` characters, and whether there were more."""
    return F.struct(F.substring(text, 1, limit).alias("source"), (F.length(text) > limit).alias("partial"))


def leading_comment(lines: Column, line: Column) -> Column:
    """The comment that ends directly above a line, with the blank lines inside it; empty where there is none."""
    above = F.reverse(F.slice(lines, 1, F.greatest(line - 1, F.lit(0))))
    goes_on = F.transform(above, lambda x: x.rlike(_COMMENT) | (F.trim(x) == ""))
    stop = F.array_position(goes_on, False).cast("int")
    block = F.slice(above, 1, F.when(stop > 0, stop - 1).otherwise(F.size(above)))
    return F.when((F.size(above) > 0) & F.try_element_at(above, F.lit(1)).rlike(_COMMENT), F.regexp_replace(F.array_join(F.reverse(block), "\n"), r"^\s+|\s+$", "")).otherwise("")


def shown_source(lines: Column, line: Column, end_line: Column) -> Column:
    """A unit as a question shows it, and as its hash covers it: the comment above, then its lines."""
    comment = leading_comment(lines, line)
    body = F.array_join(F.slice(lines, line, F.greatest(end_line - line + 1, F.lit(0))), "\n")
    return F.concat(F.when(comment != "", F.concat(comment, F.lit("\n"))).otherwise(""), body)


def span_of(lines: Column, line: Column, end_line: Column, own: Column | None = None) -> Column:
    """A unit's lines; of a unit that holds others, those that are not its ``own`` line numbers are null."""
    span = F.slice(lines, line, F.greatest(end_line - line + 1, F.lit(0)))
    return span if own is None else F.transform(span, lambda x, i: F.when(own.isNull() | F.array_contains(own, i + line), x))


def shown_lines(lines: Column) -> Column:
    """Lines as text, each stretch of nulls as one line that says so."""
    marked = F.transform(lines, lambda x, i: F.when(x.isNotNull(), x).when((i == 0) | F.try_element_at(lines, F.greatest(i, F.lit(1))).isNotNull(), F.lit(ELSEWHERE)))
    return F.array_join(F.filter(marked, lambda x: x.isNotNull()), "\n")


def excerpt(lines: Column, line: Column, end_line: Column, limit: int, focus: Column | None = None) -> Column:
    """A unit with the comment above it, or a window of ``limit`` of these lines, about the ``focus`` line where one is given, with
    counts of what is left out."""
    comment = leading_comment(lines, line)
    above = F.when(comment != "", F.split(comment, "\n")).otherwise(F.array().cast("array<string>"))
    whole = F.concat(above, span_of(lines, line, end_line))
    size = F.size(whole)
    at = F.lit(0) if focus is None else F.coalesce(F.least(F.greatest(F.lit(0), F.size(above) + focus - line - limit // 2), size - limit), F.lit(0))
    part = shown_lines(F.slice(whole, at + 1, limit))
    before = F.when(at > 0, F.concat(F.lit("... ("), at.cast("string"), F.lit(" lines above)\n"))).otherwise("")
    after = F.when(at + limit < size, F.concat(F.lit("\n... ("), (size - at - limit).cast("string"), F.lit(" more lines)"))).otherwise("")
    return F.when(size <= limit, shown_lines(whole)).otherwise(F.concat(before, part, after))


def body_lines(line: Column, end_line: Column) -> Column:
    """``(from, to)``: the lines that say whether a unit ran, which its first does not unless it is the only one."""
    return F.struct(F.when(end_line > line, line + 1).otherwise(line).alias("from"), F.when(end_line > line, end_line).otherwise(line).alias("to"))


def cut_to_fit(text: Column, room: Column | int, rounds: int = 40) -> Column:
    """A text cut to at most ``room`` tokens: first in proportion to its size, then by tenths until it fits."""
    room = room if isinstance(room, Column) else F.lit(room)
    share = F.greatest(F.lit(0), F.floor(F.length(text) * room / F.greatest(token_estimate(text), F.lit(1)))).cast("int")
    step = lambda length, _: F.when(token_estimate(F.substring(text, F.lit(1), length)) > room, F.floor(length * 0.9).cast("int")).otherwise(length)
    length = F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), share, step)
    return F.when(token_estimate(text) <= room, text).otherwise(F.substring(text, F.lit(1), length))


def wrapped(text: Column, width: int = 92, indent: str = "  ") -> Column:
    """Lines filled with words up to ``width``, a longer word on a line of its own."""
    words = F.filter(F.split(text, r"\s+"), lambda w: w != "")
    last = lambda lines: F.try_element_at(lines, F.lit(-1))
    fits = lambda lines, w: (F.size(lines) > 0) & (F.length(last(lines)) + 1 + F.length(w) <= width)
    filled = F.aggregate(
        words, F.array().cast("array<string>"),
        lambda lines, w: F.when(fits(lines, w), F.concat(F.slice(lines, F.lit(1), F.greatest(F.size(lines) - 1, F.lit(0))), F.array(F.concat(last(lines), F.lit(" "), w)))).otherwise(F.concat(lines, F.array(w))),
    )
    return F.transform(filled, lambda x: F.concat(F.lit(indent), x))


def fixed_width(rows: DataFrame, columns: dict[str, str], name: str = "line") -> DataFrame:
    """``rows`` with a line of text in which each of ``columns`` is as wide as its widest cell or its name, to the ``left`` or ``right``."""
    cells = {c: F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns}
    widths = rows.agg(*(F.greatest(F.max(F.length(v)), F.lit(len(c))).alias(f"__w_{c}") for c, v in cells.items()))
    padded = [(F.rpad if align == "left" else F.lpad)(cells[c], F.coalesce(f"__w_{c}", F.lit(len(c))), F.lit(" ")) for c, align in columns.items()]
    # one row of widths
    return rows.crossJoin(F.broadcast(widths)).withColumn(name, F.rtrim(F.concat_ws("  ", *padded))).drop(*(f"__w_{c}" for c in columns))


# --- paths and names
def python_module(path: Column) -> Column:
    """The dotted name under which a Python file is imported."""
    return F.replace(F.regexp_replace(F.regexp_replace(path, r"\.py$", ""), "/__init__$", ""), F.lit("/"), F.lit("."))


def header_language(path: Column) -> Column:
    """An aggregate: what a ``.h`` is among these paths, C++ where any file has one of its extensions."""
    return F.when(F.bool_or(path.rlike(r"\.(cpp|cc|cxx|hpp|hh|hxx)$")), "cpp").otherwise("c")


def starts_with(parts: Column, prefix: Column) -> Column:
    """Whether an array begins with another."""
    return (F.size(prefix) <= F.size(parts)) & (F.slice(parts, 1, F.greatest(F.size(prefix), F.lit(0))) == prefix)


def name_parts(name: Column) -> Column:
    """A dotted or ``::`` name as its parts."""
    return F.filter(F.split(name, r"::|\."), lambda x: x != "")


def canonical_name(name: Column, imports: Column, scripts: Column) -> Column:
    """The parts of a called name, its head replaced by what ``imports`` (``alias``, ``module``, ``name``) bring in under it. In
    ``scripts`` a module is one part, since a slash there is part of its name."""
    parts = name_parts(name)
    brought = F.try_element_at(F.filter(imports, lambda i: i["alias"] == F.try_element_at(parts, F.lit(1))), F.lit(1))
    module = F.when(scripts, F.array(F.regexp_replace(brought["module"], "^node:", ""))).otherwise(name_parts(brought["module"]))
    own = F.when(brought["name"].isin("default", "*"), F.array().cast("array<string>")).otherwise(F.array(brought["name"]))
    return F.when(brought.isNull(), parts).otherwise(F.concat(module, own, F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0)))))


def type_name(text: Column) -> Column:
    """A written return type without its marker, parentheses and data locations."""
    bare = F.regexp_replace(F.regexp_replace(text, r"^(:|->|returns)\s*", ""), r"^\((.*)\)$", "$1")
    return F.trim(F.regexp_replace(bare, r"\b(memory|calldata|storage)\b", ""))


def valid_reference(name: Column, most: int = 256) -> Column:
    """A referenced name, or ``<dynamic>`` where it is no path of identifiers of reasonable length."""
    return F.when((F.length(name) <= most) & name.rlike(r"^[#@$]?[\p{L}_$][\p{L}\p{N}_$]*[?!]?((\.|::|->|\?\.|&\.)[#@$]?[\p{L}_$][\p{L}\p{N}_$]*[?!]?)*$"), name).otherwise("<dynamic>")


# --- scores
def kind_label(kind: Column) -> Column:
    """How a kind is shown."""
    return F.coalesce(F.try_element_at(_map(KIND_LABELS), kind), kind)


def percent(value: Column) -> Column:
    return F.concat(F.floor(value * 100 + 0.5).cast("long").cast("string"), F.lit("%"))


def money(dollars: Column) -> Column:
    """Dollars with as many digits as their size asks for; null is an unknown price."""
    tiny = F.regexp_replace(F.format_string("%.9f", dollars), "0+$", "")
    digits = F.when((dollars > 0) & (dollars < 0.0001), tiny).when(dollars < 0.01, F.format_string("%.4f", dollars)).otherwise(F.format_string("%.2f", dollars))
    return F.when(dollars.isNull(), "price unknown").otherwise(F.concat(F.lit("$"), digits))


def since(seconds: Column) -> Column:
    """How long ago, in the largest unit that still tells something."""
    s = F.greatest(F.lit(0), F.floor(seconds + 0.5))
    unit = lambda size, letter: F.concat(F.floor(s / size + 0.5).cast("long").cast("string"), F.lit(f"{letter} ago"))
    return F.when(seconds.isNull(), "").when(s < 90, unit(1, "s")).when(s < 5400, unit(60, "m")).when(s < 172800, unit(3600, "h")).otherwise(unit(86400, "d"))


def severity_name(band: Column, predicted: Column) -> Column:
    """A band with its score behind it; a dash without one."""
    return F.when(band.isNull(), "-").when(predicted.isNull(), band).otherwise(F.concat(band, F.format_string(" (%.1f)", predicted)))


def band_weight(probabilities: Column, band: Column) -> Column:
    """How much of a distribution over levels lies in a band: none where it leaves the level out, all without a distribution."""
    level = F.create_map(*(x for i, b in enumerate(BANDS) for x in (F.lit(b), F.lit(str(i)))))
    return F.when(probabilities.isNull(), 1.0).otherwise(F.coalesce(F.try_element_at(probabilities, F.try_element_at(level, band)), F.lit(0.0)))


def first_few(texts: Column, keep: int = 3, separator: str = ", ") -> Column:
    """The first texts of an array, and how many more there are."""
    more = F.size(texts) - keep
    return F.array_join(F.concat(F.slice(texts, 1, keep), F.when(more > 0, F.array(F.concat(F.lit("+"), more.cast("string"), F.lit(" more")))).otherwise(F.array().cast("array<string>"))), separator)


def spread(masses: Column, keep: int = 3, least: float = 0.005) -> Column:
    """The greatest values of a map above ``least`` as percentages, greatest first (ties by key), and how many more there are."""
    rows = F.filter(F.map_entries(masses), lambda e: e["value"] > least)
    ordered = F.array_sort(F.transform(rows, lambda e: F.struct((-e["value"]).alias("v"), e["key"].alias("k"))))
    return first_few(F.transform(ordered, lambda e: F.concat(kind_label(e["k"]), F.lit(" "), percent(-e["v"]))), keep, "  ")


def page_caption(listed: Column, total: Column, start: int, size: int) -> Column:
    """Where a page lies in its list, and how to get the next."""
    noun = F.concat(total.cast("string"), F.when(total == 1, " open issue").otherwise(" open issues"))
    pages = F.greatest(F.lit(1), F.ceil(total / size)).cast("long")
    past = F.concat(F.lit(f"page {start // size + 1} is past the end. "), noun, F.lit(", "), pages.cast("string"), F.when(pages == 1, " page").otherwise(" pages"))
    head = F.when((listed == total) & F.lit(start == 0), noun).otherwise(F.concat(F.lit(f"{start + 1}-"), (listed + start).cast("string"), F.lit(" of "), noun))
    following = F.when(listed + start < total, F.lit(f". --page {start // size + 2} for the next")).otherwise("")
    return F.when((listed == 0) & F.lit(start > 0), past).otherwise(F.concat(head, following))


# --- mutants
def emptied(literal: Column) -> Column:
    """A string literal without its text, in its own quotes; null where it is none or is empty."""
    pattern = r"(?s)^([a-zA-Z@$]*)([\"'`]+)(.*)\2$"
    return F.when(literal.rlike(pattern) & (F.regexp_extract(literal, pattern, 3) != ""), F.regexp_replace(literal, pattern, "$1$2$2"))


def _piece(text: Column, most: int) -> Column:
    flat = F.regexp_replace(F.trim(text), r"\s+", " ")
    return F.when(F.length(flat) > most, F.concat(F.substring(flat, 1, most - 1), F.lit("…"))).otherwise(flat)


def mutant_phrase(kind: Column, before: Column, after: Column) -> Column:
    """What an edit changed, in the words of its kind."""
    quoted = lambda c: F.concat(F.lit("`"), _piece(c, 48), F.lit("`"))
    dropped = (kind == "method") & (F.contains(before, F.lit("(")) | (F.startswith(before, after) & F.substring(before, F.length(after) + 1, F.length(before)).rlike(r"^[\s.:?!&>-]")))
    rest = F.substring(before, F.length(after) + 1, F.length(before))
    called = F.when(F.startswith(before, after), F.regexp_extract(rest, r"^[\s.:?!&>()-]*([\w$?!.:]+)", 1)).otherwise(F.regexp_extract(before, r"^[\w$.:]+", 0))
    name = F.when(called == "", before).otherwise(called)
    return (
        F.when(kind == "removal", F.concat(F.lit("the call "), quoted(before), F.lit(" removed")))
        .when(dropped, F.concat(F.lit("the call to `"), name, F.lit("` removed")))
        .when(kind == "chaining", F.concat(F.lit("the optional `"), F.when(before == "?", "?.").otherwise(before), F.lit("` made unconditional")))
        .when(kind == "lambda", "the arrow function returning `undefined`")
        .when(kind == "block", "the branch's body emptied")
        .when((kind == "body") & after.rlike(r"return|^\{ \S"), F.concat(F.lit("the body replaced by "), quoted(F.regexp_replace(after, r"^\{ | \}$", ""))))
        .when(kind == "body", "the body emptied")
        .when(kind == "condition", F.concat(F.lit("`"), after, F.lit("` as the condition")))
        .otherwise(F.concat(quoted(after), F.lit(" instead of "), quoted(before)))
    )


def applied(source: Column, line: Column, column: Column, before: Column, after: Column) -> Column:
    """A text with an edit made at a line's byte offset; null where what stands there is not what the edit replaces."""
    rows = F.split(source, "\n")
    start = F.aggregate(F.slice(rows, 1, F.greatest(line - 1, F.lit(0))), F.lit(0), lambda n, x: n + F.octet_length(x) + 1) + column
    raw = F.encode(source, "UTF-8")
    at = F.substring(raw, start + 1, F.octet_length(before))
    edited = F.decode(F.concat(F.substring(raw, F.lit(1), start), F.encode(after, "UTF-8"), F.substring(raw, start + F.octet_length(before) + 1, F.octet_length(raw))), "UTF-8")
    return F.when((line <= F.size(rows)) & (at == F.encode(before, "UTF-8")), edited)


def regex_variants(pattern: Column) -> Column:
    """What a regular expression can become by one edit: an anchor dropped, a quantifier loosened or tightened, a class turned into
    its complement. An array of different texts, in the order of their place."""
    at = F.sequence(F.lit(1), F.greatest(F.length(pattern), F.lit(1)))
    char = lambda i: F.substring(pattern, i, F.lit(1))
    before = lambda i: F.when(i > 1, char(F.greatest(i - 1, F.lit(1)))).otherwise("")
    escaped = lambda i: (before(i) == "\\") & (F.when(i > 2, char(F.greatest(i - 2, F.lit(1)))).otherwise("") != "\\")
    swap = lambda i, size, to: F.concat(F.substring(pattern, F.lit(1), i - 1), to, F.substring(pattern, i + size, F.length(pattern)))
    flipped = lambda c: F.when(c == F.lower(c), F.upper(c)).otherwise(F.lower(c))

    def variant(i):
        c = char(i)
        inside = F.when(c.rlike("^[dDwWsS]$"), swap(i, 1, flipped(c))).when(c == "b", swap(i - 1, 2, F.lit("")))
        free = (
            F.when((c == "+") & (before(i) != "\\"), swap(i, 1, F.lit("*")))
            .when((c == "*") & (before(i) != "\\"), swap(i, 1, F.lit("+")))
            .when((c == "?") & ~before(i).isin("\\", "(", "+", "*", "?", "}"), swap(i, 1, F.lit("")))
            .when((c == "[") & (char(i + 1) == "^") & (before(i) != "\\"), swap(i + 1, 1, F.lit("")))
        )
        return F.when(escaped(i), inside).otherwise(free)

    anchors = F.array(
        F.when(F.startswith(pattern, F.lit("^")), swap(F.lit(1), 1, F.lit(""))), F.when(F.endswith(pattern, F.lit("$")) & ~F.endswith(pattern, F.lit("\\$")), F.substring(pattern, F.lit(1), F.length(pattern) - 1))
    )
    return F.filter(F.concat(anchors, F.transform(at, variant)), lambda x: x.isNotNull())
