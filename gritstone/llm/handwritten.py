"""Generated, minified, vendored source files and data saved as code, told from hand-written source.

Three kinds of evidence, in this order:

* declared: git attribute files among the rows mark paths as generated or vendored; the deepest file decides, in it the last
  line that sets the attribute, both ways; macros, quoted patterns and ``!`` are read as git does;
* written in the file: marks that public tools write, the repetition of numbered lines that only a program writes, lines as long
  as a minifier leaves them, code that is literals with hardly a word between them;
* mined and applied to repositories that declare nothing. Paths: endings and directory names that, in repositories with attribute
  files, are marked nearly always; a hit lowers what the text must show, as a name alone is no case (``names_decide`` lets it
  decide). Marks: runs of three words in comments on the file that nearly only files with other evidence hold, be it
  declared, repeated, or copied into several repositories. Code: the paragraphs of every file so found to be vendored, in any
  repository; a file most of whose code stands in them is a copy too, marked or not, wherever it lies.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gritstone.functions import lexing
from gritstone.operators.selection import attribute_flags
from gritstone.session import checkpointed

#: Share of the text of code lines that is left when lines equal but for their numbers count once; generated at or below. The
#: second where the path already looks generated.
DISTINCT_SHARE, DISTINCT_HINTED = 0.4, 0.7
#: Code lines that repetition needs at least.
REPEATED_LINES = 12
#: Characters per line of code, literals not counted; minified above.
LINE_LENGTH = 110
#: Share of code in unbroken literals and lists of numbers; data at or above.
LITERAL_SHARE = 0.5
#: Share of code in words outside literals, of this many characters of code at least; data at or below.
WORD_SHARE, WORD_CODE = 0.05, 200
#: Share of a file's code that stands in paragraphs of vendored files; a copy at or above. The second where the path already looks
#: vendored.
COPIED_SHARE, COPIED_HINTED = 0.5, 0.25
#: Characters a paragraph needs to be told from others.
PARAGRAPH = 60
#: Share of the different texts with a paragraph that must be marked for it to be learnt; what many others hold too is common to
#: all code. Equal texts count once, so that unmarked copies of a file don't outvote its mark.
LEARNT_SHARE = 0.1
#: Repositories in which a paragraph travels; a file most of whose code travels is evidence for marks, though no case by itself.
TRAVELS = 3
#: Share of the files with a run of words, or with a path pattern, that other evidence must speak for, and different texts, or
#: repositories that declare, with it.
MINED_SHARE, MINED_TEXTS, MINED_REPOS = 0.98, 5, 2
#: Slices of a key that many rows may hold, when they are looked up in a table of few rows.
SLICES = 16

# Marks, fixed values: what public generators and vendoring tools write.
GENERATED = re.compile(
    r"\bcode generated by\b|\bdo not edit\b|@generated\b|<auto-?generated|\bauto-?generated\b(?! (?:code|client|files?) (?:lives|is|are))|\bautomatically (?:generated|created)\b|\b(?:this file|file) (?:was|is) (?:auto(?:matically)?[- ]?)?(?:generated|produced)\b"
    r"|\bgenerated (?:from|by|using|with)\b|\bmachine[- ]generated\b|\bchanges will be (?:lost|overwritten)\b|\b(?:erzeugt|generiert) von\b|\bgenerado (?:por|autom)|\bg[ée]n[ée]r[ée] par\b",
    re.I,
)
VENDORED = re.compile(r"\bvendored (?:from|copy)\b|\bcopied (?:verbatim|unchanged) from\b|\bthird[- ]party (?:code|source)\b.{0,40}\bdo not (?:edit|modify)\b", re.I)

#: A mark that opens a line, perhaps after the word it speaks of; a bare tag is none, as it states nothing.
_OPENS = r"^[\W_]*(?:(?:warning|note|attention|notice)\W+)?(?:(?:this|the) (?:file|code|source)\W+(?:(?:is|was|has been) )?)?(?!@generated\b)"
STATED_GENERATED = re.compile(f"{_OPENS}(?:{GENERATED.pattern})", re.I | re.M)
STATED_VENDORED = re.compile(f"{_OPENS}(?:{VENDORED.pattern})", re.I | re.M)
#: A line that reads as a comment in a language that is not known.
_COMMENT_LIKE = re.compile(r"^[ \t]*(?:[^\w\s]|(?:rem|dnl)\b).*", re.I | re.M)

_WORD = re.compile(r"[^\W\d_]+")
_IDENTIFIER = re.compile(r"[^\W\d]\w*")
_BLANK = re.compile(r"\s*\Z|[ \t]*\n[ \t]*(?:\n|\Z)")
_NUMBER = re.compile(r"0x[0-9a-fA-F]+|[0-9]+")
_SPACE = re.compile(r"\s+")
_UNBROKEN = re.compile(r"[A-Za-z0-9+/=_-]{40,}|(?:\\x[0-9a-fA-F]{2}){8,}|(?:(?:-?0x[0-9a-fA-F]+|-?[0-9][0-9.]*)\s*,\s*){8,}")
_PARAGRAPHS = re.compile(r"\n[ \t]*(?:\n[ \t]*)+")

TRAITS = "file_id long, repo string, path string, received_at timestamp, digest long, generated boolean, distinct double, minified boolean, data boolean, vendored boolean, grams array<long>, paragraphs array<long>, sizes array<int>"


def file_traits(source: str, language: str | None) -> tuple[bool, bool, bool, bool, list[int], list[int]]:
    """``(generated, minified, data, vendored, paragraph hashes, their sizes)`` of one text by itself; hashes name code without
    comments."""
    _, generated, distinct, minified, data, vendored, _, hashes, sizes = _text_traits(source, language)
    return generated or (distinct <= DISTINCT_SHARE and not data), minified, data, vendored, hashes, sizes


def _comments(text: str, language: str | None) -> tuple[str, str, list[str], list[str], list[str]]:
    """Code without comments, code without literals too, comments before any code, other comments that stand by themselves, and of
    these all that speak of the file: a blank line or the end of the text follows."""
    first, later, on_file = [], [], []
    if language is None:
        told = [m for m in _COMMENT_LIKE.finditer(text)]
        start = next((i for i, line in enumerate(text.split("\n")) if line.strip() and not _COMMENT_LIKE.match(line)), None)
        limit = len(text) if start is None else sum(len(line) + 1 for line in text.split("\n")[:start])
        first = [m[0] for m in told if m.start() < limit]
        return text, text, first, [text], first + [m[0] for m in told if m.start() >= limit and _BLANK.match(text, m.end())]
    code, bare = [], []
    at, begun = 0, False
    block: list[str] = []
    for m in lexing._SCAN[language].finditer(text):
        between = text[at : m.start()]
        code.append(between)
        bare.append(between)
        # a further line of comment goes with the lines above it
        if block and (begun or between.strip() or between.count("\n") != 1):
            block = []
        begun = begun or not between.isspace() and between != ""
        at = m.end()
        breaks = "\n" * m[0].count("\n")
        if m["c"] is None:
            code.append(m[0])
            bare.append(lexing.STRING + breaks)
            begun = True
            continue
        code.append(breaks)
        bare.append(breaks)
        if not begun:
            first.append(m[0])
            on_file.append(m[0])
        elif text[m.start() - 1] == "\n":
            later.append(m[0])
            if _BLANK.match(text, at):
                on_file.append(m[0])
    code.append(text[at:])
    bare.append(text[at:])
    return "".join(code), "".join(bare), first, later, on_file


def _grams(comments: list[str]) -> set[int]:
    """Every run of three words within a line, as hashes."""
    out = set()
    for comment in comments:
        for line in comment.lower().split("\n"):
            words = _WORD.findall(line)
            out.update(map(" ".join, zip(words, words[1:], words[2:])))
    return {xxhash.xxh3_64_intdigest(g) - 2**63 for g in out}


def _text_traits(source: str, language: str | None) -> tuple[int, bool, float, bool, bool, bool, list[int], list[int], list[int]]:
    """A digest of one text's code, whether it is marked as generated, the share of its lines that are different, whether it is
    minified or data or marked as vendored, the runs of words in its comments on the file, its paragraphs and their sizes."""
    text = lexing.clean(source)
    code, bare, first, later, on_file = _comments(text, language)
    marks, stated = "\n".join(first), "\n".join(later)
    generated = bool(GENERATED.search(marks) or STATED_GENERATED.search(stated))
    vendored = bool(VENDORED.search(marks) or STATED_VENDORED.search(stated))

    lines = [s for s in (_SPACE.sub(" ", line).strip() for line in code.split("\n")) if len(s) >= 10]
    distinct = 1.0
    if len(lines) >= REPEATED_LINES:
        plain = [_NUMBER.sub("9", line) for line in lines]
        distinct = sum(map(len, set(plain))) / sum(map(len, plain))
    size = len(code.strip())
    literal = sum(len(m[0]) for m in _UNBROKEN.finditer(code))
    data = bool(lines) and literal >= LITERAL_SHARE * size
    if not data and size >= WORD_CODE and language is not None:
        data = sum(map(len, _IDENTIFIER.findall(bare))) <= WORD_SHARE * size
    minified = False
    if language in ("javascript", "typescript") and not data and lines and max(map(len, lines)) > LINE_LENGTH:
        kept = [len(s) for s in (line.strip() for line in bare.split("\n")) if s]
        minified = bool(kept) and sum(kept) / len(kept) > LINE_LENGTH
    hashes, sizes = [], []
    for part in _PARAGRAPHS.split(code):
        part = _SPACE.sub(" ", part).strip()
        if len(part) >= PARAGRAPH:
            hashes.append(xxhash.xxh3_64_intdigest(part) - 2**63)
            sizes.append(len(part))
    digest = xxhash.xxh3_64_intdigest(_SPACE.sub(" ", code).strip()) - 2**63
    return digest, generated, distinct, minified, data, vendored, list(_grams(on_file)), hashes, sizes


def _traits(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    names = [c.split()[0] for c in TRAITS.split(", ")]
    for pdf in batches:
        rows = [
            (file_id, repo, path, at, *_text_traits(source or "", lexing.language_of(language, path)))
            for file_id, repo, path, language, source, at in zip(pdf.file_id, pdf.repo, pdf.path, pdf.language, pdf.source, pdf.received_at)
        ]
        yield pd.DataFrame(rows, columns=names)


def newest(rows: DataFrame, key: list[str], columns: list[str]) -> DataFrame:
    """One row per ``key``: that of the latest ``received_at`` (null is the oldest), among equals the greatest ``columns``. Rows are
    combined before the shuffle, however many a key has."""
    row = F.struct("received_at", *columns)
    return rows.groupBy(*key).agg(F.max(row).alias("r")).select(*key, *(F.col(f"r.{c}").alias(c) for c in columns))


def lookup(rows: DataFrame, table: DataFrame, key: str) -> DataFrame:
    """``rows`` joined with ``table``, which has each key once and few rows: it is repeated in slices, so that the rows of a key that
    many hold do not meet in one task."""
    n = F.lit(SLICES)
    sliced = table.withColumn("_slice", F.explode(F.sequence(F.lit(0), n - 1)))
    return rows.withColumn("_slice", F.pmod(F.xxhash64("file_id"), n).cast("int")).join(sliced, [key, "_slice"]).drop("_slice")


def declared(files: DataFrame) -> DataFrame | None:
    """``(repo, path, declared_generated, declared_vendored)`` of the files that an attribute file of their repository speaks of; the
    latest delivery of each attribute file counts. None where there is no attribute file."""
    flags = attribute_flags(files)
    if flags is None:
        return None
    return flags.select("repo", "path", *(F.try_element_at("flags", F.lit(f"linguist-{k}")).alias(f"declared_{k}") for k in ("generated", "vendored")))


def path_patterns(path: Column) -> Column:
    """The patterns that a path has part in: each directory's name, the ending behind the first dot of the base name, and the end of
    the name before it, from its last underscore, with that ending."""
    parts = F.split(path, "/")
    base = F.element_at(parts, -1)
    directories = F.transform(F.slice(parts, 1, F.size(parts) - 1), lambda d: F.concat(d, F.lit("/")))
    ending, tail = F.regexp_extract(base, r"^[^.]+(\.[^.]+\..+)$", 1), F.regexp_extract(base, r"(_[^_.]+\..+)$", 1)
    return F.filter(F.array_distinct(F.concat(directories, F.array(ending, tail))), lambda x: x != "")


def mined_paths(files: DataFrame) -> DataFrame:
    """``(pattern, hints_generated, hints_vendored)``: patterns whose files are nearly all marked, in the repositories that mark any.
    ``files`` has ``repo``, ``path``, ``declared_generated`` and ``declared_vendored``."""
    flag = lambda c: F.coalesce(c, F.lit(False))
    declaring = files.where(flag("declared_generated") | flag("declared_vendored")).select("repo").distinct()
    rows = files.join(declaring, "repo", "left_semi").select("repo", *(flag(c).alias(c) for c in ("declared_generated", "declared_vendored")), F.explode(path_patterns(F.col("path"))).alias("pattern"))
    by = rows.groupBy("pattern", "repo").agg(F.count(F.lit(1)).alias("n"), F.count_if("declared_generated").alias("g"), F.count_if("declared_vendored").alias("v"))
    by = by.groupBy("pattern").agg(F.sum("n").alias("n"), F.sum("g").alias("g"), F.sum("v").alias("v"), F.count(F.lit(1)).alias("repos")).where(F.col("repos") >= MINED_REPOS)
    return by.select("pattern", (F.col("g") >= MINED_SHARE * F.col("n")).alias("hints_generated"), (F.col("v") >= MINED_SHARE * F.col("n")).alias("hints_vendored")).where("hints_generated OR hints_vendored")


_FLAGS = ["declared_generated", "declared_vendored", "hints_generated", "hints_vendored"]


def _told_by_paths(latest: DataFrame, rows: DataFrame) -> DataFrame:
    """``latest`` with what attribute files say of each path, and what patterns mined from them say where they say nothing."""
    said = declared(rows)
    if said is None:
        return latest.select("*", *(F.lit(None).cast("boolean").alias(c) for c in _FLAGS))
    said = latest.select("file_id", "repo", "path").join(said, ["repo", "path"], "left")
    said = checkpointed(said)
    patterns = said.select("file_id", F.explode(path_patterns(F.col("path"))).alias("pattern"))
    hints = lookup(patterns, mined_paths(said), "pattern").groupBy("file_id").agg(*(F.bool_or(c).alias(c) for c in _FLAGS[2:]))
    said = said.join(hints, "file_id", "left")
    return latest.join(said.select("file_id", *_FLAGS), "file_id")


def classify_files(files: DataFrame, names_decide: bool = False) -> DataFrame:
    """``(file_id, repo, path, kind)`` for every file of ``files`` (the columns of source_analysis), ``kind`` being ``generated``,
    ``minified``, ``data``, ``vendored`` or ``hand-written``; of several the first in this order. With ``names_decide`` a path
    pattern mined from attribute files decides like an attribute; else it only lowers what the text must show.

    Defined cases: a null id is no file; of a file delivered more than once the latest ``received_at`` counts (null is the
    oldest), also where paragraphs and marks are learnt; a null, empty or unknown-language text is judged by what can be read
    in it; attribute files are no source and have no row; an empty table gives no rows.
    """
    rows = files.where("file_id IS NOT NULL").select(F.col("file_id").cast("long").alias("file_id"), "repo", "path", "language", "source", "received_at")
    source = rows.where("path IS NULL OR NOT (path = '.gitattributes' OR path LIKE '%/.gitattributes')")
    kept = [c.split()[0] for c in TRAITS.split(", ") if c.split()[0] not in ("file_id", "received_at")]
    # flags and hashes are small beside the texts; written once, they spare every later branch the lexing
    latest = checkpointed(_told_by_paths(newest(source.mapInPandas(_traits, TRAITS), ["file_id"], kept), rows))

    flag = lambda c: F.coalesce(c, F.lit(False))
    parts = latest.select("file_id", "repo", "digest", F.explode(F.arrays_zip("paragraphs", "sizes")).alias("x")).select("file_id", "repo", "digest", F.col("x.paragraphs").alias("paragraph"), F.col("x.sizes").alias("size"))
    sizes = parts.groupBy("file_id").agg(F.sum("size").alias("all_size"))
    in_some = lambda known: lookup(parts.select("file_id", "paragraph", "size"), known, "paragraph").groupBy("file_id").agg(F.sum("size").alias("known_size")).join(sizes, "file_id").select("file_id", (F.col("known_size") / F.col("all_size")).alias("share"))

    # seeds of marks: what is declared, marked by public tools, written by repetition, or travels
    travelling = parts.select("paragraph", "repo").distinct().groupBy("paragraph").count().where(F.col("count") >= TRAVELS).select("paragraph")
    travels = in_some(travelling).where(F.col("share") >= COPIED_SHARE).select("file_id", F.lit(True).alias("travels"))
    repeated = (F.col("distinct") <= F.when(flag("hints_generated"), DISTINCT_HINTED).otherwise(DISTINCT_SHARE)) & ~F.col("data")
    generated = F.coalesce("declared_generated", F.col("generated") | repeated)
    vendored = F.coalesce("declared_vendored", F.col("vendored"))
    seeds = latest.join(travels, "file_id", "left").select("file_id", "digest", generated.alias("g"), (vendored | flag("travels")).alias("v"), F.explode("grams").alias("gram"))
    # texts fall into 63 classes by digest; as many different texts as classes there are at least
    texts = F.bit_count(F.bit_or(F.expr("shiftleft(1L, cast(pmod(digest, 63L) AS int))")))
    told = seeds.groupBy("gram").agg(F.count(F.lit(1)).alias("n"), F.count_if("g").alias("g"), F.count_if("v").alias("v"), texts.alias("texts")).where(F.col("texts") >= MINED_TEXTS)
    told = told.select("gram", (F.col("g") >= MINED_SHARE * F.col("n")).alias("g"), (F.col("v") >= MINED_SHARE * F.col("n")).alias("v")).where("g OR v")
    marks = lookup(seeds.select("file_id", "gram"), told, "gram").groupBy("file_id").agg(F.bool_or("g").alias("mined_generated"), F.bool_or("v").alias("mined_vendored"))

    marked = latest.drop("grams", "paragraphs", "sizes").join(marks, "file_id", "left")
    by_name = lambda c: flag(c) & F.lit(names_decide)
    marked = marked.withColumn("g", F.coalesce("declared_generated", F.col("generated") | repeated | flag("mined_generated") | by_name("hints_generated")))
    marked = marked.withColumn("v", F.coalesce("declared_vendored", F.col("vendored") | flag("mined_vendored") | by_name("hints_vendored")))
    marked = checkpointed(marked.select("file_id", "repo", "path", "digest", "minified", "data", "declared_vendored", "hints_vendored", "g", "v"))
    of_texts = parts.join(marked.select("file_id", F.col("v").alias("marked")), "file_id").groupBy("paragraph", "digest").agg(F.bool_or("marked").alias("marked"))
    learnt = of_texts.groupBy("paragraph").agg(F.count_if("marked").alias("marked"), F.count(F.lit(1)).alias("n")).where((F.col("marked") > 0) & (F.col("marked") >= LEARNT_SHARE * F.col("n"))).select("paragraph")
    rows = marked.join(in_some(learnt), "file_id", "left")
    copied = flag(F.col("share") >= F.when(flag("hints_vendored"), COPIED_HINTED).otherwise(COPIED_SHARE))
    copy = F.coalesce("declared_vendored", F.col("v") | copied)
    kind = F.when(F.col("g"), "generated").when(F.col("minified"), "minified").when(F.col("data"), "data").when(copy, "vendored").otherwise("hand-written")
    return rows.select("file_id", "repo", "path", kind.alias("kind"))
