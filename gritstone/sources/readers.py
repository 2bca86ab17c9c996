"""Readers of what version control and test runs leave behind, as table functions over texts.

Each takes a DataFrame with a text column and gives rows; the formats are read line by line on the JVM where regular
expressions can, in Arrow batches where they cannot.
"""

from __future__ import annotations

import json
import subprocess
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TREE = "mode string, type string, sha string, size long, path string"


def git(root: str, *args: str) -> str:
    """One git command's output, hooks disabled; an error carries what it said."""
    done = subprocess.run(["git", "-c", "core.hooksPath=/dev/null", "-C", root, *args], capture_output=True, text=True, errors="replace")
    if done.returncode:
        raise RuntimeError(done.stderr.strip() or f"git {args[0]} failed")
    return done.stdout


def parse_tree(listing: str) -> list[tuple[str, str, str, int | None, str]]:
    """Rows of a zero-terminated long recursive tree listing; an entry that cannot be read is an error."""
    out = []
    for entry in filter(None, listing.split("\0")):
        head, tab, path = entry.partition("\t")
        fields = head.split()
        if not tab or len(fields) != 4:
            raise ValueError(f"not a tree entry: {entry!r}")
        out.append((fields[0], fields[1], fields[2], int(fields[3]) if fields[3].isdigit() else None, path))
    return out


def git_tree(spark: SparkSession, root: str, revision: str = "HEAD") -> DataFrame:
    """The tree of a revision as rows, read in a task from the command's output, a stretch of entries at a time. The revision is
    looked up first, so that an unknown one is an error at once and the task reads one tree whatever happens to it."""
    revision = git(root, "rev-parse", "--verify", f"{revision}^{{tree}}").strip()
    names = [c.split()[0] for c in TREE.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for _ in batches:
            with subprocess.Popen(["git", "-c", "core.hooksPath=/dev/null", "-C", root, "ls-tree", "-r", "-l", "-z", revision], stdout=subprocess.PIPE, stderr=subprocess.PIPE) as child:
                held = b""
                while part := child.stdout.read(1 << 20):
                    whole, zero, rest = (held + part).rpartition(b"\0")
                    held = rest if zero else held + part
                    if zero:
                        out = pd.DataFrame(parse_tree(whole.decode(errors="replace")), columns=names)
                        out["size"] = out["size"].astype("Int64")
                        yield out
                said = child.stderr.read().decode(errors="replace").strip()
            if child.returncode:
                raise RuntimeError(said or "git ls-tree failed")

    return spark.range(0, 1, 1, 1).mapInPandas(run, TREE)


def blob_size(head: bytes) -> int | None:
    """The size that the head of a blob in a batch names; None where the object is missing, an error for another kind or a size
    that is no 63-bit number."""
    fields = head.split()
    if len(fields) == 2 and fields[1] == b"missing":
        return None
    if len(fields) != 3 or fields[1] != b"blob" or not fields[2].isdigit() or int(fields[2]) >= 2**63:
        raise ValueError(f"not the head of a blob: {head!r}")
    return int(fields[2])


def git_blobs(tree: DataFrame, root: str) -> DataFrame:
    """``tree`` with ``text``: one batch process per task reads the blobs of its rows; a missing one has a null text."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        with subprocess.Popen(["git", "-C", root, "cat-file", "--batch"], stdin=subprocess.PIPE, stdout=subprocess.PIPE) as child:
            for pdf in batches:
                texts = []
                for sha in pdf.sha:
                    child.stdin.write(f"{sha}\n".encode())
                    child.stdin.flush()
                    size = blob_size(child.stdout.readline())
                    texts.append(None if size is None else child.stdout.read(size).decode(errors="replace"))
                    if size is not None:
                        child.stdout.read(1)
                yield pdf.assign(text=texts)
            child.stdin.close()

    return tree.mapInPandas(run, ", ".join(f"{n} {t}" for n, t in tree.dtypes) + ", text string")


def changed_lines(diffs: DataFrame, text: str = "diff") -> DataFrame:
    """``(path, changed_line)`` of unified diffs without context: new-side lines, and for a pure deletion the lines around it."""
    # a hunk belongs to the file named last before it, found by splitting at the file headers
    parts = diffs.select(F.explode(F.split(F.concat(F.lit("\n"), F.col(text)), r"\n(?=\+\+\+ )")).alias("part")).where("part LIKE '+++ %'")
    named = parts.select(F.regexp_extract("part", r"^\+\+\+ (?:b/)?([^\t\n]+)", 1).alias("path"), F.regexp_extract_all("part", F.lit(r"(?m)^@@ -[0-9,]+ \+([0-9]+(?:,[0-9]+)?) @@"), F.lit(1)).alias("hunks"))
    hunk = named.where("path <> '/dev/null'").select("path", F.explode("hunks").alias("h"))
    start = F.split("h", ",")[0].cast("int")
    count = F.coalesce(F.try_element_at(F.split("h", ","), F.lit(2)).cast("int"), F.lit(1))
    span = F.when(count > 0, F.sequence(start, start + count - 1)).otherwise(F.array(start, start + 1))
    return hunk.select("path", F.explode(span).alias("changed_line")).where("changed_line > 0").distinct()


_SUITE = "struct<_file:string,_name:string,testcase:array<struct<_name:string,_classname:string,_file:string,_line:int,_time:double,failure:array<string>,error:array<string>,skipped:array<string>>>>"


def junit_cases(reports: DataFrame, text: str = "xml") -> DataFrame:
    """``(suite, classname, name, file, line, time, status)`` of JUnit reports with one level of suites; a case without a file takes its
    suite's. A report that is no XML is an error."""
    rooted = F.when(F.col(text).rlike(r"<testsuites[\s>]"), F.col(text)).otherwise(F.concat(F.lit("<testsuites>"), F.regexp_replace(text, r"^\s*<\?xml[^>]*\?>", ""), F.lit("</testsuites>")))
    parsed = reports.select(F.from_xml(rooted, f"testsuite array<{_SUITE}>", {"mode": "FAILFAST"}).alias("x"))
    case = parsed.select(F.explode("x.testsuite").alias("s")).select("s", F.explode("s.testcase").alias("c"))
    status = F.when(F.col("c.error").isNotNull(), "error").when(F.col("c.failure").isNotNull(), "failed").when(F.col("c.skipped").isNotNull(), "skipped").otherwise("passed")
    return case.select(F.col("s._name").alias("suite"), F.col("c._classname").alias("classname"), F.col("c._name").alias("name"), F.coalesce("c._file", "s._file").alias("file"), F.col("c._line").alias("line"), F.col("c._time").alias("time"), status.alias("status"))


def go_profile(profiles: DataFrame, text: str = "profile") -> DataFrame:
    """``(path, line)`` of lines that a Go cover profile saw run."""
    row = r"(?m)^(\S+):([0-9]+)\.[0-9]+,([0-9]+)\.[0-9]+ [0-9]+ [1-9][0-9]*$"
    found = profiles.select(F.explode(F.arrays_zip(*(F.regexp_extract_all(text, F.lit(row), F.lit(i)).alias(n) for i, n in ((1, "p"), (2, "a"), (3, "b"))))).alias("x"))
    return found.select(F.col("x.p").alias("path"), F.explode(F.sequence(F.col("x.a").cast("int"), F.col("x.b").cast("int"))).alias("line")).distinct()


def go_events(outputs: DataFrame, text: str = "output") -> DataFrame:
    """``(package, test, status)`` of ``go test -json`` output; lines that are no JSON are skipped."""
    lines = outputs.select(F.explode(F.split(text, "\r?\n")).alias("line")).where("line LIKE '{%'")
    event = lines.select(F.from_json("line", "Action string, Package string, Test string").alias("e")).where("e.Action IN ('pass', 'fail') AND e.Test IS NOT NULL")
    return event.select(F.col("e.Package").alias("package"), F.col("e.Test").alias("test"), F.when(F.col("e.Action") == "pass", "passed").otherwise("failed").alias("status"))


def libtest_results(outputs: DataFrame, text: str = "output") -> DataFrame:
    """``(test, status)`` of ``test name ... ok`` lines; ignored ones are left out."""
    row = r"(?m)^test (\S+)(?: - should panic)? \.\.\. (ok|FAILED)$"
    found = outputs.select(F.explode(F.arrays_zip(F.regexp_extract_all(text, F.lit(row), F.lit(1)).alias("t"), F.regexp_extract_all(text, F.lit(row), F.lit(2)).alias("s"))).alias("x"))
    return found.select(F.col("x.t").alias("test"), F.when(F.col("x.s") == "ok", "passed").otherwise("failed").alias("status"))


def trx_results(reports: DataFrame, text: str = "xml") -> DataFrame:
    """``(test, status, seconds)`` of TRX reports: passed and failed results."""
    tags = reports.select(F.explode(F.regexp_extract_all(text, F.lit(r"<UnitTestResult\b([^>]*)>"), F.lit(1))).alias("a"))
    attribute = lambda n: F.nullif(F.regexp_extract("a", rf'\b{n}="([^"]*)"', 1), F.lit(""))
    hms = F.split(attribute("duration"), ":")
    seconds = F.try_element_at(hms, F.lit(1)).cast("double") * 3600 + F.try_element_at(hms, F.lit(2)).cast("double") * 60 + F.try_element_at(hms, F.lit(3)).cast("double")
    rows = tags.select(attribute("testName").alias("test"), F.lower(attribute("outcome")).alias("status"), seconds.alias("seconds"))
    return rows.where("status IN ('passed', 'failed')")


def compiler_errors(outputs: DataFrame, text: str = "output") -> DataFrame:
    """``(path, line, column, code, message)`` of ``path(line,col): error CODE: message`` and ``e: path:line:col message`` lines."""
    lines = outputs.select(F.explode(F.split(text, "\r?\n")).alias("l"))
    one, two = r"^\s*(.+?)\(([0-9]+),([0-9]+)\): error ([A-Z]+[0-9]+): (.*)$", r"^e: (?:file://)?(.+?):([0-9]+):([0-9]+)()[: ]+(.*)$"
    pick = lambda i: F.when(F.col("l").rlike(one), F.regexp_extract("l", one, i)).when(F.col("l").rlike(two), F.regexp_extract("l", two, i))
    rows = lines.select(pick(1).alias("path"), pick(2).cast("int").alias("line"), pick(3).cast("int").alias("column"), F.nullif(pick(4), F.lit("")).alias("code"), pick(5).alias("message"))
    return rows.where("path IS NOT NULL")


def json_values(text: str) -> list:
    """The values of a text that holds several JSON values one after another."""
    out, at, decoder = [], 0, json.JSONDecoder()
    while at < len(text):
        while at < len(text) and text[at].isspace():
            at += 1
        if at < len(text):
            value, at = decoder.raw_decode(text, at)
            out.append(value)
    return out


def executed_lines(coverage: DataFrame, file: str = "path") -> DataFrame:
    """``(context, path, line)`` of coverage databases (SQLite, lines as bits), ``coverage`` naming the database files."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import sqlite3

        for pdf in batches:
            rows = []
            for name in pdf[file]:
                with sqlite3.connect(f"file:{name}?mode=ro", uri=True) as con:
                    for context, path, bits in con.execute("SELECT c.context, f.path, l.numbits FROM line_bits l JOIN file f ON f.id = l.file_id JOIN context c ON c.id = l.context_id"):
                        rows += [(context, path, 8 * i + b) for i, byte in enumerate(bits) for b in range(8) if byte >> b & 1]
            if rows:
                yield pd.DataFrame(rows, columns=["context", "path", "line"])

    return coverage.select(file).mapInPandas(run, "context string, path string, line int")


def test_of(node: str) -> str:
    """A runner's node name as a test's id: without parameters, its parts after the file joined by dots."""
    path, _, rest = node.partition("::")
    return f"{path}::{'.'.join(rest.split('[', 1)[0].split('::'))}" if rest else path
