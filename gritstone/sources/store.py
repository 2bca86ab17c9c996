"""State on disk: snapshots, event logs, journals of runs, versioned reports, and rules as a table.

Everything is a folder of files that Spark's committer makes visible at once: an overwrite is atomic for its readers, a
repeated append of one batch replaces that batch. Retention deletes whole folders.
"""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gritstone.functions.text import identity


#: Timestamps are kept to the microsecond, which JSON is not by default.
EXACT = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}


def _files(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), jvm.org.apache.hadoop.fs.Path


def exists(spark: SparkSession, path: str) -> bool:
    at, fs, _ = _files(spark, path)
    return fs.exists(at)


def guarded(spark: SparkSession, out: str, path: str) -> str:
    """``path`` below ``out``; an error where it would lead outside, by dots or through a link."""
    at, fs, make = _files(spark, f"{out}/{path}")
    root = make(out)
    inside = [p for p in path.split("/") if p]
    if not inside or ".." in inside or path.startswith("/"):
        raise ValueError(f"{path!r} does not lie in {out!r}")
    step = at
    while step is not None and step.toString() != root.toString():
        if fs.exists(step) and fs.supportsSymlinks() and fs.getFileLinkStatus(step).isSymlink():
            raise ValueError(f"{step.toString()} is a link")
        step = step.getParent()
    return f"{out}/{path}"


# --- snapshots
def write_snapshot(rows: DataFrame, path: str, header: Mapping[str, object] | None = None, records_per_file: int = 1_000_000) -> None:
    """Replace the snapshot at ``path``: the rows as JSON lines, then the header, which says the rows are whole."""
    rows.write.mode("overwrite").option("maxRecordsPerFile", records_per_file).options(**EXACT).json(f"{path}/rows")
    spark = rows.sparkSession
    spark.createDataFrame([(json.dumps(dict(header or {}), sort_keys=True, default=str), rows.schema.json())], "header string, schema string").coalesce(1).write.mode("overwrite").json(f"{path}/header")


def read_snapshot(spark: SparkSession, path: str) -> tuple[dict, DataFrame]:
    """The header and the rows of a snapshot, with the types they were written with."""
    from pyspark.sql.types import StructType

    held = spark.read.schema("header string, schema string").json(f"{path}/header").first()
    if held is None:
        raise FileNotFoundError(path)
    return json.loads(held.header), spark.read.schema(StructType.fromJson(json.loads(held.schema))).options(**EXACT).json(f"{path}/rows")


def read_or(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The JSON lines at ``path``, or no rows where nothing was written yet."""
    return spark.read.schema(schema).options(**EXACT).json(path) if exists(spark, path) else spark.createDataFrame([], schema)


# --- event logs
CLOSURES = "seq long, type string, at timestamp, id string, method string, path string, name string, line int, kinds array<string>, reason string"


def append_events(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").options(**EXACT).json(path)


def closure_events(findings: DataFrame, kind: str, seq: Column, kinds: Column | None = None, reason: str | None = None) -> DataFrame:
    """Events that close (``dismissed``) or reopen findings, in the form of the log."""
    if kind not in ("dismissed", "reopened"):
        raise ValueError(kind)
    has = lambda c, t: F.col(c).cast(t).alias(c) if c in findings.columns else F.lit(None).cast(t).alias(c)
    held = F.array().cast("array<string>") if kinds is None else kinds
    return findings.select(seq.cast("long").alias("seq"), F.lit(kind).alias("type"), has("at", "timestamp"), has("id", "string"), has("method", "string"), has("path", "string"), has("name", "string"), has("line", "int"), held.alias("kinds"), F.lit(reason).cast("string").alias("reason"))


# --- journals
def journal(rows: DataFrame, path: str, run: str, batch: int) -> None:
    """Write one batch of a run and then publish it; a batch that is written again replaces itself."""
    rows.write.mode("overwrite").options(**EXACT).json(f"{path}/run={run}/batch={batch}")
    rows.sparkSession.createDataFrame([(run, batch)], "run string, batch int").coalesce(1).write.mode("overwrite").json(f"{path}/published/{run}-{batch}")


def read_journal(spark: SparkSession, path: str, run: str, schema: str) -> DataFrame:
    """The published batches of a run, with ``batch``."""
    if not exists(spark, f"{path}/published"):
        return spark.createDataFrame([], f"{schema}, batch int")
    known = spark.read.schema("run string, batch int").option("recursiveFileLookup", "true").json(f"{path}/published").where(F.col("run") == run).select("batch").distinct()
    rows = spark.read.schema(f"{schema}, batch int").options(**EXACT).option("basePath", f"{path}/run={run}").json(f"{path}/run={run}") if exists(spark, f"{path}/run={run}") else spark.createDataFrame([], f"{schema}, batch int")
    # as many rows as batches
    return rows.join(F.broadcast(known), "batch", "left_semi")


def prune(spark: SparkSession, path: str, keep: Sequence[str]) -> list[str]:
    """Delete every folder in ``path`` but those named in ``keep``."""
    at, fs, make = _files(spark, path)
    gone = []
    if fs.exists(at):
        for status in fs.listStatus(at):
            name = status.getPath().getName()
            if status.isDirectory() and name not in keep and name.removeprefix("run=") not in keep:
                fs.delete(status.getPath(), True)
                gone.append(name)
    return sorted(gone)


# --- reports
REPORT = "created_at string, revision string, section string, row string"


def write_report(sections: Mapping[str, DataFrame], path: str, created_at: str, revision: str) -> None:
    """Keep a report, its lists as sections of one table, beside the earlier ones; written again it replaces itself."""
    rows = None
    for name, df in sections.items():
        one = df.select(F.lit(name).alias("section"), F.to_json(F.struct(*df.columns)).alias("row"))
        rows = one if rows is None else rows.unionByName(one)
    stamp = created_at.replace(":", "-").replace(" ", "T")
    rows.withColumn("created_at", F.lit(created_at)).withColumn("revision", F.lit(revision)).write.mode("overwrite").json(f"{path}/{stamp}-{revision[:7]}")


def reports(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(REPORT).option("recursiveFileLookup", "true").json(path) if exists(spark, path) else spark.createDataFrame([], REPORT)


def newest_report(spark: SparkSession, path: str, wanted: Column | None = None) -> tuple[str, str] | None:
    """``(created_at, revision)`` of the newest report that ``wanted`` (over these two) holds for."""
    rows = reports(spark, path).select("created_at", "revision").distinct()
    held = (rows if wanted is None else rows.where(wanted)).orderBy(F.desc("created_at"), F.desc("revision")).first()
    return None if held is None else (held.created_at, held.revision)


def baseline(spark: SparkSession, path: str, revision: str, named: str | None = None) -> tuple[str, str] | None:
    """The report to compare with: that of the commit ``named``, which must exist, else the newest of another revision."""
    if named is not None:
        found = newest_report(spark, path, F.startswith("revision", F.lit(named)))
        if found is None:
            raise LookupError(f"no report of {named}")
        return found
    return newest_report(spark, path, F.col("revision") != revision)


def report_section(spark: SparkSession, path: str, at: tuple[str, str], section: str, schema: str) -> DataFrame:
    rows = reports(spark, path).where((F.col("created_at") == at[0]) & (F.col("revision") == at[1]) & (F.col("section") == section))
    return rows.select(F.from_json("row", schema).alias("r")).select("r.*")


# --- rules
def insert_rules(rules: DataFrame, fresh: DataFrame) -> DataFrame:
    """``rules`` and the new ones; a name that any file defines already is an error."""
    taken = fresh.join(rules.select("name").distinct(), "name", "left_semi").select("name").orderBy("name").first()
    if taken is not None:
        raise ValueError(f"rule {taken.name!r} is there already")
    return rules.unionByName(fresh, allowMissingColumns=True)


def edit_rules(rules: DataFrame, changes: DataFrame, cleared: Sequence[str] = ()) -> DataFrame:
    """``rules`` with each value of ``changes`` that is not null in place of the old one, and the columns ``cleared`` null in changed
    rows; a change of a name that is not there adds it."""
    own = [c for c in rules.columns if c != "name"]
    told = changes.select("name", F.lit(True).alias("__told"), *(F.col(c).alias(f"__{c}") for c in changes.columns if c != "name"))
    merged = rules.join(told, "name", "full_outer")
    value = lambda c: F.coalesce(f"__{c}", c) if f"__{c}" in told.columns else F.col(c)
    return merged.select("name", *(F.when(~F.col("__told").isNotNull() | F.lit(c not in cleared), value(c)).alias(c) for c in own))


def remove_rules(rules: DataFrame, names: DataFrame, shipped: Column) -> DataFrame:
    """``rules`` without those in ``names``; a ``shipped`` one stays, disabled."""
    named = names.select("name").distinct().withColumn("__gone", F.lit(True))
    rows = rules.join(named, "name", "left").withColumn("disabled", F.coalesce("disabled", F.lit(False)) | F.coalesce("__gone", F.lit(False)) if "disabled" in rules.columns else F.coalesce("__gone", F.lit(False)))
    return rows.where(F.col("__gone").isNull() | shipped).drop("__gone")


def defined_in(rules: DataFrame, name: str) -> DataFrame:
    """Where a rule is defined, in the order files are read."""
    w = Window.partitionBy("name").orderBy("load_order")
    return rules.where(F.col("name") == name).withColumn("nth", F.row_number().over(w)).select("name", "file", "nth").orderBy("nth")


# --- rows for another service
def issue_rows(issues: DataFrame, key: str, severity: DataFrame | None = None) -> DataFrame:
    """One row per finding and label: its greatest probability to three places, and a severity only for defects and holes."""
    one = issues.groupBy(key, "question", "type").agg(F.round(F.max("probability"), 3).alias("probability"))
    one = one if severity is None else one.join(severity.select(key, "severity"), key, "left")
    held = F.when(F.col("type").isin("defect", "security"), F.col("severity") if severity is not None else F.lit(None).cast("string"))
    return one.select(identity(F.col(key).cast("string"), F.col("question")).alias("id"), key, "question", "type", "probability", held.alias("severity"))
