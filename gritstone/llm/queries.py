"""The registered queries of the training-data operators, and their SQL where SQL can express them on whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gritstone.session import table

from . import docpairs, handwritten, leaks, mixing, setjoin, subjects, syntax, topn

Query = Callable[[SparkSession, str], DataFrame]


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    """Pairs of different tests that kill nearly the same mutants (Jaccard of the key sets at least 0.8)."""
    pairs = setjoin.similar_pairs(table(spark, sf, "tests"), "test_no", F.col("mutants"), 0.8, F.col("received_at"))
    return pairs.select(F.col("a").alias("test_a"), F.col("b").alias("test_b"))


def p4_classes(spark: SparkSession, sf: str) -> DataFrame:
    """Every test with keys: its class of equal key sets and to how many other classes that class is linked."""
    members, links = setjoin.similar_classes(table(spark, sf, "tests"), "test_no", F.col("mutants"), 0.8, F.col("received_at"))
    ends = links.select(F.explode(F.array("a", "b")).alias("class_id")).groupBy("class_id").agg(F.count(F.lit(1)).alias("links"))
    return members.join(ends, "class_id", "left").select(F.col("id").alias("test_no"), "class_id", F.coalesce("links", F.lit(0)).alias("links"))


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    """The three findings of each (repo, method) that come first by severity, confidence and id."""
    findings = table(spark, sf, "findings").select("finding_id", "repo", "method", "severity", "confidence", "received_at")
    return topn.top_findings(findings, 3).select("finding_id", F.col("rank_no").cast("int").alias("rank_no"))


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    """Files that are not hand-written: generated, minified, copied from third parties, or data saved as code."""
    kinds = handwritten.classify_files(table(spark, sf, "source_analysis"))
    return kinds.where("kind <> 'hand-written'").select("file_id")


def p1_kinds(spark: SparkSession, sf: str) -> DataFrame:
    """Per kind of file: how many, and their lines of code, comment lines and opaque bytes by the latest measurement."""
    kinds = handwritten.classify_files(table(spark, sf, "source_analysis"))
    row = F.struct("measured_at", "sloc", "comment_lines", "opaque_bytes")
    latest = table(spark, sf, "measurement").where("file_id IS NOT NULL").groupBy("file_id").agg(F.max(row).alias("m"))
    total = lambda c: F.coalesce(F.sum(f"m.{c}"), F.lit(0)).alias(c)
    return kinds.join(latest, "file_id", "left").groupBy("kind").agg(F.count(F.lit(1)).alias("files"), total("sloc"), total("comment_lines"), total("opaque_bytes"))


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    """Files whose source has a syntax error in its language."""
    return syntax.syntax_verdicts(table(spark, sf, "source_analysis")).where("NOT valid").select("file_id")


def p2_errors(spark: SparkSession, sf: str) -> DataFrame:
    """Each broken file with the cause, the line of the furthest failure and what stands there."""
    return syntax.syntax_verdicts(table(spark, sf, "source_analysis")).where("NOT valid").select("file_id", "language", "cause", "line", "message")


def p2_rates(spark: SparkSession, sf: str) -> DataFrame:
    """Files, broken files and their share per repository and language."""
    return syntax.syntax_rates(syntax.syntax_verdicts(table(spark, sf, "source_analysis")))


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    """Declarations whose documentation is not trivial, of functions delimited by their nesting."""
    return docpairs.documented(table(spark, sf, "source_analysis"), with_code=True).select("file_id", "decl_id")


def p3_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Each documented function's code with its documentation."""
    return docpairs.code_doc_pairs(table(spark, sf, "source_analysis"))


def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    """Documents and the evaluation items with which they have ten or more successive words in common."""
    near = leaks.leaked_items(table(spark, sf, "documents"), table(spark, sf, "eval_items"), min_words=10, errors=1)
    return near.where("longest_run >= 10").select("doc_id", "item_id")


def p6_near(spark: SparkSession, sf: str) -> DataFrame:
    """As p6_found, with passages of ten words in which one word was changed, and how much of the item each gives away."""
    return leaks.leaked_items(table(spark, sf, "documents"), table(spark, sf, "eval_items"), min_words=10, errors=1)


def p6_items(spark: SparkSession, sf: str) -> DataFrame:
    """Every evaluation item with the number of documents that give it away word for word."""
    items = table(spark, sf, "eval_items").select("item_id", "suite")
    leaks_of = p6_found(spark, sf).groupBy("item_id").agg(F.count(F.lit(1)).alias("n"))
    return items.join(leaks_of, "item_id", "left").select("item_id", "suite", F.coalesce("n", F.lit(0)).alias("documents"))


def _mix(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    documents = table(spark, sf, "documents").select("doc_id", "text", "source", "lang")
    found = subjects.assign_subjects(documents, table(spark, sf, "subject_labels"), table(spark, sf, "subjects"))
    topics = found.select("doc_id", F.col("subject").alias("topic"))
    return mixing.mix_with_margins(documents, table(spark, sf, "mix_targets"), topics)


def p7_mix(spark: SparkSession, sf: str) -> DataFrame:
    """The documents of the mix and how often each is used."""
    return _mix(spark, sf)[0]


def p7_shares(spark: SparkSession, sf: str) -> DataFrame:
    """The share each source should have of the mix's tokens and the share it has."""
    return mixing.mix_report(_mix(spark, sf)[0], table(spark, sf, "mix_targets"))


def p7_margins(spark: SparkSession, sf: str) -> DataFrame:
    """Per source, language and topic the share it should have of the mix, the share planned and the share reached."""
    return mixing.margin_report(*_mix(spark, sf))


def p8_found(spark: SparkSession, sf: str) -> DataFrame:
    """Each document with the one or two subjects it deals with."""
    found = subjects.assign_subjects(table(spark, sf, "documents"), table(spark, sf, "subject_labels"), table(spark, sf, "subjects"))
    return found.select("doc_id", "subject")


def p8_composition(spark: SparkSession, sf: str) -> DataFrame:
    """Documents and their share per subject; a document with two subjects counts half for each."""
    found = p8_found(spark, sf)
    part = found.withColumn("part", 1 / F.count(F.lit(1)).over(Window.partitionBy("doc_id")))
    by = part.groupBy("subject").agg(F.count(F.lit(1)).alias("documents"), F.sum("part").alias("parts"))
    # as many rows as subjects
    return by.select("subject", "documents", F.round(F.col("parts") / F.sum("parts").over(Window.partitionBy(F.lit(1))), 6).alias("share"))


def queries() -> dict[str, Query]:
    return {"p1_found": p1_found, "p1_kinds": p1_kinds, "p2_found": p2_found, "p2_errors": p2_errors, "p2_rates": p2_rates, "p3_found": p3_found, "p3_pairs": p3_pairs, "p4_found": p4_found, "p4_classes": p4_classes, "p5_found": p5_found, "p6_found": p6_found, "p6_near": p6_near, "p6_items": p6_items, "p7_mix": p7_mix, "p7_shares": p7_shares, "p7_margins": p7_margins, "p8_found": p8_found, "p8_composition": p8_composition}


_KEYS = """
last AS (SELECT test_no, arg_max(mutants, received_at) AS mutants FROM tests GROUP BY test_no),
keys AS (SELECT DISTINCT test_no, lower(trim(m)) AS k FROM (SELECT test_no, unnest(mutants) AS m FROM last) WHERE m IS NOT NULL AND trim(m) <> ''),
sizes AS (SELECT test_no, count(*) AS n FROM keys GROUP BY test_no),
both_kill AS (SELECT a.test_no AS x, b.test_no AS y, count(*) AS o FROM keys a JOIN keys b ON a.k = b.k AND a.test_no < b.test_no GROUP BY 1, 2),
pairs AS (SELECT x AS test_a, y AS test_b FROM both_kill JOIN sizes s ON s.test_no = x JOIN sizes t ON t.test_no = y WHERE 5 * o >= 4 * (s.n + t.n - o))
"""


_LEAKS = r"""
texts AS (SELECT 'd' AS side, doc_id AS id, text FROM documents UNION ALL SELECT 'i', item_id, text FROM eval_items),
words AS (SELECT side, id, list_filter(regexp_split_to_array(regexp_replace(lower(regexp_replace(text, '\p{Cf}', '', 'g')), '[^\p{L}\p{N}]+', ' ', 'g'), ' '), lambda x: x <> '') AS w FROM texts WHERE text IS NOT NULL),
windows AS (SELECT DISTINCT side, id, array_to_string(w[p:p + 9], ' ') AS g FROM (SELECT side, id, w, unnest(range(1, len(w) - 8)) AS p FROM words WHERE len(w) >= 10)),
found AS (SELECT DISTINCT d.id AS doc_id, i.id AS item_id FROM windows d JOIN windows i ON d.g = i.g AND d.side = 'd' AND i.side = 'i')
"""


def oracle_sql() -> dict[str, str]:
    return {
        "p6_found": f"WITH {_LEAKS} SELECT doc_id, item_id FROM found",
        "p6_items": f"WITH {_LEAKS} SELECT item_id, suite, (SELECT count(*) FROM found f WHERE f.item_id = e.item_id) AS documents FROM eval_items e",
        "p4_found": f"WITH {_KEYS} SELECT test_a, test_b FROM pairs",
        "p4_classes": f"""WITH {_KEYS},
            sets AS (SELECT test_no, string_agg(k, chr(10) ORDER BY k) AS s FROM keys GROUP BY test_no),
            classes AS (SELECT s, min(test_no) AS class_id FROM sets GROUP BY s),
            members AS (SELECT test_no, class_id FROM sets JOIN classes USING (s)),
            links AS (SELECT DISTINCT m.class_id AS a, n.class_id AS b FROM pairs JOIN members m ON m.test_no = test_a JOIN members n ON n.test_no = test_b WHERE m.class_id <> n.class_id),
            undirected AS (SELECT DISTINCT least(a, b) AS a, greatest(a, b) AS b FROM links),
            ends AS (SELECT c, count(*) AS n FROM (SELECT a AS c FROM undirected UNION ALL SELECT b FROM undirected) GROUP BY c)
            SELECT test_no, class_id, coalesce(n, 0) AS links FROM members LEFT JOIN ends ON c = class_id""",
        "p5_found": r"""WITH last AS (
              SELECT * FROM findings WHERE finding_id IS NOT NULL
              QUALIFY row_number() OVER (PARTITION BY finding_id ORDER BY received_at DESC NULLS LAST) = 1),
            scored AS (
              SELECT finding_id, repo, method,
                coalesce(try_cast(nullif(regexp_extract(severity, '\(\s*([0-9]+(?:\.[0-9]+)?)\s*\)', 1), '') AS DOUBLE),
                         try_cast(nullif(regexp_extract(severity, '(?i)^\s*p?\s*([0-9]+(?:\.[0-9]+)?)\s*$', 1), '') AS DOUBLE)) AS s,
                try_cast(nullif(regexp_extract(confidence, '^\s*([0-9]+(?:\.[0-9]+)?)\s*%?\s*$', 1), '') AS DOUBLE)
                  / CASE WHEN contains(confidence, '%') THEN 100 ELSE 1 END AS c
              FROM last WHERE method IS NOT NULL AND repo IS NOT NULL),
            ranked AS (
              SELECT finding_id, row_number() OVER (PARTITION BY repo, method ORDER BY s ASC NULLS LAST, c DESC NULLS LAST, finding_id) AS rank_no FROM scored)
            SELECT finding_id, rank_no::INTEGER AS rank_no FROM ranked WHERE rank_no <= 3""",
    }
