"""All similar pairs between set-valued records, by a prefix-filtered join with length and positional filters.

Tokens travel as 64-bit digests. Sets are first grouped into classes of equal sets; the join runs between class representatives.
Tokens are ordered by rarity over all records. For a Jaccard threshold t two sets of sizes x >= y can only match if y >= t*x and
if a token of the first x - ceil(t*x) + 1 of the one is among the first y - ceil(2t/(1+t)*y) + 1 of the other (Xiao et al.,
"Efficient similarity joins for near duplicate detection"). Only these prefixes are indexed, under the token and a logarithmic
band of lengths; what shares one is verified by its whole overlap. A token that many sets hold is cut into slices.
"""

from __future__ import annotations

from math import log

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gritstone.session import checkpointed

#: Guards ceil() against binary rounding, e.g. 0.8 * 15 = 12.000000000000002
EPS = 1e-9
#: Sets under one token, and members under one class, that are kept together; more are cut into slices of about this size.
TOGETHER, MEMBERS = 20_000, 1_000


def canonical_sets(df: DataFrame, id_col: str, tokens: Column, newest: Column | None = None) -> DataFrame:
    """Rows ``(id, tokens)`` with the sorted digests of each record's distinct tokens: letter case and surrounding blanks do not
    count, nor do nulls. Of several rows with an id the one with the greatest ``newest`` counts, among equals the one whose
    digests are greatest.

    Records without tokens are in no pair and drop out.
    """
    clean = F.filter(F.transform(tokens, lambda x: F.lower(F.trim(x))), lambda x: x.isNotNull() & (x != ""))
    digests = F.array_sort(F.array_distinct(F.transform(clean, lambda x: F.xxhash64(x))))
    rows = df.select(F.col(id_col).alias("id"), F.struct((F.lit(0) if newest is None else newest).alias("newest"), digests.alias("tokens")).alias("row"))
    # digests are a fraction of the texts, and are all that is shuffled
    rows = rows.where("id IS NOT NULL").groupBy("id").agg(F.max("row").alias("row"))
    return rows.select("id", F.col("row.tokens").alias("tokens")).where("size(tokens) > 0")


def _ranked(reps: DataFrame) -> DataFrame:
    """``(id, n, ranked)``: each set's ``(freq, token)`` in the global order of rarity, rarest first."""
    tokens = reps.select("id", F.explode("tokens").alias("token"))
    frequency = tokens.groupBy("token").agg(F.count(F.lit(1)).cast("int").alias("freq"))
    ranked = tokens.join(frequency, "token").groupBy("id").agg(F.array_sort(F.collect_list(F.struct("freq", "token"))).alias("ranked"))
    return ranked.select("id", F.size("ranked").alias("n"), "ranked")


def _band(n: Column, t: float) -> Column:
    """The band of a length: lengths within a factor of ``t`` lie in the same or in adjacent bands."""
    return F.floor(F.log(n.cast("double")) / log(1 / t) + EPS).cast("int") if t < 1 else n.cast("int")


def similar_representatives(reps: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """Pairs ``(a, b, overlap, similarity)``, ``a < b``, of different sets in ``reps`` (``id``, ``tokens``) with Jaccard >= ``threshold``;
    ``sets`` has these rows too, perhaps among others, and is cheap to read again."""
    t = float(threshold)
    n = F.col("n")
    ranked = _ranked(reps)
    # the index prefix is the longer of the two where sets are long, never longer than the probe's; one row holds both
    longest = (n - F.ceil(n * t - EPS) + 1).cast("int")
    held = (n - F.ceil(n * (2 * t / (1 + t)) - EPS) + 1).cast("int")
    prefixes = checkpointed(ranked.select("id", "n", F.slice("ranked", 1, longest).alias("prefix"), held.alias("held")))
    rows = prefixes.select("id", "n", "held", F.posexplode("prefix").alias("pos", "x")).select("id", "n", "held", "pos", "x.token", F.ceil(F.col("x.freq") / TOGETHER).cast("int").alias("slices"))
    index = rows.where("pos < held").select(F.col("id").alias("q"), F.col("n").alias("ni"), F.col("pos").alias("j"), "token", _band(n, t).alias("band"), F.pmod(F.xxhash64("id"), F.col("slices")).cast("int").alias("slice"))
    bands = F.sequence(_band(F.ceil(n * t - EPS), t), _band(n, t))
    probe = rows.select(F.col("id").alias("p"), F.col("n").alias("np"), F.col("pos").alias("i"), "token", "slices", F.explode(bands).alias("band"))
    probe = probe.select("p", "np", "i", "token", "band", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)).alias("slice"))
    need = F.ceil((F.col("np") + F.col("ni")) * (t / (1 + t)) - EPS).cast("int")
    # positional filter: after this shared token no more can follow than the shorter rest of the two
    reach = F.least(F.col("np") - F.col("i"), F.col("ni") - F.col("j"))
    within = (F.col("ni") >= F.col("np") * t - EPS) & ((F.col("np") > F.col("ni")) | ((F.col("np") == F.col("ni")) & (F.col("p") < F.col("q"))))
    met = probe.join(index, ["token", "band", "slice"]).where(within & (F.col("p") != F.col("q")))
    # the first shared token of two sets stands at the least i, where the filter is exact
    first = F.min(F.struct("i", (reach >= need).alias("enough"))).alias("f")
    candidates = met.groupBy("p", "q").agg(first).where("f.enough").select("p", "q")
    left, right = sets.select(F.col("id").alias("p"), F.col("tokens").alias("tp")), sets.select(F.col("id").alias("q"), F.col("tokens").alias("tq"))
    overlap = F.size(F.array_intersect("tp", "tq"))
    union = F.size("tp") + F.size("tq") - F.col("overlap")
    return (
        candidates.join(left, "p")
        .join(right, "q")
        .select(F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b"), overlap.alias("overlap"), "tp", "tq")
        .withColumn("similarity", F.col("overlap") / union)
        .where(F.col("overlap") >= union * t - EPS)
        .select("a", "b", "overlap", "similarity")
    )


def similar_classes(df: DataFrame, id_col: str, tokens: Column, threshold: float = 0.8, newest: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """``(members, links)``: ``members(id, class_id)`` names each record's class of equal sets, ``links(a, b, overlap,
    similarity)`` are the pairs of classes at or above ``threshold``, by class id.

    Tokens and sets are told apart by 64-bit and 128-bit digests; among a billion different tokens the chance that any two are
    taken for one is 3 in 100, and it would change the overlap of the few sets that hold both.

    Defined cases: null ids, null or empty sets and sets of nulls alone are in no class; a repeated id counts once, by the
    greatest ``newest`` (null is least) and then the greatest digests; repeated, padded and differently cased tokens count once;
    an empty table gives empty results.
    """
    if not 0 < threshold <= 1:
        raise ValueError("threshold must be in (0, 1]")
    sets = checkpointed(canonical_sets(df, id_col, tokens, newest).select("id", F.xxhash64("tokens").alias("k1"), F.xxhash64(F.lit("second"), F.reverse("tokens")).alias("k2"), "tokens"))
    # a digest stands for the set, so that a class of any size is combined before the shuffle and never collected
    classes = sets.groupBy("k1", "k2").agg(F.min("id").alias("class_id"))
    members = sets.select("id", "k1", "k2").join(classes, ["k1", "k2"]).select("id", "class_id")
    reps = sets.select("id", "tokens").join(classes.select(F.col("class_id").alias("id")), "id", "left_semi")
    return members, similar_representatives(reps, sets, threshold)


def similar_pairs(df: DataFrame, id_col: str, tokens: Column, threshold: float = 0.8, newest: Column | None = None, members_together: int = MEMBERS) -> DataFrame:
    """Every pair ``(a, b)``, ``a < b``, of records whose sets are at least ``threshold`` alike, copies expanded. A class is cut into
    slices of about ``members_together``, and two slices meet in one place, so that no class is paired with itself in one task."""
    members, links = similar_classes(df, id_col, tokens, threshold, newest)
    sizes = members.groupBy("class_id").agg(F.count(F.lit(1)).alias("size"))
    sizes = sizes.select("class_id", F.ceil(F.col("size") / members_together).cast("int").alias("slices"), (F.col("size") > 1).alias("several"))
    members = members.join(sizes, "class_id").select("id", "class_id", F.pmod(F.xxhash64("id"), F.col("slices")).cast("int").alias("slice"))
    upto = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    one, two = (sizes.select(F.col("class_id").alias(c), F.col("slices").alias(f"n{c}")) for c in "ab")
    across = links.select("a", "b").join(one, "a").join(two, "b").select("a", "b", upto("na").alias("s"), "nb").select("a", "b", "s", upto("nb").alias("t"))
    within = sizes.where("several").select(F.col("class_id").alias("a"), F.col("class_id").alias("b"), upto("slices").alias("s"), "slices").select("a", "b", "s", upto("slices").alias("t")).where("s <= t")
    blocks = across.unionByName(within)
    left, right = (members.select(F.col("class_id").alias(c), F.col("slice").alias(s), F.col("id").alias(x)) for c, s, x in (("a", "s", "x"), ("b", "t", "y")))
    pairs = blocks.join(left, ["a", "s"]).join(right, ["b", "t"]).where((F.col("a") != F.col("b")) | (F.col("s") != F.col("t")) | (F.col("x") < F.col("y")))
    return pairs.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
