"""Quality rules whose cutoffs are risk-controlled on labelled holdouts (operator 10). DataFrame expressions only."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .base import documents, settle, words

#: Most of a stratum's good documents that all rules together may reject, and the chance that any bound fails.
RISK, DELTA = 0.05, 0.05
#: Name, side that is rejected, and the cutoff at each level, mildest first: a level sets the cutoffs of all rules.
RULES: tuple[tuple[str, str, tuple[float, ...]], ...] = (
    ("symbols_per_word", ">", (1.0, 0.5, 0.3, 0.2, 0.1, 0.05, 0.03, 0.02)),
    ("chars_per_word_high", ">", (30.0, 20.0, 15.0, 12.0, 10.0, 9.0, 8.5, 8.0)),
    ("chars_per_word_low", "<", (1.0, 1.5, 2.0, 2.5, 3.0, 3.5, 3.75, 4.0)),
    ("dup_lines_per_word", ">", (0.5, 0.3, 0.2, 0.1, 0.05, 0.03, 0.02, 0.01)),
    ("repeated_words", ">", (0.45, 0.4, 0.35, 0.3, 0.25, 0.2, 0.15, 0.1)),
    ("few_words", "<", (50.0, 50.0, 50.0, 55.0, 60.0, 75.0, 100.0, 150.0)),
)
LEVELS = len(RULES[0][2])
#: Strata up to which their table is broadcast; beyond, documents are joined to it by a shuffle on a salted key.
STRATA, SALTS = 10_000, 64
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def metrics(docs: DataFrame, *keep: str) -> DataFrame:
    """The columns `keep` with the five base metrics of the whole text and base_failed.

    Three-word windows are compared by a 64-bit hash of their words within their document: hashes are sorted with their
    places in the row's own array, equal neighbours mark windows, and the marked places' steps give the words they cover.
    No row is exploded and nothing is shuffled.
    """
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(
        *keep,
        words(F.col("text")).alias("w"),
        F.length(F.regexp_replace(text, r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("lines"),
    )
    n = F.size("w")
    gram = lambda i: F.xxhash64(F.get("w", i), F.get("w", i + 1), F.get("w", i + 2))
    rows = rows.select(
        *keep,
        n.cast("long").alias("n_words"),
        F.length(F.array_join("w", "")).cast("long").alias("word_chars"),
        "n_symbols",
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.when(n >= 4, F.transform(F.sequence(F.lit(0), n - 3), gram)).alias("g"),
    )
    # Only documents with a repeated window go on; all others' arrays are null from here.
    rows = rows.withColumn("g", F.when(F.size(F.array_distinct("g")) < F.size("g"), F.sort_array(F.transform("g", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    same = lambda x, i: (F.get("g", i + 1)["h"] == x["h"]) | ((i > 0) & (F.get("g", i - 1)["h"] == x["h"]))
    rows = rows.withColumn("g", F.sort_array(F.filter("g", same)["i"]))
    step = lambda x, i: F.least(F.lit(3), F.coalesce(F.get("g", i + 1), x + 3) - x)
    covered = F.coalesce(F.aggregate(F.transform("g", step), F.lit(0), lambda a, x: a + x), F.lit(0)).cast("long")
    rows = rows.withColumn("n_repeat_words", covered).drop("g")
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return rows.withColumn("base_failed", failed)


def ratio(rule: str) -> Column:
    """What a rule measures; null, which no rule rejects, for documents without words."""
    of = {
        "symbols_per_word": F.col("n_symbols") / F.col("n_words"),
        "chars_per_word_high": F.col("word_chars") / F.col("n_words"),
        "chars_per_word_low": F.col("word_chars") / F.col("n_words"),
        "dup_lines_per_word": F.col("n_dup_lines") / F.col("n_words"),
        "repeated_words": F.col("n_repeat_words") / F.col("n_words"),
        "few_words": F.col("n_words").cast("double"),
    }
    return F.when(F.col("n_words") > 0, of[rule])


def severity() -> Column:
    """The mildest level at which a rule rejects the document; LEVELS if none does."""
    firsts = []
    for rule, side, cuts in RULES:
        value, first = ratio(rule), F
        for level, cut in enumerate(cuts):
            first = first.when(value > cut if side == ">" else value < cut, level)
        firsts.append(first.otherwise(LEVELS))
    return F.least(*firsts)


def binomial_tail(k: Column, n: Column, p: float) -> Column:
    """P(X <= k) for X binomial(n, p), summed exactly in logarithms; 1 where k is not below its mean."""
    first = n * F.lit(math.log1p(-p))
    odds = math.log(p) - math.log1p(-p)

    def add(acc: Column, i: Column) -> Column:
        term = acc["term"] + F.log((n - i + 1.0) / i) + odds
        return F.struct(term.alias("term"), (acc["sum"] + F.log1p(F.exp(term - acc["sum"]))).alias("sum"))

    start = F.struct(first.alias("term"), first.alias("sum"))
    some = F.when(k > 0, F.sequence(F.lit(1).cast("long"), k)).otherwise(F.array().cast("array<long>"))
    return F.when(k < n * F.lit(p), F.exp(F.aggregate(some, start, add, lambda a: a["sum"]))).otherwise(F.lit(1.0))


def thresholds(found: DataFrame, labels: DataFrame, stratum: str = "lang", risk: float = RISK, delta: float = DELTA) -> DataFrame:
    """(stratum, level, cutoffs): per stratum its level and, for reading, the cutoff of each rule there.

    The holdout is every labelled document that passes the base rules. Levels are nested, and tested from the mildest on
    until one fails (a fixed sequence, which needs no further correction); a level is certified if k or fewer false
    rejections among n good documents would have probability at most delta / strata, were the true rate above `risk`: the
    exact one-sided binomial bound, with Bonferroni's correction over strata. Of the certified levels that reject a larger
    part of the bad than of the good, the one with the largest difference is taken; ties: the mildest. Strata without a
    level are absent.
    """
    known = labels.where("quality IN (0, 1) AND doc_id IS NOT NULL").select("doc_id", "quality").distinct()
    rows = found.where("NOT base_failed").join(known, "doc_id").withColumn("severity", severity())
    good, at = F.col("quality") == 1, lambda level: F.col("severity") <= level
    cells = [F.struct(F.lit(level).alias("level"), F.count_if(at(level) & good).alias("k"), F.count_if(at(level) & ~good).alias("hits")) for level in range(LEVELS)]
    table = settle(rows.groupBy(stratum).agg(F.count_if(good).alias("n"), F.count_if(~good).alias("m"), F.array(*cells).alias("cells")))
    strata = max(1, table.count())
    each = table.select(stratum, "n", "m", F.inline("cells"))
    sure = binomial_tail(F.col("k"), F.col("n").cast("double"), risk) <= delta / strata
    # The first level that fails ends the sequence.
    chain = each.withColumn("fails", F.when(sure, LEVELS).otherwise(F.col("level")))
    ends = chain.groupBy(F.col(stratum).alias("s")).agg(F.min("fails").alias("end"))
    gain = F.col("hits") / F.col("m") - F.col("k") / F.col("n")
    picked = each.join(settle(ends), F.col(stratum).eqNullSafe(F.col("s"))).where("level < end AND n > 0 AND m > 0").withColumn("gain", gain).where("gain > 0")
    best = picked.groupBy(F.col(stratum).alias("stratum")).agg(F.max_by("level", F.struct(F.col("gain"), -F.col("level"))).alias("level"))
    cutoffs = F.array(*[F.create_map(*[F.lit(x) for rule, _, cuts in RULES for x in (rule, cuts[level])]) for level in range(LEVELS)])
    return best.select("stratum", "level", F.get(cutoffs, "level").alias("cutoffs"))


def judged(found: DataFrame, limits: DataFrame, stratum: str = "lang") -> DataFrame:
    """Adds kept: neither a base rule nor the cutoffs of its stratum's level reject the document."""
    limits = settle(limits.select("stratum", "level"))
    if limits.count() <= STRATA:
        rows = found.join(F.broadcast(limits), found[stratum].eqNullSafe(limits["stratum"]), "left")
    else:
        # A stratum may hold a large part of the documents: they are dealt over SALTS copies of its row.
        many = limits.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        dealt = found.withColumn("salt_", F.pmod(F.xxhash64(*BASE, F.monotonically_increasing_id()), F.lit(SALTS)).cast("int"))
        rows = dealt.join(many, dealt[stratum].eqNullSafe(many["stratum"]) & (dealt["salt_"] == many["salt"]), "left").drop("salt", "salt_")
    hit = F.coalesce(severity() <= F.col("level"), F.lit(False))
    return rows.withColumn("kept", ~F.col("base_failed") & ~hit).drop("stratum", "level")


def judge(docs: DataFrame, labels: DataFrame, stratum: str = "lang") -> DataFrame:
    """One row per document with doc_id, the stratum, the base metrics, base_failed and kept.

    A null or blank text has no words, so base rules reject it; a text of any length is measured whole. A null stratum is a
    stratum. A stratum without enough labelled documents for a level to be certified rejects nothing beyond the base
    rules. Documents with a null doc_id are judged but are no holdout; a doc_id with both labels counts as one good and
    one bad document, and rows that share a doc_id each count. Without labels, or without documents, only base rules act.
    Other columns are not looked at.
    """
    found = settle(metrics(docs, "doc_id", stratum))
    return judged(found, thresholds(found, labels, stratum), stratum)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(documents(spark, sf_dir), documents(spark, sf_dir, "labels")).select("doc_id", *BASE, "base_failed", "kept")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that no rule rejects. Rows that share a doc_id stay if one of them does."""
    good = settle(judge(docs, documents(spark, sf_dir, "labels")).where("kept").select(F.col("doc_id").alias("id")).distinct())
    return docs.join(good, docs["doc_id"].eqNullSafe(good["id"]), "left_semi")
