"""Fuzzy duplicates: pairs of rows whose keys are similar by token-sorted longest common subsequence."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import Limits
from ..functions.text import fuzzy_key, token_sorted
from .common import ROW_ID, col

#: Keys up to this length are compared in one BIGINT; 62 keeps the sums below its sign.
BITS = 62
#: Longest keys whose subsequences with one, two and three characters less are listed: a thousand at most for each key.
LISTED = (100, 32, 19)
#: Rows of one key that go together when pairs of keys become pairs of rows; a task holds the pairs of two such lists at once.
TOGETHER = 64


def least_common(t: float) -> str:
    """SQL: the common characters that the threshold asks of keys a and b."""
    return f"greatest(ceil({t / 2!r}D * (a.n + b.n) - 1e-9D), 1)"


def listed(t: float) -> str:
    """SQL: whether keys a and b, a the longer, are to meet on subsequences; else they meet on prefixes."""
    return f"a.n <= CASE a.n - {least_common(t)} WHEN 0 THEN a.n " + " ".join(f"WHEN {k} THEN {n}" for k, n in enumerate(LISTED, 1)) + " ELSE 0 END"


def lengths_that_meet(keys: DataFrame, t: float) -> list:
    """For each length of keys: `cut`, how many characters less the subsequences have on which such keys meet others (null: on none), and `far`, whether some are met on prefixes."""
    lengths = keys.select("n").distinct()
    pairs = lengths.alias("a").join(lengths.alias("b"), F.expr(f"a.n >= b.n AND b.n >= {least_common(t)}"))
    pairs = pairs.select(F.expr(listed(t)).alias("listed"), F.inline(F.expr(f"array(struct(a.n AS n, a.n - {least_common(t)} AS cut), struct(b.n AS n, b.n - {least_common(t)} AS cut))")))
    return pairs.groupBy("n").agg(F.max(F.when(F.col("listed"), F.col("cut"))).cast("int").alias("cut"), F.max(~F.col("listed")).alias("far")).collect()


def subsequences(keys: DataFrame, deepest: int) -> DataFrame:
    """A row for each key and each subsequence of it with up to `cut` characters less."""
    keys = keys.withColumn("cut0", F.array("sorted"))
    for k in range(1, deepest + 1):
        less = f"flatten(transform(cut{k - 1}, s -> transform(sequence(1, greatest(length(s), 1)), p -> concat(substring(s, 1, p - 1), substring(s, p + 1)))))"
        keys = keys.withColumn(f"cut{k}", F.expr(f"IF(cut >= {k}, array_distinct({less}), CAST(array() AS array<string>))"))
    return keys.select("block", "key", "n", F.explode(F.concat(*(f"cut{k}" for k in range(deepest + 1)))).alias("part"))


def masks(key: Column) -> Column:
    """Where each character of the key stands, as bits: a map that is made once per row, not per pair."""
    chars = F.transform(F.split(key, ""), lambda x, i: F.struct(x.alias("x"), i.alias("i")))
    kinds = F.array_distinct(F.split(key, ""))
    bits = lambda c: F.aggregate(chars, F.lit(0).cast("long"), lambda m, s: m + F.when(s["x"] == c, F.expr("1L").cast("long") * F.pow(F.lit(2.0), s["i"]).cast("long")).otherwise(F.lit(0).cast("long")))
    return F.map_from_arrays(kinds, F.transform(kinds, bits))


def bag(key: Column, least: int) -> Column:
    """One bit for each character that stands `least` times or oftener (characters may share one)."""
    chars = F.split(key, "")
    often = F.filter(F.array_distinct(chars), lambda c: F.size(F.filter(chars, lambda x: x == c)) >= least)
    return F.aggregate(often, F.lit(0).cast("long"), lambda m, c: m.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), (F.ascii(c) % 62).cast("int"))))


def prefix(key: Column, t: float) -> Column:
    """The tokens of which two keys that are similar enough have one in common.

    A token is a character and the number of its occurrence. A key of n characters shares at least o of them with any key
    that its length allows, so of the tokens in one order the first n - o + 1 of both must meet. Late occurrences, which
    fewer keys have, come first.
    """
    chars, n = F.split(key, ""), F.length(key)
    each = F.transform(F.array_distinct(chars), lambda c: F.transform(F.sequence(F.lit(1), F.size(F.filter(chars, lambda x: x == c))), lambda k: F.struct((-k).alias("k"), F.xxhash64(c).alias("h"), c.alias("c"))))
    least = F.ceil(n * F.lit(t / (2 - t)) - 1e-9)
    shared = F.greatest(F.ceil(F.lit(t / 2) * (n + least) - 1e-9), F.lit(1))
    tokens = F.transform(F.sort_array(F.flatten(each)), lambda s: F.concat(s["c"], s["k"].cast("string")))
    return F.slice(tokens, 1, (n - shared + 1).cast("int"))


def lcs(a_masks: Column, a_length: Column, b: Column) -> Column:
    """Length of the longest common subsequence, bit-parallel over the characters of b; a has at most 62."""
    ones = (F.pow(F.lit(2.0), a_length).cast("long") - 1).cast("long")

    def step(v: Column, c: Column) -> Column:
        u = v.bitwiseAND(F.coalesce(F.element_at(a_masks, c), F.lit(0).cast("long")))
        return ((v + u).bitwiseOR(v - u)).bitwiseAND(ones)

    return a_length - F.bit_count(F.aggregate(F.split(b, ""), ones, step))


@F.pandas_udf(T.IntegerType())
def lcs_long(a: pd.Series, b: pd.Series) -> pd.Series:
    """The same for keys of any length, on Python's whole numbers."""
    out = []
    for x, y in zip(a, b, strict=True):
        where: dict[str, int] = {}
        for i, c in enumerate(x or ""):
            where[c] = where.get(c, 0) | 1 << i
        ones = v = (1 << len(x or "")) - 1
        for c in y or "":
            u = v & where.get(c, 0)
            v = ((v + u) | (v - u)) & ones
        out.append(len(x or "") - v.bit_count())
    return pd.Series(out, dtype="int32")


def near_pairs(keys: DataFrame, t: float, deepest: int) -> DataFrame:
    """Pairs of keys that have a listed subsequence in common. All that meet are similar enough; the longest is their common part."""
    sent = subsequences(keys, deepest)
    longer = f"(a.n > b.n OR a.n = b.n AND a.key < b.key) AND length(a.part) >= {least_common(t)} AND {listed(t)}"
    met = sent.alias("a").join(sent.alias("b"), F.expr(f"a.block = b.block AND a.part = b.part AND {longer}"))
    pairs = met.groupBy(F.col("a.block").alias("block"), F.col("a.key").alias("ka"), F.col("b.key").alias("kb")).agg(F.max(F.length("a.part")).alias("common"))
    return pairs.withColumn("raw", 2.0 * F.col("common") / (F.length("ka") + F.length("kb"))).where(F.col("raw") >= t - 1e-12).drop("common")


def far_pairs(keys: DataFrame, t: float) -> DataFrame:
    """Pairs of keys whose subsequences would be too many: they meet on a token of their prefixes, and are compared."""
    keys = keys.withColumn("masks", F.when(F.col("n") <= BITS, masks(F.col("sorted"))))
    keys = keys.withColumns({f"bag{k}": bag(F.col("sorted"), k) for k in (1, 2, 3)})
    # Characters that one key has oftener than the other cannot be common: a bound on the similarity, and lossless.
    left_over = lambda x, y: f"{x}.n - " + " - ".join(f"bit_count({x}.bag{k} & ~{y}.bag{k})" for k in (1, 2, 3))
    can = f"2.0 * least({left_over('a', 'b')}, {left_over('b', 'a')}) >= {t!r} * (a.n + b.n) - 1e-9"
    if t > 0:
        sent = keys.withColumn("tokens", prefix(F.col("sorted"), t)).withColumn("token", F.explode("tokens"))
        longer = f"(a.n > b.n OR a.n = b.n AND a.key < b.key) AND b.n >= {t / (2 - t)!r}D * a.n - 1e-9 AND NOT {listed(t)}"
        met = sent.alias("a").join(sent.alias("b"), F.expr(f"a.block = b.block AND a.token = b.token AND {longer} AND {can} AND array_intersect(a.tokens, b.tokens)[0] = a.token"))
    else:
        met = keys.alias("a").join(keys.alias("b"), F.expr("a.block = b.block AND a.key < b.key"))
    # The longer side is a; where it fits, its masks serve, else the shorter's.
    short = lcs(F.coalesce("a.masks", "b.masks"), F.when(F.col("a.masks").isNotNull(), F.col("a.n")).otherwise(F.col("b.n")), F.when(F.col("a.masks").isNotNull(), F.col("b.sorted")).otherwise(F.col("a.sorted")))
    pairs = met.select(F.col("a.block").alias("block"), F.col("a.key").alias("ka"), F.col("b.key").alias("kb"), F.col("a.n").alias("na"), F.col("b.n").alias("nb"), F.col("a.sorted").alias("sa"), F.col("b.sorted").alias("sb"), short.alias("fit"))
    is_long = F.least("na", "nb") > BITS
    common = F.when(is_long, lcs_long(F.when(is_long, F.col("sa")), F.when(is_long, F.col("sb")))).otherwise(F.col("fit"))
    return pairs.withColumn("raw", 2.0 * common / (F.col("na") + F.col("nb"))).where(F.col("raw") >= t - 1e-12).select("block", "ka", "kb", "raw")


def rows_of_pairs(scored: DataFrame, rows: DataFrame, sizes: DataFrame) -> DataFrame:
    """(index_a, index_b, key_a, key_b, similarity, raw): each row of a pair's one key with each of its other.

    Rows of a key go in lists of about TOGETHER. Lists meet lists and are dealt anew, so that the pairs of two frequent keys
    are made by many tasks, and only where they are read.
    """
    piece = F.expr(f"pmod(xxhash64(i), CAST(ceil(size / {TOGETHER}) AS BIGINT))").alias("piece")
    lists = rows.join(sizes, ["block", "key"]).groupBy("block", "key", piece).agg(F.collect_list("i").alias("ids"))
    side = lambda x: lists.select("block", F.col("key").alias(f"k{x}"), F.col("piece").alias(f"piece_{x}"), F.col("ids").alias(f"ids_{x}"))
    met = scored.withColumn("similarity", F.round("raw", 3)).join(side("a"), ["block", "ka"]).join(side("b"), ["block", "kb"])
    # By number, as partitions of few bytes can hold many pairs and are not to be put together.
    met = met.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), "block", "ka", "kb", "piece_a", "piece_b")
    each = met.select("ka", "kb", "similarity", "raw", "ids_b", F.explode("ids_a").alias("ia")).select("ka", "kb", "similarity", "raw", "ia", F.explode("ids_b").alias("ib"))
    flip = F.col("ia") > F.col("ib")
    two = lambda x, y: (F.when(flip, F.col(y)).otherwise(F.col(x)), F.when(flip, F.col(x)).otherwise(F.col(y)))
    (ia, ib), (ka, kb) = two("ia", "ib"), two("ka", "kb")
    return each.select(ia.alias("index_a"), ib.alias("index_b"), ka.alias("key_a"), kb.alias("key_b"), "similarity", "raw")


def fuzzy_pairs(
    df: DataFrame, columns: list[str], threshold: float = 0.85, row_id: str = ROW_ID, limits: Limits = Limits(), block: Column | None = None, ordered: bool = True
) -> DataFrame | None:
    """(index_a, index_b, key_a, key_b, similarity): rows a < b with unequal keys and similarity of at least the threshold.

    Distinct keys are compared, not rows. Where the threshold leaves few characters out, keys meet on the subsequences that
    it allows, so only similar ones meet; others share a token of their prefixes (a hash join, lossless) and have lengths and
    characters that allow the threshold; such a pair is taken at its first shared token. A threshold of 0 asks for
    all pairs. A `block` column makes keys meet only within its value, which is quicker and may lose pairs. None beyond
    the row limit. The pair limit takes the most similar pairs. The most similar come first, unless `ordered` is off: copies
    of two keys are paired row by row, and sorting these pairs takes far more than making them.
    """
    if not isinstance(threshold, (int, float)) or isinstance(threshold, bool) or not 0 <= threshold <= 1:
        raise ValueError("threshold: a number from 0 to 1")
    names = [c for c in dict.fromkeys(columns) if c in df.columns]
    if not names:
        raise ValueError("columns: at least one column of the table")
    if limits.max_fuzzy_rows is not None and df.limit(limits.max_fuzzy_rows + 1).count() > limits.max_fuzzy_rows:
        return None
    rows = df.select(col(row_id).alias("i"), fuzzy_key(*map(col, names)).alias("key"), (block if block is not None else F.lit(0)).alias("block")).where("key IS NOT NULL AND key <> ''")
    sizes = rows.groupBy("block", "key").agg(F.count("*").alias("size"))
    keys = sizes.select("block", "key", token_sorted(F.col("key")).alias("sorted"), F.length("key").alias("n"))
    t = float(threshold)
    if t > 0:
        lengths = lengths_that_meet(rows.select(F.length("key").alias("n")), t)
        deepest = max((r.cut for r in lengths if r.cut is not None), default=0)
        keys = keys.join(F.broadcast(df.sparkSession.createDataFrame(lengths, "n int, cut int, far boolean")), "n")
        scored = near_pairs(keys.where("cut IS NOT NULL"), t, deepest)
        if any(r.far for r in lengths):
            scored = scored.unionByName(far_pairs(keys.where("far"), t))
    else:
        scored = far_pairs(keys, t)
    out = rows_of_pairs(scored, rows, sizes)
    if ordered or limits.max_fuzzy_pairs is not None:
        out = out.orderBy(F.desc("similarity"), "index_a", F.desc("raw"), "index_b")
    return (out if limits.max_fuzzy_pairs is None else out.limit(limits.max_fuzzy_pairs)).drop("raw")
