"""Near-duplicate documents by min-max hashing (operator 8)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .base import discard, documents, release, settle, settled, store
from .graph import components
from .shingles import WordHashes, mixed, shingle_set

#: Hash evaluations per shingle; each gives a minimum and a maximum, so signatures have twice as many values.
HASHES = 64
#: Values of a signature in a band. 32 bands of 4: a pair at similarity 0.8 shares none with probability 5e-8.
ROWS = 4
#: Narrow rows of intermediate tables in a partition at least.
ROWS_EACH = 100_000
#: Of the 128 values' low bytes, the fewest in common that a pair may have to be confirmed; at 0.8, 102.5 are expected (sd 4.5).
LEAST_COMMON = 72


def _constants() -> tuple[np.ndarray, np.ndarray]:
    seeds = mixed(np.arange(1, 2 * HASHES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return (seeds[:HASHES].astype(np.uint32) | np.uint32(1)), seeds[HASHES:].astype(np.uint32)


def signature(shingles: np.ndarray) -> np.ndarray:
    """Minimum and maximum of each hash over the set, as 2 * HASHES 32-bit values."""
    a, b = _constants()
    x = (shingles >> np.uint64(32)).astype(np.uint32)
    low, high = np.full(HASHES, 0xFFFFFFFF, dtype=np.uint32), np.zeros(HASHES, dtype=np.uint32)
    for i in range(0, len(x), 1024):  # a block stays in the cache
        v = a[:, None] * x[None, i : i + 1024] + b[:, None]
        np.minimum(low, v.min(axis=1), out=low)
        np.maximum(high, v.max(axis=1), out=high)
    return np.stack([low, high], axis=1).ravel()


def _sets(docs: DataFrame, words: int, sketch: bool) -> DataFrame:
    """Per document: its set's size, and either what finds candidates or the set itself."""
    n_bands = 2 * HASHES // ROWS

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = WordHashes()
        salt = mixed(np.arange(1, n_bands + 1, dtype=np.uint64))
        for b in batches:
            out = []
            for doc_id, text in zip(b["doc_id"].to_numpy(dtype=object), b["text"], strict=True):
                s = shingle_set(known.of(text.encode().lower().split() if isinstance(text, str) else []), words)
                if not sketch:
                    out.append((doc_id, s.view(np.int64)))
                elif not len(s):
                    out.append((doc_id, 0, 0, 0, None, None))
                else:
                    sig = signature(s)
                    key = salt.copy()
                    for j in range(ROWS):
                        key = mixed(key * np.uint64(3) + sig[j::ROWS].astype(np.uint64))
                    one, two = np.bitwise_xor.reduce(mixed(s)), np.add.reduce(mixed(s + np.uint64(1)))
                    # The low byte, mixed: the high bits of all minima of large sets are alike.
                    codes = (sig * np.uint32(0x9E3779B1) >> np.uint32(24)).astype(np.uint8).tobytes()
                    out.append((doc_id, len(s), int(one.view(np.int64)), int(two.view(np.int64)), key.view(np.int64), codes))
            cols = ["doc_id", "n", "k1", "k2", "bands", "codes"] if sketch else ["id", "shingles"]
            got = pd.DataFrame(out, columns=cols, dtype=object)
            yield got.assign(**{c: got[c].astype("Int64") for c in ("doc_id", "id") if c in cols})

    schema = "doc_id long, n long, k1 long, k2 long, bands array<long>, codes binary" if sketch else "id long, shingles array<long>"
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInPandas(run, schema)


def _alike(pairs: DataFrame, facts: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sizes and signatures allow the similarity, and which are worth confirming."""

    @F.pandas_udf("int")
    def common(x: pd.Series, y: pd.Series) -> pd.Series:
        one, two = (np.frombuffer(b"".join(z), np.uint8).reshape(len(z), -1) for z in (x, y))
        return pd.Series((one == two).sum(axis=1), dtype="int32")

    a = facts.select(F.col("id").alias("a"), F.col("n").alias("na"), F.col("codes").alias("ca"))
    b = facts.select(F.col("id").alias("b"), F.col("n").alias("nb"), F.col("codes").alias("cb"))
    near = pairs.join(a, "a").join(b, "b").where(f"100 * least(na, nb) >= {percent} * greatest(na, nb)")
    return near.where(common("ca", "cb") >= LEAST_COMMON).select("a", "b").distinct()


def _confirm(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs with 100 * intersection >= percent * union, on whole sets."""
    a = sets.select(F.col("id").alias("a"), F.col("shingles").alias("sa"))
    b = sets.select(F.col("id").alias("b"), F.col("shingles").alias("sb"))
    same = F.size(F.array_intersect("sa", "sb"))
    return pairs.join(a, "a").join(b, "b").where(100 * same >= percent * (F.size("sa") + F.size("sb") - same)).select("a", "b")


def _by_differences(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) that may be similar, of members (pivot, id, root, main) with other roots, one of them not main.

    With dx what x and the pivot do not share, x and y are apart by |dx| + |dy| - 2 |dx & dy|, of which a similar pair has
    at most c * (nx + ny). A member far from the pivot has a large dx, so a similar y must share at least some o elements
    of dx. Sorted alike, rarest first, the first |d| - o + 1 elements of both then have one in common (prefix filter), and
    pairs are joined on those alone. Elements that one member alone has are shared with nobody: u of them in dx and m
    others put x and y at least ux + uy + |mx - my| apart. A member that no pair of counts (u, m) of its pivot allows to be
    near is searched no further: so are all copies with many edits of their own. No similar pair is lost.
    """
    c = f"({100 - percent}D / {100 + percent})"
    most = f"({c} * n * {1 + 100 / percent!r}D + 1e-6)"
    own = members.join(sets, "id").join(sets.select(F.col("id").alias("pivot"), F.col("shingles").alias("theirs")), "pivot")
    apart = F.array_union(F.array_except("shingles", "theirs"), F.array_except("theirs", "shingles"))
    own = store(own.select("pivot", "id", "root", "main", F.size("shingles").alias("n"), F.size("theirs").alias("hn"), apart.alias("d")))
    direct = own.where(f"root <> main AND size(d) * {100 + percent} <= (n + hn) * {100 - percent}").select(F.col("pivot").alias("a"), F.col("id").alias("b"))
    elements = own.select("pivot", "id", F.explode("d").alias("e"))
    often, _ = settled(elements.groupBy("pivot", "e").agg(F.count("*").alias("c")).where("c > 1"), ROWS_EACH)
    order = elements.join(often, ["pivot", "e"]).groupBy("pivot", "id").agg(F.sort_array(F.collect_list(F.struct("c", "e"))).alias("o"))
    own = own.select("pivot", "id", "root", "main", "n", "hn", F.size("d").alias("t")).join(order, ["pivot", "id"], "left")
    own = store(own.withColumn("m", F.greatest(F.size("o"), F.lit(0))).withColumn("u", F.col("t") - F.col("m")))
    # For each m the least u: as many rows as sets have sizes, whatever the number of members.
    counts = own.groupBy("pivot", "m").agg(F.min("u").alias("u")).groupBy("pivot").agg(F.collect_list(F.struct("m", "u")).alias("counts"))
    may = own.where("root <> main").join(settle(counts), "pivot").where(f"exists(counts, k -> u + k.u + abs(m - k.m) <= {most})")

    def prefix(rows: DataFrame, least: str) -> DataFrame:
        keep = rows.withColumn("keep", F.expr(f"cast(m - ({least}) + 1 AS int)")).where("keep > 0")
        return keep.select("pivot", "id", "root", "n", "m", "u", F.explode(F.expr("slice(o.e, 1, keep)")).alias("e"))

    x = prefix(may, f"greatest(1, ceil((t - {c} * (n + hn)) / 2 - 1e-6), ceil(t - {most}))").alias("x")
    y = prefix(own, f"floor((t + {c} * (hn - n)) / 2 - 1e-6) + 1").alias("y")
    close = f"100 * least(x.n, y.n) >= {percent} * greatest(x.n, y.n) AND x.u + y.u + abs(x.m - y.m) <= {c} * (x.n + y.n) + 1e-6"
    met = x.join(y, F.expr(f"x.pivot = y.pivot AND x.e = y.e AND x.root <> y.root AND {close}"))
    return direct.unionByName(met.select(F.least("x.id", "y.id").alias("a"), F.greatest("x.id", "y.id").alias("b")).distinct())


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """Per row of `docs` (doc_id, text): doc_id, n_shingles, component_id, kept.

    Equal sets are one class, represented by its smallest doc_id. Classes meet in buckets of bands of their min-max
    signatures. No bucket is expanded into pairs: its members are compared with its smallest one, and those of buckets
    that still hold several components are searched by their differences from a pivot (_by_differences), which loses no
    link. Every link is confirmed on whole sets.
    A null or blank text has no shingles and is linked with nothing. Rows with one doc_id are one document with several
    texts; a null doc_id has component null and is kept. Texts of any length are taken whole; other columns are not
    looked at. An empty table gives no rows.
    """
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text")
    found = store(_sets(docs, words, sketch=True))
    ided = found.where("doc_id IS NOT NULL AND n > 0")
    classes = settle(ided.groupBy("k1", "k2", "n").agg(F.min("doc_id").alias("rep")))
    reps = ided.join(classes.select(F.col("rep").alias("doc_id"), "k1", "k2", "n"), ["doc_id", "k1", "k2", "n"], "left_semi")
    spread = reps.select(F.col("doc_id").alias("id"), F.explode("bands").alias("key"))
    full = settle(spread.groupBy("key").agg(F.count("*").alias("members"), F.min("id").alias("hub")).where("members > 1").drop("members"))
    buckets, _ = settled(spread.join(full, "key"), ROWS_EACH)
    release(spark)
    ids = settle(buckets.select("id").distinct())
    facts = store(reps.select(F.col("doc_id").alias("id"), "n", "codes").join(ids, "id", "left_semi"))
    texts = docs.join(ids, docs["doc_id"] == ids["id"], "left_semi")
    sets = store(_sets(texts, words, sketch=False))

    def confirmed(pairs: DataFrame) -> DataFrame:
        release(spark)
        likely, _ = settled(_alike(pairs, facts, percent), ROWS_EACH)
        return settled(_confirm(likely, sets, percent), ROWS_EACH)[0]

    tree = components(confirmed(buckets.where("id <> hub").select(F.col("hub").alias("a"), F.col("id").alias("b")).distinct()))
    release(spark)
    # A bucket's smallest member has met all others by now. Rows of one doc_id with several texts are joined by their id alone.
    named = buckets.where("id <> hub").join(tree, "id", "left").select("key", "id", F.coalesce("root", "id").alias("root"))
    sizes = named.groupBy("key", "root").agg(F.count("*").alias("c"))
    main = sizes.groupBy("key").agg(F.max_by("root", F.struct("c", "root")).alias("main"), F.count("*").alias("parts")).where("parts > 1").drop("parts")
    members, n = settled(named.join(settle(main), "key").select(F.col("main").alias("pivot"), "id", "root", "main").distinct(), ROWS_EACH)
    if n:
        more = confirmed(_by_differences(members, sets, percent))
        tree = components(more.unionByName(tree.select(F.col("id").alias("a"), F.col("root").alias("b"))))
    discard(facts, sets)
    named = settle(classes.join(tree, classes["rep"] == tree["id"], "left").select("k1", "k2", "n", F.coalesce("root", "rep").alias("root")))
    plain = found.select("doc_id", "n", "k1", "k2")
    own = F.coalesce("root", "doc_id")
    return plain.join(named, ["k1", "k2", "n"], "left").select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        F.when(F.col("doc_id").isNotNull(), own).alias("component_id"),
        F.coalesce(F.col("doc_id") == own, F.lit(True)).alias("kept"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir), words=4, percent=80)


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays: that with its smallest doc_id, in one row. Five words, 0.8.

    Of several rows with that doc_id the one with the least hash over all its columns stays, the same in each run. Rows
    without a doc_id all stay.
    """
    kept = near_duplicates(docs, words=5, percent=80).where("kept").select(F.col("doc_id").alias("kept_id"))
    kept = settle(kept.where("kept_id IS NOT NULL").distinct())
    known = docs.where("doc_id IS NOT NULL")
    # The join deals the documents by doc_id, so that taking one row of an id moves nothing again.
    known = known.join(kept, known["doc_id"] == kept["kept_id"], "left_semi")
    one = known.groupBy("doc_id").agg(F.min_by(F.struct(*docs.columns), F.xxhash64(*docs.columns)).alias("r")).select("r.*")
    return one.unionByName(docs.where("doc_id IS NULL"))
