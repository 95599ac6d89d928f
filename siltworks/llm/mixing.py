"""Mixing of sources to target weights by a time-varying curriculum (operator 7)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .base import documents, n_words, ranked, settle, store

#: Weights of the sources, in code point order, repeating.
WEIGHTS = (1, 2, 3)
#: No source, and no document, is taken more often than this.
MOST = 3
#: Part of a source's share that its schedule moves through training: 0 keeps shares constant, 1 lets the extremes reach 0.
TILT = 0.5


def targets(units: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: float = MOST) -> DataFrame:
    """One row per source: source, source_size, weight, target, begin (the sizes of all earlier sources).

    `units` has source and size. Targets share the sum of all sizes by weight; one above `most` times its source's
    size stops there and the excess is shared again by weight. That is done by raising one level: each round caps the
    sources that the level overfills and spreads the rest, in aggregates over the table of sources, until no more fall.
    A source without words has target 0. No source is collected.
    """
    sums = units.groupBy("source").agg(F.sum("size").alias("source_size"))
    table = ranked(sums, F.col("source").isNull(), F.col("source"), weight="source_size")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("pos") % len(weights) + 1).cast("int"))
    table = settle(table.select("source", "source_size", F.col("before").alias("begin"), weight.alias("weight")))
    full = F.col("source_size") * float(most)
    level, capped = 0.0, -1
    while True:
        over = full < F.col("weight") * F.lit(level) if capped >= 0 else F.lit(False)
        r = table.agg(
            F.sum("source_size").alias("all"),
            F.sum(F.when(over, full).otherwise(0.0)).alias("held"),
            F.sum(F.when(over, 0.0).otherwise(F.col("weight"))).alias("free"),
            F.count_if(over).alias("n"),
        ).first()
        if not r["all"] or r["n"] == capped or not r["free"]:
            break
        level, capped = (r["all"] - r["held"]) / r["free"], r["n"]
    return table.withColumn("target", F.least(full, F.col("weight") * F.lit(float(level))))


def position(done: Column, share: Column, tilt: Column) -> Column:
    """When, from 0 to 1 of training, a source has supplied the part `done` of its target.

    A source's share of the mix at time t is share + tilt * (2t - 1); its supply up to t is share*t + tilt*(t*t - t).
    The inverse is the root of that quadratic, in the form that stays exact for tilt near 0.
    """
    b, c = share - tilt, done * share
    root = F.sqrt(F.greatest(b * b + 4.0 * tilt * c, F.lit(0.0)))
    return F.when((b + root) > 0, F.least(F.lit(1.0), 2.0 * c / (b + root))).otherwise(F.lit(0.0))


def mix(units: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: float = MOST, tilt: float = TILT, seed: int = 7, keep: tuple[str, ...] = ()) -> DataFrame:
    """Adds source_size, target, taken, copies, position and stream (its place in the source's shuffled stream).

    `units` has doc_id, source, size (words, long). Every source is a stream of its documents in an order hashed from
    doc_id; epochs of that stream are read until the target is reached, so each document is taken whole as often as
    whole epochs fit, and once more in the last epoch as far as the target reaches: of at most one document a part.
    So taken words of a source are its rounded target. Shares drift: weightier sources rise, lighter ones sink, and
    shares sum to 1 at all times. Reruns agree, also where doc_id repeats (equal rows stay equal as a set).
    Nulls: a null source is a source of its own, the last; a null doc_id hashes as any value; a null size counts 0.
    Columns of `units` named in `keep` stay, and order rows that agree in all else.
    Documents without words get taken 0 and position 0. Texts of any length count whole; columns of other names are not
    looked at. An empty table gives an empty result.
    """
    # Read three times below; the words of a text are counted once.
    units = settle(units.select("doc_id", "source", F.coalesce("size", F.lit(0)).cast("long").alias("size"), *keep))
    table = targets(units, weights, most)
    # Shares at time t: q + d * (2t - 1), with d = tilt * q * (z - mean of z) and z in 0..1 rising with the weight.
    low, high = float(min(weights)), float(max(weights))
    z = (F.col("weight") - low) / ((high - low) or 1.0)
    sums = table.agg(F.sum("target").alias("t"), F.sum(F.col("target") * z).alias("tz")).first()
    whole, mean = (sums["t"] or 1.0), (sums["tz"] or 0.0) / (sums["t"] or 1.0)
    q = F.col("target") / F.lit(whole)
    table = table.withColumns({"q": q, "d": F.lit(float(tilt)) * q * (z - F.lit(mean))})
    key = F.md5(F.concat_ws("/", F.lit(str(seed)), F.col("doc_id").cast("string")))
    rows = ranked(units.withColumns({"last": F.col("source").isNull(), "key": key}), *map(F.col, ("last", "source", "key", "doc_id", "size", *keep)), weight="size")
    at = F.col("u.before") - F.col("s.begin")
    joined = rows.alias("u").join(table.alias("s"), F.col("u.source").eqNullSafe(F.col("s.source"))).select(
        "u.doc_id", "u.source", "u.size", "s.source_size", "s.target", "s.q", "s.d", at.alias("stream"), *[f"u.{c}" for c in keep]
    )
    goal = F.round("target").cast("long")
    epochs = F.when(F.col("source_size") > 0, F.expr("cast(round(target) AS long) div source_size")).otherwise(F.lit(0)).cast("long")
    left = F.least(F.greatest(goal - epochs * F.col("source_size") - F.col("stream"), F.lit(0)), F.col("size"))
    return (
        joined.withColumn("epochs", epochs)
        .withColumn("part", left.cast("long"))
        .withColumn("taken", F.col("epochs") * F.col("size") + F.col("part"))
        .withColumn("copies", F.when(F.col("size") > 0, F.col("epochs") + (F.col("part") > 0).cast("long")).otherwise(F.lit(0)).cast("long"))
        .withColumn("position", F.when(F.col("target") > 0, position(F.col("stream") / F.col("target"), F.col("q"), F.col("d"))).otherwise(F.lit(0.0)))
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, range-sorted by their training position."""
    units = documents(spark, sf_dir).select("doc_id", "source", n_words(F.col("text")).alias("size"))
    mixed = mix(units).select("doc_id", "size", "source_size", "target", "taken", "position")
    by = [F.col("position"), F.col("doc_id"), F.col("size")]
    return settle(mixed).repartitionByRange(*by).sortWithinPartitions(*by).select("doc_id", "size", "source_size", "target", "taken", F.round("position", 6).alias("position"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixed corpus: documents as often as taken, in training order, with the columns of `docs`.

    Every document is taken whole: the last epoch ends at the boundary of a document that is nearest to the target, so
    that the words taken from a source differ from its rounded target by at most half a document. Each row has a plan of
    its own, also where doc_id repeats or is null. A document without words, or beyond its source's target, is not taken.
    """
    # The document stays one struct, so that its columns' names cannot meet the plan's.
    docs_ = store(docs.select(F.struct("*").alias("doc"), F.monotonically_increasing_id().alias("row")))
    units = docs_.select("doc.doc_id", "doc.source", n_words(F.col("doc.text")).alias("size"), F.xxhash64("doc").alias("tie"), "row")
    plan = mix(units, keep=("tie", "row"))
    times = F.col("epochs") + (F.col("part") * 2 >= F.col("size")).cast("long")
    plan = settle(plan.where("size > 0").withColumn("times", times).where("times > 0").select("row", "source_size", "target", "q", "d", "stream", "times"))
    rows = docs_.join(plan, "row").select("doc", "source_size", "target", "q", "d", "stream", F.explode(F.sequence(F.lit(0).cast("long"), F.col("times") - 1)).alias("copy"))
    done = (F.col("copy") * F.col("source_size") + F.col("stream")) / F.col("target")
    rows = rows.select("doc", "copy", position(done, F.col("q"), F.col("d")).alias("at"))
    by = [F.col("at"), F.col("doc.doc_id"), F.col("copy")]
    return rows.repartitionByRange(*by).sortWithinPartitions(*by).select("doc.*")
