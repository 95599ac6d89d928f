"""Near-duplicate vectors by randomised-rotation binary codes with stored correction factors (operator 1)."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .base import discard, documents, release, settle, settled, store
from .graph import components
from .shingles import mixed

COSINE = 0.9
#: Chance that a pair at exactly the threshold meets in no band of code bits.
MISS = 1e-4
#: Width of the confidence bound, in the estimate's standard errors.
SURE = 4.5


def rotation(dim: int, which: int) -> np.ndarray:
    """A random orthogonal matrix, the same in every worker."""
    q, r = np.linalg.qr(np.random.default_rng([7, dim, which]).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def plan(n: int, cosine: float = COSINE, miss: float = MISS) -> tuple[int, int]:
    """Bits in a band, which grow with log2 of the vectors, and the number of bands for the wanted recall."""
    bits = max(4, math.ceil(math.log2(max(n, 2))) + 1)
    meet = (1 - math.acos(cosine) / math.pi) ** bits
    return bits, math.ceil(math.log(miss) / math.log1p(-meet))


def _codes(vectors: DataFrame, bits: int, bands: int) -> DataFrame:
    """Per vector: digest, bands of sign bits, code (64 bits a long) and correction factor, and its rotated unit vector."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        salt = mixed(np.arange(1, bands + 1, dtype=np.uint64))
        weights = np.uint64(1) << np.arange(bits, dtype=np.uint64)
        known: dict[int, np.ndarray] = {}
        for b in batches:
            out = []
            for vec_id, v in zip(b["vec_id"].to_numpy(dtype=object), b["embedding"], strict=True):
                # None within an array arrives as NaN.
                x = np.asarray([] if v is None else v, dtype=np.float64)
                if not (len(x) and np.isfinite(x).all() and x.any()):
                    out.append((vec_id, None, None, None, None, None, None, None, None))
                    continue
                u = scaled(x[None])[0]
                u /= np.sqrt(u @ u)
                d = len(u)
                if d not in known:
                    known.clear()
                    known[d] = np.concatenate([rotation(d, t) for t in range(-(-bits * bands // d))])
                turned = known[d] @ u
                signs = turned[: bits * bands] > 0
                keys = (signs.reshape(bands, bits) * weights).sum(axis=1, dtype=np.uint64)
                r = turned[:d]
                digest = xxhash.xxh128_intdigest((x + 0.0).tobytes())
                code = np.packbits(np.concatenate([r > 0, np.zeros(-d % 64, dtype=bool)])).view("<i8")
                out.append((
                    vec_id, int(np.uint64(digest & (2**64 - 1)).view(np.int64)), int(np.uint64(digest >> 64).view(np.int64)), d,
                    mixed(keys * np.uint64(2) + salt * np.uint64(d)).view(np.int64),
                    code, float(np.abs(r).sum() / math.sqrt(d)), r.astype("<f4").tobytes(), x,
                ))
            got = pd.DataFrame(out, columns=["vec_id", "k1", "k2", "dim", "bands", "code", "factor", "turned", "embedding"], dtype=object)
            yield got.assign(**{c: got[c].astype("Int64") for c in ("vec_id", "k1", "k2", "dim")})

    return vectors.mapInPandas(run, "vec_id long, k1 long, k2 long, dim int, bands array<long>, code array<long>, factor double, turned binary, embedding array<double>")


def scaled(x: np.ndarray) -> np.ndarray:
    """Rows times a power of two, exact, so that squares of the largest and smallest doubles stay finite."""
    _, e = np.frexp(np.abs(x).max(axis=1, keepdims=True))
    return np.ldexp(x, -e)


def cosines(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Of the rows of two matrices, in double precision."""
    x, y = scaled(x), scaled(y)
    return (x * y).sum(axis=1) / np.sqrt((x * x).sum(axis=1) * (y * y).sum(axis=1))


def bound(turned: np.ndarray, signs: np.ndarray, factor: np.ndarray, sure: float = SURE) -> tuple[np.ndarray, np.ndarray]:
    """Per row: the unbiased estimate of the inner product with the vector of that code, and the half width of its bound."""
    d = turned.shape[1]
    estimate = (np.where(signs, 1.0, -1.0) * turned).sum(axis=1) / math.sqrt(d) / factor
    return estimate, sure * np.sqrt(np.maximum(0.0, 1 - factor * factor)) / factor / math.sqrt(max(d - 1, 1))


def _by_dim(dims: np.ndarray, f, out: np.ndarray) -> np.ndarray:
    """`out` with f(rows) for the rows of each dimension."""
    for d in np.unique(dims):
        rows = np.flatnonzero(dims == d)
        out[rows] = f(rows, int(d))
    return out


def _linked(pairs: DataFrame, nodes: DataFrame, cosine: float) -> DataFrame:
    """(a, b, cosine) of the pairs (a, b) that are linked.

    Codes that differ in more bits than SURE deviations allow at the threshold are dropped first; then one's code and
    factor and the other's rotated vector give estimate and bound; pairs whose bound reaches the threshold are computed.
    """

    @F.pandas_udf("boolean")
    def worth(dim: pd.Series, turned: pd.Series, code: pd.Series, factor: pd.Series) -> pd.Series:
        def reach(rows: np.ndarray, d: int) -> np.ndarray:
            t = np.frombuffer(b"".join(turned.iloc[rows]), "<f4").reshape(len(rows), d).astype(np.float64)
            c = np.unpackbits(np.stack(code.iloc[rows].to_list()).astype("<i8").view(np.uint8), axis=1, count=d)
            e, w = bound(t, c.astype(bool), factor.iloc[rows].to_numpy())
            return e + w >= cosine

        return pd.Series(_by_dim(dim.to_numpy(), reach, np.zeros(len(dim), dtype=bool)))

    @F.pandas_udf("double")
    def exact(dim: pd.Series, x: pd.Series, y: pd.Series) -> pd.Series:
        of = lambda rows, _: cosines(np.stack(x.iloc[rows].to_list()), np.stack(y.iloc[rows].to_list()))
        return pd.Series(_by_dim(dim.to_numpy(), of, np.zeros(len(dim))))

    p = math.acos(cosine) / math.pi
    most = f"dim * {p!r}D + {SURE!r}D * sqrt(dim * {p * (1 - p)!r}D)"
    one, two = (nodes.select(F.col("id").alias(k), F.col("code").alias(f"c{k}"), "dim") for k in "ab")
    differ = "aggregate(zip_with(ca, cb, (x, y) -> bit_count(x ^ y)), 0, (s, x) -> s + x)"
    pairs, _ = settled(pairs.join(one, "a").join(two.withColumnRenamed("dim", "other"), "b").where(f"dim = other AND {differ} <= {most}").select("a", "b"))
    one = nodes.select(F.col("id").alias("a"), "turned", "dim")
    two = nodes.select(F.col("id").alias("b"), "code", "factor")
    likely, _ = settled(pairs.join(one, "a").join(two, "b").where(worth("dim", "turned", "code", "factor")).select("a", "b"))
    one = nodes.select(F.col("id").alias("a"), F.col("embedding").alias("x"), "dim")
    two = nodes.select(F.col("id").alias("b"), F.col("embedding").alias("y"))
    return settled(likely.join(one, "a").join(two, "b").select("a", "b", exact("dim", "x", "y").alias("cosine")).where(F.col("cosine") >= cosine))[0]


def near_duplicates(vectors: DataFrame, cosine: float = COSINE, miss: float = MISS) -> DataFrame:
    """Per row of `vectors` (vec_id, embedding): vec_id, n_links, component_id, kept.

    Equal vectors are one class. Classes meet where a band of their sign bits under random rotations agrees; the number
    of bands follows from the wanted recall at the threshold. No bucket is expanded: its members are first compared with
    its smallest. Those within half the threshold's angle of one are its ball, whose members are all linked with one
    another, as angles add up; they are counted, not paired. Of what is left in a bucket, only members of other balls
    than its largest are paired. n_links counts all other rows linked, copies included.
    A vector that is null, empty, zero or holds null or non-finite components links with nothing, and vectors of
    unequal length never link. Vectors of any finite size are scaled exactly. Rows that share a vec_id are one id with
    several vectors: each row counts the links of its own vector, and all are one component. A row with a null vec_id is
    linked with nothing and kept. Other columns are not looked at. An empty table gives no rows.
    """
    spark = vectors.sparkSession
    vectors = vectors.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>"))
    bits, bands = plan(vectors.count(), cosine, miss)
    coded = store(_codes(vectors, bits, bands))
    valid, key = coded.where("vec_id IS NOT NULL AND dim IS NOT NULL"), ["k1", "k2", "dim"]
    classes = settle(valid.groupBy(*key).agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies"))).withColumn("id", F.monotonically_increasing_id())
    classes = settle(classes)
    nodes = store(valid.join(classes, [*key]).where("vec_id = rep").drop("vec_id", "k1", "k2", "rep", "copies").dropDuplicates(["id"]))
    spread = nodes.select("id", F.explode("bands").alias("key"))
    full = settle(spread.groupBy("key").agg(F.count("*").alias("n"), F.min("id").alias("hub")).where("n > 1").drop("n"))
    met, _ = settled(spread.join(full, "key").where("id <> hub"), 200_000)
    release(spark)
    first = _linked(met.select(F.col("hub").alias("a"), F.col("id").alias("b")).distinct(), nodes, cosine)
    half = math.cos(math.acos(cosine) / 2) + 1e-9
    balls = settled(first.where(F.col("cosine") >= half).groupBy(F.col("b").alias("id")).agg(F.min("a").alias("ball")))[0]
    release(spark)
    named = met.join(balls, "id", "left").select("key", "id", F.coalesce("ball", "id").alias("ball"))
    sizes = named.groupBy("key", "ball").agg(F.count("*").alias("c"))
    main = sizes.groupBy("key").agg(F.max_by("ball", F.struct("c", "ball")).alias("main"), F.count("*").alias("parts")).where("parts > 1").drop("parts")
    apart, _ = settled(named.join(settle(main), "key"), 200_000)
    other = F.expr("x.key = y.key AND x.ball <> y.ball AND (y.ball = y.main OR x.id < y.id)")
    pairs = apart.where("ball <> main").alias("x").join(apart.alias("y"), other).select(F.least("x.id", "y.id").alias("a"), F.greatest("x.id", "y.id").alias("b"))
    links = first.unionByName(_linked(pairs.distinct(), nodes, cosine)).select("a", "b").distinct()
    release(spark)
    # What is in one ball is counted by the ball.
    of = lambda k: balls.select(F.col("id").alias(k), F.col("ball").alias(f"ball_{k}"))
    links = settle(links.join(of("a"), "a", "left").join(of("b"), "b", "left").where("ball_a IS NULL OR ball_b IS NULL OR ball_a <> ball_b").select("a", "b"))
    copies = classes.select("id", "copies")
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    beside = both.join(copies.withColumnRenamed("id", "b"), "b").groupBy(F.col("a").alias("id")).agg(F.sum("copies").alias("beside"))
    within = balls.join(copies, "id").groupBy("ball").agg(F.sum("copies").alias("all"))
    within = settle(balls.join(settle(within), "ball").select("id", "all"))
    discard(nodes)
    # Rows with one vec_id are one id, whatever their vectors.
    rows = valid.select("vec_id", *key).join(classes.select("id", *key), key).select("vec_id", "id")
    twice = rows.groupBy("vec_id").agg(F.min("id").alias("a"), F.max("id").alias("z")).where("a <> z").select("vec_id", "a")
    same = rows.join(settle(twice), "vec_id").select("a", F.col("id").alias("b"))
    tree = components(links.unionByName(balls.select(F.col("ball").alias("a"), F.col("id").alias("b"))).unionByName(same))
    roots = classes.join(tree, "id", "left").select("id", *key, "rep", "copies", F.coalesce("root", "id").alias("root"))
    lows = settle(roots.groupBy("root").agg(F.min("rep").alias("low")))
    roots = roots.join(lows, "root").join(settle(beside), "id", "left").join(within, "id", "left")
    n = F.coalesce("all", "copies") - 1 + F.coalesce("beside", F.lit(0))
    found = settle(roots.select(*key, n.alias("n"), "low"))
    own = F.col("vec_id").isNotNull()
    return coded.select("vec_id", *key).join(found, key, "left").select(
        "vec_id",
        F.when(own, F.coalesce("n", F.lit(0))).otherwise(F.lit(0)).cast("long").alias("n_links"),
        F.when(own, F.coalesce("low", "vec_id")).alias("component_id"),
        F.coalesce(F.col("vec_id") == F.coalesce("low", "vec_id"), F.lit(True)).alias("kept"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir, "embeddings"))
