"""Exact removal of passages repeated across documents: seed on winnowed anchors, extend, cut (operator 3)."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .base import discard, documents, release, settle, store, words
from .shingles import BASE2, WordHashes, runs

LENGTH = 50
#: Grams per window of winnowing, a power of two; an anchor is a run of LENGTH - SPAN + 1 words.
SPAN = 32
_AT = np.uint64((1 << 24) - 1)


def anchors(grams: np.ndarray, span: int = SPAN) -> np.ndarray:
    """Of each window of `span` grams, the place of the least one (ties: the first); equal windows choose alike."""
    if len(grams) < span:
        return np.empty(0, dtype=np.int64)
    if len(grams) > int(_AT):  # beyond 16 million words, in overlapping parts
        part = int(_AT) - span
        return np.concatenate([anchors(grams[i : i + part + span - 1], span) + i for i in range(0, len(grams) - span + 1, part)])
    low = (grams & ~_AT) | np.arange(len(grams), dtype=np.uint64)
    step = 1
    while step < span:
        low = np.minimum(low[:-step], low[step:])
        step *= 2
    return (low & _AT).astype(np.int64)


def _split(text: object) -> list[bytes]:
    return text.encode().split() if isinstance(text, str) else []


def _digest(parts: list[bytes]) -> bytes:
    return hashlib.sha256(b" ".join(parts)).digest()


def sides(h: np.ndarray, at: np.ndarray, k: int, reach: int) -> tuple[np.ndarray, np.ndarray]:
    """A hash of the `reach` words left and right of each seed, or of those that the document has."""
    whole = runs(h, reach)

    def of(starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        full = (starts >= 0) & (ends <= len(h))
        out = np.empty(len(at), dtype=np.uint64)
        out[full] = whole[starts[full]]
        for i in np.flatnonzero(~full):
            part = h[max(0, starts[i]) : ends[i]]
            out[i] = xxhash.xxh3_64_intdigest(part.tobytes())
        return out

    return of(at - reach, at), of(at + k, at + k + reach)


def _seeds(docs: DataFrame, length: int) -> DataFrame:
    """Per document: its words' number and digest, and its seeds: anchor, place and the hashes of both sides."""
    k = length - SPAN + 1

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = WordHashes()
        for b in batches:
            out = []
            for doc_id, text in zip(b["doc_id"].to_numpy(dtype=object), b["text"], strict=True):
                parts = _split(text)
                at = values = left = right = np.empty(0, dtype=np.uint64)
                if len(parts) >= length:
                    h = known.of(parts)
                    grams = runs(h, k)
                    at = np.unique(anchors(grams))
                    values, (left, right) = grams[at], sides(h, at, k, SPAN - 1)
                out.append((doc_id, len(parts), _digest(parts), values.view(np.int64), at.astype(np.int32), left.view(np.int64), right.view(np.int64)))
            got = pd.DataFrame(out, columns=["doc_id", "n_words", "sha", "anchor", "at", "left", "right"], dtype=object)
            yield got.assign(doc_id=got["doc_id"].astype("Int64"))

    return docs.mapInPandas(run, "doc_id long, n_words long, sha binary, anchor array<long>, at array<int>, left array<long>, right array<long>")


def _windows(touched: DataFrame, length: int) -> DataFrame:
    """The windows around open seeds: each window belongs to the one anchor that winnowing chooses in it."""
    k = length - SPAN + 1

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = WordHashes()
        for b in batches:
            for doc_id, key, text, seeds in zip(b["doc_id"], b["key"], b["text"], b["open"], strict=True):
                h = known.of(_split(text))
                owner = anchors(runs(h, k))
                at = np.flatnonzero(np.isin(owner, np.asarray(seeds, dtype=np.int64)))
                one, two = runs(h, length)[at], runs(h, length, BASE2)[at]
                yield pd.DataFrame({"doc_id": doc_id, "key": key, "at": at.astype(np.int32), "h": one.view(np.int64), "h2": (two >> np.uint64(33)).astype(np.int32)})

    return touched.mapInPandas(run, "doc_id long, key long, at int, h long, h2 int")


def _cut(found: DataFrame, length: int) -> DataFrame:
    """Texts without the words of their matched reaches and windows."""
    k = length - SPAN + 1

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for doc_id, key, text, seeds, starts in zip(b["doc_id"], b["key"], b["text"], b["matched"], b["starts"], strict=True):
                parts = _split(text)
                at = np.asarray([] if seeds is None else seeds, dtype=np.int64)
                s = np.unique(np.asarray([] if starts is None else starts, dtype=np.int64))
                edge = np.zeros(len(parts) + 1, dtype=np.int64)
                np.add.at(edge, np.concatenate([np.maximum(at - SPAN + 1, 0), s]), 1)
                np.add.at(edge, np.concatenate([np.minimum(at + k + SPAN - 1, len(parts)), s + length]), -1)
                gone = np.cumsum(edge)[:-1] > 0
                bounds = np.flatnonzero(np.diff(np.concatenate([[0], gone.view(np.int8), [0]])))
                spans = [{"from": int(x), "to": int(y)} for x, y in bounds.reshape(-1, 2)]
                kept = [w for w, g in zip(parts, gone.tolist(), strict=True) if not g]
                out.append((doc_id, key, int(gone.sum()), _digest(kept), spans))
            yield pd.DataFrame(out, columns=["doc_id", "key", "n_removed", "kept_sha", "spans"])

    return found.mapInPandas(run, "doc_id long, key long, n_removed long, kept_sha binary, spans array<struct<`from`:int,`to`:int>>")


def remove_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """Per row: doc_id, n_words, n_removed, kept_sha256 and the removed `spans` (word places, end exclusive).

    A word goes if a window of `length` words over it also starts in a document with a smaller doc_id; windows are judged
    on the input. Documents with equal word sequences are settled first: all but the smallest doc_id go whole, and only
    that one is searched. Every window holds a seed, an anchor that winnowing chooses by content alone, and reaches at most
    SPAN - 1 words beyond it. Documents are joined on their seeds with the smallest document that has the seed, never in
    pairs, and the match is extended from there both ways. Where both sides agree as far as windows reach, all of it goes.
    Where not, windows may still start in a third document: around such open seeds they are compared one by one, with the
    smallest doc_id of each window by a minimum. Spans that touch make one maximal repeat. Windows' hashes have 95 bits,
    seeds with their sides 192. A null or blank text has no words; one of any length is taken whole. A row with a null
    doc_id is neither searched nor cut. Rows of one doc_id do not shorten one another. Other columns are not looked at.
    An empty table gives no rows.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    key = F.xxhash64("sha").alias("key")
    seeds = store(_seeds(docs, length))
    long_ = seeds.where(f"doc_id IS NOT NULL AND n_words >= {length}")
    first = settle(long_.groupBy("sha").agg(F.min("doc_id").alias("first")))
    searched = long_.join(first.withColumnRenamed("first", "doc_id"), ["sha", "doc_id"], "left_semi")
    pins = searched.select("doc_id", key, F.explode(F.arrays_zip("anchor", "at", "left", "right")).alias("x")).select("doc_id", "key", "x.*")
    one = [(F.min(c) == F.max(c)) for c in ("left", "right")]
    met = pins.groupBy("anchor").agg(F.min(F.struct("doc_id", "at", "left", "right")).alias("rep"), F.max("doc_id").alias("hi"), (one[0] & one[1]).alias("alike"))
    met = settle(met.where("rep.doc_id < hi").select("anchor", F.col("rep.doc_id").alias("lo"), F.col("rep.left").alias("l"), F.col("rep.right").alias("r"), "alike"))
    release(spark)
    agree = F.expr("doc_id > lo AND left = l AND right = r")
    state = pins.join(met, "anchor").select("doc_id", "key", "at", agree.alias("matched"), (~agree & ~F.col("alike")).alias("open"))
    of = lambda c: F.collect_set(F.when(F.col(c), F.col("at"))).alias(c)
    hits = settle(state.where("matched OR open").groupBy("doc_id", "key").agg(of("matched"), of("open")))
    release(spark)
    same = F.xxhash64(F.unhex(F.sha2(F.array_join(words(F.col("text")), " "), 256))) == F.col("key")
    touched = store(docs.where("doc_id IS NOT NULL").join(hits, "doc_id").where(same))
    release(spark)
    windows = store(_windows(touched.where("size(open) > 0").drop("matched"), length))
    least = settle(windows.groupBy("h", "h2").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).where("lo < hi").drop("hi"))
    starts = windows.join(least, ["h", "h2"]).where("doc_id > lo").groupBy("doc_id", "key").agg(F.collect_set("at").alias("starts"))
    starts = settle(starts)
    release(spark)
    once = touched.drop("open").dropDuplicates(["doc_id", "key"]).join(starts, ["doc_id", "key"], "left")
    cut = _cut(once.where("size(matched) > 0 OR starts IS NOT NULL"), length)
    cut = settle(cut)
    discard(touched, windows)
    rows = seeds.select("doc_id", "n_words", "sha", key).join(first, "sha", "left").join(cut, ["doc_id", "key"], "left")
    copy = F.col("doc_id") > F.col("first")
    whole = F.array(F.struct(F.lit(0).alias("from"), F.col("n_words").cast("int").alias("to")))
    return rows.select(
        "doc_id",
        "n_words",
        F.when(copy, F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.lower(F.hex(F.when(copy, F.lit(_digest([]))).otherwise(F.coalesce("kept_sha", "sha")))).alias("kept_sha256"),
        F.when(copy, whole).otherwise(F.col("spans")).alias("spans"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(documents(spark, sf_dir)).drop("spans")
