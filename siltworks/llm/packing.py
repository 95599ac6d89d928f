"""Packing of tokenised documents into fixed-length sequences by bulk-synchronous best fit (operator 5)."""

from __future__ import annotations

import bisect
import itertools
import re
import sys
import types
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .base import documents, ranked, release, settle

CAPACITY = 4096
END = 1
#: Bytes of text that a worker takes at once, and pre-tokens in one call of the tokeniser.
AT_ONCE, CALL = 8_000_000, 2_000
#: Bytes of strings, with their ids, that a worker remembers at a time; an entry takes ENTRY bytes besides them.
REMEMBERED, ENTRY = 160_000_000, 60
#: Documents and gaps that one task matches in a round.
SHARE = 20_000


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def portions(texts: pa.Array) -> Iterator[pa.Array]:
    """The texts in slices of some AT_ONCE bytes, one text at least."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < len(texts):
        to = int(np.searchsorted(ends, (ends[at - 1] if at else 0) + AT_ONCE, side="right"))
        yield texts.slice(at, max(to, at + 1) - at)
        at = max(to, at + 1)


#: Words whose pre-tokens are sure: ASCII and the precomposed letters of Latin-1, which no normalisation changes.
_SURE = re.compile(r"[!-~\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+")
#: In lower case, as the vocabulary's pre-tokeniser cuts them.
_PARTS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z\u00df-\u00f6\u00f8-\u00ff]+|[0-9]|[^a-z0-9\u00df-\u00f6\u00f8-\u00ff]+")
#: The same by bytes of UTF-8: blanks, letters (C3 and what follows it), digits, other signs; ODD ones are in no sure word.
BLANK, LETTER, DIGIT, SIGN, ODD = range(5)
_KIND = np.full(256, ODD, dtype=np.uint8)
_KIND[0x21:0x7F] = SIGN
_KIND[list(b" \t\n\x0b\f\r")] = BLANK
_KIND[[*range(0x41, 0x5B), *range(0x61, 0x7B), 0xC3, *range(0x80, 0xC0)]] = LETTER
_KIND[0x30:0x3A] = DIGIT
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20


def cut(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The strings whose ids, one after the other, are those of the texts, and before how many each text starts (and the last ends).

    Words of sure characters are cut where the kind of character changes and before and after digits, in lower case, as the
    pre-tokeniser does. Words that hold others, may hold a special token or one of its contractions stay as they are.
    """
    text = pa.large_string()
    lines = pc.binary_join_element_wise(pc.fill_null(texts.cast(text), ""), pa.scalar("", text), pa.scalar("\n", text))
    ends = np.frombuffer(lines.buffers()[1], dtype=np.int64)[lines.offset : lines.offset + len(lines) + 1]
    body = np.frombuffer(lines.buffers()[2], dtype=np.uint8)[ends[0] : ends[-1]]
    kind, low = _KIND[body], _LOWER[body]
    kept, after = kind != BLANK, body[:-1] == 0xC3
    next_ = body[1:]
    low[1:][after & (next_ < 0x9F)] += 0x20
    first = kept.copy()
    first[1:] &= (kind[1:] != kind[:-1]) | (kind[1:] == DIGIT)
    odd = kind == ODD
    odd[1:] |= (after & ((next_ == 0x97) | (next_ == 0xB7))) | ((body[:-1] == 0x3C) & (next_ == 0x7C)) | ((body[:-1] == 0x27) & (kind[1:] == LETTER))
    if odd.any():
        edges = np.flatnonzero(np.diff(kept, prepend=False))
        word = np.unique(np.searchsorted(edges, np.flatnonzero(odd), side="right") - 1)
        step = np.zeros(len(body), dtype=np.int8)
        step[edges[word]], step[edges[word + 1]] = 1, -1
        whole = np.cumsum(step, dtype=np.int8).view(bool)
        np.copyto(low, body, where=whole)
        first &= ~whole
        first[edges[word]] = True
    starts = np.append(np.flatnonzero(first[kept]), np.count_nonzero(kept))
    found = pa.Array.from_buffers(pa.large_binary(), len(starts) - 1, [None, pa.py_buffer(starts), pa.py_buffer(low[kept])])
    return found, np.searchsorted(np.flatnonzero(first), ends - ends[0])


def sure(text: str) -> bool:
    return text.isascii() and text.isalpha() or _SURE.fullmatch(text) is not None and "<|" not in text


class WordIds:
    """The ids of words, or of parts of words that were cut(), as little-endian bytes, remembered in bounded space.

    Sure words are cut into lower-case pre-tokens by one pattern, and these encoded, many in one call, by the vocabulary's
    model alone, as its normaliser and pattern leave them as they are; the tokens that end pre-tokens tell them apart. Words
    outside _SURE, and those that may hold a special token, are encoded whole, one by one.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer, pre_tokenizers

        self.path, self.ids, self.size, self.tok = path, {}, 0, Tokenizer.from_file(path)
        self.bare = Tokenizer(self.tok.model)
        by_bytes = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.bare.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), by_bytes])
        vocab = self.tok.get_vocab(with_added_tokens=True)
        self.ends = np.zeros(max(vocab.values()) + 1, dtype=bool)
        for token, i in vocab.items():
            self.ends[i] = token.endswith("</w>")

    def _whole(self, texts: list[str]) -> list[bytes]:
        return [np.asarray(e.ids, dtype="<u4").tobytes() for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]

    def _parts(self, texts: list[str]) -> list[bytes]:
        out: list[bytes] = []
        for i in range(0, len(texts), CALL):
            some = texts[i : i + CALL]
            ids = np.asarray(self.bare.encode_batch_fast([" ".join(some)], add_special_tokens=False)[0].ids, dtype="<u4")
            last = np.flatnonzero(self.ends[ids])
            if len(last) == len(some):
                body, cuts = ids.tobytes(), ((last + 1) * 4).tolist()
                out += map(body.__getitem__, map(slice, [0, *cuts], cuts))
            else:
                out += self._whole(some)
        return out

    def _remember(self, words: list[bytes], found: list[bytes]) -> None:
        self.ids.update(zip(words, found, strict=True))
        self.size += sum(map(sys.getsizeof, words)) + sum(map(sys.getsizeof, found)) + ENTRY * len(words)

    def learn(self, docs: list[list[bytes]]) -> None:
        """Afterwards `ids` has all words of these documents."""
        new = set(itertools.filterfalse(self.ids.__contains__, itertools.chain.from_iterable(docs)))
        if self.size > REMEMBERED and new:
            self.ids, self.size = {}, 0
            new = set(itertools.chain.from_iterable(docs))
        whole, single, cuts = [], [], {}
        for w, t in zip(new, b" ".join(new).decode().split(" "), strict=bool(new)):
            if not sure(t):
                whole.append(w)
            elif len(parts := _PARTS.findall(t.lower())) == 1:
                single.append(w)
            else:
                cuts[w] = parts
        self._remember(whole, self._whole([w.decode() for w in whole]))
        self._remember(single, self._parts([w.decode().lower() for w in single]))
        parts = list(set(itertools.chain.from_iterable(cuts.values())))
        known = dict(zip(parts, self._parts(parts), strict=True))
        self._remember(list(cuts), [b"".join(map(known.__getitem__, c)) for c in cuts.values()])


def worker_ids(path: str) -> WordIds:
    """The WordIds of this worker process, which outlives a task."""
    home = sys.modules.setdefault("siltworks_worker_ids", types.ModuleType("siltworks_worker_ids"))
    if getattr(home, "path", None) != path:
        home.path, home.found = path, WordIds(path)
    return home.found


def pieces(docs: DataFrame, capacity: int = CAPACITY, tokenizer: str | None = None) -> DataFrame:
    """Tokenises whole texts; one row per piece: doc_id, piece, start, length, ids_crc32.

    The vocabulary's pre-tokeniser never joins characters across white space, so ids are found once per different part of
    a word in some AT_ONCE bytes of texts, and remembered; what a worker remembers is bounded in bytes. A null text is empty
    and yields its end id alone; a text of any length is tokenised whole.
    """
    path = tokenizer or vocabulary()
    names = ["doc_id", "piece", "start", "length", "ids_crc32"]

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = worker_ids(path)
        end = END.to_bytes(4, "little")
        for b in batches:
            at = 0
            for texts in portions(b.column("text")):
                found, before = cut(texts)
                coded = found.dictionary_encode()
                words = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
                known.learn([words])
                ids = pa.array(map(known.ids.__getitem__, words), type=pa.large_binary(), size=len(words)).take(coded.indices)
                cuts = np.frombuffer(ids.buffers()[1], dtype=np.int64)[ids.offset :][before]
                n = (cuts[1:] - cuts[:-1]) // 4 + 1
                each = -(-n // capacity)
                doc = np.repeat(np.arange(len(n)), each)
                piece = np.arange(len(doc)) - np.repeat(np.cumsum(each) - each, each)
                start = piece * capacity
                length = np.minimum(n[doc] - start, capacity)
                first, last = cuts[doc] + 4 * start, np.minimum(cuts[doc] + 4 * (start + length), cuts[doc + 1])
                body = memoryview(ids.buffers()[2] or b"")
                crc = [zlib.crc32(body[i:j]) for i, j in zip(first.tolist(), last.tolist(), strict=True)]
                for k in (np.cumsum(each) - 1).tolist():
                    crc[k] = zlib.crc32(end, crc[k])
                doc_id = b.column("doc_id").take(pa.array(doc + at))
                yield pa.RecordBatch.from_arrays([doc_id, pa.array(piece.astype(np.int32)), *map(pa.array, (start, length)), pa.array(crc, type=pa.int64())], names=names)
                at += len(texts)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(
        encode, "doc_id long, piece int, start long, length long, ids_crc32 long"
    )


def sweep(counts: list[tuple[int, int]], capacity: int, open_: list[tuple[int, int]] | None = None) -> list[tuple[int, int, int, int]]:
    """Best fit, run by run: (first rank, documents a bin takes, first bin, their offset in it).

    `counts` has (length, documents of that length), longest first; ranks count through them. `open_` has (gap, bins with
    it), smallest first; bins count through them, and new bins come after. Bins with equal gaps are interchangeable, so
    documents and gaps are held as runs: at most `capacity` lengths and gaps. The longest waiting run goes to its
    successor among the gaps (the least that fits), its r-th document to the r-th bin of the gap's run; when no gap fits,
    a run of new bins opens. That places every document where best-fit-decreasing does.
    """
    gaps: dict[int, list[tuple[int, int]]] = {}
    order: list[int] = []
    plan: list[tuple[int, int, int, int]] = []
    rank = opened = 0

    def put(gap: int, first: int, n: int) -> None:
        if n and gap:
            if gap not in gaps:
                gaps[gap] = []
                bisect.insort(order, gap)
            runs = gaps[gap]
            if runs and runs[-1][0] + runs[-1][1] == first:
                runs[-1] = (runs[-1][0], runs[-1][1] + n)
            else:
                runs.append((first, n))

    for gap, n in open_ or ():
        put(gap, opened, n)
        opened += n
    for length, n in counts:
        while n:
            k = bisect.bisect_left(order, length)
            if k < len(order):
                gap = order[k]
                first, bins = gaps[gap].pop()
                if not gaps[gap]:
                    del gaps[gap], order[k]
            else:
                gap, first, bins = capacity, opened, -(-n // (capacity // length))
                opened += bins
            each = gap // length
            full, rest = divmod(min(n, bins * each), each)
            plan.append((rank, each, first, capacity - gap))
            put(gap - each * length, first, full)
            put(gap - rest * length, first + full, 1 if rest else 0)
            put(gap, first + full + bool(rest), bins - full - bool(rest))
            rank += full * each + rest
            n -= full * each + rest
    return plan


def match(lengths: np.ndarray, free: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) of documents whose lengths fall, by best fit into bins whose free space rises, then into new ones."""
    runs = [tuple(map(int, x)) for x in zip(*np.unique(lengths, return_counts=True), strict=True)][::-1]
    gaps = [tuple(map(int, x)) for x in zip(*np.unique(free, return_counts=True), strict=True)]
    p = np.array(sweep(runs, capacity, gaps), dtype=np.int64).reshape(-1, 4)
    rank = np.arange(len(lengths))
    r = p[np.searchsorted(p[:, 0], rank, side="right") - 1]
    j = rank - r[:, 0]
    return r[:, 2] + j // r[:, 1], r[:, 3] + (j % r[:, 1]) * lengths


def _round(rows: DataFrame, which: int, tasks: int, capacity: int, fit: Callable) -> DataFrame:
    """One round: rows (size, a document's length or -1; gap, a sequence's free space or null) ranked by `pos` are dealt to `tasks`."""
    schema = T.StructType([T.StructField(f.name, f.dataType) for f in rows.drop("pos").schema])

    def place(table: pa.Table) -> pa.Table:
        table = table.sort_by("pos").drop_columns(["pos"])
        docs = table.filter(pc.field("gap").is_null())
        gaps = table.filter(pc.field("gap").is_valid()).sort_by([("gap", "ascending"), ("sequence_id", "ascending")])
        lengths, free = docs["length"].to_numpy(), gaps["gap"].to_numpy()
        at, offset = fit(lengths, free, capacity)
        n = max(len(free), int(at.max(initial=-1)) + 1)
        left = np.concatenate([free, np.full(n - len(free), capacity, dtype=np.int64)]) - np.bincount(at, weights=lengths, minlength=n).astype(np.int64)
        task = table["task"][0].as_py()
        ids = np.concatenate([gaps["sequence_id"].to_numpy(), ((which << 22) + task << 32) + np.arange(n - len(free))]).astype(np.int64)
        # Best fit leaves at most one new sequence half empty; its documents wait for other tasks' gaps.
        kept = (left < (capacity + 1) // 2) | (np.arange(n) < len(free)) if tasks > 1 else np.ones(n, dtype=bool)
        done = kept[at]
        put = lambda t, name, values: t.set_column(t.schema.get_field_index(name), name, values)
        docs = put(docs, "sequence_id", pa.array(ids[at], mask=~done, type=pa.int64()))
        docs = put(docs, "offset", pa.array(offset, mask=~done, type=pa.int64()))
        empty = {f.name: pa.nulls(int(kept.sum()), f.type) for f in docs.schema} | {"sequence_id": pa.array(ids[kept]), "gap": pa.array(left[kept])}
        out = pa.concat_tables([docs, pa.table([empty[f.name] for f in docs.schema], schema=docs.schema)])
        return out.select(schema.names)

    return rows.withColumn("task", (F.col("pos") % tasks).cast("int")).groupBy("task").applyInArrow(place, schema)


def pack(rows: DataFrame, capacity: int = CAPACITY, share: int = SHARE, fit: Callable = match) -> DataFrame:
    """Adds sequence_id and offset to pieces with a `length` from 1 to capacity: bulk-synchronous best fit by `fit`.

    Each round range-sorts the waiting documents by falling length and the open gaps by size, and deals both by rank, so
    that every task (of some `share` rows) has the same mixture of sizes and no gap is in two. A task sweeps its
    documents, longest first, to their successors among its gaps, the least that fit; those that meet at one gap go in by
    rank, gaps are updated, and what fits none opens sequences. The documents of a new sequence that stays half empty wait:
    with all gaps left they make the next round, then, without, a round of fewer tasks, until one task has them all.
    With few rows there is one task, and sequences are those of best-fit-decreasing. Equal rows, null ids and clashing
    column names do no harm; an empty table gives no rows.
    """
    doc = F.struct("*").alias("doc")
    waiting = settle(rows.select(doc, F.col("length").cast("long").alias("length")))
    none = F.lit(None).cast("long")
    waiting = waiting.select("doc", "length", none.alias("sequence_id"), none.alias("offset"), none.alias("gap"))
    placed, gaps, n, which, n_gaps = [], None, waiting.count(), 0, 0
    while n:
        both = waiting if which % 2 == 0 else waiting.unionByName(gaps)
        tasks = -(-(n + (n_gaps if which % 2 else 0)) // share)
        order = [F.col("gap").isNotNull(), F.col("length").desc(), "gap", "sequence_id", "doc"]
        out = settle(_round(ranked(both, *order), which, tasks, capacity, fit))
        docs, mine = out.where("gap IS NULL"), out.where("gap > 0")
        placed.append(docs.where("sequence_id IS NOT NULL"))
        gaps = mine if gaps is None or which % 2 else gaps.unionByName(mine)
        waiting = docs.where("sequence_id IS NULL")
        found = out.agg(F.count_if(F.expr("gap IS NULL AND sequence_id IS NULL")).alias("n"), F.count_if(F.expr("gap > 0")).alias("g")).first()
        n, n_gaps, which = found["n"], found["g"] + (0 if which % 2 else n_gaps), which + 1
        release(rows.sparkSession)
    whole = placed[0] if placed else waiting
    for x in placed[1:]:
        whole = whole.unionByName(x)
    return whole.select("doc.*", "sequence_id", "offset")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(pieces(documents(spark, sf_dir)))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The packed pieces of all documents; a document that comes several times is packed several times."""
    return pack(pieces(docs))
