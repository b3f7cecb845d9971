"""Benchmark decontamination by Wu-Manber search over words.

The patterns are all windows of ten consecutive item words (an item of fewer words is one window). Per
window length m a shift table, indexed by the hash of a block of consecutive words, says how far the search
may move: the least distance from that block to the end of any window, or m - block + 1 where the block is in
none. At shift 0 the hash of the block picks a bucket of windows that end in it, and a direct comparison of
all words confirms. Hash collisions can only make a shift too small, never too large, so nothing is missed.

No shuffle: every document is searched where it is read. Windows are held in blocks of bounded size; if the
benchmark needs several, the documents are searched for one block after the other, in one narrow stage.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import words as W
from tidemark.llm.batches import mapped

TABLE_BITS = 16
SCRATCH_BYTES = 4 << 20


class Tables:
    """Shift tables and buckets for windows of one length."""

    def __init__(self, length: int, windows: dict[bytes, list[str]]) -> None:
        self.length, self.block = length, min(3, length)
        self.shift = np.full(1 << TABLE_BITS, length - self.block + 1, np.uint8 if length < 256 else np.uint32)
        self.bucket: dict[int, dict[bytes, list[str]]] = defaultdict(dict)
        for text, items in windows.items():
            raw = np.frombuffer(text, np.uint8)
            found = W.split(raw, np.array([0, len(raw)]))
            h = found.run_hash(np.arange(length - self.block + 1), self.block)
            for k, slot in enumerate((h >> np.uint64(64 - TABLE_BITS)).tolist()):
                self.shift[slot] = min(self.shift[slot], length - self.block - k)
            self.bucket[int(h[-1])][text] = items

    def search(self, found: W.Words, data: bytes, hit: np.ndarray, items: list[set[str]]) -> None:
        m, b = self.length, self.block
        if len(found.start) < m:
            return
        h = found.run_hash(np.arange(len(found.start) - b + 1), b)  # of the block that begins at a word
        jump = self.shift[(h >> np.uint64(64 - TABLE_BITS)).astype(np.int64)].tolist()
        start, end, bucket = found.start, found.end, self.bucket
        bounds = found.first.tolist()
        for doc in range(len(bounds) - 1):
            at, last = bounds[doc] + m - b, bounds[doc + 1] - b  # at: where the window's last block begins
            while at <= last:
                step = jump[at]
                if step:
                    at += step
                    continue
                near = bucket.get(int(h[at]))
                if near:
                    lo = at - m + b
                    own = b" ".join(data[s:e] for s, e in zip(start[lo : lo + m].tolist(), end[lo : lo + m].tolist(), strict=True))
                    if own in near:
                        hit[lo : lo + m] = True
                        items[doc].update(near[own])
                at += 1


def _item_windows(window: int):
    schema = pa.schema([("n", pa.int32()), ("window", pa.binary()), ("item", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offsets = W.text_bytes(batch["text"])
            names = batch["item"].to_pylist()
            for lo, hi in W.pieces(offsets, SCRATCH_BYTES):
                found = W.split(raw[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
                data = found.lower.tobytes()
                ns, texts, items = [], [], []
                for row in range(hi - lo):
                    own = [data[s:e] for s, e in zip(found.start[found.first[row] : found.first[row + 1]], found.end[found.first[row] : found.first[row + 1]], strict=True)]
                    n = min(window, len(own))
                    for k in range(len(own) - n + 1 if own else 0):
                        ns.append(n)
                        texts.append(b" ".join(own[k : k + n]))
                        items.append(names[lo + row])
                yield pa.RecordBatch.from_arrays([pa.array(ns, pa.int32()), pa.array(texts, pa.binary()), pa.array(items, pa.string())], schema=schema)

    return run


def contamination(docs: DataFrame, items: DataFrame, window: int = 10, *, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text", block_bytes: int = 16 << 20, keep: list[str] | None = None) -> DataFrame:
    """One row per document row: key, n_words, n_hit, spans, items, n_items, items_sha256, contaminated.

    spans are [first word, end word) runs that lie in occurrences; items are the ids, as strings in string
    order, of items with an occurring window; the columns ``keep`` pass through. A null or empty text has no words. Rows are kept one for one,
    repeated keys and null keys included. An item without an id marks words but is not listed. Other columns
    of either table are ignored, whatever their names. With an empty benchmark nothing is hit.
    """
    spark = docs.sparkSession
    rows = items.select(F.col(item_key).cast("string").alias("item"), F.col(item_text).alias("text"))
    rows = mapped(rows, _item_windows(window), "n int, window binary, item string").distinct()
    size = rows.agg(F.sum(F.length("window") + F.coalesce(F.length("item"), F.lit(0)) + 64)).first()[0] or 0
    blocks = max(1, -(-size // block_bytes))
    kept = keep or []
    carried = F.struct(*[F.col(c).alias(f"c{i}") for i, c in enumerate(kept)], F.lit(0).alias("pad")).alias("row")
    out = docs.select(F.col(key).alias("key"), carried, F.col(text).alias("text"), F.lit(None).cast("array<bigint>").alias("spans"), F.lit(None).cast("array<string>").alias("items"), F.lit(0).cast("bigint").alias("n_words"))
    for k in range(blocks):
        held: dict[int, dict[bytes, list[str]]] = defaultdict(lambda: defaultdict(list))
        for n, w, item in rows.where(F.pmod(F.xxhash64("window", "item"), F.lit(blocks)) == k).toLocalIterator():
            held[n][bytes(w)] += [item] if item is not None else []
        shared = spark.sparkContext.broadcast([Tables(n, dict(w)) for n, w in held.items()])
        out = mapped(out, _search(shared), out.schema)
    sorted_items = F.array_sort("items")
    return out.select(
        F.col("key").alias(key), *[F.col(f"row.c{i}").alias(c) for i, c in enumerate(kept) if c != key], "n_words",
        F.expr("aggregate(spans, 0L, (covered, x) -> x - covered)").alias("n_hit"),  # ends less starts
        "spans", sorted_items.alias("items"), F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.concat_ws(",", sorted_items), 256).alias("items_sha256"), (F.size("spans") > 0).alias("contaminated"),
    )


def _search(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = shared.value
        for batch in batches:
            raw, offsets = W.text_bytes(batch["text"])
            before, known = batch["spans"].to_pylist(), batch["items"].to_pylist()
            spans: list[list[int]] = []
            items: list[set[str]] = [set(x or ()) for x in known]
            counts = np.zeros(batch.num_rows, np.int64)
            for lo, hi in W.pieces(offsets, SCRATCH_BYTES):
                found = W.split(raw[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
                data, hit = found.lower.tobytes(), np.zeros(len(found.start) + 1, bool)
                for row in range(lo, hi):
                    for s, e in zip((before[row] or [])[::2], (before[row] or [])[1::2], strict=True):
                        hit[found.first[row - lo] + s : found.first[row - lo] + e] = True
                own = items[lo:hi]
                for t in tables:
                    t.search(found, data, hit, own)
                for row in range(hi - lo):
                    a, b = found.first[row], found.first[row + 1]
                    edge = np.flatnonzero(np.diff(np.concatenate(([False], hit[a:b], [False]))))
                    spans.append(edge.tolist())
                    counts[lo + row] = b - a
            yield pa.RecordBatch.from_arrays(
                [batch["key"], batch["row"], batch["text"], pa.array(spans, pa.list_(pa.int64())), pa.array([sorted(x) for x in items], pa.list_(pa.string())), pa.array(counts)],
                names=["key", "row", "text", "spans", "items", "n_words"],
            )

    return run
