"""Packing documents into fixed windows by lexical retrieval: BM25 neighbours fill each seed's window.

The inverted index is sharded by document: a shard is a run of a partition's documents of about SHARD_IDS ids,
indexed and packed where it is read, so nothing is shuffled and memory stays bounded. Documents longer than a
window fill windows of their own; what is left of them, and all shorter ones, are the shard's items. A seed (the
first unused item) opens a window; the unused items that score best for its most telling terms follow until
the window is full. The last one is cut to fit, and its rest is the next seed. What remains at the end of a
shard is laid out in windows whose lengths are powers of two, so no window needs padding.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import tokens
from tidemark.llm.batches import mapped

WINDOW = 2048
SHARD_IDS = 1 << 20
QUERY_TERMS = 24
K1, B = 1.2, 0.75


class Index:
    """BM25 over items, each an array of ids; a term is an id."""

    def __init__(self, items: list[np.ndarray]) -> None:
        n = len(items)
        size = np.array([len(x) for x in items], np.int64)
        owner = np.repeat(np.arange(n), size)
        flat = np.concatenate(items).astype(np.int64) if n else np.zeros(0, np.int64)
        joint, tf = np.unique(flat * max(n, 1) + owner, return_counts=True)  # by term, then item
        self.term, self.item = joint // max(n, 1), joint % max(n, 1)
        norm = K1 * (1 - B + B * size / max(size.mean() if n else 1.0, 1.0))
        df = np.bincount(self.term)
        idf = np.log(1 + (n - df + 0.5) / (df + 0.5))
        self.gain = idf[self.term] * tf * (K1 + 1) / (tf + norm[self.item]) if n else np.zeros(0)
        self.bounds = np.concatenate([[0], np.cumsum(df)])
        self.df = df
        # each item's terms, the ones with most gain first
        order = np.lexsort((-self.gain, self.item))
        self.own_terms, self.own_bounds = self.term[order], np.searchsorted(self.item[order], np.arange(n + 1))
        self.n = n

    def neighbours(self, item: int, unused: np.ndarray) -> np.ndarray:
        """Unused items by falling score for the item's most telling terms, ties by number; the rest of no score are left out."""
        terms = self.own_terms[self.own_bounds[item] : min(self.own_bounds[item] + QUERY_TERMS, self.own_bounds[item + 1])]
        spans = [slice(self.bounds[t], self.bounds[t + 1]) for t in terms if self.df[t] > 1]
        if not spans:
            return np.zeros(0, np.int64)
        score = np.bincount(np.concatenate([self.item[s] for s in spans]), np.concatenate([self.gain[s] for s in spans]), self.n)
        near = np.flatnonzero((score > 0) & unused)
        return near[np.argsort(-score[near], kind="stable")]


def layout(documents: list[np.ndarray], window: int) -> Iterator[tuple[int, int, int, int, int]]:
    """(document, start, length, sequence, offset) of every piece of a shard."""
    sequence = 0
    items, at = [], []
    for d, ids in enumerate(documents):
        whole = len(ids) // window * window
        for start in range(0, whole, window):
            yield d, start, window, sequence, 0
            sequence += 1
        if len(ids) > whole:
            items.append(ids[whole:])
            at.append((d, whole))
    index = Index(items)
    unused = np.ones(len(items), bool)
    left = sum(map(len, items))
    rest: tuple[int, int] | None = None  # an item and how much of it is laid out
    first = 0
    while left:
        room = window if left >= window else 1 << (left.bit_length() - 1)
        left -= room
        offset, queue = 0, None
        while room:
            if rest is None:
                if queue is None and offset == 0:
                    while not unused[first]:
                        first += 1
                    item = first
                else:
                    if queue is None:
                        queue = iter(index.neighbours(seed, unused).tolist())
                    item = next(queue, None)
                    if item is None:  # no neighbour is left: the next unused item
                        while not unused[first]:
                            first += 1
                        item = first
                    elif not unused[item]:
                        continue
                unused[item] = False
                rest = item, 0
            item, done = rest
            if offset == 0:
                seed = item
            n = min(room, len(items[item]) - done)
            d, start = at[item]
            yield d, start + done, n, sequence, offset
            offset, room = offset + n, room - n
            rest = (item, done + n) if done + n < len(items[item]) else None
        sequence += 1


def pack(docs: DataFrame, *, key: str = "doc_id", text: str = "text", vocabulary: str = tokens.WORD_BPE, end_id: int = 1, window: int = WINDOW, with_ids: bool = False) -> DataFrame:
    """A row per piece: key, start, length, ids_crc32, doc_tokens, sequence_id, offset (and ids, if asked for).

    Every id of every row, its end id included, lies in exactly one piece; a null or empty text is its end id
    alone. Sequences hold ``window`` ids or a smaller power of two, without gaps. Repeated and null keys are
    documents of their own. sequence_id numbers a partition's sequences from its number times 2**33.
    """
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = tokens.encoder(vocabulary)
        held, keys, size = [], [], 0
        base = TaskContext.get().partitionId() << 33
        key_type = None

        def packed() -> pa.RecordBatch:
            nonlocal base, held, keys, size
            rows = list(layout(held, window))
            d, start, length, sequence, offset = (np.array(x, np.int64) for x in zip(*rows, strict=True))
            parts = [held[x][s : s + n] for x, s, n, _, _ in rows]
            columns = [
                pa.array(keys, key_type).take(pa.array(d)), pa.array(start), pa.array(length), pa.array([zlib.crc32(p.tobytes()) for p in parts], pa.int64()),
                pa.array(np.array([len(x) for x in held], np.int64)[d]), pa.array(sequence + base), pa.array(offset),
            ]
            if with_ids:
                columns.append(pa.array([p.astype(np.int64) for p in parts], pa.list_(pa.int64())))
            base += int(sequence.max()) + 1
            held, keys, size = [], [], 0
            return pa.RecordBatch.from_arrays(columns, names=["key", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"][: len(columns)])

        for batch in batches:
            key_type = batch["key"].type
            for k, ids in zip(batch["key"].to_pylist(), coder.ids(batch["text"].to_pylist()), strict=True):
                held.append(np.append(ids, np.uint32(end_id)).astype("<u4"))
                keys.append(k)
                size += len(held[-1])
                if size >= SHARD_IDS:
                    yield packed()
        if held:
            yield packed()

    schema = f"key {kind}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint" + ", ids array<bigint>" * with_ids
    out = mapped(docs.select(F.col(key).alias("key"), F.col(text).alias("text")), run, schema)
    return out.withColumnRenamed("key", key)
