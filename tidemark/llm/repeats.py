"""Removal of repeated byte strings by suffix sorting with a difference cover.

Every byte covered by a string of DEPTH bytes that starts in two places goes. Three steps find those strings.

1. Anchors. Each window of DEPTH bytes has an anchor, the smallest hash among its short substrings. Equal
   windows have equal anchors, so a window can only repeat among windows whose anchor hash occurs again. A
   span is the union of the neighbouring windows of one anchor. Where a whole span occurs again, all its
   windows repeat; where its anchor hash is unique, none does. Only spans that share an anchor hash with
   different spans are undecided, and only these are sorted.
2. Suffix sort of the undecided spans, spread over the cluster by anchor hash. Positions that are 1 or 2
   modulo 3 are sampled: triples of their eight-byte words are sorted and named, and the same is done with
   triples of the names until a name stands for DEPTH - 3 bytes. The remaining suffixes merge with the sample
   by the difference cover: any two positions have a shift of 0, 1 or 2 bytes that makes both sampled, so
   three sorted lists of (bytes before, name, bytes after) bring all equal windows together, and comparing
   neighbours in them finds every repeat.
3. Anchor hashes with very many different spans are not gathered; their windows are counted by hash.

Texts are identified by a 128-bit hash, and equal texts are handled once.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import store
from tidemark.llm import words as W
from tidemark.llm.batches import mapped

DEPTH = 200
GRAM = 24
SEGMENT = 2 << 20  # bytes looked at together
CHUNK = 3 << 19  # bytes sorted together
MOST_SPANS = 3_000  # of one anchor hash, to be sorted in one task
_POSITION = 23  # bits of a position in a segment


def _gram_hashes(raw: np.ndarray) -> np.ndarray:
    """A hash of the GRAM bytes from each position."""
    n = len(raw) - GRAM + 1
    word = np.zeros(len(raw) - 7, np.uint64)
    for k in range(8):
        word |= raw[k : k + len(word)].astype(np.uint64) << np.uint64(56 - 8 * k)
    h = np.zeros(n, np.uint64)
    for k in range(0, GRAM, 8):
        h = (h + word[k : k + n]) * np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(31)
    return h * np.uint64(0x94D049BB133111EB)


def anchors(raw: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, int, int, int, int]]:
    """(row, first window, windows, anchor hash, span hash) of every span; rows end at ``offsets``."""
    width = DEPTH - GRAM + 1
    # a long row is looked at in segments that share DEPTH - 1 bytes, so each window lies in one of them
    for lo, hi in W.pieces(offsets, SEGMENT):
        ends = [(offsets[lo], offsets[hi])] if offsets[hi] - offsets[lo] <= SEGMENT or hi - lo > 1 else [(a, min(a + SEGMENT + DEPTH - 1, offsets[hi])) for a in range(offsets[lo], offsets[hi], SEGMENT)]
        for begin, end in ends:
            part = raw[begin:end]
            if len(part) < DEPTH:
                continue
            h = _gram_hashes(part)
            least = (h & ~np.uint64((1 << _POSITION) - 1)) | np.arange(len(h), dtype=np.uint64)
            span = 1
            while span * 2 <= width:
                least = np.minimum(least[:-span], least[span:])
                span *= 2
            if width > span:
                least = np.minimum(least[: span - width], least[width - span :])
            at = (least & np.uint64((1 << _POSITION) - 1)).astype(np.int64)
            start = np.arange(len(at)) + begin
            row = np.searchsorted(offsets, start, side="right") - 1
            good = start + DEPTH <= offsets[row + 1]
            turn = np.flatnonzero(np.r_[True, (at[1:] != at[:-1]) | (row[1:] != row[:-1]) | (good[1:] != good[:-1])])
            stop = np.r_[turn[1:], len(at)]
            kept = good[turn]
            turn, stop = turn[kept], stop[kept]
            data = part.tobytes()
            for r, a, n, x in zip(row[turn].tolist(), turn.tolist(), (stop - turn).tolist(), h[at[turn]].view(np.int64).tolist(), strict=True):
                yield r, int(a + begin - offsets[r]), n, x, xxhash.xxh3_64_intdigest(data[a : a + n + DEPTH - 1]) - (1 << 63)


def _anchor_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        raw, offsets = W.text_bytes(batch["text"])
        found = np.array(list(anchors(raw, offsets)), np.int64).reshape(-1, 5)
        rows = pa.array(found[:, 0])
        yield pa.RecordBatch.from_arrays([batch["t1"].take(rows), batch["t2"].take(rows), *(pa.array(found[:, k]) for k in (1, 2, 3, 4))], names=["t1", "t2", "at", "n", "h", "span"])


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    deflate = zstandard.ZstdCompressor(level=1)
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch["t1"], batch["t2"], pa.array([deflate.compress(t.encode()) for t in batch["text"].to_pylist()], pa.binary())], names=["t1", "t2", "packed"])


def _span_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    inflate = zstandard.ZstdDecompressor()
    for batch in batches:
        columns: dict[str, list] = {c: [] for c in ("h", "many", "t1", "t2", "at", "n", "repeated", "data")}
        for t1, t2, packed, spans in zip(*(batch[c].to_pylist() for c in ("t1", "t2", "packed", "spans")), strict=True):
            text = inflate.decompress(packed)
            for s in spans:
                for c, x in (("h", s["h"]), ("many", s["many"]), ("t1", t1), ("t2", t2), ("at", s["at"]), ("n", s["n"]), ("repeated", s["repeated"]), ("data", text[s["at"] : s["at"] + s["n"] + DEPTH - 1])):
                    columns[c].append(x)
        kinds = [pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.binary()]
        yield pa.RecordBatch.from_arrays([pa.array(columns[c], k) for c, k in zip(columns, kinds, strict=True)], names=list(columns))


def _named(keys: np.ndarray) -> np.ndarray:
    """Ranks of keys among the distinct ones."""
    return np.unique(keys, return_inverse=True)[1].astype(np.uint64)


def repeated_windows(spans: list[bytes], twice: list[bool]) -> list[np.ndarray]:
    """For each span, which of its windows of DEPTH bytes also start elsewhere in the spans; ``twice``: the span itself occurs again.

    Suffix sort with the difference cover {1, 2} modulo 3, names of bounded depth; see the module's text.
    """
    size = np.array([len(s) for s in spans], np.int64)
    first = np.concatenate([[0], np.cumsum(size)])
    text = np.frombuffer(b"".join(spans) + bytes(16), np.uint8)
    n = int(first[-1])
    room = np.repeat(first[1:], size) - np.arange(n)  # bytes left in the span
    word = np.zeros(n, np.uint64)
    for k in range(8):
        word |= text[k : k + n].astype(np.uint64) << np.uint64(56 - 8 * k)
    sampled = np.arange(n) % 3 != 0
    name = np.zeros(n, np.uint64)
    at = np.flatnonzero(sampled & (room >= 8))
    name[at] = _named(word[at])
    bits = np.uint64(21)
    # depths 8 -> 20 -> 56 -> 164 -> 197; all shifts are multiples of three, so the sample refers to itself
    for depth, shifts in ((20, (6, 12)), (56, (18, 36)), (164, (54, 108)), (DEPTH - 3, (DEPTH - 167,))):
        at = np.flatnonzero(sampled & (room >= depth))
        key = name[at]
        for s in shifts:
            key = (key << bits) | name[at + s]
        name = np.zeros(n, np.uint64)
        name[at] = _named(key)
    window = room >= DEPTH
    weight = np.repeat(np.where(np.array(twice, bool), 2, 1), size)
    out = np.zeros(n, bool)
    p = np.arange(n)
    for shift in range(3):
        at = np.flatnonzero(window & ((p + shift) % 3 != 0))
        key = name[at + shift]
        for k in [*range(shift), *range(DEPTH - 3 + shift, DEPTH)]:
            key = (key << np.uint64(8)) | text[at + k]
        order = np.argsort(key, kind="stable")
        ranked = key[order]
        turn = np.flatnonzero(np.r_[True, ranked[1:] != ranked[:-1]]) if len(at) else np.zeros(0, np.int64)
        total = np.add.reduceat(weight[at][order], turn) if len(at) else np.zeros(0, np.int64)
        again = np.repeat(total > 1, np.diff(np.r_[turn, len(at)]))
        out[at[order[again]]] = True
    return [out[a : max(a, b - DEPTH + 1)] for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)]


def _runs(flags: np.ndarray) -> list[tuple[int, int]]:
    edge = np.flatnonzero(np.diff(np.concatenate(([False], flags, [False]))))
    return list(zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True))


def _sorted_spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Spans come grouped by anchor hash; whole groups are sorted together, CHUNK bytes or a little more at a time."""
    held: list[tuple] = []
    size, last = 0, None

    def solved() -> pa.RecordBatch:
        flags = repeated_windows([r[5] for r in held], [r[4] for r in held])
        rows = [(t1, t2, at + a, b - a) for (_, t1, t2, at, repeated, _), f in zip(held, flags, strict=True) if not repeated for a, b in _runs(f)]
        columns = list(zip(*rows, strict=True)) if rows else [()] * 4
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["t1", "t2", "at", "n"])

    for batch in batches:
        for row in zip(*(batch[c].to_pylist() for c in ("h", "t1", "t2", "at", "repeated", "data")), strict=True):
            if size >= CHUNK and row[0] != last:
                yield solved()
                held, size = [], 0
            held.append(row)
            size += len(row[5])
            last = row[0]
    if held:
        yield solved()


def _window_hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        t1s, t2s, starts, hashes, weights = [], [], [], [], []
        for t1, t2, at, n, repeated, data in zip(*(batch[c].to_pylist() for c in ("t1", "t2", "at", "n", "repeated", "data")), strict=True):
            for k in range(n):
                t1s.append(t1)
                t2s.append(t2)
                starts.append(at + k)
                hashes.append(xxhash.xxh3_128_digest(data[k : k + DEPTH]))
                weights.append(2 if repeated else 1)
        yield pa.RecordBatch.from_arrays([pa.array(t1s, pa.int64()), pa.array(t2s, pa.int64()), pa.array(starts, pa.int64()), pa.array(hashes, pa.binary()), pa.array(weights, pa.int64())], names=["t1", "t2", "at", "w", "weight"])


def _without(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    inflate = zstandard.ZstdDecompressor()
    for batch in batches:
        rows = []
        for packed, windows in zip(batch["packed"].to_pylist(), batch["windows"].to_pylist(), strict=True):
            raw = np.frombuffer(inflate.decompress(packed), np.uint8)
            change = np.zeros(len(raw) + 1, np.int64)
            if windows:
                w = np.array([(x["at"], x["at"] + x["n"] + DEPTH - 1) for x in windows], np.int64)
                np.add.at(change, w[:, 0], 1)
                np.add.at(change, w[:, 1], -1)
            gone = np.cumsum(change)[:-1] > 0
            runs = _runs(gone)
            rows.append((len(raw), int(gone.sum()), len(runs), hashlib.sha256(raw[~gone].tobytes()).hexdigest(), [x for r in runs for x in r]))
        columns = list(zip(*rows, strict=True)) if rows else [()] * 5
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.int64())]
        yield pa.RecordBatch.from_arrays([batch["t1"], batch["t2"], *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names=["t1", "t2", "n_bytes", "n_removed", "n_spans", "kept_sha256", "removed"])


def removed(docs: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_bytes, n_removed, n_spans, kept_sha256 and removed ([start, end) pairs in bytes) of every row.

    A null text is empty; texts shorter than DEPTH bytes lose nothing; a repeated text of DEPTH bytes or more
    loses everything. Rows are kept one for one, repeated and null keys included; other columns are ignored.
    """
    rows = docs.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    rows = rows.withColumns({"t1": F.xxhash64("text"), "t2": F.xxhash64(F.lit(1), "text")})
    long = rows.where(F.octet_length("text") >= DEPTH).select("t1", "t2", "text")
    found = store.kept(mapped(long, _anchor_rows, "t1 bigint, t2 bigint, at bigint, n bigint, h bigint, span bigint"), "anchors", "zstd")
    distinct = found.groupBy("h", "span").agg(F.count("*").alias("times"), F.min(F.struct("t1", "t2", "at", "n")).alias("one"))
    hashes = distinct.groupBy("h").agg(F.sum("times").alias("total"), F.count("*").alias("kinds")).where("total > 1")
    state = store.kept(distinct.join(hashes, "h").select("h", "span", "kinds", (F.col("times") > 1).alias("repeated"), "one.*"), "spans", "zstd")

    packed = store.kept(mapped(long, _packed, "t1 bigint, t2 bigint, packed binary").groupBy("t1", "t2").agg(F.first("packed").alias("packed")), "packed")
    wanted = state.where("kinds > 1").groupBy("t1", "t2").agg(F.collect_list(F.struct("h", (F.col("kinds") > MOST_SPANS).alias("many"), "at", "n", "repeated")).alias("spans"))
    texts = mapped(packed.join(wanted, ["t1", "t2"]), _span_texts, "h bigint, many boolean, t1 bigint, t2 bigint, at bigint, n bigint, repeated boolean, data binary")
    texts = store.kept(texts, "texts", "zstd")
    few = mapped(texts.where("not many").drop("many", "n").repartition("h").sortWithinPartitions("h"), _sorted_spans, "t1 bigint, t2 bigint, at bigint, n bigint")
    counted = mapped(texts.where("many"), _window_hashes, "t1 bigint, t2 bigint, at bigint, w binary, weight bigint")
    again = counted.groupBy("w").agg(F.sum("weight").alias("total")).where("total > 1").select("w")
    crowded = counted.where("weight = 1").join(again, "w", "left_semi").select("t1", "t2", "at", F.lit(1).cast("bigint").alias("n"))

    whole = found.join(state.where("repeated").select("h", "span"), ["h", "span"], "left_semi").select("t1", "t2", "at", "n")
    windows = whole.union(few).union(crowded).groupBy("t1", "t2").agg(F.collect_set(F.struct("at", "n")).alias("windows"))
    results = mapped(packed.join(windows, ["t1", "t2"]), _without, "t1 bigint, t2 bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, removed array<bigint>")
    own = rows.select("key", "t1", "t2", F.octet_length("text").cast("bigint").alias("size"), F.sha2("text", 256).alias("whole"))
    none = F.lit(0).cast("bigint")
    return own.join(results, ["t1", "t2"], "left").select(
        F.col("key").alias(key), F.col("size").alias("n_bytes"), F.coalesce("n_removed", none).alias("n_removed"), F.coalesce("n_spans", none).alias("n_spans"),
        F.coalesce("kept_sha256", "whole").alias("kept_sha256"), F.coalesce("removed", F.array().cast("array<bigint>")).alias("removed"),
    )
