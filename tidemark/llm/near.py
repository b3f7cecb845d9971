"""Near-duplicate documents: consistent weighted sampling over TF-IDF shingles, bands, exact verification.

A shingle is five consecutive words (a shorter text is one shingle). Its weight is its count in the document
times 1 + IDF_SHARE * idf, where idf in [0, 1] is the mean over its words of log(N / df) / log(N). Document
frequencies are counted over all documents in a hashed vocabulary of 2**VOCABULARY_BITS counters, which bounds
the table that is broadcast; a collision changes a weight alike in every document.

Improved consistent weighted sampling gives each document BANDS * ROWS samples; documents that agree in a band
share a bucket. A bucket is never paired with itself: its most popular member (of whose buckets most documents
are) is compared with every other member by weighted Jaccard similarity of the whole texts. Links make
components; then the most popular member of the next component in the bucket is compared with the others, for
TURNS turns. That settles large families with few comparisons. What shares a bucket and is still in several
components is then compared exactly, by a prefix filter: shingles have one order, rare ones first, and texts of
similarity t share one of those that come before the last t of either's weight. Every pair that shares such a
shingle, and whose weights from there on can still reach t, is verified, so no pair of a bucket is left open.
Texts with the same words are one node throughout.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm import graph, store
from tidemark.llm import words as W
from tidemark.llm.batches import mapped

SHINGLE = 5
SIMILARITY = 0.8
BANDS, ROWS = 10, 4
IDF_SHARE = 0.25
TURNS = 4
VOCABULARY_BITS = 18
COUNTER_BITS = 20
SCRATCH_BYTES = 1 << 20


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents by hashed word, summed over what one task has read."""
    df = np.zeros(1 << VOCABULARY_BITS, np.int64)
    for batch in batches:
        raw, offsets = W.text_bytes(batch["text"])
        for lo, hi in W.pieces(offsets, SCRATCH_BYTES):
            found = W.split(raw[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
            slot = (found.hash >> np.uint64(64 - VOCABULARY_BITS)).astype(np.int64)
            once = np.unique((found.doc() << VOCABULARY_BITS) | slot)
            df += np.bincount(once & ((1 << VOCABULARY_BITS) - 1), minlength=len(df))
    some = np.flatnonzero(df)
    yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(df[some])], names=["slot", "df"])


def idf_table(texts: DataFrame) -> np.ndarray:
    """idf by hashed word, scaled to [0, 1], over all documents; words never seen have 1."""
    counted = mapped(texts.select("text"), _frequencies, "slot int, df bigint").groupBy("slot").agg(F.sum("df").alias("df")).toPandas()
    n = max(2, texts.count())
    out = np.ones(1 << VOCABULARY_BITS, np.float32)
    out[counted["slot"].to_numpy()] = np.log(n / counted["df"].to_numpy()) / np.log(n)
    return np.clip(out, 0, 1)


def _gamma_quantiles() -> np.ndarray:
    """Gamma(2, 1) at 2**16 evenly spaced probabilities, by bisection of 1 - (1 + x) exp(-x)."""
    p = (np.arange(1 << 16) + 0.5) / (1 << 16)
    low, high = np.zeros_like(p), np.full_like(p, 64.0)
    for _ in range(60):
        x = (low + high) / 2
        under = 1 - (1 + x) * np.exp(-x) < p
        low, high = np.where(under, x, low), np.where(under, high, x)
    return low


def shingles(found: W.Words, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, shingle, weight) of the distinct shingles of each row, by row."""
    sizes = np.diff(found.first)
    starts = found.starts_of(SHINGLE)
    h = found.run_hash(starts, SHINGLE)
    rarity = idf[(found.hash >> np.uint64(64 - VOCABULARY_BITS)).astype(np.int64)]
    mean = np.zeros(len(starts), np.float32)
    for k in range(SHINGLE):  # in a fixed order, so that a shingle weighs the same everywhere
        mean += rarity[starts + k]
    mean /= SHINGLE
    row = found.doc()[starts]
    for n in range(1, SHINGLE):  # texts shorter than a shingle
        short = np.flatnonzero(sizes == n)
        if len(short):
            at = found.first[short]
            h = np.concatenate([h, found.run_hash(at, n)])
            total = np.zeros(len(short), np.float32)
            for k in range(n):
                total += rarity[at + k]
            mean, row = np.concatenate([mean, total / np.float32(n)]), np.concatenate([row, short])
    joint = (row.astype(np.uint64) << np.uint64(48)) | (h >> np.uint64(16))
    distinct, at, count = np.unique(joint, return_index=True, return_counts=True)
    weight = count * (np.float32(1) + np.float32(IDF_SHARE) * mean[at])
    return (distinct >> np.uint64(48)).astype(np.int64), distinct & np.uint64((1 << 48) - 1), weight.astype(np.float32)


def _samples(row: np.ndarray, shingle: np.ndarray, weight: np.ndarray, gamma: np.ndarray, log_gamma: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows that have shingles, and for each the BANDS * ROWS sampled shingles."""
    first = np.flatnonzero(np.r_[True, row[1:] != row[:-1]]) if len(row) else np.zeros(0, np.int64)
    log_w = np.log(weight)
    out = np.empty((len(first), BANDS * ROWS), np.uint64)
    tag = W.mixed(shingle) & np.uint64(0xFFFFFFFF)
    for k in range(BANDS * ROWS):
        h = W.mixed(shingle + np.uint64((k + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1))
        r = gamma[(h & np.uint64(0xFFFF)).astype(np.int64)]
        log_c = log_gamma[((h >> np.uint64(16)) & np.uint64(0xFFFF)).astype(np.int64)]
        beta = ((h >> np.uint64(32)) & np.uint64(0xFFFF)).astype(np.float32) / np.float32(65536)
        log_a = log_c - r * (np.floor(log_w / r + beta) - beta) - r
        bits = log_a.astype(np.float32).view(np.int32)
        order = (bits ^ ((bits >> 31) & np.int32(0x7FFFFFFF))).astype(np.int64) + (1 << 31)  # integers in the order of the floats
        out[:, k] = np.minimum.reduceat((order.astype(np.uint64) << np.uint64(32)) | tag, first) & np.uint64(0xFFFFFFFF) if len(first) else 0
    return row[first], out


def _sketcher(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        idf, gamma, log_gamma = shared.value
        for batch in batches:
            raw, offsets = W.text_bytes(batch["text"])
            prints: list[bytes | None] = []
            bands: list[np.ndarray | None] = [None] * batch.num_rows
            mass = np.zeros(batch.num_rows)
            for lo, hi in W.pieces(offsets, SCRATCH_BYTES):
                found = W.split(raw[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
                for a, b in zip(found.first[:-1].tolist(), found.first[1:].tolist(), strict=True):
                    prints.append(xxhash.xxh3_128_digest(found.hash[a:b].tobytes()) if b > a else None)
                row, shingle, weight = shingles(found, idf)
                mass[lo:hi] = np.bincount(row, weight, hi - lo)
                rows, samples = _samples(row, shingle, weight, gamma, log_gamma)
                banded = samples.reshape(len(rows), BANDS, ROWS)
                h = np.zeros((len(rows), BANDS), np.uint64)
                for k in range(ROWS):
                    h = W.mixed(h ^ banded[:, :, k]) + np.uint64(k + 1)
                for i, x in zip(rows.tolist(), h.view(np.int64), strict=True):
                    bands[lo + i] = x
            yield pa.RecordBatch.from_arrays([batch["key"], batch["text_hash"], pa.array(prints, pa.binary()), pa.array(mass), pa.array(bands, pa.list_(pa.int64()))], names=["key", "text_hash", "print", "mass", "bands"])

    return run


def similarity(a: np.ndarray, wa: np.ndarray, b: np.ndarray, wb: np.ndarray) -> float:
    """Weighted Jaccard similarity of two sorted shingle sets."""
    _, i, j = np.intersect1d(a, b, assume_unique=True, return_indices=True)
    least = np.minimum(wa[i], wb[j]).astype(float).sum()
    return float(least / (wa.astype(float).sum() + wb.astype(float).sum() - least)) if len(a) or len(b) else 0.0


def _verifier(shared, least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        idf = shared.value[0]
        inflate = zstandard.ZstdDecompressor()
        recent: dict[bytes, tuple[np.ndarray, np.ndarray]] = {}

        def held(name: bytes, packed: bytes) -> tuple[np.ndarray, np.ndarray]:
            if name not in recent:
                if len(recent) >= 64:
                    recent.clear()
                text = inflate.decompress(packed)
                _, s, w = shingles(W.split(np.frombuffer(text, np.uint8), np.array([0, len(text)])), idf)
                recent[name] = s, w
            return recent[name]

        for batch in batches:
            good = [similarity(*held(a, x), *held(b, y)) >= least for a, b, x, y in zip(*(batch[c].to_pylist() for c in ("a", "b", "text_a", "text_b")), strict=True)]
            yield pa.RecordBatch.from_arrays([batch["a"], batch["b"]], names=["a", "b"]).filter(pa.array(good, pa.bool_()))

    return run


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    deflate = zstandard.ZstdCompressor(level=1)
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch["key"], batch["text_hash"], pa.array([deflate.compress(t.encode()) for t in batch["text"].to_pylist()], pa.binary())], names=["key", "text_hash", "packed"])


def _pairs(placed: DataFrame, turn: int, least: float) -> DataFrame:
    """Members of each bucket beside its hub of this turn: (a, b), each pair once.

    Components present in a bucket take turns by their most popular member, which is the hub; it meets all
    members of the other components. Pairs whose total weights alone keep them below ``least`` are left out.
    """
    best = F.max_by(F.struct("print", "mass"), F.struct("popular", "print"))
    parts = placed.groupBy("band", "h", "label").agg(best.alias("best"), F.max("popular").alias("popular"))
    order = Window.partitionBy("band", "h").orderBy(F.desc("popular"), "label")
    hubs = parts.withColumn("turn", F.row_number().over(order)).where(F.col("turn") <= turn + 1).where(F.col("turn") == turn + 1)
    hubs = hubs.select("band", "h", F.col("label").alias("hub_label"), "best.*").withColumnsRenamed({"print": "hub", "mass": "hub_mass"})
    near = placed.join(hubs, ["band", "h"]).where(F.col("label") != F.col("hub_label")).where(F.least("mass", "hub_mass") >= F.greatest("mass", "hub_mass") * (least - 1e-6))
    return near.select(F.least("print", "hub").alias("a"), F.greatest("print", "hub").alias("b")).distinct()


def _inflated(batch: pa.RecordBatch, idf: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    inflate = zstandard.ZstdDecompressor()
    for packed in batch["packed"].to_pylist():
        text = inflate.decompress(packed)
        _, s, w = shingles(W.split(np.frombuffer(text, np.uint8), np.array([0, len(text)])), idf)
        yield s, w


def _slots(shingle: np.ndarray) -> np.ndarray:
    return (shingle & np.uint64((1 << COUNTER_BITS) - 1)).astype(np.int64)


def _counter(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << COUNTER_BITS, np.int64)
        for batch in batches:
            for s, _ in _inflated(batch, shared.value[0]):
                np.add.at(counts, _slots(s), 1)
        some = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(counts[some])], names=["slot", "n"])

    return run


def prefix(shingle: np.ndarray, weight: np.ndarray, counts: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """The shingles, rare ones first, at which at least ``least`` of the weight is still to come, and that weight."""
    order = np.lexsort((shingle, counts[_slots(shingle)]))
    tail = np.cumsum(weight[order].astype(float)[::-1])[::-1]
    n = np.count_nonzero(tail >= (least - 1e-6) * tail[0]) if len(tail) else 0
    return shingle[order[:n]], tail[:n]


def _prefixes(shared, counted, least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cut = [prefix(s, w, counted.value, least) for s, w in _inflated(batch, shared.value[0])]
            row = pa.array(np.repeat(np.arange(len(cut)), [len(s) for s, _ in cut]))
            s, tail = (np.concatenate([c[k] for c in cut] or [np.zeros(0)]) for k in (0, 1))
            yield pa.RecordBatch.from_arrays([batch["print"].take(row), batch["label"].take(row), batch["mass"].take(row), pa.array(s.astype(np.int64)), pa.array(tail)], names=["print", "label", "mass", "shingle", "tail"])

    return run


def _undecided_pairs(placed: DataFrame, packed: DataFrame, shared, least: float) -> DataFrame:
    """(a, b), each once: members of different components that may reach ``least``, of all buckets that hold several."""
    several = placed.groupBy("band", "h").agg(F.min("label").alias("first"), F.max("label").alias("last")).where("first <> last")
    members = placed.join(several, ["band", "h"], "left_semi").select("print", "label", "mass").distinct()
    members = store.kept(members.join(packed, "print"), "undecided")
    counts = np.zeros(1 << COUNTER_BITS, np.int64)
    table = mapped(members.select("packed"), _counter(shared), "slot int, n bigint").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()
    counts[table["slot"].to_numpy()] = table["n"].to_numpy()
    counted = placed.sparkSession.sparkContext.broadcast(counts)
    rows = store.kept(mapped(members, _prefixes(shared, counted, least), "print binary, label binary, mass double, shingle bigint, tail double"), "prefixes")
    a, b = (rows.select("shingle", F.col("print").alias(x), *[F.col(c).alias(f"{c}_{x}") for c in ("label", "mass", "tail")]) for x in "ab")
    # at the first shingle they share, both must have the weight in common that the similarity takes
    enough = F.least("tail_a", "tail_b") >= (F.col("mass_a") + F.col("mass_b")) * (least / (1 + least) - 1e-6)
    return a.join(b, "shingle").where(F.col("a") < F.col("b")).where(F.col("label_a") != F.col("label_b")).where(enough).select("a", "b").distinct()


def classes(docs: DataFrame, *, key: str = "doc_id", text: str = "text", least: float = SIMILARITY) -> DataFrame:
    """key, class_id and kept of every row: class_id is the smallest key of the row's near-duplicate class.

    Rows whose texts have the same words are in one class; classes are joined by links of weighted Jaccard
    similarity of ``least`` or more. A null text, or one without words, is a class of its own (class_id is its
    key). Rows with a null key get the class of their words; it is null if no row of it has a key, and such rows
    are not compared further. kept: the key is the class's smallest; where keys repeat, all such rows are kept.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col(key).alias("key"), F.xxhash64(text).alias("text_hash"), F.col(text).alias("text"))
    gamma = _gamma_quantiles()
    shared = spark.sparkContext.broadcast((idf_table(texts), gamma.astype(np.float32), np.log(gamma).astype(np.float32)))
    kind = texts.schema["key"].dataType.simpleString()
    sketched = store.kept(mapped(texts, _sketcher(shared), f"key {kind}, text_hash bigint, print binary, mass double, bands array<bigint>"), "sketches")
    nodes = sketched.where("print is not null").groupBy("print").agg(F.min(F.when(F.col("key").isNotNull(), F.struct("key", "text_hash"))).alias("own"), F.max("mass").alias("mass"), F.max("bands").alias("bands"))
    nodes = store.kept(nodes.select("print", "own.key", "own.text_hash", "mass", "bands"), "nodes")
    members = nodes.where("key is not null").select("print", "mass", F.posexplode("bands").alias("band", "h"))
    sizes = members.groupBy("band", "h").agg(F.count("*").alias("n")).where("n > 1")
    met = store.kept(members.join(sizes, ["band", "h"]), "met")
    popular = met.groupBy("print").agg(F.sum("n").alias("popular"))
    buckets = store.kept(met.join(popular, "print").select("band", "h", "print", "mass", "popular"), "buckets")
    packed = mapped(texts.where("text is not null"), _packed, f"key {kind}, text_hash bigint, packed binary")
    wanted = nodes.join(popular, "print", "left_semi").select("print", "key", "text_hash")
    packed = store.kept(wanted.join(packed, ["key", "text_hash"]).groupBy("print").agg(F.max("packed").alias("packed")), "texts")

    labels = nodes.select(F.col("print").alias("node"), F.col("print").alias("label"))
    tested = None
    for turn in range(TURNS + 1):  # hubs first; the last turn leaves no pair of a bucket open
        placed = buckets.join(labels, buckets["print"] == labels["node"]).select("band", "h", "print", "mass", "popular", "label")
        pairs = _pairs(placed, turn, least) if turn < TURNS else _undecided_pairs(placed, packed, shared, least)
        if tested is not None:
            pairs = pairs.join(tested, ["a", "b"], "left_anti")
        pairs = store.kept(pairs, "pairs")
        if pairs.isEmpty():
            continue
        both = pairs.join(packed.select(F.col("print").alias("a"), F.col("packed").alias("text_a")), "a")
        both = both.join(packed.select(F.col("print").alias("b"), F.col("packed").alias("text_b")), "b")
        found = store.kept(mapped(both.select("a", "b", "text_a", "text_b"), _verifier(shared, least), "a binary, b binary"), "found")
        tested = pairs if tested is None else tested.union(pairs)
        if found.isEmpty():
            continue
        old = labels.select(F.col("node").alias("a"), F.col("label").alias("label_a"))
        other = labels.select(F.col("node").alias("b"), F.col("label").alias("label_b"))
        links = store.kept(found.join(old, "a").join(other, "b").select(F.col("label_a").alias("a"), F.col("label_b").alias("b")).distinct(), "links")
        joined = graph.components(links.select(F.col("a").alias("node")).union(links.select("b")), links).select(F.col("node").alias("was"), F.col("label").alias("becomes"))
        labels = store.kept(labels.join(joined, labels["label"] == joined["was"], "left").select("node", F.coalesce("becomes", "label").alias("label")), "labels")

    smallest = labels.join(nodes.select("print", "key"), F.col("node") == F.col("print")).select("node", "label", "key")
    named = smallest.join(smallest.groupBy("label").agg(F.min("key").alias("class_id")), "label").select("node", "class_id")
    out = sketched.join(named, sketched["print"] == named["node"], "left")
    class_id = F.when(F.col("print").isNull(), F.col("key")).otherwise(F.col("class_id"))
    return out.select(F.col("key").alias(key), class_id.alias("class_id"), class_id.eqNullSafe(F.col("key")).alias("kept"))
