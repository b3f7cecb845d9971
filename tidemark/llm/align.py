"""Alignment of two tokenizers over the same bytes: groups between common token ends, and links of token pairs.

A document's tokens are rows of sparse matrices in compressed-row form, built by hand: token by byte for the overlap
of tokens, token by group for their membership in groups. Gustavson's row products A.Bt add, for each row of A, the
rows of Bt that its entries select. The byte matrices give overlap links with their bytes in common, the group
matrices all pairs of a shared group. Matrices of many texts are stacked block-diagonally.

Neither tokenizer merges across a place where a space follows a character that is no white space (byte-level
pre-tokens break there, and no piece of the other holds its space mark behind another character; a vocabulary for
which that fails is refused). So texts are cut there into chunks, tokens and groups lie within one chunk, and each
distinct chunk is encoded and multiplied once per task as long as its results are held.

Counts over the corpus are never gathered on the driver or broadcast. Documents are dealt to blocks where they are
read; a block's distinct id pairs are counted by Spark over all blocks, and each block is answered with the counts of
its own pairs.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator
from itertools import chain, pairwise, repeat

import numpy as np
import public_tokenizers
import pyarrow as pa
import sentencepiece
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tidemark.llm import store
from tidemark.llm.batches import mapped

BYTE_BPE = "byte_bpe_50k.json"
PIECE_BPE = "piece_bpe_32k.model"
HELD_BYTES = 64 << 20  # results of chunks held by a task
PIECE_CHARS = 1 << 20  # characters of texts worked on together; a longer text is cut at chunks
BLOCK_PAIRS = 1 << 19  # id pairs of documents in a block, the last document's included
SLICE = 1 << 21  # products formed at once
LEARNT = 1 << 15  # chunks encoded and multiplied together; their numbers take 15 bits of a key, ids 24 each
JOINED_BYTES = 1 << 14  # chunks are encoded side by side in texts of this size
MARK = "▁"
_CHUNKS = re.compile(r"\s*\S+(?:[^\S ]\s*\S*)*|\s+")
_CUT = re.compile(r"(?<=\S) ")


class Rows:
    """A sparse matrix by rows: ``columns[begin[i]:begin[i + 1]]`` are the columns of the ones in row i."""

    def __init__(self, begin: np.ndarray, columns: np.ndarray) -> None:
        self.begin, self.columns = begin, columns

    @classmethod
    def of_lengths(cls, lengths: np.ndarray) -> Rows:
        """Row i holds the next ``lengths[i]`` columns: tokens over their bytes, groups over their tokens."""
        begin = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)
        return cls(begin, np.arange(begin[-1]))

    @classmethod
    def of_owners(cls, owner: np.ndarray) -> Rows:
        """One column per row: bytes in their token (the transpose of a token-byte matrix), tokens in their group."""
        return cls(np.arange(len(owner) + 1), owner)


def row_products(left: Rows, right: Rows, most: int = SLICE) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(row, column, value) of left.right by Gustavson's rule, in slices of whole rows with about ``most`` products.

    Row i of the product is the sum of the rows of ``right`` that the entries of row i of ``left`` name.
    """
    widths = right.begin[left.columns + 1] - right.begin[left.columns]
    before = np.concatenate([[0], np.cumsum(widths)])  # products before each entry of left
    rows = len(left.begin) - 1
    lo = 0
    while lo < rows:
        hi = int(np.searchsorted(before[left.begin], before[left.begin[lo]] + most, side="right")) - 1
        hi = min(max(hi, lo + 1), rows)
        e = slice(left.begin[lo], left.begin[hi])
        width = widths[e]
        row = np.repeat(np.repeat(np.arange(lo, hi), np.diff(left.begin[lo : hi + 1])), width)
        start = np.repeat(right.begin[left.columns[e]] - (before[:-1][e] - before[left.begin[lo]]), width)
        column = right.columns[start + np.arange(len(row))]
        if len(row):
            place, n = _counted(row << 32 | column)
            yield place >> 32, place & 0xFFFFFFFF, n
        lo = hi


def _byte_alphabet() -> dict[str, int]:
    """The characters by which byte-level vocabularies write bytes: printable ones stand for themselves, the rest follow at 256."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class Aligner:
    """Both tokenizers and the results of chunks held so far."""

    def __init__(self, byte_bpe: str, piece_bpe: str) -> None:
        path = lambda name: name if "/" in name else public_tokenizers.path(name)
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks share the cores already
        self.a = Tokenizer.from_file(path(byte_bpe))
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=path(piece_bpe))
        letters = _byte_alphabet()
        self.bytes_a = [bytes(letters[c] for c in t) if all(c in letters for c in t) else t.encode() for t in (self.a.id_to_token(k) for k in range(self.a.get_vocab_size()))]
        pieces = [self.b.id_to_piece(k) for k in range(self.b.get_piece_size())]
        with open(path(byte_bpe)) as f:
            form = json.load(f)
        if form["normalizer"] or form["pre_tokenizer"] != form["pre_tokenizer"] | {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}:
            raise ValueError(f"{byte_bpe} is not a plain byte-level vocabulary")
        if any(re.search(f"[^{MARK}]{MARK}", p) for p in pieces):
            raise ValueError(f"{piece_bpe} has pieces with a space mark inside")
        self.bytes_b = [bytes([int(p[3:-1], 16)]) if self.b.is_byte(k) else p.replace(MARK, " ").encode() for k, p in enumerate(pieces)]
        self.length_a, self.length_b = (np.array([len(x) for x in s], np.int64) for s in (self.bytes_a, self.bytes_b))
        self.spelt_a, self.spelt_b = (np.frombuffer(b"".join(s), np.uint8) for s in (self.bytes_a, self.bytes_b))
        self.bytes_a = self.bytes_b = None
        self.space = self.b.piece_to_id(MARK)
        self.forget()

    def forget(self) -> None:
        self.slot: dict[str, int] = {}
        self.groups: list[bytes] = []
        self.valid = [np.zeros(0, bool)]
        self.figures = [np.zeros((0, 5), np.int64)]
        self.pairs, self.times, self.n_pairs = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        self.size = 0

    def _ids_a(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.a.encode_batch_fast(texts, add_special_tokens=False)]

    def _ids_b(self, texts: list[str]) -> list[list[int]]:
        """Texts begin with a space, and the library adds the first itself, but not to an empty text."""
        return [[self.space] if t == " " else ids for t, ids in zip(texts, self.b.encode([t[1:] for t in texts], num_threads=1), strict=True)]

    def _encoded(self, run: list[str], odd: list[str], sizes: np.ndarray, ids_of, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all chunks, and how many each has. Those of ``run`` may stand side by side, and ``sizes`` are their bytes."""
        cuts = np.flatnonzero(np.diff(np.cumsum(sizes) // JOINED_BYTES)) + 1
        together = ["".join(run[lo:hi]) for lo, hi in pairwise([0, *cuts.tolist(), len(run)]) if hi > lo]
        found = ids_of(together)
        ids = np.fromiter(chain.from_iterable(found), np.int64, sum(map(len, found)))
        ends, wanted = np.cumsum(length[ids]), np.cumsum(sizes)
        place = np.searchsorted(ends, wanted)
        if len(run) and (place[-1] != len(ids) - 1 or (ends[place] != wanted).any()):
            odd, n = run + odd, np.zeros(0, np.int64)  # some chunk isn't spelt by its tokens, so each is encoded alone
            ids = ids[:0]
        else:
            n = np.diff(place, prepend=-1)
        alone = ids_of(odd)
        more = np.fromiter(map(len, alone), np.int64, len(odd))
        return np.concatenate([ids, np.fromiter(chain.from_iterable(alone), np.int64, int(more.sum()))]), np.concatenate([n, more])

    @staticmethod
    def _spells(raw: np.ndarray, of_chunk: np.ndarray, ids: np.ndarray, own: np.ndarray, length: np.ndarray, spelt: np.ndarray) -> np.ndarray:
        """Per chunk whether its tokens' bytes are its own; ``of_chunk`` are bytes of each, ``own`` the chunk of each token."""
        n = length[ids]
        same = np.bincount(own, n, len(of_chunk)).astype(np.int64) == of_chunk
        ids, n, own = ids[same[own]], n[same[own]], own[same[own]]
        told = spelt[np.repeat((np.cumsum(length) - length)[ids] - (np.cumsum(n) - n), n) + np.arange(n.sum())]
        differs = np.flatnonzero(told != raw[np.repeat(same, of_chunk)])
        same[np.repeat(np.arange(len(same)), np.where(same, of_chunk, 0))[differs]] = False
        return same

    def learn(self, chunks: list[str]) -> None:
        """Encodes new chunks and multiplies their matrices, all stacked."""
        for k in range(0, len(chunks), LEARNT):
            self._learn(chunks[k : k + LEARNT])

    def _learn(self, chunks: list[str]) -> None:
        odd = [c for c in chunks if c[-1].isspace() or MARK in c]
        run = [c for c in chunks if not (c[-1].isspace() or MARK in c)] if odd else chunks
        chunks = run + odd
        joined = list(map(str.encode, chunks))
        of_chunk, raw = np.fromiter(map(len, joined), np.int64, len(chunks)), np.frombuffer(b"".join(joined), np.uint8)
        sides, valid = [], np.ones(len(chunks), bool)
        for ids_of, length, spelt in ((self._ids_a, self.length_a, self.spelt_a), (self._ids_b, self.length_b, self.spelt_b)):
            ids, n = self._encoded(run, odd, of_chunk[: len(run)], ids_of, length)
            own = np.repeat(np.arange(len(chunks)), n)
            valid &= self._spells(raw, of_chunk, ids, own, length, spelt)
            sides.append((ids, own))
        (id_a, own_a), (id_b, own_b) = ((ids[valid[own]], own[valid[own]]) for ids, own in sides)
        n_a, n_b = (np.bincount(own, minlength=len(chunks)) for own in (own_a, own_b))
        token_bytes_a = Rows.of_lengths(self.length_a[id_a])
        token_bytes_b = Rows.of_lengths(self.length_b[id_b])
        overlaps = np.zeros(len(chunks), np.int64)
        for row, _, _ in row_products(token_bytes_a, Rows.of_owners(np.repeat(np.arange(len(id_b)), self.length_b[id_b]))):
            overlaps += np.bincount(own_a[row], minlength=len(chunks))
        end_a, end_b = token_bytes_a.begin[1:], token_bytes_b.begin[1:]
        common = np.intersect1d(end_a, end_b, assume_unique=True)
        group_a, group_b = np.searchsorted(common, end_a), np.searchsorted(common, end_b)
        of_group_b = Rows.of_lengths(np.bincount(group_b, minlength=len(common)))
        links = np.zeros(len(chunks), np.int64)
        keys, times = [], []
        for row, column, _ in row_products(Rows.of_owners(group_a), of_group_b):
            links += np.bincount(own_a[row], minlength=len(chunks))
            found, n = _counted(own_a[row] << 48 | id_a[row] << 24 | id_b[column])
            keys.append(found)
            times.append(n)
        key, time = _counted(np.concatenate(keys), np.concatenate(times)) if keys else (np.zeros(0, np.int64), np.zeros(0, np.int64))
        groups = np.bincount(own_a[np.searchsorted(end_a, common)], minlength=len(chunks))
        self.figures.append(np.stack([n_a, n_b, groups, links, overlaps], axis=1))
        self.n_pairs.append(np.bincount(key >> 48, minlength=len(chunks)))
        self.pairs.append((key >> 24 & 0xFFFFFF) << 32 | key & 0xFFFFFF)
        self.times.append(time)
        texts = self._texts(len(chunks), id_a, id_b, group_a, group_b, own_a)
        self.slot.update(zip(chunks, range(len(self.groups), len(self.groups) + len(chunks)), strict=True))
        self.groups += texts
        self.valid.append(valid)
        self.size += 250 * len(chunks) + 16 * len(time) + sum(map(len, texts)) + 2 * sum(map(len, chunks))

    @staticmethod
    def _texts(chunks: int, id_a: np.ndarray, id_b: np.ndarray, group_a: np.ndarray, group_b: np.ndarray, own_a: np.ndarray) -> list[bytes]:
        """Groups of each chunk as a1,a2|b1;a3|b2,b3, the ids' digits written side by side; empty without tokens."""
        if not len(id_a):
            return [b""] * chunks
        n = int(group_a[-1]) + 1
        upto_a, upto_b = (np.cumsum(np.bincount(g, minlength=n)) for g in (group_a, group_b))
        at_a = np.arange(len(id_a)) + np.concatenate([[0], upto_b[:-1]])[group_a]
        at_b = np.arange(len(id_b)) + upto_a[group_b]
        ids, mark = np.empty(len(id_a) + len(id_b), np.int64), np.full(len(id_a) + len(id_b), ord(","), np.uint8)
        ids[at_a], ids[at_b] = id_a, id_b
        mark[at_a[upto_a - 1]], mark[at_b[upto_b - 1]] = ord("|"), ord(";")
        width = 1
        while 10**width <= ids.max():
            width += 1
        written = np.empty((len(ids), width + 1), np.uint8)
        for k in range(width):
            written[:, k] = ids // 10 ** (width - 1 - k) % 10 + ord("0")
        written[:, width] = mark
        shown = np.ones(written.shape, bool)
        for k in range(width - 1):
            shown[:, k] = ids >= 10 ** (width - 1 - k)
        ends = np.cumsum(shown.sum(axis=1))
        data = written[shown].tobytes()
        last = ends[at_b[upto_b - 1]]  # of each group
        stop = np.zeros(chunks, np.int64)
        np.maximum.at(stop, own_a[upto_a - 1], last)
        stop = np.maximum.accumulate(stop).tolist()
        return [data[lo : max(lo, hi - 1)] for lo, hi in pairwise([0, *stop])]

    def slots(self, chunks: list[str]) -> np.ndarray:
        """The slot of each chunk, learnt if new."""
        if self.size > HELD_BYTES:
            self.forget()
        found = np.fromiter(map(self.slot.get, chunks, repeat(-1)), np.int64, len(chunks))
        missing = np.flatnonzero(found < 0)
        new = dict.fromkeys(chunks[k] for k in missing.tolist())
        if new:
            self.learn(list(new))
            found[missing] = [self.slot[chunks[k]] for k in missing.tolist()]
        for name in ("valid", "figures", "pairs", "times", "n_pairs"):
            parts = getattr(self, name)
            if len(parts) > 1:
                setattr(self, name, [np.concatenate(parts)])
        if new:
            self.begin = np.concatenate([[0], np.cumsum(self.n_pairs[0])])
        return found


def _counted(key: np.ndarray, weight: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, and how often each occurs or the sum of its weights."""
    if not len(key):
        return key, np.zeros(0, np.int64)
    if (key[1:] < key[:-1]).any():
        order = np.argsort(key, kind="stable")
        key, weight = key[order], None if weight is None else weight[order]
    at = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    return key[at], np.diff(np.concatenate([at, [len(key)]])) if weight is None else np.add.reduceat(weight, at)


class Document:
    """Figures of one text, added up over its pieces."""

    def __init__(self, with_groups: bool) -> None:
        self.figures = np.zeros(5, np.int64)
        self.hash, self.text = hashlib.sha256(), [] if with_groups else None
        self.keys: list[np.ndarray] = []
        self.times: list[np.ndarray] = []
        self.valid, self.begun = True, False

    def add(self, aligner: Aligner, slots: np.ndarray) -> None:
        self.valid = self.valid and bool(aligner.valid[0][slots].all())
        if not self.valid:
            return
        self.figures += aligner.figures[0][slots].sum(axis=0)
        groups = (b";" if self.begun else b"") + b";".join(map(aligner.groups.__getitem__, slots.tolist()))
        self.hash.update(groups)
        if self.text is not None:
            self.text.append(groups)
        self.begun = True
        slot, n = np.unique(slots, return_counts=True)
        width = aligner.n_pairs[0][slot]
        at = np.repeat(aligner.begin[slot] - (np.cumsum(width) - width), width) + np.arange(width.sum())
        self.keys.append(aligner.pairs[0][at])
        self.times.append(aligner.times[0][at] * np.repeat(n, width))

    def pairs(self) -> tuple[np.ndarray, np.ndarray]:
        """Distinct id pairs of the text and how many links each has."""
        if not self.valid or not self.keys:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        key, back = np.unique(np.concatenate(self.keys), return_inverse=True)
        return key, np.bincount(back, np.concatenate(self.times), len(key)).astype(np.int64)


def _pieces(text: str) -> Iterator[str]:
    """A text cut at chunk borders into pieces of about PIECE_CHARS characters."""
    lo = 0
    while lo < len(text):
        m = _CUT.search(text, lo + PIECE_CHARS)
        hi = m.start() if m else len(text)
        yield text[lo:hi]
        lo = hi


def _packed(index: np.ndarray, times: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(np.concatenate([np.diff(index, prepend=0), times]).astype("<u4").tobytes())


def _unpacked(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    both = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), "<u4").astype(np.int64)
    half = len(both) // 2
    return np.cumsum(both[:half]), both[half:]


_FIGURES = ("n_a", "n_b", "n_groups", "n_links", "n_overlaps")


def _encoded(docs: DataFrame, key: str, text: str, byte_bpe: str, piece_bpe: str, with_groups: bool) -> DataFrame:
    """Rows of documents (their figures and packed pairs, by place in the block's list) and of blocks (id pairs, documents with each)."""
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = Aligner(byte_bpe, piece_bpe)
        block = TaskContext.get().partitionId() << 24
        held: list[tuple] = []
        size = 0

        def closed(held: list[tuple], key_type: pa.DataType) -> pa.RecordBatch:
            pairs, place, n = np.unique(np.concatenate([k for _, _, k, _ in held]), return_inverse=True, return_counts=True)
            ends = np.cumsum([len(k) for _, _, k, _ in held])[:-1]
            packed = [_packed(p, t) for p, (_, _, _, t) in zip(np.split(place, ends), held, strict=True)]
            valid = [d.valid and d.begun for _, d, _, _ in held]
            figures = np.stack([d.figures if ok else np.zeros(5, np.int64) for (_, d, _, _), ok in zip(held, valid, strict=True)])
            groups = [b"".join(d.text).decode() if ok else "" for (_, d, _, _), ok in zip(held, valid, strict=True)] if with_groups else [None] * len(held)
            columns = [
                pa.array([block] * (len(held) + 1), pa.int64()),
                pa.array([False] * len(held) + [True]),
                pa.array([k for k, _, _, _ in held] + [None], key_type),
                *[pa.array([*figures[:, c].tolist(), None], pa.int64()) for c in range(5)],
                pa.array([d.hash.hexdigest() if ok else "" for (_, d, _, _), ok in zip(held, valid, strict=True)] + [None]),
                pa.array([*groups, None], pa.string()),
                pa.array([*packed, None], pa.binary()),
                pa.array([None] * len(held) + [pairs], pa.list_(pa.int64())),
                pa.array([None] * len(held) + [n], pa.list_(pa.int64())),
            ]
            return pa.RecordBatch.from_arrays(columns, names=["block", "is_list", "key", *_FIGURES, "groups_sha256", "groups", "packed", "pairs", "n_docs"])

        for batch in batches:
            key_type = batch.schema.field("key").type
            row = 0
            while row < batch.num_rows:
                group, chars = [], 0  # texts worked on together
                while row < batch.num_rows and (not group or chars < PIECE_CHARS):
                    t = batch["text"][row].as_py() or ""
                    group.append((batch["key"][row].as_py(), t))
                    chars += len(t)
                    row += 1
                documents = [Document(with_groups) for _ in group]
                if len(group) == 1:
                    for piece in _pieces(f" {group[0][1]}" if group[0][1] else ""):
                        documents[0].add(aligner, aligner.slots(_CHUNKS.findall(piece)))
                else:
                    cut = [_CHUNKS.findall(f" {t}") if t else [] for _, t in group]
                    slots = aligner.slots(list(chain.from_iterable(cut)))
                    for d, part in zip(documents, np.split(slots, np.cumsum([len(c) for c in cut])[:-1]), strict=True):
                        if len(part):
                            d.add(aligner, part)
                for (k, _), d in zip(group, documents, strict=True):
                    pairs, times = d.pairs()
                    d.keys, d.times = [], []
                    held.append((k, d, pairs, times))
                    size += len(pairs)
                    if size >= BLOCK_PAIRS or len(held) >= 1 << 14:
                        yield closed(held, key_type)
                        held, size, block = [], 0, block + 1
        if held:
            yield closed(held, key_type)

    schema = (
        f"block bigint, is_list boolean, key {kind}, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, n_overlaps bigint, "
        "groups_sha256 string, groups string, packed binary, pairs array<bigint>, n_docs array<bigint>"
    )
    return mapped(docs.select(F.col(key).alias("key"), F.col(text).alias("text")), run, schema)


def _table(encoded: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(block, place, pair, n_docs) of all lists, and (pair, count, best) over the corpus."""
    lists = encoded.where("is_list").select("block", F.posexplode(F.arrays_zip("pairs", "n_docs")).alias("place", "z")).select("block", "place", "z.pairs", "z.n_docs")
    counts = lists.groupBy("pairs").agg(F.sum("n_docs").alias("count")).withColumn("a", F.shiftright("pairs", 32))
    highest = counts.groupBy("a").agg(F.max("count").alias("highest"))
    return lists, counts.join(highest, "a").select("pairs", "count", (F.col("count") == F.col("highest")).alias("best"))


def links(docs: DataFrame, *, key: str = "doc_id", text: str = "text", byte_bpe: str = BYTE_BPE, piece_bpe: str = PIECE_BPE) -> DataFrame:
    """(a_id, b_id, n_docs, best): id pairs linked anywhere, in how many documents, and whether none of a_id's is in more.

    Rows count as documents, null and repeated keys included; an empty table gives no pairs.
    """
    _, table = _table(store.kept(_encoded(docs, key, text, byte_bpe, piece_bpe, False), "aligned"))
    return table.select(F.shiftright("pairs", 32).alias("a_id"), F.col("pairs").bitwiseAND(0xFFFFFFFF).alias("b_id"), F.col("count").alias("n_docs"), "best")


def aligned(
    docs: DataFrame, *, key: str = "doc_id", text: str = "text", byte_bpe: str = BYTE_BPE, piece_bpe: str = PIECE_BPE, with_groups: bool = True
) -> DataFrame:
    """Per row: key, n_a, n_b (tokens), n_groups, n_links (pairs that share a group), n_overlaps (pairs that share a byte),
    n_best (links whose id pair is in as many documents as any of its A id's), count_sum (documents of the id pair, summed
    over links), groups_sha256, and groups (a1,a2|b1;a3|b2,b3) if asked for.

    A text that is null, empty, or whose tokens do not spell a space and the text has zeros and empty strings. Every row
    is a document: repeated rows count each, null keys stay. Texts are read whole, in pieces; memory is bounded by a
    piece, a block of BLOCK_PAIRS id pairs, and what one document's own groups need. Other columns, whatever their names,
    are ignored. An empty table gives an empty one.
    """
    encoded = store.kept(_encoded(docs, key, text, byte_bpe, piece_bpe, with_groups), "aligned")
    lists, table = _table(encoded)
    answers = lists.join(table, "pairs").select(F.col("block").alias("asked"), "place", "count", "best")
    kept = ["key", *_FIGURES, "groups_sha256", *(["groups"] if with_groups else [])]
    rows = encoded.where("not is_list").select("block", "packed", *kept)
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.select(*kept).schema) + ", n_best bigint, count_sum bigint"

    def answered(left: pa.Table, right: pa.Table) -> pa.Table:
        place = right["place"].to_numpy()
        count, best = (np.zeros(len(place), np.int64) for _ in range(2))
        count[place], best[place] = right["count"].to_numpy(), right["best"].to_numpy().astype(np.int64)
        sums = []
        for data in left["packed"]:
            index, times = _unpacked(data.as_py())
            sums.append((int((best[index] * times).sum()), int((count[index] * times).sum())))
        out = left.select(kept)
        return out.append_column("n_best", pa.array([b for b, _ in sums], pa.int64())).append_column("count_sum", pa.array([c for _, c in sums], pa.int64()))

    out = rows.groupBy("block").cogroup(answers.groupBy("asked")).applyInArrow(answered, schema)
    return out.withColumnRenamed("key", key)
