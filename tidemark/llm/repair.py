"""Repair of conversations: the cheapest edits that leave an optional system turn and then user and assistant by turns.

Rows of a conversation are numbered states of a small machine: nothing yet, after a system turn, after a user turn, after
an assistant turn. Nodes are (row, state), arcs are edits: Keep, Rerole, Delete take a row, Insert takes none. A cost
DP from the end finds what each node still costs, and which arcs are optimal. Nodes are then ranked by the least audit
(the edits' initials) of 1, 2, 4, ... letters that can follow: a rank of twice the length is the rank of a pair, that of
the node and that of the node its pointer reaches, and pointers double with it. The letters out of one node differ, so
each node has one least arc; ranks choose it, and the audit is read off the doubled pointers at all places at once.

A conversation may hold any share of all rows. Rows are sorted over range partitions and cut into segments of bounded
size; a segment's costs from each state to each state form a min-plus matrix. Segments of one conversation are combined
by doubling, as joins: first backward, for what remains to be paid behind each segment, then forward, for the state in
which the least path enters it. Each segment is then solved on its own.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm import store
from tidemark.llm.batches import mapped
from tidemark.operators.scan import numbered

KEEP, REROLE, DELETE, INSERT, UNFINISHED = 0, 3, 4, 3, 3  # costs
SEGMENT_ROWS = 1_024
SEGMENT_CHARS = 1 << 20
SOLVED_ROWS = 1 << 14  # rows solved together
START, SYSTEM, USER, ASSISTANT = range(4)
NEXT = np.array([USER, USER, ASSISTANT, USER])  # the state that a user or assistant turn leads to
ENDING = np.array([0, 2 * INSERT, INSERT, 0])  # cost of ending in each state
FAR = 1 << 60
_LETTERS = b" DIKR"  # in ASCII order; 0 is the end of a segment
_FINE, _MUST_GO, _UNFINISHED = range(3)
_BLANK = r"[^\x20\x09-\x0D]"


def damaged(rows: DataFrame) -> DataFrame:
    """Conversations with faults put in by a hash of their ids: rows dropped, emptied, stripped of full stops, repeated or
    given to the user. A null counts as one space in the hash, the role and the text."""
    ready = rows.select("conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"))
    name = F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")])
    how = F.crc32(name.cast("binary")) % 20
    text = F.when(how == 1, "").when(how == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(how == 4, "user").otherwise(F.col("role"))
    copies = F.explode(F.when(how == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    out = ready.where(how != 0).select("conv_id", "turn", role.alias("role"), text.alias("text"), copies.alias("copy"))
    return out.drop("copy")


def _faulty(rows: DataFrame) -> DataFrame:
    """Rows with a number of their own and their first fault, written once so that numbers stay."""
    digest = F.unhex(F.sha2(F.concat_ws(":", F.length("role"), "role", "text"), 256))
    kept = store.kept(rows.withColumns({"digest": digest, "id": F.monotonically_increasing_id()}), "turns")
    place = F.struct("turn", "id")
    again = kept.groupBy(F.col("conv_id").alias("of"), F.col("digest").alias("same")).agg(F.count("*").alias("n"), F.min(place).alias("first")).where("n > 1")
    known = kept.join(again, (F.col("digest") == F.col("same")) & F.col("conv_id").eqNullSafe(F.col("of")), "left")
    last = F.regexp_extract("text", r"([^\x20\x09-\x0D])[\x20\x09-\x0D]*\z", 1)
    fault = (
        F.when(~F.col("text").rlike(_BLANK), 1).when(F.col("first.id") != F.col("id"), 2).when(~last.isin(".", "!", "?"), 3).otherwise(0)
    )
    return known.select("conv_id", "turn", "role", "text", "id", fault.cast("int").alias("fault"), F.substring("text", 1, 64).alias("head"), "digest")


class _Batch(NamedTuple):
    """Segments stacked: positions ``base[s] .. base[s] + size[s]``, the last of which is the segment's exit."""

    base: np.ndarray
    size: np.ndarray
    initial: np.ndarray  # state a kept row would lead to as a role, by position; START if none
    fault: np.ndarray

    @classmethod
    def of(cls, initials: list[bytes], faults: list[bytes]) -> _Batch:
        size = np.array([len(x) for x in faults], np.int64)
        base = np.cumsum(size + 1) - (size + 1)
        initial, fault = (np.frombuffer(b"".join(x + b"\0" for x in side), np.uint8).astype(np.int64) for side in (initials, faults))
        return cls(base, size, initial, fault)

    def arcs(self, at: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """(letter, cost, steps of position, state reached) from every state of positions ``at``, in order of letters."""
        shape = (len(at), 4)
        stay, gone, extra = self.initial[at][:, None], (self.fault[at] == _MUST_GO)[:, None], np.where(self.fault[at] == _UNFINISHED, UNFINISHED, 0)[:, None]
        state = np.broadcast_to(np.arange(4), shape)
        ahead = np.broadcast_to(NEXT, shape)
        kept = np.where((stay == SYSTEM) & (state == START), SYSTEM, ahead)
        fits = ((stay == SYSTEM) & (state == START)) | ((stay == ahead) & (stay != SYSTEM))
        yield 1, np.full(shape, DELETE), np.ones(shape, int), state
        yield 2, np.full(shape, INSERT), np.zeros(shape, int), ahead
        yield 3, np.where(fits & ~gone, KEEP + extra, FAR), np.ones(shape, int), kept
        yield 4, np.where(~gone, REROLE + extra, FAR), np.ones(shape, int), ahead

    def costs(self, leaving: np.ndarray) -> np.ndarray:
        """Least cost from every (position, state), given that of the exits (segment, state)."""
        cost = np.full((int((self.size + 1).sum()), 4), FAR)
        cost[self.base + self.size] = leaving
        order = np.argsort(-self.size, kind="stable")
        sizes = -self.size[order]
        for t in range(int(self.size.max(initial=0)) - 1, -1, -1):
            at = (self.base[order[: np.searchsorted(sizes, -t, side="left")]]) + t
            best = np.full((len(at), 4), FAR)
            for letter, price, step, state in self.arcs(at):
                if letter != 2:
                    best = np.minimum(best, price + np.take_along_axis(cost[at + 1], state, 1))
            for q in (USER, ASSISTANT, START, SYSTEM):  # turns may be put in before the row: user and assistant lead to each other
                other = np.minimum(best[:, NEXT[q]], best[:, NEXT[NEXT[q]]] + INSERT) if q > SYSTEM else best[:, USER]
                best[:, q] = np.minimum(best[:, q], INSERT + other)
            cost[at] = np.minimum(best, FAR)
        return cost

    def matrices(self) -> np.ndarray:
        """Least cost of each segment from each entry state to each exit state."""
        out = np.full((len(self.size), 4, 4), FAR)
        for q in range(4):
            leaving = np.full((len(self.size), 4), FAR)
            leaving[:, q] = 0
            out[:, :, q] = self.costs(leaving)[self.base]
        return out

    def paths(self, leaving: np.ndarray) -> _Paths:
        return _Paths(self, self.costs(leaving))


class _Paths:
    """Least optimal paths from every node (4 x position + state): ranks by doubling, and the pointers of every level."""

    def __init__(self, batch: _Batch, cost: np.ndarray) -> None:
        self.batch, self.cost = batch, cost
        nodes = cost.size
        inner = np.ones(len(cost), bool)
        inner[batch.base + batch.size] = False
        at = np.flatnonzero(inner)
        arcs = []
        for letter, price, step, state in batch.arcs(at):
            target = 4 * (at[:, None] + step) + state
            optimal = (cost[at] < FAR) & (price < FAR) & (price + cost.reshape(-1)[target] == cost[at])
            arcs.append((letter, optimal, target))
        first = np.zeros((len(at), 4), np.int64)
        goes = 4 * at[:, None] + np.arange(4)
        for letter, optimal, target in reversed(arcs):  # the least letter last
            first, goes = np.where(optimal, letter, first), np.where(optimal, target, goes)
        rank, pointer = np.zeros((len(cost), 4), np.int64), np.arange(nodes).reshape(-1, 4)
        rank[at], pointer[at] = first, goes
        rank, pointer, steps = rank.reshape(-1), pointer.reshape(-1), (rank.reshape(-1) > 0).astype(np.int64)
        self.levels = [pointer]
        while (pointer != pointer[pointer]).any():
            rank = np.unique(rank * (nodes + 5) + rank[pointer], return_inverse=True)[1].reshape(-1)
            steps = steps + steps[pointer]
            pointer = pointer[pointer]
            self.levels.append(pointer)
        # the arc of the least audit, by letter and the rank of where it leads
        choice = np.full((len(at), 4), FAR)
        letter_of = np.zeros((len(at), 4), np.int64)
        for letter, optimal, target in arcs:
            value = np.where(optimal, letter * (nodes + 5) + rank[target], FAR)
            letter_of = np.where(value < choice, letter, letter_of)
            choice = np.minimum(choice, value)
        self.letter = np.zeros((len(cost), 4), np.int64)
        self.letter[at] = letter_of
        self.letter, self.steps, self.end = self.letter.reshape(-1), steps, pointer

    def exits(self, entry: np.ndarray) -> np.ndarray:
        """The state in which the least path leaves each segment, entered in ``entry``."""
        return self.end[4 * self.batch.base + entry] % 4

    def read(self, entry: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(segment, letter, node) of every edit of the paths from ``entry``, in order."""
        start = 4 * self.batch.base + entry
        n = self.steps[start]
        segment = np.repeat(np.arange(len(start)), n)
        ahead = np.arange(len(segment)) - np.repeat(np.cumsum(n) - n, n)
        node = start[segment]
        for k, pointer in enumerate(self.levels):
            node = np.where(ahead >> k & 1, pointer[node], node)
        return segment, self.letter[node], node


_INITIAL = {"s": SYSTEM, "u": USER, "a": ASSISTANT}


def _segments(rows: DataFrame) -> DataFrame:
    """Runs of rows of one conversation, at most SEGMENT_ROWS long, in order of ``seq``."""
    order = ["conv_id", "turn", "role", "head", "digest", "id"]
    kind = rows.schema["conv_id"].dataType.simpleString()
    turn_kind = rows.schema["turn"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seq = TaskContext.get().partitionId() << 32
        ready: list[dict] = []
        held = 0
        rest: list[tuple] = []
        chars = 0

        def closed(rest: list[tuple]) -> dict:
            nonlocal seq
            seq += 1
            roles = [r for _, _, r, _, _ in rest]
            turns = [t for _, t, _, _, _ in rest if t is not None]
            pairs = [a[:1] + b[:1] for a, b in zip(roles, roles[1:])]  # noqa: B905
            faults = [f for _, _, _, _, f in rest]
            return {
                "conv_id": rest[0][0], "seq": seq, "roles": roles, "texts": [x for _, _, _, x, _ in rest],
                "initials": bytes(_INITIAL.get(r[:1], START) for r in roles),
                "faults": bytes(_MUST_GO if f in (1, 2) else _UNFINISHED if f else _FINE for f in faults),
                "blank": faults.count(1), "duplicate": faults.count(2), "truncated": faults.count(3),
                "illegal": sum(p not in ("su", "ua", "au") for p in pairs), "first": roles[0][:1], "last": roles[-1][:1],
                "least": min(turns, default=None), "most": max(turns, default=None), "turns": len(set(turns)),
            }

        def emitted(ready: list[dict]) -> pa.RecordBatch:
            found = _Batch.of([s["initials"] for s in ready], [s["faults"] for s in ready]).matrices().reshape(len(ready), 16).tolist()
            return pa.RecordBatch.from_pylist([s | {"costs": c} for s, c in zip(ready, found, strict=True)], schema)

        for batch in batches:
            columns = [batch[c].to_pylist() for c in ("conv_id", "turn", "role", "text", "fault")]
            schema = pa.schema([("conv_id", batch.schema.field("conv_id").type), *_SEGMENT_FIELDS])
            for row in zip(*columns, strict=True):
                if rest and (row[0] != rest[0][0] or len(rest) >= SEGMENT_ROWS or chars >= SEGMENT_CHARS):
                    ready.append(closed(rest))
                    held += chars
                    rest, chars = [], 0
                    if len(ready) >= SOLVED_ROWS >> 3 or held >= SEGMENT_CHARS << 3:
                        yield emitted(ready)
                        ready, held = [], 0
                rest.append(row)
                chars += len(row[3]) + len(row[2])
        if rest:
            ready.append(closed(rest))
        if ready:
            yield emitted(ready)

    schema = f"conv_id {kind}, seq bigint, roles array<string>, texts array<string>, initials binary, faults binary, blank bigint, duplicate bigint, truncated bigint, illegal bigint, first string, last string, least {turn_kind}, most {turn_kind}, turns bigint, costs array<bigint>"
    ordered = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    return mapped(ordered.select("conv_id", "turn", "role", "text", "fault"), run, schema)


_SEGMENT_FIELDS = [
    ("seq", pa.int64()), ("roles", pa.list_(pa.string())), ("texts", pa.list_(pa.string())), ("initials", pa.binary()), ("faults", pa.binary()),
    ("blank", pa.int64()), ("duplicate", pa.int64()), ("truncated", pa.int64()), ("illegal", pa.int64()), ("first", pa.string()), ("last", pa.string()),
    ("least", pa.int64()), ("most", pa.int64()), ("turns", pa.int64()), ("costs", pa.list_(pa.int64())),
]


def _product(left: Column, right: Column) -> Column:
    """Min-plus product of 4 x 4 matrices as flat arrays."""
    return F.array(*[
        F.least(F.lit(FAR), *[F.element_at(left, 4 * i + j + 1) + F.element_at(right, 4 * j + k + 1) for j in range(4)]) for i in range(4) for k in range(4)
    ])


def _scanned(chain: DataFrame, column: str, combine, longest: int, step: int) -> DataFrame:
    """``column`` combined over the places of a conversation from each one to its end (``step`` 1) or start (-1), by doubling.

    ``chain`` has conv, place and the column; each round joins a place with the one twice as far ahead.
    """
    reach = 1
    while reach < longest:
        far = chain.select(F.col("conv").alias("of"), (F.col("place") - step * reach).alias("at"), F.col(column).alias("far"))
        met = chain.join(far, (F.col("conv") == F.col("of")) & (F.col("place") == F.col("at")), "left")
        chain = store.kept(met.select("conv", "place", F.when(F.col("far").isNull(), F.col(column)).otherwise(combine(F.col(column), F.col("far"))).alias(column)), "doubled")
        reach *= 2
    return chain


def _solved(segments: DataFrame) -> DataFrame:
    """Each segment with its entry state and the costs behind it (``entry``, ``leaving``, ``place``, ``segments``)."""
    sizes = segments.groupBy("conv_id").agg(F.count("*").alias("n"), F.min("seq").alias("conv"))
    alone = sizes.where("n = 1").select("conv", "n")
    single = segments.join(alone, segments["seq"] == alone["conv"]).select(
        segments["*"], F.lit(0).cast("bigint").alias("place"), F.lit(1).cast("bigint").alias("n"), F.lit(START).alias("entry"),
        F.array(*[F.lit(int(x)).cast("bigint") for x in ENDING]).alias("leaving"),
    )
    several = sizes.where("n > 1").select(F.col("conv_id").alias("of"), "conv", "n")
    longest = several.agg(F.max("n")).first()[0] or 0
    if not longest:
        return single
    chain = segments.join(several, F.col("conv_id").eqNullSafe(F.col("of"))).select("conv", "seq", "costs", "n")
    chain = store.kept(numbered(chain, ["conv"], ["seq"], "place").withColumn("place", F.col("place") - 1), "chain")
    rest = _scanned(chain.select("conv", "place", "costs"), "costs", _product, longest, 1)
    behind = rest.select("conv", (F.col("place") - 1).alias("place"), "costs")
    ending = [F.lit(int(x)) for x in ENDING]
    leaving = F.array(*[F.least(*[F.element_at("later", 4 * q + k + 1) + ending[k] for k in range(4)]) for q in range(4)])
    plain = F.array(*[x.cast("bigint") for x in ending])
    known = chain.select("conv", "place", "seq", "n").join(behind.withColumnRenamed("costs", "later"), ["conv", "place"], "left")
    known = known.select("conv", "place", "seq", "n", F.when(F.col("later").isNull(), plain).otherwise(leaving).alias("leaving"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            part = _Batch.of(batch["initials"].to_pylist(), batch["faults"].to_pylist())
            paths = part.paths(np.array(batch["leaving"].to_pylist(), np.int64).reshape(-1, 4))
            turns = np.stack([paths.exits(np.full(batch.num_rows, q)) for q in range(4)], axis=1).tolist()
            yield pa.RecordBatch.from_arrays([batch["conv"], batch["place"], pa.array(turns, pa.list_(pa.int64()))], names=["conv", "place", "turns"])

    states = mapped(known.join(segments.select("seq", "initials", "faults"), "seq").select("conv", "place", "initials", "faults", "leaving"), run, "conv bigint, place bigint, turns array<bigint>")
    through = _scanned(store.kept(states, "states"), "turns", lambda here, before: F.transform(before, lambda q: F.element_at(here, (q + 1).cast("int"))), longest, -1)
    entry = through.select("conv", (F.col("place") + 1).alias("place"), F.element_at("turns", START + 1).cast("int").alias("entry"))
    entered = known.join(entry, ["conv", "place"], "left").select("seq", "place", "n", F.coalesce("entry", F.lit(START)).alias("entry"), "leaving")
    return single.unionByName(segments.join(entered, "seq"))


def edits(rows: DataFrame) -> DataFrame:
    """Segments of conversations (columns conv_id, turn, role, text; see ``repaired``) with their part of the audit and their repaired turns.

    conv_id, place (of the segment), n (segments of the conversation), audit, roles, texts (after repair), cost (from the
    segment on), the counts of faults, and what is needed where segments meet (first, last, least, most, turns).
    """
    segments = store.kept(_segments(_faulty(rows)), "segments")
    kind = rows.schema["conv_id"].dataType.simpleString()
    passed = ["conv_id", "place", "n", "blank", "duplicate", "truncated", "illegal", "first", "last", "least", "most", "turns"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            part = _Batch.of(batch["initials"].to_pylist(), batch["faults"].to_pylist())
            entry = batch["entry"].to_numpy().astype(np.int64)
            paths = part.paths(np.array(batch["leaving"].to_pylist(), np.int64).reshape(-1, 4))
            segment, letter, node = paths.read(entry)
            cuts = np.searchsorted(segment, np.arange(batch.num_rows + 1))
            marks = np.frombuffer(_LETTERS, np.uint8)[letter].tobytes().decode()
            row = node // 4 - part.base[segment]
            leads = NEXT[node % 4]
            letter, row, leads = letter.tolist(), row.tolist(), leads.tolist()
            last = (batch["place"].to_numpy() == batch["n"].to_numpy() - 1).tolist()
            ends, sums = paths.exits(entry).tolist(), paths.cost.reshape(-1)[4 * part.base + entry].tolist()
            audits, roles, texts = [], [], []
            old_roles, old_texts = batch["roles"].to_pylist(), batch["texts"].to_pylist()
            for s in range(batch.num_rows):
                role, text = [], []
                for k in range(cuts[s], cuts[s + 1]):
                    if letter[k] == 1:
                        continue
                    role.append(old_roles[s][row[k]] if letter[k] == 3 else "user" if leads[k] == USER else "assistant")
                    text.append("" if letter[k] == 2 else old_texts[s][row[k]])
                audit = marks[cuts[s] : cuts[s + 1]]
                if last[s]:
                    added = {START: [], SYSTEM: ["user", "assistant"], USER: ["assistant"], ASSISTANT: []}[ends[s]]
                    audit += "I" * len(added)
                    role += added
                    text += [""] * len(added)
                audits.append(audit)
                roles.append(role)
                texts.append(text)
            kept = [batch[c] for c in passed]
            lists = pa.list_(pa.string())
            yield pa.RecordBatch.from_arrays(
                [*kept, pa.array(sums, pa.int64()), pa.array(audits, pa.string()), pa.array(roles, lists), pa.array(texts, lists)],
                names=[*passed, "cost", "audit", "roles", "texts"],
            )

    schema = (
        f"conv_id {kind}, place bigint, n bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, first string, last string, "
        "least bigint, most bigint, turns bigint, cost bigint, audit string, roles array<string>, texts array<string>"
    )
    return mapped(_solved(segments).select(*passed, "initials", "faults", "entry", "leaving", "roles", "texts"), run, schema)


def repaired(rows: DataFrame) -> DataFrame:
    """Per conversation that has rows: faults, the least cost, the audit, and the digest of the repaired turns.

    conv_id, gaps (turn numbers missing between the least and the most), blank, duplicate, truncated (rows by first
    fault), illegal (neighbours out of order), cost, audit, repaired_sha256 (of ``role:text`` lines), n_repaired.
    Rows are taken by turn, nulls first, then by role and text, repeated rows count each; a null conv_id is a
    conversation; texts are read whole; role and text should not be null (``damaged`` fills them). Other columns are
    ignored. No rows give no conversations. ``edits`` holds the repaired turns themselves.

    Almost all conversations are one segment. The audit and digest of a longer one are each one value over all its rows in
    order, so its segments pass one task in a stream, of which only the hash state and the audit are held.
    """
    found = store.kept(edits(rows.select("conv_id", F.col("turn").cast("bigint").alias("turn"), "role", "text")), "edits")
    lines = F.array_join(F.zip_with("roles", "texts", lambda r, t: F.concat(r, F.lit(":"), t)), "\n")
    gaps = F.coalesce(F.col("most") - F.col("least") + 1 - F.col("turns"), F.lit(0).cast("bigint"))
    counts = ["blank", "duplicate", "truncated", "illegal", "cost", "audit"]
    single = found.where("n = 1").select("conv_id", gaps.alias("gaps"), *counts, F.sha2(lines, 256).alias("repaired_sha256"), F.size("roles").cast("bigint").alias("n_repaired"))
    kind = rows.schema["conv_id"].dataType.simpleString()
    schema = f"conv_id {kind}, gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string, repaired_sha256 string, n_repaired bigint"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = None

        def row(now: dict, kind: pa.DataType) -> pa.RecordBatch:
            gaps = now["most"] - now["least"] + 1 - now["turns"] if now["turns"] else 0
            values = [now["conv"], gaps, *[now[c] for c in counts[:5]], "".join(now["audit"]), now["hash"].hexdigest(), now["size"]]
            kinds = [kind, *[pa.int64()] * 6, pa.string(), pa.string(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds, strict=True)], names=["conv_id", "gaps", *counts, "repaired_sha256", "n_repaired"])

        for batch in batches:
            kind = batch.schema.field("conv_id").type
            for s in batch.to_pylist():
                if s["place"] == 0:
                    if now:
                        yield row(now, kind)
                    now = {"conv": s["conv_id"], "turns": 0, "least": None, "most": None, "audit": [], "hash": hashlib.sha256(), "size": 0, "last": None, "cost": s["cost"]}
                    now |= dict.fromkeys(counts[:4], 0)
                for c in counts[:4]:
                    now[c] += s[c]
                if now["last"] is not None and now["last"] + s["first"] not in ("su", "ua", "au"):
                    now["illegal"] += 1
                now["last"] = s["last"]
                if s["turns"]:
                    now["turns"] += s["turns"] - (now["most"] == s["least"])
                    now["least"], now["most"] = s["least"] if now["least"] is None else now["least"], s["most"]
                now["audit"].append(s["audit"])
                for r, t in zip(s["roles"], s["texts"], strict=True):
                    now["hash"].update((("\n" if now["size"] else "") + r + ":" + t).encode())
                    now["size"] += 1
        if now:
            yield row(now, kind)

    several = found.where("n > 1").repartition("conv_id").sortWithinPartitions("conv_id", "place")
    return single.unionByName(mapped(several, run, schema))
