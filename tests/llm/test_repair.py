import hashlib
import heapq
import random
import re
import zlib
from collections import defaultdict

from pyspark.sql import functions as F

from tidemark.llm import catalog, repair

SF = "/root/testdata/sf0.01"
FIELDS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def cheapest(rows, faults):
    """Least (cost, audit) by a search over whole strings: states are what the initials so far allow."""
    queue = [(0, "", 0, "", ())]
    done = set()
    while queue:
        cost, audit, i, seen, turns = heapq.heappop(queue)
        tail = seen[:1] if len(seen) == 1 else seen[:1] + seen[-1:]  # all that the form asks for later
        if (i, tail) in done:
            continue
        done.add((i, tail))
        if i == len(rows) and re.fullmatch("(s?(ua)+)?", seen):
            return cost, audit, turns

        def grow(price, letter, step, turn, seen=seen, cost=cost, audit=audit, i=i, turns=turns):
            new = seen + (turn[0][:1] if turn else "")
            if turn is None or (turn[0] and re.fullmatch("s?(ua)*u?", new)):
                heapq.heappush(queue, (cost + price, audit + letter, i + step, new, turns + ((turn,) if turn else ())))

        for role in ("user", "assistant"):
            grow(3, "I", 0, (role, ""))
        if i < len(rows):
            role, text = rows[i]
            grow(4, "D", 1, None)
            if faults[i] not in ("blank", "duplicate"):
                extra = 3 if faults[i] else 0
                grow(extra, "K", 1, (role, text))
                for other in ("user", "assistant"):
                    grow(3 + extra, "R", 1, (other, text))


def brute(rows):
    """The contract for rows (turn, role, text) of one conversation, in order."""
    faults, seen = [], set()
    for _, role, text in rows:
        bare = re.sub(r"[\x20\x09-\x0D]", "", text)
        faults.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
        seen.add((role, text))
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))  # noqa: B905
    cost, audit, kept = cheapest([(r, t) for _, r, t in rows], faults)
    digest = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in kept).encode()).hexdigest()
    return gaps, faults.count("blank"), faults.count("duplicate"), faults.count("truncated"), illegal, cost, audit, digest


def ordered(rows):
    return sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))


def damage(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        how = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if how == 0:
            continue
        text = "" if how == 1 else re.sub("[.!?]", "", text) if how == 2 else text
        out += [(conv, turn, "user" if how == 4 else role, text)] * (2 if how == 3 else 1)
    return out


def by_conversation(rows):
    out = defaultdict(list)
    for conv, *row in rows:
        out[conv].append(tuple(row))
    return {c: ordered(r) for c, r in out.items()}


def test_whole_table_equals_brute_force(spark):
    table = spark.read.parquet(f"{SF}/conversations.parquet").collect()
    want = by_conversation(damage([(r.conv_id, r.turn, r.role, r.text) for r in table]))
    got = catalog.op13_repair(spark, SF).collect()
    assert len(got) == len({r.conv_id for r in table})
    empty = (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    for r in got:
        assert tuple(r[f] for f in FIELDS) == (brute(want[r.conv_id]) if r.conv_id in want else empty)
    assert len({r.audit for r in got}) > 10


def drawn(seed, n, convs):
    rng = random.Random(seed)
    texts = ["Yes.", "No", "Why?", "", " \t", "Go on!", "so.\n", "x", "end. y", " "]
    roles = ["user", "assistant", "system", "user", "assistant", "tool", "", "usher"]
    return [(rng.choice(convs), rng.choice([None, *range(12)]), rng.choice(roles), rng.choice(texts)) for _ in range(n)]


def check(spark, rows):
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(5).withColumn("id", F.lit("clash")).withColumn("digest", F.lit(0))
    got = {r.conv_id: tuple(r[f] for f in FIELDS) for r in repair.repaired(frame).collect()}
    want = by_conversation(rows)
    assert got.keys() == want.keys()
    for conv, found in got.items():
        assert found == brute(want[conv]), want[conv]


def test_drawn_conversations(spark):
    check(spark, drawn(1, 900, [None, *range(150)]))


def test_conversation_over_many_segments(spark, monkeypatch):
    monkeypatch.setattr(repair, "SEGMENT_ROWS", 3)
    check(spark, drawn(2, 260, [None, None, 1, 1, 1, *range(2, 30)]) + [(99, 1, "user", "Same.")] * 25)


def test_no_rows_and_all_dropped(spark, tmp_path):
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert repair.repaired(empty).count() == 0
    gone = [(c, t) for c in range(40) for t in range(3) if zlib.crc32(f"{c}:{t}".encode()) % 20 == 0]
    assert gone
    rows = [(c, t, None, None) for c, t in gone] + [(None, None, "user", "Hi."), (500, 1, "user", None)]
    spark.createDataFrame(rows, empty.schema).write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r.conv_id: r for r in catalog.op13_repair(spark, str(tmp_path)).collect()}
    want = by_conversation(damage(rows))
    for conv in {c for c, *_ in rows}:
        expected = brute(want[conv]) if conv in want else (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
        assert tuple(got[conv][f] for f in FIELDS) == expected


def test_repaired_turns(spark):
    rows = [(1, 0, "assistant", "Hi."), (1, 1, "user", "Ask?"), (1, 2, "user", "Again?")]
    out = repair.edits(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).first()
    assert (out.audit, out.cost) == (brute([r[1:] for r in rows])[6], brute([r[1:] for r in rows])[5])
    assert len(out.roles) == len(out.texts) and [r[0] for r in out.roles] == ["u", "a"] * (len(out.roles) // 2)
