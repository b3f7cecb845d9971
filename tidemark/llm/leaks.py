"""Secrets in texts: known forms, and candidate strings whose sliding windows have the entropy of a random key.

Known forms (``assign``, ``access``, ``hex``) are patterns. Beside them every run of characters of one alphabet
(a character class: hexadecimal digits, or letters and digits with ``+/=_-``) that is at least a window long is a
candidate. A window of fixed length slides over it; the Shannon entropy of its characters follows from counts of
which each step changes two, so a candidate costs time linear in its length. Windows at or above the threshold of
their class that mix letters and digits are joined to spans, unless an allow-list explains the candidate.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_right
from collections.abc import Iterator, Sequence
from itertools import accumulate
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.batches import mapped

# The known forms; in ``assign`` letters match in either ASCII case.
KNOWN = ("assign", "access", "hex")
_ASSIGN = re.compile(r"""(?ai:(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+))""")
_ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
_HEX = re.compile(r"[0-9a-f]{24,}")
_WORDS = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")
LEAST_VALUE = 6

UNIT = 1 << 32  # entropies are summed in units of 2**-32 bits, so that steps add up exactly
BEFORE = 32  # characters before a candidate that an allow-list pattern may look at


class CharacterClass(NamedTuple):
    name: str
    characters: str  # the inside of a pattern's brackets
    window: int
    bits: float  # least entropy a character of a window, in bits


# A random window of 32 hexadecimal digits has 3.65 bits on average, one of 24 of 64 characters 4.2; words stay below 3.8.
CLASSES = (CharacterClass("random_hex", "0-9A-Fa-f", 32, 3.2), CharacterClass("random", "A-Za-z0-9+/=_-", 24, 3.95))
# What looks random and is no secret: matched against up to BEFORE characters and the candidate, which is what \Z ends.
ALLOWED = (
    r"[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}\Z",  # identifiers of standard form
    r"(?i)(?:sha(?:1|224|256|384|512)|md5|commit|digest|checksum)[ :=-]{1,3}[0-9A-Za-z+/=]+\Z",  # published digests
    r"(?i)example|placeholder|changeme|0123456789|abcdefghijkl",  # stand-ins and alphabets
    r"(?i)(?:https?:/|www\.)\S*\Z",  # addresses
)


def _table(window: int) -> list[int]:
    return [0] + [round(c * math.log2(c) * UNIT) for c in range(1, window + 2)]  # one more while a character comes in


def entropy_spans(text: str, kind: CharacterClass) -> Iterator[tuple[int, int]]:
    """Spans of ``text``, one run of the class, that windows of at least its entropy cover; windows count if they mix letters and digits."""
    w, table = kind.window, _table(kind.window)
    most = round((math.log2(w) - kind.bits) * w * UNIT)  # H >= bits exactly if sum c log c <= w (log w - bits)
    counts: dict[str, int] = {}
    total = letters = digits = 0
    begin = end = -1
    for k, c in enumerate(text):
        n = counts.get(c, 0)
        counts[c] = n + 1
        total += table[n + 1] - table[n]
        letters += c.isalpha()
        digits += c.isdigit()
        if k >= w:
            gone = text[k - w]
            n = counts[gone]
            counts[gone] = n - 1
            total -= table[n] - table[n - 1]
            letters -= gone.isalpha()
            digits -= gone.isdigit()
        if k >= w - 1 and letters and digits and total <= most:
            if k - w + 1 > end >= 0:
                yield begin, end
                begin = -1
            if begin < 0:
                begin = k - w + 1
            end = k + 1
    if begin >= 0:
        yield begin, end


def known_spans(text: str) -> list[tuple[int, str, int]]:
    """(start, kind, end) of the known forms, each kind leftmost without overlap, by start and then kind."""
    found = []
    low = text.encode("utf-8", "surrogatepass").lower()
    if any(word in low for word in _WORDS):
        found += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= LEAST_VALUE]
    if b"akia" in low:
        found += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text)]
    found += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    return [(s, KNOWN[k], e) for s, k, e in sorted(found)]


def random_spans(text: str, known: Sequence[tuple[int, str, int]], classes: Sequence, allowed: Sequence[re.Pattern], values: frozenset[str]) -> list[tuple[int, str, int]]:
    """(start, kind, end) of the spans that entropy adds to the known ones: none within a known one, none that is allowed."""
    found = []
    begins, reach = [a for a, _, _ in known], list(accumulate((b for _, _, b in known), max))
    for kind, pattern in classes:
        for m in pattern.finditer(text):
            start, run = m.start(), m.group()
            if run in values or any(p.search(text, max(0, start - BEFORE), m.end()) for p in allowed):
                continue
            for s, e in entropy_spans(run, kind):
                before = bisect_right(begins, start + s)
                if not before or reach[before - 1] < start + e:
                    found.append((start + s, kind.name, start + e))
    return sorted(found)


def find(
    docs: DataFrame, *, key: str = "doc_id", text: str = "text", keep: Sequence[str] = (), classes: Sequence[CharacterClass] = CLASSES,
    allowed: Sequence[str] = ALLOWED, allowed_values: Sequence[str] = (),
) -> DataFrame:
    """(key, keep..., spans): per row an array of (kind, start, end) in code points, end exclusive, by start, then kind.

    Known forms are never suppressed; ``allowed`` (patterns) and ``allowed_values`` (whole candidates) hold back only
    what entropy adds. Rows are independent: there is no shuffle, repeated rows and null keys each keep their row, a
    null or empty text has no spans, an empty table gives an empty one, and other columns, whatever their names, are
    ignored unless kept. Texts are read whole; a text of any length takes time linear in it and little memory beside it.
    """
    spec = [(c, re.compile(f"[{c.characters}]{{{c.window},}}")) for c in classes]
    patterns, values = [re.compile(p) for p in allowed], frozenset(allowed_values)
    row = F.struct(F.col(key).alias("key"), *[F.col(c).alias(f"k{i}") for i, c in enumerate(keep)])
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for t in batch["text"]:
                t = t.as_py() or ""
                known = known_spans(t)
                both = known + random_spans(t, known, spec, patterns, values)
                both.sort(key=lambda s: s[0])  # stable: known before random at one start
                out.append([{"kind": k, "start": s, "end": e} for s, k, e in both])
            yield pa.RecordBatch.from_arrays([batch["row"], pa.array(out, kind)], names=["row", "spans"])

    held = docs.select(row.alias("row"), F.col(text).alias("text"))
    found = mapped(held, run, f"row {held.schema['row'].dataType.simpleString()}, spans array<struct<kind:string,start:bigint,end:bigint>>")
    return found.select(F.col("row.key").alias(key), *[F.col(f"row.k{i}").alias(c) for i, c in enumerate(keep)], "spans")


def joined(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
