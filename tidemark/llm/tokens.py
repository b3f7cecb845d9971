"""Token ids of whole texts by the tokenizers library, each distinct pre-token encoded once per worker.

A byte pair encoding never merges across pre-tokens. For texts whose characters all lie below U+0250 and that
hold no apostrophe, pre-tokens are cut here with numpy for a whole batch, and the library encodes only those
not met before; every other text goes to the library whole. Ids are the library's in both cases.
"""

from __future__ import annotations

import unicodedata
from itertools import chain

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer
from tokenizers.pre_tokenizers import ByteLevel

BYTE_BPE = "byte_bpe_50k.json"
WORD_BPE = "word_bpe_49k.json"
PIECE_CHARS = 1 << 18
MOST_HELD = 1 << 20  # pre-tokens, at 36 bytes and 4 for each id: some 48 MB, all in plain arrays
_SIMPLE = 0x250
_SPACES = [*range(9, 14), 32, 0x85, 0xA0]
_LETTER, _NUMBER, _OTHER, _SPACE = range(4)
_CLASS = np.array([_SPACE if c in _SPACES else {"L": _LETTER, "N": _NUMBER}.get(unicodedata.category(chr(c))[0], _OTHER) for c in range(_SIMPLE)], np.uint8)
_SHOWN = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that byte-level tokens show as themselves; others follow U+0100
_ALPHABET = np.array([b if b in _SHOWN else 256 + b - sum(x < b for x in _SHOWN) for b in range(256)], np.uint32)
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)


class Encoder:
    """``style``: 'bytes' for byte-level pre-tokens with their leading space, 'words' for lower-case ones without."""

    def __init__(self, path: str, style: str) -> None:
        self.library, self.words = Tokenizer.from_file(path), style == "words"
        self.library.encode_special_tokens = False
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        # a pre-token's bytes as the model knows them, if nothing but byte-level cutting comes before it
        plain = self.library.normalizer is None and isinstance(self.library.pre_tokenizer, ByteLevel) and not self.library.pre_tokenizer.add_prefix_space
        self.model = self.library.model if plain and not self.words else None
        self.forget()

    def forget(self) -> None:
        self.known, self.slot_of = np.zeros(1 << 16, np.uint64), np.full(1 << 16, -1, np.int32)  # open addressing: hashes, and their slots
        self.flat = np.zeros(1 << 16, np.uint32)
        self.begin, self.count = np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int32)
        self.again = np.zeros(1 << 14, bool)  # met since they were learned or last kept
        self.held = self.filled = 0

    def _spare(self) -> None:
        """Forgets the pre-tokens not met again lately, or all if those are few."""
        keep = np.flatnonzero(self.again[: self.held])
        slot_of = np.full(self.held, -1, np.int64)
        slot_of[keep] = np.arange(len(keep))
        flat, begin, count, at = self.flat, self.begin[keep], self.count[keep], np.flatnonzero(self.slot_of >= 0)
        hashes, slots = self.known[at], slot_of[self.slot_of[at]]
        self.forget()
        if len(keep) > MOST_HELD // 4 * 3:
            return
        ends = np.cumsum(count.astype(np.int64))
        self._reserve(len(keep), int(ends[-1]) if len(keep) else 0)
        self.flat[: self.filled] = flat[np.repeat(begin - (ends - count), count) + np.arange(self.filled)]
        self.begin[: self.held], self.count[: self.held] = ends - count, count
        self._place(hashes[slots >= 0], slots[slots >= 0].astype(np.int32))

    def _reserve(self, held: int, filled: int) -> None:
        """Room for so many pre-tokens and ids, which count as held from now on."""
        while filled > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        while held > len(self.begin):
            self.begin, self.count, self.again = (np.concatenate([x, np.zeros_like(x)]) for x in (self.begin, self.count, self.again))
        while 2 * held > len(self.known):
            old = np.flatnonzero(self.slot_of >= 0)
            hashes, slots = self.known[old], self.slot_of[old]
            self.known, self.slot_of = np.zeros(2 * len(self.known), np.uint64), np.full(2 * len(self.known), -1, np.int32)
            self._place(hashes, slots)
        self.held, self.filled = held, filled

    def _home(self, hashes: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return ((hashes * np.uint64(_BASE)) >> np.uint64(65 - len(self.known).bit_length())).astype(np.int64)

    def _find(self, hashes: np.ndarray) -> np.ndarray:
        """The slot of each hash, -1 if it is not held."""
        at = self._home(hashes)
        out = self.slot_of[at].astype(np.int64)
        todo = np.flatnonzero((self.known[at] != hashes) & (out >= 0))
        at, mask = at[todo], len(self.known) - 1
        while len(todo):
            at = (at + 1) & mask
            out[todo] = self.slot_of[at]
            on = (self.known[at] != hashes[todo]) & (out[todo] >= 0)
            todo, at = todo[on], at[on]
        return out

    def _place(self, hashes: np.ndarray, slots: np.ndarray) -> None:
        at, mask = self._home(hashes), len(self.known) - 1
        while len(at):
            free = self.slot_of[at] < 0
            self.slot_of[at[free]], self.known[at[free]] = slots[free], hashes[free]
            lost = self.slot_of[at] != slots
            at, hashes, slots = (at[lost] + 1) & mask, hashes[lost], slots[lost]

    def _encoded(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of pre-tokens on end, and how many each has.

        Byte-level pre-tokens go to the library's model as they are: each is one pre-token, so nothing is left to cut.
        """
        if self.model is not None and not any(t[0].isspace() and (t[0] != " " or t[1:2].strip() == "") for t in texts):
            raw = np.frombuffer("\n".join(texts).encode(), np.uint8)
            words = _ALPHABET[raw].tobytes().decode("utf-32-le").split(chr(_ALPHABET[10]))
            if len(words) == len(texts):
                each = [[t.id for t in self.model.tokenize(w)] for w in words]
                return np.fromiter(chain.from_iterable(each), np.int64), np.fromiter(map(len, each), np.int64, len(each))
        each = [e.ids for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]
        return np.array([i for ids in each for i in ids], np.int64), np.array([len(ids) for ids in each], np.int64)

    def _learn(self, hashes: np.ndarray, texts: list[str]) -> None:
        blank = np.array([t.isspace() for t in texts])  # encoded by themselves
        for chosen in (np.flatnonzero(blank), np.flatnonzero(~blank)):
            if not len(chosen):
                continue
            ids, count = self._encoded([texts[k] for k in chosen.tolist()])
            held, filled = self.held, self.filled
            self._reserve(held + len(chosen), filled + len(ids))
            self.flat[filled : self.filled] = ids
            self.begin[held : self.held], self.count[held : self.held] = filled + np.cumsum(count) - count, count
            self._place(hashes[chosen], np.arange(held, self.held, dtype=np.int32))

    def _cut(self, texts: list[str]) -> tuple[str, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The joined texts, and start, end, hash and text number of each pre-token."""
        joined = "".join(texts)
        code = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        n = len(code)
        edges = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
        kind = _CLASS[code]
        begin = np.ones(n + 1, bool)
        begin[1:n] = kind[1:] != kind[:-1]
        begin[edges] = True
        if self.words:
            begin[:n] |= kind == _NUMBER
            start = np.flatnonzero(begin[:n] & (kind != _SPACE))
            # a token ends where the next run begins
            at = np.flatnonzero(begin)
            end = at[np.searchsorted(at, start, side="right")]
        else:
            inner = np.ones(n + 1, bool)
            inner[edges] = False  # positions that continue a text
            spot = np.flatnonzero(inner[1:n] & (kind[:-1] == _SPACE) & (kind[1:] != _SPACE)) + 1
            begin[spot - 1] = True  # the last space of a run stands alone or joins what follows
            begin[spot] = code[spot - 1] != 32
            start = np.flatnonzero(begin[:n])
            end = np.concatenate([start[1:], [n]])
        with np.errstate(over="ignore"):
            power = np.full(n + 1, _BASE, np.uint64)
            power[0] = 1
            np.multiply.accumulate(power, out=power)
            total = np.zeros(n + 1, np.uint64)
            np.cumsum((code + np.uint32(1)).astype(np.uint64) * power[:n], out=total[1:])
            inverse = np.full(n + 1, _INVERSE, np.uint64)
            inverse[0] = 1
            np.multiply.accumulate(inverse, out=inverse)
            h = (total[end] - total[start]) * inverse[start] + (end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
        return joined, start, end, h, np.searchsorted(edges, start, side="right") - 1

    def _slots(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Slot and text number of each pre-token, in order."""
        joined, start, end, h, owner = self._cut(texts)
        slots = self._find(h)
        new = np.flatnonzero(slots < 0)
        self.again[slots if not len(new) else slots[slots >= 0]] = True
        if len(new):
            distinct, first = np.unique(h[new], return_index=True)
            if self.held and self.held + len(distinct) > MOST_HELD:
                self._spare()
                slots = self._find(h)
                new = np.flatnonzero(slots < 0)
                distinct, first = np.unique(h[new], return_index=True)
            at = new[first]
            self._learn(distinct, [joined[a:b] for a, b in zip(start[at].tolist(), end[at].tolist(), strict=True)])
            slots[new] = self._find(h[new])
        return slots, owner

    def _plain(self, text: str) -> bool:
        if "'" in text or any(s in text for s in self.special):
            return False
        return text.isascii() or bool(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).max() < _SIMPLE)

    def _parts(self, texts: list[str | None]):
        """Groups of (row, text) to cut here, and of those for the library."""
        group, size = [], 0
        for row, text in enumerate(texts):
            text = text or ""
            ready = text.lower() if self.words else text
            if not self._plain(ready):
                yield None, (row, text)
                continue
            group.append((row, ready))
            size += len(ready)
            if size >= PIECE_CHARS:
                yield group, None
                group, size = [], 0
        if group:
            yield group, None

    def lengths(self, texts: list[str | None]) -> np.ndarray:
        """Ids in each text; null is empty."""
        out = np.zeros(len(texts), np.int64)
        for group, single in self._parts(texts):
            if single:
                out[single[0]] = len(self.library.encode(single[1], add_special_tokens=False).ids)
                continue
            slots, owner = self._slots([t for _, t in group])
            out[[r for r, _ in group]] = np.bincount(owner, self.count[slots], len(group)).astype(np.int64)
        return out

    def ids(self, texts: list[str | None]) -> list[np.ndarray]:
        """The ids of each text as unsigned 32-bit integers; null is empty."""
        out: list[np.ndarray] = [np.zeros(0, np.uint32)] * len(texts)
        for group, single in self._parts(texts):
            if single:
                out[single[0]] = np.asarray(self.library.encode(single[1], add_special_tokens=False).ids, np.uint32)
                continue
            slots, owner = self._slots([t for _, t in group])
            n = self.count[slots].astype(np.int64)
            ends = np.cumsum(n)
            flat = self.flat[np.repeat(self.begin[slots] - (ends - n), n) + np.arange(ends[-1] if len(ends) else 0)]
            per = np.cumsum(np.bincount(owner, n, len(group)).astype(np.int64))
            for (row, _), part in zip(group, np.split(flat, per[:-1]), strict=True):
                out[row] = part
        return out


_HELD: dict[tuple[str, str], Encoder] = {}


def encoder(name: str) -> Encoder:
    """The worker's encoder for a vocabulary file of public_tokenizers (or a path to one in the same format)."""
    style = "words" if "word_bpe" in name else "bytes"
    key = (name, style)
    if key not in _HELD:
        _HELD[key] = Encoder(name if "/" in name else public_tokenizers.path(name), style)
    return _HELD[key]
