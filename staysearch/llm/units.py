"""Encodes blocks of texts through their distinct units.

A unit begins at a text's start, where white space (0x20 or 0x09-0x0D) follows anything else, at a
full stop or comma after an ASCII or Latin-1 letter, and at a CJK full stop or comma after a CJK
letter. Pre-tokenizers that attach one leading space to a word, and those that drop white space,
always have a token boundary there, so texts can be encoded unit by unit. Units repeat a lot:
each distinct one is encoded once and kept in a cache of the process, found by its 64-bit
fingerprint and compared byte by byte. The cache is bounded in bytes.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

from staysearch.llm.textbytes import Fingerprints, owners

CACHE_BYTES = 72 << 20


ASCII_LETTER = np.zeros(256, bool)
ASCII_LETTER[[*range(65, 91), *range(97, 123)]] = True


def letters(data: np.ndarray) -> np.ndarray:
    """Marks the bytes of ASCII and Latin-1 letters."""
    found = ASCII_LETTER[data]
    # Second bytes 0x97 and 0xB7 after 0xC3 are the signs of multiplication and division.
    second = np.zeros(len(data), bool)
    second[1:] = (data[:-1] == 0xC3) & (data[1:] != 0x97) & (data[1:] != 0xB7)
    found |= second
    found[:-1] |= second[1:]
    return found


def _before(data: np.ndarray, k: int) -> np.ndarray:
    """For each position, the byte ``k`` before it; 0 where there is none."""
    out = np.zeros(len(data), np.uint8)
    out[k:] = data[: len(data) - k]
    return out


def unit_starts(offsets: np.ndarray, data: np.ndarray) -> np.ndarray:
    n = len(data)
    start = np.zeros(n + 1, bool)
    if n > 1:
        one, two, three = (_before(data, k) for k in (1, 2, 3))
        # Unicode's other white space joins that which follows it, as do control characters here;
        # with U+2000 to U+203F left out as a whole.
        wide = (one >= 0x80) & ~(
            ((two == 0xC2) & ((one == 0x85) | (one == 0xA0)))
            | ((three == 0xE1) & (two == 0x9A) & (one == 0x80))
            | ((three == 0xE2) & ((two == 0x80) | (two == 0x81)))
            | ((three == 0xE3) & (two == 0x80) & (one == 0x80))
        )
        white = (data == 0x20) | ((data >= 0x09) & (data <= 0x0D))
        start[:n] = white & (((one > 0x20) & (one < 0x7F)) | wide)
        letter = np.zeros(n, bool)
        letter[1:] = letters(data)[:-1]
        start[:n] |= ((data == 0x2E) | (data == 0x2C)) & letter
        inner = ((one & 0xC0) == 0x80) & ((two & 0xC0) == 0x80)
        cjk = inner & (three >= 0xE4) & (three <= 0xE9) & ~((three == 0xE4) & (two == 0xB7)) & ~((three == 0xE9) & (two == 0xBF))
        stop = np.zeros(n, bool)
        if n > 2:
            stop[:-2] = ((data[:-2] == 0xE3) & (data[1:-1] == 0x80) & ((data[2:] == 0x81) | (data[2:] == 0x82))) | (
                (data[:-2] == 0xEF) & (data[1:-1] == 0xBC) & (data[2:] == 0x8C)
            )
        start[:n] |= stop & cjk
    start[offsets] = True
    return np.flatnonzero(start[:n])


def gathered(flat: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The concatenation of ``flat[start : start + length]`` for all spans."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    index = np.arange(total) + np.repeat(starts - (ends - lengths), lengths)
    return flat[index]


class Spans:
    """A growing sequence of number lists in one flat array."""

    def __init__(self, dtype=np.int32):
        self.flat, self.used = np.zeros(1 << 16, dtype), 0
        self.starts, self.lengths, self.count = np.zeros(1 << 12, np.int64), np.zeros(1 << 12, np.int64), 0

    def append(self, flat: np.ndarray, lengths: np.ndarray) -> None:
        while self.used + len(flat) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        while self.count + len(lengths) > len(self.lengths):
            self.starts = np.concatenate([self.starts, np.zeros_like(self.starts)])
            self.lengths = np.concatenate([self.lengths, np.zeros_like(self.lengths)])
        at = slice(self.count, self.count + len(lengths))
        self.flat[self.used : self.used + len(flat)] = flat
        self.lengths[at] = lengths
        self.starts[at] = self.used + np.cumsum(lengths) - lengths
        self.used += len(flat)
        self.count += len(lengths)

    @property
    def bytes(self) -> int:
        return self.used * self.flat.itemsize + self.count * 16

    def take(self, slots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        lengths = self.lengths[slots]
        return gathered(self.flat, self.starts[slots], lengths), lengths


class UnitEncoder:
    """``encode`` maps units (UTF-8) to a flat id array and the number of ids of each."""

    def __init__(
        self, encode: Callable[[list[bytes]], tuple[np.ndarray, np.ndarray]], limit: int = CACHE_BYTES
    ):
        self.encode, self.limit = encode, limit
        self._clear()

    def _clear(self) -> None:
        self.prints, self.slots = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.spans, self.texts = Spans(), Spans(np.uint8)

    def _units(self, offsets: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Cache slot of every unit of the block, and where the units start."""
        if self.spans.bytes + self.texts.bytes + 16 * len(self.prints) > self.limit:
            self._clear()
        starts = unit_starts(offsets, data)
        sizes = np.diff(np.append(starts, len(data)))
        prints, first, inverse = np.unique(
            Fingerprints(data).spans(starts, starts + sizes), return_index=True, return_inverse=True
        )
        # The units lie side by side, so their bytes are the block.
        same = np.array_equal(sizes[first][inverse], sizes)
        if not same or not np.array_equal(gathered(data, starts[first][inverse], sizes), data):
            return self._one_by_one(data, starts, sizes), starts
        at = np.searchsorted(self.prints, prints)
        near = np.minimum(at, max(len(self.prints) - 1, 0))
        known = self.prints[near] == prints if len(self.prints) else np.zeros(len(prints), bool)
        slots = np.full(len(prints), -1, np.int64)
        slots[known] = self.slots[near[known]]
        kept, lengths = self.texts.take(slots[known])
        here = first[known]
        same = np.array_equal(lengths, sizes[here])
        if not same or not np.array_equal(kept, gathered(data, starts[here], sizes[here])):
            return self._one_by_one(data, starts, sizes), starts
        new = np.flatnonzero(~known)
        if len(new):
            slots[new] = self._encoded(data, starts[first[new]], sizes[first[new]])
            self.prints = np.insert(self.prints, at[new], prints[new])
            self.slots = np.insert(self.slots, at[new], slots[new])
        return slots[inverse], starts

    def _encoded(self, data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """New slots of units, which are encoded and stored."""
        raw = data.tobytes()
        flat, lengths = self.encode([raw[a : a + n] for a, n in zip(starts.tolist(), sizes.tolist(), strict=True)])
        slots = np.arange(self.spans.count, self.spans.count + len(starts))
        self.spans.append(flat, lengths)
        self.texts.append(gathered(data, starts, sizes), sizes)
        return slots

    def _one_by_one(self, data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Slots without the cache, for a block in which different units share a fingerprint."""
        raw, distinct = data.tobytes(), {}
        which = np.array(
            [distinct.setdefault(raw[a : a + n], len(distinct)) for a, n in zip(starts.tolist(), sizes.tolist(), strict=True)]
        )
        first = np.unique(which, return_index=True)[1]
        return self._encoded(data, starts[first], sizes[first])[which]

    def block(self, offsets: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the block, and the number of ids of each text."""
        n = len(offsets) - 1
        if len(data) == 0:
            return np.zeros(0, np.int32), np.zeros(n, np.int64)
        slots, starts = self._units(offsets, data)
        ids, lengths = self.spans.take(slots)
        return ids, np.bincount(owners(offsets, starts), weights=lengths, minlength=n).astype(np.int64)

    def counts(self, offsets: np.ndarray, data: np.ndarray) -> np.ndarray:
        """The number of ids of each text."""
        n = len(offsets) - 1
        if len(data) == 0:
            return np.zeros(n, np.int64)
        slots, starts = self._units(offsets, data)
        lengths = self.spans.lengths[slots]
        return np.bincount(owners(offsets, starts), weights=lengths, minlength=n).astype(np.int64)
