"""Byte-level BPE encoding and decoding by batched numpy merge rounds.

The symbols of many words lie in one flat array. A round looks all neighbouring pairs up by
binary search over the sorted pair keys, takes the lowest rank of each word, and merges all
its occurrences from the left; finished words leave the array. Merging a pair can only create
pairs of higher rank, so a round may merge every occurrence at once.

Nulls and empty texts have no ids. A special token's string in a text becomes its id, as the
tokenizers library does by default. Decoding joins the tokens' bytes; bytes that are not
UTF-8 become U+FFFD. A task's memory is a multiple of its block: 256 KB or the longest text.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from staysearch.llm.common import freeing, id_text, text_blocks
from staysearch.llm.units import UnitEncoder, gathered, letters

# Fixed: the pre-tokenizer pattern of the byte-level vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
NONE = np.iinfo(np.int64).max
SHIFT = 20


def byte_letters() -> list[str]:
    """The letter that stands for each byte in the vocabulary's token strings."""
    visible = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(visible)]
    letters = {b: chr(b) for b in visible} | {b: chr(256 + i) for i, b in enumerate(rest)}
    return [letters[b] for b in range(256)]


def plain_words(units: list[bytes]) -> np.ndarray:
    """Which units are ASCII and Latin-1 letters only, after one space at most."""
    data = np.frombuffer(b"".join(units), np.uint8)
    ends = np.cumsum([len(u) for u in units])
    starts = np.append(0, ends[:-1])
    other = ~letters(data)
    other[starts] &= data[starts] != 0x20
    some = ends - starts > (data[starts] == 0x20)
    return some & (np.diff(np.append(0, np.cumsum(other))[np.append(0, ends)]) == 0)


class BytePairs:
    """Vocabulary and merges of one tokenizer file (its JSON text)."""

    def __init__(self, definition: str):
        file = json.loads(definition)
        vocab: dict[str, int] = file["model"]["vocab"]
        special = {t["content"]: t["id"] for t in file.get("added_tokens", [])}
        letters = byte_letters()
        self.first = np.array([vocab[x] for x in letters], np.int64)
        pairs = [m.split(" ") if isinstance(m, str) else m for m in file["model"]["merges"]]
        keys = np.array([vocab[a] << SHIFT | vocab[b] for a, b in pairs], np.int64)
        merged = np.array([vocab[a + b] for a, b in pairs], np.int64)
        order = np.argsort(keys)
        self.keys, self.ranks, self.merged = keys[order], order.astype(np.int64), merged[order]
        self.special = special
        self.splits = re.compile("(" + "|".join(map(re.escape, sorted(special, key=len, reverse=True))) + ")") if special else None
        byte = {x: b for b, x in enumerate(letters)}
        size = max([*vocab.values(), *special.values()]) + 1
        tokens = [b""] * size
        for token, i in vocab.items():
            tokens[i] = bytes(byte[x] for x in token) if all(x in byte for x in token) else token.encode()
        for token, i in special.items():
            tokens[i] = token.encode()
        self.token_lengths = np.array([len(t) for t in tokens], np.int64)
        self.token_starts = np.cumsum(self.token_lengths) - self.token_lengths
        self.token_bytes = np.frombuffer(b"".join(tokens), np.uint8)
        self.pattern = regex.compile(PATTERN)

    def merge(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids of the words and the number of each; words are not empty."""
        lengths = np.array([len(w) for w in words], np.int64)
        symbols = self.first[np.frombuffer(b"".join(words), np.uint8)]
        names = np.arange(len(words))
        out_flat, out_names, out_lengths = [], [], []
        while len(names):
            word = np.repeat(np.arange(len(names)), lengths)
            key = np.full(len(symbols), -1, np.int64)
            if len(symbols) > 1:
                same = word[:-1] == word[1:]
                key[:-1] = np.where(same, symbols[:-1] << SHIFT | symbols[1:], -1)
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            rank = np.where(self.keys[at] == key, self.ranks[at], NONE)
            lowest = np.minimum.reduceat(rank, np.cumsum(lengths) - lengths)
            chosen = np.flatnonzero((rank == lowest[word]) & (rank != NONE))
            if len(chosen):
                # Of overlapping occurrences (a run of one symbol) every other one merges.
                joint = np.zeros(len(chosen), bool)
                joint[1:] = np.diff(chosen) == 1
                heads = np.flatnonzero(~joint)
                run = np.arange(len(chosen)) - np.repeat(heads, np.diff(np.append(heads, len(chosen))))
                chosen = chosen[run % 2 == 0]
            keep = np.ones(len(symbols), bool)
            symbols[chosen] = self.merged[at[chosen]]
            keep[chosen + 1] = False
            done = lowest == NONE
            lengths = lengths - np.bincount(word[chosen], minlength=len(names))
            symbols, word = symbols[keep], word[keep]
            if done.any():
                gone = done[word]
                out_flat.append(symbols[gone])
                out_names.append(names[done])
                out_lengths.append(lengths[done])
                symbols, names, lengths = symbols[~gone], names[~done], lengths[~done]
        if not out_flat:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        flat, sizes, owner = np.concatenate(out_flat), np.concatenate(out_lengths), np.concatenate(out_names)
        order = np.argsort(owner)
        starts = np.cumsum(sizes) - sizes
        return gathered(flat, starts[order], sizes[order]), sizes[order]

    def units(self, units: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids of units and the number of each."""
        find = self.pattern.findall
        plain = plain_words(units)
        words: list[bytes] = []
        counts, names = np.ones(len(units), np.int64), {}
        for i, (unit, whole) in enumerate(zip(units, plain.tolist(), strict=True)):
            if whole:
                words.append(unit)
                continue
            text, before = unit.decode("utf-8", "replace"), len(words)
            parts = self.splits.split(text) if self.splits else [text]
            for k, part in enumerate(parts):
                if k % 2:
                    names[len(words)] = self.special[part]
                    words.append(part.encode())
                else:
                    words.extend(w.encode() for w in find(part))
            counts[i] = len(words) - before
        distinct: dict[bytes, int] = {}
        which = np.array([distinct.setdefault(w, len(distinct)) for w in words], np.int64)
        flat, lengths = self.merge(list(distinct))
        flat, lengths = gathered(flat, (np.cumsum(lengths) - lengths)[which], lengths[which]), lengths[which]
        if names:
            flat, lengths = self._with_special(flat, lengths, names)
        ends = np.cumsum(np.append(0, lengths))
        edges = np.cumsum(np.append(0, counts))
        return flat, np.diff(ends[edges])

    @staticmethod
    def _with_special(flat: np.ndarray, lengths: np.ndarray, names: dict[int, int]) -> tuple[np.ndarray, np.ndarray]:
        parts = np.split(flat, np.cumsum(lengths)[:-1])
        for i, token in names.items():
            parts[i] = np.array([token], flat.dtype)
        return np.concatenate(parts), np.array([len(p) for p in parts], np.int64)

    def decode(self, ids: np.ndarray) -> np.ndarray:
        """The tokens' bytes, one after the other."""
        return gathered(self.token_bytes, self.token_starts[ids], self.token_lengths[ids])


@lru_cache(maxsize=2)
def coder(definition: str) -> tuple[BytePairs, UnitEncoder]:
    """One coder, with its caches, for all tasks of a worker process."""
    pairs = BytePairs(definition)
    return pairs, UnitEncoder(pairs.units)


def encode_texts(definition: str, texts: list[str]) -> list[list[int]]:
    _, units = coder(definition)
    out = []
    for _, _, offsets, data in text_blocks(pa.array(texts, pa.string())):
        ids, counts = units.block(offsets, data)
        out += [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])]
    return out


def decode_ids(definition: str, ids: list[int]) -> str:
    pairs, _ = coder(definition)
    return pairs.decode(np.array(ids, np.int64)).tobytes().decode("utf-8", "replace")


def encoded(docs: DataFrame, definition: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and ids (array of int) of each document."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, units = coder(definition)
        for batch in batches:
            for a, b, offsets, data in text_blocks(batch.column(1)):
                ids, counts = units.block(offsets, data)
                edges = pa.array(np.append(0, np.cumsum(counts)), pa.int32())
                yield pa.record_batch(
                    [batch.column(0).slice(a, b - a), pa.ListArray.from_arrays(edges, pa.array(ids, pa.int32()))],
                    ["doc_id", "ids"],
                )

    return id_text(docs, doc_id, text).mapInArrow(freeing(step), "doc_id long, ids array<int>")


def round_trip(docs: DataFrame, definition: str) -> DataFrame:
    """doc_id, n_tokens and checksums of the ids and of the text decoded from them."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs, units = coder(definition)
        for batch in batches:
            for a, b, offsets, data in text_blocks(batch.column(1)):
                ids, counts = units.block(offsets, data)
                raw = ids.astype("<u4").tobytes()
                back = pairs.decode(ids)
                sums = np.append(0, np.cumsum(pairs.token_lengths[ids]))
                edges = np.append(0, np.cumsum(counts))
                at = sums[edges]
                back = back.tobytes()
                ids_sha, text_sha = [], []
                for i in range(b - a):
                    ids_sha.append(hashlib.sha256(raw[4 * edges[i] : 4 * edges[i + 1]]).hexdigest())
                    decoded = back[at[i] : at[i + 1]].decode("utf-8", "replace").encode()
                    text_sha.append(hashlib.sha256(decoded).hexdigest())
                yield pa.record_batch(
                    [batch.column(0).slice(a, b - a), pa.array(counts), pa.array(ids_sha), pa.array(text_sha)],
                    ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
                )

    return id_text(docs).mapInArrow(
        freeing(step), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    )
