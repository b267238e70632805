"""BPE, packing and token counts against the tokenizers library and brute force."""

from __future__ import annotations

import hashlib
import random
import struct
import sys
import zlib
from collections import Counter
from pathlib import Path

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

sys.path.insert(0, str(Path(__file__).parent))

import tables  # noqa: E402

from staysearch.llm import bpe, packing, token_counts  # noqa: E402
from staysearch.llm.queries import BYTE_BPE, WORD_BPE, definition  # noqa: E402

ALPHABET = " \n\ta.b,'sé　日1!?Ã<|>́ z×÷"


@pytest.fixture(scope="module")
def library():
    return {name: Tokenizer.from_str(definition(name)) for name in (BYTE_BPE, WORD_BPE)}


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(ALPHABET, max_size=60), min_size=1, max_size=4))
def test_merge_rounds_equal_library(texts):
    tokenizer = Tokenizer.from_str(definition(BYTE_BPE))
    wanted = [e.ids for e in tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert bpe.encode_texts(definition(BYTE_BPE), texts) == wanted
    for ids in wanted:
        assert bpe.decode_ids(definition(BYTE_BPE), ids) == tokenizer.decode(ids, skip_special_tokens=False)


def test_specials_runs_and_long_words(library):
    texts = ["<|endoftext|> a<|endoftext|>\n <|endoftext|>", "a" * 5000, "aaaa bbbb " * 50, "", "\x00\x01 \x85"]
    wanted = [library[BYTE_BPE].encode(t, add_special_tokens=False).ids for t in texts]
    assert bpe.encode_texts(definition(BYTE_BPE), texts) == wanted


def test_ids_that_are_no_text_decode_like_the_library(library):
    rng = random.Random(4)
    for _ in range(100):
        ids = [rng.randrange(50257) for _ in range(6)]
        assert bpe.decode_ids(definition(BYTE_BPE), ids) == library[BYTE_BPE].decode(ids, skip_special_tokens=False)


def test_round_trip_rows(spark, library):
    texts = tables.edge_texts()
    rows = bpe.round_trip(tables.documents(spark, texts), definition(BYTE_BPE)).collect()
    wanted = []
    for i, text in texts:
        ids = library[BYTE_BPE].encode(text or "", add_special_tokens=False).ids
        raw = struct.pack(f"<{len(ids)}I", *ids)
        wanted.append((i, len(ids), hashlib.sha256(raw).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()))
    assert Counter(map(tuple, rows)) == Counter(wanted)


def test_encoded_ids_and_empty_table(spark, library):
    docs = tables.documents(spark, [(1, "two words"), (2, None)])
    found = {r.doc_id: r.ids for r in bpe.encoded(docs, definition(BYTE_BPE)).collect()}
    assert found == {1: library[BYTE_BPE].encode("two words").ids, 2: []}
    assert bpe.round_trip(tables.empty(docs), definition(BYTE_BPE)).count() == 0


# -- packing ---------------------------------------------------------------------


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 64), max_size=300))
def test_plan_uses_every_piece_once(lengths):
    patterns = packing.plan(dict(Counter(lengths)), 64)
    used = Counter()
    for times, items in patterns:
        assert times > 0 and sum(x * k for x, k in items) <= 64
        for x, k in items:
            used[x] += times * k
    assert used == Counter(lengths)


def test_exact_complements_fill_sequences():
    patterns = packing.plan({50: 3, 14: 1, 10: 1, 4: 1, 7: 1, 5: 1, 2: 1}, 64)
    assert sum(times for times, _ in patterns) == 3
    assert all(sum(x * k for x, k in items) == 64 for _, items in patterns)


def test_best_fit_takes_the_tightest_gap():
    # 40 leaves 24 and 44 leaves 20; 20 goes to the gap of 20.
    patterns = packing._best_fit(__import__("numpy").bincount([44, 40, 20], minlength=65), 64)
    assert sorted(sorted(x for x, _ in items) for _, items in patterns) == [[20, 44], [40]]


def packed_right(rows, texts, tokenizer, capacity):
    wanted = Counter()
    for i, text in texts:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 0]
        for k in range(0, len(ids), capacity):
            part = ids[k : k + capacity]
            wanted[i, k // capacity, k, len(part), zlib.crc32(struct.pack(f"<{len(part)}I", *part))] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == wanted
    ends: dict[int, int] = {}
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == ends.get(r.sequence_id, 0)
        ends[r.sequence_id] = r.offset + r.length
    assert max(ends.values()) <= capacity
    return len(ends)


def test_pack_report(spark, library):
    texts = tables.edge_texts()
    rows = packing.pack_report(tables.documents(spark, texts), definition(WORD_BPE)).collect()
    sequences = packed_right(rows, texts, library[WORD_BPE], packing.CAPACITY)
    assert sequences <= -(-sum(r.length for r in rows) // packing.CAPACITY) + 1
    assert packing.pack_report(tables.documents(spark, []), definition(WORD_BPE)).count() == 0


def test_sequences_hold_the_ids(spark, library):
    docs = tables.documents(spark, [(k, tables.sentence(k, 30)) for k in range(40)])
    pieces = packing.pieces(docs, definition(WORD_BPE), 64, with_ids=True)
    rows = packing.sequences(packing.packed(pieces, 64)).collect()
    assert all(0 < len(r.ids) <= 64 for r in rows)
    whole = Counter(i for r in rows for i in r.ids)
    wanted = Counter()
    for k in range(40):
        wanted.update([*library[WORD_BPE].encode(tables.sentence(k, 30), add_special_tokens=False).ids, 0])
    assert whole == wanted


# -- token counts ----------------------------------------------------------------


def test_suffix_sums_answer_every_limit(spark, library):
    texts = tables.edge_texts()
    lengths = [len(library[BYTE_BPE].encode(t or "", add_special_tokens=False).ids) for _, t in texts]
    docs = tables.documents(spark, texts)
    sums = token_counts.count_report(docs, definition(BYTE_BPE)).cache()
    for r in sums.collect():
        assert r.n_docs == lengths.count(r.length)
        assert r.docs_at_least == sum(x >= r.length for x in lengths)
        assert r.tokens_at_least == sum(x for x in lengths if x >= r.length)
        assert r.truncated_tokens == sum(min(x, r.length) for x in lengths)
        assert (r.total_docs, r.total_tokens) == (len(lengths), sum(lengths))
        assert r.share_fitting == pytest.approx(sum(x <= r.length for x in lengths) / len(lengths))
    assert sums.count() == len(set(lengths))
    limits = [0, 1, 17, 10**6]
    for r in token_counts.at_limits(sums, limits).collect():
        assert r.docs_longer == sum(x > r.limit_tokens for x in lengths)
        assert r.truncated_tokens == sum(min(x, r.limit_tokens) for x in lengths)
    for r in token_counts.quantiles(sums, [0.5, 1.0]).collect():
        assert r.length == min(x for x in lengths if sum(y <= x for y in lengths) >= r.share * len(lengths))
    assert token_counts.count_report(tables.empty(docs), definition(BYTE_BPE)).count() == 0
