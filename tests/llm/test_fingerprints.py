"""Texts that a weak fingerprint would confuse, units of all scripts, samples of any size."""

from __future__ import annotations

import random
import sys
from itertools import combinations_with_replacement
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

sys.path.insert(0, str(Path(__file__).resolve().parent))

from staysearch.llm import bpe, common, near_dup, packing, quality_rules, token_counts
from staysearch.llm.common import text_blocks
from staysearch.llm.queries import BYTE_BPE, WORD_BPE, definition
from staysearch.llm.textbytes import PRIME, Fingerprints, powers
from staysearch.llm.units import UnitEncoder, unit_starts
from tables import documents


def thue_morse(n=1024):
    """A string over a and b, and its complement: equal modulo 2**64 in every odd base."""
    bits = [bin(i).count("1") % 2 for i in range(n)]
    return "".join("ab"[x] for x in bits), "".join("ba"[x] for x in bits)


A, B = thue_morse()


def ids(name, text):
    return Tokenizer.from_str(definition(name)).encode(text, add_special_tokens=False).ids


def test_fingerprints_tell_them_apart():
    data = np.frombuffer((A + B + A).encode(), np.uint8)
    one, other, again = Fingerprints(data).spans(np.array([0, 1024, 2048]), np.array([1024, 2048, 3072]))
    assert one == again != other
    assert powers(12345, 9).tolist() == [pow(12345, k, PRIME) for k in range(9)]
    rng = random.Random(1)
    texts = ["".join(rng.choice("ab") for _ in range(rng.randrange(1, 9))) for _ in range(3000)]
    ends = np.cumsum([len(t) for t in texts])
    prints = Fingerprints(np.frombuffer("".join(texts).encode(), np.uint8)).spans(np.append(0, ends[:-1]), ends)
    assert len(set(zip(texts, prints.tolist(), strict=True))) == len(set(texts)) == len(set(prints.tolist()))


def test_bpe_counts_and_packing_keep_them_apart(spark):
    wanted = [ids(BYTE_BPE, A), ids(BYTE_BPE, B)]
    assert wanted[0] != wanted[1] and bpe.encode_texts(definition(BYTE_BPE), [A, B]) == wanted
    docs = documents(spark, [(1, A), (2, B)])
    lengths = {r.length: r.n_docs for r in token_counts.histogram(docs, definition(BYTE_BPE)).collect()}
    assert sum(k * n for k, n in lengths.items()) == sum(map(len, wanted))
    got = {r.doc_id: list(r.ids) for r in packing.pieces(docs, definition(WORD_BPE), with_ids=True).collect()}
    assert got == {1: [*ids(WORD_BPE, A), 0], 2: [*ids(WORD_BPE, B), 0]}


def test_lines_and_shingles_keep_them_apart(spark):
    docs = documents(spark, [(1, f"{A}\n{B}\n{A}"), (2, f"{A} x y z w"), (3, f"{B} x y z w"), (4, f"{A} x y z w")])
    found = {r.doc_id: r for r in near_dup.near_duplicates(docs).collect()}
    assert [found[i].component_id for i in (1, 2, 3, 4)] == [1, 2, 3, 2]
    (_, _, offsets, data), = text_blocks(pa.array([f"{A}\n{B}\n{A}"]))
    assert quality_rules.measures(offsets, data)["n_dup_lines"].tolist() == [1]


def test_a_collision_does_not_change_ids(monkeypatch):
    """Units are compared by their bytes, within a block and with the cache."""
    monkeypatch.setattr(Fingerprints, "spans", lambda self, starts, ends: np.zeros(len(starts), np.uint64))
    pairs = bpe.BytePairs(definition(BYTE_BPE))
    encoder = UnitEncoder(pairs.units)
    for texts in (["one"], ["two"], ["one two", "three one"], ["one"]):
        for _, _, offsets, data in text_blocks(pa.array(texts)):
            flat, counts = encoder.block(offsets, data)
            parts = np.split(flat, np.cumsum(counts)[:-1])
            assert [p.tolist() for p in parts] == [ids(BYTE_BPE, t) for t in texts]


SCRIPTS = ["Привет, мир и люди. ", "Γειά σου κόσμε. ", "مرحبا بالعالم ", "你好，世界。再见、朋友。", "नमस्ते दुनिया ", "日本語 テスト。\n", "a  b  c　 d́ ", "x  y\u0085 z   q "]


def test_units_of_all_scripts_are_short_and_right():
    rng = random.Random(2)
    texts = ["".join(rng.choice(SCRIPTS) for _ in range(rng.randrange(1, 40))) for _ in range(300)]
    assert bpe.encode_texts(definition(BYTE_BPE), texts) == [ids(BYTE_BPE, t) for t in texts]
    encoder = packing.library_encoder(definition(WORD_BPE))
    for _, _, offsets, data in text_blocks(pa.array(texts)):
        flat, counts = encoder.block(offsets, data)
        assert [p.tolist() for p in np.split(flat, np.cumsum(counts)[:-1])] == [ids(WORD_BPE, t) for t in texts]
    for text in ("Привет, мир и люди. " * 100, "你好，世界。再见、朋友。" * 100, "مرحبا بالعالم " * 100):
        data = np.frombuffer(text.encode(), np.uint8)
        assert np.diff(np.append(unit_starts(np.array([0, len(data)]), data), len(data))).max() < 40


def test_the_unit_cache_is_bounded_in_bytes():
    encoder = UnitEncoder(bpe.BytePairs(definition(BYTE_BPE)).units, limit=50_000)
    rng, most = random.Random(3), 0
    for _ in range(40):
        texts = [" ".join(str(rng.random()) for _ in range(200))]
        for _, _, offsets, data in text_blocks(pa.array(texts)):
            flat, _ = encoder.block(offsets, data)
            assert flat.tolist() == ids(BYTE_BPE, texts[0])
        most = max(most, encoder.spans.bytes + encoder.texts.bytes)
    assert most < 120_000


def test_samples_of_any_share(spark):
    rows = spark.range(200_000)
    for share in (1.0, 0.3, 1e-4):
        n = rows.where(common.sampled(F.col("id"), share)).count()
        assert abs(n - 200_000 * share) <= 5 * (200_000 * share) ** 0.5
    assert rows.where(common.sampled(F.col("id"), 1e-12)).count() == 0
    assert "2^" not in str(common.sampled(F.col("id"), 1e-15)) and int(1e-15 * (1 << 63)) > 0


@pytest.mark.parametrize("seed", range(6))
def test_sum_index_finds_what_brute_force_finds(seed):
    rng = random.Random(seed)
    counts = np.array([0] + [rng.choice([0, 0, 1, 2]) for _ in range(30)])
    index = packing.SumIndex(counts)
    for _ in range(60):
        used = tuple(x for x in [rng.randrange(1, 31)] if index.counts[x])
        gap = rng.randrange(1, 31)
        left = [n - used.count(x) for x, n in enumerate(index.counts)]
        fits = any(
            sum(c) == gap and all(left[x] >= c.count(x) for x in c)
            for k in (1, 2, 3) for c in combinations_with_replacement([x for x in range(1, 31) if left[x]], k)
        )
        found = index.complement(gap, used)
        assert bool(found) == fits
        if found:
            assert sum(found) == gap and all(left[x] >= found.count(x) for x in found)
            for x in found:
                index.take(x, 1)
