from __future__ import annotations

import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from quire.llm import packing as P

from .conftest import frame, odd_texts, words


@pytest.fixture(scope="module")
def tokenizer() -> Tokenizer:
    return Tokenizer.from_file(public_tokenizers.path(P.TOKENIZER))


TEXTS = [
    *odd_texts(), "The cat's hat, it's 3.14 & 50%!", "ǅ İstanbul ΟΔΟΣ straße K Å é é ́x", "a~b ~ ~~ c~", "tab\tand nbsp em", "##@@!!$$", "don't we've I'M", "１２３ ½ ² 一二",
]


def test_tokens_equal_the_tokenizer(tokenizer):
    tokens = P.Tokens(P.TOKENIZER)
    for _ in range(2):
        assert [np.frombuffer(b, "<u4").tolist() for b in tokens([t or "" for t in TEXTS])] == [tokenizer.encode(t or "", add_special_tokens=False).ids for t in TEXTS]


SPECIAL = ["a <|endoftext|> b", "<|startoftext|>", "x<|ENDOFTEXT|>y z", "<| endoftext |>", "İ$]", "İİ..", "\u0958! q", "\ufb1d?? x", "Ⅷ, ½; x", "क़. ꙋ̈!"]


def test_tokens_of_special_tokens_and_marks(tokenizer):
    for texts in (SPECIAL, SPECIAL[::-1]):
        assert [np.frombuffer(b, "<u4").tolist() for b in P.Tokens(P.TOKENIZER)(texts)] == [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]


def test_tokens_of_random_strings(tokenizer):
    """10,000 strings of characters whose case or normal form is out of the ordinary, among plain ones."""
    r = random.Random(1)
    odd = "İıſßẞΣςǅǆŉΐﬁﬃ\u0958\u095c\ufb1d\u0344\u0301\u0307\u0338\u0345\u1e9e漢字かなカナ한글각ÅÅÅåé́ñΏаЁёĳ½²Ⅷⅷ٣३１\u200d\ufe0f😀\u00a0\u2028\u3000'’"
    plain = "abcdeXYZ019 .,;:!?$]()<|>~-_'\n\t\"#/"
    texts = ["".join(r.choice(odd if r.random() < 0.45 else plain) for _ in range(r.randint(1, 14))) for _ in range(10_000)]
    tokens = P.Tokens(P.TOKENIZER)
    got = [np.frombuffer(b, "<u4").tolist() for i in range(0, len(texts), 500) for b in tokens(texts[i : i + 500])]
    wrong = [t for t, ids in zip(texts, got, strict=True) if ids != tokenizer.encode(t, add_special_tokens=False).ids]
    assert not wrong, (len(wrong), wrong[:5])


def test_a_length_is_ranked_in_buckets(spark, monkeypatch):
    monkeypatch.setattr(P, "BUCKET", 7)
    rows = P.query(frame(spark, [""] * 200 + ["one two"] * 31)).collect()
    assert len(rows) == 231 and len({(r.sequence_id, r.offset) for r in rows}) == 231


def test_pack(spark, tokenizer, empty):
    texts = TEXTS + [words(random.Random(i).randint(1, 1500), i) for i in range(120)]
    rows = P.query(frame(spark, texts)).collect()
    by: dict[int, list] = {}
    for r in rows:
        by.setdefault(r.doc_id, []).append(r)
    assert set(by) == set(range(len(texts)))
    total = 0
    for i, t in enumerate(texts):
        ids = np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        own = sorted(by[i], key=lambda r: r.piece)
        assert [r.piece for r in own] == list(range(len(own))) and [r.start for r in own] == [k * 4096 for k in range(len(own))]
        assert sum(r.length for r in own) == len(ids) and all(r.length == 4096 for r in own[:-1])
        assert all(r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length].tobytes()) for r in own)
        total += len(ids)
    sequences: dict[int, list] = {}
    for r in rows:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in sequences.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 4096
    assert len(sequences) <= total / 4096 * 1.02 + 1
    assert P.query(empty).count() == 0


def test_repeated_rows_are_packed_each(spark):
    docs = frame(spark, ["same text"] * 50, [1] * 49 + [None])
    rows = P.query(docs).collect()
    assert len(rows) == 50 and len({(r.sequence_id, r.offset) for r in rows}) == 50


@pytest.mark.parametrize("seed", range(6))
def test_plan_places_every_piece_once(seed):
    r = random.Random(seed)
    counts = Counter(min(4096, max(1, int(r.lognormvariate(6, 1.2)))) for _ in range(3000))
    counts = {k: v * (1 if seed % 2 else 1000) for k, v in counts.items()}
    plan = P.plan(counts)
    got, filled = Counter(), Counter()
    for length, first, count, sequence, offset in plan.runs:
        assert got[length] == first
        got[length] += count
        if seed % 2:
            for s in range(sequence, sequence + count):
                assert filled[s] == offset  # runs are in the order of their offsets
                filled[s] += length
    assert got == counts
    if seed % 2:
        assert max(filled.values()) <= 4096 and len(filled) == plan.sequences
    assert plan.sequences <= sum(k * v for k, v in counts.items()) / 4096 * 1.01 + 1


def test_column_generation_beats_single_size_configurations():
    sizes, demand = [2500, 1500, 1300, 700], np.array([10.0, 10.0, 20.0, 30.0])
    found = P.configurations(sizes, demand, 4096)
    assert np.allclose(sum(c * x for c, x in found), demand)
    assert all((c * sizes).sum() <= 4096 for c, _ in found)
    assert sum(x for _, x in found) < sum(d / (4096 // s) for s, d in zip(sizes, demand, strict=True))
