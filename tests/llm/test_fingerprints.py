from __future__ import annotations

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from quire.llm import fingerprints as G

from .conftest import frame, odd_texts, words


def jaccard(a: str, b: str) -> float:
    x, y = Counter(a.split()), Counter(b.split())
    keys = set(x) | set(y)
    return sum(min(x[k], y[k]) for k in keys) / sum(max(x[k], y[k]) for k in keys) if keys else 1.0


def test_collisions_estimate_generalised_jaccard():
    r, errors = random.Random(1), []
    sampler = G.Sampler(512)
    for seed in range(30):
        a = words(80, seed).split() * r.randint(1, 3)
        b = a[: r.randint(0, len(a))] + words(40, 900 + seed).split() * r.randint(1, 3)
        one, two = sampler([" ".join(a), " ".join(b)])
        errors.append(G.likeness(one, two) - jaccard(" ".join(a), " ".join(b)))
    assert abs(np.mean(errors)) < 0.01 and np.std(errors) < 0.04


def test_tables_do_not_change_prints(monkeypatch):
    texts = [words(50, i) for i in range(60)]
    whole = G.Sampler()(texts)
    monkeypatch.setattr(G, "TABLE_ROWS", 100)
    monkeypatch.setattr(G, "STEP", 500)
    assert (G.Sampler()(texts) == whole).all() and (G.Sampler()(texts[::-1])[::-1] == whole).all()


def test_query(spark, empty):
    texts = odd_texts() + [words(30 + i, i % 20) for i in range(150)]
    ids = [i * 3 for i in range(len(texts))]
    docs = frame(spark, texts, ids).repartition(5)
    rows = {r.doc_id: r for r in G.query(docs).collect()}
    plain = [t or "" for t in texts]
    assert len(rows) == len(texts)
    by_text: dict[str, str] = {}
    for k, i in enumerate(ids):
        own, after = plain[k], plain[(k + 1) % len(plain)]
        cut = len(own) // 4
        edited = own[: len(own) - cut] + after[:cut]
        r = rows[i]
        assert (r.n_chars, r.edited_sha256) == (len(own), hashlib.sha256(edited.encode()).hexdigest())
        assert by_text.setdefault(own, r.fingerprint) == r.fingerprint
        assert by_text.setdefault(edited, r.edited_fingerprint) == r.edited_fingerprint
        assert abs(r.near_next - jaccard(own, after)) < 0.3 and abs(r.near_edited - jaccard(own, edited)) < 0.3
    assert G.query(empty).count() == 0


def test_repeated_and_null_ids_and_a_lone_document(spark):
    rows = G.query(frame(spark, ["a b c d", "a b c d", "e f g h", "i j"], [1, 1, None, None])).collect()
    assert len(rows) == 4
    lone = G.query(frame(spark, ["abcd"])).collect()
    assert lone[0].edited_sha256 == hashlib.sha256(b"abca").hexdigest() and lone[0].near_next == 1.0
    assert G.query(frame(spark, ["ab", "cd"], [None, None])).count() == 2


def brute_edits(docs: list[tuple[int | None, str]]) -> Counter:
    """Of documents in order of id, nulls last, with no texts of one id but equal ones: (id, characters, digest of the edited text)."""
    rows = sorted(docs, key=lambda d: (d[0] is None, d[0] or 0))
    out = []
    for (i, own), (_, after) in zip(rows, rows[1:] + rows[:1], strict=True):
        cut = len(own) // 4
        out.append((i, len(own), hashlib.sha256((own[: len(own) - cut] + after[:cut]).encode()).hexdigest()))
    return Counter(out)


@pytest.mark.parametrize("hot", [None, -7, 3, 2**62 + 12345, 900])
def test_an_id_with_a_third_of_all_rows(spark, hot):
    """Equal rows of one id, or of none, are dealt to many ranges; the others stay in order. Ids beyond 53 bits too."""
    big = 2**61 if hot and hot > 2**60 else 0
    docs = [(big + 3 * i, words(20 + i % 7, i)) for i in range(160)] + [(hot, words(30, 999))] * 90
    docs = [d for d in docs if d[0] != hot or d[1] == words(30, 999)]
    random.Random(2).shuffle(docs)
    rows = G.query(frame(spark, [t for _, t in docs], [i for i, _ in docs]).repartition(6)).collect()
    assert Counter((r.doc_id, r.n_chars, r.edited_sha256) for r in rows) == brute_edits(docs)
    sampler = G.Sampler()
    prints = dict(zip([t for _, t in docs], G.written(sampler([t for _, t in docs])), strict=True))
    by_id = {i: prints[t] for i, t in docs}
    assert all(r.fingerprint == by_id[r.doc_id] for r in rows)
    assert sum(r.near_next == 1.0 for r in rows) >= 89


def test_an_id_with_many_texts_is_cut_by_their_hashes(spark):
    docs = [(5, words(25, i)) for i in range(120)] + [(None, words(25, 500 + i)) for i in range(120)] + [(i, words(20, 900 + i)) for i in range(10, 40)]
    df = frame(spark, [t for _, t in docs], [i for i, _ in docs]).repartition(6)
    starts, equal = G.starts_of(df.select(F.col("doc_id").alias("id"), F.shiftright(F.xxhash64("text"), 11).alias("tie")), 16)
    assert sum(s[:2] == (False, 5) for s in starts) > 4 and sum(s[0] for s in starts) > 4 and not equal
    rows = G.query(df).collect()
    assert Counter(r.doc_id for r in rows) == Counter(i for i, _ in docs) and len({r.edited_sha256 for r in rows}) == len(docs)
    # Each document's edited text ends like the beginning of exactly one other: one closed chain.
    heads = Counter(hashlib.sha256((a[: len(a) - len(a) // 4] + b[: len(a) // 4]).encode()).hexdigest() for _, a in docs for _, b in docs)
    assert all(heads[r.edited_sha256] >= 1 for r in rows)
