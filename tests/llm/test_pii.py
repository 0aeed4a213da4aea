from __future__ import annotations

import hashlib
import random
import re
import time

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quire.llm import pii as P

from .conftest import frame, odd_texts

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(s: str) -> bool:
    d = [int(c) for c in s if c.isdigit()][::-1]
    return (sum(d[::2]) + sum(sum(divmod(2 * x, 10)) for x in d[1::2])) % 10 == 0


def brute(text: str) -> list[tuple[str, int, int]]:
    out = []
    for kind, pattern in PATTERNS.items():
        for m in re.finditer(pattern, text):
            n = sum(c.isdigit() for c in m.group())
            if kind == "ip" and any(int(p) > 255 for p in m.group().split(".")):
                continue
            if (kind == "card" and not (13 <= n <= 19 and luhn(m.group()))) or (kind == "phone" and not 9 <= n <= 15):
                continue
            out.append((kind, m.start(), m.end()))
    return out


@settings(max_examples=300, deadline=None)
@given(st.text("0123456789+@.- ()ab%é\n", max_size=60))
def test_base_spans(text):
    assert [(P.KINDS[k], s, e) for k, s, e in P.base_spans(text)] == brute(text)


@settings(max_examples=300, deadline=None)
@given(st.text("12+@.- ()a", max_size=60))
def test_base_spans_of_dense_texts(text):
    assert [(P.KINDS[k], s, e) for k, s, e in P.base_spans(text)] == brute(text)
    found = P.candidates(text, P.base_spans(text))
    wider = sorted((s, e) for _, s, e, c in found if not P.votes_of(c)[1])
    assert all(a[1] <= b[0] for a, b in zip(wider, wider[1:]))
    assert not any(s < e2 and s2 < e for s, e in wider for _, s2, e2 in P.base_spans(text))


HOSTILE = {
    "digits": "7" * 1_000_000,
    "letters and a sign": "a" * 1_000_000 + " @ " + "b" * 1_000_000,
    "signs": "a@" * 300_000,
    "signs without a dot": "a" * 500_000 + "@" + "b" * 500_000,
    "phone numbers": "+1 (212) 555-0100 or 212-555-0199, " * 20_000,
    "zeros": "1." + "0" * 1_000_000 + "1.2.3",
    "dotted": "1." * 300_000,
    "pluses": "+1" + "(" * 500_000 + "+1" * 200_000,
    "card digits": "4 " * 300_000,
    "spelled": "x (at) y (dot) " * 40_000,
    "dots": "a@b" + " . c" * 200_000,
    "spaces": "a" + " " * 500_000 + "@b.c",
}


@pytest.mark.parametrize("name", sorted(HOSTILE))
def test_hostile_texts_take_linear_time(name):
    text = HOSTILE[name]
    began = time.process_time()
    base = P.base_spans(text)
    found = P.candidates(text, base)
    assert time.process_time() - began < 4  # a quadratic scan takes hours
    assert len(found) >= len(base)
    short = text[:400]
    assert [(P.KINDS[k], s, e) for k, s, e in P.base_spans(short)] == brute(short)


def corpus() -> list[str | None]:
    r = random.Random(3)
    some = ["mail a.b@c.example.com now", "ip 10.1.2.300 or 1.2.3.4", "card 4111 1111 1111 1111.", "call +1 (212) 555-0100!", "😀é x@y.de", "4111111111111112", "phone 212-555-0199 or bob (at) site (dot) com"]
    return odd_texts() + some + [f"w {r.choice(some)} w" for _ in range(40)]


def test_query(spark, empty):
    texts = corpus()
    rows = {r.doc_id: r for r in P.query(frame(spark, texts)).collect()}
    assert len(rows) == len(texts)
    for i, t in enumerate(texts):
        base = [f"{k}:{s}:{e}" for k, s, e in brute(t or "")]
        assert rows[i].base_sha256 == hashlib.sha256(",".join(base).encode()).hexdigest()
        every = rows[i].spans.split(",") if rows[i].spans else []
        assert set(base) <= set(every)
        assert every == sorted(every, key=lambda x: (list(PATTERNS).index(x.split(":")[0]), int(x.split(":")[1])))
        assert [rows[i].n_email, rows[i].n_ip, rows[i].n_card, rows[i].n_phone] == [sum(b.startswith(k) for b in base) for k in PATTERNS]
    assert P.query(empty).count() == 0


def code(kind: int, base: bool, votes: list[int], shape: int = 4) -> int:
    c = 2 * kind + base
    for v in votes:
        c = c * 3 + v
    return c * P.SHAPES + shape


def test_unsupported_candidates_are_rejected_and_supported_ones_accepted():
    yes, no, skip = P.YES, P.NO, P.ABSTAIN
    good, like, bad = code(2, True, [yes, yes, yes, skip, yes]), code(2, False, [no, yes, yes, yes, yes]), code(2, False, [no, no, no, skip, no])
    accepted = P.accepted_codes({good: 500, like: 60, bad: 400})
    assert good in accepted and like in accepted and bad not in accepted
    assert P.accepted_codes({}) == set()


def test_reliabilities_tell_good_labelers_from_bad_ones():
    """Votes drawn from known reliabilities, without any anchors: expectation-maximisation finds them again."""
    r = np.random.default_rng(5)
    truth = r.random(20_000) < 0.3
    right = np.array([0.95, 0.9, 0.85, 0.6, 0.5])
    said = np.where(r.random((len(truth), 5)) < right, truth[:, None], ~truth[:, None]).astype(int)
    votes, n = np.unique(said, axis=0, return_counts=True)
    post, p = P.reliabilities(votes, np.zeros(len(votes), bool), n.astype(float))
    assert np.allclose(p[1, :, P.YES], right, atol=0.06) and np.allclose(p[0, :, P.NO], right, atol=0.06)
    by = {tuple(v): q for v, q in zip(votes.tolist(), post, strict=True)}
    assert ((np.array([by[tuple(v)] for v in said.tolist()]) > 0.5) == truth).mean() > 0.95


def planted(n: int, seed: int) -> tuple[list[str], list[set[tuple[str, str]]]]:
    """Texts with personal data beside the base patterns and look-alikes, and what of the former is in each."""
    r = random.Random(seed)
    number = lambda k: "".join(r.choice("0123456789") for _ in range(k))
    texts, wanted = [], []
    for _ in range(n):
        name = r.choice(["ann", "bob", "li", "maria"])
        what = r.randrange(7)
        own = set()
        if what == 0:
            spelled = f"{name} (at) site{number(2)} (dot) {r.choice(['com', 'org', 'de'])}"
            text, own = f"please {r.choice(['write', 'mail', 'contact'])} {spelled}, thanks", {("email", spelled)}
        elif what == 1:
            phone = f"{r.randint(201, 989)}-{r.randint(200, 999)}-{number(4)}"
            text, own = f"{r.choice(['call', 'phone', 'mobile'])} {phone} today", {("phone", phone)}
        elif what == 2:
            text = f"write to {name}.{number(2)}@mail.example.com or call +1 ({r.randint(201, 989)}) 555-{number(4)} now"
        elif what == 3:
            text = f"the server 10.{r.randint(0, 255)}.0.{r.randint(0, 255)} answers, release {r.randint(300, 900)}.{r.randint(300, 900)}.2.1 not"
        elif what == 4:
            text = f"order x{number(13)}y of part a{number(3)}-{number(3)}-{number(4)}b"
        elif what == 5:
            text = f"rates fell a{number(2)}.{number(3)}.{number(4)}z while costs rose"
        else:
            text = "plain words and nothing else " * 3
        texts.append(text)
        wanted.append(own)
    return texts, wanted


def test_added_spans_on_planted_texts(spark):
    texts, wanted = planted(600, 11)
    docs = frame(spark, texts)
    rows = {r.doc_id: r for r in P.query(docs).collect()}
    hit = added = 0
    for i, (t, own) in enumerate(zip(texts, wanted, strict=True)):
        base = {f"{k}:{s}:{e}" for k, s, e in brute(t)}
        more = [x.split(":") for x in rows[i].spans.split(",") if x and x not in base]
        got = {(k, t[int(s) : int(e)]) for k, s, e in more}
        added += len(got)
        hit += len(got & own)
    total = sum(map(len, wanted))
    assert total > 100 and hit / total >= 0.95 and hit / added >= 0.95


def test_redact(spark):
    docs = frame(spark, ["mail a@b.com, call +1 212 555 0100", None, "", "clean"])
    out = [r.text for r in P.redact(docs, frozenset()).orderBy("doc_id").collect()]
    assert out == ["mail <email>, call <phone>", None, "", "clean"]
    assert P.redact(docs, frozenset()).columns == docs.columns
