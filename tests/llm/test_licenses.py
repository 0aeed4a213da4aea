from __future__ import annotations

import random
import re
import time

import duckdb
import pyarrow as pa
import pytest

from quire.llm import licenses as L

from .conftest import frame, odd_texts

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def lower(text: str) -> str:
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def brute(text: str) -> tuple[int, list[tuple[int, str]], set[str]]:
    words = WORD.findall(lower(text))
    places = [(i, label) for phrase, label in L.PHRASES for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split()]
    labels = {label for _, label in places}
    for line in text.split("\n"):
        own = set(WORD.findall(lower(line)))
        for label, notice in L.NOTICES:
            t = set(WORD.findall(lower(notice)))
            if len(t & own) >= len(t) * L.CONTAINMENT - 1e-9:
                labels.add(label)
    return len(words), places, labels


def corpus() -> list[str | None]:
    r, out = random.Random(5), odd_texts()
    for _, notice in L.NOTICES:
        w = notice.split()
        for _ in range(6):
            kept = [x for x in w if r.random() < 0.88]
            r.shuffle(kept)
            out.append("before\n" + " ".join(kept + ["noise"] * r.randint(0, 5)) + "\nafter")
    return out + ["CC BY-NC 4.0 cc\nby", "MIT License mit license", "Kelvin K cc by", "Apache\tLicense, GNU General Public\nLicense"]


def test_query(spark, empty):
    texts = corpus()
    rows = {r.doc_id: r for r in L.query(frame(spark, texts)).collect()}
    hit = 0
    for i, t in enumerate(texts):
        n, places, labels = brute(t or "")
        r = rows[i]
        assert (r.n_words, r.n_base) == (n, len(places))
        assert (r.first_word, r.last_word) == ((min(places)[0], max(places)[0]) if places else (None, None))
        assert r.base_labels == ",".join(sorted({label for _, label in places})) and r.labels == ",".join(sorted(labels))
        assert 0 <= r.score <= 1 and (r.score > 0) == bool(labels)
        hit += bool(labels - {label for _, label in places})
    assert hit > 5 and L.query(empty).count() == 0


def test_order_of_words_does_not_change_matches():
    lines = [L.words_of(t or "") for t in corpus()]
    some = L.build_index({})
    other = L.build_index({w: hash(w) % 97 for w in L.universe(L.NOTICES)})
    for w in lines:
        assert sorted(L.match_block(w, some)) == sorted(L.match_block(w, other))


def labels(spark, *texts: str) -> list[str]:
    rows = {r.doc_id: r.labels for r in L.query(frame(spark, list(texts))).collect()}
    return [rows[i] for i in range(len(texts))]


def test_wrapped_notices_are_found(spark):
    """Every notice, in lines of four words as a comment within prose, and inside one long line."""
    prose = "x1 x2 x3 x4 x5 " * 200
    texts = []
    for _, notice in L.NOTICES:
        w = notice.split()
        texts += [prose + "\n" + "\n".join(f" * {' '.join(w[i : i + 4])}" for i in range(0, len(w), 4)) + "\n" + prose, prose + notice + prose]
    got = labels(spark, *texts)
    for i, (label, _) in enumerate(L.NOTICES):
        assert label in got[2 * i].split(",") and label in got[2 * i + 1].split(",")


def test_words_scattered_in_a_long_line_are_no_notice(spark):
    far = " filler" * 50
    assert labels(spark, f"released{far} under{far} the{far} mit{far} license", "released under the good mit license") == ["", "mit"]


def test_windows_match_every_window_counted():
    r = random.Random(11)
    index = L.build_index({})
    for _ in range(300):
        _, notice = r.choice(L.NOTICES)
        w = [x for x in L.words_of(notice) for _ in range(r.randint(0, 2)) if r.random() < 0.9] + [b"z"] * r.randint(0, 9)
        r.shuffle(w)
        w += L.words_of(notice)[: r.randint(0, 30)]
        want = set()
        for k, n in enumerate(index.widths):
            t = set(index.words[k])
            if any(len(t & set(w[i : i + n])) >= index.needed[k] for i in range(len(w))):
                want.add(k)
        assert {k for _, _, k, _ in L.matches(w, index)} == want


def test_sql_agrees_on_wrapped_and_scattered_notices(spark):
    texts = corpus()
    for _, notice in L.NOTICES:
        w = notice.split()
        texts += ["\n".join(" ".join(w[i : i + 3]) for i in range(0, len(w), 3)), " x ".join(w), " ".join(w[: len(w) // 2]) + " y" * 60 + " ".join(w[len(w) // 2 :])]
    con = duckdb.connect()
    con.register("documents", pa.table({"doc_id": list(range(len(texts))), "text": texts}))
    names = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]
    want = sorted(con.sql(f"SELECT {', '.join(names)} FROM ({L.oracle_sql()})").fetchall())
    got = sorted(tuple(r[c] for c in names) for r in L.query(frame(spark, texts)).collect())
    assert [g[:-1] for g in got] == [w[:-1] for w in want] and [g[-1] for g in got] == pytest.approx([w[-1] for w in want])
    assert sum(g[5] != g[6] for g in got) > 20  # labels beyond the base


def test_places_take_linear_time():
    words = L.words_of("cc by " * 200_000 + "permission is hereby granted " * 50_000)
    began = time.process_time()
    assert len(L.places(words)) == 200_000
    L.matches(words, L.build_index({}))
    assert time.process_time() - began < 5
