"""Personal data by weak supervision: labelers vote, expectation-maximisation weighs them, a span classifier decides.

Every text is scanned for candidate spans of four kinds (email, ip, card, phone): those of the strict base patterns, and those
of wider ones. Five labelers vote on each candidate: a regular expression of the usual way to write it (``form``), a
checksum or range check (``valid``), a gazetteer of known endings, prefixes and codes (``known``), words before it
(``context``) and its borders (``border``); a vote is no, yes or abstain. Votes, a few shape features and whether it is a base
span make a code; counts of codes over *all* texts go to the driver, whose size is bounded by the number of codes (``KINDS`` x
2 x 3^5 x ``SHAPES``), not by the input.

For each kind, expectation-maximisation on those counts estimates how each labeler votes on true and on false spans. Base
spans are anchors, held true; that a span is one is no vote, so that other spans aren't judged by lacking it. The posteriors
are the soft labels of a logistic span classifier over votes and shape. A second pass over the texts keeps base spans
always and adds candidates that overlap no base span and that the classifier accepts.

Every scan is linear in the text, whatever stands in it: runs of characters are consumed once, never from each start anew.

Offsets are code points, the end exclusive. Defined cases: a null text is empty and has no spans; of wider candidates that
overlap, the first kind's in the order of ``KINDS`` stays; spans of two kinds that start alike are in that order too;
repeated rows give repeated rows; an empty table gives an empty table and accepts nothing. Only the named columns are read;
others pass through :func:`redact` whatever their names.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import map_texts, tuned, worker_memory

KINDS = ("email", "ip", "card", "phone")
LABELERS = ("form", "valid", "known", "context", "border")
SHAPES = 8
NO, YES, ABSTAIN = 0, 1, 2
ACCEPT = 0.5

Span = tuple[int, int]

#: Fixed values of the contract: the base patterns are
#: email [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+, ip [0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+),
#: card [0-9]([\x20-]?[0-9])+ and phone \+[0-9][\x20().0-9-]+[0-9]; below they are in parts that are scanned once.
LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
#: A run of digits is taken with three more or alone, so that the search goes on behind it.
FOUR = re.compile(r"[0-9]++(\.[0-9]++\.[0-9]++\.[0-9]++)?+")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
#: Wider: spelled-out addresses, numbers that fail a check, national phone numbers.
AT = re.compile(r"@|\(at\)|\[at\]")
SPELLED_DOMAIN = re.compile(r" ?[A-Za-z0-9-]++(?: ?(?:\.|\(dot\)|\[dot\]) ?[A-Za-z0-9-]++)++")
NATIONAL = re.compile(r"(?<![0-9])(?:\+?[0-9]{1,3}[ .-])?\(?[0-9]{2,4}\)?[ .-][0-9]{3,4}[ .-][0-9]{3,4}(?![0-9])")
#: The usual way to write each kind.
FORM = {
    "email": re.compile(r"[^\s@]+@[^\s@]+\.[A-Za-z]{2,}|\S+ ?[(\[]at[)\]] ?\S+(?: ?[(\[]dot[)\]] ?[A-Za-z-]+)+"),
    "ip": re.compile(r"(?:(?:0|[1-9][0-9]{0,2})(?:\.(?!$)|$)){4}"),
    "card": re.compile(r"[0-9]{13,19}|(?:[0-9]{4}([ -])[0-9]{4}\1[0-9]{4}\1[0-9]{1,7})|[0-9]{4}([ -])[0-9]{6}\2[0-9]{5}"),
    "phone": re.compile(r"(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{2,4}\) ?|[0-9]{2,4}[ .-])[0-9]{3,4}(?:[ .-][0-9]{2,4})+"),
}
#: Gazetteers, and words that announce a kind.
ENDINGS = frozenset(
    "com net org edu gov mil int info biz name pro io ai app dev me tv co example test "
    "at au be bg br ca ch cl cn cz de dk ee es eu fi fr gr hk hr hu ie il in is it jp kr lt lu lv mx nl no nz pl pt ro rs ru se sg si sk th tr tw ua uk us za".split()
)
CARD_STARTS = ("34", "36", "37", "38", "4", "50", "51", "52", "53", "54", "55", "56", "58", "6011", "62", "63", "64", "65", "67", "35")
DIAL_CODES = tuple("1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 54 55 56 57 60 61 62 63 64 65 66 81 82 84 86 90 91 92 98 351 352 353 354 358 359 370 371 372 380 385 386 420 421 852 886 966 971 972".split())
NETWORKS = ("10.", "127.", "172.16.", "192.168.", "169.254.", "8.8.")
CONTEXT = {
    "email": re.compile(r"(?i)mail|contact|write|reach|correo|schreib|écri"),
    "ip": re.compile(r"(?i)\bip\b|server|host|address|login|client|ping|dirección|adresse"),
    "card": re.compile(r"(?i)card|visa|credit|debit|amex|payment|tarjeta|karte|carte"),
    "phone": re.compile(r"(?i)phone|call|\btel|fax|mobile|dial|\bsms\b|ring|teléfono|telefon|appel|anruf"),
}
BEFORE = 30
_DIGIT = re.compile(r"[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 if d > 4 else d * 2
        total += d
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(_DIGIT.findall(s))


def _valid(kind: str, s: str) -> bool:
    if kind == "ip":
        parts = [p.lstrip("0") for p in s.split(".")]
        return all(len(p) <= 3 and int(p or "0") <= 255 for p in parts)
    if kind == "card":
        d = _digits(s)
        return 13 <= len(d) <= 19 and luhn(d)
    if kind == "phone":
        return 9 <= len(_digits(s)) <= 15
    return True


def _may_have(text: str) -> tuple[bool, bool]:
    """Whether it can have emails; whether it can have numbers."""
    return "@" in text or "(at)" in text or "[at]" in text, _DIGIT.search(text) is not None


def _addresses(text: str, at: Iterator[Span], domain: re.Pattern, gap: str) -> Iterator[Span]:
    """Addresses around places (start, end) of the sign: the characters before one are looked at once."""
    low = 0
    for a, b in at:
        if a < low:
            continue
        before = text[low:a]
        stem = before.removesuffix(gap) if gap else before
        start = low + len(stem.rstrip(LOCAL))
        found = domain.match(text, b) if start < low + len(stem) else None
        low = b
        if found is not None:
            yield start, found.end()
            low = found.end()


def _signs(text: str) -> Iterator[Span]:
    at = text.find("@")
    while at >= 0:
        yield at, at + 1
        at = text.find("@", at + 1)


def _spans(pattern: re.Pattern, text: str) -> Iterator[Span]:
    return (m.span() for m in pattern.finditer(text))


def _strict(kind: str, text: str) -> Iterator[Span]:
    """Leftmost spans of a base pattern, checked or not."""
    if kind == "email":
        return _addresses(text, _signs(text), DOMAIN, "")
    if kind == "ip":
        return (m.span() for m in FOUR.finditer(text) if m.group(1) is not None)
    return _spans(CARD if kind == "card" else PHONE, text)


def _wide(kind: str, text: str) -> Iterator[Span]:
    """Leftmost spans of a wider pattern."""
    if kind == "email":
        return _addresses(text, _spans(AT, text), SPELLED_DOMAIN, " ")
    if kind == "ip":
        return _strict(kind, text)
    if kind == "card":
        return ((s, e) for s, e in _strict(kind, text) if e - s <= 2 * 19 and 13 <= len(_digits(text[s:e])) <= 19)
    return _spans(NATIONAL, text)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end), by kind, then start."""
    mail, number = _may_have(text)
    found = []
    for k, kind in enumerate(KINDS):
        if mail if kind == "email" else number and (kind != "phone" or "+" in text):
            found += [(k, s, e) for s, e in _strict(kind, text) if _valid(kind, text[s:e])]
    return found


def _code(k: int, text: str, start: int, end: int, base: bool) -> int:
    kind, s = KINDS[k], text[start:end]
    digits = _digits(s)
    valid = ABSTAIN if kind == "email" else YES if _valid(kind, s) else NO
    if kind == "email":
        known = YES if re.split(r"[ .)\]]", s)[-1].lower() in ENDINGS else NO
    elif kind == "ip":
        known = YES if s.startswith(NETWORKS) else ABSTAIN
    elif kind == "card":
        known = YES if digits.startswith(CARD_STARTS) else NO
    else:
        known = (YES if digits.startswith(DIAL_CODES) else NO) if s.startswith("+") else ABSTAIN
    context = YES if CONTEXT[kind].search(text[max(0, start - BEFORE) : start]) else ABSTAIN
    joined = (start > 0 and text[start - 1].isalnum()) or (end < len(text) and text[end].isalnum())
    # What is longer than any usual way to write it isn't one; the patterns see short strings only.
    form = YES if len(s) <= 254 and FORM[kind].fullmatch(s) else NO
    n = len(digits) if kind != "email" else len(s)
    size = 0 if n < 9 else 1 if n < 13 else 2 if n < 17 else 3
    code = 2 * k + base
    for v in (form, valid, known, context, NO if joined else YES):
        code = code * 3 + v
    return (code * SHAPES) + size * 2 + (" " in s or "-" in s)


def _free(spans: Iterator[Span], taken: list[Span]) -> list[Span]:
    """Those of ascending spans that overlap none of ``taken``, ascending and apart; one sweep over both."""
    out, i = [], 0
    for s, e in spans:
        while i < len(taken) and taken[i][1] <= s:
            i += 1
        if i == len(taken) or taken[i][0] >= e:
            out.append((s, e))
    return out


def _union(spans: list[Span]) -> list[Span]:
    out: list[Span] = []
    for s, e in sorted(spans):
        if out and s < out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


def candidates(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int, int]]:
    """(kind, start, end, code) of the base spans, then of wider ones that overlap none of them nor one another."""
    mail, number = _may_have(text)
    if not (mail or number):
        return []
    out = [(k, s, e, _code(k, text, s, e, True)) for k, s, e in base]
    taken = _union([(s, e) for _, s, e in base])
    for k, kind in enumerate(KINDS):
        if mail if kind == "email" else number:
            free = _free(_wide(kind, text), taken)
            out += [(k, s, e, _code(k, text, s, e, False)) for s, e in free]
            taken = _union(taken + free) if free else taken
    return out


def code_counts(docs: DataFrame, text_col: str = "text") -> dict[int, int]:
    """How often each code occurs in all texts: one row a code from each batch, summed."""
    rows = docs.select(F.col(f"`{text_col}`").cast("string").alias("t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_memory("pii")
        seen: Counter[int] = Counter()
        for b in batches:
            for t in b.column(0).to_pylist():
                if t:
                    seen.update(c[3] for c in candidates(t, base_spans(t)))
        yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.int32()), pa.array(list(seen.values()), pa.int64())], names=["code", "n"])

    tuned(docs.sparkSession)
    return {r.code: r.n for r in rows.mapInArrow(run, "code int, n long").groupBy("code").agg(F.sum("n").alias("n")).collect()}


def votes_of(code: int) -> tuple[int, bool, list[int], int]:
    """(kind, whether a base span, votes, shape)."""
    code, shape = divmod(code, SHAPES)
    votes = []
    for _ in LABELERS:
        code, v = divmod(code, 3)
        votes.append(v)
    return code // 2, bool(code % 2), votes[::-1], shape


def reliabilities(votes: np.ndarray, anchored: np.ndarray, n: np.ndarray, rounds: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """Posterior of each vote pattern, and P(vote | false/true) as [class, labeler, vote], by expectation-maximisation.

    Anchored patterns are held true. The others begin at their share of yes among the votes that aren't abstentions; those
    that fail a check begin as false.
    """
    said = votes != ABSTAIN
    post = np.clip((np.where(said, votes, 0).sum(1) + 0.5) / (said.sum(1) + 1), 0.05, 0.95)
    post[votes[:, 1] == NO] = 0.05
    post[anchored] = 0.99
    p = np.zeros((2, votes.shape[1], 3))
    for _ in range(rounds):
        for c, q in ((0, 1 - post), (1, post)):
            for v in range(3):
                p[c, :, v] = ((votes == v) * (q * n)[:, None]).sum(0) + 1
        p /= p.sum(2, keepdims=True)
        prior = np.clip((post * n).sum() / n.sum(), 0.01, 0.99)
        each = np.log(np.take_along_axis(p[:, None], votes[None, :, :, None].repeat(2, 0), 3)[..., 0]).sum(2)
        post = 1 / (1 + np.exp(np.clip(each[0] - each[1] + np.log((1 - prior) / prior), -30, 30)))
        post[anchored] = np.maximum(post[anchored], 0.99)
    return post, p


def _features(kinds: np.ndarray, votes: np.ndarray, shapes: np.ndarray) -> np.ndarray:
    eye = lambda x, n: np.eye(n)[x]
    return np.hstack([eye(kinds, len(KINDS)), eye(votes, 3).reshape(len(votes), -1), eye(shapes, SHAPES), eye(kinds * 3 + votes[:, 1], 12)])


def accepted_codes(counts: dict[int, int], rounds: int = 400) -> set[int]:
    """The codes that the final classifier accepts."""
    if not counts:
        return set()
    codes = sorted(counts)
    split = [votes_of(c) for c in codes]
    kinds, anchored, votes, shapes = (np.array(column) for column in zip(*split, strict=True))
    n = np.array([counts[c] for c in codes], float)
    soft = np.zeros(len(codes))
    for k in set(kinds.tolist()):
        soft[kinds == k] = reliabilities(votes[kinds == k], anchored[kinds == k], n[kinds == k])[0]
    x, w = _features(kinds, votes, shapes), np.zeros(_features(kinds[:1], votes[:1], shapes[:1]).shape[1])
    weight = np.sqrt(n) / np.sqrt(n).sum()
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-(x @ w)))
        w -= 2.0 * (x.T @ (weight * (p - soft)) + 1e-4 * w)
    return {c for c, q in zip(codes, 1 / (1 + np.exp(-(x @ w))), strict=True) if q >= ACCEPT}


def train(docs: DataFrame, text_col: str = "text") -> frozenset[int]:
    return frozenset(accepted_codes(code_counts(docs, text_col)))


def all_spans(text: str, accepted: frozenset[int]) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """Base spans; base and accepted spans by kind, then start."""
    base = base_spans(text)
    found = candidates(text, base)
    return base, sorted(base + [(k, s, e) for k, s, e, c in found[len(base) :] if c in accepted])


def written(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for k, s, e in spans)


def find(docs: DataFrame, accepted: frozenset[int], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_email, n_ip, n_card, n_phone, base_sha256, spans), one row a document."""

    def run(texts: list[str]) -> list[pa.Array]:
        counts: list[list[int]] = [[] for _ in KINDS]
        shas, spans = [], []
        for t in texts:
            base, every = all_spans(t, accepted)
            for k, c in enumerate(counts):
                c.append(sum(s[0] == k for s in base))
            shas.append(hashlib.sha256(written(base).encode()).hexdigest())
            spans.append(written(every))
        return [*(pa.array(c, pa.int64()) for c in counts), pa.array(shas, pa.string()), pa.array(spans, pa.string())]

    return map_texts(docs, text_col, [id_col], run, ", ".join(f"n_{k} long" for k in KINDS) + ", base_sha256 string, spans string")


def redact(docs: DataFrame, accepted: frozenset[int], text_col: str = "text") -> DataFrame:
    """docs with each span of the text replaced by its kind in angle brackets; of overlapping spans the union, under the first's kind."""

    def clean(t: str | None) -> str | None:
        if not t:
            return t
        out, at = [], 0
        for s, e, k in sorted((s, e, k) for k, s, e in all_spans(t, accepted)[1]):
            if s >= at:
                out += [t[at:s], f"<{KINDS[k]}>"]
            at = max(at, e)
        return "".join(out) + t[at:] if out else t

    @F.pandas_udf("string")
    def redacted(texts: pd.Series) -> pd.Series:
        worker_memory("pii")
        return texts.map(clean)

    tuned(docs.sparkSession)
    return docs.withColumn(text_col, redacted(F.col(f"`{text_col}`")))


def query(docs: DataFrame) -> DataFrame:
    return find(docs, train(docs))
