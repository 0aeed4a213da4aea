"""Document fingerprints by consistent weighted sampling.

A text is a set of words weighted by how often they occur. For each of ``SAMPLES`` samples every word draws, from its hash
alone, r and c from Gamma(2, 1) and b from U(0, 1); with weight w, t = floor(ln w / r + b), ln y = r (t - b) and
ln a = ln c - ln y - r. The word with the least a, with its t, is the sample. Two texts agree in a sample with probability
sum(min(w, v)) / sum(max(w, v)), their generalised Jaccard similarity, so the share of equal samples estimates it.

:func:`with_next` puts each document beside the next one in ascending order of id without any total order in one task:
ids are cut at values that occur in the table, each cut's first document also goes, as a guest, to the range before it, and
each range is sorted on its own. An id, or null, that fills ranges of its own is cut further by the hash of the text; where equal
rows fill ranges, each task sends one of them on and completes the others, whose next document is equal. Texts travel compressed.

Words are runs of anything but white space. Defined cases: a null text is empty; all texts without words have the same
fingerprint; rows with equal ids come in the order of a hash of their texts, null ids last; a single document is its own
next; repeated rows give repeated rows, of which the last has another next document; an empty table gives an empty table. Only
the named columns are read.
"""

from __future__ import annotations

import bisect
import hashlib
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import map_texts, text_steps, tuned

SAMPLES = 64
#: Entries of a worker's table of (word, count); it is begun anew beyond that.
TABLE_ROWS = 60_000
STEP = 1_000_000
#: Ranges for each shuffle partition, so that partitions come out even.
RANGES = 4


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def draw(words: np.ndarray, weights: np.ndarray, samples: int) -> tuple[np.ndarray, np.ndarray]:
    """(ln a as float32, 32 bits of word and t) of shape (words, samples), from 64-bit word hashes and weights."""
    lanes = (np.arange(1, samples + 1, dtype=np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
    one = _mix(words[:, None] + lanes)
    two = _mix(one + np.uint64(0xD1B54A32D192ED03))
    part = lambda h, shift: (((h >> np.uint64(shift)) & np.uint64(0x1FFFFF)).astype(np.float32) + np.float32(0.5)) * np.float32(2.0**-21)
    r = -np.log(part(one, 0) * part(one, 21))
    c = -np.log(part(one, 42) * part(two, 0))
    b = part(two, 21)
    t = np.floor(np.log(weights.astype(np.float32))[:, None] / r + b)
    ln_a = np.log(c) - r * (t - b) - r
    code = _mix(words[:, None] + t.astype(np.int64).astype(np.uint64) * np.uint64(0xA0761D6478BD642F)) >> np.uint64(32)
    return ln_a, code.astype(np.uint32)


class Sampler:
    """Fingerprints of texts; a table of the (word, count) pairs met lately spares drawing them again."""

    def __init__(self, samples: int = SAMPLES) -> None:
        self.samples = samples
        self._clear()

    def _clear(self) -> None:
        self.at: dict[tuple[str, int], int] = {}
        self.ln_a = np.empty((0, self.samples), np.float32)
        self.code = np.empty((0, self.samples), np.uint32)

    def _add(self, pairs: list[tuple[str, int]]) -> None:
        grown_a, grown_c = [self.ln_a], [self.code]
        for i in range(0, len(pairs), 2048):
            some = pairs[i : i + 2048]
            words = np.array([xxhash.xxh3_64_intdigest(w) for w, _ in some], np.uint64)
            a, c = draw(words, np.array([n for _, n in some]), self.samples)
            grown_a.append(a)
            grown_c.append(c)
        self.ln_a, self.code = np.concatenate(grown_a), np.concatenate(grown_c)

    def __call__(self, texts: list[str]) -> np.ndarray:
        """(texts, samples) of uint32."""
        out = np.zeros((len(texts), self.samples), np.uint32)
        done = 0
        for first, step in text_steps(texts, STEP):
            if len(self.at) > TABLE_ROWS:
                self._clear()
            known = len(self.at)
            find = self.at.setdefault
            rows = [[find(p, len(self.at)) for p in Counter(t.split()).items()] for t in step]
            if len(self.at) > known:
                self._add(list(self.at)[known:])
            for i, row in enumerate(rows, first):
                if row:
                    index = np.array(row)
                    out[i] = self.code[index[self.ln_a[index].argmin(0)], np.arange(self.samples)]
            done = first + len(step)
        assert done == len(texts)
        return out


def likeness(one: np.ndarray, two: np.ndarray) -> np.ndarray:
    return (one == two).mean(axis=-1)


def written(prints: np.ndarray) -> list[str]:
    return [p.tobytes().hex() for p in prints.astype("<u4")]


Start = tuple[bool, int, int | None]  # no id, id, hash of the text (none: all rows of the id stand together)
LOWEST = -(1 << 63)


def starts_of(rows: DataFrame, ranges: int) -> tuple[list[Start], frozenset[tuple[bool, int, int]]]:
    """Starts, which occur in rows (id, tie), that cut them into about even ranges, and the (no id, id, tie) of equal rows that fill one.

    Both are at most about twice ``ranges``, whatever the table; ``tie`` has 53 bits.
    """
    shares = [i / ranges for i in range(1, ranges)] or [0.5]
    row = rows.agg(F.count(F.lit(1)).alias("n"), F.count("id").alias("ids"), F.min("id").alias("least"), F.max("id").alias("most")).first()
    no_ids = row.n - row.ids
    cuts: list[int] = []
    filling: list[int] = []
    if row.ids:
        # Percentiles are of doubles: of ids beyond 53 bits the upper ones are cut, and the least id of each stands for them.
        high = F.call_function("shiftright", F.col("id"), F.lit(0 if max(-row.least, row.most) < 1 << 53 else 11))
        highs = Counter(rows.agg(F.percentile_approx(high, shares, 20 * ranges).alias("cuts")).first().cuts)
        cuts = [row.least] + [r.id for r in rows.where(high.isin(list(highs))).groupBy(high.alias("high")).agg(F.min("id").alias("id")).collect()]
        # What holds two ranges' share of the rows stands at several cuts.
        several = [h for h, k in highs.items() if k > 1]
        if several:
            filling = [r.id for r in rows.where(high.isin(several)).groupBy("id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") * ranges >= 2 * row.n).collect()]
    starts: set[Start] = {(False, i, None) for i in cuts if i not in filling}
    equal: set[tuple[bool, int, int]] = set()
    by_text = [F.col("id").isin(filling)] * bool(filling) + [F.col("id").isNull()] * (no_ids * ranges >= 2 * row.n and no_ids > 0 or not row.ids)
    if by_text and row.n:
        ties = rows.where(reduce(lambda a, b: a | b, by_text)).groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.min("tie").alias("least"), F.percentile_approx("tie", shares, 20 * ranges).alias("cuts"))
        for r in ties.collect():
            key = (r.id is None, r.id or 0)
            each = [r.least, *r.cuts]
            equal |= {(*key, t) for t, k in Counter(each).items() if k * r.n >= row.n}
            parts = max(1, r.n * ranges // row.n)
            starts |= {(*key, each[j * len(each) // parts]) for j in range(min(parts, len(each)))}
    return sorted(starts, key=lambda s: (s[0], s[1], LOWEST if s[2] is None else s[2])), frozenset(equal)


def with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", samples: int = SAMPLES) -> DataFrame:
    """(id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next), one row a document.

    The edited text has the last floor(n_chars / 4) characters replaced by the first as many, or all, of the next document.
    """
    spark = tuned(docs.sparkSession)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("t"))
    rows = rows.select("id", F.call_function("shiftright", F.xxhash64("t"), F.lit(11)).alias("tie"), "t")
    starts, equal = starts_of(rows.select("id", "tie"), RANGES * parts)
    keys = [(no, i, LOWEST if tie is None else tie) for no, i, tie in starts]
    begins = set(starts)
    first_columns = {"range": "int", "kind": "int", "no_id": "boolean", "id": "long", "tie": "long", "print": "binary", "packed": "binary", "done": "binary"}
    out_columns = {"id": "long", "n_chars": "long", "edited_sha256": "string", "fingerprint": "string", "edited_fingerprint": "string", "near_edited": "double", "near_next": "double"}
    arrow = {"int": pa.int32(), "long": pa.int64(), "boolean": pa.bool_(), "binary": pa.binary(), "string": pa.string(), "double": pa.float64()}
    batch = lambda columns, found: pa.RecordBatch.from_arrays([pa.array([r[k] for r in found], arrow[t]) for k, t in enumerate(columns.values())], names=list(columns))

    def edited(own: str, following: str) -> str:
        cut = len(own) // 4
        return own[: len(own) - cut] + following[:cut]

    def first_pass(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sampler, pack = Sampler(samples), zstandard.ZstdCompressor(level=3)
        met: dict[tuple, tuple[str, bytes, bytes]] = {}  # of equal rows the one sent on: text, edited print, edited digest
        for b in batches:
            ids, ties, texts = (c.to_pylist() for c in b.columns)
            for at, step in text_steps(texts, STEP):
                prints = [p.tobytes() for p in sampler(step).astype("<u4")]
                out: list[tuple] = []
                for n, (i, tie, t, p) in enumerate(zip(ids[at:], ties[at:], step, prints)):
                    key = (i is None, i or 0, tie)
                    own = (*key[:1], i, tie, p)
                    if key in equal:
                        if key in met and met[key][0] == t:
                            _, edited_print, digest = met[key]
                            out.append(((n + tie) % len(keys), 0, *own, edited_print, len(t).to_bytes(8, "little") + digest))
                            continue
                        if key not in met:
                            e = edited(t, t)
                            met[key] = (t, sampler([e])[0].astype("<u4").tobytes(), hashlib.sha256(e.encode()).digest())
                    packed = pack.compress(t.encode())
                    k = max(0, bisect.bisect_right(keys, key) - 1)
                    out.append((k, 1, *own, packed, None))
                    if keys and (key in begins or (*key[:2], None) in begins) and keys[k][:2] == key[:2] and (starts[k][2] is None or starts[k][2] == tie):
                        out.append(((k - 1) % len(keys), 2, *own, packed, None))
                yield batch(first_columns, out)

    def second_pass(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sampler, pack = Sampler(samples), zstandard.ZstdDecompressor()
        before: tuple | None = None
        waiting: list[tuple] = []  # id, characters, edited text, print, next print
        done: list[tuple] = []  # id, characters, digest, print, edited print, next print
        chars = 0

        def flush() -> pa.RecordBatch:
            fresh = sampler([w[2] for w in waiting]).astype("<u4")
            every = done + [(w[0], w[1], hashlib.sha256(w[2].encode()).hexdigest(), w[3], e.tobytes(), w[4]) for w, e in zip(waiting, fresh, strict=True)]
            own, new, following = (np.frombuffer(b"".join(r[k] for r in every), "<u4").reshape(len(every), -1) for k in (3, 4, 5))
            near = zip(likeness(own, new).tolist(), likeness(own, following).tolist(), strict=True)
            return batch(out_columns, [(r[0], r[1], r[2], r[3].hex(), r[4].hex(), *x) for r, x in zip(every, near, strict=True)])

        for b in batches:
            for k, kind, _, i, _, p, z, d in zip(*(c.to_pylist() for c in b.columns)):
                if kind == 0:
                    done.append((i, int.from_bytes(d[:8], "little"), d[8:].hex(), p, z, p))
                else:
                    text = pack.decompress(z).decode()
                    if before is not None and before[1] == 1 and before[0] == k:
                        own = before[4]
                        waiting.append((before[2], len(own), edited(own, text), before[3], p))
                        chars += len(own)
                    before = (k, kind, i, p, text)
                if chars >= STEP or len(done) >= 4096:
                    yield flush()
                    waiting, done, chars = [], [], 0
        if waiting or done:
            yield flush()

    ddl = lambda columns: ", ".join(f"{c} {t}" for c, t in columns.items())
    packed = rows.mapInArrow(first_pass, ddl(first_columns))
    ordered = packed.repartition(parts, "range").sortWithinPartitions("range", "kind", "no_id", "id", "tie")
    return ordered.mapInArrow(second_pass, ddl(out_columns)).withColumnRenamed("id", id_col)


def fingerprint(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", samples: int = SAMPLES) -> DataFrame:
    """(id, fingerprint), one row a document."""
    def run(texts: list[str]) -> list[pa.Array]:
        return [pa.array(written(Sampler(samples)(texts)), pa.string())]

    return map_texts(docs, text_col, [id_col], run, "fingerprint string")


def query(docs: DataFrame) -> DataFrame:
    return with_next(docs)
