"""Packing documents into sequences: linear grouping, configurations, substitution, best fit.

A document is its token ids and an end id; only what is longer than a sequence is cut, into pieces of full length but the
last. The plan is made on how many pieces there are of each length, at most ``capacity`` numbers whatever the input:

1. Linear grouping: large lengths, sorted, are dealt into groups of about equal cardinality (of the numbers of groups in ``GROUPS`` the best) (at borders between
   lengths) and rounded up to their group's largest.
2. Configurations: multisets of rounded lengths that fit a sequence. Column generation finds how often to use each: a basis
   of configurations gives prices, a knapsack over the few sizes finds a better configuration, until there is none.
3. Substitution: whole multiples of the configurations take actual pieces, group by group in descending order; a run of
   sequences whose slots have the same actual lengths is one entry.
4. Best fit: large pieces that are left, then small ones, in descending order, go where the least room stays.

The plan is a list of runs (length, first rank, count, sequence, offset). A piece's rank among its length is its rank in a
hash bucket of its length plus the counts of the buckets before; a length has as many buckets as its count needs, so no task
holds a length, and its run is found by binary search. Pieces are written to the shared folder once, so that plan and ranks see the same rows.

Defined cases: a null text is empty, and an empty text is one piece of the end id alone; repeated rows are packed each;
null ids are kept; an empty table gives an empty table. Only the named columns are read.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.llm.common import durable, map_texts, text_steps, worker_memory

CAPACITY = 4096
END_ID = 1
#: Numbers of groups that are tried; the plan with the fewest sequences stays.
GROUPS = (12, 24, 48, 96)
#: Lengths above a sequence's eighth are large.
LARGE_SHARE = 8
#: Pieces of one length that one task ranks.
BUCKET = 100_000
TOKENIZER = "word_bpe_49k.json"
#: Chunks and words whose ids a worker remembers; what comes beyond is forgotten after its batch.
REMEMBERED = 300_000
#: Characters whose chunks are looked up at once.
STEP = 500_000


class Tokens:
    """Token ids of texts, as little-endian 32-bit numbers.

    The tokenizer's merges never cross a space, nor the border between letters or numbers and ASCII punctuation, and it lowers
    case: so it is run on the distinct lower-case words within what stands between spaces. Words that its normalisation (lower
    case, canonical composition) gives a character that is neither, as a combining mark, aren't parted from what follows them;
    they and all other chunks are encoded as they are. A text that may hold one of the tokenizer's special tokens is encoded whole.

    Texts of Latin letters are put in lower case at once, and spaces around their ASCII punctuation, which is a border already:
    so fewer distinct chunks are met. Punctuation beside an apostrophe, which may begin an ending, or beside signs beyond ASCII
    stays where it is.
    """

    MARK = "~"
    STOPS = frozenset(".,;:!?")
    WORD = re.compile(r"([^\W\d_]+)([!-/:-@\[-`{-~]*)")
    BEYOND = re.compile("[^\\x00-\u012f\u0131-\u017f]")
    PUNCTUATION = re.compile(r"(?<![^A-Za-z0-9\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u017f \n])([!-&(-/:-@\[-`{-~]++)(?![^A-Za-z0-9\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u017f \n])")

    def __init__(self, file: str) -> None:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        if "/" not in file:
            import public_tokenizers

            file = public_tokenizers.path(file)
        self.tokenizer = Tokenizer.from_file(file)
        self.special = tuple({t.content[:2] for t in self.tokenizer.get_added_tokens_decoder().values()})
        # For words that need neither lower case nor a normal form, and end where spaces are.
        self.bare = Tokenizer.from_file(file)
        self.bare.normalizer = normalizers.Sequence([])
        self.bare.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        self.known: dict[str, bytes] = {"": b""}
        self.mark = self._encode(self.MARK)
        # Which ids end a word: a word of Latin letters has one, its last.
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True

    def _encode(self, text: str, bare: bool = False) -> np.ndarray:
        return np.array((self.bare if bare else self.tokenizer).encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")

    @staticmethod
    def _latin(word: str) -> bool:
        return word.isalpha() and (word.isascii() or (max(word) < "\u0180" and "\u0130" not in word))

    def _learn_words(self, words: list[str]) -> None:
        latin, marked = [], []
        for w in words:
            if self._latin(w):
                latin.append(w)
            elif self.MARK in w:
                self.known[w] = self._encode(w).tobytes()
            else:
                marked.append(w)
        for some, glue in ((latin, " "), (marked, f" {self.MARK} ")):
            for i in range(0, len(some), 4096):
                part = some[i : i + 4096]
                ids = self._encode(glue.join(part), glue == " ")
                if glue == " ":
                    ends, skip = (np.flatnonzero(self.ends[ids]) + 1) * 4, 0
                else:
                    ends, skip = np.append(np.flatnonzero(ids == self.mark[0]), len(ids)) * 4, 4
                raw, at = ids.tobytes(), 0
                for w, end in zip(part, ends.tolist(), strict=True):
                    self.known[w] = raw[at:end]
                    at = end + skip

    def _split(self, chunk: str) -> tuple[str, str]:
        """A word and the punctuation after it, or the chunk and nothing."""
        if chunk.isalpha():
            word, rest = chunk, ""
        elif chunk[:-1].isalpha() and chunk[-1] in self.STOPS:
            word, rest = chunk[:-1], chunk[-1]
        else:
            m = self.WORD.fullmatch(chunk)
            if m is None:
                return chunk, ""
            word, rest = m.groups()
        if self._latin(word):
            return word.lower(), rest
        # Beyond Latin, lowering a word and lowering its letters can differ, and normal forms can end in marks.
        if rest and not (unicodedata.normalize("NFC", word.lower()).isalnum() and unicodedata.normalize("NFC", word).lower().isalnum()):
            return chunk, ""
        return word, rest

    def _spaced(self, text: str) -> str:
        if text.isascii() or not self.BEYOND.search(text):
            return self.PUNCTUATION.sub(r" \1 ", text.lower())
        return text

    def __call__(self, texts: list[str]) -> list[bytes]:
        whole = {i: self._encode(t).tobytes() for i, t in enumerate(texts) if any(m in t for m in self.special)}
        chunks = [[""] if i in whole else self._spaced(t).replace("\n", " ").split(" ") for i, t in enumerate(texts)]
        known = self.known
        fresh = list(set().union(*chunks).difference(known))
        split = [(c.lower(), "") if c.isascii() and c.isalpha() else self._split(c) for c in fresh]
        new = list({w for pair in split for w in pair}.difference(known))
        self._learn_words(new)
        known.update({c: known[w] + known[rest] for c, (w, rest) in zip(fresh, split, strict=True) if c != w})
        out = [whole[i] if i in whole else b"".join(map(known.__getitem__, c)) for i, c in enumerate(chunks)]
        if len(known) > REMEMBERED:
            for c in {*fresh, *new}:
                del known[c]
        return out


def pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, tokenizer: str = TOKENIZER, with_ids: bool = False) -> DataFrame:
    """(id, piece, start, length, ids_crc32 and, if asked for, ids binary), one row a piece."""
    end = np.array([END_ID], "<u4").tobytes()

    def run(texts: list[str]) -> list[pa.Array]:
        held = worker_memory("packing")
        if tokenizer not in held:
            held[tokenizer] = Tokens(tokenizer)
        rows = []
        for ids in (ids for _, step in text_steps(texts, STEP) for ids in held[tokenizer](step)):
            ids += end
            cut = [ids[a : a + 4 * capacity] for a in range(0, len(ids), 4 * capacity)]
            rows.append([{"piece": i, "start": i * capacity, "length": len(c) // 4, "ids_crc32": zlib.crc32(c)} | ({"ids": c} if with_ids else {}) for i, c in enumerate(cut)])
        fields = [("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())] + ([("ids", pa.binary())] if with_ids else [])
        return [pa.array(rows, pa.list_(pa.struct(fields)))]

    kind = "piece: int, start: bigint, length: bigint, ids_crc32: bigint" + (", ids: binary" if with_ids else "")
    return map_texts(docs, text_col, [id_col], run, f"p array<struct<{kind}>>").select(F.col(f"`{id_col}`").alias("id"), F.explode("p").alias("p")).select("id", "p.*")


# ---- The plan ----


def grouped(lengths: list[int], counts: dict[int, int], groups: int) -> list[list[int]]:
    """Descending lengths dealt into groups of about equal numbers of pieces."""
    total = sum(counts[x] for x in lengths)
    out: list[list[int]] = []
    held = 0
    for x in lengths:
        if not out or held >= total * len(out) / groups:
            out.append([])
        out[-1].append(x)
        held += counts[x]
    return out


def best_configuration(sizes: list[int], prices: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The multiset of sizes within the capacity that is worth most: an unbounded knapsack, a size at a time."""
    worth, last = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    for k, (s, v) in enumerate(zip(sizes, prices, strict=True)):
        for a in range(s, capacity + 1, s):
            b = min(a + s, capacity + 1)
            more = worth[a - s : b - s] + v
            better = more > worth[a:b] + 1e-12
            worth[a:b] = np.where(better, more, worth[a:b])
            last[a:b] = np.where(better, k, last[a:b])
    used, room = np.zeros(len(sizes)), int(worth.argmax())
    value = worth[room]
    while last[room] >= 0:
        used[last[room]] += 1
        room -= sizes[last[room]]
    return value, used


def configurations(sizes: list[int], demand: np.ndarray, capacity: int, rounds: int = 400) -> list[tuple[np.ndarray, float]]:
    """(pieces of each size, how often) that meets the demand with about the fewest sequences, by column generation."""
    n = len(sizes)
    basis = np.diag([float(capacity // s) for s in sizes])
    x = demand / np.diag(basis)
    for _ in range(rounds):
        inverse = np.linalg.inv(basis)
        x = inverse @ demand
        value, column = best_configuration(sizes, np.ones(n) @ inverse, capacity)
        if value <= 1 + 1e-7:
            break
        way = inverse @ column
        ratio = np.where(way > 1e-9, x / np.where(way > 1e-9, way, 1), np.inf)
        basis[:, int(ratio.argmin())] = column
    return [(basis[:, j], float(x[j])) for j in range(n)]


@dataclass
class Plan:
    """Runs of pieces of one length: ranks first .. first + count - 1 go to sequences from ``sequence`` on, at ``offset``."""

    capacity: int
    runs: list[tuple[int, int, int, int, int]] = field(default_factory=list)  # length, first, count, sequence, offset
    sequences: int = 0
    used: dict[int, int] = field(default_factory=dict)  # ranks given out, by length
    room: dict[int, list[tuple[int, int]]] = field(default_factory=dict)  # by room left: (sequence, count)
    open_rooms: int = 0  # bit r: there is room r

    def give(self, length: int, count: int, sequence: int, offset: int) -> None:
        first = self.used.get(length, 0)
        self.runs.append((length, first, count, sequence, offset))
        self.used[length] = first + count

    def leave(self, room: int, sequence: int, count: int) -> None:
        if room and count:
            self.room.setdefault(room, []).append((sequence, count))
            self.open_rooms |= 1 << room

    def substitute(self, groups: list[list[int]], left: dict[int, int], found: list[tuple[np.ndarray, float]]) -> None:
        """Whole multiples of the configurations, filled with actual pieces."""
        for column, times in found:
            slots = [g for g, n in enumerate(column.astype(int)) for _ in range(n)]
            todo = int(times + 1e-9)
            while todo and slots:
                # The run ends where a slot's length runs out; slots of one group share its pieces.
                heads: list[int] | None = []
                takes: dict[int, int] = {}
                for g in slots:
                    x = next((x for x in groups[g] if left[x] > takes.get(x, 0)), None)
                    if x is None:
                        heads = None
                        break
                    heads.append(x)
                    takes[x] = takes.get(x, 0) + 1
                if heads is None:
                    break
                count = min(todo, *(left[x] // n for x, n in takes.items()))
                offset = 0
                for x in heads:
                    self.give(x, count, self.sequences, offset)
                    left[x] -= count
                    offset += x
                self.leave(self.capacity - offset, self.sequences, count)
                self.sequences += count
                todo -= count

    def best_fit(self, length: int, count: int) -> None:
        while count:
            fitting = self.open_rooms >> length
            if fitting:
                room = length + (fitting & -fitting).bit_length() - 1
                sequence, n = self.room[room].pop()
                k = min(n, count)
                self.give(length, k, sequence, self.capacity - room)
                if n > k:
                    self.room[room].append((sequence + k, n - k))
                elif not self.room[room]:
                    self.open_rooms &= ~(1 << room)
                self.leave(room - length, sequence, k)
                count -= k
                continue
            each = self.capacity // length
            n = max(1, count // each)
            for k in range(min(each, count)):
                self.give(length, n, self.sequences, k * length)
            filled = min(each, count)
            self.leave(self.capacity - filled * length, self.sequences, n)
            self.sequences += n
            count -= n * filled


def plan(counts: dict[int, int], capacity: int = CAPACITY, groups: tuple[int, ...] = GROUPS) -> Plan:
    """Where the pieces of each length go, from how many there are."""
    return min((_plan(counts, capacity, k) for k in groups), key=lambda p: p.sequences)


def _plan(counts: dict[int, int], capacity: int, groups: int) -> Plan:
    out, left = Plan(capacity), dict(counts)
    large = sorted((x for x in counts if capacity // LARGE_SHARE < x < capacity), reverse=True)
    if large:
        parts = grouped(large, counts, groups)
        demand = np.array([float(sum(counts[x] for x in g)) for g in parts])
        out.substitute(parts, left, configurations([g[0] for g in parts], demand, capacity))
    for x in sorted(left, reverse=True):
        out.best_fit(x, left[x])
    return out


# ---- Packing ----


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, tokenizer: str = TOKENIZER) -> DataFrame:
    """(id, piece, start, length, ids_crc32, sequence_id, offset), one row a piece."""
    spark = docs.sparkSession
    cut = durable(pieces(docs, id_col, text_col, capacity, tokenizer))
    counts = {r.length: r.n for r in cut.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    # One row a length: at most ``capacity`` of them.
    lengths = spark.createDataFrame([(x, -(-n // BUCKET)) for x, n in counts.items()], "length long, buckets long")
    tie = F.xxhash64("id", "piece", "ids_crc32")
    bucketed = cut.join(F.broadcast(lengths), "length").withColumn("bucket", F.pmod(tie, F.col("buckets"))).drop("buckets")
    sizes = bucketed.groupBy("length", "bucket").agg(F.count(F.lit(1)).alias("n"))
    runs = np.array(sorted(plan(counts, capacity).runs), np.int64).reshape(-1, 5)
    sent = spark.sparkContext.broadcast((runs[:, 0] << 40 | runs[:, 1], runs[:, 1], runs[:, 3], runs[:, 4]))

    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("length", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    ranked = bucketed.withColumn("nth", F.row_number().over(Window.partitionBy("length", "bucket").orderBy("id", "piece", "ids_crc32")))
    ranked = ranked.join(starts, ["length", "bucket"]).select("id", "piece", "start", "length", "ids_crc32", (F.col("first") + F.col("nth") - 1).alias("rank"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, firsts, sequences, offsets = sent.value
        for b in batches:
            rank = b.column("rank").to_numpy()
            k = np.searchsorted(keys, b.column("length").to_numpy() << 40 | rank, "right") - 1
            columns = b.columns[:5] + [pa.array(sequences[k] + rank - firsts[k]), pa.array(offsets[k])]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    kind = dict(ranked.dtypes)["id"]
    return ranked.mapInArrow(place, f"id {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long").withColumnRenamed("id", id_col)


def query(docs: DataFrame) -> DataFrame:
    return pack(docs)
