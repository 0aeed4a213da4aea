"""Near duplicates: an n-gram Jaccard join by MinHash banding.

1. A text's word 5-grams are hashed to a set of 64-bit numbers. Texts with equal sets are one node, whose key is a digest
   of the set; only the counts of copies go on.
2. Each node has a MinHash signature, cut into bands; rows and bands are the largest rows, and the bands they need, that
   find a pair at the threshold with the target recall within ``HASHES`` hashes.
3. Band hashes are shuffled. A bucket links its members to its least one: as many edges as members, not pairs. Connected
   parts of these edges hold every candidate pair.
4. Each part is verified exactly, on full n-gram sets. Sets of a pair at the threshold differ in size by its inverse at most, so a
   part falls into size classes of which only the same and the next are compared. Classes beyond ``TILE`` nodes (or
   ``TILE_CHARS`` characters) are dealt into blocks and verified block against block, so no task holds a large part. A tile
   gives the number of documents that each node is linked to and a spanning forest of its links, never the pairs.
5. Connected parts of the forests are the classes. A document's links are the other documents with similarity of at least
   the threshold, copies included.

Texts move once, compressed, and only those that stand for a node of a part: a sieve (a Bloom filter of bounded size) of
their ids spares the others the shuffle, as one of shared buckets does for band hashes. What passes is joined exactly.

No pair of linked texts is lost but by the band's recall (0.9999 at the threshold, more above). Hot buckets, copies and
classes are aggregated before they are shuffled or salted.

Words are what stands between white space. Defined cases: a null text is empty; texts without words are copies of each
other; a text of fewer than five words has one n-gram, all its words; rows with equal ids are documents each; a null id is
the last choice for a class's id; where texts of a class tie for the least id one of them stays; an empty table gives an empty
table. Only the named columns are read; others pass through :func:`keep_first` whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from math import ceil, log

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.llm.common import Sieve, durable, forget, hot_join, map_texts, salted_join, sieved, spare, text_steps, tuned, worker_memory

WORDS = 5
THRESHOLD = 0.8
RECALL = 0.9999
HASHES = 128
TILE = 512
TILE_CHARS = 4_000_000
#: Words whose hashes a worker remembers.
REMEMBERED = 150_000


def banding(threshold: float = THRESHOLD, recall: float = RECALL, hashes: int = HASHES) -> tuple[int, int]:
    """(bands, rows): the most rows whose bands fit into the hashes."""
    best = (0, 0)
    for rows in range(1, hashes + 1):
        bands = ceil(log(1 - recall) / log(1 - threshold**rows))
        if bands * rows > hashes:
            break
        best = (bands, rows)
    return best


class _WordHashes(dict):
    def __missing__(self, word: str) -> int:
        h = xxhash.xxh3_64_intdigest(word)
        if len(self) < REMEMBERED:
            self[word] = h
        return h


def ngrams(text: str, words: int = WORDS) -> np.ndarray:
    """The sorted distinct hashes of a text's word n-grams."""
    known = worker_memory("near duplicates").setdefault("word_hashes", _WordHashes())
    own = text.split()
    if not own:
        return np.empty(0, np.uint64)
    h = np.array([known[w] for w in own], np.uint64)
    n = min(words, len(h))
    out = np.zeros(len(h) - n + 1, np.uint64)
    for i in range(n):
        out = (out ^ h[i : i + len(out)]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return np.unique(out)


def key_of(grams: np.ndarray) -> bytes:
    return hashlib.blake2b(grams.tobytes(), digest_size=16).digest()


class Signer:
    """Band hashes of n-gram sets."""

    def __init__(self, bands: int, rows: int) -> None:
        self.bands, self.rows = bands, rows
        seeds = np.random.default_rng(20)
        self.a = seeds.integers(0, 1 << 63, bands * rows, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.b = seeds.integers(0, 1 << 63, bands * rows, dtype=np.uint64)

    def __call__(self, grams: np.ndarray) -> np.ndarray:
        least = np.full(len(self.a), np.iinfo(np.uint64).max, np.uint64)
        for i in range(0, len(grams), 1024):
            np.minimum(least, (grams[i : i + 1024, None] * self.a + self.b).min(0), out=least)
        least = least.reshape(self.bands, self.rows)
        out = np.arange(1, self.bands + 1, dtype=np.uint64)
        for r in range(self.rows):
            out = (out ^ least[:, r]) * np.uint64(0xD1342543DE82EF95)
            out ^= out >> np.uint64(32)
        return out.view(np.int64)


def signatures(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, key, size, bands): one row a document; size is that of its n-gram set; no bands for a text without words."""
    bands, rows = banding()

    def run(texts: list[str]) -> list[pa.Array]:
        sign = Signer(bands, rows)
        sets = [ngrams(t) for t in texts]
        return [pa.array([key_of(g) for g in sets], pa.binary()), pa.array([len(g) for g in sets], pa.int64()), pa.array([sign(g) if len(g) else [] for g in sets], pa.list_(pa.int64()))]

    return map_texts(docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text")), "text", ["id"], run, "key binary, size long, bands array<long>")


def components(edges: DataFrame) -> DataFrame:
    """edges (a, b) to (v, label): one vertex of each vertex's connected part.

    Each round draws a new order of the vertices; a vertex takes the first of its neighbours and itself as parent, and edges
    are drawn anew between the parents, of which a constant share of the vertices remains, whatever the shape. Once no edges
    are left the parents are followed back, round by round.
    """
    rounds: list[DataFrame] = []
    edges = durable(_upright(edges.select("a", "b")))
    while edges.limit(1).count():
        drawn = lambda c: F.xxhash64(F.lit(len(rounds)), c)  # noqa: E731, B023
        ends = edges.select(F.col("a").alias("v"), F.col("b").alias("u")).union(edges.select(F.col("b").alias("v"), F.col("a").alias("u")))
        first = ends.groupBy("v").agg(F.min(F.struct(drawn(F.col("u")).alias("h"), "u")).alias("m"))
        parents = durable(first.select("v", F.when(F.struct(drawn(F.col("v")).alias("h"), F.col("v").alias("u")) < F.col("m"), F.col("v")).otherwise(F.col("m.u")).alias("parent")))
        rounds.append(parents)
        up = salted_join(edges, parents.select(F.col("v").alias("b"), F.col("parent").alias("pb")), ["b"], "inner", [F.col("a")])
        up = salted_join(up, parents.select(F.col("v").alias("a"), F.col("parent").alias("pa")), ["a"], "inner", [F.col("b")])
        before, edges = edges, durable(_upright(up.select(F.col("pa").alias("a"), F.col("pb").alias("b"))))
        forget(before)
    if not rounds:
        return durable(edges.withColumnsRenamed({"a": "v", "b": "label"}))
    forget(edges)
    labels = durable(rounds[-1].select("v", F.col("parent").alias("label")))
    for parents in reversed(rounds[:-1]):
        further = labels.select(F.col("v").alias("parent"), "label")
        before, labels = labels, durable(salted_join(parents, further, ["parent"], "left", [F.col("v")]).select("v", F.coalesce("label", "parent").alias("label")))
        forget(before)
    forget(*rounds)
    return labels


def _upright(edges: DataFrame) -> DataFrame:
    return edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def candidate_parts(nodes: DataFrame) -> DataFrame:
    """nodes (node, bands) to (v, label): the parts of nodes that share a band.

    The buckets of a node have leaders; it is joined to the least of them, and they to that: nodes with the same leaders
    draw the same edges between them.
    """
    members = nodes.select("node", F.explode("bands").alias("bucket"))
    shared = durable(members.groupBy("bucket").agg(F.min("node").alias("first"), F.max("node").alias("last")).where("first != last").drop("last"))
    # Most buckets have one member: only members of what may be shared are shuffled again.
    some = members.where(Sieve(shared, "bucket").may_hold(F.col("bucket")))
    leaders = salted_join(some, shared, ["bucket"], "inner", [F.col("node")]).groupBy("node").agg(F.collect_set("first").alias("all"))
    leaders = durable(leaders.withColumn("least", F.array_min("all")))
    own = leaders.select(F.col("node").alias("a"), F.col("least").alias("b"))
    between = leaders.select(F.explode("all").alias("a"), F.col("least").alias("b"))
    parts = components(own.union(between.where("a != b").distinct()))
    forget(shared, leaders)
    return parts


def linked(one: list[np.ndarray], two: list[np.ndarray] | None, threshold: float = THRESHOLD) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs of sets with at least the threshold's similarity: within one list, or between two. By slabs of rows."""
    sets = one + (two or [])
    sizes = np.array([len(s) for s in sets])
    owner = np.repeat(np.arange(len(sets)), sizes)
    _, column, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    common = counts[column] > 1  # others are in no intersection
    owner, column = owner[common], column[common]
    new = np.cumsum(counts > 1) - 1
    column = new[column]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    n, m = len(one), len(two) if two is not None else len(one)
    shared = np.zeros((n, m), np.float32)
    width = 2048
    edges = np.searchsorted(column, np.arange(0, (column[-1] + 1 if len(column) else 0) + width, width))
    for k, (a, b) in enumerate(zip(edges[:-1], edges[1:], strict=True)):
        if a == b:
            continue
        has = np.zeros((len(sets), width), np.float32)
        has[owner[a:b], column[a:b] - k * width] = 1
        shared += has[:n] @ (has[n:] if two is not None else has).T
    least = threshold / (1 + threshold) * (sizes[:n, None] + sizes[None, n:] if two is not None else sizes[:, None] + sizes[None, :])
    hit = shared >= least - 1e-3
    if two is None:
        hit &= np.arange(n)[:, None] < np.arange(m)[None, :]
    yield np.nonzero(hit)


def size_class(size: Column, threshold: float = THRESHOLD) -> Column:
    """Classes of set sizes: those of a pair at the threshold are equal or next to each other."""
    # A little wider than the threshold's inverse, so that no rounding parts a pair.
    return F.floor(F.log(F.greatest(size, F.lit(1))) / F.lit(-log(threshold) + 1e-6)).cast("int")


def _verify(rows: list[tuple], two: bool) -> list[tuple]:
    """rows (side, key, n, text) of a tile, of two blocks or one, to (key, links, other): links of nodes, and edges of a forest."""
    unpack = zstandard.ZstdDecompressor()
    seen: dict[bytes, tuple] = {r[1]: r for r in rows}
    first = [r for r in seen.values() if not r[0]]
    second = [r for r in seen.values() if r[0]]
    sets = [[ngrams(unpack.decompress(r[3]).decode()) for r in side] for side in (first, second)]
    every = first + second
    weight = np.array([r[2] for r in every])
    links, root = np.zeros(len(every), np.int64), list(range(len(every)))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    out: list[tuple] = []
    if len(every) < 2 or two and not (first and second):  # a block's own pairs are another tile's
        return out
    for a, b in linked(sets[0], sets[1] if second else None):
        b = b + len(first) * bool(second)
        np.add.at(links, a, weight[b])
        np.add.at(links, b, weight[a])
        for i, j in zip(a.tolist(), b.tolist()):
            x, y = find(i), find(j)
            if x != y:
                root[max(x, y)] = min(x, y)
    for i in np.flatnonzero(links).tolist():
        r = find(i)
        out.append((every[i][1], int(links[i]), every[r][1] if r != i else None))
    return out


def _texts(docs: DataFrame, parts: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(key, chars, packed, n, size, part): the text of one document, that of id ``first``, for each node of parts."""
    sieve = Sieve(parts.select(F.xxhash64("first").alias("h")), "h")
    sent, level = sieve.sent, 3
    rows = docs.select(*[p.alias(f"p{i}") for i, p in enumerate(sieve.places(F.xxhash64(f"`{id_col}`")))], F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    kind = dict(rows.dtypes)["id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=level)
        for b in batches:
            wanted = pa.array(sieved(sent.value, [b.column(i).to_numpy() for i in range(4)]))
            ids, texts = b.column(4).filter(wanted), b.column(5).filter(wanted).to_pylist()
            for first, step in text_steps(texts):
                columns = [ids.slice(first, len(step)), pa.array([key_of(ngrams(t)) for t in step], pa.binary()), pa.array([len(t) for t in step], pa.int64()), pa.array([pack.compress(t.encode()) for t in step], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=["id", "key", "chars", "packed"])

    tuned(docs.sparkSession)
    texts = rows.mapInArrow(run, f"id {kind}, key binary, chars long, packed binary")
    found = salted_join(texts, parts, ["key"], "inner", [F.col("id")]).where(F.col("id").eqNullSafe(F.col("first")))
    return found.drop("id", "first")


def verified(docs: DataFrame, parts: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """parts (key, first, n, size, part), first being the id of the document that stands for a node, to (key, links, other)."""
    texts = durable(_texts(docs, parts, id_col, text_col).withColumn("cls", size_class(F.col("size"))))
    sizes = texts.groupBy("part", "cls").agg(F.count(F.lit(1)).alias("m"), F.sum("chars").alias("c"))
    sizes = sizes.select("part", "cls", F.greatest(F.ceil(F.col("m") / TILE), F.ceil(F.col("c") / TILE_CHARS)).cast("int").alias("blocks"))
    # A part has as many classes as sizes have, some tens; next ones stand beside each other.
    row = Window.partitionBy("part").orderBy("cls")
    beside = lambda w, step: F.when(w(F.col("cls"), 1).over(row) == F.col("cls") + step, w(F.col("blocks"), 1).over(row)).otherwise(0)
    sizes = sizes.select("part", "cls", "blocks", beside(F.lag, -1).alias("below"), beside(F.lead, 1).alias("above"))
    rows = salted_join(texts, sizes, ["part", "cls"], "inner", [F.col("key")])
    rows = rows.withColumn("own", F.struct("cls", F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int").alias("block")))
    blocks = lambda step, n: F.transform(F.sequence(F.lit(1), n), lambda i: F.struct((F.col("cls") + step).alias("cls"), (i - 1).alias("block")))
    near = [F.when(F.col(n) > 0, blocks(step, F.col(n))).otherwise(F.array().cast("array<struct<cls:int,block:int>>")) for step, n in ((-1, "below"), (0, "blocks"), (1, "above"))]
    rows = rows.withColumn("other", F.explode(F.concat(*near)))
    rows = rows.select("part", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), (F.col("own") > F.col("other")).alias("side"), "key", "n", "packed")
    # A tile's rows come one after the other.
    parts_n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.select("part", F.concat_ws(":", "low.cls", "low.block").alias("low"), F.concat_ws(":", "high.cls", "high.block").alias("high"), "side", "key", "n", "packed")
    dealt = dealt.repartition(parts_n, "part", "low", "high").sortWithinPartitions("part", "low", "high")

    def tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tile: tuple | None = None
        held: list[tuple] = []
        done: list[tuple] = []
        batch_of = lambda found: pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*found), (pa.binary(), pa.int64(), pa.binary()), strict=True)], names=["key", "links", "other"])
        for b in batches:
            for *now, side, key, n, packed in zip(*(c.to_pylist() for c in b.columns)):
                if now != tile:
                    done += _verify(held, tile[1] != tile[2]) if len(held) > 1 else []
                    tile, held = now, []
                held.append((side, key, n, packed))
            if len(done) > 4096:
                yield batch_of(done)
                done = []
        done += _verify(held, tile[1] != tile[2]) if len(held) > 1 else []
        if done:
            yield batch_of(done)

    found = durable(dealt.mapInArrow(tiles, "key binary, links long, other binary"))
    forget(texts)
    return found


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """Documents (id, key) and nodes (key, n, class_id, stays, links, linked), both written down.

    ``class_id`` is the least id of a class, which other classes may have too; ``stays`` is true of one node of each class, that
    has a document of this id; ``linked`` of nodes with links to other nodes.
    """
    tuned(docs.sparkSession)
    signed = durable(signatures(docs, id_col, text_col))
    nodes = durable(signed.groupBy("key").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n"), F.first("size").alias("size"), F.first("bands").alias("bands")))
    # Candidate parts are of 64 bits of the key: a collision can only make a part larger.
    node = F.conv(F.hex(F.substring("key", 1, 8)), 16, -10).cast("long").alias("node")
    parts = candidate_parts(nodes.where(F.size("bands") > 0).select(node, "bands"))
    in_parts = durable(nodes.select("key", "first", "n", "size", node).join(parts.select(F.col("v").alias("node"), F.col("label").alias("part")), "node").drop("node"))
    found = verified(docs, in_parts, id_col, text_col)
    labels = components(found.where("other IS NOT NULL").select(F.col("key").alias("a"), F.col("other").alias("b")))
    links = found.groupBy("key").agg(F.sum("links").alias("links"))
    own = nodes.select("key", "first", "n").join(links, "key").join(labels.select(F.col("v").alias("key"), "label"), "key")
    least = own.groupBy("label").agg(F.min(F.struct(F.col("first").isNull().alias("null"), "first", "key")).alias("least"))
    linked = salted_join(own, least, ["label"], "inner", [F.col("key")]).select("key", F.col("least.first").alias("class_id"), (F.col("least.key") == F.col("key")).alias("stays"), "links", F.lit(True).alias("linked"))
    # Most nodes have no links; the few that do are joined to all, one row a key on both sides.
    every = nodes.select("key", "first", "n").join(linked, "key", "left")
    own_id = F.when(F.col("linked"), F.col("class_id")).otherwise(F.col("first"))
    out = durable(every.select("key", "n", own_id.alias("class_id"), F.coalesce("stays", F.lit(True)).alias("stays"), (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("linked", F.lit(False)).alias("linked")))
    forget(nodes, parts, in_parts, found, labels)
    return signed, out


def join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, class_id, n_links), one row a document."""
    members, nodes = classes(docs, id_col, text_col)
    out = hot_join(members.select("id", "key"), nodes.select("key", "n", "class_id", "n_links"), "key", "n", [F.col("id")])
    return out.select(F.col("id").alias(id_col), "class_id", "n_links")


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one document of each class: that of the least id, once if it is repeated.

    Documents whose id is surely none that goes stay as they are; only the others move. Their ids decide, unless a document
    that goes shares its id with one that stays: then their n-grams do.
    """
    signed, nodes = classes(docs, id_col, text_col)
    several = nodes.where("n > 1 OR linked").select("key", "n", "class_id", "stays")
    members = hot_join(signed.select("id", "key"), several, "key", "n", [F.col("id")])
    stays = F.col("stays") & F.col("id").eqNullSafe(F.col("class_id"))
    counted = members.select("id", "key", stays.alias("stays")).groupBy("id", "key", "stays").agg(F.count(F.lit(1)).alias("copies"))
    gone = durable(counted.where("NOT stays OR copies > 1"))
    twice = gone.where("stays").limit(1).count() > 0
    ids = durable(gone.groupBy("id").agg(F.sum(F.when(~F.col("stays"), F.col("copies")).otherwise(0)).alias("going")))
    rows = salted_join(signed.select("id", "key"), ids, ["id"], "inner", [F.col("key")], 8).groupBy("id").agg(F.count(F.lit(1)).alias("rows"), F.first("going").alias("going"))
    shared = ids.where("id IS NULL").limit(1).count() > 0 or rows.where("going < rows").limit(1).count() > 0

    sieve = Sieve(ids.select(F.xxhash64("id").alias("h")), "h")
    may = spare(docs.columns, "may")
    own = F.col(f"`{id_col}`")
    flagged = docs.withColumn(may, sieve.may_hold(F.xxhash64(own)))
    names = [F.col(f"`{c}`") for c in docs.columns]
    sure, unsure = flagged.where(~F.col(f"`{may}`")).select(*names), flagged.where(F.col(f"`{may}`"))
    if not shared:
        key = spare(docs.columns, "gone_id")
        few = ids.select(F.col("id").alias(key))
        return sure.unionAll(salted_join(unsure.withColumn(key, own), few, [key], "left_anti", [F.col(f"`{text_col}`")], 8).select(*names))

    @F.pandas_udf("binary")
    def key_of_text(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: key_of(ngrams(t or "")))

    key = spare([*docs.columns, may], "key")
    others = [spare([*docs.columns, key, may], c) for c in ("class_id", "stays")]
    unsure = unsure.withColumn(key, key_of_text(F.col(f"`{text_col}`").cast("string")))
    decided = salted_join(unsure, several.select(F.col("key").alias(key), F.col("class_id").alias(others[0]), F.col("stays").alias(others[1])), [key], "left", [own])
    kept = decided.where(F.col(others[1]).isNull() | F.col(others[1]) & own.eqNullSafe(F.col(others[0])))
    if twice:  # of rows with equal ids and n-grams one stays
        kept = kept.dropDuplicates([key])
    return sure.unionAll(kept.select(*names))


def query(docs: DataFrame) -> DataFrame:
    return join(docs)


#: All pairs of n-gram sets, and a closure over the links.
ORACLE_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '\s+'), lambda x: x <> '') AS w FROM documents),
grams AS (
  SELECT doc_id, CASE WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS g FROM w),
each AS (SELECT doc_id, unnest(g) AS g FROM grams),
sizes AS (SELECT doc_id, len(g) AS n FROM grams),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM each a JOIN each b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM pairs p JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 9 * p.n >= 4 * (x.n + y.n)),
reach(a, b) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
classes AS (SELECT a AS doc_id, min(b) AS class_id FROM reach GROUP BY a),
counts AS (SELECT a AS doc_id, count(*) AS n FROM links GROUP BY a)
SELECT doc_id, class_id, coalesce(n, 0)::BIGINT AS n_links FROM classes LEFT JOIN counts USING (doc_id)
"""
