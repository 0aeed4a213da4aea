"""BM25 retrieval over blocks, search, and the assembly of contexts for a question."""

from __future__ import annotations

from collections import Counter
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions import text as T

#: BM25's parameters, the types it ranks, and the limits of contexts.
K1, B = 1.4, 0.72
RANKED_TYPES = ("text", "heading", "caption", "table")
ABSTRACT_PAGES = 1
ABSTRACTS = 2
CONTEXT_LEAST = 6
CONTEXT_CHARS = 1800
EVIDENCE_CHARS = 160
EVIDENCE_FALLBACK = 3


def question_terms(question: str) -> list[str]:
    """The tokens of a question: the same rule as :func:`quire.functions.text.tokens`."""
    import re

    out: list[str] = []
    for w in re.findall(T.TOKEN, question):
        if w[0].isascii():
            out.append(w.lower())
        else:
            out += [w] if len(w) == 1 else [w[i : i + 2] for i in range(len(w) - 1)]
    return out


def bm25(units: DataFrame, question: str, text_col: str = "text", scope: Sequence[str] = (), kept: Column | None = None) -> DataFrame:
    """units with ``score``, of those where it is above 0.

    Term frequencies are counted in the row, so postings are never exploded; what is aggregated is one row a scope. A term
    that the question repeats counts again. Without terms every unit has score 0 and stays.
    """
    terms = Counter(question_terms(question))
    scope = list(scope)
    rows = units if kept is None else units.where(kept)
    tokens = T.tokens(F.col(text_col))
    # Tokens hold no spaces, so between two of them each can be counted as a string.
    rows = rows.withColumn("_t", tokens).withColumns({"_len": F.size("_t"), "_t": F.concat(F.lit(" "), F.array_join("_t", "  "), F.lit(" "))})
    frequency = [_occurrences(F.col("_t"), w).alias(f"_f{i}") for i, w in enumerate(terms)]
    rows = rows.select(*units.columns, "_len", *frequency)
    if not terms:
        return rows.select(*units.columns, F.lit(0.0).alias("score"))
    keys = [F.col(c) for c in scope] or [F.lit(0).alias("_all")]
    stats = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.avg("_len").alias("_avg"), *[F.count_if(F.col(f"_f{i}") > 0).alias(f"_d{i}") for i in range(len(terms))])
    # Without a scope the statistics are a single row.
    joined = rows.join(stats, scope) if scope else rows.withColumn("_all", F.lit(0)).join(F.broadcast(stats), "_all")
    length = F.greatest(F.col("_len"), F.lit(1))
    score = F.lit(0.0)
    for i, times in enumerate(terms.values()):
        f, d = F.col(f"_f{i}"), F.col(f"_d{i}")
        idf = F.log(1 + (F.col("_n") - d + 0.5) / (d + 0.5))
        part = idf * (f * (K1 + 1)) / (f + K1 * (1 - B + B * length / F.col("_avg")))
        score = score + F.when(f > 0, part * times).otherwise(F.lit(0.0))
    return joined.withColumn("score", score).where("score > 0").select(*units.columns, "score")


def _occurrences(joined: Column, term: str) -> Column:
    marked = f" {term} "
    return ((F.octet_length(joined) - F.octet_length(F.replace(joined, F.lit(marked), F.lit("")))) / len(marked.encode())).cast("int")


def top_k(scored: DataFrame, k: int, order: Sequence[str], scope: Sequence[str] = ()) -> DataFrame:
    """The k best of each scope, ties in reading order, with ``rank`` from 1."""
    by = [F.col("score").desc(), *[F.col(c) for c in order]]
    if not scope:
        best = scored.orderBy(*by).limit(k)
        return best.withColumn("rank", F.row_number().over(Window.orderBy(*by)))
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy(*scope).orderBy(*by))).where(F.col("rank") <= k)


def retrieval_text(blocks: DataFrame, variants: DataFrame, provider: str, on: Sequence[str] = ("doc_id", "block_id")) -> DataFrame:
    """blocks with ``match_text``: the newest translation by the provider, else the newest of any, else the original."""
    usable = variants.where(~T.blank(F.col("text")))
    own = F.max_by(F.when(F.col("provider") == provider, F.col("text")), F.when(F.col("provider") == provider, F.col("seq")))
    best = usable.groupBy(*on).agg(own.alias("_own"), F.max_by("text", "seq").alias("_any"))
    return blocks.join(best, list(on), "left").withColumn("match_text", F.coalesce("_own", "_any", "text")).drop("_own", "_any")


def search(blocks: DataFrame, needle: str, translations: str | None = None) -> DataFrame:
    """Blocks, but meta, whose text or any translation (a map column) has the needle, in any case."""
    wanted = needle.strip().lower()
    hit = F.lower("text").contains(wanted)
    if translations:
        hit = hit | F.exists(F.map_values(translations), lambda t: F.lower(t).contains(wanted))
    return blocks.where((F.col("type") != "meta") & F.coalesce(hit, F.lit(False))) if wanted else blocks.limit(0)


def cycle(index: Column, step: int, n: Column) -> Column:
    """The next hit, around the end."""
    return F.when(n > 0, F.pmod(index + step, n))


def contexts(blocks: DataFrame, question: str, k: int, requested: Sequence[str] = (), id_col: str = "id") -> DataFrame:
    """For each document the blocks handed to the model: requested, abstract, then ranked; cut to max(k + 2, 6)."""
    at = F.array_position(F.array(*[F.lit(r) for r in requested]), F.col(id_col)) if requested else F.lit(0)
    chosen = blocks.where(at > 0).withColumn("_class", F.lit(0)).withColumn("_by", at.cast("double"))
    opening = F.lower(F.substring("text", 1, 40))
    abstract = (F.col("page") <= ABSTRACT_PAGES) & (F.col("type") == "text") & (opening.contains("abstract") | opening.contains("摘要") | (F.length("text") > 400))
    first = Window.partitionBy("doc_id").orderBy("ord")
    abstracts = blocks.where(abstract & (at == 0)).withColumn("_n", F.row_number().over(first)).where(F.col("_n") <= ABSTRACTS).drop("_n")
    abstracts = abstracts.withColumn("_class", F.lit(1)).withColumn("_by", F.col("ord").cast("double"))
    ranked = bm25(blocks, question, scope=["doc_id"], kept=F.col("type").isin(*RANKED_TYPES) & ~T.blank(F.col("text")))
    ranked = top_k(ranked, k, ["ord"], ["doc_id"]).join(chosen.unionByName(abstracts).select("doc_id", id_col), ["doc_id", id_col], "left_anti")
    ranked = ranked.withColumn("_class", F.lit(2)).withColumn("_by", F.col("rank").cast("double")).drop("score", "rank")
    every = chosen.unionByName(abstracts).unionByName(ranked.select(*chosen.columns))
    place = Window.partitionBy("doc_id").orderBy("_class", "_by", "ord")
    # The ranking only fills up what requested and abstract blocks leave of k.
    held = F.count_if(F.col("_class") < 2).over(Window.partitionBy("doc_id"))
    out = every.withColumn("position", F.row_number().over(place)).withColumn("_held", held)
    out = out.where(((F.col("_class") < 2) | (F.col("_held") < k)) & (F.col("position") <= max(k + 2, CONTEXT_LEAST)))
    return out.withColumn("context", F.substring("text", 1, CONTEXT_CHARS)).drop("_class", "_by", "_held")


def evidence(cited: DataFrame, chosen: DataFrame, id_col: str = "id") -> DataFrame:
    """Cited blocks that were in the contexts; for a document without any, its first three contexts."""
    good = cited.join(chosen.select("doc_id", id_col, "page", "text", "position"), ["doc_id", id_col]).select("doc_id", id_col, "page", F.coalesce("quote", F.substring("text", 1, EVIDENCE_CHARS)).alias("quote"))
    spare = chosen.where(F.col("position") <= EVIDENCE_FALLBACK).join(good.select("doc_id").distinct(), "doc_id", "left_anti")
    return good.unionByName(spare.select("doc_id", id_col, "page", F.substring("text", 1, EVIDENCE_CHARS).alias("quote")))
