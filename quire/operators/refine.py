"""Document-wide refinement of blocks: branding, cut paragraphs, references, title, outline, front matter."""

from __future__ import annotations

import json
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from quire.functions import text as T

#: Limits in points, characters and shares.
BRANDING = (8, 60, 3, 1.02)
EDGE_SHIFT = 14.0
BODY_WIDTH = 160
SAME_PAGE_GAP = (-3.0, 30.0, 2.6)
LOOK_AHEAD = 4
TITLE_TOP, TITLE_RUN, TITLE_CHARS = 300, 320, (20, 400)
FLOATS = ("figure", "table", "formula", "footnote")
IGNORED = ("header", "footer", "meta", "caption")
NUMBERED_SHARE, LARGER, BAND, IN_BAND = 0.92, 1.3, 1.12, 1.05


def _doc() -> WindowSpec:
    return Window.partitionBy("doc_id")


def _in_order() -> WindowSpec:
    return _doc().orderBy("ord")


def _flag(when: F.Column, name: str) -> F.Column:
    return F.when(when, F.array_append("flags", F.lit(name))).otherwise(F.col("flags"))


def isolate_rails(blocks: DataFrame) -> DataFrame:
    """Text that starts like a bibliographic rail, before the references, is metadata."""
    refs = F.max((T.matches(T.strip(F.col("text")), r"(?i)^(references|bibliography)$")).cast("int")).over(_in_order().rowsBetween(Window.unboundedPreceding, 0))
    rail = (F.col("type") == "text") & (F.length(T.strip(F.col("text"))) >= 10) & (refs == 0) & T.starts_citation(F.col("text"))
    return blocks.withColumn("type", F.when(rail, "meta").otherwise(F.col("type")))


def demote_branding(blocks: DataFrame) -> DataFrame:
    """Short text that a document repeats, no larger than its body, is a running head."""
    short, long, times, ratio = BRANDING
    text = F.col("type") == "text"
    rows = blocks.withColumn("_s", T.strip(F.col("text"))).withColumn("_body", F.median(F.when(text & (F.col("size") > 0), F.col("size"))).over(_doc()))
    rows = rows.withColumn("_n", F.count_if(text).over(Window.partitionBy("doc_id", "_s")))
    hit = F.coalesce(text & F.length("_s").between(short, long) & (F.col("_n") >= times) & (F.col("size") <= F.col("_body") * ratio) & ~F.col("_s").endswith("."), F.lit(False))
    return rows.withColumn("_hit", hit).withColumn("flags", _flag(F.col("_hit"), "running-branding")).withColumn("type", F.when(F.col("_hit"), "header").otherwise(F.col("type"))).drop("_s", "_n", "_body", "_hit")


def _predicates(blocks: DataFrame) -> DataFrame:
    """What the joins ask of each block's text, computed natively beforehand."""
    text = F.col("text")
    return blocks.withColumns({
        "_mid": T.ends_mid_sentence(text), "_opens": T.opens_unit(text), "_label": T.is_figure_label(text), "_head": T.is_running_head(text, F.col("bbox.y1")),
        "_low": T.matches(T.lstrip(text), r"^[a-z(\[]"), "_lower": T.matches(T.lstrip(text), r"^[a-z(]"), "_blank": T.blank(text),
    })


def join_cut_paragraphs(blocks: DataFrame) -> DataFrame:
    """Paragraphs that a page or column break cut in two, joined; order is dense again.

    What a join does changes what the next one sees, so each document is folded in order; the predicates on texts come
    precomputed from native expressions. Documents come one a row, many to a batch, and only what joins look at or change
    leaves Arrow.
    """
    rows = _predicates(blocks)
    changed = [c for c in ("text", "flags", "bbox", "emphasis") if c in blocks.columns]
    seen = ["ord", "type", "page", "column", "size", *changed, "_mid", "_opens", "_label", "_head", "_low", "_lower", "_blank"]
    whole = StructType.fromJson(json.loads(re.sub(r'("(?:nullable|containsNull|valueContainsNull)":)false', r"\1true", blocks.schema.json())))

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = to_arrow_schema(whole)
        for batch in batches:
            docs = batch.column("rows")
            every = pa.RecordBatch.from_struct_array(docs.flatten())
            found = every.select(seen).to_pylist()
            places, kept = [], []
            ends = np.cumsum(docs.value_lengths().to_numpy(zero_copy_only=False)).tolist()
            for start, end in zip([0, *ends[:-1]], ends):
                order = sorted(range(start, end), key=lambda i: found[i]["ord"])
                own = [found[i] for i in order]
                gone = _join(own)
                left = [i for i in range(len(own)) if i not in gone]
                places += [order[i] for i in left]
                kept += [own[i] | {"ord": n} for n, i in enumerate(left)]
            every = every.take(pa.array(places, pa.int64()))
            fresh = {c: pa.array([r[c] for r in kept], kinds.field(c).type) for c in ("ord", *changed)}
            yield pa.RecordBatch.from_arrays([fresh[c] if c in fresh else every.column(c).cast(kinds.field(c).type) for c in kinds.names], schema=kinds)

    docs = rows.groupBy("doc_id").agg(F.collect_list(F.struct(*rows.columns)).alias("rows")).select("rows")
    return docs.mapInArrow(fold, whole)


def _join(rows: list[dict]) -> set[int]:
    """Join a document's blocks, given in order, in place; which ones went into others."""
    for r in rows:
        r["flags"] = r["flags"] if r["flags"] is not None else []
        r |= {c: math.nan for c in ("page", "column", "size") if r[c] is None}  # equal to nothing
    gone: set[int] = set()
    margins = _margins(rows)
    texts = [i for i, r in enumerate(rows) if r["type"] == "text" and not r["_blank"]]
    for at, i in enumerate(texts):
        if i in gone:
            continue
        tail = rows[i]
        cut = "tail-full" in tail["flags"]
        if not (cut or tail["_mid"]):
            continue
        for j in texts[at + 1 : at + 1 + LOOK_AHEAD]:
            verdict = "next" if j in gone else _continues(rows, gone, margins, i, j, cut)
            if verdict == "next":
                continue
            if verdict == "join":
                _merge(tail, rows[j])
                gone.add(j)
            break
    _join_edges(rows, gone)
    return gone


def _margins(rows: list[dict]) -> dict[int, float]:
    """The modal left edge of each page's wide blocks."""
    found: dict[int, list[float]] = {}
    for r in rows:
        if r["type"] in ("text", "heading") and r["bbox"]["x1"] - r["bbox"]["x0"] >= 200:
            found.setdefault(r["page"], []).append(r["bbox"]["x0"])
    return {p: max(sorted(v), key=lambda x: sum(abs(y - x) <= 3.0 for y in v)) for p, v in found.items()}


def _continues(rows: list[dict], gone: set[int], margins: dict[int, float], i: int, j: int, cut: bool) -> str:
    """Whether block j goes on where i stops: join, next (look further) or stop."""
    tail, head = rows[i], rows[j]
    between = [rows[k] for k in range(i + 1, j) if k not in gone and rows[k]["type"] not in IGNORED and not rows[k]["_head"] and not rows[k]["_label"]]
    if between and not (cut and head["_low"] and all(b["type"] in FLOATS for b in between)):
        return "stop"
    a, b = tail["bbox"], head["bbox"]
    if head["page"] == tail["page"]:
        gap = b["y0"] - a["y1"]
        if tail["column"] != head["column"] or gap < SAME_PAGE_GAP[0]:
            return "next"
        if gap > max(SAME_PAGE_GAP[1], tail["size"] * SAME_PAGE_GAP[2]):
            return "stop"
    elif head["page"] == tail["page"] + 1:
        if head["_head"] or b["x1"] - b["x0"] < BODY_WIDTH:
            return "next"
        if abs(b["x0"] - a["x0"]) > EDGE_SHIFT or b["x0"] - margins.get(head["page"], b["x0"]) > 8:
            return "stop"
    else:
        return "stop"
    return "stop" if head["_opens"] or (not cut and not head["_lower"]) else "join"


def _merge(tail: dict, head: dict) -> None:
    before = tail["text"].rstrip() + " "
    if "emphasis" in tail:
        shift = len(before) - (len(head["text"]) - len(head["text"].lstrip()))
        moved = [{**m, "start": m["start"] + shift, "end": m["end"] + shift} for m in head["emphasis"]]
        tail["emphasis"] = [*tail["emphasis"], *moved]
    tail["text"] = f"{before}{head['text'].lstrip()}".strip()
    tail["flags"] = [f for f in tail["flags"] if f != "tail-full"] + (["tail-full"] if "tail-full" in head["flags"] else [])
    box = dict(tail["bbox"])
    tail["bbox"] = box | {"x0": min(box["x0"], head["bbox"]["x0"]), "x1": max(box["x1"], head["bbox"]["x1"])}
    for p in ("_mid", "_blank"):
        tail[p] = head[p]


def _join_edges(rows: list[dict], gone: set[int]) -> None:
    """The last text of a page and the first of the next, whatever floats between them."""
    pages = sorted({r["page"] for r in rows})
    text_of = {p: [i for i, r in enumerate(rows) if i not in gone and r["page"] == p and r["type"] == "text"] for p in pages}
    for p in pages[:-1]:
        tails, heads = [i for i in text_of[p] if i not in gone], text_of.get(p + 1, [])
        if not tails or not heads:
            continue
        tail = rows[tails[-1]]
        if not ("tail-full" in tail["flags"] or tail["_mid"]):
            continue
        first = next((i for i in heads[:3] if not (rows[i]["_head"] or rows[i]["_label"])), None)
        if first is None or not rows[first]["_low"]:
            continue
        b = rows[first]["bbox"]
        if abs(b["x0"] - tail["bbox"]["x0"]) <= EDGE_SHIFT and b["x1"] - b["x0"] >= BODY_WIDTH:
            box = tail["bbox"]
            _merge(tail, rows[first])
            tail["bbox"] = box
            gone.add(first)


def mark_references(blocks: DataFrame) -> DataFrame:
    """The first short block that says so heads the references; entries after it are of that type."""
    title = (F.length(T.strip(F.col("text"))) <= 40) & T.matches(F.col("text"), r"(?i)^\s*(references|bibliography)\s*$")
    at = F.min(F.when(title, F.col("ord"))).over(_doc())
    rows = blocks.withColumn("_at", at)
    year = T.matches(F.col("text"), r"(?U)\b(19|20)\d{2}\b")
    entry = F.col("type").isin("text", "footnote") & (F.col("ord") > F.col("_at")) & year & (T.starts_reference(F.col("text")) | T.strip(F.col("text")).startswith("["))
    head = F.col("ord") == F.col("_at")
    kind = F.when(head, "heading").when(entry, "reference").otherwise(F.col("type"))
    return rows.withColumn("level", F.when(head, 1).otherwise(F.col("level"))).withColumn("type", kind).drop("_at")


def is_title_candidate() -> F.Column:
    s = T.strip(F.col("text"))
    fit = (F.col("page") == 0) & (F.col("bbox.y0") < TITLE_TOP) & F.length(s).between(*TITLE_CHARS) & F.col("type").isin("text", "heading")
    return fit & ~F.array_contains("flags", "faint-text") & ~T.is_front_matter(s)


def merge_title(blocks: DataFrame) -> DataFrame:
    """The top-most fitting block of the first page is the title; headings right below it are its further lines.

    The run of lines is a fold over the few headings of the first page; ``title`` marks all blocks of it.
    """
    rows = blocks.withColumn("_fit", is_title_candidate())
    rows = rows.withColumn("_top", F.min_by(F.when(F.col("_fit"), F.struct("id", "bbox")), F.when(F.col("_fit"), F.struct("bbox.y0", "ord"))).over(_doc())).drop("_fit")
    below = (F.col("page") == 0) & (F.col("type") == "heading") & (F.col("id") != F.col("_top.id")) & (F.col("bbox.y0") > F.col("_top.bbox.y0")) & (F.col("bbox.y0") <= TITLE_RUN)
    rows = rows.withColumn("_all", F.array_sort(F.collect_list(F.when(below, F.struct("ord", "id", "bbox", "text"))).over(_doc())))
    start = F.struct(F.col("_top.bbox").alias("last"), F.array().cast("array<string>").alias("ids"))

    def step(acc: F.Column, x: F.Column) -> F.Column:
        gap = x["bbox"]["y0"] - acc["last"]["y1"]
        goes_on = (gap >= 0) & (gap < F.greatest(F.lit(12.0), (acc["last"]["y1"] - acc["last"]["y0"]) * 2.5))
        return F.when(goes_on, F.struct(x["bbox"].alias("last"), F.array_append(acc["ids"], x["id"]).alias("ids"))).otherwise(acc)

    out = rows.withColumn("_more", F.when(F.col("_top").isNotNull(), F.aggregate("_all", start, step)["ids"])).withColumn("_run", F.filter("_all", lambda x: F.array_contains("_more", x["id"])))
    own = F.coalesce(F.col("id") == F.col("_top.id"), F.lit(False))
    further = F.coalesce(F.array_contains("_more", F.col("id")), F.lit(False))
    joined = F.array_join(F.concat(F.array(T.strip(F.col("text"))), F.transform("_run", lambda x: T.strip(x["text"]))), " ")
    edge = lambda c, pick: pick(F.col(f"bbox.{c}"), F.coalesce((F.array_min if pick is F.least else F.array_max)(F.transform("_run", lambda x: x["bbox"][c])), F.col(f"bbox.{c}"))).alias(c)
    box = F.struct(edge("x0", F.least), edge("y0", F.least), edge("x1", F.greatest), edge("y1", F.greatest))
    many = own & F.coalesce(F.size("_run") > 0, F.lit(False))
    out = out.withColumns({
        "text": F.when(many, joined).otherwise(F.col("text")), "bbox": F.when(many, box).otherwise(F.col("bbox")), "flags": _flag(further, "title-continuation"),
        "type": F.when(own, "heading").when(further, "text").otherwise(F.col("type")), "level": F.when(own, 1).when(~further, F.col("level")), "title": own | further,
    })
    return out.drop("_top", "_more", "_run", "_all")


def refine_outline(blocks: DataFrame) -> DataFrame:
    """Headings that are rubrics, banners or list items leave the outline. Expects ``title``."""
    s = T.strip(F.col("text"))
    heading, numbered = F.col("type") == "heading", T.is_section_heading(s)
    rows = blocks.withColumn("_is_numbered", numbered)
    numbered = F.col("_is_numbered")
    rows = rows.withColumns({
        "_body": F.median(F.when((F.col("size") > 0) & (F.length(s) >= 12), F.col("size"))).over(_doc()),
        "_top": F.max(F.when(heading & (F.col("size") > 0), F.col("size"))).over(_doc()),
        "_k": F.count_if(heading & numbered).over(_doc()),
        "_numbered": F.median(F.when(heading & numbered & (F.col("size") > 0), F.col("size"))).over(_doc()),
    })
    letters, size, body = T.count_of(s, "[A-Za-z一-鿿]"), F.col("size"), F.col("_body")
    larger, steps = size >= body * LARGER, F.col("_top") >= body * BAND
    long_enough = (F.length(s) >= 15) | (letters >= 12) | (F.size(F.split(s, r"(?U)\s+")) >= 3)
    rubric = (
        F.array_contains("flags", "faint-text")
        | ((F.length(s) < 14) & (letters < 12) & (F.col("bbox.y0") < 100))
        | (T.is_front_matter(s) & ~larger)
        | ((F.col("_k") >= 2) & ~T.is_structural_label(s))
        | (~larger & ~long_enough)
        | (steps & ~larger & (F.length(s) < 55) & (size < body * IN_BAND))
        | (steps & ~larger & (F.length(s) < 40) & (size < body * BAND))
    )
    ours = heading & ~F.col("title") & body.isNotNull() & F.col("_top").isNotNull()
    item = F.coalesce(ours & numbered & F.col("level").isNotNull() & (size > 0) & (size < F.col("_numbered") * NUMBERED_SHARE), F.lit(False))
    out = F.coalesce(ours & ~numbered & rubric, F.lit(False))
    rows = rows.withColumns({"_item": item, "_out": out})
    item, out = F.col("_item"), F.col("_out")
    changed = {"flags": _flag(item | out, "outline-demoted"), "level": F.when(~(item | out), F.col("level")), "type": F.when(item, "text").when(out, "meta").otherwise(F.col("type"))}
    return rows.withColumns(changed).drop("_body", "_top", "_k", "_numbered", "_is_numbered", "_item", "_out")


def front_matter_first(blocks: DataFrame) -> DataFrame:
    """Where metadata stands between body blocks, it moves before the body."""
    front = F.col("type").isin("meta", "header", "footer")
    seen = F.max((~front).cast("int")).over(_in_order().rowsBetween(Window.unboundedPreceding, 0))
    rows = blocks.withColumn("_front", front).withColumn("_late", F.col("_front") & (seen == 1))
    rows = rows.withColumn("_mixed", F.max("_late").over(_doc()))
    place = _doc().orderBy(F.when(F.col("_mixed") & F.col("_front"), 0).otherwise(1), F.when(F.col("_mixed") & F.col("_front"), F.col("page")), F.when(F.col("_mixed") & F.col("_front"), F.col("bbox.y0")), F.when(F.col("_mixed") & F.col("_front"), F.col("bbox.x0")), "ord")
    return rows.withColumn("ord", F.row_number().over(place) - 1).drop("_front", "_late", "_mixed")


def refine(blocks: DataFrame, hoist: bool = True) -> DataFrame:
    rows = join_cut_paragraphs(demote_branding(isolate_rails(blocks)))
    rows = refine_outline(merge_title(mark_references(rows))).drop("title")
    return front_matter_first(rows) if hoist else rows


def page_edges(blocks: DataFrame) -> DataFrame:
    """Pairs (doc_id, page, tail, head): the last text of a page that stops mid-sentence and a next page that goes on in lower case."""
    texts = blocks.where("type = 'text'")
    ends = texts.groupBy("doc_id", "page").agg(F.max_by("text", "ord").alias("tail"), F.min_by("text", "ord").alias("head"))
    following = F.lead("head").over(Window.partitionBy("doc_id").orderBy("page"))
    after = F.lead("page").over(Window.partitionBy("doc_id").orderBy("page"))
    pairs = ends.withColumn("next_head", following).withColumn("next_page", after).where(F.col("next_page") == F.col("page") + 1)
    return pairs.where(T.ends_mid_sentence(F.col("tail")) & T.matches(T.lstrip(F.col("next_head")), r"^[a-z(\[]")).select("doc_id", "page", "tail", F.col("next_head").alias("head"))


def parse_documents(spans: DataFrame, **beside: DataFrame | str) -> DataFrame:
    """Spans, and what :func:`quire.operators.pages.parse` takes beside them, to refined blocks.

    Metadata between body blocks moves before them in documents with a page whose rail was split off, and where it is mixed in.
    """
    from quire.operators import pages

    return refine(pages.parse(spans, **beside).blocks)
