"""Regions of a page: tables without grids, figures with captions, display equations; their joins with lines."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions import text as T
from quire.operators.layout import PAGE

#: Limits in points, characters and shares.
INSIDE_TABLE, INSIDE_EQUATION = 0.55, 0.95
EQUATION_PAD = (-10.0, -8.0, 12.0, 8.0)
CAPTION_GAP = 90.0
FIGURE_LEAST, FIGURE_SHARE = 8.0, 0.012
BASELINE = 2.5
ROW_STEP = (6.0, 26.0)
ROW_CHARS, CELL_CHARS, CELL_WORDS, PROSE_PAIR, CELL_GAP = 140, 70, 8, 26, 12.0
LEAST_ROWS = 3
ALIGNED_GRID, ALIGNED_SHARE = 12.0, 0.6
TAIL_PITCH = 2.4
KEPT_TEXT = 0.8
ANCHOR_WINDOW = (22.0, 6.0)
BAND_STEP, BAND_LINES, BAND_FORMULAS, BAND_SHARE = 16.0, 14, 3, 0.5
EQUATION_LEAST, EQUATION_WIDTH, EQUATION_APART = 5.0, 1.2, 3.0
TRIM_GAP, TRIM_LEAST = 6.0, (30.0, 4.0)
CROP_PAD = (-8.0, -6.0, 10.0, 6.0)


def overlap(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(a1, b1) - F.greatest(a0, b0))


def share_inside(a: Sequence[Column], b: Sequence[Column]) -> Column:
    """The share of box a (x0, y0, x1, y1) that lies in box b."""
    area = F.greatest(F.lit(1e-6), (a[2] - a[0]) * (a[3] - a[1]))
    return overlap(a[0], a[2], b[0], b[2]) * overlap(a[1], a[3], b[1], b[3]) / area


def members(lines: DataFrame, regions: DataFrame, share: float = INSIDE_TABLE, pad: Sequence[float] = (0, 0, 0, 0), keys: Sequence[str] = PAGE) -> DataFrame:
    """lines with ``region``: the first region of the page that holds enough of the line, else null."""
    sides = ("x0", "y0", "x1", "y1")
    # Of equal boxes only the first counts; a page has few others.
    distinct = regions.groupBy(*keys, *sides).agg(F.min("region").alias("region"))
    per_page = distinct.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("region", *sides))).alias("_all"))
    hit = lambda r: share_inside([F.col(c) for c in sides], [r[c] + p for c, p in zip(sides, pad, strict=True)]) >= share
    return lines.join(per_page, list(keys), "left").withColumn("region", F.try_element_at(F.filter("_all", hit), F.lit(1))["region"]).drop("_all")


def nearest_caption(figures: DataFrame, captions: DataFrame, keys: Sequence[str] = PAGE, gap: float = CAPTION_GAP) -> DataFrame:
    """figures with ``caption``: the page's nearest caption above or below, less than a gap away; of equals the first.

    A page's heights and captions are looked at together, sorted, and never as pairs. Sides that are null are open.
    """
    names = {k: f"_k{i}" for i, k in enumerate(keys)}
    heights = [F.col(c).cast("double").alias(f"_{c}") for c in ("y0", "y1")]
    own = [F.col(k).alias(n) for k, n in names.items()]
    number = ~F.isnan(F.coalesce("_y0", F.lit(0.0))) & ~F.isnan(F.coalesce("_y1", F.lit(0.0)))
    spots = figures.select(*own, *heights).where(number).distinct()
    some = captions.dropna(subset=list(keys))
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy("ord", "text"))
    some = some.select(*own, *heights, rank.alias("_rank"), "text").where(number)
    kinds = dict(spots.dtypes)
    schema = ", ".join(f"{n} {kinds[n]}" for n in names.values()) + ", _y0 double, _y1 double, caption string"

    def fold(page: pd.DataFrame, near: pd.DataFrame) -> pd.DataFrame:
        found = _nearest(*_open(page), *_open(near), near["_rank"].to_numpy(), gap)
        text = dict(zip(near["_rank"], near["text"]))
        return page.assign(caption=[text.get(r) for r in found])[[*names.values(), "_y0", "_y1", "caption"]]

    near = spots.groupBy(*names.values()).cogroup(some.groupBy(*names.values())).applyInPandas(fold, schema)
    near = near.where("caption IS NOT NULL").withColumnsRenamed({"_y0": "_top", "_y1": "_bottom"})
    same = [F.col(k) == F.col(n) for k, n in names.items()] + [F.col(c).cast("double").eqNullSafe(F.col(n)) for c, n in (("y0", "_top"), ("y1", "_bottom"))]
    on = same[0]
    for s in same[1:]:
        on = on & s
    return figures.join(near, on, "left").drop(*names.values(), "_top", "_bottom")


def _open(rows: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Tops and bottoms, infinite where there is none."""
    return rows["_y0"].fillna(-np.inf).to_numpy(float), rows["_y1"].fillna(np.inf).to_numpy(float)


def _nearest(top: np.ndarray, bottom: np.ndarray, c_top: np.ndarray, c_bottom: np.ndarray, c_rank: np.ndarray, gap: float) -> list[int | None]:
    """For each height the rank of the nearest caption less than ``gap`` away, the least of equals.

    Boxes whose bottom is above their top, of which pages have none, are looked at one by one. For others: the least rank of captions that touch a height comes from a tree over their bottoms, to which they are added by their
    tops; the next one below, or above, is the next in order.
    """
    best: list[tuple[float, int] | None] = [None] * len(top)
    odd, c_odd = bottom < top, c_bottom < c_top
    for i in range(len(top)) if c_odd.any() else np.flatnonzero(odd).tolist():
        seen = slice(None) if odd[i] else c_odd
        d = np.maximum(np.maximum(c_top[seen] - bottom[i], top[i] - c_bottom[seen]), 0.0)
        if len(d) and d.min() < gap:
            best[i] = (float(d.min()), int(c_rank[seen][d == d.min()].min()))
    c_top, c_bottom, c_rank = c_top[~c_odd], c_bottom[~c_odd], c_rank[~c_odd]
    by_top = np.argsort(c_top, kind="stable")
    # From the lowest bottom up: the places at or behind a bottom are a prefix of the tree.
    bottoms = np.unique(c_bottom)[::-1]
    place = len(bottoms) - np.searchsorted(bottoms[::-1], c_bottom, "left")
    behind = (len(bottoms) - np.searchsorted(bottoms[::-1], top, "left")).tolist()
    none = np.iinfo(np.int64).max
    tree = [none] * (len(bottoms) + 1)
    tops, places, ranks = c_top[by_top].tolist(), place[by_top].tolist(), c_rank[by_top].tolist()
    added = 0
    for i in np.argsort(bottom, kind="stable").tolist():
        while added < len(tops) and tops[added] <= bottom[i]:
            at = places[added]
            while at < len(tree):
                tree[at] = min(tree[at], ranks[added])
                at += at & -at
            added += 1
        at, least = behind[i], none
        while at:
            least = min(least, tree[at])
            at -= at & -at
        if least < none and gap > 0 and not odd[i] and (best[i] is None or (0.0, least) < best[i]):
            best[i] = (0.0, least)
    for places_, away in ((c_top, lambda v, i: v - bottom[i]), (c_bottom, lambda v, i: top[i] - v)):
        lower = places_ is c_top
        order = np.lexsort((c_rank, places_))
        values, first = np.unique(places_[order], return_index=True)
        least = c_rank[order][first]
        starts = np.searchsorted(values, bottom, "right") if lower else np.searchsorted(values, top, "left") - 1
        for i in [i for i, b in enumerate(best) if (b is None or b[0] > 0) and not odd[i]]:
            j, step = int(starts[i]), 1 if lower else -1
            if not 0 <= j < len(values):
                continue
            d, r = away(values[j], i), least[j]
            while 0 <= j < len(values) and away(values[j], i) == d:  # two heights may be as far as doubles tell
                r, j = min(r, least[j]), j + step
            if d < gap and (best[i] is None or (d, r) < best[i]):
                best[i] = (d, int(r))
    return [None if b is None else b[1] for b in best]


def figures(images: DataFrame, tables: DataFrame, texts: DataFrame, captions: DataFrame, page_area: Column) -> DataFrame:
    """Images that are figures: large enough, in no table and under no text; with caption and the name of their crop."""
    width, height = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    rows = images.where((width >= FIGURE_LEAST) & (height >= FIGURE_LEAST) & (width * height >= page_area * FIGURE_SHARE))
    box = lambda df, name: df.groupBy(*PAGE).agg(F.collect_list(F.struct("x0", "y0", "x1", "y1")).alias(name))
    rows = rows.join(box(tables, "_t"), list(PAGE), "left").join(box(texts, "_x"), list(PAGE), "left")
    wide = lambda r: overlap(F.col("x0"), F.col("x1"), r["x0"], r["x1"]) / width
    tall = lambda r: overlap(F.col("y0"), F.col("y1"), r["y0"], r["y1"]) / height
    in_table = F.coalesce(F.exists("_t", lambda r: (wide(r) > 0.5) & (tall(r) > 0.5)), F.lit(False))
    under_text = F.coalesce(F.exists("_x", lambda r: (wide(r) > 0.6) & (tall(r) > 0.8)), F.lit(False))
    rows = nearest_caption(rows.where(~in_table & ~under_text).drop("_t", "_x"), captions)
    number = F.row_number().over(Window.partitionBy(*PAGE).orderBy("y0", "x0"))
    return rows.withColumn("image_path", F.format_string("p%04d_fig%03d.png", F.col("page"), number))


def looks_like_table(box: Sequence[Column], rows: Column, line_widths: Column) -> Column:
    """Large enough, with four filled cells at least, and not just lines of running text in a frame."""
    width = box[2] - box[0]
    sorted_ = F.array_sort(line_widths)
    n = F.size(line_widths)
    median = (F.element_at(sorted_, ((n + 1) / 2).cast("int")) + F.element_at(sorted_, (n / 2).cast("int") + 1)) / 2.0
    text = F.when(n >= 3, median > width * 0.5).otherwise(F.lit(False))
    filled = F.size(F.filter(F.flatten(rows), lambda c: ~T.blank(c)))
    return (width >= 40) & (box[3] - box[1] >= 12) & ~text & (filled >= 4)


def is_pseudo_table(rows: Column) -> Column:
    """Equations with their numbers, reference lists, or columns of prose, taken for a table."""
    has = F.filter(rows, lambda r: F.size(r) > 0)
    left = F.transform(has, lambda r: F.element_at(r, 1))
    right = F.transform(F.filter(rows, lambda r: F.size(r) > 1), lambda r: F.element_at(r, 2))
    n = lambda cells, rule: F.size(F.filter(cells, rule)).cast("double")
    left_n, right_n = F.size(left).cast("double"), F.size(right).cast("double")
    maths = n(left, lambda c: T.matches(c, T.MATH_CHARS)) >= F.greatest(F.lit(2.0), left_n * 0.5)
    numbered = n(left, lambda c: T.matches(T.strip(c), r"^\[?\d{1,3}\]?\.?$")) >= left_n * 0.6
    longish = n(right, lambda c: F.length(c) > 60) >= right_n * 0.6
    long = n(right, lambda c: F.length(c) > 90) >= right_n * 0.6
    prose = n(left, lambda c: (F.length(c) > 60) & (F.size(F.split(T.strip(c), r"(?U)\s+")) >= 8)) >= left_n * 0.6
    return (left_n == 0) | (right_n == 0) | maths | (numbered & longish) | long | prose


def rule_tables(lines: DataFrame) -> DataFrame:
    """Tables that have rules but no grid: (doc_id, page, region, x0, y0, x1, y1, rows).

    Lines on one baseline are a row if they read like cells with a wide gap between; rows in a steady rhythm with aligned
    columns are a table, whose last row may go on in lines below. Baselines depend on the first line of their group and
    tails are taken one by one, so each page is folded in order.
    """

    def fold(page: pd.DataFrame) -> pd.DataFrame:
        ordered = page.assign(_y=page["y0"].round(1)).sort_values(["_y", "x0"]).to_dict("records")
        out = []
        for run in _rhythm(_rows_of(ordered)):
            if len(run) >= LEAST_ROWS and _aligned(run):
                grid, box = [[a[2], b[2]] for _, a, b in run], _box([r[0] for r in run])
                grid, box = _with_tail(ordered, run, grid, box)
                out.append((page["doc_id"].iloc[0], page["page"].iloc[0], len(out), *box, grid))
        return pd.DataFrame(out, columns=["doc_id", "page", "region", "x0", "y0", "x1", "y1", "rows"])

    found = _maybe_ruled(lines.select(*PAGE, "text", "x0", "y0", "x1", "y1")).groupBy(*PAGE).applyInPandas(fold, "doc_id string, page int, region int, x0 double, y0 double, x1 double, y1 double, rows array<array<string>>")
    return found.where(~is_pseudo_table(F.col("rows")))


def _maybe_ruled(lines: DataFrame) -> DataFrame:
    """Lines of pages that may hold a ruled table; other pages aren't folded.

    A row of cells is a pair of lines of which one is short, or has a third line on its baseline; pages with fewer of these
    than a table has rows hold none. Heights are rounded before they are ordered, so the bound is wider by that.
    """
    order = Window.partitionBy(*PAGE).orderBy(F.round("y0", 1), "x0")
    third = F.abs(F.col("y0") - F.lag("y0", 2).over(order)) <= BASELINE + 0.2
    # str.strip takes these separators too.
    short = F.length(F.btrim("text", F.lit(T.WHITE + "\x1c\x1d\x1e\x1f"))) <= PROSE_PAIR
    rows = lines.withColumn("_cell", F.coalesce(short, F.lit(True)) | F.coalesce(third, F.lit(False)))
    return rows.withColumn("_cells", F.count_if("_cell").over(Window.partitionBy(*PAGE))).where(F.col("_cells") >= LEAST_ROWS).drop("_cell", "_cells")


def _box(boxes: list[tuple]) -> tuple:
    return min(b[0] for b in boxes), min(b[1] for b in boxes), max(b[2] for b in boxes), max(b[3] for b in boxes)


def _rows_of(ordered: list[dict]) -> list[tuple]:
    """(box, left cell, right cell) of baselines that read like a row of cells; a cell is (x0, x1, text)."""
    groups: list[list[dict]] = []
    for ln in ordered:
        if groups and abs(groups[-1][0]["y0"] - ln["y0"]) <= BASELINE:
            groups[-1].append(ln)
        else:
            groups.append([ln])
    rows = []
    for g in groups:
        g = sorted(g, key=lambda ln: ln["x0"])
        texts = [ln["text"].strip() for ln in g]
        prose = any(len(t) > CELL_CHARS and len(t.split()) >= CELL_WORDS for t in texts)
        if len(g) < 2 or len(" ".join(texts)) > ROW_CHARS or prose or (len(g) == 2 and min(map(len, texts)) > PROSE_PAIR):
            continue
        gap, k = max((b["x0"] - a["x1"], i) for i, (a, b) in enumerate(zip(g, g[1:])))
        if gap >= CELL_GAP:
            cell = lambda part: (part[0]["x0"], part[-1]["x1"], " ".join(ln["text"].strip() for ln in part))
            rows.append((_box([(ln["x0"], ln["y0"], ln["x1"], ln["y1"]) for ln in g]), cell(g[: k + 1]), cell(g[k + 1 :])))
    return rows


def _rhythm(rows: list[tuple]) -> list[list[tuple]]:
    runs: list[list[tuple]] = []
    for r in rows:
        if runs and ROW_STEP[0] <= r[0][1] - runs[-1][-1][0][1] <= ROW_STEP[1]:
            runs[-1].append(r)
        else:
            runs.append([r])
    return runs


def _aligned(run: list[tuple]) -> bool:
    for side in (1, 2):
        starts = [round(r[side][0] / ALIGNED_GRID) for r in run]
        if max(map(starts.count, starts)) >= len(run) * ALIGNED_SHARE:
            return True
    return False


def _with_tail(ordered: list[dict], run: list[tuple], grid: list[list[str]], box: tuple) -> tuple[list[list[str]], tuple]:
    """Single lines right below the last row, each under one of its cells, belong to that cell; all of them or none."""
    steps = sorted(b[0][1] - a[0][1] for a, b in zip(run, run[1:]))
    pitch = steps[len(steps) // 2]
    last, left, right = run[-1]
    below = [ln for ln in ordered if last[1] + BASELINE < ln["y0"] <= last[1] + TAIL_PITCH * pitch]
    cells, boxes = [grid[-1][0], grid[-1][1]], [box]
    for ln in below:
        side = next((i for i, c in enumerate((left, right)) if abs(ln["x0"] - c[0]) <= ALIGNED_GRID), None)
        if side is None or ln["text"].strip() in cells:
            return grid, box
        cells[side] += " " + ln["text"].strip()
        boxes.append((ln["x0"], ln["y0"], ln["x1"], ln["y1"]))
    return [*grid[:-1], cells], _box(boxes)


def kept_tables(lines: DataFrame, tables: DataFrame) -> DataFrame:
    """Tables whose cells hold at least four fifths of the text of the lines they cover; else the lines stay text."""
    inside = members(lines, tables).where("region IS NOT NULL").groupBy(*PAGE, "region").agg(F.sum(F.length(F.regexp_replace("text", r"(?U)\s+", ""))).alias("_taken"))
    cells = F.length(F.regexp_replace(F.array_join(F.flatten("rows"), ""), r"(?U)\s+", ""))
    return tables.join(inside, [*PAGE, "region"], "left").where(F.coalesce(cells >= F.col("_taken") * KEPT_TEXT, F.lit(True))).drop("_taken")


EQUATIONS = "doc_id string, page int, region int, x0 double, y0 double, x1 double, y1 double, number string, crop struct<x0:double,y0:double,x1:double,y1:double>"


def equation_regions(lines: DataFrame) -> DataFrame:
    """Display equations: (doc_id, page, region, box, number, crop), of lines that no table has taken.

    A number like (3) stands beside its equation: the formula lines around it, and what is left of it, are a region. Where there
    are no numbers, dense runs of formula lines are. A region takes in whole lines; one that overlaps an earlier region is none.
    ``crop`` leaves lines of prose out, where the formula lines are a run of their own.

    What a line is has been decided natively; which regions stand depends on those before, so a page is folded in order.
    """
    text = T.strip(F.col("text"))
    width = F.col("page_width") if "page_width" in lines.columns else F.lit(float("inf"))
    rows = lines.select(*PAGE, "x0", "y0", "x1", "y1", width.alias("width"), T.is_formula_line(text).alias("formula"), T.is_prose(text).alias("prose"), F.regexp_extract(text, r"^\(\s*(\d{1,3})\s*\)$", 1).alias("number"))
    # Pages without formula lines enough for a run, or one and a number, aren't folded.
    page = Window.partitionBy(*PAGE)
    rows = rows.withColumns({"_formulas": F.count_if("formula").over(page), "_numbers": F.count_if(F.col("number") != "").over(page)})
    rows = rows.where((F.col("_formulas") >= BAND_FORMULAS) | ((F.col("_formulas") > 0) & (F.col("_numbers") > 0))).drop("_formulas", "_numbers")

    def fold(page: pd.DataFrame) -> pd.DataFrame:
        page = page.sort_values(["y0", "x0"], ignore_index=True)
        out = []
        for rank, (inside, number) in enumerate(_equations_of(page)):
            box = [float(f(page.loc[inside, c])) for c, f in (("x0", min), ("y0", min), ("x1", max), ("y1", max))]
            crop = _without_prose(page, box)
            padded = [max(0.0, crop[0] + CROP_PAD[0]), max(0.0, crop[1] + CROP_PAD[1]), crop[2] + CROP_PAD[2], crop[3] + CROP_PAD[3]]
            out.append((page["doc_id"].iloc[0], page["page"].iloc[0], rank, *box, number, dict(zip(("x0", "y0", "x1", "y1"), padded, strict=True))))
        return pd.DataFrame(out, columns=["doc_id", "page", "region", "x0", "y0", "x1", "y1", "number", "crop"])

    return rows.groupBy(*PAGE).applyInPandas(fold, EQUATIONS)


def _equations_of(page: pd.DataFrame) -> list[tuple[pd.Series, str]]:
    """(lines inside, number) of each region, numbered ones first, in order."""
    found: list[tuple[pd.Series, str]] = []
    taken: list[tuple[float, float]] = []

    def offer(members: pd.Series, number: str) -> None:
        top, bottom = page.loc[members, "y0"].min(), page.loc[members, "y1"].max()
        inside = (page["y0"] <= bottom + 2) & (page["y1"] >= top - 2)
        own = page[inside]
        width, height = own["x1"].max() - own["x0"].min(), own["y1"].max() - own["y0"].min()
        fits = min(width, height) >= EQUATION_LEAST and width <= page["width"].iloc[0] * EQUATION_WIDTH
        if fits and all(own["y1"].max() < a - EQUATION_APART or own["y0"].min() > b + EQUATION_APART for a, b in taken):
            taken.append((own["y0"].min(), own["y1"].max()))
            found.append((inside, number))

    for i in page.index[page["number"] != ""]:
        anchor = page.loc[i]
        near = page["y0"].between(anchor["y0"] - ANCHOR_WINDOW[0], anchor["y1"] + ANCHOR_WINDOW[1]) & (page.index != i)
        likely = near & (page["formula"] | (page["x0"] < anchor["x0"]))
        members = likely if likely.any() else near
        if members.any():
            offer(members | (page.index == i), anchor["number"])
    for band in _bands(page["y0"].tolist(), page["formula"].tolist()):
        formulas = int(page.loc[band, "formula"].sum())
        if formulas >= BAND_FORMULAS and formulas >= len(band) * BAND_SHARE:
            offer(page.index.isin(band), "")
    return found


def _bands(tops: list[float], formula: list[bool]) -> list[list[int]]:
    """Runs of lines, from a formula line on, in steps of ``BAND_STEP`` at most; prose ends one that has formulas enough."""
    bands: list[list[int]] = []
    open_ = False
    for i, (y, f) in enumerate(zip(tops, formula, strict=True)):
        band = bands[-1] if open_ else []
        if open_ and (y - tops[band[-1]] > BAND_STEP or len(band) >= BAND_LINES or (not f and sum(formula[j] for j in band) >= BAND_FORMULAS)):
            open_ = False
        if open_:
            band.append(i)
        elif f:
            bands.append([i])
            open_ = True
    joined: list[list[int]] = []
    for band in bands:  # what a short line had cut is one again
        if joined and 0 <= tops[band[0]] - tops[joined[-1][-1]] <= BAND_STEP:
            joined[-1] += band
        else:
            joined.append(band)
    return joined


def _without_prose(page: pd.DataFrame, box: list[float]) -> list[float]:
    """The box cut down to its longest run of lines that aren't prose; the box itself where that doesn't part them."""
    x0, y0, x1, y1 = box
    own = page[(page["y0"] >= y0 - 3) & (page["y1"] <= y1 + 3) & (page["x0"] >= x0 - 3) & (page["x1"] <= x1 + 3)]
    prose, maths = own[own["prose"]], own[~own["prose"]]
    if prose.empty or maths.empty:
        return box
    run = (maths["y0"] - maths["y1"].shift() > TRIM_GAP).cumsum()
    best = maths[run == run.value_counts(sort=False).idxmax()]
    top, bottom = float(best["y0"].min()), float(best["y1"].max())
    mixed = ((prose["y0"] >= top - 3) & (prose["y1"] <= bottom + 3)).any()
    return box if x1 - x0 < TRIM_LEAST[0] or bottom - top < TRIM_LEAST[1] or mixed else [x0, top, x1, bottom]


def in_equations(lines: DataFrame, found: DataFrame) -> DataFrame:
    """lines with ``region``: the equation that takes the line; headings and prose inside one stay text."""
    text = T.strip(F.col("text"))
    marked = members(lines, found, INSIDE_EQUATION, EQUATION_PAD)
    return marked.withColumn("region", F.when(F.col("region").isNotNull() & ~T.is_section_heading(text) & ~T.is_prose(text), F.col("region")))


def used_equations(marked: DataFrame, found: DataFrame) -> DataFrame:
    """Equations that take at least one line, as crops: (doc_id, page, region, x0, y0, x1, y1, number, crop, image_path)."""
    used = marked.where("region IS NOT NULL").select(*PAGE, "region").distinct()
    out = found.join(used, [*PAGE, "region"]).drop("region", "x0", "y0", "x1", "y1")
    unpadded = [(F.col(f"crop.{c}") - p).alias(c) for c, p in zip(("x0", "y0", "x1", "y1"), CROP_PAD, strict=True)]
    region = (F.row_number().over(Window.partitionBy(*PAGE).orderBy("crop.y0", "crop.x0")) - 1).alias("region")
    out = out.select(*PAGE, region, *unpadded, "number", "crop")
    return out.withColumn("image_path", F.format_string("p%04d_eq%03d.png", F.col("page") + 1, F.col("region") + 1))


def equations(lines: DataFrame) -> DataFrame:
    found = equation_regions(lines)
    return used_equations(in_equations(lines, found), found)


def detected_tables(lines: DataFrame, tables: DataFrame | None = None) -> DataFrame:
    """Tables of a page, numbered: those a finder gave (doc_id, page, x0, y0, x1, y1, rows) that look like tables, then ruled ones."""
    box = ("x0", "y0", "x1", "y1")
    ruled = rule_tables(lines).select(*PAGE, F.lit(1).alias("_source"), F.col("region").alias("_n"), *box, "rows")
    if tables is not None:
        given = tables.withColumn("region", F.row_number().over(Window.partitionBy(*PAGE).orderBy("y0", "x0", "y1", "x1")) - 1)
        inside = lines.select(*PAGE, *[F.col(c).alias(f"l_{c}") for c in box]).join(given.select(*PAGE, "region", *box), list(PAGE))
        inside = inside.where(share_inside([F.col(f"l_{c}") for c in box], [F.col(c) for c in box]) >= 0.5)
        widths = inside.groupBy(*PAGE, "region").agg(F.collect_list(F.col("l_x1") - F.col("l_x0")).alias("_widths"))
        given = given.join(widths, [*PAGE, "region"], "left").withColumn("_widths", F.coalesce("_widths", F.array().cast("array<double>")))
        given = given.where(looks_like_table([F.col(c) for c in box], F.col("rows"), F.col("_widths")))
        # A ruled table where one was given is the same table.
        taken = given.groupBy(*PAGE).agg(F.collect_list(F.struct(*box)).alias("_given"))
        twice = F.exists("_given", lambda g: share_inside([F.col(c) for c in box], [g[c] for c in box]) >= 0.5)
        ruled = ruled.join(taken, list(PAGE), "left").where(~F.coalesce(twice, F.lit(False))).drop("_given")
        ruled = given.select(*PAGE, F.lit(0).alias("_source"), F.col("region").alias("_n"), *box, "rows").unionByName(ruled)
    region = F.row_number().over(Window.partitionBy(*PAGE).orderBy("_source", "_n")) - 1
    return ruled.withColumn("region", region).drop("_source", "_n")


def crop_manifest(figs: DataFrame | None, eqs: DataFrame, dpi: int = 200) -> DataFrame:
    """What a renderer has to crop: page, box and file name; nothing is drawn here."""
    some = lambda df, kind: df.select(*PAGE, *[F.col(c) for c in ("x0", "y0", "x1", "y1")], "image_path", F.lit(kind).alias("kind"), F.lit(dpi).alias("dpi"))
    crops = eqs.withColumns({c: F.col(f"crop.{c}") for c in ("x0", "y0", "x1", "y1")}) if "crop" in eqs.columns else eqs
    large = (F.col("x1") - F.col("x0") >= FIGURE_LEAST) & (F.col("y1") - F.col("y0") >= FIGURE_LEAST)
    every = some(crops, "equation") if figs is None else some(figs, "figure").unionByName(some(crops, "equation"))
    return every.where(large)
