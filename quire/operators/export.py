"""Rendering: Markdown export, HTML tables, summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions import text as T

#: The sections of a summary in order; the first three are single texts.
SUMMARY_SECTIONS = (
    ("research_question", "Research question"),
    ("method", "Method"),
    ("data_and_setup", "Data & setup"),
    ("key_findings", "Key findings"),
    ("novelty", "Novelty"),
    ("limitations", "Limitations"),
    ("key_numbers", "Key numbers"),
    ("reusable_points", "Reusable points"),
)
SCALAR_SECTIONS = 3


def table_html(rows: Column) -> Column:
    """A grid as an HTML table whose first row is its head."""
    cells = lambda r, tag: F.array_join(F.transform(r, lambda c: F.concat(F.lit(f"<{tag}>"), T.escape_html(F.coalesce(c, F.lit(""))), F.lit(f"</{tag}>"))), "")
    line = lambda r, i: F.concat(F.lit("<tr>"), F.when(i == 0, cells(r, "th")).otherwise(cells(r, "td")), F.lit("</tr>"))
    return F.concat(F.lit('<table class="doc-table">'), F.array_join(F.transform(rows, line), ""), F.lit("</table>"))


def table_markdown(rows: Column) -> Column:
    line = lambda r: F.concat(F.lit("| "), F.array_join(r, " | "), F.lit(" |"))
    rule = F.concat(F.lit("| "), F.array_join(F.transform(F.element_at(rows, 1), lambda _: F.lit("---")), " | "), F.lit(" |"))
    lines = F.transform(rows, line)
    return F.array_join(F.concat(F.slice(lines, 1, 1), F.array(rule), F.slice(lines, F.lit(2), F.greatest(F.size(lines) - 1, F.lit(0)))), "\n")


def markdown(blocks: DataFrame, mode: str = "bilingual") -> DataFrame:
    """(doc_id, markdown): blocks in reading order, without running heads.

    Modes: original, translated (the original where there is no translation) and bilingual. ``translation`` is a column of
    ``blocks``; level, image_path, caption and table_rows are used where they are there.
    """
    has = blocks.columns
    own = T.strip(F.col("text"))
    other = F.when(~T.blank(F.col("translation")), T.strip(F.col("translation"))) if "translation" in has else F.lit(None).cast("string")
    level = F.coalesce(F.col("level"), F.lit(2)) if "level" in has else F.lit(2)
    prose = {"original": own, "translated": F.coalesce(other, own), "bilingual": F.concat_ws("\n\n", own, other)}[mode]
    title = {"original": own, "translated": F.coalesce(other, own), "bilingual": F.concat_ws(" / ", own, other)}[mode]
    out = F.when(F.col("type") == "heading", F.concat(F.repeat(F.lit("#"), level), F.lit(" "), title))
    if "image_path" in has:
        caption = F.coalesce(F.col("caption"), F.lit(""))
        out = out.when(F.col("type") == "figure", F.concat(F.lit("!["), caption, F.lit("]("), F.coalesce("image_path", F.lit("")), F.lit(")\n\n"), caption))
    if "table_rows" in has:
        out = out.when((F.col("type") == "table") & (F.size("table_rows") > 0), table_markdown(F.col("table_rows")))
    rows = blocks.where(~F.col("type").isin("header", "footer", "blank")).withColumn("_line", out.otherwise(prose)).where(F.col("_line") != "")
    lines = rows.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("ord", "_line"))).alias("all"))
    return lines.select("doc_id", F.array_join(F.transform("all", lambda x: x["_line"]), "\n\n").alias("markdown"))


def notes_appendix(notes: DataFrame) -> DataFrame:
    """(doc_id, notes): quotes and comments, in order."""
    line = F.concat(F.lit("> "), F.coalesce("quote", F.lit("")), F.lit("\n\n"), F.coalesce("comment", F.lit("")))
    lines = notes.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("id", line.alias("line")))).alias("all"))
    return lines.select("doc_id", F.array_join(F.transform("all", lambda x: x["line"]), "\n\n").alias("notes"))


def summary_markdown(reply: Column) -> Column:
    """Markdown of a summary reply in JSON; sections without content are left out. A lone text counts as a list of one."""
    parts = []
    for i, (key, title) in enumerate(SUMMARY_SECTIONS):
        value = T.strip(F.coalesce(F.get_json_object(reply, f"$.{key}"), F.lit("")))
        if i >= SCALAR_SECTIONS:
            items = F.coalesce(F.from_json(value, "array<string>"), F.when(value != "", F.array(value)), F.array().cast("array<string>"))
            items = F.filter(F.transform(items, T.strip), lambda x: x != "")
            value = F.array_join(F.transform(items, lambda x: F.concat(F.lit("- "), x)), "\n")
        parts.append(F.when(value != "", F.concat(F.lit(f"## {title}\n\n"), value)))
    return F.concat_ws("\n\n", *parts)


def emphasis_markup(text: Column, runs: Column) -> Column:
    """Text with its runs (start, end, style) wrapped in ** or *; runs are in order and don't overlap."""
    mark = lambda style: F.when(style.contains("bold"), F.lit("**")).otherwise(F.lit("*"))
    part = lambda a, b: F.substring(text, a + 1, F.greatest(b - a, F.lit(0)))
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))
    step = lambda acc, r: F.struct(F.concat(acc["out"], part(acc["at"], r["start"]), mark(r["style"]), part(r["start"], r["end"]), mark(r["style"])).alias("out"), r["end"].alias("at"))
    done = F.aggregate(runs, start, step)
    return F.concat(done["out"], part(done["at"], F.length(text)))
