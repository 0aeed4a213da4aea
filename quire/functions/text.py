"""Scalar text functions and line predicates, as Column expressions.

Patterns are given the meaning that Unicode-aware engines have: ``(?U)`` makes ``\\w \\d \\s \\b`` Unicode in Java.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---- Fixed values: patterns, word lists and constants that results depend on ----

#: What (?U)\\s matches; trimming it looks at both ends only, a pattern at every character.
WHITE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
CJK = "[一-鿿]"
TOKEN = r"[A-Za-z][A-Za-z\-]{1,}|\d+(?:\.\d+)?|[一-鿿]+"
CJK_PER_TOKEN = 1.6
OTHER_PER_TOKEN = 3.9
HYPHEN_END = r"(?U)(\w)[-\u2010\u2011]$"
HYPHEN_BREAK = r"(?U)(\w)[-\u2010\u2011]\n"
CID_GARBAGE = r"\(cid:\d+\)"
GARBAGE_CHARS = r"[\ufffd\u25a1\u25a0]"
FORMULA_HINT = r"(?U)(?:[=≈≤≥∑∫√±×÷·^_]\s*[\w\\])|(?:\\[a-zA-Z]+\{)|\b(?:where|s\.t\.)\b.*[=<>]"
REFERENCE_START = r"(?U)^\s*(\[?\d{1,3}\]?[.)]?\s|[A-Z][a-z]+,\s+[A-Z]\.)"
CAPTION_START = r"(?iU)^\s*(figure|fig\.?|table|tab\.?|scheme|algorithm|listing)\s*\d+"
ROMAN_SECTION = r"(?U)^\s*[IVX]{1,4}[.)]?\s+\S"
PAGE_NUMBER = r"(?iU)^\s*(?:page\s+)?\d{1,4}\s*(?:of|/)\s*\d{1,4}\s*$"
FOLIO_ONLY = r"(?U)^\s*\d{1,4}\s*$"
META_LABEL = (
    r"(?iU)^\s*(article\s+info|abstract|keywords?|citation|cite\s+this\s+article|funding|funding\s+information|"
    r"acknowledg(?:e?ments?)|author\s+contributions?|conflicts?\s+of\s+interest|data\s+availability|ethics?\s+statement|"
    r"informed\s+consent|abbreviations?|supplementary\s+material|correspondence|academic\s+editor|received|revised|accepted|"
    r"published|doi|issn|copyright|license|publisher'?s?\s+note|institutional\s+review|highlights?|graphical\s+abstract|editor)\s*:?\s*$"
)
META_INLINE = (
    r"(?iU)^\s*(citation|cite\s+this\s+article|doi|received|revised|accepted|published|funding|acknowledg(?:e?ments?)|"
    r"author\s+contributions?|conflicts?\s+of\s+interest|data\s+availability|abbreviations?|keywords?|academic\s+editor|"
    r"correspondence|supplementary\s+material|ethics?\s+statement|informed\s+consent|institutional\s+review\s+board\s+statement|"
    r"publisher'?s?\s+note)\s*:"
)
#: Without their flags; :func:`starts_rail` and :func:`starts_citation` add them.
RAIL_LABEL = (
    r"(?:(?:citation|cite\s+this\s+article|doi|received|revised|accepted|published|funding|acknowledg(?:e?ments?)|"
    r"author\s+contributions?|conflicts?\s+of\s+interest|data\s+availability|abbreviations?|keywords?|academic\s+editor|"
    r"correspondence|supplementary\s+material|ethics?\s+statement|informed\s+consent|publisher'?s?\s+note)\s*:)"
    r"|(?:\b[A-Z][A-Za-z'’\-]{1,20},\s*(?:[A-Z]\.\s*){1,3}(?:;|$))"
)
CITATION_FRAGMENT = r"[A-Z][A-Za-z'’\-]{1,20},\s*(?:[A-Z]\.\s*){1,3}(?:;\s*[A-Z][A-Za-z'’\-]{1,20},\s*(?:[A-Z]\.\s*){1,3})+"
MATH_CHARS = r"[=+\-−×÷∑∫√±≤≥<>^_{}\[\]|∈∥·]"
MATH_GLYPH = r"[\x00-\x1f\x7f\u2000-\u206f\ue000-\uf8ff]"
EQUATION_NUMBER = r"(?U)^\(\s*\d{1,3}\s*\)$"
MEASUREMENT_TAIL = r"(?sU)\d+(?:\.\d+)?\s*[a-zA-Z%]{0,4}\s*[,;].*\d"
SENTENCE_END = "(?U)[.。!！?？:：;；]\\s*[»\"”'’)\\]]*$"
UNFINISHED_TAIL = r"(?U)[a-z,;]$|\b(and|or|of|the|to|in|with|that|which|for|as)$"
RUN_IN_LABEL = r"^[A-Z][A-Za-z][A-Za-z0-9 \-/()]{0,30}:"
FRONT_MATTER_HEADING = (
    r"(?iU)^\s*(TYPE\b|ORIGINAL\s+RESEARCH|REVIEW\s+ARTICLE|RESEARCH\s+ARTICLE|contents\s+lists\s+available|published\b|"
    r"journal\s+homepage|see\s+the\s+online\s+version|academic\s+editor|editorial\b|research\s+article|short\s+communication|case\s+report)"
)
HEADING_STOPWORDS = (
    "january february march april may june july august september october november december "
    "and or of the in on at for with to by cm mm kg m s"
).split()
STRUCTURAL_LABELS = (
    "abstract", "introduction", "background", "related work", "related works", "literature review", "methods", "method",
    "materials and methods", "methodology", "methods and materials", "experimental", "experiments", "results",
    "results and discussion", "discussion", "conclusions", "conclusion", "conclusions and outlook", "limitations",
    "future work", "outlook", "references", "bibliography", "acknowledgments", "acknowledgements", "funding", "appendix",
    "appendices", "supplementary", "supplementary material", "data availability", "author contributions",
    "conflicts of interest", "abbreviations", "keywords", "highlights",
    "摘要", "引言", "前言", "相关工作", "方法", "实验", "结果", "讨论", "结论", "参考文献", "致谢", "附录",
)

# ---- Basics ----


def strip(c: Column) -> Column:
    """Without white space of any kind at both ends; SQL's trim takes spaces only."""
    return F.btrim(c, F.lit(WHITE))


def lstrip(c: Column) -> Column:
    return F.ltrim(c, F.lit(WHITE))


def blank(c: Column) -> Column:
    return ~F.coalesce(c, F.lit("")).rlike(r"(?U)\S")


def matches(c: Column, pattern: str) -> Column:
    return c.rlike(pattern)


def count_of(c: Column, pattern: str) -> Column:
    return F.regexp_count(c, F.lit(pattern))


def estimate_tokens(c: Column) -> Column:
    """CJK characters / 1.6 + others / 3.9, cut to a whole number, and one more; 0 for an empty text."""
    cjk = count_of(c, CJK).cast("double")
    estimate = (cjk / F.lit(CJK_PER_TOKEN) + (F.length(c) - cjk) / F.lit(OTHER_PER_TOKEN)).cast("int") + 1
    return F.when(F.coalesce(F.length(c), F.lit(0)) == 0, F.lit(0)).otherwise(estimate).cast("int")


def ascii_lower(c: Column) -> Column:
    """A-Z in lower case; other letters stay, and none becomes an ASCII one."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def tokens(c: Column) -> Column:
    """Retrieval tokens: lower-case words, numbers, and overlapping pairs of CJK characters (a lone one as itself)."""
    found = F.regexp_extract_all(ascii_lower(c), F.lit(TOKEN), F.lit(0))
    pairs = lambda w: F.when(F.length(w) == 1, F.array(w)).otherwise(F.transform(F.sequence(F.lit(1), F.length(w) - 1), lambda i: F.substring(w, i, F.lit(2))))
    mixed = F.flatten(F.transform(found, lambda w: F.when(w.rlike(CJK), pairs(w)).otherwise(F.array(w))))
    return F.when(c.rlike(CJK), mixed).otherwise(found)


def repair_hyphens(lines: Column) -> Column:
    """Text of lines joined by newlines: a word cut at a line's end is one word again, other line ends are spaces."""
    joined = F.regexp_replace(F.regexp_replace(lines, HYPHEN_BREAK, "$1"), "\n", " ")
    return strip(F.regexp_replace(joined, "[ \t]{2,}", " "))


def highlight(c: Column, needle: str, open_tag: str = "<mark>", close_tag: str = "</mark>") -> Column:
    """Every occurrence of a fixed string, in any case, between tags."""
    quoted = "".join(rf"\{x}" if not x.isalnum() and x.isascii() else x for x in needle)
    return F.regexp_replace(c, f"(?iu){quoted}", f"{open_tag}$0{close_tag}") if needle else c


def escape_html(c: Column) -> Column:
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        c = F.replace(c, F.lit(raw), F.lit(safe))
    return c


def json_in(raw: Column) -> Column:
    """The JSON in a reply as text: the whole, a fenced block, or from the first to the last brace or bracket; else null."""
    text = strip(raw)
    outer = lambda a, b: F.regexp_extract(text, rf"(?s)(\{a}.*\{b})", 1)
    tries = [text, strip(F.regexp_extract(text, r"(?s)```(?:json)?\s*(.*?)```", 1)), outer("{", "}"), outer("[", "]")]
    sound = lambda t: F.when(F.try_parse_json(t).isNotNull() & (t != ""), t)
    return F.coalesce(*[sound(t) for t in tries])


# ---- Predicates on a line or block of text ----


def ends_in_hyphen(c: Column) -> Column:
    return matches(c, HYPHEN_END)


def garbage_count(c: Column) -> Column:
    return count_of(c, GARBAGE_CHARS) + count_of(c, CID_GARBAGE)


def is_page_number(c: Column) -> Column:
    return matches(c, PAGE_NUMBER) | matches(c, FOLIO_ONLY)


def starts_caption(c: Column) -> Column:
    return matches(c, CAPTION_START)


def starts_reference(c: Column) -> Column:
    return matches(c, REFERENCE_START)


def starts_citation(c: Column) -> Column:
    return matches(F.substring(strip(c), 1, 90), f"(?U)^(?:{CITATION_FRAGMENT})")


def starts_rail(c: Column) -> Column:
    """Begins with a label of a metadata rail, in any case, or with an author of a citation."""
    return matches(c, f"(?iU)^(?:{RAIL_LABEL})")


def is_meta_label(c: Column) -> Column:
    return matches(c, META_LABEL) | matches(c, META_INLINE)


def is_formula_line(c: Column) -> Column:
    """Reads like a line of a display equation."""
    s = strip(c)
    symbols = count_of(s, MATH_CHARS) + count_of(s, MATH_GLYPH)
    sentence = (count_of(s, "[A-Za-z]{3,}") >= 3) & (count_of(s, "[A-Za-z]") >= 18)
    dense = (symbols >= 2) & (symbols / F.greatest(F.length(s), F.lit(1)) >= 0.12)
    # Most lines have at most one character that could be a symbol, which is too few.
    usual = r"\p{IsAlphabetic}\p{IsDigit} .,;:'\"()!?"
    several = matches(s, f"[^{usual}][{usual}]*[^{usual}]")
    return (
        F.when((s == "") | (F.length(s) > 110), False)
        .when((F.length(s) <= 3) & matches(s, MATH_GLYPH), True)
        .when(matches(s, EQUATION_NUMBER), True)
        .when(~several, False)
        .otherwise(dense & ~sentence)
    )


def is_prose(c: Column) -> Column:
    s = strip(c)
    return (s != "") & (F.length(s) >= 30) & (count_of(s, "[A-Za-z]{2,}") >= 4) & ~is_formula_line(s)


def hints_formula(c: Column) -> Column:
    """Short text with the look of a formula that doesn't read like prose."""
    return (F.length(c) < 220) & matches(c, FORMULA_HINT) & ~is_prose(c)


def is_section_heading(c: Column) -> Column:
    """A heading by its text alone: a roman or decimal number of at most three levels before words that aren't a measure."""
    s = strip(c)
    # Nearly all lines begin with neither a number nor a roman one; the rest is asked of others only.
    begins = F.coalesce(matches(s, r"(?U)^[\dIVX]"), F.lit(False))
    numbered = r"(?sU)^\s*(\d{1,2}(?:\.\d{1,2})*)(\.?)(?=[\s.])\s*(.*)$"
    prefix, dot, rest = F.regexp_extract(s, numbered, 1), F.regexp_extract(s, numbered, 2), strip(F.regexp_extract(s, numbered, 3))
    levels = F.size(F.split(prefix, r"\."))
    word = F.regexp_extract(rest, r"(?U)^\S+", 0)
    bare = (levels == 1) & (dot == "")
    words_first = matches(rest, r"^[\p{L}\p{N}]") & (F.length(word) >= 2) & (count_of(word, "[A-Za-z]") >= F.greatest(F.lit(1), F.floor(F.length(word) / 2)))
    titled = matches(rest, r"^\p{Lu}") & ~F.lower(word).isin(HEADING_STOPWORDS)
    return F.coalesce(
        F.when(~begins, False)
        .when((s == "") | (F.length(s) > 120) | is_page_number(s) | matches(s, r"(?iU)^\s*(figure|table|fig\.|tab\.)\s*\d"), False)
        .when((count_of(s, "[A-Za-z一-鿿]") < 4) | (F.length(F.regexp_replace(s, r"(?U)[\W_]+", "")) < 6), False)
        .when(matches(s, ROMAN_SECTION) & (F.length(s) < 80), True)
        .when((prefix == "") | (levels > 3) | prefix.startswith("0."), False)
        .otherwise(words_first & ~matches(rest, MEASUREMENT_TAIL) & (~bare | titled) & (F.length(rest) >= 2)),
        F.lit(False),
    )


def ends_mid_sentence(c: Column) -> Column:
    s = strip(c)
    return (F.length(s) >= 60) & ~matches(s, SENTENCE_END) & matches(F.right(s, F.lit(24)), UNFINISHED_TAIL)


def is_figure_label(c: Column) -> Column:
    s = strip(c)
    panel = matches(s, r"^[\(\[]?[A-Za-z0-9]{1,3}[\)\].]?$")
    short = (F.size(F.split(s, r"(?U)\s+")) <= 4) & ~matches(s, "[.!?;:]") & (F.length(s) <= 24)
    return (s != "") & (F.length(s) <= 28) & (panel | short)


def is_running_head(c: Column, y1: Column) -> Column:
    s = strip(c)
    return (s != "") & (F.length(s) <= 90) & (is_page_number(s) | (~matches(s, r"^[a-z(\[]") & (y1 <= 90.0)))


def opens_unit(c: Column) -> Column:
    """Starts something new: nothing at all, a heading, a caption or a run-in label."""
    s = lstrip(c)
    return (s == "") | is_section_heading(s) | starts_caption(s) | matches(s, RUN_IN_LABEL)


def is_front_matter(c: Column) -> Column:
    return matches(c, FRONT_MATTER_HEADING)


def is_structural_label(c: Column) -> Column:
    return F.lower(strip(c)).isin(*STRUCTURAL_LABELS)


def is_standalone(c: Column) -> Column:
    """A line that never runs on into the next: blank, a folio, a short caption, a heading or a short label."""
    s = strip(c)
    return (s == "") | is_page_number(s) | (starts_caption(s) & (F.length(s) < 200)) | is_section_heading(s) | (s.endswith(":") & (F.length(s) < 60))
