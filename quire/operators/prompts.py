"""What a model is asked, in our own words. The last line of every prompt is its payload as JSON."""

from __future__ import annotations

import json
from collections.abc import Sequence

#: Names of target languages, and how many hints of a first attempt are passed on.
LANGUAGES = {"zh": "Simplified Chinese", "en": "English", "ja": "Japanese", "ko": "Korean", "de": "German", "fr": "French", "es": "Spanish", "ru": "Russian", "pt": "Portuguese"}
HINTS = 4
STYLES = {
    "academic": "Write as a careful scientific translator would: exact terms, complete sentences.",
    "plain": "Write plainly, for readers from other fields; keep terms exact.",
}


def _asked(lines: Sequence[str], payload: dict) -> str:
    return "\n".join([*lines, json.dumps(payload, ensure_ascii=False)])


def _beside(glossary: str, context: str, hints: Sequence[str] | None) -> list[str]:
    lines = [f"Terms:\n{glossary}"] if glossary else []
    lines += [f"Context, not to be translated:\n{context}"] if context else []
    return lines + (["Mind these problems of a first attempt: " + "; ".join(list(hints)[:HINTS])] if hints else [])


def translation(items: list[dict], lang: str, glossary: str = "", context: str = "", hints: Sequence[str] | None = None, style: str = "academic", brief: bool = False) -> str:
    """For texts by id. ``brief`` is for small local models, which long instructions confuse."""
    own = f"Translate each text into {LANGUAGES.get(lang, lang)}. Keep every placeholder tag as it is and answer with JSON of the same shape."
    return _asked([own, *([] if brief else [STYLES[style]]), *_beside(glossary, context, hints)], {"items": items})


def table(rows: list[list[str]], lang: str, glossary: str = "", hints: Sequence[str] | None = None) -> str:
    own = f"Translate the cells of this table into {LANGUAGES.get(lang, lang)}. Keep numbers, units and placeholder tags; answer with JSON of as many rows and cells."
    return _asked([own, *_beside(glossary, "", hints)], {"rows": rows})


def summary(source: str, lang: str, sections: Sequence[str], scalars: int) -> str:
    own = f"Summarise this document in {LANGUAGES.get(lang, lang)}, from what it says only. Answer with a JSON object: texts for {', '.join(sections[:scalars])}; lists of texts for {', '.join(sections[scalars:])}. Leave out what isn't there."
    return _asked([own], {"document": source})


def glossary(candidates: Sequence[str], sample: str, lang: str) -> str:
    own = f"Which of these candidates are terms of the field, and what are they in {LANGUAGES.get(lang, lang)}? Answer with JSON {{\"terms\": [{{\"source\", \"target\", \"note\"}}]}}, names and acronyms that stay as they are included."
    return _asked([own], {"candidates": list(candidates), "sample": sample})


def question(asked: str, contexts: list[dict], lang: str) -> str:
    own = f"Answer the question in {LANGUAGES.get(lang, lang)} from these passages only, and say which ones you used. Answer with JSON {{\"answer\", \"evidence\": [{{\"id\", \"quote\"}}]}}; if they don't say, say so."
    return _asked([own], {"question": asked, "passages": contexts})
