"""Spelling of tokens and sentence ends, in plain Python (shipped to executors by value)."""

from __future__ import annotations

import unicodedata

# --- fixed values: what a token's characters are replaced by, in order ---
REPLACED = [("`", "'"), ("﻿", ""), ("â€™", "'"), ("\x92", "'"), ("’", "'"), ("…", "..."), ("“", '"'), ("”", '"')]
QUESTION, EXCLAMATION, DECLARATIVE, PAUSE = ["?"], ["!"], [".", "。"], [";", ":", "；", "：", "…"]
FRENCH = {("de", "le"): "du", ("de", "les"): "des", ("à", "le"): "au", ("a", "le"): "au", ("à", "les"): "aux", ("a", "les"): "aux"}
# --- end of fixed values ---


def normal_token(token: str | None) -> str:
    if token and token.isascii():  # nothing to normalise, one replacement that can apply
        return token.strip().lower().replace("`", "'")
    text = unicodedata.normalize("NFKC", token or "").strip().lower()
    for old, new in REPLACED:
        text = text.replace(old, new)
    return text


def without_marks(text: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c))


def token_forms(tokens: list[str], language: str = "") -> set[str]:
    """All spellings a group of tokens counts as equal under."""
    return forms_of([normal_token(t) for t in tokens], language)


def forms_of(normal: list[str], language: str = "") -> set[str]:
    """The same for tokens in their normal spelling."""
    plain = [t for t in normal if t]
    if not plain:
        return set()
    forms = set()
    for words in (plain,) if all(t.isascii() for t in plain) else (plain, [without_marks(t) for t in plain]):
        forms |= {" ".join(words), "".join(words)}
        kept = [t.replace("'", "").replace("-", "") for t in words]
        if kept != words:
            forms |= {" ".join(kept), "".join(kept)}
    if language == "fr" and tuple(plain) in FRENCH:
        forms.add(FRENCH[tuple(plain)])
    return forms - {""}


def last_class(text: str) -> str:
    last = text.strip()[-1:]
    for name, marks in (("question", QUESTION), ("exclamation", EXCLAMATION), ("declarative", DECLARATIVE), ("pause", PAUSE)):
        if last in marks:
            return name
    return "none"
