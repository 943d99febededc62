"""Names given by a user: options split into tuples, model names in one spelling, names checked against a list."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values ---
MODELS = ["xlmr", "nllb_encoder"]
MODEL_ALIASES = {"nllb": "nllb_encoder"}
LANGUAGES = ["en", "fr", "zh"]
CONDITIONS = ["raw", "shared", "specific", "full", "mismatched_shared"]
#: The columns of a language's timeline: onset, offset, and whether the picture event belongs to it.
TIMELINES = {"en": ("onset_en", "offset_en", True), "fr": ("onset_fr", "offset_fr", False), "zh": ("onset_zh", "offset_zh", False)}
# --- end of fixed values ---


def split_option(value: str | None) -> tuple[str, ...]:
    """``a, b,,c`` as (a, b, c)."""
    return tuple(x for x in (part.strip() for part in (value or "").split(",")) if x)


def model_name(value: str) -> str:
    """The name in the spelling tables use; raises for an unknown one."""
    name = MODEL_ALIASES.get(value.strip().lower(), value.strip().lower())
    return checked_names([name], MODELS, "model")[0]


def model_column(value: Column) -> Column:
    """The same for a column; an unknown name stays as it is."""
    name = F.lower(F.trim(value))
    for alias, full in MODEL_ALIASES.items():
        name = F.when(name == alias, full).otherwise(name)
    return name


def checked_names(names: Iterable[str], known: list[str], what: str) -> list[str]:
    """The names, each once, in the order given; raises for none and for unknown ones."""
    out = list(dict.fromkeys(names))
    unknown = [n for n in out if n not in known]
    if unknown or not out:
        raise ValueError(f"unknown {what}: {', '.join(unknown)}" if unknown else f"no {what} given")
    return out


def path_included(path: Column, prefixes: list[str], depth: int = 1) -> Column:
    """Whether the path's first ``depth`` parts are one of the prefixes (all paths for no prefix)."""
    if not prefixes:
        return F.lit(True)
    return F.array_join(F.slice(F.filter(F.split(path, "/"), lambda x: x != ""), 1, depth), "/").isin(*prefixes)
