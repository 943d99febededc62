"""Text and ordered-row operators: normal forms, context, spans, samples, budgets."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.functions.tokens import DECLARATIVE, EXCLAMATION, FRENCH, PAUSE, QUESTION, normal_token, without_marks


def _normal_tokens(tokens: pd.Series) -> pd.Series:
    return tokens.map(normal_token)


def _without_marks(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else without_marks(t))


def normal_tokens(tokens: Column | str) -> Column:
    """Normal spellings; Unicode normal forms have no SQL function, so Arrow batches go through Python."""
    return F.pandas_udf(_normal_tokens, "string")(tokens)


def folded(texts: Column | str) -> Column:
    """Texts without diacritics."""
    return F.pandas_udf(_without_marks, "string")(texts)


def canonical_forms(normal: Column, plain: Column) -> Column:
    """The same forms for one token, from its normal and its folded spelling, in SQL functions."""
    bare = lambda c: F.translate(c, "'-", "")
    return F.filter(F.array_distinct(F.array(normal, bare(normal), plain, bare(plain))), lambda x: x != "")


def group_forms(tokens: Column, language: Column | None = None) -> Column:
    """Forms of a group of normal tokens (empty ones left out): joined by a space and by nothing, without ' and -, and the French contractions; folding apart."""
    plain = F.filter(tokens, lambda t: t != "")
    bare = F.transform(plain, lambda t: F.translate(t, "'-", ""))
    forms = F.array(*[F.array_join(x, sep) for x in (plain, bare) for sep in (" ", "")])
    if language is not None:
        pair = F.array_join(plain, " ")
        short = F.create_map(*[F.lit(x) for k, v in FRENCH.items() for x in (" ".join(k), v)])
        forms = F.concat(forms, F.when((language == "fr") & pair.isin(*[" ".join(k) for k in FRENCH]), F.array(F.try_element_at(short, pair))).otherwise(F.array().cast("array<string>")))
    return F.filter(F.array_distinct(forms), lambda x: x != "")


def lemma_or_word(lemma: Column, word: Column) -> Column:
    """The lemma, the word where that is blank or missing."""
    return F.when(F.trim(lemma) != "", F.trim(lemma)).otherwise(word)


def soft_token(token: Column) -> Column:
    """Whether a normal token is punctuation that alignment may skip."""
    return token.rlike(r"""^[-.?!,:;"']*$""")


def punct_class(text: Column) -> Column:
    """Class of the last character that is no white space."""
    last = F.regexp_extract(text, r"(\S)\s*$", 1)
    return F.when(last.isin(QUESTION), "question").when(last.isin(EXCLAMATION), "exclamation").when(last.isin(DECLARATIVE), "declarative").when(last.isin(PAUSE), "pause").otherwise("none")


def log_ratio(a: Column, b: Column) -> Column:
    return F.abs(F.log((a + 1) / (b + 1)))


def previous_context(rows: DataFrame, section: list[str], order: str, text: str, k: int) -> DataFrame:
    """context: up to ``k`` earlier texts of the section and the row's own, joined by a space."""
    w = Window.partitionBy(*section).orderBy(order).rowsBetween(-k, 0)
    return rows.withColumn("context", F.array_join(F.collect_list(text).over(w), " "))


def span_candidates(rows: DataFrame, section: list[str], order: str, text: str) -> DataFrame:
    """Spans of one and of two consecutive rows: start, length, text, onset, offset."""
    w = Window.partitionBy(*section).orderBy(order)
    both = rows.withColumn("next_text", F.lead(text).over(w)).withColumn("next_offset", F.lead("offset").over(w))
    one = F.struct(F.lit(1).alias("length"), F.trim(text).alias("text"), F.col("offset").alias("offset"))
    two = F.struct(F.lit(2).alias("length"), F.concat_ws(" ", F.nullif(F.trim(text), F.lit("")), F.nullif(F.trim("next_text"), F.lit(""))).alias("text"), F.col("next_offset").alias("offset"))
    spans = F.when(F.col("next_offset").isNull(), F.array(one)).otherwise(F.array(one, two))
    return both.select(*section, F.col(order).alias("start"), "onset", F.explode(spans).alias("x")).select(*section, "start", "onset", "x.*")


def pseudo_random(column: Column) -> Column:
    """A key in 0 .. 2^32 - 1 that any engine computes alike."""
    return (column * 2654435761) % 4294967296


def review_sample(rows: DataFrame, key: str, flagged: str, score: str, section: str, pattern: str, size: int = 100) -> DataFrame:
    """Up to 50 flagged rows, the 20 lowest and 20 highest scores, 2 a section, 2 a pattern, filled up to ``size``; each row once."""
    ranked = rows.withColumn("draw", pseudo_random(F.col(key)))
    strata = [
        (50, Window.orderBy(F.desc(flagged), "draw", key), F.col(flagged)), (20, Window.orderBy(score, key), F.lit(True)), (20, Window.orderBy(F.desc(score), key), F.lit(True)),
        (2, Window.partitionBy(section).orderBy("draw", key), F.lit(True)), (2, Window.partitionBy(pattern).orderBy("draw", key), F.lit(True)), (size, Window.orderBy("draw", key), F.lit(True)),
    ]
    taken = None
    for priority, (limit, order, allowed) in enumerate(strata):
        pick = ranked.withColumn("place", F.row_number().over(order)).where(allowed & (F.col("place") <= limit)).select(key, F.lit(priority).alias("stratum"), F.col("place").cast("int").alias("place"))
        taken = pick if taken is None else taken.unionByName(pick)
    once = taken.withColumn("n", F.row_number().over(Window.partitionBy(key).orderBy("stratum", "place"))).where("n = 1").drop("n")
    return once.orderBy("stratum", "place", key).limit(size)


def budget_batches(rows: DataFrame, group: list[str], order: str, size: str, budget: int) -> DataFrame:
    """batch: consecutive rows of a group whose sizes add up to at most ``budget`` (a larger row stands alone)."""
    kinds = dict(rows.dtypes)

    def run(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(order, ignore_index=True)
        batch, held, out = 0, 0, []
        for n in frame[size]:
            if held and held + n > budget:
                batch, held = batch + 1, 0
            held += n
            out.append(batch)
        return frame.assign(batch=out)[[*group, order, size, "batch"]]

    schema = ", ".join([*(f"{c} {kinds[c]}" for c in (*group, order, size)), "batch int"])
    return rows.select(*group, order, size).groupBy(*group).applyInPandas(run, schema)
