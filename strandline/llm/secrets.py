"""Secret scan with multipart credential linking, in DataFrame and SQL functions only.

Three base kinds are found by pattern. Weaker parts (bare user names, long
random-looking tokens, short hex runs, endpoints) are candidates only: an
interval join inside scopes of ``SCOPE`` code points reports one when a base
part of another role lies in its scope, or when parts of both other roles do.

Positions come from the text between the matches: the lengths of what a pattern
splits off and of what it matches, summed from the left.

Defined results: null text counts as empty; rows with equal doc_id and text get
equal results; a text without spans has empty strings' digest and list.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.llm._shared import stored

#: Code points on either side of a part within which others complete it.
SCOPE = 400
#: Matches that are folded into one list at a time: a list is copied at every step, so long ones are put together from blocks.
FOLDED = 256

ASSIGN = r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: Kinds in their order: (kind, role, base, pattern). A run of capitals or of hex digits matches whole or not at all, so its least length may stand in the pattern.
KINDS = [
    ("assign", "secret", True, ASSIGN),
    ("access", "id", True, r"AKIA[A-Z0-9]{16,}"),
    ("hex", "secret", True, r"[0-9a-f]{24,}"),
    ("user", "id", False, r"""(?:[Uu]ser(?:name)?|[Ll]ogin|[Cc]lient_?[Ii]d|[Aa]ccount)["']?\x20*[:=]\x20*["']?[A-Za-z0-9_.@-]{3,}"""),
    ("blob", "secret", False, r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]*+[0-9])(?=[0-9a-z+/_-]*+[A-Z])[A-Za-z0-9+/_-]{32,}+={0,2}"),
    ("shorthex", "secret", False, r"(?<![0-9A-Za-z])(?=[a-f]*+[0-9])[0-9a-f]{16,23}(?![0-9A-Za-z])"),
    ("endpoint", "endpoint", False, r"""[a-z]{2,8}://[^\x20\x09-\x0D"'<>]+|(?<![0-9.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?::[0-9]{1,5})?(?![0-9.])"""),
]
_SPAN = "array<struct<s:int,e:int,k:int>>"


def _found(text: Column, number: int) -> Column:
    """Spans of one kind as array<struct<s, e, k>>; k is the kind's place in KINDS."""
    kind, _, _, pattern = KINDS[number]
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    parts = [F.transform(F.split(text, pattern, -1), F.length).alias("gap"), F.transform(whole, F.length).alias("own")]
    if kind == "assign":
        parts.append(F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(2)), F.length).alias("value"))
    zipped = F.filter(F.arrays_zip(*parts), lambda x: x["own"].isNotNull())

    def step(acc: Column, x: Column) -> Column:
        begin = acc["at"] + x["gap"]
        end = begin + x["own"]
        spans = F.concat(acc["out"], F.array(F.struct(begin.alias("s"), end.alias("e"), F.lit(number).alias("k"))))
        if kind == "assign":
            spans = F.when(x["value"] >= 6, spans).otherwise(acc["out"])
        return F.struct(end.alias("at"), spans.alias("out"))

    def fold(matches: Column, at: Column) -> Column:
        return F.aggregate(matches, F.struct(at.alias("at"), F.array().cast(_SPAN).alias("out")), step)["out"]

    def folded(m: Column) -> Column:
        numbers = F.sequence(F.lit(0), F.floor((F.size(m) - 1) / FOLDED).cast("int"))
        blocks = F.transform(numbers, lambda b: F.slice(m, b * FOLDED + 1, F.lit(FOLDED)))
        length = lambda block: F.aggregate(block, F.lit(0), lambda n, x: n + x["gap"] + x["own"])
        none = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))
        begins = F.aggregate(blocks, none, lambda acc, block: F.struct((acc["at"] + length(block)).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out")))["out"]
        in_blocks = F.flatten(F.transform(F.arrays_zip(blocks.alias("m"), begins.alias("at")), lambda z: fold(z["m"], z["at"])))
        return F.when(F.size(m) <= FOLDED, fold(m, F.lit(0))).otherwise(in_blocks)

    # a lambda binds the matches, so that the text is searched once
    every = F.element_at(F.transform(F.array(zipped), folded), 1)
    return F.when(F.regexp_like(text, F.lit(pattern)), every).otherwise(F.array().cast(_SPAN))


def _listed(spans: Column) -> Column:
    name = F.array(*[F.lit(k) for k, *_ in KINDS])
    return F.array_join(F.transform(F.array_sort(spans), lambda x: F.concat_ws(":", F.element_at(name, x["k"] + 1), x["s"], x["e"])), ",")


def scan_secrets(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans (and n_linked) for every row of ``docs`` (doc_id, text)."""
    text = F.col("sl_text")
    texts = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("sl_text"))
    numbers = {flag: [i for i, kind in enumerate(KINDS) if kind[2] is flag] for flag in (True, False)}
    found = texts.select(
        "doc_id", F.xxhash64(text).alias("t1"), F.xxhash64(F.lit(1), text).alias("t2"),
        F.concat(*[_found(text, i) for i in numbers[True]]).alias("base"), F.concat(*[_found(text, i) for i in numbers[False]]).alias("weak"),
    )
    found, _ = stored(found)

    # parts are linked once for each distinct text
    key = ["t1", "t2"]
    role = F.element_at(F.array(*[F.lit(r) for _, r, _, _ in KINDS]), F.col("k") + 1)
    some = found.where(F.size("weak") > 0).select(*key, "base", "weak").dropDuplicates(key)
    weak = some.select(*key, F.explode("weak").alias("w")).select(*key, "w.*").withColumn("role", role).withColumn("scope", F.floor(F.col("s") / SCOPE))
    reach = F.sequence(F.floor((F.col("s") - SCOPE) / SCOPE), F.floor((F.col("e") + SCOPE) / SCOPE))
    parts = some.select(*key, F.explode(F.concat("base", "weak")).alias("w")).select(*key, "w.*")
    parts = parts.select(*key, F.col("s").alias("ps"), F.col("e").alias("pe"), role.alias("prole"), (F.col("k") < len(numbers[True])).alias("strong"), F.explode(reach).alias("scope"))
    near = weak.join(parts, [*key, "scope"]).where(f"s >= ps - {SCOPE} and s <= pe + {SCOPE}")
    other = F.col("prole") != F.col("role")
    judged = near.groupBy(*key, "s", "e", "k").agg(
        F.bool_or(other & F.col("strong")).alias("completed"),
        F.count_distinct(F.when(other, F.col("prole"))).alias("others"),
        F.bool_or(F.col("strong") & (F.col("ps") < F.col("e")) & (F.col("s") < F.col("pe"))).alias("inside"),
    )
    linked = judged.where("not inside and (completed or others > 1)").groupBy(*key).agg(F.collect_list(F.struct("s", "e", "k")).alias("linked"))
    out = found.join(linked, key, "left")
    ordered = lambda spans: F.transform(spans, lambda x: F.struct(x["s"].alias("s"), x["k"].alias("k"), x["e"].alias("e")))
    count = lambda i: F.size(F.filter("base", lambda x: x["k"] == i)).cast("bigint")
    linked = F.coalesce("linked", F.array().cast(_SPAN))
    return out.select(
        "doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
        F.sha2(_listed(ordered(F.col("base"))), 256).alias("base_sha256"), _listed(ordered(F.concat("base", linked))).alias("spans"),
        F.size(linked).cast("bigint").alias("n_linked"),
    )
