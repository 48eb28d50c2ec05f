"""Role gate: which titles suit which target roles, as an equi-join on phrases.

A target is compiled to rows ``(role, phrase, weight, need)``; a title is exploded to its
token n-grams; the two meet on the phrase, and a pair passes when its weights reach
``need``. Both sides are distinct texts, so the work grows with the vocabulary of titles
and targets and not with candidates times vacancies.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talentmesh import lexicons as lex
from talentmesh.functions.text import (
    constant_array, explode_some, never_null, role_text,
)
from talentmesh.operators.skew import salted_join

PASS_ALL = "*"


def _padded(c: Column) -> Column:
    return F.concat(F.lit(" "), c, F.lit(" "))


def _norm_constant(phrase: str) -> str:
    """Normal form of a lexicon phrase, computed once while the plan is built."""
    kept = "".join(ch if (ch.isalnum() or ch in "+#") else " " for ch in phrase.lower())
    return " ".join(kept.split())


def role_family(normal_target: Column) -> Column:
    """Index of the first family with a marker in the target; null without one."""
    padded = _padded(normal_target)
    case = F.when(F.lit(False), F.lit(None).cast("int"))
    for i, (markers, _) in enumerate(lex.ROLE_FAMILIES):
        names = "|".join(_norm_constant(m) for m in markers)
        case = case.when(padded.rlike(f" (?:{names}) "), F.lit(i))
    return case


def _family_phrases(family: Column) -> Column:
    joined = [
        ";".join(dict.fromkeys(_norm_constant(p) for p in related))
        for _, related in lex.ROLE_FAMILIES
    ]
    return F.split(F.element_at(constant_array(joined), family + 1), ";")


def compile_roles(targets: DataFrame, role: str = "role") -> DataFrame:
    """``role, phrase, weight, need`` of every distinct target text.

    * the whole phrase always suffices;
    * a family target passes on any phrase of its family;
    * otherwise any distinctive token suffices;
    * a target of generic tokens only needs half of them, repeats counted.

    A blank target compiles to the single phrase ``*``.
    """
    base = targets.select(never_null(F.col(role)).alias("role")).distinct()
    tokens = F.filter(
        F.split(F.col("normal"), " "),
        lambda t: (F.length(t) > 1) & ~t.isin(*lex.SENIORITY_TOKENS),
    )
    shaped = (
        base.withColumn("normal", never_null(role_text(F.col("role"))))
        .withColumn("family", role_family(F.col("normal")))
        .withColumn("tokens", tokens)
        .withColumn(
            "distinctive", F.filter("tokens", lambda t: ~t.isin(*lex.GENERIC_ROLE_TOKENS))
        )
    )
    one = lambda p: F.struct(p.alias("phrase"), F.lit(1).alias("weight"))
    plain = F.col("family").isNotNull() | (F.size("distinctive") > 0)
    need = F.when(plain, F.lit(1)).otherwise(
        F.greatest(F.lit(1), F.floor((F.size("tokens") + 1) / 2).cast("int"))
    )
    parts = (
        F.when(F.col("family").isNotNull(), F.transform(_family_phrases(F.col("family")), one))
        .when(F.size("distinctive") > 0, F.transform(F.array_distinct("distinctive"), one))
        .otherwise(
            F.transform(
                F.array_distinct("tokens"),
                lambda t: F.struct(
                    t.alias("phrase"),
                    F.size(F.filter("tokens", lambda u: u == t)).alias("weight"),
                ),
            )
        )
    )
    whole = F.array(F.struct(F.col("normal").alias("phrase"), F.col("need").alias("weight")))
    exploded = (
        shaped.withColumn("need", need)
        .withColumn(
            "rows",
            F.when(F.trim("role") == "", F.array(
                F.struct(F.lit(PASS_ALL).alias("phrase"), F.lit(1).alias("weight"))))
            .otherwise(F.concat(whole, parts)),
        )
        .withColumn("need", F.when(F.trim("role") == "", F.lit(1)).otherwise(F.col("need")))
        .select("role", "need", explode_some(F.col("rows")).alias("r"))
        .select("role", F.col("r.phrase").alias("phrase"), F.col("r.weight").alias("weight"), "need")
        .where(F.col("phrase") != "")
    )
    # The whole phrase and a family phrase may coincide: keep the larger weight.
    return exploded.groupBy("role", "phrase", "need").agg(F.max("weight").alias("weight"))


def title_phrases(titles: DataFrame, title: str, sizes: DataFrame | None = None) -> DataFrame:
    """``title, phrase``: the distinct token n-grams of every distinct title.

    ``sizes`` is a one-row table with the phrase lengths that can match at all, so a long
    page heading does not emit n-grams nobody asks for. Every title also emits ``*``.
    """
    base = titles.select(never_null(F.col(title)).alias("title")).distinct()
    toks = F.filter(F.split(role_text(F.col("title")), " "), lambda t: t != "")
    shaped = base.withColumn("toks", toks)
    if sizes is not None:
        shaped = shaped.crossJoin(F.broadcast(sizes))
        lengths = F.col("sizes")
    else:
        lengths = F.sequence(F.lit(1), F.greatest(F.size("toks"), F.lit(1)))
    grams = F.flatten(
        F.transform(
            lengths,
            lambda n: F.when(
                F.size("toks") >= n,
                F.transform(
                    F.sequence(F.lit(1), F.size("toks") - n + 1),
                    lambda i: F.array_join(F.slice("toks", i, n), " "),
                ),
            ).otherwise(F.array().cast("array<string>")),
        )
    )
    return shaped.select(
        "title",
        explode_some(F.array_distinct(F.concat(F.array(F.lit(PASS_ALL)), grams))).alias("phrase"),
    )


def phrase_sizes(roles: DataFrame) -> DataFrame:
    """One row: the distinct phrase lengths of the compiled roles (an aggregate of ints)."""
    n = F.size(F.split("phrase", " "))
    return roles.agg(F.array_sort(F.collect_set(n)).alias("sizes"))


def role_titles(targets: DataFrame, titles: DataFrame, role: str = "role",
                title: str = "title") -> DataFrame:
    """Distinct ``role, title`` pairs that pass the gate.

    The phrase join is salted by title: a phrase such as a bare job word may occur in a
    large share of the titles.
    """
    roles = compile_roles(targets, role)
    grams = title_phrases(titles, title, phrase_sizes(roles))
    met = salted_join(grams, roles, ["phrase"], ["title"])
    return (
        met.groupBy("role", "title", "need")
        .agg(F.sum("weight").alias("got"))
        .where(F.col("got") >= F.col("need"))
        .select("role", "title")
    )


def roles_of() -> Column:
    """Roles a candidate asks for: the target, else every likely title, else everything."""
    return (
        F.when(F.col("target_position") != "", F.array(F.col("target_position")))
        .when(F.size("likely_titles") > 0, F.col("likely_titles"))
        .otherwise(F.array(F.lit("")))
    )
