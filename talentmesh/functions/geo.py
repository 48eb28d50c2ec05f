"""Country expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talentmesh import lexicons as lex
from talentmesh.functions.text import any_of, collapse, fold, java_quote, let, strip, text_of


def _lookup(mapping: dict[str, str], key: Column) -> Column:
    table = F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv])
    return F.try_element_at(table, key)


def normal_country(c: Column) -> Column:
    cleaned = collapse(F.replace(F.lower(text_of(c)), F.lit("_"), F.lit(" ")))
    return F.coalesce(_lookup(lex.COUNTRY_SYNONYMS, cleaned), cleaned)


def ad_api_code(c: Column) -> Column:
    return _lookup(lex.AD_API_CODES, normal_country(c))


def _bounded(terms) -> str:
    return r"(?<![a-z])(?:" + "|".join(java_quote(t) for t in terms) + r")(?![a-z])"


def has_place(location: Column, term: Column) -> Column:
    """A term taken from a column, letters-only boundaries, any run of blanks inside."""
    quoted = F.regexp_replace(
        F.regexp_replace(fold(term), r"([^a-z0-9\s])", r"\\$1"), " ", r"(?U:\\s+)"
    )
    pattern = F.concat(F.lit("(?<![a-z])"), quoted, F.lit("(?![a-z])"))
    return (term != "") & F.regexp_like(fold(location), pattern)


def names_any(location: Column, terms) -> Column:
    """The location names one of the constant terms."""
    return fold(location).rlike(_bounded(terms))


def is_global(location: Column) -> Column:
    return names_any(location, lex.GLOBAL_PLACES)


def places_of(location: Column) -> Column:
    """Known countries a location names."""
    return F.array_distinct(
        F.transform(
            F.regexp_extract_all(
                fold(location), F.lit(_bounded(sorted(lex.KNOWN_COUNTRIES, key=len, reverse=True))),
                F.lit(0),
            ),
            collapse,
        )
    )


def in_target(location: Column, target: Column) -> Column:
    """The location names the target or one of its places."""
    case = F.when(F.lit(False), F.lit(False))
    for country, places in lex.COUNTRY_PLACES.items():
        case = case.when(target == country, names_any(location, places))
    return case.otherwise(has_place(location, target))


def _belongs(place: Column, target: Column) -> Column:
    """A named country is the target itself or one of its aliases."""
    case = F.when(F.lit(False), F.lit(False))
    for country, places in lex.COUNTRY_PLACES.items():
        case = case.when(target == country, place.isin(*places))
    return case.otherwise(place == target)


def names_other(location: Column, target: Column) -> Column:
    return F.exists(places_of(location), lambda p: ~_belongs(p, target))


def compatible(place: Column, own: Column, wanted: Column, allow_global: Column) -> Column:
    """The seven-step country rule on normal forms; the first step that applies decides.

    ``place`` is the trimmed lower-case location, ``own`` and ``wanted`` are normal country
    names. Pass plain columns: every argument is used several times.
    """
    other = names_other(place, wanted)
    inside = (place != "") & in_target(place, wanted)
    worldwide = is_global(place)
    remote = place.rlike(r"(?U)\bremote\b")
    return (
        F.when(worldwide, allow_global & ~other)
        .when(allow_global & remote & ((own == "") | (own == wanted) | inside) & ~other,
              F.lit(True))
        .when(place.isin("remote", "remote only"), own == wanted)
        .when(inside, F.lit(True))
        .otherwise((own == wanted) & ((place == "") | ~other))
    )


def with_compatibility(df: DataFrame, location: Column, hint: Column, target: Column,
                       allow_global: Column, name: str) -> DataFrame:
    """Add the country verdict; the normal forms are computed once as columns."""
    return (
        df.withColumn("__place", F.lower(strip(text_of(location))))
        .withColumn("__own", normal_country(hint))
        .withColumn("__wanted", normal_country(target))
        .withColumn(
            name,
            compatible(F.col("__place"), F.col("__own"), F.col("__wanted"), allow_global),
        )
        .drop("__place", "__own", "__wanted")
    )


def remote_suits(location: Column, country: Column) -> Column:
    """Remote boards: broad wording, the regional wording, or the country itself."""
    low = F.lower(location)
    return (
        any_of(low, lex.REMOTE_BROAD_TERMS)
        | ((country == "sri lanka") & any_of(low, lex.REMOTE_ASIA_TERMS))
        | (country.isin(*lex.REMOTE_EUROPE_COUNTRIES) & low.contains("europe"))
        | low.contains(country)
    )


def foreign_location(location: Column) -> Column:
    low = F.lower(location)
    parts = F.transform(F.split(low, r"[,;|]"), strip)
    return low.contains("foreign job") | F.array_contains(parts, "international")


def evidence_place(text: Column, country: Column) -> Column:
    """Label of the first place of the country that a text mentions, else ''."""
    wanted = normal_country(country)


    def label(low: Column) -> Column:
        local = F.coalesce(
            *[F.when(low.rlike(_bounded([p])), F.lit(p.title())) for p in lex.EVIDENCE_PLACES],
            F.lit(""),
        )
        return (
            F.when(wanted == "", F.lit(""))
            .when(wanted == "sri lanka", local)
            .when(has_place(low, wanted), F.initcap(wanted))
            .otherwise(F.lit(""))
        )

    return let(F.lower(text), label)
