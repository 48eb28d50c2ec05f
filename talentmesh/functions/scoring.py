"""Score, required years and the other per-row rules of matching."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from talentmesh import lexicons as lex
from talentmesh.functions.text import any_of, holds_any, let, mask_bits, strip, text_of

HIGH_MASK = mask_bits(lex.HIGH_VALUE_SKILLS, lex.SKILLS)
LOW_MASK = mask_bits(lex.LOW_SIGNAL_SKILLS, lex.SKILLS)
#: Terms that nothing but their number tells apart in a score.
SKILL_KINDS = tuple(m for m in (
    HIGH_MASK & ~LOW_MASK, LOW_MASK & ~HIGH_MASK, HIGH_MASK & LOW_MASK,
    (1 << len(lex.SKILLS)) - 1 & ~(HIGH_MASK | LOW_MASK)) if m)
TITLE_KINDS = ((1 << len(lex.TITLE_TERMS)) - 1,)
AI_SKILL_MASK = mask_bits(lex.AI_PROFILE_SKILLS, lex.SKILLS)
AI_TITLE_MASK = mask_bits(lex.AI_PROFILE_TITLES, lex.TITLE_TERMS)


def _long(n: int) -> Column:
    return F.lit(n).cast("long")


def title_minimum(title: Column) -> Column:
    """Years a title implies; null when it says nothing."""
    low = F.lower(text_of(title))
    case = F.when(any_of(low, lex.ENTRY_TITLE_TERMS), F.lit(0.0))
    for pattern, years in lex.SENIORITY_MINIMUMS:
        case = case.when(low.rlike("(?U)" + pattern), F.lit(years))
    return case


def required_years(title: Column, description: Column) -> Column:
    """Largest of the years a title implies and the years a text asks for."""
    text = F.lower(F.concat(text_of(title), F.lit(". "), text_of(description)))
    found = [
        F.transform(F.regexp_extract_all(text, F.lit("(?U)" + p), F.lit(1)), lambda y: y.try_cast("double"))
        for p in lex.YEARS_PATTERNS
    ]
    # Every pattern ends in years.
    stated = F.when(text.contains("year"), F.array_max(F.filter(F.concat(*found), lambda y: y <= 60)))
    return F.greatest(stated, title_minimum(title))


def entry_level(title: Column) -> Column:
    return F.lower(text_of(title)).rlike("(?U)" + lex.UNDERLEVEL_PATTERN)


def experience_fits(required: Column, years: Column, under: Column) -> Column:
    return years.isNull() | ((required.isNull() | (required <= years)) & ~under)


def closed_text(title: Column, description: Column) -> Column:
    return holds_any(F.lower(F.concat_ws(" ", text_of(title), text_of(description))),
                     lex.CLOSED_JOB_PHRASES)


def fresh(
    published: Column, source: Column, verified: Column, closed: Column, now: Column,
    max_age_days: int = 7,
) -> Column:
    """Live listings; discovery rows need a date or a verified page."""
    day = F.expr("INTERVAL 1 DAY")
    oldest = now - F.make_dt_interval(days=F.lit(max_age_days))
    return (
        F.when(closed, F.lit(False))
        .when(published > now + day, F.lit(False))
        .when((published < oldest) & ~source.isin(*lex.CURRENT_OPEN_SOURCES), F.lit(False))
        .when(published.isNull() & source.isin(*lex.DISCOVERY_SOURCES) & ~verified, F.lit(False))
        .otherwise(F.lit(True))
    )


def ai_profile(title_mask: Column, skill_mask: Column, target: Column) -> Column:
    return (
        (title_mask.bitwiseAND(_long(AI_TITLE_MASK)) != 0)
        | (skill_mask.bitwiseAND(_long(AI_SKILL_MASK)) != 0)
        | any_of(F.lower(text_of(target)), lex.AI_TARGET_WORDS)
    )


def ai_alignment(title: Column) -> Column:
    """How far a title is an AI role; a function of the title alone."""
    low = F.lower(text_of(title))
    padded = F.concat(F.lit(" "), low, F.lit(" "))
    return (
        F.when(any_of(padded, lex.AI_EXCLUDED_WORDS), F.lit(-65.0))
        .when(any_of(padded, lex.AI_EXACT_ROLES), F.lit(35.0))
        .when(any_of(padded, lex.AI_SCIENTIST_ROLES), F.lit(25.0))
        .when(padded.rlike(r"(?U)\b(?:ai|llm|ml)\b") | padded.contains("machine learning"),
              F.lit(15.0))
        .otherwise(F.lit(-45.0))
    )


def target_tokens(target: Column) -> Column:
    """Tokens of a target longer than one character, repeats kept."""
    return F.filter(
        F.regexp_extract_all(F.lower(text_of(target)), F.lit("[a-z0-9+#]+"), F.lit(0)),
        lambda t: F.length(t) > 1,
    )


def _whole_word(title: Column, token: Column) -> Column:
    quoted = F.regexp_replace(token, r"([+#])", r"\\$1")
    return F.regexp_like(title, F.concat(F.lit(r"(?U)\b"), quoted, F.lit(r"\b")))


def target_alignment(target: Column, tokens: Column, title_low: Column) -> Column:
    """30 for the phrase, 24 for every token, 6 a token up to 12, else -30."""
    wanted = F.size(tokens)
    hits = F.size(F.filter(tokens, lambda t: _whole_word(title_low, t)))
    return (
        F.when((text_of(target) == "") | (wanted == 0), F.lit(0.0))
        .when(F.contains(title_low, strip(F.lower(target))), F.lit(30.0))
        .when(hits == wanted, F.lit(24.0))
        .when(hits > 0, F.least(F.lit(12.0), hits * F.lit(6.0)))
        .otherwise(F.lit(-30.0))
    )


def match_score(
    shared_skills: Column, shared_titles: Column, alignment: Column, is_ai: Column,
    ai_fit: Column, has_date: Column, has_url: Column, senior_title: Column, years: Column,
    under: Column,
) -> Column:
    """Heuristic score: capped at 100, no floor, one decimal."""
    high = F.bit_count(shared_skills.bitwiseAND(_long(HIGH_MASK)))
    low = F.bit_count(shared_skills.bitwiseAND(_long(LOW_MASK)))
    titles = F.bit_count(shared_titles)
    total = (
        F.least(high * F.lit(12.0), F.lit(72.0))
        + F.least(low * F.lit(2.0), F.lit(8.0))
        + F.least(titles * F.lit(16.0), F.lit(32.0))
        + alignment
        + F.when(is_ai, ai_fit + F.when(ai_fit < 0, F.lit(-20.0)).otherwise(F.lit(0.0)))
        .otherwise(F.lit(0.0))
        + F.when(has_date, F.lit(5.0)).otherwise(F.lit(0.0))
        + F.when(has_url, F.lit(5.0)).otherwise(F.lit(0.0))
        + F.when(senior_title & F.coalesce(years < 3, F.lit(False)), F.lit(-20.0))
        .otherwise(F.lit(0.0))
        + F.when(under, F.lit(-45.0)).otherwise(F.lit(0.0))
    )
    return F.round(F.least(total, F.lit(100.0)), 1)


def concern_list(
    eligibility: Column, senior_title: Column, years: Column, cv_is_senior: Column, under: Column
) -> Column:
    few_years = F.coalesce(years < 3, F.lit(False))
    return F.array_compact(
        F.array(
            F.when(eligibility, F.lit(lex.CONCERN_ELIGIBILITY)),
            F.when(senior_title & few_years, F.lit(lex.CONCERN_SENIORITY_YEARS)).when(
                senior_title & ~cv_is_senior, F.lit(lex.CONCERN_SENIORITY_REVIEW)
            ),
            F.when(under, F.lit(lex.CONCERN_UNDERLEVEL)),
        )
    )


def bounded_setting(value: float, low: float, high: float) -> float:
    return max(low, min(high, float(value)))


def confidence_route(
    required: Column, years: Column, score: Column, n_skills: Column, n_chars: Column,
    n_concerns: Column, accept_score: float = 85.0, min_skills: int = 2,
    min_description: int = 200,
) -> Column:
    """``rejected`` / ``accepted`` / ``ambiguous``."""
    accept = bounded_setting(accept_score, 60, 100)
    skills = int(bounded_setting(min_skills, 1, 20))
    chars = int(bounded_setting(min_description, 0, 10000))
    return (
        F.when(F.coalesce(required > years, F.lit(False)), F.lit("rejected"))
        .when((score >= accept) & (n_skills >= skills) & (n_chars >= chars) & (n_concerns == 0),
              F.lit("accepted"))
        .otherwise(F.lit("ambiguous"))
    )


def it_position(position: Column) -> Column:
    normal = F.array_join(
        F.regexp_extract_all(F.lower(text_of(position)), F.lit(r"[a-z0-9+#/.]+"), F.lit(0)), " "
    )
    return (normal != "") & any_of(normal, lex.IT_ROLE_TERMS)


def ai_position(position: Column) -> Column:
    return any_of(F.lower(text_of(position)), lex.AI_POSITION_WORDS)


def outside_text(text: Column) -> Column:
    return any_of(text, lex.OUTSIDE_TERMS)


def ai_title(text: Column) -> Column:
    """AI / ML wording in a listing that is not about another country."""
    low = F.concat(F.lit(" "), F.lower(text), F.lit(" "))
    named = any_of(low, lex.AI_TITLE_WORDS)
    loose = low.rlike(r"(?U)\bai\b") & low.rlike("(?U)" + lex.AI_TITLE_ROLE_PATTERN)
    return ~outside_text(low) & (named | loose)


def job_like_text(text: Column) -> Column:
    return any_of(F.lower(text), lex.JOB_TEXT_WORDS) & ai_title(text)


def any_query(haystack: Column, queries: Column) -> Column:
    """Any query phrase, or an AI term together with a technical role."""
    padded = F.concat(F.lit(" "), haystack, F.lit(" "))
    return let(haystack, lambda h: F.exists(queries, lambda q: F.contains(h, q))) | (
        any_of(padded, lex.AI_HAYSTACK_TERMS) & any_of(haystack, lex.TECHNICAL_ROLE_TERMS)
    )


def any_word(haystack: Column, terms: Column) -> Column:
    """Plain containment of any term; no terms means everything passes."""
    return (F.size(terms) == 0) | let(
        haystack, lambda h: F.exists(terms, lambda t: F.contains(h, F.lower(t)))
    )


def listing_relevance(title: Column, target: Column) -> Column:
    """``struct<class int, coverage double>`` used to order a structured inventory."""
    normal = lambda c: F.trim(F.regexp_replace(F.lower(text_of(c)), "[^a-z0-9+#]+", " "))
    want, have = normal(target), normal(title)
    tokens = F.filter(F.split(want, " "), lambda t: ~t.isin("", *lex.SENIORITY_TOKENS))
    hits = F.size(F.filter(tokens, lambda t: _whole_word(have, t)))
    phrase = F.regexp_like(
        have, F.concat(F.lit(r"\b"), F.regexp_replace(want, r"([+#])", r"\\$1"), F.lit(r"\b"))
    )
    coverage = F.coalesce(F.try_divide(hits.cast("double"), F.size(tokens)), F.lit(0.0))
    grade = (
        F.when(want == "", F.lit(0))
        .when(have == want, F.lit(4))
        .when(phrase, F.lit(3))
        .when(F.size(tokens) == 0, F.lit(0))
        .when(hits == F.size(tokens), F.lit(2))
        .when(hits > 0, F.lit(1))
        .otherwise(F.lit(0))
    )
    share = F.when(grade >= 3, F.lit(1.0)).when(want == "", F.lit(0.0)).otherwise(coverage)
    return F.struct(grade.alias("grade"), share.alias("coverage"))


def salary_range(low: Column, high: Column) -> Column:
    low, high = F.nullif(low, F.lit("")), F.nullif(high, F.lit(""))
    return F.coalesce(F.concat(low, F.lit(" - "), high), low, high, F.lit(""))


def salary_offer(low: Column, high: Column, currency: Column, period: Column) -> Column:
    amount = salary_range(low, high)
    text = F.concat(text_of(currency), F.lit(" "), amount, F.lit(" "), text_of(period))
    return F.when(amount == "", F.lit("")).otherwise(strip(text))


__all__ = [n for n in dir() if not n.startswith("_") and n not in ("re", "annotations")]
