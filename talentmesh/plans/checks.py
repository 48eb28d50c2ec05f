"""SQL fragments for the checking side: the rules again, as plain ANSI-style SQL.

Patterns avoid look-around, which the checking engine lacks: a term is tested between
``(^|[^class])`` and ``([^class]|$)``, one term at a time.
"""

from __future__ import annotations

import re

from talentmesh import lexicons as lex


def lit(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def str_list(terms) -> str:
    return f"[{', '.join(lit(t) for t in terms)}]"


def _pattern(term: str) -> str:
    return r"\s+".join(re.sub(r"([^A-Za-z0-9_])", r"\\\1", w) for w in term.split(" "))


def has_term(col: str, term: str, edge: str = "a-z0-9+#") -> str:
    return f"regexp_matches({col}, {lit(f'(^|[^{edge}]){_pattern(term)}([^{edge}]|$)')})"


def any_term(col: str, terms, edge: str = "a-z0-9+#") -> str:
    body = "|".join(_pattern(t) for t in terms)
    return f"regexp_matches({col}, {lit(f'(^|[^{edge}])({body})([^{edge}]|$)')})"


def contains_any(col: str, terms) -> str:
    return "(" + " OR ".join(f"contains({col}, {lit(t)})" for t in terms) + ")"


def in_list(terms) -> str:
    return "(" + ", ".join(lit(t) for t in terms) + ")"


def term_list(col: str, terms) -> str:
    """Terms present in ``col``, alphabetical, as a list."""
    arms = ", ".join(f"CASE WHEN {has_term(col, t)} THEN {lit(t)} END" for t in terms)
    return f"list_filter([{arms}], lambda x: x IS NOT NULL)"


def strip(col: str) -> str:
    return rf"regexp_replace({col}, '^\s+|\s+$', '', 'g')"


def collapse(col: str) -> str:
    return rf"trim(regexp_replace({col}, '[\s\x{{a0}}]+', ' ', 'g'))"


def fold(col: str) -> str:
    return f"replace(lower({col}), 'ß', 'ss')"


def identity(col: str) -> str:
    return f"trim(regexp_replace({fold(col)}, '[^a-z0-9]+', ' ', 'g'))"


def role(col: str) -> str:
    return f"trim(regexp_replace({fold(col)}, '[^a-z0-9+#]+', ' ', 'g'))"


def country(col: str) -> str:
    clean = collapse(f"replace(lower(coalesce({col}, '')), '_', ' ')")
    arms = " ".join(f"WHEN {lit(k)} THEN {lit(v)}" for k, v in lex.COUNTRY_SYNONYMS.items())
    return f"(CASE {clean} {arms} ELSE {clean} END)"


def names_other(place: str, wanted: str) -> str:
    parts = []
    for known in lex.KNOWN_COUNTRIES:
        own = [c for c, places in lex.COUNTRY_PLACES.items() if known in places]
        excluded = [f"{wanted} <> {lit(known)}"] if known not in lex.COUNTRY_PLACES else []
        excluded += [f"{wanted} <> {lit(c)}" for c in own]
        parts.append(f"({' AND '.join(excluded)} AND {has_term(place, known, 'a-z')})")
    return "(" + " OR ".join(parts) + ")"


def in_target(place: str, wanted: str) -> str:
    arms = " ".join(
        f"WHEN {wanted} = {lit(c)} THEN {any_term(place, places, 'a-z')}"
        for c, places in lex.COUNTRY_PLACES.items()
    )
    generic = (
        f"({wanted} <> '' AND regexp_matches({place}, '(^|[^a-z])' || "
        f"replace({wanted}, ' ', '\\s+') || '([^a-z]|$)'))"
    )
    return f"(CASE {arms} ELSE {generic} END)"


def country_ok(place: str, own: str, wanted: str, allow: str) -> str:
    other, inside = names_other(place, wanted), in_target(place, wanted)
    world = any_term(place, lex.GLOBAL_PLACES, "a-z")
    remote = rf"regexp_matches({place}, '\bremote\b')"
    return f"""(CASE
      WHEN {allow} AND {world} AND NOT {other} THEN TRUE
      WHEN {allow} AND {remote} AND NOT {other}
           AND ({own} = '' OR {own} = {wanted} OR ({place} <> '' AND {inside})) THEN TRUE
      WHEN {world} THEN FALSE
      WHEN {place} IN ('remote', 'remote only') THEN {own} = {wanted}
      WHEN {place} <> '' AND {inside} THEN TRUE
      WHEN {place} = '' AND {own} = {wanted} THEN TRUE
      ELSE {own} = {wanted} AND NOT {other} END)"""


def title_minimum(low: str) -> str:
    arms = " ".join(
        f"WHEN regexp_matches({low}, {lit(p)}) THEN {y}" for p, y in lex.SENIORITY_MINIMUMS
    )
    return f"(CASE WHEN {contains_any(low, lex.ENTRY_TITLE_TERMS)} THEN 0.0 {arms} END)"


def required_years(title: str, description: str) -> str:
    text = f"lower({title} || '. ' || {description})"
    lists = ", ".join(
        f"list_transform(regexp_extract_all({text}, {lit(p)}, 1), lambda y: CAST(y AS DOUBLE))"
        for p in lex.YEARS_PATTERNS
    )
    stated = f"list_max(list_filter(list_concat({lists}), lambda y: y <= 60))"
    return f"greatest({stated}, CAST({title_minimum(f'lower({title})')} AS DOUBLE))"


def role_gate(title: str, target: str) -> str:
    """Role gate of one title and one target text."""
    padded = f"(' ' || {role(title)} || ' ')"
    norm = role(target)
    has = lambda p: f"contains({padded}, {lit(f' {p} ')})"
    clean = lambda p: " ".join(re.sub("[^a-z0-9+#]+", " ", p.lower()).split())
    arms = []
    for markers, related in lex.ROLE_FAMILIES:
        mark = " OR ".join(
            f"contains(' ' || {norm} || ' ', {lit(f' {clean(m)} ')})" for m in markers
        )
        hit = " OR ".join(has(clean(p)) for p in related)
        arms.append(f"WHEN {mark} THEN ({hit})")
    tokens = (
        f"list_filter(string_split({norm}, ' '), lambda t: length(t) > 1 "
        f"AND t NOT IN {in_list(lex.SENIORITY_TOKENS)})"
    )
    special = f"list_filter({tokens}, lambda t: t NOT IN {in_list(lex.GENERIC_ROLE_TOKENS)})"
    found = lambda ts: f"len(list_filter({ts}, lambda t: contains({padded}, ' ' || t || ' ')))"
    return f"""(CASE WHEN trim({target}) = '' THEN TRUE
      WHEN {norm} <> '' AND contains({padded}, ' ' || {norm} || ' ') THEN TRUE
      {' '.join(arms)}
      WHEN len({special}) > 0 THEN {found(special)} > 0
      WHEN len({tokens}) = 0 THEN FALSE
      ELSE {found(tokens)} >= greatest(1, (len({tokens}) + 1) // 2) END)"""


def word_in(text: str, token: str) -> str:
    return (
        rf"regexp_matches({text}, '\b' || replace(replace({token}, '+', '\+'), '#', '\#') || '\b')"
    )


def target_alignment(target: str, low: str) -> str:
    tokens = (
        f"list_filter(regexp_extract_all(lower({target}), '[a-z0-9+#]+'), lambda t: length(t) > 1)"
    )
    hits = f"len(list_filter({tokens}, lambda t: {word_in(low, 't')}))"
    return f"""(CASE WHEN {target} = '' OR len({tokens}) = 0 THEN 0.0
      WHEN contains({low}, trim(lower({target}))) THEN 30.0
      WHEN {hits} = len({tokens}) THEN 24.0
      WHEN {hits} > 0 THEN least(12.0, {hits} * 6.0) ELSE -30.0 END)"""


def ai_alignment(low: str) -> str:
    padded = f"(' ' || {low} || ' ')"
    return f"""(CASE WHEN {contains_any(padded, lex.AI_EXCLUDED_WORDS)} THEN -65.0
      WHEN {contains_any(padded, lex.AI_EXACT_ROLES)} THEN 35.0
      WHEN {contains_any(padded, lex.AI_SCIENTIST_ROLES)} THEN 25.0
      WHEN regexp_matches({padded}, '\\b(ai|llm|ml)\\b') OR contains({padded}, 'machine learning')
        THEN 15.0 ELSE -45.0 END)"""


def closed(title: str, description: str) -> str:
    return contains_any(f"lower({title} || ' ' || {description})", lex.CLOSED_JOB_PHRASES)


POSTED = """(CASE seq % 6 WHEN 0 THEN CAST(posted AS TIMESTAMP)
  WHEN 1 THEN CAST(posted AS TIMESTAMP) + INTERVAL 510 MINUTE
  WHEN 2 THEN CAST(posted AS TIMESTAMP) + INTERVAL 10 HOUR
  WHEN 5 THEN CAST(posted AS TIMESTAMP) + INTERVAL 1065 MINUTE END)"""
"""The instant behind the view's date texts (23:15 at +05:30 is 17:45 UTC)."""


def fresh(published: str, days: int, now: str) -> str:
    clock = f"CAST({lit(now)} AS TIMESTAMP)"
    return f"""(CASE WHEN {closed('title', 'description')} THEN FALSE
      WHEN {published} > {clock} + INTERVAL 1 DAY THEN FALSE
      WHEN {published} < {clock} - INTERVAL {days} DAY
           AND source NOT IN {in_list(lex.CURRENT_OPEN_SOURCES)} THEN FALSE
      WHEN {published} IS NULL AND source IN {in_list(lex.DISCOVERY_SOURCES)}
           AND NOT detail_page_verified THEN FALSE ELSE TRUE END)"""


def vacancy_features(jobs: str = "jobs") -> str:
    """CTE ``feats``: what matching needs of every vacancy."""
    return f"""feats AS (
  SELECT seq, title, lower(title) AS low, {strip('lower(location)')} AS place,
         {country('country_hint')} AS own, {term_list('hay', lex.SKILLS)} AS skills,
         {term_list('lower(title)', lex.TITLE_TERMS)} AS titles,
         {required_years('title', 'description')} AS req,
         {ai_alignment('lower(title)')} AS ai_fit,
         CASE WHEN published_raw <> '' THEN 5.0 ELSE 0.0 END
           + CASE WHEN url <> '' THEN 5.0 ELSE 0.0 END AS extras,
         {contains_any('hay', lex.ELIGIBILITY_WORDS)} AS eligibility,
         {contains_any('lower(title)', lex.SENIOR_TITLE_WORDS)} AS senior,
         regexp_matches(lower(title), {lit(lex.UNDERLEVEL_PATTERN)}) AS entry,
         length({strip('description')}) >= 200 AS long_text
  FROM (SELECT *, lower(title || ' ' || description) AS hay FROM {jobs}) h
)"""


def scored_pairs(jobs: str = "jobs") -> str:
    """CTEs ending in ``scored``: every gated (candidate, vacancy) pair with its score."""
    split = lambda c: f"list_filter(string_split({c}, '|'), lambda t: t <> '')"
    return f"""{vacancy_features(jobs)},
cands AS (
  SELECT *, {split('skills_text')} AS skills, {split('titles_text')} AS titles,
         {country('country')} AS wanted,
         {contains_any('lower(raw_text)', lex.SENIOR_CV_WORDS)} AS cv_senior,
         regexp_matches(lower(target_position), {lit(lex.UNDERLEVEL_PATTERN)}) AS asks_entry
  FROM people
),
flags AS (
  SELECT *, len(list_intersect(titles, [{', '.join(lit(t) for t in lex.AI_PROFILE_TITLES)}])) > 0
    OR len(list_intersect(skills, [{', '.join(lit(t) for t in lex.AI_PROFILE_SKILLS)}])) > 0
    OR {contains_any('lower(target_position)', lex.AI_TARGET_WORDS)} AS is_ai,
    CASE WHEN target_position <> '' THEN [target_position]
         WHEN len(titles) > 0 THEN titles ELSE [''] END AS asked
  FROM cands
),
wanted_roles AS (SELECT DISTINCT unnest(asked) AS role FROM flags),
gate AS (
  SELECT role, low, {role_gate('low', 'role')} AS ok, {target_alignment('role', 'low')} AS fit
  FROM wanted_roles CROSS JOIN (SELECT DISTINCT low FROM feats) t
),
asked AS (SELECT candidate_id, unnest(asked) AS role FROM flags),
reach AS (
  SELECT DISTINCT a.candidate_id, g.low FROM asked a JOIN gate g ON g.role = a.role AND g.ok
),
spots AS (SELECT DISTINCT place, own FROM feats),
zones AS (SELECT DISTINCT wanted, allow_global_remote AS allow FROM flags),
geo AS (
  SELECT place, own, wanted, allow FROM spots CROSS JOIN zones
  WHERE {country_ok('place', 'own', 'wanted', 'allow')}
),
pairs AS (
  SELECT c.candidate_id, f.seq, f.req, f.long_text, f.eligibility, f.senior, c.cv_senior,
         c.experience_years AS years,
         list_sort(list_intersect(c.skills, f.skills)) AS shared,
         list_sort(list_intersect(c.titles, f.titles)) AS named,
         c.is_ai, f.ai_fit, f.extras,
         CASE WHEN c.target_position = '' THEN 0.0 ELSE g.fit END AS fit,
         coalesce(c.experience_years >= 3 AND NOT c.asks_entry AND f.entry, FALSE) AS under
  FROM flags c
  JOIN reach r ON r.candidate_id = c.candidate_id
  JOIN feats f ON f.low = r.low
  JOIN geo z ON z.place = f.place AND z.own = f.own AND z.wanted = c.wanted
            AND z.allow = c.allow_global_remote
  LEFT JOIN gate g ON g.role = c.target_position AND g.low = f.low
),
scored AS (
  SELECT *, round(CAST(least(100.0,
      least(12.0 * len(list_intersect(shared, [{', '.join(lit(t) for t in lex.HIGH_VALUE_SKILLS)}])), 72.0)
    + least(2.0 * len(list_intersect(shared, [{', '.join(lit(t) for t in lex.LOW_SIGNAL_SKILLS)}])), 8.0)
    + least(16.0 * len(named), 32.0) + fit
    + CASE WHEN is_ai THEN ai_fit + CASE WHEN ai_fit < 0 THEN -20.0 ELSE 0.0 END ELSE 0.0 END
    + extras
    + CASE WHEN senior AND years < 3 THEN -20.0 ELSE 0.0 END
    + CASE WHEN under THEN -45.0 ELSE 0.0 END) AS DOUBLE), 1) AS score,
    CASE WHEN eligibility THEN [{lit(lex.CONCERN_ELIGIBILITY)}] ELSE CAST([] AS VARCHAR[]) END
    || CASE WHEN senior AND years < 3 THEN [{lit(lex.CONCERN_SENIORITY_YEARS)}]
            WHEN senior AND NOT cv_senior THEN [{lit(lex.CONCERN_SENIORITY_REVIEW)}]
            ELSE CAST([] AS VARCHAR[]) END
    || CASE WHEN under THEN [{lit(lex.CONCERN_UNDERLEVEL)}] ELSE CAST([] AS VARCHAR[]) END
      AS concerns
  FROM pairs
),
routed AS (
  SELECT *, CASE WHEN req > years THEN 'rejected'
    WHEN score >= 85 AND len(shared) >= 2 AND long_text AND len(concerns) = 0 THEN 'accepted'
    ELSE 'ambiguous' END AS route
  FROM scored
)"""
