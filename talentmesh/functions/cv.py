"""CV text to candidate fields, as array expressions over the lines of a document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talentmesh import lexicons as lex
from talentmesh.functions.text import (
    any_of, cv_skill_mask, cv_title_mask, mask_to_array, strip, text_of, words,
)

# --- fixed values: patterns of CV fields ----------------------------------------------------------
EMAIL = r"(?U)[\w.+-]+@[\w.-]+\.[A-Za-z]{2,}"
PHONE = r"(?U)\+?\d[\d\s().-]{7,}\d"
LINK = r"(?iU)https?://\S+|www\.\S+"
LINE_BREAK = r"\R|[\x1c-\x1e]"
# Where a CV is searched by default, in lines, and the most words of a line that names a role.
NAME_LINES, HEADLINE_LINES, TITLE_LINES, EXPERIENCE_LINES, ROLE_WORDS = 5, 60, 25, 30, 14


def lines_of(c: Column) -> Column:
    """Trimmed, non-empty lines."""
    return F.filter(F.transform(F.split(c, LINE_BREAK), strip), lambda s: s != "")


def first_email(c: Column) -> Column:
    return F.regexp_extract(c, EMAIL, 0)


def first_phone(c: Column) -> Column:
    return strip(F.regexp_extract(c, PHONE, 0))


def links(c: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(c, F.lit(LINK), F.lit(0)))


def _word_count(line: Column) -> Column:
    return F.size(words(line))


def title_case(line: Column) -> Column:
    """Every run of letters capitalised, also after an apostrophe or a dash."""
    runs = F.regexp_extract_all(line, F.lit(r"\p{L}+|\P{L}+"), F.lit(0))
    return F.array_join(
        F.transform(
            runs,
            lambda r: F.concat(F.upper(F.substring(r, 1, 1)), F.lower(F.substr(r, F.lit(2)))),
        ),
        "",
    )


def _first(lines: Column, n: int | None) -> Column:
    return lines if n is None else F.slice(lines, 1, n)


def person_name(lines: Column, email: Column, name_lines: int | None = NAME_LINES,
                headline_lines: int | None = HEADLINE_LINES) -> Column:
    """A short line near the top, else an upper-case line further down, else ''; None searches all lines."""
    mail = F.lower(email)

    def without_mail(line: Column) -> Column:
        return (mail == "") | ~F.contains(F.lower(line), mail)

    plain = F.filter(
        _first(lines, name_lines),
        lambda s: without_mail(s)
        & ~any_of(F.lower(s), ("http", "linkedin", "@"))
        & _word_count(s).between(2, 5),
    )
    loud = F.filter(
        _first(lines, headline_lines),
        lambda s: ~F.lower(s).isin(*lex.SECTION_HEADINGS)
        & without_mail(s)
        & ~s.rlike(r"\p{Nd}")
        & ~any_of(F.lower(s), ("@", "http"))
        & _word_count(s).between(2, 4)
        & (F.upper(s) == s),
    )
    return F.coalesce(
        F.try_element_at(plain, F.lit(1)), title_case(F.try_element_at(loud, F.lit(1))), F.lit("")
    )


def likely_titles(lines: Column, title_lines: int | None = TITLE_LINES) -> Column:
    """Title terms of the opening lines and of short lines that read like a title."""
    titled = F.filter(
        lines,
        lambda s: (_word_count(s) <= ROLE_WORDS)
        & any_of(F.lower(s), lex.TITLE_CONTEXT_TERMS),
    )
    text = F.array_join(F.concat(_first(lines, title_lines), titled), "\n")
    return mask_to_array(cv_title_mask(text), lex.TITLE_TERMS)


def experience_lines(lines: Column, limit: int | None = EXPERIENCE_LINES) -> Column:
    kept = F.filter(
        lines,
        lambda s: s.startswith("-") | s.startswith("*")
        | (any_of(F.lower(s), lex.TITLE_TERMS) & (_word_count(s) <= ROLE_WORDS)),
    )
    return _first(kept, limit)


def cv_skills(c: Column) -> Column:
    return mask_to_array(cv_skill_mask(c), lex.SKILLS)


def repair_spacing(c: Column) -> Column:
    """Join the letters of lines that were extracted letter by letter."""

    def fix(line: Column) -> Column:
        bare = strip(line)
        tokens = F.filter(F.split(bare, " "), lambda t: t != "")
        short = F.size(F.filter(tokens, lambda t: F.length(t) <= 2))
        spaced = (
            (F.length(bare) >= 6) & (F.size(tokens) >= 3) & (short / F.size(tokens) > 0.7)
        )
        joined = F.array_join(
            F.transform(
                F.filter(F.split(bare, r"(?U)\s{2,}"), lambda w: w != ""),
                lambda w: F.replace(w, F.lit(" "), F.lit("")),
            ),
            " ",
        )
        return F.when(spaced, joined).otherwise(line)

    return F.array_join(F.transform(F.split(c, LINE_BREAK), fix), "\n")


def parse_cvs(documents: DataFrame, text: str = "raw_text") -> DataFrame:
    """Add the extracted candidate fields to a table of CV texts."""
    raw = text_of(text)
    staged = documents.withColumn("__lines", lines_of(raw)).withColumn("email", first_email(raw))
    at = F.col("__lines")
    return staged.select(
        *[c for c in documents.columns],
        person_name(at, F.col("email")).alias("name"),
        "email",
        first_phone(raw).alias("phone"),
        links(raw).alias("links"),
        cv_skills(raw).alias("skills"),
        likely_titles(at).alias("likely_titles"),
        experience_lines(at).alias("experience_lines"),
    )


def read_cvs(spark, path: str) -> DataFrame:
    """One row per text or Markdown file (decoded as UTF-8, whole file)."""
    return spark.read.text(path, wholetext=True, pathGlobFilter="*.{txt,md}").select(
        F.substring_index(F.input_file_name(), "/", -1).alias("candidate_id"),
        F.col("value").alias("raw_text"),
    )
