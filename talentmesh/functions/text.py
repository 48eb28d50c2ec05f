"""Text expressions: normal forms, term masks, HTML to text, bounded evidence.

Everything here is a ``Column -> Column`` expression that stays inside whole-stage
code generation; nothing touches Python.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Callable, Iterable, Sequence
from html.entities import name2codepoint

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talentmesh import lexicons as lex

SPACES = r"(?U)\s+"
UNIT = "\u001f"


def text_of(c: Column | str) -> Column:
    """Absent text is the empty string throughout the model."""
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))


def never_null(c: Column) -> Column:
    """Mark a text as present. Join keys built from expressions are wrapped in this, so the
    optimizer has no null test to infer and to copy, with the expression, into the scan."""
    return F.coalesce(c, F.lit(""))


def explode_some(values: Column) -> Column:
    """Explode an array known to have members.

    The outer form keeps the optimizer from inferring ``size(...) > 0`` and copying the
    whole array expression into a filter below.
    """
    return F.explode_outer(values)


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once and use it many times inside ``body``.

    An expression written inside a lambda runs once per element; here it becomes the lambda
    variable of a one-element array instead.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def computed(df: DataFrame, **columns: Column) -> DataFrame:
    """Add columns that are worked out once per row and never again.

    They pass through a one-row generator, below which the optimizer cannot push a filter on
    them; otherwise each such filter would repeat the whole expression in the scan.
    """
    bundle = F.struct(*[c.alias(n) for n, c in columns.items()])
    kept = [c for c in df.columns if c not in columns]
    return df.select(*kept, F.explode_outer(F.array(bundle)).alias("__made")).select(
        *kept, *[F.col(f"__made.{n}").alias(n) for n in columns]
    )


def strip(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def collapse(c: Column) -> Column:
    """Runs of white space become one blank; ends are trimmed."""
    return F.trim(F.regexp_replace(c, SPACES, " "))


def fold(c: Column) -> Column:
    """Case folding: lower case plus the one expansion that matters, sharp s."""
    return F.replace(F.lower(c), F.lit("ß"), F.lit("ss"))


def identity_text(c: Column) -> Column:
    """Letters and digits only, single blanks: the form used to compare identities."""
    return F.trim(F.regexp_replace(fold(c), "[^a-z0-9]+", " "))


def role_text(c: Column) -> Column:
    """Like :func:`identity_text` but keeps ``+`` and ``#`` (c++, c#)."""
    return F.trim(F.regexp_replace(fold(c), "[^a-z0-9+#]+", " "))


def company_key(c: Column) -> Column:
    return collapse(F.lower(c))


def words(c: Column) -> Column:
    """White-space separated words, without empty ones."""
    return F.filter(F.split(collapse(c), " "), lambda w: w != "")


def any_of(c: Column, phrases: Iterable[str]) -> Column:
    """True when any phrase occurs as a plain substring."""
    return F.coalesce(c.rlike("|".join(re.escape(p) for p in phrases)), F.lit(False))


def holds_any(c: Column, phrases: Iterable[str]) -> Column:
    """Like :func:`any_of`, for a few phrases in long texts: each is looked for by itself."""
    return F.coalesce(functools.reduce(lambda a, b: a | b, [c.contains(p) for p in phrases]), F.lit(False))


def stripped_length(c: Column) -> Column:
    """``length(strip(c))``; a text that neither begins nor ends with white space is not written anew."""
    bare = F.substring(c, 1, 1).rlike(r"(?U)\S") & F.substring(c, -1, 1).rlike(r"(?U)\S")
    return F.when(bare, F.length(c)).otherwise(F.length(strip(c)))


#: What stands between the words of a term: white space, or in CVs whatever no term is made of.
BLANK, CV_GAP = r"(?U:\s+)", "[^a-z0-9+#/]+"


def java_quote(term: str, gap: str = BLANK) -> str:
    """A literal for a Java pattern, blanks matching any ``gap``."""
    return gap.join(re.sub(r"([^A-Za-z0-9_ ])", r"\\\1", w) for w in term.split(" "))


def _grouped_alternation(terms: Sequence[str], gap: str = BLANK) -> str:
    """``(?:a(?:b|c)|d...)``: one branch per first character, so that a position that
    cannot start any term is refused after one comparison."""
    by_head: dict[str, list[str]] = {}
    for term in sorted(terms, key=len, reverse=True):
        by_head.setdefault(term[0], []).append(term)
    branches = []
    for head, group in sorted(by_head.items()):
        tails = "|".join(java_quote(t, gap)[len(java_quote(head)):] for t in group)
        branches.append(f"{java_quote(head)}(?:{tails})")
    return "(?:" + "|".join(branches) + ")"


def _cv_pattern(terms: Sequence[str]) -> str:
    """Finds in lower-cased text what stands in it as :func:`cv_text`; a term with other signs never does."""
    held = [t for t in terms if not re.search(CV_GAP, t.replace(" ", ""))]
    return rf"(?<![a-z0-9+#]){_grouped_alternation(held, CV_GAP)}(?![a-z0-9+#])"


SKILL_PATTERN = rf"(?<![a-z0-9+#]){_grouped_alternation(lex.SKILLS)}(?![a-z0-9+#])"
CV_SKILL_PATTERN = _cv_pattern(lex.SKILLS)


def constant_array(terms: Sequence[str]) -> Column:
    """A constant array of strings; folded to one literal when the plan is optimised."""
    return F.split(F.lit(UNIT.join(terms)), UNIT)


def _bit_of(terms: Sequence[str], term: Column) -> Column:
    position = F.array_position(constant_array(terms), term)
    return F.call_function("shiftleft", F.lit(1).cast("long"), (position - 1).cast("int"))


def _one_blank(gap: str) -> Callable[[Column], Column]:
    return collapse if gap == BLANK else lambda hit: F.regexp_replace(hit, gap, " ")


def skill_mask(lowered: Column, pattern: str = SKILL_PATTERN, gap: str = BLANK) -> Column:
    """Skills present in lower-cased text as a 60-bit mask (bit = place in the lexicon).

    No skill is part of another at a word boundary, so one alternation finds them all.
    """
    hits = F.array_distinct(
        F.transform(
            F.regexp_extract_all(lowered, F.lit(pattern), F.lit(0)), _one_blank(gap)
        )
    )
    return F.aggregate(
        hits, F.lit(0).cast("long"), lambda acc, s: acc.bitwiseOR(_bit_of(lex.SKILLS, s))
    )


def _implied_titles() -> dict[str, int]:
    """Mask of every title term together with the shorter terms it contains as words."""
    padded = {t: f" {t} " for t in lex.TITLE_TERMS}
    return {
        t: sum(1 << i for i, u in enumerate(lex.TITLE_TERMS) if padded[u] in padded[t])
        for t in lex.TITLE_TERMS
    }


TITLE_PATTERN = rf"(?<![a-z0-9+#]){_grouped_alternation(lex.TITLE_TERMS)}(?![a-z0-9+#])"
CV_TITLE_PATTERN = _cv_pattern(lex.TITLE_TERMS)
_IMPLIED = _implied_titles()


def title_mask(lowered: Column, pattern: str = TITLE_PATTERN, gap: str = BLANK) -> Column:
    """Title terms present as a 22-bit mask.

    Terms nest but never overlap otherwise, so the longest hits are found by one pattern
    and each adds the terms inside it.
    """
    hits = F.array_distinct(
        F.transform(F.regexp_extract_all(lowered, F.lit(pattern), F.lit(0)), _one_blank(gap))
    )
    masks = F.split(F.lit(",".join(str(_IMPLIED[t]) for t in lex.TITLE_TERMS)), ",")
    return F.aggregate(
        hits,
        F.lit(0).cast("long"),
        lambda acc, t: acc.bitwiseOR(
            F.element_at(
                masks, F.array_position(constant_array(lex.TITLE_TERMS), t).cast("int")
            ).cast("long")
        ),
    )


def mask_of_array(values: Column, terms: Sequence[str]) -> Column:
    """Mask of the array members that belong to the lexicon."""
    known = constant_array(terms)
    return F.aggregate(
        F.array_distinct(F.filter(values, lambda v: F.array_contains(known, v))),
        F.lit(0).cast("long"),
        lambda acc, s: acc.bitwiseOR(_bit_of(terms, s)),
    )


def mask_bits(terms: Iterable[str], lexicon: Sequence[str]) -> int:
    return sum(1 << lexicon.index(t) for t in terms)


def mask_to_array(mask: Column, terms: Sequence[str]) -> Column:
    """Lexicon terms of a mask, in lexicon (alphabetical) order."""
    return let(
        mask, lambda m: F.filter(constant_array(terms), lambda t, i: F.getbit(m, i) == 1)
    )


def cv_text(c: Column) -> Column:
    """The form CV terms are matched on: lower case, ``+ # /`` kept."""
    return F.regexp_replace(F.lower(c), CV_GAP, " ")


def cv_skill_mask(c: Column) -> Column:
    """``skill_mask(cv_text(c))`` without writing that text."""
    return skill_mask(F.lower(c), CV_SKILL_PATTERN, CV_GAP)


def cv_title_mask(c: Column) -> Column:
    """``title_mask(cv_text(c))`` without writing that text."""
    return title_mask(F.lower(c), CV_TITLE_PATTERN, CV_GAP)


# --- HTML ----------------------------------------------------------------------------------------

_ENTITY = r"&(?:#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]*);"


# One constant; the optimizer folds it to a map literal.
_NAMED = "\u001e".join(f"{n}\u001f{chr(p)}" for n, p in sorted(name2codepoint.items()))


def _entity_value(entity: Column) -> Column:
    names = F.str_to_map(F.lit(_NAMED), F.lit("\u001e"), F.lit("\u001f"))
    body = F.substr(entity, F.lit(2), F.length(entity) - 2)
    code = F.when(
        body.rlike("^#[xX]"), F.conv(F.substr(body, F.lit(3)), 16, 10)
    ).otherwise(F.substr(body, F.lit(2)))
    numeric = let(
        F.coalesce(code.try_cast("int"), F.lit(0)),
        lambda point: F.when(
            (point > 0) & (point < 0x110000) & ~point.between(0xD800, 0xDFFF),
            F.decode(F.unhex(F.lpad(F.hex(point), 8, "0")), "UTF-32"),
        ).otherwise(F.lit("\ufffd")),
    )
    value = F.when(body.startswith("#"), numeric).otherwise(F.try_element_at(names, body))
    return F.coalesce(value, entity)


def unescape(c: Column) -> Column:
    """Decode numeric and HTML 4 named entities on the JVM.

    Every distinct entity of a text is replaced in one pass, those that stand for an
    ampersand last, so that ``&amp;lt;`` becomes ``&lt;`` and not ``<``. Names that only
    HTML 5 has, or that lack the semicolon, stay as they are.
    """

    def decoded(text: Column) -> Column:
        found = F.array_distinct(F.regexp_extract_all(text, F.lit(_ENTITY), F.lit(0)))
        valued = F.transform(
            found, lambda e: F.struct(e.alias("e"), _entity_value(e).alias("v")))
        ordered = F.array_sort(F.transform(
            valued, lambda p: F.struct((p["v"] == "&").alias("last"), p["e"], p["v"])))
        return F.aggregate(ordered, text, lambda acc, p: F.replace(acc, p["e"], p["v"]))

    return let(c, lambda text: F.when(text.contains("&"), decoded(text)).otherwise(text))


def clean_html(c: Column, decode=unescape) -> Column:
    """Readable text of a fragment: breaks, tags dropped, entities decoded, one line."""
    broken = F.regexp_replace(c, r"(?i)<br\s*/?>|</p>|</li>", "\n")
    return collapse(decode(F.regexp_replace(broken, "<[^>]+>", " ")))


def clean_ats_html(c: Column, decode=unescape) -> Column:
    """The variant used by applicant-tracking feeds (block tags become blanks)."""
    broken = F.regexp_replace(c, r"(?i)<(?:br|/p|/li|/div|/h[0-9])\b[^>]*>", " ")
    return collapse(decode(F.regexp_replace(broken, "<[^>]+>", " ")))


def clean_page_text(c: Column, decode=unescape) -> Column:
    """Scripts and styles removed first; used for contact pages."""
    bare = F.regexp_replace(c, r"(?is)<(script|style).*?>.*?</\1>", " ")
    return collapse(decode(F.regexp_replace(bare, "<[^>]+>", " ")))


def first_group(c: Column, pattern: str, group: int = 1) -> Column:
    return strip(F.regexp_extract(c, pattern, group))


def attribute(tag: Column, name: str, decode=lambda c: c) -> Column:
    """Value of an HTML attribute, quoted either way or bare; '' when absent.

    Values are returned as written; pass ``unescape`` where entities may occur."""
    head = rf"(?is)\b{re.escape(name)}\s*=\s*"
    value = F.coalesce(
        F.nullif(F.regexp_extract(tag, head + r'"([^"]*)"', 1), F.lit("")),
        F.nullif(F.regexp_extract(tag, head + r"'([^']*)'", 1), F.lit("")),
        F.nullif(F.regexp_extract(tag, head + r"([^\s>\"']+)", 1), F.lit("")),
        F.lit(""),
    )
    return decode(value)


# --- bounded evidence ----------------------------------------------------------------------------


def bounded_text(c: Column, limit: int) -> Column:
    """Two thirds head, marker, one third tail when the text exceeds the limit."""
    budget = max(0, limit - len(lex.EVIDENCE_GAP))
    head = budget * 2 // 3
    tail = budget - head
    cut = F.concat(
        F.substring(c, 1, head),
        F.lit(lex.EVIDENCE_GAP),
        F.substr(c, F.length(c) - tail + 1, F.lit(tail)) if tail else F.lit(""),
    )
    return F.when(F.length(c) <= limit, c).otherwise(cut)


def bounded_items(values: Column, max_items: int, item_limit: int) -> Column:
    """Beginning and end of a long array, every item bounded."""
    head = max_items * 2 // 3
    tail = max_items - head
    kept = F.when(F.size(values) <= max_items, values).otherwise(
        F.concat(F.slice(values, 1, head), F.slice(values, -tail, tail))
    )
    return F.transform(kept, lambda v: bounded_text(v, item_limit))


def guard_formula(c: Column) -> Column:
    """Spreadsheet guard: a cell that would be read as a formula gets a quote in front."""
    return F.when(c.rlike(r"(?U)^\s*[=+\-@]"), F.concat(F.lit("'"), c)).otherwise(c)


def masked_email(c: Column) -> Column:
    local = F.substring_index(c, "@", 1)
    domain = F.substring_index(c, "@", -1)
    return F.when(
        c.contains("@") & (local != ""), F.concat(F.substring(local, 1, 1), F.lit("***@"), domain)
    ).otherwise(F.lit("***"))
