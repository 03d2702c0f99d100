"""Keyword matching with attribution: which configured keyword hit first."""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postmill.functions.text import fold_case

KINDS = {"word": r"\b{}\b", "prefix": r"\b{}", "contains": "{}"}


def pattern(keyword: str, kind: str, *, exact_acronyms: bool = False) -> str:
    """A Java regular expression for a keyword; unknown kinds are words.

    Case is ignored, except for a keyword in capitals when ``exact_acronyms``. (?U) makes letters,
    white space and word limits those of Unicode.
    """
    body = KINDS.get(kind, KINDS["word"]).format(re.escape(keyword))
    flags = "(?uU)" if exact_acronyms and keyword.isupper() else "(?iuU)"
    return flags + body


def first_match(text: Column | str, keywords: Sequence[tuple[str, str]], *, label: str = "", exact_acronyms: bool = False) -> Column:
    """"label: 'keyword' (kind)" of the first configured keyword that hits; null when none does."""
    c = F.col(text) if isinstance(text, str) else text
    prefix = f"{label}: " if label else ""
    each = [pattern(k, kind, exact_acronyms=exact_acronyms) for k, kind in keywords]
    arms = [F.when(c.rlike(p), F.lit(f"{prefix}'{k}' ({kind})")) for p, (k, kind) in zip(each, keywords)]
    if len(arms) < 3:
        return F.coalesce(*arms, F.lit(None).cast("string"))
    # Most texts match none: one pattern of all says so, and only those that it hits are asked which.
    return F.when(c.rlike("|".join(f"(?:{p})" for p in each)), F.coalesce(*arms))


def all_hits(text: Column | str, keywords: Sequence[str]) -> Column:
    """All keywords that the folded text holds, in configured order."""
    c = fold_case(text)
    return F.filter(F.array(*[F.lit(k) for k in keywords]).cast("array<string>"), lambda k: F.contains(c, fold_case(k)))


def haystack(*columns: str) -> Column:
    """The columns joined by single spaces, null as empty, empty parts kept."""
    parts = [F.coalesce(F.col(c), F.lit("")) for c in columns]
    return reduce(lambda a, b: F.concat(a, F.lit(" "), b), parts)


def keyword_rule(text: Column | str, *, exclude: Sequence[str] = (), include: Sequence[str] = ()) -> Column:
    """Substring rules, whatever the case: the first of ``exclude`` that hits, or that none of ``include`` does; null when the text passes."""
    c = fold_case(text)
    arms = [F.when(F.contains(c, fold_case(F.lit(k))), F.lit(f"exclude_keywords: matched {k!r}")) for k in exclude]
    if include:
        arms.append(F.when(F.size(all_hits(text, include)) == 0, F.lit("include_keywords: no match")))
    return F.coalesce(*arms, F.lit(None).cast("string"))


def split_by_rule(rows: DataFrame, rule: Column) -> tuple[DataFrame, DataFrame]:
    """(kept, dropped) rows; the dropped ones with the rule that hit as drop_rule."""
    marked = rows.withColumn("drop_rule", rule)
    return marked.where("drop_rule IS NULL").drop("drop_rule"), marked.where("drop_rule IS NOT NULL")


# What divides the options of a free location; results must agree with stored ones.
OPTION_MARKS = r"[|/\n;]+"
# Words that say "several places", with a figure or one of COUNTS before WHERES, or alone.
COUNTS, WHERES, ALONE = ("multiple", "several", "various", "many"), ("location", "locations", "places", "cities", "offices", "sites"), ("various", "multiple", "several")
# Words that name the field instead of filling it.
LABELS = (
    "title", "location", "locations", "city", "country", "place", "department", "unknown", "n/a", "na", "none", "null", "tbd", "tba", "-", "–", "—",
    "not specified", "see description", "ort", "plats", "standort", "arbetsort",
)
# Letters of pay grades, which a figure of one or two places follows, and words before a grade.
GRADES, GRADE_WORDS = ("p", "d", "g", "gs", "ns", "no", "noa", "nob", "noc", "nod", "sb", "fs", "ics", "iica", "lica", "ug"), ("grade", "level", "band")


def options(location: Column | str) -> Column:
    """The options that a free location names, between | / ; and line ends; without blank ones."""
    c = F.col(location) if isinstance(location, str) else location
    return F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), OPTION_MARKS), F.trim), lambda x: x != "")


def value_kind(location: Column | str, title: Column | str) -> Column:
    """Kind of a location value: empty, title (equal to it), placeholder, label, grade or place; the first that fits.

    White space is one blank and case does not count.
    """

    def plain(x: Column | str) -> Column:
        return fold_case(F.trim(F.regexp_replace(F.coalesce(F.col(x) if isinstance(x, str) else x, F.lit("")), r"(?U)\s+", " ")))

    either = "|".join
    many = rf"^([0-9]+|{either(COUNTS)}) ({either(WHERES)})$"
    grade = rf"^({either(GRADES)})[ -]?[0-9]{{1,2}}$|^({either(GRADE_WORDS)}) \S+$"

    def kind(x: Column) -> Column:
        c = x["c"]
        return (
            F.when(c == "", "empty")
            .when(c == x["t"], "title")
            .when(c.rlike(many) | c.isin(*ALONE), "placeholder")
            .when(c.isin(*LABELS), "label")
            .when(c.rlike(grade), "grade")
            .otherwise("place")
        )

    # Inside the lambda the plain texts are values: no arm works them out again.
    return F.get(F.transform(F.array(F.struct(plain(location).alias("c"), plain(title).alias("t"))), kind), F.lit(0))
