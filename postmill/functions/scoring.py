"""Checks of answers from a scorer: JSON text with a score, two judgements, a reason and flags."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from postmill.functions.text import strip_or_empty

ANSWER = "struct<score:string,seniority_fit:string,relevance:string,reasoning:string,flags:array<string>>"


def answer_fault(payload: Column | str, *, seniority: tuple[str, ...], relevance: tuple[str, ...]) -> Column:
    """What is wrong with an answer, the first that is; null for a good one.

    The score must be a whole number from 0 to 100, not text and not a truth value.
    """
    c = F.col(payload) if isinstance(payload, str) else payload
    p = F.from_json(c, ANSWER)
    raw = F.get_json_object(c, "$.score")
    whole = c.rlike(r'"score"\s*:\s*-?\d+\s*[,}]') & raw.try_cast("int").between(0, 100)
    return (
        F.when(c.isNull() | ~F.coalesce(F.trim(c).startswith("{"), F.lit(False)) | p.isNull(), "no JSON object")
        .when(~F.coalesce(whole, F.lit(False)), "score")
        .when(~F.coalesce(p["seniority_fit"].isin(*seniority), F.lit(False)), "seniority_fit")
        .when(~F.coalesce(p["relevance"].isin(*relevance), F.lit(False)), "relevance")
        .when(strip_or_empty(p["reasoning"]) == "", "reasoning")
        .when(p["flags"].isNull(), "flags")
    )


def cost(tokens_in: Column, tokens_out: Column, *, price_in: float, price_out: float) -> Column:
    """What scoring costs, with prices for a million tokens."""
    return (F.coalesce(tokens_in, F.lit(0)) * price_in + F.coalesce(tokens_out, F.lit(0)) * price_out) / 1_000_000


def first_line(c: Column | str, most: int = 200) -> Column:
    """The first line of a text that is not blank, cut to ``most`` characters; empty without one."""
    x = F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))
    lines = F.filter(F.transform(F.split(x, r"\r?\n"), lambda s: F.trim(s)), lambda s: s != "")
    return F.substring(F.coalesce(F.get(lines, F.lit(0)), F.lit("")), 1, most)


def sheet_link(url: Column, text: Column) -> Column:
    """A spreadsheet formula that links ``text`` to ``url``; quotes are doubled, no link gives the text."""
    q = lambda x: F.replace(F.coalesce(x, F.lit("")), F.lit('"'), F.lit('""'))
    return F.when(F.coalesce(url, F.lit("")) == "", F.coalesce(text, F.lit(""))).otherwise(F.concat(F.lit('=HYPERLINK("'), q(url), F.lit('","'), q(text), F.lit('")')))
