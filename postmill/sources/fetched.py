"""What was fetched: whether a stored answer may still be used, and whether a host lets a page be read."""

from __future__ import annotations

import re
from collections.abc import Iterator
from urllib.robotparser import RobotFileParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postmill.operators.identity import origin

TTL_SECONDS = 30 * 60


def cache_state(fetched_us: Column, now_us: Column, validator: Column, *, ttl: int = TTL_SECONDS) -> Column:
    """hit (younger than ``ttl``), revalidate (older, with an etag or date to ask by) or miss; an answer from the future is a miss."""
    age = now_us - fetched_us
    fresh = (age >= 0) & (age <= ttl * 1_000_000)
    return F.when(fresh, "hit").when(F.coalesce(validator, F.lit("")) != "", "revalidate").otherwise("miss")


def latest_answers(answers: DataFrame, *, url: str = "url", at: str = "fetched_at") -> DataFrame:
    """The latest good answer for each address; one that failed never replaces a good one."""
    rest = [c for c in answers.columns if c != url]
    good = answers.where(F.col("status").between(200, 299))
    return good.groupBy(url).agg(F.max_by(F.struct(*rest), F.col(at)).alias("a")).select(url, *[F.col(f"a.{c}").alias(c) for c in rest])


def robots_verdicts(urls: DataFrame, files: DataFrame, agent: str, *, url: str = "url", exempt: tuple[str, ...] = ()) -> DataFrame:
    """(url, allowed, reason, crawl_delay) for addresses, by their hosts' files (origin, status, text).

    A host without a file, one that answered 4xx, one that could not be read (5xx or no answer) and
    one of ``exempt`` (origins) allow all. Every file is parsed once a task; a host with a third of
    all addresses is joined by its file, not collected.
    """
    asked = urls.select(F.col(url).alias("u"), origin(url).alias("o"))
    known = files.select(F.lower("origin").alias("o"), "status", F.col("text").alias("t")).dropDuplicates(["o"])
    both = asked.join(known, "o", "left")
    skip = {x.lower() for x in exempt}

    def judge(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parsed: dict[str, RobotFileParser] = {}
        for pdf in it:
            out = []
            for o, u, status, text in zip(pdf["o"], pdf["u"], pdf["status"], pdf["t"]):
                delay, ok = None, True
                if not isinstance(o, str):
                    why = "no address"
                elif o in skip:
                    why = "exempt"
                elif pd.isna(status) or status >= 500:
                    why = "unreadable"
                elif status >= 400:
                    why = "absent"
                else:
                    p = parsed.get(o)
                    if p is None:
                        p = RobotFileParser()
                        p.parse((text if isinstance(text, str) else "").splitlines())
                        p.modified()
                        if len(parsed) < 10_000:
                            parsed[o] = p
                    ok, delay = p.can_fetch(agent, u), p.crawl_delay(agent)
                    why = "file"
                out.append((u, ok, why, float(delay) if delay is not None else None))
            yield pd.DataFrame(out, columns=["url", "allowed", "reason", "crawl_delay"])

    done = both.mapInPandas(judge, "url string, allowed boolean, reason string, crawl_delay double")
    return done.withColumnRenamed("url", url) if url != "url" else done


def retry_delays(times: int = 5, step: float = 1.0) -> list[float]:
    """How long to wait before each further try: a step more every time."""
    return [step * i for i in range(1, times)]


def retried(status: int | None) -> bool:
    """Whether an answer is worth another try: none at all or a fault of the server."""
    return status is None or status >= 500


def next_page(url: str, name: str, step: int) -> str:
    """An address with its paging parameter a step further; added where it is missing."""
    m = re.search(rf"([?&]{re.escape(name)}=)(\d+)", url)
    if m:
        return f"{url[: m.start()]}{m[1]}{int(m[2]) + step}{url[m.end() :]}"
    return f"{url}{'&' if '?' in url else '?'}{name}={step}"
