"""Keys of postings and identity of boards, as columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from postmill.functions.text import fold_case, strip, strip_or_empty
from postmill.operators.snapshot_diff import canonical_key


def dedupe_key(detail_url: Column | str, apply_url: Column | str) -> Column:
    """The canonical detail link, or else the canonical apply link; empty when there is neither."""
    first, second = (F.coalesce(canonical_key(c), F.lit("")) for c in (detail_url, apply_url))
    return F.when(first != "", first).otherwise(second)


def host(url: Column | str) -> Column:
    """The host of a link in lower case, without www.; null when it is no link."""
    h = F.lower(F.try_parse_url(strip(url), F.lit("HOST")))
    return F.regexp_replace(h, r"^www\.", "")


# Hosts where many boards lie under one address, told apart by the first part of the path.
SHARED_HOSTS = (
    "boards.greenhouse.io", "job-boards.greenhouse.io", "boards.eu.greenhouse.io", "job-boards.eu.greenhouse.io", "jobs.ashbyhq.com", "apply.workable.com", "jobs.workable.com",
    "careers.smartrecruiters.com", "jobs.smartrecruiters.com", "jobs.lever.co", "jobs.eu.lever.co", "jobs.jobvite.com", "jobs.recruitee.com",
)
SHARED_SUFFIX = ".myworkdayjobs.com"
_LOCALE = r"(?i)^[a-z]{2}([-_][a-z]{2,3})?$"


def origin(url: Column | str) -> Column:
    """Scheme and host of a link in lower case, https where none is given; null when there is no host."""
    c = F.lower(strip(url))
    full = F.when(c.rlike(r"^[a-z][a-z0-9+.-]*://"), c).otherwise(F.concat(F.lit("https://"), c))
    h, scheme = F.try_parse_url(full, F.lit("HOST")), F.try_parse_url(full, F.lit("PROTOCOL"))
    return F.when(h.isNotNull() & (h != ""), F.concat(scheme, F.lit("://"), h))


def board_identity(url: Column | str, shared_hosts: Sequence[str] = SHARED_HOSTS, shared_suffix: str = SHARED_SUFFIX) -> Column:
    """What makes two links the same board: the host, on shared hosts with the first part of the path.

    Leading parts that are locales (xx, xx-XX, in either case) are skipped while another part
    follows. A host without a scheme is a link too; what has no host with a dot gives null.
    """
    c = strip(url)
    full = F.when(c.contains("://"), c).otherwise(F.concat(F.lit("https://"), F.ltrim(c, F.lit("/"))))
    h = host(full)
    path = F.filter(F.split(F.coalesce(F.try_parse_url(full, F.lit("PATH")), F.lit("")), "/"), lambda x: x != "")
    first = F.coalesce(F.get(F.filter(path, lambda x: ~x.rlike(_LOCALE)), F.lit(0)), F.get(path, F.size(path) - 1))
    board = F.when((h.isin(list(shared_hosts)) | h.endswith(shared_suffix)) & first.isNotNull(), F.concat(h, F.lit("/"), fold_case(first))).otherwise(h)
    return F.when(h.contains("."), board)


def same_board(a: Column | str, b: Column | str) -> Column:
    """Whether two links lead to one board; false where either is no link."""
    return F.coalesce(board_identity(a) == board_identity(b), F.lit(False))


def untitled(title: Column | str) -> Column:
    return strip_or_empty(title) == ""
