"""Timestamps written in many ways, normalised to one form.

Every value becomes an array of its valid readings. Along the record order of each source a
Viterbi pass picks one reading per value: changing the written form costs, so does a step back in
time, and a reading against what the source is known to do costs more than any path can save.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, replace
from datetime import date, datetime, timedelta, timezone
from functools import lru_cache
from zoneinfo import ZoneInfo

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postmill.functions.session import spill

# Month names and their usual short forms in en, de, fr, sv, da and es.
MONTHS = {
    1: "january jan januar jänner janvier janv januari enero ene",
    2: "february feb februar février fevrier févr februari febrero",
    3: "march mar märz maerz mars marts marzo mär",
    4: "april apr avril avr abril abr",
    5: "may mai maj mayo",
    6: "june jun juni juin junio",
    7: "july jul juli juillet juil julio",
    8: "august aug août aout augusti agosto ago",
    9: "september sep sept septembre septiembre setiembre",
    10: "october oct oktober okt octobre octubre",
    11: "november nov novembre noviembre",
    12: "december dec dezember dez décembre decembre déc diciembre dic",
}
MONTH = {w: m for m, words in MONTHS.items() for w in words.split()}

# Zone letters in common use, hours from UTC, for boards whose own zone lacks them.
LETTERS = {"utc": 0, "gmt": 0, "z": 0, "wet": 0, "west": 1, "bst": 1, "cet": 1, "cest": 2, "eet": 2, "eest": 3, "msk": 3,
           "eat": 3, "ist": 5.5, "est": -5, "edt": -4, "cst": -6, "cdt": -5, "mst": -7, "mdt": -6, "pst": -8, "pdt": -7}

# Words of age in the six languages.
TODAY = {"today", "just posted", "heute", "aujourd'hui", "idag", "i dag", "hoy"}
YESTERDAY = {"yesterday", "gestern", "hier", "igår", "i går", "ayer"}
UNIT = {
    "h": "h hr hrs hour hours stunde stunden heure heures timme timmar time timer hora horas",
    "m": "min mins minute minutes minuten minuter minutter minuto minutos",
    "d": "d day days tag tagen tage jour jours dag dagar dage día días dia dias",
    "w": "w wk week weeks woche wochen semaine semaines vecka veckor uge uger semana semanas",
}
UNITS = {w: u for u, words in UNIT.items() for w in words.split()}

_LEAD = re.compile(r"^(?:(?:posted|publicerad|veröffentlicht|publié|publicado|publiceret|opslået)\s+)?(?:(?:on|den|am|le|el)\s+)?", re.I)
_AGO = re.compile(r"^(?:vor|il y a|för|for|hace)?\s*(\d+|an?|one)\s*([^\W\d]+)\.?\s*(?:ago|sedan|siden)?$", re.I)
_CLOCK = r"(\d{1,2})[:.h](\d{2})(?:[:.](\d{2})(?:[.,](\d+))?)?\s*([ap]\.?m\.?)?"
_ISO = re.compile(r"^(\d{4})-(\d{1,2})-(\d{1,2})(?:[T\s]\s*(\d{1,2}):(\d{2})(?::(\d{2})(?:[.,](\d+))?)?\s*(.*))?$", re.I)
_WEEK = re.compile(r"^(\d{4})-?W(\d{2})-?([1-7])$", re.I)
_PACKED = re.compile(r"^(\d{4})(\d{2})(\d{2})(?:T?(\d{2})(\d{2})(\d{2})?(?:[.,](\d+))?\s*(.*))?$", re.I)
_FIGURES = re.compile(rf"^(\d{{1,2}})([/.])(\d{{1,2}})\2(\d{{4}}|\d{{2}})(?:,?\s+{_CLOCK}\s*(.*))?$", re.I)
_DAY_WORD = re.compile(
    rf"^(?:[^\W\d]{{2,10}}\.?,?\s+)?(\d{{1,2}})(?:\.|st|nd|rd|th|er)?\s+(?:de\s+)?([^\W\d]+)\.?,?\s+(?:de\s+)?(\d{{4}})(?:,?\s+(?:à|kl\.?|um|at|a las)?\s*{_CLOCK}\s*(?:uhr)?\s*(.*))?$",
    re.I,
)
_WORD_DAY = re.compile(rf"^(?:[^\W\d]{{2,10}}\.?,\s+)?([^\W\d]+)\.?\s+(\d{{1,2}})(?:st|nd|rd|th)?,?\s+(\d{{4}})(?:,?\s+(?:at\s+)?{_CLOCK}\s*(.*))?$", re.I)
_ZONE = re.compile(r"^(?:(?:utc|gmt)?\s*([+-])(\d{1,2})(?::?(\d{2}))?|([a-z]{1,5}))?\s*(?:\[([A-Za-z_+\-0-9/]+)\])?$", re.I)

UNRESOLVED = "unresolved"
EPOCH = datetime(1970, 1, 1, tzinfo=timezone.utc)


@lru_cache(maxsize=1024)
def zone(name: str | None) -> ZoneInfo | None:
    try:
        return ZoneInfo(name) if name else None
    except (KeyError, ValueError, OSError):
        return None


@lru_cache(maxsize=4096)
def letters_at(name: str | None, letters: str, year: int) -> timedelta | None:
    """The offset that ``letters`` stand for at a place in a year: the place's own letters come first."""
    own = zone(name)
    if own:
        for month in range(1, 13):
            at = datetime(year, month, 15, tzinfo=own)
            if (at.tzname() or "").lower() == letters:
                return at.utcoffset()
    return timedelta(hours=LETTERS[letters]) if letters in LETTERS else None


def local(naive: datetime, tz: ZoneInfo) -> list[datetime]:
    """The instants at which clocks in ``tz`` showed ``naive``: none in a gap, two in a fold."""
    found = []
    for fold in (0, 1):
        at = naive.replace(tzinfo=tz, fold=fold).astimezone(timezone.utc)
        if at.astimezone(tz).replace(tzinfo=None) == naive and at not in found:
            found.append(at)
    return found


@dataclass(frozen=True)
class Reading:
    """One way to take a value. ``form`` names the written form, ``us`` orders readings in time, ``cost`` is that of the reading alone."""

    form: str
    norm: str
    us: int
    cost: float = 0.0


def _instant(form: str, at: datetime, ms: int) -> Reading:
    us = (at - EPOCH) // timedelta(microseconds=1) + ms * 1000
    return Reading(form, at.strftime("%Y-%m-%dT%H:%M:%S.") + f"{ms:03d}Z", us)


def _day(form: str, d: date) -> Reading:
    return Reading(form, d.isoformat(), (datetime(d.year, d.month, d.day, tzinfo=timezone.utc) - EPOCH) // timedelta(microseconds=1))


def _built(form: str, y: int, mo: int, d: int, clock: tuple, rest: str | None, board_zone: str | None) -> list[Reading]:
    """Readings of a date and perhaps a time with perhaps a zone."""
    try:
        day = date(y, mo, d)
    except ValueError:
        return []
    if clock[0] is None:
        return [_day(form, day)]
    h, mi, s, part, half = int(clock[0]), int(clock[1]), int(clock[2] or 0), clock[3] or "", (clock[4] or "").lower().replace(".", "")
    if half:
        if not 1 <= h <= 12:
            return []
        h = h % 12 + (12 if half == "pm" else 0)
    if h > 23 or mi > 59 or s > 60:
        return []
    if s == 60:
        # A leap second ends a day in UTC; it is taken as the instant after it.
        at = _built(form, y, mo, d, (clock[0], clock[1], "59", None, clock[4]), rest, board_zone)
        after = [Reading(r.form, _instant("", EPOCH + timedelta(microseconds=r.us + 1_000_000), 0).norm, r.us + 1_000_000) for r in at]
        return [r for r in after if r.us % 86_400_000_000 == 0]
    naive, ms = datetime(y, mo, d, h, mi, s), int((part + "000")[:3])
    m = _ZONE.match((rest or "").strip())
    if not m:
        return []
    sign, hh, mm, letters, region = m.groups()
    try:
        if sign:
            off = timedelta(hours=int(hh), minutes=int(mm or 0)) * (1 if sign == "+" else -1)
            return [_instant(form + "+offset", naive.replace(tzinfo=timezone(off)).astimezone(timezone.utc), ms)]
        if letters:
            off = letters_at(board_zone, letters.lower(), y) if letters.lower() not in ("z", "utc", "gmt") else timedelta(0)
            if off is None:
                return []
            return [_instant(form + "+letters", naive.replace(tzinfo=timezone(off)).astimezone(timezone.utc), ms)]
        tz = zone(region) if region else zone(board_zone)
        return [_instant(form + "+local", at, ms) for at in local(naive, tz)] if tz else []
    except (ValueError, OverflowError):
        return []


CONTRARY = 1e9  # cost of a reading against what the board is known to do: more than a path can save


def readings(value: str | None, fetched_at: str | None, board_zone: str | None, date_order: str | None) -> list[Reading]:
    """The readings of a value that agree with what is known of its board."""
    return [r for r in interpretations(value, fetched_at, board_zone, date_order) if r.cost < CONTRARY]


def interpretations(value: str | None, fetched_at: str | None, board_zone: str | None, date_order: str | None) -> list[Reading]:
    """All valid readings of a value, with their costs; none when no instant or day follows from it."""
    v = " ".join((value or "").split())
    if not v:
        return []
    if re.fullmatch(r"\d{9,13}|\d{15,19}", v):
        # Ten figures reach seconds of this era, thirteen milliseconds, sixteen microseconds, nineteen nanoseconds.
        unit = next(u for most, u in ((10, 1), (13, 1000), (17, 1_000_000), (19, 1_000_000_000)) if len(v) <= most)
        s, part = divmod(int(v), unit)
        return [_instant("epoch", EPOCH + timedelta(seconds=s), part * 1000 // unit)]
    if m := _WEEK.match(v):
        try:
            return [_day("week", date.fromisocalendar(*map(int, m.groups())))]
        except ValueError:
            return []
    v = _LEAD.sub("", v)
    low = v.lower()
    if low in TODAY or low in YESTERDAY or (ago := _AGO.match(low)):
        tz = zone(board_zone)
        try:
            at = datetime.fromisoformat((fetched_at or "").strip().replace("Z", "+00:00"))
        except ValueError:
            return []
        if tz is None or at.tzinfo is None:
            return []
        if low in TODAY or low in YESTERDAY:
            return [_day("age", at.astimezone(tz).date() - timedelta(days=low in YESTERDAY))]
        n, unit = ago[1], UNITS.get(ago[2])
        n = int(n) if n.isdigit() else 1
        if unit is None or n > 100_000:
            return []
        if unit in "hm":
            return [_day("age", (at - timedelta(**{"hours" if unit == "h" else "minutes": n})).astimezone(tz).date())]
        return [_day("age", at.astimezone(tz).date() - timedelta(days=n * (7 if unit == "w" else 1)))]
    if m := _ISO.match(v):
        g = m.groups()
        return _built("iso", int(g[0]), int(g[1]), int(g[2]), (*g[3:7], None), g[7], board_zone)
    if m := _PACKED.match(v):
        g = m.groups()
        return _built("packed", int(g[0]), int(g[1]), int(g[2]), (*g[3:7], None), g[7], board_zone)
    if m := _FIGURES.match(v):
        a, mark, b, y, *g = m.groups()
        y = int(y) + (2000 if len(y) == 2 else 0)
        out = []
        # The board's own order comes first, so that it names a date that reads alike both ways.
        for o in ["DMY"] if mark == "." else sorted(("DMY", "MDY"), key=lambda o: o != date_order):
            d, mo = (int(a), int(b)) if o == "DMY" else (int(b), int(a))
            against = CONTRARY if mark == "/" and date_order in ("DMY", "MDY") and o != date_order else 0.0
            same = {x.norm for x in out}
            out += [replace(r, cost=against) for r in _built(f"figures{mark}{o}", y, mo, d, tuple(g[:5]), g[5], board_zone) if r.norm not in same]
        return out
    if m := _DAY_WORD.match(v):
        d, word, y, *g = m.groups()
        if (mo := MONTH.get(word.lower())) is not None:
            return _built("day month", int(y), mo, int(d), tuple(g[:5]), g[5], board_zone)
    if m := _WORD_DAY.match(v):
        word, d, y, *g = m.groups()
        if (mo := MONTH.get(word.lower())) is not None:
            return _built("month day", int(y), mo, int(d), tuple(g[:5]), g[5], board_zone)
    return []


SWITCH, BACKWARD = 1.0, 0.5


def step_cost(a: Reading, b: Reading) -> float:
    """Cost of ``b`` right after ``a``: a change of form, a step back in time."""
    return SWITCH * (a.form != b.form) + BACKWARD * (b.us < a.us)


def block_matrix(seq: list[list[Reading]]) -> list[list[float]]:
    """Least cost from each reading of the first value to each reading of the last one, without that of the first reading."""
    first = seq[0]
    rows = [[0.0 if i == j else float("inf") for j in range(len(first))] for i in range(len(first))]
    for prev, cur in zip(seq, seq[1:]):
        cost = [[step_cost(a, b) + b.cost for a in prev] for b in cur]
        rows = [[min(r[k] + c[k] for k in range(len(prev))) for c in cost] for r in rows]
    return rows


def viterbi(seq: list[list[Reading]], start: list[float] | None = None, end: int | None = None) -> list[int]:
    """The cheapest choice of one reading per value; ties go to the earlier reading."""
    cost, back = list(start or [r.cost for r in seq[0]]), []
    for prev, cur in zip(seq, seq[1:]):
        best = [min(range(len(prev)), key=lambda k: (cost[k] + step_cost(prev[k], b), k)) for b in cur]
        cost = [cost[k] + step_cost(prev[k], b) + b.cost for k, b in zip(best, cur)]
        back.append(best)
    at = min(range(len(cost)), key=lambda k: (cost[k], k)) if end is None else end
    path = [at]
    for best in reversed(back):
        path.append(at := best[at])
    return path[::-1]


BLOCK = 20_000


PARSED = "row_id bigint, value string, forms array<string>, norms array<string>, us array<bigint>, costs array<double>"


def parse(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Batches of values with what is known of their boards gain the parts of their readings."""
    for pdf in it:
        known = [[x if isinstance(x, str) else None for x in pdf[c]] for c in ("value", "fetched_at", "time_zone", "date_order")]
        all_ = [interpretations(*x) for x in zip(*known)]
        parts = {name: [[getattr(r, a) for r in rs] for rs in all_] for name, a in (("forms", "form"), ("norms", "norm"), ("us", "us"), ("costs", "cost"))}
        yield pdf.drop(columns=["fetched_at", "time_zone", "date_order"]).assign(**parts)


def _readable(pdf: pd.DataFrame) -> tuple[pd.DataFrame, list[list[Reading]]]:
    pdf = pdf.sort_values(["row_id", "value"], kind="stable", na_position="first").reset_index(drop=True)
    return pdf, [[Reading(f, n, int(u), float(c)) for f, n, u, c in zip(*x)] for x in zip(pdf["forms"], pdf["norms"], pdf["us"], pdf["costs"])]


def normalise(df: DataFrame, boards: DataFrame, *, block: int = BLOCK) -> DataFrame:
    """Normalise ``df(tbl, board, row_id, value, fetched_at)``.

    ``boards(board, time_zone, date_order)`` tells what is known of each board. The result has
    (tbl, board, row_id, value, readings array<string>, chosen, norm). ``readings`` are all valid
    readings, ``chosen`` the one on the cheapest path through the board's records in row order, or
    null; ``norm`` is ``chosen`` when it agrees with what is known and is the only reading of its
    form, else ``unresolved``.

    * Null and blank values are left out. A value without a valid reading is ``unresolved``.
    * Both orders of day and month are read. The board's own costs nothing and the other CONTRARY,
      so the path takes that one only where it is the only one, and the norm is ``unresolved``; on a
      board without a known order the path decides.
    * A local time that came twice keeps both readings; since no single instant follows, its norm
      is ``unresolved`` although the path has a choice. One that never came has no reading.
    * A board that is missing or has no zone leaves local times and ages unresolved. A null board is
      a board of its own. Rows with a null row_id come before all others, in no order of their own.
    * Epochs are read in seconds to nanoseconds, a leap second as the instant after it, ISO week
      dates as days; a week alone is none. Repeated rows come out as often as they went in. Further
      columns are ignored.

    Values are read once and written down. The records of a board are cut into blocks of ``block``
    row numbers, rows without one by their place in the written table. The cost matrix of each block
    (first by last reading) is all that is put in sequence, so a board with a third of all rows
    still spreads over the cluster.
    """
    # A board is a row of a configuration; a list of them too long to send is joined by shuffle.
    known = boards.select(F.col("board").alias("__b"), "time_zone", "date_order").dropDuplicates(["__b"])
    rows = df.select("tbl", "board", F.col("row_id").cast("bigint").alias("row_id"), "value", "fetched_at")
    rows = rows.where(F.regexp_replace("value", r"(?U)\s", "") != "")
    rows = rows.join(known, F.col("board") == F.col("__b"), "left").drop("__b")
    # Null row numbers get blocks below all others.
    loose = F.floor(F.monotonically_increasing_id() / F.lit(block)) - F.lit(1 << 50)
    rows = rows.withColumn("block", F.coalesce(F.floor(F.col("row_id") / F.lit(block)), loose))
    fields = "tbl string, board string, block bigint, "
    rows = spill(rows.select("tbl", "board", "block", "row_id", "value", "fetched_at", "time_zone", "date_order").mapInPandas(parse, fields + PARSED))

    def read_block(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, all_ = _readable(pdf)
        seq = [r for r in all_ if r]
        m = block_matrix(seq) if seq else []
        ends = [[(x.form, x.us, x.cost) for x in r] for r in (seq[:1] + seq[-1:])]
        first, last = ends or ([], [])
        return pd.DataFrame([{
            "tbl": pdf["tbl"][0], "board": pdf["board"][0], "block": pdf["block"][0], "matrix": m,
            "first_form": [x[0] for x in first], "first_us": [x[1] for x in first], "first_cost": [x[2] for x in first],
            "last_form": [x[0] for x in last], "last_us": [x[1] for x in last],
        }])

    def link_blocks(pdf: pd.DataFrame) -> pd.DataFrame:
        """Viterbi over the blocks of a board: which reading each block starts and ends with."""
        pdf = pdf.sort_values("block").reset_index(drop=True)
        live = [i for i in range(len(pdf)) if len(pdf["first_form"][i])]
        starts, ends_ = {}, {}
        cost: list[float] = []
        back: list[tuple[list[int], list[int]]] = []
        for n, i in enumerate(live):
            first = [Reading(f, "", u, c) for f, u, c in zip(pdf["first_form"][i], pdf["first_us"][i], pdf["first_cost"][i])]
            if n == 0:
                enter, via = [b.cost for b in first], [0] * len(first)
            else:
                p = live[n - 1]
                last = [Reading(f, "", u) for f, u in zip(pdf["last_form"][p], pdf["last_us"][p])]
                via = [min(range(len(last)), key=lambda k: (cost[k] + step_cost(last[k], b), k)) for b in first]
                enter = [cost[k] + step_cost(last[k], b) + b.cost for k, b in zip(via, first)]
            m = pdf["matrix"][i]
            out = range(len(pdf["last_form"][i]))
            frm = [min(range(len(first)), key=lambda k: (enter[k] + m[k][j], k)) for j in out]
            cost = [enter[k] + m[k][j] for j, k in enumerate(frm)]
            # Many contrary readings must not drown the steps in rounding.
            least = min(cost)
            cost = [c - least for c in cost]
            back.append((via, frm))
        if live:
            at = min(range(len(cost)), key=lambda k: (cost[k], k))
            for n in range(len(live) - 1, -1, -1):
                via, frm = back[n]
                ends_[live[n]] = at
                starts[live[n]] = frm[at]
                at = via[frm[at]]
        return pd.DataFrame({"tbl": pdf["tbl"], "board": pdf["board"], "block": pdf["block"],
                             "start": [starts.get(i, 0) for i in range(len(pdf))], "end": [ends_.get(i, 0) for i in range(len(pdf))]})

    def settle(pdf: pd.DataFrame) -> pd.DataFrame:
        start, end = int(pdf["start"].iloc[0]), int(pdf["end"].iloc[0])
        pdf, all_ = _readable(pdf)
        seq = [r for r in all_ if r]
        picks = iter(viterbi(seq, [0.0 if k == start else float("inf") for k in range(len(seq[0]))], end) if seq else [])
        chosen = [r[next(picks)] if r else None for r in all_]
        # Two instants of one form come from a clock that showed the time twice: nothing decides between them.
        norm = [c.norm if c and c.cost < CONTRARY and sum(x.form == c.form for x in r) == 1 else UNRESOLVED for c, r in zip(chosen, all_)]
        return pd.DataFrame({"tbl": pdf["tbl"], "board": pdf["board"], "row_id": pdf["row_id"], "value": pdf["value"],
                             "readings": [[x.norm for x in r] for r in all_], "chosen": [c.norm if c else None for c in chosen], "norm": norm})

    key = ["tbl", "board", "block"]
    blocks = rows.groupBy(*key).applyInPandas(
        read_block, fields + "matrix array<array<double>>, first_form array<string>, first_us array<bigint>, first_cost array<double>, last_form array<string>, last_us array<bigint>"
    )
    links = blocks.groupBy("tbl", "board").applyInPandas(link_blocks, fields + "start int, end int")
    same = [rows[c].eqNullSafe(links[c]) for c in key]
    joined = rows.join(links, same[0] & same[1] & same[2]).drop(*[links[c] for c in key])
    return joined.groupBy(*key).applyInPandas(
        settle, "tbl string, board string, row_id bigint, value string, readings array<string>, chosen string, norm string"
    )
