"""Free-entered place names mapped to a reference list by symmetric deletes.

The dictionary holds every reference name with up to two characters left out; a phrase meets its
candidates where it, with up to two characters left out, hits an entry. Candidates are ranked by a
weighted Damerau-Levenshtein distance, then by how often the entry is named correctly in the data.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import cached_property, lru_cache
from itertools import combinations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postmill.functions.session import spill

# A reference list up to this many rows is sent to every task (about 4 KB a name with its deletes);
# a longer one is taken in ranges of this size.
BROADCAST_ROWS = 20_000
AREAS = 10_000  # different countries and regions that a reference list may name

# Letters whose usual plain spelling is not just the letter without its mark.
PLAIN = str.maketrans({"ø": "o", "æ": "ae", "œ": "oe", "ß": "ss", "đ": "d", "ł": "l", "þ": "th", "ð": "d", "’": "'"})
SPELT = str.maketrans({"ö": "oe", "ä": "ae", "ü": "ue", "ø": "oe", "å": "aa", "æ": "ae", "œ": "oe", "ß": "ss", "’": "'"})

# Words that stand beside a town and name none, in the feeds' languages.
AROUND = (
    r"^(?:greater|near|close to|office|offices|location|in|remote from|area|region|bei|nahe|près de|nära|nær|cerca de)\b[:\s]+",
    r"^\d{3,6}\s+",
    r"\s*[-–]?\s*\b(?:on[- ]?site|onsite|hybrid|remote|vor ort|sur place|på plats)$",
    r"[\s-]+(?:sub|project|country|regional|field|head|main|branch)[- ]office$",
    r"\s+(?:area|city|hq|headquarters|office|region|metro|stadt|centre|center|campus|district)$",
    r"\s+\d+(?:st|nd|rd|th)\s+floor$",
    r"-(?:nord|süd|sud|ost|west|north|south|east|syd|øst|öst|est|ouest|norte|sur)$",
)
ASIDE = re.compile(r"^(?:central|hybrid|remote|on[- ]?site|city|hq|centre|center|main|office)$", re.I)
NO_TOWN = set(
    """remote hybrid global worldwide anywhere flexible nationwide various multiple locations location home based homebased
    office tbc tbd tba na n/a none unknown europe emea apac amer latam mena africa asia america americas world international
    fully field online virtual telework telecommute wfh from work to be confirmed determined several places many sites site on
    home-based or and the of in all any distributed region regional country national eu uk us""".split()
)


_MANGLED = re.compile("[\u00c2-\u00f4][\u0080-\u00bf\u0152-\u0192\u02c6\u02dc\u2013-\u2122]+")


def _byte(c: str) -> bytes:
    try:
        return c.encode("cp1252")
    except UnicodeEncodeError:
        return c.encode("latin-1")


def repaired(s: str) -> str:
    """Undo UTF-8 that was read as Latin-1 or Windows-1252, run by run; other text is left alone."""

    def back(m: re.Match) -> str:
        try:
            return b"".join(map(_byte, m[0])).decode("utf-8")
        except (UnicodeDecodeError, UnicodeEncodeError):
            return m[0]

    return _MANGLED.sub(back, s)


def fold(s: str, spelt: bool = False) -> str:
    """Lower case without marks; ``spelt`` writes umlauts and the like with two letters."""
    s = unicodedata.normalize("NFC", s).casefold()
    s = s.translate(SPELT if spelt else PLAIN)
    s = "".join(c for c in unicodedata.normalize("NFD", s) if not unicodedata.combining(c))
    return " ".join(s.replace(".", " ").split())


def deletes(s: str, most: int) -> set[str]:
    """``s`` with none to ``most`` of its characters left out."""
    out = {s}
    for n in range(1, min(most, len(s) - 1) + 1):
        out.update("".join(c for i, c in enumerate(s) if i not in left) for left in map(set, combinations(range(len(s)), n)))
    return out


def reach(s: str) -> int:
    """The distance within which a phrase may be taken for a name of this length."""
    return 0 if len(s) < 5 else 1 if len(s) < 6 else 2


_VOWELS = set("aeiouy")


def distance(a: str, b: str, limit: float = 2.0) -> float:
    """Weighted Damerau-Levenshtein (adjacent swaps).

    A swap, a doubled letter or one vowel for another weighs 0.8, any other edit 1.0; above
    ``limit`` (in plain edits) the result is infinite.
    """
    if abs(len(a) - len(b)) > limit:
        return float("inf")
    rows = [[(j, j * 1.0) for j in range(len(b) + 1)]]
    for i, x in enumerate(a, 1):
        row = [(i, i * 1.0)]
        for j, y in enumerate(b, 1):
            p = rows[-1][j - 1]
            if x == y:
                best = p
            else:
                w = 0.8 if x in _VOWELS and y in _VOWELS else 1.0
                best = (p[0] + 1, p[1] + w)
            p = rows[-1][j]
            best = min(best, (p[0] + 1, p[1] + (0.8 if i > 1 and a[i - 2] == x else 1.0)))
            p = row[-1]
            best = min(best, (p[0] + 1, p[1] + (0.8 if j > 1 and b[j - 2] == y else 1.0)))
            if i > 1 and j > 1 and x == b[j - 2] and y == a[i - 2]:
                p = rows[-2][j - 2]
                best = min(best, (p[0] + 1, p[1] + 0.8))
            row.append(best)
        rows.append(row)
    plain, weighed = rows[-1][-1]
    return weighed if plain <= limit else float("inf")


@dataclass(frozen=True)
class Entry:
    place_id: int
    country: str
    code: str
    region: str


class Lookup:
    """The reference list with its delete dictionary; small enough to be sent to every task."""

    def __init__(self, rows: list[tuple], counts: dict[int, int] | None = None, areas: list[tuple] = ()):
        """rows: (place_id, name, country, country_code, region, aliases); areas: further (country, country_code, region)."""
        self.counts = counts or {}
        self.entries: dict[int, Entry] = {}
        self.names: dict[str, set[int]] = {}
        self.codes: dict[str, set[int]] = {}
        self.areas: dict[str, tuple[str, str]] = {}
        for pid, name, country, code, region, aliases in rows:
            if pid is None:
                continue
            self.entries[pid] = Entry(pid, fold(country or ""), (code or "").lower(), fold(region or ""))
            self.area(country, code, region)
            for n in [name, *(aliases if aliases is not None else [])]:
                if not n or not n.strip():
                    continue
                code = len(n) <= 4 and n.isupper()
                if code:
                    self.codes.setdefault(n, set()).add(pid)
                # A short alias in capitals is a code; a town's own name is also written in small letters.
                if not code or n == name:
                    for v in {fold(n), fold(n, spelt=True)}:
                        self.names.setdefault(v, set()).add(pid)
        for a in areas:
            self.area(*a)
        self.longest = max(map(len, self.names), default=0)

    @cached_property
    def by_delete(self) -> dict[str, set[str]]:
        out: dict[str, set[str]] = {}
        for v in self.names:
            for d in deletes(v, reach(v)):
                out.setdefault(d, set()).add(v)
        return out

    def area(self, country: str | None, code: str | None, region: str | None) -> None:
        for what, kind in ((country, "country"), (region, "region")):
            if what:
                self.areas[fold(what)] = (kind, fold(what))
        if code:
            self.areas[code.lower()] = ("code", code.lower())

    def fuzzy(self, phrase: str) -> list[tuple[float, set[int]]]:
        """Entries within reach, as (weighted distance, place ids), for each spelling of the phrase."""
        found: dict[str, float] = {}
        for q in {fold(phrase), fold(phrase, spelt=True)}:
            # A phrase that is longer than every name by more than the distance is within reach of none.
            names = {n for d in deletes(q, 2) for n in self.by_delete.get(d, ())} if len(q) <= self.longest + 2 else set()
            for n in names:
                w = distance(q, n, min(reach(n), 2))
                if w < found.get(n, float("inf")):
                    found[n] = w
        return [(w, self.names[n]) for n, w in found.items()]

    def choose(self, options: list[tuple[float, set[int]]], hints: set[tuple[str, str]]) -> tuple[int, float, tuple]:
        """The best entry, its distance and its rank: nearest first, half an edit nearer in the country or region that the value names, then most often named."""

        def fits(e: Entry) -> bool:
            return any(getattr(e, k) == v for k, v in hints)

        def rank(w: float, p: int) -> tuple:
            away = bool(hints) and not fits(self.entries[p])
            return w + 0.5 * away, -self.counts.get(p, 0), p, w

        best = min(rank(w, p) for w, ids in options for p in ids)
        return best[2], best[3], best[:2]


_SPLIT = re.compile(r"\s*(?:[;|&\n\r/•·]|\s+(?:or|and|oder|und|ou|et|och|eller|og|y|o)\s+)\s*", re.I)


def phrases(value: str, lookup: Lookup) -> list[tuple[str, set[tuple[str, str]]]]:
    """The phrases of a value that may name a town, each with the countries and regions beside it."""
    out = []
    value = value.replace("N/A", "").replace("n/a", "")
    for part in _SPLIT.split(repaired(value)):
        hints: set[tuple[str, str]] = set()
        words: list[str] = []
        asides = re.findall(r"\(([^()]*)\)", part)
        part = re.sub(r"\([^()]*\)", " ", part)
        pieces = [x for x in re.split(r"\s*,\s*|\s+[-–—]\s+", part) if x.strip()]
        for piece in [*pieces, *asides]:
            piece = " ".join(piece.strip(" .:-–\t").split())
            if m := re.match(r"^([A-Z]{2})-\s*(?=\S)", piece):
                if m[1].lower() in lookup.areas:
                    hints.add(lookup.areas[m[1].lower()])
                    piece = piece[m.end() :]
            before = None
            while piece and piece != before:
                before = piece
                for rx in AROUND:
                    piece = re.sub(rx, "", piece, flags=re.I).strip(" .:-–")
            if not piece or ASIDE.match(piece):
                continue
            low = fold(piece)
            if low in lookup.areas and (len(piece) > 2 or piece.isupper()):
                hints.add(lookup.areas[low])
            elif not re.search(r"[^\W\d_]{2}", piece) or all(w in NO_TOWN or w.isdigit() for w in re.findall(r"[^\W_][\w/-]*", low)):
                continue
            else:
                words.append(piece)
        out += [(w, hints) for w in words]
    return out


CODE, NAME, NEAR, MISS = range(4)


def towns(value: str | None, lookup: Lookup) -> list[tuple[str, int, float, int, float, int]]:
    """(phrase, place_id, distance, tier, rank, named) for every town a value names; place_id 0 for one not on the list.

    Nothing for null, blank or town-free values. A phrase that is a two-letter country code, a
    country or a region is a hint to its neighbours, and with no town beside it no case.
    """
    if not value or not value.strip():
        return []
    found = []
    parts = phrases(value, lookup)
    everywhere = set().union(*(h for _, h in parts)) if parts else set()
    for phrase, hints in parts:
        q = fold(phrase)
        if phrase in lookup.codes:
            tier, options = CODE, [(0.0, lookup.codes[phrase])]
        elif q in lookup.names:
            tier, options = NAME, [(0.0, lookup.names[q])]
        else:
            tier, options = NEAR, lookup.fuzzy(phrase)
        if options:
            pid, w, (rank, named) = lookup.choose(options, hints or everywhere)
            found.append((phrase, pid, w, tier, rank, named))
        else:
            found.append((phrase, 0, 0.0, MISS, 0.0, 0))
    return found


RESULT = "value string, n int, phrase string, place_id bigint, distance double, tier int, rank double, named bigint"


def _reference(places: DataFrame) -> list[tuple]:
    cols = ["place_id", "name", "country", "country_code", "region", "aliases"]
    return [tuple(r) for r in places.select(*cols).collect()]


def map_places(
    values: DataFrame, places: DataFrame, *, column: str = "value", keys: Sequence[str] = (), broadcast_rows: int = BROADCAST_ROWS
) -> DataFrame:
    """Towns named by the values of ``column``: (keys..., value, phrase, place_id, distance).

    Without ``keys`` each distinct value is answered once; with them every row is answered where it
    lies, with no shuffle. place_id 0 reports a miss: a phrase that reads as a town and is within
    reach of no entry. Null, blank and town-free values give no rows; a value of any length is read
    whole. An empty reference list makes every town a miss. Columns not named are ignored.

    A value that a third of all rows share is worked out once per task. The list is sent to the
    tasks only while it has at most ``broadcast_rows`` rows. A longer one is split into ranges of
    that size, which pass through the driver one by one; each task holds one range at a time and the
    best entry over all ranges is taken, so the work grows with the list but no task holds more than
    a range. Both ways give the same rows: rows and the phrases of a value are numbered.
    """
    rows = values.select(*keys, F.col(column).alias("value")).where(F.col("value").isNotNull())
    rows = rows if keys else rows.distinct()
    n = places.count()
    out = [*keys, "value", "phrase", "place_id", "distance"]
    if n <= broadcast_rows:
        return _matched(rows, _reference(places), keys).select(*out)
    areas = [tuple(r) for r in places.select("country", "country_code", "region").distinct().limit(AREAS + 1).collect()]
    if len(areas) > AREAS:
        raise ValueError(f"the reference list names more than {AREAS} countries and regions")
    parts = -(-n // broadcast_rows)
    split = places.withColumn("__part", F.pmod(F.xxhash64("place_id"), F.lit(parts)))
    # The written table keeps its numbers, so that all ranges answer the same rows.
    rows = spill(rows.withColumn("__row", F.monotonically_increasing_id()))
    found = None
    for k in range(parts):
        one = _matched(rows, _reference(split.where(F.col("__part") == k)), ["__row"], areas)
        found = one if found is None else found.unionByName(one)
    best = F.struct("tier", "rank", "named", "place_id", "distance")
    merged = found.groupBy("__row", "n").agg(F.min(best).alias("b"), F.first("phrase").alias("phrase"))
    merged = merged.select("__row", "phrase", F.col("b.place_id").alias("place_id"), F.col("b.distance").alias("distance"))
    return merged.join(rows, "__row").select(*out)


def _matched(rows: DataFrame, reference: list[tuple], keys: Sequence[str], areas: list[tuple] = ()) -> DataFrame:
    sc = rows.sparkSession.sparkContext
    plain = sc.broadcast(reference)

    def count(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        look, named = Lookup(plain.value, None, areas), Counter()
        for pdf in it:
            for v, times in Counter(pdf["value"]).items():
                for phrase, _ in phrases(v, look):
                    ids = look.names.get(fold(phrase), ())
                    if len(ids) == 1:
                        named.update({p: times for p in ids})
        yield pd.DataFrame({"place_id": list(named), "n": list(named.values())}, columns=["place_id", "n"])

    # One count per entry of the list, so no longer than the list.
    counts = rows.select("value").mapInPandas(count, "place_id bigint, n bigint").groupBy("place_id").agg(F.sum("n").alias("n"))
    weights = sc.broadcast({r[0]: r[1] for r in counts.collect()})
    names = [*keys, "value", "n", "phrase", "place_id", "distance", "tier", "rank", "named"]
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}

    def match(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        look = Lookup(plain.value, weights.value, areas)
        memo = lru_cache(maxsize=100_000)(lambda v: towns(v, look))
        for pdf in it:
            cols = [pdf[k] for k in keys]
            yield pd.DataFrame([(*r, i, *t) for r in zip(*cols, pdf["value"]) for i, t in enumerate(memo(r[-1]))], columns=names)

    return rows.mapInPandas(match, ", ".join([*(f"`{k}` {kinds[k]}" for k in keys), RESULT]))
