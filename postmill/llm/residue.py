"""Template residue, filler and error pages.

Records made from one template are aligned by the words on both sides of a position: positions that
hold many different words are slots. A variable name, a default value or a blank that sits in a slot
was never filled; the same text in a sentence that is always written that way is real content.
Sentences that recur across records and mostly make up whole pages are error templates.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import defaultdict
from collections.abc import Callable, Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postmill.functions.session import cut

# The written forms of variables, defaults and blanks.
STRONG = re.compile(
    r"\{\{[^{}\n]{1,80}\}\}|\{%[^%\n]{1,80}%\}|<%[^%\n]{1,80}%>|[$#]\{[^{}\n]{1,80}\}|\$[A-Za-z_]{2,40}\$|\{[A-Za-z_][\w.]{0,40}\}|\{\d{0,2}\}"
    r"|<<[^<>\n]{1,60}>>|<[A-Za-z][\w .-]{1,40}>|\[\[[^\[\]\n]{1,60}\]\]|%\([A-Za-z_]\w*\)[sdf]|%[A-Z][A-Z_]{1,30}%|@@[^@\n]{1,40}@@|##[^#\s]{1,40}##"
    r"|__[A-Z][A-Z_]*__|_{3,}|\.{5,}|…{3,}|#(?:REF|NAME|VALUE|N/A|NULL|NUM|DIV/0)[!?]?|\[object Object\]|\[[●•■□x_. ]{1,12}\]|[●■□]{1,8}|\?{3,}"
    r"|\[(?:INSERT|ENTER|ADD|YOUR|TO BE|TBD|TBC|NAME|DATE|CITY|COMPANY|TITLE)\b[^\[\]\n]{0,60}\]|\[(?:to be|insert|enter|your|company|job|role|city|team|name|date|start|unit|salary|location)\b[^\[\]\n]{0,60}\]"
    r"|\((?:insert|enter|your|fill in|add|to be (?:confirmed|completed|filled|defined))\b[^()\n]{0,60}\)"
)
WEAK = re.compile(r"(?<![\w-])(?:null|NULL|undefined|None|NaN|N/A|n/a|TBD(?:-TBD)?|TBC(?:-TBC)?|TODO|FIXME|X{3,}|x{3,}|\[[A-Z][\w ]{1,40}\])(?![\w-])")

# Of the forms in brackets, those that no menu or job title has: they count wherever they stand.
PLAIN_FORM = re.compile(r"<<|<%|\[\[|\[object Object\]|[\[(](?:insert|enter|add|your|fill in|to be|tbd|tbc)\b", re.I)

# The opening words of filler and sample sentences.
FILLER = re.compile(
    r"^(?:sample|dummy|example|placeholder|filler|test) (?:text|content|copy)\b|^job description goes here|^insert (?:the )?text\b|^to be completed by|^(?:text|content) goes here"
    r"|^(?:blindtext|mustertext|beispieltext|platzhaltertext|fülltext)\b|^(?:text|inhalt|beschreibung|stellenbeschreibung) folgt\b|^hier (?:steht|kommt|folgt) (?:später |noch )?(?:die|der) (?:stellen|text)|^wird (?:noch )?(?:von|vom|durch) .{3,40}(?:ergänzt|ausgefüllt)"
    r"|^exempeltext\b|^provtext\b|^här kommer annons|^fylls i av|^eksempeltekst|^her kommer (?:job|stillings)?opslag|^udfyldes af|^testtekst\b|^(?:tekst|text|beskrivelse|beskrivning) (?:følger|kommer)\b"
    r"|^(?:texte|contenu) (?:d'exemple|factice|provisoire|de remplissage|à remplacer|à compléter|à venir)|^ici viendra|^à compléter par|^(?:texto|contenido) de (?:ejemplo|muestra|relleno|prueba)|^aquí irá|^pendiente de completar"
    r"|^(?:asdf|qwer|bla|test|text|xxx|blah|foo|lorem)(?: (?:asdf|qwer|bla|test|text|xxx|blah|foo|bar|ipsum|\d+))*$",
)
# Words of error, access and script messages.
ERROR = re.compile(
    r"(?:could not be|was not|not) found|404|(?:^|\W)(?:http|error|fel|fehler|erreur|fejl) \d|finns inte|findes ikke|introuvable|nicht gefunden|no encontramos|does not exist|access denied|forbidden|denied|nekad|nægtet|refusé|denegado|verweigert"
    r"|session (?:has )?expired|gått ut|udløbet|expiré|caducado|abgelaufen|temporarily unavailable|tillfälligt nere|nede i øjeblikket|indisponible|no disponible|nicht erreichbar|went wrong"
    r"|(?:enable|activer?|activa|aktivieren sie|slå på|slå) (?:javascript|scripts)|needs? javascript|(?:skript|script)s?\b.{0,30}(?:run|fonctionner|funcionar|tillåtna|tilladt|eingeschaltet)|eingeschalteten skripten|robot|roboter|you are human|checking your browser|captcha|loading vacancy"
)
# The sample paragraph in common use; first its words that none of the feeds' languages has in use, then its others.
SEEDS = set(
    """lorem ipsum dolor amet consectetur consectetuer adipiscing elit eiusmod tempor incididunt labore dolore magna aliqua enim minim veniam quis
    nostrud exercitation ullamco laboris nisi aliquip commodo consequat duis aute irure reprehenderit voluptate velit esse cillum fugiat nulla
    pariatur excepteur sint occaecat cupidatat proident sunt culpa officia deserunt mollit anim laborum""".split()
)
SEED_TOKENS = SEEDS | {w + end for w in SEEDS for end in ",."}
SAMPLE = SEEDS | set("sit sed do ut et ad ex ea in non qui est id".split())

MIN_FILLERS = 8  # different words that make a position a slot
SHORT = 5  # sentences up to which a record counts as a whole-page message
WHOLE_PAGE = 0.6  # share of a sentence's records that are short, from which it is an error template
OTHERS = 2  # records with an unmistakable form for each different filler at its position, up to which it is residue
MIN_PAGES = 3  # records that a sentence must recur in
SAMPLE_WORDS = 0.7  # share of a sentence's words that are sample words, from which it is sample text
BESIDE_SEEDS = 0.5  # share of a word's lines that hold a seed, from which it is a sample word
MIN_LINES = 3  # lines that a word must come in to be learnt as a sample word
POSITIONS, MOST = 1 << 22, 1 << 26  # places of the filter that says which positions are looked at: 16 for each, within 4 M and 64 M

# What lies between stops and line ends, caught if it may be a sentence: a letter or figure, at least 20 signs, a stop and a space.
_SEGMENT = re.compile(r"([^.!?\n]{21,}+)[.!?](?=\s|$)|[^.!?\n]*+(?:[.!?\n]|$)")
_LETTER = re.compile(r"\w")
_CUT = re.compile(r"(?<=[.!?])\s+|\n")
_WORD = re.compile(r"[^\W\d_]+")
_BULLET = re.compile(r"^(?:[-–—*•+→»›]|\d{1,2}[.)]|[a-z]\))\s+")
_END = ".,;:!?"


# One of these stands in every text that the patterns above can match.
HINTS = ("{", "<", "[", "@@", "##", "__", "$", "#", "●", "■", "□", ".....", "………", "???", "%(", "(insert", "(enter", "(your", "(fill", "(add", "(to be",
         "null", "NULL", "undefined", "None", "NaN", "N/A", "n/a", "TBD", "TBC", "TODO", "FIXME", "XXX", "xxx")
ERROR_HINTS = ("not found", "be found", "404", "http ", "error ", "fel ", "fehler ", "erreur ", "fejl ", "gefunden", "finns inte", "findes ikke", "introuvable",
               "no encontramos", "not exist", "denied", "forbidden", "nekad", "nægtet", "refusé", "denegado", "verweigert", "expired", "gått ut", "udløbet", "expiré",
               "caducado", "abgelaufen", "unavailable", "tillfälligt", "øjeblikket", "indisponible", "no disponible", "erreichbar", "went wrong", "javascript",
               "robot", "you are human", "your browser", "captcha", "loading vacancy")
FILLER_HINTS = ("sample ", "dummy ", "example ", "placeholder ", "filler ", "test", "description goes", "insert ", "to be completed", " goes here", "text", "inhalt folgt",
                "beschreibung folgt", "hier steht", "hier kommt", "hier folgt", "wird ", "här kommer", "fylls i", "tekst", "opslag", "udfyldes", "beskrivelse", "beskrivning",
                "contenu ", "ici viendra", "à compléter", "contenido ", "aquí irá", "pendiente", "asdf", "qwer", "bla", "xxx", "foo", "lorem")
_PERCENT = re.compile(r"%[A-Z]")
_SCRIPT = re.compile(r"s[ck]ripts?\b")
_FIGURES = re.compile(r"\d+(?:[.,:]\d+)*")
_ANY_FIGURE = re.compile(r"\d")


def h64(s: str) -> int:
    return xxhash.xxh64_intdigest(s) - (1 << 63)


def squashed(s: str) -> str:
    """A sentence as a template: lower case, one space, no bullet, no figures."""
    s = " ".join(s.split()).casefold()
    if s and not s[0].isalpha():
        s = _BULLET.sub("", s)
    return _FIGURES.sub("9", s) if _ANY_FIGURE.search(s) else s


def _automaton(words: tuple[str, ...]) -> ahocorasick.Automaton:
    auto = ahocorasick.Automaton()
    for h in words:
        auto.add_word(h, h)
    auto.make_automaton()
    return auto


@lru_cache(maxsize=1)
def hints() -> ahocorasick.Automaton:
    """Finds in one pass what a line must hold for ERROR or FILLER to match."""
    return _automaton(ERROR_HINTS + FILLER_HINTS)


@lru_cache(maxsize=1)
def form_hints() -> ahocorasick.Automaton:
    """Finds in one pass what a text must hold for STRONG or WEAK to match."""
    return _automaton(HINTS)


TELLS, FORMS, SCRIPTS, SEEDED = 1, 2, 4, 8


@lru_cache(maxsize=1)
def all_hints() -> ahocorasick.Automaton:
    """Finds in one pass of a line in lower case what it may hold; the patterns and words themselves decide."""
    marks: dict[str, int] = defaultdict(int)
    for words, mark in ((ERROR_HINTS + FILLER_HINTS, TELLS), ((*HINTS, "%"), FORMS), (("script", "skript"), SCRIPTS), (SEEDS, SEEDED)):
        for h in words:
            marks[h.casefold()] |= mark
    auto = ahocorasick.Automaton()
    for h, mark in marks.items():
        auto.add_word(h, mark)
    auto.make_automaton()
    return auto


def templates(text: str) -> list[str]:
    """The distinct sentences of a text as templates; menus (lines of separated items) left out."""
    out = {}
    for s in _CUT.split(text):
        if s and not ("|" in s or "·" in s or "›" in s or "»" in s or "\t" in s or "   " in s):
            t = squashed(s)
            if t:
                out[t] = None
    return list(out)


def is_short(text: str) -> bool:
    n = 0
    for m in _SEGMENT.finditer(text):
        s = m[1]
        if s and (s[0].isalnum() or (w := _LETTER.search(s)) and len(s) - w.end() >= 20):
            n += 1
            if n > SHORT:
                return False
    return True


_Sample = tuple[str, int, int, list[str]]


def sample(sentence: str) -> _Sample | None:
    """(sentence, words, words of SAMPLE, the other words) of a sentence of at least five words; else None."""
    words = _WORD.findall(sentence)
    if len(words) < 5:
        return None
    others = [w for w in words if w not in SAMPLE]
    return sentence, len(words), len(words) - len(others), others


def telling(line: str, hinted: bool = True) -> tuple[list[tuple[str, bool, bool]], list[_Sample]]:
    """(template, filler, wrong) for every sentence of a line that is filler or speaks of an error, and its sentences beside a seed.

    With ``hinted`` a line without any of the hints is not read further; the result is the same.
    """
    tokens = line.casefold().split()
    low, seeded = " ".join(tokens), not SEED_TOKENS.isdisjoint(tokens)
    if hinted and not seeded and next(hints().iter(low), None) is None and not _SCRIPT.search(low):
        return [], []
    return _told(line, seeded)


def _told(line: str, seeded: bool) -> tuple[list[tuple[str, bool, bool]], list[_Sample]]:
    said = templates(line)
    out = []
    for s in said:
        filler, wrong = FILLER.match(s) is not None, ERROR.search(s) is not None
        if filler or wrong:
            out.append((s, filler, wrong))
    return out, [x for x in map(sample, said) if x] if seeded else []


def line_finds(line: str) -> tuple[list[tuple[str, str, bool]], list[tuple[str, bool, bool]], list[_Sample]]:
    """residues() and telling() of a line, in one pass over its signs."""
    low, marks = line.casefold(), 0
    if "  " in low or not low.isprintable():
        low = " ".join(low.split())
    for _, mark in all_hints().iter(low):
        marks |= mark
    if not marks:
        return [], [], []
    forms = residues(line) if marks & FORMS else []
    seeded = marks & SEEDED and not SEED_TOKENS.isdisjoint(low.split())
    if seeded or marks & TELLS or marks & SCRIPTS and _SCRIPT.search(low):
        return forms, *_told(line, bool(seeded))
    return forms, [], []


def _before(line: str, at: int) -> str:
    left = line[:at].rstrip()
    if not left or left[-1] in ".!?" or _BULLET.fullmatch(left + " "):
        return "^"
    w = left.split()[-1].casefold()
    return w if w.isalnum() else w.strip("(\"'«»")


def _after(line: str, at: int) -> str:
    right = line[at:]
    if not right.strip():
        return "$"
    if right[0] in _END:
        return right[0]
    w = right.split()[0].casefold()
    return w.rstrip(_END) if len(w) > 1 else w


def residues(text: str) -> list[tuple[str, str, bool]]:
    """(position, what stands there, unmistakable form) for all that may be residue."""
    out: list[tuple[str, str, bool]] = []
    if next(form_hints().iter(text), None) is None and not ("%" in text and _PERCENT.search(text)):
        return out
    for line in text.split("\n"):
        line = line.replace("\xa0", " ").rstrip("\r")
        spans = [(m.start(), m.end(), True) for m in STRONG.finditer(line)]
        spans += [(m.start(), m.end(), False) for m in WEAK.finditer(line) if not any(a <= m.start() < b for a, b, _ in spans)]
        for a, b, strong in spans:
            what = line[a:b]
            if what[0] in "[<(" and not re.search(r"[.!?]\s*$", line) and not line[:a].rstrip().endswith(":") and not PLAIN_FORM.match(what):
                # Bracketed words in menus and job titles are no blanks; they are in sentences, which end in a stop, and after a label.
                continue
            out.append((f"{_before(line, a)}\0{_after(line, b)}", what, strong))
    return out


_FULL = (1 << 64) - 1
_A, _B, _C = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9


def _word_hash(w: str) -> int:
    return xxhash.xxh64_intdigest(w)


def position_key(pos: str) -> int:
    """The key of a position, from its words before and after; never 0, which stands for nothing."""
    before, after = pos.split("\0")
    h = (_word_hash(before) * _A + _word_hash(after) * _B) & ((1 << 64) - 1)
    return h - (1 << 63) or 1


def span_bit(words: list[str]) -> int:
    """The bit by which Slots.count() knows what stands at a position, as one word or a span of up to three; 0 for longer ones."""
    if len(words) == 1:
        w = words[0]
        return 1 << (hash_word(w[:-1] if w[-1] in _END and len(w) > 1 else w) & 63)
    if len(words) > 3:
        return 0
    inner = [_word_hash(_FIGURES.sub("9", w)) for w in words[:-1]]
    last = words[-1].rstrip(_END) or words[-1]
    h = inner[0] * _A + _word_hash(last) * _B + (inner[1] * (_A ^ _B) if len(inner) > 1 else 0)
    return 1 << ((h & ((1 << 64) - 1)) >> 58)


class _Numbers(dict):
    """Numbers words as they come."""

    def __init__(self, add: Callable[[str], int]) -> None:
        self.add = add
        self["\x01"] = 0

    def __missing__(self, w: str) -> int:
        n = self[w] = self.add(w)
        return n


@lru_cache(maxsize=500_000)
def word_row(w: str) -> tuple[tuple[int, int, int, int, int], int]:
    """What Slots keeps of a word; and 1 if it ends a sentence, 2 more if it is a bullet, 4 more if it is a seed."""
    end = w[-1]
    stopped = end in _END and len(w) > 1
    bullet = bool(_BULLET.fullmatch(w + " "))
    before = "^" if end in ".!?" or bullet else w if w.isalnum() else w.strip("(\"'«»")
    bare = w.rstrip(_END) if len(w) > 1 else w
    row = (
        _word_hash(before) * _A & _FULL, _word_hash(bare or w) * _B & _FULL, _word_hash(end) * _B & _FULL if stopped else 0,
        1 << (hash_word(w[:-1] if stopped else w) & 63), _word_hash(_FIGURES.sub("9", w)),
    )
    return row, (end in ".!?") + 2 * bullet + 4 * (w in SEED_TOKENS)


class Slots:
    """What stands at the marked positions of many lines, word by word, aligned like residues().

    Words are numbered as they come; everything else is done on arrays of numbers. A word has the
    form it takes before a position, the form it takes after one, the stop at its end (all three
    as their part of a key), a bit, and its hash.
    """

    LIMIT = 300_000

    def __init__(self, marked: np.ndarray) -> None:
        self.marked = marked
        # The number of places is a power of two, so the rest of a division is the low bits.
        self.low = np.int64(len(marked) - 1)
        self.start()

    def start(self) -> None:
        # 0 is the end of a line.
        self.number = _Numbers(self.add)
        self.text = [""]
        self.rows: list[tuple[int, ...]] = [(_word_hash("^") * _A & _FULL, _word_hash("$") * _B & _FULL, 0, 0, 0)]
        self.kinds = bytearray(1)
        self.table, self.flags, self.known = np.zeros((5, 0), dtype=np.uint64), np.zeros(0, dtype=np.uint8), np.zeros(0, dtype=bool)

    def add(self, w: str) -> int:
        row, kind = word_row(w)
        self.rows.append(row)
        self.kinds.append(kind)
        self.text.append(w)
        return len(self.rows) - 1

    def on(self, key: np.ndarray) -> np.ndarray:
        return self.marked[key & self.low]

    def count(
        self, lines: list[str], words: dict[int, int], spans: dict[int, int] | None = None, uses: dict[int, list[int]] | None = None,
        sentences: Callable[[int, str], None] = lambda n, s: None,
    ) -> None:
        """Or the bits of the words at marked positions into ``words``, those of two or three words into ``spans``; add the lines of
        marked words, and those with a seed, to ``uses``; pass on the number of the line and the template of every sentence whose head is marked."""
        if len(self.rows) > self.LIMIT:
            self.start()
        numbers = self.number.__getitem__
        ids, ends = [0], []
        for t in lines:
            ids += map(numbers, (t.replace("\n", " \x01 ") if "\n" in t else t).casefold().split())
            ids.append(0)
            ends.append(len(ids))
        # Two ends more, so that what comes after a word or span is always there.
        at = np.array([*ids, 0, 0], dtype=np.int64)
        if len(self.rows) > self.table.shape[1]:
            fresh = np.array(self.rows[self.table.shape[1] :], dtype=np.uint64).T
            self.table = np.concatenate((self.table, fresh), axis=1)
            self.flags = np.frombuffer(bytes(self.kinds), dtype=np.uint8)
            self.known = np.concatenate((self.known, self.on(_as_key(fresh[1]))))
        before, after, stop = (x[at] for x in self.table[:3])
        bit, bare = self.table[3:]
        flags = self.flags[at]
        n = len(ids) - 2
        word = at != 0
        here = np.nonzero(word[1 : n + 1])[0] + 1
        if not len(here):
            return
        # What comes after a word as the last of a position's fillers: its stop or the next word.
        goes_on = stop == 0
        follows = np.where(goes_on[:-1], after[1:], stop[:-1])
        on = np.nonzero(word[1 : n + 1] & self.on(_as_key(before[:n] + follows[1 : n + 1])))[0]
        for k, b in zip(_as_key(before[on] + follows[on + 1]).tolist(), bit[at[on + 1]].tolist()):
            words[k or 1] |= b
        if spans is not None:
            self.count_spans(n, at, before, after, follows, word, goes_on, spans)

        at_word = np.nonzero(word[1 : n + 1] & self.known[at[1 : n + 1]])[0]
        if len(at_word) and uses is not None:
            line = np.searchsorted(ends, here)
            seeded = np.zeros(len(ends), dtype=bool)
            seeded[line[flags[here] >= 4]] = True
            for k, x in set(zip(_as_key(after[at_word + 1]).tolist(), np.searchsorted(ends, at_word + 1).tolist())):
                use = uses[k or 1]
                use[0] += 1
                use[1] += int(seeded[x])

        # Sentences start at the start of a line or after a full stop; a bullet does not belong to them.
        starts = ~word | (flags & 1 > 0)
        first = np.nonzero(starts[here - 1])[0]
        last = np.r_[first[1:], len(here)]
        first = first + ((flags[here[first]] & 2 > 0) & (last - first > 1))
        second = np.minimum(first + 1, last - 1)
        head = _as_key(
            bare[at[here[first]]] * np.uint64(_A) + (bare[at[here[second]]] ^ (last - first).astype(np.uint64)) * np.uint64(_B) + bare[at[here[last - 1]]] * np.uint64(_C)
        )
        for i in np.nonzero(self.on(head))[0].tolist():
            start = int(here[first[i]])
            s = " ".join([self.text[j] for j in ids[start : start + int(last[i] - first[i])]])
            sentences(bisect_right(ends, start), _FIGURES.sub("9", s))

    def count_spans(
        self, n: int, at: np.ndarray, before: np.ndarray, after: np.ndarray, follows: np.ndarray, word: np.ndarray, goes_on: np.ndarray, spans: dict[int, int]
    ) -> None:
        """Or the bits of spans of two and three words at marked positions into ``spans``; no word but the last has a stop.

        The arrays are of the words and ends of lines in order, ``n`` of them between the first and the last.
        """
        bare, inner = self.table[4], word & goes_on
        within = inner[1 : n + 1]
        for k in (1, 2):
            on = np.nonzero(within & word[1 + k : n + 1 + k] & self.on(_as_key(before[:n] + follows[1 + k : n + 1 + k])))[0]
            h = bare[at[on + 1]] * np.uint64(_A) + after[on + 1 + k]
            if k == 2:
                h += bare[at[on + 2]] * np.uint64(_A ^ _B)
            for key, b in zip(_as_key(before[on] + follows[on + 1 + k]).tolist(), (h >> np.uint64(58)).tolist()):
                spans[key or 1] = spans.get(key or 1, 0) | 1 << b
            within = within & inner[1 + k : n + 1 + k]


def _as_key(h: np.ndarray) -> np.ndarray:
    return (h ^ np.uint64(1 << 63)).view(np.int64)


def word_key(w: str) -> int:
    """The key by which Slots.count() knows a word."""
    h = (_word_hash(w) * _B) & ((1 << 64) - 1)
    return h - (1 << 63) or 1


def head_key(template: str) -> int:
    """The key of a sentence's first two and last words and length, by which Slots.count() knows the ones to look at."""
    w = template.split()
    h = (_word_hash(w[0]) * _A + (_word_hash(w[min(1, len(w) - 1)]) ^ len(w)) * _B + _word_hash(w[-1]) * _C) & ((1 << 64) - 1)
    return h - (1 << 63) or 1


def _key(kind: str, s: str) -> int:
    return h64(kind + s)


class _Memo(dict):
    """What was found in each line; of limited size."""

    ROWS, CHARS = 300_000, 60_000_000

    def __init__(self) -> None:
        self.chars = 0

    def put(self, line: str, found: object) -> None:
        if len(self) >= self.ROWS or self.chars >= self.CHARS:
            self.clear()
            self.chars = 0
        self[line] = found
        self.chars += len(line)


def _filter(keys: DataFrame) -> np.ndarray:
    """Flags for the 64-bit keys in column h: at least 16 places for each within POSITIONS and MOST, gathered as packed pieces."""
    keys = cut(keys.distinct())
    places = POSITIONS
    while places < MOST and places < 16 * keys.count():
        places *= 2
    size = 1 << 16

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        flags = np.zeros(size, dtype=bool)
        flags[pdf["p"].to_numpy() % size] = True
        return pd.DataFrame({"c": [int(pdf["p"].iloc[0]) // size], "b": [np.packbits(flags).tobytes()]})

    at = keys.select(F.pmod("h", F.lit(places)).cast("int").alias("p")).distinct()
    # At most MOST / 65,536 pieces of 8 KB come to the driver, however many keys there are.
    out = np.zeros((places // size, size // 8), dtype=np.uint8)
    for c, b in at.groupBy(F.floor(F.col("p") / size)).applyInPandas(pack, "c int, b binary").collect():
        out[c] = np.frombuffer(b, dtype=np.uint8)
    return out.ravel()


FOUND = "k string, kind string, h bigint, bit bigint, span boolean, sure boolean, short boolean, lead bigint, words int, listed int, others array<bigint>"


def find_residue(df: DataFrame, *, key: str = "dedupe_key", text: str = "description_text", min_fillers: int = MIN_FILLERS) -> DataFrame:
    """The records with residue: (key, reason), reason the first of filler, placeholder, page by name.

    * Null and empty texts are no cases; texts of any length are read whole. Rows with one key are
      taken together. A null key is a key. Other columns are ignored.
    * Repeated rows and copies count once each towards templates, like any other record.
    * An unmistakable form (a variable in braces, a run of underscores) is residue too where other
      fillers, of up to three words, stand at its position, at least one for every two records with
      such a form, and in at most two records where nothing else stands. A word like null is so only
      in a slot.
    * Sample text is known by its opening words, or by its words: those of the common sample paragraph
      and those that are learnt from all lines because half of their lines hold words of it.

    Nothing grows with the data in the driver: positions, words and templates of interest are marked
    in a filter of bounded size; the statistics are combined per task and joined back by hash. What a
    position holds is kept as 64 bits, of which at least ``min_fillers`` must be set: so many
    different words at least. Every line is read; a memo of limited size saves reading those that recur.
    """
    rows = df.select(F.col(key).cast("string").alias("k"), F.col(text).alias("t")).where(F.col("t").isNotNull() & (F.col("t") != ""))
    rows = rows.where(F.btrim("t") != "")

    def look(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Candidates: residue forms, sentences of short records, filler."""
        memo, nothing = _Memo(), ((), (), ())
        for pdf in it:
            out = []
            for k, t in zip(pdf["k"], pdf["t"]):
                said: dict[str, tuple[bool, bool]] = {}
                samples: dict[str, _Sample] = {}
                for line in t.split("\n"):
                    got = memo.get(line)
                    if got is None:
                        forms, *told = line_finds(line)
                        got = nothing
                        if forms or told[0] or told[1]:
                            got = (tuple((position_key(p), signed(span_bit(w.casefold().split())), " " in w, strong) for p, w, strong in forms), *told)
                        memo.put(line, got)
                    if got is not nothing:
                        forms, tells, texts = got
                        out += [(k, "slot", *f, False, 1, 0, 0, None) for f in forms]
                        said.update((s, (filler, wrong)) for s, filler, wrong in tells)
                        samples.update((x[0], x) for x in texts)
                for s, words, listed, others in samples.values():
                    out.append((k, "sample", _key("l", s), 0, False, False, False, 0, words, listed, [word_key(w) for w in others]))
                short = is_short(t)
                for s in templates(t) if short else said:
                    filler, wrong = said.get(s, (False, False))
                    if filler:
                        out.append((k, "filler", 0, 0, False, True, short, 0, 0, 0, None))
                    elif short or wrong:
                        out.append((k, "page", _key("s", s), 0, False, wrong, short and " " in s, head_key(s), 0, 0, None))
            yield pd.DataFrame(out, columns=[x.split()[0] for x in FOUND.split(", ")])

    found = cut(rows.mapInPandas(look, FOUND))
    # A sentence of no error wording must come in two short records at least to be a template of whole pages.
    pages = found.where("kind = 'page'").groupBy("h", "lead").agg(F.bool_or("sure").alias("sure"), F.count("*").alias("n")).where("sure OR n > 1")
    slots, words = found.where("kind = 'slot'").select("h"), found.select(F.explode("others").alias("h"))
    seen = df.sparkSession.sparkContext.broadcast(_filter(slots.union(pages.select(F.explode(F.array("h", "lead")))).union(words)).tobytes())

    def count(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Per task: 64 bits of what stands at each marked position; how often marked sentences come, and in short records; the lines of marked words."""
        flags = np.unpackbits(np.frombuffer(seen.value, dtype=np.uint8)).astype(bool)
        places, at_slots, memo = len(flags), Slots(flags), _Memo()
        words: dict[int, int] = defaultdict(int)
        spans: dict[int, int] = {}
        uses: dict[int, list[int]] = defaultdict(lambda: [0, 0])
        for pdf in it:
            lines = [t.split("\n") for t in pdf["t"]]
            for i in range(0, len(lines), 500):
                part = lines[i : i + 500]
                fresh = list({x for ls in part for x in ls if x not in memo})
                # What stands where is the same each time a line comes; its sentences count by record.
                heads: dict[str, set[int]] = defaultdict(set)

                def sentence(n: int, s: str, heads: dict = heads, fresh: list = fresh) -> None:
                    h = _key("s", s)
                    if flags[h % places]:
                        heads[fresh[n]].add(h)

                at_slots.count(fresh, words, spans, uses, sentence)
                known = {x: memo[x] for ls in part for x in ls if x in memo and memo[x]}
                known.update(heads)
                for x in fresh:
                    memo.put(x, heads.get(x, ()))
                for t, ls in zip(pdf["t"][i : i + 500], part):
                    met = set().union(*(known[x] for x in ls if x in known))
                    short = bool(met) and is_short(t)
                    for h in met:
                        uses[h][0] += 1
                        uses[h][1] += short
            if len(words) + len(spans) + len(uses) > 200_000:
                yield _counts(words, spans, uses)
                words.clear()
                spans.clear()
                uses.clear()
        yield _counts(words, spans, uses)

    def _counts(words: dict, spans: dict, uses: dict) -> pd.DataFrame:
        a = [(h, signed(b), 0, 0, 0) for h, b in words.items()] + [(h, 0, signed(b), 0, 0) for h, b in spans.items()]
        return pd.DataFrame(a + [(h, 0, 0, n, m) for h, (n, m) in uses.items()], columns=["h", "bits", "spans", "n", "m"])

    stats = cut(rows.select("t").mapInPandas(count, "h bigint, bits bigint, spans bigint, n bigint, m bigint").groupBy("h").agg(
        F.bit_or("bits").alias("bits"), F.bit_or("spans").alias("spans"), F.sum("n").alias("n"), F.sum("m").alias("m")
    ))
    # In how many records residue stands at a position: a sentence that is always written so comes in many.
    own = [F.bit_or(F.when(F.col("span") == x, F.col("bit")).otherwise(0)).alias(n) for n, x in (("own", False), ("own_spans", True))]
    formed = found.where("kind IN ('slot', 'page')")
    shared = formed.where("kind = 'slot'").groupBy("h").agg(F.count_distinct("k").alias("records"), *own)
    joined = formed.join(stats.join(shared, "h", "left"), "h", "left")
    fillers = F.coalesce(F.bit_count("bits"), F.lit(0))
    # Words and spans that stand at the position besides the forms of residue.
    others = sum(F.coalesce(F.bit_count(F.col(x).bitwiseAND(F.bitwise_not(y))), F.lit(0)) for x, y in (("bits", "own"), ("spans", "own_spans")))
    rare = F.col("sure") & ((others > 0) & (others * OTHERS >= F.col("records")) | (F.col("records") <= 2))
    slot = (F.col("kind") == "slot") & ((fillers >= min_fillers) | rare)
    whole = (F.col("n") >= MIN_PAGES) & (F.col("m") >= F.col("n") * WHOLE_PAGE)
    page = (F.col("kind") == "page") & F.when(F.col("sure"), whole | (F.col("short") & (F.col("m") * 2 > F.col("n")))).otherwise(whole & F.col("short"))
    marked = joined.withColumn("reason", F.when(slot, "placeholder").when(page, "page")).select("k", "reason")

    # Sample text: the share of a sentence's words that are sample words, listed or learnt.
    learnt = stats.where((F.col("n") >= MIN_LINES) & (F.col("m") >= F.col("n") * BESIDE_SEEDS)).select("h", F.lit(1).alias("known"))
    sentences = found.where("kind = 'sample'").select("k", F.col("h").alias("s"), "words", "listed", F.explode_outer("others").alias("h")).join(learnt, "h", "left")
    share = (F.max("listed") + F.coalesce(F.sum("known"), F.lit(0))) / F.max("words")
    sampled = sentences.groupBy("k", "s").agg(share.alias("share")).where(F.col("share") >= SAMPLE_WORDS).select("k", F.lit("filler").alias("reason"))
    plain = found.where("kind = 'filler'").select("k", F.lit("filler").alias("reason"))
    every = marked.where(F.col("reason").isNotNull()).union(sampled).union(plain)
    return every.groupBy(F.col("k").alias(key)).agg(F.min("reason").alias("reason"))


def signed(bits: int) -> int:
    return bits - (1 << 64) if bits >> 63 else bits


def hash_word(w: str) -> int:
    return xxhash.xxh32_intdigest(w)
