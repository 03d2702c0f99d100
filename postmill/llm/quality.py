"""Figures about each text, and its structure by divergence from profiles.

The signs of every line (function words, other words, figures, codes, separators, stops, bullets and
so on) make a distribution. Its Jensen-Shannon divergence from the profiles of prose in each
language, of lists, of tables and of junk says what the line is; the profile also counts how far the
function words are those of the language. Profiles are learnt in train_quality.py and kept as
quality_profiles.json beside this file.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PROFILES = os.path.join(os.path.dirname(os.path.abspath(__file__)), "quality_profiles.json")
KINDS = ("prose", "list", "table", "junk")

# Function words by language; first those that go with a sentence, then the others.
VERBAL = {
    "en": "we you they he she it i our your their us is are was were be been has have had will would can could may must should do does did not if when whenever so that who which please",
    "de": "wir sie er es ich unsere unserem unser ihre ihr ihnen ihren ist sind war waren wird werden hat haben kann können muss müssen soll nicht wenn dass die denen deren wie uns sich",
    "fr": "nous vous ils elle il on notre nos votre vos est sont était a ont avons aurez sera seront peut doit devrez ne pas si que qui quand ce cela s'il",
    "sv": "vi du de han hon det jag vår våra vårt din ditt dina är var blir har hade kan ska skulle måste inte om som när att dig oss",
    "da": "vi du de han hun det jeg vores din dit dine er var bliver har havde kan skal skulle må ikke hvis som når at dig os der",
    "es": "nosotros tú ellos él ella yo nuestra nuestro nuestras tu tus su sus es son era ha han hay tiene puede debe no si que quien cuando te nos se eres",
}
NOMINAL = {
    "en": "the a an of in on at to for with and or from by about around after before during between into as up",
    "de": "der die das den dem des ein eine einen einem einer und oder in im an am auf zu zum zur für mit von vom bei nach aus um über",
    "fr": "le la les l un une des du de d et ou à au aux en dans sur pour avec par vers autour depuis chez",
    "sv": "en ett den och eller i på av till för med från kring efter inför under hos runt",
    "da": "en et den og eller i på af til for med fra omkring efter før under hos over",
    "es": "el la los las un una unos unas y o de del al en a por para con sobre entre desde cerca hacia",
}
LANGS = tuple(VERBAL)
_VERBAL = {w for v in VERBAL.values() for w in v.split()}
_NOMINAL = {w for v in NOMINAL.values() for w in v.split()} - _VERBAL
_COMMON = _VERBAL | _NOMINAL
BY_LANG = {w: [i for i, k in enumerate(LANGS) if w in f" {VERBAL[k]} {NOMINAL[k]} ".split()] for w in _COMMON}

SIGNS = ("verbal", "nominal", "word", "name", "figure", "code", "separator", "comma", "stop", "bullet", "symbol", "odd", "broken", "open end", "gap", "rule", "few", "some", "many", "same")
S = {s: i for i, s in enumerate(SIGNS)}
_TOKEN = re.compile(r"[^\W_]+(?:['’\-./:][^\W_]+)*|\t| {3,}|[^\w\s]+|_+")
_VOWEL = re.compile(r"[aeiouyåäöæøéèêëáàâíìîïóòôúùûüœ]", re.I)
_CLUSTER = re.compile(r"[bcdfghjklmnpqrstvwxzñçß]{5,}", re.I)
_ENUM = re.compile(r"^\s*(?:[-–—*•+]|\d{1,3}[.)]|[a-z][.)])\s+")
_LATIN = re.compile(r"^[\u0000-ɏ‐-‧€]*$")


def sign(t: str) -> int:
    """The sign that a token stands for."""
    low = t.casefold()
    if low in _VERBAL:
        return S["verbal"]
    if low in _NOMINAL:
        return S["nominal"]
    c = t[0]
    if c == "\t" or c == " ":
        return S["gap"]
    if c.isalnum():
        if not _LATIN.match(t):
            return S["broken"]
        figures = sum(x.isdigit() for x in t)
        if figures:
            return S["figure"] if all(x.isdigit() or x in ".,:/-" for x in t) else S["code"]
        if any(x.isupper() for x in t[1:]) and not t.isupper() and not re.search(r"[-'’./]", t) and len(re.findall("[A-ZÅÄÖØÆ]", t)) > 2:
            return S["odd"]
        if re.search(r"[a-z][.:/][a-z]", t) and len(t) < 24:
            return S["code"]
        if "/" in t or "." in t:
            return S["word"]
        if len(t) > 28 and "-" not in t or not _VOWEL.search(t) and len(t) > 2 or _CLUSTER.search(t) and not t[0].isupper() and len(_VOWEL.findall(t)) * 4 < len(t):
            return S["odd"]
        return S["name"] if c.isupper() else S["word"]
    if t in (",",):
        return S["comma"]
    if t in (";", "|", "!", "||", ";;"):
        return S["separator"]
    if t in (".", "?", ".)", "…", "...", ".”", '."') or t == ":":
        return S["stop"]
    if len(t) > 3 and len(set(t)) <= 3:
        return S["rule"]
    if not _LATIN.match(t):
        return S["broken"]
    return S["symbol"]


_known: dict[str, int] = {}
LENGTH = 12 + len(LANGS)  # the bit from which a token's code holds its length, above the languages


def coded(t: str) -> int:
    """A token's sign, whether it is a word, languages of which it is a function word, and its length, in one number."""
    low = t.casefold()
    langs = sum(1 << i for i in BY_LANG.get(low, ()))
    code = sign(t) | t[0].isalpha() << 11 | langs << 12 | len(t) << LENGTH
    if len(_known) < 300_000:
        _known[t] = code
    return code


def line_codes(line: str) -> tuple[list[int], int]:
    """The coded tokens of a line and its shape: 1 bulleted, 2 open at the end, 4 separated, 8 a rule, 16 saying the same over and over."""
    if line.isupper():
        line = line.lower()
    shape = 0
    m = _ENUM.match(line)
    if m:
        shape |= 1
        line = line[m.end() :]
    tokens = _TOKEN.findall(line.strip())
    known = _known.get
    codes = [known(t) or coded(t) for t in tokens]
    if not tokens:
        return codes, shape | 8
    last = codes[-1] & 31
    if last != S["stop"]:
        shape |= 2
    if len(tokens) >= 24 and len(set(tokens)) < 0.4 * len(tokens) and len(set(zip(*(tokens[i:] for i in range(9))))) < 0.4 * len(tokens):
        shape |= 16
    signs = {c & 31 for c in codes}
    if S["separator"] in signs or S["gap"] in signs:
        shape |= 4
    if signs <= {S["rule"], S["separator"], S["symbol"]}:
        shape |= 8
    return codes, shape


WEIGHTS = np.ones(len(SIGNS))
WEIGHTS[[S["separator"], S["gap"]]] = 2.0


def signs_of(codes: np.ndarray, block: np.ndarray, counts: np.ndarray, shapes: np.ndarray, blocks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Counts of signs, and of function words by language, for each block of lines.

    codes and block go by token; counts (tokens), shapes and blocks go by line.
    """
    n, k = int(blocks[-1]) + 1, len(SIGNS)
    kind = codes & 31
    out = np.bincount(block * k + kind, minlength=n * k).reshape(n, k) * WEIGHTS
    words = np.bincount(np.repeat(np.arange(len(counts)), counts), weights=(kind <= S["name"]), minlength=len(counts))
    weight = np.maximum(1.0, 0.15 * counts)
    np.add.at(out, (blocks, np.where(words <= 3, S["few"], np.where(words <= 7, S["some"], S["many"]))), weight)
    np.add.at(out[:, S["bullet"]], blocks, 1.5 * (shapes & 1))
    np.add.at(out[:, S["open end"]], blocks, (shapes >> 1 & 1) * weight)
    np.add.at(out[:, S["same"]], blocks, (shapes >> 4 & 1) * counts)
    langs = np.stack([np.bincount(block, weights=codes >> (12 + i) & 1, minlength=n) for i in range(len(LANGS))], axis=1)
    return out, langs


def line_signs(line: str) -> tuple[np.ndarray, np.ndarray]:
    """The counts of signs of a line, and of its function words by language."""
    codes, shape = line_codes(line)
    zero = np.zeros(1, dtype=np.int64)
    a, b = signs_of(np.array(codes, dtype=np.int64), np.zeros(len(codes), dtype=np.int64), np.array([len(codes)]), np.array([shape]), zero)
    return a[0], b[0]


def divergence(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Jensen-Shannon divergence (bits) of each row of p from each row of q."""
    a, b = p[:, None, :], q[None, :, :]
    m = (a + b) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        x = np.where(a > 0, a * np.log2(a / m), 0).sum(-1)
        y = np.where(b > 0, b * np.log2(b / m), 0).sum(-1)
    return (x + y) / 2


class Profiles:
    def __init__(self, names: list[str], signs: np.ndarray, langs: np.ndarray) -> None:
        # names like "prose en", "list items"; langs (profiles, L) only count for prose.
        self.names, self.signs, self.langs = names, signs, langs
        self.kinds = [KINDS.index(n.split()[0]) for n in names]
        self.prose = np.array([k == 0 for k in self.kinds])

    @classmethod
    def load(cls) -> Profiles:
        with open(PROFILES) as f:
            d = json.load(f)
        return cls(list(d), np.array([v["signs"] for v in d.values()]), np.array([v["langs"] for v in d.values()]))

    def nearest(self, signs: np.ndarray, langs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each line the nearest profile and its divergence."""
        p = signs / np.maximum(signs.sum(1, keepdims=True), 1e-9)
        d = np.concatenate([divergence(p[at : at + 4096], self.signs) for at in range(0, len(p), 4096)]) if len(p) else np.zeros((0, len(self.names)))
        share = langs / np.maximum(langs.sum(1, keepdims=True), 1e-9)
        has = langs.sum(1) > 0
        for k in np.nonzero(self.prose)[0]:
            d[:, k] += np.where(has, 0.1 * divergence(share, self.langs[k : k + 1])[:, 0], 0.1)
        return d.argmin(1), d.min(1)


FIGURES = ("n_words", "mean_word_length", "symbol_ratio", "digit_ratio", "punctuated_lines", "bullet_lines", "common_words", "verbal_words")


def repeated(text: str) -> bool:
    """Whether a text is mostly the same words over and over: runs of five words, under a third of them distinct."""
    w = text.split()
    if len(w) < 40 or len(set(w)) > 0.5 * len(w):
        return False
    runs = set(zip(w, w[1:], w[2:], w[3:], w[4:]))
    return len(runs) < (len(w) - 4) / 3


def settled(kinds: np.ndarray, shapes: np.ndarray, sizes: np.ndarray) -> None:
    """Put right what a line can't tell by itself: rules and headings, in place."""
    rule = shapes & 8 > 0
    n = len(kinds)
    if rule.any() and not rule.all():
        # A rule belongs to the table it is drawn in; one between paragraphs divides them.
        solid = np.nonzero(~rule)[0]
        at = np.nonzero(rule)[0]
        left = solid[np.maximum(np.searchsorted(solid, at) - 1, 0)]
        right = solid[np.minimum(np.searchsorted(solid, at), len(solid) - 1)]
        table = (kinds[left] == 2) & (at - left < 3) | (kinds[right] == 2) & (np.abs(right - at) < 3)
        kinds[at] = np.where(table, 2, np.where(len(at) * 4 < n, kinds[left], 3))
    if n <= 3 or not (kinds == 1).any() or (kinds == 1).all():
        return
    cut = np.nonzero(np.diff(kinds))[0] + 1
    for start, end in zip(np.r_[0, cut].tolist(), np.r_[cut, n].tolist()):
        # A short line or two between paragraphs is a heading, not a list.
        if kinds[start] == 1 and end - start < 3 and sizes[start:end].sum() < 120:
            kinds[start:end] = min(int(kinds[k]) for k in (start - 1, end) if 0 <= k < n)


AT_ONCE = 256


def text_quality(df: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``df``: key, FIGURES, the shares of characters by kind, kind and divergence.

    kind is the kind with most characters among list, table and junk if these are together more than
    half of the characters of the non-blank lines, else prose; ties go to the earlier in KINDS.
    divergence is the mean over the lines, weighted by characters.

    * Null, empty and blank texts have kind "blank" and zeros. Texts of any length are read whole.
    * Repeated rows come out as often as they went in; a null key is kept; other columns are left out.

    Every text is read where it lies: no shuffle, nothing sent to the driver.
    """
    kind = df.schema[key].dataType.simpleString()

    def read(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        profiles = Profiles.load()
        for pdf in it:
            for at in range(0, len(pdf), AT_ONCE):
                part = pdf.iloc[at : at + AT_ONCE]
                found = measured([t if isinstance(t, str) else "" for t in part["t"]], profiles)
                yield pd.DataFrame([(k, *m) for k, m in zip(part["k"], found)], columns=["k", *FIGURES, *(f"{x}_share" for x in KINDS), "kind", "divergence"])

    rows = df.select(F.col(key).alias("k"), F.col(text).alias("t"))
    figures = "n_words bigint, " + ", ".join(f"{x} double" for x in FIGURES[1:])
    shares = ", ".join(f"{x}_share double" for x in KINDS)
    return rows.mapInPandas(read, f"k {kind}, {figures}, {shares}, kind string, divergence double").withColumnRenamed("k", key)


BLANK = (0, *[0.0] * (len(FIGURES) - 1), 0.0, 0.0, 0.0, 0.0, "blank", 0.0)


def measured(texts: list[str], profiles: Profiles) -> list[tuple]:
    """The columns of text_quality() for each text.

    Successive lines of one shape are a block, which has one distribution and one kind.
    """
    codes: list[int] = []
    counts: list[int] = []
    shapes: list[int] = []
    sizes: list[int] = []
    stops: list[bool] = []
    doc: list[int] = []
    same: list[bool] = []
    for d, text in enumerate(texts):
        same.append(repeated(text))
        for x in text.split("\n"):
            x = x.strip()
            if x:
                c, shape = line_codes(x)
                codes += c
                counts.append(len(c))
                shapes.append(shape)
                sizes.append(len(x))
                stops.append(x[-1] in ".!?:;…")
                doc.append(d)
    if not doc:
        return [BLANK] * len(texts)
    code, count, shape, size, of = (np.array(x, dtype=np.int64) for x in (codes, counts, shapes, sizes, doc))
    block = np.cumsum(np.r_[0, (shape[1:] != shape[:-1]) | (of[1:] != of[:-1])])
    signs, langs = signs_of(code, np.repeat(block, count), count, shape, block)
    near, far = profiles.nearest(signs, langs)
    kinds = np.array(profiles.kinds)[near][block]
    first = np.searchsorted(of, np.arange(len(texts) + 1))
    for d in np.unique(of).tolist():
        part = slice(first[d], first[d + 1])
        if same[d]:
            kinds[part] = 3
        else:
            settled(kinds[part], shape[part], size[part])
    n = len(texts)
    token = np.repeat(of, count)
    kind, length, alpha = code & 31, code >> LENGTH, code >> 11 & 1
    total = lambda where, weight=None: np.bincount(token[where], weights=None if weight is None else weight[where], minlength=n)
    words, letters = total(alpha == 1), total(alpha == 1, length)
    solid = np.maximum(total(kind != S["gap"], length), 1)
    marks = np.zeros(32, dtype=bool)
    marks[[S["separator"], S["comma"], S["stop"], S["symbol"], S["rule"]]] = True
    symbols, figures = total(marks[kind], length), total(kind == S["figure"], length)
    verbal, common = total(kind == S["verbal"]), total(kind <= S["nominal"])
    lines = np.maximum(np.bincount(of, minlength=n), 1)
    stopped, bullets = np.bincount(of, weights=stops, minlength=n) / lines, np.bincount(of, weights=shape & 1, minlength=n) / lines
    share = np.bincount(of * 4 + kinds, weights=size, minlength=4 * n).reshape(n, 4)
    whole = share.sum(1)
    away = np.bincount(of, weights=far[block] * size, minlength=n)
    out = []
    for d in range(n):
        if not whole[d]:
            out.append(BLANK)
            continue
        x, w = share[d] / whole[d], max(1, int(words[d]))
        best = 1 + int(x[1:].argmax())
        out.append((
            int(words[d]), float(letters[d]) / w, float(symbols[d] / solid[d]), float(figures[d] / solid[d]), float(stopped[d]), float(bullets[d]),
            float(common[d]) / w, float(verbal[d]) / w, *map(float, x), KINDS[best] if x[1:].sum() > 0.5 else "prose", float(away[d] / whole[d]),
        ))
    return out
