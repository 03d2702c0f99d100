"""The main content of pages by a tree-structured graphical model.

A page is a tree: the page, its blocks (runs of lines of one shape) in order, their lines in order,
written as first child and next sibling. Every block and line is content or furniture. Potentials on
the edges couple neighbours in the tree, potentials on the lines come from their words and shape.
Sum-product passes up and down the tree give each line its probability of being furniture. The
potentials are trained in train_pages.py and kept as weights.npz beside this file.
"""

from __future__ import annotations

import os
import re
from collections.abc import Callable, Iterator, Sequence
from functools import lru_cache
from itertools import chain, compress, islice
from operator import add

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SIZE = 1 << 15  # places for hashed features
SHAPES = ("menu", "sentence", "bullet", "heading", "short", "plain")
MENU, SENTENCE, BULLET, HEADING, SHORT, PLAIN = range(6)
# Edge kinds: block after block by shapes, line under block, line after line by the block's shape.
BLOCK_EDGE, CHILD_EDGE, LINE_EDGE = 0, 36, 42
EDGES = 48
WEIGHTS = os.path.join(os.path.dirname(os.path.abspath(__file__)), "pages_weights.npz")

_SEPARATED = re.compile(r"\t|\s[|·•/»«›>]\s|\s::\s|\S {3,}\S|›|»|«")
_BULLET = re.compile(r"^(?:[-–—*•+]|\d{1,2}[.)])\s+\S")
_FIGURES = re.compile(r"\d+")
_FAR = re.compile(r"[^\x00-\x7f]")
_NO_CAPITALS = bytes(i for i in range(256) if not 65 <= i <= 90)
_WORDS = re.compile(r"[^\W\d_]+|\d+|[^\w\s]")


def shape(s: str) -> int:
    """The shape of a stripped line."""
    n = s.count(" ") + 1
    if s[-1] in ".!?…" and n >= 4 and "\t" not in s and "   " not in s:
        return BULLET if _BULLET.match(s) else SENTENCE
    if _BULLET.match(s):
        return BULLET
    if _SEPARATED.search(s):
        return MENU
    if s[-1] == ":":
        return HEADING
    return SHORT if n <= 4 else PLAIN


def _h(s: str) -> int:
    return xxhash.xxh32_intdigest(s) & (SIZE - 1)


def squash(s: str) -> str:
    """A line for comparison: lower case, single spaces, figures as 9."""
    return _FIGURES.sub("9", " ".join(s.split()).casefold())


def capitals(s: str) -> int:
    """The number of upper-case letters."""
    n = len(s.encode("utf-8", "replace").translate(None, _NO_CAPITALS))
    return n if s.isascii() else n + sum(map(str.isupper, _FAR.findall(s)))


def shape_values(s: str, kind: int, words: list[str]) -> tuple[int, str, str, int, int]:
    """What shape_features() go by: few enough combinations to be remembered."""
    first = s[0] if not s[0].isalnum() else "A" if s[0].isupper() else "a"
    last = s[-1] if not s[-1].isalnum() else "9" if s[-1].isdigit() else "a"
    names = capitals(s) if len(s) < 120 else 9
    return kind, first, last, names if names < 6 else 6, len(words) if len(words) < 12 else 12


def shape_features(kind: int, first: str, last: str, names: int, words: int) -> tuple[str, ...]:
    """Names of a line's features of shape."""
    k = SHAPES[kind]
    return (f"b:{k}:{last}", f"n:{words}:{k}:{last}", f"c:{first}:{k}", f"t:{k}:{names}:{words}")


def line_features(s: str, kind: int) -> list[str]:
    """Names of the features of a line on its own; the line as a whole comes first."""
    low = squash(s)
    words = _WORDS.findall(low)
    return ["w:" + low, *shape_features(*shape_values(s, kind, words)), *("u:" + w for w in set(words)), "2:" + " ".join(words[:2])]


def context_features(kind: int, before: int | None, after: int | None, head: str, following: str, is_title: bool, where: int) -> list[str]:
    """Features of a line's place: shapes around it, the heading above it, the line below it."""
    k = SHAPES[kind]
    b = SHAPES[before] if before is not None else "^"
    a = SHAPES[after] if after is not None else "$"
    return [f"h:{k}:{head}", f"f:{k}:{following}", f"s:{b}:{k}:{a}", f"p:{k}:{where}", f"i:{k}:{is_title}"]


def forest(kinds: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, ...]:
    """The arrays of a Tree of pages with these numbers of lines, one after the other, of these shapes."""
    n = len(kinds)
    opens = np.zeros(n, dtype=bool)
    starts = (np.cumsum(counts) - counts)[counts > 0]
    opens[starts] = True
    of_page = np.cumsum(opens) - 1
    opens[1:] |= kinds[1:] != kinds[:-1]
    at = np.nonzero(opens)[0]  # first lines of blocks
    block = np.cumsum(opens) - 1
    node = np.arange(n) + block + 1  # a block comes just before its lines
    first = np.zeros(n, dtype=bool)
    first[starts] = True
    first = first[at]  # blocks that open a page
    nth = np.arange(len(at)) - block[starts][of_page[at]]
    size = n + len(at)
    parent, depth, edge, line = np.arange(-1, size - 1), np.empty(size, dtype=np.int64), np.empty(size, dtype=np.int64), np.full(size, -1)
    head = node[at] - 1
    parent[head] = np.where(first, -1, np.r_[-1, head[:-1]])
    depth[head] = nth
    edge[head] = BLOCK_EDGE + np.where(first, 0, np.r_[0, kinds[at[:-1]]] * 6 + kinds[at])
    depth[node] = nth[block] + np.arange(n) - at[block] + 1
    edge[node] = np.where(opens, CHILD_EDGE, LINE_EDGE) + kinds
    line[node] = np.arange(n)
    return parent, depth, edge, line


class Tree:
    """Nodes of many pages as arrays; parents come before children."""

    def __init__(self) -> None:
        self.parent: list[int] = []
        self.depth: list[int] = []
        self.edge: list[int] = []
        self.line: list[int] = []  # which line a node is, or -1 for a block

    def page(self, shapes: list[int], first: int) -> None:
        """Add a page whose lines, numbered from ``first``, have these shapes."""
        parent, depth, edge, line = self.parent, self.depth, self.edge, self.line
        n, block, block_depth, last, current = len(parent), -1, -1, -1, -1
        down = 0
        for i, s in enumerate(shapes):
            if s != current:
                parent.append(block)
                block, block_depth = n, block_depth + 1
                depth.append(block_depth)
                edge.append(BLOCK_EDGE + (current * 6 + s if current >= 0 else 0))
                line.append(-1)
                last, down, current = n, block_depth, s
                n += 1
                edge.append(CHILD_EDGE + s)
            else:
                edge.append(LINE_EDGE + s)
            down += 1
            parent.append(last)
            depth.append(down)
            line.append(first + i)
            last = n
            n += 1

    def arrays(self) -> tuple[np.ndarray, ...]:
        return tuple(np.array(x, dtype=np.int64) for x in (self.parent, self.depth, self.edge, self.line))


def sum_product(parent: np.ndarray, depth: np.ndarray, edge: np.ndarray, unary: np.ndarray, pair: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Log messages up and down: node marginals (n, 2), edge marginals (n, 2, 2; parent first), log partition."""
    n = len(parent)
    inside, up = unary.copy(), np.zeros((n, 2))
    order = np.argsort(depth, kind="stable")
    cuts = np.searchsorted(depth[order], np.arange(depth.max() + 2)) if n else np.array([0])
    levels = [order[a:b] for a, b in zip(cuts, cuts[1:])]
    for at in reversed(levels[1:]):
        m = pair[edge[at]] + inside[at][:, None, :]
        up[at] = np.logaddexp(m[:, :, 0], m[:, :, 1])
        np.add.at(inside, parent[at], up[at])
    down, both = np.zeros((n, 2)), np.zeros((n, 2, 2))
    for at in levels[1:]:
        p = parent[at]
        outside = down[p] + inside[p] - up[at]
        m = outside[:, :, None] + pair[edge[at]]
        down[at] = np.logaddexp(m[:, 0, :], m[:, 1, :])
        both[at] = m + inside[at][:, None, :]
    belief = inside + down
    z = np.logaddexp(belief[:, 0], belief[:, 1])
    marginal = np.exp(belief - z[:, None])
    both -= np.max(both, axis=(1, 2), keepdims=True)
    both = np.exp(both)
    both /= both.sum(axis=(1, 2), keepdims=True)
    return marginal, both, float(z[levels[0]].sum()) if n else 0.0


class _Memo(dict):
    """What a function makes of keys; of limited size."""

    def __init__(self, make: Callable, size: int = 500_000) -> None:
        self.make, self.size = make, size

    def __missing__(self, k: object) -> object:
        v = self.make(k)
        if len(self) >= self.size:
            self.clear()
        self[k] = v
        return v


class Reader:
    """Pages to lines with features, and to probabilities once it has weights."""

    def __init__(self, weights: np.ndarray | None = None, pair: np.ndarray | None = None) -> None:
        self.pair = pair
        # Without weights a line stands for its features, with them for the sum of their weights.
        self.values = weights.tolist() if weights is not None else None
        self.forget()
        self.known: dict[str, float] = {}
        self.words = _Memo(lambda w: self.values[_h("u:" + w)]).__getitem__
        self.shapes = lru_cache(maxsize=50_000)(lambda *a: self.total(shape_features(*a)))
        self.starts = lru_cache(maxsize=100_000)(lambda w: self.values[_h("2:" + w)])
        # No word or figure goes beyond a token, so lines are put together from theirs.
        self.squashed = _Memo(lambda w: _FIGURES.sub("9", w)).__getitem__
        self.parts = _Memo(lambda w: tuple(_WORDS.findall(_FIGURES.sub("9", w)))).__getitem__

    def forget(self) -> None:
        """Drop what is known of lines, but not what is known of words."""
        self.features = _Memo(self._features, 200_000).__getitem__
        self.place = _Memo(self._place, 400_000).__getitem__

    def total(self, names: list[str]) -> float:
        known, values, out = self.known, self.values, 0.0
        for x in names:
            v = known.get(x)
            if v is None:
                v = values[_h(x)]
                if len(known) < 500_000 and len(x) < 40:
                    known[x] = v
            out += v
        return out

    def _features(self, s: str) -> tuple[int, str, object]:
        kind = shape(s)
        if self.values is None:
            f = line_features(s, kind)
            return kind, f[0][2:] if len(s) < 60 else "", f
        # The same sum as over line_features(), with less to build.
        tokens = s.casefold().split()
        low = " ".join(map(self.squashed, tokens))
        words = list(chain.from_iterable(map(self.parts, tokens)))
        out = self.values[_h("w:" + low)] + self.shapes(*shape_values(s, kind, words)) + self.starts(" ".join(words[:2]))
        return kind, low if len(s) < 60 else "", out + sum(map(self.words, set(words)))

    def _place(self, a: tuple) -> object:
        f = context_features(*a)
        return f if self.values is None else self.total(f)

    def lines(self, text: str, title: str | None) -> tuple[list[int], list[int], list[object], list[object]]:
        """Numbers, shapes and features (or scores) of the non-blank lines, counted from 1."""
        stripped = list(map(str.strip, text.split("\n")))
        numbers = [i for i, s in enumerate(stripped, 1) if s]
        if not numbers:
            return [], [], [], []
        kinds, lows, own = map(list, zip(*map(self.features, filter(None, stripped))))
        name = squash(title or "") or None
        place, head, n, at = [], "", len(kinds), self.place
        before: int | None = None
        for i, (kind, low, after, below) in enumerate(zip(kinds, lows, [*kinds[1:], None], [*lows[1:], ""])):
            follow = below if after == SHORT or after == HEADING else ""
            place.append(at((kind, before, after, head, follow, low == name, 4 * i // n)))
            # A heading holds for the short lines under it until text or a menu comes.
            if kind == SHORT and before not in (SHORT, HEADING) or kind == HEADING or kind == PLAIN and before in (SENTENCE, BULLET, MENU, None):
                head = low
            elif kind == SENTENCE or kind == MENU:
                head = ""
            before = kind
        return numbers, kinds, own, place


@lru_cache(maxsize=1)
def _loaded() -> Reader:
    with np.load(WEIGHTS) as z:
        return Reader(z["weights"].astype(np.float64), z["pair"].astype(np.float64))


def load() -> Reader:
    """The trained reader, which a process keeps with the words it knows."""
    reader = _loaded()
    reader.forget()
    return reader


def marginals(reader: Reader, texts: list[str], titles: list[str | None]) -> tuple[list[list[int]], np.ndarray]:
    """The numbers of each page's non-blank lines, and the probabilities of all of them of being furniture."""
    shapes, scores, numbers = [], [], []
    for text, title in zip(texts, titles):
        num, kinds, own, place = reader.lines(text, title)
        shapes += kinds
        scores += map(add, own, place)
        numbers.append(num)
    prob = np.empty(len(scores))
    if scores:
        parent, depth, edge, line = forest(np.array(shapes, dtype=np.int64), np.array(list(map(len, numbers)), dtype=np.int64))
        unary = np.zeros((len(parent), 2))
        is_line = line >= 0
        unary[is_line, 1] = scores
        marginal, _, _ = sum_product(parent, depth, edge, unary, reader.pair)
        prob[:] = marginal[is_line, 1]
    return numbers, prob


def furniture(reader: Reader, texts: list[str], titles: list[str | None]) -> list[list[tuple[int, float]]]:
    """For each page its non-blank lines as (number, probability of being furniture)."""
    numbers, prob = marginals(reader, texts, titles)
    p = iter(prob.tolist())
    return [list(zip(num, islice(p, len(num)))) for num in numbers]


def split_pages(reader: Reader, texts: list[str], titles: list[str | None], threshold: float) -> tuple[list[list[int]], list[list[int]]]:
    """For each page the numbers of its furniture lines and of its body lines."""
    numbers, prob = marginals(reader, texts, titles)
    flags = (prob >= threshold).tolist()
    off, on, at = [], [], 0
    for num in numbers:
        f = flags[at : at + len(num)]
        off.append(list(compress(num, f)))
        on.append([i for i, x in zip(num, f) if not x])
        at += len(num)
    return off, on


PAGES_AT_ONCE = 256


def body_lines(reader: Reader, texts: list[str | None], titles: list[str | None], threshold: float = 0.5) -> Iterator[tuple[list[list[int]], list[list[str]]]]:
    """Numbers and body lines of pages, some pages at a time."""
    for at in range(0, len(texts), PAGES_AT_ONCE):
        part = [x or "" for x in texts[at : at + PAGES_AT_ONCE]]
        _, on = split_pages(reader, part, titles[at : at + PAGES_AT_ONCE], threshold)
        split = [t.split("\n") for t in part]
        yield on, [[s[i - 1] for i in ns] for s, ns in zip(split, on)]


WANTED = ("title", "furniture", "body", "body_no")


def read_pages(it: Iterator[pd.DataFrame], wanted: Sequence[str] = WANTED, threshold: float = 0.5) -> Iterator[pd.DataFrame]:
    """Batches of pages (t, name and further columns) as batches of the wanted columns beside all but t and name.

    ``joined`` may be wanted too: the title and the body lines joined by spaces.
    """
    reader = load()
    for pdf in it:
        for at in range(0, len(pdf), PAGES_AT_ONCE):
            part = pdf.iloc[at : at + PAGES_AT_ONCE]
            texts = [x if isinstance(x, str) else "" for x in part["t"]]
            names = [x if isinstance(x, str) else None for x in part["name"]]
            off, on = split_pages(reader, texts, names, threshold)
            out = {c: part[c] for c in part.columns if c not in ("t", "name")}
            if "title" in wanted:
                out["title"] = names
            if "furniture" in wanted:
                out["furniture"] = off
            if "body_no" in wanted:
                out["body_no"] = on
            if "body" in wanted or "joined" in wanted:
                bodies = []
                for t, ns in zip(texts, on):
                    split = t.split("\n")
                    bodies.append([split[i - 1] for i in ns])
                if "body" in wanted:
                    out["body"] = bodies
                if "joined" in wanted:
                    out["joined"] = [" ".join([*([n] if n is not None else []), *b]) for n, b in zip(names, bodies)]
            yield pd.DataFrame(out)


def page_lines(
    df: DataFrame, *, key: str = "dedupe_key", text: str = "description_text", title: str = "title", also: Sequence[str] = (), wanted: Sequence[str] = WANTED, threshold: float = 0.5
) -> DataFrame:
    """Each page with the numbers of its furniture lines and its body lines: (key, title, furniture, body, body_no).

    ``furniture`` and ``body_no`` are array<int>, ``body`` array<string> with the lines as they
    stand. Lines are split at \\n and counted from 1; blank lines belong to neither.

    ``also`` names further columns to keep, ``wanted`` those of the four that are made.

    * Null, empty and blank texts give empty arrays. A null title is no title.
    * Texts of any length are read whole. Repeated rows come out as often as they went in; a null
      key is kept. Columns not named are left out, so none can clash. Ties at the threshold are
      furniture.

    Every page is read on its own: no shuffle, nothing sent to the driver.
    """
    rows = df.select(F.col(key).alias("k"), F.col(title).alias("name"), F.col(text).alias("t"), *[F.col(c).alias(f"also_{i}") for i, c in enumerate(also)])
    kinds = [("k", df.schema[key].dataType.simpleString()), *((f"also_{i}", df.schema[c].dataType.simpleString()) for i, c in enumerate(also))]
    made = {"title": "string", "furniture": "array<int>", "body": "array<string>", "body_no": "array<int>"}
    kinds += [(c, made[c]) for c in WANTED if c in wanted]

    def read(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for out in read_pages(it, wanted, threshold):
            yield out[[c for c, _ in kinds]]

    out = rows.mapInPandas(read, ", ".join(f"{c} {t}" for c, t in kinds))
    return out.select(F.col("k").alias(key), *[c for c in WANTED if c in wanted], *[F.col(f"also_{i}").alias(c) for i, c in enumerate(also)])
