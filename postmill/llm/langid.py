"""The language of records, titles and lines by a bidirectional gated recurrent network over bytes.

The network reads the bytes of a line in both directions and gives every byte a distribution over
languages; the distributions are pooled over the line, and lines over the record. It is trained in
train_langid.py by backpropagation through time and kept as langid_weights.npz beside this file.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postmill.llm.pages import body_lines, load

LANGUAGES = ("en", "de", "fr", "sv", "da", "es")
WEIGHTS = os.path.join(os.path.dirname(os.path.abspath(__file__)), "langid_weights.npz")
LONG = 4096  # bytes up to which a line's start and end are shared
POSITIONS = 1 << 22  # bytes of lines that are read with shared starts and ends; a longer line alone
WIDTH = 2048  # nodes read side by side
WORD = 8  # bytes of a line taken together as a number
SUMMED = 1 << 15  # bytes whose distributions are summed at a time; a longer line alone
ABREAST = 200_000  # bytes of long lines read side by side; a longer line alone
STRETCH = 16  # steps after which the states of long lines are turned into scores

# Spellings of the languages as labels.
SPELLINGS = {
    "en": "en eng english englisch anglais engelska engelsk inglés",
    "de": "de deu ger german deutsch allemand tyska tysk alemán",
    "fr": "fr fra fre french français französisch franska fransk francés",
    "sv": "sv swe swedish svenska schwedisch suédois svensk sueco",
    "da": "da dan danish dansk dänisch danois danska danés",
    "es": "es spa spanish español castellano spanisch espagnol spanska spansk",
}
SPELLING = {w: k for k, v in SPELLINGS.items() for w in v.split()}
NO_LANGUAGE = {"", "und", "unknown", "n/a", "none", "null", "other", "xx", "zxx", "mul", "-"}


@lru_cache(maxsize=10_000)
def named(label: str | None) -> str | None:
    """The language a declared label names: one of LANGUAGES, "other", or None for no language."""
    low = (label or "").strip().casefold()
    if low in NO_LANGUAGE:
        return None
    return SPELLING.get(low) or SPELLING.get(re.split(r"[-_ (]", low)[0]) or "other"


def as_words(lines: list[bytes], size: np.ndarray) -> np.ndarray:
    """The words of WORD bytes of lines of these sizes, each line filled up with zeros, which no line has."""
    return np.frombuffer(b"".join([s.ljust(n, b"\0") for s, n in zip(lines, (-(-size // WORD) * WORD).tolist())]), dtype=np.uint64)


ONE, TWO = np.ones((), dtype=np.float32), np.full((), -2, dtype=np.float32)


def step(gates: np.ndarray, fed: np.ndarray, s: np.ndarray) -> None:
    """Carry the states s (.., H) on by the inputs of their bytes and what the states feed back, both (3, .., H), which are overwritten."""
    z, c, zr = gates[0], gates[2], gates[:2]
    zr += fed[:2]
    np.exp(zr, zr)
    zr += ONE
    np.divide(ONE, zr, zr)
    r = gates[1]
    r *= fed[2]
    c += r
    np.exp(c, c)
    c += ONE
    np.divide(TWO, c, c)
    c += ONE
    s -= c
    s *= z
    s += c


class Network:
    """Both directions: arrays and lists have two parts (forward, backward)."""

    def __init__(self, table: np.ndarray, u: np.ndarray, v: np.ndarray, c: np.ndarray) -> None:
        # table (2, 256, 3H): input weights and biases applied to every byte; u (2, H, 3H); v (2, H, L); c (L).
        table, u, self.v, self.c = (np.ascontiguousarray(x, dtype=np.float32) for x in (table, u, v, c))
        self.h = h = u.shape[1]
        # The gates z and r are 1 / (1 + e^-x), the candidate 1 - 2 / (1 + e^2x): inputs come with the factors of x.
        by = np.array([-1, -1, 2], dtype=np.float32)
        self.table = [[np.ascontiguousarray(t[:, i * h : (i + 1) * h] * by[i]) for i in range(3)] for t in table]
        self.u = np.stack([np.stack([w[:, i * h : (i + 1) * h] * by[i] for i in range(3)]) for w in u])
        # States lie between -1 and 1, so no score is larger than this.
        self.most = float(np.abs(self.v).sum(axis=(0, 1)).max() + np.abs(self.c).max())

    @classmethod
    def load(cls) -> Network:
        with np.load(WEIGHTS) as z:
            return cls(z["table"], z["u"], z["v"], z["c"])

    def scores(self, x: np.ndarray, live: list[int]) -> np.ndarray:
        """Scores (time, batch, L) of the bytes x (time, batch), of which the first ``live`` lines go on at a time."""
        t, n = x.shape
        h, u = self.h, np.ascontiguousarray(self.u.swapaxes(0, 1))
        out = np.tile(self.c, (t, n, 1))
        gates, fed = (np.empty((3, 2, n, h), dtype=np.float32) for _ in range(2))
        s, states = np.zeros((2, n, h), dtype=np.float32), np.empty((min(t, STRETCH), 2, n, h), dtype=np.float32)
        for i in range(t):
            # The backward direction goes from the longest line's end; a line joins where it ends, with no state before.
            for k, b in (0, x[i]), (1, x[t - 1 - i]):
                for gate, weights in zip(gates, self.table[k]):
                    weights.take(b, 0, gate[k], "clip")
            step(gates, np.matmul(s, u, fed), s)
            if live[t - 1 - i] < n:
                s[1, live[t - 1 - i] :] = 0
            at = i % STRETCH
            states[at] = s
            if at == STRETCH - 1 or i == t - 1:
                out[i - at : i + 1] += states[: at + 1, 0] @ self.v[0]
                out[t - 1 - i : t - i + at] += (states[: at + 1, 1] @ self.v[1])[::-1]
        return out

    def logits(self, x: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Sums over the positions of log probabilities (batch, L) of byte rows x (batch, time), sorted by length downwards."""
        n, t = x.shape
        live = np.searchsorted(-lengths, -np.arange(t), side="left").tolist()  # rows longer than i
        with np.errstate(over="ignore"):
            z = self.scores(x.T.astype(np.intp, order="C"), live)
        if self.most > 80:
            z -= z.max(axis=2, keepdims=True)
        part = np.log(np.exp(z) @ np.ones(z.shape[2], dtype=np.float32))
        for i in range(int(lengths[-1]), t):
            z[i, live[i] :] = 0
            part[i, live[i] :] = 0
        return z.sum(axis=0) - part.sum(axis=0)[:, None]

    def shared_scores(self, k: int, words: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Scores (nodes, WORD, L) of one direction over sorted lines of these numbers of words, and the node of every word.

        What a direction has read up to a word is the start of the line, so a start that lines share is
        one node, read once. Lines in order keep lines with the same start side by side.
        """
        h, u, v, (of_z, of_r, of_c) = self.h, self.u[k], self.v[k], [w.take for w in self.table[k]]
        out, place = np.empty((len(words), WORD, v.shape[1]), dtype=np.float32), np.empty(len(words), dtype=np.int64)
        gates, fed = (np.empty((3, WIDTH, h), dtype=np.float32) for _ in range(2))
        kept = np.empty((WIDTH, WORD, h), dtype=np.float32)
        # Of the lines that go on: where their next word is, words left, their node, whether it is theirs alone or the first of several.
        at, left, node, own = np.cumsum(count) - count, count, np.zeros(len(count), dtype=np.int64), np.zeros(len(count), dtype=bool)
        done, states = 0, np.zeros((1, h), dtype=np.float32)
        while len(at):
            # Nothing is shared with a line that has ended, so the first one stands for itself.
            own[0] = True
            w = words[at]
            own[1:] |= w[1:] != w[:-1]
            made = np.flatnonzero(own)
            parent, letters = node[made], w[made].view(np.uint8).reshape(-1, WORD).T.astype(np.intp, order="C")
            node = np.cumsum(own) - 1
            place[at] = node + done
            before, states = states, np.empty((len(made), h), dtype=np.float32)
            for i in range(0, len(made), WIDTH):
                s = states[i : i + WIDTH]
                n = len(s)
                g, f = gates[:, :n], fed[:, :n]
                z, r, c = g
                before.take(parent[i : i + WIDTH], 0, s, "clip")
                for j in range(WORD):
                    b = letters[j, i : i + WIDTH]
                    of_z(b, 0, z, "clip")
                    of_r(b, 0, r, "clip")
                    of_c(b, 0, c, "clip")
                    step(g, np.matmul(s, u, f), s)
                    kept[:n, j] = s
                np.matmul(kept[:n].reshape(-1, h), v, out[done + i : done + i + n].reshape(-1, v.shape[1]))
            done += len(made)
            on = left > 1
            own[1:] |= ~on[:-1]
            at, left, node, own = at[on] + 1, left[on] - 1, node[on], own[on]
        return out[:done], place

    def shared_logits(self, lines: list[bytes]) -> np.ndarray:
        """Sums over the bytes of log probabilities (lines, L) of lines in order, none of them empty."""
        size = np.array(list(map(len, lines)), dtype=np.int64)
        back = [s[::-1] for s in lines]
        order = np.array(sorted(range(len(back)), key=back.__getitem__), dtype=np.int64)
        # Lines are filled up to whole words; what is read beyond their ends is not looked at.
        count = -(-size // WORD)
        # A gate far from 0 goes beyond what a float holds and is then 0, as it should be.
        with np.errstate(over="ignore"):
            ahead, node = self.shared_scores(0, as_words(lines, size), count)
            behind, back_node = self.shared_scores(1, as_words([back[i] for i in order.tolist()], size[order]), count[order])
        first, back_first = np.cumsum(count) - count, np.empty(len(size), dtype=np.int64)
        back_first[order] = np.cumsum(count[order]) - count[order]
        ends = np.cumsum(size)
        ones, total = np.ones(len(self.c), dtype=np.float32), np.empty((len(size), len(self.c)))
        i = 0
        while i < len(size):
            start = int(ends[i] - size[i])
            j = max(i + 1, int(np.searchsorted(ends, start + SUMMED, side="right")))
            n = count[i:j]
            # Words of the part as they follow each other, and the bytes of these: forwards, and backwards from the last.
            f, nth = np.cumsum(n) - n, np.arange(int(n.sum()))
            z = ahead.take(node[np.repeat(first[i:j] - f, n) + nth], 0).reshape(-1, len(self.c))
            y = behind.take(back_node[np.repeat(back_first[i:j] - f, n) + nth], 0).reshape(-1, len(self.c))
            m, to = size[i:j], ends[i:j] - start
            byte = np.arange(int(to[-1]))
            z = z.take(np.repeat(f * WORD - to + m, m) + byte, 0)
            z += y.take(np.repeat(f * WORD + to - 1, m) - byte, 0)
            z += self.c
            if self.most > 80:
                z -= z.max(axis=1, keepdims=True)
            z -= np.log(np.exp(z) @ ones)[:, None]
            total[i:j] = np.add.reduceat(z, to - m, axis=0)
            i = j
        return total

    def read(self, lines: list[str]) -> np.ndarray:
        """Log probabilities (lines, L) of lines; see read_bytes()."""
        return self.read_bytes(all_prepared(lines))

    def read_bytes(self, lines: list[bytes]) -> np.ndarray:
        """Log probabilities (lines, L) of prepared lines, pooled over bytes; an empty line is all even.

        The sum of the position log probabilities is scaled by the root of the length, so that a
        long line is surer than a short one without being certain.
        """
        total = np.zeros((len(lines), len(LANGUAGES)))
        size = np.array([len(b) for b in lines], dtype=np.int64)
        some = np.flatnonzero((size > 0) & (size <= LONG)).tolist()
        order = np.array(sorted(some, key=lines.__getitem__), dtype=np.int64)
        ends = np.cumsum(size[order])
        at = 0
        while at < len(order):
            end = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + POSITIONS, side="right")))
            total[order[at:end]] = self.shared_logits([lines[i] for i in order[at:end].tolist()])
            at = end
        # Long lines are few and go side by side: fewer the longer they are.
        order = np.argsort(-size, kind="stable")[: int((size > LONG).sum())]
        at = 0
        while at < len(order):
            longest = int(size[order[at]])
            part = order[at : at + max(1, ABREAST // longest)]
            at += len(part)
            x = np.zeros((len(part), longest), dtype=np.uint8)
            x[np.arange(longest) < size[part][:, None]] = np.frombuffer(b"".join([lines[i] for i in part.tolist()]), dtype=np.uint8)
            total[part] = self.logits(x, size[part])
        total /= np.sqrt(np.maximum(size, 1))[:, None]
        total -= total.max(axis=1, keepdims=True)
        return total - np.log(np.exp(total).sum(axis=1, keepdims=True))


_PLAIN = re.compile(r"[^\w'’\-]+|\d+")


def prepared(s: str) -> bytes:
    """The bytes the network reads: words of a line in lower case, runs of other signs and figures as one blank."""
    return _PLAIN.sub(" ", s).strip().casefold().encode("utf-8", "replace")


KEPT, SIGN, FIGURE, END = range(4)
AT_ONCE = 1 << 20  # characters prepared side by side


def _kind(c: str) -> int:
    """What prepared() does with a character."""
    return FIGURE if c.isdecimal() else KEPT if c.isalnum() or c in "_'’-" else END if c == "\n" else SIGN


@lru_cache(maxsize=1)
def kinds() -> np.ndarray:
    return np.array([_kind(chr(i)) for i in range(1 << 16)], dtype=np.uint8)


def all_prepared(lines: list[str]) -> list[bytes]:
    """prepared() of many lines, character by character on arrays."""
    out: list[bytes] = []
    ends = np.cumsum([len(s) + 1 for s in lines])
    at = 0
    while at < len(lines):
        end = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + AT_ONCE)))
        part = lines[at:end]
        text = "\n".join(part)
        if text.count("\n") >= len(part):
            # A line feed within a line is a sign like any other.
            text = "\n".join([s.replace("\n", " ") for s in part])
        c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        k = kinds()[np.minimum(c, 0xFFFF)]
        for i in np.nonzero(c > 0xFFFF)[0].tolist():
            k[i] = _kind(chr(c[i]))
        stays = (k == KEPT) | (k == END)
        blank = ~stays
        # The first of a run stands for it.
        stays[:1] = True
        stays[1:] |= k[1:] != k[:-1]
        text = np.where(blank, np.uint32(32), c)[stays].tobytes().decode("utf-32-le", "surrogatepass")
        out += [s.strip().casefold().encode("utf-8", "replace") for s in text.split("\n")]
        at = end
    return out


# A title or line differs from the main language only if it is this sure of it.
SURE = 0.6


def languages(
    pages: DataFrame, *, key: str = "dedupe_key", title: str = "title", lines: str = "body", numbers: str = "body_no", label: str = "lang_label", sure: float = SURE
) -> DataFrame:
    """Language and confidence of records, titles and lines.

    ``pages`` has a key, a title, an array of lines with an array of their numbers, and a declared
    label. The result has (key, declared, lang, confidence, title_lang, title_confidence,
    segments array<struct<line_no, pieces, lang, confidence>>).

    * The distributions of the lines are pooled by their words; lang is the language with the
      greatest part, confidence that part; a tie goes to the earlier one in LANGUAGES. It is null,
      with confidence 0, for a record without words, whose title is then judged alone. declared is
      what the label names: a language, "other" or null.
    * A null or empty title has no language. Null lines are empty. Lines of any length are read whole.
    * Repeated rows come out as often as they went in; a null key is kept; other columns are left
      out, so none can clash.

    Records are read where they lie: no shuffle, nothing sent to the driver.
    """
    kind = pages.schema[key].dataType.simpleString()
    rows = pages.select(F.col(key).alias("k"), F.col(title).alias("title"), F.col(lines).alias("body"), F.col(numbers).alias("body_no"), F.col(label).alias("label"))

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[Records]:
        for b in it:
            yield b.column("k"), *(b.column(c).to_pylist() for c in ("title", "body", "body_no", "label"))

    return rows.mapInArrow(lambda it: read_languages(batches(it), sure), f"k {kind}, {FOUND}").withColumnRenamed("k", key)


def page_languages(df: DataFrame, *, key: str = "dedupe_key", text: str = "description_text", title: str = "title", label: str = "lang_label", sure: float = SURE) -> DataFrame:
    """languages() of the body lines of pages, as page_lines() finds them, in one pass over the pages; the same result."""
    kind = df.schema[key].dataType.simpleString()
    rows = df.select(F.col(key).alias("k"), F.col(title).alias("name"), F.col(text).alias("t"), F.col(label).alias("label"))

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[Records]:
        """Batches as they came, so that lines are shared in all of one."""
        reader = load()
        for b in it:
            names, texts = b.column("name").to_pylist(), b.column("t").to_pylist()
            lines, numbers = [], []
            for on, body in body_lines(reader, texts, names):
                lines += body
                numbers += on
            yield b.column("k"), names, lines, numbers, b.column("label").to_pylist()

    return rows.mapInArrow(lambda it: read_languages(batches(it), sure), f"k {kind}, {FOUND}").withColumnRenamed("k", key)


FOUND = (
    "declared string, lang string, confidence double, title_lang string, title_confidence double, "
    "segments array<struct<line_no int, pieces int, lang string, confidence double>>"
)


# Keys, titles, lines, their numbers and labels of a batch of records.
Records = tuple[pa.Array, list[str | None], list[list[str | None] | None], list[list[int] | None], list[str | None]]


def read_languages(it: Iterator[Records], sure: float) -> Iterator[pa.RecordBatch]:
    """Batches of records as batches of k and FOUND."""
    net = Network.load()
    for keys, names, texts, numbers, labels in it:
        if not len(keys):
            continue
        texts = [[s or "" for s in x] if x else [] for x in texts]
        names = [x or "" for x in names]
        # Lines that the network reads alike are read once a batch.
        number: dict[str, int] = {}
        for s in names:
            number.setdefault(s, len(number))
        flat = [number.setdefault(s, len(number)) for x in texts for s in x]
        index: dict[bytes, int] = {}
        to = np.array([index.setdefault(b, len(index)) for b in all_prepared(list(number))], dtype=np.int64)
        prob = np.exp(net.read_bytes(list(index)))
        words = np.array([len(s.split()) for s in number], dtype=np.int64)
        at, title = np.array(flat, dtype=np.int64), np.array([number[s] for s in names], dtype=np.int64)
        counts = np.array([len(x) for x in texts], dtype=np.int64)
        main, conf, title_pick, title_conf, pick, line_conf = judge(prob[to[at]], words[at], counts, prob[to[title]], sure)
        no_title = np.array([not s.strip() for s in names])
        # Lines without a number are no segments.
        shown = [min(len(x), len(ns) if ns is not None else 0) for x, ns in zip(texts, numbers)]
        if shown != counts.tolist():
            on = np.concatenate([np.arange(n) < m for n, m in zip(counts, shown)])
            at, pick, line_conf = at[on], pick[on], line_conf[on]
        nos = pa.array([i for ns, m in zip(numbers, shown) if m for i in ns[:m]], type=pa.int32())
        parts = [nos, pa.array(words[at], type=pa.int32()), named_by(pick), pa.array(line_conf)]
        segments = pa.ListArray.from_arrays(
            pa.array(np.r_[0, np.cumsum(shown)], type=pa.int32()), pa.StructArray.from_arrays(parts, names=["line_no", "pieces", "lang", "confidence"])
        )
        declared = pa.array([named(x) for x in labels], type=pa.string())
        title_lang = named_by(np.where(no_title, -1, title_pick))
        columns = [keys, declared, named_by(main), pa.array(conf), title_lang, pa.array(np.where(no_title, 0.0, title_conf)), segments]
        yield pa.RecordBatch.from_arrays(columns, names=["k", "declared", "lang", "confidence", "title_lang", "title_confidence", "segments"])


def named_by(pick: np.ndarray) -> pa.Array:
    """Names of the languages with these numbers, null for -1."""
    return pa.array(LANGUAGES, type=pa.string()).take(pa.array(pick, type=pa.int32(), mask=pick < 0))


def judge(prob: np.ndarray, words: np.ndarray, counts: np.ndarray, title: np.ndarray, sure: float) -> tuple[np.ndarray, ...]:
    """Main language (-1 for none) and confidence of records, language and confidence of their titles and of their lines.

    ``prob`` and ``words`` are of all lines, of which the records have ``counts`` in order; ``title`` is of the titles.
    """
    n, one = len(counts), np.arange(len(counts))
    pooled, total = np.zeros((n, len(LANGUAGES))), np.zeros(n, dtype=np.int64)
    some = np.nonzero(counts)[0]
    if len(some):
        start = (np.cumsum(counts) - counts)[some]
        pooled[some] = np.add.reduceat(prob * words[:, None], start, axis=0)
        total[some] = np.add.reduceat(words, start)
    main = np.where(total > 0, pooled.argmax(axis=1), -1)
    conf = np.where(total > 0, pooled[one, main] / np.maximum(total, 1), 0.0)

    def unless_unsure(p: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        row, best = np.arange(len(p)), p.argmax(axis=1)
        pick = np.where((of < 0) | (p[row, best] >= sure), best, of)
        return pick, p[row, pick]

    return main, conf, *unless_unsure(title, main), *unless_unsure(prob, np.repeat(main, counts))


def judged(scores: np.ndarray, lines: list[str], numbers: list[int], title: np.ndarray | None, sure: float) -> tuple:
    """Main language, title language and segments of one record from the log probabilities."""
    words = np.array([len(s.split()) for s in lines], dtype=np.int64)
    name = np.exp(title if title is not None else np.zeros(len(LANGUAGES)))[None]
    main, conf, t_pick, t_conf, pick, line_conf = judge(np.exp(scores), words, np.array([len(lines)]), name, sure)
    segments = [{"line_no": int(no), "pieces": int(n), "lang": LANGUAGES[i], "confidence": float(p)} for no, n, i, p in zip(numbers, words, pick, line_conf)]
    t = (LANGUAGES[t_pick[0]], float(t_conf[0])) if title is not None else (None, 0.0)
    return (LANGUAGES[main[0]] if main[0] >= 0 else None, float(conf[0]), *t, segments)
