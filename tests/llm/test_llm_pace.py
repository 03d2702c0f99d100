"""What saves CPU seconds gives the results of the plain way."""

import time

import numpy as np
import pandas as pd

from postmill.llm import langid, neardup, pages, residue

ODD = ["", "a\nb 12,3 4", "Ⓐ x  9９ ٣", "🚀 go𝟘 ß İ", "’s -_- ", "ͅ ǰ", " tab\there\xa0and  there ", "x" * 5, "\ud800 lone"]


def test_lines_prepared_together(monkeypatch):
    want = [langid.prepared(s) for s in ODD * 3]
    assert langid.all_prepared(ODD * 3) == want and langid.all_prepared([]) == []
    monkeypatch.setattr(langid, "AT_ONCE", 7)
    assert langid.all_prepared(ODD * 3) == want


def test_lines_of_unlike_length_are_read_as_alone():
    net = langid.Network.load()
    lines = [("vi söker dig som vill arbeta " * 9)[:n] for n in (250, 249, 120, 40, 7, 1)]
    together = net.read(lines)
    assert np.allclose(together, np.concatenate([net.read([s]) for s in lines]), atol=1e-4)


def plainly(w: dict[str, np.ndarray], line: bytes) -> np.ndarray:
    """Log probabilities of a line, one byte after the other by the formulas of the network."""
    scores = np.tile(w["c"], (len(line), 1))
    for k, to in (0, range(len(line))), (1, range(len(line) - 1, -1, -1)):
        s = np.zeros(16)
        for i in to:
            (xz, xr, xc), (uz, ur, uc) = w["table"][k, line[i]].reshape(3, 16), np.split(s @ w["u"][k], 3)
            z, r = (0.5 + 0.5 * np.tanh(x / 2) for x in (xz + uz, xr + ur))
            s = z * s + (1 - z) * np.tanh(xc + r * uc)
            scores[i] += s @ w["v"][k]
    p = (scores - np.logaddexp.reduce(scores, axis=1, keepdims=True)).sum(axis=0) / np.sqrt(len(line))
    return p - np.logaddexp.reduce(p)


def test_starts_and_ends_that_lines_share_are_read_once(monkeypatch):
    with np.load(langid.WEIGHTS) as f:
        w = {k: f[k].astype(np.float64) for k in f.files}
    base = "vi söker dig som vill arbeta hos oss and we look for people".encode()
    lines = [base[:n] for n in (1, 7, 8, 9, 15, 16, 17, 40, 60)] + [base[i:] for i in (1, 8, 9, 30)]
    lines += [base + b" aa " + base, base + b" ab " + base, b"", base[:8], base[:8] + b"x", b"y" + base[:8]]
    want = np.array([plainly(w, s) if s else np.full(6, -np.log(6)) for s in lines])
    net = langid.Network.load()
    assert np.allclose(net.read_bytes(lines), want, atol=1e-4)
    for name, size in ("WIDTH", 3), ("SUMMED", 20), ("POSITIONS", 100), ("LONG", 16), ("ABREAST", 150), ("STRETCH", 7):
        monkeypatch.setattr(langid, name, size)
        assert np.allclose(net.read_bytes(lines), want, atol=1e-4)
    # 500 lines with a common start of 400 bytes: its 50 words are read once and not 500 times.
    same = sorted(b"we write " * 44 + b"    " + b"%03d" % i for i in range(500))
    size = np.array(list(map(len, same)))
    nodes, place = net.shared_scores(0, langid.as_words(same, size), -(-size // langid.WORD))
    assert len(place) == 500 * 51 and len(nodes) == 50 + 500


def test_gates_far_from_zero_are_shut_or_open():
    with np.load(langid.WEIGHTS) as f:
        net = langid.Network(f["table"].astype(np.float32) * 1000, f["u"], f["v"], f["c"])
    assert np.isfinite(net.read(["vi soker dig", "we look for you"])).all()


def test_records_judged_together_as_alone():
    rng = np.random.default_rng(4)
    counts, lines = np.array([0, 3, 1, 0, 5]), ["a b", "", "c", "d e f", "", "g", "h i", "j", "k"]
    z = np.log(rng.dirichlet(np.ones(6), 9))
    titles = np.log(rng.dirichlet(np.ones(6), 5))
    main, conf, t_pick, t_conf, pick, line_conf = langid.judge(np.exp(z), np.array([len(s.split()) for s in lines]), counts, np.exp(titles), 0.6)
    at = 0
    for i, n in enumerate(counts):
        lang, c, t, tc, segments = langid.judged(z[at : at + n], lines[at : at + n], list(range(1, n + 1)), titles[i], 0.6)
        assert lang == (langid.LANGUAGES[main[i]] if main[i] >= 0 else None) and np.isclose(c, conf[i]) and (t, tc) == (langid.LANGUAGES[t_pick[i]], t_conf[i])
        assert [(x["lang"], x["confidence"]) for x in segments] == [(langid.LANGUAGES[p], q) for p, q in zip(pick[at : at + n], line_conf[at : at + n])]
        at += n


def test_trees_of_pages_made_together():
    for kinds in ([[0, 0, 3, 1], [], [1], [1, 1, 4]], [[]], [[5]], [[], [2, 2, 0, 0, 2]]):
        tree, n = pages.Tree(), 0
        for k in kinds:
            tree.page(k, n)
            n += len(k)
        made = pages.forest(np.array(sum(kinds, []), dtype=np.int64), np.array([len(k) for k in kinds]))
        assert all(np.array_equal(x, y) for x, y in zip(tree.arrays(), made))


def test_lines_weighed_by_their_tokens():
    reader = pages.load()
    for s in ["Data, data and DATA: 12 of 2026!", "Über 300 Menschen_und mehr", "A 1a b2b 3,4 (x)", "• İstanbul – Ǆ 𝐀"]:
        kind, low, weight = reader.features(s)
        assert low == pages.squash(s) and np.isclose(weight, reader.total(pages.line_features(s, kind)))
        assert pages.capitals(s) == sum(map(str.isupper, s))


def test_one_pass_finds_what_two_find():
    lines = ["The {{name}} of null", "50 %NAME% here.", "Lorem ipsum dolor sit amet vix.", "the\tpage  could\xa0not be found", "JavaScripts run", "A description of nothing.", "", "  Sample   text here", "Elite animals"]
    for s in lines:
        assert tuple(residue.line_finds(s)) == (residue.residues(s), *residue.telling(s, hinted=False))


def test_long_lines_without_a_stop_take_linear_time():
    start = time.process_time()
    assert residue.is_short("word and " * 40_000)
    assert time.process_time() - start < 5
    six = "We look at what people need. " * 6
    assert not residue.is_short(six) and residue.is_short(six[:-29] + "- short. " * 9 + "No stop for people at the end of it")
    assert not residue.is_short("- " + "\n- ".join(["1 of what the people need!"] * 6))


def test_words_of_many_texts():
    for texts in (ODD, [*ODD, "ΟΔΟΣ και Σ"], [s for s in ODD if "🚀" not in s and "Ⓐ" not in s], ["ﬁ ǅ ½ A_b"], ["\n", ""], [""], []):
        assert neardup.words_of(texts) == [neardup._WORDS.findall(t.lower()) for t in texts]


def test_runs_and_bands_of_many_sets():
    sets = [neardup.shingles(f"we write to you about {i} and about {i} and what people need there", 3) for i in range(5)]
    assert all(np.array_equal(np.unique(s), s) for s in sets)
    together = neardup.banded(np.stack([neardup.minima(s) for s in sets]))
    assert all(np.array_equal(b, neardup.bands(s)) for b, s in zip(together, sets))
    s = sets[0]
    assert np.unpackbits(neardup.bitmap(s).view(np.uint8), bitorder="little").nonzero()[0].tolist() == sorted({int(x >> np.uint64(17)) % neardup.BITS for x in s})


def test_members_of_a_cell_all_meet(monkeypatch):
    monkeypatch.setattr(neardup, "BLOCK", 3)
    rng = np.random.default_rng(2)
    cells = {7: 1, 8: 2, 9: 3, 10: 4, 11: 8}
    pairs = rng.permutation(np.array([(c, 100 * c + i) for c, n in cells.items() for i in range(n)], dtype=np.int64))
    tasks = pd.concat(neardup.cell_tasks(pairs))
    met = []
    for _, t in tasks.groupby("cell"):
        m, side = t["class"].tolist(), t["side"].tolist()
        met += [(min(a, b), max(a, b)) for i, a in enumerate(m) for j, b in enumerate(m) if i < j and (side[i] == side[j] == 0 or {side[i], side[j]} == {1, 2})]
    assert sorted(met) == sorted((100 * c + i, 100 * c + j) for c, n in cells.items() for j in range(n) for i in range(j))


def test_cells_in_many_groups(spark, monkeypatch):
    rng = np.random.default_rng(5)
    base = [[f"w{x}" for x in rng.integers(0, 500, 40)] for _ in range(30)]
    rows = [(f"{i}-{j}", " ".join(w[: 40 - j])) for i, w in enumerate(base) for j in range(4)]
    df = spark.createDataFrame(rows, "key string, text string")
    links = lambda: sorted(tuple(r) for r in neardup.near_duplicates(df, width=3, threshold=0.6)[1].collect())
    want = links()
    monkeypatch.setattr(neardup, "GROUP", 1 << 9)
    monkeypatch.setattr(neardup, "ROWS_OUT", 7)
    assert links() == want and len(want) >= 180
