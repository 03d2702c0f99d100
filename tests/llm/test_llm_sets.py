import itertools
import random
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from postmill.llm import neardup
from postmill.llm.mixing import mix
from postmill.llm.neardup import SignatureTree, bitmap, dual, expanded, near_duplicates, shingles
from postmill.llm.packing import best_fit, completions, fill_containers, least_containers, pack, report
from postmill.llm.tokens import sized


def texts(n=60, seed=3):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(300)]
    out = []
    for i in range(n):
        w = [rng.choice(vocab) for _ in range(rng.randrange(20, 80))]
        out.append(" ".join(w))
        for _ in range(rng.randrange(3)):
            v = list(w)
            for _ in range(rng.randrange(1, 6)):
                v[rng.randrange(len(v))] = rng.choice(vocab)
            out.append(" ".join(v))
    return out + out[:5]


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 0.0


def test_links_equal_brute_force(spark):
    rows = [(f"k{i:03d}", t, "c") for i, t in enumerate(texts())] + [("n", None, "c"), (None, "", "c"), ("s", "one two", "c")]
    df = spark.createDataFrame(rows, "key string, text string, class string")
    members, links = near_duplicates(df, width=3, threshold=0.6)
    got = {(r.key_a, r.key_b) for r in expanded(members, links).collect()}
    sets = {k: set(zip(*(t.split()[i:] for i in range(3)))) for k, t, _ in rows if t}
    want = {(a, b) for a, b in itertools.combinations(sorted(k for k in sets if k), 2) if jaccard(sets[a], sets[b]) >= 0.6}
    assert got == want and len(want) > 20
    assert members.count() == len(rows) and members.where("class is null").count() == 3
    m, l = near_duplicates(df.limit(0))
    assert m.count() == 0 and l.count() == 0


def test_large_cells_go_block_by_block(spark, monkeypatch):
    monkeypatch.setattr(neardup, "BLOCK", 4)
    base = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(30):
        v = list(base)
        v[i] = f"x{i}"
        rows.append((f"k{i:02d}", " ".join(v)))
    members, links = near_duplicates(spark.createDataFrame(rows, "key string, text string"), width=3, threshold=0.6)
    assert expanded(members, links).count() == 30 * 29 // 2


def test_dual_traversal_loses_nothing():
    sets = [shingles(t, 3) for t in texts(40, 9)]
    maps, sizes = np.stack([bitmap(s) for s in sets]), np.array([len(s) for s in sets])
    t = SignatureTree(maps, sizes)
    i, j = dual(t, t, 0.6)
    kept = {tuple(sorted(p)) for p in zip(i.tolist(), j.tolist())}
    for a, b in itertools.combinations(range(len(sets)), 2):
        if jaccard(set(sets[a].tolist()), set(sets[b].tolist())) >= 0.6:
            assert (a, b) in kept
    half = SignatureTree(maps[:20], sizes[:20]), SignatureTree(maps[20:], sizes[20:])
    x, y = dual(*half, 0.6)
    assert {(a, b) for a, b in kept if a < 20 <= b} <= set(zip(x.tolist(), (y + 20).tolist()))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 40), max_size=25), st.integers(40, 60))
def test_packing_is_whole_and_tight(sizes, capacity):
    bins = pack(sizes, capacity)
    assert sorted(i for b in bins for i in b) == list(range(len(sizes)))
    assert all(sum(sizes[i] for i in b) <= capacity for b in bins)
    assert len(bins) <= least_containers(sizes, capacity) * 1.25 + 1


def test_completion_beats_best_fit():
    sizes = [6, 6, 5, 5, 5, 4, 4, 4, 3, 3, 3, 3, 9]
    assert len(pack(sizes, 12)) == 5 == -(-sum(sizes) // 12)


def test_containers(spark):
    rng = random.Random(2)
    rows = [(i, rng.randrange(0, 90)) for i in range(500)] + [(900, 250), (901, 100), (None, 7), (902, None), (903, 0), (900, 250)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, n_tokens long, container long")
    out = fill_containers(df, 100, group=120)
    got = out.collect()
    by = {}
    for r in got:
        by.setdefault(r.container, []).append(r)
    assert all(sum(x.n_tokens for x in v) == v[0].filled <= 100 for v in by.values())
    assert sorted(r.piece for r in got if r.doc_id == 900) == [0, 0, 1, 1, 2, 2] and sum(r.n_tokens for r in got) == sum(n or 0 for _, n in rows)
    # Packing by groups costs little against best fit over everything at once.
    assert report(out, 100).first().containers <= 1.02 * len(best_fit([r.n_tokens for r in got], 100))
    assert fill_containers(df.limit(0), 100).count() == 0


def test_mix_reaches_targets(spark):
    rng = random.Random(4)
    rows = [(i, "big" if i % 3 else "small", rng.randrange(1, 60)) for i in range(3000)] + [(9001, None, 5), (9002, "big", 0), (9003, "tiny", 40)]
    docs = spark.createDataFrame([(*r, "m") for r in rows], "doc_id long, source string, n_tokens long, mix string")
    t = [("even", "big", 0.5, 1), ("even", "small", 0.5, 2), ("gone", "big", 0.5, 1), ("gone", "absent", 0.5, 3), ("none", "absent", 1.0, 1), ("nulls", "big", None, None)]
    targets = spark.createDataFrame(t, "mix string, source string, target_share double, max_repeats int")
    sel, shares = mix(docs, targets)
    got = sel.collect()
    cap = {(m, s): r for m, s, _, r in t}
    assert all(1 <= r.uses <= cap[(r.mix, r.source)] for r in got) and len({(r.mix, r.doc_id) for r in got}) == len(got)
    s = {(r.mix, r.source): r for r in shares.collect()}
    assert abs(s[("even", "big")].actual_share - 0.5) < 0.01 and s[("gone", "big")].actual_share == 1.0 and s[("none", "absent")].actual_share is None
    want = {}
    for r in got:
        want[(r.mix, r.source)] = want.get((r.mix, r.source), 0) + r.uses * r.n_tokens
    assert all(s[k].tokens == v for k, v in want.items())
    assert mix(docs.limit(0), targets)[0].count() == 0 and mix(docs, targets.limit(0))[1].count() == 0


def test_token_counts(spark):
    df = spark.createDataFrame([(1, "Hello there, you.", 5), (2, None, 5), (3, "", 5)], "doc_id long, text string, n_tokens int")
    assert {r.doc_id: r.n_tokens for r in sized(df).collect()} == {1: 5, 2: 0, 3: 0}


def test_thresholds_that_bands_do_not_hold_are_refused(spark):
    df = spark.createDataFrame([("a", "one two three four")], "key string, text string")
    for t in (0.59, 0.4, 0.0, float("nan")):
        with pytest.raises(ValueError):
            near_duplicates(df, threshold=t)
    assert (1 - neardup.LEAST**neardup.ROWS) ** neardup.BANDS < 5e-4


def test_long_documents_are_sampled_in_proportion(spark):
    """A source of long and short documents gives both as it has them; only the tail of a budget goes to those that fit."""
    rng = random.Random(7)
    rows = [(i, "a", 400 if rng.random() < 0.2 else 40) for i in range(4000)] + [(10_000 + i, "b", 50) for i in range(2000)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, n_tokens long")
    targets = spark.createDataFrame([("m", "a", 0.1, 1), ("m", "b", 0.9, 1)], "mix string, source string, target_share double, max_repeats int")
    sel, shares = mix(docs, targets)
    got = [r.n_tokens for r in sel.where("source = 'a'").collect()]
    # A document of 400 is a twenty-eighth of the budget of about 11,100 tokens.
    assert 0.1 < sum(n == 400 for n in got) / len(got) < 0.3
    assert abs({r.source: r.actual_share for r in shares.collect()}["a"] - 0.1) < 0.002
    one = spark.createDataFrame([(1, "a", 900), (2, "b", 1000)], "doc_id long, source string, n_tokens long")
    assert mix(one, targets, total=1000)[0].count() == 0 and {r.doc_id for r in mix(one, targets, total=1112)[0].collect()} == {2}


def fewest_containers(sizes, capacity):
    """By trying every container for every item."""
    best = len(sizes)

    def put(i, room):
        nonlocal best
        if len(room) >= best:
            return
        if i == len(sizes):
            best = len(room)
            return
        for j in {r: j for j, r in enumerate(room) if r >= sizes[i]}.values():
            put(i + 1, [*room[:j], room[j] - sizes[i], *room[j + 1 :]])
        put(i + 1, [*room, capacity - sizes[i]])

    put(0, [])
    return best


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(1, 30), min_size=1, max_size=9), st.integers(30, 45))
def test_packing_is_best_on_small_groups(sizes, capacity):
    sizes = sorted(sizes, reverse=True)
    want = fewest_containers(sizes, capacity)
    assert least_containers(sizes, capacity) <= want == len(pack(sizes, capacity))


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(1, 60), min_size=1, max_size=60), st.integers(1, 200))
def test_fullest_filling_is_among_the_completions(sizes, space):
    reached = {0}
    for s in sizes:
        reached |= {r + s for r in reached if r + s <= space}
    got = completions(sorted(set(sizes)), Counter(sizes), space)
    assert sum(got[0]) == max(reached) and all(not Counter(f) - Counter(sizes) for f in got)


def test_search_goes_on_and_beats_best_fit():
    """Sizes near a third of the capacity, where best fit leaves room."""
    rng, gains = random.Random(11), 0
    for _ in range(20):
        sizes = [rng.randrange(250, 420) for _ in range(60)]
        gains += len(best_fit(sizes, 1000)) - len(pack(sizes, 1000))
    assert gains >= 10


def test_rows_without_a_key_spread_over_groups(spark):
    df = spark.range(4000).select(F.lit(None).cast("long").alias("doc_id"), (F.col("id") % 90 + 1).alias("n_tokens"))
    out = fill_containers(df, 100, group=100)
    # The group is in the number of a container, so one group would give numbers of one range.
    groups = out.select(F.shiftright("container", 24).alias("g")).distinct().count()
    assert groups >= 40 and out.count() == 4000 and report(out, 100).first().unused < 0.03
