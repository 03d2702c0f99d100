import random

from postmill.operators.snapshot_diff import snapshot_changes

SCHEMA = "run_id long, dedupe_key string, title string, location string, status string, experience_level string, misses int, description_sha256 string, last_seen string, change string"


def brute(rows):
    runs = sorted({r[0] for r in rows if r[0] is not None})
    state = {}
    for r in rows:
        if r[0] is None or r[1] is None:
            continue
        k = r[1].strip().replace("http://", "https://", 1) if r[1].strip().startswith("http://") else r[1].strip()
        v = tuple((str(x) if x is not None else "").strip() for x in r[2:8])
        old = state.get((r[0], k))
        if old is None or r[8] > old[0]:
            state[(r[0], k)] = (r[8], v)
    out = set()
    for a, b in zip(runs, runs[1:]):
        before, after = ({k: v for (run, k), (_, v) in state.items() if run == x} for x in (a, b))
        out |= {(b, k, "added") for k in after.keys() - before.keys()} | {(b, k, "removed") for k in before.keys() - after.keys()}
        out |= {(b, k, "changed") for k in before.keys() & after.keys() if before[k] != after[k]}
    return out


def test_equals_brute_force(spark):
    rng = random.Random(1)
    rows = []
    for i in range(600):
        k = rng.choice([f"http://x/{rng.randrange(30)}", f" https://x/{rng.randrange(30)}\t", "", None])
        rows.append((rng.choice([3, 5, 9, 10, None]), k, rng.choice(["a", " a ", "b", None, ""]), None, "s", "", rng.choice([0, 1, None]), "h", f"2026-01-01T00:00:{i % 60:02d}+00:00" if i < 60 else f"2026-01-02T{i // 60:02d}:00:{i % 60:02d}+00:00", "clash"))
    got = [tuple(r) for r in snapshot_changes(spark.createDataFrame(rows, SCHEMA)).collect()]
    assert len(got) == len(set(got)) and set(got) == brute(rows)


def test_empty_and_single(spark):
    assert snapshot_changes(spark.createDataFrame([], SCHEMA)).count() == 0
    assert snapshot_changes(spark.createDataFrame([(1, "k", "t", None, None, None, 0, None, "", "")], SCHEMA)).count() == 0


def test_far_dates_and_ties(spark):
    """A last_seen beyond the microseconds of a shifted clock, unreadable ones, and full ties."""
    rows = [(1, "k", "old", None, None, None, 0, None, "2026-01-01T00:00:00Z", ""), (2, "k", "far", None, None, None, 0, None, "9999-12-31T23:59:59Z", ""), (2, "k", "old", None, None, None, 0, None, "never", "")]
    rows += [(r, "t", x, None, None, None, 0, None, "2026-01-01T00:00:00Z", "") for r in (1, 2) for x in ("a", "b")]
    df = spark.createDataFrame(rows, SCHEMA)
    for parts in (1, 5):
        assert [tuple(r) for r in snapshot_changes(df.repartition(parts)).collect()] == [(2, "k", "changed")]
