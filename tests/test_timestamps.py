import random
from itertools import product

import pytest

from postmill.operators.timestamps import CONTRARY, Reading, block_matrix, interpretations, normalise, readings, step_cost, viterbi

CASES = [
    ("2025-08-17T10:31:25.301Z", "Europe/Paris", "DMY", "2025-08-17T10:31:25.301Z"),
    ("2025-01-25T10:25:00.585719814Z", None, None, "2025-01-25T10:25:00.585Z"),
    ("  2026-11-06t05:06:13z ", "Europe/Paris", "DMY", "2026-11-06T05:06:13.000Z"),
    ("20260210T120000Z", "Europe/Paris", "DMY", "2026-02-10T12:00:00.000Z"),
    ("1749013960066", None, None, "2025-06-04T05:12:40.066Z"),
    ("1769722677", None, None, "2026-01-29T21:37:57.000Z"),
    ("17/04/2026 03:52", "Europe/Berlin", "DMY", "2026-04-17T01:52:00.000Z"),
    ("10/30/24 09:15", "America/New_York", "MDY", "2024-10-30T13:15:00.000Z"),
    ("16.01.2026 18:49", "America/New_York", "MDY", "2026-01-16T23:49:00.000Z"),
    ("26.10.2025 02:42", "Europe/Berlin", "DMY", "unresolved"),
    ("30.03.2025 02:42", "Europe/Berlin", "DMY", "unresolved"),
    ("31/02/2025", "Europe/Berlin", "DMY", "unresolved"),
    ("23/05/2025", "America/New_York", "MDY", "unresolved"),
    ("2026-06-18T25:10:00Z", None, None, "unresolved"),
    ("2025-11-02 01:30:00 EST", "America/New_York", "MDY", "2025-11-02T06:30:00.000Z"),
    ("2026-04-08 04:02:54 IST", "Asia/Kolkata", "DMY", "2026-04-07T22:32:54.000Z"),
    ("2026-05-25 06:49 UTC-7", "America/Los_Angeles", "MDY", "2026-05-25T13:49:00.000Z"),
    ("2025-08-11T03:49:14+02:00[Europe/Berlin]", "Europe/Berlin", "DMY", "2025-08-11T01:49:14.000Z"),
    ("29 mars 2026 à 04h07", "Europe/Paris", "DMY", "2026-03-29T02:07:00.000Z"),
    ("27. Oktober 2024, 12:12 Uhr", "Europe/Berlin", "DMY", "2024-10-27T11:12:00.000Z"),
    ("30 de marzo de 2025, 05:11", "Europe/Madrid", "DMY", "2025-03-30T03:11:00.000Z"),
    ("26 oktober 2025 kl. 05.34", "Europe/Stockholm", "DMY", "2025-10-26T04:34:00.000Z"),
    ("Tue, 28 Oct 2025 11:26:40 +0100", None, None, "2025-10-28T10:26:40.000Z"),
    ("Oct 26, 2025 5:57 AM CET", "Europe/Berlin", "DMY", "2025-10-26T04:57:00.000Z"),
    ("20260510", None, None, "2026-05-10"),
    ("Posted Feb 28, 2025", None, None, "2025-02-28"),
    ("POSTED 2 WEEKS AGO", "Europe/Stockholm", "DMY", "2026-04-17"),
    ("Posted Yesterday", "Europe/Stockholm", "DMY", "2026-04-30"),
    ("1 hour ago", "Europe/Stockholm", "DMY", "2026-05-01"),
    ("2h ago", "Europe/Stockholm", "DMY", "2026-04-30"),
    ("Posted 30+ Days Ago", "Europe/Stockholm", "DMY", "unresolved"),
    ("ongoing", "Europe/Stockholm", "DMY", "unresolved"),
]
FETCHED = "2026-04-30T23:43:25+00:00"


@pytest.mark.parametrize("value,zone,order,want", CASES)
def test_one_value(value, zone, order, want):
    r = readings(value, FETCHED, zone, order)
    assert (r[0].norm if len(r) == 1 else "unresolved") == want


def test_viterbi_equals_brute_force_also_in_blocks():
    rng = random.Random(5)
    for _ in range(50):
        seq = [[Reading(rng.choice("ab"), "", rng.randrange(5)) for _ in range(rng.randrange(1, 3))] for _ in range(7)]

        def cost(path):
            p = [s[i] for s, i in zip(seq, path)]
            return sum(map(step_cost, p, p[1:]))

        best = min(map(cost, product(*(range(len(s)) for s in seq))))
        assert cost(viterbi(seq)) == best
        m = block_matrix(seq)
        assert min(map(min, m)) == best


def test_normalise_defined_results(spark):
    boards = spark.createDataFrame([("b", "Europe/Berlin", None)], "board string, time_zone string, date_order string")
    rows = [("t", "b", i, v, FETCHED, "extra") for i, v in enumerate(["03/04/2025", "25/04/2025", "26/04/2025", None, " ", "?", "26.10.2025 02:42", "x" * 100000])]
    rows += [("t", None, 20, "2025-01-01", None, "e"), ("t", "b", 1, "25/04/2025", FETCHED, "again"), ("t", "unknown", 5, "01.01.2025 10:00", FETCHED, "e")]
    df = spark.createDataFrame(rows, "tbl string, board string, row_id long, value string, fetched_at string, time_zone string")
    for block in (2, 1000):
        out = normalise(df, boards, block=block).collect()
        got = {(r.board, r.row_id): r.norm for r in out}
        # Without a known order the path keeps to the form that the other values fix.
        assert got[("b", 0)] == "2025-04-03" and got[("b", 1)] == "2025-04-25"
        assert ("b", 3) not in got and ("b", 4) not in got
        assert got[("b", 5)] == got[("b", 6)] == got[("b", 7)] == "unresolved"
        assert got[(None, 20)] == "2025-01-01" and got[("unknown", 5)] == "unresolved"
        assert sum(r.row_id == 1 for r in out) == 2
    assert normalise(df.limit(0), boards).count() == 0


@pytest.mark.parametrize(
    "value,want",
    [
        ("1749013960066123", "2025-06-04T05:12:40.066Z"), ("1749013960066123456", "2025-06-04T05:12:40.066Z"), ("20260210120000", "2026-02-10T11:00:00.000Z"),
        ("2016-12-31T23:59:60Z", "2017-01-01T00:00:00.000Z"), ("2017-01-01T00:59:60+01:00", "2017-01-01T00:00:00.000Z"), ("2016-12-31T22:59:60Z", "unresolved"),
        ("2026-W05-3", "2026-01-28"), ("2026W053", "2026-01-28"), ("2026-W54-1", "unresolved"), ("2026-W05", "unresolved"),
    ],
)
def test_rarer_forms(value, want):
    r = readings(value, FETCHED, "Europe/Berlin", "DMY")
    assert (r[0].norm if len(r) == 1 else "unresolved") == want


def test_the_path_decides_the_order(spark):
    """One board known to put the month first, one unknown: the same values, read both ways."""
    assert {(r.norm, r.cost) for r in interpretations("03/04/2025", FETCHED, "Europe/Berlin", "MDY")} == {("2025-03-04", 0.0), ("2025-04-03", CONTRARY)}
    boards = spark.createDataFrame([("known", "Europe/Berlin", "MDY"), ("day", "Europe/Berlin", None), ("month", "Europe/Berlin", None)], "board string, time_zone string, date_order string")
    values = {"known": ["03/04/2025", "25/04/2025"], "day": ["24/03/2025", "03/04/2025", "25/04/2025"], "month": ["03/24/2025", "04/03/2025", "04/25/2025"]}
    rows = [("t", b, i, v, FETCHED) for b, vs in values.items() for i, v in enumerate(vs)] + [("t", "day", None, "03/04/2025", FETCHED)] * 3
    out = normalise(spark.createDataFrame(rows, "tbl string, board string, row_id long, value string, fetched_at string"), boards, block=2).collect()
    got = {(r.board, r.row_id): r.norm for r in out}
    assert got[("known", 0)] == "2025-03-04" and got[("known", 1)] == "unresolved"
    assert got[("day", 1)] == got[("month", 1)] == "2025-04-03" and len(out) == len(rows)
