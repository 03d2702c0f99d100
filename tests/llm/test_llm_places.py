from itertools import product

import pytest

from postmill.llm.places import Lookup, deletes, distance, fold, map_places, repaired, towns

PLACES = [
    (1, "Grytrumfors", "Sweden", "SE", "Nordics", None),
    (2, "Kooddalbyn", "Australia", "AU", "Oceania", ["KOA"]),
    (3, "Kooddalbyn", "Ireland", "IE", "British Isles", None),
    (4, "Peñfacereceda", "Spain", "ES", "Iberia", ["PFE", "Norra Västnässjö"]),
    (5, "Wexwywick-on-Sea", "United Kingdom", "GB", "British Isles", None),
    (6, "Östra Ulvwylövik", "Sweden", "SE", "Nordics", None),
]
SCHEMA = "place_id long, name string, country string, country_code string, region string, aliases array<string>"


@pytest.mark.parametrize(
    "value,want",
    [
        ("Grytrumfors", [1]), ("GRYTRUMFORS, Sweden", [1]), ("Kooddalbyn, IE", [3]), ("AU-Kooddalbyn", [2]), ("Kooddalbyn (British Isles)", [3]), ("PFE", [4]),
        ("Norra Vastnassjo HQ", [4]), ("Oestra Ulvwyloevik", [6]), ("PeÃ±facereceda - on site", [4]), ("Wexwywick-on-Sea-Nord", [5]), ("Spain, Peñfacereceda Sub-Office", [4]),
        ("12345 Grytrumofrs", [1]), ("Hybrid; Grytrmfors or remote", [1]), ("Grytrumfors | Kooddalbyn, Ireland / Nowhereville", [1, 3, 0]), ("Remote", []), ("Kenya, Nairobia", [0]),
        ("14 Locations", []), ("", []), (None, []), ("   ", []), ("Spain", []), ("-", []), ("Remote | Worldwide", []),
    ],
)
def test_values(value, want):
    look = Lookup(PLACES + [(7, "X", "Kenya", "KE", "East Africa", None)])
    assert [t[1] for t in towns(value, look)] == want


def test_distance_against_brute_force():
    words = ["".join(w) for n in range(4) for w in product("ab", repeat=n)]

    def plain(a, b):
        d = {(i, 0): i for i in range(len(a) + 1)} | {(0, j): j for j in range(len(b) + 1)}
        for i in range(1, len(a) + 1):
            for j in range(1, len(b) + 1):
                d[i, j] = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (a[i - 1] != b[j - 1]))
                if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                    d[i, j] = min(d[i, j], d[i - 2, j - 2] + 1)
        return d[len(a), len(b)]

    for a, b in product(words, repeat=2):
        n = plain(a, b)
        assert (distance(a, b) < float("inf")) == (n <= 2)
        # Every pair within two edits meets in a common deletion.
        if n <= 2 and a and b and min(len(a), len(b)) > 2:
            assert deletes(a, 2) & deletes(b, 2)


def test_fold_and_repair():
    assert fold("Ærthdolundø") == "aerthdolundo" and fold("Ö", spelt=True) == "oe"
    assert repaired("SkÃ¦ldrupgÃ¥rd, Peñ") == "Skældrupgård, Peñ" and repaired("Ã") == "Ã"


def test_both_ways_agree(spark):
    places = spark.createDataFrame(PLACES, SCHEMA)
    rows = [("a", "Grytrumfors"), ("b", "Grytrumfors"), ("b", "Grytrumfors"), ("c", None), ("d", "Nowhereville; Kooddalbyn, IE"), (None, "PFE"), ("e", "Grytrumfors " + "x" * 5000)]
    df = spark.createDataFrame(rows, "phrase string, value string")
    whole = sorted(map(str, map_places(df, places).select("value", "phrase", "place_id").collect()))
    split = sorted(map(str, map_places(df, places, broadcast_rows=2).select("value", "phrase", "place_id").collect()))
    assert whole == split
    keyed = map_places(df.withColumnRenamed("phrase", "k"), places, keys=("k",))
    assert keyed.where("k = 'b'").count() == 2 and keyed.where("k is null").first().place_id == 4
    assert {r.place_id for r in map_places(df, places.limit(0)).collect()} == {0}
    assert map_places(df.limit(0), places).count() == 0


def test_long_names_are_reached_like_short_ones():
    name = "Saint Ethelburga by the Old Mill Stream near the Long Water Meadows"
    look = Lookup([*PLACES, (8, name, "Ireland", "IE", "British Isles", None), (9, "BONN", "Germany", "DE", "Central Europe", ["BNN"])])
    for typed in (name.replace("burga", "bura"), name.replace("Old", "Odl"), name[:-1]):
        assert [t[1] for t in towns(typed, look)] == [8]
    assert [t[1] for t in towns("Bonn", look)] == [9] and [t[1] for t in towns("bonn; BNN", look)] == [9, 9]
    assert [t[1] for t in towns("Q" * 100_000, look)] == [0]


def test_ranges_give_the_rows_of_the_broadcast(spark):
    """Repeated rows, one name in two countries within a value, codes beside names."""
    places = spark.createDataFrame([*PLACES, (7, "Pfe", "Ireland", "IE", "British Isles", None)], SCHEMA)
    rows = [("a", "Kooddalbyn, Australia; Kooddalbyn, Ireland"), ("a", "Kooddalbyn, Australia; Kooddalbyn, Ireland"), (None, "PFE"), ("b", "Grytrmfors | Grytrumfors"), ("c", None)]
    df = spark.createDataFrame(rows, "k string, value string")
    cols = ["k", "value", "phrase", "place_id", "distance"]
    whole = sorted(map(repr, map_places(df, places, keys=("k",)).select(cols).collect()))
    assert whole == sorted(map(repr, map_places(df, places, keys=("k",), broadcast_rows=2).select(cols).collect())) and len(whole) == 7
