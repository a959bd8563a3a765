"""Edge cases of the scalar functions."""

import pytest
from pyspark.sql import functions as F

from gapwise.functions import coordinates, geo, names, nulls, rules, similarity


def values(spark, data, ddl, *cols):
    return [tuple(r) for r in spark.createDataFrame(data, ddl).select(*cols).collect()]


COORDINATES = [
    (None, None, "missing"), ("", None, "missing"), ("  ", None, "missing"),
    ("7.908017", 7.908017, "clean"), ("1e1", 10.0, "clean"), (" 5 ", 5.0, "clean"),
    ("7,908,", 7.908, "comma_decimal"), (",908", 0.908, "comma_decimal"), ("+7,9", 7.9, "comma_decimal"), (",", None, "unparseable"), (",,", None, "unparseable"),
    ("7°30'.5\"N", 7.500139, "dms"), ("7°30'5\"n", None, "unparseable"), ("7 °30'5\"N", None, "unparseable"), ("7°30'5.\"W ", -7.501389, "dms"),
    ("7,908,017", 7.908017, "comma_decimal"), ("7,9", 7.9, "comma_decimal"),
    ("-7,9", None, "unparseable"), ("1,2.5", None, "unparseable"), ("190,5", None, "unparseable"),
    ("8°30'0\"N", 8.5, "dms"), ("8°30’0”S", -8.5, "dms"), ("8°30'", None, "unparseable"),
    ("7d", None, "unparseable"), ("1_0", None, "unparseable"), ("abc", None, "unparseable"),
]


def test_parse_coordinate(spark):
    got = values(spark, [(x,) for x, *_ in COORDINATES], "s string", "s", coordinates.parse_coordinate(F.col("s")).alias("p"))
    assert [(s, None if p.value is None else round(p.value, 6), p.method) for s, p in got] == COORDINATES


def test_coord_status(spark):
    data = [(2.5, 14.0), (15.01, 9.0), (None, 9.0), (9.0, None), (9.0, 3.99)]
    got = [r[0] for r in values(spark, data, "lon double, lat double", coordinates.coord_status(F.col("lon"), F.col("lat")))]
    assert got == ["included", "excluded_out_of_bounds", *["excluded_missing_or_unparseable"] * 2, "excluded_out_of_bounds"]


def test_names(spark):
    data = [("  Tivsano-North  LGA ",), ("Foo local govt area",), ("A   B",), ("LGA",), (None,)]
    assert [r[0] for r in values(spark, data, "s string", names.normalize_lga_name(F.col("s")))] == ["tivsano-north", "foo", "a b", "lga", None]
    junk = values(spark, [(" UNNAMED facility\t",), ("x",), (None,)], "s string", names.is_junk_name(F.col("s")))
    assert [r[0] for r in junk] == [True, False, False]
    rows = values(spark, [(None,), (" ",), (" Total ",), ("x",)], "s string", names.is_data_row(F.col("s")))
    assert [bool(r[0]) for r in rows] == [False, False, False, True]
    agree = values(spark, [("X LGA", "x"), ("x", "y"), (None, "x"), ("x", None)], "a string, b string", names.agrees(F.col("a"), F.col("b")))
    assert [r[0] for r in agree] == [True, False, None, False]


def test_nulls(spark):
    data = [("NA",), ("nan",), ("",), ("None",), ("Nao",), (None,)]
    assert [r[0] for r in values(spark, data, "s string", nulls.na_to_null(F.col("s")))] == [None] * 4 + ["Nao", None]
    assert values(spark, data, "s string", F.count_if(nulls.differs(F.col("s"), "Nao")), nulls.share(F.col("s") == "Nao")) == [(5, pytest.approx(1 / 6))]


@pytest.mark.parametrize(("adequate", "any_", "want"), [(60.0, 99.0, "adequately_served"), (60.1, 60.0, "facility_present_understaffed"), (60.1, 60.1, "facility_absent"), (None, 10.0, "facility_present_understaffed"), (None, None, "facility_absent")])
def test_gap_type(spark, adequate, any_, want):
    assert values(spark, [(adequate, any_)], "a double, b double", rules.gap_type(F.col("a"), F.col("b"))) == [(want,)]


def test_dose(spark):
    data = [("Yes", None, "Yes"), ("No", "Yes", "No"), (None, "Yes", "No")]
    assert [r[0] for r in values(spark, data, "s string, c string, g string", rules.dose(F.col("s"), F.col("c"), F.col("g")))] == [None, "No", "No"]


def test_adequacy(spark):
    ddl = ", ".join(f"{c} int, {m} int" for c, m in rules.CADRES) + ", known boolean"
    rest = [None, 0, None, 0, None, 0]
    data = [([None, 1, 4, 4, *rest, False], "unknown_facility_type"), ([None, 0, 4, 4, *rest, True], "no_personnel_record"), ([1, 1, None, 4, *rest, True], "adequate"), ([1, 1, 3, 4, *rest, True], "inadequate"), ([0, 0, 4, 4, *rest, True], "adequate")]
    got = [r[0] for r in values(spark, [x for x, _ in data], ddl, rules.adequacy(F.col("known"), F.col("med_officers").isNotNull()))]
    assert got == [w for _, w in data]


def test_geo(spark):
    line = "LINESTRING (0 0, 0 1, 1 1)"
    row = values(spark, [(line,)], "s string", geo.haversine_km(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(1.0)), F.size(geo.segments(geo.parse_linestring(F.col("s")))), geo.travel_minutes(F.lit(10.0), 20.0))[0]
    assert row == (pytest.approx(111.194927, abs=1e-6), 2, 30.0)


def test_similarity():
    assert round(similarity.ratio("this is a test", "this is a test!"), 2) == 96.55
    assert round(similarity.weighted_ratio("this is a test", "this is a new test!!!"), 1) == 85.5
    assert similarity.weighted_ratio("", "a") == 0.0
    assert similarity.weighted_ratio("north ward", "ward north") == 95.0
    for a, b in (("abc", "abd"), ("a b c", "c b x"), ("abcdefghij", "cde"), ("é", "e")):
        assert similarity.weighted_ratio(a, b) == similarity.weighted_ratio(b, a)
        assert 0 <= similarity.weighted_ratio(a, b) <= 100
    assert similarity.lcs("abcde", "xaxcxe") == 3


@pytest.mark.parametrize("a, b, want", [
    # published examples of the score, without and with lower case
    ("new york jets", "New York Jets", 76.92307692307692), ("new york jets", "New York Giants", 64.28571428571428), ("cowboys", "Dallas Cowboys", 83.07692307692308),
    ("new york jets", "new york jets", 100.0), ("new york jets", "new york giants", 78.57142857142857), ("cowboys", "dallas cowboys", 90.0),
    ("fuzzy wuzzy was a bear", "wuzzy fuzzy was a bear", 95.0), ("fuzzy was a bear", "fuzzy fuzzy was a bear", 95.0),
])
def test_published_scores(a, b, want):
    assert similarity.weighted_ratio(a, b) == pytest.approx(want)


def test_scores_against_sql():
    """Every pair of 70 names of up to six words with 40 choices, half of them edits: the oracle's SQL shares no code with the scorer."""
    import random

    import duckdb

    from gapwise.catalog.tables import SCORES_SQL

    rng = random.Random(5)
    words = ["north", "south", "ward", "bank", "old", "é", "river", "a", "hill", "A"]
    name = lambda: " ".join(rng.choice(words) for _ in range(rng.randrange(1, 7)))
    choices = sorted({name() for _ in range(40)})
    edited = {"".join(c for c in rng.choice(choices) if rng.random() > 0.2).strip() for _ in range(40)}
    names = sorted(({name() for _ in range(35)} | edited) - set(choices) - {""})
    con = duckdb.connect()
    con.execute("CREATE TABLE n AS SELECT unnest(?) AS name", [names])
    con.execute("CREATE TABLE c AS SELECT unnest(?) AS choice", [choices])
    got = {(a, b): s for a, b, s in con.execute(f"WITH x AS (FROM n), k AS (FROM c), {SCORES_SQL} SELECT name, choice, score FROM s").fetchall()}
    assert len(got) == len(names) * len(choices)
    assert [(p, s) for p, s in got.items() if similarity.weighted_ratio(*p) != pytest.approx(s)] == []


def test_check_digit(spark):
    def want(d):
        if not d or not d.isdigit():
            return None
        v = -sum(int(c) * (k % 6 + 2) for k, c in enumerate(reversed(d))) % 11
        return "X" if v == 10 else str(v)

    data = [str(480_000 + k) for k in range(40)] + ["0", "12345678901234567890", "", "12a", None]
    got = [r[0] for r in values(spark, [(d,) for d in data], "d string", rules.check_digit(F.col("d")))]
    assert got == [want(d) for d in data] and "X" in got
