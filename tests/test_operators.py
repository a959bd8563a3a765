"""Operators on small frames with nulls, ties and larger-than-memory forms."""

import math
import random

import pytest
from pyspark.sql import functions as F

from gapwise.functions import rules
from gapwise.operators import matching, network, overlay, survey, tables
from gapwise.plans import access, coverage
from gapwise.sources import office


def test_forward_fill_over_ranges(spark):
    rows = [(i, "s%d" % i if i % 7 == 0 else None) for i in range(200)]
    df = spark.createDataFrame(rows, "row_index long, state string").repartition(5)
    got = {r.row_index: r.state for r in tables.forward_fill(df, ["state"], "row_index").collect()}
    assert got == {i: "s%d" % (i - i % 7) for i in range(200)}


def test_forward_fill_loses_no_row(spark, tmp_path):
    n = 1_000_000
    at = F.col("id")
    wide = {f"x{k}": F.concat(F.lit("text "), at * (k + 3)) for k in range(4)}
    block = F.floor(at / 997) * 997
    rows = spark.range(n).withColumns(wide).withColumns({"row_index": at, "state": F.when(at % 997 == 0, F.concat(F.lit("s"), at)), "area": F.when(at % 500_001 == 3, at)})
    rows = rows.drop("id").repartition(23)
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    tables.forward_fill(rows, ["state", "area"], "row_index").write.parquet(f"{tmp_path}/filled")
    got = spark.read.parquet(f"{tmp_path}/filled")
    at, block = F.col("row_index"), F.floor(F.col("row_index") / 997) * 997
    good = (F.col("state") == F.concat(F.lit("s"), block)) & F.col("area").eqNullSafe(F.when(at >= 500_004, 500_004).when(at >= 3, 3))
    for k in range(4):
        good &= F.col(f"x{k}") == F.concat(F.lit("text "), at * (k + 3))
    assert tuple(got.agg(F.count("*"), F.count_distinct("row_index"), F.count_if(good)).first()) == (n, n, n)


def test_forward_fill_odd_places(spark):
    ddl = "row_index long, state string"
    got = lambda data: sorted(map(str, map(tuple, tables.forward_fill(spark.createDataFrame(data, ddl), ["state"], "row_index").collect())))
    assert got([]) == []
    assert got([(5, None)]) == ["(5, None)"]
    assert got([(None, "a"), (-3, None), (10**12, None), (7, "b")]) == sorted(["(None, 'a')", "(-3, 'a')", f"({10**12}, 'b')", "(7, 'b')"])


def test_forward_fill_with_one_far_place(spark, tmp_path):
    n = 100_000
    rows = spark.range(n + 1).select(F.when(F.col("id") == n, 10**12).otherwise(F.col("id")).alias("row_index"), F.when(F.col("id") % 997 == 0, F.concat(F.lit("s"), "id")).alias("state"))
    out = tables.forward_fill(rows, ["state"], "row_index")
    good = F.col("state") == F.concat(F.lit("s"), F.floor(F.least("row_index", F.lit(n)) / 997) * 997)
    assert tuple(out.agg(F.count("*"), F.count_if(good)).first()) == (n + 1, n + 1)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        sizes = tables.forward_fill(rows, ["state"], "row_index").groupBy(F.spark_partition_id()).count().toPandas()["count"]
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert "__range" in plan and sizes.max() < 0.8 * n  # four ranges, some of which may share a partition


def test_pick_by_rule_keeps_null_keys(spark):
    rows = [(0, "a", "x", None), (1, "a", "y", "Gazette"), (2, "b", "t", None), (3, "b", "u", None), (4, None, "q", None), (5, None, "r", None)]
    df = spark.createDataFrame(rows, "i int, k string, sen string, remarks string")
    hit = F.col("sen") == "u"
    got = sorted(r.i for r in tables.pick_by_rule(df, "k", hit, F.coalesce(F.lower("remarks").contains("gazette"), F.lit(False)), F.col("i")).collect())
    assert got == [1, 3, 4, 5]


def test_positional_join_checks_counts(spark):
    a = spark.createDataFrame([(0, "x"), (1, "y")], "row_index int, a string")
    assert tables.positional_join(a, a.withColumnRenamed("a", "b")).count() == 2
    with pytest.raises(ValueError):
        tables.positional_join(a, a.withColumnRenamed("a", "b").limit(1))


def test_update_from_keeps_unmatched(spark):
    t = spark.createDataFrame([(1, "a"), (2, "b"), (None, "c")], "k int, v string")
    s = spark.createDataFrame([(2, None), (9, "z")], "k int, v string")
    assert sorted(map(str, (tuple(r) for r in tables.update_from(t, s, "k", ["v"]).collect()))) == sorted(map(str, [(1, "a"), (2, None), (None, "c")]))


def test_fuzzy_over_blocks(spark, monkeypatch):
    monkeypatch.setattr(matching, "BLOCK", 2)
    choices = spark.createDataFrame([("alpha",), ("beta",), ("gamma",), ("delta",), (None,), ("beta",)], "c string")
    rows = spark.createDataFrame([(1, "alpha"), (2, "gamna"), (3, "zzz"), (4, None), (5, "")], "i int, n string")
    got = {r.i: (r.match_method, r.matched) for r in matching.fuzzy_best_match(rows, "n", choices, "c", 75).collect()}
    assert got == {1: ("exact", "alpha"), 2: ("fuzzy", "gamma"), 3: ("unmatched", None), 4: ("missing", None), 5: ("unmatched", None)}


def test_both_shortest_path_forms_agree(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(30), rng.randrange(30), float(rng.randrange(1, 50))) for _ in range(70)]
    e = network.both_ways(spark.createDataFrame([x for x in edges if x[0] != x[1]], "a long, b long, weight double"))
    s = spark.createDataFrame([(0,), (5,), (99,)], "source long")
    read = lambda df: {(r.source, r.node): round(r.cost, 9) for r in df.collect()}
    assert read(network.shortest_paths(s, e)) == read(network.relaxed_paths(s, e))


def test_least_ways_forms_agree(spark):
    rng = random.Random(5)
    edges = [(rng.randrange(40), rng.randrange(40), float(rng.randrange(1, 9))) for _ in range(60)]
    e = network.both_ways(spark.createDataFrame([x for x in edges if x[0] != x[1]], "a long, b long, weight double"))
    starts = [(g, rng.randrange(45), float(rng.randrange(4)), f"t{k}") for g in ("p", "q") for k in range(6)]
    s = spark.createDataFrame(starts, "grp string, node long, off double, target string")
    want = {}
    for r in network.relaxed_paths(spark.createDataFrame(sorted({(x[1],) for x in starts}), "source long"), e).collect():
        for g, n, off, t in starts:
            if n == r.source:
                want[g, r.node] = min(want.get((g, r.node), (1e9, "")), (off + r.cost, t))
    read = lambda df: {(r.grp, r.node): (r.way, r.target) for r in df.collect()}
    assert read(network.least_ways(s, e)) == want
    assert read(overlay.least_ways(s, e, at_once=1)) == want


def test_nearest_node_by_cells(spark, monkeypatch):
    rng = random.Random(2)
    nodes = [(k, round(rng.uniform(2, 9), 3), round(rng.uniform(4, 13), 3)) for k in range(300)] + [(300, 179.9, 5.0), (301, 3.0, 5.0), (302, 3.0, 5.0)]
    points = [(k, round(rng.uniform(1, 11), 3), round(rng.uniform(3, 15), 3)) for k in range(200)] + [(200, -179.9, 5.0), (201, 100.0, -60.0), (202, None, 5.0), (203, 3.0, 5.0), (204, 0.0, 89.9)]
    n, p = spark.createDataFrame(nodes, "node_id long, lon double, lat double"), spark.createDataFrame(points, "i long, lon double, lat double")
    read = lambda: {r.i: (r.node_id, r.node_km and round(r.node_km, 9)) for r in network.nearest_node(p, "lon", "lat", n).collect()}

    def km(a, b, c, d):
        a, b, c, d = map(math.radians, (a, b, c, d))
        return 2 * 6371.0 * math.asin(math.sqrt(math.sin((d - b) / 2) ** 2 + math.cos(b) * math.cos(d) * math.sin((c - a) / 2) ** 2))

    want = {i: (None, None) if x is None else min((km(x, y, a, b), k) for k, a, b in nodes)[::-1] for i, x, y in points}
    got = read()
    assert got[203] == (301, 0.0) and got[200][0] == 300 and got[202] == (None, None)
    assert {i: v[0] for i, v in got.items()} == {i: v[0] for i, v in want.items()}
    assert all(v[1] == pytest.approx(want[i][1], abs=1e-6) for i, v in got.items() if v[1] is not None)
    monkeypatch.setattr(network, "BLOCK", 50)
    assert read() == got
    none = network.nearest_node(p, "lon", "lat", n.limit(0))
    assert none.columns == ["i", "lon", "lat", "node_id", "node_km"] and none.where("node_id is null and node_km is null").count() == len(points)


def test_quantiles(spark, monkeypatch):
    import numpy as np

    from gapwise.operators import describe

    monkeypatch.setattr(describe, "AT_HAND", 30)
    monkeypatch.setattr(describe, "ERROR", 0.01)
    rng = np.random.default_rng(3)
    for v in ([], [4.0], [2.0] * 500, rng.normal(0, 1, 900).tolist(), (10.0 ** rng.uniform(-300, 300, 800)).tolist(), rng.integers(0, 5, 700).astype(float).tolist() + [1e308, -1e308]):
        rows = spark.createDataFrame([(x,) for x in [*v, None, float("nan")]], "x double")
        want = np.quantile(v, [0.05, 0.25, 0.5, 1.0]).tolist() if v else [None] * 4
        got = describe.quantiles(rows, "x", [0.05, 0.25, 0.5, 1.0])
        assert got == want or got == pytest.approx(want, rel=1e-12)


def test_last_norm_of_a_type_counts(spark):
    minima = [m for _, m in rules.CADRES]
    norms = spark.createDataFrame([("Post", 1, 5, 0, 0, 0, 0), ("Post", 2, 0, 2, 0, 0, 0)], "facility_type string, row_index int, " + ", ".join(f"{m} int" for m in minima)).repartition(3)
    facilities = spark.createDataFrame([("F", "Post")], "facility_id string, facility_type string")
    staff = spark.createDataFrame([("F", 0, 2, 0, 0, 0)], "facility_id string, " + ", ".join(f"{c} int" for c, _ in rules.CADRES))
    r = access.classify_adequacy(facilities, staff, norms).first()
    assert [r[m] for m in minima] == [0, 2, 0, 0, 0] and r.adequacy_status == "adequate"


def test_last_parallel_road_counts(spark):
    p = [(1.0, 1.0), (2.0, 1.0)]
    lines = spark.createDataFrame([(0, 10.0, p), (1, 20.0, p[::-1])], "line long, speed double, points array<struct<x: double, y: double>>")
    g = network.road_graph(network.road_segments(lines, "points", "speed", "line")).collect()
    assert len(g) == 1 and g[0].weight == pytest.approx(g[0].dist_km / 20 * 60)


def test_single_cluster_strata_add_nothing(spark):
    rows = [("s1", "c1", 1, 2.0), ("s1", "c1", 0, 2.0), ("s2", "c2", 1, 1.0), ("s2", "c3", 0, 3.0), ("s2", "c3", 1, None)]
    got = {r.domain: r for r in survey.ratio_estimates(spark.createDataFrame(rows, "s string, c string, y int, w double"), "y", "w", "s", "c").collect()}
    assert got["s1"].se == 0.0 and got["s1"].coverage == 0.5 and got["s1"].n == 2
    assert got["s2"].n == 3 and got["s2"].coverage == 0.25
    assert got["ALL"].n == 5


def test_access_plan(spark):
    sheet = spark.createDataFrame([(1, "S", "Foo LGA", "North", "3", "L1", None), (2, None, "Bar", None, "2", "L2", None), (3, None, "TOTAL", None, None, None, None)], "i long, a string, b string, c string, d string, e string, f string")
    walk = access.build_crosswalk(sheet)
    assert {(r.lga_code, r.state, r.senatorial_district) for r in walk.collect()} == {("L1", "S", "North"), ("L2", "S", "North")}
    register = spark.createDataFrame([("F1", "Clinic", "foo", "North", "7,5", "8.0"), ("F2", "unnamed facility", "foo", None, "7.5", "8.0"), ("F3", "Post", "Barr", "South", "NA", "8.0")], "facility_id string, facility_name string, lga_name string, sen_district string, longitude string, latitude string")
    clean, log = access.clean_register(register, walk)
    got = {r.facility_id: (r.longitude_clean, r.coord_status, r.matched_lga_code, r.sen_district_agrees) for r in clean.collect()}
    assert got == {"F1": (7.5, "included", "L1", True), "F3": (None, "excluded_missing_or_unparseable", "L2", False)}
    assert {r.facility_id: (r.lon_parse_method, r.lga_match_method) for r in log.collect()} == {"F1": ("comma_decimal", "exact"), "F3": ("missing", "fuzzy")}
    roads = spark.createDataFrame([(0, 60.0, [(7.0, 8.0), (7.5, 8.0), (8.0, 8.0)])], "line long, speed double, points array<struct<x: double, y: double>>")
    wards = spark.createDataFrame([("W1", 7.5, 8.0, 10), ("W2", 7.0, 8.0, 20)], "ward_code string, lon double, lat double, total_population int")
    facilities = spark.createDataFrame([("F1", 7.5, 8.0, "adequate"), ("F9", 7.0, 8.0, "inadequate")], "facility_id string, lon double, lat double, adequacy_status string")
    gaps = access.classify_gaps(wards, facilities, roads, threshold=30.0)
    assert {r.ward_code: (r.gap_type, r.nearest_any_facility_id) for r in gaps.collect()} == {"W1": ("adequately_served", "F1"), "W2": ("facility_present_understaffed", "F9")}
    assert [r.severity_rank for r in access.most_severe(gaps).collect()] == [1]
    assert {r.gap_type: (r.n_wards, r.people, r.median_min) for r in access.summary(gaps).collect()} == {"adequately_served": (1, 10, 0.0), "facility_present_understaffed": (1, 20, gaps.where("ward_code = 'W2'").first().travel_time_to_adequate_min)}


def test_coverage_plan(spark):
    hh = [("H1", "C1", "S", "I1", "Completed", 20, 10, 100), ("H1", "C1", "S", "I1", "Completed", 20, 10, 100), ("H2", "C1", "S", "I1", "Refused", 3, 10, 100), ("H3", "C2", "S", "I2", "Completed", 22, 10, 50)]
    h = spark.createDataFrame(hh, "household_id string, cluster_id string, stratum_code string, interviewer_id string, result_of_visit string, interview_duration_min int, stage2_households_selected int, stage2_households_listed int")
    ch = [("K1", "H1", "C1", "S", "Yes", "Yes", "No"), ("K2", "H3", "C2", "S", "No", None, "No"), ("K3", "H3", "C2", "S", "Yes", None, "Yes"), ("K4", "HX", "C2", "S", "No", None, "Yes")]
    c = spark.createDataFrame(ch, "child_id string, household_id string, cluster_id string, stratum_code string, vaccination_card_seen string, dose_recorded_on_card string, dose_reported_by_caregiver string")
    f = spark.createDataFrame([("C1", 1, 0.1), ("C2", 1, 0.2), ("C3", 0, 0.3)], "cluster_id string, selected int, stage1_selection_probability double")
    got = {r.domain: r for r in coverage.coverage(h, c, f).collect()}
    w1, w2 = 1 / (0.1 * 0.1) * 2, 1 / (0.2 * 0.2)
    assert got["ALL"].n == 2 and got["ALL"].coverage == pytest.approx(w1 / (w1 + w2))
    assert [r.child_id for r in coverage.weighted_children(h, c, f)[1].collect()] == ["K4"]
    log = spark.createDataFrame([("I1", 10, 8, 20.0, "Yes", None), ("I1", 0, 0, 10.0, None, "Yes")], "interviewer_id string, households_attempted int, households_completed int, mean_interview_duration_min double, supervisor_spot_check string, gps_verified string")
    checks = coverage.interviewer_checks(h, c, log)
    assert checks["fieldwork"].first().asDict() == {"interviewer_id": "I1", "days": 2, "mean_completion_rate": 0.8, "mean_duration": 15.0, "pct_spot_checked": 50.0, "pct_gps_verified": 50.0}
    assert {r.interviewer_id: r.n for r in checks["zscores"].collect()} == {"I1": 1, "I2": 2}
    assert {r.interviewer_id: r.pct_missing for r in checks["missingness"].collect()} == {"I1": 0.0, "I2": 50.0}
    assert checks["durations"].where("interviewer_id = 'I1'").first().n == 2


def test_wkb_shapes():
    import struct

    ring = [(0.0, 0.0), (1.0, 0.0), (1.0, 1.0), (0.0, 0.0)]
    polygon = struct.pack("<BIII", 1, 3, 1, len(ring)) + b"".join(struct.pack("<dd", *p) for p in ring)
    many = struct.pack(">BII", 0, 6, 2) + polygon * 2
    assert office.rings_of(polygon) == [ring] and office.rings_of(many) == [ring, ring]
    assert office.rings_of(office.wkb_of(office.gpkg_blob(office.point_wkb(1.5, 2.5)))) == [[(1.5, 2.5)]]


def test_wkb_z_and_m():
    import struct

    for code in (1001, 2001, 0x80000001, 0x40000001):
        assert office.rings_of(struct.pack("<BIddd", 1, code, 1.0, 2.0, 9.0)) == [[(1.0, 2.0)]]
    line = struct.pack("<BIIdddddddd", 1, 3002, 2, 1.0, 2.0, 8.0, 9.0, 3.0, 4.0, 8.0, 9.0)
    assert office.rings_of(line) == [[(1.0, 2.0), (3.0, 4.0)]]
    assert office.rings_of(struct.pack("<BIIdddddddd", 1, 0xC0000002, 2, 1.0, 2.0, 8.0, 9.0, 3.0, 4.0, 8.0, 9.0)) == [[(1.0, 2.0), (3.0, 4.0)]]


def test_centroid_with_a_hole_and_a_second_part(spark):
    from gapwise.functions import geo

    square = lambda x, y, n: [(x, y), (x + n, y), (x + n, y + n), (x, y + n), (x, y)]
    rings = [square(0.0, 0.0, 4.0), square(0.0, 0.0, 2.0)[::-1], square(10.0, 0.0, 2.0)]
    df = spark.createDataFrame([(rings,)], "r array<array<struct<x: double, y: double>>>")
    c = df.select(geo.area_centroid(F.col("r")).alias("c")).first().c
    assert (c.x, c.y, c.area2) == (pytest.approx((16 * 2 - 4 * 1 + 4 * 11) / 16), pytest.approx((16 * 2 - 4 + 4) / 16), 32.0)


def test_fuzzy_against_all_pairs(spark):
    from gapwise.functions.similarity import weighted_ratio

    rng = random.Random(7)
    words = ["north", "south", "ward", "bank", "old", "new", "river", "a", "hill top"]
    name = lambda: " ".join(rng.choice(words) for _ in range(rng.randrange(1, 6)))
    edit = lambda x: "".join(c for c in x if rng.random() > 0.15) or "x"
    choices = sorted({name() for _ in range(60)})
    names = sorted({edit(name()) for _ in range(80)} | {"", "zzz"})
    got = matching.fuzzy_best_match(spark.createDataFrame([(n,) for n in names], "n string"), "n", spark.createDataFrame([(c,) for c in choices], "c string"), "c").collect()
    for r in got:
        score, best = min((-weighted_ratio(r.n, c), c) for c in choices)
        if r.n not in choices:
            assert r.match_score == pytest.approx(-score) and r.matched == (best if -score >= 85 else None), r


def test_shared_folder_is_the_one_that_spark_has(spark):
    from gapwise.shared import cut, shared_folder

    at = shared_folder(spark)
    assert at == spark.sparkContext.getCheckpointDir() == shared_folder(spark)
    assert cut(spark.range(3)).count() == 3


def test_names_are_scored_with_a_block_of_choices_at_once(monkeypatch):
    from gapwise.functions.similarity import weighted_ratio

    rng = random.Random(5)
    words = ["north", "south", "ward", "é", "hill top", "x" * 30, "y" * 70]
    name = lambda: rng.choice([" ", "  "]).join(rng.choice(words) for _ in range(rng.randrange(6)))
    edit = lambda x: "".join(c for c in x if rng.random() > 0.15)
    choices = sorted({name() for _ in range(60)} | {"", " ", "b"})
    held = matching.Choices(choices)
    for x in {edit(name()) for _ in range(80)} - {""} | {" ", "z" * 65}:
        score, best = min((-weighted_ratio(x, c), c) for c in choices)
        assert held.best(x) == (-score, best), x
    monkeypatch.setattr(matching, "weighted_ratio", None)  # no pair of these is scored by itself
    numbered = [f"Supplier#{k:09d}" for k in range(300)]
    for x in ["no such place 771000000#reilppuS", "supplier#000000005", "Suplier#000000123"]:
        score, best = min((-weighted_ratio(x, c), c) for c in numbered)
        assert matching.Choices(numbered).best(x) == (-score, best)


def test_states_of_a_search_do_not_follow_the_number_of_choices(monkeypatch):
    """Choices with the same beginnings and ends share the search of a name; none is scored by itself."""
    import numpy as np

    from gapwise.functions.similarity import weighted_ratio
    from gapwise.operators import letters

    names = ["no such place 771000000#reilppuS", "supplier#000000005", "Suplier#000000123"]
    small = [f"Supplier#{k:09d}" for k in range(400)]
    assert matching.Choices(small).best_of(names) == [(-s, c) for s, c in (min((-weighted_ratio(x, c), c) for c in small) for x in names)]
    monkeypatch.setattr(matching, "weighted_ratio", None)
    monkeypatch.setattr(matching, "Texts", None)
    states, count = [0], np.bitwise_count
    monkeypatch.setattr(letters.np, "bitwise_count", lambda x: states.__setitem__(0, states[0] + np.size(x)) or count(x))

    def taken(n):
        states[0], held = 0, matching.Choices([f"Supplier#{k:09d}" for k in range(n)])
        return held.best_of(names) and states[0]

    assert taken(50_000) < 4 * taken(1_000)


def test_names_of_many_kinds_against_all_pairs(monkeypatch):
    from gapwise.functions.similarity import weighted_ratio
    from gapwise.operators import letters

    for seed in range(40):
        rng = random.Random(seed)
        monkeypatch.setattr(letters.Letters, "MOST", rng.choice([3, 50, 1 << 18]))
        some = rng.choice(["ab", "abc ", "0123456789", "éß😀 x"])
        word = lambda most: "".join(rng.choice(some) for _ in range(rng.randrange(most)))
        words = [word(7) or "w" for _ in range(8)]
        name = lambda: rng.choice([word(rng.choice([4, 12, 70])), " ".join(rng.choice(words) for _ in range(rng.randrange(1, 5)))])
        choices = sorted({name() for _ in range(rng.choice([1, 5, 40]))})
        names = sorted({name() for _ in range(8)} | {"".join(c for c in rng.choice(choices) if rng.random() > 0.15) for _ in range(8)} | {"no such place " + rng.choice(choices)[::-1]})
        want = [min((-weighted_ratio(x, c), c) for c in choices) for x in names]
        assert matching.Choices(choices).best_of(names) == [(-s, c) for s, c in want], seed
