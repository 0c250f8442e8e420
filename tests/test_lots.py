"""Lots whose numbers are written oddly."""

from strider.operators import places


def test_numbers_as_text(spark):
    rows = [(1, "05", "40.7", "-74"), (2, "5b", " 4e1", "-.5"), (3, "06", "40", "-74"), (4, "", "40", "-74"), (5, None, "40", "-74"), (6, "1", "0", "-74"), (7, "1", "", "-74"), (8, "1", "40", None), (9, "1", "1e999", "-74"), (10, "-1", "40", "-74"), (11, "0001", "40.5 N", "74.")]
    got = places.classified_lots(spark.createDataFrame(rows, "id long, landuse string, latitude string, longitude string")).collect()
    assert sorted(map(tuple, got)) == [(1, 40.7, -74.0, 5), (2, 40.0, -0.5, 5), (11, 40.5, 74.0, 1)]


def test_flags_of_tags(spark):
    rows = [(1, None), (2, {}), (3, {"tunnel": "no", "covered": "yes"}), (4, {"tunnel": ""}), (5, {"golf": "path"}), (6, {"highway": "service", "service": "alleyway"}), (7, {"highway": "service", "foot": "private"}), (8, {"highway": "service", "indoor": "yes"})]
    df = spark.createDataFrame(rows, "id long, tags map<string, string>")
    got = {r.id: (r.tunneled, r.golf, r.cemetery_lane) for r in df.select("id", *places.way_flags(df["tags"])).collect()}
    none = (False, False, False)
    assert got == {1: none, 2: none, 3: (True, False, False), 4: (True, False, False), 5: (False, True, False), 6: (False, False, True), 7: none, 8: none}
