"""Location parsing and location rules."""

import pytest
from pyspark.sql import functions as F

from postflow.functions.places_data import DEFAULT_GAZETTEER
from postflow.operators import places
from postflow.operators.places import LocationRule

# (text, ISO code, workplace type, remote flag, hints) -> (regions, region, work mode)
GOLDENS = [
    (("San Francisco, CA | New York City, NY | Seattle, WA",), (["us"], "us", "onsite")),
    (("Washington, D.C.",), (["us"], "us", "onsite")),
    (("Remote - U.S.",), (["us"], "us", "remote")),
    (("Remote-Friendly (Travel-Required) | San Francisco, CA",), (["us"], "us", "remote")),
    (("London, UK; San Francisco, CA",), (["uk", "us"], "uk", "onsite")),
    (("Dublin, IE; London, UK; Remote-Friendly, United States",), (["ireland", "uk", "us"], "ireland", "remote")),
    (("Zürich, CH",), (["switzerland"], "switzerland", "onsite")),
    (("Amsterdam ",), (["netherlands"], "netherlands", "onsite")),
    (("San Francisco or NYC",), (["us"], "us", "onsite")),
    (("London & Amsterdam",), (["uk", "netherlands"], "uk", "onsite")),
    (("Ontario, CAN",), (["canada"], "canada", "onsite")),
    (("Remote International",), ([], "unknown", "remote")),
    (("Tokyo, Japan",), ([], "other", "onsite")),
    (("India - Remote",), ([], "other", "remote")),
    (("Europe",), ([], "unknown", "unknown")),
    (("Middle East",), ([], "unknown", "unknown")),
    (("2 Locations",), ([], "unknown", "unknown")),
    (("asdfgh qwerty",), ([], "unknown", "unknown")),
    (("",), ([], "unknown", "unknown")),
    ((None,), ([], "unknown", "unknown")),
    (("Lisbon (Hybrid)",), (["portugal"], "portugal", "hybrid")),
    (("Milan, IT",), (["italy"], "italy", "onsite")),
    (("Toronto, NL",), (["canada", "netherlands"], "canada", "onsite")),
    (("america",), ([], "unknown", "unknown")),
    (("San Francisco", None, "Hybrid", True), (["us"], "us", "hybrid")),
    (("San Francisco", None, "OnSite", False), (["us"], "us", "onsite")),
    (("Lisbon", None, "In-Office", None), (["portugal"], "portugal", "onsite")),
    (("Lisbon", None, "whatever", True), (["portugal"], "portugal", "remote")),
    (("Lisbon", None, None, False), (["portugal"], "portugal", "onsite")),
    (("Remote", "PT", "remote", None), (["portugal"], "portugal", "remote")),
    (("Tokyo, Japan", "JP", "hybrid", None), ([], "other", "hybrid")),
    (("London", "gb", None, None, ["Paris", "London"]), (["uk", "france"], "uk", "onsite")),
    (("remote or hybrid in Berlin",), ([], "unknown", "remote")),
]


def test_location_goldens(spark):
    rows = [(i, *case, *[None] * (5 - len(case))) for i, (case, _) in enumerate(GOLDENS)]
    df = spark.createDataFrame(
        rows, "i INT, location_raw STRING, country_code STRING, workplace_type STRING, "
        "is_remote BOOLEAN, location_hints ARRAY<STRING>")
    got = {r["i"]: r["location"] for r in places.parse_locations(df).collect()}
    for i, (case, (regions, region, mode)) in enumerate(GOLDENS):
        assert (got[i]["regions"], got[i]["region"], got[i]["work_mode"]) == (regions, region, mode), case


PRIORITY = [LocationRule(("onsite", "hybrid"), ("portugal", "switzerland"))]
ACCEPTABLE = [LocationRule(("onsite", "hybrid"), ("canada",)), LocationRule(("remote",), ("eu", "us"))]


def test_location_match(spark):
    rows = [
        ("uk", ["uk", "canada"], "onsite", "acceptable", "canada"),
        ("canada", ["canada", "portugal"], "onsite", "priority", "portugal"),
        ("germany", ["germany"], "remote", "acceptable", "germany"),
        ("germany", ["germany"], "onsite", "excluded", None),
        ("other", [], "onsite", "excluded", None),
        ("unknown", [], "remote", "unknown", None),
        ("portugal", ["portugal"], "unknown", "unknown", None),
        ("portugal", None, "hybrid", "priority", "portugal"),
    ]
    df = spark.createDataFrame(rows, "region STRING, regions ARRAY<STRING>, mode STRING, fit STRING, place STRING")
    got = df.select("fit", "place", places.location_match(
        F.col("region"), F.col("regions"), F.col("mode"), PRIORITY, ACCEPTABLE).alias("m")).collect()
    for r in got:
        assert (r["m"]["fit"], r["m"]["place"]) == (r["fit"], r["place"])


def test_region_groups(spark):
    assert "portugal" in places.expand(["eu"]) and "switzerland" not in places.expand(["eu"])
    assert places.expand(["us", "us"]) == ["us"]
    assert places.unknown_tokens(["eu", "us", "atlantis"]) == ["atlantis"]
    assert places.check_rules([LocationRule(("onsite", "moon"), ("atlantis",))]) == [
        "rule 1: unknown region atlantis", "rule 1: unknown work mode moon"]
    groups = spark.createDataFrame([("eu", c) for c in places.expand(["eu"])], "group STRING, country STRING")
    rules = spark.createDataFrame([("a", "eu"), ("a", "us"), ("b", "portugal")], "rule STRING, region STRING")
    got = places.expand_regions(rules, "region", groups)
    assert got.count() == 29 and got.where("region = 'eu'").count() == 0


def test_gazetteer_emits_only_known_tokens():
    assert places.check_gazetteer(DEFAULT_GAZETTEER) == []
    assert DEFAULT_GAZETTEER.resolve("nl") == "netherlands" and DEFAULT_GAZETTEER.resolve("de") == "germany"
