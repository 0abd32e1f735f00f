"""Typed events as reports, by hand, and through extraction."""

from datetime import datetime

from orrery.operators import extract
from orrery.sources import bridge

CONFLICT = "src string, type string, subtype string, date string, location string, admin1 string, lat double, lon double, fatalities long, actor1 string, actor2 string, notes string"


def test_conflict_reports(spark):
    rows = [
        ("acled", "Battles", "Armed clash", "2024-01-05", "Rutshuru", "Nord-Kivu", -1.18765, 29.4, 4, "M23", "FARDC", ""),
        ("acled", "Battles", "", "", "", "", -1.0, 29.0, 0, "", "M23", None),
        ("acled", "Riots", "x", "bad day", None, None, None, 29.0, None, None, None, "  Des notes.  "),
    ]
    got = bridge.conflict_reports(spark.createDataFrame(rows, CONFLICT)).collect()
    assert got[0]["text"] == "Armed clash signalé à Rutshuru impliquant M23 et FARDC. 4 morts rapportés. Localité : Rutshuru, Nord-Kivu."
    assert (got[0]["source_id"], got[0]["created_at"], got[0]["geo_radius_km"]) == ("acled:2024-01-05:-1.188:29.400:Battles", datetime(2024, 1, 5, 12), 5.0)
    assert got[1]["text"] == "Battles signalé à localité non précisée impliquant M23." and got[1]["created_at"] is None
    assert got[2]["text"] == "Des notes." and got[2]["created_at"] is None


def test_sensor_reports(spark):
    points = spark.createDataFrame([("2024-01-05", datetime(2024, 1, 5, 3, 7), -1.5, 29.25, 330.5, None, None, "N")], "date string, ts timestamp_ntz, lat double, lon double, brightness double, frp double, confidence string, daynight string")
    (got,) = bridge.thermal_reports(points).collect()
    assert got["source_id"] == "firms:2024-01-05:0307:-1.5000:29.2500" and (got["frp"], got["brightness"]) == (0.0, 330.5)
    assert got["text"] == "Anomalie thermique VIIRS détectée. Puissance radiative ? MW, luminosité 331 K, confiance capteur n/a."
    seen = spark.createDataFrame([(None, "Convoy", None, None, None, -1.5, 29.0, None)], "id string, type string, desc string, platform string, status string, lat double, lon double, ts timestamp_ntz")
    (got,) = bridge.drone_reports(seen).collect()
    assert (got["source_id"], got["text"]) == ("uas:-1.5,29.0", "Convoy. Plateforme UAS, statut n/a.")


def test_reports_become_events(spark):
    row = ("acled", "Battles", "Armed clash", "2024-01-05", "Rutshuru", "Nord-Kivu", -1.18765, 29.4, 4, "", "", "")
    seen = spark.createDataFrame([], "key string, correct boolean, weight double, at timestamp_ntz")
    (got,) = extract.normalise(bridge.conflict_reports(spark.createDataFrame([row], CONFLICT)), seen, datetime(2024, 1, 6)).collect()
    assert (got["fatalities"], got["method"], got["source_type"]) == (4, "exact", "acled")
