"""Small reference tables. Values that results depend on are fixed values; names of places and actors are invented."""

from __future__ import annotations

# Type, category, base severity.
EVENT_TYPES = [
    ("armed_clash", "conflict", 0.80),
    ("shelling", "conflict", 0.85),
    ("airstrike", "conflict", 0.90),
    ("drone_strike", "conflict", 0.80),
    ("ied", "conflict", 0.75),
    ("abduction", "conflict", 0.70),
    ("massacre", "conflict", 1.00),
    ("sexual_violence", "conflict", 0.85),
    ("looting", "conflict", 0.50),
    ("arson", "conflict", 0.55),
    ("displacement", "humanitarian", 0.65),
    ("roadblock", "conflict", 0.35),
    ("mine_incident", "conflict", 0.50),
    ("protest", "political", 0.30),
    ("arrest", "political", 0.25),
    ("comms_blackout", "sensor", 0.55),
    ("troop_movement", "conflict", 0.45),
    ("humanitarian_access", "humanitarian", 0.40),
    ("thermal_anomaly", "sensor", 0.30),
    ("unknown", "other", 0.20),
]
STATUSES = ["unverified", "corroborated", "confirmed", "disputed", "rejected", "merged"]

# Pairs of types that may describe one incident.
TYPE_AFFINITY = [
    ("armed_clash", "shelling"),
    ("armed_clash", "massacre"),
    ("armed_clash", "troop_movement"),
    ("massacre", "arson"),
    ("shelling", "airstrike"),
    ("airstrike", "drone_strike"),
    ("ied", "shelling"),
    ("looting", "arson"),
    ("displacement", "armed_clash"),
    ("abduction", "armed_clash"),
    ("thermal_anomaly", "arson"),
    ("thermal_anomaly", "shelling"),
]

# Within-family correlation of reports.
FAMILY_RHO = {
    "social": 0.62, "messaging": 0.55, "press": 0.45, "broadcast": 0.38, "wire": 0.30,
    "official": 0.35, "field": 0.22, "sensor": 0.10, "imagery": 0.10,
}

# The public keys of source types, each with its family, grade, credibility and strength of the prior. They
# equal those that records of such sources carry elsewhere, so that a user's types find their row.
SOURCE_PROFILES = [
    ("acled", "wire", "B", 2, 40),
    ("reliefweb", "wire", "B", 2, 30),
    ("ocha", "wire", "A", 2, 40),
    ("radio_okapi", "broadcast", "B", 2, 30),
    ("rtnc", "broadcast", "C", 3, 15),
    ("community_radio", "broadcast", "C", 3, 10),
    ("actualite_cd", "press", "B", 3, 20),
    ("7sur7", "press", "C", 3, 12),
    ("politico_cd", "press", "C", 3, 12),
    ("press_other", "press", "D", 3, 8),
    ("twitter_verified", "social", "C", 3, 8),
    ("twitter_unverified", "social", "E", 4, 4),
    ("facebook", "social", "E", 4, 4),
    ("telegram", "messaging", "D", 4, 6),
    ("whatsapp", "messaging", "D", 4, 5),
    ("ngo_field", "field", "B", 2, 20),
    ("civil_society", "field", "C", 3, 14),
    ("sms_gateway", "field", "D", 3, 6),
    ("firms", "sensor", "A", 2, 50),
    ("acoustic", "sensor", "B", 2, 25),
    ("telecom", "sensor", "A", 1, 45),
    ("sentinel", "imagery", "A", 1, 50),
    ("uas_isr", "imagery", "A", 1, 45),
    ("fardc", "official", "D", 3, 15),
    ("monusco", "official", "B", 2, 30),
    ("gov_provincial", "official", "C", 3, 18),
    ("anonymous", "social", "F", 5, 2),
]
#: The profile of a source type that has none.
DEFAULT_SOURCE = "anonymous"
# Probability of a reliability grade, and of a credibility.
GRADE_P = {"A": 0.95, "B": 0.80, "C": 0.65, "D": 0.40, "E": 0.20, "F": 0.50}
CREDIBILITY_P = {1: 0.95, 2: 0.80, 3: 0.65, 4: 0.40, 5: 0.20, 6: 0.50}

#: Invented settlements: name, lat, lon, population, radius in km, kind, province, aliases.
PLACES = [
    ("Amaro", -1.50, 29.10, 650_000, 9.0, "city", "Northreach", ["amaro", "amaro ville"]),
    ("Beltane", 0.45, 29.45, 230_000, 6.0, "city", "Northreach", ["beltane"]),
    ("Corvo", -2.45, 28.85, 810_000, 8.0, "city", "Southreach", ["corvo", "corvo centre"]),
    ("Dunmar", -3.35, 29.15, 320_000, 6.0, "town", "Southreach", ["dunmar"]),
    ("Esker", 1.55, 30.20, 360_000, 7.0, "city", "Eastmark", ["esker", "esker nord"]),
    ("Fallow", -1.20, 28.10, 45_000, 3.0, "town", "Northreach", ["fallow"]),
    ("Garrow", -0.60, 29.30, 90_000, 4.0, "town", "Northreach", ["garrow"]),
    ("Hollin", -2.95, 27.90, 12_000, 2.0, "village", "Southreach", ["hollin"]),
    ("Ister", 2.40, 28.60, 28_000, 3.0, "town", "Eastmark", ["ister"]),
    ("Jorum", 3.10, 30.60, 8_000, 2.0, "village", "Eastmark", ["jorum"]),
    ("Kestle", -0.10, 27.60, 15_000, 2.5, "village", "Westvale", ["kestle"]),
    ("Larch", 1.05, 27.40, 60_000, 3.5, "town", "Westvale", ["larch"]),
]
#: Middles of the invented provinces: name, lat, lon, radius in km.
PROVINCES = [("Northreach", -0.7, 29.1, 95.0), ("Southreach", -3.1, 28.9, 110.0), ("Eastmark", 2.3, 29.6, 130.0), ("Westvale", 0.9, 27.8, 120.0)]
#: Persons per square km outside settlements, by invented province.
RURAL_DENSITY = {"Northreach": 84.0, "Southreach": 52.0, "Eastmark": 37.0, "Westvale": 9.0}
RURAL_DEFAULT = 30.0

#: Invented points of interest: kind, name, lat, lon.
POINTS = [
    ("hospital", "Amaro General", -1.52, 29.08),
    ("hospital", "Esker Clinic", 1.57, 30.22),
    ("hospital", "Corvo Mercy", -2.44, 28.86),
    ("hospital", "Larch Post", 1.04, 27.42),
    ("camp", "Site One", -1.60, 29.00),
    ("camp", "Site Two", 1.70, 30.10),
    ("mine", "Red Pit", -1.10, 28.20),
    ("mine", "Blue Pit", 0.80, 27.80),
    ("airstrip", "Garrow Strip", -0.62, 29.28),
    ("airstrip", "Dunmar Strip", -3.33, 29.17),
    ("border", "East Gate", -1.55, 29.60),
    ("border", "North Gate", 3.20, 30.90),
]
POINT_KINDS = ["hospital", "camp", "mine", "airstrip", "border"]

#: Invented roads: name, points as (lon, lat).
AXES = [
    ("Amaro-Garrow", [(29.10, -1.50), (29.20, -1.05), (29.30, -0.60)]),
    ("Garrow-Beltane", [(29.30, -0.60), (29.45, 0.45)]),
    ("Corvo-Dunmar", [(28.85, -2.45), (29.00, -2.90), (29.15, -3.35)]),
    ("Esker-Jorum", [(30.20, 1.55), (30.40, 2.30), (30.60, 3.10)]),
]

#: Invented provinces: name, ring as (lon, lat); a later ring may overlap an earlier one, which then wins.
RINGS = [
    ("Northreach", [(28.0, -2.0), (30.0, -2.0), (30.2, 0.8), (28.9, 1.0), (27.9, -0.4)]),
    ("Southreach", [(27.2, -4.0), (29.8, -4.0), (30.0, -2.0), (28.0, -2.0)]),
    ("Eastmark", [(28.9, 1.0), (30.2, 0.8), (31.0, 2.2), (30.5, 4.0), (28.2, 3.6)]),
    ("Westvale", [(27.0, -1.0), (27.9, -0.4), (28.9, 1.0), (28.2, 3.6), (27.0, 2.0)]),
]
#: Invented lakes: name, lat, lon, radius in km.
LAKES = [("Long Water", -2.0, 29.6, 40.0), ("Far Water", 2.1, 30.8, 30.0)]
#: Boxes (south, north, west, east) of highland and forest on the invented map: ridges along the roads, woods in the west.
HIGHLAND = [(-1.3, -0.7, 29.15, 29.4), (-3.1, -2.6, 28.9, 29.3), (1.9, 2.8, 30.25, 30.75)]
FOREST = [(-0.8, 0.7, 27.1, 28.3), (2.0, 3.4, 27.2, 28.9), (-3.8, -2.9, 27.3, 28.2)]

#: Invented actors: name, side, habitual event types, aliases.
ACTORS = [
    ("Grey Column", "rebel", ["armed_clash", "massacre"], ["grey column", "colonne grise"]),
    ("Third Brigade", "army", ["armed_clash", "troop_movement"], ["third brigade", "troisieme brigade"]),
    ("River Guard", "militia", ["roadblock", "looting"], ["river guard", "garde du fleuve"]),
    ("Blue Mission", "peacekeeper", ["troop_movement"], ["blue mission", "mission bleue"]),
    ("Hill Farmers", "civilian", ["protest"], ["hill farmers", "fermiers"]),
]
#: Pairs of sides that fight each other.
OPPOSED = [("rebel", "army"), ("rebel", "militia"), ("rebel", "peacekeeper"), ("militia", "army")]
