"""Event types of reports: weighted cues, suppressed and collapsed, tilted by actors and casualties.

Everything happens within a row: no join, no shuffle.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import dims
from .patterns import contained

# Type, weight, cues of a rule; the first cue that the folded text contains counts once.
RULES = [
    ("armed_clash", 3.0, [
        "affrontement", "accrochage", "combat", "echange de tirs", "echanges de tirs", "offensive", "contre offensive", "incursion", "attaque contre les positions",
        "repousse", "reprise de", "ligne de front", "front", "mapigano", "mapambano", "vita", "kupigana", "bitumba", "etumba", "clash", "firefight", "fighting",
    ]),
    ("armed_clash", 1.2, [
        "tirs", "coups de feu", "balles", "risasi", "gunfire", "crepitement",
    ]),
    ("shelling", 3.5, [
        "obus", "bombardement", "bombarde", "mortier", "roquette", "artillerie", "tirs d artillerie", "bombe est tombee", "shelling", "mabomu", "kombora",
    ]),
    ("airstrike", 3.5, [
        "frappe aerienne", "raid aerien", "avion de chasse", "sukhoi", "bombardement aerien", "helicoptere de combat", "airstrike", "ndege za kivita",
    ]),
    ("drone_strike", 3.5, [
        "frappe de drone", "drone arme", "attaque de drone", "drone strike", "drone kamikaze", "uav strike",
    ]),
    ("ied", 3.5, [
        "engin explosif", "eei", "ied", "mine artisanale", "bombe artisanale", "explosion d une bombe", "attentat a la bombe", "kifaa cha kulipuka", "a explose",
        "deflagration",
    ]),
    ("massacre", 3.8, [
        "massacre", "tuerie", "carnage", "massacres", "exactions massives", "des dizaines de civils tues", "mauaji", "mauaji ya halaiki", "koboma bato",
    ]),
    ("abduction", 3.5, [
        "enlevement", "enleve", "enleves", "kidnapping", "kidnappe", "rapt", "pris en otage", "otages", "disparition forcee", "utekaji", "wametekwa", "kutekwa nyara",
    ]),
    ("sexual_violence", 3.8, [
        "viol", "viols", "violence sexuelle", "violences sexuelles", "agression sexuelle", "ubakaji", "kubakwa", "rape", "sexual violence",
    ]),
    ("looting", 2.8, [
        "pillage", "pille", "pilles", "saccage", "vol de betail", "razzia", "depouille", "uporaji", "wizi", "kupora", "looting", "looted",
    ]),
    ("arson", 3.0, [
        "incendie", "incendies", "incendie criminel", "maisons brulees", "village brule", "reduit en cendres", "mise a feu", "moto", "kuchoma", "walichoma", "burned",
    ]),
    ("displacement", 3.0, [
        "deplacement", "deplaces", "deplacees", "exode", "fuient", "ont fui", "refugies", "vague de deplacement", "site de deplaces", "camp de deplaces", "wakimbizi",
        "wamekimbia", "kukimbia", "bakimi", "displacement", "fled",
    ]),
    ("roadblock", 3.0, [
        "barriere", "barrieres", "barrage routier", "poste de peage illegal", "taxation illegale", "rancon", "racket", "tracasserie", "kizuizi", "barabara imefungwa",
        "roadblock", "checkpoint illegal",
    ]),
    ("mine_incident", 3.2, [
        "carre minier", "site minier", "exploitation miniere", "creuseurs", "coltan", "cassiterite", "or artisanal", "puits d or", "mine d or", "eboulement", "machimbo",
        "wachimbaji", "mining site",
    ]),
    ("protest", 2.8, [
        "manifestation", "manifestants", "marche pacifique", "ville morte", "sit in", "grogne", "protestation", "maandamano", "protest", "demonstration",
    ]),
    ("arrest", 2.5, [
        "arrestation", "arrete", "arretes", "interpelle", "interpellation", "garde a vue", "ecroue", "kukamatwa", "amekamatwa", "arrested",
    ]),
    ("comms_blackout", 3.5, [
        "coupure de reseau", "reseau coupe", "panne de reseau", "internet coupe", "coupure d internet", "blackout", "sans reseau", "antenne detruite", "mtandao",
        "hakuna mtandao", "network outage", "shutdown",
    ]),
    ("troop_movement", 2.6, [
        "renfort", "renforts", "deploiement", "colonne militaire", "convoi militaire", "progression", "repli", "retrait des troupes", "positionnement", "wanajeshi wamefika",
        "kupelekwa", "troop movement", "reinforcement",
    ]),
    ("humanitarian_access", 2.8, [
        "acces humanitaire", "convoi humanitaire", "aide humanitaire bloquee", "suspension des activites", "ong suspend", "corridor humanitaire", "msaada wa kibinadamu",
        "humanitarian access",
    ]),
    ("thermal_anomaly", 4.0, [
        "anomalie thermique", "point chaud viirs", "thermal anomaly",
    ]),
]
# Type, cues that cut its score to a quarter.
SUPPRESSORS = [
    ("armed_clash", ["calme est revenu", "accalmie", "cessez le feu", "aucun affrontement", "situation calme"]),
    ("displacement", ["retour des deplaces", "sont rentres", "retour volontaire"]),
]
# Cues of sport and culture, which share verbs and names with violence.
OFF_TOPIC = [
    "ligue 1", "ligue 2", "linafoot", "vodacom ligue", "championnat", "football", "footballeur", " stade ", "coupe du congo", "can 2", "leopards", "mazembe", "don bosco",
    "lupopo", "daring", "basketball", "handball", "athletisme", "sportif", "selection nationale", "concert", "festival", "musique", "artiste", "cinema", "miss ", "rumba",
    "album", "championne", "champion ", "match ", "buteur", "victoire face",
]
# Types that off-topic texts lose; weights of actors and casualties; temperature of the softmax.
VIOLENT = ["armed_clash", "shelling", "airstrike", "drone_strike", "ied", "abduction", "massacre", "sexual_violence", "looting", "arson", "troop_movement"]
HABIT, FACING, ABDUCTED, DISPLACED, INJURED, MANY_DEAD, MANY_DEAD_FOUGHT, MANY = 0.55, 1.8, 1.6, 1.4, 0.4, 1.9, 0.7, 8
TEMPERATURE, ALTERNATES, EVIDENCE = 2.0, 3, 6
FOUND = T.StructType().add("cues", T.ArrayType(T.StringType())).add("cuts", T.ArrayType(T.BooleanType())).add("leisure", T.BooleanType())


#: All cues in one list, and of each what it stands for: a rule, a suppressor or what is off topic.
_CUES = [(i, None, c) for i, (_, _, cues) in enumerate(RULES) for c in cues] + [(None, i, c) for i, (_, cues) in enumerate(SUPPRESSORS) for c in cues] + [(None, None, c) for c in OFF_TOPIC]
_WORDS = tuple(c for *_, c in _CUES)


def _cues_of(text: str) -> tuple[list[str | None], list[bool], bool]:
    first: list[str | None] = [None] * len(RULES)
    cuts, leisure = [False] * len(SUPPRESSORS), False
    for i in sorted(contained(_WORDS, text), reverse=True):  # a rule's earlier cues come later
        rule, cut, word = _CUES[i]
        if rule is not None:
            first[rule] = word
        elif cut is not None:
            cuts[cut] = True
        else:
            leisure = True
    return first, cuts, leisure


@F.pandas_udf(FOUND)
def cues_in(texts: pd.Series) -> pd.DataFrame:
    """What of the rules a folded text contains: each rule's first cue or null, each suppressor or not, off-topic or not.
    One pass over a text finds all."""
    each = [_cues_of(t) for t in texts.fillna("")]
    return pd.DataFrame({"cues": [x[0] for x in each], "cuts": [x[1] for x in each], "leisure": [x[2] for x in each]})


def classified(rows: DataFrame, folded: Column, actors: Column, fatalities: Column, injured: Column, abducted: Column, displaced: Column, name: str = "class") -> DataFrame:
    """``rows`` with a struct(type, score, alts, evidence) of a text passed through ``fold_key``.

    Actors are names of ``dims.ACTORS``; others, repeats and nulls do not count. Types are ranked by score, ties by what
    scored them first: rules in order, suppressors, actors, casualties. A suppressor alone leaves its type with a score
    of nothing, which still ranks. A null or empty text has no cues; without any score the type is ``unknown``. Texts
    are scanned for cues once, in an Arrow batch; ranking is native, in steps that each bind what the next one uses.
    """
    who = F.coalesce(actors, F.array().cast("array<string>"))
    given = {"_dead": fatalities, "_hurt": injured, "_taken": abducted, "_moved": displaced}
    places = {f"_at{i}": F.array_position(who, F.lit(n)) for i, (n, *_) in enumerate(dims.ACTORS)}
    out = rows.withColumns({"_found": cues_in(folded), **{n: F.coalesce(c, F.lit(0)) for n, c in given.items()}, **places})
    out = out.withColumns(_ranks())
    out = out.withColumn("_ranked", F.sort_array(F.array(*[F.col(f"_r_{k}") for k in KINDS]), asc=False))
    return out.withColumn(name, _answer()).drop("_found", "_ranked", *given, *places, *[f"_r_{k}" for k in KINDS])


KINDS = [t[0] for t in dims.EVENT_TYPES if t[0] != "unknown"]
#: What scored a type first, by number: rules from 0, suppressors, habits by the actor's place, casualties.
SUPPRESSED, HABITUAL, LATER = 100, 200, 1_000_000_000


def _ranks() -> dict[str, Column]:
    """A column for each type: struct(score, minus what scored it first, type), null without any score."""
    at = [F.col(f"_at{i}") for i in range(len(dims.ACTORS))]
    cue = lambda i: F.col("_found.cues")[i].isNotNull()
    number = lambda c: c.cast("int")
    dead, taken = F.col("_dead"), F.col("_taken")
    foes = {frozenset(p) for p in dims.OPPOSED}
    facing, armed = F.lit(0), F.lit(0)
    for i, (_, side, *_) in enumerate(dims.ACTORS):
        against = [at[j] > at[i] for j, (_, other, *_) in enumerate(dims.ACTORS) if j != i and frozenset((side, other)) in foes]
        later_foe = F.lit(False)
        for a in against:
            later_foe |= a
        facing += number((at[i] > 0) & later_foe)
        armed += number(at[i] > 0) if side != "civilian" else F.lit(0)
    # What follows the cues: type, whether it holds, its points.
    later = [
        ("armed_clash", facing > 0, facing * FACING),
        ("abduction", taken > 0, F.lit(ABDUCTED)),
        ("displacement", F.col("_moved") > 0, F.lit(DISPLACED)),
        ("armed_clash", (F.col("_hurt") > 0) & (dead == 0), F.lit(INJURED)),
        ("massacre", (dead >= MANY) & (armed <= 1), F.lit(MANY_DEAD)),
        ("armed_clash", (dead >= MANY) & (armed > 1), F.lit(MANY_DEAD_FOUGHT)),
    ]
    hard = (dead > 0) | (taken > 0)
    for i, (kind, _, _) in enumerate(RULES):
        if kind in VIOLENT:
            hard |= cue(i)
    out = {}
    for kind in KINDS:
        score, first = F.lit(0.0), [F.lit(None).cast("long")]
        for i, (k, w, _) in enumerate(RULES):
            if k == kind:
                score += F.when(cue(i), w).otherwise(0.0)
                first.append(F.when(cue(i), F.lit(i)))
        for i, (k, _) in enumerate(SUPPRESSORS):
            if k == kind:
                score *= F.when(F.col("_found.cuts")[i], 0.25).otherwise(1.0)
                first.append(F.when(F.col("_found.cuts")[i], F.lit(SUPPRESSED + i)))
        for i, (_, _, habits, _) in enumerate(dims.ACTORS):
            if kind in habits:
                score += F.when(at[i] > 0, HABIT).otherwise(0.0)
                first.append(F.when(at[i] > 0, at[i] * 10 + F.lit(HABITUAL + habits.index(kind))))
        for i, (k, holds, points) in enumerate(later):
            if k == kind:
                score += F.when(holds, points).otherwise(0.0)
                first.append(F.when(holds, F.lit(LATER + i)))
        one = F.least(*first) if len(first) > 1 else first[0]
        stays = ~F.col("_found.leisure") | hard if kind in VIOLENT else F.lit(True)
        ranked = F.struct(F.round(score, 9).alias("score"), (-one).cast("long").alias("first"), F.lit(kind).alias("type"))
        out[f"_r_{kind}"] = F.when(one.isNotNull() & stays, ranked)
    return out


def _answer() -> Column:
    """From the ranked types, best first and nulls last."""
    present = [F.col(f"_r_{k}") for k in KINDS]
    weight = lambda r: F.coalesce(F.exp(r["score"] / TEMPERATURE), F.lit(0.0))
    total, n = F.lit(0.0), F.lit(0)
    for r in present:
        total, n = total + weight(r), n + r.isNotNull().cast("int")
    shares = [F.struct(r["type"].alias("type"), (weight(r) / F.nullif(total, F.lit(0.0))).alias("score")) for r in (F.get("_ranked", F.lit(i)) for i in range(ALTERNATES + 1))]
    cues = F.array_except(F.col("_found.cues"), F.array(F.lit(None).cast("string")))
    return F.struct(
        F.coalesce(shares[0]["type"], F.lit("unknown")).alias("type"),
        F.when(n > 0, shares[0]["score"]).otherwise(0.0).alias("score"),
        F.slice(F.array(*shares[1:]), F.lit(1), F.greatest(F.lit(0), F.least(n - 1, F.lit(ALTERNATES)))).alias("alts"),
        F.when(n == 0, F.array().cast("array<string>")).otherwise(F.slice(cues, 1, EVIDENCE)).alias("evidence"),
    )
