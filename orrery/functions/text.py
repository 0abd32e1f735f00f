"""Folding, tokens, similarity and cleaning of text."""

from __future__ import annotations

import re
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Letters with marks, and the same without.
MARKED = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿ"
PLAIN = "aaaaaaceeeeiiiinooooouuuuyy"

# Marker words of languages, in order of preference on ties.
LANGUAGE_MARKERS = {
    "fr": [
        "le", "la", "les", "des", "dans", "selon", "vers", "avec", "ont", "ete", "sont", "entre", "apres", "contre", "ce", "cette", "au", "aux", "du", "pour", "par", "plus",
        "nuit", "matin", "soir", "hier",
    ],
    "sw": [
        "wa", "ya", "na", "katika", "kwa", "walikuwa", "watu", "usiku", "asubuhi", "jana", "leo", "wamekufa", "mji", "vita", "askari", "risasi", "wanajeshi", "wengi",
        "habari",
    ],
    "ln": [
        "na", "ya", "mpo", "bato", "mokolo", "lobi", "butu", "esika", "bakufi", "mingi", "likambo", "bitumba", "soda", "mboka", "esalemi",
    ],
    "en": [
        "the", "and", "was", "were", "have", "been", "reported", "near", "after", "with", "clash", "killed", "civilians", "sources", "forces",
    ],
}
# Words without meaning for retrieval.
STOP_WORDS = [
    "le", "la", "les", "un", "une", "des", "de", "du", "et", "ou", "en", "dans", "sur", "pour", "par", "avec", "sans", "que", "qui", "quoi", "quel", "quels", "quelle",
    "quelles", "est", "sont", "aux", "au", "ce", "ces", "se", "sa", "son", "ses", "il", "elle", "ne", "pas", "plus", "the", "a", "an", "of", "in", "on", "for", "and", "or",
    "to", "is", "are", "what", "which", "how", "why", "main", "principaux", "principales", "comment", "pourquoi",
]
# Cues of certainty, the first that occurs decides.
DENIAL = [
    "dement", "dementi", "nie", "nient", "rejette", "rejettent", "faux", "infondee", "infondees", "aucune attaque", "pas eu lieu", "rumeur infondee", "denies", "denied",
    "anakanusha", "si kweli",
]
HEDGE = [
    "aurait", "auraient", "serait", "seraient", "pourrait", "pourraient", "presume", "presumee", "suppose", "supposee", "non confirme", "non confirmee", "non confirmes",
    "a confirmer", "sous reserve", "rumeur", "rumeurs", "bruit court", "on parle de", "alleged", "allegedly", "reportedly", "unconfirmed", "inasemekana", "yasemekana",
    "huenda",
]
ATTRIBUTION = [
    "selon", "d apres", "affirme", "affirment", "declare", "declarent", "rapporte", "rapportent", "temoins", "temoignage", "sources locales", "source locale", "a indique",
    "ont indique", "according to", "said", "kulingana na", "alisema", "walisema", "vyanzo",
]


def unmark(s: Column) -> Column:
    """Lower case without marks."""
    return F.translate(F.lower(s), MARKED, PLAIN)


def fold_key(s: Column) -> Column:
    """Lower case letters, digits and single spaces alone."""
    x = F.regexp_replace(unmark(s), r"['’ʼ]", " ")
    x = F.regexp_replace(x, r"[^a-z0-9\s-]", " ")
    return F.trim(F.regexp_replace(x, r"[\s_-]+", " "))


def tokens(folded: Column) -> Column:
    return F.filter(F.split(folded, " "), lambda x: x != "")


def question_terms(question: str) -> list[str]:
    """``query_terms`` of a text at hand."""
    plain = question.lower().translate(str.maketrans(MARKED, PLAIN))
    return list(dict.fromkeys(w for w in re.split("[^a-z0-9]+", plain) if len(w) > 2 and w not in STOP_WORDS))


def query_terms(s: Column) -> Column:
    """Distinct terms of three letters and more, without stop words."""
    words = F.filter(F.split(unmark(s), "[^a-z0-9]+"), lambda x: F.length(x) > 2)
    return F.array_except(F.array_distinct(words), F.array(*map(F.lit, STOP_WORDS)))


def trigrams(folded: Column) -> Column:
    """The set of character trigrams of the text between blanks, in the order of the text; of a null none. One pass over
    the text in a task: a substring in an expression is sought from the text's start, for each trigram anew."""

    @F.pandas_udf("array<string>")
    def grams(texts: pd.Series) -> pd.Series:
        return pd.Series([[] if t is None else list(dict.fromkeys(map("".join, zip(x := f" {t} ", x[1:], x[2:], strict=False)))) for t in texts], dtype=object)

    return grams(folded)


def trigram_set(text: str) -> np.ndarray:
    """``trigram_codes`` of one folded text."""
    x = np.frombuffer(f" {text} ".encode("ascii"), np.uint8).astype(np.int32)
    return np.unique(x[:-2] * 16384 + x[1:-1] * 128 + x[2:])


def trigram_codes(folded: Column) -> Column:
    """``trigrams`` of a text passed through ``fold_key``, each as a number, ascending: its letters are ASCII, of seven bits."""

    @F.pandas_udf("array<int>")
    def codes(texts: pd.Series) -> pd.Series:
        return pd.Series([[] if t is None else trigram_set(t) for t in texts], dtype=object)

    return codes(folded)


def dice(a: Column, b: Column) -> Column:
    """Of two sets; 0 if both are empty."""
    total = F.size(a) + F.size(b)
    return F.when(total == 0, 0.0).otherwise(2.0 * F.size(F.array_intersect(a, b)) / total)


def jaccard(a: Column, b: Column) -> Column:
    """Of two sets; 0 if both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 0.0).otherwise(F.size(F.array_intersect(a, b)).cast("double") / union)


def detect_language(words: Column) -> Column:
    """By marker words, two at least; one language shares markers with another and needs one more."""
    best, name = F.lit(0), F.lit("unknown")
    for lang, marks in LANGUAGE_MARKERS.items():
        n = F.size(F.array_intersect(words, F.array(*map(F.lit, marks)))) - (1 if lang == "ln" else 0)
        name = F.when(n > best, lang).otherwise(name)
        best = F.greatest(best, n)
    return F.when(best >= 2, name).otherwise("unknown")


def first_cue(folded: Column, cues: Sequence[str]) -> Column:
    """The first of the cues that the text contains, as a substring; null if none."""
    return F.coalesce(*[F.when(folded.contains(c), F.lit(c)) for c in cues])


def certainty(folded: Column) -> Column:
    """struct(level, cue): denied before hedged before attributed, else asserted."""
    found = {"denied": first_cue(folded, DENIAL), "hedged": first_cue(folded, HEDGE), "attributed": first_cue(folded, ATTRIBUTION)}
    level = F.coalesce(*[F.when(c.isNotNull(), F.lit(k)) for k, c in found.items()], F.lit("asserted"))
    return F.struct(level.alias("level"), F.coalesce(*found.values()).alias("cue"))


def summarise(text: Column, most: int = 180) -> Column:
    """The first sentence if it is of a middling length, else the text, cut at a word where it is long."""
    clean = F.trim(F.regexp_replace(text, r"\s+", " "))
    stop = F.length(F.regexp_extract(clean, r"^(.*?)[.!?](\s|$)", 1))
    ends = F.regexp_like(clean, F.lit(r"^.*?[.!?](\s|$)"))
    head = F.substring(clean, 1, most + 1)
    blank = F.length(head) - F.length(F.substring_index(head, " ", -1)) - 1
    return (
        F.when(ends & (stop > 40) & (stop < most), F.substring(clean, F.lit(1), stop + 1))
        .when(F.length(clean) <= most, clean)
        .otherwise(F.concat(F.substring(clean, F.lit(1), F.when(blank > 60, blank).otherwise(most)), F.lit("…")))
    )


def tidy_title(s: Column) -> Column:
    """Undo blanks before punctuation and inside numbers."""
    x = F.regexp_replace(F.coalesce(s, F.lit("")), r"\s+([,.;:!?%])", "$1")
    x = F.regexp_replace(x, r"(\d),\s(\d{3})\b", "$1,$2")
    return F.trim(F.regexp_replace(x, r"\s+", " "))


def decode_entities(s: Column) -> Column:
    """The named entities of feeds, and numeric ones; those over 255 become blanks."""
    x = F.replace(s, F.lit("&amp;"), F.lit("&"))
    x = F.replace(F.replace(x, F.lit("&lt;"), F.lit("<")), F.lit("&gt;"), F.lit(">"))
    x = F.regexp_replace(x, "&#0?39;|&apos;|&rsquo;|&#8217;", "'")
    x = F.regexp_replace(x, "&quot;|&ldquo;|&rdquo;", '"')
    x = F.replace(x, F.lit("&nbsp;"), F.lit(" "))
    number = lambda p: F.regexp_extract(p, r"^(\d{1,7});", 1).try_cast("int")
    rest = lambda p: F.regexp_replace(p, r"^\d+;", "")
    parts = F.transform(
        F.split(x, "&#"),
        lambda p, i: F.when(i == 0, p)
        .when(number(p).isNull(), F.concat(F.lit("&#"), p))
        .otherwise(F.concat(F.when(number(p) < 256, F.char(number(p))).otherwise(" "), rest(p))),
    )
    return F.when(x.contains("&#"), F.array_join(parts, "")).otherwise(x)


def strip_html(s: Column) -> Column:
    """Decode, drop tags, and both again for what was encoded twice."""
    x = F.regexp_replace(F.coalesce(s, F.lit("")), r"<!\[CDATA\[|\]\]>", "")
    for _ in range(2):
        x = F.regexp_replace(decode_entities(x), "<[^>]*>", " ")
    return F.trim(F.regexp_replace(x, r"\s+", " "))


def strip_links(s: Column, host: str = r"t\.co") -> Column:
    """Drop a shortener's links."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.coalesce(s, F.lit("")), rf"https?://{host}/\S+", " "), r"\s+", " "))


def host_of(url: Column) -> Column:
    """Without ``www.``; empty where there is none."""
    return F.regexp_replace(F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]+)", 1)), r"^www\.", "")


def truncate(s: Column, most: int) -> Column:
    return F.when(F.length(s) > most, F.concat(F.substring(s, 1, most), F.lit("…"))).otherwise(s)


def fnv1a(s: Column) -> Column:
    """32-bit FNV-1a over code points, as eight hex digits."""
    codes = F.transform(F.filter(F.split(s, ""), lambda c: c != ""), lambda c: F.ascii(c).cast("long"))
    h = F.aggregate(codes, F.lit(2166136261).cast("long"), lambda a, c: F.pmod(a.bitwiseXOR(c) * 16777619, F.lit(4294967296)))
    return F.lpad(F.lower(F.hex(h)), 8, "0")
