"""Many fixed words looked up in a text in one pass, by an automaton that a worker builds once."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import cache

import ahocorasick
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Words of which a relevant text contains one, as a substring: as browsers read it, in lower case, and as
# collectors do, in lower case without marks.
RELEVANT = [
    "rdc", "congo", "kivu", "ituri", "goma", "bukavu", "beni", "butembo", "bunia", "uvira", "masisi", "rutshuru", "walikale", "fizi", "kalemie", "m23", "fardc", "adf",
    "codeco", "wazalendo", "monusco", "virunga",
]
RELEVANT_COLLECTED = [
    "congo", "rdc", "drc", "kinshasa", "kivu", "goma", "bukavu", "beni", "butembo", "ituri", "bunia", "uvira", "masisi", "rutshuru", "walikale", "fizi", "minembwe", "m23",
    "fardc", "wazalendo", "monusco", "adf", "codeco", "mai-mai", "maimai", "lualaba", "tanganyika", "kasai", "kasaï", "tshopo", "maniema", "mbuji", "kananga", "lubumbashi",
    "kalemie", "kolwezi", "nyiragongo", "congolais", "congolese",
]


@cache
def automaton(words: tuple[str, ...]) -> ahocorasick.Automaton:
    """Of the words, each with all its places in the list."""
    places: dict[str, list[int]] = {}
    for i, w in enumerate(words):
        places.setdefault(w, []).append(i)
    out = ahocorasick.Automaton()
    for w, at in places.items():
        out.add_word(w, tuple(at))
    out.make_automaton()
    return out


def contained(words: tuple[str, ...], text: str) -> set[int]:
    """Places of the words that the text contains, overlapping ones too."""
    return {i for _, at in automaton(words).iter(text) for i in at}


def found(words: Sequence[str]) -> Callable[[Column], Column]:
    """A function of a text: the places in ``words`` (from 0, ascending) of those it contains, however long it is. A null
    or empty text contains none; words must not be empty."""
    given = tuple(words)
    if not given or not all(given):
        raise ValueError("give words of one letter at least")

    @F.pandas_udf("array<int>")
    def look(texts: pd.Series) -> pd.Series:
        return pd.Series([sorted(contained(given, t)) if t else [] for t in texts], dtype=object)

    return look


def relevant(lower: Column, words: Sequence[str] = RELEVANT) -> Column:
    """Whether a text in lower case (for ``RELEVANT_COLLECTED``, without marks) names the region."""
    return F.size(found(words)(lower)) > 0
