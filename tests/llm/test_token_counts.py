import random

import pytest
from tokenizers import Tokenizer
from tokenizers.models import Unigram

from orrery.llm import token_counts as t

PIECES = ["▁", "e", "a", "▁a", "an", "t", "he", "▁the", "the", "n", "d", "▁and", "nd", "é", "éa", "h", "▁t", "eat", "tan", "日本"]
TEXTS = [None, "", " \n", "the and", "the\tand\x1ctan é", "日本 日 本日本 \x85", "héat " * 5, "a" * 3000, "x", "\U0001f600e", "an" * 40 + " tea"]


def brute(v, text):
    """The tokenizers library's Viterbi on each word; unknown characters count as bytes."""
    if v not in brute.known:
        names = [("\0unk", 0.0)] + list(v.scores.items())
        brute.known[v] = Tokenizer(Unigram(names, 0, False))
    tok = brute.known[v]
    total = 0
    for w in (text or "").encode().split():
        word = t.MARK + w.decode()
        for piece, (s, e) in zip((x := tok.encode(word)).tokens, x.offsets, strict=True):
            total += 1 if piece in v.scores else len(word[s:e].encode())
    return total


brute.known = {}


class Hashable(t.Vocabulary):
    __hash__ = object.__hash__
    __eq__ = object.__eq__


@pytest.fixture(scope="module")
def vocabularies():
    small = t.Vocabulary.ranked(PIECES)
    return [Hashable(small.scores), Hashable(t.Vocabulary.load().scores)]


def test_against_viterbi(vocabularies):
    rng = random.Random(4)
    texts = TEXTS[:10] + [" ".join("".join(rng.choice("thenadé日x") for _ in range(rng.randint(1, 12))) for _ in range(30)) for _ in range(30)]
    for v in vocabularies:
        words, tokens = t.TrieCounter(v).total(texts)
        assert tokens == [brute(v, x) for x in texts]
        assert words == [len((x or "").encode().split()) for x in texts]


def test_prefixes_are_shared(vocabularies):
    c = t.TrieCounter(vocabularies[0])
    c.total(["thea theb thec thead", "thea"])
    assert c.scored == 1 + 3 + 3 + 1  # the mark, t-h-e, a, b, c, and d under a
    c.total(["theadx", "the"])  # another batch: only x is new, and the end at an inner node is its count
    assert c.scored == 9 and c.known[b"the"] == c.tokens[down(c, "▁the")]


def down(counter, path):
    at = 0
    for x in path:
        at = counter.children[at << 21 | ord(x)]
    return at


def test_table(spark, vocabularies, monkeypatch):
    monkeypatch.setattr(t, "KEPT", 3)
    rows = [(i if i != 4 else None, x) for i, x in enumerate(TEXTS)] + [(3, TEXTS[3])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as n_words", "2 as _text")
    v = vocabularies[0]
    got = t.count_tokens(docs, v).collect()
    key = lambda r: (r[0] is None, r)
    assert sorted(map(tuple, got), key=key) == sorted([(k, len((x or "").encode().split()), brute(v, x)) for k, x in rows], key=key)
    assert t.count_tokens(docs.limit(0), v).collect() == []
    with pytest.raises(ValueError):
        t.Vocabulary({})
