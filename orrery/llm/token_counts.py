"""Token counts under a unigram vocabulary, by dynamic programming on a trie of pre-tokens.

A text's pre-tokens are its words with a word mark before each. Their best segmentation maximises the sum of the
pieces' scores. A task keeps one trie of all pre-tokens that it has met: a node holds the forward score and the count of
tokens of the best segmentation up to it, computed once when the node is made, so all words that begin alike, in whatever
batch they come, share that work; the node where a word ends is that word's count. Texts then add up stored counts.

A character that no piece covers scores less than any piece and counts as its UTF-8 bytes. The vocabulary is a public
tokenizer's; where its scores are ranks, the score of a piece is the log of a Zipf law of its rank. A vocabulary is
fixed and small, so it is broadcast; the corpus is read once and not shuffled.

Defined results: a null or empty text, or one of blanks, has no tokens; words of any length are counted whole; equal
rows get equal counts; an empty table gives an empty result. Only the named columns are read, so other columns cannot
clash.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import small_batches

MARK = "▁"
#: Where the vocabulary is; a parameter of the query.
MODEL = "/opt/tokenizers/piece_bpe_32k.model"
#: Words and trie nodes that a task keeps; beyond, it starts anew, which costs time only.
KEPT, KEPT_NODES = 1_000_000, 1_500_000
#: Characters of a word that become nodes; longer words are counted whole, but not kept.
KEPT_CHARS = 64


@dataclass
class Vocabulary:
    scores: dict[str, float]

    def __post_init__(self) -> None:
        if not self.scores:
            raise ValueError("a vocabulary has pieces")
        self.longest = max(map(len, self.scores))
        self.unknown = min(self.scores.values()) - 10.0

    @classmethod
    def ranked(cls, pieces: Sequence[str]) -> Vocabulary:
        """Scores by a Zipf law of the pieces' ranks."""
        return cls({p: -math.log(i + 1.0) - math.log(math.log(len(pieces) + 2.0)) for i, p in reversed(list(enumerate(pieces)))})

    @classmethod
    def load(cls, path: str = MODEL) -> Vocabulary:
        """The pieces of a sentencepiece model in order, without its control and byte pieces."""
        import sentencepiece

        m = sentencepiece.SentencePieceProcessor(model_file=path)
        own = (i for i in range(m.get_piece_size()) if not (m.is_control(i) or m.is_unknown(i) or m.is_byte(i) or m.is_unused(i)))
        return cls.ranked([m.id_to_piece(i) for i in own])


class TrieCounter:
    """Token counts of words, by a trie that grows with the words it meets."""

    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary
        self.scored = 0  # nodes that were ever made, and so scored
        self.clear()

    def clear(self) -> None:
        self.known: dict[bytes, int] = {}  # words that end at a node, with its count
        self.children: dict[int, int] = {}  # a node's number and a character, as one number: the node below
        self.best, self.tokens = [0.0], [0]  # forward score and count of tokens of each node; the root's are nothing

    def insert(self, words: Iterable[str]) -> dict[str, int]:
        """Each word's count of tokens. Words come sorted, so one keeps the path that it shares with the one before; from
        there known nodes are followed, and nodes are made for the rest."""
        get, longest, unknown = self.v.scores.get, self.v.longest, self.v.unknown
        children, all_best, all_tokens = self.children, self.best, self.tokens
        path, best, tokens, last, out = [0], [0.0], [0], "", {}
        for word in words:
            w = MARK + word
            shared = 0
            for x, y in zip(last, w, strict=False):
                if x != y:
                    break
                shared += 1
            del path[shared + 1 :], best[shared + 1 :], tokens[shared + 1 :]
            for end in range(shared + 1, len(w) + 1):
                if end <= KEPT_CHARS:
                    key = path[-1] << 21 | ord(w[end - 1])
                    if (node := children.get(key)) is not None:
                        path.append(node)
                        best.append(all_best[node])
                        tokens.append(all_tokens[node])
                        continue
                top, count = -math.inf, 0
                for start in range(end - longest if end > longest else 0, end):
                    if (s := get(w[start:end])) is not None and (z := best[start] + s) > top:
                        top, count = z, tokens[start] + 1
                if (z := best[-1] + unknown) > top and get(w[end - 1]) is None:
                    top, count = z, tokens[-1] + len(w[end - 1].encode("utf-8", "surrogatepass"))
                self.scored += 1
                if end <= KEPT_CHARS:
                    children[key] = len(all_best)
                    path.append(len(all_best))
                    all_best.append(top)
                    all_tokens.append(count)
                else:
                    path.append(-1)
                best.append(top)
                tokens.append(count)
            last, out[word] = w, tokens[-1]
        return out

    def total(self, texts: Sequence[str | None]) -> tuple[list[int], list[int]]:
        """(words, tokens) of the texts."""
        if len(self.known) > KEPT or len(self.best) > KEPT_NODES:
            self.clear()
        known, split = self.known, [(t or "").encode("utf-8", "surrogatepass").split() for t in texts]
        fresh = {w.decode("utf-8", "surrogatepass"): w for ws in split for w in ws if w not in known}
        long = []
        for word, count in self.insert(sorted(fresh)).items():
            known[fresh[word]] = count
            if len(word) > KEPT_CHARS:
                long.append(fresh[word])
        totals = [sum(map(known.__getitem__, ws)) for ws in split]
        for w in long:
            del known[w]
        return [len(ws) for ws in split], totals


def count_tokens(docs: DataFrame, vocabulary: Vocabulary, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, n_words and n_tokens (long) of every row."""
    held = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = TrieCounter(held.value)
        for b in batches:
            words, tokens = counter.total(b.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(words, pa.int64()), pa.array(tokens, pa.int64())], names=[key, "n_words", "n_tokens"])

    small_batches(docs.sparkSession)
    rows = docs.select(F.col(f"`{key}`").alias(key), F.col(f"`{text}`").alias("_text"))
    return rows.mapInArrow(run, rows.select(key).schema.add("n_words", "long").add("n_tokens", "long"))
