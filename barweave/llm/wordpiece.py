"""Numbers of greedy word pieces, by an automaton that never builds the pieces.

The vocabulary is a trie. A node's failure link leads to the node that is left once the longest-match
pieces of the node's string are taken off as far as they are settled, and its popped count says how many
pieces those are. Reading a word then takes a step for each letter and for each link, which is linear in
its length, and the count of its pieces is the sum of the popped counts on the way.
"""

from __future__ import annotations

import json
import unicodedata
from functools import lru_cache

import regex
from pyspark.sql import DataFrame

from .bpe import END, REMEMBERED, byte_letters, default_path
from .common import per_text

NONE = -1


class PieceCounter:
    """Counts the greedy longest-match pieces of words over a set of pieces; a word that cannot be covered counts as one."""

    def __init__(self, pieces):
        self._steps: list[dict[str, int]] = [{}]
        ends = [False]
        for piece in pieces:
            node = 0
            for letter in piece:
                after = self._steps[node].get(letter)
                if after is None:
                    after = self._steps[node][letter] = len(self._steps)
                    self._steps.append({})
                    ends.append(False)
                node = after
            ends[node] = node != 0
        self._fail, self._popped = [NONE] * len(ends), [0] * len(ends)
        layer = [0]
        while layer:
            below = []
            for up in layer:
                for letter, node in self._steps[up].items():
                    below.append(node)
                    if ends[node]:
                        self._fail[node], self._popped[node] = 0, 1
                        continue
                    popped, at = self._popped[up], self._fail[up]
                    while at != NONE and letter not in self._steps[at]:
                        popped += self._popped[at]
                        at = self._fail[at]
                    if at != NONE:
                        self._fail[node], self._popped[node] = self._steps[at][letter], popped
            layer = below

    def count(self, word: str) -> int:
        steps, fail, popped = self._steps, self._fail, self._popped
        node = n = 0
        for letter in word:
            while (after := steps[node].get(letter)) is None:
                n += popped[node]
                node = fail[node]
                if node == NONE:
                    return 1
            node = after
        while node > 0:
            n += popped[node]
            node = fail[node]
        return n if node == 0 else 1


class TokenCounter:
    """Word pieces of whole texts: words as the vocabulary file splits them, pieces by longest match."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            described = json.load(file)
        mark = described["model"]["end_of_word_suffix"]
        pattern = described["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"].replace("\\s", "\\p{White_Space}")
        self._words = regex.compile(pattern).findall
        self._letters = byte_letters()
        self._pieces = PieceCounter(t[: -len(mark)] + END if t.endswith(mark) and len(t) > len(mark) else t for t in described["model"]["vocab"])
        self._known: dict[str, int] = {}

    def _remember(self, word: str) -> int:
        if len(self._known) >= REMEMBERED:
            self._known.clear()
        letters = self._letters
        n = self._known[word] = self._pieces.count("".join([letters[b] for b in word.encode("utf-8")]) + END)
        return n

    def count(self, text: str) -> tuple[int, int]:
        """Words and pieces."""
        if not text.isascii():
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
        known, remember = self._known, self._remember
        words = self._words(text.lower())
        return len(words), sum([known.get(w) or remember(w) for w in words])


@lru_cache(maxsize=2)
def counter(path: str) -> TokenCounter:
    """One counter for each worker process and file."""
    return TokenCounter(path)


def count_tokens(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """``doc_id, n_words, n_tokens`` for every row: words, and greedy longest-match pieces of them all.

    Pieces with the word-end mark match only at the end of a word. Null and empty texts have none; very long ones are counted whole.
    Repeated rows are counted each; an empty table gives an empty result; other columns are not looked at.
    The vocabulary file is read in each worker from ``path``.
    """
    path = path or default_path()

    def make(texts):
        import pyarrow as pa

        counts = [counter(path).count(t) for t in texts]
        return [pa.array([c[i] for c in counts], pa.int64()) for i in range(2)]

    return per_text(docs, make, "n_words bigint, n_tokens bigint", id_col, text_col)
