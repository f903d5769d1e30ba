"""Exact byte-pair encoding of whole texts by dynamic programming over prefixes, and decoding.

For every prefix of a word exactly one token can end its encoding. An automaton over the vocabulary
lists the tokens that are suffixes of the prefix, longest first; the one whose predecessor (the stored
last token of the prefix before it) is compatible with it is stored. Following the stored tokens back
from the end of the word gives the ids that merging by rank would give, without any merging.

Two tokens are compatible if no merge of higher priority would cross the border between them while
their own parts are being merged; that is tested by undoing their merges from the latest on.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata

import regex
from pyspark.sql import DataFrame

from .common import held, per_text

#: Stands for the end of a word inside the automaton; no byte maps to it.
END = "￿"
#: Letters, digits and white space (also that of Unicode) below U+0100: inside a class of a pattern.
_LETTERS, _DIGITS, _SPACE = "a-zA-Z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\xff", "0-9\xb2\xb3\xb9\xbc-\xbe", "\t-\r \x85\xa0"
#: What the vocabulary's pattern finds, and the same for texts below U+0100.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
NARROW = re.compile(f"[{_LETTERS}]+|'s|'t|'re|'ve|'m|'ll|'d|[{_DIGITS}]|[^{_SPACE}{_LETTERS}{_DIGITS}]+")
WIDE = re.compile("[^\x00-\xff]").search
#: Words of a generation that a worker remembers: the one before is kept, and what is used again moves on.
REMEMBERED = 150_000
#: Pairs of tokens whose test a worker remembers.
PAIRS = 400_000


def byte_letters() -> list[str]:
    """The printable letter for every byte: itself where it is printable, else the next one from U+0100 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b if b in plain else next(spare)) for b in range(256)]


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class WordBpe:
    """Encoder for a vocabulary whose words are lower-cased, split by a pattern, and end in a mark."""

    def __init__(self, path: str):
        import ahocorasick

        with open(path, encoding="utf-8") as file:
            described = json.load(file)
        model, normal, pre = described["model"], described["normalizer"], described["pre_tokenizer"]
        kinds = [n["type"] for n in normal["normalizers"]], [p["type"] for p in pre["pretokenizers"]]
        if model["type"] != "BPE" or kinds != (["NFC", "Replace", "Lowercase"], ["Split", "ByteLevel"]) or described["decoder"]:
            raise ValueError("only the word-end BPE layout is supported")
        mark = model["end_of_word_suffix"]
        vocab: dict[str, int] = model["vocab"]
        self.names = {i: t for t, i in vocab.items()}
        self.special = {t["content"]: t["id"] for t in described["added_tokens"]}
        self.names |= {i: t for t, i in self.special.items()}
        self._special = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        # White space never reaches a word, so the pattern alone does what replacing it by spaces does.
        pattern = pre["pretokenizers"][0]["pattern"]["Regex"].replace("\\s", "\\p{White_Space}")
        self._words = regex.compile(pattern).findall
        self._narrow = NARROW.findall if pre["pretokenizers"][0]["pattern"]["Regex"] == PATTERN else self._words
        self._letters = {b: c for b, c in enumerate(byte_letters())}
        #: Merge rank of a pair of ids; the two parts and the rank of a token that a merge makes.
        self._rank: dict[tuple[int, int], int] = {}
        self._parts: dict[int, tuple[int, int, int]] = {}
        for rank, (left, right) in enumerate(model["merges"]):
            pair, made = (vocab[left], vocab[right]), vocab[left + right]
            self._rank.setdefault(pair, rank)
            self._parts.setdefault(made, (*pair, rank))
        self._fits: dict[int, bool] = {}
        automaton = ahocorasick.Automaton()
        for token, i in vocab.items():
            text = token[: -len(mark)] + END if token.endswith(mark) and len(token) > len(mark) else token
            automaton.add_word(text, (i, len(text) - 1))
        automaton.make_automaton()
        self._suffixes = automaton.iter
        #: Tokens of a word, joined by a space (none holds one); the ids follow from them.
        self._known: dict[str, str] = {}
        self._older: dict[str, str] = {}
        self._decimal = {t: str(i) for i, t in self.names.items()}
        if len(self._decimal) < len(self.names) or any(" " in t for t in self._decimal):
            raise ValueError("tokens must differ and hold no space")

    def fits(self, left: int, right: int) -> bool:
        """Whether merging leaves ``left`` and ``right`` side by side as they are."""
        key = left << 20 | right
        known = self._fits.get(key)
        if known is None:
            if len(self._fits) >= PAIRS:
                self._fits.clear()
            known = self._fits[key] = self._compatible(left, right)
        return known

    def _compatible(self, left: int, right: int) -> bool:
        rank, parts, latest = self._rank, self._parts, 1 << 40
        while True:
            crossing = rank.get((left, right))
            if crossing is not None and crossing < latest:
                return False
            a, b = parts.get(left), parts.get(right)
            # Undo the later of the two merges; what it made was not there yet when earlier ranks were merged.
            if a and (not b or a[2] > b[2]):
                left, latest = a[1], a[2]
            elif b:
                right, latest = b[0], b[2] + 1
            else:
                return True

    def word(self, mapped: str) -> list[int]:
        """Ids of one word, given in byte letters."""
        text = mapped + END
        # By the place of its last letter: the token that ends a prefix, where there is one yet, and the place before the token.
        last: list[int | None] = [None] * len(text)
        left = [-1] * len(text)
        known, fits = self._fits.get, self.fits
        for end, (token, back) in self._suffixes(text):
            if last[end] is None:
                before = end - back - 1
                if before >= 0:
                    a = last[before]
                    if a is None:
                        continue
                    fit = known(a << 20 | token)
                    if not (fits(a, token) if fit is None else fit):
                        continue
                last[end] = token
                left[end] = before
        ids = []
        at = len(text) - 1
        while at >= 0:
            ids.append(last[at])
            at = left[at]
        return ids[::-1]

    def _remember(self, word: str) -> str:
        """What is not in this generation: from the one before, or worked out."""
        if len(self._known) >= REMEMBERED:
            self._older = dict(self._known)
            self._known.clear()
        found = self._older.get(word)
        if found is None:
            found = self._worked_out(word)
        self._known[word] = found
        return found

    def _worked_out(self, word: str) -> str:
        mapped = word if word.isascii() else "".join(map(self._letters.__getitem__, word.encode("utf-8")))
        if not mapped.isprintable():
            mapped = "".join(map(self._letters.__getitem__, word.encode("utf-8")))
        names = self.names
        return " ".join([names[i] for i in self.word(mapped)])

    def _pieces(self, text: str) -> list[str]:
        words = self._narrow
        if not text.isascii():
            # Lower-casing goes letter by letter, so a final sigma is like any other.
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
            if WIDE(text):
                words = self._words
        known, remember = self._known, self._remember
        return [known.get(w) or remember(w) for w in words(text.lower())]

    def encode_parts(self, text: str) -> tuple[int, str, str]:
        """Number of ids; the ids in decimal and the decoded tokens, each joined by a space."""
        if self._special is not None and "<" in text and self._special.search(text):
            pieces = []
            for i, part in enumerate(self._special.split(text)):
                pieces += [part] if i % 2 else self._pieces(part)
        else:
            pieces = self._pieces(text)
        decoded = " ".join(pieces)
        ids = [self._decimal[t] for t in decoded.split(" ")] if pieces else []
        return len(ids), " ".join(ids), decoded

    def encode(self, text: str) -> list[int]:
        return [int(i) for i in self.encode_parts(text)[1].split()]

    def decode(self, ids: list[int]) -> str:
        """The vocabulary has no decoder: its tokens as they are, joined by a space."""
        return " ".join([self.names[i] for i in ids if i in self.names])


def encoder(path: str) -> WordBpe:
    """One encoder for each worker process and file."""
    return held(("bpe", path), lambda: WordBpe(path))


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """``doc_id, n_tokens, ids, decoded`` for every row: the ids in order, and the text they decode to.

    Null counts as the empty text, which has no ids and decodes to ''; very long texts are encoded whole. Rows keep their number; ids may
    repeat or be null; other columns are not looked at. The vocabulary file is read in each worker from
    ``path``, which must lead to it on every machine.
    """
    path = path or default_path()

    def make(texts):
        import pyarrow as pa

        bpe = encoder(path)
        parts = [bpe.encode_parts(t) for t in texts]
        ids = pa.array([[int(i) for i in p[1].split()] for p in parts], pa.list_(pa.int32()))
        return [pa.array([p[0] for p in parts], pa.int64()), ids, pa.array([p[2] for p in parts], pa.string())]

    return per_text(docs, make, "n_tokens bigint, ids array<int>, decoded string", id_col, text_col)


def encode_digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256``: as :func:`encode`, but digests in the place of ids and text.

    The digests are of the decimal ids joined by one space and of the decoded text in UTF-8, taken in
    the worker that encodes, so that neither leaves it.
    """
    path = path or default_path()

    def digest(text: str) -> str:
        return hashlib.sha256(text.encode("utf-8")).hexdigest()

    def make(texts):
        import pyarrow as pa

        bpe = encoder(path)
        made = []
        for text in texts:
            n, ids, decoded = bpe.encode_parts(text)
            made.append((n, digest(ids), digest(decoded)))
        return [pa.array([m[i] for m in made], kind) for i, kind in enumerate((pa.int64(), pa.string(), pa.string()))]

    return per_text(docs, make, "n_tokens bigint, ids_sha256 string, decoded_sha256 string", id_col, text_col)
