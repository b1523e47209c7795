"""Encoding texts with a public byte-level BPE vocabulary, exactly, by dynamic programming.

Merging pairs greedily and keeping, for every prefix of a word, the unique last token of that
prefix's encoding give the same ids: a token t that ends at position i is the last token of prefix
i exactly if it may stand behind the last token of prefix i - len(t), that is, if encoding the two
joined gives back the two. So one pass over the word with an automaton that names all tokens ending
at each position (a trie with suffix links), and one compatibility test for each, fills the table,
and the ids are read off by following it back. Each distinct word is encoded once a worker.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from koengine.runtime import ship_code

TOKENIZER_DIR = "/opt/tokenizers"
VOCABULARY = "byte_bpe_50k.json"
#: The published pre-tokenisation pattern of this vocabulary.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
CACHE_WORDS = 400_000


def _byte_letters() -> dict[str, int]:
    """The published letters of byte-level vocabularies: printable bytes stand for themselves."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {chr(b): b for b in plain}
    rest = [b for b in range(256) if b not in set(plain)]
    letters.update({chr(256 + i): b for i, b in enumerate(rest)})
    return letters


class Encoder:
    """Exact ids of words under a byte-level BPE vocabulary (JSON with ``vocab`` and ``merges``)."""

    def __init__(self, blob: bytes, pattern: str = PATTERN):
        import ahocorasick
        import regex

        model = json.loads(blob)["model"]
        letters = _byte_letters()
        special = {t["id"] for t in json.loads(blob).get("added_tokens", [])}
        vocab = {bytes(letters[c] for c in w): i for w, i in model["vocab"].items() if i not in special}
        raw = {w: i for w, i in model["vocab"].items()}
        self.pairs: dict[tuple[int, int], int] = {}
        self.left: dict[int, int] = {i: i for b, i in vocab.items() if len(b) == 1}
        self.right: dict[int, int] = dict(self.left)
        #: Tokens are compared by the rank of the merge that makes them, bytes rank lowest.
        self.rank: dict[int, int] = {i: -1 - n for n, i in enumerate(self.left)}
        for n, m in enumerate(model["merges"]):
            a, b = m.split(" ") if isinstance(m, str) else m
            t = raw[a + b]
            if (raw[a], raw[b]) in self.pairs or t in self.rank:
                continue
            self.pairs[raw[a], raw[b]] = t
            self.left[t], self.right[t], self.rank[t] = raw[a], raw[b], n
        self.automaton = ahocorasick.Automaton()
        for b, i in vocab.items():
            if i in self.rank:
                self.automaton.add_word(b.decode("latin-1"), (len(b), i))
        self.automaton.make_automaton()
        self.whole = {b: i for b, i in vocab.items() if i in self.rank}
        self.find = regex.compile(pattern).findall
        self.cache: dict[str, list[int]] = {}
        self.fits: dict[tuple[int, int], bool] = {}
        self.own: dict[int, bool] = {}

    def compatible(self, a: int, b: int) -> bool:
        """Whether the encoding of the two tokens' joined bytes is the two tokens."""
        got = self.fits.get((a, b))
        if got is None:
            if len(self.fits) > 2_000_000:
                self.fits.clear()
            got = self.fits[a, b] = self._compatible(a, b)
        return got

    def _compatible(self, a: int, b: int) -> bool:
        # Look at the border between a and b while both are taken apart, latest merge first: any
        # pair across the border that would have been merged before its parts went on rules it out.
        limit = float("inf")
        rank, pairs, left, right = self.rank, self.pairs, self.left, self.right
        while True:
            t = pairs.get((a, b))
            if t is not None and rank[t] < limit:
                return False
            whole_a, whole_b = left[a] == a, left[b] == b
            if whole_a and whole_b:
                return True
            # At equal rank the leftmost occurrence merges first, so the left side is the later one to undo.
            if not whole_a and (whole_b or rank[a] > rank[b]):
                limit = rank[a]
                a = right[a]
            else:
                limit = rank[b] + 1
                b = left[b]

    def word(self, word: str) -> list[int]:
        data = word.encode("utf-8")
        one = self.whole.get(data)
        n = len(data)
        last: list[int] = [-1] * (n + 1)
        size = [0] * (n + 1)
        if one is not None and self._is_own(one):
            return [one]
        # matches come by end position, longest first, so position i is settled before any later one
        for end, (k, t) in self.automaton.iter(data.decode("latin-1")):
            i = end + 1
            if size[i]:
                continue
            start = i - k
            if start == 0:
                if self._is_own(t):
                    last[i], size[i] = t, k
            elif size[start] and self.compatible(last[start], t):
                last[i], size[i] = t, k
        out = []
        i = n
        while i > 0:
            out.append(last[i])
            i -= size[i]
        return out[::-1]

    def _is_own(self, t: int) -> bool:
        """Whether merging the token's bytes from scratch gives the token (looked up once a token)."""
        got = self.own.get(t)
        if got is None:
            parts: list[int] = []
            todo = [t]
            while todo:
                x = todo.pop()
                if self.left[x] == x:
                    parts.append(x)
                else:
                    todo += [self.right[x], self.left[x]]
            while len(parts) > 1:
                ranked = [(self.rank[self.pairs[p]], i) for i, p in enumerate(zip(parts, parts[1:])) if p in self.pairs]
                if not ranked:
                    break
                _, i = min(ranked)
                parts[i : i + 2] = [self.pairs[parts[i], parts[i + 1]]]
            got = self.own[t] = parts == [t]
        return got

    def ids(self, text: str | None) -> list[int]:
        if not text:
            return []
        cache, out = self.cache, []
        for w in self.find(text):
            got = cache.get(w)
            if got is None:
                if len(cache) > CACHE_WORDS:
                    cache.clear()
                got = self.word(w)
                if len(w) <= 64:
                    cache[w] = got
            out += got
        return out


#: Encoders of a worker by the digest of their vocabulary file, so equal file names do no harm.
_WORKERS: dict[str, Encoder] = {}


def _encoder(digest: str, blob) -> Encoder:
    if digest not in _WORKERS:
        _WORKERS[digest] = Encoder(blob.value)
    return _WORKERS[digest]


def _vocabulary(df: DataFrame, tokenizer_dir: str, vocabulary: str):
    ship_code(df.sparkSession)
    with open(f"{tokenizer_dir}/{vocabulary}", "rb") as f:
        data = f.read()
    return df.sparkSession.sparkContext.broadcast(data), hashlib.sha256(data).hexdigest()  # one vocabulary file, 1.5 MB


def ids_column(df: DataFrame, text: Column, tokenizer_dir: str = TOKENIZER_DIR, vocabulary: str = VOCABULARY) -> Column:
    """``array<int>`` of the text's ids, without special tokens; empty for null and empty texts."""
    blob, digest = _vocabulary(df, tokenizer_dir, vocabulary)

    @F.pandas_udf(T.ArrayType(T.IntegerType()))
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        enc = _encoder(digest, blob)
        for s in batches:
            yield pd.Series([enc.ids(t) for t in s], dtype=object)

    return encode(text)


def count_column(df: DataFrame, text: Column, tokenizer_dir: str = TOKENIZER_DIR, vocabulary: str = VOCABULARY) -> Column:
    """Number of ids of the text; 0 for null and empty texts."""
    blob, digest = _vocabulary(df, tokenizer_dir, vocabulary)

    @F.pandas_udf(T.LongType())
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        enc = _encoder(digest, blob)
        for s in batches:
            yield pd.Series([len(enc.ids(t)) for t in s], dtype="int64")

    return count(text)


def encode_corpus(df: DataFrame, *, key: str, text: str, tokenizer_dir: str = TOKENIZER_DIR, vocabulary: str = VOCABULARY) -> DataFrame:
    """(key, ids) of every row.

    Defined cases: null and empty texts have an empty list; text that looks like a special token is
    ordinary text; every row of ``df`` gives one row, repeated keys too; an empty table gives no
    rows; further columns are ignored.
    """
    d = df.select(F.col(key).alias("k"), F.col(text).alias("t"))
    return d.select(F.col("k").alias(key), ids_column(d, F.col("t"), tokenizer_dir, vocabulary).alias("ids"))
