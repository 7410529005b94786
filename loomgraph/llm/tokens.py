"""Encoding a corpus with a public byte-level BPE vocabulary (problem 8)."""

from __future__ import annotations

import base64
import os
from collections.abc import Callable, Iterator

import pandas as pd
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Folder of the vocabularies.
TOKENIZERS = "/opt/tokenizers"
# Fixed value: the pattern that cuts text into words before merges.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class TrieEncoder:
    """Byte-level BPE by depth-first traversal of the trie of distinct words.

    A merge-based encoding has a property that makes it a walk: the encoding of a prefix is the encoding of
    a shorter prefix plus one last token, and that token is the only one, among the vocabulary's suffixes of
    the prefix, that stays apart from the token before it. So each trie node needs its last token only, and words
    with a common prefix share the nodes of it. Sorted words are visited in the trie's depth-first order, so
    the path to the current node is all that is kept.
    """

    def __init__(self, ranks: dict[bytes, int], most_words: int = 200_000):
        self.ranks, self.longest, self.most_words = ranks, max(map(len, ranks)), most_words
        self.pattern = regex.compile(WORDS)
        self.apart: dict[tuple[bytes, bytes], bool] = {}
        self.known: dict[str, list[int]] = {}

    def _merge(self, text: bytes) -> list[bytes]:
        """Merges by rank, the definition of the encoding; only used on one or two tokens' bytes."""
        parts = [text[i : i + 1] for i in range(len(text))]
        while len(parts) > 1:
            best = min((self.ranks.get(a + b, 1 << 60), i) for i, (a, b) in enumerate(zip(parts, parts[1:])))
            if best[0] == 1 << 60:
                break
            pair = parts[best[1]] + parts[best[1] + 1]
            parts[best[1] : best[1] + 2] = [pair]
        return parts

    def _stays(self, before: bytes, token: bytes) -> bool:
        key = (before, token)
        got = self.apart.get(key)
        if got is None:
            if len(self.apart) > 500_000:
                self.apart.clear()
            got = self.apart[key] = self._merge(before + token) == ([before, token] if before else [token])
        return got

    def encode_words(self, words: list[str]) -> None:
        """Puts the ids of each word into ``known``."""
        ranks, longest = self.ranks, self.longest
        path: list[bytes] = [b""]  # path[n]: the last token of the current word's first n bytes
        previous = b""
        for raw, word in sorted((w.encode("utf-8", "replace"), w) for w in words):
            shared, top = 0, min(len(raw), len(previous))
            while shared < top and raw[shared] == previous[shared]:
                shared += 1
            del path[shared + 1 :]
            for end in range(shared + 1, len(raw) + 1):
                for start in range(max(0, end - longest), end):
                    token = raw[start:end]
                    if token in ranks and self._stays(path[start], token):
                        path.append(token)
                        break
                else:
                    raise ValueError("the vocabulary lacks single bytes")
            ids, at = [], len(raw)
            while at:
                ids.append(ranks[path[at]])
                at -= len(path[at])
            self.known[word] = ids[::-1]
            previous = raw

    def encode_batch(self, texts: list[str | None]) -> list[list[int]]:
        """The ids of each text; none for null and empty texts."""
        cut = [self.pattern.findall(t) if t else [] for t in texts]
        if len(self.known) > self.most_words:
            self.known = {}
        self.encode_words(list({w for words in cut for w in words if w not in self.known}))
        return [[i for w in words for i in self.known[w]] for words in cut]


def load_ranks(path: str) -> dict[bytes, int]:
    """The ranks of a ``.tiktoken`` file."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


_ENCODERS: dict[str, TrieEncoder] = {}


def encoder(path: str) -> TrieEncoder:
    """The encoder of a file, made once a Python worker."""
    if path not in _ENCODERS:
        _ENCODERS[path] = TrieEncoder(load_ranks(path))
    return _ENCODERS[path]


def encode(documents: DataFrame, key: str = "doc_id", text: str = "text", tokenizer: str = f"{TOKENIZERS}/byte_bpe_50k.tiktoken") -> DataFrame:
    """(key, ids): the token ids of each text, without special tokens; an empty list for null and empty texts.

    Row by row in Arrow batches, without a shuffle: each task keeps the words it has met, and inserts only new ones.
    Blank texts are text. Repeated keys give repeated rows; other columns are left out. The vocabulary's file need
    only be on the driver, which sends it to the executors.
    """
    return _batches(documents, key, text, tokenizer, "ids array<int>", lambda ids: ids)


def count_tokens(documents: DataFrame, key: str = "doc_id", text: str = "text", tokenizer: str = f"{TOKENIZERS}/byte_bpe_50k.tiktoken") -> DataFrame:
    """``documents`` reduced to ``key`` and ``tokens``, the number of ids of each text."""
    return _batches(documents, key, text, tokenizer, "tokens bigint", len)


def shared_file(spark: SparkSession, path: str) -> Callable[[], str]:
    """Sends a file to the executors, once a session; gives a function that tells a task where it lies."""
    context = spark.sparkContext
    sent = context.__dict__.setdefault("_loomgraph_files", set())
    if path not in sent:
        context.addFile(path)
        sent.add(path)
    name = os.path.basename(path)
    return lambda: SparkFiles.get(name)


def _batches(documents: DataFrame, key: str, text: str, tokenizer: str, column: str, make) -> DataFrame:
    name = column.split()[0]
    place = shared_file(documents.sparkSession, tokenizer)
    kind = documents.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = encoder(place())
        for pdf in batches:
            for i in range(0, len(pdf), 1000):
                part = pdf.iloc[i : i + 1000]
                texts = [t if isinstance(t, str) else None for t in part["__text"]]
                yield pd.DataFrame({key: part["__key"].to_numpy(), name: [make(x) for x in own.encode_batch(texts)]}, columns=[key, name])

    return documents.select(F.col(key).alias("__key"), F.col(text).alias("__text")).mapInPandas(run, f"`{key}` {kind}, {column}")


def available(tokenizer: str = f"{TOKENIZERS}/byte_bpe_50k.tiktoken") -> bool:
    return os.path.exists(tokenizer)
