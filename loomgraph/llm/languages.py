"""Language models on character n-grams, and the labels they learn from.

``Profiles`` are hyperdimensional: letters are random vectors, an n-gram binds its permuted letters,
a text bundles its n-grams, and cosine compares it with the prototypes of the languages.
``Regression`` is multinomial logistic regression on hashed n-grams.
Both are fitted on the driver from a sample whose size is bounded by parameters; texts are scored in
Arrow batches on the executors.
"""

from __future__ import annotations

import re
import unicodedata
import zlib

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.llm import prose
from loomgraph.storage import bounded

#: Bounds of the sample: documents a language, characters of each, distinct sentences a language.
SAMPLE_DOCS, SAMPLE_CHARS, SAMPLE_SENTENCES = 120, 3000, 300
NONE = "zxx"


def label_map(lang_codes) -> dict[str, str]:
    """Every spelling of a language (code, three-letter code, name; lower case) to its code. ``lang_codes``: rows of code, name, iso3."""
    out = {}
    for r in lang_codes:
        for x in (r["code"], r["iso3"], r["name"]):
            if x:
                out[x.strip().lower()] = r["code"]
    return out


def canonical(label: Column, lang_codes: DataFrame) -> Column:
    """The code that a label means, or null. Case, blanks and a region after the code do not matter.

    ``lang_codes`` is a fixed table of few rows, which is checked; its spellings become a literal map.
    """
    pairs = label_map(bounded(lang_codes).collect())
    known = F.create_map(*[F.lit(x) for kv in sorted(pairs.items()) for x in kv])
    x = F.lower(F.trim(label))
    return F.coalesce(known[x], known[F.regexp_extract(x, r"^([a-z]{2,3})[-_]", 1)])


def sample(documents: DataFrame, code: Column, docs: int = SAMPLE_DOCS, chars: int = SAMPLE_CHARS) -> list[tuple[str, str]]:
    """(language, beginning of the text) of at most ``docs`` documents a language, chosen by the hash of their texts.

    ``code`` is the language's code of a row. Ranked within input partitions first, so that no language gathers in a task.
    """
    rank = Window.partitionBy("code").orderBy("h", "text")
    rows = documents.select(code.alias("code"), F.substring("text", 1, chars).alias("text"), F.xxhash64("text").alias("h")).where("code is not null and text is not null")
    rows = rows.withColumn("r", F.row_number().over(rank)).where(F.col("r") <= docs)
    return [(r["code"], r["text"]) for r in rows.select("code", "text", "h").collect()]


def sentence_set(pairs: list[tuple[str, str]], most: int = SAMPLE_SENTENCES) -> tuple[list[str], list[str]]:
    """Distinct sentences with their language, from texts whose labels may be wrong or too narrow.

    A sentence that occurs in several texts takes the label that most of them have; another one keeps its
    text's label unless a first model is sure of a different language.
    """
    votes: dict[str, dict[str, int]] = {}
    for lang, text in pairs:
        for s in set(prose.sentences(text)):
            v = votes.setdefault(s, {})
            v[lang] = v.get(lang, 0) + 1
    texts, labels, sure = [], [], []
    for s in votes:
        lang = max(votes[s], key=lambda x: (votes[s][x], x))
        texts.append(s)
        labels.append(lang)
        second = max((n for x, n in votes[s].items() if x != lang), default=0)
        sure.append(votes[s][lang] >= 3 and votes[s][lang] >= 1.5 * second)
    order = sorted(range(len(texts)), key=lambda i: (not sure[i], zlib.crc32(texts[i].encode("utf-8", "replace")), texts[i]))

    def first(chosen: list[int], n: int) -> list[int]:
        seen: dict[str, int] = {}
        out = []
        for i in chosen:
            seen[labels[i]] = seen.get(labels[i], 0) + 1
            if seen[labels[i]] <= n:
                out.append(i)
        return out

    kept = first(order, most + most // 3)
    for least in (0.8, 0.0):
        if len({labels[i] for i in kept}) > 1:
            part = [texts[i] for i in kept]
            got, confidence = Profiles(1024).fit(part, [labels[i] for i in kept], 0).predict(part)
            kept = [i for i, g, c in zip(kept, got, confidence) if g == labels[i] or sure[i] or c < least]
    kept = first(kept, most)
    return [texts[i] for i in kept], [labels[i] for i in kept]


def _points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts in lower case, each between blanks, and where each begins (and the end)."""
    texts = [" " + re.sub(r"[\W\d_]+", " ", t.lower()).strip() + " " for t in texts]
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    return np.frombuffer("".join(texts).encode("utf-32-le", "replace"), np.uint32).astype(np.int64), np.concatenate(([0], np.cumsum(lengths)))


def _normal(text: str) -> str:
    return unicodedata.normalize("NFC", text)


# The letters of each script, as first and last points.
_SCRIPTS = [
    [(0x41, 0x5A), (0x61, 0x7A), (0xC0, 0x24F), (0x1E00, 0x1EFF)], [(0x400, 0x52F)], [(0x3040, 0x30FF)], [(0x3400, 0x9FFF)], [(0xAC00, 0xD7AF), (0x1100, 0x11FF)], [(0x370, 0x3FF)], [(0x590, 0x6FF)], [(0x900, 0xDFF), (0xE00, 0xEFF)],
]
_KANA = 2
_SCRIPT_OF = np.full(0x110000, len(_SCRIPTS), np.uint8)
for _i, _ranges in enumerate(_SCRIPTS):
    for _a, _b in _ranges:
        _SCRIPT_OF[_a : _b + 1] = _i


def scripts(points: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The script of most letters of each text (of ``_points``); Japanese if a tenth of them is kana. -1: no letters."""
    texts, k = len(starts) - 1, len(_SCRIPTS) + 1
    owner = np.repeat(np.arange(texts), np.diff(starts))
    n = np.bincount(owner * k + _SCRIPT_OF[points], minlength=texts * k).reshape(texts, k)[:, :-1]
    total = n.sum(1)
    return np.where(total == 0, -1, np.where(n[:, _KANA] * 10 >= total, _KANA, n.argmax(1)))


def script_mask(texts: list[str], labels: list[str], languages: list[str]) -> np.ndarray:
    """(script, language): 0 where at least a twentieth of a language's sentences has the script, else a large negative number."""
    n = np.zeros((len(_SCRIPTS) + 1, len(languages)))
    np.add.at(n, (scripts(*_points([_normal(t) for t in texts])), [languages.index(x) for x in labels]), 1)
    mask = np.where(n >= 0.05 * np.maximum(n.sum(0), 1), 0.0, -1e3)
    mask[-1] = 0
    mask[(mask < 0).all(1)] = 0
    return mask.astype(np.float32)


#: Slots of the table of n-grams that a worker keeps, and the most scores in it: 24 MB, and 16 MB at 20 languages.
_SLOT_BITS, _MOST_SCORES = 21, 200_000


class Profiles:
    """Hyperdimensional language profiles of letter n-grams (n = 3)."""

    def __init__(self, size: int = 2048, seed: int = 7):
        self.size, self.seed = size, seed
        self.languages: list[str] = []  # none until fitted
        self.letters: dict[int, np.ndarray] = {}

    def _letter(self, point: int) -> np.ndarray:
        v = self.letters.get(point)
        if v is None:
            v = self.letters[point] = np.random.default_rng((self.seed, point)).integers(0, 2, self.size).astype(np.float32) * 2 - 1
        return v

    def _bound(self, gram: int) -> np.ndarray:
        a, b, c = gram >> 42, (gram >> 21) & 0x1FFFFF, gram & 0x1FFFFF
        return np.roll(self._letter(a), 2) * np.roll(self._letter(b), 1) * self._letter(c)

    @staticmethod
    def _grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The trigrams of each text and how many each text has; a text has at least one."""
        return Profiles._cut(*_points([_normal(t) or " " for t in texts]))

    @staticmethod
    def _cut(p: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        p = np.concatenate((p, [32, 32]))
        grams = (p[:-2] << 42) | (p[1:-1] << 21) | p[2:]
        counts = np.maximum(np.diff(at) - 2, 1)
        starts = np.repeat(at[:-1] - np.concatenate(([0], np.cumsum(counts)[:-1])), counts)
        return grams[starts + np.arange(counts.sum())], counts

    def fit(self, texts: list[str], labels: list[str], rounds: int = 30) -> Profiles:
        """Prototypes: the bundles of each language's sentences, less what all share; sentences that are nearer to
        another prototype are then added to their own and taken from the other."""
        self.languages = sorted(set(labels))
        y = np.array([self.languages.index(x) for x in labels])
        grams, counts = self._grams(texts)
        distinct, at = np.unique(grams, return_inverse=True)
        bound = np.empty((len(distinct), self.size), np.int8)
        for i, g in enumerate(distinct.tolist()):
            bound[i] = self._bound(g)
        encoded = np.empty((len(texts), self.size), np.float32)
        for i, own in enumerate(np.split(at, np.cumsum(counts)[:-1])):
            encoded[i] = bound[own].sum(0, dtype=np.int16)
        del bound
        encoded /= np.linalg.norm(encoded, axis=1, keepdims=True)
        p = np.zeros((len(self.languages), self.size), np.float32)
        for k in range(len(p)):
            p[k] = encoded[y == k].mean(0)
        p -= p.mean(0)
        p /= np.maximum(np.linalg.norm(p, axis=1, keepdims=True), 1e-9)
        points = _points([_normal(t) or " " for t in texts])
        self.mask = script_mask(texts, labels, self.languages)
        mask, margin = self.mask[scripts(*points)], 0.1
        for _ in range(rounds if len(p) > 1 else 0):
            c = encoded @ p.T + mask
            right = c[np.arange(len(y)), y].copy()
            c[np.arange(len(y)), y] = -np.inf
            other = c.argmax(1)
            wrong = np.flatnonzero((right - c[np.arange(len(y)), other] < margin) & (c[np.arange(len(y)), other] > -10))
            if not len(wrong):
                break
            for k in range(len(p)):
                p[k] += 0.5 / max(1, (y == k).sum()) * (encoded[wrong[y[wrong] == k]].sum(0) - encoded[wrong[other[wrong] == k]].sum(0))
            p /= np.maximum(np.linalg.norm(p, axis=1, keepdims=True), 1e-9)
        self.prototypes = p
        self._forget()
        return self

    def _forget(self) -> None:
        """Empties the table of scores, which otherwise grows with the n-grams that are met."""
        self.slots = np.full(1 << _SLOT_BITS, -1, np.int64)
        self.rows = np.zeros(1 << _SLOT_BITS, np.int32)
        self.scores = np.zeros((0, len(self.languages)), np.float32)

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k not in ("slots", "rows", "scores", "letters")}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        self.letters = {}
        if self.languages:
            self._forget()

    def _rows(self, grams: np.ndarray) -> np.ndarray:
        """The row of ``scores`` of each n-gram: its bound vector's products with the prototypes, made when it is first met."""
        if len(self.scores) > _MOST_SCORES:
            self._forget()
        slot = ((grams.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - _SLOT_BITS)).astype(np.int64)
        out = self.rows[slot]
        other = np.flatnonzero(self.slots[slot] != grams)
        if len(other):  # not met yet, or a slot's second n-gram, which is made again
            distinct, first, at = np.unique(grams[other], return_index=True, return_inverse=True)
            made = [np.stack([self._bound(g) for g in distinct[i : i + 4096].tolist()]) @ self.prototypes.T for i in range(0, len(distinct), 4096)]
            rows = np.arange(len(self.scores), len(self.scores) + len(distinct), dtype=np.int32)
            self.scores = np.concatenate((self.scores, *made))
            own = slot[other[first]]
            free = self.slots[own] == -1
            self.slots[own[free]], self.rows[own[free]] = distinct[free], rows[free]
            # Of several that fell on one free slot the last stays, with its row.
            out[other] = rows[at]
        return out

    def cosines(self, texts: list[str]) -> np.ndarray:
        """Cosine of each text's bundle with each prototype; languages that are not written in a text's script are far below.

        Trigrams that no labelled sentence holds are noise to every prototype, and a short text of many letters, as in Chinese, can
        hold none but such; its letters' script still tells which languages it can be in.

        A dot product is a sum over n-grams, so an n-gram's products with the prototypes are made once;
        bound vectors of different n-grams are orthogonal but for chance, which gives the bundle's length.
        """
        out = [np.zeros((0, len(self.languages)), np.float32)]
        for i in range(0, len(texts), 4000):
            points = _points([_normal(t) or " " for t in texts[i : i + 4000]])
            grams, counts = self._cut(*points)
            rows = self._rows(grams)
            starts = np.concatenate(([0], np.cumsum(counts)[:-1]))
            dots = np.stack([np.add.reduceat(column[rows], starts) for column in np.ascontiguousarray(self.scores.T)], 1)
            owner = np.repeat(np.arange(len(counts), dtype=np.int64), counts)
            pair = np.sort((owner << 32) | rows)
            cuts = np.flatnonzero(np.concatenate(([True], pair[1:] != pair[:-1])))
            times = np.diff(np.append(cuts, len(pair))).astype(np.float64)
            square = np.bincount(pair[cuts] >> 32, weights=times * times, minlength=len(counts))
            out.append((dots / np.sqrt(square * self.size)[:, None] + self.mask[scripts(*points)]).astype(np.float32))
        return np.concatenate(out)

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        """The language of each text, and a confidence: the softmax of its cosines at the best one."""
        c = self.cosines(texts)
        best = c.argmax(1) if len(c) else np.zeros(0, int)
        e = np.exp((c - c.max(1, keepdims=True)) * 40) if len(c) else c
        return [self.languages[i] for i in best], (1 / e.sum(1) if len(c) else np.zeros(0))


class Regression:
    """Multinomial logistic regression on hashed letter n-grams (n = 1 to 4), fitted by gradient descent from the n-grams' log odds."""

    def __init__(self, bits: int = 16, rounds: int = 8, rate: float = 5.0, decay: float = 1e-6, most: int = 300, smooth: float = 0.5, scale: float = 1.0):
        self.smooth, self.scale = smooth, scale
        self.languages: list[str] = []  # none until fitted
        self.bits, self.rounds, self.rate, self.decay, self.most = bits, rounds, rate, decay, most

    def _features(self, p: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Hashed n-grams of texts (``_points``) text by text, where each text's begin, and each text's weight of an n-gram."""
        pad = np.concatenate((p, np.full(3, 32)))
        h, out = np.zeros(len(p), np.uint64), []
        for n in range(4):
            h = h * np.uint64(0x9E3779B97F4A7C15) + pad[n : n + len(p)].astype(np.uint64) + np.uint64(n + 1)
            out.append(((h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(64 - self.bits))
        counts = np.diff(at) * 4
        return np.stack(out, 1).ravel().astype(np.int64), np.concatenate(([0], np.cumsum(counts)[:-1])), 1 / np.sqrt(counts)

    def fit(self, texts: list[str], labels: list[str]) -> Regression:
        """At most ``most`` sentences a language are used."""
        seen: dict[str, int] = {}
        keep = []
        for i, x in enumerate(labels):
            seen[x] = seen.get(x, 0) + 1
            if seen[x] <= self.most:
                keep.append(i)
        texts, labels = [texts[i] for i in keep], [labels[i] for i in keep]
        self.languages = sorted(set(labels))
        k = len(self.languages)
        hashed, starts, weight = self._features(*_points([_normal(t) for t in texts]))
        counts = np.diff(np.concatenate((starts, [len(hashed)])))
        owner = np.repeat(np.arange(len(texts)), counts)
        used, at = np.unique(hashed, return_inverse=True)
        order = np.argsort(at, kind="stable")
        cuts = np.searchsorted(at[order], np.arange(len(used)))
        y = np.array([self.languages.index(x) for x in labels])
        share = (len(y) / k / np.bincount(y, minlength=k))[y] ** 0.5  # rare languages count more
        n = np.stack([np.bincount(at, weights=(y[owner] == j), minlength=len(used)) for j in range(k)], 1) + self.smooth
        w = np.log(n / n.sum(0))
        w = (self.scale * (w - w.mean(1, keepdims=True))).astype(np.float32)
        for _ in range(self.rounds):
            z = np.add.reduceat(np.ascontiguousarray(w.T)[:, at], starts, axis=1).T * weight[:, None]
            z = np.exp(z - z.max(1, keepdims=True))
            z /= z.sum(1, keepdims=True)
            z[np.arange(len(y)), y] -= 1
            z *= (share * weight)[:, None] / len(y)
            g = np.add.reduceat(np.ascontiguousarray(z.T, dtype=np.float32)[:, owner[order]], cuts, axis=1).T + self.decay * w
            w -= self.rate * g
        self.weights = np.zeros((1 << self.bits, k), np.float32)
        self.weights[used] = w
        self.mask = script_mask(texts, labels, self.languages)
        return self

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        """The language of each text and its probability."""
        names, sure, turned = [], [], np.ascontiguousarray(self.weights.T)
        for i in range(0, len(texts), 2000):
            part = texts[i : i + 2000]
            points = _points([_normal(t) for t in part])
            hashed, starts, weight = self._features(*points)
            z = np.stack([np.add.reduceat(row[hashed], starts) for row in turned], 1) * weight[:, None] + self.mask[scripts(*points)]
            z = np.exp(z - z.max(1, keepdims=True))
            z /= z.sum(1, keepdims=True)
            best = z.argmax(1)
            names += [self.languages[j] for j in best]
            sure.append(z[np.arange(len(best)), best])
        return names, (np.concatenate(sure) if sure else np.zeros(0))


def settle(cosines: np.ndarray, counts: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """The language and confidence of each sentence of several texts, from the sentences' cosines; ``counts``: sentences of each text.

    A sentence that is close between languages goes to one that another sentence of its text is surely in.
    """
    n = np.array([c for c in counts if c], np.int64)
    owner = np.repeat(np.arange(len(n)), n)
    rows = np.arange(len(cosines))
    e = np.exp((cosines - cosines.max(1, keepdims=True)) * 40)
    e /= e.sum(1, keepdims=True)
    best = cosines.argmax(1)
    sure = e[rows, best] >= 0.9
    known = np.zeros((len(n), cosines.shape[1]))
    np.add.at(known, (owner[sure], best[sure]), 1)
    total = np.add.reduceat(e, np.cumsum(n) - n, axis=0) if len(n) else known
    known = np.where(known.any(1, keepdims=True), known > 0, total >= total.max(1, keepdims=True))
    shifted = e * np.where(known, 1.0, 0.08)[owner]
    shifted /= shifted.sum(1, keepdims=True)
    alone = sure | (n == 1)[owner]
    best = np.where(alone, best, shifted.argmax(1))
    return best, np.where(alone, e[rows, best], shifted[rows, best])
