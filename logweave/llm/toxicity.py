"""Toxicity scores from a weighted lexicon.

Texts are folded (compatibility forms, case, homoglyphs, invisible signs, digits that stand for letters)
and searched for all lexicon entries at once by Aho-Corasick.  An entry matches at the beginning of a
word; a match inside an exception phrase doesn't count.  Weights of a text's matches add up, are
normalised by its length and mapped to 0 .. 1 by a logistic curve.

The lexicon (word beginnings and their log odds), the exceptions and the curve are learned from a
bounded sample of labelled documents outside the held-out fold.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logweave.llm import textarrays as ta
from logweave.llm.labelled import in_fold, sample
from logweave.llm.shared import written

#: Labelled documents that are learned from, at most.
TRAIN_ROWS = 16_000
#: Word beginnings of these lengths are candidates, and whole words up to WORD signs.
SHORTEST, LONGEST, WORD = 4, 7, 24
#: An entry stands in at least so many toxic documents, is so much more likely there (log odds) and so
#: far from chance (log-likelihood ratio; 17 is about 1 in 25,000).
LEAST_DOCS, LEAST_ODDS, LEAST_RATIO = 3, 2.0, 17.0
#: Words after which the normaliser has grown to two.
LENGTH_UNIT = 400

# Signs that look like a Latin letter, digits and signs that stand for one, invisible signs.
HOMOGLYPHS = {
    "а": "a", "в": "b", "с": "c", "ԁ": "d", "е": "e", "ё": "e", "һ": "h", "і": "i", "ї": "i", "ј": "j", "к": "k", "ӏ": "l", "м": "m", "п": "n", "о": "o", "р": "p", "ԛ": "q", "ѕ": "s", "т": "t", "ѵ": "v", "ԝ": "w", "х": "x", "у": "y",
    "α": "a", "β": "b", "ε": "e", "η": "n", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "σ": "o", "τ": "t", "υ": "u", "χ": "x", "ω": "w",
    "ı": "i", "ɡ": "g", "ɑ": "a", "ʏ": "y", "ɪ": "i", "ᴀ": "a", "ᴏ": "o", "ᴜ": "u",
}
DIGITS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s"}
INVISIBLE = "­​‌‍‎‏⁠﻿"

_TABLE = str.maketrans({**HOMOGLYPHS, **DIGITS, **dict.fromkeys(INVISIBLE, "")})
_WORDS = re.compile(r"[^\W_]+")


def fold(text: str | None) -> str:
    """Folded form of a text; null gives the empty text."""
    text = text or ""
    if not text.isascii():
        text = unicodedata.normalize("NFKC", text)
    return text.lower().translate(_TABLE)


def beginnings(word: str) -> list[str]:
    """Lexicon candidates of a folded word."""
    out = [word[:k] for k in range(SHORTEST, min(LONGEST, len(word) - 1) + 1)]
    return [*out, word] if SHORTEST <= len(word) <= WORD else out


@dataclass
class Lexicon:
    """Entries with weights, exception phrases and the curve; a few KB that grow with the sample at most."""

    weights: dict[str, float]
    exceptions: list[str] = field(default_factory=list)
    slope: float = 0.0
    offset: float = 0.0

    def matcher(self) -> Matcher:
        return _matcher(tuple(sorted(self.weights.items())), tuple(sorted(self.exceptions)))

    def score(self, evidence: float) -> float:
        z = self.slope * evidence + self.offset
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


class Matcher:
    """Automaton over entries and exceptions."""

    def __init__(self, weights: dict[str, float], exceptions: tuple[str, ...]):
        self.weights = weights
        self.automaton = ahocorasick.Automaton()
        for word in weights:
            self.automaton.add_word(word, (word, word in exceptions))
        for phrase in exceptions:
            if phrase not in weights:
                self.automaton.add_word(phrase, (phrase, True))
        if len(self.automaton):
            self.automaton.make_automaton()

    def matches(self, folded: str) -> list[tuple[int, str]]:
        """Places and entries that count."""
        if not len(self.automaton):
            return []
        found, covered = [], []
        n = len(folded)
        for end, (phrase, exception) in self.automaton.iter(folded):
            start = end - len(phrase) + 1
            if start and folded[start - 1].isalnum():
                continue
            if exception and (end + 1 == n or not folded[end + 1].isalnum()):
                covered.append((start, end))
            if phrase in self.weights:
                found.append((start, end, phrase))
        if covered:
            found = [f for f in found if not any(a <= f[0] and f[1] <= b for a, b in covered)]
        return [(start, phrase) for start, _, phrase in found]

    def evidence(self, text: str | None) -> float:
        """Weights of the matches, repeats with less and less, over a normaliser that grows with the
        logarithm of the length."""
        folded = fold(text)
        counts = Counter(phrase for _, phrase in self.matches(folded))
        if not counts:
            return 0.0
        words = folded.count(" ") + 1
        return sum(self.weights[p] * (1 + math.log(c)) for p, c in counts.items()) / (1 + math.log2(1 + words / LENGTH_UNIT))


@lru_cache(maxsize=2)
def _matcher(weights: tuple, exceptions: tuple) -> Matcher:
    return Matcher(dict(weights), exceptions)


def _present(parts: Iterator[pa.RecordBatch], features) -> Iterator[pa.RecordBatch]:
    """Documents of each class that have each feature, counted per task."""
    toxic: Counter = Counter()
    clean: Counter = Counter()
    for batch in parts:
        ys = batch.column("y").to_pylist()
        for at, texts in ta.batches(batch.column("text")):
            for k, text in enumerate(texts):
                (toxic if ys[at + k] else clean).update(features(text))
    keys = [*toxic.keys() | clean.keys()]
    yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array([toxic[k] for k in keys], pa.int64()), pa.array([clean[k] for k in keys], pa.int64())], names=["feature", "toxic", "clean"])


def _counted(rows: DataFrame, features) -> DataFrame:
    counted = rows.mapInArrow(lambda parts: _present(parts, features), "feature string, toxic long, clean long")
    return counted.groupBy("feature").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def _word_features(text: str) -> set[str]:
    return {b for w in set(_WORDS.findall(fold(text))) for b in beginnings(w)}


def _log_odds(toxic: int, clean: int, n_toxic: int, n_clean: int) -> float:
    return math.log((toxic + 0.5) / (n_toxic + 1)) - math.log((clean + 0.5) / (n_clean + 1))


def _ratio(toxic: int, clean: int, n_toxic: int, n_clean: int) -> float:
    """Log-likelihood ratio of one rate for both classes against one for each."""

    def part(k: int, n: int) -> float:
        return (k * math.log(k / n) if k else 0.0) + ((n - k) * math.log((n - k) / n) if n > k else 0.0)

    return 2 * (part(toxic, n_toxic) + part(clean, n_clean) - part(toxic + clean, n_toxic + n_clean))


def _phrases(text: str, matcher: Matcher) -> set[str]:
    """Words with a match, alone and with the word before or after."""
    folded = fold(text)
    starts = {s for s, _ in matcher.matches(folded)}
    if not starts:
        return set()
    words = [(m.start(), m.group()) for m in _WORDS.finditer(folded)]
    out = set()
    for i, (start, word) in enumerate(words):
        if start in starts:
            out.add(word)
            if i + 1 < len(words):
                out.add(folded[start : words[i + 1][0] + len(words[i + 1][1])])
            if i:
                out.add(folded[words[i - 1][0] : start + len(word)])
    return {p for p in out if len(p) <= 4 * WORD}


def _curve(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset of a logistic curve, by Newton's method with a small penalty."""
    design = np.stack((x, np.ones_like(x)), 1)
    w = np.array([0.0, math.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5))])
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -30, 30)))
        grad = design.T @ (p - y) + np.array([1e-2, 1e-3]) * w
        hess = (design * (p * (1 - p))[:, None]).T @ design + np.diag([1e-2, 1e-3])
        step = np.linalg.solve(hess, grad)
        w -= np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return float(max(w[0], 0.0)), float(w[1])


def learn(docs: DataFrame, labels: DataFrame, held_out: tuple[int, int] = (4, 2), rows: int = TRAIN_ROWS, exceptions: tuple[str, ...] = ()) -> Lexicon:
    """Lexicon from at most ``rows`` labelled documents outside the fold ``crc32(doc_id) % n == k``.

    ``exceptions`` adds phrases to those learned.  Without toxic (or without any) rows the lexicon is
    empty and all scores are the base rate.
    """
    train = written(sample(docs, labels, "toxic", held_out, rows).select("text", "y"), "toxicity-sample")
    sizes = {r.y: r["count"] for r in train.groupBy("y").count().collect()}
    n_toxic, n_clean = sizes.get(1, 0), sizes.get(0, 0)
    if not n_toxic:
        return Lexicon({}, [], 0.0, math.log(0.5 / (n_clean + 0.5)))
    first = _counted(train.where("y = 1"), _word_features).where(F.col("toxic") >= LEAST_DOCS)
    known = frozenset(r.feature for r in first.collect())
    counted = _counted(train, lambda text: _word_features(text) & known).collect()
    weights: dict[str, float] = {}
    for r in sorted(counted, key=lambda r: (len(r.feature), r.feature)):
        odds = _log_odds(r.toxic, r.clean, n_toxic, n_clean)
        if r.toxic < LEAST_DOCS or odds < LEAST_ODDS or _ratio(r.toxic, r.clean, n_toxic, n_clean) < LEAST_RATIO:
            continue
        shorter = max((weights[r.feature[:k]] for k in range(SHORTEST, len(r.feature)) if r.feature[:k] in weights), default=0.0)
        if odds > shorter + 0.5:
            weights[r.feature] = odds
    found = Matcher(weights, ())
    phrases = _counted(train, lambda text: _phrases(text, found)).where("clean >= 2").collect()
    learned = [r.feature for r in phrases if _log_odds(r.toxic, r.clean, n_toxic, n_clean) < 0]
    lexicon = Lexicon(weights, sorted({*learned, *(fold(p) for p in exceptions)}))
    pairs = np.array(train.select(evidence(lexicon), F.col("y").cast("double")).collect(), float)
    lexicon.slope, lexicon.offset = _curve(pairs[:, 0], pairs[:, 1])
    return lexicon


def _scorer(lexicon: Lexicon, curve: bool):
    @F.arrow_udf("double")
    def scored(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        matcher = lexicon.matcher()
        for part in parts:
            out: list[float] = []
            for _, texts in ta.batches(part):
                out += [lexicon.score(matcher.evidence(t)) if curve else matcher.evidence(t) for t in texts]
            yield pa.array(out, pa.float64())

    return scored


def evidence(lexicon: Lexicon, text: str = "text"):
    """Column of the normalised evidence."""
    return _scorer(lexicon, False)(F.col(f"`{text}`").cast("string")).alias("evidence")


def score_toxicity(docs: DataFrame, lexicon: Lexicon, text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """``docs`` with ``score`` (0 to 1; null and empty texts have the base rate) and ``predicted``.

    Whole texts are scored in place, without a shuffle; columns of those names are replaced, all others
    and repeated rows stay; an empty table stays empty.  Lexicon entries have ``SHORTEST`` signs or more, so
    shorter words count only within longer ones or phrases.
    """
    scored = docs.withColumn("score", _scorer(lexicon, True)(F.col(f"`{text_col}`").cast("string")))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def held_out_scores(docs: DataFrame, labels: DataFrame, held_out: tuple[int, int] = (4, 2)) -> DataFrame:
    """doc_id, held_out, score, predicted of all ``docs`` by a lexicon learned outside the fold."""
    lexicon = learn(docs, labels, held_out)
    return score_toxicity(docs.select("doc_id", "text"), lexicon).select("doc_id", in_fold(F.col("doc_id"), *held_out).alias("held_out"), "score", "predicted")
