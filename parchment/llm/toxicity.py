"""Toxicity: gradient-boosted trees over dense features of the whole text, with isotonic calibration.

The features are densities of a lexicon that is learnt from the labelled sample (words and openings of words that toxic
documents hold far more often), how near its words stand to a second person, capitals, punctuation, obfuscation and
repetition rates, and size. Lexicon features of a training row come from the other folds' lexicon, and the calibration
from trees that did not see the row.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parchment.llm.common import at_work, prepare, sampled

#: Labelled documents that a model learns from, and the bytes of their texts; the longest text among them (longer ones
#: are scored like all others, but teach nothing).
TRAIN_ROWS, TRAIN_BYTES, TRAIN_LONGEST = 6000, 32 << 20, 1 << 20
FOLDS, TREES, LEAVES_DEPTH, BINS, RATE = 5, 60, 3, 32, 0.15
SHORTEST, LONGEST, RARE = 3, 8, 4
_word = re.compile(r"[^\W_]+")
#: Second persons of the corpus's languages.
YOU = frozenset("you your yours yourself u ur du dich dir dein deine sie ihr euch tu te toi ton ta vous votre vos tú ti usted ustedes vosotros".split())
_masked = re.compile(r"[^\W\d_][@$!*#0-9.\-][^\W\d_]")
_shout = re.compile("[A-Z]{3,}")
_leet = str.maketrans("013457@$!", "oleastasi")
NAMES = ("strong_rate", "weak_rate", "strong", "weak", "weight_rate", "weight_max", "weight_top", "near_you", "kinds", "you_rate", "capitals", "shouted", "marks", "exclaims", "masked", "repeats", "digits", "distinct", "length")


class Lexicon:
    """Weights of words by their openings of SHORTEST to LONGEST letters and by the whole: smoothed log odds of a toxic document."""

    def __init__(self, inside: Counter, outside: Counter, yes: int, no: int):
        """inside and outside count, of `yes` toxic and `no` other documents, those that hold a key."""
        self.weights: dict[str, float] = {}
        for key, n in inside.items():
            if n >= RARE:
                odds = np.log((n + 0.5) / (max(1, yes) + 1)) - np.log((outside[key] + 0.5) / (max(1, no) + 1))
                if odds > 2:
                    self.weights[key] = float(odds)
        self.seen: dict[str, float] = {}

    def __getstate__(self):
        return {"weights": self.weights, "seen": {}}

    def weight(self, word: str) -> float:
        found = self.seen.get(word)
        if found is None:
            if len(self.seen) > 100_000:
                self.seen.clear()
            w = self.weights
            found = max([w.get(word + "$", 0.0), *(w.get(word[:k], 0.0) for k in range(SHORTEST, min(LONGEST, len(word) - 1) + 1))])
            if not found and not word.isalpha():
                plain = word.translate(_leet)
                found = w.get(plain + "$", 0.0) if plain != word else 0.0
            self.seen[word] = found
        return found


def keys_of(bag: set[str]) -> set[str]:
    return {w[:k] for w in bag for k in range(SHORTEST, min(LONGEST, len(w) - 1) + 1)} | {w + "$" for w in bag if len(w) >= SHORTEST}


def lexicons(bags: list[set[str]], toxic: np.ndarray, fold: np.ndarray) -> list[Lexicon]:
    """A lexicon without each fold, and one of all; documents are counted once, by fold."""
    inside, outside = [Counter() for _ in range(FOLDS)], [Counter() for _ in range(FOLDS)]
    for bag, t, k in zip(bags, toxic, fold):
        if t:
            inside[k].update(keys_of(bag))
    every = sum(inside, Counter())
    wanted = {key for key, n in every.items() if n >= RARE}
    for bag, t, k in zip(bags, toxic, fold):
        if not t:
            outside[k].update(wanted & keys_of(bag))
    every, others = Counter({key: every[key] for key in wanted}), sum(outside, Counter())
    out = []
    for k in range(FOLDS):
        rest = fold != k
        part = Counter({key: n - inside[k][key] for key, n in every.items()})
        out.append(Lexicon(part, Counter({key: n - outside[k][key] for key, n in others.items()}), int(toxic[rest].sum()), int((1 - toxic[rest]).sum())))
    return [*out, Lexicon(every, others, int(toxic.sum()), int((1 - toxic).sum()))]


def words_of(text: str) -> list[str]:
    words = _word.findall(text.lower())
    if _masked.search(text):  # i.d.i.o.t, st*pid and the like, beside the plain words
        words += [w for t in text.lower().split() if _masked.search(t) and (w := "".join(_word.findall(t.translate(_leet))))]
    return words


def features(text: str | None, lexicon: Lexicon) -> list[float]:
    text = text or ""
    words = words_of(text)
    n, size = max(1, len(words)), max(1, len(text))
    weights = [lexicon.weight(w) for w in words]
    hits = [i for i, x in enumerate(weights) if x]
    strong = [i for i in hits if weights[i] > 4]
    you = [i for i, w in enumerate(words) if w in YOU]
    near = 0
    if hits and you:
        at = np.array(you)
        near = sum(bool(np.abs(at - i).min() <= 5) for i in strong)
    top = sorted((weights[i] for i in hits), reverse=True)
    upper = sum(map(text.count, "ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
    shouted = len(_shout.findall(text)) if upper else 0
    marks = sum(map(text.count, "!?*#$%&"))
    repeats = sum(a == b for a, b in zip(words, words[1:]))
    return [len(strong) / n, len(hits) / n, len(strong), len(hits), sum(top) / n, top[0] if top else 0.0, sum(top[:5]), near, len({words[i] for i in strong}), len(you) / n, upper / size, shouted / n, marks / size, text.count("!") / size, len(_masked.findall(text)) / n, repeats / n, sum(map(text.count, "0123456789")) / size, len(set(words)) / n, np.log1p(n)]


class Trees:
    """Gradient-boosted regression trees on the logistic loss, over binned features."""

    def __init__(self, x: np.ndarray, y: np.ndarray, trees: int = TREES):
        self.cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(x.shape[1])]
        binned = np.stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(self.cuts)], axis=1)
        share = min(max(y.mean(), 1e-3), 1 - 1e-3)
        self.start = float(np.log(share / (1 - share)))
        self.trees: list[list[tuple]] = []
        score = np.full(len(y), self.start)
        for _ in range(trees):
            p = 1 / (1 + np.exp(-score))
            slope, curve = y - p, np.maximum(p * (1 - p), 1e-6)
            tree: list[tuple] = []
            where = self._grow(binned, slope, curve, np.arange(len(y)), 0, tree)
            for rows, value in where:
                score[rows] += value
            self.trees.append(tree)

    def _grow(self, binned, slope, curve, rows, depth, tree) -> list:
        """Nodes are (feature, cut, left, right) or (-1, value)."""
        g, h = slope[rows].sum(), curve[rows].sum()
        best = (1e-3, None)
        if depth < LEAVES_DEPTH and len(rows) >= 20:
            for j in range(binned.shape[1]):
                width = len(self.cuts[j]) + 1
                gs = np.bincount(binned[rows, j], slope[rows], width).cumsum()[:-1]
                hs = np.bincount(binned[rows, j], curve[rows], width).cumsum()[:-1]
                if not len(gs):
                    continue
                gain = gs**2 / (hs + 1) + (g - gs) ** 2 / (h - hs + 1) - g**2 / (h + 1)
                gain[(hs < 1) | (h - hs < 1)] = 0
                if gain.max() > best[0]:
                    best = (gain.max(), (j, int(gain.argmax())))
        at = len(tree)
        if best[1] is None:
            value = float(RATE * g / (h + 1))
            tree.append((-1, value))
            return [(rows, value)]
        j, k = best[1]
        tree.append(())
        left = binned[rows, j] <= k
        out = self._grow(binned, slope, curve, rows[left], depth + 1, tree)
        second = len(tree)
        out += self._grow(binned, slope, curve, rows[~left], depth + 1, tree)
        tree[at] = (j, float(self.cuts[j][k]), at + 1, second)
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.start)
        for tree in self.trees:
            stack = [(0, np.arange(len(x)))]
            while stack:
                at, rows = stack.pop()
                if not len(rows):
                    continue
                node = tree[at]
                if node[0] < 0:
                    out[rows] += node[1]
                else:
                    left = x[rows, node[0]] <= node[1]
                    stack += [(node[2], rows[left]), (node[3], rows[~left])]
        return out


def isotonic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The non-decreasing step function of x that is nearest to y: pooled adjacent violators, as (x, value) knots."""
    order = np.argsort(x, kind="stable")
    blocks: list[list[float]] = []
    for a, b in zip(x[order], y[order]):
        if blocks and blocks[-1][3] == a:
            blocks[-1][0] += b
            blocks[-1][1] += 1
        else:
            blocks.append([b, 1, a, a])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            s, n, _, high = blocks.pop()
            blocks[-1][0] += s
            blocks[-1][1] += n
            blocks[-1][3] = high
    return np.array([k for b in blocks for k in (b[2], b[3])]), np.array([v for b in blocks for v in [b[0] / b[1]] * 2])


class ToxicityModel:
    def __init__(self, texts: list[str], toxic: list[int]):
        y = np.array(toxic, dtype=float)
        self.constant = None
        if len(set(toxic)) < 2 or len(y) < 2 * FOLDS:
            self.constant = float(y.mean()) if len(y) else 0.0
            return
        shared: dict[str, str] = {}  # a word that many documents hold is held once
        bags = [{shared.setdefault(w, w) for w in words_of(t or "")} for t in texts]
        # copies share a fold, else a copy would leak its label
        fold = np.array([hash_fold(t) for t in texts])
        x = np.zeros((len(y), len(NAMES)))
        *apart_from, self.lexicon = lexicons(bags, y, fold)
        for i, k in enumerate(fold):
            x[i] = features(texts[i], apart_from[k])
        apart = np.zeros(len(y))
        for k in range(FOLDS):
            if (fold == k).any() and (fold != k).any():
                apart[fold == k] = Trees(x[fold != k], y[fold != k]).score(x[fold == k])
        self.knots = isotonic(apart, y)
        self.trees = Trees(x, y)

    def predict(self, texts: list[str | None]) -> np.ndarray:
        """Calibrated scores from 0 to 1."""
        if self.constant is not None:
            return np.full(len(texts), self.constant)
        if not texts:
            return np.zeros(0)
        raw = self.trees.score(np.array([features(t, self.lexicon) for t in texts]))
        return np.clip(np.interp(raw, *self.knots), 0, 1)


def hash_fold(text: str | None) -> int:
    import zlib

    return zlib.crc32((text or "").encode("utf-8", "surrogatepass")) % FOLDS


def held_out() -> Column:
    """The remainder of crc32 of doc_id as text by 5 is 0; false for a null doc_id."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))


def train_toxicity_model(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS, size: int = TRAIN_BYTES) -> ToxicityModel:
    """Fit on a sample of the labelled documents outside the held-out part: about `rows` labels by hash of doc_id, and
    of their texts, by hash of doc_id and text, about `size` bytes.

    Rows with a null doc_id or toxic teach nothing; of repeated labels the greatest counts. Without labels, or with
    one kind only, the score is a constant.
    """
    prepare(docs.sparkSession)
    known = labels.where(~held_out() & F.col("doc_id").isNotNull() & F.col("toxic").isNotNull())
    known = known.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg((F.max("toxic") > 0).cast("int").alias("toxic"))
    most = (1 << 30) * min(1.0, rows / max(1, known.count()))
    # about `rows` small rows whatever the number of labels: a bound for the broadcast
    chosen = F.broadcast(known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < most))
    told = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).where(F.octet_length("text") <= TRAIN_LONGEST).join(chosen, "doc_id")
    total = told.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    sample = sampled(told, F.lit(min(1.0, size / max(1, total)))).select("doc_id", "fp", "toxic", "text").toPandas().sort_values(["doc_id", "fp"])
    return ToxicityModel(sample["text"].tolist(), sample["toxic"].astype(int).tolist())


def toxicity_of(text: Column, model: ToxicityModel) -> Column:
    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        at_work()
        return pd.Series(model.predict([None if t is None else t for t in texts]))

    return score(text.cast("string"))


def score_toxicity(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of docs, from the whole text and nothing else.

    Null and empty texts are scored as texts without a word. Null doc_id: not held out. Repeated rows get equal
    scores; other columns are ignored.
    """
    prepare(docs.sparkSession)
    out = docs.select("doc_id", held_out().alias("held_out"), toxicity_of(F.col("text"), model).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def drop_toxic(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """docs less the rows with a score of 0.5 or more; columns stay as they are."""
    prepare(docs.sparkSession)
    return docs.where(toxicity_of(F.col("text"), model) < 0.5)
