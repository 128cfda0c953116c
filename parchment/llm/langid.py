"""Language identification by error-correcting output codes over hashed byte n-grams.

Each language gets a codeword; a binary classifier for each bit is a logistic regression on square roots of n-gram
shares. A text is given the language whose codeword has the least logistic loss against the bits' margins; a small
lead over the next codeword is flagged.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parchment.llm.common import at_work, prepare, sampled

#: Texts that a model learns from, dealt evenly to the languages, and their bytes; the longest text among them (longer
#: ones are judged like all others, but teach nothing); share of a second-best loss below which a decision is ambiguous.
TRAIN_ROWS, TRAIN_BYTES, TRAIN_LONGEST, LEAD = 3000, 24 << 20, 1 << 20, 0.15
PAIRS, TRIPLES = 2048, 6144
_latin = re.compile("[A-Za-z]")
_low = np.arange(256, dtype=np.int64)
_low[65:91] += 32
_low[:65] = 32  # digits and punctuation are no language
_low[91:97] = 32
_low[123:128] = 32


def has_letter(text: str) -> bool:
    return bool(_latin.search(text)) or any(map(str.isalpha, text))


def features(text: str) -> np.ndarray:
    """Square roots of the shares of hashed byte pairs and triples of the whole text."""
    b = _low[np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)]
    b = np.concatenate([[32], b, [32]])
    two = (b[:-1] * 641 + b[1:] * 33) % PAIRS
    three = (b[:-2] * 7919 + b[1:-1] * 641 + b[2:] * 33) % TRIPLES
    out = np.concatenate([np.bincount(two, minlength=PAIRS) / len(two), np.bincount(three, minlength=TRIPLES) / max(1, len(three))])
    return np.sqrt(out, dtype=np.float64).astype(np.float32)


def codewords(classes: int, seed: int = 3) -> np.ndarray:
    """A row of +1 and -1 for each class: all splits of up to five classes, else random ones far from each other."""
    if classes == 1:
        return np.ones((1, 1), np.int8)
    if classes <= 5:
        splits = range(1, 1 << (classes - 1))
        return np.array([[-1 if k and s >> (k - 1) & 1 else 1 for s in splits] for k in range(classes)], dtype=np.int8)
    rng, best, far = np.random.default_rng(seed), None, -1
    bits = int(np.ceil(10 * np.log2(classes)))
    for _ in range(200):
        code = rng.choice(np.array([-1, 1], np.int8), (classes, bits))
        apart = (code[:, None] != code[None]).sum(-1) + bits * np.eye(classes, dtype=int)
        if (least := int(apart.min())) > far and (abs(code.sum(0)) < classes).all():
            best, far = code, least
    return best


class LanguageModel:
    def __init__(self, texts: list[str], langs: list[str], steps: int = 120, penalty: float = 1e-5):
        self.langs = sorted(set(langs))
        if not self.langs:
            self.code = np.ones((0, 1), np.int8)
            self.weights = np.zeros((PAIRS + TRIPLES + 1, 1), np.float32)
            return
        self.code = codewords(len(self.langs))
        x = np.ones((len(texts), PAIRS + TRIPLES + 1), np.float32)
        for i, t in enumerate(texts):
            x[i, :-1] = features(t) * 10
        at = {k: i for i, k in enumerate(self.langs)}
        want = self.code[[at[k] for k in langs]].astype(np.float32)
        share = np.bincount([at[k] for k in langs], minlength=len(at))
        weight = np.array([len(langs) / len(at) / share[at[k]] for k in langs], dtype=np.float32)[:, None]
        w = np.zeros((x.shape[1], want.shape[1]), np.float32)
        first, second = np.zeros_like(w), np.zeros_like(w)
        for t in range(1, steps + 1):  # Adam on the logistic loss of all bits
            slope = x.T @ (-want * weight / (1 + np.exp(np.clip(want * (x @ w), -30, 30)))) / len(texts) + penalty * w
            first, second = 0.9 * first + 0.1 * slope, 0.99 * second + 0.01 * slope**2
            w -= 0.05 * (first / (1 - 0.9**t)) / (np.sqrt(second / (1 - 0.99**t)) + 1e-8)
        self.weights = w

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """(language, score from 0 to 1, ambiguous); `und` with score 0 without a letter or a learned language."""
        if text is None or not self.langs or not has_letter(text):
            return "und", 0.0, True
        margin = (features(text) * 10) @ self.weights[:-1] + self.weights[-1]
        loss = np.logaddexp(0, -self.code * margin).sum(axis=1)
        k = int(loss.argmin())
        share = np.exp(loss[k] - loss)
        lead = 1.0 if len(loss) == 1 else float(np.partition(loss, 1)[1] - loss[k]) / self.code.shape[1]
        return self.langs[k], float(1 / share.sum()), lead < LEAD


def held_out() -> Column:
    """The remainder of crc32 of doc_id as text by 4 is 2; false for a null doc_id."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))


def train_language_model(docs: DataFrame, rows: int = TRAIN_ROWS, size: int = TRAIN_BYTES) -> LanguageModel:
    """Fit on a sample of the labelled texts outside the held-out part: of each language, by hash of doc_id and text,
    about its share of `rows` rows and of `size` bytes, so a rare language is learned too.

    Rows with a null lang, text or doc_id teach nothing. Without any labelled text the model answers `und`.
    """
    prepare(docs.sparkSession)
    known = docs.where(~held_out() & F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull() & (F.octet_length("text") <= TRAIN_LONGEST))
    known = known.select("doc_id", F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    # a row for each language
    totals = known.groupBy("lang").agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("size")).collect()
    shares = {r["lang"]: min(1.0, rows / len(totals) / r["n"], size / len(totals) / max(1, r["size"])) for r in totals}
    if not shares:
        return LanguageModel([], [])
    share = F.element_at(F.create_map(*[F.lit(x) for pair in shares.items() for x in pair]), F.col("lang"))
    sample = sampled(known, share).select("doc_id", "fp", "lang", "text").toPandas().sort_values(["doc_id", "fp", "lang"])
    sample = sample[[has_letter(t) for t in sample["text"]]] if len(sample) else sample
    return LanguageModel(sample["text"].tolist(), sample["lang"].tolist())


def identify_languages(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """doc_id, held_out, lang_pred, score, ambiguous for every row of docs, from the whole text and nothing else.

    `und` (score 0, ambiguous) if text is null or has no letter. Null doc_id: not held out. Repeated rows get equal
    answers; other columns are ignored.
    """
    prepare(docs.sparkSession)

    @F.pandas_udf("lang string, score double, ambiguous boolean")
    def judge(texts: pd.Series) -> pd.DataFrame:
        at_work()
        return pd.DataFrame([model.predict(t) for t in texts], columns=["lang", "score", "ambiguous"])

    found = docs.select("doc_id", held_out().alias("held_out"), judge(F.col("text").cast("string")).alias("found"))
    return found.select("doc_id", "held_out", F.col("found.lang").alias("lang_pred"), F.col("found.score").alias("score"), F.col("found.ambiguous").alias("ambiguous"))
