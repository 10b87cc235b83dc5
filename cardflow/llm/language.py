"""Language identification with error-correcting output codes.

Every language has a binary codeword.  One logistic classifier per bit, on hashed
character n-grams of the whole text, predicts the bits; the language whose codeword has
the smallest weighted loss wins.  A text whose two best codewords are close in loss
is flagged as ambiguous.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cardflow.llm.text import release_memory, unused

UNKNOWN = "und"
DIM = 4096
# Bound on the rows the classifiers are fitted on, shared evenly by the languages.
MAX_SAMPLE = 4000
PER_LANGUAGE = 500
MAX_LANGUAGES = 1000
ITERATIONS, RIDGE = 150, 1e-4
# Gap between the two best probabilities below which a text is ambiguous.
AMBIGUOUS = 0.2
_FACTORS = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D], dtype=np.uint32)


def features(text: str) -> np.ndarray:
    """Square roots of the shares of hashed 1-, 2- and 3-grams of characters, unit length.

    Letters are lower-cased; each run of other characters counts as one space.
    """
    code = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    letter = (code >= 128) | ((code >= 97) & (code <= 122))
    code = np.where(letter, code, np.uint32(32))
    code = code[np.concatenate(([True], letter[1:] | letter[:-1]))] if len(code) else code
    out, gram = np.zeros(DIM, dtype=np.float32), np.zeros(len(code), dtype=np.uint32)
    for n in range(3):
        if len(code) <= n:
            break
        gram = gram[: len(code) - n] * np.uint32(31) + code[n:] * _FACTORS[n]
        place = (gram * np.uint32(0x9E3779B1) + np.uint32(n)) >> np.uint32(20)
        out += np.bincount(place, minlength=DIM).astype(np.float32) / (3 * len(gram))
    return np.sqrt(out)


def codewords(k: int, seed: int = 0) -> np.ndarray:
    """k codewords of +1 and -1: all splits for few languages, else the best of random draws."""
    if k < 2:
        return np.ones((k, 0))
    if k <= 5:
        bits = np.arange(1, 2 ** (k - 1))
        return np.array([np.where((bits >> i) & 1, -1.0, 1.0) if i < k - 1 else np.ones(len(bits)) for i in range(k)])
    rng, best, far = np.random.default_rng(seed), None, -1.0
    for _ in range(50):
        code = rng.choice([-1.0, 1.0], size=(k, int(np.ceil(10 * np.log2(k)))))
        split = code[:, np.abs(code.sum(axis=0)) < k]
        near = float((split.shape[1] - (split @ split.T)[~np.eye(k, dtype=bool)]).min() / 2)
        if near > far:
            best, far = split, near
    return best


@dataclass(frozen=True)
class Model:
    languages: tuple[str, ...]
    code: np.ndarray  # languages x bits
    weights: np.ndarray  # DIM x bits
    bias: np.ndarray
    trust: np.ndarray  # weight of each bit's loss, from its accuracy on the sample

    def losses(self, x: np.ndarray) -> np.ndarray:
        """Weighted mean logistic loss of every codeword, rows x languages."""
        margin = (x @ self.weights + self.bias)[:, None, :] * self.code[None]
        return np.logaddexp(0.0, -margin) @ (self.trust / self.trust.sum())

    def predict(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Index of the language, its probability, and whether it is ambiguous."""
        if len(self.languages) == 1:
            return np.zeros(len(x), int), np.ones(len(x)), np.zeros(len(x), bool)
        raw = -self.losses(x) * self.code.shape[1]
        p = np.exp(raw - raw.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        top = np.sort(p, axis=1)[:, ::-1]
        return p.argmax(axis=1), top[:, 0], top[:, 0] - top[:, 1] < AMBIGUOUS


def fit_bits(x: np.ndarray, label: np.ndarray, languages: tuple[str, ...]) -> Model:
    """Logistic regressions of all bits at once, by accelerated gradient descent."""
    code = codewords(len(languages))
    if len(languages) < 2:
        return Model(languages, code, np.zeros((DIM, 0), np.float32), np.zeros(0), np.ones(0))
    y = code[label].astype(np.float32)
    w, b = np.zeros((DIM, code.shape[1]), np.float32), np.zeros(code.shape[1], np.float32)
    ahead_w, ahead_b, step = w, b, np.float32(2.0)
    for t in range(ITERATIONS):
        pull = -y / (1 + np.exp(np.clip(y * (x @ ahead_w + ahead_b), -30, 30))) / len(x)
        new_w, new_b = ahead_w - step * (x.T @ pull + RIDGE * ahead_w), ahead_b - step * pull.sum(axis=0)
        k = np.float32(t / (t + 3))
        ahead_w, ahead_b, w, b = new_w + k * (new_w - w), new_b + k * (new_b - b), new_w, new_b
    right = ((x @ w + b) * y > 0).mean(axis=0)
    return Model(languages, code, w, b, np.maximum(0.05, 2 * right - 1))


def fit(docs: DataFrame, learn: Column, text: str = "text", lang: str = "lang", doc_id: str = "doc_id") -> Model | None:
    """Fit on rows where ``learn`` holds and text and language are not null.

    At most PER_LANGUAGE ids of a language and about MAX_SAMPLE in all, those with the
    smallest hashes; of rows that share id and language one counts.  None if there are none.
    """
    rows = docs.filter(learn & F.col(lang).isNotNull() & F.col(text).isNotNull())
    names = rows.groupBy(lang).count().limit(MAX_LANGUAGES + 1).collect()
    if not names:
        return None
    if len(names) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    languages = tuple(sorted(r[0] for r in names))
    each = max(1, min(PER_LANGUAGE, MAX_SAMPLE // len(languages)))
    order = Window.partitionBy(lang).orderBy(F.xxhash64(doc_id), doc_id)
    chosen = rows.select(doc_id, lang, F.row_number().over(order).alias("_rn")).filter(F.col("_rn") <= each)
    ids = F.broadcast(chosen.select(doc_id).distinct())  # at most MAX_SAMPLE ids

    def vectors(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            vec = [features(t).astype(np.float16).tobytes() for t in batch["text"]]
            yield pd.DataFrame({"lang": batch["lang"], "vec": vec})

    picked = rows.join(ids, doc_id, "left_semi").groupBy(doc_id, F.col(lang).alias("lang")).agg(F.min(text).alias("text"))
    got = picked.select("lang", "text").mapInPandas(vectors, "lang string, vec binary").collect()
    x = np.stack([np.frombuffer(r["vec"], dtype=np.float16) for r in got]).astype(np.float32)
    place = {name: i for i, name in enumerate(languages)}
    return fit_bits(x, np.array([place[r["lang"]] for r in got]), languages)


NAMES = ("lang_pred", "score", "ambiguous")


def identify(docs: DataFrame, model: Model | None, text: str = "text", names: Sequence[str] = NAMES) -> DataFrame:
    """Add lang_pred, score (0 to 1) and ambiguous, from whole texts alone.

    Null texts and texts without a letter are ``und`` with score 0, and so is
    everything without a model.  All rows and columns are kept; columns of these names (or of the
    three given instead) are replaced.
    """

    @F.pandas_udf("lang_pred string, score double, ambiguous boolean")
    def predicted(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in texts:
            out = pd.DataFrame({"lang_pred": UNKNOWN, "score": 0.0, "ambiguous": False}, index=range(len(batch)))
            known = [i for i, t in enumerate(batch) if t is not None and any(map(str.isalpha, t))] if model else []
            for i in range(0, len(known), 256):
                at = known[i : i + 256]
                best, score, unsure = model.predict(np.stack([features(batch.iloc[j]) for j in at]))
                out.loc[at, "lang_pred"] = [model.languages[b] for b in best]
                out.loc[at, "score"] = score
                out.loc[at, "ambiguous"] = unsure
            yield out
        release_memory()

    kept = [F.col(f"`{c}`") for c in docs.columns if c not in names]
    found, = unused(docs, "_p")
    added = [F.col(f"{found}.{own}").alias(name) for own, name in zip(NAMES, names, strict=True)]
    return docs.select(*kept, predicted(F.col(text)).alias(found)).select(*kept, *added)
