"""Language identification with a string kernel.

k(x, y) is the number of different character n-grams (n = 1..3, a blended spectrum) that
two texts share, normalised by their own numbers.  A few texts of each language are
landmarks (Nyström); one-versus-rest kernel ridge regression is solved in their space.
Texts are scored in batches: presence rows times the landmarks' presence gives the kernel,
the kernel times the solved weights gives one margin per language.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codeloom.llm.registry import fresh

ORDERS = (1, 2, 3)
BITS = 18  # n-grams are told apart by so many bits of their hash
FACTORS = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D], np.uint32)
PER_LANGUAGE = 300  # labelled texts learned from, per language
LANDMARKS = 32  # of them landmarks, per language
RIDGE = 1e-3
UNKNOWN = "und"


@cache
def _letters() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(sys.maxunicode + 1)), bool, sys.maxunicode + 1)


def grams(texts: list[str | None]) -> tuple[list[tuple[np.ndarray, np.ndarray]], np.ndarray]:
    """([(text number, hashed n-gram) per order], has a letter).  What is no letter counts
    as a blank; n-grams do not cross texts."""
    low = [(t or "").lower() for t in texts]
    sizes = np.fromiter(map(len, low), np.int64, len(low))
    code = np.frombuffer("".join(low).encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _letters()[code]
    owner = np.repeat(np.arange(len(low)), sizes)
    lettered = np.bincount(owner[letter], minlength=len(low)) > 0
    code = np.where(letter, code, np.uint32(32)) + np.uint32(1)
    found = []
    total = np.zeros(len(code), np.uint32)
    for n in ORDERS:
        shifted = code[n - 1 :] * FACTORS[n - 1]
        total = total[: len(shifted)] + (shifted ^ (shifted >> np.uint32(15)))
        mixed = (total ^ np.uint32(n)) * np.uint32(0x27D4EB2F)
        whole = owner[: len(shifted)] == owner[n - 1 :]
        found.append((owner[: len(shifted)][whole], (mixed >> np.uint32(32 - BITS))[whole]))
    return found, lettered


class KernelModel:
    """Landmarks and weights; ``None`` stands for a model without languages."""

    def __init__(self, languages: list[str], column: np.ndarray, landmarks: np.ndarray, weights: np.ndarray):
        self.languages, self.column, self.weights = languages, column, weights
        self.landmarks = landmarks  # presence, landmark by n-gram
        self.norm = np.sqrt(np.maximum(1, landmarks.sum(1, dtype=np.int64))).astype(np.float32)

    def kernel(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        found, lettered = grams(texts)
        present = np.zeros((len(texts), self.landmarks.shape[1]), np.float32)
        for owner, gram in found:
            at = self.column[gram]
            seen = at >= 0
            present[owner[seen], at[seen]] = 1
        own = np.sqrt(np.maximum(1, present.sum(1)))
        return present @ self._dense() / own[:, None] / self.norm, lettered

    def _dense(self) -> np.ndarray:
        if not hasattr(self, "dense"):
            self.dense = self.landmarks.T.astype(np.float32)
        return self.dense

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "dense"}

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        kernel, lettered = self.kernel(texts)
        margin = kernel @ self.weights
        best = margin.argmax(1)
        share = np.exp(4 * (margin - margin.max(1, keepdims=True)))
        score = np.where(lettered, share.max(1) / share.sum(1), 0.0)
        return [self.languages[b] if ok else UNKNOWN for b, ok in zip(best, lettered)], score


def learn(rows: pd.DataFrame, landmarks: int = LANDMARKS, ridge: float = RIDGE) -> KernelModel | None:
    """Fit on ``rows`` (lang, text), which must be few; their order matters for nothing but
    the choice of landmarks (the first of each language)."""
    languages = sorted(rows["lang"].unique())
    if not languages:
        return None
    texts, marks = rows["text"].tolist(), rows.groupby("lang").head(landmarks)["text"].tolist()
    found, _ = grams(marks)
    used = np.unique(np.concatenate([g for _, g in found]))
    column = np.full(1 << BITS, -1, np.int32)
    column[used] = np.arange(len(used))
    presence = np.zeros((len(marks), max(1, len(used))), np.uint8)
    for owner, gram in found:
        presence[owner, column[gram]] = 1
    model = KernelModel(languages, column, presence, np.zeros((len(marks), len(languages)), np.float32))
    inner = model.kernel(marks)[0].astype(np.float64)
    value, vector = np.linalg.eigh((inner + inner.T) / 2)
    root = vector / np.sqrt(np.maximum(value, 1e-6)) @ vector.T
    phi = np.concatenate([model.kernel(texts[a : a + 256])[0] for a in range(0, len(texts), 256)]).astype(np.float64) @ root
    target = np.where(rows["lang"].to_numpy()[:, None] == np.array(languages), 1.0, -1.0)
    solved = np.linalg.solve(phi.T @ phi + ridge * len(texts) * np.eye(len(marks)), phi.T @ target)
    model.weights = (root @ solved).astype(np.float32)
    return model


def training_rows(docs: DataFrame, *, per_language: int = PER_LANGUAGE) -> pd.DataFrame:
    """At most ``per_language`` rows (lang, text) of each language, by the hash of their id.

    Held-out rows (crc32 of the id as text, modulo 5, is 0), null languages, null ids and
    texts without words are never among them.
    """
    keys = docs.where("lang IS NOT NULL AND text IS NOT NULL AND crc32(cast(doc_id AS string)) % 5 <> 0")
    order = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    chosen = (
        keys.select("doc_id", "lang").withColumn("place", F.row_number().over(order))
        .where(F.col("place") <= per_language).select("doc_id", F.col("lang").alias("own"), "place")
    )
    chosen = docs.sparkSession.createDataFrame(chosen.collect(), chosen.schema)  # bounded, see above
    rows = keys.join(F.broadcast(chosen), "doc_id").where("lang = own").select("lang", "text", "place", "doc_id")
    found = rows.toPandas().sort_values(["lang", "place", "text"])
    return found.drop_duplicates(["lang", "place"])[["lang", "text"]].reset_index(drop=True)


def identify(docs: DataFrame, model: KernelModel | None, *, text: str = "text", batch: int = 1 << 18) -> DataFrame:
    """``docs`` with two more columns, lang_pred and score.  Null texts and texts without a
    letter are ``und`` with score 0; so is everything if there was nothing to learn from.
    If ``docs`` has a column of such a name, the new one gets an underscore after its own.
    """
    pred, score_name = fresh(docs, "lang_pred"), fresh(docs, "score")
    shared = docs.sparkSession.sparkContext.broadcast(model)  # landmarks x n-grams, bounded
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    place = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from codeloom.llm.tokens import slices

        own = shared.value
        for rows in batches:
            texts = rows.column(place)
            names, scores = [], []
            for a, b in slices(texts, batch):
                some = texts[a:b].to_pylist()
                for c in range(0, len(some), 256):
                    part = some[c : c + 256]
                    got, score = own.predict(part) if own else ([UNKNOWN] * len(part), np.zeros(len(part)))
                    names += got
                    scores += score.tolist()
            yield pa.RecordBatch.from_arrays(
                [*rows.columns, pa.array(names, pa.string()), pa.array(scores, pa.float64())], [*rows.schema.names, pred, score_name]
            )

    return docs.mapInArrow(run, f"{kinds}, `{pred}` string, `{score_name}` double")
