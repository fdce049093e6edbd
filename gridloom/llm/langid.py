"""Language identification by a string kernel.

Kernel: blended spectrum of presence: the number of n-grams (1 to 3 bytes of the lower-cased UTF-8 text, other bytes than
letters as one separator) that two texts share, over the root of the product of their own numbers. Nyström: landmarks
of each language span the feature space; n-grams of no landmark have no weight in it. One-versus-rest kernel ridge
regression on those features; texts are scored by batched products (presence x landmarks x weights).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import is_column

#: Landmarks and labelled texts of each language, and the ridge.
LANDMARKS, SAMPLE, RIDGE = 32, 300, 0.1
#: Bounds of a whole sample and of all landmarks: where languages are so many that these are passed, each gets an equal share.
ALL_SAMPLE, ALL_LANDMARKS = 60_000, 2_048
UNKNOWN = "und"
_LETTER = regex.compile(r"\p{L}")
CHUNK = 1 << 20
#: Byte classes: separator, 26 letters, 128 bytes of other characters.
CLASSES = 155


def _classes() -> np.ndarray:
    table = np.zeros(256, np.uint8)
    table[97:123] = np.arange(1, 27)
    table[128:] = np.arange(27, CLASSES)
    return table


_CLASS = _classes()


def grams(text: str) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """1-, 2- and 3-gram codes of the text's bytes, a chunk at a time (chunks overlap by two bytes)."""
    raw = np.frombuffer((" " + text.lower() + " ").encode("utf-8", "ignore"), np.uint8)
    for at in range(0, max(len(raw) - 2, 1), CHUNK):
        c = _CLASS[raw[at : at + CHUNK + 2]].astype(np.int32)
        two = c[:-1] * CLASSES + c[1:]
        yield c, two, two[:-1] * CLASSES + c[2:]


@dataclass
class Model:
    languages: list[str]
    #: Feature number of each n-gram, 0 for those of no landmark, by code.
    codes: tuple[np.ndarray, np.ndarray, np.ndarray]
    landmarks: np.ndarray
    weights: np.ndarray

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "tables"}

    @cached_property
    def tables(self) -> list[np.ndarray]:
        """Feature numbers by code: 15 MB, made once in each worker process for a broadcast model."""
        out, n = [], 1
        for codes, size in zip(self.codes, (CLASSES, CLASSES**2, CLASSES**3), strict=True):
            table = np.zeros(size, np.int32)
            table[codes] = np.arange(n, n + len(codes))
            n += len(codes)
            out.append(table)
        return out

    def presence(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.landmarks.shape[1] + 1), np.float32)
        for row, text in zip(out, texts, strict=True):
            for parts in grams(text):
                for table, codes in zip(self.tables, parts, strict=True):
                    row[table[codes]] = 1
        return out[:, 1:]

    def scores(self, texts: list[str]) -> np.ndarray:
        x = self.presence(texts)
        norm = np.sqrt(np.maximum(x.sum(1, keepdims=True), 1))
        return (x @ self.landmarks.T / norm) @ self.weights

    def predict(self, texts: list[str | None], batch: int = 256) -> tuple[list[str], list[float]]:
        """Language and score (0 to 1) of each text: ``und`` and 0 for null and texts without a letter."""
        names, values = [UNKNOWN] * len(texts), [0.0] * len(texts)
        at = [i for i, t in enumerate(texts) if t and _LETTER.search(t)] if self.languages else []
        for start in range(0, len(at), batch):
            part = at[start : start + batch]
            s = self.scores([texts[i] for i in part])
            for i, k, v in zip(part, s.argmax(1).tolist(), s.max(1).tolist(), strict=True):
                names[i], values[i] = self.languages[k], min(max((v + 1) / 2, 0.0), 1.0)
        return names, values

    def evidence(self, texts: list[str | None], batch: int = 256) -> list[tuple[int, float, float]]:
        """Of each text: its distinct 3-grams, their share that landmarks hold, and the best score less the second.

        The margin is infinite with fewer than two languages. Null or without a letter: nothing, 0 and 0.
        """
        out = [(0, 0.0, 0.0)] * len(texts)
        at = [i for i, t in enumerate(texts) if t and _LETTER.search(t)] if self.languages else []
        for start in range(0, len(at), batch):
            part = at[start : start + batch]
            s = np.sort(self.scores([texts[i] for i in part]), axis=1)
            margins = s[:, -1] - s[:, -2] if s.shape[1] > 1 else np.full(len(part), np.inf)
            for i, margin in zip(part, margins.tolist(), strict=True):
                three = np.unique(np.concatenate([np.unique(c[2]) for c in grams(texts[i])]))
                out[i] = (len(three), float((self.tables[2][three] > 0).mean()) if len(three) else 0.0, margin)
        return out


def fit(sample: pd.DataFrame, landmarks: int = LANDMARKS, ridge: float = RIDGE) -> Model:
    """``sample``: text, lang. Landmarks are the first texts of each language in the order given."""
    languages = sorted(sample["lang"].unique())
    if not languages:
        none = np.zeros(0, np.int64)
        return Model([], (none, none, none), np.zeros((0, 0), np.float32), np.zeros((0, 0), np.float32))
    landmarks = max(1, min(landmarks, ALL_LANDMARKS // len(languages)))
    marks = [t for lang in languages for t in sample.loc[sample["lang"] == lang, "text"].head(landmarks)]
    codes = tuple(np.unique(np.concatenate([np.unique(part[k]) for t in marks for part in grams(t)])) for k in range(3))
    model = Model(languages, codes, np.zeros((1, sum(map(len, codes))), np.float32), np.zeros((1, 1), np.float32))
    z = model.presence(marks)
    model.landmarks = z / np.sqrt(np.maximum(z.sum(1, keepdims=True), 1))
    values, vectors = np.linalg.eigh((model.landmarks @ model.landmarks.T).astype(float))
    good = values > 1e-6 * values[-1]
    root = vectors[:, good] / np.sqrt(values[good])
    texts = sample["text"].tolist()
    kernel = []
    for at in range(0, len(texts), 256):
        x = model.presence(texts[at : at + 256])
        kernel.append(x @ model.landmarks.T / np.sqrt(np.maximum(x.sum(1, keepdims=True), 1)))
    features = np.concatenate(kernel).astype(float) @ root
    target = np.where(sample["lang"].to_numpy()[:, None] == np.array(languages, object)[None, :], 1.0, -1.0)
    solved = np.linalg.solve(features.T @ features + ridge * np.eye(features.shape[1]), features.T @ target)
    model.weights = (root @ solved).astype(np.float32)
    return model


def labelled_sample(docs: DataFrame, train: F.Column, text_col: str = "text", lang_col: str = "lang", per_language: int = SAMPLE) -> pd.DataFrame:
    """At most ``per_language`` rows of each language among those where ``train`` holds: a bounded, repeatable sample.

    At most ALL_SAMPLE rows in all: with more languages than fit, each has an equal share, one at least (so many languages
    at most, the most frequent). Texts are taken by the order of their hash, copies once. Null, blank and unlabelled texts
    teach nothing; without labelled texts the sample is empty.
    """
    rows = docs.where(train & F.col(lang_col).isNotNull() & F.col(text_col).rlike(r"\p{L}")).select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    order = F.pmod(F.xxhash64("text", F.lit("sample")), F.lit(1 << 30))
    rows = rows.withColumn("order", order)
    sizes = rows.groupBy("lang").agg(F.approx_count_distinct("order").alias("n")).orderBy(F.desc("n"), "lang").limit(ALL_SAMPLE)
    counts = {r["lang"]: r["n"] for r in sizes.collect()}
    if not counts:
        return pd.DataFrame({"text": [], "lang": []})
    per_language = max(1, min(per_language, ALL_SAMPLE // len(counts)))
    # a share of each language by hash, near twice what is wanted, so that no task and not the driver sees more
    shares = docs.sparkSession.createDataFrame([(lang, min(1.0, (2 * per_language + 20) / n)) for lang, n in counts.items()], "lang string, share double")
    near = rows.join(F.broadcast(shares), "lang").where(F.col("order") < F.col("share") * (1 << 30)).select("text", "lang", "order")
    return near.distinct().toPandas().sort_values(["lang", "order", "text"]).groupby("lang").head(per_language)[["text", "lang"]].reset_index(drop=True)


def predict(docs: DataFrame, model: Model, text_col: str = "text", name_col: str = "lang_pred", score_col: str = "score") -> DataFrame:
    """``docs`` with the language and score of every whole text; columns of those names are replaced.

    Null text, an empty one or one without a letter: ``und`` and 0. Of languages with equal scores the first by name is
    taken. Texts of any length are read whole, in chunks. Repeated rows and other columns stay, columns of the two names
    in any case are replaced; an empty table gives an empty result; nothing is shuffled.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)
    kept = docs.select(*(c for c in docs.columns if not is_column(c, name_col, score_col)))
    at = [c.lower() for c in kept.columns].index(text_col.lower())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            names, values = sent.value.predict(b.column(at).to_pylist())
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(names, pa.string()), pa.array(values, pa.float64())], names=[*b.schema.names, name_col, score_col])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields)
    return kept.mapInArrow(run, f"{fields}, `{name_col}` string, `{score_col}` double")


def recognised(docs: DataFrame, model: Model, known: float, margin: float, enough: int, text_col: str = "text") -> DataFrame:
    """``docs`` in a language of the model, by evidence: at least the share ``known`` of a text's distinct 3-grams is in
    landmarks, and where there are ``enough`` of them, the best language leads the second by ``margin``.

    Null texts and those without a letter go. Rows stay as they are; an empty table gives an empty result."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    at = [c.lower() for c in docs.columns].index(text_col.lower())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = sent.value.evidence(b.column(at).to_pylist())
            yield b.filter(pa.array([n > 0 and share >= known and (n < enough or lead >= margin) for n, share, lead in found], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
