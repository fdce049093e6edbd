"""Toxicity of texts by a weighted lexicon, matched by Aho-Corasick on folded text.

Folding: lower case, look-alike letters of other scripts and full-width forms become Latin letters, digits and signs inside a
word become the letters they stand for, other characters part words. A word with a second reading (an accent left off, 1 as
l) has it matched as well. The lexicon is learned from labelled texts: words and beginnings of words, each weighted by the
log of its odds in toxic texts; words beside a term with which it stands in clean texts alone make an exception phrase, in
which the term does not count. A text's score is a logistic of its summed weights, both as they are and as a share of its
words, fitted on texts that did not choose the weights.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from functools import cached_property

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import is_column, small_side, written

#: Labelled texts of each class that are learned from, at most (by the order of their hash); terms counted over them that reach
#: the driver, and those kept.
SAMPLE, CANDIDATES, TERMS = 6_000, 30_000, 20_000
#: Evidence that a term must have (twice the log-likelihood ratio of its odds), and the clean texts an exception must be in.
EVIDENCE, EXCEPTION = 18.0, 3
#: Log odds below which a term says too little to count.
LEAST = 2.0
#: Share of a beginning's toxic texts that longer terms must explain to take its place; evidence and log odds from which a term may have
#: exceptions, which lower both.
MOST, HINT = 0.8, (6.0, 0.7)
#: Beginnings of words that may be terms, in letters.
PREFIXES = range(3, 9)
FOLDS = 5

# Letters that look like Latin ones, and signs that stand for letters inside a word.
LOOKALIKES = str.maketrans("авекмнорстухѕіјԁԛԝһӏαβεηικνορτυχωıɑɡ", "abekmhopctyxsijdqwhlabenikvoptuxwiag")
DIGITS = str.maketrans("01345789@$!|", "oieastbgasii")
_SIGN = r"[01345789@$!|]"
_LETTER = r"[^\W\d_]"
#: A word that a letter ends and a sign is in, or that a sign other than ! begins.
_MARKED = re.compile(rf"(?<![^\W_])(?:{_LETTER}+{_SIGN}[\w@$!|]*(?<={_LETTER})|[01345789@$|]+{_LETTER}[\w@$!|]*(?<=[^\W_]))")
_WORD = re.compile(rf"{_LETTER}+")
_SIGNS = re.compile(_SIGN)


def fold(text: str) -> tuple[list[str], list[str]]:
    """The folded words of a text, and the second readings of those that have one."""
    text = text.lower()
    if not text.isascii():
        text = unicodedata.normalize("NFKC", text).translate(LOOKALIKES)
    other: list[str] = []
    if _SIGNS.search(text):

        def letters(m: re.Match) -> str:
            word = m[0]
            if "1" in word or "|" in word or "!" in word:
                other.append(word.replace("1", "l").replace("|", "l").replace("!", "l").translate(DIGITS))
            return word.translate(DIGITS)

        text = _MARKED.sub(letters, text)
    words = _WORD.findall(text)
    if not text.isascii():
        for w in words:
            if not w.isascii() and (plain := "".join(c for c in unicodedata.normalize("NFD", w) if not unicodedata.combining(c))) != w:
                other.append(plain)
    return words, other


def features(word: str) -> Iterator[str]:
    """Terms that a word can be found by: itself (`` word ``) and its beginnings (`` wor``)."""
    yield f" {word} "
    for n in PREFIXES:
        if len(word) > n:
            yield f" {word[:n]}"


@dataclass
class Model:
    """Weights of each term (of all texts, then of each fold's counterpart), exception phrases, and the logistic."""

    terms: dict[str, tuple[float, ...]] = field(default_factory=dict)
    exceptions: tuple[str, ...] = ()
    #: Constant, of the summed weights, of the summed weights a hundred words (both as logs).
    logistic: tuple[float, float, float] = (-30.0, 0.0, 0.0)

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "machine"}

    @cached_property
    def machine(self) -> ahocorasick.Automaton | None:
        """All patterns in one automaton, made once in each worker process; None without terms."""
        if not self.terms:
            return None
        made = ahocorasick.Automaton()
        for term, weights in self.terms.items():
            made.add_word(term, (len(term), tuple(weights)))
        for phrase in self.exceptions:
            if phrase not in self.terms:
                made.add_word(phrase, (len(phrase), [i for i, c in enumerate(phrase[:-1]) if c == " "]))
        made.make_automaton()
        return made

    def hits(self, text: str | None) -> tuple[int, dict[int, tuple[float, ...]], str]:
        """Number of words, the weights found by where their word starts (the most of the terms that it matches), and the folded text."""
        words, other = fold(text or "")
        joined = f" {' '.join(words)} "
        found: dict[int, tuple[float, ...]] = {}
        if self.machine is None:
            return len(words), found, joined
        spared: set[int] = set()
        for end, (n, told) in self.machine.iter(joined):
            if isinstance(told, list):  # an exception: where its words start
                spared.update(end - n + 1 + i for i in told)
            else:
                self._keep(found, end - n + 1, told)
        for at in spared & found.keys():
            del found[at]
        for i, word in enumerate(other):
            if weights := self.terms.get(f" {word} "):
                self._keep(found, -1 - i, weights)
        return len(words), found, joined

    @staticmethod
    def _keep(found: dict, at: int, weights: tuple[float, ...]) -> None:
        if at not in found or found[at][0] < weights[0]:
            found[at] = weights

    @staticmethod
    def values(n: int, total: float) -> tuple[float, float, float]:
        return 1.0, math.log1p(total), math.log1p(100 * total / max(n, 1))

    def score(self, text: str | None) -> float:
        n, found, _ = self.hits(text)
        x = sum(a * b for a, b in zip(self.logistic, self.values(n, sum(w[0] for w in found.values())), strict=True))
        return 1 / (1 + math.exp(-min(max(x, -60.0), 60.0)))


def labelled_sample(docs: DataFrame, labels: DataFrame, per_class: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> DataFrame:
    """``(text, toxic, fold)``: about ``per_class`` labelled texts of each class at most, a written table.

    Texts are taken by their hash, so equal ones are one; of near copies (those with the same lowest hash of their three-word
    shingles) one stays, and they fall into one fold. A document with several labels is toxic if any
    says so; null labels and null texts teach nothing.
    """
    marks = labels.where(F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.max((F.col(label_col) == 1).cast("int")).alias("toxic"))
    marks = written(marks, "labels")
    sizes = {r["toxic"]: r["n"] for r in marks.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    share = {k: min(1.0, per_class / n) for k, n in sizes.items()}
    key = F.xxhash64(text_col, F.lit("sample"))
    hashed = docs.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), key.alias("h")).join(small_side(marks), "id")
    near = F.pmod("h", F.lit(1 << 30)) < F.when(F.col("toxic") == 1, share.get(1, 0.0)).otherwise(share.get(0, 0.0)) * (1 << 30)
    chosen = written(hashed.where(near).groupBy("h").agg(F.min("id").alias("id"), F.max("toxic").alias("toxic")), "chosen")
    texts = docs.select(F.col(id_col).alias("id"), key.alias("h"), F.col(text_col).alias("text")).join(small_side(chosen), ["id", "h"])
    # near copies would make any rare word of theirs look like evidence: most have their lowest shingle in common
    texts = texts.dropDuplicates(["h"]).withColumn("words", F.split(F.lower("text"), r"[\x20\x09-\x0D]+"))
    lowest = F.array_min(F.transform("words", lambda w, i: F.xxhash64(w, F.get("words", i + 1), F.get("words", i + 2))))
    group = texts.withColumn("group", F.coalesce(lowest, F.col("h"))).dropDuplicates(["group", "toxic"])
    return written(group.select("text", "toxic", F.pmod(F.hash("group"), F.lit(FOLDS)).alias("fold")), "labelled-texts")


def _tallied(sample: DataFrame, found_in: object) -> DataFrame:
    """``(term, toxic and clean texts of each fold)`` with a term that ``found_in`` gives for a text: counts are summed in each task before the shuffle."""
    names = [f"{kind}{f}" for f in range(FOLDS) for kind in ("clean", "toxic")]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def send() -> pa.RecordBatch:
            columns = [pa.array(list(counts), pa.string()), *(pa.array([c[i] for c in counts.values()], pa.int64()) for i in range(2 * FOLDS))]
            return pa.RecordBatch.from_arrays(columns, names=["term", *names])

        counts: dict[str, list[int]] = defaultdict(lambda: [0] * 2 * FOLDS)
        for b in batches:
            for text, toxic, part in zip(*(b.column(c).to_pylist() for c in ("text", "toxic", "fold")), strict=True):
                for term in found_in(text):
                    counts[term][2 * part + toxic] += 1
                if len(counts) > 50_000:
                    yield send()
                    counts.clear()
        yield send()

    tallied = sample.mapInArrow(run, f"term string, {', '.join(f'{n} bigint' for n in names)}")
    return tallied.groupBy("term").agg(*(F.sum(n).alias(n) for n in names))


def _weight(toxic: float, clean: float, toxic_texts: int, clean_texts: int) -> tuple[float, float]:
    """Log odds of a term, and the evidence for them: twice the log-likelihood ratio against equal odds, 0 where toxic odds are less."""
    weight = math.log((toxic + 0.5) / (toxic_texts + 1)) - math.log((clean + 0.5) / (clean_texts + 1))
    share = toxic_texts / max(toxic_texts + clean_texts, 1)
    n = toxic + clean
    if not n or toxic <= n * share:
        return weight, 0.0
    evidence = 2 * sum(k * math.log(k / (n * s)) for k, s in ((toxic, share), (clean, 1 - share)) if k)
    return weight, evidence


def _weighted(tallies: Iterable, sizes: list[int], least: float = EVIDENCE, odds: float = LEAST) -> dict[str, tuple[float, ...]]:
    """Weights over all texts and, for each fold, over the others; 0 where the evidence there is not enough."""
    ways = [list(range(FOLDS)), *([g for g in range(FOLDS) if g != f] for f in range(FOLDS))]
    out = {}
    for r in tallies:
        counts = [r[f"{kind}{f}"] for f in range(FOLDS) for kind in ("clean", "toxic")]
        weights = []
        for way in ways:
            c, t, cs, ts = (sum(x[2 * f + k] for f in way) for x, k in ((counts, 0), (counts, 1), (sizes, 0), (sizes, 1)))
            weight, evidence = _weight(t, c, ts, cs)
            weights.append(weight if evidence >= least and weight >= odds else 0.0)
        if any(weights):
            out[r["term"]] = tuple(weights)
    return out


def _chosen(terms: dict[str, tuple[float, ...]], toxic: dict[str, int]) -> dict[str, tuple[float, ...]]:
    """Beginnings that owe most of their toxic texts to longer ones (or words) of no less weight go; then, of the others, those
    of which a shorter one weighs as much."""

    def shorter(term: str) -> list[str]:
        word = term.strip()
        return [t for n in PREFIXES if n < len(word) and (t := f" {word[:n]}") in terms]

    owed: dict[str, int] = defaultdict(int)
    for term, w in terms.items():
        chain = shorter(term)
        for i, t in enumerate(chain):  # what the shortest ones of no less weight explain
            if w[0] >= terms[t][0] and not any(terms[q][0] >= terms[t][0] for q in chain[i + 1 :]):
                owed[t] += toxic[term]
    left = {t: w for t, w in terms.items() if owed[t] < MOST * toxic[t]}
    return {t: w for t, w in left.items() if not any(o in left and left[o][0] >= w[0] for o in shorter(t))}


def _fitted(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> tuple[float, float, float]:
    """Logistic regression by Newton steps."""
    beta = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        slope = x.T @ (y - p) - ridge * beta
        curve = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(x.shape[1])
        step = np.linalg.solve(curve, slope)
        beta += step
        if np.abs(step).max() < 1e-8:
            break
    return tuple(float(b) for b in beta)


def fit(sample: DataFrame, exceptions: Iterable[str] = ()) -> Model:
    """The model of ``labelled_sample``; ``exceptions`` are phrases known beforehand in which no term counts.

    Without toxic texts there is no lexicon and every score is the share of toxic texts among the labelled, near 0.
    """
    found = {(r["fold"], r["toxic"]): r["n"] for r in sample.groupBy("fold", "toxic").agg(F.count("*").alias("n")).collect()}
    sizes = [found.get((f, k), 0) for f in range(FOLDS) for k in (0, 1)]
    toxic, every = sum(sizes[1::2]), sum(sizes)
    if not every:
        return Model()
    given = tuple(f" {' '.join(fold(p)[0])} " for p in exceptions)
    prior = math.log((toxic + 0.5) / (every - toxic + 0.5))
    model = Model(exceptions=given, logistic=(prior, 0.0, 0.0))
    if not toxic:
        return model

    def words_in(text: str) -> set[str]:
        return {t for w in set(fold(text)[0]) for t in features(w)}

    def first(tallied: DataFrame) -> list:
        t, c = (sum((F.col(f"{k}{f}") for f in range(FOLDS)), F.lit(0)) for k in ("toxic", "clean"))
        gain = t * F.log((t + 0.5) * F.lit((every - toxic + 1) / (toxic + 1)) / (c + 0.5))
        return tallied.where(t >= 3).withColumn("gain", gain).where("gain > 0").orderBy(F.desc("gain"), "term").limit(CANDIDATES).collect()

    tallies = first(_tallied(sample, words_in))
    loose = {t: (1.0,) * (FOLDS + 1) for t in _weighted(tallies, sizes, *HINT)}
    send = sample.sparkSession.sparkContext.broadcast
    probe = send(Model(terms=loose, exceptions=given))

    def phrases_in(text: str) -> set[str]:
        """Two-word phrases of the text's whole-word terms."""
        _, hit, joined = probe.value.hits(text)
        out = set()
        for at in hit:
            if at < 0:
                continue
            end = joined.index(" ", at + 1)
            if f"{joined[at : end + 1]}" not in probe.value.terms:
                continue
            if at:
                out.add(joined[joined.rindex(" ", 0, at) : end + 1])
            if end + 1 < len(joined):
                out.add(joined[at : joined.index(" ", end + 1) + 1])
        return out

    t, c = (sum((F.col(f"{k}{f}") for f in range(FOLDS)), F.lit(0)) for k in ("toxic", "clean"))
    spared = _tallied(sample, phrases_in).where((t == 0) & (c >= EXCEPTION)).orderBy(F.desc(c), "term").limit(TERMS).collect()
    probe.destroy()  # workers keep a broadcast, and the automaton made of it, as long as it lives
    model.exceptions = tuple(dict.fromkeys([*given, *(r["term"] for r in spared)]))
    if model.exceptions:  # without the texts in which a term stands in exceptions only
        probe = send(Model(terms=loose, exceptions=model.exceptions))

        def left_in(text: str) -> set[str]:
            words = set()
            _, hit, joined = probe.value.hits(text)
            for at in hit:
                if at >= 0:
                    words.add(joined[at + 1 : joined.index(" ", at + 1)])
            return {t for w in words for t in features(w) if t in probe.value.terms}

        tallies = first(_tallied(sample, left_in))
        probe.destroy()
    terms = _chosen(_weighted(tallies, sizes), {r["term"]: sum(r[f"toxic{f}"] for f in range(FOLDS)) for r in tallies})
    model.terms = dict(sorted(terms.items(), key=lambda i: (-i[1][0], i[0]))[:TERMS])
    own = {t.strip() for t in model.terms if t.endswith(" ")}
    model.exceptions = tuple(p for p in model.exceptions if p in given or own & set(p.split()))
    learned = send(model)

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, total = [], []
            for text, part in zip(b.column("text").to_pylist(), b.column("fold").to_pylist(), strict=True):
                words, hit, _ = learned.value.hits(text)
                n.append(words)
                total.append(sum(w[1 + part] for w in hit.values()))
            yield pa.RecordBatch.from_arrays([b.column("toxic"), pa.array(n, pa.int64()), pa.array(total, pa.float64())], names=["toxic", "n", "total"])

    rows = sample.mapInArrow(measured, "toxic int, n long, total double").groupBy("toxic", "n", "total").count().collect()
    x = np.array([Model.values(r["n"], r["total"]) for r in rows])
    learned.destroy()
    index = np.repeat(np.arange(len(rows)), [r["count"] for r in rows])
    return Model(model.terms, model.exceptions, _fitted(x[index], np.array([r["toxic"] for r in rows], float)[index]))


def score(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """``docs`` with ``score`` (0 to 1) and ``predicted`` (1 from 0.5 on) of every whole text; columns of those names are replaced.

    Null and empty texts, and texts without a letter, have no hit and score as such texts do. Nothing is shuffled; repeated rows
    and other columns stay; an empty table gives an empty result.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)
    kept = docs.select(*(c for c in docs.columns if not is_column(c, "score", "predicted")))
    at = [c.lower() for c in kept.columns].index(text_col.lower())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [sent.value.score(t) for t in b.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(found, pa.float64()), pa.array([int(s >= 0.5) for s in found], pa.int32())], names=[*b.schema.names, "score", "predicted"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields)
    return kept.mapInArrow(run, f"{fields}, score double, predicted int")
