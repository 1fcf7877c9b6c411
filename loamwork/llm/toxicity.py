"""Toxicity by a classifier chain.

The chain predicts low quality, then toxic, then severe, each by a linear model over the text's features and the
earlier categories' probabilities. Later links are trained on out-of-fold probabilities, so that they see the earlier
links as wrong as those are on new texts. Severe is labelled from the labelled texts: toxic ones in which the share of
words with a telling feature is at least the toxic median.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loamwork.llm import worker
from loamwork.llm.store import materialise, prepare

#: Labelled documents that the chain is fitted on, the first by a hash of their ids. Scoring covers every document.
SAMPLE = 8_000
#: Features taken for each label, the most telling ones; the least documents of the sample that must have one, and the
#: least chi-square statistic.
FEATURES, LEAST_DOCS, LEAST_CHI2 = 2_048, 5, 10.8
FOLDS = 4
LINKS = ("low_quality", "toxic", "severe")
PREFIXES = (4, 5)
_WORD = re.compile(r"[^\W\d_]+")


def words(text: str | None) -> set[str]:
    return set(_WORD.findall((text or "").lower()))


def features(word: str) -> list[str]:
    """A word's features: itself and its beginnings, which reach inflected forms that the sample lacks."""
    return [word, *(f"{word[:k]}*" for k in PREFIXES if len(word) > k)]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents of the partition with each feature, by label."""
    total: dict[str, Counter] = {k: Counter() for k in ("n", "low", "tox")}
    for batch in batches:
        for text, quality, toxic in zip(*(batch.column(c).to_pylist() for c in ("text", "quality", "toxic")), strict=True):
            own = {f for w in words(text) for f in features(w)}
            total["n"].update(own)
            if quality == 0:
                total["low"].update(own)
            if toxic == 1:
                total["tox"].update(own)
    names = list(total["n"])
    yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), *(pa.array([c[x] for x in names], pa.int64()) for c in total.values())], names=["feature", *total])


def telling(labelled: DataFrame) -> list[str]:
    """The features that depend most on either label, by the chi-square statistic."""
    total = labelled.agg(F.count("*").alias("n"), F.sum(F.expr("cast(quality = 0 as int)")).alias("low"), F.sum(F.expr("cast(toxic = 1 as int)")).alias("tox")).first()
    counts = labelled.mapInArrow(_count, "feature string, n long, low long, tox long").groupBy("feature").agg(*(F.sum(c).alias(c) for c in ("n", "low", "tox"))).filter(F.col("n") >= LEAST_DOCS)
    counts = materialise(counts, "features")

    def chi2(label: str) -> Column:
        pos = total[label] or 0
        if not 0 < pos < total["n"]:
            return F.lit(0.0)
        a, n = F.col(label).cast("double"), F.col("n").cast("double")
        return total["n"] * F.pow(a * total["n"] - n * pos, 2) / (n * F.greatest(total["n"] - n, F.lit(1.0)) * pos * (total["n"] - pos))

    def top(label: str) -> list[str]:
        ranked = counts.select("feature", chi2(label).alias("chi2")).filter(F.col("chi2") > LEAST_CHI2)
        return [r["feature"] for r in ranked.orderBy(F.desc("chi2"), "feature").limit(FEATURES).collect()]

    return list(dict.fromkeys([*top("tox"), *top("low")]))


class Active:
    """The selected features of a text, through a bounded memory of words."""

    def __init__(self, names: list[str]):
        self.of, self.memory = {f: i for i, f in enumerate(names)}, {}

    def __call__(self, text: str | None) -> tuple[np.ndarray, int, int]:
        """(feature numbers ascending, words with one, words)."""
        memory, own, hits = self.memory, set(), 0
        if len(memory) > 400_000:
            memory.clear()
        all_ = words(text)
        for w in all_:
            got = memory.get(w)
            if got is None:
                got = memory[w] = tuple(self.of[f] for f in features(w) if f in self.of)
            if got:
                own.update(got)
                hits += 1
        return np.fromiter(sorted(own), np.int64, len(own)), hits, len(all_)


@dataclass(frozen=True)
class Link:
    """weights of the features, then of the earlier links' probabilities; bias."""

    weights: np.ndarray
    bias: float

    def probabilities(self, row: np.ndarray, active: np.ndarray, earlier: np.ndarray) -> np.ndarray:
        """Of texts whose features are the pairs (row, active), after earlier links (texts x links): one sparse product."""
        n, k = earlier.shape
        z = self.bias + np.bincount(row, self.weights[active], n) + earlier @ self.weights[len(self.weights) - k :]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def logistic(rows: np.ndarray, cols: np.ndarray, vals: np.ndarray, y: np.ndarray, width: int, l2: float = 0.1, steps: int = 200, settled: float = 5e-4) -> Link:
    """L2-regularised logistic regression on triplets, by accelerated gradient with a step size a column, until no weight
    moves by `settled` in a step, or for so many steps."""
    n, w, b = len(y), np.zeros(width), 0.0
    if not 0 < y.sum() < n:  # one class: its smoothed share, whatever the text
        p = (y.sum() + 0.5) / (n + 1)
        return Link(w, float(np.log(p / (1 - p))))
    b = float(np.log(y.mean() / (1 - y.mean())))
    by = np.argsort(rows, kind="stable")
    row_names, row_at = np.unique(rows[by], return_index=True)
    row_cols, row_vals = cols[by], vals[by]
    by = np.argsort(cols, kind="stable")
    col_names, col_at = np.unique(cols[by], return_index=True)
    col_rows, col_vals = rows[by], vals[by]
    del by
    each = np.bincount(rows, vals, n) + 1  # bounds the curvature with the other columns a row has
    curve = 0.25 * np.bincount(cols, np.abs(vals) * each[rows], width) + l2
    curve_b = 0.25 * each.sum()
    look, look_b = w.copy(), b
    for t in range(steps):
        z = np.full(n, look_b)
        z[row_names] += np.add.reduceat(row_vals * look[row_cols], row_at)
        err = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - y
        slope = l2 * look
        slope[col_names] += np.add.reduceat(col_vals * err[col_rows], col_at)
        new = look - slope / curve
        new_b = look_b - err.sum() / curve_b
        pace = t / (t + 3)
        look, look_b = new + pace * (new - w), new_b + pace * (new_b - b)
        still = max(np.abs(new - w).max(initial=0), abs(new_b - b)) < settled
        w, b = new, new_b
        if still:
            break
    return Link(w, b)


@dataclass(frozen=True)
class Chain:
    names: list[str]
    links: list[Link]

    def scorer(self):
        """texts -> the categories' probabilities (texts x links), first link first."""
        active = Active(self.names)

        def score(texts: list[str | None]) -> np.ndarray:
            row, own = flat([active(t)[0] for t in texts])
            out = np.zeros((len(texts), 0))
            for link in self.links:
                out = np.column_stack([out, link.probabilities(row, own, out)])
            return out

        return score


def flat(actives: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(row, feature) of all features of some texts."""
    sizes = [len(a) for a in actives]
    return np.repeat(np.arange(len(actives)), sizes), np.concatenate([*actives, np.zeros(0, np.int64)])


def _triplets(actives: list[np.ndarray], earlier: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n, k = earlier.shape
    row, own = flat(actives)
    rows = np.concatenate([row, np.repeat(np.arange(n), k)]).astype(np.int32)
    cols = np.concatenate([own, np.tile(np.arange(k) + width, n)]).astype(np.int32)
    return rows, cols, np.concatenate([np.ones(len(rows) - n * k), earlier.ravel()])


def fit_chain(names: list[str], actives: list[np.ndarray], labels: np.ndarray, fold: np.ndarray) -> tuple[Chain, np.ndarray]:
    """The chain, and the out-of-fold probabilities of its rows (rows x links)."""
    n, width = len(actives), len(names)
    out, links = np.zeros((n, 0)), []
    for j in range(labels.shape[1]):
        rows, cols, vals = _triplets(actives, out, width)
        held = np.zeros(n)
        for f in range(FOLDS):
            rest = fold != f
            mine = rest[rows]
            place = np.cumsum(rest) - 1
            link = logistic(place[rows[mine]], cols[mine], vals[mine], labels[rest, j], width + j)
            row, own = flat([actives[i] for i in np.flatnonzero(~rest)])
            held[~rest] = link.probabilities(row, own, out[~rest])
        links.append(logistic(rows, cols, vals, labels[:, j], width + j))
        out = np.column_stack([out, held])
    return Chain(names, links), out


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Chain:
    """Fit on at most `sample` documents that have a toxic label; a null quality counts as good.

    Rows of labels that share an id count once, by their largest toxic and least quality. No label, no text that has
    one, or one class only: the links predict the smoothed share of their label. Of texts that share an id the least counts.
    """
    prepare(docs.sparkSession)
    once = labels.filter("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"), F.coalesce(F.min("quality"), F.lit(1)).alias("quality"))
    chosen = once.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)  # bounded, so it may be broadcast
    labelled = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "quality", "toxic").agg(F.min("text").alias("text"))
    labelled = materialise(labelled.repartition(8, "doc_id"), "labelled")
    names = telling(labelled)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        active = Active(names)
        for batch in batches:
            got = [active(t) for t in batch.column("text").to_pylist()]
            made = [pa.array([g[0].tolist() for g in got], pa.list_(pa.int32())), pa.array([g[1] / max(1, g[2]) for g in got], pa.float64())]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("quality"), batch.column("toxic"), *made], names=["doc_id", "quality", "toxic", "active", "share"])

    kinds = {f.name: f.dataType.simpleString() for f in labelled.schema.fields}
    # `sample` rows at most, as arrays: no Python object a feature on the driver
    rows = labelled.mapInArrow(encode, f"doc_id {kinds['doc_id']}, quality {kinds['quality']}, toxic {kinds['toxic']}, active array<int>, share double").toArrow().sort_by("doc_id").combine_chunks()
    told = {c: rows[c].to_numpy() for c in ("quality", "toxic", "share")}
    held = rows["active"].combine_chunks() if rows.num_rows else pa.array([], pa.list_(pa.int32()))
    actives = np.split(held.flatten().to_numpy(), held.offsets.to_numpy()[1:-1] - held.offsets.to_numpy()[0]) if rows.num_rows else []
    toxic = (told["toxic"] == 1).astype(float)
    severe = toxic * (told["share"] >= (np.median(told["share"][toxic == 1]) if toxic.any() else 1))
    y = np.column_stack([(told["quality"] == 0).astype(float), toxic, severe])
    return fit_chain(names, actives, y, np.arange(rows.num_rows) * 2654435761 % (1 << 32) * FOLDS >> 32)[0]


def score(text: Column, chain: Chain) -> Column:
    """A struct of doubles, one a category, over the whole text (null: empty)."""
    fields = ", ".join(f"{k}: double" for k in LINKS)

    @F.arrow_udf(f"struct<{fields}>")
    def of(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        worker.free()
        scorer = chain.scorer()
        for batch in texts:
            got = scorer(batch.to_pylist())
            yield pa.StructArray.from_arrays([pa.array(got[:, j]) for j in range(len(LINKS))], names=list(LINKS))

    return of(text)


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, sample: int = SAMPLE) -> DataFrame:
    """docs with toxicity (the struct of probabilities) and toxic (its toxic probability reaches the threshold). Columns of
    docs with these names are replaced. Every row is scored by its own text, a null one as empty; no rows give none."""
    chain = train(docs.select("doc_id", "text"), labels.select("doc_id", "quality", "toxic"), sample)
    return docs.withColumn("toxicity", score(F.col("text"), chain)).withColumn("toxic", F.col("toxicity.toxic") >= threshold)
