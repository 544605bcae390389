"""Quality classifier by co-training of two views.

Text view: shares of characters of each kind, triples of kinds, repeated
words, and the same for the worst line, all over the whole text. Metadata view:
language, source and length as the table gives them.

Training uses a bounded sample (``most_labelled`` labelled and ``most_pool``
unlabelled rows, the smallest hashes of the ids). In each round both views are
fitted anew (logistic regression), calibrated on a held-out fifth, and each
hands its most confident pseudo-labels for pool rows to the other view: the
first ``per_round`` by rank (a tenth of a small pool), of both classes in
proportion to the labels. A pseudo-label weighs as much as its giver's chance
lies above the class's share, times how well the giver ranks the held-out rows
(1 if certain and never wrong, nothing if it ranks them like a coin), so a weak
view teaches only as much as it knows. At last both views are calibrated and
combined (logistic, five folds), and every document is scored.

Only the sample's features (about 2 kB a row) come to the driver; weights of a
few kilobytes are broadcast.

Defined results. Null text is empty; null language or source is a value of its
own; a null length counts as the text's. Documents with several labels take
their mean, above a half being good. If the sample has fewer than two labels of one
kind, nothing can be told apart and every document is kept, its score the share of
good labels (1 if there are none). Repeated rows are scored each; of rows that
share an id, training takes the one with the smallest text, language, source
and length. An empty
table gives an empty result. Extra columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from zonepulse.llm.common import stored, worker_state
from zonepulse.llm.hashing import words_of

#: Kinds of bytes: other, upper, lower, digit, space, line end, sentence mark, symbol.
KIND = np.zeros(256, np.int64)
KIND[65:91], KIND[97:123], KIND[48:58], KIND[128:] = 1, 2, 3, 2
KIND[[0x20, 0x09, 0x0B, 0x0C]], KIND[[0x0A, 0x0D]] = 4, 5
KIND[[ord(c) for c in ".,;:?!'\"()-"]] = 6
KIND[[ord(c) for c in "#$%&*+/<=>@[\\]^_`{|}~"]] = 7
N_KINDS = 8
LINE_FEATURES = 6
N_TEXT = N_KINDS**3 + 4 * LINE_FEATURES + 4
N_META = 128
#: Lines shorter than this tell nothing of their own.
SHORT_LINE = 20


def text_features(data: np.ndarray) -> np.ndarray:
    """Features of a text's bytes; long texts are taken in parts and added up."""
    out = np.zeros(N_TEXT, np.float32)
    if not len(data):
        return out
    triples = np.zeros(N_KINDS**3, np.int64)
    for at in range(0, len(data), 1 << 20):
        kind = KIND[data[at : at + (1 << 20) + 2]]
        if len(kind) > 2:
            triples += np.bincount(kind[:-2] * 64 + kind[1:-1] * 8 + kind[2:], minlength=N_KINDS**3)
    out[: N_KINDS**3] = np.sqrt(triples / max(1, triples.sum()))

    hashes, start, stop = words_of(data)
    same = np.zeros(len(hashes), bool)
    same[1:] = hashes[1:] == hashes[:-1]
    n = max(1, len(hashes))
    ends = np.flatnonzero(data == 0x0A)
    line_start = np.concatenate([[0], ends + 1])
    line_start = line_start[line_start < len(data)]
    length = np.diff(np.concatenate([line_start, [len(data)]]))
    word_line = np.searchsorted(line_start, start, "right") - 1
    words = np.maximum(1, np.bincount(word_line, minlength=len(line_start)))

    def in_line(mask: np.ndarray) -> np.ndarray:
        return np.add.reduceat(mask.astype(np.int32), line_start)

    letters = in_line((data >= 65) & (data < 91)) + in_line((data >= 97) & (data < 123))
    shares = np.stack(
        [
            in_line((data >= 65) & (data < 91)) / np.maximum(1, letters),
            in_line(KIND[data] == 7) / words,
            in_line(data == 33) / words,
            np.bincount(word_line, weights=same, minlength=len(line_start)) / words,
            in_line((data >= 48) & (data < 58)) / length,
            in_line(data == 124) / words,
        ]
    )
    weight = length / length.sum()
    told = length >= SHORT_LINE
    worst = shares[:, told].max(1) if told.any() else shares.max(1)
    at = N_KINDS**3
    out[at : at + 4 * LINE_FEATURES] = np.concatenate(
        [np.minimum(shares @ weight, 4), np.minimum(worst, 4), (shares > 0.2) @ weight, (shares > 0.6) @ weight]
    )
    distinct, counts = np.unique(hashes, return_counts=True)
    out[-4:] = [
        len(distinct) / n * np.log1p(n),
        counts.max() / n if len(counts) else 0,
        np.minimum((stop - start).sum() / n, 40) / 10 if len(start) else 0,
        np.log1p(len(data)) / 10,
    ]
    return out


def meta_features(lang: str | None, source: str | None, n_chars: int) -> np.ndarray:
    """Hashed language, source and length class."""
    out = np.zeros(N_META, np.float32)
    size = int(np.log2(1 + max(0, n_chars)) * 2)
    for name in (f"l{lang}", f"s{source}", f"n{size}", f"l{lang}n{size // 4}"):
        out[zlib.crc32(name.encode()) % (N_META - 1)] += 1
    out[-1] = np.log1p(max(0, n_chars)) / 10
    return out


@dataclass
class Logistic:
    """Standardised logistic regression with a quadratic penalty, fitted by Newton steps."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray, penalty: float = 1.0, steps: int = 25, trust: np.ndarray | None = None) -> Logistic:
        """``trust`` weighs the rows; both classes weigh the same in sum."""
        x = x.astype(np.float64)
        trust = np.ones(len(y)) if trust is None else trust
        mean, scale = x.mean(0), x.std(0)
        scale[scale < 1e-6] = np.inf  # a constant column says nothing
        z = np.hstack([(x - mean) / scale, np.ones((len(x), 1))])
        w = np.zeros(z.shape[1])
        ridge = np.full(len(w), penalty)
        ridge[-1] = 1e-6
        share = (trust * y).sum() / trust.sum()
        balance = trust * np.where(y > 0.5, 0.5 / max(share, 1e-9), 0.5 / max(1 - share, 1e-9))
        for _ in range(steps):
            p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
            gradient = z.T @ (balance * (p - y)) + ridge * w
            curve = (z.T * (balance * p * (1 - p))) @ z + np.diag(ridge)
            step = np.linalg.solve(curve, gradient)
            w -= step * min(1.0, 5 / max(1e-12, np.abs(step).max()))
            if np.abs(step).max() < 1e-6:
                break
        return cls(mean, scale, w)

    def margin(self, x: np.ndarray) -> np.ndarray:
        z = (x.astype(np.float64) - self.mean) / self.scale
        return np.clip(z @ self.weights[:-1] + self.weights[-1], -30, 30)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def platt(margin: np.ndarray, y: np.ndarray, steps: int = 100) -> tuple[float, float]:
    """Slope and shift that turn margins into probabilities (targets smoothed as Platt proposed).

    Newton steps, halved until the loss falls: margins may be separated widely.
    """
    good, bad = y.sum(), len(y) - y.sum()
    target = np.where(y > 0.5, (good + 1) / (good + 2), 1 / (bad + 2))
    z = np.stack([margin, np.ones_like(margin)], 1)
    prior, penalty = np.array([1.0, 0.0]), 1e-2

    def loss(w: np.ndarray) -> float:
        x = z @ w
        return float((np.logaddexp(0, x) - target * x).sum() + penalty / 2 * ((w - prior) ** 2).sum())

    w, best = prior, loss(prior)
    for _ in range(steps):
        p = sigmoid(z @ w)
        step = np.linalg.solve((z.T * (p * (1 - p))) @ z + penalty * np.eye(2), z.T @ (p - target) + penalty * (w - prior))
        size = 1.0
        while size > 1e-6 and loss(w - size * step) >= best:
            size /= 2
        if size <= 1e-6:
            break
        w = w - size * step
        best = loss(w)
    return max(0.0, float(w[0])), float(w[1])


@dataclass
class Model:
    """Two calibrated views and their combination; ``handed``: per round and view, how many good and bad labels it gave, and their weight."""

    text: Logistic
    meta: Logistic
    text_platt: tuple[float, float]
    meta_platt: tuple[float, float]
    combination: np.ndarray
    handed: list[tuple[int, str, int, int, float]] = field(default_factory=list)

    def view_logits(self, text: np.ndarray, meta: np.ndarray) -> np.ndarray:
        a = self.text_platt[0] * self.text.margin(text) + self.text_platt[1]
        b = self.meta_platt[0] * self.meta.margin(meta) + self.meta_platt[1]
        return np.stack([a, b, np.ones_like(a)], 1)

    def scores(self, text: np.ndarray, meta: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        views = self.view_logits(text, meta)
        return sigmoid(views[:, 0]), sigmoid(views[:, 1]), sigmoid(views @ self.combination)


def rank_skill(margin: np.ndarray, y: np.ndarray) -> float:
    """How much more often a good row lies above a bad one than below: 1 always, 0 like a coin or worse (ties count half)."""
    good, bad = margin[y > 0.5], np.sort(margin[y < 0.5])
    if not len(good) or not len(bad):
        return 0.0
    above, not_below = np.searchsorted(bad, good, "left"), np.searchsorted(bad, good, "right")
    return max(0.0, float((above + not_below).sum() / (len(good) * len(bad)) - 1))


FOLDS = 5


def folds_of(y: np.ndarray) -> np.ndarray:
    """Each row's fold, every kind of label dealt evenly."""
    fold = np.zeros(len(y), np.int64)
    for label in (0, 1):
        rows = np.flatnonzero(y == label)
        fold[rows] = np.arange(len(rows)) % FOLDS
    return fold


def cotrain(
    text: np.ndarray, meta: np.ndarray, y: np.ndarray, pool_text: np.ndarray, pool_meta: np.ndarray, rounds: int, per_round: int
) -> Model:
    """Fit both views over rounds in which each teaches the other what it is most sure of.

    In the rounds the first fold is held out for calibration. At the end the
    views are fitted on all labelled rows; calibration and combination use
    the margins that each row gets from a fit without its fold.
    """
    fold = folds_of(y)
    # labels that the other view gave: row of the pool -> label and weight
    given: tuple[dict[int, tuple[int, float]], dict[int, tuple[int, float]]] = ({}, {})
    views, pools, handed = (text, meta), (pool_text, pool_meta), []

    def fitted(v: int, use: np.ndarray) -> Logistic:
        rows = sorted(given[v])
        told, trust = (np.array([given[v][r][k] for r in rows], np.float64) for k in (0, 1))
        x = np.vstack([views[v][use], pools[v][rows]])
        return Logistic.fit(x, np.concatenate([y[use], told]), trust=np.concatenate([np.ones(use.sum()), trust]))

    for turn in range(rounds):
        chance, skill = [], []
        for v in (0, 1):
            model = fitted(v, fold > 0)
            held = model.margin(views[v][fold == 0])
            slope, shift = platt(held, y[fold == 0])
            skill.append(rank_skill(held, y[fold == 0]))
            chance.append(sigmoid(slope * model.margin(pools[v]) + shift))
        for v in (0, 1):
            counts, weight = [], 0.0
            for label, p, share in ((1, chance[v], y.mean()), (0, 1 - chance[v], 1 - y.mean())):
                wanted = max(1, round(min(per_round, len(p) / 10) * share))
                free = (int(r) for r in np.argsort(-p, kind="stable") if p[r] > share and int(r) not in given[1 - v])
                taken = {r: (label, skill[v] * float((p[r] - share) / (1 - share))) for r in islice(free, wanted)}
                given[1 - v].update(taken)
                counts.append(len(taken))
                weight += sum(w for _, w in taken.values())
            handed.append((turn, ("text", "meta")[v], counts[0], counts[1], weight))

    calibrated, logits = [], []
    for v in (0, 1):
        margin = np.zeros(len(y))
        for f in range(FOLDS):
            if (fold == f).any():
                margin[fold == f] = fitted(v, fold != f).margin(views[v][fold == f])
        calibrated.append(platt(margin, y))
        logits.append(calibrated[v][0] * margin + calibrated[v][1])
    both = np.stack(logits, 1)
    joint = Logistic.fit(both, y, penalty=0.1)
    slope, shift = platt(joint.margin(both), y)
    w = slope * joint.weights[:-1] / joint.scale
    rest = slope * (joint.weights[-1] - (joint.weights[:-1] / joint.scale * joint.mean).sum()) + shift
    every = np.ones(len(y), bool)
    return Model(fitted(0, every), fitted(1, every), calibrated[0], calibrated[1], np.array([w[0], w[1], rest]), handed)


def _rows(docs: DataFrame, id_col: str) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        text.alias("text"),
        F.col("lang").cast("string").alias("lang"),
        F.col("source").cast("string").alias("source"),
        F.coalesce(F.col("n_chars").cast("long"), F.length(text).cast("long")).alias("n_chars"),
    )


def _features(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    text = [text_features(np.frombuffer(t.as_buffer() or b"", np.uint8)) for t in batch.column("text")]
    meta = [meta_features(*m) for m in zip(*(batch.column(c).to_pylist() for c in ("lang", "source", "n_chars")), strict=True)]
    return np.array(text).reshape(-1, N_TEXT), np.array(meta).reshape(-1, N_META)


def train(
    docs: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id",
    most_labelled: int = 6000, most_pool: int = 3000, rounds: int = 3, per_round: int = 300,
) -> Model | float:
    """The model, or the share of good labels if only one kind is there. The sample is bounded by the two ``most``."""
    rows = _rows(docs, id_col)
    told = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull())
    told = told.groupBy(F.col(id_col).cast("long").alias("doc_id")).agg((F.avg(label_col) > 0.5).cast("int").alias("label"))
    order = (F.xxhash64("doc_id"), "doc_id")
    chosen = told.orderBy(*order).limit(most_labelled)
    ids = rows.select("doc_id").where("doc_id is not null").distinct()
    pool = ids.orderBy(*order).limit(4 * (most_pool + most_labelled)).join(told, "doc_id", "left_anti").orderBy(*order).limit(most_pool)
    sample = stored(chosen.unionByName(pool.withColumn("label", F.lit(None).cast("int"))), "sample")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_state("quality")
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                text, meta = _features(batch)
                yield pa.RecordBatch.from_pydict(
                    {
                        "doc_id": batch.column("doc_id"),
                        "label": batch.column("label"),
                        "text": pa.array([t.tobytes() for t in text], pa.binary()),
                        "meta": pa.array([m.tobytes() for m in meta], pa.binary()),
                    }
                )

    # the sample has at most most_labelled + most_pool rows
    row = F.min(F.struct("text", "lang", "source", "n_chars")).alias("row")
    picked = rows.join(F.broadcast(sample), "doc_id").groupBy("doc_id", "label").agg(row).select("doc_id", "label", "row.*")
    made = picked.mapInArrow(run, "doc_id long, label int, text binary, meta binary").orderBy("doc_id").collect()
    table = lambda rows, c: np.frombuffer(b"".join(bytes(r[c]) for r in rows), np.float32).reshape(len(rows), -1)
    known, free = [r for r in made if r["label"] is not None], [r for r in made if r["label"] is None]
    y = np.array([r["label"] for r in known], np.float64)
    if min((y == 0).sum(), (y == 1).sum()) < 2:
        return float(y.mean()) if len(y) else 1.0
    empty = np.zeros((0, N_TEXT), np.float32), np.zeros((0, N_META), np.float32)
    free_text, free_meta = (table(free, "text"), table(free, "meta")) if free else empty
    return cotrain(table(known, "text"), table(known, "meta"), y, free_text, free_meta, rounds, per_round)


def classify(docs: DataFrame, model: Model | float, threshold: float = 0.5, id_col: str = "doc_id") -> DataFrame:
    """One row per document: doc_id, score_text, score_meta, score, kept (score of at least ``threshold``)."""
    if not isinstance(model, Model):
        share = F.lit(float(model))
        return _rows(docs, id_col).select(
            "doc_id", share.alias("score_text"), share.alias("score_meta"), share.alias("score"), F.lit(True).alias("kept")
        )
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_state("quality")
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                text, meta, both = shared.value.scores(*_features(batch))
                yield pa.RecordBatch.from_pydict(
                    {"doc_id": batch.column("doc_id"), "score_text": text, "score_meta": meta, "score": both, "kept": both >= threshold}
                )

    kind = "doc_id long, score_text double, score_meta double, score double, kept boolean"
    return _rows(docs, id_col).mapInArrow(run, kind)


def quality_scores(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, **options) -> DataFrame:
    return classify(docs, train(docs, labels, **options), threshold)


def kept_documents(docs: DataFrame, model: Model | float, threshold: float = 0.5, id_col: str = "doc_id") -> DataFrame:
    """The rows of ``docs`` that the model keeps, with all their columns (no shuffle)."""
    if not isinstance(model, Model):
        return docs
    shared = docs.sparkSession.sparkContext.broadcast(model)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    view = F.struct(
        text.alias("text"),
        F.col("lang").cast("string").alias("lang"),
        F.col("source").cast("string").alias("source"),
        F.coalesce(F.col("n_chars").cast("long"), F.length(text).cast("long")).alias("n_chars"),
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_state("quality")
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                seen = batch.column(batch.num_columns - 1)
                both = shared.value.scores(*_features(pa.RecordBatch.from_arrays(seen.flatten(), [f.name for f in seen.type])))[2]
                yield batch.filter(pa.array(both >= threshold)).select(list(range(batch.num_columns - 1)))

    return docs.withColumn("__view", view).mapInArrow(run, docs.schema)
