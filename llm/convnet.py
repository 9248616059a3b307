"""Toxicity with a convolutional text classifier, in numpy.

Words are hashed to rows of an embedding table.  Filters of several widths slide over the whole
text, each gives its largest value (max pooling), and a logistic layer turns these into a score.  It is
trained by Adam on the labelled documents of the training side, up to `SAMPLE` of them (those with the
smallest hash of their id, the documented bound); a fifth of them is held back to calibrate the score
(a slope and an intercept) and to choose a threshold for each language.

The score of a text depends on its words only.  Language enters after the score, as the choice of the
threshold of the column `flagged`.

Documents are scored in place, as whole texts: after training, each filter is a table from word to
value for each of its places, so a convolution is a sum of table rows.

A null or empty text has the score of a text without words.  A null id is not held out.  Documents
without a label, or with a null label, are not learned from.  A language without enough labelled
documents has the general threshold.  Repeated rows are separate documents.  Without labels of both
kinds every score is the share of toxic ones (0 without any labels).  An empty table gives an empty
result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from llm.scratch import Scratch
from llm.textops import ALNUM, pieces, words

SAMPLE = 16_000
BUCKETS, SIZE = 1 << 15, 16
WIDTHS, FILTERS = (1, 2, 3), 8
#: Passes over the sample (more of them over a small one, up to `MOST`, for `STEPS` batches).
EPOCHS, MOST, STEPS, BATCH = 10, 25, 1_700, 32
#: Step of Adam for filters and layer, of plain gradients for embeddings, and share of words left out.
RATE, EMBED_RATE, DROP = 0.003, 1.0, 0.5
#: Labelled toxic documents of a language that a threshold of its own needs.
ENOUGH = 20


def word_rows(data: np.ndarray, offsets: np.ndarray, buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray]:
    """Embedding rows of the words of some texts, and the offsets of the texts in them.

    Each text ends with rows 0, as many as the widest filter needs; words have rows from 1 on.
    """
    found = words(data, offsets, ALNUM)
    hashes, at = found.grams(1, shorter=False)
    pad = max(WIDTHS)
    starts = at + np.arange(len(at)) * pad
    rows = np.zeros(starts[-1], np.int32)
    rows[np.arange(len(hashes)) + np.repeat(starts[:-1] - at[:-1], np.diff(at))] = hashes % np.uint64(buckets - 1) + np.uint64(1)
    return rows, starts


def over_the_end(starts: np.ndarray, width: int) -> np.ndarray:
    """Places where a filter of this width would reach into the next text."""
    return (starts[1:, None] - 1 - np.arange(width - 1)).ravel()


@dataclass
class Net:
    """Embeddings, filters (one array `width x SIZE x FILTERS` for each width), biases, logistic layer."""

    parts: dict = field(default_factory=dict)
    slope: float = 1.0
    shift: float = 0.0

    @staticmethod
    def random(seed: int = 3) -> Net:
        r = np.random.default_rng(seed)
        # Small: a word that was never learned from adds next to nothing.
        parts = {"embed": r.normal(0, 0.01, (BUCKETS, SIZE)).astype(np.float32)}
        parts["embed"][0] = 0
        for w in WIDTHS:
            parts[f"filter{w}"] = r.normal(0, 0.5 / np.sqrt(w), (w, SIZE, FILTERS)).astype(np.float32)
            parts[f"bias{w}"] = np.zeros(FILTERS, np.float32)
        parts["out"] = r.normal(0, 0.3, len(WIDTHS) * FILTERS).astype(np.float32)
        parts["base"] = np.full(1, -1.0, np.float32)
        return Net(parts)

    def tables(self) -> dict:
        """For each width and place of a filter, its value for each word."""
        p = self.parts
        return {(w, k): p["embed"] @ p[f"filter{w}"][k] for w in WIDTHS for k in range(w)}

    def pooled(self, rows: np.ndarray, starts: np.ndarray, tables: dict) -> np.ndarray:
        """Largest value of each filter in each text."""
        out = []
        for w in WIDTHS:
            values = tables[w, 0][rows]
            for k in range(1, w):
                values[:-k] += tables[w, k][rows[k:]]
            values[over_the_end(starts, w)] = -np.inf
            out.append(np.maximum.reduceat(values, starts[:-1]) + self.parts[f"bias{w}"])
        return np.maximum(np.concatenate(out, axis=1), 0)

    def scores(self, rows: np.ndarray, starts: np.ndarray, tables: dict) -> np.ndarray:
        logit = self.pooled(rows, starts, tables) @ self.parts["out"] + self.parts["base"][0]
        return 1 / (1 + np.exp(-np.clip(self.slope * logit.astype(np.float64) + self.shift, -700, 700)))


def gradients(net: Net, rows: np.ndarray, starts: np.ndarray, labels: np.ndarray, weight: np.ndarray) -> dict:
    """Gradients of the mean loss; those of the embeddings as `(rows, values)`."""
    p = net.parts
    texts = np.arange(len(labels))
    owner = np.repeat(texts, np.diff(starts))
    used, inverse = np.unique(rows, return_inverse=True)
    embed = p["embed"][used]
    grads, pools, places = {}, [], []
    for w in WIDTHS:
        tables = [embed @ p[f"filter{w}"][k] for k in range(w)]
        values = tables[0][inverse]
        for k in range(1, w):
            values[:-k] += tables[k][inverse[k:]]
        values[over_the_end(starts, w)] = -np.inf
        top = np.maximum.reduceat(values, starts[:-1])
        # The first place of the largest value of each text and filter.
        hit, which = np.nonzero(values == top[owner])
        place = np.full(top.shape, len(rows), np.int64)
        np.minimum.at(place, (owner[hit], which), hit)
        places.append(place)
        pools.append(top + p[f"bias{w}"])
    pool = np.concatenate(pools, axis=1)
    active = np.maximum(pool, 0)
    logit = active @ p["out"] + p["base"][0]
    error = (1 / (1 + np.exp(-logit)) - labels) * weight / len(labels)
    grads["out"] = active.T @ error + 1e-4 * p["out"]
    grads["base"] = np.array([error.sum()], np.float32)
    back = (error[:, None] * p["out"]) * (pool > 0)
    moved, by = [], []
    for n, w in enumerate(WIDTHS):
        g = back[:, n * FILTERS : (n + 1) * FILTERS]
        grads[f"bias{w}"] = g.sum(axis=0)
        filters = np.zeros_like(p[f"filter{w}"])
        for k in range(w):
            at = np.minimum(places[n] + k, len(rows) - 1)
            word = rows[at]
            filters[k] = np.einsum("tf,tfd->df", g, p["embed"][word])
            moved.append(word.ravel())
            by.append((g[:, :, None] * p[f"filter{w}"][k].T[None]).reshape(-1, SIZE))
        grads[f"filter{w}"] = filters
    moved, by = np.concatenate(moved), np.concatenate(by)
    some = np.unique(moved, return_inverse=True)
    total = np.zeros((len(some[0]), SIZE), np.float32)
    np.add.at(total, some[1], by)
    real = some[0] > 0
    grads["embed"] = (some[0][real], total[real])
    return grads


def train(texts: list[np.ndarray], labels: np.ndarray, epochs: int | None = None, seed: int = 3) -> Net:
    """Adam over batches, plain gradients for the embeddings (a word that is rare moves little).

    Toxic documents weigh as much as the others together.  In each pass a random share of the
    words is left out, so no document is known by a single word.
    """
    epochs = epochs or min(MOST, max(EPOCHS, -(-STEPS * BATCH // len(texts))))
    net = Net.random(seed)
    r = np.random.default_rng(seed + 1)
    first, second = ({k: np.zeros_like(v) for k, v in net.parts.items() if k != "embed"} for _ in range(2))
    share = labels.mean()
    weight = np.where(labels > 0, 0.5 / share, 0.5 / (1 - share))
    turn = 0
    for _ in range(epochs):
        order = r.permutation(len(texts))
        for a in range(0, len(order), BATCH):
            some = order[a : a + BATCH]
            rows = np.concatenate([texts[k] for k in some])
            rows[r.random(len(rows)) < DROP] = 0
            starts = np.concatenate(([0], np.cumsum([len(texts[k]) for k in some])))
            turn += 1
            for name, g in gradients(net, rows, starts, labels[some], weight[some]).items():
                if name == "embed":
                    net.parts[name][g[0]] -= EMBED_RATE * g[1]
                    continue
                m, v = first[name], second[name]
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                net.parts[name] -= RATE * (m / (1 - 0.9**turn)) / (np.sqrt(v / (1 - 0.999**turn)) + 1e-6)
    return net


def calibrate(net: Net, logits: np.ndarray, labels: np.ndarray) -> None:
    """Slope and intercept by Newton steps on the log loss, with targets drawn in from 0 and 1."""
    up, down = labels.sum(), len(labels) - labels.sum()
    goal = np.where(labels > 0, (up + 1) / (up + 2), 1 / (down + 2))
    x = np.stack([logits, np.ones_like(logits)], axis=1)
    theta = np.array([1.0, 0.0])
    for _ in range(50):
        q = 1 / (1 + np.exp(-np.clip(x @ theta, -30, 30)))
        grad = x.T @ (q - goal) + 1e-3 * theta
        theta = theta - np.linalg.solve((x * (q * (1 - q))[:, None]).T @ x + 1e-3 * np.eye(2), grad)
    net.slope, net.shift = max(float(theta[0]), 1e-3), float(theta[1])


def best_threshold(scores: np.ndarray, labels: np.ndarray) -> float:
    """The threshold with the best F1; in the middle between the neighbouring scores."""
    order = np.argsort(-scores, kind="stable")
    hits = np.cumsum(labels[order])
    f1 = 2 * hits / (np.arange(1, len(order) + 1) + labels.sum())
    k = int(f1.argmax())
    after = scores[order[k + 1]] if k + 1 < len(order) else 0.0
    return float((scores[order[k]] + after) / 2)


@dataclass
class Model:
    net: Net | None
    prior: float
    general: float = 0.5
    thresholds: dict = field(default_factory=dict)


def fit(labelled: DataFrame, sample: int = SAMPLE, seed: int = 3) -> Model:
    """Train on `(doc_id, text, lang, toxic)`, at most `sample` rows of it."""
    order = F.xxhash64("doc_id", F.lit(seed))
    table = labelled.where("toxic is not null").orderBy(order, "doc_id", "text").limit(sample).select("text", "lang", "toxic").toArrow()
    labels = (table.column("toxic").to_numpy() > 0).astype(np.float64)
    if labels.sum() in (0, len(labels)):
        return Model(None, float(labels.mean()) if len(labels) else 0.0)
    texts = []
    for chunk in table.column("text").chunks:
        for _, _, data, offsets in pieces(chunk):
            rows, starts = word_rows(data, offsets)
            texts += [rows[a:b] for a, b in zip(starts[:-1], starts[1:])]
    held = np.arange(len(texts)) % 5 == 0
    if min(labels[held].sum(), labels[~held].sum(), (1 - labels[held]).sum(), (1 - labels[~held]).sum()) == 0:
        held[:] = True
    learn = np.flatnonzero(~held) if not held.all() else np.arange(len(texts))
    net = train([texts[k] for k in learn], labels[learn], seed=seed)
    check = np.flatnonzero(held)
    tables = net.tables()
    rows = np.concatenate([texts[k] for k in check])
    starts = np.concatenate(([0], np.cumsum([len(texts[k]) for k in check])))
    logits = (net.pooled(rows, starts, tables) @ net.parts["out"] + net.parts["base"][0]).astype(np.float64)
    calibrate(net, logits, labels[check])
    scores = net.scores(rows, starts, tables)
    model = Model(net, float(labels.mean()), best_threshold(scores, labels[check]))
    langs = np.array([x or "" for x in table.column("lang").to_pylist()])[check]
    for lang in np.unique(langs):
        own = langs == lang
        if labels[check][own].sum() >= ENOUGH and (1 - labels[check][own]).sum() >= ENOUGH:
            model.thresholds[str(lang)] = best_threshold(scores[own], labels[check][own])
    return model


def score(docs: DataFrame, model: Model) -> DataFrame:
    """The columns of `docs` with `score`, of the whole `text`."""
    keep = [c for c in docs.columns if c not in ("score", "text")]
    net = model.net
    # Arrays only: tasks build the net again from them.
    plain = (model.prior, net and net.parts, net and (net.slope, net.shift), net and net.tables())
    shared = docs.sparkSession.sparkContext.broadcast(plain)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        prior, parts, line, tables = shared.value
        net = parts and Net(parts, *line)
        for batch in batches:
            out = [np.zeros(0)]
            for i, j, data, offsets in pieces(batch.column("text"), limit=1 << 18):
                if net is None:
                    out.append(np.full(j - i, prior))
                else:
                    rows, starts = word_rows(data, offsets)
                    out.append(net.scores(rows, starts, tables))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(np.concatenate(out))], [*keep, "score"])

    rows = docs.select(*keep, "text")
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != "text"), "score double"])
    return rows.mapInArrow(run, schema)


def classify(
    docs: DataFrame, labels: DataFrame, held_out: Column, key: str = "doc_id", sample: int = SAMPLE, threshold: float = 0.7
) -> DataFrame:
    """`(doc_id, held_out, score, predicted, lang_threshold, flagged)` for each row of `docs (doc_id, text, lang)`.

    Labels of documents for which `held_out` is true are not learned from.  `predicted` compares the
    score with `threshold`, `flagged` with the threshold of the document's language.
    """
    scratch = Scratch(docs.sparkSession, "convnet")
    rows = docs.select(F.col(key).alias("doc_id"), "text", "lang", F.coalesce(held_out, F.lit(False)).alias("held_out"))
    # The ids of the sample, so at most `sample` of them are sent to the tasks that read the texts.
    ids = labels.select(F.col(key).alias("_id"), "toxic").where("_id is not null and toxic is not null")
    ids = ids.groupBy("_id").agg(F.max("toxic").alias("toxic")).withColumn("doc_id", F.col("_id")).where(~F.coalesce(held_out, F.lit(False)))
    ids = scratch.save(ids.select("_id", "toxic").orderBy(F.xxhash64("_id", F.lit(3)), "_id").limit(sample), "sample")
    labelled = rows.join(F.broadcast(ids), F.col("doc_id") == F.col("_id")).select("doc_id", "text", "lang", "toxic")
    model = fit(labelled, sample)
    scored = score(rows, model)
    by_lang = F.create_map(*[F.lit(x) for pair in model.thresholds.items() for x in pair]) if model.thresholds else None
    general = F.lit(model.general)
    limit = general if by_lang is None else F.coalesce(F.element_at(by_lang, F.coalesce("lang", F.lit(""))), general)
    return scored.select(
        "doc_id", "held_out", "score", (F.col("score") >= threshold).cast("int").alias("predicted"),
        limit.alias("lang_threshold"), (F.col("score") >= limit).alias("flagged"),
    )
