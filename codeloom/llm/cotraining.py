"""Quality classifier by co-training.

One classifier sees a document's text, the other its metadata. Each labels the unlabelled documents that
it is surest of for the other, round by round; then both are calibrated on labelled rows kept aside, and
the calibrated views together score every document.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.llm.common import materialize, ship, steps, text_or_empty
from codeloom.llm.toxicity import fit_logistic

#: Hashed words of a text, and all features of both views.
WORDS = 64
TEXT_SIZE, META_SIZE = 136 + WORDS, 66


def text_features(text: str) -> np.ndarray:
    """Of the whole text: shares of the bytes (those beyond ASCII together) and of its words by hash, length, word, line and repetition statistics."""
    data = text.encode("utf-8", "surrogatepass")
    counts = np.bincount(np.frombuffer(data, np.uint8), minlength=256).astype(float)
    n = max(1, len(data))
    words = data.split()
    lines = data.split(b"\n")
    more = (
        np.log1p(len(data)) / 10, np.log1p(len(words)) / 10, len(set(words)) / max(1, len(words)), len(data) / max(1, len(words)) / 10,
        len(set(lines)) / len(lines), np.log1p(len(lines)) / 5, counts[65:91].sum() / n,
    )
    hashed = np.zeros(WORDS)
    for word, times in Counter(words).items():
        hashed[xxhash.xxh3_64_intdigest(word) % WORDS] += times
    return np.concatenate((np.sqrt(counts[:128] / n), [np.sqrt(counts[128:].sum() / n)], more, np.sqrt(hashed / max(1, len(words))))).astype(np.float32)


def meta_features(values: tuple) -> np.ndarray:
    """Of the metadata: hashed values of the strings, and the size of the number if there is one."""
    made = np.zeros(META_SIZE, np.float32)
    for i, value in enumerate(values):
        if isinstance(value, (int, float)):
            made[64] = np.log1p(max(0.0, float(value))) / 10
            made[65] = made[64] ** 2
            value = f"size {int(4 * np.log2(1 + max(0.0, float(value))))}"
        made[xxhash.xxh3_64_intdigest(f"{i} {value}") % 64] += 1
    return made


@dataclass
class View:
    """A standardised logistic classifier and the straight line that calibrates its log-odds."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    line: tuple[float, float] = (0.0, 1.0)

    @staticmethod
    def fit(x: np.ndarray, y: np.ndarray) -> View:
        mean, scale = x.mean(0), x.std(0) + 1e-3
        return View(mean, scale, fit_logistic((x - mean) / scale, y, ridge=1.0))

    def odds(self, x: np.ndarray) -> np.ndarray:
        return self.line[0] + self.line[1] * np.clip(((x - self.mean) / self.scale) @ self.weights[1:] + self.weights[0], -20, 20)


@dataclass
class CoTrained:
    text: View | None
    meta: View | None
    mix: np.ndarray
    rate: float
    #: How many bad and good labels the text view, and the metadata view, have passed on.
    passed: list[list[int]] = field(default_factory=lambda: [[0, 0], [0, 0]])

    def scores(self, text: np.ndarray, meta: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Probabilities of good quality: by the text, by the metadata and by both."""
        if self.text is None or self.meta is None:
            flat = np.full(len(text), self.rate)
            return flat, flat, flat
        a, b = self.text.odds(text), self.meta.odds(meta)
        both = self.mix[0] + self.mix[1] * a + self.mix[2] * b
        return tuple(1 / (1 + np.exp(-np.clip(z, -30, 30))) for z in (a, b, both))


def log_loss(view: View, x: np.ndarray, y: np.ndarray) -> float:
    p = np.clip(1 / (1 + np.exp(-view.odds(x))), 1e-6, 1 - 1e-6)
    return float(-(y * np.log(p) + (1 - y) * np.log(1 - p)).mean())


def confident(odds: np.ndarray, known: np.ndarray, y: np.ndarray, most: int, sure: float, least: int = 5) -> np.ndarray:
    """The pool rows, at most ``most`` and surest first, whose odds are so high that of the labelled rows ``known`` with such odds a share of ``sure`` is right.

    The ``least`` labelled rows of the highest odds count in any case.
    """
    order = np.argsort(-odds, kind="stable")[:most]
    if len(known) < least:
        return order[:0]
    enough = np.sort(known)[-least]
    while len(order) and y[known >= min(odds[order[-1]], enough)].mean() < sure:
        order = order[: len(order) // 2]
    return order


def co_train(text: np.ndarray, meta: np.ndarray, y: np.ndarray, pool_text: np.ndarray, pool_meta: np.ndarray, rounds: int = 5, share: float = 0.05, sure: float = 0.9) -> CoTrained:
    """``rounds`` of exchange over an unlabelled pool; a fifth of the labelled rows is kept aside.

    In a round each view passes on at most ``share`` of the pool to the other, in the ratio of the labels, so always rows of both labels or none.
    A label is passed on where ``sure`` of the rows kept aside with such odds have it, and halfway from its rate to all of them at least. A view
    that explains the rows kept aside worse after a round forgets that round. At last those rows calibrate both views and their mix.
    """
    rate = float((y.sum() + 0.5) / (len(y) + 1))
    kept = np.arange(len(y)) % 5 != 0
    if len(y) < 20 or len(set(y[kept])) < 2 or len(set(y[~kept])) < 2:
        return CoTrained(None, None, np.zeros(3), rate)
    labelled, pools = (text, meta), (pool_text, pool_meta)
    given: list[dict[int, float]] = [{}, {}]
    passed = [[0, 0], [0, 0]]

    def fitted(i: int, extra: dict[int, float]) -> View:
        rows = np.fromiter(extra, np.int64, len(extra))
        return View.fit(np.r_[labelled[i][kept], pools[i][rows]], np.r_[y[kept], np.fromiter(extra.values(), float, len(extra))])

    views = [fitted(i, {}) for i in (0, 1)]
    losses = [log_loss(v, x[~kept], y[~kept]) for v, x in zip(views, labelled)]
    many = max(1, int(share * len(pool_text)))
    for _ in range(rounds if len(pool_text) else 0):
        offers = []
        for i in (0, 1):  # what view i tells the other
            left = np.array([r for r in range(len(pool_text)) if r not in given[1 - i]], np.int64)
            odds, known = views[i].odds(pools[i][left]), views[i].odds(labelled[i][~kept])
            good = confident(odds, known, y[~kept], max(1, int(many * rate)), max(sure, (1 + rate) / 2)) if len(left) else left
            bad = confident(-odds, -known, 1 - y[~kept], max(1, int(many * (1 - rate))), max(sure, 1 - rate / 2)) if len(left) else left
            good = good[: -(-int(len(bad) * 1000 * rate / (1 - rate)) // 1000)]
            bad = bad[: -(-int(len(good) * 1000 * (1 - rate) / rate) // 1000)]
            offers.append(dict.fromkeys(left[good].tolist(), 1.0) | dict.fromkeys(left[bad].tolist(), 0.0))
        before = len(given[0]) + len(given[1])
        for i in (0, 1):
            offer = offers[1 - i]
            if offer:
                view = fitted(i, given[i] | offer)
                loss = log_loss(view, labelled[i][~kept], y[~kept])
                if loss <= losses[i]:
                    given[i] |= offer
                    views[i], losses[i] = view, loss
                    for label in offer.values():
                        passed[1 - i][int(label)] += 1
        if len(given[0]) + len(given[1]) == before:
            break
    for view, x in zip(views, labelled):
        line = fit_logistic(view.odds(x[~kept])[:, None], y[~kept], ridge=0.1)
        view.line = (float(line[0]), max(0.0, float(line[1])))
    mix = fit_logistic(np.c_[views[0].odds(text[~kept]), views[1].odds(meta[~kept])], y[~kept], ridge=0.1)
    return CoTrained(views[0], views[1], mix, rate, passed)


def _with_features(docs: DataFrame, id_col: str, text_col: str, meta_cols: tuple[str, ...], more: tuple[str, ...] = ()) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in steps(batches, "text"):
            text = [text_features(t) for t in part.column("text").to_pylist()]
            meta = [meta_features(v) for v in zip(*(part.column(f"m{i}").to_pylist() for i in range(len(meta_cols))))]
            columns = [part.column("id"), *[part.column(c) for c in more], pa.array([x.tobytes() for x in text], pa.binary()), pa.array([x.tobytes() for x in meta], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["id", *more, "tx", "mx"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), *more, text_or_empty(text_col).alias("text"), *[F.col(c).alias(f"m{i}") for i, c in enumerate(meta_cols)])
    return rows.mapInArrow(run, "id long" + "".join(f", {c} double" for c in more) + ", tx binary, mx binary")


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", meta_cols: tuple[str, ...] = ("source", "lang", "n_chars"), label_col: str = "quality", labelled_rows: int = 8000, pool_rows: int = 8000) -> CoTrained:
    """Co-trains on at most ``labelled_rows`` labelled and about ``pool_rows`` unlabelled documents, those whose id's hash is least.

    Their features, under two kilobytes each, are all that the driver holds; of rows that repeat an id, the one with the least features counts. Without both labels every document gets the label's rate.
    """
    ship(docs.sparkSession)
    own = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).groupBy(id_col).agg(F.max(label_col).cast("double").alias("y"))
    chosen = own.orderBy(F.xxhash64(id_col, F.lit(41)), id_col).limit(labelled_rows)
    known = docs.join(F.broadcast(chosen), id_col)  # at most labelled_rows rows
    rest = docs.where(F.col(id_col).isNotNull()).select(id_col).join(own, id_col, "left_anti").orderBy(F.xxhash64(id_col, F.lit(43)), id_col).limit(pool_rows)
    pool = docs.join(F.broadcast(rest), id_col).withColumn("y", F.lit(-1.0))  # at most pool_rows rows
    held = _with_features(known.unionByName(pool), id_col, text_col, meta_cols, ("y",)).groupBy("id").agg(F.min(F.struct("tx", "mx", "y")).alias("x"))
    both = materialize(held.select("id", "x.*"), "co-sample").orderBy("id").collect()
    text = np.array([np.frombuffer(r["tx"], np.float32) for r in both]).reshape(-1, TEXT_SIZE)
    meta = np.array([np.frombuffer(r["mx"], np.float32) for r in both]).reshape(-1, META_SIZE)
    y = np.array([r["y"] for r in both])
    return co_train(text[y >= 0], meta[y >= 0], y[y >= 0], text[y < 0], meta[y < 0])


def score_quality(docs: DataFrame, model: CoTrained, id_col: str = "doc_id", text_col: str = "text", meta_cols: tuple[str, ...] = ("source", "lang", "n_chars")) -> DataFrame:
    """(id, text_score, meta_score, score) of every row: probabilities of good quality.

    A null text counts as empty and null metadata as a value of its own. Repeated rows score alike. No shuffle.
    """
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = np.array([np.frombuffer(x.as_py(), np.float32) for x in batch.column("tx")]).reshape(-1, TEXT_SIZE)
            meta = np.array([np.frombuffer(x.as_py(), np.float32) for x in batch.column("mx")]).reshape(-1, META_SIZE)
            yield pa.RecordBatch.from_arrays([batch.column("id"), *[pa.array(s, pa.float64()) for s in model.scores(text, meta)]], ["id", "text_score", "meta_score", "score"])

    return _with_features(docs, id_col, text_col, meta_cols).mapInArrow(run, "id long, text_score double, meta_score double, score double").withColumnRenamed("id", id_col)
