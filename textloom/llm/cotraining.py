"""Operator 1: quality classifier by co-training of a text view and a metadata view.

The content view sees hashed words and word shapes; the metadata view sees the page's language, source,
length and layout counts. Both are logistic models fitted on a bounded sample of labelled documents. Over
several rounds each names the documents of an unlabelled pool of which it is surest, and the other learns
them as pseudo-labels. Their scores are then calibrated and combined on labelled documents kept back, and
every document is scored in one pass.

The sample holds at most ``per_class`` labelled documents of each class and ``pool`` unlabelled ones, in
hashed order of their ids, of at most ``most_chars`` characters each and one row of each id (the smallest). One
labelled row in eight calibrates the views, another one in eight their combination.

Defined results: null and empty texts and null metadata have the features of nothing and get a score;
labels without id or class are ignored, contradicting ones count as good; without labels of both classes
every score is 0.5 and every document is kept; repeated rows score alike; rows of one id with other columns are
scored each by its own; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DIMS = 1 << 11
META = 1 << 9
UPPER, DIGITS, SPACE = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t\n\r\x0b\x0c"
SYMBOLS = bytes(b for b in range(33, 127) if not chr(b).isalnum() and b not in b".,;:'\"-?()")


def slot(text: bytes, dims: int) -> int:
    return xxhash.xxh32_intdigest(text) % dims


class Content:
    """Hashed words and shapes: the square roots of their shares, of length 1."""

    def __init__(self, memory: int = 300_000):
        self.memory, self.known = memory, {}
        self.words, self.shapes = np.zeros(1 << 12, dtype=np.int64), np.zeros(1 << 12, dtype=np.int64)

    def _learn(self, w: bytes) -> int:
        core = w.strip(SYMBOLS + b".,;:'\"-?()")
        tail = w[len(w.rstrip(SYMBOLS)) :]
        case = b"U" if len(core) > 1 and core.isupper() else b"T" if core.istitle() else b"l"
        self.known[w] = at = len(self.known)
        if at == len(self.words):
            self.words, self.shapes = np.concatenate((self.words, self.words)), np.concatenate((self.shapes, self.shapes))
        self.words[at] = slot(b"w" + core.lower(), DIMS)
        self.shapes[at] = slot(b"s" + case + tail[:3] + (b"#" if not core else b""), DIMS)
        return at

    def features(self, text: str | None) -> np.ndarray:
        if len(self.known) > self.memory:
            self.known = {}
        words, known = (text or "").encode("utf-8", "surrogatepass").split(), self.known
        if not words:
            return np.zeros(DIMS, dtype=np.float32)
        ids = np.array([known[w] if w in known else self._learn(w) for w in words])
        counts = np.bincount(self.words[ids], minlength=DIMS) + np.bincount(self.shapes[ids], minlength=DIMS).astype(float)
        counts[slot(b"repeated", DIMS)] += (ids[1:] == ids[:-1]).sum()
        x = np.sqrt(counts / len(words))
        return (x / np.linalg.norm(x)).astype(np.float32)


def metadata(text: str | None, lang: str | None, source: str | None, n_chars: int | None) -> np.ndarray:
    raw = (text or "").encode("utf-8", "surrogatepass")
    lines, size = raw.split(b"\n"), max(1, len(raw))
    without = lambda c: (len(raw) - len(raw.translate(None, c))) / size
    x = np.zeros(META, dtype=np.float32)
    x[:8] = [without(UPPER), without(DIGITS), without(SPACE), without(SYMBOLS), len(set(lines)) / len(lines), np.log1p(len(lines)) / 8, np.log1p(size / len(lines)) / 10, np.log1p(max(0, n_chars or 0)) / 12]
    for k, kind in enumerate((x[0], x[3])):
        x[8 + 8 * k + min(7, int(kind * 16))] = 1
    for name, value in (("lang", lang), ("source", source)):
        x[24 + slot(f"{name}={value}".encode("utf-8", "surrogatepass"), META - 24)] = 1
    return x


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


class Logistic:
    """A logistic model by Adam with weight decay, classes weighing alike."""

    def __init__(self, dims: int, decay: float = 1e-4):
        self.w, self.b, self.decay = np.zeros(dims, dtype=np.float32), 0.0, decay

    def logit(self, x: np.ndarray) -> np.ndarray:
        return x @ self.w + self.b

    def fit(self, x: np.ndarray, y: np.ndarray, steps: int = 200) -> Logistic:
        weight = np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y == 0).sum()))
        w, b = np.zeros(x.shape[1]), 0.0
        m, v = np.zeros(x.shape[1] + 1), np.zeros(x.shape[1] + 1)
        for k in range(1, steps + 1):
            error = (sigmoid(x @ w.astype(np.float32) + b) - y) * weight
            g = np.concatenate((x.T @ error.astype(np.float32) + self.decay * w, [error.sum()]))
            m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
            step = 0.3 * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.99**k)) + 1e-8)
            w, b = w - step[:-1], b - step[-1]
        self.w, self.b = w.astype(np.float32), float(b)
        return self


def calibrated(z: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Weights of a logistic model with an intercept and a little ridge, by Newton's method."""
    x = np.column_stack((np.ones(len(z)), z))
    ridge = np.array([1e-3] + [1e-2] * (x.shape[1] - 1))
    w = np.zeros(x.shape[1])
    for _ in range(40):
        p = sigmoid(x @ w)
        w = w - np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(ridge), x.T @ (p - y) + ridge * w)
    return w


class CoTrained:
    """The two views, their calibrations and their combination."""

    def fit(self, rows: list[tuple], y: np.ndarray, pool: list[tuple], rounds: int = 4, sure: float = 0.95, most: int = 150) -> CoTrained:
        content = Content()
        views = [np.array([content.features(r[0]) for r in [*rows, *pool]]), np.array([metadata(*r) for r in [*rows, *pool]])]
        place = np.arange(len(rows)) % 8
        kept_back = place % 4 == 3
        learn = [np.concatenate((~kept_back, np.zeros(len(pool), dtype=bool))) for _ in views]
        given = [np.concatenate((y, np.zeros(len(pool)))) for _ in views]
        free = np.concatenate((np.zeros(len(rows), dtype=bool), np.ones(len(pool), dtype=bool)))
        models = [Logistic(v.shape[1]) for v in views]
        self.exchanged = 0
        for turn in range(rounds + 1):
            for k, model in enumerate(models):
                model.fit(views[k][learn[k]], given[k][learn[k]])
            if turn == rounds:
                break
            named = []
            for k, model in enumerate(models):
                p = np.where(free, sigmoid(model.logit(views[k])), 0.5)
                order = np.argsort(p, kind="stable")
                good, bad = order[::-1][:most], order[:most]
                named.append((good[p[good] >= sure], bad[p[bad] <= 1 - sure]))
            for k, (good, bad) in enumerate(named):  # what one view is sure of, the other learns
                learn[1 - k][good], learn[1 - k][bad] = True, True
                given[1 - k][good], given[1 - k][bad] = 1, 0
                self.exchanged += len(good) + len(bad)
            taken = np.concatenate([x for pair in named for x in pair]).astype(np.int64)
            free[taken] = False
            if not len(taken):
                break
        self.models = models
        logits = lambda at: np.column_stack([m.logit(v[at]) for m, v in zip(models, views)])
        one, other = np.flatnonzero(place == 3), np.flatnonzero(place == 7)
        self.single = [calibrated(logits(one)[:, [k]], y[one]) for k in range(2)]
        both = np.column_stack([self.calibrate(k, logits(other)[:, k]) for k in range(2)])
        self.joint = calibrated(both, y[other])
        return self

    def calibrate(self, view: int, z: np.ndarray) -> np.ndarray:
        return np.clip(self.single[view][0] + self.single[view][1] * z, -8, 8)

    def scores(self, content: np.ndarray, meta: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        both = [self.calibrate(0, self.models[0].logit(content)), self.calibrate(1, self.models[1].logit(meta))]
        joint = sigmoid(self.joint[0] + np.column_stack(both) @ self.joint[1:])
        return sigmoid(both[0]), sigmoid(both[1]), joint


def training_rows(docs: DataFrame, labels: DataFrame, label_col: str, per_class: int, pool: int, most_chars: int) -> tuple[list, np.ndarray, list]:
    """Bounded samples: labelled rows with their classes, and unlabelled rows, in hashed order."""
    known = labels.select(F.col("doc_id").alias("id"), F.col(label_col).cast("int").alias("y")).filter("id IS NOT NULL AND y IN (0, 1)").groupBy("id").agg(F.max("y").alias("y"))
    parts = [known.filter(F.col("y") == y).orderBy(F.xxhash64("id"), "id").limit(per_class) for y in (0, 1)]
    rest = docs.select("id").filter("id IS NOT NULL").join(known, "id", "left_anti").distinct().withColumn("y", F.lit(-1)).orderBy(F.xxhash64("id"), "id").limit(pool)
    chosen = parts[0].unionByName(parts[1]).unionByName(rest).collect()  # at most 2 per_class + pool ids
    if not chosen:
        return [], np.zeros(0), []
    ids = docs.sparkSession.createDataFrame([tuple(r) for r in chosen], f"id {docs.schema['id'].dataType.simpleString()}, y int")
    rows = docs.filter(F.coalesce(F.length("text"), F.lit(0)) <= most_chars).join(F.broadcast(ids), "id")
    rows = rows.groupBy("id").agg(F.min(F.struct("text", "lang", "source", "n_chars")).alias("r"), F.first("y").alias("y")).select("id", "y", "r.*").orderBy("id").collect()  # one row of each chosen id
    row = lambda r: (r["text"], r["lang"], r["source"], r["n_chars"])
    return [row(r) for r in rows if r["y"] >= 0], np.array([r["y"] for r in rows if r["y"] >= 0], dtype=float), [row(r) for r in rows if r["y"] < 0]


def classify_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source", chars_col: str = "n_chars", label_col: str = "quality", per_class: int = 900, pool: int = 1200, most_chars: int = 200_000, step: int = 400) -> DataFrame:
    """``(doc_id, content_score, metadata_score, score, keep)`` of every row; ``keep`` where the score is at least 0.5."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"), F.col(source_col).alias("source"), F.col(chars_col).cast("long").alias("n_chars"))
    sample, y, unlabelled = training_rows(rows, labels, label_col, per_class, pool, most_chars)
    fitted = CoTrained().fit(sample, y, unlabelled) if len(set(y.tolist())) == 2 and len(y) >= 8 else None
    model = docs.sparkSession.sparkContext.broadcast(fitted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        content = Content()
        for whole in batches:
            for at in range(0, whole.num_rows, step):
                batch = whole.slice(at, step)
                if model.value is None:
                    found = (np.full(batch.num_rows, 0.5),) * 3
                else:
                    texts, *rest = (batch.column(k).to_pylist() for k in (1, 2, 3, 4))
                    found = model.value.scores(np.array([content.features(t) for t in texts]), np.array([metadata(*r) for r in zip(texts, *rest)]))
                yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(f.astype(float)) for f in found]], names=["doc_id", "content_score", "metadata_score", "score"])

    kind = docs.schema[id_col].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, content_score double, metadata_score double, score double").withColumn("keep", F.col("score") >= 0.5)
