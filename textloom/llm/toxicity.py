"""Operator 8: toxic spans by a linear-chain conditional random field.

Labels say whether a document is toxic, not where. Token labels come from contrast: in toxic documents, a
word is toxic if it stands in far more of them than of the clean ones. A two-state chain with word
identity, affix and transition weights is trained on them by gradient descent on its likelihood, and
forward-backward marginals give each token's probability. A document's score calibrates the strongest
marginal and the expected number of offending tokens; offending tokens are returned with their offsets.

Training uses at most ``per_class`` labelled documents of the clean and the toxic class, taken in hashed order, of at most
``most_chars`` characters each, one row of each id (the smallest text), and only ids whose crc32 mod 5 is not 0. It
reads them in stretches of ``CHAIN`` words. Scoring covers every document and its whole text as one chain: stretches
of ``CHAIN`` words are computed side by side, and messages pass from one to the next over the stretches' products.

Defined results: a null, empty or wordless text scores as a document without offending tokens, and has no
spans; rows of ``labels`` without id or label are ignored, contradicting ones count as toxic; without
labels of both classes every score is 0; repeated rows score alike; rows of one id with other texts are scored
each by its own; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.licenses import TABLE

CHAIN = 64
SLOTS = 1 << 16
#: The words of ``split_words`` as a pattern on characters, for offsets.
WORD = re.compile(r"[0-9A-Za-z\x80-\U0010ffff]+")


def split_words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(TABLE).split()


def word_slots(word: bytes) -> tuple[int, int, int]:
    """Hashed places of a word's identity, prefix and suffix weights."""
    digest = xxhash.xxh32_intdigest
    return digest(b"w" + word) % SLOTS, digest(b"p" + word[:4]) % SLOTS, digest(b"s" + word[-4:]) % SLOTS


class Chains:
    """Words of many texts in stretches of a common length; ``parts`` has the number of stretches of each text."""

    def __init__(self, lengths: np.ndarray):
        self.parts = parts = np.maximum(1, -(-lengths // CHAIN))
        ends = np.cumsum(lengths)
        self.total = int(ends[-1]) if len(ends) else 0
        self.row = np.zeros(self.total, dtype=np.int64)
        first = np.concatenate(([0], np.cumsum(parts)[:-1])) if len(parts) else np.zeros(0, dtype=np.int64)
        inside = np.arange(self.total) - np.repeat(ends - lengths, lengths)
        self.row = np.repeat(first, lengths) + inside // CHAIN
        self.col = inside % CHAIN
        self.n = int(parts.sum()) if len(parts) else 0

    def spread(self, values: np.ndarray, fill: float = 0.0) -> np.ndarray:
        out = np.full((self.n, CHAIN), fill)
        out[self.row, self.col] = values
        return out


def marginals(emission: np.ndarray, mask: np.ndarray, trans: np.ndarray, enter: np.ndarray | None = None, leave: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Forward-backward in scaled form.

    ``emission`` is the log-odds of state 1, ``trans`` the 2 x 2 log weights; ``enter`` has the forward messages
    before the first words, after the transition, ``leave`` the backward messages after the last. Gives the
    probability of state 1, the expected transitions (2, 2) and each chain's log normaliser.
    """
    n, length = emission.shape
    t = np.exp(trans)
    e = np.exp(np.clip(emission, -30, 30))
    forward, scale = np.zeros((length, n, 2)), np.ones((length, n))
    a = (np.ones((n, 2)) if enter is None else enter) * np.stack([np.ones(n), e[:, 0]], axis=1)
    for k in range(length):
        if k:
            step = a @ t
            step[:, 1] *= e[:, k]
            a = np.where(mask[:, k, None], step, a)
        scale[k] = np.where(mask[:, k], a.sum(axis=1), 1.0)
        a = a / scale[k][:, None]
        forward[k] = a
    b, prob, moves = np.ones((n, 2)) if leave is None else leave, np.zeros((n, length)), np.zeros((2, 2))
    for k in range(length - 1, -1, -1):
        both = forward[k] * b
        prob[:, k] = np.where(mask[:, k], both[:, 1] / both.sum(axis=1), 0.0)
        if k:
            ahead = b * np.stack([np.ones(n), e[:, k]], axis=1) / scale[k][:, None]
            ok = mask[:, k]
            moves += t * (forward[k - 1][ok].T @ ahead[ok])
            b = np.where(ok[:, None], ahead @ t.T, b)
    return prob, moves, np.log(scale).sum(axis=0)


def border_messages(emission: np.ndarray, mask: np.ndarray, trans: np.ndarray, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What ``marginals`` is to enter and leave each stretch with, so that the stretches of a text are one chain."""
    n, length = emission.shape
    t = np.exp(trans)
    e = np.exp(np.clip(emission, -30, 30))
    product = np.broadcast_to(np.eye(2), (n, 2, 2)).copy()  # of weights and transitions, up to the last word
    for k in range(length):
        step = (product.reshape(-1, 2) @ t).reshape(n, 2, 2) if k else product.copy()
        step[:, :, 1] *= e[:, k, None]
        product = np.where(mask[:, k, None, None], step, product)
        product /= np.maximum(product.sum(axis=(1, 2)), 1e-300)[:, None, None]
    enter, leave = np.ones((n, 2)), np.ones((n, 2))
    first = np.concatenate(([0], np.cumsum(parts)[:-1]))
    for j in range(1, int(parts.max(initial=1))):
        at = first[parts > j] + j
        enter[at] = (enter[at - 1, None] @ product[at - 1])[:, 0] @ t
        enter[at] /= enter[at].sum(axis=1, keepdims=True)
        at = (first + parts)[parts > j] - 1 - j
        leave[at] = (t @ product[at + 1] @ leave[at + 1, :, None])[:, :, 0]
        leave[at] /= leave[at].sum(axis=1, keepdims=True)
    return enter, leave


class Tagger:
    """Weights of the chain and of the document score."""

    def __init__(self) -> None:
        self.weights, self.bias, self.trans = np.zeros(SLOTS), -4.0, np.zeros((2, 2))
        self.score_weights = np.array([0.0, 0.0, 0.0])
        self.memory: dict[bytes, float] = {}

    def __getstate__(self) -> dict:
        return self.__dict__ | {"memory": {}}

    def emission(self, words: list[bytes]) -> np.ndarray:
        memory = self.memory
        if len(memory) > 150_000:
            memory.clear()
        for w in set(words).difference(memory):
            a, b, c = word_slots(w)
            memory[w] = float(self.weights[a] + 0.5 * (self.weights[b] + self.weights[c]) + self.bias)
        return np.array([memory[w] for w in words])

    def tag(self, texts: list[str | None]) -> list[np.ndarray]:
        """The probability of each word of each text."""
        return self._marginals([self.emission(split_words(t)) for t in texts])

    def _marginals(self, emissions: list[np.ndarray]) -> list[np.ndarray]:
        lengths = np.array([len(e) for e in emissions], dtype=np.int64)
        chains = Chains(lengths)
        if not chains.total:
            return [np.zeros(0) for _ in emissions]
        emission, mask = chains.spread(np.concatenate(emissions)), chains.spread(np.ones(chains.total)) > 0
        prob, _, _ = marginals(emission, mask, self.trans, *border_messages(emission, mask, self.trans, chains.parts))
        return np.split(prob[chains.row, chains.col], np.cumsum(lengths)[:-1])

    def features(self, prob: np.ndarray) -> np.ndarray:
        strong = prob[prob >= 0.5]
        return np.array([1.0, prob.max(initial=0.0), np.log1p(strong.sum())])

    def score(self, prob: np.ndarray) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.features(prob) @ self.score_weights, -30, 30))))

    def fit(self, texts: list[str | None], toxic: list[int], epochs: int = 60, lift: float = 20.0, evidence: float = 12.0) -> Tagger:
        number: dict[bytes, int] = {}
        docs = []
        for t in texts:
            words = split_words(t)
            docs.append(np.fromiter((number.setdefault(w, len(number)) for w in words), dtype=np.int32, count=len(words)))
        label = np.array(toxic, dtype=bool)
        hashes = np.array([xxhash.xxh64_intdigest(w) for w in number], dtype=np.uint64)
        slots = np.array([word_slots(w) for w in number], dtype=np.int32).reshape(-1, 3)
        fresh = distinct_texts([hashes[d] for d in docs])
        sizes = [max(1, int((fresh & (label == y)).sum())) for y in (False, True)]
        found = np.zeros((2, len(number)), dtype=np.int64)
        for d, y, new in zip(docs, label, fresh):
            if new:
                found[int(y), np.unique(d)] += 1
        marked = (contrast(found[1], found[0], sizes[1] / sum(sizes)) >= evidence) & (found[1] / sizes[1] >= lift * (found[0] + 0.1) / sizes[0])
        chosen = [docs[i] for i in np.flatnonzero(fresh)]
        lengths = np.array([len(d) for d in chosen], dtype=np.int64)
        if lengths.sum():
            flat = np.concatenate(chosen)
            self._descend(slots, flat, marked[flat] & np.repeat(label[fresh], lengths), Chains(lengths), epochs)
        score = self.weights[slots[:, 0]] + 0.5 * (self.weights[slots[:, 1]] + self.weights[slots[:, 2]]) + self.bias
        x = [self.features(p) for at in range(0, len(chosen), 100) for p in self._marginals([score[d] for d in chosen[at : at + 100]])]
        self._calibrate(np.array(x).reshape(-1, 3), label[fresh].astype(float))
        return self

    def _descend(self, slots: np.ndarray, flat: np.ndarray, gold: np.ndarray, chains: Chains, epochs: int) -> None:
        # chains without a toxic token are many and alike: one in a few, in order, weighs for the rest
        hot = np.bincount(chains.row, gold, chains.n) > 0
        cold = np.flatnonzero(~hot)
        every = max(1, len(cold) // max(1500, 2 * int(hot.sum())))
        rows = np.sort(np.concatenate((np.flatnonzero(hot), cold[::every])))
        place = np.full(chains.n, -1)
        place[rows] = np.arange(len(rows))
        inside = place[chains.row] >= 0
        r, c, own = place[chains.row[inside]], chains.col[inside], slots[flat[inside]]
        mask, truth = np.zeros((len(rows), CHAIN), dtype=bool), np.zeros((len(rows), CHAIN))
        mask[r, c], truth[r, c] = True, gold[inside]
        heavy = np.where(hot[rows], 1.0, min(every, 4))
        states, pairs = truth.astype(int), mask[:, 1:] & mask[:, :-1]
        gold_moves = np.zeros((2, 2))
        np.add.at(gold_moves, (states[:, :-1][pairs], states[:, 1:][pairs]), 1.0)
        n = max(1.0, truth.sum())
        theta = np.concatenate((self.weights, [self.bias], self.trans.ravel()))
        first, second = np.zeros_like(theta), np.zeros_like(theta)
        for step in range(1, epochs + 1):
            w, bias, trans = theta[:SLOTS], theta[SLOTS], theta[SLOTS + 1 :].reshape(2, 2)
            e = np.zeros(mask.shape)
            e[r, c] = w[own[:, 0]] + 0.5 * (w[own[:, 1]] + w[own[:, 2]]) + bias
            prob, moves, _ = marginals(e, mask, trans)
            error = ((prob - truth) * heavy[:, None])[r, c]
            grad = np.bincount(own[:, 0], error, SLOTS) + 0.5 * (np.bincount(own[:, 1], error, SLOTS) + np.bincount(own[:, 2], error, SLOTS))
            grad = np.concatenate((grad / n + 1e-5 * w, [error.sum() / n], ((moves - gold_moves) / n + 1e-3 * trans).ravel()))
            first, second = 0.9 * first + 0.1 * grad, 0.99 * second + 0.01 * grad * grad
            theta = theta - 0.3 * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-6)
        self.weights, self.bias, self.trans = theta[:SLOTS].copy(), float(theta[SLOTS]), theta[SLOTS + 1 :].reshape(2, 2).copy()
        self.memory = {}

    def _calibrate(self, x: np.ndarray, y: np.ndarray) -> None:
        w = np.zeros(3)
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            hessian = (x * (p * (1 - p))[:, None]).T @ x + np.diag([1e-6, 0.05, 0.05])
            w = w - np.linalg.solve(hessian, x.T @ (p - y) + np.array([0.0, 0.05, 0.05]) * w)
        self.score_weights = w


def contrast(toxic: np.ndarray, clean: np.ndarray, share: float) -> np.ndarray:
    """Log-likelihood ratio of words' documents being toxic more often than the sample's ``share``."""
    n = np.maximum(1, toxic + clean)
    gain = toxic * np.log(np.maximum(toxic, 1) / n / share) + clean * np.log(np.maximum(clean, 1) / n / max(1e-9, 1 - share))
    return np.where(toxic > share * n, 2 * gain, 0.0)


def distinct_texts(texts: list[np.ndarray]) -> np.ndarray:
    """False for texts that share the least or largest hash of their five-word runs with an earlier one: copies count once."""
    seen, out = set(), []
    for h in texts:
        n = max(1, len(h) - 4)
        run = np.zeros(n, dtype=np.uint64)
        for k in range(min(5, len(h))):
            run = (run ^ (run >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15) + h[k : n + k]
        marks = {(0, int(run.min())), (1, int(run.max()))}
        out.append(not marks & seen)
        seen |= marks
    return np.array(out, dtype=bool)


def labelled_sample(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, per_class: tuple[int, int], most_chars: int) -> tuple[list, list]:
    """Texts and labels of at most ``per_class`` training documents of class 0 and 1, in hashed order, one text of an id."""
    known = labels.select(F.col("doc_id").alias("id"), F.col(label_col).cast("int").alias("y")).filter("id IS NOT NULL AND y IS NOT NULL")
    known = known.filter(F.crc32(F.col("id").cast("string").cast("binary")) % 5 != 0).groupBy("id").agg(F.max("y").alias("y"))
    chosen = [known.filter(F.col("y") == y).orderBy(F.xxhash64("id"), "id").limit(per_class[y]) for y in (0, 1)]
    chosen = chosen[0].unionByName(chosen[1]).collect()  # bounded by per_class
    if not chosen:
        return [], []
    spark = docs.sparkSession
    ids = spark.createDataFrame([(r["id"], r["y"]) for r in chosen], f"id {docs.schema[id_col].dataType.simpleString()}, y int")
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).filter(F.coalesce(F.length("text"), F.lit(0)) <= most_chars).join(F.broadcast(ids), "id")
    rows = rows.groupBy("id").agg(F.min("text").alias("text"), F.first("y").alias("y")).orderBy("id").collect()  # one row of each chosen id
    return [r["text"] for r in rows], [r["y"] for r in rows]


def train_tagger(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", per_class: tuple[int, int] = (2500, 800), most_chars: int = 200_000) -> Tagger | None:
    texts, toxic = labelled_sample(docs, labels, id_col, text_col, label_col, per_class, most_chars)
    return Tagger().fit(texts, toxic) if len(set(toxic)) == 2 else None


SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("probability", pa.float64())]))


def score_toxicity(docs: DataFrame, tagger: Tagger | None, id_col: str = "doc_id", text_col: str = "text", step: int = 400) -> DataFrame:
    """``(doc_id, score, spans)`` of every row; offsets count characters."""
    model = docs.sparkSession.sparkContext.broadcast(tagger)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = model.value
        for whole in batches:
            for at in range(0, whole.num_rows, step):
                batch = whole.slice(at, step)
                texts = batch.column(1).to_pylist()
                probs = own.tag(texts) if own else [np.zeros(0)] * len(texts)
                spans = []
                for t, p in zip(texts, probs):
                    bad = np.flatnonzero(p >= 0.5)
                    ends = [m.span() for m in WORD.finditer(t)] if len(bad) else []
                    spans.append([{"start": ends[k][0], "end": ends[k][1], "probability": float(p[k])} for k in bad.tolist()])
                scores = pa.array([own.score(p) if own else 0.0 for p in probs], type=pa.float64())
                yield pa.RecordBatch.from_arrays([batch.column(0), scores, pa.array(spans, type=SPANS)], names=["doc_id", "score", "spans"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, f"doc_id {kind}, score double, spans array<struct<start:bigint,end:bigint,probability:double>>")


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", per_class: tuple[int, int] = (2500, 800)) -> DataFrame:
    """``(doc_id, held_out, score, predicted, spans)`` of every document."""
    scored = score_toxicity(docs, train_tagger(docs, labels, id_col, text_col, per_class=per_class), id_col, text_col)
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    return scored.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "spans")


def drop_toxic(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", per_class: tuple[int, int] = (2500, 800), step: int = 400) -> DataFrame:
    """``docs`` without the rows whose score is 0.5 or more; rows pass through whole, with all columns."""
    tagger = train_tagger(docs, labels, id_col, text_col, per_class=per_class)
    if tagger is None:
        return docs
    model, place = docs.sparkSession.sparkContext.broadcast(tagger), docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, step):
                batch = whole.slice(at, step)
                yield batch.filter(pa.array([model.value.score(p) < 0.5 for p in model.value.tag(batch.column(place).to_pylist())], type=pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
