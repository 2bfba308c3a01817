"""Toxic spans and document scores by a linear-chain conditional random field.

Tokens are labelled from document labels: in a toxic document those whose word or word
beginning is far more frequent in toxic than in clean documents are toxic, in a clean one
none is.  The field is fitted to them, then twice relabels the toxic documents by its own
marginals and is fitted again.  Features are the word and its beginnings of
``PREFIXES`` letters, so inflected and unseen forms count too.

A document's score is a logistic function of the sum and the two highest of its
forward-backward marginals and of its length, fitted to marginals of models that have not seen the
document.  Tokens with a marginal above one half make the offending spans, in code
points.

The model is fitted on the driver to at most ``SAMPLE`` labelled documents of each label
(least hashes of their ids first) with at most ``LONGEST`` letters, which bounds what the
driver gets; all rows are scored over whole texts, very long ones too, with memory in
proportion.  Null and empty texts have no tokens and get the score of their zeros.  Rows
are scored one by one: repeated rows get equal scores, null ids are kept, further columns
may have any name, an empty table gives an empty result.
Without labels of both kinds every score is the share of toxic labels, or 0.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cloakframe.llm import crf
from cloakframe.llm.scratch import configure, numbered
from cloakframe.llm.streams import texts, tidy

#: Documents of each label that the model is fitted to, and the letters that one may have.
SAMPLE = 1200
LONGEST = 100_000
PREFIXES = (3, 4, 5, 6, 7, 8)
#: Toxic documents in which a feature must occur: so many, and this share of them.
LEAST = 2
LEAST_SHARE = 0.006
#: Times by which a feature must be more frequent in toxic documents.
RATIO = 5.0
#: Features that the model may hold.
FEATURES = 100_000
#: Tokens of a training sequence.
PIECE = 32
THRESHOLD = 0.3
CACHE = 200_000
_EDGE = re.compile(r"^\W+|\W+$")
_TOKEN = re.compile(r"[^ \t\n\r\x0b\x0c]+")


def held_out(doc_id: F.Column) -> F.Column:
    """Whether a document's label must not be learnt from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def word(token: str) -> str:
    return _EDGE.sub("", token.lower())


def features(w: str) -> list[str]:
    return ["=" + w, *(w[:k] for k in PREFIXES if len(w) >= k)] if w else []


class Scorer:
    """A fitted model: words' scores, the chain, and the logistic function of documents."""

    def __init__(self, model: crf.Model, document: np.ndarray, flat: float | None = None) -> None:
        self.model, self.document, self.flat = model, document, flat
        self.cache: dict[bytes, float] = {}

    def __getstate__(self) -> dict:
        return self.__dict__ | {"cache": {}}

    def _score(self, token: bytes) -> float:
        get = self.model.weights.get
        return self.model.bias + sum(get(f, 0.0) for f in features(word(token.decode())))

    def marginals(self, docs: list[bytes]) -> list[np.ndarray]:
        """Marginal of each token of each text."""
        if len(self.cache) > CACHE:
            self.cache = {}
        cache, all_scores = self.cache, []
        for d in docs:
            tokens = d.split()
            try:
                s = list(map(cache.__getitem__, tokens))
            except KeyError:
                for t in tokens:
                    if t not in cache:
                        cache[t] = self._score(t)
                s = list(map(cache.__getitem__, tokens))
            all_scores.append(np.array(s))
        lengths = np.array([len(s) for s in all_scores], np.int64)
        out: list[np.ndarray] = [np.empty(0)] * len(docs)
        for part in crf.batches(lengths):
            own = lengths[part]
            if not own[0]:
                continue
            scores = np.full((own[0], len(part)), self.model.bias)
            for j, k in enumerate(part.tolist()):
                scores[: own[j], j] = all_scores[k]
            m = crf.marginals(scores, own, self.model.chain)
            for j, k in enumerate(part.tolist()):
                out[k] = m[: own[j], j]
        return out

    def score(self, found: list[np.ndarray]) -> np.ndarray:
        if self.flat is not None:
            return np.full(len(found), self.flat)
        return 1 / (1 + np.exp(-np.clip(_summary(found) @ self.document, -50, 50)))


def _summary(found: list[np.ndarray]) -> np.ndarray:
    """What a document's score depends on: the sum of its marginals, the two highest, and its length."""
    out = np.ones((len(found), 5))
    for i, m in enumerate(found):
        top = np.sort(np.partition(m, -2)[-2:]) if len(m) > 1 else np.concatenate((np.zeros(2 - len(m)), m))
        out[i, 1:] = np.log1p(m.sum()), top[1], top[0], np.log1p(len(m)) / 10
    return out


def _candidates(docs: list[list[str]], toxic: np.ndarray) -> dict[str, float]:
    """Features far more frequent in toxic documents, with the logarithm of how much."""
    counts = (Counter(), Counter())
    for words, y in zip(docs, toxic, strict=True):
        counts[int(y)].update({f for w in set(words) for f in features(w)})
    n1, n0 = max(1, int(toxic.sum())), max(1, int((~toxic).sum()))
    out = {}
    for f, t in counts[1].items():
        ratio = (t / n1) / ((counts[0][f] + 0.5) / n0)
        if t >= max(LEAST, LEAST_SHARE * n1) and ratio >= RATIO:
            out[f] = float(np.log(ratio) * min(1.0, t / 4))
    return dict(sorted(out.items(), key=lambda x: (-x[1], x[0]))[:FEATURES])


def _fit_field(docs: list[list[str]], toxic: np.ndarray) -> crf.Model:
    known = _candidates(docs, toxic)
    number = {f: i for i, f in enumerate(known)}
    strength = np.array(list(known.values()) or [0.0])
    lists: dict[str, list[int]] = {}
    pieces, owner = [], []
    plain = Counter()
    for d, words in enumerate(docs):
        for at in range(0, len(words), PIECE):
            part = words[at : at + PIECE]
            for w in part:
                if w not in lists:
                    lists[w] = [number[f] for f in features(w) if f in number]
            if any(lists[w] for w in part):
                pieces.append([lists[w] for w in part])
                owner.append(d)
            else:
                plain[len(part)] += 1
    # pieces without any feature are all alike
    weights = np.array([1.0] * len(pieces) + [float(c) for c in plain.values()])
    own = np.array(owner, np.int64)
    pieces += [[[]] * n for n in plain]
    if not pieces:
        return crf.Model()
    lengths = np.array([len(p) for p in pieces], np.int64)
    shape = (PIECE, len(pieces))
    items = [(t * shape[1] + j, f) for j, p in enumerate(pieces) for t, f in enumerate(p) if f]
    place = np.array([i[0] for i in items], np.int64)
    flat = np.array([x for i in items for x in i[1]], np.int64)
    offsets = np.cumsum([0] + [len(i[1]) for i in items])[:-1].astype(np.int64)
    labels = np.zeros(shape)
    bad = np.zeros(shape[1], bool)
    bad[: len(own)] = toxic[own]
    if len(items):
        best = np.maximum.reduceat(strength[flat], offsets)
        sure = (best >= np.log(RATIO)) & bad[place % shape[1]]
        labels.reshape(-1)[place[sure]] = 1
    theta, bias, chain = np.zeros(len(known)), -2.0, crf.Chain()
    for step in range(3):
        theta, bias, chain = crf.fit(flat, offsets, place, shape, lengths, labels, weights, len(known), 120 if step == 2 else 60)
        if step == 2 or not len(items):
            break
        scores = np.full(shape, bias)
        np.add.at(scores.reshape(-1), place, np.add.reduceat(theta[flat], offsets))
        m = crf.marginals(scores, lengths, chain) * bad
        # a toxic document has a toxic token: its likeliest one
        peak = np.zeros(len(docs))
        np.maximum.at(peak, own, m[:, : len(own)].max(0))
        labels = (m > 0.5).astype(float)
        labels[:, : len(own)] += (m[:, : len(own)] == peak[own]) & (m[:, : len(own)] > 0.02) & (labels[:, : len(own)] == 0)
    used = {f: float(theta[i]) for f, i in number.items() if abs(theta[i]) > 1e-3}
    return crf.Model(used, bias, chain)


def fit(docs: list[bytes], toxic: np.ndarray, weights: np.ndarray) -> Scorer:
    """The scorer of labelled texts; ``weights`` undo the sampling of labels."""
    if toxic.all() or not toxic.any():
        return Scorer(crf.Model(), np.zeros(5), float(np.mean(toxic)) if len(toxic) else 0.0)
    words = [[word(t) for t in d.decode().split()] for d in docs]
    model = _fit_field(words, toxic)
    x = np.empty((len(docs), 5))
    halves = np.arange(len(docs)) % 2
    for h in (0, 1):
        here, there = np.flatnonzero(halves == h), np.flatnonzero(halves != h)
        half = _fit_field([words[i] for i in there], toxic[there])
        x[here] = _summary(Scorer(half, np.zeros(5)).marginals([docs[i] for i in here]))
    # ridge-penalized logistic regression by Newton steps
    beta = np.zeros(5)
    y = toxic.astype(float)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        g = x.T @ (weights * (y - p)) - 0.05 * beta
        h = (x * (weights * p * (1 - p))[:, None]).T @ x + 0.05 * np.eye(5)
        step = np.linalg.solve(h, g)
        beta += step * min(1.0, 4 / (np.abs(step).max() + 1e-12))
        if np.abs(step).max() < 1e-8:
            break
    return Scorer(model, beta)


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Scorer:
    """A scorer fitted to a bounded sample of ``docs`` that have labels and are not held out."""
    known = labels.filter("doc_id is not null and toxic is not null").filter(~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg((F.max("toxic") > 0).alias("toxic")).withColumn("key", F.xxhash64("doc_id"))
    there = known.join(docs.select(F.col("doc_id").alias("id")).distinct(), F.col("doc_id") == F.col("id"), "left_semi")
    totals = {r.toxic: r["count"] for r in there.groupBy("toxic").count().collect()}
    ids = [there.filter(F.col("toxic") == y).orderBy("key", "doc_id").limit(sample).select("doc_id", "toxic") for y in (True, False)]
    chosen = ids[0].union(ids[1]).withColumnsRenamed({"doc_id": "id"})
    text = docs.select("doc_id", "text").filter(F.coalesce(F.char_length("text"), F.lit(0)) <= LONGEST).join(F.broadcast(chosen), F.col("doc_id") == F.col("id"))  # at most 2 * sample ids
    rows = text.groupBy("id").agg(F.min("text").alias("text"), F.first("toxic").alias("toxic")).orderBy(F.xxhash64("id"), "id").collect()
    y = np.array([r.toxic for r in rows], bool)
    share = {v: totals.get(v, 0) / max(1, int((y == v).sum())) for v in (True, False)}
    scale = len(rows) / max(1, sum(totals.values()))
    weights = np.array([share[bool(v)] * scale for v in y])
    return fit([(r.text or "").encode() for r in rows], y, weights)


def score(docs: DataFrame, scorer: Scorer, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, held_out, score, predicted, spans) for each row of ``docs`` (doc_id, text, ...)."""
    configure(docs.sparkSession)
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))

    def spans(text: bytes, m: np.ndarray) -> list[dict[str, int]]:
        bad = m > 0.5
        if not bad.any():
            return []
        t = text.decode()
        places = [x.span() for x in _TOKEN.finditer(t)]
        edges = np.flatnonzero(np.diff(np.concatenate(([False], bad, [False])).astype(np.int8)))
        return [{"start": places[s][0], "end": places[e - 1][1]} for s, e in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            docs_in = texts(b.column(2))
            found = scorer.marginals(docs_in)
            p = scorer.score(found)
            where = [spans(t, m) for t, m in zip(docs_in, found, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(p), pa.array((p >= threshold).astype(np.int32)), pa.array(where, kind)], ["doc_id", "held_out", "score", "predicted", "spans"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), "text")
    return rows.mapInArrow(tidy(run), "doc_id long, held_out boolean, score double, predicted int, spans array<struct<start:int,end:int>>")


def reject(docs: DataFrame, scorer: Scorer, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with all their columns, without the documents whose score reaches the threshold."""
    configure(docs.sparkSession)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            p = scorer.score(scorer.marginals(texts(b.column(at))))
            yield pa.RecordBatch.from_arrays(b.filter(pa.array(p < threshold)).columns, names)

    names = docs.columns
    return numbered(docs).mapInArrow(tidy(run), docs.schema)
