"""Toxic spans and document scores by a linear-chain conditional random field.

Labels are given per document, so tokens are labelled from them: words and stems that almost only toxic documents hold are
toxic tokens in toxic documents, and ones that cover toxic documents still unexplained are added one by one. The field's two
states (toxic or not) are scored from the word, its stem (first four and five letters), and its neighbours; weights are fitted by gradient ascent on the
likelihood of windows around toxic tokens and of windows of clean documents. Scoring runs forward and backward over every
token of every text. A document's score is a logistic function of its highest marginal and of the sum of its marginals;
tokens with a marginal of one half or more are the offending spans.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import col

_WORD = re.compile(r"\w+")


@dataclass
class SpanModel:
    """Fitted field: weights by word and stem, transitions, and the document's logistic weights."""

    ids: dict[str, int] = field(default_factory=dict)
    stems: dict[str, int] = field(default_factory=dict)
    here: np.ndarray = field(default_factory=lambda: np.zeros(1))
    before: np.ndarray = field(default_factory=lambda: np.zeros(1))
    after: np.ndarray = field(default_factory=lambda: np.zeros(1))
    moves: np.ndarray = field(default_factory=lambda: np.ones((2, 2)))
    doc: np.ndarray | None = None  # None: nothing learnt, every score is 0


class WordIds(dict):
    """Row of the weight tables for a word as written; words not learnt go by their longest learnt stem, or to row 0."""

    def __init__(self, model: SpanModel, limit: int = 400_000):
        super().__init__()
        self.model, self.limit = model, limit

    def __missing__(self, word: str) -> int:
        low = word.lower()
        out = self.model.ids.get(low)
        if out is None:
            stems = self.model.stems
            out = stems.get(low[:5]) or stems.get(low[:4], 0)
        if len(self) >= self.limit:
            self.clear()
        self[word] = out
        return out


def emissions(rows: list[np.ndarray], model: SpanModel) -> np.ndarray:
    """Score of the toxic state of every token of every text, texts one after the other."""
    if not rows:
        return np.empty(0)
    ids = np.concatenate(rows)
    lengths = np.array([len(r) for r in rows])
    ends = np.cumsum(lengths)
    out = model.here[ids]
    left, right = np.empty(len(ids)), np.empty(len(ids))
    left[1:], right[:-1] = model.before[ids[:-1]], model.after[ids[1:]]
    left[(ends - lengths)[lengths > 0]] = 0
    right[(ends - 1)[lengths > 0]] = 0
    return out + left + right


def forward_backward(scores: np.ndarray, lengths: np.ndarray, moves: np.ndarray, step: int = 128) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Marginals of the toxic state, with the forward share of the token before and the backward share of each token.

    Exact over whole texts and vectorised: texts are cut into steps of fixed length, each step's transfer matrix is formed
    for all steps at once, matrices are chained per text, and messages then run inside all steps at once.
    """
    n_seg = -(-lengths // step)
    total = int(n_seg.sum())
    if not total:
        return np.empty(0), np.empty(0), np.empty(0)
    text = np.repeat(np.arange(len(lengths)), n_seg)
    first = np.cumsum(n_seg) - n_seg
    place = np.arange(total) - first[text]
    start = (np.cumsum(lengths) - lengths)[text] + place * step
    size = np.minimum(lengths[text] - place * step, step)
    grid = start[:, None] + np.arange(step)
    valid = np.arange(step) < size[:, None]
    gain = np.exp(np.clip(np.where(valid, scores[np.minimum(grid, len(scores) - 1)], 0), -30, 30))
    transfer = np.tile(np.eye(2), (total, 1, 1))
    for t in range(step):
        nxt = np.stack(
            [transfer[:, :, 0] * moves[0, 0] + transfer[:, :, 1] * moves[1, 0],
             (transfer[:, :, 0] * moves[0, 1] + transfer[:, :, 1] * moves[1, 1]) * gain[:, t, None]], axis=2)
        nxt /= nxt.sum(axis=(1, 2), keepdims=True)
        transfer = np.where(valid[:, t, None, None], nxt, transfer)
    fore, back = np.empty((total, 2)), np.empty((total, 2))
    v, u = np.tile([1.0, 0.0], (len(lengths), 1)), np.ones((len(lengths), 2))
    for s in range(int(n_seg.max())):
        live = np.flatnonzero(n_seg > s)
        at = first[live] + s
        fore[at] = v[live]
        new = np.einsum("na,nab->nb", v[live], transfer[at])
        v[live] = new / new.sum(axis=1, keepdims=True)
        at = first[live] + n_seg[live] - 1 - s
        back[at] = u[live]
        new = np.einsum("nab,nb->na", transfer[at], u[live])
        u[live] = new / new.sum(axis=1, keepdims=True)
    share, came, comes = (np.zeros((total, step)) for _ in range(3))
    p = fore[:, 1]
    for t in range(step):
        came[:, t] = p
        toxic = ((1 - p) * moves[0, 1] + p * moves[1, 1]) * gain[:, t]
        clean = (1 - p) * moves[0, 0] + p * moves[1, 0]
        share[:, t] = toxic / (toxic + clean)
        p = np.where(valid[:, t], share[:, t], p)
    b = back[:, 1] / back.sum(axis=1)
    for t in range(step - 1, -1, -1):
        comes[:, t] = b
        toxic = moves[1, 0] * (1 - b) + moves[1, 1] * gain[:, t] * b
        clean = moves[0, 0] * (1 - b) + moves[0, 1] * gain[:, t] * b
        b = np.where(valid[:, t], toxic / (toxic + clean), b)
    hit = share * comes
    marginal = hit / (hit + (1 - share) * (1 - comes))
    return marginal[valid], came[valid], comes[valid]


def _stems(word: str) -> tuple[str, ...]:
    return (word[:4] + "-", word[:5] + "-") if len(word) > 4 else ()


def _inflected(words: list[list[str]]) -> set[str]:
    """Stems of several word forms, none of which makes up over four fifths of them: of one form, a stem says nothing."""
    texts = Counter(w for part in words for w in set(part))
    forms, total, most = Counter(), Counter(), Counter()
    for word, n in texts.items():
        for stem in _stems(word):
            forms[stem] += 1
            total[stem] += n
            most[stem] = max(most[stem], n)
    return {s for s, n in forms.items() if n >= 3 and most[s] <= 0.8 * total[s]}


def _toxic_keys(bags: list[set[str]], labels: np.ndarray) -> set[str]:
    """Words and stems that mark toxic documents, from document labels."""
    n_toxic, n_clean = int(labels.sum()), int((1 - labels).sum())
    inside, outside = Counter(), Counter()
    for bag, y in zip(bags, labels, strict=True):
        (inside if y else outside).update(bag)

    def sure(word: str) -> bool:
        a, b = inside[word] / n_toxic, outside[word] / max(1, n_clean)
        return a >= 0.95 * (a + b)

    often = max(3, 0.05 * n_toxic)
    words = {w for w, n in inside.items() if n >= often and sure(w)}
    rest = [bag for bag, y in zip(bags, labels, strict=True) if y and not bag & words]
    while rest:
        best, n = max(((w, n) for w, n in Counter(w for b in rest for w in b).items() if sure(w)),
                      key=lambda x: (x[1], x[0]), default=("", 0))
        if n < max(2, 0.005 * n_toxic):
            break
        words.add(best)
        rest = [b for b in rest if best not in b]
    return words


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float) -> np.ndarray:
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        step = np.linalg.solve(h, x.T @ (y - p) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-9:
            break
    return w


def _doc_features(marginal: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    text = np.repeat(np.arange(len(lengths)), lengths)
    top = np.zeros(len(lengths))
    np.maximum.at(top, text, marginal)
    total = np.bincount(text, marginal, len(lengths))
    top = np.clip(top, 1e-6, 1 - 1e-6)
    return np.stack([np.ones(len(lengths)), np.log(top / (1 - top)) / 4, np.log1p(total)], axis=1)


def fit(texts: list[str | None], labels: list[int], *, rounds: int = 120, window: int = 10, ridge: float = 0.05, seed: int = 3,
        toxic_windows: int = 3, clean_windows: int = 2) -> SpanModel:
    """Fit on labelled texts (1 toxic). Equal texts count once; with one class only, nothing is learnt.

    All words of all texts mark the toxic ones; the field's weights are learnt on at most ``toxic_windows`` windows around such
    words of a toxic text and ``clean_windows`` of a clean one. Scoring reads whole texts.
    """
    pairs = sorted({(t or "", int(y)) for t, y in zip(texts, labels, strict=True) if y is not None})
    y = np.array([b for _, b in pairs], int)
    if not len(y) or y.min() == y.max():
        return SpanModel()
    one: dict[str, str] = {}  # one object per different word
    words = [[one.setdefault(w, w) for w in _WORD.findall(t.lower())] for t, _ in pairs]
    del pairs, one
    inflected = _inflected(words)
    keys_of: dict[str, tuple[str, ...]] = {}  # a word and its stems, told apart by a mark that no word holds
    for w in {x for part in words for x in part}:
        keys_of[w] = (w, *[k for k in _stems(w) if k in inflected])
    marks = _toxic_keys([{k for x in set(w) for k in keys_of[x]} for w in words], y)
    rng = np.random.default_rng(seed)
    pieces: list[tuple[list[str], np.ndarray]] = []
    for w, toxic in zip(words, y, strict=True):
        hot = np.array([i for i, x in enumerate(w) if not marks.isdisjoint(keys_of[x])] if toxic else [], int)
        for i in rng.permutation(hot)[:toxic_windows]:
            part = w[max(0, i - window) : i + window + 1]
            pieces.append((part, np.array([not marks.isdisjoint(keys_of[x]) for x in part])))
        for i in rng.integers(0, max(1, len(w)), clean_windows if not toxic else 0):
            part = w[i : i + 4 * window]
            if part:
                pieces.append((part, np.zeros(len(part), bool)))
    if not any(t.any() for _, t in pieces):
        return SpanModel()
    seen = Counter(x for part, _ in pieces for x in set(part))
    stem_seen = Counter(k[:-1] for part, _ in pieces for k in {k for x in part for k in keys_of[x][1:]})
    known = sorted(w for w, n in seen.items() if n >= 3)
    stems = sorted(k for k, n in stem_seen.items() if n >= 3)
    model = SpanModel(ids={w: i + 1 for i, w in enumerate(known)})
    model.stems = {k: 1 + len(known) + i for i, k in enumerate(stems)}
    size = 1 + len(known) + len(stems)
    up = np.zeros((2, size), np.int64)  # the rows of a row's stems; row 0, without weight, where there is none
    for word, i in (model.ids | model.stems).items():
        for j, n in enumerate((4, 5)):
            stem = model.stems.get(word[:n], 0) if len(word) >= n else 0
            up[j, i] = stem if stem != i else 0
    look = WordIds(model)
    rows = [np.fromiter(map(look.__getitem__, part), np.int64, len(part)) for part, _ in pieces]
    truth = np.concatenate([t for _, t in pieces]).astype(float)
    lengths = np.array([len(r) for r in rows])
    ids = np.concatenate(rows)
    open_at = (np.cumsum(lengths) - lengths)
    past = np.roll(ids, 1)
    past[open_at] = 0
    coming = np.roll(ids, -1)
    coming[np.cumsum(lengths) - 1] = 0
    before_truth = np.roll(truth, 1)
    before_truth[open_at] = 0
    w = {k: np.zeros(size) for k in ("word", "before", "after")}
    move, bias = np.zeros((2, 2)), -2.0
    memory = {k: np.full(size, 1e-6) for k in w} | {"move": np.full((2, 2), 1e-6), "bias": 1e-6}
    rate = 0.5
    for _ in range(rounds):
        model.here = bias + w["word"] + w["word"][up[0]] + w["word"][up[1]]
        model.before, model.after, model.moves = w["before"], w["after"], np.exp(move)
        marginal, came, comes = forward_backward(emissions(rows, model), lengths, model.moves, 4 * window)
        wrong = truth - marginal
        grads = {
            "word": sum(np.bincount(x, wrong, size) for x in (ids, up[0][ids], up[1][ids])),
            "before": np.bincount(past, wrong, size), "after": np.bincount(coming, wrong, size),
        }
        gain = np.exp(np.clip(emissions(rows, model), -30, 30))
        pair = np.stack([(1 - came) * model.moves[0, 0] * (1 - comes), (1 - came) * model.moves[0, 1] * gain * comes,
                         came * model.moves[1, 0] * (1 - comes), came * model.moves[1, 1] * gain * comes])
        pair /= pair.sum(axis=0)
        real = np.array([((1 - before_truth) * (1 - truth)).sum(), ((1 - before_truth) * truth).sum(),
                         (before_truth * (1 - truth)).sum(), (before_truth * truth).sum()])
        grads["move"] = (real - pair.sum(axis=1)).reshape(2, 2)
        for k in w:
            # Neighbours say little, so their weights are held back more.
            g = grads[k] - (ridge if k == "word" else 100 * ridge) * w[k]
            g[0] = 0
            memory[k] += g * g
            w[k] = w[k] + rate * g / np.sqrt(memory[k])
        g = grads["move"] - ridge * move
        memory["move"] += g * g
        move = move + rate * g / np.sqrt(memory["move"])
        memory["bias"] += wrong.sum() ** 2
        bias += rate * wrong.sum() / np.sqrt(memory["bias"])
    model.here = bias + w["word"] + w["word"][up[0]] + w["word"][up[1]]
    model.before, model.after, model.moves = w["before"], w["after"], np.exp(move)
    features = []
    for lo in range(0, len(words), 128):
        whole = [np.fromiter(map(look.__getitem__, x), np.int64, len(x)) for x in words[lo : lo + 128]]
        lengths = np.array([len(r) for r in whole])
        marginal, _, _ = forward_backward(emissions(whole, model), lengths, model.moves)
        features.append(_doc_features(marginal, lengths))
    model.doc = _logistic(np.concatenate(features), y, 0.1)
    return model


def score_texts(texts: list[str | None], model: SpanModel, look: WordIds) -> tuple[np.ndarray, list[list[tuple[int, int, float]]]]:
    """Score of each text and its offending spans (start, end, marginal) in characters."""
    if model.doc is None:
        return np.zeros(len(texts)), [[] for _ in texts]
    rows = []
    for t in texts:
        words = _WORD.findall(t) if t else []
        rows.append(np.fromiter(map(look.__getitem__, words), np.int64, len(words)))
    lengths = np.array([len(r) for r in rows], np.int64)
    marginal, _, _ = forward_backward(emissions(rows, model), lengths, model.moves)
    score = 1 / (1 + np.exp(-np.clip(_doc_features(marginal, lengths) @ model.doc, -30, 30)))
    ends = np.cumsum(lengths)
    spans: list[list[tuple[int, int, float]]] = []
    for t, lo, hi in zip(texts, ends - lengths, ends, strict=True):
        hot = np.flatnonzero(marginal[lo:hi] >= 0.5)
        if len(hot):
            at = [m.span() for m in _WORD.finditer(t)]
            spans.append([(*at[i], float(marginal[lo + i])) for i in hot])
        else:
            spans.append([])
    return score, spans


def _slices(texts: pa.Array, chars: int = 4_000_000) -> Iterator[list[str | None]]:
    size, part = 0, []
    for t in texts:
        part.append(t.as_py())
        size += len(part[-1] or "")
        if size > chars:
            yield part
            size, part = 0, []
    if part:
        yield part


def labelled_sample(docs: DataFrame, labels: DataFrame, *, id: str = "doc_id", text: str = "text", label: str = "toxic",
                    per_class: int = 1500) -> pd.DataFrame:
    """Texts and labels of at most ``per_class`` labelled ids a class, those of smallest id hash, in this order.

    An id that is labelled both ways is left out; of several texts of one id the first in order stands for it.
    """
    known = (
        labels.select(col(id).alias("_id"), col(label).cast("int").alias("_y")).filter("_id IS NOT NULL AND _y IN (0, 1)")
        .groupBy("_id").agg(F.min("_y").alias("_y"), F.max("_y").alias("_z")).filter("_y = _z").drop("_z")
    )
    picked = None
    for y in (0, 1):
        part = known.filter(F.col("_y") == y).orderBy(F.xxhash64("_id"), "_id").limit(per_class)
        picked = part if picked is None else picked.unionByName(part)
    # At most 2 * per_class rows, so this side is small whatever the input.
    return docs.select(col(id).alias("_d"), col(text).alias("text")).join(
        F.broadcast(picked), F.col("_d") == F.col("_id")
    ).groupBy("_id", "_y").agg(F.min("text").alias("text")).orderBy(F.xxhash64("_id"), "_id").select(
        "text", F.col("_y").alias("label")
    ).toPandas()


def score_documents(docs: DataFrame, model: SpanModel, *, id: str = "doc_id", text: str = "text") -> DataFrame:
    """``id``, ``score`` and ``spans`` (``start``, ``end``, ``marginal``) per row, over whole texts; one row out per row in.

    Null and empty texts score as texts without any sign of toxicity. Rows are scored each for themselves, so ties, repeats
    and other columns play no part; an empty table gives no rows.
    """
    rows = docs.select(col(id).alias("_id"), col(text).alias("_t"))
    kind = rows.schema["_id"].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(model)
    span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("marginal", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        look = WordIds(shared.value)
        for batch in batches:
            score, spans = [], []
            for part in _slices(batch.column(1)):
                s, found = score_texts(part, shared.value, look)
                score += s.tolist()
                spans += [[{"start": a, "end": b, "marginal": m} for a, b, m in x] for x in found]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score, pa.float64()), pa.array(spans, span)],
                                             names=[id, "score", "spans"])

    return rows.mapInArrow(run, f"`{id}` {kind}, score double, spans array<struct<start:int,end:int,marginal:double>>")


def drop_toxic(docs: DataFrame, model: SpanModel, *, text: str = "text", threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that score below ``threshold``, with all their columns."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        look = WordIds(shared.value)
        for batch in batches:
            keep: list[bool] = []
            for part in _slices(batch.column(at)):
                keep += (score_texts(part, shared.value, look)[0] < threshold).tolist()
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
