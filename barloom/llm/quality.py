"""Quality classifier: a factorisation machine over hashed words, structure and metadata.

score = sigmoid(w0 + sum w_i x_i + 1/2 sum_f [(sum v_if x_i)^2 - sum v_if^2 x_i^2]), so the pairwise
interactions of a text with n features cost n * rank.  Features: hashed lower-cased words (root of the
count, scaled to unit length), binned structure statistics of the bytes and words, and binned metadata
columns that the caller names.  The model is fitted on the driver from at most ``sample`` labelled rows
(SAMPLE below, chosen by a hash of their ids) and broadcast: 2**WORD_BITS * (rank + 1) floats at most.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _text as t

SAMPLE = 8000
WORD_BITS = 16
RANK = 8
BINS = 24
PIECE = 1 << 20  # bytes of text turned into features at once
STEPS = 500  # few rows are gone over more often
U64 = np.uint64

_CLASS = np.zeros(256, np.uint8)  # bit 0 upper, 1 lower, 2 digit, 3 white space, 4 newline, 5 other ASCII, 6 not ASCII
_CLASS[65:91] = 1
_CLASS[97:123] = 2
_CLASS[48:58] = 4
_CLASS[t.SPACE] |= 8
_CLASS[10] |= 16
_CLASS[33:48] = _CLASS[58:65] = _CLASS[91:97] = _CLASS[123:127] = 32
_CLASS[128:] = 64
_STATS = 15


def _bin(values: np.ndarray) -> np.ndarray:
    """Bin of a share in 0..1, finer towards 0."""
    return np.minimum(BINS - 1, (np.sqrt(np.clip(values, 0, 1)) * BINS).astype(np.int64))


def features(column, metadata: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(begins by document, places, values) of the sparse rows."""
    data, offsets = t.buffers(column)
    n_docs = len(offsets) - 1
    kinds = _CLASS[data]
    size = np.diff(offsets)
    per = []
    for bit in range(7):
        total = np.r_[0, np.cumsum((kinds >> bit) & 1, dtype=np.int64)]
        per.append(np.diff(total[offsets]) / np.maximum(1, size))
    start, end, first = t.words(data, offsets)
    n_words = np.diff(first)
    word = t.hashes(t.LOWER[data], start, end, 41)
    owner = np.repeat(np.arange(n_docs), n_words)
    keys = np.sort((owner.astype(U64) << U64(WORD_BITS)) | (word >> U64(64 - WORD_BITS)))
    begin = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, np.int64)
    counts = np.diff(np.r_[begin, len(keys)])
    keys = keys[begin].astype(np.int64)
    doc, place = keys >> WORD_BITS, keys & ((1 << WORD_BITS) - 1)
    value = np.sqrt(counts)
    norm = np.sqrt(np.bincount(doc, value * value, n_docs))
    value = value / norm[doc] if len(doc) else value
    some = np.maximum(1, n_words)
    kinds_of = np.bincount(doc, minlength=n_docs)
    most = np.zeros(n_docs)
    np.maximum.at(most, doc, counts)
    length = end - start
    mean = np.bincount(owner, length, n_docs) / some
    capital = np.bincount(owner, (_CLASS[data[start]] & 1) if len(start) else None, n_docs) / some if len(start) else np.zeros(n_docs)
    shout = (np.minimum(length, 2) == 2) & (_CLASS[data[np.minimum(start + 1, len(data) - 1)]] & 1 > 0) if len(start) else np.zeros(0, bool)
    shout = np.bincount(owner, shout, n_docs) / some if len(start) else np.zeros(n_docs)
    odd = (_CLASS[data[end - 1]] & 32 > 0) if len(end) else np.zeros(0, bool)
    odd = np.bincount(owner, odd, n_docs) / some if len(start) else np.zeros(n_docs)
    stats = [*(_bin(x) for x in per), _bin(kinds_of / some), _bin(most / some), _bin(mean / 40), _bin(capital), _bin(shout), _bin(odd),
             np.minimum(BINS - 1, np.log2(1 + n_words).astype(np.int64)), np.minimum(BINS - 1, np.log2(1 + size).astype(np.int64))]
    base = 1 << WORD_BITS
    places, values, owners = [place], [value], [doc]
    for k, bins in enumerate([*stats, *metadata]):
        places.append(base + k * BINS + bins)
        values.append(np.full(n_docs, 0.5))
        owners.append(np.arange(n_docs))
    owners = np.concatenate(owners)
    order = np.argsort(owners, kind="stable")
    return np.searchsorted(owners[order], np.arange(n_docs + 1)), np.concatenate(places)[order], np.concatenate(values)[order].astype(np.float32)


def _metadata_bins(batch: pa.RecordBatch, names: list[str]) -> list[np.ndarray]:
    """Numbers by the binary order of their size, text by a hash; null has a bin of its own."""
    out = []
    for name in names:
        column = batch.column(name)
        missing = np.asarray(column.is_null())
        if pa.types.is_integer(column.type) or pa.types.is_floating(column.type):
            x = np.nan_to_num(np.abs(np.asarray(column.fill_null(0), float)), posinf=1e300)
            bins = np.minimum(BINS - 2, np.log2(1 + x).astype(np.int64))
        else:
            data, offsets = t.buffers(column.cast(pa.string()))
            bins = np.array([int(t.hashes(data, np.array([i]), np.array([j]), 43)[0] % U64(BINS - 1)) if j > i else 0 for i, j in zip(offsets, offsets[1:])], np.int64)
        out.append(np.where(missing, BINS - 1, bins))
    return out


@dataclass
class Model:
    """Weights of a fitted machine; ``score`` takes sparse rows."""

    bias: float
    weights: np.ndarray
    factors: np.ndarray

    def margin(self, begins: np.ndarray, places: np.ndarray, values: np.ndarray) -> np.ndarray:
        at = begins[:-1]
        x = values[:, None] * self.factors[places]
        sums, squares = np.add.reduceat(x, at), np.add.reduceat(x * x, at)
        return self.bias + np.add.reduceat(values * self.weights[places], at) + 0.5 * (sums * sums - squares).sum(1)

    def score(self, begins, places, values) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(begins, places, values), -30, 30)))


def _train(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, size: int, epochs: int, rate: float, decay: float) -> Model:
    rng = np.random.default_rng(5)
    model = Model(0.0, np.zeros(size, np.float32), (rng.standard_normal((size, RANK)) * 0.02).astype(np.float32))
    if not len(rows):
        model.factors[:] = 0
        return model
    share = np.clip(labels.mean(), 0.01, 0.99)
    model.bias = float(np.log(share / (1 - share)))
    gw, gv = np.full(size, 1e-2, np.float32), np.full((size, RANK), 1e-2, np.float32)
    for _ in range(min(40, max(epochs, -(-STEPS * 64 // len(rows))))):
        order = rng.permutation(len(rows))
        for lo in range(0, len(order), 64):
            pick = order[lo : lo + 64]
            places, values = np.concatenate([rows[i][0] for i in pick]), np.concatenate([rows[i][1] for i in pick])
            begins = np.r_[0, np.cumsum([len(rows[i][0]) for i in pick])]
            own = np.repeat(np.arange(len(pick)), np.diff(begins))
            factors = model.factors[places]
            x = values[:, None] * factors
            sums = np.add.reduceat(x, begins[:-1])
            error = (model.score(begins, places, values) - labels[pick]).astype(np.float32)
            model.bias -= 0.02 * float(error.mean())
            each = error[own] * values
            kinds, back = np.unique(places, return_inverse=True)
            dw = np.bincount(back, each, len(kinds)).astype(np.float32) / 8 + decay * model.weights[kinds]
            slope = each[:, None] * (sums[own] - x)
            sort = np.argsort(back, kind="stable")
            dv = np.add.reduceat(slope[sort], np.searchsorted(back[sort], np.arange(len(kinds)))) / 8 + decay * model.factors[kinds]
            gw[kinds] += dw * dw
            gv[kinds] += dv * dv
            model.weights[kinds] -= rate * dw / np.sqrt(gw[kinds])
            model.factors[kinds] -= rate / 2 * dv / np.sqrt(gv[kinds])
    return model


def held_out(column: str = "doc_id", folds: int = 5, fold: int = 0):
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")) % folds == fold, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, metadata: list[str] = (), sample: int = SAMPLE, epochs: int = 6, rate: float = 0.08, decay: float = 1e-5) -> Model:
    """Fit on at most ``sample`` of the labelled rows given: labels has (doc_id, quality 0/1).

    Rows with a null id or label are left out; the mean decides where a doc_id has several labels, and the
    smallest text where it has several rows.  Without any usable row the model scores everything 0.5.
    """
    marked = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg((F.avg("quality") >= 0.5).cast("int").alias("label"))
    marked = F.broadcast(marked.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample))  # at most ``sample`` rows
    extra = [F.max(c).alias(f"m{k}") for k, c in enumerate(metadata)]
    texts = docs.join(marked, "doc_id").groupBy("doc_id", "label").agg(F.min(F.col("text").cast("string")).alias("text"), *extra)
    names = [f"m{k}" for k in range(len(metadata))]

    def run(batches):
        for batch in (part for batch in batches for part in t.pieces(batch, limit=PIECE)):
            begins, places, values = features(batch.column("text"), _metadata_bins(batch, names))
            cut = pa.array(begins, pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("label"), pa.ListArray.from_arrays(cut, pa.array(places, pa.int32())), pa.ListArray.from_arrays(cut, pa.array(values, pa.float32()))], ["doc_id", "label", "places", "values"])

    got = texts.mapInArrow(t.trimmed(run), "doc_id long, label int, places array<int>, values array<float>").toArrow().sort_by("doc_id")
    rows = [(np.asarray(p.values, np.int32), np.asarray(v.values, np.float32)) for p, v in zip(got["places"], got["values"])]
    model = _train(rows, np.asarray(got["label"], float), (1 << WORD_BITS) + (_STATS + len(metadata)) * BINS, epochs, rate, decay)
    del got, rows
    t.trim()
    return model


def _scored(docs: DataFrame, model: Model, metadata: list[str], threshold: float, keep: list[str], only: bool) -> DataFrame:
    """The columns ``keep`` as k0, k1, ..., score and predicted; with ``only`` rows below the threshold stay in the worker."""
    shared = docs.sparkSession.sparkContext.broadcast((model.bias, model.weights, model.factors))
    names = [f"m{k}" for k in range(len(metadata))]
    string = [c for c in keep if c == "text" and docs.schema[c].dataType.simpleString() == "string"]  # goes along once
    kept = [docs[c].alias(f"k{k}") for k, c in enumerate(keep) if c not in string]
    inner = docs.select(*kept, docs["text"].cast("string").alias("text"), *[docs[c].alias(n) for c, n in zip(metadata, names)])
    wanted = ["text" if c in string else f"k{k}" for k, c in enumerate(keep)]
    out = [f"k{k}" for k in range(len(keep))]

    def run(batches):
        model = Model(*shared.value)
        for batch in batches:
            for part in t.pieces(batch, limit=PIECE):
                scores = model.score(*features(part.column("text"), _metadata_bins(part, names))).astype(float)
                good = scores >= threshold
                made = pa.RecordBatch.from_arrays([*(part.column(c) for c in wanted), pa.array(scores), pa.array(good.astype(np.int32))], [*out, "score", "predicted"])
                yield made.filter(pa.array(good)) if only else made

    types = ", ".join(f"k{k} {docs.schema[c].dataType.simpleString()}" for k, c in enumerate(keep))
    return inner.mapInArrow(t.trimmed(run), f"{types}, score double, predicted int")


def score(docs: DataFrame, model: Model, metadata: list[str] = (), threshold: float = 0.3, keep: list[str] = ("doc_id",)) -> DataFrame:
    """Per row of docs the columns ``keep``, score (0 to 1) and predicted (1 if score >= threshold, else 0).

    Null and empty texts are scored by their structure alone, very long texts whole; rows repeat as in docs;
    columns not named are ignored, whatever their names; an empty table gives an empty result.
    """
    return _scored(docs, model, metadata, threshold, keep, False).withColumnsRenamed({f"k{k}": c for k, c in enumerate(keep)})


def accepted(docs: DataFrame, model: Model, metadata: list[str] = (), threshold: float = 0.3) -> DataFrame:
    """The rows of docs, with all their columns, whose score is at least the threshold; see ``score``."""
    rows = _scored(docs, model, metadata, threshold, docs.columns, True)
    return rows.drop("score", "predicted").toDF(*docs.columns)
