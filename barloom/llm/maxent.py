"""Hashed maximum-entropy language model with a class-factored softmax.

P(word | context) = P(class | context) * P(slot | class, context) * P(word | class, slot).  A word's class
comes from its last bytes and its slot from its first ones, so both are known for unseen words.  The first
two factors are softmaxes over CLASSES and SLOTS outputs whose scores add up hashed features of the context:
the word before, the pair before (n-grams), and the words two and three before (skips).  The last factor
comes from counts over the whole training corpus, (c + 1) / (N_b + V_b + 1) within a class and slot, so
every context's probabilities of all known words and one unknown word a bucket sum to one.

Training: the documents are dealt to shards of about SHARD bytes by a hash of the row, so that the model follows
from the rows alone, not from partitions or cores.  In each of ROUNDS rounds every shard takes gradient steps
(AdaGrad) over its share, beginning with the broadcast weights, and the token-weighted mean of the shards'
changes, summed up in a tree, is added.  The gradient of a softmax is the features of the true outcome less their
expectation; the expectation is estimated by one outcome drawn from the model for each token (Gumbel noise on
the scores), so a step only touches two cells a feature.  Scores are the full softmax.

The feature tables grow with the training text: one row of the class table for each 16 KB, 2**14 to 2**17 rows
(the weights, at most 21 MB, are broadcast).  Counts: each group of documents asks for its distinct words once,
packed by hash range (64-bit hashes), and scoring joins the answers, so the text moves once.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _session
from . import _text as t
from .substring_dedup import _cuts, _packed

CLASSES = SLOTS = 32
BATCH = 1 << 16
STEPS = 16  # mini-batches of a piece, at least
SCORED = 8192  # tokens scored at once
PIECE = 4 << 20  # bytes of text whose mini-batches are mixed
ROUNDS = (0.125, 0.875)
RATE = 0.15
SHARD = 32 << 20
SHARDS = 8192  # above this number shards grow instead
BRANCH = 16
NARROWER = 5  # the slot table has 2**NARROWER times fewer rows, each for all classes
PARTS = 16
U64 = np.uint64
_END, _START = t.stream(61, 2)


class Tokens:
    """Tokens of documents in order, each document followed by its end."""

    def __init__(self, column):
        data, offsets = t.buffers(column)
        data = t.LOWER[data]
        start, end, first = t.words(data, offsets)
        n = len(first) - 1
        self.begin = first + np.arange(n + 1)
        last = self.begin[1:] - 1
        total = int(self.begin[-1])
        body = np.ones(total, bool)
        body[last] = False
        self.word = np.full(total, _END, U64)
        self.word[body] = t.hashes(data, start, end, 62)
        bucket = np.zeros(total, np.int64)
        if len(start):
            lo, hi = start.astype(np.int64), end.astype(np.int64)
            tail = np.zeros(len(start), np.int64)
            head = np.zeros(len(start), np.int64)
            for k in range(3):
                tail = tail * 257 + np.where(hi - 1 - k >= lo, data[np.maximum(hi - 1 - k, lo)].astype(np.int64) + 1, 0)
                head = head * 257 + np.where(lo + k < hi, data[np.minimum(lo + k, hi - 1)].astype(np.int64) + 1, 0)
            classes = (t.mix(tail.astype(U64) + U64(17)) >> U64(32)).astype(np.int64) % CLASSES
            slots = (t.mix(head.astype(U64) + U64(99)) >> U64(32)).astype(np.int64) % SLOTS
            bucket[body] = classes * SLOTS + slots
        self.bucket = bucket

    def contexts(self, bits: int) -> tuple[np.ndarray, np.ndarray]:
        """(rows of the class weights, rows of the slot weights), one column a feature; see Weights."""
        n = len(self.word)
        before = []
        for back in (1, 2, 3):
            x = np.full(n, _START, U64)
            x[back:] = self.word[:-back] if n > back else x[back:]
            for k in range(back):
                at = self.begin[:-1] + k
                at = at[at < np.minimum(self.begin[1:], n)]
                x[at] = _START
            before.append(x)
        one, two, three = before
        with np.errstate(over="ignore"):
            keys = [t.mix(one + U64(1)), t.mix(one * U64(3) + t.mix(two)), t.mix(two + U64(2)), t.mix(three + U64(3))]
        wide = np.stack([(k >> U64(64 - bits)).astype(np.int32) for k in keys], 1)
        narrow = np.stack([(keys[i] >> U64(64 - bits + NARROWER)).astype(np.int32) for i in (0, 2)], 1)
        return wide, narrow


class Weights:
    """Class weights (row, class) and slot weights (row * class, slot), each with a last row for the bias.

    ``bits``: the class table has 2**bits rows, the slot table 2**(bits - NARROWER) for each class.
    """

    def __init__(self, bits: int, parts=None):
        self.bits = bits
        self.classes, self.slots = parts or [np.zeros(s, np.float32) for s in self.shapes(bits)]

    @staticmethod
    def shapes(bits: int):
        return ((1 << bits) + 1, CLASSES), (((1 << (bits - NARROWER)) + 1) * CLASSES, SLOTS)

    def rows(self, wide, narrow, bucket):
        """Per level: (table, rows of each feature and of the bias, true outcomes)."""
        c = bucket // SLOTS
        bias = np.full(len(bucket), len(self.classes) - 1)
        yield self.classes, [*wide.T, bias], c
        yield self.slots, [*(x * CLASSES + c for x in narrow.T), (len(self.slots) - CLASSES) + c], bucket % SLOTS

    @staticmethod
    def sums(table, rows) -> np.ndarray:
        """The outcomes' scores: a sum of the features' rows."""
        out = table[rows[0]]
        for r in rows[1:]:
            out += table[r]
        return out

    def log10(self, wide, narrow, bucket) -> np.ndarray:
        """Per token log10 P(class | context) + log10 P(slot | class, context)."""
        out = np.empty(len(bucket))
        for lo in range(0, len(bucket), SCORED):
            part = slice(lo, lo + SCORED)
            out[part] = 0
            for table, rows, true in self.rows(wide[part], narrow[part], bucket[part]):
                x = self.sums(table, rows)
                x -= x.max(1, keepdims=True)
                out[part] += x[np.arange(len(x)), true] - np.log(np.exp(x).sum(1))
        return out / np.log(10)

    def step(self, wide, narrow, bucket, seen, draw) -> None:
        """One gradient step; seen holds the sums of squared gradients, draw gives Gumbel noise for n tokens."""
        for (table, rows, true), g in zip(self.rows(wide, narrow, bucket), seen):
            drawn = (self.sums(table, rows) + draw(len(bucket))).argmax(1)
            width = table.shape[1]
            ups = np.concatenate([r * width + true for r in rows])
            downs = np.concatenate([r * width + drawn for r in rows])
            change = (np.bincount(ups, minlength=table.size) - np.bincount(downs, minlength=table.size)).astype(np.float32).reshape(table.shape)
            g += change * change
            table += RATE * change / np.sqrt(g)


def table_bits(size: int) -> int:
    """The feature table's bits for ``size`` bytes of training text: a row for each 16 KB."""
    return min(17, max(14, (size >> 14).bit_length()))


class _Learner:
    """The weights of one shard on the way: starts from the shared ones, ends in a row of changes a slice."""

    def __init__(self, shard: int, start, bits: int):
        self.shard, self.bits, self.start, self.count = shard, bits, start, 0
        self.weights = Weights(bits, [x.copy() for x in start])
        self.seen = [np.ones(x.shape, np.float32) for x in start]
        self.rng = np.random.default_rng([71, shard])
        self.noise = -np.log(self.rng.exponential(size=(BATCH + 4096, max(CLASSES, SLOTS)))).astype(np.float32)
        self.held, self.size = [], 0

    def draw(self, n: int) -> np.ndarray:
        at = int(self.rng.integers(0, 4096))
        return self.noise[at : at + n]

    def add(self, texts: pa.Array) -> None:
        """Take texts in order; pieces end where the texts so far reach PIECE bytes, however they come in."""
        sizes = np.asarray(pc.fill_null(pc.binary_length(texts.cast(pa.large_binary())), 0), np.int64)
        lo = 0
        while lo < len(texts):
            total = self.size + np.cumsum(sizes[lo:])
            hi = lo + int(np.searchsorted(total, PIECE)) + 1
            self.held.append(texts.slice(lo, hi - lo))
            self.size = int(total[min(hi, len(texts)) - lo - 1])
            if self.size >= PIECE:
                self.learn()
            lo = hi

    def learn(self) -> None:
        if not self.held:
            return
        tokens = Tokens(pa.chunked_array(self.held, pa.large_string()))
        self.held, self.size = [], 0
        wide, narrow = tokens.contexts(self.bits)
        n = len(wide)
        steps = max(-(-n // BATCH), min(STEPS, 1 + n // 64))
        for k in range(steps * max(1, min(20, BATCH // n))):  # mini-batches mix the piece's documents; few tokens are gone over more often
            pick = slice(k % steps, n, steps)
            self.weights.step(wide[pick], narrow[pick], tokens.bucket[pick], self.seen, self.draw)
        self.count += n

    def change(self, slices: int) -> pa.RecordBatch:
        self.learn()
        whole = np.concatenate([(x - y).ravel() for x, y in zip((self.weights.classes, self.weights.slots), self.start)])
        cut = np.array_split(whole.astype(np.float16), slices)
        return pa.RecordBatch.from_arrays([pa.array([self.shard] * slices, pa.int32()), pa.array(range(slices), pa.int32()), pa.array([self.count] * slices, pa.int64()), pa.array([x.tobytes() for x in cut], pa.binary())], ["shard", "slice", "tokens", "change"])


def _learn(shared, bits: int, slices: int):
    """Rows come sorted by shard and hash, so what a shard learns doesn't depend on batches or partitions."""

    def run(batches):
        learner = None
        for batch in batches:
            shards = np.asarray(batch.column("shard"))
            texts = batch.column("text").cast(pa.large_string())
            cuts = np.r_[0, np.flatnonzero(shards[1:] != shards[:-1]) + 1, len(shards)]
            for lo, hi in zip(cuts[:-1], cuts[1:]):
                if hi == lo:
                    continue
                if learner is None or learner.shard != shards[lo]:
                    if learner is not None:
                        yield learner.change(slices)
                    learner = _Learner(int(shards[lo]), shared.value, bits)
                learner.add(texts.slice(lo, hi - lo))
        if learner is not None:
            yield learner.change(slices)

    return t.trimmed(run)


CHANGE = "shard int, slice int, tokens long, change binary"


def _mean(key, table):
    """The token-weighted mean of one slice of up to BRANCH shards or means, in their order."""
    table = table.sort_by("shard")
    total, weight = None, 0
    for n, raw in zip(table["tokens"].to_pylist(), table["change"]):
        x = np.frombuffer(raw.as_buffer(), np.float16).astype(np.float64) * n
        total = x if total is None else total + x
        weight += n
    mean = (total / max(1, weight)).astype(np.float16)
    return pa.table({"shard": pa.array([table["shard"][0].as_py() // BRANCH], pa.int32()), "slice": pa.array([table["slice"][0].as_py()], pa.int32()), "tokens": pa.array([weight], pa.int64()), "change": pa.array([mean.tobytes()], pa.binary())})


def train(docs: DataFrame, size: int | None = None, slices: int = 16) -> Weights:
    """Weights after one pass over all of docs (doc_id, text), in rounds that share the documents out by hash."""
    spark = docs.sparkSession
    size = _session.text_bytes(docs) if size is None else size
    bits = table_bits(size)
    weights = [np.zeros(s, np.float32) for s in Weights.shapes(bits)]
    share = F.pmod(F.xxhash64("text", "doc_id"), F.lit(1000))
    low = 0.0
    for part in ROUNDS:
        shards = max(1, min(SHARDS, round(size * part / SHARD)))
        mine = docs.where((share >= 1000 * low) & (share < 1000 * (low + part)))
        mine = mine.select(F.pmod(F.xxhash64("doc_id", "text"), F.lit(shards)).cast("int").alias("shard"), F.xxhash64("text").alias("tie"), "text")
        low += part
        shared = spark.sparkContext.broadcast(weights)
        dealt = mine.repartition(min(shards, int(spark.conf.get("spark.sql.shuffle.partitions"))), "shard").sortWithinPartitions("shard", "tie").select("shard", "text")
        changes = dealt.mapInArrow(_learn(shared, bits, slices), CHANGE)
        while True:
            changes = changes.groupBy("slice", F.floor(F.col("shard") / BRANCH).alias("branch")).applyInArrow(_mean, CHANGE)
            if shards <= BRANCH:
                break
            shards = -(-shards // BRANCH)
        got = changes.toArrow().sort_by("slice")
        if len(got):
            flat = np.concatenate([np.frombuffer(x, np.float16) for x in got["change"].to_pylist()]).astype(np.float32)
            sizes = np.cumsum([x.size for x in weights])[:-1]
            weights = [w + x.reshape(w.shape) for w, x in zip(weights, np.split(flat, sizes))]
        shared.unpersist()
    return Weights(bits, weights)


class _Corpus:
    """One group's documents in a fixed order, with the distinct words it asks for."""

    def __init__(self, table):
        self.table = table.sort_by([("doc_id", "ascending"), ("tie", "ascending")]).combine_chunks()
        self.held = np.asarray(self.table["held_out"])
        self.parts, self.first = [], [0]
        sizes = np.asarray(pc.fill_null(pc.binary_length(self.table["text"].cast(pa.large_binary())), 0), np.int64)
        for lo, hi in t.slices(sizes):
            self.parts.append((lo, hi, Tokens(self.table["text"].slice(lo, hi - lo))))
        word = np.concatenate([x.word for _, _, x in self.parts]) if self.parts else np.zeros(0, U64)
        bucket = np.concatenate([x.bucket for _, _, x in self.parts]) if self.parts else np.zeros(0, np.int64)
        learned = np.concatenate([np.repeat(~self.held[lo:hi], np.diff(x.begin)) for lo, hi, x in self.parts]) if self.parts else np.zeros(0, bool)
        self.kinds, at, self.back = np.unique(word, return_index=True, return_inverse=True)
        self.bucket = bucket[at]
        self.counts = np.bincount(self.back, learned, len(self.kinds)).astype(np.int64)


def _ask(buckets: int):
    def run(key, table):
        corpus = _Corpus(table)
        if len(corpus.back) >= 1 << 32:
            raise ValueError("a group of documents has too many tokens for its counts")
        counts, place = corpus.counts.astype(np.uint32), corpus.bucket.astype(np.uint16)
        return _packed(key[0].as_py(), corpus.kinds, buckets, lambda i, j: corpus.kinds[i:j].tobytes() + counts[i:j].tobytes() + place[i:j].tobytes())

    return run


def _asked(table):
    """(distinct words, first place, place in them of every entry, entries by asking row, training counts, buckets)."""
    raws = table["payload"].to_pylist()
    sizes = [len(x) // 14 for x in raws]
    word = np.concatenate([np.frombuffer(x, U64, n) for x, n in zip(raws, sizes)])
    count = np.concatenate([np.frombuffer(x, np.uint32, n, 8 * n) for x, n in zip(raws, sizes)])
    place = np.concatenate([np.frombuffer(x, np.uint16, n, 12 * n) for x, n in zip(raws, sizes)])
    kinds, at, back = np.unique(word, return_index=True, return_inverse=True)
    return back, sizes, np.bincount(back, count, len(kinds)).astype(np.int64), place[at]


def _answer(key, table):
    back, sizes, total, _ = _asked(table)
    answers = np.split(total[back], np.cumsum(sizes)[:-1])
    return pa.table({"pid": table["pid"], "bucket": table["bucket"], "bits": pa.array([x.tobytes() for x in answers], pa.binary())})


def _totals(key, table):
    """One row: tokens and known words of each model bucket among the words of one hash range."""
    _, _, total, place = _asked(table)
    both = np.stack([np.bincount(place, x, CLASSES * SLOTS).astype(np.int64) for x in (total, total > 0)])
    return pa.table({"part": pa.array([key[0].as_py() % PARTS], pa.int32()), "bits": pa.array([both.tobytes()], pa.binary())})


def _add(key, table):
    both = sum(np.frombuffer(x, np.int64) for x in table["bits"].to_pylist())
    return pa.table({"part": pa.array([key[0].as_py()], pa.int32()), "bits": pa.array([both.tobytes()], pa.binary())})


OUT = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def _score(shared, buckets: int):
    def run(key, left, right):
        corpus, weights = _Corpus(left), shared.value
        totals = np.zeros((2, CLASSES * SLOTS), np.int64)
        counts = np.zeros(len(corpus.kinds), np.int64)
        cuts = _cuts(corpus.kinds, buckets)
        for b, bits in zip(right["bucket"].to_pylist(), right["bits"].to_pylist()):
            if b < 0:
                totals += np.frombuffer(bits, np.int64).reshape(totals.shape)
            else:
                counts[cuts[b] : cuts[b + 1]] = np.frombuffer(bits, np.int64)
        n, v = int(totals[0].sum()), int(totals[1].sum())
        base = np.log10((counts + 1) / (n + v + 1))
        within = np.log10((counts + 1) / (totals[0] + totals[1] + 1)[corpus.bucket])
        known = counts > 0
        rows, at = [], 0
        for lo, hi, tokens in corpus.parts:
            back = corpus.back[at : at + len(tokens.word)]
            at += len(back)
            begin = tokens.begin[:-1]
            model = weights.log10(*tokens.contexts(weights.bits), tokens.bucket) + within[back]
            rows.append([np.diff(tokens.begin), np.add.reduceat(known[back].astype(np.int64), begin), np.add.reduceat(base[back], begin), np.add.reduceat(model, begin)])
        size, known, base, model = (np.concatenate(x) for x in zip(*rows))
        return pa.table({
            "doc_id": corpus.table["doc_id"], "held_out": corpus.table["held_out"], "n_tokens": pa.array(size, pa.int64()), "n_known": pa.array(known, pa.int64()),
            "train_tokens": pa.array(np.full(len(size), n), pa.int64()), "base_score": pa.array(base, pa.float64()), "score": pa.array(model, pa.float64()),
        })

    return run


def score(docs: DataFrame, held_out, weights: Weights | None = None) -> DataFrame:
    """Per row of docs (doc_id, text): the columns of OUT; held_out is a condition, other rows are learned from.

    Null texts are empty: one token, the end; very long ones are scored whole.  Rows with a null condition are
    learned from; rows repeat as in docs and count each, rows with a null doc_id too.  Other columns are ignored;
    an empty table gives an empty result.
    """
    spark = docs.sparkSession
    size = _session.text_bytes(docs)
    groups = _session.fan(spark, size)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.coalesce(held_out, F.lit(False)).alias("held_out"))
    weights = train(rows.where("not held_out"), size) if weights is None else weights
    shared = spark.sparkContext.broadcast(weights)
    rows = rows.withColumn("tie", F.xxhash64("text")).withColumn("pid", F.pmod(F.xxhash64("doc_id", "tie"), F.lit(groups)).cast("int"))
    asked = rows.groupBy("pid").applyInArrow(_ask(groups), "pid int, bucket int, payload binary")
    told = asked.groupBy("bucket").applyInArrow(_answer, "pid int, bucket int, bits binary")
    totals = asked.groupBy("bucket").applyInArrow(_totals, "part int, bits binary").groupBy("part").applyInArrow(_add, "part int, bits binary")
    # PARTS rows of 16 KB, given to every group
    totals = totals.select(F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("pid"), F.lit(-1).alias("bucket"), "bits")
    return rows.groupBy("pid").cogroup(told.union(totals).groupBy("pid")).applyInArrow(_guard(_score(shared, groups)), OUT)


def _guard(run):
    """Groups that have answers but no documents give nothing."""

    def guarded(key, left, right):
        if not left.num_rows:
            return pa.table({"doc_id": pa.array([], pa.int64()), "held_out": pa.array([], pa.bool_()), **{c: pa.array([], pa.int64()) for c in ("n_tokens", "n_known", "train_tokens")}, "base_score": pa.array([], pa.float64()), "score": pa.array([], pa.float64())})
        return run(key, left, right)

    return guarded
