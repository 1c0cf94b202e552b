"""MinHash near-duplicates with tensored banding, confirmed on whole shingle sets.

Two collections of ``m`` hashes each (every one made of ``r`` minima) give m * m table keys, the pairs
(a_i, b_j), for 2 * m * r minima instead of m * m * 2 * r.  Two texts of similarity s share a key with
probability (1 - (1 - s**r)**m)**2; ``bands`` takes the smallest m that misses at most ``miss`` of the
links at the threshold.  Only hashes that another document shares take part in the m * m products.

Texts with equal sets are one class, so copies never meet as pairs.  Candidates are verified in two
rounds: each text against the smallest one with which it shares a key at each of its a_i, at most m pairs a
text; then every pair that shares a key and that the links found so far leave in different components, each
once, at the first a_i that it shares.  Pairs within a component are never formed.

A key is a weak test for texts that resemble one another a little below the threshold, so that a large group of
them would give pairs by the square of its size.  So the texts that share a key, and only they, get a sketch: four
bits of each of many further minima.  Of N minima two texts of similarity s differ in about 2 N (1 - s) bits, and a
pair that differs in more bits than a pair at the threshold does with a probability of SKETCH_MISS is no
candidate; the joins that find pairs look at the sketches themselves.  What is left is confirmed on the sets of
word sequences.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _session
from . import _text as t

U64 = np.uint64
GROUP = 256
PIECE = 1 << 20  # bytes of text hashed at once
SKETCH = 96  # words of 64 bits in a sketch; each has 4 bits of 16 minima
QUICK = 12  # words looked at first
SKETCH_MISS = 1e-5
SIGNED = "doc_id long, n_shingles long, s1 long, s2 long, a array<long>, b array<long>"


def bands(threshold: float, miss: float = 1e-4) -> tuple[int, int]:
    """(minima in a hash, hashes in a collection) for a similarity threshold."""
    r = 6
    return r, math.ceil(math.log(miss / 2) / math.log(1 - threshold**r))


def sketch_limit(threshold: float, minima: int) -> int:
    """Bits in which the sketches of two texts at the threshold differ at most, but for SKETCH_MISS of the cases."""
    one = np.array([math.comb(4, k) / 16 for k in range(5)]) * (1 - threshold)
    one[0] += threshold
    whole = np.ones(1)
    for _ in range(minima):
        whole = np.convolve(whole, one)
    return int(np.flatnonzero(np.cumsum(whole[::-1])[::-1] > SKETCH_MISS)[-1])


def shingle_sets(column, size: int):
    """Yield (row of the first document, sorted 56-bit shingles, begins) for runs of up to GROUP documents."""
    data, offsets = t.buffers(column)
    data = t.LOWER[data]
    start, end, first = t.words(data, offsets)
    word = t.hashes(data, start, end, 21)
    full, at = t.windows(word, first, size, 22)
    counts = np.diff(first)
    values, owner = [full], [t.doc_of(at, first)]
    for n in range(1, size):  # texts of fewer words: the whole sequence
        rows = np.flatnonzero(counts == n)
        if len(rows):
            with np.errstate(over="ignore"):
                whole = np.zeros(len(rows), U64)
                for k, c in enumerate(t.stream(23 + n, n)):
                    whole += word[first[rows] + k] * (c | U64(1))
            values.append(t.mix(whole))
            owner.append(rows)
    values, owner = np.concatenate(values), np.concatenate(owner)
    order = np.argsort(owner, kind="stable")
    values, owner = values[order], owner[order]
    for lo in range(0, len(counts), GROUP):
        i, j = np.searchsorted(owner, (lo, lo + GROUP))
        keys = np.sort(((owner[i:j] - lo).astype(U64) << U64(56)) | (values[i:j] >> U64(8)))
        if len(keys):
            keys = keys[np.r_[True, keys[1:] != keys[:-1]]]
        begins = np.searchsorted(keys, np.arange(min(GROUP, len(counts) - lo) + 1).astype(U64) << U64(56)) if lo + GROUP > len(counts) or GROUP < 256 else np.r_[np.searchsorted(keys, np.arange(GROUP).astype(U64) << U64(56)), len(keys)]
        yield lo, keys & U64((1 << 56) - 1), begins


def _sign(size: int, r: int, m: int):
    def run(batches):
        salts = t.stream(31, 2 * m * r)
        for batch in (part for batch in batches for part in t.pieces(batch, limit=PIECE)):
            ids = batch.column("doc_id")
            for lo, keys, begins in shingle_sets(batch.column("text"), size):
                n = np.diff(begins)
                some = np.flatnonzero(n)
                with np.errstate(over="ignore"):
                    s1, s2 = np.zeros(len(n), U64), np.zeros(len(n), U64)
                    sign = np.zeros((2 * m, len(some)), U64)
                    if len(some):
                        at = begins[:-1][some]
                        s1[some] = np.add.reduceat(t.mix(keys), at)
                        s2[some] = np.add.reduceat(t.mix(keys ^ U64(0x5BF03635AB2E91D7)), at)
                        spread = t.mix(keys + U64(1))
                        for k, c in enumerate(salts):
                            low = np.minimum.reduceat((spread ^ c) * (c | U64(1)), at)
                            sign[k // r] = t.mix(sign[k // r] + low + c)
                hold = np.r_[0, np.cumsum(n > 0)]
                yield pa.RecordBatch.from_arrays([ids.slice(lo, len(n)), pa.array(n, pa.int64()), pa.array(s1.view(np.int64)), pa.array(s2.view(np.int64)), _lists(hold, sign[:m]), _lists(hold, sign[m:])], ["doc_id", "n_shingles", "s1", "s2", "a", "b"])

    return t.trimmed(run)


def _lists(hold: np.ndarray, rows: np.ndarray) -> pa.ListArray:
    """One list a document: the columns of rows, or nothing where hold does not grow."""
    return pa.ListArray.from_arrays(pa.array(hold * len(rows), pa.int32()), pa.array(np.ascontiguousarray(rows.T).view(np.int64).ravel()))


def _sketches(size: int, allowed):
    """Sketches of the rows whose hashed id the bitmap holds."""

    def run(batches):
        salts = t.stream(33, 16 * SKETCH)
        for part in _known(allowed)(batches):
            for lo, keys, begins in shingle_sets(part.column("text"), size):
                n = np.diff(begins)
                some = np.flatnonzero(n)
                sketch = np.zeros((SKETCH, len(some)), U64)
                if len(some):
                    spread, at = t.mix(keys + U64(1)), begins[:-1][some]
                    with np.errstate(over="ignore"):
                        for k, c in enumerate(salts):
                            low = np.minimum.reduceat((spread ^ c) * (c | U64(1)), at)
                            sketch[k // 16] |= (t.mix(low) >> U64(60)) << U64(4 * (k % 16))
                    yield pa.RecordBatch.from_arrays([part.column("id").slice(lo, len(n)).take(pa.array(some)), _lists(np.arange(len(some) + 1), sketch)], ["id", "sketch"])

    return t.trimmed(run)


def _known(allowed):
    """The rows whose hashed id the bitmap holds."""

    def run(batches):
        seen = allowed.value
        for batch in batches:
            slot = np.asarray(batch.column("slot"), np.int64)
            rows = np.flatnonzero((seen[slot >> 6] >> (slot & 63)) & 1)
            if len(rows):
                for part in t.pieces(batch.take(pa.array(rows)), limit=PIECE):
                    yield part.select(["id", "text"])

    return t.trimmed(run)


def word_set(text: bytes, size: int) -> set:
    """The distinct runs of ``size`` words of a text, or all its words where it has fewer."""
    words = text.translate(bytes(t.LOWER)).split()
    if len(words) < size:
        return {tuple(words)} if words else set()
    return set(zip(*(words[k:] for k in range(size))))


def _confirm(size: int, percent: int):
    def run(batches):
        last, mine = None, set()
        for batch in batches:
            good, left, right = [], batch.column("left"), batch.column("right")
            for i, a in enumerate(batch.column("a").to_pylist()):
                text = left[i].as_py().encode()
                if (a, text) != last:
                    last, mine = (a, text), word_set(text, size)
                other = word_set(right[i].as_py().encode(), size)
                both = len(mine & other)
                good.append(100 * both >= percent * (len(mine) + len(other) - both))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(good, pa.bool_()))

    return t.trimmed(run)


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80, miss: float = 1e-4) -> DataFrame:
    """Per row of docs (doc_id, text): doc_id, n_shingles, component_id, kept (doc_id is its component's smallest).

    Texts are lower-cased (A-Z) and linked when 100 * intersection >= percent * union of their sets of
    ``size``-word shingles; shorter texts are one shingle, texts without words (null, empty) link with
    nothing.  A doc_id that occurs in several rows is one node and all its rows have its component.  Rows
    with a null doc_id take no part: component_id is null and kept is true.  Other columns are ignored.
    """
    spark = docs.sparkSession
    r, m = bands(percent / 100, miss)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    signed = _session.table(rows.mapInArrow(_sign(size, r, m), SIGNED), "signed")
    full = signed.where("n_shingles > 0 and doc_id is not null")
    classes = _session.table(full.groupBy("s1", "s2", "n_shingles").agg(F.min("doc_id").alias("rep")), "classes")
    member = full.select("doc_id", "n_shingles", "s1", "s2")
    kept = full.join(classes.withColumnRenamed("rep", "doc_id"), ["s1", "s2", "n_shingles", "doc_id"]).dropDuplicates(["doc_id", "s1", "s2"])
    kept = kept.select(F.col("doc_id").alias("id"), F.col("n_shingles").alias("n"), "s1", "a", "b")

    sides = kept.select("id", "n", "s1", F.posexplode(F.concat("a", "b")).alias("k", "v"))
    sides = sides.select("id", "n", "s1", F.expr(f"k >= {m}").alias("second"), F.xxhash64("k", "v").alias("h"))
    shared = sides.groupBy("h").agg(F.count("*").alias("c")).where("c > 1").select("h")
    both = sides.join(shared, "h").groupBy("id", "n", "s1").agg(F.collect_set(F.expr("if(second, null, h)")).alias("xs"), F.collect_set(F.expr("if(second, h, null)")).alias("ys"))
    both = _session.table(both.where("size(xs) > 0 and size(ys) > 0").drop("s1"), "hashes")
    keys = both.select("id", "n", F.explode("xs").alias("x"), "ys").select("id", "n", "x", F.explode("ys").alias("y"))
    keys = keys.select("id", "n", "x", F.xxhash64("x", "y").alias("key"))
    low = keys.groupBy("key").agg(F.min(F.struct("id", "n")).alias("low"), F.count("*").alias("c")).where("c > 1")
    # the smallest partner over all keys of a hash a_i: at most m of them a text, whatever the size of its group
    keys = keys.join(low, "key").groupBy("id", "n", "x").agg(F.min("low").alias("low")).select("id", "n", F.col("low.id").alias("a"), F.col("low.n").alias("an")).distinct()
    keys = _session.table(keys, "keys")

    near = f"100 * least(n, an) >= {percent} * greatest(n, an)"
    alike = f"{' + '.join(f'bit_count(sketch[{i}] ^ o_sketch[{i}])' for i in range(QUICK))} <= {sketch_limit(percent / 100, 16 * QUICK)}"
    alike += f" and aggregate(zip_with(sketch, o_sketch, (p, q) -> bit_count(p ^ q)), 0, (s, v) -> s + v) <= {sketch_limit(percent / 100, 16 * SKETCH)}"
    texts = rows.where("doc_id is not null and text is not null").select(F.col("doc_id").alias("id"), "text")
    wanted = keys.select("id").distinct()

    def reading(ids: DataFrame):
        """(a bitmap of ids, broadcast; texts with the place of their id in it)."""
        allowed = spark.sparkContext.broadcast(_session.id_filter(ids, "id"))
        return allowed, texts.withColumn("slot", F.pmod(F.xxhash64("id"), F.lit(len(allowed.value) * 64)))

    allowed, read = reading(wanted)
    sketches = _session.table(read.mapInArrow(_sketches(size, allowed), "id long, sketch array<long>").join(wanted, "id", "left_semi").distinct(), "sketches")
    stars = keys.where(f"id <> a and {near}").select("a", F.col("id").alias("b")).distinct()
    stars = stars.join(sketches.withColumnRenamed("id", "b"), "b").join(sketches.select(F.col("id").alias("a"), F.col("sketch").alias("o_sketch")), "a")
    stars = _session.table(stars.where(alike).select("a", "b").distinct(), "stars")

    def confirmed(pairs: DataFrame) -> DataFrame:
        some = pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct()
        allowed, read = reading(some)
        held = read.mapInArrow(_known(allowed), "id long, text string").join(some, "id", "left_semi")
        held = _session.table(held.dropDuplicates(["id", "text"]), "texts")
        right, left = held.select(F.col("id").alias("b"), F.col("text").alias("right")), held.select(F.col("id").alias("a"), F.col("text").alias("left"))
        met = pairs.join(right, "b").join(left, "a")
        return met.select("a", "b", "left", "right").mapInArrow(_confirm(size, percent), "a long, b long").distinct()

    copies = member.join(classes, ["s1", "s2", "n_shingles"]).select("doc_id", "rep")
    twice = copies.groupBy("doc_id").agg(F.min("rep").alias("a"), F.max("rep").alias("z")).where("a <> z").select("doc_id", "a")
    split = copies.join(twice, "doc_id").select("a", F.col("rep").alias("b")).where("a <> b")
    links = _session.table(confirmed(stars), "links")
    found = _session.components(links)

    at = both.join(sketches, "id").join(found, "id", "left").withColumn("root", F.coalesce("root", "id")).select("*", F.explode("xs").alias("x"))
    mixed = at.groupBy("x").agg(F.min("root").alias("p"), F.max("root").alias("q")).where("p <> q").select("x")
    counts = at.join(mixed, "x", "left_semi").groupBy("x", "root").agg(F.count("*").alias("c"))
    at = _session.table(at.join(counts, ["x", "root"]), "mixed")
    other = at.select(*[F.col(c).alias(f"o_{c}") for c in ("x", "id", "n", "xs", "ys", "sketch", "root", "c")])
    fits = f"100 * least(n, o_n) >= {percent} * greatest(n, o_n) and {alike} and arrays_overlap(ys, o_ys) and array_min(array_intersect(xs, o_xs)) = x"
    # documents that are alone with their component at this hash meet one by one; larger components by their root
    alone = at.where("c = 1").join(other.where("o_c = 1"), F.expr(f"x = o_x and id < o_id and {fits}")).select("id", "o_id")
    heads = at.where("c > 1").select("x", F.col("root").alias("h_root")).distinct()
    grouped = at.join(heads, "x").where("root <> h_root and (c = 1 or root < h_root)").join(other.where("o_c > 1"), F.expr(f"x = o_x and h_root = o_root and {fits}")).select("id", "o_id")
    cross = alone.union(grouped).select(F.least("id", "o_id").alias("a"), F.greatest("id", "o_id").alias("b")).distinct()
    cross = _session.table(cross.join(stars, ["a", "b"], "left_anti"), "cross")
    more = confirmed(cross)
    found = _session.table(_session.components(links.union(more).union(split)), "components")

    rest = member.join(classes, ["s1", "s2", "n_shingles"]).join(found.select(F.col("id").alias("rep"), "root"), "rep", "left")
    rest = rest.select("doc_id", "n_shingles", F.coalesce("root", "rep").alias("component_id"))
    # a doc_id that also has a row without words still belongs to the component of its other rows
    alone = signed.where("n_shingles = 0 and doc_id is not null").select("doc_id", "n_shingles")
    alone = alone.join(rest.groupBy("doc_id").agg(F.min("component_id").alias("component_id")), "doc_id", "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))
    unknown = signed.where("doc_id is null").select("doc_id", "n_shingles", F.lit(None).cast("long").alias("component_id"))
    return rest.union(alone).union(unknown).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
