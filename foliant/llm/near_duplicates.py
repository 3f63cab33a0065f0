"""Problem 5: near-duplicate records by HyperMinHash.

A record's shingles are hashed into ``FAMILIES`` sketches of ``BUCKETS``
buckets; a bucket keeps, of its smallest hash value, the number of leading
zeros and ``MANTISSA`` further bits (16 bits in all).  Empty buckets borrow
the register of a bucket drawn by a fixed hash, which keeps the chance of
agreement at the Jaccard similarity also for short records.  Then

1. records with the same shingle set fall into one class (first 64 bits of a
   cryptographic hash of the sorted set); all later steps see one row a class,
   so a group of copies of any size is one row;
2. classes that agree in all ``ROWS`` registers of at least ``least_bands``
   bands are candidates.  Pairs are formed inside a band's bucket only where
   it has at most ``block`` classes.  Larger buckets are cut into blocks and
   every pair of blocks is compared in its own task by the registers, which
   emits only pairs that pass.  Buckets above ``huge`` classes (boilerplate)
   are banded again: a candidate needs a second band anyway, so their classes
   meet by pairs of bands, which are smaller by the chance of a band;
3. the share of agreeing registers, less the expected number of accidental
   agreements at the two cardinalities, estimates the similarity; candidates
   well below the threshold end here;
4. the rest is verified on the shingles themselves.

Sizes of buckets come from one window over the bands.  Bands that hold a
thousandth of all classes or more, as a sample of the classes shows, do not
go through it: they are counted by an aggregation that combines in each task,
and the counts are joined to them; the sample decides on the way only.

At similarity 0.5 a pair agrees in a band with chance 1/16; of 96 bands at
least two agree with chance 0.985, at 0.6 with chance 0.9999.

Defined results: records without a shingle (null, blank, fewer than
``words`` words) resemble nothing; repeated rows count once; a record id that
occurs with several contents has the pairs of each; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foliant.functions.batches import spread
from foliant.session import materialize

FAMILIES, BUCKETS, MANTISSA, ROWS = 6, 64, 10, 4
REGISTERS = FAMILIES * BUCKETS
BANDS = REGISTERS // ROWS
WORD = re.compile(r"[^\W_]+")
_MASK = (1 << 64) - 1


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_SEEDS = mix(np.arange(1, FAMILIES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_DRAWS = (mix(np.arange(BUCKETS * BUCKETS, dtype=np.uint64) + np.uint64(77)) % np.uint64(BUCKETS)).astype(np.int64).reshape(BUCKETS, BUCKETS)


class Shingler:
    """Distinct shingle hashes of texts; word hashes are kept between calls."""

    def __init__(self, words: int):
        self.words, self.known = words, {}

    def word_hashes(self, text: str) -> list[int]:
        known, out = self.known, []
        for w in WORD.findall(unicodedata.normalize("NFC", text).lower()):
            h = known.get(w)
            if h is None:
                if len(known) > 500_000:
                    known.clear()
                h = known[w] = int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "little")
            out.append(h)
        return out

    def __call__(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """``(owner, hash)`` sorted, each hash once for its owner."""
        hashes, lengths = [], []
        for t in texts:
            h = self.word_hashes(t) if t else []
            hashes.extend(h)
            lengths.append(len(h))
        x = np.array(hashes, dtype=np.uint64)
        owner = np.repeat(np.arange(len(texts)), lengths)
        if len(x) < self.words:
            return np.empty(0, np.int64), np.empty(0, np.uint64)
        m = len(x) - self.words + 1
        s = np.zeros(m, np.uint64)
        for k in range(self.words):
            s = mix(s * np.uint64(0x9E3779B97F4A7C15) + x[k : k + m])
        one = owner[:m] == owner[self.words - 1 :]
        owner, s = owner[:m][one], s[one]
        by = np.lexsort((s, owner))
        owner, s = owner[by], s[by]
        new = np.ones(len(s), bool)
        new[1:] = (s[1:] != s[:-1]) | (owner[1:] != owner[:-1])
        return owner[new], s[new]


def registers(owner: np.ndarray, s: np.ndarray, n: int) -> np.ndarray:
    """``n x REGISTERS`` compressed registers (rows without shingles: 0)."""
    out = np.zeros((n, REGISTERS), np.uint16)
    top = np.uint64(_MASK)
    for f in range(FAMILIES):
        g = mix(s ^ _SEEDS[f])
        least = np.full(n * BUCKETS, top)
        np.minimum.at(least, owner * BUCKETS + (g & np.uint64(BUCKETS - 1)).astype(np.int64), g >> np.uint64(6))
        least = least.reshape(n, BUCKETS)
        full = least != top
        frac, exp = np.frexp(least.astype(np.float64))
        reg = ((58 - np.minimum(exp, 58)).astype(np.uint16) << MANTISSA) | ((frac * 2 - 1) * (1 << MANTISSA)).astype(np.uint16)
        reg[~full] = 0
        have = full.copy()
        some = full.any(axis=1)
        for draw in _DRAWS:
            need = ~have & some[:, None]
            if not need.any():
                break
            take = need & full[:, draw]
            reg = np.where(take, reg[:, draw], reg)
            have |= take
        for step in range(1, BUCKETS):
            need = ~have & some[:, None]
            if not need.any():
                break
            take = need & np.roll(full, -step, axis=1)
            reg = np.where(take, np.roll(np.where(full, reg, 0), -step, axis=1), reg)
            have |= take
        out[:, f * BUCKETS : (f + 1) * BUCKETS] = reg
    return out


def accidental(na: np.ndarray, nb: np.ndarray) -> np.ndarray:
    """Chance that different minima of buckets with these cardinalities agree
    in leading zeros and mantissa."""
    zeros = np.arange(40)
    def of(n):  # chance of each number of leading zeros of the minimum
        lam = np.maximum(n, 1)[:, None] / BUCKETS
        return np.exp(-lam * 2.0 ** -(zeros + 1)) - np.exp(-lam * 2.0 ** -zeros)

    pa_, pb = of(na), of(nb)
    return (pa_ * pb).sum(1) / (pa_.sum(1) * pb.sum(1)) / (1 << MANTISSA)


def estimate(ra: np.ndarray, rb: np.ndarray, na: np.ndarray, nb: np.ndarray) -> np.ndarray:
    """Collision-corrected Jaccard similarity of register rows."""
    agree = (ra == rb).mean(axis=1)
    c = accidental(na, nb)
    return np.clip((agree - c) / (1 - c), 0, 1)


def sketches(records: DataFrame, key: str, content: str, words: int) -> DataFrame:
    """``(key, sig, n, regs, text)`` of each record that has a shingle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(words)
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                owner, s = shingler(part.column(1).to_pylist())
                n = part.num_rows
                regs = registers(owner, s, n)
                ends = np.searchsorted(owner, np.arange(n + 1))
                keep = np.flatnonzero(np.diff(ends))
                sigs = [int.from_bytes(hashlib.blake2b(s[ends[i] : ends[i + 1]].tobytes(), digest_size=8).digest(), "little", signed=True) for i in keep]
                some = part.take(pa.array(keep))
                yield pa.RecordBatch.from_arrays(
                    [some.column(0), pa.array(sigs, pa.int64()), pa.array(np.diff(ends)[keep].astype(np.int32)), pa.array([regs[i].tobytes() for i in keep], pa.binary()), some.column(1)],
                    names=[key, "sig", "n", "regs", "text"])

    kind = dict(records.dtypes)[key]
    return spread(records.select(key, content)).mapInArrow(run, f"`{key}` {kind}, sig bigint, n int, regs binary, text string")


def band_keys(classes: DataFrame) -> DataFrame:
    """``(band, sig)``: one row for each band of each class."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                part = batch.slice(at, 2048)
                r = np.frombuffer(b"".join(part.column(1).to_pylist()), np.uint16).reshape(part.num_rows, BANDS, ROWS)
                k = np.zeros((part.num_rows, BANDS), np.uint64)
                for j in range(ROWS):
                    k = (k << np.uint64(16)) | r[:, :, j]
                k = mix(k + np.arange(BANDS, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(k.ravel().view(np.int64)), pa.array(np.repeat(part.column(0).to_numpy(zero_copy_only=False), BANDS))], names=["band", "sig"]
                )

    return classes.select("sig", "regs").mapInArrow(run, "band bigint, sig bigint")


#: Bands taken together before blocks are compared whatever their size.
DEPTH = 2
_SAMPLE, _SHARE = 64, 1_000


def _hot_bands(keyed: DataFrame) -> DataFrame | None:
    """Bands that hold at least about a thousandth of the keys' owners: at
    most ``_SHARE`` times the bands of one owner, a proven bound."""
    some = keyed.where(F.pmod(F.xxhash64("sig"), F.lit(_SAMPLE)) == 0)
    owners = keyed.select("sig").where(F.pmod(F.xxhash64("sig"), F.lit(_SAMPLE)) == 0).agg(F.approx_count_distinct("sig")).collect()[0][0]
    hot = some.groupBy("band").agg(F.count("*").alias("n")).where(F.col("n") >= max(_SAMPLE, owners // _SHARE)).select("band")
    bands = [r.band for r in hot.limit(_SHARE * BANDS * 2).collect()]
    return keyed.sparkSession.createDataFrame([(b,) for b in bands], "band bigint") if bands else None


def _sized(keyed: DataFrame, hot: DataFrame | None) -> DataFrame:
    """Keys with the size of their bucket, those with others in it only."""
    every = F.count("*").over(Window.partitionBy("band"))
    if hot is None:
        return keyed.withColumn("size", every).where("size > 1")
    wide = keyed.join(F.broadcast(hot), "band", "left_semi")
    counts = wide.groupBy("band").agg(F.count("*").alias("size"))
    rest = keyed.join(F.broadcast(hot), "band", "left_anti").withColumn("size", every)
    return rest.where("size > 1").unionByName(wide.join(F.broadcast(counts), "band"))  # as many rows as ``hot``


def candidates(classes: DataFrame, threshold: float, least_bands: int = 2, block: int = 128, huge: int = 16_384) -> DataFrame:
    """Pairs ``(a, b)``, a < b, of classes to be verified."""
    sample = classes.where(F.pmod(F.xxhash64("sig"), F.lit(_SAMPLE)) == 0)
    return _paired(_sized(band_keys(classes), _hot_bands(band_keys(sample))), classes, threshold, least_bands, block, huge, 1)


def _paired(sized: DataFrame, classes: DataFrame, threshold: float, least: int, block: int, huge: int, depth: int) -> DataFrame:
    shared = materialize(sized, "bands")
    # small buckets: all pairs of at most `block` classes
    lists = shared.where(F.col("size") <= block).groupBy("band").agg(F.sort_array(F.collect_list("sig")).alias("s"))
    tails = F.transform("s", lambda x, i: F.struct(x.alias("a"), F.slice(F.col("s"), i + 2, F.size("s")).alias("bs")))
    pairs = lists.select(F.explode(tails).alias("t")).select(F.col("t.a").alias("a"), F.explode("t.bs").alias("b"))
    often = pairs.groupBy("a", "b").agg(F.count("*").alias("n")).where(F.col("n") >= least).select("a", "b")
    largest = shared.agg(F.max("size")).collect()[0][0] or 0
    if largest <= block:
        return often
    # large buckets: pairs of blocks, compared by their registers
    wide = F.col("size") > huge
    large = shared.where((F.col("size") > block) & (F.lit(depth == DEPTH) | ~wide))
    blocks = F.ceil(F.col("size") / block).cast("int")
    large = large.withColumns({"blocks": blocks, "mine": F.pmod(F.xxhash64("sig", "band"), blocks).cast("int")})
    others = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    placed = large.select("band", "sig", "mine", others.alias("other")).select(
        "band", "sig", "mine", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"))
    margin = threshold - 5 * (0.25 / REGISTERS) ** 0.5

    def compare(pdf):
        import pandas as pd

        regs = np.frombuffer(b"".join(pdf["regs"]), np.uint16).reshape(len(pdf), REGISTERS)
        sig, n, mine = (pdf[c].to_numpy() for c in ("sig", "n", "mine"))
        i, j = int(pdf["i"].iloc[0]), int(pdf["j"].iloc[0])
        left, right = np.flatnonzero(mine == i), np.flatnonzero(mine == j)
        a_out, b_out = [], []
        for x in left:
            ys = right[sig[right] > sig[x]] if i == j else right
            if len(ys):
                est = estimate(regs[x][None, :], regs[ys], np.full(len(ys), n[x]), n[ys])
                ys = ys[est >= margin]
                a_out.append(np.minimum(sig[x], sig[ys]))
                b_out.append(np.maximum(sig[x], sig[ys]))
        flat = lambda v: np.concatenate(v) if v else np.empty(0, np.int64)
        return pd.DataFrame({"a": flat(a_out), "b": flat(b_out)})

    met = placed.join(classes.select("sig", "n", "regs"), "sig").groupBy("band", "i", "j").applyInPandas(compare, "a bigint, b bigint")
    found = often.unionByName(met)
    if largest > huge and depth < DEPTH:
        # huge buckets: their classes meet where they share one more band
        first = shared.where(wide).select("sig", F.col("band").alias("_b"))
        again = first.join(shared.select("sig", "band"), "sig").where("_b <> band").select(F.xxhash64(F.least("_b", "band"), F.greatest("_b", "band")).alias("band"), "sig").distinct()
        found = found.unionByName(_paired(_sized(again, _hot_bands(again)), classes, threshold, 1, block, huge, depth + 1))
    return found.distinct()


def verify(pairs: DataFrame, classes: DataFrame, threshold: float, words: int) -> DataFrame:
    """Pairs whose similarity reaches the threshold, with the similarity."""
    margin = threshold - 5 * (0.25 / REGISTERS) ** 0.5
    side = lambda c: classes.select(F.col("sig").alias(c), *(F.col(x).alias(f"{x}_{c}") for x in ("n", "regs", "text")))
    joined = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "n_a", "n_b", "regs_a", "regs_b", "text_a", "text_b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(words)
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                a, b, na, nb = (part.column(c).to_numpy(zero_copy_only=False) for c in range(4))
                grid = lambda c: np.frombuffer(b"".join(part.column(c).to_pylist()), np.uint16).reshape(part.num_rows, REGISTERS)
                near = np.flatnonzero(estimate(grid(4), grid(5), na, nb) >= margin)
                if not len(near):
                    continue
                some = part.take(pa.array(near))
                # shingles of both sides as (pair, hash): those that are there twice are shared
                (po, ps), (qo, qs) = shingler(some.column(6).to_pylist()), shingler(some.column(7).to_pylist())
                owner, s = np.concatenate((po, qo)), np.concatenate((ps, qs))
                by = np.lexsort((s, owner))
                owner, s = owner[by], s[by]
                twice = (owner[1:] == owner[:-1]) & (s[1:] == s[:-1])
                both = np.bincount(owner[1:][twice], minlength=len(near))
                union = na[near] + nb[near] - both
                ok = both >= threshold * union
                yield pa.RecordBatch.from_arrays([pa.array(a[near][ok], pa.int64()), pa.array(b[near][ok], pa.int64()), pa.array(both[ok] / union[ok], pa.float64())], names=["a", "b", "similarity"])

    return joined.mapInArrow(run, "a bigint, b bigint, similarity double")


def near_duplicates(records: DataFrame, key: str = "chunk_id", content: str = "content", words: int = 5, threshold: float = 0.8) -> tuple[DataFrame, DataFrame]:
    """``members (key, sig)`` and ``links (a, b, similarity)`` between classes."""
    made = materialize(sketches(records.select(key, content).where(F.col(content).isNotNull()), key, content, words), "sketches")
    members = made.select(key, "sig").distinct()
    # of equal rows, any one: partial aggregation leaves one a task of a class
    classes = materialize(made.groupBy("sig").agg(*(F.first(c).alias(c) for c in ("n", "regs", "text"))), "classes")
    links = materialize(verify(candidates(classes, threshold), classes, threshold, words), "links")
    return members, links


def pairs_of_records(members: DataFrame, links: DataFrame, key: str) -> DataFrame:
    """All pairs of records, those with the same shingles included."""
    x, y = members.select(F.col(key).alias("x"), F.col("sig").alias("a")), members.select(F.col(key).alias("y"), F.col("sig").alias("b"))
    same = F.col("a") == F.col("b")
    within = x.join(y, same & (F.col("x") < F.col("y"))).select("x", "y")
    across = links.join(x, "a").join(y, "b").where("x <> y").select("x", "y")
    return within.unionByName(across).select(F.least("x", "y").alias("chunk_a"), F.greatest("x", "y").alias("chunk_b")).distinct()


def components(links: DataFrame) -> DataFrame:
    """``(sig, root)``: the smallest class id of each connected component, for
    classes with a link.  Labels move along links and then along labels until
    nothing moves; the rounds grow with the logarithm of the longest chain."""
    edges = materialize(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))), "edges")
    labels = materialize(edges.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("sig"), F.least("a", "m").alias("root")), "labels")
    while True:
        to = labels.select(F.col("sig").alias("b"), F.col("root").alias("other"))
        near = edges.join(to, "b").groupBy(F.col("a").alias("sig")).agg(F.min("other").alias("other"))
        moved = labels.join(near, "sig").select("sig", F.least("root", "other").alias("next"), "root")
        jump = labels.select(F.col("sig").alias("next"), F.col("root").alias("far"))
        after = materialize(moved.join(jump, "next").select("sig", F.least("next", "far").alias("root"), F.col("root").alias("was")), "labels")
        labels = after.select("sig", "root")
        if after.where("root <> was").isEmpty():
            return labels


def groups(members: DataFrame, links: DataFrame, key: str) -> DataFrame:
    """One row a record: its class, its group, and its class's links."""
    degree = links.select(F.explode(F.array("a", "b")).alias("sig")).groupBy("sig").agg(F.count("*").alias("links"))
    return members.join(degree, "sig", "left").join(components(links), "sig", "left").select(
        key, F.col("sig").alias("class_id"), F.coalesce("root", "sig").alias("group_id"), F.coalesce("links", F.lit(0)).alias("links"))
