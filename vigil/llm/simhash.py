"""SimHash near-duplicates, linked by Golay-code fuzzy hashing of fingerprint segments.

A fingerprint of 64 bits is cut into segments of 22, 21 and 21 bits. Two fingerprints that differ in at most two bits
agree exactly in one segment (pigeonhole), and in the next one they differ in at most two. That next segment, padded
with zeros to 23 bits, is decoded by the perfect binary Golay code: its keys are all codewords at distance 4 or less
(one, or six where the nearest codeword is three bits away). Two words at distance 2 have a common neighbour, whose
codeword is within 3 of it and so within 4 of both: they share a key. Rows of the same exact segment and codeword are
candidates and are verified on all 64 bits.

The pipeline's stage (``keep_one``) has parameters of its own: five-word shingles and a Jaccard similarity of 0.8. Its
candidates agree, after decoding, in one of many segments of a wide SimHash and are verified on the shingles themselves.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache, reduce
from itertools import combinations, repeat

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from xxhash import xxh64_intdigest

from vigil.llm.common import saved, skew_join, small_batches
from vigil.llm.components import connected_components

SEED = 42
WIDTHS = (22, 21, 21)
#: Generator polynomial of the binary Golay code of length 23: x^11+x^10+x^6+x^5+x^4+x^2+1 (fixed value).
GENERATOR = 0b110001110101
#: Bits of one rank of shingle hashes that are counted at a time.
CHUNK = 1 << 16
#: Most fingerprints of a bucket that are compared with each other; larger buckets go the way of ``_hot_links``.
BUCKET = 32
#: The pipeline's stage: words of a shingle, least similarity, bits of a fingerprint.
STAGE_WORDS, SIMILAR, WIDE = 5, 0.8, 512
#: Chance to miss a pair of the least similarity, about; nodes that share a bucket by chance; nodes of a large bucket.
MISSED, CHANCE, STAGE_BUCKET = 0.01, 16, 128
#: Nodes of a bucket that is linked through a head first.
DENSE = 64
#: Shingles of a head that nodes of a dense group keep as bits, a multiple of 64; most bits of the whole fingerprint in
#: which dense candidates differ (78 differ at the least similarity, with deviation 8).
HELD, WIDE_APART = 1024, 106
#: Most of the first 128 bits in which candidates differ: 19 differ at the least similarity, with deviation 4.
APART = 40


def fingerprint(text: str | None, size: int = 3) -> int:
    """The SimHash of the word shingles of ``text`` as a signed 64-bit number; zero where there is no word."""
    words = (text or "").encode("utf-8", "replace").lower().split()  # bytes: only ASCII is lowered and split
    if not words:
        return 0
    size = min(size, len(words))
    grams = map(b" ".join, zip(*(words[i:] for i in range(size)), strict=False))
    n = len(words) - size + 1
    h = np.fromiter(map(xxh64_intdigest, grams, repeat(SEED)), dtype="<u8", count=n)
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, n, CHUNK):
        part = h[at : at + CHUNK]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<i8")[0])


@F.pandas_udf(T.LongType())
def fingerprint_udf(texts: pd.Series) -> pd.Series:
    return pd.Series([fingerprint(t) for t in texts], dtype="int64")


@lru_cache(maxsize=1)
def _golay() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Syndromes of the upper and lower bits; by syndrome: the error of least weight, and the five of weight 4."""

    def rest(v: int) -> int:
        for i in range(22, 10, -1):
            if v >> i & 1:
                v ^= GENERATOR << i - 11
        return v

    upper = np.array([rest(v << 12) for v in range(1 << 11)])
    lower = np.array([rest(v) for v in range(1 << 12)])
    leader, fours = np.zeros(1 << 11, dtype=np.int64), np.full((1 << 11, 5), -1, dtype=np.int64)
    unit = [1 << i for i in range(23)]
    for weight in (1, 2, 3):
        for bits in combinations(unit, weight):
            leader[rest(sum(bits))] = sum(bits)
    filled = np.zeros(1 << 11, dtype=np.int64)
    for bits in combinations(unit, 4):
        s = rest(v := sum(bits))
        if bin(leader[s]).count("1") == 3:
            fours[s, filled[s]] = v
            filled[s] += 1
    return upper, lower, leader, fours


def codewords(v: np.ndarray) -> np.ndarray:
    """Indices (12 bits) of the Golay codewords within distance 4 of each 23-bit word; -1 fills the six columns."""
    upper, lower, leader, fours = _golay()
    s = upper[v >> 12] ^ lower[v & 0xFFF]
    errors = np.concatenate([leader[s][:, None], fours[s]], axis=1)
    return np.where(errors >= 0, (v[:, None] ^ errors) >> 11, -1)


def nearest(v: np.ndarray) -> np.ndarray:
    """Index (12 bits) of the one Golay codeword within distance 3 of each 23-bit word."""
    upper, lower, leader, _ = _golay()
    return (v ^ leader[upper[v >> 12] ^ lower[v & 0xFFF]]) >> 11


def fuzzy_keys(fp: np.ndarray) -> np.ndarray:
    """Bucket keys of fingerprints (18 columns, -1 for none): table, exact segment, codeword of the next segment."""
    bits = fp.astype(np.uint64)
    at = np.cumsum((0, *WIDTHS))
    parts = [(bits >> np.uint64(at[i]) & np.uint64((1 << w) - 1)).astype(np.int64) for i, w in enumerate(WIDTHS)]
    out = []
    for i in range(3):
        words = codewords(parts[(i + 1) % 3])
        out.append(np.where(words >= 0, (i << 40) | (parts[i][:, None] << 12) | words, -1))
    return np.concatenate(out, axis=1)


@F.pandas_udf(T.ArrayType(T.LongType()))
def fuzzy_keys_udf(fp: pd.Series) -> pd.Series:
    keys = fuzzy_keys(fp.to_numpy(dtype=np.int64).view(np.uint64)) if len(fp) else np.zeros((0, 18), dtype=np.int64)
    return pd.Series([row[row >= 0] for row in keys])


def _hot_links(hot: DataFrame) -> DataFrame:
    """Links among the fingerprints of large buckets, without pairing them.

    Each fingerprint goes to itself and to its 64 neighbours; two are within distance 2 if and only if they meet.
    At most 65 meet at one place, so the lists are bounded and the rows are 65 times the fingerprints.
    """
    near = F.concat(F.array("fp"), F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.col("fp").bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), i))))
    met = hot.select("fp", F.explode(near).alias("at")).groupBy("at").agg(F.min("fp").alias("a"), F.collect_list("fp").alias("all")).filter(F.size("all") > 1)
    return met.select("a", F.explode("all").alias("b")).filter("a <> b")


def fingerprint_links(fps: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """Links (a, b) that join distinct fingerprints ``fp`` at two or fewer differing bits, directly or through others."""
    keyed = fps.select("fp", F.explode(fuzzy_keys_udf("fp")).alias("key"))
    sizes = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    shared = saved(keyed.join(sizes, "key"), "buckets")
    near = (
        "flatten(transform(all, (x, i) -> transform(filter(slice(all, i + 2, size(all)),"
        " y -> bit_count(x ^ y) <= 2), y -> struct(x as a, y as b))))"
    )
    cold = shared.filter(F.col("n") <= bucket).groupBy("key").agg(F.collect_list("fp").alias("all"))
    pairs = cold.select(F.explode(F.expr(near)).alias("p")).select("p.a", "p.b")
    hot = shared.filter(F.col("n") > bucket).select("fp").distinct()
    return pairs.union(_hot_links(hot)).distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", out: str = "component_id") -> DataFrame:
    """(id, fp, component): the SimHash of every text and the smallest id that links reach.

    Null and empty texts have fingerprint zero and link like others. Equal fingerprints are linked. A null id never is
    a component's name unless no row of the component has one. Repeated rows stay. The result is a table in the
    shared folder joined with one row per fingerprint, so a group of copies never sits in one task.
    """
    prints = saved(docs.select(F.col(id_col).alias("id"), fingerprint_udf(F.col(text_col)).alias("fp")), "prints")
    kinds = saved(prints.groupBy("fp").agg(F.min("id").alias("least")), "kinds")
    roots = connected_components(fingerprint_links(kinds), "a", "b")
    rooted = kinds.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = rooted.groupBy("root").agg(F.min("least").alias(out))
    named = rooted.join(least, "root").select("fp", out)
    return prints.join(named, "fp").select(F.col("id").alias(id_col), "fp", out)


def shingle_set(text: str | None, size: int = STAGE_WORDS) -> np.ndarray:
    """Sorted different hashes of the word shingles of ``text``; one of all words where there are fewer."""
    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return np.zeros(0, dtype="<u8")
    size = min(size, len(words))
    grams = set(map(b" ".join, zip(*(words[i:] for i in range(size)), strict=False)))
    return np.sort(np.fromiter(map(xxh64_intdigest, grams, repeat(SEED)), dtype="<u8", count=len(grams)))


def wide_bits(hashes: np.ndarray) -> np.ndarray:
    """The SimHash of ``WIDE`` bits of a set of shingle hashes, packed in bytes."""
    ones = np.zeros(WIDE, dtype=np.int64)
    factors = np.random.default_rng(SEED).integers(1, 1 << 63, WIDE // 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    for at in range(0, len(hashes), 1024):
        mixed = hashes[at : at + 1024, None] * factors
        mixed ^= mixed >> np.uint64(31)
        mixed *= np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
        ones += np.unpackbits(mixed.view(np.uint8), axis=1, bitorder="little").sum(axis=0, dtype=np.uint32)
    return np.packbits(2 * ones > len(hashes), bitorder="little")


@F.pandas_udf(T.StructType([T.StructField("node", T.LongType()), T.StructField("n", T.LongType()), T.StructField("wide", T.BinaryType())]))
def wide_udf(texts: pd.Series) -> pd.DataFrame:
    sets = [shingle_set(t) for t in texts]
    nodes = [int(np.uint64(xxh64_intdigest(h.tobytes(), SEED)).view(np.int64)) if len(h) else 0 for h in sets]
    return pd.DataFrame({"node": pd.Series(nodes, dtype="int64"), "n": pd.Series([len(h) for h in sets], dtype="int64"), "wide": pd.Series([wide_bits(h).tobytes() for h in sets], dtype=object)})


@F.pandas_udf(T.ArrayType(T.LongType()))
def shingle_set_udf(texts: pd.Series) -> pd.Series:
    return pd.Series([shingle_set(t).view("<i8") for t in texts])


@lru_cache(maxsize=8)
def golay_agreement(p: float) -> float:
    """Part of random words of 23 bits whose nearest codeword stays when every bit flips with probability ``p``."""
    r = np.random.default_rng(SEED)
    words, flips = r.integers(0, 1 << 23, 200_000), (r.random((200_000, 23)) < p) @ (1 << np.arange(23))
    return float((nearest(words) == nearest(words ^ flips)).mean())


def segments(n: int) -> np.ndarray:
    """Bit positions (tables x bits) of the segments for ``n`` fingerprints: buckets of ``CHANCE`` by chance, about.

    The first 23 bits of a row are decoded to a Golay codeword of 12 bits, the rest are compared as they are. There are
    as many rows as leave out a pair of similarity ``SIMILAR`` with probability ``MISSED``: their bits differ with
    probability acos(2J / (1 + J)) / pi, for sets of equal size.
    """
    more = min(12, max(0, math.ceil(math.log2(max(1, n) / CHANCE)) - 12))
    flips = math.acos(2 * SIMILAR / (1 + SIMILAR)) / math.pi
    agree = golay_agreement(flips) * (1 - flips) ** more
    r = np.random.default_rng(SEED)
    return np.stack([r.choice(WIDE, 23 + more, replace=False) for _ in range(math.ceil(math.log(MISSED) / math.log(1 - agree)))])


def _segment_keys(at: np.ndarray):
    """The keys of all segments and the first two words of a wide fingerprint."""
    word, rest = np.zeros((WIDE, len(at)), dtype=np.float32), np.zeros((WIDE, len(at)), dtype=np.float32)
    for t, row in enumerate(at):  # sums stay below 2 ** 24, so they are exact
        word[row[:23], t] = 2.0 ** np.arange(23)
        rest[row[23:], t] = 2.0 ** np.arange(len(row) - 23)
    table = np.arange(len(at), dtype=np.int64) << 32

    def values(raw: np.ndarray) -> np.ndarray:
        bits = np.unpackbits(raw, axis=1, bitorder="little").astype(np.float32)
        return table | (bits @ rest).astype(np.int64) << 12 | nearest((bits @ word).astype(np.int64))

    @F.pandas_udf("keys array<long>, f0 long, f1 long")
    def keys(wide: pd.Series) -> pd.DataFrame:
        raw = np.frombuffer(b"".join(wide), dtype=np.uint8).reshape(len(wide), WIDE // 8)
        every = [row for i in range(0, len(raw), 1024) for row in values(raw[i : i + 1024])]
        first = np.ascontiguousarray(raw[:, :16]).view("<i8")
        return pd.DataFrame({"keys": pd.Series(every, dtype=object), "f0": first[:, 0], "f1": first[:, 1]})

    return keys


def _keyed(kinds: DataFrame, at: np.ndarray) -> DataFrame:
    """A row (node, n, f0, f1, other columns but wide, key) for every node with a shingle and every segment."""
    cut = kinds.filter("n > 0").withColumn("_k", _segment_keys(at)("wide"))
    return cut.select(*(c for c in kinds.columns if c != "wide"), "_k.f0", "_k.f1", F.explode("_k.keys").alias("key"))


def _fits(a: str, b: str) -> Column:
    """Whether sizes and first 128 bits of two rows allow ``SIMILAR``."""
    x, y = (lambda c: F.col(f"{a}.{c}")), (lambda c: F.col(f"{b}.{c}"))
    apart = F.bit_count(x("f0").bitwiseXOR(y("f0"))) + F.bit_count(x("f1").bitwiseXOR(y("f1")))
    return (x("n") * SIMILAR <= y("n")) & (y("n") * SIMILAR <= x("n")) & (apart <= APART)


def large_buckets(kinds: DataFrame, at: np.ndarray, least: int | None = None) -> DataFrame:
    """(key, m): buckets of over ``least`` (``DENSE``) nodes."""
    counts = _keyed(kinds.select("node", "n", "wide"), at).groupBy("key").agg(F.count(F.lit(1)).alias("m"))
    return saved(counts.filter(F.col("m") > (least or DENSE)), "large")


def anchor_pairs(kinds: DataFrame, at: np.ndarray, large: DataFrame) -> DataFrame:
    """(node, head): each node of the ``large`` buckets with two heads, those of most nodes.

    A bucket's head is the node nearest to what most of its nodes have in every bit. A dense group so gets a number of
    pairs in proportion to its size, which join most of what can be joined.
    """
    total = kinds.count() * len(at)
    narrow = _keyed(kinds.select("node", "n", "wide"), at).select("key", "node", "n", "f0", "f1")
    rows = saved(skew_join(narrow, large, "key", "m", total), "members")
    most = [reduce(Column.bitwiseOR, (F.shiftleft((2 * F.sum(F.shiftright(f, i).bitwiseAND(F.lit(1))) > F.count(F.lit(1))).cast("long"), i) for i in range(64))) for f in ("f0", "f1")]
    usual = saved(rows.groupBy("key").agg(F.first("m").alias("size"), most[0].alias("u0"), most[1].alias("u1")), "usual")
    apart = F.bit_count(F.col("f0").bitwiseXOR(F.col("u0"))) + F.bit_count(F.col("f1").bitwiseXOR(F.col("u1")))
    entry = F.struct(apart.alias("apart"), "node", "n", "f0", "f1")
    heads = skew_join(rows, usual, "key", "size", total).groupBy("key").agg(F.first("size").alias("size"), F.min(entry).alias("y"))
    met = skew_join(rows, saved(heads, "heads"), "key", "size", total).select(F.struct("node", "n", "f0", "f1").alias("x"), "y")
    met = saved(met.filter(_fits("x", "y")).select(F.col("x.node").alias("node"), F.col("y.node").alias("head")).distinct(), "headed")
    uses = saved(met.groupBy("head").agg(F.count(F.lit(1)).alias("uses")), "uses")
    ranked = skew_join(met, uses, "head", "uses", met.count()).groupBy("node").agg(F.sort_array(F.collect_list(F.struct("uses", "head")), False).alias("heads"))
    return ranked.select("node", F.explode(F.slice("heads", 1, 2)).alias("h")).select("node", "h.head")


@F.pandas_udf(T.ArrayType(T.LongType()))
def _held_udf(head: pd.Series, own: pd.Series) -> pd.Series:
    """Which of the first ``HELD`` shingles of a head's set a node has, as bits of ``HELD`` / 64 numbers."""

    def bits(h: np.ndarray, x: np.ndarray) -> np.ndarray:
        at = np.zeros(HELD, dtype=bool)
        at[: len(h)] = np.isin(h[:HELD], x)[:HELD]
        return np.packbits(at, bitorder="little").view("<i8")

    return pd.Series([bits(h, x) for h, x in zip(head, own, strict=True)])


def _leaders(tried: DataFrame, roots: DataFrame) -> DataFrame:
    """(node, head) for every node of ``tried`` (node, head, linked): of its heads the one with most links, and of the
    heads that links join with that one again the one with most."""
    links = tried.groupBy("head").agg(F.count_if("linked").alias("links")).join(roots.withColumnRenamed("node", "head"), "head", "left")
    heads = saved(links.withColumn("root", F.coalesce("root", "head")), "links")
    leaders = heads.groupBy("root").agg(F.max_by("head", F.struct("links", "head")).alias("leader"))
    named = saved(heads.join(leaders, "root"), "leaders")
    best = tried.select("node", "head").join(named, "head").groupBy("node").agg(F.max_by("leader", F.struct("links", "head")).alias("head"))
    return saved(best, "chosen")


def _references(chosen: DataFrame) -> DataFrame:
    """(node, ref, held, rest, more) for every row of ``chosen`` (node, head, both sets, both): what bounds shared shingles.

    ``held`` are bits of the first shingles of the head that the node has, ``rest`` is how many of the others it has, and
    ``more`` how many shingles it has besides, as far as another node of the head has them too.
    """
    chosen = saved(chosen.withColumn("beside", F.array_except("node_set", "head_set")).withColumn("held", _held_udf("head_set", "node_set")).drop("node_set", "head_set"), "references")
    single = chosen.select("node", "head", F.explode("beside").alias("shingle")).groupBy("head", "shingle").agg(F.count(F.lit(1)).alias("n"), F.min("node").alias("node"))
    single = single.filter("n = 1").groupBy("node").agg(F.count(F.lit(1)).alias("single"))
    counted = F.aggregate("held", F.lit(0), lambda total, x: total + F.bit_count(x))
    more = F.size("beside") - F.coalesce("single", F.lit(0))
    out = chosen.join(single, "node", "left")
    return out.select("node", F.col("head").alias("ref"), "held", (F.col("both") - counted).cast("long").alias("rest"), more.cast("long").alias("more"))


def _met_in_order(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Candidates of different roots among rows (key, node, root, n, f0, f1, ref, rest, more, held) in order of the key."""
    key, node, root, n, f0, f1, ref, rest, more = range(9)

    def fit(x: tuple[np.ndarray, np.ndarray], y: tuple[np.ndarray, np.ndarray], i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Those of the positions i and j of x and y that may be links."""
        (a, wide_a), (b, wide_b) = x, y
        count = lambda u, v: np.bitwise_count(u.view(np.uint64)[i] ^ v.view(np.uint64)[j]).astype(np.int64)
        good = (a[root][i] != b[root][j]) & (count(a[f0], b[f0]) + count(a[f1], b[f1]) <= APART)
        good &= (a[n][i] * SIMILAR <= b[n][j]) & (b[n][j] * SIMILAR <= a[n][i])
        i, j = i[good], j[good]
        shared = (a[ref][i] != 0) & (b[ref][j] != 0)
        far = np.zeros(len(i), dtype=bool)
        k, m = i[shared], j[shared]
        bits = lambda op, part: np.bitwise_count(op(wide_a[k, part].view(np.uint64), wide_b[m, part].view(np.uint64))).sum(axis=1, dtype=np.int64)
        far[shared] = bits(np.bitwise_xor, slice(HELD // 64, None)) > WIDE_APART
        both = bits(np.bitwise_and, slice(HELD // 64)) + np.minimum(a[rest][k], b[rest][m]) + np.minimum(a[more][k], b[more][m])
        far[shared] |= (a[ref][k] == b[ref][m]) & (both < SIMILAR * (a[n][k] + b[n][m] - both) - 1e-9)
        return a[node][i[~far]], b[node][j[~far]]

    def pairs(x: tuple[np.ndarray, np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        keys = x[0][key]
        starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        sizes = np.diff(np.append(starts, len(keys)))
        for at, size in zip(starts[sizes > STAGE_BUCKET], sizes[sizes > STAGE_BUCKET], strict=True):
            group = x[0][:, at : at + size], x[1][at : at + size]
            _, of, count = np.unique(group[0][root], return_inverse=True, return_counts=True)
            every = np.arange(size)
            for k in np.flatnonzero(of != count.argmax()):  # two rows of the most frequent root need no comparison
                yield fit(group, group, np.full(size, k), every)
        alive = np.flatnonzero(np.repeat(sizes <= STAGE_BUCKET, sizes))
        end, d = np.repeat(starts + sizes, sizes), 1
        while len(alive := alive[alive + d < end[alive]]):
            yield fit(x, x, alive, alive + d)
            d += 1

    def found(held: list[tuple[np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        for a, b in pairs((np.concatenate([h[0] for h in held], axis=1), np.concatenate([h[1] for h in held]))):
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])

    held: list[tuple[np.ndarray, np.ndarray]] = []  # rows of the last key so far
    for batch in batches:
        if not batch.num_rows:
            continue
        *columns, lists = batch.columns
        x = np.stack([c.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64) for c in columns])
        wide = np.zeros((batch.num_rows, (HELD + WIDE) // 64), dtype=np.int64)
        wide[lists.is_valid().to_numpy(zero_copy_only=False)] = lists.flatten().to_numpy(zero_copy_only=False).reshape(-1, wide.shape[1])
        last = int(np.searchsorted(x[key], x[key][-1]))
        if last or (held and held[0][0][key][0] != x[key][0]):
            yield from found([*held, (x[:, :last], wide[:last])])
            held = []
        held.append((x[:, last:], wide[last:]))
    if held:
        yield from found(held)


def _may_link(a: str, b: str) -> Column:
    """``_fits``, and for dense nodes the whole fingerprint and what the shared head says, as in ``_met_in_order``."""
    x, y = (lambda c: F.col(f"{a}.{c}")), (lambda c: F.col(f"{b}.{c}"))
    words = HELD // 64

    def bits(op: str, start: int, size: int) -> Column:
        each = F.zip_with(F.slice(x("held"), start + 1, size), F.slice(y("held"), start + 1, size), lambda p, q: F.bit_count(getattr(p, op)(q)))
        return F.aggregate(each, F.lit(0), lambda total, v: total + v)

    both = bits("bitwiseAND", 0, words) + F.least(x("rest"), y("rest")) + F.least(x("more"), y("more"))
    far = (bits("bitwiseXOR", words, WIDE // 64) > WIDE_APART) | ((x("ref") == y("ref")) & (both < SIMILAR * (x("n") + y("n") - both) - 1e-9))
    return (x("root") != y("root")) & _fits(a, b) & ~F.coalesce(far, F.lit(False))


def similar_pairs(kinds: DataFrame, at: np.ndarray, large: DataFrame, hot: int | None = None) -> DataFrame:
    """Candidate pairs (a, b) of ``kinds`` (node, root, n, wide, ref, rest, more, held) of different roots, without repeats.

    Nodes of one bucket are candidates unless sizes or first 128 bits speak against ``SIMILAR`` (``_fits``), or, where both
    have a head, all bits of the fingerprint do, or shingles shared with the same head exclude it. Buckets of over
    ``hot`` nodes (by default 4096 and a thousandth of all; so there are at most 1000 of each segment) are dealt to parts:
    there the nodes that are not of the most frequent root meet all nodes. Smaller ones are met in order of the key.
    ``large`` are buckets with their sizes, no larger one left out.
    """
    hot = hot or max(4096, kinds.count() // 1000)
    columns = ["node", "root", "n", "f0", "f1", "ref", "rest", "more", "held"]
    whole = F.when(F.col("ref").isNotNull(), F.concat("held", _words_udf("wide")))
    keyed = _keyed(kinds.withColumn("held", whole), at).select("key", *columns)
    large = large.filter(F.col("m") > hot)
    cold = keyed.join(F.broadcast(large), "key", "left_anti").repartition("key").sortWithinPartitions("key")
    pairs = cold.mapInArrow(_met_in_order, "a long, b long")
    if large.head(1):
        rows = saved(keyed.join(F.broadcast(large), "key"), "hot")
        most = rows.groupBy("key", "root").count().groupBy("key").agg(F.max_by("root", F.struct("count", "root")).alias("most"))
        few = rows.join(F.broadcast(saved(most, "most")), "key").filter("root <> most")
        parts = F.ceil(F.col("m") / hot).cast("int")
        every = rows.select("key", F.pmod(F.xxhash64("node"), parts).cast("int").alias("part"), F.struct(*columns).alias("x"))
        few = few.select("key", F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"), F.struct(*columns).alias("y"))
        met = every.join(few.hint("merge"), (every["key"] == few["key"]) & (every["part"] == few["part"]) & _may_link("x", "y"))
        pairs = pairs.union(met.select(F.col("x.node").alias("a"), F.col("y.node").alias("b")))
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


@F.pandas_udf(T.ArrayType(T.LongType()))
def _words_udf(wide: pd.Series) -> pd.Series:
    return pd.Series([np.frombuffer(w, dtype="<i8") for w in wide])


def _with_sets(pairs: DataFrame, one: str, two: str, rows: DataFrame, kinds: DataFrame) -> DataFrame:
    """``pairs`` with the shingle sets of both nodes, and ``both``, how many they share."""
    uses = saved(pairs.select(F.explode(F.array(one, two)).alias("node")).groupBy("node").agg(F.count(F.lit(1)).alias("uses")), "uses")
    some = kinds.select("node", "row").join(uses, "node")
    texts = rows.select("row", "text").join(some.select("node", "row", "uses"), "row").dropDuplicates(["node"])
    sets = saved(texts.select("node", "uses", shingle_set_udf("text").alias("set")), "sets")
    total, out = 2 * pairs.count(), pairs
    for x in (one, two):
        out = skew_join(out, sets.select(F.col("node").alias(x), "uses", F.col("set").alias(f"{x}_set")), x, "uses", total).drop("uses")
    return out.withColumn("both", F.size(F.array_intersect(f"{one}_set", f"{two}_set")))


def _similar(one: str, two: str) -> Column:
    return F.col("both") >= SIMILAR * (F.size(f"{one}_set") + F.size(f"{two}_set") - F.col("both")) - 1e-9


def similar_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(row, root) for every row of ``docs``: row is (no_id, id, mark), the id and hash of its text.

    Texts of shingle Jaccard ``SIMILAR`` or more have the same root. Candidates come from Golay-coded segments of a
    SimHash of ``WIDE`` bits and are verified on their shingle sets: first those with the heads of large buckets, then
    those that the first links leave apart and a common head does not exclude. Texts of equal sets (all without a word, too) are one node.
    """
    with small_batches(docs.sparkSession):
        rows = docs.select(row_key(F.col(id_col), F.col(text_col)).alias("row"), F.col(text_col).alias("text"))
        prints = saved(rows.select("row", wide_udf("text").alias("w")).select("row", "w.*"), "prints")
        kinds = saved(prints.groupBy("node").agg(F.min("row").alias("row"), F.first("n").alias("n"), F.first("wide").alias("wide")), "kinds")
        at = segments(kinds.count())
        large = large_buckets(kinds, at)
        tried = saved(_with_sets(saved(anchor_pairs(kinds, at, large), "anchored"), "node", "head", rows, kinds).select("node", "head", _similar("node", "head").alias("linked")), "tried")
        first = tried.filter("linked and node <> head").select(F.col("node").alias("a"), F.col("head").alias("b"))
        roots = connected_components(first, "a", "b")
        references = _references(_with_sets(_leaders(tried, roots), "node", "head", rows, kinds))
        rooted = kinds.select("node", "n", "wide").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
        rooted = saved(rooted.join(references, "node", "left"), "rooted")
        second = _with_sets(saved(similar_pairs(rooted, at, large), "candidates"), "a", "b", rows, kinds).filter(_similar("a", "b")).select("a", "b")
        second = saved(second, "verified")
        roots = connected_components(first.union(second), "a", "b")
        named = kinds.select("node").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
        sizes = prints.groupBy("node").agg(F.count(F.lit(1)).alias("copies"))
        named = saved(named.join(sizes, "node"), "named")
        total = prints.count()
    return skew_join(prints.select("row", "node"), named, "node", "copies", total).select("row", "root")


def row_key(id_: Column, text: Column) -> Column:
    """A row's id and the hash of its text; rows without an id come last in order."""
    return F.struct(id_.isNull().alias("no_id"), id_.alias("id"), F.xxhash64(text).alias("mark"))


def similar_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", out: str = "component_id") -> DataFrame:
    """(id, component): the smallest id that links reach (``similar_rows``). Null ids and repeated rows are as in ``near_duplicates``."""
    found = saved(similar_rows(docs, id_col, text_col), "similar")
    least = saved(found.groupBy("root").agg(F.min("row.id").alias(out), F.count(F.lit(1)).alias("n")), "least")
    return skew_join(found, least, "root", "n", found.count()).select(F.col("row.id").alias(id_col), out)


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One document of each group of similar texts (``similar_rows``): the one with the smallest id, one without an id if all are.

    Documents are told apart by id and text: different texts under one id are different documents, of rows with equal
    id and text any one stays. Columns are those of ``docs``.
    """
    best = similar_rows(docs, id_col, text_col).groupBy("root").agg(F.min("row").alias("_row")).select("_row")
    own = docs.withColumnsRenamed({c: f"in_{c}" for c in docs.columns})
    keyed = own.withColumn("_row", row_key(F.col(f"in_{id_col}"), F.col(f"in_{text_col}")))
    kept = keyed.join(saved(best, "kept"), "_row", "left_semi").dropDuplicates(["_row"])
    return kept.select(*(F.col(f"in_{c}").alias(c) for c in docs.columns))
