"""Language-model scores: an interpolated modified Kneser-Ney n-gram model, counted on Spark and mapped by its workers.

Counting goes from the longest n-grams down. Tasks count the n-grams of about two million tokens at a time and deal the
counts to shards by a hash; a shard sums what all tasks sent for its n-grams, writes them as arrays sorted by hash into
the shared folder, and sends two kinds of counts to the next shorter length: how many different words stand before an
n-gram's rest (which is what shorter n-grams are counted by), and how many words, and how often, follow its context.
Scoring tasks map the arrays of all shards into memory and look the hashes of a text's n-grams up by bisection.

Words and n-grams are told apart by 64-bit hashes. A shard has a stated number of rows whatever the size of the corpus,
n-grams are dealt by the hash of all their words, so no word, however frequent, makes a shard larger, and nothing but
one row a shard goes to the driver.
"""

from __future__ import annotations

import functools
import os
import uuid
import zlib
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from urllib.parse import urlsplit

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vigil.llm.common import shared_dir

#: Words of an n-gram.
ORDER = 2
#: Tokens counted, and tokens scored, at a time; rows of a shard, about; characters of a text split at a time; words remembered by a task.
CHUNK, SCORED, SHARD, PIECE, WORDS = 1 << 21, 1 << 20, 1 << 22, 1 << 20, 1 << 18
#: Discounts of counts 1, 2 and 3 or more, where the counts of counts allow no estimate.
DISCOUNTS = (0.5, 1.0, 1.5)
#: Numbers of the start and the end of a text: hashes of what no word can be.
START, END = np.uint64(xxhash.xxh64_intdigest(b" ")), np.uint64(xxhash.xxh64_intdigest(b"\n"))
#: What a shard keeps of an n-gram: its adjusted count, its plain count, and as a context the adjusted counts of what
#: follows, summed, and how many of these are 1, 2, 3 or more.
VALUES = ("adjusted", "plain", "total", "ones", "twos", "more")
PACKED = "shard int, n long, words binary, places binary, counts binary"


class _Hashes(dict):
    """Word -> hash; forgets all words when there are too many."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= WORDS:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h


def _pieces(text: bytes) -> Iterator[bytes]:
    """A long text cut at white space."""
    at = 0
    while len(text) - at > PIECE:
        to = at + PIECE
        while to < len(text) and text[to] not in b" \t\n\v\f\r":
            to += 1
        yield text[at:to]
        at = to
    yield text[at:]


def tokens(text: bytes | None, hashes: dict[bytes, int]) -> np.ndarray:
    """Hashes of the words of a text, A-Z lower-cased, and of its end. Null is an empty text."""
    found = []
    for piece in _pieces(text or b""):
        words = piece.lower().split()  # of bytes: ASCII letters and ASCII white space
        found.append(np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words)))
    return np.concatenate([*found, np.array([END])])


def gram_hash(words: Sequence[np.ndarray]) -> np.ndarray:
    """One hash for each n-gram, from the hashes of its first words, second words and so on; that of a single word is its own."""
    h = words[0].copy()
    for w in words[1:]:
        h *= np.uint64(0x9E3779B97F4A7C15)
        h += w
        h ^= h >> np.uint64(32)
        h *= np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(29)
    return h


def _grams(stream: np.ndarray, order: int) -> np.ndarray:
    return np.stack([stream[j : len(stream) - order + 1 + j] for j in range(order)], axis=1)


def _summed(hashes: np.ndarray, words: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of the same hash as one, in order of hashes."""
    by = np.argsort(hashes, kind="stable")
    hashes = hashes[by]
    first = np.flatnonzero(np.concatenate([[True], hashes[1:] != hashes[:-1]])) if len(hashes) else np.zeros(0, np.int64)
    return hashes[first], words[by[first]], np.add.reduceat(counts[by], first, axis=0) if len(first) else counts[:0]


def _least(x: np.ndarray) -> np.ndarray:
    return x.astype(np.min_scalar_type(int(x.max(initial=0))))


def _packed(hashes: np.ndarray, words: np.ndarray, counts: np.ndarray, bits: int) -> Iterator[dict]:
    """Rows in order of hashes as one record for each shard: the different words, their places, and counts, in few bytes."""
    shard = (hashes >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(hashes), np.int64)
    cuts = np.flatnonzero(np.concatenate([[True], shard[1:] != shard[:-1], [True]])) if len(shard) else []
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        if words.shape[1] == 1:  # different already
            held, places = words[a:b, 0], b""
        else:
            held, place = np.unique(words[a:b], return_inverse=True)
            places = _least(place.reshape(-1)).tobytes()
        # most counts are 1 or 0; the hashes do not compress
        yield {"shard": int(shard[a]), "n": int(b - a), "words": held.tobytes(), "places": places, "counts": zlib.compress(_least(counts[a:b].T).tobytes(), 1)}


def _unpacked(n: int, words: bytes, places: bytes, counts: bytes, order: int, values: int) -> tuple[np.ndarray, np.ndarray]:
    read = lambda b, m: np.frombuffer(b, f"u{len(b) // (n * m)}")
    held, column_by_column = np.frombuffer(words, np.uint64), zlib.decompress(counts)
    grams = held[:, None] if order == 1 else held[read(places, order).reshape(n, order).astype(np.int64)]
    return grams, read(column_by_column, values).reshape(values, n).T.astype(np.int64)


def _record(rows: list[dict]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(rows, pa.schema([("shard", pa.int32()), ("n", pa.int64()), ("words", pa.binary()), ("places", pa.binary()), ("counts", pa.binary())]))


def _counts_of_texts(batches: Iterator[pa.RecordBatch], order: int, bits: int) -> Iterator[pa.RecordBatch]:
    """Packed counts of the n-grams of texts (one column, binary)."""
    hashes: dict[bytes, int] = _Hashes()
    start, held, size = np.full(order - 1, START), [], 0

    def flush() -> pa.RecordBatch:
        stream = np.concatenate([x for t in held for x in (start, t)])
        held.clear()
        h = gram_hash([stream[j : len(stream) - order + 1 + j] for j in range(order)])
        real = np.flatnonzero(stream[order - 1 :] != START)  # an n-gram ends with a token
        h, first, n = np.unique(h[real], return_index=True, return_counts=True)
        first = real[first]
        grams = np.stack([stream[first + j] for j in range(order)], axis=1)
        return _record(list(_packed(h, grams, n[:, None], bits)))

    for batch in batches:
        for text in batch.column(0):
            held.append(tokens(text.as_py(), hashes))
            size += len(held[-1])
            if size >= CHUNK:
                yield flush()
                size = 0
    if held:
        yield flush()


def _write(folder: str, order: int, shard: int, arrays: dict[str, np.ndarray]) -> None:
    """Arrays as files in the shared folder; a repeated task puts the same files in their place."""
    for name, x in arrays.items():
        part = f"{folder}/{order}-{shard}-{name}-{uuid.uuid4().hex}.part"
        with open(part, "wb") as f:
            np.save(f, x)
        os.replace(part, f"{folder}/{order}-{shard}-{name}.npy")


def _summing(*of: object) -> Callable[[tuple, pa.Table], pa.Table]:
    return lambda key, table: _sum_shard(key[0].as_py(), table, *of)


def _sum_shard(shard: int, table: pa.Table, order: int, values: int, bits: int, folder: str) -> pa.Table:
    """Sum a shard's packed counts, write its arrays, and pack what goes to the next shorter length.

    One more array has numbers for the driver: rows, counts of counts 1 to 4 and of 3 or more, sums of adjusted and plain
    counts. Single words send nothing on but an empty record.
    """
    parts = [_unpacked(*(table.column(c)[i].as_py() for c in ("n", "words", "places", "counts")), order, values) for i in range(table.num_rows)]
    words, counts = (np.concatenate(x) for x in zip(*parts, strict=True))
    hashes, words, counts = _summed(gram_hash(words.T), words, counts)
    if values == 1:  # the longest: counted as they are, and no context of any
        adjusted, plain = counts[:, 0], counts[:, 0]
        arrays = {"hash": hashes, "adjusted": _least(adjusted)}
    else:
        adjusted, plain = counts[:, 0], counts[:, 1]
        arrays = {"hash": hashes} | {n: _least(counts[:, k]) for k, n in enumerate(VALUES) if n != "plain"}
    if order == 1:
        arrays["plain"] = _least(plain)
    seen = np.bincount(np.minimum(adjusted, 5), minlength=6)
    arrays["told"] = np.array([(adjusted > 0).sum(), *seen[1:5], seen[3:].sum(), adjusted.sum(), plain.sum()], np.int64)
    _write(folder, order, shard, arrays)
    out = [] if order > 1 else [{"shard": shard, "n": len(hashes), "words": b"", "places": b"", "counts": b""}]
    if order > 1:
        real = adjusted > 0
        words, adjusted, plain = words[real], adjusted[real], plain[real]
        before = np.where(words[:, 1] == START, adjusted, 1)  # nothing but starts stand before a start
        after = np.minimum(adjusted, 3)[:, None] == np.arange(1, 4)
        # each kind is summed first, so that the two together are few rows
        kinds = ((words[:, 1:], (before, plain), 0), (words[:, :-1], (adjusted, *after.T), 2))
        held = []
        for shorter, values_, at in kinds:
            h, w, c = _summed(gram_hash(shorter.T), shorter, np.stack(values_, axis=1).astype(np.int64))
            full = np.zeros((len(h), len(VALUES)), np.int64)
            full[:, at : at + c.shape[1]] = c
            held.append((h, w, full))
        out += _packed(*_summed(*(np.concatenate(x) for x in zip(*held, strict=True))), bits)
    return pa.Table.from_batches([_record(out)])


@dataclass(frozen=True)
class Model:
    """A counted model: where its arrays are and what the driver knows of it."""

    folder: str
    order: int
    bits: int
    #: Discounts of counts 1, 2 and 3 or more, by length.
    discounts: tuple[tuple[float, float, float], ...]
    #: Training tokens, different ones among them, sum of adjusted counts of single words, weight of what was never seen.
    tokens: int
    words: int
    total: int
    unseen: float


def _discounts(n1: int, n2: int, n3: int, n4: int) -> tuple[float, float, float]:
    """Those of modified Kneser-Ney; where counts of counts are missing or give values out of range, ``DISCOUNTS``."""
    if not (n1 and n2 and n3):
        return DISCOUNTS
    y = n1 / (n1 + 2 * n2)
    found = (1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3)
    return found if all(0 < d <= k for d, k in zip(found, (1, 2, 3), strict=True)) else DISCOUNTS


def shared_path(spark: SparkSession) -> str:
    """The shared folder as a path that workers can map files of: a mounted one, by path or file:."""
    place = urlsplit(shared_dir(spark))
    if place.scheme not in ("", "file"):
        raise ValueError(f"arrays are mapped from files: mount the shared folder on all machines, not {place.scheme}:")
    return place.path


def count(texts: DataFrame, order: int = ORDER) -> Model:
    """Count a model on the one column of ``texts``. Null and empty texts have one token, their end."""
    if order < 1:
        raise ValueError("an n-gram has a word at least")
    spark = texts.sparkSession
    folder = f"{shared_path(spark)}/lm-{uuid.uuid4().hex}"
    os.makedirs(folder)
    texts = texts.select(F.col(texts.columns[0]).cast("binary"))
    size = texts.agg(F.sum(F.octet_length(F.col(texts.columns[0])))).first()[0] or 0
    bits = max(0, (size // 5 // SHARD).bit_length())  # a token is of five or six bytes in most texts
    rows = texts.mapInArrow(lambda b: _counts_of_texts(b, order, bits), PACKED)
    for k in range(order, 0, -1):
        summing = _summing(k, 1 if k == order else len(VALUES), bits, folder)
        rows = rows.repartition(1 << bits, "shard").groupBy("shard").applyInArrow(summing, PACKED)
    rows.agg(F.sum("n")).first()  # one job for all lengths; what it leaves are the arrays
    told = [_told(folder, k, bits) for k in range(1, order + 1)]
    discounts = tuple(_discounts(*(int(n) for n in t[1:5])) for t in told)
    kept, n1, n2, _, _, more, adjusted, plain = (int(x) for x in told[0])
    held_back = float(np.dot(discounts[0], (n1, n2, more)))
    return Model(folder, order, bits, discounts, plain, kept, adjusted, held_back / adjusted if adjusted else 1.0)


def _told(folder: str, order: int, bits: int) -> np.ndarray:
    """Sums of the eight numbers that each shard has told; a shard without rows has told nothing."""
    paths = (f"{folder}/{order}-{shard}-told.npy" for shard in range(1 << bits))
    return np.sum([np.zeros(8, np.int64), *(np.load(p) for p in paths if os.path.exists(p))], axis=0)


@functools.lru_cache(maxsize=1 << 14)
def _mapped(path: str) -> np.ndarray | None:
    return np.load(path, mmap_mode="r") if os.path.exists(path) else None


class Lookup:
    """The arrays of a model, mapped by this worker: only pages that are looked at are read."""

    def __init__(self, model: Model) -> None:
        self.model = model

    def find(self, grams: np.ndarray, names: tuple[str, ...]) -> list[np.ndarray]:
        """Of each row of word hashes the named values; zero where the model lacks it."""
        m, order = self.model, grams.shape[1]
        asked, back = np.unique(gram_hash(grams.T), return_inverse=True)
        out = [np.zeros(len(asked), np.int64) for _ in names]
        bounds = np.searchsorted(asked, np.arange(1 << m.bits, dtype=np.uint64) << np.uint64(64 - m.bits)) if m.bits else np.zeros(1, np.int64)
        for shard, (a, b) in enumerate(zip(bounds, [*bounds[1:], len(asked)], strict=True)):
            hashes = _mapped(f"{m.folder}/{order}-{shard}-hash.npy") if b > a else None
            if hashes is None or not len(hashes):
                continue
            at = np.minimum(np.searchsorted(hashes, asked[a:b]), len(hashes) - 1)
            hit = hashes[at] == asked[a:b]
            for x, n in zip(out, names, strict=True):
                x[a:b][hit] = _mapped(f"{m.folder}/{order}-{shard}-{n}.npy")[at[hit]]
        return [x[back] for x in out]

    def probabilities(self, stream: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(probability, plain count) of each token after the first ``order - 1`` of the stream."""
        m = self.model
        last = m.order - 1
        adjusted, plain = self.find(stream[last:, None], ("adjusted", "plain"))
        p = self._discounted(adjusted, 1) / max(m.total, 1) + m.unseen / (m.words + 1)
        for k in range(2, m.order + 1):
            grams = _grams(stream[m.order - k :], k)
            (adjusted,) = self.find(grams, ("adjusted",))
            total, *after = self.find(grams[:, :-1], ("total", "ones", "twos", "more"))
            held_back = sum(d * n for d, n in zip(m.discounts[k - 1], after, strict=True))
            p = np.where(total > 0, (self._discounted(adjusted, k) + held_back * p) / np.maximum(total, 1), p)
        return p, plain

    def _discounted(self, adjusted: np.ndarray, k: int) -> np.ndarray:
        return np.maximum(adjusted - np.array((0.0, *self.model.discounts[k - 1]))[np.minimum(adjusted, 3)], 0)


def score(rows: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """Add n_tokens, n_known, base_score and score to ``rows``, which lose their text.

    Scores are log10 probabilities of the whole text and its end: ``score`` of the model, ``base_score`` of single
    tokens with one added to each count. The perplexity of a text is 10^(-score / n_tokens).
    """
    keep = [c for c in rows.columns if c != text_col]

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        look, hashes = Lookup(model), _Hashes()
        start = np.full(model.order - 1, START)
        one = np.log10(model.tokens + model.words + 1)

        def sums(held: list[np.ndarray]) -> np.ndarray:
            """Every text's sums; a text follows the starts of its own, which do not count."""
            stream = np.concatenate([x for t in held for x in (start, t)])
            p, plain = look.probabilities(np.concatenate([start, stream]))
            real = stream != START
            each = np.stack([plain > 0, np.log10(plain + 1.0) - one, np.log10(p)], axis=1)[real]
            return np.add.reduceat(each, np.cumsum([0, *(len(t) for t in held[:-1])]), axis=0)

        for batch in batches:
            held, size, found, lengths = [], 0, [], []
            for text in batch.column(len(keep)):
                held.append(tokens(text.as_py(), hashes))
                lengths.append(len(held[-1]))
                size += lengths[-1]
                if size >= SCORED:
                    found.append(sums(held))
                    held, size = [], 0
            if held:
                found.append(sums(held))
            x = np.concatenate(found) if found else np.zeros((0, 3))
            new = [pa.array(lengths, pa.int64()), pa.array(x[:, 0].astype(np.int64)), pa.array(x[:, 1]), pa.array(x[:, 2])]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], *new], names=[*keep, "n_tokens", "n_known", "base_score", "score"])

    kind = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in keep)
    return rows.select(*keep, F.col(text_col).cast("binary")).mapInArrow(scored, f"{kind}, n_tokens long, n_known long, base_score double, score double")


def score_held_out(docs: DataFrame, order: int = ORDER, parts: int = 7, out: int = 2) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row of ``docs``.

    Held out of counting are rows whose crc32(doc_id as text) mod ``parts`` is ``out``; rows without an id are counted.
    Repeated rows count, and are scored, one by one. Without training tokens every probability is 1.
    """
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % parts == out, F.lit(False))
    rows = docs.select("doc_id", held.alias("held_out"), "text")
    model = count(rows.filter(~F.col("held_out")).select("text"), order)
    found = score(rows, model).withColumn("train_tokens", F.lit(model.tokens).cast("long"))
    return found.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")
