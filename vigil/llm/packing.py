"""Best-fit packing of tokenised documents into fixed-length sequences by bin completion.

Sizes are whole numbers up to the capacity, so the problem is a histogram of at most ``capacity`` counts, whatever the
number of documents. Fillings of that histogram are found on the driver by branch and bound; Spark then ranks pieces
within each size and joins them with the (bounded) table of places.
"""

from __future__ import annotations

import json
import math
import struct
import zlib
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from vigil.llm.common import position_in_group, saved

CAPACITY = 2048
#: Words whose ids a Python worker remembers at most.
REMEMBERED = 200_000
#: Fillings kept at one node of those found, pairs looked at for them, and nodes of the whole search.
WIDTH, LOOKED, NODES = 6, 60, 4000
#: First solutions that fill bins of large sizes with large sizes: how many dividing sizes are tried, in two rounds.
DIVES = 12
#: Pieces of one size that are ranked in one task, about.
RANKED = 10_000


#: How byte-level BPE splits a text before merging (fixed value).
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def ranked_vocabulary(path: str) -> tiktoken.Encoding | None:
    """The vocabulary of a byte-level BPE file as ranks, if its ids rank as its merges do."""
    with open(path, encoding="utf-8") as f:
        held = json.load(f)
    model, before = held["model"], held.get("pre_tokenizer") or {}
    if model.get("type") != "BPE" or held.get("normalizer") or before.get("type") != "ByteLevel" or before.get("add_prefix_space"):
        return None
    merged = [model["vocab"].get("".join(m.split(" ") if isinstance(m, str) else m)) for m in model["merges"]]
    if merged != sorted(x for x in merged if x is not None):
        return None
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that stand for themselves
    byte_of = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(plain))}
    special = {t["content"] for t in held.get("added_tokens", ())}
    ranks = {bytes(byte_of[c] for c in t): i for t, i in model["vocab"].items() if t not in special}
    return tiktoken.Encoding("file", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})


#: Packers of few ids.
PACKED = [struct.Struct(f"<{n}I").pack for n in range(12)]


class _Joined(Exception):
    """A word cannot be encoded apart from what stands beside it."""


class _Words(dict):
    """Word -> its packed ids, as they are after ``before`` (a space or nothing)."""

    def __init__(self, encoder: Encoder, before: str) -> None:
        super().__init__()
        self.encoder, self.before = encoder, before

    def __missing__(self, word: str) -> bytes:
        if not word or word[0].isspace() or word[-1].isspace():
            raise _Joined
        if "\n" in word:
            first, *rest = word.split("\n")
            return self.encoder.line_break.join([self[first], *(self.encoder.start[x] for x in rest)])
        if word[-1] in ".," and word[:-1].isalpha():  # never joined with the letters before
            return self[word[:-1]] + self.encoder.start[word[-1]]
        if len(self) >= REMEMBERED:
            self.clear()
        out = self[word] = self.encoder.word(self.before + word)
        return out


class Encoder:
    """Ids of a text as packed little-endian numbers, equal to the tokenizer's own, faster on repeated words.

    The pre-tokenizer never joins a word with the one before a single space or line break, so words are encoded one by
    one and remembered. Texts with other runs of white space, or with a special token, go to the tokenizer whole.
    Where ids follow the order of merges, as in byte-level vocabularies of this kind, a new word goes to tiktoken with
    the vocabulary of the same file, which gives the same ids in a tenth of the time; otherwise to the tokenizer.
    """

    def __init__(self, path: str) -> None:
        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.ranks = ranked_vocabulary(path)
        self.start, self.later = _Words(self, ""), _Words(self, " ")
        self.line_break = self.whole("\n")

    def word(self, text: str) -> bytes:
        if self.ranks is None:
            return self.whole(text)
        ids = self.ranks.encode_ordinary(text)
        return PACKED[len(ids)](*ids) if len(ids) < len(PACKED) else struct.pack(f"<{len(ids)}I", *ids)

    def whole(self, text: str) -> bytes:
        ids = self.tokenizer.encode(text, add_special_tokens=False).ids
        return struct.pack(f"<{len(ids)}I", *ids)

    def __call__(self, text: str) -> bytes:
        if not text:
            return b""
        if any(t in text for t in self.special):
            return self.whole(text)
        first, *rest = text.split(" ")
        try:
            return b"".join([self.start[first] if first else b"", *map(self.later.__getitem__, rest)])
        except _Joined:
            return self.whole(text)


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def cuts(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of ``n`` tokens; only the first may be shorter than ``capacity``."""
    first = n if n <= capacity else n % capacity or capacity
    return [(0, first), *((s, capacity) for s in range(first, n, capacity))]


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, end: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, piece, start, length, ids_crc32) of every piece of every document; ``end`` closes each document."""
    closing = struct.pack("<I", end)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of = encoder(path)
        for batch in batches:
            out: list[list[int]] = [[], [], [], [], []]
            for i, text in enumerate(batch.column(1)):
                ids = ids_of(text.as_py() or "") + closing
                for k, (start, length) in enumerate(cuts(len(ids) // 4, capacity)):
                    for column, v in zip(out, (i, k, start, length, zlib.crc32(ids[4 * start : 4 * (start + length)])), strict=True):
                        column.append(v)
            rows, *rest = out
            kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int64())
            columns = [batch.column(0).take(pa.array(rows, pa.int64())), *(pa.array(x, k) for x, k in zip(rest, kinds, strict=True))]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "piece", "start", "length", "ids_crc32"])

    some = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return some.mapInArrow(encode, "id long, piece int, start long, length long, ids_crc32 long")


def least_bins(counts: dict[int, int], capacity: int) -> int:
    """A lower bound on the bins: for every k, items over capacity - k stand alone, those over half never pair up.

    Or else, for every k, the sum of sizes rounded to parts of k: a dual feasible function.
    """
    total = sum(s * n for s, n in counts.items())
    best = -(-total // capacity)
    for k in range(1, 32):
        rounded = sum(n * (s * k if (k + 1) * s % capacity == 0 else (k + 1) * s // capacity * capacity) for s, n in counts.items())
        best = max(best, -(-rounded // (k * capacity)))
    for k in sorted({s for s in counts if s <= capacity // 2} | {0}):
        large = [(s, n) for s, n in counts.items() if s > capacity - k]
        middle = [(s, n) for s, n in counts.items() if capacity // 2 < s <= capacity - k]
        small = sum(s * n for s, n in counts.items() if k <= s <= capacity // 2)
        room = sum((capacity - s) * n for s, n in middle)
        best = max(best, sum(n for _, n in large) + sum(n for _, n in middle) + max(0, math.ceil((small - room) / capacity)))
        if len(counts) > 64 and k > 64:  # the bound is weak beyond, and need not be the best one
            break
    return best


def best_fit(counts: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Best-fit decreasing on a histogram: (sizes, how often) of all bins."""
    rooms: dict[int, list[tuple[tuple[int, ...], int]]] = {}
    for size in sorted(counts, reverse=True):
        left = counts[size]
        while left:
            fits = min((r for r in rooms if r >= size), default=None)
            if fits is None:
                each = capacity // size
                full, rest = divmod(left, each)
                for n, times in ((each, full), (rest, 1)):
                    if n and times:
                        rooms.setdefault(capacity - n * size, []).append(((size,) * n, times))
                break
            held, times = rooms[fits].pop()
            if not rooms[fits]:
                del rooms[fits]
            n = min(times, left)
            left -= n
            if times > n:
                rooms.setdefault(fits, []).append((held, times - n))
            rooms.setdefault(fits - size, []).append(((*held, size), n))
    return [x for group in rooms.values() for x in group]


def fullest(room: int, sizes: list[int], counts: dict[int, int]) -> tuple[int, ...]:
    """The filling of the largest sum, of large sizes where it can: reachable sums are bits of a number, size by size."""
    sizes, mask = sizes[: bisect_right(sizes, room)], (1 << room + 1) - 1
    reach = [1]
    for s in sizes:
        bits, left, k = reach[-1], min(counts[s], room // s), 1
        while left > 0:
            bits |= bits << min(k, left) * s & mask
            left, k = left - k, 2 * k
        reach.append(bits)
    rest, out = reach[-1].bit_length() - 1, []
    for i in range(len(sizes) - 1, -1, -1):
        s = sizes[i]
        n = next(n for n in range(min(counts[s], rest // s), -1, -1) if reach[i] >> rest - n * s & 1)
        out += [s] * n
        rest -= n * s
        if not rest:
            break
    return tuple(out)


def fillings(room: int, sizes: list[int], counts: dict[int, int], most: int = WIDTH) -> list[tuple[int, ...]]:
    """Undominated ways to fill ``room`` from ``sizes`` (ascending, all with a count), least waste first.

    The fullest comes first. For one further item only the largest that fits is undominated; for two, each first item
    takes the largest second one. A filling goes on until nothing fits. One that another beats item by item is dropped.
    """

    def largest(limit: int, used: tuple[int, ...]) -> int:
        i = bisect_right(sizes, limit) - 1
        while i >= 0 and counts[sizes[i]] <= used.count(sizes[i]):
            i -= 1
        return sizes[i] if i >= 0 else 0

    def finished(used: tuple[int, ...]) -> tuple[int, ...]:
        left = room - sum(used)
        while nxt := largest(left, used):
            used, left = (*used, nxt), left - nxt
        return used

    top = bisect_right(sizes, room)
    if not top:
        return [()]
    if sizes[top - 1] == room:
        return [(room,)]
    found = {finished((sizes[top - 1],)), fullest(room, sizes, counts)}
    second = 0
    for a in reversed(sizes[:top]):
        if a < second or len(found) > LOOKED:
            break
        b = largest(min(a, room - a), (a,))
        if b > second:  # else an earlier pair has both larger
            second = b
            found.add(finished((a, b)))
            if sum(max(found, key=sum)) == room and len(found) >= most:
                break
    ranked = sorted(found, key=lambda f: (room - sum(f), len(f), f))
    kept: list[tuple[int, ...]] = []
    for f in ranked:
        if not any(len(g) == len(f) and all(x >= y for x, y in zip(sorted(g), sorted(f), strict=True)) for g in kept):
            kept.append(f)
    return kept[:most]


def dive(counts: dict[int, int], capacity: int, above: int) -> list[tuple[tuple[int, ...], int]]:
    """Fill every bin around the largest remaining size: over ``above`` with the largest that fit, else as full as can be.

    Large sizes that would need the smallest ones for company are so packed among themselves.
    """
    left, sizes, out = dict(counts), sorted(counts), []
    while sizes:
        held, room = [sizes[-1]], capacity - sizes[-1]
        left[sizes[-1]] -= 1
        open_ = [s for s in sizes if left[s]]
        if held[0] > above:
            i = bisect_right(open_, room) - 1
            while i >= 0:
                n = min(left[open_[i]], room // open_[i])
                held += [open_[i]] * n
                room -= n * open_[i]
                i = min(i - 1, bisect_right(open_, room) - 1)
        else:
            held += fullest(room, open_, left)
        left[held[0]] += 1
        used = Counter(held)
        times = min(left[s] // n for s, n in used.items())
        for s, n in used.items():
            left[s] -= times * n
        sizes = [s for s in sizes if left[s]]
        out.append((tuple(held), times))
    return out


def _dived(counts: dict[int, int], capacity: int, bound: int) -> list[tuple[tuple[int, ...], int]]:
    """The best of ``DIVES`` dives over sizes as dividing ones, and as many between the neighbours of the best."""
    sizes, found = sorted(counts), {}
    lo, hi = 0, len(sizes) - 1
    for _ in range(2):
        for i in sorted({lo + (hi - lo) * j // (DIVES - 1) for j in range(DIVES)} - found.keys(), reverse=True):
            found[i] = dive(counts, capacity, sizes[i])
            if sum(n for _, n in found[i]) <= bound:
                return found[i]
        tried = sorted(found)
        at = tried.index(min(tried, key=lambda i: sum(n for _, n in found[i])))
        lo, hi = tried[max(0, at - 1)], tried[min(len(tried) - 1, at + 1)]
    return min(found.values(), key=lambda b: sum(n for _, n in b))


def bin_completion(counts: dict[int, int], capacity: int = CAPACITY, nodes: int = NODES) -> list[tuple[tuple[int, ...], int]]:
    """Fill bins around the largest remaining size, depth first; the best-fit solution and dives are first incumbents.

    A filling is used as often as the counts allow, so a path has as many steps as sizes run out, not as documents.
    A branch ends once its waste exceeds what one bin fewer than the incumbent leaves. The search ends at the lower
    bound or after ``nodes`` nodes; its result is never worse than best-fit.
    """
    counts = {s: n for s, n in counts.items() if n > 0}
    total = sum(s * n for s, n in counts.items())
    best = best_fit(counts, capacity)
    bins, bound = sum(n for _, n in best), least_bins(counts, capacity)
    if bins > bound:
        best = min(best, _dived(counts, capacity, bound), key=lambda b: sum(n for _, n in b))
        bins = sum(n for _, n in best)
    left, sizes, path, waste = dict(counts), sorted(counts), [], 0
    open_nodes: list[list[tuple[int, ...]]] = []
    seen = 0

    def take(filling: tuple[int, ...]) -> None:
        nonlocal waste, sizes
        times = min(left[s] // filling.count(s) for s in set(filling))
        for s in filling:
            left[s] -= times
        sizes = [s for s in sizes if left[s]]
        waste += times * (capacity - sum(filling))
        path.append((filling, times))

    def give_back() -> None:
        nonlocal waste, sizes
        filling, times = path.pop()
        for s in filling:
            left[s] += times
        sizes = sorted({*sizes, *filling})
        waste -= times * (capacity - sum(filling))

    while bins > bound and seen < nodes:
        allowed = (bins - 1) * capacity - total
        if sizes and waste <= allowed:
            seen += 1
            top = sizes[-1]
            left[top] -= 1
            options = [(top, *f) for f in fillings(capacity - top, [s for s in sizes if left[s]], left)]
            left[top] += 1
            open_nodes.append(options[::-1])
        else:
            if not sizes and waste <= allowed:
                best, bins = list(path), sum(n for _, n in path)
            give_back()
        while open_nodes and not open_nodes[-1]:
            open_nodes.pop()
            if not open_nodes:
                return best
            give_back()
        take(open_nodes[-1].pop())
    return best


def places(bins: list[tuple[tuple[int, ...], int]]) -> list[tuple[int, int, int, int, int]]:
    """(length, rank from, rank below, first sequence, offset): where the pieces of a length go, by their rank."""
    out, taken, first = [], {}, 0
    for held, times in bins:
        offset = 0
        for s in held:
            lo = taken.get(s, 0)
            out.append((s, lo, lo + times, first, offset))
            taken[s], offset = lo + times, offset + s
        first += times
    return out


def pack(cut: DataFrame, capacity: int = CAPACITY, nodes: int = NODES) -> DataFrame:
    """Add sequence_id and offset to a table with id, piece, start, length, ids_crc32 (read several times).

    The histogram has at most ``capacity`` rows; the table of places has a few rows for each step of the search and
    does not grow with the documents, so both may meet the driver. An empty table gives an empty result. Repeated rows
    each get a place of their own.
    """
    histogram = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    total = sum(histogram.values())
    where = places(bin_completion(histogram, capacity, nodes))
    slots = cut.sparkSession.createDataFrame(where, "length long, lo long, hi long, first long, offset long")
    order = [F.col("id"), F.col("piece"), F.col("ids_crc32")]
    ranked = position_in_group(cut, ["length"], order, max(1, total // RANKED), "rank")
    held = ranked.join(F.broadcast(slots), (ranked["length"] == slots["length"]) & (F.col("rank") >= F.col("lo")) & (F.col("rank") < F.col("hi")))
    return held.select("id", "piece", "start", ranked["length"], "ids_crc32", (F.col("first") + F.col("rank") - F.col("lo")).alias("sequence_id"), "offset")


def packed(docs: DataFrame, path: str, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Tokenise and pack documents; null texts are empty and hold the closing id alone."""
    cut = saved(pieces(docs, path, capacity, 0, id_col, text_col), "pieces")
    return pack(cut, capacity).withColumnRenamed("id", id_col)
