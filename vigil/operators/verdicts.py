"""Claims against their most similar evidence, folded by response: the rules of ``grounding`` over whole batches in NumPy.

Nothing is left out: every claim meets every chunk that shares a word with it. What differs from a row for each claim is
only that a response's claims stay together, so that its chunks are counted once and no claim is copied or shuffled.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

import numpy as np

from vigil.functions import lexicons as L

WORD, TOKEN = re.compile(r"\w\w+"), re.compile(r"[a-z0-9]+(?:'[a-z]+)?")
NONE, NEGATIONS = frozenset([*L.STOPWORDS, *L.MODALS, *L.NEGATIONS]), frozenset(L.NEGATIONS)
#: Meetings of words, and claims times chunks, that are held at once.
MEETINGS, CELLS = 1 << 20, 1 << 20
RETRIEVAL, ENTAIL, CONTRADICT = 0.10, 0.60, 0.60


def _r4(x: np.ndarray) -> np.ndarray:
    return np.round(x + 1e-9, 4)


def _counts(texts: Sequence[str], known: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
    """(text, word) of all words of two characters or more; new words get the next numbers."""
    words, sizes = [], []
    for text in texts:
        found = WORD.findall(text.lower())
        sizes.append(len(found))
        words += [known.setdefault(w, len(known)) for w in found]
    return np.repeat(np.arange(len(texts)), sizes), np.array(words, dtype=np.int64)


def nearest(asked: Sequence[str], chunks: Sequence[str], most: int) -> tuple[np.ndarray, np.ndarray]:
    """(similarity, place) of the ``most`` chunks nearest to each text that is asked for, ties to the earlier chunk.

    Similarities are those of ``grounding.Index`` over all chunks; they are 0 where no word is shared or no chunk is left.
    """
    n, many, known = len(asked), len(chunks), {}
    at, word = _counts(chunks, known)
    by, query = _counts(asked, known)
    size = max(1, len(known))
    key, m = np.unique(word * many + at, return_counts=True)
    word, at = np.divmod(key, many)
    df = np.bincount(word, minlength=size)
    first = np.cumsum(df) - df
    weight, own = np.log((2 + many) / (1 + df)) + 1, np.log((2 + many) / (2 + df)) + 1  # a query is a document too
    norm = np.bincount(at, weights=(m * weight[word]) ** 2, minlength=many)
    key, k = np.unique(by * size + query, return_counts=True)
    by, query = np.divmod(key, size)
    length = np.bincount(by, weights=(k * own[query]) ** 2, minlength=n)
    meets = df[query]
    to = np.searchsorted(by, np.arange(n + 1))  # where a claim's words begin
    upto = np.concatenate([[0], np.cumsum(meets)])[to]
    score, place = np.zeros((n, most)), np.zeros((n, most), dtype=np.int64)
    a = 0
    while a < n:
        b = min(int(np.searchsorted(upto, upto[a] + MEETINGS, "right")) - 1, a + CELLS // many)
        b = min(n, max(a + 1, b))
        w, each = query[to[a] : to[b]], meets[to[a] : to[b]]
        entry = np.repeat(np.arange(len(w)), each)
        post = np.arange(len(entry)) + np.repeat(first[w] - (np.cumsum(each) - each), each)
        cell, count, x = (by[to[a] : to[b]] - a)[entry] * many + at[post], m[post], w[entry]
        cells = (b - a) * many
        dots = np.bincount(cell, weights=k[to[a] : to[b]][entry] * count * own[x] * own[x], minlength=cells).reshape(b - a, many)
        more = np.bincount(cell, weights=count * count * (own * own - weight * weight)[x], minlength=cells).reshape(b - a, many)
        sim = np.zeros(dots.shape)
        np.divide(dots, np.sqrt(length[a:b, None] * (norm + more)), out=sim, where=dots > 0)
        sim, rows = np.round(sim, 12), np.arange(b - a)
        for i in range(min(most, many)):
            place[a:b, i] = best = sim.argmax(1)
            score[a:b, i] = np.maximum(sim[rows, best], 0)
            sim[rows, best] = -1
        a = b
    return np.round(np.minimum(score, 1.0), 6), place


def _said(text: str, seen: dict[str, tuple]) -> tuple:
    """(content words, whether negated, numbers) of a text."""
    if text not in seen:
        words = set(TOKEN.findall(text.lower()))
        digits = {w for w in words if w.isdigit()}
        seen[text] = (words - digits - NONE, not NEGATIONS.isdisjoint(words), {w for w in digits if len(w) <= 3})
    return seen[text]


def _label(met: np.ndarray, asked: np.ndarray, negation: np.ndarray, numeric: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(1 contradiction, 2 entailment, 3 neutral; confidence), as ``grounding.coverage_nli`` has it."""
    cover = met / np.maximum(asked, 1)
    topical, empty = cover >= 0.30, asked == 0
    cases = [empty, topical & (negation | numeric), cover >= 0.48]
    sure = [np.full(len(cover), 0.5), np.where(negation, np.minimum(0.97, 0.72 + 0.25 * cover), np.minimum(0.95, 0.72 + 0.20 * cover)), np.minimum(0.95, 0.55 + 0.40 * cover)]
    return np.select(cases, [3, 1, 2], 3), _r4(np.select(cases, sure, np.minimum(0.60, 0.40 + 0.35 * cover)))


def folded(claims: Sequence[Sequence[str]], stakes: Sequence[Sequence[float]], chunks: Sequence[Sequence[str]], depths: Sequence[int]) -> dict[str, np.ndarray]:
    """Sums over the claims of each response: number, highest criticality (NaN without claims), weights, and for every depth
    verdicts by kind and sums of evidence strength, weighted risk and confidence of the claims that are decided.

    ``stakes`` are the criticalities of the claims' texts. Claims of a response without chunks need not be given.
    """
    most, n = max(depths), len(stakes)
    size = np.fromiter(map(len, stakes), dtype=np.int64, count=n)
    row, total = np.repeat(np.arange(n), size), int(size.sum())
    first = np.cumsum(size) - size
    score, there = np.zeros((total, most)), np.zeros(total)
    found: list[np.ndarray] = []
    for r in np.flatnonzero(size):
        if not len(chunks[r]):
            continue
        at = int(first[r])
        near, place = nearest(claims[r], chunks[r], most)
        score[at : at + size[r]] = near
        retrieved = near[:, 0] >= RETRIEVAL
        there[at : at + size[r]] = np.where(retrieved, 1.0, 0.3)
        inside = retrieved[:, None] & (near >= np.maximum(RETRIEVAL, 0.6 * near[:, :1]))
        seen, pairs = {}, []
        for a, i in zip(*(x.tolist() for x in np.nonzero(inside)), strict=True):
            h, p = _said(claims[r][a], seen), _said(chunks[r][place[a, i]], seen)
            pairs.append((at + a, i, len(h[0] & p[0]), len(h[0]), h[1] != p[1], bool(h[2] and p[2]) and h[2].isdisjoint(p[2])))
        if pairs:
            found.append(np.array(pairs, dtype=np.int64))
    kind, sure = np.zeros((total, most), dtype=np.int64), np.zeros((total, most))
    if found:
        p = np.concatenate(found)
        kind[p[:, 0], p[:, 1]], sure[p[:, 0], p[:, 1]] = _label(p[:, 2], p[:, 3], p[:, 4] > 0, p[:, 5] > 0)
    best, critical = score[:, 0], np.fromiter((x for s in stakes for x in s), dtype=float, count=total)
    weight = 1 + 0.5 * critical
    summed = lambda x: np.bincount(row, weights=x, minlength=n)
    highest = np.full(n, np.nan)
    np.fmax.at(highest, row, critical)
    out = {"claims": size, "critical": highest, "weight": summed(weight)}
    for d in depths:
        top = lambda label, least, d=d: np.where((kind[:, :d] == label) & (sure[:, :d] >= least), sure[:, :d], 0.0).max(1, initial=0.0)
        against, for_ = top(1, CONTRADICT), top(2, ENTAIL)
        retrieved = best >= RETRIEVAL
        status = np.select([against > 0, for_ > 0, retrieved], [1, 2, 3], 0)
        nli = np.select([against > 0, for_ > 0], [against, for_], sure[:, :d].max(1, initial=0.0))
        strength = _r4(np.minimum(1.0, 0.4 * best + 0.4 * nli + 0.2 * there))
        risk = np.select([status == 1, status == 2, status == 3], [
            (0.55 + 0.30 * nli) * (0.75 + 0.25 * np.minimum(1.0, best / 0.6)), 0.08 * (1 - 0.9 * np.minimum(1.0, (best + nli) / 1.6)), 0.42 * (0.6 + 0.4 * (1 - strength))], 0.50)
        risk = _r4(np.minimum(1.0, risk))
        out |= {f"{name}{d}": summed(status == s).astype(np.int64) for s, name in ((2, "supported"), (1, "contradicted"), (3, "neutral"))}
        out |= {f"strength{d}": summed(strength), f"risk{d}": summed(weight * risk), f"nli{d}": summed(np.where((status == 1) | (status == 2), nli, 0.0))}
    return out
