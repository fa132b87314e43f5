"""Vector codes, filter interactions and language-model scores, against brute force and on odd rows."""

from __future__ import annotations

import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from vigil.llm import codes, filter_audit, kneser_ney

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LABELS = "doc_id long, quality int, toxic int"
VECTORS = "vec_id long, embedding array<float>, label int"

# --- vector codes


def plain_codes(rows, parts=16, size=64, rounds=2):
    kept = [(i, [math.floor(256 * float(x)) for x in v], label) for i, v, label in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    width = max(1, -(-max((len(v) for _, v, _ in kept), default=0) // parts))
    cut = [[tuple((v + [0] * width * parts)[p * width : (p + 1) * width]) for p in range(parts)] for _, v, _ in kept]
    books = [[c[p] for c in cut[:size]] for p in range(parts)]
    near = lambda x, b: min((sum((s - t) ** 2 for s, t in zip(x, e)), k) for k, e in enumerate(b))
    for _ in range(rounds):
        for p, b in enumerate(books):
            mine = defaultdict(list)
            for c in cut:
                mine[near(c[p], b)[1]].append(c[p])
            books[p] = [tuple(sum(x) // len(mine[k]) for x in zip(*mine[k])) if k in mine else e for k, e in enumerate(b)]
    best = [[near(c[p], books[p]) for p in range(parts)] for c in cut]
    error = [min(sum(d for d, _ in b), (1 << 63) - 1) for b in best]
    by_label = Counter()
    for (_, _, label), e in zip(kept, error):
        by_label[label] += e
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest() if kept else hashlib.sha256(b"").hexdigest()
    return sorted(((i, "".join(f"{k:02x}" for _, k in b), e, min(by_label[label], (1 << 63) - 1), digest) for (i, _, label), b, e in zip(kept, best, error)), key=repr)


def coded(spark, rows):
    return sorted((tuple(r) for r in codes.compress(spark.createDataFrame(rows, VECTORS)).collect()), key=repr)


def test_codes_equal_brute_force(spark):
    r = np.random.default_rng(5)
    rows = [(i, [float(np.float32(x)) for x in r.normal(size=32)], int(i % 3) if i % 7 else None) for i in range(300)]
    rows += [rows[5], (900, rows[3][1], 1), (None, rows[9][1], 2), (901, None, 1), (902, [1.0, None] * 16, 1), (903, [float("nan")] * 32, 1), (904, [float("inf")] * 32, 0), (905, [0.0] * 32, 0)]
    assert coded(spark, rows) == plain_codes(rows)


@pytest.mark.parametrize(
    "rows",
    [
        [],
        [(1, None, 1)],
        [(7, [], None), (8, [], 1)],
        [(3, [0.5] * 5, 1), (2, [1.0, -1.0], None), (3, [0.25] * 17, 1)],
        [(i, [1.0] * 16, 1) for i in range(70)],
        [(1, [3e38] * 16, 1), (2, [-3e38] * 16, 1), (3, [1.5] * 16, 2)],
    ],
    ids=["empty", "none usable", "no components", "ragged", "equal", "huge"],
)
def test_codes_of_odd_tables(spark, rows):
    if rows and rows[0][1] and rows[0][1][0] == 3e38:  # whole numbers end at a long's ends
        assert [r[2] for r in coded(spark, rows)] == [0, 0, 0]
    else:
        assert coded(spark, rows) == plain_codes(rows)


def test_orchard_finds_the_first_of_nearest_entries_and_looks_at_few():
    r = np.random.default_rng(2)
    entries = r.integers(-3, 4, (4, 64, 3))  # many entries as near as each other, and repeated ones
    x = r.integers(-5, 6, (500, 4, 3))
    at, away = codes.Codebooks(entries).nearest(x)
    d = ((x[:, :, None, :] - entries[None]) ** 2).sum(axis=3)
    assert (away == d.min(axis=2)).all() and (at == d.argmin(axis=2)).all()
    big = codes.Codebooks(entries.astype(object) * 10**12).nearest(x * 10**12)
    assert (big[0] == at).all() and [int(x) for x in big[1].ravel()] == [int(x) * 10**24 for x in away.ravel()]


def test_codes_ignore_other_columns_and_clashing_names(spark):
    rows = [(i, [float(i % 5), 1.0], i % 2) for i in range(20)]
    df = spark.createDataFrame(rows, VECTORS)
    extra = df.withColumns({"id": F.lit("x"), "v": F.lit(1), "error": F.lit(2), "code": F.lit(3), "n": F.lit(4), "_part": F.lit(5)})
    assert sorted(map(tuple, codes.compress(extra).collect())) == sorted(map(tuple, codes.compress(df).collect()))


# --- filters

WORDS = "red blue green over under stone river cloud table light".split()


def plain_audit(docs, labels):
    first = {}
    for i, text, *_ in docs:
        if i is not None:
            first[text or ""] = min(first.get(text or "", i), i)
    good, toxic = ({i for i, *v in labels if i is not None and v[k] == 1} for k in (0, 1))
    rows = []
    for i, text, lang, *_ in docs:
        t = text or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = {"A": len(w) < 100, "B": 100 * len(set(w)) < 80 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 10 * len(t), "D": bool(re.search("[#$%&*|]", t)), "E": i is not None and i > first[t]}
        rows.append((lang or "", {f for f, v in fails.items() if v}, i in good, i in toxic))
    out = {}
    for part in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == part]
        total = Counter()
        for order in itertools.permutations("ABCDE"):
            for k, f in enumerate(order):
                before = set(order[:k])
                removed = [r for r in own if f in r[1] and not r[1] & before]
                total[f] += len(removed)
                out[part, "".join(order), k + 1] = [sum(1 for r in own if not r[1] & (before | {f})), len(removed), sum(1 for r in own if f in r[1] and r[1] & before), sum(1 for r in own if r[1] == {f}), sum(r[2] for r in removed), sum(r[3] for r in removed), f]
        for key, v in out.items():
            if key[0] == part:
                v[6] = total[v[6]] if isinstance(v[6], str) else v[6]
    return out


def audited(docs, labels):
    return {(r["part"], r["filter_order"], r["step"]): [r[c] for c in filter_audit.COUNTS] for r in filter_audit.audit(*filter_audit.documents(docs, labels)).collect()}


def test_audit_equals_brute_force(spark):
    r = random.Random(4)
    texts = [" ".join(r.choice(WORDS) + (str(r.randint(0, 99)) if r.random() < 0.7 else "") for _ in range(r.choice([5, 99, 100, 130, 400]))) for _ in range(120)]
    texts = [t.upper() if k % 9 == 0 else t + " $" if k % 5 == 0 else t for k, t in enumerate(texts)] + texts[:30] + ["", None, " ", "A" * 9, "é|", "Word word" * 70, " ".join(WORDS * 20)]
    docs = [(k, t, [None, "", "en", "fr"][k % 4], "s", 1) for k, t in enumerate(texts)] + [(None, texts[0], "en", "s", 1), (3, texts[3], "fr", "s", 1), (3, texts[3], "fr", "s", 1), (2, "other text of one id", "en", None, None)]
    labels = [(k, k % 3 == 0, k % 4 == 0) for k in range(0, 150, 2)] + [(4, 1, 0), (4, None, 1), (None, 1, 1), (9999, 1, 1)]
    labels = [(i, None if q is None else int(q), int(t)) for i, q, t in labels]
    df = spark.createDataFrame(docs, DOCS).withColumns({"key": F.lit(1), "part": F.lit("x"), "A": F.lit(True), "digest": F.lit(1), "n": F.lit(0), "before": F.lit(7), "id": F.lit(8)})
    assert audited(df, spark.createDataFrame(labels, LABELS)) == plain_audit(docs, labels)


def test_audit_of_empty_and_of_clean_tables(spark):
    none = spark.createDataFrame([], LABELS)
    assert audited(spark.createDataFrame([], DOCS), none) == {}
    clean = [(k, " ".join(f"w{k}x{i}" for i in range(120)), "en", "s", 1) for k in range(4)]
    found = audited(spark.createDataFrame(clean, DOCS), none)
    assert len(found) == 600 and all(v == [4, 0, 0, 0, 0, 0, 0] for v in found.values())


def test_audit_of_other_filters(spark):
    ids = spark.createDataFrame([(k, "p", 1, 0) for k in range(6)], "key long, part string, good int, toxic int")
    fails = {"X": ids.filter("key < 3").select("key"), "Y": ids.filter("key in (2, 5)").select("key")}
    found = {(r["filter_order"], r["step"]): (r["kept"], r["removed"], r["redundant"], r["unique_fails"], r["good_lost"], r["shapley"]) for r in filter_audit.audit(ids, fails).collect()}
    assert found == {("XY", 1): (3, 3, 0, 2, 3, 5), ("XY", 2): (2, 1, 1, 1, 1, 3), ("YX", 1): (4, 2, 0, 1, 2, 3), ("YX", 2): (2, 2, 1, 2, 2, 5)}
    with pytest.raises(ValueError):
        filter_audit.audit(ids, {})


# --- language model


class Plain:
    """Interpolated modified Kneser-Ney by its definition, over dictionaries of words."""

    def __init__(self, texts, order):
        self.order = order
        raw, self.plain = Counter(), Counter()
        for t in texts:
            s = [" "] * (order - 1) + self.words(t)
            raw.update(tuple(s[i : i + order]) for i in range(len(s) - order + 1))
            self.plain.update(self.words(t))
        self.levels = {order: raw}
        for k in range(order - 1, 0, -1):
            up, here = self.levels[k + 1], Counter()
            for g, n in up.items():
                here[g[1:]] += n if g[1] == " " else 1
            self.levels[k] = here
        self.d = {k: self.discounts(Counter(c.values())) for k, c in self.levels.items()}
        self.after = {k: defaultdict(list) for k in self.levels}
        for k, c in self.levels.items():
            for g, n in c.items():
                self.after[k][g[:-1]].append(n)

    @staticmethod
    def words(t):
        return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) + ["\n"]

    @staticmethod
    def discounts(n):
        if not (n[1] and n[2] and n[3]):
            return kneser_ney.DISCOUNTS
        y = n[1] / (n[1] + 2 * n[2])
        d = tuple(k - (k + 1) * y * n[k + 1] / n[k] for k in (1, 2, 3))
        return d if all(0 < x <= k for k, x in zip((1, 2, 3), d)) else kneser_ney.DISCOUNTS

    def p(self, g):
        k = len(g)
        if not k:
            return 1 / (len(self.plain) + 1)
        lower = self.p(g[1:])
        after = self.after[k].get(g[:-1])
        if not after:
            return lower
        cut = lambda n: self.d[k][min(n, 3) - 1] if n else 0
        n = self.levels[k].get(g, 0)
        return (max(n - cut(n), 0) + sum(map(cut, after)) * lower) / sum(after)

    def score(self, t):
        s = [" "] * (self.order - 1) + self.words(t)
        return sum(math.log10(self.p(tuple(s[i - self.order + 1 : i + 1]))) for i in range(self.order - 1, len(s)))


def prose(n, seed=3):
    r = random.Random(seed)
    return [" ".join(r.choice(WORDS[: 3 + 7 * (k % 2)]) + ("s" if r.random() < 0.1 else "") + (str(r.randint(0, 500)) if r.random() < 0.1 else "") for _ in range(r.randint(0, 40))) for k in range(n)]


@pytest.mark.parametrize(("order", "bits"), [(1, 0), (2, 0), (2, 3), (3, 2), (4, 0)])
def test_scores_equal_the_definition(spark, monkeypatch, order, bits):
    texts = [*prose(150), "", None, " \t\n", "RED Blue\vgreen", "red blue É", "<s> </s>", "nothing known here at all"]
    df = spark.createDataFrame([(k, t, "en", "s", 1) for k, t in enumerate(texts)] + [(None, "red blue", "en", "s", 1), (5, texts[5], "en", "s", 1)], DOCS).withColumn("score", F.lit("x"))
    if bits:
        monkeypatch.setattr(kneser_ney, "SHARD", max(1, sum(len(t or "") for t in texts) // 5 // 2**bits))
    rows = [(k, t, k is not None and zlib.crc32(str(k).encode()) % 7 == 2) for k, t in [*enumerate(texts), (None, "red blue"), (5, texts[5])]]
    model = Plain([t for _, t, held in rows if not held], order)
    n = sum(model.plain.values())
    want = []
    for k, t, held in rows:
        w = model.words(t)
        want.append((k, held, len(w), sum(1 for x in w if model.plain[x]), n, sum(math.log10((model.plain[x] + 1) / (n + len(model.plain) + 1)) for x in w), model.score(t)))
    found = [tuple(r) for r in kneser_ney.score_held_out(df, order).collect()]
    key = lambda r: (r[0] is None, r[0] or 0, r[2])
    for a, b in zip(sorted(found, key=key), sorted(want, key=key), strict=True):
        assert a[:5] == b[:5] and a[5:] == pytest.approx(b[5:], rel=1e-9)


@pytest.mark.parametrize("order", [2, 3])
def test_probabilities_sum_to_one(spark, order):
    texts = prose(60)
    model = kneser_ney.count(spark.createDataFrame([(t,) for t in texts], "t string"), order)
    look, hashes = kneser_ney.Lookup(model), kneser_ney._Hashes()
    words = sorted({w for t in texts for w in Plain.words(t)[:-1]})
    each = np.array([hashes[w.encode()] for w in words] + [int(kneser_ney.END), hashes[b"never seen"]], np.uint64)
    for context in (["red"] * (order - 1), ["blue", "unseen"][-(order - 1) :], [words[-1]] * (order - 1)):
        at = np.array([hashes[w.encode()] for w in context], np.uint64)
        assert sum(look.probabilities(np.append(at, w))[0][0] for w in each) == pytest.approx(1)


def test_held_out_texts_score_above_single_tokens(spark):
    phrases = ["over the old stone bridge", "under a grey cloud", "by the light of the river", "at the long table"]
    r = random.Random(1)
    df = spark.createDataFrame([(k, " ".join(r.choice(phrases) for _ in range(20)), "en", "s", 1) for k in range(200)], DOCS)
    rows = kneser_ney.score_held_out(df).filter("held_out").collect()
    assert len(rows) > 10 and all(r["score"] > 0.6 * r["base_score"] for r in rows)


def test_model_without_texts_and_with_one_very_long_text(spark):
    empty = spark.createDataFrame([], DOCS)
    assert kneser_ney.score_held_out(empty).collect() == []
    only_held = spark.createDataFrame([(k, "a b", "en", "s", 1) for k in range(200) if zlib.crc32(str(k).encode()) % 7 == 2], DOCS)
    assert all(tuple(r)[1:] == (True, 3, 0, 0, 0.0, 0.0) for r in kneser_ney.score_held_out(only_held).collect())
    long = " ".join(f"w{i % 1000}" for i in range(600_000))
    rows = kneser_ney.score_held_out(spark.createDataFrame([(0, long, "en", "s", 1)], DOCS)).collect()
    assert rows[0]["n_tokens"] == 600_001 and rows[0]["n_known"] == 600_001
    assert [len(x) for x in [kneser_ney.tokens(long.encode(), kneser_ney._Hashes())]] == [600_001]
