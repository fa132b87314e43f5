"""SimHash, packing, mixing, personal data, toxicity and the pipeline, against brute force and on odd rows."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F
from pyspark.sql.functions import PandasUDFType
from tokenizers import Tokenizer

from vigil.llm import mixing, packing, pii, simhash, toxicity
from vigil.llm.common import small_batches

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
PATH = public_tokenizers.path("byte_bpe_50k.json")
WORDS = "red blue green over under stone river cloud table light quick slow near far one two three four five six".split()
ODD = ["", None, " ", "\n\t ", "word", "word", "a b", "ÄÖ ß ñ", "x" * 5000, "a\u00a0b  c\r\nd", "<|endoftext|> tail", "mail me at a@b.co, or +1 (252) 555-8630"]


def documents(spark, texts, extra=False):
    rows = [(i, t, "en", f"s{i % 3}" if i % 7 else None, len(t or "")) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, DOCS)
    if extra:  # names that operators use inside, and a repeated row and one without an id
        df = df.unionByName(df.limit(1)).unionByName(spark.createDataFrame([(None, "lost row", None, None, None)], DOCS))
        df = df.withColumns({"fp": F.lit(1), "score": F.lit("x"), "toxic": F.lit(1), "_score": F.lit(2), "_id": F.lit(3), "label": F.lit(0), "base": F.lit(0), "spans": F.lit(0), "rank": F.lit(9), "size": F.lit(9)})
    return df


def sentences(n, seed=1, length=30):
    r = random.Random(seed)
    return [" ".join(r.choice(WORDS) for _ in range(r.randint(1, length))) for _ in range(n)]


# --- SimHash


def plain_fingerprint(text):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if w]
    if not words:
        return 0
    grams = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_fingerprints_equal_the_plain_ones():
    for t in [*ODD, *sentences(50), "A B C d É"]:
        assert simhash.fingerprint(t) % (1 << 64) == plain_fingerprint(t)


def test_golay_keys_meet_at_distance_two():
    r = np.random.default_rng(3)
    v = r.integers(0, 1 << 23, 20000)
    keys = simhash.codewords(v)
    assert ((keys >= 0).sum(axis=1) % 5 == 1).all()
    for flips in (1, 2):
        u = v.copy()
        for row in range(len(v)):
            for b in r.choice(23, flips, replace=False):
                u[row] ^= 1 << int(b)
        other = simhash.codewords(u)
        assert all(set(a[a >= 0]) & set(b[b >= 0]) for a, b in zip(keys, other, strict=True))


def components(fps, most=2):
    root = {f: f for f in fps}

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    order = sorted(root)
    for i, a in enumerate(order):
        for b in order[i + 1 :]:
            if bin((a ^ b) & (1 << 64) - 1).count("1") <= most:
                root[find(b)] = find(a)
    return {f: find(f) for f in root}


@pytest.mark.parametrize("bucket", [2, 32])
def test_links_of_fingerprints(spark, bucket):
    """Dense clouds of fingerprints and chains; small buckets send nearly all down the way of large ones."""
    r = random.Random(5)
    fps = set()
    for _ in range(6):
        f = r.getrandbits(64)
        for _ in range(40):
            fps.add(f ^ (1 << r.randrange(64)) ^ (1 << r.randrange(64)))
        for _ in range(8):
            f ^= (1 << r.randrange(64)) ^ (1 << r.randrange(64))
            fps.add(f)
    fps |= {r.getrandbits(64) for _ in range(100)}
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    links = simhash.fingerprint_links(spark.createDataFrame([(f,) for f in signed], "fp long"), bucket).collect()
    from vigil.llm.components import connected_components

    frame = spark.createDataFrame([(x["a"], x["b"]) for x in links], "a long, b long")
    got = {x["node"]: x["root"] for x in connected_components(frame, "a", "b").collect()}
    want = components(signed)
    groups = lambda m: {frozenset(k for k in m if m[k] == v) for v in set(m.values())}
    assert groups({f: got.get(f, f) for f in signed}) == groups(want)


def test_near_duplicates(spark):
    base = sentences(30, 9, 200)
    texts = ODD + base + [base[0], base[0].upper(), base[1] + " extra"] + sentences(40, 4)
    got = {r["doc_id"]: r for r in simhash.near_duplicates(documents(spark, texts)).collect()}
    fps = {i: simhash.fingerprint(t) for i, t in enumerate(texts)}
    root = components(set(fps.values()))
    for i in fps:
        assert got[i]["fp"] == fps[i]
        assert got[i]["component_id"] == min(j for j in fps if root[fps[j]] == root[fps[i]])


def test_keep_one_keeps_columns_and_first(spark):
    docs = documents(spark, ["a b c d", "a b c d", "other words here now", None, ""], extra=True)
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in kept.collect()) == [(False, 0), (False, 2), (False, 3), (True, 0)]


def test_keep_one_drops_texts_of_similarity_080_and_no_others(spark, monkeypatch):
    r = random.Random(12)
    jaccard = lambda a, b: len(set(a) & set(b)) / len(set(a) | set(b))
    texts, near = [], []
    for i in range(60):
        words = [f"w{r.randrange(10**6)}" for _ in range(r.randint(150, 400))]
        copy = list(words)
        for at in range(20, len(words) - 20, 60 if i % 2 else 20):  # every change breaks five shingles
            copy[at] = f"new{at}"
        near.append(jaccard(simhash.shingle_set(" ".join(words)), simhash.shingle_set(" ".join(copy))) >= 0.8)
        texts += [" ".join(words), " ".join(copy)]
    assert 20 < sum(near) < 40
    want = [i for i in range(len(texts)) if not (i % 2 and near[i // 2])]
    docs = documents(spark, texts)
    assert sorted(x["doc_id"] for x in simhash.keep_one(docs).collect()) == want
    # buckets that are dealt to parts give the same pairs, and those that anchors leave are found by either way
    at = simhash.segments(len(texts))
    kinds = docs.select(simhash.wide_udf("text").alias("w")).select("w.*").withColumn("root", F.col("node"))
    none = {"ref": "long", "rest": "long", "more": "long", "held": "array<long>"}
    kinds = kinds.withColumns({c: F.lit(None).cast(t) for c, t in none.items()})
    pairs = [{(x["a"], x["b"]) for x in simhash.similar_pairs(kinds, at, simhash.large_buckets(kinds, at, 2), hot).collect()} for hot in (2, 4096)]
    assert pairs[0] == pairs[1] and len(pairs[0]) >= sum(near)
    anchored = {(min(x), max(x)) for x in simhash.anchor_pairs(kinds, at, simhash.large_buckets(kinds, at, 1)).collect() if x["node"] != x["head"]}
    assert anchored <= pairs[0] and len(anchored) >= sum(near) / 4


def test_keep_one_of_a_dense_group(spark):
    """Near copies of one text: linked through fixed nodes, not in pairs; those apart from all stay."""
    r = random.Random(21)
    base = [f"b{r.randrange(10**6)}" for _ in range(300)]
    texts = []
    for i in range(400):
        words = list(base)
        for at in r.sample(range(300), 3):
            words[at] = f"n{i}x{at}"
        texts.append(" ".join(words))
    docs = documents(spark, [*texts, *sentences(20, 5)])
    assert simhash.keep_one(documents(spark, texts)).count() == 1
    kinds = docs.select(simhash.wide_udf("text").alias("w")).select("w.*").withColumn("root", F.col("node"))
    at = simhash.segments(420)
    assert 300 <= simhash.anchor_pairs(kinds, at, simhash.large_buckets(kinds, at, 8)).count() <= 2 * 420


@pytest.mark.parametrize("hot", [None, 100])
def test_a_common_head_excludes_pairs_but_no_links(spark, monkeypatch, hot):
    """Copies with many changes, about half of them similar to the text they come from: few candidates, every link."""
    r = random.Random(22)
    base, texts = [f"b{r.randrange(10**6)}" for _ in range(200)], []
    for i in range(300):
        words = list(base)
        for at in r.sample(range(200), r.randint(0, 9)):
            words[at] = f"n{i}x{at}"
        texts.append(" ".join(words))
    sets = [set(simhash.shingle_set(t).tolist()) for t in texts]
    jaccard = lambda a, b: len(a & b) / len(a | b)
    near = {i: {j for j in range(300) if jaccard(sets[i], sets[j]) >= 0.8} for i in range(300)}
    want = {}
    for i in range(300):
        seen, todo = {i}, [i]
        while todo:
            todo += [j for j in near[todo.pop()] if j not in seen and not seen.add(j)]
        want[i] = min(seen)
    asked = []
    monkeypatch.setattr(simhash, "DENSE", 8)
    plain = simhash.similar_pairs
    monkeypatch.setattr(simhash, "similar_pairs", lambda k, at, large: asked.append((k, plain(k, at, large, hot), large)) or asked[-1][1])
    got = {x["doc_id"]: x["component_id"] for x in simhash.similar_documents(documents(spark, texts)).collect()}
    assert 10 < len(set(want.values())) and got == want
    free = asked[0][0].withColumns({"ref": F.lit(None).cast("long")})
    assert asked[0][1].count() < plain(free, simhash.segments(300), asked[0][2], hot).count() / 10


def test_keep_one_holds_little_text_at_once(spark, monkeypatch):
    """Texts and sets reach the workers in batches of few bytes, whatever the session allows, whose bound stays."""
    r = random.Random(31)
    texts = [" ".join(f"w{r.randrange(10**6)}" for _ in range(2500)) for _ in range(450)]
    assert sum(map(len, texts)) > 8 << 20
    wide, sets = simhash.wide_udf.func, simhash.shingle_set_udf.func

    def little(found):
        def held(texts):
            if texts.str.len().sum() > 5 << 20:
                raise ValueError("a batch of too many bytes")
            return found(texts)

        return held

    fields = "struct<node: bigint, n: bigint, wide: binary>"
    monkeypatch.setattr(simhash, "wide_udf", F.pandas_udf(little(wide), fields, PandasUDFType.SCALAR))
    monkeypatch.setattr(simhash, "shingle_set_udf", F.pandas_udf(little(sets), "array<bigint>", PandasUDFType.SCALAR))
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    docs = documents(spark, [*texts, texts[0] + " more", texts[1]]).coalesce(1)
    assert sorted(x["doc_id"] for x in simhash.keep_one(docs).collect()) == list(range(450))
    assert spark.conf.get(name) == before
    with pytest.raises(KeyError), small_batches(spark):
        assert spark.conf.get(name) == str(4 << 20)
        raise KeyError
    assert spark.conf.get(name) == before


def test_keep_one_keeps_different_texts_of_one_id(spark):
    rows = [(1, "a b c d e f g", "en", "s", 0), (1, "quite another text of words here", "en", "s", 0), (1, "a b c d e f g", "en", "s", 0), (None, "x y", "en", "s", 0), (None, "x y", "en", "s", 0), (None, "z", "en", "s", 0)]
    kept = simhash.keep_one(spark.createDataFrame(rows, DOCS)).collect()
    assert sorted(str((r["doc_id"], r["text"][:2])) for r in kept) == ["(1, 'a ')", "(1, 'qu')", "(None, 'x ')", "(None, 'z')"]


def test_components_of_a_long_chain(spark):
    from vigil.llm.components import connected_components

    r = random.Random(2)
    ids = r.sample(range(10**6), 200)
    links = spark.createDataFrame([*zip(ids, ids[1:], strict=False), (5, 5), (7, None)], "a long, b long")
    roots = connected_components(links, "a", "b").collect()
    assert {x["root"] for x in roots} == {min(ids)} and len(roots) == 200


# --- packing


def test_encoder_equals_the_tokenizer():
    tokenizer, encode = Tokenizer.from_file(PATH), packing.encoder(PATH)
    odd = ["a  b", "a\n\nb", "a \nb", "it's x's", " a b ", "don't 'tis 12 3.4", "word.\nNext, one.", "é ü\u3000x", "\n", "tab\there", "a\n.b", "x, y. z!", *[t for t in ODD if t], *sentences(20)]
    for t in odd:
        ids = tokenizer.encode(t, add_special_tokens=False).ids
        assert encode(t) == b"".join(i.to_bytes(4, "little") for i in ids), t


def test_pieces_and_places(spark):
    long_text = " ".join(sentences(400, 8))
    texts = [*ODD, long_text, *sentences(60, 3, 300)]
    tokenizer = Tokenizer.from_file(PATH)
    got = packing.packed(documents(spark, texts), PATH, 256).collect()
    tokens = {i: [*tokenizer.encode(t or "", add_special_tokens=False).ids, 0] for i, t in enumerate(texts)}
    by_sequence, seen = {}, Counter()
    for r in got:
        ids = tokens[r["doc_id"]]
        part = ids[r["start"] : r["start"] + r["length"]]
        assert zlib.crc32(np.array(part, "<u4").tobytes()) == r["ids_crc32"] and len(part) == r["length"]
        assert r["length"] == 256 or r["piece"] == 0
        by_sequence.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        seen[r["doc_id"]] += r["length"]
    assert seen == {i: len(t) for i, t in tokens.items()}
    for held in by_sequence.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= 256
    assert len(by_sequence) <= packing.least_bins(Counter(r["length"] for r in got), 256) + 1


def test_bin_completion_is_sound():
    r = random.Random(6)
    for _ in range(20):
        counts = Counter(r.randint(1, 60) for _ in range(r.randint(1, 60)))
        bins = packing.bin_completion(counts, 64)
        used = Counter()
        for held, times in bins:
            assert sum(held) <= 64
            for s in held:
                used[s] += times
        assert used == counts
        n = sum(t for _, t in bins)
        assert packing.least_bins(counts, 64) <= n <= sum(t for _, t in packing.best_fit(counts, 64))
    assert packing.bin_completion({}, 64) == []
    # best-fit decreasing needs three bins here, completion finds two
    assert sum(t for _, t in packing.bin_completion({4: 1, 3: 2, 6: 1, 2: 2}, 10)) == 2


@pytest.mark.parametrize(("low", "high", "most"), [(650, 720, 710), (500, 900, 725), (1, 2048, 1036)])
def test_bin_completion_of_sizes_that_do_not_fit_well(low, high, most):
    r = random.Random(31)
    counts = Counter(r.randint(low, high) for _ in range(2000))
    bins = packing.bin_completion(counts)
    used = Counter()
    for held, times in bins:
        assert sum(held) <= 2048
        for s in held:
            used[s] += times
    assert used == counts
    assert packing.least_bins(counts, 2048) <= sum(t for _, t in bins) <= most


def test_packing_of_nothing_and_of_repeats(spark):
    assert packing.packed(documents(spark, []), PATH).count() == 0
    rows = packing.packed(documents(spark, ["same", "same"], extra=True), PATH).collect()
    assert len(rows) == 4 and len({(r["sequence_id"], r["offset"]) for r in rows}) == 4


# --- mixing


def plain_targets(sizes, weights=(3, 1, 2)):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    out, left, open_ = {}, 1.5 * sum(sizes.values()), set(names)
    while open_:
        level = left / sum(w[s] for s in open_)
        over = {s for s in open_ if level * w[s] > 2 * sizes[s]}
        if not over:
            return out | {s: level * w[s] for s in open_}
        for s in over:
            out[s] = 2.0 * sizes[s]
            left -= out[s]
        open_ -= over
    return out


def test_mix_meets_targets(spark):
    texts = sentences(300, 7, 400) + ODD
    rows = [(i, t, "en", ["big", "a", "Z", None, "tiny"][0 if i % 3 else i % 5], 0) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, DOCS)
    slots, found = mixing.mix(docs, block=16)
    got = {r["id"]: r for r in found.collect()}
    source = {i: s for i, _, _, s, _ in rows}
    size = {i: len([w for w in re.split(r"[\x20\x09-\x0D]+", t or "") if w]) for i, t in enumerate(texts)}
    total = Counter()
    for i, s in source.items():
        total[s] += size[i]
    want, taken = plain_targets(total), Counter()
    for i, r in got.items():
        assert r["size"] == size[i] and 0 <= r["taken"] <= 2 * size[i]
        assert r["target"] == pytest.approx(want[source[i]]) and r["source_size"] == total[source[i]]
        taken[source[i]] += r["taken"]
    for s in total:
        assert abs(taken[s] - want[s]) <= 1
    assert slots.agg(F.sum("words")).first()[0] == sum(taken.values())
    assert slots.groupBy("s", "epoch", "block").count().filter("count > 1").count() == 0
    again = {r["id"]: r["taken"] for r in mixing.mix(docs.repartition(3), block=16)[1].collect()}
    assert again == {i: r["taken"] for i, r in got.items()}


def test_mix_of_nothing(spark):
    assert mixing.mix(documents(spark, []))[1].count() == 0
    assert [r["taken"] for r in mixing.mix(documents(spark, ["", None]))[1].collect()] == [0, 0]


def test_mixed_documents_keep_columns(spark):
    docs = documents(spark, sentences(60, 2), extra=True)
    out = mixing.mixed_documents(docs)
    assert out.columns == docs.columns and out.count() > 0


def test_mixed_documents_meet_targets_with_long_documents(spark):
    """Fractions of a half or less left out every long document."""
    r = random.Random(13)
    rows = [(i, " ".join([f"d{i}", *["w"] * r.randint(1200, 2400)]), "en", f"s{i % 6:02}" if i % 10 else "s06", 0) for i in range(600)]
    docs = spark.createDataFrame(rows, DOCS)
    words = lambda found: Counter({x["source"]: x["n"] for x in found.groupBy("source").agg(F.sum(mixing.word_count(F.col("text"))).alias("n")).collect()})
    had, got = words(docs), words(mixing.mixed_documents(docs))
    want = plain_targets(had)
    assert any(want[s] % had[s] < 0.9 * had[s] for s in had)
    for s in had:
        assert abs(got[s] - want[s]) < 0.04 * want[s] + 2400, s


# --- personal data

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    return sum(int(d) if i % 2 == 0 else sum(divmod(2 * int(d), 10)) for i, d in enumerate(reversed(digits))) % 10 == 0


def plain_spans(text):
    out = []
    for kind, pattern in PLAIN.items():
        for m in re.finditer(pattern, text or ""):
            d = re.sub("[^0-9]", "", m[0])
            ok = {"email": True, "ip": kind == "ip" and all(int(p) <= 255 for p in m[0].split(".")), "card": 13 <= len(d) <= 19 and luhn(d), "phone": 9 <= len(d) <= 15}[kind]
            if ok:
                out.append(f"{kind}:{m.start()}:{m.end()}")
    return out


def test_base_spans_equal_the_plain_ones(spark):
    tricky = [
        "a@b.com.c_d@e.fg x@y@z.com .@-.- a.b@c", "1.2.3.4.5.6.7.8 256.1.1.1 0001.2.3.4 1.2.3", "4111 1111 1111 1111 4111111111111112 4111-1111-1111-1111", "+1 (252) 555-8630 +12 +1234567890123456 ++1 22 33 44 55",
        "\u0001a@b.co\u0002 \u00e9\U0001f600 10.0.0.1", "1 " * 4000, "a" * 3000 + "@", "9" * 3000, "call 555-123-4567 or user [at] example [dot] com", "card 4111 1111 1111 1112 here", "from host 10[.]20[.]30[.]40 and 300[.]1[.]1[.]1",
    ]
    texts = [*ODD, *tricky]
    for r in pii.detect(documents(spark, texts)).select("doc_id", pii.joined(F.col("base")).alias("base"), pii.joined(F.col("spans")).alias("spans")).collect():
        want = plain_spans(texts[r["doc_id"]])
        assert r["base"] == ",".join(want), texts[r["doc_id"]][:80]
        assert set(want) <= set(r["spans"].split(",")) | {""}


def test_em_finds_the_reliable_labeler():
    r = np.random.default_rng(1)
    truth = r.random(20000) < 0.4
    vote = lambda p: np.where(r.random(20000) < p, 1, -1) * np.where(truth, 1, -1)
    votes = np.stack([vote(0.95), vote(0.8), vote(0.7), np.where(r.random(20000) < 0.5, 0, vote(0.75))], axis=1)
    patterns, counts = np.unique(votes, axis=0, return_counts=True)
    likely, reliable = pii.expectation_maximisation(patterns.astype(float), counts.astype(float))
    assert reliable[0] > reliable[1] > reliable[2]
    right = sum(c for p, c, n in zip(likely, counts, patterns, strict=True) if (p > 0.5) == (n[0] > 0))
    assert right / 20000 > 0.9


def test_redaction(spark):
    docs = documents(spark, ["é mail a@b.co now", "nothing", None, "ip 10.0.0.1"], extra=True)
    out = pii.redact(docs)
    assert out.columns == docs.columns
    got = {r["doc_id"]: (r["text"], r["n_chars"]) for r in out.collect()}
    assert got[0] == ("é mail [EMAIL] now", 18) and got[1] == ("nothing", 7) and got[2][0] is None and got[3][0] == "ip [IP]"
    assert pii.redact(documents(spark, [])).count() == 0


def test_digest(spark):
    r = pii.detect(documents(spark, [None])).select(F.sha2(pii.joined(F.col("base")), 256).alias("d")).first()
    assert r["d"] == hashlib.sha256(b"").hexdigest()


# --- toxicity


def labelled(spark, n=600):
    r = random.Random(11)
    bad, texts, labels = ["idiot", "moron", "scum"], [], []
    for i in range(n):
        words = [r.choice(WORDS) for _ in range(20)]
        toxic = i % 6 == 0
        if toxic:
            words[3], words[9] = r.choice(bad), r.choice(bad)
        if i % 6 == 0 or i % 6 == 1 and i % 4 == 1:  # a group that toxic texts mention more often
            words[5] = "muslim"
        texts.append(" ".join(words))
        labels.append((i, 1, int(toxic)))
    return documents(spark, texts), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_toxicity_held_out_and_neutral_mentions(spark):
    docs, labels = labelled(spark)
    got = {r["doc_id"]: r for r in toxicity.score(docs, labels).collect()}
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 3 == 1) for i, r in got.items())
    assert all(r["predicted"] == (r["doc_id"] % 6 == 0) for r in got.values() if r["held_out"])
    model, free = toxicity.train(docs, labels), toxicity.train(docs, labels, swap=0.0)
    gap = lambda m: abs(m.score("one muslim here") - m.score("one christian here"))
    assert gap(model) < gap(free) / 3 and model.score("a muslim river") < 0.5


def test_neutral_mentions_of_every_term_pass(spark):
    docs, labels = labelled(spark)
    model = toxicity.train(docs, labels)
    terms = [t for g in toxicity.IDENTITY for t in g]
    neutral = [f"{a} {t} {b}" for t in terms for a, b in (("red river", "under stone"), ("one", "two three"), ("", ""))]
    assert sum(model.score(x) >= toxicity.THRESHOLD for x in neutral) == 0
    assert all(abs(model.score(f"one {t}") - model.score("one")) < 0.05 for t in terms)


def test_toxicity_on_odd_input(spark):
    docs, labels = labelled(spark, 60)
    for tables in ((documents(spark, ODD, extra=True), labels), (documents(spark, []), labels), (docs, labels.limit(0)), (docs, labels.withColumn("toxic", F.lit(None).cast("int"))), (docs, labels.withColumn("toxic", F.lit(0)))):
        rows = toxicity.score(*tables).collect()
        assert len(rows) == tables[0].count() and all(0 <= r["score"] <= 1 for r in rows)
    # documents of one kind only are left of the labelled ones
    absent = spark.createDataFrame([*((i, 1, 0) for i in range(60)), *((i, 1, 1) for i in range(500, 540))], "doc_id long, quality int, toxic int")
    for some in (absent, absent.withColumn("toxic", 1 - F.col("toxic"))):
        assert {r["predicted"] for r in toxicity.score(docs, some).collect()} == {0}
    wide = documents(spark, ["red", "blue"], extra=True)
    assert toxicity.drop_toxic(wide, labels).columns == wide.columns


# --- the pipeline


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    docs, labels = labelled(spark, 300)
    docs = docs.unionByName(documents(spark, ["mail a@b.co please now " * 9, None, ""]).withColumn("doc_id", F.col("doc_id") + 1000))
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    rows = corpus_pipeline.run(spark, str(tmp_path)).collect()
    ids = {r["doc_id"] for r in rows}
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "simhash_near_dedup", "pii", "mixing", "best_fit_packing"]
    assert not any(i % 6 == 0 for i in ids if i < 300) and len(ids) > 50
    stages = dict(corpus_pipeline.STAGES)
    for name in list(stages)[:4]:
        assert stages[name](spark, docs.limit(0), str(tmp_path)).columns == docs.columns
