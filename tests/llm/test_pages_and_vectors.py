"""Main text, URL filter, language, top-k search and vector near-duplicates, against brute force and on odd rows."""

from __future__ import annotations

import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from vigil.llm import embdup, html_mincut, langid, topk, url_markov
from vigil.llm.queries import URL_RULES

PAGE = """<html><head><title>T</title><style>p{}</style></head><body><header><nav><a href=/>Home</a> <a href=/b>About us</a></nav></header>
<div class="cookie-notice">We use cookies on this site, please accept them all now.</div><aside class="sidebar"><h3>Related</h3><ul><li><a>Link one</a><li><a>Link two</a></ul></aside>
<article><h1>The  title</h1><p>First &amp; <b>bold</b>text &#233; goes on, long enough to count as content.</p><div class="ad">Buy now, great offers for you only today.</div><p>Short.</p>
<script>var x = "</p>";</script><blockquote>A quote, with words in it.</blockquote></article><div id="comments"><p>Great article, I like it very much indeed, thanks!</p></div>
<form><label>Email</label><button>Send</button></form><footer>&copy; 2024 The company of this site.</footer></body></html>"""


def test_main_text():
    assert html_mincut.main_text(PAGE) == "The title First & boldtext é goes on, long enough to count as content. Short. A quote, with words in it."


@pytest.mark.parametrize("page", ["", None, "<", "<p", "<!-- open", "<p>a<p>b", "<script>", "</div></div>", "<div>" * 2000 + "x", "a < b", "&bogus; &#xzz;"])
def test_main_text_never_fails(page):
    assert isinstance(html_mincut.main_text(page), str)


@pytest.mark.parametrize("shape", ["<div>x", "<a ", "<a \"", "<a ='>", "<a =\"x>\"", "<p>word</p><nav>a</nav>", "</b>", "<li>x", "<b>x"])
def test_long_pages_take_linear_time(shape):
    began = time.perf_counter()
    html_mincut.main_text(shape * 100_000)
    assert time.perf_counter() - began < 30


def test_tags_with_odd_quotes():
    blocks = html_mincut.read_blocks("<p title=it's>one</p><p>it's two <a href=/x/>link</a> three</p><img alt=\"a > b\"><p class=\"x>four</p>")
    assert [b.text for b in blocks] == ["one", "it's two link three", "four"]
    assert [round(b.linked, 2) for b in blocks] == [0, 0.21, 0]


def test_minimum_cut_equals_brute_force():
    r = np.random.default_rng(4)
    for _ in range(40):
        n = int(r.integers(2, 8))
        cost, pair = r.normal(size=n) * 2, np.triu(r.random((n, n)) * (r.random((n, n)) < 0.5), 1)
        net = html_mincut.Network(n + 2)
        for i in range(n):
            net.add(n, i, max(cost[i], 0))
            net.add(i, n + 1, max(-cost[i], 0))
            for j in range(i + 1, n):
                if pair[i, j]:
                    net.add(i, j, pair[i, j], pair[i, j])

        def energy(x):
            x = np.array(x, dtype=bool)
            return np.maximum(cost, 0)[~x].sum() + np.maximum(-cost, 0)[x].sum() + pair[x[:, None] != x[None, :]].sum()

        best = min(energy([m >> i & 1 for i in range(n)]) for m in range(1 << n))
        assert energy(net.source_side(n, n + 1)[:n]) == pytest.approx(best)


def test_extract_keeps_rows_and_columns(spark):
    pages = spark.createDataFrame([(1, PAGE, "x"), (1, PAGE, "x"), (None, None, None)], "page_id long, html string, path string")
    out = html_mincut.extract(pages)
    assert out.columns == ["page_id", "html", "path", "text"] and sorted(len(r["text"]) for r in out.collect())[0] == 0 and out.count() == 3


# --- URLs


def plain_rule(url):
    if url is None or "://" not in url:
        return "", "", None
    rest = url.split("://", 1)[1]
    cut = min((rest.find(c) for c in "/?#" if c in rest), default=len(rest))
    host, tail = rest[:cut], rest[cut:]
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    path = tail[: min((tail.find(c) for c in "?#" if c in tail), default=len(tail))]
    best = None
    for rule, _ in URL_RULES:
        at = rule.index("/")
        if (host == rule[:at] or host.endswith("." + rule[:at])) and path.startswith(rule[at:]) and (best is None or len(rule) > len(best)):
            best = rule
    return host, path, best


def test_hosts_paths_and_rules(spark):
    urls = ["http://a.net/x", "HTTP://A.Example.NET/en/1?q#f", "http://net", "https://notexample.com/de/1", "http://x.example.com/de/9#a", "http://w.org/fr/", "http://w.org/FR/", "ftp://a.b?x://c/d", "no scheme", "", None, "http://é.net/", "a://b://c.net/x", "x\n://y.net/z"]
    rows = spark.createDataFrame(list(enumerate(urls)), "page_id int, url string").withColumn("score", F.lit("mine")).withColumn("gram", F.lit(1))
    got = {r["page_id"]: r for r in url_markov.judge(rows, URL_RULES).collect()}
    for i, u in enumerate(urls):
        host, path, rule = plain_rule(u)
        assert (got[i]["host"], got[i]["path"], got[i]["rule"]) == (host, path, rule), u
        assert got[i]["verdict"] == dict(URL_RULES)[rule] if rule else got[i]["verdict"] in ("allow", "block")
    assert url_markov.judge(rows.limit(0), URL_RULES).count() == 0


def test_url_scores_equal_a_plain_model(spark):
    urls = [f"http://good{i}.example.net/en/{i}" for i in range(20)] + [f"http://casino{i}.net/win" for i in range(20)]
    urls += ["http://casino.example.com/win", "http://good.example.com/en/3", "http://ünï.example.com/\U0001f600", "x"]
    frame = spark.createDataFrame([(u,) for u in urls], "url string")
    got = {r["url"]: r["score"] for r in url_markov.judge(frame, URL_RULES).collect()}
    held = {r["url"] for r in frame.filter(url_markov.is_held(F.col("url"))).collect()}
    order, models = url_markov.ORDER, {}
    uniform = 1 / (len(set("".join(urls))) + 1)
    padded = lambda u: [url_markov.PAD] * order + list(u)
    for label in ("allow", "block"):
        counts = {}
        for u in urls:
            rule = plain_rule(u)[2]
            if rule and dict(URL_RULES)[rule] == label and u not in held:
                s = padded(u)
                for i in range(order, len(s)):
                    for k in range(order + 1):
                        c = counts.setdefault(tuple(s[i - k : i]), {})
                        c[s[i]] = c.get(s[i], 0) + 1
        models[label] = counts

    def p(counts, context, x):
        low = p(counts, context[1:], x) if context else uniform
        c = counts.get(context, {})
        return (c.get(x, 0) + len(c) * low) / (sum(c.values()) + len(c)) if c else low

    for u in urls:
        s = padded(u)
        ratio = lambda i: np.log(p(models["allow"], tuple(s[i - order : i]), s[i]) / p(models["block"], tuple(s[i - order : i]), s[i]))
        assert got[u] == pytest.approx(np.mean([ratio(i) for i in range(order, len(s))]), abs=1e-5)
    assert got["http://good.example.com/en/3"] > got["http://casino.example.com/win"]


def test_url_verdicts_on_unseen_hosts(spark):
    """Numbers, non-ASCII labels and longer pieces tell URLs apart that no rule fits."""
    good = [f"http://site{i}.example.net/en/story-2{i % 10}1{i % 7}" for i in range(400)]
    bad = [f"http://site{i}.casino{i % 9}.net/en/story-9{i % 10}8{i % 7}" for i in range(400)]
    new_good = [f"http://other{i}.example.com/en/story-2{i % 10}1{i % 7}" for i in range(50)]
    new_bad = [f"http://other{i}.casino{i % 9}.com/en/story-9{i % 10}8{i % 7}" for i in range(50)]
    frame = spark.createDataFrame([(u,) for u in [*good, *bad, *new_good, *new_bad, None, "", "x" * 20000]], "url string")
    got = {r["url"]: r for r in url_markov.judge(frame, URL_RULES).collect()}
    assert len(got) == len({*good, *bad, *new_good, *new_bad}) + 3
    assert sum(got[u]["verdict"] == "allow" for u in new_good) >= 48 and sum(got[u]["verdict"] == "block" for u in new_bad) >= 48
    assert got[None]["score"] == 0 == got[""]["score"]


# --- language


def test_language(spark):
    words = {"en": "the and of with this that from house", "de": "der und die nicht mit schule haus zeit", "fr": "le la les dans pour avec maison temps"}
    r = np.random.default_rng(5)
    say = lambda lang, n: " ".join(r.choice(words[lang].split(), n))
    labelled = spark.createDataFrame([(say(x, 30), x) for x in words for _ in range(30)] + [(None, "en"), ("x", None)], "text string, lang string")
    pages = [(i, f"http://{x}.site.com/{x}/{i}", f"<html lang='{x}'><body>{say(x, 20)}</body></html>", x) for i, x in enumerate(list(words) * 10)]
    pages += [(100, "http://de.site.com/x", "", "de"), (101, "http://fr.site.com/fr/1", f"<html lang=en>{say('fr', 30)}</html>", "fr"), (102, None, None, None)]
    frame = spark.createDataFrame(pages, "page_id long, url string, html string, want string").withColumn("lang", F.lit("clash"))
    got = langid.identify(frame, labelled).collect()
    assert len(got) == len(pages)
    assert all(x["lang"] == x["want"] and 0 < x["probability"] <= 1 for x in got if x["want"])
    assert langid.identify(frame.limit(0), labelled).count() == 0
    assert {x["lang"] for x in langid.identify(frame, labelled.limit(0)).collect()} == {None}


def test_language_equals_a_plain_version(spark):
    """Thirty languages, all of them modelled; posteriors from hand-made shares."""
    r = np.random.default_rng(15)
    names = [f"l{i:02}" for i in range(30)]
    words = {x: ["".join(r.choice(list("abcdefghijklmnopqrstuvwxyz"), 5)) for _ in range(12)] for x in names}
    say = lambda x, n: " ".join(r.choice(words[x], n))
    labelled = spark.createDataFrame([(say(x, 30), x) for x in names for _ in range(4 if x < "l20" else 2)], "text string, lang string")
    # texts of two languages leave the rest of the evidence something to say
    pages = [(i, f"http://{names[i % 30] if i % 3 else 'www'}.s{i % 4}.com/a/{'de' if i % 5 else 'fr'}/", f"<html lang={'de' if i % 7 else 'fr'}>{say(names[i % 30], 3)} {say(names[i * 7 % 30], 2)}</html>") for i in range(120)]
    frame = spark.createDataFrame(pages, "page_id long, url string, html string")
    got = {x["page_id"]: x for x in langid.identify(frame, labelled).collect()}
    languages, model = langid.text_model(labelled)
    assert languages == names
    score = lambda t: (lambda g: model[g].sum(axis=0) * min(1.0, langid.EVIDENCE / len(g)))(langid.trigrams(t))
    like = np.array([score(" " + h.split(">", 1)[1].rsplit("<", 1)[0] + " ") for _, _, h in pages])
    like = np.exp(like - like.max(axis=1, keepdims=True))
    t = like / like.sum(axis=1, keepdims=True)
    share = (t.sum(axis=0) + 1) / (len(pages) + 30)
    host = [u.split("/")[2] for _, u, _ in pages]
    keys = {"declared": [h[11:13] for _, _, h in pages], "address": [u[-3:-1] for _, u, _ in pages], "domain": [x.split(".", 1)[1] for x in host], "host": host}

    def smoothed(name, i, above):
        same = [j for j in range(len(pages)) if keys[name][j] == keys[name][i] and j != i]
        return (t[same].sum(axis=0) + langid.SMOOTH * above) / (len(same) + langid.SMOOTH)

    for i in range(len(pages)):
        w = like[i] * smoothed("declared", i, share) / share * smoothed("address", i, share) / share * smoothed("host", i, smoothed("domain", i, share))
        assert got[i]["lang"] == names[int(w.argmax())] and got[i]["probability"] == pytest.approx(w.max() / w.sum(), abs=1e-6)


# --- vectors


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")


def test_bounds_hold():
    r = np.random.default_rng(6)
    q, x = r.normal(size=(20, 37)), r.normal(size=(30, 37))
    exact, last = q @ x.T, None
    for n in topk.LEVELS:
        bound = topk.statistics(q, n) @ topk.statistics(x, n).T
        assert (bound >= exact - 1e-9).all() and (last is None or bound.sum() <= last + 1e-6)
        last = bound.sum()


def test_top_k_equals_brute_force(spark):
    r = np.random.default_rng(7)
    x = r.normal(size=(400, 12)).round(1)
    x[50:60] = x[0]  # ties
    rows = [(i, [float(v) for v in x[i]], 0) for i in range(400)] + [(1000, None, 0), (1050, [float("nan")] * 12, 0), (1100, [None] * 12, 0), (None, [1.0] * 12, 0)]
    got = topk.top_k(topk.whole_numbers(vectors(spark, rows)), F.col("vec_id") % 50 == 0, 5).collect()
    whole = np.floor(256 * x.astype(np.float32).astype(float)).astype(np.int64)
    want = {}
    for q in range(0, 400, 50):
        s = whole @ whole[q]
        order = sorted((-int(s[j]), j) for j in range(400) if j != q)[:5]
        want |= {(q, k + 1): (j, -v) for k, (v, j) in enumerate(order)}
    assert {(g["query_id"], g["rank"]): (g["vec_id"], g["score"]) for g in got} == want
    few = topk.top_k(topk.whole_numbers(vectors(spark, rows[:3])), F.col("vec_id") % 50 == 0, 5).collect()
    assert [g["rank"] for g in few] == [1, 2]
    assert topk.top_k(topk.whole_numbers(vectors(spark, [])), F.col("vec_id") % 50 == 0, 5).count() == 0


def test_large_scores_and_small_blocks():
    r = np.random.default_rng(8)
    x = r.integers(-50, 50, size=(300, 16)).astype(float)
    q = x[::30]
    at, ids, s = topk.search_block(np.arange(0, 300, 30), q, np.arange(300), x, 3, step=7)
    for k in range(10):
        want = sorted((-int(v), j) for j, v in enumerate(x @ q[k]) if j != 30 * k)[:3]
        assert [(-int(v), int(i)) for i, v in zip(ids[at == k], s[at == k], strict=True)] == want


def test_scores_beyond_doubles_and_longs(spark):
    """Whole numbers over 2^53 rank exactly; scores outside a long are its ends; one beyond the doubles takes no part."""
    a = float(2**45 + 1)
    rows = [(0, [a, 3.0]), (1, [a, 1.0]), (2, [a, 2.0]), (3, [-a, 0.0]), (50, [1e40, 0.0]), (51, [1e308, 0.0])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = topk.top_k(topk.whole_numbers(frame), F.col("vec_id") % 50 == 0, 4).collect()
    whole = {i: [int(c * 256) if abs(c * 256) < 2**53 else int(c * 256) for c in v] for i, v in rows if i < 51}
    limit = lambda x: max(-(2**63), min(2**63 - 1, x))
    for q in (0, 50):
        want = sorted((-limit(sum(x * y for x, y in zip(whole[q], v, strict=True))), i) for i, v in whole.items() if i != q)[:4]
        assert [(g["vec_id"], -g["score"]) for g in sorted(got, key=lambda g: (g["query_id"], g["rank"])) if g["query_id"] == q] == [(i, s) for s, i in want]


def test_integers_beyond_doubles():
    x = np.array([[2.0**30, 1.0], [2.0**30, 2.0], [2.0**30, 3.0], [-(2.0**30), 0.0]])
    at, ids, s = topk.search_block(np.array([9]), x[:1], np.arange(4), x, 3)
    assert list(ids) == [2, 1, 0] and [int(v) for v in s] == [2**60 + 3, 2**60 + 2, 2**60 + 1]


@pytest.mark.parametrize("home", [4096, 16])
def test_vector_links_equal_brute_force(spark, monkeypatch, home):
    """Clusters, copies, other labels and odd vectors; small cells are split over several tasks."""
    monkeypatch.setattr(embdup, "HOME", home)
    r = np.random.default_rng(9)
    rows = []
    for c in range(12):
        centre = r.normal(size=20)
        for _ in range(25):
            v = centre + r.normal(size=20) * 0.12 * r.random()
            rows.append((len(rows), [float(a) for a in v], c % 2))
    rows += [(len(rows) + i, rows[0][1], 0) for i in range(5)] + [(900, [0.0] * 20, 0), (901, None, 0), (902, [float("inf")] * 20, 0), (903, rows[0][1], None), (904, [1.0, 2.0], 0), (905, [2.0, 4.0], 0), (906, [None, 1.0], 0)]
    got = {g["vec_id"]: g for g in embdup.linked(vectors(spark, rows)).collect()}
    assert len(got) == len(rows)
    good = {}
    for i, v, label in rows:
        if v is not None and label is not None and all(a is not None and np.isfinite(a) for a in v) and any(v):
            u = np.array(v, dtype=np.float32).astype(float)
            good[i] = (label, u / np.linalg.norm(u))
    near = {i: {j for j in good if j != i and good[i][0] == good[j][0] and len(good[i][1]) == len(good[j][1]) and good[i][1] @ good[j][1] >= 0.98} for i in good}
    for i, g in got.items():
        seen, todo = {i}, [i]
        while todo:
            for j in near.get(todo.pop(), ()):
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        assert (g["n_links"], g["component_id"], g["kept"]) == (len(near.get(i, ())), min(seen), min(seen) == i)
    assert embdup.linked(vectors(spark, [])).count() == 0


def test_groups_of_a_full_cell_hold_two_buckets(spark):
    """Every home row meets every other row of its cell once, whatever the share of visitors."""
    rows = spark.createDataFrame([(1, 0, 7, i, i % 4 == 0) for i in range(400)], "label int, b int, cell long, node long, home boolean")
    full = spark.createDataFrame([(1, 0, 7, 10)], "label int, b int, cell long, parts int")
    groups, met = {}, []
    for r in embdup.dealt_to_buckets(rows, full).collect():
        groups.setdefault((r["i"], r["j"]), []).append((r["node"], r["home"]))
    for (i, j), held in groups.items():
        assert len({n for n, _ in held}) == len(held) <= 120
        met += [(x, y) for x, at_home in held if at_home for y, other in held if x != y and (i == j or not other)]
    assert len(met) == len(set(met)) and set(met) == {(x, y) for x in range(0, 400, 4) for y in range(400) if x != y}
