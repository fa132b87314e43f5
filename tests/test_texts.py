"""Sentences, evidence and decisions from texts."""

from __future__ import annotations

import itertools
import random
import re
import time
from collections import defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

from vigil import queries as Q
from vigil.functions import lexicons as L
from vigil.operators import grounding as G
from vigil.operators import responsibility as R
from vigil.operators import routing as V
from vigil.operators import verdicts as VE
from vigil.plans import texts as TX

ODD = [
    "0 rooms. 1 bed. 2 chairs for 22. 33 lamps 3. 4111 1111 1111 1111", " 10. Leading.  Two  spaces . \t Tab\tled.\n\n  indented 5 \r\n", "a.\x0bB.\x0cC? \xa0D!\u3000E \u2003F.\u2003 ", None, "", " \n \xa0", "\tone", "x\x0by z\xa0w",
    "Ends. \u2028Line. \x85Next", "...  !!! ???", "0\n1\n2\n3\n44\n5 5\n6. 7. 8. 9. 10. 11", "\n\t\n", ". . .",
]


@pytest.mark.parametrize("name", ["t01_sentences", "t02_claims"])
def test_sentences_equal_sql_on_odd_texts(spark, tmp_path, name):
    spark.createDataFrame(list(enumerate(ODD)), "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    assert sorted(map(tuple, Q.QUERIES[name](spark, str(tmp_path)).collect())) == sorted(db.execute(Q.SQL[name]).fetchall())


def _told(seed: int, n: int) -> str:
    r = random.Random(seed)
    words = "warehouse opens nine morning refund card order arrives monday not closed seven price 7 12 99999 ten euros never without customer Zoë straße o'clock can't the is".split()
    return "".join(" ".join(r.choice(words) for _ in range(r.randint(1, 9))) + r.choice([". ", "! ", "\n", ".\t"]) for _ in range(n))


def test_folded_verdicts_equal_a_row_for_each_claim(spark):
    texts = [(i, _told(i, i % 23), None if i % 5 == 4 else _told(i if i % 2 else i + 100, i % 17) + ("x" * 900 + " the price. " + "y z " * 500 if i % 7 == 0 else "")) for i in range(60)]
    texts += [(60, "One. Two", "!!! ???"), (61, None, "Some text here."), (62, "Same same. Same same. Same same.", "Same same. Same same. Same same."), (63, "No words shared at all.", "Nothing else matches")]
    rows = spark.createDataFrame(texts, "id long, response string, context string").cache()
    got = {r["id"]: r for r in G.graded(rows, ["id"], "response", "context", (G.SHALLOW, G.DEEP)).collect()}
    assert len(got) == len(texts)
    claims = {d: defaultdict(list) for d in (G.SHALLOW, G.DEEP)}
    for d, by in claims.items():
        for c in G.claim_results(rows, ["id"], "response", "context", d).collect():
            by[c["id"]].append(c)
    kinds = set()
    for (d, by), i in itertools.product(claims.items(), got):
        row, own = got[i], by[i]
        status = [c["status"] for c in own]
        kinds |= set(status)
        assert (row["claims"], row[f"supported{d}"], row[f"contradicted{d}"]) == (len(own), status.count("SUPPORTED"), status.count("CONTRADICTED"))
        assert row["max_text_criticality"] == max((c["text_criticality"] for c in own), default=None)
        if not own:
            assert (row[f"status{d}"], row[f"performance_risk{d}"], row[f"evidence_quality{d}"], row[f"neutral_rate{d}"]) == ("UNVERIFIED", 0.10, 0.0, 0.0)
            continue
        assert row[f"neutral_rate{d}"] == status.count("NEUTRAL") / len(own)
        assert row[f"evidence_quality{d}"] == pytest.approx(sum(c["evidence_strength"] for c in own) / len(own), abs=6e-5)
        weights = [1 + 0.5 * c["text_criticality"] for c in own]
        mean = sum(w * c["claim_risk"] for w, c in zip(weights, own, strict=True)) / sum(weights)
        hit = status.count("CONTRADICTED")
        assert row[f"performance_risk{d}"] == pytest.approx(max(mean, min(0.97, 0.62 + 0.12 * hit)) if hit else mean if set(status) == {"SUPPORTED"} else max(mean, 0.05), abs=6e-5)
    assert kinds == {"SUPPORTED", "CONTRADICTED", "NEUTRAL", "NO_EVIDENCE"}


@pytest.mark.parametrize("held", [None, 7])
def test_nearest_chunks_equal_the_index(monkeypatch, held):
    if held:  # so small that every claim is a block of its own
        monkeypatch.setattr(VE, "MEETINGS", held)
        monkeypatch.setattr(VE, "CELLS", held)
    for seed in range(20):
        asked, chunks = (_told(seed + k, 25).split(". ") for k in (0, seed % 2))
        index = G.Index()
        for c in chunks:
            index.add(c)
        score, place = VE.nearest(asked, chunks, 3)
        for a, text in enumerate(asked):
            best = [(j, round(min(1.0, s), 6)) for j, s in index.best(text, 3) if s > 0]
            assert [(int(j), float(s)) for j, s in zip(place[a], score[a], strict=True) if s > 0] == best


def test_no_claim_is_a_row_of_its_own(spark):
    documents = spark.createDataFrame([(i, f"s{i % 2}", _told(i, 5)) for i in range(9)], "doc_id long, source string, text string")
    for rows in (TX.from_documents(documents), TX.from_documents_in_context(documents)):
        plan = TX.detected(rows)._jdf.queryExecution().optimizedPlan().toString()
        assert "Generate" not in plan and "outer" not in plan


def test_cascade_by_equals_the_cascade_of_each_profile(spark):
    said = ["", "Short answer", "Mail a.b@c.de now", "x@", "a@b.c", "Card 4111 1111 1111 1111", "AB123456 ACC-1234", "Call +1 (504) 555-0292", "We never share data", "A Guaranteed Refund", "See www.a.b", "To Big Name", "No 1 2 3", "Room 7", "wire it", "Say insider"]
    said += ["word " * n for n in (69, 71, 111, 141, 161, 221, 321)] + [_told(i, i) for i in range(6)]
    apps = [*V.PROFILES, "unknown", None]
    rows = [(i, a, ("refund", "information", None)[i % 3], (0.0, 5.0)[i % 5 == 0], ("", "Can I cancel?")[i % 2], t, ("", "Room 7 is short", " ")[i % 3]) for i, (t, a) in enumerate(itertools.product(said, apps))]
    rows = spark.createDataFrame(rows, "interaction_id long, application string, action_type string, amount double, prompt string, response string, context string").cache()
    got = {r["interaction_id"]: (r["cascade_outcome"], r["complexity"], r["cascade_deep"]) for r in V.cascade_by(rows).collect()}
    assert {x[0] for x in got.values()} == {"CLEARED", "VIOLATION", "AMBIGUOUS"} and len(got) == len(said) * len(apps)
    for app in apps:
        own = rows.filter(F.col("application").eqNullSafe(app))
        for r in V.cascade(own, app if app in V.PROFILES else "default", V.is_action(F.col("action_type"), F.col("amount"))).collect():
            assert got[r["interaction_id"]] == (r["outcome"], r["complexity"], r["verdict"] == "ROUTE_TO_DEEP"), r


#: The forms of the entity patterns that look back first; those in use begin with a character.
LOOK_BACK = [
    r"(?<!\d)(?:\d[ -]?){13,16}(?!\d)", r"(?<!\d)\d{4}\s\d{4}\s\d{4}(?!\d)", r"(?<!\d)\d{3}-\d{2}-\d{4}(?!\d)", r"(?<![A-Z0-9])[A-Z]{5}\d{4}[A-Z](?![A-Z0-9])", r"(?<![A-Za-z0-9])ACC-\d{5,}(?![A-Za-z0-9])",
    r"(?<![A-Za-z0-9])EMP-\d{4,}(?![A-Za-z0-9])", r"[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}", r"(?<!\w)(?:\+?\d[\d\-\s]{7,}\d)(?!\w)", L.PII[-1][1],
]


def test_entity_patterns_find_what_their_plain_forms_find():
    r, parts = random.Random(3), ["4111 1111 1111 1111", "123-45-6789", "1234 5678 9012", "ABCDE1234F", "+1 (504) 555-0292", "+44 20 7946 0958", "a.b@c.de", "x@y.com.z@w.org", "ACC-12345", "EMP-1234", "12 Main Street", " ", "x", "1", "+", "-", "A", "@", "_"]
    texts = ["".join(r.choice(parts) for _ in range(r.randint(1, 12))) for _ in range(3000)] + ["".join(r.choice("01+- a\n.") for _ in range(40)) for _ in range(3000)]
    for (kind, new), old in zip(L.PII, LOOK_BACK, strict=True):
        found = [[m.span() for m in re.finditer(new, t)] for t in texts]
        assert found == [[m.span() for m in re.finditer(old, t)] for t in texts], kind
        assert any(found)


def test_a_long_run_of_letters_is_scanned_once():
    began = time.perf_counter()
    assert [f["matched"] for f in R.scan("a" * 60_000 + " 123-45-6789")] == ["123-45-6789"]
    assert time.perf_counter() - began < 2


def test_words_asked_for_first_leave_nothing_out(spark):
    odd = ["MEN generally", "Women are", "people in the town usually", "She tend to be far less", "older he is the BEST fit for", "he more capable", "it adapts more slowly", "Preferentially", "prioritize the male", "PRIORITIZING THE URBAN", "not a good cultural fit", "wouldnt fit in", "wouldn't fit in", "nothing", None, ""]
    rows = spark.createDataFrame(list(enumerate(odd)), "id long, text string")
    plain = [re.compile(p, re.I | re.A) for p, _ in L.BIAS]
    for r in rows.withColumns(R.bias(F.col("text"))).collect():
        grouped, want = re.search(r"\b(?:" + "|".join(L.GROUPS) + r")\b", r["text"] or "", re.I), dict.fromkeys(L.BIAS_WEIGHT, 0)
        for p, (_, kind) in zip(plain, L.BIAS, strict=True):
            want[kind] += len(p.findall(r["text"] or "")) if grouped or kind not in L.NEED_GROUP else 0
        assert {k: r[f"b_{k}"] for k in want} == want, r
    cards = ["+4 1-1+1 1-1+1 1+1 1 1", "1234567890", "123456789", "4111-1111-1111-1111", "411111111111", "AB123456", "ab123456", "xAB123456", "acct_1234", "EMP1234", "Cust-12345", "acc-123", "C1234", "٤" * 12, None]
    rows = spark.createDataFrame(list(enumerate(cards)), "id long, text string")
    for n, sign in V.SIGNS.items():
        assert rows.filter(F.col("text").rlike(V.PATTERNS[n]) & ~F.col("text").rlike(sign)).count() == 0 < rows.filter(F.col("text").rlike(V.PATTERNS[n])).count()


def test_stored_decisions_are_not_planned_again(spark, tmp_path, monkeypatch):
    rows = [(i, f"s{i % 2}", _told(i, 4) + ("I will hurt you." if i == 3 else "")) for i in range(12)]
    spark.createDataFrame(rows, "doc_id long, source string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    names = ["x04_critical_turns", "x03_session_snapshots_documents", "d14_decisions_documents"]
    first = {n: sorted(map(str, Q.QUERIES[n](spark, str(tmp_path)).collect())) for n in names}
    assert all(first.values())
    for name in ("detected", "scored", "decisions", "from_documents"):
        monkeypatch.setattr(TX, name, None)
    assert first == {n: sorted(map(str, Q.QUERIES[n](spark, str(tmp_path)).collect())) for n in names}


def test_severe_toxicity_needs_no_evidence_and_decides_as_all_rules_do(spark, tmp_path):
    bad = ["", "I will hurt you.", "Your kind.", "What the hell, shut up, you people, not my problem.", "damn it", "I WILL FIND YOU 4111 1111 1111 1111 a.b@c.de"]
    rows = [(i, f"s{i % 3}", None if i == 7 else _told(i, i % 9) + bad[i % 6] + (" See €50000 refund." if i % 4 == 0 else "")) for i in range(180)]
    spark.createDataFrame(rows, "doc_id long, source string, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    query = Q.QUERIES["d05_toxicity_in_context"](spark, str(tmp_path))
    got = sorted(map(str, query.collect()))
    assert got == sorted(map(str, Q._severe(Q.text_decided(spark, str(tmp_path), "in_context")).collect()))
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = db.execute(Q.SQL["d05_toxicity_in_context"]).fetchall()
    assert sorted(map(tuple, query.collect()), key=str) == sorted(want, key=str) and 30 < sum(r[5] for r in want) < 180
    plan = query._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and "Python" not in plan
