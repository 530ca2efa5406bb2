"""Whole records: states merge in any split, and every defined case."""

import json
import random

import pytest
from pyspark.sql import functions as F

from pagewright.operators import records
from pagewright.operators.reduce import merge_contradictions, merge_entities

LISTS = "topics array<string>, salient_quotes array<string>, " + ", ".join(f"{k} array<struct<{records._fields(k)}>>" for k in records.FIELDS).replace("contradictions array", "internal_contradictions array")
SCHEMA = f"doc_id long, section_name string, chapter_name string, seg_no long, seg_id string, pages array<int>, ocr_confidence string, has_table boolean, has_figure boolean, sentiment string, summary string, {LISTS}"


def children(spark):
    r = random.Random(3)
    pick = lambda *x: r.choice(x)
    rows = []
    for n in range(40):
        entity = lambda: (pick("The Bank", "Acme Bank", "acme  bank", "P. Q.", None), pick([], ["Bank"], ["The Bank", "ACME"], None), pick("org", None), pick("issuer", "lender", None), pick("it lends", None))
        metric = lambda: (pick("Net Margin", "net  margin", "Profit"), pick("4%", "4.53%", "about 4%"), pick(4.0, 4.53, None), pick("percent", None), pick("FY24", "FY23", None), None, None, pick("q1", "q22"))
        claim = lambda: (pick("We grew", "we  GREW", "We hold"), "performance", pick(["Acme Bank"], ["P. Q.", "Bank"], None), pick("positive", "neutral"), pick("FY24", "ongoing"), pick("x", "xxxx", None), "high")
        decision = lambda: (pick("Appoint X", "appoint x"), pick("appointment", None), pick(["Board"], []), pick(["X"], None), None, pick("d", "dd"))
        risk = lambda: (pick("Rates rise", "rates  rise"), pick("market", "credit"), pick("low", "high", None), pick(["Acme Bank"], []), pick("hedged", None), pick("r", "rr"))
        clash = lambda: (pick("Two totals", "two  totals"), pick(["a", "b"], ["a"], None), pick(["qa", "qb"], ["qa", "qb", "qc"], None))
        some = lambda make: pick(None, [], [make()], [make(), None, make(), make()])
        rows.append((pick(1, 2, None), pick("A", "B", None), "C", n, f"s_{n}", pick(None, [n % 5]), "high", n % 9 == 0, False, "neutral", f"S{n}", pick(None, ["T  one", "t one", None]), pick(["x"], ["y", "x"]), *map(some, (entity, metric, claim, decision, risk, clash))))
    return spark.createDataFrame(rows, SCHEMA).select("*", F.lit("clash").alias("kind"), F.lit(1).alias("id"))


def shown(df):
    return sorted((r["v"] for r in df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("v")).collect()), key=str)


KEYS = ["doc_id", "section_name"]


@pytest.mark.parametrize("parts", [2, 5])
def test_any_split_merges_to_the_same_record(spark, parts):
    rows = children(spark)
    whole = shown(records.records(records.state(rows, KEYS, F.col("seg_no")), KEYS))
    split = [records.state(rows.where(F.pmod(F.hash("seg_no"), F.lit(parts)) == k), KEYS, F.col("seg_no")) for k in range(parts)]
    nested = records.merged(records.merged(*split[1:], keys=KEYS), split[0], split[0], keys=KEYS)
    assert shown(records.records(nested, KEYS)) == whole


def plain(rows):
    """Lists of one group by hand: what is told of entities, claims and clashes."""
    gist = lambda s: " ".join(s.split()).lower()
    claims, risks, values = {}, {}, {}
    for r in sorted(rows, key=lambda r: r["seg_no"]):
        for c in r["key_claims"] or []:
            if c:
                key = (c["polarity"], c["temporal_scope"], gist(c["text"]))
                held = claims.setdefault(key, [c, set()])
                held[1].update(c["entity_refs"] or [])
                if len(c["supporting_quote"] or "") > len(held[0]["supporting_quote"] or ""):
                    held[0] = c
        for c in r["risks"] or []:
            if c:
                key = (c["risk_category"], gist(c["text"]))
                risks[key] = max(risks.get(key, -1), {"low": 0, "high": 2, None: -1}[c["severity"]])
        for m in r["metrics"] or []:
            if m and m["numeric_value"] is not None:
                values.setdefault((gist(m["name"]), m["time_period"], m["unit"]), set()).add(m["numeric_value"])
    clashes = sum(len(v) > 1 for v in values.values())
    own = {gist(c["description"]) for r in rows for c in r["internal_contradictions"] or [] if c}
    return [[c["text"], c["supporting_quote"], sorted(names)] for c, names in claims.values()], {k: {2: "high", 0: "low", -1: None}[v] for k, v in risks.items()}, clashes + len(own)


def test_lists_by_hand(spark):
    rows = children(spark)
    got = {(r["doc_id"], r["section_name"]): r for r in records.section_records(rows).collect()}
    groups = {}
    for r in rows.collect():
        groups.setdefault((r["doc_id"], r["section_name"] or ""), []).append(r)
    assert set(got) == set(groups)
    for key, members in groups.items():
        claims, risks, clashes = plain(members)
        r = got[key]
        assert [[c["text"], c["supporting_quote"], c["entity_refs"]] for c in r["key_claims"]] == claims
        assert {(x["risk_category"], " ".join(x["text"].split()).lower()): x["severity"] for x in r["risks"]} == risks
        assert len(r["contradictions"]) == clashes
        names = [e["name"] for e in r["key_entities"]] + [a for e in r["key_entities"] for a in e["aliases"]]
        assert len(names) == len(set(names)) and all(e["name"] for e in r["key_entities"])
        assert r["segment_ids"] == [m["seg_id"] for m in sorted(members, key=lambda m: m["seg_no"])]


def test_conflicts_carry_up_and_unite(spark):
    metric = lambda value, quote: json.dumps({"metrics": [{"name": "Margin", "value_text": f"{value}%", "numeric_value": value, "unit": "percent", "time_period": "FY24", "supporting_quote": quote}]})
    kind = f"array<struct<{records._fields('metrics')}>>"
    rows = [(1, s, "C", n, metric(v, f"q{n}")) for n, (s, v) in enumerate([("A", 4.0), ("A", 5.0), ("B", 4.0), ("B", 6.0), ("E", 4.0)])]
    df = spark.createDataFrame(rows, "doc_id int, section_name string, chapter_name string, seg_no int, j string")
    df = df.select("*", F.from_json("j", f"metrics {kind}")["metrics"].alias("metrics"), F.concat(F.lit("s"), "seg_no").alias("seg_id"), F.array("seg_no").alias("pages"), F.lit("high").alias("ocr_confidence"), F.lit(False).alias("has_table"), F.lit(False).alias("has_figure"), F.lit("neutral").alias("sentiment"), F.lit("s").alias("summary")).drop("j")
    sections = records.section_records(df)
    assert {r["section_name"]: [c["statements"] for c in r["contradictions"]] for r in sections.collect()} == {"A": [["Margin: 4.0%", "Margin: 5.0%"]], "B": [["Margin: 4.0%", "Margin: 6.0%"]], "E": []}
    (chapter,) = records.chapter_records(sections).collect()
    (clash,) = chapter["contradictions"]
    assert clash["description"] == "Conflicting values of margin for FY24 in percent"
    assert sorted(set(clash["statements"])) == ["Margin: 4.0%", "Margin: 5.0%", "Margin: 6.0%"] and set(clash["supporting_quotes"]) >= {"q0", "q1", "q2", "q3"}
    assert len(chapter["metrics"]) == 1 and chapter["section_names"] == ["A", "B", "E"]


def test_empty_and_without_lists(spark):
    bare = spark.createDataFrame([], SCHEMA)
    assert records.section_records(bare).collect() == [] and records.chapter_records(records.section_records(bare)).collect() == []
    one = spark.createDataFrame([(1, None, None, 0, "s", None, None, None, None, None, None, ["t"])], "doc_id int, section_name string, chapter_name string, seg_no int, seg_id string, pages array<int>, ocr_confidence string, has_table boolean, has_figure boolean, sentiment string, summary string, topics array<string>")
    (r,) = records.section_records(one).collect()
    assert r["topics"] == ["t"] and r["metrics"] == [] and r["contradictions"] == [] and r["section_name"] == ""


def test_null_keys_and_names_of_entities(spark):
    rows = [(None, "Alpha", ["Al"]), (None, "Al", ["Alfa"]), (1, "Beta", ["B"]), (1, None, ["b"]), (1, None, None), (1, " ", [])]
    got = merge_entities(spark.createDataFrame(rows, "k long, name string, aliases array<string>"), ["k"])
    assert sorted(map(tuple, got.collect()), key=str) == [(1, "Beta", ["B", "b"]), (None, "Alpha", ["Al", "Alfa"])]
    assert merge_entities(spark.createDataFrame([], "k long, name string, aliases array<string>"), ["k"]).collect() == []


def test_contradictions_united(spark):
    rows = [(1, "Two  totals", ["a", "b"], ["qa", "qb"]), (1, "two totals", ["b", "c"], ["qb", "qc"])]
    (r,) = merge_contradictions(spark.createDataFrame(rows, "k int, description string, statements array<string>, supporting_quotes array<string>"), ["k"]).collect()
    assert r["statements"] == ["a", "b", "c"] and r["supporting_quotes"] == ["qa", "qb", "qc"]
