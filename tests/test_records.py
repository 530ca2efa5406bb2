"""Reductions, store verbs, plans, payloads and traces."""

import random

from pyspark.sql import Row
from pyspark.sql import functions as F

from pagewright.operators import payloads, reduce, store, traces
from pagewright.plans import planner
from pagewright.streaming import scopes

from .test_stream import State


def got(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=str)


def test_reduction(spark):
    schema = "doc_id int, seg_no int, seg_id string, section_name string, chapter_name string, pages array<int>, ocr_confidence string, has_table boolean, has_figure boolean, sentiment string, summary string, topics array<string>, salient_quotes array<string>"
    rows = [
        (1, 10, "s_010", "S", "late", [3, 2], "high", False, None, "positive", "two.", ["Risk  A", "b"], ["q2"]),
        (1, 2, "s_002", "S", "early", [2, 1], "low", True, None, "negative", "one.", ["risk a"], ["q1"]),
        (1, 3, "s_003", None, None, None, "medium", None, None, "neutral", None, None, None),
    ]
    sections = reduce.reduce_sections(spark.createDataFrame(rows, schema))
    by = {r.section_name: r for r in sections.collect()}
    s = by["S"]
    assert (s.chapter_name, s.pages, s.segment_ids, s.ocr_confidence, s.has_table, s.has_figure, s.sentiment, s.summary, s.salient_quotes) == ("early", [1, 2, 3], ["s_002", "s_010"], "low", True, False, "mixed", "one. two.", ["q1", "q2"])
    assert s.topics == ["risk a", "b"] and by[""].pages == [] and by[""].chapter_name == ""
    chapters = reduce.reduce_chapters(sections.withColumn("chapter_name", F.lit("c"))).first()
    assert chapters.section_names == ["S", ""] and chapters.ocr_confidence == "low"


def test_entities_join_over_aliases(spark):
    rows = [(1, "Acme", ["ACM"]), (1, "Acme Corporation", ["acm", "Old Co"]), (1, "old co", None), (1, "Other", []), (2, "Acme", [])]
    found = reduce.merge_entities(spark.createDataFrame(rows, "doc_id int, name string, aliases array<string>"), ["doc_id"])
    assert got(found, "doc_id", "name", "aliases") == [(1, "Acme Corporation", ["ACM", "Acme", "Old Co", "acm", "old co"]), (1, "Other", []), (2, "Acme", [])]


def test_claims_decisions_contradictions(spark):
    claims = spark.createDataFrame([(1, "Sales  rose", "pos", "2024", "short"), (1, "sales rose", "pos", "2024", "longer quote"), (1, "sales rose", "neg", "2024", "x")], "doc_id int, text string, polarity string, temporal_scope string, supporting_quote string")
    assert got(reduce.dedup_claims(claims, ["doc_id"]), "polarity", "supporting_quote") == [("neg", "x"), ("pos", "longer quote")]
    decisions = spark.createDataFrame([(1, "Buy it", "a"), (1, "buy  IT", "a")], "doc_id int, text string, decision_type string")
    assert reduce.dedup_decisions(decisions, ["doc_id"]).count() == 1
    both = spark.createDataFrame([(1, "D", ["a"], ["qa"]), (1, "d", ["b", "a"], ["qb", "qa"])], "doc_id int, description string, statements array<string>, supporting_quotes array<string>")
    assert got(reduce.merge_contradictions(both, ["doc_id"]), "statements", "supporting_quotes") == [(["a", "b"], ["qa", "qb"])]
    risks = spark.createDataFrame([(1, "r", "c", None), (1, "R", "c", "low"), (1, "r ", "c", "high"), (1, "s", "c", None)], "doc_id int, text string, risk_category string, severity string")
    assert got(reduce.escalate_risks(risks, ["doc_id"]), "gist", "severity", "n_merged") == [("r", "high", 3), ("s", None, 1)]


def test_validation_digest(spark):
    rows = spark.createDataFrame([("low", "mixed", "s"), ("LOW", None, None)], "ocr_confidence string, sentiment string, summary string")
    errors = [r.errors for r in reduce.unconfirmed(rows).collect()]
    assert errors == [[], ["ocr_confidence", "sentiment", "summary"]]
    digest = spark.createDataFrame([(["a", "b", "c", "d", "e"],), (["a"],)], "e array<string>").select(reduce.error_digest("e")).collect()
    assert [d[0] for d in digest] == ["a; b; c (+2 more)", "a"]


def test_store(spark):
    old = spark.createDataFrame([(1, "a", "kept"), (2, "b", "x"), (None, "n", "y")], "id int, name string, extra string")
    new = spark.createDataFrame([(1, "A", 9), (3, None, 7), (None, "N", 1)], "id int, name string, n int")
    once = store.upsert(old, new, ["id"])
    want = [(1, "A", "kept", 9), (2, "b", "x", None), (3, None, None, 7), (None, "N", "y", 1)]
    assert got(once, "id", "name", "extra", "n") == want
    assert got(store.upsert(once, new, ["id"]), "id", "name", "extra", "n") == want
    assert got(store.missing_work(new, old, ["id"]), "id") == [(3,), (None,)]
    assert got(store.duplicates(old.union(old.limit(1)), ["id"]), "n") == [(2,)]
    assert store.get_record(old, id=2).first().name == "b" and store.get_record(old, id=5).first() is None


def test_plan_cap_comes_before_check(spark):
    tasks = spark.createDataFrame([(1, 1, n, "bad" if n in (1, 2, 3) else f"S{n}") for n in range(1, 13)], "question_id int, doc_id int, task_no int, section_name string")
    sections = spark.createDataFrame([(1, f"S{n}") for n in range(1, 13)], "doc_id int, section_name string")
    assert planner.valid_tasks(tasks, sections, 10).count() == 7
    assert planner.dropped_tasks(tasks, sections, 10).count() == 3
    assert planner.valid_tasks(tasks.where("false"), sections, 10).count() == 0
    questions = spark.createDataFrame([(1, 1, "capital growth plans"), (2, 1, "list all capital plans"), (3, 9, "capital")], "question_id int, doc_id int, question string")
    named = spark.createDataFrame([(1, "Capital plans", "growth of capital"), (1, "People", "staff")], "doc_id int, section_name string, summary string")
    assert got(planner.plan(questions, named), "question_id", "section_name", "score") == [(1, "Capital plans", 3)]


def test_payloads(spark):
    texts = ['{"question": "q", "document_id": "d"}', ' {"other": 1} ', "plain", '{"question": ', None, '{"run_id": "r"}']
    rows = spark.createDataFrame([(i, "user", t) for i, t in enumerate(texts)] + [(9, "assistant", texts[0])], "i int, role string, text string")
    found = {r.i: (r.is_payload, r.question, r.document_id, r.error is None) for r in payloads.run_inputs(rows, {"document_id": None, "run_id": "s"}).collect()}
    assert found[0] == (True, "q", "d", True) and found[1][0] is False and found[2] == (False, "plain", None, False)
    assert found[3][0] is False and found[4] == (False, None, None, False) and found[5][:2] == (True, None) and found[9][0] is False


def test_batch_equals_the_state_machine(spark):
    rng, rows = random.Random(3), []
    for run in range(12):
        calls = []
        for seq in range(1, 60):
            kind = rng.choice(["tool_start", "tool_start", "tool_end", "model_end", "model_end", "finalize", "junk"])
            call = f"c{rng.randint(1, 30)}" if kind == "tool_end" else f"c{run}_{seq}" if kind == "tool_start" else None
            if kind == "tool_end" and calls and rng.random() < 0.7:
                call = rng.choice(calls)
            parents = rng.sample(calls, min(len(calls), rng.randint(0, 3)))
            name = rng.choice(["lookup", "grep", "plan_sections", "run_lookup_worker"])
            rows.append(Row(run_id=run, seq=seq, ts=None, kind=kind, name=name, call_id=call, parent_ids=parents, input_tokens=seq, output_tokens=1 if seq % 3 else None, total_tokens=seq + 1, answer=f"a{seq}" if kind == "finalize" else None))
            if kind == "tool_start":
                calls.append(call)
    schema = "run_id long, seq int, ts timestamp, kind string, name string, call_id string, parent_ids array<string>, input_tokens long, output_tokens long, total_tokens long, answer string"
    events = spark.createDataFrame(rows, schema)
    batch = {(r.run_id, r.scope_id): (r.kind, r.input_tokens, r.output_tokens, r.total_tokens, r.llm_calls) for r in traces.scope_usage(events).collect()}
    want = {}
    for run in range(12):
        state = scopes.Run(scopes.FRESH, *(scopes.Kept(State()) for _ in range(3)))
        for r in rows:
            if r.run_id == run:
                state.take(r.asDict())
        want |= {(run, scope): tuple(x[:5]) for scope, x in state.scopes.held.items() if x}
        assert traces.final_answers(events.where(f"run_id = {run}")).first().final_answer == state.answer
    assert batch == want
    totals = {r.run_id: r.total_tokens for r in traces.run_totals(traces.scope_usage(events)).collect()}
    assert totals[0] == sum(v[3] for (run, _), v in want.items() if run == 0)


def test_scope_tree_order(spark):
    rows = [(1, "supervisor", "supervisor", None, 0)] + [(1, f"s{n}", "k", "supervisor" if n != 3 else "s2", n) for n in range(1, 12)]
    parents = spark.createDataFrame(rows, "run_id int, scope_id string, kind string, parent_scope_id string, order_no int")
    assert [r.scope_id for r in traces.scope_tree(parents).orderBy("place").collect()] == ["supervisor", "s1", "s2", "s3", *(f"s{n}" for n in range(4, 12))]
