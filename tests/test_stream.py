"""The stream gives what the batch gives, however the events come."""

import json
import random

import pandas as pd
import pytest

from pagewright import catalogue
from pagewright.operators import traces
from pagewright.streaming import scopes

SF = "/root/testdata/sf0.001"


def streamed(spark, events, parts, folder, **how):
    """Latest update of each scope; ``parts`` are the files of one micro-batch each."""
    for n, part in enumerate(parts):
        spark.createDataFrame(part, events.schema).coalesce(1).write.json(f"{folder}/in/{n:03d}")
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).option("latestFirst", "false").json(f"{folder}/in/*")
    seen = []
    query = scopes.scope_updates(stream, **how).writeStream.foreachBatch(lambda df, n: seen.extend((n, r) for r in df.collect())).outputMode("update").option("checkpointLocation", f"{folder}/c").trigger(availableNow=True).start()
    query.awaitTermination(300)
    return {(r["run_id"], r["scope_id"]): r for _, r in sorted(seen, key=lambda x: x[0])}


def test_shuffled_and_repeated_events_give_the_batch_result(spark, tmp_path):
    events = catalogue.trace_events(spark, SF).where("run_id < 25")
    rows = events.collect()
    twice = rows + random.Random(1).sample(rows, len(rows) // 3)
    random.Random(2).shuffle(twice)
    got = streamed(spark, events, [twice[i::5] for i in range(5)], tmp_path, late="36500 days")
    want = {(r.run_id, r.scope_id): (r.kind, r.total_tokens, r.llm_calls) for r in traces.scope_usage(events).collect()}
    assert {k: (r["kind"], r["total_tokens"], r["llm_calls"]) for k, r in got.items()} == want
    answers = {r.run_id: r.final_answer for r in traces.final_answers(events).collect()}
    assert {r["run_id"]: r["final_answer"] for r in got.values() if r["scope_id"] == "supervisor"} == answers
    bad = {r["run_id"]: r["n"] for r in traces.bad_events(events).groupBy("run_id").count().withColumnRenamed("count", "n").collect()}
    assert {run: r["n_bad"] for (run, s), r in got.items() if s == "supervisor" and r["n_bad"]} == bad
    assert sum(r["n_dropped"] for (_, s), r in got.items() if s == "supervisor") == len(twice) - len(rows)


def event(seq, minute, kind, **more):
    base = {"run_id": 1, "seq": seq, "ts": pd.Timestamp("2024-01-01") + pd.Timedelta(minutes=minute), "kind": kind, "name": None, "call_id": None, "parent_ids": None, "input_tokens": None, "output_tokens": None, "total_tokens": None, "answer": None}
    return base | more


class State:
    """A map or value state without a stream."""

    def __init__(self):
        self.held = {}

    def containsKey(self, key):  # noqa: N802
        return key in self.held

    def getValue(self, key):  # noqa: N802
        return self.held[key]

    def updateValue(self, key, value):  # noqa: N802
        self.held[key] = value

    def removeKey(self, key):  # noqa: N802
        del self.held[key]

    def iterator(self):
        return iter(list(self.held.items()))

    def exists(self):
        return bool(self.held)

    def get(self):
        return self.held[()]

    def update(self, value):
        self.held[()] = value

    def clear(self):
        self.held.clear()


class Handle:
    def __init__(self):
        self.states, self.timers = {}, set()

    def getMapState(self, name, *_):  # noqa: N802
        return self.states.setdefault(name, State())

    getValueState = getMapState  # noqa: N815

    def registerTimer(self, at):  # noqa: N802
        self.timers.add(at)


class Expired:
    def __init__(self, at):
        self.at = at

    def getExpiryTimeInMs(self):  # noqa: N802
        return self.at


@pytest.fixture
def runs():
    made, handle = scopes.Runs(idle=3_600_000), Handle()
    made.init(handle)
    return made, handle


def take(runs, *events):
    (out,) = runs[0].handleInputRows((1,), iter([pd.DataFrame(list(events))]), None)
    return {r["scope_id"]: r for r in out.to_dict("records")}


def expire(runs, minute):
    at = int((pd.Timestamp("2024-01-01") + pd.Timedelta(minutes=minute)).timestamp() * 1000)
    return [r for out in runs[0].handleExpiredTimer((1,), None, Expired(at)) for r in out.to_dict("records")], at


def test_a_call_that_comes_late_still_gets_its_tokens(runs):
    spent = event(2, 1, "model_end", parent_ids=["c1"], input_tokens=5, output_tokens=2, total_tokens=7)
    assert take(runs, spent)["supervisor"]["total_tokens"] == 0
    got = take(runs, event(1, 0, "tool_start", name="lookup", call_id="c1"))
    assert got["lookup_agent_call_1"]["total_tokens"] == 7 and got["supervisor"]["total_tokens"] == 0
    assert take(runs, spent)["supervisor"]["n_dropped"] == 1
    got = take(runs, event(3, 2, "tool_end", call_id="c1"), event(4, 3, "model_end", parent_ids=["c1"], total_tokens=1))
    assert got["supervisor"]["total_tokens"] == 1 and not got["lookup_agent_call_1"]["open"]
    assert not runs[1].states["opened"].held and not runs[1].states["waiting"].held


def test_a_gap_is_given_up_when_the_watermark_passes(runs):
    take(runs, event(3, 5, "model_end", total_tokens=3), event(4, 9, "model_end", total_tokens=4))
    assert len(runs[1].timers) == 3  # two that wait, and the time of the run itself
    out, at = expire(runs, 5)
    assert at in runs[1].timers and [r["total_tokens"] for r in out] == [7]
    assert take(runs, event(1, 0, "model_end", total_tokens=100))["supervisor"]["n_dropped"] == 1


def test_state_goes_when_the_run_is_idle(runs):
    take(runs, event(1, 0, "finalize", answer="a"))
    assert expire(runs, 30)[0] == [] and runs[1].states["meta"].held
    assert expire(runs, 60)[0] == [] and not any(s.held for s in runs[1].states.values())


def test_events_that_can_not_be_read(runs):
    odd = [event(None, 0, "model_end"), event(1, 0, "nonsense"), event(2, 0, None), event(3, 0, "tool_end", call_id="unknown"), event(4, 0, "tool_start", name="lookup"), event(5, 0, "model_end", parent_ids=[None, "x"]), event(6, 0, "finalize")]
    got = take(runs, *odd)
    assert got["supervisor"]["n_bad"] == 3 and got["supervisor"]["llm_calls"] == 1 and json.dumps(got["supervisor"]["final_answer"]) == "null"
