"""Sessions, model layers and the chain's own state."""

import json
import threading
from http.server import BaseHTTPRequestHandler, HTTPServer

import pytest
from pyspark.sql import functions as F

from brevira.operators import classify as C
from brevira.operators import models as M
from brevira.plans.compress import compress, notes_before_compaction
from brevira.plans.config import Config
from brevira.sources.adapters import automatic, to_adk, to_openai
from brevira.streaming.session import MESSAGES, STATE, Sessions, load
from tests.test_engine import messages

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()


def text(seed, n=60):
    return " ".join(WORDS[(seed * 7 + i * i * (seed + 3)) % len(WORDS)] + str((seed * 31 + i) % 97) for i in range(n))


def talk(conv, turns=6, size=200):
    return [(conv, i, "user" if i % 2 == 0 else "tool", f"user turn {i} of {conv}" if i % 2 == 0 else text(conv * 100 + i, size), None if i % 2 == 0 else "fetch") for i in range(turns)]


def test_answers_are_asked_one_by_one_where_a_batch_fails():
    def model(prompts, limits):
        if len(prompts) > 1 or prompts == ["bad"]:
            raise RuntimeError("no")
        return [p.upper() + str(n) for p, n in zip(prompts, limits, strict=True)]

    assert M.answers(model, ["a", None, "bad", "b"], [1, 2, 3, 4]) == ["A1", None, None, "B4"]
    assert M.answers(lambda p, n: [], ["a"], [1]) == [None]


def test_a_model_behind_a_chat_endpoint():
    class Handler(BaseHTTPRequestHandler):
        def do_POST(self):
            body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            said = f"{body['messages'][0]['content']} {body['max_tokens']}"
            got = {"content": [{"type": "text", "text": said}]} if self.path == "/a" else {"choices": [{"message": {"content": said}}]}
            self.send_response(200)
            self.end_headers()
            self.wfile.write(json.dumps(got).encode())

        def log_message(self, *args):
            pass

    server = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    url = f"http://127.0.0.1:{server.server_port}"
    assert M.answers(M.Posted(url + "/o", "m"), ["hi", "ho"], [7, 8]) == ["hi 7", "ho 8"]
    assert M.answers(M.Posted(url + "/a", "m", "anthropic"), ["hi"], [7]) == ["hi 7"]
    server.shutdown()
    assert M.answers(M.Posted("http://127.0.0.1:9/", "m", seconds=1), ["hi"], [7]) == [None]


def test_summaries_that_lose_something_are_not_taken(spark):
    long_ = "We looked at src/app/main.py and src/app/util.py and saw TypeError: cannot read the thing at all. " + text(1)
    good = "src/app/main.py and src/app/util.py raise TypeError when read."

    def model(prompts, limits):
        said = {"one": good, "two": "src/app/main.py and src/app/util.py do not work.", "three": "only src/app/main.py, TypeError remains", "four": "TypeError"}
        return [next((said[k] for k in said if p.rstrip().endswith(" " + k)), None) for p in prompts]

    rows = [(1, i, "assistant", f"{long_} {k}") for i, k in enumerate(["one", "two", "three", "four", "five"])] + [(1, 8, "assistant", "short one"), (1, 9, "user", "q")]
    out = {r.idx: r.content for r in M.summarised(C.classified(messages(spark, rows), 0), model).collect()}
    assert out[0] == good and out[8] == "short one"
    assert all(out[i] == rows[i][3] for i in (1, 2, 3, 4))


def test_scores_of_a_model_and_what_counts_without_them(spark):
    def model(prompts, limits):
        said = {"m0": 'sure: {"score": 9, "reason": "x"}', "m1": '{"score": 2}', "m2": '{"reason": "none"}', "m3": "no idea", "m4": '{"score": "high"}'}
        return [next(v for k, v in said.items() if p.endswith(k)) for p in prompts]

    rows = [(1, 0, "assistant", "text m0"), (1, 1, "assistant", "text m1"), (1, 2, "assistant", "text m2"), (1, 3, "assistant", "fix parser m3"), (1, 4, "assistant", "other m4"), (1, 9, "user", "q"), (2, 0, "assistant", "no task"), (2, 1, "user", "q")]
    tasks = spark.createDataFrame([(1, "fix the parser today")], "conv_id long, task string")
    out = {(r.conv_id, r.idx): round(r.relevance, 6) for r in M.scored(C.classified(messages(spark, rows), 0), tasks, model).collect()}
    assert out == {(1, 0): 0.9, (1, 2): 0.5, (1, 3): round(2 / 3, 6), (1, 9): 1.0, (2, 0): 0.5, (2, 1): 1.0}


def test_facts_of_a_model_must_be_in_the_text(spark):
    said = {"files": ["src/a/b.py — read", "src/not/there.py"], "errors": ["KeyError: x"], "decisions": ["we keep the parser"], "open_items": ["invented sentence of nothing"], "conclusions": ["ok", "Elephants everywhere"]}

    def model(prompts, limits):
        return ["```json\n" + json.dumps(said) + "\n```" if "first task" in p else "not json" for p in prompts]

    rows = [(1, 0, "user", "first task"), (1, 1, "assistant", "Read src/a/b.py, a keyerror. Then We keep the PARSER as is, elephants"), (1, 2, "user", "q"), (2, 0, "user", "other"), (2, 1, "assistant", "I'll use sqlite for this."), (2, 2, "user", "q")]
    out = M.facts(C.classified(messages(spark, rows), 1), model).collect()
    assert {(r.category, r.content) for r in out if r.conv_id == 1 and r.category not in ("INTENT", "ACTIVE_CONTEXT")} == {("FILES", "src/a/b.py — read"), ("ERRORS", "KeyError: x"), ("DECISIONS", "we keep the parser"), ("OUTCOMES", "Elephants everywhere")}
    assert {r.category for r in out if r.conv_id == 2} >= {"INTENT", "DECISIONS"}


def test_a_layer_that_fails_is_left_out_and_the_rest_goes_on(spark, monkeypatch):
    from brevira.plans import compress as P

    monkeypatch.setattr(P.S, "coalesced", lambda df, n: df.withColumn("content", F.raise_error(F.lit("broken layer"))))
    with pytest.warns(UserWarning, match="coalesce is left out"):
        r = compress(messages(spark, [*talk(1), (1, 6, "tool", text(101, 200)), (1, 7, "user", "last")]), Config(recent_turns=1, reorder=True))
    assert list(r.skipped) == ["coalesce"]
    log = {(x.layer, x.action, x.idx) for x in r.log.collect()}
    assert ("exact_dedup", "changed", 6) in log and not any(x[0] == "coalesce" for x in log)
    places = sorted((x.place, x.idx) for x in r.places.collect())
    assert [p for p, _ in places] == list(range(r.messages.count())) and places[-1][1] == 7


def test_sessions_on_a_stream_keep_state_and_expire(spark, tmp_path):
    source, root = tmp_path / "in", tmp_path / "state"
    schema = spark.createDataFrame([], MESSAGES).schema
    s = Sessions(spark, str(root), Config(recent_turns=1), window=2_000, reserve=0, ttl=None)
    for conv in (1, 2):
        messages(spark, talk(conv, 6, 200 if conv == 1 else 3)).select(*schema.names).coalesce(1).write.mode("append").parquet(str(source))
        s.run(spark.readStream.schema(schema).parquet(str(source)), str(tmp_path / "check"), str(tmp_path / "out")).awaitTermination()
    got = {(r.version, r.conv_id): r.action for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {(0, 1): "compressed", (1, 2): "buffered"}
    assert {r.conv_id: r.rows for r in s.listed(1).collect()}[2] == 6
    assert s.facts(1).where("conv_id = 1 and category = 'INTENT'").count() == 1
    was = {r.idx: r.original for r in s.expand(1, spark.range(6).selectExpr("1L as conv_id", "id as idx")).collect()}
    assert was and all(t == talk(1)[i][3] for i, t in was.items())
    assert s.report(1).where("conv_id = 1").first().saved > 0

    s.save(1, str(tmp_path / "saved"))
    with open(tmp_path / "saved" / "facts" / "bad.json", "w") as f:
        f.write("{broken\n")
    t = load(spark, str(tmp_path / "saved"), str(tmp_path / "state2"), keep_ratio=0.4)
    assert (t.config.keep_ratio, t.config.recent_turns, t.window) == (0.4, 1, 2_000)
    same = lambda df, name: sorted(map(tuple, df.select(*[c.strip().split(" ")[0] for c in STATE[name].split(",")]).collect()))
    assert same(t.facts(-1), "facts") == same(s.facts(1), "facts")
    assert same(t.state("seen", -1), "seen") == same(s.state("seen", 1), "seen") != []
    with pytest.raises(ValueError):
        t.configure(no_such=1)

    s.destroy(1, spark.createDataFrame([(2,)], "conv_id long"))
    assert {r.conv_id for r in s.listed(1).collect()} == {1}
    s.ttl = 10.0
    at = s.state("touched", 1).first()["at"]
    s.push(messages(spark, talk(3, 2, 3)), 2, now=at + 11)
    assert {r.conv_id for r in s.listed(2).collect()} == {3} and s.facts(2).where("conv_id = 1").count() == 0
    assert not (root / "buffer-00000000").exists() and (root / "buffer-00000001").exists()


def test_formats_are_found_and_come_back(spark):
    m = messages(spark, [(1, 0, "user", "hello"), (1, 1, "assistant", "hi there"), (2, 0, "user", "good day"), (2, 1, "tool", "12", "f", "c1")])
    records = to_openai(m.where("conv_id = 1")).unionByName(to_adk(m.where("conv_id = 2")))
    back = automatic(records, lambda x: x.withColumn("content", F.upper("content"))).collect()
    bodies = {r.conv_id: r.body for r in back}
    assert len(back) == 4 and "function_responses" in "".join(r.body for r in back if r.conv_id == 2) and "HI THERE" in "".join(r.body for r in back if r.conv_id == 1), bodies


def test_notes_before_compaction(spark):
    lines = [(1, 0, json.dumps({"role": "user", "content": "fix src/app/main.py"})), (1, 1, "{bad"), (1, 2, json.dumps({"role": "assistant", "content": "I'll use sqlite for this."})), (1, 3, json.dumps({"role": "user", "content": "go on"}))]
    out = notes_before_compaction(spark.createDataFrame(lines, "conv_id long, idx long, value string")).collect()
    assert len(out) == 1 and "fix src/app/main.py" in out[0].text and "sqlite" in out[0].text
