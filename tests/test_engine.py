"""Operators on hand-written rows."""

import math
import random
import re
from collections import Counter

import pytest

from brevira.functions import constants as K
from brevira.operators import structure as J
from brevira.plans.config import Config, preset, reconfigured


def messages(spark, rows):
    from brevira.sources.messages import shaped

    ddl = "conv_id long, idx long, role string, content string, name string, tool_call_id string, call_id string, compressed boolean"
    return shaped(spark.createDataFrame([(r + (None,) * 8)[:8] for r in rows], ddl))


def classes(spark, rows, recent=1):
    from brevira.operators.classify import classified

    return {r.idx: r.ctype for r in classified(messages(spark, rows), recent).collect()}


def test_classes_in_rule_order(spark):
    trace = "Traceback (most recent call last)\n  File \"a.py\", line 1\n  File \"b.py\", line 2\nraise ValueError"
    got = classes(spark, [(1, 0, "system", "s"), (1, 1, "user", "hi"), (1, 2, "assistant", "plan"), (1, 3, "tool", trace), (1, 4, "tool", ' {"a": 1}'), (1, 5, "tool", "x", "read_file"), (1, 6, "tool", "12"), (1, 7, "user", "q"), (1, 8, "user", "last"), (1, 9, "tool", "after")])
    assert got == {1: "OLD_CONVERSATION", 2: "ASSISTANT_REASONING", 3: "ERROR_TRACE", 4: "TOOL_RESULT_JSON", 5: "CODE_BLOCK", 6: "TOOL_RESULT_TEXT", 7: "OLD_CONVERSATION", 8: "USER_QUERY", 9: "RECENT_TURN"}


def test_fewer_users_than_recent_turns(spark):
    got = classes(spark, [(1, 0, "assistant", "a"), (1, 1, "assistant", "b"), (1, 2, "user", "c")], recent=5)
    assert got == {0: "ASSISTANT_REASONING", 1: "RECENT_TURN", 2: "USER_QUERY"}


def test_no_recent_turns(spark):
    assert classes(spark, [(1, 0, "user", "c"), (1, 1, "assistant", "b")], recent=0) == {0: "USER_QUERY", 1: "ASSISTANT_REASONING"}


def test_empty_table(spark):
    from brevira.operators.classify import class_totals, classified

    assert class_totals(classified(messages(spark, []))).count() == 0


def test_exact_dedup_counts_empty_texts_as_copies(spark):
    from brevira.operators.classify import classified
    from brevira.operators.dedup import exact

    out, edges = exact(classified(messages(spark, [(1, 0, "tool", "a  b"), (1, 1, "assistant", ""), (1, 2, "assistant", ""), (1, 3, "tool", " a b"), (1, 9, "user", "q")]), 1))
    assert {(e.src, e.dst) for e in edges.collect()} == {(2, 1), (3, 0)}
    assert {r.idx: r.content for r in out.collect()}[3].endswith("See message #0.]")


def test_packing_starts_anew_on_overflow(spark):
    from pyspark.sql import functions as F

    from brevira.operators.dedup import packed

    parts = [" ".join(["w"] * n) for n in (120, 90, 60, 300, 10)]
    got = spark.createDataFrame([(parts,)], "p array<string>").select(packed(F.col("p"), "\n\n").alias("c")).first().c
    assert [len(c.split()) for c in got] == [120, 150, 300, 10]


def test_coalesce_keeps_short_runs(spark):
    from brevira.operators.classify import classified
    from brevira.operators.coalesce import coalesced

    rows = classified(messages(spark, [(1, 0, "user", "old"), (1, 1, "assistant", "a"), (1, 2, "assistant", " "), (1, 3, "assistant", "b!"), (1, 4, "user", "q")]), 1)
    got = {r.idx: r.content for r in coalesced(rows.where("not protected")).collect()}
    assert got == {0: "old", 1: "[Assistant notes: a. b!]"}


def test_importance_against_plain_python(spark):
    from brevira.operators.classify import classified
    from brevira.operators.importance import scored

    texts = ["see src/app/main.py port 8080", "You must never do that", "maybe later", "plain words here"]
    rows = [(1, i, "assistant", t) for i, t in enumerate(texts)] + [(1, 9, "user", "q")]
    got = {r.idx: r.importance for r in scored(classified(messages(spark, rows), 1).where("not protected")).collect()}
    n, docs = len(texts), [[w for w in re.findall(r"\w+", t.lower()) if w not in K.STOP_WORDS] for t in texts]
    for i, t in enumerate(texts):
        words = docs[i]
        idf = {w: math.log((n + 1) / (sum(w in d for d in docs) + 1)) + 1 for w in words}
        tfidf = min(sum(words.count(w) / len(words) * idf[w] for w in set(words)) / max(len(set(words)), 1), 1) if words else 0
        dense = lambda p: min(len(re.findall(p, t)) / len(t.split()), 1)  # noqa: B023, E731
        ins = next((s for p, s in ((K.ABSOLUTE, 1.0), (K.IMPERATIVE, 0.7), (K.CONDITIONAL, 0.5), (K.HEDGED, 0.2)) if re.search(p, t)), 0.0) * 0.6
        want = dense(K.ENTITIES) * 0.15 + dense(K.NUMBERS) * 0.10 + ins * 0.15 + 0.15 / (1 + 0.1 * (n - 1 - i)) + tfidf * 0.15
        assert got[i] == pytest.approx((max(want, 0.75) if ins >= 0.7 else want) * 0.95)


def test_budget_drops_the_least_relevant_first(spark):
    from pyspark.sql import functions as F

    from brevira.operators.budget import within
    from brevira.operators.classify import classified

    rows = classified(messages(spark, [(1, i, "assistant", "x" * 350) for i in range(5)] + [(1, 9, "user", "q")]), 1).withColumn("relevance", F.col("idx") % 3 / 3)
    kept = within(rows, spark.createDataFrame([(1, 301)], "conv_id long, budget long"))
    assert sorted(r.idx for r in kept.collect()) == [1, 2, 4, 9]


def test_orphans_go(spark):
    from brevira.operators.budget import intact

    got = {r.idx: r.tool_calls for r in intact(messages(spark, [(1, 0, "assistant", "", None, None, "a"), (1, 1, "tool", "x", None, "a"), (1, 2, "tool", "y", None, "b"), (1, 3, "assistant", "", None, None, "c")])).collect()}
    assert sorted(got) == [0, 1, 3] and got[0] and got[3] is None


def test_json_and_signatures():
    assert "more items, each with keys: a, b" in J.shrink_json('[{"a":1,"b":2},{"a":1,"b":2},{"a":1,"b":2},{"a":1,"b":2}]', 3)
    assert J.shrink_json("not json") == "not json"
    assert "def f(x)" in J.signatures("import os\n\ndef f(x):\n    y = g(x)\n    z = y + 1\n    return h(z) + y + z + 1\n") and "return" not in J.signatures("def f(x):\n    y = 1\n    y = 2\n    y = 3\n    y = 4\n    return y\n")


def test_config():
    assert preset("coding").recent_turns == 3 and Config(model="gpt-4o").token_budget == 80_000
    with pytest.raises(ValueError):
        preset("nothing")
    with pytest.raises(ValueError):
        reconfigured(Config(), nothing=1)
    with pytest.raises(ValueError):
        Config(token_budget=5)


def test_adapters_keep_every_row_and_call(spark):
    from brevira.plans.queries import QUERIES
    from brevira.sources import adapters as A
    from brevira.sources.messages import derived

    call = lambda k: {"id": f"c{k}", "type": "function", "name": "read_file", "arguments": f'{{"path": "a{k}"}}'}
    rows = [(1, 0, "user", "q", None, None), (1, 1, "assistant", "", None, [call(1), call(2)]), (1, 2, "tool", "t1", "c1", None), (1, 3, "tool", "t2", "c2", None), (1, 4, "assistant", "text too", None, [call(3)])]
    m = spark.createDataFrame(rows, f"conv_id long, idx long, role string, content string, tool_call_id string, tool_calls {A.CALLS}")
    m = A.shaped(m)
    want = {(r.idx, r.role, r.content, r.tool_call_id, str(r.tool_calls)) for r in m.collect()}
    sf = "/root/testdata/sf0.001"
    whole = derived(spark, sf)
    n, n_calls = whole.count(), whole.where("size(tool_calls) > 0").count()
    for name, (into, out) in A.ADAPTERS.items():
        assert {(r.idx // A.SPREAD, r.role, r.content, r.tool_call_id, str(r.tool_calls)) for r in into(out(m)).collect()} == want
        assert A.detected(out(m)).first().framework == name
        back = QUERIES[f"adapter_{name}"](spark, sf)
        assert back.count() == n and back.where("calls <> ''").count() == n_calls > 0


def test_pressure_sets_the_layers(spark):
    from brevira.plans.compress import compress

    rng = random.Random(5)
    text = lambda: "\n".join(" ".join("".join(rng.choices("abcdefghijklmnop", k=7)) for _ in range(12)) for _ in range(5))
    texts = [(c, i, "user" if i % 2 else "tool", f"user turn {i} asks for the state" if i % 2 else text(), "fetch") for c in (2, 3, 4) for i in range(12)]
    windows = spark.createDataFrame([(2, 12_000, 0, 6_600), (3, 12_000, 0, 11_400), (4, 120_000, 0, 0)], "conv_id long, window long, reserve long, usage long")
    r = compress(messages(spark, texts), Config(recent_turns=2), windows=windows)
    out = {(x.conv_id, x.idx): x.content for x in r.messages.collect()}
    was = {(t[0], t[1]): t[3] for t in texts}
    assert all(out[4, i] == was[4, i] for i in range(12))  # NONE
    assert all(out[2, i] == was[2, i] for i in range(0, 8, 2))  # LOW: no pruning of words
    assert sum(len(t) for (c, _), t in out.items() if c == 3) < sum(len(t) for (c, _), t in out.items() if c == 2) / 2  # CRITICAL: masked, pruned, in its budget


def test_near_copies_of_texts_in_brackets(spark):
    from brevira.operators.classify import classified
    from brevira.operators.dedup import exact
    from brevira.plans.compress import near_edges

    array = lambda n: "[" + ", ".join(f'{{"id": {i}, "name": "row{i}"}}' for i in range(n)) + "]"
    log = "[2026-01-01 10:00:00] started the loader and read all rows of the table in one pass"
    rows = [(1, 0, "tool", array(40)), (1, 1, "tool", array(41)), (1, 2, "tool", array(40)), (1, 3, "tool", log + " a"), (1, 4, "tool", log + " b"), (1, 9, "user", "q")]
    work, edges = exact(classified(messages(spark, rows), 1).where("not protected"))
    assert {(e.src, e.dst) for e in edges.collect()} == {(2, 0)}
    assert {(e.src, e.dst) for e in near_edges(work, edges, 0.8).collect()} == {(0, 1), (3, 4)}


def test_near_cosine_all_against_plain_python(spark):
    from brevira.plans.queries import QUERIES, work

    sf = "/root/testdata/sf0.001"
    got = {(r.conv_id, r.src): (r.dst, r.similarity) for r in QUERIES["near_cosine_all"](spark, sf).collect()}
    groups = {}
    for r in work(spark, sf).where("policy not in ('PRESERVE', 'LIGHT')").collect():
        groups.setdefault((r.conv_id, r.ctype), []).append((r.idx, Counter(re.findall(r"\w+", r.content.lower()))))
    want, close = {}, set()
    for (conv, _), rows in groups.items():
        n, vectors = len(rows), []
        df = Counter(w for _, c in rows for w in c)
        for idx, c in sorted(rows, key=lambda x: x[0]):
            v = {w: k / sum(c.values()) * (math.log((n + 1) / (df[w] + 1)) + 1) for w, k in c.items()}
            norm = math.sqrt(sum(x * x for x in v.values()))
            vectors.append((idx, {w: x / norm for w, x in v.items()}))
        for i, (src, a) in enumerate(vectors):
            for dst, b in vectors[i + 1 :]:
                s = sum(x * b.get(w, 0.0) for w, x in a.items())
                if abs(s - 0.8) < 1e-6:
                    close.add((conv, src))
                if s >= 0.8:
                    want.setdefault((conv, src), (dst, s))
    assert got.keys() - close == want.keys() - close and all(got[k][0] == want[k][0] and got[k][1] == pytest.approx(want[k][1], abs=2e-6) for k in want.keys() - close)
    assert {t for (_, t), rows in groups.items() if len(rows) > 1} - {"TOOL_RESULT_TEXT", "CODE_BLOCK"}


def test_sql_names_are_queries():
    from brevira.plans.queries import QUERIES, SQL

    assert set(SQL) <= set(QUERIES)
