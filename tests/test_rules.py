"""Rules without SQL of their own against plain Python, on whole small tables and on hand-written rows."""

import math
import re
from collections import Counter

import pytest

from brevira.functions import constants as K
from brevira.operators import dedup as D
from brevira.operators import facts as X
from brevira.operators import lines as L
from brevira.operators import structure as J
from brevira.plans.queries import QUERIES, work

SF = "/root/testdata/sf0.001"


def test_cleaned_rows_against_the_chain_of_rules(spark):
    odd = ["", "\n\n\n", "a\r\n\r\nb", "\n".join(f"row {i} 'x{i}' done" for i in range(9)), "\n".join(f"line number{'x' * i} of text" for i in range(150)), "-----\n=====\nMIT License\n\n\n# -*- coding: x\naaaa", "é \n \n \nb"]
    rows = spark.createDataFrame([(1, i, t, p) for i, t in enumerate(odd) for p in ["MODERATE"]] + [(2, 0, "a\n\n\nb", "PRESERVE")], "conv_id long, idx long, content string, policy string")
    for df in (rows, work(spark, SF)):
        one, other = ({(r.conv_id, r.idx): r.content for r in f(df).select("conv_id", "idx", "content").collect()} for f in (L.cleaned, L.cleaned_by_lines))
        assert one == other and len(one) > 5


def test_fences_are_rewritten_in_place():
    body = "def f(x):\n    y = x + 1\n    z = y * 2\n    return z + y + x + 1000\n"
    text = f"before\n```python\n{body}```\nbetween\n```\nplain words\n```\nafter\n```js\nfunction g(a) {{\n  return a + 1 + 2 + 3 + 4;\n}}\n```\nend"
    got = J.signatures(text)
    assert got.startswith("before\n```python\ndef f(x):") and "return" not in got and "\nbetween\n```\nplain words\n```\nafter\n" in got and "function g(a) { ... }" in got and got.endswith("```\nend")


def words_of(text):
    return re.findall(r"\w+", text.lower())


def test_pruned_words_against_plain_python(spark):
    rows = work(spark, SF).select("conv_id", "idx", "content", "policy").collect()
    n = Counter(r.conv_id for r in rows)
    df = Counter((r.conv_id, w) for r in rows for w in set(words_of(r.content)))
    keep_word = re.compile("^(?:" + "|".join(f"(?:{p})" for p in K.KEPT_WORDS) + ")$", re.ASCII)
    space = re.compile(r"\s+", re.ASCII)

    def prune(conv, line):
        words = space.split(line.strip(" \t\n\x0b\f\r"))
        if words == [""]:
            return line
        score = [math.log((n[conv] + 1) / (df[conv, w.lower()] + 1)) + 1 if (conv, w.lower()) in df else 1.0 for w in words]
        keep = max(1, int(len(words) * 0.5))
        if keep >= len(words):
            return line
        least = sorted(score)[len(words) - keep]
        return " ".join(w for w, x in zip(words, score, strict=True) if keep_word.match(w) or x >= least - 1e-12)

    import hashlib

    got = {(r.conv_id, r.idx): r.content_sha256 for r in QUERIES["token_prune"](spark, SF).collect()}
    assert len(got) == len(rows)
    for r in rows:
        text = "\n".join(prune(r.conv_id, x) for x in r.content.split("\n")) if r.policy in ("MODERATE", "AGGRESSIVE") else r.content
        assert got[r.conv_id, r.idx] == hashlib.sha256(text.encode()).hexdigest(), (r.conv_id, r.idx)


def test_minhash_pairs_against_exact_similarity(spark):
    groups = {}
    for r in work(spark, SF).where("policy not in ('PRESERVE', 'LIGHT')").collect():
        t = r.content.strip(" \t\n\x0b\f\r").lower()
        groups.setdefault((r.conv_id, r.ctype), []).append((r.idx, {t[i : i + 5] for i in range(max(len(t) - 4, 1))}))
    got = {(r.conv_id, r.src): r.dst for r in QUERIES["near_minhash"](spark, SF).collect()}
    for (conv, _), rows in groups.items():
        rows.sort(key=lambda x: x[0])
        for i, (src, a) in enumerate(rows):
            later = [(dst, len(a & b) / len(a | b)) for dst, b in rows[i + 1 :]]
            if any(s > 0.95 for _, s in later):  # estimates scatter by about 0.035
                assert (conv, src) in got
            if (conv, src) in got:
                assert dict(later)[got[conv, src]] > 0.6


def test_chunks_against_plain_python(spark):
    def packed(parts, most=200):
        out, now, n = [], None, 0
        for p in parts:
            w = len(p.split())
            if now is not None and n + w > most:
                out.append(now)
                now, n = p, w
            else:
                now, n = p if now is None else now + "\n\n" + p, n + w
        return [*out, now] if now is not None else out

    shared = " ".join(f"s{i}" for i in range(150))
    own = lambda k: " ".join(f"{k}w{i}" for i in range(180))
    texts = [f"{own('a')}\n\n{shared}\n\n{own('b')}", f"{shared}\n\n{own('c')}", "short", f"{own('d')}\n \n{shared}\n\n{own('a')}"]
    rows = spark.createDataFrame([(1, i, t, "AGGRESSIVE", "TOOL_RESULT_TEXT") for i, t in enumerate(texts)], "conv_id long, idx long, content string, policy string, ctype string")
    seen, want = {}, {}
    for i, t in enumerate(texts):
        chunks = packed(re.split(r"\n\s*\n", t)) if len(t.split()) >= 200 else [t]
        if len(chunks) > 1:
            new = []
            for c in chunks:
                k = " ".join(c.split())
                new.append(f"[Duplicate chunk — see message {seen[k][0]}: {seen[k][1][:60].strip()}]" if k in seen else c)
                seen.setdefault(k, (i, c))
            t = "\n\n".join(new) if new != chunks else t
        want[i] = t
    assert {r.idx: r.content for r in D.chunked(rows, least_words=200).collect()} == want and sum("Duplicate chunk" in t for t in want.values()) >= 2


def test_argument_facts_and_their_order(spark):
    import json

    got = X.argument_facts(json.dumps({"path": "src/app/main.py", "deep": [{"order": "ORD-12345", "u": "see https://x.org/a now"}], "id": "123e4567-e89b-12d3-a456-426614174000"}), "edit_file", 3)
    assert {"category": "IDENTIFIERS", "content": "ID: ORD-12345 (order)", "confidence": 0.9} in got and any(f["content"] == "URL: https://x.org/a" for f in got) and any(f["content"].startswith("UUID: 123e4567") and f["content"].endswith("(id)") for f in got)
    assert any(f["content"].startswith("src/app/main.py — ") for f in got) and X.argument_facts("not json but src/a.py here", None, 1)[0]["content"] == "src/a.py — referenced at turn 1"
    many = [("c" + str(k), "function", "read", json.dumps([f"ORD-{10000 + 100 * k + i}" for i in range(60)])) for k in range(70)]
    rows = spark.createDataFrame([(1, 1, "assistant", "I'll use plain files.", None, None, many, None, False, "ASSISTANT_REASONING", "MODERATE", False)], "conv_id long, idx long, role string, content string, name string, tool_call_id string, tool_calls array<struct<id:string,type:string,name:string,arguments:string>>, metadata string, compressed boolean, ctype string, policy string, protected boolean")
    facts = X.extracted(rows).collect()
    ids = [f.content for f in sorted(facts, key=lambda f: f.seq) if f.content.startswith("ID: ")]
    assert len({f.seq for f in facts}) == len(facts) and ids == [f"ID: ORD-{10000 + 100 * k + i}" for k in range(70) for i in range(60)]


def test_masks_against_plain_python(spark):
    text = "\n".join(f"plain line {i} of the result" for i in range(30)) + "\nkeep NEEDLE here"
    rows = spark.createDataFrame([(1, i, text, "fetch", "TOOL_RESULT_TEXT", False) for i in range(3)] + [(1, 9, "short", "fetch", "TOOL_RESULT_TEXT", False)], "conv_id long, idx long, content string, name string, ctype string, protected boolean")
    needles = spark.createDataFrame([(1, ["needle"])], "conv_id long, needles array<string>")
    got = {r.idx: r.content for r in L.masked(rows, needles, least_results=2, least_chars=200).collect()}
    assert got[9] == "short" and got[0] == '[Tool: fetch("plain line 0 of the result") — 31 lines]\nKey: plain line 0 of the result | plain line 1 of the result ... keep NEEDLE here\nPreserved: keep NEEDLE here'
    assert L.masked(rows, needles, least_results=20, least_chars=200).where("content like '[Tool%'").count() == 0


@pytest.mark.parametrize("name", ["tool_integrity", "decision_log"])
def test_sql_of_whole_tables(spark, name):
    import duckdb

    from brevira.plans.queries import SQL

    con = duckdb.connect()
    for t in ("conversations", "documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    rel = con.sql(SQL[name])
    df = QUERIES[name](spark, SF)
    assert sorted(rel.columns) == sorted(df.columns)
    assert sorted(rel.fetchall()) == sorted(map(tuple, df.select(*rel.columns).collect())) != []
