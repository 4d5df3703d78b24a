"""Queries over the driver's tables, one for each operator or small group of them, and their SQL for DuckDB."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import constants as K
from ..operators import budget as B
from ..operators import classify as C
from ..operators import coalesce as S
from ..operators import dedup as D
from ..operators import facts as X
from ..operators import importance as I
from ..operators import lines as L
from ..operators import structure as J
from ..operators import tokens as T
from ..session import shared_dir, staged
from ..sources import adapters as A
from ..sources.messages import VIEW, derived, from_conversations
from .compress import compress
from .config import Config, looked_up, pressure, resolved, thresholds

RECENT = 1


def rows(spark, sf_dir) -> DataFrame:
    return C.classified(derived(spark, sf_dir), RECENT)


def work(spark, sf_dir) -> DataFrame:
    return rows(spark, sf_dir).where(~F.col("protected"))


def _digest(df: DataFrame, *more: str) -> DataFrame:
    return df.select("conv_id", "idx", F.sha2("content", 256).alias("content_sha256"), *more)


def conversation_classes(spark, sf_dir):
    return C.class_totals(C.classified(from_conversations(spark, sf_dir), 2))


def classify(spark, sf_dir):
    return rows(spark, sf_dir).select("conv_id", "idx", "ctype", "policy", "protected", "tokens")


def class_totals(spark, sf_dir):
    return C.class_totals(rows(spark, sf_dir))


def tiers(spark, sf_dir):
    return C.tiers(rows(spark, sf_dir))


def zone_order(spark, sf_dir):
    return C.reassembled(C.zones(derived(spark, sf_dir))).select("conv_id", "idx", "zone", "position")


def _windows(spark, sf_dir):
    names = F.array(*map(F.lit, ["gpt-4o-mini-2024", "GPT-4.1-nano-x", "claude-haiku-4-5-1", "nobody"]))
    return looked_up(derived(spark, sf_dir).select("conv_id").distinct().withColumn("model", F.element_at(names, (F.col("conv_id") % 4 + 1).cast("int")))).withColumn("usage", (F.col("conv_id") % 10 * 19_000).cast("long"))


def window_pressure(spark, sf_dir):
    return pressure(resolved(derived(spark, sf_dir), _windows(spark, sf_dir))).select("conv_id", "window", "reserve", "usage", "capacity", "available", F.round("usage_ratio", 6).alias("usage_ratio"), "pressure")


def adaptive_thresholds(spark, sf_dir):
    t = thresholds(pressure(resolved(derived(spark, sf_dir), _windows(spark, sf_dir))), Config(recent_turns=2))
    return t.select("conv_id", "pressure", "skip", F.col("recent_turns").cast("long").alias("recent_turns"), "budget", F.round("keep_ratio", 6).alias("keep_ratio"), F.round("entropy", 6).alias("entropy"), "mask", F.size("engines").cast("long").alias("n_engines"))


def exact_dedup(spark, sf_dir):
    out, edges = D.exact(rows(spark, sf_dir))
    return edges.join(out.select("conv_id", F.col("idx").alias("src"), "content"), ["conv_id", "src"]).select("conv_id", "src", "dst", "content")


def cross_window_dedup(spark, sf_dir):
    r = rows(spark, sf_dir)
    old = r.where("idx < 20").select(F.col("conv_id").alias("session_id"), F.lit(0).alias("window"), D.content_hash(F.col("content")).alias("hash"))
    out, _ = D.cross_window(r.where("idx >= 20"), old)
    return _digest(out)


def near_cosine(spark, sf_dir):
    e = D.near_by_cosine(work(spark, sf_dir).where("ctype in ('TOOL_RESULT_TEXT', 'CODE_BLOCK')"), 0.8)
    return e.select("conv_id", "src", "dst", F.round("similarity", 6).alias("similarity"))


def near_cosine_all(spark, sf_dir):
    """:func:`near_cosine` on rows of every type."""
    e = D.near_by_cosine(work(spark, sf_dir), 0.8)
    return e.select("conv_id", "src", "dst", F.round("similarity", 6).alias("similarity"))


def near_minhash(spark, sf_dir):
    return D.near_by_minhash(work(spark, sf_dir), 0.8)


def near_marked(spark, sf_dir):
    w = work(spark, sf_dir)
    return _digest(D.mark(w, D.near(w, 0.8)))


def chunk_dedup(spark, sf_dir):
    return _digest(D.chunked(work(spark, sf_dir), least_words=200))


def coalesce_runs(spark, sf_dir):
    return S.coalesced(work(spark, sf_dir)).where("role = 'assistant'").select("conv_id", "idx", "content")


def _lines(df):
    return df.select("conv_id", "idx", "pos", "line")


def lines_blank(spark, sf_dir):
    return _lines(L.blank_runs(L.exploded(work(spark, sf_dir))))


def lines_entropy(spark, sf_dir):
    return _lines(L.low_entropy(L.exploded(work(spark, sf_dir)), 1.8))


def lines_repeated(spark, sf_dir):
    return _lines(L.repeated(L.exploded(work(spark, sf_dir))))


def lines_truncated(spark, sf_dir):
    return _lines(L.truncated(L.exploded(work(spark, sf_dir)), 10))


def lines_boilerplate(spark, sf_dir):
    r = work(spark, sf_dir).where(F.col("policy").isin(*L.POLICIES))
    return r.select("conv_id", "idx", F.sha2(L.without_boilerplate(F.col("content")), 256).alias("content_sha256"))


def lines_cleaned(spark, sf_dir):
    return _digest(L.cleaned(work(spark, sf_dir)))


def rereads(spark, sf_dir):
    return _digest(L.rereads(work(spark, sf_dir)))


def _critical(spark, sf_dir):
    return X.needles(X.critical_strings(X.extracted(rows(spark, sf_dir))))


def observation_masks(spark, sf_dir):
    return _digest(L.masked(work(spark, sf_dir), _critical(spark, sf_dir), least_results=2, least_chars=200))


def token_idf(spark, sf_dir):
    return T.idf(work(spark, sf_dir)).select("conv_id", "token", F.round("idf", 6).alias("idf"))


def token_idf_merged(spark, sf_dir):
    w = work(spark, sf_dir)
    return T.merged_idf(T.idf(w.where("idx < 500")), T.idf(w)).select("conv_id", "token", F.round("idf", 6).alias("idf"))


def token_prune(spark, sf_dir):
    return _digest(T.pruned(work(spark, sf_dir), 0.5))


def json_and_signatures(spark, sf_dir):
    return _digest(J.structured(work(spark, sf_dir), 3))


def phase(spark, sf_dir):
    return I.phases(work(spark, sf_dir))


def importance(spark, sf_dir):
    return I.scored(work(spark, sf_dir)).select("conv_id", "idx", F.round("importance", 5).alias("importance"))


def shields(spark, sf_dir):
    return I.scored(work(spark, sf_dir)).groupBy("conv_id", "shield").agg(F.count("*").alias("n_rows"))


def query_relevance(spark, sf_dir):
    w = work(spark, sf_dir)
    return I.relevance(w, I.queries_of(w)).select("conv_id", "idx", F.round("score", 5).alias("score"))


def relevance_prune(spark, sf_dir):
    r = staged(rows(spark, sf_dir))
    w, facts = staged(I.scored(r.where(~F.col("protected")))), staged(X.extracted(r))
    return _digest(I.relevance_pruned(w, X.chains(w), facts, X.needles(X.protected_strings(facts))))


def discourse(spark, sf_dir):
    w = work(spark, sf_dir).withColumn("shield", F.lit("COMPRESSIBLE"))
    return _digest(I.discourse(w, RECENT))


def _tasks(spark, sf_dir):
    b = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    n = b.count()
    c = derived(spark, sf_dir).select("conv_id").distinct().withColumn("item_id", F.col("conv_id") % n)
    return c.join(b, "item_id").select("conv_id", F.col("text").alias("task"))


def task_scores(spark, sf_dir):
    return B.scored(rows(spark, sf_dir), _tasks(spark, sf_dir), 0.05).select("conv_id", "idx", F.round("relevance", 6).alias("relevance"))


def budget_drop(spark, sf_dir):
    r = rows(spark, sf_dir).withColumn("relevance", (F.col("idx") % 7) / 7)
    return B.within(r, r.select("conv_id").distinct().withColumn("budget", F.lit(6000))).select("conv_id", "idx", F.col("role"))


def budget_full(spark, sf_dir):
    r = rows(spark, sf_dir)
    facts = X.extracted(r)
    _, edges = D.exact(r)
    return _digest(B.within(r, r.select("conv_id").distinct().withColumn("budget", F.lit(3000)), edges, X.needles(X.critical_strings(facts)), X.needles(X.protected_strings(facts))))


def reorder(spark, sf_dir):
    return B.reordered(rows(spark, sf_dir)).select("conv_id", "idx", "place")


def orphans(spark, sf_dir):
    return B.orphans(derived(spark, sf_dir))


def tool_integrity(spark, sf_dir):
    return B.intact(derived(spark, sf_dir)).select("conv_id", "idx", F.coalesce(F.size("tool_calls"), F.lit(0)).cast("long").alias("n_calls"))


def report(spark, sf_dir):
    r = derived(spark, sf_dir)
    return B.report(r, r.where("idx % 3 <> 0")).select("conv_id", "rows_in", "tokens_in", "rows_out", "tokens_out", "saved", F.round("ratio", 6).alias("ratio"), F.round("cost_saved", 6).alias("cost_saved"))


def decision_log(spark, sf_dir):
    w = work(spark, sf_dir)
    return B.decisions(w, D.exact(w)[0], "dedup")


def ledger(spark, sf_dir):
    return X.extracted(rows(spark, sf_dir)).select("conv_id", "category", "content", "turn")


def ledger_facts(spark, sf_dir):
    """Distinct facts of the labelled kinds, without paths and context, whose texts need no turn."""
    f = X.extracted(rows(spark, sf_dir))
    return f.where("category = 'DECISIONS' or content rlike '^(URL|Date|Amount|Metric|Reference|Code entity): '").select("conv_id", "category", "content")


def ledger_text(spark, sf_dir):
    return X.rendered(X.extracted(rows(spark, sf_dir)))


def critical_strings(spark, sf_dir):
    return X.critical_strings(X.extracted(rows(spark, sf_dir)))


def protected_strings(spark, sf_dir):
    return X.protected_strings(X.extracted(rows(spark, sf_dir)))


def reasoning_chains(spark, sf_dir):
    return X.chains(rows(spark, sf_dir)).select("conv_id", "src", "dst")


def question_arcs(spark, sf_dir):
    return X.arcs(rows(spark, sf_dir)).select("conv_id", "question", F.size("deliberations").cast("long").alias("n_deliberations"), "resolution", "resolved")


def supersessions(spark, sf_dir):
    return X.supersessions(rows(spark, sf_dir)).select("conv_id", "superseding", "superseded", "reason")


def signals(spark, sf_dir):
    r = rows(spark, sf_dir)
    return X.signals(X.arcs(r), X.supersessions(r))


def _round_trip(name):
    def query(spark, sf_dir):
        into, out = A.ADAPTERS[name]
        back = into(out(derived(spark, sf_dir)))
        calls = F.array_join(F.transform("tool_calls", lambda x: F.concat_ws(":", x["id"], x["name"], x["arguments"])), ",")
        return back.select("conv_id", F.floor(F.col("idx") / A.SPREAD).cast("long").alias("idx"), "role", F.sha2("content", 256).alias("content_sha256"), "tool_call_id", F.coalesce(calls, F.lit("")).alias("calls"))

    query.__name__ = f"adapter_{name}"
    return query


def detect_framework(spark, sf_dir):
    m = derived(spark, sf_dir)
    out = None
    for i, (name, (_, to)) in enumerate(A.ADAPTERS.items()):
        d = A.detected(to(m.where(F.col("conv_id") % 6 == i))).withColumn("expected", F.lit(name))
        out = d if out is None else out.unionByName(d)
    return out


def transcript(spark, sf_dir):
    m = derived(spark, sf_dir)
    value = F.when(F.col("idx") % 17 == 0, "{bad").otherwise(F.to_json(F.struct(F.when(F.col("idx") % 19 == 0, "robot").otherwise(F.col("role")).alias("role"), "content")))
    return A.transcript(m.select("conv_id", "idx", value.alias("value"))).select("conv_id", "idx", "role", F.sha2("content", 256).alias("content_sha256"))


def compress_report(spark, sf_dir):
    r = compress(derived(spark, sf_dir), Config(recent_turns=RECENT, token_budget=4000), _tasks(spark, sf_dir))
    return r.report.select("conv_id", "rows_in", "tokens_in", "rows_out", "tokens_out", F.round("ratio", 6).alias("ratio"))


def compress_windows(spark, sf_dir):
    """The chain with a context window for each conversation: those under pressure are shrunk by their own settings."""
    r = compress(derived(spark, sf_dir), Config(recent_turns=RECENT), _tasks(spark, sf_dir), _windows(spark, sf_dir))
    return r.report.select("conv_id", "rows_in", "tokens_in", "rows_out", "tokens_out", F.round("ratio", 6).alias("ratio"))


def session_stream(spark, sf_dir):
    from ..streaming.session import Sessions

    s = Sessions(spark, f"{shared_dir(spark)}/sessions-{uuid.uuid4().hex}", Config(recent_turns=RECENT), window=30_000)
    m = from_conversations(spark, sf_dir)
    first = s.push(m.where("idx < 2"), 0).withColumn("version", F.lit(0))
    second = s.push(m.where("idx >= 2"), 1, flush=True).withColumn("version", F.lit(1))
    return first.unionByName(second)


QUERIES = {
    f.__name__: f
    for f in (
        conversation_classes, classify, class_totals, tiers, zone_order, window_pressure, adaptive_thresholds, exact_dedup, cross_window_dedup, near_cosine, near_cosine_all, near_minhash, near_marked,
        chunk_dedup, coalesce_runs, lines_blank, lines_entropy, lines_repeated, lines_truncated, lines_boilerplate, lines_cleaned, rereads, observation_masks, token_idf, token_idf_merged,
        token_prune, json_and_signatures, phase, importance, shields, query_relevance, relevance_prune, discourse, task_scores, budget_drop, budget_full, reorder, orphans, tool_integrity,
        report, decision_log, ledger, ledger_facts, ledger_text, critical_strings, protected_strings, reasoning_chains, question_arcs, supersessions, signals,
        *map(_round_trip, A.ADAPTERS), detect_framework, transcript, compress_report, compress_windows, session_stream,
    )
}


# ---------------------------------------------------------------- SQL for DuckDB


def _list(words) -> str:
    return "(" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + ")"


def _q(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


_TOKENS = r"regexp_extract_all(lower(content), '[\p{L}\p{N}_]+')"
_STRIP = r"regexp_replace({}, '^\s+|\s+$', '', 'g')"
_NORM = r"trim(regexp_replace({}, '\s+', ' ', 'g'))"
_HASH = f"sha256({_NORM})"
_COUNT = "len(regexp_extract_all({}, {}))"
_POLICY = "CASE ctype " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in K.POLICIES.items()) + " END"


def _classes(source: str, recent: int) -> str:
    hits = " + ".join(_COUNT.format("content", _q(p)) for p in K.ERROR_SIGNS)
    return rf"""
z3 AS (SELECT *, CASE WHEN role = 'user' THEN sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY idx DESC) END AS u FROM {source} WHERE role <> 'system'),
z4 AS (SELECT *, idx > coalesce(max(CASE WHEN u = {recent} THEN idx END) OVER (PARTITION BY conv_id), min(idx) OVER (PARTITION BY conv_id)) AS recent,
  CASE WHEN {hits} >= 3 THEN 'ERROR_TRACE' WHEN regexp_matches(content, '^\s*[\[{{]') AND json_valid(content) THEN 'TOOL_RESULT_JSON'
       WHEN coalesce(name IN {_list(K.CODE_TOOLS)}, false) OR regexp_matches(content, '```[\s\S]*?```') THEN 'CODE_BLOCK' ELSE 'TOOL_RESULT_TEXT' END AS sub FROM z3),
z5 AS (SELECT *, CASE WHEN u = 1 THEN 'USER_QUERY' WHEN role = 'tool' THEN CASE WHEN sub = 'TOOL_RESULT_TEXT' AND recent THEN 'RECENT_TURN' ELSE sub END WHEN recent THEN 'RECENT_TURN'
       WHEN role = 'assistant' THEN 'ASSISTANT_REASONING' ELSE 'OLD_CONVERSATION' END AS ctype FROM z4),
rws AS (SELECT conv_id, idx, role, content, name, tool_call_id, call_id, ctype, {_POLICY} AS policy, ctype IN {_list(K.PROTECTED)} AS protected, cast(ceil(length(content) / 3.5::DOUBLE) AS bigint) AS tokens FROM z5),
wrk AS (SELECT * FROM rws WHERE NOT protected)"""


_MSG = f"WITH messages AS ({VIEW}), " + _classes("messages", RECENT).strip()
_LINES = _MSG + r", lns AS (SELECT conv_id, idx, unnest(range(0, len(l))) AS pos, unnest(l) AS line FROM (SELECT conv_id, idx, string_split(content, chr(10)) AS l FROM wrk WHERE policy IN ('MODERATE', 'AGGRESSIVE', 'STACK')) t)"
_LOCK = "policy NOT IN ('PRESERVE', 'LIGHT')"
_TOTALS = "SELECT conv_id, ctype, count(*) AS n_rows, cast(sum(tokens) AS bigint) AS n_tokens, cast(sum(protected::int) AS bigint) AS n_protected FROM rws GROUP BY ALL"


def _pressure() -> str:
    from .config import MODELS

    values = ", ".join(f"('{m}', {w}, {r})" for m, (w, r) in MODELS.items())
    return (
        _MSG
        + rf""", md(prefix, w, r) AS (VALUES {values}),
cv AS (SELECT conv_id, CASE conv_id % 4 WHEN 0 THEN 'gpt-4o-mini-2024' WHEN 1 THEN 'GPT-4.1-nano-x' WHEN 2 THEN 'claude-haiku-4-5-1' ELSE 'nobody' END AS model, conv_id % 10 * 19000 AS usage0,
  (sum(length(content)) * 10) // 35 AS est, sum((role = 'user')::int) AS turns FROM messages GROUP BY conv_id),
pk AS (SELECT cv.*, md.w, md.r, row_number() OVER (PARTITION BY conv_id ORDER BY length(prefix) DESC NULLS LAST) AS k FROM cv LEFT JOIN md ON starts_with(lower(model), prefix)),
pr AS (SELECT conv_id, turns, cast(coalesce(w, 200000) AS bigint) AS "window", cast(coalesce(r, 8192) AS bigint) AS reserve, cast(greatest(usage0, est) AS bigint) AS usage FROM pk WHERE k = 1),
pc AS (SELECT *, greatest(0, "window" - reserve) AS capacity FROM pr),
pu AS (SELECT *, greatest(0, capacity - usage) AS available, CASE WHEN capacity = 0 THEN 1.0::DOUBLE ELSE least(1.0::DOUBLE, greatest(0.0::DOUBLE, usage::DOUBLE / capacity)) END AS usage_ratio FROM pc),
pp AS (SELECT *, CASE WHEN 1 - usage_ratio > 0.60::DOUBLE THEN 'NONE' WHEN 1 - usage_ratio > 0.40::DOUBLE THEN 'LOW' WHEN 1 - usage_ratio > 0.25::DOUBLE THEN 'MEDIUM' WHEN 1 - usage_ratio > 0.10::DOUBLE THEN 'HIGH' ELSE 'CRITICAL' END AS pressure FROM pu)"""
    )


def _case(i: int, default: str) -> str:
    return "CASE pressure " + " ".join(f"WHEN '{k}' THEN {v[i]}::DOUBLE" for k, v in K.PRESSURE.items() if v[i] is not None) + f" ELSE {default} END"


_MEAN = rf"""
tk AS (SELECT conv_id, idx, unnest({_TOKENS}) AS token FROM src),
tf AS (SELECT conv_id, idx, token, count(*) AS n FROM tk WHERE token NOT IN {_list(K.STOP_WORDS)} GROUP BY ALL),
tw AS (SELECT conv_id, idx, token, n / sum(n) OVER (PARTITION BY conv_id, idx) * (ln((nr + 1) / (count(*) OVER (PARTITION BY conv_id, token) + 1)::DOUBLE) + 1) AS weight FROM tf JOIN (SELECT conv_id, count(*) AS nr FROM src GROUP BY 1) USING (conv_id))"""


def _round_sql() -> str:
    return f"WITH messages AS ({VIEW}) SELECT conv_id, idx, role, sha256(content) AS content_sha256, tool_call_id, coalesce(call_id || ':read_file:{{}}', '') AS calls FROM messages"


_FACTS = (
    _MSG
    + rf""", ex AS (SELECT * FROM rws WHERE ctype IN {_list(X.EXTRACTABLE)}),
fx AS (SELECT DISTINCT conv_id, 'IDENTIFIERS' AS category, content FROM (
  SELECT conv_id, 'URL: ' || regexp_replace(unnest(regexp_extract_all(content, {_q(K.URL)}, 1)), '[.,;)"'']+$', '') AS content FROM ex
  UNION ALL SELECT conv_id, 'Date: ' || unnest(regexp_extract_all(content, {_q(K.DATE)}, 1)) FROM ex
  UNION ALL SELECT conv_id, 'Amount: ' || unnest(regexp_extract_all(content, {_q(K.MONEY)}, 1)) FROM ex
  UNION ALL SELECT conv_id, 'Metric: ' || unnest(regexp_extract_all(content, {_q(K.PERCENT)}, 1)) FROM ex
  UNION ALL SELECT conv_id, 'Reference: ' || unnest(regexp_extract_all(content, {_q(K.LINE_REF)}, 1)) FROM ex
  """
    + "".join(f"UNION ALL SELECT conv_id, 'Code entity: ' || x FROM (SELECT conv_id, unnest(regexp_extract_all(content, {_q(p)}, 1)) AS x FROM ex) t WHERE length(x) > 2\n  " for p in K.CODE_ENTITIES)
    + rf""") t),
sn AS (SELECT conv_id, unnest(string_split(regexp_replace(content, '([.!])\s+', '\1' || chr(1), 'g'), chr(1))) AS s FROM rws WHERE role = 'assistant')
SELECT * FROM fx UNION ALL SELECT DISTINCT conv_id, 'DECISIONS', substr({_STRIP.format("s")}, 1, 200) FROM sn WHERE trim(s) <> '' AND regexp_matches(s, {_q(K.DECISION_SENTENCE)}) AND NOT regexp_matches(s, {_q(K.HEDGE)})"""
)

_ARC = rf"""list_filter(list_distinct(regexp_extract_all(lower(content), '\b([a-z]\w{{2,}})\b', 1)), lambda x: x NOT IN {_list(K.ARC_STOP_WORDS)})"""
_ENT = rf"""list_distinct(list_concat(list_concat(list_transform(regexp_extract_all(content, '[\w./\\]+\.\w{{1,8}}'), lambda x: lower(x)), list_transform(regexp_extract_all(content, '\b[a-z]+(?:[A-Z][a-z]+)+\b'), lambda x: lower(x))),
  list_filter(list_transform(regexp_extract_all(content, '\b(\w+)\s*\(', 1), lambda x: lower(x)), lambda x: x NOT IN {_list(K.ARC_STOP_WORDS)} AND length(x) > 2)))"""
_ARCS = (
    _MSG
    + rf""", kw AS (SELECT *, {_ARC} AS k FROM rws WHERE length(content) >= 10),
qs AS (SELECT conv_id, idx AS question, k, lead(idx) OVER (PARTITION BY conv_id ORDER BY idx) AS nxt FROM kw WHERE role = 'user' AND (regexp_matches(content, {_q(K.QUESTION)}) OR regexp_matches(content, '(?i)\bshould (?:we|I)\b') OR regexp_matches(content, {_q(K.ARC_QUESTION)}))),
an AS (SELECT conv_id, idx AS i, k AS ak, regexp_matches(content, {_q(K.RESOLUTION)}) AS res, regexp_matches(content, {_q(K.DELIBERATION)}) AS del FROM kw WHERE role = 'assistant'),
arcs AS (SELECT qs.conv_id, question, count(CASE WHEN i > question AND NOT res AND del AND (nxt IS NULL OR i < nxt) THEN 1 END) AS n_deliberations, min(CASE WHEN i > question AND res AND len(list_intersect(k, ak)) >= 2 THEN i END) AS resolution
  FROM qs LEFT JOIN an ON qs.conv_id = an.conv_id WHERE len(k) >= 2 GROUP BY 1, 2),
en AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY idx) AS n, {_ENT} AS e FROM rws),
sup AS (SELECT a.conv_id, a.idx AS superseding, min(b.idx) AS superseded, CASE WHEN regexp_matches(lower(any_value(a.content)), 'actually|turns out|correction|not|but') THEN 'correction' WHEN regexp_matches(lower(any_value(a.content)), 'all|pass|now|updated') THEN 'status_update' ELSE 'refinement' END AS reason
  FROM en a JOIN en b ON a.conv_id = b.conv_id AND b.n < a.n AND b.n >= a.n - 20 AND b.role IN ('assistant', 'tool') AND list_has_any(a.e, b.e)
  WHERE a.role = 'assistant' AND length(a.content) >= 20 AND regexp_matches(a.content, {_q(K.SUPERSESSION)}) GROUP BY 1, 2)"""
)

_PHASE = rf""", lst AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY idx DESC) AS bk FROM wrk) t WHERE bk <= 10),
pcn AS (SELECT conv_id, count(*) AS n, sum((ctype = 'ERROR_TRACE')::int) AS e, sum((ctype = 'CODE_BLOCK')::int) AS c, sum((ctype IN ('TOOL_RESULT_TEXT', 'TOOL_RESULT_JSON'))::int) AS t FROM lst GROUP BY 1),
phs AS (SELECT conv_id, CASE WHEN e >= 2 OR (e >= 1 AND n <= 5) THEN 'DEBUGGING' WHEN c >= 3 OR c > 0.3::DOUBLE * n THEN 'IMPLEMENTATION' WHEN t >= 3 THEN 'REVIEW' ELSE 'EXPLORATION' END AS phase FROM pcn),
phm AS (SELECT conv_id, phase, CASE phase WHEN 'DEBUGGING' THEN 1.1::DOUBLE WHEN 'IMPLEMENTATION' THEN 1.05::DOUBLE WHEN 'REVIEW' THEN 1.0::DOUBLE ELSE 0.95::DOUBLE END AS multiplier FROM phs)"""

SQL = {
    "conversation_classes": "WITH messages AS (SELECT conv_id, turn AS idx, role, text AS content, NULL AS name, NULL AS tool_call_id, NULL AS call_id FROM conversations), " + _classes("messages", 2).strip() + _TOTALS.join(["\n", ""]),
    "classify": _MSG + "\nSELECT conv_id, idx, ctype, policy, protected, tokens FROM rws",
    "class_totals": _MSG + "\n" + _TOTALS,
    "tiers": _MSG + "\nSELECT conv_id, count(*) AS n_rows, CASE WHEN count(*) <= 50 THEN 'full' WHEN count(*) <= 150 THEN 'standard' WHEN count(*) <= 300 THEN 'fast' ELSE 'ultra_fast' END AS tier FROM rws GROUP BY 1",
    "zone_order": f"WITH messages AS ({VIEW}), z AS (SELECT conv_id, idx, CASE WHEN role = 'system' THEN 1 ELSE 3 END AS zone FROM messages) SELECT *, cast(row_number() OVER (PARTITION BY conv_id ORDER BY zone, idx) - 1 AS int) AS position FROM z",
    "window_pressure": _pressure() + '\nSELECT conv_id, "window", reserve, usage, capacity, available, round(usage_ratio, 6) AS usage_ratio, pressure FROM pp',
    "adaptive_thresholds": _pressure()
    + rf"""
SELECT conv_id, pressure, pressure = 'NONE' AS skip, cast(CASE WHEN pressure = 'NONE' OR turns = 0 THEN 2 ELSE least(2, greatest(1, round_even(turns * {_case(0, "0.3")}, 0))) END AS bigint) AS recent_turns,
  CASE WHEN pressure <> 'NONE' THEN cast(greatest(100, floor(available * {_case(1, "1.0")})) AS bigint) END AS budget,
  round(greatest(0.1::DOUBLE, 0.5::DOUBLE * {_case(2, "1.0")}), 6) AS keep_ratio, round(greatest(0.3::DOUBLE, 1.8::DOUBLE * {_case(3, "1.0")}), 6) AS entropy, pressure IN ('HIGH', 'CRITICAL') AS mask,
  cast(CASE pressure WHEN 'NONE' THEN 0 WHEN 'LOW' THEN 2 WHEN 'MEDIUM' THEN 5 WHEN 'HIGH' THEN 7 ELSE 8 END AS bigint) AS n_engines FROM pp""",
    "exact_dedup": _MSG
    + rf""", h AS (SELECT *, {_HASH.format("content")} AS h FROM rws WHERE {_LOCK}), f AS (SELECT *, min(idx) OVER (PARTITION BY conv_id, h) AS fst FROM h)
SELECT conv_id, idx AS src, fst AS dst, '[' || coalesce(name, 'content') || ' was read earlier in this session. Content unchanged. See message #' || fst || '.]' AS content FROM f WHERE fst < idx""",
    "cross_window_dedup": _MSG
    + rf""", old AS (SELECT DISTINCT conv_id, {_HASH.format("content")} AS h FROM rws WHERE idx < 20), n AS (SELECT *, CASE WHEN {_LOCK} THEN {_HASH.format("content")} END AS h FROM rws WHERE idx >= 20)
SELECT n.conv_id, n.idx, sha256(CASE WHEN old.h IS NOT NULL THEN '[' || coalesce(name, 'content') || ' was read earlier in this session. Content unchanged. Seen in a previous window.]' ELSE content END) AS content_sha256 FROM n LEFT JOIN old ON n.conv_id = old.conv_id AND n.h = old.h""",
    "near_cosine": _MSG
    + rf""", own AS (SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY conv_id, ctype) AS m FROM wrk WHERE ctype IN ('TOOL_RESULT_TEXT', 'CODE_BLOCK')) t WHERE m >= 2),
tk AS (SELECT conv_id, ctype, idx, m, unnest({_TOKENS}) AS token FROM own), tf AS (SELECT conv_id, ctype, idx, m, token, count(*) AS n FROM tk GROUP BY ALL),
tw AS (SELECT *, n / sum(n) OVER (PARTITION BY conv_id, idx) * (ln((m + 1) / (count(*) OVER (PARTITION BY conv_id, ctype, token) + 1)::DOUBLE) + 1) AS w FROM tf),
tn AS (SELECT *, w / sqrt(sum(w * w) OVER (PARTITION BY conv_id, idx)) AS x FROM tw),
pr AS (SELECT a.conv_id, a.idx AS src, b.idx AS dst, sum(a.x * b.x) AS s FROM tn a JOIN tn b ON a.conv_id = b.conv_id AND a.ctype = b.ctype AND a.token = b.token AND a.idx < b.idx GROUP BY 1, 2, 3 HAVING sum(a.x * b.x) >= 0.8)
SELECT conv_id, src, min(dst) AS dst, round(arg_min(s, dst), 6) AS similarity FROM pr GROUP BY 1, 2""",
    "coalesce_runs": _MSG
    + rf""", s AS (SELECT *, role = 'assistant' AND policy IN ('MODERATE', 'AGGRESSIVE') AND call_id IS NULL AND length(content) < 100 AS sh FROM wrk),
g AS (SELECT *, CASE WHEN sh AND coalesce(lag(sh) OVER (PARTITION BY conv_id ORDER BY idx), false) THEN 0 ELSE 1 END AS st FROM s),
i AS (SELECT *, sum(st) OVER (PARTITION BY conv_id ORDER BY idx) AS isl, {_STRIP.format("content")} AS p FROM g),
m AS (SELECT conv_id, isl, min(idx) AS idx, count(*) AS n, bool_and(sh) AS ok, '[Assistant notes: ' || coalesce(string_agg(CASE WHEN p = '' THEN NULL WHEN regexp_matches(p, '[.!?;:]$') THEN p ELSE p || '.' END, ' ' ORDER BY idx), '') || ']' AS note FROM i GROUP BY 1, 2)
SELECT i.conv_id, i.idx, CASE WHEN ok AND n >= 3 THEN note ELSE content END AS content FROM i JOIN m USING (conv_id, isl) WHERE role = 'assistant' AND (NOT (ok AND n >= 3) OR i.idx = m.idx)""",
    "lines_blank": _LINES + rf", b AS (SELECT *, {_STRIP.format('line')} = '' AS bl FROM lns), c AS (SELECT *, coalesce(lag(bl) OVER (PARTITION BY conv_id, idx ORDER BY pos), false) AS p FROM b) SELECT conv_id, idx, cast(pos AS int) AS pos, line FROM c WHERE NOT (bl AND p)",
    "lines_entropy": _LINES
    + rf""", s AS (SELECT *, {_STRIP.format("line")} AS st FROM lns),
ch AS (SELECT conv_id, idx, pos, unnest(string_split(st, '')) AS c FROM s WHERE st <> ''), cn AS (SELECT conv_id, idx, pos, c, count(*)::DOUBLE AS n FROM ch GROUP BY ALL),
en AS (SELECT conv_id, idx, pos, -sum(n / t * log2(n / t)) AS e FROM (SELECT *, sum(n) OVER (PARTITION BY conv_id, idx, pos) AS t FROM cn) x GROUP BY 1, 2, 3)
SELECT conv_id, idx, cast(pos AS int) AS pos, line FROM s LEFT JOIN en USING (conv_id, idx, pos) WHERE st = '' OR regexp_matches(st, {_q(K.PATH)}) OR regexp_matches(st, '\d') OR round(e, 9) >= 1.8""",
    "lines_repeated": _LINES
    + rf""", p AS (SELECT *, regexp_replace(regexp_replace({_STRIP.format("line")}, '\d+', '#', 'g'), '[''"].*?[''"]', 'STR', 'g') AS pt FROM lns),
g AS (SELECT *, CASE WHEN pt = lag(pt) OVER w THEN 0 ELSE 1 END AS st FROM p WINDOW w AS (PARTITION BY conv_id, idx ORDER BY pos)), i AS (SELECT *, sum(st) OVER (PARTITION BY conv_id, idx ORDER BY pos) AS isl FROM g),
k AS (SELECT *, count(*) OVER (PARTITION BY conv_id, idx, isl) AS n, row_number() OVER (PARTITION BY conv_id, idx, isl ORDER BY pos) AS r FROM i)
SELECT conv_id, idx, cast(pos AS int) AS pos, CASE WHEN n > 3 AND pt <> '' AND r = 4 THEN '[... ' || (n - 3) || ' similar lines omitted ...]' ELSE line END AS line FROM k WHERE NOT (n > 3 AND pt <> '') OR r <= 4""",
    "lines_truncated": _LINES
    + r""", k AS (SELECT *, row_number() OVER (PARTITION BY conv_id, idx ORDER BY pos) AS r, count(*) OVER (PARTITION BY conv_id, idx) AS n FROM lns)
SELECT conv_id, idx, cast(pos AS int) AS pos, CASE WHEN n > 10 AND r = 6 THEN '[... ' || (n - 10) || ' lines omitted — showing first 5 and last 5 lines ...]' ELSE line END AS line FROM k WHERE n <= 10 OR r <= 6 OR r > n - 5""",
    "lines_boilerplate": _MSG + "\nSELECT conv_id, idx, sha256(" + "".join("regexp_replace(" for _ in K.BOILERPLATE) + "content" + "".join(f", {_q(p)}, '', 'g')" for p in K.BOILERPLATE) + ") AS content_sha256 FROM wrk WHERE policy IN ('MODERATE', 'AGGRESSIVE', 'STACK')",
    "rereads": _MSG
    + rf""", e AS (SELECT *, CASE WHEN policy IN ('MODERATE', 'AGGRESSIVE', 'STACK') AND ctype IN ('TOOL_RESULT_TEXT', 'TOOL_RESULT_JSON', 'CODE_BLOCK') AND length(content) > 200 THEN {_HASH.format("content")} END AS h, {_STRIP.format("string_split(content, chr(10))[1]")} AS f1 FROM wrk),
f AS (SELECT *, min(idx) OVER (PARTITION BY conv_id, h) AS fst FROM e)
SELECT conv_id, idx, sha256(CASE WHEN h IS NOT NULL AND fst < idx THEN '[Previously read: ' || coalesce(nullif(regexp_extract(content, {_q(K.PATH)}), ''), CASE WHEN length(f1) > 60 THEN f1[1:57] || '...' END, nullif(f1, ''), 'content') || ' — see message ' || fst || ']' ELSE content END) AS content_sha256 FROM f""",
    "token_idf": _MSG + rf", d AS (SELECT conv_id, token, count(*) AS df FROM (SELECT DISTINCT conv_id, idx, unnest({_TOKENS}) AS token FROM wrk) t GROUP BY 1, 2), n AS (SELECT conv_id, count(*) AS n FROM wrk GROUP BY 1) SELECT conv_id, token, round(ln((n + 1) / (df + 1)::DOUBLE) + 1, 6) AS idf FROM d JOIN n USING (conv_id)",
    "token_idf_merged": _MSG
    + rf""", tk AS (SELECT DISTINCT conv_id, idx, unnest({_TOKENS}) AS token FROM wrk), a AS (SELECT conv_id, token, count(*) AS df FROM tk GROUP BY 1, 2), b AS (SELECT conv_id, token, count(*) AS df FROM tk WHERE idx < 500 GROUP BY 1, 2),
na AS (SELECT conv_id, count(*) AS n FROM wrk GROUP BY 1), nb AS (SELECT conv_id, count(*) AS n FROM wrk WHERE idx < 500 GROUP BY 1)
SELECT a.conv_id, a.token, round(CASE WHEN b.df IS NOT NULL THEN ln((nb.n + 1) / (b.df + 1)::DOUBLE) + 1 ELSE ln((na.n + 1) / (a.df + 1)::DOUBLE) + 1 END, 6) AS idf FROM a JOIN na USING (conv_id) LEFT JOIN b ON a.conv_id = b.conv_id AND a.token = b.token LEFT JOIN nb ON a.conv_id = nb.conv_id""",
    "phase": _MSG + _PHASE + " SELECT conv_id, phase, multiplier FROM phm",
    "query_relevance": _MSG
    + r""", uq AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY idx DESC) AS k FROM wrk WHERE role = 'user' AND content <> ''), qq AS (SELECT conv_id, string_agg(content, ' ' ORDER BY idx) AS q FROM uq WHERE k <= 2 GROUP BY 1),
src AS (SELECT conv_id, idx, content FROM wrk UNION ALL SELECT conv_id, -1, q FROM qq), """
    + _MEAN.strip()
    + r""", nm AS (SELECT conv_id, idx, sqrt(sum(weight * weight)) AS nr FROM tw GROUP BY 1, 2),
dt AS (SELECT a.conv_id, a.idx, sum(a.weight * b.weight) AS d FROM tw a JOIN tw b ON a.conv_id = b.conv_id AND a.token = b.token AND b.idx = -1 WHERE a.idx <> -1 GROUP BY 1, 2)
SELECT w.conv_id, w.idx, round(coalesce(d / (n1.nr * n2.nr), 0), 5) AS score FROM wrk w JOIN qq USING (conv_id) LEFT JOIN dt ON w.conv_id = dt.conv_id AND w.idx = dt.idx LEFT JOIN nm n1 ON w.conv_id = n1.conv_id AND w.idx = n1.idx LEFT JOIN nm n2 ON w.conv_id = n2.conv_id AND n2.idx = -1""",
    "task_scores": _MSG
    + rf""", ts AS (SELECT DISTINCT r.conv_id, list_filter(list_distinct(regexp_extract_all(lower(b.text), '[\p{{L}}\p{{N}}_]+')), lambda x: x NOT IN {_list(K.TASK_STOP_WORDS)}) AS k FROM rws r JOIN benchmark b ON b.item_id = r.conv_id % (SELECT count(*) FROM benchmark)),
s0 AS (SELECT r.*, CASE WHEN protected THEN 1.0::DOUBLE WHEN coalesce(len(k), 0) > 0 THEN len(list_intersect(k, {_TOKENS})) / len(k)::DOUBLE ELSE 0.5::DOUBLE END AS sc FROM rws r LEFT JOIN ts USING (conv_id)),
s1 AS (SELECT *, count(*) OVER (PARTITION BY conv_id) AS n, row_number() OVER (PARTITION BY conv_id ORDER BY idx) - 1 AS p FROM s0),
s2 AS (SELECT *, sc * CASE WHEN n <= 10 OR protected THEN 1.0::DOUBLE WHEN p / greatest(n - 1, 1)::DOUBLE < 0.15::DOUBLE THEN 1.1::DOUBLE WHEN p / greatest(n - 1, 1)::DOUBLE > 0.85::DOUBLE THEN 1.15::DOUBLE ELSE 0.9::DOUBLE END AS rel FROM s1),
s3 AS (SELECT *, protected OR round(rel, 9) >= 0.05 AS keep FROM s2)
SELECT conv_id, idx, round(rel, 6) AS relevance FROM (SELECT *, bool_or(keep) OVER (PARTITION BY conv_id) AS any_left FROM s3) t WHERE keep OR NOT any_left""",
    "budget_drop": _MSG
    + r""", ca AS (SELECT DISTINCT conv_id, call_id AS id FROM rws WHERE call_id IS NOT NULL), re AS (SELECT DISTINCT conv_id, tool_call_id AS id FROM rws WHERE tool_call_id IS NOT NULL), bth AS (SELECT conv_id, id FROM ca INTERSECT SELECT conv_id, id FROM re),
d AS (SELECT r.*, (idx % 7) / 7.0::DOUBLE AS rel, sum(tokens) OVER (PARTITION BY conv_id) AS total, NOT protected AND ctype NOT IN ('CODE_BLOCK', 'ERROR_TRACE') AND NOT EXISTS (SELECT 1 FROM bth b WHERE b.conv_id = r.conv_id AND b.id IN (r.call_id, r.tool_call_id)) AS drp FROM rws r),
p AS (SELECT *, coalesce(sum(tokens) OVER (PARTITION BY conv_id, drp ORDER BY rel, idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM d)
SELECT conv_id, idx, role FROM p WHERE NOT (drp AND total > 6000 AND total - before > 6000)""",
    "orphans": f"WITH messages AS ({VIEW}), c AS (SELECT DISTINCT conv_id, call_id AS id FROM messages WHERE call_id IS NOT NULL), r AS (SELECT DISTINCT conv_id, tool_call_id AS id FROM messages WHERE tool_call_id IS NOT NULL) SELECT coalesce(c.conv_id, r.conv_id) AS conv_id, coalesce(c.id, r.id) AS id, CASE WHEN c.id IS NULL THEN 'result' ELSE 'call' END AS side FROM c FULL JOIN r ON c.conv_id = r.conv_id AND c.id = r.id WHERE c.id IS NULL OR r.id IS NULL",
    "tool_integrity": f"""WITH messages AS ({VIEW}), rs AS (SELECT DISTINCT conv_id, tool_call_id AS id FROM messages WHERE tool_call_id IS NOT NULL), cs AS (SELECT DISTINCT conv_id, call_id AS id FROM messages WHERE call_id IS NOT NULL)
SELECT m.conv_id, m.idx, cast(rs.id IS NOT NULL AS bigint) AS n_calls FROM messages m LEFT JOIN rs ON rs.conv_id = m.conv_id AND rs.id = m.call_id LEFT JOIN cs ON cs.conv_id = m.conv_id AND cs.id = m.tool_call_id WHERE m.tool_call_id IS NULL OR cs.id IS NOT NULL""",
    "decision_log": _MSG
    + rf""", h AS (SELECT *, {_HASH.format("content")} AS h FROM wrk WHERE {_LOCK}), f AS (SELECT *, min(idx) OVER (PARTITION BY conv_id, h) AS fst FROM h),
n AS (SELECT *, '[' || coalesce(name, 'content') || ' was read earlier in this session. Content unchanged. See message #' || fst || '.]' AS note FROM f WHERE fst < idx)
SELECT conv_id, 'dedup' AS layer, 'changed' AS action, idx, tokens AS tokens_before, cast(ceil(length(note) / 3.5::DOUBLE) AS bigint) AS tokens_after FROM n WHERE note <> content""",
    "report": f"WITH messages AS ({VIEW}), t AS (SELECT *, cast(ceil(length(content) / 3.5::DOUBLE) AS bigint) AS k FROM messages), s AS (SELECT conv_id, count(*) AS rows_in, cast(sum(k) AS bigint) AS tokens_in, count(CASE WHEN idx % 3 <> 0 THEN 1 END) AS rows_out, cast(coalesce(sum(CASE WHEN idx % 3 <> 0 THEN k END), 0) AS bigint) AS tokens_out FROM t GROUP BY 1) SELECT *, tokens_in - tokens_out AS saved, CASE WHEN tokens_out > 0 THEN round(tokens_in / tokens_out::DOUBLE, 6) WHEN tokens_in > 0 THEN 'inf'::DOUBLE ELSE 1.0::DOUBLE END AS ratio, round((tokens_in - tokens_out) / 1000.0::DOUBLE * 0.003::DOUBLE, 6) AS cost_saved FROM s",
    "ledger_facts": _FACTS,
    "reasoning_chains": _MSG + f", c AS (SELECT *, last_value(CASE WHEN role = 'assistant' THEN idx END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS dst FROM rws) SELECT conv_id, idx AS src, dst FROM c WHERE regexp_matches(content, {_q(K.CHAIN)}) AND dst IS NOT NULL",
    "question_arcs": _ARCS + "\nSELECT conv_id, question, n_deliberations, resolution, resolution IS NOT NULL AS resolved FROM arcs",
    "supersessions": _ARCS + "\nSELECT conv_id, superseding, superseded, reason FROM sup",
    "signals": _ARCS
    + """, a AS (SELECT conv_id, count(*) AS questions, sum((resolution IS NOT NULL)::int) AS resolved FROM arcs GROUP BY 1), s AS (SELECT conv_id, sum((reason = 'correction')::int) AS correction, sum((reason = 'status_update')::int) AS status_update, sum((reason = 'refinement')::int) AS refinement FROM sup GROUP BY 1)
SELECT coalesce(a.conv_id, s.conv_id) AS conv_id, cast(coalesce(questions, 0) AS bigint) AS questions, cast(coalesce(resolved, 0) AS bigint) AS resolved, cast(coalesce(correction, 0) AS bigint) AS correction, cast(coalesce(status_update, 0) AS bigint) AS status_update, cast(coalesce(refinement, 0) AS bigint) AS refinement, cast(coalesce(questions, 0) - coalesce(resolved, 0) AS bigint) AS unresolved FROM a FULL JOIN s ON a.conv_id = s.conv_id""",
    **{f"adapter_{n}": _round_sql() for n in A.ADAPTERS},
    "transcript": f"WITH messages AS ({VIEW}) SELECT conv_id, idx, role, sha256(content) AS content_sha256 FROM messages WHERE idx % 17 <> 0 AND idx % 19 <> 0",
}


def _ship(f):
    from ..session import ship

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return f(ship(spark), sf_dir)

    query.__name__ = f.__name__
    return query


QUERIES = {k: _ship(f) for k, f in QUERIES.items()}
