"""Quick forms of patterns and vectors against the plain ones, and how often the texts are read."""

import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from brevira.functions import constants as K
from brevira.functions.text import holds, strip, tokens, word_count
from brevira.operators import classify as C
from brevira.operators import dedup as D
from brevira.operators import facts as X
from brevira.operators import importance as I

DATA = "/root/testdata/sf0.001"
PARTS = "a b Z fooBar fooBar9 foo_bar foo_bar_ C: ABC A_B xC: / \\ . - : :12 .py a.b 12 3456 1.2.3 v2.0 0xff E1234 line port items GB class def function https:// use must if then not ? é ß ſ İ ́ \u0085   $5.20 50% Error: at Traceback get ( ) ' \" ``` Therefore result".split(" ")


@pytest.fixture(scope="module")
def texts(spark):
    rnd = random.Random(5)
    rows = [(k // 40, k, "tool", "".join(rnd.choice(PARTS) + rnd.choice(["", "", " ", "\n"]) for _ in range(rnd.randrange(40)))) for k in range(4000)]
    return spark.createDataFrame(rows, "conv_id long, idx long, role string, content string").repartition(4).cache()


@pytest.mark.parametrize("quick, plain", [(I.ENTITIES, K.ENTITIES), (I.NUMBERS, K.NUMBERS), (X.FILE_PATH, K.FILE_PATH)])
def test_quick_patterns_find_the_same(texts, quick, plain):
    found = [F.regexp_extract_all("content", F.lit(f"({p})"), F.lit(1)) for p in (quick, plain)]
    assert texts.where(found[0] != found[1]).count() == 0
    assert texts.where(F.size(found[0]) > 0).count() > 100


def test_hints_hide_no_match(texts):
    c = F.col("content")
    marked = texts.join(I.mean_tfidf(texts), ["conv_id", "idx"])
    for i, (p, _) in enumerate(I.MARKS):
        assert marked.where(c.rlike(p) & (F.col("marks").bitwiseAND(1 << i) == 0)).count() == 0
    for x, p in zip(C.SIGN_PARTS, K.ERROR_SIGNS, strict=True):
        assert x is None or texts.where(c.rlike(p) & ~holds(c, x)).count() == 0
    plain = F.when(F.length(strip(c)) == 0, 0).otherwise(F.size(F.split(strip(c), r"\s+")))
    assert texts.where(word_count(c) != plain).count() == 0


def test_words_are_the_engines(spark):
    """Python may know letters that the engine does not know yet."""
    df = spark.createDataFrame([(i, chr(i)) for i in range(0x3000) if not 0xD800 <= i < 0xE000], "i int, c string")
    got = {r.i: set(I._words(r.t)) for r in df.select("i", I._as_words(F.col("c")).alias("t")).collect()}
    assert all(got[r.i] == set(r.w) for r in df.select("i", tokens(F.col("c")).alias("w")).collect())


def test_vectors_against_tables(texts):
    v = D.tfidf(texts, ["conv_id", "idx"], ["conv_id"], K.STOP_WORDS).groupBy("conv_id", "idx").agg(F.least(F.avg("weight"), F.lit(1.0)).alias("plain"))
    got = I.mean_tfidf(texts).join(v, ["conv_id", "idx"], "left")
    assert got.count() == texts.count()
    assert got.where((F.coalesce("tfidf", F.lit(0.0)) - F.coalesce("plain", F.lit(0.0))).cast("double").between(-1e-9, 1e-9) == F.lit(False)).count() == 0


def test_lines_cut_as_the_engine_cuts(texts):
    def cut(line):
        words = F.split(strip(line), r"\s+")
        return F.when(strip(line) == "", line).otherwise(F.array_join(F.slice(words, 1, F.greatest(F.lit(1), F.floor(F.size(words) * 0.3).cast("int"))), " "))

    plain = F.array_join(F.transform(F.split("content", "\n"), cut), "\n")
    assert texts.where(I.heavy_prune(F.col("content")) != plain).count() == 0


def test_pruned_texts_against_tables_of_words(texts):
    from brevira.operators import tokens as T

    rows = texts.withColumn("policy", F.when(F.col("idx") % 9 == 0, "PRESERVE").otherwise("MODERATE"))
    needles = texts.select("conv_id").distinct().withColumn("needles", F.array(F.lit("IF"), F.lit("é"), F.lit("zz")))
    for ratio in (0.5, F.when(F.col("idx") % 2 == 0, 0.2).otherwise(0.9)):
        quick = T.pruned(rows, ratio, needles=needles).select("conv_id", "idx", F.col("content").alias("new"))
        plain = T.pruned(rows, ratio, T.idf(rows), needles)
        assert quick.join(plain, ["conv_id", "idx"]).where("new = content").count() == texts.count()
    plan = quick._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan  # no table of all words


def test_rows_beyond_memory_are_read_again():
    from brevira.operators.tokens import _Spool

    s = _Spool(10)
    for i in range(9):
        s.add((i, "x" * i), i)
    assert s.file is not None and list(s) == [(i, "x" * i) for i in range(9)]


@pytest.mark.skipif(not Path(DATA).exists(), reason="no tables")
def test_relevance_prune_reads_its_texts_a_few_times(spark):
    from brevira.plans.queries import relevance_prune

    assert not any("documents.parquet" in x for x in relevance_prune(spark, DATA).inputFiles())  # else each layer runs the ones before it anew
