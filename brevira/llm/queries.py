"""Queries of the corpus operators over the driver's tables, and their SQL where there is one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..session import ship
from . import chat, decontaminate, html, jaccard, media, pieces, secrets, sharding, toxicity, urls
from .common import table


def op1_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.sharded(table(ship(spark), sf_dir, "documents"))


def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.report(secrets.scanned(table(ship(spark), sf_dir, "documents").select("doc_id", "text")))


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(ship(spark), sf_dir, "documents").select("doc_id", "text")
    return decontaminate.report(decontaminate.contamination(docs, table(spark, sf_dir, "benchmark")))


def op4_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.columns(table(ship(spark), sf_dir, "documents"))


def op5_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = jaccard.near_duplicates(table(ship(spark), sf_dir, "documents"))
    return found.select("doc_id", "class_id", "copy_id", "n_copies", "n_links")


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(ship(spark), sf_dir, "documents")
    return toxicity.judged(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judged(table(ship(spark), sf_dir, "pages").select("page_id", "url")).drop("url")


def op8_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.read_back(chat.formatted(chat.with_extra(table(ship(spark), sf_dir, "conversations"))))


def op9_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.report(table(ship(spark), sf_dir, "pages"))


def op10_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.report(table(ship(spark), sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_shards, op2_secrets, op3_decontaminate, op4_media, op5_near_duplicates, op6_toxicity, op7_url_filter, op8_chat, op9_html, op10_pieces)}

SQL = {"op3_decontaminate": decontaminate.SQL.format(docs="documents"), "op7_url_filter": urls.SQL}
