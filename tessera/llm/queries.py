"""The queries of this package, op1 to op13, and their SQL for DuckDB."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import sql
from tessera.llm.decontaminate import contamination
from tessera.llm.neardup import near_duplicates
from tessera.llm.negatives import mine_hard_negatives, relabelled
from tessera.llm.packing import pack
from tessera.llm.quality import classify
from tessera.llm.quotes import link_quotes
from tessera.llm.resample import resample
from tessera.llm.rules import judge
from tessera.llm.secrets import report
from tessera.llm.substring import repeat_report
from tessera.llm.token_counts import count_tokens
from tessera.llm.urls import filter_urls
from tessera.llm.warc import read_archives, write_archives
from tessera.session import table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    """Register a query and, where there is one, its SQL."""

    def add(f: Query) -> Query:
        QUERIES[name] = f
        if oracle:
            ORACLE[name] = oracle
        return f

    return add


@query("op1_packing")
def _(spark, sf_dir):
    return pack(table(spark, sf_dir, "documents"), with_ids=False)


@query("op5_near_duplicates", sql.NEAR_DUPLICATES)
def _(spark, sf_dir):
    return near_duplicates(table(spark, sf_dir, "documents"), shingle=2)


@query("op6_token_counts")
def _(spark, sf_dir):
    return count_tokens(table(spark, sf_dir, "documents"))


@query("op7_decontamination", sql.DECONTAMINATION)
def _(spark, sf_dir):
    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    items = F.sha2(F.array_join("item_ids", ","), 256)
    return found.select("doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"), items.alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


@query("op10_quality_rules", sql.RULES)
def _(spark, sf_dir):
    return judge(table(spark, sf_dir, "documents")).drop("class_distance", "word_distance")


@query("op3_warc", sql.WARC)
def _(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    found = read_archives(write_archives(pages), pages.schema["page_id"].dataType)
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query("op9_url_filter")
def _(spark, sf_dir):
    return filter_urls(table(spark, sf_dir, "pages"), table(spark, sf_dir, "documents")).drop("log_odds")


@query("op2_quote_links")
def _(spark, sf_dir):
    return link_quotes(table(spark, sf_dir, "conversations"))


@query("op8_substring_dedup")
def _(spark, sf_dir):
    return repeat_report(table(spark, sf_dir, "documents"))


@query("op4_quality")
def _(spark, sf_dir):
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op11_secrets", sql.SECRETS)
def _(spark, sf_dir):
    return report(table(spark, sf_dir, "documents"))


@query("op12_resampling", sql.RESAMPLING)
def _(spark, sf_dir):
    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op13_hard_negatives", sql.HARD_NEGATIVES)
def _(spark, sf_dir):
    return mine_hard_negatives(table(spark, sf_dir, "embeddings"), label=relabelled())
