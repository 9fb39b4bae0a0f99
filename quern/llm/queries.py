"""The queries of this subpackage, by name, and their SQL where DuckDB can state the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quern.llm import bpe, chat, decontaminate, language, media, near, runs, shards, tokenfile, toxicity, turns, urls, warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_decontamination": decontaminate.query,
    "op2_token_files": tokenfile.query,
    "op3_url_filter": urls.query,
    "op4_language_id": language.query,
    "op5_chat_repair": chat.query,
    "op6_bpe": bpe.query,
    "op7_near_duplicates": near.query,
    "op8_toxicity": toxicity.query,
    "op9_png_columns": media.query,
    "op10_warc_derivatives": warc.query,
    "op11_periodic_runs": runs.query,
    "op12_feistel_shards": shards.query,
    "op13_structure_repair": turns.query,
}

ORACLE_SQL: dict[str, str] = {"op3_url_filter": urls.ORACLE_SQL, "op12_feistel_shards": shards.ORACLE_SQL}
