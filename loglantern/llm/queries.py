"""The operators of this folder as queries, with the SQL that checks them.

Where there is no SQL, ``tests/llm`` holds the query against brute force.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline
from loglantern.llm import bpe, chat, language, lines, minhash, mixing, phrases, quality, sitetext, substring, vectors, warc, whitening

_MODULES = {
    "op1_source_mix": mixing,
    "op2_line_dedup": lines,
    "op3_vector_dedup": vectors,
    "op4_warc": warc,
    "op5_chat_format": chat,
    "op6_minhash_dedup": minhash,
    "op7_substring_dedup": substring,
    "op8_language_id": language,
    "op9_bpe": bpe,
    "op10_quality_rules": quality,
    "op11_site_text": sitetext,
    "op12_whitening": whitening,
    "op13_phrase_mining": phrases,
}

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {name: module.query for name, module in _MODULES.items()}
QUERIES["pipeline"] = corpus_pipeline.run

ORACLES: dict[str, str] = {name: module.SQL for name, module in _MODULES.items() if module.SQL}
