"""The queries of this subpackage and their SQL, as ``__spark_entry__`` adds them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import oracles
from .bpe import op1_bpe
from .common import table
from .licenses import op4_licenses
from .vectors import op10_neardup
from .mixing import op6_mixing
from .ngrams import op5_ngram_join
from .packing import op11_packing
from .pii import op9_pii
from .quality import op8_quality
from .resampling import op13_resampling
from .topk import op2_topk
from .toxicity import op7_toxicity
from .tries import op12_trie
from .urls import judge, op3_urls

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_bpe": op1_bpe,
    "op2_topk": op2_topk,
    "op3_urls": op3_urls,
    "op4_licenses": op4_licenses,
    "op5_ngram_join": op5_ngram_join,
    "op6_mixing": op6_mixing,
    "op7_toxicity": op7_toxicity,
    "op8_quality": op8_quality,
    "op9_pii": op9_pii,
    "op10_neardup": op10_neardup,
    "op11_packing": op11_packing,
    "op12_trie": op12_trie,
    "op13_resampling": op13_resampling,
    # Columns of these operators that SQL can express, from the same rows.
    "contract_urls": lambda spark, sf_dir: judge(table(spark, sf_dir, "pages").select("page_id", "url")).select("page_id", "host", "path", "rule", "decided"),
    "contract_licenses": lambda spark, sf_dir: op4_licenses(spark, sf_dir).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels"),
    "contract_mixing": lambda spark, sf_dir: op6_mixing(spark, sf_dir).select("doc_id", "size", "source_size", F.round("target", 3).alias("target")),
    "contract_pii": lambda spark, sf_dir: op9_pii(spark, sf_dir).select("doc_id", "n_email", "n_ip", "n_card", "n_phone"),
    "contract_pii_spans": lambda spark, sf_dir: op9_pii(spark, sf_dir).select("doc_id", "base_sha256"),
    "contract_toxicity": lambda spark, sf_dir: op7_toxicity(spark, sf_dir).select("doc_id", "held_out"),
}

ORACLE_SQL: dict[str, str] = {
    "op2_topk": oracles.TOPK,
    "op5_ngram_join": oracles.NGRAMS,
    "op10_neardup": oracles.NEARDUP,
    "contract_urls": oracles.URLS,
    "contract_licenses": oracles.LICENSES,
    "contract_mixing": oracles.MIXING,
    "contract_pii": oracles.PII,
    "contract_pii_spans": oracles.PII_SPANS,
    "contract_toxicity": oracles.TOXICITY,
    "op12_trie": oracles.TRIE,
    "op13_resampling": oracles.RESAMPLING,
}
