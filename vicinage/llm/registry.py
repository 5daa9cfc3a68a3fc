"""The subpackage's queries and their SQL, for the entry module."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import ann, jaccard, language, licenses, mixing, packing, surrogates, topk, toxicity, warc

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {
    "op1_ngram_jaccard": jaccard.op1_ngram_jaccard,
    "op2_best_fit_packing": packing.op2_best_fit_packing,
    "op3_language_id": language.op3_language_id,
    "op4_toxicity": toxicity.op4_toxicity,
    "op5_license_scan": licenses.op5_license_scan,
    "op6_exact_top_k": topk.op6_exact_top_k,
    "op7_hash_prefix_forest": ann.op7_hash_prefix_forest,
    "op8_warc": warc.op8_warc,
    "op9_pii_surrogates": surrogates.op9_pii_surrogates,
    "op10_source_mixing": mixing.op10_source_mixing,
}

#: SQL where it can express an operator.
ORACLES: dict[str, str] = {
    "op6_exact_top_k": topk.OP6_SQL,
    "op8_warc": warc.OP8_SQL,
    "op10_source_mixing": mixing.OP10_SQL,
}
