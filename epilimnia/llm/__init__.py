"""Operators of a training-data pipeline, and the queries that apply them to whole tables.

Functions that run on executors are shipped by value, so workers need no copy of this package.
"""

from __future__ import annotations

import sys

from pyspark import cloudpickle

from epilimnia.llm import (
    best_fit,
    compression_classifier,
    dart_minhash,
    digest_index,
    multi_index,
    phrases,
    prefix_trie,
    range_coder,
    robust_outliers,
    string_kernel,
    trie_bpe,
    url_rules,
    warc_derivatives,
)

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Query name -> function of (session, folder).
QUERIES = {
    "op1_robust_outliers": robust_outliers.op1_robust_outliers,
    "op2_compression_classifier": compression_classifier.op2_compression_classifier,
    "op3_best_fit": best_fit.op3_best_fit,
    "op4_digest_index": digest_index.op4_digest_index,
    "op5_warc_derivatives": warc_derivatives.op5_warc_derivatives,
    "op6_string_kernel": string_kernel.op6_string_kernel,
    "op7_trie_bpe": trie_bpe.op7_trie_bpe,
    "op8_dart_minhash": dart_minhash.op8_dart_minhash,
    "op9_url_rules": url_rules.op9_url_rules,
    "op10_range_coder": range_coder.op10_range_coder,
    "op11_prefix_trie": prefix_trie.op11_prefix_trie,
    "op12_multi_index": multi_index.op12_multi_index,
    "op13_phrases": phrases.op13_phrases,
}

#: SQL with the same rows, where SQL can state them.
SQL = {**digest_index.ORACLE, **phrases.ORACLE, **prefix_trie.ORACLE, **url_rules.ORACLE, **warc_derivatives.ORACLE}
