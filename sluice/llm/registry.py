"""Queries and oracle SQL of the training-data operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import chat, exact, hardneg, langid, mixing, ngrams, packing, prefixtrie, quality, secretscan, shards, simhash, tokencount

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_randomness_scan": secretscan.op1_randomness_scan,
    "op2_streaming_dedup": exact.op2_streaming_dedup,
    "op3_simhash_bktree": simhash.op3_simhash_bktree,
    "op4_token_cache": tokencount.op4_token_cache,
    "op5_subset_sum_mix": mixing.op5_subset_sum_mix,
    "op6_isolation_forest": quality.op6_isolation_forest,
    "op7_subword_softmax": langid.op7_subword_softmax,
    "op8_size_tiered_shards": shards.op8_size_tiered_shards,
    "op9_chat_fsm": chat.op9_chat_fsm,
    "op10_nnls_packing": packing.op10_nnls_packing,
    "op11_four_russians": hardneg.op11_four_russians,
    "op12_backoff_automaton": ngrams.op12_backoff_automaton,
    "op13_prefix_monoid": prefixtrie.op13_prefix_monoid,
}

ORACLE: dict[str, str] = {
    "op2_streaming_dedup": exact.OP2_SQL,
    "op8_size_tiered_shards": shards.OP8_SQL,
    "op9_chat_fsm": chat.OP9_SQL,
    "op11_four_russians": hardneg.OP11_SQL,
    "op12_backoff_automaton": ngrams.OP12_SQL,
    "op13_prefix_monoid": prefixtrie.OP13_SQL,
}
