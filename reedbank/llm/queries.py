"""The subpackage's queries, and their SQL where SQL can express them."""

from __future__ import annotations

from reedbank.llm.op01_ngram_join import op1_ngram_join
from reedbank.llm.op02_shard import op2_shard
from reedbank.llm.op03_lm_trie import op3_lm_trie
from reedbank.llm.op04_decontaminate import op4_decontaminate
from reedbank.llm.op05_chat import op5_chat
from reedbank.llm.op06_quality_rules import op6_quality_rules
from reedbank.llm.op07_quality_knn import op7_quality_knn
from reedbank.llm.op08_suffix_dedup import op8_suffix_dedup
from reedbank.llm.op09_secrets import op9_secrets
from reedbank.llm.op10_bpe import op10_bpe
from reedbank.llm.op11_fill_in_middle import op11_fill_in_middle
from reedbank.llm.op12_prefix_trie import op12_prefix_trie
from reedbank.llm.op13_toxicity import op13_toxicity
from reedbank.llm.oracle_sql import ORACLE_SQL  # noqa: F401

QUERIES = {f.__name__: f for f in (op1_ngram_join, op2_shard, op3_lm_trie, op4_decontaminate, op5_chat, op6_quality_rules, op7_quality_knn, op8_suffix_dedup, op9_secrets, op10_bpe, op11_fill_in_middle, op12_prefix_trie, op13_toxicity)}
