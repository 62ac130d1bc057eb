"""Registered queries of this subpackage."""

from __future__ import annotations

import corpus_pipeline
from weftlog.llm import chat, decontaminate, infill, quality, warc
from weftlog.llm.alignment import op11_elementary_intervals
from weftlog.llm.neardup import op2_order_minhash
from weftlog.llm.neighbours import op13_inverted_multi_index
from weftlog.llm.packing import op5_hilbert_packing
from weftlog.llm.sharding import op6_sampled_splitters
from weftlog.llm.suffixes import op1_sparse_suffixes
from weftlog.llm.tokens import op7_addressable_codes
from weftlog.llm.toxicity import op4_weak_supervision

QUERIES: dict = {"op1_sparse_suffixes": op1_sparse_suffixes, "op2_order_minhash": op2_order_minhash, "op3_rule_cascade": quality.op3_rule_cascade, "op4_weak_supervision": op4_weak_supervision, "op5_hilbert_packing": op5_hilbert_packing, "op6_sampled_splitters": op6_sampled_splitters, "op7_addressable_codes": op7_addressable_codes, "op8_winnowing": decontaminate.op8_winnowing, "op9_reply_trees": chat.op9_reply_trees, "op10_dictionary_warc": warc.op10_dictionary_warc, "op11_elementary_intervals": op11_elementary_intervals, "op12_checkpointed_infill": infill.op12_checkpointed_infill, "op13_inverted_multi_index": op13_inverted_multi_index, "pipeline": corpus_pipeline.run}
ORACLES: dict = {"op3_rule_cascade": quality.ORACLE, "op8_winnowing": decontaminate.ORACLE, "op9_reply_trees": chat.ORACLE, "op10_dictionary_warc": warc.ORACLE, "op12_checkpointed_infill": infill.ORACLE}
