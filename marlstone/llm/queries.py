"""Queries of the training-data operators."""

from __future__ import annotations

from marlstone.llm.chat import OP11_SQL, op11_chat_format
from marlstone.llm.decontam import OP3_SQL, op3_decontaminate
from marlstone.llm.jaccard import op9_similar_components
from marlstone.llm.katz import op1_katz_scores
from marlstone.llm.langid import op2_language_id
from marlstone.llm.licenses import OP10_SQL, op10_license_scan
from marlstone.llm.merkle import OP13_SQL, op13_merkle_manifest
from marlstone.llm.negatives import OP12_SQL, op12_hard_negatives
from marlstone.llm.packing import op7_pack
from marlstone.llm.pii import op5_personal_data
from marlstone.llm.quality import op6_host_quality
from marlstone.llm.sharding import op8_ring_shards
from marlstone.llm.token_files import op4_token_files

QUERIES = {f.__name__: f for f in (op1_katz_scores, op2_language_id, op3_decontaminate, op4_token_files, op5_personal_data, op6_host_quality, op7_pack, op8_ring_shards, op9_similar_components, op10_license_scan, op11_chat_format, op12_hard_negatives, op13_merkle_manifest)}
ORACLES: dict[str, str] = {"op3_decontaminate": OP3_SQL, "op10_license_scan": OP10_SQL, "op11_chat_format": OP11_SQL, "op12_hard_negatives": OP12_SQL, "op13_merkle_manifest": OP13_SQL}
