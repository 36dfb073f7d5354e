"""Queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from graphloom.llm import pipeline
from graphloom.llm.ann import op1_ann
from graphloom.llm.byte_bpe import op3_byte_bpe
from graphloom.llm.fingerprints import op6_fingerprints
from graphloom.llm.id_files import op9_id_files
from graphloom.llm.near_dedup import op7_near_dedup
from graphloom.llm.packing import op5_packing
from graphloom.llm.pii import op2_pii
from graphloom.llm.quality import op10_quality
from graphloom.llm.token_counts import op4_token_counts
from graphloom.llm.toxicity import op8_toxicity

QUERIES = {
    "op1_ann": op1_ann,
    "op2_pii": op2_pii,
    "op3_byte_bpe": op3_byte_bpe,
    "op4_token_counts": op4_token_counts,
    "op5_packing": op5_packing,
    "op6_fingerprints": op6_fingerprints,
    "op7_near_dedup": op7_near_dedup,
    "op8_toxicity": op8_toxicity,
    "op9_id_files": op9_id_files,
    "op10_quality": op10_quality,
    "pipeline": pipeline.run,
}

#: The ten operators hash, learn, search or code in ways that SQL does not express; tests/llm holds them against brute force.
ORACLE_SQL: dict[str, str] = {}
