"""The registered queries of this subpackage."""

from __future__ import annotations

from tidemill.llm import (
    alignment,
    byte_bpe,
    decontamination,
    embeddings,
    fingerprints,
    importance,
    language,
    ngram_join,
    packing,
    quality,
    token_counts,
    token_files,
    warc,
)

QUERIES = {
    "op1_token_counts": token_counts.op1_token_counts,
    "op2_language": language.op2_language,
    "op3_token_files": token_files.op3_token_files,
    "op4_quality": quality.op4_quality,
    "op5_embedding_dedup": embeddings.op5_embedding_dedup,
    "op6_byte_bpe": byte_bpe.op6_byte_bpe,
    "op7_warc": warc.op7_warc,
    "op8_ngram_join": ngram_join.op8_ngram_join,
    "op9_fingerprints": fingerprints.op9_fingerprints,
    "op10_packing": packing.op10_packing,
    "op11_decontamination": decontamination.op11_decontamination,
    "op12_importance": importance.op12_importance,
    "op13_alignment": alignment.op13_alignment,
}

#: The others cannot be written in SQL: their tests use brute force, round trips or held-out accuracy.
ORACLE_SQL: dict[str, str] = {
    "op11_decontamination": decontamination.ORACLE_SQL,
    "op12_importance": importance.ORACLE_SQL,
}
