"""Queries of the corpus operators and the SQL that gives the same rows, where SQL can."""

from __future__ import annotations

from loomspan.llm import bitplanes, compression, embeddings, fim, html_paths, langid, minhash, mixing, quality, secrets, sentencepiece, toolcalls, warc

QUERIES = {
    "op1_warc": warc.op1_warc,
    "op2_sentencepiece": sentencepiece.op2_sentencepiece,
    "op3_embedding_near_dedup": embeddings.op3_embedding_near_dedup,
    "op4_chat_tool_calls": toolcalls.op4_chat_tool_calls,
    "op5_source_mixing": mixing.op5_source_mixing,
    "op6_secret_scans": secrets.op6_secret_scans,
    "op7_quality_rules": quality.op7_quality_rules,
    "op8_minhash_near_dedup": minhash.op8_minhash_near_dedup,
    "op9_language_id": langid.op9_language_id,
    "op10_html_extraction": html_paths.op10_html_extraction,
    "op11_compression_quality": compression.op11_compression_quality,
    "op12_centroid_clusters": bitplanes.op12_centroid_clusters,
    "op13_fill_in_middle": fim.op13_fill_in_middle,
}

ORACLES = {
    "op1_warc": warc.ORACLE,
    "op3_embedding_near_dedup": embeddings.ORACLE,
    "op4_chat_tool_calls": toolcalls.ORACLE,
    "op5_source_mixing": mixing.ORACLE,
    "op6_secret_scans": secrets.ORACLE,
    "op8_minhash_near_dedup": minhash.ORACLE,
    "op12_centroid_clusters": bitplanes.ORACLE,
    "op13_fill_in_middle": fim.ORACLE,
}
