"""Queries of the training-data operators, and their DuckDB SQL."""

from __future__ import annotations

from tessera.llm import alignment, bpe, embeddings, langid, licenses, packing, pieces, ppm, quality, runs, sharding, simhash, warc

QUERIES = {
    "op1_language": langid.op1_language,
    "op2_length_buckets": packing.op2_length_buckets,
    "op3_simhash": simhash.op3_simhash,
    "op4_bpe": bpe.op4_bpe,
    "op5_embeddings": embeddings.op5_embeddings,
    "op6_quality": quality.op6_quality,
    "op7_jump_shards": sharding.op7_jump_shards,
    "op8_licenses": licenses.op8_licenses,
    "op9_ppm": ppm.op9_ppm,
    "op10_warc": warc.op10_warc,
    "op11_runs": runs.op11_runs,
    "op12_sentencepiece": pieces.op12_sentencepiece,
    "op13_alignment": alignment.op13_alignment,
}

ORACLE = {
    "op2_length_buckets": packing.ORACLE_SQL,
    "op5_embeddings": embeddings.ORACLE_SQL,
    "op6_quality": quality.ORACLE_SQL,
    "op8_licenses": licenses.ORACLE_SQL,
    "op10_warc": warc.ORACLE_SQL,
}
