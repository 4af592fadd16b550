"""The registered queries of this subpackage, and their SQL."""

from __future__ import annotations

from kinfold.llm import bpe, chat, katz, langid, licenses, mixing, neighbours, negatives, ngram_join, passages, quality, resampling, token_files

QUERIES = {
    "op1_quality": quality.op1_quality,
    "op2_bpe": bpe.op2_bpe,
    "op3_mixing": mixing.op3_mixing,
    "op4_katz": katz.op4_katz,
    "op5_licenses": licenses.op5_licenses,
    "op6_langid": langid.op6_langid,
    "op7_ngram_join": ngram_join.op7_ngram_join,
    "op8_chat": chat.op8_chat,
    "op9_neighbours": neighbours.op9_neighbours,
    "op10_token_files": token_files.op10_token_files,
    "op11_passages": passages.op11_passages,
    "op12_negatives": negatives.op12_negatives,
    "op13_resampling": resampling.op13_resampling,
}

#: DuckDB SQL for the queries that SQL can express.
ORACLES: dict[str, str] = {
    "op3_mixing": mixing.OP3_SQL,
    "op5_licenses": licenses.OP5_SQL,
    "op8_chat": chat.OP8_SQL,
    "op12_negatives": negatives.OP12_SQL,
}
