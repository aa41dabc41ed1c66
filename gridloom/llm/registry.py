"""Queries and SQL of the training-data operators, by name."""

from __future__ import annotations

import corpus_pipeline
from gridloom.llm import bpe, chat, exact, langid, manifest, media, mixing, neardup, pii, quality, rules, warc, whitening

QUERIES = {
    "op1_chat": chat.op1_chat,
    "op2_warc": warc.op2_warc,
    "op3_mixing": mixing.op3_mixing,
    "op4_quality": quality.op4_quality,
    "op5_minhash": neardup.op5_minhash,
    "op6_langid": langid.op6_langid,
    "op7_media": media.op7_media,
    "op8_rules": rules.op8_rules,
    "op9_bpe": bpe.op9_bpe,
    "op10_pii": pii.op10_pii,
    "op11_whitening": whitening.op11_whitening,
    "op12_merkle": manifest.op12_merkle,
    "op13_exact": exact.op13_exact,
    "pipeline": corpus_pipeline.run,
}
SQL: dict[str, str] = {
    "op1_chat": chat.SQL,
    "op2_warc": warc.SQL,
    "op3_mixing": mixing.SQL,
    "op8_rules": rules.SQL,
    "op12_merkle": manifest.SQL,
    "op13_exact": exact.SQL,
}


def queries():
    return dict(QUERIES)


def oracle_sql():
    return dict(SQL)
