"""The registered queries of the training-data operators, and the SQL of those that SQL can express."""

from __future__ import annotations

from tessera.llm import bpe, chat, fim, fingerprint, jaccard, mixing, pii, quality, rules, spelling, toxicity, urls, warc

QUERIES = {
    "op1_bpe": bpe.op1_bpe,
    "op2_pii": pii.op2_pii,
    "op3_toxicity": toxicity.op3_toxicity,
    "op4_chat": chat.op4_chat,
    "op5_mixing": mixing.op5_mixing,
    "op6_jaccard": jaccard.op6_jaccard,
    "op7_url_filter": urls.op7_url_filter,
    "op8_fingerprint": fingerprint.op8_fingerprint,
    "op9_quality": quality.op9_quality,
    "op10_warc": warc.op10_warc,
    "op11_fim": fim.op11_fim,
    "op12_spelling": spelling.op12_spelling,
    "op13_rules": rules.op13_rules,
}

SQL = {
    "op4_chat": chat.OP4_SQL,
    "op7_url_filter": urls.OP7_SQL,
    "op10_warc": warc.OP10_SQL,
    "op11_fim": fim.OP11_SQL,
}
