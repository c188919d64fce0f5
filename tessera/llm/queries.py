"""The queries of this subpackage and their SQL, for __spark_entry__.py."""

from __future__ import annotations

from . import chat, fingerprint, langid, mixing, neardup, packing, resharding, secrets, tokenio, topk

QUERIES = {
    "op1_best_fit_packing": packing.op1_best_fit_packing,
    "op2_secret_scan": secrets.op2_secret_scan,
    "op3_resharding": resharding.op3_resharding,
    "op4_minhash_neardup": neardup.op4_minhash_neardup,
    "op5_token_binary": tokenio.op5_token_binary,
    "op6_source_mixing": mixing.op6_source_mixing,
    "op7_chat_format": chat.op7_chat_format,
    "op8_fingerprints": fingerprint.op8_fingerprints,
    "op9_language_id": langid.op9_language_id,
    "op10_exact_topk": topk.op10_exact_topk,
}

ORACLE_SQL = {
    "op2_secret_scan": secrets.OP2_SQL,
    "op4_minhash_neardup": neardup.OP4_SQL,
    "op6_source_mixing": mixing.OP6_SQL,
    "op7_chat_format": chat.OP7_SQL,
    "op10_exact_topk": topk.OP10_SQL,
}
