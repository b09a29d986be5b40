"""The queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from . import ann, licenses, mixing, pieces, pii, repeats, secrets, simhash, topk, toxicity

QUERIES = {
    "op1_simhash": simhash.op1_simhash,
    "op2_mixing": mixing.op2_mixing,
    "op3_secret_scan": secrets.op3_secret_scan,
    "op4_toxicity": toxicity.op4_toxicity,
    "op5_sentencepiece": pieces.op5_sentencepiece,
    "op6_exact_top_k": topk.op6_exact_top_k,
    "op7_license_scan": licenses.op7_license_scan,
    "op8_pii": pii.op8_pii,
    "op9_nearest_neighbours": ann.op9_nearest_neighbours,
    "op10_repeats": repeats.op10_repeats,
}

SQL = {
    "op7_license_scan": licenses.OP7_SQL,
    "op6_exact_top_k": topk.OP6_SQL,
}
