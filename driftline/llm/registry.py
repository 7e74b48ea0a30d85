"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from . import ann, codes, divergence, language, licenses, mixing, packing, pii, secrets, simhash, substrings, topk, toxicity

QUERIES = {
    "op1_pii": pii.op1_pii,
    "op2_secrets": secrets.op2_secrets,
    "op3_substrings": substrings.op3_substrings,
    "op4_ann": ann.op4_ann,
    "op5_simhash": simhash.op5_simhash,
    "op6_language": language.op6_language,
    "op7_topk": topk.op7_topk,
    "op8_mixing": mixing.op8_mixing,
    "op9_packing": packing.op9_packing,
    "op10_toxicity": toxicity.op10_toxicity,
    "op11_codes": codes.op11_codes,
    "op12_licenses": licenses.op12_licenses,
    "op13_divergence": divergence.op13_divergence,
}
SQL = {
    "op3_substrings": substrings.SQL,
    "op7_topk": topk.SQL,
    "op8_mixing": mixing.SQL,
    "op11_codes": codes.SQL,
    "op13_divergence": divergence.SQL,
}
