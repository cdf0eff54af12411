"""The registered queries of this subpackage and, where SQL can state them, their SQL."""

from __future__ import annotations

from wordmill.llm import bpe, clustering, codes, jaccard, langid, licenses, lines, mixing, neardup, packing, pii, topk, toxicity

QUERIES = {
    "op1_topk": topk.op1_topk,
    "op2_pii": pii.op2_pii,
    "op3_line_dedup": lines.op3_line_dedup,
    "op4_toxicity": toxicity.op4_toxicity,
    "op5_bpe": bpe.op5_bpe,
    "op6_mixing": mixing.op6_mixing,
    "op7_neardup": neardup.op7_neardup,
    "op8_language": langid.op8_language,
    "op9_jaccard": jaccard.op9_jaccard,
    "op10_licenses": licenses.op10_licenses,
    "op11_codes": codes.op11_codes,
    "op12_packing": packing.op12_packing,
    "op13_clustering": clustering.op13_clustering,
}
ORACLES: dict[str, str] = {
    "op1_topk": topk.ORACLE,
    "op3_line_dedup": lines.ORACLE,
    "op7_neardup": neardup.ORACLE,
    "op11_codes": codes.ORACLE,
    "op13_clustering": clustering.ORACLE,
}
