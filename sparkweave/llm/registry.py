"""The queries of this subpackage and their oracles."""

from sparkweave.llm import bitsliced, decontamination, hardneg, jaccard, licenses, merkle, packing, pii, quality, recompression, simhash, toxicity, urls

QUERIES = {
    "op1_best_fit_packing": packing.op1_best_fit_packing,
    "op2_bit_sliced_top_k": bitsliced.op2_bit_sliced_top_k,
    "op3_quality": quality.op3_quality,
    "op4_license_scan": licenses.op4_license_scan,
    "op5_url_filter": urls.op5_url_filter,
    "op6_decontamination": decontamination.op6_decontamination,
    "op7_simhash_covering": simhash.op7_simhash_covering,
    "op8_toxicity": toxicity.op8_toxicity,
    "op9_pii": pii.op9_pii,
    "op10_recompression": recompression.op10_recompression,
    "op11_ngram_jaccard_join": jaccard.op11_ngram_jaccard_join,
    "op12_hard_negatives": hardneg.op12_hard_negatives,
    "op13_merkle_manifest": merkle.op13_merkle_manifest,
}
ORACLE: dict[str, str] = {
    "op2_bit_sliced_top_k": bitsliced.OP2_SQL,
    "op12_hard_negatives": hardneg.OP12_SQL,
    "op13_merkle_manifest": merkle.OP13_SQL,
}
