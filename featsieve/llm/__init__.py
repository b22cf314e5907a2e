"""Operators of a training-data pipeline over documents and embeddings."""

from . import addressable_codes, byte_bpe, cotrain_quality, credential_links, crf_language, dart_minhash, inverted_multi_index, multiset_hash, packing, paragraph_banding, poisson_mix, role_repair, whitening

QUERIES = {
    "op1_dart_minhash": dart_minhash.op1_dart_minhash,
    "op2_inverted_multi_index": inverted_multi_index.op2_inverted_multi_index,
    "op3_cost_balanced_packing": packing.op3_cost_balanced_packing,
    "op4_crf_language": crf_language.op4_crf_language,
    "op5_cotrain_quality": cotrain_quality.op5_cotrain_quality,
    "op6_paragraph_banding": paragraph_banding.op6_paragraph_banding,
    "op7_poisson_mix": poisson_mix.op7_poisson_mix,
    "op8_credential_links": credential_links.op8_credential_links,
    "op9_multiset_hash": multiset_hash.op9_multiset_hash,
    "op10_addressable_codes": addressable_codes.op10_addressable_codes,
    "op11_chebyshev_whitening": whitening.op11_chebyshev_whitening,
    "op12_byte_bpe": byte_bpe.op12_byte_bpe,
    "op13_role_repair": role_repair.op13_role_repair,
}
SQL = {"op7_poisson_mix": poisson_mix.TWIN, "op9_multiset_hash": multiset_hash.TWIN}
