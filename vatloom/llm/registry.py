"""Queries of the training-data operators, and DuckDB SQL where SQL can express them."""

from . import decontaminate, fill_middle, fingerprint, html_text, langid, minhash, mixing, pii, preference, suffix_dedup, suffix_tree, toxicity, vector_codes

QUERIES = {
    "op2_suffix_tree": suffix_tree.op2_suffix_tree,
    "op3_suffix_dedup": suffix_dedup.op3_suffix_dedup,
    "op5_preference": preference.op5_preference,
    "op8_html": html_text.op8_html,
    "op7_fingerprint": fingerprint.op7_fingerprint,
    "op4_langid": langid.op4_langid,
    "op1_pii": pii.op1_pii,
    "op9_minhash": minhash.op9_minhash,
    "op10_decontaminate": decontaminate.op10_decontaminate,
    "op6_mixing": mixing.op6_mixing,
    "op11_toxicity": toxicity.op11_toxicity,
    "op12_vector_codes": vector_codes.op12_vector_codes,
    "op13_fill_middle": fill_middle.op13_fill_middle,
}
ORACLES = {
    "op5_preference": preference.OP5_SQL,
    "op10_decontaminate": decontaminate.OP10_SQL,
    "op6_mixing": mixing.OP6_SQL,
    "op12_vector_codes": vector_codes.OP12_SQL,
    "op13_fill_middle": fill_middle.OP13_SQL,
}
