"""The queries of this subpackage for the driver's contract, and their SQL where SQL can express them."""

from __future__ import annotations

from docmill.llm import classifier, embeddings, html_text, mixing, packing, rules, sharding, simhash, token_files, warc


def queries() -> dict:
    return {
        "op1_best_fit_packing": packing.query,
        "op2_quality_classifier": classifier.query,
        "op3_warc_bundles": warc.query,
        "op4_simhash_byte_index": simhash.query,
        "op5_html_tree_model": html_text.query,
        "op6_rendezvous_sharding": sharding.query,
        "op7_divergence_rules": rules.query,
        "op8_itq_hamming_tables": embeddings.query,
        "op9_bit_plane_token_files": token_files.query,
        "op10_temperature_mixing": mixing.query,
    }


def oracle_sql() -> dict[str, str]:
    return {"op3_warc_bundles": warc.oracle(), "op10_temperature_mixing": mixing.oracle()}
