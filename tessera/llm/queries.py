"""The queries of the corpus operators and their SQL."""

from __future__ import annotations

from tessera.llm import divergence_audit, exact_dedup, html_extraction, language_id, license_scan, line_dedup, merkle_manifest, minhash, mixing, packing, quality_classifier, quality_rules, substring_dedup

QUERIES = {
    "op1_line_dedup": line_dedup.op1_line_dedup,
    "op2_license_scan": license_scan.op2_license_scan,
    "license_notice_lines": license_scan.license_notice_lines,
    "op3_packing": packing.op3_packing,
    "op4_language_id": language_id.op4_language_id,
    "op5_quality_classifier": quality_classifier.op5_quality_classifier,
    "op6_minhash_near_dedup": minhash.op6_minhash_near_dedup,
    "op7_mixing": mixing.op7_mixing,
    "op8_quality_rules": quality_rules.op8_quality_rules,
    "op9_exact_dedup": exact_dedup.op9_exact_dedup,
    "op10_substring_dedup": substring_dedup.op10_substring_dedup,
    "op11_merkle_manifest": merkle_manifest.op11_merkle_manifest,
    "op12_html_extraction": html_extraction.op12_html_extraction,
    "op13_source_divergence": divergence_audit.op13_source_divergence,
}
SQL = {
    "op1_line_dedup": line_dedup.OP1_SQL,
    "op2_license_scan": license_scan.OP2_SQL,
    "license_notice_lines": license_scan.NOTICES_SQL,
    "op6_minhash_near_dedup": minhash.OP6_SQL,
    "op7_mixing": mixing.OP7_SQL,
    "op8_quality_rules": quality_rules.OP8_SQL,
    "op9_exact_dedup": exact_dedup.OP9_SQL,
    "op10_substring_dedup": substring_dedup.OP10_SQL,
    "op11_merkle_manifest": merkle_manifest.OP11_SQL,
    "op12_html_extraction": html_extraction.OP12_SQL,
    "op13_source_divergence": divergence_audit.OP13_SQL,
}
