"""The operators' queries, and SQL for those that SQL can express."""

from ploidlens.llm import html, idfiles, jaccard, langid, licenses, mixing, packing, pii, quality, webp

QUERIES = {
    "op1_html_main_text": html.op1_html_main_text,
    "op2_language_id": langid.op2_language_id,
    "op3_jaccard_join": jaccard.op3_jaccard_join,
    "op4_best_fit_packing": packing.op4_best_fit_packing,
    "op5_id_files": idfiles.op5_id_files,
    "op6_mix_sources": mixing.op6_mix_sources,
    "op7_pii": pii.op7_pii,
    "op8_webp_media": webp.op8_webp_media,
    "op9_license_scan": licenses.op9_license_scan,
    "op10_quality_rules": quality.op10_quality_rules,
}
ORACLE_SQL = {"op3_jaccard_join": jaccard.SQL, "op6_mix_sources": mixing.SQL, "op9_license_scan": licenses.oracle()}
