"""The queries of this subpackage, by name, and SQL for those that SQL can express."""

from webloom.llm import decontaminate, language_id, licenses, line_dedup, near_dups, pieces, quality_model, quality_rules, repeats, token_store

QUERIES = {
    f.__name__: f
    for f in (
        language_id.op1_language_id,
        token_store.op2_token_store,
        licenses.op3_license_scan,
        near_dups.op4_near_duplicates,
        repeats.op5_repeated_strings,
        pieces.op6_sentencepiece,
        quality_model.op7_quality_classifier,
        quality_rules.op8_quality_rules,
        line_dedup.op9_line_dedup,
        decontaminate.op10_decontamination,
    )
}
SQL = {"op4_near_duplicates": near_dups.OP4_SQL, "op8_quality_rules": quality_rules.OP8_SQL, "op10_decontamination": decontaminate.OP10_SQL}
