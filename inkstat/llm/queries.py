"""The queries of this package by name, and SQL for those that SQL can express."""

from . import ann, chat, decontaminate, language_id, lm_score, packing, quality, simhash, tokens, urls


def pipeline(spark, sf_dir):
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    "op1_fm_decontaminate": decontaminate.op1_fm_decontaminate,
    "op2_onebit_neighbours": ann.op2_onebit_neighbours,
    "op3_snapshot_chat": chat.op3_snapshot_chat,
    "op4_path_templates": urls.op4_path_templates,
    "op5_ppm_score": lm_score.op5_ppm_score,
    "op6_ppm_language": language_id.op6_ppm_language,
    "op7_token_output": tokens.op7_token_output,
    "op8_gam_quality": quality.op8_gam_quality,
    "op9_pivot_simhash": simhash.op9_pivot_simhash,
    "op10_nnls_packing": packing.op10_nnls_packing,
    "pipeline": pipeline,
}
ORACLE_SQL = {"op3_snapshot_chat": chat.OP3_SQL}
