"""Registered queries of the training-data operators."""

from __future__ import annotations

from loomkv.llm import chat, decontaminate, language_id, packing, quality_model, quality_rules, secrets, sharding, simhash, token_files


def queries() -> dict:
    import corpus_pipeline

    return {
        "op1_decontamination": decontaminate.query,
        "op2_token_files": token_files.query,
        "op3_quality_rules": quality_rules.query,
        "op4_simhash": simhash.query,
        "op5_chat_format": chat.query,
        "op6_secret_scan": secrets.query,
        "op7_language_id": language_id.query,
        "op8_packing": packing.query,
        "op9_sharding": sharding.query,
        "op10_quality_model": quality_model.query,
        "decontamination_proximity": decontaminate.proximity_query,
        "pages_language_id": language_id.pages_query,
        "pipeline": corpus_pipeline.run,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_decontamination": decontaminate.SQL, "decontamination_proximity": decontaminate.PROXIMITY_SQL, "op3_quality_rules": quality_rules.SQL, "op5_chat_format": chat.SQL, "op6_secret_scan": secrets.SQL}
