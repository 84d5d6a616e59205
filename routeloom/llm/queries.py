"""The registered queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from routeloom.llm import chat, decontamination, jaccard_join, licenses, mixing, pii, quality_model, quality_rules, sharding, token_shards

QUERIES = {
    "op1_quality_model": quality_model.query,
    "op2_mixing": mixing.query,
    "op3_quality_rules": quality_rules.query,
    "op4_sharding": sharding.query,
    "op5_chat": chat.query,
    "op6_decontamination": decontamination.query,
    "op7_pii": pii.query,
    "op8_jaccard_join": jaccard_join.query,
    "op9_licenses": licenses.query,
    "op10_token_shards": token_shards.query,
    # what SQL can say of operators that it cannot express
    "quality_rule_counts": quality_rules.base_counts_query,
    "personal_data_counts": pii.base_counts,
}

SQL = {
    "op2_mixing": mixing.SQL,
    "op4_sharding": sharding.SQL,
    "op5_chat": chat.SQL,
    "op6_decontamination": decontamination.SQL,
    "op8_jaccard_join": jaccard_join.SQL,
    "op9_licenses": licenses.SQL,
    "quality_rule_counts": quality_rules.BASE_SQL,
    "personal_data_counts": pii.BASE_SQL,
}
