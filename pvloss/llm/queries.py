"""Queries of the training-text operators and the SQL that checks them."""

import corpus_pipeline

from . import bpe_queries, chat_queries, decontam_queries, idstore_queries, importance_queries, pivots_queries, quality_lm_queries, quality_queries, simhash_queries, tokencount_queries, toxicity_queries, turnrepair_queries, urlfilter_queries


def queries():
    return {
        "op1_decontaminate": decontam_queries.op1_decontaminate,
        "op2_quality_rules": quality_lm_queries.op2_quality_rules,
        "op3_quality_cnn": quality_queries.op3_quality_cnn,
        "op4_token_counts": tokencount_queries.op4_token_counts,
        "op5_simhash_dedup": simhash_queries.op5_simhash_dedup,
        "op6_byte_bpe": bpe_queries.op6_byte_bpe,
        "op7_id_store": idstore_queries.op7_id_store,
        "op8_chat_format": chat_queries.op8_chat_format,
        "op9_url_filter": urlfilter_queries.op9_url_filter,
        "op10_toxicity": toxicity_queries.op10_toxicity,
        "op11_importance": importance_queries.op11_importance,
        "op12_turn_repair": turnrepair_queries.op12_turn_repair,
        "op13_pivot_index": pivots_queries.op13_pivot_index,
        "pipeline": corpus_pipeline.run,
    }


def oracle_sql():
    return {
        "op1_decontaminate": decontam_queries.ORACLE,
        "op8_chat_format": chat_queries.ORACLE,
        "op9_url_filter": urlfilter_queries.ORACLE,
        "op13_pivot_index": pivots_queries.ORACLE,
    }
