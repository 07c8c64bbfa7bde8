
from __future__ import annotations

#: Rows that are no query of a data engine.
OUT_OF_SCOPE = {
    "S9": "needs a PDF library", "S14": "upload service", "S16": "HTTP live stream", "ST11": "replaced by task retries and checkpoints",
}

#: Rows shown by functions that no query of the test tables fits, with where they are tested.
TESTED = {
    "S1": "sources/files.observe: tests/test_operators.py::test_files",
    "S6": "sources/files.decode: tests/test_operators.py::test_files",
    "S13": "sources/log.read_golden, golden_json",
}

SHOWN = {
    "S2": "blob_store", "S3": "new_artifacts", "S4": "log_append", "S5": "log_scan", "S7": "markdown_structure", "S8": "code_definitions python_definitions",
    "S10": "parser_dispatch", "S11": "kind_by_suffix", "S12": "export_items export_json export_markdown", "S15": "stream_ingest", "S17": "message_ingest message_items correction_chains superseded_messages",
    "F1": "current_and_live", "F2": "search_filters search_filters_deleted", "F3": "conjunctive_tag_filter", "F4": "all_of_tags", "F5": "memories_in_range",
    "F6": "stale_rows", "F7": "substring_search", "F8": "suffix_match", "F9": "choice_phrases", "F10": "not_reviewed", "F11": "row_value_in", "F12": "glob_exclusion",
    "F13": "row_level_scope", "F14": "second_page",
    "J1": "inner_join revenue_by_nation", "J2": "left_join_zero_kept source_list", "J3": "left_join_aggregates", "J4": "semi_join", "J5": "anti_join not_reviewed",
    "J6": "customers_without_urgent_orders unreturned_parts", "J7": "key_difference vanished_files", "J8": "cooccurrence", "J9": "pairwise_similarity", "J10": "merge_chain_resolution",
    "J11": "correction_chains final_corrections", "J12": "interval_join", "J13": "span_overlap", "J14": "natural_key_relink", "J15": "jaccard_history", "J16": "term_overlap unstated_assumptions",
    "J17": "memories_as_of", "J18": "connections",
    "A1": "stats_one_pass", "A2": "distinct_edges graph_relations", "A3": "filtered_counts", "A4": "provenance_profile", "A5": "observed_bounds", "A6": "entity_stats near_duplicate_names",
    "A7": "entity_df_hubs", "A8": "latest_verdict", "A9": "success_rate", "A10": "group_hold_rates", "A11": "event_stats event_latency", "A12": "surfacing_stats surfacing_thresholds",
    "A13": "importance_evidence", "A14": "cooccurrence", "A15": "weekly_rhythm", "A16": "corpus_fingerprint", "A17": "system_report", "A18": "doctor_checks", "A19": "relation_counts",
    "A20": "purge_scope", "A21": "metric_summary value_summary", "A22": "nearest_rank_percentile", "A23": "weight_tuning",
    "W1": "find_gaps_by_user find_gaps_by_source", "W2": "version_fold", "W3": "version_changes", "W4": "rrf_fusion ranking_windows", "W5": "best_rank_seeds", "W6": "sessionize",
    "W7": "message_ordinals", "W8": "latest_verdict latest_hits_per_query", "W9": "rerank_tail", "W10": "facet_stability", "W11": "history_pairs",
    "L1": "vector_topk", "L2": "keyword_topk", "L3": "nulls_last_order nulls_first_order", "L4": "random_sample", "L5": "ordering_top_k", "L6": "rerank_tail", "L7": "next_claim",
    "L8": "mmr_select prompt_packing", "L9": "history_compaction",
    "U1": "union_distinct connections", "U2": "intersect_keys shared_entities", "U3": "except_keys key_difference", "U4": "replay_diff graph_divergence", "U5": "best_unordered_pair", "U6": "rrf_fusion union_all",
    "R1": "ann_topk", "R2": "vector_topk", "R3": "not_unit_vectors", "R4": "keyword_topk keyword_grammar postings stored_index", "R5": "hybrid_documents hybrid_filtered", "R6": "rrf_fusion weighted_rrf", "R7": "five_signal_fusion",
    "R8": "chunk_grouping", "R9": "rerank_tail", "R10": "recency_scores", "R11": "importance_scores", "R12": "temporal_intents", "R13": "intent_application", "R14": "five_signal_fusion",
    "R15": "citation_excerpts", "R16": "citation_integrity", "R17": "mmr_select", "R18": "mmr_select", "R19": "context_assembly", "R20": "prompt_packing", "R21": "ann_recall", "R22": "ir_metrics",
    "R23": "golden_evaluation golden_worst", "R24": "weight_tuning",
    "G1": "graph_mentions graph_relations", "G2": "graph_hash", "G3": "graph_divergence", "G4": "graph_upsert", "G5": "graph_prune", "G6": "graph_neighbours", "G7": "mention_edges", "G8": "graph_reach graph_reach_past_hubs",
    "G9": "hub_suppressed_expansion entity_df_hubs", "G10": "graph_sync_scope", "G11": "graph_label_counts", "G12": "connected_components similar_components",
    "E1": "canonical_keys", "E2": "canonical_names", "E3": "canonical_keys near_duplicate_names", "E4": "exact_candidates", "E5": "alias_candidates", "E6": "similar_names", "E7": "winner_choice",
    "E8": "merge_collisions merge_ledger", "E9": "normalize_text", "E10": "chunks", "E11": "sentences", "E12": "token_count", "E13": "embedding_cache", "E14": "version_changes", "E15": "diff_spans line_diff", "E16": "tags",
    "E17": "message_intent", "E18": "refers_back", "E19": "session_titles", "E20": "citation_grounding", "E21": "summary_grounding technical_terms", "E22": "reflection_list", "E23": "query_kinds",
    "E24": "entity_extraction", "E25": "entity_extraction",
    "T1": "activity_by_day activity_by_week activity_by_month", "T2": "activity_in_range", "T3": "activity_by_day activity_in_range", "T4": "memories_as_of", "T5": "memories_in_range", "T6": "out_of_order",
    "T7": "find_gaps_by_user find_gaps_by_type find_gaps_by_source", "T8": "version_changes diff_spans line_diff", "T9": "facet_changes", "T10": "confidence_horizon", "T11": "outcome_window",
    "M1": "wilson_intervals", "M2": "calibration_bands", "M3": "pattern_confidence", "M4": "support_needed", "M5": "pattern_confidence group_hold_rates", "M6": "timing_pattern", "M7": "choice_pattern",
    "M8": "calibration_bands", "M9": "pattern_discovery", "M10": "gap_analysis unstated_assumptions orphaned_work", "M11": "user_model user_model_changes pattern_discovery", "M12": "assessment", "M13": "trajectory_scores",
    "M14": "claim_support answer_verdicts", "M15": "answer_evaluation", "M16": "record_validation",
    "ST1": "stream_ingest", "ST2": "pending_dedupe", "ST3": "rate_limit rate_limit_window", "ST4": "debounce stream_debounce", "ST5": "sessionize session_windows", "ST6": "delivery_lag event_latency", "ST7": "fan_out",
    "ST8": "precompute_policy", "ST9": "surfacing_gate", "ST10": "surfacing_thresholds feedback_bar", "ST12": "pipeline_stages", "ST13": "tombstones restored_items purge_rules",
    "ST14": "tumbling_windows sliding_windows stream_tumbling stream_sliding stream_join",
    "Q1": "source_list", "Q2": "memory_detail", "Q3": "decision_list", "Q4": "decision_detail", "Q5": "assumption_list", "Q6": "group_candidate_pairs", "Q7": "review_queue", "Q8": "pattern_list evidence_by_side",
    "Q9": "reflection_list", "Q10": "event_tail", "Q11": "surfacing_log", "Q12": "session_list superseded_messages", "Q13": "processing_status", "Q14": "backfill_targets", "Q15": "live_model",
    "Q16": "assumption_proposals", "Q17": "entity_lookup",
}

#: Shapes of section 2.16, which the reference lacks and Spark gives.
EXTRAS = "rollup cube grouping_sets pivot intersect_all except_all full_outer_join ranking_windows frame_windows range_window lateral_top_n column_encryption"
