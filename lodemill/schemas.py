"""Schemas of the engine's tables."""

from __future__ import annotations

DOCUMENT = "id long, title string, content string, source string, document_type string, status string, batch_id string, parent_id long, create_time timestamp, update_time timestamp, metadata map<string,string>, position int, vectorized boolean, error_message string"
CHUNK = "id long, document_id long, content string, start_position long, end_position long, chunk_index int, metadata map<string,string>, create_time timestamp, update_time timestamp, vectorized boolean, vector_id long, overlap_length int, quality_score double"
VECTOR = "id long, external_id string, vector_type string, dimensions int, embedding array<float>, index_name string, create_time timestamp, update_time timestamp, metadata map<string,string>, embedding_model string, vector_norm double, vector_category string, content_summary string, space_type string, is_primary boolean"
QUERY = "id long, user_id string, session_id string, original_text string, processed_text string, status string, query_type string, route_target string, create_time timestamp, complete_time timestamp, latency_ms long, metadata string, query_variants string, decomposed_queries string, response_ids string, error_message string, retrieval_params string"
RESPONSE = "id long, query_id long, session_id string, answer_text string, retrieved_context string, context_sources string, status string, create_time timestamp, complete_time timestamp, latency_ms long, model_name string, generation_params string, evaluation_metrics string, faithfulness_score int, relevance_score int, error_message string, need_review boolean, metadata string, corrected_answer_text string, response_type string"
RULE = "id long, rule_type string, rule_content string, task_type string, topic_domain string, target_processor string, confidence double, priority int, is_active boolean, match_mode string, allow_cascade boolean, lock_processor boolean, route_key string, semantic_threshold double, create_time timestamp, update_time timestamp"
EDGE = "id long, source_type string, source_id string, target_type string, target_id string, status int"
PAGE_CACHE = "doc_key string, page_no int, page_count int, ok boolean, retries int, content string, cached_at timestamp"

#: Kinds of tasks, topics and vectors that the tables hold.
TASKS = ("FAQ", "FACT_LOOKUP", "ANALYSIS", "COMPARISON", "TROUBLESHOOT", "SUMMARIZATION", "DECISION_SUPPORT", "ORDER_LOOKUP", "CHAT", "TASK", "UNKNOWN")
STATUSES = ("PENDING", "PROCESSING", "INDEXED", "FAILED")
VECTOR_TYPES = ("DOCUMENT", "CHUNK", "QUERY", "HYBRID")
