"""Explicit schemas of the engine's records, as DDL; nothing is inferred."""

DOCUMENT = "id string, content string, source_type string, metadata map<string,string>"
CHUNK = "id string, doc_id string, content string, source_type string, chunk_index int, metadata map<string,string>"
QUESTION = "id string, text string, ground_truth string, source_type string, category string, difficulty string"
RETRIEVED = "question_id string, rank int, chunk_id string, score double, reasoning_path string"
INTENT = "query string, label string, method string, confidence double"
EVAL_RESULT = (
    "question_id string, question string, source_type string, category string, pipeline string, index_backend string, "
    "intent_label string, ground_truth string, predicted_answer string, answer_correct boolean, completeness double, "
    "overall_score double, agentic_strategy string, reranker string, cache_mode string, latency_ms double, "
    "recall_at_1 boolean, recall_at_3 boolean, recall_at_5 boolean"
)
EXPERIMENTS = "id string, name string, config string, created_at timestamp"
RUNS = "id string, experiment_id string, status string, started_at timestamp, finished_at timestamp, n_questions int"
EVAL_ROWS = (
    "id string, run_id string, question_id string, pipeline string, model_id string, source_type string, "
    "answer_correct int, completeness double, overall_score double, latency_ms double, cost_usd double, is_error int"
)
COST_RECORD = (
    "id string, run_id string, model_id string, stage string, input_tokens int, output_tokens int, cost_usd double, "
    "latency_ms int, timestamp double"
)
ANNOTATION = "question_id string, human_correct boolean, human_completeness double, experiment string"
JUDGE_SAMPLE = (
    "question_id string, question string, ground_truth string, predicted_answer string, judge_correct boolean, "
    "judge_completeness double, human_correct boolean, human_completeness double"
)
PROBE = "query string, expected_behavior string"
CHALLENGE = (
    "id string, title string, difficulty string, goal string, metric string, operator string, target double, "
    "filter map<string,string>, constraint struct<metric:string,operator:string,target:double>, hint string, "
    "concept string, locked_params array<string>"
)
BLOCK = (
    "block_id string, block_type string, page int, section string, text string, table_id string, caption string, "
    "rows array<array<string>>, bbox struct<x0:double,top:double,x1:double,bottom:double>, seq int"
)
WORD = "page int, text string, x0 double, x1 double, top double, bottom double"
RETRIEVAL_LOG = "timestamp timestamp, query string, index_backend string, num_chunks int, scores array<double>, source_types array<string>, top_chunk_preview string"
TRACE = (
    "query_id string, query string, pipeline string, intent struct<label:string,confidence:double>, cache_hit boolean, "
    "reranked boolean, retrieval_hops array<struct<hop:int,query:string,chunk_ids:array<string>>>, latency_ms double, "
    "input_tokens int, output_tokens int"
)
EXAMPLE = "question string, answer string, reasoning string"
