"""Declared schemas of the engine's entities; a null in a score means that the stage was not reached."""

SOURCE_DOC = "doc_id string, title string, source_uri string, text string"
CHUNK = "chunk_id string, doc_id string, text string, token_count int, ordinal int"
RETRIEVED = "chunk_id string, text string, dense double, sparse double, fused double, rerank double"
CITATION = "chunk_id string, doc_id string, span struct<start: int, end: int>"
LATENCY = "retrieve double, rerank double, generate double"
ANSWER = "question string, text string, citations array<struct<chunk_id: string, doc_id: string, span: struct<start: int, end: int>>>, retrieved array<struct<chunk_id: string, text: string, dense: double, sparse: double, fused: double, rerank: double>>, latency_ms struct<retrieve: double, rerank: double, generate: double>"
REQUEST = "request_id bigint, question string, top_k int"
GROUND_TRUTH = "question string, reference_answer string, relevant_contexts array<string>"
SCORED_ITEM = (
    "git_sha string, run_id string, question string, faithfulness double, answer_relevance double, context_recall double, attribution string, generated_answer string, retrieved_json string, ts timestamp"
)
RUN = "run_id string, git_sha string, ts timestamp, faithfulness double, answer_relevance double, context_recall double, retrieval_fail bigint, generation_fail bigint"
MANIFEST = "corpus_name string, one_sentence string, source_base_url string, license_basis string, fetched_utc string, rfcs array<struct<number: int, title: string, cluster: string>>"
SEED = "question string, cluster string"
STREAM_EVENT = "request_id bigint, seq bigint, event string, data string"
