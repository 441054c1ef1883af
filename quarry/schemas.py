"""Schemas of the records that pass between operators."""

from __future__ import annotations

DOCUMENT = "doc_id string, text string, source_path string, doc_type string, doc_hash string, title string, page_spans array<struct<page:int,start_offset:int,end_offset:int>>, images array<struct<id:string,path:string,page:int>>, metadata map<string,string>"
CHUNK = "doc_id string, chunk_index int, chunk_id string, start_offset int, end_offset int, text string, metadata map<string,string>"
RESULT = "query_id bigint, rank int, chunk_id string, score double, text string, metadata map<string,string>"
TRACE = "trace_id string, trace_type string, started_at string, finished_at string, total_elapsed_ms double, stages array<struct<stage:string,timestamp:string,elapsed_ms:double,data:map<string,string>>>, metadata map<string,string>"
CASE = "case_id string, query string, reference_answer string, evidences array<struct<document_name:string,page_number:int,text:string>>, metadata map<string,string>"
GOLDEN = "query string, expected_chunk_ids array<string>, expected_sources array<string>, reference_answer string"
HISTORY = "file_hash string, file_path string, status string, collection string, error_msg string, processed_at string, updated_at string"
IMAGE = "image_id string, file_path string, collection string, doc_hash string, page_num int, created_at string"
CHECKPOINT = "case_key string, result struct<query:string,case_id:string,retrieved_chunk_ids:array<string>,generated_answer:string,metrics:map<string,double>,elapsed_ms:double>"
BENCHMARK_ROW = "case_id string, question string, answer string, doc_name string, question_type string, question_reasoning string, company string, justification string, evidence array<struct<doc_name:string,page_num:int,text:string>>"
