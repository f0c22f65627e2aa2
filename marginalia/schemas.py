"""Schemas of the stored tables, as DDL."""

CHUNKS = "id long, chunk_text string not null, parent_text string, chunk_vector array<float>, doc_name string not null, doc_page int, chunk_index int, created_by string, created_at timestamp, updated_at timestamp"
FAQ = "id long, question string not null, question_vector array<float>, answer string not null, category string, source_doc string, source_page int, confidence double, created_by string, created_at timestamp, updated_at timestamp"
HISTORY = "id long, session_id string not null, role string not null, content string not null, created_at timestamp"
FAQ_JSON = "query string, pos array<string>, neg array<string>, question string, answer string, vector array<float>, metadata struct<source_doc:string,category:string,source_page:int,confidence:double,created_by:string>, _bad string"
TELEMETRY = "timestamp string, event_type string, data map<string,string>"
