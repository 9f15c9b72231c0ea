"""Schemas of the tables that operators exchange."""

DOCUMENTS = "doc_id string, content string, tokens array<string>, segment_id bigint, group_id int"
COMMANDS = "type string, doc struct<doc_id: string, tokens: array<string>>, doc_id string, seq bigint, appended bigint"
QUERIES = "query_id bigint, raw string, tokens array<string>, tags array<string>"
POSTINGS = "namespace string, group_id int, segment_id bigint, term string, doc_id string, tf bigint, dl int, bm25 double"
LENGTHS = "namespace string, group_id int, segment_id bigint, doc_id string, dl int"
SEGMENTS = "namespace string, group_id int, segment_id bigint, num_docs bigint, total_length bigint, avg_length bigint, create_time timestamp, version int, num_postings bigint, checksum bigint"
TOMBSTONES = "namespace string, doc_id string, upto bigint"
HITS = "query_id bigint, segment_id bigint, doc_id string, bm25_score double"
NAMESPACES = "namespace string, shard_num int, replica_factor int, initial boolean"
SHARDS = "namespace string, group_id int, replica_id int, node string, node_status string, next string, todo string"
NODES = "addr string, status string"
MEMBERS = "namespace string, addr string"
