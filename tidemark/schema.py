"""Column layouts of the data model, as DDL strings."""

OPLOG = "key string, value string, seq long, op string"
MANIFEST = "id long, level int, min_key string, max_key string, max_seq long, size_bytes long, n_rows long, path string"
WAL = "offset long, checksum long, seq long, op string, key string, value string"
LOG_ENTRY = "struct<term: long, index: long, op: string, key: string, value: string>"
REPL_LOG = "term long, index long, op string, key string, value string"
REPL_MESSAGE = f"term long, leader_commit long, entries array<{LOG_ENTRY}>"
REQUEST = "verb string, key string, value string"
REPLY = "success boolean, message string, value string"
