"""DuckDB SQL for those queries of this subpackage that SQL can express on whole tables."""

WS = "[ \\t\\n\\x0B\\f\\r]+"

SQL = {
    "op8_exact_dedup": f"""
        WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '{WS}', ' ', 'g') AS norm FROM documents)
        SELECT doc_id, min(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = min(doc_id) OVER g AS kept, sha256(norm) AS text_sha256
        FROM t WINDOW g AS (PARTITION BY norm)
    """,
}
