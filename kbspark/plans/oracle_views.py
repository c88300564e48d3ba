"""DuckDB twins of the fixture views and text functions, as SQL fragments.

Only the base tables are registered on the oracle side, so each oracle query
puts the views it needs in as CTEs.  All views read whole tables.
"""

from __future__ import annotations


def norm(x: str) -> str:
    """F1 in DuckDB."""
    return f"trim(regexp_replace(lower({x}), '[^\\p{{L}}\\p{{N}}_]+', ' ', 'g'))"


def token_sort(x: str) -> str:
    """M3's processed, token-sorted string in DuckDB."""
    return ("array_to_string(list_sort(list_filter(string_split(trim(lower(regexp_replace(regexp_replace("
            f"{x}, '[\\x{{80}}-\\x{{FF}}]', '', 'g'), '[^\\p{{L}}\\p{{N}}_]', ' ', 'g'))), ' '), lambda t: t <> '')), ' ')")


FX = {
    "fx_assistants": """fx_assistants AS (SELECT DISTINCT CAST(substr(source, 4) AS BIGINT) + 1 AS id, source AS name,
        concat('asst_', source) AS assistant_key FROM documents)""",
    "fx_catalog": """fx_catalog AS (SELECT doc_id AS image_row, source AS filepath,
        concat(source, '_image_rId', CAST(doc_id % 40 AS VARCHAR), '.png') AS filename,
        CASE doc_id % 4 WHEN 0 THEN concat('Figura ', CAST(doc_id AS VARCHAR), ': ', string_split(text, chr(10))[1])
          WHEN 1 THEN concat('Picture ', CAST(doc_id AS VARCHAR)) WHEN 2 THEN string_split(text, chr(10))[1] ELSE NULL END AS title,
        CASE WHEN doc_id % 2 = 0 THEN 'png' ELSE 'jpg' END AS ext,
        CASE WHEN doc_id % 2 = 0 THEN 'image/png' ELSE 'image/jpeg' END AS content_type,
        CASE WHEN doc_id % 5 = 0 THEN NULL ELSE text END AS description,
        CAST(substr(source, 4) AS BIGINT) + 1 AS assistant_id FROM documents)""",
    "fx_questions": """fx_questions AS (SELECT item_id AS question_id, text AS question,
        concat('src', CAST(item_id % 25 AS VARCHAR)) AS assistant_name FROM benchmark)""",
    "fx_messages": """fx_messages AS (SELECT conv_id AS thread_id, turn AS seq, role,
        CASE WHEN role = 'assistant' THEN concat(text, ' smt_figura', CAST(turn AS VARCHAR), '.png (x_image_a.jpg) smt_figura',
          CAST(turn AS VARCHAR), '.png') ELSE text END AS text,
        TIMESTAMP '2024-01-01 00:00:00' + to_hours(CAST(conv_id AS BIGINT)) + to_minutes(CAST(turn AS BIGINT)) AS created_at
        FROM conversations)""",
    "fx_runs_status": """fx_runs_status AS (SELECT DISTINCT conv_id AS thread_id,
        CASE WHEN conv_id % 4 = 0 THEN 'failed' WHEN conv_id % 4 = 1 THEN 'requires_action' ELSE 'completed' END AS status
        FROM conversations)""",
    "fx_tool_calls": """fx_tc0 AS (SELECT item_id AS i, printf('"src%d_image_rId%d.png"', item_id % 25, item_id % 25) AS one,
          printf('"src%d_image_rId%d.png"', item_id % 20, item_id % 20) AS two FROM benchmark),
        fx_tool_calls AS (SELECT i AS call_id, CASE WHEN i % 7 = 3 THEN 'code_interpreter' ELSE 'function' END AS call_type,
          CASE WHEN i % 11 = 5 THEN 'other' WHEN i % 2 = 0 THEN 'get_image' ELSE 'get_images' END AS function_name,
          CASE WHEN i % 2 = 0 THEN concat('{"filename":', one, '}') ELSE concat('{"query":[', one, ',', two, ']}') END AS arguments
          FROM fx_tc0)""",
    "fx_checklist": """fx_checklist AS (SELECT l.doc_id AS question_id, d.source AS assistant_name, l.quality AS correct
        FROM labels l JOIN documents d ON l.doc_id = d.doc_id)""",
    "fx_vec_catalog": """fx_vec_catalog AS (SELECT a.vec_id AS image_row, a.embedding AS title_vec, b.embedding AS desc_vec
        FROM embeddings a LEFT JOIN embeddings b ON b.vec_id = a.vec_id + 1)""",
    "fx_vec_questions": """fx_vec_questions AS (SELECT a.vec_id AS question_id,
        list_transform(list_zip(a.embedding, b.embedding), lambda p: p[1] + p[2]) AS q_vec
        FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1)""",
    "fx_doc_runs": """fx_ps AS (SELECT doc_id, source, unnest(range(len(string_split(text, chr(10))))) AS p,
          unnest(string_split(text, chr(10))) AS para FROM documents),
        fx_rs AS (SELECT *, unnest(range(len(string_split(para, '. ')))) AS r, unnest(string_split(para, '. ')) AS t FROM fx_ps),
        fx_doc_runs AS (SELECT doc_id, source, CAST(p AS INTEGER) AS para_idx, CAST(r AS INTEGER) AS run_idx,
          CASE WHEN (doc_id + p + r) % 7 = 0 THEN 'drawing' ELSE 'text' END AS kind, t AS text FROM fx_rs)""",
}


def f5(descr: str, name: str, ordinal: str) -> str:
    return f"coalesce(nullif({descr}, ''), nullif({name}, ''), printf('image_%04d', {ordinal}))"


def f2(alt: str, ext: str) -> str:
    """F2 on an already stripped and lower-cased alt text column."""
    return (f"CASE WHEN {alt} IS NULL THEN NULL "
            f"WHEN regexp_matches({alt}, '^figura\\s*\\d+') THEN concat('figura', printf('%02d', CAST(regexp_extract({alt}, '^figura\\s*(\\d+)', 1) AS HUGEINT)), '.', {ext}) "
            f"WHEN regexp_matches({alt}, '^picture\\s*\\d+') THEN concat('picture', CAST(CAST(regexp_extract({alt}, '^picture\\s*(\\d+)', 1) AS HUGEINT) AS VARCHAR), '.', {ext}) "
            f"ELSE strip_accents(regexp_replace({alt}, '\\s+', '', 'g')) END")


def strip_lower(x: str) -> str:
    return f"lower(regexp_replace({x}, '^\\s+|\\s+$', '', 'g'))"


FX_INGEST = {
    "fx_doc_images": """fx_di0 AS (SELECT doc_id, source, para_idx, run_idx, text,
          CAST(row_number() OVER (PARTITION BY doc_id ORDER BY para_idx, run_idx) AS INTEGER) AS img_idx
          FROM fx_doc_runs WHERE kind = 'drawing' AND (para_idx + run_idx) % 3 <> 2),
        fx_doc_images AS (SELECT doc_id, source, img_idx, para_idx, run_idx, text AS descr,
          concat('Imagem ', CAST(img_idx AS VARCHAR)) AS name,
          concat('rId', CAST(doc_id % 20 + 20 * ((para_idx + run_idx) % 3) AS VARCHAR)) AS embed_id,
          CASE WHEN (para_idx + run_idx) % 2 = 0 THEN 'png' ELSE '' END AS ext, 'image/png' AS content_type,
          encode(text) AS content FROM fx_di0)""",
}


def new_images_sql() -> str:
    alt = f5("descr", "name", "img_idx")
    return f"""fx_ni0 AS (SELECT *, {alt} AS alt, {strip_lower(alt)} AS alt_t, coalesce(nullif(ext, ''), 'png') AS ext2
          FROM fx_doc_images),
        fx_new_images AS (SELECT doc_id, img_idx, source AS filepath, {f2('alt_t', 'ext2')} AS filename, content_type,
          alt AS title, concat('asst_', source) AS assistant_key FROM fx_ni0),
        fx_captions AS (SELECT concat(filepath, '_', filename) AS filename,
          arg_min(concat('Legenda: ', title), doc_id * 1000000 + img_idx) AS description
          FROM fx_new_images WHERE img_idx % 2 = 1 GROUP BY 1),
        fx_kb_catalog AS (SELECT image_row, filepath, filename, content_type, title, description, assistant_id FROM fx_catalog
          UNION ALL
          SELECT (SELECT max(image_row) FROM fx_catalog) + row_number() OVER (ORDER BY n.doc_id, n.img_idx) AS image_row,
            n.filepath, concat(n.filepath, '_', n.filename) AS filename, n.content_type, n.title, c.description, a.id AS assistant_id
          FROM fx_new_images n LEFT JOIN fx_captions c ON c.filename = concat(n.filepath, '_', n.filename)
          LEFT JOIN fx_assistants a ON a.assistant_key = n.assistant_key),
        fx_kb_catalog_v1 AS (SELECT image_row, filepath, regexp_replace(filename, '^[^_]*_', '') AS filename, content_type,
          title, description, assistant_id FROM fx_kb_catalog)"""


def with_views(*names: str, extra: str = "", recursive: bool = False) -> str:
    """``WITH`` clause holding the named fixture views, then ``extra`` CTEs."""
    parts = []
    for n in names:
        if n == "fx_kb_catalog_v1":
            continue  # defined together with fx_kb_catalog
        if n == "fx_kb_catalog":
            parts.append(new_images_sql())
        else:
            parts.append(FX[n] if n in FX else FX_INGEST[n])
    if extra:
        parts.append(extra)
    return ("WITH RECURSIVE " if recursive else "WITH ") + ",\n".join(parts)
