"""Registered queries of the training-data operators, with production
parameters over whole tables, and their DuckDB twins where SQL can say them."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kbspark.llm import (bpe, chat, embedding_join, exact_dedup, html_extract, jaccard_join, license_scan, packing, periodic_runs, spelling, token_counts,
                         toxicity, warc)
from kbspark.llm.common import SPACE, table

QUERIES = {}
ORACLE = {}


def register(oracle: str | None = None):
    def deco(fn):
        QUERIES[fn.__name__] = fn
        if oracle is not None:
            ORACLE[fn.__name__] = oracle
        return fn
    return deco


# 1: toxicity --------------------------------------------------------------------------


@register()
def op1_toxicity(spark, sf_dir):
    out = toxicity.score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return out.select(F.col("id").alias("doc_id"), toxicity.held_out(F.col("id")).alias("held_out"), "score",
                      (F.col("score") >= 0.5).cast("int").alias("predicted"))


# 2: chat formatting -------------------------------------------------------------------

BOUNDARY = "</s>[INST] ok [/INST]"
_ADDED = r"""LENGTH(t) - LENGTH(REPLACE(t, '\', '')) + """ + " + ".join(
    f"(LENGTH(t) - LENGTH(REPLACE(t, '{c}', ''))) // {len(c)}" for c in ("<|", "<s>", "</s>", "<SYS>>", "</SYS>>", "[INST]", "[/INST]"))
OP2 = f"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '{BOUNDARY}' UNION ALL SELECT -1, 1, 'assistant', '{BOUNDARY}'),
sized AS (
  SELECT *, {len(chat.START + chat.SEP + chat.END)}
    + (SELECT length(t) + {_ADDED} FROM (SELECT role AS t)) + (SELECT length(t) + {_ADDED} FROM (SELECT text AS t)) AS chars FROM turns)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  sum(chars)::BIGINT AS formatted_chars
FROM sized GROUP BY conv_id
"""


@register(OP2)
def op2_chat_formatting(spark, sf_dir):
    """Each conversation is a tree in which a turn replies to the one before."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    added = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"),
                                  F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(BOUNDARY).alias("text"))
    order = Window.partitionBy("tree").orderBy("turn", "role", "text")
    messages = (rows.unionByName(added).withColumn("tree", F.coalesce(F.col("conv_id").cast("string"), F.lit("none")))
                .withColumn("node", F.row_number().over(order).cast("long"))
                .select("tree", "node", F.when(F.col("node") > 1, F.col("node") - 1).alias("parent"), "role", "text", F.lit(0.0).alias("score")))
    out = chat.format_trees(messages).where("rank = 1").select("tree", "formatted", "loss_spans", chat.parse_turns(F.col("formatted")).alias("turns"),
                                                               chat.masked_text(F.col("formatted"), F.col("loss_spans")).alias("loss"))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return out.select(F.when(F.col("tree") != "none", F.col("tree").cast("long")).alias("conv_id"), F.size("turns").cast("long").alias("n_turns"),
                      F.sha2(said, 256).alias("turns_sha256"), F.length("loss").cast("long").alias("loss_chars"),
                      F.sha2("loss", 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"))


# 3: licence scan ----------------------------------------------------------------------

_SETS = {name: license_scan.bigrams(license_scan.words_of(text)) for name, text in license_scan.TEMPLATES.items()}
OP3 = f"""
WITH t(licence, grams) AS (VALUES {", ".join(f"('{n}', [{', '.join(repr(' '.join(g)) for g in sorted(s))}])" for n, s in _SETS.items())}),
d AS (SELECT row_number() OVER () AS r, doc_id, lower(regexp_replace(coalesce(text, ''), '[^A-Za-z0-9\n]+', ' ', 'g')) AS plain FROM documents),
para AS (SELECT r, unnest(regexp_split_to_array(plain, '\n( *\n)+')) AS part FROM d),
parts AS (
  SELECT r, unnest(string_split(plain, chr(10))) AS part FROM d
  UNION ALL SELECT r, part FROM para WHERE contains(trim(part, chr(10) || ' '), chr(10))
  UNION ALL SELECT r, plain FROM d WHERE regexp_matches(plain, '\n( *\n)+')),
w AS (SELECT r, list_filter(regexp_split_to_array(part, '[ \n]+'), lambda x: x <> '') AS w FROM parts),
g AS (SELECT r, list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS grams FROM w WHERE len(w) > 1),
hit AS (SELECT r, row_number() OVER () AS g, licence, len(list_intersect(g.grams, t.grams)) AS s, len(g.grams) + len(t.grams) AS n
        FROM g JOIN t ON len(g.grams) * 180 >= len(t.grams) * 120 AND len(t.grams) * 180 >= len(g.grams) * 120 AND list_has_any(g.grams, t.grams)),
good AS (SELECT r, licence, s, n, 2.0 * s / n AS dice FROM hit WHERE 200 * s >= 80 * n),
per AS (SELECT r, arg_min(licence, (-dice::DOUBLE, licence)) AS licence, max(2::DOUBLE * s / n) AS dice FROM good GROUP BY r),
places AS (SELECT g.r, count(*) AS places FROM g WHERE EXISTS (SELECT 1 FROM t WHERE list_has_any(g.grams, t.grams)
   AND 200 * len(list_intersect(g.grams, t.grams)) >= 80 * (len(g.grams) + len(t.grams))) GROUP BY g.r)
SELECT doc_id, licence, coalesce(dice, 0) AS dice, coalesce(places, 0) AS places FROM d LEFT JOIN per USING (r) LEFT JOIN places USING (r)
"""


@register(OP3)
def op3_licence_scan(spark, sf_dir):
    return license_scan.scan_licences(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


# 4: n-gram Jaccard join ---------------------------------------------------------------


@register()
def op4_jaccard_join(spark, sf_dir):
    return jaccard_join.near_duplicates(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


# 5: HTML extraction -------------------------------------------------------------------


@register()
def op5_html_extraction(spark, sf_dir):
    out = html_extract.extract_pages(table(spark, sf_dir, "pages"))
    return out.select(F.col("id").alias("page_id"), "url", "text", F.length("text").cast("long").alias("n_chars"))


# 6: byte-level BPE --------------------------------------------------------------------


@register()
def op6_byte_bpe(spark, sf_dir):
    out = bpe.encode_texts(table(spark, sf_dir, "documents"), keep=("ids_sha256", "decoded_sha256"))
    return out.withColumnRenamed("id", "doc_id")


# 7: best-fit packing ------------------------------------------------------------------


@register()
def op7_best_fit_packing(spark, sf_dir):
    out = packing.pack_documents(table(spark, sf_dir, "documents"))
    return out.select(F.col("id").alias("doc_id"), "piece", "start", "length", F.col("crc").alias("ids_crc32"), "sequence_id", "offset")


# 8: embedding near-duplicates ---------------------------------------------------------

OP8 = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, CASE WHEN len(embedding) > 0 AND list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x)))
      AND list_bool_or(list_transform(embedding, lambda x: x <> 0)) THEN embedding::DOUBLE[] END AS e FROM embeddings),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
      WHERE list_cosine_similarity(a.e, b.e) >= 0.93),
reach(a, b) AS (SELECT vec_id, vec_id FROM v UNION SELECT reach.a, l.b FROM reach JOIN l ON reach.b = l.a)
SELECT v.vec_id, (SELECT count(*) FROM l WHERE l.a = v.vec_id) AS n_links, min(reach.b) AS component_id, min(reach.b) = v.vec_id AS kept
FROM v JOIN reach ON reach.a = v.vec_id GROUP BY v.vec_id
"""


@register(OP8)
def op8_embedding_near_dedup(spark, sf_dir):
    return embedding_join.link_embeddings(table(spark, sf_dir, "embeddings")).withColumnRenamed("id", "vec_id")


# 9: exact deduplication ---------------------------------------------------------------

OP9 = r"""
WITH d AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = min(doc_id) OVER w AS kept, text_sha256
FROM d WINDOW w AS (PARTITION BY text_sha256)
"""


@register(OP9)
def op9_exact_dedup(spark, sf_dir):
    out = exact_dedup.tree_dedup(table(spark, sf_dir, "documents"))
    return out.select(F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", F.lower(F.hex("sha")).alias("text_sha256"))


# 10: WARC -----------------------------------------------------------------------------

_HEX32 = " || ".join(
    f"""(SELECT substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (v >> 15) + 1, 1) || substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((v >> 10) & 31) + 1, 1)
 || substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((v >> 5) & 31) + 1, 1) || substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (v & 31) + 1, 1)
 FROM (SELECT CAST('0x' || substr(h, {5 * i + 1}, 5) AS BIGINT) AS v))""" for i in range(8))
OP10 = f"""
WITH p AS (SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS h,
                  max(page_id) OVER (PARTITION BY coalesce(html, '')) AS last FROM pages)
SELECT page_id, payload_bytes, {_HEX32} AS payload_digest,
  CASE WHEN last = page_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN last <> page_id THEN last END AS refers_to
FROM p
"""


@register(OP10)
def op10_warc(spark, sf_dir):
    got = warc.archive_round_trip(table(spark, sf_dir, "pages"))
    said = F.regexp_extract("metadata", r"X-Payload-Bytes: (\d+)", 1).cast("long")
    return got.select(F.regexp_extract("record_id", r"^(-?\d+):", 1).try_cast("long").alias("page_id"),
                      F.when(F.col("kind") == "revisit", said).otherwise(F.col("payload_bytes")).alias("payload_bytes"),
                      F.when(F.col("kind") == "revisit", F.col("digest")).otherwise(F.col("payload_digest")).alias("payload_digest"),
                      F.col("kind").alias("record_type"), F.col("refers_to").cast("long").alias("refers_to"))


# 11: token counts ---------------------------------------------------------------------


@register()
def op11_token_counts(spark, sf_dir):
    return token_counts.count_tokens(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


# 12: spelling variants ----------------------------------------------------------------


def _nibble(value: int) -> int:
    """Entry of the crc32 table of half bytes."""
    for _ in range(4):
        value = value >> 1 ^ (0xEDB88320 if value & 1 else 0)
    return value


_HALF_BYTES = f"[{', '.join(str(_nibble(i)) for i in range(16))}]"
OP12 = rf"""
WITH RECURSIVE r AS (
  SELECT doc_id, unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-z\x{{C0}}-\x{{FF}}]+')) AS raw FROM documents),
lowered AS (SELECT doc_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run, count(*) AS n FROM r GROUP BY ALL),
coded AS (SELECT *, hex(encode(coalesce(doc_id::VARCHAR, '') || ':' || run)) AS x FROM lowered),
hashed AS (SELECT run, n, xor(4294967295, list_reduce(
    list_prepend(4294967295::BIGINT, list_transform(range(len(x)), lambda i: instr('0123456789ABCDEF', substr(x, (i + 1 - 2 * (i % 2) + 1)::BIGINT, 1))::BIGINT - 1)),
    lambda crc, d: xor(crc >> 4, ({_HALF_BYTES})[(xor(crc, d) & 15) + 1]))) AS h FROM coded),
damaged AS (SELECT CASE WHEN h % 97 = 0 THEN left(run, (h % length(run))::BIGINT) || substr(run, (h % length(run) + 2)::BIGINT) ELSE run END AS word, n FROM hashed),
words AS (SELECT word, sum(n)::BIGINT AS n FROM damaged WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3),
cut AS (SELECT word, n, i, left(word, i - 1) || substr(word, i + 1) AS d FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words)),
pairs AS (
  SELECT a.word, b.word AS near, b.n FROM cut a JOIN words b ON a.d = b.word
  UNION SELECT b.word, a.word, a.n FROM cut a JOIN words b ON a.d = b.word
  UNION SELECT a.word, b.word, b.n FROM cut a JOIN cut b ON a.d = b.d AND a.i = b.i AND a.word <> b.word),
best AS (SELECT word, count(*) AS n_near, min((-n, near)) AS b FROM pairs GROUP BY word),
forms AS (SELECT words.word, words.n, coalesce(n_near, 0) AS n_near, CASE WHEN -b[1] >= 2 * words.n THEN b[2] END AS form,
  CASE WHEN -b[1] >= 2 * words.n THEN -b[1] END AS form_n FROM words LEFT JOIN best USING (word)),
walk(word, root) AS (SELECT word, word FROM forms UNION ALL SELECT walk.word, forms.form FROM walk JOIN forms ON walk.root = forms.word WHERE forms.form IS NOT NULL)
SELECT f.word, f.form, walk.root, f.n, f.n_near, f.form_n
FROM forms f JOIN walk ON walk.word = f.word JOIN forms last ON last.word = walk.root AND last.form IS NULL
"""


def damaged_words(docs):
    """One row per letter run of each text; a run whose crc32 with its
    document's id (null: empty) is divisible by 97 loses one code point."""
    runs = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("doc"), F.explode(spelling.letter_runs(F.col("text"))).alias("run"))
    hashed = runs.select("run", F.crc32(F.concat("doc", F.lit(":"), "run")).alias("h"))
    return hashed.select(F.expr("if(h % 97 = 0, concat(left(run, int(h % length(run))), substring(run, int(h % length(run)) + 2)), run)").alias("word"))


@register(OP12)
def op12_spelling_variants(spark, sf_dir):
    return spelling.group_variants(spelling.count_words(damaged_words(table(spark, sf_dir, "documents"))))


# 13: periodic runs --------------------------------------------------------------------


def with_repeats(docs):
    """``(doc_id, text)`` in which documents picked by the crc32 of their id
    repeat a stretch of words to the end; null ids are not picked."""
    h = F.crc32(F.col("doc_id").cast("string"))
    words = F.filter(F.split("text", SPACE), lambda w: w != "")
    picked = docs.select("doc_id", "text", F.floor(h / 10).cast("long").alias("g"), F.when(h % 10 == 0, words).alias("words"))
    sized = picked.withColumn("words", F.expr("if(size(words) > 0, words, null)")).withColumn("n", F.expr("if(words is null, null, size(words))"))
    cut = sized.withColumn("a", F.expr("g % n")).withColumn("p", F.expr("1 + (n - a) div (3 + g % 8)"))
    tail = "slice(flatten(array_repeat(slice(words, cast(a + 1 as int), cast(p as int)), cast((n - a + p - 1) div p as int))), 1, cast(n - a as int))"
    said = F.expr(f"array_join(concat(slice(words, 1, cast(a as int)), {tail}), ' ')")
    return cut.select("doc_id", F.coalesce(said, F.col("text")).alias("text"))


@register()
def op13_periodic_runs(spark, sf_dir):
    out = periodic_runs.find_runs(with_repeats(table(spark, sf_dir, "documents").select("doc_id", "text")))
    best = F.expr("""aggregate(runs, cast(null as struct<start:bigint,length:bigint,period:bigint>),
        (b, r) -> if(b is null or r.length * b.period > b.length * r.period, r, b))""")
    lines = F.expr("array_join(transform(runs, r -> concat(r.start, ',', r.length, ',', r.period, '\n')), '')")
    out = out.select("id", "runs", "collapsed", best.alias("best"), lines.alias("lines"))
    return out.select(F.col("id").alias("doc_id"), F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
                      F.expr("1000 * best.length div best.period").alias("exponent_milli"), F.sha2("lines", 256).alias("runs_sha256"),
                      F.sha2("collapsed", 256).alias("collapsed_sha256"))
