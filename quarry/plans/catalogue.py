"""Every query of the library by name, with the SQL that gives the same rows where SQL can.

Documents are a corpus whose collection is the language and whose path is made of source and id; conversations are
messages with conv_id * 1000 + turn as their time; the second snapshot of the incremental queries changes every seventh
document and drops every eleventh.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry import tables
from quarry.functions import columns as C
from quarry.operators import clusters, index, messages, passages, providers, retrieval
from quarry.streaming import events as streams

#: Passages of one document at most: the step from one document's keys to the next one's.
PASSAGES = 1 << 24

QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _fold(x: str) -> str:
    return f"""lower(replace(replace(replace(replace(translate({x}, '{C.ACCENTED}', '{C.PLAIN}'), 'œ', 'oe'), 'Œ', 'OE'), 'æ', 'ae'), 'Æ', 'AE'))"""


_FOLD = _fold("text")


def read(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _turns(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "conversations")


def _corpus(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "documents").select(
        F.col("doc_id").alias("key"), "lang", F.concat("source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".md")).alias("source"), "text"
    )


def _passages(spark: SparkSession, d: str) -> DataFrame:
    """The corpus as passages: a key of document and ordinal, the document's source with the location."""
    cut = passages.split(_corpus(spark, d), keep=("lang", "source"))
    return cut.select(
        (F.col("key") * PASSAGES + F.col("ordinal")).alias("key"), "lang", F.concat_ws(" ", "source", "location").alias("source"), F.col("passage").alias("text")
    )


def _questions(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "benchmark").select(F.col("item_id").alias("question_id"), "text")


# --- tokens, formats, scalar functions ---------------------------------------------------------------------------


@query("SELECT doc_id, CAST(ceil(length(text) / 4.0) AS BIGINT) AS tokens FROM documents")
def q_token_estimate(spark, d):
    return read(spark, d, "documents").select("doc_id", C.tokens(F.col("text")).alias("tokens"))


@query("""SELECT conv_id, count(*) AS n_messages, CAST(sum(CAST(ceil(length(text) / 4.0) AS BIGINT) + 4) AS BIGINT) AS prompt_tokens
FROM conversations GROUP BY conv_id""")
def q_prompt_tokens(spark, d):
    return messages.prompt_tokens(_turns(spark, d))


@query("""SELECT conv_id, turn, role, tokens, CAST(place AS INTEGER) AS place FROM (SELECT conv_id, turn, role,
  CAST(ceil(length(text) / 4.0) AS BIGINT) + 4 AS tokens,
  row_number() OVER (PARTITION BY conv_id ORDER BY ceil(length(text) / 4.0) DESC, turn) AS place FROM conversations) WHERE place <= 5""")
def q_longest_messages(spark, d):
    return messages.longest(_turns(spark, d))


@query("""WITH s AS (SELECT conv_id,
  CAST(coalesce(sum(CAST(ceil(length(text) / 4.0) AS BIGINT) + 4) FILTER (role = 'system'), 0) AS BIGINT) AS system_tokens,
  CAST(coalesce(sum(CAST(ceil(length(text) / 4.0) AS BIGINT) + 4) FILTER (role <> 'system'), 0) AS BIGINT) AS history_tokens
  FROM conversations WHERE trim(text) <> '' GROUP BY conv_id)
SELECT *, system_tokens + history_tokens AS total_tokens,
  CASE WHEN system_tokens + history_tokens = 0 THEN 0 ELSE system_tokens * 100 // (system_tokens + history_tokens) END AS system_percent,
  CASE WHEN system_tokens + history_tokens = 0 THEN 0 ELSE history_tokens * 100 // (system_tokens + history_tokens) END AS history_percent FROM s""")
def q_context_breakdown(spark, d):
    return messages.context_breakdown(_turns(spark, d))


@query("""WITH p AS (SELECT conv_id, turn, role, CAST(ceil(length(text) / 4.0) AS BIGINT) AS output_tokens,
  CAST(coalesce(sum(CAST(ceil(length(text) / 4.0) AS BIGINT) + 4) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS input_tokens
  FROM conversations)
SELECT conv_id, count(*) AS requests, CAST(sum(input_tokens * 2000000 // 1000000 + output_tokens * 10000000 // 1000000) AS BIGINT) AS micros
FROM p WHERE role = 'assistant' GROUP BY conv_id""")
def q_cost(spark, d):
    return messages.costs(_turns(spark, d), 2_000_000, 10_000_000)


@query("""SELECT doc_id,
  replace(format('{:,}', n_chars * 977), ',', chr(8239)) AS grouped,
  CASE WHEN n < 1000 THEN CAST(n AS VARCHAR) WHEN n < 10000 THEN (n + 50) // 100 // 10 || ',' || (n + 50) // 100 % 10 || 'k'
    WHEN n < 1000000 THEN (n + 500) // 1000 || 'k' ELSE (n + 50000) // 100000 // 10 || ',' || (n + 50000) // 100000 % 10 || 'M' END AS short,
  CASE WHEN s < 60 THEN 'à l''instant' WHEN s < 3600 THEN 'il y a ' || s // 60 || ' min' WHEN s < 86400 THEN 'il y a ' || s // 3600 || ' h'
    WHEN s < 172800 THEN 'hier' WHEN s < 2592000 THEN 'il y a ' || s // 86400 || ' j' WHEN s < 31536000 THEN 'il y a ' || s // 2592000 || ' mois'
    ELSE 'il y a ' || s // 31536000 || ' an(s)' END AS age
FROM (SELECT doc_id, n_chars, n_chars * 977 AS n, n_chars * doc_id AS s FROM documents)""")
def q_formats(spark, d):
    n, s = F.col("n_chars") * 977, F.col("n_chars") * F.col("doc_id")
    return read(spark, d, "documents").select(
        "doc_id", C.format_count(n).alias("grouped"), C.format_short(n).alias("short"), C.ago(s).alias("age")
    )


@query("""SELECT doc_id, CASE WHEN strip = '' THEN 'conversation.md' ELSE strip || '.md' END AS slug FROM (
  SELECT doc_id, regexp_replace(substr(regexp_replace(regexp_replace(""" + _FOLD + """, '[^a-z0-9]+', '-', 'g'), '^-', ''), 1, 50), '-+$', '') AS strip FROM documents)""")
def q_slug(spark, d):
    return read(spark, d, "documents").select("doc_id", C.slug(F.col("text")).alias("slug"))


@query("""SELECT doc_id, CASE WHEN length(first) <= 60 THEN first ELSE substr(first, 1, 59) || '…' END AS title FROM (
  SELECT doc_id, coalesce(list_filter(list_transform(string_split(replace(text, chr(13) || chr(10), chr(10)), chr(10)), lambda x: trim(x)), lambda x: x <> '')[1], '') AS first
  FROM documents)""")
def q_title_from(spark, d):
    return read(spark, d, "documents").select("doc_id", C.title_from(F.col("text")).alias("title"))


@query("""SELECT doc_id, kind FROM (SELECT doc_id, source || '/' || replace(coalesce(regexp_extract(text, '[A-Za-z]+', 0), 'x'), '.', '') || '.' || e AS path,
  CASE WHEN e IN ('md', 'markdown') THEN 'markdown' WHEN e IN ('csv', 'log') THEN 'text' WHEN e IN ('rs', 'Py', 'YAML') THEN 'code' WHEN e IN ('pdf', 'docx', 'odt') THEN e END AS kind FROM (
  SELECT *, ['md', 'csv', 'rs', 'Py', 'pdf', 'bin', 'markdown', 'log', 'YAML', 'docx', 'odt', 'exe'][CAST(length(text) % 12 AS INTEGER) + 1] AS e FROM documents))""")
def q_file_kind(spark, d):
    ext = F.get(F.array(*map(F.lit, "md csv rs Py pdf bin markdown log YAML docx odt exe".split())), (F.length("text") % 12).cast("int"))
    # a name that is only an extension has no kind
    name = F.coalesce(F.nullif(F.regexp_extract("text", "[A-Za-z]+", 0), F.lit("")), F.lit("x"))
    path = F.concat(F.coalesce("source", F.lit("")), F.lit("/"), name, F.lit("."), ext)
    return read(spark, d, "documents").select("doc_id", C.file_kind(path).alias("kind"))


@query(r"""SELECT doc_id, regexp_matches(lower(source || '/' || f || '/' || w), '(^|/)(\.ssh|\.aws|\.env[^/]*|id_rsa[^/]*|[^/]*credentials[^/]*|[^/]*secret[^/]*|[^/]*\.(pem|key|p12|pfx|kdbx))(/|$)') AS secret
FROM (SELECT doc_id, source, ['.ssh', 'docs', 'my-Secrets', '.env.local', 'keyboard', 'src'][CAST(length(text) % 6 AS INTEGER) + 1] AS f, regexp_extract(text, '[A-Za-z]+', 0) || CASE WHEN length(text) % 5 = 0 THEN '.PEM' ELSE '.md' END AS w FROM documents)""")
def q_sensitive_path(spark, d):
    n = F.length("text")
    folder = F.get(F.array(*map(F.lit, [".ssh", "docs", "my-Secrets", ".env.local", "keyboard", "src"])), (n % 6).cast("int"))
    name = F.concat(F.regexp_extract("text", "[A-Za-z]+", 0), F.when(n % 5 == 0, ".PEM").otherwise(".md"))
    return read(spark, d, "documents").select("doc_id", C.is_secret(F.concat_ws("/", "source", folder, name)).alias("secret"))


@query("SELECT p_partkey, p_name FROM part WHERE contains(lower(p_name), 'a') AND contains(lower(p_name), 're')")
def q_all_words(spark, d):
    return read(spark, d, "part").filter(C.has_all_words(F.col("p_name"), F.lit("RE a"))).select("p_partkey", "p_name")


@query("""SELECT page_id, nullif(replace(replace(replace(replace(replace(replace(replace(
  trim(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&nbsp;', chr(160)),
  '&eacute;', 'é'), '&amp;', '&'), '') AS title FROM pages""")
def q_html_title(spark, d):
    return read(spark, d, "pages").select("page_id", C.html_title(F.col("html")).alias("title"))


@query()
def q_entities(spark, d):
    return read(spark, d, "pages").select("page_id", C.decode_entities(F.col("html")).alias("text"))


@query("SELECT doc_id, sha256(text) AS digest FROM documents")
def q_fingerprint(spark, d):
    return read(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("digest"))


@query("""SELECT conv_id, turn, array_to_string(list_filter([CASE WHEN length(text) % 2 = 0 THEN CAST(turn AS VARCHAR) END, CAST(length(text) AS VARCHAR), CAST(conv_id AS VARCHAR)], lambda x: x IS NOT NULL), ',') AS cited FROM conversations""")
def q_cited_numbers(spark, d):
    """Brackets in the messages themselves: one number (or a word), then two."""
    first = F.when(F.length("text") % 2 == 0, F.col("turn").cast("string")).otherwise(F.concat(F.col("turn").cast("string"), F.lit(", x")))
    text = F.concat("text", F.lit(" ["), first, F.lit("] "), "text", F.lit("[ "), F.length("text"), F.lit(" ;"), "conv_id", F.lit("]"))
    numbers = F.transform(C.cited_numbers(text), lambda n: n.cast("string"))
    return _turns(spark, d).select("conv_id", "turn", F.array_join(numbers, ",").alias("cited"))


@query("""SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, CASE WHEN event_id % 3 = 2 THEN event_type || ' ' || props ELSE event_type || event_id END AS message FROM events""")
def q_json(spark, d):
    own = F.concat("event_type", "event_id")
    nested = F.to_json(F.struct(F.struct(own.alias("message")).alias("error")))
    flat = F.to_json(F.struct(own.alias("error")))
    body = F.get(F.array(nested, flat, F.concat(F.lit(" "), "event_type", F.lit(" "), "props", F.lit(" "))), (F.col("event_id") % 3).cast("int"))
    return read(spark, d, "events").select(
        "event_id", F.get_json_object("props", "$.k").cast("long").alias("k"), C.error_message(body).alias("message")
    )


# --- conversations -----------------------------------------------------------------------------------------------


@query("""WITH u AS (SELECT conv_id, turn, text, lag(text) OVER w AS previous, lead(turn) OVER w AS rest FROM conversations
  WHERE role = 'user' AND trim(text) <> '' WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
SELECT conv_id, CASE WHEN len(regexp_split_to_array(trim(text), '\\s+')) < 6 AND previous IS NOT NULL
  THEN trim(previous) || chr(10) || trim(text) ELSE trim(text) END AS search_text FROM u WHERE rest IS NULL""")
def q_search_text(spark, d):
    return messages.search_texts(_turns(spark, d))


_TITLE = """CASE WHEN length(f) <= 60 THEN f ELSE substr(f, 1, 59) || '…' END"""
_OVERVIEW = f"""SELECT conv_id, {_TITLE} AS title, created_at, updated_at, n_messages FROM (SELECT conv_id,
  coalesce(list_filter(list_transform(string_split(coalesce(arg_min(text, turn) FILTER (role = 'user' AND trim(text) <> ''), ''), chr(10)), lambda x: trim(x)), lambda x: x <> '')[1], '') AS f,
  min(conv_id * 1000 + turn) AS created_at, max(conv_id * 1000 + turn) AS updated_at, count(*) AS n_messages FROM conversations GROUP BY conv_id)"""


@query(_OVERVIEW)
def q_list(spark, d):
    return messages.overview(_turns(spark, d))


@query(f"""WITH o AS ({_OVERVIEW}), t AS (SELECT conv_id, list_filter(string_split_regex(lower(text), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '') AS w FROM conversations),
hit AS (SELECT DISTINCT conv_id FROM t WHERE len(list_filter(w, lambda x: starts_with(x, 'the'))) > 0 AND len(list_filter(w, lambda x: starts_with(x, 'an'))) > 0)
SELECT o.conv_id, title, updated_at, hit.conv_id IS NOT NULL AS in_messages FROM o LEFT JOIN hit ON o.conv_id = hit.conv_id
WHERE hit.conv_id IS NOT NULL OR contains(lower(title), 'the an') ORDER BY updated_at DESC, o.conv_id DESC LIMIT 200""")
def q_message_search(spark, d):
    turns = _turns(spark, d)
    return messages.find_conversations(turns, messages.overview(turns), "the an").drop("excerpt")


@query("""WITH t AS (SELECT conv_id, turn, text, list_filter(string_split_regex(lower(text), '[^\\p{L}\\p{N}]+'), lambda x: x <> '') AS w FROM conversations),
m AS (SELECT conv_id, arg_min(text, turn) AS text FROM t WHERE len(list_filter(w, lambda x: starts_with(x, 'the'))) > 0 AND len(list_filter(w, lambda x: starts_with(x, 'an'))) > 0 GROUP BY conv_id),
s AS (SELECT conv_id, list_filter(string_split_regex(text, '\\s+'), lambda x: x <> '') AS w FROM m),
k AS (SELECT conv_id, w, list_transform(w, lambda x: CASE WHEN regexp_matches(lower(x), '^[^\\p{L}\\p{N}]*the') THEN 1 ELSE 0 END + CASE WHEN regexp_matches(lower(x), '^[^\\p{L}\\p{N}]*an') THEN 2 ELSE 0 END) AS m FROM s),
i AS (SELECT conv_id, w, m, unnest(range(1, len(w) + 1)) AS i FROM k),
v AS (SELECT conv_id, w, i, m[i : i + 9] AS m FROM i WHERE m[i] > 0),
c AS (SELECT conv_id, w, i, bit_count(CAST(list_reduce(m, lambda a, b: a | b) AS INTEGER)) AS covered,
  CASE WHEN list_reduce(m, lambda a, b: a | b) = m[1] THEN 1 ELSE list_position(list_transform(m, lambda x: x | m[1] = 3), true) END AS span FROM v),
p AS (SELECT conv_id, w, greatest(1, least(i, len(w) - 9)) AS first FROM c QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY covered DESC, span, i) = 1)
SELECT conv_id, CASE WHEN first > 1 THEN '…' ELSE '' END || array_to_string(w[first : first + 9], ' ') || CASE WHEN first + 9 < len(w) THEN '…' ELSE '' END AS excerpt FROM p""")
def q_search_excerpt(spark, d):
    turns = _turns(spark, d)
    return messages.find_conversations(turns, messages.overview(turns), "the an", most=None).filter("excerpt IS NOT NULL").select("conv_id", "excerpt")


@query(_OVERVIEW.replace("SELECT conv_id,", "SELECT conv_id, false AS in_messages,", 1).replace("created_at, updated_at, n_messages FROM", "updated_at FROM", 1))
def q_blank_search(spark, d):
    turns = _turns(spark, d)
    return messages.find_conversations(turns, messages.overview(turns), "  ").drop("excerpt")


@query("""WITH l AS (SELECT conv_id * 1000 + turn AS time, text FROM conversations WHERE role = 'user' AND trim(text) <> '' ORDER BY time DESC LIMIT 500)
SELECT time, text FROM (SELECT time, text, lag(text) OVER (ORDER BY time) AS b FROM l) WHERE text IS DISTINCT FROM b""")
def q_input_history(spark, d):
    return messages.input_history(_turns(spark, d))




@query(f"""SELECT * FROM (SELECT conv_id, coalesce(min(turn) FILTER (contains(f, 'the') AND contains(f, 'ent')), min(turn) FILTER (contains(f, 'the') OR contains(f, 'ent'))) AS turn
FROM (SELECT *, {_FOLD} AS f FROM conversations) GROUP BY conv_id) WHERE turn IS NOT NULL""")
def q_preview_anchor(spark, d):
    return messages.preview_anchor(_turns(spark, d), ["the", "ent"])


@query(f"""WITH p AS (SELECT conv_id, turn, string_split({_FOLD}, 'en.') AS parts FROM conversations),
e AS (SELECT conv_id, turn, parts, unnest(range(0, len(parts) - 1)) AS k FROM p)
SELECT conv_id, turn, CAST(k AS INTEGER) AS k, CAST(length(array_to_string(parts[1 : k + 1], '')) + 3 * k AS BIGINT) AS start,
  CAST(length(array_to_string(parts[1 : k + 1], '')) + 3 * k + 3 AS BIGINT) AS "end" FROM e""")
def q_find(spark, d):
    """No text of the table folds one character to two, so folded places are its own; tests have the others."""
    return messages.occurrences(_turns(spark, d), "Én.")


@query("""SELECT conv_id, string_agg(CASE role WHEN 'user' THEN '## Vous' WHEN 'assistant' THEN '## Assistant' ELSE '## Système' END
  || chr(10) || chr(10) || rtrim(text) || chr(10), chr(10) ORDER BY turn) AS body FROM conversations WHERE trim(text) <> '' GROUP BY conv_id""")
def q_export_markdown(spark, d):
    return messages.export_markdown(_turns(spark, d))


@query("""SELECT conv_id, string_agg('<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10), '' ORDER BY turn) || '<|im_start|>assistant' || chr(10) AS body
FROM conversations WHERE trim(text) <> '' GROUP BY conv_id""")
def q_chatml(spark, d):
    return messages.chatml(_turns(spark, d))


@query("""WITH c AS (SELECT conv_id, turn AS position, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n, 'doc' || turn AS source, text FROM conversations WHERE turn < 3),
s AS (SELECT conv_id, string_agg('[' || n || '] ' || source || chr(10) || text, chr(10) || chr(10) ORDER BY n) AS sources FROM c GROUP BY conv_id)
SELECT x.conv_id, CAST(-1 AS BIGINT) AS position, 'system' AS role, concat_ws(chr(10) || chr(10), 'Answer.', sources) AS content FROM (SELECT DISTINCT conv_id FROM conversations) x LEFT JOIN s ON x.conv_id = s.conv_id
UNION ALL SELECT conv_id, turn, role, text FROM conversations WHERE trim(text) <> ''""")
def q_prompt(spark, d):
    turns = _turns(spark, d)
    chunks = turns.filter("turn < 3").select(
        "conv_id", F.col("turn").alias("position"), F.concat(F.lit("doc"), F.col("turn").cast("string")).alias("source"),
        F.lit("").alias("location"), "text",
    )
    return messages.build_prompt(turns, chunks, "Answer.")


@query("""SELECT conv_id, turn, question FROM (SELECT conv_id, turn, role, coalesce(
  min(CASE WHEN role = 'user' THEN turn END) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING),
  max(CASE WHEN role = 'user' THEN turn END) OVER (PARTITION BY conv_id)) AS question FROM conversations) WHERE role = 'assistant'""")
def q_images(spark, d):
    role = F.when(F.col("role") == "assistant", "attachment").otherwise(F.col("role"))
    return messages.images_to_questions(_turns(spark, d).withColumn("role", role).withColumn("image", F.lit("png")))


@query("""SELECT conv_id, after_seq, count(*) + 1 AS total, (SELECT min(x) FROM range(1, 50) t(x) WHERE x NOT IN (SELECT unnest(u))) AS shown
FROM (SELECT conv_id, CASE WHEN turn % 4 = 0 THEN NULL ELSE turn % 4 END AS after_seq, CASE WHEN turn // 4 >= 1 THEN turn // 4 + 1 ELSE 1 END AS number,
  list(CASE WHEN turn // 4 >= 1 THEN turn // 4 + 1 ELSE 1 END) OVER (PARTITION BY conv_id, turn % 4) AS u FROM conversations) GROUP BY conv_id, after_seq, u""")
def q_versions(spark, d):
    group, number = F.col("turn") % 4, F.expr("turn div 4")
    tails = _turns(spark, d).select(
        "conv_id", F.when(group != 0, group).alias("after_seq"), F.when(number >= 1, number + 1).otherwise(F.lit(1)).alias("number")
    )
    return messages.versions(tails)


@query("""SELECT conv_id, arg_min(role, turn) AS role, arg_max(text, turn) AS text FROM conversations GROUP BY conv_id""")
def q_conversation_merge(spark, d):
    return messages.merge_log(_turns(spark, d), ["conv_id"], ["role"], ["text"], "turn")


@query("SELECT conv_id, turn, role, text FROM conversations WHERE NOT (conv_id % 3 = 0 AND turn >= 4)")
def q_truncate(spark, d):
    turns = _turns(spark, d)
    cuts = turns.filter("conv_id % 3 = 0").select("conv_id").distinct().withColumn("from_turn", F.lit(4))
    return messages.truncate(turns, cuts)[0]


@query("""WITH m AS (SELECT conv_id, max(turn) FILTER (role = 'user') AS last, min(turn) FILTER (role = 'assistant') AS first FROM conversations GROUP BY conv_id)
SELECT c.conv_id, c.turn, CASE WHEN c.turn > m.last THEN 'after' ELSE 'before' END AS side FROM conversations c JOIN m ON c.conv_id = m.conv_id WHERE c.turn > m.last
UNION ALL SELECT c.conv_id, c.turn, 'before' FROM conversations c JOIN m ON c.conv_id = m.conv_id WHERE c.turn < m.first""")
def q_around_message(spark, d):
    """What follows the last question of a conversation, and what comes before its first answer."""
    turns = _turns(spark, d)
    late = messages.after(turns, turns.filter("role = 'user'").select("conv_id", "turn")).withColumn("side", F.lit("after"))
    early = messages.before(turns, turns.filter("role = 'assistant'").select("conv_id", "turn")).withColumn("side", F.lit("before"))
    return late.unionByName(early).select("conv_id", "turn", "side")


@query("""WITH l AS (SELECT conv_id, list_distinct(list(role ORDER BY turn)) AS n FROM conversations GROUP BY conv_id)
SELECT conv_id, nullif(array_to_string(list_sort(list_filter(n, lambda x: x <> 'user')), ','), '') AS collections FROM l""")
def q_delete_collection(spark, d):
    """The roles of each conversation stand for the collections that it searches."""
    lists = _turns(spark, d).groupBy("conv_id").agg(F.array_join(F.array_sort(F.collect_list("role")), " , ").alias("collections"))
    return messages.forget_collection(lists, "user")


# --- index maintenance -------------------------------------------------------------------------------------------


def _snapshots(spark, d):
    docs = read(spark, d, "documents").select(
        F.concat("source", F.lit("/"), F.col("doc_id").cast("string")).alias("path"), "doc_id", F.col("n_chars").alias("size"), F.md5("text").alias("hash")
    )
    known = docs.filter("doc_id % 13 <> 5").select(
        "path", "size", F.lit(0).cast("long").alias("mtime"), "hash", F.when(F.col("doc_id") % 17 == 3, "no text").alias("skipped")
    )
    changed = F.col("doc_id") % 7 == 0
    scan = docs.filter("doc_id % 11 <> 2").select(
        "path", "size", F.when(F.col("doc_id") % 3 == 0, 1).otherwise(0).cast("long").alias("mtime"),
        F.when(changed, F.concat("hash", F.lit("x"))).otherwise(F.col("hash")).alias("hash"),
    )
    return scan, known


_PLAN = """SELECT source || '/' || doc_id AS path, CASE WHEN doc_id % 11 = 2 THEN 'removed' WHEN doc_id % 13 = 5 THEN 'added'
  WHEN doc_id % 3 <> 0 THEN 'unchanged' WHEN doc_id % 7 <> 0 AND doc_id % 17 <> 3 THEN 'touched' WHEN doc_id % 17 = 3 THEN 'added' ELSE 'updated' END AS action
FROM documents WHERE NOT (doc_id % 11 = 2 AND doc_id % 13 = 5)"""


@query(_PLAN)
def q_index_plan(spark, d):
    return index.plan(*_snapshots(spark, d))


@query(f"""SELECT count(*) FILTER (action <> 'removed') AS files, count(*) FILTER (action = 'added') AS added, count(*) FILTER (action = 'updated') AS updated,
  count(*) FILTER (action IN ('unchanged', 'touched')) AS unchanged, count(*) FILTER (action = 'removed') AS removed FROM ({_PLAN})""")
def q_index_report(spark, d):
    return index.report(index.plan(*_snapshots(spark, d)))


@query("""SELECT added, modified, removed, is_stale, added || ' nouveaux fichiers, ' || modified || ' fichiers modifiés, ' || removed || ' fichiers supprimés' AS sentence
FROM (SELECT count(*) FILTER (doc_id % 13 = 5 AND doc_id % 11 <> 2) AS added, count(*) FILTER (doc_id % 13 <> 5 AND doc_id % 11 <> 2 AND doc_id % 3 = 0) AS modified,
  count(*) FILTER (doc_id % 11 = 2 AND doc_id % 13 <> 5) AS removed, true AS is_stale FROM documents)""")
def q_staleness(spark, d):
    out = index.staleness(*_snapshots(spark, d))
    return out.withColumn("sentence", index.staleness_sentence(F.col("added"), F.col("modified"), F.col("removed")))


@query("""SELECT lang AS collection, count(*) FILTER (doc_id % 17 <> 3) AS n_documents, CAST(sum(CASE WHEN doc_id % 5 = 0 THEN 0 ELSE 1 END) AS BIGINT) AS n_chunks,
  coalesce(max(doc_id) FILTER (doc_id % 5 <> 0), 0) AS last_chunk FROM documents GROUP BY lang""")
def q_collection_summary(spark, d):
    docs = read(spark, d, "documents").withColumn("collection", F.col("lang"))
    chunks = docs.filter("doc_id % 5 <> 0").select("collection", F.col("doc_id").alias("chunk_id"))
    listed = docs.withColumn("skipped", F.when(F.col("doc_id") % 17 == 3, "no text"))
    return index.collection_summary(docs.select("collection").distinct(), listed, chunks)


@query("SELECT DISTINCT source AS name FROM documents WHERE doc_id % 29 = 1")
def q_collections_touched(spark, d):
    docs = read(spark, d, "documents")
    roots = docs.select(F.col("source").alias("name"), F.concat(F.lit("data/"), "source").alias("root")).distinct()
    paths = docs.filter("doc_id % 29 = 1").select(F.concat(F.lit("data/"), "source", F.lit("/a/"), F.col("doc_id").cast("string")).alias("path"))
    return index.collections_touched(roots, paths)


@query("SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN text || '!' ELSE text END AS text FROM documents WHERE doc_id % 11 <> 2")
def q_replace_documents(spark, d):
    docs = read(spark, d, "documents").select("doc_id", "text")
    changed = docs.filter("doc_id % 7 = 0 AND doc_id % 11 <> 2").withColumn("text", F.concat("text", F.lit("!")))
    return index.replace_documents(docs, changed, docs.filter("doc_id % 11 = 2"), ["doc_id"])


# --- retrieval ---------------------------------------------------------------------------------------------------

_STOP = ", ".join(f"'{w}'" for w in C.STOP_WORDS)


def _terms(table: str) -> str:
    singular = _fold("regexp_replace(w, '^(.{4,})s$', '\\1')")
    return f"""SELECT item_id, list_distinct(list_transform(list_filter(list_transform(list_filter(string_split_regex(text, '[^\\p{{L}}\\p{{N}}]+'),
  lambda w: length(w) >= 3 OR (length(w) = 2 AND (regexp_matches(w, '[0-9]') OR regexp_matches(w, '^\\p{{Lu}}+$')))), lambda w: lower(w)),
  lambda w: w NOT IN ({_STOP})), lambda w: {singular})) AS terms FROM {table}"""


@query(f"""SELECT item_id, array_to_string(list_sort(terms), ' ') AS terms FROM ({_terms("(SELECT item_id, text || ' XK of 4b Éa' AS text FROM benchmark)")})""")
def q_fts_terms(spark, d):
    text = F.concat("text", F.lit(" XK of 4b Éa"))
    return read(spark, d, "benchmark").select("item_id", F.array_join(F.array_sort(C.search_terms(text)), " ").alias("terms"))


_KEYWORD = f"""tok AS (SELECT doc_id, unnest(list_filter(string_split_regex({_FOLD}, '[^\\p{{L}}\\p{{N}}]+'), lambda w: w <> '')) AS term FROM documents),
post AS (SELECT doc_id, term, count(*) AS tf FROM tok GROUP BY ALL), len AS (SELECT d.doc_id, count(t.term) AS size FROM documents d LEFT JOIN tok t ON d.doc_id = t.doc_id GROUP BY 1),
pre AS (SELECT DISTINCT item_id, unnest(terms) AS prefix FROM ({_terms("benchmark")})), wanted AS (SELECT DISTINCT prefix FROM pre),
vocab AS (SELECT term, prefix FROM (SELECT term, substr(term, 1, CAST(unnest(range(1, length(term) + 1)) AS INTEGER)) AS prefix FROM (SELECT DISTINCT term FROM post)) JOIN wanted USING (prefix)),
found AS (SELECT prefix, doc_id, sum(tf) AS tf FROM post JOIN vocab USING (term) GROUP BY ALL), seen AS (SELECT prefix, count(*) AS n FROM found GROUP BY prefix),
whole AS (SELECT count(*) AS nt, avg(size) AS mean FROM len),
kw AS (SELECT item_id, doc_id, round(sum(greatest(ln((nt - n + 0.5) / (n + 0.5)), 1e-6) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * size / mean))), 6) AS score
  FROM found JOIN seen USING (prefix) JOIN len USING (doc_id) JOIN pre USING (prefix), whole GROUP BY ALL),
kwr AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) - 1 AS place FROM kw)"""


@query(f"WITH {_KEYWORD} SELECT item_id AS question_id, doc_id AS key, CAST(score AS DOUBLE) AS score, CAST(place AS INTEGER) AS place FROM kwr WHERE place < 50")
def q_keyword_bm25(spark, d):
    return retrieval.keyword(_corpus(spark, d), _questions(spark, d))


@query("""WITH q AS (SELECT vec_id AS qid, embedding AS qv FROM embeddings WHERE vec_id % 100 = 0),
s AS (SELECT qid AS question_id, vec_id AS key, round(list_sum(list_transform(list_zip(embedding, qv), lambda p: CAST(p[1] AS DOUBLE) * CAST(p[2] AS DOUBLE))), 9) AS score FROM embeddings, q)
SELECT question_id, key, score, CAST(place AS INTEGER) AS place FROM (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, key) - 1 AS place FROM s) WHERE place < 50""")
def q_cosine_topk(spark, d):
    vectors = read(spark, d, "embeddings").select(F.col("vec_id").alias("key"), F.col("embedding").cast("array<double>").alias("vector"))
    asked = vectors.filter("key % 100 = 0").select(F.col("key").alias("question_id"), F.col("vector").alias("question_vector"))
    return retrieval.nearest(vectors, asked)


def _vector(table: str, key: str, name: str) -> str:
    """Relations {name}(key, bucket, x): the coordinates of each text's vector that aren't zero."""
    return f"""{name}w AS (SELECT {key} AS key, unnest(list_filter(string_split_regex(lower(text), '[^\\p{{L}}\\p{{N}}]+'), lambda x: length(x) > 2)) AS word FROM {table}),
{name}u AS (SELECT DISTINCT word, hex(encode(word)) AS h FROM {name}w),
{name}b AS (SELECT word, list_reduce(list_prepend(37, list_transform(range(1, length(h), 2), lambda i: CAST('0x' || substr(h, CAST(i AS INTEGER), 2) AS INTEGER))),
  lambda x, y: (xor(x, y & 63) * 51) & 63) AS bucket FROM {name}u),
{name}c AS (SELECT key, bucket, count(*) AS n FROM {name}w JOIN {name}b USING (word) GROUP BY ALL),
{name} AS (SELECT key, CAST(bucket AS INTEGER) AS bucket, n / sqrt(sum(n * n) OVER (PARTITION BY key)) AS x FROM {name}c)"""


@query(f"WITH {_vector('documents', 'doc_id', 'v')} SELECT key, bucket, round(x, 9) AS weight FROM v")
def q_hash_embed(spark, d):
    vectors = retrieval.hash_vectors(_corpus(spark, d), "key")
    return vectors.select("key", F.posexplode("vector").alias("bucket", "x")).filter("x > 0").select("key", "bucket", F.round("x", 9).alias("weight"))


@query(ORACLES["q_cosine_topk"])
def q_cosine_clusters(spark, d):
    """The same rows, from the clusters that a question can't do without."""
    vectors = read(spark, d, "embeddings").select(F.col("vec_id").alias("key"), F.col("embedding").cast("array<double>").alias("vector"))
    asked = vectors.filter("key % 100 = 0").select(F.col("key").alias("question_id"), F.col("vector").alias("question_vector"))
    return clusters.nearest(clusters.build(vectors), asked)[0]


@query("SELECT vec_id, CAST(4 * len(embedding) AS BIGINT) AS n_bytes, embedding AS vector FROM embeddings")
def q_vector_bytes(spark, d):
    """Vectors as bytes and back; the two bytes too many are dropped."""
    raw = retrieval.vector_bytes(F.col("embedding"))
    stored = read(spark, d, "embeddings").select("vec_id", raw.alias("raw"))
    return stored.select("vec_id", F.octet_length("raw").cast("long").alias("n_bytes"), retrieval.vector_of(F.concat("raw", F.unhex(F.lit("0102")))).alias("vector"))


@query("""SELECT vec_id, round(sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE)))), 6) AS norm FROM embeddings""")
def q_l2_norm(spark, d):
    v = F.col("embedding").cast("array<double>")
    return read(spark, d, "embeddings").select("vec_id", F.round(F.sqrt(retrieval.dot(v, v)), 6).alias("norm"))


_MEANING = f"""{_vector("documents", "doc_id", "v")}, {_vector("benchmark", "item_id", "q")},
m AS (SELECT q.key AS item_id, v.key AS doc_id, round(sum(v.x * q.x), 9) AS score FROM v JOIN q USING (bucket) GROUP BY ALL),
mr AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) - 1 AS place FROM m)"""
_FUSED = f"""{_KEYWORD}, {_MEANING}, fused AS (SELECT coalesce(a.item_id, b.item_id) AS question_id, coalesce(a.doc_id, b.doc_id) AS key,
  round(coalesce(1.0 / (a.place + 61), 0) + coalesce(1.0 / (b.place + 61), 0), 9) AS score
  FROM (SELECT * FROM mr WHERE place < 50 AND score >= 0.3) a FULL JOIN (SELECT * FROM kwr WHERE place < 50) b ON a.item_id = b.item_id AND a.doc_id = b.doc_id)"""


@query(f"WITH {_FUSED} SELECT * FROM fused")
def q_rrf(spark, d):
    corpus, asked = _corpus(spark, d), _questions(spark, d)
    vectors = retrieval.hash_vectors(asked, "question_id").withColumnRenamed("vector", "question_vector")
    return retrieval.fuse(retrieval.nearest(retrieval.hash_vectors(corpus, "key"), vectors), retrieval.keyword(corpus, asked), 0.3)


@query()
def q_hybrid_context(spark, d):
    """Over passages, whose splitting SQL doesn't express; tests compare it with a plain version."""
    return retrieval.hybrid(_passages(spark, d), _questions(spark, d))


@query()
def q_multi_collection(spark, d):
    """As above, over two of the collections, named in the label, with a reranker."""
    labelled = _passages(spark, d).withColumn("source", C.collection_label(F.col("lang"), F.col("source"), 2))
    return retrieval.hybrid(labelled, _questions(spark, d), reranker=retrieval.word_scores, keep=F.col("lang").isin("en", "fr"))


@query(f"""WITH {_KEYWORD}, c AS (SELECT k.item_id, k.doc_id, k.place, list_distinct(list_filter(string_split_regex(lower(b.text), '\\s+'), lambda w: octet_length(encode(w)) > 2)) AS w,
  lower(d.text) AS t FROM kwr k JOIN documents d USING (doc_id) JOIN benchmark b ON k.item_id = b.item_id WHERE k.place < 20),
h AS (SELECT *, CAST(len(list_filter(w, lambda x: contains(t, x))) AS DOUBLE) AS hits FROM c)
SELECT item_id AS question_id, doc_id AS key, hits, CAST(place AS INTEGER) AS place,
  CAST(row_number() OVER (PARTITION BY item_id ORDER BY hits DESC, place) - 1 AS INTEGER) AS new_place FROM h""")
def q_word_rerank(spark, d):
    corpus, asked = _corpus(spark, d), _questions(spark, d)
    found = tables.with_texts(retrieval.keyword(corpus, asked, 20), corpus.select("key", "text"))
    return retrieval.rerank(found, asked).select("question_id", "key", "hits", "place", "new_place")


@query(f"""WITH {_KEYWORD}, t AS (SELECT k.item_id, string_agg('[' || (place + 1) || '] ' || source || '/' || doc_id || '.md' || chr(10) || text, chr(10) || chr(10) ORDER BY place) AS output
  FROM kwr k JOIN documents USING (doc_id) WHERE place < 5 GROUP BY k.item_id)
SELECT b.item_id AS question_id, coalesce(t.output, 'Aucun passage ne correspond à cette recherche.') AS output FROM benchmark b LEFT JOIN t ON b.item_id = t.item_id""")
def q_search_tool(spark, d):
    corpus, asked = _corpus(spark, d), _questions(spark, d)
    found = tables.with_texts(retrieval.keyword(corpus, asked, 5), corpus.select("key", "text", F.col("source").alias("label")))
    numbered = found.select("question_id", (F.col("place") + 1).alias("number"), "label", "text")
    return retrieval.tool_output(asked.select("question_id").join(numbered, "question_id", "left"))


@query(f"""WITH {_KEYWORD} SELECT item_id AS question_id, CAST(place AS INTEGER) AS number, CASE WHEN place % 3 = 0 THEN CAST('-Infinity' AS DOUBLE) ELSE CAST(score AS DOUBLE) END AS score, item_id % 2 = 0 AS valid
FROM kwr WHERE place < 10""")
def q_rerank_scores(spark, d):
    found = retrieval.keyword(_corpus(spark, d), _questions(spark, d), 10).select("question_id", F.col("place").alias("number"), "score")
    strange = found.filter("question_id % 2 = 1 AND number = 0").withColumn("number", F.lit(99))
    return retrieval.scores_in_order(found.drop("score"), found.filter("number % 3 <> 0").unionByName(strange))


@query()
def q_context_providers(spark, d):
    """Two sources under one numbering and one budget: documents by their words, embeddings' texts by their meaning. Both belong
    to the result, so one that fails fails the query."""
    docs = _corpus(spark, d)
    own = [providers.Words(docs.filter("lang = 'en'"), "words"), providers.Meaning(docs.filter("lang <> 'en'"), "meaning")]
    return providers.complete(*providers.gather(own, _questions(spark, d)))


@query("SELECT doc_id, doc_id || '.md — § ' || lang || chr(10) || text AS text FROM documents")
def q_embedding_text(spark, d):
    docs = read(spark, d, "documents")
    source = F.concat("source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".md"))
    return docs.select("doc_id", retrieval.embedding_text(source, F.concat(F.lit("§ "), "lang"), F.col("text")).alias("text"))


# --- passages ----------------------------------------------------------------------------------------------------


@query("""SELECT doc_id, CAST(pos AS INTEGER) AS pos, length(block) AS n FROM (SELECT doc_id, generate_subscripts(b, 1) - 1 AS pos, unnest(b) AS block FROM (
  SELECT doc_id, list_filter(list_transform(string_split_regex(text, '\\n(?:[ \\t\\r]*\\n)+'), lambda x: regexp_replace(x, '^\\n+|\\n+$', '', 'g')), lambda x: trim(x) <> '') AS b FROM documents))""")
def q_blocks(spark, d):
    return read(spark, d, "documents").select("doc_id", F.posexplode(passages.blocks(F.col("text"))).alias("pos", "block")).select(
        "doc_id", "pos", F.length("block").cast("long").alias("n")
    )


def _split(most: int, sections: bool = False, table: str = "documents") -> str:
    """Lines into blocks, blocks into passages of up to `most` characters, one step of a recursion for each."""
    head = "regexp_matches(line, '^\\s*#{1,6} .*\\S')" if sections else "false"
    fresh = f"(w.last OR length(w.cur) + 1 + length(e.piece) > {most})"
    place = "CASE WHEN {0}.title IS NULL THEN 'début' ELSE '§ ' || {0}.title END" if sections else "'L' || {0}.first || '-' || {0}.last"
    return f"""WITH RECURSIVE l AS (SELECT doc_id AS key, regexp_replace(unnest(string_split(text, chr(10))), '\\r$', '') AS line, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM {table}),
h AS (SELECT *, {head} AS head FROM l),
g AS (SELECT *, sum(CASE WHEN head OR before OR NOT regexp_matches(line, '\\S') THEN 1 ELSE 0 END) OVER (PARTITION BY key ORDER BY n) AS run FROM (SELECT *, coalesce(lag(head) OVER (PARTITION BY key ORDER BY n), false) AS before FROM h)),
o AS (SELECT key, n, run, head, NOT head AND length(line) > {most} AS long, unnest(range(0, CASE WHEN head THEN 1 ELSE greatest(1, length(line)) END, {most})) AS start, line FROM g WHERE regexp_matches(line, '\\S')),
e AS (SELECT key, n, run, long, CASE WHEN head THEN trim(line) ELSE substr(line, CAST(start + 1 AS BIGINT), {most}) END AS piece, row_number() OVER w AS i, lead(run) OVER w IS DISTINCT FROM run AS last,
  last_value(CASE WHEN head THEN trim(regexp_extract(line, '^\\s*#{{1,6}} (.*)$', 1)) END IGNORE NULLS) OVER (PARTITION BY key ORDER BY n, start ROWS UNBOUNDED PRECEDING) AS title,
  head AND regexp_matches(line, '^\\s*#{{1,2}} ') AS opens FROM o WINDOW w AS (PARTITION BY key ORDER BY n, start)),
walk AS (SELECT key, i, piece AS cur, n AS beg, n, last, title, opens, CAST(NULL AS VARCHAR) AS done, n AS a, n AS b, title AS done_title, opens AS done_opens FROM e WHERE i = 1
  UNION ALL SELECT e.key, e.i, CASE WHEN {fresh} THEN e.piece ELSE w.cur || chr(10) || e.piece END, CASE WHEN {fresh} THEN e.n ELSE w.beg END, e.n, e.last, e.title, e.opens,
    CASE WHEN {fresh} THEN w.cur END, w.beg, CASE WHEN w.last THEN w.n WHEN e.long THEN e.n ELSE e.n - 1 END, w.title, w.opens
  FROM walk w JOIN e ON e.key = w.key AND e.i = w.i + 1),
ends AS (SELECT key, max(i) AS i FROM e GROUP BY key),
blocks AS (SELECT key, text, a, b, title, opens, row_number() OVER (PARTITION BY key ORDER BY i) AS j FROM (SELECT key, i, done AS text, a, b, done_title AS title, done_opens AS opens FROM walk WHERE done IS NOT NULL
  UNION ALL SELECT w.key, w.i + 1, w.cur, w.beg, w.n, w.title, w.opens FROM walk w JOIN ends ON ends.key = w.key AND ends.i = w.i) WHERE regexp_matches(text, '\\S')),
pack AS (SELECT key, j, text AS held, length(text) + 2 AS size, 1 AS n, 0 AS old, a AS first, b AS last, title, text AS tail, a AS tail_a, title AS tail_title, opens AS tail_opens, CAST(NULL AS VARCHAR) AS done, '' AS place FROM blocks WHERE j = 1
  UNION ALL SELECT key, j, CASE WHEN again THEN tail || chr(10) || chr(10) || text WHEN full_ THEN text ELSE held || chr(10) || chr(10) || text END,
    length(text) + 2 + CASE WHEN again THEN length(tail) + 2 WHEN full_ THEN 0 ELSE size END, CASE WHEN again THEN 2 WHEN full_ THEN 1 ELSE n + 1 END, CASE WHEN again THEN 1 WHEN full_ THEN 0 ELSE old END,
    CASE WHEN again THEN tail_a WHEN full_ THEN a ELSE first END, b, CASE WHEN again THEN tail_title WHEN full_ THEN own ELSE title END, text, a, own, opens, CASE WHEN full_ THEN held END, {place.format("s")}
  FROM (SELECT *, full_ AND NOT opens AND NOT tail_opens AND length(tail) <= {most // 8} AS again FROM (SELECT p.* EXCLUDE (key, j, done, place), x.key, x.j, x.text, x.a, x.b, x.title AS own, x.opens, p.n > p.old AND (x.opens OR p.size + length(x.text) + 2 > {most}) AS full_
    FROM pack p JOIN blocks x ON x.key = p.key AND x.j = p.j + 1)) s),
stops AS (SELECT key, max(j) AS j FROM blocks GROUP BY key),
cut AS (SELECT key, j, place AS location, done AS passage FROM pack WHERE done IS NOT NULL
  UNION ALL SELECT p.key, p.j + 1, {place.format("p")}, p.held FROM pack p JOIN stops ON stops.key = p.key AND stops.j = p.j WHERE p.n > p.old)
SELECT key, CAST(row_number() OVER (PARTITION BY key ORDER BY j) - 1 AS INTEGER) AS ordinal, location, passage FROM cut"""


@query(_split(1000))
def q_chunks_text(spark, d):
    return passages.split(_corpus(spark, d), 250)


_HEADED = "(SELECT doc_id, replace(text, '. ', '.' || chr(10) || repeat('#', CAST(doc_id % 4 + 1 AS INTEGER)) || ' ' || source || chr(10)) AS text FROM documents)"


@query(_split(1000, True, _HEADED))
def q_chunks_sections(spark, d):
    """Between its sentences each document gets headings, whose level goes by its number."""
    mark = F.concat(F.lit(".\n"), F.repeat(F.lit("#"), (F.col("doc_id") % 4 + 1).cast("int")), F.lit(" "), "source", F.lit("\n"))
    docs = read(spark, d, "documents").select(F.col("doc_id").alias("key"), F.replace("text", F.lit(". "), mark).alias("text"))
    return passages.split(docs, 250, sections=True)


# --- streams -----------------------------------------------------------------------------------------------------


@query("""WITH e AS (SELECT user_id AS key, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 3 SECOND THEN 0 ELSE 1 END AS fresh FROM events),
s AS (SELECT key, ts, sum(fresh) OVER (PARTITION BY key ORDER BY ts ROWS UNBOUNDED PRECEDING) AS session FROM e)
SELECT key, epoch_us(min(ts)) AS first, epoch_us(max(ts)) AS last, count(*) AS n FROM s GROUP BY key, session""")
def q_debounce(spark, d):
    events = read(spark, d, "events").select(F.col("user_id").alias("key"), F.col("ts").cast("timestamp").alias("ts"))
    us = lambda c: F.unix_micros(F.col(c)).alias(c)
    return streams.debounce(events).select("key", us("first"), us("last"), "n")


@query("""WITH e AS (SELECT user_id AS key, event_id, row_number() OVER (PARTITION BY user_id, epoch_ms(ts) // 500 ORDER BY ts, event_id) AS a,
  row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS z FROM events)
SELECT key, event_id, z = 1 AS final FROM e WHERE a = 1 OR z = 1""")
def q_throttle(spark, d):
    return streams.throttle(read(spark, d, "events").withColumnRenamed("user_id", "key"))


@query("""SELECT event_id FROM events WHERE user_id IN (SELECT user_id FROM events WHERE event_type = 'signup')""")
def q_stale_discard(spark, d):
    events = read(spark, d, "events").withColumnRenamed("user_id", "request_id")
    return streams.current_only(events, events.filter("event_type = 'signup'").select("request_id").distinct()).select("event_id")


@query("SELECT user_id AS request_id, string_agg(event_type, '' ORDER BY event_id) AS text FROM events GROUP BY user_id")
def q_stream_text(spark, d):
    return streams.stream_text(
        read(spark, d, "events").select(F.col("user_id").alias("request_id"), F.col("event_id").alias("pos"), F.col("event_type").alias("text"))
    )


@query("""SELECT user_id AS request_id, CAST(0 AS INTEGER) AS round, event_id % 2 AS call_index, CASE WHEN event_id % 2 = 0 THEN 'call_0_0' ELSE string_agg('c', '') END AS call_id,
  string_agg(CASE WHEN event_type = 'view' THEN 'v' ELSE '' END, '' ORDER BY event_id) AS call_name, string_agg(props, '' ORDER BY event_id) AS arguments
FROM events GROUP BY user_id, event_id % 2""")
def q_tool_calls(spark, d):
    odd = F.col("event_id") % 2
    return streams.tool_calls(
        read(spark, d, "events").select(
            F.col("user_id").alias("request_id"), F.lit(0).alias("round"), F.col("event_id").alias("pos"), odd.alias("call_index"),
            F.when(odd == 1, "c").alias("call_id"), F.when(F.col("event_type") == "view", "v").alias("call_name"), F.col("props").alias("arguments"),
        )
    )


@query("""WITH e AS (SELECT user_id AS request_id, event_id AS pos, event_type AS kind,
  min(CASE WHEN event_type = 'error' THEN event_id END) OVER (PARTITION BY user_id) AS e FROM events)
SELECT request_id, pos, kind FROM e WHERE e IS NULL OR pos <= e""")
def q_until_error(spark, d):
    return streams.until_done(
        read(spark, d, "events").select(F.col("user_id").alias("request_id"), F.col("event_id").alias("pos"), F.col("event_type").alias("kind"))
    )


@query("""SELECT CAST(conv_id AS VARCHAR) AS stream_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS pos, role AS data FROM conversations""")
def q_sse_frames(spark, d):
    body = F.encode(F.concat(F.lit(": c\r\ndata: "), "role", F.lit("\r\n\r\n")), "UTF-8")
    return streams.sse(
        _turns(spark, d).select(F.col("conv_id").cast("string").alias("stream_id"), F.col("turn").alias("chunk_seq"), body.alias("bytes"))
    )


from quarry.plans import checked as _checked  # noqa: E402,F401  (queries of these modules register here)
from quarry.plans import more as _more  # noqa: E402,F401
