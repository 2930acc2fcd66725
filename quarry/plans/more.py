"""More queries by name: prompts and what they cost, versions, collection tables, wire formats, files and streams.

Messages with attachments, tools, summaries, images and states are made from the conversations: the kind of a turn
follows from its number.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions import columns as C
from quarry.functions import markup, wire
from quarry.operators import passages, prompts, store, versions
from quarry.plans.catalogue import _corpus, _split, _turns, query, read
from quarry.sources import files, ignore, office
from quarry.streaming import events as streams

# --- prompts -----------------------------------------------------------------------------------------------------

_ROLE = "CASE WHEN role <> 'system' AND turn % 9 = 4 THEN 'attachment' WHEN role <> 'system' AND turn % 9 = 6 THEN 'tool' WHEN role <> 'system' AND turn % 9 = 7 THEN 'summary' ELSE role END"
_MSG = f"""msg AS (SELECT conv_id, turn, {_ROLE} AS role, text, CASE turn % 11 WHEN 5 THEN 'failed' WHEN 9 THEN 'streaming' WHEN 10 THEN 'cancelled' ELSE 'complete' END AS status,
  CASE WHEN turn % 2 = 0 THEN 'f' || turn || '.md' END AS source, CASE WHEN {_ROLE} = 'attachment' AND conv_id % 2 = 0 THEN 'png' || turn END AS image FROM conversations),
u AS (SELECT * FROM msg WHERE status NOT IN ('failed', 'streaming') AND trim(text) <> ''),
chunks AS (SELECT conv_id, turn AS position, 'doc' || turn AS source, CASE WHEN turn = 1 THEN 'L1-2' ELSE '' END AS location, text FROM conversations WHERE turn IN (1, 2)),
src AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY kind, position) AS number, kind, path, location, text FROM (
  SELECT conv_id, 0 AS kind, turn AS position, coalesce(source, 'fichier joint') AS path, '' AS location, text FROM u WHERE role = 'attachment' AND image IS NULL
  UNION ALL SELECT conv_id, 1, position, source, location, text FROM chunks)),
block AS (SELECT conv_id, rtrim(string_agg(chr(10) || '[' || number || '] ' || path || CASE WHEN location = '' THEN '' ELSE ' ' || location END || chr(10) || trim(text) || chr(10), '' ORDER BY number), chr(10) || ' ') AS b FROM src GROUP BY conv_id),
summ AS (SELECT conv_id, arg_max(text, turn) FILTER (role = 'summary' AND status = 'complete' AND trim(text) <> '') AS s FROM msg GROUP BY conv_id),
sys AS (SELECT summ.conv_id, concat_ws(chr(10) || chr(10), 'Answer.', '{prompts.SUMMARY_INTRO}' || chr(10) || trim(s), '{prompts.CONTEXT_INTRO}' || chr(10) || b) AS content
  FROM summ LEFT JOIN block ON summ.conv_id = block.conv_id),
img AS (SELECT m.conv_id, m.turn, m.image, coalesce((SELECT min(u.turn) FROM u WHERE u.conv_id = m.conv_id AND u.role = 'user' AND u.turn > m.turn), (SELECT max(u.turn) FROM u WHERE u.conv_id = m.conv_id AND u.role = 'user')) AS q
  FROM msg m WHERE m.image IS NOT NULL),
imgs AS (SELECT conv_id, q, string_agg(image, ',' ORDER BY turn) AS images, count(*) AS n_images FROM img GROUP BY conv_id, q),
sent AS (SELECT conv_id, CAST(-1 AS BIGINT) AS position, 'system' AS role, content FROM sys WHERE content <> ''
  UNION ALL SELECT conv_id, turn, CASE role WHEN 'tool' THEN 'assistant' ELSE role END, CASE role WHEN 'tool' THEN '[outil : ' || coalesce(source, 'outil') || ']' || chr(10) ||
    CASE WHEN length(text) > 8000 THEN substr(text, 1, 8000) || chr(10) || '[…]' ELSE text END ELSE text END FROM u WHERE role IN ('system', 'user', 'assistant', 'tool')),
built AS (SELECT s.*, coalesce(images, '') AS images, coalesce(n_images, 0) AS n_images FROM sent s LEFT JOIN imgs i ON s.conv_id = i.conv_id AND s.position = i.q)"""


def _messages(spark: SparkSession, d: str) -> DataFrame:
    role = F.expr(_ROLE)
    return _turns(spark, d).select(
        "conv_id", "turn", role.alias("role"), "text",
        F.expr("CASE turn % 11 WHEN 5 THEN 'failed' WHEN 9 THEN 'streaming' WHEN 10 THEN 'cancelled' ELSE 'complete' END").alias("status"),
        F.expr("CASE WHEN turn % 2 = 0 THEN concat('f', turn, '.md') END").alias("source"),
        F.when((role == "attachment") & (F.col("conv_id") % 2 == 0), F.concat(F.lit("png"), "turn")).alias("image"),
    )


def _chunks(spark: SparkSession, d: str) -> DataFrame:
    return _turns(spark, d).filter("turn IN (1, 2)").select(
        "conv_id", F.col("turn").alias("position"), F.concat(F.lit("doc"), "turn").alias("source"), F.expr("CASE WHEN turn = 1 THEN 'L1-2' ELSE '' END").alias("location"), "text"
    )


@query(f"WITH {_MSG} SELECT conv_id, position, role, content, images FROM built")
def q_prompt_full(spark, d):
    built = prompts.build_messages(_messages(spark, d), _chunks(spark, d), " Answer. ")
    return built.withColumn("images", F.array_join("images", ","))


@query(f"WITH {_MSG} SELECT conv_id, CAST(sum(CAST(ceil(length(content) / 4.0) AS BIGINT) + 4 + 1000 * n_images) AS BIGINT) AS tokens FROM built GROUP BY conv_id")
def q_prompt_estimate(spark, d):
    return prompts.estimate(prompts.build_messages(_messages(spark, d), _chunks(spark, d), "Answer."))


@query(f"WITH {_MSG} SELECT conv_id, count(*) FILTER (role = 'attachment' AND image IS NULL AND status NOT IN ('failed', 'streaming') AND trim(text) <> '') + 1 AS first_number FROM msg GROUP BY conv_id")
def q_first_context_number(spark, d):
    return prompts.first_context_numbers(_messages(spark, d))


@query(f"WITH {_MSG} SELECT conv_id, CAST(number AS INTEGER) AS number, path, location FROM src WHERE kind = 1")
def q_citations(spark, d):
    return prompts.citations(_messages(spark, d), _chunks(spark, d))


@query(f"""WITH {_MSG} SELECT conv_id, 'Summarize this conversation:' || chr(10) || chr(10) || string_agg('### ' || CASE role WHEN 'user' THEN 'User' WHEN 'assistant' THEN 'Assistant' WHEN 'system' THEN 'System'
  WHEN 'summary' THEN 'Summary of earlier messages' WHEN 'tool' THEN 'Tool result (' || coalesce(source, '') || ')' ELSE 'Attached file ' || coalesce(source, '') END || chr(10) || trim(text), chr(10) || chr(10) ORDER BY turn) AS request
FROM u GROUP BY conv_id""")
def q_summary_request(spark, d):
    return prompts.summary_requests(_messages(spark, d))


_MEASURED = "measured AS (SELECT conv_id, 1000 + conv_id AS input_tokens, CASE WHEN conv_id % 3 = 0 THEN NULL ELSE 50 END AS output_tokens, 4 AS n_messages FROM (SELECT DISTINCT conv_id FROM conversations) WHERE conv_id % 4 <> 1)"


@query(f"""WITH {_MSG}, {_MEASURED}, est AS (SELECT conv_id, sum(CAST(ceil(length(content) / 4.0) AS BIGINT) + 4 + 1000 * n_images) AS tokens FROM built GROUP BY conv_id),
n AS (SELECT m.conv_id, input_tokens + coalesce(output_tokens, 0) AS total, n_messages, count(*) AS n, coalesce(sum(CAST(ceil(length(text) / 4.0) AS BIGINT) + 4) FILTER (place > n_messages), 0) AS newer
  FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS place FROM msg) m LEFT JOIN measured d ON m.conv_id = d.conv_id GROUP BY ALL)
SELECT n.conv_id, CAST(CASE WHEN n_messages <= n THEN total + newer ELSE coalesce(tokens, 0) END AS BIGINT) AS tokens, coalesce(n_messages = n, false) AS measured FROM n LEFT JOIN est ON n.conv_id = est.conv_id""")
def q_context_usage(spark, d):
    messages = _messages(spark, d)
    measured = messages.filter("conv_id % 4 <> 1").select("conv_id").distinct().select(
        "conv_id", (F.col("conv_id") + 1000).alias("input_tokens"), F.when(F.col("conv_id") % 3 != 0, 50).alias("output_tokens"), F.lit(4).alias("n_messages")
    )
    return prompts.context_usage(messages, prompts.build_messages(messages, _chunks(spark, d), "Answer."), measured)


@query(f"""WITH {_MSG}, s AS (SELECT conv_id, coalesce(sum(CAST(ceil(length(content) / 4.0) AS BIGINT) + 4) FILTER (role = 'system'), 0) AS all_system,
  coalesce(sum(CAST(ceil(length(content) / 4.0) AS BIGINT) + 4) FILTER (role <> 'system'), 0) AS history FROM built GROUP BY conv_id),
p AS (SELECT conv_id, coalesce(sum(CAST(ceil(length(text) / 4.0) AS BIGINT)) FILTER (role = 'attachment' AND image IS NULL), 0) AS attachments, 1000 * count(*) FILTER (role = 'attachment' AND image IS NOT NULL) AS images,
  coalesce(sum(CAST(ceil(length(text) / 4.0) AS BIGINT)) FILTER (role = 'summary' AND status = 'complete'), 0) AS summary FROM msg GROUP BY conv_id),
r AS (SELECT conv_id, sum(CAST(ceil(length(text) / 4.0) AS BIGINT)) AS retrieved FROM chunks GROUP BY conv_id),
a AS (SELECT s.conv_id, greatest(all_system - attachments - summary - coalesce(retrieved, 0), 0) AS system, coalesce(retrieved, 0) AS retrieved, attachments, images, summary, history, greatest(all_system + history, 1) AS t
  FROM s JOIN p ON s.conv_id = p.conv_id LEFT JOIN r ON s.conv_id = r.conv_id)
SELECT conv_id, {", ".join(f"CAST({c} AS BIGINT) AS {c}, CAST({c} * 100 // t AS BIGINT) AS {c}_percent" for c in ("system", "retrieved", "attachments", "images", "summary", "history"))} FROM a""")
def q_prompt_breakdown(spark, d):
    return prompts.breakdown(_messages(spark, d), _chunks(spark, d), "Answer.")


@query("""SELECT user_id AS request_id, arg_max(event_id % 100, event_id) FILTER (event_id % 3 = 0) AS input_tokens, arg_max(event_id % 77, event_id) FILTER (event_id % 5 = 1) AS output_tokens FROM events GROUP BY user_id""")
def q_last_usage(spark, d):
    return prompts.last_usage(read(spark, d, "events").select(
        F.col("user_id").alias("request_id"), F.col("event_id").alias("pos"),
        F.when(F.col("event_id") % 3 == 0, F.col("event_id") % 100).alias("input_tokens"), F.when(F.col("event_id") % 5 == 1, F.col("event_id") % 77).alias("output_tokens"),
    ))


@query("""WITH r AS (SELECT conv_id, turn, CASE turn % 3 WHEN 0 THEN 'a' WHEN 1 THEN 'b' ELSE 'c' END AS model, length(text) * 900 AS i, CASE WHEN turn % 5 = 0 THEN NULL ELSE length(text) * 70 END AS o FROM conversations WHERE role = 'assistant'),
p AS (SELECT 'a' AS model, 150000 AS pi, 600000 AS po UNION ALL SELECT 'b', 2000000, 9999999),
c AS (SELECT conv_id, turn, CAST(i * pi // 1000000 + coalesce(o, 0) * po // 1000000 AS BIGINT) AS micros FROM r LEFT JOIN p ON r.model = p.model)
SELECT conv_id, turn, micros, CAST(coalesce(sum(micros) OVER (PARTITION BY conv_id ORDER BY turn), 0) AS BIGINT) AS total FROM c""")
def q_request_costs(spark, d):
    size = F.length("text").cast("long")
    requests = _turns(spark, d).filter("role = 'assistant'").select(
        "conv_id", "turn", F.expr("CASE turn % 3 WHEN 0 THEN 'a' WHEN 1 THEN 'b' ELSE 'c' END").alias("model"),
        (size * 900).alias("input_tokens"), F.when(F.col("turn") % 5 != 0, size * 70).alias("output_tokens"),
    )
    prices = spark.createDataFrame([("a", 150_000, 600_000), ("b", 2_000_000, 9_999_999)], "model string, input_price long, output_price long")
    return prompts.request_costs(requests, prices)


@query("""WITH r AS (SELECT conv_id, turn, text, length(text) * 3 AS tokens, CASE WHEN turn % 4 = 1 THEN NULL ELSE 100 + turn END AS f, 100 + turn + (length(text) * 37) % 2000 AS n FROM conversations)
SELECT conv_id, turn, CAST(tokens * 1000 // greatest(n - f, 1) AS BIGINT) * CASE WHEN f IS NULL THEN NULL ELSE 1 END AS per_second,
  CASE WHEN n - f >= 500 THEN CAST(CAST(ceil(length(text) / 4.0) AS BIGINT) * 1000 // (n - f) AS BIGINT) END AS live FROM r""")
def q_speed(spark, d):
    first = F.col("turn") + 100
    ms = (F.length("text").cast("long") * 37) % 2000
    replies = _turns(spark, d).select("conv_id", "turn", "text", (F.length("text").cast("long") * 3).alias("tokens"), F.when(F.col("turn") % 4 != 1, first).alias("first_ms"), (first + ms).alias("now_ms"))
    out = prompts.speeds(replies)
    known = replies.select("conv_id", "turn", F.col("first_ms").isNotNull().alias("known"))
    return out.join(known, ["conv_id", "turn"]).select("conv_id", "turn", F.when(F.col("known"), F.col("per_second")).alias("per_second"), "live")


def _starts(spark, d):
    return _turns(spark, d).filter("conv_id % 2 = 0").select("conv_id").distinct().withColumn("context_start", F.col("conv_id") % 5)


_IN = "inside AS (SELECT * FROM conversations WHERE turn >= CASE WHEN conv_id % 2 = 0 THEN conv_id % 5 ELSE 0 END)"


@query(f"WITH {_IN} SELECT conv_id, turn, role FROM inside")
def q_in_context(spark, d):
    return prompts.in_context(_turns(spark, d), _starts(spark, d)).select("conv_id", "turn", "role")


@query(f"WITH {_IN} SELECT conv_id, min(turn) AS turn FROM inside GROUP BY conv_id")
def q_context_boundary(spark, d):
    return prompts.context_boundary(_turns(spark, d), _starts(spark, d))


@query(f"WITH {_IN} SELECT conv_id, count(*) FILTER (role IN ('user', 'assistant')) >= 2 AS compactable FROM inside GROUP BY conv_id")
def q_compactable(spark, d):
    return prompts.compactable(_turns(spark, d), _starts(spark, d))


# --- versions ----------------------------------------------------------------------------------------------------

_TAILS = """tails AS (SELECT conv_id, CAST(CASE WHEN conv_id % 2 = 0 THEN 1 END AS BIGINT) AS after_seq, CAST(2 AS BIGINT) AS number, turn, role, 'old ' || text AS text FROM conversations WHERE conv_id % 3 <> 2 AND turn BETWEEN 2 AND 3)"""


def _tails(spark, d):
    return _turns(spark, d).filter("conv_id % 3 <> 2 AND turn BETWEEN 2 AND 3").select(
        "conv_id", F.when(F.col("conv_id") % 2 == 0, 1).cast("long").alias("after_seq"), F.lit(2).cast("long").alias("number"), "turn", "role", F.concat(F.lit("old "), "text").alias("text")
    )


def _cuts(spark, d):
    return _turns(spark, d).filter("conv_id % 4 <> 1").select("conv_id").distinct().withColumn("after_seq", F.when(F.col("conv_id") % 2 == 0, 1).cast("long"))


@query(f"""WITH {_TAILS} SELECT * FROM tails UNION ALL
SELECT conv_id, CASE WHEN conv_id % 2 = 0 THEN 1 END, 1, turn, role, text FROM conversations WHERE conv_id % 4 <> 1 AND (conv_id % 2 = 1 OR turn > 1)""")
def q_archive_tail(spark, d):
    return versions.archive(_turns(spark, d), _tails(spark, d), _cuts(spark, d))[1]


@query(f"""WITH {_TAILS}, target AS (SELECT DISTINCT conv_id FROM tails WHERE conv_id % 4 <> 1)
SELECT conv_id, turn, role, text FROM conversations WHERE NOT (conv_id IN (SELECT conv_id FROM target) AND (conv_id % 2 = 1 OR turn > 1))
UNION ALL SELECT conv_id, turn, role, text FROM tails WHERE conv_id IN (SELECT conv_id FROM target)""")
def q_switch_version(spark, d):
    return versions.switch(_turns(spark, d).select("conv_id", "turn", "role", "text"), _tails(spark, d), _cuts(spark, d).withColumn("number", F.lit(2).cast("long")))[0]


@query(f"""WITH {_TAILS}, b AS (SELECT DISTINCT conv_id, after_seq FROM tails)
SELECT b.conv_id, b.after_seq, (SELECT min(turn) FROM conversations c WHERE c.conv_id = b.conv_id AND (b.after_seq IS NULL OR c.turn > b.after_seq)) AS mark FROM b
WHERE b.after_seq IS NULL OR EXISTS (SELECT 1 FROM conversations c WHERE c.conv_id = b.conv_id AND c.turn = b.after_seq)""")
def q_branch_points(spark, d):
    return versions.branch_points(_turns(spark, d), _tails(spark, d))


@query(f"""WITH {_TAILS} SELECT * FROM tails UNION ALL SELECT conv_id, 1, 1, turn, role, text FROM conversations WHERE turn = 3 AND conv_id % 2 = 0""")
def q_keep_reply(spark, d):
    pairs = _turns(spark, d).filter("conv_id % 2 = 0").select("conv_id").distinct().select(
        "conv_id", F.lit(1).cast("long").alias("question"), F.lit(2).cast("long").alias("chosen"), F.lit(3).cast("long").alias("other")
    )
    return versions.keep_reply(_turns(spark, d), _tails(spark, d), pairs)[1]


@query("SELECT conv_id, turn FROM conversations WHERE conv_id % 5 <> 2")
def q_delete_conversation(spark, d):
    gone = _turns(spark, d).filter("conv_id % 5 = 2").select("conv_id")
    return versions.delete_conversations(gone, _turns(spark, d))[0].select("conv_id", "turn")


@query("""WITH l AS (SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN text END AS title, CASE WHEN turn % 3 = 1 THEN role END AS persona, turn % 4 = 3 AS cleared FROM conversations)
SELECT conv_id, coalesce(arg_max(title, turn) FILTER (title IS NOT NULL), 'untitled') AS title,
  CASE WHEN count(*) FILTER (persona IS NOT NULL OR cleared) = 0 THEN 'none' ELSE list(persona ORDER BY turn DESC) FILTER (persona IS NOT NULL OR cleared)[1] END AS persona FROM l GROUP BY conv_id""")
def q_point_updates(spark, d):
    turns = _turns(spark, d)
    known = turns.select("conv_id").distinct().select("conv_id", F.lit("untitled").alias("title"), F.lit("none").alias("persona"))
    log = turns.select(
        "conv_id", F.col("turn").alias("op"), F.when(F.col("turn") % 4 == 3, F.array(F.lit("persona"))).otherwise(F.array().cast("array<string>")).alias("cleared"),
        F.when(F.col("turn") % 2 == 0, F.col("text")).alias("title"), F.when(F.col("turn") % 3 == 1, F.col("role")).alias("persona"),
    )
    return versions.point_updates(known, log, ["title", "persona"])


# --- collections -------------------------------------------------------------------------------------------------


def _stored(spark, d):
    docs = read(spark, d, "documents").select(
        F.col("lang").alias("collection"), F.col("doc_id").cast("string").alias("path"), F.col("n_chars").alias("size"), F.lit(0).cast("long").alias("mtime"),
        F.md5("text").alias("hash"), F.when(F.col("doc_id") % 17 == 3, "no text").alias("skipped"),
    )
    chunks = read(spark, d, "documents").filter("doc_id % 17 <> 3").select(
        F.col("lang").alias("collection"), F.col("doc_id").cast("string").alias("path"), F.explode(F.array(F.lit(0), F.lit(1))).alias("ordinal"), F.lit("").alias("location"), F.lit("old").alias("text")
    )
    return docs, chunks


@query("""SELECT lang AS collection, CAST(doc_id AS VARCHAR) AS path, ordinal, CASE WHEN doc_id % 5 = 0 THEN 'new' ELSE 'old' END AS text
FROM documents, (SELECT unnest([0, 1]) AS ordinal) WHERE CASE WHEN doc_id % 5 = 0 THEN ordinal = 0 WHEN doc_id % 7 = 1 THEN false ELSE doc_id % 17 <> 3 END""")
def q_write_documents(spark, d):
    docs, chunks = _stored(spark, d)
    new = docs.filter("cast(path as long) % 5 = 0").drop("skipped")
    new_chunks = new.select("collection", "path", F.lit(0).alias("ordinal"), F.lit("L1-1").alias("location"), F.lit("new").alias("text"))
    docs, chunks = store.write_documents(docs, chunks, new, new_chunks)
    skipped = docs.filter("cast(path as long) % 7 = 1 AND cast(path as long) % 5 <> 0").withColumn("reason", F.lit("fichier binaire"))
    return store.write_skipped(docs, chunks, skipped)[1].select("collection", "path", "ordinal", "text")


@query("""SELECT lang AS collection, CAST(doc_id AS VARCHAR) AS path, CAST(CASE WHEN doc_id % 3 = 0 THEN 9 ELSE 0 END AS BIGINT) AS mtime, CASE WHEN doc_id % 7 = 1 THEN '' ELSE md5(text) END AS hash,
  CASE WHEN doc_id % 7 = 1 THEN 'fichier binaire' WHEN doc_id % 17 = 3 THEN 'no text' END AS skipped FROM documents WHERE doc_id % 11 <> 2""")
def q_touch_and_skip(spark, d):
    docs, chunks = _stored(spark, d)
    docs, chunks = store.write_skipped(docs, chunks, docs.filter("cast(path as long) % 7 = 1").withColumn("reason", F.lit("fichier binaire")))
    docs = store.touch_documents(docs, docs.filter("cast(path as long) % 3 = 0").select("collection", "path", F.lit(9).cast("long").alias("new_mtime")))
    return store.remove_documents(docs, chunks, docs.filter("cast(path as long) % 11 = 2"))[0].select("collection", "path", "mtime", "hash", "skipped")


@query("""WITH c AS (SELECT DISTINCT lang AS name FROM documents), o AS (SELECT name, CASE name WHEN 'en' THEN 'b' WHEN 'fr' THEN 'a' ELSE 'a' END AS m, name = 'en' AS reset FROM c)
SELECT name, m AS embedding_model, CASE WHEN reset THEN 0 ELSE 64 END AS dims, reset, (SELECT count(*) FROM documents WHERE lang = name AND NOT reset) AS n_documents FROM o
UNION ALL SELECT 'new', 'b', 0, false, 0""")
def q_open_collection(spark, d):
    docs, _ = _stored(spark, d)
    known = docs.select(F.col("collection").alias("name")).distinct().select("name", F.concat(F.lit("/"), "name").alias("root"), F.lit("a").alias("embedding_model"), F.lit(64).alias("dims"))
    wanted = spark.createDataFrame([("en", "/x", "b"), ("fr", "/y", "a"), ("new", "/z", "b")], "name string, root string, model string")
    opened, left = store.open_collections(known, docs, wanted)
    counts = left.groupBy(F.col("collection").alias("name")).agg(F.count("*").alias("n_documents"))
    return opened.join(counts, "name", "left").select("name", "embedding_model", "dims", "reset", F.coalesce("n_documents", F.lit(0)).alias("n_documents"))


@query("SELECT lang AS collection, CAST(doc_id AS VARCHAR) AS path, ordinal FROM documents, (SELECT unnest([0, 1]) AS ordinal) WHERE doc_id % 17 <> 3 AND lang IN ('en', 'de')")
def q_load_passages(spark, d):
    docs, chunks = _stored(spark, d)
    return store.load_passages(chunks, docs, ["en", "de"]).select("collection", "path", "ordinal")


_RUN = """WITH p AS (SELECT lang AS collection, doc_id, CASE doc_id % 6 WHEN 0 THEN 'added' WHEN 1 THEN 'updated' WHEN 2 THEN 'removed' WHEN 3 THEN 'touched' ELSE 'unchanged' END AS action, doc_id % 12 = 6 AS failed FROM documents),
r AS (SELECT collection, count(*) FILTER (action <> 'removed') AS files, count(*) FILTER (action = 'added' AND NOT failed) AS added, count(*) FILTER (action = 'updated') AS updated,
  count(*) FILTER (action IN ('touched', 'unchanged')) AS unchanged, count(*) FILTER (action = 'removed') AS removed, count(*) FILTER (failed) AS skipped, 2 * count(*) FILTER (action = 'updated') AS passages FROM p GROUP BY collection)"""


def _run(spark, d):
    docs, _ = _stored(spark, d)
    n = F.col("path").cast("long")
    kinds = F.array(*map(F.lit, ["added", "updated", "removed", "touched", "unchanged", "unchanged"]))
    planned = docs.select("collection", "path", F.get(kinds, (n % 6).cast("int")).alias("action"))
    written = docs.filter(n % 6 == 1).withColumn("ordinal", F.explode(F.array(F.lit(0), F.lit(1))))
    return store.index_report(planned, docs.filter(n % 12 == 6), written)


@query(f"{_RUN} SELECT * FROM r")
def q_index_run(spark, d):
    return _run(spark, d)


@query(f"""{_RUN} SELECT collection, '« ' || collection || ' » indexée : ' || concat_ws(', ', files || ' fichiers', CASE WHEN added > 0 THEN added || ' ajoutés' END, CASE WHEN updated > 0 THEN updated || ' modifiés' END,
  CASE WHEN removed > 0 THEN removed || ' retirés' END, CASE WHEN unchanged > 0 THEN unchanged || ' inchangés' END, CASE WHEN skipped > 0 THEN skipped || ' ignorés' END) || ', ' ||
  replace(format('{{:,}}', passages * 1000), ',', chr(8239)) || ' passages écrits' || CASE WHEN collection = 'en' THEN ' (modèle d''embedding changé : réindexé)' ELSE '' END AS sentence FROM r""")
def q_index_sentence(spark, d):
    counts = {c: F.col(c) for c in ("files", "added", "updated", "removed", "unchanged", "skipped")}
    return _run(spark, d).select("collection", store.index_sentence(F.col("collection"), counts, F.col("passages") * 1000, F.col("collection") == "en").alias("sentence"))


@query("""WITH s AS (SELECT lang, doc_id % 13 = 5 AND doc_id % 11 <> 2 AS a, doc_id % 13 <> 5 AND doc_id % 11 <> 2 AND doc_id % 3 = 0 AS m, doc_id % 13 <> 5 AND doc_id % 11 = 2 AS r FROM documents)
SELECT lang AS collection, CAST(CASE WHEN lang = 'es' THEN 0 ELSE count(*) FILTER (a) END AS BIGINT) AS added, CAST(CASE WHEN lang = 'es' THEN 0 ELSE count(*) FILTER (m) END AS BIGINT) AS modified,
  CAST(CASE WHEN lang = 'es' THEN 0 ELSE count(*) FILTER (r) END AS BIGINT) AS removed, lang = 'es' AS missing_root, lang <> 'es' AND count(*) FILTER (a OR m OR r) > 0 AS is_stale FROM s GROUP BY lang""")
def q_staleness_by_collection(spark, d):
    docs, _ = _stored(spark, d)
    n = F.col("path").cast("long")
    scan = docs.filter(n % 11 != 2).withColumn("mtime", F.when(n % 3 == 0, 1).otherwise(0).cast("long"))
    roots = docs.select("collection").distinct().withColumn("present", F.col("collection") != "es")
    return store.staleness(roots, scan.select("collection", "path", "size", "mtime"), docs.filter(n % 13 != 5).select("collection", "path", "size", "mtime"))


@query("SELECT count(*) AS n_documents FROM documents WHERE lang IN ('en', 'fr')")
def q_documents_selected(spark, d):
    summary = read(spark, d, "documents").groupBy(F.col("lang").alias("collection")).agg(F.count("*").alias("n_documents"))
    return store.documents_selected(summary, C.names(F.lit("en, fr,en")))


@query("""SELECT p_partkey, p_name || '-Q4.gguf' AS path, CASE WHEN p_partkey % 2 = 0 THEN p_partkey * 10 ELSE p_partkey END AS size, CASE WHEN p_partkey % 2 = 0 AND p_partkey > 0 THEN md5(p_name) END AS sha256 FROM part WHERE p_partkey % 3 <> 1""")
def q_listed_files(spark, d):
    """One listing for each part: a file, a folder, a note, and a shard (two parts of three)."""
    stored = F.when(F.col("p_partkey") % 2 == 0, F.struct(F.concat(F.lit("sha256:"), F.md5("p_name")).alias("oid"), (F.col("p_partkey") * 10).alias("size")))
    entry = lambda kind, path, lfs: F.struct(F.lit(kind).alias("type"), path.alias("path"), F.col("p_partkey").alias("size"), lfs.alias("lfs"))
    none = F.lit(None).cast("struct<oid:string,size:bigint>")
    own = F.when(F.col("p_partkey") % 3 == 1, F.lit("m-00001-of-00002.gguf")).otherwise(F.concat("p_name", F.lit("-Q4.gguf")))
    listing = F.to_json(F.array(entry("file", own, stored), entry("directory", F.lit("x.gguf"), none), entry("file", F.lit("a/b.gguf"), none), entry("file", F.lit("README.md"), none)))
    return read(spark, d, "part").select("p_partkey", F.inline(store.listed_files(listing)))


@query("""SELECT 'r' || (p_partkey % 7) AS repo, p_name AS path, p_partkey AS size FROM part""")
def q_smallest_first(spark, d):
    return store.smallest_first(read(spark, d, "part").select(F.concat(F.lit("r"), F.col("p_partkey") % 7).alias("repo"), F.col("p_name").alias("path"), F.col("p_partkey").alias("size")))


_INVENTORY = """inv AS (SELECT 'r' || repo AS repo, 'f' || file AS file, bytes, downloaded_at FROM (SELECT user_id % 9 AS repo, user_id % 2 AS file, arg_max(event_id % 3 = 0, event_id) AS deleted,
  arg_max(event_id * 2, event_id) AS bytes, arg_max(event_id, event_id) AS downloaded_at FROM events GROUP BY ALL) WHERE NOT deleted)"""


def _models(spark, d):
    return store.inventory(read(spark, d, "events").select(
        F.concat(F.lit("r"), F.col("user_id") % 9).alias("repo"), F.concat(F.lit("f"), F.col("user_id") % 2).alias("file"), F.col("event_id").alias("op"),
        (F.col("event_id") % 3 == 0).alias("deleted"), (F.col("event_id") * 2).alias("bytes"), F.col("event_id").alias("downloaded_at"),
    ))


@query(f"WITH {_INVENTORY} SELECT * FROM inv")
def q_model_inventory(spark, d):
    return _models(spark, d)


@query(f"WITH {_INVENTORY}, cat AS (SELECT 'r' || x AS repo, 'c' AS file FROM range(0, 12) t(x)) SELECT repo, file, true AS downloaded FROM inv UNION ALL SELECT repo, file, false FROM cat WHERE repo NOT IN (SELECT repo FROM inv)")
def q_model_rows(spark, d):
    catalogue = spark.range(12).select(F.concat(F.lit("r"), F.col("id")).alias("repo"), F.lit("c").alias("file"))
    return store.model_rows(_models(spark, d), catalogue)


@query("""WITH c AS (SELECT user_id AS model, event_id * 7 % 5 AS t, count(*) AS n FROM events WHERE event_id * 7 % 5 <> 0 GROUP BY ALL)
SELECT model, t AS tensor_type FROM (SELECT *, row_number() OVER (PARTITION BY model ORDER BY n DESC, t) AS k FROM c) WHERE k = 1""")
def q_dominant_type(spark, d):
    return store.dominant_type(read(spark, d, "events").select(F.col("user_id").alias("model"), (F.col("event_id") * 7 % 5).alias("tensor_type")))


@query(r"""WITH u AS (SELECT page_id, regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) AS host, list_filter(string_split(regexp_extract(url, '^[a-z]+://[^/]+/([^?#]*)', 1), '/'), lambda x: x <> '') AS p FROM pages),
t AS (SELECT page_id, CASE page_id % 5 WHEN 0 THEN p WHEN 1 THEN p || ['blob', 'main', host] WHEN 2 THEN p || ['tree', 'v' || page_id] WHEN 3 THEN [host] || p ELSE p || ['issues'] END AS p FROM u),
k AS (SELECT page_id, p, len(p) AS n, p[3] AS kind FROM t),
s AS (SELECT page_id, p, n = 2 OR (n = 3 AND kind = 'tree') OR (n = 4 AND kind = 'tree') OR (n = 5 AND kind IN ('blob', 'resolve')) AS ok, (n = 4 AND kind = 'tree') OR (n = 5 AND kind IN ('blob', 'resolve')) AS revised, n = 5 AND kind IN ('blob', 'resolve') AS filed FROM k)
SELECT page_id, CASE WHEN ok THEN p[1] || '/' || p[2] END AS repo, CASE WHEN revised THEN p[4] END AS revision, CASE WHEN filed THEN p[5] END AS file FROM s""")
def q_parse_target(spark, d):
    """Owner and name are the folders of the pages' URLs."""
    n = F.col("page_id")
    host, inside = F.regexp_extract("url", "^[a-z]+://([^/?#]+)", 1), F.regexp_extract("url", "^[a-z]+://[^/]+/([^?#]*)", 1)
    shapes = F.array(
        inside, F.concat(F.lit("https://hub.example/"), inside, F.lit("/blob/main/"), host), F.concat(F.lit("http://hub.example/"), inside, F.lit("/tree/v"), n, F.lit("?x#y")), F.col("url"), F.concat(F.lit("hub.example/"), inside, F.lit("/issues/"))
    )
    found = store.parsed_target(F.get(shapes, (n % 5).cast("int")), ("hub.example",))
    return read(spark, d, "pages").select("page_id", found["repo"].alias("repo"), found["revision"].alias("revision"), found["file"].alias("file"))


# --- wire formats ------------------------------------------------------------------------------------------------


@query("""SELECT conv_id, turn, CASE WHEN turn % 3 = 0 THEN NULL ELSE '[{"number":' || turn || ',"path":"p' || conv_id || '","location":"L' || turn || '"}]' END AS body, CASE WHEN turn % 3 = 0 THEN 0 ELSE 1 END AS n FROM conversations""")
def q_citations_json(spark, d):
    one = F.array(F.struct(F.col("turn").cast("int").alias("number"), F.concat(F.lit("p"), "conv_id").alias("path"), F.concat(F.lit("L"), "turn").alias("location")))
    body = wire.citations_json(F.when(F.col("turn") % 3 != 0, one).otherwise(F.array().cast(wire.CITATIONS)))
    return _turns(spark, d).select("conv_id", "turn", body.alias("body")).withColumn("n", F.size(wire.citations_of(F.coalesce("body", F.when(F.col("turn") % 2 == 0, "")))))


@query("SELECT p_partkey, p_partkey % 3 <> 1 AS chat, CASE WHEN p_partkey % 2 = 0 THEN p_partkey ELSE p_size END AS context FROM part")
def q_chat_models(spark, d):
    name = F.when(F.col("p_partkey") % 3 == 1, F.concat(F.lit("text-embedding-"), "p_partkey")).otherwise(F.concat(F.lit("m-"), "p_partkey"))
    window = wire.context_window(F.when(F.col("p_partkey") % 2 == 0, F.col("p_partkey")), F.col("p_size").cast("long"))
    return read(spark, d, "part").select("p_partkey", wire.can_chat(name).alias("chat"), window.alias("context"))


@query("SELECT event_id, CASE WHEN event_id % 5 = 4 THEN NULL ELSE event_id END AS context FROM events")
def q_reported_window(spark, d):
    e, n = F.col("event_id").cast("string"), F.col("event_id") % 5
    body = (
        F.when(n == 0, F.concat(F.lit('{"models":[{"name":"x"},{"name":"m:latest","context_length":'), e, F.lit("}]}")))
        .when(n == 1, F.concat(F.lit('{"models":[{"key":"m","max_context_length":1,"loaded_instances":[{"config":{"context_length":'), e, F.lit("}}]}]}")))
        .when(n == 2, F.concat(F.lit('{"models":[{"id":"m","max_context_length":'), e, F.lit("}]}")))
        .when(n == 3, F.concat(F.lit('{"default_generation_settings":{"n_ctx":'), e, F.lit("}}")))
        .otherwise(F.lit('{"models":[]}'))
    )
    return read(spark, d, "events").select("event_id", wire.reported_window(body, F.lit("m")).alias("context"))


@query("""SELECT event_id, CASE event_id % 6 WHEN 0 THEN 'lire ' || event_type WHEN 1 THEN 'lister un dossier' WHEN 2 THEN 'chercher « ' || event_type || ' » dans les documents' WHEN 3 THEN 'chercher « a » dans « ' || event_type || ' »'
  WHEN 4 THEN 'utiliser git › log (k: ' || json_extract_string(props, '$.k') || ')' ELSE 'outil inconnu : ' || event_type END AS what FROM events""")
def q_describe_call(spark, d):
    n = F.col("event_id") % 6
    pick = lambda *values: F.get(F.array(*values), n.cast("int"))
    name = pick(F.lit("read_file"), F.lit("list_dir"), F.lit("search_documents"), F.lit("search_documents"), F.lit("git__log"), F.col("event_type"))
    arguments = pick(
        F.concat(F.lit('{"path":"'), "event_type", F.lit('"}')), F.lit("not json"), F.concat(F.lit('{"query":"'), "event_type", F.lit('"}')),
        F.concat(F.lit('{"query":"a","collection":"'), "event_type", F.lit('"}')), F.col("props"), F.lit("{}"),
    )
    return read(spark, d, "events").select("event_id", wire.described_call(name, arguments).alias("what"))


@query("""SELECT event_id, event_id % 2 = 0 AS ok, CASE WHEN event_id % 3 = 0 THEN event_type || chr(10) || '[image image/png]' || chr(10) || '[ressource r]' || chr(10) || '[lien u]' WHEN event_id % 3 = 1 THEN '{"a":1}' ELSE '' END AS text FROM events""")
def q_tool_result(spark, d):
    failed = F.when(F.col("event_id") % 2 == 1, F.lit(',"isError":true')).otherwise(F.lit(""))
    content = F.concat(F.lit('{"content":[{"type":"text","text":"'), "event_type", F.lit('"},{"type":"image","mimeType":"image/png"},{"type":"other"},{"type":"resource","resource":{"uri":"r"}},{"type":"resource_link","uri":"u"}]'), failed, F.lit("}"))
    body = F.when(F.col("event_id") % 3 == 0, content).when(F.col("event_id") % 3 == 1, F.concat(F.lit('{"structuredContent":{"a":1}'), failed, F.lit("}"))).otherwise(F.concat(F.lit('{"content":[]'), failed, F.lit("}")))
    return read(spark, d, "events").select("event_id", wire.tool_result(body).alias("x")).select("event_id", "x.ok", "x.text")


_WIRE = """w AS (SELECT conv_id, turn, CASE WHEN role <> 'system' AND turn % 5 IN (2, 3) THEN 'tool' ELSE role END AS role, text FROM conversations),
g AS (SELECT *, sum(CASE WHEN role = 'tool' AND before = 'tool' THEN 0 ELSE 1 END) OVER (PARTITION BY conv_id ORDER BY turn) AS number FROM (SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS before FROM w WHERE role <> 'system'))"""


def _wired(spark, d):
    tool = (F.col("role") != "system") & (F.col("turn") % 5).isin(2, 3)
    return _turns(spark, d).select(
        "conv_id", F.col("turn").alias("position"), F.when(tool, "tool").otherwise(F.col("role")).alias("role"), F.col("text").alias("content"), F.when(tool, F.concat(F.lit("c"), "turn")).alias("call_id")
    )


@query(f"""WITH {_WIRE}, t AS (SELECT conv_id, count(DISTINCT number) AS n_turns, count(*) FILTER (role = 'tool') AS n_results FROM g GROUP BY conv_id),
s AS (SELECT conv_id, string_agg(text, chr(10) || chr(10) ORDER BY turn) FILTER (role = 'system') AS system FROM w GROUP BY conv_id)
SELECT s.conv_id, s.system, coalesce(n_turns, 0) AS n_turns, coalesce(n_results, 0) AS n_results FROM s LEFT JOIN t ON s.conv_id = t.conv_id""")
def q_turn_messages(spark, d):
    kind = "array<struct<role:string,content:array<struct<type:string,tool_use_id:string,text:string>>>>"
    turns = F.coalesce(F.from_json("turns", kind), F.array().cast(kind))
    results = F.filter(F.flatten(F.transform(turns, lambda t: t["content"])), lambda x: x["type"] == "tool_result")
    return wire.turn_messages(_wired(spark, d)).select("conv_id", "system", F.size(turns).cast("long").alias("n_turns"), F.size(results).cast("long").alias("n_results"))


@query(f"WITH {_WIRE} SELECT conv_id, turn, role, text FROM w")
def q_chat_messages(spark, d):
    rows = F.from_json("body", "array<struct<role:string,content:string,tool_call_id:string>>")
    return wire.chat_messages(_wired(spark, d)).select("conv_id", F.posexplode(rows).alias("k", "x")).join(
        _turns(spark, d).selectExpr("conv_id", "turn", "row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS k"), ["conv_id", "k"]
    ).select("conv_id", "turn", "x.role", F.col("x.content").alias("text"))


# --- markup and files --------------------------------------------------------------------------------------------


@query()
def q_html_text(spark, d):
    return read(spark, d, "pages").select("page_id", markup.html_to_text(F.col("html")).alias("text"))


@query("""WITH t AS (SELECT doc_id, regexp_replace(text, '(^|\\n)\\s*$', '') AS code, text FROM documents)
SELECT doc_id, CASE WHEN code = '' THEN '' ELSE code || chr(10) END AS code FROM t UNION ALL SELECT doc_id, doc_id || chr(10) FROM documents""")
def q_code_blocks(spark, d):
    """Each document's text in a fence, and its number as an indented block."""
    text = F.concat(F.lit("# t\n\n~~~py\n"), "text", F.lit("\n~~~\ntext `x`\n\n    "), "doc_id", F.lit("\n\nend"))
    return read(spark, d, "documents").select("doc_id", F.explode(markup.code_blocks(text)).alias("code"))


@query("""SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(text, '[ \\t\\r\\x0b\\x0c]+(\\n|$)', '\\1', 'g'), '\\n{3,}', chr(10) || chr(10), 'g'), '^\\n+|\\n+$', '', 'g') AS text FROM documents""")
def q_tidy(spark, d):
    return read(spark, d, "documents").select("doc_id", markup.tidy(F.col("text")).alias("text"))


@query("""SELECT doc_id, kind, reason FROM (SELECT doc_id, CASE doc_id % 4 WHEN 3 THEN NULL ELSE 'markdown' END AS kind, CASE doc_id % 4 WHEN 1 THEN 'fichier binaire' WHEN 2 THEN 'aucun texte' END AS reason FROM documents) WHERE kind IS NOT NULL""")
def q_extract(spark, d):
    n = F.col("doc_id") % 4
    content = F.when(n == 1, F.unhex(F.lit("410042"))).when(n == 2, F.encode(F.lit(" \n"), "UTF-8")).otherwise(F.encode("text", "UTF-8"))
    listed = read(spark, d, "documents").select(F.concat("doc_id", F.when(n == 3, ".bin").otherwise(".md")).alias("path"), content.alias("content"))
    return office.extract(listed).select(F.regexp_extract("path", r"\d+", 0).cast("long").alias("doc_id"), "kind", "reason")


@query("""SELECT doc_id, CASE doc_id % 5 WHEN 1 THEN 'too large' WHEN 2 THEN 'not text' WHEN 3 THEN 'not UTF-8' END AS reason, CASE doc_id % 5 WHEN 0 THEN text END AS text, CASE doc_id % 5 WHEN 4 THEN to_base64(encode(text)) END AS image FROM documents""")
def q_attachments(spark, d):
    n = F.col("doc_id") % 5
    content = F.when(n == 2, F.unhex(F.lit("410042"))).when(n == 3, F.unhex(F.lit("FF41"))).otherwise(F.encode("text", "UTF-8"))
    listed = read(spark, d, "documents").select(
        F.concat("doc_id", F.when(n == 4, ".PNG").otherwise(".txt")).alias("path"), F.when(n == 1, 300_000).otherwise(F.octet_length(content)).cast("long").alias("size"), content.alias("content")
    )
    return office.attachments(listed).select(F.regexp_extract("path", r"\d+", 0).cast("long").alias("doc_id"), "reason", "text", F.regexp_replace("image.base64", "\r\n", "").alias("image"))


@query("""WITH e AS (SELECT source AS folder, doc_id || CASE WHEN doc_id % 3 = 0 THEN '/' ELSE '' END AS name FROM documents WHERE doc_id % 5 <> 0), r AS (SELECT *, row_number() OVER (PARTITION BY folder ORDER BY name) AS k FROM e)
SELECT f.folder, coalesce(t.text, '(dossier vide)') AS text FROM (SELECT DISTINCT source AS folder FROM documents) f LEFT JOIN (SELECT folder, string_agg(name, chr(10) ORDER BY k) FILTER (k <= 300) ||
  CASE WHEN count(*) > 300 THEN chr(10) || '[… ' || (count(*) - 300) || ' autres]' ELSE '' END AS text FROM r GROUP BY folder) t ON f.folder = t.folder""")
def q_list_dir(spark, d):
    name = F.concat(F.when(F.col("doc_id") % 5 == 0, ".").otherwise(""), F.col("doc_id").cast("string"))
    return office.listings(read(spark, d, "documents").select(F.col("source").alias("folder"), name.alias("name"), (F.col("doc_id") % 3 == 0).alias("is_folder")))


@query(r"""WITH p AS (SELECT page_id, list_filter(string_split(regexp_extract(url, '^[a-z]+://[^/]+/([^?#]*)', 1), '/'), lambda x: x <> '') AS parts FROM pages),
f AS (SELECT page_id, parts || [CASE WHEN page_id % 3 = 0 THEN 'note.md' ELSE 'data.log' END] AS parts FROM p),
i AS (SELECT page_id, parts, len(list_filter(range(1, len(parts) + 1), lambda k: CASE WHEN parts[k] = 'note.md' AND k = 3 AND parts[1] = 'es' THEN true WHEN ends_with(parts[k], '25') THEN false
  WHEN regexp_matches(parts[k], '[0-4]$') THEN true WHEN k < len(parts) AND parts[k] = 'fr' THEN true ELSE false END)) > 0 AS ignored FROM f)
SELECT page_id, ignored, NOT ignored AND parts[len(parts)] = 'note.md' AS accepted FROM i""")
def q_ignore_rules(spark, d):
    """Files below the folders that the pages' URLs name."""
    folder = F.filter(F.split(F.regexp_extract("url", "^[a-z]+://[^/]+/([^?#]*)", 1), "/"), lambda x: x != "")
    path = F.array_join(F.array_append(folder, F.when(F.col("page_id") % 3 == 0, "note.md").otherwise("data.log")), "/")
    rules = ["# by name", "fr/", "*[0-4]", "!*25", "/es/?*/note.md", "[z-a]"]
    left_out = ignore.ignored(path, rules)
    return read(spark, d, "pages").select("page_id", left_out.alias("ignored"), (files.accepted(path, ["md"]) & ~left_out).alias("accepted"))


@query("""SELECT doc_id, CASE WHEN doc_id % 3 = 2 THEN 'unsupported' WHEN n_chars * 300 > CASE WHEN doc_id % 3 = 1 THEN 52428800 ELSE 2097152 END THEN 'too large' END AS reason FROM documents""")
def q_skip_reason(spark, d):
    path = F.get(F.array(F.lit("a.md"), F.lit("b.docx"), F.lit("c.bin")), (F.col("doc_id") % 3).cast("int"))
    return read(spark, d, "documents").select("doc_id", files.skip_reason(path, F.col("n_chars") * 300).alias("reason"))


@query("""SELECT doc_id, substr(regexp_replace(source || '_' || text, '[^A-Za-z0-9_-]', '_', 'g'), 1, 64) AS name, CASE WHEN length(text) > 200 THEN substr(text, 1, 200) || chr(10) || '[…]' ELSE text END AS cut FROM documents""")
def q_cut_and_name(spark, d):
    return read(spark, d, "documents").select("doc_id", C.exposed_name(F.col("source"), F.col("text")).alias("name"), C.truncated(F.col("text"), 200).alias("cut"))


@query("""SELECT doc_id, CASE WHEN b < 1024 THEN b || ' o' WHEN b < 1048576 THEN (b + 512) // 1024 || ' ko' ELSE '-' END AS size, replace(printf('%.4f', doc_id * 100 / 1000000.0), '.', ',') || ' €' AS cost
FROM (SELECT doc_id, CASE WHEN n_chars < 1024 THEN n_chars ELSE 10240 + n_chars END AS b FROM documents) WHERE b < 1048576""")
def q_sizes_and_costs(spark, d):
    b = F.when(F.col("n_chars") < 1024, F.col("n_chars")).otherwise(F.col("n_chars") + 10240)
    return read(spark, d, "documents").filter(b < 1048576).select("doc_id", C.format_bytes(b).alias("size"), C.format_cost(F.col("doc_id") * 100, "€", 4).alias("cost"))


# --- streams -----------------------------------------------------------------------------------------------------


@query("""WITH e AS (SELECT user_id AS request_id, event_id AS pos, event_type AS t, event_id % 5 AS n FROM events)
SELECT request_id, pos, CAST(0 AS INTEGER) AS item, CASE n WHEN 0 THEN 'text' WHEN 1 THEN 'tool' WHEN 2 THEN 'usage' WHEN 3 THEN 'error' ELSE 'done' END AS kind, CASE n WHEN 0 THEN t || t WHEN 3 THEN t END AS text,
  CASE n WHEN 1 THEN 'f' END AS call_name, CASE n WHEN 1 THEN t END AS arguments, CASE n WHEN 2 THEN pos END AS input_tokens FROM e""")
def q_chat_decode(spark, d):
    n, t, e = F.col("event_id") % 5, F.col("event_type"), F.col("event_id").cast("string")
    data = (
        F.when(n == 0, F.concat(F.lit('{"choices":[{"delta":{"content":"'), t, F.lit('"}},{"delta":{"content":"'), t, F.lit('"}}]}')))
        .when(n == 1, F.concat(F.lit('{"choices":[{"delta":{"tool_calls":[{"index":0,"id":"i","function":{"name":"f","arguments":"'), t, F.lit('"}}]}}]}')))
        .when(n == 2, F.concat(F.lit('{"choices":[],"usage":{"prompt_tokens":'), e, F.lit(',"completion_tokens":1}}')))
        .when(n == 3, F.concat(F.lit('{"error":{"message":"'), t, F.lit('"}}')))
        .otherwise(F.lit(" [DONE] "))
    )
    frames = read(spark, d, "events").select(F.col("user_id").alias("request_id"), F.col("event_id").alias("pos"), data.alias("data"))
    return streams.chat_items(frames).select("request_id", "pos", "item", "kind", "text", "call_name", "arguments", "input_tokens")


@query("""WITH e AS (SELECT user_id AS request_id, event_id AS pos, event_type AS t, event_id % 8 AS n FROM events)
SELECT request_id, pos, CASE n WHEN 0 THEN 'usage' WHEN 1 THEN 'text' WHEN 2 THEN 'tool' WHEN 3 THEN 'tool' WHEN 4 THEN 'usage' WHEN 5 THEN 'done' ELSE 'error' END AS kind, CASE n WHEN 1 THEN t WHEN 6 THEN t END AS text,
  CASE n WHEN 2 THEN 'f' END AS call_name, CASE n WHEN 2 THEN '' WHEN 3 THEN t END AS arguments, CASE n WHEN 0 THEN pos + 125 END AS input_tokens, CASE n WHEN 4 THEN pos END AS output_tokens FROM e WHERE n <> 7""")
def q_messages_decode(spark, d):
    n, t, e = F.col("event_id") % 8, F.col("event_type"), F.col("event_id").cast("string")
    data = (
        F.when(n == 0, F.concat(F.lit('{"type":"message_start","message":{"usage":{"input_tokens":'), e, F.lit(',"cache_creation_input_tokens":25,"cache_read_input_tokens":100}}}')))
        .when(n == 1, F.concat(F.lit('{"type":"content_block_delta","index":0,"delta":{"type":"text_delta","text":"'), t, F.lit('"}}')))
        .when(n == 2, F.lit('{"type":"content_block_start","index":1,"content_block":{"type":"tool_use","id":"i","name":"f"}}'))
        .when(n == 3, F.concat(F.lit('{"type":"content_block_delta","index":1,"delta":{"type":"input_json_delta","partial_json":"'), t, F.lit('"}}')))
        .when(n == 4, F.concat(F.lit('{"type":"message_delta","usage":{"output_tokens":'), e, F.lit("}}")))
        .when(n == 5, F.lit('{"type":"message_stop"}'))
        .when(n == 6, F.concat(F.lit('{"type":"error","error":{"message":"'), t, F.lit('"}}')))
        .otherwise(F.lit('{"type":"ping"}'))
    )
    frames = read(spark, d, "events").select(F.col("user_id").alias("request_id"), F.col("event_id").alias("pos"), data.alias("data"))
    return streams.message_items(frames).select("request_id", "pos", "kind", "text", "call_name", "arguments", "input_tokens", "output_tokens")


@query("""SELECT CAST(conv_id AS VARCHAR) AS stream_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS pos, role || chr(10) || 'é' || turn AS data FROM conversations""")
def q_sse_split(spark, d):
    """Every event is cut at each of its bytes: a chunk holds one byte."""
    event = F.encode(F.concat(F.lit("event: m\r\n: c\r\ndata: "), "role", F.lit("\r\ndata:é"), F.col("turn").cast("string"), F.lit("\r\n\r\n")), "UTF-8")
    cut = _turns(spark, d).select(F.col("conv_id").cast("string").alias("stream_id"), "turn", event.alias("raw")).select(
        "stream_id", "turn", "raw", F.explode(F.sequence(F.lit(1), F.octet_length("raw"))).alias("k")
    )
    return streams.sse(cut.select("stream_id", (F.col("turn") * 10_000 + F.col("k")).alias("chunk_seq"), F.expr("substring(raw, k, 1)").alias("bytes")))


@query("""WITH e AS (SELECT user_id AS request_id, event_id AS pos, CASE event_type WHEN 'view' THEN 'phase' WHEN 'click' THEN 'text' ELSE event_type END AS kind FROM events),
f AS (SELECT *, min(CASE WHEN kind = 'text' THEN pos END) OVER (PARTITION BY request_id) AS first FROM e) SELECT request_id, pos, kind FROM f WHERE kind <> 'phase' OR first IS NULL OR pos < first""")
def q_phases(spark, d):
    kind = F.when(F.col("event_type") == "view", "phase").when(F.col("event_type") == "click", "text").otherwise(F.col("event_type"))
    return streams.phases_shown(read(spark, d, "events").select(F.col("user_id").alias("request_id"), F.col("event_id").alias("pos"), kind.alias("kind")))


@query("""WITH r AS (SELECT user_id AS request_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS round FROM events) SELECT request_id, CAST(round AS INTEGER) AS round, CASE WHEN round = 8 THEN 'error' ELSE 'tools' END AS kind FROM r WHERE round <= 8""")
def q_rounds(spark, d):
    rounds = read(spark, d, "events").selectExpr("user_id AS request_id", "row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS round")
    return streams.limited_rounds(rounds)


@query("""WITH e AS (SELECT user_id AS request_id, (event_id * 7919) % 5000 AS at_ms FROM events), l AS (SELECT *, max(at_ms) OVER (PARTITION BY request_id) AS last FROM e),
s AS (SELECT request_id, last, at_ms // 500 AS slot, min(at_ms) AS at_ms FROM l GROUP BY ALL)
SELECT request_id, min(at_ms) AS first_ms, count(*) + max(CASE WHEN at_ms < last AND slot = last // 500 THEN 1 ELSE 0 END) AS n FROM s GROUP BY request_id""")
def q_timings(spark, d):
    return streams.timings(read(spark, d, "events").select(F.col("user_id").alias("request_id"), (F.col("event_id") * 7919 % 5000).alias("at_ms")))


@query(_split(400))
def q_passages_packed(spark, d):
    """Passages whose blocks meet the limit exactly; tests compare them with a plain version."""
    return passages.split(_corpus(spark, d), 100)
