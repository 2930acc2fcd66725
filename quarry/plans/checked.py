"""Queries for operators that only tests called so far, each with its SQL."""

from __future__ import annotations

import io
import struct
import zipfile
from collections.abc import Iterator
from xml.sax.saxutils import escape

import pandas as pd
from pyspark.sql import functions as F

from quarry import tables
from quarry.functions import columns as C
from quarry.operators import messages, retrieval
from quarry.plans.catalogue import _FUSED, _KEYWORD, _corpus, _questions, _turns, query, read
from quarry.sources import headers, office
from quarry.streaming import folds

# --- scalar functions ----------------------------------------------------------------------------------------------

_URL_PATH = r"regexp_extract(url, '^[a-z]+://[^/]+/([^?#]*)', 1)"


@query(rf"""WITH p AS (SELECT page_id, {_URL_PATH} || ['.md', '.PY', '/target/x.rs', '/.git/y.md', '.bin', '/node_modules', '/targets/z.txt'][CAST(page_id % 7 AS INTEGER) + 1] AS path FROM pages)
SELECT page_id, NOT regexp_matches(path, '(^|/)\.[^/]') AND NOT regexp_matches(path, '(^|/)(target|node_modules|__pycache__)(/|$)') AND regexp_matches(lower(path), '[^/]\.(md|py|rs|txt)$') AS relevant FROM p""")
def q_watch_relevant(spark, d):
    ends = F.array(*map(F.lit, [".md", ".PY", "/target/x.rs", "/.git/y.md", ".bin", "/node_modules", "/targets/z.txt"]))
    path = F.concat(F.regexp_extract("url", "^[a-z]+://[^/]+/([^?#]*)", 1), F.get(ends, (F.col("page_id") % 7).cast("int")))
    return read(spark, d, "pages").select("page_id", C.watch_relevant(path).alias("relevant"))


@query(r"""WITH u AS (SELECT page_id, CASE page_id % 5 WHEN 0 THEN url WHEN 1 THEN regexp_replace(url, '://[^/]+', '://LocalHost:8080') WHEN 2 THEN regexp_replace(url, '://[^/]+', '://127.0.0.1') WHEN 3 THEN regexp_replace(url, '://[^/]+', '://[::1]:1') ELSE regexp_replace(url, '://', '://localhost.') END AS url FROM pages)
SELECT page_id, regexp_matches(lower(url), '^[a-z]+://(localhost|127\.0\.0\.1|\[::1\]|0\.0\.0\.0)([:/?#]|$)') AS loopback FROM u""")
def q_loopback(spark, d):
    host = lambda x: F.regexp_replace("url", "://[^/]+", f"://{x}")
    shapes = F.array(F.col("url"), host("LocalHost:8080"), host("127.0.0.1"), host("[::1]:1"), F.regexp_replace("url", "://", "://localhost."))
    return read(spark, d, "pages").select("page_id", C.is_loopback(F.get(shapes, (F.col("page_id") % 5).cast("int"))).alias("loopback"))


@query("""SELECT doc_id, lang || ' › ' || source || CASE WHEN length(text) % 2 = 0 THEN ' L' || length(text) ELSE '' END AS several, source || CASE WHEN length(text) % 2 = 0 THEN ' L' || length(text) ELSE '' END AS single FROM documents""")
def q_collection_label(spark, d):
    place = F.when(F.length("text") % 2 == 0, F.concat(F.lit("L"), F.length("text").cast("string"))).otherwise("")
    label = C.label(F.col("source"), place)
    return read(spark, d, "documents").select("doc_id", C.collection_label(F.col("lang"), label, 2).alias("several"), C.collection_label(F.col("lang"), label, 1).alias("single"))


@query(r"""WITH l AS (SELECT doc_id, repeat(' ', doc_id % 3) || repeat('#', doc_id % 9) || CASE WHEN doc_id % 5 = 0 THEN '' ELSE ' ' END || regexp_extract(text, '^[ -~]*', 0) AS line FROM documents)
SELECT doc_id, CASE WHEN ok THEN length(regexp_extract(line, '^ *(#*)', 1)) END AS level, CASE WHEN ok THEN trim(regexp_extract(line, '^ *#* (.*)$', 1)) END AS title
FROM (SELECT *, regexp_matches(line, '^ *#{1,6} .*[^ ]') AS ok FROM l)""")
def q_markdown_heading(spark, d):
    first = F.regexp_extract("text", "^[ -~]*", 0)
    n = F.col("doc_id")
    line = F.concat(F.repeat(F.lit(" "), (n % 3).cast("int")), F.repeat(F.lit("#"), (n % 9).cast("int")), F.when(n % 5 == 0, "").otherwise(" "), first)
    heading = C.markdown_heading(line)
    return read(spark, d, "documents").select("doc_id", heading["level"].alias("level"), heading["title"].alias("title"))


@query("""SELECT conv_id, turn, array_to_string(CASE WHEN len(k) > 0 THEN k ELSE [1, 2, 3, 4] END, ',') AS kept FROM (SELECT conv_id, turn,
  list_filter([1, 2, 3, 4], lambda n: n = turn OR n = length(text) % 6) AS k FROM conversations)""")
def q_keep_cited(spark, d):
    text = F.concat("text", F.lit(" ["), "turn", F.lit("] and [n] and [ "), (F.length("text") % 6).cast("string"), F.lit(" ; 77]"))
    citations = F.transform(F.sequence(F.lit(1), F.lit(4)), lambda n: F.struct(n.cast("long").alias("number"), F.lit("p").alias("path")))
    kept = F.transform(C.keep_cited(citations, text), lambda c: c["number"].cast("string"))
    return _turns(spark, d).select("conv_id", "turn", F.array_join(kept, ",").alias("kept"))


@query(r"""WITH t AS (SELECT conv_id, turn, repeat('`', turn % 6) || text || chr(10) || repeat(' ', conv_id % 3) || repeat('`', conv_id % 7) || 'x  ' AS text FROM conversations),
f AS (SELECT *, repeat('`', CAST(greatest(2, list_max(list_transform(string_split(text, chr(10)), lambda x: length(regexp_extract(x, '^\s*(`*)', 1))))) + 1 AS INTEGER)) AS fence FROM t)
SELECT conv_id, turn, fence || chr(10) || rtrim(text) || chr(10) || fence AS fenced FROM f""")
def q_fenced(spark, d):
    tail = F.concat(F.repeat(F.lit(" "), (F.col("conv_id") % 3).cast("int")), F.repeat(F.lit("`"), (F.col("conv_id") % 7).cast("int")), F.lit("x  "))
    text = F.concat(F.repeat(F.lit("`"), (F.col("turn") % 6).cast("int")), "text", F.lit("\n"), tail)
    return _turns(spark, d).select("conv_id", "turn", C.fenced(text).alias("fenced"))


_KNOWN = ", ".join("'{}': '{}'".format(k, v.replace("'", "''")) for k, v in C.ENTITIES.items())
_DECODED = rf"""CASE WHEN name <> '' AND map_contains(known, name) THEN known[name] || substr(x, length(name) + 2)
  WHEN point IS NOT NULL AND point <= 1114111 AND NOT point BETWEEN 55296 AND 57343 THEN chr(CAST(point AS INTEGER)) || substr(x, length(name) + 2) ELSE '&' || x END"""


@query(rf"""WITH s AS (SELECT page_id, string_split(html || '&#' || page_id || ';&#x' || hex(page_id) || ';&euro;&#xD800;&' || page_id || ';', '&') AS a FROM pages),
p AS (SELECT page_id, generate_subscripts(a, 1) AS k, unnest(a) AS x FROM s),
n AS (SELECT *, CASE WHEN k > 1 THEN regexp_extract(x, '^([^;]{{1,10}});', 1) ELSE '' END AS name, MAP {{{_KNOWN}}} AS known FROM p),
v AS (SELECT *, coalesce(TRY_CAST('0x' || nullif(regexp_extract(name, '^#[xX]\+?([0-9a-fA-F]+)$', 1), '') AS BIGINT), TRY_CAST(nullif(regexp_extract(name, '^#\+?([0-9]+)$', 1), '') AS BIGINT)) AS point FROM n)
SELECT page_id, string_agg(CASE WHEN k = 1 THEN x ELSE {_DECODED} END, '' ORDER BY k) AS text FROM v GROUP BY page_id""")
def q_references(spark, d):
    """Named entities and numeric references of the pages, and of what their numbers give."""
    n = F.col("page_id")
    html = F.concat("html", F.lit("&#"), n, F.lit(";&#x"), F.hex(n), F.lit(";&euro;&#xD800;&"), n, F.lit(";"))
    return read(spark, d, "pages").filter(F.col("html").isNotNull()).select("page_id", C.decode_entities(html).alias("text"))


# --- conversations -------------------------------------------------------------------------------------------------


@query("""SELECT conv_id, turn, role, CASE WHEN length(text) % 3 = 0 THEN text || '!' ELSE text END AS text, turn * 2 AS created FROM conversations""")
def q_message_merge(spark, d):
    """Messages written once, and some of them again with another role and text: the first role stays, the last text counts."""
    turns = _turns(spark, d)
    once = turns.withColumn("op", F.col("turn") * 2).withColumn("created", F.col("turn") * 2)
    again = turns.filter(F.length("text") % 3 == 0).select("conv_id", "turn", F.lit("other").alias("role"), F.concat("text", F.lit("!")).alias("text"), (F.col("turn") * 2 + 1).alias("op"), F.lit(-1).cast("long").alias("created"))
    merged = messages.merge_log(once.unionByName(again), ["conv_id", "turn"], ["role", "created"], ["text"], "op")
    return merged.select("conv_id", "turn", "role", "text", "created")


# --- retrieval -----------------------------------------------------------------------------------------------------

_LIMITED = """cand AS (SELECT f.question_id, f.key, row_number() OVER (PARTITION BY f.question_id ORDER BY f.score DESC, f.key) AS place, d.source || '/' || d.doc_id || '.md' AS label,
  CAST(ceil(length(d.text) / 4.0) AS BIGINT) AS tokens, md5(d.text) AS digest FROM fused f JOIN documents d ON d.doc_id = f.key),
walk AS (SELECT DISTINCT question_id, CAST(0 AS BIGINT) AS place, CAST(3000 AS BIGINT) AS rest, CAST(0 AS BIGINT) AS number, CAST([] AS VARCHAR[]) AS seen, false AS ok, CAST(NULL AS BIGINT) AS key, '' AS label, CAST(0 AS BIGINT) AS tokens FROM cand
  UNION ALL SELECT question_id, place, CASE WHEN ok THEN rest - tokens ELSE rest END, CASE WHEN ok THEN number + 1 ELSE number END, CASE WHEN ok THEN list_append(seen, digest) ELSE seen END, ok, key, label, tokens
  FROM (SELECT c.question_id, c.place, w.rest, w.number, w.seen, c.key, c.label, c.tokens, c.digest, w.number < 5 AND c.tokens <= w.rest AND NOT list_contains(w.seen, c.digest) AS ok
    FROM walk w JOIN cand c ON c.question_id = w.question_id AND c.place = w.place + 1))"""


@query(f"WITH RECURSIVE {_FUSED}, {_LIMITED} SELECT question_id, number, key, label, tokens FROM walk WHERE ok")
def q_hybrid_documents(spark, d):
    """Both rankings, their fusion and the limits, over whole documents."""
    return retrieval.hybrid(_corpus(spark, d), _questions(spark, d))


@query(f"""WITH {_KEYWORD}, c AS (SELECT k.item_id, k.doc_id, k.place, list_distinct(list_filter(string_split_regex(lower(b.text), '\\s+'), lambda w: octet_length(encode(w)) > 2)) AS w,
  lower(d.text) AS t FROM kwr k JOIN documents d USING (doc_id) JOIN benchmark b ON k.item_id = b.item_id WHERE k.place < 10),
h AS (SELECT *, CASE WHEN doc_id % 7 <> 0 THEN len(list_filter(w, lambda x: contains(t, x))) END AS hits FROM c),
u AS (SELECT *, bool_and(hits IS NOT NULL) OVER (PARTITION BY item_id) AS usable FROM h)
SELECT item_id AS question_id, doc_id AS key, CAST(row_number() OVER (PARTITION BY item_id ORDER BY CASE WHEN usable THEN hits END DESC, place) - 1 AS INTEGER) AS new_place FROM u""")
def q_rerank_incomplete(spark, d):
    """A reranker that has no score for some texts: their questions keep their order."""
    corpus, asked = _corpus(spark, d), _questions(spark, d)
    found = tables.with_texts(retrieval.keyword(corpus, asked, 10), corpus.select("key", "text"))
    some = lambda rows: retrieval.word_scores(rows).filter("key % 7 <> 0")
    return retrieval.rerank(found, asked, some).select("question_id", "key", "new_place")


# --- files ---------------------------------------------------------------------------------------------------------

_PLAIN = "[^ -~À-ɏ]"


def _word_file(paragraphs: list[str], odt: bool) -> bytes:
    """A word-processor file with the paragraphs, every third one a heading."""
    if odt:
        body = "".join(f'<t:h t:outline-level="2">{escape(p)}</t:h>' if k % 3 == 0 else f"<t:p>{escape(p)}</t:p>" for k, p in enumerate(paragraphs))
        name, xml = "content.xml", f'<t:d xmlns:t="t">{body}</t:d>'
    else:
        style = '<w:pPr><w:pStyle w:val="Heading 2"/></w:pPr>'
        body = "".join(f"<w:p>{style if k % 3 == 0 else ''}<w:r><w:t>{escape(p)}</w:t></w:r></w:p>" for k, p in enumerate(paragraphs))
        name, xml = "word/document.xml", f'<w:d xmlns:w="w">{body}</w:d>'
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr(name, xml)
    return out.getvalue()


@query(rf"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS k FROM documents),
p AS (SELECT doc_id, k, trim(regexp_replace(line, '{_PLAIN}', ' ', 'g')) AS line FROM l)
SELECT doc_id, string_agg(CASE WHEN k % 3 = 0 THEN '## ' ELSE '' END || line || chr(10) || chr(10), '' ORDER BY k) AS text FROM p WHERE line <> '' GROUP BY doc_id""")
def q_office_text(spark, d):
    """Documents as word-processor files of both kinds, and the text that is read from them."""

    def packed(column: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for lists, odt in column:
            yield pd.Series([_word_file(list(p), bool(o)) for p, o in zip(lists, odt, strict=True)])

    lines = F.transform(F.split("text", "\n"), lambda x: F.regexp_replace(x, _PLAIN, " "))
    odt = F.col("doc_id") % 2 == 0
    content = F.pandas_udf(packed, "binary")(lines, odt)
    listed = read(spark, d, "documents").select(F.concat("doc_id", F.when(odt, ".odt").otherwise(".docx")).alias("path"), content.alias("content"))
    found = office.extract(listed).filter("reason IS NULL")
    return found.select(F.regexp_extract("path", r"^\d+", 0).cast("long").alias("doc_id"), "text")


@query("""SELECT p_partkey, 'arch' || p_size AS architecture, p_name AS name, CAST(p_size * 1024 AS BIGINT) AS context_length, CAST(p_size * (p_partkey + 1) * 2 AS BIGINT) AS parameters,
  ['F32', 'F16', 'Q4_K_M', 'BF16'][CAST(p_partkey % 4 AS INTEGER) + 1] AS quantization FROM part WHERE p_partkey % 5 <> 0""")
def q_model_headers(spark, d):
    """Headers made of the parts' names and sizes; every fifth is cut off and gives an error."""

    def text(x: str) -> bytes:
        return struct.pack("<Q", len(x.encode())) + x.encode()

    def header(key: int, name: str, size: int) -> bytes:
        arch = f"arch{size}"
        pairs = [
            text("general.architecture") + struct.pack("<I", 8) + text(arch),
            text("general.name") + struct.pack("<I", 8) + text(name),
            text("general.file_type") + struct.pack("<II", 4, (0, 1, 15, 32)[key % 4]),
            text(f"{arch}.context_length") + struct.pack("<II", 4, size * 1024),
        ]
        tensors = [text("t") + struct.pack("<IQQIQ", 2, size, key + 1, 0, 0)] * 2
        raw = b"GGUF" + struct.pack("<IQQ", 3, len(tensors), len(pairs)) + b"".join(pairs) + b"".join(tensors)
        return raw[:-1] if key % 5 == 0 else raw

    def packed(column: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for rows in column:
            yield pd.Series([header(int(k), n, int(s)) for k, n, s in zip(*rows, strict=True)])

    content = F.pandas_udf(packed, "binary")("p_partkey", "p_name", "p_size")
    found = headers.model_headers(read(spark, d, "part").select(F.col("p_partkey").cast("string").alias("path"), content.alias("content")))
    return found.filter("error IS NULL").select(F.col("path").cast("long").alias("p_partkey"), "architecture", "name", "context_length", "parameters", "quantization")


# --- streams -------------------------------------------------------------------------------------------------------

_KINDS = {"signup": "phase", "view": "text", "click": "tool", "purchase": "usage", "error": "done"}


def _items(spark, d):
    """Events as the items of a request for each user."""
    kind = F.create_map(*[F.lit(x) for pair in _KINDS.items() for x in pair])[F.col("event_type")]
    return read(spark, d, "events").select(
        F.col("user_id").alias("request_id"), F.col("event_id").alias("pos"), F.when(F.col("event_id") % 997 == 0, "error").otherwise(kind).alias("kind"),
        F.col("event_type").alias("text"), (F.col("event_id") * 7).alias("at_ms"), (F.col("event_id") % 3).cast("int").alias("call_index"),
        F.when(F.col("event_id") % 2 == 0, F.col("event_id").cast("string")).alias("call_id"), F.col("event_type").alias("call_name"), F.col("props").alias("arguments"),
        F.col("event_id").alias("input_tokens"), F.lit(None).cast("long").alias("output_tokens"),
    )


@query()
def q_reply(spark, d):
    """All that a reader of each reply is told; tests compare it with a fold by hand."""
    return folds.folded(_items(spark, d), folds.Reply)


@query("""WITH e AS (SELECT user_id AS request_id, event_id AS pos, CASE WHEN event_id % 997 = 0 THEN 'error' ELSE CASE event_type WHEN 'click' THEN 'tool' WHEN 'error' THEN 'done' ELSE 'other' END END AS kind, event_id % 3 AS i, event_id, event_type, props FROM events),
r AS (SELECT *, coalesce(sum(CASE WHEN kind = 'done' THEN 1 ELSE 0 END) OVER (PARTITION BY request_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS part FROM e),
s AS (SELECT request_id, part, count(*) FILTER (kind = 'tool') AS tools, max(CASE WHEN kind = 'done' THEN 1 ELSE 0 END) AS done, max(CASE WHEN kind = 'error' THEN 1 ELSE 0 END) AS broken FROM r GROUP BY ALL),
k AS (SELECT *, sum(CASE WHEN tools = 0 OR broken = 1 THEN 1 ELSE 0 END) OVER (PARTITION BY request_id ORDER BY part) AS stopped FROM s),
c AS (SELECT r.request_id, r.part, r.i, string_agg(CASE WHEN event_id % 2 = 0 THEN CAST(event_id AS VARCHAR) ELSE '' END, '' ORDER BY pos) AS id, string_agg(event_type, '' ORDER BY pos) AS name, string_agg(props, '' ORDER BY pos) AS args
  FROM r JOIN k ON k.request_id = r.request_id AND k.part = r.part AND k.stopped = 0 AND k.done = 1 WHERE r.kind = 'tool' GROUP BY ALL)
SELECT request_id, CAST(part AS INTEGER) AS round, CAST(i AS INTEGER) AS call_index, CASE WHEN id = '' THEN 'call_' || CAST(part AS INTEGER) || '_' || (row_number() OVER (PARTITION BY request_id, part ORDER BY i) - 1) ELSE id END AS call_id, name AS call_name, args AS arguments FROM c""")
def q_finished_calls(spark, d):
    """The calls of every round that was done, up to the request's end."""
    return folds.folded(_items(spark, d), folds.Calls)


@query("""WITH e AS (SELECT user_id AS request_id, event_id AS pos, CASE WHEN event_id % 997 = 0 THEN 'error' ELSE CASE event_type WHEN 'signup' THEN 'phase' WHEN 'view' THEN 'text' WHEN 'click' THEN 'tool' WHEN 'purchase' THEN 'usage' ELSE 'done' END END AS kind, event_type AS text FROM events),
w AS (SELECT *, min(pos) FILTER (kind = 'text') OVER (PARTITION BY request_id) AS spoken, min(pos) FILTER (kind IN ('done', 'error')) OVER (PARTITION BY request_id) AS ended FROM e)
SELECT request_id, kind, text, pos FROM w WHERE (ended IS NULL OR pos <= ended) AND NOT (kind = 'phase' AND spoken IS NOT NULL AND pos > spoken)""")
def q_phase_state(spark, d):
    """Items up to the request's end, without phases after the first token, by the state that a stream keeps."""
    return folds.folded(_items(spark, d), folds.Phases)
