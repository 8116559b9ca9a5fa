"""Registered queries: line structure, chunking, OCR and evidence text."""

from __future__ import annotations

from pyspark.sql import functions as F

from evidar.catalog.common import document_chunks, norm, tables, tokens, trim
from evidar.catalog.retrieval import plain_questions
from evidar.catalog.text import COMPARABLE
from evidar.config import Config
from evidar.functions import structure as S
from evidar.operators import evidence, index, lexical, ocr
from evidar.operators.ranking import top_k

QUERIES: dict = {}
ORACLES: dict[str, str] = {}

HAN_DIGITS = "[一二三四五六七八九十]+"


def line_class(x: str) -> str:
    v = trim(x)
    word = "(^|[^A-Za-z0-9_])(const|let|var|function|class|import|def|return)($|[^A-Za-z0-9_])"
    return f"""CASE WHEN {v} = '' THEN 'blank'
      WHEN regexp_matches({x}, '^```|^(?: {{2,}}|\\t)') OR regexp_matches({x}, '{word}') THEN 'code'
      WHEN regexp_matches({v}, '^\\|.*\\|$') OR regexp_matches({x}, '[^\\s\\p{{Z}}][\\s\\p{{Z}}]{{3,}}[^\\s\\p{{Z}}]') THEN 'table'
      WHEN regexp_matches({v}, '^(?:[-*•·▪◦]|\\d+[.)]|{HAN_DIGITS}[、.])') THEN 'list'
      WHEN regexp_matches({v}, '(?i)^.{{1,48}}(?:是指|定义为|定义：|定义:| means | refers to )') THEN 'definition'
      WHEN length({v}) <= 90 AND (regexp_matches({v}, '^#{{1,6}}\\s+')
        OR regexp_matches({v}, '^(?:\\d+(?:\\.\\d+)*|{HAN_DIGITS})[、.)]\\s*[^\\s\\p{{Z}}]+')
        OR (regexp_matches({v}, '^[A-Z0-9][A-Z0-9 &:/_-]{{3,}}$') AND regexp_matches({v}, '[A-Z]'))) THEN 'heading'
      ELSE 'prose' END"""


def units_sql(name: str, source: str, key: str) -> str:
    """Gaps and islands over the lines of ``source(key, text)``; result ``{name}(key, pos, type, text)``."""
    return f"""
{name}_l AS (SELECT {key}, generate_subscripts(lines, 1) AS i, unnest(lines) AS line
  FROM (SELECT {key}, string_split({norm('text')}, chr(10)) AS lines FROM {source})),
{name}_k AS (SELECT *, {line_class('line')} AS kind FROM {name}_l),
{name}_b AS (SELECT *, CASE WHEN kind IN ('blank', 'heading') OR kind IS DISTINCT FROM lag(kind) OVER w THEN 1 ELSE 0 END AS start
  FROM {name}_k WINDOW w AS (PARTITION BY {key} ORDER BY i)),
{name}_r AS (SELECT *, sum(start) OVER (PARTITION BY {key} ORDER BY i) AS run FROM {name}_b),
{name}_u AS (SELECT {key}, run, any_value(kind) AS type, {norm("string_agg(line, chr(10) ORDER BY i)")} AS text FROM {name}_r GROUP BY {key}, run),
{name}_n AS (SELECT {key}, run, type, text FROM {name}_u WHERE type <> 'blank' AND text <> ''
  UNION ALL SELECT {key}, 0, 'prose', {norm('text')} FROM {source} s WHERE NOT EXISTS (
    SELECT 1 FROM {name}_u u WHERE u.{key} = s.{key} AND u.type <> 'blank' AND u.text <> '')),
{name} AS (SELECT {key}, row_number() OVER (PARTITION BY {key} ORDER BY run) AS pos, type, text FROM {name}_n)
"""


def classify_lines(t):
    lines = t("documents").select("doc_id", F.explode(F.split("text", "\n")).alias("line"))
    return lines.groupBy("doc_id", S.classify_line("line").alias("kind")).agg(F.count(F.lit(1)).alias("n"))


QUERIES["classify_lines"] = tables(classify_lines)
ORACLES["classify_lines"] = f"""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents)
SELECT doc_id, {line_class('line')} AS kind, count(*) AS n FROM l GROUP BY ALL
"""


def _sections(t):
    return t("documents").select(
        F.col("doc_id"), F.col("doc_id").cast("string").alias("section_id"), F.lit(1).alias("section_pos"),
        F.lit("start").alias("title"), "text")


def segment_runs(t):
    units = index.segments(_sections(t))
    return units.select("section_id", F.col("unit_pos").cast("bigint").alias("unit_pos"), "type", F.md5("text").alias("digest"))


QUERIES["segment_runs"] = tables(segment_runs)
ORACLES["segment_runs"] = f"""
WITH {units_sql('u', 'documents', 'doc_id')}
SELECT doc_id::VARCHAR AS section_id, pos - 1 AS unit_pos, type, md5(text) AS digest FROM u
"""


def chunk_sections(t):
    chunks = index.chunk_sections(_sections(t))
    return chunks.select("doc_id", F.col("piece_pos").cast("bigint").alias("piece_pos"), "content_type",
                         F.array_join("structure_types", ",").alias("structure_types"),
                         F.md5("title").alias("title"), F.md5("text").alias("digest"))


QUERIES["chunk_sections"] = tables(chunk_sections)
ORACLES["chunk_sections"] = f"""
WITH RECURSIVE {units_sql('u', 'documents', 'doc_id')},
whole AS (SELECT doc_id, {norm('text')} AS text FROM documents),
pack(doc_id, pos, title, held, f_title, f_text, s_title, s_type, s_text) AS (
  SELECT doc_id, 0::BIGINT, 'start', '', NULL::VARCHAR, NULL::VARCHAR, NULL::VARCHAR, NULL::VARCHAR, NULL::VARCHAR FROM whole WHERE length(text) > 1200
  UNION ALL
  SELECT p.doc_id, u.pos, CASE WHEN u.type = 'heading' THEN u.text ELSE p.title END,
    CASE WHEN u.type = 'heading' THEN u.text WHEN u.type <> 'prose' THEN '' WHEN p.held = '' THEN u.text
         WHEN length(p.held) + 1 + length(u.text) > 1200 THEN u.text ELSE p.held || chr(10) || u.text END,
    CASE WHEN p.held <> '' AND (u.type <> 'prose' OR length(p.held) + 1 + length(u.text) > 1200) THEN p.title END,
    CASE WHEN p.held <> '' AND (u.type <> 'prose' OR length(p.held) + 1 + length(u.text) > 1200) THEN p.held END,
    p.title, CASE WHEN u.type NOT IN ('prose', 'heading') THEN u.type END, CASE WHEN u.type NOT IN ('prose', 'heading') THEN u.text END
  FROM pack p JOIN u ON u.doc_id = p.doc_id AND u.pos = p.pos + 1),
lastp AS (SELECT doc_id, max(pos) AS pos FROM pack GROUP BY doc_id),
seg AS (SELECT doc_id, pos, 1 AS sub, f_title AS title, 'prose' AS type, f_text AS text FROM pack WHERE f_text IS NOT NULL
  UNION ALL SELECT doc_id, pos, 2, s_title, s_type, s_text FROM pack WHERE s_text IS NOT NULL
  UNION ALL SELECT doc_id, pos + 1, 1, title, 'prose', held FROM pack JOIN lastp USING (doc_id, pos) WHERE held <> ''),
tgt AS (SELECT *, length(text) AS n, CASE type WHEN 'definition' THEN 760 WHEN 'code' THEN 900 WHEN 'table' THEN 1000 WHEN 'list' THEN 1000 ELSE 1200 END AS target FROM seg),
cut(doc_id, pos, sub, title, type, text, n, target, start_at, end_at) AS (
  SELECT doc_id, pos, sub, title, type, text, n, target, -1::BIGINT, 0::BIGINT FROM tgt
  UNION ALL
  SELECT doc_id, pos, sub, title, type, text, n, target, start_at,
    CASE WHEN ideal >= n THEN n WHEN upto > 0 THEN low + upto ELSE ideal END
  FROM (SELECT *, length(regexp_extract(substr(text, low + 1, ideal - low + 1), '(?s)^(.*[。！？.!?；;\\n])', 1)) AS upto
    FROM (SELECT *, greatest(start_at + 320, ideal - 240) AS low
      FROM (SELECT *, least(n, start_at + target) AS ideal
        FROM (SELECT doc_id, pos, sub, title, type, text, n, target, CASE WHEN start_at < 0 THEN 0 ELSE greatest(start_at + 1, end_at - 160) END AS start_at
              FROM cut WHERE end_at < n) a) b) c) d),
long_piece AS (SELECT doc_id, pos, sub, start_at, title, type, {norm('substr(text, start_at + 1, end_at - start_at)')} AS text FROM cut WHERE start_at >= 0),
piece AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY pos, sub, start_at) - 1 AS piece_pos, title, type, text FROM long_piece WHERE text <> ''
  UNION ALL SELECT doc_id, 0, 'start', NULL, text FROM whole WHERE length(text) <= 1200),
keyed AS (SELECT *, doc_id * 100000 + piece_pos AS pid FROM piece),
{units_sql('v', 'keyed', 'pid')},
kinds AS (SELECT pid, type, min(pos) AS pos FROM v WHERE type <> 'heading' GROUP BY ALL),
agg AS (SELECT pid, string_agg(type, ',' ORDER BY pos) AS structure_types,
   arg_max(type, CASE type WHEN 'list' THEN 1 WHEN 'definition' THEN 2 WHEN 'table' THEN 3 WHEN 'code' THEN 4 ELSE 0 END) AS dominant FROM kinds GROUP BY pid)
SELECT doc_id, piece_pos, coalesce(keyed.type, dominant, 'prose') AS content_type, coalesce(structure_types, '') AS structure_types,
  md5(title) AS title, md5(text) AS digest FROM keyed LEFT JOIN agg USING (pid)
"""


def _turn_nodes(t):
    return t("conversations").select(
        F.col("conv_id").cast("string").alias("doc_id"), F.lit("talk").alias("file_name"), F.col("turn").alias("node_seq"),
        F.when(F.col("role") == "system", "note").when(F.col("conv_id") % 2 == 0, "page").otherwise("slide").alias("type"),
        F.col("turn").cast("int").alias("number"), "text", F.lit(None).cast("string").alias("text_origin"),
        F.lit(None).cast("double").alias("ocr_confidence"))


def extract_sections(t):
    out = index.extract_sections(_turn_nodes(t))
    return out.select("doc_id", "section_id", "label", "number", "text_origin", F.md5("title").alias("title"), F.md5("text").alias("digest"))


SECTIONS_SQL = f"""
nodes AS (SELECT conv_id::VARCHAR AS doc_id, turn, CASE WHEN role = 'system' THEN 'note' WHEN conv_id % 2 = 0 THEN 'page' ELSE 'slide' END AS type, {norm('text')} AS text FROM conversations),
src AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY turn) AS position FROM nodes n
  WHERE type IN ('page', 'slide') OR NOT EXISTS (SELECT 1 FROM nodes m WHERE m.doc_id = n.doc_id AND m.type IN ('page', 'slide'))),
sections AS (SELECT doc_id, turn, CASE WHEN type = 'note' THEN 'section' ELSE type END AS kind,
  CASE WHEN type = 'note' OR turn = 0 THEN position ELSE turn END::INTEGER AS number, text FROM src WHERE text <> ''),
labelled AS (SELECT *, CASE kind WHEN 'slide' THEN '幻灯片 ' || number WHEN 'page' THEN '第 ' || number || ' 页' ELSE '内容片段 ' || number END AS label FROM sections)
"""
QUERIES["extract_sections"] = tables(extract_sections)
ORACLES["extract_sections"] = f"""
WITH {SECTIONS_SQL}
SELECT doc_id, kind || '-' || number AS section_id, label, number, 'native' AS text_origin,
  md5(coalesce(list_filter(list_transform(string_split(text, chr(10)), lambda x: {trim('x')}),
    lambda x: length(x) BETWEEN 2 AND 100 AND NOT regexp_matches(x, '^[•·▪◦*-]'))[1], label)) AS title, md5(text) AS digest FROM labelled
"""


def section_budget(t):
    sections = index.extract_sections(_turn_nodes(t))
    small = Config(max_sections=5, max_chars=900, max_chunks=6)
    return index.budget_sections(sections, small).select(
        "doc_id", F.col("section_pos").cast("bigint").alias("section_pos"), F.length("text").cast("bigint").alias("n_chars"), F.md5("text").alias("digest"))


QUERIES["section_budget"] = tables(section_budget)
ORACLES["section_budget"] = f"""
WITH {SECTIONS_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY turn) AS section_pos FROM sections QUALIFY section_pos <= 5),
b AS (SELECT *, 900 - coalesce(sum(length(text)) OVER (PARTITION BY doc_id ORDER BY section_pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS room FROM r)
SELECT doc_id, section_pos, least(length(text), room)::BIGINT AS n_chars, md5(left(text, room::BIGINT)) AS digest FROM b WHERE room > 0
"""


def build_documents(t):
    sections = index.extract_sections(_turn_nodes(t))
    _, headers = index.apply_budgets(sections, Config(max_sections=6, max_chars=5_000, max_chunks=5))
    return headers


QUERIES["apply_budgets"] = tables(build_documents)


def running_budget(t):
    sized = t("conversations").select("conv_id", "turn", F.length("text").alias("n_chars"))
    return index.running_budget(sized, ["conv_id"], "turn", "n_chars", 2_000).select(
        "conv_id", "turn", F.col("used_before").cast("bigint"), F.col("allowed").cast("bigint"))


QUERIES["running_budget"] = tables(running_budget)
ORACLES["running_budget"] = """
WITH x AS (SELECT conv_id, turn, length(text) AS n, coalesce(sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn
  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS used FROM conversations)
SELECT conv_id, turn, used AS used_before, greatest(least(n, 2000 - used), 0)::BIGINT AS allowed FROM x
"""


def assemble_lines(t):
    items = t("lineitem").select(
        F.col("l_orderkey").alias("doc_id"), F.col("l_linestatus").alias("page"), F.col("l_linenumber").alias("item_seq"),
        F.concat(F.lit("  "), F.col("l_partkey").cast("string"), F.lit("\t "), F.col("l_returnflag")).alias("str"),
        F.col("l_quantity").alias("x"), (F.col("l_extendedprice") % 30).alias("y"))
    return index.assemble_lines(items)


QUERIES["assemble_lines"] = tables(assemble_lines)
ORACLES["assemble_lines"] = """
WITH i AS (SELECT l_orderkey AS doc_id, l_linestatus AS page, l_linenumber, l_partkey || ' ' || l_returnflag AS str, l_quantity AS x,
  (floor((l_extendedprice % 30) / 3 + 0.5) * 3)::BIGINT AS line_y FROM lineitem),
l AS (SELECT doc_id, page, line_y, string_agg(str, ' ' ORDER BY x, l_linenumber, str) AS line FROM i GROUP BY ALL)
SELECT doc_id, page, string_agg(line, chr(10) ORDER BY line_y DESC) AS text, count(*) AS n_lines FROM l GROUP BY ALL
"""


def flatten_nodes(t):
    turns = t("conversations")
    top = turns.select("conv_id").distinct().select(
        F.col("conv_id").alias("doc_id"), F.lit("top").alias("node_id"), F.lit(None).cast("string").alias("parent_id"),
        F.lit(0).cast("bigint").alias("node_seq"), F.lit(0).alias("level"), F.lit("  ").alias("text"))
    mid = turns.select("conv_id", "role").distinct().select(
        F.col("conv_id").alias("doc_id"), F.col("role").alias("node_id"), F.lit("top").alias("parent_id"),
        F.when(F.col("role") == "system", 0).when(F.col("role") == "user", 1).otherwise(2).cast("bigint").alias("node_seq"),
        F.lit(1).alias("level"), F.when(F.col("role") == "system", "system part").alias("text"))
    leaf = turns.select(
        F.col("conv_id").alias("doc_id"), F.concat(F.lit("t"), F.col("turn").cast("string")).alias("node_id"),
        F.col("role").alias("parent_id"), F.col("turn").alias("node_seq"), F.lit(2).alias("level"), "text")
    flat = index.flatten_nodes(top.unionByName(mid).unionByName(leaf), 2)
    return flat.select("doc_id", F.md5("text").alias("digest"))


QUERIES["flatten_nodes"] = tables(flatten_nodes)
ORACLES["flatten_nodes"] = f"""
WITH leaf AS (SELECT conv_id, role, turn, {norm('text')} AS text FROM conversations),
mid AS (SELECT conv_id, role, string_agg(text, chr(10) ORDER BY turn) FILTER (text <> '') AS text FROM leaf GROUP BY ALL),
two AS (SELECT conv_id, role, CASE role WHEN 'system' THEN 'system part' ELSE {norm("text")} END AS text FROM mid),
one AS (SELECT conv_id, string_agg(text, chr(10) ORDER BY CASE role WHEN 'system' THEN 0 WHEN 'user' THEN 1 ELSE 2 END) AS text FROM two GROUP BY conv_id)
SELECT conv_id AS doc_id, md5({norm("text")}) AS digest FROM one
"""


# ---- OCR ---------------------------------------------------------------------
def merge_native_ocr(t):
    """Turn pairs: a user turn as native text, the answer with the user's lines mixed in as OCR text."""
    turns = t("conversations")
    asked = turns.filter("role = 'user'").select("conv_id", "turn", F.col("text").alias("native"))
    answered = turns.filter("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("answer"))
    pairs = asked.join(answered, ["conv_id", "turn"]).withColumn("ocr", F.concat_ws("\n", F.upper("native"), "answer", "answer"))
    merged = ocr.merge_native_ocr("native", "ocr")
    return pairs.select("conv_id", "turn", merged.alias("m")).select("conv_id", "turn", "m.origin", F.md5("m.text").alias("digest"))


QUERIES["merge_native_ocr"] = tables(merge_native_ocr)
# Line by line: what is known grows with every line that is taken.
ORACLES["merge_native_ocr"] = f"""
WITH RECURSIVE p AS (SELECT u.conv_id, u.turn, {norm('u.text')} AS a, {norm("upper(replace(u.text, 'ß', 'ss')) || chr(10) || a.text || chr(10) || a.text")} AS b
  FROM conversations u JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 WHERE u.role = 'user' AND a.role = 'assistant'),
l AS (SELECT *, list_filter(list_transform(string_split(a, chr(10)), lambda x: {COMPARABLE.format(x='x')}), lambda x: length(x) >= 4) AS known,
  list_filter(list_transform(string_split(b, chr(10)), lambda x: {trim('x')}), lambda x: x <> '') AS lines FROM p),
r AS (SELECT conv_id, turn, lines, 0 AS i, known, []::VARCHAR[] AS added FROM l
  UNION ALL
  SELECT conv_id, turn, lines, i + 1, CASE WHEN taken THEN list_append(known, key) ELSE known END, CASE WHEN taken THEN list_append(added, lines[i + 1]) ELSE added END
  FROM (SELECT *, key <> '' AND NOT list_contains(known, key) AND NOT (length(key) >= 8 AND len(list_filter(known, lambda k: contains(k, key) OR contains(key, k))) > 0) AS taken
    FROM (SELECT *, {COMPARABLE.format(x='lines[i + 1]')} AS key FROM r WHERE i < len(lines)) x) y),
d AS (SELECT conv_id, turn, added FROM r WHERE i = len(lines)),
o AS (SELECT l.*, added, contains({COMPARABLE.format(x='a')}, {COMPARABLE.format(x='b')}) AS covered FROM l JOIN d USING (conv_id, turn))
SELECT conv_id, turn, CASE WHEN a = '' THEN 'ocr' WHEN b <> '' AND NOT covered AND len(added) > 0 THEN 'mixed' ELSE 'native' END AS origin,
  md5(CASE WHEN a = '' THEN b WHEN b <> '' AND NOT covered AND len(added) > 0 THEN a || chr(10) || chr(10) || array_to_string(added, chr(10)) ELSE a END) AS digest FROM o
"""


def _ocr_pages(t):
    return t("events").select(
        F.floor(F.col("event_id") / 100).alias("doc_id"),
        F.element_at(F.array(F.lit("auto"), F.lit("force"), F.lit("none")), (F.floor(F.col("event_id") / 100) % 3 + 1).cast("int")).alias("mode"),
        (F.col("event_id") % 100 + 1).alias("number"), F.col("value").alias("confidence"), (F.col("event_id") % 1000).alias("duration_ms"),
        F.when(F.col("event_type") == "error", "failed").otherwise("success").alias("status"))


def ocr_summary(t):
    return ocr.ocr_summary(_ocr_pages(t)).withColumn("failed_page_numbers", F.array_join(F.transform("failed_page_numbers", lambda x: x.cast("string")), ","))


QUERIES["ocr_summary"] = tables(ocr_summary)
ORACLES["ocr_summary"] = """
SELECT event_id // 100 AS doc_id, count(*) AS total_pages, count(*) FILTER (event_type <> 'error') AS successful_pages,
  count(*) FILTER (event_type = 'error') AS failed_pages, round(avg(value) FILTER (event_type <> 'error'), 1) AS average_confidence,
  sum(event_id % 1000)::BIGINT AS duration_ms,
  coalesce(string_agg((event_id % 100 + 1)::VARCHAR, ',' ORDER BY event_id) FILTER (event_type = 'error'), '') AS failed_page_numbers
FROM events GROUP BY event_id // 100
"""


def ocr_failure_check(t):
    native = t("documents").select(F.col("doc_id"), "text")
    return ocr.ocr_failure_check(_ocr_pages(t), native).select("doc_id", "mode", "pages", "failed", "must_retry")


QUERIES["ocr_failure_check"] = tables(ocr_failure_check)
ORACLES["ocr_failure_check"] = f"""
WITH p AS (SELECT event_id // 100 AS doc_id, ['auto', 'force', 'none'][(event_id // 100) % 3 + 1] AS mode, count(*) AS pages, count(*) FILTER (event_type = 'error') AS failed FROM events GROUP BY ALL),
n AS (SELECT doc_id, bool_or(length({norm('text')}) >= 24 AND regexp_matches(text, '[A-Za-z0-9]')) AS meaningful FROM documents GROUP BY ALL)
SELECT p.*, CASE mode WHEN 'force' THEN failed = pages OR (failed > 0 AND (pages <= 10 OR failed / pages > 0.1))
  WHEN 'auto' THEN pages > 0 AND failed = pages AND NOT coalesce(meaningful, FALSE) ELSE FALSE END AS must_retry
FROM p LEFT JOIN n USING (doc_id)
"""


def auto_ocr_pages(t):
    pages = t("conversations").select(
        F.col("conv_id").alias("doc_id"), F.col("turn").alias("number"), "text",
        F.element_at(F.array(F.lit("auto"), F.lit("force"), F.lit("none")), (F.col("conv_id") % 3 + 1).cast("int")).alias("mode"))
    return ocr.auto_ocr_pages(pages).select("doc_id", "number", "mode")


QUERIES["auto_ocr_pages"] = tables(auto_ocr_pages)
ORACLES["auto_ocr_pages"] = """
SELECT * FROM (SELECT conv_id AS doc_id, turn AS number, ['auto', 'force', 'none'][conv_id % 3 + 1] AS mode FROM conversations
  WHERE length(text) < 48 OR conv_id % 3 = 1) WHERE mode <> 'none'
"""


# ---- chunk tables ------------------------------------------------------------
def document_stats(t):
    return index.document_stats(document_chunks(t, "source"))


QUERIES["document_stats"] = tables(document_stats)
ORACLES["document_stats"] = """
SELECT source AS collection_id, count(*) AS chunk_count, sum(length(text))::BIGINT AS character_count,
  count(DISTINCT doc_id % 120) AS indexed_page_count, 0::BIGINT AS visual_chunk_count FROM documents GROUP BY source
"""


def sanitize_chunks(t):
    out = index.sanitize_chunks(document_chunks(t, "source").withColumn("kind", F.col("file_name")))
    return out.select("collection_id", "chunk_id", "kind", "number", "title", F.md5("text").alias("digest"))


QUERIES["sanitize_chunks"] = tables(sanitize_chunks)
ORACLES["sanitize_chunks"] = f"""
WITH f AS (SELECT *, split_part(split_part(text, chr(10), 1), '.', 1) AS title FROM documents),
n AS (SELECT source, doc_id, title, {norm('text')} AS body FROM f)
SELECT source AS collection_id, doc_id::VARCHAR AS chunk_id, 'section' AS kind, (doc_id % 120 + 1)::INTEGER AS number, title, md5(body) AS digest
FROM n WHERE length(body) >= 12
"""


def union_visual(t):
    chunks = document_chunks(t, "source").select("collection_id", "chunk_id", "text", "content_type", "evidence_weight")
    analyses = t("labels").select(
        F.lit("labels").alias("collection_id"), F.lit("labels").alias("file_name"), F.lit("page").alias("kind"),
        (F.col("doc_id") % 120 + 1).cast("int").alias("number"), F.col("doc_id").cast("string").alias("visual_id"),
        F.lit("chart").alias("visual_kind"), F.concat(F.lit("Label "), F.col("doc_id").cast("string")).alias("title"),
        F.lit("quality").alias("summary"), F.array(F.col("quality").cast("string"), F.col("toxic").cast("string")).alias("observations"),
        F.array().cast("array<string>").alias("relationships"), (F.col("quality") * 0.5).alias("confidence"))
    return index.union_visual(chunks, analyses).select("collection_id", "chunk_id", "content_type", F.md5("text").alias("digest"), "evidence_weight")


QUERIES["union_visual"] = tables(union_visual)
ORACLES["union_visual"] = """
SELECT source AS collection_id, doc_id::VARCHAR AS chunk_id, CASE lang WHEN 'en' THEN 'prose' WHEN 'fr' THEN 'code' WHEN 'de' THEN 'table' ELSE 'list' END AS content_type,
  md5(text) AS digest, NULL::DOUBLE AS evidence_weight FROM documents
UNION ALL
SELECT 'labels', 'page-' || (doc_id % 120 + 1) || '-visual-' || doc_id, 'visual',
  md5('视觉证据类型：chart' || chr(10) || '标题：Label ' || doc_id || chr(10) || '摘要：quality' || chr(10) || '可见元素：' || chr(10) || '- ' || quality || chr(10) || '- ' || toxic),
  0.85 FROM labels
"""


# ---- evidence text -----------------------------------------------------------
def _phrase_hits(t):
    chunks = document_chunks(t)
    hits = lexical.phrase_hits(plain_questions(t), chunks, lexical.build_index(chunks)).join(
        chunks.select("chunk_id", "chunk_ordinal"), "chunk_id")
    return chunks, top_k(hits, ["query_id"], [F.col("chunk_ordinal")], 10).withColumn("score", 1.0 / F.col("rank"))


def create_sources(t):
    chunks, hits = _phrase_hits(t)
    out = evidence.create_sources(hits, plain_questions(t), chunks)
    return out.select("query_id", "source_id", "chunk_id", F.round("confidence", 4).alias("confidence"), F.md5("highlight").alias("highlight"), F.md5("excerpt").alias("excerpt"), F.round("score", 4).alias("score"))


SOURCE_HITS_SQL = f"""
p AS (SELECT item_id, text AS question, lower({norm('text')}) AS phrase, {tokens('text')} AS qtok FROM benchmark),
h AS (SELECT item_id, question, qtok, d.*, row_number() OVER (PARTITION BY item_id ORDER BY doc_id)::INTEGER AS rank FROM p, documents d WHERE contains(lower(d.text), phrase) QUALIFY rank <= 10)
"""
RELIABILITY_SQL = """CASE doc_id % 4 WHEN 1 THEN 0.5 + (n_chars % 101) / 100.0::DOUBLE * 0.45 WHEN 2 THEN 0.72 + (n_chars % 101) / 100.0::DOUBLE * 0.25 WHEN 3 THEN 0.72 ELSE 1.0 END::DOUBLE"""
QUERIES["create_sources"] = tables(create_sources)
ORACLES["create_sources"] = f"""
WITH {SOURCE_HITS_SQL},
s AS (SELECT *, generate_subscripts(ss, 1) AS i, unnest(ss) AS raw FROM (SELECT *, regexp_extract_all(text, '[^。！？.!?\\n]+[。！？.!?]?') AS ss FROM h)),
z AS (SELECT *, {trim('raw')} AS sentence, len(list_intersect(list_distinct({tokens('raw')}), list_distinct(qtok))) AS score FROM s),
best AS (SELECT item_id, doc_id, score, sentence FROM z WHERE length(sentence) >= 8
  QUALIFY row_number() OVER (PARTITION BY item_id, doc_id ORDER BY score DESC, length(sentence) DESC, i) = 1),
first AS (SELECT item_id, doc_id, sentence FROM z WHERE i = 1),
hl AS (SELECT h.*, left(CASE WHEN b.score > 0 THEN b.sentence WHEN f.sentence <> '' THEN f.sentence ELSE h.text END, 260) AS highlight
  FROM h LEFT JOIN best b USING (item_id, doc_id) LEFT JOIN first f USING (item_id, doc_id))
SELECT item_id AS query_id, rank AS source_id, doc_id::VARCHAR AS chunk_id, round({RELIABILITY_SQL}, 4) AS confidence, md5(highlight) AS highlight,
  md5(substr(text, greatest(0, instr(text, highlight) - 161) + 1, 560)) AS excerpt, round(1.0::DOUBLE / rank, 4) AS score FROM hl
"""


def grounding_context(t):
    chunks, hits = _phrase_hits(t)
    return evidence.grounding_context(hits, chunks).select("query_id", "evidence_count", F.md5("context").alias("digest"))


QUERIES["grounding_context"] = tables(grounding_context)
ORACLES["grounding_context"] = f"""
WITH {SOURCE_HITS_SQL}
SELECT item_id AS query_id, count(*) AS evidence_count, md5(string_agg('[来源' || rank || '｜' || source || '｜page ' || (doc_id % 120 + 1) || '｜标题：'
  || split_part(split_part(text, chr(10), 1), '.', 1) || '｜类型：' || CASE lang WHEN 'en' THEN 'prose' WHEN 'fr' THEN 'code' WHEN 'de' THEN 'table' ELSE 'list' END
  || '｜证据来源：' || CASE doc_id % 4 WHEN 1 THEN 'ocr' WHEN 2 THEN 'mixed' WHEN 3 THEN 'vision' ELSE 'native' END
  || '｜可靠度：' || printf('%.2f', {RELIABILITY_SQL}) || ']' || chr(10) || text, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY rank)) AS digest
FROM h GROUP BY item_id
"""
