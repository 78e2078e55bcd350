"""Catalogue: scalar functions, text, chunks, mentions, vectors, hybrid retrieval."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomgraph.functions import strings as st
from loomgraph.functions import text as tx
from loomgraph.graph import PropertyGraph, union_all
from loomgraph.operators import cells
from loomgraph.operators import chunks as ch
from loomgraph.operators import hybrid, maintenance, mentions, questions, ranking, setops, vectors
from loomgraph.plans.registry import checked
from loomgraph.session import settle, shared_dir
from loomgraph.sources.text import file_type, routing_error
from loomgraph.spec import EdgeSpec, GraphSpec, NodeSpec

# ---- scalar functions --------------------------------------------------------------------


@checked(
    "f3_coalesce",
    "SELECT page_id, coalesce(nullif(regexp_extract(url, 'page=([0-9]+)', 1), ''), CAST(page_id AS VARCHAR), '') AS label FROM pages",
)
def _f3(w):
    page = F.nullif(F.regexp_extract("url", "page=([0-9]+)", 1), F.lit(""))
    return w.t("pages").select("page_id", F.coalesce(page, F.col("page_id").cast("string"), F.lit("")).alias("label"))


@checked(
    "f4_case_buckets",
    """SELECT CASE WHEN o_totalprice > 400000 THEN 'large' WHEN o_totalprice > 200000 THEN 'medium' ELSE 'small' END AS bucket,
         count(*) AS cnt FROM orders GROUP BY 1""",
)
def _f4(w):
    total = F.col("o_totalprice")
    bucket = F.when(total > 400000, "large").when(total > 200000, "medium").otherwise("small")
    return w.t("orders").groupBy(bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("cnt"))


@checked(
    "f5_label_and_relation_names",
    """SELECT DISTINCT p_name, array_to_string(list_transform(string_split(p_name, ' '),
         lambda x: upper(x[1]) || lower(x[2:])), '') AS label, upper(replace(p_name, ' ', '_')) AS relation FROM part""",
)
def _f5(w):
    snake = F.regexp_replace("p_name", " ", "_")
    return w.t("part").select(
        "p_name", st.pascal_label(snake).alias("label"),
        st.relation_name(F.concat(snake, F.lit("_id"))).alias("relation"),
    ).distinct()


_WORD_ROWS = "(SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS word FROM conversations)"
_SINGULAR = """CASE WHEN ends_with({x}, 'ies') AND length({x}) > 4 THEN left({x}, length({x}) - 3) || 'y'
  WHEN ends_with({x}, 'es') AND length({x}) > 3 THEN left({x}, length({x}) - 2)
  WHEN ends_with({x}, 's') AND length({x}) > 2 THEN left({x}, length({x}) - 1) ELSE {x} END"""


def _words(w):
    found = F.regexp_extract_all(F.lower("text"), F.lit("([a-z]+)"), 1)
    return w.t("conversations").select(F.explode(found).alias("word")).distinct()


@checked("f6_singular", f"SELECT word, {_SINGULAR.format(x='word')} AS singular FROM {_WORD_ROWS} t")
def _f6(w):
    return _words(w).select("word", st.singular(F.col("word")).alias("singular"))


@checked(
    "f7_label_match",
    f"""WITH l AS (SELECT DISTINCT split_part(p_name, ' ', 2) AS label FROM part),
        t AS (SELECT DISTINCT upper(split_part(p_name, ' ', 2)) || s AS text FROM part, (VALUES (''), ('s'), ('es')) v(s))
        SELECT DISTINCT text, label FROM t JOIN l ON lower(label) = lower(text)
          OR lower(label) = {_SINGULAR.format(x='lower(text)')}
          OR {_SINGULAR.format(x='lower(label)')} = {_SINGULAR.format(x='lower(text)')}""",
)
def _f7(w):
    noun = F.substring_index("p_name", " ", -1)
    labels = w.t("part").select(noun.alias("label")).distinct()
    texts = labels.select(
        F.explode(F.array(*[F.concat(F.upper("label"), F.lit(s)) for s in ("", "s", "es")])).alias("text")
    ).distinct()
    return setops.match_labels(texts, labels)


_SYN = {"und": ["der", "die"], "the": ["and", "of"]}


def _syn_sql() -> str:
    expr = "text"
    for canonical, words in _SYN.items():
        for word in words:
            expr = f"regexp_replace({expr}, '{word}', '{canonical}', 'gi')"
    return f"SELECT conv_id, turn, {expr} AS text FROM conversations"


@checked("f8_synonyms", _syn_sql())
def _f8(w):
    return w.t("conversations").select("conv_id", "turn", st.synonyms(F.col("text"), _SYN).alias("text"))


@checked(
    "f9_language_test",
    """SELECT kind, count(*) AS cnt FROM (SELECT 'order' AS kind, '주문 #' || o_orderkey AS name FROM orders
         UNION ALL SELECT 'part', p_name FROM part) t WHERE regexp_matches(name, '[가-힣]') GROUP BY 1""",
)
def _f9(w):
    g = w.graph
    rows = union_all([g.nodes("Order").select(F.lit("order").alias("kind"), "name"),
                      g.nodes("Part").select(F.lit("part").alias("kind"), "name")])
    return rows.where(st.has_hangul(F.col("name"))).groupBy("kind").agg(F.count(F.lit(1)).alias("cnt"))


_STOP = ", ".join(f"'{s}'" for s in st.STOPWORDS_EN)
_STOP_KO = ", ".join(f"'{s}'" for s in st.STOPWORDS_KO)
_KEYWORDS = """list_filter(list_distinct(list_transform(regexp_extract_all({x}, '[\\p{{L}}\\p{{M}}\\p{{Nd}}\\p{{Pc}}]+'),
  lambda t: lower(t))), lambda t: length(t) > 1 AND NOT list_contains([%s], t))""" % _STOP


@checked("f10_keywords", f"SELECT doc_id, array_to_string(list_sort({_KEYWORDS.format(x='text')}), ' ') AS words FROM documents")
def _f10(w):
    return w.t("documents").select("doc_id", F.array_join(F.array_sort(st.keywords(F.col("text"))), " ").alias("words"))


@checked(
    "f2_to_float",
    """SELECT page_id, TRY_CAST(nullif(regexp_extract(url, 'page=([0-9]+)', 1), '') AS DOUBLE) AS page,
         TRY_CAST(url AS DOUBLE) AS broken FROM pages""",
)
def _f2(w):
    page = F.regexp_extract("url", "page=([0-9]+)", 1)
    return w.t("pages").select(
        "page_id", page.try_cast("double").alias("page"), F.col("url").try_cast("double").alias("broken")
    )


@checked("f11_preview", "SELECT doc_id, left(text, 200) AS p200, left(text, 3000) AS p3000 FROM documents")
def _f11(w):
    text = F.col("text")
    return w.t("documents").select("doc_id", st.preview(text, 200).alias("p200"), st.preview(text, 3000).alias("p3000"))


@checked(
    "f12_json_digest",
    """SELECT p_partkey, sha256('{"id":' || p_partkey || ',"name":"' || p_name || '"}') AS digest,
         left(sha256('{"id":' || p_partkey || ',"name":"' || p_name || '"}'), 16) AS short FROM part""",
)
def _f12(w):
    digest = st.json_digest(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"))
    return w.t("part").select("p_partkey", digest.alias("digest"), F.left(digest, F.lit(16)).alias("short"))


_PATH = "rtrim(regexp_extract(url, '^https?://[^/]+([^?#]*)', 1), '/')"


@checked(
    "f13_path_template",
    f"""SELECT page_id, CASE WHEN p = '' THEN '/' ELSE p END AS path FROM (SELECT page_id, array_to_string(
          list_transform(string_split({_PATH}, '/'), lambda s: CASE WHEN regexp_full_match(s, '[0-9]+') THEN '{{id}}'
          ELSE s END), '/') AS p FROM pages)""",
)
def _f13(w):
    path = F.regexp_extract("url", "^https?://[^/]+([^?#]*)", 1)
    return w.t("pages").select("page_id", st.path_template(path).alias("path"))


@checked(
    "f14_json_property",
    "SELECT event_id, CAST(regexp_extract(props, '\"k\": *([0-9]+)', 1) AS BIGINT) AS k FROM events",
)
def _f14(w):
    parsed = F.from_json("props", "map<string,string>")
    return w.t("events").select("event_id", parsed["k"].cast("long").alias("k"))


@checked(
    "f15_template_rendering",
    """SELECT event_id, '[' || event_type || '] user ' || user_id || ' ' || coalesce(CASE WHEN event_type = 'view' THEN 'seen' END, '')
         || '.' AS line FROM events""",
)
def _f15(w):
    values = {"type": F.col("event_type"), "user": F.col("user_id"), "note": F.when(F.col("event_type") == "view", "seen")}
    return w.t("events").select("event_id", st.render("[{type}] user {user} {note}.", values.get).alias("line"))


@checked(
    "f16_number_formatting",
    """SELECT o_orderkey, format('{:,}', CAST(round(o_totalprice * 100) AS BIGINT)) AS amount,
         year(o_orderdate) || '-' || lpad(CAST(month(o_orderdate) AS VARCHAR), 2, '0') AS period FROM orders""",
)
def _f16(w):
    return w.t("orders").select(
        "o_orderkey", st.grouped_number(F.round(F.col("o_totalprice") * 100).cast("long")).alias("amount"),
        F.concat(F.year("o_orderdate"), F.lit("-"), F.lpad(F.month("o_orderdate").cast("string"), 2, "0")).alias("period"),
    )


# ---- markup and routing ---------------------------------------------------------------------


def _sql_strip(x: str) -> str:
    return f"regexp_replace(regexp_replace({x}, '^\\s+', ''), '\\s+$', '')"


def _sql_html(x: str) -> str:
    text = f"regexp_replace(regexp_replace({x}, '{tx.HTML_ITEMS}', chr(1), 'g'), chr(1) || '+', chr(10), 'g')"
    for entity, char in tx.ENTITIES:
        text = f"replace({text}, '{entity}', '{char.replace(chr(39), chr(39) * 2)}')"
    return _sql_strip(f"regexp_replace({text}, '\\n{{3,}}', chr(10) || chr(10), 'g')")


def _sql_markdown(x: str) -> str:
    for pattern, replacement in tx.MARKDOWN_STEPS:
        new = "chr(10) || chr(10)" if "\n" in replacement else "'" + replacement.replace("$1", "\\1") + "'"
        x = f"regexp_replace({x}, '{pattern}', {new}, 'g')"
    return _sql_strip(x)


@checked(
    "t1_html_to_text",
    f"""SELECT page_id, {_sql_html('html')} AS text, {_sql_strip("regexp_replace(regexp_replace(html, '<[^>]+>', ' ', 'g'), '\\s+', ' ', 'g')")}
        AS flat FROM pages""",
)
def _t1(w):
    html = F.col("html")
    return w.t("pages").select("page_id", tx.html_text(html).alias("text"), tx.html_flat(html).alias("flat"))


@checked("t2_markdown_to_text", f"SELECT doc_id, {_sql_markdown('text')} AS text FROM documents")
def _t2(w):
    return w.t("documents").select("doc_id", tx.markdown_text(F.col("text")).alias("text"))


_FILENAME = """source || '/' || doc_id || CASE lang WHEN 'en' THEN '.txt' WHEN 'fr' THEN '.Markdown' WHEN 'de' THEN '.html'
  ELSE '.xyz' END"""


def _filename():
    lang = F.col("lang")
    ext = F.when(lang == "en", ".txt").when(lang == "fr", ".Markdown").when(lang == "de", ".html").otherwise(".xyz")
    return F.concat("source", F.lit("/"), F.col("doc_id").cast("string"), ext)


_KIND = "CASE lang WHEN 'en' THEN 'txt' WHEN 'fr' THEN 'md' WHEN 'de' THEN 'html' END"


@checked(
    "t3_type_routing",
    f"""SELECT {_FILENAME} AS filename, {_KIND} AS file_type, CASE WHEN lang NOT IN ('en', 'fr', 'de')
          THEN 'Unsupported file type: .xyz' END AS error FROM documents""",
)
def _t3(w):
    name = F.col("filename")
    return w.t("documents").select(_filename().alias("filename")).select(
        "filename", file_type(name).alias("file_type"), routing_error(name).alias("error")
    )


# ---- chunks -----------------------------------------------------------------------------------


def _sql_fixed(source: str, size: int, overlap: int, key: str = "doc_id") -> str:
    stride = size - overlap
    return f"""(SELECT {key}, i AS chunk_index, i * {stride} AS char_start, least(i * {stride} + {size}, length(body)) AS char_end,
      {_sql_strip(f"substr(body, i * {stride} + 1, {size})")} AS text
      FROM (SELECT {key}, body, CAST(unnest(range(CASE WHEN length(body) <= {size} THEN 1
        ELSE CAST(ceil((length(body) - {size}) / {stride}.0) AS BIGINT) + 1 END)) AS INT) AS i FROM {source} s
        WHERE {_sql_strip('body')} <> '') x
      WHERE {_sql_strip(f"substr(body, i * {stride} + 1, {size})")} <> '')"""


_DOC_BODIES = "(SELECT doc_id, text AS body FROM documents)"
_CHUNKS = _sql_fixed(_DOC_BODIES, 1000, 200)


@checked("t4_fixed_chunks", f"SELECT *, length(text) AS char_count FROM {_sql_fixed(_DOC_BODIES, 500, 100)} c")
def _t4(w):
    return ch.fixed_chunks(w.t("documents").select("doc_id", "text"), "text", 500, 100)


@checked("t5_sentence_chunks")
def _t5(w):
    return ch.chunk_documents(w.t("documents").select("doc_id", "text"), strategy="sentence", size=500, overlap=100)


@checked("t6_recursive_chunks")
def _t6(w):
    return ch.chunk_documents(w.t("documents").select("doc_id", "text"), strategy="recursive")


@checked("t7_merge_fold")
def _t7(w):
    """How the packed chunks of each document cover it."""
    rows = ch.chunk_documents(w.t("documents").select("doc_id", "text"), strategy="sentence", size=300, overlap=60)
    return rows.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("chunks"), F.sum("char_count").alias("chars"), F.max("char_end").alias("last_end")
    )


@checked("t8_page_chunks")
def _t8(w):
    pages = w.t("conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("page_num"), "text")
    return ch.chunk_pages(pages, strategy="recursive", size=400, overlap=80)


@checked(
    "t9_blank_chunks_dropped",
    f"""SELECT page_id, count(*) AS chunks, CAST(max(chunk_index) AS INT) AS last_index, CAST(sum(length(text)) AS BIGINT) AS chars
        FROM {_sql_fixed("(SELECT page_id, regexp_replace(html, '<[^>]+>', repeat(' ', 30), 'g') AS body FROM pages)", 25, 5, "page_id")} c
        GROUP BY 1""",
)
def _t9(w):
    """Tags blown up to blanks give many blank windows; the index keeps the raw position."""
    bodies = w.t("pages").select("page_id", F.regexp_replace("html", "<[^>]+>", " " * 30).alias("text"))
    return ch.fixed_chunks(bodies, "text", 25, 5).groupBy("page_id").agg(
        F.count(F.lit(1)).alias("chunks"), F.max("chunk_index").alias("last_index"), F.sum("char_count").alias("chars")
    )


_PARSED = f"""(SELECT doc_id, {_FILENAME} AS filename, {_KIND} AS file_type, CASE lang WHEN 'en' THEN {_sql_strip('text')}
  WHEN 'fr' THEN {_sql_markdown('text')} WHEN 'de' THEN {_sql_html('text')} END AS body FROM documents)"""


def _passages(w):
    """Dictionary of text entities: the passages of ``benchmark``."""
    return w.t("benchmark").select(F.col("text").alias("name"), F.lit("Passage").alias("label"), F.col("item_id").alias("id"))


def _ingested(w):
    docs = w.t("documents").select("doc_id", _filename().alias("filename"), F.col("text").alias("content"))
    return hybrid.ingest(docs, _passages(w), strategy="fixed")


@checked(
    "t10_document_pipeline",
    f"""WITH p AS (SELECT * FROM {_PARSED} x), c AS (SELECT doc_id, count(*) AS n FROM {_sql_fixed("(SELECT * FROM p WHERE body IS NOT NULL)", 1000, 200)} y GROUP BY 1)
        SELECT doc_id, filename, file_type, coalesce(n, 0) AS chunk_count,
          CASE WHEN file_type IS NULL THEN 'Unsupported file type: .xyz' WHEN coalesce(body, '') = '' THEN 'No text content extracted'
            WHEN n IS NULL THEN 'No chunks generated' END AS error,
          CASE WHEN n IS NULL THEN 'failed' ELSE 'ready' END AS status FROM p LEFT JOIN c USING (doc_id)""",
)
def _t10(w):
    return _ingested(w).documents.drop("tenant_id")


_MENTIONS = f"""(SELECT c.doc_id, c.chunk_index, b.text AS name, 'Passage' AS label, position(lower(b.text) IN lower(c.text)) - 1
  AS char_start, length(b.text) AS n FROM {_CHUNKS} c JOIN benchmark b ON contains(lower(c.text), lower(b.text)))"""


def _doc_chunks(w):
    return ch.fixed_chunks(w.t("documents").select("doc_id", "text"))


@checked(
    "t11_entity_mentions",
    f"""SELECT doc_id, chunk_index, name, label, 1.0::DOUBLE AS confidence, 'kg_match' AS source, char_start,
          char_start + n AS char_end, row_number() OVER (PARTITION BY doc_id, chunk_index ORDER BY char_start, label,
          n DESC, name) AS position FROM {_MENTIONS} m""",
)
def _t11(w):
    return mentions.mentions(_doc_chunks(w), ["doc_id", "chunk_index"], _passages(w))


_TERMS = "(SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z]{12,}')) AS name FROM benchmark)"


def _terms(w):
    """Long words of the passages, as a second dictionary."""
    found = F.regexp_extract_all(F.lower("text"), F.lit("([a-z]{12,})"), 1)
    return w.t("benchmark").select(F.explode(found).alias("name"), F.lit("Term").alias("label")).distinct()


_J22 = f"""SELECT doc_id, name, 'Term' AS label, CAST(position(name IN lower(text)) - 1 AS INT) AS char_start,
  CAST(position(name IN lower(text)) - 1 + length(name) AS INT) AS char_end FROM documents JOIN {_TERMS} t
  ON contains(lower(text), name)"""


@checked("j22_dictionary_join", _J22)
def _j22(w):
    return mentions.match_dictionary(w.t("documents"), ["doc_id"], "text", _terms(w))


@checked("j22_dictionary_join_large", _J22)
def _j22b(w):
    """The path for dictionaries too large to send to the tasks."""
    return mentions.match_dictionary(w.t("documents"), ["doc_id"], "text", _terms(w), max_rows=0)


@checked(
    "t12_link_documents",
    f"""SELECT 'Document' AS element, count(*) AS cnt FROM documents UNION ALL SELECT 'Chunk', count(*) FROM {_CHUNKS} c
        UNION ALL SELECT 'HAS_CHUNK', count(*) FROM {_CHUNKS} c UNION ALL SELECT 'MENTIONS', count(*) FROM
          (SELECT DISTINCT doc_id, chunk_index, name FROM {_MENTIONS} m)
        UNION ALL SELECT 'entities', count(*) FROM (SELECT DISTINCT doc_id, name FROM {_MENTIONS} m)""",
)
def _t12(w):
    pieces = _doc_chunks(w)
    found = mentions.mentions(pieces, ["doc_id", "chunk_index"], _passages(w))
    docs = w.t("documents").select("doc_id", _filename().alias("filename"), file_type(_filename()).alias("file_type"))
    parts = mentions.link_documents(docs, pieces, found)
    rows = [df.select(F.lit(name).alias("element"), F.lit(1).cast("long").alias("n")) for name, df in parts.items()]
    rows.append(mentions.entities_per_document(found).select(F.lit("entities").alias("element"), F.col("entities").alias("n")))
    return union_all(rows).groupBy("element").agg(F.sum("n").alias("cnt"))


# ---- questions ----------------------------------------------------------------------------------

_ASK = (
    ("What products did {c} order?", "customer"),
    ("{c}가 주문한 상품은?", "customer"),
    ("{c}의 주소는?", "customer"),
    ("{c} 주문의 배송 상태는?", "customer"),
    ("What categories of products ordered by {c}?", "customer"),
    ("만약 {s}가 중단되면 어떻게 되나?", "supplier"),
    ("{s}와 삼성전자 공급 상품 비교", "supplier"),
    ("Who ordered {p}", "part"),
    ("{p}를 주문한 고객은?", "part"),
    ("Top 5 best-selling categories near {p}", "part"),
    ("{p} 추천 이유와 전체 구조", "part"),
)
_ASK_SQL = "(" + " UNION ALL ".join(
    f"SELECT '{i}:' || {col} AS qid, replace(replace(replace('{text}', '{{c}}', {col}), '{{s}}', {col}), '{{p}}', {col}) AS question FROM "
    f"{'(SELECT DISTINCT p_name FROM part)' if table == 'part' else table} t"
    for i, (text, table) in enumerate(_ASK)
    for col in [{"customer": "c_name", "supplier": "s_name", "part": "p_name"}[table]]
) + " UNION ALL SELECT 'turn:' || conv_id || ':' || turn, text FROM conversations)"


def _questions(w):
    """Questions about every customer, supplier and part name, and every conversation turn."""
    col = {"customer": "c_name", "supplier": "s_name", "part": "p_name"}
    frames = []
    for i, (text, table) in enumerate(_ASK):
        name = w.t(table).select(F.col(col[table]).alias("n"))
        name = name.distinct() if table == "part" else name
        frames.append(name.select(F.concat(F.lit(f"{i}:"), "n").alias("qid"),
                                  st.render(text, lambda _: F.col("n")).alias("question")))
    turns = w.t("conversations").select(
        F.concat(F.lit("turn:"), "conv_id", F.lit(":"), "turn").alias("qid"), F.col("text").alias("question")
    )
    return union_all([*frames, turns])


@checked(
    "t13_question_entities",
    f"""WITH d AS (SELECT c_name AS name, 'Customer' AS label, 1 AS r FROM customer UNION ALL SELECT s_name, 'Supplier', 2
          FROM supplier UNION ALL SELECT DISTINCT p_name, 'Part', 3 FROM part)
        SELECT qid, name, label FROM {_ASK_SQL} q JOIN d ON contains(question, name)
        QUALIFY row_number() OVER (PARTITION BY qid ORDER BY r, length(name) DESC, name) = 1""",
)
def _t13(w):
    names = mentions.entity_dictionary(w.graph, ["Customer", "Supplier", "Part"])
    return mentions.question_entities(_questions(w), "qid", "question", names, ["Customer", "Supplier", "Part"])


@checked(
    "w4_longest_match",
    f"""SELECT doc_id, name, 'Term' AS label FROM documents JOIN {_TERMS} t ON contains(lower(text), name)
        QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY length(name) DESC, name) = 1""",
)
def _w4(w):
    hits = mentions.match_dictionary(w.t("documents"), ["doc_id"], "text", _terms(w))
    return ranking.longest_match(hits, "doc_id", F.lit(1))


def _rules_sql() -> str:
    cases, fields = [], {p: [] for p in tx.QUESTION_PARAMS}
    for template, pattern, params in tx.QUESTION_RULES:
        quoted = "(?i)" + pattern.replace("'", "''")
        test = f"regexp_matches(question, '{quoted}')"
        cases.append(f"WHEN {test} THEN '{template}'")
        for p in fields:
            groups = [f"nullif(regexp_extract(question, '{quoted}', {i}), '')" for i in params.get(p, ())]
            fields[p].append(f"WHEN {test} THEN " + (f"coalesce({', '.join(groups)})" if groups else "NULL"))
    agg = ", ".join(f"'{t}'" for t in tx.AGGREGATE_TEMPLATES)
    params = ", ".join(f"CASE {' '.join(f)} END AS {p}" for p, f in fields.items())
    return f"""SELECT qid, template, CASE WHEN template IS NULL THEN 'unsupported' WHEN template IN ({agg}) THEN 'cypher_agg'
      ELSE 'cypher_traverse' END AS route, name, other, target, "limit" FROM (SELECT qid, CASE {' '.join(cases)} END AS template,
      {params.replace('AS limit', 'AS "limit"')} FROM {_ASK_SQL} q)"""


@checked("t14_question_classification", _rules_sql())
def _t14(w):
    return questions.classify(_questions(w), "qid", "question")


def _any_sql(patterns) -> str:
    return "(" + " OR ".join(f"regexp_matches(question, '{p}')" for p in patterns) + ")"


@checked(
    "t15_intent_classification",
    "SELECT qid, CASE " + " ".join(f"WHEN {_any_sql(p)} THEN '{n}'" for n, p in tx.INTENT_PATTERNS.items())
    + f" ELSE 'lookup' END AS intent FROM {_ASK_SQL} q",
)
def _t15(w):
    return _questions(w).select("qid", tx.intent(F.col("question")).alias("intent"))


@checked(
    "t16_aggregate_and_depth",
    f"""SELECT qid, {_any_sql(tx.AGGREGATE_PATTERNS)} AS is_aggregate, CASE WHEN regexp_matches(question, '{tx.DEPTH_ONE}') THEN 1
          WHEN regexp_matches(question, '{tx.DEPTH_THREE}') THEN 3 ELSE 2 END AS depth FROM {_ASK_SQL} q""",
)
def _t16(w):
    question = F.col("question")
    return _questions(w).select("qid", tx.is_aggregate(question).alias("is_aggregate"), tx.depth(question).alias("depth"))


# ---- vectors -------------------------------------------------------------------------------------


def _sql_counts(source: str, key: str) -> str:
    return f"""(SELECT {key}, ('0x' || substr(md5(word), 1, 8))::BIGINT % 64 AS bucket, count(*) AS n FROM (SELECT {key},
      unnest(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{M}}\\p{{Nd}}_]+')) AS word FROM {source} s) w GROUP BY ALL)"""


def _sql_vectors(source: str, key: str) -> str:
    return f"""(SELECT {key}, bucket, n / sqrt(CAST(sum(n * n) OVER (PARTITION BY {key}) AS DOUBLE)) AS v
      FROM {_sql_counts(source, key)} c)"""


@checked(
    "t17_hashed_vectors",
    f"SELECT doc_id, bucket, round(v, 6) AS weight FROM {_sql_vectors('documents', 'doc_id')} v",
)
def _t17(w):
    rows = vectors.hashed_vectors(w.t("documents").select("doc_id", "text"), ["doc_id"], "text")
    parts = rows.select("doc_id", F.posexplode("embedding").alias("bucket", "v")).where("v <> 0")
    return parts.select("doc_id", F.col("bucket").cast("long").alias("bucket"), F.round("v", 6).alias("weight"))


def _exemplars(w):
    """One query vector per label: that of its smallest id."""
    return w.t("embeddings").groupBy(F.col("label").alias("query_id")).agg(
        F.min_by("embedding", "vec_id").alias("embedding")
    )


def _corpus(w):
    return w.t("embeddings").select(F.col("vec_id").alias("item_id"), "embedding")


_COSINE = """WITH e AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings),
  q AS (SELECT label AS query_id, arg_min(v, vec_id) AS v FROM e GROUP BY 1),
  s AS (SELECT query_id, vec_id AS item_id, round(list_cosine_similarity(q.v, e.v), 6) AS score FROM q, e),
  t AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item_id) AS rank FROM s QUALIFY rank <= 10)"""


@checked("v1_exact_cosine_topk", f"{_COSINE} SELECT query_id, item_id, score, rank FROM t")
def _v1(w):
    return vectors.cosine_topk(_exemplars(w), _corpus(w), 10)


@checked(
    "w2_per_query_top_k",
    f"{_COSINE} SELECT query_id, item_id, score, rank FROM t WHERE rank <= 3",
)
def _w2(w):
    return vectors.cosine_topk(_exemplars(w), _corpus(w), 3)


@checked("v2_threshold_after_limit", f"{_COSINE} SELECT query_id, item_id, score, rank FROM t WHERE score >= 0.4")
def _v2(w):
    return vectors.above(vectors.cosine_topk(_exemplars(w), _corpus(w), 10), 0.4)


@checked(
    "v3_zero_vector_guard",
    """SELECT vec_id FROM embeddings WHERE label <> 3""",
)
def _v3(w):
    """Vectors of one label are blanked out and must be refused."""
    blank = F.when(F.col("label") == 3, F.transform("embedding", lambda x: x * 0)).otherwise(F.col("embedding"))
    return vectors.nonzero(w.t("embeddings").select("vec_id", blank.alias("embedding"))).select("vec_id")


@checked(
    "v4_approximate_knn",
    """SELECT true AS recall_reached, 0::BIGINT AS wrong_scores, count(*) AS queries FROM (SELECT DISTINCT label FROM embeddings)""",
)
def _v4(w):
    """Whether nine tenths of the exact result are found, and how many scores differ from the exact ones."""
    queries, corpus = _exemplars(w), _corpus(w)
    exact = vectors.cosine_topk(queries, corpus, 10)
    near = settle(vectors.approx_topk(queries, corpus, 10, 64))
    share = vectors.recall(near, exact).select((F.col("recall") >= 0.9).alias("recall_reached"))
    both = near.join(exact.withColumnRenamed("score", "exact_score"), ["query_id", "item_id"])
    wrong = both.agg(F.count_if(F.col("score") != F.col("exact_score")).alias("wrong_scores"))
    asked = near.agg(F.count_distinct("query_id").alias("queries"))
    return share.join(wrong).join(asked)  # three frames of one row


@checked(
    "v4_learned_cells",
    """SELECT true AS recall_reached, 0::BIGINT AS wrong_scores, count(*) AS queries, true AS most_spared FROM documents
       WHERE doc_id % 100 = 0 AND regexp_matches(text, '[\\p{L}\\p{M}\\p{Nd}_]')""",
)
def _v4_cells(w):
    """Every hundredth document against all, by hashed vectors: recall, exact scores, and whether seven tenths are not met."""
    rows = vectors.hashed_vectors(w.t("documents").select(F.col("doc_id").alias("item_id"), "text"), ["item_id"], "text")
    corpus = settle(vectors.nonzero(rows).select("item_id", "embedding"))
    queries = corpus.where("item_id % 100 = 0").withColumnRenamed("item_id", "query_id")
    near, met = cells.CellIndex.build(corpus).calibrate(queries, corpus, 10).search(queries, 10)
    exact, near = settle(vectors.cosine_topk(queries, corpus, 10)), settle(near)
    share = vectors.recall(near, exact).select((F.col("recall") >= 0.9).alias("recall_reached"))
    both = near.join(exact.withColumnRenamed("score", "exact_score"), ["query_id", "item_id"])
    wrong = both.agg(F.count_if(F.col("score") != F.col("exact_score")).alias("wrong_scores"))
    asked = met.agg(F.count(F.lit(1)).alias("queries"), F.sum("met").alias("met"))
    total = corpus.agg(F.count(F.lit(1)).alias("n"))
    spared = asked.join(total).select("queries", (F.col("met") < 0.3 * F.col("n") * F.col("queries")).alias("most_spared"))
    return share.join(wrong).join(spared)  # frames of one row


@checked(
    "y3_pluggable_embedder",
    """SELECT doc_id, length(text)::DOUBLE AS chars, length(regexp_replace(text, '[^aeiou]', '', 'g'))::DOUBLE AS vowels,
         CASE WHEN contains(text, 'the') THEN 'ValueError: refused' END AS error FROM documents WHERE NOT contains(text, 'the')
       UNION ALL SELECT doc_id, NULL, NULL, 'ValueError: refused' FROM documents WHERE contains(text, 'the')""",
)
def _y3(w):
    """Vectors of a user's function that refuses some texts."""

    def counted(batch):
        if batch.str.contains("the", regex=False).any():
            raise ValueError("refused")
        return [[float(len(t)), float(sum(map(t.count, "aeiou")))] for t in batch]

    rows = vectors.embed_with(w.t("documents").select("doc_id", "text"), "text", counted)
    return rows.select(
        "doc_id", F.get("embedding", F.lit(0)).alias("chars"), F.get("embedding", F.lit(1)).alias("vowels"),
        F.col("embedding_error").alias("error"),
    )


@checked(
    "y4_chunk_table_function",
    f"SELECT doc_id, count(*) AS chunks, CAST(max(char_end) AS INT) AS last_end FROM {_CHUNKS} c GROUP BY 1",
)
def _y4(w):
    ch.register_chunker(w.spark)
    w.t("documents").select("doc_id", "text").createOrReplaceTempView("chunk_input")
    return w.spark.sql(
        """SELECT doc_id, count(*) AS chunks, max(char_end) AS last_end
           FROM chunk_input, LATERAL chunk_text(text, 'fixed', 1000, 200) GROUP BY doc_id"""
    )


# ---- retrieval --------------------------------------------------------------------------------------

# every language has a type here, and there are two tenants: documents by source, questions by number
_NAMED = "source || '/' || doc_id || CASE lang WHEN 'fr' THEN '.Markdown' WHEN 'de' THEN '.html' ELSE '.txt' END"
_OWNER = "'t' || coalesce(TRY_CAST(regexp_extract(source, '([0-9]+)$', 1) AS BIGINT), 0) % 2"
_BODIES = f"""(SELECT doc_id, {_NAMED} AS filename, {_OWNER} AS tenant, CASE lang WHEN 'fr' THEN {_sql_markdown('text')}
  WHEN 'de' THEN {_sql_html('text')} ELSE {_sql_strip('text')} END AS body FROM documents)"""
_READY = f"""(SELECT c.doc_id, c.chunk_index, c.doc_id || ':' || c.chunk_index AS chunk_id, c.text, p.filename, p.tenant,
  NULL::INTEGER AS page_num FROM {_sql_fixed(f"(SELECT * FROM {_BODIES} x)", 1000, 200)} c JOIN {_BODIES} p USING (doc_id))"""
_ASKED = "(SELECT item_id AS query_id, text, 't' || item_id % 2 AS tenant FROM benchmark)"


def _sql_hits(ready: str, asked: str) -> str:
    """CTEs up to ``cut``: the reranked hits of every question among its tenant's chunks."""
    return f"""WITH rc AS MATERIALIZED (SELECT * FROM {ready} r), aq AS MATERIALIZED (SELECT * FROM {asked} a),
  cv AS MATERIALIZED (SELECT * FROM {_sql_vectors('rc', 'chunk_id')} v JOIN (SELECT chunk_id, tenant FROM rc) o USING (chunk_id)),
  qv AS MATERIALIZED (SELECT * FROM {_sql_vectors('aq', 'query_id')} v JOIN (SELECT query_id, tenant FROM aq) o USING (query_id)),
  sc AS (SELECT qv.query_id, cv.chunk_id, round(sum(qv.v * cv.v), 6) AS score FROM qv JOIN cv USING (bucket, tenant) GROUP BY 1, 2),
  tk AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM sc QUALIFY rank <= 10),
  kw AS (SELECT query_id, text AS question, {_KEYWORDS.format(x='text')} AS words FROM aq),
  ht AS (SELECT tk.*, rc.doc_id, rc.chunk_index, rc.text, rc.filename, rc.page_num, kw.words FROM tk JOIN rc USING (chunk_id)
    JOIN kw USING (query_id) WHERE score >= 0.3),
  rr AS (SELECT *, CASE WHEN len(words) = 0 THEN score ELSE round(score * 0.7 + CAST(len(list_filter(words,
    lambda t: contains(lower(ht.text), t))) AS DOUBLE) / len(words) * 0.3, 4) END AS rerank_score FROM ht),
  cut AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rerank_score DESC, chunk_id) AS position FROM rr
    QUALIFY position <= 5)"""


_HITS = _sql_hits(_READY, _ASKED)


def _ready(w):
    """Ready chunks with vectors, their documents, and the passages as questions; two tenants."""
    lang, number = F.col("lang"), F.regexp_extract("source", "([0-9]+)$", 1).try_cast("long")
    ext = F.when(lang == "fr", ".Markdown").when(lang == "de", ".html").otherwise(".txt")
    docs = w.t("documents").select(
        "doc_id", F.concat("source", F.lit("/"), F.col("doc_id").cast("string"), ext).alias("filename"),
        F.col("text").alias("content"), F.concat(F.lit("t"), F.coalesce(number, F.lit(0)) % 2).alias("tenant_id"),
    )
    got = hybrid.ingest(docs, _passages(w), strategy="fixed")
    asked = w.t("benchmark").select(
        F.col("item_id").alias("query_id"), F.col("text").alias("question"), F.concat(F.lit("t"), F.col("item_id") % 2).alias("tenant_id")
    )
    embedded = vectors.hashed_vectors(asked, ["query_id"], "question")
    # both are read twice, by the search and by the lookup of the found chunks
    return settle(got.chunks), settle(got.documents), embedded


def _hits(w):
    chunks, documents, asked = _ready(w)
    return hybrid.retrieve(asked, chunks, documents)


@checked("v5_keyword_rerank", f"{_HITS} SELECT query_id, chunk_id, score, rank, rerank_score FROM rr")
def _v5(w):
    return vectors.keyword_rerank(_hits(w)).select("query_id", "chunk_id", "score", "rank", "rerank_score")


@checked(
    "v6_blend_external_scores",
    f"""{_HITS}, b AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rerank_score DESC, chunk_id) AS r FROM rr)
        SELECT query_id, chunk_id, CASE WHEN r <= 3 AND chunk_index % 2 = 0 THEN round((round(rerank_score * 10000)
          + (doc_id % 11) * 1000) / 2) / 10000 ELSE rerank_score END AS rerank_score FROM b""",
)
def _v6(w):
    hits = settle(vectors.keyword_rerank(_hits(w)))
    ratings = hits.where("chunk_index % 2 = 0").select("query_id", "chunk_id", (F.col("doc_id") % 11).alias("rating"))
    order = [F.desc("rerank_score"), F.asc("chunk_id")]
    rows = vectors.blend_scores(hits, ratings, ["query_id", "chunk_id"], "query_id", order, first=3)
    return rows.select("query_id", "chunk_id", "rerank_score")


@checked("v7_rerank_cut", f"{_HITS} SELECT query_id, chunk_id, rerank_score, position FROM cut")
def _v7(w):
    return hybrid.rerank(_hits(w)).select("query_id", "chunk_id", "rerank_score", "position")


_TEXT_LABELS = ("Passage", "Term")
_ENTITY = f"""{_HITS}, joined AS (SELECT query_id, string_agg(text, ' ' ORDER BY position) AS text FROM cut GROUP BY 1),
  d AS (SELECT DISTINCT text AS name, 'Passage' AS label, 1 AS r FROM benchmark UNION ALL SELECT name, 'Term', 2 FROM {_TERMS} t),
  en AS (SELECT query_id, name, label, row_number() OVER (PARTITION BY query_id ORDER BY r, length(name) DESC, name) AS entity_rank
    FROM joined JOIN d ON contains(joined.text, name) QUALIFY entity_rank <= 3)"""


def _text_names(w):
    return union_all([_passages(w).select("name", "label"), _terms(w)])


@checked("v8_entities_of_hits", f"{_ENTITY} SELECT query_id, name, label, entity_rank FROM en")
def _v8(w):
    hits = settle(hybrid.rerank(_hits(w)))
    return hybrid.hit_entities(hits, _text_names(w), _TEXT_LABELS)


TEXT_GRAPH = GraphSpec(
    (
        NodeSpec("Document", "documents", "doc_id", unique=True),
        NodeSpec("Source", "documents", "source", name_template="{id}"),
        NodeSpec("Passage", "benchmark", "item_id", {"name": "text"}, unique=True),
        NodeSpec("Term", "terms", "name", name_template="{id}"),
    ),
    (
        EdgeSpec("FROM_SOURCE", "Document", "Source", "documents", "doc_id", "source", unique=True),
        EdgeSpec("QUOTES", "Document", "Passage", "quotes", "src", "dst", unique=True),
        EdgeSpec("USES_TERM", "Passage", "Term", "passage_terms", "item_id", "name"),
    ),
)


def _text_graph(w):
    quotes = hybrid.mention_edges(
        mentions.match_dictionary(w.t("documents"), ["doc_id"], "text", _passages(w)), _passages(w)
    )
    found = F.regexp_extract_all(F.lower("text"), F.lit("([a-z]{12,})"), 1)
    passage_terms = w.t("benchmark").select("item_id", F.explode(found).alias("name"))
    tables = {
        "documents": w.t("documents"), "benchmark": w.t("benchmark"), "terms": _terms(w), "quotes": settle(quotes),
        "passage_terms": passage_terms,
    }
    return PropertyGraph.build(TEXT_GRAPH, tables)


_CONTEXT = f"""{_ENTITY}, te AS (SELECT DISTINCT 'Document_' || doc_id AS a, 'Passage_' || item_id AS b, 'QUOTES' AS rel
      FROM documents d2 JOIN benchmark b2 ON contains(lower(d2.text), lower(b2.text))
    UNION SELECT DISTINCT 'Passage_' || item_id, 'Term_' || unnest(regexp_extract_all(lower(text), '[a-z]{{12,}}')), 'USES_TERM'
      FROM benchmark),
  ub AS (SELECT a, b, rel FROM te UNION ALL SELECT b, a, rel FROM te),
  nm AS (SELECT 'Passage_' || item_id AS id, text AS name, 'Passage' AS label FROM benchmark
    UNION ALL SELECT 'Document_' || doc_id, 'Document #' || doc_id, 'Document' FROM documents
    UNION ALL SELECT 'Term_' || name, name, 'Term' FROM {_TERMS} t),
  an AS (SELECT en.query_id, en.entity_rank, nm.id AS anchor, en.name, en.label FROM en JOIN nm USING (name, label)),
  nb AS (SELECT a AS anchor, b AS id, rel, row_number() OVER (PARTITION BY a ORDER BY b, rel) AS position
    FROM (SELECT DISTINCT a, b, rel FROM ub WHERE a IN (SELECT anchor FROM an)) QUALIFY position <= 10),
  ln AS (SELECT anchor, min(position) AS position, '  -' || rel || '-> ' || label || '(' || name || ')' AS line
    FROM nb JOIN nm USING (id) GROUP BY anchor, label, name, rel),
  al AS (SELECT query_id, entity_rank, 0 AS position, chr(10) || label || '(' || name || '):' AS line FROM an
    UNION ALL SELECT query_id, entity_rank, position, line FROM an JOIN ln USING (anchor))"""


@checked(
    "v9_graph_context",
    f"""{_CONTEXT} SELECT query_id, '[그래프 컨텍스트]' || chr(10) || string_agg(line, chr(10) ORDER BY entity_rank, position, line)
        AS graph_context FROM al GROUP BY 1""",
)
def _v9(w):
    hits = settle(hybrid.rerank(_hits(w)))
    return hybrid.graph_context(_text_graph(w), hybrid.hit_entities(hits, _text_names(w), _TEXT_LABELS))


_DOCUMENT_TEXT = """'[문서 검색 결과]' || chr(10) || string_agg(chr(10) || '--- 문서 ' || position || ' [출처: ' || filename || ', 관련도: '
  || printf('%.2f', score) || '] ---' || chr(10) || text, chr(10) ORDER BY position)"""


@checked("v10_document_context", f"{_HITS} SELECT query_id, {_DOCUMENT_TEXT} AS document_context FROM cut GROUP BY 1")
def _v10(w):
    return hybrid.document_context(hybrid.rerank(_hits(w)))


@checked(
    "v11_source_citations",
    f"""{_HITS} SELECT query_id, position, doc_id AS document_id, filename, text AS chunk_text,
          round(score, 3) AS relevance_score, chunk_index, page_num FROM cut""",
)
def _v11(w):
    return hybrid.citations(hybrid.rerank(_hits(w)))


# conversations as documents of pages: a turn is a page
_PAGES = f"""(SELECT conv_id AS doc_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn, chunk_index) - 1 AS INT) AS chunk_index,
    conv_id || ':' || (row_number() OVER (PARTITION BY conv_id ORDER BY turn, chunk_index) - 1) AS chunk_id, c.text,
    'talk/' || conv_id || '.pdf' AS filename, '_default_' AS tenant, CAST(turn + 1 AS INTEGER) AS page_num
  FROM {_sql_fixed("(SELECT conv_id || '/' || turn AS page_key, text AS body FROM conversations)", 200, 40, "page_key")} c
  JOIN (SELECT conv_id, turn, conv_id || '/' || turn AS page_key FROM conversations) t USING (page_key))"""
_OPENINGS = "(SELECT conv_id AS query_id, text, '_default_' AS tenant FROM conversations WHERE turn = 0 AND conv_id % 10 = 0)"
_PAGED = _sql_hits(_PAGES, _OPENINGS)
_PAGED_TEXT = _DOCUMENT_TEXT.replace("filename || ',", "filename || ', p.' || page_num || ',")


def _paged_hits(w):
    """What every tenth conversation opens with, searched in the turns of all."""
    turns = w.t("conversations")
    docs = turns.select(F.col("conv_id").alias("doc_id"), F.concat(F.lit("talk/"), "conv_id", F.lit(".pdf")).alias("filename")).distinct()
    pages = turns.select(F.col("conv_id").alias("doc_id"), (F.col("turn") + 1).alias("page_num"), "text")
    got = hybrid.ingest_pages(docs, pages, _passages(w), "fixed", 200, 40)
    asked = turns.where("turn = 0 AND conv_id % 10 = 0").select(F.col("conv_id").alias("query_id"), F.col("text").alias("question"))
    embedded = vectors.hashed_vectors(asked, ["query_id"], "question")
    return hybrid.rerank(hybrid.retrieve(embedded, settle(got.chunks), settle(got.documents)))


@checked("v10_paged_context", f"{_PAGED} SELECT query_id, {_PAGED_TEXT} AS document_context FROM cut GROUP BY 1")
def _v10_paged(w):
    return hybrid.document_context(_paged_hits(w))


@checked(
    "v11_paged_citations",
    f"""{_PAGED} SELECT query_id, position, doc_id AS document_id, filename, text AS chunk_text,
          round(score, 3) AS relevance_score, chunk_index, page_num FROM cut""",
)
def _v11_paged(w):
    return hybrid.citations(_paged_hits(w))


@checked(
    "v12_hybrid_retrieval",
    f"""{_CONTEXT}, gc AS (SELECT query_id, '[그래프 컨텍스트]' || chr(10) || string_agg(line, chr(10)
          ORDER BY entity_rank, position, line) AS graph_context FROM al GROUP BY 1),
        dc AS (SELECT query_id, {_DOCUMENT_TEXT} AS document_context, count(*) AS sources FROM cut GROUP BY 1)
        SELECT item_id AS query_id, CASE WHEN document_context IS NULL AND graph_context IS NULL
            THEN 'No relevant documents or graph data found.'
            ELSE 'No LLM configured. Returning raw context.' || chr(10) || chr(10)
              || coalesce(document_context, graph_context) END AS answer, graph_context, document_context,
          coalesce(sources, 0) AS sources, document_context IS NULL AND graph_context IS NULL AS no_context
        FROM benchmark LEFT JOIN gc ON gc.query_id = item_id LEFT JOIN dc ON dc.query_id = item_id""",
)
def _v12(w):
    chunks, documents, asked = _ready(w)
    return hybrid.hybrid(asked, chunks, documents, _text_graph(w), _text_names(w), _TEXT_LABELS)


# ---- chunk storage ------------------------------------------------------------------------------------


@checked(
    "s10_chunk_upsert",
    f"""SELECT c.doc_id, c.chunk_index, c.text, length(c.text) AS char_count, d.source AS tenant_id FROM (
          SELECT c.* FROM {_sql_fixed(_DOC_BODIES, 1000, 200)} c JOIN documents USING (doc_id) WHERE lang <> 'en'
          UNION ALL SELECT c.* FROM {_sql_fixed(_DOC_BODIES, 500, 100)} c JOIN documents USING (doc_id) WHERE lang = 'en') c
        JOIN documents d USING (doc_id)""",
)
def _s10(w):
    """All documents are stored, then the English ones again with smaller chunks."""
    docs = w.t("documents")
    owner = docs.select("doc_id", F.col("source").alias("tenant_id"))
    folder = shared_dir(w.spark, "chunks")
    first = ch.fixed_chunks(docs.select("doc_id", "text"), "text", 1000, 200).join(owner, "doc_id")
    again = ch.fixed_chunks(docs.where("lang = 'en'").select("doc_id", "text"), "text", 500, 100).join(owner, "doc_id")
    maintenance.write_chunks(first, folder, buckets=4)
    maintenance.write_chunks(again, folder, buckets=4)
    return w.spark.read.parquet(folder).select("doc_id", "chunk_index", "text", "char_count", "tenant_id")


@checked(
    "s11_document_delete",
    f"""WITH gone AS (SELECT doc_id FROM labels WHERE toxic = 1),
        m AS (SELECT DISTINCT doc_id, chunk_index, name FROM {_MENTIONS} x)
        SELECT 'Document' AS element, count(*) FILTER (doc_id IN (SELECT * FROM gone)) AS deleted,
          count(*) FILTER (doc_id NOT IN (SELECT * FROM gone)) AS kept FROM documents
        UNION ALL SELECT 'Chunk', count(*) FILTER (doc_id IN (SELECT * FROM gone)),
          count(*) FILTER (doc_id NOT IN (SELECT * FROM gone)) FROM {_CHUNKS} c
        UNION ALL SELECT 'MENTIONS', 0, count(*) FILTER (doc_id NOT IN (SELECT * FROM gone)) FROM m""",
)
def _s11(w):
    docs, pieces = w.t("documents").select("doc_id"), _doc_chunks(w)
    found = mentions.mentions(pieces, ["doc_id", "chunk_index"], _passages(w))
    toxic = w.t("labels").where("toxic = 1")
    d, c, m, counts = maintenance.delete_documents(toxic, docs, pieces, found)
    zero = F.lit(0).cast("long")
    kept = [df.select(F.lit(n).alias("element"), zero.alias("deleted"), F.lit(1).cast("long").alias("kept"))
            for n, df in (("Document", d), ("Chunk", c), ("MENTIONS", m))]
    gone = counts.select(F.col("label").alias("element"), "deleted", zero.alias("kept"))
    return union_all([*kept, gone]).groupBy("element").agg(F.sum("deleted").alias("deleted"), F.sum("kept").alias("kept"))
