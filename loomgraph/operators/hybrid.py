"""Document ingest and hybrid retrieval as composed DataFrame jobs."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.functions.plan import sized, spread
from loomgraph.functions.strings import has_hangul
from loomgraph.functions.text import html_text, markdown_text, strip
from loomgraph.graph import PropertyGraph, union_all
from loomgraph.operators import vectors
from loomgraph.operators.chunks import chunk_documents, chunk_pages
from loomgraph.operators.mentions import match_dictionary, mentions
from loomgraph.operators.ranking import top_k_per
from loomgraph.operators.traversal import Frontier, hop_lists_from, with_names
from loomgraph.session import settle
from loomgraph.sources.text import file_type, routing_error

DEFAULT_TENANT = "_default_"
SOURCES = 5
ENTITIES = 3
NEIGHBOURS = 10
# Headings and fallback answers.
DOCUMENT_HEADING = "[문서 검색 결과]"
GRAPH_HEADING = "[그래프 컨텍스트]"
NO_MODEL = ("LLM이 설정되지 않아 원본 컨텍스트를 반환합니다.\n\n", "No LLM configured. Returning raw context.\n\n")
NO_CONTEXT = ("관련 문서나 그래프 데이터를 찾을 수 없습니다.", "No relevant documents or graph data found.")


# ---- ingest -------------------------------------------------------------------------


def parse_documents(docs: DataFrame) -> DataFrame:
    """Route by file name and reduce to plain text; failures carry their reason.

    ``docs``: doc_id, filename, content.  Adds file_type, text, error.
    """
    kind = file_type(F.col("filename"))
    text = (
        F.when(kind == "html", html_text(F.col("content")))
        .when(kind == "md", markdown_text(F.col("content")))
        .when(kind == "txt", strip(F.col("content")))
    )
    problem = F.coalesce(
        routing_error(F.col("filename")),
        F.when(kind.isin("pdf", "docx"), F.lit("Supply extracted text for this type")),
        F.when(F.coalesce("_parsed", F.lit("")) == "", F.lit("No text content extracted")),
    )
    # the reason reads the text as a column of its own: otherwise all patterns run once more for it
    parsed = docs.withColumn("_parsed", text)
    return parsed.select("*", kind.alias("file_type"), F.col("_parsed").alias("text"), problem.alias("error")).drop("_parsed")


@dataclass(frozen=True)
class Ingested:
    documents: DataFrame
    chunks: DataFrame
    found: DataFrame


def ingest(
    docs: DataFrame,
    names: DataFrame,
    strategy: str = "recursive",
    size: int = 1000,
    overlap: int = 200,
    tenant: str = DEFAULT_TENANT,
    embedder: vectors.Embedder | None = None,
) -> Ingested:
    """Parse, chunk, embed and link documents in one flow, without a loop over documents.

    ``documents`` ends with status ``ready`` or ``failed`` and the reason.
    Vectors are hashed token counts, or those of ``embedder``.  A column tenant_id
    of ``docs`` is kept, otherwise all belong to ``tenant``.
    """
    # both stages feed several outputs: each is stored once instead of being parsed again
    parsed = settle(parse_documents(spread(_owned(docs, tenant), "doc_id")).drop("content"))
    good = parsed.where("error IS NULL").select("doc_id", "tenant_id", "text")
    pieces = settle(chunk_documents(good, "text", strategy, size, overlap))
    return _ingested(parsed, pieces, names, embedder)


def ingest_pages(
    docs: DataFrame,
    pages: DataFrame,
    names: DataFrame,
    strategy: str = "recursive",
    size: int = 1000,
    overlap: int = 200,
    tenant: str = DEFAULT_TENANT,
    embedder: vectors.Embedder | None = None,
) -> Ingested:
    """The same for documents whose text comes page by page: chunks carry ``page_num``.

    ``docs``: doc_id, filename; ``pages``: doc_id, page_num, text, extracted
    already.  Chunks never cross a page; their index runs through the document.
    A document without a page that has text fails.
    """
    owned = _owned(docs, tenant)
    bodies = pages.select("doc_id", "page_num", "text").join(owned.select("doc_id"), "doc_id", "left_semi")
    read = bodies.where(F.coalesce(strip(F.col("text")), F.lit("")) != "").select("doc_id").distinct().withColumn("_read", F.lit(True))
    parsed = settle(
        owned.join(read, "doc_id", "left").select(
            "doc_id", "tenant_id", "filename", file_type(F.col("filename")).alias("file_type"),
            F.when(F.col("_read").isNull(), F.lit("No text content extracted")).alias("error"),
        )
    )
    cut = chunk_pages(bodies, strategy=strategy, size=size, overlap=overlap)
    pieces = settle(cut.join(sized(parsed.where("error IS NULL").select("doc_id", "tenant_id")), "doc_id"))
    return _ingested(parsed, pieces, names, embedder)


def _owned(docs: DataFrame, tenant: str) -> DataFrame:
    return docs if "tenant_id" in docs.columns else docs.withColumn("tenant_id", F.lit(tenant))


def _ingested(parsed: DataFrame, pieces: DataFrame, names: DataFrame, embedder: vectors.Embedder | None) -> Ingested:
    """Vectors, document status and mentions of chunked documents."""
    if embedder is None:
        embedded = vectors.hashed_vectors(pieces, ["doc_id", "chunk_index"], "text")
    else:
        embedded = vectors.embed_with(pieces, "text", embedder)
    chunks = embedded.withColumn("chunk_id", F.concat_ws(":", "doc_id", "chunk_index"))
    counts = pieces.groupBy("doc_id").agg(F.count(F.lit(1)).alias("chunk_count"))
    documents = (
        parsed.select("doc_id", "filename", "file_type", "error", "tenant_id")
        .join(counts, "doc_id", "left")
        .withColumn("chunk_count", F.coalesce("chunk_count", F.lit(0)))
        .withColumn("error", F.coalesce("error", F.when(F.col("chunk_count") == 0, "No chunks generated")))
        .withColumn("status", F.when(F.col("error").isNull(), "ready").otherwise("failed"))
    )
    keys = ["doc_id", "chunk_index", "tenant_id"]
    return Ingested(documents, chunks, mentions(pieces.select(*keys, "text"), keys, names))


# ---- retrieval -----------------------------------------------------------------------


def retrieve(
    questions: DataFrame, chunks: DataFrame, documents: DataFrame, k: int = 10, minimum: float = 0.3
) -> DataFrame:
    """Top-k chunks per question above the threshold, with text and file name.

    ``questions``: query_id, question, embedding and tenant_id; without the last
    they belong to the default tenant.  Only chunks of the question's tenant
    whose document is ready are searched.
    """
    if "tenant_id" not in questions.columns:
        questions = questions.withColumn("tenant_id", F.lit(DEFAULT_TENANT))
    usable = vectors.searchable(chunks, documents)
    ranked = vectors.cosine_topk(questions, usable, k, "query_id", "chunk_id", within=["tenant_id"])
    asked = questions.select("query_id", "question", "tenant_id")
    # k rows per question: text and file name are looked up for these only
    kept = settle(vectors.above(ranked, minimum).join(asked, "query_id"))
    page = ["page_num"] if "page_num" in chunks.columns else []
    texts = chunks.select("chunk_id", "doc_id", "tenant_id", "chunk_index", *page, "text").join(kept, ["chunk_id", "tenant_id"])
    ready = documents.where("status = 'ready'").select("doc_id", "tenant_id", "filename")
    return texts.join(ready, ["doc_id", "tenant_id"]).drop("tenant_id")


def rerank(hits: DataFrame, k: int = SOURCES) -> DataFrame:
    return vectors.rerank_cut(vectors.keyword_rerank(hits), "query_id", "chunk_id", k)


def hit_entities(
    hits: DataFrame, names: DataFrame, label_order: Sequence[str], limit: int = ENTITIES
) -> DataFrame:
    """Up to ``limit`` entities named in the joined texts of a question's hits.

    Label order first, longer names first.
    """
    joined = hits.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("position", "text"))).alias("_l"))
    texts = joined.select("query_id", F.array_join(F.transform("_l", lambda s: s["text"]), " ").alias("text"))
    found = match_dictionary(texts, ["query_id"], "text", names, ignore_case=False)
    rank = F.array_position(F.array(*map(F.lit, label_order)), F.col("label"))
    order = [rank.asc(), F.desc(F.length("name")), F.asc("name")]
    return top_k_per(found.where(rank > 0), ["query_id"], limit, order, "entity_rank").select(
        "query_id", "name", "label", "entity_rank"
    )


def graph_lines(g: PropertyGraph, entities: DataFrame, limit: int = NEIGHBOURS) -> DataFrame:
    """Formatted one-hop neighbours of the picked entities: (query_id, entity_rank, position, line)."""
    picked = settle(entities)
    labels = [r["label"] for r in picked.select("label").distinct().collect()]  # labels only
    anchors = [
        g.nodes(label)
        .join(picked.where(F.col("label") == label).select("name").distinct(), "name")
        .select(F.lit(label).alias("label"), F.col("id").cast("string").alias("key"), "name")
        for label in labels
    ]
    if not anchors:
        return picked.select(
            "query_id", "entity_rank", F.lit(0).alias("position"), F.lit("").alias("line")
        ).where(F.lit(False))
    nodes = settle(union_all(anchors))
    hops = hop_lists_from(g, Frontier(nodes.select("label", "key"), frozenset(labels)), 1)
    near = with_names(g, top_k_per(hops, ["anchor"], limit, [F.asc("id"), F.asc("rel")], "position"))
    lines = near.groupBy("anchor", "label", "name", "rel").agg(F.min("position").alias("position")).select(
        "anchor",
        "position",
        F.concat(F.lit("  -"), "rel", F.lit("-> "), "label", F.lit("("), "name", F.lit(")")).alias("line"),
    )
    anchored = nodes.select(F.concat_ws("_", "label", "key").alias("anchor"), "label", "name").join(
        picked, ["label", "name"]
    )
    head = anchored.select(
        "query_id", "entity_rank", "anchor", F.lit(0).alias("position"),
        F.concat(F.lit("\n"), "label", F.lit("("), "name", F.lit("):")).alias("line"),
    )
    body = anchored.select("query_id", "entity_rank", "anchor").join(lines, "anchor")
    return head.unionByName(body.select(*head.columns)).select("query_id", "entity_rank", "position", "line")


def graph_context(g: PropertyGraph, entities: DataFrame, neighbours: int = NEIGHBOURS) -> DataFrame:
    """One text per question: its entities with their nearest neighbours."""
    lines = graph_lines(g, entities, neighbours)
    packed = lines.groupBy("query_id").agg(
        F.sort_array(F.collect_list(F.struct("entity_rank", "position", "line"))).alias("_l")
    )
    body = F.array_join(F.transform("_l", lambda s: s["line"]), "\n")
    return packed.select("query_id", F.concat_ws("\n", F.lit(GRAPH_HEADING), body).alias("graph_context"))


def document_context(hits: DataFrame, limit: int = SOURCES) -> DataFrame:
    """One text per question: numbered passages with source and score."""
    page = _page(hits)
    number = F.col("position").cast("string")
    line = F.concat(
        F.lit("\n--- 문서 "), number, F.lit(" [출처: "), F.coalesce("filename", F.lit("unknown")),
        F.when(page.isNotNull(), F.concat(F.lit(", p."), page.cast("string"))).otherwise(""),
        F.lit(", 관련도: "), F.format_string("%.2f", "score"), F.lit("] ---\n"), "text",
    )
    packed = (
        hits.where(F.col("position") <= limit)
        .groupBy("query_id")
        .agg(F.sort_array(F.collect_list(F.struct("position", line.alias("line")))).alias("_l"))
    )
    body = F.array_join(F.transform("_l", lambda s: s["line"]), "\n")
    return packed.select("query_id", F.concat_ws("\n", F.lit(DOCUMENT_HEADING), body).alias("document_context"))


def _page(hits: DataFrame) -> Column:
    return F.col("page_num").cast("int") if "page_num" in hits.columns else F.lit(None).cast("int")


def citations(hits: DataFrame, limit: int = SOURCES) -> DataFrame:
    return hits.where(F.col("position") <= limit).select(
        "query_id",
        "position",
        F.col("doc_id").alias("document_id"),
        F.coalesce("filename", F.lit("unknown")).alias("filename"),
        F.col("text").alias("chunk_text"),
        F.round("score", 3).alias("relevance_score"),
        "chunk_index",
        _page(hits).alias("page_num"),
    )


def hybrid(
    questions: DataFrame,
    chunks: DataFrame,
    documents: DataFrame,
    g: PropertyGraph,
    names: DataFrame,
    label_order: Sequence[str],
    k: int = 10,
    minimum: float = 0.3,
    sources: int = SOURCES,
    entities: int = ENTITIES,
    neighbours: int = NEIGHBOURS,
) -> DataFrame:
    """Retrieval, rerank, graph and document context: one row per question.

    ``k`` chunks are found, ``sources`` of them kept after reranking; ``entities``
    named in these are shown with ``neighbours`` each.  Texts are never cut.
    """
    hits = settle(rerank(retrieve(questions, chunks, documents, k, minimum), sources))
    about = graph_context(g, hit_entities(hits, names, label_order, entities), neighbours)
    cited = hits.groupBy("query_id").agg(F.count(F.lit(1)).alias("sources"))
    joined = (
        questions.select("query_id", "question")
        .join(document_context(hits, sources), "query_id", "left")
        .join(about, "query_id", "left")
        .join(cited, "query_id", "left")
    )
    context = F.coalesce("document_context", "graph_context")
    ko = has_hangul(F.col("question"))

    def worded(pair: tuple[str, str]):
        return F.when(ko, F.lit(pair[0])).otherwise(F.lit(pair[1]))

    answer = F.when(context.isNull(), worded(NO_CONTEXT)).otherwise(
        F.concat(worded(NO_MODEL), context)
    )
    return joined.select(
        "query_id",
        answer.alias("answer"),
        "graph_context",
        "document_context",
        F.coalesce("sources", F.lit(0)).alias("sources"),
        context.isNull().alias("no_context"),
    )


def mention_edges(found: DataFrame, names: DataFrame) -> DataFrame:
    """(doc_id, entity id) pairs from mentions and a dictionary with ``id``."""
    return found.join(names.select("name", "label", "id"), ["name", "label"]).select(
        F.col("doc_id").alias("src"), F.col("id").alias("dst")
    ).distinct()


