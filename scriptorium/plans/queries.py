"""The registered queries: operators applied to the whole of the given tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptorium.constants import EMBEDDING_DIM, COOCCURRENCE_RADIUS, DISTANCE_CUTOFF, TOP_K, TOP_K_SMALL
from scriptorium.functions import markup, urls
from scriptorium.operators import chunking, crawl, dictionary, graph, lexicon, pages, presence, prompts, retrieval, status
from scriptorium.operators import documents as docs
from scriptorium.plans import tables
from scriptorium.sources import corpus as sources
from scriptorium.sources import sinks
from scriptorium.sources.corpus import with_source
from scriptorium.session import checkpoint_folder, written, written_to
from scriptorium.streaming.index import append_chunks, document_stream, keep_index, read_index

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

SCOPE = "https://"
DOMAIN = "la colección de documentos"


def query(function: Query) -> Query:
    QUERIES[function.__name__] = function
    return function


def joined(items: Column | str) -> Column:
    items = F.col(items) if isinstance(items, str) else items
    return F.array_join(items.cast("array<string>"), "|")


# Sources and sinks


@query
def scan_corpus(spark, sf_dir):
    corpus = tables.documents(spark, sf_dir).select(F.col("doc_id").alias("path"), "text")
    return with_source(corpus)


@query
def pages_scanned(spark, sf_dir):
    """The stored pages as files of both kinds, and what a scan for Markdown finds there and in a folder that does not exist."""
    folder = _written(spark, "pages")
    stored = pages.page_store(tables.pages(spark, sf_dir), SCOPE).checkpoint()
    sinks.write_files(stored, folder, "markdown_file", "markdown")
    sinks.write_files(stored, folder, "html_file", "html")
    return sources.scan_corpus(spark, folder).unionByName(sources.scan_corpus(spark, f"{folder}/nowhere"))


def _pdf_folder(spark, sf_dir) -> str:
    """Every page as a file: PDFs with suffixes in either case, some below a folder, and other files."""
    folder = _written(spark, "pdfs")
    number = F.col("page_id").cast("string")
    name = (
        F.when(F.col("page_id") % 4 == 0, F.concat(F.lit("p "), number, F.lit(".pdf")))
        .when(F.col("page_id") % 4 == 1, F.concat(F.lit("p+"), number, F.lit(".PDF")))
        .when(F.col("page_id") % 4 == 2, F.concat(F.lit("below/p"), number, F.lit(".pdf")))
        .otherwise(F.concat(F.lit("text/p"), number, F.lit(".pdf.txt")))
    )
    sinks.write_files(tables.pages(spark, sf_dir).select(name.alias("name"), "html"), folder, "name", "html")
    return folder


@query
def pdfs_scanned(spark, sf_dir):
    """The PDF files directly in a folder, and those of a folder that does not exist."""
    folder = _pdf_folder(spark, sf_dir)
    found = sources.scan_pdfs(spark, folder).unionByName(sources.scan_pdfs(spark, f"{folder}/nowhere"))
    return found.select("name", "length", F.sha2("content", 256).alias("content_sha256"))


@query
def folder_status(spark, sf_dir):
    """Result lines of a folder of PDFs of which some are too short to convert, of one without PDFs and of one that does not exist."""
    folder, found = _pdf_folder(spark, sf_dir), None
    for name in (".", "text", "nowhere"):
        path = f"{folder}/{name}"
        error = F.when(F.col("length") < 2000, F.concat(F.lit("only "), "length", F.lit(" bytes")))
        value = F.concat(F.regexp_replace("name", r"\.[^.]*$", ""), F.lit(".md"))
        done = status.ingest_status(sources.scan_pdfs(spark, path), F.col("name"), value, error)
        lines = status.folder_lines(done, name, sources.folder_exists(spark, path)).withColumn("folder", F.lit(name))
        found = lines if found is None else found.unionByName(lines)
    return found


@query
def ingest_status(spark, sf_dir):
    """The number in each page address; addresses that end in something else are reported."""
    named = pages.url_parts(tables.pages(spark, sf_dir).select("page_id", "url"))
    number = F.expr("try_cast(name AS BIGINT)")
    error = F.when(number.isNull(), F.concat(F.lit("no number: "), "name"))
    return status.ingest_status(named, F.col("url"), number, error)


@query
def page_store(spark, sf_dir):
    return pages.page_store(tables.pages(spark, sf_dir), SCOPE)


# Pages and URLs


@query
def extract_links(spark, sf_dir):
    return pages.extract_links(tables.pages(spark, sf_dir))


def _link_forms(spark, sf_dir) -> DataFrame:
    """Every link of the pages, written in each of the forms a reference can take."""
    href = F.col("href")
    rest = F.substring(href, F.lit(2), F.length(href))
    forms = F.array(
        href,
        rest,
        F.concat(F.lit("../"), rest),
        F.concat(F.lit("./a/../"), rest),
        F.concat(F.lit("?q="), rest),
        F.concat(F.lit("#"), rest),
        F.concat(F.lit("//other.example.org"), href),
        F.concat(F.lit("mailto:"), rest),
        F.concat(F.lit("http://other.example.org"), href),
        F.lit(""),
    )
    links = pages.extract_links(tables.pages(spark, sf_dir))
    return links.select("page_id", "url", "position", F.posexplode(forms).alias("form", "href"))


@query
def resolve_links(spark, sf_dir):
    return pages.resolve_links(_link_forms(spark, sf_dir))


def _addresses(spark, sf_dir) -> DataFrame:
    """Page addresses, plain and with endings that decide about routes and paths."""
    url = F.col("url")
    forms = F.array(
        url,
        F.concat(url, F.lit("/x//y.PDF")),
        F.regexp_replace(url, "[?#].*$", ".pdf"),
        F.concat(F.regexp_replace(url, "[?#].*$", ""), F.lit("/a.pdf?v=1")),
        F.concat(F.lit("mailto:"), url),
        F.regexp_replace(url, "^(https?://[^/]*).*$", "$1"),
        F.regexp_replace(url, "^https?://[^/]*", ""),
    )
    return tables.pages(spark, sf_dir).select("page_id", F.posexplode(forms).alias("form", "url"))


@query
def url_parts(spark, sf_dir):
    return pages.url_parts(_addresses(spark, sf_dir))


@query
def storage_path(spark, sf_dir):
    return pages.storage_paths(_addresses(spark, sf_dir))


@query
def route_by_type(spark, sf_dir):
    return pages.route_by_type(_addresses(spark, sf_dir))


@query
def crawl_scope(spark, sf_dir):
    return pages.crawl_scope(tables.pages(spark, sf_dir).select("page_id", "url"), SCOPE)


@query
def rewrite_links(spark, sf_dir):
    return pages.rewrite_links(tables.pages(spark, sf_dir))


@query
def html_to_markdown(spark, sf_dir):
    odd = F.when(F.col("page_id") % 2 == 1, F.concat("html", F.lit(tables.ODD_HTML))).otherwise(F.col("html"))
    return pages.pages_to_markdown(tables.pages(spark, sf_dir).withColumn("html", odd))


@query
def page_edges(spark, sf_dir):
    """All links of the site, with the page that was captured at their end."""
    return pages.page_edges(tables.site_pages(spark, sf_dir), tables.SITE)


@query
def crawl_closure(spark, sf_dir):
    """From the first captured page of every host along the links of the site."""
    start = tables.site_pages(spark, sf_dir).groupBy("host").agg(F.min_by(urls.canonical(F.col("url")), "page_id").alias("url"))
    return crawl.crawl_closure(tables.site_links(spark, sf_dir), start, "http")


@query
def frontier_anti(spark, sf_dir):
    """Link targets that were not captured."""
    targets = tables.site_links(spark, sf_dir).select(F.col("dst").alias("url"))
    seen = tables.site_pages(spark, sf_dir).select(urls.canonical(F.col("url")).alias("url"))
    return crawl.unvisited(targets, seen)


# Text


@query
def markdown_to_text(spark, sf_dir):
    return tables.pages(spark, sf_dir).select(
        "page_id", markup.markdown_to_text(markup.html_to_markdown(F.col("html"))).alias("text")
    )


@query
def recursive_chunks(spark, sf_dir):
    return chunking.recursive_rows(tables.documents_md(spark, sf_dir), "doc_id")


@query
def paragraphs(spark, sf_dir):
    return tables.documents_md(spark, sf_dir).select(
        "doc_id", F.posexplode(chunking.paragraphs(F.col("text"))).alias("position", "paragraph")
    )


@query
def word_packing(spark, sf_dir):
    return tables.documents_md(spark, sf_dir).select(
        "doc_id", F.posexplode(chunking.pack_words(F.col("text"))).alias("piece_no", "piece")
    )


@query
def paragraph_chunks(spark, sf_dir):
    return tables.documents_md(spark, sf_dir).select(
        "doc_id", F.posexplode(chunking.paragraph_chunks(F.col("text"))).alias("chunk_index", "chunk")
    )


@query
def chunk_positions(spark, sf_dir):
    rows = chunking.chunk_rows(tables.documents_md(spark, sf_dir), "doc_id")
    return rows.select("doc_id", "chunk_index", "start_line", "end_line")


@query
def chunk_index_table(spark, sf_dir):
    return chunking.chunk_index_table(tables.documents_md(spark, sf_dir), "doc_id")


@query
def attach_source(spark, sf_dir):
    """Sources listed per text, given to chunks by position; chunks beyond the list get the fallback."""
    corpus = tables.documents_md(spark, sf_dir)
    chunks = chunking.global_positions(corpus, "doc_id")
    sources = with_source(corpus.select(F.col("doc_id").alias("path"))).select(
        F.col("path").alias("position"), "source"
    )
    return chunking.attach_source(chunks, sources)


@query
def line_paragraphs(spark, sf_dir):
    return tables.recognised_pages(spark, sf_dir).select(
        "doc", "page_num", F.posexplode(docs.line_paragraphs(F.col("text"))).alias("position", "paragraph")
    )


@query
def ragged_to_markdown(spark, sf_dir):
    return docs.ragged_to_markdown(tables.ragged(spark, sf_dir), "conv_id", "turn")


@query
def filled_cells(spark, sf_dir):
    """The cells of the same tables with blank ones replaced."""
    blanked = tables.ragged(spark, sf_dir).withColumn(
        "rows",
        F.transform("rows", lambda row: F.transform(row, lambda cell: F.when(cell.contains(","), " \t").otherwise(cell))),
    )
    # Some tables have only rows without cells, some have one among others, some have no rows.
    empty = F.array().cast("array<string>")
    none = F.array().cast("array<array<string>>")
    given = (
        F.when(F.col("role") == "system", F.array(empty, empty))
        .when(F.col("turn") == 1, F.array_append("rows", empty))
        .when(F.col("turn") == 2, none)
        .otherwise(F.col("rows"))
    )
    rows = docs.fill_cells(given)
    return blanked.select("conv_id", "turn", F.posexplode(rows).alias("row_no", "_row")).select(
        "conv_id", "turn", "row_no", joined("_row").alias("cells")
    )


@query
def document_markdown(spark, sf_dir):
    return docs.document_markdown(tables.recognised_pages(spark, sf_dir))


@query
def reading_order_rows(spark, sf_dir):
    boxes = tables.boxes(spark, sf_dir).select("table_id", "box_id", "x", "y", "w", "h")
    return docs.reading_order(boxes)


@query
def boxes_to_markdown(spark, sf_dir):
    """Cell boxes of every order as a table; orders without boxes and with a box that lost its place say so."""
    return docs.boxes_to_markdown(tables.regions(spark, sf_dir), tables.cell_boxes(spark, sf_dir))


@query
def region_filter(spark, sf_dir):
    return docs.region_filter(tables.boxes(spark, sf_dir)).select("table_id", "id", "region.*")


# Lexicon


@query
def acronym_occurrences(spark, sf_dir):
    return lexicon.acronym_occurrences(tables.documents_acr(spark, sf_dir), "doc_id")


@query
def acronym_definitions(spark, sf_dir):
    return lexicon.acronym_definitions(tables.documents_acr(spark, sf_dir), "doc_id")


@query
def acronym_dictionary(spark, sf_dir):
    found = lexicon.acronym_dictionary(tables.documents_acr(spark, sf_dir), "doc_id", parts=PARTS)
    return found.withColumn("files", joined("files"))


@query
def sentences(spark, sf_dir):
    return lexicon.sentence_rows(tables.documents(spark, sf_dir), "doc_id")


@query
def tokens(spark, sf_dir):
    return lexicon.token_rows(tables.documents(spark, sf_dir), "doc_id")


@query
def tagged_tokens(spark, sf_dir):
    return lexicon.tagged_token_rows(tables.documents(spark, sf_dir), "doc_id")


@query
def tagged_by_table(spark, sf_dir):
    """Tags from a table: the words of the questions are not nouns; all others by length."""
    words = tables.questions(spark, sf_dir).select(F.explode(lexicon.tokens_of(F.col("question"))).alias("token"))
    tags = words.distinct().withColumn("tag", F.lit("XX"))
    default = F.when(F.length("token") >= 5, "NN").otherwise("XX")
    rows = lexicon.token_rows(tables.documents(spark, sf_dir), "doc_id")
    return lexicon.tag_by_table(rows, tags, default).groupBy("token", "tag").agg(F.count("*").alias("n"))


@query
def noun_runs(spark, sf_dir):
    return lexicon.noun_run_rows(tables.documents(spark, sf_dir), "doc_id")


@query
def lemma_by_table(spark, sf_dir):
    """Single nouns that the questions hold become their first four letters; counted by term."""
    words = tables.questions(spark, sf_dir).select(F.explode(lexicon.tokens_of(F.col("question"))).alias("term")).distinct()
    runs = lexicon.noun_run_rows(tables.documents(spark, sf_dir), "doc_id", lemma=lambda noun: noun)
    found = lexicon.lemma_by_table(runs, words.withColumn("lemma", F.substring("term", 1, 4)))
    return found.groupBy("term").agg(F.count("*").alias("n"))


@query
def term_dictionary(spark, sf_dir):
    found = lexicon.term_dictionary(tables.documents(spark, sf_dir), "doc_id", parts=PARTS)
    return found.withColumn("files", joined("files"))


# Relations and graph


#: Parts that the lists of a dictionary entry come in, at every size of the tables.
PARTS = 8


def _dictionaries(corpus: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    return (
        lexicon.acronym_dictionary(corpus, key, parts=PARTS),
        lexicon.term_dictionary(corpus, key, parts=PARTS),
    )


class _Graph:
    """Dictionary, nodes, relations and edges of the conversation corpus.

    Tables that several later steps read are written, so that each is computed once.
    """

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        checkpoint_folder(spark)
        self.corpus = tables.talks(spark, sf_dir)
        acronyms, terms = _dictionaries(self.corpus, "path")
        self.acronyms, self.terms = written(acronyms), written(terms)
        self.nodes = graph.graph_nodes(self.acronyms, self.terms)
        self.elements = graph.elements(self.nodes)
        self._places = self._names = None

    def _numbered(self) -> None:
        """First positions per document, and the names of the numbers that stand for the elements in them."""
        if self._places is None:
            self._names = written_to(graph.numbered_elements(self.nodes))
            numbers = self.corpus.sparkSession.read.parquet(self._names)
            found = presence.element_presence(self.corpus, self.elements.join(numbers, ["element", "kind"]))
            self._places = written(presence.document_places(found.select("path", F.col("number").alias("element"), F.col("code").alias("kind"), "position")))

    @property
    def neighbours(self) -> graph.Neighbours:
        """Neighbours, made from the places wherever they are used, since they are a large multiple of the texts."""
        self._numbered()
        return graph.Neighbours(self._places, COOCCURRENCE_RADIUS, self._names)

    @property
    def relations(self) -> DataFrame:
        return graph.relations_of(self.neighbours).rows()

    @property
    def merged_edges(self) -> graph.Edges:
        # Relations come from the nodes, so both ends are known.
        return graph.graph_edges(graph.relations_of(self.neighbours))

    @property
    def edges(self) -> DataFrame:
        return self.merged_edges.rows()

    @property
    def connections(self) -> DataFrame:
        return graph.element_connections(self.neighbours)

    @property
    def dictionary(self) -> DataFrame:
        return dictionary.semantic_dictionary(self.acronyms, self.terms, self.nodes, self.neighbours, PARTS)


@query
def elements(spark, sf_dir):
    return _Graph(spark, sf_dir).elements


@query
def element_presence(spark, sf_dir):
    """All acronyms and terms of the documents, searched in all documents."""
    corpus = tables.documents_acr(spark, sf_dir)
    acronyms, terms = _dictionaries(corpus, "doc_id")
    everything = graph.elements(graph.graph_nodes(acronyms, terms))
    return presence.element_presence(corpus, everything, "doc_id")


@query
def cooccurrence_pairs(spark, sf_dir):
    built = _Graph(spark, sf_dir)
    return presence.cooccurrence_pairs(presence.element_presence(built.corpus, built.elements), COOCCURRENCE_RADIUS)


@query
def graph_nodes(spark, sf_dir):
    return _Graph(spark, sf_dir).nodes


@query
def graph_edges(spark, sf_dir):
    return _Graph(spark, sf_dir).edges


@query
def degree_centrality(spark, sf_dir):
    built = _Graph(spark, sf_dir)
    found = graph.degree_centrality(built.nodes, built.merged_edges)
    return found.withColumn("centrality", F.round("centrality", 6))


@query
def element_connections(spark, sf_dir):
    return _Graph(spark, sf_dir).connections


@query
def semantic_dictionary(spark, sf_dir):
    found = _Graph(spark, sf_dir).dictionary
    return found.select(
        "kind", "id", "part", "definition", "occurrences",
        joined("files").alias("files"),
        joined("connections").alias("connections"),
        F.round("centrality", 6).alias("centrality"),
    )


@query
def semantic_dictionary_json(spark, sf_dir):
    found = _Graph(spark, sf_dir).dictionary
    return dictionary.semantic_dictionary_json(found.withColumn("centrality", F.round("centrality", 6)))


@query
def graph_style(spark, sf_dir):
    built = _Graph(spark, sf_dir)
    return graph.graph_style(built.nodes, built.edges)


@query
def graph_export_lines(spark, sf_dir):
    built = _Graph(spark, sf_dir)
    return graph.graph_export_lines(built.nodes, built.edges)


@query
def run_stats(spark, sf_dir):
    built = _Graph(spark, sf_dir)
    edges = written(built.edges.select("weight"))
    return dictionary.run_stats(
        {
            "files": built.corpus,
            "acronyms": built.acronyms.select("acronym").distinct(),
            "terms": built.terms.select("term").distinct(),
            "nodes": built.nodes,
            "edges": edges,
        },
        # The weight of an edge is the number of its relations.
        {"relations": (edges, F.col("weight")), "chunks": (built.corpus, F.size(chunking.paragraph_chunks(F.col("text"))))},
    )


@query
def enriched_texts(spark, sf_dir):
    found = dictionary.enriched_texts(_Graph(spark, sf_dir).dictionary)
    return found.select(
        "kind", "id", "part", "text",
        F.col("metadata.definition").alias("definition"),
        F.col("metadata.occurrences").alias("occurrences"),
        joined("metadata.files").alias("files"),
        F.round("metadata.centrality", 6).alias("centrality"),
    )


# Embedding and retrieval


def _index(spark, sf_dir) -> DataFrame:
    return chunking.chunk_index_table(tables.documents_md(spark, sf_dir), "doc_id")


def _search(spark, sf_dir, metric: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The index, the questions, and the nearest chunks of every question."""
    index = written(_index(spark, sf_dir))
    asked = tables.questions(spark, sf_dir)
    results = retrieval.nearest(
        retrieval.embed_texts(index.select("id", "chunk"), "chunk"),
        retrieval.embed_texts(asked, "question"),
        TOP_K,
        metric,
        width=EMBEDDING_DIM,
    )
    return index, asked, results


@query
def embed_chunks(spark, sf_dir):
    rows = chunking.chunk_rows(tables.documents_md(spark, sf_dir), "doc_id")
    vectors = retrieval.embed_texts(rows.select("doc_id", "chunk_index", "chunk"), "chunk")
    rounded = F.transform("embedding", lambda x: F.round(x * 1000000).cast("bigint"))
    return vectors.select("doc_id", "chunk_index", joined(rounded).alias("embedding"))


@query
def semantic_search(spark, sf_dir):
    return _search(spark, sf_dir, "cosine")[2]


def _label_search(spark, sf_dir, k: int, metric: str) -> DataFrame:
    """The mean vector of each label as a question to the whole table; the labels are few."""
    vectors = tables.load(spark, sf_dir, "embeddings", "vec_id").select(F.col("vec_id").alias("id"), "embedding", "label")
    width = retrieval.usual_width(vectors)
    means = (
        vectors.filter(retrieval.usable_vector(F.col("embedding"), width))
        .select(F.col("label").cast("bigint").alias("query_id"), F.posexplode(F.col("embedding").cast("array<double>")).alias("i", "x"))
        .groupBy("query_id", "i")
        .agg(F.avg("x").alias("x"))
        .groupBy("query_id")
        .agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "x"))), lambda p: p["x"]).alias("embedding"))
    )
    return retrieval.nearest(vectors.select("id", "embedding"), means, k, metric, width=width)


@query
def rejected_vectors(spark, sf_dir):
    """The vectors that a search leaves out, with the reason: some of the table's are lost, cut short, lengthened, or hold a null."""
    vectors = tables.load(spark, sf_dir, "embeddings", "vec_id").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("embedding"))
    width = retrieval.usual_width(vectors)
    spoilt = (
        F.when(F.col("id") % 11 == 0, F.lit(None).cast("array<double>"))
        .when(F.col("id") % 7 == 0, F.slice("embedding", 2, 5))
        .when(F.col("id") % 5 == 0, F.array_append("embedding", F.lit(1.0)))
        .when(F.col("id") % 3 == 0, F.transform("embedding", lambda x, i: F.when(i != 1, x)))
        .otherwise(F.col("embedding"))
    )
    return retrieval.rejected_vectors(vectors.withColumn("embedding", spoilt), width).select("id", "reason")


@query
def knn_cosine(spark, sf_dir):
    return _label_search(spark, sf_dir, TOP_K, "cosine")


@query
def knn_l2(spark, sf_dir):
    return _label_search(spark, sf_dir, TOP_K_SMALL, "l2")


@query
def knn_cutoff(spark, sf_dir):
    return retrieval.within_cutoff(_label_search(spark, sf_dir, TOP_K, "l2"), DISTANCE_CUTOFF)


@query
def search_report(spark, sf_dir):
    index, _, results = _search(spark, sf_dir, "cosine")
    return retrieval.search_report(results, index)


def _contexts(spark, sf_dir) -> DataFrame:
    index, asked, results = _search(spark, sf_dir, "l2")
    sourced = with_source(index.select("id", "path", "chunk"))
    return prompts.context_assembly(asked, results, sourced, 0.9)


@query
def recursive_search(spark, sf_dir):
    """Pages as Markdown, as plain text, in recursive chunks; the three nearest of each question as its context."""
    texts = tables.pages(spark, sf_dir).select(
        F.col("page_id").alias("path"), markup.markdown_to_text(markup.html_to_markdown(F.col("html"))).alias("text")
    )
    chunks = chunking.numbered_chunks(chunking.recursive_rows(texts), "path").withColumnRenamed("position", "id").checkpoint()
    asked = tables.questions(spark, sf_dir)
    vectors = retrieval.embed_texts(chunks.select("id", "chunk"), "chunk")
    results = retrieval.nearest(vectors, retrieval.embed_texts(asked, "question"), TOP_K_SMALL, "l2", width=EMBEDDING_DIM)
    return prompts.context_assembly(asked, results, with_source(chunks), 0.9)


@query
def context_assembly(spark, sf_dir):
    return _contexts(spark, sf_dir)


@query
def prompt_build(spark, sf_dir):
    return prompts.prompt_build(_contexts(spark, sf_dir), DOMAIN)


@query
def request_payload(spark, sf_dir):
    return prompts.request_payload(prompts.prompt_build(_contexts(spark, sf_dir), DOMAIN))


@query
def parse_responses(spark, sf_dir):
    """Conversation turns as answers of a model: good, without choices, not JSON, failed."""
    message = F.struct(F.struct(F.col("text").alias("content")).alias("message"))
    good = F.to_json(F.struct(F.array(message).alias("choices")))
    responses = tables.load(spark, sf_dir, "conversations", "conv_id", "turn").select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("query_id"),
        F.when(F.col("role") == "system", 500).otherwise(200).alias("status"),
        F.lit("Internal Server Error").alias("reason"),
        F.when(F.col("role") == "assistant", good)
        .when(F.col("turn") == 0, F.lit('{"error":"x"}'))
        .when(F.col("text").contains("."), F.col("text"))
        .otherwise(good)
        .alias("body"),
    )
    return prompts.parse_responses(responses)


# Streaming


@query
def stream_chunk_index(spark, sf_dir):
    """The index of the documents, built by a stream and read back."""
    run = f"{checkpoint_folder(spark)}/stream-{uuid.uuid4().hex}"
    schema = tables.load(spark, sf_dir, "documents").schema.toDDL()
    # A pattern and not a path: the table may be one file or a folder of files, and a stream takes a path for a folder.
    arriving = document_stream(spark, f"{sf_dir}/document[s].parquet", schema)
    append_chunks(arriving.select("doc_id", "text"), f"{run}/index", f"{run}/log", "doc_id").awaitTermination()
    return spark.read.parquet(f"{run}/index")


@query
def stream_upsert_index(spark, sf_dir):
    """An index kept by a stream: all documents, then new versions of some, empty versions of others, and old versions that come too late."""
    run = _written(spark, "upsert")
    rows = tables.documents(spark, sf_dir).select("doc_id", "text")
    third, seventh = F.col("doc_id") % 3 == 0, F.col("doc_id") % 7 == 0
    arriving = (
        rows.withColumn("version", F.lit(1)),
        tables.documents_md(spark, sf_dir).filter(third | seventh).select("doc_id", F.when(~seventh, F.col("text")).alias("text"), F.lit(2).alias("version")),
        rows.filter(F.col("doc_id") % 5 == 0).select("doc_id", F.lit("late").alias("text"), F.lit(0).alias("version")),
    )
    for versions in arriving:
        versions.repartition(4).write.mode("append").parquet(f"{run}/in")
        # What has arrived is taken in; the next run continues after it.
        stream = document_stream(spark, f"{run}/in", "doc_id bigint, text string, version int", files_per_trigger=4)
        keep_index(stream, f"{run}/index", f"{run}/log", "doc_id").awaitTermination()
    return read_index(spark, f"{run}/index")


# Sinks, written and read back


def _written(spark: SparkSession, name: str) -> str:
    return f"{checkpoint_folder(spark)}/{name}-{uuid.uuid4().hex}"


@query
def index_written(spark, sf_dir):
    """Chunks of all documents in an index that was replaced once and appended to once."""
    path = _written(spark, "index")
    rows = chunking.chunk_rows(tables.documents(spark, sf_dir), "doc_id")
    even = F.col("doc_id") % 2 == 0
    # Cut once: this half goes into the index that is replaced and is appended to the next.
    odd = written(rows.filter(~even))
    sinks.replace_index(odd, path)
    sinks.replace_index(rows.filter(even), path)
    sinks.append_index(odd, path)
    return spark.read.parquet(path)


@query
def dictionary_written(spark, sf_dir):
    """The semantic dictionary as a file of its own form, read back."""
    path, built = _written(spark, "dictionary"), _Graph(spark, sf_dir)
    sinks.write_dictionary(built.dictionary.withColumn("centrality", F.round("centrality", 6)), built.relations, path)
    found = sources.scan_dictionary(spark, path, lines=True)
    return found.withColumn("files", joined("files")).withColumn("connections", joined("connections"))


@query
def relations_written(spark, sf_dir):
    """The relations of the same file, without the kinds of their ends."""
    path, built = _written(spark, "relations"), _Graph(spark, sf_dir)
    sinks.write_dictionary(built.dictionary, built.relations, path)
    return sources.scan_relations(spark, path, lines=True)
