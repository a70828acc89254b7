"""A facade over the operators: documents in, chunks, index, graph and answers out."""

from __future__ import annotations

import hashlib
import json
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..operators import blockmax, chunking, embedder, embedding, graph, index, ivf, layout, pages as page_ops, search, tables
from ..sources.store import TABLES, Store, list_documents
from ..streaming import ingest, progress
from ..streaming.ingest import PAGES

EVENTS = "batch_id long, doc_id long, seq long, stage string, processed int, total int, error string"

LIMITS = {"query": (1, 2000), "top_k": (1, 20)}


@dataclass(frozen=True)
class Settings:
    path: str
    buckets: int = 64
    embedder: str = "hashing"
    reranker: str = "lexical"
    sizes: chunking.ChunkSizes = field(default_factory=chunking.ChunkSizes)
    semantic: bool = True
    candidates: int = 30
    embed_batch: int = 32
    embed_steps: int = 1

    def __post_init__(self):
        if self.reranker not in ("lexical", "none"):
            raise ValueError("reranker must be 'lexical' or 'none'; another one is passed to the engine as a function")


class Engine:
    """Tables in a folder and what can be asked of them. scorer: a reranker (query, text) -> Column in place of the lexical
    one, such as a pandas UDF around a cross-encoder. embed: a function (text) -> Column of array<float> in place of hashed
    features, such as a pandas UDF around a model, whose batches are Arrow's; embed_query: another one for queries. model: in place of both, what loads a
    model that takes a list of texts, settings.embed_batch of them, and gives their vectors; settings.embed_steps is how often its progress is told of."""

    def __init__(self, spark: SparkSession, settings: Settings, scorer=search.lexical_score, embed=None, embed_query=None, model=None):
        if model is not None and embed is not None:
            raise ValueError("either a model or a function embeds")
        self.model = model
        self.spark, self.settings, self.scorer, self.embed, self.embed_query = spark, settings, scorer, embed, embed_query or embed
        self.store = Store(spark, settings.path, settings.buckets)

    def info(self) -> dict:
        s = self.settings
        return {"embedder": s.embedder if self.embed is None and self.model is None else "a function", "reranker": s.reranker, "tables": [t for t in TABLES if self.store.exists(t)]}

    def _vectors(self, texts: DataFrame, keys: list[str], isolate: bool = False) -> DataFrame:
        return embedder.embedded(texts, keys, self.model, f"{self.settings.path}#{id(self.model)}", self.settings.embed_batch, isolate)

    def _embedder(self, texts: DataFrame) -> DataFrame:
        if self.model is not None:
            return self._vectors(texts, ["chunk_id", "doc_id"], isolate=True)
        return ingest.hashing(texts) if self.embed is None else texts.withColumn("embedding", self.embed(F.col("text"))).drop("text")

    def ingest(self, pages: DataFrame, batch: int = 0) -> None:
        """Pages (doc_id, page_no, text; also width, height and words, for rectangles) into chunks, an index and a graph;
        documents already there are replaced."""
        ingest.ingest_batch(pages, self.store, batch, self.settings.sizes, self.settings.semantic, self._embedder, self.settings.embed_steps)

    def ingest_stream(self, folder: str, checkpoint: str, once: bool = True, schema: str = PAGES):
        return ingest.start(ingest.watch(self.spark, folder, schema=schema), self.store, checkpoint, self.settings.sizes, self.settings.semantic, once, self._embedder, self.settings.embed_steps)

    def register(self, files: DataFrame) -> None:
        """Files (doc_id, name, content) as they came; content may be null."""
        self.store.replace("files", files.select("doc_id", "name", "content"))

    def file(self, doc_id) -> DataFrame:
        """name and content of a document's file; no row where none is registered."""
        return self.store.document("files", doc_id).select("name", "content")

    def chunks(self, chunk_ids: DataFrame) -> DataFrame:
        """The chunks with these chunk_ids; ids that are not there are left out."""
        return self.store.read("chunks").join(chunk_ids.select("chunk_id").distinct(), "chunk_id", "left_semi")

    def progress(self) -> DataFrame:
        return progress.snapshot(self.store.read("progress"))

    def watch(self, batch: int = 0, every: float = 0.15, most: float = 3600.0):
        """Snapshots of a batch that is being ingested, as they change, until it has ended."""
        return progress.poll(lambda: self.store.read("progress", EVENTS), batch, every, most)

    def documents(self) -> DataFrame:
        pages, files = self.store.read("pages"), self.store.read("files", "doc_id long, name string, content binary")
        return list_documents(pages.select("doc_id").distinct().join(files.select("doc_id", "name"), "doc_id", "left"), pages, self.store.read("chunks", "doc_id long"))

    def graph(self, doc_id) -> tuple[DataFrame, DataFrame]:
        """Nodes and edges of a document, made from its chunks where they are not stored."""
        if self.store.exists("nodes") and self.store.exists("edges"):
            return self.store.document("nodes", doc_id), self.store.document("edges", doc_id)
        chunks = self.store.document("chunks", doc_id)
        top = graph.top_entities(graph.entities(chunks))
        return graph.nodes(top), graph.edges(graph.cooccurrences(chunks, top))

    def _index_path(self) -> str:
        """Where indexes over the postings and vectors that are there now lie. Another version of these has another place."""
        tables = self.store.version()[1]
        return f"{self.settings.path}/_indexes/{hashlib.md5(json.dumps([tables.get(t) for t in ('postings', 'lengths', 'vectors')]).encode()).hexdigest()}"

    def build_indexes(self, recall: float = 0.95) -> dict:
        """Blocks of postings that a search of everything prunes, and inverted lists of vectors for approximate search. They serve until documents
        change; searches then do without until this is called again. The result tells how many lists a query probes for the recall."""
        path = self._index_path()
        blockmax.build(index.of_tables(self.store.read("postings").drop("doc_id"), self.store.read("lengths").drop("doc_id"), "chunk_id")).save(f"{path}/blocks")
        vectors = self.store.read("vectors").select("chunk_id", "embedding")
        made = ivf.build(vectors, "chunk_id")
        made.save(f"{path}/lists")
        made = ivf.Ivf.load(self.spark, f"{path}/lists")
        probes = ivf.probes_for(made, vectors, recall)
        # written last: an index without it is not used
        self.spark.createDataFrame([(probes,)], "probes int").coalesce(1).write.mode("overwrite").parquet(f"{path}/done")
        return {"lists": len(made.centroids), "probes": probes}

    def search(self, queries: DataFrame, mode: str = "hybrid", top_k: int = 5, doc_ids: list | None = None, pushdown: bool = False, approximate: bool = False) -> DataFrame:
        """Answers to queries (query_id, query) with their citations. approximate: vectors come from the inverted lists that build_indexes made.

        One document in doc_ids is searched alone, with its own statistics. Several are a filter over the best answers
        of all, of which three times as many are fetched, or with pushdown the corpus itself; none or an
        empty list is everything.
        """
        low, high = LIMITS["top_k"]
        if not low <= top_k <= high:
            raise ValueError(f"top_k must be {low} to {high}")
        low, high = LIMITS["query"]
        n = F.length(F.coalesce("query", F.lit("")))
        asked = queries.select("query_id", F.when(n.between(low, high), F.col("query")).otherwise(F.raise_error(F.lit(f"a query must have {low} to {high} characters"))).alias("query"))
        read, scope = self.store.read, doc_ids or []
        if len(scope) == 1:
            if self.store.document("pages", scope[0]).isEmpty():
                raise KeyError(scope[0])
            read = lambda name: self.store.document(name, scope[0])
        elif scope and pushdown:
            read = lambda name: self.store.read(name).where(F.col("doc_id").isin(scope))
        later = len(scope) > 1 and not pushdown
        # what ingestion has stored: only postings of the queries' terms are counted, and no text is read before the candidates are known
        chunks, built = read("chunks"), index.of_tables(read("postings").drop("doc_id"), read("lengths").drop("doc_id"), "chunk_id")
        wanted = asked.select("query_id", F.col("query").alias("text"))
        vectors = self._vectors(wanted, ["query_id"]) if self.model is not None else embedding.dense_vectors(wanted, ["query_id"]) if self.embed_query is None else wanted.select("query_id", self.embed_query(F.col("text")).alias("embedding"))
        by_index, depth = {}, self.settings.candidates
        if not scope or later:
            path = self._index_path()
            there = self.store.has(f"{path}/done")
            if there and mode != "dense":
                by_index["sparse_ranks"] = blockmax.bm25(blockmax.Blocks.load(self.spark, f"{path}/blocks"), asked, depth)
            if approximate and mode != "sparse":
                if not there:
                    raise KeyError("no lists of these vectors: call build_indexes")
                probes = self.spark.read.parquet(f"{path}/done").first()["probes"]
                by_index["dense_ranks"] = ivf.search(ivf.Ivf.load(self.spark, f"{path}/lists"), vectors, depth, probes)
        found = search.hybrid(chunks.select("chunk_id", "text"), "chunk_id", built, asked, top_k * 3 if later else top_k, depth, mode, self.settings.reranker != "none", self.scorer, read("vectors").select("chunk_id", "embedding"), vectors, **by_index)
        found = found.join(chunks.select("chunk_id", "doc_id", "text", "spans"), "chunk_id")
        if later:
            found = search.in_documents(found, self.spark.createDataFrame([(d,) for d in scope], "doc_id long"), top_k)
        return self._cited(found)

    def _cited(self, found: DataFrame) -> DataFrame:
        spans = found.select("query_id", "chunk_id", "doc_id", F.explode_outer("spans").alias("s")).select("query_id", "chunk_id", "doc_id", F.col("s.page").alias("page_no"), F.col("s.start").alias("span_start"), F.col("s.end").alias("span_end"))
        pages, spans = self.store.read("pages"), spans.drop("query_id").distinct()
        rects = {"width", "height", "words"} <= set(pages.columns)
        cited = search.citation_rects(spans, pages) if rects else search.citations(spans, pages)
        each = cited.groupBy("chunk_id").agg(F.array_sort(F.collect_list(F.struct(*cited.drop("chunk_id", "doc_id").columns))).alias("citations"))
        return found.drop("spans").join(each, "chunk_id", "left")

    def highlights(self, chunk_id: str, page_no: int | None = None) -> DataFrame:
        """The pages and places of a chunk, with rectangles where pages have words; on one page, if it is said."""
        chunk = self.store.read("chunks").where(F.col("chunk_id") == chunk_id)
        return self._cited(chunk.select(F.lit(0).alias("query_id"), "chunk_id", "doc_id", "text", "spans")).select(F.explode("citations").alias("c")).select("c.*").where(F.lit(True) if page_no is None else F.col("page_no") == page_no)

    # the document tools, by the names they have there
    tools = {
        "merge": page_ops.merge_documents, "extract": page_ops.select_pages, "text-paginated": page_ops.speech_pages, "ocr": page_ops.with_recognised,
        "table-columns": tables.columns, "extract-selected-columns": tables.project, "to-sheet": tables.sheet, "mask-columns": tables.mask,
        "sensitive-data": text.sensitive, "redact": text.redact, "rects": layout.line_rects, "embed": embedding.dense_vectors,
    }
