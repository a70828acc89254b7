"""Streaming ingestion: landed pages to chunk, index, graph and progress tables, batch by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import graph
from ..operators.chunking import ChunkSizes, chunk_spans, chunks, with_spans
from ..operators.embedding import dense_vectors
from ..operators.index import build, with_embeddings
from ..sources.store import Store

PAGES = "doc_id long, page_no int, text string"


def watch(spark: SparkSession, folder: str, files_each: int | None = None, schema: str = PAGES) -> DataFrame:
    """A stream of page files (Parquet) that land in a folder. schema: PAGES, or with width, height and words too."""
    reader = spark.readStream.schema(schema)
    return (reader.option("maxFilesPerTrigger", files_each) if files_each else reader).parquet(folder)


def hashing(texts: DataFrame) -> DataFrame:
    """The embedder of hashed features: (chunk_id, doc_id, text) to (chunk_id, doc_id, embedding)."""
    return dense_vectors(texts, ["chunk_id", "doc_id"])


def ingest_batch(pages: DataFrame, store: Store, batch: int, sizes: ChunkSizes = ChunkSizes(), semantic: bool = True, embedder=hashing, steps: int = 1) -> None:
    """Pages into chunks, postings, vectors and a graph, which replace what their documents had in the store.

    A document with a page without a number goes to `failed` with all its pages, as do pages without a document; the others
    do not wait for it. embedder: texts (chunk_id, doc_id, text) to (chunk_id, doc_id, embedding); a document with a chunk that it leaves
    without one goes to `failed`, too, and keeps what the store had of it. Where no document has all its vectors, the embedder is at fault and the batch stops. steps: parts of the chunks that are embedded one after the other, each told of when it is done. Each stage is told of in `progress` when it is done. The batch's pages and chunks are written aside once and read back for
    what follows. All tables change together, at the end: a batch that stops leaves them as they were. Running a batch again gives the
    same tables."""
    spark = pages.sparkSession
    here = store.aside(pages)
    pages = spark.read.schema(pages.schema).parquet(here)
    bad = pages.where("doc_id is null or page_no is null")
    wrong = bad.select("doc_id").distinct()
    good = pages.where("doc_id is not null").join(wrong, "doc_id", "left_anti")
    ids = good.select("doc_id").distinct()
    number = F.lit(batch).cast("long").alias("batch_id")
    said: list[DataFrame] = []

    def tell(documents: DataFrame, stage: str, error: str | None = None, processed: int = 1, total: int = 1) -> None:
        said.append(documents.select(number, "doc_id", F.lit(len(said)).cast("long").alias("seq"), F.lit(stage).alias("stage"), F.lit(processed).alias("processed"), F.lit(total).alias("total"), F.lit(error).cast("string").alias("error")))
        rows = said[0]
        for x in said[1:]:
            rows = rows.unionByName(x)
        store.put("progress", rows, "batch_id")

    def failed(documents: DataFrame, error: str) -> DataFrame:
        rows = pages.join(documents, pages["doc_id"].eqNullSafe(documents["doc_id"]), "left_semi")
        return rows.withColumns({"batch_id": number, "error": F.lit(error)})

    lost = failed(wrong, "a page without a number or a document")
    store.put("failed", lost, "batch_id")
    tell(wrong, "error", "a page without a number or a document")
    tell(ids, "chunking")
    made = chunks(good, sizes, semantic)
    aside = store.aside(made)
    made = spark.read.schema(made.schema).parquet(aside)
    tell(ids, "embedding", processed=int(steps == 1), total=steps)
    slices, kind = [], None
    for k in range(steps):
        some = made if steps == 1 else made.where(F.pmod(F.xxhash64("chunk_id"), F.lit(steps)) == k)
        vectors = some.select("chunk_id", "doc_id").join(embedder(some.select("chunk_id", "doc_id", "text")), ["chunk_id", "doc_id"], "left")
        kind = vectors.schema
        slices.append(store.aside(vectors))
        if steps > 1:
            tell(ids, "embedding", processed=k + 1, total=steps)
    vectors = spark.read.schema(kind).parquet(*slices)
    bare = vectors.where("embedding is null").select("doc_id").distinct()
    if not bare.isEmpty():
        whole = ids.join(bare, "doc_id", "left_anti")
        if not whole.isEmpty():
            made, good, vectors, ids = (x.join(bare, "doc_id", "left_anti") for x in (made, good, vectors, ids))
            store.put("failed", lost.unionByName(failed(bare, "a chunk without an embedding")), "batch_id")
            tell(bare, "error", "a chunk without an embedding")
    tell(ids, "graphing")
    built = build(made, "chunk_id", scope="doc_id")
    top = graph.top_entities(graph.entities(made))
    spans = chunk_spans(made, good).join(made.select("chunk_id", "chunk_no"), "chunk_id")
    with store.transaction():
        store.replace("pages", good)
        store.replace("chunks", with_spans(made, chunk_spans(made, good)), ids)
        store.replace("vectors", with_embeddings(vectors), ids)
        store.replace("postings", built.postings, ids)
        store.replace("lengths", built.lengths, ids)
        store.replace("nodes", graph.nodes(top, graph.entity_pages(made, spans)), ids)
        store.replace("edges", graph.edges(graph.cooccurrences(made, top)), ids)
    tell(ids, "done")
    for path in (aside, here, *slices):
        store.remove(path)


def start(stream: DataFrame, store: Store, checkpoint: str, sizes: ChunkSizes = ChunkSizes(), semantic: bool = True, once: bool = True, embedder=hashing, steps: int = 1):
    """A streaming query that ingests every batch; once: what is there now, then it ends."""
    writer = stream.writeStream.foreachBatch(lambda pages, batch: ingest_batch(pages, store, batch, sizes, semantic, embedder, steps)).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
