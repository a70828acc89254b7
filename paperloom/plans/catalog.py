"""All registered queries and their SQL twins, which DuckDB runs on the same tables.

A query takes (session, folder) and returns a DataFrame over whole tables. SQL is given wherever it can say the same.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import patterns, text as T
from ..operators import blockmax, chunking, embedding, fulltext, graph, index, ivf, layout, pages as P, search, tables
from ..sources.store import kept, list_documents, scratch, settled
from ..streaming import progress
from . import evaluate

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def queries() -> dict:
    return dict(QUERIES)


def oracles() -> dict[str, str]:
    return dict(ORACLES)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Live BM25, the five best documents of each benchmark passage."""
    return bm25_live_topk(spark, sf_dir)


# --- inputs ---------------------------------------------------------------------------------


def _t(spark, d, name):
    return settled(spark).read.parquet(f"{d}/{name}.parquet")


def _docs(spark, d, *more):
    return _t(spark, d, "documents").select("doc_id", "text", *more)


def _asked(spark, d):
    return _t(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


def _pages(spark, d):
    return P.pages_of_lines(_docs(spark, d))


def _chunks(spark, d):
    return chunking.fixed_windows(_docs(spark, d)).select("doc_id", F.col("window_no").alias("chunk_no"), "text")


def _tables(spark, d):
    """Price lists of the parts by brand, as tables on pages: a document a brand, a page a size, the header first."""
    part = _t(spark, d, "part")
    body = F.transform(F.array_sort(F.collect_list(F.struct("p_partkey", "p_name", "p_type"))), lambda r: F.array(r["p_partkey"].cast("string"), r["p_name"], F.when(r["p_partkey"] % 7 != 0, r["p_type"])))
    each = part.groupBy(F.col("p_brand").alias("doc_id"), F.col("p_size").alias("page_no")).agg(body.alias("b"))
    return each.select("doc_id", "page_no", F.lit(1).alias("table_no"), F.concat(F.array(F.array(F.lit("Part  key"), F.lit("Name"), F.lit("Type"))), "b").alias("rows"))


def _sql_list(values) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


STEM = """CASE WHEN length(t) > 4 AND t LIKE '%ies' THEN t[:-4] || 'y' WHEN length(t) > 5 AND t LIKE '%ing' THEN t[:-4]
 WHEN length(t) > 4 AND t LIKE '%ed' THEN t[:-3] WHEN length(t) > 3 AND t LIKE '%s' AND t NOT LIKE '%ss' THEN t[:-2] ELSE t END"""


def _tok(text: str) -> str:
    return f"list_transform(list_filter(regexp_extract_all(lower({text}), '[a-z0-9]+'), lambda t: NOT list_contains({_sql_list(patterns.STOPWORDS)}, t)), lambda t: {STEM})"


def _words(text: str) -> str:
    return rf"regexp_extract_all(lower({text}), '[\pL\pN_]+')"


def _spaces(text: str) -> str:
    return rf"regexp_extract_all(lower({text}), '\S+')"


PAGES_SQL = """lines AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents),
pages AS (SELECT doc_id, p::INTEGER AS page_no, array_to_string(l[(p - 1) * 20 + 1 : p * 20], chr(10)) AS text FROM (SELECT doc_id, l, unnest(range(1, (len(l) + 19) // 20 + 1)) AS p FROM lines))"""

CHUNKS_SQL = r"""words AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '\S+') AS w FROM documents),
chunks AS (SELECT doc_id, k::INTEGER AS chunk_no, array_to_string(w[k * 140 + 1 : k * 140 + 160], ' ') AS text, (k * 140)::INTEGER AS word_start, least(k * 140 + 160, len(w))::INTEGER AS word_end
  FROM (SELECT doc_id, w, unnest(range(0, CASE WHEN len(w) = 0 THEN 0 ELSE greatest((len(w) - 160 + 139) // 140, 0) + 1 END)) AS k FROM words))"""


# --- text -----------------------------------------------------------------------------------


@query(f"SELECT doc_id, array_to_string({_tok('text')}, ' ') AS tokens FROM documents")
def tokenize_stem(spark, d):
    return _docs(spark, d).select("doc_id", F.array_join(T.tokenize(F.col("text")), " ").alias("tokens"))


@query(f"SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest({_tok('text')}) AS term FROM documents) GROUP BY ALL")
def term_freq(spark, d):
    return index.build(_docs(spark, d), "doc_id", "stemmed").postings


@query(f"SELECT term, count(DISTINCT doc_id) AS df FROM (SELECT doc_id, unnest({_tok('text')}) AS term FROM documents) GROUP BY ALL")
def doc_freq(spark, d):
    return index.document_frequency(index.build(_docs(spark, d), "doc_id", "stemmed"))


@query(f"SELECT count(*) AS n, round(avg(len({_words('text')})), 4) AS avg_dl, sum(len({_words('text')})) AS total FROM documents")
def corpus_stats(spark, d):
    i = index.build(_docs(spark, d), "doc_id", "live")
    return i.lengths.agg(F.count("*").alias("n"), F.round(F.avg("dl"), 4).alias("avg_dl"), F.sum("dl").alias("total"))


@query(r"SELECT doc_id, len(regexp_extract_all(text, '\S+'))::INTEGER AS n_tokens, md5(trim(regexp_replace(text, '\s+', ' ', 'g'))) AS normal FROM documents")
def normalize_ws(spark, d):
    return _docs(spark, d).select("doc_id", T.count_tokens(F.col("text")).alias("n_tokens"), F.md5(T.normalize_space(F.col("text"))).alias("normal"))


_SPEECH_SQL = "text"
for _p, _by in ((r"https?://\S+|www\.\S+", ""), (r"\S+@\S+", ""), (r"\n", " "), (r"[_/\\|*~<>\[\]{}]", " "), (r",([^\s])", r", \1"), (r"\.([^\s])", r". \1"), (r"\s+", " ")):
    _SPEECH_SQL = f"regexp_replace({_SPEECH_SQL}, '{_p}', '{_by}', 'g')"


@query(f"WITH {PAGES_SQL}, clean AS (SELECT doc_id, page_no AS p, trim({_SPEECH_SQL}) AS text FROM pages) SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY p)::INTEGER AS page_no, text FROM clean WHERE text <> ''")
def clean_for_speech(spark, d):
    return P.speech_pages(_pages(spark, d))


@query(r"""WITH s AS (SELECT doc_id, list_filter(list_transform(regexp_extract_all(text, '[^.!?]+[.!?]*'), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '') AS l FROM documents)
SELECT doc_id, CASE WHEN len(l) = 0 THEN 1 ELSE len(l) END::INTEGER AS n, CASE WHEN len(l) = 0 THEN NULL ELSE md5(array_to_string(l, '|')) END AS said FROM s""")
def speech_sentences(spark, d):
    said = _docs(spark, d).select("doc_id", T.speech_sentences(F.col("text")).alias("l"))
    return said.select("doc_id", F.size("l").alias("n"), F.md5(F.array_join("l", "|")).alias("said"))


@query("""SELECT item_id, nullif(array_to_string(list_transform(list_filter(l, lambda x, i: length(x) > 1 AND list_position(l, x) = i), lambda x: x), ' | '), '') AS ts
FROM (SELECT item_id, list_transform(regexp_extract_all(text, '[A-Za-z0-9]+'), lambda x: lower(x)) AS l FROM benchmark)""")
def or_tsquery(spark, d):
    return _t(spark, d, "benchmark").select("item_id", T.or_query(F.col("text")).alias("ts"))


@query("SELECT doc_id, regexp_replace(text, '(?i)(the|and)', '<mark>\\1</mark>', 'g') AS marked FROM documents")
def highlight_terms(spark, d):
    return _docs(spark, d).select("doc_id", T.highlight(F.col("text"), F.lit("the and x")).alias("marked"))


# --- pages, sentences, chunks ---------------------------------------------------------------


@query(f"WITH {PAGES_SQL} SELECT doc_id, page_no, length(text)::INTEGER AS length, coalesce(sum(length(text) + 1) OVER (PARTITION BY doc_id ORDER BY page_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::INTEGER AS start FROM pages")
def page_starts(spark, d):
    return P.page_starts(_pages(spark, d)).select("doc_id", "page_no", "length", "start")


@query("SELECT doc_id, md5(coalesce(text, '')) AS body FROM documents")
def pages_joined(spark, d):
    return P.joined(_pages(spark, d)).select("doc_id", F.md5("text").alias("body"))


@query(f"WITH {PAGES_SQL}, p AS (SELECT *, page_no AS source_page FROM pages WHERE page_no BETWEEN 1 AND 2 OR page_no = 4) SELECT doc_id, source_page, row_number() OVER (PARTITION BY doc_id ORDER BY source_page)::INTEGER AS page_no, md5(text) AS body FROM p")
def select_pages(spark, d):
    return P.select_pages(_pages(spark, d), "1-2, 4, 2").select("doc_id", "source_page", "page_no", F.md5("text").alias("body"))


@query(f"""WITH {PAGES_SQL}, f AS (SELECT source AS merged_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS position, doc_id FROM documents)
SELECT merged_id, row_number() OVER (PARTITION BY merged_id ORDER BY position, p.page_no)::INTEGER AS page_no, doc_id, p.page_no AS source_page FROM f JOIN pages p USING (doc_id) WHERE merged_id IN (SELECT merged_id FROM f GROUP BY 1 HAVING count(*) >= 2)""")
def merge_docs(spark, d):
    """The documents of each source as one, in the order of their ids, which do for positions."""
    files = _t(spark, d, "documents").select(F.col("source").alias("merged_id"), F.col("doc_id").alias("position"), "doc_id")
    return P.merge_documents(_pages(spark, d), files).select("merged_id", "page_no", "doc_id", "source_page")


@query(f"WITH {PAGES_SQL} SELECT doc_id, sum(length(trim(text)))::BIGINT AS chars FROM pages GROUP BY doc_id HAVING sum(length(trim(text))) < 80")
def scanned_documents(spark, d):
    return P.scanned_documents(_pages(spark, d))


@query(rf"WITH {PAGES_SQL} SELECT doc_id, array_to_string(list_transform(list_sort(list(page_no)), lambda n: 'page ' || n || ': no extractable text'), '; ') AS warnings FROM pages WHERE length(text) < 400 OR NOT regexp_matches(text, '\S') GROUP BY doc_id")
def empty_page_warnings(spark, d):
    """Short pages stand for scanned ones: white space is all that was read of them."""
    read = F.when(F.length("text") < 400, F.lit(" \n\t")).otherwise(F.col("text"))
    return P.empty_pages(_pages(spark, d).withColumn("text", read)).select("doc_id", F.array_join("warnings", "; ").alias("warnings"))


SENTENCES_SQL = rf"""cut AS (SELECT doc_id, string_split(regexp_replace(coalesce(text, ''), '([.!?])(\s+)(["''(\[]?[A-Z0-9])', '\1' || chr(1) || '\2' || chr(2) || '\3', 'g'), chr(1)) AS l FROM documents),
raw AS (SELECT doc_id, unnest(l) AS x, generate_subscripts(l, 1) AS i FROM cut),
piece AS (SELECT doc_id, i, CASE WHEN contains(x, chr(2)) THEN split_part(x, chr(2), 1) ELSE '' END AS gap, CASE WHEN contains(x, chr(2)) THEN split_part(x, chr(2), 2) ELSE x END AS piece FROM raw),
placed AS (SELECT *, sum(length(gap) + length(piece)) OVER (PARTITION BY doc_id ORDER BY i) - length(piece) AS pos, regexp_extract(right(piece, 16), '(\S+)\s*$', 1) AS last FROM piece),
marked AS (SELECT *, list_contains({_sql_list(patterns.ABBREVIATIONS)}, lower(last)) OR regexp_matches(last, '^[A-Z]\.$') AS no_cut FROM placed),
numbered AS (SELECT *, coalesce(sum(CASE WHEN no_cut THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS g FROM marked),
whole AS (SELECT doc_id, g, min(pos) AS pos, max(pos + length(piece)) AS stop FROM numbered GROUP BY ALL),
texts AS (SELECT doc_id, pos, substr(text, pos::INTEGER + 1, (stop - pos)::INTEGER) AS raw FROM whole JOIN documents USING (doc_id)),
sents AS (SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1)::INTEGER AS sent_no, (pos + length(raw) - length(ltrim(raw, ' ' || chr(9) || chr(10) || chr(13))))::INTEGER AS start, trim(raw, ' ' || chr(9) || chr(10) || chr(13)) AS sentence FROM texts WHERE regexp_matches(raw, '\S'))"""


@query(rf"""WITH {SENTENCES_SQL} SELECT doc_id, sent_no, start, (start + length(sentence))::INTEGER AS "end", len(regexp_extract_all(sentence, '\S+'))::INTEGER AS tokens FROM sents""")
def sentences(spark, d):
    return chunking.sentences(_docs(spark, d)).select("doc_id", "sent_no", "start", "end", "tokens")


@query(rf"""WITH {SENTENCES_SQL}, w AS (SELECT *, regexp_extract_all(sentence, '\S+') AS w, string_split_regex(sentence, '\S+') AS g FROM sents),
each AS (SELECT doc_id, start, sentence, unnest(w) AS word, unnest(g[:len(w)]) AS gap, generate_subscripts(w, 1) AS j FROM w WHERE len(w) > 20),
placed_words AS (SELECT *, sum(length(gap) + length(word)) OVER (PARTITION BY doc_id, start ORDER BY j) AS upto FROM each),
long AS (SELECT doc_id, start, sentence, min(upto - length(word)) AS a, max(upto) AS b, count(*) AS tokens FROM placed_words GROUP BY doc_id, start, sentence, (j - 1) // 20),
pieces AS (SELECT doc_id, start, start + length(sentence) AS "end", len(w) AS tokens, sentence FROM w WHERE len(w) <= 20 UNION ALL SELECT doc_id, start + a, start + b, tokens, substr(sentence, (a + 1)::INTEGER, (b - a)::INTEGER) FROM long)
SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY start) - 1)::INTEGER AS sent_no, start::INTEGER AS start, "end"::INTEGER AS "end", tokens::INTEGER AS tokens, md5(sentence) AS body FROM pieces""")
def hard_split(spark, d):
    cut = chunking.hard_split(chunking.sentences(_docs(spark, d)), 20)
    return cut.select("doc_id", "sent_no", "start", "end", "tokens", F.md5("sentence").alias("body"))


@query(f"WITH {CHUNKS_SQL} SELECT doc_id, chunk_no, md5(text) AS body, word_start, word_end FROM chunks")
def fixed_windows(spark, d):
    return chunking.fixed_windows(_docs(spark, d)).select("doc_id", F.col("window_no").alias("chunk_no"), F.md5("text").alias("body"), "word_start", "word_end")


def _passages(spark, d):
    """Chunks of five sentences: what the span and citation queries take."""
    return _passages_of(chunking.sentences(_docs(spark, d)))


def _passages_of(s):
    k = F.floor(F.col("sent_no") / 5).cast("int")
    rows = s.groupBy("doc_id", k.alias("chunk_no")).agg(F.min("start").alias("char_start"), F.max("end").alias("char_end"))
    return rows.withColumn("chunk_id", F.format_string("%d:%04d", "doc_id", "chunk_no"))


PASSAGES_SQL = rf"""{SENTENCES_SQL}, passages AS (SELECT doc_id, sent_no // 5 AS k, doc_id || ':' || lpad((sent_no // 5)::VARCHAR, 4, '0') AS chunk_id, min(start) AS a, max(start + length(sentence)) AS b FROM sents GROUP BY ALL),
{PAGES_SQL}, starts AS (SELECT *, coalesce(sum(length(text) + 1) OVER (PARTITION BY doc_id ORDER BY page_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::INTEGER AS s FROM pages),
spans AS (SELECT chunk_id, p.doc_id, page_no, (greatest(a, s) - s)::INTEGER AS span_start, (least(b, s + length(text)) - s)::INTEGER AS span_end, text FROM passages p JOIN starts USING (doc_id) WHERE s < b AND s + length(text) > a)"""


@query(f"WITH {PASSAGES_SQL} SELECT chunk_id, doc_id, page_no, span_start, span_end FROM spans WHERE span_end > span_start")
def chunk_spans(spark, d):
    return chunking.chunk_spans(_passages(spark, d), _pages(spark, d))


def _cited(spark, d):
    pages = _pages(spark, d)
    return search.citations(chunking.chunk_spans(_passages(spark, d), pages), pages)


@query(f"WITH {PASSAGES_SQL} SELECT chunk_id, doc_id, page_no, span_start, span_end, md5(substr(text, span_start + 1, span_end - span_start)) AS body FROM spans WHERE span_end > span_start")
def citations(spark, d):
    return _cited(spark, d).select("chunk_id", "doc_id", "page_no", "span_start", "span_end", F.md5("text").alias("body"))


@query(f"WITH {PASSAGES_SQL} SELECT chunk_id, arg_max(page_no, [span_end - span_start, -page_no]) AS page_no FROM spans WHERE span_end > span_start GROUP BY chunk_id")
def best_page_by_length(spark, d):
    return search.best_page_by_length(_cited(spark, d))


@query(f"""WITH {PASSAGES_SQL}, c AS (SELECT chunk_id, page_no, CASE WHEN contains(lower(substr(text, span_start + 1, span_end - span_start)), 'ing') OR contains(lower(substr(text, span_start + 1, span_end - span_start)), 'zz') THEN 0 ELSE 1 END AS miss FROM spans WHERE span_end > span_start)
SELECT 1::BIGINT AS query_id, chunk_id, arg_min(page_no, [miss, page_no]) AS page_no FROM c GROUP BY chunk_id""")
def best_page_by_terms(spark, d):
    asked = spark.range(1).select(F.lit(1).cast("long").alias("query_id"), F.lit("ing zz a").alias("query"))
    return search.best_page_by_terms(_cited(spark, d).withColumn("query_id", F.lit(1).cast("long")), asked)


@query(f"WITH {PASSAGES_SQL} SELECT chunk_id, CASE WHEN min(page_no) = max(page_no) THEN 'Page ' || min(page_no) ELSE 'Pages ' || min(page_no) || '-' || max(page_no) END AS label FROM spans WHERE span_end > span_start GROUP BY chunk_id")
def page_label(spark, d):
    return search.page_label(_cited(spark, d))


def packed_sql(s: chunking.ChunkSizes = chunking.ChunkSizes(), rows: str = "marked") -> str:
    """packed (doc_id, chunk_no, first, last) of rows (doc_id, i, tok, brk), for WITH RECURSIVE: one chunk a step. A chunk
    begins at `first`, or at `fresh`, its first new sentence, if the kept ones leave that no room; it ends at the first place
    where a break, the target, a sentence that no longer fits, or the end of the document closes it."""
    kept = f"CASE WHEN NOT cut AND {s.overlap} > 0 AND last - first >= {s.overlap} THEN last + 1 - {s.overlap} ELSE last + 1 END"
    return f"""sums AS (SELECT doc_id, i, brk, sum(tok) OVER w AS upto, sum(tok) OVER w - tok AS before, lead(tok) OVER (PARTITION BY doc_id ORDER BY i) AS next FROM {rows} WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
jumps AS (SELECT doc_id, -1 AS chunk_no, 0 AS first, -1 AS last, 0 AS begin, 0 AS fresh FROM {rows} WHERE i = 0
  UNION ALL SELECT doc_id, chunk_no, first, last, {kept} AS begin, last + 1 AS fresh FROM (
    SELECT doc_id, chunk_no, first, min(i) AS last, arg_min(brk AND size >= {s.least}, i) AS cut FROM (
      SELECT j.doc_id, j.chunk_no + 1 AS chunk_no, b.i AS first, e.i, e.brk, e.next, e.upto - b.before AS size
      FROM jumps j JOIN sums k ON k.doc_id = j.doc_id AND k.i = j.begin JOIN sums f ON f.doc_id = j.doc_id AND f.i = j.fresh
      JOIN sums b ON b.doc_id = j.doc_id AND b.i = CASE WHEN f.upto - k.before > {s.most} THEN j.fresh ELSE j.begin END
      JOIN sums e ON e.doc_id = j.doc_id AND e.i BETWEEN j.fresh AND j.fresh + {s.most})
    WHERE next IS NULL OR (brk AND size >= {s.least}) OR size >= {s.target} OR size + next > {s.most} GROUP BY ALL)),
packed AS (SELECT doc_id, chunk_no, first, last FROM jumps WHERE chunk_no >= 0)"""


@query(f"WITH {SENTENCES_SQL} SELECT doc_id, sent_no, start FROM sents WHERE sent_no // 5 % 3 = 1")
def uncovered_sentences(spark, d):
    """Where every third passage is missing, its sentences; chunks of whole documents leave none."""
    # sentences are cut once: points, passages and chunks are made of one table
    sents = kept(chunking.sentences(_docs(spark, d)), "sentences")
    holes = chunking.uncovered(sents.select("doc_id", "sent_no", "start"), _passages_of(sents).where("chunk_no % 3 <> 1"))
    pieces = chunking.hard_split(sents, 256)
    return holes.unionByName(chunking.uncovered(pieces, chunking.pack_groups(pieces)))


# --- vectors --------------------------------------------------------------------------------

_CRC = """crc(n, c, k) AS (SELECT range, range, 0 FROM range(256) UNION ALL SELECT n, CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END, k + 1 FROM crc WHERE k < 8),
lut AS (SELECT list(c ORDER BY n) AS l FROM crc WHERE k = 8)"""


def _hashed_sql(rows: str, keys: str, p: str = "") -> str:
    """<p>unit (keys, bucket, value): unit vectors of the hashed features of rows (keys, text)."""
    return f"""{p}toks AS (SELECT {keys}, {_tok("text")} AS t FROM ({rows})),
{p}feats AS (SELECT {keys}, unnest(list_concat(t, CASE WHEN len(t) < 2 THEN [] ELSE list_transform(range(1, len(t)), lambda i: t[i] || '_' || t[i + 1]) END)) AS f FROM {p}toks),
{p}tf AS (SELECT {keys}, f, count(*) AS n FROM {p}feats GROUP BY ALL),
{p}hashes AS (SELECT f, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(f, ''), lambda ch: ascii(ch)::BIGINT)), lambda c, b: xor(l[(xor(c, b) & 255) + 1], c >> 8)), 4294967295) AS h FROM (SELECT DISTINCT f FROM {p}tf), lut),
{p}cells AS (SELECT {keys}, (h % 384)::INTEGER AS bucket, sum(CASE WHEN h >> 31 = 1 THEN 1 ELSE -1 END * (1 + ln(n))) AS v FROM {p}tf JOIN {p}hashes USING (f) GROUP BY ALL),
{p}unit AS (SELECT {keys}, bucket, coalesce(v / nullif(sqrt(sum(v * v) OVER (PARTITION BY {keys})), 0), 0) AS value FROM {p}cells)"""


_HASHED = _hashed_sql("SELECT item_id, text FROM benchmark", "item_id")


@query(f"WITH RECURSIVE {_CRC}, {_HASHED} SELECT item_id, bucket, round(value, 6) AS value FROM unit WHERE abs(value) > 1e-9")
def hash_features(spark, d):
    v = embedding.sparse_vectors(_t(spark, d, "benchmark").select("item_id", "text"), ["item_id"])
    return v.where(F.abs("value") > 1e-9).withColumn("value", F.round("value", 6))


# sentences cut into pieces of at most 256 words, the cosine of each one's surroundings with the next one's, and breaks
BREAKS_SQL = rf"""{SENTENCES_SQL}, runs AS (SELECT doc_id, start, sentence, regexp_extract_all(sentence, '\S+\s*') AS r FROM sents),
words_at AS (SELECT doc_id, start, sentence, unnest(r) AS w, generate_subscripts(r, 1) AS k FROM runs),
ends_at AS (SELECT *, sum(length(w)) OVER (PARTITION BY doc_id, start ORDER BY k) AS upto FROM words_at),
cut_at AS (SELECT doc_id, start, sentence, (k - 1) // 256 AS g, min(upto - length(w)) AS a, max(upto - length(w) + length(rtrim(w, ' ' || chr(9) || chr(10) || chr(13)))) AS b, count(*) AS tok FROM ends_at GROUP BY ALL),
split AS (SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY start, g) - 1)::INTEGER AS i, (start + a)::INTEGER AS start, (start + b)::INTEGER AS stop, tok::BIGINT AS tok, substr(sentence, a::INTEGER + 1, (b - a)::INTEGER) AS s, count(*) OVER (PARTITION BY doc_id) AS n FROM cut_at),
around AS (SELECT doc_id, i, string_agg(s, ' ' ORDER BY i) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS text FROM split WHERE n >= 4),
{_hashed_sql("SELECT doc_id, i, text FROM around", "doc_id, i", "s_")},
near AS (SELECT a.doc_id, a.i, round(coalesce(x, 0), 9) AS similarity FROM around a JOIN around z ON z.doc_id = a.doc_id AND z.i = a.i + 1
  LEFT JOIN (SELECT p.doc_id, p.i, sum(p.value * q.value) AS x FROM s_unit p JOIN s_unit q ON q.doc_id = p.doc_id AND q.i = p.i + 1 AND q.bucket = p.bucket GROUP BY ALL) d ON d.doc_id = a.doc_id AND d.i = a.i),
breaks AS (SELECT *, similarity < quantile_cont(similarity, 0.2) OVER (PARTITION BY doc_id) AS is_break FROM near)"""


@query(f"WITH RECURSIVE {_CRC}, {BREAKS_SQL} SELECT doc_id, i AS sent_no, round(similarity, 6) AS similarity, is_break FROM breaks")
def semantic_breaks(spark, d):
    found = chunking.semantic_breaks(chunking.hard_split(chunking.sentences(_docs(spark, d)), 256))
    return found.withColumn("similarity", F.round("similarity", 6))


@query(f"""WITH RECURSIVE {_CRC}, {BREAKS_SQL}, flagged AS (SELECT s.doc_id, s.i, tok, coalesce(is_break, false) AS brk FROM split s LEFT JOIN breaks b ON b.doc_id = s.doc_id AND b.i = s.i), {packed_sql(rows="flagged")}
SELECT p.doc_id || ':' || lpad(chunk_no::VARCHAR, 4, '0') AS chunk_id, p.doc_id, chunk_no, a.start AS char_start, b.stop AS char_end,
  trim(regexp_replace(substr(d.text, a.start + 1, b.stop - a.start), '\\s+', ' ', 'g')) AS text
FROM packed p JOIN split a ON a.doc_id = p.doc_id AND a.i = p.first JOIN split b ON b.doc_id = p.doc_id AND b.i = p.last JOIN documents d ON d.doc_id = p.doc_id""")
def pack_chunks(spark, d):
    return chunking.chunks(_pages(spark, d))


@query(f"WITH RECURSIVE {_CRC}, {_HASHED} SELECT item_id, round(sqrt(sum(value * value)), 4) AS norm, 384 AS dim, count(*) FILTER (abs(value) > 1e-6) AS cells FROM unit GROUP BY 1")
def hash_vectors_unit(spark, d):
    v = embedding.dense_vectors(_t(spark, d, "benchmark").select("item_id", "text"), ["item_id"])
    norm = F.round(F.sqrt(embedding.dot(F.col("embedding"), F.col("embedding"))), 4)
    return v.select("item_id", norm.alias("norm"), F.size("embedding").alias("dim"), F.size(F.filter("embedding", lambda x: F.abs(x) > 1e-6)).cast("long").alias("cells"))


def _vectors(spark, d):
    e = _t(spark, d, "embeddings")
    return e.select("vec_id", "embedding", "label"), e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "embedding", "label")


def _dense_sql(more: str) -> str:
    return f"""WITH s AS (SELECT q.vec_id AS query_id, e.vec_id, round(list_dot_product(q.embedding::DOUBLE[], e.embedding::DOUBLE[]), 4) AS score FROM embeddings q JOIN embeddings e ON {more} WHERE q.vec_id % 50 = 0)
SELECT * FROM (SELECT query_id, vec_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, score FROM s) WHERE rank <= 10"""


@query(_dense_sql("true"))
def dense_topk(spark, d):
    v, q = _vectors(spark, d)
    return search.dense(v.drop("label"), q.drop("label"), top=10)


@query(_dense_sql("q.label = e.label"))
def dense_topk_scoped(spark, d):
    v, q = _vectors(spark, d)
    return search.dense(v, q, top=10, scope="label")


def _ann(spark, d):
    """The index of all vectors, every fiftieth as a query, and how many lists to probe for a recall of 0.95 at 10."""
    v, q = (x.drop("label") for x in _vectors(spark, d))
    made = ivf.build(v, "vec_id")
    made = ivf.Ivf(made.key, made.centroids, made.lists.cache())
    return made, v, q, ivf.probes_for(made, v, 0.95)


@query()
def ann_topk(spark, d):
    """Ten neighbours of each query out of the lists it probes. What it finds depends on learnt centroids, so there is no SQL: ann_recall holds it
    against exact search."""
    made, _, q, probes = _ann(spark, d)
    return ivf.search(made, q, 10, probes)


@query()
def ann_recall(spark, d):
    """recall at 10 of ann_topk against dense_topk, lists, probes, and the share of the vectors that a query reads."""
    made, v, q, probes = _ann(spark, d)
    found = ivf.recall(ivf.search(made, q, 10, probes), search.dense(v, q, top=10), "vec_id").join(ivf.probed_share(made, q, probes), F.lit(True))
    return found.select(F.round("recall", 4).alias("recall"), F.lit(len(made.centroids)).alias("lists"), F.lit(probes).alias("probes"), F.round("share", 4).alias("share"))


def _cosine_sql(top: int, name: str) -> str:
    """name (query_id, doc_id, rank, score): the best documents of each passage by the cosine of hashed features."""
    return f"""{_hashed_sql("SELECT item_id, text FROM benchmark", "item_id", "q_")}, {_hashed_sql("SELECT doc_id, text FROM documents", "doc_id", "d_")},
dots AS (SELECT item_id, doc_id, sum(q.value * d.value) AS x FROM q_unit q JOIN d_unit d USING (bucket) GROUP BY ALL),
{name} AS (SELECT * FROM (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id)::INTEGER AS rank, score
  FROM (SELECT b.item_id AS query_id, d.doc_id, round(coalesce(x, 0), 4) AS score FROM benchmark b CROSS JOIN documents d LEFT JOIN dots USING (item_id, doc_id))) WHERE rank <= {top})"""


@query(f"WITH RECURSIVE {_CRC}, {_cosine_sql(5, 'best')} SELECT * FROM best")
def hash_cosine_topk(spark, d):
    return search.hashed(_docs(spark, d), "doc_id", _asked(spark, d), top=5)


# --- rankings -------------------------------------------------------------------------------


def _bm25_sql(tokens, mean: str, top: int, name: str = "bm25", scope: bool = False) -> str:
    decimals = 5 if tokens is _words else 9
    s, part = ("source, ", "PARTITION BY source") if scope else ("", "")
    on = "USING (term, source)" if scope else "USING (term)"
    asked = "SELECT item_id, source, text FROM benchmark, (SELECT DISTINCT source FROM documents)" if scope else "SELECT item_id, text FROM benchmark"
    return f"""{name}_t AS (SELECT doc_id, {s}{tokens("coalesce(text, '')")} AS t FROM documents),
{name}_l AS (SELECT doc_id, {s}len(t) AS dl, count(*) OVER ({part}) AS n, avg(len(t)) OVER ({part}) AS a FROM {name}_t),
{name}_p AS (SELECT doc_id, {s}term, count(*) AS tf FROM (SELECT doc_id, {s}unnest(t) AS term FROM {name}_t) GROUP BY ALL),
{name}_d AS (SELECT term, {s}count(*) AS df FROM {name}_p GROUP BY ALL),
{name}_q AS (SELECT DISTINCT item_id, {s}unnest({tokens("text")}) AS term FROM ({asked})),
{name}_s AS (SELECT item_id AS query_id, p.doc_id, {s}round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / ({mean})))), {decimals}) AS score
  FROM {name}_q JOIN {name}_d {on} JOIN {name}_p p {on} JOIN (SELECT doc_id, dl, n, a FROM {name}_l) USING (doc_id) GROUP BY ALL),
{name} AS (SELECT * FROM (SELECT query_id, {s}doc_id, row_number() OVER (PARTITION BY {s}query_id ORDER BY score DESC, doc_id)::INTEGER AS rank, score FROM {name}_s WHERE score > 0) WHERE rank <= {top})"""


_LIVE, _STEMMED = "a + 1e-5", "CASE WHEN a > 0 THEN a ELSE 1 END"


@query(f"WITH {_bm25_sql(_tok, _STEMMED, 5)} SELECT * FROM bm25")
def bm25_stemmed_topk(spark, d):
    return search.bm25(index.build(_docs(spark, d), "doc_id", "stemmed"), _asked(spark, d), 5)


@query(f"WITH {_bm25_sql(_words, _LIVE, 5)} SELECT * FROM bm25")
def bm25_live_topk(spark, d):
    return search.bm25(index.build(_docs(spark, d), "doc_id", "live"), _asked(spark, d), 5)


@query(f"WITH {_bm25_sql(_spaces, _LIVE, 5)} SELECT * FROM bm25")
def bm25_ws_topk(spark, d):
    return search.bm25(index.build(_docs(spark, d), "doc_id", "space"), _asked(spark, d), 5)


@query(f"""WITH {_bm25_sql(_words, _LIVE, 3, scope=True)} SELECT source, query_id, doc_id, rank, score FROM bm25""")
def bm25_scoped_topk(spark, d):
    """Statistics of each scope apart: a query for each passage and source."""
    docs = _docs(spark, d, "source")
    sources = docs.select("source").distinct()
    asked = _asked(spark, d).withColumnRenamed("query_id", "item").join(sources.withColumn("k", F.lit(1)), F.lit(True)).drop("k")
    q = asked.select(F.concat_ws("/", F.col("item").cast("string"), "source").alias("query_id"), "query", "source", "item")
    found = search.bm25(index.build(docs, "doc_id", "live", "source"), q.select("query_id", "query", "source"), 3)
    return found.withColumns({"source": F.substr("query_id", F.instr("query_id", "/") + 1), "item": F.substring_index("query_id", "/", 1).cast("long")}).select("source", F.col("item").alias("query_id"), "doc_id", "rank", "score")


@query(f"WITH {_bm25_sql(_words, _LIVE, 5)} SELECT * FROM bm25")
def bm25_pruned_topk(spark, d):
    """What bm25_live_topk finds, out of blocks of postings, few of which are scored."""
    made = blockmax.build(index.build(_docs(spark, d), "doc_id", "live"))
    # bounds, leading regions and the others read the blocks in turn, so they are made once
    return blockmax.bm25(replace(made, blocks=kept(made.blocks, "blocks"), stats=kept(made.stats, "stats")), _asked(spark, d), 5)


def _rankings(spark, d, top=30):
    docs, asked = _docs(spark, d), _asked(spark, d)
    return search.bm25(index.build(docs, "doc_id", "stemmed"), asked, top), search.bm25(index.build(docs, "doc_id", "live"), asked, top)


_BOTH_SQL = f"{_bm25_sql(_tok, _STEMMED, 30, 'ra')}, {_bm25_sql(_words, _LIVE, 30, 'rb')}"


@query(f"""WITH {_BOTH_SQL}, u AS (SELECT query_id, doc_id, 2.0 / (60 + rank) AS s FROM ra UNION ALL SELECT query_id, doc_id, 1.0 / (60 + rank) FROM rb)
SELECT query_id, doc_id, round(sum(s), 9) AS rrf FROM u GROUP BY ALL""")
def rrf_fuse(spark, d):
    a, b = _rankings(spark, d)
    return search.reciprocal_rank_fusion([a, b], "doc_id", weights=[2.0, 1.0]).withColumn("rrf", F.round("rrf", 9))


_MERGED_SQL = """f AS (SELECT coalesce(ra.query_id, rb.query_id) AS query_id, coalesce(ra.doc_id, rb.doc_id) AS doc_id, ra.rank AS dense_rank, ra.score AS dense_score, rb.rank AS sparse_rank, rb.score AS sparse_score,
  round(coalesce(1.0::DOUBLE / (60 + ra.rank), 0) + coalesce(1.0::DOUBLE / (60 + rb.rank), 0), 9) AS rrf FROM ra FULL JOIN rb ON ra.query_id = rb.query_id AND ra.doc_id = rb.doc_id),
fused AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rrf DESC, dense_rank ASC NULLS LAST, sparse_rank ASC NULLS LAST, doc_id)::INTEGER AS fused_rank FROM f) WHERE fused_rank <= 30)"""
_FUSED_SQL = f"{_BOTH_SQL}, {_MERGED_SQL}"


@query(f"WITH {_FUSED_SQL} SELECT * FROM fused")
def hybrid_full_outer(spark, d):
    a, b = _rankings(spark, d)
    return search.fused(a, b, "doc_id")


def _share(q: str, t: str) -> str:
    return f"CASE WHEN len({q}) = 0 THEN 0.0 ELSE len(list_intersect({q}, {t}))::DOUBLE / len({q}) END"


def _pairs(t: str) -> str:
    return f"list_distinct(CASE WHEN len({t}) < 2 THEN [] ELSE list_transform(range(1, len({t})), lambda i: {t}[i] || ' ' || {t}[i + 1]) END)"


_RERANKED_SQL = f"""x AS (SELECT f.*, {_tok("b.text")} AS q, {_tok("d.text")} AS t FROM fused f JOIN benchmark b ON b.item_id = f.query_id JOIN documents d ON d.doc_id = f.doc_id),
y AS (SELECT * EXCLUDE (q, t), round({_share("list_distinct(q)", "list_distinct(t)")} + 0.5 * ({_share(_pairs("q"), _pairs("t"))}), 4) AS score FROM x),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, fused_rank)::INTEGER AS rank FROM y) WHERE rank <= 5)"""


@query(f"WITH {_FUSED_SQL}, {_RERANKED_SQL} SELECT query_id, doc_id, rank, score FROM best")
def lexical_rerank(spark, d):
    a, b = _rankings(spark, d)
    return search.reranked(search.fused(a, b, "doc_id"), _docs(spark, d), _asked(spark, d), "doc_id", 5).select("query_id", "doc_id", "rank", "score")


@query(f"WITH RECURSIVE {_CRC}, {_cosine_sql(30, 'ra')}, {_bm25_sql(_words, _LIVE, 30, 'rb')}, {_MERGED_SQL}, {_RERANKED_SQL} SELECT query_id, doc_id, rank, score, rrf, dense_rank, sparse_rank FROM best")
def hybrid_search(spark, d):
    docs = _docs(spark, d)
    return search.hybrid(docs, "doc_id", index.build(docs, "doc_id", "live"), _asked(spark, d)).select("query_id", "doc_id", "rank", "score", "rrf", "dense_rank", "sparse_rank")


@query(f"""WITH {_bm25_sql(_words, _LIVE, 30)}, k AS (SELECT * FROM bm25 WHERE doc_id IN (SELECT doc_id FROM documents WHERE lang = 'en'))
SELECT * FROM (SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY rank)::INTEGER AS rank FROM k) WHERE rank <= 5""")
def post_filter_docs(spark, d):
    found = search.bm25(index.build(_docs(spark, d), "doc_id", "live"), _asked(spark, d), 30)
    return search.in_documents(found, _t(spark, d, "documents").where("lang = 'en'").select("doc_id"), 5)


_MATCHES_SQL = f"""words AS (SELECT doc_id, l[i] AS w, i AS pos FROM (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS i FROM (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS l FROM documents))),
stems AS (SELECT doc_id, pos, {STEM.replace("(t)", "(w)").replace("t LIKE", "w LIKE").replace("t NOT", "w NOT").replace("t[", "w[").replace("ELSE t END", "ELSE w END")} AS term FROM words WHERE NOT list_contains({_sql_list(patterns.STOPWORDS)}, w)),
asked AS (SELECT DISTINCT item_id AS query_id, unnest({_tok("text")}) AS term FROM benchmark),
hits AS (SELECT query_id, doc_id, term, pos FROM asked JOIN stems USING (term)),
many AS (SELECT query_id, doc_id, count(DISTINCT term) AS held, count(*) AS n FROM hits GROUP BY ALL)"""

# the shortest stretch from each match on that has all terms; a cover where none that starts later ends as soon
_COVERS_SQL = """after AS (SELECT a.query_id, a.doc_id, a.pos AS start, b.term, min(b.pos) AS reached FROM hits a JOIN hits b ON a.query_id = b.query_id AND a.doc_id = b.doc_id AND b.pos >= a.pos GROUP BY ALL),
stretch AS (SELECT query_id, doc_id, start, max(reached) AS stop, count(*) AS terms FROM after GROUP BY ALL),
whole AS (SELECT s.*, held, lead(stop) OVER (PARTITION BY query_id, doc_id ORDER BY start) AS later FROM stretch s JOIN many USING (query_id, doc_id) WHERE terms = held),
cover AS (SELECT query_id, doc_id, held, start, stop FROM whole WHERE later IS NULL OR later > stop),
valued AS (SELECT c.query_id, c.doc_id, held, 0.1::DOUBLE / (1 + stop - start + 1 - count(*)) AS v FROM cover c JOIN hits h ON h.query_id = c.query_id AND h.doc_id = c.doc_id AND h.pos BETWEEN start AND stop GROUP BY c.query_id, c.doc_id, held, start, stop)"""


def _full_text_sql(scores: str) -> str:
    return f"SELECT * FROM (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id)::INTEGER AS rank, score FROM ({scores})) WHERE rank <= 5"


def _full_text(spark, d, match):
    return fulltext.cover_density(fulltext.positions(_docs(spark, d), "doc_id"), _asked(spark, d), "doc_id", 5, match)


@query(f"WITH {_MATCHES_SQL}, {_COVERS_SQL} {_full_text_sql('SELECT query_id, doc_id, round(held + sum(v) / (1 + sum(v)), 6) AS score FROM valued GROUP BY query_id, doc_id, held')}")
def cover_density_topk(spark, d):
    return _full_text(spark, d, "most")


@query(f"WITH {_MATCHES_SQL}, {_COVERS_SQL} {_full_text_sql('SELECT query_id, doc_id, round(sum(v), 6) AS score FROM valued JOIN (SELECT query_id, count(*) AS held FROM asked GROUP BY ALL) USING (query_id, held) GROUP BY ALL')}")
def cover_density_all_topk(spark, d):
    return _full_text(spark, d, "all")


@query(f"WITH {_MATCHES_SQL} {_full_text_sql('SELECT query_id, doc_id, round(0.1::DOUBLE * n, 6) AS score FROM many')}")
def full_text_or_topk(spark, d):
    return _full_text(spark, d, "any")


@query(f"""WITH t AS (SELECT doc_id, {_tok("text")} AS t FROM documents), p AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(t) AS term FROM t) GROUP BY ALL),
s AS (SELECT item_id AS query_id, doc_id, round(sum(tf) / (1 + ln(len(t))), 4) AS score FROM (SELECT DISTINCT item_id, unnest({_tok("text")}) AS term FROM benchmark) JOIN p USING (term) JOIN t USING (doc_id) GROUP BY item_id, doc_id, t)
SELECT * FROM (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id)::INTEGER AS rank, score FROM s) WHERE rank <= 5""")
def overlap_topk(spark, d):
    return search.overlap_search(_docs(spark, d), "doc_id", _asked(spark, d), 5)


@query(f"""WITH {_bm25_sql(_words, _LIVE, 5)}, g AS (SELECT query_id, min(rank) AS r FROM bm25 JOIN documents d USING (doc_id) JOIN benchmark b ON b.item_id = query_id WHERE contains(d.text, b.text) GROUP BY 1)
SELECT count(*) AS n, round(avg(CASE WHEN r = 1 THEN 1.0 ELSE 0.0 END), 6) AS hit_1, round(avg(CASE WHEN r IS NOT NULL THEN 1.0 ELSE 0.0 END), 6) AS hit_k, round(avg(coalesce(1.0 / r, 0)), 6) AS mrr FROM benchmark LEFT JOIN g ON g.query_id = item_id""")
def eval_hit_mrr(spark, d):
    docs, asked = _docs(spark, d), _asked(spark, d)
    found = search.bm25(index.build(docs, "doc_id", "live"), asked, 5)
    gold = found.join(docs, "doc_id").join(asked, "query_id").where(F.contains("text", F.col("query"))).select("query_id", "doc_id")
    return evaluate.hits(found, gold, asked)


@query(f"""WITH RECURSIVE {_CRC}, {_cosine_sql(30, "ra")}, {_bm25_sql(_words, _LIVE, 30, "rb")}, {_MERGED_SQL},
r AS (SELECT 'dense' AS mode, query_id, doc_id, rank FROM ra UNION ALL SELECT 'sparse', query_id, doc_id, rank FROM rb UNION ALL SELECT 'hybrid', query_id, doc_id, fused_rank FROM fused),
g AS (SELECT mode, query_id, min(rank) AS r FROM r JOIN documents d USING (doc_id) JOIN benchmark b ON b.item_id = query_id WHERE rank <= 5 AND contains(d.text, b.text) GROUP BY ALL)
SELECT mode, count(*) AS n, round(avg(CASE WHEN r = 1 THEN 1.0 ELSE 0.0 END), 6) AS hit_1, round(avg(CASE WHEN r IS NOT NULL THEN 1.0 ELSE 0.0 END), 6) AS hit_k, round(avg(coalesce(1.0 / r, 0)), 6) AS mrr
FROM (SELECT unnest(['dense', 'sparse', 'hybrid']) AS mode, item_id AS query_id FROM benchmark) LEFT JOIN g USING (mode, query_id) GROUP BY mode""")
def eval_modes(spark, d):
    """Hits of dense, sparse and fused search, before reranking: a document answers a passage that it holds."""
    docs, asked = _docs(spark, d), _asked(spark, d)
    # each ranking is used for its own hits and for the fused ones; as tables of some rows they meet texts without a shuffle of these
    dense, sparse = kept(search.hashed(docs, "doc_id", asked, 30), "dense"), kept(search.bm25(index.build(docs, "doc_id", "live"), asked, 30), "sparse")
    both = search.fused(dense, sparse, "doc_id").select("query_id", "doc_id", F.col("fused_rank").alias("rank"))
    ranks = None
    for mode, found in (("dense", dense), ("sparse", sparse), ("hybrid", both)):
        one = found.where("rank <= 5").select(F.lit(mode).alias("mode"), "query_id", "doc_id", "rank")
        ranks = one if ranks is None else ranks.unionByName(one)
    ranks = kept(ranks, "ranks")
    gold = kept(ranks.select("query_id", "doc_id").distinct().join(docs, "doc_id").join(asked, "query_id").where(F.contains("text", F.col("query"))).select("query_id", "doc_id"), "gold")
    out = None
    for mode in ("dense", "sparse", "hybrid"):
        one = evaluate.hits(ranks.where(F.col("mode") == mode).drop("mode"), gold, asked).select(F.lit(mode).alias("mode"), "*")
        out = one if out is None else out.unionByName(one)
    return out


@query("""WITH r AS (SELECT event_type, value AS t, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS p, count(*) OVER (PARTITION BY event_type) AS n FROM events WHERE value IS NOT NULL)
SELECT event_type, max(n) AS n, max(t) FILTER (p = n // 2) AS p50, max(t) FILTER (p = greatest(n * 95 // 100 - 1, 0)) AS p95 FROM r GROUP BY 1""")
def latency_percentiles(spark, d):
    return evaluate.latencies(_t(spark, d, "events"), "event_type", "value")


# --- graph ----------------------------------------------------------------------------------

_CAMEL, _CAPITALS = (patterns.ENTITY_PATTERNS[i].replace(r"\b", "") for i in (1, 2))
# RE2 knows word boundaries of ASCII only: other letters become underscores first
MENTIONS_SQL = f"""{CHUNKS_SQL}, plain AS (SELECT doc_id, chunk_no, regexp_replace(text, '[^\\x00-\\x7f]', '_', 'g') AS text FROM chunks),
hits AS ({" UNION ALL ".join(f"SELECT doc_id, chunk_no, {p} AS p, unnest(regexp_extract_all(text, '{pattern}', 1)) AS raw, generate_subscripts(regexp_extract_all(text, '{pattern}', 1), 1) AS i FROM plain" for p, pattern in enumerate(patterns.ENTITY_PATTERNS))}),
mentions AS (SELECT doc_id, chunk_no, p, i, trim(raw) AS raw, trim(regexp_replace(lower(raw), '\\s+', ' ', 'g')) AS key FROM hits WHERE length(trim(raw)) >= 3 AND NOT list_contains({_sql_list(sorted(set(patterns.ENTITY_STOPWORDS)))}, lower(trim(raw)))),
agg AS (SELECT doc_id, key, arg_min(raw, [-length(regexp_replace(raw, '[^A-Z]', '', 'g')), chunk_no, p, i]) AS text, arg_min(raw, [chunk_no, p, i]) AS first, count(*) AS freq, count(DISTINCT chunk_no) AS df FROM mentions GROUP BY ALL),
entities AS (SELECT doc_id, key, text, CASE WHEN regexp_matches(first, '(?i){patterns.PERSON_START}') THEN 'PERSON' WHEN regexp_matches(first, '{patterns.ORG_ENDING}') THEN 'ORG'
  WHEN regexp_matches(first, '(?i){patterns.TECH_ENDING}') OR regexp_full_match(first, '{_CAPITALS}') OR regexp_full_match(first, '{_CAMEL}') THEN 'TECH'
  WHEN len(string_split_regex(first, '\\s+')) > 1 AND len(list_filter(string_split_regex(first, '\\s+'), lambda w: NOT regexp_matches(w, '^[A-Z]'))) = 0 THEN 'CONCEPT' ELSE 'TERM' END AS etype, freq, df,
  round(freq / n * (ln((n + 1) / (df + 1)) + 1), 9) AS score FROM agg JOIN (SELECT doc_id, count(*) AS n FROM chunks GROUP BY 1) USING (doc_id)),
top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, key DESC)::INTEGER AS rank FROM entities) WHERE rank <= 80)"""
PAIRS_SQL = f"""{MENTIONS_SQL}, seen AS (SELECT DISTINCT doc_id, chunk_no, key FROM mentions JOIN top USING (doc_id, key)),
pairs AS (SELECT a.doc_id, a.key AS x, b.key AS y, count(*) AS n, min(a.chunk_no) AS f FROM seen a JOIN seen b ON a.doc_id = b.doc_id AND a.chunk_no = b.chunk_no AND a.key < b.key GROUP BY ALL),
edges AS (SELECT doc_id, substr(md5(x), 1, 12) AS source, substr(md5(y), 1, 12) AS target, w AS weight FROM (SELECT *, round(n / max(n) OVER (PARTITION BY doc_id), 3) AS w, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, f, x, y) AS p FROM pairs) WHERE p <= 150 AND w >= 0.04)"""


@query(f"WITH {MENTIONS_SQL} SELECT doc_id, key, text, etype, freq, df, score FROM entities")
def entities(spark, d):
    return graph.entities(_chunks(spark, d))


@query(f"WITH {MENTIONS_SQL} SELECT doc_id, key, rank, score FROM top")
def entity_topn(spark, d):
    return graph.top_entities(graph.entities(_chunks(spark, d))).select("doc_id", "key", "rank", "score")


def _nodes(spark, d):
    return graph.nodes(graph.top_entities(graph.entities(_chunks(spark, d))))


def _graph(spark, d):
    """Nodes and edges, from mentions that are found once."""
    c = _chunks(spark, d)
    found = kept(graph.mentions(c), "mentions")
    top = kept(graph.top_entities(graph.entities(c, found)), "top")
    return graph.nodes(top), graph.edges(graph.cooccurrences(c, top, found))


def _edges(spark, d):
    return _graph(spark, d)[1]


@query(f"WITH {MENTIONS_SQL} SELECT doc_id, substr(md5(key), 1, 12) AS node_id, key, text, etype, freq, rank FROM top")
def graph_nodes(spark, d):
    return _nodes(spark, d)


@query(f"WITH {PAIRS_SQL} SELECT * FROM edges")
def graph_edges(spark, d):
    return _edges(spark, d)


@query(f"WITH {PAIRS_SQL} SELECT doc_id, source AS node_id, target AS neighbour FROM edges UNION ALL SELECT doc_id, target, source FROM edges")
def neighbors(spark, d):
    return graph.neighbours(_edges(spark, d))


@query(f"WITH {MENTIONS_SQL} SELECT etype, count(*) AS n FROM top GROUP BY 1")
def type_counts(spark, d):
    return graph.type_counts(_nodes(spark, d))


@query(f"WITH {MENTIONS_SQL} SELECT doc_id, substr(md5(key), 1, 12) AS node_id, round(6 + CASE WHEN max(freq) OVER (PARTITION BY doc_id) <= 1 THEN 0.5 ELSE freq / max(freq) OVER (PARTITION BY doc_id) END * 14, 6) AS size FROM top")
def relative_sizes(spark, d):
    return graph.relative_size(_nodes(spark, d)).select("doc_id", "node_id", "size")


@query(f"""WITH {PAIRS_SQL}, n AS (SELECT doc_id, substr(md5(key), 1, 12) AS node_id FROM top WHERE etype IN ('TECH', 'CONCEPT', 'TERM') AND contains(lower(text), 'th'))
SELECT * FROM edges WHERE (doc_id, source) IN (SELECT (doc_id, node_id) FROM n) AND (doc_id, target) IN (SELECT (doc_id, node_id) FROM n)""")
def visible_edges(spark, d):
    nodes, edges = _graph(spark, d)
    return graph.visible_edges(edges, graph.filter_nodes(nodes, ["TECH", "CONCEPT", "TERM"], "TH"))


# the fixed keywords, and words that the documents have
WORDS_OF_GRAPH = [*patterns.GRAPH_KEYWORDS, "the", "The", "and", "token", "de", "que", "der", "die", "le"]
_KEYWORDS = _sql_list(WORDS_OF_GRAPH)
_KEYED = {False: f"SELECT doc_id, chunk_no, unnest(list_filter(regexp_extract_all(regexp_replace(text, '[^\\x00-\\x7f]', '_', 'g'), '\\b[A-Za-z0-9.\\-]+\\b'), lambda w: list_contains({_KEYWORDS}, w))) AS key FROM chunks", True: f"SELECT doc_id, chunk_no, unnest(list_filter(list_transform(regexp_extract_all(text, '\\S+'), lambda w: regexp_replace(w, '^[^\\pL\\pN]+|[^\\pL\\pN]+$', '', 'g')), lambda w: list_contains({_KEYWORDS}, w))) AS key FROM chunks"}


@query(f"WITH {CHUNKS_SQL} SELECT key, count(*) AS freq FROM ({_KEYED[False]}) GROUP BY 1")
def keyword_nodes(spark, d):
    return graph.keyword_nodes(_chunks(spark, d), keywords=WORDS_OF_GRAPH)


@query(f"WITH {CHUNKS_SQL} SELECT key, count(*) AS freq FROM ({_KEYED[True]}) GROUP BY 1")
def keyword_nodes_ws(spark, d):
    return graph.keyword_nodes(_chunks(spark, d), True, WORDS_OF_GRAPH)


@query(f"WITH {CHUNKS_SQL}, s AS (SELECT DISTINCT * FROM ({_KEYED[False]})) SELECT a.key AS source, b.key AS target, count(*) AS weight FROM s a JOIN s b ON a.doc_id = b.doc_id AND a.chunk_no = b.chunk_no AND a.key < b.key GROUP BY ALL")
def keyword_edges(spark, d):
    return graph.keyword_edges(_chunks(spark, d), keywords=WORDS_OF_GRAPH)


# --- document tools -------------------------------------------------------------------------


@query("SELECT DISTINCT doc_id, kind, value FROM (" + " UNION ALL ".join(f"SELECT doc_id, '{k}' AS kind, unnest(regexp_extract_all(regexp_replace(text, '[^\\x00-\\x7f]', '_', 'g'), '{p}')) AS value FROM documents" for k, p in patterns.SENSITIVE.items() if k != "emails") + f" UNION ALL SELECT doc_id, 'emails', unnest(regexp_extract_all(text, '{patterns.SENSITIVE['emails']}')) FROM documents)")
def sensitive_scan(spark, d):
    return _docs(spark, d).select("doc_id", F.explode(T.sensitive(F.col("text"))).alias("x")).select("doc_id", "x.kind", "x.value")


@query("SELECT doc_id, regexp_replace(regexp_replace(text, '(?i)the', '███', 'g'), '(?i)e\\.', '██', 'g') AS text FROM documents")
def redact_terms(spark, d):
    return _docs(spark, d).select("doc_id", T.redact(F.col("text"), ["the", "e."]).alias("text"))


_TABLES_SQL = """tabs AS (SELECT p_brand AS doc_id, p_size AS page_no, list([p_partkey::VARCHAR, p_name, CASE WHEN p_partkey % 7 <> 0 THEN p_type END] ORDER BY p_partkey) AS b FROM part GROUP BY ALL)"""


@query(f"""WITH {_TABLES_SQL}, h AS (SELECT doc_id, page_no, string_split(b[1][2], ' ') AS h FROM tabs), c AS (SELECT doc_id, page_no, unnest(h) AS name, generate_subscripts(h, 1) AS i FROM h)
SELECT doc_id, name AS "column", row_number() OVER (PARTITION BY doc_id ORDER BY min([page_no, i]))::INTEGER AS place FROM c WHERE name <> '' GROUP BY 1, 2""")
def table_columns(spark, d):
    """Headers that differ from table to table: the words of the first part's name."""
    head = F.split(F.get(F.get("rows", F.lit(1)), F.lit(1)), " ")
    return tables.columns(_tables(spark, d).withColumn("rows", F.concat(F.array(head), F.slice("rows", 2, F.size("rows")))))


@query(r"""SELECT p_brand AS doc_id, p_size AS page_no, row_number() OVER (PARTITION BY p_brand, p_size ORDER BY p_partkey)::INTEGER AS row_no, coalesce(CASE WHEN p_partkey % 7 <> 0 THEN trim(regexp_replace(p_type, '\s+', ' ', 'g')) END, '') AS "Type", '' AS "None", p_partkey::VARCHAR AS "Part key" FROM part""")
def table_project(spark, d):
    return tables.project(_tables(spark, d), ["Type", "None", "Part key"]).select("doc_id", "page_no", "row_no", "Type", "None", "Part key")


@query(f"""WITH {_TABLES_SQL}, r AS (SELECT doc_id, page_no, unnest(list_concat([['Part  key', 'Name', 'Type']], b, [[]])) AS c, generate_subscripts(list_concat([['Part  key', 'Name', 'Type']], b, [[]]), 1) AS i FROM tabs)
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY page_no, i)::INTEGER AS line_no, array_to_string(list_transform(c, lambda x: coalesce(x, '')), '|') AS cells FROM r""")
def table_sheet(spark, d):
    return tables.sheet(_tables(spark, d)).select("doc_id", "line_no", F.array_join("cells", "|").alias("cells"))


@query(f"""WITH {_TABLES_SQL} SELECT doc_id, page_no, len(b)::INTEGER AS n, md5(array_to_string(list_transform(b, lambda r: r[1]), '|')) AS body FROM tabs""")
def table_mask(spark, d):
    rows = F.slice("rows", 2, F.size("rows"))
    hidden = tables.mask(_tables(spark, d), ["NAME", "type"])
    return hidden.select("doc_id", "page_no", (F.size("rows") - 1).alias("n"), F.md5(F.array_join(F.flatten(rows), "|")).alias("body"))


def _events(spark, d):
    return _as_progress(_t(spark, d, "events"))


def _as_progress(events):
    stages = {"view": "parsing", "click": "embedding", "signup": "graphing", "purchase": "done", "error": "error"}
    stage = F.create_map(*[F.lit(x) for kv in stages.items() for x in kv])[F.col("event_type")]
    return events.select((F.col("user_id") % 20).alias("batch_id"), F.col("user_id").alias("doc_id"), F.col("event_id").alias("seq"), stage.alias("stage"), (F.col("event_id") % 7).alias("processed"), F.lit(7).alias("total"), F.when(F.col("event_type") == "error", F.concat(F.lit("event "), F.col("event_id").cast("string"))).alias("error"))


_LATEST_SQL = """l AS (SELECT user_id % 20 AS batch_id, user_id AS doc_id, arg_max(event_type, event_id) AS s, max(event_id) AS e FROM events GROUP BY ALL),
p AS (SELECT *, CASE s WHEN 'view' THEN 8.0 WHEN 'click' THEN 35 + 50.0 * (e % 7) / 7 WHEN 'signup' THEN 90.0 WHEN 'purchase' THEN 100.0 ELSE 0.0 END::DOUBLE AS pct FROM l)"""


@query(f"WITH {_LATEST_SQL} SELECT batch_id, count(*) AS docs, bool_and(s IN ('purchase', 'error')) AS done, round(avg(pct), 1) AS pct FROM p GROUP BY 1")
def progress_snapshot(spark, d):
    return progress.snapshot(_events(spark, d))


@query(f"WITH {_LATEST_SQL} SELECT batch_id, count(*) FILTER (s = 'purchase') AS done_docs, CASE WHEN count(*) FILTER (s = 'purchase') = 0 THEN 'event ' || arg_min(e, doc_id) FILTER (s = 'error') END AS error FROM p GROUP BY 1")
def progress_outcome(spark, d):
    return progress.outcome(_events(spark, d))


@query(f"""WITH {_LATEST_SQL} SELECT batch_id, count(*) AS docs, bool_and(s IN ('purchase', 'error')) AS done, round(avg(pct), 1) AS pct, count(*) FILTER (s = 'purchase') AS done_docs,
  CASE WHEN count(*) FILTER (s = 'purchase') = 0 THEN 'event ' || arg_min(e, doc_id) FILTER (s = 'error') END AS error, (SELECT count(*) FROM events x WHERE x.user_id % 20 = p.batch_id) AS seen FROM p GROUP BY 1""")
def progress_stream(spark, d):
    """The same of a stream: events are folded file by file, and the last snapshot of each batch is read back."""
    kept = scratch(spark, "progress")
    # a stream reads folders, so a table that is one file is named by a pattern
    events = settled(spark).readStream.schema(_t(spark, d, "events").schema).option("maxFilesPerTrigger", 8).parquet(f"{d}/events.parque[t]")
    with progress.rocksdb(spark):
        told = progress.snapshots(_as_progress(events)).writeStream.outputMode("update").foreachBatch(lambda rows, _: rows.write.mode("append").parquet(f"{kept}/rows"))
        told.option("checkpointLocation", f"{kept}/state").trigger(availableNow=True).start().awaitTermination()
    rows = spark.read.parquet(f"{kept}/rows")
    return rows.groupBy("batch_id").agg(F.max_by(F.struct("docs", "done", "pct", "done_docs", "error", "seen"), "seen").alias("s")).select("batch_id", "s.*")


@query(f"WITH {PAGES_SQL}, {CHUNKS_SQL} SELECT d.doc_id, coalesce(p.n, 0) AS n_pages, coalesce(c.n, 0) AS n_chunks FROM documents d LEFT JOIN (SELECT doc_id, count(*) AS n FROM pages GROUP BY 1) p USING (doc_id) LEFT JOIN (SELECT doc_id, count(*) AS n FROM chunks GROUP BY 1) c USING (doc_id)")
def document_list(spark, d):
    return list_documents(_docs(spark, d), _pages(spark, d), _chunks(spark, d))


@query(rf"""WITH {PAGES_SQL}, w AS (SELECT doc_id, page_no, list_filter(string_split_regex(text, '[ \t\n\x0b\f\r]+'), lambda x: x <> '') AS w FROM pages),
box AS (SELECT doc_id, page_no, list_transform(range(1, len(w)), lambda i: [{{'x0': (i % 12 * 40)::DOUBLE, 'y0': (i // 12 * 6 + length(w[i + 1]) % 5)::DOUBLE, 'x1': (i % 12 * 40 + length(w[i + 1]))::DOUBLE, 'y1': (i // 12 * 6 + length(w[i + 1]) % 5 + 10)::DOUBLE}}]) AS b FROM w WHERE len(w) > 1),
merged AS (SELECT doc_id, page_no, unnest(list_reduce(b, lambda a, x: CASE WHEN abs(x[1].y0 - a[-1].y0) <= 3 THEN list_concat(a[:-2], [{{'x0': least(a[-1].x0, x[1].x0), 'y0': least(a[-1].y0, x[1].y0), 'x1': greatest(a[-1].x1, x[1].x1), 'y1': greatest(a[-1].y1, x[1].y1)}}]) ELSE list_concat(a, x) END)) AS r FROM box)
SELECT doc_id, page_no, r.x0 * 2 - 1 AS "left", r.y0 * 2 - 1 AS top, (r.x1 - r.x0) * 2 + 2 AS width, (r.y1 - r.y0) * 2 + 2 AS height FROM merged""")
def word_rects(spark, d):
    """Words of each whole page, twelve to a row of a grid, with tops that depend on their lengths and may fall into a line with those of the row before."""
    words = F.filter(F.split("text", r"\s+"), lambda w: w != "")
    top = lambda w, i: F.floor(i / 12) * 6.0 + F.length(w) % 5
    box = F.transform(words, lambda w, i: F.struct(w.alias("text"), (i % 12 * 40.0).alias("x0"), top(w, i).alias("y0"), (i % 12 * 40.0 + F.length(w)).alias("x1"), (top(w, i) + 10).alias("y1"), (i * 5).alias("start"), (i * 5 + 4).alias("end")))
    rects = layout.line_rects(layout.overlapping(box, F.lit(5), F.lit(2**31 - 1)))
    return _pages(spark, d).select("doc_id", "page_no", F.explode(layout.scaled(rects, F.lit(480.0), F.lit(960.0))).alias("r")).select("doc_id", "page_no", "r.*")


@query("SELECT event_id, (abs(value / 100) > 0.05 AND abs(value / 200) > 0.05) OR event_type = 'error' OR value / 100 < 0.6 AS mark FROM events WHERE value IS NOT NULL")
def watermark_predicate(spark, d):
    text = F.when(F.col("event_type") == "error", "Confidential draft").otherwise(F.col("event_type"))
    return _t(spark, d, "events").where("value is not null").select("event_id", T.is_watermark(text, F.col("value") / 100, F.col("value") / 200, F.col("value") / 100).alias("mark"))
