"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns, for every operator and stage."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from paperloom.llm import alignment, bpe, convolution, html, jaccard, language_model, merkle, packing, pii, quality, substrings, suffixes, topk

LONG = " ".join(f"word{i % 977}x{i % 31}" for i in range(60_000))
ROWS = [
    (1, LONG, "en", "s", 0),
    (2, LONG, "en", "s", 0),
    (3, None, "en", None, 0),
    (4, "", None, "s", 0),
    (5, " \n\t ", "en", "s", 0),
    (6, "one two", "en", "s", 0),
    (6, "one two", "en", "s", 0),
    (None, "one two three four five six", "en", "s", None),
    (7, "x" * 200_000, "en", "s", 0),
    (8, "Ünïcödé 日本語 🙂 one two three", "en", "s", 0),
]
TYPES = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def docs(spark):
    clash = ["tree", "block", "at", "digest", "level", "place", "total", "side", "chunk", "deal", "ids", "score", "quality", "one", "part", "kind", "body", "size", "n", "a", "b", "component_id", "cluster", "n_values", "kept", "bundle", "row", "h", "word"]
    return spark.createDataFrame(ROWS, TYPES).select("*", *[F.lit(1).alias(c) for c in clash]).repartition(3).cache()


OPERATORS = {
    "jaccard": jaccard.jaccard_join,
    "lm": lambda d: language_model.score_documents(d, language_model.Training(rounds=1)),
    "pii": pii.pseudonymise,
    "quality": quality.quality_rules,
    "suffixes": suffixes.suffix_array_dedup,
    "without_repeats": suffixes.without_repeats,
    "substrings": substrings.substring_dedup,
    "packing": lambda d: packing.best_fit_packing(d, packing.default_tokenizer()),
    "alignment": alignment.tokenizer_alignment,
    "convolution": lambda d: convolution.quality_scores(d, d.selectExpr("doc_id", "cast(doc_id % 2 as int) quality"), convolution.Training(steps=4, epochs=1)),
    "merkle": merkle.merkle_manifest,
    "bpe": lambda d: bpe.encode(d, bpe.default_ranks(), bpe.default_pattern()),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_odd_rows_keep_their_place(spark, docs, name):
    got = OPERATORS[name](docs).collect()
    ids = [r["doc_id"] for r in got]
    if name == "packing":
        ids = [r["doc_id"] for r in got if r["piece"] == 0]
    assert sorted(ids, key=lambda x: (x is None, x)) == [1, 2, 3, 4, 5, 6, 6, 7, 8, None]


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_table(spark, name):
    out = OPERATORS[name](spark.createDataFrame([], TYPES))
    assert out.count() == 0


@pytest.mark.parametrize("name", ["jaccard", "substrings", "suffixes", "quality", "packing", "bpe", "pii", "alignment", "convolution", "merkle"])
def test_all_null(spark, name):
    out = OPERATORS[name](spark.createDataFrame([(None, None, None, None, None)] * 2, TYPES))
    assert out.count() == 2


def test_defined_results(spark, docs):
    j = {r["doc_id"]: r for r in jaccard.jaccard_join(docs).collect()}
    assert j[2]["component_id"] == 1 and j[4]["component_id"] == 4 and j[4]["n_shingles"] == 0 and j[None]["component_id"] is None and j[6]["n_shingles"] == 1
    s = {r["doc_id"]: r for r in suffixes.suffix_array_dedup(docs).collect()}
    assert s[1]["n_removed"] == s[2]["n_removed"] == len(LONG) and s[7]["n_removed"] == 200_000 and s[None]["n_removed"] == 0
    w = {r["doc_id"]: r for r in substrings.substring_dedup(docs).collect()}
    assert w[1]["n_removed"] == 0 and w[2]["n_removed"] == 60_000 and w[None]["n_removed"] == 0
    p = [r for r in packing.best_fit_packing(docs, packing.default_tokenizer()).collect() if r["doc_id"] in (3, 4, 5)]
    assert [r["length"] for r in p] == [1, 1, 1]


@pytest.mark.parametrize("stage", [s for s in corpus_pipeline.STAGES], ids=lambda s: s[0])
def test_stages(spark, docs, stage):
    name, f = stage
    out = f(spark, docs, "")
    if name != "best-fit packing":
        assert out.columns == list(corpus_pipeline.COLUMNS)
    assert out.count() >= (0 if name == "quality rules" else 1)
    assert f(spark, spark.createDataFrame([], TYPES), "").count() == 0


def test_pages_edges(spark):
    rows = [(1, None, None), (2, "http://h.org/a", ""), (3, "http://h.org/b", "no tags"), (3, "http://h.org/b", "no tags"), (None, "x", "<p>a<p>b"), (4, "http://h.org/c", "<div><" + "x" * 100_000 + "<p>&amp;&#233;</p>")]
    out = html.extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("host", F.lit(1))).collect()
    text = {r["page_id"]: r["text"] for r in out}
    assert len(out) == 6 and text[1] == text[2] == "" and text[3] == "no tags" and text[None] == "a\nb"
    assert html.extract_main_text(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_vector_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, None), (4, [nan, 1.0]), (5, [inf, 1.0]), (6, [None, 1.0]), (7, [1.0]), (8, [-0.5, 0.25]), (None, [1.0, 1.0]), (50, [0.0, 0.0]), (100, None)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("label", F.lit(1))
    got = {(r["query_id"], r["rank"]): (r["vec_id"], r["score"]) for r in topk.exact_top_k(df, F.col("vec_id") % 50 == 0, 3).collect()}
    assert got == {(0, 1): (1, 65536), (0, 2): (2, 65536), (0, 3): (50, 0), (50, 1): (0, 0), (50, 2): (1, 0), (50, 3): (2, 0)}
    assert topk.exact_top_k(df.limit(0), F.col("vec_id") % 50 == 0).count() == 0
