from pyspark.sql import functions as F

from paperloom.functions import text as T


def one(spark, text, use):
    return spark.createDataFrame([(text,)], "t string").select(use(F.col("t")).alias("x")).first()["x"]


def test_tokenize_drops_stop_words_before_stemming(spark):
    assert one(spark, "The studies of Running dogs and being passed", T.tokenize) == ["study", "runn", "dog", "pass"]


def test_stem_takes_one_rule_from_a_least_length(spark):
    for word, stem in (("ties", "tie"), ("flies", "fly"), ("ring", "ring"), ("sing", "sing"), ("bring", "bring"), ("caring", "car"), ("red", "red"), ("shed", "shed"), ("asked", "ask"), ("gas", "gas"), ("glass", "glass"), ("cars", "car")):
        assert one(spark, word, T.stem) == stem


def test_unicode_words_and_spaces(spark):
    assert one(spark, "Été_1, ñandú!", T.word_tokens) == ["été_1", "ñandú"]
    assert one(spark, " a\t b\n\nc ", T.normalize_space) == "a b c"
    assert one(spark, " a\t b\n\nc ", T.count_tokens) == 3
    assert one(spark, "", T.normalize_space) == ""


def test_bigrams_of_short_lists_are_none(spark):
    assert one(spark, "turbine", lambda t: T.bigrams(T.tokenize(t))) == []
    assert one(spark, "big turbine pump", lambda t: T.bigrams(T.tokenize(t))) == ["big_turbine", "turbine_pump"]


def test_or_query(spark):
    assert one(spark, "Pump a pump, Valve!", T.or_query) == "pump | valve"
    assert one(spark, "a ! b", T.or_query) is None


def test_text_for_speech(spark):
    got = one(spark, "See https://x.org/a now,ok.Fine a@b.c {x}_y\nwww.z.com 3.14", T.for_speech)
    assert got == "See now, ok. Fine x y 3. 14"


def test_speech_sentences_fall_back_to_the_text(spark):
    assert one(spark, "Hi there. You? ", T.speech_sentences) == ["Hi there.", "You?"]
    assert one(spark, "...", T.speech_sentences) == ["..."]


def test_highlight_quotes_patterns(spark):
    assert one(spark, "C++ and c++ (x)", lambda t: T.highlight(t, F.lit("c++ x"))) == "<mark>C++</mark> and <mark>c++</mark> (x)"


def test_sensitive_values(spark):
    found = one(spark, "a.b@c.org 1234 5678 9012 and 1234-5678-9012-3456, 555-123-4567", T.sensitive)
    kinds = {}
    for r in found:
        kinds.setdefault(r["kind"], set()).add(r["value"])
    assert kinds["emails"] == {"a.b@c.org"} and "1234 5678 9012" in kinds["ids"] and kinds["cards"] == {"1234-5678-9012-3456"} and kinds["phones"] == {"555-123-4567"}


def test_redaction_needs_terms(spark):
    import pytest

    assert one(spark, "Ada met ADA.", lambda t: T.redact(t, ["ada", "."])) == "███ met ████"
    with pytest.raises(ValueError):
        T.redact(F.lit("x"), [])


def test_feature_hash_is_crc32(spark):
    import zlib

    for f in ("abc_def", "ümlaut", ""):
        h = zlib.crc32(f.encode())
        row = spark.createDataFrame([(f,)], "t string").select(*[c.alias(n) for n, c in zip("bs", T.feature_hash(F.col("t")))]).first()
        assert (row["b"], row["s"]) == (h % 384, 1 if h >> 31 else -1)


def test_predicates(spark):
    assert one(spark, "abc1", T.is_safe_id) and not one(spark, "a/b", T.is_safe_id)
    assert one(spark, "X.PDF", T.has_pdf_name)
    mark = lambda text, dx, dy, o: one(spark, text, lambda t: T.is_watermark(t, F.lit(dx), F.lit(dy), F.lit(o)))
    assert mark("x", 0.7, 0.7, 1.0) and mark(" Do Not Copy ", 1.0, 0.0, 1.0) and mark("x", 1.0, 0.0, 0.5) and not mark("x", 1.0, 0.0, 1.0)
