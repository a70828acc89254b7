"""Text functions, all Column to Column and JVM-side."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .patterns import SENSITIVE, STOPWORDS, WATERMARKS


def strings(values) -> Column:
    return F.array(*[F.lit(x) for x in values])


def bind(value: Column, use) -> Column:
    """use(value) with value computed once, though a lambda of use may read it for every element."""
    return F.transform(F.array(value), use)[0]


def stem(t: Column) -> Column:
    """The first suffix rule that fits: ies to y, ing, ed, s but not ss; each from a least length on."""
    n, cut = F.length(t), lambda k: F.substr(t, F.lit(1), F.length(t) - k)
    return (
        F.when((n > 4) & t.endswith("ies"), F.concat(cut(3), F.lit("y")))
        .when((n > 5) & t.endswith("ing"), cut(3))
        .when((n > 4) & t.endswith("ed"), cut(2))
        .when((n > 3) & t.endswith("s") & ~t.endswith("ss"), cut(1))
        .otherwise(t)
    )


def raw_words(text: Column) -> Column:
    """Lower-case ASCII words, which tokenize goes on from."""
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0))


def tokenize(text: Column, stopwords: bool = True, stems: bool = True) -> Column:
    """Lower-case ASCII words, without stop words, stemmed."""
    words = raw_words(text)
    if stopwords:
        words = F.filter(words, lambda t: ~t.isin(STOPWORDS))
    return F.transform(words, stem) if stems else words


def word_tokens(text: Column) -> Column:
    """Lower-case Unicode words (letters, digits, underscore)."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"(?U)\w+"), F.lit(0))


def space_tokens(text: Column) -> Column:
    """Lower-case words between white space; punctuation stays."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"(?U)\S+"), F.lit(0))


def count_tokens(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"(?U)\S+"))


def strip(text: Column) -> Column:
    """Text without white space at its ends."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def normalize_space(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, r"(?U)\s+", " "), "^ | $", "")


def bigrams(tokens: Column, joiner: str = "_") -> Column:
    return bind(tokens, lambda t: F.when(F.size(t) < 2, F.array().cast("array<string>")).otherwise(F.zip_with(F.slice(t, 1, F.size(t) - 1), F.slice(t, 2, F.size(t)), lambda a, b: F.concat(a, F.lit(joiner), b))))


def or_query(text: Column) -> Column:
    """Distinct words of more than one character, in order, joined by ' | '; null if there are none."""
    words = F.array_distinct(F.filter(F.transform(F.regexp_extract_all(text, F.lit("[A-Za-z0-9]+"), F.lit(0)), F.lower), lambda t: F.length(t) > 1))
    return F.nullif(F.array_join(words, " | "), F.lit(""))


def for_speech(text: Column) -> Column:
    """Text as a voice should read it: no addresses, no markup signs, a space after commas and full stops."""
    for pattern, by in ((r"(?U)https?://\S+|www\.\S+", ""), (r"(?U)\S+@\S+", ""), ("\n", " "), (r"[_/\\|*~<>\[\]{}]", " "), (r"(?U),([^\s])", ", $1"), (r"(?U)\.([^\s])", ". $1")):
        text = F.regexp_replace(text, pattern, by)
    return normalize_space(text)


def speech_sentences(text: Column) -> Column:
    found = F.filter(F.transform(F.regexp_extract_all(text, F.lit("[^.!?]+[.!?]*"), F.lit(0)), strip), lambda s: s != "")
    return bind(found, lambda f: F.when(F.size(f) == 0, F.array(strip(text))).otherwise(f))


def quoted(term: Column) -> Column:
    """A term as a pattern that matches it alone."""
    return F.regexp_replace(term, r"([\\.^$|?*+()\[\]{}-])", r"\\$1")


def highlight(text: Column, query: Column) -> Column:
    """Every occurrence of a query word of more than one character, in <mark>, whatever its case."""
    terms = F.filter(F.split(query, " +"), lambda t: F.length(t) > 1)
    return bind(terms, lambda t: F.when(F.size(t) == 0, text).otherwise(F.regexp_replace(text, F.concat(F.lit("(?i)("), F.array_join(F.transform(t, quoted), "|"), F.lit(")")), F.lit("<mark>$1</mark>"))))


def stable_id(key: Column) -> Column:
    return F.substr(F.md5(key), F.lit(1), F.lit(12))


def feature_hash(feature: Column, dim: int = 384) -> tuple[Column, Column]:
    """Bucket and sign of a feature, from its CRC-32."""
    h = F.crc32(F.encode(feature, "UTF-8"))
    return F.pmod(h, F.lit(dim)).cast("int"), F.when(F.shiftrightunsigned(h, 31) % 2 == 1, 1).otherwise(-1)


def caps(raw: Column) -> Column:
    return F.regexp_count(raw, F.lit("[A-Z]"))


def is_safe_id(s: Column) -> Column:
    return s.rlike("^[A-Za-z0-9]+$")


def is_pdf(content: Column) -> Column:
    return F.substring(content, 1, 4) == F.lit(b"%PDF")


def has_pdf_name(path: Column) -> Column:
    return F.lower(path).rlike(r"\.pdf$")


def sensitive(text: Column) -> Column:
    """Array of (kind, value): distinct values that look like addresses, 12-digit ids, 16-digit cards, phone numbers."""

    def found(kind, pattern):
        return F.transform(F.array_distinct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0))), lambda v: F.struct(F.lit(kind).alias("kind"), v.alias("value")))

    return F.concat(*[found(*x) for x in SENSITIVE.items()])


def redact(text: Column, terms: list[str]) -> Column:
    """Every occurrence of a term, whatever its case, as that many full blocks. No terms is an error."""
    if not terms:
        raise ValueError("nothing to redact")
    for t in terms:
        text = F.regexp_replace(text, F.concat(F.lit("(?i)"), quoted(F.lit(t))), F.lit("█" * len(t)))
    return text


def is_watermark(text: Column, dx: Column, dy: Column, opacity: Column) -> Column:
    says = F.lower(strip(text))
    named = F.exists(strings(WATERMARKS), lambda w: F.contains(says, w))
    return (F.abs(dx) > 0.05) & (F.abs(dy) > 0.05) | named | (opacity < 0.6)
