"""Text functions as Columns: language class, tokenizers, terms, trigrams, normal forms.

Everything here stays in the JVM, but for ``folded``: Spark has no Unicode normal forms. Java's ``\\w`` is ASCII, so word characters are spelled
``[\\p{L}\\p{N}_]``.
"""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = r"[\p{L}\p{N}_]"
HAN = r"[\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{F900}-\x{FAFF}]"
#: Words that say nothing about a topic. Fixed values.
TOPIC_STOPS = ("a", "an", "and", "are", "be", "by", "can", "do", "does", "for", "from", "how", "in", "is", "it", "of", "on", "or", "the", "this", "to", "what", "when", "where", "which", "who", "why", "with")


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def all_matches(c: Column | str, pattern: str) -> Column:
    return F.regexp_extract_all(_col(c), F.lit(pattern), F.lit(0))


def casefold(c: Column | str) -> Column:
    """Lower case with the sharp s folded, as full case folding would on this repertoire."""
    return F.replace(F.lower(_col(c)), F.lit("ß"), F.lit("ss"))


def _fold(texts: pd.Series) -> pd.Series:
    return texts.map(lambda x: None if x is None else unicodedata.normalize("NFKC", x).casefold())


def folded(c: Column | str) -> Column:
    """NFKC and full case folding, in Arrow batches."""
    return F.pandas_udf(_fold, "string")(_col(c))


def language_class(c: Column | str) -> Column:
    """zh, en or mixed by the presence of Han and Latin letters; unknown without either."""
    han, latin = _col(c).rlike(HAN), _col(c).rlike("[A-Za-z]")
    return F.when(han & latin, "mixed").when(han, "zh").when(latin, "en").otherwise("unknown")


def chunk_tokens(c: Column | str) -> Column:
    """Tokens that a chunk's size is counted in: joined words, or one symbol."""
    return all_matches(c, rf"{WORD}+(?:[./:@-]{WORD}+)*|[^\p{{L}}\p{{N}}_\s]")


def feature_tokens(c: Column | str) -> Column:
    return all_matches(casefold(c), rf"{WORD}+(?:[./:@-]{WORD}+)*")


def topic_terms(c: Column | str, stops: tuple[str, ...] = TOPIC_STOPS) -> Column:
    """Distinct topic words: ASCII identifiers or runs of Han characters, without stop words and single characters."""
    found = all_matches(c, rf"[A-Za-z0-9][A-Za-z0-9_.:/-]*|{HAN}{{2,}}")
    folded = F.transform(found, F.lower)
    return F.array_distinct(F.filter(folded, lambda w: (F.char_length(w) > 1) & ~w.isin(*stops)))


def trigrams(c: Column | str) -> Column:
    """Distinct trigrams of each lower-case word, padded with two blanks before and one after."""
    words = F.transform(all_matches(F.lower(_col(c)), r"[\p{L}\p{N}]+"), lambda w: F.concat(F.lit("  "), w, F.lit(" ")))
    grams = F.transform(words, lambda w: F.transform(F.sequence(F.lit(1), F.char_length(w) - 2), lambda i: F.substring(w, i, F.lit(3))))
    return F.array_distinct(F.flatten(grams))


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays of distinct values; two empty ones give 0."""
    shared = F.size(F.array_intersect(a, b))
    return F.coalesce(F.try_divide(shared.cast("double"), (F.size(a) + F.size(b) - shared).cast("double")), F.lit(0.0))


def overlap_share(query: Column, evidence: Column) -> Column:
    """|query & evidence| / |query|; 0 for an empty query."""
    return F.coalesce(F.try_divide(F.size(F.array_intersect(query, evidence)).cast("double"), F.size(query).cast("double")), F.lit(0.0))


def collapsed(c: Column | str) -> Column:
    return F.trim(F.regexp_replace(_col(c), r"\s+", " "))


def question_key(c: Column | str) -> Column:
    """A question in NFKC without case, spare blanks and closing punctuation."""
    return F.regexp_replace(collapsed(folded(c)), r"[?!.。？！]+$", "")


def first_sentences(c: Column | str, limit: int = 240) -> Column:
    """The first two sentences, cut to ``limit`` characters with an ellipsis."""
    parts = F.slice(F.split(collapsed(c), r"(?<=[.!?]) "), 1, 2)
    text = F.array_join(parts, " ")
    return F.when(F.char_length(text) > limit, F.concat(F.rtrim(F.substring(text, 1, limit - 1)), F.lit("…"))).otherwise(text)


def safe_url(c: Column | str) -> Column:
    """The URL if it is http(s), names a host and holds no credentials, else null."""
    good = _col(c).rlike(r"^(?i)https?://[^/?#@]+(?:[/?#].*)?$")
    return F.when(good, _col(c))


#: Marks of blocks, which quoted text must not hold, those of which no letter may follow, and what takes their place. Fixed values.
MARKS = ["[UNTRUSTED_CONTENT_BEGIN]", "[UNTRUSTED_CONTENT_END]", "[/UNTRUSTED_CONTENT_BEGIN]", "[/UNTRUSTED_CONTENT_END]"]
OPEN_MARKS = ["[SOURCE", "[/SOURCE"]
NEUTRAL = "[ESCAPED_BOUNDARY"
_MARKED = "(?i)" + "|".join([*map(re.escape, MARKS), *(re.escape(m) + r"\b" for m in OPEN_MARKS)])


def escaped_field(c: Column | str) -> Column:
    """One line without spare blanks and without block marks."""
    return F.regexp_replace(F.trim(F.regexp_replace(_col(c), r"[\t\r\f\x0B\n ]+", " ")), _MARKED, F.lit(NEUTRAL))


def quoted(c: Column | str) -> Column:
    """Untrusted text without block marks, every line behind a bar."""
    lines = F.split(F.regexp_replace(F.regexp_replace(_col(c), _MARKED, F.lit(NEUTRAL)), r"(?:\r\n|\r|\n)$", ""), r"\r\n|\r|\n")
    return F.when(_col(c) == "", F.lit("|")).otherwise(F.array_join(F.transform(lines, lambda x: F.concat(F.lit("| "), x)), "\n"))


def dense_length(c: Column | str) -> Column:
    """Characters that are not white space."""
    return F.char_length(F.regexp_replace(_col(c), r"\s+", ""))


def quality_gate(c: Column | str, least: int = 40) -> Column:
    return F.when(dense_length(c) >= least, "ready").otherwise("too_short")


def numbers(c: Column | str) -> Column:
    """Distinct numbers and versions, in lower case."""
    return F.array_distinct(all_matches(F.lower(_col(c)), rf"(?<!{WORD})v?\d+(?:\.\d+)*(?:[-+][a-z0-9.]+)?"))


def version_variants(versions: Column) -> Column:
    """Each version with and without its v, order kept, blanks left out."""
    kept = F.filter(F.transform(versions, lambda v: F.trim(v)), lambda v: v != "")
    both = F.transform(kept, lambda v: F.array(v, F.when(F.lower(F.substring(v, 1, 1)) == "v", F.substring(v, 2, 1 << 20)).otherwise(F.concat(F.lit("v"), v))))
    return F.array_distinct(F.flatten(both))


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))
