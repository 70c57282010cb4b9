"""Text functions as built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Stop words, removed one after the other in this order.
STOP_WORDS = (
    "a", "the", "of", "on", "in", "an", "and", "is", "at", "are", "as", "be", "but", "by", "for", "it", "no", "not", "or",
    "such", "that", "their", "there", "these", "to", "was", "with", "they", "will", "v", "ve", "d",
)
#: Tokens that count as missing once cleaned.
MISSING = ("", "nan", "unknown")


def clean_text(col: Column) -> Column:
    """Lower-case ASCII words with single spaces and without stop words.

    One word after the other is removed between spaces, then once at either end: a fold over the list of words, so
    that the plan does not grow with it. A text of one word can lose none, and skips that.
    """
    out = F.regexp_replace(col.cast("string"), r"[^\x00-\x7F]", "")
    out = F.trim(F.lower(F.regexp_replace(out, "[^A-Za-z0-9]+", " ")))

    first, last, gap = F.lit("\x01"), F.lit("\x02"), F.lit(" ")  # marks of the ends, which no cleaned text holds

    def without(text: Column, w: Column) -> Column:
        inner = F.replace(text, F.concat(gap, w, gap), gap)
        return F.replace(F.replace(inner, F.concat(first, w, gap), first), F.concat(gap, w, last), last)

    marked = F.aggregate(F.array(*[F.lit(w) for w in STOP_WORDS]), F.concat(first, out, last), without)
    return F.when(F.contains(out, gap), F.translate(marked, "\x01\x02", "")).otherwise(out)


def clean_text_sql(column: str) -> str:
    """The same as clean_text in DuckDB's SQL."""
    out = rf"trim(lower(regexp_replace(regexp_replace(CAST({column} AS VARCHAR), '[^\x00-\x7F]', '', 'g'), '[^A-Za-z0-9]+', ' ', 'g')))"
    for w in STOP_WORDS:
        for pattern, to in ((f" {w} ", " "), (f"^{w} | {w}$", "")):
            out = f"regexp_replace({out}, '{pattern}', '{to}', 'g')"
    return out


def lower_all(df: DataFrame) -> DataFrame:
    """Every column as lower-case text."""
    return df.select(*[F.lower(F.col(f"`{c}`").cast("string")).alias(c) for c in df.columns])


def normalise_stored(col: Column) -> Column:
    """Runs of non-word characters become one space."""
    return F.regexp_replace(F.regexp_replace(col, r"\W+", " "), " +", " ")


def split_list(col: Column, delimiter: str = ", ") -> Column:
    """Parts of a delimited text; the delimiter is taken literally."""
    return F.split(col, r"\Q" + delimiter + r"\E")


def shingles(col: Column, k: int = 3) -> Column:
    """k-character pieces of the lower-case word characters; a shorter text is its own only piece."""
    t = F.regexp_replace(F.lower(col), r"[^\w]+", "")
    last = F.greatest(F.length(t) - k, F.lit(0))
    return F.transform(F.sequence(F.lit(0), last), lambda i: F.substring(t, i + 1, F.lit(k)))
