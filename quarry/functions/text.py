"""Text analysis expressions: tokenizer, chunk windows, HTML field extraction."""

from __future__ import annotations

import html as _html

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._util import as_col

# Analyzer rule (lower-case, maximal runs of letters or digits,
# no stop words, no stemming) and BM25 constants.
TOKEN_PATTERN = r"[\p{L}\p{N}]+"
BM25_K1 = 1.2
BM25_B = 0.75
# Chunk size and overlap in characters.
CHUNK_SIZE = 2000
CHUNK_OVERLAP = 200


def tokens(c) -> Column:
    """array<string> of analysed terms."""
    return F.regexp_extract_all(F.lower(as_col(c)), F.lit(TOKEN_PATTERN), 0)


def token_count(c) -> Column:
    """Number of analysed terms, without materialising them (null for null)."""
    return F.regexp_count(F.lower(as_col(c)), F.lit(TOKEN_PATTERN))


@F.arrow_udf(T.ArrayType(T.StructType([T.StructField("term", T.StringType()), T.StructField("tf", T.LongType())])))
def term_frequencies(toks: pa.Array) -> pa.Array:
    """The distinct terms of every token array with their occurrences (empty for null)."""
    sizes = pc.fill_null(pc.list_value_length(toks), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    coded = toks.flatten().dictionary_encode()
    row = np.repeat(np.arange(len(toks), dtype=np.int64), sizes)
    key, n = np.unique((row << 32) | coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), return_counts=True)
    starts = np.searchsorted(key, np.arange(len(toks) + 1, dtype=np.int64) << 32).astype(np.int32)
    terms = coded.dictionary.take(pa.array(key & 0xFFFFFFFF)).cast(pa.string())
    return pa.ListArray.from_arrays(pa.array(starts), pa.StructArray.from_arrays([terms, pa.array(n.astype(np.int64))],
                                                                                ["term", "tf"]))


def chunk_count(c, size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP) -> Column:
    """Number of fixed windows (step = size - overlap); one for short or empty text."""
    step = size - overlap
    n = F.length(F.coalesce(as_col(c), F.lit("")))
    return F.when(n <= size, F.lit(1)).otherwise(
        (F.ceil((n - size) / F.lit(step)) + 1).cast("int"))


def chunk_offsets(c, size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP) -> Column:
    """array<int> of 0-based chunk ordinals (explode for rows)."""
    return F.sequence(F.lit(0), chunk_count(c, size, overlap) - 1)


def chunk_at(c, ordinal, size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP) -> Column:
    """Characters [ordinal*step, ordinal*step + size) of the text."""
    step = size - overlap
    text = F.coalesce(as_col(c), F.lit(""))
    return text.substr(as_col(ordinal) * F.lit(step) + 1, F.lit(size))


# HTML patterns for title and body text.
TITLE_PATTERN = r"(?is)<title[^>]*>(.*?)</title>"
DROP_BLOCKS = r"(?is)<(?:script|style)[^>]*>.*?</(?:script|style)>"
TAG_PATTERN = r"(?s)<[^>]*>"


def html_title(c) -> Column:
    return F.nullif(F.trim(F.regexp_extract(as_col(c), TITLE_PATTERN, 1)), F.lit(""))


def html_text_raw(c) -> Column:
    """Visible text with entities still encoded: script/style dropped, tags to
    spaces, whitespace collapsed."""
    no_blocks = F.regexp_replace(as_col(c), DROP_BLOCKS, " ")
    no_tags = F.regexp_replace(no_blocks, TAG_PATTERN, " ")
    return F.trim(F.regexp_replace(no_tags, r"\s+", " "))


@F.pandas_udf(T.StringType())
def unescape_entities(s: pd.Series) -> pd.Series:
    """HTML entity decoding, Arrow-batched (no built-in covers all entities)."""
    return s.map(lambda v: _html.unescape(v) if isinstance(v, str) else v)


def extract_fields(pages, html_col: str = "html", decode: bool = True):
    """Raw page rows → title, visible text and UTF-8 size.  Title and size
    are built-in expressions; entity decoding of the text is the one
    Arrow-batched Python step (``decode=False`` keeps it JVM-only)."""
    html = as_col(html_col)
    text = html_text_raw(html)
    title = html_title(html)
    if decode:
        text, title = unescape_entities(text), unescape_entities(title)
    return pages.select("*", title.alias("title"), text.alias("text"),
                        F.octet_length(html).cast("bigint").alias("size"))
