"""The row-local operators on a stream.

Cleaning, tokenising, tagging, filtering and stemming look at one row at a time, so they
run unchanged on a streaming DataFrame: no state, no watermark, no shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from wordloom.functions.stem import stem_words
from wordloom.functions.wordlists import STOP_WORDS
from wordloom.operators.corpus import SECTIONS, clean_documents, tokenize_documents


def tokenize_stream(documents: DataFrame, sections: Sequence[str] = SECTIONS) -> DataFrame:
    """A1 for a stream of documents; words are stemmed by expression."""
    stop_words = stem_words(documents.sparkSession, STOP_WORDS)
    return tokenize_documents(clean_documents(documents, sections), sections, stop_words)
