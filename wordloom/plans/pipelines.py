"""The two pipelines, from a corpus to bigrams and from a corpus to word vectors."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame

from wordloom.functions.clean import CLEANERS, Cleaner
from wordloom.functions.stem import stem_vocabulary, stem_words
from wordloom.functions.wordlists import STOP_WORDS
from wordloom.operators.als import train_glove_als
from wordloom.operators.bigrams import corpus_with_bigrams, extract_bigrams
from wordloom.operators.cooccur import cooccurrence, encode_documents, vocabulary
from wordloom.operators.corpus import (
    SECTIONS,
    clean_documents,
    decode_json_sections,
    drop_by_source,
    exclude_ids,
    filter_tokens,
    kept_words,
    split_tokens,
    stem_streams,
    token_streams,
)
from wordloom.operators.denoise import denoise
from wordloom.operators.glove import output_vectors
from wordloom.operators.strata import train_glove
from wordloom.operators.ontology import GROUP_SUFFIX, PRUNED_LABELS, ROOT_LABEL, group_tokens, leaf_paths, ontology_groups
from wordloom.operators.retrofit import retrofit, sums_from_groups
from wordloom.runtime import checkpoint, write_stage

Tagger = Callable[[Column], Column]
WordList = Sequence[str] | DataFrame

# Words of a list that go into an expression; longer lists are an error, not cut.
LONGEST_LIST = 10_000


def word_list(words: WordList) -> list[str]:
    """The words of a list, or of the column `word` of a table as `read_wordlist` gives it."""
    if isinstance(words, DataFrame):
        words = [r.word for r in words.select("word").distinct().orderBy("word").limit(LONGEST_LIST + 1).collect()]
    if len(words) > LONGEST_LIST:
        raise ValueError(f"a word list may have {LONGEST_LIST} words")
    return list(words)


def prepare_corpus(
    raw: DataFrame, excluded: DataFrame | None = None, source_text: str = "cookbooks.com"
) -> DataFrame:
    """F1 + F2 + S2: raw rows `(doc_id, ingredients, instructions, link)` to documents."""
    rows = drop_by_source(raw, source_text)
    if excluded is not None:
        rows = exclude_ids(rows, excluded)
    return decode_json_sections(rows)


def preprocess(
    documents: DataFrame,
    sections: Sequence[str] = SECTIONS,
    tagger: Tagger | None = None,
    stop_words: WordList | None = None,
    cleaners: Sequence[Cleaner] = CLEANERS,
    stems: DataFrame | None = None,
) -> DataFrame:
    """Documents to stemmed token streams.

    `stop_words` is a list or a table from `read_wordlist`, `cleaners` the steps of cleaning, `stems` a
    table `(token, stem)` that counts before the built-in stems.  The filtered tokens are written once,
    as they are read twice: to stem the distinct words, and to put the stems in.
    """
    if stop_words is None:
        stop_words = stem_words(documents.sparkSession, STOP_WORDS)
    tokens = split_tokens(clean_documents(documents, sections, cleaners), sections)
    streams = token_streams(filter_tokens(tokens, sections, word_list(stop_words), tagger), sections)
    if stems is not None:
        return stem_streams(streams, sections, stems)
    streams = write_stage(streams.select("doc_id", *sections))
    known = write_stage(stem_vocabulary(kept_words(streams, sections)))
    return stem_streams(streams, sections, known, cache=True)


def build_bigrams(
    documents: DataFrame,
    freq_filter: int | float = 0.00001,
    sections: Sequence[str] = SECTIONS,
    mined: Sequence[str] | None = None,
    tagger: Tagger | None = None,
    excluded: WordList | None = None,
    **text,
) -> DataFrame:
    """Corpus to bigram model `(w1, w2, freq)`; pairs are mined in the last section by default.

    `excluded` are words that are in no pair (units and tools by default); `text` are the options
    of `preprocess`.
    """
    streams = preprocess(documents, sections, tagger, **text)
    excluded = None if excluded is None else word_list(excluded)
    return extract_bigrams(streams, freq_filter, mined or sections[-1:], excluded)


def build_training_corpus(
    documents: DataFrame,
    bigrams: DataFrame | None = None,
    sections: Sequence[str] = SECTIONS,
    tagger: Tagger | None = None,
    **text,
) -> DataFrame:
    """L8, the part before training: `(doc_id, tokens)`, one row per line of training text.

    `text` are the options of `preprocess`.
    """
    streams = preprocess(documents, sections, tagger, **text)
    return corpus_with_bigrams(streams, bigrams, sections).select("doc_id", "tokens")


@dataclass
class Embeddings:
    """What a training run leaves: vectors `(word_id, token, vec)` and the tables before them."""

    vectors: DataFrame
    vocab: DataFrame
    pairs: DataFrame
    params: DataFrame


def train_embeddings(
    docs: DataFrame,
    dim: int = 300,
    iterations: int = 100,
    min_count: int = 15,
    window: int = 10,
    components: int = 5,
    seed: int = 0,
    model: int = 2,
    on_iteration: Callable[[int, float], None] | None = None,
    solver: str = "adagrad",
) -> Embeddings:
    """Training corpus `(doc_id, tokens)` to de-noised word vectors.

    With `solver="als"` the iterations are sweeps of alternating least squares; some ten are enough, and
    `on_iteration` gets the loss, ridge included, in place of the mean error.
    """
    if solver not in ("adagrad", "als"):
        raise ValueError(f"no such solver: {solver}")
    vocab = vocabulary(docs, min_count)
    pairs = checkpoint(cooccurrence(encode_documents(docs, vocab), window))
    if solver == "als":
        after = (lambda sweep, _, loss: on_iteration(sweep, loss)) if on_iteration else None
        params = train_glove_als(pairs, dim, iterations, seed=seed, on_sweep=after)
    else:
        params = train_glove(pairs, dim, iterations, seed=seed, on_iteration=on_iteration)
    vectors = checkpoint(output_vectors(params, vocab, model))
    return Embeddings(denoise(vectors, components), vocab, pairs, params)


def build_embeddings(
    documents: DataFrame,
    bigrams: DataFrame | None = None,
    dim: int = 300,
    sections: Sequence[str] = SECTIONS,
    tagger: Tagger | None = None,
    stop_words: WordList | None = None,
    cleaners: Sequence[Cleaner] = CLEANERS,
    stems: DataFrame | None = None,
    **training,
) -> Embeddings:
    """Corpus to word vectors; the training corpus is written between the two halves."""
    text = {"stop_words": stop_words, "cleaners": cleaners, "stems": stems}
    docs = write_stage(build_training_corpus(documents, bigrams, sections, tagger, **text))
    return train_embeddings(docs, dim, **training)


def retrofit_embeddings(
    vectors: DataFrame,
    nodes: DataFrame,
    edges: DataFrame,
    bigrams: DataFrame | None = None,
    root_label: str = ROOT_LABEL,
    pruned: Sequence[str] = PRUNED_LABELS,
    suffix: str = GROUP_SUFFIX,
    **retrofitting,
) -> DataFrame:
    """Vectors `(token, vec)`, an ontology and a bigram model to retrofitted vectors.

    The members of a group of the ontology are neighbours; `retrofitting` are the options of `retrofit`.
    """
    groups = ontology_groups(leaf_paths(nodes, edges, root_label, pruned), suffix)
    members = group_tokens(groups, vectors.select("token"), bigrams)
    return retrofit(vectors, sums_from_groups(members), **retrofitting)
