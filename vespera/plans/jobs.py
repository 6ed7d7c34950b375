"""End-to-end jobs put together from the operators."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.dates import long_date
from ..functions.fixed_values import (
    CANDIDATES,
    CHUNK_OVERLAP,
    CHUNK_SIZE,
    CITIES,
    DEPARTMENTS,
    EVENTS_PER_ANSWER,
    TOPICS,
    UNKNOWN_CITY,
    UNKNOWN_START,
    UNKNOWN_TITLE,
)
from ..functions.scoring import classify
from ..functions.text import DEFAULT_PROMPT, assemble_prompt, excerpt, searchable_text, strip
from ..functions.topics import match_topics
from ..operators.chunk import bucket_of, chunk_text, with_chunk_id
from ..operators.clean import compose_text, drop_missing, prune_columns, strip_html, to_documents
from ..operators.constraints import FACETS, apply_constraints, first_events, first_matches, with_facets
from ..operators.context import answer_rows
from ..operators.embed import HASH_DIM, Embedder, embed
from ..operators.knn import knn
from ..operators.metrics import context_precision, faithfulness
from ..operators.questions import parse_questions
from ..session import materialize
from ..sources.index import write_index
from ..sources.tables import read_clean_csv, require_rows

_ASKED = ["as_of", "asked_city", "asked_department", "asked_start", "asked_end", "asked_topics"]
_SHOWN = ["chunk_id", "text", "title", "city", "department", "date_start", "date_end"]


def clean_events(events: DataFrame, null_text: str = "None", row_fallback: bool = False) -> DataFrame:
    """Known columns of events that have a description, with the text that represents them."""
    return strip_html(compose_text(drop_missing(prune_columns(events)), null_text, row_fallback))


def index_documents(
    documents: DataFrame,
    size: int = CHUNK_SIZE,
    overlap: int = CHUNK_OVERLAP,
    topics: Mapping[str, Sequence[str]] = TOPICS,
    embedder: Embedder | None = None,
    dim: int = HASH_DIM,
    by_range: bool = False,
) -> DataFrame:
    """Chunks of ``documents(doc_ord, text, metadata…)`` with ids, filter columns, topics and vectors.

    Filter columns are worked out once per document, before it is cut. There is no shuffle unless ``by_range`` asks for
    one, of documents before they are cut: for input in a few large or very uneven files. Each file then holds a range
    of chunk ids, in order, so that its statistics tell readers what they can skip. How many there are is Spark's
    choice by size: ``spark.sql.shuffle.partitions`` at most, merged to the advisory size.
    """
    if by_range:  # before the facets: working out the ranges runs all that comes before once more
        documents = documents.repartitionByRange("doc_ord").sortWithinPartitions("doc_ord")
    chunks = with_chunk_id(chunk_text(with_facets(documents), size, overlap))
    searched = chunks.withColumn("_searched", searchable_text(F.col("text"), F.col("title")))
    with_topics = searched.withColumn("topics", match_topics(F.col("_searched"), topics)).drop("_searched")
    return embed(with_topics, "text", embedder, dim)


def build_index(clean: DataFrame, ord_col: str | None = None, **options) -> DataFrame:
    """Index rows of clean events; see ``index_documents`` for the options."""
    return index_documents(to_documents(clean, ord_col), **options)


def rebuild_index(clean: DataFrame, path: str, ord_col: str | None = None, **options) -> DataFrame:
    """Build a full new version of the stored index and announce it once complete.

    Returns ``version, nb_documents, nb_chunks``; raises when there is nothing to index, leaving the old version in use.
    """
    return write_index(build_index(clean, ord_col, **options), path)


def retrieve(
    questions: DataFrame,
    index: DataFrame,
    k: int = CANDIDATES,
    top: int = EVENTS_PER_ANSWER,
    as_of: Column | None = None,
    topics: Mapping[str, Sequence[str]] = TOPICS,
    cities: Sequence[tuple[str, str]] = CITIES,
    departments: Sequence[tuple[str, ...]] = DEPARTMENTS,
    embedder: Embedder | None = None,
    dim: int = HASH_DIM,
    template: str = DEFAULT_PROMPT,
) -> DataFrame:
    """Events, context and prompt for a batch of ``questions(qid, question[, as_of])``.

    The k nearest chunks are filtered, reduced to one per event, and cut to ``top``. Questions left with nothing are
    answered by a scan of all chunks with the same filters, in chunk order. Filters run after the k nearest are known,
    never before: they may leave one or two events, and then there is no fallback.

    Vectors are read only by the search, texts only for the final events; in between travel ids and filter columns.
    Hits carry the bucket of documents that they lie in, by which a stored index is partitioned: while there are few,
    Spark reads the files of their buckets only, for filters and texts alike. Each step that is used twice is written to
    shared storage first.
    """
    parsed = parse_questions(questions, as_of, topics, cities, departments)
    asked = materialize(embed(parsed, "question", embedder, dim), "questions")
    plain = asked.drop("embedding")
    nearest = materialize(_with_bucket(knn(asked, index, k)), "nearest")
    # Spark looks for a filter on the side that prunes; this one holds for every row.
    candidates = nearest.where(F.col("rank") <= k).join(index.select("bucket", *FACETS), ["bucket", "chunk_id"])
    candidates = candidates.join(plain.select("qid", *_ASKED), "qid")
    found = first_events(apply_constraints(candidates), top).select("qid", "chunk_id", "bucket", "rank")
    found = materialize(found.withColumn("used_fallback", F.lit(False)), "found")
    missed = plain.join(found, "qid", "left_anti")
    hits = found
    if not missed.isEmpty():
        extra = _with_bucket(first_matches(materialize(missed, "missed"), index, top))
        hits = materialize(found.unionByName(extra.withColumn("used_fallback", F.lit(True))), "hits")
    shown = hits.where(F.col("rank") <= top).join(index.select("bucket", *_SHOWN), ["bucket", "chunk_id"])
    answers = answer_rows(plain, shown)
    prompt = assemble_prompt(long_date(F.col("as_of")), F.col("context"), F.col("question"), template)
    return answers.withColumn("prompt", prompt)


def _with_bucket(hits: DataFrame) -> DataFrame:
    return hits.withColumn("bucket", bucket_of(F.col("chunk_id")))


def search(questions: DataFrame, index: DataFrame, k: int = 3, embedder: Embedder | None = None, dim: int = HASH_DIM) -> DataFrame:
    """Plain nearest chunks per question with title, city, start and the first characters of the text.

    Values that an event lacks are shown by the labels for unknown ones.
    """
    asked = materialize(embed(questions.select("qid", "question"), "question", embedder, dim), "search")
    nearest = materialize(_with_bucket(knn(asked, index, k)), "nearest")
    shown = index.select(
        "bucket",
        "chunk_id",
        F.coalesce("title", F.lit(UNKNOWN_TITLE)).alias("title"),
        F.coalesce("city", F.lit(UNKNOWN_CITY)).alias("city"),
        F.coalesce("date_start", F.lit(UNKNOWN_START)).alias("date_start"),
        excerpt(F.col("text")).alias("excerpt"),
    )
    return nearest.where(F.col("rank") <= k).join(shown, ["bucket", "chunk_id"]).drop("bucket")


def evaluation_samples(test_set: DataFrame, answers: DataFrame, max_samples: int | None = None) -> DataFrame:
    """``qid, question, answer, contexts, ground_truth, reference`` of an annotated test set.

    ``test_set(qid, question, reference)``; ``answers(qid, answer, contexts)``. Rows meet on ``qid``; a question without
    answer stays, with no contexts. ``max_samples`` takes the first rows only.
    """
    if max_samples is not None:
        test_set = test_set.orderBy("qid").limit(max_samples)
    reference = strip(F.col("reference"))
    rows = test_set.select(
        "qid", strip(F.col("question")).alias("question"), reference.alias("ground_truth"), reference.alias("reference")
    )
    contexts = F.coalesce("contexts", F.array().cast("array<string>")).alias("contexts")
    return rows.join(answers.select("qid", "answer", "contexts"), "qid", "left").select(
        "qid", "question", "answer", contexts, "ground_truth", "reference"
    )


def add_classification(scores: DataFrame) -> DataFrame:
    label = classify(F.col("faithfulness"), F.col("context_precision"), F.col("contexts"), F.col("reference"))
    return scores.withColumn("classification", label)


def evaluate(samples: DataFrame, context_verdicts: DataFrame, statement_verdicts: DataFrame) -> DataFrame:
    """Samples with ``faithfulness``, ``context_precision`` and ``classification``.

    ``context_verdicts(qid, rank, relevant)`` and ``statement_verdicts(qid, supported)`` hold a judge's 0/1 verdicts.
    ``class_summary`` and ``metric_means`` report on the result.
    """
    scored = samples.join(faithfulness(statement_verdicts), "qid", "left")
    return add_classification(scored.join(context_precision(context_verdicts), "qid", "left"))


def load_clean_events(spark: SparkSession, path: str) -> DataFrame:
    """Clean events from Parquet or CSV, by the path's suffix."""
    rows = read_clean_csv(spark, path) if path.rstrip("/").endswith(".csv") else spark.read.parquet(path)
    return require_rows(rows, "event table")
