"""Registered queries with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vespera import functions as fn
from vespera import operators as op
from vespera import plans, sources
from vespera.functions.text import DEFAULT_PROMPT
from vespera.operators.constraints import FACETS
from vespera.session import materialize, scratch_path
from vespera.streaming import stream_answers, stream_event_pages, stream_index

from . import oracles as o
from .views import TOPICS, context_verdicts, judged, questions, raw_events, table

_COLUMNS = (
    "uid, title_fr, description_fr, location_city, location_department, location_postalcode, firstdate_begin, lastdate_end"
)

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return register


def _documents(spark, sf_dir):
    """Documents numbered by doc_id. The id is kept beside the known event columns, which cleaning would prune."""
    events = raw_events(spark, sf_dir)
    clean = op.strip_html(op.compose_text(op.drop_missing(events)))
    return op.to_documents(clean, "doc_id")


def _index(spark, sf_dir):
    # Each given table is one row group, which Spark reads in one task; tables of many files need no dealing out.
    return plans.index_documents(_documents(spark, sf_dir), topics=TOPICS, by_range=True)


# --- Sources and sinks ----------------------------------------------------------------------------------------------


@query(
    f"""with {o.EVENTS} select doc_id, uid, location_city, firstdate_begin from raw_events
    where location_city = 'Paris' and firstdate_begin >= '2026-03-01'"""
)
def scope_events(spark, sf_dir):
    scoped = op.scope_events(raw_events(spark, sf_dir), "Paris", "2026-03-01")
    return scoped.select("doc_id", "uid", "location_city", "firstdate_begin")


def _write_pages(spark, sf_dir, path, size=100):
    """Store the events as API pages: one JSON object per file, and an empty page at the end."""
    events = raw_events(spark, sf_dir).withColumn("page", F.floor(F.col("doc_id") / size))
    record = F.struct(*[c for c in events.columns if c not in ("doc_id", "page")])
    pages = events.groupBy("page").agg(F.collect_list(record).alias("results"))  # at most `size` records by the id
    last = pages.agg((F.max("page") + 1).alias("page")).withColumn("results", F.array().cast(pages.schema["results"].dataType))
    pages = pages.unionByName(last)
    pages.repartition("page").write.partitionBy("page").json(path)


@query(f"with {o.EVENTS} select {_COLUMNS} from raw_events")
def read_event_pages(spark, sf_dir):
    path = scratch_path(spark, "pages")
    _write_pages(spark, sf_dir, path)
    pages = sources.read_event_pages(spark, path, page_size=100, page_pattern=r"page=(\d+)/")
    return op.prune_columns(pages).drop("longdescription_fr")


@query(f"with {o.EVENTS}, {o.CLEAN} select {_COLUMNS}, text_to_embed from clean")
def clean_events(spark, sf_dir):
    return plans.clean_events(raw_events(spark, sf_dir))


@query(
    f"""with {o.EVENTS}, {o.CLEAN} select uid, title_fr, description_fr, location_city, location_department,
    location_postalcode, firstdate_begin, lastdate_end, text_to_embed from clean"""
)
def csv_round_trip(spark, sf_dir):
    clean = plans.clean_events(raw_events(spark, sf_dir))
    path = scratch_path(spark, "events-csv")
    sources.write_events(clean, path, "csv")
    return sources.read_clean_csv(spark, path, clean.schema)


@query(
    f"""with recursive {o.INDEX} select count(*) filter (chunk_pos = 0) as nb_documents, count(*) as nb_chunks
    from indexed"""
)
def rebuild_index(spark, sf_dir):
    path = scratch_path(spark, "index")
    return sources.write_index(_index(spark, sf_dir), path).select("nb_documents", "nb_chunks")


@query(
    f"""with recursive {o.INDEX} select chunk_id, chunk_pos, text, uid, title, city, department, postal_code, date_start,
    date_end, city_norm, department_norm, start_d, end_d, list_aggregate(topics, 'string_agg', ',') as topics from indexed"""
)
def index_round_trip(spark, sf_dir):
    path = scratch_path(spark, "index")
    sources.write_index(_index(spark, sf_dir), path)
    stored = sources.read_index(spark, path).withColumn("topics", F.nullif(F.array_join("topics", ","), F.lit("")))
    return stored.drop("doc_ord", "embedding", "event_key", "bucket")


_LONG = "case when doc_id % 3 > 0 then concat('Long : ', text) end"


def _text_sql(null: str, description: str) -> str:
    title, city, department, start, end = (
        f"coalesce({c}, '{null}')" for c in ("title_fr", "location_city", "location_department", "firstdate_begin", "lastdate_end")
    )
    return f"""'Titre: ' || {title} || chr(10) || 'Lieu: ' || {city} || ' (' || {department} || ')' || chr(10)
        || 'Date: du ' || {start} || ' au ' || {end} || chr(10) || 'Description: ' || coalesce({description}, '{null}')"""


@query(
    f"""with {o.EVENTS}, given as (select r.*, {_LONG} as long from raw_events r join documents using (doc_id))
    select doc_id, 'absent' as variant, {_text_sql('None', 'description_fr')} as text_to_embed from given
    union all select doc_id, 'given', {_text_sql('None', 'long')} from given
    union all select doc_id, 'by row', {_text_sql('?', 'coalesce(long, description_fr)')} from given"""
)
def compose_text(spark, sf_dir):
    """The long description as a column that is not there, one with gaps, and one whose gaps the short one fills."""
    events = raw_events(spark, sf_dir)
    texts = table(spark, sf_dir, "documents").select("doc_id", F.expr(_LONG).alias("longdescription_fr"))
    given = events.join(texts, "doc_id")
    variants = {
        "absent": op.compose_text(events),
        "given": op.compose_text(given),
        "by row": op.compose_text(given, null_text="?", row_fallback=True),
    }
    parts = [df.select("doc_id", F.lit(name).alias("variant"), "text_to_embed") for name, df in variants.items()]
    return parts[0].union(parts[1]).union(parts[2])


_REQUIRED = {
    "documents": ["doc_id", "text"],
    "benchmark": ["question", "reference"],
    "conversations": ["conv_id", "turn", "answer"],
}


@query(
    """select 'documents' as name, case when count(*) = 0 then 'the documents is empty' end as problem from documents
    union all select 'benchmark', 'missing columns: question, reference'
    union all select 'conversations', 'missing columns: answer'
    union all select 'nobody', case when count(*) = 0 then 'the table is empty' end from labels where doc_id < 0
    union all select 'labelled', case when count(*) = 0 then 'the table is empty' end from labels where doc_id >= 0"""
)
def input_checks(spark, sf_dir):
    """Required columns and rows of the given tables; some lack them."""
    found = [(name, sources.table_problem(table(spark, sf_dir, name), columns, name)) for name, columns in _REQUIRED.items()]
    labels = table(spark, sf_dir, "labels")
    found.append(("nobody", sources.table_problem(labels.where("doc_id < 0"), ["doc_id"])))
    found.append(("labelled", sources.table_problem(labels.where("doc_id >= 0"), ["doc_id"])))
    return spark.createDataFrame(found, "name string, problem string")


@query("select page_id, replace(replace(replace(html, '<p>', ''), '</p>', ''), '<br>', chr(10)) as html from pages")
def strip_html(spark, sf_dir):
    return op.strip_html(table(spark, sf_dir, "pages").select("page_id", "html"), "html")


@query(
    f"""select doc_id, {o.missing('text')} as text from documents where {o.missing('text')} is not null
    union all select -1 - conv_id * 1000 - turn, {o.missing('text')} from conversations where {o.missing('text')} is not null"""
)
def usable_text(spark, sf_dir):
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    turns = table(spark, sf_dir, "conversations")
    return op.usable_text(
        documents.unionByName(turns.select((-1 - F.col("conv_id") * 1000 - F.col("turn")).alias("doc_id"), "text")), "text"
    )


@query(f"with {o.EVENTS}, {o.CLEAN}, {o.DOCS} select * from docs")
def to_documents(spark, sf_dir):
    return _documents(spark, sf_dir)


@query("select doc_id, substr(text, 1, 250) as excerpt from documents")
def excerpt(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", fn.excerpt(F.col("text")).alias("excerpt"))


@query(
    f"""with {o.EVENTS}, {o.CLEAN}, {o.DOCS}, {o.FACETS}
    select doc_ord, date_start, date_end, start_d, end_d from facets"""
)
def iso_date(spark, sf_dir):
    return op.with_facets(_documents(spark, sf_dir)).select("doc_ord", "date_start", "date_end", "start_d", "end_d")


@query(
    f"""with {o.EVENTS} select doc_id, strftime(coalesce(try_cast(firstdate_begin as timestamptz),
    case when regexp_full_match(firstdate_begin, '[0-9]{{8}}') then try_strptime(firstdate_begin, '%Y%m%d') end::timestamptz)
    at time zone 'UTC', '%Y-%m-%d %H:%M:%S') as begins from raw_events"""
)
def parse_timestamps(spark, sf_dir):
    """Starts as moments: with an offset, as basic dates, blank, and on days that do not exist."""
    begins = fn.try_timestamp(F.col("firstdate_begin"))
    return raw_events(spark, sf_dir).select("doc_id", F.date_format(begins, "yyyy-MM-dd HH:mm:ss").alias("begins"))


# --- Chunks, topics, vectors ----------------------------------------------------------------------------------------


@query(
    f"with recursive {o.chunked('documents', 'doc_id')} select id as doc_id, chunk_pos, text from chunks"
)
def chunk_text(spark, sf_dir):
    return op.chunk_text(table(spark, sf_dir, "documents").select("doc_id", "text"))


@query(
    f"""select doc_id, w::int as chunk_pos, substr(text, w * 850 + 1, 1000) as text from (select doc_id, text,
    unnest(range(0, greatest(ceil((length(text) - 1000) / 850.0), 0)::bigint + 1)) as w from documents where text <> '')"""
)
def window_chunks(spark, sf_dir):
    return op.window_chunks(table(spark, sf_dir, "documents").select("doc_id", "text"))


@query(f"select doc_id, list_aggregate({o.topics_of('lower(text)')}, 'string_agg', ',') as topics from documents")
def match_topics(spark, sf_dir):
    documents = table(spark, sf_dir, "documents").select("doc_id", F.lower("text").alias("lower_text"))
    topics = F.array_join(fn.match_topics(F.col("lower_text"), TOPICS), ",")
    return documents.select("doc_id", F.nullif(topics, F.lit("")).alias("topics"))


@query(
    f"""with {o.vectors('documents', 'doc_id')} select k as doc_id, s - 1 as slot, round(v[s], 6) as weight
    from (select k, v, unnest(range(1, 65)) as s from documents_vec) where v[s] <> 0"""
)
def hash_vector(spark, sf_dir):
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    vectors = op.embed(documents.repartition("doc_id"))  # the given file is one row group, read in one task
    slots = vectors.select("doc_id", F.posexplode(F.coalesce("embedding", F.array())).alias("slot", "weight")).where(F.col("weight") != 0)
    return slots.select(
        "doc_id", F.col("slot").cast("bigint").alias("slot"), F.round(F.col("weight").cast("double"), 6).alias("weight")
    )


@query(
    """select a.vec_id, round(list_distance(x, y) ** 2, 6) as l2sq, round(list_dot_product(x, y), 6) as dot,
    round(list_cosine_similarity(x, y), 6) as cosine
    from (select vec_id, embedding::double[] as x from embeddings) a
    join (select vec_id, embedding::double[] as y from embeddings) b on b.vec_id = a.vec_id + 1"""
)
def distances(spark, sf_dir):
    """Each vector against the next one."""
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    after = vectors.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    x, y = F.col("embedding"), F.col("other")
    pairs = vectors.join(after, "vec_id")
    measured = {"l2sq": fn.l2sq(x, y), "dot": fn.dot(x, y), "cosine": fn.cosine(x, y)}
    return pairs.select("vec_id", *[F.round(v, 6).alias(name) for name, v in measured.items()])


@query(
    """select qid, chunk_id, round(d, 6) as distance, r::int as rank from (
      select a.vec_id as qid, b.vec_id as chunk_id, list_distance(a.v, b.v) ** 2 as d,
        row_number() over (partition by a.vec_id order by list_distance(a.v, b.v) ** 2, b.vec_id) as r
      from (select vec_id, embedding::double[] as v from embeddings) a,
           (select vec_id, embedding::double[] as v from embeddings) b) where r <= 10"""
)
def knn_topk(spark, sf_dir):
    """Ten nearest vectors of every vector."""
    vectors = table(spark, sf_dir, "embeddings")
    asked = vectors.select(F.col("vec_id").alias("qid"), "embedding")
    searched = vectors.select(F.col("vec_id").alias("chunk_id"), "embedding")
    found = op.knn(asked, searched, 10, first=F.col("chunk_id") % 8 == 0)  # part of the table bounds the distances
    return found.withColumn("distance", F.round("distance", 6))


# --- Questions ------------------------------------------------------------------------------------------------------


@query(
    f"""select conv_id, turn, case when length(text) > 1000 then 'too long' when {o.strip('text')} = '' then 'empty'
      else 'ok' end as reason, case when length(text) > 1000 or {o.strip('text')} = '' then text
      else {o.strip('text')} end as question from conversations"""
)
def validate_questions(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.col("text").alias("question"))
    valid, rejected = op.validate_questions(turns)
    return valid.withColumn("reason", F.lit("ok")).unionByName(rejected)


@query(
    f"""with {o.QUESTIONS}, {o.PARSED} select * exclude (asked_topics),
    list_aggregate(asked_topics, 'string_agg', ',') as asked_topics from asked"""
)
def parse_questions(spark, sf_dir):
    parsed = op.parse_questions(questions(spark, sf_dir), topics=TOPICS)
    return parsed.withColumn("asked_topics", F.nullif(F.array_join("asked_topics", ","), F.lit("")))


_NAMES = """names as (select phrase, upper(left(phrase, 1)) || substr(phrase, 2) as label, row_number() over (order by phrase) as place
    from (select distinct lower(substr(text, 1, 5)) as phrase from conversations where role = 'assistant'))"""


@query(
    f"""with {o.QUESTIONS}, {_NAMES}, met as (select qid, place, label from questions join names on contains(lower(question), phrase))
    select qid, arg_min(label, place) as asked_city, string_agg(label, ',' order by place) as asked_topics
    from questions left join met using (qid) group by qid"""
)
def parse_with_tables(spark, sf_dir):
    """Cities and topics from a table: how every answer begins stands for a name, and questions are searched for all."""
    begins = table(spark, sf_dir, "conversations").where("role = 'assistant'").select(F.lower(F.substring("text", 1, 5)).alias("phrase"))
    label = F.concat(F.upper(F.left("phrase", F.lit(1))), F.substring("phrase", 2, 99))
    names = op.with_ordinals(begins.distinct().orderBy("phrase").select("phrase", label.alias("label")), "place", 1)
    parsed = op.parse_questions(questions(spark, sf_dir), topics=names, cities=names)
    return parsed.select("qid", "asked_city", F.nullif(F.array_join("asked_topics", ","), F.lit("")).alias("asked_topics"))


_HEAD, _REST = DEFAULT_PROMPT.split("{date_du_jour}")
_MIDDLE, _REST = _REST.split("{context}")
_JOIN, _TAIL = _REST.split("{question}")


def _prompt_sql(context: str) -> str:
    return (
        f"{o.text(_HEAD)} || strftime(as_of, '%A %d %B %Y') || {o.text(_MIDDLE)} || {context} || {o.text(_JOIN)} "
        f"|| question || {o.text(_TAIL)}"
    )


@query(f"with {o.QUESTIONS} select qid, {_prompt_sql('question')} as prompt from questions")
def assemble_prompt(spark, sf_dir):
    asked = questions(spark, sf_dir)
    prompt = fn.assemble_prompt(fn.long_date(F.col("as_of")), F.col("question"), F.col("question"))
    return asked.select("qid", prompt.alias("prompt"))


# --- Filters and retrieval ------------------------------------------------------------------------------------------

_ONE_REQUEST = """a as (select date '2026-03-15' as as_of, 'Paris' as asked_city, null::varchar as asked_department,
    date '2026-04-01' as asked_start, date '2026-09-30' as asked_end, ['tion'] as asked_topics)"""


@query(
    f"""with recursive {o.INDEX}, {_ONE_REQUEST}
    select event_uid, chunk_id from (select coalesce(c.uid, '-') as event_uid, c.chunk_id,
      row_number() over (partition by c.event_key order by c.chunk_id) as r from indexed c, a where {o.MATCH}) where r = 1"""
)
def filter_constraints(spark, sf_dir):
    """One fixed request against every chunk of the corpus: first passing chunk per event."""
    request = {
        "qid": F.lit(0).cast("bigint"),
        "as_of": F.lit("2026-03-15").cast("date"),
        "asked_city": F.lit("Paris"),
        "asked_department": F.lit(None).cast("string"),
        "asked_start": F.lit("2026-04-01").cast("date"),
        "asked_end": F.lit("2026-09-30").cast("date"),
        "asked_topics": F.array(F.lit("tion")),
        "rank": F.col("chunk_id"),
    }
    passed = op.apply_constraints(_index(spark, sf_dir).drop("embedding").withColumns(request))
    return passed.select(F.coalesce("uid", F.lit("-")).alias("event_uid"), "chunk_id")


@query(
    f"""with recursive {o.INDEX} select chunk_id, text from (select chunk_id, text,
    row_number() over (partition by event_key order by chunk_id) as r from indexed) where r = 1"""
)
def dedup_first(spark, sf_dir):
    return op.dedup_first(_index(spark, sf_dir).select("event_key", "chunk_id", "text"), ["event_key"], ["chunk_id"]).select(
        "chunk_id", "text"
    )


@query(
    f"""with recursive {o.INDEX}, {o.QUESTIONS}, {o.PARSED},
    met as (select a.qid, c.event_key, min(c.chunk_id) as chunk_id from asked a, indexed c where {o.MATCH} group by all)
    select qid, chunk_id, r::int as rank from (select *, row_number() over (partition by qid order by chunk_id) as r from met)
    where r <= 3"""
)
def first_matches(spark, sf_dir):
    """The full-scan path on its own, for every question."""
    asked = materialize(op.parse_questions(questions(spark, sf_dir), topics=TOPICS), "asked")
    chunks = materialize(_index(spark, sf_dir).select("bucket", *FACETS), "facets")
    return op.first_matches(asked, chunks)


_RETRIEVE = f"""with recursive {o.INDEX}, {o.QUESTIONS}, {o.PARSED},
  chunk_text as (select chunk_id, text from indexed), question_text as (select qid, question as text from asked),
  {o.vectors('chunk_text', 'chunk_id')}, {o.vectors('question_text', 'qid')},
  near as materialized (select qid, chunk_id, r from (select q.k as qid, c.k as chunk_id,
     row_number() over (partition by q.k order by list_distance(q.v, c.v) ** 2, c.k) as r
     from question_text_vec q, chunk_text_vec c) where r <= 300),
  passed as (select n.qid, n.chunk_id, n.r, c.event_key from near n join indexed c using (chunk_id) join asked a using (qid)
     where {o.MATCH}),
  firsts as (select qid, event_key, min(r) as r from passed group by all),
  found as materialized (select qid, chunk_id, row_number() over (partition by qid order by r) as rank
     from (select p.* from passed p join firsts f on f.qid = p.qid and f.event_key = p.event_key and f.r = p.r)
     qualify rank <= 3),
  missed as (select * from asked where qid not in (select qid from found)),
  scanned as (select a.qid, c.event_key, min(c.chunk_id) as chunk_id from missed a, indexed c where {o.MATCH} group by all),
  hits as (select qid, chunk_id, rank, false as used_fallback from found union all
     select qid, chunk_id, row_number() over (partition by qid order by chunk_id) as rank, true from scanned qualify rank <= 3),
  shown as (select qid, {o.SOURCES} as sources, {o.CONTEXT} as context, bool_or(used_fallback) as used_fallback
     from hits join indexed using (chunk_id) group by qid),
  answers as (select a.qid, a.question, a.as_of, coalesce(s.sources, '') as sources, coalesce(s.context, {o.EMPTY}) as context,
     coalesce(s.used_fallback, true) as used_fallback from asked a left join shown s using (qid))"""


def _sources_text(df):
    return df.withColumn(
        "sources", F.array_join(F.transform("sources", lambda s: F.concat(s["title"], F.lit(" @ "), s["city"])), " ; ")
    )


@query(f"{_RETRIEVE} select qid, sources, context, used_fallback, {_prompt_sql('context')} as prompt from answers")
def retrieve(spark, sf_dir):
    """Every question against an index of every document, end to end."""
    path = scratch_path(spark, "index")
    sources.write_index(_index(spark, sf_dir), path)
    answers = plans.retrieve(questions(spark, sf_dir), sources.read_index(spark, path), topics=TOPICS)
    return _sources_text(answers).select("qid", "sources", "context", "used_fallback", "prompt")


@query(
    f"""with recursive {o.INDEX}, {o.QUESTIONS},
  chunk_text as (select chunk_id, text from indexed), question_text as (select qid, question as text from questions),
  {o.vectors('chunk_text', 'chunk_id')}, {o.vectors('question_text', 'qid')}
  select qid, chunk_id, r::int as rank, round(d, 6) as distance, coalesce(title, 'Titre inconnu') as title,
  coalesce(city, 'Ville inconnue') as city, coalesce(date_start, 'Date inconnue') as date_start,
  substr(text, 1, 250) as excerpt from (
     select q.k as qid, c.k as chunk_id, list_distance(q.v, c.v) ** 2 as d,
     row_number() over (partition by q.k order by list_distance(q.v, c.v) ** 2, c.k) as r
     from question_text_vec q, chunk_text_vec c) join indexed using (chunk_id) where r <= 3"""
)
def search(spark, sf_dir):
    path = scratch_path(spark, "index")
    sources.write_index(_index(spark, sf_dir), path)
    found = plans.search(questions(spark, sf_dir), sources.read_index(spark, path), 3)
    return found.withColumn("distance", F.round("distance", 6))


def _hits(spark, sf_dir):
    """Every document, as the events kept for a question of five documents each."""
    group, place = F.floor(F.col("doc_ord") / 5).alias("qid"), (F.col("doc_ord") % 5 + 1).alias("rank")
    return _documents(spark, sf_dir).select("*", group, place)


_HITS = f"with {o.EVENTS}, {o.CLEAN}, {o.DOCS}, hits as (select *, doc_ord // 5 as qid, doc_ord % 5 + 1 as rank from docs)"


@query(f"{_HITS} select qid, {o.CONTEXT} as context from hits group by qid")
def context_text(spark, sf_dir):
    return op.context_text(_hits(spark, sf_dir))


@query(f"{_HITS} select qid, {o.SOURCES} as sources from hits group by qid")
def project_sources(spark, sf_dir):
    return _sources_text(op.project_sources(_hits(spark, sf_dir)))


@query(
    f"""{_HITS} select qid, string_agg(case when doc_ord % 7 > 0 then text
      else trim(coalesce(title, '') || ' - ' || coalesce(city, ''), ' -') end, ' || ' order by rank) as contexts
    from hits group by qid"""
)
def retrieved_contexts(spark, sf_dir):
    """Every seventh event has no text and is shown by title and city."""
    hits = _hits(spark, sf_dir).withColumn("text", F.when(F.col("doc_ord") % 7 > 0, F.col("text")))
    return op.retrieved_contexts(hits).withColumn("contexts", F.array_join("contexts", " || "))


# --- Metrics --------------------------------------------------------------------------------------------------------

_VERDICTS = """verdicts as (select cast(substr(source, 4) as bigint) as qid, doc_id as rank, quality as relevant,
    1 - toxic as supported from labels join documents using (doc_id))"""
_PRECISION = """precision_by as (select qid, sum(case when relevant > 0 then h / p else 0 end) / (sum(relevant) + 1e-10)
    as context_precision from (select qid, relevant, sum(relevant) over w as h, count(*) over w as p from verdicts
    window w as (partition by qid order by rank rows unbounded preceding)) group by qid)"""
_FAITH = "faith_by as (select qid, avg(supported::double) as faithfulness from verdicts group by qid)"


@query(f"with {_VERDICTS}, {_PRECISION} select qid, round(context_precision, 9) as context_precision from precision_by")
def context_precision(spark, sf_dir):
    scored = op.context_precision(context_verdicts(spark, sf_dir))
    return scored.withColumn("context_precision", F.round("context_precision", 9))


@query(f"with {_VERDICTS}, {_FAITH} select qid, round(faithfulness, 9) as faithfulness from faith_by")
def faithfulness(spark, sf_dir):
    return op.faithfulness(context_verdicts(spark, sf_dir)).withColumn("faithfulness", F.round("faithfulness", 9))


@query(
    f"""{_HITS}, kept as (select qid, text, row_number() over (partition by qid order by rank) as rank from hits),
    given as (select doc_id // 5 as qid, row_number() over (partition by doc_id // 5 order by doc_id) as rank, quality
      from labels join documents using (doc_id))
    select qid, rank::int as rank, text as context, quality as relevant from kept left join given using (qid, rank)"""
)
def judged_contexts(spark, sf_dir):
    """The contexts of every question beside the verdicts on documents of its group, in their order."""
    group = F.floor(F.col("rank") / 5).alias("qid")
    verdicts = context_verdicts(spark, sf_dir).select(group, F.col("rank").alias("doc_id"), "relevant")
    ranked = op.first_events(verdicts, 5, "doc_id")  # groups have five documents at most
    return op.judged_contexts(op.retrieved_contexts(_hits(spark, sf_dir)), ranked)


_JUDGED = """judged as (select doc_id as qid,
    case when lang = 'de' then null when lang = 'es' then null else n_chars % 101 / 100.0 end::double as faithfulness,
    case when toxic = 1 then null else (n_chars % 7)::double / 7 end as context_precision, quality = 0 as no_context,
    lower(case when lang = 'fr' then 'Oui. ' when lang = 'en' then 'Le système Doit Retrouver ' else '' end || text) as ref
    from labels join documents using (doc_id)),
  classified as (select *, case
    when no_context and (contains(ref, 'doit retrouver') or contains(ref, 'doit proposer') or contains(ref, 'oui.'))
      then 'incorrecte'
    when coalesce(faithfulness, 0) >= 0.8 and coalesce(context_precision, 0) >= 0.3 then 'correcte'
    when coalesce(faithfulness, 0) >= 0.5 then 'partiellement correcte' else 'incorrecte' end as classification from judged)"""


@query(f"with {_JUDGED} select qid, classification from classified")
def classify_answers(spark, sf_dir):
    return plans.add_classification(judged(spark, sf_dir)).select("qid", "classification")


@query(
    f"""with {_JUDGED} select position, l.classification, count(c.qid) as n, (select count(*) from judged) as total,
    case when (select count(*) from judged) = 0 then 0.0::double
      else round_even(count(c.qid)::double / (select count(*) from judged) * 100, 1) end as percentage
    from (values (1, 'correcte'), (2, 'partiellement correcte'), (3, 'incorrecte')) l(position, classification)
    left join classified c on c.classification = l.classification group by position, l.classification"""
)
def class_summary(spark, sf_dir):
    return op.class_summary(plans.add_classification(judged(spark, sf_dir)))


@query(
    f"""with {_JUDGED} select 'context_precision' as metric, round(avg(context_precision), 9) as mean from judged
    union all select 'faithfulness', round(avg(faithfulness), 9) from judged"""
)
def metric_means(spark, sf_dir):
    scores = judged(spark, sf_dir).withColumn("faithfulness", F.col("faithfulness").try_cast("double"))
    return op.metric_means(scores).withColumn("mean", F.round("mean", 9))


@query(
    f"""with {o.EVENTS}, {o.CLEAN}, {o.DOCS}, {_VERDICTS}, {_PRECISION}, {_FAITH} select qid, reference, round(faithfulness, 9) as faithfulness,
    round(context_precision, 9) as context_precision, case
      when faithfulness >= 0.8 and context_precision >= 0.3 then 'correcte'
      when faithfulness >= 0.5 then 'partiellement correcte' else 'incorrecte' end as classification,
      (select count(*) from docs where doc_ord // 5 = qid)::int as n_contexts
    from (select item_id as qid, {o.strip('text')} as reference from benchmark) left join faith_by using (qid) left join precision_by using (qid)"""
)
def evaluate(spark, sf_dir):
    """Benchmark items as the annotated set, groups of documents as its answers."""
    test_set = table(spark, sf_dir, "benchmark").select(
        F.col("item_id").alias("qid"), F.col("text").alias("question"), F.col("text").alias("reference")
    )
    contexts = op.retrieved_contexts(_hits(spark, sf_dir))
    answers = contexts.withColumn("answer", F.lit("-"))
    samples = plans.evaluation_samples(test_set, answers, max_samples=None)
    verdicts = context_verdicts(spark, sf_dir)
    scored = plans.evaluate(samples, verdicts.drop("supported"), verdicts.select("qid", "supported"))
    return scored.select(
        "qid",
        "reference",
        F.round("faithfulness", 9).alias("faithfulness"),
        F.round("context_precision", 9).alias("context_precision"),
        "classification",
        F.size("contexts").alias("n_contexts"),
    )


@query(
    f"""select item_id as qid, {o.strip('text')} as question, {o.strip('text')} as reference,
    {o.strip('text')} as ground_truth, case when item_id % 3 > 0 then '-' end as answer,
    case when item_id % 3 > 0 then text else '' end as contexts from benchmark"""
)
def evaluation_samples(spark, sf_dir):
    """The whole annotated set; every third question has got no answer."""
    items = table(spark, sf_dir, "benchmark")
    test_set = items.select(F.col("item_id").alias("qid"), F.col("text").alias("question"), F.col("text").alias("reference"))
    answered = items.where("item_id % 3 > 0")
    answers = answered.select(F.col("item_id").alias("qid"), F.lit("-").alias("answer"), F.array("text").alias("contexts"))
    return plans.evaluation_samples(test_set, answers).withColumn("contexts", F.array_join("contexts", " || "))


@query(
    f"""with {_JUDGED} select qid, context_precision, case when lang = 'de' then 'n/a' when lang = 'es' then 'NaN'
      else (n_chars % 101 / 100.0)::double::varchar end as faithfulness, case when quality = 1 then text else '' end as contexts,
    case when lang = 'fr' then 'Oui. ' when lang = 'en' then 'Le système Doit Retrouver ' else '' end || text as reference,
    classification from classified join documents on doc_id = qid join labels using (doc_id)"""
)
def scores_round_trip(spark, sf_dir):
    path = scratch_path(spark, "scores-csv")
    sources.write_scores(plans.add_classification(judged(spark, sf_dir)), path, "csv")
    schema = "qid bigint, faithfulness string, context_precision double, contexts string, reference string, classification string"
    back = sources.read_clean_csv(spark, path, spark.createDataFrame([], schema).schema)
    contexts = F.array_join(F.from_json("contexts", "array<string>"), " || ")
    return back.withColumn("contexts", contexts)


# --- Corpus counts --------------------------------------------------------------------------------------------------


@query(
    """select strftime(l_shipdate, '%Y-%m') as month_year, count(*) as count from lineitem where l_shipdate is not null
    group by 1"""
)
def events_by_month(spark, sf_dir):
    return op.events_by_month(table(spark, sf_dir, "lineitem"), "l_shipdate")


@query(
    f"""with {o.EVENTS}, written as (select try_strptime(case when regexp_full_match(firstdate_begin, '[0-9]{{8}}')
      then firstdate_begin else replace(left(firstdate_begin, 10), '-', '') end, '%Y%m%d') as day from raw_events)
    select strftime(day, '%Y-%m') as month_year, count(*) as count from written where day is not null group by 1"""
)
def events_by_month_text(spark, sf_dir):
    """Dates as text: with a time, basic, blank or impossible ones."""
    return op.events_by_month(raw_events(spark, sf_dir))


@query("select user_id, count(*) as count from events group by 1 order by count desc, user_id limit 10")
def top_groups(spark, sf_dir):
    return op.top_groups(table(spark, sf_dir, "events"), "user_id")


@query(
    rf"""with {o.EVENTS} select cast(cast(right(code, 2) as int) as varchar) as arrondissement, count(*) as count
    from (select regexp_extract(location_postalcode, '(\d{{5}})', 1) as code from raw_events) where code like '75%'
    group by 1 order by count desc, arrondissement limit 10"""
)
def top_arrondissements(spark, sf_dir):
    return op.top_arrondissements(raw_events(spark, sf_dir))


# --- Streams --------------------------------------------------------------------------------------------------------


@query(f"{_RETRIEVE} select qid, sources, used_fallback from answers")
def stream_retrieve(spark, sf_dir):
    """Questions arriving as files, answered batch by batch."""
    index, inbox, out = (scratch_path(spark, name) for name in ("index", "inbox", "answers"))
    sources.write_index(_index(spark, sf_dir), index)
    asked = questions(spark, sf_dir)
    asked.write.parquet(inbox)
    stream = spark.readStream.schema(asked.schema).parquet(inbox)
    stream_answers(stream, index, out, scratch_path(spark, "checkpoint"), topics=TOPICS).awaitTermination()
    answers = spark.read.parquet(f"{out}/answers")
    return _sources_text(answers).select("qid", "sources", "used_fallback")


@query(
    f"""with recursive {o.EVENTS}, {o.CLEAN}, {o.DOCS}, {o.chunked('docs', 'doc_ord')}
    select uid, title, date_start, chunk_pos, c.text from chunks c join docs d on d.doc_ord = c.id"""
)
def stream_refresh(spark, sf_dir):
    """Event pages arriving as files, applied to an index that already holds an older text for every event.

    Events whose record has no description any more were in the index too, and leave it.
    """
    index, inbox = scratch_path(spark, "index"), scratch_path(spark, "pages")
    before = raw_events(spark, sf_dir).withColumn("description_fr", F.lit("ancienne version"))
    old = op.to_documents(op.strip_html(op.compose_text(before)), "doc_id")
    sources.write_index(plans.index_documents(old, topics=TOPICS), index)
    _write_pages(spark, sf_dir, inbox)
    events = op.prune_columns(stream_event_pages(spark, f"{inbox}/*")).drop("longdescription_fr")
    refresh = stream_index(events, index, scratch_path(spark, "checkpoint"), topics=TOPICS, by_range=True)
    refresh.awaitTermination()
    return sources.read_index(spark, index).select("uid", "title", "date_start", "chunk_pos", "text")
