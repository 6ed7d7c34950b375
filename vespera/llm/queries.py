"""The operators over their whole tables, and the pipeline, as registered queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, bpe, embed_dedup, fm_index, keyed, mixing, ordinal, packing, prefix_trie, separators, simhash, suffixes, whitening
from .common import scratch_path, table
from .tokens import tokenizer_path

#: The id that ends a document in flat files; text never encodes to it there.
SEPARATOR = 50256


def op1_nearest_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return ann.nearest(vectors, vectors.where("vec_id % 20 = 0"), k=20)


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "fingerprint", "component_id")


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's token count, from flat files of all documents."""
    path = scratch_path(spark, "flat")
    separators.write_flat(table(spark, sf_dir, "documents"), path, tokenizer_path(), SEPARATOR)
    blocks = spark.read.schema(separators.FILE).parquet(path)
    counts = separators.named(separators.scan_separators(blocks, SEPARATOR), blocks)
    return counts.select("doc_id", "n_tokens")


def op4_vector_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed_dedup.near_duplicate_vectors(table(spark, sf_dir, "embeddings"), 0.98)


def op5_mixed_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.score_texts(table(spark, sf_dir, "documents"))


def op6_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_digests(table(spark, sf_dir, "documents"), tokenizer_path())


def op7_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every stretch of repeated passages, in words."""
    found = suffixes.repeated_passages(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.col("start").alias("start_word"), F.col("end").alias("end_word"), "first_doc_id")


def op8_keyed_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "keyed")
    keyed.write_keyed(table(spark, sf_dir, "documents"), path, tokenizer_path(), end_id=2)
    return keyed.read_keyed(spark, path)


def op9_quality_grades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's expected grade, the chances of its grades, and whether it is kept."""
    docs = table(spark, sf_dir, "documents")
    model = ordinal.train(docs, ordinal.graded(table(spark, sf_dir, "labels")), grades=3)
    tail = lambda i: F.element_at("tails", i)
    return ordinal.score(docs.select("doc_id", "text"), model).select(
        F.col("doc_id").cast("long").alias("doc_id"),
        "expected_grade",
        tail(1).alias("p_not_toxic"),
        tail(2).alias("p_good"),
        (tail(2) >= 0.5).alias("kept"),
    )


def op10_packed_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(table(spark, sf_dir, "documents"), tokenizer_path(), length=2048, end_id=1)
    return pieces.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def op11_repeated_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the words of windows of twenty that occur earlier."""
    cut = fm_index.remove_repeats(table(spark, sf_dir, "documents"), window=20)
    return cut.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op12_whitened(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector on the eight widest components; the deviation as a long, which raises once it no longer fits."""
    rows = whitening.whiten(table(spark, sf_dir, "embeddings"), components=8, scale=1024, shift=100_000)
    return rows.withColumn("deviation", F.col("deviation").cast("long"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every prefix of the conversations, which share the first turns of the first one of each twenty."""
    turns = prefix_trie.with_shared_starts(table(spark, sf_dir, "conversations"), every=20, most=4)
    return prefix_trie.prefix_trie(turns).drop("a", "b")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_nearest_vectors,
        op2_simhash,
        op3_token_counts,
        op4_vector_duplicates,
        op5_mixed_scores,
        op6_bpe_round_trip,
        op7_repeated_passages,
        op8_keyed_ids,
        op9_quality_grades,
        op10_packed_pieces,
        op11_repeated_windows,
        op12_whitened,
        op13_prefix_trie,
    )
}

#: crc32 of the decimal digits of ``c``, a bit at a time.
_CRC32 = """xor(list_reduce(list_prepend(4294967295, list_transform(string_split(c::varchar, ''), lambda s: ascii(s)::bigint)),
    lambda x, y: list_reduce(list_prepend(xor(x, y), range(8)),
      lambda b, i: case when b & 1 = 1 then xor(b >> 1, 3988292384) else b >> 1 end)), 4294967295)"""

#: SQL for what it can express: one row per vector, linked by whole-table comparison within labels; every node of the
#: trie beside the nodes whose key starts with its own.
SQL: dict[str, str] = {
    "op4_vector_duplicates": """
        with recursive v as (
            select vec_id, label, embedding::double[] e from embeddings
            where label is not null and embedding is not null
              and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
              and len(list_filter(embedding, lambda x: x <> 0)) > 0),
        link as (
            select a.vec_id a, b.vec_id b from v a join v b on a.label = b.label and a.vec_id <> b.vec_id
            where list_cosine_similarity(a.e, b.e) >= 0.98),
        reach as (
            select vec_id as id, vec_id as other from embeddings
            union select reach.id, link.b from reach join link on reach.other = link.a)
        select e.vec_id, (select count(*) from link where a = e.vec_id) as n_links, min(r.other) as component_id,
               e.vec_id = min(r.other) as kept
        from embeddings e join reach r on r.id = e.vec_id group by e.vec_id""",
    "op11_repeated_windows": r"""
        with given as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as words from documents),
        split as (select doc_id, unnest(words) as word, generate_subscripts(words, 1) as place from given),
        windows as (select doc_id, place as s, string_agg(word, ' ') over w as text, count(*) over w as n from split
            window w as (partition by doc_id order by place rows between current row and 19 following)),
        late as (select doc_id, s from windows where n = 20
            qualify row_number() over (partition by text order by doc_id nulls first, s) > 1),
        gone as (select distinct doc_id, s + i as place from late, range(0, 20) r(i)),
        kept as (select doc_id, count(*) as n, string_agg(word, ' ' order by place) as text
            from split s where not exists (from gone g where g.doc_id = s.doc_id and g.place = s.place) group by doc_id)
        select given.doc_id, len(words)::bigint as n_words, len(words) - coalesce(kept.n, 0) as n_removed,
            sha256(coalesce(kept.text, '')) as kept_sha256 from given left join kept using (doc_id)""",
    "op13_prefix_trie": rf"""
        with ids as (select distinct conv_id as c from conversations where conv_id is not null),
        given as (select c, {_CRC32} % 4 as h from ids),
        own as (select conv_id, coalesce(role, '') as role, coalesce(text, '') as text, row_number() over (partition by
            conv_id order by turn nulls first, coalesce(role, ''), coalesce(text, '')) - 1 as place from conversations),
        turns as (
            select c, 0 as part, place, role, text from given join own on conv_id = c - c % 20 and place < h
            union all select c, 1, place, role, text from given join own on conv_id = c and place >= h),
        path as (
            select c, 0 as depth, '' as key, 0 as words from ids union all
            select c, row_number() over w, string_agg(sha256(length(role) || ':' || role || text), '') over w,
                len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) from turns
            window w as (partition by c order by part, place rows unbounded preceding)),
        node as (select key, depth, min(c) as conv_id, count(*) as n, any_value(words) as words from path group by all),
        last as (select c, arg_max(key, depth) as key from path group by c),
        ends as (select key, string_agg(c::varchar, ',' order by c) as ids from last group by key),
        child as (select key[:-65] as key, count(*) as n from node where depth > 0 group by all),
        below as (select t.key, count(*) filter (c.key is null) as leaves, sum((d.n - 1) * d.words) as saved
            from node t join node d on starts_with(d.key, t.key) left join child c on c.key = d.key group by t.key)
        select t.conv_id, t.depth::bigint as depth, p.conv_id as parent_conv_id, t.n as n_convs,
            coalesce(c.n, 0)::bigint as n_children, b.leaves as n_leaves, b.saved::bigint as saved_tokens,
            sha256(coalesce(e.ids, '')) as ends_sha256
        from node t join below b using (key) left join child c using (key) left join ends e using (key)
        left join node p on t.depth > 0 and p.key = t.key[:-65]""",
}
