"""The given tables seen as the library's inputs: events, questions, verdicts. Whole tables, whole texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Words of the given texts, which are invented prose, in place of the shipped topic words.
TOPICS = {"eau": ["eaux", "eau"], "que": ["que"], "nicht": ["nicht"], "tion": ["tion"], "jazz": ["jazz", "ciné-jazz"]}

# What is added to a user turn to make it ask for a place and a period.
PHRASES = [
    "à Paris le 12 août 2026 ?",
    "dans le 93 en mai",
    "ce week-end à Paris",
    "le 1er septembre 2026",
    "en décembre",
    "",
    "le 31 février 2026 à Paris",
    "les 19 et 20 juin 2026",
    "Seine Saint Denis ce week end",
    "en 1993 à PARIS",
]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def raw_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One event record per document, with the gaps and odd spellings that real records have."""
    return table(spark, sf_dir, "documents").selectExpr(
        "doc_id",
        "case when lang <> 'es' then cast(doc_id - doc_id % 3 as string) end as uid",
        "concat('Agenda ', source, case when n_chars > 2000 then ' (long)' else '' end) as title_fr",
        "case when n_chars >= 200 then text end as description_fr",
        "case lang when 'fr' then 'Paris' when 'en' then ' paris ' when 'de' then 'Lyon' end as location_city",
        """case when source in ('src1', 'src3', 'src5') then 'Seine-Saint-Denis' when source = 'src7' then null
           else 'Paris' end as location_department""",
        """case when lang = 'de' then '69001' when lang = 'es' then 'inconnu' else concat(
             case when lang = 'fr' then 'F-750' else '750' end,
             lpad(cast(cast(substr(source, 4) as int) % 20 + 1 as string), 2, '0'),
             case when lang = 'en' then '.0' else '' end) end as location_postalcode""",
        """case source when 'src2' then date_format(date_add(date'2026-01-01', cast(doc_id % 365 as int)), 'yyyyMMdd')
             when 'src4' then '2026-02-30T10:00:00+00:00' when 'src6' then ' '
             else concat(date_format(date_add(date'2026-01-01', cast(doc_id % 365 as int)), 'yyyy-MM-dd'),
                         'T00:30:00+02:00') end as firstdate_begin""",
        """case source when 'src8' then null when 'src9' then ''
             else date_format(date_add(date'2026-01-01', cast(doc_id % 365 + doc_id % 30 as int)), 'yyyy-MM-dd')
             end as lastdate_end""",
    )


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``qid, question, as_of`` from every user turn."""
    phrases = F.array(*[F.lit(p) for p in PHRASES])
    turns = table(spark, sf_dir, "conversations").where(F.col("role") == "user")
    pick = ((F.col("conv_id") + F.col("turn")) % len(PHRASES)).cast("int")
    return turns.select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("qid"),
        F.concat("text", F.lit(" "), phrases[pick]).alias("question"),
        F.date_add(F.lit("2026-03-01").cast("date"), (F.col("conv_id") % 200).cast("int")).alias("as_of"),
    )


def context_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels as verdicts on ranked contexts: one question per source of documents, ranked by document."""
    labels, documents = table(spark, sf_dir, "labels"), table(spark, sf_dir, "documents").select("doc_id", "source")
    return labels.join(documents, "doc_id").select(
        F.substring("source", 4, 9).cast("bigint").alias("qid"),
        F.col("doc_id").alias("rank"),
        F.col("quality").alias("relevant"),
        (1 - F.col("toxic")).alias("supported"),
    )


def judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One judged answer per labelled document: scores with gaps, references that do and do not expect an event."""
    labels, documents = table(spark, sf_dir, "labels"), table(spark, sf_dir, "documents")
    return labels.join(documents, "doc_id").selectExpr(
        "doc_id as qid",
        """case when lang = 'de' then 'n/a' when lang = 'es' then 'NaN'
             else cast(cast(n_chars % 101 as double) / 100 as string) end as faithfulness""",
        "case when toxic = 1 then null else cast(n_chars % 7 as double) / 7 end as context_precision",
        "case when quality = 1 then array(text) else cast(array() as array<string>) end as contexts",
        """concat(case when lang = 'fr' then 'Oui. ' when lang = 'en' then 'Le système Doit Retrouver ' else '' end,
             text) as reference""",
    )
