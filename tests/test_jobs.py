import contextlib
import datetime as dt
import importlib
import io
import json
import pathlib

import pytest
from pyspark.sql import functions as F

from test_constraints import EVENTS
from vespera import plans, sources
from vespera.functions.fixed_values import EMPTY_CONTEXT
from vespera.functions.text import assemble_prompt
from vespera.session import materialize, scratch_dir, scratch_scope
from vespera.streaming import refresh_batch, stream_answers, stream_event_pages, stream_index

TODAY = dt.date(2026, 7, 23)
RAW = "uid string, title_fr string, description_fr string, location_city string, location_department string, firstdate_begin string, lastdate_end string"
SWING = ("Bal swing au bord du canal", "Paris", "Paris", "2026-07-24T19:00:00+02:00", "2026-07-24T22:00:00+02:00",
         "Du jazz manouche à danser.")


def raw(spark, events=(*EVENTS, SWING)):
    return spark.createDataFrame([(e[0], e[0], e[5], *e[1:5]) for e in events], RAW).coalesce(1)


def questions(spark, texts, first=0):
    return spark.createDataFrame([(first + i, t, TODAY) for i, t in enumerate(texts)], "qid long, question string, as_of date")


QUESTIONS = [
    "Des concerts de jazz à Paris le 24 juillet 2026 ?",
    "Du cinéma avec du jazz à Paris le 2 août 2026 ?",
    "De l’astronomie à Paris le 12 août 2026 ?",
    "Une visite dans le 93 ?",
]


def titles(row):
    return {s.title for s in row.sources}


def test_questions_end_to_end(spark, tmp_path):
    path = f"{tmp_path}/index"
    counts = plans.rebuild_index(plans.clean_events(raw(spark)), path).first()
    assert (counts.nb_documents, counts.nb_chunks) == (6, 6)
    out = {r.qid: r for r in plans.retrieve(questions(spark, QUESTIONS), sources.read_index(spark, path)).collect()}
    # "concerts" asks for the topic too: the ball has no such word, so only the date-free rules decide here.
    assert titles(out[1]) == {EVENTS[0][0]}
    assert titles(out[2]) == {EVENTS[2][0], EVENTS[4][0]}
    assert out[3].sources == [] and out[3].context == EMPTY_CONTEXT and out[3].used_fallback
    assert EMPTY_CONTEXT in out[3].prompt and "Thursday 23 July 2026" in out[3].prompt
    block = next(b for b in out[2].context.split("\n\n---\n\n") if "Télescopes" in b.split("\n")[1])
    assert block.startswith(
        "ÉVÉNEMENT DISPONIBLE DANS LA BASE :\nTitre : Télescopes sur le toit\nVille : Paris\n"
        "Département : Paris\nDate : du 2026-08-12T21:00:00+02:00 au 2026-08-12T23:00:00+02:00\nContenu indexé :\nTitre: "
    )


def test_fallback_only_without_any_hit(spark):
    events = [(f"E{i}", "Paris", "Paris", "2026-08-01", "2026-08-01", "musique " * 3) for i in range(9)]
    index = plans.build_index(plans.clean_events(raw(spark, events))).cache()
    near = plans.retrieve(questions(spark, ["musique à Paris"]), index, k=2).first()
    assert len(near.sources) == 2 and not near.used_fallback
    later = [*events, ("Loin", "Paris", "Paris", "2027-03-01", "2027-03-02", "tout autre texte")]
    index = plans.build_index(plans.clean_events(raw(spark, later))).cache()
    far = plans.retrieve(questions(spark, ["musique musique le 1er mars 2027"]), index, k=2, topics={}).first()
    assert titles(far) == {"Loin"} and far.used_fallback
    first = plans.retrieve(questions(spark, ["quoi le 1er août 2026"]), index, k=1, topics={}).first()
    assert len(first.sources) in (1, 3)


def test_empty_build(spark, tmp_path):
    clean = plans.clean_events(raw(spark))
    path = f"{tmp_path}/index"
    plans.rebuild_index(clean, path)
    with pytest.raises(ValueError, match="no chunks"):
        plans.rebuild_index(clean.where("uid = 'none'"), path)
    assert sources.read_index(spark, path).count() == 6
    with pytest.raises(FileNotFoundError):
        sources.read_index(spark, f"{tmp_path}/none")


def test_search_excerpt(spark):
    index = plans.build_index(plans.clean_events(raw(spark))).cache()
    rows = plans.search(questions(spark, ["concert de jazz à Paris"]), index).orderBy("rank").collect()
    assert [r["rank"] for r in rows] == [1, 2, 3] and all(len(r.excerpt) <= 250 for r in rows)


def test_prompt_values_are_not_templates(spark):
    df = spark.createDataFrame([("{question}", "{context}")], "c string, q string")
    prompt = df.select(assemble_prompt(F.lit("d"), F.col("c"), F.col("q"), "{date_du_jour}|{context}|{question}|{context}"))
    assert prompt.first()[0] == "d|{question}|{context}|{question}"


def test_refresh_replaces_events_once(spark, tmp_path):
    path = f"{tmp_path}/index"
    plans.rebuild_index(plans.clean_events(raw(spark)), path)
    changed = raw(spark, [(*EVENTS[1][:5], "Nouveau texte"), ("Ajout", "Paris", "Paris", "2026-08-03", "2026-08-03", "neuf")])
    for _ in range(2):  # the second run of the batch changes nothing
        refresh_batch(changed, path, "s/7")
        rows = sources.read_index(spark, path).collect()
        assert len(rows) == 7 and len({r.chunk_id for r in rows}) == 7
        assert [r.text for r in rows if r.title == EVENTS[1][0]][0].endswith("Nouveau texte")
    with contextlib.redirect_stdout(io.StringIO()) as plan:
        sources.read_index(spark, path).explain()
    assert "BroadcastHashJoin" in plan.getvalue() and "Exchange hash" not in plan.getvalue()  # the index is not moved
    assert plan.getvalue().count("FileScan parquet") == 2  # the segments, and the list of newest versions
    refresh_batch(raw(spark, [(*EVENTS[1][:5], "Encore")]), path, "s/8")
    rows = sources.read_index(spark, path).collect()
    assert len(rows) == 7 and [r.text for r in rows if r.title == EVENTS[1][0]][0].endswith("Encore")
    plans.rebuild_index(plans.clean_events(raw(spark)), path)
    assert sources.read_index(spark, path).count() == 6


def test_streams(spark, tmp_path):
    pages, path, out = f"{tmp_path}/pages", f"{tmp_path}/index", f"{tmp_path}/out"
    (tmp_path / "pages").mkdir()

    def put(name, events):
        keys = RAW.replace(" string", "").split(", ")
        records = [{**dict(zip(keys, (e[0], e[0], e[5], *e[1:5]))), "longdescription_fr": e[5]} for e in events]
        (tmp_path / "pages" / name).write_text(json.dumps({"results": records}))

    put("1.json", EVENTS)
    stream_index(stream_event_pages(spark, pages), path, f"{tmp_path}/c1").awaitTermination()
    assert sources.read_index(spark, path).count() == 5
    put("2.json", [(*EVENTS[0][:5], "Corrigé : cinéma et jazz."), SWING])
    stream_index(stream_event_pages(spark, pages), path, f"{tmp_path}/c1").awaitTermination()
    index = sources.read_index(spark, path)
    assert index.count() == 6 and index.where("text like '%Corrigé%'").count() == 1

    questions(spark, [*QUESTIONS, " \n "]).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("qid long, question string, as_of date").parquet(f"{tmp_path}/in")
    stream_answers(stream, path, out, f"{tmp_path}/c2").awaitTermination()
    questions(spark, QUESTIONS[:1]).withColumn("qid", F.lit(90).cast("long")).write.parquet(f"{tmp_path}/in2")
    again = spark.readStream.schema("qid long, question string, as_of date").parquet(f"{tmp_path}/in2")
    stream_answers(again, path, out, f"{tmp_path}/c4").awaitTermination()  # another stream starts with batch 0 again
    (tmp_path / "other").mkdir()
    (tmp_path / "pages" / "2.json").rename(tmp_path / "other" / "1.json")
    put("9.json", [("Ailleurs", "Lyon", "Rhône", "2026-09-01", "2026-09-01", "autre flux")])
    (tmp_path / "pages" / "9.json").rename(tmp_path / "other" / "9.json")
    before = sources.read_index(spark, path).count()
    stream_index(stream_event_pages(spark, f"{tmp_path}/other"), path, f"{tmp_path}/c3").awaitTermination()
    assert sources.read_index(spark, path).count() == before + 1
    answers = {r.qid: r for r in spark.read.parquet(f"{out}/answers").collect()}
    assert answers.pop(90).question == QUESTIONS[0]
    assert set(answers) == {0, 1, 2, 3} and titles(answers[2]) == {EVENTS[2][0], EVENTS[4][0]}
    assert [r.reason for r in spark.read.parquet(f"{out}/rejected").collect()] == ["empty"]


def test_a_streams_search_merges_nothing(spark, tmp_path, monkeypatch):
    knn = importlib.import_module("vespera.operators.knn")
    path, merged, merge = f"{tmp_path}/index", [], knn.top_k

    def watched(pairs, *a):
        merged.append(merge(pairs, *a) is not pairs)
        return merge(pairs, *a)

    monkeypatch.setattr(knn, "top_k", watched)
    plans.rebuild_index(plans.clean_events(raw(spark)), path)
    questions(spark, QUESTIONS).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("qid long, question string, as_of date").parquet(f"{tmp_path}/in")
    stream_answers(stream, path, f"{tmp_path}/out", f"{tmp_path}/c").awaitTermination()
    assert merged == [False]  # one group of chunks: the rows of its search are final
    answers = {r.qid: titles(r) for r in spark.read.parquet(f"{tmp_path}/out/answers").collect()}
    asked = questions(spark, QUESTIONS)
    assert answers == {r.qid: titles(r) for r in plans.retrieve(asked, sources.read_index(spark, path)).collect()}


def gone(event):
    return (*event[:5], None)


def test_events_without_description_leave_the_index_and_may_come_back(spark, tmp_path):
    path = f"{tmp_path}/index"
    plans.rebuild_index(plans.clean_events(raw(spark)), path)
    titles_of = lambda: sorted(r.title for r in sources.read_index(spark, path).select("title").collect())
    every = titles_of()
    # One event loses its description, one keeps only blanks, one is new and has none, one is only changed.
    batch = raw(spark, [gone(EVENTS[0]), gone(("Neuf", *EVENTS[0][1:])), (*EVENTS[2][:5], "Autre texte")])
    for _ in range(2):
        assert refresh_batch(batch, path, "s/1").first().nb_chunks == 1
        assert titles_of() == sorted(set(every) - {EVENTS[0][0]})
    nothing = refresh_batch(raw(spark, [gone(EVENTS[1])]), path, "s/2").first()  # a refresh that only removes
    assert (nothing.nb_documents, nothing.nb_chunks) == (0, 0)
    assert titles_of() == sorted(set(every) - {EVENTS[0][0], EVENTS[1][0]})
    answer = plans.retrieve(questions(spark, [QUESTIONS[1]]), sources.read_index(spark, path)).first()
    assert EVENTS[0][0] not in titles(answer)
    refresh_batch(raw(spark, [EVENTS[0]]), path, "s/3")
    assert titles_of() == sorted(set(every) - {EVENTS[1][0]})
    # Of several records of one event in a batch, those with a description stay.
    refresh_batch(raw(spark, [gone(EVENTS[2]), EVENTS[2]]), path, "s/4")
    assert titles_of() == sorted(set(every) - {EVENTS[1][0]})


def test_events_without_uid_are_removed_by_title_start_and_city(spark, tmp_path):
    path = f"{tmp_path}/index"
    nameless = raw(spark).withColumn("uid", F.lit(None).cast("string"))
    plans.rebuild_index(plans.clean_events(nameless), path)
    refresh_batch(raw(spark, [gone(EVENTS[3])]).withColumn("uid", F.lit(" ")), path, "s/1")
    left = {r.title for r in sources.read_index(spark, path).collect()}
    assert left == {e[0] for e in (*EVENTS, SWING)} - {EVENTS[3][0]}


def test_compaction_keeps_rows_and_leaves_one_scan(spark, tmp_path):
    path = f"{tmp_path}/index"
    plans.rebuild_index(plans.clean_events(raw(spark)), path)
    for i in range(10):
        events = [(*EVENTS[i % 5][:5], f"Texte {i}"), (f"Ajout {i}", "Paris", "Paris", "2026-08-03", None, "neuf")]
        events += [gone((f"Ajout {i - 4}", "Paris", "Paris", "2026-08-03", None, ""))] if i > 4 else []
        refresh_batch(raw(spark, events), path, f"s/{i}")
    columns = [c for c in sources.read_index(spark, path).columns]
    rows = lambda: sorted(map(str, sources.read_index(spark, path).select(*columns).collect()))
    before = rows()
    assert len(before) == 6 + 10 - 5
    assert [len(list((tmp_path / "index" / d).glob("segment=*"))) for d in ("segments", "touched")] == [11, 10]
    made = sources.compact_index(spark, path).first()
    assert (made.version, made.nb_chunks) == (12, 11) and rows() == before
    assert sources.drop_replaced(spark, path, keep=3) == 8 and sources.drop_replaced(spark, path) == 3
    assert rows() == before
    assert [len(list((tmp_path / "index" / d).glob("segment=*"))) for d in ("segments", "touched")] == [1, 0]
    with contextlib.redirect_stdout(io.StringIO()) as plan:
        sources.read_index(spark, path).explain()
    assert plan.getvalue().count("FileScan parquet") == 1 and "Join" not in plan.getvalue()
    assert refresh_batch(raw(spark, [gone(EVENTS[0])]), path, "s/3").first().version == 5  # applied before, still known
    assert rows() == before
    # A refresh that ends while a compaction runs takes its version.
    refresh_batch(raw(spark, [SWING]), path, "s/90")
    with pytest.raises(RuntimeError, match="claimed"):
        sources.write_index(sources.read_index(spark, path), path, after=12)


def test_documents_are_numbered_without_gaps(spark, tmp_path):
    path = f"{tmp_path}/index"
    many = [(f"E{i}", "Paris", "Paris", "2026-08-01", None, "x" if i % 3 else None) for i in range(90)]
    spread = raw(spark, many).repartition(7)
    documents = plans.clean_events(spread)
    plans.rebuild_index(documents, path)
    numbers = lambda: sorted(r.doc_ord for r in sources.read_index(spark, path).select("doc_ord").collect())
    assert numbers() == list(range(60))
    refresh_batch(raw(spark, [("N1", "Paris", "Paris", "2026-08-01", None, "neuf"), many[1]]), path, "s/1")
    assert sources.read_log(spark, path).agg(F.max("next_ord")).first()[0] == 62
    assert len(numbers()) == 61 and numbers()[-2:] == [60, 61]
    order = [r.title for r in plans.build_index(plans.clean_events(raw(spark, many))).orderBy("doc_ord").collect()]
    assert order == [e[0] for e in many if e[5]]


def test_answers_read_the_buckets_of_their_hits_only(spark, tmp_path):
    path = f"{tmp_path}/index"
    body = ["jazz", "musique", "théâtre", "danse", "cirque", "lecture"]
    events = [(f"E{i}", "Paris", "Paris", "2026-08-01", None, f"{body[i % 6]} " * (i + 1)) for i in range(24)]
    numbered = plans.clean_events(raw(spark, events)).withColumn("n", F.shiftleft(F.substring("title_fr", 2, 9).cast("long"), 14))
    plans.rebuild_index(numbered, path, ord_col="n")  # a bucket for each event
    index = sources.read_index(spark, path)
    assert len(list((tmp_path / "index" / "segments").glob("segment=*/bucket=*"))) == 24
    asked = questions(spark, ["théâtre théâtre le 1er août 2026", "quoi le 1er août 2026"])
    answers = plans.retrieve(asked, index, k=2, topics={})
    with contextlib.redirect_stdout(io.StringIO()) as plan:
        answers.explain("formatted")
    filters = [x for x in plan.getvalue().splitlines() if "PartitionFilters" in x and "bucket" in x]
    assert filters and any("dynamicpruning" in x for x in filters)
    rows = {r.qid: r for r in answers.collect()}
    plain = {r.qid: r for r in plans.retrieve(asked, plans.build_index(numbered, "n").cache(), k=2, topics={}).collect()}
    assert rows == plain and all(rows.values())
    shown = {r.title for r in plans.search(asked, index, 1).collect()}
    assert shown <= {e[0] for e in events}


def test_search_labels_missing_values(spark):
    events = raw(spark, [("Jazz", None, "Paris", None, None, "jazz")]).withColumn("title_fr", F.lit(None).cast("string"))
    row = plans.search(questions(spark, ["jazz"]), plans.build_index(plans.clean_events(events)).cache()).first()
    assert (row.title, row.city, row.date_start) == ("Titre inconnu", "Ville inconnue", "Date inconnue")


def test_streams_free_their_scratch_tables(spark, tmp_path):
    scratch = scratch_dir(spark)
    path = f"{tmp_path}/index"
    plans.rebuild_index(plans.clean_events(raw(spark)), path)
    questions(spark, QUESTIONS).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("qid long, question string, as_of date").parquet(f"{tmp_path}/in")
    folder = pathlib.Path(scratch.removeprefix("file:"))
    before = set(folder.iterdir())
    stream_answers(stream, path, f"{tmp_path}/out", f"{tmp_path}/c").awaitTermination()
    refresh_batch(raw(spark, [SWING]), path, "s/5")
    assert set(folder.iterdir()) == before and spark.read.parquet(f"{tmp_path}/out/answers").count() == 4
    with pytest.raises(ValueError, match="stop"), scratch_scope(spark) as own:
        kept = materialize(spark.range(3), "t")
        with scratch_scope(spark) as inner:
            assert inner.startswith(own) and materialize(spark.range(2), "t").count() == 2
        assert kept.count() == 3
        raise ValueError("stop")
    assert set(folder.iterdir()) == before
