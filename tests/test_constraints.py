import contextlib
import datetime as dt
import io
import random

from dateutil.parser import isoparse
from pyspark.sql import functions as F

from vespera.functions.dates import iso_date
from vespera.functions.fixed_values import TOPICS
from vespera.functions.text import searchable_text
from vespera.functions.topics import match_topics
from vespera.operators.chunk import bucket_of
from vespera.operators.constraints import apply_constraints, first_events, first_matches, with_facets
from vespera.operators.questions import parse_questions

TODAY = dt.date(2026, 7, 23)
EVENTS = [
    ("Ciné-concert au kiosque", "Paris", "Paris", "2026-08-02T18:00:00+02:00", "2026-08-02T20:00:00+02:00",
     "Un film muet, accompagné par un trio de jazz."),
    ("Trio au jardin", "Paris", "Paris", "2026-08-02T18:00:00+02:00", "2026-08-02T20:00:00+02:00", "Jazz en plein air."),
    ("Télescopes sur le toit", "Paris", "Paris", "2026-08-12T21:00:00+02:00", "2026-08-12T23:00:00+02:00",
     "Initiation à l'astronomie."),
    ("Planétarium ambulant", "Lyon", "Rhône", "2026-08-12T10:00:00+02:00", "2026-08-12T18:00:00+02:00",
     "L'astronomie pour tous."),
    ("Saison du ciel", "Paris", "Paris", "2026-07-01", "2026-09-30", "Chaque soir, une étoile différente."),
]
SCHEMA = "chunk_id long, uid string, title string, city string, department string, date_start string, date_end string, text string"


def chunks_from(spark, rows, topics=TOPICS):
    df = with_facets(spark.createDataFrame(rows, SCHEMA))
    return df.withColumn("topics", match_topics(searchable_text(F.col("text"), F.col("title")), topics))


def ask(spark, chunks, questions, today=TODAY, topics=TOPICS):
    q = parse_questions(spark.createDataFrame(questions, "qid long, question string"), F.lit(today), topics)
    pairs = chunks.withColumn("rank", F.col("chunk_id").cast("int")).join(q, F.col("chunk_id") >= 0)
    return q, apply_constraints(pairs)


def test_topics_and_filters(spark):
    chunks = chunks_from(spark, [(i, e[0], *e) for i, e in enumerate(EVENTS)])
    _, out = ask(spark, chunks, [
        (1, "Du cinéma avec du jazz à Paris ?"),
        (2, "De l’astronomie à Paris le 12 août 2026 ?"),
    ])
    got = {(r.qid, r.title) for r in out.collect()}
    assert got == {(1, EVENTS[0][0]), (2, EVENTS[2][0]), (2, EVENTS[4][0])}


# Written values of a chunk and what they mean.
TITLES = {"Jazz": {"jazz"}, "Expo": set(), "Visite des coulisses": {"visite"}, "": set(), None: set()}
BODIES = {
    "musique": {"concert"}, "film de jazz": {"cinema", "jazz"}, "archives": {"patrimoine"},
    "nuit des étoiles": {"astronomie"}, "rien": set(),
}
IN_PARIS = {"Paris": True, " paris ": True, "Lyon": False, "": False, None: False}
IN_93 = {"Paris": False, "Seine-Saint-Denis": True, " seine-saint-denis (93)": True, None: False}
AUGUST, SEPTEMBER = ((dt.date(2026, m, 1), dt.date(2026, m, last)) for m, last in ((8, 31), (9, 30)))
# Questions on TODAY and what they ask for: Paris, the department, topics, first and last day.
QUESTIONS = {
    "Quoi à Paris ?": (True, False, set(), TODAY, dt.date.max),
    "jazz en août": (False, False, {"jazz"}, *AUGUST),
    "dans le 93 en septembre": (False, True, set(), *SEPTEMBER),
    "ce week-end": (False, False, set(), dt.date(2026, 7, 25), dt.date(2026, 7, 26)),
    "le 12 août 2026": (False, False, set(), dt.date(2026, 8, 12), dt.date(2026, 8, 12)),
    "visite à Paris": (True, False, {"visite"}, TODAY, dt.date.max),
    "film de jazz à Paris le 1er septembre 2026": (True, False, {"cinema", "jazz"}, SEPTEMBER[0], SEPTEMBER[0]),
    " Quoi à Paris ?": (True, False, set(), TODAY, dt.date.max),
    "éclipse en mars": (False, False, {"astronomie"}, dt.date(2027, 3, 1), dt.date(2027, 3, 31)),
}


def test_both_paths_follow_the_rules(spark):
    rnd = random.Random(5)
    rows, days, events = [], {}, {}
    for i in range(900):
        day = dt.date(2026, 7, 1) + dt.timedelta(rnd.randint(0, 120))
        until = day + dt.timedelta(rnd.choice([0, 0, 1, 3, 40]))
        # a third of all chunks belong to one event
        uid = rnd.choice([None, "hot", "hot", str(rnd.randint(0, 200)), str(rnd.randint(0, 200)), None])
        title, city, department, body = (rnd.choice(list(v)) for v in (TITLES, IN_PARIS, IN_93, BODIES))
        start, first = rnd.choice([(f"{day}T10:00:00+02:00", day), (f"{day}", day), (" ", None), (None, None), ("bad", None)])
        end, last = rnd.choice([
            (f"{until}T23:30:00+00:00", until), (f"{until:%Y%m%d}", until), ("", first), (None, first), ("2026-13-01", None),
        ])
        rows.append((i, uid, title, city, department, start, end, body))
        if first and last:
            days[i] = first, last
        events.setdefault(uid or (title, start, (city or "").strip()), set()).add(i)
    dated = set(days)
    want = {}
    for n, (paris, area, topics, since, until) in enumerate(QUESTIONS.values()):
        fits = dated & {i for i in dated if days[i][1] >= max(since, TODAY) and days[i][0] <= until}
        fits &= {r[0] for r in rows if IN_PARIS[r[3]] or not paris}
        fits &= {r[0] for r in rows if IN_93[r[4]] or not area}
        fits &= {r[0] for r in rows if topics <= TITLES[r[2]] | BODIES[r[7]]}
        want[n] = sorted(min(chunks & fits) for chunks in events.values() if chunks & fits)
    assert max(map(len, want.values())) > 20
    chunks = chunks_from(spark, rows).repartition(6)
    q, out = ask(spark, chunks, list(enumerate(QUESTIONS)))

    def by_question(df):
        found = {n: [] for n in want}
        for r in df.orderBy("qid", "rank").collect():
            found[r.qid].append(r.chunk_id)
        return found

    top = {n: w[:3] for n, w in want.items()}
    assert by_question(out) == want
    assert by_question(first_events(out)) == top
    assert by_question(first_matches(q, chunks, 3)) == top
    # One chunk a document, in rounds of 40, 640 … documents, and with the buckets that a stored index has.
    spread = chunks.withColumn("chunk_id", F.shiftleft("chunk_id", 20))
    ids = {n: [i << 20 for i in w] for n, w in top.items()}
    for table in (spread, spread.withColumn("bucket", bucket_of(F.col("chunk_id")))):
        assert by_question(first_matches(q, table, 3, first_docs=40)) == ids


def test_first_matches_of_wide_reversed_and_far_dates(spark):
    days = [("0001-01-02", "9999-12-30"), ("2026-09-20", "2026-07-01"), ("9999-01-01", "9999-12-31"), ("2020-01-01", "2026-07-23"),
            ("2026-07-01", "2026-09-20"), ("2024-01-01", "2029-01-01"), ("2026-08-12", None), ("2027-03-05", "2027-03-05")]
    rows = [(i << 20, str(i), "t", "Paris", "Paris", a, b, "x") for i, (a, b) in enumerate(days)]
    texts = ["Quoi à Paris ?", "le 12 août 2026", "quoi en mars", "quoi en juillet", "ce week-end à Paris"]
    q, out = ask(spark, chunks_from(spark, rows), list(enumerate(texts)))
    both = [sorted((r.qid, r.chunk_id) for r in df.collect()) for df in (out, first_matches(q, chunks_from(spark, rows), 99, first_docs=3))]
    assert both[0] == both[1] and len(both[0]) > 15
    none = chunks_from(spark, rows).where("chunk_id < 0")
    assert first_matches(q, none).count() == 0 and first_matches(q.limit(0), chunks_from(spark, rows)).count() == 0


def test_scan_is_told_the_dates_and_cities_asked_for(spark, tmp_path):
    rows = [(i << 20, str(i), "t", c, "Paris", "2026-08-12", None, "x") for i, c in enumerate(["Paris", "Lyon"] * 5)]
    chunks_from(spark, rows).write.parquet(f"{tmp_path}/chunks")
    q, _ = ask(spark, chunks_from(spark, rows), [(1, "Quoi à Paris le 12 août 2026 ?")])
    found = first_matches(q, spark.read.parquet(f"{tmp_path}/chunks"))
    with contextlib.redirect_stdout(io.StringIO()) as plan:
        found.explain("formatted")
    pushed = [x for x in plan.getvalue().splitlines() if "PushedFilters" in x and "city_norm" in x]
    assert pushed and all("EqualTo(city_norm,paris)" in x and "end_d,2026-08-12" in x and "start_d,2026-08-12" in x for x in pushed)
    assert [r.chunk_id >> 20 for r in found.orderBy("rank").collect()] == [0, 2, 4]


def test_iso_dates_agree_with_dateutil(spark):
    texts = [
        "2026-08-01T00:30:00+02:00", "2026-08-01", "20260801", "2026-08", "2026", "202608", "2026-8-1", "2026-02-30",
        "2026-08-01T", "2026-08-01Tgarbage", "2026-08-01 10", "2026-08-01T10:00", "2026-08-01T1000", "2026-08-01x10:00:00.123Z",
        "2026-08-01T10:00:00,5-0530", "2026-08-01T24:00", "2026-08-01T24:01", "2026-12-31T24:00:00", "20261231T24",
        "2026-08-01T25:00", "2026-08-01T10:60", "2026-W31", "2026W31", "2026-W31-6", "2026W316", "2026-W316", "2026-W54",
        "2026-W31-6T10:00", "2026-213", "2026213", "2026-000", "2026-366", "2024-366", "2026213T10", "nan", "x", "2026-0801",
        "2026-08-01T10:0000", "2026-08-01T100000", "2026-08-01T10:00:00+24:00", "2026-08-01T10:00:00+5", "2026-13-01",
        "01/08/2026", "2026-08-01T10:00:00+02", "2026-08-01T10:00:00z", "2026-08-01T10:00:60", "0000-01-01",
    ]

    def by_dateutil(t):
        try:
            return isoparse(t).date()
        except (ValueError, OverflowError):
            return None

    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for r in df.select("t", iso_date(F.col("t")).alias("d")).collect():
        assert r.d == by_dateutil(r.t), r.t
