"""The pipeline over whole tables, stage by stage, with the stages' promises checked on each result."""

import corpus_pipeline as p
from vespera.llm import simhash, suffixes
from vespera.session import materialize


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = {r.doc_id: (r.quality, r.toxic) for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    seen = [docs]
    for name, stage in p.STAGES:
        seen.append(materialize(stage(spark, seen[-1], sf_dir), name))
        if name != "pack":
            assert seen[-1].columns == docs.columns
    good, single, cut, packed = seen[1:]
    kept = {r.doc_id for r in good.select("doc_id").collect()}
    clean = [i for i, x in labels.items() if x == (1, 0)]
    assert len(kept & set(clean)) >= 0.95 * len(clean)
    assert len(kept & {i for i, x in labels.items() if x[1] == 1 or x[0] == 0}) <= 0.05 * len(labels)
    groups = simhash.near_duplicates(good).select("component_id").distinct().count()
    assert single.count() == groups
    assert cut.count() == single.count() and suffixes.repeated_passages(cut).count() <= suffixes.repeated_passages(single).count()
    ids = {r.doc_id for r in packed.select("doc_id").distinct().collect()}
    assert ids == {r.doc_id for r in cut.select("doc_id").collect()}


def test_near_duplicates_stage_follows_bit_distance(spark, sf_dir):
    """Brute force over all pairs of fingerprints; then the later stages work on what is left."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    bits = {r.doc_id: simhash.fingerprint(r.text) for r in docs.select("doc_id", "text").collect()}
    least = {i: i for i in bits}
    for a in bits:
        for b in bits:
            if a < b and (bits[a] ^ bits[b]).bit_count() <= 2:
                low, high = sorted((least[a], least[b]))
                least = {k: low if v == high else v for k, v in least.items()}
    single = materialize(p.near_duplicates(spark, docs, sf_dir), "single")
    assert sorted(r.doc_id for r in single.select("doc_id").collect()) == sorted(set(least.values()))
    cut = materialize(p.repeats(spark, single, sf_dir), "cut")
    packed = p.pack(spark, cut, sf_dir)
    assert {r.doc_id for r in packed.select("doc_id").distinct().collect()} == set(least.values())


def test_stages_keep_columns_whose_names_clash(spark):
    clash = "_id long, _hash long, _copy long, _spans string, _new string, row int, id int, hash int, kept_id int, fp int, n int"
    shared = " ".join(f"w{i}" for i in range(60))
    rows = [(0, f"a b {shared}"), (1, f"a b {shared}"), (1, f"a b {shared}"), (2, f"{shared} other words here and there"), (None, None)]
    docs = spark.createDataFrame([(*r, *[None] * 11) for r in rows], f"doc_id long, text string, {clash}")
    single = simhash.keep_one(docs)
    assert single.columns == docs.columns
    assert sorted(r.doc_id for r in single.where("doc_id is not null").collect()) == [0, 2]
    cut = suffixes.without_repeats(single)
    assert cut.columns == docs.columns
    assert {r.doc_id: r.text for r in cut.collect()} == {0: rows[0][1], 2: " other words here and there", None: None}
