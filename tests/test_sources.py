import json

import pytest
from pyspark.sql import functions as F

from kinlattice.operators import intervals, matching
from kinlattice.sources import dna, seeds, sinks
from kinlattice.streaming import events as streams

KITS = {
    "23andme": "# This data file generated by 23andMe\n# rsid\tchromosome\tposition\tgenotype\nrs1\t1\t100\tGA\nrs2\tX\t5\t--\nrs3\tMT\t7\tA\nbad\trow\tx\ty\n",
    "ancestry": "#AncestryDNA raw data\nrsid\tchromosome\tposition\tallele1\tallele2\nrs1\t1\t100\tG\tA\nrs2\t23\t5\t0\t0\nrs3\t25\t7\tA\tA\n",
    "myheritage": '# MyHeritage DNA raw data.\nRSID,CHROMOSOME,POSITION,RESULT\n"rs1","1","100","GA"\n"rs2","X","5","--"\n',
    "ftdna": 'RSID,CHROMOSOME,POSITION,RESULT\n"rs1","1","100","GA"\n"rs2","X","5","--"\n',
    "livingdna": "# Living DNA customer genotype data\n# rsid\tchromosome\tposition\tgenotype\nrs1\t1\t100\tAG\nrs2\tX\t5\t--\n",
}


@pytest.mark.parametrize("vendor", KITS)
def test_kits(spark, tmp_path, vendor):
    path = tmp_path / "kit.txt"
    path.write_text(KITS[vendor])
    assert dna.detect(KITS[vendor].splitlines()[:20]) == vendor
    rows = {r.rsid: (r.chrom, r.pos, r.genotype) for r in dna.read_raw(spark, str(path)).collect()}
    assert rows["rs1"] == (1, 100, "AG") and rows["rs2"] == (23, 5, "--") and "bad" not in rows


def test_shared_segments_end_to_end(spark, tmp_path):
    (tmp_path / "chr1.txt").write_text("pos rate cm\n0 1 0\n100000 1 10\n200000 1 30\n")
    points = dna.read_map(spark, str(tmp_path))
    assert points.count() == 3 and dna.map_breaks(points).count() == 0
    kit = lambda g: spark.createDataFrame([(f"rs{k}", 1, k * 1000, g(k), k) for k in range(200)], "rsid string, chrom int, pos int, genotype string, line long")
    both = matching.shared_variants(kit(lambda k: "--" if k == 50 else "AA"), kit(lambda k: "CC" if k == 120 else "AC"))
    runs = intervals.runs(both, ["chrom"], ["pos", "rsid"], matching.shares_allele(F.col("genotype_a"), F.col("genotype_b")), "pos")
    for end in ("start", "end"):
        runs = intervals.interpolate(runs, points, "chrom", end, "pos", "cm", f"cm_{end}", 50_000.0)
    got = sorted((r.start, r.end, r.n, round(r.cm_end - r.cm_start, 6)) for r in runs.collect())
    assert got == [(0, 119_000, 119, 13.8), (121_000, 199_000, 79, 15.6)]


def test_seeds(spark, tmp_path):
    def put(name, value):
        (tmp_path / name).write_text(json.dumps(value))
        return str(tmp_path / name)

    clusters = {"surname_variant_clusters": [{"canonical": "Cohen", "community_scope": "x", "rank_within_scope": 1, "variants_latin": ["Kohn"], "variants_hebrew": ["כהן"]}], "transliteration_tables": {"t": {"a": "b"}}}
    path = put("c.json", clusters)
    assert {(r.form, r.script) for r in seeds.surname_clusters(spark, path).collect()} == {("Kohn", "latin"), ("כהן", "hebrew")}
    assert [tuple(r) for r in seeds.transliteration(spark, path).collect()] == [("t", "a", "b")]
    place = put("p.json", [{"old_name": "A", "modern_name": "B", "modern_country": "PL", "lat_lon": [1.5, 2.5], "old_jurisdiction": [{"period": "1800", "name": "J"}]}])
    assert tuple(seeds.places(spark, place).first()) == ("A", "B", "PL", 1.5, 2.5, "1800", "J")
    with pytest.raises(ValueError, match="invalid"):
        seeds.archives(spark, put("a.json", [{"archive_id": "x", "name": "n", "time_range_start": 1900, "time_range_end": 1800}]))
    with pytest.raises(ValueError, match="repeated"):
        seeds.trees(spark, put("t.json", [{"tree_id": "1"}, {"tree_id": "1"}]))
    people = put("f.json", {"persons": [{"id": "me", "ascendancyNumber": "1"}, {"id": "dad", "ascendancyNumber": "2"}, {"id": "mum", "ascendancyNumber": "3"}, {"id": "x", "ascendancyNumber": "1-S"}]})
    assert {(r.id, r.father, r.mother) for r in seeds.pedigree(spark, people).collect()} == {("me", "dad", "mum"), ("dad", None, None), ("mum", None, None)}


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (1, "c")], "tree int, x string")
    sinks.append(df, f"{tmp_path}/t", "tree")
    sinks.append(df, f"{tmp_path}/t", "tree")
    assert spark.read.parquet(f"{tmp_path}/t").where("tree = 1").count() == 4
    manifest = sinks.export({"one": df, "two": df.limit(1)}, f"{tmp_path}/out")
    assert {tuple(r) for r in manifest.collect()} == {("one", 3), ("two", 1)} and spark.read.json(f"{tmp_path}/out/one").count() == 3
    lines = spark.createDataFrame([("f", 2, 0, "two"), ("f", 1, 0, "one"), ("g", 1, 0, "x")], "file string, no int, sub int, line string")
    sinks.write_text(lines, f"{tmp_path}/text")
    assert [r[0] for r in spark.read.text(f"{tmp_path}/text/file=f").collect()] == ["one", "two"]


def stream(spark, tmp_path, rows):
    df = spark.createDataFrame(rows, "id int, job string, stage string, ts timestamp")
    df.write.parquet(f"{tmp_path}/in")
    return df, spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in")


def test_streams(spark, tmp_path):
    from datetime import datetime, timedelta

    t = datetime(2024, 1, 1)
    rows = [(1, "a", "started", t), (2, "a", "started", t + timedelta(minutes=5)), (3, "a", "succeeded", t + timedelta(minutes=70)), (4, "a", "late", t + timedelta(minutes=71)), (5, "b", "started", t + timedelta(days=1))]
    batch, live = stream(spark, tmp_path, rows)
    run = lambda df, name, mode="append": (streams.to_table(df, f"{tmp_path}/{name}", f"{tmp_path}/ck-{name}", mode).awaitTermination(60), spark.read.parquet(f"{tmp_path}/{name}"))[1]
    kept = run(streams.first_within(live, ["job", "stage"], "ts", 60), "first")
    assert {r.stage for r in kept.collect()} == {"started", "succeeded", "late"} and kept.count() == 4
    assert {r.id for r in streams.first_within_batch(batch, ["job", "stage"], "ts", "id", 60).collect()} == {1, 3, 4, 5}
    assert {(r.job, r.n) for r in streams.daily(batch, ["job"], "ts").collect()} == {("a", 4), ("b", 1)}
    days = run(streams.daily(live, ["job"], "ts", "1 hour"), "daily")
    assert {(r.job, r.n) for r in days.collect()} <= {("a", 4), ("b", 1)}
    assert {r.id for r in streams.until_terminal(batch, "job", "ts", "id", "stage").collect()} == {1, 2, 3, 5}
    ended = run(streams.watch_jobs(live, "job", "ts", "stage"), "jobs")
    assert {(r.job, r.stages, r.ended) for r in ended.collect()} >= {("a", 3, True)}


def test_progress_is_published(spark, tmp_path):
    import time

    seen = []
    log = streams.ProgressLog(seen.append)
    spark.streams.addListener(log)
    try:
        df = spark.range(3)
        df.write.parquet(f"{tmp_path}/in")
        query = streams.to_table(spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in"), f"{tmp_path}/out", f"{tmp_path}/ck")
        query.awaitTermination(60)
        for _ in range(50):
            if any(s == "succeeded" for _, s, _ in seen):
                break
            time.sleep(0.2)
    finally:
        spark.streams.removeListener(log)
    assert {s for _, s, _ in seen} >= {"started", "running", "succeeded"} and sum(n for _, _, n in seen) == 3
