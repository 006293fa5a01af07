import pytest
from pyspark.sql import functions as F

from tallyweave.__main__ import main
from tallyweave.plans import explore, linkage, report
from tallyweave.sources import delimited, texts
from tallyweave.streaming import incremental


def test_reads_sniff_and_drop_malformed_rows(spark, tmp_path):
    path = tmp_path / "a.txt"
    path.write_text("id;word\n1;x\n2;y;z\n3;NA\n")
    df = delimited.read_any(spark, str(path))
    assert dict(df.dtypes) == {"id": "int", "word": "string"}
    assert sorted((r.id, r.word) for r in df.collect()) == [(1, "x"), (3, "NA")]


def test_matches_have_a_line_for_each_record(spark, tmp_path):
    s1 = spark.createDataFrame([("S1-1",), ("S1-2",)], "entity_id string")
    found = spark.createDataFrame([("S1-1", "S2-9", 2), ("S1-1", "S2-5", 1)], "s1_id string, cand_id string, rank int")
    delimited.write_matches(s1, found.where("rank = 1"), found, str(tmp_path / "out"))
    delimited.write_matches(s1.repartition(3), found.where("rank = 1"), found, str(tmp_path / "out"))  # again, over the first
    read = lambda n: (tmp_path / "out" / f"{n}.tsv").read_bytes().decode().split("\n")
    head, *lines = read("candidate_pairs")
    assert head == "source1_entity_id\tcandidate_entity_ids" and sorted(lines) == ["", "S1-1\tS2-5,S2-9", "S1-2\t"]
    head, *lines = read("matching_results")
    assert head == "source1_entity_id\tmatched_entity_ids" and sorted(lines) == ["", "S1-1\tS2-5", "S1-2\t"]
    assert sorted(f.name for f in (tmp_path / "out").iterdir() if not f.name.startswith(".")) == ["candidate_pairs.tsv", "matching_results.tsv"]


def test_stages_are_found_again_by_configuration(spark, tmp_path):
    made = []
    make = lambda: made.append(1) or spark.range(3)
    for config in ({"a": 1}, {"a": 1}, {"a": 2}):
        assert delimited.StageStore(spark, str(tmp_path), config).stage("x", make).count() == 3
    assert len(made) == 2
    store = delimited.StageStore(spark, str(tmp_path), {})
    store.save_value("v", {"t": 0.5})
    assert store.load_value("v") == {"t": 0.5}


def test_stages_are_made_anew_for_other_inputs(spark, tmp_path):
    rows = spark.createDataFrame([("a", 1), ("b", None)], "k string, v int")
    same = rows.orderBy("v").repartition(3)
    assert delimited.fingerprint(rows) == delimited.fingerprint(same)
    others = [rows.limit(1), rows.union(rows), rows.withColumnRenamed("v", "w"), rows.withColumn("v", F.coalesce("v", F.lit(0)))]
    assert len({delimited.fingerprint(df) for df in [rows, *others]}) == 5
    made = []
    for df in (rows, same, others[0]):
        delimited.StageStore(spark, str(tmp_path), {}, (df,)).stage("x", lambda df=df: made.append(1) or df).count()
    assert len(made) == 2


def test_exploration_report(spark, tmp_path, capsys):
    s1, pool, gt = raw_records(spark)
    for name, df in (("s1", s1), ("pool", pool), ("gt", gt)):
        delimited.write_tsv(df, f"{tmp_path}/{name}.tsv")
    args = ["--first", f"{tmp_path}/s1.tsv", "--pool", f"{tmp_path}/pool.tsv", "--truth", f"{tmp_path}/gt.tsv", "-o", f"{tmp_path}/e.html"]
    assert explore.main(args) == 0
    html = (tmp_path / "e.html").read_text()
    assert "Pairs by source" in html and "Abbreviations" in html and "<td>60</td>" in html
    assert explore.main(["--first", f"{tmp_path}/none.tsv"]) == 1 and main(["-f", f"{tmp_path}/none.tsv"]) == 1
    assert "There is no file" in capsys.readouterr().out


def test_sample_table(spark):
    df = delimited.sample_table(spark, 500)
    r = df.agg(F.min("quantity"), F.max("quantity"), F.count("rating"), F.max("price")).first()
    assert 1 <= r[0] and r[1] <= 9 and 400 < r[2] < 500 and r[3] <= 500


def test_command_line_report(spark, tmp_path):
    path = tmp_path / "a.csv"
    path.write_text("id,word\n1,<b>\n2,y\n")
    assert main(["-f", str(path), "-o", str(tmp_path / "r.html")]) == 0
    html = (tmp_path / "r.html").read_text()
    assert "&lt;b&gt;" in html and "<td><b></td>" not in html


def test_report_sizes():
    assert report.human_bytes(2048) == "2.00 KB" and report.human_number(1234567) == "1,234,567"


def raw_records(spark, n=60):
    names = ["Delta Power Inc", "Omega Foods Ltd", "Sigma Tools Corp", "Kappa Books Co", "Lambda Labs LLC", "Theta Paints"]
    name = F.concat(F.get(F.array(*map(F.lit, names)), (F.col("id") % 6).cast("int")), F.lit(" "), F.col("id").cast("string"))
    base = spark.range(n).select("id", name.alias("business_name"), F.concat(F.col("id") + 100, F.lit(" Main St, Town "), F.col("id") + 20000).alias("business_address"), F.lit("US").alias("country"))
    s1 = base.select(F.concat(F.lit("S1-"), "id").alias("entity_id"), "business_name", "business_address", "country")
    pool = base.select(F.concat(F.when(F.col("id") % 2 == 0, "S2-").otherwise("S3-"), "id").alias("entity_id"), F.upper("business_name").alias("business_name"), "business_address", "country")
    gt = base.select(F.concat(F.lit("S1-"), "id").alias("source1_entity_id"), F.concat(F.when(F.col("id") % 2 == 0, "S2-").otherwise("S3-"), "id").alias("matched_entity_ids"))
    return s1, pool, gt


def test_linkage_from_training_to_output(spark, tmp_path):
    s1, pool, gt = raw_records(spark)
    settings = linkage.Settings(max_df=0.5, trees=3, negative_rate=1.0, grid=(0.3, 0.5, 0.7))
    out = linkage.run_training(spark, s1, pool, gt, str(tmp_path / "store"), settings)
    assert out["recall"] == 1.0 and out["f05"] > 0.9
    matches = linkage.run_inference(spark, s1, pool, str(tmp_path / "store"), str(tmp_path / "out"), settings)
    right = matches.where(F.substring("s1_id", 4, 9) == F.substring("cand_id", 4, 9)).count()
    assert right >= 55
    assert linkage.run_inference(spark, s1, pool, str(tmp_path / "store"), str(tmp_path / "quick"), settings, quick=True).count() >= 50
    fewer = pool.where("entity_id < 'S2-3'")  # other records give other matches, not those that were kept
    again = linkage.run_inference(spark, s1, fewer, str(tmp_path / "store"), str(tmp_path / "out"), settings)
    wanted = {r.entity_id for r in fewer.collect()}
    assert 0 < again.count() < matches.count() and {r.cand_id for r in again.collect()} <= wanted
    [log, *_] = sorted((tmp_path / "store" / "logs").iterdir())
    assert "memory after" in log.read_text()


def test_arriving_records_are_blocked_once(spark, tmp_path):
    s1, pool, _ = raw_records(spark, 12)
    folder = tmp_path / "in"
    s1.limit(6).write.option("sep", "\t").option("header", True).csv(str(folder))
    from tallyweave.functions import text

    still = text.normalize_records(pool).cache()
    for _ in range(2):
        query = incremental.block_arriving(incremental.record_stream(spark, str(folder)), still, str(tmp_path / "out"), str(tmp_path / "state"))
        query.awaitTermination()
    found = spark.read.parquet(str(tmp_path / "out"))
    assert found.select("s1_id").distinct().count() == 6
    assert found.where(F.substring("s1_id", 4, 9) == F.substring("cand_id", 4, 9)).count() == 6


@pytest.mark.parametrize("name", ["flagship"])
def test_entry(spark, name):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 5
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_texts_are_found_where_they_were_put(spark, monkeypatch):
    monkeypatch.setattr(texts, "AT_ONCE", 3)
    rows = [(str(k), None if k % 4 == 1 else "é😀" * k, "x" * (k % 3)) for k in range(20)]
    placed = texts.put(spark.createDataFrame(rows, "id string, a string, b string").repartition(3), "id")
    got = texts.get(placed.unionByName(placed).withColumn("n", F.lit(7)), ["a", "b"])
    assert got.columns == ["id", "n", "a", "b"] and sorted(map(tuple, got.drop("n").collect()), key=str) == sorted(rows * 2, key=str)
