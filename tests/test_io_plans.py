import zipfile

from pyspark.sql import functions as F

from braidwork.plans import pipeline
from braidwork.sources import readers, writers
from braidwork.streaming import documents as stream

W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'


def docx(path, paragraphs):
    body = "".join(f"<w:p><w:r><w:t>{p}</w:t></w:r></w:p>" for p in paragraphs)
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("word/document.xml", f"<w:document {W}><w:body>{body}<w:tbl><w:tr><w:tc><w:p><w:r><w:t>table</w:t></w:r></w:p></w:tc></w:tr></w:tbl></w:body></w:document>")


def test_docx(spark, tmp_path):
    docx(tmp_path / "2.docx", ["Two", " ", "lines"])
    docx(tmp_path / "10.docx", ["Ten"])
    (tmp_path / "3.docx").write_bytes(b"broken")
    rows = readers.read_resumes(spark, str(tmp_path)).orderBy("cv_id").collect()
    assert [(r.cv_id, r.raw_text) for r in rows] == [(2, "Two\nlines"), (10, "Ten")]
    assert readers.read_resumes(spark, str(tmp_path), limit=1).first().cv_id == 2


def test_vacancies_csv(spark, tmp_path):
    (tmp_path / "v.csv").write_text('id,job_description,job_title,uid\n8,"Two\nlines, ""quoted""",Dev,u1\n37,Plain,Ops,u2\n')
    rows = readers.read_vacancies(spark, str(tmp_path / "v.csv")).orderBy("vacancy_id").collect()
    assert [(r.vacancy_id, r.id, r.job_description) for r in rows] == [(1, 8, 'Two\nlines, "quoted"'), (2, 37, "Plain")]
    assert readers.by_id(readers.read_vacancies(spark, str(tmp_path / "v.csv")), "vacancy_id", 9).count() == 0


def test_row_numbers_over_partitions(spark):
    rows = readers.with_row_numbers(spark.range(0, 100, 1, 7), "n").orderBy("id").collect()
    assert [r.n for r in rows] == list(range(1, 101))


def test_rankings_round_trip(spark, tmp_path):
    ranks = spark.createDataFrame([(1, i, r) for i, r in enumerate((3, 1, 2, 5, 4), 1)] + [(2, 1, 1)], "cv_id int, vacancy_id int, rank int")
    writers.save_rankings(ranks, str(tmp_path), "bm25", "20240101_000000")
    rows = {r.cv_id: r for r in readers.read_rankings(spark, f"{tmp_path}/rankings_*.csv").collect()}
    assert rows[1].rankings == [3, 1, 2, 5, 4] and rows[2].rankings == [1, 0, 0, 0, 0] and rows[1].method == "bm25"


def test_texts_json_tables(spark, tmp_path):
    df = spark.createDataFrame([(1, "täxt"), (2, "b")], "cv_id int, text string")
    writers.save_processed(df, f"{tmp_path}/p", "cv_id", "text")
    assert readers.read_json(spark, f"{tmp_path}/p/full", "cv_id int, text string").where("cv_id = 1").first().text == "täxt"
    writers.save_text(df, f"{tmp_path}/t", "text")
    assert sum(r.text.count("\n") for r in readers.read_text(spark, f"{tmp_path}/t").collect()) == 2
    writers.save_table(df, f"{tmp_path}/q")
    assert spark.read.parquet(f"{tmp_path}/q").count() == 2 and readers.list_files(spark, f"{tmp_path}/q").count() >= 1
    s = writers.run_summary(df, df.withColumnRenamed("cv_id", "vacancy_id"), "now").first()
    assert (s.num_cvs, s.num_vacancies, s.stamp) == (2, 2, "now")


def test_whole_run(spark):
    cv = "the best of python and sql in the team\nExperience\n2010 - 2015 work with python, docker and sql in the office for the firm\nSkills\npython, sql"
    cvs = spark.createDataFrame([(i, cv + f" {x}") for i, x in enumerate(("java", "react", "aws"), 1)], "cv_id long, raw_text string")
    vac = spark.createDataFrame([(i, "Dev", f"must have python and {x}. 3 years of experience") for i, x in enumerate(("sql", "java", "docker", "aws", "react"), 1)], "vacancy_id long, job_title string, job_description string")
    catalog = spark.createDataFrame([(1, "skill", "python", ["py"])], "catalog_id int, entry_kind string, canonical string, other_names array<string>")
    run = pipeline.run(cvs, vac, catalog)
    assert run.pairs.count() == 15 and run.ranks.count() == 15 * len(pipeline.METHODS)
    for s in ("keyword_score", "tfidf_score", "semantic_score", "total_score"):
        assert run.pairs.where(~F.col(s).between(0, 100)).count() == 0
    truth = run.ranks.where("method = 'unified'").select("cv_id", "vacancy_id", F.col("place").alias("rank"))
    m = run.metrics(truth)
    assert m.where("method = 'unified'").first().alpha == 1.0
    assert "Best method" in writers.report(m, 3, 5)


def test_pairs_without_a_common_skill_are_ranked_by_every_method(spark):
    cook = "the chef of the house is in the kitchen and has the menu for the team. Soups and sauces of the season in the office"
    cvs = spark.createDataFrame([(1, cook), (2, "the best of python and sql in the team and the office of the firm"), (None, cook), (3, "the one with java is in the team and the house of the firm")], "cv_id long, raw_text string")
    vac = spark.createDataFrame([(1, "Dev", "must have python and sql"), (2, "Cook", "a chef for soups and sauces, the menu of the season"), (3, "None", None), (4, "Empty", "")], "vacancy_id long, job_title string, job_description string")
    catalog = spark.createDataFrame([(1, "skill", "python", ["py"])], "catalog_id int, entry_kind string, canonical string, other_names array<string>")
    run = pipeline.run(cvs, vac, catalog)
    every = {(c, v) for c in (1, 2, 3) for v in (1, 2, 3, 4)}
    assert sorted((r.cv_id, r.vacancy_id) for r in run.pairs.collect()) == sorted(every)
    ranks = run.ranks.collect()
    for method in pipeline.METHODS:
        assert sorted((r.cv_id, r.vacancy_id) for r in ranks if r.method == method) == sorted(every)
        assert sorted(r.place for r in ranks if r.method == method and r.cv_id == 1) == [1, 2, 3, 4]
    assert {r.vacancy_id for r in ranks if r.cv_id == 1 and r.place == 1 and r.method in ("tfidf", "bm25", "semantic")} == {2}
    assert all(r.score is not None for r in ranks)


def test_all_pairs_in_blocks(spark):
    c, v = spark.range(23).withColumnRenamed("id", "cv_id"), spark.range(17).withColumnRenamed("id", "vacancy_id")
    pairs = pipeline.candidate_pairs(c.union(c), v, per_block=5)
    assert pairs.count() == 23 * 17 == pairs.distinct().count()
    assert pipeline.candidate_pairs(c.where("cv_id < 0"), v).count() == 0


def test_streams(spark, tmp_path):
    spark.createDataFrame([(1, "Python and SQL in the house of the team and the office is here.", "2024-01-01 10:00:00"), (1, "again", "2024-01-01 10:00:00")], "id int, t string, ts string").withColumn("ts", F.to_timestamp("ts")).write.parquet(f"{tmp_path}/in")
    source = spark.readStream.schema("id int, t string, ts timestamp").parquet(f"{tmp_path}/in")
    q = stream.write_table(stream.enrich(source, "id", "t"), f"{tmp_path}/out", f"{tmp_path}/c1")
    q.awaitTermination(60)
    assert spark.read.parquet(f"{tmp_path}/out").where("array_contains(skills, 'python')").count() == 1
    q = stream.write_table(stream.latest_only(source, ["id"], "ts"), f"{tmp_path}/once", f"{tmp_path}/c2")
    q.awaitTermination(60)
    assert spark.read.parquet(f"{tmp_path}/once").count() == 1
    w = stream.counts_by_window(source, "ts", "id").writeStream.format("memory").queryName("win").outputMode("complete").option("checkpointLocation", f"{tmp_path}/c3").trigger(availableNow=True).start()
    w.awaitTermination(60)
    assert spark.table("win").first().n == 2


def test_written_tables_are_read_back_and_cleaned(spark):
    from braidwork import session

    df = session.materialize(spark.range(5).withColumn("x", F.lit("y")))
    assert df.count() == 5 and df.columns == ["id", "x"]
    folder = session._run_folder(spark).removeprefix("file://")
    assert session.shared_dir(spark) == session.shared_dir(spark)
    keep = spark.sparkContext.applicationId
    assert folder.endswith(keep)
