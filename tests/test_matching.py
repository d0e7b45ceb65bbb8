import math

from pyspark.sql import functions as F

from braidwork.operators import matching as K
from braidwork.operators import semantic as S
from braidwork.operators import terms as G


def score(spark, resume, vacancy_text, synonyms, fuzzy=False):
    c = K.cv_features(spark.createDataFrame([(1, resume)], "cv_id long, skills array<string>"), synonyms)
    v = K.vacancy_features(spark.createDataFrame([(1, vacancy_text)], "vacancy_id long, job_description string"), synonyms)
    f = K.fuzzy_table(c.select(F.explode("norm").alias("a")), v.select(F.explode("each").alias("b"))).select("a", "b") if fuzzy else None
    return K.keyword_match(spark.createDataFrame([(1, 1)], "cv_id long, vacancy_id long"), c, v, f).first()


def test_exact_match(spark):
    r = score(spark, ["python", "Java", "sql"], "python, c++, sql", {})
    assert set(r.exact) == {"python", "sql"} and set(r.missing) == {"c++"}


def test_synonym_match(spark):
    r = score(spark, ["reactjs", "cpp"], "react, c++", {"reactjs": "react", "react": "react", "cpp": "c++", "c++": "c++"})
    assert {"react", "c++"} <= set(r.matched) and r.missing == []


def test_no_skills_and_nulls(spark):
    assert score(spark, ["python"], "nothing here", {}).keyword_score == 0.0
    r = score(spark, None, "python", {})
    assert r.matched == [] and r.keyword_score == 0.0
    assert score(spark, [None, "", "  ", "the of"], "python", {}).exact == []


def test_remote_and_bounds(spark):
    r = score(spark, ["python"], "python remote", {})
    assert 0 <= r.keyword_score <= 100


def test_weights(spark):
    df = spark.createDataFrame([("must have python\nplus java\npython python python",)], "t string")
    r = df.select(K.weight(F.col("t"), F.lit("python")).alias("p"), K.weight(F.col("t"), F.lit("java")).alias("j")).first()
    assert (r.p, r.j) == (2.0, 1.1)


def test_fuzzy_ratio(spark):
    a, b = spark.createDataFrame([("reactjs",), ("sql",)], "a string"), spark.createDataFrame([("react.js",), ("mysql",)], "b string")
    rows = K.fuzzy_table(a, b).collect()
    assert [(r.a, r.b, round(r.ratio, 4)) for r in rows] == [("reactjs", "react.js", 0.9333)]


def test_experience_rule(spark):
    df = spark.createDataFrame([(50.0, 11.0, 5), (50.0, 5.0, 5), (50.0, 1.0, 5), (50.0, None, 5)], "s double, e double, r int")
    assert [r.x for r in df.select(K.with_experience(F.col("s"), F.col("e"), F.col("r")).alias("x")).collect()] == [45.0, 55.0, 50.0, 50.0]


def test_explanation(spark):
    c = K.cv_features(spark.createDataFrame([(1, ["python"])], "cv_id long, skills array<string>"), {})
    v = K.vacancy_features(spark.createDataFrame([(1, "python, java")], "vacancy_id long, job_description string"), {})
    text = K.explanation(K.keyword_match(spark.createDataFrame([(1, 1)], "cv_id long, vacancy_id long"), c, v)).first().explanation
    assert "exact: python" in text and "java" in text


def test_ngrams(spark):
    df = spark.createDataFrame([("Ab c",)], "t string")
    assert df.select(G.char_ngrams(F.col("t")).alias("g")).first().g == ["a", "b", " ", "c", "ab", "b ", " c", "ab ", "b c"]
    assert df.select(G.word_ngrams(F.lit("deep machine learning")).alias("g")).first().g == ["deep", "machine", "learning", "deep machine", "machine learning"]
    assert df.select(G.char_ngrams(F.lit("")).alias("g")).first().g == []


def test_tfidf_cosine(spark):
    docs = spark.createDataFrame([("a", "python sql"), ("b", "python sql"), ("c", "java")], "id string, t string")
    w = G.tfidf(G.term_counts(docs, ["id"], G.word_ngrams(F.col("t"))), ["id"], 3)
    pairs = spark.createDataFrame([("a", "b"), ("a", "c")], "x string, y string")
    got = {(r.x, r.y): r.dot for r in G.pair_dot(pairs, w.withColumnRenamed("id", "x"), w.withColumnRenamed("id", "y"), "x", "y").collect()}
    assert math.isclose(got["a", "b"], 1.0) and got["a", "c"] == 0.0


def test_bm25_prefers_the_matching_document(spark):
    q = spark.createDataFrame([(1, ["rust", "rust"])], "cv_id int, tokens array<string>")
    d = spark.createDataFrame([(1, ["rust", "x"]), (2, ["go", "y"]), (3, ["z"])], "vacancy_id int, tokens array<string>")
    p = spark.createDataFrame([(1, 1), (1, 2)], "cv_id int, vacancy_id int")
    got = {r.vacancy_id: r.bm25 for r in S.bm25(p, q, d).collect()}
    idf = math.log(3 - 1 + 0.5) - math.log(1.5)
    assert math.isclose(got[1], 2 * idf * 2.5 / (1 + 1.5 * (0.25 + 0.75 * 2 / (5 / 3)))) and got[2] == 0


def test_distances_and_encoder(spark):
    df = spark.createDataFrame([([1.0, 0.0], [0.0, 1.0], [0.0, 0.0])], "a array<double>, b array<double>, z array<double>")
    r = df.select(*[S.distance(F.col("a"), F.col("b"), m).alias(m) for m in ("l1", "l2", "cosine", "other")], S.distance(F.col("a"), F.col("z"), "cosine").alias("zero")).first()
    assert (r.l1, round(r.l2, 6), r.cosine, r.other, r.zero) == (2.0, 1.414214, 1.0, 2.0, 1.0)
    rows = spark.createDataFrame([("python developer",), ("python developer",), (None,)], "t string").select(S.encode(F.col("t")).alias("v")).collect()
    assert rows[0].v == rows[1].v and abs(sum(x * x for x in rows[0].v) - 1) < 1e-5 and sum(map(abs, rows[2].v)) == 0


def test_reference_lists_beyond_ten_thousand_names(spark):
    rows = [(i, f"entry {i:05d} end", [f"other {i:05d} end"]) for i in range(12_000)] + [(20_000, None, None)]
    names = K.reference_names(spark.createDataFrame(rows, "catalog_id int, canonical string, other_names array<string>").where("canonical IS NOT NULL"))
    d = spark.createDataFrame([("knows Entry 11999 end and other 11990 END",), ("nothing",), (None,), ("",)], "part string")
    assert [r.c for r in d.select(K.first_named(d.part, names).alias("c")).collect()] == ["entry 11990 end", None, None, None]
    assert [r.c for r in d.select(K.first_named(d.part, []).alias("c")).collect()] == [None] * 4


def test_experience_counts_in_one_direction(spark):
    m = spark.createDataFrame([(1, 1, 50.0), (2, 1, 50.0), (3, 1, 98.0), (4, 1, 2.0), (5, 2, 50.0)], "cv_id long, vacancy_id long, keyword_score double")
    e = spark.createDataFrame([(1, 1.0), (2, 4.0), (3, 4.0), (4, 40.0)], "cv_id long, experience double")
    r = spark.createDataFrame([(1, 4)], "vacancy_id long, required int")
    got = {x.cv_id: (x.forward, x.reverse) for x in K.both_directions(m, e, r).collect()}
    assert got == {1: (50.0, 50.0), 2: (50.0, 55.0), 3: (98.0, 100.0), 4: (2.0, 0.0), 5: (50.0, 50.0)}
