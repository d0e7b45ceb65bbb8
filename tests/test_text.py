from pyspark.sql import functions as F

from braidwork.functions import checks as C
from braidwork.functions import text as T


def one(spark, text, column):
    return spark.createDataFrame([(text,)], "t string").select(column(F.col("t")).alias("r")).first()["r"]


def test_clean_keeps_years_and_structure(spark):
    assert one(spark, "Hello, World! 123 2023-now", T.clean) == "hello world 2023-now"
    assert one(spark, "Hello, World! 123 2023-now 120", T.clean) == "hello world 2023-now 120"
    assert one(spark, "A  b\n\nC (d) 12", T.clean) == "a b\n\nc d"
    assert one(spark, "1999 x 2019 19 20 33", T.clean) == "1999 x 2019 19 20"
    assert one(spark, "год2020 7", T.clean) == "год2020"
    assert one(spark, None, T.clean) is None
    assert one(spark, "", T.clean) == ""


def test_periods(spark):
    got = one(spark, "Worked at Company (2017-2020) and then at Startup (2020-now)", T.periods)
    assert [tuple(r) for r in got] == [(2017, 2020), (2020, 2026)]
    assert [tuple(r) for r in one(spark, "2001 to 2003, 2005 - present", T.periods)] == [(2005, 2026), (2001, 2003)]


def test_merged_years(spark):
    def years(rows, tolerance=0):
        df = spark.createDataFrame([(rows,)], "p array<struct<start:int,end:int>>")
        return df.select(T.merged_years(F.array_distinct("p"), tolerance).alias("y")).first()["y"]

    assert years([(2010, 2014), (2012, 2015), (2016, 2018), (2018, 2020)]) == 9
    assert years([(2020, 2010), (2021, 2022)]) == -9
    assert years([(2010, 2011), (2012, 2013)], 1) == 3
    assert years([]) == 0


def test_experience_section_and_choice(spark):
    text = "Summary\nWork Experience\nACME 2010 - 2014\n\nOther 2012 - 2015\nEducation\nMIT 2001 - 2005"
    assert one(spark, text, T.experience_section) == "ACME 2010 - 2014\nOther 2012 - 2015"
    assert one(spark, text, T.experience) == 5.0
    assert one(spark, "7 years of experience with Java", T.experience) == 7.0
    assert one(spark, "2019 - 2020, nothing else", T.experience) == 0.0
    assert one(spark, "5 - 7 years of work", T.explicit_years) == 7.0


def test_required_years(spark):
    assert one(spark, "At least 5+ years of experience", T.required_years) == 5
    assert one(spark, "some experience", T.required_years) is None


def test_sections_and_summaries(spark):
    assert one(spark, "Skills: Java, SQL\n\nmore", lambda c: T.first_section(c, T.X.SECTION_SKILLS)) == "Java, SQL"
    assert one(spark, "nothing", lambda c: T.first_section(c, T.X.SECTION_SKILLS)) == ""
    long = " ".join(f"This is sentence number {i} of the text." for i in range(15))
    assert one(spark, long, T.summary).count("sentence") == 10
    assert one(spark, "short", T.raw_summary) == "short"
    assert len(one(spark, "x" * 5000, T.prepare)) == 2001


def test_skills(spark):
    assert one(spark, "Python, C++ and java; going", T.tech_skills) == ["python", "java", "c++"]
    assert "go" not in one(spark, "google", T.tech_skills)
    assert one(spark, "Spring Boot and MySQL", lambda c: T.category_skills(c, "framework")) == ["spring", "spring boot", "springboot"]
    assert one(spark, "aws", lambda c: T.category_skills(c, "cloud")) == []


def test_language(spark):
    assert one(spark, "The quick fox is in the house and the dog is on the roof of it.", T.guess_language) == "en"
    assert one(spark, "Мы ждём от девяти лет опыта с языком в области банковского дела и торговли.", T.guess_language) == "ru"
    assert one(spark, "Der Hund ist auf dem Dach und die Katze ist mit dem Ball in dem Haus.", T.guess_language) == "unknown"
    assert one(spark, "short", T.guess_language) == "unknown"


def test_grammar_and_quality(spark):
    g = one(spark, "All good here.", C.grammar)
    assert (g["errors"], g["warnings"], g["suggestions"], g["score"]) == (0, 0, 0, 100)
    g = one(spark, "the the cat  sat. JavaScript is not java script.", C.grammar)
    assert (g["errors"], g["warnings"], g["suggestions"], g["score"]) == (1, 2, 1, 90)
    q = one(spark, "x", C.quality)
    assert q["score"] == 100 - 30 - 9 and q["missing_sections"] == 3


def test_issue_lists(spark):
    kinds = [i["type"] for i in one(spark, "no contact 2001 - 2015 and 2010 - 2005", C.all_checks)]
    assert kinds == ["missing_email", "missing_linkedin", "missing_location", "long_period", "date_order", "missing_education", "modern_tech"]
    assert [i["type"] for i in one(spark, "in 2050", lambda c: C.dates(c, as_of=2026))] == ["future_date"]


def test_languagetool_formula(spark):
    row = spark.range(1).select(C.languagetool_score(F.lit(2), F.lit(4), F.lit(5), F.lit(100)).alias("a"), C.languagetool_score(F.lit(2), F.lit(0), F.lit(0), F.lit(0)).alias("b")).first()
    assert (row["a"], row["b"]) == (95.0, 100.0)


def test_month_name(spark):
    assert [r["m"] for r in spark.createDataFrame([(0,), (3,), (99,)], "n int").select(T.month_name(F.col("n")).alias("m")).collect()] == ["Jan", "Mar", "Dec"]
