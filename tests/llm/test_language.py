import random

import pytest
from pyspark.sql import functions as F

from braidwork.llm import language as L

SAMPLES = {
    "en": "the team and our {} write code with them every week because it is what we like to do for the customers of this house",
    "de": "wir haben die {} mit den Kollegen und für das Haus gebaut weil es nicht anders ging und der Kunde sie jede Woche wollte",
    "fr": "nous avons construit la {} avec les collègues pour la maison parce que le client la voulait chaque semaine dans ses bureaux",
    "es": "hemos construido la {} con los compañeros para la casa porque el cliente la quería cada semana en sus oficinas y también en otras",
    "pt": "construímos a {} com os colegas para a casa porque o cliente a queria todas as semanas nos seus escritórios e não noutros",
    "ru": "мы построили {} вместе с коллегами для дома потому что заказчик хотел её каждую неделю в своих отделах и больше нигде",
}


def text(lang, rng, n=2):
    out = []
    for _ in range(n):
        w = SAMPLES[lang].format(rng.choice(["Python", "Kafka", "Redis", "Spark"])).split()
        i = rng.randrange(len(w) - 10)
        out.append(" ".join(w[i : i + 12]).capitalize() + ".")
    return " ".join(out)


@pytest.fixture(scope="module")
def model():
    rng = random.Random(1)
    rows = [(text(l, rng, 3), rng.choice(list(SAMPLES)) if rng.random() < 0.15 else l) for l in SAMPLES for _ in range(60)]
    return L.fit(rows)


def test_held_out_accuracy_with_wrong_training_labels(model):
    rng = random.Random(2)
    cases = [(l, model.classify(L.sentence_words(text(l, rng)))) for l in SAMPLES for _ in range(40)]
    assert sum(l == got for l, (got, _, _) in cases) >= 0.98 * len(cases)
    assert all(0 <= c <= 1 for _, (_, c, _) in cases)


def test_codewords_are_apart():
    code = L.codewords(6, 15)
    assert code.shape == (6, 15) and min((code[i] != code[j]).sum() for i in range(6) for j in range(i)) >= 6


def test_segments(model):
    rng = random.Random(3)
    en, de = text("en", rng), text("de", rng)
    doc = f"John Smith | 555-0100\n\n{en}\n\nSkills\nJava, SQL, Kafka\n\n{de}\n\n2010 - 2011 Developer, Firm, Town\n{de}\n\n{en}"
    assert [(s[0], s[3]) for s in L.segments(doc, model)] == [("en", 3), ("de", 2), ("en", 1)]
    assert L.segments(doc.replace("\n", "\r\n"), model)[0][0] == "en"
    for empty in (None, "", "\n\n \n", "Java, SQL", "12.", "Skills"):
        assert L.segments(empty, model) == []
    assert len(L.segments("\n\n".join([en] * 3000), model)) == 1


def test_labels(spark):
    values = ["en", "EN", "en-GB", "en_US", "English", "eng", "deu", "German", "xx", "n/a", "unknown", "", None, "english-speaking", "fra", "Portuguese", "und"]
    df = spark.createDataFrame([(v,) for v in values], "l string")
    assert [r.x for r in df.select(L.label_column(F.col("l")).alias("x")).collect()] == ["en"] * 6 + ["de"] * 2 + [None] * 6 + ["fr", "pt", None]


def test_table(spark, model):
    rng = random.Random(4)
    en = text("en", rng)
    rows = [(1, en, "en", "a"), (1, en, "en", "a"), (2, en, None, "b"), (3, en + "\n\n" + text("ru", rng), "en", "c"), (4, None, "en", "d"), (5, "", None, "e"), (None, en, "de", "f")]
    df = spark.createDataFrame(rows, "k long, t string, l string, lang string")
    found = L.label_segments(df, "k", "t", "l", model, "x")
    assert found.where("record_id = 1").count() == 1
    assert sorted(tuple(r) for r in L.wrong_labels(found).collect()) == [("x", 2, 1, "en"), ("x", 3, 1, "en"), ("x", 3, 2, "ru")]
    assert L.label_segments(df.limit(0), "k", "t", "l", model, "x").count() == 0


def test_two_languages_are_needed():
    with pytest.raises(ValueError):
        L.fit([("text", "en")])
