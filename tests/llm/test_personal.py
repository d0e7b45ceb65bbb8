import pytest

from braidwork.llm import personal as P

FIRST = ["Alice", "Peter", "Irene", "Oliver", "Heike", "Simon", "Clara", "Walter"]
LAST = ["Dorarik", "Quinov", "Selbach", "Tamquist", "Kelimont", "Rosund", "Fenlazer", "Zanick", "Marholt", "Belstad"]


def corpus(n=120):
    out = []
    for i in range(n):
        f, l = FIRST[i % 8], LAST[(i * 3 + i // 8) % 10]
        g, m = FIRST[(i + 3) % 8], LAST[(i * 7 + 1) % 10]
        phone = [f"+44 20 7946 0{100 + i}", f"020 7946 0{100 + i}"][i % 2]
        out.append(
            f"{f} {l}\nEmail - {f.lower()}.{l.lower()}{i}@firm.example\nPhone: {phone}\nAddress: {i + 1} Quiet Road, Town\nSSN 000-45-{1000 + i}\n\n"
            f"Led {i} testers at Some Firm Ltd while we built it. My manager at Other Group was {g} {m} and still answers mail at {g[0].lower()}.{m.lower()}@other.test. "
            f"For a reference please ask {FIRST[(i + 5) % 8]} {LAST[(i + 4) % 10]}, who can be reached on {phone}. Req. 2013-{1000 + i}-46, version 3.45.{i}-rc1."
        )
    return out


@pytest.fixture(scope="module")
def patterns(spark):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(corpus())], "cv_id long, text string")
    return P.learn(P.candidate_table(P._docs(docs, "cv_id", "text")))


def found(patterns, *texts):
    spark = patterns.sparkSession
    docs = spark.createDataFrame(list(enumerate(texts)), "cv_id long, text string")
    return {(r.pii_type, r.pii_text) for r in P.find(docs, "cv_id", "text", patterns).collect()}


def test_training_texts(patterns):
    got = found(patterns, corpus()[7])
    assert ("street_address", "8 Quiet Road") in got and ("id_number", "000-45-1007") in got
    assert sum(y == "email" for y, _ in got) == 2 and sum(y == "person_name" for y, _ in got) == 3 and sum(y == "phone" for y, _ in got) == 1
    assert not any("2013" in v or "Ltd" in v for _, v in got)


def test_patterns_find_unseen_identifiers(patterns):
    t = "Zoltan Brandneu\nPhone: 020 7946 0999\n\nMy manager at New Group was Xenia Unheard and still answers mail at xu [at] new [dot] test. For a reference please ask Yorick Unseen, who can be reached on 020 7946 0888. My office is at"
    got = found(patterns, t)
    assert {("person_name", "Xenia Unheard"), ("person_name", "Yorick Unseen"), ("phone", "020 7946 0999"), ("phone", "020 7946 0888")} <= got
    assert {("person_name", "xenia unheard"), ("person_name", "yorick unseen")} <= found(patterns, t.lower())


def test_obfuscated_mail_and_unknown_street_are_found_by_their_contexts(spark):
    texts = [t.replace("@other.test", " [at] other [dot] test") if i % 3 == 0 else t for i, t in enumerate(corpus())]
    texts = [t.replace(f"{i + 1} Quiet Road", f"{i + 1} Quiet Nook") if i % 3 == 1 else t for i, t in enumerate(texts)]
    docs = spark.createDataFrame(list(enumerate(texts)), "cv_id long, text string")
    rows = {(r.cv_id, r.pii_type, r.pii_text) for r in P.find(docs, "cv_id", "text").collect()}
    assert sum(y == "street_address" for _, y, _ in rows) == 120 and (4, "street_address", "5 Quiet Nook") in rows
    assert sum(y == "email" for _, y, _ in rows) == 240


def test_a_larger_collection_finds_as_much_in_each_text(spark):
    """Noise grows with the collection too; shares stay, so nothing drifts."""
    noise = ["Spring Boot", "Wrote Django", "Main Loop", "Green Field", "Data Centre"]

    def some(n):
        return [(i, t.replace("Led", f"{noise[i % 5]} for {noise[(i + i // 5) % 5]} and {noise[(i * 3) % 5]}, led")) for i, t in enumerate(corpus(n))]

    few, many = (P.find(spark.createDataFrame(some(n), "cv_id long, text string"), "cv_id", "text") for n in (120, 1200))
    per = [df.groupBy("pii_type").count().collect() for df in (few, many)]
    small, large = ({r.pii_type: r["count"] for r in x} for x in per)
    assert set(small) == set(large) == {"person_name", "email", "phone", "id_number", "street_address"}
    assert {k: round(large[k] / 10 / small[k], 1) for k in small} == dict.fromkeys(small, 1.0), (small, large)
    assert many.where("pii_text RLIKE 'Boot|Django|Loop|Field|Centre'").count() == 0


@pytest.mark.parametrize("v", ["Flat 51, 117 Perilatam Road", "93 W. Briarsti Blvd, Apt 56B", "Fliorosstraße 46", "Selomkrastr. 20a", "Am Kelaholhof 53", "101 allée des Zanarplas", "109 bis avenue Wenunnol", "23, rue de Wenilasti", "Calle Fliiyor, 63", "C/ Kelenfen 47, 2.º B", "Rua de Craunkel, n.º 86", "Travessa Troilbel 88", "ул. Липовая, д. 33", "улица Тихая, дом 127, кв. 53", "пр. Полевая, 154"])
def test_address_forms(v):
    for t in (v, v.lower(), f"Home - {v}, Townville | x", f"letter to {v} until spring"):
        m = P.ADDRESS.search(t)
        assert m and m.group().lower() == v.lower()


@pytest.mark.parametrize("v", ["a.b+c@d-e.example", "alice at firm dot example", "x.y (at) z.test", "q[at]w[dot]test", "m.n @ o.example", "A_B@C.TEST"])
def test_email_forms(v):
    assert [m.group() for m in P.EMAIL.finditer(f"mail {v}. Next")] == [v]


def test_redaction_leaves_the_rest(spark, patterns):
    docs = spark.createDataFrame([(3, corpus()[3])], "cv_id long, text string")
    r = P.redact(docs, "cv_id", "text", patterns).first().text
    assert "[PERSON_NAME]" in r and "[EMAIL]" in r and "Some Firm Ltd" in r and r.endswith("version 3.45.3-rc1.") and "@" not in r


def test_redaction_counts_characters_outside_the_first_plane(spark, patterns):
    t = "\U0001f600\U0001f600 " + corpus()[3]
    r = P.redact(spark.createDataFrame([(3, t)], "cv_id long, text string"), "cv_id", "text", patterns).first().text
    assert r.startswith("\U0001f600\U0001f600 ") and "@" not in r and r.endswith("version 3.45.3-rc1.")


def test_table(spark):
    rows = [(i, t, "x") for i, t in enumerate(corpus())] + [(0, corpus()[0], "x"), (900, None, "y"), (901, "", "y"), (None, corpus()[1], "z"), (902, "word " * 40_000, "q")]
    df = spark.createDataFrame(rows, "cv_id long, text string, pii_text string")
    pieces, redacted = P.find(df, "cv_id", "text"), P.redact(df, "cv_id", "text")
    assert pieces.columns == ["cv_id", "pii_type", "pii_text"] and pieces.count() == pieces.distinct().count()
    assert pieces.where("cv_id >= 900").count() == 0 and pieces.where("cv_id IS NULL").count() == 0
    by = {r.cv_id: r.text for r in redacted.collect()}
    assert by[900] is None and by[901] == "" and by[902] == "word " * 40_000 and len(by) == 123
    assert P.find(df.limit(0), "cv_id", "text").count() == 0 and P.redact(df.limit(0), "cv_id", "text").count() == 0
