import random

import pytest

from braidwork.llm import canonical as C

ENTRIES = [(1, "python", ("py",)), (2, "c++", ("cpp",)), (3, "continuous integration", ("ci",)), (4, "react", ()), (5, "apache kafka", ("kafka",)), (6, "vue.js", ("vue",))]
TITLES = [(7, "Data Engineer", ()), (8, "Software Architect", ()), (9, "Business Analyst", ())]


@pytest.fixture(scope="module")
def skills():
    return C.Resolver(ENTRIES)


def osa(a, b):
    d = [[max(i, j) if not min(i, j) else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i][j] = min(d[i - 1][j] + 1, d[i][j - 1] + 1, d[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i][j] = min(d[i][j], d[i - 2][j - 2] + 1)
    return d[len(a)][len(b)]


def test_trie_search_equals_brute_force():
    rng = random.Random(3)
    names = sorted({"".join(rng.choice("abcd") for _ in range(rng.randint(1, 9))) for _ in range(120)})
    t = C.Trie()
    for i, n in enumerate(names):
        t.add(n, i, C.allowed_edits(n), 0)
    for _ in range(300):
        w = "".join(rng.choice("abcd") for _ in range(rng.randint(0, 10)))
        want = {(osa(w, n), i) for i, n in enumerate(names) if osa(w, n) <= min(C.allowed_edits(n), 2)}
        assert {(d, e) for d, _, e in t.search(w, 2)} == want


@pytest.mark.parametrize(
    "value, entry",
    [("Python", 1), ("pyhton", 1), ("python 3.11", 1), ("рythоn", 1), ("pyth​on", 1), ("PY.", 1), ("good knowledge of python", 1), ("c plus plus", 2), ("cpp (advanced)", 2), ("CI/CD", 3), ("cont.  integration", 3), ("react.js", 4), ("kafka streams, 3 years", 5),
     ("pythons and boas care", 0), ("reaction chemistry", 0), ("kafkaesque prose", 0), ("-", 0), ("???", 0), (" ", 0), ("n/a", 0)],
)
def test_skills(skills, value, entry):
    assert skills.resolve(value) == entry


@pytest.mark.parametrize("value, entry", [("Sr. Data Enginere (m/f/d)", 7), ("JUNIOR ARCHITECT, SOFTWARE, FULL TIME", 8), ("Bus. Analyst - Lorilford", 9), ("analyst (business) (remote)", 9), ("Architect, Software - Fliarville", 8), ("Data Engineer, New Town", 7), ("Landscape Architect", 0), ("Software", 0)])
def test_titles(value, entry):
    assert C.Resolver(TITLES).resolve(value) == entry


def test_all_within_distance_are_given(skills):
    assert [e for _, _, e in skills.candidates("pythno")] == [1]
    near = C.Resolver([(1, "scala", ()), (2, "scale", ()), (3, "scalar", ())])
    assert {(d, e) for d, _, e in near.candidates("scala")} == {(0, 1), (1, 2), (1, 3)}


def test_paths_are_derived_from_the_other_names_of_any_list():
    """The same kinds of names on a list with other entries: nothing depends on a certain catalogue."""
    r = C.Resolver([(1, "zorblang", ("zorb",)), (2, "quark", ()), (3, "acme fluxion", ("fluxion",)), (4, "acme grindel", ()), (5, "deep mist analysis", ()), (6, "Tower Keeper", ("Tower Warden",)), (7, "Bridge Keeper", ()), (8, "nix++", ())])
    wanted = {"quarklang": 2, "quark-lang": 2, "grindel": 4, "acme zorb": 1, "DMA": 5, "analysis of deep mists": 5, "dp. mist analysis": 5, "Bridge Warden": 7, "keeper of bridges": 7, "Senior Brigde Keeper (m/f/d)": 7, "nix plus plus": 8, "quark engine": 2, "fluxion / grid": 3, "deep mist": 5}
    assert {v: r.resolve(v) for v in wanted} == wanted
    assert [r.resolve(v) for v in ("quarks bone script", "mist", "gate keeper union", "bridge", "quartz")] == [0, 0, 0, 0, 0]


def test_long_values(skills):
    assert skills.resolve("x" * 20_000) == 0


def test_table(spark):
    m = spark.createDataFrame(
        [(1, ["python", "pyhton", None, "", "pyhton"], None, "x"), (1, ["python", "pyhton", None, "", "pyhton"], None, "x"), (2, [], ["welding"], "y"), (None, ["js"], None, "z")],
        "result_id long, matched_skills array<string>, missing_skills array<string>, catalog_id string",
    )
    v = spark.createDataFrame([(5, "Data Engineer"), (6, "data engineer"), (7, None), (8, "")], "vacancy_id long, job_title string")
    c = spark.createDataFrame([(i, "skill", n, list(o)) for i, n, o in ENTRIES] + [(i, "title", n, None) for i, n, _ in TITLES], "catalog_id int, entry_kind string, canonical string, other_names array<string>")
    got = sorted(tuple(r) for r in C.free_values(m, v, c).collect())
    assert got == [("job_title", 6, "data engineer", 7), ("matched_skills", 1, "pyhton", 1), ("missing_skills", 2, "welding", 0)]
    assert C.free_values(m.limit(0), v.limit(0), c).count() == 0
    assert {r.catalog_id for r in C.free_values(m, v, c.limit(0)).collect()} == {0}


def test_entries_without_a_name_change_nothing(spark):
    m = spark.createDataFrame([(1, ["python", "pyhton"], ["welding"])], "result_id long, matched_skills array<string>, missing_skills array<string>")
    v = spark.createDataFrame([(5, "Data Engineer"), (6, "data engineer")], "vacancy_id long, job_title string")
    named = [(i, "skill", n, list(o)) for i, n, o in ENTRIES] + [(i, "title", n, None) for i, n, _ in TITLES]
    c = spark.createDataFrame([*named, (900, "skill", None, None), (901, "title", None, ["x"])], "catalog_id int, entry_kind string, canonical string, other_names array<string>")
    got = sorted(tuple(r) for r in C.free_values(m, v, c).collect())
    assert got == [("job_title", 6, "data engineer", 7), ("matched_skills", 1, "pyhton", 1), ("missing_skills", 1, "welding", 0)]
