import random

import pytest

from braidwork.llm import encoding as X

FRENCH = "Benévolat très apprécié à l’étranger : nous avons créé une équipe dévouée, là où l’on a réécrit le modèle."
GERMAN = "Außerdem habe ich Übersetzer geschult, größere Module geprüft und für Prüfungen nächtliche Läufe eingeführt."
RUSSIAN = "Команда встречается с переводчиками каждую неделю. Мы ждём от девяти лет опыта в области медицины."


@pytest.mark.parametrize("text", [FRENCH, GERMAN, RUSSIAN])
@pytest.mark.parametrize("read", X.READ_AS)
def test_utf8_read_as_another_encoding(text, read):
    bad = "".join(X.read_byte(b, read) for b in text.encode("utf-8"))
    damaged, restored = X.repair(bad)
    assert damaged
    if read in ("cp1252", "latin-1", "cp1251", "mac_roman"):
        assert restored == text


def test_twice_garbled():
    once = "".join(X.read_byte(b, "cp1252") for b in FRENCH.encode())
    twice = "".join(X.read_byte(b, "cp1252") for b in once.encode())
    assert X.repair(twice) == (True, FRENCH)


@pytest.mark.parametrize("written, read, text", [("cp1252", "mac_roman", GERMAN), ("cp1252", "cp437", FRENCH), ("cp1251", "cp1252", RUSSIAN), ("koi8-r", "cp1251", RUSSIAN), ("cp866", "cp1251", RUSSIAN), ("cp1251", "koi8-r", RUSSIAN)])
def test_single_byte_pairs(written, read, text):
    bad = "".join(X.read_byte(b, read) for b in text.encode(written))
    damaged, restored = X.repair(bad)
    same = sum(a == b for a, b in zip(restored.split(), text.split()))
    assert damaged and same >= 0.8 * len(text.split())


def test_sound_text_is_left_alone():
    sound = [FRENCH, GERMAN, RUSSIAN, FRENCH.upper(), RUSSIAN.upper(), "NÃO SEM ATENÇÃO À SITUAÇÃO", "Café Röd® at 5 µs and 20 °C, § 3 (≈ €35k), ±½ day — “naïve”…", "“витрину” in the Russian office", "Íñigo Élodie Ángel Ünal", "", None, "plain"]
    for t in sound:
        assert X.repair(t) == (False, t)


def test_only_damaged_spans_change():
    bad = "".join(X.read_byte(b, "cp1252") for b in "préféré".encode())
    text = f"{GERMAN}\n{bad}\n{RUSSIAN}"
    assert X.repair(text) == (True, f"{GERMAN}\npréféré\n{RUSSIAN}")


@pytest.mark.parametrize("bad, good", [("at 5 ╡s", "at 5 µs"), ("20 ░C", "20 °C"), ("▒╜ day", "±½ day")])
def test_short_tokens(bad, good):
    assert X.repair(bad) == (True, good)


def test_lost_characters_are_reported():
    assert X.repair("a � b") == (True, "a � b")


def test_long_and_random_text_does_not_break():
    rng = random.Random(1)
    for n in (1, 10, 1000, 50_000):
        X.repair("".join(chr(rng.choice((rng.randint(1, 0x24F), rng.randint(0x400, 0x45F), rng.randint(0x2000, 0x2600)))) for _ in range(n)))


def test_table(spark):
    bad = "".join(X.read_byte(b, "cp1252") for b in "préféré".encode())
    df = spark.createDataFrame([(1, bad, "x"), (1, bad, "x"), (2, "sound", "y"), (3, None, "z"), (4, "", "z"), (None, bad, "z"), (5, FRENCH, "q")], "doc_id long, text string, restored string")
    assert [tuple(r) for r in X.damaged_documents(df).collect()] == [(1, "préféré")]
    assert X.damaged_documents(df.limit(0)).count() == 0


def test_parts_garbled_by_different_pairs_are_all_repaired():
    one = "".join(X.read_byte(b, "cp1252") for b in RUSSIAN.encode("cp1251"))
    two = "".join(X.read_byte(b, "mac_roman") for b in GERMAN.encode("cp1252"))
    three = "".join(X.read_byte(b, "cp1252") for b in FRENCH.encode())
    four = "".join(X.read_byte(b, "cp1250") for b in FRENCH.encode())
    damaged, restored = X.repair("\n\n".join((one, two, three, four)))
    parts = restored.split("\n\n")
    assert damaged and parts[2] == FRENCH
    for got, want in ((parts[0], RUSSIAN), (parts[1], GERMAN), (parts[3], FRENCH)):
        assert sum(a == b for a, b in zip(got.split(), want.split())) >= 0.8 * len(want.split())


def test_many_lines():
    bad = "".join(X.read_byte(b, "cp1252") for b in RUSSIAN.encode("cp1251"))
    damaged, restored = X.repair("\n".join([GERMAN] * 3000 + [bad]))
    assert damaged and restored.startswith(GERMAN) and restored.endswith(RUSSIAN[-20:])
