"""Garbled text from wrong character encoding (problem 9): a multi-pattern automaton of garbled sequences."""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LATIN = "àâäçéèêëîïôöùûüÿœæßñáíóúãõåøìòýšž"
CYRILLIC = "абвгдеёжзийклмнопрстуфхцчшщъыьэюя"
MARKS = "‘’“”„‚–—…•€§°µ±½¼¾®©™≈º²³ª¿¡«»№\xa0´·×÷£¥¢"
#: Characters that may have been garbled.
REPERTOIRE = sorted(set(LATIN + LATIN.upper() + "ŸßŒÆÅØ" + CYRILLIC + CYRILLIC.upper() + MARKS) - set("SẞABCDEFGHIJKLMNOPQRTUVWXYZ"))
LETTERS = set(LATIN + LATIN.upper() + CYRILLIC + CYRILLIC.upper())
#: Encodings that UTF-8 is read as, and pairs (written, read) of single-byte encodings. Fixed values.
READ_AS = ("cp1252", "latin-1", "cp1251", "mac_roman", "cp437", "cp850", "cp866", "koi8-r", "cp1250", "iso8859-2", "iso8859-15", "cp1254", "cp852")
PAIRS = (
    *((w, r) for w in ("cp1252",) for r in ("mac_roman", "cp437", "cp850", "cp1251")),
    ("mac_roman", "cp1252"), ("cp850", "cp1252"), ("cp437", "cp1252"),
    *((w, r) for w in ("cp1251", "koi8-r", "cp866", "mac_cyrillic") for r in ("cp1252", "latin-1", "cp1251", "cp866", "koi8-r", "mac_roman", "cp437") if w != r),
)
#: Second characters that also follow a letter in sound text.
ORDINARY = set("ёЁ\xa0“”‘’„…–—•«»№≈°±§®©µ·")
#: Letters of Russian by frequency, in percent. Fixed values, public knowledge.
RUSSIAN = dict(zip("оеаинтсрвлкмдпуяыьгзбчйхжшюцщэфъё", (10.97, 8.45, 8.01, 7.35, 6.70, 6.26, 5.47, 4.73, 4.54, 4.40, 3.49, 3.21, 2.98, 2.81, 2.62, 2.01, 1.90, 1.74, 1.70, 1.65, 1.59, 1.44, 1.21, 0.97, 0.94, 0.73, 0.64, 0.48, 0.36, 0.32, 0.26, 0.04, 0.04)))
TOKEN = re.compile(r"[^\x00-\x26\x28-\x40\x5b-\x60\x7b-\x7f]*[^\x00-\x7f][^\x00-\x26\x28-\x40\x5b-\x60\x7b-\x7f]*")
LOST = "�"
#: Boxes, blocks and signs that text of this kind never has: proof even in the shortest token.
FOREIGN = {chr(c) for c in range(0x2500, 0x25A0)} | set("∞∩∏∫∂◊∑≡⌠⌡⌐ⁿ∙√")


def read_byte(b: int, encoding: str) -> str:
    """The character that a byte is read as; bytes without one become control characters, as browsers do."""
    try:
        return bytes([b]).decode(encoding)
    except UnicodeDecodeError:
        return chr(b)


@lru_cache(maxsize=None)
def sequences() -> dict[str, list[tuple[str, str]]]:
    """Garbled sequence -> ``(read as, original character)`` of UTF-8 read as each encoding."""
    out: dict[str, list[tuple[str, str]]] = {}
    for read in READ_AS:
        # text may be garbled twice: what one reading makes of a byte is written and read again
        for c in dict.fromkeys([*REPERTOIRE, *(read_byte(b, read) for b in range(0x80, 0x100))]):
            g = "".join(read_byte(b, read) for b in c.encode("utf-8"))
            if all(ord(x) > 0x7F for x in g):
                known = out.setdefault(g, [])
                if all(r != read for r, _ in known):
                    known.append((read, c))
    return out


@lru_cache(maxsize=None)
def images() -> dict[tuple[str, str], dict[str, str]]:
    """For each single-byte pair: garbled character -> original character."""
    out = {}
    for written, read in PAIRS:
        m = {}
        for c in REPERTOIRE:
            try:
                b = c.encode(written)
            except UnicodeEncodeError:
                continue
            g = read_byte(b[0], read)
            if g != c and ord(g) > 0x7F:
                m[g] = c
        out[written, read] = m
    return out


@lru_cache(maxsize=None)
def automaton():
    import ahocorasick

    a = ahocorasick.Automaton()
    for g, known in sequences().items():
        a.add_word(g, (g, known))
    a.make_automaton()
    return a


def _script(c: str) -> str:
    return "a" if c.isascii() and c.isalpha() or c in LATIN or c in LATIN.upper() else "c" if c.lower() in CYRILLIC else ""


def oddity(token: str) -> int:
    """How much of a token no language of the collection has: foreign characters inside, small before capital
    letters with accents, scripts mixed, three accented Latin letters in a row."""
    core = token.strip("'’‘“”„«»…–—•®©™°§±½€≈\xa0")
    odd = row = 0
    for i, c in enumerate(core):
        s = _script(c)
        if not s and c not in "'’-µ":
            odd += 1
        row = row + 1 if s == "a" and not c.isascii() else 0
        odd += row == 3
        if i:
            p = core[i - 1]
            t = _script(p)
            if s and t and s != t:
                odd += 1
            elif s and t and p.islower() and c.isupper() and not (p.isascii() and c.isascii()):
                odd += 1
    return odd


@lru_cache(maxsize=None)
def byte_automaton():
    """Automaton of the garbled pairs of letters that sound text does not have, each with the encoding pairs that make it.

    Of every pair of encodings, all two letters in a row of one script are garbled, one of them beyond ASCII at least;
    what comes out stays if its scripts, cases or signs do not go together (``oddity``), or if both are Latin letters
    with accents, which sound words seldom have in a row.
    """
    import ahocorasick

    foreign = set(LATIN + LATIN.upper())
    latin, cyrillic = LATIN + LATIN.upper(), CYRILLIC + CYRILLIC.upper()
    plain = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"
    made: dict[str, list[int]] = {}
    for n, back in enumerate(images().values()):
        m = {c: g for g, c in back.items()}
        for one, other in ((latin, latin + plain), (plain, latin), (cyrillic, cyrillic), (MARKS, plain), (plain, MARKS)):
            for x in one:
                for y in other:
                    if oddity(x + y) or y.isupper() and x.islower():
                        continue
                    g = m.get(x, x if x in plain else "") + m.get(y, y if y in plain else "")
                    if len(g) == 2 and g != x + y and (oddity(g) or not FOREIGN.isdisjoint(g) or all(c in foreign for c in g)):
                        known = made.setdefault(g, [])
                        if not known or known[-1] != n:
                            known.append(n)
        for g in FOREIGN.intersection(back):  # proof without a neighbour
            known = made.setdefault(g, [])
            if not known or known[-1] != n:
                known.append(n)
    a = ahocorasick.Automaton()
    for g, known in made.items():
        a.add_word(g, (g, known))
    a.make_automaton()
    return a


def _russian(word: str) -> float:
    import math

    return sum(math.log(RUSSIAN.get(c, 0.001) / 100) for c in word.lower())


def _well_cased(word: str) -> bool:
    return not word or word.islower() or word.isupper() or word[:1].isupper() and word[1:].islower()


def _utf8_spans(text: str) -> list[tuple[int, int, str]]:
    """Spans of UTF-8 read as another encoding, with the originals."""
    hits: list[tuple[int, int, str, str, bool]] = []
    for end, (g, known) in automaton().iter_long(text):
        start = end - len(g) + 1
        before, after = text[start - 1 : start], text[end + 1 : end + 2]
        for read, c in known:
            lead = g[0]
            weak = len(g) == 2 and g[1] in ORDINARY and (
                (before.isupper() or not (before.isascii() and before.isalpha()) and not (after.isascii() and after.isalpha())) if lead.lower() in CYRILLIC else before.isupper()
            )
            if len(g) == 2 and g[0] in LETTERS and g[1] in LETTERS:
                weak = True
            hits.append((start, end + 1, read, c, weak))
    sure = {h[2] for h in hits if not h[4]}
    # two in a row are no chance either, unless they are ordinary letters
    by_start = {(h[0], h[2]): h for h in hits}
    for h in hits:
        nxt = by_start.get((h[1], h[2]))
        if h[4] and nxt and h[2] not in sure and not all(c in LETTERS for c in text[h[0] : nxt[1]]) and oddity(text[h[0] : nxt[1]]):
            sure.add(h[2])
    spans, last = [], -1
    rank = {r: i for i, r in enumerate(READ_AS)}
    for start, end, read, c, weak in sorted(hits, key=lambda h: (h[0], rank[h[2]])):
        if read in sure and start > last:
            spans.append((start, end, c))
            last = end - 1
    return spans


def _byte_spans(text: str) -> list[tuple[int, int, str]]:
    """Words of one single-byte encoding read as another, with the originals.

    The automaton's matches name the pairs of encodings that may have made them; of those the one that explains the words
    around the matches best is taken, and its words are replaced, with those of the same line that it does not worsen.
    """
    hits: dict[int, int] = {}
    ends = []
    for end, (_, known) in byte_automaton().iter(text):
        ends.append(end)
        for n in known:
            hits[n] = hits.get(n, 0) + 1
    if not hits:
        return []
    tokens = [(m.start(), m.end(), m.group()) for m in TOKEN.finditer(text)]
    best: tuple[float, tuple[str, str] | None] = (0.0, None)
    odd = {t: oddity(t) for t in {x[2] for x in tokens}}
    pairs = list(images())
    for n in sorted(hits):
        pair = pairs[n]
        m = images()[pair]
        gain = 0.0
        letters_g = letters_r = ""
        for t, o in odd.items():
            short = len(t) < 3 or not any(c.isalpha() for c in t)
            if short and FOREIGN.isdisjoint(t) or any(ord(c) > 0x7F and c not in m for c in t):
                continue
            r = "".join(m.get(c, c) for c in t)
            if pair[0] != "cp1252" and pair[1] in ("cp1251", "cp866", "koi8-r") and all(c.lower() in CYRILLIC for c in t + r):
                if not t.islower() and _well_cased(r) and (_well_cased(t) or len(t) > 3):
                    letters_g, letters_r = letters_g + t, letters_r + r
                    gain += 0.0 if _well_cased(t) else 1.0
                continue
            if o and not oddity(r) and _well_cased("".join(c for c in r if c.isalpha())):
                gain += o
        if len(letters_r) >= 8:
            per = (_russian(letters_r) - _russian(letters_g)) / len(letters_r)
            gain = gain + len(letters_r) / 8 if per > 0.35 else 0.0
        elif letters_r:
            gain = 0.0
        if gain > best[0]:
            best = (gain, pair)
    if not best[1]:
        return []
    m, spans = images()[best[1]], []
    cyrillic = best[1][0] != "cp1252" and best[1][0] not in ("mac_roman", "cp850", "cp437")
    breaks = [i for i, c in enumerate(text) if c == "\n"]
    damaged_lines = set()
    fixed = []
    for start, end, t in tokens:
        if any(ord(c) > 0x7F and c not in m for c in t):
            continue
        r = "".join(m.get(c, c) for c in t)
        sure = (odd[t] and not oddity(r)) or (cyrillic and len(t) > 2 and all(c.lower() in CYRILLIC for c in t + r) and _well_cased(r) and _russian(r) - _russian(t) > 0.35 * len(t))
        line = bisect_left(breaks, start)
        fixed.append((start, end, r, sure, odd[t] >= oddity(r), line))
        if sure:
            damaged_lines.add(line)
    for start, end, r, sure, better, line in fixed:
        if sure or better and line in damaged_lines:
            spans.append((start, end, r))
    return spans


def _apply(text: str, spans: list[tuple[int, int, str]]) -> str:
    out, at = [], 0
    for start, end, r in spans:
        out += [text[at:start], r]
        at = end
    return "".join([*out, text[at:]])


def _total_oddity(text: str) -> int:
    return sum(oddity(m.group()) for m in TOKEN.finditer(text))


def repair(text: str | None) -> tuple[bool, str | None]:
    """``(damaged, restored text)``. Text garbled several times, or in parts by several pairs of encodings, is repaired
    pass by pass until no garbled sequence is left or none can be mended: every pass but the last makes the text less
    odd or shorter, so there is an end. Characters that were lost are left as they are, and make the text
    damaged. Null and plain ASCII are sound."""
    if not text or text.isascii():
        return False, text
    damaged = LOST in text
    state = (_total_oddity(text), len(text))
    while True:
        found = [x for x in (_utf8_spans(text), _byte_spans(text)) if x]
        if not found:
            return damaged, text
        damaged = True
        new = min((_apply(text, x) for x in found), key=_total_oddity)
        after = (_total_oddity(new), len(new))
        if new == text or after[0] > state[0] or after[0] == state[0] and after[1] >= state[1]:
            return damaged, new if after[0] <= state[0] else text
        text, state = new, after


def repair_column(text: Column) -> Column:
    """``struct<damaged boolean, restored string>`` for each text; restored is null for sound texts."""

    @F.pandas_udf("damaged boolean, restored string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            rows = [repair(t) for t in texts]
            yield pd.DataFrame({"damaged": [d for d, _ in rows], "restored": [r if d else None for d, r in rows]})

    return run(text)


def damaged_documents(documents: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, restored`` of the damaged documents, each once. Rows with a null id are dropped; null, empty and
    plain ASCII texts are sound and never reach Python. Of unequal texts under one id the first in order is kept."""
    open_rows = documents.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).where(F.col("doc_id").isNotNull() & F.col("text").rlike(r"[^\x00-\x7f]"))
    checked = open_rows.withColumn("r", repair_column(F.col("text"))).where("r.damaged").select("doc_id", F.col("r.restored").alias("restored"))
    return checked.groupBy("doc_id").agg(F.min("restored").alias("restored"))
