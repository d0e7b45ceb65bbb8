"""Personal information inside free text (problem 5): bootstrapped contextual extraction.

Seed entities of strict form induce lexical patterns, that is contexts and forms. Spark scores patterns by the
entities they hold and entities by the patterns that hold them, round by round; patterns of high confidence then
find identifiers that no seed form covers. All five types go through the patterns: candidates are parsed once, and
every further step joins the candidate table with the table of patterns.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from braidwork.session import materialize, spread

EMAIL = re.compile(
    r"(?<![\w.+-])(?:[\w.+-]*\w(?:@| ?\[at\] ?| ?\(at\) ?| @ )[\w-]+(?:(?:\.| ?\[dot\] ?| ?\(dot\) ?| dot )[\w-]+)*(?:\.| ?\[dot\] ?| ?\(dot\) ?| dot )[^\W\d_]{2,}"
    r"|[\w.+-]*\w at [\w-]+(?: dot [\w-]+)* dot [^\W\d_]{2,})",
    re.I,
)
#: Hyphens and spaces in all widths.
NUMBER = re.compile(r"(?<![\w@+./-])(?:\+?\(?\d+\)?(?:(?:[-./\u2010-\u2015·]|[ \xa0\u2000-\u200a\u202f]{1,2}/[ \xa0]{1,2}|[ \xa0\u2000-\u200a\u202f]{1,2})?\(?\d+\)?)*[^\W\d_]?(?![\w@])|[^\W\d_]{1,3}\d+[^\W\d_]?\d{3,}[^\W\d_]?(?![\w@]))")
YEARS = re.compile(r"(?:19|20)\d\d(?: ?[-–/] ?(?:19|20)\d\d)?")
WORD = r"[^\W\d_][\w’'-]*"
#: Street words by language: where a street's address starts and how house, flat and floor follow. Fixed values.
ADDRESS = re.compile(
    (
    rf"\b\d+(?: (?:bis|ter|quater))?,? (?:rue|avenue|allée|boulevard|impasse|place|chemin|quai|cours|route)(?: (?:de la|de l’|des|de|du))? (?:d’|l’)?{WORD}(?:, (?:apt\.?|appartement|étage) ?\w+)?"
    rf"|(?:Flat \d+\w?, )?\b\d+[a-z]? (?:[NSEW]\. )?{WORD}(?: {WORD})? (?:Street|Road|Lane|Avenue|Boulevard|Mews|Drive|Court|Square|Terrace|Close|Way|Place|Crescent|Gardens|(?:Ave|Blvd|St|Rd|Dr|Ln)\b\.?)(?:, (?:Apt|Flat|Unit|Suite|Floor) ?\d*\w?)?"
    rf"|(?:\b(?:Calle|Avenida|Avda\.|Plaza|Paseo|Camino|Ronda)|\bC/)(?: (?:de la|de los|de las|del|de))? {WORD},? (?:n\.?º ?)?\d+[a-z]?(?:, \d+\.?[ºª°](?: [a-z]\b)?)?"
    rf"|\b(?:Rua|Avenida|Travessa|Praça|Largo|Alameda|Estrada)(?: (?:dos|das|de|da|do))? {WORD},? (?:n\.?º ?)?\d+[a-z]?(?:, \d+\.?[ºª°](?: (?:dto|esq|[a-z])\b\.?)?)?"
    rf"|\b(?:(?:Am|An der|Auf dem|Im|In der|Zum|Zur) )?[^\W\d_][\w-]*(?:straße|strasse|str\.|weg|platz|allee|gasse|ring|damm|ufer|hof|steig|chaussee) \d+(?: ?[a-z]\b)?"
    rf"|\b(?:ул\.|улица|пр\.|пр-т|проспект|пер\.|переулок|наб\.|набережная|бульвар|шоссе|пл\.|площадь) {WORD}(?: {WORD})?,? (?:(?:д\.|дом) ?)?\d+[а-я]?\b(?:, (?:корп\.|кв\.|квартира|эт\.|этаж) ?\d+)*"
    ).replace(" ", r"(?:[ \xa0]+)"),
    re.I,
)
#: What a line with an address, and one with an e-mail address, must have.
STREET = re.compile(
    r"\b(?:street|road|lane|avenue|boulevard|mews|drive|court|square|terrace|close|way|place|crescent|gardens|ave|blvd|st|rd|dr|ln"
    r"|rue|allée|impasse|chemin|quai|cours|route|calle|c/|avenida|avda|plaza|paseo|camino|ronda|rua|travessa|praça|largo|alameda|estrada"
    r"|ул\.|улица|пр\.|пр-т|проспект|пер\.|переулок|наб\.|набережная|бульвар|шоссе|пл\.|площадь)(?:(?<=[./])|(?!\w))"
    r"|(?:straße|strasse|str\.|weg|platz|allee|gasse|ring|damm|ufer|hof|steig|chaussee)[ \xa0]+\d",
    re.I,
)
AT = re.compile(r"@|[\[(]at[\])]| dot ", re.I)
DIGIT = re.compile(r"\d")
#: Words (short ones with the dot of an abbreviation), numbers, line breaks, signs.
TOKEN = re.compile(r"[^\W\d_]{1,4}\.(?=[ \xa0])|[^\W\d_]+(?:[-’'][^\W\d_]+)*|\d+|\n|[^\w\s]")
NAME_PART = r"(?:[^\W\d_]\.|[^\W\d_]+(?:[-’'][^\W\d_]+)*)"
#: Titles are no part of a name. Fixed values.
TITLES = {"dr", "prof", "mr", "mrs", "ms", "miss", "herr", "frau", "sr", "sra", "srta", "don", "doña", "dra", "mme", "mlle", "m", "dipl", "ing", "eng", "г-н", "г-жа", "господин", "госпожа"}
#: Labels of identity numbers whose values are seeds. Fixed values.
ID_LABELS = {"ssn", "nif", "nie", "dni", "cpf", "инн", "снилс", "паспорт", "passport", "passeport", "pasaporte", "passaporte", "reisepass", "reisepass-nr", "personalausweis", "personalausweis-nr", "id", "id card", "national id", "tax id", "nin", "pesel", "steuer-id"}
CYRILLIC = dict(zip("абвгдеёжзийклмнопрстуфхцчшщъыьэюя", "a b v g d e e zh z i y k l m n o p r s t u f kh ts ch sh shch  y  e yu ya".split(" ")))
STRICT = {
    "phone": re.compile(r"\+\d[\d ()/.-]{6,}\d"),
    "id_number": re.compile(r"\d{3}-\d{2}-\d{4}|\d{3}\.\d{3}\.\d{3}-\d{2}"),
}
STRICT_EMAIL = re.compile(r"[\w.+-]+@[\w-]+(?:\.[\w-]+)+")
AT_DOT = re.compile(r" ?[\[(]at[\])] ?| ?@ ?| at | ?[\[(]dot[\])] ?| dot |\.", re.I)
CAPITAL = r"(?:[A-ZÀ-ÖØ-ÞŒŠŽŸА-ЯЁ][^\W\d_]*(?:[-’'][^\W\d_]+)*\.?)"
#: Looser than ADDRESS: capitalised words with a number before or behind, whatever the street is called.
LOOSE_ADDRESS = re.compile(rf"\b\d{{1,3}}[a-z]?,?[ \xa0]{CAPITAL}(?:[ \xa0]{CAPITAL}){{1,3}}|{CAPITAL}(?:[ \xa0]{CAPITAL}){{0,2}},?[ \xa0]\d{{1,3}}[a-z]?\b")
RUN = re.compile(rf"(?<![\w@.-]){CAPITAL}(?:,[ \xa0]{{1,2}}{CAPITAL}(?:[ \xa0]{{1,2}}{CAPITAL})?|(?:[ \xa0]{{1,2}}{CAPITAL})+)(?![\w@])")
SMALL_RUN = re.compile(rf"(?<![\w@.-]){NAME_PART}(?:,?[ \xa0]{{1,2}}{NAME_PART})*(?![\w@])")
TYPES = ("person_name", "email", "phone", "id_number", "street_address")


def fold(word: str) -> str:
    """Latin letters and digits of a word, as an e-mail address would spell it."""
    w = "".join(CYRILLIC.get(c, c) for c in word.lower()).replace("ß", "ss")
    return "".join(c for c in unicodedata.normalize("NFKD", w) if c.isascii() and c.isalnum())


def shape(value: str) -> str:
    v = re.sub(r"[ \xa0\u2000-\u200a\u202f]+", " ", re.sub(r"[\u2010-\u2015]", "-", value))
    return re.sub(r"[^\W\d_]", "A", re.sub(r"\d", "0", v))


class Tokens:
    """The tokens of a text, and those beside a place: lower-cased, numbers as 0, ``^`` before and ``$`` behind all."""

    def __init__(self, text: str) -> None:
        found = [(m.start(), m.end(), m.group()) for m in TOKEN.finditer(text)]
        self.text = text
        self.starts = [s for s, _, _ in found]
        self.ends = [e for _, e, _ in found]
        self.words = [t for _, _, t in found]

    def _plain(self, i: int, j: int) -> list[str]:
        return ["0" if t[0].isdigit() else t.lower() for t in self.words[i:j]]

    def before(self, at: int, n: int = 2) -> list[str]:
        i = bisect_right(self.ends, at)
        out = self._plain(max(0, i - n), i)
        return ["^"] * (n - len(out)) + out

    def after(self, at: int, n: int = 2) -> list[str]:
        i = bisect_left(self.starts, at)
        cut = [self.text[at : self.ends[i - 1]]] if i and self.ends[i - 1] > at else []
        out = (cut + [w.rstrip(".") or w for w in self._plain(i, i + n)])[:n]
        return out + ["$"] * (n - len(out))


def numbers(text: str, taken: list[tuple[int, int]]) -> Iterator[tuple[int, int, str]]:
    """Numbers that may be a phone or identity number: seven digits or more, or five beside letters."""
    for m in NUMBER.finditer(text):
        v, start = m.group(), m.start()
        if YEARS.fullmatch(v):
            continue
        digits = sum(map(str.isdigit, v))
        if digits < (5 if any(map(str.isalpha, v)) else 7) or any(a <= start < b for a, b in taken):
            continue
        if v.count("(") != v.count(")"):
            if v[0] == "(":
                v, start = v[1:], start + 1
            else:
                v = v.rstrip(")")
        yield start, start + len(v), v


def name_spans(text: str) -> Iterator[tuple[int, int, list[str]]]:
    """Runs of two or three capitalised words or initials in a line, also as ``LAST, First``, without titles."""
    for m in RUN.finditer(text):
        spans = [(x.start() + m.start(), x.end() + m.start(), x.group()) for x in re.finditer(r"[^\s,]+", m.group())]
        for i in range(len(spans) - 2, -1, -1):  # a sentence or a title ends there
            if spans[i][2].endswith(".") and len(spans[i][2]) > 2:
                spans = spans[i + 1 :]
                break
        while spans and spans[0][2].rstrip(".").lower() in TITLES and len(spans) > 2:
            spans.pop(0)
        if spans[-1][2].endswith(".") and len(spans[-1][2]) > 2:
            spans[-1] = (spans[-1][0], spans[-1][1] - 1, spans[-1][2][:-1])
        words = [w for _, _, w in spans]
        if 2 <= len(words) <= 3 and not words[-1].endswith(".") and not any(w.endswith(".") and len(w) > 2 for w in words):
            yield spans[0][0], spans[-1][1], words


def windows(text: str) -> Iterator[tuple[int, int]]:
    """All runs of two or three words within a line: where a name may stand in text that has no capitals."""
    for m in SMALL_RUN.finditer(text):
        spans = [(x.start() + m.start(), x.end() + m.start(), x.group()) for x in re.finditer(r"[^\s,]+", m.group())]
        for i in range(len(spans)):
            for j in (i + 1, i + 2):
                if j < len(spans) and not (spans[j][2].endswith(".") or spans[i][2].rstrip(".") in TITLES):
                    yield spans[i][0], spans[j][1]


def _in_lines(text: str, pattern: re.Pattern, *needs: re.Pattern) -> Iterator[tuple[int, int, str]]:
    """Matches of a pattern that stays within a line, looked for only in lines that have what it needs."""
    at = 0
    for line in text.split("\n"):
        if all(n.search(line) for n in needs):
            for m in pattern.finditer(line):
                yield at + m.start(), at + m.end(), m.group()
        at += len(line) + 1


def _emails(text: str) -> list[tuple[int, int]]:
    return [(a, b) for a, b, _ in _in_lines(text, EMAIL, AT)]


def _addresses(text: str) -> list[tuple[int, int, str]]:
    return list(_in_lines(text, ADDRESS, DIGIT, STREET))


def names_address(parts: list[str], words: list[str], mailboxes: list[list[str]]) -> bool:
    """Whether one e-mail address spells a name: a whole surname of four letters or more, and another part or its initial."""
    for box in mailboxes:
        for p in parts:
            others = [q for q in words if q and q != p]
            if len(p) > 3 and any(
                t == p and any(u == q or len(u) == 1 and u == q[0] for u in box if u is not t for q in others) or any(t in (q[0] + p, p + q[0], q + p, p + q) for q in others) for t in box
            ):
                return True
    return False


def candidates(text: str) -> list[tuple[int, int, str, str, list[str], list[str], list[str], str | None, bool]]:
    """``(start, end, kind, value, contexts, forms, both, seed type, counts)`` of all that may be personal data.

    The lexical patterns that hold a candidate are its contexts, its forms (of names, their parts) and, of numbers,
    context and form together. Windows of text without capitals are searched only; they count in no pattern.
    """
    out: list[tuple[int, int, str, str, list[str], list[str], list[str], str | None, bool]] = []
    near = Tokens(text)
    mails = _emails(text)
    boxes = []
    for start, end in mails:
        v = text[start:end]
        parts = AT_DOT.split(v)
        left = re.split(r"@|[\[(]at[\])]| at ", v, flags=re.I)[0]
        boxes.append([f for f in (fold(re.sub(r"\d", "", w)) for w in re.split(r"[._+ -]", left)) if f])
        form = "".join(AT_DOT.findall(v)[-min(2, len(parts) - 1) :]).lower()
        out.append((start, end, "email", v, [f"eL\t{' '.join(near.before(start))}"], [f"eF\t{form}"], [], "email" if STRICT_EMAIL.fullmatch(v) else None, True))
    for start, end, v in numbers(text, mails):
        before = near.before(start, 3)
        seed = next((t for t, r in STRICT.items() if r.fullmatch(v)), None)
        words = [t.rstrip(".") for t in before if t not in (":", ".", "-", "№")]
        if not seed and words and (words[-1] in ID_LABELS or " ".join(words[-2:]) in ID_LABELS or words[-1] == "no" and words[-2:-1] and words[-2] in ID_LABELS):
            seed = "id_number"
        left, s = " ".join(before[1:]), shape(v)
        out.append((start, end, "number", v, [f"dL\t{left}"], [f"dS\t{s}"], [f"dLS\t{left}\t{s}"], seed, True))
    spans = [(s, e, w, True) for s, e, w in name_spans(text)]
    if not any(map(str.isupper, text)):
        spans = [(s, e, [], False) for s, e in windows(text)]
    for start, end, words, counts in spans:
        b, a = near.before(start), near.after(end)
        folded = [fold(w) for w in words]
        parts = [f for f, w in zip(folded, words) if not w.endswith(".") and len(f) > 1]
        contexts = [f"n12\t{b[-1]}\t{' '.join(a)}", f"n21\t{' '.join(b)}\t{a[0]}"]
        out.append((start, end, "name", text[start:end], contexts, [f"nP\t{p}" for p in parts], [], "person_name" if names_address(parts, folded, boxes) else None, counts))
    taken = []
    for start, end, v in _addresses(text):
        taken.append((start, end))
        word = STREET.search(v)
        form = f"aF\t{re.sub(r'[\d \xa0]+', '', word.group()).lower() if word else ''}\t{'0' if v[0].isdigit() else 'w'}"
        out.append((start, end, "address", v, [f"aLR\t{' '.join(near.before(start))}\t{near.after(end, 1)[0]}"], [form], [], "street_address", True))
    for m in LOOSE_ADDRESS.finditer(text):
        start, end, v = m.start(), m.end(), m.group()
        if all(end <= a or start >= b for a, b in taken):
            word = re.findall(r"[^\W\d_]+", v)[-1 if v[0].isdigit() else 0].lower()
            out.append((start, end, "address", v, [f"aLR\t{' '.join(near.before(start))}\t{near.after(end, 1)[0]}"], [f"aF\t{word}\t{'0' if v[0].isdigit() else 'w'}"], [], None, True))
    return out


PATTERNS = ("contexts", "forms", "both")
CANDIDATE = "start int, end int, kind string, value string, contexts array<string>, forms array<string>, both array<string>, seed string, counts boolean"


def candidate_table(docs: DataFrame) -> DataFrame:
    """Candidates of every row of ``docs (__key, text)``, written once: the texts are read and parsed a single time.

    ``row`` tells different texts under one key apart; patterns are hashes of 64 bits.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(k, r, *c) for k, r, t in zip(b["__key"].tolist(), b["row"].tolist(), b["text"].tolist()) for c in candidates(t)]
            yield pd.DataFrame(rows, columns=["__key", "row", "start", "end", "kind", "value", *PATTERNS, "seed", "counts"])

    kind = dict(docs.dtypes)["__key"]
    full = spread(docs.where(F.length("text") > 0).select("__key", F.xxhash64("text").alias("row"), "text"), "__key", "row")
    found = full.mapInPandas(run, f"__key {kind}, row long, {CANDIDATE}")
    return materialize(found.withColumns({c: F.transform(c, lambda k: F.xxhash64(k)) for c in PATTERNS}), "candidates")


def lower_bound(hits: Column, n: Column, z: float) -> Column:
    """Wilson's lower bound of the share ``hits / n``."""
    p = hits / n
    return (p + z * z / (2 * n) - z * F.sqrt(F.greatest(F.lit(0.0), p * (1 - p) / n + z * z / (4 * n * n)))) / (1 + z * z / n)


def learn(found: DataFrame, rounds: int = 4, least: float = 0.2, z: float = 1.6) -> DataFrame:
    """Patterns ``(key, type, confidence)`` from a candidate table, by rounds over the graph of patterns and entities.

    A pattern's confidence in a type is Wilson's lower bound of the share of its different entities that are known to
    be of the type; all others count in full against it, and below ``least`` it is no pattern. Seeds are known.
    Any other entity is known to its contexts by one of its forms, and to its forms by one of its contexts, so no
    pattern can raise itself: contexts and forms have to agree. Shares do not change with the size of the collection,
    and repeated rows have no effect. Patterns stay a table: there is no bound to their number.
    """
    entities = found.where("counts").groupBy(F.xxhash64("kind", F.lower("value")).alias("entity"), *PATTERNS).agg(F.max("seed").alias("seed"))
    entities = materialize(entities.withColumn("at", F.xxhash64("entity", *PATTERNS)), "entities")
    none = F.lit(None).cast("struct<confidence:double,type:string>")
    heard, patterns = entities.select("*", *[none.alias(f"by_{c}") for c in PATTERNS]), None
    for r in range(rounds):
        seed = F.when(F.col("seed").isNotNull(), F.struct(F.lit(1.0).alias("confidence"), F.col("seed").alias("type")))
        known = {c: F.when(F.col(f"by_{c}").isNotNull(), F.struct(F.lit(1.0).alias("confidence"), F.col(f"by_{c}.type"))) for c in PATTERNS}
        to = {"contexts": F.coalesce(seed, known["forms"]), "forms": F.coalesce(seed, known["contexts"]), "both": F.coalesce(seed, known["forms"], known["contexts"])}
        edges = heard.select("entity", F.inline(F.concat(*[_with(c, m.alias("said")) for c, m in to.items()])))
        once = edges.groupBy("key", "entity").agg(F.max("said").alias("said"))
        sums = [F.sum(F.when(F.col("said.type") == t, F.col("said.confidence")).otherwise(0.0)).alias(t) for t in TYPES]
        held = once.groupBy("key").agg(F.count("*").cast("double").alias("n"), *sums)
        best = F.greatest(*[F.struct(F.col(t).alias("hits"), F.lit(t).alias("type")) for t in TYPES])
        scored = held.select("key", best["type"].alias("type"), lower_bound(best["hits"], F.col("n"), z).alias("confidence"))
        patterns = materialize(scored.where(F.col("confidence") >= least), "patterns")
        if r < rounds - 1:
            open_ = entities.where(F.col("seed").isNull())
            said = _best(open_, patterns, ["at"])
            heard = entities.join(said, "at", "left")
    return patterns


def _with(patterns: str, column: Column) -> Column:
    return F.transform(patterns, lambda k: F.struct(k.alias("key"), column))


def _best(rows: DataFrame, patterns: DataFrame, by: list[str]) -> DataFrame:
    """Per ``by``: the most confident of its contexts, forms and joint patterns, ``by_...`` each."""
    keys = rows.select(*by, F.inline(F.concat(*[_with(c, F.lit(i).alias("view")) for i, c in enumerate(PATTERNS)])))
    each = F.struct("confidence", "type")
    return keys.join(patterns, "key").groupBy(*by).agg(*[F.max(F.when(F.col("view") == i, each)).alias(f"by_{c}") for i, c in enumerate(PATTERNS)])


def spans_of(found: DataFrame, patterns: DataFrame, least: float = 0.5) -> DataFrame:
    """``(__key, row, spans)``: the candidates that their patterns accept, in order and not overlapping.

    A candidate's confidence is that of its context, form or both, each taken as independent evidence, and has to
    reach ``least``. ``spans`` is ``array<struct<start, end, type, value>>``. Of overlapping ones the more
    confident, then the longer stays; e-mail addresses go first, then street addresses, then numbers, since names may
    stand inside them.
    """
    rank = F.when(F.col("kind") == "email", 3.0).when(F.col("kind") == "address", 2.0).when(F.col("kind") == "number", 1.0).otherwise(0.0)
    place = ["__key", "row", "start", "end", "kind", "value"]
    held = _best(found.where(F.col("seed").isNull()), patterns, place)
    best = F.greatest(*[f"by_{c}" for c in PATTERNS])
    doubt = F.lit(1.0)
    for c in PATTERNS:
        doubt = doubt * F.when(F.col(f"by_{c}.type") == best["type"], 1 - F.col(f"by_{c}.confidence")).otherwise(1.0)
    accepted = held.select(*place, (1 - doubt).alias("confidence"), best["type"].alias("type")).where(F.col("confidence") >= least)
    strict = found.where(F.col("seed").isNotNull()).select(*place, F.lit(1.0).alias("confidence"), F.col("seed").alias("type"))
    taken = accepted.unionByName(strict).groupBy(*place).agg(F.max(F.struct("confidence", "type")).alias("best"))
    one = F.struct((-(rank + F.col("best.confidence"))).alias("order"), (F.col("start") - F.col("end")).alias("size"), "start", "end", F.col("best.type").alias("type"), "value")
    rows = taken.groupBy("__key", "row").agg(F.array_sort(F.collect_list(one)).alias("all"))
    kept = F.aggregate("all", F.slice("all", 1, 0), lambda acc, x: F.when(F.exists(acc, lambda y: (x["start"] < y["end"]) & (y["start"] < x["end"])), acc).otherwise(F.concat(acc, F.array(x))))
    return rows.select("__key", "row", F.array_sort(F.transform(kept, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["type"].alias("type"), x["value"].alias("value")))).alias("spans"))


def redacted(text: Column, spans: Column) -> Column:
    """The text with a typed placeholder in place of each span, all else unchanged."""
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))

    def step(acc: Column, x: Column) -> Column:
        piece = F.concat(acc["out"], text.substr(acc["at"] + 1, x["start"] - acc["at"]), F.lit("["), F.upper(x["type"]), F.lit("]"))
        return F.struct(piece.alias("out"), x["end"].alias("at"))

    done = F.aggregate(spans, start, step, lambda acc: F.concat(acc["out"], text.substr(acc["at"] + 1, F.length(text))))
    return F.when(F.size(spans) > 0, done).otherwise(text)


def _docs(df: DataFrame, key: str, text: str) -> DataFrame:
    return df.select(F.col(key).alias("__key"), F.col(text).alias("text")).where(F.col("__key").isNotNull())


def find(df: DataFrame, key: str, text: str, patterns: DataFrame | None = None) -> DataFrame:
    """``(key, pii_type, pii_text)`` of each different piece of personal data.

    ``patterns`` are those learned from another collection (``learn``); without them they are learned from this one.
    Rows with a null key are dropped; null and empty texts have no pieces. Repeated rows count once here and in
    the patterns.
    """
    found = candidate_table(_docs(df, key, text))
    spans = spans_of(found, learn(found) if patterns is None else patterns)
    return spans.select(F.col("__key").alias(key), F.explode("spans").alias("s")).select(key, F.col("s.type").alias("pii_type"), F.col("s.value").alias("pii_text")).distinct()


def redact(df: DataFrame, key: str, text: str, patterns: DataFrame | None = None) -> DataFrame:
    """``(key, text)`` with typed placeholders, each different row once; null and empty texts stay as they are."""
    docs = _docs(df, key, text)
    found = candidate_table(docs)
    spans = spans_of(found, learn(found) if patterns is None else patterns)
    rows = docs.distinct().withColumn("row", F.xxhash64("text")).join(spans, ["__key", "row"], "left")
    return rows.select(F.col("__key").alias(key), redacted(F.col("text"), F.coalesce("spans", F.array().cast("array<struct<start:int,end:int,type:string,value:string>>"))).alias(text))
