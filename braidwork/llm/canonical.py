"""Mapping freely entered values to a reference list (problem 1): a trie searched with Levenshtein automata."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import combinations, product
from math import prod

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Words that carry no meaning of their own inside a name. Fixed values.
FUNCTION_WORDS = {"of", "in", "for", "the", "and", "with", "on", "to", "a", "an"}
#: Endings that forms of one English word differ by, longest first. Fixed values.
ENDINGS = ("isation", "ization", "ations", "ation", "ators", "ating", "ative", "ated", "ator", "ments", "ment", "ings", "ing", "ions", "ion", "ors", "ers", "ies", "or", "er", "ed", "es", "ful", "y", "s", "e")
#: How signs are read aloud. Fixed values.
SIGNS = {"+": " plus ", "#": " sharp "}
#: Latin letters that Cyrillic and Greek letters look like. Fixed values.
LOOKALIKES = str.maketrans("аеорсухіјѕһԁԛԝвкмнтАВЕКМНОРСТУХІЈЅΑΒΕΖΗΙΚΜΝΟΡΤΥΧο", "aeopcyxijshdqwbkmhtABEKMHOPCTYXIJSABEZHIKMNOPTYXo")
#: Words on level, place, contract, hours or degree of knowledge, before and after a value. Fixed values.
BEFORE = re.compile(
    r"^(?:(?:good|basic|advanced|solid|strong|deep|working|some|excellent|expert|proven|profound|hands[- ]on|intermediate|fluent)\s+)*(?:knowledge|experience|skills?|understanding|command|expertise|proficiency)\s+(?:of|with|in|on)\s+"
    r"|^(?:basic|advanced|expert|intermediate|beginner|proficient(?: in)?|familiar with|experienced in|skilled in)\s+"
    r"|^(?:sr|jr|senior|junior|lead|principal|staff|mid[- ]level|mid|entry[- ]level|associate|head|chief|trainee|intern|working student)\b\.?\s+"
)
AFTER = re.compile(
    r"\s*(?:\*+|[!?.;:,]+|\((?:advanced|basic|intermediate|expert|beginner|proficient|remote|hybrid|on[- ]?site|m/f/d|f/m/d|m/w/d|m/f/x|all genders|contract|full[- ]time|part[- ]time|permanent|temporary|urgent!?|\d+\s*[-–+]?\s*\d*\s*(?:years?|yrs?)[^)]*|[ivx]{1,4})\)"
    r"|[,|/–—-]?\s*\b(?:\d+\+?\s*(?:years?|yrs?)(?:\s+(?:of\s+)?experience)?|full[- ]time|part[- ]time|permanent|temporary|contract|freelance|remote|hybrid|on[- ]?site|urgent|ii|iii|iv|level \d|advanced|expert|intermediate|beginner))\s*[!.]*$"
)
PLACE = re.compile(r"\s*(?:\s[-–—/|@]|,)\s+[^\W\d_][\w'.-]*(?:\s[\w'.]+)*$")
VERSION = re.compile(r"[\s-]*v?\d+(?:\.\d+)*[a-z]?\+?$")


def tidy(value: str) -> str:
    """One spelling for the value: compatible forms, no invisible characters, Latin look-alikes, lower case."""
    v = unicodedata.normalize("NFKC", value)
    v = "".join(c for c in v if unicodedata.category(c) != "Cf")
    if re.search("[Ѐ-ӿͰ-Ͽ]", v) and not re.search("[Ѐ-ӿͰ-Ͽ]", v.translate(LOOKALIKES)):
        v = v.translate(LOOKALIKES)
    return re.sub(r"[\s_]+", " ", v).strip().lower()


def words_of(value: str) -> list[str]:
    """The words of a tidy value: separators and outer dots gone; ``+``, ``#`` and inner dots stay."""
    return [w for w in (x.strip(".") for x in re.sub(r"[^\w+#.]+", " ", value).split()) if w]


def joined(value: str) -> str:
    """The value as one word: whatever separates its parts makes no difference."""
    return re.sub(r"[^\w+#]+", "", value).replace("_", "")


def root(word: str) -> str:
    """What the forms of a word have in common (test, tests, testing; model, modelling)."""
    for e in ENDINGS:
        if word.endswith(e) and len(word) - len(e) >= (3 if e == "s" else 4):
            word = word[: -len(e)]
            break
    return word[:-1] if len(word) > 4 and word[-1] == word[-2] else word


def unordered(words: Iterable[str]) -> str:
    """Words without function words, by their roots, in alphabetical order: a path that is free of word order."""
    return " ".join(sorted(root(w) for w in words if w not in FUNCTION_WORDS))


def abbreviates(short: str, word: str) -> bool:
    """Whether ``short`` is a beginning of ``word``, or its letters in order from the first consonants on."""
    if len(short) < 2 or len(short) >= len(word) or short[0] != word[0]:
        return False
    if len(short) >= 3 and word.startswith(short):
        return True
    at = 0
    for c in word:
        if at < len(short) and c == short[at]:
            at += 1
    return at == len(short) and not any(c in "aeiou" for c in short[1:])


def initials(words: list[str]) -> Iterator[str]:
    """Names with the first letters of all or of the first words in place of them (``sre``, ``ml engineer``)."""
    words = [w for w in words if w not in FUNCTION_WORDS]
    for n in range(2, len(words) + 1):
        yield " ".join(("".join(w[0] for w in words[:n]), *words[n:]))


def bare(value: str) -> str:
    """The value without words on level, place, contract, hours or degree of knowledge."""
    while True:
        v = AFTER.sub("", BEFORE.sub("", value)).strip()
        if v == value or not v:
            return v or value
        value = v


class Trie:
    """Paths by their letters, each with the entry that it leads to, the edits it allows and how far it is derived."""

    def __init__(self) -> None:
        self.next: list[dict[str, int]] = [{}]
        self.ends: list[list[tuple[int, int, int]]] = [[]]
        #: Of the paths through a node: the edits that one allows at most, the letters that are left at least and at most.
        self.below: list[tuple[int, int, int]] = [(0, 1 << 30, 0)]

    def add(self, path: str, entry: int, edits: int, rank: int) -> None:
        node = 0
        for i, c in enumerate(path):
            if c not in self.next[node]:
                self.next[node][c] = len(self.next)
                self.next.append({})
                self.ends.append([])
                self.below.append((0, 1 << 30, 0))
            node = self.next[node][c]
            most, least, longest = self.below[node]
            left = len(path) - i - 1
            self.below[node] = (max(most, edits), min(least, left), max(longest, left))
        if all(e != entry or r > rank or d < edits for e, d, r in self.ends[node]):
            self.ends[node].append((entry, edits, rank))

    def search(self, word: str, most: int) -> list[tuple[int, int, int]]:
        """All ``(distance, rank, entry)`` of paths within their allowed edits of ``word``, at most ``most``.

        The trie is walked with the states of the word's Levenshtein automaton, an exchange of neighbours being one
        edit. The states with 0, 1, .. edits are the bits of one number each (bit i: i letters of the word are read),
        so that a step is a few operations on whole numbers. A branch ends when no state is left.
        """
        n, found = len(word), []
        full = (1 << (n + 1)) - 1
        letters: dict[str, int] = {}
        for i, c in enumerate(word):
            letters[c] = letters.get(c, 0) | 1 << i
        first = [(1 << (d + 1)) - 1 & full for d in range(most + 1)]
        stack = [(0, 0, first, [0] * (most + 1))]
        while stack:
            node, depth, states, swaps = stack.pop()
            if self.ends[node]:
                distance = next((d for d, s in enumerate(states) if s >> n & 1), None)
                if distance is not None:
                    found += [(distance, rank, entry) for entry, edits, rank in self.ends[node] if distance <= edits]
            depth += 1
            for c, child in self.next[node].items():
                edits, least, longest = self.below[child]
                edits = min(edits, most)
                if not depth + least - edits <= n <= depth + longest + edits:
                    continue  # all paths there are too long or too short
                s = letters.get(c, 0)
                new, swapping = [(states[0] & s) << 1], [0]
                alive = new[0]
                for d in range(1, min(edits, len(states) - 1) + 1):
                    before = states[d - 1]
                    new.append(((states[d] & s) << 1 | before << 1 | before | new[d - 1] << 1 | (swaps[d] & s) << 2) & full)
                    swapping.append(before & s >> 1)
                    alive |= new[d]
                if alive:
                    stack.append((child, depth, new, swapping))
        return found


def allowed_edits(path: str) -> int:
    """Edits that a path allows: none up to four letters, 1 up to seven, 2 beyond."""
    n = len(path)
    return 0 if n < 5 else 1 if n < 8 else 2


#: How a path was derived from an entry; at equal distance the lower one wins.
NAME, OTHER, ORDER, SHORT, LIKE, WIDER = range(6)


def optional_parts(entries: list[tuple[int, str, Iterable[str]]]) -> tuple[set[str], set[str], dict[str, set[str]]]:
    """What the entries' own other names show to be optional before or behind a name, and which words stand for another.

    ``golang: go`` shows that *lang* may be missing behind a name, ``apache kafka: kafka`` the same of *apache* in front,
    ``Backend Developer: Back End Engineer`` that an engineer may be a developer.
    """
    front, behind, alike = set(), set(), {}
    for _, name, others in entries:
        long, words = joined(tidy(name)), words_of(tidy(name))
        for other in others or ():
            short, own = joined(tidy(other)), words_of(tidy(other))
            if len(short) > 1 and len(long) - len(short) > 1:
                if long.startswith(short):
                    behind.add(long[len(short) :])
                if long.endswith(short):
                    front.add(long[: -len(short)])
            if len(words) > 1 and len(own) > 1 and joined(" ".join(words[:-1])) == joined(" ".join(own[:-1])):
                alike.setdefault(words[-1], set()).add(own[-1])
                alike.setdefault(own[-1], set()).add(words[-1])
    return front, behind, alike


class Resolver:
    """Resolves values of one kind. ``entries``: ``(id, canonical name, other names)``.

    All paths follow by rule from the entries: each name as one word, its words in any order and form, its initials,
    its first words, and the name with or without what other entries' names show to be optional. ``joins`` has names
    as one word, ``sorts`` words in alphabetical order. Derived paths allow no edits and yield to the names themselves.
    """

    def __init__(self, entries: Iterable[tuple[int, str, Iterable[str]]]) -> None:
        self.joins, self.sorts = Trie(), Trie()
        self.vocabulary: set[str] = set()
        self.named: dict[str, int] = {}
        entries = sorted(entries)
        front, behind, alike = optional_parts(entries)
        first: dict[str, set[int]] = {}
        for entry, name, others in entries:
            words = words_of(tidy(name))
            for n in range(2, len(words)):
                first.setdefault(" ".join(words[:n]), set()).add(entry)
            for i, spelling in enumerate((name, *(others or ()))):
                v = tidy(spelling)
                path, words = joined(v), words_of(v)
                if not path:
                    continue
                self.joins.add(path, entry, allowed_edits(path) if i == 0 or len(path) > 5 else 0, min(i, OTHER))
                self.joins.add(joined("".join(SIGNS.get(c, c) for c in v)), entry, 0, LIKE)
                if len(path) > 2:
                    self.named.setdefault(path, entry)
                for x in behind:
                    self.joins.add(path + x, entry, 0, LIKE)
                    if path.endswith(x) and len(path) - len(x) > 2:
                        self.joins.add(path[: -len(x)], entry, 0, LIKE)
                for x in front:
                    self.joins.add(x + path, entry, 0, LIKE)
                    if path.startswith(x) and len(path) - len(x) > 2:
                        self.joins.add(path[len(x) :], entry, 0, LIKE)
                if len(words) > 1:
                    u = unordered(words)
                    self.sorts.add(u, entry, min(1, allowed_edits(u)), ORDER)
                    for short in initials(words):
                        self.joins.add(joined(short), entry, 0, SHORT)
                        if " " in short:
                            self.sorts.add(unordered(short.split()), entry, 0, SHORT)
                    for w in alike.get(words[-1], ()):
                        self.joins.add(joined(" ".join((*words[:-1], w))), entry, 0, LIKE)
                        self.sorts.add(unordered((*words[:-1], w)), entry, 0, LIKE)
                self.vocabulary.update(w for w in words if w not in FUNCTION_WORDS)
        for start, found in first.items():
            if len(found) == 1:
                self.joins.add(joined(start), *found, 0, LIKE)
        self.extra = {root(w) for w in (*self.vocabulary, *front, *behind)}
        self.resolve = lru_cache(maxsize=1 << 18)(self._resolve)

    def _forms(self, value: str) -> Iterator[str]:
        """Spellings to try, the fullest first."""
        t = tidy(value)
        b = bare(t)
        shorter = [t, b]
        if PLACE.search(b):
            shorter.append(bare(PLACE.sub("", b)))
        if "(" in b or "/" in b:  # a remark in brackets, or a choice
            shorter += [re.sub(r"\([^()]*\)", " ", b).strip(), *(x.strip() for x in b.split("/") if len(x.strip()) > 1)]
        for v in dict.fromkeys(shorter):
            yield from dict.fromkeys((v, VERSION.sub("", v)))

    def _expanded(self, words: list[str]) -> Iterator[list[str]]:
        """The words with abbreviations in full, in all ways (64 at most: a longer value is no name)."""
        ways = [[w] if w in self.vocabulary or w in FUNCTION_WORDS else [w, *sorted(x for x in self.vocabulary if abbreviates(w, x))] for w in words]
        if prod(map(len, ways)) <= 64:
            for way in product(*ways):
                if list(way) != words:
                    yield list(way)

    def candidates(self, value: str) -> list[tuple[int, int, int]]:
        """All ``(distance, rank, entry)`` within reach of any spelling of the value, nearest first."""
        found: set[tuple[int, int, int]] = set()
        for f in self._forms(value):
            path, words = joined(f), words_of(f)
            if path:
                found.update(self.joins.search(path, allowed_edits(path)))
            if 1 < len(words) <= 8:
                u = unordered(words)
                found.update(self.sorts.search(u, min(1, allowed_edits(u))))
                for way in self._expanded(words):
                    found.update((d, max(rank, SHORT), e) for d, rank, e in (*self.sorts.search(unordered(way), 0), *self.joins.search(joined(" ".join(way)), 0)))
            elif words:
                for way in self._expanded(words):
                    found.update((d, max(rank, SHORT), e) for d, rank, e in self.joins.search(joined(" ".join(way)), 0))
        for f in () if found else list(self._forms(value))[1:] or [tidy(value)]:
            words = words_of(f)
            if not found and 1 < len(words) <= 5:
                found.update(self._wider(words))
        return sorted(found)

    def _wider(self, words: list[str]) -> Iterator[tuple[int, int, int]]:
        """Entries whose names are among the words, the widest names only.

        All other words are words of other names; or one other word stands beside a name of several words, or before or
        behind a name of one word that is spelled exactly.
        """
        spare = [root(w) in self.extra for w in words]
        for n in range(1, len(words)):
            found = set()
            for drop in combinations(range(len(words)), n):
                rest = [w for i, w in enumerate(words) if i not in drop]
                known = all(spare[i] for i in drop)
                if known or n == 1 and len(rest) > 1:
                    for path in {joined(" ".join(rest)), root(rest[0]) if len(rest) == 1 else ""}:
                        found.update(e for _, _, e in self.joins.search(path, 0))
                    for way in (rest, *self._expanded(rest)) if len(rest) > 1 else ():
                        found.update(e for _, _, e in self.sorts.search(unordered(way), 0))
                elif n == 1 and rest[0] in self.named:
                    found.add(self.named[rest[0]])
            if found:
                yield from ((0, WIDER, e) for e in found)
                return

    def _resolve(self, value: str) -> int:
        best = self.candidates(value)
        return best[0][2] if best else 0


_LIVE: dict[tuple, Resolver] = {}


def catalog_entries(catalog: DataFrame, most: int = 200_000) -> dict[str, list[tuple[int, str, tuple[str, ...]]]]:
    """The reference list by ``entry_kind``. The driver reads it and sends it to the tasks: more than ``most`` entries are an error."""
    rows = catalog.where(F.col("catalog_id").isNotNull() & F.col("canonical").isNotNull()).select("catalog_id", "entry_kind", "canonical", "other_names").limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"the reference list has more than {most} entries")
    kinds: dict[str, list[tuple[int, str, tuple[str, ...]]]] = {}
    for r in rows:
        kinds.setdefault(r["entry_kind"], []).append((r["catalog_id"], r["canonical"], tuple(x for x in r["other_names"] or () if x)))
    return {k: sorted(v) for k, v in kinds.items()}


def resolve_column(value: Column, entries: list[tuple[int, str, tuple[str, ...]]]) -> Column:
    """The id of the entry that each value means (int), 0 for null, blank or unknown values.

    Nearest name first, then the paths derived least, then the lower id. Tasks keep what they have resolved,
    so a value that repeats costs one lookup.
    """
    key = tuple(entries)

    @F.pandas_udf("int")
    def resolve(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        if key not in _LIVE:
            _LIVE[key] = Resolver(key)
        lookup = _LIVE[key].resolve
        for values in batches:
            yield pd.Series([lookup(v) if v else 0 for v in values], dtype="int32")

    return resolve(value)


def free_values(match_results: DataFrame, vacancies: DataFrame, catalog: DataFrame) -> DataFrame:
    """``field_name, record_id, raw_value, catalog_id`` of every value that is not a canonical name itself.

    Null and empty values are no values; rows with a null id are dropped; a value that repeats in a record, or in
    rows delivered again, comes once. Unknown values have ``catalog_id`` 0. Canonical names are sorted out in the
    JVM before the arrays are exploded; the distinct rows are shuffled once and resolved where they lie.
    """
    kinds = catalog_entries(catalog)
    names = {k: [n for _, n, _ in kinds.get(k, [])] for k in ("skill", "title")}

    def open_values(array: str) -> Column:
        return F.array_distinct(F.filter(F.coalesce(F.col(array), F.array().cast("array<string>")), lambda v: v.isNotNull() & (v != "") & ~v.isin(names["skill"])))

    def named(array: str) -> Column:
        return F.transform(open_values(array), lambda v: F.struct(F.lit(array).alias("field_name"), v.alias("raw_value")))

    fields = F.concat(named("matched_skills"), named("missing_skills"))
    skills = match_results.where(F.col("result_id").isNotNull()).select(F.col("result_id").alias("record_id"), F.inline(fields)).select("field_name", "record_id", "raw_value").distinct()
    titles = vacancies.where(F.col("vacancy_id").isNotNull() & (F.col("job_title") != "") & ~F.col("job_title").isin(names["title"])).select(F.lit("job_title").alias("field_name"), F.col("vacancy_id").alias("record_id"), F.col("job_title").alias("raw_value")).distinct()
    return skills.withColumn("catalog_id", resolve_column(F.col("raw_value"), kinds.get("skill", []))).unionByName(titles.withColumn("catalog_id", resolve_column(F.col("raw_value"), kinds.get("title", []))))
