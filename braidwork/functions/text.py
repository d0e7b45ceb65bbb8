"""Text cleaning, sections and figures as Spark columns. Null in, null out, unless stated."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from braidwork.functions import lexicons as X


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once: inlined expressions would repeat it wherever it is used."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def strip(c: Column) -> Column:
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def words(c: Column) -> Column:
    """The text's runs of characters that are no white space."""
    return F.filter(F.split(c, r"\s+"), lambda w: w != "")


def has_word(text: Column, alternatives: Sequence[str]) -> Column:
    """Whether one of the literal alternatives stands as a word of its own in the lower-cased text."""
    names = "|".join(_quote(a) for a in alternatives)
    return F.lower(text).rlike(rf"(?:^|[^\p{{L}}\p{{N}}_])(?:{names})(?:$|[^\p{{L}}\p{{N}}_])")


def _quote(s: str) -> str:
    return "".join("\\" + c if not c.isalnum() and c not in " _" else c for c in s)


def found(text: Column, terms: Sequence[str], test) -> Column:
    """The terms that pass ``test(text, term)``, in order."""
    return F.array_compact(F.array(*[F.when(test(text, t), F.lit(t)) for t in terms]))


def contained(lowered: Column, terms: Sequence[str]) -> Column:
    return found(lowered, terms, lambda t, x: t.contains(x))


def first_section(text: Column, patterns: Sequence[str]) -> Column:
    """Group 1 of the first pattern that matches, stripped; empty if none does."""
    out = F.lit("")
    for p in reversed(patterns):
        out = F.when(text.rlike(p), strip(F.regexp_extract(text, p, 1))).otherwise(out)
    return F.when(text.isNotNull(), out)


def clean(text: Column, remove_numbers: bool = True) -> Column:
    """Lower-cased lines of letters, digits and ``_#+@.-`` with single spaces.

    Whole-word digit runs are blanked. On a line that names a year 19xx (20xx), runs that hold 19 (20) stay.
    """
    edge = r"(?<![\p{L}\p{N}_])%s\d+(?![\p{L}\p{N}_])"

    def line(raw: Column) -> Column:
        return let(F.lower(raw), cleaned)

    def cleaned(l: Column) -> Column:
        if remove_numbers:
            year = r"(?<![\p{L}\p{N}_])%s\d{2}(?![\p{L}\p{N}_])"
            y19, y20 = l.rlike(year % "19"), l.rlike(year % "20")
            l = (
                F.when(y19 & y20, F.regexp_replace(l, edge % r"(?!\d*(?:19|20))", " "))
                .when(y20, F.regexp_replace(l, edge % r"(?!\d*20)", " "))
                .when(y19, F.regexp_replace(l, edge % r"(?!\d*19)", " "))
                .otherwise(F.regexp_replace(l, edge % "", " "))
            )
        l = F.regexp_replace(l, rf"[^\p{{L}}\p{{N}}_#+@.\-\s\p{{Z}}]", " ")
        return F.trim(F.regexp_replace(l, X.SPACE + "+", " "))

    return F.array_join(F.transform(F.split(text, "\n"), line), "\n")


def periods(text: Column, as_of: int = 2026) -> Column:
    """``array<struct<start,end>>`` of ``2017 - 2020``, ``2020 to now``; an open end is ``as_of``; dashes first."""
    low = F.lower(text)

    def pairs(p: str) -> Column:
        return F.transform(
            F.arrays_zip(F.regexp_extract_all(low, F.lit(p), F.lit(1)).alias("a"), F.regexp_extract_all(low, F.lit(p), F.lit(2)).alias("b")),
            lambda z: F.struct(z["a"].cast("int").alias("start"), F.when(z["b"].rlike(r"^\d+$"), z["b"].cast("int")).otherwise(F.lit(as_of)).alias("end")),
        )

    return F.concat(pairs(X.PERIOD_DASH), pairs(X.PERIOD_TO))


def required_years(description: Column) -> Column:
    """Years of the first ``N years of experience``, or null."""
    return F.nullif(F.regexp_extract(description, X.REQUIRED_YEARS, 1), F.lit("")).try_cast("int")


def explicit_years(text: Column) -> Column:
    """Years of the first of five forms that matches with a number that no dash follows anywhere; else 0."""
    out = F.lit(0.0)
    for p in reversed(X.EXPLICIT_YEARS):
        n = F.regexp_extract(text, p, 1)
        dash = F.exists(F.array(*[F.lit(d) for d in "-–—"]), lambda d: F.regexp_replace(text, r"\s+(?=[-–—])", "").contains(F.concat(n, d)))
        out = F.when((n != "") & ~dash, n.try_cast("double")).otherwise(out)
    return out


def experience_section(text: Column) -> Column:
    """Lines after the first experience header up to a header of another section, without blank lines."""
    def first(bare: Column, names: Sequence[str]) -> Column:
        return F.array_min(F.transform(F.array(*[F.lit(h) for h in names]), lambda h: F.nullif(F.array_position(bare, h), F.lit(0).cast("bigint")))).cast("int")

    def bare(lines: Column) -> Column:
        return F.transform(lines, lambda l: F.lower(strip(l)))

    def up_to_stop(rest: Column) -> Column:
        kept = let(first(bare(rest), X.STOP_HEADERS), lambda stop: F.slice(rest, 1, F.coalesce(stop - 1, F.size(rest))))
        return F.array_join(F.filter(kept, lambda l: strip(l) != ""), "\n")

    def from_start(lines: Column) -> Column:
        return let(first(bare(lines), X.EXPERIENCE_HEADERS), lambda start: F.when(start.isNull(), F.lit("")).otherwise(let(F.slice(lines, start + 1, F.size(lines)), up_to_stop)))

    return let(F.split(text, "\n"), from_start)


def work_periods(section: Column, as_of: int = 2026) -> Column:
    """Distinct ``struct<start,end>`` of all work-period forms in a section."""
    parts = []
    for p, a, b in X.WORK_PERIODS:
        starts, ends = F.regexp_extract_all(section, F.lit(p), F.lit(a)), F.regexp_extract_all(section, F.lit(p), F.lit(b))
        parts.append(F.transform(F.arrays_zip(starts.alias("a"), ends.alias("b")), lambda z: F.struct(z["a"].cast("int").alias("start"), F.when(z["b"].rlike(r"^\d+$"), z["b"].cast("int")).otherwise(F.lit(as_of)).alias("end"))))
    return F.array_distinct(F.concat(*parts))


def merged_years(periods: Column, tolerance: int = 0) -> Column:
    """Years covered by the union of periods: sorted, joined where one starts by ``tolerance`` after the last end."""
    zero = F.struct(F.lit(None).cast("int").alias("s"), F.lit(None).cast("int").alias("e"), F.lit(0).alias("sum"))

    def step(acc: Column, p: Column) -> Column:
        joins = p["start"] <= acc["e"] + tolerance
        return (
            F.when(acc["s"].isNull(), F.struct(p["start"].alias("s"), p["end"].alias("e"), acc["sum"].alias("sum")))
            .when(joins, F.struct(acc["s"].alias("s"), F.greatest(acc["e"], p["end"]).alias("e"), acc["sum"].alias("sum")))
            .otherwise(F.struct(p["start"].alias("s"), p["end"].alias("e"), (acc["sum"] + acc["e"] - acc["s"]).alias("sum")))
        )

    return F.aggregate(F.array_sort(periods), zero, step, lambda a: a["sum"] + F.coalesce(a["e"] - a["s"], F.lit(0)))


def experience(text: Column, as_of: int = 2026) -> Column:
    """Years of experience: the union of the experience section's periods, or explicit years without a section."""
    return let(experience_section(text), lambda s: F.when(s == "", explicit_years(text)).otherwise(merged_years(work_periods(s, as_of)).cast("double")))


def prepare(text: Column, most: int = 2000) -> Column:
    """Head and tail of a long text, white space collapsed."""
    cut = F.when(F.length(text) > most, F.concat(F.substring(text, 1, most // 2), F.lit(" "), F.substring(text, -(most // 2), most // 2))).otherwise(text)
    return strip(F.regexp_replace(cut, r"\s+", " "))


def chunks(text: Column, most: int = 10) -> Column:
    """Sections of more than 50 characters; without one, paragraphs of more than 100; at most ``most``."""
    sections = F.filter(F.array(*[strip(F.regexp_extract(text, p, 1)) for p in X.SECTION_CHUNKS]), lambda s: F.length(s) > 50)
    paragraphs = F.filter(F.transform(F.split(text, "\n\n"), strip), lambda s: F.length(s) > 100)
    return F.slice(F.when(F.size(sections) > 0, sections).otherwise(paragraphs), 1, most)


def summary(text: Column, sentences: int = 10, most: int = 2000) -> Column:
    """The first sentences of more than 20 characters; a text of no more sentences is cut at ``most``."""
    s = F.filter(F.transform(F.split(text, r"[.!?]+"), strip), lambda x: F.length(x) > 20)
    return F.substring(let(s, lambda a: F.when(F.size(a) <= sentences, text).otherwise(F.concat(F.array_join(F.slice(a, 1, sentences), ". "), F.lit(".")))), 1, most)


def raw_summary(text: Column, sentences: int = 10) -> Column:
    """The first raw sentences, or the first 1000 characters of a text with no more; short texts unchanged."""
    s = F.split(text, r"[.!?]+")
    return F.when(F.length(text) < 100, text).when(F.size(s) > sentences, F.concat(F.array_join(F.slice(s, 1, sentences), ". "), F.lit("."))).otherwise(F.substring(text, 1, 1000))


def tech_skills(text: Column) -> Column:
    """Technical terms as words, or between blanks, commas and semicolons."""
    low = F.lower(text)

    def test(t: Column, term: str) -> Column:
        quoted = _quote(term)
        as_word = has_word(t, [term]) if term[-1].isalnum() else t.rlike(rf"(?:^|[^\p{{L}}\p{{N}}_]){quoted}{X.W}")
        return t.contains(term) & (as_word | t.rlike(rf"(?:^|[\s,;]){quoted}(?:$|[\s,;])"))

    return let(low, lambda l: found(l, X.TECH_TERMS, test))


def category_skills(text: Column, category: str) -> Column:
    """Terms of a category as words; phrases also inside words; none for unknown categories."""
    low = F.lower(text)

    def test(t: Column, term: str) -> Column:
        quoted = _quote(term)
        as_word = t.contains(term) & (has_word(t, [term]) if term[-1].isalnum() else t.rlike(rf"(?:^|[^\p{{L}}\p{{N}}_]){quoted}{X.W}"))
        return as_word | (t.contains(term) if " " in term else F.lit(False)) | (t.contains("spring boot") if term == "springboot" else F.lit(False))

    terms = X.CATEGORIES.get(category, ())
    return let(low, lambda l: found(l, terms, test)) if terms else F.array().cast("array<string>")


def month_name(n: Column) -> Column:
    return F.element_at(F.array(*[F.lit(m) for m in X.MONTHS]), F.least(F.lit(12), F.greatest(F.lit(1), n)))


def guess_language(text: Column, least: int = 50) -> Column:
    """``en``, ``ru`` or ``unknown``, by the share of Cyrillic letters and by frequent words."""
    def choose(low: Column) -> Column:
        tokens = F.regexp_extract_all(low, F.lit(r"(\p{L}+)"), F.lit(1))
        n = let(tokens, lambda t: F.struct(*[F.size(F.filter(t, _in(ws))).alias(lang) for lang, ws in X.FREQUENT_WORDS.items()]))
        cyrillic = F.length(F.regexp_replace(low, r"[^\p{IsCyrillic}]", ""))
        letters = F.length(F.regexp_replace(low, r"[^\p{L}]", ""))
        english = let(n, lambda c: (c["en"] > 0) & (c["en"] > F.greatest(c["de"], c["fr"], c["es"], c["pt"])))
        return F.when(2 * cyrillic > letters, "ru").when(english, "en").otherwise("unknown")

    return F.when(text.isNull() | (F.length(strip(text)) < least), "unknown").otherwise(let(F.lower(text), choose))


def _in(ws: Sequence[str]):
    return lambda w: w.isin(*ws)
