"""Document checks: issues as ``array<struct<type,severity,detail>>`` columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from braidwork.functions import lexicons as X
from braidwork.functions.text import contained, has_word, let, strip, words

ISSUE = "array<struct<type:string,severity:string,detail:string>>"


def _issue(kind: str, severity: str, detail: Column | None = None) -> Column:
    return F.struct(F.lit(kind).alias("type"), F.lit(severity).alias("severity"), (F.lit("") if detail is None else detail).alias("detail"))


def _issues(*cases: tuple[Column, str, str]) -> Column:
    return F.array_compact(F.array(*[F.when(cond, _issue(kind, severity)) for cond, kind, severity in cases]))


def contact(text: Column) -> Column:
    low = F.lower(text)
    place = text.rlike(X.LOCATION) | has_word(text, [t.lower() for t in X.TOWNS])
    return _issues(
        (~text.rlike(X.EMAIL), "missing_email", "error"), (~text.rlike(X.PHONE), "missing_phone", "warning"),
        (~(low.contains("linkedin") | low.contains("linked in")), "missing_linkedin", "warning"), (~place, "missing_location", "suggestion"),
    )


def dates(text: Column, as_of: int | None = None) -> Column:
    """Periods of more than ten years or with the end before the start; with ``as_of`` also future and old years."""
    starts, ends = F.regexp_extract_all(text, F.lit(X.PERIOD_ANY), F.lit(1)), F.regexp_extract_all(text, F.lit(X.PERIOD_ANY), F.lit(2))
    closed = F.filter(F.arrays_zip(starts.alias("a"), ends.alias("b")), lambda z: z["b"].rlike(r"^\d{4}$"))
    years = F.transform(closed, lambda z: F.struct(z["a"].alias("a"), z["b"].alias("b"), (z["b"].cast("int") - z["a"].cast("int")).alias("d")))
    odd = F.filter(years, lambda y: (y["d"] > 10) | (y["d"] < 0))
    found = F.transform(odd, lambda y: F.when(y["d"] > 10, _issue("long_period", "warning", F.concat(y["a"], F.lit("-"), y["b"]))).otherwise(_issue("date_order", "error", F.concat(y["a"], F.lit("-"), y["b"]))))
    if as_of is None:
        return found
    named = F.transform(F.regexp_extract_all(text, F.lit(r"(?:^|[^\p{L}\p{N}_])((?:19|20)\d{2})"), F.lit(1)), lambda y: y.cast("int"))
    return F.concat(found, _issues((F.exists(named, lambda y: y > as_of), "future_date", "error"), (F.exists(named, lambda y: (y < as_of - 20) & (y > 1970)), "old_date", "warning")))


def education(text: Column) -> Column:
    return _issues((~has_word(text, X.EDUCATION_WORDS), "missing_education", "warning"), (text.rlike(X.DEGREE_IN) & ~text.rlike(X.DEGREE_YEAR), "graduation_year", "suggestion"))


def skills(text: Column) -> Column:
    low = F.lower(text)
    old = F.transform(contained(low, X.OUTDATED_TECH), lambda t: _issue("outdated_tech", "suggestion", t))
    return F.concat(old, _issues((F.size(contained(low, X.MODERN_TECH)) == 0, "modern_tech", "suggestion")))


def template(text: Column) -> Column:
    return _issues((F.size(contained(F.lower(text), X.TEMPLATE_PHRASES)) >= 3, "template_resume", "warning"))


def formatting(text: Column, most: int = 5) -> Column:
    """One suggestion per paragraph of more than 100 words, one if no bullet occurs; the first ``most`` of them."""
    long = F.filter(F.transform(F.split(text, "\n\n"), lambda p, i: F.when(F.size(words(p)) > 100, _issue("long_paragraph", "suggestion", (i + 1).cast("string")))), lambda x: x.isNotNull())
    return F.slice(F.concat(long, _issues((F.size(contained(text, X.BULLETS)) == 0, "no_bullets", "suggestion"))), 1, most)


def all_checks(text: Column) -> Column:
    return F.concat(contact(text), dates(text), education(text), skills(text), template(text), formatting(text))


def consistency(experience: Column, skill_list: Column) -> Column:
    return _issues((F.coalesce((experience > 10) & ~F.exists(F.coalesce(skill_list, F.array().cast("array<string>")), lambda s: s.contains("python")), F.lit(False)), "skill_experience_mismatch", "warning"))


def grammar(text: Column) -> Column:
    """Struct of error, warning and suggestion counts and the score ``max(0, 100 - 5e - 2w - s)``."""
    low = F.lower(text)
    twice = let(words(low), lambda w: F.size(F.filter(F.zip_with(w, F.slice(w, 2, F.greatest(F.size(w), F.lit(1))), lambda a, b: (a == b) & (F.length(a) > 1)), lambda x: x)))
    errors = F.exists(F.transform(F.split(text, r"[.!?]+"), strip), lambda s: s.rlike(r"^\p{Ll}")).cast("int")
    warnings = text.rlike(r"\s{2,}").cast("int") + twice
    hints = (low.contains("javascript") & low.contains("java script")).cast("int")
    counts = F.struct(errors.alias("e"), warnings.alias("w"), hints.alias("s"))
    return let(counts, lambda c: F.struct(c["e"].alias("errors"), c["w"].alias("warnings"), c["s"].alias("suggestions"), F.greatest(F.lit(0), 100 - 5 * c["e"] - 2 * c["w"] - c["s"]).alias("score")))


def languagetool_score(errors: Column, warnings: Column, suggestions: Column, n_words: Column) -> Column:
    """``100 - (e + 0.5 w + 0.2 s) * 100 / words``, within 0..100, to one digit; 100 without words."""
    raw = 100 - F.coalesce(F.try_divide((errors + 0.5 * warnings + 0.2 * suggestions) * 100, n_words), F.lit(0.0))
    return F.round(F.greatest(F.lit(0.0), F.least(F.lit(100.0), raw)), 1)


def quality(text: Column) -> Column:
    """Struct of issue and suggestion counts and the score ``max(0, 100 - 10 i - 3 s)``."""
    n = F.size(words(text))
    low = F.lower(text)
    missing = sum((F.when(has_word(text, [s]), 0).otherwise(1) for s in ("education", "skills")), F.when(has_word(text, ["experience"]), 0).otherwise(1))
    issues = (n < 200).cast("int") + (~text.rlike(X.EMAIL)).cast("int") + (missing > 0).cast("int")
    figures = F.size(F.regexp_extract_all(text, F.lit(r"(\d+\s*[%+\-])"), F.lit(1)))
    hints = (n > 1500).cast("int") + (~text.rlike(X.PHONE)).cast("int") + (~low.contains("linkedin")).cast("int") + (figures < 2).cast("int")
    return F.struct(n.alias("words"), issues.alias("issues"), hints.alias("suggestions"), missing.alias("missing_sections"), F.greatest(F.lit(0), 100 - 10 * issues - 3 * hints).alias("score"))


def listed(issues: Column) -> Column:
    """Issues as one readable line."""
    return F.array_join(F.transform(issues, lambda i: F.concat_ws(":", i["severity"], i["type"], i["detail"])), ",")
