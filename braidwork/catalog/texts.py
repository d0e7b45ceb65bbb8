"""Queries over single texts: cleaning, sections, figures, checks, terms."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from braidwork.catalog.base import CV, VAC, Tables, count_sql, first_section_sql, has_word_sql, listed_sql, lit, query, strip_sql, words_sql
from braidwork.functions import checks as C
from braidwork.functions import lexicons as X
from braidwork.functions import text as T
from braidwork.operators import matching as K


def _year(n: str) -> str:
    return lit(rf"(?:^|[^\p{{L}}\p{{N}}_]){n}\d{{2}}(?:$|[^\p{{L}}\p{{N}}_])")


def _blank(x: str) -> str:
    once = lit(r"(^|[^\p{L}\p{N}_])\d+($|[^\p{L}\p{N}_])")
    # twice: a delimiter that one match takes is not there for the next
    return f"regexp_replace(regexp_replace({x}, {once}, '\\1 \\2', 'g'), {once}, '\\1 \\2', 'g')"


def _clean_sql(x: str) -> str:
    # protected runs are held together by a letter that no text has
    keep20 = "CASE WHEN y20 THEN regexp_replace(l, '([0-9]*20[0-9]*)', 'ǂ\\1ǂ', 'g') ELSE l END"
    keep = f"CASE WHEN y19 THEN regexp_replace({keep20}, '([0-9]*19[0-9]*)', 'ǂ\\1ǂ', 'g') ELSE {keep20} END"
    return f"""array_to_string(list_transform(list_transform(string_split({x}, chr(10)), lambda r: {{'l': lower(r), 'y19': regexp_matches(lower(r), {_year("19")}), 'y20': regexp_matches(lower(r), {_year("20")})}}),
  lambda s: trim(regexp_replace(regexp_replace(replace({_blank(keep.replace("y20", "s.y20").replace("y19", "s.y19").replace("(l,", "(s.l,").replace("ELSE l ", "ELSE s.l "))}, 'ǂ', ''), {lit(r"[^\p{L}\p{N}_#+@.\-\s\p{Z}]")}, ' ', 'g'), {lit(X.SPACE + "+")}, ' ', 'g'))), chr(10))"""


@query(f"SELECT cv_id, md5(cleaned) AS cleaned_md5, CAST(length(cleaned) AS BIGINT) AS n_chars FROM (SELECT cv_id, {_clean_sql('text')} AS cleaned FROM {CV})")
def q_clean_text(t: Tables) -> DataFrame:
    return t.cv.select("cv_id", T.clean(F.col("text")).alias("c")).select("cv_id", F.md5("c").alias("cleaned_md5"), F.length("c").cast("bigint").alias("n_chars"))


@query(f"SELECT vacancy_id, md5(cleaned) AS cleaned_md5, CAST(length(cleaned) AS BIGINT) AS n_chars FROM (SELECT vacancy_id, {_clean_sql('job_description')} AS cleaned FROM {VAC})")
def q_clean_vacancies(t: Tables) -> DataFrame:
    return t.vac.select("vacancy_id", T.clean(F.col("job_description")).alias("c")).select("vacancy_id", F.md5("c").alias("cleaned_md5"), F.length("c").cast("bigint").alias("n_chars"))


@query("SELECT DISTINCT cv_id, lang FROM cv_data WHERE lower(lang) IN ('en', 'eng', 'english') OR lower(lang) LIKE 'en-%' OR lower(lang) LIKE 'en\\_%' ESCAPE '\\'")
def q_scan_filter_lang(t: Tables) -> DataFrame:
    l = F.lower("lang")
    return t.cv_data.where(l.isin("en", "eng", "english") | l.startswith("en-") | l.startswith("en_")).select("cv_id", "lang").distinct()


@query(f"SELECT cv_id, length(text) AS n_chars FROM {CV} ORDER BY cv_id LIMIT 30")
def q_first_n(t: Tables) -> DataFrame:
    """The first 30 resumes by id: the feature is the limit."""
    return t.cv.orderBy("cv_id").limit(30).select("cv_id", F.length("text").cast("bigint").alias("n_chars"))


def _frequent(lang: str) -> str:
    return f"len(list_filter(w, lambda x: x IN ({', '.join(lit(v) for v in X.FREQUENT_WORDS[lang])})))"


@query(f"""WITH w AS (SELECT cv_id, text, regexp_extract_all(lower(text), '\\p{{L}}+') AS w, length(regexp_replace(lower(text), '[^\\p{{Cyrillic}}]', '', 'g')) AS c, length(regexp_replace(lower(text), '[^\\p{{L}}]', '', 'g')) AS n FROM {CV})
SELECT cv_id, CASE WHEN length({strip_sql('text')}) < 50 THEN 'unknown' WHEN 2 * c > n THEN 'ru' WHEN {_frequent('en')} > 0 AND {_frequent('en')} > greatest({_frequent('de')}, {_frequent('fr')}, {_frequent('es')}, {_frequent('pt')}) THEN 'en' ELSE 'unknown' END AS lang FROM w""")
def q_lang_guess(t: Tables) -> DataFrame:
    return t.cv.select("cv_id", T.guess_language(F.col("text")).alias("lang"))


@query(f"""WITH p AS (SELECT cv_id, list_concat(list_zip(regexp_extract_all(lower(text), {lit(X.PERIOD_DASH)}, 1), regexp_extract_all(lower(text), {lit(X.PERIOD_DASH)}, 2)), list_zip(regexp_extract_all(lower(text), {lit(X.PERIOD_TO)}, 1), regexp_extract_all(lower(text), {lit(X.PERIOD_TO)}, 2))) AS p FROM {CV})
SELECT cv_id, CAST(len(p) AS BIGINT) AS n_periods, array_to_string(list_transform(p, lambda z: z[1] || '-' || CASE WHEN z[2] IN ('now', 'present') THEN '2026' ELSE z[2] END), ',') AS periods FROM p""")
def q_periods(t: Tables) -> DataFrame:
    p = t.cv.select("cv_id", T.periods(F.col("text")).alias("p"))
    return p.select("cv_id", F.size("p").cast("bigint").alias("n_periods"), F.array_join(F.transform("p", lambda z: F.concat_ws("-", z["start"].cast("string"), z["end"].cast("string"))), ",").alias("periods"))


@query(f"SELECT cv_id, {first_section_sql('text', X.SECTION_SKILLS)} AS section FROM {CV}")
def q_section(t: Tables) -> DataFrame:
    return t.cv.select("cv_id", T.first_section(F.col("text"), X.SECTION_SKILLS).alias("section"))


@query(f"SELECT cv_id, {first_section_sql('text', X.SECTION_TECH)} AS section FROM {CV}")
def q_tech_section(t: Tables) -> DataFrame:
    return t.cv.select("cv_id", T.first_section(F.col("text"), X.SECTION_TECH).alias("section"))


@query(f"SELECT vacancy_id, TRY_CAST(nullif(regexp_extract(job_description, {lit(X.REQUIRED_YEARS)}, 1), '') AS INTEGER) AS required_years FROM {VAC}")
def q_required_years(t: Tables) -> DataFrame:
    return t.vac.select("vacancy_id", T.required_years(F.col("job_description")).alias("required_years"))


@query(f"SELECT cv_id, CAST(len({words_sql('text')}) AS BIGINT) AS n_words, regexp_matches(text, {lit(X.EMAIL)}) AS has_email, regexp_matches(text, {lit(X.PHONE)}) AS has_phone FROM {CV}")
def q_word_count(t: Tables) -> DataFrame:
    c = F.col("text")
    return t.cv.select("cv_id", F.size(T.words(c)).cast("bigint").alias("n_words"), c.rlike(X.EMAIL).alias("has_email"), c.rlike(X.PHONE).alias("has_phone"))


_CONTACT = [
    (f"NOT regexp_matches(text, {lit(X.EMAIL)})", "'error:missing_email:'"), (f"NOT regexp_matches(text, {lit(X.PHONE)})", "'warning:missing_phone:'"),
    ("NOT (contains(lower(text), 'linkedin') OR contains(lower(text), 'linked in'))", "'warning:missing_linkedin:'"),
    (f"NOT (regexp_matches(text, {lit(X.LOCATION)}) OR {has_word_sql('text', [x.lower() for x in X.TOWNS])})", "'suggestion:missing_location:'"),
]
_EDUCATION = [
    (f"NOT {has_word_sql('text', X.EDUCATION_WORDS)}", "'warning:missing_education:'"),
    (f"regexp_matches(text, {lit(X.DEGREE_IN)}) AND NOT regexp_matches(text, {lit(X.DEGREE_YEAR)})", "'suggestion:graduation_year:'"),
]
_SKILLS = [(f"contains(lower(text), {lit(x)})", lit(f"suggestion:outdated_tech:{x}")) for x in X.OUTDATED_TECH] + [
    (" AND ".join(f"NOT contains(lower(text), {lit(x)})" for x in X.MODERN_TECH), "'suggestion:modern_tech:'")
]
_TEMPLATE = [(f"{count_sql([f'contains(lower(text), {lit(x)})' for x in X.TEMPLATE_PHRASES])} >= 3", "'warning:template_resume:'")]


def _checked(t: Tables, check) -> DataFrame:
    return t.cv.select("cv_id", C.listed(check(F.col("text"))).alias("issues"))


@query(f"SELECT cv_id, {listed_sql(_CONTACT)} AS issues FROM {CV}")
def q_contact_checks(t: Tables) -> DataFrame:
    return _checked(t, C.contact)


_DATES = f"""(SELECT cv_id, text, list_filter(list_transform(list_filter(list_zip(regexp_extract_all(text, {lit(X.PERIOD_ANY)}, 1), regexp_extract_all(text, {lit(X.PERIOD_ANY)}, 2)), lambda z: regexp_full_match(z[2], '[0-9]{{4}}')), lambda z: {{'a': z[1], 'b': z[2], 'd': CAST(z[2] AS INTEGER) - CAST(z[1] AS INTEGER)}}), lambda y: y.d > 10 OR y.d < 0) AS odd FROM {CV})"""
_DATE_LIST = "array_to_string(list_transform(odd, lambda y: CASE WHEN y.d > 10 THEN 'warning:long_period:' ELSE 'error:date_order:' END || y.a || '-' || y.b), ',')"


@query(f"SELECT cv_id, {_DATE_LIST} AS issues FROM {_DATES}")
def q_date_checks(t: Tables) -> DataFrame:
    return _checked(t, C.dates)


@query(f"SELECT cv_id, {listed_sql(_EDUCATION)} AS issues FROM {CV}")
def q_edu_checks(t: Tables) -> DataFrame:
    return _checked(t, C.education)


@query(f"SELECT cv_id, {listed_sql(_SKILLS)} AS issues FROM {CV}")
def q_skill_checks(t: Tables) -> DataFrame:
    return _checked(t, C.skills)


@query(f"SELECT cv_id, {listed_sql(_TEMPLATE)} AS issues FROM {CV}")
def q_template(t: Tables) -> DataFrame:
    return _checked(t, C.template)


_PARAGRAPHS = f"list_filter(list_transform(string_split(text, chr(10) || chr(10)), lambda p, i: CASE WHEN len({words_sql('p')}) > 100 THEN 'suggestion:long_paragraph:' || i END), lambda x: x IS NOT NULL)"
_BULLETS = "CASE WHEN " + " AND ".join(f"NOT contains(text, {lit(b)})" for b in X.BULLETS) + " THEN ['suggestion:no_bullets:'] ELSE [] END"


@query(f"SELECT cv_id, array_to_string(list_slice(list_concat({_PARAGRAPHS}, {_BULLETS}), 1, 5), ',') AS issues FROM {CV}")
def q_formatting(t: Tables) -> DataFrame:
    return _checked(t, C.formatting)


_ALL = f"concat_ws(',', nullif({listed_sql(_CONTACT)}, ''), nullif({_DATE_LIST}, ''), nullif({listed_sql(_EDUCATION)}, ''), nullif({listed_sql(_SKILLS)}, ''), nullif({listed_sql(_TEMPLATE)}, ''), nullif(array_to_string(list_slice(list_concat({_PARAGRAPHS}, {_BULLETS}), 1, 5), ','), ''))"


@query(f"SELECT split_part(i, ':', 1) AS severity, split_part(i, ':', 2) AS type, count(*) AS n FROM (SELECT unnest(string_split({_ALL}, ',')) AS i FROM {_DATES}) WHERE i <> '' GROUP BY ALL")
def q_issue_counts(t: Tables) -> DataFrame:
    return t.cv.select(F.explode(C.all_checks(F.col("text"))).alias("i")).groupBy("i.severity", "i.type").agg(F.count("*").alias("n"))


@query("SELECT cv_id, coalesce(experience > 10 AND len(list_filter(coalesce(skills, []), lambda s: contains(s, 'python'))) = 0, false) AS mismatch FROM (SELECT DISTINCT cv_id, experience, skills FROM cv_data)")
def q_consistency(t: Tables) -> DataFrame:
    return t.cv_data.select("cv_id", "experience", "skills").distinct().select("cv_id", (F.size(C.consistency(F.col("experience"), F.col("skills"))) > 0).alias("mismatch"))


@query(f"""WITH w AS (SELECT cv_id, text, {words_sql('lower(text)')} AS w FROM {CV}),
c AS (SELECT cv_id, CASE WHEN len(list_filter(list_transform(regexp_split_to_array(text, '[.!?]+'), lambda s: {strip_sql('s')}), lambda s: regexp_matches(s, '^\\p{{Ll}}'))) > 0 THEN 1 ELSE 0 END AS e,
 CASE WHEN regexp_matches(text, '\\s{{2,}}') THEN 1 ELSE 0 END + len(list_filter(range(1, len(w)), lambda i: w[i] = w[i + 1] AND length(w[i]) > 1)) AS wn,
 CASE WHEN contains(lower(text), 'javascript') AND contains(lower(text), 'java script') THEN 1 ELSE 0 END AS s FROM w)
SELECT cv_id, CAST(e AS INTEGER) AS errors, CAST(wn AS INTEGER) AS warnings, CAST(s AS INTEGER) AS suggestions, CAST(greatest(0, 100 - 5 * e - 2 * wn - s) AS INTEGER) AS score FROM c""")
def q_grammar_score(t: Tables) -> DataFrame:
    return t.cv.select("cv_id", C.grammar(F.col("text")).alias("g")).select("cv_id", "g.*")


@query(f"""WITH c AS (SELECT cv_id, len({words_sql('text')}) AS n, {count_sql(["NOT " + has_word_sql("text", [s]) for s in ("experience", "education", "skills")])} AS m, text FROM {CV}),
d AS (SELECT cv_id, n, m, {count_sql(["n < 200", f"NOT regexp_matches(text, {lit(X.EMAIL)})", "m > 0"])} AS i, {count_sql(["n > 1500", f"NOT regexp_matches(text, {lit(X.PHONE)})", "NOT contains(lower(text), 'linkedin')", "len(regexp_extract_all(text, '[0-9]+\\s*[%+-]')) < 2"])} AS s FROM c)
SELECT cv_id, CAST(n AS INTEGER) AS words, CAST(i AS INTEGER) AS issues, CAST(s AS INTEGER) AS suggestions, CAST(m AS INTEGER) AS missing_sections, CAST(greatest(0, 100 - 10 * i - 3 * s) AS INTEGER) AS score FROM d""")
def q_resume_quality(t: Tables) -> DataFrame:
    return t.cv.select("cv_id", C.quality(F.col("text")).alias("q")).select("cv_id", "q.*")


def _found_all(p: str) -> str:
    return f"regexp_extract_all(lower(job_description), {lit(p)}, 1)"


@query(f"""SELECT vacancy_id, {strip_sql(f"regexp_extract(lower(job_description), {lit(X.MUST_LIST)}, 1)")} AS must_have, {strip_sql(f"regexp_extract(lower(job_description), {lit(X.NICE_LIST)}, 1)")} AS nice_to_have,
TRY_CAST(nullif(regexp_extract(lower(job_description), {lit(X.REQUIRED_YEARS)}, 1), '') AS INTEGER) AS years, array_to_string(list_concat({_found_all(X.EDUCATION_IN[0])}, {_found_all(X.EDUCATION_IN[1])}, {_found_all(X.EDUCATION_IN[2])}, {_found_all(X.EDUCATION_IN[3])}, {_found_all(X.EDUCATION_IN[4])}), '|') AS education,
array_to_string(list_transform({_found_all(X.CERTIFIED)}, lambda x: {strip_sql('x')}), '|') AS certifications FROM {VAC}""")
def q_requirements(t: Tables) -> DataFrame:
    low = F.lower("job_description")
    every = lambda p: F.regexp_extract_all(low, F.lit(p), F.lit(1))
    return t.vac.select(
        "vacancy_id", T.strip(F.regexp_extract(low, X.MUST_LIST, 1)).alias("must_have"), T.strip(F.regexp_extract(low, X.NICE_LIST, 1)).alias("nice_to_have"), T.required_years(low).alias("years"),
        F.array_join(F.concat(*[every(p) for p in X.EDUCATION_IN]), "|").alias("education"), F.array_join(F.transform(every(X.CERTIFIED), T.strip), "|").alias("certifications"),
    )


@query(f"""WITH n AS (SELECT catalog_id, canonical, unnest(list_concat([canonical], coalesce(other_names, []))) AS name FROM catalog_entries),
p AS (SELECT DISTINCT vacancy_id, {strip_sql('p')} AS part FROM (SELECT vacancy_id, unnest(regexp_split_to_array(job_description, '[,;•\\n]')) AS p FROM {VAC})),
m AS (SELECT vacancy_id, part, min_by(canonical, catalog_id) AS c FROM (SELECT * FROM p WHERE length(part) > 1) q LEFT JOIN n ON contains(lower(part), lower(name)) GROUP BY ALL)
SELECT vacancy_id, coalesce(c, part) AS skill FROM m GROUP BY ALL""")
def q_skills_from_text(t: Tables) -> DataFrame:
    """Parts of a text by the first entry of a reference list that occurs in them, else as they stand."""
    parts = t.vac.select("vacancy_id", F.explode(F.split("job_description", "[,;•\n]")).alias("p")).select("vacancy_id", T.strip(F.col("p")).alias("part")).where(F.length("part") > 1).distinct()
    entries = K.reference_names(t.catalog_entries.where("catalog_id IS NOT NULL AND canonical IS NOT NULL").select("catalog_id", "canonical", "other_names"))
    first = K.first_named(F.col("part"), entries)
    return parts.select("vacancy_id", F.coalesce(first, "part").alias("skill")).distinct()


@query(f"SELECT vacancy_id, {listed_sql([(f'contains(lower(job_description), {lit(s)})', lit(s)) for s in X.SOFT_SKILLS])} AS soft_skills FROM {VAC}")
def q_soft_skills(t: Tables) -> DataFrame:
    return t.vac.select("vacancy_id", F.array_join(T.contained(F.lower("job_description"), X.SOFT_SKILLS), ",").alias("soft_skills"))


_PREPARED = r"regexp_replace(CASE WHEN length(text) > 2000 THEN left(text, 1000) || ' ' || right(text, 1000) ELSE text END, '\s+', ' ', 'g')"


@query(f"SELECT cv_id, md5(p) AS prepared_md5, CAST(length(p) AS BIGINT) AS n_chars FROM (SELECT cv_id, {strip_sql(_PREPARED)} AS p FROM {CV})")
def q_prepare_text(t: Tables) -> DataFrame:
    p = t.cv.select("cv_id", T.prepare(F.col("text")).alias("p"))
    return p.select("cv_id", F.md5("p").alias("prepared_md5"), F.length("p").cast("bigint").alias("n_chars"))


_SECTIONS = "list_filter([" + ", ".join(strip_sql(f"regexp_extract(text, {lit(p)}, 1)") for p in X.SECTION_CHUNKS) + "], lambda s: length(s) > 50)"
_PARAS = f"list_filter(list_transform(string_split(text, chr(10) || chr(10)), lambda p: {strip_sql('p')}), lambda p: length(p) > 100)"


@query(f"SELECT cv_id, CAST(len(c) AS BIGINT) AS n_chunks, md5(array_to_string(c, '|')) AS chunks_md5 FROM (SELECT cv_id, list_slice(CASE WHEN len({_SECTIONS}) > 0 THEN {_SECTIONS} ELSE {_PARAS} END, 1, 10) AS c FROM {CV})")
def q_chunks(t: Tables) -> DataFrame:
    c = t.cv.select("cv_id", T.chunks(F.col("text")).alias("c"))
    return c.select("cv_id", F.size("c").cast("bigint").alias("n_chunks"), F.md5(F.array_join("c", "|")).alias("chunks_md5"))


_LONG = f"list_filter(list_transform(regexp_split_to_array(text, '[.!?]+'), lambda x: {strip_sql('x')}), lambda x: length(x) > 20)"


@query(f"SELECT cv_id, left(CASE WHEN len(s) <= 10 THEN text ELSE array_to_string(list_slice(s, 1, 10), '. ') || '.' END, 2000) AS summary FROM (SELECT cv_id, text, {_LONG} AS s FROM {CV})")
def q_summary(t: Tables) -> DataFrame:
    return t.cv.select("cv_id", T.summary(F.col("text")).alias("summary"))


_RAW = "CASE WHEN length(text) < 100 THEN text WHEN len(regexp_split_to_array(text, '[.!?]+')) > 10 THEN array_to_string(list_slice(regexp_split_to_array(text, '[.!?]+'), 1, 10), '. ') || '.' ELSE left(text, 1000) END"


@query(f"SELECT cv_id, {_RAW} AS summary FROM {CV}")
def q_fallback_summary(t: Tables) -> DataFrame:
    return t.cv.select("cv_id", T.raw_summary(F.col("text")).alias("summary"))


_BARE = f"list_transform(string_split(text, chr(10)), lambda l: lower({strip_sql('l')}))"
_HEADS = "[" + ", ".join(lit(h) for h in X.EXPERIENCE_HEADERS) + "]"
_STOPS = "[" + ", ".join(lit(h) for h in X.STOP_HEADERS) + "]"
_SECTION = f"""(SELECT cv_id, text, CASE WHEN s IS NULL THEN '' ELSE array_to_string(list_filter(list_slice(l, s + 1, coalesce(s + e - 1, len(l))), lambda x: {strip_sql('x')} <> ''), chr(10)) END AS section FROM
(SELECT *, list_min(list_filter(list_transform({_STOPS}, lambda h: list_position(list_slice(b, s + 1, len(b)), h)), lambda x: x IS NOT NULL AND x > 0)) AS e FROM
(SELECT *, list_min(list_filter(list_transform({_HEADS}, lambda h: list_position(b, h)), lambda x: x IS NOT NULL AND x > 0)) AS s FROM (SELECT cv_id, text, string_split(text, chr(10)) AS l, {_BARE} AS b FROM {CV}))))"""


@query(f"SELECT cv_id, md5(section) AS section_md5, CAST(length(section) AS BIGINT) AS n_chars FROM {_SECTION}")
def q_experience_section(t: Tables) -> DataFrame:
    s = t.cv.select("cv_id", T.experience_section(F.col("text")).alias("s"))
    return s.select("cv_id", F.md5("s").alias("section_md5"), F.length("s").cast("bigint").alias("n_chars"))


def _explicit_sql(x: str) -> str:
    tight = rf"regexp_replace({x}, '\s+([-–—])', '\1', 'g')"
    case = []
    for p in X.EXPLICIT_YEARS:
        n = f"regexp_extract({x}, {lit(p)}, 1)"
        case.append(f"WHEN {n} <> '' AND NOT (contains({tight}, {n} || '-') OR contains({tight}, {n} || '–') OR contains({tight}, {n} || '—')) THEN TRY_CAST({n} AS DOUBLE)")
    return "CASE " + " ".join(case) + " ELSE 0.0::DOUBLE END"


@query(f"SELECT cv_id, {_explicit_sql('text')} AS years FROM {CV}")
def q_explicit_years(t: Tables) -> DataFrame:
    return t.cv.select("cv_id", T.explicit_years(F.col("text")).alias("years"))


@query(f"SELECT DISTINCT rank_no, list_extract([{', '.join(lit(m) for m in X.MONTHS)}], least(12, greatest(1, rank_no))) AS month FROM annotations WHERE rank_no IS NOT NULL")
def q_month_name(t: Tables) -> DataFrame:
    return t.annotations.where("rank_no IS NOT NULL").select("rank_no").distinct().withColumn("month", T.month_name(F.col("rank_no")))


def _tech_sql(term: str, x: str = "lower(text)") -> str:
    quoted = "".join("\\" + c if not c.isalnum() and c not in " _" else c for c in term)
    word = has_word_sql(x, [term]) if term[-1].isalnum() else f"regexp_matches({x}, {lit(rf'(?:^|[^\p{{L}}\p{{N}}_]){quoted}{X.W}')})"
    return f"(contains({x}, {lit(term)}) AND ({word} OR regexp_matches({x}, {lit(rf'(?:^|[\s,;]){quoted}(?:$|[\s,;])')})))"


def _category_sql(term: str, x: str = "lower(text)") -> str:
    quoted = "".join("\\" + c if not c.isalnum() and c not in " _" else c for c in term)
    word = has_word_sql(x, [term]) if term[-1].isalnum() else f"regexp_matches({x}, {lit(rf'(?:^|[^\p{{L}}\p{{N}}_]){quoted}{X.W}')})"
    if " " in term:
        word += f" OR contains({x}, {lit(term)})"
    if term == "springboot":
        word += f" OR contains({x}, 'spring boot')"
    return f"({word})"


@query(f"SELECT cv_id, {listed_sql([(_tech_sql(s), lit(s)) for s in X.TECH_TERMS])} AS skills FROM {CV}")
def q_tech_skills(t: Tables) -> DataFrame:
    return t.cv.select("cv_id", F.array_join(T.tech_skills(F.col("text")), ",").alias("skills"))


@query("SELECT cv_id, " + ", ".join(f"{listed_sql([(_category_sql(s), lit(s)) for s in terms])} AS {name}" for name, terms in X.CATEGORIES.items()) + f" FROM {CV}")
def q_category_skills(t: Tables) -> DataFrame:
    return t.cv.select("cv_id", *[F.array_join(T.category_skills(F.col("text"), c), ",").alias(c) for c in X.CATEGORIES])


@query(f"""WITH w AS (SELECT cv_id, w, i FROM (SELECT cv_id, unnest(l) AS w, generate_subscripts(l, 1) AS i FROM (SELECT cv_id, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]+') AS l FROM {CV})) WHERE regexp_full_match(w, '[a-z]{{3,}}') AND w NOT IN ({', '.join(lit(s) for s in X.KEYWORD_STOP_WORDS)})),
c AS (SELECT cv_id, w AS keyword, count(*) AS n, min(i) AS first FROM w GROUP BY ALL)
SELECT cv_id, keyword, n, CAST(place AS INTEGER) AS place FROM (SELECT *, row_number() OVER (PARTITION BY cv_id ORDER BY n DESC, first) AS place FROM c) WHERE place <= 10""")
def q_top_keywords(t: Tables) -> DataFrame:
    from braidwork.operators.terms import top_keywords

    return top_keywords(t.cv, "cv_id", "text", 10)


@query(f"SELECT cv_id, array_to_string(list_sort(list_distinct(list_filter(list_slice(regexp_extract_all(text, {lit(X.ENTITY)}, 1), 1, 20), lambda e: length(e) > 2 AND lower(e) NOT IN ({', '.join(lit(s) for s in X.KEYWORD_STOP_WORDS)})))), '|') AS entities FROM {CV}")
def q_entities(t: Tables) -> DataFrame:
    e = F.filter(F.slice(F.regexp_extract_all("text", F.lit(X.ENTITY), F.lit(1)), 1, 20), lambda x: (F.length(x) > 2) & ~F.lower(x).isin(*X.KEYWORD_STOP_WORDS))
    return t.cv.select("cv_id", F.array_join(F.array_sort(F.array_distinct(e)), "|").alias("entities"))


@query(f"SELECT cv_id, CAST(len(d) AS BIGINT) AS dates_found, array_to_string(d, '|') AS mentions FROM (SELECT cv_id, regexp_extract_all(text, {lit(X.DATE_MENTION)}) AS d FROM {CV})")
def q_date_mentions(t: Tables) -> DataFrame:
    d = t.cv.select("cv_id", F.regexp_extract_all("text", F.lit(X.DATE_MENTION), F.lit(0)).alias("d"))
    return d.select("cv_id", F.size("d").cast("bigint").alias("dates_found"), F.array_join("d", "|").alias("mentions"))


@query(f"""WITH k AS (SELECT cv_id, w, min(i) AS first, count(*) AS n FROM (SELECT cv_id, unnest(l) AS w, generate_subscripts(l, 1) AS i FROM (SELECT cv_id, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]+') AS l FROM {CV})) WHERE regexp_full_match(w, '[a-z]{{3,}}') AND w NOT IN ({', '.join(lit(s) for s in X.KEYWORD_STOP_WORDS)}) GROUP BY ALL),
l AS (SELECT cv_id, string_agg(w, ' ' ORDER BY n DESC, first) AS kw FROM (SELECT *, row_number() OVER (PARTITION BY cv_id ORDER BY n DESC, first) AS p FROM k) WHERE p <= 10 GROUP BY cv_id)
SELECT cv_id, {_RAW} || ' ' || coalesce(kw, '') AS prepared FROM {CV} LEFT JOIN l USING (cv_id)""")
def q_kw_summary(t: Tables) -> DataFrame:
    from braidwork.operators.terms import top_keywords

    top = top_keywords(t.cv, "cv_id", "text", 10).groupBy("cv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "keyword"))), lambda x: x["keyword"]), " ").alias("kw"))
    return t.cv.join(top, "cv_id", "left").select("cv_id", F.concat_ws(" ", T.raw_summary(F.col("text")), F.coalesce("kw", F.lit(""))).alias("prepared"))


_ENTITIES = f"list_filter(list_slice(regexp_extract_all(text, {lit(X.ENTITY)}, 1), 1, 20), lambda e: length(e) > 2 AND lower(e) NOT IN ({', '.join(lit(s) for s in X.KEYWORD_STOP_WORDS)}))"


@query(f"SELECT cv_id, {_RAW} || ' ' || array_to_string(list_slice({_ENTITIES}, 1, 10), ' ') AS prepared FROM {CV}")
def q_ne_summary(t: Tables) -> DataFrame:
    """The summary with the first ten named entities after it."""
    e = F.filter(F.slice(F.regexp_extract_all("text", F.lit(X.ENTITY), F.lit(1)), 1, 20), lambda x: (F.length(x) > 2) & ~F.lower(x).isin(*X.KEYWORD_STOP_WORDS))
    return t.cv.select("cv_id", F.concat_ws(" ", T.raw_summary(F.col("text")), F.array_join(F.slice(e, 1, 10), " ")).alias("prepared"))
