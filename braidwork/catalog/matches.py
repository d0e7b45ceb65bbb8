"""Queries over terms, vectors and skill matches of documents and scored pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from braidwork.catalog import ORACLE
from braidwork.catalog.base import CV, VAC, Tables, lit, query, rnd_sql
from braidwork.catalog.ranks import PAIRS
from braidwork.catalog.texts import _tech_sql
from braidwork.functions import lexicons as X
from braidwork.functions import text as T
from braidwork.operators import matching as K
from braidwork.operators import ranking as R
from braidwork.operators import semantic as S
from braidwork.operators import terms as G
from braidwork.operators.pairs import scored_pairs
from braidwork.session import materialize

_STOP = ", ".join(lit(s) for s in X.STOP_WORDS)
#: ``kind, id, text`` of both sides: one corpus.
DOCS = f"(SELECT 'cv' AS kind, cv_id AS id, text FROM {CV} UNION ALL SELECT 'vacancy', vacancy_id, job_description FROM {VAC})"
TOKENS = f"(SELECT kind, id, list_filter(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]{{2,}}'), lambda w: w NOT IN ({_STOP})) AS w FROM {DOCS})"
GRAMS = f"(SELECT kind, id, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS term FROM {TOKENS})"
TF = f"(SELECT kind, id, term, count(*) AS tf FROM {GRAMS} GROUP BY ALL)"
VOCAB = f"(SELECT term, sum(tf) AS corpus_tf, count(*) AS df FROM {TF} GROUP BY term ORDER BY corpus_tf DESC, term LIMIT 1000)"
PAIR_IDS = "(SELECT DISTINCT cv_id, vacancy_id FROM match_results WHERE cv_id IS NOT NULL AND vacancy_id IS NOT NULL)"
#: Pairs whose texts are both known.
TEXT_PAIRS = f"(SELECT cv_id, vacancy_id FROM {PAIR_IDS} SEMI JOIN {CV} USING (cv_id) SEMI JOIN {VAC} USING (vacancy_id))".replace("SEMI JOIN (", "SEMI JOIN (")


def _weights_sql(sublinear: bool) -> str:
    tf = "1 + ln(tf)" if sublinear else "tf"
    return f"""(SELECT kind, id, term, x / sqrt(sum(x * x) OVER (PARTITION BY kind, id)) AS w FROM (SELECT kind, id, term, ({tf}) * (ln((1.0 + (SELECT count(*) FROM {DOCS})) / (1.0 + df)) + 1.0) AS x FROM {TF} JOIN {VOCAB} USING (term)))"""


def docs(t: Tables) -> DataFrame:
    cv = t.cv.select(F.lit("cv").alias("kind"), F.col("cv_id").alias("id"), "text")
    return cv.unionByName(t.vac.select(F.lit("vacancy").alias("kind"), F.col("vacancy_id").alias("id"), F.col("job_description").alias("text")))


def counts(t: Tables) -> DataFrame:
    return G.term_counts(docs(t), ["kind", "id"], G.word_ngrams(F.col("text")))


def weights(t: Tables, sublinear: bool = True) -> DataFrame:
    """TF-IDF of both sides over one corpus and its 1000 most frequent terms."""
    c = materialize(counts(t), "counts")
    return materialize(G.tfidf(c, ["kind", "id"], docs(t).count(), G.vocabulary(c, 1000), sublinear), "weights")


def text_pairs(t: Tables) -> DataFrame:
    """Ids only: the texts are not read for it, nor shuffled."""
    c, v = t.cv_data.where("text IS NOT NULL").select("cv_id"), t.vacancies.where("job_description IS NOT NULL").select("vacancy_id")
    return scored_pairs(t.match_results).join(c, "cv_id", "left_semi").join(v, "vacancy_id", "left_semi").select("cv_id", "vacancy_id")


def cosine(t: Tables, sublinear: bool = True) -> DataFrame:
    w = weights(t, sublinear)
    side = lambda kind, key: w.where(F.col("kind") == kind).select(F.col("id").alias(key), "term", "w")
    return G.pair_dot(text_pairs(t), side("cv", "cv_id"), side("vacancy", "vacancy_id"), "cv_id", "vacancy_id")


@query(f"SELECT kind, id, CAST(length(regexp_replace(lower(text), '\\s\\s+', ' ', 'g')) AS BIGINT) AS n, md5(lower(text)) AS check FROM {DOCS}".replace(" AS check", " AS text_md5"))
def q_docs(t: Tables) -> DataFrame:
    return docs(t).select("kind", "id", F.length(F.regexp_replace(F.lower("text"), r"\s\s+", " ")).cast("bigint").alias("n"), F.md5(F.lower("text")).alias("text_md5"))


_CHARS = "(SELECT vacancy_id, t, unnest(list_concat(list_transform(range(1, length(t) + 1), lambda i: substr(t, i, 1)), list_transform(range(1, length(t)), lambda i: substr(t, i, 2)), list_transform(range(1, length(t) - 1), lambda i: substr(t, i, 3)))) AS gram FROM (SELECT vacancy_id, regexp_replace(lower(job_title), '\\s\\s+', ' ', 'g') AS t FROM (SELECT DISTINCT vacancy_id, job_title FROM vacancies WHERE job_title <> '')))"


@query(f"SELECT vacancy_id, gram, count(*) AS n FROM {_CHARS} GROUP BY ALL")
def q_char_ngrams(t: Tables) -> DataFrame:
    titles = t.vacancies.where("job_title <> ''").select("vacancy_id", "job_title").distinct()
    return G.term_counts(titles, ["vacancy_id"], G.char_ngrams(F.col("job_title"))).select("vacancy_id", F.col("term").alias("gram"), F.col("tf").alias("n"))


@query(f"SELECT kind, id, term, tf FROM {TF}")
def q_word_ngrams(t: Tables) -> DataFrame:
    return counts(t)


@query(f"SELECT term, sum(tf)::BIGINT AS n, count(*) AS documents FROM {TF} GROUP BY term")
def q_term_freq(t: Tables) -> DataFrame:
    return counts(t).groupBy("term").agg(F.sum("tf").alias("n"), F.count("*").alias("documents"))


@query(f"SELECT term, corpus_tf::BIGINT AS corpus_tf, df FROM {VOCAB}")
def q_vocab(t: Tables) -> DataFrame:
    """The 1000 most frequent terms: the feature is the limit."""
    return G.vocabulary(counts(t), 1000)


@query(f"SELECT kind, id, term, round(w, 4) AS weight, CAST(place AS INTEGER) AS place FROM (SELECT *, row_number() OVER (PARTITION BY kind, id ORDER BY round(w, 9) DESC, term) AS place FROM {_weights_sql(True)} WHERE w > 0) WHERE place <= 10")
def q_top_terms(t: Tables) -> DataFrame:
    w = weights(t).withColumn("key", F.concat_ws(":", "kind", "id"))
    return G.top_terms(w, "key", 10).select("kind", "id", "term", F.round("w", 4).alias("weight"), "place")


@query(f"SELECT kind, id, string_agg(term || '=' || CAST(CAST(round(round(w, 4) * 10000) AS BIGINT) AS VARCHAR), '|' ORDER BY place) AS terms FROM (SELECT *, row_number() OVER (PARTITION BY kind, id ORDER BY round(w, 9) DESC, term) AS place FROM {_weights_sql(True)} WHERE w > 0) WHERE place <= 20 GROUP BY kind, id")
def q_term_map(t: Tables) -> DataFrame:
    """The 20 heaviest terms with their weights, here in ten-thousandths."""
    m = G.term_map(weights(t), ["kind", "id"]).select("kind", "id", F.map_entries("terms").alias("e"))
    return m.select("kind", "id", F.array_join(F.transform("e", lambda x: F.concat_ws("=", x["key"], F.round(x["value"] * 10000).cast("bigint").cast("string"))), "|").alias("terms"))


@query(f"""SELECT cv_id, coalesce(phrases, '') AS phrases, {', '.join(X.CATEGORIES)} FROM ({ORACLE['q_category_skills']}) LEFT JOIN
(SELECT id AS cv_id, string_agg(term, '|' ORDER BY place) AS phrases FROM (SELECT *, row_number() OVER (PARTITION BY kind, id ORDER BY round(w, 9) DESC, term) AS place FROM {_weights_sql(True)} WHERE w > 0) WHERE kind = 'cv' AND place <= 20 GROUP BY id) USING (cv_id)""")
def q_extract_skills(t: Tables) -> DataFrame:
    """Key phrases and the terms of every category in one struct, here as columns."""
    w = weights(t).where("kind = 'cv'").select(F.col("id").alias("cv_id"), "term", "w")
    s = G.extract_skills(t.cv, w, "cv_id", "text")
    return s.select("cv_id", F.array_join("skills.phrases", "|").alias("phrases"), *[F.array_join(f"skills.{c}", ",").alias(c) for c in X.CATEGORIES])


@query()
def q_rank_encoder(t: Tables) -> DataFrame:
    """Each CV's scored vacancies by the dot product of the encoded texts, which SQL has no encoder for."""
    c = materialize(t.cv.select("cv_id", S.encode(T.prepare(F.col("text"))).alias("a")), "encoded")
    v = materialize(t.vac.select("vacancy_id", S.encode(T.prepare(F.col("job_description"))).alias("b")), "encoded")
    d = text_pairs(t).join(c, "cv_id").join(v, "vacancy_id").select("cv_id", "vacancy_id", F.round(100 * S.dot(F.col("a"), F.col("b")), 4).alias("similarity"))
    return R.rank_in_groups(d, "cv_id", "similarity", ["vacancy_id"]).select("cv_id", "vacancy_id", "similarity", "rank")


def _cosine_sql(sublinear: bool) -> str:
    w = _weights_sql(sublinear)
    return f"""(WITH w AS MATERIALIZED {w} SELECT p.cv_id, p.vacancy_id, coalesce(d.dot, 0.0) AS dot FROM {TEXT_PAIRS} p LEFT JOIN
(SELECT p.cv_id, p.vacancy_id, sum(a.w * b.w) AS dot FROM {TEXT_PAIRS} p JOIN w a ON a.kind = 'cv' AND a.id = p.cv_id JOIN w b ON b.kind = 'vacancy' AND b.id = p.vacancy_id AND b.term = a.term GROUP BY ALL) d USING (cv_id, vacancy_id))"""


@query(f"SELECT cv_id, vacancy_id, round(dot, 6) AS similarity FROM {_cosine_sql(True)}")
def q_tfidf_cosine(t: Tables) -> DataFrame:
    return cosine(t).select("cv_id", "vacancy_id", F.round("dot", 6).alias("similarity"))


@query(f"SELECT cv_id, vacancy_id, round(dot, 6) AS similarity FROM {_cosine_sql(False)}")
def q_tfidf_fallback(t: Tables) -> DataFrame:
    return cosine(t, sublinear=False).select("cv_id", "vacancy_id", F.round("dot", 6).alias("similarity"))


@query(f"SELECT cv_id, vacancy_id, CAST(row_number() OVER (PARTITION BY cv_id ORDER BY round(dot, 9) DESC, vacancy_id) AS INTEGER) AS rank FROM {_cosine_sql(True)}")
def q_rank_fwd(t: Tables) -> DataFrame:
    """The flagship: each CV's scored vacancies by TF-IDF cosine."""
    d = cosine(t).withColumn("similarity", F.round("dot", 9))
    return R.rank_in_groups(d, "cv_id", "similarity", ["vacancy_id"], high=1.0).select("cv_id", "vacancy_id", "rank")


_BOOST = lambda x: "[" + ", ".join(f"CASE WHEN contains(lower({x}), {lit(b)}) THEN {lit(b)} END" for b in X.BOOST_TERMS) + "]"


@query(f"""WITH c AS (SELECT cv_id, list_filter({_BOOST('text')}, lambda x: x IS NOT NULL) AS a FROM {CV}), v AS (SELECT vacancy_id, list_filter({_BOOST('job_description')}, lambda x: x IS NOT NULL) AS b FROM {VAC})
SELECT cv_id, vacancy_id, CASE WHEN len(b) = 0 THEN 0.0::DOUBLE ELSE len(list_intersect(a, b))::DOUBLE / len(b) END AS boost FROM {PAIR_IDS} JOIN c USING (cv_id) JOIN v USING (vacancy_id)""")
def q_tech_boost(t: Tables) -> DataFrame:
    c = t.cv.select("cv_id", T.contained(F.lower("text"), X.BOOST_TERMS).alias("a"))
    v = t.vac.select("vacancy_id", T.contained(F.lower("job_description"), X.BOOST_TERMS).alias("b"))
    d = scored_pairs(t.match_results).join(c, "cv_id").join(v, "vacancy_id")
    return d.select("cv_id", "vacancy_id", F.coalesce(F.try_divide(F.size(F.array_intersect("a", "b")).cast("double"), F.size("b").cast("double")), F.lit(0.0)).alias("boost"))


_BM = f"""(WITH q AS (SELECT id AS cv_id, w AS term, count(*) AS qtf FROM (SELECT id, unnest(w) AS w FROM {TOKENS} WHERE kind = 'cv') GROUP BY ALL),
d AS (SELECT id AS vacancy_id, w AS term, count(*) AS tf FROM (SELECT id, unnest(w) AS w FROM {TOKENS} WHERE kind = 'vacancy') GROUP BY ALL),
l AS (SELECT id AS vacancy_id, len(w) AS dl, avg(len(w)) OVER () AS avgdl, count(*) OVER () AS n FROM {TOKENS} WHERE kind = 'vacancy'),
i0 AS (SELECT term, ln((SELECT count(*) FROM {VAC}) - count(*) + 0.5) - ln(count(*) + 0.5) AS idf FROM d GROUP BY term),
i AS (SELECT term, CASE WHEN idf < 0 THEN 0.25 * (SELECT avg(idf) FROM i0) ELSE idf END AS idf FROM i0)
SELECT p.cv_id, p.vacancy_id, coalesce(s.score, 0.0) AS score FROM {TEXT_PAIRS} p LEFT JOIN
(SELECT p.cv_id, p.vacancy_id, sum(qtf * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))) AS score FROM {TEXT_PAIRS} p JOIN q USING (cv_id) JOIN d USING (vacancy_id, term) JOIN l USING (vacancy_id) JOIN i USING (term) GROUP BY ALL) s USING (cv_id, vacancy_id))"""


@query(f"SELECT cv_id, vacancy_id, round(score, 4) AS bm25 FROM {_BM}")
def q_bm25(t: Tables) -> DataFrame:
    b = S.bm25(text_pairs(t), t.cv.select("cv_id", G.tokens(F.col("text")).alias("tokens")), t.vac.select("vacancy_id", G.tokens(F.col("job_description")).alias("tokens")))
    return b.select("cv_id", "vacancy_id", F.round("bm25", 4).alias("bm25"))


# Vectors: every embedding against the centroids of the labels, of which there are few.
_E = "(SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings WHERE embedding IS NOT NULL AND label IS NOT NULL)"
_CENT = f"(SELECT label AS c_label, list(m ORDER BY i) AS c FROM (SELECT label, i, avg(x) AS m FROM (SELECT label, unnest(e) AS x, generate_subscripts(e, 1) AS i FROM {_E}) GROUP BY label, i) GROUP BY label)"
_SIM = f"(SELECT vec_id, label, c_label, list_dot_product(e, c) / sqrt(list_dot_product(c, c)) AS sim, e, c FROM {_E}, {_CENT})"


def embeddings(t: Tables) -> DataFrame:
    return t.embeddings.where("embedding IS NOT NULL AND label IS NOT NULL").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("e"))


@query(f"SELECT vec_id, c_label, round(100 * sim, 4) AS score FROM {_SIM} WHERE label = c_label")
def q_semantic_direct(t: Tables) -> DataFrame:
    e = embeddings(t)
    return e.join(S.centroids(e), F.col("label") == F.col("c_label")).select("vec_id", "c_label", F.round(100 * S.cosine_unit(F.col("e"), F.col("c")), 4).alias("score"))


@query(f"SELECT label, c_label, round(100 * (0.7 * max(sim) + 0.3 * avg(sim)), 4) AS score, round(max(sim), 4) AS best, count(*) AS chunks FROM {_SIM} GROUP BY label, c_label")
def q_semantic_chunked(t: Tables) -> DataFrame:
    """A label's vectors are its chunks: 0.7 of the best and 0.3 of the mean similarity to each centroid."""
    s = S.against_centroids(embeddings(t))
    return s.groupBy("label", "c_label").agg(F.round(100 * (0.7 * F.max("sim") + 0.3 * F.avg("sim")), 4).alias("score"), F.round(F.max("sim"), 4).alias("best"), F.count("*").alias("chunks"))


@query(f"SELECT label, round(max(sim), 4) AS highest, round(avg(sim), 4) AS mean FROM {_SIM} WHERE label = c_label GROUP BY label")
def q_chunk_agg(t: Tables) -> DataFrame:
    e = embeddings(t)
    s = e.join(S.centroids(e), F.col("label") == F.col("c_label")).withColumn("sim", S.cosine_unit(F.col("e"), F.col("c")))
    return s.groupBy("label").agg(F.round(F.max("sim"), 4).alias("highest"), F.round(F.avg("sim"), 4).alias("mean"))


@query(f"SELECT vec_id, min_by(c_label, -round(sim, 9) + c_label * 1e-12) AS nearest, round(max(sim), 4) AS similarity FROM {_SIM} GROUP BY vec_id")
def q_most_similar(t: Tables) -> DataFrame:
    s = S.against_centroids(embeddings(t))
    return s.groupBy("vec_id").agg(F.min(F.struct((-F.round("sim", 9)).alias("s"), "c_label"))["c_label"].alias("nearest"), F.round(F.max("sim"), 4).alias("similarity"))


@query(f"SELECT vec_id, round(list_sum(list_transform(list_zip(e, c), lambda z: abs(z[1] - z[2]))), 4) AS l1, round(sqrt(list_sum(list_transform(list_zip(e, c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))), 4) AS l2, round(1 - list_dot_product(e, c) / (sqrt(list_dot_product(e, e)) * sqrt(list_dot_product(c, c))), 4) AS cosine FROM {_SIM} WHERE label = c_label")
def q_distances(t: Tables) -> DataFrame:
    e = embeddings(t)
    a, c = F.col("e"), F.col("c")
    d = e.join(S.centroids(e), F.col("label") == F.col("c_label"))
    return d.select("vec_id", *[F.round(S.distance(a, c, m), 4).alias(m) for m in ("l1", "l2", "cosine")])


# Character n-gram vectors of titles as typed and as published, over scored pairs.
def _gram_sql(rel: str, key: str, x: str) -> str:
    t = f"regexp_replace(lower({x}), '\\s\\s+', ' ', 'g')"
    return f"""(SELECT key, gram, n / sqrt(sum(n * n) OVER (PARTITION BY key)) AS w, row_number() OVER (PARTITION BY key ORDER BY gram) AS pos FROM (SELECT key, gram, count(*)::DOUBLE AS n FROM (SELECT key, unnest(list_concat(list_transform(range(1, length(t) + 1), lambda i: substr(t, i, 1)),
list_transform(range(1, length(t)), lambda i: substr(t, i, 2)), list_transform(range(1, length(t) - 1), lambda i: substr(t, i, 3)))) AS gram FROM (SELECT DISTINCT {key} AS key, {t} AS t FROM {rel} WHERE {x} <> '')) GROUP BY ALL))"""


_TITLE_PAIRS = "(SELECT DISTINCT vacancy_title AS a, job_title AS b FROM match_results JOIN (SELECT DISTINCT vacancy_id, job_title FROM vacancies) USING (vacancy_id) WHERE vacancy_title <> '' AND job_title <> '')"


def _l1_sql(on: str) -> str:
    return f"""SELECT p.a, p.b, round(greatest(0, x.s + y.s - 2 * coalesce(m.m, 0)), 4) + 0.0 AS distance, round(100 / (1 + greatest(0, x.s + y.s - 2 * coalesce(m.m, 0))), 4) AS score FROM {_TITLE_PAIRS} p
JOIN (SELECT key, sum(w) AS s FROM ga GROUP BY key) x ON x.key = p.a JOIN (SELECT key, sum(w) AS s FROM gb GROUP BY key) y ON y.key = p.b
LEFT JOIN (SELECT p.a, p.b, sum(least(ga.w, gb.w)) AS m FROM {_TITLE_PAIRS} p JOIN ga ON ga.key = p.a JOIN gb ON gb.key = p.b AND gb.{on} = ga.{on} GROUP BY ALL) m ON m.a = p.a AND m.b = p.b"""


_G = f"WITH ga AS MATERIALIZED {_gram_sql('match_results', 'vacancy_title', 'vacancy_title')}, gb AS MATERIALIZED {_gram_sql('vacancies', 'job_title', 'job_title')} "


def _title_distance(t: Tables, on: str) -> DataFrame:
    titles = t.vacancies.where("job_title <> ''").select("vacancy_id", "job_title").distinct()
    p = t.match_results.where("vacancy_title <> ''").select("vacancy_id", "vacancy_title").distinct().join(titles, "vacancy_id").select(F.col("vacancy_title").alias("a"), F.col("job_title").alias("b")).distinct()
    left = S.gram_vectors(t.match_results.where("vacancy_title <> ''").select(F.col("vacancy_title").alias("a")).distinct(), "a")
    right = S.gram_vectors(titles.select(F.col("job_title").alias("b")).distinct(), "b")
    d = S.l1_pairs(p, left, right, "a", "b", on)
    return d.select("a", "b", F.round("l1", 4).alias("distance"), F.round(100 / (1 + F.col("l1")), 4).alias("score"))


@query(_G + _l1_sql("gram"))
def q_vm_aligned(t: Tables) -> DataFrame:
    """L1 distance of normalised character n-gram vectors, n-gram against the same n-gram, and the score from it."""
    return _title_distance(t, "term")


@query(_G + _l1_sql("pos"))
def q_vm_positional(t: Tables) -> DataFrame:
    """The same with the i-th n-gram of one text against the i-th of the other, as vectors fitted on single texts compare."""
    return _title_distance(t, "pos")


# Skills.
_SKILLS = "(SELECT DISTINCT cv_id, list_filter(coalesce(skills, []), lambda s: s IS NOT NULL) AS skills FROM cv_data)"


def _norm(x: str) -> str:
    kept = f"array_to_string(list_filter(regexp_split_to_array(trim(lower(s)), '\\s+'), lambda w: w <> '' AND w NOT IN ({_STOP})), ' ')"
    return f"list_distinct(list_filter(list_transform({x}, lambda s: CASE WHEN {kept} = '' THEN trim(lower(s)) ELSE {kept} END), lambda s: s <> ''))"


_LEX = "(SELECT map_from_entries(list((n, c))) AS m FROM (SELECT n, min_by(c, id) AS c FROM (SELECT lower(unnest(list_concat([canonical], coalesce(other_names, [])))) AS n, lower(canonical) AS c, catalog_id AS id FROM catalog_entries WHERE entry_kind = 'skill') GROUP BY n))"
_CVF = f"(SELECT cv_id, list_transform(skills, lambda s: lower(s)) AS raw, norm, list_distinct(list_transform(norm, lambda s: coalesce(m[s], s))) AS canon FROM (SELECT cv_id, skills, {_norm('skills')} AS norm FROM {_SKILLS}), {_LEX})"


def _after(marker: str, s: str) -> str:
    return f"len(list_filter(string_split(low, chr(10)), lambda l: contains(l, {lit(marker)}) AND contains(substr(l, strpos(l, {lit(marker)}) + {len(marker)}), {s}))) > 0"


def _weight(s: str) -> str:
    w = f"1.0 + least((length(low) - length(replace(low, {s}, ''))) / length({s}) * 0.1, 0.3) + CASE WHEN contains(left(low, 500), {s}) THEN 0.2 ELSE 0.0 END"
    w += "".join(f" + CASE WHEN {_after(m, s)} THEN {b} ELSE 0.0 END" for m, b in X.IMPORTANCE)
    return f"round(greatest(0.5, least(2.0, {w}))::DOUBLE, 2)"


_TECH_LIST = "list_filter([" + ", ".join(f"CASE WHEN {_tech_sql(s, 'low')} THEN {lit(s)} END" for s in X.TECH_TERMS) + "], lambda x: x IS NOT NULL)"
_SOFT_LIST = "list_filter([" + ", ".join(f"CASE WHEN contains(low, {lit(s)}) THEN {lit(s)} END" for s in X.SOFT_SKILLS) + "], lambda x: x IS NOT NULL)"
_VF = f"""(SELECT vacancy_id, low, sk, terms, each, list_distinct(list_transform(each, lambda s: coalesce(m[s], s))) AS vcanon, list_transform(each, lambda s: {{'s': s, 'w': {_weight('s')}}}) AS wt,
regexp_extract(low, {lit(X.MUST_SECTION)}, 1) AS must, list_filter(each, lambda s: {' OR '.join(f'({_after(c, "s")})' for c in X.CRITICAL)}) AS critical FROM
(SELECT *, list_concat(sk, soft) AS terms, list_distinct(list_concat(sk, soft)) AS each FROM (SELECT vacancy_id, low, {_norm(_TECH_LIST)} AS sk, {_SOFT_LIST} AS soft FROM (SELECT vacancy_id, lower(job_description) AS low FROM {VAC}))), {_LEX})"""
_VWORDS = "list_distinct(regexp_split_to_array(v, '\\s+'))"
_PARTIAL = f"list_filter(each, lambda v: len({_VWORDS}) > 1 AND len(list_filter(raw, lambda r: 2 * len(list_intersect({_VWORDS}, regexp_split_to_array(r, '\\s+'))) >= len({_VWORDS}))) > 0)"
# No two terms of these lists are alike enough for a fuzzy match without being equal.
_M = f"""(SELECT *, list_filter(each, lambda s: NOT list_contains(matched, s)) AS missing FROM (SELECT *, list_distinct(list_concat(exact, synonym, partial)) AS matched FROM
(SELECT cv_id, vacancy_id, low, sk, terms, each, wt, must, critical, list_intersect(each, norm) AS exact, list_intersect(vcanon, canon) AS synonym, {_PARTIAL} AS partial FROM {PAIR_IDS} JOIN {_CVF} USING (cv_id) JOIN {_VF} USING (vacancy_id))))"""


def features(t: Tables) -> tuple[DataFrame, DataFrame]:
    syn = K.synonym_map(t.catalog_entries)
    return materialize(K.cv_features(t.cv_data.select("cv_id", "skills").distinct(), syn), "cv"), materialize(K.vacancy_features(t.vac, syn), "vac")


def matches(t: Tables) -> DataFrame:
    c, v = features(t)
    fuzzy = K.fuzzy_table(c.select(F.explode("norm").alias("a")), v.select(F.explode("each").alias("b")))
    return K.keyword_match(scored_pairs(t.match_results), c, v, fuzzy.select("a", "b"))


def _joined(x: str) -> str:
    return f"array_to_string(list_sort({x}), ',')"


def _flat(name: str):
    return F.array_join(F.array_sort(name), ",").alias(name)


@query(f"SELECT cv_id, {_joined('norm')} AS norm, {_joined('canon')} AS canon FROM {_CVF}")
def q_normalize_skills(t: Tables) -> DataFrame:
    return features(t)[0].select("cv_id", _flat("norm"), _flat("canon"))


@query(f"SELECT cv_id, vacancy_id, {_joined('exact')} AS exact FROM {_M}")
def q_exact_match(t: Tables) -> DataFrame:
    return matches(t).select("cv_id", "vacancy_id", _flat("exact"))


@query(f"SELECT cv_id, vacancy_id, {_joined('synonym')} AS synonym FROM {_M}")
def q_synonym_match(t: Tables) -> DataFrame:
    return matches(t).select("cv_id", "vacancy_id", _flat("synonym"))


@query(f"SELECT cv_id, vacancy_id, {_joined('partial')} AS partial FROM {_M}")
def q_partial_match(t: Tables) -> DataFrame:
    return matches(t).select("cv_id", "vacancy_id", _flat("partial"))


@query(f"SELECT cv_id, vacancy_id, {_joined('missing')} AS missing FROM {_M}")
def q_missing(t: Tables) -> DataFrame:
    return matches(t).select("cv_id", "vacancy_id", _flat("missing"))


@query()
def q_fuzzy_match(t: Tables) -> DataFrame:
    """Terms of both sides that are alike by sequence ratio, which SQL has no function for."""
    c, v = features(t)
    return K.fuzzy_table(c.select(F.explode("norm").alias("a")), v.select(F.explode("each").alias("b")))


@query(f"SELECT vacancy_id, u.s AS skill, u.w AS weight FROM (SELECT vacancy_id, unnest(wt) AS u FROM {_VF})")
def q_skill_weights(t: Tables) -> DataFrame:
    return features(t)[1].select("vacancy_id", F.explode("weights").alias("skill", "weight"))


_BONUS = "least(15, 2 * len(list_filter(matched, lambda m: contains(must, m))))"
_PENALTY = "least(40, 3 * len(missing) + 7 * len(list_intersect(missing, critical)))"


@query(f"SELECT cv_id, vacancy_id, CAST({_BONUS} AS INTEGER) AS bonus FROM {_M}")
def q_must_have_bonus(t: Tables) -> DataFrame:
    return matches(t).select("cv_id", "vacancy_id", "bonus")


@query(f"SELECT cv_id, vacancy_id, CAST({_PENALTY} AS INTEGER) AS penalty FROM {_M}")
def q_critical_penalty(t: Tables) -> DataFrame:
    return matches(t).select("cv_id", "vacancy_id", "penalty")


_GOT = "list_sum(list_concat([0.0::DOUBLE], list_transform(matched, lambda m: coalesce(list_filter(wt, lambda x: x.s = m)[1].w, 0.9))))"
_WHOLE = "list_sum(list_concat([0.0::DOUBLE], list_transform(terms, lambda m: coalesce(list_filter(wt, lambda x: x.s = m)[1].w, 1.0))))"
_SHARE = f"CASE WHEN {_WHOLE} = 0 THEN 0.0 ELSE {_GOT} / {_WHOLE} * 100 END"
_BASE = rnd_sql(rnd_sql(f"greatest(0.0, least(100.0, {_SHARE} + {_BONUS}) - {_PENALTY})", 6), 1)
_SCORE = f"CASE WHEN len(sk) = 0 THEN 0.0 WHEN contains(low, 'remote') OR contains(low, 'work from home') THEN least(100.0, {_BASE} + 15) ELSE {_BASE} END"


@query(f"SELECT cv_id, vacancy_id, CAST({_SCORE} AS DOUBLE) AS keyword_score FROM {_M}")
def q_keyword_score(t: Tables) -> DataFrame:
    return matches(t).select("cv_id", "vacancy_id", "keyword_score")


_EXPERIENCE = "SELECT cv_id, max(experience) AS e FROM cv_data WHERE experience IS NOT NULL GROUP BY cv_id"
_ADJUSTED = "CASE WHEN e IS NULL OR required_years IS NULL THEN s ELSE greatest(0.0, least(100.0, CASE WHEN e > 2 * required_years THEN s - 5 WHEN e >= required_years THEN s + 5 ELSE s END)) END"


@query(f"SELECT cv_id, vacancy_id, s AS forward, CAST({_ADJUSTED} AS DOUBLE) AS reverse FROM (SELECT *, CAST({_SCORE} AS DOUBLE) AS s FROM {_M}) LEFT JOIN ({_EXPERIENCE}) USING (cv_id) LEFT JOIN ({ORACLE['q_required_years']}) USING (vacancy_id)")
def q_experience_score(t: Tables) -> DataFrame:
    """Keyword scores of both directions: required years count in the reverse one only."""
    e = t.cv_data.where("experience IS NOT NULL").groupBy("cv_id").agg(F.max("experience").alias("experience"))
    r = t.vac.select("vacancy_id", T.required_years(F.col("job_description")).alias("required"))
    return K.both_directions(matches(t), e, r).select("cv_id", "vacancy_id", "forward", "reverse")


@query(f"""SELECT cv_id, vacancy_id, concat_ws(chr(10), s || ' ' || CASE WHEN s >= 80 THEN 'excellent' WHEN s >= 60 THEN 'good' WHEN s >= 40 THEN 'medium' ELSE 'weak' END, 'exact: ' || array_to_string(list_slice(list_sort(exact), 1, 5), ', '),
'synonym: ' || array_to_string(list_slice(list_sort(synonym), 1, 3), ', '), 'fuzzy: ' || array_to_string(list_slice(list_sort(exact), 1, 3), ', '),
'missing: ' || array_to_string(list_transform(list_slice(list_sort(missing), 1, 8), lambda m: CASE WHEN coalesce(list_filter(wt, lambda x: x.s = m)[1].w, 1.0) > 1.2 THEN m || '!' ELSE m END), ', ')) AS explanation FROM (SELECT *, CAST({_SCORE} AS DOUBLE) AS s FROM {_M})""")
def q_explanation(t: Tables) -> DataFrame:
    """The sequence ratio of equal terms is 1, so the fuzzy matches hold the exact ones."""
    return K.explanation(matches(t))


@query(f"SELECT (SELECT count(*) FROM (SELECT cv_id FROM cv_data INTERSECT SELECT cv_id FROM match_results)) AS common, (SELECT count(*) FROM (SELECT cv_id FROM cv_data EXCEPT SELECT cv_id FROM match_results)) AS only_cv, (SELECT count(*) FROM (SELECT cv_id FROM cv_data UNION SELECT cv_id FROM match_results)) AS either")
def q_set_ops(t: Tables) -> DataFrame:
    a, b = t.cv_data.select("cv_id"), t.match_results.select("cv_id")
    flags = a.intersect(b).select(F.lit("common").alias("k")).unionByName(a.subtract(b).select(F.lit("only_cv").alias("k"))).unionByName(a.union(b).distinct().select(F.lit("either").alias("k")))
    return flags.agg(*[F.count(F.when(F.col("k") == k, 1)).alias(k) for k in ("common", "only_cv", "either")])


@query("SELECT count(*) AS n, count(DISTINCT cv_id) AS cvs, count(DISTINCT vacancy_id) AS vacancies FROM " + TEXT_PAIRS)
def q_cross_pairs(t: Tables) -> DataFrame:
    """The pairs to be scored: those that were asked for, not all of both sides."""
    return text_pairs(t).agg(F.count("*").alias("n"), F.count_distinct("cv_id").alias("cvs"), F.count_distinct("vacancy_id").alias("vacancies"))


@query(f"SELECT kind, id, count(*) AS terms, round(sum(w * w), 6) AS norm FROM {_weights_sql(True)} GROUP BY kind, id")
def q_term_join(t: Tables) -> DataFrame:
    return weights(t).groupBy("kind", "id").agg(F.count("*").alias("terms"), F.round(F.sum(F.col("w") * F.col("w")), 6).alias("norm"))
