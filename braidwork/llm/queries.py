"""Queries of the training-data operations, over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from braidwork.llm import canonical, consensus, encoding, language, mixing, nearduplicates, packing, personal, tokens, topn
from braidwork.session import materialize, table


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return canonical.free_values(table(spark, sf_dir, "match_results"), table(spark, sf_dir, "vacancies"), table(spark, sf_dir, "catalog_entries"))


def p1_unmatched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values that mean no entry, with how often they occur."""
    return p1_found(spark, sf_dir).where(F.col("catalog_id") == 0).groupBy("field_name", "raw_value").agg(F.count("*").alias("n_records"))


def _record_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = table(spark, sf_dir, "vacancies").select(F.lit(0).alias("space"), F.col("vacancy_id").alias("id"), F.col("job_description").alias("text"))
    return v.unionByName(table(spark, sf_dir, "cv_data").select(F.lit(1).alias("space"), F.col("cv_id").alias("id"), "text"))


def _record_table():
    return F.when(F.col("space") == 0, F.lit("vacancies")).otherwise(F.lit("cv_data")).alias("record_table")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shingles of three words and a similarity of 0.5, as TESTDATA.md states the cases."""
    links, members = nearduplicates.similar_sets(_record_texts(spark, sf_dir), k=3, similarity=0.5)
    return nearduplicates.expand(links, members).select(_record_table(), "id_a", "id_b")


def p2_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every record with its group of versions and the number of its links."""
    links, members = nearduplicates.similar_sets(_record_texts(spark, sf_dir), k=3, similarity=0.5)
    return nearduplicates.groups(links, members).select(_record_table(), F.col("id").alias("record_id"), "group_id", "n_links")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topn.best_vacancies(table(spark, sf_dir, "match_results"))


def p4_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every segment of every record with its language, confidence and ambiguity."""
    v, c = table(spark, sf_dir, "vacancies"), table(spark, sf_dir, "cv_data")
    model = language.fit_on([(v, "vacancy_id", "job_description", "lang"), (c, "cv_id", "text", "lang")])
    return language.label_segments(v, "vacancy_id", "job_description", "lang", model, "vacancies").unionByName(language.label_segments(c, "cv_id", "text", "lang", model, "cv_data"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.wrong_labels(p4_segments(spark, sf_dir))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal.find(table(spark, sf_dir, "cv_data"), "cv_id", "text")


def p5_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal.redact(table(spark, sf_dir, "cv_data"), "cv_id", "text")


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return consensus.plain_consensus(table(spark, sf_dir, "annotations"))


def p6_weighted_consensus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return consensus.truth_discovery(table(spark, sf_dir, "annotations"))[0].select("cv_id", "vacancy_id", "n_votes", F.round("mean_rank", 6).alias("mean_rank"), "consensus_rank")


def p6_reliability(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = consensus.truth_discovery(table(spark, sf_dir, "annotations"))[1]
    return found.select("annotator", "n_votes", *[F.round(c, 6).alias(c) for c in ("squared_error", "variance_bound", "weight")])


def p6_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    return consensus.truth_discovery(table(spark, sf_dir, "annotations"), weighting="equal")[2].withColumn("kendall_w", F.round("kendall_w", 6))


def _sized(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``doc_id, source, tokens``, each document once."""
    d = table(spark, sf_dir, "documents").select("doc_id", "source", tokens.token_count(F.col("text")).alias("tokens"))
    return d.groupBy("doc_id").agg(F.max("source").alias("source"), F.max("tokens").alias("tokens"))


def p7_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    sized = materialize(_sized(spark, sf_dir), "tokens")
    total = sized.count()
    kinds = table(spark, sf_dir, "containers").orderBy("container_kind").limit(101).collect()
    if len(kinds) > 100:
        raise ValueError("more than 100 kinds of containers")
    packed = None
    for r in kinds:
        one = packing.pack(sized, "doc_id", "tokens", r["capacity_tokens"], total).select(F.lit(r["container_kind"]).alias("container_kind"), "*")
        packed = one if packed is None else packed.unionByName(one)
    return packed


def p8_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_sized(spark, sf_dir), table(spark, sf_dir, "mix_targets"))[0]


def p8_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_sized(spark, sf_dir), table(spark, sf_dir, "mix_targets"))[1]


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoding.damaged_documents(table(spark, sf_dir, "documents")).select("doc_id")


def p9_restored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoding.damaged_documents(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (p1_found, p1_unmatched, p2_found, p2_groups, p3_found, p4_found, p4_segments, p5_found, p5_redacted, p6_found, p6_weighted_consensus, p6_reliability, p6_agreement, p7_pack, p8_mix, p8_shares, p9_found, p9_restored)}

_COUNTING = """
WITH r AS (SELECT DISTINCT ballot_id, annotator, cv_id, vacancy_id, rank_no, annotated_at FROM annotations WHERE ballot_id IS NOT NULL AND annotator IS NOT NULL AND cv_id IS NOT NULL),
b AS (SELECT cv_id, annotator, ballot_id, max(annotated_at) AS given FROM r GROUP BY ALL
      HAVING count(*) = 5 AND count(vacancy_id) = 5 AND count(DISTINCT vacancy_id) = 5 AND count(DISTINCT rank_no) = 5 AND min(rank_no) = 1 AND max(rank_no) = 5),
n AS (SELECT * FROM b QUALIFY row_number() OVER (PARTITION BY cv_id, annotator ORDER BY given DESC NULLS LAST, ballot_id DESC) = 1),
v AS (SELECT r.cv_id, r.annotator, r.vacancy_id, r.rank_no FROM r JOIN n USING (cv_id, annotator, ballot_id)),
c AS (SELECT * FROM v WHERE cv_id IN (SELECT cv_id FROM v GROUP BY 1 HAVING count(DISTINCT annotator) >= 2))
"""

def _rounds(n: int) -> str:
    """The rounds of the weighted consensus, unrolled: votes ``v``, truth ``t`` and annotators ``a`` of each."""
    out = []
    for i in range(n + 1):
        votes = "SELECT *, 1.0::DOUBLE AS w FROM c" if not i else f"SELECT c.*, a{i - 1}.w FROM c JOIN a{i - 1} USING (annotator)"
        out.append(f"""
v{i} AS MATERIALIZED ({votes}),
t{i} AS MATERIALIZED (SELECT cv_id, vacancy_id, sum(w * rank_no) AS sr, sum(w) AS sw, count(*) AS n FROM v{i} GROUP BY ALL),
e{i} AS (SELECT annotator, count(*) AS n, coalesce(sum(pow(rank_no - CASE WHEN t.n > 1 THEN (sr - w * rank_no) / nullif(sw - w, 0) END, 2)), 0) AS e FROM v{i} v JOIN t{i} t USING (cv_id, vacancy_id) GROUP BY ALL),
a{i} AS MATERIALIZED (SELECT annotator, n, e, greatest(e, 0.001) / (n * pow(greatest(1e-6, 1 - 2 / (9 * n::DOUBLE) - 1.959963984540054 * sqrt(2 / (9 * n::DOUBLE))), 3)) AS b, 1 / b AS w FROM e{i})""")
    return ", ".join(out)


def _shingles(table_name: str, key: str, text: str) -> str:
    """One row per record and distinct run of three words, with the size of the record's set."""
    return f"""SELECT DISTINCT '{table_name}' AS record_table, {key} AS id, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS s
FROM (SELECT {key}, w, unnest(range(1, len(w) - 1)) AS i FROM (SELECT {key}, regexp_extract_all(lower({text}), '[\\p{{L}}\\p{{N}}]+') AS w FROM {table_name} WHERE {text} IS NOT NULL) WHERE len(w) >= 3)"""


ORACLE = {
    "p2_found": f"""
WITH s AS ({_shingles("vacancies", "vacancy_id", "job_description")} UNION ALL {_shingles("cv_data", "cv_id", "text")}),
n AS (SELECT record_table, id, count(*) AS n FROM s GROUP BY ALL),
c AS (SELECT a.record_table, a.id AS id_a, b.id AS id_b, count(*) AS c FROM s a JOIN s b ON a.record_table = b.record_table AND a.s = b.s AND a.id < b.id GROUP BY ALL)
SELECT c.record_table, id_a, id_b FROM c JOIN n x ON x.record_table = c.record_table AND x.id = id_a JOIN n y ON y.record_table = c.record_table AND y.id = id_b
WHERE 2 * c >= x.n + y.n - c""",
    "p3_found": """
WITH ok AS (SELECT DISTINCT * FROM match_results WHERE total_score IS NOT NULL AND NOT isnan(total_score) AND total_score BETWEEN 0 AND 100 AND cv_id IS NOT NULL AND vacancy_id IS NOT NULL),
last AS (SELECT cv_id, vacancy_id, total_score FROM ok QUALIFY row_number() OVER (PARTITION BY cv_id, vacancy_id ORDER BY scored_at DESC NULLS LAST, result_id DESC) = 1),
best AS (SELECT cv_id, vacancy_id, CAST(row_number() OVER (PARTITION BY cv_id ORDER BY total_score DESC, vacancy_id) AS INTEGER) AS place FROM last)
SELECT cv_id, place, vacancy_id FROM best WHERE place <= 3""",
    "p6_found": _COUNTING + ", m AS (SELECT cv_id, vacancy_id, avg(rank_no) AS a FROM c GROUP BY ALL) SELECT cv_id, vacancy_id, CAST(row_number() OVER (PARTITION BY cv_id ORDER BY a, vacancy_id DESC) AS INTEGER) AS consensus_rank FROM m",
    "p6_weighted_consensus": _COUNTING + "," + _rounds(6) + """
SELECT cv_id, vacancy_id, n AS n_votes, round(sr / sw, 6) AS mean_rank, CAST(row_number() OVER (PARTITION BY cv_id ORDER BY round(sr / sw, 9), vacancy_id DESC) AS INTEGER) AS consensus_rank FROM t6""",
    "p6_reliability": _COUNTING + "," + _rounds(6) + " SELECT annotator, n AS n_votes, round(e, 6) AS squared_error, round(b, 6) AS variance_bound, round(w, 6) AS weight FROM a6",
    "p6_agreement": _COUNTING + """, s AS (SELECT cv_id, vacancy_id, sum(rank_no) AS r, count(*) AS m FROM c GROUP BY ALL)
SELECT cv_id, max(m) AS n_annotators, round(12 * var_pop(r) * count(*) / (pow(max(m), 2) * (pow(count(*), 3) - count(*))), 6) AS kendall_w FROM s GROUP BY cv_id""",
}
