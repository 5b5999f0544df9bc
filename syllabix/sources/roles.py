"""Course-data roles (page views, quizzes, surveys ...) as views of the test tables.

The text of each role is SQL both Spark and DuckDB run, with two marked
differences: how a reserved name is quoted and where an array starts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

ROLES: dict[str, str] = {
    "page_views": """
SELECT institution_id, class_id, student_id, event_id AS ord,
  concat('Chapter ', cast(chapter_num AS string)) AS chapter,
  concat(cast(chapter_num AS string), '.', cast(pos AS string), ' Topic',
         CASE WHEN k % 5 = 0 THEN ' ' ELSE '' END) AS page,
  cast(ts AS string) AS dt_accessed,
  CASE WHEN event_type IN ('view','click') THEN 'true' ELSE 'false' END AS was_complete
FROM (SELECT event_id, ts, event_type, user_id AS student_id, user_id % 12 AS class_id,
        user_id % 12 % 3 AS institution_id, k, k % 7 + 1 AS chapter_num, cast(floor(k / 7) AS int) + 1 AS pos
      FROM (SELECT *, cast(regexp_extract(props, '([0-9]+)', 1) AS int) AS k FROM {events}) a) b""",
    "classes": """
SELECT user_id % 12 % 3 AS institution_id, user_id % 12 AS class_id, 'r1' AS release, 'b1' AS book,
  count(DISTINCT user_id) AS n_students
FROM {events} GROUP BY user_id % 12 % 3, user_id % 12""",
    "page_codebook": """
SELECT DISTINCT 'r1' AS release, 'b1' AS book, concat('Chapter ', cast(k % 7 + 1 AS string)) AS chapter,
  k % 7 + 1 AS chapter_num,
  concat(cast(k % 7 + 1 AS string), '.', cast(cast(floor(k / 7) AS int) + 1 AS string), ' Topic') AS page,
  cast(floor(k / 7) AS int) + 1 AS page_num
FROM (SELECT cast(regexp_extract(props, '([0-9]+)', 1) AS int) AS k FROM {events}) a WHERE k < 98""",
    "quiz_codebook": """
SELECT DISTINCT 'r1' AS release, 'b1' AS book, concat('Chapter ', cast(l_linenumber AS string)) AS chapter,
  l_linenumber AS chapter_num,
  concat(cast(l_linenumber AS string), '.11 Chapter ', cast(l_linenumber AS string), ' Review Questions') AS page,
  11 AS page_num, 20 AS mcq, 2 AS plaintext
FROM {lineitem}""",
    "quiz_responses": """
SELECT 'r1' AS release, 'b1' AS book, o_custkey % 12 % 3 AS institution_id, o_custkey % 12 AS class_id,
  o_custkey AS student_id, concat('Chapter ', cast(l_linenumber AS string)) AS chapter,
  concat(cast(l_linenumber AS string), '.11 Chapter ', cast(l_linenumber AS string), ' Review Questions ') AS page,
  CASE WHEN l_linestatus = 'O' THEN 'mcq' ELSE 'plaintext' END AS lrn_type,
  concat('L', cast(l_linenumber AS string), '-', cast(l_partkey % 20 AS string)) AS lrn_question_reference,
  cast(CASE l_returnflag WHEN 'R' THEN 1.0 WHEN 'A' THEN 0.0 END AS double) AS points_earned,
  cast(1.0 AS double) AS points_possible
FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey""",
    "survey_responses": """
SELECT 'r1' AS release, 'b1' AS book, o_custkey % 12 % 3 AS institution_id, o_custkey % 12 AS class_id,
  o_custkey AS student_id, o_orderkey AS ord,
  CASE WHEN o_orderkey % 10 = 9 THEN 'Post_Survey' ELSE 'Pre_Survey_1' END AS lrn_activity_reference,
  CASE WHEN o_orderkey % 11 = 0 THEN 'shorttext' ELSE 'mcq' END AS lrn_type,
  concat('Q', cast(o_orderkey % 6 AS string)) AS lrn_question_reference,
  concat('prompt ', cast(o_orderkey % 6 AS string)) AS prompt,
  CASE WHEN o_orderkey % 13 = 0 THEN 'null'
       WHEN o_orderkey % 17 = 0 THEN '[]'
       WHEN o_orderkey % 6 = 5
         THEN concat('["', substr(o_orderpriority, 1, 1), '", "', cast(o_orderkey % 4 AS string), '"]')
       ELSE concat('["', substr(o_orderpriority, 1, 1), '"]') END AS response
FROM {orders}""",
    "survey_codebook": """
SELECT * FROM (VALUES
  ('r1','Pre_Survey_1','Q0',1,'anx_ma_1','prompt 0','mcq','a','b','c'),
  ('r1','Pre_Survey_1','Q1',1,'r_anx_1','prompt 1','mcq','a','b',NULL),
  ('r1','Pre_Survey_1','Q2',1,'cost3_1','prompt two','mcq','a','b','c'),
  ('r1','Pre_Survey_1','Q3',1,'uv_j1_1','prompt 3','mcq','a',NULL,NULL),
  ('r1','Pre_Survey_1','Q4',1,' gender','prompt 4','mcq','a','b','c'),
  ('r1','Pre_Survey_1','Q5',1,'ma_prep_a','prompt 5','mcq','a','b','c'),
  ('r1','Pre_Survey_1','Q5',2,'ma_prep_b','prompt 5','mcq','a','b',NULL))
  AS t(release, lrn_activity_reference, lrn_question_reference, {order}, variable_name, prompt, lrn_type,
       lrn_option_0, lrn_option_1, lrn_option_2)""",
    "construct_lookup": """
SELECT * FROM (VALUES ('anx_ma_1','anxiety_math',6,false,'prompt 0'), ('r_anx_1','anxiety_math',6,false,'prompt 1'),
  ('cost3_1','stress_expectation',6,true,'prompt 2'), ('uv_j1_1','value_task',6,false,'prompt 3'))
  AS t(id, construct, scale_values, scale_flipped, question)""",
    "assessments": """
SELECT c_custkey AS student_id, CASE WHEN c_acctbal >= 0 THEN c_acctbal / 10000 END AS quiz_mean FROM {customer}""",
    "condition_survey": """
SELECT d.doc_id AS student_id, CASE WHEN l.quality = 1 THEN 'B' ELSE 'A' END AS module_variation,
  cast(d.n_chars AS double) / 1000 AS y1, cast(l.toxic AS double) AS y2
FROM {documents} d JOIN {labels} l ON d.doc_id = l.doc_id""",
    "condition_waves": """
SELECT d.source AS source, d.doc_id AS student_id,
  CASE WHEN l.toxic = 1 THEN 'C' WHEN l.quality = 1 THEN 'B' ELSE 'A' END AS module_variation,
  CASE WHEN d.doc_id % 10 > 0 THEN cast(d.n_chars AS double) / 1000 END AS y1, cast(l.toxic AS double) AS y2
FROM {documents} d JOIN {labels} l ON d.doc_id = l.doc_id""",
    "item_codebook": """
SELECT p_partkey AS item_id, CASE WHEN p_size % 2 = 0 THEN p_brand END AS lrn_option_0,
  CASE WHEN p_size % 3 = 0 THEN p_type END AS lrn_option_1,
  CASE WHEN p_retailprice > 1000 THEN p_name END AS lrn_option_2
FROM {part}""",
    "profiles": """
SELECT vec_id AS student_id, label AS class_id, {E1} AS c1, {E2} AS c2, {E3} AS c3, {E4} AS c4, {E5} AS c5,
  {E6} AS c6, {E7} AS c7, {E8} AS y FROM {embeddings}""",
}

_TABLES = ("events", "lineitem", "orders", "customer", "documents", "labels", "embeddings", "part")


def _names(first_index: int, quote: str) -> dict[str, str]:
    names = {t: t for t in _TABLES}
    names["order"] = f"{quote}order{quote}"
    for i in range(1, 9):
        names[f"E{i}"] = f"cast(embedding[{i - 1 + first_index}] AS double)"
    return names


def duckdb_sql(name: str) -> str:
    """The role as DuckDB text over the registered tables."""
    return ROLES[name].format(**_names(1, '"')).strip()


def role(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The role as a DataFrame over the parquet files in ``folder``."""
    names = _names(0, "`")
    for table in _TABLES:
        names[table] = f"parquet.`{folder}/{table}.parquet`"
    return spark.sql(ROLES[name].format(**names))
