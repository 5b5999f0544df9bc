"""DuckDB SQL each registered query is checked against.

Written apart from the operators: plain SQL over the same roles. ``STEPS`` are named
intermediate tables; a query gets the ones it mentions as common table expressions.
"""

from __future__ import annotations

import re

from syllabix.catalog.specs import (
    ENGAGEMENT_MODELS,
    FEATURES,
    ITEM_AUDITS,
    ITERATIONS,
    MERGED_MEASURES,
    MERGED_MODELS,
    MERGED_QUIZ_MODELS,
    OLS_MODELS,
    QUIZ_AUDITS,
    QUIZ_MODELS,
)
from syllabix.sources.roles import ROLES, duckdb_sql

DENSITY_CELLS = 1024
STUDENT = "release, book, institution_id, class_id, student_id"


def r6(expression: str, name: str) -> str:
    return f"round(cast({expression} AS double), 6) + 0.0 AS {name}"


def same(a: str, b: str, keys: str) -> str:
    return " AND ".join(f"{a}.{k} IS NOT DISTINCT FROM {b}.{k}" for k in keys.split(", "))


# Tail probabilities by Simpson's rule on the density, after a substitution that
# makes it smooth.
POINTS = 2000


def _simpson(integrand: str, upper: str) -> str:
    weight = f"CASE WHEN k = 0 OR k = {POINTS} THEN 1 WHEN k % 2 = 1 THEN 4 ELSE 2 END"
    return (
        f"(({upper}) / {3 * POINTS}.0 * list_sum(list_transform(range(0, {POINTS + 1}), "
        f"lambda k: ({weight}) * ({integrand.format(u=f'(({upper}) * k / {POINTS}.0)')}))))"
    )


def t_tail(t: str, df: str) -> str:
    """Two-sided p of t."""
    area = _simpson(f"pow(cos({{u}}), ({df}) - 1)", f"atan(abs({t}) / sqrt({df}))")
    return f"(1 - 2 * exp(lgamma((({df}) + 1) / 2.0) - lgamma(({df}) / 2.0)) / sqrt(pi()) * {area})"


def f_tail(f: str, d1: str, d2: str) -> str:
    area = _simpson(
        f"pow(sin({{u}}), ({d2}) - 1) * pow(cos({{u}}), ({d1}) - 1)",
        f"asin(sqrt(({d2}) / (({d2}) + ({d1}) * ({f}))))",
    )
    return (
        f"(2 * exp(lgamma((({d1}) + ({d2})) / 2.0) - lgamma(({d1}) / 2.0) - lgamma(({d2}) / 2.0)) * {area})"
    )


def chi2_tail(x: str, df: str) -> str:
    area = _simpson(f"pow({{u}}, ({df}) - 1) * exp(-({{u}}) * ({{u}}) / 2)", f"sqrt({x})")
    return f"(1 - pow(2.0, 1 - ({df}) / 2.0) / exp(lgamma(({df}) / 2.0)) * {area})"


def t_975(df: str) -> str:
    """0.975 quantile of t by its expansion around the normal quantile."""
    z = 1.959963984540054
    terms = [
        (z**3 + z) / 4,
        (5 * z**5 + 16 * z**3 + 3 * z) / 96,
        (3 * z**7 + 19 * z**5 + 17 * z**3 - 15 * z) / 384,
        (79 * z**9 + 776 * z**7 + 1482 * z**5 - 1920 * z**3 - 945 * z) / 92160,
    ]
    return "(" + f"{z!r}::double" + "".join(f" + {c!r}::double / pow({df}, {i + 1})" for i, c in enumerate(terms)) + ")"


STEPS: dict[str, str] = {}

# Survey

STEPS["pre_survey"] = "SELECT * FROM survey_responses WHERE contains(lrn_activity_reference, 'Pre_Survey')"
STEPS["pre_survey_scored"] = "SELECT * FROM pre_survey WHERE lrn_type NOT IN ('shorttext', 'plaintext')"


def _choices(source: str) -> str:
    return f"""SELECT * EXCLUDE (pos, choice), trim(choice) AS response_choice,
  row_number() OVER (PARTITION BY class_id, release, student_id, lrn_question_reference ORDER BY ord, pos) AS "order"
FROM (SELECT s.*, unnest(parts) AS choice, unnest(range(len(parts))) AS pos
      FROM (SELECT *, string_split(trim(regexp_replace(response, '[\\[\\]"]', '', 'g')), ',') AS parts FROM {source}) s
     ) x"""


STEPS["choices_all"] = _choices("pre_survey_scored")
STEPS["choices_x"] = _choices("pre_survey")
STEPS["choices"] = """SELECT * REPLACE (try_cast(response_choice AS double) AS response_choice)
FROM choices_all WHERE response_choice <> 'null' AND response_choice <> ''"""
STEPS["survey_book"] = """SELECT release, lrn_question_reference, "order", variable_name, prompt, lrn_type,
  cast((lrn_option_0 IS NOT NULL)::int + (lrn_option_1 IS NOT NULL)::int + (lrn_option_2 IS NOT NULL)::int AS bigint)
    AS num_response_options
FROM survey_codebook WHERE contains(lrn_activity_reference, 'Pre_Survey')"""


def _coded(choices: str, extra: str, on_release: str) -> str:
    return f"""SELECT c.* EXCLUDE (prompt, lrn_type), c.prompt AS prompt_survey_data, c.lrn_type AS lrn_type_survey_data,
  b.variable_name, b.prompt AS prompt_codebook, b.lrn_type AS lrn_type_codebook, b.num_response_options{extra}
FROM {choices} c LEFT JOIN survey_book b ON {on_release} c.lrn_question_reference = b.lrn_question_reference
  AND c."order" = coalesce(b."order", 1)"""


STEPS["coded"] = _coded("choices", "", "c.release = b.release AND")
STEPS["coded_x"] = _coded("choices_x", ", b.release AS release_codebook", "")


def _collapsed(coded: str) -> str:
    keys = "student_id, class_id, lrn_question_reference"
    kept = (f'ord, {keys}, "order", institution_id, release, book, prompt_codebook')
    return f"""SELECT {kept}, variable_name, num_response_options, try_cast(response_choice AS double) AS response_choice,
  response FROM {coded} WHERE NOT contains(variable_name, 'ma_prep')
UNION ALL
SELECT {kept}, 'ma_prep_combined', 4, n, names FROM (
  SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY "order", variable_name) AS nth,
    cast(count(*) OVER (PARTITION BY {keys}) AS double) AS n,
    string_agg(variable_name, '|') OVER (PARTITION BY {keys} ORDER BY "order", variable_name
      ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS names
  FROM {coded} WHERE contains(variable_name, 'ma_prep')) m WHERE nth = 1"""


STEPS["collapsed"] = _collapsed("coded")
STEPS["collapsed_x"] = _collapsed("coded_x")
STEPS["mapped_raw"] = """SELECT c.*, l.construct, l.scale_values, l.scale_flipped, l.question
FROM collapsed c LEFT JOIN construct_lookup l ON c.variable_name = l.id"""
STEPS["mapped"] = """SELECT * REPLACE (CASE WHEN variable_name = 'ma_prep_combined' THEN 'experience_math'
  ELSE construct END AS construct) FROM mapped_raw"""
STEPS["items"] = "SELECT * FROM mapped WHERE construct IS NOT NULL"
STEPS["items_x"] = """SELECT c.*, l.construct, l.scale_values, l.scale_flipped, l.question
FROM collapsed_x c JOIN construct_lookup l ON c.variable_name = l.id"""
for tag in ("", "_x"):
    STEPS[f"means{tag}"] = f"""SELECT {STUDENT}, construct, avg(response_choice) AS construct_mean,
  count(*) AS construct_responses FROM items{tag} GROUP BY ALL"""

CONSTRUCTS = ["anxiety_math", "stress_expectation", "value_task", "experience_math"]
WIDE = ", ".join(
    f"max(CASE WHEN construct = '{c}' THEN {m} END) AS {m}_{c}"
    for c in CONSTRUCTS for m in ("construct_mean", "construct_responses")
)
for tag in ("", "_x"):
    STEPS[f"wide{tag}"] = f"SELECT {STUDENT}, {WIDE} FROM means{tag} GROUP BY {STUDENT}"
WIDE_OUT = ", ".join([*[r6(f"construct_mean_{c}", f"construct_mean_{c}") for c in CONSTRUCTS],
                      *[f"construct_responses_{c}" for c in CONSTRUCTS]])

# Engagement

STEPS["parsed"] = """SELECT * REPLACE (trim(page) AS page), try_cast(dt_accessed AS timestamp) AS ts FROM page_views"""
STEPS["enriched"] = f"""SELECT v.*, c.release, c.book, p.chapter_num, p.page_num FROM parsed v
LEFT JOIN classes c ON v.institution_id = c.institution_id AND v.class_id = c.class_id
LEFT JOIN page_codebook p ON c.release = p.release AND c.book = p.book AND v.chapter = p.chapter AND v.page = p.page
WHERE p.chapter_num IS NOT NULL"""
STEPS["enriched_x"] = """SELECT v.*, c.release, c.book FROM parsed v
LEFT JOIN classes c ON v.institution_id = c.institution_id AND v.class_id = c.class_id WHERE v.chapter IS NOT NULL"""
for tag, ch in (("", "chapter_num"), ("_x", "chapter")):
    STEPS[f"first{tag}"] = f"""SELECT * FROM enriched{tag} WHERE was_complete = 'true'
QUALIFY row_number() OVER (PARTITION BY class_id, student_id, {ch}, page ORDER BY ts NULLS LAST, ord) = 1"""
    STEPS[f"page_totals{tag}"] = f"""SELECT class_id, {ch}, count(DISTINCT page) AS total_unique_pages_complete_class
FROM first{tag} GROUP BY class_id, {ch}"""
    STEPS[f"progress{tag}"] = f"""SELECT f.*, total_unique_pages_complete_class,
  row_number() OVER (PARTITION BY f.class_id, student_id, f.{ch} ORDER BY ts, page) AS pages_complete_so_far,
  count(*) OVER (PARTITION BY f.class_id, student_id, f.{ch}) AS total_unique_pages_complete_student
FROM first{tag} f JOIN page_totals{tag} t ON f.class_id = t.class_id AND f.{ch} = t.{ch}"""
    STEPS[f"engaged{tag}"] = f"""SELECT DISTINCT book, release, institution_id, class_id, student_id, chapter,
  {'chapter_num, ' if not tag else ''}total_unique_pages_complete_class,
  total_unique_pages_complete_student / total_unique_pages_complete_class AS proportion_pages_complete_student
FROM progress{tag}"""
STEPS["class_pages"] = """SELECT class_id, page, arg_min(chapter_num, (student_id, chapter_num)) AS chapter_num
FROM first GROUP BY class_id, page"""
STEPS["halves"] = f"""SELECT *, count(*) OVER (PARTITION BY iter, class_id, split) AS split_total,
  count(*) OVER (PARTITION BY iter, class_id) AS total_unique_pages_accessed_class FROM (
  SELECT i.iter, class_id, chapter_num, page, (row_number() OVER (PARTITION BY i.iter, class_id
    ORDER BY md5(concat_ws('|', '130', i.iter, class_id, page)), page) - 1) % 2 + 1 AS split
  FROM class_pages, range(1, {ITERATIONS + 1}) i(iter)) s"""
STEPS["half_scores"] = f"""SELECT i.iter, f.institution_id, f.class_id, f.student_id,
  nullif(count(*) FILTER (split = 1), 0) / max(split_total) FILTER (split = 1) AS half_1,
  nullif(count(*) FILTER (split = 2), 0) / max(split_total) FILTER (split = 2) AS half_2
FROM first f CROSS JOIN range(1, {ITERATIONS + 1}) i(iter)
LEFT JOIN halves h ON h.iter = i.iter AND h.class_id = f.class_id AND h.chapter_num = f.chapter_num AND h.page = f.page
GROUP BY ALL"""
STEPS["half_ranks"] = """SELECT *,
  rank() OVER (PARTITION BY iter ORDER BY half_1) + (count(*) OVER (PARTITION BY iter, half_1) - 1) / 2 AS rank_1,
  rank() OVER (PARTITION BY iter ORDER BY half_2) + (count(*) OVER (PARTITION BY iter, half_2) - 1) / 2 AS rank_2
FROM half_scores WHERE half_1 IS NOT NULL AND half_2 IS NOT NULL"""
STEPS["reliability"] = """SELECT *, 2 * pearson / (1 + pearson) AS spearman_brown FROM (
  SELECT iter, count(*) AS n,
    CASE WHEN min(half_1) < max(half_1) AND min(half_2) < max(half_2) THEN corr(half_1, half_2) END AS pearson,
    CASE WHEN min(half_1) < max(half_1) AND min(half_2) < max(half_2) THEN corr(rank_1, rank_2) END AS spearman
  FROM half_ranks GROUP BY iter) x"""

# Quiz

STEPS["review"] = """SELECT * REPLACE (trim(page) AS page) FROM quiz_responses
WHERE contains(page, 'Review Questions') AND lrn_type = 'mcq'"""
STEPS["quiz_limits"] = """SELECT book, release, chapter, chapter_num, sum(mcq) AS mcq, sum(plaintext) AS plaintext
FROM quiz_codebook WHERE contains(page, 'Review') GROUP BY ALL"""
STEPS["quizzes"] = """SELECT s.*, l.mcq AS n_total, n_correct / nullif(l.mcq, 0) AS eoc_score FROM (
  SELECT r.book, r.release, institution_id, class_id, student_id, r.chapter, chapter_num,
    count(*) AS questions_submitted, coalesce(sum(points_earned), 0) AS n_correct,
    coalesce(sum(points_possible), 0) AS n_attempted
  FROM review r LEFT JOIN quiz_codebook q
    ON r.book = q.book AND r.release = q.release AND r.chapter = q.chapter AND r.page = q.page
  GROUP BY ALL) s LEFT JOIN quiz_limits l
  ON s.book = l.book AND s.release = l.release AND s.chapter = l.chapter AND s.chapter_num = l.chapter_num"""
STEPS["page_numbers"] = r"""SELECT release, book, chapter, page, chapter_num,
  CASE WHEN contains(num, '.10') OR (t > 0.010::double AND t < 0.019::double) THEN t * 10 ELSE t END * 100 AS page_num
FROM (SELECT *, round((try_cast(num AS double) - chapter_num) / 10, 3) AS t FROM (
  SELECT DISTINCT c.release, c.book, v.chapter, v.page,
    try_cast(regexp_replace(v.chapter, '\D', '', 'g') AS double) AS chapter_num,
    nullif(regexp_extract(CASE WHEN length(v.page) > 8 THEN v.page[1:5] || '...' ELSE v.page END, '\d+\.*\d*'), '') AS num
  FROM page_views v LEFT JOIN classes c ON v.institution_id = c.institution_id AND v.class_id = c.class_id) a) b
WHERE t IS NOT NULL"""
STEPS["review_x"] = """SELECT r.*, p.chapter_num FROM review r LEFT JOIN page_numbers p
  ON r.book = p.book AND r.release = p.release AND r.chapter = p.chapter AND r.page = p.page"""
STEPS["quizzes_x"] = f"""SELECT s.*, n_total, n_correct / n_total AS eoc_score FROM (
  SELECT book, release, institution_id, class_id, student_id, chapter, chapter_num, count(*) AS questions_submitted,
    coalesce(sum(points_earned), 0) AS n_correct FROM review_x GROUP BY ALL) s
JOIN (SELECT class_id, chapter, chapter_num, cast(count(DISTINCT lrn_question_reference) AS double) AS n_total
  FROM review_x GROUP BY ALL) t ON {same("s", "t", "class_id, chapter, chapter_num")}"""

# Merge

for tag, keys in (("", "chapter, chapter_num"), ("_x", "chapter")):
    STEPS[f"merged{tag}"] = f"""SELECT w.*, e.* EXCLUDE ({STUDENT}), q.* EXCLUDE ({STUDENT}, {keys})
FROM wide{tag} w JOIN engaged{tag} e ON {same("w", "e", STUDENT)}
JOIN quizzes{tag} q ON {same("e", "q", STUDENT + ", " + keys)}"""
STEPS["frame"] = """SELECT class_id, student_id, chapter_num, proportion_pages_complete_student,
  construct_mean_anxiety_math, construct_mean_stress_expectation, eoc_score FROM merged
WHERE proportion_pages_complete_student IS NOT NULL AND construct_mean_anxiety_math IS NOT NULL
  AND construct_mean_stress_expectation IS NOT NULL AND eoc_score IS NOT NULL AND chapter_num IS NOT NULL"""
STEPS["averages"] = """SELECT class_id, student_id, min(chapter_num) AS chapter_num,
  min_by(construct_mean_anxiety_math, chapter_num) AS construct_mean_anxiety_math,
  min_by(construct_mean_stress_expectation, chapter_num) AS construct_mean_stress_expectation,
  avg(proportion_pages_complete_student) AS avg_prop_pages_complete, avg(eoc_score) AS avg_eoc_score
FROM frame GROUP BY class_id, student_id"""
STEPS["demographics"] = """SELECT * REPLACE (trim(variable_name) AS variable_name),
  CASE response_choice WHEN 0 THEN 'Male' WHEN 1 THEN 'Female' WHEN 2 THEN 'Non-binary'
    WHEN 3 THEN 'Prefer to self-describe' END AS response_label
FROM coded WHERE trim(variable_name) IN ('gender', 'race1', 'year')"""
STEPS["labels_wide"] = """SELECT m.class_id, m.student_id, max(response_label) AS gender,
  cast(NULL AS varchar) AS race1, cast(NULL AS varchar) AS year
FROM (SELECT DISTINCT class_id, student_id FROM merged) m
LEFT JOIN demographics d ON m.class_id = d.class_id AND m.student_id = d.student_id
GROUP BY m.class_id, m.student_id"""

# Descriptives


def _pairs(source: str, cols: list[str]) -> str:
    return " UNION ALL ".join(
        f"SELECT '{a}' AS var_i, '{b}' AS var_j, regr_count({b}, {a}) AS n, regr_sxx({b}, {a}) AS sxx, "
        f"regr_syy({b}, {a}) AS syy, regr_sxy({b}, {a}) AS sxy FROM {source}"
        for i, a in enumerate(cols) for b in cols[i + 1:]
    )


def _correlations(moments: str) -> str:
    return f"""SELECT *, CASE WHEN p IS NOT NULL THEN least(1.0, max(p * (m - nth + 1)) OVER (
  ORDER BY p NULLS LAST, var_i, var_j ROWS UNBOUNDED PRECEDING)) END AS p_holm FROM (
  SELECT *, row_number() OVER (ORDER BY p NULLS LAST, var_i, var_j) AS nth, count(p) OVER () AS m FROM (
    SELECT *, CASE WHEN abs(r) >= 1 THEN 0.0 ELSE {t_tail("t", "(n - 2.0)")} END AS p FROM (
      SELECT *, CASE WHEN abs(r) < 1 AND n > 2 THEN r * sqrt((n - 2) / (1 - r * r)) END AS t FROM (
        SELECT *, sxy / sqrt(nullif(sxx * syy, 0)) AS r FROM {moments}) a) b) c) d"""


STEPS["pair_moments"] = _pairs("profiles", FEATURES)
STEPS["correlations"] = _correlations("pair_moments")
STEPS["pair_moments_merged"] = _pairs("averages", MERGED_MEASURES)
STEPS["correlations_merged"] = _correlations("pair_moments_merged")
STEPS["graded"] = "SELECT * FROM averages JOIN assessments USING (student_id) WHERE quiz_mean IS NOT NULL"
STEPS["pair_moments_wide"] = _pairs("wide", [f"construct_mean_{c}" for c in CONSTRUCTS])
STEPS["correlations_wide"] = _correlations("pair_moments_wide")


def _density(source: str, x: str, group: str, adjust: float, low: str, high: str, keep: str) -> str:
    return f"""WITH v AS (SELECT {group} AS g, cast({x} AS double) AS x FROM {source} WHERE {x} IS NOT NULL {keep}),
span AS (SELECT cast({low} AS double) AS lo, cast({high} AS double) AS hi FROM v),
stat AS (SELECT g, count(*) AS n, min(x) AS lowest, (max(x) - min(x)) / {DENSITY_CELLS - 1} AS width,
  {0.9 * adjust!r}::double * coalesce(
    nullif(least(stddev_samp(x), (quantile_cont(x, 0.75) - quantile_cont(x, 0.25)) / 1.34::double), 0),
    nullif(stddev_samp(x), 0), nullif(abs(min(x)), 0), 1) * pow(count(*), -0.2::double) AS bw FROM v GROUP BY g),
in_cell AS (SELECT g, spot, least(floor(spot), {DENSITY_CELLS - 2}) AS cell
  FROM (SELECT g, CASE WHEN width > 0 THEN (x - lowest) / width ELSE 0 END AS spot FROM v JOIN stat USING (g))),
cell_sums AS (SELECT g, cell, sum(w) AS w FROM (
  SELECT g, cell, 1 - (spot - cell) AS w FROM in_cell UNION ALL SELECT g, cell + 1, spot - cell FROM in_cell) GROUP BY g, cell)
SELECT g AS {group}, i AS grid_index, {r6("lo + i * (hi - lo) / 511", "x")},
  {r6("sum(w * exp(-0.5::double * pow((lo + i * (hi - lo) / 511 - (lowest + cell * width)) / bw, 2))) / (any_value(n) * any_value(bw) * sqrt(2 * pi()))", "density")}
FROM cell_sums JOIN stat USING (g) CROSS JOIN span CROSS JOIN range(512) r(i) GROUP BY g, i, lo, hi"""


# Clusters: the few variables allow every partition to be looked at.

for _tail in ("", "_merged"):
    STEPS[f"profile_cells{_tail}"] = f"""SELECT var_i, var_j, r FROM correlations{_tail}
UNION ALL SELECT var_j, var_i, r FROM correlations{_tail}
UNION ALL SELECT DISTINCT var_i, var_i, 1.0::double FROM (
  SELECT var_i FROM correlations{_tail} UNION ALL SELECT var_j FROM correlations{_tail}) v"""
    STEPS[f"scaled_cells{_tail}"] = f"""SELECT var_i, var_j,
  (r - avg(r) OVER (PARTITION BY var_j)) / stddev_samp(r) OVER (PARTITION BY var_j) AS r FROM profile_cells{_tail}"""
for _tag, _source in (("scaled", "scaled_cells"), ("plain", "profile_cells"),
                      ("scaled_merged", "scaled_cells_merged"), ("plain_merged", "profile_cells_merged")):
    STEPS[f"apart_{_tag}"] = f"""SELECT a.var_i AS v, b.var_i AS u, sum(pow(a.r - b.r, 2)) AS d2
FROM {_source} a JOIN {_source} b USING (var_j) GROUP BY ALL"""


def partitions(tag: str, variables: list[str], ks: str) -> str:
    """Every partition into ``ks`` blocks (numbered by smallest member) with its cost, and the cheapest per k."""
    return f"""WITH RECURSIVE grown AS (
  SELECT [1] AS blocks, 1 AS k UNION ALL
  SELECT list_append(blocks, n), greatest(k, n) FROM grown, range(1, {len(variables) + 1}) t(n)
  WHERE n <= k + 1 AND len(blocks) < {len(variables)}),
numbered AS (SELECT *, row_number() OVER (ORDER BY blocks) AS id FROM grown WHERE len(blocks) = {len(variables)} AND k IN {ks}),
member AS (SELECT id, k, v, block FROM (SELECT id, k, unnest({variables!r}) AS v, unnest(blocks) AS block FROM numbered) m),
block_cost AS (
  SELECT a.id, a.k, a.block, sum(d2) / 2 / count(DISTINCT a.v) AS cost
  FROM member a JOIN member b ON a.id = b.id AND a.block = b.block JOIN apart_{tag} d ON d.v = a.v AND d.u = b.v GROUP BY ALL),
cheapest AS (
  SELECT id, k, cost FROM (SELECT id, k, sum(cost) AS cost FROM block_cost GROUP BY id, k)
  QUALIFY row_number() OVER (PARTITION BY k ORDER BY cost, id) = 1)"""


# Models

STEPS["outcomes"] = """SELECT *, y + class_id * 0.02::double + c1 * 0.2::double AS outcome FROM profiles"""
STEPS["conditions"] = """SELECT *, CASE WHEN module_variation = 'B' THEN 1.0::double ELSE 0.0::double END AS arm_b
FROM condition_survey"""
for _tail, _students, _rows in (("", "profiles", "outcomes"), ("_merged", "averages", "averages")):
    STEPS[f"slots{_tail}"] = f"""SELECT class_id, student_id, row_number() OVER (PARTITION BY class_id ORDER BY student_id) AS slot,
  count(*) OVER (PARTITION BY class_id) AS size FROM (SELECT DISTINCT class_id, student_id FROM {_students}) e"""
    STEPS[f"resample{_tail}"] = f"""SELECT d.iter, d.class_id, s.student_id, count(*) AS w FROM (
  SELECT i.iter, class_id,
    ('0x' || substr(md5(concat_ws('|', '123', i.iter, class_id, slot)), 1, 8))::bigint % size + 1 AS pick
  FROM slots{_tail}, range(1, {ITERATIONS + 1}) i(iter)) d
JOIN slots{_tail} s ON d.class_id = s.class_id AND d.pick = s.slot GROUP BY ALL"""
    STEPS[f"drawn{_tail}"] = f"""SELECT r.iter, o.* FROM resample{_tail} r JOIN {_rows} o USING (class_id, student_id), range(r.w) k"""


class Sweep:
    """Linear systems solved column by column with Goodnight's symmetric sweep operator."""

    def __init__(self, size: int):
        self.size = size

    def cells(self) -> list[tuple[int, int]]:
        return [(i, j) for i in range(self.size) for j in range(i, self.size)]

    @staticmethod
    def name(i: int, j: int) -> str:
        return f"a_{min(i, j)}_{max(i, j)}"

    def step(self, source: str, pivot: int, carry: str) -> str:
        d = self.name(pivot, pivot)
        parts = []
        for i, j in self.cells():
            a = self.name(i, j)
            if i == j == pivot:
                new = f"-1 / {d}"
            elif pivot in (i, j):
                new = f"{a} / {d}"
            else:
                new = f"{a} - {self.name(i, pivot)} * {self.name(pivot, j)} / {d}"
            parts.append(f"CASE WHEN u_{pivot} THEN {new} ELSE {a} END AS {a}")
        return f"SELECT {carry}, {', '.join(parts)} FROM {source}"


def sweep_chain(prefix: str, source: str, size: int, carry: str) -> tuple[list[str], str]:
    """Steps sweeping every used column but the last (the outcome); returns them and the final name."""
    sweep, steps, at = Sweep(size), [], source
    for pivot in range(size - 1):
        steps.append(f"{prefix}{pivot} AS MATERIALIZED ({sweep.step(at, pivot, carry)})")
        at = f"{prefix}{pivot}"
    return steps, at


def _spec_rows(specs: dict[str, list[str]], xs: list[str]) -> str:
    rows = [
        "(" + ", ".join([f"'{name}'", "true", *[str(x in used).lower() for x in xs]]) + ")" for name, used in specs.items()
    ]
    names = ", ".join(["model", *[f"u_{i}" for i in range(len(xs) + 1)]])
    return f"SELECT * FROM (VALUES {', '.join(rows)}) s({names})"


def ols_sql(source: str, y: str, specs: dict[str, list[str]], final: str) -> str:
    xs = list(dict.fromkeys(x for used in specs.values() for x in used))
    z = ["1.0::double", *xs, y]
    sweep = Sweep(len(z))
    flags = ", ".join(f"u_{i}" for i in range(len(xs) + 1))
    carry = f"model, {flags}, n"
    sums = ", ".join(f"sum(({z[i]}) * ({z[j]})) AS {sweep.name(i, j)}" for i, j in sweep.cells())
    steps, last = sweep_chain("o", "o_start", len(z), carry)
    begin = [
        f"o_specs AS ({_spec_rows(specs, xs)})",
        f"o_sums AS (SELECT count(*) AS n, {sums} FROM {source})",
        "o_start AS (SELECT * FROM o_sums, o_specs)",
    ]
    k = len(xs) + 1
    used = " + ".join(f"u_{i}::int" for i in range(k))
    terms = " UNION ALL ".join(
        f"SELECT model, '{'(Intercept)' if i == 0 else xs[i - 1]}' AS term, {Sweep.name(i, k)} AS estimate, n, "
        f"n - ({used}) AS df_residual, {Sweep.name(k, k)} AS rss, "
        f"sqrt({Sweep.name(k, k)} / (n - ({used})) * -{Sweep.name(i, i)}) AS std_error FROM {last} WHERE u_{i}"
        for i in range(k)
    )
    return f"WITH {', '.join([*begin, *steps])}, fits AS ({terms}) {final}"


LEVELS = 6


def mixed_sql(source: str, y: str, group: str, specs: dict[str, list[str]], final: str, by: str = "") -> str:
    """Random-intercept fits: the best theta of a coarse grid by deviance, then finer grids around the sign
    change of its derivative by theta squared, and linear interpolation in the last one."""
    xs = list(dict.fromkeys(x for used in specs.values() for x in used))
    z = ["1.0::double", *xs, y]
    k = len(z) - 1
    sweep = Sweep(len(z))
    lead = f"{by}, " if by else ""
    using = f"USING ({by})" if by else "ON true"
    flags = ", ".join(f"u_{i}" for i in range(k))
    sums = ", ".join(f"sum(({z[i]}) * ({z[j]})) AS s_{i}_{j}" for i, j in sweep.cells())
    totals = ", ".join(f"sum(s_{i}_{j}) AS s_{i}_{j}" for i, j in sweep.cells())
    shrunk = ", ".join(
        f"any_value(m.s_{i}_{j}) - sum(theta * theta / (1 + g.s_0_0 * theta * theta) * g.s_0_{i} * g.s_0_{j}) AS {sweep.name(i, j)}"
        for i, j in sweep.cells()
    )
    # The derivative of every shrunken product by theta squared.
    moved = ", ".join(
        f"-sum(g.s_0_{i} * g.s_0_{j} / pow(1 + g.s_0_0 * theta * theta, 2)) AS d_{i}_{j}" for i, j in sweep.cells())
    carried = ", ".join(f"d_{i}_{j}" for i, j in sweep.cells())
    residual = [*[f"(CASE WHEN u_{i} THEN -{sweep.name(i, k)} ELSE 0 END)" for i in range(k)], "1"]
    change = " + ".join(f"{1 if i == j else 2} * {residual[i]} * {residual[j]} * d_{i}_{j}" for i, j in sweep.cells())
    slope = f"n * ({change}) / {sweep.name(k, k)} + log_slope"
    ctes = [
        f"x_specs AS ({_spec_rows(specs, xs)})",
        f"x_groups AS MATERIALIZED (SELECT {lead}{group}, {sums} FROM {source} GROUP BY {lead}{group})",
        f"x_totals AS MATERIALIZED (SELECT {lead}{totals} FROM x_groups GROUP BY {by or '()'})",
        f"x_grid0 AS (SELECT {lead}x_specs.*, t.theta FROM x_totals, x_specs, (SELECT 0.0::double AS theta UNION ALL "
        "SELECT pow(10.0, k / 8.0 - 4) FROM range(65) r(k)) t)",
    ]
    for level in range(LEVELS):
        carry = f"{lead}model, {flags}, theta, n, logs, log_slope, {carried}"
        ctes.append(
            f"x_start{level} AS MATERIALIZED (SELECT {lead}model, {flags}, theta, any_value(m.s_0_0) AS n, "
            f"sum(ln(1 + g.s_0_0 * theta * theta)) AS logs, sum(g.s_0_0 / (1 + g.s_0_0 * theta * theta)) AS log_slope, {moved}, {shrunk} "
            f"FROM x_grid{level} t JOIN x_totals m {using} JOIN x_groups g {using} GROUP BY {lead}model, {flags}, theta)"
        )
        steps, last = sweep_chain(f"x{level}_", f"x_start{level}", len(z), carry)
        ctes += steps
        dev = f"n * (ln(2 * pi() * {sweep.name(k, k)} / n) + 1) + logs"
        if level == 0:
            window = f"PARTITION BY {lead}model ORDER BY theta"
            ctes.append(
                f"x_cut0 AS MATERIALIZED (SELECT * EXCLUDE (below, above), coalesce(below, theta) AS low, coalesce(above, theta) AS high FROM ("
                f"SELECT {lead}model, {flags}, theta, {dev} AS deviance, lag(theta) OVER ({window}) AS below, lead(theta) OVER ({window}) AS above "
                f"FROM {last}) q QUALIFY row_number() OVER (PARTITION BY {lead}model ORDER BY deviance, theta) = 1)")
        elif level < LEVELS - 1:
            ctes.append(
                f"x_slope{level} AS MATERIALIZED (SELECT {lead}model, {flags}, theta, {slope} AS slope FROM {last})")
            ctes.append(
                f"x_cut{level} AS MATERIALIZED (SELECT {lead}model, {flags}, coalesce(max(theta) FILTER (slope < 0), min(theta)) AS low, "
                f"CASE WHEN count(*) FILTER (slope < 0) = 0 THEN min(theta) ELSE coalesce(min(theta) FILTER (slope >= 0), max(theta)) END AS high, "
                f"arg_max(slope, theta) FILTER (slope < 0) AS falling, arg_min(slope, theta) FILTER (slope >= 0) AS rising "
                f"FROM x_slope{level} GROUP BY {lead}model, {flags})")
        else:
            ctes.append(f"x_best AS MATERIALIZED (SELECT *, {dev} AS deviance FROM {last})")
        if level < LEVELS - 2:
            ctes.append(
                f"x_grid{level + 1} AS (SELECT DISTINCT {lead}model, {flags}, low + (high - low) * k / 40.0 AS theta FROM x_cut{level}, range(41) r(k))")
        elif level == LEVELS - 2:
            ctes.append(
                f"x_grid{level + 1} AS (SELECT {lead}model, {flags}, CASE WHEN high > low AND rising > falling "
                f"THEN low - falling * (high - low) / (rising - falling) ELSE low END AS theta FROM x_cut{level})")
    used = " + ".join(f"u_{i}::int" for i in range(k))
    ctes.append(
        f"models AS (SELECT *, cast(n AS bigint) AS rows, {used} + 2 AS n_params, sqrt({sweep.name(k, k)} / n) AS sigma, "
        f"-deviance / 2 AS log_likelihood, deviance + 2 * ({used} + 2) AS aic FROM x_best)"
    )
    terms = " UNION ALL ".join(
        f"SELECT *, '{'(Intercept)' if i == 0 else xs[i - 1]}' AS term, {sweep.name(i, k)} AS estimate, "
        f"sigma * sqrt(-{sweep.name(i, i)}) AS std_error FROM models WHERE u_{i}" for i in range(k)
    )
    ctes.append(f"fits AS ({terms})")
    return f"WITH {', '.join(ctes)} {final}"


def with_steps(sql: str) -> str:
    """Prefix the steps and roles the text mentions, in dependency order."""
    known = {**{name: duckdb_sql(name) for name in ROLES}, **STEPS}
    needed: dict[str, None] = {}

    def visit(text: str) -> None:
        for word in dict.fromkeys(re.findall(r"[a-z_0-9]+", text)):
            if word in known and word not in needed:
                visit(known[word])
                needed[word] = None

    visit(sql)
    if not needed:
        return sql
    ctes = ",\n".join(f"{name} AS ({known[name]})" for name in needed)
    if sql.lstrip().startswith("WITH RECURSIVE "):
        return f"WITH RECURSIVE {ctes},\n{sql.lstrip()[15:]}"
    if sql.lstrip().startswith("WITH "):
        return f"WITH {ctes},\n{sql.lstrip()[5:]}"
    return f"WITH {ctes}\n{sql}"


ITEM = "class_id, release, student_id, lrn_question_reference"
CODED = ('ord, student_id, variable_name, prompt_survey_data, prompt_codebook, lrn_type_survey_data, '
         'lrn_type_codebook, num_response_options, "order", response_choice')
MAPPED = ('ord, student_id, "order", variable_name, ' + r6("response_choice", "response_choice") +
          ", construct, scale_values, scale_flipped, question")
PROGRESS = ("class_id, student_id, page, pages_complete_so_far, total_unique_pages_complete_student, "
            "total_unique_pages_complete_class, "
            + r6("pages_complete_so_far / total_unique_pages_complete_class", "proportion_pages_complete_so_far") + ", "
            + r6("total_unique_pages_complete_student / total_unique_pages_complete_class", "proportion_pages_complete_student"))
ENGAGED = ("book, release, institution_id, class_id, student_id, chapter, {num}total_unique_pages_complete_class, "
           + r6("proportion_pages_complete_student", "proportion_pages_complete_student"))
QUIZ = ("book, release, institution_id, class_id, student_id, chapter, chapter_num, questions_submitted, "
        + ", ".join(r6(c, c) for c in ("n_correct", "n_total", "eoc_score")))
MERGED = (f"{STUDENT}, {WIDE_OUT}, chapter, chapter_num, total_unique_pages_complete_class, "
          + r6("proportion_pages_complete_student", "proportion_pages_complete_student")
          + ", questions_submitted, " + ", ".join(r6(c, c) for c in ("n_correct", "n_total", "eoc_score")))
FRAME = ("class_id, student_id, chapter_num, " + ", ".join(r6(c, c) for c in (
    "proportion_pages_complete_student", "construct_mean_anxiety_math", "construct_mean_stress_expectation", "eoc_score")))
AVERAGES = ("class_id, student_id, chapter_num, " + ", ".join(r6(c, c) for c in (
    "construct_mean_anxiety_math", "construct_mean_stress_expectation", "avg_prop_pages_complete", "avg_eoc_score")))
CORRELATIONS = "var_i, var_j, n, " + ", ".join(r6(c, c) for c in ("r", "t", "p", "p_holm"))
MIXED = ("model, term, rows AS n, n_params, " + r6("theta * sigma", "group_sd") + ", "
         + ", ".join(r6(c, c) for c in ("theta", "estimate", "std_error", "sigma", "log_likelihood", "aic")))
REL = "aic - max(aic) FILTER (model = '{}') OVER ({})"


def _ols_terms() -> str:
    p = t_tail("(estimate / std_error)", "(df_residual * 1.0)")
    return ("SELECT model, term, n, df_residual, " + ", ".join([
        r6("estimate", "estimate"), r6("std_error", "std_error"), r6("estimate / std_error", "t_value"),
        r6(p, "p_value"), r6("rss", "rss")]) + " FROM fits")


def _f_test(smaller: str, larger: str) -> str:
    p = f_tail("f_value", "(df_model * 1.0)", "(df_residual * 1.0)")
    return f"""SELECT '{smaller}' AS model_0, '{larger}' AS model_1, df_model, df_residual,
  {r6("rss0", "rss0")}, {r6("rss1", "rss1")}, {r6("f_value", "f_value")}, {r6(p, "p_value")} FROM (
  SELECT *, (rss0 - rss1) / df_model / (rss1 / df_residual) AS f_value FROM (
    SELECT max(rss) FILTER (model = '{smaller}') AS rss0, max(rss) FILTER (model = '{larger}') AS rss1,
      max(df_residual) FILTER (model = '{smaller}') - max(df_residual) FILTER (model = '{larger}') AS df_model,
      max(df_residual) FILTER (model = '{larger}') AS df_residual FROM fits) a) b"""


def _bootstrap(final: str) -> str:
    return mixed_sql("drawn", "outcome", "class_id", QUIZ_MODELS, final, by="iter")


def _summary(actual: str) -> str:
    """Mean and interval of the relative AICs over iterations, beside those of the actual data."""
    return f"""SELECT model, {r6("avg(rel)", "mean")}, {r6("quantile_cont(rel, 0.025)", "lb")},
  {r6("quantile_cont(rel, 0.975)", "ub")}, {r6("any_value(aic_value)", "aic_value")}
FROM (SELECT iter, model, {REL.format("baseline", "PARTITION BY iter")} AS rel FROM models) r
LEFT JOIN ({actual}) actual USING (model) GROUP BY model"""


def _relative_columns() -> str:
    columns = [r6(f"max(aic) FILTER (model = '{m}') - max(aic) FILTER (model = 'baseline')", f"rel_{m}") for m in QUIZ_MODELS]
    columns += [
        r6(f"max(aic) FILTER (model = '{m}') - max(aic) FILTER (model = 'nervous_confval')", f"nervous_confval_rel_{m}")
        for m in ("attitudes", "nervous_confval")
    ]
    return ", ".join(columns)


def sql_g11(source: str, x: str, y: str) -> str:
    """Pearson test with the interval of Fisher's transformation."""
    half = "1.959963984540054::double / sqrt(n - 3)"
    return f"""SELECT '{x}' AS x, '{y}' AS y, n, n - 2 AS df, {r6("r", "r")}, {r6("t", "t")},
  {r6(t_tail("t", "(n - 2.0)"), "p")}, {r6(f"tanh(atanh(r) - {half})", "lower")}, {r6(f"tanh(atanh(r) + {half})", "upper")}
FROM (SELECT *, r * sqrt((n - 2) / (1 - r * r)) AS t FROM (SELECT count(*) AS n, corr({x}, {y}) AS r FROM {source}) a) b"""


# Integer columns DuckDB types more narrowly than the registered query, which reports bigint.
BIGINT = {
    "a1_read_table": ["c_nationkey"],
    "a2_drop_index_column": ["s_nationkey"],
    **dict.fromkeys(["b9_attach_construct", "b9_attach_construct_experimental"], ["scale_values"]),
    **dict.fromkeys([
        "c2_codebook_totals", "c3_score_quiz_codebook", "d3_first_completion", "d4_class_page_totals",
        "d5_running_progress", "d6_engagement_summary", "d7_split_half_assign", "e6_merge_sources", "e6_merge_sources_bucketed", "f3_model_frame",
        "f4_entity_average", "f8_density_by_group", "f11_row_mean", "f12_attach_assessment",
    ], ["chapter_num"]),
    "d2_enrich_views": ["chapter_num", "page_num"],
    **dict.fromkeys(["f5_correlation_matrix", "f5_correlation_matrix_pairwise", "f5_correlation_matrix_merged"], ["n"]),
    **dict.fromkeys(["f8_density_by_group_open", "g5_stratified_resample"], ["class_id"]),
    **dict.fromkeys(["g1_fit_random_intercept", "g1_fit_random_intercept_boundary", "g4_model_sweep", "g4_model_sweep_merged",
                     "g4_model_sweep_merged_quiz"], ["n_params"]),
}


def _audits(source: str, audits: dict[str, tuple[list[str], int]]) -> str:
    """One grouping per audit; keys an audit does not use are missing."""
    columns = list(dict.fromkeys(k for keys, _ in audits.values() for k in keys))
    return " UNION ALL ".join(
        f"SELECT '{name}' AS audit, {', '.join(r6(c, c) if c == 'chapter_num' else c for c in columns)}, nrows FROM ("
        f"SELECT {', '.join(c if c in keys else f'NULL AS {c}' for c in columns)}, count(*) AS nrows FROM {source} "
        f"GROUP BY {', '.join(keys)} HAVING count(*) > {most}) {name}" for name, (keys, most) in audits.items())


def _choose_k(tag: str, variables: list[str], ks: str) -> str:
    """Mean Euclidean silhouette of the cheapest partition per k."""
    return partitions(tag, variables, ks) + f""",
near AS (
  SELECT a.id, a.k, a.v, a.block AS own, b.block AS other, sum(sqrt(d2)) AS total, count(*) AS n
  FROM cheapest c JOIN member a USING (id, k) JOIN member b ON b.id = a.id JOIN apart_{tag} d ON d.v = a.v AND d.u = b.v GROUP BY ALL),
widths AS (
  SELECT k, v, max(n) FILTER (own = other) AS size, max(total) FILTER (own = other) / nullif(max(n) FILTER (own = other) - 1, 0) AS a,
    min(total / n) FILTER (own <> other) AS b FROM near GROUP BY k, v),
silhouettes AS (SELECT k, avg(CASE WHEN size = 1 THEN 0 ELSE (b - a) / greatest(a, b) END) AS silhouette FROM widths GROUP BY k)
SELECT cast(k AS bigint) AS k, {r6("cost", "cost")}, {r6("silhouette", "silhouette")},
  silhouette = max(silhouette) OVER () AS best, true AS converged FROM silhouettes JOIN cheapest USING (k)"""


def _cluster_profiles(tag: str, variables: list[str], correlations: str) -> str:
    """The correlation table with the clusters of the cheapest partition in two."""
    diagonal = " UNION ALL ".join(f"SELECT '{c}', '{c}', 1.0::double, 0.0::double" for c in variables)
    return partitions(tag, variables, "(2)") + f""",
chosen AS (SELECT v, cast(block AS bigint) AS block FROM cheapest JOIN member USING (id, k)),
shown AS (SELECT var_i, var_j, r, p_holm AS p FROM {correlations} UNION ALL SELECT var_j, var_i, r, p FROM {correlations}
  UNION ALL {diagonal}),
lead AS (SELECT c.v, dense_rank() OVER (ORDER BY first) AS block FROM (SELECT v, min(v) OVER (PARTITION BY block) AS first FROM chosen) c)
SELECT var_i, i.block AS cluster_i, var_j, j.block AS cluster_j, {r6("r", "r")}, {r6("p", "p")}
FROM shown JOIN lead i ON i.v = var_i JOIN lead j ON j.v = var_j"""


def _condition_effects(final: str) -> str:
    """Outcomes of merged students in both arms, one row per student and outcome."""
    return f"""WITH placed AS (SELECT DISTINCT student_id, module_variation AS arm FROM condition_survey WHERE module_variation IN ('A', 'B')),
measured AS (
  SELECT outcome, arm, y FROM (
    SELECT arm, avg_eoc_score, avg_prop_pages_complete FROM averages JOIN placed USING (student_id)
    WHERE avg_eoc_score IS NOT NULL AND avg_prop_pages_complete IS NOT NULL) m
  UNPIVOT (y FOR outcome IN (avg_eoc_score, avg_prop_pages_complete))),
arms AS (SELECT outcome, arm, count(*) AS n, avg(y) AS m, var_pop(y) * count(*) AS ss FROM measured GROUP BY ALL),
outcomes_ AS (
  SELECT outcome, sum(n) AS total, sum(ss) AS rss1, count(*) AS groups, any_value(rss0) AS rss0
  FROM arms JOIN (SELECT outcome, var_pop(y) * count(*) AS rss0 FROM measured GROUP BY outcome) w USING (outcome) GROUP BY outcome)
{final}"""


def oracle() -> dict[str, str]:
    """SQL per registered query."""
    sql: dict[str, str] = {}
    sql["a1_read_table"] = "SELECT * REPLACE (round(c_acctbal, 6) AS c_acctbal) FROM customer"
    sql["a1_read_table_csv"] = "SELECT doc_id, lang, text FROM documents"
    shaped = "c_custkey % 50 NOT IN (0, 1)"
    sql["a1_read_with_rejects"] = f"""SELECT 'rows' AS kind, '' AS name, count(*) AS n FROM customer WHERE {shaped} AND c_custkey % 50 <> 2
UNION ALL SELECT 'rejects', CASE c_custkey % 50 WHEN 0 THEN 'quotes do not pair' WHEN 1 THEN 'not 4 fields' ELSE 'c_acctbal is no double' END,
  count(*) FROM customer WHERE c_custkey % 50 < 3 GROUP BY ALL
""" + "\n".join(f"UNION ALL SELECT 'missing', '{c}', count(*) FILTER ({c} IS NULL) FROM customer WHERE {shaped}\n"
                f"UNION ALL SELECT 'unreadable', '{c}', 0" for c in ("c_custkey", "c_name", "c_nationkey")) + f"""
UNION ALL SELECT 'missing', 'c_acctbal', count(*) FILTER (c_acctbal IS NULL OR c_custkey % 50 = 3) FROM customer WHERE {shaped}
UNION ALL SELECT 'unreadable', 'c_acctbal', count(*) FROM customer WHERE c_custkey % 50 = 2"""
    sql["a2_drop_index_column"] = f"SELECT s_name, s_nationkey, {r6('s_acctbal', 's_acctbal')} FROM supplier"
    sql["a2_drop_index_column_csv"] = f"""SELECT release, book, chapter, page, {r6("chapter_num", "chapter_num")},
  {r6("page_num", "page_num")} FROM page_codebook"""
    sql["a3_write_table"] = (
        f'SELECT student_id, variable_name, "order", {r6("response_choice", "response_choice")}, response FROM items'
    )

    sql["b1_filter_activity"] = "SELECT ord, lrn_activity_reference, response FROM pre_survey"
    sql["b2_drop_item_types"] = "SELECT ord, lrn_type FROM survey_responses WHERE lrn_type NOT IN ('shorttext', 'plaintext')"
    sql["b3_explode_multiselect"] = f'SELECT ord, {ITEM}, response_choice, "order" FROM choices_all'
    sql["b4_normalize_response"] = f'SELECT ord, {ITEM}, {r6("response_choice", "response_choice")}, "order" FROM choices'
    sql["b4_normalize_response_kept"] = (
        f'SELECT ord, {ITEM}, {r6("try_cast(response_choice AS double)", "response_choice")}, "order" FROM choices_x'
    )
    sql["b5_count_options"] = """SELECT item_id, cast((lrn_option_0 IS NOT NULL)::int + (lrn_option_1 IS NOT NULL)::int
  + (lrn_option_2 IS NOT NULL)::int AS bigint) AS num_response_options FROM item_codebook"""
    sql["b6_join_codebook"] = f"SELECT {CODED} FROM coded".replace(
        ', response_choice FROM', ', ' + r6("response_choice", "response_choice") + ' FROM')
    sql["b6_join_codebook_any_release"] = f"SELECT {CODED}, release, release_codebook FROM coded_x"
    sql["b7_label_codes"] = (
        f'SELECT ord, student_id, variable_name, {r6("response_choice", "response_choice")}, response_label FROM demographics'
    )
    sql["b8_collapse_multiselect"] = (
        'SELECT ord, student_id, class_id, lrn_question_reference, "order", variable_name, num_response_options, '
        f'{r6("response_choice", "response_choice")}, response FROM collapsed'
    )
    sql["b9_attach_construct"] = f"SELECT {MAPPED} FROM items"
    sql["b9_attach_construct_experimental"] = f"SELECT {MAPPED} FROM items_x"
    sql["b10_prompt_drift"] = """SELECT variable_name, prompt_codebook, question, count(*) AS n FROM items
WHERE prompt_codebook <> question GROUP BY ALL"""
    sql["b11_construct_coverage"] = """SELECT construct, variable_name, prompt_codebook, count(*) AS n FROM mapped
WHERE construct IS NOT NULL AND response_choice IS NOT NULL GROUP BY ALL"""
    sql["b11_construct_coverage_unmapped"] = """SELECT construct, variable_name, prompt_codebook, count(*) AS n
FROM mapped_raw WHERE construct IS NULL GROUP BY ALL"""
    unit = "response_choice / (scale_values - 1.0::double)"
    sql["b12_rescale_likert"] = (
        f'SELECT ord, variable_name, "order", {r6("response_choice", "response_choice")}, '
        + r6(f"CASE WHEN scale_flipped THEN 1 - {unit} ELSE {unit} END", "response_rescaled") + " FROM items"
    )

    sql["c1_select_review"] = (
        f"SELECT page, lrn_type, student_id, count(*) AS n, {r6('sum(points_earned)', 'points')} FROM review GROUP BY ALL"
    )
    sql["c2_codebook_totals"] = (
        f"SELECT book, release, chapter, chapter_num, {r6('mcq', 'mcq')}, {r6('plaintext', 'plaintext')} FROM quiz_limits"
    )
    sql["c3_score_quiz_codebook"] = f"SELECT {QUIZ}, {r6('n_attempted', 'n_attempted')} FROM quizzes"
    sql["c4_score_quiz_observed"] = f"SELECT {QUIZ} FROM quizzes_x"
    sql["c5_derive_page_numbers"] = (
        f"SELECT release, book, chapter, page, {r6('chapter_num', 'chapter_num')}, {r6('page_num', 'page_num')} FROM page_numbers"
    )

    sql["d1_parse_access_time"] = f"""SELECT ord, page, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS dt_accessed_processed,
  epoch_us(ts) / 1000 AS dt_accessed_processed_ms FROM parsed"""
    sql["d2_enrich_views"] = """SELECT ord, student_id, class_id, institution_id, release, book, chapter, chapter_num,
  page, page_num FROM enriched"""
    sql["d3_first_completion"] = """SELECT ord, class_id, student_id, chapter_num, page,
  strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS dt_accessed_processed FROM first"""
    sql["d4_class_page_totals"] = "SELECT * FROM page_totals"
    sql["d5_running_progress"] = f"SELECT chapter_num, {PROGRESS} FROM progress"
    sql["d5_running_progress_experimental"] = f"SELECT chapter, {PROGRESS} FROM progress_x"
    sql["d6_engagement_summary"] = f"SELECT {ENGAGED.format(num='chapter_num, ')} FROM engaged"
    sql["d6_engagement_summary_experimental"] = f"SELECT {ENGAGED.format(num='')} FROM engaged_x"
    sql["d7_split_half_assign"] = "SELECT * FROM halves"
    sql["d8_split_half_scores"] = (
        f"SELECT iter, institution_id, class_id, student_id, {r6('half_1', 'half_1')}, {r6('half_2', 'half_2')} FROM half_scores"
    )
    measures = ("pearson", "spearman", "spearman_brown")
    sql["d9_split_half_reliability"] = (
        "SELECT iter, n, " + ", ".join(r6(m, m) for m in measures) + " FROM reliability"
    )
    sql["d10_interval_summary"] = " UNION ALL ".join(
        f"SELECT '{m}' AS measure, {r6(f'avg({m})', 'mean')}, {r6(f'quantile_cont({m}, 0.025)', 'lb')}, "
        f"{r6(f'quantile_cont({m}, 0.975)', 'ub')} FROM reliability" for m in measures
    )

    audit = "SELECT class_id, student_id, variable_name, count(*) AS nrows FROM items GROUP BY ALL HAVING count(*) > {}"
    sql["e1_uniqueness_audit"] = audit.format(1)
    sql["e1_uniqueness_audit_two_rows"] = audit.format(2)
    sql["e1_uniqueness_audit_submissions"] = """SELECT class_id, student_id, lrn_question_reference, count(*) AS nrows
FROM survey_responses GROUP BY ALL HAVING count(*) > 1"""
    chapters = "SELECT class_id, student_id, count(*) AS nrows FROM {} GROUP BY ALL HAVING count(*) > {}"
    sql["e1_uniqueness_audit_quiz"] = chapters.format("quizzes", 2)
    sql["e1_uniqueness_audit_engagement"] = chapters.format("engaged", 1)
    uid = "concat(coalesce(class_id::varchar, 'NA'), ', ', coalesce(student_id::varchar, 'NA'))"
    sql["e2_entity_set"] = f"SELECT DISTINCT {uid} AS \"UID\" FROM engaged"
    sets = {"survey": "items", "quiz": "quizzes", "engagement": "engaged"}
    of = {n: f"(SELECT DISTINCT {uid} AS u FROM {s})" for n, s in sets.items()}
    sizes = {n: of[n] for n in sets}
    for a, b in (("survey", "quiz"), ("survey", "engagement"), ("quiz", "engagement")):
        sizes[f"{a} and {b}"] = f"({of[a]} INTERSECT {of[b]})"
        sizes[f"{a} not {b}"] = f"({of[a]} EXCEPT {of[b]})"
        sizes[f"{b} not {a}"] = f"({of[b]} EXCEPT {of[a]})"
    sizes["survey and quiz and engagement"] = f"({of['survey']} INTERSECT {of['quiz']} INTERSECT {of['engagement']})"
    sql["e2_population_overlap"] = " UNION ALL ".join(
        f"SELECT '{name}' AS comparison, count(*) AS n FROM {s} s" for name, s in sizes.items()
    )
    sql["e3_count_entities"] = "SELECT count(*) AS n FROM (SELECT DISTINCT class_id, student_id FROM merged) d"
    sql["e3_count_entities_two_sources"] = """SELECT count(*) AS n FROM (
  SELECT student_id FROM condition_survey UNION SELECT student_id FROM engaged) d"""
    for tag, name in (("", ""), ("_x", "_experimental")):
        sql[f"e4_construct_means{name}"] = (
            f"SELECT {STUDENT}, construct, {r6('construct_mean', 'construct_mean')}, construct_responses FROM means{tag}"
        )
    sql["e5_widen_constructs"] = f"SELECT {STUDENT}, {WIDE_OUT} FROM wide"
    sql["e6_merge_sources"] = f"SELECT {MERGED}, {r6('n_attempted', 'n_attempted')} FROM merged"
    sql["e6_merge_sources_experimental"] = f"SELECT {MERGED} FROM merged_x".replace(
        ", chapter_num,", f", {r6('chapter_num', 'chapter_num')},")

    sql["f1_widen_labels"] = "SELECT class_id, student_id, gender, race1, year FROM labels_wide"
    sql["f2_category_share"] = f"""SELECT gender, count(*) AS count, (SELECT count(*) FROM labels_wide) AS total_count,
  {r6("count(*) * 100.0::double / (SELECT count(*) FROM labels_wide)", "percentage")} FROM labels_wide GROUP BY gender"""
    sql["f3_model_frame"] = f"SELECT {FRAME} FROM frame WHERE student_id <> 5"
    sql["f4_entity_average"] = f"SELECT {AVERAGES} FROM averages"
    sql["f5_correlation_matrix"] = f"SELECT {CORRELATIONS} FROM correlations"
    sql["f5_correlation_matrix_pairwise"] = f"SELECT {CORRELATIONS} FROM correlations_wide"
    diagonal = " UNION ALL ".join(f"SELECT '{c}', '{c}', 1.0::double, 0.0::double" for c in FEATURES)
    sql["f5_correlation_table"] = f"""SELECT var_i, var_j, {r6("r", "r")}, {r6("p", "p")} FROM (
  SELECT var_i, var_j, r, p_holm AS p FROM correlations UNION ALL SELECT var_j, var_i, r, p FROM correlations
  UNION ALL {diagonal}) c"""
    sql["f6_choose_k"] = _choose_k("scaled", FEATURES, "(2, 3, 4, 5, 6)")
    sql["f7_cluster_profiles"] = _cluster_profiles("plain", FEATURES, "correlations")
    sql["f6_choose_k_merged"] = _choose_k("scaled_merged", MERGED_MEASURES, "(2, 3)")
    sql["f7_cluster_profiles_merged"] = _cluster_profiles("plain_merged", MERGED_MEASURES, "correlations_merged")
    sql["f8_density_by_group"] = _density(
        "engaged", "proportion_pages_complete_student", "chapter_num", 1.5, "0", "1",
        "AND proportion_pages_complete_student BETWEEN 0 AND 1").replace("FROM v)", "FROM v LIMIT 1)")
    sql["f8_density_by_group_open"] = _density("profiles", "y", "class_id", 1.3, "min(x)", "max(x)", "")
    lines = []
    for c in ("c1", "c2"):
        lines.append(f"""SELECT '{c}' AS construct_variable, i AS grid_index, {r6("gx", "x")}, {r6("fit", "fit")}, {r6("se", "se")},
  {r6("fit - q * se", "lower")}, {r6("fit + q * se", "upper")} FROM (
  SELECT i, gx, my + slope * (gx - mx) AS fit, sqrt(s2 * (1 / n + pow(gx - mx, 2) / sxx)) AS se, {t_975("(n - 2.0)")} AS q FROM (
    SELECT *, lo + i * (hi - lo) / 79 AS gx, (syy - slope * sxy) / (n - 2) AS s2 FROM (
      SELECT count(*) AS n, avg({c}) AS mx, avg(y) AS my, regr_sxx(y, {c}) AS sxx, regr_syy(y, {c}) AS syy,
        regr_sxy(y, {c}) AS sxy, regr_sxy(y, {c}) / regr_sxx(y, {c}) AS slope, min({c}) AS lo, max({c}) AS hi
      FROM profiles) a, range(80) r(i)) b) d""")
    sql["f9_trend_by_group"] = " UNION ALL ".join(lines)
    sql["f10_group_means"] = f"""SELECT module_variation, {r6("avg(y1)", "sample_avg_y1")}, {r6("avg(y2)", "sample_avg_y2")}
FROM condition_survey GROUP BY module_variation"""
    sql["f11_row_mean"] = f"""SELECT {AVERAGES}, {r6("quiz_mean", "quiz_mean")},
  cast(round(cast((avg_eoc_score + quiz_mean) / 2 AS DECIMAL(20, 10)), 6) AS double) + 0.0 AS avg_all
FROM averages JOIN assessments USING (student_id) WHERE quiz_mean IS NOT NULL"""
    sql["f12_attach_assessment"] = f"""SELECT {ENGAGED.format(num='chapter_num, ')}, {r6("quiz_mean", "quiz_mean")}
FROM engaged JOIN assessments USING (student_id) WHERE quiz_mean IS NOT NULL"""
    sql["f13_condition_frame"] = f"""SELECT student_id, module_variation, {r6("y1", "q_y1")}, {r6("y2", "q_y2")}
FROM condition_waves WHERE source = 'src3' AND module_variation IN ('A', 'B') AND y1 IS NOT NULL AND y2 IS NOT NULL"""

    fitted = f"SELECT {MIXED} FROM fits"
    sql["g1_fit_random_intercept"] = mixed_sql("outcomes", "outcome", "class_id", {"model": ["c1", "c2"]}, fitted)
    sql["g1_fit_random_intercept_boundary"] = mixed_sql("profiles", "y", "class_id", {"model": ["c1"]}, fitted)
    chisq = "greatest(2 * (ll1 - ll0), 0)"
    lrt = f"""
SELECT 'baseline' AS model_0, '{{0}}' AS model_1, cast(df AS bigint) AS df, {r6("ll0", "ll0")}, {r6("ll1", "ll1")},
  {r6(chisq, "chisq")}, {r6(chi2_tail(chisq, "(df * 1.0)"), "p_value")} FROM (
  SELECT max(log_likelihood) FILTER (model = 'baseline') AS ll0, max(log_likelihood) FILTER (model = '{{0}}') AS ll1,
    max(n_params) FILTER (model = '{{0}}') - max(n_params) FILTER (model = 'baseline') AS df FROM models) a"""
    sql["g2_likelihood_ratio_test"] = mixed_sql("outcomes", "outcome", "class_id", ENGAGEMENT_MODELS, lrt.format("attitudes"))
    relative = REL.format("baseline", "")
    sql["g3_relative_aic"] = mixed_sql("outcomes", "outcome", "class_id", QUIZ_MODELS,
                                       f"SELECT model, {r6(relative, 'aic_value')} FROM models")
    sql["g4_model_sweep"] = mixed_sql("outcomes", "outcome", "class_id", ENGAGEMENT_MODELS, fitted)
    sql["g4_model_sweep_merged"] = mixed_sql("averages", "avg_prop_pages_complete", "class_id", MERGED_MODELS, fitted)
    sql["g4_model_sweep_merged_quiz"] = mixed_sql("averages", "avg_eoc_score", "class_id", MERGED_QUIZ_MODELS, fitted)
    sql["g2_likelihood_ratio_test_merged"] = mixed_sql(
        "averages", "avg_prop_pages_complete", "class_id", MERGED_MODELS, lrt.format("both"))
    sql["f5_correlation_matrix_merged"] = f"SELECT {CORRELATIONS} FROM correlations_merged"
    sql["g11_correlation_test_merged"] = sql_g11("graded", "avg_prop_pages_complete", "quiz_mean")
    sql["g10_nested_f_test_merged"] = ols_sql("graded", "quiz_mean", {
        "smaller": ["avg_prop_pages_complete"], "larger": ["avg_prop_pages_complete", "construct_mean_anxiety_math"],
    }, _f_test("smaller", "larger"))
    sql["g5_stratified_resample"] = "SELECT iter, class_id, student_id, w FROM resample"
    sql["g6_bootstrap_models"] = _bootstrap(f"SELECT iter, model, {r6('aic', 'aic')} FROM models")
    sql["g7_bootstrap_relative"] = _bootstrap(f"SELECT iter, {_relative_columns()} FROM models GROUP BY iter")
    compared = {m: QUIZ_MODELS[m] for m in ("baseline", "attitudes", "nervous", "exp_confval")}
    actual = mixed_sql("outcomes", "outcome", "class_id", compared, f"SELECT model, {relative} AS aic_value FROM models")
    sql["g8_transpose_summary"] = _bootstrap(_summary(actual))
    merged_actual = mixed_sql("averages", "avg_eoc_score", "class_id", MERGED_QUIZ_MODELS, f"SELECT model, {relative} AS aic_value FROM models")
    sql["g8_transpose_summary_merged"] = mixed_sql(
        "drawn_merged", "avg_eoc_score", "class_id", MERGED_QUIZ_MODELS, _summary(merged_actual), by="iter")
    f_value = "((rss0 - rss1) / (groups - 1) / (rss1 / (total - groups)))"
    f_p = f_tail("f_value", "(df_model * 1.0)", "(df_residual * 1.0)")
    sql["g10_nested_f_test_conditions"] = _condition_effects(f"""SELECT 'baseline' AS model_0, 'condition' AS model_1, df_model, df_residual,
  {r6("rss0", "rss0")}, {r6("rss1", "rss1")}, {r6("f_value", "f_value")}, {r6(f_p, "p_value")}, outcome FROM (
  SELECT *, cast(groups - 1 AS bigint) AS df_model, cast(total - groups AS bigint) AS df_residual, {f_value} AS f_value FROM outcomes_) f""")
    spread = f"{t_975('df')} * std_error"
    sql["g12_predicted_means_conditions"] = _condition_effects(f"""SELECT arm AS module_variation, n, {r6("m", "predicted")},
  {r6("std_error", "std_error")}, {r6(f"m - {spread}", "lower")}, {r6(f"m + {spread}", "upper")}, {r6("m", "sample_avg")}, outcome FROM (
  SELECT *, (total - groups) * 1.0 AS df, sqrt(rss1 / (total - groups) / n) AS std_error FROM arms JOIN outcomes_ USING (outcome)) p""")
    sql["g9_fit_ols"] = ols_sql("profiles", "y", OLS_MODELS, _ols_terms())
    sql["g9_fit_ols_arm"] = ols_sql("conditions", "y1", {"model": ["arm_b"]}, _ols_terms())
    sql["g10_nested_f_test"] = ols_sql("profiles", "y", OLS_MODELS, _f_test("two", "five"))
    sql["g10_nested_f_test_arm"] = ols_sql(
        "conditions", "y1", {"baseline": [], "condition": ["arm_b"]}, _f_test("baseline", "condition"))
    sql["g11_correlation_test"] = sql_g11("profiles", "c1", "y")
    margin = f"{t_975('df')} * std_error"
    sql["g12_predicted_means"] = f"""SELECT module_variation, n, {r6("m", "predicted")}, {r6("std_error", "std_error")},
  {r6(f"m - {margin}", "lower")}, {r6(f"m + {margin}", "upper")}, {r6("m", "sample_avg")} FROM (
  SELECT *, sqrt(sum(ss) OVER () / df / n) AS std_error FROM (
    SELECT *, sum(n) OVER () - count(*) OVER () * 1.0 AS df FROM (
      SELECT module_variation, count(*) AS n, avg(y1) AS m, var_pop(y1) * count(*) AS ss
      FROM condition_survey GROUP BY module_variation) a) b) c"""
    sql["e6_merge_sources_bucketed"] = sql["e6_merge_sources"]
    for name, columns in BIGINT.items():
        casts = ", ".join(f"cast({c} AS bigint) AS {c}" for c in columns)
        sql[name] = f"SELECT * REPLACE ({casts}) FROM ({sql[name]}) result"
    sql["e1_uniqueness_audits"] = _audits("items", ITEM_AUDITS)
    sql["e1_uniqueness_audits_quiz"] = _audits("quizzes", QUIZ_AUDITS)
    return {name: with_steps(text) for name, text in sql.items()}
