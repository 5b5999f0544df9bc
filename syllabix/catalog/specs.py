"""Parameters of the registered queries that the SQL shares."""

from __future__ import annotations

FEATURES = [f"c{i}" for i in range(1, 8)]
ITERATIONS = 100
# Predictor sets compared in the bootstrap, on the seven profile columns.
QUIZ_MODELS = {
    "baseline": [],
    "attitudes": FEATURES,
    "nervous": ["c1", "c2"],
    "exp": ["c3"],
    "confval": ["c4", "c5", "c6", "c7"],
    "nervous_confval": ["c1", "c2", "c4", "c5", "c6", "c7"],
    "nervous_exp": ["c1", "c2", "c3"],
    "exp_confval": ["c3", "c4", "c5", "c6", "c7"],
}
ENGAGEMENT_MODELS = {"baseline": [], "attitudes": FEATURES, **{f"only_{c}": [c] for c in FEATURES}}
OLS_MODELS = {"baseline": [], "two": ["c1", "c2"], "five": ["c1", "c2", "c3", "c4", "c5"]}
# Models of the merged students, and with engagement as predictor.
MERGED_MODELS = {
    "baseline": [],
    "anxiety": ["construct_mean_anxiety_math"],
    "stress": ["construct_mean_stress_expectation"],
    "both": ["construct_mean_anxiety_math", "construct_mean_stress_expectation"],
}
MERGED_QUIZ_MODELS = {**MERGED_MODELS, "engaged": ["avg_prop_pages_complete"],
                      "all": ["avg_prop_pages_complete", "construct_mean_anxiety_math", "construct_mean_stress_expectation"]}
MERGED_MEASURES = ["avg_prop_pages_complete", "avg_eoc_score", "construct_mean_anxiety_math", "construct_mean_stress_expectation"]
# Audits of one table: keys, and the rows they may have.
ITEM_AUDITS = {
    "variables": (["class_id", "student_id", "variable_name"], 1),
    "variables_twice": (["class_id", "student_id", "variable_name"], 2),
    "students": (["class_id", "student_id"], 3),
    "variables_of_classes": (["class_id", "variable_name"], 1),
}
QUIZ_AUDITS = {
    "chapters": (["class_id", "student_id", "chapter", "chapter_num"], 1),
    "chapters_twice": (["class_id", "student_id", "chapter", "chapter_num"], 2),
    "students": (["class_id", "student_id"], 2),
    "classes": (["class_id"], 1),
}
