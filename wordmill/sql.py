"""The analysers from SQL text: functions over a table of word forms.

``register`` makes temporary functions whose bodies are queries, so that a call over a
table's column is planned as a join with the forms, whatever their number:

    SELECT t.token, l.* FROM tokens t, LATERAL lemmatize(t.token) l
    SELECT token FROM tokens WHERE check_word(token)
    SELECT build_form(lexeme_id, 1) FROM lexemes

Words are looked up without regard to case.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from wordmill.functions.text import LONGEST

VIEW = "wordmill_forms"
FUNCTIONS = {
    "check_word(word STRING) RETURNS BOOLEAN": f"RETURN EXISTS (SELECT 1 FROM {VIEW} f WHERE f.form = lower(word) AND length(word) <= {LONGEST})",
    "lemmatize(word STRING) RETURNS TABLE (lexeme_id BIGINT, lemma STRING, pos INT, grams ARRAY<INT>)": f"RETURN SELECT f.lexeme_id, min(f.lemma), min(f.pos), array_sort(collect_set(f.form_id)) FROM {VIEW} f WHERE f.form = lower(word) AND length(word) <= {LONGEST} GROUP BY f.lexeme_id",
    "find_forms(word STRING, form INT) RETURNS TABLE (lexeme_id BIGINT, surface STRING)": f"RETURN SELECT DISTINCT f.lexeme_id, o.surface FROM {VIEW} f JOIN {VIEW} o ON o.lexeme_id = f.lexeme_id WHERE o.form_id = find_forms.form AND f.form = lower(word) AND length(word) <= {LONGEST}",
    "build_form(lexeme BIGINT, form INT) RETURNS STRING": f"RETURN (SELECT min(f.surface) FROM {VIEW} f WHERE f.lexeme_id = lexeme AND f.form_id = build_form.form)",
    "part_of_sp(lexeme BIGINT) RETURNS INT": f"RETURN coalesce((SELECT min(f.pos) FROM {VIEW} f WHERE f.lexeme_id = lexeme), 0)",
}


def register(spark: SparkSession, forms: DataFrame, view: str = VIEW) -> None:
    """Makes the functions of ``FUNCTIONS`` over these forms, for the session."""
    forms.createOrReplaceTempView(view)
    for head, body in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} {body.replace(VIEW, view)}")
