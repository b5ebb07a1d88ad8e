"""Schemas of the stored documents."""

META = (
    "table_id STRING, title STRING, description STRING, columns ARRAY<STRING>, row_count BIGINT, "
    "column_count BIGINT, numeric_columns ARRAY<STRING>, has_time_series BOOLEAN, domain STRING, "
    "complexity_level STRING, suitable_for_reasoning BOOLEAN"
)

QUALITY = (
    "success BOOLEAN, original_shape ARRAY<BIGINT>, final_shape ARRAY<BIGINT>, rows_removed BIGINT, "
    "columns_removed BIGINT, data_completeness DOUBLE, numeric_columns BIGINT"
)

QUESTION = (
    "question_id STRING, question STRING, table_refs ARRAY<STRING>, answer STRING, "
    "answer_type STRING, domain STRING, reasoning_type STRING, table_number INT, "
    "reasoning_steps ARRAY<STRING>, complexity_metrics STRUCT<rows_involved: INT, "
    "columns_involved: INT, steps_count: INT, complexity_score: DOUBLE>, answerable BOOLEAN, "
    "requires_calculation BOOLEAN, has_distractor BOOLEAN, distractor_type STRING"
)

# the result of a step is an object or a text, so it stays a JSON text
STEP = "content: STRING, status: STRING, error: STRING, guidance: STRING, result: STRING"

RUN = (
    f"steps: ARRAY<STRUCT<{STEP}>>, llm_answer: STRING, "
    "llm_valid: STRUCT<decision: BOOLEAN, time_s: DOUBLE, retried: BOOLEAN, error: STRING>, "
    "error: STRING"
)

RECORD = (
    "question_id STRING, question STRING, golden_answer STRING, "
    f"runs ARRAY<STRUCT<{RUN}>>"
)
