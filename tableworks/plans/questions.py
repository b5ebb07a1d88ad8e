"""Question sets: selection, id lists, batches, complexity, checks and statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tableworks.functions.columns import col
from tableworks.operators import ordered, sampling, stats

# Subsets in order of precedence, allowed answer types, weights and tier limits.
SUBSETS = ["single_table", "multi_table", "distractor_bank"]
ANSWER_TYPES = ["numerical", "categorical", "boolean", "list", "text", "NA"]
ROW_WEIGHT, COLUMN_WEIGHT, STEP_WEIGHT = 0.1, 0.2, 0.5
LOW_UP_TO, MEDIUM_UP_TO = 6.0, 21.5

_MODES = {"single_table": ["single_table"], "multi_table": ["multi_table"],
          "distractor": ["distractor_bank"], "all": SUBSETS}


def select_subset(questions: DataFrame, mode: str, subset: str = "subset") -> DataFrame:
    if mode not in _MODES:
        raise ValueError(f"unknown selection mode {mode!r}")
    return questions.filter(col(subset).isin(_MODES[mode]))


#: Ids of a range that are made at a time, and the widest range.
_BLOCK, _WIDEST = 10_000, 10_000_000_000


def expand_ids(specs: DataFrame, list_id: str, spec: str, order: str) -> DataFrame:
    """Id lists like ``1``, ``2-3``, ``7-5`` or ``8,9`` as ``(list, rank, id)``, first mention kept.

    ``specs`` has one specification per row; ``order`` is its position in the list. Ranges are
    inclusive and may be reversed; tokens that are no ids are left out. A range of more than ten thousand
    million ids is taken for a slip and raises.
    """
    tokens = specs.select(
        col(list_id), col(order).alias("_order"),
        F.posexplode(F.split(spec, ",")).alias("_token_at", "_token"))
    number = r"^\s*[+-]?\d+\s*$"
    token = F.trim("_token")
    dash = F.instr(token, "-")
    left = F.when(dash > 0, F.substring_index(token, "-", 1)).otherwise(token)
    right = F.when(dash > 0, F.substring(token, dash + 1, F.char_length(token))).otherwise(token)
    ends = tokens.filter(left.rlike(number) & right.rlike(number)).select(
        col(list_id), "_order", "_token_at",
        left.try_cast("long").alias("_a"), right.try_cast("long").alias("_b")).filter(
        "_a is not null and _b is not null")
    # a wide range becomes blocks first, so no array grows with it
    low, high = F.least("_a", "_b"), F.greatest("_a", "_b")
    width = high.cast("decimal(20,0)") - low.cast("decimal(20,0)")
    number_of_blocks = F.when(width <= _WIDEST, F.floor(width / _BLOCK).cast("long")).otherwise(
        F.raise_error(F.concat(F.lit("range too wide: "), col("_a").cast("string"), F.lit("-"), col("_b").cast("string"))).cast("long"))
    blocks = ends.select(
        col(list_id), "_order", "_token_at", low.alias("_low"), high.alias("_high"),
        F.explode(F.sequence(F.lit(0).cast("long"), number_of_blocks)).alias("_block"))
    start = col("_low") + col("_block") * _BLOCK
    ids = blocks.select(
        col(list_id), "_order", "_token_at", "_low",
        F.explode(F.sequence(start, F.least(start + (_BLOCK - 1), col("_high")))).alias("id"))
    ids = ids.withColumn("_at", col("id") - col("_low"))
    first = ids.groupBy(col(list_id), "id").agg(F.min(F.struct("_order", "_token_at", "_at")).alias("_first"))
    return ordered.positions(first, ["_first", "id"], by=[list_id], out="rank").drop("_first")


def pick_custom(ids: DataFrame, questions: DataFrame, number: str = "number") -> DataFrame:
    """Listed ids that exist; an id in several subsets takes the question of the first subset."""
    rank = F.array_position(F.array(*[F.lit(s) for s in SUBSETS]), col("subset"))
    fields = F.struct(*[col(c) for c in questions.columns])
    first = questions.groupBy(col(number).alias("id")).agg(F.min_by(fields, rank).alias("q"))
    return ids.join(first, "id").select(*[col(c) for c in ids.columns], "q.*")


def shuffled(questions: DataFrame, identity: list[str], seed: int) -> DataFrame:
    return sampling.shuffle(questions, identity, seed)


def cap(questions: DataFrame, order: list[str], n: int) -> DataFrame:
    return sampling.cap_rows(questions, order, n)


def batches(questions: DataFrame, order: list[str], size: int) -> DataFrame:
    """``position`` over the whole list, ``batch`` and ``batch_position``, all from 1."""
    return ordered.batches(questions, order, size)


def resume_from(questions: DataFrame, order: list[str], key: str, value: object) -> DataFrame:
    """The part of the list from the given question on; an unknown id gives an empty list.

    The start is a one-row aggregate used as a scalar, and the comparison is on the order key, so
    the list is filtered without numbering it.
    """
    key_of = F.struct(*[col(c) for c in order])
    start = questions.filter(col(key) == F.lit(value)).agg(F.min(key_of)).scalar()
    return questions.filter(key_of >= start)


def complexity_score(rows: Column, columns: Column, steps: Column) -> Column:
    return rows * F.lit(ROW_WEIGHT) + columns * F.lit(COLUMN_WEIGHT) + steps * F.lit(STEP_WEIGHT)


def complexity_tier(score: Column) -> Column:
    return F.when(score <= LOW_UP_TO, "low").when(score <= MEDIUM_UP_TO, "medium").otherwise("high")


def features(questions: DataFrame) -> DataFrame:
    """Flat question features from question records; absent fields get their defaults."""
    metric = lambda name, default: F.coalesce(
        col("complexity_metrics")[name], F.lit(default)).alias(name)
    flat = questions.select(
        "question_id", "question", "answer_type", "domain", "reasoning_type", "subset",
        F.coalesce("answerable", F.lit(True)).alias("answerable"),
        metric("rows_involved", 0), metric("columns_involved", 0), metric("steps_count", 0),
        metric("complexity_score", 0.0),
        F.coalesce("table_number", F.coalesce(F.size("table_refs"), F.lit(0))).alias("table_number"),
        F.coalesce("requires_calculation", F.lit(False)).alias("requires_calculation"),
        F.coalesce("has_distractor", F.lit(False)).alias("has_distractor"),
        F.coalesce("distractor_type", F.lit("none")).alias("distractor_type"),
        F.coalesce(F.char_length("question"), F.lit(0)).alias("question_length"),
        F.coalesce(F.size("reasoning_steps"), F.lit(0)).alias("reasoning_steps_count"),
    )
    return flat.withColumns({
        "complexity_level": complexity_tier(col("complexity_score")),
        "is_single_table": col("table_number") == 1,
        "is_multi_table": col("table_number") > 1,
    })


def violations(questions: DataFrame, tolerance: float = 0.05) -> DataFrame:
    """``(question_id, rule)`` for every authoring rule a question record breaks."""
    required = ["question_id", "question", "table_refs", "answer_type", "domain", "reasoning_type",
                "complexity_metrics", "answerable"]
    m = col("complexity_metrics")
    formula = complexity_score(m["rows_involved"], m["columns_involved"], m["steps_count"])
    missing = F.exists(F.array(*[col(c).isNull() for c in required]), lambda x: x)
    is_na = col("answer_type") == "NA"
    rules = {
        "id_format": ~col("question_id").rlike(r"^question_\d{3,}$"),
        "missing_field": missing,
        "answer_type": ~col("answer_type").isin(ANSWER_TYPES),
        "answerable": col("answerable") == is_na,
        "table_number": col("table_number") != F.size("table_refs"),
        "steps_count": m["steps_count"] != F.size("reasoning_steps"),
        "complexity_score": F.abs(m["complexity_score"] - formula) > tolerance,
    }
    broken = F.array_compact(F.array(*[F.when(bad, name) for name, bad in rules.items()]))
    return questions.select("question_id", F.explode(broken).alias("rule"))


DISTRIBUTIONS = ["reasoning_type", "domain", "answer_type", "complexity_level", "subset",
                 "answerable", "table_number", "reasoning_steps_count"]


def question_distributions(flat: DataFrame) -> DataFrame:
    """Counts per value of every dimension, in one pass."""
    return stats.value_counts_long(flat, DISTRIBUTIONS)


def question_report(flat: DataFrame) -> DataFrame:
    """Counts, means, deviations and correlations over a question set, as one row."""
    measures = ["complexity_score", "question_length", "reasoning_steps_count", "table_number",
                "rows_involved", "columns_involved", "steps_count"]
    flags = ["is_single_table", "is_multi_table", "answerable", "requires_calculation"]
    return flat.agg(
        F.count(F.lit(1)).alias("total_questions"),
        *[F.count_if(f).alias(f"n_{f}") for f in flags],
        *[F.avg(col(f).cast("int")).alias(f"share_{f}") for f in flags],
        *[F.avg(m).alias(f"mean_{m}") for m in measures],
        *[F.stddev_samp(m).alias(f"std_{m}") for m in measures[:4]],
        F.corr("table_number", "complexity_score").alias("corr_tables_complexity"),
        F.corr("question_length", "complexity_score").alias("corr_length_complexity"),
        F.corr("steps_count", "complexity_score").alias("corr_steps_complexity"),
    )


def distractor_report(flat: DataFrame) -> DataFrame:
    """Count and means per distractor type within the distractor subset, and over the whole subset in the row
    whose type is NULL."""
    return flat.filter(col("subset") == "distractor_bank").rollup("distractor_type").agg(
        F.count(F.lit(1)).alias("count"),
        F.avg("complexity_score").alias("mean_complexity"),
        F.avg("table_number").alias("mean_table_number"),
    )
