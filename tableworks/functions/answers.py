"""Answer comparison and response classification as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tableworks.functions.text import number_of

# Words that mean the same answer.
BOOLEANS = {"yes": "true", "true": "true", "no": "false", "false": "false"}
NUMBER_WORDS = {
    "zero": 0, "one": 1, "two": 2, "three": 3, "four": 4, "five": 5, "six": 6, "seven": 7,
    "eight": 8, "nine": 9, "ten": 10, "eleven": 11, "twelve": 12, "thirteen": 13, "fourteen": 14,
    "fifteen": 15, "sixteen": 16, "seventeen": 17, "eighteen": 18, "nineteen": 19, "twenty": 20,
}


def answer_item(text: Column) -> Column:
    """One answer in normal form: trimmed, lower case, no final ``.!?``, synonyms and numbers."""
    plain = F.trim(F.regexp_replace(F.lower(F.trim(text)), r"[.!?]+$", ""))
    same = {**BOOLEANS, **{w: str(float(n)) for w, n in NUMBER_WORDS.items()}}
    lookup = F.create_map(*[F.lit(x) for pair in same.items() for x in pair])
    return F.coalesce(F.try_element_at(lookup, plain), number_of(plain).cast("string"), plain)


def answer_key(text: Column) -> Column:
    """The answer as a sorted set of items, split at commas; equal answers have equal keys."""
    whole = F.regexp_replace(F.trim(text), r"[.!?]+$", "")
    items = F.transform(F.split(whole, ","), answer_item)
    return F.array_sort(F.array_distinct(F.filter(items, lambda i: i != "")))


def answers_match(gold: Column, answer: Column) -> Column:
    """Whether two answers say the same; a missing answer matches nothing."""
    return F.coalesce(answer_key(gold) == answer_key(answer), F.lit(False))


def numbers_match(gold: Column, answer: Column, tolerance: float) -> Column:
    """Whether two numeric answers differ by at most the tolerance; false if one is no number."""
    return F.coalesce(F.abs(number_of(gold) - number_of(answer)) <= tolerance, F.lit(False))


_STARRED_PLAN = r"(?s)\*\*PLAN\*\*\s*\n(?:PLAN\s*\n)?(.*?)\n(?:\*\*END\*\*|END PLAN)"
_HEADED_PLAN = r"(?s)##\s+PLAN\s*\n(?:PLAN\s*\n)?(.*?)\nEND PLAN"
_PLAN = r"(?s)PLAN\n(.*?)\nEND PLAN"
_PLAN_OPEN = r"(?s)(?:^|\n)PLAN\s+(.+)$"
_PLAN_LINE = r"(?m)PLAN\s+(.+?)(?:\s*#.*)?$"
_END_BLOCK = r"(?s)(?:^|\n)END\n(.*?)\nEND(?:\n|$)"
_END_MARK = r"(?i)(?:^|\n)[ \t]*(?:\*\*END\*\*|##[ \t]+END|END)[ \t]*(?=\n|$)"
_END = r"(?is)(?:^|\n)[ \t]*(?:\*\*END\*\*|##[ \t]+END|END)[ \t]*(?:\n(.*?))?(?:\n[ \t]*(?:\*\*END\*\*|END)[ \t]*(?:\n|$)|$)"
_END_LINE = r"(?:^|\n)[ \t]*(?:\*\*END\*\*|##[ \t]+END|END)[ \t]+([^\n]+)"


def classify_response(text: Column, plan_executed: bool = False) -> Column:
    """A model response as struct (kind, content): PLAN, END or ERROR with its code.

    Blocks are ``PLAN … END PLAN`` and ``END … END``, plain or with ``**`` or ``##`` headings.
    Several PLAN blocks are joined by a line break. With both kinds the plan comes first, unless it
    was executed already. A PLAN without its closing line counts as a plan.
    """
    plain = F.regexp_replace(
        F.regexp_replace(text, _STARRED_PLAN, "PLAN\n$1\nEND PLAN"),
        _HEADED_PLAN, "PLAN\n$1\nEND PLAN")
    blocks = F.filter(
        F.transform(F.regexp_extract_all(plain, F.lit(_PLAN), F.lit(1)), lambda b: _strip(b)),
        lambda b: b != "")
    rest = F.regexp_replace(plain, _PLAN, "")
    has_plan = F.size(F.regexp_extract_all(plain, F.lit(_PLAN), F.lit(1))) > 0
    has_end = rest.rlike(_END_MARK)
    has_end_line = rest.rlike(_END_LINE) & ~rest.rlike(r"(?:^|\n)END PLAN")
    end_content = F.when(has_end, _strip(F.regexp_extract(rest, _END, 1))).otherwise(
        _strip(F.regexp_extract(rest, _END_LINE, 1)))
    open_plan = plain.rlike(_PLAN_OPEN)
    plan = F.struct(F.lit("PLAN").alias("kind"), F.array_join(blocks, "\n").alias("content"))
    end = F.struct(F.lit("END").alias("kind"), end_content.alias("content"))
    any_end = has_end | has_end_line
    first, second = ((any_end, end), (has_plan, plan)) if plan_executed else (
        (has_plan, plan), (any_end, end))
    error = F.struct(F.lit("ERROR").alias("kind"), F.lit("FORMAT_NO_BLOCK").alias("content"))
    unclosed = F.struct(F.lit("PLAN").alias("kind"),
                        _strip(F.regexp_extract(plain, _PLAN_OPEN, 1)).alias("content"))
    blank = text.isNull() | (_strip(text) == "")
    return F.when(blank, error).when(*first).when(*second).when(open_plan, unclosed).otherwise(error)


def single_block(text: Column) -> Column:
    """A response that must hold exactly one block, as struct (kind, content).

    Blocks are counted as they stand between their lines (``PLAN … END PLAN``, ``END … END``). None is the error
    ``FORMAT_NO_BLOCK``, unless a PLAN was left open, whose first line counts as a plan; more than one is
    ``FORMAT_MULTIPLE_BLOCKS``.
    """
    plain = F.regexp_replace(
        F.regexp_replace(text, _STARRED_PLAN, "PLAN\n$1\nEND PLAN"), _HEADED_PLAN, "PLAN\n$1\nEND PLAN")
    whole = _strip(F.coalesce(plain, F.lit("")))
    plans = F.regexp_extract_all(whole, F.lit(_PLAN), F.lit(1))
    ends = F.regexp_extract_all(whole, F.lit(_END_BLOCK), F.lit(1))
    made = lambda kind, content: F.struct(F.lit(kind).alias("kind"), content.alias("content"))
    total = F.size(plans) + F.size(ends)
    left_open = _strip(F.regexp_replace(F.regexp_extract(whole, _PLAN_LINE, 1), r"(?m)\s*#.*$", ""))
    return (
        F.when((total == 0) & (left_open != ""), made("PLAN", left_open))
        .when(total == 0, made("ERROR", F.lit("FORMAT_NO_BLOCK")))
        .when(total > 1, made("ERROR", F.lit("FORMAT_MULTIPLE_BLOCKS")))
        .when(F.size(plans) == 1, made("PLAN", _strip(F.get(plans, F.lit(0)))))
        .otherwise(made("END", _strip(F.get(ends, F.lit(0)))))
    )


def block_kinds(text: Column) -> Column:
    """Which blocks a response holds: both, PLAN, END or none."""
    done, fresh = classify_response(text, True)["kind"], classify_response(text)["kind"]
    return (
        F.when((done == "END") & (fresh == "PLAN"), "both")
        .when(fresh == "ERROR", "none").otherwise(fresh)
    )


def _strip(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")
