"""Personal data: high-recall span generators, boosted trees over span features, calibrated thresholds.

Everything runs as column expressions. Generators cut candidate spans out of whole texts with regular
expressions; a span carries small integer features of its format and its context. Counts of feature
vectors over all candidates of all documents (a table bounded by the feature ranges) fit the trees, and
each kind gets a threshold from documents that the trees have not seen. Base spans always stay.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The kinds in their order of output, base kinds first.
BASE = ["email", "ip", "card", "phone"]
KINDS = [*BASE, "handle", "national", "secret", "ssn"]

#: Patterns of the generators. Possessive loops match the same spans as plain ones here, because nothing
#: that follows could take a character back; the look-behinds only skip starts that must fail.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    # whole runs of digits with single spaces or hyphens; runs of fewer than 16 digits fail the rule anyway
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){15,}+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    # a plain dot before a space ends a sentence, unless a well-known ending follows
    "handle": r"(?i)(?<![a-z0-9._%+-])[a-z0-9._%+-]++\x20?(?:\(at\)|\[at\])\x20?[a-z0-9-]++"
              r"(?:(?:\x20?(?:\(dot\)|\[dot\])\x20?|\x20?\.|\x20\.\x20"
              r"|\.\x20(?=(?:com|org|net|edu|gov|info|io)(?![a-z0-9])))[a-z0-9-]++)++",
    "national": r"(?<![0-9+().-])\(?[0-9]{3}\)?[-.\x20][0-9]{3}[-.\x20][0-9]{4}(?![0-9])",
    "secret": r"(?i)(?:password|passwd|pwd|secret|token|api[_-]?key|access[_-]?key)[\x20\"']{0,3}[:=]"
              r"[\x20\"']{0,3}(?=(?:\.?[a-z0-9+/_-]){8})[a-z0-9+/_-]++(?:\.{1,2}+[a-z0-9+/_-]++)*+",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
}
_OCTETS = r"^(?:0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])(?:\.|$)){4}$"
#: A spelled-out address has a part behind a dot, after the at, that can end a domain.
_ENDING = r"(?i)[(\[]at[)\]].*?(?:\.|dot[)\]])\x20?(?:[a-z]{2,}+(?![a-z0-9])|xn--)"
_KEYWORDS = r"(?i)(?:mail|phone|tel|call|fax|card|visa|pay|host|addr|token|key|pass|secret|login|user|ssn|social)"

FEATURES = ["kind", "size", "digits", "letters", "distinct", "check", "before", "after", "keyword"]
TREES, RATE, FOLDS, PRECISION = 24, 0.4, 5, 0.9


def _luhn(digits: Column) -> Column:
    doubled = F.transform(F.split(F.reverse(digits), ""), lambda d, i: d.cast("int") * (1 + i % 2))
    total = F.aggregate(doubled, F.lit(0), lambda a, v: a + v - F.when(v > 9, 9).otherwise(0))
    return F.when(F.length(digits).between(16, 19), total % 10 == 0).otherwise(False)


def _check(kind: str, value: Column, digits: Column) -> Column:
    """The format test of a kind; for base kinds it is the base rule."""
    return {
        "email": F.lit(True),
        "ip": value.rlike(_OCTETS),
        "card": _luhn(digits),
        "phone": F.length(digits).between(8, 15),
        "handle": value.rlike(_ENDING),
        "national": ~digits.rlike(r"^(?:[01]|...[01])|^(.)\1*$"),
        "secret": value.rlike(r"[:=][\x20\"']*(?=.*[0-9])(?=.*[A-Za-z])[A-Za-z0-9+/_.-]+$"),
        "ssn": ~digits.rlike(r"^(?:000|666|9)|^...00|0000$"),
    }[kind]


def _span(kind: str, start: Column, value: Column, before: Column, after: Column) -> Column:
    digits = F.regexp_replace(value, "[^0-9]", "")
    flag = lambda c: F.coalesce(c, F.lit(False)).cast("int")
    check = flag(_check(kind, value, digits))
    return F.struct(
        F.lit(KINDS.index(kind)).alias("kind"), start.cast("long").alias("start"),
        (start + F.length(value)).cast("long").alias("end"),
        F.least(F.floor(F.length(value) / 4), F.lit(15)).cast("int").alias("size"),
        F.least(F.length(digits), F.lit(20)).cast("int").alias("digits"),
        F.least(F.length(F.regexp_replace(value, "[^A-Za-z]", "")), F.lit(20)).cast("int").alias("letters"),
        F.least(F.floor(F.size(F.array_distinct(F.split(value, ""))) / 2), F.lit(10)).cast("int").alias("distinct"),
        check.alias("check"),
        flag(before.rlike("[A-Za-z0-9]$")).alias("before"),
        flag(after.rlike("^[A-Za-z0-9]")).alias("after"),
        flag(before.rlike(_KEYWORDS)).alias("keyword"),
    )


_SPANS = ("array<struct<kind:int,start:bigint,end:bigint,size:int,digits:int,letters:int,distinct:int,"
          "check:int,before:int,after:int,keyword:int>>")


def _spans(kind: str, found: Column, gaps: Column) -> Column:
    """Spans of a kind from its matches and the text between them."""
    pieces = F.transform(found, lambda value, n: F.struct(
        F.length(F.element_at(gaps, n + 1)).alias("gap"), value.alias("value"),
        F.right(F.element_at(gaps, n + 1), F.lit(32)).alias("before"),
        F.left(F.element_at(gaps, n + 2), F.lit(1)).alias("after")))
    return F.aggregate(
        pieces, F.struct(F.lit(0).cast("long").alias("at"), F.array().cast(_SPANS).alias("out")),
        lambda acc, x: F.struct(
            (acc["at"] + x["gap"] + F.length(x["value"])).cast("long").alias("at"),
            F.concat(acc["out"], F.array(_span(kind, acc["at"] + x["gap"], x["value"], x["before"], x["after"]))
                     ).alias("out")),
        lambda acc: acc["out"])


#: A text that lacks these cannot hold the kind; a plain search is cheaper than the pattern.
_NEEDS = {
    "email": lambda t: t.contains("@"), "ip": lambda t: t.contains("."), "card": lambda t: F.lit(True),
    "phone": lambda t: t.contains("+"), "handle": lambda t: t.rlike(r"(?i)[(\[]at[)\]]"), "national": lambda t: F.lit(True),
    "secret": lambda t: t.contains("=") | t.contains(":"), "ssn": lambda t: t.contains("-"),
}


def candidates(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with ``_spans``: all candidate spans of the text by kind, then start."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    some = lambda k: F.size(f"_found_{k}") > 0
    # columns of their own: each pattern runs once for a text, whatever is read from its matches
    df = docs.withColumns({f"_found_{k}": F.when(
        _NEEDS[k](text), F.regexp_extract_all(text, F.lit(PATTERNS[k]), F.lit(0))) for k in KINDS})
    df = df.withColumns({f"_gaps_{k}": F.when(some(k), F.split(text, PATTERNS[k], -1)) for k in KINDS})
    none = F.array().cast(_SPANS)
    spans = F.concat(*(F.when(some(k), _spans(k, F.col(f"_found_{k}"), F.col(f"_gaps_{k}"))).otherwise(none) for k in KINDS))
    return df.select(*docs.columns, spans.alias("_spans"))


@dataclass
class Model:
    """Trees as (feature, limit, left, right) with leaves as numbers, and a threshold for each kind."""

    trees: list
    thresholds: list


def _tree(x: np.ndarray, gradient: np.ndarray, weight: np.ndarray, rows: np.ndarray, depth: int):
    """A regression tree on the Newton steps of the logistic loss."""
    value = float(gradient[rows].sum() / (weight[rows].sum() + 1.0))
    if not depth or len(rows) < 2:
        return value
    best = (1e-6, None, None)
    total_g, total_w = gradient[rows].sum(), weight[rows].sum()
    for f in range(x.shape[1]):
        for limit in np.unique(x[rows, f])[:-1]:
            left = rows[x[rows, f] <= limit]
            g, w = gradient[left].sum(), weight[left].sum()
            gain = g * g / (w + 1) + (total_g - g) ** 2 / (total_w - w + 1) - total_g ** 2 / (total_w + 1)
            if gain > best[0]:
                best = (gain, f, int(limit))
    if best[1] is None:
        return value
    under = x[rows, best[1]] <= best[2]
    return (best[1], best[2], _tree(x, gradient, weight, rows[under], depth - 1),
            _tree(x, gradient, weight, rows[~under], depth - 1))


def _evaluate(tree, x: np.ndarray) -> np.ndarray:
    if not isinstance(tree, tuple):
        return np.full(len(x), tree)
    return np.where(x[:, tree[0]] <= tree[1], _evaluate(tree[2], x), _evaluate(tree[3], x))


def fit_counts(x: np.ndarray, label: np.ndarray, held: np.ndarray, count: np.ndarray) -> Model:
    """Trees from counted feature vectors; thresholds from those marked ``held``."""
    score, trees, w = np.zeros(len(x)), [], np.where(held, 0.0, count)
    for _ in range(TREES if len(x) else 0):
        p = 1 / (1 + np.exp(-score))
        tree = _tree(x, w * (label - p), w * p * (1 - p), np.flatnonzero(w > 0), 3)
        trees.append(tree)
        score += RATE * _evaluate(tree, x)
    thresholds = []
    for k in range(len(KINDS)):
        mine = np.flatnonzero((x[:, 0] == k) & (held if held.any() else ~held))
        order = mine[np.argsort(-score[mine], kind="stable")]
        good, all_ = np.cumsum((label * count)[order]), np.cumsum(count[order])
        # the lowest score down to which the spans of this kind are right often enough
        last = np.append(score[order][1:] != score[order][:-1], True)[: len(order)]
        fine = np.flatnonzero(last & (good >= PRECISION * all_))
        thresholds.append(float(score[order][fine[-1]]) if len(fine) else 0.0)
    return Model(trees, thresholds)


def _label(span: Column) -> Column:
    """What the trees learn: the format test holds and the span is not cut out of a longer word."""
    return F.when(span["kind"] < len(BASE), span["check"]).otherwise(
        span["check"] * (1 - span["before"]) * (1 - span["after"]))


def fit(spans: DataFrame) -> Model:
    """The model of all candidates of all documents; ``spans`` as ``candidates`` gives it."""
    one = F.col("span")
    table = (
        # the fold is settled before the spans become rows, so no row carries the whole list
        spans.select((F.pmod(F.xxhash64("_spans"), F.lit(FOLDS)) == 0).alias("held"), "_spans")
        .select("held", F.explode("_spans").alias("span"))
        .select("held", *(one[f].alias(f) for f in FEATURES), _label(one).alias("label"))
        .groupBy("held", *FEATURES, "label").agg(F.count("*").alias("n"))
    )
    # grouped by small integers: the number of rows is bounded by their ranges, not by the documents
    rows = sorted(tuple(r) for r in table.collect())
    values = np.array(rows, np.int64).reshape(len(rows), len(FEATURES) + 3)
    return fit_counts(values[:, 1:-2], values[:, -2], values[:, 0] == 1, values[:, -1])


def _tree_column(tree, span: Column) -> Column:
    if not isinstance(tree, tuple):
        return F.lit(float(tree))
    return F.when(span[FEATURES[tree[0]]] <= tree[1], _tree_column(tree[2], span)).otherwise(
        _tree_column(tree[3], span))


def _reached(span: Column, model: Model) -> Column:
    """True where the score of a span reaches the threshold of its kind."""
    score = F.lit(0.0)
    for tree in model.trees:
        score = score + F.lit(RATE) * _tree_column(tree, span)
    return score >= F.element_at(F.array(*(F.lit(t) for t in model.thresholds)), span["kind"] + 1)


def _listed(spans: Column) -> Column:
    names = F.array(*(F.lit(k) for k in KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", F.element_at(names, s["kind"] + 1), s["start"], s["end"])), ",")


def found_spans(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``row``, the columns of ``docs`` as a struct, ``text``, ``_base``, the base spans, and ``_spans``, these and
    the others that are taken.

    The struct keeps columns of any name apart from those made here.
    """
    held = docs.select(F.struct(*(docs[f"`{c}`"] for c in docs.columns)).alias("row"), docs[f"`{text_col}`"].alias("text"))
    model = fit(candidates(held.select("text")))
    parted = candidates(held).withColumns({
        "_base": F.filter("_spans", lambda s: (s["kind"] < len(BASE)) & (s["check"] == 1)),
        "_more": F.filter("_spans", lambda s: s["kind"] >= len(BASE))})
    # what lies inside a base span is found already
    inside = lambda s: F.exists("_base", lambda b: (b["start"] <= s["start"]) & (s["end"] <= b["end"]))
    more = F.filter("_more", lambda s: _reached(s, model) & ~inside(s))
    return parted.withColumn("_spans", F.concat("_base", more)).drop("_more")


def personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: ``doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans``.

    Places are code points, ends exclusive. A null or empty text has no spans: zeros, the digest of the
    empty string and an empty list. Repeated rows are searched each; a null identifier stays null; an
    empty table gives an empty result; other columns are ignored.
    """
    found = found_spans(docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")))

    def count(kind: str) -> Column:
        mine = F.filter("_base", lambda s: s["kind"] == KINDS.index(kind))
        return F.size(mine).cast("long").alias(f"n_{kind}")

    return found.select(
        F.col("row.doc_id").alias("doc_id"), *map(count, BASE),
        F.sha2(_listed(F.col("_base")), 256).alias("base_sha256"), _listed(F.col("_spans")).alias("spans"))


def redacted(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with every found span of the text replaced by its kind in brackets; a null text stays null.

    Of overlapping spans the one that starts first (then the longer one) names the mark, which stands
    for all of them. Empty texts stay empty, repeated rows are treated each, an empty table stays empty;
    other columns pass through whatever their names.
    """
    names = F.array(*(F.lit(f"[{k.upper()}]") for k in KINDS))
    found = found_spans(docs, text_col)
    ordered = F.array_sort(F.transform("_spans", lambda s: F.struct(
        s["start"].alias("start"), (-s["end"]).alias("_end"), s["kind"].alias("kind"))))
    text = F.col("text")
    built = F.aggregate(
        ordered, F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<string>").alias("out")),
        lambda acc, s: F.struct(
            F.greatest(acc["at"], -s["_end"]).cast("long").alias("at"),
            F.when(s["start"] < acc["at"], acc["out"]).otherwise(F.concat(
                acc["out"], F.array(text.substr((acc["at"] + 1).cast("int"), (s["start"] - acc["at"]).cast("int")),
                                    F.element_at(names, s["kind"] + 1)))).alias("out")),
        lambda acc: F.concat(F.array_join(acc["out"], ""),
                             text.substr((acc["at"] + 1).cast("int"), F.length(text))))
    clean = F.when(F.size("_spans") > 0, built).otherwise(text).alias(text_col)
    return found.select(*(clean if c == text_col else F.col(f"row.`{c}`").alias(c) for c in docs.columns))
