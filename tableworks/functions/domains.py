"""Subject domains of tables from keywords and aliases."""

from __future__ import annotations

import functools
import operator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tableworks.functions.columns import col

# The domain names, their keywords in order of precedence, and aliases.
DOMAINS = ["economics", "demographics", "health", "education", "environment", "technology", "general"]

KEYWORDS = {
    "health": [
        "health", "disease", "mortality", "life expectancy", "hospital", "covid", "hiv", "obesity",
        "vaccine", "malaria", "diabetes", "heart", "cancer", "cause of death",
    ],
    "economics": [
        "econom", "gdp", "income", "consumption", "trade", "inflation", "employment",
        "unemployment", "wage", "finance", "industry", "productivity", "market", "gini",
    ],
    "environment": [
        "climate", "emission", "carbon", "co2", "pollution", "environment", "energy", "forest",
        "biodiversity", "fossil", "temperature", "water", "agriculture",
    ],
    "demographics": [
        "population", "fertility", "birth", "death rate", "migration", "demograph",
        "age structure", "life expectancy",
    ],
    "education": ["education", "literacy", "school", "student", "teacher", "learning", "enrol"],
    "technology": ["technology", "internet", "ict", "digital", "innovation", "patent"],
    "general": [
        "inequality", "poverty", "wellbeing", "happiness", "crime", "violence", "social", "politic",
        "governance", "democracy", "election", "military", "conflict", "war",
    ],
}

ALIASES = {
    "economic": "economics",
    "demographic": "demographics",
    "environmental": "environment",
    "tech": "technology",
    "social": "general",
    "social_science": "general",
    "political": "general",
    "governance": "general",
}


def keyword_domain(low: Column, keywords: dict[str, list[str]] | None = None) -> Column:
    """First domain with a keyword contained in the lower-case text; NULL without any.

    A chain of substring tests inside the projection; it stops at the first hit and needs no
    keyword join.
    """
    result = None
    for domain, found in (keywords or KEYWORDS).items():
        hit = functools.reduce(operator.or_, [low.contains(k) for k in found])
        result = F.when(hit, domain) if result is None else result.when(hit, domain)
    return result


def with_domain(
    df: DataFrame, text: Column, out: str = "domain", default: str | None = "general",
) -> DataFrame:
    """``df`` with the keyword domain of a text, lower-cased once per row."""
    found = df.withColumn("_low", F.lower(text)).withColumn(out, keyword_domain(col("_low")))
    if default is not None:
        found = found.withColumn(out, F.coalesce(out, F.lit(default)))
    return found.drop("_low")


def normal_domain(name: Column, default: str = "general") -> Column:
    """Canonical domain name by alias, any case; unknown or missing names get the default."""
    known = {**{d: d for d in DOMAINS}, **ALIASES}
    lookup = F.create_map(*[F.lit(x) for pair in known.items() for x in pair])
    return F.coalesce(F.try_element_at(lookup, F.lower(name)), F.lit(default))


def domain_distribution(tables: DataFrame, domain: str = "domain") -> DataFrame:
    """Tables per domain, with a zero row for every unused domain."""
    counts = tables.groupBy(col(domain).alias("domain")).agg(F.count(F.lit(1)).alias("count"))
    every = tables.sparkSession.createDataFrame([(d,) for d in DOMAINS], "domain string")
    return every.join(counts, "domain", "left").na.fill(0, ["count"])
