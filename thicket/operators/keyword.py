"""Explainable keyword search over messages."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def query_terms(query: str) -> tuple[list[str], str | None]:
    """Distinct words of at least three signs in lower case, and their phrase if there are two or more."""
    terms = list(dict.fromkeys(t.lower() for t in re.findall(r"[\w.+#-]+", query) if len(t) >= 3))
    return terms, " ".join(terms) if len(terms) >= 2 else None


def document_weights(messages: DataFrame, terms: list[str], conversations: int) -> DataFrame:
    """(term, df, idf): conversations with each term, all terms in one pass."""
    low = F.lower("content")
    hits = F.filter(F.array(*[F.lit(t) for t in terms]), lambda t: F.contains(low, t))
    per = messages.where(F.col("content").isNotNull()).select("conversation_id", F.explode(hits).alias("term")).distinct()
    df = per.groupBy("term").agg(F.count("conversation_id").alias("df"))
    return df.withColumn("idf", idf(F.col("df"), conversations))


def idf(df: Column, conversations: int) -> Column:
    return F.least(F.lit(2.25), F.greatest(F.lit(0.65), 1 + F.log((1 + F.lit(max(1, conversations))) / (1 + F.greatest(df, F.lit(1))))))


def matches(messages: DataFrame, terms: list[str], phrase: str | None) -> DataFrame:
    """One row per message with a term: its terms with positions, and whether the phrase occurs."""
    low = F.lower("content")
    at = F.transform(F.array(*[F.lit(t) for t in terms]), lambda t: F.struct(t.alias("term"), F.instr(low, t).alias("pos")))
    out = messages.where(F.col("content").isNotNull()).withColumn("hits", F.filter(at, lambda h: h["pos"] > 0)).where(F.size("hits") > 0)
    return out.withColumn("in_phrase", F.contains(low, F.lit(phrase)) if phrase else F.lit(False))


def snippet(content: Column, pos: Column, width: int = 260, before: int = 100) -> Column:
    """A window of the text around a position, white space collapsed."""
    cut = F.substr(content, F.greatest(pos - before, F.lit(1)), F.lit(width))
    return F.trim(F.regexp_replace(cut, r"\s+", " "))


def one_line(text: Column, most: int = 240) -> Column:
    """White space collapsed, and an ellipsis in place of what is longer than ``most`` signs (40 at least); null is empty."""
    clean = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"[\s\p{Z}]+", " "))
    most = max(40, most)
    return F.when(F.length(clean) <= most, clean).otherwise(F.concat(F.rtrim(F.substring(clean, 1, most - 1)), F.lit("...")))


def warnings(*texts: Column) -> Column:
    """Warnings joined in order, each once; empty if there is none."""
    return F.array_join(F.array_distinct(F.array_compact(F.array(*texts))), "; ")


def evidence(found: DataFrame, terms: list[str], seq: str = "ingest_seq") -> DataFrame:
    """Per conversation: counts, coverage, and the best message by (phrase, all terms, coverage, least span, newest)."""
    n = len(terms)
    pos = F.transform("hits", lambda h: h["pos"])
    span = F.array_max(pos) - F.array_min(pos)
    m = found.withColumn("n_terms", F.size("hits")).withColumn("span", span)
    key = F.struct(F.col("in_phrase").cast("int").alias("p"), (F.col("n_terms") == n).cast("int").alias("a"), F.col("n_terms").alias("c"), (-F.col("span")).alias("s"), F.coalesce("created_at", F.lit(0.0)).alias("t"), (-F.col(seq)).alias("q"))
    flags = [F.max(_has(x)).alias(f"has_{i}") for i, x in enumerate(terms)]
    per = m.groupBy("conversation_id").agg(
        F.count(F.lit(1)).alias("messages"), F.sum(F.col("in_phrase").cast("long")).alias("phrase_messages"), F.sum((F.col("n_terms") == n).cast("long")).alias("all_messages"),
        F.max("created_at").alias("last_ts"), F.max(key).alias("best"), *flags,
    )
    found_terms = sum((F.col(f"has_{i}") for i in range(n)), F.lit(0))
    return per.withColumn("covered", found_terms).withColumn("coverage", F.col("covered") / n)


def _has(term: str) -> Column:
    return F.exists("hits", lambda h: h["term"] == F.lit(term)).cast("int")


def proximity(span: Column) -> Column:
    return F.when(span <= 120, 1.0).when(span <= 300, 0.8).when(span <= 800, 0.45).when(span <= 1600, 0.2).otherwise(0.0)


def score(ev: DataFrame, terms: list[str], weights: DataFrame, phrase: str | None) -> DataFrame:
    """Sum of weighted parts: term weights, all terms, phrase, coverage, one message with all, proximity,
    number of messages, scatter and size."""
    n = len(terms)
    w = F.broadcast(weights.groupBy().agg(F.map_from_entries(F.collect_list(F.struct("term", "idf"))).alias("w")))
    rows = ev.join(w)
    idf_sum = sum((F.col(f"has_{i}") * F.coalesce(F.col("w")[t], F.lit(0.0)) for i, t in enumerate(terms)), F.lit(0.0))
    near = F.when((F.col("best.c") > 1), proximity(-F.col("best.s"))).otherwise(0.0)
    parts = {
        "part_terms": 2 * idf_sum,
        "part_all": F.when(F.col("covered") == n, 2.0).otherwise(0.0),
        "part_phrase": F.when(F.col("phrase_messages") > 0, 3 + F.log1p(F.col("phrase_messages").cast("double"))).otherwise(0.0) if phrase else F.lit(0.0),
        "part_coverage": 3 * F.col("best.c") / n,
        "part_local": F.when(F.col("best.a") == 1, 2.0).otherwise(0.0),
        "part_near": 2.5 * near,
        "part_count": 0.75 * F.log1p(F.least(F.col("messages"), F.lit(40)).cast("double")),
        "part_scatter": -2.5 * (1 - F.col("best.c") / n),
        "part_size": -F.least(F.lit(2.0), F.log1p(F.col("messages") / 200.0)),
    }
    out = rows.select("conversation_id", "messages", "phrase_messages", "covered", "last_ts", *[c.alias(k) for k, c in parts.items()])
    return out.withColumn("score", sum((F.col(k) for k in parts), F.lit(0.0)))
