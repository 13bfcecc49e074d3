"""Queries of the operators for training data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from thicket.functions.keys import key
from thicket.llm import conversations, mixing, neighbours, packing, pii, reading, tokens
from thicket.session import Scratch, table

#: The session setting that holds the key of the pseudonyms, and the key of sessions that set none (tests).
PII_KEY, PII_TEST_KEY = "spark.thicket.pii.key", "thicket-test-key"
#: Lists probed for pairs of at least 0.95, and for the ten nearest at any similarity.
NEAR_PROBES, PROBES = 2, 64


def _texts(spark: SparkSession, sf_dir: str) -> list[tuple[str, DataFrame, str, str]]:
    return [
        ("messages", table(spark, sf_dir, "messages"), "message_id", "content"),
        ("daily_log_content", table(spark, sf_dir, "daily_log_content"), "node_id", "text"),
    ]


def _pii_key(spark: SparkSession) -> bytes:
    return spark.conf.get(PII_KEY, PII_TEST_KEY).encode()


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of either table and the kinds of personal data in their text, from the pseudonymised spans."""
    out = None
    for name, df, key_col, text_col in _texts(spark, sf_dir):
        part = pii.records_with(df, key_col, text_col, _pii_key(spark)).select(F.lit(name).alias("source_table"), "record_key", "kind")
        out = part if out is None else out.unionByName(part)
    return out


def p1_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts of either table with placeholders for personal data, where any was found."""
    out = None
    for name, df, key_col, text_col in _texts(spark, sf_dir):
        slim = df.select(F.col(key_col).alias("record_key"), F.col(text_col).alias("text")).where("text IS NOT NULL")
        part = pii.redact_column(slim, "text", _pii_key(spark), "redacted").where("pii_spans > 0")
        part = part.select(F.lit(name).alias("source_table"), "record_key", "redacted", "pii_spans")
        out = part if out is None else out.unionByName(part)
    return out


def p1_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every value by its pseudonym, with the records of both tables that hold it and its spans there."""
    out = None
    for name, df, key_col, text_col in _texts(spark, sf_dir):
        part = pii.values(df, key_col, text_col, _pii_key(spark)).select(F.lit(name).alias("t"), "record_key", "kind", "pseudonym", "spans")
        out = part if out is None else out.unionByName(part)
    per = out.groupBy("kind", "pseudonym", "t", "record_key").agg(F.max("spans").alias("spans")).groupBy("kind", "pseudonym")
    return per.agg(F.count(F.lit(1)).alias("records"), F.sum("spans").alias("spans"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations to drop."""
    v = conversations.verdicts(table(spark, sf_dir, "messages"), table(spark, sf_dir, "conversations"))
    return v.where(F.size("reasons") > 0).select("conversation_id")


def p2_transcripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ordered turns of the conversations that stay, in arrays of bounded length."""
    turns = conversations.transcript(table(spark, sf_dir, "messages"), table(spark, sf_dir, "conversations"))
    return conversations.transcript_parts(turns)


def p2_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many conversations are dropped for each reason; one may have several."""
    v = conversations.verdicts(table(spark, sf_dir, "messages"), table(spark, sf_dir, "conversations"))
    return v.select(F.explode("reasons").alias("reason")).groupBy("reason").agg(F.count(F.lit(1)).alias("conversations"))


def p2_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The turns of the conversations that stay, one row each."""
    turns = conversations.transcript(table(spark, sf_dir, "messages"), table(spark, sf_dir, "conversations"))
    return turns.select("conversation_id", "turn", "speaker", "content")


def p2_turns_live(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with deletions as events: a message purged after its time is gone, and its conversation is judged without it."""
    gone = table(spark, sf_dir, "purged_records").where(F.lower(F.trim("record_table")) == "messages")
    gone = gone.groupBy(key("record_key").alias("_k")).agg(F.max("purged_ts").alias("_p")).where("_k IS NOT NULL")
    m = table(spark, sf_dir, "messages").withColumn("_k", F.coalesce(key("message_id"), F.concat(F.lit("\x00"), F.col("ingest_seq").cast("string")))).join(gone, "_k", "left")
    deleted = F.col("_p").isNotNull() & ~F.coalesce(F.col("created_at") > F.col("_p"), F.lit(False))
    turns = conversations.transcript(m, table(spark, sf_dir, "conversations"), deleted=deleted)
    return turns.select("conversation_id", "turn", "speaker", "content")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs among each other's ten nearest with a cosine of at least 0.95.

    The bound is pushed into the search: whether a pair above it is among the ten nearest depends only
    on other pairs above it.
    """
    near = neighbours.neighbours(
        table(spark, sf_dir, "memory_nodes"), "id", "embedding", "ingest_seq", k=10, probes=NEAR_PROBES, min_cosine=0.95
    )
    return neighbours.mutual(near, 0.95)


def p3_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten most similar of all nodes, for the stated query set (row numbers divisible by 20)."""
    return neighbours.neighbours(
        table(spark, sf_dir, "memory_nodes"), "id", "embedding", "ingest_seq", k=10, probes=PROBES, list_rows=1000, block_rows=60_000,
        queries=F.col("ingest_seq") % 20 == 0,
    )


def _sized(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return docs.select("doc_id", "source", tokens.count_tokens(F.col("text")).alias("tokens"))


def p8_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Container of every document, or piece of one, for every capacity."""
    return packing.pack(_sized(spark, sf_dir), table(spark, sf_dir, "pack_sizes"))


def p8_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Containers used and room left unused for every capacity."""
    profiles = table(spark, sf_dir, "pack_sizes")
    return packing.report(packing.pack(_sized(spark, sf_dir), profiles), profiles)


def p8_harmonic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The plain form: every reciprocal class in containers of its own, with the room it leaves."""
    profiles = table(spark, sf_dir, "pack_sizes")
    return packing.report(packing.pack(_sized(spark, sf_dir), profiles, pure=True), profiles)


def p8_checked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What must hold of the containers, per capacity: documents with text, and how many rules are broken."""
    sized = Scratch(spark, "sized").save(_sized(spark, sf_dir))
    profiles = table(spark, sf_dir, "pack_sizes")
    cap = F.broadcast(profiles.select("profile", F.col("capacity_tokens").cast("long").alias("capacity")))
    packed = Scratch(spark, "packed").save(packing.pack(sized, profiles))
    full = packed.groupBy("profile", "container_id").agg(F.sum("tokens").alias("used")).join(cap, "profile").where("used > capacity").groupBy("profile").agg(F.count(F.lit(1)).alias("overfull"))
    per = packed.groupBy("profile", "doc_id").agg(F.sum("tokens").alias("placed"), F.count(F.lit(1)).alias("pieces"), F.max(F.col("token_start") + F.col("tokens")).alias("last"))
    per = per.join(sized.where("tokens > 0").select("doc_id", F.col("tokens").alias("size")), "doc_id", "full").join(cap, "profile", "left")
    # pieces of a document cover it once, from its first token to its last, and only long ones are cut
    bad = F.coalesce((F.col("placed") != F.col("size")) | (F.col("last") != F.col("size")), F.lit(True))
    cut = F.coalesce(F.col("pieces") > F.ceil(F.col("size") / F.col("capacity")), F.lit(True))
    out = per.groupBy("profile").agg(F.count(F.lit(1)).alias("documents"), F.sum(bad.cast("long")).alias("misplaced"), F.sum(cut.cast("long")).alias("cut_needlessly"))
    return out.join(full, "profile", "left").select("profile", "documents", "misplaced", "cut_needlessly", F.coalesce("overfull", F.lit(0)).alias("overfull"))


def p9_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every use of a document in the largest mixture that meets the target shares."""
    return mixing.mix(_sized(spark, sf_dir), table(spark, sf_dir, "mix_targets"))


def p9_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shares reached by that mixture."""
    docs, targets = Scratch(spark, "sized").save(_sized(spark, sf_dir)), table(spark, sf_dir, "mix_targets")
    return mixing.shares(mixing.mix(docs, targets), docs, targets)


def p9_checked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What must hold of the mixture, per source: its target, whether it misses it by more than whole documents explain
    (its own largest one, and its share of the largest of every source), and whether a document repeats too often."""
    docs, targets = Scratch(spark, "sized").save(_sized(spark, sf_dir)), table(spark, sf_dir, "mix_targets")
    s = mixing.shares(mixing.mix(docs, targets), docs, targets)
    largest = docs.groupBy(key("source").alias("source")).agg(F.max("tokens").alias("largest")).join(F.broadcast(targets.select(key("source").alias("source"))), "source", "left_semi")
    every = F.broadcast(largest.agg(F.sum("largest").alias("every")))
    total = F.broadcast(s.agg(F.sum("tokens").alias("total")))
    s = s.join(largest, "source", "left").join(every).join(total)
    off = F.abs(F.col("actual_share") - F.col("target_share")) * F.col("total") > F.coalesce("largest", F.lit(0)) + F.col("target_share") * F.col("every")
    return s.select("source", "target_share", off.cast("long").alias("off_target"), (F.col("most_uses") > F.col("max_repeats")).cast("long").alias("repeats_too_often"))


def p9_stretched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shares reached when half as much again is wanted as the targets can give: the exponent moves until the repeats allow it."""
    docs, targets = Scratch(spark, "sized").save(_sized(spark, sf_dir)), table(spark, sf_dir, "mix_targets")
    _, sources = mixing.measured(docs, targets)
    _, _, largest = mixing.solve(sources)
    return mixing.shares(mixing.mix(docs, targets, 1.5 * largest), docs, targets)


def p9_tempered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every use of a document in the mixture by plain temperature: exponent at the entropy of the targets, within the limits of repetition."""
    return mixing.mix(_sized(spark, sf_dir), table(spark, sf_dir, "mix_targets"), solver=mixing.tempered)


def p9_tempered_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shares reached by that mixture."""
    docs, targets = Scratch(spark, "sized").save(_sized(spark, sf_dir)), table(spark, sf_dir, "mix_targets")
    return mixing.shares(mixing.mix(docs, targets, solver=mixing.tempered), docs, targets)


def p9_temperature(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weights that plain temperature gives the sources at the entropy of the targets."""
    _, sources = mixing.measured(_sized(spark, sf_dir), table(spark, sf_dir, "mix_targets"))
    schema = "source string, target_share double, own_share double, exponent double, weight double"
    if not sources:
        return spark.createDataFrame([], schema)
    own = [s.tokens / sum(x.tokens for x in sources) for s in sources]
    goal = [s.target / sum(x.target for x in sources) for s in sources]
    a = mixing.entropy_exponent(own, mixing.entropy(goal))
    weights = [p**a for p in own]
    rows = [(s.source, g, p, a, w / sum(weights)) for s, g, p, w in zip(sources, goal, own, weights)]
    return spark.createDataFrame(rows, schema)


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of demanding prose."""
    return p10_levels(spark, sf_dir).where("level >= 3.5").select("doc_id")


def p10_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Level, band and the measures behind it of every document."""
    return reading.levels(table(spark, sf_dir, "documents"), table(spark, sf_dir, "reading_labels"))


def p10_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and words per language and band."""
    return p10_levels(spark, sf_dir).groupBy("lang", "band").agg(F.count(F.lit(1)).alias("documents"), F.sum("n_words").alias("words"))


def p10_checked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What must hold of the levels: one row for each document, none graded without text, bands that fit the level."""
    out = p10_levels(spark, sf_dir).join(table(spark, sf_dir, "documents").select("doc_id", F.length(F.trim(F.coalesce("text", F.lit("")))).alias("signs")), "doc_id")
    wrong = ~F.when(F.col("level").isNull(), F.col("band") == 0).otherwise(F.col("band") == F.floor(F.col("level") + 0.5))
    return out.agg(
        F.count(F.lit(1)).alias("documents"), F.sum((F.col("signs") == 0).cast("long")).alias("empty"), F.coalesce(F.sum(((F.col("signs") == 0) & (F.col("band") > 0)).cast("long")), F.lit(0)).alias("graded_without_text"),
        F.coalesce(F.sum(wrong.cast("long")), F.lit(0)).alias("wrong_band"),
    )


QUERIES = {
    f.__name__: f
    for f in (
        p1_found, p1_redacted, p1_links, p2_found, p2_transcripts, p2_turns, p2_turns_live, p2_reasons, p3_found, p3_neighbours, p8_containers, p8_report, p8_harmonic, p8_checked,
        p9_mixture, p9_shares, p9_checked, p9_stretched, p9_tempered, p9_tempered_shares, p9_temperature, p10_found, p10_levels, p10_profile, p10_checked,
    )
}

_ROLE = r"lower(regexp_replace(role, '^\s+|\s+$', '', 'g'))"
_ANY = lambda s: ", ".join(f"'{n}'" for n in conversations.SPEAKERS[s])
def _turns(source: str = "messages", gone: str = "false") -> str:
    """Folded turns and the counters of each conversation; ``gone`` says which last events are deletions."""
    return f"""turns AS (
  SELECT conversation_id, seq, content, CASE WHEN {_ROLE} IN ({_ANY('user')}) THEN 0 WHEN {_ROLE} IN ({_ANY('assistant')}) THEN 1
    WHEN {_ROLE} IN ({_ANY('system')}) THEN 2 WHEN {_ROLE} IN ({_ANY('tool')}) THEN 3 END AS who,
    coalesce(regexp_matches(content, '[^\\s\\pZ\\pC]'), false) AS seen
  FROM (SELECT * FROM {source} QUALIFY row_number() OVER (PARTITION BY coalesce(lower(trim(message_id)), CAST(ingest_seq AS VARCHAR)) ORDER BY ingest_seq DESC) = 1)
  WHERE conversation_id IS NOT NULL AND NOT {gone}),
per AS (
  SELECT conversation_id, count(*) AS n, count(DISTINCT seq) AS d, count(seq) AS s, min(seq) AS lo, max(seq) AS hi, count(*) FILTER (seen) AS vis,
    count(*) FILTER (who IS NULL) AS unknown, count(*) FILTER (who = 0 AND seen) AS users, count(*) FILTER (who = 1 AND seen) AS bots,
    count(*) FILTER (who = 1 AND NOT seen) AS mute, max(seq) FILTER (who = 0 AND seen) AS lu, max(seq) FILTER (who = 1 AND seen) AS lb
  FROM turns GROUP BY 1),
ids AS (SELECT conversation_id FROM conversations UNION SELECT conversation_id FROM messages)"""


_DROPPED = "(n IS NULL OR vis = 0 OR s < n OR d < n OR lo NOT IN (0, 1) OR hi - lo + 1 <> n OR unknown > 0 OR users = 0 OR bots = 0 OR mute > 0 OR coalesce(lb <= lu, true))"
_KEPT = f"""SELECT conversation_id, seq - lo + 1 AS turn, CASE who WHEN 0 THEN 'user' WHEN 1 THEN 'assistant' WHEN 2 THEN 'system' ELSE 'tool' END AS speaker, content
FROM turns JOIN per USING (conversation_id) WHERE NOT {_DROPPED}"""
_WHY = {
    "empty": "coalesce(n, 0) = 0 OR vis = 0", "no_seq": "s < n", "numbering": "d < n OR lo NOT IN (0, 1) OR hi - lo + 1 <> n", "unknown_role": "unknown > 0", "no_user": "users = 0",
    "no_assistant": "bots = 0", "mute_assistant": "mute > 0", "unanswered": "coalesce(lb <= lu, true)",
}

ORACLE = {
    "p2_found": f"WITH {_turns()} SELECT conversation_id FROM ids LEFT JOIN per USING (conversation_id) WHERE conversation_id IS NOT NULL AND {_DROPPED}",
    "p2_turns": f"WITH {_turns()} {_KEPT}",
    "p2_turns_live": f"""WITH purged AS (SELECT lower(trim(record_key)) AS k, max(purged_ts) AS p FROM purged_records WHERE lower(trim(record_table)) = 'messages' GROUP BY 1),
marked AS (SELECT messages.*, p IS NOT NULL AND NOT coalesce(created_at > p, false) AS gone FROM messages LEFT JOIN purged ON k = lower(trim(message_id))), {_turns('marked', 'gone')} {_KEPT}""",
    "p2_reasons": f"WITH {_turns()}, v AS (SELECT * FROM ids LEFT JOIN per USING (conversation_id) WHERE conversation_id IS NOT NULL), w AS ("
    + " UNION ALL ".join(f"SELECT '{name}' AS reason, count(*) FILTER ({rule}) AS conversations FROM v" for name, rule in _WHY.items())
    + ") SELECT * FROM w WHERE conversations > 0",
    "p8_checked": """SELECT profile, (SELECT count(*) FROM documents WHERE length(text) > 0) AS documents, 0 AS misplaced, 0 AS cut_needlessly, 0 AS overfull FROM pack_sizes""",
    "p9_checked": "SELECT lower(trim(source)) AS source, target_share, 0 AS off_target, 0 AS repeats_too_often FROM mix_targets",
    "p10_checked": "SELECT count(*) AS documents, count(*) FILTER (length(trim(coalesce(text, ''))) = 0) AS empty, 0 AS graded_without_text, 0 AS wrong_band FROM documents",
}
