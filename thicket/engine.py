"""One object with the public operations of the memory, over a folder of tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from thicket.config import AS_OF, Config
from thicket.functions import embed, times
from thicket.functions import vectors as V
from thicket.functions.keys import key
from thicket.operators import backfill, feedback, geometry, integrity, keyword, lineage, orphans, redelivery, retrieval
from thicket.session import Scratch, ship
from thicket.sources.store import Store
from thicket.streaming import poll as polling

FEEDBACK = "seq long, query_id string, branch_id string, score double, used boolean, corrected boolean, expanded boolean, usefulness_signal double, timestamp double"

JOBS = "id string, job_type string, target_id string, status string, payload_json string, created_ts double"


class UnknownBranch(KeyError):
    """No branch of that id."""


class Memory:
    """Tables are read from ``store`` where it has them, else from ``folder``; ``store`` takes what is written.

    Nothing reads the clock: ``now`` is an argument of the constructor.
    """

    def __init__(self, spark: SparkSession, folder: str, store: Store | None = None, now: float = AS_OF, dim: int = 64, cfg: Config = Config()):
        ship(spark)
        self.spark, self.folder, self.store, self.now, self.dim, self.cfg = spark, folder, store, now, dim, cfg

    # --- tables ---------------------------------------------------------------------------
    def table(self, name: str) -> DataFrame:
        stored = self.store.read(name) if self.store else None
        return stored if stored is not None else self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def nodes(self) -> DataFrame:
        return self.table("memory_nodes").withColumn("branch_id", key("branch_id"))

    def branches(self) -> DataFrame:
        return self.table("branch_states").withColumn("branch_id", key("branch_id"))

    def located(self) -> DataFrame:
        """Branches with the centroid of their nodes."""
        n = self.nodes().select("branch_id", "importance_score", "embedding")
        return self.branches().join(geometry.branch_geometry(n, self.dim).select("branch_id", "mean_vec"), "branch_id")

    # --- reading --------------------------------------------------------------------------
    def search(self, query: str, vector: list[float], top: int = 5, mode: str = "balanced", recency_boost: float = 0.0, half_life_days: float = 14.0,
               states: list[str] | None = None, max_age_days: float | None = None, min_age_days: float | None = None, after: float | None = None, before: float | None = None) -> dict[str, DataFrame]:
        """The channels of a search: geometry, collapsing, keyword, daily_log. Without side effects."""
        lo, hi = times.bounds(self.now, min_age_days, max_age_days, after, before)
        b = self.located().where(times.in_bounds(F.col("last_update_ts"), lo, hi))
        if states:
            b = b.where(F.col("state").isin(states))
        ranked = retrieval.cascade(b, vector, mode, top=self.cfg.result_limit, cfg=self.cfg)
        if recency_boost > 0:
            ranked = retrieval.blend(ranked, "total", "last_update_ts", recency_boost, self.now, half_life_days).orderBy(F.col("final").desc(), F.col("total").desc(), "branch_id")
        side = retrieval.score(b.where("state = 'COLLAPSING' AND node_count > 0"), vector, mode, cfg=self.cfg).orderBy(F.col("total").desc(), "branch_id").limit(top)
        out = {"geometry": ranked.limit(top), "collapsing": side}
        terms, phrase = keyword.query_terms(query)
        if terms:
            m = self.table("messages").where("conversation_id IS NOT NULL").where(times.in_bounds(F.col("created_at"), after, before))
            w = keyword.document_weights(m, terms, self.table("conversations").count())
            s = keyword.score(keyword.evidence(keyword.matches(m, terms, phrase), terms), terms, w, phrase)
            out["keyword"] = s.orderBy(F.col("score").desc(), F.col("phrase_messages").desc(), "conversation_id").limit(top)
            logs = self.table("daily_log_content")
            hit = F.lit(False)
            for t in terms:
                hit = hit | F.contains(F.lower("text"), F.lit(t))
            out["daily_log"] = logs.where(hit).orderBy(F.col("created_ts").desc(), "node_id").limit(top)
        return out

    def branch_report(self, branch_id: str) -> dict:
        """Scalars of one branch with counts by role, mode and kind of correction."""
        k = branch_id.strip().lower()
        row = self.branches().where(F.col("branch_id") == k).first()
        if row is None:
            raise UnknownBranch(branch_id)
        n = self.nodes().where(F.col("branch_id") == k)
        count = lambda c: {r[0]: r[1] for r in n.groupBy(F.coalesce(c, F.lit("unknown"))).count().collect()}  # noqa: E731  (roles, modes and kinds are short lists)
        return row.asDict() | {"roles": count("role"), "modes": count("update_mode"), "corrections": count("correction_kind")}

    def stats(self) -> DataFrame:
        return self.branches().groupBy("state", "regime").agg(F.count(F.lit(1)).alias("branches"), F.sum("node_count").alias("nodes"), *[F.avg(c).alias(f"avg_{c}") for c in ("eff_rank", "coherence", "role_diversity")])

    def snapshot(self, branch_ids: list[str] | None = None, state: str | None = None, limit: int | None = None, include_means: bool = False) -> DataFrame:
        b = self.located() if include_means else self.branches()
        if branch_ids is not None:
            b = b.where(F.col("branch_id").isin([x.strip().lower() for x in branch_ids]))
        if state and state.upper() not in ("ALL", "*"):
            b = b.where(F.col("state") == state.upper())
        b = b.orderBy(F.col("last_update_ts").desc_nulls_last(), "branch_id")
        return b.limit(limit) if limit is not None else b

    def latest_correction(self, node_id: str, chain_limit: int = 64) -> DataFrame:
        """The chain that a node belongs to, latest version first."""
        k = node_id.strip().lower()
        n = self.nodes().select(key("id").alias("id"), key("correction_root_id").alias("root"), "branch_id", "correction_kind", "correction_version", "timestamp", "ingest_seq")
        root = n.where(F.col("id") == k).select(F.coalesce("root", "id").alias("r")).limit(1)
        found = root.collect()  # one row at most
        r = F.lit(found[0]["r"] if found else None)
        chain = n.where((F.col("id") == r) | (F.col("root") == r))
        return chain.orderBy(F.col("correction_version").desc(), F.col("timestamp").desc(), F.col("ingest_seq").desc()).limit(chain_limit)

    def content(self, branch_id: str, max_entries: int = 100, max_chars: int = 250) -> DataFrame:
        """Texts behind the nodes of a branch, in order."""
        n = self.nodes().where(F.col("branch_id") == branch_id.strip().lower()).select(key("lcm_id").alias("k")).distinct()
        m = self.table("messages").select(key("message_id").alias("k"), F.lit("message").alias("kind"), "conversation_id", F.col("created_at").alias("ts"), "seq", "content")
        s = self.table("summaries").select(key("summary_id").alias("k"), "kind", "conversation_id", F.col("created_at").alias("ts"), F.lit(None).cast("long").alias("seq"), "content")
        rows = m.unionByName(s).join(n, "k", "left_semi").dropDuplicates(["k"])
        return rows.orderBy("ts", "seq", "k").limit(max_entries).withColumn("content", F.substring("content", 1, max_chars))

    def orphans(self) -> DataFrame:
        return integrity.orphan_edges(self.table("memory_edges"), self.nodes())

    def live_nodes(self) -> DataFrame:
        return orphans.live(self.table("memory_nodes"), "id", "timestamp", self.table("purged_records"), "memory_nodes")

    # --- writing --------------------------------------------------------------------------
    def enqueue(self, job_type: str, target: str | None, payload: str | None, created_ts: float) -> str:
        """A pending job; an equal one that is pending already is not added again."""
        job = f"{job_type}:{target or ''}:{created_ts}"
        new = self.spark.createDataFrame([(job, job_type, target, "pending", payload, created_ts)], JOBS)
        old = self.store.read("maintenance_jobs")
        if old is not None:
            new = new.join(old.where("status = 'pending'").select("job_type", F.coalesce("target_id", F.lit("")).alias("_t")), (new["job_type"] == old["job_type"]) & (F.coalesce(new["target_id"], F.lit("")) == F.col("_t")), "left_anti")
        self.store.upsert("maintenance_jobs", new.join(old.select("id"), "id", "left_anti") if old is not None else new, ["id"])
        return job

    def pending_jobs(self, limit: int = 10) -> DataFrame:
        return self.store.read("maintenance_jobs").where("status = 'pending'").orderBy("created_ts", "id").limit(limit)

    def complete(self, job: str) -> None:
        self.store.patch("maintenance_jobs", self.spark.createDataFrame([(job, "done")], "id string, status string"), ["id"])

    def set_state(self, name: str, value: str, table: str = "maintenance_state") -> None:
        """One value of upkeep under a name, such as a cursor or a mean."""
        self.store.upsert(table, self.spark.createDataFrame([(name, value)], "name string, value string"), ["name"])

    def get_state(self, name: str, table: str = "maintenance_state") -> str | None:
        one = self.spark.createDataFrame([(name,)], "name string")
        near = self.store.near(table, one, ["name"])
        row = near.where(F.col("name") == name).first() if near is not None else None
        return row["value"] if row else None

    def use_model(self, signature: dict, allow: bool = False) -> None:
        """Notes the model that vectors are made with; another one than before is refused unless allowed."""
        self.set_state("embedding_signature", embed.guard(self.get_state("embedding_signature"), signature, allow))

    def next_branches(self, count: int) -> list[str]:
        """The next branches in the order of their ids for a cycle of upkeep; at the end it begins again."""
        after = self.get_state("branch_cursor") or ""
        ids = self.branches().select("branch_id").where("branch_id IS NOT NULL")
        take = lambda df, n: [r["branch_id"] for r in df.orderBy("branch_id").limit(n).collect()]
        out = take(ids.where(F.col("branch_id") > after), count)
        if len(out) < count:
            out += [b for b in take(ids, count - len(out)) if b not in out]
        self.set_state("branch_cursor", out[-1] if out else "")
        return out

    def add_edges(self, edges: DataFrame) -> None:
        """Edges (src_id, dst_id, edge_type, weight, created_ts, edge_seq); the last write of a triple counts."""
        if not self.store.current("memory_edges"):
            self.store.replace("memory_edges", self.table("memory_edges"), ["edge_seq"])
        self.store.append("memory_edges", edges)

    def edges(self) -> DataFrame:
        return integrity.last_write(self.table("memory_edges"))

    def record_feedback(self, rows: DataFrame, source: str = "explicit") -> DataFrame:
        """Appends feedback within the limits of age and size; the branches' usefulness and error go on from their stored values.

        Signals are kept within 0 ... 1. Returns (branch_id, n, usefulness, retrieval_error) of the branches in ``rows``.
        """
        rows = rows.withColumn("usefulness_signal", F.when(F.col("usefulness_signal").isNotNull(), V.clamp(F.col("usefulness_signal"))))
        self.store.append("retrieval_feedback", rows.withColumn("feedback_source", F.lit(source.strip().lower())))
        self.store.replace("retrieval_feedback", feedback.retained(self.store.read("retrieval_feedback"), self.now, self.cfg))
        new = feedback.usefulness(rows.withColumn("branch_id", key("branch_id")), cfg=self.cfg)
        old = self.branches().select("branch_id", *[F.coalesce(c, F.lit(0.0)).alias(f"_{c}") for c in ("usefulness", "retrieval_error")])
        left = F.pow(F.lit(1 - self.cfg.feedback_lambda), F.col("n"))
        out = new.join(old, "branch_id", "left").select("branch_id", "n", *[(F.col(c) + left * F.coalesce(f"_{c}", F.lit(0.0))).alias(c) for c in ("usefulness", "retrieval_error")])
        if not self.store.current("branch_states"):
            self.store.replace("branch_states", self.branches(), ["branch_id"])
        out = Scratch(self.spark, "feedback").save(out)
        self.store.patch("branch_states", out.drop("n"), ["branch_id"])
        return out

    def cross_agent(self, branch_id: str | None = None, limit: int = 200) -> DataFrame:
        """Links shared across agents, the heaviest first; of one branch if given."""
        e = self.edges().where("edge_type = 'cross_agent_shared'")
        if branch_id is not None:
            b = branch_id.strip().lower()
            e = e.where((F.col("src") == b) | (F.col("dst") == b))
        return e.orderBy(F.col("weight").desc(), "src", "dst").limit(limit)

    def put_node(self, node: DataFrame) -> None:
        """Nodes that replace those with the same id."""
        if not self.store.current("memory_nodes"):
            self.store.replace("memory_nodes", self.table("memory_nodes"), ["id"])
        self.store.upsert("memory_nodes", node, ["id"])

    def add_log_entry(self, text: str, date: str, created_ts: float, vector: list[float], source: str = "manual_log") -> str:
        """One entry of a day's log as text and as node of the branch of that day."""
        stamp = int(created_ts * 1000)
        if self.spark.range(1).select(F.try_to_date(F.lit(date), "yyyy-MM-dd").alias("d")).first()["d"] is None:
            raise ValueError(f"not a date: {date}")
        node = f"node_{date.replace('-', '')}_{stamp}"
        entry = self.spark.createDataFrame([(node, text, source, created_ts)], "node_id string, text string, source string, created_ts double")
        if not self.store.current("daily_log_content"):
            self.store.replace("daily_log_content", self.table("daily_log_content"), ["node_id"])
        self.store.upsert("daily_log_content", entry, ["node_id"])
        row = (node, f"log_{stamp}", "daily_log_entry", f"day_{date}", created_ts, "user", max(1, len(text) // 4), vector)
        new = self.spark.createDataFrame([row], "id string, lcm_id string, node_type string, branch_id string, timestamp double, role string, token_count long, embedding array<float>")
        if not self.store.current("memory_nodes"):
            self.store.replace("memory_nodes", self.table("memory_nodes"), ["id"])
        self.store.append("memory_nodes", new)
        return node

    def poll(self, source: str, checkpoint: str, conversation_id: int | None = None):
        """Takes the messages that arrived since the last call and stops."""
        return polling.poll(self.spark, source, self.store, checkpoint, conversation_id)

    def backfill(self, conversation_ids: list[int], per_conversation: int = 200, resume: bool = True, dry_run: bool = False) -> DataFrame:
        """Status of each conversation; unless dry, its sampled messages become stored nodes of its branch."""
        ids = self.spark.createDataFrame([(int(i),) for i in dict.fromkeys(conversation_ids) if int(i) > 0], "conversation_id long")
        m = self.table("messages").join(F.broadcast(ids), "conversation_id", "left_semi")
        out = backfill.status(ids, m, self.branches().where("node_count > 0").select("branch_id"), per_conversation, resume)
        if not dry_run and self.store:
            todo = out.where("status = 'processed'").select("conversation_id")
            picked = backfill.stride_sample(m.join(todo, "conversation_id", "left_semi"), "conversation_id", per_conversation)
            new = m.join(picked.select("ingest_seq"), "ingest_seq", "left_semi").select(
                F.concat(F.lit("msg_"), F.sha2(key("message_id"), 256).substr(1, 16)).alias("id"), F.col("message_id").alias("lcm_id"), F.lit("message").alias("node_type"),
                F.concat(F.lit("conv_"), F.col("conversation_id").cast("string")).alias("branch_id"), F.col("created_at").alias("timestamp"), "role", "token_count", "ingest_seq",
            )
            self.store.upsert("backfilled_nodes", new, ["id"], F.col("ingest_seq"))
        return out

    def deduplicate(self) -> DataFrame:
        """Writes the nodes without repeated deliveries, with links led to the copies that stay; returns the map of copies."""
        n = self.nodes()
        dup = lineage.duplicate_map(n.where("node_type = 'message'").select("branch_id", key("lcm_id").alias("lcm_id"), "ingest_seq", key("id").alias("id")).where("lcm_id IS NOT NULL AND branch_id IS NOT NULL"))
        gone = redelivery.repeats(n.where("node_type = 'message'"), [F.col("branch_id"), key("lcm_id")], "ingest_seq", "timestamp").withColumnRenamed("seq", "ingest_seq")
        kept = n.join(gone, "ingest_seq", "left_anti")
        fixed = integrity.rewire(n, dup).select("ingest_seq", *[F.col(c).alias(f"_{c}") for c in ("parent_id", "correction_prev_id", "correction_root_id")])
        out = kept.join(fixed, "ingest_seq", "left")
        for c in ("parent_id", "correction_prev_id", "correction_root_id"):
            out = out.withColumn(c, F.coalesce(f"_{c}", c)).drop(f"_{c}")
        self.store.replace("memory_nodes", out)
        return dup

    def maintain(self) -> DataFrame:
        """Recomputes the scalars of branches with at least eight vectors, one step of a slow mean, and stores them."""
        names = ("eff_rank", "trace", "anisotropy", "coherence", "compression_loss")
        g = geometry.branch_geometry(self.nodes().select("branch_id", "importance_score", "embedding"), self.dim).where("n >= 8")
        new = g.select("branch_id", F.col("n").alias("_n"), *[F.col(c).alias(f"_{c}") for c in names])
        rho = self.cfg.ema_rho
        b = self.branches().join(new, "branch_id", "left")
        for c in names:
            b = b.withColumn(c, F.when(F.col("_n").isNotNull(), (1 - rho) * F.coalesce(c, F.lit(0.0)) + rho * F.col(f"_{c}")).otherwise(F.col(c)))
        b = b.withColumn("node_count", F.coalesce("_n", "node_count"))
        b = b.withColumn("regime", F.when(F.col("_n").isNotNull(), geometry.regime(F.col("coherence"), F.col("compression_loss"), F.col("eff_rank"), F.col("anisotropy"), self.cfg)).otherwise(F.col("regime")))
        self.store.replace("branch_states", b.drop("_n", *[f"_{c}" for c in names]))
        return self.store.read("branch_states")

    def nearest_nodes(self, vector: list[float], top: int = 10) -> DataFrame:
        """Nodes by cosine to one vector, exactly."""
        q = F.array(*[F.lit(float(x)) for x in vector])
        n = self.nodes().where(V.usable(F.col("embedding"), self.dim))
        return n.select("id", "branch_id", V.cosine(q, V.doubles("embedding")).alias("sim")).orderBy(F.col("sim").desc(), "id").limit(top)
