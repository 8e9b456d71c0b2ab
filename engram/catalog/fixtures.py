"""Memory tables derived from the given Parquet tables (whole tables, no subsets)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

EVENTS_AS_OF = "2024-01-31 00:00:00"
ORDERS_AS_OF = "2001-09-01 00:00:00"
DOCS_AS_OF = "2024-03-01 00:00:00"
DOC_TOPICS = ["que", "der", "and", "los", "the"]
EVENT_PROCEDURES = [
    # name, type, trigger phrases, steps, confidence, learned_from
    ("signup", "social", ["user", "grateful"], ["Welcome amazing people", "Write grateful thanks"], 0.9, ["7"]),
    ("click-status", "cognitive", ["status of order"], ["Check status first", "Report order number"], 0.8, ["8"]),
    ("purchase-rows", "technical", ["decided to buy"], ["Confirm decided amount", "Record since date"], 0.7, []),
    ("error-fix", "technical", ["build failed", "fix it"], ["Please repair build", "Check error load"], 0.6, ["9", "10"]),
    ("view-rows", "creative", ["looked at"], ["Run purchase rows again", "Looked rows count"], 0.5, []),
]
IDENTITY = [
    ("i1", "value-honesty", "the truth is told even when it is hard", "value", 0.9, 3),
    ("i2", "purchase-rows", "rows are bought when they are needed", "belief", 0.7, 0),
    ("i3", "growth-thanks", "grateful for amazing work and people", "growth_edge", 0.5, 8),
    ("i4", "voice", "status of order is reported with care", "voice", 0.4, 1),
    ("i5", "name", "an agent that keeps what matters", "core", 1.0, 12),
    ("i6", "covenant-user", "user looked after, build kept whole", "covenant", 0.8, 2),
]


def table(spark: SparkSession, root: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{root}/{name}.parquet")


def no_strings() -> Column:
    return F.array().cast("array<string>")


def messages_ev(spark: SparkSession, root: str, events: DataFrame | None = None) -> DataFrame:
    """Every event as a templated message; ``events`` may be a stream of the same rows."""
    ev = table(spark, root, "events") if events is None else events
    k = F.get_json_object("props", "$.k").cast("bigint").cast("string")
    price = F.format_string("%.2f", F.col("value"))
    user = F.col("user_id").cast("string")
    eid = F.col("event_id")
    body = (
        F.when(
            F.col("event_type") == "error",
            F.concat(
                F.lit("The build failed with an error, please fix it now! It cost $"), price,
                F.lit(" at "), k, F.lit("% load."),
            ),
        )
        .when(
            F.col("event_type") == "signup",
            F.concat(F.lit("Thank you! User "), user, F.lit(" says this is amazing work and we are grateful.")),
        )
        .when(
            F.col("event_type") == "purchase",
            F.concat(F.lit("We decided to buy "), k, F.lit(" rows for $"), price, F.lit(" since Jan 3, 2024.")),
        )
        .when(F.col("event_type") == "click", F.concat(F.lit("What is the status of order "), k, F.lit("?")))
        .otherwise(F.concat(F.lit("User "), user, F.lit(" looked at "), k, F.lit(" rows")))
    )
    text = (
        F.when(eid % 103 == 0, "ok")
        .when(eid % 101 == 0, "HEARTBEAT_OK")
        .when(eid % 97 == 0, F.concat(body, F.lit(" password: p"), eid.cast("string"), F.lit("abcdefgh")))
        .otherwise(body)
    )
    sender = (
        F.when(F.col("event_type") == "view", "system")
        .when(F.col("event_type") == "click", "agent")
        .otherwise("user")
    )
    return ev.select(
        eid.alias("message_id"), user.alias("session_id"), eid.alias("seq"),
        F.col("ts").cast("timestamp").alias("ts"),
        sender.alias("sender"),
        F.when(sender == "agent", "assistant").otherwise(sender).alias("role"), text.alias("text"),
    )


def messages_conv(spark: SparkSession, root: str) -> DataFrame:
    c = table(spark, root, "conversations")
    seconds = F.col("conv_id") * 3600 + F.col("turn") * 4
    start = F.unix_micros(F.lit("2024-01-01 00:00:00").cast("timestamp"))
    return c.select(
        F.col("conv_id").cast("string").alias("session_id"), F.col("turn").alias("seq"),
        F.timestamp_micros(start + seconds * 1_000_000).alias("ts"),
        F.col("role").alias("sender"), "role", "text",
    )


def status_context(balance: Column) -> Column:
    return F.when(balance < 0, "account paused").when(balance > 8000, "active priority").otherwise("regular")


def nodes(spark: SparkSession, root: str, embeddings: bool = True) -> DataFrame:
    """person, organization, place and tool nodes; vectors for persons that have one."""
    customer, supplier = table(spark, root, "customer"), table(spark, root, "supplier")
    orders, lines = table(spark, root, "orders"), table(spark, root, "lineitem")
    seen_c = orders.groupBy(F.col("o_custkey").alias("key")).agg(
        F.max("o_orderdate").alias("seen"), F.count("*").alias("sources")
    )
    seen_s = lines.groupBy(F.col("l_suppkey").alias("key")).agg(
        F.max("l_shipdate").alias("seen"), F.count("*").alias("sources")
    )
    start = F.lit("1998-01-01 00:00:00").cast("timestamp")

    def party(df, prefix, kind, key, name, balance, seen):
        return df.withColumnRenamed(key, "key").join(seen, "key", "left").select(
            F.concat(F.lit(prefix), F.col("key").cast("string")).alias("id"),
            F.lit(kind).alias("type"), F.col(name).alias("name"), no_strings().alias("aliases"),
            status_context(F.col(balance)).alias("context"),
            ((F.col("key") % 8) / 10.0 + 0.3).alias("confidence"),
            F.coalesce("seen", start).cast("timestamp").alias("last_verified"),
            F.coalesce("sources", F.lit(0)).cast("bigint").alias("source_count"),
            F.col("key").alias("vec"),
        )

    def fixed(df, kind):
        return df.select(
            "id", F.lit(kind).alias("type"), "name", no_strings().alias("aliases"),
            F.lit("regular").alias("context"), F.lit(0.9).alias("confidence"),
            start.alias("last_verified"), F.lit(0).cast("bigint").alias("source_count"),
            F.lit(None).cast("bigint").alias("vec"),
        )

    nation, region = table(spark, root, "nation"), table(spark, root, "region")
    part = table(spark, root, "part").select("p_name").distinct()
    out = (
        party(customer, "c", "person", "c_custkey", "c_name", "c_acctbal", seen_c)
        .unionByName(party(supplier, "s", "organization", "s_suppkey", "s_name", "s_acctbal", seen_s).withColumn("vec", F.lit(None).cast("bigint")))
        .unionByName(fixed(nation.select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("id"), F.col("n_name").alias("name")), "place"))
        .unionByName(fixed(region.select(F.concat(F.lit("r"), F.col("r_regionkey").cast("string")).alias("id"), F.col("r_name").alias("name")), "place"))
        .unionByName(fixed(part.select(F.concat(F.lit("t:"), F.col("p_name")).alias("id"), F.col("p_name").alias("name")), "tool"))
        .withColumn("last_modified", F.col("last_verified"))
        .withColumn("significance", F.lit(None).cast("string"))
        .withColumn("attributes", F.create_map().cast("map<string,string>"))
        .withColumn("confidence_basis", F.when(F.col("type") == "place", "stated").otherwise("observed"))
        .withColumn("emotional_weight", F.lit(0.0))
    )
    if embeddings:
        vectors = table(spark, root, "embeddings").select(F.col("vec_id").alias("vec"), "embedding")
        out = out.join(vectors, "vec", "left")
    return out.drop("vec")


def edges(spark: SparkSession, root: str) -> DataFrame:
    customer, supplier = table(spark, root, "customer"), table(spark, root, "supplier")
    nation = table(spark, root, "nation")
    orders, lines = table(spark, root, "orders"), table(spark, root, "lineitem")
    text = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    located = (
        customer.select(text("c", "c_custkey").alias("source_id"), text("n", "c_nationkey").alias("target_id"))
        .unionByName(supplier.select(text("s", "s_suppkey").alias("source_id"), text("n", "s_nationkey").alias("target_id")))
        .withColumns({"relationship": F.lit("located_in"), "category": F.lit("structural"), "strength": F.lit(0.9)})
    )
    inside = nation.select(
        text("n", "n_nationkey").alias("source_id"), text("r", "n_regionkey").alias("target_id"),
        F.lit("part_of").alias("relationship"), F.lit("structural").alias("category"), F.lit(0.9).alias("strength"),
    )
    works = (
        lines.join(orders, lines.l_orderkey == orders.o_orderkey)
        .groupBy("o_custkey", "l_suppkey")
        .agg(F.count("*").alias("n"))
        .select(
            text("c", "o_custkey").alias("source_id"), text("s", "l_suppkey").alias("target_id"),
            F.lit("works_with").alias("relationship"), F.lit("relational").alias("category"),
            F.least(F.lit(1.0), F.lit(0.3) + F.col("n") * 0.05).alias("strength"),
        )
    )
    return located.unionByName(inside).unionByName(works).withColumns(
        {
            "id": F.concat_ws(":", "source_id", "target_id", "relationship"),
            "confidence": F.lit(0.5),
        }
    )


def episodes_doc(spark: SparkSession, root: str, embeddings: bool = True) -> DataFrame:
    docs = table(spark, root, "documents")
    start = F.unix_micros(F.lit("2024-01-01 00:00:00").cast("timestamp"))
    low = F.lower("text")
    out = docs.select(
        F.col("doc_id").cast("string").alias("id"), "doc_id",
        F.timestamp_micros(start + F.col("doc_id") * 3_600_000_000).alias("created_at"),
        F.col("source").alias("session_id"), F.substring("text", 1, 100).alias("summary"),
        F.col("text").alias("narrative"), F.array("source").alias("participants"),
        F.array_compact(F.array(*[F.when(low.contains(t), F.lit(t)) for t in DOC_TOPICS])).alias("topics"),
        ((F.col("doc_id") * 37) % 100 / 100.0).alias("importance_score"),
        (F.col("doc_id") % 3).cast("int").alias("access_count"),
        (F.col("doc_id") % 7 == 0).alias("decay_protected"),
    )
    if embeddings:
        vectors = table(spark, root, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")
        out = out.join(vectors, "doc_id", "left")
    return out


def queries_bm(spark: SparkSession, root: str) -> DataFrame:
    """Benchmark texts, and one question per nation about its first supplier."""
    bm = table(spark, root, "benchmark").select(
        F.col("item_id").alias("query_id"), "text"
    )
    supplier, nation = table(spark, root, "supplier"), table(spark, root, "nation")
    first = supplier.groupBy("s_nationkey").agg(F.min("s_name").alias("s_name"))
    asked = nation.join(first, nation.n_nationkey == first.s_nationkey).select(
        (F.col("n_nationkey") + 1_000_000).cast("bigint").alias("query_id"),
        F.concat(
            F.lit("Which people are working with "), F.col("s_name"), F.lit(" in "), F.col("n_name")
        ).alias("text"),
    )
    vectors = table(spark, root, "embeddings").select(F.col("vec_id").alias("v"), "embedding")
    return (
        bm.unionByName(asked)
        .join(vectors, F.col("query_id") % 1_000_000 == F.col("v"), "left")
        .drop("v")
    )


def lessons_bm(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "benchmark").select(
        F.col("item_id").cast("string").alias("id"), F.col("text").alias("statement"),
        F.col("text").alias("prevention_rule"),
        F.when(F.col("item_id") % 3 == 0, "critical")
        .when(F.col("item_id") % 3 == 1, "important").otherwise("minor").alias("severity"),
        (F.col("item_id") % 5).cast("int").alias("times_reinforced"),
        F.lit("2024-01-15 00:00:00").cast("timestamp").alias("created_at"),
        F.col("item_id").cast("string").alias("learned_from"),
    )


def insights_doc(spark: SparkSession, root: str) -> DataFrame:
    kinds = ["lesson", "pattern", "preference", "decision", "emotional_moment"]
    kind = F.element_at(F.array(*[F.lit(k) for k in kinds]), (F.col("doc_id") % 5 + 1).cast("int"))
    return table(spark, root, "documents").select(
        F.col("doc_id").cast("string").alias("id"), kind.alias("type"),
        F.col("text").alias("content"),
        F.when(F.col("doc_id") % 3 == 0, "critical").otherwise("minor").alias("severity"),
    )


def procedures_ev(spark: SparkSession, root: str) -> DataFrame:
    """One procedure per event type seen, with its fixed triggers and steps."""
    seen = table(spark, root, "events").groupBy("event_type").agg(F.count("*").alias("n"))
    rows = spark.createDataFrame(
        [(p[0].split("-")[0], *p) for p in EVENT_PROCEDURES],
        "event_type string, name string, type string, trigger_phrases array<string>, "
        "steps array<string>, confidence double, learned_from array<string>",
    )
    return rows.join(seen, "event_type").select(
        F.concat(F.lit("p:"), F.col("name")).alias("id"), "name", "event_type", "type",
        "trigger_phrases", "steps", "confidence", "learned_from",
        F.lit(0).cast("bigint").alias("execution_count"),
        F.lit(0).cast("bigint").alias("success_count"),
        F.lit(0.0).alias("success_rate"),
        F.lit(None).cast("timestamp").alias("last_executed"),
    )


def identity_rows(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(
        IDENTITY,
        "id string, key string, value string, category string, emotional_weight double, times_affirmed int",
    )


def part_entities(spark: SparkSession, root: str) -> DataFrame:
    """Distinct part names as typed nodes: the noun decides the type."""
    noun = F.element_at(F.split("p_name", " "), -1)
    return table(spark, root, "part").select("p_name").distinct().select(
        F.concat(F.lit("t:"), F.col("p_name")).alias("id"),
        F.when(noun.isin("anvil", "bolt"), "project")
        .when(noun.isin("gear", "gizmo"), "tool")
        .when(noun.isin("plate", "ring"), "concept")
        .otherwise("organization").alias("type"),
        F.col("p_name").alias("name"), no_strings().alias("aliases"), F.lit(0.5).alias("confidence"),
    )


def order_sections(spark: SparkSession, root: str) -> DataFrame:
    """One section per order: the names of its parts, one line each."""
    lines, part = table(spark, root, "lineitem"), table(spark, root, "part")
    named = lines.join(part, lines.l_partkey == part.p_partkey)
    return named.groupBy(F.col("l_orderkey").alias("section_id")).agg(
        F.array_join(F.sort_array(F.collect_set("p_name")), "\n").alias("content")
    )


def files_nation(spark: SparkSession, root: str) -> DataFrame:
    """One markdown file per nation: headings, customers, segments."""
    customer, nation = table(spark, root, "customer"), table(spark, root, "nation")
    line = F.concat(
        F.lit("- **"), F.col("c_mktsegment"), F.lit("** "), F.col("c_name"),
        F.lit(" balance $"), F.format_string("%.2f", F.col("c_acctbal")),
    )
    body = customer.groupBy("c_nationkey").agg(
        F.count("*").alias("n"),
        F.array_join(
            F.transform(
                F.sort_array(F.collect_list(F.struct("c_custkey", line.alias("line")))), lambda s: s["line"]
            ),
            "\n",
        ).alias("lines"),
    )
    joined = nation.join(body, nation.n_nationkey == body.c_nationkey)
    name = (
        F.when(F.col("n_nationkey") == 0, "MEMORY.md")
        .when(F.col("n_nationkey") == 1, "lessons.md")
        .when(F.col("n_nationkey") % 3 == 0, F.format_string("2024-02-%02d.md", F.col("n_nationkey") + 1))
        .otherwise(F.concat(F.lower("n_name"), F.lit(".md")))
    )
    content = F.concat(
        F.lit("opening words that come before any heading\n# "), F.col("n_name"),
        F.lit("\nThe home of "), F.col("n").cast("string"), F.lit(" customers, see below.\n## Customers 🔥\n"),
        F.col("lines"), F.lit("\n### Notes\n**Mistake:** late delivery to Ann Marsh\n**Rule:** ship early\n"),
        F.lit("**Ann Marsh** and **Build Agent** met **Tom Fielding**\n#### Detail CRITICAL\nshort\n"),
        F.lit("## Decision\nWe decided that the decision is live and deployed for "), F.col("n_name"), F.lit(".\n"),
    )
    return joined.select(
        F.concat(F.lit("memory/"), name).alias("path"), name.alias("name"), content.alias("content"),
        F.length(content).cast("bigint").alias("size"),
        F.timestamp_micros(
            F.unix_micros(F.lit("2024-02-01 00:00:00").cast("timestamp")) + F.col("n_nationkey").cast("bigint") * 86_400_000_000
        ).alias("modified"),
    )
