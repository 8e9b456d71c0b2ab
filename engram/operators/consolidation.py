"""Learning from recent episodes: lessons, relationships, people, procedures, roll-ups, health."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from engram.functions.scores import clamp, half_if_missing, timestamp
from engram.functions.text import contains_any, no_strings, query_words
from engram.operators.matching import contained_terms, resolve_names, top_per, words_within
from engram.operators.ordering import places
from engram.operators.tables import apply_affirmations, identity_phrases
from engram.operators.vectors import first_above
from engram.session import use_checkpoints

INSIGHTS = (
    "insights array<struct<type:string,content:string,severity:string,"
    "related_entities:array<string>,confidence:double>>"
)


# --- model inputs and outputs ---------------------------------------------------------
def _first(df: DataFrame, n: int | None) -> DataFrame:
    return df if n is None else df.orderBy("id").limit(n)


def embedding_backlog(episodes: DataFrame, nodes: DataFrame, limit: int | None = 50) -> DataFrame:
    """(kind, id, text) of rows that still lack a vector, first ``limit`` of each kind."""
    ep_text = F.substring(
        F.concat_ws(" ", "summary", F.substring(F.coalesce("narrative", F.lit("")), 1, 600)), 1, 800
    )
    told = F.coalesce(F.try_element_at("attributes", F.lit("context")), F.lit(""))
    node_text = F.substring(F.concat(F.col("type"), F.lit(": "), F.col("name"), F.lit(". "), told), 1, 500)
    one = _first(episodes.filter("embedding IS NULL"), limit).select(F.lit("episode").alias("kind"), "id", ep_text.alias("text"))
    two = _first(nodes.filter("embedding IS NULL"), limit).select(F.lit("node").alias("kind"), "id", node_text.alias("text"))
    return one.unionByName(two)


def attach_vectors(rows: DataFrame, kind: str, vectors: DataFrame) -> DataFrame:
    """Rows with the vectors that a model gave for their backlog texts: (kind, id, embedding). A vector that is there stays.

    Of several answers for one row the first, by its components, counts.
    """
    given = vectors.filter((F.col("kind") == kind) & F.col("embedding").isNotNull()).groupBy("id").agg(F.min("embedding").alias("_given"))
    joined = rows.join(given, "id", "left").withColumn("embedding", F.coalesce("embedding", F.col("_given").cast(rows.schema["embedding"].dataType)))
    return joined.select(*rows.columns)


def embed_text(recipe: str) -> Column:
    """Text to embed: node recipes "full" and "plain", or "episode"."""
    if recipe == "episode":
        return F.concat(F.col("summary"), F.lit(". "), F.substring(F.coalesce("narrative", F.lit("")), 1, 500))
    blank = lambda c: F.when(F.length(c) > 0, c)
    known = F.when(F.size("aliases") > 0, F.concat(F.lit("Also known as: "), F.array_join("aliases", ", ")))
    parts = [F.concat(F.col("type"), F.lit(": "), F.col("name")), known, blank(F.col("context")), blank(F.col("significance"))]
    if recipe == "full":
        pairs = F.array_join(
            F.sort_array(F.transform(F.map_entries("attributes"), lambda e: F.concat(e["key"], F.lit(": "), e["value"]))), ". "
        )
        parts.append(blank(pairs))
    return F.concat_ws(". ", *parts)


def json_block(raw: Column) -> Column:
    """The fenced block of a model answer, else its outermost braces."""
    fenced = F.regexp_extract(raw, r"(?s)```(?:json)?\s*(.*?)```", 1)
    braces = F.regexp_extract(raw, r"(?s)(\{.*\})", 1)
    return F.when(F.length(fenced) > 0, fenced).otherwise(braces)


def parse_insights(raw: DataFrame, keep: list[str]) -> DataFrame:
    """One row per insight of the parsable answers; broken answers yield none."""
    parsed = F.coalesce(F.from_json(json_block(F.col("raw")), INSIGHTS), F.from_json(F.trim("raw"), INSIGHTS))
    return raw.select(*keep, F.posexplode(parsed["insights"]).alias("pos", "i")).select(*keep, "pos", "i.*")


def recent_window(episodes: DataFrame, as_of, hours: int = 24, n: int = 30) -> DataFrame:
    since = F.timestamp_micros(F.unix_micros(timestamp(as_of)) - hours * 3_600_000_000)
    return episodes.filter(F.col("created_at") > since).orderBy(F.col("created_at").desc(), "id").limit(n)


def backfill_batch(episodes: DataFrame, as_of, n: int = 20) -> DataFrame:
    until = F.timestamp_micros(F.unix_micros(timestamp(as_of)) - 24 * 3_600_000_000)
    return (
        episodes.filter((F.length("narrative") > 100) & (F.col("created_at") < until))
        .orderBy(F.col("importance_score").desc(), F.col("created_at").desc(), "id")
        .limit(n)
    )


def model_input(batch: DataFrame, persons: DataFrame | None = None) -> DataFrame:
    """Prompt texts of one bounded batch (see ``recent_window``, ``backfill_batch``)."""
    order = F.struct((-F.unix_micros("created_at")).alias("t"), "id", "participants", "summary", "narrative")
    rows = batch.agg(F.sort_array(F.collect_list(order)).alias("e"))
    who = lambda e: F.when(F.size(e["participants"]) > 0, F.array_join(e["participants"], ", ")).otherwise("unknown")
    head = lambda i: F.concat(F.lit("Episode "), (i + 1).cast("string"))
    told = lambda e: F.coalesce(e["narrative"], F.lit(""))
    full = F.transform(
        "e", lambda e, i: F.concat(head(i), F.lit(" ("), who(e), F.lit("):\n"), e["summary"], F.lit("\n"), told(e))
    )
    short = F.transform(
        "e", lambda e, i: F.concat(head(i), F.lit(": "), e["summary"], F.lit("\n"), F.substring(told(e), 1, 500))
    )
    return rows.select(
        F.substring(F.array_join(full, "\n\n---\n\n"), 1, 6000).alias("insight_text"),
        F.substring(F.array_join(short, "\n\n"), 1, 5000).alias("person_text"),
    )


def person_summaries(persons: DataFrame) -> DataFrame:
    list_or = lambda c: F.when(F.size(c) > 0, F.array_join(c, ", ")).otherwise("unknown")
    t = lambda c: F.coalesce(F.col(f"trust_from_them.{c}"), F.lit(0.5)).cast("string")
    return persons.select(
        "name",
        F.concat(
            F.col("name"), F.lit(" ("), F.col("relationship_type"), F.lit("): Trust[ability="), t("ability"),
            F.lit(", benevolence="), t("benevolence"), F.lit("], Values: "), list_or(F.col("core_values")),
            F.lit(", Frustrations: "), list_or(F.col("frustrations")),
        ).alias("summary"),
    )


# --- lessons -------------------------------------------------------------------------------
def _long_words(text: Column) -> Column:
    return query_words(F.lower(text), 4)


def match_lessons(insights: DataFrame, lessons: DataFrame, similarity: float = 0.75, first: int = 8) -> DataFrame:
    """(id, lesson_id) for lesson insights that repeat a known lesson.

    The first lesson (by id) with a close vector, when both sides carry an
    ``embedding``; else the first that shares enough long words, either word
    containing the other: three, or two for insights of at most eight.
    Insights with equal content are matched once.

    Only the first lesson counts, so lessons come in slices in their order, ``first`` of them and then twice as many as
    before, and an insight that has found its lesson meets no further one. Of the words of an insight the t - 1
    that most lessons of a slice have cannot bring t shared words alone: only the others find candidates (prefix filter).
    """
    spark = insights.sparkSession
    use_checkpoints(spark)
    told = insights.filter("type = 'lesson'").select("id", F.lower("content").alias("content"))
    texts = told.select("content").distinct().withColumn("words", F.sort_array(_long_words(F.col("content"))))
    # equal words follow each other, so that each is counted by where it and the next one begin
    starts = F.filter(F.transform("words", lambda w, i: F.struct(w.alias("iw"), i.alias("at"))), lambda s: (s["at"] == 0) | (s["iw"] != F.get("words", s["at"] - 1)))
    counts = F.transform("starts", lambda s, j: F.struct(s["iw"].alias("iw"), (F.coalesce(F.get("starts", j + 1)["at"], F.size("words")) - s["at"]).alias("times")))
    need = F.when(F.size("words") <= 8, 2).otherwise(3)
    mine = texts.withColumn("starts", starts).select(
        F.xxhash64("content").alias("key"), F.sha2("content", 256).alias("sha"), need.alias("need"), F.explode_outer(counts).alias("c")
    ).filter("c IS NOT NULL").select("key", "sha", "need", "c.iw", "c.times").checkpoint()
    theirs = lessons.select(F.col("id").alias("lesson_id"), F.explode(F.array_distinct(_long_words(F.col("statement")))).alias("lw"))
    order = places(lessons.select(F.col("id").alias("lesson_id")).distinct(), ["lesson_id"])
    theirs = theirs.join(order, "lesson_id").checkpoint()
    iw, lw = mine.select("iw").distinct(), theirs.select("lw").distinct()
    same = words_within(iw, "iw", lw, "lw").select("iw", "lw").unionByName(words_within(lw, "lw", iw, "iw").select("iw", "lw")).distinct()
    word_lessons = same.join(theirs, "lw").select("iw", "lesson_id", "place").distinct().checkpoint()
    total = order.count()
    found = None
    lo, hi = 0, first
    while lo < total:
        part = word_lessons.filter((F.col("place") > lo) & (F.col("place") <= hi))
        rows = mine if found is None else mine.join(found, ["key", "sha"], "left_anti")
        now = _first_shared(rows, part).checkpoint()
        found = now if found is None else found.unionByName(now).checkpoint()
        lo, hi = hi, hi * 3
    by_words = told.withColumns({"key": F.xxhash64("content"), "sha": F.sha2("content", 256)})
    if found is None:
        result = by_words.limit(0).select("id", F.lit(1).alias("kind"), F.lit(None).cast("string").alias("lesson_id"))
    else:
        result = by_words.join(found, ["key", "sha"]).select("id", F.lit(1).alias("kind"), "lesson_id")
    if "embedding" in insights.columns and "embedding" in lessons.columns:
        close = first_above(insights.filter("type = 'lesson'"), lessons, similarity)
        result = result.unionByName(close.select(F.col("item_id").alias("id"), F.lit(0).alias("kind"), F.col("first_id").alias("lesson_id")))
    return result.groupBy("id").agg(F.min(F.struct("kind", "lesson_id")).alias("m")).select("id", "m.lesson_id")


def _first_shared(rows: DataFrame, word_lessons: DataFrame) -> DataFrame:
    """(key, sha, lesson_id): the first lesson of a slice that shares enough words with the text."""
    often = word_lessons.groupBy("iw").agg(F.count("*").alias("often"))
    met = rows.join(often, "iw")
    by_rarity = Window.partitionBy("key", "sha").orderBy(F.col("often").desc(), "iw").rowsBetween(Window.unboundedPreceding, -1)
    # words of a text that come with more lessons than others, as long as these alone are too few
    seeds = met.withColumn("_above", F.coalesce(F.sum("times").over(by_rarity), F.lit(0))).filter(F.col("_above") + F.col("times") >= F.col("need"))
    candidates = seeds.select("key", "sha", "iw").join(word_lessons, "iw").select("key", "sha", "lesson_id").distinct()
    shared = met.select("key", "sha", "need", "iw", "times").join(word_lessons, "iw").join(candidates, ["key", "sha", "lesson_id"], "left_semi")
    enough = shared.groupBy("key", "sha", "need", "lesson_id").agg(F.sum("times").alias("n")).filter("n >= need")
    return enough.groupBy("key", "sha").agg(F.min("lesson_id").alias("lesson_id"))


def reinforce_lessons(lessons: DataFrame, matches: DataFrame, as_of) -> DataFrame:
    counts = matches.groupBy(F.col("lesson_id").alias("id")).agg(F.count("*").alias("_n"))
    out = lessons.join(counts, "id", "left").withColumn(
        "times_reinforced", (F.col("times_reinforced") + F.coalesce("_n", F.lit(0))).cast("int")
    )
    old = F.col("last_reinforced") if "last_reinforced" in lessons.columns else F.lit(None).cast("timestamp")
    return out.withColumn("last_reinforced", F.when(F.col("_n") > 0, timestamp(as_of)).otherwise(old)).drop("_n")


def new_lessons(insights: DataFrame, matches: DataFrame, as_of) -> DataFrame:
    fresh = insights.filter("type = 'lesson'").join(matches.select("id"), "id", "left_anti")
    return fresh.select(
        F.concat(F.lit("lesson:"), F.col("id")).alias("id"), F.col("content").alias("statement"),
        "severity", F.substring("content", 1, 200).alias("prevention_rule"),
        F.lit(1).alias("times_reinforced"), timestamp(as_of).alias("last_reinforced"), timestamp(as_of).alias("created_at"),
    )


# --- relationships, identity, people ----------------------------------------------------------
def discover_edges(insights: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """First edge per unordered pair of entities told together and not yet linked."""
    rows = insights.filter(F.size("related_entities") >= 2).select(
        "id", "type", "content", "related_entities", F.posexplode("related_entities").alias("i", "source")
    )
    pairs = rows.select(
        "id", "type", "content", "i", "source",
        F.posexplode(F.slice("related_entities", F.col("i") + 2, F.size("related_entities"))).alias("j", "target"),
    )
    s = resolve_names(pairs, nodes, "source").withColumnRenamed("node_id", "source_id")
    t = resolve_names(s, nodes, "target").withColumnRenamed("node_id", "target_id")
    keyed = t.filter("source_id IS NOT NULL AND target_id IS NOT NULL").withColumns(
        {"a": F.least("source_id", "target_id"), "b": F.greatest("source_id", "target_id")}
    )
    known = edges.select(F.least("source_id", "target_id").alias("a"), F.greatest("source_id", "target_id").alias("b"))
    first = (
        keyed.join(known, ["a", "b"], "left_anti")
        .groupBy("a", "b")
        .agg(F.min_by(F.struct("source_id", "target_id", "type", "content"), F.struct("id", "i", "j")).alias("e"))
    )
    kind = F.col("e.type")
    return first.select(
        "e.source_id", "e.target_id",
        F.when(kind == "decision", "influences").when(kind == "pattern", "relates_to").otherwise("works_with").alias("relationship"),
        F.lit("professional").alias("category"), F.lit(0.5).alias("strength"), F.lit(0.5).alias("confidence"),
        F.substring("e.content", 1, 200).alias("context"),
    )


def affirm_from_insights(identity: DataFrame, insights: DataFrame, as_of) -> DataFrame:
    """Once per entry when any insight holds one of its longer words."""
    key_words = F.filter(F.split(F.lower(F.replace("key", F.lit("-"), F.lit(" "))), r"\s+"), lambda w: F.length(w) > 3)
    value_words = F.filter(F.split(F.substring(F.lower("value"), 1, 100), r"\s+"), lambda w: F.length(w) > 4)
    terms = identity.select("key", F.explode(F.array_distinct(F.concat(key_words, value_words))).alias("term"))
    hits = contained_terms(insights.select("id", F.lower("content").alias("_low")), "_low", terms, "term", ["id"])
    return apply_affirmations(identity, hits.select("key").distinct().withColumn("_n", F.lit(1)), as_of)


def affirm_from_episodes(identity: DataFrame, episodes: DataFrame, as_of, hours: int = 24) -> DataFrame:
    since = F.timestamp_micros(F.unix_micros(timestamp(as_of)) - hours * 3_600_000_000)
    texts = episodes.filter(F.col("created_at") > since).select(
        "id", F.lower(F.concat_ws(" ", "summary", "narrative")).alias("_low")
    )
    hits = contained_terms(texts, "_low", identity_phrases(identity), "term", ["id"])
    return apply_affirmations(identity, hits.select("key").distinct().withColumn("_n", F.lit(1)), as_of)


def interactions_from_episodes(persons: DataFrame, episodes: DataFrame, as_of, hours: int = 24) -> DataFrame:
    since = F.timestamp_micros(F.unix_micros(timestamp(as_of)) - hours * 3_600_000_000)
    seen = episodes.filter(F.col("created_at") > since).select(F.explode("participants").alias("_p")).distinct()
    hit = F.col("_p").isNotNull()
    return (
        persons.join(seen, F.lower("name") == F.col("_p"), "left")
        .withColumn("total_interactions", F.col("total_interactions") + F.when(hit, 1).otherwise(0))
        .withColumn("last_interaction", F.when(hit, timestamp(as_of)).otherwise(F.col("last_interaction")))
        .select(*persons.columns)
    )


def _append_ignoring_case(old: Column, new: Column) -> Column:
    def add(acc, v):
        known = F.exists(acc, lambda x: F.lower(x) == F.lower(v))
        return F.when(known, acc).otherwise(F.array_append(acc, v))

    return F.aggregate(F.coalesce(new, no_strings()), F.coalesce(old, no_strings()), add)


def apply_person_updates(persons: DataFrame, updates: DataFrame, as_of) -> DataFrame:
    """Apply model updates per person in order of ``batch_order``.

    Trust moves by the deltas, cut to [0, 1] after each; unknown and zero trust
    count as one half. An answer of the model holds a person once, so the list
    gathered per person is as long as the number of answers in the batch.
    """
    keyed = updates.groupBy(F.lower("name").alias("_name")).agg(
        F.sort_array(
            F.collect_list(
                F.struct(
                    "batch_order", "trust_delta", F.map_entries("new_preferences").alias("prefs"),
                    "new_frustrations", "new_motivations",
                )
            )
        ).alias("_u")
    )
    trust = F.col("trust_from_them")

    def moved(field: str) -> Column:
        def step(acc, u):
            delta = F.coalesce(u["trust_delta"][field], F.lit(0.0))
            return F.when(delta == 0, acc).otherwise(clamp(half_if_missing(acc) + delta, 0.0, 1.0))

        return F.aggregate("_u", trust[field], step)

    joined = persons.join(keyed, F.lower("name") == F.col("_name"), "left")
    hit = F.col("_u").isNotNull()
    staged = joined.withColumns({f"_{f}": moved(f) for f in ("ability", "benevolence", "integrity")})
    composite = (
        half_if_missing(F.col("_ability")) * 0.3
        + half_if_missing(F.col("_benevolence")) * 0.4
        + half_if_missing(F.col("_integrity")) * 0.3
    )
    empty = F.create_map().cast("map<string,string>")

    def merge(acc, u):
        add = F.coalesce(F.map_from_entries(u["prefs"]), empty)
        return F.map_concat(F.map_filter(acc, lambda k, v: ~F.map_contains_key(add, k)), add)

    flat = lambda c: F.flatten(F.transform("_u", lambda u: F.coalesce(u[c], no_strings())))
    keep = lambda new, c: F.when(hit, new).otherwise(F.col(c))
    return staged.withColumns(
        {
            "trust_from_them": keep(
                F.struct(
                    F.col("_ability").alias("ability"), F.col("_benevolence").alias("benevolence"),
                    F.col("_integrity").alias("integrity"), composite.alias("composite"),
                ),
                "trust_from_them",
            ),
            "preferences": keep(F.aggregate("_u", F.coalesce("preferences", empty), merge), "preferences"),
            "frustrations": keep(_append_ignoring_case(F.col("frustrations"), flat("new_frustrations")), "frustrations"),
            "motivations": keep(_append_ignoring_case(F.col("motivations"), flat("new_motivations")), "motivations"),
            "total_interactions": F.col("total_interactions") + F.coalesce(F.size("_u"), F.lit(0)),
            "last_interaction": keep(timestamp(as_of), "last_interaction"),
        }
    ).select(*persons.columns)


# --- procedures -----------------------------------------------------------------------------------
def track_executions(procedures: DataFrame, episodes: DataFrame, strict: bool = True) -> DataFrame:
    """(name, ts, seq, success, outcome) of procedures seen in episodes.

    strict: a trigger occurs and at least min(2, steps) steps leave a word; only
    the newest such episode per procedure. Otherwise every (episode, procedure)
    with a trigger.
    """
    texts = episodes.select(
        "id", "created_at", "summary", F.lower(F.concat_ws(" ", "summary", F.coalesce("narrative", F.lit("")))).alias("_low")
    )
    terms = procedures.select("name", "steps", F.explode("trigger_phrases").alias("t")).withColumn("term", F.lower("t"))
    low = F.col("_low")
    hits = contained_terms(texts, "_low", terms, "term", ["id"])
    if strict:
        evidence = F.size(
            F.filter(
                "steps",
                lambda s: F.exists(F.slice(query_words(F.lower(s), 4), 1, 3), lambda w: low.contains(w)),
            )
        )
        hits = hits.filter(evidence >= F.least(F.lit(2), F.size("steps")))
    failed = ["failed", "error", "broken"] if strict else ["fail", "error", "broke", "broken"]
    success = ~contains_any(low, failed)
    rows = hits.select(
        "name", F.col("created_at").alias("ts"), F.col("id").alias("seq"), success.alias("success"),
        (F.when(success, "success").otherwise("failure") if strict else F.substring("summary", 1, 200)).alias("outcome"),
    ).dropDuplicates(["name", "seq"])
    if strict:
        return top_per(rows, ["name"], [F.col("ts").desc(), F.col("seq")], 1)
    return rows


# --- roll-ups -----------------------------------------------------------------------------------------
def stale_episodes(episodes: DataFrame, as_of, below: float) -> DataFrame:
    until = F.timestamp_micros(F.unix_micros(timestamp(as_of)) - 30 * 86_400_000_000)
    open_ = F.col("consolidated_into").isNull() if "consolidated_into" in episodes.columns else F.lit(True)
    return episodes.filter(
        ~F.col("decay_protected") & (F.col("importance_score") < below) & (F.col("created_at") < until)
        & (F.col("access_count") == 0) & open_
    )


def rollup_stale(episodes: DataFrame, as_of, below: float = 0.25, more_than: int = 5) -> tuple[DataFrame, DataFrame]:
    """(one summary row or none, (id, consolidated_into) marks).

    Only the first 2000 characters of the joined summaries are kept. Every
    summary brings at least its separator, so 1001 rows suffice.
    """
    stale = stale_episodes(episodes, as_of, below)
    n = stale.agg(F.count("*").alias("n"))
    head = stale.orderBy("created_at", "id").limit(1001).agg(
        F.substring(
            F.array_join(
                F.transform(
                    F.sort_array(F.collect_list(F.struct("created_at", "id", "summary"))), lambda s: s["summary"]
                ),
                "; ",
            ),
            1, 2000,
        ).alias("narrative")
    )
    one = lambda df: df.withColumn("_one", F.lit(1))
    new_id = F.concat(F.lit("rollup:"), F.date_format(timestamp(as_of), "yyyy-MM-dd"))
    summary = (
        one(n).join(one(head), "_one").filter(F.col("n") > more_than)
        .select(
            new_id.alias("id"), F.lit("consolidation").alias("session_id"),
            F.concat(F.lit("Consolidated "), F.col("n").cast("string"), F.lit(" low-importance memories")).alias("summary"),
            "narrative", F.lit(0.3).alias("importance_score"), F.lit(False).alias("decay_protected"),
            timestamp(as_of).alias("created_at"), F.col("n").alias("rolled_up"),
        )
    )
    # the summary is one row by construction, so it is the side that travels
    marks = one(stale.select("id")).join(
        F.broadcast(one(summary.select(F.col("id").alias("consolidated_into")))), "_one"
    ).drop("_one")
    return summary, marks


def rollup_daily(episodes: DataFrame, as_of, below: float = 0.3, more_than: int = 10, part: int = 1000) -> tuple[DataFrame, DataFrame]:
    """Daily variant: the whole joined text is kept, in parts of 1000 summaries.

    Part 0 carries the summary line (text cut at 500); further parts continue
    the narrative, so no row grows with the number of episodes.
    """
    stale = stale_episodes(episodes, as_of, below)
    placed = places(stale.select("id", "created_at", "summary"), ["created_at", "id"], "position").withColumn("part", F.floor((F.col("position") - 1) / part))
    joined = placed.groupBy("part").agg(
        F.array_join(
            F.transform(F.sort_array(F.collect_list(F.struct("position", "summary"))), lambda s: s["summary"]), "; "
        ).alias("narrative")
    )
    n = stale.agg(F.count("*").alias("n")).filter(F.col("n") > more_than)
    one = lambda df: df.withColumn("_one", F.lit(1))
    day = F.date_format(timestamp(as_of), "yyyy-MM-dd")
    first = F.concat(
        F.lit("Consolidated "), F.col("n").cast("string"), F.lit(" low-importance episodes from 30+ days ago: "),
        F.substring("narrative", 1, 500),
    )
    rows = one(joined).join(F.broadcast(one(n)), "_one").select(
        F.concat(F.lit("rollup:"), day, F.lit(":"), F.col("part").cast("string")).alias("id"), "part",
        F.lit("consolidation").alias("session_id"),
        F.when(F.col("part") == 0, first).otherwise(F.concat(F.lit("Continued part "), F.col("part").cast("string"))).alias("summary"),
        "narrative", F.lit(0.3).alias("importance_score"), F.lit(False).alias("decay_protected"),
        timestamp(as_of).alias("created_at"), F.col("n").alias("rolled_up"),
    )
    marks = one(placed.select("id", F.concat(F.lit("rollup:"), day, F.lit(":"), F.col("part").cast("string")).alias("consolidated_into"))).join(
        F.broadcast(one(n)), "_one"
    ).drop("_one", "n")
    return rows, marks


# --- health --------------------------------------------------------------------------------------------------
def health(tables: dict[str, DataFrame], contradictions: DataFrame | None = None, as_of=None, stale_days: int = 60) -> DataFrame:
    """One row: the score of 0 to 100, the measures it is made of, and those that are only reported.

    Reported: nodes not verified for ``stale_days`` before ``as_of`` (null without one), episodes
    with a vector and episodes with lessons.
    """
    nodes, edges, episodes = tables["nodes"], tables["edges"], tables["episodes"]
    one = lambda df: df.withColumn("_one", F.lit(1))

    def size(name: str) -> DataFrame:
        return tables[name].agg(F.count("*").alias(f"n_{name}"))

    told = F.try_element_at("attributes", F.lit("confidence")).cast("double")
    has = lambda c: (F.count_if(F.coalesce(F.size(c), F.lit(0)) > 0) if c in episodes.columns else F.lit(0).cast("bigint"))
    parts = [
        nodes.agg(
            F.count("*").alias("n_nodes"), F.count("embedding").alias("nodes_with_embedding"), F.avg(told).alias("_conf"),
            (F.lit(None).cast("bigint") if as_of is None
             else F.count_if(F.col("last_verified") < timestamp(as_of) - F.make_dt_interval(F.lit(stale_days)))).alias("stale_nodes"),
        ),
        size("edges"),
        episodes.agg(
            F.count("*").alias("n_episodes"), F.avg("importance_score").alias("_imp"),
            F.count_if("decay_protected").alias("protected"), has("decisions").alias("with_decisions"),
            (F.count("embedding") if "embedding" in episodes.columns else F.lit(0).cast("bigint")).alias("episodes_with_embedding"),
            has("lessons").alias("episodes_with_lessons"),
        ),
        tables["identity"].agg(F.count("*").alias("n_identity"), F.avg("emotional_weight").alias("_weight")),
        size("persons"), size("procedures"), size("lessons"),
        nodes.filter("type = 'person'")
        .join(
            edges.select(F.col("source_id").alias("id")).unionByName(edges.select(F.col("target_id").alias("id"))).distinct(),
            "id", "left_anti",
        )
        .agg(F.count("*").alias("orphans")),
        episodes.groupBy(F.xxhash64("summary"), F.length("summary")).agg(F.count("*").alias("c")).filter("c > 1").agg(F.count("*").alias("duplicates")),
        (nodes.limit(0).agg(F.count("*").alias("contradictions")) if contradictions is None
         else contradictions.agg(F.count_if(~F.col("resolved")).alias("contradictions"))),
    ]
    row = one(parts[0])
    for p in parts[1:]:
        row = row.join(one(p), "_one")
    share = lambda c, full, points: F.least(F.col(c) / full, F.lit(1.0)) * points
    left = lambda c: F.greatest(F.lit(0), F.lit(5) - F.col(c))
    coverage = F.when(F.col("n_nodes") > 0, F.col("nodes_with_embedding") / F.greatest("n_nodes", F.lit(1))).otherwise(0.0)
    score = (
        share("n_nodes", 100, 10) + share("n_edges", 500, 8) + share("n_episodes", 200, 8) + share("n_identity", 20, 5)
        + share("n_persons", 3, 4) + share("n_procedures", 10, 5) + coverage * 15
        + F.least(half_if_missing(F.col("_conf")), F.lit(1.0)) * 10
        + left("contradictions") + left("orphans") + left("duplicates")
        + F.coalesce("_imp", F.lit(0.0)) * 5 + share("protected", 30, 5) + share("with_decisions", 10, 5)
        + F.coalesce("_weight", F.lit(0.0)) * 5
    )
    return row.withColumns(
        {"score": F.round(score).cast("bigint"), "embedding_coverage": coverage, "avg_importance": F.col("_imp")}
    ).drop("_one", "_conf", "_imp", "_weight")
