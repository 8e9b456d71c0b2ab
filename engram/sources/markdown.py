"""Markdown corpora: scan, roles, sections, selection and triage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from engram.functions import lexicons as lx
from engram.functions.text import first_match, js_trim


def read_markdown(spark: SparkSession, path: str, profile: str = "corpus") -> DataFrame:
    """(path, name, content, size, modified) of every ``.md`` below ``path``.

    ``corpus`` skips dot folders and seven named ones; ``search`` keeps five
    root files and the ``memory`` tree without its skip list. Only the names of
    files are read for the choice, contents of dropped files are not decoded.
    """
    files = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .option("pathGlobFilter", "*.md")
        .load(path)
    )
    root = path.rstrip("/").removeprefix("file:")
    full = F.regexp_replace("path", r"^[a-z0-9]+:/*", "/")
    relative = F.substring(full, len(root) + 2, 10_000)
    folders = F.slice(F.split(relative, "/"), F.lit(1), F.size(F.split(relative, "/")) - 1)
    named = files.select(
        relative.alias("path"), F.element_at(F.split(relative, "/"), -1).alias("name"), folders.alias("_folders"),
        F.decode("content", "UTF-8").alias("content"), F.col("length").alias("size"),
        F.col("modificationTime").alias("modified"),
    )
    if profile == "search":
        skip = F.array(*[F.lit(d) for d in lx.SEARCH_SKIP_DIRS])
        in_root = (F.size("_folders") == 0) & F.col("name").isin(lx.SEARCH_ROOT_FILES)
        in_tree = (F.try_element_at("_folders", F.lit(1)) == "memory") & ~F.arrays_overlap("_folders", skip)
        kept = named.filter(in_root | F.coalesce(in_tree, F.lit(False)))
    else:
        bad = F.exists("_folders", lambda d: d.startswith(".") | d.isin(lx.CORPUS_SKIP_DIRS))
        kept = named.filter(~bad)
    return kept.drop("_folders")


def with_file_role(files: DataFrame) -> DataFrame:
    name = F.lower("name")
    rules = [(name == n, role) for n, role in lx.FILE_ROLES]
    rules += [(name.rlike(r"^\d{4}-\d{2}-\d{2}\.md\z"), "daily"), (F.col("path").contains("research"), "research")]
    return files.withColumn("role", first_match(rules, "other"))


def split_sections(files: DataFrame, max_level: int = 6) -> DataFrame:
    """Headed sections with more than 20 trimmed characters, one row each.

    A file is one row of the source, so its lines are cut inside that row; no
    shuffle is needed.
    """
    heading = r"^#{1,%d}\s+.+\z" % max_level if max_level == 6 else r"^#{1,%d}\s" % max_level
    lines = files.withColumn("_lines", F.split("content", "\n"))
    numbered = F.transform("_lines", lambda line, i: F.struct(i.alias("i"), line.alias("t")))
    start = F.struct(F.lit(-1).alias("i"), F.regexp_replace("name", r"\.md", "").alias("t"))
    marked = lines.withColumn(
        "_marks",
        F.concat(F.array(start), F.filter(numbered, lambda s: s["t"].rlike(heading))),
    )
    bounds = F.transform(
        "_marks",
        lambda s, k: F.struct(
            s["i"].alias("i"), s["t"].alias("t"),
            F.coalesce(F.try_element_at("_marks", k + 2)["i"], F.size("_lines")).alias("stop"),
        ),
    )
    cut = marked.withColumn("_s", F.explode(bounds))
    i, title, stop = F.col("_s.i"), F.col("_s.t"), F.col("_s.stop")
    opening = i < 0
    return cut.select(
        *[c for c in files.columns if c not in ("content", "size")],
        F.when(opening, title).otherwise(js_trim(F.regexp_replace(title, r"^#+\s*", ""))).alias("heading"),
        F.when(opening, 1).otherwise(F.length(F.regexp_extract(title, r"^(#+)", 1))).alias("level"),
        js_trim(F.array_join(F.slice("_lines", i + 2, stop - i - 1), "\n")).alias("content"),
        F.when(opening, 1).otherwise(i + 1).alias("line_start"),
        stop.alias("line_end"),
    ).filter(F.length("content") > 20)


def corpus_stats(files: DataFrame) -> DataFrame:
    """Files and kilobytes per role; needs ``role``."""
    return files.groupBy("role").agg(
        F.count("*").alias("files"), F.round(F.sum("size") / 1024).cast("bigint").alias("size_kb")
    )


def filter_by_manifest(files: DataFrame, manifest: DataFrame) -> DataFrame:
    """Keep files whose base name is listed as INGEST or SKIM (or the older LOW)."""
    wanted = manifest.filter(F.col("priority").isin("INGEST", "SKIM", "LOW")).select(
        F.element_at(F.split("file", "/"), -1).alias("name")
    )
    return files.join(wanted.distinct(), "name", "left_semi")


def triage_summary(triage: DataFrame) -> DataFrame:
    """Per priority: files, sections to read and their price in dollars."""
    priority = F.when(F.col("priority").isin("INGEST", "SKIM", "SKIP"), F.col("priority")).otherwise("SKIM")
    size = F.col("size")
    sections = (
        F.when(priority == "INGEST", F.ceil(size / F.lit(2000)))
        .when(priority == "SKIM", F.ceil(size / F.lit(4000)))
        .otherwise(0)
    )
    grouped = triage.groupBy(priority.alias("priority")).agg(
        F.count("*").alias("files"), F.sum(sections).alias("sections")
    )
    million = 1_000_000.0
    s = F.col("sections")
    cost = (
        F.when(F.col("priority") == "INGEST", s * 2200 / million * 15 + s * 200 / million * 75)
        .when(F.col("priority") == "SKIM", s * 1500 / million * 3 + s * 150 / million * 15)
        .otherwise(0.0)
    )
    return grouped.withColumn("cost", F.round(cost, 2))


def role_order(role: Column, order: dict[str, int]) -> Column:
    return first_match([(role == r, n) for r, n in order.items()], order["other"])


def select_files(
    files: DataFrame, roles: list[str] | None = None, skip: list[str] | None = None,
    order: dict[str, int] = lx.ROLE_ORDER_AUTO,
) -> DataFrame:
    df = files.withColumn("role_order", role_order(F.col("role"), order))
    if roles:
        df = df.filter(F.col("role").isin(roles))
    if skip:
        df = df.filter(~F.col("role").isin(skip))
    return df


def file_previews(files: DataFrame, done: DataFrame, batch: int = 5) -> DataFrame:
    """Heading lines and opening text of files not ingested yet, in numbered batches."""
    from engram.operators.ordering import places

    left = files.join(done.select("name").distinct(), "name", "left_anti")
    headers = F.array_join(
        F.slice(F.filter(F.split("content", "\n"), lambda line: line.startswith("#")), 1, 15), "\n"
    )
    text = F.concat(F.lit("HEADERS:\n"), headers, F.lit("\n\nPREVIEW:\n"), F.substring("content", 1, 500))
    ordered = places(left.select("path", "name", text.alias("preview")), ["path"], "position")
    return ordered.withColumn("batch", F.floor((F.col("position") - 1) / batch))
