"""Session transcripts: JSON lines to blocks, tool uses with their results, and an account of what could not be read.

``message.content`` is a string or an array of blocks; both come out as blocks. A line that is not an object is
counted as malformed and skipped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

BLOCK = "type string, text string, thinking string, id string, name string, input string, tool_use_id string, is_error boolean, content string"

#: Limits of one transcript: bytes, bytes of a line, records, events (content blocks).
FILE_BYTES, LINE_BYTES, RECORDS, EVENTS = 64 << 20, 8 << 20, 125_000, 25_000


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line, raw): the lines that are not blank, with their numbers from 0 in each file.

    Files are cut into byte ranges that are read apart, so no file is one row. A line belongs to the range that it
    begins in; its number is its place in the range and what the ranges of the file before hold. Blank lines count.
    """
    text = spark.read.option("lineSep", "\n").text(path)
    cut = text.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("at"), F.col("value").alias("raw"))
    ranges = cut.groupBy("file", "start").agg(F.min("at").alias("first"), F.count("*").alias("lines"))
    before = F.coalesce(F.sum("lines").over(Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = cut.join(ranges.select("file", "start", "first", before.alias("before")), ["file", "start"])
    numbered = placed.select("file", (F.col("at") - F.col("first") + F.col("before")).cast("int").alias("line"), F.regexp_replace("raw", "\r$", "").alias("raw"))
    return numbered.where(F.trim("raw") != "")


def fingerprints(spark: SparkSession, path: str) -> DataFrame:
    """(file, bytes, sha256) of the files; no fingerprint of a file beyond ``FILE_BYTES``, whose content is not read. Spark lists no empty files."""
    found = spark.read.format("binaryFile").load(path)
    small = found.where(F.col("length") <= FILE_BYTES).select(F.col("path").alias("file"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))
    return small.unionByName(found.where(F.col("length") > FILE_BYTES).select(F.col("path").alias("file"), F.col("length").alias("bytes"), F.lit(None).cast("string").alias("sha256")))


def records(lines: DataFrame) -> DataFrame:
    """(file, line, type, uuid, parent, ts, sidechain, content, bad) of every line."""
    get = lambda p: F.get_json_object("raw", p)
    variant = F.try_parse_json("raw")
    bad = variant.isNull() | ~F.schema_of_variant(variant).startswith("OBJECT") | (F.octet_length("raw") > LINE_BYTES)
    return lines.select("file", "line", get("$.type").alias("type"), get("$.uuid").alias("uuid"), get("$.parentUuid").alias("parent"), F.try_to_timestamp(get("$.timestamp")).alias("ts"), (get("$.isSidechain") == "true").alias("sidechain"), get("$.message.content").alias("content"), bad.alias("bad"))


def account(rows: DataFrame, files: DataFrame | None = None) -> DataFrame:
    """(file, records, malformed, events, over_limit), and of ``fingerprints`` bytes and sha256: what was read of each file.

    A file is over a limit by its bytes, its records, or its events: the content blocks of its records that are not
    malformed. ``within_limits`` leaves such files out. Files without a line are told of only with ``files``.
    """
    blocks = F.when(F.col("content").startswith("["), F.coalesce(F.size(F.from_json("content", "array<string>")), F.lit(0))).otherwise(F.when(F.col("content").isNotNull(), 1).otherwise(0))
    told = rows.groupBy("file").agg(F.count("*").alias("records"), F.count_if("bad").alias("malformed"), F.sum(F.when(F.col("bad"), 0).otherwise(blocks)).alias("events"))
    over = (F.col("records") > RECORDS) | (F.col("events") > EVENTS)
    if files is None:
        return told.withColumn("over_limit", over)
    none = F.lit(0).cast("long")
    joined = files.withColumn("file", F.regexp_replace("file", r"^file:/+", "file:///")).join(told.withColumn("file", F.regexp_replace("file", r"^file:/+", "file:///")), "file", "left")
    counts = {c: F.coalesce(c, none) for c in ("records", "malformed", "events")}
    return joined.withColumns(counts).withColumn("over_limit", over | (F.col("bytes") > FILE_BYTES)).select("file", "records", "malformed", "events", "over_limit", "bytes", "sha256")


def within_limits(rows: DataFrame, accounts: DataFrame) -> DataFrame:
    """The records of files that are over no limit."""
    return rows.join(accounts.where("over_limit").select("file"), "file", "left_anti")


def blocks(rows: DataFrame) -> DataFrame:
    """One row for each content block, a plain string as one block of type text."""
    fields = ", ".join(BLOCK.split(", "))
    parsed = F.from_json("content", f"array<struct<{fields.replace(' string', ':string').replace(' boolean', ':boolean')}>>")
    plain = F.array(F.from_json(F.to_json(F.struct(F.lit("text").alias("type"), F.col("content").alias("text"))), parsed_type()))
    many = F.when(F.col("content").startswith("["), parsed).otherwise(plain)
    each = rows.where(~F.col("bad") & F.col("content").isNotNull()).select("file", "line", F.col("type").alias("record"), "uuid", "ts", F.posexplode(many).alias("pos", "block"))
    return each.select("file", "line", "pos", "record", "uuid", "ts", "block.*")


def parsed_type() -> str:
    return "struct<" + BLOCK.replace(" string", ":string").replace(" boolean", ":boolean").replace(", ", ",") + ">"


def thinking(found: DataFrame, pattern: str | None = None) -> DataFrame:
    """Thinking blocks, all or those with a pattern in either case."""
    rows = found.where("type = 'thinking' and thinking is not null")
    return rows.where(F.col("thinking").rlike(f"(?i){pattern}")) if pattern else rows


def tool_uses(found: DataFrame) -> DataFrame:
    """(file, line, pos, id, name, input, ts, result, failed, done_at): uses with the result of their id; ambiguous ids (used or answered twice) get none."""
    uses = found.where("type = 'tool_use'").select("file", "line", "pos", "id", "name", "input", "ts")
    results = found.where("type = 'tool_result'").groupBy("file", "tool_use_id").agg(F.count("*").alias("n"), F.first("content").alias("result"), F.first("is_error").alias("failed"), F.first("ts").alias("done_at")).where("n = 1")
    twice = uses.groupBy("file", "id").agg(F.count("*").alias("uses"))
    joined = uses.join(twice, ["file", "id"], "left").join(results.withColumnRenamed("tool_use_id", "id").drop("n"), ["file", "id"], "left")
    single = F.col("uses") == 1
    return joined.select("file", "line", "pos", "id", "name", "input", "ts", *[F.when(single, F.col(c)).alias(c) for c in ("result", "failed", "done_at")])


#: Commands that check code, and words that tell of a failed try.
VALIDATION = r"\b(pytest|cargo test|npm test|xcodebuild|phpunit)\b"
MUTATION = ["Edit", "Write", "MultiEdit", "NotebookEdit"]


def objective_chains(uses: DataFrame) -> DataFrame:
    """(file, changed, failed_check, fixed, passed_check): a change, a failing check, a change of the same file, the same check passing; strictly in this order.

    For each failing check: the last change before it, the first change of that file after it and the first passing
    run of the same command after that; windows over a file's events, no pairs.
    """
    at = F.struct("line", "pos")
    target = F.get_json_object("input", "$.file_path")
    command = F.get_json_object("input", "$.command")
    rows = uses.withColumns({"at": at, "target": F.when(F.col("name").isin(MUTATION) & ~F.coalesce("failed", F.lit(False)), target), "check": F.when((F.col("name") == "Bash") & command.rlike(VALIDATION), command)})
    before = Window.partitionBy("file").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("last_change", F.last(F.when(F.col("target").isNotNull(), F.struct("at", "target")), ignorenulls=True).over(before))
    failed = rows.where("check is not null and failed and last_change is not null").select("file", F.col("at").alias("failed_check"), "check", "last_change")
    fixes = rows.where("target is not null").select("file", F.col("at").alias("fixed"), F.col("target").alias("fixed_target"))
    fixed = failed.join(fixes, "file").where((F.col("fixed_target") == F.col("last_change.target")) & (F.col("fixed") > F.col("failed_check"))).groupBy("file", "failed_check", "check", "last_change").agg(F.min("fixed").alias("fixed"))
    passed = rows.where("check is not null and not coalesce(failed, true)").select("file", F.col("check"), F.col("at").alias("passed_check"))
    done = fixed.join(passed, ["file", "check"]).where("passed_check > fixed").groupBy("file", "failed_check", "last_change", "fixed").agg(F.min("passed_check").alias("passed_check"))
    return done.select("file", F.col("last_change.at").alias("changed"), "failed_check", "fixed", "passed_check")
