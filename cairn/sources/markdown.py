"""Markdown stores and transcripts as DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

INDEXES = ["MEMORY.md", "MEMORY_FULL.md"]
HEAD = r"\A---\n((?s:.*?))\n---(?:\n|\z)"


def _plain(content: Column) -> Column:
    """Without byte order mark and carriage returns."""
    return F.regexp_replace(F.regexp_replace(content, "\\A\ufeff", ""), "\r\n", "\n")


def frontmatter(content: Column, nested_wins: bool = True) -> Column:
    """map<string,string> of the leading block: ``key: value`` lines, one level of nesting, matching quotes taken off.

    An inner key (an indented line) has precedence over an outer one, or the reverse. No block gives an empty map.
    """
    lines = F.filter(F.split(F.regexp_extract(_plain(content), HEAD, 1), "\n"), lambda x: x.rlike(r"^\s*[A-Za-z_][\w-]*:\s*\S"))
    pair = lambda x: F.struct(
        F.regexp_extract(x, r"^\s*([A-Za-z_][\w-]*):", 1).alias("key"), F.regexp_replace(F.regexp_extract(x, r"^\s*[A-Za-z_][\w-]*:\s*(.*?)\s*$", 1), r"""^(["'])(.*)\1$""", "$2").alias("value")
    )
    outer = F.transform(F.filter(lines, lambda x: ~x.rlike(r"^\s")), pair)
    inner = F.transform(F.filter(lines, lambda x: x.rlike(r"^\s")), pair)
    order = F.concat(inner, outer) if nested_wins else F.concat(outer, inner)
    first = F.filter(order, lambda x, i: F.array_position(F.transform(order, lambda y: y["key"]), x["key"]) == i + 1)
    return F.map_from_entries(first)


def body(content: Column) -> Column:
    return F.regexp_replace(_plain(content), HEAD, "")


def parse(files: DataFrame) -> DataFrame:
    """(file, name, description, memory_type, body, meta, source_mtime) of rows (file, content, mtime).

    A missing name is the stem with blanks for ``_``; a missing type is ``reference``; a missing description is empty.
    """
    meta = files.select("file", "mtime", "content", frontmatter(F.col("content")).alias("meta"))
    stem = F.replace(F.regexp_replace("file", r"\.md$", ""), F.lit("_"), F.lit(" "))
    return meta.select("file", F.coalesce(F.col("meta")["name"], stem).alias("name"), F.coalesce(F.col("meta")["description"], F.lit("")).alias("description"), F.coalesce(F.col("meta")["type"], F.lit("reference")).alias("memory_type"), body(F.col("content")).alias("body"), "meta", F.col("mtime").alias("source_mtime"))


def read_store(spark: SparkSession, root: str) -> DataFrame:
    """All ``<slug>/memory/*.md`` below ``root`` but the index files, parsed, with their slug."""
    raw = spark.read.format("text").option("wholetext", True).option("pathGlobFilter", "*.md").option("recursiveFileLookup", True).load(root)
    raw = raw.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_name").alias("file"), F.unix_seconds("_metadata.file_modification_time").alias("mtime"), F.col("value").alias("content"))
    raw = raw.where(~F.col("file").isin(INDEXES)).withColumn("slug", F.regexp_extract("path", r"([^/]+)/(?:memory/)?[^/]+\.md$", 1))
    parsed = parse(raw.select("content", "mtime", F.concat_ws("/", "slug", "file").alias("file")))
    where = F.split(F.col("file"), "/")
    return parsed.withColumn("slug", where[0]).withColumn("file", where[1])


def segments(lines: DataFrame) -> DataFrame:
    """(session, seg_id, kind, text, line_idx) of transcript lines (session, line_idx, raw_json).

    Side chains, turns that carry a tool result, other blocks than text and injected reminders fall out; a reminder that does not
    close empties its text. The rest is numbered by kind, U1.. and A1... Lines that are no JSON are skipped.
    """
    v = F.try_parse_json("raw_json")
    e = lines.select("session", "line_idx", v.alias("v")).where("v is not null")
    e = e.select("session", "line_idx", F.expr("try_variant_get(v, '$.type', 'string')").alias("type"), F.expr("coalesce(try_variant_get(v, '$.isSidechain', 'boolean'), false)").alias("side"), F.expr("try_variant_get(v, '$.message.content', 'array<struct<type string, text string>>')").alias("blocks"), F.expr("try_variant_get(v, '$.message.content', 'string')").alias("plain"))
    texts = F.when(F.col("blocks").isNull(), F.array("plain")).otherwise(F.transform(F.filter("blocks", lambda b: b["type"] == "text"), lambda b: b["text"]))
    keep = ~F.col("side") & F.col("type").isin("user", "assistant") & ~F.coalesce(F.exists("blocks", lambda b: b["type"] == "tool_result"), F.lit(False))
    rows = e.where(keep).select("session", "line_idx", F.col("type").alias("kind"), F.posexplode(texts).alias("block", "text"))
    bare = F.regexp_replace("text", r"(?is)<(system-reminder|relevant-memory)\b[^>]*>.*?</\1\s*>", "")
    clean = F.when(F.lower(bare).rlike(r"</?(system-reminder|relevant-memory)\b"), F.lit("")).otherwise(F.trim(bare))
    rows = rows.select("session", "line_idx", "kind", "block", clean.alias("text")).where("text <> ''")
    w = Window.partitionBy("session", "kind").orderBy("line_idx", "block")
    return rows.select("session", F.concat(F.upper(F.substring("kind", 1, 1)), F.row_number().over(w).cast("string")).alias("seg_id"), "kind", "text", "line_idx")


def render(parts: DataFrame, budget: int) -> DataFrame:
    """Segments of each session, oldest first, until the running length passes the budget; the first always stays."""
    w = Window.partitionBy("session").orderBy("line_idx", "seg_id")
    size = F.sum(F.length("text")).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return parts.withColumn("_sum", size).withColumn("_n", F.row_number().over(w)).where((F.col("_sum") <= budget) | (F.col("_n") == 1)).drop("_sum", "_n")


def write_upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``old`` that ``new`` does not replace, and ``new``; null keys compare equal."""
    named = new.select(*[F.col(k).alias(f"_n_{k}") for k in keys]).distinct()
    on = [F.col(k).eqNullSafe(F.col(f"_n_{k}")) for k in keys]
    return old.join(named, on, "left_anti").unionByName(new)
