"""Store curation: latest deliveries, duplicates, links, drift, audit, line containment, clusters, budget fill."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairn.functions import text
from cairn.sources.tables import epoch_us, materialize


def latest(memories: DataFrame) -> DataFrame:
    """The last delivery of each (slug, file), by synced_at and then mem_id. Aggregated map-side, so a hot file is no hot task."""
    columns = [c for c in memories.columns if c not in ("slug", "file")]
    order = F.struct(F.coalesce(epoch_us("synced_at"), F.lit(-1).cast("long")).alias("t"), "mem_id")
    return memories.groupBy("slug", "file").agg(F.max_by(F.struct(*columns), order).alias("row")).select("slug", "file", *[F.col(f"row.{c}").alias(c) for c in columns])


def held(memories: DataFrame, trash: DataFrame) -> DataFrame:
    """Latest deliveries that no later deletion removed."""
    gone = trash.groupBy("slug", "file").agg(F.max(epoch_us("deleted_at")).alias("gone"))
    return latest(memories).join(gone, ["slug", "file"], "left").where(F.col("gone").isNull() | (F.col("gone") <= epoch_us("synced_at"))).drop("gone")


def repeated(rows: DataFrame, key: Column, id_col: str) -> DataFrame:
    """(key hash, n, first): values that stand in more than one row; null and empty values do not count."""
    keyed = rows.select(F.col(id_col).alias("id"), key.alias("key")).where(F.col("key") != "")
    return keyed.groupBy(F.sha1("key").alias("key")).agg(F.count("*").alias("n"), F.min("id").alias("first")).where("n > 1")


def prefix_clusters(files: DataFrame, least: int = 3) -> DataFrame:
    """(slug, key, n): files whose stems share their first part up to the second ``_`` or the first ``-``."""
    key = F.regexp_extract("file", r"^([^_]+_[^-_.]+)", 1)
    return files.groupBy("slug", key.alias("key")).agg(F.count("*").alias("n")).where(F.col("n") >= least)


def drift(store: DataFrame, points: DataFrame) -> DataFrame:
    """(slug, file, state): current, stale (point older than the delivery), missing from the index, or orphan in it."""
    s = store.groupBy("slug", "file").agg(F.max(epoch_us("synced_at")).alias("came"))
    p = points.groupBy("slug", "file").agg(F.max(epoch_us("updated_at")).alias("made"))
    state = F.when(F.col("made").isNull(), "missing").when(F.col("came").isNull(), "orphan").when(F.col("made") < F.col("came"), "stale").otherwise("current")
    return s.join(p, ["slug", "file"], "full_outer").select("slug", "file", state.alias("state"))


def resolve_links(store: DataFrame) -> DataFrame:
    """(slug, file, target_slug, target): wiki links resolved inside the slug, else where only one slug has the file.

    Links are taken without label, heading and blanks; self links and repeats fall out, unresolved links have a null target.
    """
    raw = store.select("slug", "file", F.explode(text.links(F.col("body"))).alias("raw"))
    name = F.btrim(F.regexp_replace("raw", r"[|#].*$", ""), F.lit(text.BLANKS))
    named = raw.select("slug", "file", F.when(name.endswith(".md"), name).otherwise(F.concat(name, F.lit(".md"))).alias("want")).where("want <> '.md'").distinct()
    own = store.select(F.col("slug"), F.col("file").alias("want"), F.col("slug").alias("own")).distinct()
    alone = own.groupBy("want").agg(F.count("*").alias("slugs"), F.min("own").alias("other")).where("slugs = 1").drop("slugs")
    joined = named.join(own, ["slug", "want"], "left").join(alone, "want", "left")
    to = F.coalesce("own", "other")
    return joined.select("slug", "file", to.alias("target_slug"), F.when(to.isNotNull(), F.col("want")).alias("target"), "want").where(~((F.col("target_slug").eqNullSafe(F.col("slug"))) & (F.col("want") == F.col("file"))))


def audit(store: DataFrame) -> DataFrame:
    """(mem_id, finding): tiny, stale_marker, no_name, no_description, bad_type, empty_body, unsafe_file."""
    body = F.coalesce("body", F.lit(""))
    checks = [
        ("tiny", F.octet_length(body) < 200), ("stale_marker", text.matches(body, r"(?i)\b(deprecated|obsolete|superseded|outdated)\b")), ("no_name", F.coalesce(F.btrim("name"), F.lit("")) == ""), ("no_description", F.coalesce(F.btrim("description"), F.lit("")) == ""),
        ("bad_type", ~F.coalesce(F.col("memory_type").isin("user", "feedback", "project", "reference"), F.lit(False))), ("empty_body", F.btrim(body, F.lit(text.BLANKS)) == ""), ("unsafe_file", ~F.col("file").rlike(r"^[A-Za-z0-9._-]+\.md$") | F.col("file").contains("..")),
    ]
    found = F.filter(F.array(*[F.when(c, F.lit(n)) for n, c in checks]), lambda x: x.isNotNull())
    return store.select("mem_id", F.explode(found).alias("finding"))


def lost_lines(versions: DataFrame) -> DataFrame:
    """(mem_id, lost, kept) of each later delivery of a file: lines of the delivery before it that it lacks, counted as a multiset.

    ``versions``: mem_id, slug, file, synced_at, body. The delivery before is found by a window; lines are compared by two counts.
    """
    w = Window.partitionBy("slug", "file").orderBy("synced_at", "mem_id")
    pairs = versions.select("mem_id", F.lag("mem_id").over(w).alias("before"))
    lines = versions.select("mem_id", F.explode(F.split(F.coalesce("body", F.lit("")), "\n")).alias("line")).select("mem_id", F.rtrim("line").alias("line")).where("line <> ''")
    counted = lines.groupBy("mem_id", "line").agg(F.count("*").alias("n"))
    old = pairs.where("before is not null").join(counted.withColumnRenamed("mem_id", "before"), "before").select("mem_id", "line", F.col("n").alias("was"))
    both = old.join(counted, ["mem_id", "line"], "left")
    now = F.coalesce("n", F.lit(0))
    return both.groupBy("mem_id").agg(F.sum(F.greatest(F.col("was") - now, F.lit(0))).alias("lost"), F.sum(F.least("was", now)).alias("kept"))


def components(edges: DataFrame) -> DataFrame:
    """(node, component): least node of each connected component of (a, b), by alternating large and small stars.

    Every round is written to the shared folder; a hub is only ever aggregated, never collected. It ends when a round
    changes nothing, after a number of rounds that grows with the logarithm of the longest path.
    """
    now = materialize(edges.where("a is not null and b is not null and a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    nodes = now.select(F.col("a").alias("node")).union(now.select("b")).distinct()
    while True:
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("m").alias("a"), "b").where("a <> b").distinct()
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        lows = down.groupBy("a").agg(F.min("b").alias("m"))
        small = down.join(lows, "a").select(F.col("m").alias("x"), F.explode(F.array("a", "b")).alias("y")).where("x <> y").select(F.col("x").alias("a"), F.col("y").alias("b")).distinct()
        new = materialize(small, "star")
        if new.exceptAll(now).isEmpty() and now.exceptAll(new).isEmpty():
            break
        now = new
    roots = now.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("component"))
    return nodes.join(roots, "node", "left").select("node", F.coalesce("component", "node").alias("component"))


def cliques(pairs: DataFrame) -> DataFrame:
    """(cluster, member): whole components that are complete, else disjoint pairs taken greedily by score, then ids.

    ``pairs``: a < b, score. The greedy choice is made by rounds: a pair that is the best of both its ends is taken.
    """
    pairs = materialize(pairs.groupBy("a", "b").agg(F.max("score").alias("score")), "pairs")
    parts = components(pairs)
    inside = pairs.join(parts.withColumnRenamed("node", "a"), "a")
    edges = inside.groupBy("component").agg(F.count("*").alias("edges"))
    sizes = parts.groupBy("component").agg(F.count("*").alias("n"))
    full = edges.join(sizes, "component").where("2 * edges = n * (n - 1)").select("component")
    out = parts.join(full, "component", "left_semi").select(F.col("component").alias("cluster"), F.col("node").alias("member"))
    rest = materialize(inside.join(full, "component", "left_anti").select("a", "b", "score"), "rest")
    while not rest.isEmpty():
        order = F.struct((-F.col("score")).alias("s"), "a", "b")
        ends = rest.select(F.explode(F.array("a", "b")).alias("node"), order.alias("o"))
        best = ends.groupBy("node").agg(F.min("o").alias("o"))
        taken = best.groupBy("o.a", "o.b").agg(F.count("*").alias("n")).where("n = 2").select("a", "b")
        taken = materialize(taken, "taken")
        out = out.unionByName(taken.select(F.col("a").alias("cluster"), F.explode(F.array("a", "b")).alias("member")))
        used = taken.select(F.explode(F.array("a", "b")).alias("u"))
        rest = materialize(rest.join(used, F.col("a") == F.col("u"), "left_anti").join(used, F.col("b") == F.col("u"), "left_anti"), "rest")
    return out


def budget_fill(rows: DataFrame, budget: int) -> DataFrame:
    """(slug, id) taken by a greedy fill: in order, what fits the room left is taken, what does not is passed over.

    ``rows``: slug, id, pos (unique in the slug), size. Each round takes, for every slug, the longest run of fitting
    rows after the last decision (a running sum over the rows that still fit) and passes over the next one.
    """
    left = materialize(rows.select("slug", "id", "pos", F.col("size").cast("long").alias("size"), F.lit(budget).cast("long").alias("room")).where(F.col("size") <= budget), "left")
    taken = None
    run = Window.partitionBy("slug").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    while True:
        sums = left.withColumn("sum", F.sum("size").over(run)).withColumn("over", F.col("sum") > F.col("room"))
        first = sums.groupBy("slug").agg(F.min(F.when(F.col("over"), F.col("pos"))).alias("stop"), F.sum(F.when(~F.col("over"), F.col("size"))).alias("used"))
        marked = materialize(sums.join(first, "slug"), "marked")
        part = marked.where("stop is null or pos < stop").select("slug", "id")
        taken = part if taken is None else taken.unionByName(part)
        left = materialize(marked.where("pos > stop").select("slug", "id", "pos", "size", (F.col("room") - F.coalesce("used", F.lit(0))).alias("room")).where("size <= room"), "left")
        if left.isEmpty():
            return taken
