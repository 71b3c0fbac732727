"""Property graphs as vertices(id, label, ...) and edges(src, dst, kind, ts, seq)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallgrass.functions.network import is_internal


def latest_edges(edges: DataFrame, order: list[str]) -> DataFrame:
    """Of the edges between two vertices the latest, whatever their kinds. A running maximum is combined before the shuffle."""
    rest = [c for c in edges.columns if c not in ("src", "dst", *order)]
    best = edges.groupBy("src", "dst").agg(F.max(F.struct(*order, *rest)).alias("e"))
    return best.select("src", "dst", *(F.col(f"e.{c}").alias(c) for c in [*order, *rest]))


#: What an event's kind makes of its edge, and the label of the vertex it leads to: fixed values.
EDGE_KIND = {"process_exec": "spawned", "file": "read_file", "net": "connected_to", "sql": "data_flow", "ssl": "connected_to", "dns": "resolved_dns", "tc": "data_flow"}
TARGET_LABEL = {"process_exec": "process", "file": "file", "net": "endpoint", "ssl": "endpoint", "tc": "endpoint", "sql": "host", "dns": "domain"}


def edges_of(events: DataFrame) -> DataFrame:
    """src, src_label, dst, dst_label, kind, ts, risk, is_internal of events(kind, pid, ts, risk, vertex, address, statement_hash, domain_hash).

    An endpoint's key is its address, a database's the statement's hash, a domain's its hash; 0 or null leaves the event's own vertex.
    """
    by = lambda values: F.create_map(*(x for k, v in values.items() for x in (F.lit(k), F.lit(v))))
    some = lambda c: F.coalesce(F.col(c) != 0, F.lit(False))
    endpoint = F.col("kind").isin("net", "ssl", "tc") & some("address")
    dst = F.when(endpoint, F.col("address")).when((F.col("kind") == "sql") & some("statement_hash"), F.col("statement_hash")).when((F.col("kind") == "dns") & some("domain_hash"), F.col("domain_hash")).otherwise(F.col("vertex"))
    label = lambda values, other: F.coalesce(F.try_element_at(by(values), F.col("kind")), F.lit(other))
    return events.select(
        F.col("pid").alias("src"), F.lit("process").alias("src_label"), dst.alias("dst"), label(TARGET_LABEL, "host").alias("dst_label"), label(EDGE_KIND, "data_flow").alias("kind"), "ts",
        F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("risk"))).alias("risk"), F.when(endpoint, is_internal(F.col("address"))).otherwise(F.lit(True)).alias("is_internal"),
    )


def merged(edges: DataFrame, new_edges: DataFrame, vertices: DataFrame, new_vertices: DataFrame, risks: DataFrame, order: list[str]) -> tuple[DataFrame, DataFrame]:
    """Edges and vertices after a delta. Of parallel edges the latest stays. vertices(id, label, risk, last_seen, is_canary): a new row takes
    an old one's place; risks(id, risk, at) set the risk, the latest last, and move last_seen on, for vertices that are not new."""
    all_edges = latest_edges(edges.unionByName(new_edges), order)
    update = risks.groupBy("id").agg(F.max_by("risk", "at").alias("__risk"), F.max("at").alias("__at"))
    kept = vertices.join(new_vertices.select("id"), "id", "left_anti").join(update, "id", "left")
    kept = kept.withColumns({"risk": F.coalesce("__risk", "risk"), "last_seen": F.greatest("last_seen", "__at")}).select(*vertices.columns)
    return all_edges, kept.unionByName(new_vertices.select(*vertices.columns))


def canaries(vertices: DataFrame, ids: DataFrame) -> DataFrame:
    """ids(id) with is_canary; unknown vertices are none."""
    return ids.join(vertices.select("id", "is_canary"), "id", "left").withColumn("is_canary", F.coalesce("is_canary", F.lit(False)))


def degrees(edges: DataFrame) -> DataFrame:
    return edges.groupBy("src").agg(F.count(F.lit(1)).alias("out_degree"))


def dump(vertices: DataFrame, edges: DataFrame, recent: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges for display. vertices(id, label, risk, is_internal, is_canary); edges(src, dst, kind, risk, ts); recent(src, dst, parent,
    event_type, comm, risk, ts): the last events, which are shown as edges beside the graph's.

    Nodes are the vertices that an edge or a recent event names, with out_degree in the graph, and for a process the name that its latest event
    gives it.
    """
    own = edges.select("src", "dst", "kind", F.lit("graph").alias("origin"), F.col("risk").cast("double").alias("risk"), "ts")
    shown = recent.select("src", "dst", F.concat(F.lit("event."), "event_type").alias("kind"), F.lit("event").alias("origin"), F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("risk").cast("double"))).alias("risk"), "ts")
    named = own.select(F.explode(F.array("src", "dst")).alias("id")).unionByName(recent.select(F.explode(F.array("src", "dst", "parent")).alias("id"))).filter("id IS NOT NULL").distinct()
    comm = recent.filter("comm <> ''").groupBy(F.col("src").alias("id")).agg(F.max_by("comm", "ts").alias("comm"))
    nodes = vertices.join(named, "id", "left_semi").join(degrees(edges).withColumnRenamed("src", "id"), "id", "left").join(comm, "id", "left")
    number = F.concat(F.lit("#"), F.col("id").cast("string"))
    process = F.concat(F.lit("Process "), F.when(F.col("comm").isNotNull(), F.concat("comm", F.lit(" ("), number, F.lit(")"))).otherwise(number))
    label = F.when(F.lower("label") == "process", process).otherwise(F.concat_ws(" ", "label", number))
    return nodes.select("id", label.alias("display_label"), F.col("label").alias("kind"), "risk", "is_internal", "is_canary", F.coalesce("out_degree", F.lit(0)).alias("out_degree")), own.unionByName(shown)


def neighbors(edges: DataFrame, sources: DataFrame) -> DataFrame:
    return edges.join(sources.select(F.col("id").alias("src")), "src", "left_semi").select("src", "dst").distinct()


def bfs(edges: DataFrame, starts: DataFrame, depth: int) -> DataFrame:
    """id, depth of all vertices reached from starts(id) in at most depth steps, each at its least depth.

    One join a step with the last step's new vertices; checkpointed, as each step builds on the one before.
    """
    frontier = starts.select("id").distinct().withColumn("depth", F.lit(0))
    visited = frontier
    for step in range(1, depth + 1):
        reached = edges.join(frontier.select(F.col("id").alias("src")), "src").select(F.col("dst").alias("id")).distinct()
        frontier = reached.join(visited, "id", "left_anti").withColumn("depth", F.lit(step))
        frontier = checkpointed(frontier)
        visited = visited.unionByName(frontier)
    return visited


def checkpointed(df: DataFrame) -> DataFrame:
    """df.checkpoint() into the folder of spark.checkpoint.dir; where none is set, as in tests, the plan is left as it is."""
    if df.sparkSession.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        return df.checkpoint()
    folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
    if folder:
        df.sparkSession.sparkContext.setCheckpointDir(folder)
        return df.checkpoint()
    return df


def k_hop(edges: DataFrame, starts: DataFrame, depth: int) -> tuple[DataFrame, DataFrame]:
    """The vertices within depth steps, and the edges among them."""
    near = bfs(edges, starts, depth)
    inside = near.select("id")
    within = edges.join(inside.withColumnRenamed("id", "src"), "src", "left_semi").join(inside.withColumnRenamed("id", "dst"), "dst", "left_semi")
    return near, within.select(*edges.columns)


def external_neighbors(edges: DataFrame, vertices: DataFrame, sources: DataFrame) -> DataFrame:
    """Neighbours that are external endpoints: vertices(id, label, is_internal)."""
    outside = vertices.filter((F.col("label") == "endpoint") & ~F.col("is_internal")).select(F.col("id").alias("dst"))
    return neighbors(edges, sources).join(outside, "dst", "left_semi")


def motif(edges: DataFrame, pattern: list[tuple[str, str | None, str]], apart: bool = True) -> DataFrame:
    """One column a variable: the vertices for which every edge of the pattern is there.

    pattern: (variable, kind, variable), kind None for any. Edges are joined one after the other, the rarest kind first, then always the
    rarest of those that share a variable with what is bound; an edge whose ends are both bound is a semi join, which never adds rows. Parallel edges count
    once. apart: different variables are different vertices. Each edge first keeps only vertices that the other edges of its variables
    have, so what a hub multiplies are rows that still can match; what is left of a hub's skew is split by adaptive execution.
    """
    counts = {r["kind"]: r["n"] for r in edges.groupBy("kind").agg(F.count(F.lit(1)).alias("n")).collect()}  # a few kinds
    size = lambda step: sum(counts.values()) if step[1] is None else counts.get(step[1], 0)

    def plain(step: tuple[str, str | None, str]) -> DataFrame:
        a, kind, b = step
        rows = edges if kind is None else edges.filter(F.col("kind") == kind)
        if a == b:
            return rows.filter("src = dst").select(F.col("src").alias(a)).distinct()
        return rows.select(F.col("src").alias(a), F.col("dst").alias(b)).distinct()

    def reduced(i: int) -> DataFrame:
        rows = plain(pattern[i])
        for j, other in enumerate(pattern):
            for v in sorted({pattern[i][0], pattern[i][2]} & {other[0], other[2]}):
                if j != i and size(other) <= size(pattern[i]):
                    rows = rows.join(plain(other).select(v).distinct(), v, "left_semi")
        return rows

    left = sorted(range(len(pattern)), key=lambda i: (size(pattern[i]), i))
    rows, bound = None, set()
    while left:
        near = [i for i in left if {pattern[i][0], pattern[i][2]} & bound]
        if bound and not near:
            raise ValueError("the pattern falls apart: every edge shares a variable with another")
        i = (near or left)[0]
        left.remove(i)
        ends = {pattern[i][0], pattern[i][2]}
        if rows is None:
            rows = reduced(i)
        elif ends <= bound:
            rows = rows.join(plain(pattern[i]), sorted(ends), "left_semi")
        else:
            rows = rows.join(reduced(i), sorted(ends & bound))
        for new in sorted(ends - bound) if apart else ():
            for old in sorted(bound):
                rows = rows.filter(F.col(new) != F.col(old))
        if apart and not bound and len(ends) == 2:
            rows = rows.filter(F.col(pattern[i][0]) != F.col(pattern[i][2]))
        bound |= ends
    return rows.select(*sorted(bound))


#: Rows that one task numbers, about.
NUMBER_ROWS = 1_000_000


def placed(rows: DataFrame, label: str, id: str, name: str = "number", each: int = NUMBER_ROWS) -> DataFrame:
    """rows with a number from 0 on, without gaps, within each label, in an order that depends on the ids only. The ids are distinct.

    Ids are dealt into buckets by hash; a bucket's rows are numbered where they are, from the number of rows in the buckets before it on. So
    a label that all rows have is numbered by many tasks.
    """
    buckets = max(1, -(-rows.count() // each))
    dealt = rows.withColumn("__bucket", F.pmod(F.xxhash64(F.col(id)), F.lit(buckets)))
    counts = dealt.groupBy(label, "__bucket").agg(F.count(F.lit(1)).alias("__n"))
    # as many rows a label as there are buckets
    before = Window.partitionBy(label).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(F.col(label).alias("__label"), F.col("__bucket").alias("__of"), F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
    within = F.row_number().over(Window.partitionBy(label, "__bucket").orderBy(id)) - 1
    met = dealt.withColumn("__within", within).join(starts, F.col(label).eqNullSafe(F.col("__label")) & (F.col("__bucket") == F.col("__of")))
    return met.withColumn(name, (F.col("__start") + F.col("__within")).cast("long")).select(*rows.columns, name)


def dense_ids(vertices: DataFrame, known: DataFrame | None = None, each: int = NUMBER_ROWS) -> DataFrame:
    """label, id, number: numbers 0 to n - 1 within each label. known(label, id, number), what an earlier call gave, stays as it is; vertices
    that it lacks get the numbers after."""
    found = vertices.select("label", "id").distinct()
    if known is None:
        return placed(found, "label", "id", each=each)
    both = (F.col("label").eqNullSafe(F.col("__l"))) & (F.col("id") == F.col("__i"))
    new = placed(found.join(known.select(F.col("label").alias("__l"), F.col("id").alias("__i")), both, "left_anti"), "label", "id", each=each)
    sizes = known.groupBy(F.col("label").alias("__l")).agg((F.max("number") + 1).alias("__size"))
    moved = new.join(sizes, F.col("label").eqNullSafe(F.col("__l")), "left").withColumn("number", F.col("number") + F.coalesce("__size", F.lit(0)))
    return known.select("label", "id", "number").unionByName(moved.select("label", "id", "number"))
