"""Dependency graphs (F6): edges from imports, closure, cycles, depth, coupling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestrata.session import durable

#: Import kinds that name an edge; every other kind is direct.
EDGE_KINDS = ("from_import", "relative", "star_import", "type_only", "dynamic")


def module_of(path: Column) -> Column:
    """Dotted module of a path: without the extension and without a closing __init__."""
    dotted = F.translate(F.regexp_replace(path, r"(?<=[^/\\])\.[^./\\]*$", ""), "/\\", "..")
    return F.regexp_replace(dotted, r"\.__init__$", "")


def resolve_relative(source: Column, target: Column, level: Column) -> Column:
    """Module that a relative import of ``level`` dots reaches from a module."""
    parts = F.split(source, r"\.")
    base = F.slice(parts, 1, F.greatest(F.size(parts) - level, F.lit(0)))
    full = F.array_join(F.when(F.coalesce(target, F.lit("")) != "", F.concat(base, F.array(target))).otherwise(base), ".")
    return F.when(level > F.size(parts), F.coalesce(F.nullif(target, F.lit("")), source)).otherwise(full)


def edges_of(imports: DataFrame, include_external: bool = True, include_stdlib: bool = False, local: DataFrame | None = None) -> DataFrame:
    """(source, target, edge_type, is_external, is_stdlib, line) of imports (path, module, kind, is_relative, relative_level, is_stdlib, line).

    local: (module) of the project; a target is external if it is neither relative nor local. Multiple edges stay.
    """
    source = module_of(F.col("path"))
    named = imports.withColumn("source", source).withColumn(
        "target", F.when(F.col("is_relative"), resolve_relative(F.col("source"), F.col("module"), F.col("relative_level"))).otherwise(F.col("module"))
    )
    if not include_stdlib:
        named = named.where(~F.col("is_stdlib"))
    if local is not None:
        named = named.join(local.select(F.col("module").alias("target")).distinct().withColumn("_local", F.lit(True)), "target", "left")
    else:
        named = named.withColumn("_local", F.lit(None).cast("boolean"))
    external = ~F.col("is_relative") & F.col("_local").isNull()
    kept = named if include_external else named.where(F.col("is_stdlib") | ~external)
    return kept.select("source", "target", F.when(F.col("kind").isin(*EDGE_KINDS), F.col("kind")).otherwise("direct").alias("edge_type"), external.alias("is_external"), "is_stdlib", "line")


def degrees(edges: DataFrame) -> DataFrame:
    """(node, n_imports, n_imported_by, coupling) over distinct neighbours; every node of an edge has a row."""
    pairs = edges.select("source", "target").distinct()
    ends = pairs.select(F.explode(F.array(F.struct(F.col("source").alias("node"), F.lit(1).alias("out"), F.lit(0).alias("into")), F.struct(F.col("target").alias("node"), F.lit(0).alias("out"), F.lit(1).alias("into")))).alias("e"))
    return ends.groupBy("e.node").agg(F.sum("e.out").alias("n_imports"), F.sum("e.into").alias("n_imported_by")).withColumn("coupling", F.col("n_imports") + F.col("n_imported_by"))


def closure(edges: DataFrame) -> DataFrame:
    """(source, target, distance) of all pairs that a path joins; a node on a cycle reaches itself.

    Distances double from round to round: a pair further apart than ``width`` has, on its shortest path, a node at exactly that
    distance from its source, so only the pairs at that distance are extended, by all that are known. There are as many rounds
    as the logarithm of the longest distance.
    """
    reached = durable(edges.select("source", "target").where("source IS NOT NULL AND target IS NOT NULL").distinct().withColumn("distance", F.lit(1)))
    width = 1
    while True:
        rim = reached.where(F.col("distance") == width).select("source", F.col("target").alias("mid"))
        if not rim.limit(1).count():
            return reached
        beyond = reached.select(F.col("source").alias("mid"), "target", (F.col("distance") + width).alias("distance"))
        grown = rim.join(beyond, "mid").groupBy("source", "target").agg(F.min("distance").alias("distance"))
        reached = durable(reached.unionByName(grown.join(reached.select("source", "target"), ["source", "target"], "left_anti")))
        width *= 2


def depths(reached: DataFrame) -> DataFrame:
    """(node, depth): the largest least distance from a node to what it depends on (breadth-first levels)."""
    return reached.groupBy(F.col("source").alias("node")).agg(F.max("distance").alias("depth"))


def cycles(edges: DataFrame) -> DataFrame:
    """(cycle, length, severity): for every edge on a cycle the shortest cycle through it, each cycle once, from its least node.

    Of several shortest ones, the one whose nodes come first in order. So each edge of a strongly connected component is in
    one of the reported cycles, of whatever length, and there are no more of them than edges; listing all simple cycles
    would take exponential time. severity is error if the closed list has at most three entries, else warning.
    """
    some = inner_edges(edges)
    reached = closure(some)
    back = reached.select(F.col("source").alias("target"), F.col("target").alias("source"))
    # Edges on a cycle, and the pairs of one component.
    inner = durable(some.join(back, ["source", "target"], "left_semi"))
    reached = durable(reached.join(back, ["source", "target"], "left_semi"))
    onward = reached.select(F.col("source").alias("next"), "target", (F.col("distance") + 1).alias("distance"))
    via = inner.withColumnRenamed("target", "next").join(onward, "next").join(reached, ["source", "target", "distance"]).select("source", "target", "next")
    direct = inner.select("source", "target", F.col("target").alias("next"))
    # The next node of the shortest path between two nodes.
    step = durable(via.unionByName(direct).groupBy("source", "target").agg(F.min(F.struct(F.col("next") != F.col("target"), "next")).alias("n")).select("source", "target", "n.next"))
    walks = inner.select(F.col("source").alias("start"), F.array("source").alias("path"), F.col("target").alias("at"))
    found = walks.where("at = start").select("path")
    while True:
        walks = walks.where("at <> start").join(step.select(F.col("source").alias("at"), F.col("target").alias("start"), "next"), ["at", "start"])
        walks = durable(walks.select("start", F.array_append("path", F.col("at")).alias("path"), F.col("next").alias("at")))
        if not walks.limit(1).count():
            break
        found = found.unionByName(walks.where("at = start").select("path"))
    least = F.array_position("path", F.array_min("path")).cast("int")
    turned = F.concat(F.slice("path", least, F.size("path")), F.slice("path", F.lit(1), least - 1))
    return found.select(turned.alias("path")).distinct().select(
        F.array_join(F.array_append("path", F.col("path")[0]), " -> ").alias("cycle"), F.size("path").alias("length"), F.when(F.size("path") <= 2, "error").otherwise("warning").alias("severity")
    )


def inner_edges(edges: DataFrame) -> DataFrame:
    """(source, target), distinct: a part of the edges that holds every edge on a cycle.

    Edges from nodes that nothing reaches, and to nodes that reach nothing, are dropped as long as a round drops a tenth of them;
    what is left beside cycles is settled by the closure.
    """
    kept = durable(edges.select("source", "target").where("source IS NOT NULL AND target IS NOT NULL").distinct())
    size = kept.count()
    while size:
        entered, left = kept.select(F.col("target").alias("source")).distinct(), kept.select(F.col("source").alias("target")).distinct()
        kept = durable(kept.join(entered, "source", "left_semi").join(left, "target", "left_semi").select("source", "target"))
        if (now := kept.count()) > 0.9 * size:
            break
        size = now
    return kept


def components(edges: DataFrame) -> DataFrame:
    """(component, node, n_nodes, shortest, severity) of every node on a cycle of any length.

    component: the least node of the strongly connected component. shortest: nodes of the shortest cycle through the node;
    severity by it, as in ``cycles``.
    """
    reached = durable(closure(inner_edges(edges)))
    back = reached.select(F.col("source").alias("target"), F.col("target").alias("source"))
    mutual = reached.join(back, ["source", "target"])
    shortest = F.min(F.when(F.col("source") == F.col("target"), F.col("distance")))
    return mutual.groupBy(F.col("source").alias("node")).agg(F.min("target").alias("component"), F.count(F.lit(1)).alias("n_nodes"), shortest.alias("shortest")).select(
        "component", "node", "n_nodes", "shortest", F.when(F.col("shortest") <= 2, "error").otherwise("warning").alias("severity")
    )


def metrics(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """One row of figures over edges and nodes (node, is_external, is_stdlib); averages over nodes that are not external."""
    deg = degrees(edges)
    per_node = nodes.join(deg, "node", "left").na.fill(0, ["n_imports", "n_imported_by"])
    inner = ~F.col("is_external")
    total = per_node.agg(
        F.count_if(inner).alias("total_modules"), F.count_if(F.col("is_external")).alias("external_dependencies"), F.count_if(F.col("is_stdlib")).alias("stdlib_dependencies"),
        F.coalesce(F.sum(F.when(inner, F.col("n_imports"))), F.lit(0)).alias("efferent"), F.coalesce(F.sum(F.when(inner, F.col("n_imported_by"))), F.lit(0)).alias("afferent"),
    )
    safe = lambda a, b: F.when(b > 0, F.round(a / b, 6)).otherwise(0.0)
    return total.crossJoin(edges.agg(F.count(F.lit(1)).alias("total_edges"))).select(
        "total_modules", "total_edges", "external_dependencies", "stdlib_dependencies",
        safe(F.col("efferent"), F.col("total_modules")).alias("avg_imports"), safe(F.col("afferent"), F.col("total_modules")).alias("avg_imported_by"),
        safe(F.col("efferent"), F.col("efferent") + F.col("afferent")).alias("instability"),
    )


def most_coupled(edges: DataFrame, k: int = 20) -> DataFrame:
    return degrees(edges).orderBy(F.col("coupling").desc(), "node").limit(k)


def mermaid_edges(edges: DataFrame, k: int = 20) -> DataFrame:
    """(line) of the diagram of the k most coupled nodes: the edges whose both ends are among them."""
    top = F.broadcast(most_coupled(edges, k).select("node"))
    name = lambda c: F.regexp_replace(c, r"\.", "_")
    return (
        edges.join(top.withColumnRenamed("node", "source"), "source", "left_semi").join(top.withColumnRenamed("node", "target"), "target", "left_semi")
        .select(F.concat(F.lit("    "), name("source"), F.lit(" --> "), name("target")).alias("line"))
    )


def to_json(edges: DataFrame) -> DataFrame:
    """(document): the graph (source, target, edge_type) as one JSON document per source node, so that no document grows with the graph."""
    targets = F.array_sort(F.collect_list(F.struct("target", "edge_type")))
    return edges.groupBy("source").agg(targets.alias("edges")).select(F.to_json(F.struct("source", "edges")).alias("document"))


def from_json(documents: DataFrame) -> DataFrame:
    """(source, target, edge_type) of documents (document) as ``to_json`` writes them; unreadable ones and nulls have no edges."""
    parsed = F.from_json("document", "source string, edges array<struct<target: string, edge_type: string>>")
    return documents.select(parsed.alias("g")).where("g.source IS NOT NULL").select("g.source", F.explode("g.edges").alias("e")).select("source", "e.target", "e.edge_type").where("target IS NOT NULL")
