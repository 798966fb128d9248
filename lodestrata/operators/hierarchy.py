"""Parent-child links to full hierarchies.

Method: weighted disjoint-set forests. Nodes are range-partitioned by group, so a group lies in one stretch or in few
neighbouring ones, however large it is. In each stretch the links are united by weight with path compression, each node
keeping its offset to the representative (``Forest``); that gives the top of its local tree, its depth below it and the
links that close a circle. Sets are then merged over the stretches (``_merge``): every set hooks onto the one that holds its top's
parent, and each round doubles the number of sets that a set has been merged with, so rounds grow with the logarithm of
the stretches that a path crosses. A set that is still moving after as many rounds as cover all of them is on a circle or leads
into one. Paths and pairs are materialised last, by walking the indexed parents of whole levels at once.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrata.session import durable, parallelism

#: Rows that a task gathers before it hands them on.
BATCH = 500_000


def name_links(nodes: DataFrame) -> DataFrame:
    """Resolve names to links: (group, id, name, parent_id) from (group, id, name, parent, children).

    The parent is, within the group, the node with the name of the trimmed ``parent``, or else of its last
    segment (separated by ``.``, ``::``, ``$``, ``#`` or ``/``). Where ``parent`` is null or blank, it is the
    node whose ``children`` list the trimmed name. Names that match nothing give no parent. Of several nodes
    that match, the one with the least id counts. Repeated ids count once.
    """
    # Three branches read the nodes, so their deduplication is done once.
    one = durable(nodes.select("group", "id", "name", "parent", "children").dropDuplicates(["id"]))
    strip = lambda c: F.regexp_replace(c, r"^\s+|\s+$", "")
    wanted, name = strip("parent"), strip("name")
    segment = F.trim(F.element_at(F.split(wanted, r"\.|::|\$|#|/"), -1))
    # Both kinds of index, names and lists of children, are asked in one join.
    key = lambda kind, c: F.struct(F.lit(kind).alias("kind"), c.alias("key"))
    keys = F.when(F.coalesce(wanted, F.lit("")) != "", F.array(key("name", wanted), key("name", segment))).otherwise(F.array(key("child", name)))
    asked = one.select("group", "id", F.posexplode(keys).alias("rank", "k")).select("group", "id", "rank", "k.kind", "k.key").where("key <> ''")
    names = one.where("name IS NOT NULL").select("group", F.lit("name").alias("kind"), F.col("name").alias("key"), "id")
    listed = one.select("group", F.lit("child").alias("kind"), F.explode("children").alias("child"), "id").select("group", "kind", strip("child").alias("key"), "id")
    index = names.unionByName(listed).where("key <> ''").groupBy("group", "kind", "key").agg(F.min("id").alias("parent_id"))
    found = asked.join(index, ["group", "kind", "key"]).groupBy("id").agg(F.min_by("parent_id", "rank").alias("parent_id"))
    return one.select("group", "id", "name").join(found, "id", "left").select("group", "id", "name", "parent_id")


class Forest:
    """Weighted disjoint sets of one stretch's nodes, with the offset of every node to its representative.

    After the links are united: ``top`` (index of the local tree's top), ``offset`` (links up to it), ``up`` (index of the parent
    in the stretch, -1 if it is not there), ``circle`` (for nodes of a set that a link closes, the index of the link's child,
    else -1; that child is then the top, and its parent lies in the same set).
    """

    def __init__(self, ids: list[int], parents: list[int | None]):
        n = len(ids)
        place = {node: k for k, node in enumerate(ids)}
        up = [place.get(p, -1) if p is not None else -1 for p in parents]
        self._head, self._shift, weight, tops = list(range(n)), [0] * n, [1] * n, list(range(n))
        closing: dict[int, int] = {}
        for child in range(n):
            parent = up[child]
            if parent < 0:
                continue
            below, depth = self._find(child)
            above, height = self._find(parent)
            if below == above:
                closing[above] = child
                continue
            # depth(child) = depth(parent) + 1, so the two representatives are this far apart.
            gap = height + 1 - depth
            top = tops[above]
            if weight[above] < weight[below]:
                above, below, gap = below, above, -gap
            self._head[below], self._shift[below] = above, gap
            weight[above] += weight[below]
            tops[above] = top
            if below in closing:
                closing[above] = closing.pop(below)
        self.up = np.array(up, np.int64)
        self.top, self.offset, self.circle = np.zeros(n, np.int64), np.zeros(n, np.int64), np.full(n, -1, np.int64)
        for k in range(n):
            head, shift = self._find(k)
            top = closing.get(head, tops[head])
            self.top[k], self.offset[k] = top, shift - self._find(top)[1]
            if head in closing:
                self.circle[k] = top

    def _find(self, k: int) -> tuple[int, int]:
        """(representative, offset to it); compresses the path."""
        head, shift = self._head, self._shift
        path = []
        while head[k] != k:
            path.append(k)
            k = head[k]
        total = 0
        for node in reversed(path):
            total += shift[node]
            head[node], shift[node] = k, total
        return k, total

    def on_circle(self) -> np.ndarray:
        """Whether each node lies on a circle of this stretch itself."""
        flags = np.zeros(len(self.up), bool)
        for closer in np.unique(self.circle[self.circle >= 0]):
            at = closer
            while not flags[at]:
                flags[at] = True
                at = self.up[at]
        return flags

    def reach(self) -> np.ndarray:
        """Number of different ancestors of each node in the stretch; a node on a circle is its own."""
        if not (self.circle >= 0).any():
            return self.offset
        flags, out = self.on_circle(), self.offset.copy()
        length = np.bincount(self.circle[flags], minlength=len(self.up)) if flags.any() else np.zeros(len(self.up), np.int64)
        ahead = np.zeros(len(self.up), np.int64)
        for k in np.argsort(self.offset, kind="stable"):
            if self.circle[k] >= 0:
                # The top lies on the circle; a node's parent has a lesser offset, but for the top's.
                ahead[k] = 0 if flags[k] else ahead[self.up[k]] + 1
                out[k] = ahead[k] + length[self.circle[k]]
        return out

    def pairs(self) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
        """(node, ancestor, distance), all pairs of one distance at a time."""
        reach = self.reach()
        at, nodes, distance = self.up, np.arange(len(self.up)), 1
        while True:
            kept = reach[nodes] >= distance
            nodes, at = nodes[kept], at[kept]
            if not len(nodes):
                return
            yield nodes, at, distance
            at, distance = self.up[at], distance + 1

    def below(self) -> np.ndarray:
        """Number of different descendants of each node in the stretch."""
        count = np.zeros(len(self.up), np.int64)
        order = np.argsort(-self.offset, kind="stable")
        flags = self.on_circle()
        for k in order:
            if self.up[k] >= 0 and not flags[k]:
                count[self.up[k]] += count[k] + 1
        if flags.any():
            members = np.bincount(self.circle[self.circle >= 0], minlength=len(self.up))
            count[flags] = members[self.circle[flags]]
        return count


def _by_group(step: Callable[[pd.DataFrame], Iterator[pd.DataFrame]]) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """Hand ``step`` the rows of each group in the stretch; a group's rows lie together, but not in one batch."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        for batch in batches:
            if not len(batch):
                continue
            keys = batch["part"].to_numpy()
            if held and held[-1]["part"].iloc[0] != keys[0]:
                yield from step(pd.concat(held, ignore_index=True))
                held = []
            cut = np.flatnonzero(keys != keys[-1])
            if len(cut):
                edge = int(cut[-1]) + 1
                yield from step(pd.concat([*held, batch.iloc[:edge]], ignore_index=True))
                held = []
                batch = batch.iloc[edge:]
            held.append(batch)
        if held:
            yield from step(pd.concat(held, ignore_index=True))

    return run


def _forest_of(frame: pd.DataFrame) -> Forest:
    parents = frame["parent_id"]
    return Forest(frame["id"].tolist(), [None if p != p or p is None else int(p) for p in parents.astype(object)])


def _stretches(links: DataFrame, parts: int | None, named: bool = False) -> DataFrame:
    """The links in stretches of neighbouring groups, written once: (part, id, parent_id)."""
    part = F.xxhash64("group").alias("part")
    slim = links.select(part, "id", *(["name"] if named else []), F.col("parent_id").cast("long").alias("parent_id"))
    return durable(durable(slim).repartitionByRange(parts or parallelism(links.sparkSession), "part", "id").sortWithinPartitions("part", "id"))


_PLACED = "id long, name string, parent_id long, top long, offset long, below long, path string, own_circle boolean, in_circle boolean"


def _place(named: bool) -> Callable[[pd.DataFrame], Iterator[pd.DataFrame]]:
    def step(frame: pd.DataFrame) -> Iterator[pd.DataFrame]:
        forest = _forest_of(frame)
        ids = frame["id"].to_numpy()
        circle = forest.circle >= 0
        paths: list[str | None] = [None] * len(ids)
        if named:
            # Parents come before their children in the order of offsets.
            names = frame["name"].fillna("").tolist()
            for k in np.argsort(forest.offset, kind="stable"):
                if not circle[k]:
                    paths[k] = names[k] if forest.offset[k] == 0 else f"{paths[forest.up[k]]}/{names[k]}"
        columns = {
            "id": ids, "name": frame["name"].to_numpy() if named else [None] * len(ids), "parent_id": frame["parent_id"].astype("Int64"), "top": ids[forest.top], "offset": forest.offset,
            "below": forest.below() if named else 0, "path": paths, "own_circle": forest.on_circle(), "in_circle": circle,
        }
        yield pd.DataFrame(columns)

    return step


def local_forests(links: DataFrame, parts: int | None = None, named: bool = False) -> DataFrame:
    """Each node's place in the tree of its stretch: ``_PLACED``; path and below are filled if ``named``."""
    return _stretches(links, parts, named).mapInPandas(_by_group(_place(named)), _PLACED)


def _hooks(forest: DataFrame) -> DataFrame:
    """(top, entry, next, hops) of the sets whose top has its parent, the entry, in another stretch; next is that set's top."""
    # The top of a local circle has its parent in its own set.
    tops = forest.where("offset = 0 AND parent_id IS NOT NULL AND NOT in_circle").select(F.col("id").alias("top"), F.col("parent_id").alias("entry"))
    inside = forest.select(F.col("id").alias("entry"), F.col("top").alias("next"), F.col("offset").alias("up"))
    return durable(tops.join(inside, "entry").select("top", "entry", "next", (F.col("up") + 1).alias("hops")))


def _merge(hooks: DataFrame) -> DataFrame:
    """(top, next, hops, moving) of each hooked set: the set of its root, or, if moving, one on a circle that crosses stretches."""
    total = hooks.count()
    jumps = hooks.select("top", "next", "hops")
    rounds = 0
    while total and (1 << rounds) <= total * 2:
        ahead = jumps.select(F.col("top").alias("next"), F.col("next").alias("next2"), F.col("hops").alias("hops2"))
        moved = jumps.join(ahead, "next", "left").select("top", F.coalesce("next2", "next").alias("next"), (F.col("hops") + F.coalesce("hops2", F.lit(0))).alias("hops"), F.col("next2").isNotNull().alias("moved"))
        moved = durable(moved)
        if not moved.where("moved").limit(1).count():
            break
        jumps = moved.drop("moved")
        rounds += 1
    heads = jumps.select(F.col("top").alias("next"), F.lit(True).alias("moving"))
    return durable(jumps.join(heads, "next", "left").select("top", "next", "hops", F.coalesce("moving", F.lit(False)).alias("moving")))


def _reach(hooks: DataFrame) -> DataFrame:
    """(top, entry, hops): the parents by which a top's path enters other sets, with the links up to them; on a circle once round.

    By doubling: the entries of the first 2^k sets, and of as many again from there. As many rows as the crossings of all paths.
    """
    jumps = hooks.select("top", "next", "hops")
    reached = hooks.select("top", "entry", F.lit(1).cast("long").alias("hops"))
    while True:
        ahead = reached.select(F.col("top").alias("next"), "entry", F.col("hops").alias("more"))
        further = jumps.join(ahead, "next").select("top", "entry", (F.col("hops") + F.col("more")).alias("hops"))
        before = reached.count()
        reached = durable(reached.unionByName(further).groupBy("top", "entry").agg(F.min("hops").alias("hops")))
        if reached.count() == before:
            return reached
        onward = jumps.select(F.col("top").alias("next"), F.col("next").alias("next2"), F.col("hops").alias("hops2"))
        jumps = durable(jumps.join(onward, "next").select("top", F.col("next2").alias("next"), (F.col("hops") + F.col("hops2")).alias("hops")))


def _entry_chains(forest: DataFrame, entries: DataFrame) -> DataFrame:
    """(entry, ancestor, step): each entry's ancestors in its own stretch, itself at step 0."""
    trees = forest.join(entries.withColumnRenamed("entry", "id"), "id", "left_semi").select("top").distinct()
    asked = entries.select(F.col("entry").alias("id"), F.lit(True).alias("asked"))
    rows = forest.join(trees, "top", "left_semi").join(asked, "id", "left").select("top", "id", "parent_id", F.coalesce("asked", F.lit(False)).alias("asked"))

    def walk(frame: pd.DataFrame) -> pd.DataFrame:
        ids = frame["id"].to_numpy()
        forest_here = _forest_of(frame)
        reach = forest_here.reach()
        nodes = np.flatnonzero(frame["asked"].to_numpy(bool))
        at, step, out = nodes, 0, []
        while len(nodes):
            out.append(pd.DataFrame({"entry": ids[nodes], "ancestor": ids[at], "step": step}))
            kept = reach[nodes] > step
            nodes, at = nodes[kept], forest_here.up[at[kept]]
            step += 1
        chains = pd.concat(out) if out else pd.DataFrame({"entry": ids[:0], "ancestor": ids[:0], "step": ids[:0]})
        # On a circle the walk comes back to the entry, which is its step 0.
        return chains.drop_duplicates(["entry", "ancestor"])

    # A tree lies within one stretch.
    return rows.groupBy("top").applyInPandas(walk, "entry long, ancestor long, step long")


_PAIRS = "id long, ancestor long, distance long"


def _local_pairs(frame: pd.DataFrame) -> Iterator[pd.DataFrame]:
    ids = frame["id"].to_numpy()
    held, size = [], 0
    for nodes, at, distance in _forest_of(frame).pairs():
        held.append(pd.DataFrame({"id": ids[nodes], "ancestor": ids[at], "distance": np.full(len(nodes), distance, np.int64)}))
        size += len(nodes)
        if size >= BATCH:
            yield pd.concat(held)
            held, size = [], 0
    if held:
        yield pd.concat(held)


def _crosses(stretches: DataFrame) -> bool:
    """Whether any link leads out of its stretch."""

    def outside(frame: pd.DataFrame) -> Iterator[pd.DataFrame]:
        wanted = frame["parent_id"].dropna().astype("int64")
        yield pd.DataFrame({"n": [int((~wanted.isin(frame["id"])).sum())]})

    return (stretches.mapInPandas(_by_group(outside), "n long").agg(F.sum("n").alias("n")).first().n or 0) > 0


def ancestor_pairs(links: DataFrame, parts: int | None = None) -> DataFrame:
    """(id, ancestor, distance) for every node and each of its ancestors; on a cycle each node is its own.

    links: (group, id, name, parent_id). distance is the least number of links. A parent that is not among
    the ids is no ancestor. The result has as many rows as the depths add up to. parts: number of stretches.
    """
    stretches = _stretches(links, parts)
    local = stretches.mapInPandas(_by_group(_local_pairs), _PAIRS)
    if not _crosses(stretches):
        return local
    forest = durable(stretches.mapInPandas(_by_group(_place(False)), _PLACED).select("id", "parent_id", "top", "offset", "in_circle"))
    reached = _reach(_hooks(forest))
    chains = _entry_chains(forest, reached.select("entry").distinct())
    beyond = reached.join(chains, "entry").groupBy("top", "ancestor").agg(F.min(F.col("hops") + F.col("step")).alias("beyond"))
    crossing = forest.select("id", "top", "offset").join(beyond, "top").select("id", "ancestor", (F.col("offset") + F.col("beyond")).alias("distance"))
    # A circle that crosses stretches leads a path back into its own set.
    return local.unionByName(crossing).groupBy("id", "ancestor").agg(F.min("distance").alias("distance"))


def roots(links: DataFrame, parts: int | None = None) -> DataFrame:
    """(id, root, depth, cyclic): root and depth are null, and cyclic is true, for nodes on a cycle or under one."""
    forest = durable(local_forests(links, parts))
    return _rooted(forest, _merge(_hooks(forest))).select("id", "root", "depth", "cyclic")


def _rooted(forest: DataFrame, jumps: DataFrame) -> DataFrame:
    ended = forest.where("offset = 0 AND in_circle").select(F.col("top").alias("next"), F.lit(True).alias("ends_in_circle"))
    far = jumps.join(ended, "next", "left").select("top", "next", "hops", (F.col("moving") | F.coalesce("ends_in_circle", F.lit(False))).alias("far_cycle"))
    cyclic = F.col("in_circle") | F.coalesce("far_cycle", F.lit(False))
    return (
        forest.join(far, "top", "left").withColumn("cyclic", cyclic)
        .withColumns({"root": F.when(~cyclic, F.coalesce("next", "top")), "depth": F.when(~cyclic, F.col("offset") + F.coalesce("hops", F.lit(0)))})
    )


def hierarchies(links: DataFrame, parts: int | None = None) -> DataFrame:
    """One row per node: (group, id, name, root, depth, path, n_descendants, cyclic).

    A node without a parent is a root of depth 0. ``path`` holds the names from the root to the node, joined by '/';
    nulls in names become ''. A node on a cycle, or under one, has a null root, depth and path. n_descendants
    counts the nodes that have it as an ancestor, on a cycle itself too.
    """
    forest = durable(local_forests(links, parts, named=True))
    hooks = _hooks(forest)
    rooted, reached = _rooted(forest, _merge(hooks)), _reach(hooks)
    local = forest.select("id", "path")
    above = (
        reached.join(local.withColumnRenamed("id", "entry"), "entry")
        .groupBy("top").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("hops")).alias("d"), F.col("path").alias("p")))), lambda e: e["p"]), "/").alias("above"))
    )
    chains = _entry_chains(forest, reached.select("entry").distinct())
    sizes = forest.groupBy("top").agg(F.count(F.lit(1)).alias("size"))
    # Each set is below an ancestor once, its own too where a circle leads back into it.
    far = reached.join(chains, "entry").select("top", F.col("ancestor").alias("id")).distinct().join(sizes, "top")
    own = forest.select("id", F.col("top").alias("own_top"))
    beyond = far.join(own, "id").groupBy("id").agg(F.sum("size").alias("beyond"), F.max(F.col("own_top") == F.col("top")).alias("round"))
    group = links.select("id", "group")
    n_below = F.coalesce("beyond", F.lit(0)) + F.when(F.coalesce("round", F.lit(False)), F.lit(0)).otherwise(F.col("below"))
    return (
        rooted.join(above, "top", "left").join(beyond, "id", "left").join(group, "id")
        .select(
            "group", "id", "name", "root", "depth", F.when(~F.col("cyclic"), F.concat_ws("/", "above", "path")).alias("path"), n_below.alias("n_descendants"), "cyclic",
        )
    )


def circles(links: DataFrame, parts: int | None = None) -> DataFrame:
    """(group, id, parent_id, circle, length) of every link that is part of a circle; circle is its least id.

    Nodes that only lead into a circle are left out. Only nodes on circles are paired.
    """
    links = durable(links.select("group", "id", "name", "parent_id"))
    forest = durable(local_forests(links, parts))
    hooks = _hooks(forest)
    # After that many steps every moving set has come to a circle, and each set of a circle is reached from its circle.
    crossing = _merge(hooks).where("moving").select(F.col("next").alias("top")).distinct()
    # Of a set on a circle, the nodes from the entry up to the top lie on it.
    round_entries = hooks.join(crossing, "top", "left_semi").select("entry").distinct()
    far = _entry_chains(forest, round_entries).select(F.col("ancestor").alias("id"))
    on = forest.where("own_circle").select("id").unionByName(far).distinct()
    kept = durable(links.join(on, "id", "left_semi").select("group", "id", "name", "parent_id"))
    # A node on a circle has exactly the circle's nodes as its ancestors, and is its own after one turn.
    turn = F.max(F.when(F.col("id") == F.col("ancestor"), F.col("distance")))
    around = ancestor_pairs(kept, parts).groupBy("id").agg(F.min("ancestor").alias("circle"), turn.alias("length"))
    return kept.join(around, "id").select("group", "id", "parent_id", "circle", "length")


def cycles(hierarchy: DataFrame, pairs: DataFrame) -> DataFrame:
    """(group, id) of the nodes that lie on a cycle themselves."""
    own = pairs.where("id = ancestor").select("id").distinct()
    return hierarchy.select("group", "id").join(own, "id", "left_semi")
