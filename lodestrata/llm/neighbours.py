"""Most similar vectors for every vector (problem 7).

Method: randomly rotated one-bit codes. Vectors are put into the lists of coarse centroids; of each the rotated
residual is kept as a packed sign code with two correction scalars. For a query, inner products are estimated from the
packed bits, with a bound on the error; only vectors whose upper bound reaches the k-th best lower bound are
compared exactly.

The centroids are fitted on at most ``SAMPLE`` vectors. Every vector is indexed and every vector is a query. The number of
lists follows the root of the number of vectors without a limit: beyond a quarter of the sample, each coarse centroid is
refined by the same fine centroids of residuals. Neighbouring lists form a cell, which is what a task searches: a member is sent to
one cell and a query once to each cell of which it visits lists, so a vector travels a few times, not once per list. Cells
of more than ``MEMBERS`` vectors are searched in parts, and the queries of a part in blocks, so a task's share has
a fixed bound, however many vectors lie together.

Within kinds, each kind has lists of its own; a kind of at most ``EXACT`` vectors is one list that is compared exactly.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestrata.session import durable

SAMPLE = 20_000
#: Members that a cell holds on average, and most members and queries of one task.
CELL = 2_048
MEMBERS = 8_192
QUERIES = 32_768
#: Within kinds, a kind of no more vectors is searched exactly.
EXACT = 4_096
#: Half-width of the error interval in standard deviations.
EPSILON = 2.5
#: Bits of a quantised query component.
QUERY_BITS = 4
_BLOCK = 256


def usable(vectors: DataFrame, dim: int) -> DataFrame:
    """(id, kind, unit binary): one row per id with ``dim`` finite components that are not all zero, scaled to length 1.

    Rows with a null id are left out. Of rows that share an id, the one that is least by (embedding, kind) counts.
    """
    e = F.col("embedding").cast("array<double>")
    finite = F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    good = vectors.where(F.col("id").isNotNull() & (F.size("embedding") == dim)).where(finite).where(F.exists(e, lambda x: x != 0))
    one = good.groupBy("id").agg(F.min(F.struct(F.col("embedding").cast("array<float>").alias("e"), F.col("kind").alias("kind"))).alias("v"))

    def scale(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                m = np.stack(b["e"].to_numpy()).astype(np.float64)
                m /= np.abs(m).max(axis=1, keepdims=True)
                m /= np.linalg.norm(m, axis=1, keepdims=True)
                yield pd.DataFrame({"id": b["id"], "kind": b["kind"], "unit": [r.tobytes() for r in m.astype(np.float32)]})

    return one.select("id", "v.e", "v.kind").mapInPandas(scale, "id string, kind string, unit binary")


def _matrix(column: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(column), np.float32).reshape(len(column), -1)


def fit_centroids(sample: np.ndarray, count: int, rounds: int = 8, seed: int = 7, unit: bool = True) -> np.ndarray:
    """Centroids by k-means, spherical if they are to be of unit length."""
    rng = np.random.default_rng(seed)
    count = max(1, min(count, len(sample)))
    centres = sample[rng.choice(len(sample), count, replace=False)].copy()
    for _ in range(rounds):
        own = np.argmax(sample @ centres.T - (0 if unit else 0.5 * (centres**2).sum(axis=1)), axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, sample)
        if not unit:
            counts = np.bincount(own, minlength=count)[:, None]
            centres = np.where(counts > 0, sums / np.maximum(counts, 1), centres).astype(np.float32)
            continue
        norms = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(norms > 1e-6, sums / np.maximum(norms, 1e-6), centres).astype(np.float32)
    return centres


def rotation(dim: int, seed: int = 11) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dim, dim)))
    return (q * np.sign(np.diag(r))).astype(np.float32)


class Codes:
    """Packed sign codes of the rotated residuals of one list's members, with their correction scalars."""

    def __init__(self, units: np.ndarray, centre: np.ndarray, turn: np.ndarray):
        self.dim = units.shape[1]
        residual = (units - centre) @ turn
        self.norm = np.linalg.norm(residual, axis=1)
        o = residual / np.maximum(self.norm, 1e-12)[:, None]
        self.bits = pack_bits(o > 0)
        self.ones = np.bitwise_count(self.bits).sum(axis=1).astype(np.float32)
        #: <code, residual direction>: 0.8 on average, corrects the estimate and gives its error.
        self.align = np.maximum(np.abs(o).sum(axis=1) / math.sqrt(self.dim), 1e-6).astype(np.float32)
        spread = np.sqrt(np.maximum(1 - self.align**2, 0)) / self.align
        self.error = (EPSILON * spread / math.sqrt(max(self.dim - 1, 1))).astype(np.float32)

    def estimate(self, queries: np.ndarray, centre: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Estimated inner products (queries x members) of the unit vectors and the half-width of their bounds.

        With x the member and q the query: q.x = q.c + |x - c| <q', o>, where q' is the rotated query.
        """
        rotated = queries @ turn
        low = rotated.min(axis=1, keepdims=True)
        step = np.maximum((rotated.max(axis=1, keepdims=True) - low) / (2**QUERY_BITS - 1), 1e-9)
        level = np.rint((rotated - low) / step).astype(np.uint8)
        weighted = np.zeros((len(queries), len(self.bits)), np.float32)
        for plane in range(QUERY_BITS):
            q_bits = pack_bits((level >> plane) & 1)
            hits = np.zeros(weighted.shape, np.float32)
            for word in range(self.bits.shape[1]):
                hits += np.bitwise_count(q_bits[:, word, None] & self.bits[None, :, word])
            weighted += hits * float(1 << plane)
        # sum of q over the set bits = low * ones + step * weighted; the code is (2 bit - 1) / sqrt(dim)
        over_set = low * self.ones[None, :] + step * weighted
        total = (low[:, 0] * self.dim + step[:, 0] * level.sum(axis=1))[:, None]
        inner = (2 * over_set - total) / math.sqrt(self.dim) / self.align[None, :]
        base = queries @ centre
        # |q'| = 1, so the bound of <q', o> is the member's error, plus what the query's rounding can add.
        rounding = step / math.sqrt(12) * EPSILON
        return base[:, None] + self.norm * inner, self.norm * (self.error[None, :] + rounding)


def pack_bits(flags: np.ndarray) -> np.ndarray:
    packed = np.packbits(flags.astype(bool), axis=1)
    pad = -packed.shape[1] % 8
    return np.ascontiguousarray(np.pad(packed, ((0, 0), (0, pad)))).view(np.uint64)


def survivors(queries: np.ndarray, codes: Codes, centre: np.ndarray, turn: np.ndarray, k: int, least: float) -> np.ndarray:
    """Mask (queries x members) of the candidates that the bounds leave."""
    estimate, half = codes.estimate(queries, centre, turn)
    # One more than k, since the query itself may be among the members.
    if estimate.shape[1] > k + 1:
        floor = np.partition(estimate - half, -(k + 1), axis=1)[:, -(k + 1)][:, None]
    else:
        floor = np.full((len(queries), 1), -np.inf, np.float32)
    return estimate + half >= np.maximum(floor, least)


def compare_block(queries: np.ndarray, members: np.ndarray, k: int, least: float, kept: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, member, similarity) of the pairs in the mask ``kept`` that can be among a query's best k here; without a mask of all.

    Most members of a short list survive the bounds, and one product is cheaper than so many pairs one by one; the pairs
    that come out are compared in double precision.
    """
    sims = queries @ members.T
    if kept is not None:
        sims[~kept] = -np.inf
    if sims.shape[1] > k + 1:
        # The rounding of single precision is far below 1e-5.
        floor = np.partition(sims, -(k + 1), axis=1)[:, -(k + 1)][:, None] - 1e-5
    else:
        floor = np.full((len(queries), 1), -np.inf, np.float32)
    q, m = np.nonzero((sims >= np.maximum(floor, least - 1e-5)) & np.isfinite(sims))
    exact = np.einsum("ij,ij->i", queries[q].astype(np.float64), members[m].astype(np.float64))
    return q, m, exact


#: List and cell of the kinds that are compared exactly.
_WHOLE = -1
#: Rows that are compared with the centroids at a time.
_ROWS = 1_024


class Lists:
    """The lists of one kind: coarse centroids, fine centroids of the residuals that all of them share, and the lists' cells.

    List ``c * len(fine) + f`` has the centre coarse[c] + fine[f].
    """

    def __init__(self, first_cell: int, sample: np.ndarray, total: int, lists: int, most: int):
        self.coarse = fit_centroids(sample, min(lists, most))
        fine = math.ceil(lists / len(self.coarse))
        if fine > 1:
            residual = sample - self.coarse[np.argmax(sample @ self.coarse.T, axis=1)]
            self.fine = fit_centroids(residual, fine, unit=False)
        else:
            self.fine = np.zeros((1, sample.shape[1]), np.float32)
        n_fine = len(self.fine)
        cells = max(1, total // CELL)
        groups = fit_centroids(self.coarse, min(cells, len(self.coarse)))
        of_coarse = np.argmax(self.coarse @ groups.T, axis=1)
        # More cells than coarse centroids: the fine ones are shared out among them.
        share = min(n_fine, math.ceil(cells / len(self.coarse)))
        lists_of = np.arange(len(self.coarse) * n_fine)
        self.cells = (first_cell + of_coarse[lists_of // n_fine] * share + (lists_of % n_fine) % share).astype(np.int32)
        self.last_cell = first_cell + len(groups) * share
        self.sizes = np.zeros(len(lists_of), np.int64)
        #: Half the squared length of every centre, as (coarse, fine).
        self.half = 0.5 * ((self.coarse**2).sum(axis=1)[:, None] + 2 * self.coarse @ self.fine.T + (self.fine**2).sum(axis=1)[None, :])

    def __len__(self) -> int:
        return len(self.cells)

    def centre(self, number: int) -> np.ndarray:
        c, f = divmod(number, len(self.fine))
        return self.coarse[c] + self.fine[f]

    def nearest(self, units: np.ndarray, count: int) -> np.ndarray:
        """(rows x count) numbers of the lists with the nearest centres, the nearest first."""
        count = min(count, len(self))
        out = np.empty((len(units), count), np.int64)
        keep = min(len(self.coarse), max(count, 32))
        for at in range(0, len(units), _ROWS):
            some = units[at : at + _ROWS]
            by_coarse = some @ self.coarse.T
            if len(self.fine) == 1:
                score, numbers = by_coarse - self.half[:, 0], None
            else:
                best = np.argpartition(self.half.min(axis=1) - by_coarse, keep - 1, axis=1)[:, :keep]
                score = (np.take_along_axis(by_coarse, best, axis=1)[:, :, None] + (some @ self.fine.T)[:, None, :] - self.half[best]).reshape(len(some), -1)
                numbers = (best[:, :, None] * len(self.fine) + np.arange(len(self.fine))).reshape(len(some), -1)
            top = np.argpartition(-score, count - 1, axis=1)[:, :count]
            top = np.take_along_axis(top, np.argsort(-np.take_along_axis(score, top, axis=1), axis=1, kind="stable"), axis=1)
            out[at : at + _ROWS] = top if numbers is None else np.take_along_axis(numbers, top, axis=1)
        return out

    def visited(self, units: np.ndarray, probes: int, enough: int) -> tuple[np.ndarray, np.ndarray]:
        """(row, list) of every list that a row visits: the nearest ``probes``, and more until they hold ``enough`` vectors."""
        top = self.nearest(units, probes)
        rows, lists = [np.repeat(np.arange(len(units)), top.shape[1])], [top.ravel()]
        short, count = np.flatnonzero(self.sizes[top].sum(axis=1) < enough), top.shape[1]
        while len(short) and count < len(self):
            more = self.nearest(units[short], 2 * count)
            rows.append(np.repeat(short, more.shape[1] - count))
            lists.append(more[:, count:].ravel())
            short, count = short[self.sizes[more].sum(axis=1) < enough], more.shape[1]
        return np.concatenate(rows), np.concatenate(lists)


def fit_lists(units: DataFrame, exact: int, most: int) -> dict[str, Lists]:
    """The lists of every kind of more than ``exact`` vectors, fitted on at most SAMPLE vectors, with their sizes.

    The driver gets the sample and one count per kind and list.
    """
    large = units.groupBy("own_kind").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > exact).orderBy("own_kind").collect()
    wanted = {r.own_kind: max(1, int(2 * math.sqrt(r.n))) for r in large}
    sum_wanted = sum(wanted.values())
    quota = {r.own_kind: max(4, SAMPLE * wanted[r.own_kind] // sum_wanted) for r in large}
    if not large:
        return {}
    chances = units.sparkSession.createDataFrame([(r.own_kind, min(1.0, 1.2 * quota[r.own_kind] / r.n)) for r in large], "own_kind string, chance double")
    drawn = F.pmod(F.xxhash64("id"), F.lit(1_000_000)) < F.col("chance") * 1_000_000
    sample = units.join(F.broadcast(chances), "own_kind").where(drawn).select("own_kind", "unit").limit(2 * SAMPLE).toPandas()
    out: dict[str, Lists] = {}
    cell = 0
    for r in large:
        some = sample.loc[sample["own_kind"] == r.own_kind, "unit"].iloc[: quota[r.own_kind]]
        if len(some):
            out[r.own_kind] = Lists(cell, _matrix(some), r.n, wanted[r.own_kind], max(1, most * wanted[r.own_kind] // sum_wanted))
            cell = out[r.own_kind].last_cell
    return out


_PLACED = "id string, own_kind string, unit binary, list int"


def nearest(
    vectors: DataFrame, k: int = 10, dim: int = 64, least: float = -2.0, probes: int = 24, within_kind: bool = False, members: int = MEMBERS, block: int = QUERIES, exact: int = EXACT, coarse: int = SAMPLE // 4
) -> DataFrame:
    """The k most similar other vectors of every usable vector: (id, neighbour, similarity, rank).

    vectors: (id string, kind string, embedding array<float>). Similarity is the cosine, ties go to the lesser id.
    Pairs below ``least`` are left out. within_kind: only neighbours of the same kind (null equals null). Vectors
    that are not usable are neither queries nor neighbours; repeated ids count once. Fewer than k others give
    fewer rows; no usable vectors give an empty result. Approximate: a query visits the ``probes`` lists
    with the nearest centroids, and further ones until they hold k others, so every query with k others gets k rows; where
    the lists are no more than that, it sees all vectors. within_kind: kinds of at most ``exact`` vectors are searched
    exactly. coarse: most coarse centroids, of all kinds together.
    """
    spark = vectors.sparkSession
    units = usable(vectors.select("id", "kind", "embedding"), dim)
    # Null is a kind of its own, apart from the empty name.
    own_kind = F.coalesce(F.concat(F.lit("="), "kind"), F.lit("")) if within_kind else F.lit("")
    units = durable(units.select("id", own_kind.alias("own_kind"), "unit"))
    turn = rotation(dim)
    index = fit_lists(units, exact if within_kind else 0, coarse)
    shared = spark.sparkContext.broadcast((index, turn))

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for kind, rows in b.groupby("own_kind"):
                lists = shared.value[0].get(kind)
                own = np.full(len(rows), _WHOLE, np.int32) if lists is None else lists.nearest(_matrix(rows["unit"]), 1)[:, 0].astype(np.int32)
                yield rows.assign(list=own)[["id", "own_kind", "unit", "list"]]

    placed = durable(units.mapInPandas(place, _PLACED))
    # One row per list.
    for r in placed.groupBy("own_kind", "list").agg(F.count(F.lit(1)).alias("n")).collect():
        if r.own_kind in index:
            index[r.own_kind].sizes[r.list] = r.n
    ready = spark.sparkContext.broadcast((index, turn))

    def visits(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[pd.DataFrame, str, np.ndarray, np.ndarray, np.ndarray, list[np.ndarray]]]:
        """(rows, kind, cell of each row, then of every cell that a row visits: row, cell, lists in it)."""
        for b in batches:
            for kind, rows in b.groupby("own_kind"):
                lists = ready.value[0].get(kind)
                if lists is None:
                    cell = np.full(len(rows), _WHOLE)
                    yield rows, kind, cell, np.arange(len(rows)), cell, [np.array([_WHOLE], np.int32)] * len(rows)
                    continue
                # One more than k, since the query itself is among the members.
                row, number = lists.visited(_matrix(rows["unit"]), probes, k + 1)
                cell = lists.cells[number]
                order = np.lexsort((number, cell, row))
                row, cell, number = row[order], cell[order], number[order].astype(np.int32)
                first = np.r_[0, np.flatnonzero((np.diff(row) != 0) | (np.diff(cell) != 0)) + 1]
                yield rows, kind, lists.cells[rows["list"].to_numpy()], row[first], cell[first], np.split(number, first[1:])

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for _, kind, own, _, cell, _ in visits(batches):
            n = pd.DataFrame({"cell": np.r_[own, cell], "n": np.r_[np.ones(len(own), int), np.zeros(len(cell), int)], "v": np.r_[np.zeros(len(own), int), np.ones(len(cell), int)]})
            yield n.groupby("cell", as_index=False).sum().assign(own_kind=kind)[["own_kind", "cell", "n", "v"]]

    # One row per cell: into how many parts and blocks it is cut.
    sizes = placed.mapInPandas(count, "own_kind string, cell int, n long, v long").groupBy("own_kind", "cell").agg(F.sum("n").alias("n"), F.sum("v").alias("v")).where("n > 0 AND v > 0").collect()
    plan = spark.sparkContext.broadcast({(r.own_kind, r.cell): (math.ceil(r.n / members), math.ceil(r.v / block)) for r in sizes})

    def share(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows, kind, own, row, cell, numbers in visits(batches):
            ids, vectors = rows["id"].to_numpy(object), rows["unit"].to_numpy(object)
            spot = pd.util.hash_array(ids)
            cuts = lambda cells: np.array([plan.value.get((kind, int(c)), (0, 0)) for c in cells], np.int64).reshape(-1, 2)
            own_cuts, cuts_of = cuts(own), cuts(cell)
            # A member goes to its part of every block, a query to its block of every part; empty cells drop out.
            for is_member, at, cells, (fixed, spread), seen in ((True, np.arange(len(ids)), own, own_cuts.T, None), (False, row, cell, cuts_of.T[::-1], numbers)):
                times = np.where(fixed > 0, spread, 0)
                which = np.repeat(np.arange(len(at)), times)
                turnwise = np.arange(len(which)) - np.repeat(np.cumsum(times) - times, times)
                mine = (spot[at[which]] >> np.uint64(0 if is_member else 20)).astype(np.uint64) % np.maximum(fixed[which], 1).astype(np.uint64)
                part, blk = (mine, turnwise) if is_member else (turnwise, mine)
                own_lists = rows["list"].to_numpy().astype(np.int32)
                held = [own_lists[w : w + 1] for w in which] if seen is None else [seen[w] for w in which]
                yield pd.DataFrame({"id": ids[at[which]], "own_kind": kind, "unit": vectors[at[which]], "cell": cells[which].astype(np.int32), "lists": held, "member": is_member, "part": part.astype(np.int64), "block": blk.astype(np.int64)})

    shares = placed.mapInPandas(share, "id string, own_kind string, unit binary, cell int, lists array<int>, member boolean, part long, block long")

    def search(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        index, t = ready.value
        lists = index.get(key[0])
        is_member = frame["member"].to_numpy(bool)
        mem, qry = frame[is_member], frame[~is_member]
        best = _Best(k, mem["id"].to_numpy(object), qry["id"].to_numpy(object))
        if len(mem) and len(qry):
            m_units, q_units = _matrix(mem["unit"]), _matrix(qry["unit"])
            m_list = np.array([x[0] for x in mem["lists"]])
            visits = np.concatenate(qry["lists"].to_numpy())
            visitor = np.repeat(np.arange(len(qry)), [len(x) for x in qry["lists"]])
            by_list = np.argsort(visits, kind="stable")
            visits, visitor = visits[by_list], visitor[by_list]
            for number in np.unique(m_list):
                here = np.flatnonzero(m_list == number)
                asking = visitor[np.searchsorted(visits, number) : np.searchsorted(visits, number, side="right")]
                codes = None if number == _WHOLE else Codes(m_units[here], lists.centre(int(number)), t)
                for at in range(0, len(asking), _BLOCK):
                    some = asking[at : at + _BLOCK]
                    kept = None if codes is None else survivors(q_units[some], codes, lists.centre(int(number)), t, k, least - 1e-6)
                    q, m, sim = compare_block(q_units[some], m_units[here], k, least, kept)
                    best.add(some[q], here[m], sim, sim >= least)
        return best.frame()

    found = shares.groupBy("own_kind", "cell", "part", "block").applyInPandas(search, "id string, neighbour string, similarity double")
    by_rank = Window.partitionBy("id").orderBy(F.col("similarity").desc(), "neighbour")
    return found.withColumn("rank", F.row_number().over(by_rank)).where(F.col("rank") <= k)


class _Best:
    """The k best members of every query of a task, ties to the lesser id; what cannot be among them is let go now and then."""

    def __init__(self, k: int, members: np.ndarray, queries: np.ndarray):
        self.k, self.members, self.queries = k, members, queries
        # Ranks of the ids sort faster than the ids.
        self.order = np.argsort(np.argsort(members.astype(str), kind="stable")) if len(members) else np.zeros(0, int)
        self.held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.size, self.room = 0, max(4 * k * len(queries), 1 << 20)

    def add(self, q: np.ndarray, m: np.ndarray, sim: np.ndarray, fits: np.ndarray) -> None:
        keep = fits & (self.queries[q] != self.members[m])
        self.held.append((q[keep], m[keep], sim[keep]))
        self.size += int(keep.sum())
        if self.size > self.room:
            self._shrink()

    def _shrink(self) -> None:
        q, m, sim = (np.concatenate(x) for x in zip(*self.held)) if self.held else (np.zeros(0, int), np.zeros(0, int), np.zeros(0))
        order = np.lexsort((self.order[m], -sim, q))
        q, m, sim = q[order], m[order], sim[order]
        first = np.r_[0, np.flatnonzero(np.diff(q)) + 1] if len(q) else np.zeros(0, int)
        place = np.arange(len(q)) - np.repeat(first, np.diff(np.r_[first, len(q)]))
        top = place < self.k
        self.held, self.size = [(q[top], m[top], sim[top])], int(top.sum())

    def frame(self) -> pd.DataFrame:
        self._shrink()
        q, m, sim = self.held[0]
        return pd.DataFrame({"id": self.queries[q], "neighbour": self.members[m], "similarity": sim.astype(np.float64)})


def similar_pairs(vectors: DataFrame, least: float = 0.9, k: int = 10, dim: int = 64, **options) -> DataFrame:
    """(id_a, id_b), id_a < id_b: pairs of similarity of at least ``least`` of which one is among the k nearest of the other."""
    near = nearest(vectors, k, dim, least=least, **options)
    return near.select(F.least("id", "neighbour").alias("id_a"), F.greatest("id", "neighbour").alias("id_b")).distinct()
