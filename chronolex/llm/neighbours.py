"""The k most similar vectors for every vector of a space (problem 1).

Method: low-dimensional stable projections indexed by a kd-tree.  Vectors are set to
unit length and projected by Gaussian (2-stable) directions to ``m`` numbers, so the
squared projected distance of two vectors over their squared distance follows a
chi-square law with m degrees of freedom.  A kd-tree over the projected points cuts a
space into cells and cells into leaves; every row is indexed.  A query visits the
leaves in which a neighbour lies, by the normal law of its projected difference, but
for a quarter of ``1 - confidence``, and verifies their points on the full vectors; it
stops when the chi-square test says that what lies farther off in the projection holds
a better neighbour with a probability below the rest of ``1 - confidence``.

Layout: the top of the tree is fitted on a bounded sample, ``SAMPLE_A_CELL`` rows for
each cell that a space needs, ``SAMPLE_TOTAL`` for all spaces together; a space of one
cell needs none.  A row's cell follows from the tree alone.  A cell is one task of one
shuffle and is written as rows of leaves to the shared folder; the search reads its
query leaves from that table and fetches the cells it needs from the same files, so
vectors are shuffled once and no pair of all vectors is formed.  What is broadcast is
the trees and the directory of cells, which have at most ``SAMPLE_TOTAL / 16`` cells of
more than one a space; beyond ``SAMPLE_TOTAL / SAMPLE_A_CELL`` cells these hold more
points each.  A cell's queries look only at the cells whose boxes their own box can reach.

Exact copies share one entry that carries the k+1 smallest keys; that many decide every
top-k list, and the remaining copies take theirs from the entry by a join.  A group of
copies of any size is thus one point of one cell.

Defined results: rows whose vector is null, of another length, all zero or not finite
appear on neither side; a null space is a space of its own; a space with fewer than
k+1 rows gives fewer neighbours; similarity is the cosine in double precision, rounded
to 9 decimals, ties go to the smaller key.
"""

from __future__ import annotations

import hashlib
import math
from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronolex.runtime import shared_dir

#: Rows on which the tops of the trees are fitted: for each cell, and for all spaces together.
SAMPLE_A_CELL = 64
SAMPLE_TOTAL = 1_000_000
#: Points wanted in a cell and, at most, in a leaf.
CELL_POINTS = 4096
LEAF_POINTS = 512
#: Spaces whose names the driver may hold; more is an error.
MOST_SPACES = 100_000
#: Cells that a worker holds, and whose queries a task answers where there are many.
_CELLS_HELD = 48
CELLS_A_TASK = 16
#: The first ring reaches as far as if the k-th best were at this squared distance, and
#: rings grow at most by this factor.  They order the work and leave the result as it is.
FIRST_RADIUS = 0.08
RADIUS_GROWTH = 3.0
#: Leaves of a smaller chance are looked for only where larger ones do not add up.
LEAST_CHANCE = 2e-4
#: From this squared distance on, chances are spread over all leaves and radius alone decides.
FAR_AWAY = 1.0


def chi_square_quantile(p: float, m: int) -> float:
    """x with P(chi-square of m degrees <= x) = p, by bisection on the incomplete gamma series."""

    def below(x: float) -> float:
        a, y = m / 2, x / 2
        term = total = 1.0
        for i in range(1, 1000):
            term *= y / (a + i)
            total += term
            if term < total * 1e-12:
                break
        return math.exp(a * math.log(y) - y - math.lgamma(a + 1)) * total

    lo, hi = 1e-9, m + 20 * math.sqrt(2 * m) + 60
    for _ in range(100):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if below(mid) < p else (lo, mid)
    return hi


def projected_dimensions(rows: int) -> int:
    """An axis for each binary cut down to the leaves and two: no axis is then cut twice, and the ball that a query verifies stays small."""
    return max(6, min(16, round(math.log2(max(2, rows / LEAF_POINTS))) + 2))


def directions(dim: int, m: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).standard_normal((dim, m)).astype(np.float32)


def grow(points: np.ndarray, parts: int) -> list[tuple]:
    """A kd-tree with ``parts`` leaves as nodes (axis, threshold, left, right); leaves are (-1, number).

    Splits the widest axis so that both sides get points in proportion to their leaves.
    """
    nodes: list[tuple] = []
    leaf = 0
    todo = [(0, np.arange(len(points)), parts)]
    nodes.append(())
    while todo:
        at, rows, n = todo.pop()
        spread = points[rows].std(axis=0) if len(rows) > 1 else np.zeros(points.shape[1])
        axis = int(np.argmax(spread))
        if n < 2 or spread[axis] <= 0:
            nodes[at] = (-1, 0.0, leaf, 0)
            leaf += 1
            continue
        values = points[rows, axis]
        cut = float(np.partition(values, (k := max(1, min(len(rows) - 1, len(rows) * (n // 2) // n))))[k])
        low = values < cut
        if low.all() or not low.any():
            cut = float(np.nextafter(np.float32(values.min()), np.float32(np.inf)))
            low = values < cut
        a, b = len(nodes), len(nodes) + 1
        nodes += [(), ()]
        nodes[at] = (axis, cut, a, b)
        todo += [(b, rows[~low], n - n // 2), (a, rows[low], n // 2)]
    return nodes


def descend(nodes: list[tuple], points: np.ndarray) -> np.ndarray:
    """The leaf number of every point."""
    out = np.empty(len(points), np.int32)
    todo = [(0, np.arange(len(points)))]
    while todo:
        at, rows = todo.pop()
        axis, cut, a, b = nodes[at]
        if axis < 0:
            out[rows] = a
        elif len(rows):
            low = points[rows, axis] < cut
            todo += [(a, rows[low]), (b, rows[~low])]
    return out


_STEPS = 1024
_NORMAL = np.array([0.5 * math.erfc(-i / _STEPS / math.sqrt(2)) for i in range(-8 * _STEPS, 8 * _STEPS + 1)], np.float32)


def normal_cdf(z: np.ndarray) -> np.ndarray:
    """P(standard normal <= z), from a table."""
    return _NORMAL[np.clip(z * np.float32(_STEPS) + np.float32(8 * _STEPS + 0.5), 0, 16 * _STEPS).astype(np.int32)]


def graft(top: list[tuple], below: dict[int, tuple[int, list[tuple]]]) -> list[tuple]:
    """The tree ``top`` with each leaf replaced by the tree of its cell; leaves are numbered from the number given with that tree."""
    nodes = list(top)
    for at, (axis, _, cell, _) in enumerate(top):
        if axis < 0 and cell in below:
            first, tree = below[cell]
            base = len(nodes) - 1  # the root takes the leaf's place
            moved = [(-1, 0.0, int(a) + first, 0) if x < 0 else (int(x), cut, int(a) + base, int(b) + base) for x, cut, a, b in tree]
            nodes[at] = moved[0]
            nodes += moved[1:]
        elif axis < 0:
            nodes[at] = (-1, 0.0, -1, 0)  # no row lies there
    return nodes


def chances(nodes: list[tuple], points: np.ndarray, inverse: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Points, leaves, and the chances of at least ``least`` that a neighbour of the point lies in the leaf.

    A neighbour is off by a normal deviation, of standard deviation 1 / ``inverse``, on each axis.
    """
    points, inverse = np.ascontiguousarray(points.T), inverse.astype(np.float32)
    out = []
    todo: list[tuple] = [(0, np.arange(len(inverse)), np.ones(len(inverse), np.float32), {})]
    while todo:
        at, rows, p, bounds = todo.pop()
        axis, cut, a, b = nodes[at]
        if axis < 0:
            out.append((rows, np.full(len(rows), a, np.int32), p))
            continue
        x, i = points[axis][rows], inverse[rows]
        low = normal_cdf((np.float32(cut) - x) * i)
        lo, hi = bounds.get(axis, (None, None))
        if lo is not None or hi is not None:
            under = 0 if lo is None else normal_cdf((np.float32(lo) - x) * i)
            within = (1 if hi is None else normal_cdf((np.float32(hi) - x) * i)) - under
            low = np.clip((low - under) / np.maximum(within, np.float32(1e-9)), 0, 1)
        low = low * p
        high = p - low
        for child, share, edge in ((b, high, (cut, hi)), (a, low, (lo, cut))):
            keep = np.flatnonzero(share >= least)
            if len(keep):
                todo.append((child, rows[keep], share[keep], bounds | {axis: edge}))
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, np.float32)
    return tuple(np.concatenate(x) for x in zip(*out))


def likely_leaves(nodes: list[tuple], leaves: int, points: np.ndarray, inverse: np.ndarray, miss: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of points and leaves: of each point the fewest leaves that hold a neighbour with a chance of 1 - ``miss``."""
    found: list[tuple] = []
    todo, least = np.arange(len(points)), LEAST_CHANCE
    while len(todo):
        q, leaf, p = chances(nodes, points[todo], inverse[todo], least)
        enough = np.bincount(q, p, len(todo)) >= 1 - miss
        if least * leaves <= miss / 4:  # what is left out adds up to less
            enough[:] = True
        order = np.argsort(q - p.astype(np.float64))  # by point, the likeliest first
        q, leaf, p = q[order], leaf[order], p[order].astype(np.float64)
        before = np.cumsum(p) - p
        each = np.bincount(q, minlength=len(todo))
        before -= np.repeat(before[(np.cumsum(each) - each)[each > 0]], each[each > 0])
        take = (before < 1 - miss) & enough[q] & (leaf >= 0)
        found.append((todo[q[take]], leaf[take]))
        todo, least = todo[~enough], least / 16
    return tuple(np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, np.int64), np.zeros(0, np.int32))


def box_distance(points: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Squared distance of every point to every box."""
    out = np.zeros((len(points), len(lo)), np.float32)
    for d in range(points.shape[1]):
        x = points[:, d, None]
        gap = np.maximum(np.maximum(lo[None, :, d] - x, x - hi[None, :, d]), 0)
        out += gap * gap
    return out


def _unit(raw: np.ndarray) -> np.ndarray:
    return (raw / np.sqrt((raw.astype(np.float64) ** 2).sum(axis=1))[:, None]).astype(np.float32)


def _usable(column: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers and vectors of the usable rows of an array column."""
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    size = lists.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False)
    at = np.flatnonzero(size == dim)
    if not len(at):
        return at, np.zeros((0, dim), np.float32)
    flat = lists.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).astype(np.float32).reshape(-1, dim)
    good = np.isfinite(flat).all(axis=1) & (flat != 0).any(axis=1)
    return at[good], np.ascontiguousarray(flat[good])


def _group_copies(raw: np.ndarray, keys: list[np.ndarray], counts: np.ndarray, k1: int):
    """Distinct vectors with their k1 smallest keys and numbers of copies."""
    whole = np.ascontiguousarray(raw).view(np.dtype((np.void, raw.shape[1] * 4))).ravel()
    first, group = np.unique(whole, return_index=True, return_inverse=True)[1:]
    if len(first) == len(raw):
        return raw, keys, counts
    merged: list[list] = [[] for _ in first]
    for g, k in zip(group, keys):
        merged[g].append(k)
    total = np.zeros(len(first), np.int64)
    np.add.at(total, group, counts)
    return raw[first], [np.sort(np.concatenate(x))[:k1] if len(x) > 1 else x[0] for x in merged], total


def box_gaps(lo: np.ndarray, hi: np.ndarray, los: np.ndarray, his: np.ndarray) -> np.ndarray:
    """Squared distance of one box to every box."""
    gap = np.maximum(np.maximum(los - hi, lo - his), 0)
    return (gap * gap).sum(axis=1)


#: How file systems of the engine are called by the reader of the index on the executors.
_SCHEMES = {"s3a": "s3", "s3n": "s3", "wasbs": "abfss"}


def index_uri(path: str) -> str:
    """The address under which executors open a folder of the engine: other names of the same stores are mapped."""
    scheme, colon, rest = path.partition(":")
    if not colon or "/" in scheme:
        return f"file://{path}"
    if scheme == "dbfs":
        return "file:///dbfs/" + rest.lstrip("/")
    if scheme == "file":
        return "file:///" + rest.lstrip("/")
    return f"{_SCHEMES.get(scheme, scheme)}:{rest}"


class _Cells:
    """Cells of the written index, fetched from the shared folder and held for a while."""

    def __init__(self, path: str, dim: int, proj: np.ndarray):
        self.path, self.dim, self.proj, self.fs = path, dim, proj, None
        self.held: OrderedDict = OrderedDict()

    def get(self, s: int, cell: int) -> dict:
        if (s, cell) in self.held:
            self.held.move_to_end((s, cell))
            return self.held[s, cell]
        import pyarrow.fs as pafs
        import pyarrow.parquet as pq

        if self.fs is None:
            self.fs = pafs.FileSystem.from_uri(index_uri(self.path))
        fs, root = self.fs
        files = [f.path for f in fs.get_file_info(pafs.FileSelector(f"{root}/s={s}/cell={cell}")) if f.path.endswith(".parquet")]
        t = pa.concat_tables([pq.ParquetFile(fs.open_input_file(f)).read(columns=["leaf", "points", "vec", "key_counts", "keys", "lo", "hi"], use_threads=False) for f in files])
        order = np.argsort(t["leaf"].to_numpy())
        column = lambda c, kind: [np.frombuffer(x.as_buffer(), kind) for x in t[c].take(order)]
        raw = np.concatenate(column("vec", np.float32)).reshape(-1, self.dim)
        exact = raw.astype(np.float64)
        length = np.sqrt(np.einsum("ij,ij->i", exact, exact))
        exact /= length[:, None]
        unit = exact.astype(np.float32)
        projected = unit @ self.proj
        got = {
            "raw": raw, "unit": unit, "length": length, "proj": projected, "norm": (norm := (projected * projected).sum(axis=1)), "lifted": np.ascontiguousarray(np.vstack([2 * projected.T, -norm])), "ends": np.concatenate([[0], np.cumsum(t["points"].to_numpy()[order])]), "lo": np.stack(column("lo", np.float32)), "hi": np.stack(column("hi", np.float32)),
            "key_counts": np.concatenate(column("key_counts", np.int32)), "keys": np.concatenate(column("keys", np.int64)),
        }
        got["key_ends"] = np.concatenate([[0], np.cumsum(got["key_counts"])])
        got["least"] = got["keys"][got["key_ends"][:-1]]
        self.held[s, cell] = got
        if len(self.held) > _CELLS_HELD:
            self.held.popitem(last=False)
        return got


class _Best:
    """The best ``keep`` points so far of each query of a block, by rounded cosine and then smallest key.

    A point that comes after k+1 others in this order holds none of the first k+1 entries,
    so that many points decide a list however many points tie.
    """

    def __init__(self, queries: int, keep: int, kth: int):
        self.cos = np.full((queries, keep), -2.0)
        self.key = np.full((queries, keep), np.iinfo(np.int64).max)
        self.cell = np.full((queries, keep), -1, np.int32)
        self.row = np.full((queries, keep), -1, np.int32)
        self.kth = kth
        self.codes = np.zeros(0, np.int64)
        self.copies: dict[tuple[int, int], np.ndarray] = {}  # all keys of the points, by cell and row, that have several

    def worst(self) -> np.ndarray:
        return self.cos[:, self.kth]

    def add(self, q: np.ndarray, cos: np.ndarray, key: np.ndarray, cell: int, row: np.ndarray) -> None:
        last = self.cos[q, -1]
        better = (cos > last) | ((cos == last) & (key < self.key[q, -1]))
        if not better.any():
            return
        q, cos, key, row = q[better], cos[better], key[better], row[better]
        who = np.unique(q)
        keep = self.cos.shape[1]
        aq = np.concatenate([np.repeat(who, keep), q])
        ac = np.concatenate([self.cos[who].ravel(), cos])
        ak = np.concatenate([self.key[who].ravel(), key])
        al = np.concatenate([self.cell[who].ravel(), np.full(len(q), cell, np.int32)])
        ar = np.concatenate([self.row[who].ravel(), row.astype(np.int32)])
        order = np.lexsort((ak, -ac, aq))
        aq = aq[order]
        start = np.flatnonzero(np.concatenate([[True], aq[1:] != aq[:-1]]))
        take = order[(start[:, None] + np.arange(keep)).ravel()]  # everyone has at least ``keep`` lines
        self.cos[who], self.key[who], self.cell[who], self.row[who] = (x[take].reshape(-1, keep) for x in (ac, ak, al, ar))


def _cosines(home: dict, x: np.ndarray, other: dict, y: np.ndarray) -> np.ndarray:
    """Similarities as they are defined: in double precision, rounded."""
    dot = np.einsum("ij,ij->i", home["raw"][x].astype(np.float64), other["raw"][y].astype(np.float64))
    return np.round(dot / (home["length"][x] * other["length"][y]), 9)


def _home(cells: _Cells, s: int, own: list[int]) -> dict:
    """The points of some cells as one block of queries."""
    parts = [cells.get(s, c) for c in own]
    home = {x: np.concatenate([p[x] for p in parts]) for x in ("raw", "unit", "proj", "norm", "length", "key_counts", "keys")}
    return home | {"key_ends": np.concatenate([[0], np.cumsum(home["key_counts"])])}


def search_cells(cells: _Cells, directory, s: int, home: dict, k: int, stop: float, miss: float) -> _Best:
    """Nearest points of all queries of a block: rings of growing projected radius until the tests hold.

    The tests: of a vector nearer than the k-th best at squared distance d, the squared
    projected distance is above ``stop * d`` with a probability below 1 - confidence, and
    it lies outside the leaves that a ring visits with a probability of ``miss``.  A ring
    fetches each cell once for the whole block.
    """
    numbers, lo, hi, first, nodes = directory
    unit, proj, norm = home["unit"], home["proj"], home["norm"]
    many = len(unit)
    asked = np.hstack([proj, np.ones((many, 1), np.float32)])
    best = _Best(many, k + 9, k)  # itself, k others, and 8 to spare
    error = (unit.shape[1] + 4) * 2.0**-24  # of a cosine in single precision, at most
    gaps = box_gaps(proj.min(axis=0), proj.max(axis=0), lo, hi)  # no query is nearer to a box than its block's box
    seen: dict[int, np.ndarray] = {}  # by cell, the leaves (times ``many``) and queries of the last ring
    is_open = np.ones(many, bool)
    inner = np.full(many, -1.0, np.float32)  # what lies this near in a leaf of the last ring has been verified
    outer = np.full(many, stop * FIRST_RADIUS, np.float32)
    everything = stop * 4  # no two unit vectors are farther apart
    while is_open.any():
        open_ = np.flatnonzero(is_open)
        whole = outer[open_] > stop * FAR_AWAY
        by_radius, by_chance = open_[whole], open_[~whole]
        codes = [np.zeros(0, np.int64)]
        for i in range(0, len(by_chance), 16_384):
            part = by_chance[i : i + 16_384]
            q, leaf = likely_leaves(nodes, first[-1], proj[part], np.sqrt(stop / outer[part]), miss)
            codes.append(leaf * np.int64(many) + part[q])
        likely = np.sort(np.concatenate(codes))
        starts = np.searchsorted(likely, first * many)
        reach = outer[by_radius].max(initial=-1) * 1.00001  # single precision
        for c in np.argsort(gaps, kind="stable"):
            visit = likely[starts[c] : starts[c + 1]] - first[c] * many
            before = seen.get(c, visit[:0])
            before = before[is_open[before % many]]
            other = None
            if gaps[c] <= reach:
                want = by_radius[box_distance(proj[by_radius], lo[c : c + 1], hi[c : c + 1])[:, 0] <= outer[by_radius]]
                if len(want):
                    other = cells.get(s, int(numbers[c]))
                    q, leaf = np.nonzero(box_distance(proj[want], other["lo"], other["hi"]) <= outer[want][:, None])
                    visit = np.union1d(visit, leaf * np.int64(many) + want[q])
            if len(before):
                visit = np.union1d(visit, before)
            if not len(visit):
                continue
            other = other or cells.get(s, int(numbers[c]))
            at = visit % many
            most = np.full(len(visit), np.inf, np.float32)
            if len(before):
                again = np.searchsorted(visit, before)
                most[again] = (norm - inner)[at[again]]
            seen[c] = visit
            qs, rs = [], []
            edges = np.searchsorted(visit, np.arange(first[c + 1] - first[c] + 1) * many)
            for leaf in np.flatnonzero(np.diff(edges)):
                q, end = at[edges[leaf] : edges[leaf + 1]], most[edges[leaf] : edges[leaf + 1]]
                a, b = other["ends"][leaf], other["ends"][leaf + 1]
                least = (norm[q] - outer[q])[:, None]
                for i in range(0, len(q), 512):  # 2 q.p - |p|^2 against |q|^2 - radius, in pieces that stay in cache
                    d = asked[q[i : i + 512]] @ other["lifted"][:, a:b]
                    hit = np.flatnonzero(d >= least[i : i + 512])
                    if len(hit):
                        who = hit // (b - a) + i
                        ring = d.ravel()[hit] < end[who]
                        qs.append(q[who[ring]])
                        rs.append(hit[ring] % (b - a) + a)
            if qs:
                q, r = np.concatenate(qs), np.concatenate(rs)
                for i in range(0, len(q), 20_000):
                    x, y = q[i : i + 20_000], r[i : i + 20_000]
                    near = np.einsum("ij,ij->i", unit[x], other["unit"][y]) >= best.cos[x, -1] - error
                    x, y = x[near], y[near]
                    best.add(x, _cosines(home, x, other, y), other["least"][y], int(numbers[c]), y)
                    for row in np.unique(y[other["key_counts"][y] > 1]).tolist():
                        best.copies[int(numbers[c]), row] = other["keys"][other["key_ends"][row] : other["key_ends"][row + 1]]
        needed = (stop * 2 * np.maximum(0, 1 - best.worst())).astype(np.float32)  # as precise as ``outer``, which may be set to it
        is_open &= (needed > outer) & (outer < everything)
        inner[is_open] = outer[is_open]
        outer[is_open] = np.minimum(needed, outer * RADIUS_GROWTH)[is_open]
    return best


def nearest(df: DataFrame, key: str = "vec_id", space: str = "space", vector: str = "vec", *, k: int = 10, dim: int = 64, confidence: float = 0.98, seed: int = 11) -> DataFrame:
    """``(key, neighbour, similarity, position)``: the k most similar rows of each row's space."""
    spark = df.sparkSession
    rows = df.select(F.col(space).alias("space"), F.col(key).cast("long").alias("key"), F.col(vector).alias("vec")).where(F.col(key).isNotNull())
    sizes = rows.groupBy("space").count().limit(MOST_SPACES + 1).collect()
    if len(sizes) > MOST_SPACES:
        raise ValueError(f"more than {MOST_SPACES} spaces")
    names = {r["space"]: i for i, r in enumerate(sorted(sizes, key=lambda r: (r["space"] is not None, str(r["space"]))))}
    count = {r["space"]: r["count"] for r in sizes}
    m = projected_dimensions(max(count.values(), default=1))
    proj = directions(dim, m, seed)
    miss = (1 - confidence) / 4  # by leaf, and the rest by radius
    stop = chi_square_quantile(confidence + miss, m)
    k1 = k + 1
    kind = rows.schema["space"].dataType.simpleString()
    # a space of one cell needs no tree, another a few rows for each of its cells
    several = sum(n for n in count.values() if n > CELL_POINTS)
    rate = min(SAMPLE_A_CELL / CELL_POINTS, SAMPLE_TOTAL / max(1, several))
    big = [x for x, n in count.items() if n > CELL_POINTS]
    if len(big) <= 256:  # named in the condition
        of_several = F.col("space").isin(*[x for x in big if x is not None]) | (F.col("space").isNull() if None in big else F.lit(False))
        drawn = rows.where(F.coalesce(of_several, F.lit(False)))
    else:  # at most one line for each CELL_POINTS rows, and MOST_SPACES
        named = spark.createDataFrame([(x,) for x in big], f"space {kind}")
        drawn = rows.alias("r").join(F.broadcast(named.alias("b")), F.col("r.space").eqNullSafe(F.col("b.space")), "left_semi")

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, raw = _usable(batch.column(1), dim)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), pa.array([x.tobytes() for x in _unit(raw) @ proj], pa.binary())], names=["space", "p"])

    hashed = F.shiftrightunsigned(F.xxhash64("key", F.lit(seed)), 33) / float(2**31)
    sampled: dict = {}
    for r in drawn.where(hashed < rate).select("space", "vec").mapInArrow(project, f"space {kind}, p binary").collect():
        sampled.setdefault(r["space"], []).append(r["p"])
    trees = spark.sparkContext.broadcast({s: grow(np.frombuffer(b"".join(p), np.float32).reshape(-1, m), max(1, min(-(-count[s] // CELL_POINTS), len(p) // 16))) for s, p in sampled.items()})
    numbers = spark.sparkContext.broadcast(names)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = numbers.value
        for batch in batches:
            at, raw = _usable(batch.column(2), dim)
            own = batch.column(0).take(pa.array(at)).to_pylist()
            ids = batch.column(1).take(pa.array(at)).to_numpy()
            label = np.array([names[x] for x in own], np.int32)
            for name in set(own):
                i = np.flatnonzero(label == names[name])
                vec, keys, copies = _group_copies(raw[i], [x for x in ids[i][:, None]], np.ones(len(i), np.int64), k1)
                tree = trees.value.get(name) or [(-1, 0.0, 0, 0)]
                cell = descend(tree, _unit(vec) @ proj)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(vec), names[name], np.int32)), pa.array(cell), pa.array([x.tobytes() for x in vec], pa.binary()), pa.array([x.astype(np.int64).tobytes() for x in keys], pa.binary()), pa.array(copies)],
                    names=["s", "cell", "vec", "keys", "copies"],
                )

    def leaves(label: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        raw = np.frombuffer(b"".join(pdf["vec"]), np.float32).reshape(-1, dim)
        raw, keys, copies = _group_copies(raw, [np.frombuffer(x, np.int64) for x in pdf["keys"]], pdf["copies"].to_numpy(), k1)
        p = _unit(raw) @ proj
        tree = grow(p, -(-len(p) // LEAF_POINTS))
        leaf = descend(tree, p)
        order = np.argsort(leaf, kind="stable")
        number = {x: i for i, x in enumerate(np.unique(leaf).tolist())}
        tree = np.array([(-1, 0, number.get(a, -1), 0) if axis < 0 else (axis, cut, a, b) for axis, cut, a, b in tree], np.float64).tobytes()
        out = []
        for n, at in enumerate(np.split(order, np.flatnonzero(np.diff(leaf[order])) + 1)):
            part = [keys[i] for i in at]
            out.append((int(label[0]), int(label[1]), n, len(at), p[at].min(axis=0).tobytes(), p[at].max(axis=0).tobytes(), p.min(axis=0).tobytes(), p.max(axis=0).tobytes(), raw[at].tobytes(), np.array([len(x) for x in part], np.int32).tobytes(), np.concatenate(part).tobytes(), int(copies[at].max()), b"" if n else tree))
        return pd.DataFrame(out, columns=["s", "cell", "leaf", "points", "lo", "hi", "cell_lo", "cell_hi", "vec", "key_counts", "keys", "most_copies", "tree"])

    layout = "s int, cell int, leaf int, points int, lo binary, hi binary, cell_lo binary, cell_hi binary, vec binary, key_counts binary, keys binary, most_copies long, tree binary"
    path = shared_dir(spark)
    placed = rows.mapInArrow(place, "s int, cell int, vec binary, keys binary, copies long")
    placed.groupBy("s", "cell").applyInPandas(leaves, layout).write.partitionBy("s", "cell").parquet(path)
    fields = [f for f in layout.split(", ") if not f.startswith(("s ", "cell "))]
    index = spark.read.schema(", ".join([*fields, "s int", "cell int"])).parquet(path)
    directory: dict = {}
    crowded = False
    of_cells = index.groupBy("s", "cell").agg(F.first("cell_lo").alias("lo"), F.first("cell_hi").alias("hi"), F.max("most_copies").alias("copies"), F.count("*").alias("leaves"), F.max("tree").alias("tree"))
    for r in of_cells.orderBy("s", "cell").collect():
        directory.setdefault(r["s"], []).append((r["cell"], r["lo"], r["hi"], r["leaves"], r["tree"]))
        crowded |= r["copies"] > k1
    by_number = {names[x]: tree for x, tree in trees.value.items()}

    def listed(s: int, x: list[tuple]) -> tuple:
        first = np.cumsum([0, *[n for _, _, _, n, _ in x]])
        below = {c: (int(first[i]), np.frombuffer(tree).reshape(-1, 4).tolist()) for i, (c, _, _, _, tree) in enumerate(x)}
        nodes = graft(by_number.get(s) or [(-1, 0.0, 0, 0)], below)
        return np.array([y[0] for y in x], np.int32), *(np.stack([np.frombuffer(y[i], np.float32) for y in x]) for i in (1, 2)), first, nodes

    boxes = spark.sparkContext.broadcast({s: listed(s, x) for s, x in directory.items()})
    every = [(s, x[0]) for s in sorted(directory) for x in directory[s]]
    turns = spark.sparkContext.broadcast(every)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = _Cells(path, dim, proj)
        for batch in batches:
            own: dict = {}
            for s, cell in (turns.value[i] for i in batch.column(0).to_pylist()):
                own.setdefault(s, []).append(cell)
            for s, block in own.items():
                home = _home(cells, s, block)
                yield from _ranked(s, home, search_cells(cells, boxes.value[s], s, home, k, stop, miss), k, crowded)

    # cells that follow each other lie side by side and need the same others
    tasks = max(1, min(len(every), max(3 * spark.sparkContext.defaultParallelism, -(-len(every) // CELLS_A_TASK))))
    asked = spark.range(0, len(every), 1, tasks)
    found = asked.mapInArrow(search, "key long, neighbour long, similarity double, position int, copies_of binary")
    lists = found.where("copies_of is null").drop("copies_of")
    if not crowded:
        return lists
    return lists.unionByName(_further_copies(rows, found, index, k1, dim, numbers))


def _ranked(s: int, home: dict, best: _Best, k: int, crowded: bool) -> Iterator[pa.RecordBatch]:
    """The ranking of the best points, with copies, for all keys of each query."""
    best.codes = np.array([(c << 32) | row for c, row in best.copies], np.int64)
    for a in range(0, len(best.row), 1024):
        yield _ranked_part(s, home, np.arange(a, min(a + 1024, len(best.row))), best, k, crowded)


def _ranked_part(s: int, home: dict, at: np.ndarray, best: _Best, k: int, crowded: bool) -> pa.RecordBatch:
    q, j = np.nonzero(best.row[at] >= 0)
    pools = [best.key[at][q, j]]
    n_keys, first = np.ones(len(q), np.int64), np.arange(len(q))
    code = (best.cell[at][q, j].astype(np.int64) << 32) | best.row[at][q, j]
    base = len(q)
    for c in np.unique(code[np.isin(code, best.codes)]):
        keys, i = best.copies[int(c) >> 32, int(c) & 0xFFFFFFFF], np.flatnonzero(code == c)
        n_keys[i], first[i] = len(keys), base
        pools.append(keys)
        base += len(keys)
    pool = np.concatenate(pools)
    entry = np.repeat(np.arange(len(q)), n_keys)
    key = pool[first[entry] + np.arange(len(entry)) - np.repeat(np.cumsum(n_keys) - n_keys, n_keys)]
    sim, who = best.cos[at][q, j][entry], q[entry]
    order = np.lexsort((key, -sim, who))
    key, sim, who = key[order], sim[order], who[order]
    place = np.arange(len(who)) - np.searchsorted(who, who)
    keep = place <= k
    key, sim, who = key[keep], sim[keep], who[keep]
    starts, sizes = np.searchsorted(who, np.arange(len(at))), np.bincount(who, minlength=len(at))
    # one list for each key of a query: its entries without the key itself
    asks = home["key_counts"][at]
    asker = np.repeat(np.arange(len(at)), asks)
    asked = np.concatenate([home["keys"][home["key_ends"][i] : home["key_ends"][i + 1]] for i in at])
    line = np.repeat(np.arange(len(asker)), sizes[asker])
    entry = starts[asker][line] + np.arange(len(line)) - np.repeat(np.cumsum(sizes[asker]) - sizes[asker], sizes[asker])
    me, other, sim2 = asked[line], key[entry], sim[entry]
    keep = me != other
    me, other, sim2, line = me[keep], other[keep], sim2[keep], line[keep]
    position = np.arange(len(line)) - np.searchsorted(line, line) + 1
    keep = position <= k
    cols = [me[keep], other[keep], sim2[keep], position[keep].astype(np.int32)]
    copies: list = [None] * int(keep.sum())
    if crowded:  # also the plain list of each query, for copies beyond the keys that are kept
        digest = [_digest(s, home["raw"][i]) for i in at]
        place = np.arange(len(who)) - np.searchsorted(who, who)
        head = place < k
        cols = [np.concatenate(x) for x in zip(cols, [np.zeros(head.sum(), np.int64), key[head], sim[head], (place[head] + 1).astype(np.int32)])]
        copies += [digest[i] for i in who[head]]
    return pa.RecordBatch.from_arrays([*(pa.array(c) for c in cols), pa.array(copies, pa.binary())], names=["key", "neighbour", "similarity", "position", "copies_of"])


def _digest(s: int, vector: np.ndarray) -> bytes:
    return hashlib.blake2b(vector.tobytes(), digest_size=16, salt=int(s).to_bytes(8, "little")).digest()


def _further_copies(rows: DataFrame, found: DataFrame, index: DataFrame, k1: int, dim: int, numbers: Broadcast) -> DataFrame:
    """Lists of the copies whose key is not among the k1 smallest of their vector."""

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, raw = _usable(batch.column(2), dim)
            label = [numbers.value[x] for x in batch.column(0).take(pa.array(at)).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(1).take(pa.array(at)), pa.array([_digest(s, x) for s, x in zip(label, raw)], pa.binary())], names=["key", "copies_of"])

    def crowds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s, vec, counts, keys in zip(*(batch.column(i).to_pylist() for i in range(4))):
                n = np.frombuffer(counts, np.int32)
                full = np.flatnonzero(n == k1)
                raw = np.frombuffer(vec, np.float32).reshape(-1, dim)
                last = np.frombuffer(keys, np.int64)[np.cumsum(n) - 1]
                yield pa.RecordBatch.from_arrays([pa.array([_digest(s, raw[i]) for i in full], pa.binary()), pa.array(last[full])], names=["copies_of", "last"])

    copies = rows.select("space", "key", "vec").mapInArrow(digests, "key long, copies_of binary")
    full = index.where(F.col("most_copies") > k1).select("s", "vec", "key_counts", "keys").mapInArrow(crowds, "copies_of binary, last long")
    more = copies.join(full, "copies_of").where("key > last").select("copies_of", "key")
    plain = found.where("copies_of is not null").select("copies_of", "neighbour", "similarity", "position")
    return more.join(plain, "copies_of").select("key", "neighbour", "similarity", "position")
