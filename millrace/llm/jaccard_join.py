"""Exact self-join of documents whose shingle sets have a Jaccard similarity of at least a bound: a metric-space join.

Jaccard distance is a metric; r is the largest distance of a link.

1. *Pivots and Voronoi regions.* Sampled documents that lie apart are pivots, PIVOTS of them at most, and every document gets its distances to all pivots that it
   shares a shingle with. A document whose nearest pivot is within R (2r, if that is no more than 1 - 2r) belongs to that pivot's region; all others form the *far* region, the last one.
2. *Windows.* If x of pivot p's region links with y, then d(y, p) <= d(x, p) + r <= R + r, and, since p is nearest to x, d(y, p) <= d(y, q) + 2r for
   the pivot q nearest to y. So documents within this window of a region that comes before their own are replicated to it as guests, and
   every linked pair meets in the earlier one of its two regions.
3. *The far region.* Most documents there are at nearly distance 1 from all others, where the triangle inequality of whole documents tells nothing, so
   it is split by nested sets of shingles in one order for all documents (by how often a count sketch over the corpus has seen them, then by hash). The part of x
   that lies outside of y is a directed distance with a triangle inequality too: who is within k = size - ceil(bound * size) of x holds some of the first k + 1 shingles of x. Regions are those of single shingles,
   windows the first k + 1. Pairs that meet in a region are counted over all regions; what meets often enough to reach the bound is tied to one group, as are all documents
   of a region with more than SMALL. The order keeps common shingles out of windows; it never decides results.
4. *Recursion.* Regions of pivots and groups with more than GROUP documents, or MEMBERS members, draw pivots of their own and split by the
   same windows, across tasks, until they are small. Each small one is joined exactly in a task (again by pivots above CELL documents, then by matrix products).
5. *Dense regions.* Where all documents lie within each other's windows, no split can part them. They are cut into bands by their distance a from one central pivot,
   and the triangle inequality decides whole blocks of bands: blocks with a + a' <= r all link, without being compared or even brought together; blocks
   with |a - a'| > r never do; only the others are compared, each pair of blocks in a task of its own.

Guests carry a bit for each level at which they are guests: two guests of one level meet elsewhere, so their pair isn't counted. Equal sets are one document until the end, so exact copies cost nothing. Nothing is dropped or capped, and results don't depend
on the sketch or on the choice of pivots. Hashes have 64 bits: two different shingles of a document collide with odds of size**2 / 2**65.

Defined cases: a null text is empty; documents without words have no shingles, link with nothing and are their own component. Fewer words than a shingle has
make one shingle. A null id takes part and comes back as null, but names a component only if no other id is in it. Rows that repeat an id
are documents of their own. An empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm import common
from millrace.llm.common import Filter
from millrace.llm.components import connected_components, forest

#: Counters of the sketch, and of each slice in which it is merged: 8 MB for every executor, whatever the corpus.
SKETCH, SLICE = 1 << 21, 1 << 16
#: Pivots of the first level, and members of all their sets (8 MB): a bound on what is broadcast. A task offers so many of its own.
PIVOTS, PIVOT_MEMBERS, OFFERED = 1024, 1 << 20, 64
#: Window rows that one task joins, about.
RANGE_ROWS = 1 << 20
#: Documents of a far region that are paired directly; window rows of a shingle from which on it is dealt by row.
SMALL, HOT = 48, 1 << 18
#: Documents of a region that one task joins, and members of all their sets.
GROUP, MEMBERS = 1024, 1 << 22
#: Pivots of a region that is split; the share of comparisons, and the replication of documents, from which on the split counts as none.
SPLITS, STUCK, COPIES = 16, 0.5, 1.5
#: Bands of a dense region within the distance of a link.
BANDS = 8
#: Documents of a cell that are compared without further pivots, and pivots of a split within a task.
CELL, CELL_PIVOTS = 256, 16
#: Levels of recursion: one bit of a long for each.
DEPTH = 60
EPS = 1e-9


def _key(h: np.ndarray) -> int:
    """Signed 64-bit key of a set."""
    return int(np.int64(np.uint64(xxhash.xxh3_64_intdigest(h.tobytes(), seed=len(h)))))


def _window(n: int, num: int, den: int) -> int:
    return n - -(-n * num // den) + 1


def _counts(part: np.ndarray) -> bytes:
    """A slice of the sketch: small counts as bytes, all of them or those that aren't 0, and larger ones apart."""
    at, big = np.flatnonzero(part), np.flatnonzero(part >= 255)
    small = np.minimum(part, 255).astype(np.uint8)
    body = small.tobytes() if 3 * len(at) > SLICE else at.astype(np.uint16).tobytes() + small[at].tobytes()
    return np.array([len(body), len(big)], np.uint32).tobytes() + body + big.astype(np.uint16).tobytes() + part[big].astype(np.uint32).tobytes()


def _add_counts(total: np.ndarray, b: bytes) -> None:
    size, big = (int(x) for x in np.frombuffer(b, np.uint32, 2))
    body, rest = b[8 : 8 + size], b[8 + size :]
    if size == SLICE:
        total += np.frombuffer(body, np.uint8)
    else:
        n = size // 3
        total[np.frombuffer(body, np.uint16, n)] += np.frombuffer(body, np.uint8, n, 2 * n)
    total[np.frombuffer(rest, np.uint16, big)] += np.frombuffer(rest[2 * big :], np.uint32, big) - np.uint32(255)


def _profiles(words: int, row_keys: bool):
    """Rows (id, row key, n, key) of documents; then (slice, counts) of the sketch of what the task has read, and sets it offers as pivots (slice -2)."""

    def task(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts = np.zeros(SKETCH, np.uint32)
        offered: dict[int, tuple[int, np.ndarray]] = {}
        for f in frames:
            sets = [common.shingles(t, words) for t in f["text"]]
            if sets:
                counts += np.bincount((np.concatenate(sets) & np.uint64(SKETCH - 1)).astype(np.int64), minlength=SKETCH).astype(np.uint32)
            keys = [_key(s) for s in sets]
            for k, s in zip(keys, sets):
                if 0 < len(s) <= PIVOT_MEMBERS // OFFERED:
                    offered[_mixed(k)] = (k, s)
            offered = dict(sorted(offered.items())[:OFFERED])
            rows = [common.row_key(i, t or b"") for i, t in zip(f["id"].tolist(), f["text"])] if row_keys else None
            yield pd.DataFrame({"id": f["id"], "row": rows, "n": [len(s) for s in sets], "key": keys, "slice": -1, "counts": None})
        rows = [(k, 0, _counts(part)) for k, part in enumerate(counts.reshape(-1, SLICE)) if part.any()]
        rows += [(-2, k, s.tobytes()) for k, s in offered.values()]
        yield pd.DataFrame({"id": common.NO_ID, "row": None, "n": 0, "key": [r[1] for r in rows], "slice": [r[0] for r in rows], "counts": [r[2] for r in rows]})

    return task


def _mixed(key: int) -> int:
    return xxhash.xxh64_intdigest(key.to_bytes(8, "little", signed=True)) >> 1


def _add(rows: pd.DataFrame) -> pd.DataFrame:
    total = np.zeros(SLICE, np.uint32)
    for b in rows["counts"]:
        _add_counts(total, b)
    return pd.DataFrame({"slice": [rows["slice"].iat[0]], "counts": [total.tobytes()]})


class Pivots:
    """Distances to sets that are few enough to be everywhere, by an index of their members."""

    def __init__(self, sets: list[np.ndarray]):
        self.sizes = np.array([len(s) for s in sets], np.int64)
        all_, owner = np.concatenate([*sets, np.empty(0, np.uint64)]), np.repeat(np.arange(len(sets)), self.sizes)
        order = np.argsort(all_, kind="stable")
        self.members, first = np.unique(all_[order], return_index=True)
        self.owner, self.start = owner[order], np.append(first, len(all_))

    def near(self, sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(set, pivot, distance) wherever a set shares a member with a pivot, by set, then pivot."""
        empty = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
        if not len(self.members) or not sum(map(len, sets)):
            return empty
        h, of = np.concatenate(sets), np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        at = np.minimum(np.searchsorted(self.members, h), len(self.members) - 1)
        hit = self.members[at] == h
        at, of = at[hit], of[hit]
        times = self.start[at + 1] - self.start[at]
        place = np.repeat(self.start[at] - np.r_[0, np.cumsum(times)[:-1]], times) + np.arange(times.sum())
        pair, both = np.unique(np.repeat(of, times) * len(self.sizes) + self.owner[place], return_counts=True)
        i, p = pair // len(self.sizes), pair % len(self.sizes)
        n = np.array([len(s) for s in sets], np.int64)
        return i, p, 1 - both / (n[i] + self.sizes[p] - both)


def _apart(sets: list[np.ndarray], least: float, central: bool = False) -> list[int]:
    """Places of sets of which no two are closer than ``least``: each in turn that isn't too near to one before it; ``central``: those first that are nearest to all others."""
    i, j, d = Pivots(sets).near(sets)
    order = range(len(sets))
    if central:
        order = np.argsort(-np.bincount(i, 1 - d, len(sets)), kind="stable").tolist()
    close: dict[int, set[int]] = {}
    for a, b in zip(i[d < least].tolist(), j[d < least].tolist()):
        close.setdefault(a, set()).add(b)
    out: list[int] = []
    gone: set[int] = set()
    for k in order:
        if k not in gone:
            out.append(k)
            gone |= close.get(k, set())
    return out


def _near(r: float) -> float:
    """Radius of the regions of the first level. With 1 - 2r at most, whoever links with a document of a region shares shingles with its pivot."""
    return min(2 * r, 1 - 2 * r) - EPS


def _regions(i: np.ndarray, p: np.ndarray, d: np.ndarray, n: int, last: int, r: float, near: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(home of each of n documents, guests, regions that they visit) from distances by document and pivot; home is ``last`` where no pivot is as close as ``near``."""
    least = np.full(n, np.inf)
    np.minimum.at(least, i, d)
    home = np.full(n, last)
    nearest = d == least[i]
    np.minimum.at(home, i[nearest], p[nearest])
    home[~(least <= near)] = last
    window = (p < home[i]) & (d <= np.minimum(least[i] + 2 * r, near + r) + EPS)
    return home, i[window], p[window]


_PLACED = "region string, key long, n long, guest long, members binary, range int"


def _windows(words: int, num: int, den: int, ranges: int, sketch, pivots):
    """Documents of pivots' regions and their guests, as rows with whole sets; for the far region, window rows packed by range of the shingle's hash: shingles, keys, sizes and window lengths one after another."""
    r = 1 - num / den

    def pack(held: list[tuple[np.ndarray, int, int]]) -> pd.DataFrame:
        h = np.concatenate([x[0] for x in held])
        lengths = [len(x[0]) for x in held]
        key, n = np.repeat(np.array([x[1] for x in held], np.int64), lengths), np.repeat(np.array([x[2] for x in held], np.uint32), lengths)
        hot = sketch.value[(h & np.uint64(SKETCH - 1)).astype(np.int64)] >= HOT
        at = ((h >> np.uint64(24)) % np.uint64(ranges)).astype(np.int64)
        at[hot] = ranges + ((h[hot] ^ key[hot].view(np.uint64)) % np.uint64(ranges)).astype(np.int64)  # such a region is dealt over tasks
        order = np.argsort(at, kind="stable")
        ends = np.searchsorted(at[order], np.arange(2 * ranges + 1))
        rows = [(k, h[i].tobytes() + key[i].tobytes() + n[i].tobytes()) for k in range(2 * ranges) if len(i := order[ends[k] : ends[k + 1]])]
        return pd.DataFrame({"region": None, "key": 0, "n": 0, "guest": 0, "members": [x[1] for x in rows], "range": [x[0] for x in rows]})

    def task(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts, index, seen, held, size = sketch.value, pivots.value, set(), [], 0
        last = len(index.sizes)
        for f in frames:
            sets, keys = [], []
            for t in f["text"]:
                h = common.shingles(t, words)
                if len(h) and (key := _key(h)) not in seen:
                    seen.add(key)
                    sets.append(h)
                    keys.append(key)
            home, guest, visited = _regions(*index.near(sets), len(sets), last, r, _near(r))
            rows = [(f"p{home[k]}", keys[k], len(sets[k]), 0, sets[k].tobytes(), -1) for k in np.flatnonzero(home < last)]
            rows += [(f"p{p}", keys[k], len(sets[k]), 1, sets[k].tobytes(), -1) for k, p in zip(guest.tolist(), visited.tolist())]
            if rows:
                yield pd.DataFrame(rows, columns=["region", "key", "n", "guest", "members", "range"])
            for k in np.flatnonzero(home == last):
                h = sets[k]
                often = np.minimum(counts[(h & np.uint64(SKETCH - 1)).astype(np.int64)], (1 << 24) - 1).astype(np.uint64)
                w = h[np.argsort(often << np.uint64(40) | h >> np.uint64(24), kind="stable")[: _window(len(h), num, den)]]
                held.append((w, keys[k], len(h)))
                size += len(w)
                if size > RANGE_ROWS:
                    yield pack(held)
                    held, size = [], 0
        if held:
            yield pack(held)

    return task


def _unpack(blobs) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    parts = []
    for b in blobs:
        m = len(b) // 20
        parts.append((np.frombuffer(b, np.uint64, m), np.frombuffer(b, np.int64, m, 8 * m), np.frombuffer(b, np.uint32, m, 16 * m)))
    h, key, n = (np.concatenate(x) for x in zip(*parts))
    order = np.lexsort((key, h))
    h, key, n = h[order], key[order], n[order]
    once = np.r_[True, (h[1:] != h[:-1]) | (key[1:] != key[:-1])]
    return h[once], key[once], n[once].astype(np.int64)


_PAIR = "a long, b long, na long, nb long, met long"


def _pairs(num: int, den: int, ranges: int):
    """Pairs of a range and in how many of its regions they meet; met is -1 for pairs that only keep a large region together.

    Above ranges are parts of very large regions: their documents are tied to a node of the region's own.
    """

    def task(rows: pd.DataFrame) -> pd.DataFrame:
        h, key, n = _unpack(rows["members"])
        start = np.flatnonzero(np.r_[True, h[1:] != h[:-1]])
        m = np.diff(np.r_[start, len(h)])
        out = []
        if rows["range"].iat[0] >= ranges:
            return pd.DataFrame({"a": key, "b": (h >> np.uint64(1)).astype(np.int64), "na": n, "nb": n, "met": -1})
        for k in np.unique(m[(m > 1) & (m <= SMALL)]):  # regions of one size at once
            at = start[m == k][:, None] + np.arange(k)
            i, j = np.triu_indices(k, 1)
            a, b = at[:, i].ravel(), at[:, j].ravel()
            fit = den * np.minimum(n[a], n[b]) >= num * np.maximum(n[a], n[b])
            out.append(np.stack([key[a[fit]], key[b[fit]], n[a[fit]], n[b[fit]]], axis=1))
        pairs = np.concatenate(out) if out else np.empty((0, 4), np.int64)
        order = np.lexsort((pairs[:, 1], pairs[:, 0]))
        pairs = pairs[order]
        first = np.flatnonzero(np.r_[True, (pairs[1:, :2] != pairs[:-1, :2]).any(axis=1)]) if len(pairs) else np.empty(0, np.int64)
        met = np.diff(np.r_[first, len(pairs)])
        out = [np.column_stack([pairs[first], met])]
        for s, k in zip(start[m > SMALL], m[m > SMALL]):
            out.append(np.column_stack([key[s + 1 : s + k], np.full(k - 1, key[s]), n[s + 1 : s + k], np.full(k - 1, n[s]), np.full(k - 1, -1)]))
        return pd.DataFrame(np.unique(np.concatenate(out), axis=0), columns=["a", "b", "na", "nb", "met"])

    return task


def _linked(sets: list[np.ndarray], num: int, den: int, other: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs (i < j) of sets within the distance; with other, only pairs across that place."""
    size = np.array([len(s) for s in sets], np.int64)
    _, column = np.unique(np.concatenate(sets), return_inverse=True)
    row = np.repeat(np.arange(len(sets)), size)
    shared = np.bincount(column) > 1
    row, column = row[shared[column]], (np.cumsum(shared) - 1)[column[shared[column]]]
    pieces: list[np.ndarray] = []
    order = np.argsort(row, kind="stable")
    column, starts = column[order], np.searchsorted(row[order], np.arange(len(sets) + 1))
    wide = int(shared.sum())

    def common_(i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many members each of the sets i shares with each of the sets j."""
        total = np.zeros((len(i), len(j)), np.float32)
        step = max(512, (1 << 22) // max(len(i), len(j)))
        for low in range(0, wide, step):
            blocks = []
            for idx in (i, j):
                block = np.zeros((len(idx), min(step, wide - low)), np.float32)
                for r, x in enumerate(idx.tolist()):
                    c = column[starts[x] : starts[x + 1]]
                    block[r, c[(c >= low) & (c < low + step)] - low] = 1
                blocks.append(block)
            total += blocks[0] @ blocks[1].T
        return total.astype(np.int64)

    def compare(idx: np.ndarray) -> None:
        for low in range(0, len(idx), 1024):
            i = idx[low : low + 1024]
            both = common_(i, idx)
            x, y = np.nonzero(den * both >= num * (size[i][:, None] + size[idx][None, :] - both))
            x, y = i[x], idx[y]
            ok = x < y if other is None else (x < other) & (y >= other)
            pieces.append(x[ok] * len(sets) + y[ok])

    def split(idx: np.ndarray) -> None:
        if len(idx) <= CELL:
            return compare(idx)
        pivots = idx[np.linspace(0, len(idx) - 1, CELL_PIVOTS).astype(int)]
        both = common_(idx, pivots)
        # In units of 1 / den: a link means a distance of at most den - num.
        far = den * (1 - both / (size[idx][:, None] + size[pivots][None, :] - both))
        reach = far - far.min(axis=1, keepdims=True) <= 2 * (den - num) + 1e-6
        home = far.argmin(axis=1)
        cells = [idx[reach[:, k] & ((home == k).any())] for k in range(CELL_PIVOTS)]
        if sum(len(c) ** 2 for c in cells) > 0.8 * len(idx) ** 2:
            return compare(idx)
        for c in cells:
            if len(c) > 1:
                split(c)
        return None

    # Whatever has the same shared members lies together, so that pivots spread over the clusters.
    split(np.lexsort((np.array([s[0] for s in sets]), size)))
    found = np.unique(np.concatenate(pieces)) if pieces else np.empty(0, np.int64)
    return found // len(sets), found % len(sets)


def _group(num: int, den: int):
    """Rows (key, root, links) of the documents of one region, or of two blocks of a dense one (sides 0 and 1)."""

    def task(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["side", "key"], kind="stable", ignore_index=True)
        sets = [np.frombuffer(b, np.uint64) for b in rows["members"]]
        key, times, guest = rows["key"].to_numpy(), rows["times"].to_numpy(), rows["guest"].to_numpy()
        first = int((rows["side"] == 0).sum())
        i, j = _linked(sets, num, den, first if first < len(rows) else None)
        counted = (guest[i] & guest[j]) == 0
        ci, cj = i[counted], j[counted]
        links = np.bincount(ci, times[cj], len(sets)) + np.bincount(cj, times[ci], len(sets))
        nodes, roots = forest(key[i], key[j])
        root = pd.Series(roots, nodes).reindex(key).to_numpy() if len(nodes) else key
        root = np.where(pd.isna(root), key, root).astype(np.int64)
        return pd.DataFrame({"key": key, "root": root, "links": links.astype(np.int64)})

    return task


def _members(words: int, sent, bits: int):
    """Whole sets of documents that may be in a group, once for each task."""

    def task(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        test, seen = Filter(bits, np.frombuffer(sent.value, np.uint8)), set()
        for f in frames:
            out = []
            sets = [common.shingles(t, words) for t in f["text"]]
            keys = np.array([_key(s) for s in sets], np.int64)
            for k in np.flatnonzero(test.has(keys.view(np.uint64))) if len(keys) else ():
                if len(sets[k]) and keys[k] not in seen:
                    seen.add(keys[k])
                    out.append((keys[k], sets[k].tobytes()))
            yield pd.DataFrame(out, columns=["key", "members"]).astype({"key": "int64"})

    return task


def _numbers(keys: list) -> np.ndarray:
    return np.array(keys, np.int64).view(np.uint64)


def _assign(num: int, den: int, bit: int):
    """Some documents of a large region and the region's own pivots: rows with the child region, and the distance to its pivot. Without pivots (by chance) the region is its own child."""
    r = 1 - num / den

    def task(rows: pd.DataFrame, pivots: pd.DataFrame) -> pd.DataFrame:
        pivots = pivots.drop_duplicates("key").sort_values("key", ignore_index=True)
        sets = [np.frombuffer(b, np.uint64) for b in rows["members"]]
        found = [np.frombuffer(b, np.uint64) for b in pivots["members"]]
        best = _apart(found, 2 * r, True)  # the same ones in all parts of the region
        names = [str(pivots["key"][k]) for k in best]
        i, p, d = Pivots([found[k] for k in best]).near(sets)
        # All distances, also those of 1: a region of its own may be at distance 1 from all of its pivots.
        far = np.ones((len(sets), max(1, len(names))))
        far[i, p] = d
        i, p = (x.ravel() for x in np.indices(far.shape))
        home, guest, visited = _regions(i, p, far.ravel(), len(sets), len(names), r, 2.0)
        out = rows[["region", "key", "n", "times", "guest", "members"]].copy()
        out["child"] = [names[k] if names else "" for k in home] if names else ""
        out["a"] = far.min(axis=1)
        more = out.iloc[guest].copy()
        more["child"], more["a"] = [names[k] for k in visited], far[guest, visited]
        more["guest"] = more["guest"] | bit
        return pd.concat([out, more], ignore_index=True)

    return task


def _pivot_distance(rows: pd.DataFrame, pivots: pd.DataFrame) -> pd.DataFrame:
    """Some documents of a dense region with their distance to its central pivot."""
    out = rows[["region", "key", "n", "times", "guest", "members"]].copy()
    out["a"] = 1.0
    i, _, d = Pivots([np.frombuffer(b, np.uint64) for b in pivots["members"][:1]]).near([np.frombuffer(b, np.uint64) for b in rows["members"]])
    out.iloc[i, out.columns.get_loc("a")] = d
    return out


_ROWS = "region string, key long, n long, times long, guest long, members binary"


def _with_pivots(rows: DataFrame, pivots: DataFrame, task, schema: str) -> DataFrame:
    """task(documents, pivots) for parts of about half a group; rows have ``size``, that of their region, pivots (region, size, key, members)."""
    parts = F.ceil(F.col("size") * 2 / GROUP).cast("int")
    rows = rows.withColumn("part", F.pmod(F.xxhash64("key"), parts).cast("int"))
    pivots = pivots.withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1)))
    pivots = pivots.toDF(*pivots.columns)  # columns of their own, although they come from the same rows
    return rows.groupBy("region", "part").cogroup(pivots.groupBy("region", "part")).applyInPandas(task, schema)


def _small_and_dense(rows: DataFrame, num: int, den: int) -> tuple[DataFrame | None, DataFrame | None]:
    """Split regions by pivots of their own until they are small: rows of small regions, and of those that can't be split, with distances to a central pivot."""
    small, dense = [], []
    for depth in range(1, DEPTH):
        sizes = common.cut(rows.groupBy("region").agg(F.count("*").alias("size"), F.sum("n").alias("weight")))
        total = sizes.agg(F.sum("size")).first()[0] or 0
        rows = common.join_by_size(rows, sizes, "region", "size", total)
        large = (F.col("size") > GROUP) | (F.col("weight") > MEMBERS) & (F.col("size") > 1)
        small.append(rows.where(~large).select("region", "key", "n", "times", "guest", "members"))
        if sizes.where(large).isEmpty():
            break
        rows = rows.where(large)
        # About SPLITS pivots, fewer of long documents, drawn by hash.
        wanted = F.least(F.lit(float(SPLITS)), F.greatest(F.lit(3.0), F.lit(float(PIVOT_MEMBERS)) * F.col("size") / F.col("weight")))
        draw = F.shiftrightunsigned(F.xxhash64("key", F.lit(depth)), 11) / F.lit(float(1 << 53))
        pivots = common.cut(rows.where(draw * F.col("size") < wanted).select("region", "size", "key", "members"))
        split = common.cut(_with_pivots(rows, pivots, _assign(num, den, 1 << depth), f"{_ROWS}, child string, a double"))
        children = split.groupBy("region", "child").agg(F.count("*").alias("rows"))
        whole = sizes.where(large).select("region", "size")
        told = children.groupBy("region").agg(F.sum(F.col("rows") * F.col("rows")).alias("work"), F.sum("rows").alias("all"), F.max_by("child", "rows").alias("centre")).join(whole, "region")
        told = common.cut(told.withColumn("stuck", (F.col("work") > F.col("size") * F.col("size") * STUCK) | (F.col("all") > F.col("size") * COPIES)).withColumn("last", F.lit(depth == DEPTH - 1)))
        stuck = told.where("stuck or last")
        if not stuck.isEmpty():
            hard = common.join_by_size(rows.drop("size"), stuck.select("region", "size", "centre"), "region", "size", total)
            centre = hard.where(F.col("key") == F.expr("try_cast(centre as long)")).select("region", "size", "key", "members")
            dense.append(common.cut(_with_pivots(hard, centre, _pivot_distance, f"{_ROWS}, a double")))
        rows = common.join_by_size(split, told.where("not stuck and not last").select("region", "size"), "region", "size", total)
        rows = rows.select(F.concat_ws("/", "region", "child").alias("region"), "key", "n", "times", "guest", "members")
    union = lambda found: None if not found else found[0] if len(found) == 1 else found[0].unionByName(union(found[1:]))
    return union(small), union(dense)


def _dense_links(rows: DataFrame, num: int, den: int) -> DataFrame:
    """(key, root, links) of dense regions, from rows with a: the distance to the region's central pivot."""
    r = 1 - num / den
    rows = rows.withColumn("band", F.floor(F.col("a") * BANDS / r).cast("int") if r else F.lit(0))
    bands = rows.groupBy("region", "band").agg(F.count("*").alias("rows"))
    bands = F.broadcast(bands) if bands.count() <= 100_000 else bands
    rows = common.cut(rows.join(bands, ["region", "band"]).withColumn("cell", F.pmod(F.xxhash64("key"), F.ceil(F.col("rows") / GROUP)).cast("int")).withColumn("block", F.struct("band", "cell")).drop("rows", "band", "cell"))
    blocks = rows.groupBy("region", "block").agg(F.min("a").alias("low"), F.max("a").alias("high"), F.min("key").alias("one"))
    weights = rows.groupBy("region", "block", "guest").agg(F.sum("times").alias("weight"))
    left, right = (blocks.select("region", *(F.col(c).alias(f"{c}{k}") for c in ("block", "low", "high", "one"))) for k in (1, 2))
    pairs = left.join(right, "region").where(F.col("low2") - F.col("high1") <= r + EPS).where(F.col("low1") - F.col("high2") <= r + EPS)
    pairs = common.cut(pairs.withColumn("all", F.col("high1") + F.col("high2") <= r - EPS))

    # Blocks that all link: their weights are added up by block and guest bits, and one edge for each document keeps them together.
    sure = pairs.where("all")
    of = weights.select("region", F.col("block").alias("block1"), F.col("guest").alias("guest1")).join(sure, ["region", "block1"])
    other = weights.select("region", F.col("block").alias("block2"), F.col("guest").alias("guest2"), "weight")
    added = of.join(other, ["region", "block2"]).where("guest1 & guest2 = 0").groupBy("region", F.col("block1").alias("block"), F.col("guest1").alias("guest")).agg(F.sum("weight").alias("added"))
    near = sure.groupBy("region", F.col("block1").alias("block")).agg(F.min("one2").alias("one"), F.bool_or(F.col("block1") == F.col("block2")).alias("self"))
    known = rows.drop("members").join(near, ["region", "block"]).join(added, ["region", "block", "guest"], "left")
    own = F.when(F.col("self") & (F.col("guest") == 0), F.col("times")).otherwise(0)
    known = known.select("key", F.col("one").alias("root"), (F.coalesce("added", F.lit(0)) - own).alias("links"))
    known = known.union(sure.select(F.col("one1").alias("key"), F.col("one2").alias("root"), F.lit(0).cast("long").alias("links")))

    # Other pairs of blocks are compared, each in a task.
    open_ = pairs.where("not all and block1 <= block2").select("region", "block1", "block2")
    sides = [open_.select("region", F.col(f"block{k + 1}").alias("block"), "block1", "block2", F.lit(k).alias("side")) for k in (0, 1)]
    sites = rows.join(sides[0].union(sides[1].where("block1 <> block2")), ["region", "block"])
    return known.union(sites.groupBy("region", "block1", "block2").applyInPandas(_group(num, den), "key long, root long, links long"))


def similar_documents(docs: DataFrame, words: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id, n_links for every row; documents link when den * intersection >= num * union."""
    out = _linked_rows(docs, words, num, den, id_col, text_col, False)
    none = F.col("n") == 0
    component = F.when(none, F.col("id")).otherwise(F.col("component"))
    out = out.withColumn("component_id", component)
    return out.select(common.opened("id").alias("doc_id"), F.col("n").alias("n_shingles"), common.opened("component_id").alias("component_id"), F.when(none, 0).otherwise(F.col("links")).cast("long").alias("n_links"))


def _placed(rows: DataFrame, profile: DataFrame, classes: DataFrame, words: int, num: int, den: int) -> DataFrame:
    """Rows (region, key, n, times, guest, members): documents of the pivots' regions with their guests, and of the far region's groups."""
    spark = rows.sparkSession
    sketch = np.zeros(SKETCH, np.uint32)
    # 8 MB in one job; an iterator would run a job for each partition, of which only as many as there are slices have rows.
    for x in profile.where("slice >= 0").groupBy("slice").applyInPandas(_add, "slice int, counts binary").coalesce(SKETCH // SLICE).collect():
        sketch[x["slice"] * SLICE : (x["slice"] + 1) * SLICE] = np.frombuffer(x["counts"], np.uint32)
    chosen, members, r = [], 0, 1 - num / den
    offered = profile.where("slice = -2").select("key", "counts").dropDuplicates(["key"]).orderBy(F.xxhash64("key")).limit(PIVOTS)
    for x in offered.collect():
        if members + len(x["counts"]) // 8 <= PIVOT_MEMBERS:
            chosen.append(np.frombuffer(x["counts"], np.uint64))
            members += len(x["counts"]) // 8
    chosen = [chosen[k] for k in _apart(chosen, _near(r) + r)]  # pivots next to each other would share their regions' documents
    n = F.col("n")
    total = profile.where("slice = -1").agg(F.sum(n - F.ceil(n * num / den) + 1)).first()[0] or 0
    ranges = int(total // RANGE_ROWS + 1)
    sent = spark.sparkContext.broadcast(sketch), spark.sparkContext.broadcast(Pivots(chosen))
    first = common.cut(rows.mapInPandas(common.tidied(_windows(words, num, den, ranges, *sent)), _PLACED))
    for x in sent:  # checkpointed, so nothing runs again that would need them
        x.destroy()
    del sketch, chosen
    common.release()

    pairs = first.where("range >= 0").select("range", "members").groupBy("range").applyInPandas(_pairs(num, den, ranges), _PAIR)
    # Of two documents, the one whose window ends first can share, beyond what met, only what lies after its window.
    tail = F.greatest(*(F.ceil(F.col(c) * num / den) - 1 for c in ("na", "nb")))
    enough = F.ceil((F.col("na") + F.col("nb")) * num / (num + den))
    pairs = pairs.groupBy("a", "b").agg(F.first("na").alias("na"), F.first("nb").alias("nb"), F.sum(F.greatest("met", F.lit(0))).alias("met"), F.min("met").alias("tie"))
    groups = common.cut(connected_components(pairs.where((F.col("tie") < 0) | (F.col("met") + tail >= enough)).select("a", "b")))
    filled, bits = common.sent_filter(groups, "node", _numbers)
    far = rows.mapInPandas(common.tidied(_members(words, filled, bits)), "key long, members binary").join(groups, F.col("key") == F.col("node"))
    far = far.select(F.concat(F.lit("g"), "root").alias("region"), "key", F.lit(0).cast("long").alias("guest"), "members")
    placed = first.where("range < 0").select("region", "key", "guest", "members").union(far).join(classes.select("key", "n", "times"), "key")
    return common.cut(placed.dropDuplicates(["key", "region"]).select("region", "key", "n", "times", "guest", "members"))


def _linked_rows(docs: DataFrame, words: int, num: int, den: int, id_col: str, text_col: str, row_keys: bool) -> DataFrame:
    """id, row key, n, root (one for each component), component (its smallest id) and links of every row; the last three mean nothing where n is 0."""
    rows = docs.select(common.sealed(id_col).alias("id"), F.col(text_col).cast("binary").alias("text"))
    profile = common.cut(rows.mapInPandas(common.tidied(_profiles(words, row_keys)), "id long, row binary, n long, key long, slice int, counts binary"))
    each = profile.where("slice = -1").select("id", "row", "n", "key")
    total = each.count()
    classes = common.cut(each.groupBy("key", "n").agg(F.min("id").alias("rep"), F.count("*").alias("times")))
    small, dense = _small_and_dense(_placed(rows, profile, classes, words, num, den), num, den)
    linked = small.withColumn("side", F.lit(0)).groupBy("region").applyInPandas(_group(num, den), "key long, root long, links long")
    linked = common.cut(linked if dense is None else linked.union(_dense_links(dense, num, den)))

    links = linked.groupBy("key").agg(F.sum("links").alias("links"))
    found = connected_components(linked.select(F.col("key").alias("a"), F.col("root").alias("b")))
    classes = classes.join(links, "key", "left").join(found.withColumnRenamed("node", "key"), "key", "left")
    # A component's name is its smallest id, which needn't belong to its smallest key.
    least = classes.where("root is not null").groupBy("root").agg(F.min("rep").alias("least"))
    classes = classes.join(least, "root", "left").select("key", "times", F.coalesce("root", "key").alias("root"), F.coalesce("least", "rep").alias("component"), (F.coalesce("links", F.lit(0)) + F.col("times") - 1).alias("links"))
    return common.join_by_size(each, common.cut(classes), "key", "times", total)


def one_of_each(docs: DataFrame, words: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The document with the smallest id of each component, with all its columns. Rows with a null id stay only where no id is in their component.

    Null ids and ids that repeat with different texts are no components: if the smallest id of one has several texts, that of the smallest hash stays.
    Texts without words stay; of rows that are equal in id and text one stays.
    """
    found = _linked_rows(docs, words, num, den, id_col, text_col, True)
    row = F.struct("id", "row").alias("best")
    each = found.where("n > 0").groupBy("root").agg(F.min(row).alias("best"), F.count("*").alias("rows")).where("rows > 1")
    told = common.join_by_size(found.where("n > 0").select("root", "row"), each, "root", "rows", found.count()).select(F.col("row").alias("key"), (F.col("row") == F.col("best.row")).alias("kept"))
    blank = found.where("n = 0").groupBy("row").agg(F.count("*").alias("rows")).where("rows > 1").select(F.col("row").alias("key"), F.lit(True).alias("kept"))
    return common.kept_rows(docs, id_col, text_col, common.cut(told.union(blank).distinct()))


ORACLE = r"""
with recursive w as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as ws from documents
), s as (
  select distinct doc_id, unnest(case when len(ws) = 0 then [] when len(ws) < 4 then [array_to_string(ws, ' ')] else list_transform(range(1, len(ws) - 2), lambda i: array_to_string(ws[i:i + 3], ' ')) end) as shingle from w
), n as (
  select doc_id, count(*) as n from s group by 1
), p as (
  select a.doc_id as a, b.doc_id as b, count(*) as met from s a join s b on a.shingle = b.shingle and a.doc_id <> b.doc_id group by 1, 2
), e as (
  select a, b from p join n x on x.doc_id = a join n y on y.doc_id = b where 100 * met >= 85 * (x.n + y.n - met)
), r as (
  select doc_id, doc_id as other from documents union select r.doc_id, e.b from r join e on r.other = e.a
), c as (
  select doc_id, min(other) as component_id from r group by 1
)
select doc_id, cast(coalesce(n.n, 0) as bigint) as n_shingles, component_id, (select count(*) from e where e.a = c.doc_id) as n_links from c left join n using (doc_id)
"""
