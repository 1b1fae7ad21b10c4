"""SimHash near-dedup with the generalised pigeonhole principle.

1. Each whole text becomes a 64-bit fingerprint of its word shingles (XXH64, seed 42).
2. Equal fingerprints collapse, so a group of copies is one node from here on.
3. Bits are grouped into parts so that correlated bits share a part (greedy on the bit
   correlations, which are counted over all nodes).
4. For every node, dynamic programming over the parts allots thresholds t_i >= -1 with
   sum(t_i + 1) = distance + 1, where the estimated candidates and probes are fewest.
   Two fingerprints within the distance agree up to t_i bits in at least one part i.
5. Probes meet the nodes by part value in bins; candidates are verified by popcount in blocks, and
   a bin sends a spanning star of its links, never all pairs of a group.
6. Stars become components by star contraction over the cluster.

At scale: after the texts are read once, a node costs about m rows of 16 bytes and its
probes; the numbers of parts and bins follow the number of nodes, so bins stay small. A large group with one part value is
searched from node to node, each against the nodes not yet linked, so g fingerprints that are near one another cost about g
popcounts for each step of the search, not g**2; a bin never sends more than g - 1 links of a group.

Defined cases: a null or word-less text has fingerprint zero and links like any other; a
shorter text is one shingle; a long text is hashed in blocks of shingles; repeated rows stay rows of one component; a null doc_id gets the
component of its fingerprint and never names one (null if no known doc_id is in it); an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from ..session import materialize
from . import kernel as K
from .graph import components

SKETCH_BITS = 12
PROBE_COST, PAIR_BLOCK, LARGE = 20, 1 << 21, 1024


def fingerprint(text: bytes, shingle: int = 4) -> int:
    """The unsigned 64-bit fingerprint of one UTF-8 text."""
    words = text.lower().split()  # of bytes: A-Z and the six white-space bytes only
    if not words:
        return 0
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(b" ".join(words), 42)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[a:b], 42) for a, b in zip(starts[: 1 - shingle].tolist(), ends[shingle - 1 :].tolist(), strict=True)], np.uint64)
    bits = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 1 << 14):
        bits += np.unpackbits(hashes[i : i + (1 << 14)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * bits > len(hashes), bitorder="little").view(np.uint64)[0])


def _fingerprints(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = K.utf8(batch.column(1))
            found = [fingerprint(data[offsets[i] : offsets[i + 1]].tobytes(), shingle) for i in range(batch.num_rows)]
            yield pa.record_batch([batch.column(0), pa.array(np.array(found, np.uint64).view(np.int64)), batch.column(2)], names=["doc_id", "fp", "mark"])

    return run


def _bits(fps: np.ndarray) -> np.ndarray:
    return np.unpackbits(fps.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")


def _bit_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros((64, 64))
    for batch in batches:
        fps = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
        for i in range(0, len(fps), 1 << 16):
            x = _bits(np.ascontiguousarray(fps[i : i + (1 << 16)])).astype(np.float32)
            total += x.T @ x
    i, j = np.divmod(np.arange(4096), 64)
    yield pa.record_batch([pa.array(i), pa.array(j), pa.array(total.reshape(-1).astype(np.int64))], names=["i", "j", "n"])


def bit_groups(both: np.ndarray, n: int, parts: int) -> list[list[int]]:
    """Bits in ``parts`` groups of nearly equal size; both[i, j]: nodes with bits i and j set. Correlated bits go together."""
    p = np.diag(both) / max(n, 1)
    spread = np.sqrt(np.maximum(p * (1 - p), 1e-9))
    close = np.abs(both / max(n, 1) - np.outer(p, p)) / np.outer(spread, spread)
    np.fill_diagonal(close, 0)
    left, out = set(range(64)), []
    for k in range(parts):
        size = len(left) // (parts - k)
        group = [max(left, key=lambda b: (close[b, sorted(left)].sum(), -b))]
        left.discard(group[0])
        while len(group) < size:
            best = max(left, key=lambda b: (close[b, group].sum(), -b))
            group.append(best)
            left.discard(best)
        out.append(group)
    return out


def part_values(fps: np.ndarray, groups: list[list[int]]) -> list[np.ndarray]:
    """The bits of each group, gathered into a number."""
    out = []
    for group in groups:
        value = np.zeros(len(fps), np.uint64)
        for at, bit in enumerate(group):
            value |= ((fps >> np.uint64(bit)) & np.uint64(1)) << np.uint64(at)
        out.append(value)
    return out


def probes(width: int, radius: int) -> int:
    return sum(len(list(combinations(range(width), e))) for e in range(radius + 1))


def part_count(n: int, distance: int) -> int:
    """The number of parts with the least work for n nodes, were all values equally likely."""

    def work(m: int) -> float:
        width = 64 // m
        best = [0.0] + [np.inf] * (distance + 1)
        for _ in range(m):
            best = [min(best[s - t] + (probes(width, t - 1) * (PROBE_COST + n / 2.0**width) if t else 0) for t in range(0, min(s, 3) + 1)) for s in range(distance + 2)]
        return best[distance + 1]

    return min(range(max(1, (distance + 3) // 3), distance + 2), key=work)


def allot(values: list[np.ndarray], widths: list[int], sketches: np.ndarray, n: int, distance: int) -> np.ndarray:
    """t_i + 1 for every node (rows) and part (columns), by dynamic programming over estimated candidates.

    sketches[i]: counts of the nodes by the low SKETCH_BITS bits of part i.
    """
    rows, m = len(values[0]), len(values)
    costs = np.zeros((m, 4, rows))
    for i, (value, width) in enumerate(zip(values, widths, strict=True)):
        low = min(width, SKETCH_BITS)
        share = 2.0 ** -(width - low)
        near = (value & np.uint64(2**low - 1)).astype(np.int64)
        here = sketches[i][near] * share
        one = here * (1 + (width - low)) + sum(sketches[i][near ^ (1 << b)] for b in range(low)) * share
        costs[i, 1] = PROBE_COST + here
        costs[i, 2] = PROBE_COST * probes(width, 1) + one
        costs[i, 3] = PROBE_COST * probes(width, 2) + one + n * (probes(width, 2) - probes(width, 1)) / 2.0**width
    best = np.full((distance + 2, rows), np.inf)
    best[0] = 0
    choice = np.zeros((m, distance + 2, rows), np.int8)
    for i in range(m):
        now = np.full_like(best, np.inf)
        for s in range(distance + 2):
            for t in range(min(s, 3) + 1):
                cost = best[s - t] + costs[i, t]
                better = cost < now[s]
                now[s] = np.where(better, cost, now[s])
                choice[i, s] = np.where(better, t, choice[i, s])
        best = now
    out, state = np.zeros((rows, m), np.int8), np.full(rows, distance + 1)
    for i in reversed(range(m)):
        out[:, i] = choice[i, state, np.arange(rows)]
        state -= out[:, i]
    return out


def _to_bins(groups: list[list[int]], sketches: np.ndarray, n: int, distance: int, bins: int):
    widths = [len(g) for g in groups]
    masks = [[np.uint64(sum(1 << b for b in c)) for e in (1, 2) for c in combinations(range(w), e)] for w in widths]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            all_fps = np.ascontiguousarray(batch.column(0).to_numpy(zero_copy_only=False)).view(np.uint64)
            for i in range(0, len(all_fps), 1 << 14):
                fps = all_fps[i : i + (1 << 14)]
                values = part_values(fps, groups)
                radii = allot(values, widths, sketches, n, distance)
                keys, owners, roles = [], [], []
                for part, value in enumerate(values):
                    tag = np.uint64(part) << np.uint64(40)
                    keys.append(value | tag)
                    owners.append(fps)
                    roles.append((radii[:, part] > 0).astype(np.uint8))  # 1: a node that also probes its own value
                    for radius, flips in ((2, masks[part][: widths[part]]), (3, masks[part][widths[part] :])):
                        who = radii[:, part] >= radius
                        for flip in flips if who.any() else ():
                            keys.append((value[who] ^ flip) | tag)
                            owners.append(fps[who])
                            roles.append(np.full(int(who.sum()), 2, np.uint8))  # 2: a probe only
                keys, owners, roles = np.concatenate(keys), np.concatenate(owners), np.concatenate(roles)
                to = (K.mix(keys) % np.uint64(bins)).astype(np.int32)
                order = np.argsort(to, kind="stable")
                keys, owners, roles = keys[order], owners[order], roles[order]
                own, begin = np.unique(to[order], return_index=True)
                rows = [(b, K.pack(keys[s:e], owners[s:e], roles[s:e])) for b, s, e in zip(own.tolist(), begin.tolist(), [*begin[1:].tolist(), len(to)], strict=True)]
                yield pa.record_batch([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], names=["bin", "block"])

    return run


def _search_large(members: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that span the components of some distinct fingerprints: each is compared with those that no link has reached."""
    left, u, v = members, [], []
    while len(left):
        open_, left = [left[:1]], left[1:]
        while open_ and len(left):
            frontier = np.concatenate(open_)
            size = max(1, PAIR_BLOCK // len(left))
            now, rest = frontier[:size], frontier[size:]
            near = np.bitwise_count(now[:, None] ^ left[None, :]) <= distance
            hit = near.any(axis=0)
            u.append(now[near[:, hit].argmax(axis=0)])
            v.append(left[hit])
            open_ = [x for x in (rest, left[hit]) if len(x)]
            left = left[~hit]
    none = np.empty(0, np.uint64)
    return np.concatenate([none, *u]), np.concatenate([none, *v])


def _links(distance: int):
    def run(rows: pa.Table) -> pa.Table:
        blocks = [K.unpack(b.as_py()) for b in rows["block"]]
        keys, owners, roles = (np.concatenate(x) for x in zip(*blocks, strict=True))
        data = roles < 2
        order = np.argsort(keys[data], kind="stable")
        data_keys, data_fps = keys[data][order], owners[data][order]
        ask = roles > 0
        ask_keys, ask_fps = keys[ask], owners[ask]
        nodes = np.unique(owners)
        lo, hi = np.searchsorted(data_keys, ask_keys, "left"), np.searchsorted(data_keys, ask_keys, "right")
        root, size = np.arange(len(nodes)), hi - lo
        for key in np.unique(ask_keys[size >= LARGE]):
            a, b = _search_large(np.unique(owners[keys == key]), distance)
            u, v, kids = np.searchsorted(nodes, a), np.searchsorted(nodes, b), np.flatnonzero(root != np.arange(len(nodes)))
            root = K.components(len(nodes), np.concatenate([u, kids]), np.concatenate([v, root[kids]]))
        size = np.where(size < LARGE, size, 0)
        ends = np.cumsum(size)
        at, total = 0, int(ends[-1]) if len(ends) else 0
        while at < total:  # blocks of pairs; a group larger than a block is met in slices
            stop = min(total, at + PAIR_BLOCK)
            pair = np.arange(at, stop)
            who = np.searchsorted(ends, pair, "right")
            other = data_fps[lo[who] + pair - (ends[who] - size[who])]
            mine = ask_fps[who]
            near = (np.bitwise_count(mine ^ other) <= distance) & (mine != other)
            if near.any():
                u, v = np.searchsorted(nodes, mine[near]), np.searchsorted(nodes, other[near])
                kids = np.flatnonzero(root != np.arange(len(nodes)))
                root = K.components(len(nodes), np.concatenate([u, kids]), np.concatenate([v, root[kids]]))
            at = stop
        kids = np.flatnonzero(root != np.arange(len(nodes)))
        return pa.table({"u": pa.array(nodes[kids].view(np.int64)), "v": pa.array(nodes[root[kids]].view(np.int64))})

    return run


def near_links(nodes: DataFrame, distance: int = 4) -> DataFrame:
    """Links (u, v) between distinct fingerprints ``fp`` whose components are those of all pairs within the distance."""
    nodes = nodes.select("fp")
    counts = nodes.mapInArrow(_bit_counts, "i bigint, j bigint, n bigint").groupBy("i", "j").agg(F.sum("n").alias("n")).collect()
    both = np.zeros((64, 64))
    for row in counts:  # 4,096 rows, whatever the input
        both[row["i"], row["j"]] = row["n"]
    n = nodes.count()
    groups = bit_groups(both, n, part_count(n, distance))
    sketches = np.zeros((len(groups), 2**SKETCH_BITS))

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(groups), 2**SKETCH_BITS), np.int64)
        for batch in batches:
            fps = np.ascontiguousarray(batch.column(0).to_numpy(zero_copy_only=False)).view(np.uint64)
            for i, value in enumerate(part_values(fps, groups)):
                total[i] += np.bincount((value & np.uint64(2**SKETCH_BITS - 1)).astype(np.int64), minlength=2**SKETCH_BITS)
        i, v = np.nonzero(total)
        yield pa.record_batch([pa.array(i), pa.array(v), pa.array(total[i, v])], names=["i", "v", "n"])

    for row in nodes.mapInArrow(sketch, "i bigint, v bigint, n bigint").groupBy("i", "v").agg(F.sum("n").alias("n")).collect():
        sketches[row["i"], row["v"]] = row["n"]  # at most parts * 4,096 rows
    bins = max(8, n * len(groups) * 4 // 500_000)
    sent = nodes.mapInArrow(_to_bins(groups, sketches, n, distance, bins), "bin int, block binary")
    return sent.groupBy("bin").applyInArrow(_links(distance), "u bigint, v bigint")


def simhash_near_dedup(docs: DataFrame, distance: int = 4, shingle: int = 4, mark: bool = False) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (smallest doc_id reachable) of each row of (doc_id, text). mark: also the xxhash64 of its text."""
    plain = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"), F.xxhash64("text").alias("mark"))
    fps = materialize(plain.mapInArrow(_fingerprints(shingle), "doc_id bigint, fp bigint, mark bigint"))
    nodes = materialize(fps.groupBy("fp").agg(F.min("doc_id").alias("first")))
    roots = components(near_links(nodes, distance))
    placed = nodes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    names = placed.groupBy("root").agg(F.min("first").alias("component_id"))
    table = placed.join(names, "root").select("fp", "component_id")
    return fps.join(table, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", *(["mark"] if mark else []))
