"""SimHash fingerprints and their near-duplicate components, compared bit-sliced.

Fingerprint: A-Z lower-cased, words between ASCII white space, 3-word shingles with repeats, XXH64 with seed 42; a bit is
1 if set in over half the hashes. Distinct fingerprints that differ in at most 3 bits are linked.

Candidates: the 64 bits are cut into five blocks; three differing bits leave at least two blocks untouched, so two
linked fingerprints share the key of at least one of ten block pairs. Keys of one fingerprint are dropped before any
comparison. A key with more than `group` fingerprints is keyed again by the blocks of its remaining bits; at most 2^24
distinct fingerprints can share both keys, and those beyond `group` are compared tile by tile. So no task holds an
unbounded group, and no pair within the radius is lost.

Comparison: a group's bit planes are stored vertically, 64 fingerprints a word. A query adds one plane after the other to
all distances at once with carry-save counters that saturate beyond the radius, and words whose 64 lanes are all beyond
it are abandoned. A group returns a spanning forest, never its pairs.

Defined cases: null, empty and blank texts have fingerprint zero and are linked like any other; texts of one or two words
have one shingle; equal fingerprints are one component whatever their number; null doc_ids never name a component while
it has another doc_id; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import discard, key_bitmap, marked, materialise, ship, tidied

SEED, WIDTH, RADIUS = 42, 3, 3
GROUP = 8192
SMALL = 64
ALL = np.uint64(0xFFFFFFFFFFFFFFFF)


def fingerprint(text: bytes, width: int = WIDTH, seed: int = SEED) -> int:
    """The fingerprint of a whole text as an unsigned number."""
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    k = min(width, len(words))
    digest = xxhash.xxh64_digest
    spans = zip(starts[: len(words) - k + 1].tolist(), ends[k - 1 :].tolist(), strict=True)
    hashes = np.frombuffer(b"".join([digest(joined[a:b], seed) for a, b in spans]), np.uint8).reshape(-1, 8)
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 1 << 14):
        ones += np.unpackbits(hashes[i : i + (1 << 14)], axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and fp, the fingerprint as a signed long."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.fromiter((fingerprint(t.as_py() or b"") for t in batch.column(1).cast(pa.binary())), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], ["doc_id", "fp"])

    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(tidied(run), f"doc_id {dict(docs.dtypes)['doc_id']}, fp long")


def block_masks(bits: list[int], blocks: int = 5, agree: int = 2) -> list[int]:
    """Masks over the given bit positions: every choice of `agree` blocks of them."""
    parts = [sum(1 << b for b in bits[len(bits) * i // blocks : len(bits) * (i + 1) // blocks]) for i in range(blocks)]
    return [sum(c) for c in combinations(parts, agree)]


FIRST = block_masks(list(range(64)))
SECOND = [block_masks([b for b in range(64) if not m >> b & 1]) for m in FIRST]


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def planes(fps: np.ndarray) -> np.ndarray:
    """64 rows, one a bit; lane i of a row is fingerprint i. Missing lanes of the last word repeat the first fingerprint."""
    fps = np.concatenate([fps, np.repeat(fps[:1], -len(fps) % 64)])
    bits = np.unpackbits(fps.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return np.ascontiguousarray(np.packbits(bits.T, axis=1, bitorder="little")).view(np.uint64)


def add_plane(x: np.ndarray, ones: np.ndarray, twos: np.ndarray, over: np.ndarray) -> None:
    """Carry-save step: adds a plane of difference bits to all lanes' counters; over stays set from a count of 4 on."""
    carry = ones & x
    ones ^= x
    over |= twos & carry
    twos ^= carry


def near(query: np.ndarray, vertical: np.ndarray) -> np.ndarray:
    """For each query a row of words over the lanes: bits set where at most 3 bits differ."""
    n, words = len(query), vertical.shape[1]
    out = np.zeros(n * words, np.uint64)
    q, w = np.divmod(np.arange(n * words), words)
    ones, twos, over = (np.zeros(n * words, np.uint64) for _ in range(3))
    flips = np.where((query[:, None] >> np.arange(64, dtype=np.uint64)) & np.uint64(1), ALL, np.uint64(0)).T.copy()
    whole = True
    for k in range(64):
        x = (vertical[k][None, :] ^ flips[k][:, None]).ravel() if whole else vertical[k][w] ^ flips[k][q]
        add_plane(x, ones, twos, over)
        if k % 8 == 7 and k < 63 and k >= 15:
            live = np.flatnonzero(over != ALL)
            if len(live) < 0.6 * len(over):
                whole, q, w = False, q[live], w[live]
                ones, twos, over = ones[live], twos[live], over[live]
                if not len(live):
                    break
    out[q * words + w] = ~over
    return out.reshape(n, words)


def near_lanes(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether a[i] and b[i] differ in at most 3 bits, 64 pairs a word."""
    vertical = planes(a ^ b)
    ones, twos, over = (np.zeros(vertical.shape[1], np.uint64) for _ in range(3))
    for k in range(64):
        add_plane(vertical[k], ones, twos, over)
        if k % 16 == 15 and (over == ALL).all():
            break
    return np.unpackbits((~over).view(np.uint8), bitorder="little")[: len(a)].view(bool)


def roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest member of each member's component under the links a-b, by hooking and pointer jumping."""
    root = np.arange(n)
    while True:
        ra, rb = root[a], root[b]
        apart = ra != rb
        if not apart.any():
            return root
        a, b, ra, rb = a[apart], b[apart], ra[apart], rb[apart]
        np.minimum.at(root, np.maximum(ra, rb), np.minimum(ra, rb))
        while not (root == (jumped := root[root])).all():
            root = jumped


def group_roots(fps: np.ndarray, queries: int = 256) -> np.ndarray:
    """Components of one group of distinct fingerprints, compared all with all in blocks of queries."""
    vertical, n = planes(fps), len(fps)
    links_a, links_b = [], []
    for at in range(0, n, queries):
        hits = near(fps[at : at + queries], vertical)
        if n % 64:
            hits[:, -1] &= np.uint64((1 << n % 64) - 1)
        left = np.ones(len(hits), bool)
        # Queries whose lanes meet are one: each block adds a link a lane at most.
        while left.any():
            first = int(np.flatnonzero(left)[0])
            mask, members = hits[first].copy(), np.zeros(len(hits), bool)
            while True:
                met = left & ~members & (hits & mask).any(1)
                if not met.any():
                    break
                members |= met
                mask |= np.bitwise_or.reduce(hits[met], axis=0)
            left &= ~members
            left[first] = False
            lanes = np.flatnonzero(np.unpackbits(mask.view(np.uint8), bitorder="little")[:n])
            links_a.append(lanes), links_b.append(np.full(len(lanes), at + first))
    return roots(n, np.concatenate(links_a), np.concatenate(links_b))


def link_groups(gids: np.ndarray, fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links (fingerprint, smallest fingerprint of its component in the group) of whole groups, sorted by gid."""
    cuts = np.flatnonzero(np.concatenate([[True], gids[1:] != gids[:-1], [True]]))
    sizes = np.diff(cuts)
    a, b = [], []
    small = np.repeat((sizes > 1) & (sizes <= SMALL), sizes)
    g, f = gids[small], fps[small]
    for lag in range(1, min(SMALL, len(g))):
        i = np.flatnonzero(g[lag:] == g[:-lag])
        if not len(i):
            break
        i = i[near_lanes(f[i], f[i + lag])]
        a.append(i), b.append(i + lag)
    found = roots(len(f), np.concatenate(a), np.concatenate(b)) if a else np.arange(len(f))
    linked = np.flatnonzero(found != np.arange(len(f)))
    out_a, out_b = [f[linked]], [f[found[linked]]]
    for i in np.flatnonzero(sizes > SMALL):
        group = np.unique(fps[cuts[i] : cuts[i + 1]])
        found = group_roots(group)
        linked = np.flatnonzero(found != np.arange(len(group)))
        out_a.append(group[linked]), out_b.append(group[found[linked]])
    return np.concatenate(out_a), np.concatenate(out_b)


def _links(grouped: DataFrame) -> DataFrame:
    """Links of all groups (gid, fp); a task reads its groups as one sorted stream."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_g, held_f, rows = [], [], 0

        def out(gids: np.ndarray, fps: np.ndarray) -> pa.RecordBatch:
            a, b = link_groups(gids, fps.view(np.uint64))
            return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["u", "v"])

        for batch in batches:
            held_g.append(batch.column(0).to_numpy()), held_f.append(batch.column(1).to_numpy())
            rows += batch.num_rows
            if rows >= 1 << 17:
                gids, fps = np.concatenate(held_g), np.concatenate(held_f)
                last = int(np.searchsorted(gids, gids[-1]))
                if last:
                    yield out(gids[:last], fps[:last])
                held_g, held_f, rows = [gids[last:]], [fps[last:]], len(gids) - last
        if rows:
            yield out(np.concatenate(held_g), np.concatenate(held_f))

    return grouped.repartition("gid").sortWithinPartitions("gid", "fp").mapInArrow(tidied(run), "u long, v long")


def _shared(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The rows whose keys another row has too, with the number n of rows."""
    counts = rows.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1")
    return rows.join(counts, keys)


def _masked(masks: list[int], named: list[Column]) -> Column:
    return F.explode(F.array(*(F.struct(*(c.alias(f"c{j}") for j, c in enumerate(named)), F.lit(t).alias("t"), F.col("fp").bitwiseAND(F.lit(signed(m))).alias("key")) for t, m in enumerate(masks))))


def links(distinct: DataFrame, group: int = GROUP) -> DataFrame:
    """A spanning set of links u-v between distinct fingerprints (column fp) within the radius."""
    ship(distinct.sparkSession)
    keyed = distinct.select("fp", _masked(FIRST, []).alias("k")).select("fp", "k.t", "k.key")
    shared = materialise(_shared(keyed, ["t", "key"]), "simhash-shared")
    grouped = shared.filter(F.col("n") <= group).select(F.xxhash64("t", "key").alias("gid"), "fp")
    hot = shared.filter(F.col("n") > group)
    if not hot.isEmpty():
        finer = F.element_at(F.array(*(F.array(*(F.lit(signed(m)) for m in row)) for row in SECOND)), F.col("t") + 1)
        again = hot.select("fp", "t", "key", F.posexplode(finer).alias("t2", "mask")).select("fp", "t", "key", "t2", F.col("fp").bitwiseAND(F.col("mask")).alias("key2"))
        again = _shared(again, ["t", "key", "t2", "key2"])
        tiles = F.ceil(F.col("n") / group).cast("int")
        again = again.withColumn("tiles", tiles).withColumn("i", F.pmod(F.xxhash64("fp"), F.col("tiles")).cast("int"))
        again = again.withColumn("j", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
        tile = [F.least("i", "j"), F.greatest("i", "j")]
        grouped = grouped.unionByName(again.select(F.xxhash64("t", "key", "t2", "key2", *tile).alias("gid"), "fp"))
    out = materialise(_links(grouped).distinct(), "simhash-links")
    discard(shared)
    return out


def components(edges: DataFrame) -> DataFrame:
    """u and its component's smallest member v, for all u that are not it: large-star and small-star rounds."""

    def mark(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())

    edges = materialise(edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    now = mark(edges)
    while now[0]:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        lowest = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(lowest, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        large = materialise(large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "large-star")
        lowest = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(lowest, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(lowest.select("u", F.col("m").alias("v")))
        small = materialise(small.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "small-star")
        before, now = now, mark(small)
        discard(edges, large)
        edges = small
        if before == now:
            break
    return edges


def near_duplicates(docs: DataFrame, group: int = GROUP) -> DataFrame:
    """doc_id, fingerprint (16 hexadecimal digits), component_id (smallest doc_id reachable over links)."""
    fps = materialise(fingerprints(docs), "fingerprints")
    found = links(fps.select("fp").distinct(), group)
    stars = components(found)
    # The smallest doc_id of a fingerprint, then of a component: a row a fingerprint from here on.
    least = fps.groupBy("fp").agg(F.min("doc_id").alias("first_id"))
    root = least.join(stars.select(F.col("u").alias("fp"), F.col("v").alias("root")), "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"), "first_id")
    named = root.join(root.groupBy("root").agg(F.min("first_id").alias("component_id")), "root").select("fp", "component_id")
    out = fps.join(named, "fp")
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame, group: int = GROUP) -> DataFrame:
    """docs with one row of each component: the smallest doc_id's.

    Rows that share a doc_id are one document: it stays if one of them leads its component, as its first row in hash
    order. Rows without a doc_id stay. Only rows that may have to go are shuffled; a bitmap of fixed size tells the
    others, which pass where they are read. A component of any size is only ever counted, never gathered.
    """
    named = near_duplicates(docs, group).filter("doc_id is not null")
    named = named.groupBy("doc_id").agg(F.count("*").alias("__n"), F.max((F.col("doc_id") == F.col("component_id")).cast("int")).alias("__leads"))
    touched = materialise(named.filter("__n > 1 or __leads = 0").withColumnRenamed("doc_id", "__doc"), "simhash-touched")
    bits = key_bitmap(touched, ["__doc"])
    # A row's columns travel as one, so their names cannot clash with those used here.
    rows = docs.select("doc_id", F.struct(*docs.columns).alias("row"))
    maybe = marked(rows, ["doc_id"], bits, True)
    found = maybe.join(touched, maybe["doc_id"] == touched["__doc"], "left")
    clear = found.filter("__doc is null").select("row")
    repeats = found.filter("__leads = 1 and __n > 1").withColumn("__h", F.xxhash64("row"))
    one = repeats.withColumn("__k", F.row_number().over(Window.partitionBy("doc_id").orderBy("__h"))).filter("__k = 1").select("row")
    kept = marked(rows, ["doc_id"], bits, False).select("row").unionByName(clear).unionByName(one)
    return kept.select(*(F.col("row").getField(c).alias(c) for c in docs.columns))
