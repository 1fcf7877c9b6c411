"""Near-duplicate documents: SuperMinHash signatures, banding, verification on full sets, union-find grouping.

Documents with equal shingle sets form a class, and only class representatives are compared. Band buckets propose
pairs, signatures screen them, and full sets decide. Proposals come in two steps so that a bucket never gives all its
pairs: first each member with the bucket's smallest and with its nearest member; then, once verified links are
grouped, only pairs across groups that their signatures don't rule out.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loamwork.llm.graph import connected_components
from loamwork.llm.store import Held, bounded, fresh, join_checked, materialise, prepare
from loamwork.llm.text import Piece, grams, mix, pieces

#: BANDS bands of BAND_ROWS slots: a pair of similarity 0.8 shares no band with probability (1 - 0.8^6)^42 = 3e-6.
SLOTS, BANDS, BAND_ROWS = 256, 42, 6
#: Slots whose low four bits travel with a bucket's members, and the least estimate by them that is worth verifying:
#: over four standard deviations under 0.8.
SCREEN, LEAST = 256, 0.68
#: Members of a bucket that one task holds; larger buckets are split and their parts met pairwise.
PART = 2048
#: Full sets, and their bytes, that a block of the second verification holds about.
BLOCK_SETS, BLOCK_BYTES = 2048, 16 << 20
#: Elements whose slot shuffles are held at once.
SHUFFLED = 1 << 15
_MAX = np.uint64(0xFFFFFFFFFFFFFFFF)
_STEP = np.uint64(0x9E3779B97F4A7C15)
_C = mix(np.arange(1, SLOTS + 1, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95)) | np.uint64(1)


def shingle_sets(p: Piece, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes ascending and distinct within each text, first position of each text and the end)."""
    n = p.counts()
    parts: list[np.ndarray] = []
    g = grams(p.hash, k)
    sizes = np.zeros(p.n + 1, np.int64)
    for i in range(p.n):
        a, c = p.first[i], n[i]
        if c >= k:
            own = np.sort(mix(g[a : a + c - k + 1]))
        elif c:
            own = mix(grams(p.hash[a : a + c], int(c)) + np.uint64(c))
        else:
            continue
        if len(own) > 1:
            own = own[np.concatenate([[True], own[1:] != own[:-1]])]
        parts.append(own)
        sizes[i + 1] = len(own)
    return (np.concatenate(parts) if parts else np.zeros(0, np.uint64)), np.cumsum(sizes)


def _draw(elements: np.ndarray, level: int, slots: int) -> tuple[np.ndarray, np.ndarray]:
    """(place to swap with at this level, value) of each element."""
    z = mix(elements + np.uint64((level + 1) * int(_STEP) & int(_MAX)))
    place = level + ((z & np.uint64(0xFFFFFF)) * np.uint64(slots - level) >> np.uint64(24)).astype(np.int64)
    return place, (np.uint64(level) << np.uint64(40)) | (z >> np.uint64(24))


def superminhash(elements: np.ndarray, first: np.ndarray, slots: int = SLOTS) -> np.ndarray:
    """Signatures (texts x slots) by SuperMinHash (Ertl 2017), level by level for many texts at once.

    At level j an element's own shuffle of the slots names its j-th slot, which takes the minimum of j plus a fraction.
    A text stops at the first level that leaves no slot empty: every later value would be larger. Values are integers,
    the level in the high bits; an empty set keeps the maximum everywhere. Texts that go on past level 0 do so in
    batches of SHUFFLED elements, long texts first, so that the shuffles held are few and the levels of short ones shared.
    """
    n = len(first) - 1
    sizes = np.diff(first)
    sig = np.full((n, slots), _MAX, np.uint64)
    flat = sig.reshape(-1)
    place, value = _draw(elements, 0, slots)
    np.minimum.at(flat, np.repeat(np.arange(n), sizes) * slots + place, value)
    on = np.flatnonzero((sig == _MAX).any(1) & (sizes > 0))
    on = on[np.argsort(-sizes[on], kind="stable")]
    total = np.cumsum(sizes[on])
    at = 0
    while at < len(on):
        to = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + SHUFFLED, side="right")))
        own, at = on[at:to], to
        text = np.repeat(own, sizes[own])
        index = np.concatenate([np.arange(first[i], first[i + 1]) for i in own])
        live = elements[index]
        shuffle = np.tile(np.arange(slots, dtype=np.uint8 if slots <= 256 else np.uint16), (len(live), 1))
        rows = np.arange(len(live))
        shuffle[rows, place[index]] = 0
        for level in range(1, slots):
            pick, value = _draw(live, level, slots)
            slot = shuffle[rows, pick]
            shuffle[rows, pick] = shuffle[rows, level]
            np.minimum.at(flat, text * slots + slot, value)
            waiting = (sig[own] == _MAX).any(1)
            if not waiting.any():
                break
            if (kept := np.repeat(waiting, sizes[own])).sum() < 0.75 * len(live):
                own, text, live, shuffle = own[waiting], text[kept], live[kept], shuffle[kept]
                rows = np.arange(len(live))
    return sig


def class_keys(sets: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes of each set; zeros for an empty one."""
    out = []
    for c in (_STEP, _C[0]):
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(sets ^ c))])
        out.append(mix(sums[first[1:]] - sums[first[:-1]] + np.diff(first).astype(np.uint64)).view(np.int64))
    return out[0], out[1]


FEATS = "doc_id long, n long, s1 long, s2 long, bands array<long>, screen binary"


def _features(k: int) -> Callable:
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shift = np.arange(BANDS, dtype=np.uint64) * _STEP
        for batch in batches:
            for p in pieces(batch.column("text"), lower=True):
                sets, first = shingle_sets(p, k)
                sig = superminhash(sets, first)
                s1, s2 = class_keys(sets, first)
                used = sig[:, : BANDS * BAND_ROWS].reshape(p.n, BANDS, BAND_ROWS)
                bands = mix((used * _C[:BAND_ROWS]).sum(2) + shift).view(np.int64)
                low = (sig[:, :SCREEN] & np.uint64(15)).astype(np.uint8)
                screen = low[:, 0::2] | (low[:, 1::2] << 4)
                listed = pa.ListArray.from_arrays(pa.array(np.arange(p.n + 1) * BANDS, pa.int32()), pa.array(bands.ravel()))
                made = [pa.array(np.diff(first)), pa.array(s1), pa.array(s2), listed, pa.array([x.tobytes() for x in screen], pa.binary())]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(p.row, p.n), *made], names=[x.split()[0] for x in FEATS.split(", ")])

    return emit


def _colliding(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by band hash, those whose hash another row has."""
    last_band, last_node, last_used = None, None, True
    for batch in batches:
        if not batch.num_rows:
            continue
        band, node = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        same = band[1:] == band[:-1]
        ties = last_band is not None and last_band == band[0]
        use = np.zeros(len(band), bool)
        use[1:] |= same
        use[:-1] |= same
        use[0] |= ties
        b, v = band[use], node[use]
        if ties and not last_used:
            b, v = np.concatenate([[last_band], b]), np.concatenate([[last_node], v])
        last_band, last_node, last_used = band[-1], node[-1], bool(use[-1])
        yield pa.RecordBatch.from_arrays([pa.array(b, pa.int64()), pa.array(v, pa.int64())], names=["band", "node"])


def _unpack(blobs: list[bytes]) -> np.ndarray:
    packed = np.frombuffer(b"".join(blobs), np.uint8).reshape(len(blobs), SCREEN // 2)
    return np.concatenate([packed & 15, packed >> 4], axis=1)


def _estimate(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Similarities of the rows of a to the signature b; a sixteenth of unlike slots agree by chance."""
    return ((a == b).mean(1) - 1 / 16) / (15 / 16)


def _groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[tuple, list[list]]]:
    """Rows sorted by their first columns, group after group: (key, the other columns as lists)."""
    held, key = None, None
    for batch in batches:
        cols = [c.to_pylist() for c in batch.columns]
        for row in zip(*cols, strict=True):
            if held is None or row[:keys] != key:
                if held is not None:
                    yield key, held
                key, held = row[:keys], [[] for _ in cols[keys:]]
            for to, x in zip(held, row[keys:], strict=True):
                to.append(x)
    if held is not None:
        yield key, held


PROPOSED = "x long, y long, estimate double, near boolean"


def _propose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each part of a bucket (band, part, node, screen, least, least_screen): two partners a member at most."""

    def made(rows: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.int64(), pa.int64(), pa.float64(), pa.bool_()]
        return pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], kinds[j]) for j in range(4)], names=[x.split()[0] for x in PROPOSED.split(", ")])

    rows: list[tuple] = []
    for _, (node, screen, least, least_screen) in _groups(batches, 2):
        a = _unpack(screen)
        to_least = _estimate(a, _unpack(least_screen[:1])[0])
        rows += [(x, least[0], float(e), False) for x, e in zip(node, to_least, strict=True) if x != least[0] and e >= LEAST]
        for i, x in enumerate(node if len(node) > 1 else []):
            e = _estimate(a, a[i])
            e[i] = -1
            j = int(e.argmax())
            if e[j] >= LEAST and node[j] not in (x, least[0]):
                rows.append((x, node[j], float(e[j]), True))
        if len(rows) > 20_000:
            yield made(rows)
            rows = []
    yield made(rows)


def _across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of two parts of a bucket (band, i, j, node, screen, bands, component, part, cluster, block): the pairs of two components
    that may be links, each in the first bucket only that holds both, packed by their cluster and the blocks of their nodes."""

    def packed(cluster: int, held: list[np.ndarray]) -> pa.RecordBatch:
        both = np.concatenate(held) if held else np.zeros((0, 4), np.int64)
        both = both[np.lexsort((both[:, 1], both[:, 0]))]
        edge = np.flatnonzero(np.concatenate([[True], (both[1:, :2] != both[:-1, :2]).any(1)])) if len(both) else np.zeros(0, np.int64)
        cuts = [both[m:n, 2:].tobytes() for m, n in zip(edge, [*edge[1:], len(both)][: len(edge)], strict=True)]
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(edge), cluster, np.int64)), pa.array(both[edge, 0]), pa.array(both[edge, 1]), pa.array(cuts, pa.binary())], names=["cluster", "bx", "by", "pairs"])

    for (band, i, j), (node, screen, bands, component, part, cluster, block) in _groups(batches, 3):
        a, every, group, ids, side, home = _unpack(screen), np.array(bands), np.array(component), np.array(node), np.array(part), np.array(block, np.int64)
        held, size = [], 0
        for k in range(len(ids)):
            other = np.flatnonzero((group != group[k]) & (ids > ids[k]) & ((side != side[k]) if i != j else True))
            if len(other):
                other = other[_estimate(a[other], a[k]) >= LEAST]
            if len(other):
                other = other[every[k][(every[other] == every[k]).argmax(1)] == band]
            if len(other):
                low, high = np.minimum(home[other], home[k]), np.maximum(home[other], home[k])
                held.append(np.stack([low, high, np.full(len(other), ids[k]), ids[other]], axis=1))
                size += len(other)
            if size > 500_000:
                yield packed(cluster[0], held)
                held, size = [], 0
        yield packed(cluster[0], held)


def _verify_blocks(percent: int) -> Callable:
    def check(_: tuple, packed: pa.Table, sets: pa.Table) -> pa.Table:
        """The links that join components, among two blocks' candidate pairs."""
        own = {n: (c, np.frombuffer(x, np.uint64)) for n, c, x in zip(*(sets[k].to_pylist() for k in ("node", "component", "shingles")), strict=True)}
        up: dict[int, int] = {}

        def root(x: int) -> int:
            while up.get(x, x) != x:
                x = up[x]
            return x

        links = []
        for blob in packed["pairs"]:
            for x, y in np.frombuffer(blob.as_buffer(), np.int64).reshape(-1, 2).tolist():
                if x in own and y in own:
                    (cx, p), (cy, q) = own[x], own[y]
                    a, b = root(cx), root(cy)
                    if a != b and linked(p, q, percent):
                        up[max(a, b)] = min(a, b)
                        links.append((x, y))
        return pa.table({"x": pa.array([p[0] for p in links], pa.int64()), "y": pa.array([p[1] for p in links], pa.int64())})

    return check


def linked(p: np.ndarray, q: np.ndarray, percent: int) -> bool:
    """100 * intersection >= percent * union, of two ascending sets."""
    if 100 * min(len(p), len(q)) < percent * max(len(p), len(q)):
        return False
    at = np.searchsorted(p, q)
    both = int((p[np.minimum(at, len(p) - 1)] == q).sum())
    return 100 * both >= percent * (len(p) + len(q) - both)


def _sets_of(k: int) -> Callable:
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc, want1, want2 = (batch.column(c).to_pylist() for c in ("doc_id", "s1", "s2"))
            for p in pieces(batch.column("text"), lower=True):
                sets, first = shingle_sets(p, k)
                s1, s2 = class_keys(sets, first)
                rows = [i for i in range(p.n) if (s1[i], s2[i]) == (want1[p.row + i], want2[p.row + i])]
                yield pa.RecordBatch.from_arrays([pa.array([doc[p.row + i] for i in rows], pa.int64()), pa.array([int(first[i + 1] - first[i]) for i in rows], pa.int64()), pa.array([sets[first[i] : first[i + 1]].tobytes() for i in rows], pa.binary())], names=["node", "size", "shingles"])

    return emit


def _verify(percent: int) -> Callable:
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y, a, b = (batch.column(c).to_pylist() for c in ("x", "y", "a", "b"))
            told = [linked(np.frombuffer(p, np.uint64), np.frombuffer(q, np.uint64), percent) for p, q in zip(a, b, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()), pa.array(y, pa.int64()), pa.array(told, pa.bool_())], names=["x", "y", "linked"])

    return emit


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(x, y) -> (x, y, linked) by intersection and union of the full sets; sizes that rule a link out are not joined."""
    a = sets.select(F.col("node").alias("x"), F.col("size").alias("nx"), F.col("shingles").alias("a"))
    b = sets.select(F.col("node").alias("y"), F.col("size").alias("ny"), F.col("shingles").alias("b"))
    sized = pairs.join(a.select("x", "nx"), "x").join(b.select("y", "ny"), "y").filter(f"100 * least(nx, ny) >= {percent} * greatest(nx, ny)")
    both = sized.select("x", "y").join(b.select("y", "b"), "y").join(a.select("x", "a"), "x").select("x", "y", "a", "b")
    return both.mapInArrow(_verify(percent), "x long, y long, linked boolean")


def near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 80, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: doc_id, n_shingles, s1 and s2 (two hashes of the shingle set), component_id, kept (doc_id = component_id).

    Words are runs of other than ASCII white space, A-Z lower-cased; a text of fewer words than a shingle is one
    shingle; a text without words, or null, has an empty set and is alone. A null id is linked with nothing: its
    component is null and it is kept. Rows that share an id are one node. An empty table gives no rows.
    """
    prepare(docs.sparkSession)
    base = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    feats = materialise(base.mapInArrow(_features(shingle), FEATS), "signatures")
    with Held() as hold:
        component = materialise(_components(base, feats, shingle, percent, hold), "components")
    out = feats.select("doc_id", F.col("n").alias("n_shingles"), "s1", "s2").join(component, "doc_id", "left").withColumn("component_id", F.coalesce("component_id", "doc_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def deduplicate(docs: DataFrame, shingle: int = 5, percent: int = 80, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with one row of each near-duplicate group: the one of the smallest id. Rows without a word all stay.

    Rows are judged by their texts, whatever their ids: rows that share an id, or have none, get numbers of their own above
    all ids, written once so that they hold. Rows of such ids with the same text are one; of those the one whose columns
    sort first stays (columns that can't be sorted aside). An empty table gives no rows.
    """
    uid = fresh(docs, "uid")
    key = F.col(doc_id).cast("long")
    repeated = materialise(docs.groupBy(key.alias(uid)).agg(F.count("*").alias("n")).filter(f"n > 1 or `{uid}` is null").select(uid), "repeated")
    named = docs.withColumn(uid, key)
    if not repeated.isEmpty():
        top = named.agg(F.coalesce(F.max(uid), F.lit(0))).first()[0]
        marked = bounded(repeated.withColumnRenamed(uid, "marked"))
        same = F.col(f"`{uid}`").eqNullSafe(F.col("marked"))
        order = F.struct(*(F.col(f"`{c}`") for c in named.columns if not any(x in named.schema[c].dataType.simpleString() for x in ("map<", "variant"))))
        row = F.struct(*(F.col(f"`{c}`") for c in named.columns))
        by_text = F.sha2(F.coalesce(F.col(text), F.lit("")), 256)
        odd = named.join(marked, same, "left_semi").groupBy(F.col(uid).alias("k"), by_text.alias("t"), F.col(text).isNull().alias("z")).agg(F.min_by(row, order).alias("row"))
        # numbers in the order of id and text, so that the same row stays in every run
        odd = odd.repartitionByRange(F.asc_nulls_last("k"), "t").sortWithinPartitions(F.asc_nulls_last("k"), "t").select("row.*")
        odd = materialise(odd.withColumn(uid, F.lit(top + 1) + F.monotonically_increasing_id()), "odd")
        named = named.join(marked, same, "left_anti").unionByName(odd)
    told = near_duplicates(named.select(F.col(uid).alias("doc_id"), F.col(text).alias("text")), shingle, percent)
    gone = materialise(told.filter(~F.col("kept")).select(F.col("doc_id").alias(uid)), "gone")
    return join_checked(named, gone, [uid], "left_anti").select(*(F.col(f"`{c}`") for c in docs.columns))


def _components(base: DataFrame, feats: DataFrame, shingle: int, percent: int, hold: Held) -> DataFrame:
    """(doc_id, component_id) of the documents that have an id and a shingle, from their written features."""
    some = feats.filter("n > 0 and doc_id is not null")
    classes = some.groupBy("s1", "s2").agg(F.min("doc_id").alias("rep"))
    members = hold(some.join(classes, ["s1", "s2"]).filter("doc_id = rep").select(F.col("rep").alias("node"), "s1", "s2", "bands", "screen"))
    laid = members.select(F.explode("bands").alias("band"), "node").repartition("band").sortWithinPartitions("band", "node")
    hits = materialise(laid.mapInArrow(_colliding, "band long, node long").distinct(), "collisions")
    sizes = hold(hits.groupBy("band").agg(F.count("*").alias("g"), F.min("node").alias("least")).filter("g > 1"))
    screens = materialise(members.join(hits.select("node").distinct(), "node", "left_semi"), "screens")
    one = hold(screens.select("node", "screen").dropDuplicates(["node"]))
    rows = join_checked(hits.join(sizes, "band"), one, ["node"], "inner")
    rows = join_checked(rows, one.select(F.col("node").alias("least"), F.col("screen").alias("least_screen")), ["least"], "inner")
    rows = rows.withColumn("part", F.pmod(F.xxhash64("node"), F.ceil(F.col("g") / PART))).select("band", "part", "node", "screen", "least", "least_screen")
    proposed = rows.repartition("band", "part").sortWithinPartitions("band", "part").mapInArrow(_propose, PROPOSED)
    # two partners a document over all its buckets: the smallest that is like it, and the nearest
    best = proposed.groupBy("x", "near").agg(F.min("y").alias("low"), F.max_by("y", F.struct("estimate", "y")).alias("close"))
    first = materialise(best.select(F.col("x"), F.when(F.col("near"), F.col("close")).otherwise(F.col("low")).alias("y")).distinct(), "proposals")
    wanted = first.select(F.col("x").alias("node")).union(first.select("y")).distinct()
    sets = _full_sets(base, screens, wanted, shingle, hold)
    links = materialise(verified(first, sets, percent).filter("linked").select("x", "y"), "links")
    comps = connected_components(links)
    labelled = join_checked(hits.join(sizes.select("band", "g"), "band"), comps, ["node"], "left").withColumn("component", F.coalesce("component", "node"))
    labelled = materialise(labelled, "labelled")
    open_ = labelled.groupBy("band").agg(F.min("component").alias("a"), F.max("component").alias("b")).filter("a < b").select("band")
    rest = materialise(labelled.join(open_, "band", "left_semi"), "open")
    left = hold(rest.select("node", "component").distinct())
    if not left.isEmpty():
        more = _second_links(base, rest, left, screens, shingle, percent, hold)
        comps = connected_components(links.union(more))
    reps = some.select("doc_id", "s1", "s2").join(classes, ["s1", "s2"]).select("doc_id", "s1", "s2", F.col("rep").alias("node")).distinct()
    reps = join_checked(reps, comps, ["node"], "left").withColumn("component", F.coalesce("component", "node"))
    # rows that share an id are one node: its smallest component
    return reps.groupBy("doc_id").agg(F.min("component").alias("component_id"))


def _full_sets(base: DataFrame, screens: DataFrame, wanted: DataFrame, shingle: int, hold: Held) -> DataFrame:
    """The full shingle sets of the wanted representatives, from their texts."""
    keys = hold(screens.select("node", "s1", "s2").join(wanted, "node", "left_semi").distinct().withColumnRenamed("node", "doc_id"))
    return materialise(join_checked(base, keys, ["doc_id"], "inner").select("doc_id", "text", "s1", "s2").mapInArrow(_sets_of(shingle), "node long, size long, shingles binary"), "sets")


def _second_links(base: DataFrame, rest: DataFrame, left: DataFrame, screens: DataFrame, shingle: int, percent: int, hold: Held) -> DataFrame:
    """Links between components in the buckets that still hold several.

    Every pair that its signatures don't rule out is verified, save those of components that a link found in the same
    task has joined. Pairs stay packed. Nodes that buckets connect form a cluster, and full sets travel once a pair of
    blocks of their cluster: once in all for most, and never once a pair.
    """
    least = rest.groupBy("band").agg(F.min("node").alias("least"))
    clusters = connected_components(rest.join(least, "band").select("node", "least").filter("node <> least").distinct())
    left = materialise(left.join(clusters.select("node", F.col("component").alias("cluster")), "node"), "left")
    sets = _full_sets(base, screens, left.select("node"), shingle, hold)
    own = sets.dropDuplicates(["node"]).join(left, "node")
    large = own.groupBy("cluster").agg(F.greatest(F.ceil(F.count("*") / BLOCK_SETS), F.ceil(F.sum(F.octet_length("shingles")) / BLOCK_BYTES)).cast("int").alias("blocks")).filter("blocks > 1")
    large = materialise(large, "large")
    blocked = join_checked(left, large, ["cluster"], "left").withColumn("block", F.pmod(F.xxhash64("node", F.lit(1)), F.coalesce("blocks", F.lit(1))).cast("long")).drop("blocks")
    blocked = hold(blocked)
    parts = F.ceil(F.col("g") / PART).cast("int")
    spread = rest.withColumn("part", F.pmod(F.xxhash64("node"), parts).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), parts - 1)))
    spread = spread.join(screens.select("node", "screen", "bands").dropDuplicates(["node"]), "node").join(blocked.select("node", "cluster", "block"), "node")
    spread = spread.select("band", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"), "node", "screen", "bands", "component", "part", "cluster", "block")
    packed = materialise(spread.repartition("band", "i", "j").sortWithinPartitions("band", "i", "j").mapInArrow(_across, "cluster long, bx long, by long, pairs binary"), "packed")
    met = packed.select(*(F.col(c).alias(c) for c in ("cluster", "bx", "by"))).distinct()
    sides = met.select("cluster", F.col("bx").alias("block"), "bx", "by").union(met.filter("bx <> by").select("cluster", F.col("by").alias("block"), "bx", "by"))
    held = sets.join(blocked, "node").join(sides, ["cluster", "block"]).select("cluster", "bx", "by", "node", "component", "shingles")
    keys = ("cluster", "bx", "by")
    return materialise(packed.groupBy(*keys).cogroup(held.groupBy(*keys)).applyInArrow(_verify_blocks(percent), "x long, y long"), "second")
