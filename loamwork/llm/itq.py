"""Embedding near-duplicates: iterative quantisation codes, multi-index Hamming tables, reranking by exact cosine."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loamwork.llm.graph import connected_components
from loamwork.llm.store import Held, join_checked, materialise, prepare

#: Vectors that the rotations are fitted on; every vector is indexed.
SAMPLE = 10_000
#: Bits of one rotation's code, as many as dimensions at most.
CODE_BITS = 64
#: Least probability that a pair exactly at the threshold shares a table's key.
RECALL = 0.999
#: Bits of a code that travel with each table's row and screen the pairs of a bucket: so many that pairs of unlike vectors
#: hardly pass, since what passes is gathered in clusters.
SCREEN_BITS = 192
CODES = tuple(f"c{k}" for k in range(SCREEN_BITS // 64))
#: Members of a table's bucket that one task holds; larger ones are split and their parts met pairwise.
PART = 2048
#: Rows of a bucket that are compared with the others at once.
CHUNK = 256
#: Classes of one length up to which all are compared, without an index.
EXACT = 2048
#: Vectors, and their bytes, that a block of the reranking holds about.
BLOCK, BLOCK_BYTES = 1024, 16 << 20


@dataclass(frozen=True)
class Index:
    """Rotations (dimensions x bits each), bits of a table's key, tables, bits that screen, and how many of those a link may
    differ in at most."""

    rotations: list[np.ndarray]
    key_bits: int
    tables: int
    screened: int
    most: int

    def bits(self, x: np.ndarray) -> np.ndarray:
        return np.concatenate([x @ r > 0 for r in self.rotations], axis=1)

    def keys(self, bits: np.ndarray) -> np.ndarray:
        """Each table's key: its own run of key_bits bits of one rotation's code, with the table's number above."""
        width = self.rotations[0].shape[1]
        each = width // self.key_bits
        place = np.int64(1) << np.arange(self.key_bits, dtype=np.int64)
        out = np.empty((len(bits), self.tables), np.int64)
        for t in range(self.tables):
            at = t // each * width + t % each * self.key_bits
            out[:, t] = bits[:, at : at + self.key_bits] @ place + (np.int64(t) << np.int64(32))
        return out


def rotation(x: np.ndarray, width: int, rng: np.random.Generator, steps: int = 25) -> np.ndarray:
    """ITQ (Gong and Lazebnik 2011): principal directions, then the rotation nearest to its own sign codes."""
    _, vectors = np.linalg.eigh(x.T @ x)
    basis = vectors[:, ::-1][:, :width]
    v = x @ basis
    r = np.linalg.qr(rng.standard_normal((width, width)))[0]
    for _ in range(steps):
        u, _, w = np.linalg.svd(v.T @ np.where(v @ r > 0, 1.0, -1.0))
        r = u @ w
    return basis @ r


def fit(sample: np.ndarray, rows: int, cosine: float, seed: int = 7) -> Index:
    """Rotations from unit vectors; key bits follow log2(rows), tables the recall at the threshold.

    A bit of two vectors at angle a differs with probability a / pi; a table finds them if none of its key_bits does.
    Vectors are not centred: planes through the origin keep that true, however far from it the corpus lies.
    """
    rng = np.random.default_rng(seed)
    width = min(CODE_BITS, sample.shape[1])
    q = math.acos(cosine) / math.pi
    key_bits = min(width, 24, max(8, round(math.log2(max(2, rows))) - 6))
    tables = math.ceil(math.log(1 - RECALL) / math.log(1 - (1 - q) ** key_bits))
    n = math.ceil(tables / (width // key_bits))
    rotations = []
    for _ in range(n):
        own = sample[rng.integers(0, len(sample), max(1, len(sample) // 2))]
        rotations.append(rotation(own, width, rng))
    bits = min(n, SCREEN_BITS // width) * width
    # in few dimensions rotations, and so the bits that a pair differs in, are more alike than independent ones
    slack = 4.5 * (1 + 16 / width) * math.sqrt(bits * q * (1 - q))
    return Index(rotations, key_bits, tables, bits, min(bits, math.ceil(bits * q + slack)))


def unit(rows: list[list[float]]) -> np.ndarray:
    x = np.array(rows, np.float64)
    x /= np.abs(x).max(1, keepdims=True)  # squares stay finite
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _members(batches: Iterator[pa.RecordBatch], index: Index) -> Iterator[pa.RecordBatch]:
    """A row a vector and table: its key, and the first SCREEN_BITS bits of its code as numbers of 64."""
    for batch in batches:
        if not batch.num_rows:
            continue
        bits = index.bits(unit(batch.column("vector").to_pylist()))
        keys = index.keys(bits)
        code = np.zeros((len(bits), SCREEN_BITS), np.uint8)
        code[:, : index.screened] = bits[:, : index.screened]
        code = np.packbits(code, axis=1).view(np.int64)
        for at in range(0, len(bits), 1024):
            k, c = keys[at : at + 1024], np.repeat(code[at : at + 1024], index.tables, axis=0)
            node = batch.column("node").slice(at, len(k)).to_numpy()
            yield pa.RecordBatch.from_arrays([pa.array(k.ravel()), pa.array(np.repeat(node, index.tables)), *(pa.array(np.ascontiguousarray(x)) for x in c.T)], names=["key", "node", *CODES])


def spread(near: np.ndarray) -> np.ndarray:
    """For each node of a symmetric matrix of links the first node of its component."""
    label = np.arange(len(near))
    while True:
        # every node takes the least label among its neighbours and itself, then its label's label
        new = label.copy()
        for at in range(0, len(near), CHUNK):
            to = slice(at, at + CHUNK)
            new[to] = np.minimum(new[to], np.where(near[to], label, len(label)).min(1))
        new = np.minimum(new, new[new])
        if (new == label).all():
            return label
        label = new


def _pairs(batches: Iterator[pa.RecordBatch], index: Index) -> Iterator[pa.RecordBatch]:
    """Of the parts of a bucket (key, i, j, node, part, code): a row a node with a candidate, its component's first node in
    the bucket, and the candidates above it, packed. A pair that an earlier table of the screened bits holds is left out."""
    bits = min(SCREEN_BITS, index.screened)
    width = index.rotations[0].shape[1]
    each = width // index.key_bits
    rows: list[tuple] = []

    def early(code: np.ndarray) -> np.ndarray:
        """The keys of those tables that the screened bits make up."""
        plain = np.unpackbits(code.view(np.uint8).reshape(len(code), -1), axis=1)[:, :bits].astype(np.int64)
        place = np.int64(1) << np.arange(index.key_bits, dtype=np.int64)
        return np.stack([plain[:, at : at + index.key_bits] @ place for t in range(min(index.tables, bits // width * each)) for at in (t // each * width + t % each * index.key_bits,)], axis=1)

    def met(key: int, i: int, j: int, node: np.ndarray, part: np.ndarray, code: np.ndarray) -> None:
        table = int(key) >> 32
        keys = early(code)[:, :table] if table else None
        for at in range(0, len(node), CHUNK):
            to = slice(at, at + CHUNK)
            near = sum(np.bitwise_count(code[to, None, k] ^ code[None, :, k]) for k in range(len(CODES))) <= index.most
            near &= node[to, None] < node[None, :]
            if i != j:
                near &= part[to, None] != part[None, :]
            x, y = np.nonzero(near)
            if keys is not None and len(x):
                apart = ~(keys[x + at] == keys[y]).any(1)
                x, y = x[apart], y[apart]
            cut = np.flatnonzero(np.diff(x, prepend=-1))
            for b, e in zip(cut, [*cut[1:], len(x)][: len(cut)], strict=True):
                rows.append((int(node[x[b] + at]), node[y[b:e]].tobytes()))

    def made() -> pa.RecordBatch:
        batch = pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.binary())], names=["a", "others"])
        rows.clear()
        return batch

    key, held = None, []
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [batch.column(c).to_numpy() for c in ("key", "i", "j", "node", "part")]
        code = np.stack([batch.column(c).to_numpy() for c in CODES], axis=1).view(np.uint64)  # of signed numbers bitwise_count takes the magnitude
        edge = np.flatnonzero((np.diff(cols[0]) != 0) | (np.diff(cols[1]) != 0) | (np.diff(cols[2]) != 0)) + 1
        for a, b in zip([0, *edge], [*edge, batch.num_rows], strict=True):
            here = (cols[0][a], cols[1][a], cols[2][a])
            if held and here != key:
                met(*key, *(np.concatenate([r[m] for r in held]) for m in range(3)))
                held = []
            key = here
            held.append((cols[3][a:b], cols[4][a:b], code[a:b]))
        if len(rows) > 20_000:
            yield made()
    if held:
        met(*key, *(np.concatenate([r[m] for r in held]) for m in range(3)))
    yield made()


def candidates(reps: DataFrame, index: Index, hold: Held) -> DataFrame:
    """(node, vector) -> (a, others): nodes that share a table's key and pass the code screen, packed by the smaller one."""
    shared = reps.sparkSession.sparkContext.broadcast(index)
    laid = hold(reps.select("node", "vector").mapInArrow(lambda x: _members(x, shared.value), f"key long, node long, {', '.join(f'{c} long' for c in CODES)}"))
    large = hold(laid.groupBy("key").agg(F.count("*").alias("g")).filter(f"g > {PART}"))
    rows = join_checked(laid, large, ["key"], "left")
    parts = F.ceil(F.coalesce("g", F.lit(1)) / PART).cast("int")
    rows = rows.withColumn("part", F.pmod(F.xxhash64("node"), parts).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), parts - 1)))
    rows = rows.select("key", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"), "node", "part", *CODES)
    return rows.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j").mapInArrow(lambda x: _pairs(x, shared.value), "a long, others binary")


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Candidate pairs of a batch as stars: as many rows as nodes, whatever the pairs."""
    for batch in batches:
        blobs = [np.frombuffer(x.as_buffer(), np.int64) for x in batch.column(1)]
        sizes = np.cumsum([0, *map(len, blobs)])
        node, at = np.unique(np.concatenate([batch.column(0).to_numpy(), *blobs]), return_inverse=True)
        up, of, other = np.arange(len(node)), at[: len(blobs)], at[len(blobs) :]

        def roots(x: np.ndarray) -> np.ndarray:
            while (up[x] != x).any():
                x = up[x]
            return x

        for k, a in enumerate(of):
            own = np.append(other[sizes[k] : sizes[k + 1]], a)
            top = roots(own)
            up[top] = up[own] = top.min()
        yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(node[roots(np.arange(len(node)))])], names=["a", "b"])


def _place(node, blocks):
    """The block of a node among so many, alike on columns and arrays."""
    if isinstance(node, np.ndarray):
        return (node ^ (node >> 7) ^ (node >> 17)) % blocks
    return F.pmod(node.bitwiseXOR(F.shiftright(node, 7)).bitwiseXOR(F.shiftright(node, 17)), blocks)


PACKED = "solo boolean, g long, bx long, by long, pairs binary"


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, others, solo, g, blocks) -> pairs by the group and blocks that their vectors meet in."""
    for batch in batches:
        out: dict[tuple, list[np.ndarray]] = {}
        for a, blob, solo, g, blocks in zip(batch.column(0).to_pylist(), batch.column(1), *(batch.column(c).to_pylist() for c in (2, 3, 4)), strict=True):
            other = np.frombuffer(blob.as_buffer(), np.int64)
            pairs = np.stack([np.full(len(other), a), other], axis=1)
            if blocks == 1:
                out.setdefault((solo, g, 0, 0), []).append(pairs)
                continue
            x, y = int(_place(np.array([a]), blocks)[0]), _place(other, blocks)
            for b in np.unique(y):
                out.setdefault((solo, g, min(x, int(b)), max(x, int(b))), []).append(pairs[y == b])
        keys = list(out)
        made = [pa.array([k[j] for k in keys], (pa.bool_(), pa.int64(), pa.int64(), pa.int64())[j]) for j in range(4)]
        yield pa.RecordBatch.from_arrays([*made, pa.array([np.concatenate(out[k]).tobytes() for k in keys], pa.binary())], names=[x.split()[0] for x in PACKED.split(", ")])


FOUND = "a long, b long, linked long"


def _told(node: np.ndarray, copies: np.ndarray, near: np.ndarray) -> pa.Table:
    """Of a symmetric matrix of links: (node, null, copies linked), and (node, first node of its component, null)."""
    linked = np.concatenate([near[at : at + CHUNK] @ copies for at in range(0, len(near), CHUNK)]) if len(near) else copies
    first = spread(near)
    has, off = np.flatnonzero(near.any(1)), np.flatnonzero(first != np.arange(len(first)))
    a = np.concatenate([node[has], node[off]])
    b = pa.array(np.concatenate([np.zeros(len(has), np.int64), node[first[off]]]), mask=np.arange(len(a)) < len(has))
    c = pa.array(np.concatenate([linked[has], np.zeros(len(off), np.int64)]), mask=np.arange(len(a)) >= len(has))
    return pa.table({"a": pa.array(a), "b": b, "linked": c})


def _vectors(held: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    node = held["node"].to_numpy()
    order = np.argsort(node)
    x = held["vector"].to_pylist()
    return node[order], held["copies"].to_numpy()[order], np.array([x[i] for i in order], object)


def _rerank(cosine: float):
    def check(_: tuple, packed: pa.Table, held: pa.Table) -> pa.Table:
        """Links among the candidate pairs of a group or two blocks: cosines of the original vectors."""
        node, copies, vectors = _vectors(held)
        near = np.zeros((len(node), len(node)), bool)
        for blob in packed["pairs"]:
            pairs = np.frombuffer(blob.as_buffer(), np.int64).reshape(-1, 2)
            near[np.searchsorted(node, pairs[:, 0]), np.searchsorted(node, pairs[:, 1])] = True
        a, b = np.nonzero(near)
        near[:] = False
        for d in {len(v) for v in vectors}:  # candidates have the same length
            own = np.flatnonzero([len(v) == d for v in vectors])
            x = np.zeros((len(node), d))
            x[own] = unit([vectors[i] for i in own])
            mine = np.isin(a, own)
            p, q = a[mine], b[mine]
            for at in range(0, len(p), 8192):
                to = slice(at, at + 8192)
                near[p[to], q[to]] = (x[p[to]] * x[q[to]]).sum(1) >= cosine
        return _told(node, copies, near | near.T)

    return check


def _all_pairs(cosine: float):
    def check(held: pa.Table) -> pa.Table:
        """Links among all vectors of a length that few have."""
        node, copies, vectors = _vectors(held)
        x = unit(list(vectors))
        near = np.zeros((len(x), len(x)), bool)
        for at in range(0, len(x), CHUNK):
            near[at : at + CHUNK] = [(x[i] * x).sum(1) >= cosine for i in range(at, min(at + CHUNK, len(x)))]
        np.fill_diagonal(near, False)
        return _told(node, copies, near | near.T)

    return check


def links(classes: DataFrame, cosine: float, hold: Held) -> DataFrame:
    """(node, vector, copies) -> FOUND rows: partial counts of the vectors linked, and a forest of the links.

    Lengths that up to EXACT classes have are compared whole; every other length has an index of its own, of which the
    driver fits as many as there are such lengths.
    """
    counts = hold(classes.groupBy(F.size("vector").alias("d")).agg(F.count("*").alias("n")))
    large = counts.filter(F.col("n") > EXACT).orderBy("d").collect()
    few = join_checked(classes.withColumn("d", F.size("vector")), counts.filter(F.col("n") <= EXACT).select("d"), ["d"], "inner")
    out = few.groupBy("d").applyInArrow(_all_pairs(cosine), FOUND)
    pairs = None
    for r in large:
        own = classes.filter(F.size("vector") == r["d"])
        sample = own.orderBy(F.xxhash64("node")).limit(SAMPLE).select("vector").collect()
        found = materialise(candidates(own, fit(unit([x["vector"] for x in sample]), r["n"], cosine), hold), "pairs")
        pairs = found if pairs is None else pairs.union(found)
    if pairs is None:
        return out
    # nodes that candidate pairs connect meet in one group: several small clusters, or two blocks of a large one
    cluster = connected_components(pairs.mapInArrow(_stars, "a long, b long"))
    cluster = materialise(cluster.join(classes.select("node", (F.size("vector") * 8 + 64).cast("long").alias("size")), "node"), "clusters")
    size = hold(cluster.groupBy("component").agg(F.count("*").alias("n"), F.sum("size").alias("bytes")))
    blocks = F.greatest(F.ceil(F.col("n") / BLOCK), F.ceil(F.col("bytes") / BLOCK_BYTES))
    total = size.agg(F.sum("n"), F.sum("bytes")).first()
    bins = max(1, -(-(total[0] or 0) // BLOCK), -(-(total[1] or 0) // BLOCK_BYTES))
    size = hold(size.select("component", blocks.cast("long").alias("blocks")))
    solo = F.col("blocks") == 1
    placed = join_checked(cluster, size, ["component"], "inner").select("node", solo.alias("solo"), F.when(solo, F.pmod(F.xxhash64("component"), F.lit(bins))).otherwise(F.col("component")).alias("g"), "blocks")
    placed = hold(placed.withColumn("block", _place(F.col("node"), F.col("blocks"))))
    packed = materialise(pairs.join(placed.withColumnRenamed("node", "a"), "a").select("a", "others", "solo", "g", "blocks").mapInArrow(_pack, PACKED), "packed")
    met = packed.select(*(F.col(c).alias(c) for c in ("solo", "g", "bx", "by"))).distinct()
    sides = met.withColumn("block", F.explode(F.array_distinct(F.array("bx", "by"))))
    held = placed.select("solo", "g", "block", "node").join(sides, ["solo", "g", "block"]).select("solo", "g", "bx", "by", "node").join(classes, "node")
    keys = ("solo", "g", "bx", "by")
    return out.union(packed.groupBy(*keys).cogroup(held.groupBy(*keys)).applyInArrow(_rerank(cosine), FOUND))


def near_duplicates(vectors: DataFrame, cosine: float = 0.9, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """Per row: vec_id, n_links, component_id, kept (vec_id = component_id).

    Equal vectors are one class; classes are compared, copies counted. Vectors of different lengths are not compared.
    Vectors that are null, empty or zero, or hold null or non-finite components link with nothing: no links, a component
    of their own. A null id links with nothing and is kept, its component null. Rows that share an id are one node. An
    empty table gives no rows.

    The links of a group of near copies are counted, which takes the square of its size in comparisons, in blocks: neither
    a row nor a vector travels a pair.
    """
    spark = vectors.sparkSession
    prepare(spark)
    base = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).cast("array<double>").alias("vector"))
    sound = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("vector", lambda x: x != 0)
    usable = base.filter(F.col("vec_id").isNotNull()).filter(F.coalesce(sound, F.lit(False)))
    classes = usable.groupBy("vector").agg(F.min("vec_id").alias("first"), F.count("*").alias("copies"))
    classes = materialise(classes.withColumn("node", F.monotonically_increasing_id()), "classes")  # a number a class, written once
    with Held() as hold:
        found = materialise(links(classes, cosine, hold), "links")
        comps = hold(connected_components(found.filter("b is not null").select("a", "b")))
        linked = found.filter("linked is not null").groupBy(F.col("a").alias("node")).agg(F.sum("linked").alias("linked"))
        told = classes.select("node", "first", "copies").join(linked, "node", "left").join(comps, "node", "left").withColumn("component", F.coalesce("component", "node"))
        told = hold(told.select("node", "first", "component", (F.col("copies") - 1 + F.coalesce("linked", F.lit(0))).alias("n_links")))
        told = told.join(told.groupBy(F.col("component").alias("c")).agg(F.min("first").alias("component_id")), F.col("component") == F.col("c")).select("node", "n_links", "component_id")
        of = usable.join(classes.select("vector", "node"), "vector").select("vec_id", "node").distinct()
        of = of.join(told, "node").groupBy("vec_id").agg(F.sum("n_links").alias("n_links"), F.min("component_id").alias("component_id"))
        of = materialise(of, "vectors")
    out = base.select("vec_id").join(of, "vec_id", "left")
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
