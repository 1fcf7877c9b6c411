"""Mixing sources to target weights by Pfair scheduling.

Each source's documents form blocks. A source of weight w gives its i-th block the release time floor(i / w) and the
deadline ceil((i + 1) / w); earliest deadline first then fills one slot after another, and at any time a source is
within one block of its share (Baruah et al. 1996). The weights are taken as the exact ratios that they are, and the
period is their common denominator, so no rounding adds up however long the mix. The driver works out a phase or a
period, whichever is shorter, and every block finds its slot by its source and number: eight bytes a block.
"""

from __future__ import annotations

import bisect
import heapq
import math
from array import array
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loamwork.llm.store import BROADCAST_BYTES, bounded, materialise

#: Documents of a source that are ordered in one task.
BUCKET_ROWS = 2_000
#: Blocks of a source whose slots travel in one row.
CHUNK = 256
#: Bound on a common denominator; weights that need a larger one are taken to this many parts of their sum.
MOST_PARTS = 1 << 62


class Slots:
    """A source's slots over a period, worked out as far as its phase goes; len() is their number over the whole period."""

    def __init__(self, share: int):
        self.share, self.known = share, array("q")

    def __len__(self) -> int:
        return self.share

    def __getitem__(self, i: int) -> int:
        return self.known[i]


@dataclass(frozen=True)
class Phase:
    """From start_slot on, source's blocks from first to last (exclusive) lie at slots[i % a] + (i // a) * period, i counted
    from first; a, the number of slots, is exactly the source's weight of the period."""

    source: str
    first: int
    last: int
    start_slot: int
    period: int
    slots: Slots


def whole_shares(weights: dict[str, float]) -> dict[str, int]:
    """The least integers in the exact ratios of the weights; only where their sum passes MOST_PARTS, the nearest below it."""
    exact = {s: Fraction(w) for s, w in weights.items()}
    total = sum(exact.values())
    scale = math.lcm(*(x.denominator for x in exact.values()))
    whole = {s: int(x * scale) for s, x in exact.items()}
    if sum(whole.values()) > MOST_PARTS:
        whole = {s: max(1, math.floor(x / total * (MOST_PARTS - len(exact)))) for s, x in exact.items()}
    least = math.gcd(*whole.values())
    return {s: n // least for s, n in whole.items()}


def hyperperiod(shares: dict[str, int], blocks: dict[str, int]) -> tuple[dict[str, Slots], int]:
    """Slots of each source's blocks, by earliest deadline among the released, over one period or until a source has no
    block left, and how many slots that are."""
    period = sum(shares.values())
    slots = {s: Slots(n) for s, n in shares.items()}
    waiting: list[tuple[int, str]] = []  # next releases; the first blocks are released at once
    ready = [(-(-period // n), s) for s, n in shares.items()]
    heapq.heapify(ready)
    t, over = 0, False
    while t < period and not over:
        while waiting and waiting[0][0] <= t:
            _, s = heapq.heappop(waiting)
            heapq.heappush(ready, (-(-(len(slots[s].known) + 1) * period // shares[s]), s))
        deadline, s = heapq.heappop(ready)
        assert t < deadline, "an earliest-deadline schedule of full use misses no deadline"
        known = slots[s].known
        known.append(t)
        t += 1
        over = len(known) == blocks[s]
        if len(known) < shares[s]:
            heapq.heappush(waiting, (len(known) * period // shares[s], s))
    return slots, t


def schedule(blocks: dict[str, int], weights: dict[str, float]) -> list[Phase]:
    """The phases of a mix that ends when every block has its slot.

    When a source runs out, the others' weights are scaled up to one and a new phase begins; within each phase every
    source stays within one block of its share.
    """
    left = {s: n for s, n in sorted(blocks.items()) if n > 0}
    done, slot, out = dict.fromkeys(left, 0), 0, []
    whole = whole_shares({s: weights[s] for s in left}) if left else {}
    while left:
        least = math.gcd(*(whole[s] for s in left))
        shares = {s: whole[s] // least for s in left}
        period = sum(shares.values())
        slots, length = hyperperiod(shares, left)
        if all(len(slots[s].known) < n for s, n in left.items()):  # a whole period, which repeats
            length = min((n - 1) // shares[s] * period + slots[s][(n - 1) % shares[s]] + 1 for s, n in left.items())
        rounds, rest = divmod(length, period)
        for s in left:
            if n := rounds * shares[s] + bisect.bisect_left(slots[s].known, rest):
                out.append(Phase(s, done[s], done[s] + n, slot, period, slots[s]))
                done[s] += n
                left[s] -= n
        left = {s: n for s, n in left.items() if n}
        slot += length
    return out


def slot_table(phases: list[Phase]) -> pa.Table:
    """(mix_key, mix_chunk, mix_slots): the slots of a source's blocks from mix_chunk * CHUNK on, CHUNK a row at most."""
    own: dict[str, list[np.ndarray]] = {}
    for p in phases:
        if p.last > p.first:
            i, known = np.arange(p.last - p.first), np.asarray(p.slots.known)
            own.setdefault(p.source, []).append(p.start_slot + (known[i % p.slots.share] + i // p.slots.share * p.period))
    keys, chunks, slots = [], [], []
    for s, parts in own.items():
        whole = np.concatenate(parts)
        for k in range(0, len(whole), CHUNK):
            keys.append(s), chunks.append(k // CHUNK), slots.append(whole[k : k + CHUNK])
    schema = pa.schema([("mix_key", pa.string()), ("mix_chunk", pa.int64()), ("mix_slots", pa.list_(pa.int64()))])
    return pa.table([pa.array(keys, pa.string()), pa.array(chunks, pa.int64()), pa.array(slots, pa.list_(pa.int64()))], schema=schema)


def target_weights(counts: dict[str, int], temperature: float = 0.5) -> dict[str, float]:
    """Shares proportional to each source's size to the power of the temperature."""
    return {s: n**temperature for s, n in counts.items()}


def _placed(docs: DataFrame, block: int, weights: dict[str | None, float] | None, source: str, doc_id: str) -> tuple[DataFrame, int]:
    """The rows of mix(), and the number of slots."""
    spark = docs.sparkSession
    key = F.when(F.col(source).isNull(), F.lit("n")).otherwise(F.concat(F.lit("s"), F.col(source).cast("string")))
    # a row a source, of which there are no more than blocks
    counted = docs.groupBy(key.alias("k")).agg(F.count("*").alias("n"), F.count_if(F.col(doc_id).isNull()).alias("without")).collect()
    counts = {r["k"]: r["n"] for r in counted}
    share = target_weights(counts) if weights is None else {k: weights.get(None if k == "n" else k[1:], 0) for k in counts}
    if any(not w > 0 for w in share.values()):
        raise ValueError("every source needs a weight above 0")
    sizes = [(k, max(1, -(-n // BUCKET_ROWS))) for k, n in counts.items()]
    buckets = spark.createDataFrame(sizes, "mix_key string, mix_buckets int")
    # the row travels as one struct, so that its columns may have any names
    kept = [c for c in docs.columns if c not in ("mix_slot", "mix_offset", "mix_position")]
    hashed = [F.col(f"`{c}`") for c in kept if not any(x in docs.schema[c].dataType.simpleString() for x in ("map<", "variant"))]
    tie = F.xxhash64(*hashed) if hashed else F.lit(0).cast("long")
    bucket = F.xxhash64(F.col(doc_id))
    if any(r["without"] for r in counted):  # rows without an id are told apart, and spread, by what they hold
        bucket = F.when(F.col(doc_id).isNull(), tie).otherwise(bucket)
    keyed = docs.select(F.struct(*(F.col(f"`{c}`") for c in kept)).alias("mix_row"), F.col(doc_id).alias("mix_id"), tie.alias("mix_tie"), bucket.alias("mix_hash"), key.alias("mix_key")).join(bounded(buckets), "mix_key")
    keyed = keyed.withColumn("mix_bucket", F.pmod("mix_hash", F.col("mix_buckets")).cast("int")).drop("mix_buckets", "mix_hash")
    held = keyed.groupBy("mix_key", "mix_bucket").count()
    before = Window.partitionBy("mix_key").orderBy("mix_bucket").rowsBetween(Window.unboundedPreceding, -1)
    # a row a bucket: BUCKET_ROWS times fewer than the input
    offsets = materialise(held.select("mix_key", "mix_bucket", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("mix_before")), "offsets")
    within = Window.partitionBy("mix_key", "mix_bucket").orderBy("mix_id", "mix_tie")
    ranked = keyed.withColumn("mix_rank", F.row_number().over(within) - 1)
    placed = ranked.join(bounded(offsets), ["mix_key", "mix_bucket"]).withColumn("mix_index", F.col("mix_before") + F.col("mix_rank"))
    phases = schedule({k: -(-n // block) for k, n in counts.items()}, share)
    placed = placed.withColumn("mix_block", F.floor(F.col("mix_index") / block).cast("long"))
    placed = placed.withColumn("mix_chunk", F.floor(F.col("mix_block") / CHUNK).cast("long"))
    slots = sum(p.last - p.first for p in phases)
    table = spark.createDataFrame(slot_table(phases))
    table = F.broadcast(table) if 8 * slots <= BROADCAST_BYTES else table.hint("merge")
    placed = placed.join(table, ["mix_key", "mix_chunk"])
    slot = F.element_at("mix_slots", (F.col("mix_block") % CHUNK + 1).cast("int"))
    out = placed.withColumn("mix_slot", slot.cast("long")).withColumn("mix_offset", F.col("mix_index") % block)
    out = out.withColumn("mix_position", F.col("mix_slot") * block + F.col("mix_offset"))
    return out.select("mix_row.*", "mix_slot", "mix_offset", "mix_position"), slots


def mix(docs: DataFrame, block: int = 64, weights: dict[str | None, float] | None = None, source: str = "source", doc_id: str = "doc_id") -> DataFrame:
    """docs with mix_slot, mix_offset (place in the block) and mix_position = mix_slot * block + mix_offset.

    Order within a source: by a hash bucket of the id, then id, then a hash of the row; each bucket holds about BUCKET_ROWS
    rows, so that a source with a third of all rows is ordered by many tasks. Every row has a place, no place two rows; a
    source's last block may be short and leaves a gap. A null source is a source of its own; rows without an id lie in
    buckets by a hash of what they hold; rows with equal ids lie beside each other, in the order of that hash, and only rows
    equal in all but map columns are interchangeable. weights: by source name, None for null; default the square root of
    its rows. Columns of docs that are called mix_slot, mix_offset or mix_position give way. Any number of sources; the
    driver holds eight bytes a block, and works out a phase for each source that runs out. A missing or non-positive weight
    is an error; an empty table gives no rows.
    """
    return _placed(docs, block, weights, source, doc_id)[0]


def mix_in_order(docs: DataFrame, rows_per_file: int = 20_000, block: int = 64, weights: dict[str | None, float] | None = None, source: str = "source", doc_id: str = "doc_id") -> DataFrame:
    """The rows of mix() in the order of their positions: part files, and the rows of each, follow the schedule.

    Positions have no gaps but in sources' last blocks, so a position names its part: no sampling and no second look at the rows.
    """
    placed, slots = _placed(docs, block, weights, source, doc_id)
    parts = max(1, -(-slots * block // rows_per_file))
    return placed.repartitionById(parts, F.floor(F.col("mix_position") / rows_per_file).cast("int")).sortWithinPartitions("mix_position")
