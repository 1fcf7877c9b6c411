"""Removal of passages of 50 words or more that an earlier document has.

Two passes over the texts. The first fills count-min sketches, one a partition, of window anchors: the anchor of a
50-word window is the smallest hash of its 26 runs of 25 words, so equal windows have equal anchors, and an anchor's
document count bounds the count of each of its windows from above. Sketches merge cell by cell. The second pass keeps
only windows whose anchor the merged sketch estimates in two documents or more, so no repeated window is lost, and
groups them exactly: consecutive windows of one anchor travel as one run, equal runs collapse first, and only anchors
with several different runs are resolved window by window.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loamwork.llm.store import Held, materialise, prepare
from loamwork.llm.text import WORD_POWERS, Piece, grams, mix, pieces, sliding_min

WINDOW, GRAM = 50, 25
#: Rows of the sketch. A row has CELLS cells an anchor or more, 2^LEAST_BITS at least; the merged sketch is one bit a cell and
#: goes to every executor, which is why a row stops at 2^MOST_BITS cells (256 MB a row, made for 20 TB of text): beyond that
#: more windows pass on to the exact stage, and none is lost.
ROWS, CELLS, LEAST_BITS, MOST_BITS = 2, 8, 16, 31
#: Bytes of text that have an anchor, about: 13 words.
ANCHOR_BYTES = 78
_BLOCK_BITS = 16
_SEEDS = np.array([0x5851F42D4C957F2D, 0x14057B7EF767814F], np.uint64)
_LAST = (1 << 63) - 1


def cells(anchors: np.ndarray, width_bits: int) -> list[np.ndarray]:
    return [(mix(anchors ^ s) >> np.uint64(64 - width_bits)).astype(np.int64) for s in _SEEDS[:ROWS]]


def runs(p: Piece) -> tuple[np.ndarray, ...] | None:
    """Runs of consecutive windows of one text with one anchor: (text index, first word in the piece, windows, anchor)."""
    n = len(p.hash)
    if n < WINDOW:
        return None
    anchor = sliding_min(mix(grams(p.hash, GRAM)), WINDOW - GRAM + 1)
    text = np.repeat(np.arange(p.n), p.counts())
    whole = text[: n - WINDOW + 1] == text[WINDOW - 1 :]
    new = np.ones(len(anchor), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (text[1 : len(anchor)] != text[: len(anchor) - 1]) | ~whole[:-1]
    start = np.flatnonzero(new & whole)
    if not len(start):
        return None
    # a run ends before the next beginning or the next window that leaves its text
    stop = np.flatnonzero(np.concatenate([(new | ~whole)[1:], [True]])) + 1
    stop = stop[np.searchsorted(stop, start, side="right")]
    return text[start], start, stop - start, anchor[start]


def _sketch(width_bits: int):
    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The partition's sketch: for each block of cells, those counted once and those counted more."""
        held: list[np.ndarray] = []
        done = np.zeros(0, np.int64)  # cell * 2 + (counted more than once)

        def settle() -> np.ndarray:
            fresh = np.sort(np.concatenate(held)) if held else np.zeros(0, np.int64)
            held.clear()
            cell, count = np.unique(np.concatenate([fresh, done >> 1, done[(done & 1) == 1] >> 1]), return_counts=True)
            return cell * 2 + (count > 1)

        size = 0
        for batch in batches:
            for p in pieces(batch[0]):
                if (found := runs(p)) is None:
                    continue
                text, _, _, anchor = found
                _, one = np.unique(mix(anchor ^ mix(text.astype(np.uint64) + np.uint64(1))), return_index=True)  # once a text
                for row, c in enumerate(cells(anchor[one], width_bits)):
                    held.append(c + (row << width_bits))
                    size += len(c)
            if size > 1_000_000:
                done, size = settle(), 0
        done = settle()
        block = done >> (1 + _BLOCK_BITS)
        edge = np.flatnonzero(np.diff(block, prepend=-1))
        names, once, more = [], [], []
        for a, b in zip(edge, [*edge[1:], len(done)][: len(edge)], strict=True):
            own = done[a:b]
            low = ((own >> 1) & ((1 << _BLOCK_BITS) - 1)).astype(np.uint16)
            names.append(int(block[a]))
            once.append(low[(own & 1) == 0].tobytes())
            more.append(low[(own & 1) == 1].tobytes())
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array(once, pa.binary()), pa.array(more, pa.binary())], names=["block", "once", "more"])

    return build


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Partitions' counts of blocks of cells, sorted by block, added one by one: a bit for each cell that reaches two.
    What is held is the counts of one block, however many partitions the sketches come from."""
    total, at = np.zeros(1 << _BLOCK_BITS, np.uint8), None

    def done() -> pa.RecordBatch:
        bits = np.packbits(total > 1, bitorder="little").tobytes()
        total[:] = 0
        return pa.RecordBatch.from_arrays([pa.array([at], pa.int64()), pa.array([bits], pa.binary())], names=["block", "bits"])

    for batch in batches:
        for block, once, more in zip(batch.column("block").to_pylist(), batch.column("once"), batch.column("more"), strict=True):
            if at is not None and block != at:
                yield done()
            at = block
            cell = np.frombuffer(once.as_buffer(), np.uint16)
            total[cell] = np.minimum(total[cell], 1) + 1
            total[np.frombuffer(more.as_buffer(), np.uint16)] = 2
    if at is not None:
        yield done()


def width_for(docs: DataFrame) -> int:
    """Bits of a cell's number, from the bytes of all texts."""
    size = docs.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    return min(MOST_BITS, max(LEAST_BITS, (CELLS * size // ANCHOR_BYTES).bit_length()))


def repeated_cells(docs: DataFrame, width_bits: int) -> np.ndarray:
    """The merged sketch as one bit a cell: estimated in two documents or more. ROWS * 2^width_bits bits come to the driver."""
    parts = docs.select("text").mapInArrow(_sketch(width_bits), "block long, once binary, more binary")
    merged = parts.repartition("block").sortWithinPartitions("block").mapInArrow(_merge, "block long, bits binary")
    bits = np.zeros(ROWS << (width_bits - 3), np.uint8)
    step = 1 << (_BLOCK_BITS - 3)
    for r in merged.toLocalIterator():
        bits[r["block"] * step : (r["block"] + 1) * step] = np.frombuffer(r["bits"], np.uint8)
    return bits


RUN = "doc long, tid long, v long, k long, start int, n int, w array<long>"


def candidate_runs(docs: DataFrame, bits: np.ndarray, width_bits: int) -> DataFrame:
    """Runs whose anchor is estimated repeated, with a hash k of the run's words and w, one of each window's."""
    sketch = docs.sparkSession.sparkContext.broadcast(bits)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        twice = sketch.value
        for batch in batches:
            doc, tid = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            for p in pieces(batch[2]):
                if (found := runs(p)) is None:
                    continue
                text, start, n, anchor = found
                keep = np.ones(len(anchor), bool)
                for row, c in enumerate(cells(anchor, width_bits)):
                    c = c + (row << width_bits)
                    keep &= (twice[c >> 3] >> (c & 7).astype(np.uint8)) & 1 == 1
                text, start, n, anchor = text[keep], start[keep], n[keep], anchor[keep]
                if not len(start):
                    continue
                up, down = WORD_POWERS.upto(len(p.hash) + 1)
                sums = np.zeros(len(p.hash) + 1, np.uint64)
                np.cumsum(p.hash * up[: len(p.hash)], out=sums[1:])
                run = mix((sums[start + n + WINDOW - 1] - sums[start]) * down[start] + n.astype(np.uint64) * _SEEDS[0])
                offsets = np.concatenate([[0], np.cumsum(n)])
                at = np.repeat(start - offsets[:-1], n) + np.arange(offsets[-1])
                window = mix((sums[at + WINDOW] - sums[at]) * down[at])
                listed = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(window.view(np.int64)))
                own = p.row + text
                made = [pa.array(doc[own]), pa.array(tid[own]), pa.array(anchor.view(np.int64)), pa.array(run.view(np.int64)), pa.array((start - p.first[text]).astype(np.int32)), pa.array(n.astype(np.int32)), listed]
                yield pa.RecordBatch.from_arrays(made, names=[x.split()[0] for x in RUN.split(", ")])

    return docs.select("doc", "tid", "text").mapInArrow(emit, RUN)


def removed_runs(docs: DataFrame, width_bits: int, hold: Held) -> DataFrame:
    """(doc, tid, text) -> (doc, tid, runs array of (start, n)): first windows of the runs to remove, by document.

    Tables of one row a repeated run or window are joined as tables of their own, the same way at every size: AQE can then
    split the rows of a passage that very many documents share, which never meet in one task.
    """
    found = materialise(candidate_runs(docs, repeated_cells(docs, width_bits), width_bits), "runs")
    same = hold(found.groupBy("v", "k").agg(F.min("doc").alias("least"), F.max("doc").alias("most")))
    several = same.groupBy("v").agg(F.count("*").alias("kinds")).filter("kinds > 1").select("v", F.lit(True).alias("several"))
    told = materialise(same.join(several, "v", "left").filter("several or least < most").withColumn("several", F.coalesce("several", F.lit(False))), "repeated")
    # all of a run in a later document goes; the first document's windows may still lie in another run of the anchor
    whole = F.array(F.struct(F.lit(None).cast("long").alias("h"), F.col("start").alias("start"), F.col("n").alias("n")))
    each = F.transform("w", lambda x, i: F.struct(x.alias("h"), (F.col("start") + i).alias("start"), F.lit(1).alias("n")))
    part = F.when(F.col("doc") > F.col("least"), whole).when(F.col("several"), each)
    laid = found.join(told.hint("merge"), ["v", "k"]).select("doc", "tid", "v", F.explode(part).alias("x")).select("doc", "tid", "v", "x.*")
    laid = hold(laid)
    single = laid.filter("h is not null")
    least = hold(single.groupBy("v", "h").agg(F.min("doc").alias("least"), F.max("doc").alias("most")).filter("least < most").select("v", "h", "least"))
    later = single.join(least.hint("merge"), ["v", "h"]).filter("doc > least")
    cover = laid.filter("h is null").select("doc", "tid", "start", "n").union(later.select("doc", "tid", "start", "n"))
    # as many entries as the document has words, at most
    return cover.groupBy("doc", "tid").agg(F.collect_set(F.struct("start", "n")).alias("runs"))


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        runs = batch.column("runs")
        at = runs.offsets.to_numpy() - runs.offsets[0].as_py()
        start, n = (runs.flatten().field(k).to_numpy().astype(np.int64) for k in ("start", "n"))
        total, gone, kept = [], [], []
        for i, text in enumerate(batch.column("text")):
            words = (text.as_py() or "").encode().split()
            total.append(len(words))
            if at[i + 1] > at[i]:
                own = slice(at[i], at[i + 1])
                edge = np.zeros(len(words) + 1, np.int64)
                np.add.at(edge, start[own], 1)
                np.add.at(edge, start[own] + n[own] + WINDOW - 1, -1)
                words = list(itertools.compress(words, (np.cumsum(edge)[:-1] == 0).tolist()))
            gone.append(total[-1] - len(words))
            kept.append(b" ".join(words))
        made = [pa.array(total, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *made], names=["doc_id", "n_words", "n_removed", "kept_text"])


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width_bits: int | None = None) -> DataFrame:
    """Per row: doc_id, n_words, n_removed, kept_text (kept words joined by one space).

    A word goes if a 50-word window over it has a word sequence that also starts in a document of a smaller id; windows
    are judged on the input. Words are runs of other than ASCII white space, unchanged. Null or short texts lose nothing;
    a null id counts as 2^63 - 1; rows with equal ids are none of them the smaller; an empty table gives no rows.

    Two windows are taken as equal if a 64-bit anchor and a 64-bit hash of theirs are. Both come from 64-bit hashes of the
    words, polynomials modulo 2^64 mixed once more, which texts made for it (Thue-Morse words of 1,024 characters) can
    bring to collide; others do so with the probability that random numbers have. width_bits: of the sketch's cells, by
    default from the bytes of the texts.
    """
    prepare(docs.sparkSession)
    base = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    base = base.withColumn("doc", F.coalesce("doc_id", F.lit(_LAST))).withColumn("tid", F.xxhash64(F.coalesce("text", F.lit(""))))
    keyed = base.select("doc", "tid", "text")
    with Held() as hold:
        cover = materialise(removed_runs(keyed, width_bits or width_for(keyed), hold), "cover")
    joined = base.join(cover.hint("merge"), ["doc", "tid"], "left")
    return joined.select("doc_id", "text", "runs").mapInArrow(_cut, "doc_id long, n_words long, n_removed long, kept_text string")


def digest(kept: Column) -> Column:
    return F.sha2(F.encode(kept, "UTF-8"), 256)
