"""Exact dedup by a tree-merge of sorted digest runs.

Every document becomes a digest entry. A task sorts its entries into runs, cuts them by their
destination and folds entries of equal digest to one that carries the identifier to retain and the
number of documents. Partitions are numbered in binary, and in binomial round r a partition swaps entries with the one
whose number differs in bit r alone: each entry goes to the side that bit r of its digest names. After the last round all
entries of a digest have met, and partition and digest agree.

A shuffle costs more than a merge, so ROUNDS rounds share one: a partition sends a run straight to each of the 2**ROUNDS partitions
that these rounds reach, and the receiver merges what it gets as the rounds would, two runs at a time in a binomial
tree, folding and verifying at every level. Copies fold where they first meet, so a group of any size sends one entry for each partition and
round. Runs travel as sorted slices of the digest's range, and a slice is merged at a time, so a task
holds its fan-in of slices and never a partition. A 64-bit digest orders the runs; SHA-256 and the byte length
verify each fold.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vframe.llm.common import addressed, ascii_lower, attach, discard, keep_rows, width, written

#: Binomial rounds that share a shuffle.
ROUNDS = 3
#: Entries that a task sorts into one run, and entries that a slice of a merged run should have.
RUN, SLICE = 1 << 17, 1 << 13
#: A slice of a sorted run on its way to a partition.
CHUNK = "addr int, slice int, entries binary"
#: An entry: digest, whether and which identifier is retained, its row, and the number of documents.
ENTRY = np.dtype([("key", "<u8"), ("sha", "<u8", 4), ("bytes", "<i8"), ("none", "<i8"), ("id", "<i8"), ("file", "<i8"), ("at", "<i8"), ("n", "<i8")])
_ENTRIES = "key long, sha binary, bytes long, id long, file long, at long"
_WHOLE = "key long, sha binary, bytes long, keep long, file long, at long, size long"


def folded(entries: np.ndarray) -> np.ndarray:
    """Entries in order of their digest, those of equal digest folded: the smallest identifier (none comes last) and row, the sum of n."""
    entries = entries[entries["key"].argsort(kind="stable")]  # merges runs that are sorted already
    twin = entries["key"][1:] == entries["key"][:-1]
    if not twin.any():
        return entries
    tied = np.flatnonzero(np.r_[twin, False] | np.r_[False, twin])
    some = entries[tied]
    order = np.lexsort([some[c] for c in ("at", "file", "id", "none", "bytes")] + [some["sha"][:, i] for i in range(4)] + [some["key"]])
    entries[tied] = some[order]
    same = twin & (entries["bytes"][1:] == entries["bytes"][:-1]) & (entries["sha"][1:] == entries["sha"][:-1]).all(1)
    starts = np.flatnonzero(np.r_[True, ~same])
    out = entries[starts]
    out["n"] = np.add.reduceat(entries["n"], starts)
    return out


def merged(runs: list[np.ndarray]) -> np.ndarray:
    """Sorted runs merged pair by pair, as the rounds that share a shuffle would."""
    while len(runs) > 1:
        runs = [folded(np.concatenate(runs[i : i + 2])) for i in range(0, len(runs), 2)]
    return runs[0]


def _chunks(run: np.ndarray, addr: np.ndarray, slices: int) -> pa.RecordBatch:
    """A sorted run cut by the partitions its entries go to and by slice; the upper bits of the digest number the slices."""
    shift = np.uint64(64 - (slices.bit_length() - 1))
    part = (run["key"] >> shift).astype(np.int64) if slices > 1 else np.zeros(len(run), np.int64)
    order = np.lexsort([part, addr])  # stable: the digests stay in order
    run, addr, part = run[order], addr[order], part[order]
    starts = np.flatnonzero(np.r_[True, (addr[1:] != addr[:-1]) | (part[1:] != part[:-1])]) if len(run) else np.zeros(0, int)
    blobs = [run[a:b].tobytes() for a, b in zip(starts, np.r_[starts[1:], len(run)], strict=True)]
    columns = [pa.array(addr[starts], pa.int32()), pa.array(part[starts], pa.int32()), pa.array(blobs, pa.binary())]
    return pa.RecordBatch.from_arrays(columns, names=["addr", "slice", "entries"])


def _onward(run: np.ndarray, addr: np.ndarray | int, first: int, bits: int) -> np.ndarray:
    """Where entries go in the rounds from ``first``: those bits of the address become the digest's."""
    mask = ((1 << min(ROUNDS, bits - first)) - 1) << first
    return (addr & ~mask) | ((run["key"] & np.uint64(mask)).astype(np.int64))


def _tree(entries: DataFrame, bits: int, slices: int) -> DataFrame:
    """One row (_WHOLE) for each digest, from entries with their partition ``addr``."""

    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, addrs, n = [], [], 0

        def run() -> pa.RecordBatch:
            both, at = np.concatenate(held), np.concatenate(addrs)
            out = [(folded(both[at == a]), a) for a in np.unique(at)]
            run = np.concatenate([r for r, _ in out])
            return _chunks(run, _onward(run, np.repeat([a for _, a in out], [len(r) for r, _ in out]), 0, bits), slices)

        for batch in batches:
            fresh = np.zeros(batch.num_rows, ENTRY)
            for name in ("key", "bytes", "file", "at"):
                fresh[name] = batch.column(name).to_numpy().view(ENTRY[name])
            sha = batch.column("sha").cast(pa.binary(32))
            fresh["sha"] = np.frombuffer(sha.buffers()[1], ">u8")[4 * sha.offset :][: 4 * len(sha)].reshape(-1, 4)
            ids = batch.column("id")
            fresh["none"], fresh["id"], fresh["n"] = ids.is_null().to_numpy(zero_copy_only=False), ids.fill_null(0).to_numpy(), 1
            held.append(fresh), addrs.append(batch.column("addr").to_numpy())
            n += len(fresh)
            if n >= RUN:
                yield run()
                held, addrs, n = [], [], 0
        if n:
            yield run()

    def merge(first: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            at, runs = None, []

            def done() -> pa.RecordBatch:
                whole = merged(runs)
                if first < bits:
                    return _chunks(whole, _onward(whole, at[0], first, bits), slices)
                keep = pa.array(whole["id"], pa.int64(), mask=whole["none"] > 0)
                sha = pa.array([x.tobytes() for x in whole["sha"].astype(">u8")], pa.binary())
                columns = [pa.array(whole["key"].view("<i8")), sha, pa.array(whole["bytes"]), keep, *[pa.array(whole[c]) for c in ("file", "at", "n")]]
                return pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in _WHOLE.split(", ")])

            for batch in batches:
                for addr, part, blob in zip(*[batch.column(c) for c in ("addr", "slice", "entries")], strict=True):
                    here = (addr.as_py(), part.as_py())
                    if runs and here != at:
                        yield done()
                        runs = []
                    at = here
                    runs.append(np.frombuffer(blob.as_py(), ENTRY))
            if runs:
                yield done()

        return run

    chunks, first = entries.mapInArrow(sort, CHUNK), 0
    while True:
        first += min(ROUNDS, bits - first)
        met = chunks.repartition(1 << bits, "addr").sortWithinPartitions("addr", "slice")
        chunks = met.mapInArrow(merge(first), CHUNK if first < bits else _WHOLE)
        if first == bits:
            return chunks


def _entries(docs: DataFrame, row: str, id_col: str, text_col: str, sign: int) -> tuple[DataFrame, DataFrame]:
    """The entry of each row, and the folded ones of each digest; identifiers times ``sign``."""
    bits = max(1, (width(docs.sparkSession) - 1).bit_length())
    text = ascii_lower(F.coalesce(F.col(text_col), F.lit("")))
    read = docs.select((F.col(id_col).cast("long") * sign).alias("id"), text.alias("t"), F.col(row).alias("row"))
    entries = written(
        read.select(
            F.pmod(F.spark_partition_id(), F.lit(1 << bits)).alias("addr"),
            F.xxhash64("t").alias("key"),
            F.unhex(F.sha2("t", 256)).alias("sha"),
            F.octet_length("t").cast("long").alias("bytes"),
            "id",
            F.col("row.file").alias("file"),
            F.col("row.at").alias("at"),
        )
    )
    slices = 1 << max(0, (entries.count() // (SLICE << bits)).bit_length())
    return entries, _tree(entries, bits, slices)


def exact_dedup(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest"
) -> DataFrame:
    """Group documents of equal text (A-Z lower-cased) and choose the one that stays.

    Returns doc_id, keep_id, group_size, kept and text_sha256, one row for each
    input row. ``keep`` is "smallest" or "largest" identifier. Null texts count as
    empty, and empty texts are equal to each other. Rows that repeat the identifier that stays with the
    same text all say kept, as the answer is by identifier; :func:`drop_copies` keeps one of them. A row without an
    identifier is counted and never kept unless its whole group has none. No rows give no rows;
    other columns are ignored.
    """
    sign = {"smallest": 1, "largest": -1}[keep]
    docs, row = addressed(docs)
    entries, whole = _entries(docs, row, id_col, text_col, sign)
    digest = ["key", "sha", "bytes"]
    out = attach(entries.select("addr", *digest, "id"), whole.select(*digest, "keep", "size"), digest, "addr")
    return out.select(
        (F.col("id") * sign).alias("doc_id"),
        (F.col("keep") * sign).alias("keep_id"),
        F.col("size").alias("group_size"),
        F.col("id").eqNullSafe(F.col("keep")).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
    )


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "largest") -> DataFrame:
    """One row of each set of equal texts, that of the identifier which :func:`exact_dedup` keeps; columns stay as they are.

    Where rows repeat that identifier too, the first by place stays; a set without identifiers keeps its first row.
    """
    docs, row = addressed(docs)
    entries, whole = _entries(docs, row, id_col, text_col, {"smallest": 1, "largest": -1}[keep])
    kept = written(whole.select(F.struct("file", "at").alias("row")))
    discard(entries)
    return keep_rows(docs, row, kept)
