"""SimHash near-dedup over pivot distance tables.

The pivots are PIVOTS reference fingerprints. A fingerprint's row in the table holds its Hamming distance to each of
them, kept by BLOCKS blocks of bits; the blocks of a pivot sum to the whole distance. By the triangle inequality
two fingerprints differ, in each block, by at least their largest coordinate difference there.

So if LIMIT = 3 bits differ, at least three of the six blocks are untouched and all their coordinates are equal:
rows meet by an equi-join on the coordinates of each three blocks (a maximum coordinate difference of zero), which spares
any cross join. Among rows that met, a pair goes if a whole distance differs by more than LIMIT, or if
the largest coordinate differences of the blocks sum to more; the exact distance verifies the survivors.

A bucket returns a spanning forest of its verified links, not all its pairs: that has
the same components. Buckets of over BUCKET rows are dealt out as pairs of chunks, which
together hold every pair.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vframe.llm.common import addressed, attach, components, keep_rows, sifted, written

LIMIT = 3
BLOCKS = 6
PIVOTS = 10
BUCKET = 4096
SEED = 42
HASHES_AT_ONCE = 1 << 16


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """The 64-bit SimHash of a whole text, unsigned; zero without words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    count, n = np.zeros(64, np.int64), max(1, len(words) - shingle + 1)
    for at in range(0, n, HASHES_AT_ONCE):
        hashes = [
            xxhash.xxh64_intdigest(b" ".join(words[i : i + shingle]), SEED)
            for i in range(at, min(n, at + HASHES_AT_ONCE))
        ]
        octets = np.array(hashes, "<u8").view(np.uint8).reshape(-1, 8)
        count += np.unpackbits(octets, axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * count > n, bitorder="little").view("<u8")[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column("text")
        prints = np.array([fingerprint(texts[i].as_py()) for i in range(len(texts))], np.uint64)
        yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("id"), pa.array(prints.view(np.int64))], names=["row", "id", "fp"])


def pivots() -> list[int]:
    """The reference fingerprints, by the splitmix64 rule."""
    state, out = 0, []
    for _ in range(PIVOTS):
        state = (state + 0x9E3779B97F4A7C15) % 2**64
        z = (state ^ (state >> 30)) * 0xBF58476D1CE4E5B9 % 2**64
        z = (z ^ (z >> 27)) * 0x94D049BB133111EB % 2**64
        out.append(z ^ (z >> 31))
    return out


def _masks() -> list[int]:
    """The bits of each block."""
    cuts = [round(i * 64 / BLOCKS) for i in range(BLOCKS + 1)]
    return [sum(1 << j for j in range(a, b)) for a, b in zip(cuts, cuts[1:], strict=False)]


def _signed(bits: int) -> int:
    return bits - 2**64 if bits >= 2**63 else bits


def with_distances(prints: DataFrame) -> DataFrame:
    """The pivot distance table: to rows with a fingerprint ``fp``, for each block a long of its distances to the pivots, four bits each."""

    def block(mask: int):
        distances = [F.bit_count(F.col("fp").bitwiseXOR(F.lit(_signed(p))).bitwiseAND(F.lit(_signed(mask)))) for p in pivots()]
        return reduce(lambda a, d: F.shiftleft(a, 4).bitwiseOR(d), distances, F.lit(0).cast("long"))

    return prints.withColumns({f"block{i}": block(mask) for i, mask in enumerate(_masks())})


def _unpacked(blocks: np.ndarray) -> np.ndarray:
    """Distances by row, block and pivot."""
    shifts = 4 * np.arange(PIVOTS - 1, -1, -1)
    return (blocks[:, :, None] >> shifts & 15).astype(np.int8)


def _near(table: np.ndarray, fp: np.ndarray, x: int, rows: np.ndarray) -> np.ndarray:
    """Which of ``rows`` lie within LIMIT bits of row x: by coordinate differences first, the rest by their distance."""
    apart = np.abs(table[rows] - table[x])
    near = (np.abs(table[rows].sum(1) - table[x].sum(0)).max(1) <= LIMIT) & (apart.max(2).sum(1) <= LIMIT)
    near[near] = np.bitwise_count(fp[rows[near]] ^ fp[x]) <= LIMIT
    return near


def _forest(fp: np.ndarray, table: np.ndarray) -> tuple[list[int], list[int]]:
    """Links that span each component of the rows: breadth first, each row found once."""
    seen_from, seen_to = [], []
    rest = np.arange(len(fp))
    while len(rest):
        front, rest = [rest[0]], rest[1:]
        while front and len(rest):
            x = front.pop()
            near = _near(table, fp, x, rest)
            found = rest[near]
            seen_from += [x] * len(found)
            seen_to += found.tolist()
            front += found.tolist()
            rest = rest[~near]
    return seen_from, seen_to


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Verified links of buckets whose rows follow each other; a bucket may span batches."""
    names, held = ("key", "c1", "c2", "fp", *[f"block{i}" for i in range(BLOCKS)]), None

    def done(parts: list[np.ndarray], ends: np.ndarray) -> pa.RecordBatch:
        fp, a, b, at = parts[3].view(np.uint64), [], [], 0
        table = _unpacked(np.stack(parts[4:], 1))
        for end in ends:
            x, y = _forest(fp[at:end], table[at:end])
            a += [parts[3][at + i] for i in x]
            b += [parts[3][at + i] for i in y]
            at = end
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    for batch in batches:
        parts = [np.array(batch.column(n).to_numpy(zero_copy_only=False)) for n in names]
        if held is not None:
            parts = [np.concatenate(x) for x in zip(held, parts, strict=True)]
        if not len(parts[0]):
            continue
        turn = (parts[0][1:] != parts[0][:-1]) | (parts[1][1:] != parts[1][:-1]) | (parts[2][1:] != parts[2][:-1])
        ends = np.flatnonzero(turn) + 1
        if len(ends):
            yield done(parts, ends)
        held = [x[ends[-1] if len(ends) else 0 :] for x in parts]
    if held is not None:
        yield done(held, np.array([len(held[0])]))


def simhash_links(prints: DataFrame) -> DataFrame:
    """Spanning links (a, b) among distinct fingerprints (fp long)."""
    table = with_distances(prints.select("fp"))
    blocks = [f"block{i}" for i in range(BLOCKS)]
    triples = combinations(range(BLOCKS), BLOCKS - LIMIT)
    tagged = F.array(*[F.xxhash64(F.lit(n), *[f"block{i}" for i in t]) for n, t in enumerate(triples)])
    keyed = table.select("fp", *blocks, F.explode(tagged).alias("key"))
    # Counts combine before the shuffle, so a hot key is no task's burden; only rows that meet another go on.
    shared = written(keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"))
    met = sifted(keyed, shared, "key").join(shared, "key")
    dealt = (
        met.withColumn("k", F.ceil(F.col("n") / BUCKET).cast("int"))
        .withColumn("c", F.pmod(F.xxhash64("fp"), F.col("k")).cast("int"))
        .withColumn("j", F.explode(F.sequence(F.lit(0), F.col("k") - 1)))
        .select("key", F.least("c", "j").alias("c1"), F.greatest("c", "j").alias("c2"), "fp", *blocks)
    )
    by = ["key", "c1", "c2"]
    return dealt.repartition(*by).sortWithinPartitions(*by).mapInArrow(_links, "a long, b long")


def _grouped(docs: DataFrame, row: str, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """(row, id, fp) of each document, and (fp, best) of each fingerprint: the least identifier and row of its group, nulls last."""
    source = docs.select(F.col(row).alias("row"), F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    prints = written(source.mapInArrow(_fingerprints, "row struct<file: long, at: long>, id long, fp long"))
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "row")).alias("best")
    distinct = written(prints.groupBy("fp").agg(first))
    found = components(simhash_links(distinct))
    known = distinct.join(found, distinct["fp"] == found["node"], "left").select("fp", F.coalesce("component", "fp").alias("group"), "best")
    best = known.groupBy("group").agg(F.min("best").alias("best"))
    return prints, attach(known.select("fp", "group"), best, "group", "fp").select("fp", "best")


def simhash_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprint every whole text and group what links at LIMIT or fewer bits.

    Returns doc_id, fingerprint (16 hex digits) and component_id (the smallest
    identifier reachable by links), one row for each input row. Null and wordless texts
    have the fingerprint zero and link like any other. Repeated rows give
    repeated results. A row without an identifier takes part by its text
    and has the component of its group, null only if no row of the group
    has an identifier. No rows give no rows; other columns are ignored.
    """
    docs, row = addressed(docs)
    prints, groups = _grouped(docs, row, id_col, text_col)
    return attach(prints, groups, "fp", "row").select(
        F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("best.id").alias("component_id")
    )


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each group, that of its smallest identifier; columns stay as they are.

    Where rows repeat that identifier the first by place stays; a group without identifiers keeps its first row.
    """
    docs, row = addressed(docs)
    _, groups = _grouped(docs, row, id_col, text_col)
    return keep_rows(docs, row, groups.select("best.row").distinct())
