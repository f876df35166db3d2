"""Hierarchical multi-length packing.

Context sizes form tiers: 1024, 512, 256 and so on by powers of two. A document
gives as many whole windows of the top tier as it fills. What is left
over is routed to the smallest tier that holds it and waits there for a fit. A
piece that leaves a gap in its window takes the longest waiting pieces
of its own and shorter tiers that fit (best fit, longest first), cutting the last one
where nothing fits whole. A window that ends up at exactly a power of two is
closed at that size without padding. Step groups are balanced: each holds exactly STEP_TOKENS tokens, so each step of
training costs the same. A tier's windows make groups of their own; what the tiers have left over at the end of a task is dealt
together, longest first, which fills every group but the task's last, as all sizes are powers of two.

Every task packs the documents it reads, batch by batch, and carries what waits on
to its next batch: no shuffle, and at most RESERVE pieces and a step group's windows held for each tier. At its end
the rest is cut into powers of two, so no sequence holds padding.
"""

from __future__ import annotations

import base64
import bisect
import os
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WINDOW = 1024
TIERS = (1024, 512, 256, 128, 64)
#: Tokens of a step group.
STEP_TOKENS = 16 * WINDOW
#: Pieces that wait in each tier of a task for a gap; beyond it the tier closes windows of its own size.
RESERVE = 64
END_ID = 0

PIECES = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, "
    "tier int, step_group long"
)

Piece = tuple[int, int, object, int, np.ndarray]  # length, arrival, document, start, ids


def tier_of(length: int) -> int:
    """The smallest tier that holds ``length`` tokens."""
    return min(t for t in TIERS if t >= length)


def cut(piece: Piece, length: int) -> tuple[Piece, Piece]:
    """The first ``length`` tokens of a piece, and the others."""
    _, arrival, doc, start, ids = piece
    return (
        (length, arrival, doc, start, ids[:length]),
        (len(ids) - length, arrival, doc, start + length, ids[length:].copy()),
    )


class Packer:
    """Packs the documents of one task; ``emit`` gets the pieces of each closed window and its tier."""

    def __init__(self, emit: Callable[[list[Piece], int], None]) -> None:
        self.emit = emit
        self.waiting: dict[int, list[Piece]] = {t: [] for t in TIERS}  # each sorted by length
        self.arrivals = 0

    def add(self, doc: object, ids: np.ndarray) -> None:
        piece: Piece = (len(ids), self.arrivals, doc, 0, ids)
        while piece[0] > WINDOW:
            whole, piece = cut(piece, WINDOW)
            self.emit([whole], WINDOW)
        self._route(piece)
        self.arrivals += 1
        for tier in TIERS:
            while len(self.waiting[tier]) > RESERVE:
                self._close(tier)

    def _route(self, piece: Piece) -> None:
        bisect.insort(self.waiting[tier_of(piece[0])], piece, key=lambda p: p[:2])

    def _fitting(self, gap: int) -> Piece | None:
        """The longest waiting piece that fits a gap whole."""
        for tier in TIERS:
            if tier < 2 * gap:  # longer tiers hold nothing as short
                at = bisect.bisect_right(self.waiting[tier], gap, key=lambda p: p[0])
                if at:
                    return self.waiting[tier].pop(at - 1)
        return None

    def _close(self, tier: int) -> None:
        """Build a window of a tier around its longest piece and fill the gap from its own and shorter tiers."""
        window = [self.waiting[tier].pop()]
        gap = tier - window[0][0]
        while gap:
            piece = self._fitting(gap)
            if piece is None:  # nothing fits whole: cut the shortest piece of this tier
                piece, rest = cut(self.waiting[tier].pop(0), gap)
                self._route(rest)
            window.append(piece)
            gap -= piece[0]
        self.emit(window, tier)

    def finish(self) -> None:
        """Cut what still waits into windows at powers of two."""
        rest = [p for tier in TIERS for p in self.waiting[tier]][::-1]
        left = sum(p[0] for p in rest)
        while left:
            size = gap = min(1 << (left.bit_length() - 1), WINDOW)
            window = []
            while gap:
                piece = rest.pop()
                if piece[0] > gap:
                    piece, later = cut(piece, gap)
                    rest.append(later)
                window.append(piece)
                gap -= piece[0]
            self.emit(window, tier_of(size))
            left -= size
        self.waiting = {t: [] for t in TIERS}


class Steps:
    """Deals windows, which are powers of two, to step groups; ``emit`` gets each window and the number of its group."""

    def __init__(self, emit: Callable[[object, int], None]) -> None:
        self.emit, self.groups = emit, 0
        self.open: dict[int, list[tuple[int, object]]] = {t: [] for t in TIERS}
        self.size = dict.fromkeys(TIERS, 0)

    def _close(self, windows: list[tuple[int, object]]) -> None:
        for _, window in windows:
            self.emit(window, self.groups)
        self.groups += 1

    def add(self, tier: int, size: int, window: object) -> None:
        self.open[tier].append((size, window))
        self.size[tier] += size
        if size == tier and self.size[tier] == STEP_TOKENS:
            self._close(self.open[tier])
            self.open[tier], self.size[tier] = [], 0

    def finish(self) -> None:
        """Deal what the tiers have left over, longest first: each sum of powers of two meets the bound exactly."""
        rest = sorted((w for tier in TIERS for w in self.open[tier]), key=lambda w: -w[0])
        group, total = [], 0
        for size, window in rest:
            group.append((size, window))
            total += size
            if total == STEP_TOKENS:
                self._close(group)
                group, total = [], 0
        if group:
            self._close(group)
        self.open = {t: [] for t in TIERS}


class Encoder:
    """Token ids of whole texts, as ``tokenizers`` gives them for the file at ``tokenizer_path``.

    Where the same vocabulary is at hand as ranks, ``tiktoken`` computes the same ids at a fraction
    of the cost. Texts that hold the string of a special token still go to ``tokenizers``, which
    alone knows those; so do texts with such long runs of white space that the pattern's engine gives them up.
    """

    def __init__(self, tokenizer_path: str, ranks_path: str | None = None, pattern: str | None = None) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(tokenizer_path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.fast = None
        if ranks_path:
            import tiktoken

            with open(ranks_path, "rb") as lines:
                ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
            self.fast = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    def ids(self, text: str) -> np.ndarray:
        """The ids of a text and END_ID."""
        found = None
        if self.fast is not None and not any(s in text for s in self.special):
            try:
                found = self.fast.encode_to_numpy(text, disallowed_special=())
            except ValueError:  # the pattern ran out of stack
                pass
        if found is None:
            found = np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)
        return np.append(found, np.uint32(END_ID))


def pack(
    docs: DataFrame,
    tokenizer_path: str,
    ranks_path: str | None = None,
    pattern: str | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Pack all documents into sequences of at most WINDOW tokens; one row for each piece.

    Returns doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, tier (the
    context size of the sequence) and step_group. A document is its tokens and the
    id END_ID, so null and empty texts are one token. Documents may be cut; every token lies in
    exactly one piece. A row without an identifier is packed under a null
    one, and a repeated row is packed again. Texts of any kind and length are encoded whole, one at a time. No rows give
    no rows; other columns are ignored.
    Sequence numbers are unique: the task's number times 2**33 and a count.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the tasks are the parallelism
        encoder = Encoder(tokenizer_path, ranks_path, pattern)
        base = TaskContext.get().partitionId() << 33
        rows: list[tuple] = []
        state = {"sequence": base}
        tokens: dict[int, int] = {}

        def count(window: list[tuple], group: int) -> None:
            rows.extend((*piece, base + group) for piece in window)

        steps = Steps(count)

        def emit(window: list[Piece], tier: int) -> None:
            offset, pieces = 0, []
            for length, arrival, doc, start, ids in window:
                crc = zlib.crc32(np.ascontiguousarray(ids, "<u4"))
                pieces.append((doc, start, length, crc, tokens[arrival], state["sequence"], offset, tier))
                offset += length
            state["sequence"] += 1
            steps.add(tier, offset, pieces)

        packer = Packer(emit)
        fields = [(x.split()[0], {"long": pa.int64(), "int": pa.int32()}[x.split()[1]]) for x in PIECES.split(", ")]

        def flush() -> pa.RecordBatch:
            columns = list(zip(*rows, strict=True)) or [()] * len(fields)
            batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(columns, fields, strict=True)], names=[n for n, _ in fields])
            rows.clear()
            live = {p[1] for waiting in packer.waiting.values() for p in waiting}
            for gone in [k for k in tokens if k not in live]:
                del tokens[gone]
            return batch

        for batch in batches:
            for doc, text in zip(*batch.columns, strict=True):
                ids = encoder.ids(text.as_py() or "")
                tokens[packer.arrivals] = len(ids)
                packer.add(doc.as_py(), ids)
                if len(rows) >= 4096:
                    yield flush()
        packer.finish()
        steps.finish()
        yield flush()

    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return source.mapInArrow(run, PIECES)
