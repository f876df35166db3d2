"""Toxicity by noisy-channel deobfuscation.

A writer who hides a word sends it through a noisy channel: letters become look-alike
signs, are spaced out or repeated. Each suspicious token becomes a lattice
whose arcs say which letters a sign may stand for, that a separator may stand for
nothing and that a run of one letter may stand for one or two. Viterbi
decoding finds the likeliest path under a character trigram model times the
channel's costs. The restored text is what the score reads.

The character model counts the trigrams of every document (its table is
bounded by the alphabet: 28 cubed). The score's lexicon is fitted on a bounded sample of
labelled rows: words and word beginnings or endings whose share of toxic documents is high by
a lower confidence bound. A text scores by noisy-or over its words.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator, Mapping
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vframe.llm.common import discard, written

#: Labelled rows that the lexicon is fitted on, at most; a documented bound. The sample is uniform, so that it
#: keeps the share of toxic rows, which the bounds below are about.
SAMPLE = 24_000
#: Entries of the lexicon, at most; those of the highest bound stay.
LEXICON = 8_192
#: Normal deviate of the lower confidence bound, and the share it has to exceed.
DEVIATE, LEAST_SHARE = 2.33, 0.5
#: From this score on a document counts as toxic.
THRESHOLD = 0.7

# What a sign may stand for in obfuscated text.
LOOKALIKE = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "<": "c", "{": "c", "€": "e", "£": "l",
}
SEPARATORS = " \t.-_*~'"
#: Log costs of the channel: a sign for a letter, a separator or a repeated letter for nothing.
SIGN_COST, GAP_COST, REPEAT_COST, KEEP_COST = -1.0, -0.5, -0.7, -9.0

#: Words whose readings, weights or counts a task remembers; beyond it the memory starts anew.
REMEMBERED = 50_000
#: Steps of a lattice after which settled readings are said.
SETTLE = 1024
#: Lengths of the lexicon's words that are looked for inside a spaced run.
SHORTEST, LONGEST = 3, 24

ALPHABET = 28  # 0: outside a word, 1 to 26: a to z, 27: any other byte of a word
_CLASS = np.full(256, 27, np.uint8)
_CLASS[:128] = 0
_CLASS[97:123] = np.arange(1, 27)
_CLASS[65:91] = np.arange(1, 27)

_SIGNS = re.escape("".join(LOOKALIKE))
#: Letters apart: four or more single signs between separators.
SPACED = re.compile(rf"(?<!\S)[^\W_](?:[ \t.\-_*~']{{1,3}}[a-z{_SIGNS}]){{3,}}(?!\S)")
#: In a word that isn't a plain number: a sign, letters parted by separators, or a doubled letter.
ODD = re.compile(rf"(?![\d.,:+\-()]+$)(?:.*[{_SIGNS}]|.*[a-z][*.\-_~']+[a-z]|.*([a-z])\1)", re.S)
_RUN = re.compile(r"(.)\1*", re.S)


@dataclass(frozen=True)
class CharModel:
    """Log probabilities of a character class after two others."""

    table: np.ndarray

    @cached_property
    def flat(self) -> list[float]:
        """The table as plain numbers, which are quicker one by one."""
        return self.table.ravel().tolist()

    @classmethod
    def of(cls, counts: np.ndarray) -> CharModel:
        """Witten-Bell-like mix of the trigram, bigram and unigram shares."""
        c3 = counts.reshape(ALPHABET, ALPHABET, ALPHABET).astype(float)
        c2, c1 = c3.sum(0), c3.sum((0, 1))
        p1 = (c1 + 1) / (c1.sum() + ALPHABET)
        kinds = (c2 > 0).sum(1, keepdims=True)
        p2 = (c2 + (kinds + 1) * p1) / (c2.sum(1, keepdims=True) + kinds + 1)
        kinds = (c3 > 0).sum(2, keepdims=True)
        p3 = (c3 + (kinds + 1) * p2) / (c3.sum(2, keepdims=True) + kinds + 1)
        return cls(np.log(p3))


def _arcs_of(run: str, spaced: bool) -> list[tuple[str, float]]:
    """The strings that a run of one sign may stand for with log costs. In a spaced run a separator may also part words."""
    sign, n = run[0], len(run)
    if sign in SEPARATORS:
        return [("", GAP_COST), (" ", GAP_COST)] if spaced else [("", GAP_COST), (run, KEEP_COST)]
    letters = [(x, 0.0) for x in sign if x.isalpha()] or [(x, SIGN_COST) for x in LOOKALIKE.get(sign, "")]
    if not letters:
        return [("", GAP_COST + KEEP_COST), (run, KEEP_COST)]
    arcs = [(x, cost + (REPEAT_COST if n > 1 else 0)) for x, cost in letters]
    if n > 1:
        arcs += [(2 * x, 2 * cost + (REPEAT_COST if n > 2 else 0)) for x, cost in letters]
    return arcs


def _arcs(token: str, spaced: bool = False) -> Iterator[list[tuple[str, float]]]:
    """The lattice of a token: the arcs of each run of one sign."""
    return (_arcs_of(match[0], spaced) for match in _RUN.finditer(token))


def _class_of(letter: str) -> int:
    return ord(letter) - 96 if "a" <= letter <= "z" else 27 if letter.isalpha() else 0


Arc = tuple[str, float, tuple[int, ...]]
_known: dict[tuple[str, bool], list[Arc]] = {}


def _classed(run: str, spaced: bool) -> list[Arc]:
    """Arcs with the classes of their letters; those of short runs are remembered."""
    arcs = [(said, cost, tuple(map(_class_of, said))) for said, cost in _arcs_of(run, spaced)]
    if len(run) < 5 and len(_known) < REMEMBERED:
        _known[run, spaced] = arcs
    return arcs


State = int  # the classes of the last two letters, as one number
Trail = list[dict[State, tuple[State, str]]]  # for each step: where a state came from and what was said


def _said(trail: Trail, state: State) -> str:
    out = []
    for came in reversed(trail):
        state, letters = came[state]
        out.append(letters)
    return "".join(reversed(out))


def decode(token: str, model: CharModel, spaced: bool = False) -> str:
    """The likeliest plain reading of a token: Viterbi over its lattice, a state per last two classes.

    Each state points back to the one it came from. As soon as one state is left, and after each SETTLE steps, what all paths that are left have in
    common is said and forgotten, so a token of any length takes time in proportion.
    """
    flat = model.flat
    out: list[str] = []
    state, cost = 0, 0.0  # the one path, where there is one
    costs: dict[State, float] | None = None  # else the paths by their state
    trail: Trail = []
    for match in _RUN.finditer(token):
        run = match[0]
        arcs = _known.get((run, spaced)) or _classed(run, spaced)
        if costs is None:
            if len(arcs) == 1 and len(arcs[0][2]) == 1:
                letters, price, classes = arcs[0]
                at = state * ALPHABET + classes[0]
                cost += price + flat[at]
                state = at % (ALPHABET * ALPHABET)
                out.append(letters)
                continue
            costs = {state: cost}
        after: dict[State, float] = {}
        came: dict[State, tuple[State, str]] = {}
        for before, so_far in costs.items():
            for letters, price, classes in arcs:
                x, total = before, so_far + price
                for z in classes:
                    at = x * ALPHABET + z
                    total += flat[at]
                    x = at % (ALPHABET * ALPHABET)
                if x not in after or total > after[x]:
                    after[x], came[x] = total, (before, letters)
        trail.append(came)
        if len(after) == 1:
            ((state, cost),) = after.items()
            out.append(_said(trail, state))
            costs, trail = None, []
            continue
        costs = after
        if len(trail) % SETTLE == 0:
            states = set(costs)
            for at in range(len(trail) - 1, -1, -1):
                states = {trail[at][s][0] for s in states}
                if len(states) == 1:
                    out.append(_said(trail[:at], states.pop()))
                    trail = trail[at:]
                    break
    if costs is not None:
        out.append(_said(trail, max(costs, key=lambda s: (costs[s] + flat[s * ALPHABET], s))))
    return "".join(out)


class Restorer:
    """Restores texts; remembers the readings of a bounded number of words.

    A spaced run becomes the words that its likeliest reading parts. With a ``lexicon``, the words of it that the
    run's letters hold elsewhere follow them, as the likeliest parting may miss one, and a word
    doubled throughout may be read single.
    """

    def __init__(self, model: CharModel, lexicon: Mapping[str, float] | None = None) -> None:
        self.model, self.lexicon = model, lexicon or {}
        self.readings: dict[str, str] = {}

    def _spaced(self, run: str) -> list[str]:
        parted = decode(run, self.model, spaced=True)
        words = parted.split()
        for whole in (decode(run, self.model), parted.replace(" ", "")):
            words.append(whole)
            if self.lexicon:
                ends = range(len(whole) - SHORTEST + 1)
                words += [w for i in ends for n in range(SHORTEST, min(LONGEST, len(whole) - i) + 1) if (w := whole[i : i + n]) in self.lexicon]
        return list(dict.fromkeys(words))

    def _reading(self, word: str) -> str:
        """The reading of a suspicious word."""
        said = self.readings.get(word)
        if said is None:
            if len(self.readings) > REMEMBERED:
                self.readings.clear()
            said = decode(word, self.model)
            if said != word and self.lexicon and said not in self.lexicon and (single := _RUN.sub(r"\1", said)) in self.lexicon:
                said = single
            self.readings[word] = said
        return said

    def _apart(self, text: str | None) -> list[str]:
        return SPACED.sub(lambda m: " ".join(self._spaced(m[0])), (text or "").lower()).split()

    def text(self, text: str | None) -> str:
        """The restored text, lower-cased, a blank between words."""
        return " ".join(self._reading(w) if ODD.match(w) else w for w in self._apart(text))

    def words(self, text: str | None) -> set[str]:
        """The distinct words of the restored text."""
        words, suspicious = set(self._apart(text)), ODD.match
        odd = [w for w in words if suspicious(w)]
        words.difference_update(odd)
        words.update(map(self._reading, odd))
        return words


def stripped(word: str) -> str:
    return word.strip(".,;:!?\"'()[]")


def _trigrams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(ALPHABET**3, np.int64)
    for batch in batches:
        for value in batch.column(0):
            text = value.as_py()
            if text:
                c = _CLASS[np.frombuffer(f"  {text} ".encode("utf-8", "surrogatepass"), np.uint8)].astype(np.int32)
                total += np.bincount((c[:-2] * ALPHABET + c[1:-1]) * ALPHABET + c[2:], minlength=ALPHABET**3)
    at = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], names=["gram", "n"])


def fit_char_model(docs: DataFrame, text_col: str = "text") -> CharModel:
    """Trigram counts over all of every text; at most ALPHABET cubed rows reach the driver."""
    counts = docs.select(text_col).mapInArrow(_trigrams, "gram int, n long").groupBy("gram").agg(F.sum("n").alias("n"))
    table = np.zeros(ALPHABET**3, np.int64)
    for row in counts.collect():
        table[row["gram"]] = row["n"]
    return CharModel.of(table)


def held_out(id_column: Column) -> Column:
    """True for the third of the rows that no label is learnt from."""
    return F.coalesce(F.crc32(id_column.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def _share_bound(toxic: Column, n: Column) -> Column:
    """Lower end of Wilson's interval for the share of toxic documents."""
    z2 = DEVIATE**2
    share = toxic / n
    return (share + z2 / (2 * n) - DEVIATE * F.sqrt(share * (1 - share) / n + z2 / (4 * n * n))) / (1 + z2 / n)


def _sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts with their least shingle hash, which near copies mostly share."""
    for batch in batches:
        keys = []
        for value in batch.column(0):
            words = (value.as_py() or "").lower().split()
            keys.append(min((xxhash.xxh64_intdigest(" ".join(words[i : i + 3])) for i in range(max(1, len(words) - 2))), default=0))
        key = pa.array(np.array(keys, np.uint64).view(np.int64))
        yield pa.RecordBatch.from_arrays([*batch.columns, key], names=["text", "toxic", "key"])


def fit_lexicon(
    docs: DataFrame, labels: DataFrame, model: CharModel, id_col: str = "doc_id", text_col: str = "text"
) -> dict[str, float]:
    """Words, and word parts with a ``*``, with the share of toxic texts among those that have them.

    At most SAMPLE rows, the first by a hash of the identifier, and one of
    each set of near copies; held-out rows are never read. Parts are
    counted over the words that the lexicon doesn't hold whole.
    """
    known = labels.select(F.col(id_col).alias("id"), F.col("toxic").cast("int").alias("toxic"))
    known = known.where(~held_out(F.col("id")) & F.col("id").isNotNull() & F.col("toxic").isin(0, 1))
    one_each = known.groupBy("id").agg(F.max("toxic").alias("toxic"))
    sample = F.broadcast(one_each.orderBy(F.xxhash64("id"), "id").limit(SAMPLE))  # bounded
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(sample, "id").select("text", "toxic")
    sketched = rows.mapInArrow(_sketched, "text string, toxic int, key long")
    once = sketched.groupBy("key").agg(F.min(F.struct("text", "toxic")).alias("row")).select("row.text", "row.toxic")

    def counted(seen: tuple[Counter, Counter]) -> pa.RecordBatch:
        names = list(seen[0].keys() | seen[1].keys())
        counts = [pa.array([s[x] for x in names], pa.int64()) for s in (seen[1], seen[0])]
        return pa.RecordBatch.from_arrays([pa.array(names, pa.string()), *counts], names=["feature", "toxic", "clean"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        restorer = Restorer(model)
        for batch in batches:
            seen: tuple[Counter, Counter] = (Counter(), Counter())
            for text, toxic in zip(*batch.columns, strict=True):
                seen[toxic.as_py()].update({stripped(w) for w in restorer.words(text.as_py())})
                if len(seen[0]) + len(seen[1]) > REMEMBERED:
                    yield counted(seen)
                    seen = (Counter(), Counter())
            yield counted(seen)

    def best(counted: DataFrame) -> list:
        both = counted.groupBy("feature").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
        bound = _share_bound(F.col("toxic"), F.col("toxic") + F.col("clean"))
        return (
            both.where("toxic > 0")
            .withColumn("bound", bound)
            .where(F.col("bound") > LEAST_SHARE)
            .orderBy(F.desc("bound"), "feature")
            .limit(LEXICON)
            .collect()
        )

    words = written(once.mapInArrow(count, "feature string, toxic long, clean long").where("feature <> ''"))
    whole = best(words)
    rest = words.where(~F.col("feature").isin([r["feature"] for r in whole])) if whole else words
    size, word = F.length("feature"), F.col("feature")
    heads = F.transform(F.sequence(F.lit(4), F.least(F.lit(7), size - 1)), lambda k: F.concat(F.substr(word, F.lit(1), k), F.lit("*")))
    tails = F.transform(F.sequence(F.lit(4), F.least(F.lit(7), size - 1)), lambda k: F.concat(F.lit("*"), F.substr(word, size - k + 1, k)))
    split = rest.where(size > 4).select(F.explode(F.concat(heads, tails)).alias("feature"), "toxic", "clean")
    found = {r["feature"]: (r["toxic"] + 0.5) / (r["toxic"] + r["clean"] + 1.0) for r in whole + best(split)}
    for r in whole:  # decoding may have halved a double letter
        found.setdefault(_RUN.sub(r"\1", r["feature"]), found[r["feature"]])
    discard(words)
    return found


#: Lengths of word beginnings and endings in the lexicon.
PARTS = range(4, 8)


class Scorer:
    """Scores texts: noisy-or over the distinct words of the restored text.

    A word that the lexicon doesn't hold counts by the highest share of its beginnings and endings there.
    """

    def __init__(self, model: CharModel, lexicon: Mapping[str, float]) -> None:
        self.restorer = Restorer(model, lexicon)
        self.whole = lexicon
        self.heads = {w[:-1]: share for w, share in lexicon.items() if w.endswith("*")}
        self.tails = {w[1:]: share for w, share in lexicon.items() if w.startswith("*")}
        self.weights: dict[str, float] = {}

    def _weight(self, word: str) -> float:
        """Log of the chance that a word doesn't make its text toxic."""
        plain = stripped(word)
        share = self.whole.get(plain, 0.0)
        if not share:
            heads, tails = self.heads, self.tails
            for k in PARTS:
                if k >= len(plain):
                    break
                head, tail = plain[:k], plain[-k:]
                if head in heads and heads[head] > share:
                    share = heads[head]
                if tail in tails and tails[tail] > share:
                    share = tails[tail]
        return math.log1p(-share) if share else 0.0

    def __call__(self, text: str | None) -> float:
        clean, weights = 0.0, self.weights
        if len(weights) > REMEMBERED:
            weights.clear()
        for word in self.restorer.words(text):
            weight = weights.get(word)
            if weight is None:
                weight = weights[word] = self._weight(word)
            clean += weight
        return 1.0 - math.exp(clean)


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[CharModel, dict[str, float]]:
    """The character model and the lexicon."""
    model = fit_char_model(docs, text_col)
    return model, fit_lexicon(docs, labels, model, id_col, text_col)


def toxicity(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD
) -> DataFrame:
    """Restore and score every whole text.

    Returns doc_id, held_out, score (0 to 1) and predicted (1 from ``threshold`` on), one
    row for each input row. Null and empty texts score like a text that has no word of the
    lexicon. Equal texts score alike. Labels that are null or neither 0 nor 1,
    and labels of unknown documents, teach nothing; without labels every score is zero. A
    row without an identifier is scored and not held out. Other columns are ignored.
    """
    model, lexicon = fit(docs, labels, id_col, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = Scorer(model, lexicon)
        for batch in batches:
            out = [score(text.as_py()) for text in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.float64())], names=["doc_id", "score"])

    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return source.mapInArrow(run, "doc_id long, score double").select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted")
    )


def drop_toxic(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` without the rows that score as toxic; columns stay as they are.

    Each row is judged by its own text in one pass, so no join is needed and repeated or null identifiers make no difference.
    """
    model, lexicon = fit(docs, labels, id_col, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = Scorer(model, lexicon)
        for batch in batches:
            yield batch.filter(pa.array([score(text.as_py()) < threshold for text in batch.column(text_col)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def restored_texts(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, restored): what the score reads, for each input row; null and empty texts are empty."""
    model, lexicon = fit(docs, labels, id_col, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        restorer = Restorer(model, lexicon)
        for batch in batches:
            out = [restorer.text(text.as_py()) for text in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], names=["doc_id", "restored"])

    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return source.mapInArrow(run, "doc_id long, restored string")
