"""Line dedup by a segment-partition edit join.

Two lines may differ by one edit for each PER code points of the shorter, EDITS at most. If they do so within e edits, they
share a segment: cut the shorter (or equal) line into e + 1 segments,
and the other line holds one of them untouched, at a start that its number and the
lengths allow. So each distinct line is indexed under its segments with its length, and
probes the substrings of itself that could be a segment of a line up to EDITS shorter. Starts
are those of multi-match selection: before segment i at most i - 1 edits, after it at
most e + 1 - i. Equal keys make candidates. As many lines may share a long passage, the join
itself drops pairs whose letter parities differ in more bits than e edits can change, and deals the rows of a hot segment as
pairs of chunks; a banded bit-parallel edit distance verifies the rest.

The verifier keeps, for each number of errors, a word whose bits are the 2 * e + 1 diagonals
of the band; one step for each character advances all of them by shifts and masks.

Lines go by hash, two independent ones of 64 bits together, so that no text is shuffled but that of lines that meet another.
Equal lines count once wherever rows meet. All of it is column expressions; no Python runs on the executors.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vframe.llm.common import addressed, attach, bind, components, discard, fresh, sifted, width, written

EDITS = 2
#: Code points of the shorter line for each edit: lines of fewer link only when equal.
PER = 8
#: Rows of a chunk of a hot segment.
HOT = 2048
#: Places from which on a line counts as repeated: such lines are made distinct before their segments are cut.
REPEATED = 64
#: Documents of one in which hot segments are looked for, how often a segment occurs there if it is hot, and how many are listed at most.
SAMPLED, OFTEN, LISTED = 1024, 32, 1 << 16


def allowed(length: Column, edits: int = EDITS) -> Column:
    """The edits that may part a line of ``length`` from a line as long or longer."""
    return F.least(F.lit(edits), F.floor(length / PER).cast("int"))


def _segment(length: Column, i: Column | int, edits: Column | int) -> tuple[Column, Column]:
    """Start (from 0) and size of segment i (from 1): the later ones take what doesn't divide evenly."""
    i, edits = (F.lit(x) if isinstance(x, int) else x for x in (i, edits))
    size, longer = F.floor(length / (edits + 1)), length % (edits + 1)
    short = edits + 1 - longer  # segments of the smaller size
    start = size * (i - 1) + F.greatest(F.lit(0), i - 1 - short)
    return start.cast("int"), (size + (i > short).cast("int")).cast("int")


def parts(edits: int) -> list[tuple[int, int, int, int]]:
    """What a line indexes or probes for lines that allow ``edits``, as (edits, how much shorter the other line is, number of the segment, shift of its start)."""
    out = []
    for shorter in range(edits + 1):
        for i in range(1, edits + 2):
            before, after = i - 1, edits + 1 - i
            out += [(edits, shorter, i, d) for d in range(max(-before, shorter - after), min(before, shorter + after) + 1)]
    return out


def keyed(lines: DataFrame, edits: int = EDITS) -> DataFrame:
    """Keys of lines (h, line, n) as (h, key, own): own if the line is indexed by it, not only probed for.

    The parts are exploded as a constant, so that the compiled code holds one small expression for all of them. As a segment has one code point
    at least, the shifts of parts never lead out of the line.
    """
    table = lambda some: F.array(*[F.struct(*[F.lit(x).alias(c) for c, x in zip(("e", "shorter", "i", "d"), p, strict=True)]) for p in some])
    every = [p for e in range(1, edits + 1) for p in parts(e)]
    long = F.col("n") >= PER * edits + edits  # all lines that it may meet allow all edits
    each = lines.select("h", "line", "n", F.explode(F.when(long, table(parts(edits))).otherwise(table(every))).alias("p"))
    length, i, e = F.col("n") - F.col("p.shorter"), F.col("p.i"), F.col("p.e")
    start, size = _segment(length, i, e)
    key = F.xxhash64(length, i, F.substr(F.col("line"), start + F.col("p.d") + 1, size)).alias("key")
    own = (F.col("p.shorter") == 0) & (F.col("p.d") == 0)
    return each.where(allowed(length, edits) == e).select("h", key, own.alias("own"))


def _common(a: Column, b: Column) -> Column:
    """Length of the common beginning of two strings (up to 2**17), by halving steps."""
    most = F.least(F.length(a), F.length(b))
    steps = F.array(*[F.lit(1 << k) for k in range(16, -1, -1)])
    same = lambda n: (n <= most) & (F.substr(a, F.lit(1), n) == F.substr(b, F.lit(1), n))
    return F.aggregate(steps, F.lit(0), lambda n, k: F.when(same(n + k), n + k).otherwise(n))


def trimmed(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """``pairs`` with the common beginning and end taken off both strings, which leaves their edit distance."""
    for _ in range(2):
        tail = _common(F.col(a), F.col(b)) + 1
        cut = lambda c: F.reverse(F.substr(F.col(c), F.col("_tail"), F.length(c)))  # noqa: B023, E731
        pairs = pairs.withColumn("_tail", tail).withColumns({a: cut(a), b: cut(b)}).drop("_tail")
    return pairs


def plausible(a: Column, b: Column, edits: int = EDITS) -> Column:
    """False only if over ``edits`` edits part the strings: of edits + 1 segments of a, one must lie in b, shifted by ``edits`` at most."""
    n = F.length(a)

    def found(i: int) -> Column:
        start, size = _segment(n, i, edits)
        low = F.greatest(start - edits, F.lit(0))
        return F.contains(F.substr(b, low + 1, start + size + edits - low), F.substr(a, start + 1, size))

    return reduce(lambda x, y: x | y, [found(i) for i in range(1, edits + 2)], n <= edits)


def verified(pairs: DataFrame, a: str, b: str, edits: int = EDITS) -> DataFrame:
    """The pairs whose strings are within ``edits`` edits, by banded bit-parallel simulation.

    Bit d of word e says that with e errors, the whole of a so far meets b up to that
    length plus d - edits. A match stays on its diagonal, so does a substitution with one more
    error; a character of a alone steps one diagonal down, one of b alone one up.
    """
    band, full = 2 * edits + 1, (1 << (2 * edits + 1)) - 1
    first = F.array(*[F.lit(sum(1 << d for d in range(edits, edits + e + 1))) for e in range(edits + 1)])
    # The state carries the other line's letters, as the optimiser would split them anew at each step.
    start = F.struct(first.alias("words"), F.split(F.col(b), "").alias("other"), F.lit(0).alias("match"), F.lit(0).alias("i"))

    def matched(s: Column, letter: Column) -> Column:
        same = lambda d: F.get(s["other"], s["i"] + (d - edits)) == letter
        return sum((F.when(same(d), 1 << d).otherwise(0) for d in range(1, band)), F.when(same(0), 1).otherwise(0))

    def advanced(words: Column, match: Column) -> Column:
        fresh: list[Column] = []
        for e in range(edits + 1):
            word = F.get(words, F.lit(e)).bitwiseAND(match)
            if e:
                less = F.get(words, F.lit(e - 1))
                word = word.bitwiseOR(less).bitwiseOR(F.shiftright(less, 1)).bitwiseOR(F.shiftleft(fresh[-1], 1))
            fresh.append(word.bitwiseAND(F.lit(full)))
        return F.array(*fresh)

    def step(s: Column, letter: Column) -> Column:
        with_match = F.array(s.withField("match", matched(s, letter)))  # a list of one, to name the match once
        done = lambda t: t.withField("words", advanced(t["words"], t["match"])).withField("i", t["i"] + 1)
        return F.get(F.transform(with_match, done), F.lit(0))

    goal = F.element_at(F.array(*[F.lit(1 << d) for d in range(band)]), F.length(b) - F.length(a) + edits + 1)
    reached = lambda s: F.exists(s["words"], lambda w: w.bitwiseAND(goal) != 0)
    close = pairs.where(F.abs(F.length(a) - F.length(b)) <= edits)
    return close.where(F.aggregate(F.filter(F.split(F.col(a), ""), lambda c: c != ""), start, step, reached))


def letter_parities(line: Column) -> Column:
    """64 bits: for each class of letters whether their number is odd. An edit changes two bits at most."""
    flip = lambda bits, c: bits.bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.ascii(c), F.lit(64))))
    return F.aggregate(F.split(line, ""), F.lit(0).cast("long"), flip)


def _hashes(line: str) -> list[Column]:
    """Two hashes of a line, seeded apart and so independent."""
    return [F.xxhash64(line).alias("h"), F.xxhash64(F.lit(1), line).alias("g")]


def near_lines(lines: DataFrame, edits: int = EDITS, repeated: DataFrame | None = None, sample: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Links (a, b) among the distinct ones of lines (line string) within the edits that the shorter allows, and the lines (id, h, g, line) that they are about.

    ``repeated`` lists hashes (h) of lines that occur often, and ``sample`` has some of the lines. Both only serve to keep hot lines and segments from
    gathering in one task; the links don't depend on them.
    """
    size = lambda some: some.select(*_hashes("line"), "line", F.length("line").alias("n")).where(F.col("n") >= PER)
    sized = size(lines)
    once = sized if repeated is None else sifted(sized, repeated, "h", rest=True).unionByName(sifted(sized, repeated, "h").distinct())
    keys, hot = keyed(once, edits), None
    if sample is not None:
        often = keyed(size(sample).distinct(), edits).groupBy("key").count().where(F.col("count") >= OFTEN)
        hot = written(often.orderBy(F.desc("count"), "key").limit(LISTED).select("key"))
    by_key = Window.partitionBy("key")
    around = {"low": F.min("h").over(by_key), "high": F.max("h").over(by_key), "owned": F.max("own").over(by_key)}
    plain = keys if hot is None or hot.isEmpty() else keys.join(F.broadcast(hot), "key", "left_anti")  # at most LISTED rows
    met = plain.withColumns(around).where((F.col("low") != F.col("high")) & F.col("owned")).select("key", "h", "own")
    if plain is not keys:
        met = met.unionByName(keys.join(F.broadcast(hot), "key", "left_semi").select("key", "h", "own"))  # at most LISTED rows
    met = written(met.distinct())
    ids = written(met.select("h").distinct())
    # Not a semi-join, which the optimiser would move ahead of the sifting.
    likely = sifted(sized, ids, "h").distinct().join(ids, "h").withColumn("id", F.monotonically_increasing_id())
    some = written(likely.withColumn("letters", letter_parities(F.col("line"))))
    # The rows of a hot segment are dealt to chunks, and each pair of chunks is a group of its own.
    chunks = F.ceil(F.col("m") / HOT).cast("int")
    chunk = lambda name: F.pmod(F.xxhash64(F.lit(7), name), F.col("k")).cast("int")
    counts = met.groupBy("key").agg(F.count("*").alias("m"))
    marked = met.join(some.select("h", "id", "letters", "n"), "h").join(counts, "key").withColumn("k", chunks)
    every = F.explode(F.sequence(F.lit(0), F.col("k") - 1))
    index = marked.where("own").select("key", F.col("id").alias("a"), F.col("letters").alias("letters_a"), F.col("n").alias("n_a"), chunk("id").alias("x"), every.alias("y"))
    probes = marked.select(F.col("key").alias("probe"), F.col("id").alias("b"), "letters", "own", "n", chunk("id").alias("v"), every.alias("u"))
    limit = allowed(F.least("n", "n_a"), edits)
    alike = F.bit_count(F.col("letters").bitwiseXOR(F.col("letters_a"))) <= 2 * limit
    apart = (F.col("a") != F.col("b")) & (~F.col("own") | (F.col("a") < F.col("b")))
    same = (F.col("probe") == F.col("key")) & (F.col("u") == F.col("x")) & (F.col("v") == F.col("y"))
    pairs = probes.join(index, same & alike & apart)
    pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), limit.alias("limit")).distinct()
    full = pairs.join(some.select(F.col("id").alias("a"), F.col("line").alias("line_a")), "a").join(
        some.select(F.col("id").alias("b"), F.col("line").alias("line_b")), "b"
    )
    # Few pairs of long work: an even deal, and the middles written so that no step trims them again.
    middles = written(trimmed(full, "line_a", "line_b").repartition(width(lines.sparkSession), "a", "b"))
    found = []
    for e in range(1, edits + 1):
        mine = middles.where(F.col("limit") == e)
        likely = mine.where(plausible(F.col("line_a"), F.col("line_b"), e))
        found.append(verified(likely, "line_a", "line_b", e).select("a", "b"))
    out = written(reduce(DataFrame.unionByName, found).distinct())
    discard(met, ids, middles, *([hot] if hot is not None else []))
    return out, some


def _addressed(docs: DataFrame) -> tuple[DataFrame, str, Column]:
    """``docs`` by place; the column's name and its hash, which with the identifier tells rows apart."""
    docs, row = addressed(docs)
    return docs, row, F.xxhash64(F.col(row)["file"], F.col(row)["at"])


def _listed(docs: DataFrame, row: Column, id_col: str, text_col: str, edits: int) -> DataFrame:
    """(doc_id, row, places, near) of the documents that lose lines."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), row.alias("row"), F.split(text, "\n", -1).alias("lines"))
    each = source.select("doc_id", "row", F.posexplode("lines").alias("place", "line")).where("trim(line) <> ''")
    places = each.select("doc_id", "row", "place", *_hashes("line"))
    found = places.groupBy("h", "g").agg(F.min(F.struct("doc_id", "row", "place")).alias("first"), F.count("*").alias("n"))
    first = written(found)
    repeated = written(first.where(F.col("n") >= REPEATED).select("h"))
    sampled = each.where(F.pmod("row", F.lit(SAMPLED)) == 0).select("line")
    links, lines = near_lines(each.select("line"), edits, repeated, sampled)
    groups = written(components(links).select(F.col("node").alias("id"), F.col("component").alias("class")))
    linked = written(lines.join(groups, "id").select("h", "g", "class"))
    discard(lines, links, groups, repeated)
    # A line that occurs once and links with none is never dropped, so it needs no lookup.
    classed = written(first.join(linked, ["h", "g"], "left").where((F.col("n") > 1) | F.col("class").isNotNull()))
    discard(first, linked)
    best = classed.where("class is not null").groupBy("class").agg(F.min(F.struct("first", "h", "g")).alias("best"))
    same = (F.coalesce("best.h", "h") == F.col("h")) & (F.coalesce("best.g", "g") == F.col("g"))
    lookup = attach(classed, best, "class", "h").select("h", "g", F.coalesce("best.first", "first").alias("first"), (~same).alias("near"))
    met = attach(sifted(places, classed.select("h"), "h"), lookup, ["h", "g"], "row").where("first is not null")
    dropped = met.where(~F.struct("doc_id", "row", "place").eqNullSafe(F.col("first")))
    return dropped.groupBy("doc_id", "row").agg(
        F.array_sort(F.collect_list("place")).alias("places"), F.count_if("near").alias("near")
    )


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", edits: int = EDITS) -> DataFrame:
    """Find the lines of each document that equal or nearly equal an earlier line of the corpus.

    Lines are what newlines part. Lines that link, directly or through others,
    form a class; its first line by (doc_id, row, place) stays and the others are dropped. Blank
    lines always stay. Returns doc_id, n_lines, n_dropped, n_near (dropped lines whose text
    differs from the one that stays) and dropped (their places from 0, comma-joined), one row
    for each input row. Null and empty texts have one blank line. Rows are told apart by their place: of repeated rows, with or without
    an identifier, the first keeps its lines and the others lose them. Rows without an identifier come first. No rows give
    no rows; other columns are ignored.
    """
    docs, _, row = _addressed(docs)
    listed = _listed(docs, row, id_col, text_col, edits).withColumnsRenamed({"doc_id": "_id", "row": "_at"})
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), row.alias("row"), F.size(F.split(text, "\n", -1)).cast("long").alias("n_lines"))
    out = rows.join(listed, (rows["row"] == listed["_at"]) & rows["doc_id"].eqNullSafe(listed["_id"]), "left")
    places = F.coalesce("places", F.array().cast("array<int>"))
    return out.select(
        "doc_id",
        "n_lines",
        F.size(places).cast("long").alias("n_dropped"),
        F.coalesce("near", F.lit(0)).cast("long").alias("n_near"),
        F.array_join(places.cast("array<string>"), ",").alias("dropped"),
    )


def _without(lines: Column, gone: Column) -> Column:
    """An array without the elements at places ``gone``: both are sorted together, so that a gone place stands before its element."""
    kept = F.transform(lines, lambda line, i: F.struct(i.alias("i"), F.lit(1).alias("line"), line.alias("text")))
    marks = F.transform(gone, lambda i: F.struct(i.alias("i"), F.lit(0).alias("line"), F.lit(None).cast("string").alias("text")))
    stays = lambda a, x, i: (x["line"] == 1) & ((i == 0) | (F.get(a, i - 1)["i"] != x["i"]))
    return bind(F.array_sort(F.concat(kept, marks)), lambda a: F.transform(F.filter(a, lambda x, i: stays(a, x, i)), lambda x: x["text"]))


def drop_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", edits: int = EDITS) -> DataFrame:
    """``docs`` with the dropped lines taken out of the texts; columns and rows stay as they are, null texts too."""
    names = docs.columns
    docs, _, row = _addressed(docs)
    at, own, gone = (fresh(docs, n) for n in ("_at", "_own", "_gone"))
    found = _listed(docs, row, id_col, text_col, edits).select(F.col("row").alias(at), F.col("doc_id").alias(own), F.col("places").alias(gone))
    both = docs.join(found, (row == F.col(at)) & F.col(id_col).cast("long").eqNullSafe(F.col(own)), "left")
    left = F.array_join(_without(F.split(F.coalesce(F.col(text_col), F.lit("")), "\n", -1), F.col(gone)), "\n")
    text = F.when(F.col(gone).isNull(), F.col(text_col)).otherwise(left)
    return both.select(*[text.alias(c) if c == text_col else F.col(c) for c in names])
