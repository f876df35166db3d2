"""Personal data by candidate generation and gradient boosting.

Four exact kinds are base spans and always stay. Beside them, high-recall generators propose
overlapping candidates: any long number, any dotted quad, anything around an at sign or its spelling, any long mixed token.
Boosted trees read the format of a candidate (digits, groups, separators, checksum) and its context
(neighbouring characters and words), and a threshold for each kind, calibrated on
the quarter of the examples that the trees haven't seen, selects those that join the base spans.

The base patterns are no teacher for what they miss. So the trees learn from base spans rewritten into forms that the
patterns don't know, in their own context: addresses with spelled signs, numbers without a plus or with other separators.
Candidates beside a word that speaks for their kind are weak examples where their format allows it. Counter-examples are candidates that meet no base
span, have no such word near, and are not of the shape of a rewritten form: those stay unlabelled, so that a corpus with many hidden forms doesn't
teach to reject them. Every base span and every such candidate of the corpus is an example: features are small numbers, so equal examples
are counted and weighed, and the trees are fitted inside the engine on the distinct ones, then written out as column expressions.

Whole texts are read once, by Java regular expressions rewritten to run in linear time
without recursion: a run starts only where the character before can't belong to it or where the
last match ended, repeats are possessive, and repeated groups are lazy character runs that end by
lookahead. What follows works on a narrow table of spans with their context; spans of a text meet by
ordered windows, so no step compares all spans of a text with each other.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vframe.llm.common import addressed, between, bind, discard, fresh, running, stretches, written

KINDS = ("email", "ip", "card", "phone")
#: Kinds of added spans: the base ones, and long tokens such as keys.
ADDED_KINDS = (*KINDS, "secret")

_LOCAL, _LABEL = "A-Za-z0-9._%+-", "A-Za-z0-9-"
#: [local]+@[label]+(\.[label]+)+
EMAIL = (
    rf"(?:(?<![{_LOCAL}])|\G)[{_LOCAL}]++@[{_LABEL}]++\.[{_LABEL}][{_LABEL}.]*?(?=\.?(?:[^{_LABEL}.]|\z)|\.\.)"
)
#: [0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)
IP = r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
#: [0-9]([ -]?[0-9])+ where 12 or more such characters follow the first digit
CARD = r"(?<![0-9])(?<![0-9][ -])[0-9](?=[0-9 -]{12})[0-9 -]*?(?=[ -]?(?:[^0-9 -]|\z)|[ -][ -])"
PHONE = r"\+[0-9][ ().0-9-]+[0-9]"

#: Generators of candidates, by the kind they propose; a number's kind is by its digits.
NUMBERS = r"(?<![0-9])[+(]?[0-9][0-9 ().-]{5,38}[0-9]"
QUADS = r"(?<![0-9.])[0-9]{1,4}(?:(?:[.:]|\[[.]\]|[(\[](?:dot|DOT)[)\]])[0-9]{1,4}){3}(?![0-9])"
_AT, _DOT = r" ?(?:@|[(\[](?:at|AT)[)\]]) ?| (?:at|AT) ", r" ?(?:\.|[(\[](?:dot|DOT)[)\]]) ?| (?:dot|DOT) "
AT = rf"(?<![{_LOCAL}])[{_LOCAL}]{{1,64}}(?:{_AT})[{_LABEL}]{{1,63}}(?:(?:{_DOT})[{_LABEL}]{{1,63}}){{1,4}}"
#: Signs without which a text holds no address in any form.
AT_SIGNS = ("@", "(at)", "[at]", "(AT)", "[AT]", " at ", " AT ")
_TOKEN = "A-Za-z0-9+/_-"
SECRET = rf"(?<![{_TOKEN}])(?=[A-Za-z+/_-]{{0,60}}[0-9])[{_TOKEN}]{{20,256}}(?![{_TOKEN}])"

# Words near a candidate that speak for a kind.
NEAR = {
    "phone": "tel|phone|call|fax|mobil|whatsapp",
    "card": "card|visa|credit|karte|tarjeta|carte|iban|account",
    "ip": "host|server|addr|ip ",
    "email": "mail|contact|write to",
    "secret": "token|key|secret|passw|auth|bearer",
}
#: Code points of context on the left, from the last match of the same generator on.
CONTEXT = 24
TREES, DEPTH = 10, 4
#: Bins of a feature, at least and at most. The engine finds split points from bins * bins rows, so bins grow as the root of the examples; the square of more overflows.
BINS = 32, 46_340
#: Precision among unseen examples that a threshold has to reach.
PRECISION = 0.98

SPAN = "struct<kind:string,start:int,end:int,said:string,left:string,after:string>"


def _none() -> Column:
    return F.array().cast(f"array<{SPAN}>")


def _located(text: Column, pattern: str, kind: str) -> Column:
    """All matches of a pattern as spans with their context; start and end in code points, the end exclusive."""

    def spans(s: Column, before: Column) -> Column:
        def span(said: Column, i: Column) -> Column:
            gap = F.get(s["gaps"], i)
            start = F.get(before, i) + F.length(gap)
            return F.struct(
                F.lit(kind).alias("kind"), start.alias("start"), (start + F.length(said)).alias("end"), said.alias("said"),
                F.right(gap, F.lit(CONTEXT)).alias("left"), F.left(F.get(s["gaps"], i + 1), F.lit(1)).alias("after"),
            )

        return F.transform(s["said"], span)

    def placed(said: Column) -> Column:
        pair = F.struct(said.alias("said"), F.split(text, pattern, -1).alias("gaps"))  # the gaps stand before, between and after the matches
        sizes = lambda s: F.transform(s["said"], lambda m, i: F.length(m) + F.length(F.get(s["gaps"], i)))
        return bind(pair, lambda s: bind(running(sizes(s)), lambda before: spans(s, before)))

    return bind(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda said: F.when(F.size(said) == 0, _none()).otherwise(placed(said)))


def _digits(said: Column) -> Column:
    return F.regexp_replace(said, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """Whether a string of digits passes Luhn's check."""

    def add(total: Column, i: Column) -> Column:
        digit = F.substr(F.reverse(digits), i, F.lit(1)).cast("int")
        twice = F.when(digit > 4, 2 * digit - 9).otherwise(2 * digit)
        return total + F.when(i % 2 == 0, twice).otherwise(digit)

    return F.when(digits != "", F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add) % 10 == 0).otherwise(False)


def _quad(said: Column) -> Column:
    """Whether each dotted part is at most 255; leading zeros don't count."""
    part = lambda p: F.regexp_replace(p, "^0+(?=.)", "")
    small = lambda p: (F.length(part(p)) < 4) & (F.substr(part(p), F.lit(1), F.lit(3)).try_cast("int") <= 255)
    return F.forall(F.split(said, "[.]"), lambda p: F.coalesce(small(p), F.lit(False)))


def base_spans(text: Column) -> Column:
    """The spans of the four exact kinds, by kind as listed, then start."""
    digits = lambda s: F.length(_digits(s["said"]))
    email = F.when(F.contains(text, F.lit("@")), _located(text, EMAIL, "email")).otherwise(_none())
    ip = F.filter(_located(text, IP, "ip"), lambda s: _quad(s["said"]))
    card = F.filter(_located(text, CARD, "card"), lambda s: digits(s).between(13, 19) & _luhn(_digits(s["said"])))
    phone = F.when(F.contains(text, F.lit("+")), _located(text, PHONE, "phone")).otherwise(_none())
    return F.concat(email, ip, card, F.filter(phone, lambda s: digits(s).between(9, 15)))


def _has(text: Column, *signs: str) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(text, F.lit(s)) for s in signs])


def candidates(text: Column) -> Column:
    """What the generators propose; spans of different generators may overlap."""
    numbers = F.transform(
        _located(text, NUMBERS, "phone"),
        lambda s: s.withField("kind", F.when(F.length(_digits(s["said"])) >= 13, "card").otherwise("phone")),
    )
    numbers = F.filter(numbers, lambda s: F.length(_digits(s["said"])) >= 7)
    at = F.when(_has(text, *AT_SIGNS) & _has(text, ".", "dot", "DOT"), _located(text, AT, "email")).otherwise(_none())
    words = [w for name in ("token", "key", "secret", "passw", "auth", "bearer") for w in (name, name.title(), name.upper())]
    secret = F.when(_has(text, *words), _located(text, SECRET, "secret")).otherwise(_none())
    return F.concat(at, _located(text, QUADS, "ip"), numbers, secret)


def _near(kind: str, left: Column) -> Column:
    return F.rlike(F.lower(left), F.lit(NEAR[kind]))


def _features(span: dict[str, Column]) -> dict[str, Column]:
    """Format and context of a candidate (kind, said, left, after) as numbers."""
    said, left, after = span["said"], span["left"], span["after"]
    signs = lambda pattern: F.length(said) - F.length(F.regexp_replace(said, pattern, ""))
    groups = F.filter(F.split(said, "[^0-9]+"), lambda g: g != "")
    out = {
        "kind": F.array_position(F.array(*map(F.lit, ADDED_KINDS)), span["kind"]),
        "length": F.length(said),
        "digits": F.length(_digits(said)),
        "groups": F.size(groups),
        "longest": F.coalesce(F.array_max(F.transform(groups, F.length)), F.lit(0)),
        "spaces": signs(" "),
        "dots": signs("[.]"),
        "hyphens": signs("-"),
        "round": signs("[()]"),
        "square": signs("[\\[\\]]"),
        "upper": signs("[A-Z]"),
        "plus": F.startswith(said, F.lit("+")),
        "luhn": _luhn(_digits(said)),
        "quad": _quad(F.regexp_replace(F.regexp_replace(said, "[^0-9]+", "."), "^[.]|[.]$", "")) & (F.size(groups) == 4),
        "spelled": F.rlike(said, F.lit("(?i)[( \\[](at|dot)[) \\]]")),
        "domain": F.rlike(said, F.lit("[a-z0-9]*[ .)\\]][a-z]{2,6}$")),
        "letter_before": F.rlike(left, F.lit("[\\p{L}0-9_=#]$")),
        "letter_after": F.rlike(after, F.lit("[\\p{L}0-9_=#]")),
    }
    out |= {f"near_{kind}": _near(kind, left) for kind in NEAR}
    return {name: F.coalesce(c.cast("double"), F.lit(0.0)) for name, c in out.items()}


def _tree(node, features: list[Column]) -> Column:
    """A fitted tree as nested conditions."""
    if node.numDescendants() == 0:
        return F.lit(float(node.prediction()))
    split = node.split()
    left, right = _tree(node.leftChild(), features), _tree(node.rightChild(), features)
    return F.when(features[split.featureIndex()] <= float(split.threshold()), left).otherwise(right)


def score(model: GBTClassificationModel | None, features: dict[str, Column]) -> Column:
    """The boosted trees' probability as an expression; zero without a model."""
    if model is None:
        return F.lit(0.0)
    columns = list(features.values())
    trees = [w * _tree(t._call_java("rootNode"), columns) for t, w in zip(model.trees, model.treeWeights, strict=True)]
    return 1.0 / (1.0 + F.exp(-2.0 * reduce(lambda a, b: a + b, trees)))


def rewritten(kind: Column, said: Column, form: Column) -> Column:
    """A base span in one of three forms that the base patterns don't know."""
    pick = lambda *forms: F.when(form == 0, forms[0]).when(form == 1, forms[1]).otherwise(forms[2])
    name, host = F.substring_index(said, "@", 1), F.substring_index(said, "@", -1)
    spelled = lambda at, dot: F.concat(name, F.lit(at), F.replace(host, F.lit("."), F.lit(dot)))
    bare, national = F.regexp_replace(said, "^[+]", ""), F.regexp_replace(said, "^[+][0-9]{1,3}[ .-]*", "")
    fours = lambda sign: F.regexp_replace(_digits(said), "(.{4})(?=.)", f"$1{sign}")
    return (
        F.when(kind == "email", pick(spelled(" (at) ", " (dot) "), spelled("[at]", "[dot]"), spelled(" at ", " dot ")))
        .when(kind == "phone", pick(bare, national, F.regexp_replace(bare, "[ ()-]+", ".")))
        .when(kind == "card", pick(fours("."), fours(" - "), fours("  ")))
        .otherwise(pick(*[F.replace(said, F.lit("."), F.lit(dot)) for dot in ("[.]", "(dot)", "[dot]")]))
    )


def _shape(kind: Column, said: Column) -> Column:
    """A span's kind, its digits as 9 and runs of letters as a, and whether its digits pass their kind's check."""
    words = F.regexp_replace(said, "[A-Za-z0-9_%+.-]*[A-Za-z0-9_%+-]", "a")
    plain = F.regexp_replace(F.regexp_replace(said, "[0-9]", "9"), "[A-Za-z]+", "a")
    shape = F.when(kind == "email", words).when(kind == "ip", F.regexp_replace(plain, "9+", "9")).otherwise(plain)
    return F.concat_ws("|", kind, shape, F.when(kind == "ip", _quad(F.regexp_replace(said, "[^0-9]+", "."))).otherwise(_luhn(_digits(said))))


def _counted(spans: DataFrame, *keys: str) -> DataFrame:
    """Labelled spans as distinct rows of ``keys``, kind, label, side and features, with their number as weight.

    A hash of a span's content says whether its examples are held out of the trees, so equal spans are on one side.
    """
    fields = ("kind", "said", "left", "after")
    features = _features({c: F.col(c) for c in fields})
    held = (F.pmod(F.xxhash64(*fields), F.lit(4)) == 0).alias("held")
    rows = spans.select(*keys, F.col("kind").alias("proposed"), "label", held, *[c.alias(n) for n, c in features.items()])
    return rows.groupBy(*rows.columns).agg(F.count("*").cast("double").alias("weight"))


def _examples(found: DataFrame, marks: DataFrame) -> DataFrame:
    """All labelled candidates, counted: weak ones of the texts, and every base span rewritten."""
    near = {k: _near(k, F.col("left")) for k in NEAR}
    own = reduce(lambda c, k: c.when(F.col("kind") == k, near[k]), list(NEAR)[1:], F.when(F.col("kind") == "phone", near["phone"]))
    any_near = reduce(lambda a, b: a | b, near.values())
    digits = F.length(_digits(F.col("said")))
    sound = (
        F.when(F.col("kind") == "phone", digits.between(9, 15))
        .when(F.col("kind") == "card", digits.between(13, 19) & _luhn(_digits(F.col("said"))))
        .when(F.col("kind") == "ip", _quad(F.regexp_replace(F.col("said"), "[^0-9]+", ".")))
        .otherwise(True)
    )
    label = F.when(own & sound, 1.0).when(~any_near, 0.0)
    shape = F.when(F.col("kind").isin(*KINDS), _shape(F.col("kind"), F.col("said")))  # no other kind has base spans
    base = found.where(F.size("base") > 0).select(F.explode("base").alias("s")).select("s.kind", "s.said", "s.left", "s.after")
    made = base.withColumn("said", rewritten(F.col("kind"), F.col("said"), F.pmod(F.xxhash64("said", "left"), F.lit(3)))).withColumn("label", F.lit(1.0))
    made = written(_counted(made.withColumn("shape", shape), "shape"))
    weak = marks.where("not base and not meets").withColumns({"label": label, "shape": shape}).where("label is not null")
    weak = written(_counted(weak, "shape"))
    sure, unsure = weak.where("label = 1 or shape is null"), weak.where("label = 0 and shape is not null")
    unlike = unsure.join(made.select("shape").distinct(), "shape", "left_anti")
    rows = reduce(DataFrame.unionByName, (sure, unlike, made)).drop("shape")
    out = written(rows.groupBy(*[c for c in rows.columns if c != "weight"]).agg(F.sum("weight").alias("weight")))
    discard(made, weak)
    return out


def fit(found: DataFrame, marks: DataFrame) -> tuple[GBTClassificationModel | None, dict[str, float]]:
    """Trees and thresholds by kind, from every labelled candidate and every base span.

    Three quarters of them, by a hash of their content, grow the trees and the rest sets the thresholds. Without both examples and
    counter-examples there is no model; a kind without a threshold adds nothing.
    """
    examples = _examples(found, marks)
    features = [c for c in examples.columns if c not in ("proposed", "label", "held", "weight")]
    grow, hold = examples.where("not held"), examples.where("held")
    model, limits = None, {}
    sizes = [r["count"] for r in grow.groupBy("label").count().collect()]
    if len(sizes) == 2:
        vectors = VectorAssembler(inputCols=features, outputCol="features").transform(grow.orderBy(*features, "label"))
        bins = min(max(BINS[0], math.isqrt(sum(sizes)) + 1), BINS[1])
        trees = GBTClassifier(maxIter=TREES, maxDepth=DEPTH, maxBins=bins, seed=7, labelCol="label", weightCol="weight")
        model = trees.fit(vectors.select("features", "label", "weight"))
        scored = hold.withColumn("score", F.round(score(model, {n: F.col(n) for n in features}), 2))
        seen = scored.groupBy("proposed", "score").agg(F.sum("weight").alias("n"), F.sum(F.col("label") * F.col("weight")).alias("good")).collect()
        for kind in ADDED_KINDS:
            n = good = 0
            for row in sorted((r for r in seen if r["proposed"] == kind), key=lambda r: -r["score"]):
                n, good = n + row["n"], good + row["good"]
                if good >= PRECISION * n:
                    limits[kind] = row["score"]
    discard(examples)
    return model, limits


def _marked(found: DataFrame) -> DataFrame:
    """Base spans and candidates, one row each, with whether a candidate meets a base span of its text."""
    spans = lambda name, flag: F.transform(name, lambda s: F.struct(s.alias("s"), F.lit(flag).alias("base")))
    each = found.where(F.size("found") > 0).select("row", F.explode(F.concat(spans("base", True), spans("found", False))).alias("x"))
    each = each.select("row", "x.s.*", "x.base")
    before = Window.partitionBy("row").orderBy("start", F.desc("base")).rowsBetween(Window.unboundedPreceding, -1)
    after = Window.partitionBy("row").orderBy(F.desc("start"), "base").rowsBetween(Window.unboundedPreceding, -1)
    reach = F.max(F.when(F.col("base"), F.col("end"))).over(before) > F.col("start")
    next_one = F.min(F.when(F.col("base"), F.col("start"))).over(after) < F.col("end")
    return each.withColumn("meets", F.coalesce(reach, F.lit(False)) | F.coalesce(next_one, F.lit(False)))


def _best(chosen: DataFrame) -> DataFrame:
    """Of spans that overlap, directly or in a chain, the one of the best score, then length, then place; one array for each text."""
    ordered = Window.partitionBy("row").orderBy("start", "end", "kind")
    reach = F.max("end").over(ordered.rowsBetween(Window.unboundedPreceding, -1))
    starts = chosen.withColumn("apart", F.coalesce(F.col("start") >= reach, F.lit(True)).cast("int"))
    chains = starts.withColumn("chain", F.sum("apart").over(ordered.rowsBetween(Window.unboundedPreceding, 0)))
    rank = Window.partitionBy("row", "chain").orderBy(F.desc("score"), F.desc(F.col("end") - F.col("start")), "start", "kind")
    best = chains.withColumn("rank", F.row_number().over(rank)).where("rank = 1")
    return best.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("start", "end", "kind", "said"))).alias("added"))


def _found(docs: DataFrame, row: str, id_col: str, text_col: str) -> DataFrame:
    """(row, doc_id, base, added) of addressed documents."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(row).alias("row"), F.col(id_col).cast("long").alias("doc_id"), text.alias("text"))
    found = written(rows.select("row", "doc_id", base_spans(F.col("text")).alias("base"), candidates(F.col("text")).alias("found")))
    marks = written(_marked(found))
    model, limits = fit(found, marks)
    limit = reduce(lambda c, k: F.when(F.col("kind") == k, limits[k]).otherwise(c), limits, F.lit(2.0))
    loose = marks.where("not base and not meets").withColumn("score", F.round(score(model, _features({c: F.col(c) for c in ("kind", "said", "left", "after")})), 2))
    added = _best(loose.where(F.col("score") >= limit))
    plain = lambda c: F.transform(c, lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["said"].alias("said")))
    none = F.array().cast("array<struct<kind:string,start:int,end:int,said:string>>")
    return found.join(added, "row", "left").select("row", "doc_id", plain(F.col("base")).alias("base"), F.coalesce(plain(F.col("added")), none).alias("added"))


def _listed(spans: Column) -> Column:
    """Spans as kind:start:end, comma-joined, by kind as listed, then start."""
    rank = F.transform(spans, lambda s: F.struct(F.array_position(F.array(*map(F.lit, ADDED_KINDS)), s["kind"]), s["start"], s["end"], s["kind"].alias("kind")))
    return F.array_join(F.transform(F.array_sort(rank), lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Find personal data in every whole text.

    Returns doc_id, base (spans of the exact kinds) and added (candidates that the trees
    select and that meet no base span; of candidates that overlap, the best by score, then by length
    and place), one row for each input row, whatever its identifier. Null and empty texts have no spans; repeated rows give
    repeated results; no rows give none; other columns are ignored.
    """
    docs, row = addressed(docs)
    return _found(docs, row, id_col, text_col).drop("row")


def pii_digest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts and digests of :func:`find_pii`: the columns of the query."""
    found = find_pii(docs, id_col, text_col)
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    return found.select(
        "doc_id",
        *[count(k).alias(f"n_{k}") for k in KINDS],
        F.sha2(_listed(F.col("base")), 256).alias("base_sha256"),
        _listed(F.concat("base", "added")).alias("spans"),
        F.size("added").cast("long").alias("n_added"),
    )


def replaced(text: Column, spans: Column) -> Column:
    """A text with its spans (kind, start, end) replaced by their kind in angle brackets; what overlaps merges under the first kind.

    The text is first cut in stretches, so that each piece costs its own length and not its place in the text.
    """
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
    whole = F.struct(stretches(text).alias("cut"), F.length(text).alias("n"), ordered.alias("spans"))

    def parts(w: Column, reach: Column) -> Column:
        def part(s: Column, i: Column) -> Column:
            at = F.get(reach, i)
            tag = F.when((i == 0) | (s["start"] >= at), F.concat(F.lit("<"), s["kind"], F.lit(">"))).otherwise("")
            return F.concat(between(w["cut"], at, s["start"]), tag)

        return F.concat(F.array_join(F.transform(w["spans"], part), ""), between(w["cut"], F.element_at(reach, -1), w["n"]))

    ends = lambda w: F.transform(w["spans"], lambda s: s["end"])
    return bind(whole, lambda w: bind(running(ends(w), F.greatest), lambda reach: parts(w, reach)))


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with every span of the texts replaced by its kind in angle brackets; columns and rows stay as they are, a null text too.

    Rows are matched by their place and not by identifier, so repeated and null identifiers make no difference.
    """
    names = docs.columns
    docs, row = addressed(docs)
    found = _found(docs, row, id_col, text_col).select(F.col("row").alias("_r"), F.concat("base", "added").alias("_s")).where(F.size("_s") > 0)
    spans, key = fresh(docs, "_spans"), fresh(docs, "_key")
    both = docs.join(found.withColumnsRenamed({"_r": key, "_s": spans}), F.col(row) == F.col(key), "left")
    text = F.when(F.col(spans).isNull(), F.col(text_col)).otherwise(replaced(F.col(text_col), F.col(spans)))
    return both.select(*[text.alias(c) if c == text_col else F.col(c) for c in names])
