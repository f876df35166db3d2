"""The ten operators against brute force, round trips and held-out labels, on small tables with odd rows."""

import hashlib
import random
import re
from fractions import Fraction
from functools import reduce
from itertools import combinations, product
from pathlib import Path

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vframe.llm import chat_format, embedding_dedup, exact_dedup, license_scan, line_dedup, mixing, packing, pii, simhash_dedup, toxicity
from vframe.llm import common, queries
from vframe.llm.common import table
from vframe.llm.queries import TOKENIZER

DATA = "/root/testdata/sf0.001"

WORDS = "the cat sat on a mat while rain fell over hills and rivers near old stone walls of town".split()
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _salt string, h string, key long"


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


@pytest.fixture(scope="module")
def texts():
    rnd = random.Random(4)
    base = [" ".join(rnd.choice(WORDS) for _ in range(rnd.randint(3, 60))) for _ in range(40)]
    out = [*base, *base[:5], *[b.upper() for b in base[:3]], *[f"{b} end" for b in base[:8]], None, "", " \n", "<|endoftext|> x", "a" * 5000, " ".join(WORDS * 300)]
    return out + [base[0]] * 30


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(i, t, None, ["hot", "b", None][i % 7 % 3], None, "x", "y", 1) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_no_rows(empty, spark):
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    results = [
        toxicity.toxicity(empty, labels), exact_dedup.exact_dedup(empty), simhash_dedup.simhash_dedup(empty), line_dedup.line_dedup(empty),
        pii.pii_digest(empty), license_scan.scan_licenses(empty), mixing.mix(empty), packing.pack(empty, *TOKENIZER),
        embedding_dedup.embedding_dedup(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")),
    ]
    assert [r.count() for r in results] == [0] * len(results)


@pytest.mark.parametrize("keep", ["largest", "smallest"])
def test_exact_dedup(docs, texts, keep):
    groups = {}
    for i, t in enumerate(texts):
        groups.setdefault(lower(t), []).append(i)
    rows = {r["doc_id"]: r for r in exact_dedup.exact_dedup(docs, keep=keep).collect()}
    assert len(rows) == len(texts)
    for text, ids in groups.items():
        for i in ids:
            kept = max(ids) if keep == "largest" else min(ids)
            assert (rows[i]["keep_id"], rows[i]["group_size"], rows[i]["kept"]) == (kept, len(ids), i == kept)
            assert rows[i]["text_sha256"] == hashlib.sha256(text.encode()).hexdigest()
    assert exact_dedup.drop_copies(docs).columns == docs.columns


CLASHES = ["_row", "row", "key", "h", "g", "_wanted", "_salt", "dropped", "start", "end", "base", "found", "spans", "_spans", "_key", "fp", "id", "addr", "class", "first", "_slot", "source2", "hash", "range", "file", "at", "n", "score"]


@pytest.fixture(scope="module")
def clashing(spark):
    texts = ["mail a@b.org now", "mail a@b.org now", None, "", " \n", "x" * 70_000 + " end", "one two three four five six seven eight\nsame line of text", "One two three four five six seven eight\nsame line of text"]
    rows = [(i % 7 or None, t, "hot" if i % 3 else None, *[f"{c}{i}" for c in CLASHES], {"k": i}) for i, t in enumerate(texts * 3)]
    return spark.createDataFrame(rows, f"doc_id long, text string, source string, {', '.join(f'{c} string' for c in CLASHES)}, extra map<string,int>")


def test_clashing_names_and_odd_rows(spark, clashing):
    labels = spark.createDataFrame([(1, 0, "x"), (None, 1, "x"), (2, None, "x"), (3, 7, "x")], "doc_id long, toxic int, id string")
    same = [mixing.in_mixed_order(clashing), toxicity.drop_toxic(clashing, labels), pii.redact(clashing), line_dedup.drop_lines(clashing)]
    fewer = [exact_dedup.drop_copies(clashing), simhash_dedup.drop_near_copies(clashing)]
    assert all(x.columns == clashing.columns for x in [*same, *fewer])
    assert [x.count() for x in same] == [24] * 4 and [x.count() for x in fewer] == [5, 4]
    assert sorted(map(str, same[0].collect())) == sorted(map(str, clashing.collect())) == sorted(map(str, same[1].collect()))
    queries_ = [
        toxicity.toxicity(clashing, labels), exact_dedup.exact_dedup(clashing), simhash_dedup.simhash_dedup(clashing), line_dedup.line_dedup(clashing),
        pii.pii_digest(clashing), license_scan.scan_licenses(clashing), toxicity.restored_texts(clashing, labels), mixing.mix(clashing),
    ]
    assert [x.count() for x in queries_] == [24] * len(queries_)
    assert packing.pack(clashing, *TOKENIZER).groupBy("doc_id").count().count() == 7


def test_empty_tables_of_changed_frames(spark, clashing):
    none, labels = clashing.where("false"), spark.createDataFrame([], "doc_id long, toxic int")
    made = [mixing.in_mixed_order(none), toxicity.drop_toxic(none, labels), pii.redact(none), line_dedup.drop_lines(none), exact_dedup.drop_copies(none), simhash_dedup.drop_near_copies(none)]
    assert [(x.count(), x.columns) for x in made] == [(0, clashing.columns)] * len(made)


def test_intermediates_are_deleted(spark):
    since = common.mark()
    d = common.written(spark.range(10))
    e = common.written(spark.range(3))
    common.sweep(since, e)
    assert common.mark() - since == {p for p in common.mark() if p.rpartition("/")[2] in e.inputFiles()[0]} and e.count() == 3
    common.discard(e)
    assert common.mark() == since and d is not None


def test_merged_runs_fold(monkeypatch, spark):
    monkeypatch.setattr(exact_dedup, "RUN", 7)
    monkeypatch.setattr(exact_dedup, "SLICE", 2)
    rnd = random.Random(3)
    rows = [(rnd.choice([None, *range(9)]), rnd.choice(["a", "B", "b", "", None, "x" * 500_000])) for _ in range(400)]
    groups = {}
    for i, t in rows:
        groups.setdefault(lower(t), []).append(i)
    d = spark.createDataFrame(rows, "doc_id long, text string").repartition(11)
    for r in exact_dedup.exact_dedup(d).collect():
        ids = next(x for t, x in groups.items() if hashlib.sha256(t.encode()).hexdigest() == r["text_sha256"])
        least = min((i for i in ids if i is not None), default=None)
        assert (r["keep_id"], r["group_size"], r["kept"]) == (least, len(ids), r["doc_id"] == least)
    kept = exact_dedup.drop_copies(d, keep="smallest").collect()
    assert sorted(lower(r["text"]) for r in kept) == sorted(groups)


def test_running(spark):
    rows = spark.createDataFrame([([3, 4, 5, 1],), ([],), (list(range(100)),)], "n array<int>").select("n", common.running("n").alias("sums"))
    assert all(r["sums"] == [sum(r["n"][:i]) for i in range(len(r["n"]) + 1)] for r in rows.collect())


def test_rows_without_identifier(spark):
    d = spark.createDataFrame([(None, "a"), (1, "a"), (None, "b"), (1, "a")], "doc_id long, text string")
    rows = sorted((r["text_sha256"][:4], str(r["doc_id"]), r["group_size"], r["kept"]) for r in exact_dedup.exact_dedup(d).collect())
    a, b = (hashlib.sha256(x.encode()).hexdigest()[:4] for x in "ab")
    assert rows == sorted([(a, "1", 3, True), (a, "1", 3, True), (a, "None", 3, False), (b, "None", 1, True)])
    assert simhash_dedup.simhash_dedup(d).count() == 4


def plain_components(n, links):
    root = list(range(n))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in links:
        a, b = top(a), top(b)
        root[max(a, b)] = min(a, b)
    return [top(i) for i in range(n)]


def test_simhash(docs, texts):
    prints = [simhash_dedup.fingerprint(t) for t in texts]
    links = [(i, j) for i, j in combinations(range(len(prints)), 2) if (prints[i] ^ prints[j]).bit_count() <= 3]
    rows = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in simhash_dedup.simhash_dedup(docs).collect()}
    assert rows == {i: (f"{prints[i]:016x}", c) for i, c in enumerate(plain_components(len(prints), links))}


def test_simhash_bucket_chunks(spark, monkeypatch):
    monkeypatch.setattr(simhash_dedup, "BUCKET", 4)
    rnd = random.Random(1)
    prints = sorted({rnd.getrandbits(6) << rnd.choice([0, 20, 58]) for _ in range(60)})
    signed = [p - 2**64 if p >= 2**63 else p for p in prints]
    frame = spark.createDataFrame([(p,) for p in signed], "fp long")
    found = [(signed.index(r["a"]), signed.index(r["b"])) for r in simhash_dedup.simhash_links(frame).collect()]
    links = [(i, j) for i, j in combinations(range(len(prints)), 2) if (prints[i] ^ prints[j]).bit_count() <= 3]
    assert set(map(tuple, map(sorted, found))) <= set(links)
    assert plain_components(len(prints), found) == plain_components(len(prints), links)


def test_pivot_distances_bound_the_hamming_distance():
    rnd = random.Random(6)
    prints = [rnd.getrandbits(64) for _ in range(200)]
    prints += [p ^ sum(1 << b for b in rnd.sample(range(64), rnd.randint(1, 5))) for p in prints]
    fp = np.array(prints, np.uint64)
    table = np.array([[[((p ^ v) & m).bit_count() for v in simhash_dedup.pivots()] for m in simhash_dedup._masks()] for p in prints], np.int8)
    for x in range(0, 400, 7):
        want = [(prints[x] ^ p).bit_count() <= 3 for p in prints]
        assert simhash_dedup._near(table, fp, x, np.arange(400)).tolist() == want


def test_pivot_table_unpacks(spark):
    prints = [0, 1, -1, 2**62, -(2**63)]
    rows = simhash_dedup.with_distances(spark.createDataFrame([(p,) for p in prints], "fp long")).collect()
    table = simhash_dedup._unpacked(np.array([[r[f"block{i}"] for i in range(6)] for r in rows]))
    assert table.tolist() == [[[((r["fp"] ^ v) % 2**64 & m).bit_count() for v in simhash_dedup.pivots()] for m in simhash_dedup._masks()] for r in rows]


def test_rows_without_identifier_link(spark):
    near = " ".join(WORDS * 30)
    d = spark.createDataFrame([(None, near), (4, near), (None, "x y z"), (7, near + " end"), (7, near), (7, near)], "doc_id long, text string")
    rows = simhash_dedup.simhash_dedup(d).collect()
    assert sorted(str(r["component_id"]) for r in rows) == ["4"] * 5 + ["None"]
    assert sorted(map(str, simhash_dedup.drop_near_copies(d).collect())) == sorted(map(str, [d.collect()[1], d.collect()[2]]))


def test_packing(docs, texts):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    pieces = packing.pack(docs, *TOKENIZER).toPandas()
    import zlib

    for doc, mine in pieces.sort_values("start").groupby("doc_id"):
        ids = np.array([*plain.encode(texts[doc] or "", add_special_tokens=False).ids, 0], "<u4")
        assert mine.length.sum() == len(ids) == mine.doc_tokens.iloc[0]
        for p in mine.itertuples():
            assert p.ids_crc32 == zlib.crc32(ids[p.start : p.start + p.length].tobytes())
    for _, window in pieces.sort_values("offset").groupby("sequence_id"):
        total = window.length.sum()
        assert (window.offset == window.length.cumsum() - window.length).all() and total <= 1024 and total & (total - 1) == 0
    assert set(pieces.doc_id) == set(range(len(texts)))


@pytest.mark.parametrize("text", [" " * 1_000_000, "\n" * 1_000_000, "x\t" + "\t" * 1_000_000 + "y", "a" * 10_000_000], ids=["blanks", "newlines", "tabs", "letters"])
def test_packing_takes_very_long_texts(spark, text):
    pieces = packing.pack(spark.createDataFrame([(1, text), (2, "end")], "doc_id long, text string"), *TOKENIZER).toPandas()
    assert (pieces.groupby("doc_id").length.sum() == pieces.groupby("doc_id").doc_tokens.first()).all() and pieces.doc_tokens.max() > 400_000


def test_step_groups_are_balanced(docs):
    pieces = packing.pack(reduce(DataFrame.unionAll, [docs] * 6).coalesce(1), *TOKENIZER).toPandas()
    sums = pieces.groupby("step_group").length.sum()
    assert len(sums) > 2 and (sums == packing.STEP_TOKENS).sum() >= len(sums) - 1 and sums.max() == packing.STEP_TOKENS


def test_steps_fill_groups_from_any_windows():
    rnd, dealt = random.Random(2), {}
    steps = packing.Steps(lambda window, group: dealt.setdefault(group, []).append(window))
    sizes = [rnd.choice(packing.TIERS) for _ in range(900)] + [1, 2, 8, 32]
    for size in sizes:
        steps.add(packing.tier_of(size), size, size)
    steps.finish()
    sums = [sum(g) for _, g in sorted(dealt.items())]
    assert sorted(x for g in dealt.values() for x in g) == sorted(sizes)
    assert set(sums[:-1]) == {packing.STEP_TOKENS} and sums[-1] <= packing.STEP_TOKENS


def test_ranks_give_the_tokenizers_ids():
    from tokenizers import Tokenizer

    plain, ours, rnd = Tokenizer.from_file(TOKENIZER[0]), packing.Encoder(*TOKENIZER), random.Random(9)
    signs = ["a", "B", " ", "  ", "\n", "'s", "1", "é", "😀", "<|endoftext|>", "\t", ".", "　"]
    for _ in range(3000):
        text = "".join(rnd.choice(signs) for _ in range(rnd.randint(0, 30)))
        assert ours.ids(text)[:-1].tolist() == plain.encode(text, add_special_tokens=False).ids


def test_mixing_stays_within_a_block(docs, spark):
    rows = spark.range(4000).selectExpr("id AS doc_id", "CASE WHEN id % 3 = 0 THEN 'hot' WHEN id % 3 = 1 THEN 'b' END AS source")
    weights = {"hot": 0.5, "b": 0.3, None: 0.2}
    out = mixing.mix(rows, weights).toPandas()
    assert len(out) == 4000 and not out.duplicated(["_slot", "_place"]).any()
    assert ((out._slot >= out._release) & (out._slot < out._deadline)).all()
    blocks = out.drop_duplicates(["_slot"]).sort_values("_slot")
    last = min(blocks[blocks.source.fillna("") == (s or "")]._slot.max() for s in weights)
    for s, w in weights.items():
        at = np.sort(blocks[blocks.source.fillna("") == (s or "")]._slot)
        for t in range(0, last, 7):
            assert abs((at < t).sum() - w * t) < 1
    assert mixing.in_mixed_order(docs).columns == docs.columns


def plain_schedule(parts, slots):
    """Earliest deadline first among released blocks, slot by slot."""
    period, done, out = sum(parts.values()), dict.fromkeys(parts, 0), []
    for slot in range(slots):
        due = {s: (-(-(done[s] + 1) * period // p), done[s] * period // p, s) for s, p in parts.items() if done[s] * period // p <= slot}
        s = min(due, key=due.get)
        out.append((s, done[s]))
        done[s] += 1
    return out


@pytest.mark.skipif(not Path(DATA).exists(), reason="the driver's tables aren't here")
def test_mixing_query_against_a_plain_scheduler(spark):
    out = queries.op9_mixing(spark, DATA).toPandas()
    sizes = out.groupby("source").size()
    parts = {s: max(1, round(mixing.PARTS * n**0.5 / sum(sizes**0.5))) for s, n in sizes.items()}
    blocks = {(s, b): set(x.slot) for (s, b), x in out.groupby(["source", "block"])}
    assert all(len(x) == 1 for x in blocks.values())
    slots = max(max(x) for x in blocks.values()) + 1
    want = {key: {slot} for slot, key in enumerate(plain_schedule(parts, slots)) if key in blocks}
    assert blocks == want and set(sizes.index) == set(parts) and len(set(parts.values())) == len(set(sizes))
    assert all(sorted(x.place) == list(range(len(x))) for _, x in out.groupby(["source", "block"]))
    assert len(out) == table(spark, DATA, "documents").count()


def test_mix_is_the_same_by_any_ranges(spark, monkeypatch):
    rows = spark.range(3000).selectExpr("id AS doc_id", "IF(id % 4 = 0, 'b', 'hot') AS source")
    first = sorted(map(tuple, mixing.mix(rows, {"b": 0.3}).collect()))
    for bits, most in ((1, 1 << 16), (2, 64)):
        monkeypatch.setattr(mixing, "RANGE_BITS", bits)
        monkeypatch.setattr(mixing, "RANGE_ROWS", most)
        assert sorted(map(tuple, mixing.mix(rows.repartition(5), {"b": 0.3}).collect())) == first


def test_mixing_weights():
    assert mixing.whole_parts({"a": 0.1, "b": 0.2, "c": Fraction(1, 7)}) == {"a": 7, "b": 14, "c": 10}
    with pytest.warns(UserWarning, match="rounded"):
        small = mixing.whole_parts({"a": 1e-9, "b": 1.0})
    assert small["a"] == 1 and sum(small.values()) >= mixing.PERIOD
    for bad in ({}, {"a": 0.0}, {"a": -1}, {"a": float("nan")}, dict.fromkeys(map(str, range(mixing.SOURCES + 1)), 1)):
        with pytest.raises(ValueError):
            mixing.whole_parts(bad)


def test_mixing_keeps_clashing_columns(spark):
    rows = [(i % 9 or None, "s", "h", i, {"k": i}, 5, None) for i in range(300)]
    d = spark.createDataFrame(rows, "doc_id long, _source string, _hash string, row int, range map<string,int>, _slot int, source string")
    assert sorted(map(str, mixing.in_mixed_order(d).collect())) == sorted(map(str, d.collect()))
    out = mixing.mix(d, {None: 0.7})
    assert out.columns == [c for c in d.columns if c != "_slot"] + list(mixing.ADDED) and out.select("_slot", "_place").distinct().count() == 300


def pii_of(text):
    out = []
    patterns = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}
    for kind, pattern in patterns.items():
        for m in re.finditer(pattern, text):
            d = [int(c) for c in m[0] if c in "0123456789"]
            luhn = sum(sum(divmod(2 * x, 10)) if i % 2 else x for i, x in enumerate(reversed(d))) % 10 == 0
            good = {"email": True, "ip": all(int(x) < 256 for x in m[0].split(".")) if kind == "ip" else 0, "card": 13 <= len(d) <= 19 and luhn, "phone": 9 <= len(d) <= 15}
            if good[kind]:
                out.append(f"{kind}:{m.start()}:{m.end()}")
    return ",".join(out)


def test_pii(spark):
    rnd = random.Random(3)
    some = ["".join(rnd.choice("ab@..-_%+ 10234567(): 9😀é") for _ in range(rnd.randint(0, 90))) for _ in range(400)]
    some += ["x@y.com_z@w.org a@b.c..d 1.2.3.004 4111 1111 1111 1111 +1 (555) 010-9999", "5" * 9000, "a.b@" * 500, "+1 (((" * 500, None, ""]
    rows = pii.pii_digest(spark.createDataFrame(list(enumerate(some)), "doc_id long, text string")).collect()
    assert len(rows) == len(some)
    for r in rows:
        base = pii_of(some[r["doc_id"]] or "")
        assert r["base_sha256"] == hashlib.sha256(base.encode()).hexdigest()
        assert set(filter(None, base.split(","))) <= set(r["spans"].split(","))


def planted(seed=1):
    rnd = random.Random(seed)
    d = lambda n: "".join(rnd.choice("0123456789") for _ in range(n))
    card = lambda: next(c for c in iter(lambda: "4" + d(15), None) if sum(sum(divmod(int(x) * (1 + i % 2), 10)) for i, x in enumerate(reversed(c))) % 10 == 0)
    name = lambda: "".join(rnd.choice("abcdefgh") for _ in range(6))
    some = lambda n: " ".join(rnd.choice(WORDS) for _ in range(n))
    known = [lambda: f"{name()}@{name()}.org", lambda: f"+1 ({d(3)}) 555-{d(4)}", card, lambda: f"{rnd.randint(1, 200)}.{rnd.randint(1, 200)}.{rnd.randint(1, 200)}.{rnd.randint(1, 200)}"]
    hidden = {
        "email": lambda: f"{name()} (at) {name()} (dot) org", "phone": lambda: f"({d(3)}) 555-{d(4)}",
        "card": lambda: (lambda c: f"{c[:4]}.{c[4:8]}.{c[8:12]}.{c[12:]}")(card()), "ip": lambda: f"{rnd.randint(1, 200)}[.]{rnd.randint(1, 200)}[.]{rnd.randint(1, 200)}[.]{rnd.randint(1, 200)}",
    }
    decoys = [lambda: f"{d(4)} {d(4)} {d(4)}", lambda: f"{rnd.randint(1900, 2030)}-0{rnd.randint(1, 9)}-1{rnd.randint(0, 9)} 1{rnd.randint(0, 9)}.30", lambda: "7" + d(20), lambda: (lambda c: f"{c[:4]}.{c[4:8]}.{c[8:12]}.{c[12:15]}{(int(c[15]) + 1) % 10}")(card())]
    texts, want = [], {}
    for i in range(900):
        text = some(12) + " "
        if i % 3 == 0:
            text += rnd.choice(known)()
        elif i % 3 == 1:
            text += rnd.choice(decoys)()
        elif i % 12 == 2:
            kind = rnd.choice(list(hidden))
            said = hidden[kind]()
            want[i] = (kind, len(text), len(text) + len(said))
            text += said
        texts.append(text + " " + some(12))
    return texts, want


def test_added_spans_on_planted_forms(spark):
    texts, want = planted()
    rows = pii.find_pii(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    added = {(r["doc_id"], s["kind"], s["start"], s["end"]) for r in rows for s in r["added"]}
    hits = {(i, k) for i, k, a, b in added if i in want and want[i][0] == k and a <= want[i][2] - 4 and b >= want[i][1] + 4}
    assert len(hits) >= 0.95 * len(want) and len(hits) >= 0.95 * len(added)


def test_pii_learns_from_every_example(spark):
    docs = spark.range(13_000).selectExpr("id AS row", "concat('u', id, '@h.org und ', 1000000 + id, ' x') AS text")
    found = common.written(docs.select("row", pii.base_spans(F.col("text")).alias("base"), pii.candidates(F.col("text")).alias("found")))
    examples = pii._examples(found, common.written(pii._marked(found)))
    assert {r["label"]: r["n"] for r in examples.groupBy("label").agg(F.sum("weight").alias("n")).collect()} == {0.0: 13_000, 1.0: 13_000}


def test_pii_finds_what_is_rare_among_many(spark):
    left = "CASE WHEN id % 10000 = 7 THEN 'token ' ELSE 'key for all of the doors of this house ' END"
    docs = spark.range(120_000).selectExpr("id AS doc_id", f"concat({left}, substr(sha2(string(id), 256), 1, 24)) AS text")
    rows = pii.find_pii(docs).where("size(added) > 0").collect()
    assert sorted((r["doc_id"], r["added"][0]["kind"]) for r in rows) == [(i, "secret") for i in range(7, 120_000, 10_000)]


def test_redact_by_row(spark):
    rows = [(None, "x a@b.org y", 1), (1, "mail c@d.org", 2), (1, "plain", 3), (2, None, 4), (3, "", 5), (4, "é😀 " * 900 + "1.2.3.4 end " * 3, 6)]
    out = {r["_spans"]: tuple(r) for r in pii.redact(spark.createDataFrame(rows, "doc_id long, text string, _spans int")).collect()}
    want = ["x <email> y", "mail <email>", "plain", None, "", "é😀 " * 900 + "<ip> end " * 3]
    assert out == {n: (i, t, n) for (i, _, n), t in zip(rows, want)}


def test_pii_in_one_long_text(spark):
    text = "call 1.2.3.4 or a@b.org, " * 4000 + "7 " * 200_000
    r = pii.pii_digest(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert r["n_ip"] == 4000 and r["n_email"] == 4000 and r["base_sha256"] == hashlib.sha256(pii_of(text).encode()).hexdigest()


def test_licences(spark):
    texts = ["All rights reserved. x, Licensed under CC BY-NC 4.0.", "Released under the MIT License.", "cc by cc by", None, "", "no licence", "Licensed under the Apache License, Version 2.0."]
    rows = {r["doc_id"]: r for r in license_scan.scan_licenses(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert rows[0]["base_labels"] == "cc-by,reserved" and "cc-by-nc" in rows[0]["labels"] and rows[0]["n_base"] == 2
    assert rows[1]["labels"] == "mit" and rows[1]["n_base"] == 0 and rows[1]["score"] == 1
    assert (rows[2]["n_base"], rows[2]["first_word"], rows[2]["last_word"]) == (2, 0, 2)
    assert rows[3]["n_words"] == 0 and rows[3]["first_word"] is None and rows[5]["labels"] == "" and rows[6]["labels"] == "apache"


def test_automaton_matches_substrings():
    rnd, texts = random.Random(2), [[1, 2, 3, 1, 2, 4], [2, 3, 5], [1, 2, 3, 5, 5], [2, 3, 5]]
    joined = [(t, k) for t, text in enumerate(texts) for k in range(len(text) + 1)]
    at = {p: i for i, p in enumerate(joined)}
    for least in (1, 2):
        machine = license_scan.Automaton(texts, least)
        for _ in range(300):
            words = [rnd.randint(1, 6) for _ in range(12)]
            want = set()
            for t, text in enumerate(texts):
                for i, k in product(range(12), range(len(text))):
                    if words[i] == text[k] and (i == 0 or k == 0 or words[i - 1] != text[k - 1]):
                        n = next((n for n in range(12) if i + n == 12 or k + n == len(text) or words[i + n] != text[k + n]), 12)
                        if n >= least:
                            want.add((i, at[t, k], n))
            got = machine.matches(words)
            assert len(got) == len(set(got)) and set(map(tuple, got)) == want


def test_chains_are_the_best_ones():
    rnd = random.Random(4)
    for _ in range(300):
        found = [license_scan.Match(rnd.randint(0, 20), rnd.randint(0, 12), rnd.randint(1, 5)) for _ in range(rnd.randint(1, 6))]
        most = 0
        for n in range(1, len(found) + 1):
            for some in combinations(sorted(found), n):
                covered, sound = some[0].length, True
                for b, m in zip(some, some[1:]):
                    lost = max(0, b.start + b.length - m.start, b.at + b.length - m.at)
                    sound &= lost < m.length and m.start + lost - b.start - b.length <= 3
                    covered += m.length - lost
                most = max(most, covered if sound else 0)
        got = license_scan.chains(found, 3)
        assert max(c for *_, c in got) == most
        spans = sorted(got)
        assert all(a[1] <= b[0] for a, b in zip(spans, spans[1:]))


def test_edited_notices_are_covered():
    scan = license_scan.Scanner().scan
    words = lambda text: license_scan.WORD.findall(text.lower())
    apache = license_scan.TEMPLATES["apache"][1]
    assert scan(words("x " + apache.replace("You may obtain a copy of the License at ", "") + " y"))["labels"] == "apache"
    for label, texts in license_scan.TEMPLATES.items():
        for text in texts:
            found = scan(words(f"Copyright 2020. {text} The end."))
            assert label in found["labels"].split(",") and found["score"] == 1.0
            cut = words(text)
            if len(cut) > 30:
                cut[12:14] = ["other", "words", "here"]
                assert label in scan(cut)["labels"].split(",")
    assert scan(words(license_scan.TEMPLATES["mit"][2]) * 300)["n_words"] > 40_000


@pytest.mark.skipif(not Path(DATA).exists(), reason="the driver's tables aren't here")
def test_licence_base_columns_against_sql(spark):
    import duckdb

    phrases = "(VALUES ('cc by', 'cc-by'), ('general public license', 'gpl'), ('all rights reserved', 'reserved')) AS p(phrase, label)"
    sql = f"""
        WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w
                   FROM '{DATA.replace("0.001", "0.01")}/documents.parquet'),
        e AS (SELECT doc_id, i, w, label, phrase FROM d, {phrases}, LATERAL (SELECT unnest(range(len(w))) AS i)),
        f AS (SELECT doc_id, i, label FROM e WHERE array_to_string(w[i + 1 : i + len(string_split(phrase, ' '))], ' ') = phrase)
        SELECT d.doc_id, len(w) AS n_words, count(f.i) AS n_base, min(f.i) AS first_word, max(f.i) AS last_word,
               coalesce(string_agg(DISTINCT f.label, ',' ORDER BY f.label), '') AS base_labels
        FROM d LEFT JOIN f ON d.doc_id = f.doc_id GROUP BY d.doc_id, w"""
    want = sorted(tuple(r) for r in duckdb.sql(sql).fetchall())
    found = queries.op8_license_scan(spark, DATA.replace("0.001", "0.01")).collect()
    assert sorted((r["doc_id"], r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) for r in found) == want
    assert all(set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(",")) for r in found)


LAYOUTS = {
    "messages array<struct<role:string,content:string>>": [("human", "hi <s:x>"), ("gpt", "a\\l</s>"), (None, None)],
    "conversations array<struct<from:string,value:string>>": [("user", "a"), ("model", "")],
}


@pytest.mark.parametrize("layout", LAYOUTS)
def test_chat_round_trip(spark, layout):
    rows = chat_format.read_back(chat_format.format_chat(spark.createDataFrame([(1, LAYOUTS[layout]), (2, None)], f"id long, {layout}"), "id")).collect()
    got = {r["id"]: r for r in rows}
    want = [(chat_format.ROLES.get(role, "user"), text or "") for role, text in LAYOUTS[layout]]
    assert [(t["role"], t["text"]) for t in got[1]["turns"]] == want and got[2]["turns"] == []
    assert [t["said"] for t in got[1]["turns"]] == [role or "user" for role, _ in LAYOUTS[layout]]
    assert got[1]["loss_texts"] == [t for r, t in want if r == "assistant"]


def test_chat_layouts(spark):
    d = spark.createDataFrame([(1, "do", None, "done")], "id long, instruction string, input string, output string")
    assert [(t["role"], t["text"]) for t in chat_format.canonical(d, "id").first()["turns"]] == [("user", "do"), ("assistant", "done")]
    with pytest.raises(ValueError):
        chat_format.canonical(d, "id", ["input"])


def test_layouts_differ_from_row_to_row(spark):
    schema = "id long, messages array<struct<role:string,content:string>>, conversations array<struct<`from`:string,value:string>>, prompt string, response string, system string, odd string"
    rows = [
        (1, [("human", "a"), ("GPT", "b")], None, None, None, None, None), (2, None, [("a=>b", "x"), (None, None)], None, None, None, None),
        (3, None, None, "p", "r", None, None), (4, None, None, "p", "r", "s", None), (5, None, None, None, None, None, "?"), (6, None, None, None, None, None, None),
        (7, [], None, None, None, None, None), (None, [(None, "only text")], None, None, None, None, None), (None, None, None, "", None, None, None),
        (8, [("user", "a"), ("assistant", "b")], None, "p", None, None, None),
    ]
    d = spark.createDataFrame(rows, schema)
    made = chat_format.format_chat(d, "id")
    got = sorted((str(r["id"]), str([(t["role"], t["text"], t["said"]) for t in r["turns"] or []]), str(r["loss_texts"])) for r in chat_format.read_back(made).collect())
    want = [
        ("1", [("user", "a", "human"), ("assistant", "b", "GPT")], ["b"]), ("2", [("a=>b", "x", "a=>b"), ("user", "", "user")], []),
        ("3", [("user", "p", "user"), ("assistant", "r", "assistant")], ["r"]), ("4", [("system", "s", "system"), ("user", "p", "user"), ("assistant", "r", "assistant")], ["r"]),
        ("5", [], None), ("6", [], []), ("7", [], []), ("None", [("user", "only text", "user")], []), ("None", [("user", "", "user")], []), ("8", [], None),
    ]
    assert got == sorted((i, str(t), str(x)) for i, t, x in want)
    assert {r["id"] for r in made.where("formatted is null").collect()} == {5, 8}
    assert made.where("formatted is not null").select("layout").distinct().count() == 7
    assert chat_format.chat_digest(d.where("false"), "id").count() == 0
    extra = d.where("id <= 4").withColumns({"_layout": F.lit("x"), "turns": F.lit(None).cast("string"), "rows": F.lit(1), "k": F.create_map(F.lit("a"), F.lit(1))})
    assert sorted(r["formatted"] for r in chat_format.format_chat(extra, "id").collect()) == sorted(r["formatted"] for r in made.where("id <= 4").collect())


def test_records_take_several_layouts(spark):
    said = [["user", "assistant"], ["system", "user", "assistant"], ["user"], ["user", "assistant", "user", "Bot"], ["a", "b"], [None, None, None]]
    rows = [(i, k, role, None if i % 5 == 0 else "".join(random.Random(i * k).choice("<>\\lge=é</s>") for _ in range(k * 700))) for i in range(60) for k, role in enumerate(said[i % 6])]
    d = spark.createDataFrame(rows + [(None, 0, "user", "x")], "conv_id long, turn long, role string, text string")
    records = chat_format.conversations_as_records(d)
    assert chat_format.canonical(records, "conv_id").select("layout").distinct().count() >= 6
    digest = {r["conv_id"]: r for r in chat_format.chat_digest(records, "conv_id").collect()}
    assert len(digest) == 61
    for i in range(60):
        mine = [(r[2] or "user", r[3] or "") for r in rows if r[0] == i]
        sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
        assert digest[i]["turns_sha256"] == sha("".join(f"{r}\n{t}\n" for r, t in mine))
        assert digest[i]["loss_sha256"] == sha("".join(t for r, t in mine if chat_format.ROLES.get(r.lower(), r) == "assistant"))


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


@pytest.mark.parametrize("most", [1 << 26, 1 << 12, 10])
def test_sifting_loses_no_key(spark, monkeypatch, most):
    monkeypatch.setattr(common, "SIFT_BITS", most)
    rows = spark.range(4000).selectExpr("xxhash64(id) AS h", "id")
    keys = rows.where("id % 50 = 0").select("h")
    passed = {r["id"] for r in common.sifted(rows, keys, "h").select("id").collect()}
    assert passed >= set(range(0, 4000, 50))
    assert len(passed) < 400 or most == 10
    assert common.sifted(rows, keys.limit(0), "h").count() == 0


@pytest.mark.parametrize("hot", [2048, 3])
def test_near_lines(spark, monkeypatch, hot):
    monkeypatch.setattr(line_dedup, "HOT", hot)
    rnd = random.Random(5)
    base = ["".join(rnd.choice("abé😀 x") for _ in range(rnd.randint(5, 24))) for _ in range(16)]
    lines = set(base)
    for b in base * 5:
        b = list(b)
        for _ in range(rnd.randint(0, 3)):
            k = rnd.randrange(len(b))
            b[k : k + rnd.randint(0, 1)] = rnd.choice(["", "a", "c"])
        lines.add("".join(b))
    lines = sorted(x for x in lines if x.strip())
    monkeypatch.setattr(line_dedup, "OFTEN", 2)
    every = spark.createDataFrame([(x,) for x in lines * 3], "line string")
    repeated = every.where("length(line) > 12").select(F.xxhash64("line").alias("h")).distinct()
    links, some = line_dedup.near_lines(every) if hot > 3 else line_dedup.near_lines(every, 2, repeated, every)
    place = {r["id"]: lines.index(r["line"]) for r in some.collect()}
    got = {tuple(sorted((place[r["a"]], place[r["b"]]))) for r in links.collect()}
    most = lambda a, b: min(2, min(len(a), len(b)) // 8)
    want = {(i, j) for i, j in combinations(range(len(lines)), 2) if edits(lines[i], lines[j]) <= most(lines[i], lines[j])}
    assert got == want and {most(lines[i], lines[j]) for i, j in want} == {1, 2}


def plain_line_dedup(rows):
    """Dropped places of each row, by comparing all lines; rows are in order of identifier and place."""
    lines = [(i, k, line) for i, (_, t) in enumerate(rows) for k, line in enumerate((t or "").split("\n")) if line.strip(" ")]
    links = [(x, y) for x, y in combinations(range(len(lines)), 2) if (a := lines[x][2]) == (b := lines[y][2]) or edits(a, b) <= min(2, min(len(a), len(b)) // 8)]
    group = plain_components(len(lines), links)
    out = [[] for _ in rows]
    for x, (i, k, _) in enumerate(lines):
        if group[x] != x:
            out[i].append(k)
    return out


def test_line_dedup_against_brute_force(spark, monkeypatch):
    for name, n in (("REPEATED", 2), ("SAMPLED", 2), ("OFTEN", 3)):
        monkeypatch.setattr(line_dedup, name, n)
    rnd = random.Random(11)
    pool = ["".join(rnd.choice("abc d") for _ in range(rnd.randint(3, 26))) for _ in range(30)]
    pool += [p[:5] + "x" + p[5:] for p in pool[:15]] + ["", " ", "ab", "é" * 2500, "é" * 2500 + "!"]
    rows = [(i, "\n".join(rnd.choice(pool) for _ in range(rnd.randint(1, 7)))) for i in range(40)] + [(50, None), (51, "")]
    d = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, dropped string, _gone int").coalesce(1)
    want = plain_line_dedup(rows)
    got = line_dedup.line_dedup(d).collect()
    assert sorted((str(r["doc_id"]), r["n_lines"], r["n_dropped"], r["dropped"]) for r in got) == sorted(
        (str(i), len((t or "").split("\n")), len(x), ",".join(map(str, x))) for (i, t), x in zip(rows, want)
    )
    left = [t if not x else "\n".join(line for k, line in enumerate(t.split("\n")) if k not in x) for (_, t), x in zip(rows, want)]
    out = line_dedup.drop_lines(d)
    assert out.columns == d.columns and sorted((str(r["doc_id"]), str(r["text"])) for r in out.collect()) == sorted((str(i), str(t)) for (i, _), t in zip(rows, left))


def test_lines_of_repeated_identifiers(spark):
    rows = [(None, "alpha\nsame"), (None, "beta\nsame"), (None, "gamma\nother"), (5, "one two\nsame"), (5, "three\nmore"), (5, "three\nmore")]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    lines = [line for r in line_dedup.drop_lines(d).collect() for line in r["text"].split("\n") if line]
    assert sorted(lines) == sorted({line for _, t in rows for line in t.split("\n")})
    assert line_dedup.line_dedup(d).count() == len(rows)


def test_line_dedup(spark):
    long = "this is a line of some length"
    d = spark.createDataFrame([(1, f"{long}\nx\n\n"), (2, f"y\n{long}!\n\nx"), (3, None)], "doc_id long, text string")
    rows = {r["doc_id"]: tuple(r)[1:] for r in line_dedup.line_dedup(d).collect()}
    assert rows == {1: (4, 0, 0, ""), 2: (4, 2, 1, "1,3"), 3: (1, 0, 0, "")}
    assert {r["text"] for r in line_dedup.drop_lines(d).collect()} == {f"{long}\nx\n\n", "y\n", None}


def test_embeddings(spark):
    rng = np.random.default_rng(0)
    centres = rng.normal(size=(40, 16))
    x = np.repeat(centres, 6, 0) + 0.06 * rng.normal(size=(240, 16))
    x[7] = x[8]
    rows = [(i, [float(np.float32(v)) for v in x[i]], i % 2 if i % 50 else None) for i in range(240)]
    rows += [(900, None, 1), (901, [0.0] * 16, 1), (902, [float("nan")] * 16, 1), (903, [], 1), (904, [1.0], 1)]
    out = {r["vec_id"]: r for r in embedding_dedup.embedding_dedup(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")).collect()}
    unit = {i: np.array(v, float) / np.linalg.norm(v) for i, v, l in rows[:240]}
    links = [(i, j) for i, j in combinations(range(240), 2) if rows[i][2] is not None and rows[i][2] == rows[j][2] and unit[i] @ unit[j] >= 0.98]
    found = sum(out[i]["n_links"] for i in range(240)) / 2
    assert links and 0.9 * len(links) <= found <= len(links)
    assert all(out[i]["n_links"] == 0 and out[i]["kept"] for i in range(900, 905)) and len(out) == 245


@pytest.mark.parametrize(("groups", "size", "loose"), [(7, 100, 0), (3, 200, 168)])
def test_embeddings_in_large_groups(spark, groups, size, loose):
    rng = np.random.default_rng(1)
    x = np.repeat(rng.normal(size=(groups, 64)), size, 0) + 0.08 * rng.normal(size=(groups * size, 64))
    x = np.concatenate([x, rng.normal(size=(loose, 64))]).astype(np.float32).astype(float)
    rows = [(i, v.tolist(), 1) for i, v in enumerate(x)]
    out = embedding_dedup.embedding_dedup(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")).collect()
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    links = (unit @ unit.T >= 0.98).sum() - len(x)
    assert links > groups * size and 0.95 * links <= sum(r["n_links"] for r in out) <= links


@pytest.mark.parametrize("overlap", [2, 0])
def test_embeddings_over_large_and_dense_shards(spark, monkeypatch, overlap):
    for name, n in (("SAMPLE", 64), ("SHARD", 40), ("LARGE", 60), ("CHUNK", 32), ("DEAL", 50), ("SHARD_SAMPLE", 100), ("OVERLAP", overlap)):
        monkeypatch.setattr(embedding_dedup, name, n)
    rng = np.random.default_rng(3)
    x = np.repeat(rng.normal(size=(60, 32)), 6, 0) + 0.08 * rng.normal(size=(360, 32))
    x = np.concatenate([x, rng.normal(size=32) + 0.05 * rng.normal(size=(300, 32))])
    rows = [(i, v.tolist(), 1) for i, v in enumerate(x)]
    out = embedding_dedup.embedding_dedup(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).toPandas().set_index("vec_id")
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = (unit @ unit.T >= 0.98) & ~np.eye(len(x), dtype=bool)
    got = out.loc[range(len(x))].n_links.to_numpy()
    assert (got <= near.sum(1)).all() and got.sum() >= (0.9 if overlap else 1.0) * near.sum() and got[360:].sum() == near[360:].sum()


def test_embeddings_in_double_precision_and_by_row(spark):
    rows = [(1, [1.0, -0.0, 2.0], 1), (2, [1.0, -0.0, 2.0], 1), (3, [1.0, 0.0, 2.0], 1), (5, [1e39, 1e39, 1.0], 2), (6, [1e39, 1e39, 1.0], 2)]
    rows += [(7, [1e-320, 0.0, 0.0], 2), (None, [1.0, 0.0, 2.001], 1), (9, [0.0, 1.0, 0.0], 1), (9, [1.0, 0.0, 2.0], 1), (10, [0.0, 1.0, 0.0], 1)]
    out = embedding_dedup.embedding_dedup(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).drop("audit_recall").collect()
    want = [(1, 4, 1, True), (2, 4, 1, False), (3, 4, 1, False), (None, 4, 1, False), (9, 4, 1, False), (9, 1, 9, True), (10, 1, 9, False)]
    want += [(5, 1, 5, True), (6, 1, 5, False), (7, 0, 7, True)]
    assert sorted(map(str, map(tuple, out))) == sorted(map(str, want))


def test_bridges_join_all_components():
    rng = np.random.default_rng(2)
    x = embedding_dedup._unit(pa.array(np.repeat(rng.normal(size=(9, 32)), 90, 0).tolist()) ) + 0.01 * rng.normal(size=(810, 32))
    near = embedding_dedup._pruned((x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32))
    assert set(plain_components(810, [(i, int(j)) for i, some in enumerate(near) for j in some])) == {0}


def test_toxicity_learns_and_restores(spark):
    rnd = random.Random(8)
    rows, labels = [], []
    for i in range(600):
        words = [rnd.choice(WORDS) + rnd.choice(["", "s", "ing"]) for _ in range(30)]
        if i % 5 == 0:
            words.insert(3, "grumbold")
        rows.append((i, " ".join(words)))
        labels.append((i, int(i % 5 == 0)))
    rows += [(1000, "the grumb01d cat"), (1001, "the g r u m b o l d cat"), (1002, "the grumb0ld cat"), (1003, "gruuumbold"), (1004, None), (1005, "")]
    out = {r["doc_id"]: r for r in toxicity.toxicity(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")).collect()}
    assert all(out[i]["predicted"] == y for i, y in labels)
    assert [out[i]["predicted"] for i in range(1000, 1006)] == [1, 1, 1, 1, 0, 0]
    docs, known = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    said = {r["doc_id"]: r["restored"] for r in toxicity.restored_texts(docs, known).collect()}
    assert "grumbold" in said[1001].split() and said[1002] == "the grumbold cat" and said[1004] == ""
    odd = docs.unionByName(spark.createDataFrame([(0, "the cat"), (None, "the cat"), (None, "grumbold sat")], "doc_id long, text string"))
    kept = [r["doc_id"] for r in toxicity.drop_toxic(odd, known).collect()]
    assert kept.count(0) == 1 and kept.count(None) == 1 and not set(kept) & {i for i, y in labels if y and i}


def every_path(token, model, spaced):
    """The best reading by trying all paths through the lattice."""
    best = None
    for path in product(*toxicity._arcs(token, spaced)):
        said, cost, x, y = "".join(p[0] for p in path), sum(p[1] for p in path), 0, 0
        for letter in said:
            z = toxicity._class_of(letter)
            cost += model.table[x, y, z]
            x, y = y, z
        best = max(best or (-1e9, ""), (cost + model.table[x, y, 0], said), key=lambda b: b[0])
    return best


@pytest.mark.parametrize("settle", [2, 1024])
def test_viterbi_finds_the_best_path(monkeypatch, settle):
    monkeypatch.setattr(toxicity, "SETTLE", settle)
    rnd = random.Random(7)
    model = toxicity.CharModel.of(np.random.default_rng(1).integers(0, 50, toxicity.ALPHABET**3))
    for _ in range(150):
        token = "".join(rnd.choice("ab1|6$l-  eé%") * rnd.randint(1, 3) for _ in range(rnd.randint(1, 7)))
        for spaced in (False, True):
            assert toxicity.decode(token, model, spaced) == every_path(token, model, spaced)[1]


def test_decoding_takes_time_in_proportion():
    model = toxicity.CharModel.of(np.ones(toxicity.ALPHABET**3))
    assert len(toxicity.decode("a1" * 150_000, model)) == 300_000


def test_toxicity_sees_through_the_gates(spark):
    rnd = random.Random(8)
    bad, rows, labels = ["grumbold", "zass", "fliddet"], [], []
    for i in range(900):
        words = [rnd.choice(WORDS) + rnd.choice(["", "s", "ing"]) for _ in range(30)]
        if i % 5 == 0:
            words.insert(3, bad[i // 5 % 3])
        rows.append((i, " ".join(words)))
        labels.append((i, int(i % 5 == 0)))
    hidden = ["what a g r u m b o l d", "f l i d d e t g r u m b o l d", "the za$$ sat", "ggrruummbboolldd", "fflliiddddeett", "the g r u m b o l d a cat"]
    clean = ["the cat sat on a wall", "over hills 1994 and 2,500 rivers!", "a b c d e f", "ffaallll over hills"]
    rows += [(1000 + i, x) for i, x in enumerate(hidden + clean)]
    out = {r["doc_id"]: r for r in toxicity.toxicity(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")).collect()}
    assert all(out[i]["predicted"] == y for i, y in labels)
    assert [out[1000 + i]["predicted"] for i in range(len(hidden + clean))] == [1] * len(hidden) + [0] * len(clean)
