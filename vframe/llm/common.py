"""Plumbing shared by the operators of this folder.

Everything here is lazy or writes to the shared checkpoint folder, so a lost
executor costs a recomputation and never a result.
"""

from __future__ import annotations

import atexit
import operator
import tempfile
import uuid
from collections.abc import Callable

from pyspark import SparkContext
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()
#: Bits of the map that :func:`sifted` broadcasts, at most: 2**20 words of 64.
SIFT_BITS = 1 << 26


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of a data folder, read by Spark alone (the path may be in any store)."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def ascii_lower(column: Column) -> Column:
    """Lower-case A-Z and nothing else."""
    return F.translate(column, UPPER, LOWER)


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; a temporary one only where it is unset and all runs on one machine, as in tests."""
    context = spark.sparkContext
    configured = context.getConf().get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if context.getCheckpointDir() is None:
        if not context.master.startswith("local[") and context.master != "local":
            raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="vframe-"))
    return context.getCheckpointDir().rstrip("/")


#: Folders written by this process and not yet deleted, in order.
_folders: dict[str, None] = {}


def written(df: DataFrame, codec: str = "snappy") -> DataFrame:
    """Cut the lineage: write ``df`` once to the shared folder and read it back.

    Unlike an eager checkpoint this runs the last stage once, and the
    files outlive the executors that wrote them. What no one discards goes when the process ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/vframe-{uuid.uuid4().hex}"
    if not _folders:
        atexit.register(_leave)
    _folders[path] = None
    df.write.parquet(path, compression=codec)
    return spark.read.schema(df.schema).parquet(path)


def _delete(path: str) -> None:
    context = SparkContext._active_spark_context
    if context is not None and context._jvm is not None:
        folder = context._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(context._jsc.hadoopConfiguration()).delete(folder, True)
        _folders.pop(path, None)


def _leave() -> None:
    for path in list(_folders):
        _delete(path)


def discard(*frames: DataFrame) -> None:
    """Delete the files behind frames made by :func:`written`; they must not be read again."""
    for df in frames:
        names = {name.rpartition("/")[0].rpartition("/")[2] for name in df.inputFiles()}
        for path in [p for p in _folders if p.rpartition("/")[2] in names]:
            _delete(path)


def mark() -> set[str]:
    """What is written so far, for :func:`sweep`."""
    return set(_folders)


def sweep(since: set[str], *needed: DataFrame) -> None:
    """Delete what was written since a :func:`mark` but for the files that the frames ``needed`` read."""
    names = {name.rpartition("/")[0].rpartition("/")[2] for df in needed for name in df.inputFiles()}
    for path in [p for p in _folders if p not in since and p.rpartition("/")[2] not in names]:
        _delete(path)


def fresh(df: DataFrame, name: str) -> str:
    """``name``, with underscores put before it until no column of ``df`` has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def addressed(docs: DataFrame) -> tuple[DataFrame, str]:
    """``docs`` with an address for each row, and the address column's name, which was free.

    The address is the row's place in a Parquet file, so that it is the same at every reading, whichever
    executors are left. A frame that isn't itself a table of such files is written first.
    """
    name = fresh(docs, "_row")
    plan = docs._jdf.queryExecution().analyzed()
    if plan.getClass().getSimpleName() != "LogicalRelation" or "parquet" not in plan.relation().toString().lower():
        docs = written(docs)
    place = docs.metadataColumn("_metadata")
    return docs.select("*", F.struct(F.xxhash64(place["file_path"]).alias("file"), place["row_index"].alias("at")).alias(name)), name


def running(numbers: Column, join: Callable[[Column, Column], Column] = operator.add) -> Column:
    """The sums of the first 0, 1, 2 and so on elements of an array, by doubling steps: n log n, where appending would be n squared.

    ``join`` may be another associative function for which zero changes nothing, such as the maximum of positive numbers.
    """
    steps = F.transform(F.sequence(F.lit(0), F.ceil(F.log2(F.size(numbers) + 1)).cast("int")), lambda k: F.call_function("shiftleft", F.lit(1), k))
    start = F.concat(F.array(F.lit(0)), numbers)
    return F.aggregate(steps, start, lambda a, k: F.transform(a, lambda x, i: join(x, F.when(i >= k, F.get(a, i - k)).otherwise(F.lit(0)))))


def bind(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is worked out once, however often ``use`` names it: lambdas are not searched for common expressions."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


#: Code points of a stretch that texts are cut by.
STRETCH = 1024


def stretches(text: Column) -> Column:
    """A text in stretches of STRETCH code points, for :func:`between`."""
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{STRETCH}}}"), F.lit(0))


def between(cut: Column, a: Column, b: Column) -> Column:
    """The code points of a text in stretches from ``a`` to before ``b``: this costs a piece's own length, and not its place in the text."""
    first = F.floor(a / STRETCH).cast("int")
    some = F.slice(cut, first + 1, F.floor((b - 1) / STRETCH).cast("int") - first + 1)
    return F.when(b > a, F.substr(F.array_join(some, ""), a % STRETCH + 1, b - a)).otherwise("")


def width(spark: SparkSession) -> int:
    """The number of shuffle partitions in force."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def sifted(rows: DataFrame, keys: DataFrame, key: str, rest: bool = False) -> DataFrame:
    """The ``rows`` whose hashed key (a long) is in ``keys``, and some others: for use before an exact join. Keys have to be hashes.

    The keys set the bits of a map of at most SIFT_BITS, which is broadcast as words of 64. Rows
    whose bit is unset go before they are shuffled. Beyond as many keys as bits the map would let nearly
    every row through, so rows are passed on as they are.
    """
    n = keys.count()
    if n > SIFT_BITS:
        return rows.where("false") if rest else rows
    bits = min(SIFT_BITS, max(1 << 12, 1 << (64 * n).bit_length()))
    # Nothing here can be null where the key can't, else the join would test the key for null and work it out twice.
    word = lambda c: F.shiftright(F.col(c).bitwiseAND(F.lit(bits - 1)), 6).cast("int")
    bit = lambda c: F.call_function("shiftleft", F.lit(1).cast("long"), F.col(c).bitwiseAND(F.lit(63)).cast("int"))
    table = keys.select(word(key).alias("_word"), bit(key).alias("_bit")).groupBy("_word").agg(F.bit_or("_bit").alias("_bits"))
    marked = rows.withColumn("_word", word(key)).join(F.broadcast(table), "_word", "left" if rest else "inner")  # bounded: SIFT_BITS / 64 rows
    met = F.col("_bits").bitwiseAND(bit(key)) != 0
    return marked.where(~F.coalesce(met, F.lit(False)) if rest else met).drop("_word", "_bits")


def attach(rows: DataFrame, lookup: DataFrame, keys: str | list[str], salt_by: str | Column) -> DataFrame:
    """Left-join ``lookup`` (unique by ``keys``) to ``rows``, whose keys may be hot.

    The rows of a key are split over as many salts as there are shuffle
    partitions. One row for each (key, salt) meets the lookup, and the rows then
    join that on both, so no task gets more than its share of a key.
    """
    keys, parts = [keys] if isinstance(keys, str) else keys, max(64, width(rows.sparkSession))
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64(F.lit(17), salt_by), F.lit(parts)).cast("int"))
    met = salted.select(*keys, "_salt").distinct().join(lookup, keys, "left")
    return salted.join(met, [*keys, "_salt"], "left").drop("_salt")


def keep_rows(docs: DataFrame, name: str, kept: DataFrame) -> DataFrame:
    """The rows of addressed ``docs`` whose address is in column ``row`` of ``kept``, without the address; addresses are unique, so none is hot."""
    wanted = kept.select(F.col("row").alias(fresh(docs, "_wanted"))).hint("shuffle_hash")
    return docs.join(wanted, docs[name] == wanted[wanted.columns[0]], "left_semi").drop(name)


def components(edges: DataFrame) -> DataFrame:
    """Connected components of ``edges`` (a long, b long) as (node, component = smallest node).

    Alternating large-star and small-star rounds; each groups by a node with map-side minima and gives
    each edge its node's minimum by a salted join, so a hub costs no task more than its share. Each
    round's edges go to the shared folder. Nodes without an edge are not returned.
    """
    def summed(frame: DataFrame) -> tuple[DataFrame, tuple]:
        """A round's edges, written, with their number and a sum of their hashes, which are taken while they are written."""
        seen = Observation()
        hashes = F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))
        out = written(frame.observe(seen, F.count(F.lit(1)).alias("n"), hashes.alias("hashes")))
        return out, (seen.get["n"], seen.get["hashes"])

    edges, before = summed(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    while before[0]:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = (
            attach(both, least, "u", "v")
            .where("v > u")
            .select(F.col("v").alias("u"), F.col("m").alias("v"))
            .distinct()
        )
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = attach(large, least, "u", "v").select("u", "v", "m")
        after_round, after = summed(
            small.select("u", F.col("m").alias("v"))
            .unionByName(small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")))
            .distinct()
        )
        discard(edges)
        edges = after_round
        if after == before:
            break
        before = after
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )
