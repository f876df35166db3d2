"""Text and message-log expressions: token estimates, truncation, merges and cut-offs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Code point ranges that count as ideographs, and the tokens of a sign.
WIDE = r"[\x{4E00}-\x{9FFF}\x{3400}-\x{4DBF}\x{3000}-\x{303F}\x{FF00}-\x{FFEF}]"
WIDE_TOKENS, OTHER_TOKENS, MESSAGE_TOKENS = 0.8, 0.3, 4
STRING_CAP, FINDINGS_CAP, BUDGET, HARD_LIMIT = 200, 12, 256_000, 1_000_000


def token_estimate(text: Column) -> Column:
    """Estimated tokens of a text, rounded half to even; null counts as empty."""
    text = F.coalesce(text, F.lit(""))
    narrow = F.length(F.regexp_replace(text, WIDE, ""))
    return F.rint((F.length(text) - narrow) * F.lit(WIDE_TOKENS) + narrow * F.lit(OTHER_TOKENS)).cast("long")


def truncated(text: Column, limit: int = STRING_CAP) -> Column:
    """The first ``limit`` code points and how many follow."""
    rest = F.length(text) - limit
    return F.when(rest > 0, F.concat(F.substr(text, F.lit(1), F.lit(limit)), F.lit("…[+"), rest.cast("string"), F.lit(" chars]"))).otherwise(text)


def token_buckets(messages: DataFrame, by: str = "conv_id") -> DataFrame:
    """Estimated tokens by role for each conversation; roles other than the three count nothing.

    Where the messages have a column tool_calls (JSON text, null without calls), an assistant's calls cost like its text.
    """
    calls = token_estimate(F.when(F.col("role") == "assistant", F.col("tool_calls"))) if "tool_calls" in messages.columns else F.lit(0)
    cost = token_estimate(F.col("text")) + calls + MESSAGE_TOKENS
    of = lambda role: F.coalesce(F.sum(F.when(F.col("role") == role, cost)), F.lit(0)).cast("long")
    return messages.groupBy(by).agg(of("user").alias("user"), of("assistant").alias("assistant"), of("tool").alias("tool_results"))


def utilisation(total: Column, budget: int = BUDGET) -> Column:
    """Share of a token budget, over 1 where it is exceeded; 0 without a budget."""
    return total.cast("double") / F.lit(float(budget)) if budget > 0 else F.lit(0.0)


def bar_fill(share: Column, width: int) -> Column:
    """Cells of a bar of ``width`` that a share fills, rounded half to even, from none to all."""
    return F.greatest(F.lit(0), F.least(F.lit(max(0, width)), F.rint(share * width).cast("int")))


def context_breakdown(messages: DataFrame, system: str = "", summary: str = "", tools: list[str] | None = None, factor: float = 1.0, by: str = "conv_id") -> DataFrame:
    """What fills each conversation's context: tokens by category, scaled by a calibration factor, their total and its share of the budget.

    ``system`` and ``summary`` are texts and ``tools`` the JSON texts of the tools' definitions, which all conversations share.
    """
    parts = {"system": [system], "summary": [summary], "tools": tools or []}
    shared = {k: reduce(lambda a, b: a + b, [token_estimate(F.lit(t)) for t in texts], F.lit(0)) for k, texts in parts.items()}
    raw = token_buckets(messages, by).withColumns(shared)
    names = ["system", "summary", "tools", "user", "assistant", "tool_results"]
    scaled = lambda c: F.rint(c * F.lit(float(factor))).cast("long")
    total = scaled(reduce(lambda a, b: a + b, map(F.col, names)))
    return raw.select(by, *[scaled(F.col(n)).alias(n) for n in names], total.alias("total"), utilisation(total).alias("utilisation"))


def calibrated(previous: Column, estimated: Column, actual: Column) -> Column:
    """Exponential mean of actual over estimated tokens, kept within 0.2 and 5; samples under 50 change nothing."""
    fresh = F.round(F.greatest(F.lit(0.2), F.least(F.lit(5.0), 0.3 * (actual / estimated) + 0.7 * previous)), 4)
    return F.when((estimated < 50) | (actual < 50) | actual.isNull() | estimated.isNull(), previous).otherwise(fresh)


def upsert_latest(updates: DataFrame, key: str, order: str) -> DataFrame:
    """For each key, the last non-null value of every other column by ``order``."""
    others = [c for c in updates.columns if c not in (key, order)]
    latest = [F.max_by(F.col(c), F.when(F.col(c).isNotNull(), F.col(order))).alias(c) for c in others]
    return updates.groupBy(key).agg(*latest)


def upsert_by_id(current: DataFrame, update: DataFrame, key: str = "id", order: str = "seq") -> DataFrame:
    """Entries with updates merged in, field by field: known identifiers change where the update says something, unknown ones are new.

    An update without an identifier is a new entry: those get the numbers after the largest known, in their order. Updates of one entry
    apply in order. The columns of ``current`` are all but ``order``.
    """
    known = current.agg(F.coalesce(F.max(key), F.lit(0)).alias("top")).unionByName(update.agg(F.coalesce(F.max(key), F.lit(0)).alias("top"))).agg(F.max("top")).first()[0]
    fresh = update.where(F.col(key).isNull()).withColumn(key, F.lit(known) + F.row_number().over(Window.orderBy(order)))  # a session's new entries
    first = current.withColumn(order, F.lit(None).cast(update.schema[order].dataType))
    every = first.unionByName(update.where(F.col(key).isNotNull()), True).unionByName(fresh, True)
    at = F.coalesce(F.col(order).cast("double"), F.lit(float("-inf")))
    others = [c for c in current.columns if c != key]
    latest = [F.max_by(F.col(c), F.when(F.col(c).isNotNull(), at)).alias(c) for c in others]
    return every.groupBy(key).agg(*latest)


def latest(updates: DataFrame, key: str, value: str, order: str) -> DataFrame:
    """The last value written for each key, null too."""
    return updates.groupBy(key).agg(F.max_by(F.struct(value), F.col(order))[value].alias(value))


def turns_added(updates: DataFrame, key: str, amount: str | None = None) -> DataFrame:
    """How many turns each key has: the sum of what updates add, one each where no amount is named."""
    return updates.groupBy(key).agg(F.sum(F.coalesce(F.col(amount), F.lit(1)) if amount else F.lit(1)).cast("long").alias("turns"))


# The fields of a memory and the names that a model may give them.
MEMORY = {"user_goal": ("user_goal", "用户目标"), "key_findings": ("key_findings", "关键发现"), "progress": ("progress", "进展")}


def parsed_memory(text: Column) -> Column:
    """A memory (user_goal, key_findings, progress) from a model's JSON text, code fences taken off; null if it isn't a JSON object.

    Findings given as one text are a list of one; blank findings go.
    """
    plain = F.trim(F.regexp_replace(F.trim(text), r"(?s)^```[^\n]*\n?(.*?)(\n```[^\n]*)?$", "$1"))
    tree = F.try_parse_json(plain)
    read = lambda name, kind: F.coalesce(*[F.try_variant_get(tree, f'$["{n}"]', kind) for n in MEMORY[name]])
    one = F.transform(F.array(read("key_findings", "string")), lambda f: f)
    findings = F.coalesce(read("key_findings", "array<string>"), one)
    said = F.filter(findings, lambda f: f.isNotNull() & (F.trim(f) != ""))
    memory = F.struct(F.coalesce(read("user_goal", "string"), F.lit("")).alias("user_goal"), said.alias("key_findings"), F.coalesce(read("progress", "string"), F.lit("")).alias("progress"))
    return F.when(F.startswith(F.schema_of_variant(tree), F.lit("OBJECT")), memory)


def rendered_memory(memory: Column) -> Column:
    """A memory as lines of text; empty fields are left out."""
    listed = F.array_join(F.transform(memory["key_findings"], lambda f: F.concat(F.lit("- "), f)), "\n")
    goal = F.when(memory["user_goal"] != "", F.concat(F.lit("Goal: "), memory["user_goal"]))
    findings = F.when(F.size(memory["key_findings"]) > 0, F.concat(F.lit("Findings:\n"), listed))
    progress = F.when(memory["progress"] != "", F.concat(F.lit("Progress: "), memory["progress"]))
    return F.concat_ws("\n", goal, findings, progress)


def merged_findings(old: Column, new: Column, cap: int = FINDINGS_CAP) -> Column:
    """Old then new findings without repeats, the last ``cap`` of them."""
    both = F.array_distinct(F.concat(old, new))
    return F.slice(both, F.greatest(F.size(both) - cap + 1, F.lit(1)), F.lit(cap))


def merged_text(old: Column, new: Column) -> Column:
    """The new text unless it is empty or null."""
    return F.coalesce(F.nullif(new, F.lit("")), old)


def history(messages: DataFrame) -> DataFrame:
    """User messages and assistant messages that say something."""
    return messages.where("role = 'user' OR (role = 'assistant' AND coalesce(text, '') <> '')")


def compaction_cutoff(messages: DataFrame, keep: int, trigger: int, by: str = "conv_id", order: str = "turn") -> DataFrame:
    """(conversation, cutoff): how many leading messages a summary replaces.

    The cut lies before a user message. It keeps the last ``keep`` user messages; where that still
    leaves ``trigger`` messages or more, it moves to a later user message. Conversations
    shorter than ``trigger`` are cut nowhere.
    """
    back = Window.partitionBy(by).orderBy(F.desc(order))
    whole = Window.partitionBy(by)
    ranked = messages.select(
        by,
        (F.col("role") == "user").alias("user"),
        F.row_number().over(back).alias("left"),
        F.sum((F.col("role") == "user").cast("int")).over(back.rowsBetween(Window.unboundedPreceding, 0)).alias("users"),
        F.count("*").over(whole).alias("n"),
    )
    fits = F.col("user") & (F.col("n") >= trigger) & (F.col("users") <= keep) & (F.col("left") < trigger)
    last = F.min(F.when(F.col("user"), F.col("left")))
    return ranked.groupBy(by).agg(
        F.coalesce(F.max("n") - F.max(F.when(fits, F.col("left"))), F.when(F.max("n") >= trigger, F.max("n") - last), F.lit(0)).cast("long").alias("cutoff")
    )


def routes(messages: DataFrame, keep: int, trigger: int, by: str = "conv_id", order: str = "turn") -> DataFrame:
    """(conversation, enters, goes_on): where each conversation goes next.

    It enters at ``summarize`` if a summary would replace messages, else at ``react``; it goes on to ``tools`` if its last message is an
    assistant's with tool calls (a column tool_calls, not null and no empty list), else to ``finish``.
    """
    calls = F.coalesce(~F.col("tool_calls").isin("", "[]"), F.lit(False)) if "tool_calls" in messages.columns else F.lit(False)
    last = messages.groupBy(by).agg(F.max_by((F.col("role") == "assistant") & calls, F.col(order)).alias("calls"))
    cut = compaction_cutoff(messages, keep, trigger, by, order)
    enters = F.when(F.col("cutoff") > 0, "summarize").otherwise("react")
    return cut.join(last, by).select(by, enters.alias("enters"), F.when(F.col("calls"), "tools").otherwise("finish").alias("goes_on"))


def open_items(items: DataFrame, by: str, hidden: tuple[str, ...] = ("done", "archived")) -> DataFrame:
    """(by, shown): the items (id, content, status) of each owner that aren't hidden, one line each by identifier."""
    left = items.where(~F.coalesce(F.col("status").isin(*hidden), F.lit(False)))
    line = F.format_string("[#%d] %s", F.col("id"), F.coalesce("content", F.lit("")))
    lines = F.array_sort(F.collect_list(F.struct(F.col("id"), line.alias("line"))))
    return left.groupBy(by).agg(F.array_join(F.transform(lines, lambda x: x["line"]), "\n").alias("shown"))
