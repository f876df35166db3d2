"""Chat formatting by schema fingerprints.

Records come in many layouts: rows of turns, prompt and response, instruction, input
and output, lists of messages with various names. A table read from mixed records has the fields of all layouts,
null where a record lacks them. The nested field paths that a record has,
sorted and hashed, are its fingerprint; it selects, row by row, a declarative mapping
that says where the turns, roles and texts lie. Every layout becomes the same
canonical array of (role, text), which the template writes as

    <s:role>escaped text</s>

for each turn; where the source named the role otherwise, its name follows the canonical one after an equals sign. In a text, a backslash becomes two,
and the angle bracket that opens control strings becomes backslash and l (in a role, the closing one too, as g, and the equals sign, as e); so no text
can forge a control string, and reading back is exact. All of it is column expressions; no Python runs on the executors.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from functools import reduce
from itertools import chain
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vframe.llm.common import between, bind, running, stretches

OPEN, CLOSE, NAMED, END = "<s:", ">", "=", "</s>"
TURN = "array<struct<role:string,text:string>>"

# Names of roles in the wild and their canonical ones.
ROLES = {
    "user": "user", "human": "user", "prompter": "user", "assistant": "assistant", "gpt": "assistant",
    "bot": "assistant", "model": "assistant", "system": "system", "tool": "tool", "function": "tool",
}


def fingerprint(field_paths: list[str]) -> str:
    """The hash of a layout's field paths."""
    return hashlib.sha256("\n".join(sorted(field_paths)).encode()).hexdigest()[:16]


def paths(schema: T.StructType) -> list[tuple[str, Callable[[], Column]]]:
    """The nested field paths of a schema, lists as ``[]``, each with the condition that a record has it.

    A leaf in a list is there if an element has it, or if no element has any leaf, as in an empty list: then the list alone tells the layout.
    """

    def within(kind: T.DataType, path: str, value: Callable[[Column], Column]) -> list[tuple[str, Callable[[Column], Column]]]:
        if isinstance(kind, T.StructType):
            return [p for f in kind.fields for p in within(f.dataType, f"{path}.{f.name}" if path else f.name, lambda x, n=f.name: value(x)[n])]
        if isinstance(kind, T.ArrayType):
            inner = within(kind.elementType, path + "[]", lambda x: x)

            def has(x: Column, one: Callable[[Column], Column]) -> Column:
                items = value(x)
                some = lambda test: F.exists(items, lambda e: test(e).isNotNull())
                blank = F.forall(items, lambda e: reduce(and_, [test(e).isNull() for _, test in inner]))
                return F.when(F.coalesce(some(one) | blank, F.lit(False)), F.lit(True))

            return [(p, lambda x, one=one: has(x, one)) for p, one in inner]
        return [(path, value)]

    out = []
    for f in schema.fields:
        column = F.col(f"`{f.name.replace('`', '``')}`")
        out += [(p, lambda c=column, value=value: value(c).isNotNull()) for p, value in within(f.dataType, f.name, lambda x: x)]
    return out


def _messages(array: str, role: str, text: str) -> Callable[[], Column]:
    return lambda: F.transform(F.col(array), lambda m: F.struct(m[role].alias("role"), m[text].alias("text")))


def _texts(array: str, text: str) -> Callable[[], Column]:
    """A list without any role."""
    return lambda: F.transform(F.col(array), lambda m: F.struct(F.lit(None).cast("string").alias("role"), m[text].alias("text")))


def _roles(array: str, role: str) -> Callable[[], Column]:
    """A list without any text."""
    return lambda: F.transform(F.col(array), lambda m: F.struct(m[role].alias("role"), F.lit(None).cast("string").alias("text")))


def _fields(*pairs: tuple[str, str]) -> Callable[[], Column]:
    """Turns from single fields."""
    return lambda: F.array(*[F.struct(F.lit(role).alias("role"), F.col(name).cast("string").alias("text")) for role, name in pairs])


def _instruction() -> Column:
    said = F.concat(F.col("instruction"), F.when(F.col("input") != "", F.concat(F.lit("\n\n"), F.col("input"))).otherwise(""))
    return F.array(
        F.struct(F.lit("user").alias("role"), said.alias("text")),
        F.struct(F.lit("assistant").alias("role"), F.col("output").alias("text")),
    )


#: Lists of messages: their names, and those of role and text.
LISTS = (("messages", "role", "content"), ("turns", "role", "text"), ("conversations", "from", "value"))
#: Layouts of single fields.
FIELDS = (
    (("user", "prompt"), ("assistant", "response")),
    (("user", "prompt"), ("assistant", "completion")),
    (("user", "question"), ("assistant", "answer")),
    (("system", "system"), ("user", "prompt"), ("assistant", "response")),
    (("user", "instruction"), ("assistant", "output")),
    (("user", "prompt"),),
    (("user", "instruction"),),
    (("assistant", "response"),),
)
#: Mappings by the fingerprint of their layout, and the paths that make it.
MAPPINGS: dict[str, tuple[list[str], Callable[[], Column]]] = {
    fingerprint(names): (names, mapping)
    for names, mapping in chain(
        (([f"{a}[].{t}", f"{a}[].{r}"], _messages(a, r, t)) for a, r, t in LISTS),
        (([f"{a}[].{t}"], _texts(a, t)) for a, r, t in LISTS),
        (([f"{a}[].{r}"], _roles(a, r)) for a, r, t in LISTS),
        (([name for _, name in pairs], _fields(*pairs)) for pairs in FIELDS),
        [(["input", "instruction", "output"], _instruction), ([], lambda: F.array().cast(TURN))],
    )
}


def canonical(records: DataFrame, id_col: str, layout: list[str] | None = None) -> DataFrame:
    """(id, turns, layout) of records in any known layouts, which may differ from row to row; ``layout`` is the row's fingerprint.

    A turn has role, text and said, the role's name in the source. The columns that known layouts begin at make a record's layout, or those that
    ``layout`` names; other columns are ignored, whatever their names. Roles in the wild become canonical, unknown ones stay; null roles are
    "user", null texts are empty. A record all of whose columns are null, and one with an empty list, has no turns. A record in an unknown layout has
    null turns: one whose fields no mapping takes together, or that has other columns alone. A frame none of whose columns is in a known layout is refused.
    """
    tops = {p.split("[]")[0].split(".")[0] for some, _ in MAPPINGS.values() for p in some}
    names = layout or [c for c in records.columns if c != id_col and c in tops]
    every = paths(T.StructType([records.schema[n] for n in names]))
    known = {p for p, _ in every}
    usable = {k: m for k, (some, m) in MAPPINGS.items() if some and known.issuperset(some)}
    if not usable:
        raise ValueError(f"no mapping for the layout {sorted(known) or records.columns}")
    present = F.array_sort(F.filter(F.array(*[F.when(test(), F.lit(p)) for p, test in every]), lambda p: p.isNotNull()))
    prints = F.substr(F.sha2(F.array_join(present, "\n"), 256), F.lit(1), F.lit(16))
    others = [records[f"`{c}`"].isNotNull() for c in records.columns if c != id_col and c not in names] if layout is None else []
    tagged = records.select(F.col(id_col).alias("id"), *[F.col(n) for n in names], prints.alias("_layout"), reduce(or_, others, F.lit(False)).alias("_others"))
    turns = F.when((F.col("_layout") == fingerprint([])) & ~F.col("_others"), F.array().cast(TURN))
    for key, mapping in usable.items():
        turns = turns.when(F.col("_layout") == key, mapping().cast(TURN))
    pairs = F.create_map(*[F.lit(x) for pair in ROLES.items() for x in pair])
    said = lambda t: F.coalesce(t["role"], F.lit("user"))
    clean = lambda t: F.struct(
        F.coalesce(F.try_element_at(pairs, F.lower(said(t))), said(t)).alias("role"), F.coalesce(t["text"], F.lit("")).alias("text"), said(t).alias("said")
    )
    return tagged.select("id", F.transform(turns, clean).alias("turns"), F.col("_layout").alias("layout"))


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<"), F.lit("\\l"))


def escape_name(name: Column) -> Column:
    """A role's name, whose closing bracket and equals sign would end it too."""
    return F.replace(F.replace(escape(name), F.lit(CLOSE), F.lit("\\g")), F.lit(NAMED), F.lit("\\e"))


def unescape(text: Column) -> Column:
    """Undo :func:`escape`: a doubled backslash is set aside while the others are read."""
    apart = F.split(text, r"\\\\", -1)  # a regular expression for two backslashes
    signs = (("\\l", "<"), ("\\g", CLOSE), ("\\e", NAMED))

    def plain(part: Column) -> Column:
        for code, sign in signs:
            part = F.replace(part, F.lit(code), F.lit(sign))
        return part

    return F.array_join(F.transform(apart, plain), "\\")


def format_chat(records: DataFrame, id_col: str, layout: list[str] | None = None) -> DataFrame:
    """Write each record as one string.

    Returns id, formatted, loss_mask, an array of (start, length) in code points of the
    formatted string: the texts of assistant turns, as escaped, and layout. A record without
    turns is the empty string, one in an unknown layout null. Repeated records give repeated results, no records none.
    """
    turns = canonical(records, id_col, layout)
    name = lambda t: F.concat(escape_name(t["role"]), F.when(t["said"] != t["role"], F.concat(F.lit(NAMED), escape_name(t["said"]))).otherwise(""))
    written = F.transform(
        "turns",
        lambda t: F.struct(
            F.concat(F.lit(OPEN), name(t), F.lit(CLOSE)).alias("head"),
            escape(t["text"]).alias("body"),
            (t["role"] == "assistant").alias("learnt"),
        ),
    )

    def laid(w: Column) -> Column:
        lengths = F.transform(w, lambda t: F.length(t["head"]) + F.length(t["body"]) + F.lit(len(END)))
        span = lambda at: lambda t, i: F.struct((F.get(at, i) + F.length(t["head"])).alias("start"), F.length(t["body"]).alias("length"), t["learnt"].alias("learnt"))
        spans = bind(running(lengths), lambda at: F.transform(w, span(at)))
        mask = F.transform(F.filter(spans, lambda s: s["learnt"]), lambda s: F.struct(s["start"].alias("start"), s["length"].alias("length")))
        text = F.array_join(F.transform(w, lambda t: F.concat(t["head"], t["body"], F.lit(END))), "")
        return F.struct(text.alias("formatted"), mask.alias("loss_mask"))

    out = turns.select("id", "layout", F.when(F.col("turns").isNotNull(), bind(written, laid)).alias("out"))
    return out.select("id", "out.formatted", "out.loss_mask", "layout")


def read_back(formatted: DataFrame) -> DataFrame:
    """Parse :func:`format_chat`'s output: id, turns (role, text, said) and loss_texts, all from the string and its mask."""
    blocks = F.filter(F.split("formatted", END, -1), lambda b: b != "")

    def turn(b: Column) -> Column:
        head, body = F.substring_index(b, CLOSE, 1), F.substr(b, F.position(F.lit(CLOSE), b) + F.lit(1))
        names = F.split(F.substr(head, F.lit(len(OPEN) + 1)), NAMED, 2)
        return F.struct(unescape(F.get(names, F.lit(0))).alias("role"), unescape(body).alias("text"), unescape(F.coalesce(F.get(names, F.lit(1)), F.get(names, F.lit(0)))).alias("said"))

    cut = lambda c: F.transform("loss_mask", lambda s: unescape(between(c, s["start"], s["start"] + s["length"])))
    return formatted.select("id", F.transform(blocks, turn).alias("turns"), bind(stretches(F.col("formatted")), cut).alias("loss_texts"), "formatted")


def conversations_as_records(conversations: DataFrame) -> DataFrame:
    """One record for each conversation, its rows by turn, then role and text on ties; null texts are empty.

    Records come in the layouts that a mixed collection has, null where they lack a field: two turns of a user and an
    assistant as prompt and response, with a system turn before them those three, and others as one of three lists by a hash of the
    identifier.
    """
    row = F.struct(F.col("turn").alias("turn"), F.col("role").alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    grouped = conversations.groupBy("conv_id").agg(F.array_sort(F.collect_list(row)).alias("rows"))
    spoken = F.array_join(F.transform("rows", lambda r: r["role"]), "|", "?")
    pair, triple = spoken == "user|assistant", spoken == "system|user|assistant"
    sort = F.when(pair, 3).when(triple, 4).otherwise(F.pmod(F.xxhash64("conv_id"), F.lit(3)))
    said = lambda i: F.get(F.col("rows"), F.lit(i))["text"]
    listed = lambda role, text: F.transform("rows", lambda r: F.struct(r["role"].alias(role), r["text"].alias(text)))
    lists = [F.when(sort == i, listed(role, text)).alias(name) for i, (name, role, text) in enumerate(LISTS)]
    prompt, response = F.when(pair, said(0)).when(triple, said(1)), F.when(pair, said(1)).when(triple, said(2))
    return grouped.select("conv_id", *lists, F.when(triple, said(0)).alias("system"), prompt.alias("prompt"), response.alias("response"))


def chat_digest(records: DataFrame, id_col: str, layout: list[str] | None = None) -> DataFrame:
    """What the formatted strings hold, read back from them: the digest columns of the query. Roles are named as in the source."""
    back = read_back(format_chat(records, id_col, layout))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["said"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    learnt = F.array_join("loss_texts", "")
    return back.select(
        F.col("id").alias("conv_id"),
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.length(learnt).cast("long").alias("loss_chars"),
        F.sha2(learnt, 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
