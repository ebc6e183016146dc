"""Chat formatting by schema fingerprint.

A record may hold its conversation in one of several layouts. The nested field
paths that are filled in a row are hashed; the hash selects a declarative mapping
(where roles and texts stand) that turns the row into canonical turns. A template
then writes the turns between markers; control strings inside texts are escaped
reversibly, and spans of assistant texts form the loss mask.

Null texts are empty texts, null roles empty roles. Rows whose fingerprint no
mapping knows get null turns and a null form, never silently another layout. Rows
are formatted one by one; empty tables give empty results; extra columns stay.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

TURNS = "array<struct<role:string,text:string>>"
OPEN, CLOSE = "<|turn|>", "<|end|>\n"
#: sign that begins an escape; itself written as sign and 0
SIGN = "␛"
#: control strings begin with one of two brackets, which escaping replaces
CONTROL = [(r"<(/?s>|\||/?<SYS>>|/?SYS>>)", "<", "l"), (r"\[(/?INST\])", "[", "b")]


@dataclass(frozen=True)
class Mapping:
    """Where a layout keeps its turns: pairs of role and field, or one array of structs."""

    fields: tuple[tuple[str, str], ...] = ()
    array: str = ""
    role: str = "role"
    text: str = "text"
    names: tuple[tuple[str, str], ...] = ()

    def paths(self) -> list[str]:
        return sorted([f"{self.array}[].{self.role}", f"{self.array}[].{self.text}"] if self.array else [p for _, p in self.fields])

    def turns(self) -> Column:
        if not self.array:
            return F.array(*[F.struct(F.lit(r).alias("role"), F.coalesce(F.col(p).cast("string"), F.lit("")).alias("text")) for r, p in self.fields])

        def turn(x: Column) -> Column:
            said = role = F.coalesce(x[self.role].cast("string"), F.lit(""))
            for old, new in self.names:
                said = F.when(role == old, F.lit(new)).otherwise(said)
            return F.struct(said.alias("role"), F.coalesce(x[self.text].cast("string"), F.lit("")).alias("text"))

        return F.transform(F.col(self.array), turn)


#: layouts in common use
MAPPINGS = [
    Mapping(fields=(("user", "prompt"), ("assistant", "response"))),
    Mapping(fields=(("system", "system"), ("user", "prompt"), ("assistant", "response"))),
    Mapping(fields=(("user", "instruction"), ("assistant", "output"))),
    Mapping(fields=(("system", "instruction"), ("user", "input"), ("assistant", "output"))),
    Mapping(array="messages", role="role", text="content"),
    Mapping(array="conversations", role="from", text="value", names=(("human", "user"), ("gpt", "assistant"))),
]


def field_paths(schema: T.StructType, prefix: str = "") -> list[tuple[str, str]]:
    """(path, top-level or struct column that must be filled) of each leaf."""
    out: list[tuple[str, str]] = []
    for f in schema.fields:
        name, kind, mark = prefix + f.name, f.dataType, ""
        while isinstance(kind, T.ArrayType):
            kind, mark = kind.elementType, mark + "[]"
        if isinstance(kind, T.StructType) and mark:
            out += [(f"{name}{mark}.{g.name}", name) for g in kind.fields]
        elif isinstance(kind, T.StructType):
            out += field_paths(kind, name + ".")
        else:
            out.append((name + mark, name))
    return out


def fingerprint(rows: DataFrame, columns: list[str]) -> Column:
    """Hash of the sorted field paths that are filled in the row."""
    schema = T.StructType([rows.schema[c] for c in columns])
    present = sorted(field_paths(schema))
    names = F.array(*[F.when(F.col(where).isNotNull(), F.lit(path)) for path, where in present])
    return F.sha2(F.array_join(names, "\n"), 256)


def canonical_turns(rows: DataFrame, columns: list[str], mappings: list[Mapping] | None = None) -> DataFrame:
    """Adds ``fingerprint`` and ``turns``, read through the mapping of the fingerprint."""
    held = {p for p, _ in field_paths(T.StructType([rows.schema[c] for c in columns]))}
    turns = F.lit(None).cast(TURNS)
    for m in reversed(mappings if mappings is not None else MAPPINGS):
        if set(m.paths()) <= held:
            mark = F.sha2(F.lit("\n".join(m.paths())), 256)
            turns = F.when(F.col("fingerprint") == mark, m.turns().cast(TURNS)).otherwise(turns)
    return rows.withColumn("fingerprint", fingerprint(rows, columns)).withColumn("turns", turns)


def escaped(text: Column) -> Column:
    """No control string is left; ``unescaped`` gives the text back."""
    out = F.replace(text, F.lit(SIGN), F.lit(SIGN + "0"))
    for pattern, _, code in CONTROL:
        out = F.regexp_replace(out, pattern, f"{SIGN}{code}$1")
    return out


def unescaped(text: Column) -> Column:
    out = text
    for _, char, code in CONTROL:
        out = F.replace(out, F.lit(SIGN + code), F.lit(char))
    out = F.replace(out, F.lit(SIGN + "n"), F.lit("\n"))
    return F.replace(out, F.lit(SIGN + "0"), F.lit(SIGN))


def formatted(rows: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """Adds ``formatted`` and ``loss`` (start and length in characters of each
    ``loss_role`` text) to rows with ``turns``."""
    role = lambda x: F.replace(escaped(x["role"]), F.lit("\n"), F.lit(SIGN + "n"))  # noqa: E731 - a role stays on its line
    d = rows.withColumn("__parts", F.transform("turns", lambda x: F.struct(
        (x["role"] == loss_role).alias("loss"), F.concat(F.lit(OPEN), role(x), F.lit("\n")).alias("head"), escaped(x["text"]).alias("body"))))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,length:int>>").alias("spans"))

    def step(state: Column, x: Column) -> Column:
        begin = state["at"] + F.length(x["head"])
        span = F.struct(begin.alias("start"), F.length(x["body"]).alias("length"))
        return F.struct(
            (begin + F.length(x["body"]) + F.lit(len(CLOSE))).alias("at"),
            F.when(x["loss"], F.concat(state["spans"], F.array(span))).otherwise(state["spans"]).alias("spans"))

    text = F.array_join(F.transform("__parts", lambda x: F.concat(x["head"], x["body"], F.lit(CLOSE))), "")
    return d.withColumn("formatted", text).withColumn("loss", F.aggregate("__parts", start, step, lambda s: s["spans"])).drop("__parts")


def read_back(rows: DataFrame) -> DataFrame:
    """Adds ``turns_read`` and ``loss_text``, from ``formatted`` and ``loss`` alone."""
    pieces = F.filter(F.split("formatted", CLOSE.replace("|", r"\|")), lambda x: x != "")
    d = rows.withColumn("__pieces", pieces)

    def turn(x: Column) -> Column:
        said = F.substring_index(x, "\n", 1)
        return F.struct(
            unescaped(F.substr(said, F.lit(len(OPEN) + 1))).alias("role"),
            unescaped(F.substr(x, F.length(said) + F.lit(2))).alias("text"))

    whole = F.col("formatted")
    lost = F.transform("loss", lambda s: unescaped(F.substr(whole, s["start"] + 1, s["length"])))
    return d.withColumn("turns_read", F.transform("__pieces", turn)).withColumn("loss_text", F.array_join(lost, "")).drop("__pieces")


def gathered(turns: DataFrame) -> DataFrame:
    """Rows by turn become one record a conversation, in the layout that fits it:
    prompt and response, the same with a system text, or a list of messages."""
    one = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct(
        "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")))).alias("all"))
    roles = F.transform("all", lambda x: x["role"])
    d = one.withColumn("__roles", roles)
    pair = F.col("__roles") == F.array(F.lit("user"), F.lit("assistant"))
    three = F.col("__roles") == F.array(F.lit("system"), F.lit("user"), F.lit("assistant"))
    said = F.col("all")
    messages = F.transform(said, lambda x: F.struct(x["role"].alias("role"), x["text"].alias("content")))
    return d.select(
        "conv_id",
        F.when(three, F.get(said, F.lit(0))["text"]).alias("system"),
        F.when(pair, F.get(said, F.lit(0))["text"]).when(three, F.get(said, F.lit(1))["text"]).alias("prompt"),
        F.when(pair, F.get(said, F.lit(1))["text"]).when(three, F.get(said, F.lit(2))["text"]).alias("response"),
        F.when(~pair & ~three, messages).alias("messages"))
