"""Chat formatting: records of any known layout become turns, and turns one training text with a loss mask.

A record's schema fingerprint is the md5 of the sorted nested field paths that are filled in it, taken from the
paths that the layouts name. The fingerprint selects a declared mapping, so one table may mix prompt, instruction,
message and turn-by-turn layouts. Turns are written with marks, texts are escaped so that no text can hold a mark,
and both are read back from what was written. All of it is column expressions.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

START, END = "<|im_start|>", "<|im_end|>\n"
ASSISTANT = "assistant"
#: turns of a conversation that are joined first, so that a long conversation is put together from few rows
CHUNK = 64


@dataclass(frozen=True)
class Said:
    """One turn of a fixed role: the texts of the fields, those that are filled, with an empty line between."""

    role: str
    fields: tuple[str, ...]


@dataclass(frozen=True)
class Listed:
    """Turns of a list of structs, or one turn of a struct: where role and text stand, and what roles are called."""

    field: str
    role: str
    text: str
    roles: tuple[tuple[str, str], ...] = ()


@dataclass(frozen=True)
class Layout:
    """Field paths that make a layout (``[]`` is an element of a list), those that may be missing, and its turns."""

    name: str
    required: tuple[str, ...]
    optional: tuple[str, ...]
    turns: tuple[Said | Listed, ...]

    def path_sets(self) -> Iterator[tuple[str, ...]]:
        for n in range(len(self.optional) + 1):
            for more in combinations(self.optional, n):
                yield tuple(sorted((*self.required, *more)))


_NAMES = (("human", "user"), ("gpt", ASSISTANT))

LAYOUTS = (
    Layout("turn", ("row",), ("row.role", "row.text"), (Listed("row", "role", "text"),)),
    Layout("prompt", ("prompt",), ("response", "system"),
           (Said("system", ("system",)), Said("user", ("prompt",)), Said(ASSISTANT, ("response",)))),
    Layout("completion", ("prompt", "completion"), ("system",),
           (Said("system", ("system",)), Said("user", ("prompt",)), Said(ASSISTANT, ("completion",)))),
    Layout("question", ("question", "answer"), ("context",),
           (Said("user", ("context", "question")), Said(ASSISTANT, ("answer",)))),
    Layout("instruction", ("instruction", "output"), ("input", "system"),
           (Said("system", ("system",)), Said("user", ("instruction", "input")), Said(ASSISTANT, ("output",)))),
    Layout("messages", ("messages[]",), ("messages[].role", "messages[].content", "system"),
           (Said("system", ("system",)), Listed("messages", "role", "content", _NAMES))),
    Layout("exchange", ("conversations[]",), ("conversations[].from", "conversations[].value", "system"),
           (Said("system", ("system",)), Listed("conversations", "from", "value", _NAMES))),
)

_TURNS = "array<struct<role:string,text:string>>"


def records_of_json(df: DataFrame, column: str, layouts: tuple[Layout, ...] = LAYOUTS) -> DataFrame:
    """``df`` with the fields of the layouts, read from JSON text; fields that a record lacks are null."""
    scalars, nested = {}, {}
    for layout in layouts:
        for path in (*layout.required, *layout.optional):
            top, _, rest = path.partition("[]." if "[]." in path else ".")
            if rest:
                nested.setdefault((top, "[]" in path), []).append(rest)
            elif "[]" not in top:
                scalars.setdefault(top, None)
    fields = [T.StructField(name, T.StringType()) for name in scalars if (name, False) not in nested]
    for (name, listed), inner in nested.items():
        kind = T.StructType([T.StructField(x, T.StringType()) for x in dict.fromkeys(inner)])
        fields.append(T.StructField(name, T.ArrayType(kind) if listed else kind))
    return df.withColumn("_r", F.from_json(F.col(column), T.StructType(fields))).select("*", "_r.*").drop("_r")


def _paths(kind: T.DataType, path: str) -> Iterator[tuple[str, Callable[[Column], Column]]]:
    """Every field path below ``path`` and, for a value standing there, whether it is filled."""
    def any_element(filled: Callable[[Column], Column]) -> Callable[[Column], Column]:
        return lambda v: F.coalesce(F.exists(v, filled), F.lit(False))

    def in_field(filled: Callable[[Column], Column], name: str) -> Callable[[Column], Column]:
        return lambda v: filled(v[name])

    if isinstance(kind, T.ArrayType):
        for below, filled in _paths(kind.elementType, f"{path}[]"):
            yield below, any_element(filled)
        return
    yield path, lambda v: v.isNotNull()
    if isinstance(kind, T.StructType):
        for field in kind:
            for below, filled in _paths(field.dataType, f"{path}.{field.name}"):
                yield below, in_field(filled, field.name)


def _digest(paths: tuple[str, ...]) -> str:
    return hashlib.md5("\n".join(paths).encode()).hexdigest()


def fingerprint(df: DataFrame, layouts: tuple[Layout, ...] = LAYOUTS) -> Column:
    """md5 of the sorted field paths that are filled in a row, of those that any layout names."""
    known = {p for layout in layouts for p in (*layout.required, *layout.optional)}
    found = [(path, filled(df[field.name])) for field in df.schema
             if any(p == field.name or p.startswith((f"{field.name}.", f"{field.name}[")) for p in known)
             for path, filled in _paths(field.dataType, field.name) if path in known]
    return F.md5(F.concat_ws("\n", *[F.when(filled, F.lit(path)) for path, filled in sorted(found, key=lambda x: x[0])]))


def _turn(role: Column, text: Column) -> Column:
    return F.struct(role.cast("string").alias("role"), text.cast("string").alias("text"))


def _renamed(role: Column, roles: tuple[tuple[str, str], ...]) -> Column:
    role = role.cast("string")
    for own, usual in roles:
        role = F.when(role == own, usual).otherwise(role)
    return F.coalesce(role, F.lit(""))


def _turns(df: DataFrame, layout: Layout) -> Column:
    """The turns that a layout makes of a row, as far as the table has its fields."""
    parts = []
    for rule in layout.turns:
        if isinstance(rule, Said):
            own = [F.col(f).cast("string") for f in rule.fields if f in df.columns]
            if own:
                filled = F.filter(F.array(*own), lambda t: t.isNotNull())
                one = F.array(_turn(F.lit(rule.role), F.array_join(filled, "\n\n")))
                parts.append(F.when(F.size(filled) > 0, one).otherwise(F.array().cast(_TURNS)))
            continue
        kind = df.schema[rule.field].dataType
        if isinstance(kind, T.ArrayType):
            one = _listed(rule, set(kind.elementType.names))
            parts.append(F.transform(F.filter(F.col(rule.field), lambda x: x.isNotNull()), one))
        else:
            parts.append(F.array(_listed(rule, set(kind.names))(F.col(rule.field))))
    return F.concat(*parts).cast(_TURNS)


def _listed(rule: Listed, names: set[str]) -> Callable[[Column], Column]:
    """The turn that a struct with these fields is."""
    def one(x: Column) -> Column:
        role, text = (x[n] if n in names else F.lit(None) for n in (rule.role, rule.text))
        return _turn(_renamed(role, rule.roles), F.coalesce(text.cast("string"), F.lit("")))

    return one


def canonical(df: DataFrame, layouts: tuple[Layout, ...] = LAYOUTS) -> DataFrame:
    """``df`` with ``fingerprint``, the name of its ``layout`` and its ``turns array<struct<role, text>>``.

    A row of an unknown layout stays, with a null layout and no turns. Null texts and roles of a turn are empty.
    Columns that no layout names play no part, nor do those named but of another shape.
    """
    out = df.withColumn("_fingerprint", fingerprint(df, layouts))
    # a layout counts only if the table has its fields
    have = {path for field in df.schema for path, _ in _paths(field.dataType, field.name)}
    name, turns = F.lit(None).cast("string"), F.array().cast(_TURNS)
    for layout in layouts:
        sets = [_digest(s) for s in layout.path_sets() if have.issuperset(s)]
        if sets:
            here = F.col("_fingerprint").isin(sets)
            name = F.when(here, layout.name).otherwise(name)
            turns = F.when(here, _turns(df, layout)).otherwise(turns)
    return out.select(*[F.col(c) for c in df.columns if c not in ("fingerprint", "layout", "turns")],
                      F.col("_fingerprint").alias("fingerprint"), name.alias("layout"), turns.alias("turns"))


def escaped(text: Column) -> Column:
    """A backslash more between ``<`` and ``|``, so that no text holds ``<|``."""
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", r"<$1|")


def escaped_role(role: Column) -> Column:
    """A role stands in one line."""
    return escaped(F.replace(F.replace(role, F.lit("%"), F.lit("%25")), F.lit("\n"), F.lit("%0A")))


def unescaped_role(role: Column) -> Column:
    return F.replace(F.replace(unescaped(role), F.lit("%0A"), F.lit("\n")), F.lit("%25"), F.lit("%"))


def formatted(turns: DataFrame, key: str = "conv_id", order: str = "turn") -> DataFrame:
    """``key, formatted, mask``: one row per conversation, from rows of ``canonical`` with ``key`` and ``order``.

    Rows of a conversation stand by ``order``, nulls first, the turns of a row in their own order, ties by what is
    written. ``mask`` has for each turn how many code points from its start are not trained on (``skip``) and how
    many then are (``take``): texts of the assistant, marks excluded. A null key is a conversation of its own; a
    conversation without turns is an empty text.
    """
    spots = turns.select(F.col(key).alias("_key"), F.col(order).alias("_order"), F.posexplode_outer("turns").alias("_place", "_t"))
    head = F.concat(F.lit(START), escaped_role(F.col("_t.role")), F.lit("\n"))
    written = spots.select("_key", "_order", "_place", F.col("_t.role").alias("_role"), head.alias("_head"),
                           escaped(F.col("_t.text")).alias("_body"))
    loss = F.struct(F.length("_head").cast("long").alias("skip"), F.when(F.col("_role") == ASSISTANT, F.length("_body"))
                    .otherwise(0).cast("long").alias("take"))
    pieces = written.select("_key", F.floor(F.col("_order").cast("double") / CHUNK).alias("_chunk"), F.when(
        F.col("_head").isNotNull(), F.struct("_order", "_place", F.concat("_head", "_body", F.lit(END)).alias("piece"),
                                             loss.alias("loss"))).alias("_p"))
    chunks = pieces.groupBy("_key", "_chunk").agg(F.sort_array(F.collect_list("_p")).alias("_ps")).select(
        "_key", F.struct("_chunk", F.array_join("_ps.piece", "").alias("piece"), F.col("_ps.loss").alias("mask")).alias("_c"))
    return chunks.groupBy("_key").agg(F.sort_array(F.collect_list("_c")).alias("_cs")).select(
        F.col("_key").alias(key), F.array_join("_cs.piece", "").alias("formatted"), F.flatten("_cs.mask").alias("mask"))


def turns_of(text: Column) -> Column:
    """The turns read back from a formatted text."""
    def read(piece: Column) -> Column:
        role = F.substring_index(piece, "\n", 1)
        return _turn(unescaped_role(F.substring(role, len(START) + 1, 2**31 - 1)),
                     unescaped(F.substr(piece, F.length(role) + 2)))

    return F.transform(_pieces(text), read)


def trained_on(text: Column, mask: Column) -> Column:
    """What lies under the loss mask of a formatted text, unescaped, joined."""
    under = F.zip_with(_pieces(text), mask, lambda piece, m: unescaped(
        F.substr(piece, (m["skip"] + 1).cast("int"), m["take"].cast("int"))))
    return F.array_join(under, "")


def _pieces(text: Column) -> Column:
    """The text of each turn up to its end mark."""
    parts = F.split(text, F.lit(END.replace("|", r"\|")))
    return F.slice(parts, F.lit(1), F.size(parts) - 1)


def read_back(chats: DataFrame, key: str = "conv_id") -> DataFrame:
    """Digests of what ``formatted`` wrote, each read back from it."""
    read = chats.select(key, "formatted", turns_of(F.col("formatted")).alias("_turns"),
                        trained_on(F.col("formatted"), F.col("mask")).alias("_loss"))
    whole = F.array_join(F.transform("_turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(key, F.size("_turns").cast("long").alias("n_turns"), F.sha2(whole, 256).alias("turns_sha256"),
                       F.length("_loss").cast("long").alias("loss_chars"), F.sha2("_loss", 256).alias("loss_sha256"),
                       F.length("formatted").cast("long").alias("formatted_chars"))


def formatted_conversations(conversations: DataFrame, extra: DataFrame | None = None) -> DataFrame:
    """Digests of ``conversations`` (a row per turn) and of ``extra`` records of any layout, with conv_id and turn."""
    rows = conversations.select("conv_id", "turn", F.struct(F.col("role").cast("string").alias("role"),
                                                            F.col("text").cast("string").alias("text")).alias("row"))
    both = rows if extra is None else rows.unionByName(extra, allowMissingColumns=True)
    return read_back(formatted(canonical(both)))
