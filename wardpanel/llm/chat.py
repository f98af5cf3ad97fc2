"""Chat formatting of records in many layouts, in DataFrame functions only."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, StructType

START, END = "<|im_start|>", "<|im_end|>"
#: Longer JSON records may hold a text beyond the parser's 20,000,000 characters, or pass the 128 MiB of a variant; shorter ones cannot.
JSON_CHARS = 20_000_000
#: Marks an escape; it is doubled by the digit where a text holds it itself.
ESCAPE = "\x10"
TURNS = "array<struct<role:string,text:string>>"

# Role names of public chat layouts.
ROLES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant", "chatgpt": "assistant"}


@dataclass(frozen=True)
class Layout:
    """How records with a certain set of field paths become turns.

    `turns`: path of a list, with the fields of role and text.  Otherwise `fields`: (role, path, ...) in order; several
    paths are joined by a blank line, paths that are missing are left out.  `needs` are the paths that mark the layout.
    """

    name: str
    needs: tuple[str, ...]
    turns: str | None = None
    role: str = "role"
    text: str = "content"
    fields: tuple[tuple[str, ...], ...] = ()


LAYOUTS = (
    Layout("messages", ("messages[0].role", "messages[0].content"), "messages"),
    Layout("conversations", ("conversations[0].from", "conversations[0].value"), "conversations", "from", "value"),
    Layout("dialog", ("dialog[0].speaker", "dialog[0].text"), "dialog", "speaker", "text"),
    Layout("completion", ("prompt", "completion"), fields=(("system", "system"), ("user", "prompt"), ("assistant", "completion"))),
    Layout("response", ("prompt", "response"), fields=(("system", "system"), ("user", "prompt"), ("assistant", "response"))),
    Layout("chosen", ("prompt", "chosen"), fields=(("system", "system"), ("user", "prompt"), ("assistant", "chosen"))),
    Layout("instruction", ("instruction", "output"), fields=(("system", "system"), ("user", "instruction", "input"), ("assistant", "output"))),
    Layout("question", ("question", "answer"), fields=(("system", "system"), ("user", "context", "question"), ("assistant", "answer"))),
    Layout("nested", ("data.prompt", "data.response"), fields=(("system", "data.system"), ("user", "data.prompt"), ("assistant", "data.response"))),
)
PATHS = tuple(sorted({p for layout in LAYOUTS for p in layout.needs}))


def fingerprint(record: Column) -> Column:
    """Hash of the marking field paths that a variant record has; values do not matter, a null value counts as there."""
    there = F.array(*[F.when(F.variant_get(record, f"$.{p}", "variant").isNotNull(), F.lit(p)) for p in PATHS])
    return F.xxhash64(F.array_join(there, "\n"))


def _known(layout: Layout) -> Column:
    return F.xxhash64(F.lit("\n".join(p for p in PATHS if p in layout.needs)))


def _text(record: Column, path: str) -> Column:
    return F.try_variant_get(record, f"$.{path}", "string")


def _field_type(kind: DataType, path: str) -> DataType | None:
    """Type of a field path in a schema; None where the schema has no such path."""
    for step in path.replace("[0]", ".[0]").split("."):
        if step == "[0]":
            kind = kind.elementType if isinstance(kind, ArrayType) else None
        else:
            kind = kind[step].dataType if isinstance(kind, StructType) and step in kind.names else None
        if kind is None:
            return None
    return kind


def _field(record: Column, path: str) -> Column:
    for step in path.split("."):
        record = record.getField(step)
    return record


def schema_layout(schema: StructType) -> Layout | None:
    """The layout whose marking field paths are those of the schema."""
    there = {p for p in PATHS if _field_type(schema, p) is not None}
    return next((layout for layout in LAYOUTS if set(layout.needs) == there), None)


def typed_turns(records: DataFrame, record_col: str) -> DataFrame:
    """Adds `layout` and `turns` to records that are structs: all have the layout of the schema, and no value passes a parser."""
    schema, record = records.schema[record_col].dataType, F.col(record_col)
    layout = schema_layout(schema)
    if layout is None:
        return records.withColumns({"layout": F.lit(None).cast("string"), "turns": F.lit(None).cast(TURNS)})
    inner = _field_type(schema, f"{layout.turns}[0]") if layout.turns else schema
    text = lambda r, path: _field(r, path).cast("string") if _field_type(inner, path) is not None else F.lit(None).cast("string")
    items = _field(record, layout.turns) if layout.turns else None
    here = F.coalesce(F.size(items) > 0, F.lit(False)) & F.get(items, F.lit(0)).isNotNull() if layout.turns else record.isNotNull()
    return records.withColumns({"layout": F.when(here, F.lit(layout.name)), "turns": F.when(here, layout_turns(record, layout, text, items))})


def layout_turns(record: Column, layout: Layout, _text: Callable[[Column, str], Column] = _text, items: Column | None = None) -> Column:
    if layout.turns:
        items = F.try_variant_get(record, f"$.{layout.turns}", "array<variant>") if items is None else items
        role = lambda x: F.lower(F.coalesce(_text(x, layout.role), F.lit(""))) if layout.role != "role" else F.coalesce(_text(x, layout.role), F.lit(""))
        named = lambda r: F.coalesce(F.element_at(F.create_map(*[F.lit(v) for pair in ROLES.items() for v in pair]), r), r)
        turn = lambda x: F.struct((named(role(x)) if layout.role != "role" else role(x)).alias("role"), F.coalesce(_text(x, layout.text), F.lit("")).alias("text"))
        return F.transform(items, turn).cast(TURNS)
    parts = []
    for role, *paths in layout.fields:
        values = [F.when(F.length(_text(record, p)) > 0, _text(record, p)) if p not in layout.needs or len(paths) > 1 else F.coalesce(_text(record, p), F.lit("")) for p in paths]
        text = values[0] if len(values) == 1 else F.concat_ws("\n\n", *values)
        parts.append(F.when(text.isNotNull(), F.struct(F.lit(role).alias("role"), text.alias("text"))))
    return F.filter(F.array(*parts), lambda x: x.isNotNull()).cast(TURNS)


def canonical_turns(records: DataFrame, record_col: str = "record") -> DataFrame:
    """Adds `layout` and `turns`.  Records are JSON strings or structs; the fingerprint of their field paths selects the layout.

    Null, broken or unknown records get a null layout and null turns.  When several layouts could apply, none does:
    the fingerprint covers the paths of all layouts, so a mixture is unknown unless it is listed.
    A JSON record of more than `JSON_CHARS` that the parser does not take is an error, as it may be well-formed but too
    large for it; structs have no such limit.
    """
    if isinstance(records.schema[record_col].dataType, StructType):
        return typed_turns(records, record_col)
    record = F.try_parse_json(F.col(record_col))
    large = record.isNull() & (F.length(record_col) > JSON_CHARS)
    record = F.when(large, F.raise_error(F.lit("a JSON record is too large for the parser, or broken; give large records as structs")).cast("variant")).otherwise(record)
    found = records.withColumn("__v", record).withColumn("__f", fingerprint(F.col("__v")))
    name, turns = F.lit(None).cast("string"), F.lit(None).cast(TURNS)
    for layout in LAYOUTS:
        here = F.col("__f") == _known(layout)
        name = F.when(here, F.lit(layout.name)).otherwise(name)
        turns = F.when(here, layout_turns(F.col("__v"), layout)).otherwise(turns)
    return found.withColumns({"layout": name, "turns": turns}).drop("__v", "__f")


def escape(text: Column, line_break: bool = False) -> Column:
    """No control string is left in the text; `unescape` gives it back."""
    out = F.replace(F.replace(text, F.lit(ESCAPE), F.lit(ESCAPE + "0")), F.lit("<|"), F.lit(f"<{ESCAPE}|"))
    return F.replace(out, F.lit("\n"), F.lit(ESCAPE + "n")) if line_break else out


def unescape(text: Column) -> Column:
    out = F.replace(F.replace(text, F.lit(ESCAPE + "n"), F.lit("\n")), F.lit(f"<{ESCAPE}|"), F.lit("<|"))
    return F.replace(out, F.lit(ESCAPE + "0"), F.lit(ESCAPE))


def render(chats: DataFrame, turns_col: str = "turns", learn: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """Adds `formatted` and `loss_mask`, the spans (start, length in code points) of the texts to learn from.

    A turn reads `<|im_start|>role\\ntext<|im_end|>\\n`; control strings inside roles and texts are escaped, and line breaks
    inside roles.  Null turns: null.  No turns: an empty text and mask.
    """
    head = lambda t: F.concat(F.lit(START), escape(F.coalesce(t["role"], F.lit("")), True), F.lit("\n"))
    body = lambda t: escape(F.coalesce(t["text"], F.lit("")))
    parts = F.transform(F.col(turns_col), lambda t: F.struct(head(t).alias("head"), body(t).alias("body"), F.coalesce(t["role"].isin(*learn), F.lit(False)).alias("learn")))
    step = lambda state, p: F.struct(
        (state["at"] + F.length(p["head"]) + F.length(p["body"]) + len(END) + 1).cast("bigint").alias("at"),
        F.when(p["learn"], F.array_append(state["spans"], F.struct((state["at"] + F.length(p["head"])).cast("bigint").alias("start"), F.length(p["body"]).cast("bigint").alias("length")))).otherwise(state["spans"]).alias("spans"),
    )
    zero = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast("array<struct<start:bigint,length:bigint>>").alias("spans"))
    mask = F.aggregate(F.col("__p"), zero, step, lambda state: state["spans"])
    text = F.array_join(F.transform(F.col("__p"), lambda p: F.concat(p["head"], p["body"], F.lit(END + "\n"))), "")
    return chats.withColumn("__p", parts).withColumns({"formatted": text, "loss_mask": mask}).drop("__p")


def read_turns(formatted: Column) -> Column:
    """The turns of a rendered text."""
    pieces = F.filter(F.split(formatted, r"<\|im_end\|>\n"), lambda x: x != "")
    inner = lambda x: F.substring(x, len(START) + 1, F.length(x))
    role = lambda x: F.substring_index(inner(x), "\n", 1)
    return F.transform(pieces, lambda x: F.struct(unescape(role(x)).alias("role"), unescape(F.substring(inner(x), F.length(role(x)) + 2, F.length(x))).alias("text")))


def read_loss(formatted: Column, mask: Column) -> Column:
    """The texts under the loss mask, unescaped, one after the other."""
    return F.array_join(F.transform(mask, lambda s: unescape(F.substring(formatted, (s["start"] + 1).cast("int"), s["length"].cast("int")))), "")


def rows_to_structs(rows: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(id_col, record): rows by turn as one struct of the `messages` layout; ties of turn by role, then text.  Null text: empty."""
    message = F.struct(F.col(role_col).cast("string").alias("role"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("content"))
    grouped = rows.groupBy(F.col(id_col).alias(id_col)).agg(F.sort_array(F.collect_list(F.struct(F.col(turn_col).alias("turn"), message.alias("message")))).alias("list"))
    return grouped.select(id_col, F.struct(F.transform("list", lambda x: x["message"]).alias("messages")).alias("record"))


def rows_to_records(rows: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """`rows_to_structs` with the records as JSON."""
    structs = rows_to_structs(rows, id_col, turn_col, role_col, text_col)
    return structs.select(id_col, F.to_json("record", {"ignoreNullFields": "false"}).alias("record"))


def format_chats(records: DataFrame, record_col: str = "record") -> DataFrame:
    """Adds `layout`, `turns`, `formatted` and `loss_mask` to records of any layout; rows are independent, copies stay."""
    return render(canonical_turns(records, record_col))
