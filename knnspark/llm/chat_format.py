"""Chat formatting by schema fingerprinting, in DataFrame functions only.

A record's nested field paths are hashed; the fingerprint selects a declarative mapping that says
where its turns are. All layouts become canonical turns (role, text), which one template renders:

    <|im_start|>role
    text<|im_end|>

Control strings inside texts are escaped reversibly: each ``<|`` becomes ``<|lt|>`` (and a newline in
a role ``<|nl|>``), so the only ``<|im_`` in the output are the template's own. The loss mask is a list
of character spans, one for each assistant text.

Edge cases: null text or role counts as empty; a conversation's turns go by turn number, nulls
first, then role and text, so ties and repeated rows have one order; a row whose layout no mapping knows is returned by
`unmapped`, never dropped silently; empty tables give empty results.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, END, ESCAPE, NEWLINE = "<|im_start|>", "<|im_end|>", "<|lt|>", "<|nl|>"
TURNS = "array<struct<role:string,text:string>>"


@dataclass(frozen=True)
class Mapping:
    """paths: a record's field paths, as `paths_of` writes them. turns: SQL over the variant `rec`
    that gives an array of structs role, text."""

    name: str
    paths: str
    turns: str


def _text(path: str) -> str:
    return f"coalesce(try_variant_get(rec, '$.{path}', 'string'), '')"


def _pair(*turns: tuple[str, str]) -> str:
    return "array(" + ", ".join(f"named_struct('role', {role}, 'text', {text})" for role, text in turns) + ")"


def _list(path: str, role: str, text: str, names: dict[str, str] | None = None) -> str:
    of = f"coalesce(x.`{role}`, '')"
    if names:
        of = "case " + of + "".join(f" when '{a}' then '{b}'" for a, b in names.items()) + f" else {of} end"
    return f"transform(coalesce(try_variant_get(rec, '$.{path}', 'array<struct<`{role}`:string,`{text}`:string>>'), array()), x -> named_struct('role', {of}, 'text', coalesce(x.`{text}`, '')))"


#: The layouts that are known: a row for each turn, messages, prompt and completion, instructions, shared conversations.
MAPPINGS = (
    Mapping("turn_row", "OBJECT<conv_id, role, text, turn>", _pair((_text("role"), _text("text")))),
    Mapping("messages", "OBJECT<messages: ARRAY<OBJECT<content, role>>>", _list("messages", "role", "content")),
    Mapping("messages_id", "OBJECT<id, messages: ARRAY<OBJECT<content, role>>>", _list("messages", "role", "content")),
    Mapping("shared", "OBJECT<conversations: ARRAY<OBJECT<from, value>>>", _list("conversations", "from", "value", {"human": "user", "gpt": "assistant"})),
    Mapping("prompt_response", "OBJECT<prompt, response>", _pair(("'user'", _text("prompt")), ("'assistant'", _text("response")))),
    Mapping("prompt_completion", "OBJECT<completion, prompt>", _pair(("'user'", _text("prompt")), ("'assistant'", _text("completion")))),
    Mapping("instruction", "OBJECT<instruction, output>", _pair(("'user'", _text("instruction")), ("'assistant'", _text("output")))),
    Mapping(
        "instruction_input",
        "OBJECT<input, instruction, output>",
        _pair(("'user'", f"concat({_text('instruction')}, if({_text('input')} = '', '', concat('\\n\\n', {_text('input')})))"), ("'assistant'", _text("output"))),
    ),
    Mapping("question", "OBJECT<answer, question>", _pair(("'user'", _text("question")), ("'assistant'", _text("answer")))),
)

def paths_of(rec: Column) -> Column:
    """A variant's nested field paths, nested as its fields are, with sorted names.

    It is Spark's own schema of the value without scalar types, so that 1 and 1.5, or a null, have the same layout:
    ``OBJECT<id, messages: ARRAY<OBJECT<content, role>>>``.
    """
    return F.regexp_replace(F.schema_of_variant(rec), r": (?!OBJECT<|ARRAY<)[A-Z_]+(?:\([0-9, ]*\))?", "")


def fingerprint(paths: Column) -> Column:
    return F.xxhash64(paths)


def canonical(records: DataFrame, rec: str = "rec", mappings: tuple[Mapping, ...] = MAPPINGS) -> DataFrame:
    """Adds fingerprint, layout (null if none is known) and turns to rows whose `rec` is a variant."""
    marked = records.withColumn("fingerprint", fingerprint(paths_of(F.col(rec))))
    if rec != "rec":
        marked = marked.withColumn("rec", F.col(rec))
    layout, turns = F.lit(None).cast("string"), F.lit(None).cast(TURNS)
    for m in mappings:
        hit = F.col("fingerprint") == fingerprint(F.lit(m.paths))
        layout = F.when(hit, F.lit(m.name)).otherwise(layout)
        turns = F.when(hit, F.expr(m.turns).cast(TURNS)).otherwise(turns)
    return marked.withColumns({"layout": layout, "turns": turns})


def unmapped(marked: DataFrame) -> DataFrame:
    return marked.filter(F.col("layout").isNull())


def escape(text: Column) -> Column:
    return F.replace(text, F.lit("<|"), F.lit(ESCAPE))


def unescape(text: Column) -> Column:
    return F.replace(text, F.lit(ESCAPE), F.lit("<|"))


def escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit("\n"), F.lit(NEWLINE))


def unescape_role(role: Column) -> Column:
    return unescape(F.replace(role, F.lit(NEWLINE), F.lit("\n")))


def render(turns: Column) -> tuple[Column, Column]:
    """The formatted text, and its loss spans (start from 0, length, in characters)."""
    parts = F.transform(turns, lambda t: F.concat(F.lit(START), escape_role(t["role"]), F.lit("\n"), escape(t["text"]), F.lit(END + "\n")))
    tail = len(END) + 1
    sizes = F.transform(turns, lambda t: F.struct((F.lit(len(START) + 1) + F.length(escape_role(t["role"]))).alias("head"), F.length(escape(t["text"])).alias("body"), (t["role"] == "assistant").alias("learn")))
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,length:int>>").alias("spans"))
    spans = F.aggregate(
        sizes,
        zero,
        lambda acc, s: F.struct(
            (acc["at"] + s["head"] + s["body"] + F.lit(tail)).alias("at"),
            F.when(s["learn"], F.concat(acc["spans"], F.array(F.struct((acc["at"] + s["head"]).alias("start"), s["body"].alias("length"))))).otherwise(acc["spans"]).alias("spans"),
        ),
    )
    return F.array_join(parts, ""), spans["spans"]


def parse(formatted: Column) -> Column:
    """The turns, read back from the formatted text."""
    blocks = F.filter(F.split(formatted, r"<\|im_end\|>\n"), lambda b: b != "")
    return F.transform(
        blocks,
        lambda b: F.struct(
            unescape_role(b.substr(F.lit(len(START) + 1), F.instr(b, "\n") - F.lit(len(START) + 1))).alias("role"),
            unescape(b.substr(F.instr(b, "\n") + F.lit(1), F.length(b))).alias("text"),
        ),
    )


def learned(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped."""
    return F.array_join(F.transform(spans, lambda s: unescape(formatted.substr(s["start"] + F.lit(1), s["length"]))), "")


def format_turn_rows(rows: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """conv_id, layout, formatted, loss_spans for rows of single turns, in any known layout.

    A conversation is the unit of output, so its turns meet in one row; nothing larger does.
    """
    named = rows.select(F.col(id_col).alias("conv_id"), F.col(turn_col).alias("turn"), F.col(role_col).alias("role"), F.col(text_col).alias("text"))
    recs = named.select("conv_id", "turn", F.to_variant_object(F.struct(*named.columns)).alias("rec"))
    marked = canonical(recs).select("conv_id", "layout", F.struct("turn", F.col("turns")[0]["role"].alias("role"), F.col("turns")[0]["text"].alias("text")).alias("t"))
    chats = marked.groupBy("conv_id").agg(F.max("layout").alias("layout"), F.array_sort(F.collect_list("t")).alias("turns"))
    formatted, spans = render(F.col("turns"))
    return chats.select("conv_id", "layout", formatted.alias("formatted"), spans.alias("loss_spans"))


def format_records(records: DataFrame, json_col: str, keep: list[str]) -> DataFrame:
    """The same for records of any known layout, given as JSON."""
    marked = canonical(records.select(*keep, F.try_parse_json(json_col).alias("rec")))
    formatted, spans = render(F.col("turns"))
    return marked.select(*keep, "layout", "fingerprint", formatted.alias("formatted"), spans.alias("loss_spans"))
