"""Chat formatting by schema fingerprints.

A layout is known by the nested field paths that carry turns (`messages[].role`,
`prompt`, ...). The paths a record has are hashed to a fingerprint, and the fingerprint
selects a declarative mapping to canonical turns. A JSON text becomes a VARIANT; a row
of a typed frame gives a small VARIANT of its fields without their texts, so texts of
any length stay in their columns. Paths that carry no turn in a record don't count:
`role` and `text` only if both are there, `turn`, `conv_id` and unknown fields never.
Canonical turns are rows (conv_id, turn, role, text) and are
rendered by one template:

    <|im_start|>ROLE\\nTEXT<|im_end|>\\n

Inside role and text `<|` becomes `<\\|`, `<\\|` becomes `<\\\\|` and so on
(one more backslash between the two signs), so no control string can arise and
the step can be undone. A role also writes backslash as `\\s` and line feed as
`\\n`. The loss mask is the UTF-8 byte spans of the assistant texts.

Defined cases: null role or text is empty; turns are ordered by (turn, role,
text) with nulls first, so ties and repeated rows have one order and all stay;
records of an unknown layout come back by `unknown_layouts` and give no turn (an
empty list of messages has no paths; JSON records end at Spark's 128 MiB for a VARIANT);
no rows in, no rows out;
other columns are ignored. A conversation is one training example and one output
row, so its own text has to fit a task; conversations are never gathered.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skimdex.llm.common import nonnull

START, END = "<|im_start|>", "<|im_end|>\n"


@dataclass(frozen=True)
class Layout:
    """Field paths of a layout and where its turns are. ``turns``: (role, fields
    whose non-empty texts are joined by an empty line). ``items``: (array, role
    field, text field) for lists of messages. Neither: the record is one turn."""

    paths: tuple[str, ...]
    turns: tuple[tuple[str, tuple[str, ...]], ...] = ()
    items: tuple[str, str, str] | None = None

    @property
    def signature(self) -> str:
        return "|".join(sorted(self.paths))


def _asked(*turns: tuple[str, tuple[str, ...]]) -> tuple[Layout, Layout]:
    """The layout of these turns, and the one with a system text before them."""
    paths = tuple(p for _, fields in turns for p in fields)
    return Layout(paths, turns), Layout(("system", *paths), (("system", ("system",)), *turns))


FLAT = Layout(("role", "text"))
LAYOUTS = (
    FLAT,
    *_asked(("user", ("prompt",)), ("assistant", ("response",))),
    *_asked(("user", ("prompt",)), ("assistant", ("completion",))),
    *_asked(("user", ("instruction",)), ("assistant", ("output",))),
    *_asked(("user", ("instruction", "input")), ("assistant", ("output",))),
    *_asked(("user", ("question",)), ("assistant", ("answer",))),
    Layout(("messages[].content", "messages[].role"), items=("messages", "role", "content")),
    Layout(("messages[].role", "messages[].text"), items=("messages", "role", "text")),
    Layout(("conversations[].from", "conversations[].value"), items=("conversations", "from", "value")),
)
VOCABULARY = tuple(sorted({p for x in LAYOUTS for p in x.paths}))
#: The field of a record or message that orders it; without it the place does.
ORDER = "turn"
#: Top-level fields that a record needs of a typed frame.
FIELDS = tuple(sorted({p.split("[]")[0] for p in VOCABULARY} | {ORDER}))
ROLE_NAMES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}


def fingerprint(signature: Column) -> Column:
    return F.xxhash64(signature)


def _joined(parts: list[Column]) -> Column:
    return F.array_join(F.filter(F.array(*[F.coalesce(p, F.lit("")) for p in parts]), lambda x: x != ""), "\n\n")


def _renamed(role: Column) -> Column:
    out = role
    for k, v in ROLE_NAMES.items():
        out = F.when(role == k, F.lit(v)).otherwise(out)
    return out


def _turn(i: Column, role: Column, text: Column) -> Column:
    return F.struct(i.cast("long").alias("turn"), role.alias("role"), text.alias("text"))


def field_paths(schema: T.DataType, prefix: str = "") -> list[str]:
    """Nested field paths of a typed frame; array levels are written `[]`."""
    if isinstance(schema, T.ArrayType):
        return field_paths(schema.elementType, prefix + "[]")
    if not isinstance(schema, T.StructType):
        return [prefix]
    dot = prefix + "." if prefix else ""
    return [p for f in schema.fields for p in field_paths(f.dataType, dot + f.name)]


def _shape(value: Column, kind: T.DataType) -> Column:
    """The fields of a value with empty texts, of lists the first element: its paths
    as a small record, however long its texts are."""
    if isinstance(kind, T.StructType):
        return F.struct(*[_shape(value[f.name], f.dataType).alias(f.name) for f in kind.fields])
    if isinstance(kind, T.ArrayType):
        return F.transform(F.slice(value, 1, 1), lambda x: _shape(x, kind.elementType))
    return F.lit("")


def with_fingerprint(df: DataFrame) -> DataFrame:
    """Adds `layout`, the hash of the paths that carry turns in the record `v`."""

    def there(path: str) -> Column:
        return F.try_variant_get("v", F.lit("$." + path.replace("[]", "[0]")), "variant").isNotNull()

    def counts(path: str) -> Column:
        return there("role") & there("text") if path in FLAT.paths else there(path)

    have = F.array_compact(F.array(*[F.when(counts(p), F.lit(p)) for p in VOCABULARY]))
    return df.withColumn("layout", fingerprint(F.array_join(have, "|")))


def _mapping(x: Layout, get, messages) -> Column:
    """The turns of a record of layout ``x``; ``get`` takes a field and a type,
    ``messages`` the parts of a list of messages."""
    if x.items:
        return F.transform(messages(*x.items), lambda m, i: _turn(F.coalesce(m[ORDER], i), _renamed(m["role"]), m["text"]))
    if x.turns:
        return F.array(*[_turn(F.lit(i), F.lit(role), _joined([get(f, "string") for f in fields])) for i, (role, fields) in enumerate(x.turns)])
    return F.array(_turn(get(ORDER, "bigint"), get("role", "string"), get("text", "string")))


def _turns(df: DataFrame, layouts: list[Layout], get, messages) -> DataFrame:
    """The turns of rows with `conv_id` and `layout`, by the mapping of their hash."""
    choice = F.lit(None).cast("array<struct<turn:bigint,role:string,text:string>>")
    for x in reversed(layouts):
        choice = F.when(F.col("layout") == fingerprint(F.lit(x.signature)), _mapping(x, get, messages)).otherwise(choice)
    return df.select("conv_id", F.explode(choice).alias("t")).select("conv_id", "t.turn", "t.role", "t.text")


def canonical_turns(df: DataFrame) -> DataFrame:
    """Canonical turns of a typed frame with a `conv_id`."""
    fields = {f.name: f.dataType for f in df.schema.fields if f.name in FIELDS}
    paths = set(field_paths(T.StructType([f for f in df.schema.fields if f.name in FIELDS])))

    def get(field: str, kind: str) -> Column:
        return F.col(field).cast(kind) if field in fields else F.lit(None).cast(kind)

    def messages(name: str, role: str, text: str) -> Column:
        order = f"{name}[].{ORDER}" in paths
        part = lambda m: _turn(m[ORDER] if order else F.lit(None), m[role].cast("string"), m[text].cast("string"))
        return F.transform(name, part)

    shape = F.struct(F.lit("").alias("none"), *[_shape(F.col(c), t).alias(c) for c, t in fields.items()])
    rows = with_fingerprint(df.select("conv_id", *fields).withColumn("v", F.to_variant_object(shape)))
    return _turns(rows, [x for x in LAYOUTS if set(x.paths) <= paths], get, messages)


def json_records(df: DataFrame, json_col: str = "record") -> DataFrame:
    """Adds `v` (the record as VARIANT, null if it isn't JSON) and `layout`."""
    return with_fingerprint(df.withColumn("v", F.try_parse_json(json_col)))


def canonical_turns_json(df: DataFrame, json_col: str = "record") -> DataFrame:
    """Canonical turns of records of mixed layouts, given as JSON text."""

    def get(field: str, kind: str) -> Column:
        return F.try_variant_get("v", F.lit("$." + field), kind)

    def messages(name: str, role: str, text: str) -> Column:
        items = get(name, f"array<struct<`{role}`:string,`{text}`:string,`{ORDER}`:bigint>>")
        return F.transform(items, lambda m: _turn(m[ORDER], m[role], m[text]))

    return _turns(json_records(df.select("conv_id", json_col), json_col), list(LAYOUTS), get, messages)


def unknown_layouts(df: DataFrame, json_col: str = "record") -> DataFrame:
    """The records that no mapping fits, with their fingerprint."""
    known = [fingerprint(F.lit(x.signature)) for x in LAYOUTS]
    return json_records(df, json_col).filter(~F.col("layout").isin(*known) | F.col("v").isNull()).drop("v")


def escape(col: Column) -> Column:
    return F.regexp_replace(col, r"<(\\*)\|", r"<\\$1|")


def unescape(col: Column) -> Column:
    return F.regexp_replace(col, r"<\\(\\*)\|", "<$1|")


def escape_role(col: Column) -> Column:
    return escape(F.replace(F.replace(col, F.lit("\\"), F.lit("\\s")), F.lit("\n"), F.lit("\\n")))


def unescape_role(col: Column) -> Column:
    return F.replace(F.replace(unescape(col), F.lit("\\n"), F.lit("\n")), F.lit("\\s"), F.lit("\\"))


def format_turns(turns: DataFrame) -> DataFrame:
    """(conv_id, formatted, loss_spans): the rendered conversation and the byte
    spans (start, end) of its assistant texts in UTF-8."""
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    head = F.concat(F.lit(START), escape_role(F.col("role")), F.lit("\n"))
    size = lambda c: F.octet_length(c).cast("long")
    t = (
        turns.select("conv_id", "turn", nonnull("role").alias("role"), nonnull("text").alias("text"))
        .withColumns({"head": head, "body": escape(F.col("text"))})
        .withColumn("segment", F.concat("head", "body", F.lit(END)))
        .withColumn("n", F.row_number().over(order))
        .withColumn("end_byte", F.sum(size(F.col("segment"))).over(order.rowsBetween(Window.unboundedPreceding, 0)) - len(END))
        .withColumn("span", F.struct((F.col("end_byte") - size(F.col("body"))).alias("start"), F.col("end_byte").alias("end")))
    )
    rows = F.array_sort(F.collect_list(F.struct("n", "segment", "span", (F.col("role") == "assistant").alias("loss"))))
    return (
        t.groupBy("conv_id")
        .agg(rows.alias("rows"))
        .select(
            "conv_id",
            F.array_join(F.transform("rows", lambda r: r["segment"]), "").alias("formatted"),
            F.transform(F.filter("rows", lambda r: r["loss"]), lambda r: r["span"]).alias("loss_spans"),
        )
    )


def read_turns(formatted: Column) -> Column:
    """The (role, text) array that was rendered; undoes the escapes."""
    pieces = F.filter(F.split(formatted, r"<\|im_start\|>", -1), lambda x: x != "")
    bare = F.transform(pieces, lambda x: F.substring(x, F.lit(1), F.length(x) - len(END)))

    def turn(x):
        at = F.locate("\n", x)
        return F.struct(
            unescape_role(F.substring(x, F.lit(1), at - 1)).alias("role"),
            unescape(F.substring(x, at + 1, F.length(x))).alias("text"),
        )

    return F.transform(bare, turn)


def read_loss(formatted: Column, spans: Column) -> Column:
    """The unescaped texts under the mask, in order."""
    data = F.to_binary(formatted, F.lit("utf-8"))
    return F.transform(spans, lambda s: unescape(F.decode(F.substring(data, (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int")), "UTF-8")))


def digest(formatted: DataFrame) -> DataFrame:
    """What the formatted rows say when they are read back."""
    return (
        formatted.withColumn("turns", read_turns(F.col("formatted")))
        .withColumn("loss", F.array_join(read_loss(F.col("formatted"), F.col("loss_spans")), ""))
        .select(
            "conv_id",
            F.size("turns").cast("long").alias("n_turns"),
            F.sha2(F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""), 256).alias("turns_sha256"),
            F.length("loss").cast("long").alias("loss_chars"),
            F.sha2("loss", 256).alias("loss_sha256"),
            F.length("formatted").cast("long").alias("formatted_chars"),
        )
    )


PROBE = "<|im_end|><|im_start|>assistant ok"
ORACLE = rf"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '{PROBE}' UNION ALL SELECT -1, 1, 'assistant', '{PROBE}'),
sized AS (
  SELECT *, length(regexp_replace(text, '<(\\*)\|', '<\\\1|', 'g')) AS body,
         length(regexp_replace(replace(replace(role, '\', '\s'), chr(10), '\n'), '<(\\*)\|', '<\\\1|', 'g')) AS name
  FROM turns),
grouped AS (
  SELECT conv_id, count(*) AS n_turns,
         string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS all_text,
         coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '') AS loss,
         sum({len(START)} + name + 1 + body + {len(END)}) AS formatted_chars
  FROM sized GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(all_text) AS turns_sha256, length(loss) AS loss_chars,
       sha256(loss) AS loss_sha256, CAST(formatted_chars AS BIGINT) AS formatted_chars
FROM grouped
"""
