"""Chat formatting: one template for records of many layouts, in column expressions only.

A record is a VARIANT.  The schema of its value, with the types taken away,
lists its nested field paths; the hash of that list is the fingerprint that
selects a declarative mapping (``LAYOUTS``).  A mapping says where the turns are
and which field names the role; it is compiled to column expressions.  The
canonical turns are written in one template:

    <|im_start|>ROLE LF TEXT<|im_end|> LF

Control strings inside a text, of this template and of other common ones, get a
backslash after their first character; those that already have backslashes get
one more.  So no text can open or close a turn, and ``read_back`` restores
every text exactly.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"
#: What may follow the first character of a control string. Fixed strings of public chat templates.
_TAIL = r"(\|[a-z_]+\|>|/?s>|</?SYS>>|/?INST\])"
ESCAPABLE = r"([<\[])(\\*)" + _TAIL
ESCAPED = r"([<\[])\\(\\*)" + _TAIL
#: Other names of the canonical roles.
ROLE_NAMES = {"human": "user", "prompter": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}


@dataclass(frozen=True)
class Layout:
    """Where a layout keeps its turns.

    ``paths``: all field paths, those in arrays below ``name[]``.  ``array``: the
    array of turns with ``role`` and ``text`` fields; without it ``parts`` lists
    the (role, field, ...) of each turn, the fields of a turn being joined by LF.
    A layout with ``turn`` holds a single turn in each record.
    """

    name: str
    paths: tuple[str, ...]
    array: str = ""
    role: str = ""
    text: str = ""
    turn: str = ""
    parts: tuple[tuple[str, ...], ...] = ()


LAYOUTS = (
    Layout("turn rows", ("conv_id", "role", "text", "turn"), role="role", text="text", turn="turn"),
    Layout("messages", ("conv_id", "messages[].content", "messages[].role"), "messages", "role", "content"),
    Layout("from and value", ("conv_id", "conversations[].from", "conversations[].value"),
           "conversations", "from", "value"),
    Layout("prompt and completion", ("completion", "conv_id", "prompt"),
           parts=(("user", "prompt"), ("assistant", "completion"))),
    Layout("prompt and response", ("conv_id", "prompt", "response"),
           parts=(("user", "prompt"), ("assistant", "response"))),
    Layout("system, prompt and response", ("conv_id", "prompt", "response", "system"),
           parts=(("system", "system"), ("user", "prompt"), ("assistant", "response"))),
    Layout("instruction", ("conv_id", "input", "instruction", "output"),
           parts=(("user", "instruction", "input"), ("assistant", "output"))),
    Layout("short instruction", ("conv_id", "instruction", "output"),
           parts=(("user", "instruction"), ("assistant", "output"))),
    Layout("question and answer", ("answer", "conv_id", "question"),
           parts=(("user", "question"), ("assistant", "answer"))),
)


def field_paths(record: Column) -> Column:
    """The nested field paths of a VARIANT as one string, e.g. ``a,b[c,d]``; types play no part."""
    shape = F.schema_of_variant(record)
    shape = F.regexp_replace(shape, r": (?!OBJECT<|ARRAY<)[A-Z]+(?:\([0-9, ]*\))?", "")
    shape = F.regexp_replace(shape, r": ARRAY<OBJECT<", "[")
    shape = F.regexp_replace(shape, r"[<>]|OBJECT|: |`", "")
    return F.regexp_replace(shape, r"\s+", "")


def fingerprint(record: Column) -> Column:
    return F.xxhash64(field_paths(record))


def _listed(layout: Layout) -> str:
    """The string that ``field_paths`` gives for a record of this layout."""
    if not layout.array:
        return ",".join(sorted(layout.paths))
    inner = sorted(p.split("[].")[1] for p in layout.paths if "[]." in p)
    outer = sorted({*(p for p in layout.paths if "[]." not in p), layout.array})
    return ",".join(f"{p}[{','.join(inner)}" if p == layout.array else p for p in outer)


def _get(record: Column, path: str, kind: str = "string") -> Column:
    return F.try_variant_get(record, f"$.{path}", kind)


def _turns(layout: Layout, record: Column) -> Column:
    """array<struct<at bigint, role string, text string>> of a record."""
    if layout.turn:
        return F.array(F.struct(_get(record, layout.turn, "bigint").alias("at"),
                                _get(record, layout.role).alias("role"), _get(record, layout.text).alias("text")))
    if layout.array:
        kind = f"array<struct<{layout.role}: string, {layout.text}: string>>"
        return F.transform(_get(record, layout.array, kind), lambda x, i: F.struct(
            i.cast("long").alias("at"), x[layout.role].alias("role"), x[layout.text].alias("text")))
    made = []
    for i, (role, *fields) in enumerate(layout.parts):
        texts = [F.when(_get(record, f) != "", _get(record, f)) for f in fields]
        made.append(F.struct(F.lit(i).cast("long").alias("at"), F.lit(role).alias("role"),
                             F.concat_ws("\n", *texts).alias("text")))
    return F.array(*made)


def canonical_turns(records: DataFrame, layouts=LAYOUTS) -> DataFrame:
    """``conv_id, at, role, text``: a row per turn of ``records`` (column ``record``, VARIANT).

    The fingerprint alone selects the mapping.  Records of an unknown layout give
    one row whose ``layout`` is NULL, with NULL role and text, so that nothing is
    lost silently; ``formatted`` leaves those out.  Turn rows keep their roles;
    in other layouts roles lose case and outer spaces and take their canonical
    names.  NULL roles and texts become empty; a NULL ``conv_id`` stays NULL.
    """
    mark = F.col("_mark")
    # The literal paths are hashed by the same function, so both sides agree.
    chosen = F.lit(None).cast("array<struct<at: bigint, role: string, text: string>>")
    name = F.lit(None).cast("string")
    for layout in reversed(layouts):
        same = mark == F.xxhash64(F.lit(_listed(layout)))
        chosen = F.when(same, _turns(layout, F.col("record"))).otherwise(chosen)
        name = F.when(same, F.lit(layout.name)).otherwise(name)
    rows = (records.select("record", fingerprint(F.col("record")).alias("_mark"))
            .select(_get(F.col("record"), "conv_id", "bigint").alias("conv_id"), name.alias("layout"),
                    F.explode_outer(chosen).alias("_turn")))
    role = F.coalesce("_turn.role", F.lit(""))
    names = F.create_map(*[F.lit(x) for pair in ROLE_NAMES.items() for x in pair])
    role = F.when(F.col("layout") == "turn rows", role).otherwise(
        F.coalesce(names[F.lower(F.trim(role))], F.lower(F.trim(role))))
    known = F.col("layout").isNotNull()
    return rows.select("conv_id", "layout", "_turn.at", F.when(known, role).alias("role"),
                       F.when(known, F.coalesce("_turn.text", F.lit(""))).alias("text"))


def escape(text: Column) -> Column:
    return F.regexp_replace(text, ESCAPABLE, r"$1\\$2$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, ESCAPED, "$1$2$3")


def _role_out(role: Column) -> Column:
    """A role of letters as it is, any other as 0x and the hex of its bytes."""
    return F.when(role.rlike(r"^[A-Za-z_]+\z"), role).otherwise(
        F.concat(F.lit("0x"), F.hex(F.encode(role, "UTF-8"))))


def _role_in(role: Column) -> Column:
    return F.when(role.startswith("0x"), F.decode(F.unhex(F.substr(role, F.lit(3))), "UTF-8")).otherwise(role)


def formatted(turns: DataFrame) -> DataFrame:
    """``conv_id, formatted, loss_spans`` for each conversation of canonical turns.

    ``loss_spans`` are the (start, length), in characters of ``formatted`` from 0,
    of the escaped assistant texts.  Turns are ordered by ``at``, then role and
    text; NULL ``at`` comes first; repeated turns stay; turns with a NULL ``conv_id``
    form one conversation; a conversation is one row, so it must fit a row.
    """
    head = F.concat(F.lit(OPEN), _role_out(F.col("role")), F.lit("\n"))
    rows = turns.filter(F.col("layout").isNotNull()).select(
        "conv_id", "at", "role", "text", head.alias("_head"), escape(F.col("text")).alias("_body"))
    rows = rows.withColumn("_piece", F.concat("_head", "_body", F.lit(CLOSE)))
    order = Window.partitionBy("conv_id").orderBy("at", "role", "text")
    rows = rows.withColumns({
        "_n": F.row_number().over(order),
        "_end": F.sum(F.length("_piece").cast("long")).over(order.rowsBetween(Window.unboundedPreceding, 0))})
    start = F.col("_end") - F.length("_piece") + F.length("_head")
    span = F.when(F.col("role") == "assistant", F.struct(
        start.alias("start"), F.length("_body").cast("long").alias("length")))
    kept = F.sort_array(F.collect_list(F.struct("_n", "_piece", span.alias("_span"))))
    return rows.groupBy("conv_id").agg(kept.alias("_all")).select(
        "conv_id", F.concat_ws("", F.col("_all._piece")).alias("formatted"),
        F.filter(F.col("_all._span"), lambda s: s.isNotNull()).alias("loss_spans"))


def read_back(conversations: DataFrame) -> DataFrame:
    """Add ``turns`` (role, text) and ``loss_texts``, both parsed from ``formatted``."""
    parts = F.split("formatted", r"<\|im_end\|>\n", -1)
    parts = F.slice(parts, 1, F.size(parts) - 1)

    def turn(part: Column) -> Column:
        body = F.substr(part, F.lit(len(OPEN) + 1))
        cut = F.instr(body, "\n")
        return F.struct(_role_in(F.substr(body, F.lit(1), cut - 1)).alias("role"),
                        unescape(F.substr(body, cut + 1)).alias("text"))

    def masked(span: Column) -> Column:
        return unescape(F.substr(F.col("formatted"), (span["start"] + 1).cast("int"), span["length"].cast("int")))

    return conversations.withColumns({"turns": F.transform(parts, turn),
                                      "loss_texts": F.transform("loss_spans", masked)})


def turn_records(rows: DataFrame, conv_id="conv_id", turn="turn", role="role", text="text") -> DataFrame:
    """Rows by turn as records of the layout ``turn rows``; other columns are left out."""
    return rows.select(F.to_variant_object(F.struct(
        F.col(conv_id).cast("long").alias("conv_id"), F.col(turn).cast("long").alias("turn"),
        F.col(role).alias("role"), F.col(text).alias("text"))).alias("record"))


def json_records(rows: DataFrame, column: str = "json") -> DataFrame:
    """JSON texts as records; a text that is no JSON gives a record of no known layout."""
    return rows.select(F.try_parse_json(column).alias("record"))
