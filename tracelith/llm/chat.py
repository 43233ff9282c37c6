"""Chat formatting with DataFrame functions only.

Records come in different layouts (prompt and response, instruction, messages), as JSON texts or as struct columns. A record's nested field
paths, as far as any layout knows them, are sorted and hashed; the hash selects a declarative mapping to canonical turns (role, text). In a
struct a null field is an absent one. Paths that hold text but are no layout's own set take the mapping ``mixed``, which makes a turn of
whatever is there, so that no record with text in known fields comes out without turns. Fields that no layout knows are passed
over; records without text in known fields, and JSON that is no object, get layout null and no turns.

The template writes a turn as ``<|role|>text</s>``. In texts and roles ``&``, ``<`` and ``[`` (roles: ``|`` too) become entities, so every control
string that begins with one of them (``</s>``, ``<|``, ``[INST]``, ``[/INST]``) is broken, and reading back is exact. The loss mask is a list of
(turn, start, end), one for each assistant text: code points from the beginning of that turn's part of the output, each part ending with ``</s>``.
Places within parts make formatting and reading linear in a conversation's length and its number of turns. ``read_back`` needs the
formatted text and the mask only.

Null texts and roles count as empty. Turns are ordered by (turn, role, text), null turns first; repeated rows are turns each. Rows of a
null conv_id form one conversation. A conversation is one output row and so one task's work; nothing larger is gathered. Texts are whole, up
to what one Spark value holds (2 GB); JSON strings are read without the parser's usual limit. Tables without rows give no rows. ``canonical``,
``formatted`` and ``read_back`` add columns to those of their input and replace any of the same names (fingerprint, layout, turns;
formatted, loss; read, loss_text); names that begin with ``_tracelith_`` are reserved. ``digests`` reads four columns and ignores others.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

MESSAGES = "transform(filter(r.messages, m -> m is not null), m -> struct(m.role as role, m.content as text))"
CONVERSATIONS = "transform(filter(r.conversations, m -> m is not null), m -> struct(case m.from when 'human' then 'user' when 'gpt' then 'assistant' else m.from end as role, m.value as text))"
#: Layouts: name, field paths, turns as SQL over the parsed record ``r``. Optional fields make a layout of their own.
LAYOUTS = (
    ("messages", ["messages", "messages[].content", "messages[].role"], MESSAGES),
    ("conversations", ["conversations", "conversations[].from", "conversations[].value"], CONVERSATIONS),
    ("prompt", ["prompt", "response"], "array(struct('user' as role, r.prompt as text), struct('assistant' as role, r.response as text))"),
    ("prompt-completion", ["prompt", "completion"], "array(struct('user' as role, r.prompt as text), struct('assistant' as role, r.completion as text))"),
    ("prompt-system", ["prompt", "response", "system"], "array(struct('system' as role, r.system as text), struct('user' as role, r.prompt as text), struct('assistant' as role, r.response as text))"),
    ("instruction", ["instruction", "output"], "array(struct('user' as role, r.instruction as text), struct('assistant' as role, r.output as text))"),
    ("instruction-input", ["input", "instruction", "output"], "array(struct('user' as role, concat(coalesce(r.instruction, ''), if(coalesce(r.input, '') = '', '', concat('\\n\\n', r.input))) as text), struct('assistant' as role, r.output as text))"),
)
#: Any other set of paths: what is there, in this order; user texts are one turn.
MIXED = f"""concat(filter(array(struct('system' as role, r.system as text)), t -> t.text is not null), coalesce({MESSAGES}, array()), coalesce({CONVERSATIONS}, array()),
  if(coalesce(r.prompt, r.instruction, r.input) is null, array(), array(struct('user' as role, array_join(filter(array(r.prompt, r.instruction, r.input), x -> x <> ''), '\\n\\n') as text))),
  filter(transform(array(r.response, r.completion, r.output), x -> struct('assistant' as role, x as text)), t -> t.text is not null))"""
CONTAINERS = {"messages": ("role", "content"), "conversations": ("from", "value")}
TEXTS = ("prompt", "response", "completion", "system", "instruction", "input", "output")
FIELDS = {c: f"array<struct<{', '.join(f'`{f}`: string' for f in fs)}>>" for c, fs in CONTAINERS.items()} | dict.fromkeys(TEXTS, "string")
RECORD = ", ".join(f"{n} {t}" for n, t in FIELDS.items())
#: Strings of any length; the parser's own default would give null beyond 20 million characters.
JSON_OPTIONS = "map('maxStringLen', '2147483647')"
#: Entities in the order of escaping; reading back takes them in the reverse order (fixed values of the template).
ENTITIES = (("&", "&amp;"), ("<", "&lt;"), ("[", "&#91;"))
BAR = ("|", "&#124;")
END = "</s>"


def escape(x: str, role: bool = False) -> str:
    """SQL that escapes the SQL expression ``x``."""
    for a, b in (*ENTITIES, *([BAR] if role else [])):
        x = f"replace({x}, '{a}', '{b}')"
    return x


def unescape(x: str) -> str:
    for a, b in reversed((*ENTITIES, BAR)):
        x = f"replace({x}, '{b}', '{a}')"
    return x


def _let(name: str, value: str, body: str) -> str:
    """SQL for ``body`` with ``name`` bound to ``value``, which is computed once: a column that a lambda captures might be computed for each element."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def known_paths() -> list[str]:
    return sorted([*TEXTS, *CONTAINERS, *(f"{c}[].{f}" for c, fs in CONTAINERS.items() for f in fs)])


def text_paths() -> list[str]:
    return [*TEXTS, *(f"{c}[].{text}" for c, (_, text) in CONTAINERS.items())]


def _is_struct(df: DataFrame, column: str) -> bool:
    return isinstance(df.schema[column].dataType, StructType)


def json_paths(record: str) -> str:
    """SQL: the nested field paths of a JSON text; null if it isn't an object."""
    elements = lambda c: f"coalesce(from_json({record}, '{c} array<string>', {JSON_OPTIONS}).{c}, array())"
    inner = [f"transform(array_distinct(flatten(transform({elements(c)}, e -> coalesce(json_object_keys(e), array())))), f -> concat('{c}[].', f))" for c in CONTAINERS]
    return f"concat(json_object_keys({record}), {', '.join(inner)})"


def struct_paths(record: str) -> str:
    """SQL: the paths of the fields that aren't null in a struct of the type RECORD."""
    there = [f"if({record}.{n} is not null, '{n}', null)" for n in (*TEXTS, *CONTAINERS)]
    there += [f"if(exists({record}.{c}, m -> m.`{f}` is not null), '{c}[].{f}', null)" for c, fs in CONTAINERS.items() for f in fs]
    return f"filter(array({', '.join(there)}), p -> p is not null)"


def field_paths(paths: str) -> Column:
    """The sorted distinct paths that any layout knows."""
    known = ", ".join(f"'{p}'" for p in known_paths())
    return F.expr(f"array_sort(array_distinct(filter({paths}, p -> p in ({known}))))")


def canonical(records: DataFrame, record: str = "record") -> DataFrame:
    """Adds fingerprint, layout and turns (array of role and text, nulls as empty texts). The record is a JSON text or a struct with fields of RECORD."""
    if _is_struct(records, record):
        own = set(records.schema[record].dataType.names)
        fields = [f"'{n}', {f'{record}.{n}' if n in own else f'cast(null as {t})'}" for n, t in FIELDS.items()]
        parsed, paths = f"named_struct({', '.join(fields)})", struct_paths("_tracelith_record")
    else:
        parsed, paths = f"from_json({record}, '{RECORD}', {JSON_OPTIONS})", json_paths(record)
    out = records.withColumn("_tracelith_record", F.expr(parsed)).withColumn("_tracelith_paths", field_paths(paths))
    out = out.withColumn("fingerprint", F.xxhash64(F.array_join("_tracelith_paths", "\n")))
    some = F.arrays_overlap("_tracelith_paths", F.array(*map(F.lit, text_paths())))
    layout, turns = F.when(some, "mixed"), F.when(some, F.expr(MIXED.replace("r.", "_tracelith_record.")))
    for name, own_paths, mapping in LAYOUTS:
        match = F.col("fingerprint") == F.xxhash64(F.lit("\n".join(sorted(own_paths))))
        layout, turns = F.when(match, name).otherwise(layout), F.when(match, F.expr(mapping.replace("r.", "_tracelith_record."))).otherwise(turns)
    out = out.withColumn("layout", layout).withColumn("turns", turns)
    clean = "transform(filter(coalesce(turns, array()), t -> t is not null), t -> struct(coalesce(t.role, '') as role, coalesce(t.text, '') as text))"
    return out.withColumn("turns", F.expr(clean)).drop("_tracelith_record", "_tracelith_paths")


def formatted(turns: DataFrame) -> DataFrame:
    """Adds ``formatted`` and ``loss`` (array of turn, start and end) to a frame with ``turns``."""
    parts = f"transform(turns, t -> struct(concat('<|', {escape('t.role', True)}, '|>') as mark, {escape('t.text')} as body, t.role = 'assistant' as loss))"
    spans = "transform(_tracelith_parts, (p, i) -> struct(p.loss as loss, i as turn, length(p.mark) as start, length(p.mark) + length(p.body) as end))"
    out = turns.withColumn("_tracelith_parts", F.expr(parts))
    out = out.withColumn("formatted", F.expr(f"array_join(transform(_tracelith_parts, p -> concat(p.mark, p.body, '{END}')), '')"))
    return out.withColumn("loss", F.expr(f"transform(filter({spans}, x -> x.loss), x -> struct(x.turn as turn, x.start as start, x.end as end))")).drop("_tracelith_parts")


def read_back(df: DataFrame) -> DataFrame:
    """Adds ``read`` (turns) and ``loss_text`` from ``formatted`` and ``loss`` alone."""
    pieces = _let("p", f"split(formatted, '{END}', -1)", "slice(p, 1, size(p) - 1)")  # what follows the last end is no turn
    turn = f"struct({unescape('substring(x, 3, locate(' + repr('|>') + ', x) - 3)')} as role, {unescape('substring(x, locate(' + repr('|>') + ', x) + 2)')} as text)"
    lost = f"array_join(transform(loss, s -> {unescape('substring(element_at(p, s.turn + 1), s.start + 1, s.end - s.start)')}), '')"
    both = _let("p", pieces, f"struct(transform(p, x -> {turn}) as read, {lost} as loss_text)")
    out = df.withColumn("_tracelith_both", F.expr(both))
    return out.withColumn("read", F.col("_tracelith_both.read")).withColumn("loss_text", F.col("_tracelith_both.loss_text")).drop("_tracelith_both")


def records_of(conversations: DataFrame) -> DataFrame:
    """(conv_id, record): the rows of each conversation as one record, a struct in the layout that its shape suits.

    A user's text with an assistant's answer: prompt and response, with the system's text before it if there is one. Longer talks of these
    roles that begin with the user: conversations. All others: messages.
    """
    rows = conversations.select("conv_id", F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).alias("t"))
    grouped = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("t")).withColumn("roles", F.expr("transform(t, x -> x.role)"))
    shape = F.expr("""case when roles = array('user', 'assistant') then 'prompt' when roles = array('system', 'user', 'assistant') then 'prompt-system'
      when roles[0] = 'user' and forall(roles, r -> r in ('user', 'assistant', 'system')) then 'conversations' else 'messages' end""")
    shaped = grouped.withColumn("shape", shape)
    fields = {
        "messages": ("shape = 'messages'", "transform(t, x -> struct(x.role as role, x.text as content))"),
        "conversations": ("shape = 'conversations'", "transform(t, x -> struct(case x.role when 'user' then 'human' when 'assistant' then 'gpt' else x.role end as `from`, x.text as value))"),
        "system": ("shape = 'prompt-system'", "t[0].text"), "prompt": ("shape in ('prompt', 'prompt-system')", "t[size(t) - 2].text"), "response": ("shape in ('prompt', 'prompt-system')", "t[size(t) - 1].text"),
    }
    return shaped.select("conv_id", F.struct(*(F.expr(f"if({when}, {value}, null)").alias(name) for name, (when, value) in fields.items())).alias("record"))


def probe(spark: SparkSession) -> DataFrame:
    """Conversation -7: both sides say the template's own control strings."""
    return spark.sql("SELECT -7L AS conv_id, turn, role, '</s>[INST] ok [/INST]' AS text FROM VALUES (0L, 'user'), (1L, 'assistant') AS t(turn, role)")


def digests(conversations: DataFrame) -> DataFrame:
    """Formats every conversation, reads the output back and returns its digests."""
    done = read_back(formatted(canonical(records_of(conversations))))
    return done.select(
        "conv_id", F.size("read").cast("long").alias("n_turns"),
        F.sha2(F.expr("array_join(transform(read, t -> concat(t.role, '\\n', t.text, '\\n')), '')"), 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"), F.sha2("loss_text", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"), "layout",
    )
