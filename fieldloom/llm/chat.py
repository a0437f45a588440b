"""Chat formatting by schema fingerprints, in DataFrame functions only.

Records are JSON objects of any layout. The sorted set of a record's nested field
paths is its fingerprint's input; the fingerprint selects a declarative mapping, which
says where turns lie. All mappings lead to one array of (role, text) turns, which a
template renders. Control strings inside roles and texts are escaped reversibly, and
``read_back`` recovers turns and the loss mask's texts from the rendered form alone.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TURNS = "array<struct<role:string,text:string>>"
#: Characters up to which no JSON text meets a limit of the parsers: 20 M characters of
#: one string, 128 MiB of all values.
PARSED_CHARS = 20_000_000
OPEN, MIDDLE, CLOSE = "### ", ":\n", "</turn>\n"


@dataclass(frozen=True)
class Mapping:
    """Where the turns of one layout lie.

    ``paths`` are the layout's nested field paths; a list is marked ``[]``. Either
    ``messages`` names a list of objects with role and text fields, or ``fields``
    gives (role, path) in order; an empty or missing field is no turn.
    """

    name: str
    paths: tuple[str, ...]
    messages: str = ""
    role_field: str = "role"
    text_field: str = "content"
    fields: tuple[tuple[str, str], ...] = ()
    #: source role → canonical role; other roles stay
    roles: tuple[tuple[str, str], ...] = ()


MAPPINGS = (
    Mapping("messages", ("messages", "messages[].content", "messages[].role"), messages="messages"),
    Mapping(
        "shared_turns",
        ("conversations", "conversations[].from", "conversations[].value"),
        messages="conversations",
        role_field="from",
        text_field="value",
        roles=(("human", "user"), ("gpt", "assistant")),
    ),
    Mapping("prompt_response", ("prompt", "response"), fields=(("user", "prompt"), ("assistant", "response"))),
    Mapping(
        "instruction",
        ("input", "instruction", "output"),
        fields=(("user", "instruction"), ("user", "input"), ("assistant", "output")),
    ),
    Mapping("instruction_only", ("instruction", "output"), fields=(("user", "instruction"), ("assistant", "output"))),
    Mapping(
        "system_prompt_response",
        ("prompt", "response", "system"),
        fields=(("system", "system"), ("user", "prompt"), ("assistant", "response")),
    ),
    Mapping(
        "nested_exchange",
        ("data", "data.answer", "data.question"),
        fields=(("user", "data.question"), ("assistant", "data.answer")),
    ),
)


def fingerprint(paths: Column) -> Column:
    """Of a set of field paths, whatever their order or repetition."""
    return F.substring(F.sha2(F.array_join(F.array_sort(F.array_distinct(paths)), "\n"), 256), 1, 16)


#: Of a schema in words: a field's name, an opening of an object or list, a closing.
SCHEMA_PIECE = r"(`(?:[^`]|``)*`|[^\s<>,:`]+): |OBJECT<|ARRAY<|>"


def field_paths(record: Column) -> Column:
    """Nested field paths of a JSON object, however deep; a list is marked ``[]``.

    A list's own paths are those of all its elements together. Null, or text that is
    no object, has none; below a list that mixes objects with other values there are none.
    """
    schema = F.schema_of_variant(F.try_parse_json(record))
    pieces = F.regexp_extract_all(schema, F.lit(SCHEMA_PIECE), F.lit(0))
    # ``at`` is the path of the value that is read, ``open`` that of each open bracket.
    state = "struct<at:string,open:array<string>,paths:array<string>>"
    start = F.struct(F.lit("").alias("at"), F.array().alias("open"), F.array().alias("paths")).cast(state)

    def step(s: Column, piece: Column) -> Column:
        prefix = F.coalesce(F.element_at(s["open"], -1), F.lit(""))
        told = F.regexp_replace(piece, ": $", "")
        quoted = F.replace(F.substr(told, F.lit(2), F.length(told) - 2), F.lit("``"), F.lit("`"))
        name = F.when(F.startswith(told, F.lit("`")), quoted).otherwise(told)
        path = F.concat(prefix, name)
        listed = F.concat(s["at"], F.lit("[]"))
        inside = F.when(s["at"] == "", "").otherwise(F.concat(s["at"], F.lit(".")))
        return (
            F.when(piece == ">", _state(prefix, F.slice(s["open"], 1, F.greatest(F.size(s["open"]) - 1, F.lit(0))), s["paths"]))
            .when(piece == "ARRAY<", _state(listed, F.array_append(s["open"], prefix), s["paths"]))
            .when(piece == "OBJECT<", _state(s["at"], F.array_append(s["open"], inside), s["paths"]))
            .otherwise(_state(path, s["open"], F.array_append(s["paths"], path)))
        )

    found = F.aggregate(pieces, start, step)["paths"]
    return F.when(F.startswith(schema, F.lit("OBJECT<")), found).otherwise(F.array().cast("array<string>"))


def _state(at: Column, opened: Column, paths: Column) -> Column:
    return F.struct(at.alias("at"), opened.alias("open"), paths.alias("paths"))


def _canonical(m: Mapping, role: Column) -> Column:
    for source, target in m.roles:
        role = F.when(role == source, target).otherwise(role)
    return role


def _turns(record: Column, m: Mapping) -> Column:
    """The mapping's turns of a JSON record."""

    if m.messages:
        shape = f"struct<`{m.messages}`:array<struct<`{m.role_field}`:string,`{m.text_field}`:string>>>"
        listed = F.from_json(record, shape[7:-1].replace("`:", "` ", 1))[m.messages]
        return F.transform(
            listed,
            lambda x: F.struct(
                _canonical(m, F.coalesce(x[m.role_field], F.lit(""))).alias("role"),
                F.coalesce(x[m.text_field], F.lit("")).alias("text"),
            ),
        )
    turns = [
        F.struct(F.lit(role).alias("role"), F.get_json_object(record, "$." + path).alias("text"))
        for role, path in m.fields
    ]
    return F.filter(F.array(*turns), lambda x: F.coalesce(x["text"], F.lit("")) != "")


def canonical_turns(records: DataFrame, record: str = "record", mappings: tuple[Mapping, ...] = MAPPINGS) -> DataFrame:
    """``records`` with ``layout_hash``, ``layout`` and ``turns``.

    A record whose fingerprint no mapping has keeps a null ``layout`` and null
    ``turns``: unknown layouts are seen, not guessed. So does a null record. A record
    that is too long for the parsers is an error, for it would look like an unknown one.
    """
    whole = F.col(record)
    too_long = (F.length(whole) > PARSED_CHARS) & F.try_parse_json(whole).isNull()
    told = F.concat(F.lit("record of "), F.length(whole).cast("string"), F.lit(" characters does not parse"))
    paths = F.when(too_long, F.raise_error(told).cast("array<string>")).otherwise(field_paths(whole))
    df = records.withColumn("layout_hash", fingerprint(paths))
    return _mapped(df, mappings, lambda m: _turns(F.col(record), m))


def _mapped(df: DataFrame, mappings: tuple[Mapping, ...], make: Callable[[Mapping], Column]) -> DataFrame:
    """Adds ``layout`` and ``turns`` by the mapping whose paths have each row's ``layout_hash``."""
    layout, turns = F.lit(None).cast("string"), F.lit(None).cast(TURNS)
    for m in mappings:
        own = F.col("layout_hash") == fingerprint(F.array(*map(F.lit, m.paths)))
        layout = F.when(own, m.name).otherwise(layout)
        turns = F.when(own, make(m)).otherwise(turns)
    return df.withColumns({"layout": layout, "turns": turns.cast(TURNS)})


def escape(text: Column) -> Column:
    """Without any control string: a backslash breaks each, and is itself doubled."""
    text = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    text = F.replace(text, F.lit("##"), F.lit("#\\#"))
    text = F.replace(text, F.lit("</"), F.lit("<\\/"))
    return F.replace(text, F.lit(":\n"), F.lit(":\\\n"))


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def render(df: DataFrame, turns: str = "turns", learned: str = "assistant") -> DataFrame:
    """Adds ``formatted`` and ``loss_mask``, a span for each turn.

    A turn is ``### role:``, a new line, its text and ``</turn>`` with a new line. A
    span says how many code points the turn is ``of``, and where in it the learned
    text begins (from 1) and how long it is; a turn that is not learned has null there.
    Null turns give an empty text. The time is linear in turns and text.
    """
    empty = F.array().cast(TURNS)
    written = F.transform(
        F.coalesce(F.col(turns), empty),
        lambda t: F.struct(
            F.concat(F.lit(OPEN), escape(F.coalesce(t["role"], F.lit(""))), F.lit(MIDDLE)).alias("head"),
            escape(F.coalesce(t["text"], F.lit(""))).alias("body"),
            (F.coalesce(t["role"], F.lit("")) == learned).alias("learned"),
        ),
    )

    def span(t: Column) -> Column:
        return F.struct(
            (F.length(t["head"]) + F.length(t["body"]) + len(CLOSE)).alias("of"),
            F.when(t["learned"], F.length(t["head"]) + 1).alias("first"),
            F.when(t["learned"], F.length(t["body"])).alias("chars"),
        )

    return df.withColumn("_written", written).withColumns(
        {
            "formatted": F.array_join(
                F.transform("_written", lambda t: F.concat(t["head"], t["body"], F.lit(CLOSE))), ""
            ),
            "loss_mask": F.transform("_written", span),
        }
    ).drop("_written")


def read_back(df: DataFrame) -> DataFrame:
    """Adds ``read_turns`` and ``loss_texts``, from ``formatted`` and ``loss_mask`` alone."""
    pieces = F.filter(F.split("formatted", CLOSE), lambda p: p != "")

    def turn(p: Column) -> Column:
        role = F.substring_index(p, MIDDLE, 1)
        return F.struct(
            unescape(F.substr(role, F.lit(len(OPEN) + 1))).alias("role"),
            unescape(F.substr(p, F.length(role) + len(MIDDLE) + 1)).alias("text"),
        )

    # Each turn is cut by its own span: no text is searched from its beginning twice.
    masked = F.zip_with(pieces, "loss_mask", lambda p, s: unescape(F.substr(p, s["first"], s["chars"])))
    return df.withColumns({"read_turns": F.transform(pieces, turn), "loss_texts": F.filter(masked, lambda x: x.isNotNull())})


def format_chats(records: DataFrame, record: str = "record", mappings: tuple[Mapping, ...] = MAPPINGS) -> DataFrame:
    """``records`` with layout, canonical ``turns``, ``formatted`` text and ``loss_mask``.

    One row for each row of ``records``; columns of the same name as an added one are
    replaced. Empty texts are empty turns in message lists, and no turns in layouts
    of single fields. Repeated records are formatted alike.
    """
    return render(canonical_turns(records, record, mappings))


def as_records(rows: DataFrame, key: str = "conv_id", order: str = "turn") -> DataFrame:
    """Rows of single turns as one JSON record of messages for each conversation.

    Turns are ordered by ``order``, null first, ties by role and text; a null role or
    text is empty. Rows without a key are one conversation with a null key.
    """
    turn = F.struct(
        F.col(order).alias("at"),
        F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
    )
    ordered = F.transform(
        F.array_sort(F.collect_list(turn)), lambda x: F.struct(x["role"].alias("role"), x["text"].alias("content"))
    )
    return rows.groupBy(key).agg(ordered.alias("messages")).select(key, F.to_json(F.struct("messages")).alias("record"))


#: Layouts of tables with a turn in each row: beside the order, who speaks and what.
ROW_MAPPINGS = (
    Mapping("turn_rows", ("role", "text"), text_field="text"),
    Mapping("message_rows", ("content", "role")),
    Mapping("shared_turn_rows", ("from", "value"), role_field="from", text_field="value", roles=(("human", "user"), ("gpt", "assistant"))),
)


def as_turns(rows: DataFrame, key: str = "conv_id", order: str = "turn", mappings: tuple[Mapping, ...] = ROW_MAPPINGS) -> DataFrame:
    """Rows of single turns as one row of ``turns`` for each conversation, ready to render.

    The fingerprint of the rows' fields, taken of a record that has them without their
    values, selects the mapping; of other columns those that some mapping names count.
    Unknown fields give a null ``layout`` and null ``turns``. No text is written to JSON
    or parsed, so no length of a text or a conversation changes the layout. Rows are
    ordered as ``as_records`` orders them; those without a key are one conversation.
    """
    named = {f for m in mappings for f in m.paths}
    skeleton = F.to_json(F.struct(*(F.lit("").alias(c) for c in rows.columns if c in named)))
    found = fingerprint(field_paths(skeleton))
    role, text, layout = F.lit(None).cast("string"), F.lit(None).cast("string"), F.lit(None).cast("string")
    for m in mappings:
        if not set(m.paths) <= set(rows.columns):
            continue
        own = found == fingerprint(F.array(*map(F.lit, m.paths)))
        said = _canonical(m, F.coalesce(F.col(m.role_field), F.lit("")))
        role = F.when(own, said).otherwise(role)
        text = F.when(own, F.coalesce(F.col(m.text_field), F.lit(""))).otherwise(text)
        layout = F.when(own, m.name).otherwise(layout)
    turn = F.struct(F.col(order).alias("at"), role.alias("role"), text.alias("text"))
    ordered = F.transform(
        F.array_sort(F.collect_list(turn)), lambda x: F.struct(x["role"].alias("role"), x["text"].alias("text"))
    )
    done = rows.groupBy(key).agg(ordered.cast(TURNS).alias("turns"))
    return done.select(
        key, found.alias("layout_hash"), layout.alias("layout"), F.when(layout.isNotNull(), F.col("turns")).alias("turns")
    )


# --- outlines: records of any layout whose texts lie beside them -----------------------


def outlines(done: DataFrame, key: str = "conv_id", turns: str = "turns", mappings: tuple[Mapping, ...] = MAPPINGS) -> DataFrame:
    """(key, outline, roles, texts): each conversation as a record of one of the layouts.

    The outline is the record's JSON with numbers of texts in the place of texts, and of a
    list its first element only; ``roles`` are as the layout writes them. So an outline is
    short, whatever the texts and however many. The key's hash proposes the layout; a
    conversation that it cannot hold (other roles in its single fields, or roles that its
    own names would take) is a list of messages.
    """
    df = done.select(key, F.transform(turns, lambda t: t["role"]).alias("roles"), F.transform(turns, lambda t: t["text"]).alias("texts"))
    choice = F.pmod(F.xxhash64(key), F.lit(len(mappings))).cast("int")
    plain = next(m for m in mappings if m.messages and not m.roles)
    outline, roles = _outline(plain), F.col("roles")
    for i, m in enumerate(mappings):
        back = {target: source for source, target in m.roles}
        fits = ~F.exists("roles", lambda r: r.isin(*back.values())) if m.roles else F.lit(True)
        if not m.messages:
            fits = F.col("roles") == F.array(*(F.lit(role) for role, _ in m.fields))
        own = (choice == i) & F.coalesce(fits, F.lit(False))
        outline = F.when(own, _outline(m)).otherwise(outline)
        if back:
            roles = F.when(own, F.transform("roles", _named(back))).otherwise(roles)
    return df.withColumns({"outline": outline, "roles": roles}).select(key, "outline", "roles", "texts")


def _named(names: dict[str, str]) -> Callable[[Column], Column]:
    def role_of(role: Column) -> Column:
        for target, source in names.items():
            role = F.when(role == target, source).otherwise(role)
        return role

    return role_of


def _outline(m: Mapping) -> Column:
    if m.messages:
        first = F.struct(F.get("roles", F.lit(0)).alias(m.role_field), (F.size("texts") - 1).cast("string").alias(m.text_field))
        return F.to_json(F.struct(F.array(first).alias(m.messages)), {"ignoreNullFields": "false"})
    tree: dict = {}
    for i, (_, path) in enumerate(m.fields):
        *above, last = path.split(".")
        at = tree
        for name in above:
            at = at.setdefault(name, {})
        at[last] = (F.size("texts") - len(m.fields) + i).cast("string")

    def built(node: dict) -> Column:
        return F.struct(*((built(v) if isinstance(v, dict) else v).alias(k) for k, v in node.items()))

    return F.to_json(built(tree))


def outlined_turns(df: DataFrame, outline: str = "outline", mappings: tuple[Mapping, ...] = MAPPINGS) -> DataFrame:
    """``df`` (outline, roles, texts) with ``layout_hash``, ``layout`` and canonical ``turns``.

    The nested field paths of each row's outline are hashed, and select its mapping, as
    those of whole records do in ``canonical_turns``; texts are fetched by their numbers
    and never parsed. A field that the outline lacks is no turn; an unknown layout, or a
    null outline, has null turns.
    """

    def turns(m: Mapping) -> Column:
        if m.messages:
            return F.zip_with("roles", "texts", lambda r, t: F.struct(_canonical(m, F.coalesce(r, F.lit(""))).alias("role"), F.coalesce(t, F.lit("")).alias("text")))
        fields = [F.struct(F.lit(role).alias("role"), F.get("texts", F.get_json_object(outline, "$." + path).cast("int")).alias("text")) for role, path in m.fields]
        return F.filter(F.array(*fields), lambda x: x["text"].isNotNull())

    return _mapped(df.withColumn("layout_hash", fingerprint(field_paths(F.col(outline)))), mappings, turns)


def digests(df: DataFrame, key: str = "conv_id") -> DataFrame:
    """What was read back, as counts and hashes."""
    told = F.transform("read_turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    loss = F.array_join("loss_texts", "")
    return df.select(
        key,
        F.size("read_turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(told, ""), 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
