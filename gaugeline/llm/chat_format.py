"""Chat formatting: records of many layouts become canonical turns and one training string with its loss mask.

A record's *fingerprint* is a hash of the nested field paths it holds (``messages[]``, ``messages[].role``, ...). A
layout declares the paths it needs, those it may have and how its turns are read; the fingerprints of all its forms are
known when the plan is built, so a record finds its layout by one hash. Everything is a DataFrame expression.

Nulls: a path whose value is null counts as absent; null roles and texts of a list's entries become empty texts; a null
entry of a list is a turn of empty role and text. Records that fit no layout keep a null ``layout``, ``turns`` and
``formatted``. An empty list gives no turns and an empty string. Columns that no layout names are ignored, so extra
columns of any name do no harm. Texts and roles may hold anything, control strings included: they are escaped and read
back unchanged. A conversation is one training example, so its turns end up in one row, whatever the number.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import any_of, col


@dataclass(frozen=True)
class Turn:
    """One turn: a fixed role and the texts at ``paths``, those present joined by a blank line; none present, no turn."""

    role: str
    paths: tuple[str, ...]


@dataclass(frozen=True)
class Each:
    """One turn an entry of the list at ``path``; ``roles`` renames roles, others stay."""

    path: str
    role: str
    text: str
    roles: dict[str, str] = field(default_factory=dict, hash=False)


@dataclass(frozen=True)
class Layout:
    """A declared layout: paths every record holds, paths it may hold, and the turns in order."""

    name: str
    required: tuple[str, ...]
    optional: tuple[str, ...]
    turns: tuple[Turn | Each, ...]

    def forms(self) -> list[str]:
        """The path lists of all records of this layout."""
        return [
            "\n".join(sorted(self.required + some))
            for n in range(len(self.optional) + 1)
            for some in combinations(self.optional, n)
        ]


def _entries(path: str, role: str, text: str) -> dict:
    return {"required": (f"{path}[]",), "optional": (f"{path}[].{role}", f"{path}[].{text}")}


LAYOUTS = (
    Layout("messages", **_entries("messages", "role", "content"), turns=(Each("messages", "role", "content"),)),
    Layout("message_texts", **_entries("messages", "role", "text"), turns=(Each("messages", "role", "text"),)),
    Layout(
        "conversations",
        **_entries("conversations", "from", "value"),
        turns=(Each("conversations", "from", "value", {"human": "user", "gpt": "assistant"}),),
    ),
    Layout(
        "instruction",
        ("instruction", "output"),
        ("input", "system"),
        (Turn("system", ("system",)), Turn("user", ("instruction", "input")), Turn("assistant", ("output",))),
    ),
    Layout("prompt", ("prompt", "completion"), ("system",),
           (Turn("system", ("system",)), Turn("user", ("prompt",)), Turn("assistant", ("completion",)))),
    Layout("question", ("question", "answer"), ("context",),
           (Turn("user", ("context", "question")), Turn("assistant", ("answer",)))),
)


@dataclass(frozen=True)
class Template:
    """Marks around a turn: ``open`` role newline text ``close``. Both marks start with ``<|``, which escaping takes from texts."""

    open: str = "<|im_start|>"
    close: str = "<|im_end|>\n"
    loss_roles: tuple[str, ...] = ("assistant",)


def schema_paths(schema: T.StructType, prefix: str = "") -> list[str]:
    """Nested field paths of a schema: lists as ``a[]``, fields of a list's entries as ``a[].b``."""
    found = []
    for f in schema.fields:
        path, kind = prefix + f.name, f.dataType
        while isinstance(kind, T.ArrayType):
            path, kind = path + "[]", kind.elementType
            found.append(path)
        if isinstance(kind, T.StructType):
            found += schema_paths(kind, path + ".")
        elif not path.endswith("[]"):
            found.append(path)
    return found


def _present(path: str) -> Column:
    """True where a record holds a value at ``path``."""

    def down(value: Column | None, steps: list[str]) -> Column:
        if not steps:
            return value.isNotNull()
        name, lists = steps[0].rstrip("[]"), steps[0].count("[]")
        value = col(name) if value is None else value.getField(name)

        def inside(v: Column, depth: int) -> Column:
            if depth == 0:
                return down(v, steps[1:])
            if depth == 1 and not steps[1:]:
                return v.isNotNull()
            return F.coalesce(F.exists(v, lambda x: inside(x, depth - 1)), F.lit(False))

        return inside(value, lists)

    return down(None, path.split("."))


def _hash(paths: Column) -> Column:
    return F.xxhash64(F.lit("paths"), paths)


def fingerprint(schema: T.StructType, layouts: Sequence[Layout] = LAYOUTS) -> Column:
    """Hash of the sorted paths a record holds, of those that some layout names."""
    named = {p for layout in layouts for p in layout.required + layout.optional}
    paths = sorted(named & set(schema_paths(schema)))
    return _hash(F.concat_ws("\n", *[F.when(_present(p), F.lit(p)) for p in paths]))


def _empty(text: Column) -> Column:
    return F.coalesce(text.cast("string"), F.lit(""))


def _turn(role: Column, text: Column) -> Column:
    return F.struct(role.alias("role"), text.alias("text"))


def _field(path: str) -> Column:
    first, *rest = path.split(".")
    return reduce(lambda c, name: c.getField(name), rest, col(first))


def _reader(rule: Each, paths: set[str]) -> Callable[[Column], Column]:
    """Turn of a list's entry."""
    have = [n if f"{rule.path}[].{n}" in paths else None for n in (rule.role, rule.text)]

    def read(x: Column) -> Column:
        role, text = (_empty(x.getField(n)) if n else F.lit("") for n in have)
        for old, new in rule.roles.items():
            role = F.when(role == old, new).otherwise(role)
        return _turn(role, text)

    return read


def _turns(layout: Layout, paths: set[str]) -> Column:
    parts = []
    for rule in layout.turns:
        if isinstance(rule, Each):
            parts.append(F.transform(_field(rule.path), _reader(rule, paths)))
        else:
            known = [p for p in rule.paths if p in paths]
            if known:
                there = any_of([_field(p).isNotNull() for p in known])
                text = F.concat_ws("\n\n", *[_field(p).cast("string") for p in known])
                parts.append(F.when(there, F.array(_turn(F.lit(rule.role), text))).otherwise(F.array()))
    return F.concat(*parts) if len(parts) > 1 else parts[0]


def canonical_turns(records: DataFrame, keep: Sequence[str] = (), layouts: Sequence[Layout] = LAYOUTS) -> DataFrame:
    """``keep``, ``fingerprint``, ``layout`` and ``turns`` (list of ``role``, ``text``), one row per record.

    ``records`` holds its fields as columns, nested or not. ``keep`` names columns to carry; they can't be called as the
    three new ones.
    """
    paths = set(schema_paths(records.schema))
    possible = [x for x in layouts if paths.issuperset(x.required)]
    hashed = records.withColumn("_paths", fingerprint(records.schema, layouts))
    name, turns = F.lit(None).cast("string"), F.lit(None).cast("array<struct<role:string,text:string>>")
    for layout in reversed(possible):
        fits = any_of([F.col("_paths") == _hash(F.lit(form)) for form in layout.forms()])
        name = F.when(fits, layout.name).otherwise(name)
        turns = F.when(fits, _turns(layout, paths)).otherwise(turns)
    return hashed.select(
        *[col(c) for c in keep], F.col("_paths").alias("fingerprint"), name.alias("layout"), turns.alias("turns")
    )


def parse_records(df: DataFrame, text: str, keep: Sequence[str] = (), layouts: Sequence[Layout] = LAYOUTS) -> DataFrame:
    """Records given as JSON texts, as columns that ``canonical_turns`` takes; a text that is no JSON object holds no path."""
    tree: dict = {}
    for path in (p for layout in layouts for p in layout.required + layout.optional):
        node = tree
        for step in path.split("."):
            node = node.setdefault(step, {})

    def kind(node: dict, lists: int) -> T.DataType:
        inner = T.StructType([T.StructField(k.rstrip("[]"), kind(v, k.count("[]"))) for k, v in node.items()]) if node else T.StringType()
        for _ in range(lists):
            inner = T.ArrayType(inner)
        return inner

    parsed = df.select(*[col(c) for c in keep], F.from_json(col(text), kind(tree, 0)).alias("_record"))
    return parsed.select(*[col(c) for c in keep], *[F.col("_record").getField(f.name).alias(f.name) for f in kind(tree, 0).fields])


def escape(text: Column) -> Column:
    """A text in which ``<|`` doesn't occur: between ``<`` and ``|`` goes one backslash more than there is."""
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", r"<$1|")


def _role_out(role: Column) -> Column:
    return F.replace(F.replace(F.replace(role, F.lit("%"), F.lit("%25")), F.lit("\n"), F.lit("%0A")), F.lit("<"), F.lit("%3C"))


def _role_in(role: Column) -> Column:
    return F.replace(F.replace(F.replace(role, F.lit("%3C"), F.lit("<")), F.lit("%0A"), F.lit("\n")), F.lit("%25"), F.lit("%"))


def format_chats(chats: DataFrame, template: Template = Template()) -> DataFrame:
    """``chats`` (with ``turns``) with ``formatted`` and ``loss_mask`` added.

    The mask is a run-length code of the formatted string's UTF-8 bytes: an entry a turn, ``skip`` bytes outside the loss,
    then ``take`` bytes under it; what follows up to the next turn is outside.
    """
    pieces = F.transform(
        "turns",
        lambda t: F.struct(
            F.concat(F.lit(template.open), _role_out(t["role"]), F.lit("\n")).alias("head"),
            escape(t["text"]).alias("body"),
            t["role"].isin(list(template.loss_roles)).alias("learnt"),
        ),
    )
    return (
        chats.withColumn("_pieces", pieces)
        .withColumn("formatted", F.array_join(F.transform("_pieces", lambda p: F.concat(p["head"], p["body"], F.lit(template.close))), ""))
        .withColumn(
            "loss_mask",
            F.transform(
                "_pieces",
                lambda p: F.struct(
                    F.octet_length(p["head"]).cast("bigint").alias("skip"),
                    F.when(p["learnt"], F.octet_length(p["body"])).otherwise(0).cast("bigint").alias("take"),
                ),
            ),
        )
        .drop("_pieces")
    )


def read_back(formatted: DataFrame, template: Template = Template()) -> DataFrame:
    """``formatted`` rows with what their string and mask say: ``read_turns`` and ``read_loss`` (the learnt texts in order).

    No mark occurs inside a text, so the string is cut at the opening marks; each cut holds one turn and one entry of the
    mask. Linear in the string's length.
    """
    opening = "".join("\\" + c if not c.isalnum() and c != "_" else c for c in template.open)
    cut = F.filter(F.split("formatted", f"(?={opening})", -1), lambda c: c != "")

    def turn(c: Column) -> Column:
        rest = F.substring(c, F.lit(len(template.open) + 1), F.length(c))
        role = F.substring_index(rest, "\n", 1)
        body = F.substring(rest, F.length(role) + 2, F.length(rest) - F.length(role) - 1 - len(template.close))
        return _turn(_role_in(role), unescape(body))

    def learnt(c: Column, i: Column) -> Column:
        run = F.col("loss_mask")[i]
        raw = F.substring(c.cast("binary"), (run["skip"] + 1).cast("int"), run["take"].cast("int"))
        return unescape(raw.cast("string"))

    return (
        formatted.withColumn("_cuts", cut)
        .withColumn("read_turns", F.transform("_cuts", turn))
        .withColumn("read_loss", F.transform("_cuts", learnt))
        .drop("_cuts")
    )


def gather_turns(rows: DataFrame, *, id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One record per conversation of a table of turns: ``id`` and ``messages``, by turn (null first), then role and text."""
    entry = F.struct(col(turn).alias("turn"), col(role).alias("role"), col(text).alias("text"))
    return (
        rows.groupBy(col(id).alias(id))
        .agg(F.array_sort(F.collect_list(entry)).alias("_entries"))
        .select(col(id), F.transform("_entries", lambda e: F.struct(e["role"].alias("role"), e["text"].alias("text"))).alias("messages"))
    )


def digests(read: DataFrame, id: str = "conv_id") -> DataFrame:
    """Counts and SHA-256 digests of what was read back, one row per record; null where no layout fits."""
    lines = F.array_join(F.transform("read_turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    learnt = F.array_join("read_loss", "")
    return read.select(
        col(id),
        F.size("read_turns").cast("bigint").alias("n_turns"),
        F.sha2(lines, 256).alias("turns_sha256"),
        F.length(learnt).cast("bigint").alias("loss_chars"),
        F.sha2(learnt, 256).alias("loss_sha256"),
        F.length("formatted").cast("bigint").alias("formatted_chars"),
    )
