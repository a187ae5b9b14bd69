"""Chat formatting with a sandboxed template language.

A template is parsed to a syntax tree, constant parts are folded, and the tree is turned to nested Python closures that
render a conversation as a stream of pieces; no text is ever evaluated as code. The language:

    {{ expr }}                       output
    {% if expr %} {% elif expr %} {% else %} {% endif %}
    {% for turn in turns %} {% endfor %}    the turns in order; one loop a template
    {% generation %} {% endgeneration %}    the text inside is under the loss mask
    expr: 'string' | name | expr + expr | expr == expr | expr != expr | not expr | expr and expr | expr or expr
          | (expr) | expr | filter

Names, with or without turn. before them: role, text, index (the turn's number), first and last (of the conversation).
Filters: escape, upper, lower, title, trim. `not` binds weaker than comparisons and stronger than `and`. A template without
a loop is the inside of one.

escape puts a backslash before every backslash and before every control string of the template, so no text can make one.
The reader follows from the template: for each role that it tells apart, and any other, the tree is folded with that role
known and becomes a pattern whose groups are the escaped names. Reading back is exact.

Turns meet by conversation, sorted by turn, and stream through the template. The formatted text is cut to parts after
turns, so the memory of a task does not grow with a conversation, only with its longest turn.

Defined cases: a null role or text is empty; turns of one number are ordered by role, then text; a null turn comes
first; repeated rows are turns of their own; a very long text is one turn like any other; an empty table gives no rows;
other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keyloom.llm.common import read_table

TEMPLATE = (
    "{% for turn in turns %}{{ '### ' }}{% if role == 'assistant' %}{{ 'Assistant' }}{% elif role == 'user' %}{{ 'User' }}"
    "{% else %}{{ role | escape }}{% endif %}{{ ': ' }}"
    "{% if role == 'assistant' %}{% generation %}{{ text | escape }}{% endgeneration %}{% else %}{{ text | escape }}{% endif %}"
    "{{ '</turn>\n' }}{% endfor %}"
)
#: What a text must not contain unescaped.
CONTROLS = ("### ", ": ", "</turn>")
ROLES = {"Assistant": "assistant", "User": "user"}

TOKEN = re.compile(r"\s*(?:'((?:[^'\\]|\\.)*)'|([A-Za-z_]+(?:\.[A-Za-z_]+)?)|(==|!=|[+()|]))")
PART = re.compile(r"\{\{(.*?)\}\}|\{%(.*?)%\}", re.S)
FILTERS: dict[str, Callable] = {"upper": str.upper, "lower": str.lower, "title": str.title, "trim": str.strip}
NAMES = ("role", "text", "index", "first", "last")
LOOP = re.compile(r"for\s+turn\s+in\s+turns")
#: Code points of formatted text from which a part ends after its turn.
PART_SIZE = 1 << 20


class TemplateError(ValueError):
    """The template isn't in the language."""


@dataclass
class Node:
    kind: str
    value: object = None
    parts: list = field(default_factory=list)


def parse(source: str) -> Node:
    """The syntax tree of a template."""
    tags: list[tuple[str, str]] = []
    at = 0
    for m in PART.finditer(source):
        if m.start() > at:
            tags.append(("literal", source[at : m.start()]))
        tags.append(("output", m[1]) if m[1] is not None else ("tag", m[2].strip()))
        at = m.end()
    if at < len(source):
        tags.append(("literal", source[at:]))
    position = 0

    def body(ends: tuple[str, ...]) -> tuple[Node, str]:
        nonlocal position
        out = Node("sequence")
        while position < len(tags):
            kind, text = tags[position]
            position += 1
            word = text.split(None, 1)[0] if kind == "tag" and text else ""
            if kind == "literal":
                out.parts.append(Node("constant", text))
            elif kind == "output":
                out.parts.append(expression(text))
            elif word in ends:
                return out, text
            elif word == "if":
                branches, test = [], text[2:]
                while True:
                    inner, end = body(("elif", "else", "endif"))
                    branches.append((expression(test) if test is not None else Node("constant", True), inner))
                    if end == "endif":
                        break
                    if test is None:
                        raise TemplateError("nothing but endif follows else")
                    test = end[4:] if end.startswith("elif") else None
                out.parts.append(Node("choice", parts=branches))
            elif word == "for":
                if not LOOP.fullmatch(text):
                    raise TemplateError(f"the only loop is over turns, not {text!r}")
                out.parts.append(Node("loop", parts=[body(("endfor",))[0]]))
            elif word == "generation":
                out.parts.append(Node("generation", parts=[body(("endgeneration",))[0]]))
            else:
                raise TemplateError(f"unknown tag {text!r}")
        if ends:
            raise TemplateError(f"{ends[-1]} is missing")
        return out, ""

    tree = fold(body(())[0])
    if loops(tree) > 1:
        raise TemplateError("a template has one loop, as its turns are a stream")
    return tree


def loops(node: Node) -> int:
    inner = [p for part in node.parts for p in (part if isinstance(part, tuple) else (part,))]
    return (node.kind == "loop") + sum(map(loops, inner))


def expression(source: str) -> Node:
    tokens: list[tuple[str, str]] = []
    at = 0
    source = source.rstrip()
    while at < len(source):
        m = TOKEN.match(source, at)
        if not m:
            raise TemplateError(f"can't read {source[at:]!r}")
        at = m.end()
        tokens.append(("string", re.sub(r"\\(.)", r"\1", m[1], flags=re.S)) if m[1] is not None else ("word", m[2]) if m[2] else ("sign", m[3]))
    tokens.append(("end", ""))
    k = 0

    def take(*what: tuple[str, str]) -> str | None:
        nonlocal k
        if tokens[k] in what:
            k += 1
            return tokens[k - 1][1]
        return None

    def binary(below: Callable, *signs: tuple[str, str]) -> Callable:
        def level() -> Node:
            left = below()
            while sign := take(*signs):
                left = Node("binary", sign, [left, below()])
            return left

        return level

    def atom() -> Node:
        nonlocal k
        kind, text = tokens[k]
        k += 1
        if kind == "string":
            out = Node("constant", text)
        elif (kind, text) == ("sign", "("):
            out = either()
            if not take(("sign", ")")):
                raise TemplateError("a bracket isn't closed")
        elif kind == "word" and text.removeprefix("turn.") in NAMES:
            out = Node("name", text.removeprefix("turn."))
        else:
            raise TemplateError(f"unexpected {text!r}")
        while take(("sign", "|")):
            kind, text = tokens[k]
            k += 1
            if text != "escape" and text not in FILTERS:
                raise TemplateError(f"unknown filter {text!r}")
            out = Node("filter", text, [out])
        return out

    added = binary(atom, ("sign", "+"))
    compared = binary(added, ("sign", "=="), ("sign", "!="))

    def negated() -> Node:
        return Node("not", parts=[negated()]) if take(("word", "not")) else compared()

    both = binary(negated, ("word", "and"))
    either = binary(both, ("word", "or"))
    out = either()
    if tokens[k][0] != "end":
        raise TemplateError(f"unexpected {tokens[k][1]!r}")
    return out


def fold(node: Node, known: dict[str, object] | None = None) -> Node:
    """Constant parts and known names computed, neighbouring constants joined, dead branches dropped. The value None is that
    of a name which equals no constant."""
    known = known or {}
    if node.kind == "name" and known.get(node.value) is not None:
        return Node("constant", known[node.value])
    if node.kind == "choice":
        branches = []
        for test, inner in node.parts:
            test, inner = fold(test, known), fold(inner, known)
            if test.kind == "constant" and not test.value:
                continue
            branches.append((test, inner))
            if test.kind == "constant":
                break
        if not branches:
            return Node("sequence")
        return branches[0][1] if branches[0][0].kind == "constant" else Node("choice", parts=branches)
    parts = [fold(p, known) for p in node.parts]
    if node.kind == "sequence":
        out: list[Node] = []
        for p in parts:
            for q in p.parts if p.kind == "sequence" else [p]:
                if q.kind == "constant" and out and out[-1].kind == "constant":
                    out[-1] = Node("constant", str(out[-1].value) + str(q.value))
                else:
                    out.append(q)
        return Node("sequence", parts=out)
    folded = Node(node.kind, node.value, parts)
    if node.kind == "binary" and node.value in ("==", "!=") and {p.kind for p in parts} == {"name", "constant"}:
        name = next(p.value for p in parts if p.kind == "name")
        if name in known:
            return Node("constant", node.value == "!=")
    constant = parts and all(p.kind == "constant" for p in parts)
    if constant and (node.kind in ("binary", "not") or node.kind == "filter" and node.value != "escape"):
        return Node("constant", value_of(folded, None)({}))
    return folded


def value_of(node: Node, escape: Callable[[str], str] | None) -> Callable[[dict], object]:
    """A closure that computes an expression."""
    if node.kind == "constant":
        value = node.value
        return lambda turn: value
    if node.kind == "name":
        name = node.value
        return lambda turn: turn[name]
    inner = [value_of(p, escape) for p in node.parts]
    if node.kind == "not":
        return lambda turn: not inner[0](turn)
    if node.kind == "filter":
        apply = escape if node.value == "escape" else FILTERS[node.value]
        return lambda turn: apply(str(inner[0](turn)))
    a, b = inner
    return {
        "+": lambda turn: str(a(turn)) + str(b(turn)),
        "==": lambda turn: a(turn) == b(turn),
        "!=": lambda turn: a(turn) != b(turn),
        "and": lambda turn: a(turn) and b(turn),
        "or": lambda turn: a(turn) or b(turn),
    }[node.value]


#: What a closure yields after each turn.
TURN_END = (None, False)


def renderer(node: Node, escape: Callable[[str], str]) -> Callable[[dict | None, Iterable[dict], bool], Iterator[tuple]]:
    """A closure of the present turn, the turns to come and whether it is under the loss mask; it yields pieces with that."""
    if node.kind == "sequence":
        inner = [renderer(p, escape) for p in node.parts]

        def sequence(turn: dict | None, turns: Iterable[dict], masked: bool) -> Iterator[tuple]:
            for part in inner:
                yield from part(turn, turns, masked)

        return sequence
    if node.kind == "choice":
        branches = [(value_of(t, escape), renderer(x, escape)) for t, x in node.parts]

        def choice(turn: dict | None, turns: Iterable[dict], masked: bool) -> Iterator[tuple]:
            for test, part in branches:
                if test(turn):
                    yield from part(turn, turns, masked)
                    return

        return choice
    if node.kind == "generation":
        part = renderer(node.parts[0], escape)
        return lambda turn, turns, masked: part(turn, turns, True)
    if node.kind == "loop":
        part = renderer(node.parts[0], escape)

        def loop(turn: dict | None, turns: Iterable[dict], masked: bool) -> Iterator[tuple]:
            for now in turns:
                yield from part(now, (), masked)
                yield TURN_END

        return loop
    value = value_of(node, escape)

    def output(turn: dict | None, turns: Iterable[dict], masked: bool) -> Iterator[tuple]:
        yield str(value(turn)), masked

    return output


def reader(node: Node, fields: dict[str, str], controls: str) -> str:
    """The pattern of what a tree renders; escaped texts hold none of the controls. fields gets the name of each group."""
    if node.kind == "constant":
        return re.escape(str(node.value))
    if node.kind == "sequence":
        return "".join(reader(p, fields, controls) for p in node.parts)
    if node.kind == "generation":
        return reader(node.parts[0], fields, controls)
    if node.kind == "choice":
        branches = [reader(x, fields, controls) for _, x in node.parts]
        closed = node.parts[-1][0].kind == "constant"
        return "(?:" + "|".join(branches if closed else [*branches, ""]) + ")"
    if node.kind == "filter" and node.value == "escape" and node.parts[0].kind == "name" and node.parts[0].value in ("role", "text"):
        group = f"g{len(fields)}"
        fields[group] = node.parts[0].value
        return rf"(?P<{group}>(?:\\.|(?!{controls})[^\\])*?)"
    raise TemplateError("only escaped roles and texts and constants can be read back")


def neighbours(turns: Iterable[dict]) -> Iterator[dict]:
    """The turns, each with first and last."""
    before = None
    for turn in turns:
        if before is not None:
            yield before | {"last": False}
        before = turn | {"first": before is None}
    if before is not None:
        yield before | {"last": True}


class ChatFormat:
    """A compiled template with its control strings."""

    def __init__(self, template: str = TEMPLATE, controls: tuple[str, ...] = CONTROLS, roles: dict[str, str] | None = None):
        self.tree = parse(template)
        if not loops(self.tree):
            self.tree = Node("sequence", parts=[Node("loop", parts=[self.tree])])
        self.roles = ROLES if roles is None else roles
        self._controls = "|".join(map(re.escape, sorted(controls, key=len, reverse=True)))
        self._special = re.compile(rf"\\|{self._controls}")
        self._names = set(self.roles)
        self._render = renderer(self.tree, self.escape)
        self._reader: tuple | None = None

    def escape(self, text: str) -> str:
        """A backslash before each backslash and each control string; and before a text that is a shown role name."""
        out = self._special.sub(lambda m: "\\" + m[0], text)
        # ":" at the end of a role would join the control string that follows it
        out = re.sub(r"(?=[:#<]\Z)", r"\\", out)
        return "\\" + out if text in self._names else out

    @staticmethod
    def unescape(text: str) -> str:
        return re.sub(r"\\(.)", r"\1", text, flags=re.S)

    def parts(self, turns: Iterable[dict], size: int = PART_SIZE) -> Iterator[tuple[str, list[tuple[int, int]]]]:
        """Formatted text of a conversation in parts that end after turns, each with its spans under the loss mask in code
        points. turns: dicts of role, text and index, read as they are needed."""
        out: list[str] = []
        spans: list[tuple[int, int]] = []
        at = 0
        for piece, masked in self._render(None, neighbours(turns), False):
            if piece is None:
                if at >= size:
                    yield "".join(out), spans
                    out, spans, at = [], [], 0
                continue
            if masked and piece:
                if spans and spans[-1][1] == at:
                    spans[-1] = (spans[-1][0], at + len(piece))
                else:
                    spans.append((at, at + len(piece)))
            out.append(piece)
            at += len(piece)
        if out:
            yield "".join(out), spans

    def render(self, turns: list[dict]) -> tuple[str, list[tuple[int, int]]]:
        """A whole conversation as one part."""
        return next(self.parts(turns, 1 << 62), ("", []))

    def _patterns(self) -> tuple:
        """What stands before the loop, a turn by role, and what stands after it."""
        if self._reader is None:
            at = next((i for i, p in enumerate(self.tree.parts) if p.kind == "loop"), None)
            if at is None:
                raise TemplateError("a loop inside other tags can't be read back")
            edges = [re.compile(reader(Node("sequence", parts=x), {}, self._controls), re.S) for x in (self.tree.parts[:at], self.tree.parts[at + 1 :])]
            body, turns = self.tree.parts[at].parts[0], []
            for role in [*sorted(told_apart(body)), None]:
                fields: dict[str, str] = {}
                turns.append((role, re.compile(reader(fold(body, {"role": role}), fields, self._controls), re.S), fields))
            self._reader = edges[0], turns, edges[1]
        return self._reader

    def read(self, formatted: str) -> list[tuple[str, str]]:
        """(role, text) of each turn of formatted text, or of a part of it."""
        before, patterns, after = self._patterns()
        turns, at = [], 0
        if m := before.match(formatted):
            at = m.end()
        while at < len(formatted):
            for role, pattern, fields in patterns:
                if m := pattern.match(formatted, at):
                    got = {name: self.unescape(m[g]) for g, name in fields.items() if m[g] is not None}
                    turns.append((got.get("role", role or ""), got.get("text", "")))
                    break
            if m is None or m.end() == at:
                if after.fullmatch(formatted, at):
                    break
                raise ValueError(f"no turn at {at}")
            at = m.end()
        return turns


def told_apart(node: Node) -> set[str]:
    """The roles that a template compares with."""
    inner = [p for part in node.parts for p in (part if isinstance(part, tuple) else (part,))]
    own = {p.value for p in inner if p.kind == "constant" and isinstance(p.value, str)} if node.kind == "binary" and node.value in ("==", "!=") else set()
    return own.union(*map(told_apart, inner)) if inner else own


def format_conversations(conversations: DataFrame, chat: ChatFormat) -> DataFrame:
    """conv_id, part, formatted, spans: each conversation in parts, in order; spans (begin, end) are under the loss mask."""
    rows = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    ordered = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turns = (row for batch in batches for row in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True))
        out: list[tuple] = []
        size = 0

        def flush() -> pa.RecordBatch:
            columns = list(zip(*out, strict=True)) or [()] * 4
            batch = pa.RecordBatch.from_arrays(
                [
                    pa.array(columns[0], pa.int64()),
                    pa.array(columns[1], pa.int32()),
                    pa.array(columns[2], pa.string()),
                    pa.array([[{"begin": a, "end": b} for a, b in x] for x in columns[3]], SPANS),
                ],
                names=["conv_id", "part", "formatted", "spans"],
            )
            out.clear()
            return batch

        for key, own in groupby(turns, key=lambda row: row[0]):
            said = ({"role": r, "text": t, "index": n} for _, n, r, t in own)
            for k, (text, spans) in enumerate(chat.parts(said)):
                out.append((key, k, text, spans))
                size += len(text)
                if size >= PART_SIZE:
                    yield flush()
                    size = 0
        yield flush()

    return ordered.mapInArrow(run, "conv_id long, part int, formatted string, spans array<struct<begin: long, end: long>>")


SPANS = pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))


def read_back(formatted: DataFrame, chat: ChatFormat, in_order: bool = False) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, all read from the formatted parts.

    in_order: the parts of a conversation stand together and in order, as format_conversations leaves them."""
    rows = formatted.select("conv_id", "part", "formatted", "spans")
    ordered = rows if in_order else rows.repartition("conv_id").sortWithinPartitions("conv_id", "part")
    ordered = ordered.select("conv_id", "formatted", "spans")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: tuple | None = None
        turns = loss = None
        sums = [0, 0, 0]
        out: list[tuple] = []

        def close() -> None:
            if now is not None:
                out.append((now[0], sums[0], turns.hexdigest(), sums[1], loss.hexdigest(), sums[2]))

        def flush() -> pa.RecordBatch:
            columns = list(zip(*out, strict=True)) or [()] * 6
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            batch = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=NAMES_OUT)
            out.clear()
            return batch

        for batch in batches:
            for key, text, spans in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if now is None or now[0] != key:
                    close()
                    now, turns, loss, sums = (key,), hashlib.sha256(), hashlib.sha256(), [0, 0, 0]
                for role, said in chat.read(text):
                    turns.update(f"{role}\n{said}\n".encode())
                    sums[0] += 1
                for span in spans:
                    said = chat.unescape(text[span["begin"] : span["end"]])
                    loss.update(said.encode())
                    sums[1] += len(said)
                sums[2] += len(text)
            if len(out) > 5000:
                yield flush()
        close()
        yield flush()

    return ordered.mapInArrow(run, ", ".join(f"{n} {'string' if 'sha' in n else 'long'}" for n in NAMES_OUT))


NAMES_OUT = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]

PROBE = "\\### Assistant: </turn> ok"


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    chat = ChatFormat()
    table = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit(PROBE).alias("text"),
    )
    return read_back(format_conversations(table.unionByName(probe), chat), chat, in_order=True)


_ESCAPED = "replace(replace(replace(replace({0}, '\\', '\\\\'), '### ', '\\### '), ': ', '\\: '), '</turn>', '\\</turn>')"
_ENDED = "(length({0}) + (right({0}, 1) IN (':', '#', '<'))::INT + ({1} IN ('Assistant', 'User'))::INT)"
OP4_SQL = f"""
WITH turns AS (
  SELECT conv_id::BIGINT AS conv_id, turn::BIGINT AS turn, coalesce(role, '') AS role, coalesce(text, '') AS text
  FROM conversations
  UNION ALL SELECT -7, 0, 'user', '{PROBE}'
  UNION ALL SELECT -7, 1, 'assistant', '{PROBE}'
), shown AS (
  SELECT *, {_ESCAPED.format("text")} AS e, {_ESCAPED.format("role")} AS r FROM turns
)
SELECT conv_id, count(*)::BIGINT AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(4 + 2 + 8 + {_ENDED.format("e", "text")}
           + CASE role WHEN 'assistant' THEN 9 WHEN 'user' THEN 4 ELSE {_ENDED.format("r", "role")} END)::BIGINT AS formatted_chars
FROM shown GROUP BY conv_id
"""
