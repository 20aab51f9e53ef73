"""Chat formatting: a small compiler for sandboxed chat templates, and its use on conversations.

A template has text, {{ expression }}, {% for x in messages %}, {% if %}/{% elif %}/{% else %} and
{% generation %}...{% endgeneration %}, which marks what a model is trained on. Expressions have strings, numbers,
fields of the loop variable (role, text), loop.first, loop.last and loop.index, ==, !=, and, or, not, + and the
filters escape, trim, upper and lower; there are no calls and no other names. The source is parsed to a syntax tree,
constants are folded, and the tree becomes Python closures that yield (text, under the loss mask).

Turns stream: rows are dealt by conversation and sorted by turn, and a task holds two turns at a time, whatever the
length of a conversation. `escape` puts a backslash before backslashes and inside `<|`, and writes a line end in a role
as a backslash and n, so control strings come only from the template and texts can be read back exactly.

Defined cases: null roles and texts are empty; null turns come first; turns with equal numbers go by role and text,
repeated rows are turns of their own; a null conv_id is one conversation; an empty table gives no conversation.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterable, Iterator
from functools import cache
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type


START, END = "<|im_start|>", "<|im_end|>"
CHATML = (
    "{% for m in messages %}" + START + "{{ m.role | escape }}\n"
    "{% if m.role == 'assistant' %}{% generation %}{{ m.text | escape }}{% endgeneration %}"
    "{% else %}{{ m.text | escape }}{% endif %}" + END + "\n{% endfor %}"
)
Env = dict[str, object]
Pieces = Iterator[tuple[str | None, bool]]


def escape(text: str) -> str:
    return text.replace("\\", "\\\\").replace("<|", "<\\|")


def escape_role(text: str) -> str:
    return escape(text).replace("\n", "\\n")


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], text, flags=re.S) if "\\" in text else text


FILTERS: dict[str, Callable[[str], str]] = {"escape": escape, "trim": str.strip, "upper": str.upper, "lower": str.lower}
LOOP = ("first", "last", "index")
FIELDS = ("role", "text")
PARTS = re.compile(r"\{\{(.*?)\}\}|\{%(.*?)%\}", re.S)
TOKENS = re.compile(r"""\s*(?:("(?:[^"\\]|\\.)*"|'(?:[^'\\]|\\.)*')|(\d+)|([A-Za-z_]\w*)|(==|!=|[().+|]))""")


class TemplateError(ValueError):
    pass


class Expression:
    """Recursive descent over one expression; nodes are tuples whose first entry names them."""

    def __init__(self, source: str, names: tuple[str, ...]):
        self.names, self.tokens, at = names, [], 0
        while source[at:].strip():
            m = TOKENS.match(source, at)
            if not m:
                raise TemplateError(f"can't read {source[at:]!r}")
            self.tokens.append((m.lastindex, m[m.lastindex]))
            at = m.end()
        self.at = 0

    def peek(self) -> str | None:
        return self.tokens[self.at][1] if self.at < len(self.tokens) else None

    def take(self, *wanted: str) -> str | None:
        if self.at < len(self.tokens) and self.tokens[self.at][0] != 1 and self.peek() in wanted:
            self.at += 1
            return self.tokens[self.at - 1][1]
        return None

    def whole(self) -> tuple:
        node = self.either()
        if self.at != len(self.tokens):
            raise TemplateError(f"unexpected {self.peek()!r}")
        return node

    def either(self) -> tuple:
        node = self.both()
        while self.take("or"):
            node = ("or", node, self.both())
        return node

    def both(self) -> tuple:
        node = self.negated()
        while self.take("and"):
            node = ("and", node, self.negated())
        return node

    def negated(self) -> tuple:
        return ("not", self.negated()) if self.take("not") else self.compared()

    def compared(self) -> tuple:
        node = self.joined()
        if op := self.take("==", "!="):
            node = (op, node, self.joined())
        return node

    def joined(self) -> tuple:
        node = self.filtered()
        while self.take("+"):
            node = ("+", node, self.filtered())
        return node

    def filtered(self) -> tuple:
        node = self.single()
        while self.take("|"):
            name = self.peek()
            self.at += 1
            if name not in FILTERS:
                raise TemplateError(f"no filter {name!r}")
            node = ("filter", name, node)
        return node

    def single(self) -> tuple:
        if self.take("("):
            node = self.either()
            if not self.take(")"):
                raise TemplateError("a bracket isn't closed")
            return node
        if self.at >= len(self.tokens):
            raise TemplateError("an expression is missing")
        kind, word = self.tokens[self.at]
        self.at += 1
        if kind == 1:
            return ("const", re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], word[1:-1], flags=re.S))
        if kind == 2:
            return ("const", int(word))
        if word in ("true", "false"):
            return ("const", word == "true")
        if self.take("."):
            field = self.peek()
            self.at += 1
            if (word == "loop" and field in LOOP) or (word in self.names and field in FIELDS):
                return ("field", word, field)
            raise TemplateError(f"{word}.{field} isn't allowed")
        raise TemplateError(f"the name {word!r} isn't allowed")


def parsed(source: str) -> list[tuple]:
    """The syntax tree: a list of nodes."""
    parts: list[tuple[str, str]] = []
    at = 0
    for m in PARTS.finditer(source):
        parts += [("text", source[at : m.start()])] * (m.start() > at)
        parts.append(("out", m[1]) if m[1] is not None else ("tag", m[2].strip()))
        at = m.end()
    parts += [("text", source[at:])] * (at < len(source))
    place = 0

    def body(ends: tuple[str, ...], names: tuple[str, ...]) -> tuple[list[tuple], str]:
        nonlocal place
        nodes: list[tuple] = []
        while place < len(parts):
            kind, value = parts[place]
            place += 1
            if kind == "text":
                nodes.append(("text", value))
            elif kind == "out":
                nodes.append(("out", Expression(value, names).whole()))
            elif (word := value.split(None, 1)[0] if value else "") in ends:
                return nodes, value
            elif word == "for":
                m = re.fullmatch(r"for\s+([A-Za-z_]\w*)\s+in\s+messages", value)
                if not m or names:
                    raise TemplateError(f"can't loop by {value!r}")
                nodes.append(("for", m[1], body(("endfor",), (m[1],))[0]))
            elif word == "if":
                arms, last = [], value
                while last != "endif":
                    test = ("const", True) if last == "else" else Expression(last.split(None, 1)[1], names).whole()
                    arm, last = body(("elif", "else", "endif"), names)
                    arms.append((test, arm))
                nodes.append(("if", arms))
            elif word == "generation":
                nodes.append(("generation", body(("endgeneration",), names)[0]))
            else:
                raise TemplateError(f"no statement {value!r}")
        if ends:
            raise TemplateError(f"{ends[-1]} is missing")
        return nodes, ""

    return body((), ())[0]


OPERATORS: dict[str, Callable] = {"==": lambda a, b: a == b, "!=": lambda a, b: a != b, "+": lambda a, b: str(a) + str(b), "and": lambda a, b: a and b, "or": lambda a, b: a or b}


def folded_expression(node: tuple) -> tuple:
    if node[0] in OPERATORS:
        a, b = folded_expression(node[1]), folded_expression(node[2])
        return ("const", OPERATORS[node[0]](a[1], b[1])) if a[0] == b[0] == "const" else (node[0], a, b)
    if node[0] == "not":
        a = folded_expression(node[1])
        return ("const", not a[1]) if a[0] == "const" else ("not", a)
    if node[0] == "filter":
        a = folded_expression(node[2])
        return ("const", FILTERS[node[1]](str(a[1]))) if a[0] == "const" else ("filter", node[1], a)
    return node


def folded(nodes: list[tuple]) -> list[tuple]:
    """The tree with constant expressions computed, settled branches resolved and neighbouring texts joined."""
    out: list[tuple] = []
    for node in nodes:
        new = [node]
        if node[0] == "out":
            value = folded_expression(node[1])
            new = [("text", str(value[1]))] if value[0] == "const" else [("out", value)]
        elif node[0] == "for":
            new = [("for", node[1], folded(node[2]))]
        elif node[0] == "generation":
            new = [("generation", folded(node[1]))]
        elif node[0] == "if":
            arms = []
            for test, arm in node[1]:
                test = folded_expression(test)
                if test[0] != "const" or test[1]:
                    arms.append((test, folded(arm)))
                if test[0] == "const" and test[1]:
                    break
            new = arms[0][1] if arms and arms[0][0][0] == "const" else [("if", arms)] * bool(arms)
        for x in new:
            if x[0] == "text" and out and out[-1][0] == "text":
                out[-1] = ("text", out[-1][1] + x[1])
            else:
                out.append(x)
    return out


def of_role(node: tuple) -> bool:
    """Whether a role goes into the value, through filters or joined to something."""
    return node[0] == "field" and node[2] == "role" or any(of_role(x) for x in node[1:] if isinstance(x, tuple))


def evaluator(node: tuple) -> Callable[[Env], object]:
    if node[0] == "const":
        return lambda env, value=node[1]: value
    if node[0] == "field":
        return lambda env, name=node[1], field=node[2]: env[name][field]
    if node[0] == "not":
        inner = evaluator(node[1])
        return lambda env: not inner(env)
    if node[0] == "filter":
        inner, apply = evaluator(node[2]), FILTERS[node[1]]
        if node[1] == "escape" and of_role(node[2]):
            apply = escape_role
        return lambda env: apply(str(inner(env)))
    if node[0] in ("and", "or"):
        a, b, stop = evaluator(node[1]), evaluator(node[2]), node[0] == "or"
        return lambda env: x if bool(x := a(env)) == stop else b(env)
    a, b, op = evaluator(node[1]), evaluator(node[2]), OPERATORS[node[0]]
    return lambda env: op(a(env), b(env))


def with_ends(messages: Iterable[dict]) -> Iterator[tuple[dict, dict]]:
    """Each message with its loop values; one message is read ahead."""
    held, n = None, 0
    for message in messages:
        if held is not None:
            yield held, {"first": n == 1, "last": False, "index": n}
        held, n = message, n + 1
    if held is not None:
        yield held, {"first": n == 1, "last": True, "index": n}


def runner(nodes: list[tuple], masked: bool = False) -> Callable[[Env], Pieces]:
    """A closure that yields the pieces of nodes."""
    steps: list[Callable[[Env], Pieces]] = []
    for node in nodes:
        if node[0] == "text":
            steps.append(lambda env, piece=((node[1], masked),): iter(piece))
        elif node[0] == "out":
            steps.append(lambda env, value=evaluator(node[1]): iter(((str(value(env)), masked),)))
        elif node[0] == "generation":
            steps.append(runner(node[1], True))
        elif node[0] == "if":
            arms = [(evaluator(test), runner(arm, masked)) for test, arm in node[1]]

            def branch(env: Env, arms=arms) -> Pieces:
                for test, arm in arms:
                    if test(env):
                        return arm(env)
                return iter(())

            steps.append(branch)
        else:
            inner, name = runner(node[2], masked), node[1]

            def loop(env: Env, inner=inner, name=name) -> Pieces:
                for message, place in with_ends(env["messages"]):
                    yield from inner({name: message, "loop": place})
                    yield None, False  # a turn is whole

            steps.append(loop)

    def run(env: Env) -> Pieces:
        for step in steps:
            yield from step(env)

    return run


@cache
def compiled(source: str) -> Callable[[Iterable[dict]], Pieces]:
    run = runner(folded(parsed(source)))
    return lambda messages: run({"messages": messages})


def by_conversation(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[object, Iterator[tuple]]]:
    """(conv_id, its rows) of batches in which the rows of a conversation follow each other."""
    rows = (row for b in batches for row in zip(*(b.column(i).to_pylist() for i in range(width))))
    return groupby(rows, key=lambda r: r[0])


def kinds_of(df: DataFrame) -> tuple[str, pa.DataType]:
    kind = df.schema["conv_id"].dataType
    return kind.simpleString(), to_arrow_type(kind)


def formatted(conversations: DataFrame, template: str = CHATML) -> DataFrame:
    """(conv_id, part, piece, spans): the conversation's text is its pieces in the order of part.

    spans lists [start, end) of the loss mask in code points of the whole conversation; a piece holds a turn.
    """
    compiled(template)  # errors show on the driver
    kind, arrow = kinds_of(conversations)
    rows = conversations.select("conv_id", "turn", "role", "text")
    dealt = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", "role", "text")
    schema = f"conv_id {kind}, part int, piece string, spans array<struct<start:long,end:long>>"
    layout = pa.schema([("conv_id", arrow), ("part", pa.int32()), ("piece", pa.string()),
                        ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))])

    def render(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[dict] = []
        for conv, turns in by_conversation(batches, 3):
            at, part, piece, spans = 0, 0, [], []
            for text, masked in compiled(template)({"role": r or "", "text": t or ""} for _, r, t in turns):
                if text:
                    piece.append(text)
                    if masked:
                        spans.append({"start": at, "end": at + len(text)})
                    at += len(text)
                elif text is None and piece:
                    out.append({"conv_id": conv, "part": part, "piece": "".join(piece), "spans": spans})
                    part, piece, spans = part + 1, [], []
                    if len(out) >= 256:
                        yield pa.RecordBatch.from_pylist(out, layout)
                        out = []
            if piece:
                out.append({"conv_id": conv, "part": part, "piece": "".join(piece), "spans": spans})
        if out:
            yield pa.RecordBatch.from_pylist(out, layout)

    return dealt.mapInArrow(render, schema)


TURN = re.compile(re.escape(START) + r"([^\n]*)\n(.*?)" + re.escape(END) + r"\n", re.S)


def read_back(pieces: DataFrame, in_order: bool = False) -> DataFrame:
    """Of formatted()'s rows: conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, read from the text and spans.

    Rows may come in any order, as from a table that they were written to. With in_order they aren't shuffled again, which
    suits what formatted() returned itself; a part in the wrong place is an error then.
    """
    kind, arrow = kinds_of(pieces)
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]

    def as_batch(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows))
        ids = pa.array(columns[0], arrow)
        return pa.RecordBatch.from_arrays([ids, *(pa.array(c) for c in columns[1:])], names)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = []
        for conv, parts in by_conversation(batches, 4):
            turns, loss, n, chars, at, rest = hashlib.sha256(), hashlib.sha256(), 0, 0, 0, ""
            for place, (_, part, piece, spans) in enumerate(parts):
                if part != place:
                    raise ValueError(f"part {part} of a conversation in place {place}")
                for s in spans:
                    masked = unescape(piece[s["start"] - at : s["end"] - at])
                    chars += len(masked)
                    loss.update(masked.encode())
                at += len(piece)
                rest += piece
                done = 0
                for m in TURN.finditer(rest):
                    if m.start() != done:
                        raise ValueError("text between turns")
                    turns.update(f"{unescape(m[1])}\n{unescape(m[2])}\n".encode())
                    n, done = n + 1, m.end()
                rest = rest[done:]
            if rest:
                raise ValueError("a turn isn't whole")
            rows.append((conv, n, turns.hexdigest(), chars, loss.hexdigest(), at))
            if len(rows) >= 1024:
                yield as_batch(rows)
                rows = []
        if rows:
            yield as_batch(rows)

    pieces = pieces.select("conv_id", "part", "piece", "spans")
    return (pieces if in_order else pieces.repartition("conv_id").sortWithinPartitions("conv_id", "part")).mapInArrow(read, f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
