"""Chat formatting: a small template language, compiled to closures.

A template is parsed into a syntax tree, constant parts are folded, and each node becomes
a Python closure that yields text. Text inside ``{% generation %}`` is marked, which gives
the loss mask. Templates see the names that they are given and nothing else: there are no
calls, no attributes but keys of mappings, and no imports.

    {% for m in messages %}{{ m.role }}: {{ m.content | escape }}{% endfor %}

Statements: for, if / elif / else, set, generation. Expressions: literals, names, ``.key``
and ``[key]``, filters, ``~ + - * // %``, comparisons, in, and, or, not, ``a if b else c``.
In a loop, ``loop`` has index, index0, first and last.
"""

from __future__ import annotations

import operator
import re
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The marks of a turn. No text in the output has ``<|`` but these.
START, ROLE_END, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>"
CHATML = (
    "{% for m in messages %}" + START + "{{ m.role | escape }}" + ROLE_END
    + "{% if m.role == 'assistant' %}{% generation %}{{ m.content | escape }}{% endgeneration %}"
    + "{% else %}{{ m.content | escape }}{% endif %}" + END + "\n{% endfor %}"
)
#: Characters after which the output of a long conversation goes on in another row.
PIECE = 1 << 20


def escape(text: str) -> str:
    """A text without ``<|``: a backslash goes before the bar, and one more where there were some."""
    return re.sub(r"<(\\*)\|", r"<\\\1|", text)


def unescape(text: str) -> str:
    return re.sub(r"<\\(\\*)\|", r"<\1|", text)


class TemplateError(ValueError):
    """A template that cannot be read, or that asks for what it may not see."""


# The syntax tree.


@dataclass(frozen=True)
class Const:
    value: object


@dataclass(frozen=True)
class Name:
    name: str


@dataclass(frozen=True)
class Item:
    of: object
    key: object


@dataclass(frozen=True)
class Apply:
    name: str
    args: tuple


@dataclass(frozen=True)
class Choice:
    test: object
    then: object
    other: object


@dataclass(frozen=True)
class Output:
    value: object


@dataclass(frozen=True)
class For:
    name: str
    over: object
    body: tuple


@dataclass(frozen=True)
class If:
    test: object
    then: tuple
    other: tuple


@dataclass(frozen=True)
class Set:
    name: str
    value: object


@dataclass(frozen=True)
class Generation:
    body: tuple


def _text(value: object) -> str:
    return "" if value is None else value if isinstance(value, str) else str(value)


#: Longest text, and number of bits, that a multiplication may give.
MAX_PRODUCT = 1_000_000


def _times(a: object, b: object) -> object:
    """A product of numbers, or a text or list repeated, within ``MAX_PRODUCT``."""
    if isinstance(a, int) and isinstance(b, int):
        size = a.bit_length() + b.bit_length()
    else:
        size = max((len(x) * y for x, y in ((a, b), (b, a)) if isinstance(x, (str, list, tuple))), default=0)
    if size > MAX_PRODUCT:
        raise TemplateError("a product is too large")
    return a * b


OPERATORS: dict[str, Callable] = {
    "or": lambda a, b: a or b,
    "and": lambda a, b: a and b,
    "not": operator.not_,
    "neg": operator.neg,
    "==": operator.eq,
    "!=": operator.ne,
    "<": operator.lt,
    ">": operator.gt,
    "<=": operator.le,
    ">=": operator.ge,
    "in": lambda a, b: a in b,
    "~": lambda a, b: _text(a) + _text(b),
    "+": operator.add,
    "-": operator.sub,
    "*": _times,
    "//": operator.floordiv,
    "%": operator.mod,
}
FILTERS: dict[str, Callable] = {
    "escape": lambda v: escape(_text(v)),
    "trim": lambda v: _text(v).strip(),
    "upper": lambda v: _text(v).upper(),
    "lower": lambda v: _text(v).lower(),
    "length": len,
    "string": _text,
    "default": lambda v, other="": other if v is None else v,
    "replace": lambda v, old, new: _text(v).replace(old, new),
}
_LEVELS = (("or",), ("and",), ("==", "!=", "<=", ">=", "<", ">", "in"), ("~",), ("+", "-"), ("*", "//", "%"))
_PARTS = re.compile(r"(\{\{.*?\}\}|\{%.*?%\}|\{#.*?#\})", re.S)
_TOKEN = re.compile(
    r"\s*(?:(?P<num>\d+)|(?P<str>'(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\")|(?P<name>[A-Za-z_]\w*)"
    r"|(?P<op>==|!=|<=|>=|//|[-+*%~<>|.,()\[\]=]))",
    re.S,
)
_WORDS = {"true": True, "false": False, "none": None, "True": True, "False": False, "None": None}
_ESCAPES = {"n": "\n", "t": "\t", "r": "\r"}


class _Expression:
    """One expression or statement head, read from left to right."""

    def __init__(self, source: str):
        self.tokens: list[tuple[str, str]] = []
        at, source = 0, source.rstrip()
        while at < len(source):
            found = _TOKEN.match(source, at)
            if not found:
                raise TemplateError(f"cannot read {source[at:]!r}")
            self.tokens.append((found.lastgroup, found[found.lastgroup]))
            at = found.end()
        self.at = 0

    def peek(self) -> str | None:
        """The next operator or word; strings and numbers are neither."""
        if self.at < len(self.tokens) and self.tokens[self.at][0] in ("op", "name"):
            return self.tokens[self.at][1]
        return None

    def take(self, *wanted: str) -> bool:
        if self.peek() in wanted and wanted:
            self.at += 1
            return True
        return False

    def need(self, wanted: str) -> None:
        if not self.take(wanted):
            raise TemplateError(f"{wanted!r} is missing")

    def name(self) -> str:
        if self.at >= len(self.tokens) or self.tokens[self.at][0] != "name":
            raise TemplateError("a name is missing")
        self.at += 1
        name = self.tokens[self.at - 1][1]
        if name.startswith("_"):
            raise TemplateError(f"{name!r} is not open to templates")
        return name

    def end(self) -> None:
        if self.at < len(self.tokens):
            raise TemplateError(f"{self.tokens[self.at][1]!r} is not expected")

    def whole(self):
        value = self.choice()
        self.end()
        return value

    def choice(self):
        value = self.binary(0)
        if self.take("if"):
            test = self.binary(0)
            other = self.choice() if self.take("else") else Const(None)
            return Choice(test, value, other)
        return value

    def binary(self, level: int):
        if level == len(_LEVELS):
            return self.unary()
        if level == 2 and self.take("not"):
            return Apply("not", (self.binary(2),))
        left = self.binary(level + 1)
        while True:
            sign = self.peek()
            if sign in _LEVELS[level]:
                self.at += 1
                left = Apply(sign, (left, self.binary(level + 1)))
            elif level == 2 and sign == "not":
                self.at += 1
                self.need("in")
                left = Apply("not", (Apply("in", (left, self.binary(3))),))
            else:
                return left

    def unary(self):
        if self.take("-"):
            return Apply("neg", (self.unary(),))
        value = self.primary()
        while True:
            if self.take("."):
                value = Item(value, Const(self.name()))
            elif self.take("["):
                value = Item(value, self.choice())
                self.need("]")
            elif self.take("|"):
                name, args = self.name(), [value]
                if name not in FILTERS:
                    raise TemplateError(f"there is no filter {name!r}")
                if self.take("("):
                    while not self.take(")"):
                        args.append(self.choice())
                        self.take(",")
                value = Apply("|" + name, tuple(args))
            else:
                return value

    def primary(self):
        if self.at >= len(self.tokens):
            raise TemplateError("an expression ends early")
        kind, token = self.tokens[self.at]
        if kind == "num":
            self.at += 1
            return Const(int(token))
        if kind == "str":
            self.at += 1
            return Const(re.sub(r"\\(.)", lambda m: _ESCAPES.get(m[1], m[1]), token[1:-1], flags=re.S))
        if kind == "name":
            if token in _WORDS:
                self.at += 1
                return Const(_WORDS[token])
            return Name(self.name())
        if self.take("("):
            value = self.choice()
            self.need(")")
            return value
        raise TemplateError(f"{token!r} is not expected")


class _Template:
    """The statements of a template."""

    def __init__(self, source: str):
        # Every other part is a tag; a minus at an end of it takes the white space beyond.
        parts = _PARTS.split(source)
        for i in range(1, len(parts), 2):
            if parts[i][2] == "-":
                parts[i - 1] = parts[i - 1].rstrip()
            if parts[i][-3] == "-":
                parts[i + 1] = parts[i + 1].lstrip()
        self.parts = [p for p in parts if p and not p.startswith("{#")]
        self.at = 0

    @staticmethod
    def inner(tag: str) -> str:
        return tag[2:-2].removeprefix("-").removesuffix("-")

    def body(self, *closers: str) -> tuple[tuple, _Expression | None]:
        """Nodes up to a closing statement, and that statement."""
        nodes: list = []
        while self.at < len(self.parts):
            part = self.parts[self.at]
            self.at += 1
            if part.startswith("{{"):
                nodes.append(Output(_Expression(self.inner(part)).whole()))
            elif part.startswith("{%"):
                head = _Expression(self.inner(part))
                if head.peek() in closers and closers:
                    return tuple(nodes), head
                nodes.append(self.statement(head))
            else:
                nodes.append(Output(Const(part)))
        if closers:
            raise TemplateError(f"{closers[-1]!r} is missing")
        return tuple(nodes), None

    def statement(self, head: _Expression):
        if head.take("for"):
            name = head.name()
            head.need("in")
            over = head.whole()
            body, _ = self.body("endfor")
            return For(name, over, body)
        if head.take("if"):
            return self.condition(head)
        if head.take("set"):
            name = head.name()
            head.need("=")
            return Set(name, head.whole())
        if head.take("generation"):
            head.end()
            body, _ = self.body("endgeneration")
            return Generation(body)
        raise TemplateError(f"there is no statement {head.peek()!r}")

    def condition(self, head: _Expression):
        test = head.whole()
        then, closer = self.body("elif", "else", "endif")
        other: tuple = ()
        if closer.take("elif"):
            other = (self.condition(closer),)
        elif closer.take("else"):
            other, _ = self.body("endif")
        return If(test, then, other)


def parse(source: str) -> tuple:
    return _Template(source).body()[0]


def fold(node):
    """The same tree with constant expressions computed, dead branches gone and texts joined."""
    if isinstance(node, tuple):
        out: list = []
        for part in map(fold, node):
            for one in part if isinstance(part, tuple) else (part,):
                if isinstance(one, Output) and isinstance(one.value, Const):
                    one = Output(Const(_text(one.value.value)))
                    if not one.value.value:
                        continue
                    if out and isinstance(out[-1], Output) and isinstance(out[-1].value, Const):
                        one = Output(Const(out.pop().value.value + one.value.value))
                out.append(one)
        return tuple(out)
    if isinstance(node, Item):
        return Item(fold(node.of), fold(node.key))
    if isinstance(node, Apply):
        args = tuple(map(fold, node.args))
        if all(isinstance(a, Const) for a in args):
            return Const(_function(node.name)(*(a.value for a in args)))
        return Apply(node.name, args)
    if isinstance(node, Choice):
        test = fold(node.test)
        if isinstance(test, Const):
            return fold(node.then if test.value else node.other)
        return Choice(test, fold(node.then), fold(node.other))
    if isinstance(node, Output):
        return Output(fold(node.value))
    if isinstance(node, For):
        return For(node.name, fold(node.over), fold(node.body))
    if isinstance(node, If):
        test = fold(node.test)
        if isinstance(test, Const):
            return fold(node.then if test.value else node.other)
        return If(test, fold(node.then), fold(node.other))
    if isinstance(node, Set):
        return Set(node.name, fold(node.value))
    if isinstance(node, Generation):
        return Generation(fold(node.body))
    return node


def _function(name: str) -> Callable:
    """An operator or filter whose errors are the template's."""
    function = FILTERS[name[1:]] if name.startswith("|") else OPERATORS[name]

    def guarded(*args):
        try:
            return function(*args)
        except (TypeError, ArithmeticError, AttributeError) as error:
            raise TemplateError(f"{name} fails: {error}") from error

    return guarded


def _get(value: object, key: object) -> object:
    """A key of a mapping or a place in a list; none if there is nothing."""
    if isinstance(value, dict):
        return value.get(key)
    if isinstance(value, (list, tuple)) and isinstance(key, int):
        return value[key] if -len(value) <= key < len(value) else None
    return None


def _value(node) -> Callable[[dict], object]:
    """A closure that computes an expression."""
    if isinstance(node, Const):
        return lambda names, value=node.value: value
    if isinstance(node, Name):
        return lambda names, name=node.name: names.get(name)
    if isinstance(node, Item):
        of, key = _value(node.of), _value(node.key)
        return lambda names: _get(of(names), key(names))
    if isinstance(node, Choice):
        test, then, other = map(_value, (node.test, node.then, node.other))
        return lambda names: then(names) if test(names) else other(names)
    args = tuple(map(_value, node.args))
    if node.name in ("and", "or"):
        left, right = args
        if node.name == "and":
            return lambda names: left(names) and right(names)
        return lambda names: left(names) or right(names)
    function = _function(node.name)
    if len(args) == 1:
        only = args[0]
        return lambda names: function(only(names))
    return lambda names: function(*(a(names) for a in args))


Writer = Callable[[dict, bool], Iterator[tuple[str, bool]]]


def _writer(node) -> Writer:
    """A closure that yields text, each with whether it is generated."""
    if isinstance(node, tuple):
        parts = tuple(map(_writer, node))
        if len(parts) == 1:
            return parts[0]

        def every(names, marked):
            for part in parts:
                yield from part(names, marked)

        return every
    if isinstance(node, Output):
        value = _value(node.value)

        def write(names, marked):
            text = _text(value(names))
            if text:
                yield text, marked

        return write
    if isinstance(node, If):
        test, then, other = _value(node.test), _writer(node.then), _writer(node.other)
        return lambda names, marked: (then if test(names) else other)(names, marked)
    if isinstance(node, Generation):
        body = _writer(node.body)
        return lambda names, marked: body(names, True)
    if isinstance(node, Set):
        value = _value(node.value)

        def store(names, marked):
            names[node.name] = value(names)
            yield from ()

        return store
    over, body = _value(node.over), _writer(node.body)

    def loop(names, marked):
        inner = dict(names)
        rows, place = iter(over(names) or ()), 0
        row = next(rows, None)
        while row is not None:
            after = next(rows, None)
            inner[node.name] = row
            inner["loop"] = {"index": place + 1, "index0": place, "first": not place, "last": after is None}
            yield from body(inner, marked)
            row, place = after, place + 1

    return loop


@dataclass
class Template:
    """A compiled template; ``render`` yields ``(text, generated)`` as messages come in."""

    source: str
    _write: Writer = field(init=False, repr=False)

    def __post_init__(self):
        self._write = _writer(fold(parse(self.source)))

    def render(self, messages: Iterable[dict], **names) -> Iterator[tuple[str, bool]]:
        yield from self._write({**names, "messages": messages}, False)


SCHEMA = "conv_id long, piece long, text string, loss array<struct<start:int,end:int>>, turns long"


def _pieces(rows: Iterator[dict], template: Template) -> Iterator[dict]:
    """The output of rows sorted by conversation; long output is cut after a whole turn."""
    for conv_id, turns in groupby(rows, key=lambda r: r["conv_id"]):
        read = 0

        def messages():
            nonlocal read
            for row in turns:
                read += 1
                yield {"role": row["role"] or "", "content": row["text"] or ""}

        number, parts, spans, size, counted, known = 0, [], [], 0, 0, 0
        for text, marked in template.render(messages()):
            # The loop reads one turn ahead: when a further one has been read, a turn begins here.
            if read > known and size > PIECE:
                yield {"conv_id": conv_id, "piece": number, "text": "".join(parts), "loss": spans, "turns": read - 2 - counted}
                number, parts, spans, size, counted = number + 1, [], [], 0, read - 2
            known = read
            if marked:
                spans.append({"start": size, "end": size + len(text)})
            parts.append(text)
            size += len(text)
        yield {"conv_id": conv_id, "piece": number, "text": "".join(parts), "loss": spans, "turns": read - counted}


def _batches(rows: Iterator[dict], schema: pa.Schema, most: int = 256) -> Iterator[pa.RecordBatch]:
    held: list[dict] = []
    size = 0
    for row in rows:
        held.append(row)
        size += len(row.get("text") or "")
        if len(held) >= most or size > PIECE:
            yield pa.RecordBatch.from_pylist(held, schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_pylist(held, schema)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        yield from batch.to_pylist()


_PIECES = pa.schema(
    [
        ("conv_id", pa.int64()),
        ("piece", pa.int64()),
        ("text", pa.string()),
        ("loss", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))),
        ("turns", pa.int64()),
    ]
)


def format_conversations(turns: DataFrame, template: str = CHATML) -> DataFrame:
    """Formatted conversations: conv_id, piece (long, from 0), text, loss (spans of code points), turns.

    ``turns`` has conv_id, turn, role and text; other columns are not read. Turns go by turn
    (null first), ties by role and text; repeated rows are turns of their own. A null role or
    text is empty; null conv_ids are one conversation. Output of more than ``PIECE``
    characters goes on in another row after a whole turn, so a conversation of any length
    streams through its task. The rows of a conversation come in order, one after another.
    No rows, no result.
    """
    compiled = Template(template)  # an error in the template shows here
    source = compiled.source

    def run(batches):
        yield from _batches(_pieces(_rows(batches), Template(source)), _PIECES)

    return (
        turns.select(
            F.col("conv_id").cast("long"), F.col("turn").cast("long"),
            F.col("role").cast("string"), F.col("text").cast("string"),
        )
        .repartition("conv_id")
        .sortWithinPartitions("conv_id", "turn", "role", "text")
        .select("conv_id", "role", "text")
        .mapInArrow(run, SCHEMA)
    )
