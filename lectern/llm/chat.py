"""Chat formatting with a compiled, sandboxed template language.

A template is parsed to a syntax tree, constants are folded, and what is left becomes Python
closures. The language has text, {{ expression }}, for, if/elif/else, set, {# comments #}, and
generation blocks, whose output is marked as what a model is trained on. A - at the inner side of
a mark ({%- -%}, {{- -}}, {#- -#}) strips the white space of the text beside it. Expressions reach
mapping keys and the listed filters only: no attributes, calls or imports. Loops, nesting, numbers
and the sizes of texts are bounded (a text by what the conversation itself holds), also while
constants are folded, and whatever goes wrong is a TemplateError.

Defined results: a null role or text is empty; turns come in the order of (turn, role, text),
nulls first, repeated rows each as a turn of its own; a null conversation id is a conversation;
an empty table gives no rows; other columns are neither read nor returned.
"""

from __future__ import annotations

import hashlib
import operator
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches

# Strings that models read as control.
CONTROL = ("<|im_start|>", "<|im_end|>", "<|endoftext|>", "<|startoftext|>", "<s>", "</s>", "<unk>", "<pad>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
TEMPLATE = """{% for message in messages %}{{ '<|im_start|>' ~ (message.role | escape_line) ~ '\\n' }}{% if message.role == 'assistant' %}{% generation %}{{ message.text | escape }}{% endgeneration %}{% else %}{{ message.text | escape }}{% endif %}{{ '<|im_end|>' }}
{% endfor %}"""
FORMATTED = "conv_id long, formatted string, spans array<struct<start: long, end: long>>"

_starts = re.compile("(?=" + "|".join(map(re.escape, CONTROL)) + ").", re.S)
_code = re.compile(r"\\(\\|\d+;)")


def escape(text: str) -> str:
    """Break every control string so that unescape() restores it; other text stays as it is."""
    return _starts.sub(lambda m: f"\\{ord(m[0])};", text.replace("\\", "\\\\"))


def escape_line(text: str) -> str:
    return escape(text).replace("\n", "\\10;")


def unescape(text: str) -> str:
    return _code.sub(lambda m: "\\" if m[1] == "\\" else chr(int(m[1][:-1])), text)


class TemplateError(ValueError):
    """A template that doesn't parse, or asks for something outside the language."""


#: Levels of nesting; rounds of all loops of a rendering; the largest number; characters that a
#: template may make of its own, and for each character of the conversation.
MOST_DEPTH, MOST_ROUNDS, MOST_NUMBER, MOST_CHARS, MOST_GROWTH = 50, 10_000_000, 1 << 62, 1 << 24, 8
_FAULTS = (TypeError, ValueError, ArithmeticError, LookupError, AttributeError, RecursionError, MemoryError)

FILTERS: dict[str, Callable] = {"escape": escape, "escape_line": escape_line, "trim": str.strip, "upper": str.upper, "lower": str.lower, "length": len}


# --- syntax tree ---------------------------------------------------------------------------


@dataclass(frozen=True)
class Const:
    value: object


@dataclass(frozen=True)
class Name:
    name: str


@dataclass(frozen=True)
class Item:
    base: object
    key: object


@dataclass(frozen=True)
class Op:
    op: str
    args: tuple


@dataclass(frozen=True)
class Filter:
    name: str
    arg: object


@dataclass(frozen=True)
class Emit:
    expr: object


@dataclass(frozen=True)
class For:
    name: str
    source: object
    body: tuple


@dataclass(frozen=True)
class If:
    test: object
    yes: tuple
    no: tuple


@dataclass(frozen=True)
class Set:
    name: str
    expr: object


@dataclass(frozen=True)
class Generation:
    body: tuple


class _Budget:
    """What is left of a rendering's limits; it stands in the variables under the empty name."""

    def __init__(self, chars: int, rounds: int):
        self.chars, self.out, self.rounds = chars, chars, rounds

    def text(self, size: int) -> None:
        if size > self.chars:
            raise TemplateError("a text grows beyond its limit")

    def emit(self, size: int) -> None:
        self.out -= size
        if self.out < 0:
            raise TemplateError("the output grows beyond its limit")

    def round(self) -> None:
        self.rounds -= 1
        if self.rounds < 0:
            raise TemplateError("too many rounds")


def _chars(x: object) -> int:
    """Characters that a variable holds, containers included."""
    if isinstance(x, str):
        return len(x)
    if isinstance(x, dict):
        return sum(map(_chars, x.values())) + 16 * len(x)
    return sum(map(_chars, x)) + 16 * len(x) if isinstance(x, (list, tuple)) else 16


def _join(a: object, b: object, budget: _Budget) -> str:
    a, b = _text(a), _text(b)
    budget.text(len(a) + len(b))
    return a + b


def _number(run: Callable) -> Callable:
    def made(a: object, b: object, budget: _Budget) -> int:
        if not (isinstance(a, int) and isinstance(b, int)):
            raise TemplateError("numbers only")
        n = run(a, b)
        if abs(n) > MOST_NUMBER:
            raise TemplateError("a number grows beyond its limit")
        return n

    return made


def _plain(run: Callable) -> Callable:
    return lambda a, b, budget: run(a, b)


_add = _number(operator.add)
_BINARY = {x: _plain(f) for x, f in (("==", operator.eq), ("!=", operator.ne), ("<", operator.lt), ("<=", operator.le), (">", operator.gt), (">=", operator.ge), ("in", lambda a, b: a in b))}
_BINARY |= {"-": _number(operator.sub), "%": _number(operator.mod), "~": _join, "+": lambda a, b, budget: _join(a, b, budget) if isinstance(a, str) and isinstance(b, str) else _add(a, b, budget)}
_LEVELS = (("==", "!=", "<", "<=", ">", ">=", "in"), ("+", "-", "~"), ("%",))
_TOKEN = re.compile(r"\s*(?:(\d+)|('(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\")|([A-Za-z][A-Za-z0-9_]*)|(==|!=|<=|>=|[-+~%<>|.\[\]()]))", re.S)
_OPEN = re.compile(r"\{[{%#]")
_INNER = {mark: re.compile(rf"""((?:'(?:[^'\\]|\\.)*+'|"(?:[^"\\]|\\.)*+"|(?!-?{end})[^'"])*+)(-?){end}""", re.S) for mark, end in (("{{", r"\}\}"), ("{%", r"%\}"))}
_ESCAPES = {"n": "\n", "t": "\t", "r": "\r"}


def _text(x: object) -> str:
    return "" if x is None else x if isinstance(x, str) else str(x)


class _Expression:
    """Recursive descent over the tokens of one expression."""

    def __init__(self, source: str):
        self.tokens: list[tuple[str, object]] = []
        at, source = 0, source.rstrip()
        while at < len(source):
            m = _TOKEN.match(source, at)
            if not m:
                raise TemplateError(f"cannot read {source[at:]!r}")
            number, string, name, mark = m.groups()
            if number:
                self.tokens.append(("const", int(number)))
            elif string:
                self.tokens.append(("const", re.sub(r"\\(.)", lambda e: _ESCAPES.get(e[1], e[1]), string[1:-1], flags=re.S)))
            elif name:
                self.tokens.append(("name", name))
            else:
                self.tokens.append(("mark", mark))
            at = m.end()
        self.at = self.depth = 0

    def peek(self, *texts: str) -> str | None:
        if self.at < len(self.tokens):
            kind, value = self.tokens[self.at]
            if kind in ("mark", "name") and value in texts:
                return value
        return None

    def take(self, *texts: str) -> str | None:
        found = self.peek(*texts)
        self.at += found is not None
        return found

    def need(self, text: str) -> None:
        if not self.take(text):
            raise TemplateError(f"expected {text!r}")

    def whole(self) -> object:
        tree = self.choice()
        if self.at < len(self.tokens):
            raise TemplateError(f"unexpected {self.tokens[self.at][1]!r}")
        return tree

    def choice(self) -> object:
        self.deeper()
        value = self.logic("or")
        if self.take("if"):
            test = self.logic("or")
            self.need("else")
            value = Op("?", (test, value, self.choice()))
        self.depth -= 1
        return value

    def deeper(self) -> None:
        self.depth += 1
        if self.depth > MOST_DEPTH:
            raise TemplateError("too deep")

    def logic(self, word: str) -> object:
        inner = (lambda: self.logic("and")) if word == "or" else self.negation
        tree = inner()
        while self.take(word):
            tree = Op(word, (tree, inner()))
        return tree

    def negation(self) -> object:
        if not self.take("not"):
            return self.level(0)
        self.deeper()
        tree = Op("not", (self.negation(),))
        self.depth -= 1
        return tree

    def level(self, k: int) -> object:
        if k == len(_LEVELS):
            return self.filtered()
        tree = self.level(k + 1)
        while mark := self.take(*_LEVELS[k]):
            tree = Op(mark, (tree, self.level(k + 1)))
        return tree

    def filtered(self) -> object:
        tree = self.primary()
        while True:
            if self.take("."):
                tree = Item(tree, Const(self.name()))
            elif self.take("["):
                tree = Item(tree, self.choice())
                self.need("]")
            elif self.take("|"):
                name = self.name()
                if name not in FILTERS:
                    raise TemplateError(f"no filter {name!r}")
                tree = Filter(name, tree)
            else:
                return tree

    def name(self) -> str:
        if self.at < len(self.tokens) and self.tokens[self.at][0] == "name":
            self.at += 1
            return self.tokens[self.at - 1][1]
        raise TemplateError("expected a name")

    def primary(self) -> object:
        if self.take("("):
            tree = self.choice()
            self.need(")")
            return tree
        if self.at < len(self.tokens) and self.tokens[self.at][0] == "const":
            self.at += 1
            return Const(self.tokens[self.at - 1][1])
        name = self.name()
        words = {"true": True, "false": False, "none": None}
        return Const(words[name]) if name in words else Name(name)


def _parts(source: str) -> list[tuple[str, str]]:
    """(mark, inner) pieces of a template, mark "" for text; comments and stripped space are gone."""
    out, at, strip = [], 0, False
    while at < len(source):
        begin = _OPEN.search(source, at)
        text = source[at : begin.start() if begin else len(source)]
        text = text.lstrip() if strip else text
        if begin and source[begin.end() : begin.end() + 1] == "-":
            text = text.rstrip()
        if text:
            out.append(("", text))
        if not begin:
            break
        body = begin.end() + (source[begin.end() : begin.end() + 1] == "-")
        if begin[0] == "{#":
            end = source.find("#}", body)
            if end < 0:
                raise TemplateError("a comment isn't closed")
            strip, at = source[body:end].endswith("-"), end + 2
            continue
        m = _INNER[begin[0]].match(source, body)
        if not m:
            raise TemplateError(f"{begin[0]} isn't closed")
        out.append((begin[0], m[1]))
        strip, at = m[2] == "-", m.end()
    return out


def parse(source: str) -> tuple:
    """The syntax tree of a template."""
    parts = _parts(source)

    def block(at: int, depth: int, *ends: str) -> tuple[tuple, int, str]:
        if depth > MOST_DEPTH:
            raise TemplateError("too deep")
        out: list = []
        while at < len(parts):
            mark, inner = parts[at]
            at += 1
            if mark != "{%":
                out.append(Emit(_Expression(inner).whole() if mark else Const(inner)))
                continue
            head, rest = (inner.split(None, 1) + ["", ""])[:2]
            rest = rest.strip()
            if head in ends:
                if rest and head != "elif":
                    raise TemplateError(f"unexpected {rest!r}")
                return tuple(out), at, f"{head} {rest}".strip()
            if head == "for":
                m = re.fullmatch(r"([A-Za-z]\w*)\s+in\s+(.+)", rest, re.S)
                if not m:
                    raise TemplateError(f"cannot read {inner!r}")
                body, at, _ = block(at, depth + 1, "endfor")
                out.append(For(m[1], _Expression(m[2]).whole(), body))
            elif head == "if":
                node, at = branch(at, depth + 1, rest)
                out.append(node)
            elif head == "set":
                m = re.fullmatch(r"([A-Za-z]\w*)\s*=(.+)", rest, re.S)
                if not m:
                    raise TemplateError(f"cannot read {inner!r}")
                out.append(Set(m[1], _Expression(m[2]).whole()))
            elif head == "generation" and not rest:
                body, at, _ = block(at, depth + 1, "endgeneration")
                out.append(Generation(body))
            else:
                raise TemplateError(f"no statement {inner!r}")
        if ends:
            raise TemplateError(f"missing {ends[-1]}")
        return tuple(out), at, ""

    def branch(at: int, depth: int, test: str) -> tuple[If, int]:
        yes, at, end = block(at, depth, "elif", "else", "endif")
        no: tuple = ()
        if end.startswith("elif"):
            node, at = branch(at, depth + 1, end[4:])
            no = (node,)
        elif end == "else":
            no, at, _ = block(at, depth, "endif")
        return If(_Expression(test).whole(), yes, no), at

    return block(0, 0)[0]


def fold(node: object) -> object:
    """Compute what depends on no variable, drop dead branches, and merge neighbouring text."""
    if isinstance(node, tuple):
        out: list = []
        for x in map(fold, node):
            for y in x if isinstance(x, tuple) else (x,):
                if isinstance(y, Emit) and isinstance(y.expr, Const) and out and isinstance(out[-1], Emit) and isinstance(out[-1].expr, Const):
                    out[-1] = Emit(Const(_text(out[-1].expr.value) + _text(y.expr.value)))
                elif not (isinstance(y, Emit) and isinstance(y.expr, Const) and _text(y.expr.value) == ""):
                    out.append(y)
        return tuple(out)
    if isinstance(node, Op):
        args = tuple(map(fold, node.args))
        if node.op in ("?", "and", "or") and isinstance(args[0], Const):
            if node.op == "?":
                return args[1] if args[0].value else args[2]
            return args[1] if bool(args[0].value) == (node.op == "and") else args[0]
        return _constant(Op(node.op, args)) if all(isinstance(a, Const) for a in args) else Op(node.op, args)
    if isinstance(node, Filter):
        arg = fold(node.arg)
        return _constant(Filter(node.name, arg)) if isinstance(arg, Const) else Filter(node.name, arg)
    if isinstance(node, Item):
        return Item(fold(node.base), fold(node.key))
    if isinstance(node, Emit):
        return Emit(fold(node.expr))
    if isinstance(node, Set):
        return Set(node.name, fold(node.expr))
    if isinstance(node, For):
        return For(node.name, fold(node.source), fold(node.body))
    if isinstance(node, Generation):
        return Generation(fold(node.body))
    if isinstance(node, If):
        test = fold(node.test)
        if isinstance(test, Const):
            return fold(node.yes if test.value else node.no)
        return If(test, fold(node.yes), fold(node.no))
    return node


def _constant(node: object) -> Const:
    return Const(_value(node)({"": _Budget(1 << 20, 0)}))


def _value(node: object) -> Callable[[dict], object]:
    """A closure that computes an expression from the variables."""
    if isinstance(node, Const):
        value = node.value
        return lambda env: value
    if isinstance(node, Name):
        name = node.name

        def look(env: dict) -> object:
            if name not in env:
                raise TemplateError(f"no variable {name!r}")
            return env[name]

        return look
    if isinstance(node, Item):
        base, key = _value(node.base), _value(node.key)

        def item(env: dict) -> object:
            b, k = base(env), key(env)
            if isinstance(b, dict):
                return b.get(k)
            if isinstance(b, (list, tuple, str)) and isinstance(k, int):
                return b[k] if -len(b) <= k < len(b) else None
            raise TemplateError(f"no item {k!r}")

        return item
    if isinstance(node, Filter):
        run, arg = FILTERS[node.name], _value(node.arg)
        if node.name == "length":
            return lambda env: run(arg(env))

        def filtered(env: dict) -> str:
            made = run(_text(arg(env)))
            env[""].text(len(made))
            return made

        return filtered
    args = [_value(a) for a in node.args]
    if node.op == "not":
        return lambda env: not args[0](env)
    if node.op == "and":
        return lambda env: args[0](env) and args[1](env)
    if node.op == "or":
        return lambda env: args[0](env) or args[1](env)
    if node.op == "?":
        return lambda env: args[1](env) if args[0](env) else args[2](env)
    run2 = _BINARY[node.op]
    return lambda env: run2(args[0](env), args[1](env), env[""])


Writer = Callable[[dict, list, bool], None]


def _statement(node: object) -> Writer:
    """A closure that writes (text, under the mask) parts."""
    if isinstance(node, tuple):
        steps = [_statement(x) for x in node]

        def run(env: dict, out: list, masked: bool) -> None:
            for s in steps:
                s(env, out, masked)

        return run
    if isinstance(node, Emit):
        value = _value(node.expr)

        def emit(env: dict, out: list, masked: bool) -> None:
            text = _text(value(env))
            env[""].emit(len(text))
            out.append((text, masked))

        return emit
    if isinstance(node, Set):
        name, value = node.name, _value(node.expr)
        return lambda env, out, masked: env.__setitem__(name, value(env))
    if isinstance(node, Generation):
        body = _statement(node.body)
        return lambda env, out, masked: body(env, out, True)
    if isinstance(node, If):
        test, yes, no = _value(node.test), _statement(node.yes), _statement(node.no)
        return lambda env, out, masked: (yes if test(env) else no)(env, out, masked)
    name, source, body = node.name, _value(node.source), _statement(node.body)

    def loop(env: dict, out: list, masked: bool) -> None:
        rows = source(env)
        if not isinstance(rows, (list, tuple)):
            raise TemplateError("for needs a list")
        for k, x in enumerate(rows):
            env[""].round()
            body(env | {name: x, "loop": {"index0": k, "index": k + 1, "first": k == 0, "last": k + 1 == len(rows)}}, out, masked)

    return loop


@lru_cache(maxsize=32)
def compile_template(source: str) -> Callable[..., tuple[str, list[tuple[int, int]]]]:
    """A function of the template's variables: the text, and the code point ranges under the mask."""
    try:
        write = _statement(fold(parse(source)))
    except _FAULTS as e:
        raise e if isinstance(e, TemplateError) else TemplateError(f"{type(e).__name__}: {e}") from None

    def render(**variables: object) -> tuple[str, list[tuple[int, int]]]:
        parts: list[tuple[str, bool]] = []
        budget = _Budget(MOST_CHARS + (MOST_GROWTH + len(source)) * _chars(variables), MOST_ROUNDS)
        try:
            write(dict(variables) | {"": budget}, parts, False)
        except _FAULTS as e:
            raise e if isinstance(e, TemplateError) else TemplateError(f"{type(e).__name__}: {e}") from None
        at, spans = 0, []
        for text, masked in parts:
            if masked and text:
                spans.append((at, at + len(text)))
            at += len(text)
        return "".join(t for t, _ in parts), spans

    return render


def _conversations(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[object, list[dict]]]:
    """Rows that come sorted, conversation by conversation, whatever the batch they lie in."""
    now, turns = None, []
    for batch in batches:
        for r in zip(*(batch.column(k).to_pylist() for k in range(3))):
            if turns and r[0] != now:
                yield now, turns
                turns = []
            now = r[0]
            turns.append({"role": r[1] or "", "text": r[2] or ""})
    if turns:
        yield now, turns


def format_conversations(rows: DataFrame, template: str = TEMPLATE, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """conv_id, formatted, spans: each conversation rendered, with the ranges to learn from."""
    compile_template(template)  # a faulty template fails here
    bound_batches(rows.sparkSession)
    cols = [F.col(conv_col).cast("long").alias("conv_id"), F.col(role_col).alias("role"), F.col(text_col).alias("text"), F.col(turn_col).alias("turn")]
    dealt = rows.select(*cols).repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").drop("turn")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        render = compile_template(template)
        ids, texts, spans, size = [], [], [], 0
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

        def made() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(texts, pa.string()), pa.array(spans, kind)], ["conv_id", "formatted", "spans"])

        for conv, turns in _conversations(batches):
            text, masked = render(messages=turns)
            ids.append(conv)
            texts.append(text)
            spans.append([{"start": a, "end": b} for a, b in masked])
            size += len(text)
            if size > 4 << 20:
                yield made()
                ids, texts, spans, size = [], [], [], 0
        yield made()

    return dealt.mapInArrow(run, FORMATTED)


_turn = re.compile(r"<\|im_start\|>([^\n]*)\n(.*?)<\|im_end\|>\n", re.S)


def read_turns(formatted: str) -> list[tuple[str, str]]:
    """Roles and texts back from what the default template wrote."""
    out, at = [], 0
    while at < len(formatted):
        m = _turn.match(formatted, at)
        if not m:
            raise ValueError(f"no turn at {at}")
        out.append((unescape(m[1]), unescape(m[2])))
        at = m.end()
    return out


def digest_formatted(formatted: DataFrame) -> DataFrame:
    """What the formatted conversations say when they are read back."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: dict[str, list] = {c: [] for c in ("n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")}
            for text, spans in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                turns = read_turns(text)
                loss = "".join(unescape(text[s["start"] : s["end"]]) for s in spans)
                rows["n_turns"].append(len(turns))
                rows["turns_sha256"].append(hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest())
                rows["loss_chars"].append(len(loss))
                rows["loss_sha256"].append(hashlib.sha256(loss.encode()).hexdigest())
                rows["formatted_chars"].append(len(text))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(v, pa.string() if c.endswith("256") else pa.int64()) for c, v in rows.items())], ["conv_id", *rows])

    return formatted.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
