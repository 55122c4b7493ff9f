"""Chat formatting: a sandboxed template language compiled into closures that render and mark conversations."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterable, Iterator
from itertools import chain, groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dunlake.llm.common import ship_package

#: Marks each turn; texts and roles are escaped, so no text can close or open a turn.
CHAT_TEMPLATE = (
    "{% for message in messages %}<|im_start|>{{ message.role | escape_line }}\n"
    "{% if message.role == 'assistant' %}{% generation %}{{ message.text | escape }}{% endgeneration %}"
    "{% else %}{{ message.text | escape }}{% endif %}<|im_end|>\n{% endfor %}"
)
TURN = re.compile(r"<\|im_start\|>([^\n]*)\n(.*?)<\|im_end\|>\n", re.S)
#: Characters of formatted text after which a piece ends at the next end of a loop pass.
PIECE_CHARS = 1 << 18


class TemplateError(ValueError):
    """The template holds something that the language doesn't have."""


def escape(text: str) -> str:
    r"""``\`` becomes ``\\`` and ``<|`` becomes ``<\|``: no control string is left, and ``unescape`` gives the text back."""
    return text.replace("\\", "\\\\").replace("<|", "<\\|")


def escape_line(text: str) -> str:
    """Like ``escape``, and line feeds are escaped too."""
    return escape(text).replace("\n", "\\n")


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], text, flags=re.S) if "\\" in text else text


FILTERS: dict[str, Callable[[str], str]] = {"escape": escape, "escape_line": escape_line, "trim": str.strip, "lower": str.lower, "upper": str.upper}
#: What a dotted name may end in; nothing else of an object can be reached.
FIELDS = {"role", "text", "first", "last", "index"}

_PIECES = re.compile(r"\{\{(.*?)\}\}|\{%(.*?)%\}", re.S)
_LEXEMES = re.compile(r"\s*(?:('(?:[^'\\]|\\.)*')|([A-Za-z_]\w*(?:\.[A-Za-z_]\w*)*)|(==|!=|\||\+|\(|\)))")


# Expressions are tuples: ("const", value), ("name", path), ("filter", name, e), ("not", e), (operator, left, right).
class _Expression:
    def __init__(self, source: str):
        self.tokens, at, source = [], 0, source.strip()
        while at < len(source):
            found = _LEXEMES.match(source, at)
            if not found:
                raise TemplateError(f"unknown expression: {source!r}")
            self.tokens.append(found)
            at = found.end()
        self.at = 0
        self.source = source

    def peek(self) -> str | None:
        return self.tokens[self.at][0].strip() if self.at < len(self.tokens) else None

    def take(self, *options: str) -> str | None:
        if (now := self.peek()) in options:
            self.at += 1
            return now
        return None

    def parse(self):
        tree = self.either()
        if self.at < len(self.tokens):
            raise TemplateError(f"unknown expression: {self.source!r}")
        return tree

    def either(self):
        left = self.both()
        while self.take("or"):
            left = ("or", left, self.both())
        return left

    def both(self):
        left = self.negated()
        while self.take("and"):
            left = ("and", left, self.negated())
        return left

    def negated(self):
        return ("not", self.negated()) if self.take("not") else self.compared()

    def compared(self):
        left = self.joined()
        if sign := self.take("==", "!="):
            return (sign, left, self.joined())
        return left

    def joined(self):
        left = self.filtered()
        while self.take("+"):
            left = ("+", left, self.filtered())
        return left

    def filtered(self):
        tree = self.atom()
        while self.take("|"):
            name = self.peek()
            if name not in FILTERS:
                raise TemplateError(f"unknown filter: {name!r}")
            self.at += 1
            tree = ("filter", name, tree)
        return tree

    def atom(self):
        if self.take("("):
            tree = self.either()
            if not self.take(")"):
                raise TemplateError(f"unclosed bracket: {self.source!r}")
            return tree
        if self.at >= len(self.tokens):
            raise TemplateError(f"unfinished expression: {self.source!r}")
        text, name, _ = self.tokens[self.at].groups()
        self.at += 1
        if text is not None:
            return ("const", re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], text[1:-1]))
        if name in ("true", "false"):
            return ("const", name == "true")
        if name is None or any(part not in FIELDS for part in name.split(".")[1:]):
            raise TemplateError(f"not reachable: {name!r}")
        return ("name", tuple(name.split(".")))


def parse(template: str) -> list[tuple]:
    """Syntax tree: a list of ("text", s), ("put", e), ("for", name, source, body), ("if", [(e, body)...]), ("generation", body)."""
    stack: list[tuple[str, list]] = [("", [])]
    at = 0
    for found in chain(_PIECES.finditer(template), [None]):
        plain = template[at : found.start() if found else len(template)]
        if plain:
            stack[-1][1].append(("text", plain))
        if found is None:
            break
        at = found.end()
        if found[1] is not None:
            stack[-1][1].append(("put", _Expression(found[1]).parse()))
            continue
        words = found[2].strip()
        keyword, _, rest = words.partition(" ")
        if keyword == "for":
            loop = re.fullmatch(r"([A-Za-z_]\w*) in ([A-Za-z_]\w*)", rest.strip())
            if not loop:
                raise TemplateError(f"unknown loop: {words!r}")
            node = ("for", loop[1], loop[2], [])
            stack[-1][1].append(node)
            stack.append(("for", node[3]))
        elif keyword == "if":
            node = ("if", [(_Expression(rest).parse(), [])])
            stack[-1][1].append(node)
            stack.append(("if", node[1][0][1]))
        elif keyword in ("elif", "else") and stack[-1][0] == "if":
            branches = stack[-2][1][-1][1]
            branches.append((_Expression(rest).parse() if keyword == "elif" else ("const", True), []))
            stack[-1] = ("if", branches[-1][1])
        elif keyword == "generation":
            node = ("generation", [])
            stack[-1][1].append(node)
            stack.append(("generation", node[1]))
        elif keyword.startswith("end") and stack[-1][0] == keyword[3:] != "":
            stack.pop()
        else:
            raise TemplateError(f"unknown or misplaced: {words!r}")
    if len(stack) > 1:
        raise TemplateError(f"not closed: {stack[-1][0]}")
    return stack[0][1]


def _evaluate(tree: tuple, env: dict):
    return _expression(tree)(env)


def fold(tree: tuple) -> tuple:
    """The expression with all parts that need no variable replaced by their value."""
    if tree[0] in ("const", "name"):
        return tree
    inner = [fold(t) if isinstance(t, tuple) else t for t in tree[1:]]
    tree = (tree[0], *inner)
    return ("const", _evaluate(tree, {})) if all(t[0] == "const" for t in inner if isinstance(t, tuple)) else tree


def fold_body(body: list[tuple]) -> list[tuple]:
    """Fold expressions, drop branches that can't be taken, and join neighbouring constant texts."""
    out: list[tuple] = []

    def add(node: tuple) -> None:
        if node[0] == "text" and out and out[-1][0] == "text":
            out[-1] = ("text", out[-1][1] + node[1])
        elif node != ("text", ""):
            out.append(node)

    for node in body:
        if node[0] == "put":
            tree = fold(node[1])
            add(("text", _text(tree[1])) if tree[0] == "const" else ("put", tree))
        elif node[0] == "for":
            add(("for", node[1], node[2], fold_body(node[3])))
        elif node[0] == "generation":
            add(("generation", fold_body(node[1])))
        elif node[0] == "if":
            branches = []
            for test, inner in node[1]:
                test = fold(test)
                if test[0] == "const" and not test[1]:
                    continue
                branches.append((test, fold_body(inner)))
                if test[0] == "const":
                    break
            if branches and branches[0][0][0] == "const":
                for inner in branches[0][1]:
                    add(inner)
            elif branches:
                add(("if", branches))
        else:
            add(node)
    return out


def _text(value) -> str:
    return "" if value is None else str(value)


def _expression(tree: tuple) -> Callable[[dict], object]:
    kind = tree[0]
    if kind == "const":
        return lambda env: tree[1]
    if kind == "name":
        head, *fields = tree[1]

        def look(env):
            value = env.get(head)
            for field in fields:
                value = value.get(field) if isinstance(value, dict) else None
            return value

        return look
    if kind == "filter":
        function, inner = FILTERS[tree[1]], _expression(tree[2])
        return lambda env: function(_text(inner(env)))
    parts = [_expression(t) for t in tree[1:]]
    if kind == "not":
        return lambda env: not parts[0](env)
    left, right = parts
    return {
        "and": lambda env: left(env) and right(env),
        "or": lambda env: left(env) or right(env),
        "==": lambda env: left(env) == right(env),
        "!=": lambda env: left(env) != right(env),
        "+": lambda env: _text(left(env)) + _text(right(env)),
    }[kind]


#: A fragment of output: its text, whether it is generated, and whether a pass of the outermost loop ends with it.
Fragment = tuple[str, bool, bool]


def _closure(body: list[tuple], marked: bool, depth: int) -> Callable[[dict], Iterator[Fragment]]:
    steps = []
    for node in body:
        kind = node[0]
        if kind == "text":
            steps.append(lambda env, text=node[1]: iter(((text, marked, False),)))
        elif kind == "put":
            steps.append(lambda env, get=_expression(node[1]): iter(((_text(get(env)), marked, False),)))
        elif kind == "generation":
            steps.append(_closure(node[1], True, depth))
        elif kind == "if":
            steps.append(_choice([(_expression(test), _closure(inner, marked, depth)) for test, inner in node[1]]))
        else:
            steps.append(_loop(node[1], node[2], _closure(node[3], marked, depth + 1), depth))

    def run(env: dict) -> Iterator[Fragment]:
        for step in steps:
            yield from step(env)

    return run


def _choice(branches):
    def run(env: dict) -> Iterator[Fragment]:
        for test, body in branches:
            if test(env):
                yield from body(env)
                return

    return run


def _loop(name: str, source: str, body, depth: int):
    def run(env: dict) -> Iterator[Fragment]:
        items = iter(env.get(source) or ())
        item = next(items, None)
        index = 0
        while item is not None:
            following = next(items, None)
            index += 1
            yield from body({**env, name: item, "loop": {"first": index == 1, "last": following is None, "index": index}})
            if depth == 0:
                yield "", False, True
            item = following

    return run


def compile_template(template: str) -> Callable[[Iterable[dict]], Iterator[Fragment]]:
    """Function from messages (dicts with role and text) to fragments. It reads messages one at a time."""
    body = _closure(fold_body(parse(template)), False, 0)
    return lambda messages: body({"messages": messages})


def pieces(fragments: Iterable[Fragment], limit: int = PIECE_CHARS) -> Iterator[tuple[str, list[tuple[int, int]], int]]:
    """Join fragments into pieces of whole loop passes: text, the generated spans as offsets in the piece, and passes so far.

    A piece ends with the pass in which it reaches ``limit`` characters. Fragments without text give no piece.
    """
    texts, spans, size, passes = [], [], 0, 0
    for text, marked, ends in fragments:
        if marked and text:
            spans.append((size, size + len(text)))
        texts.append(text)
        size += len(text)
        passes += ends
        if ends and size >= limit:
            yield "".join(texts), spans, passes
            texts, spans, size = [], [], 0
    if size:
        yield "".join(texts), spans, passes


def _stream(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(column.to_pylist() for column in batch.columns), strict=True)


PIECE_SCHEMA = pa.schema(
    [("conv_id", pa.int64()), ("piece", pa.int64()), ("n_turns", pa.int64()), ("text", pa.string()), ("starts", pa.list_(pa.int64())), ("ends", pa.list_(pa.int64()))]
)
PIECE_DDL = "conv_id long, piece long, n_turns long, text string, starts array<long>, ends array<long>"


def format_conversations(turns: DataFrame, template: str = CHAT_TEMPLATE) -> DataFrame:
    """Render each conversation: (conv_id, piece, n_turns, text, starts, ends), pieces in order from 0.

    ``turns`` has conv_id, turn, role and text; null role or text is empty, rows without conv_id form one conversation,
    rows of a conversation are taken in the order of turn, role, text (nulls first), repeated rows each count. starts and
    ends are the generated spans in code points of the piece; n_turns is the number of turns of the conversation up to
    the end of the piece. A long conversation gives several pieces, each with whole turns. Other columns don't matter.

    Rows are dealt by conversation and sorted; the task reads them as a stream and holds one piece, so a conversation
    may be larger than memory.
    """
    ship_package(turns)
    render = compile_template(template)
    ordered = (
        turns.select(
            F.col("conv_id").cast("long").alias("conv_id"), "turn",
            F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
        )
        .repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", "role", "text")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        size = 0
        for conv_id, group in groupby(_stream(batches), key=lambda row: row[0]):
            messages = ({"role": role, "text": text} for _, role, text in group)
            for piece, (text, spans, n_turns) in enumerate(pieces(render(messages))):
                out.append((conv_id, piece, n_turns, text, [a for a, _ in spans], [b for _, b in spans]))
                size += len(text)
                if size >= 1 << 22:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), PIECE_SCHEMA, strict=True)], schema=PIECE_SCHEMA)
                    out, size = [], 0
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), PIECE_SCHEMA, strict=True)], schema=PIECE_SCHEMA)

    return ordered.mapInArrow(run, PIECE_DDL)


DIGEST_DDL = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
DIGEST_SCHEMA = pa.schema(
    [("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())]
)


def read_back(formatted: DataFrame) -> DataFrame:
    """Parse formatted pieces again: one row per conversation with digests of its turns and of the text under the mask.

    Takes the output of ``format_conversations`` with the default template, whose tasks hold the pieces in order.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = []
        for conv_id, group in groupby(_stream(batches), key=lambda row: row[0]):
            turns, loss = hashlib.sha256(), hashlib.sha256()
            n_turns = loss_chars = chars = 0
            for _, _, _, text, starts, ends in group:
                at = 0
                for turn in TURN.finditer(text):
                    if turn.start() != at:
                        raise ValueError("formatted text holds more than turns")
                    at = turn.end()
                    n_turns += 1
                    turns.update(f"{unescape(turn[1])}\n{unescape(turn[2])}\n".encode())
                if at != len(text):
                    raise ValueError("formatted text holds more than turns")
                chars += len(text)
                for start, end in zip(starts, ends, strict=True):
                    said = unescape(text[start:end])
                    loss_chars += len(said)
                    loss.update(said.encode())
            out.append((conv_id, n_turns, turns.hexdigest(), loss_chars, loss.hexdigest(), chars))
            if len(out) >= 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), DIGEST_SCHEMA, strict=True)], schema=DIGEST_SCHEMA)
                out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), DIGEST_SCHEMA, strict=True)], schema=DIGEST_SCHEMA)

    ship_package(formatted)
    return formatted.mapInArrow(run, DIGEST_DDL)
