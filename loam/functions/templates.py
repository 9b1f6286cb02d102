"""Chat templates as column expressions: a template is read once on the driver, and what it renders is built from Spark's own functions."""

from __future__ import annotations

import ast
import re
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from loam.functions.text import strip

TAG = re.compile(r"\{%[-+]?.*?[-+]?%\}|\{\{-?.*?-?\}\}|\{#-?.*?-?#\}", re.DOTALL)
QUOTED = re.compile(r"('(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\")", re.DOTALL)


@dataclass(frozen=True)
class Value:
    """A column with the kind of what it holds: text, bool, int, messages (an array of role and content) or message."""

    column: Column
    kind: str


@dataclass(frozen=True)
class Loop:
    index0: Value
    length: Value


class Undefined:
    """A name or field that isn't there: an empty text, and false."""


#: What expressions give: a constant of Python, a column, or a loop's state.
Any_ = object
Env = dict[str, Any_]


def render(template: str, messages: Column, **given: object) -> Column:
    """The text that a chat template makes of messages (an array of role and content, in order); null contents are empty, null messages give null.

    A template may loop over messages or a slice of them, test, set names, and use loop.first, last, index, index0 and length; roles, contents,
    constants and given names (bos_token, add_generation_prompt and such); ``+``, ``~``, ``%``, comparisons, ``in``, ``and``, ``or``, ``not``, ``a if b else c``; the filters trim, upper, lower, length;
    the methods strip, lstrip, rstrip, upper, lower, startswith, endswith and split with an index; ``is defined``, ``is none``; raise_exception, which fails
    the job for conversations that come to it. Names that are set in a loop are its round's own. White space around tags goes as for templates of tokenizers: a
    line feed after a block tag, and blanks before one on its line. Anything else is a ValueError when the template is read.
    """
    env: Env = {"messages": Value(messages, "messages"), **given}
    parts = parse(template)
    body, at, _ = _block(parts, 0, ())
    if at != len(parts):
        raise ValueError(f"a tag without its beginning: {parts[at][1]}")
    out, _ = _run(body, env)
    return F.when(messages.isNotNull(), _text(out))


def parse(template: str) -> list[tuple[str, str]]:
    """(text | output | block, content) in order, without comments."""
    out: list[tuple[str, str]] = []
    at, eat = 0, ""
    for m in [*TAG.finditer(template), None]:
        text = template[at : m.start() if m else len(template)]
        if eat == "-":
            text = text.lstrip()
        elif eat == "\n" and text.startswith("\n"):
            text = text[1:]
        if m is None:
            out.append(("text", text))
            break
        tag, at = m.group(), m.end()
        if tag[2] == "-":
            text = text.rstrip()
        elif tag[1] in "%#" and tag[2] != "+":
            text = re.sub(r"(^|\n)[ \t]+\Z", r"\1", text) if text.strip(" \t") != "" or not out else re.sub(r"[ \t]+\Z", "", text) if _line_start(out) else text
        out.append(("text", text))
        eat = "-" if tag[-3] == "-" else "\n" if tag[1] in "%#" else ""
        if tag[1] != "#":
            out.append(("block" if tag[1] == "%" else "output", tag[2:-2].strip("+-").strip()))
    return [p for p in out if p != ("text", "")]


def _line_start(out: list[tuple[str, str]]) -> bool:
    """Whether what comes next begins a line: after a block tag whose line feed is gone there is nothing else on the line."""
    return not out or out[-1][0] == "block" or out[-1][1].endswith("\n")


Node = tuple


def _block(parts: list[tuple[str, str]], at: int, ends: tuple[str, ...]) -> tuple[list[Node], int, str]:
    """Nodes up to a block tag that begins with one of ends."""
    nodes: list[Node] = []
    while at < len(parts):
        kind, content = parts[at]
        word = content.split(None, 1)[0] if kind == "block" and content else ""
        if word in ends:
            return nodes, at, word
        at += 1
        if kind == "text":
            nodes.append(("text", content))
        elif kind == "output":
            nodes.append(("output", expression(content)))
        elif word == "set":
            m = re.fullmatch(r"set\s+(\w+)\s*=\s*(.*)", content, re.DOTALL)
            if m is None:
                raise ValueError(f"not understood: {content}")
            nodes.append(("set", m[1], expression(m[2])))
        elif word == "for":
            m = re.fullmatch(r"for\s+(\w+)\s+in\s+(.*)", content, re.DOTALL)
            if m is None:
                raise ValueError(f"not understood: {content}")
            body, at, word = _block(parts, at, ("endfor",))
            _closed(word, content)
            at += 1
            nodes.append(("for", m[1], expression(m[2]), body))
        elif word == "if":
            branches, test = [], expression(content[2:])
            while True:
                body, at, word = _block(parts, at, ("elif", "else", "endif"))
                _closed(word, content)
                branches.append((test, body))
                tag, at = parts[at][1], at + 1
                if word == "endif":
                    break
                test = expression(tag[4:]) if word == "elif" else ast.Constant(True)
            nodes.append(("if", branches))
        elif word not in ("generation", "endgeneration"):  # marks for training, which render nothing
            raise ValueError(f"not understood: {content}")
    return nodes, at, ""


def _closed(word: str, tag: str) -> None:
    if not word:
        raise ValueError(f"a tag without its end: {tag}")


def expression(source: str) -> ast.expr:
    """An expression of a template as one of Python: they differ in the names of constants, and in that a filter binds tightest."""
    pieces = QUOTED.split(source)
    for i in range(0, len(pieces), 2):
        p = re.sub(r"\btrue\b", "True", re.sub(r"\bfalse\b", "False", re.sub(r"\bnone\b", "None", pieces[i])))
        pieces[i] = p.replace("**", "?").replace("|", "**").replace("~", "@").replace("\n", " ")
    try:
        return ast.parse("".join(p.replace("\n", "\\n") if i % 2 else p for i, p in enumerate(pieces)).strip(), mode="eval").body
    except SyntaxError as e:
        raise ValueError(f"not understood: {source}") from e


def _run(nodes: list[Node], env: Env) -> tuple[Any_, Env]:
    """What nodes render, and the names after them."""
    out: list[Any_] = []
    for node in nodes:
        if node[0] == "text":
            out.append(node[1])
        elif node[0] == "output":
            out.append(_str(_eval(node[1], env)))
        elif node[0] == "set":
            env = env | {node[1]: _eval(node[2], env)}
        elif node[0] == "for":
            out.append(_loop(node, env))
        else:
            made, env = _choose(node[1], env)
            out.append(made)
    return _concat(out), env


def _loop(node: Node, env: Env) -> Any_:
    _, name, source, body = node
    over = _eval(source, env)
    if not isinstance(over, Value) or over.kind != "messages":
        raise ValueError("only messages can be looped over")

    def each(m: Column, i: Column) -> Column:
        loop = Loop(Value(i, "int"), Value(F.size(over.column), "int"))
        return _text(_run(body, env | {name: Value(m, "message"), "loop": loop})[0])

    return Value(F.array_join(F.transform(over.column, each), ""), "text")


def _choose(branches: list[tuple[ast.expr, list[Node]]], env: Env) -> tuple[Any_, Env]:
    """What the first branch renders whose test holds; names that branches set differ by the same tests."""
    if not branches:
        return "", env
    (test, body), rest = branches[0], branches[1:]
    holds = _truth(_eval(test, env))
    if isinstance(holds, bool):
        return _run(body, env) if holds else _choose(rest, env)
    yes, env_yes = _run(body, env)
    no, env_no = _choose(rest, env)
    merged = dict(env)
    for name in env_yes.keys() | env_no.keys():
        a, b = env_yes.get(name, Undefined()), env_no.get(name, Undefined())
        if a is not b:
            merged[name] = _either(holds, a, b)
    return _either(holds, yes, no), merged


def _either(test: Value, a: Any_, b: Any_) -> Any_:
    kinds = {_kind(x) for x in (a, b)} - {"undefined"}
    if kinds <= {"bool"}:
        return Value(F.when(test.column, _bool(a)).otherwise(_bool(b)), "bool")
    if kinds == {"int"}:
        return Value(F.when(test.column, _column(a)).otherwise(_column(b)), "int")
    if kinds <= {"messages"}:
        return Value(F.when(test.column, _column(a)).otherwise(_column(b)), "messages")
    # false or none for a text that isn't there counts as an empty one, which is as false
    a, b = ("" if x is False or x is None else x for x in (a, b))
    if not {_kind(x) for x in (a, b)} <= {"text", "undefined"}:
        raise ValueError(f"one name for values of the kinds {sorted(kinds)}")
    return Value(F.when(test.column, _text(a)).otherwise(_text(b)), "text")


def _kind(x: Any_) -> str:
    if isinstance(x, Value):
        return x.kind
    return "undefined" if x is None or isinstance(x, Undefined) else "bool" if isinstance(x, bool) else "int" if isinstance(x, int) else "text"


def _column(x: Any_) -> Column:
    return x.column if isinstance(x, Value) else F.lit(x)


def _bool(x: Any_) -> Column:
    x = _truth(x)
    return x.column if isinstance(x, Value) else F.lit(x)


def _str(x: Any_) -> Any_:
    """As output: constants as they are written, nothing for what isn't there."""
    if isinstance(x, Value):
        return x if x.kind == "text" else Value(x.column.cast("string"), "text")
    return "" if isinstance(x, Undefined) else str(x)


def _text(x: Any_) -> Column:
    x = _str(x)
    return F.coalesce(x.column, F.lit("")) if isinstance(x, Value) else F.lit(x)


def _concat(parts: list[Any_]) -> Any_:
    joined: list[Any_] = []
    for p in map(_str, parts):
        if isinstance(p, str) and joined and isinstance(joined[-1], str):
            joined[-1] += p
        elif p != "":
            joined.append(p)
    if not joined:
        return ""
    if len(joined) == 1:
        return joined[0]
    return Value(F.concat(*(_text(p) for p in joined)), "text")


def _truth(x: Any_) -> Value | bool:
    if not isinstance(x, Value):
        return False if isinstance(x, Undefined) else bool(x)
    if x.kind == "bool":
        return x
    if x.kind == "text":
        return Value(F.coalesce(x.column, F.lit("")) != "", "bool")
    if x.kind == "int":
        return Value(x.column != 0, "bool")
    return Value(F.size(x.column) > 0, "bool") if x.kind == "messages" else Value(x.column.isNotNull(), "bool")


COMPARE: dict[type, Callable] = {ast.Eq: lambda a, b: a == b, ast.NotEq: lambda a, b: a != b, ast.Lt: lambda a, b: a < b, ast.LtE: lambda a, b: a <= b, ast.Gt: lambda a, b: a > b, ast.GtE: lambda a, b: a >= b}
FILTERS: dict[str, Callable[[Column], Column]] = {
    "trim": strip,
    "strip": strip,
    "lstrip": lambda c: F.regexp_replace(c, r"(?U)^[\s\x1c-\x1f]+", ""),
    "rstrip": lambda c: F.regexp_replace(c, r"(?U)[\s\x1c-\x1f]+\z", ""),
    "upper": F.upper,
    "lower": F.lower,
}


def _no(e: ast.expr) -> ValueError:
    return ValueError(f"not understood: {ast.unparse(e).replace('**', '|').replace('@', '~')}")


def _eval(e: ast.expr, env: Env) -> Any_:
    if isinstance(e, ast.Constant):
        return e.value
    if isinstance(e, ast.Name):
        return env.get(e.id, Undefined())
    if isinstance(e, (ast.Attribute, ast.Subscript)):
        return _field(e, env)
    if isinstance(e, ast.BinOp):
        return _binary(e, env)
    if isinstance(e, ast.BoolOp):
        return _logic(isinstance(e.op, ast.And), [_eval(v, env) for v in e.values])
    if isinstance(e, ast.UnaryOp):
        x = _eval(e.operand, env)
        if isinstance(e.op, ast.Not):
            x = _truth(x)
            return Value(~x.column, "bool") if isinstance(x, Value) else not x
        if isinstance(e.op, ast.USub) and isinstance(x, int):
            return -x
    if isinstance(e, ast.IfExp):
        test = _truth(_eval(e.test, env))
        if isinstance(test, bool):
            return _eval(e.body if test else e.orelse, env)
        return _either(test, _eval(e.body, env), _eval(e.orelse, env))
    if isinstance(e, ast.Compare) and len(e.ops) == 1:
        return _compare(e, env)
    if isinstance(e, ast.Call):
        return _call(e, env)
    raise _no(e)


def _logic(all_: bool, values: list[Any_]) -> Any_:
    known = [_truth(v) for v in values]
    if (not all_) in [k for k in known if isinstance(k, bool)]:
        return not all_
    columns = [k.column for k in known if isinstance(k, Value)]
    if not columns:
        return all_
    return Value(reduce((lambda a, b: a & b) if all_ else (lambda a, b: a | b), columns), "bool")


def _field(e: ast.Attribute | ast.Subscript, env: Env) -> Any_:
    x = _eval(e.value, env)
    if isinstance(e, ast.Subscript) and isinstance(e.slice, ast.Slice):
        return _slice(e, x, env)
    key = e.attr if isinstance(e, ast.Attribute) else _eval(e.slice, env)
    if isinstance(x, Loop):
        i, n = x.index0, x.length
        found = {"index0": i, "length": n, "index": Value(i.column + 1, "int"), "first": Value(i.column == 0, "bool"), "last": Value(i.column == n.column - 1, "bool")}
        if key in found:
            return found[key]
    elif isinstance(x, Value) and x.kind == "message":
        return Value(F.coalesce(x.column[key], F.lit("")), "text") if key in ("role", "content") else Undefined()
    elif isinstance(x, Value) and x.kind == "messages" and isinstance(key, int):
        return Value(F.try_element_at(x.column, F.lit(key + 1 if key >= 0 else key)), "message")
    elif isinstance(x, Value) and x.kind == "pieces" and isinstance(key, int):
        return Value(F.coalesce(F.try_element_at(x.column, F.lit(key + 1 if key >= 0 else key)), F.lit("")), "text")
    elif isinstance(x, Undefined):
        return x
    raise _no(e)


def _slice(e: ast.Subscript, x: Any_, env: Env) -> Any_:
    low, high = (None if b is None else _eval(b, env) for b in (e.slice.lower, e.slice.upper))
    if not (isinstance(x, Value) and x.kind == "messages") or e.slice.step or not all(b is None or isinstance(b, int) for b in (low, high)):
        raise _no(e)
    n = F.size(x.column)
    place = lambda b: F.lit(b) if b >= 0 else F.greatest(n + b, F.lit(0))
    start = place(low or 0)
    end = n if high is None else F.least(place(high), n)
    return Value(F.slice(x.column, start + 1, F.greatest(end - start, F.lit(0))), "messages")


def _binary(e: ast.BinOp, env: Env) -> Any_:
    a = _eval(e.left, env)
    if isinstance(e.op, ast.Pow):  # a filter; a chain of them nests to the right
        rest = e.right
        while True:
            last = not (isinstance(rest, ast.BinOp) and isinstance(rest.op, ast.Pow))
            a = _filter(rest if last else rest.left, a, e)
            if last:
                return a
            rest = rest.right
    b = _eval(e.right, env)
    if isinstance(e.op, ast.MatMult) or isinstance(e.op, ast.Add) and "text" in (_kind(a), _kind(b)):
        return _concat([a, b])
    how = {ast.Add: lambda p, q: p + q, ast.Sub: lambda p, q: p - q, ast.Mod: lambda p, q: p % q}.get(type(e.op))
    if how is None or {_kind(a), _kind(b)} != {"int"}:
        raise _no(e)
    return Value(how(_column(a), _column(b)), "int") if isinstance(a, Value) or isinstance(b, Value) else how(a, b)


def _filter(e: ast.expr, x: Any_, whole: ast.expr) -> Any_:
    name = e.id if isinstance(e, ast.Name) else ""
    if name in ("length", "count") and isinstance(x, Value):
        return Value(F.size(x.column) if x.kind == "messages" else F.length(x.column), "int")
    if name in FILTERS and not name.endswith("strip") and _kind(x) in ("text", "undefined"):
        return Value(FILTERS[name](_text(x)), "text")
    raise _no(whole)


def _compare(e: ast.Compare, env: Env) -> Any_:
    op, right = e.ops[0], e.comparators[0]
    a = _eval(e.left, env)
    if isinstance(op, (ast.Is, ast.IsNot)):
        name = right.id if isinstance(right, ast.Name) else "none" if isinstance(right, ast.Constant) and right.value is None else ""
        if isinstance(right, ast.UnaryOp) and isinstance(right.op, ast.Not) and isinstance(right.operand, ast.Name):
            name, op = right.operand.id, ast.IsNot()
        told = {"defined": not isinstance(a, Undefined), "undefined": isinstance(a, Undefined), "none": a is None, "string": _kind(a) == "text"}
        if name not in told:
            raise _no(e)
        return told[name] == isinstance(op, ast.Is)
    if isinstance(op, (ast.In, ast.NotIn)):
        if isinstance(right, (ast.List, ast.Tuple)):
            found = _logic(False, [_same(a, _eval(x, env)) for x in right.elts])
        else:
            b = _eval(right, env)
            if _kind(a) != "text" or _kind(b) not in ("text", "message"):
                raise _no(e)
            found = a in ("role", "content") if _kind(b) == "message" else Value(F.contains(_text(b), _text(a)), "bool")
        if isinstance(op, ast.In):
            return found
        return Value(~found.column, "bool") if isinstance(found, Value) else not found
    b = _eval(right, env)
    if isinstance(op, (ast.Eq, ast.NotEq)):
        same = _same(a, b)
        if isinstance(op, ast.Eq):
            return same
        return Value(~same.column, "bool") if isinstance(same, Value) else not same
    if {_kind(a), _kind(b)} != {"int"}:
        raise _no(e)
    how = COMPARE[type(op)]
    return Value(how(_column(a), _column(b)), "bool") if isinstance(a, Value) or isinstance(b, Value) else how(a, b)


def _same(a: Any_, b: Any_) -> Any_:
    if not isinstance(a, Value) and not isinstance(b, Value):
        return a == b
    if _kind(a) != _kind(b):
        return False
    return Value(_column(a) == _column(b), "bool")


def _call(e: ast.Call, env: Env) -> Any_:
    values = [_eval(a, env) for a in e.args]
    if isinstance(e.func, ast.Name) and e.func.id == "raise_exception" and len(values) == 1:
        return Value(F.raise_error(_text(values[0])).cast("string"), "text")
    if isinstance(e.func, ast.Attribute) and not e.keywords:
        x, name = _eval(e.func.value, env), e.func.attr
        if _kind(x) in ("text", "undefined"):
            if name in FILTERS and not values:
                return Value(FILTERS[name](_text(x)), "text")
            if name in ("startswith", "endswith") and len(values) == 1:
                return Value(getattr(_text(x), name)(_text(values[0])), "bool")
            if name == "split" and len(values) == 1 and isinstance(values[0], str) and values[0]:
                return Value(F.split(_text(x), re.sub(r"(\W)", r"\\\1", values[0])), "pieces")
    raise _no(e)
