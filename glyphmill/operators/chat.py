"""Chat templates: a subset of Jinja over JSON values, compiled once per worker.

Values are JSON's; mappings iterate in the order of their sorted keys; undefined prints as nothing. What the dialect lacks
(break, continue, raw, else of a loop, unknown tests) is an error; filters that it knows by name only pass values through.
"""

from __future__ import annotations

import json
import math
import re
from collections.abc import Callable

from pyspark.sql import DataFrame
import pyarrow as pa

from .template_syntax import Node, TemplateError, parse

RESERVED = ("messages", "add_generation_prompt", "bos_token", "eos_token")
DEPTH, LOOPS = 64, 1_000_000


class _Undefined:
    def __repr__(self):
        return ""


UNDEFINED = _Undefined()
def truth(v) -> bool:
    return v is not UNDEFINED and v is not None and v != 0 and v != "" and v != [] and v != {} and v is not False


def text_of(v) -> str:
    if v is None or v is UNDEFINED:
        return ""
    if isinstance(v, bool):
        return "True" if v else "False"
    if isinstance(v, float):
        return f"{v:g}"
    return v if isinstance(v, str) else compact(v) if isinstance(v, (list, dict)) else str(v)


def compact(v) -> str:
    return json.dumps(v, ensure_ascii=False, separators=(",", ":"), sort_keys=True, default=lambda x: None)


def _bytewise(f: Callable[[str], str]) -> Callable[[str], str]:
    return lambda s: re.sub(r"[A-Za-z]+", lambda m: f(m[0]), s)


class Run:
    def __init__(self, values: dict, macros: dict):
        self.scopes, self.macros, self.depth = [values], macros, 0

    def get(self, name: str):
        for s in reversed(self.scopes):
            if name in s:
                return s[name]
        return UNDEFINED


def _attribute(v, name):
    if isinstance(v, dict):
        return v.get(name, UNDEFINED) if isinstance(name, str) else UNDEFINED
    if isinstance(v, list) and isinstance(name, int) and not isinstance(name, bool):
        return v[name] if -len(v) <= name < len(v) else UNDEFINED
    return UNDEFINED


def _same(a, b) -> bool:
    return isinstance(a, bool) == isinstance(b, bool) and a == b and (a is UNDEFINED) == (b is UNDEFINED)


def _binary(op: str, a, b):
    number = lambda x: isinstance(x, (int, float)) and not isinstance(x, bool)
    if op == "==":
        return _same(a, b)
    if op == "!=":
        return not _same(a, b)
    if op == "~":
        return text_of(a) + text_of(b)
    if op == "in":
        if isinstance(b, str):
            return isinstance(a, str) and a in b
        return isinstance(b, (list, dict)) and any(_same(a, x) for x in b)
    if op == "+":
        if number(a) and number(b):
            return a + b
        return a + b if isinstance(a, list) and isinstance(b, list) else text_of(a) + text_of(b)
    if op in ("<", ">", "<=", ">="):
        if not (number(a) and number(b) or isinstance(a, str) and isinstance(b, str)):
            return False
        return {"<": a < b, ">": a > b, "<=": a <= b, ">=": a >= b}[op]
    if not (number(a) and number(b)):
        raise TemplateError(f"{op} needs numbers")
    if op in ("/", "//", "%") and not b:
        raise TemplateError("division by zero")
    if op == "//":
        return int(a / b)
    if op == "%":
        return int(math.fmod(a, b)) if isinstance(a, int) and isinstance(b, int) else math.fmod(a, b)
    return {"-": lambda: a - b, "*": lambda: a * b, "/": lambda: a / b, "**": lambda: float(a) ** b}[op]()


TESTS: dict[str, Callable] = {
    "defined": lambda v: v is not UNDEFINED, "undefined": lambda v: v is UNDEFINED, "none": lambda v: v is None, "true": lambda v: v is True, "false": lambda v: v is False,
    "boolean": lambda v: isinstance(v, bool), "string": lambda v: isinstance(v, str), "number": lambda v: isinstance(v, (int, float)) and not isinstance(v, bool),
    "integer": lambda v: isinstance(v, int) and not isinstance(v, bool), "float": lambda v: isinstance(v, float), "mapping": lambda v: isinstance(v, dict),
    "iterable": lambda v: isinstance(v, (list, dict, str)), "sequence": lambda v: isinstance(v, (list, str)), "callable": lambda v: False,
    "even": lambda v: isinstance(v, int) and v % 2 == 0, "odd": lambda v: isinstance(v, int) and v % 2 == 1, "eq": lambda v: False, "ne": lambda v: False, "equalto": lambda v: False,
}


def _sized(v) -> int:
    return len(v.encode()) if isinstance(v, str) else len(v) if isinstance(v, (list, dict)) else 0


def _batch(v, n, *_):
    if n <= 0:
        raise TemplateError("batch needs a positive size")
    return [v[i : i + n] for i in range(0, len(v), n)]


def _replaced(v, a, b, *_):
    if not a:
        raise TemplateError("replace needs something to replace")
    return text_of(v).replace(a, b)


def _split(v, sep=None, *_):
    if sep == "":
        raise TemplateError("split needs a separator")
    return v.split(sep)


# fixed values: what trimming takes away
BLANKS = " \t\n\r"
FILTERS: dict[str, Callable] = {
    "trim": lambda v, *a: text_of(v).strip(BLANKS), "length": lambda v, *a: _sized(v), "count": lambda v, *a: _sized(v),
    "default": lambda v, d="", *a: d if v is UNDEFINED or v is None else v, "d": lambda v, d="", *a: d if v is UNDEFINED or v is None else v,
    "first": lambda v, *a: v[0] if isinstance(v, list) and v else UNDEFINED, "last": lambda v, *a: v[-1] if isinstance(v, list) and v else UNDEFINED,
    "upper": lambda v, *a: _bytewise(str.upper)(text_of(v)), "lower": lambda v, *a: _bytewise(str.lower)(text_of(v)),
    "title": lambda v, *a: re.sub(r"[A-Za-z]+", lambda m: m[0].capitalize(), text_of(v)), "join": lambda v, sep="", *a: sep.join(map(text_of, v)),
    "list": lambda v, *a: sorted(v) if isinstance(v, dict) else list(v), "int": lambda v, *a: int(float(v)) if re.fullmatch(r"-?\d+(\.\d+)?", text_of(v)) else 0,
    "float": lambda v, *a: float(v) if re.fullmatch(r"-?\d+(\.\d+)?", text_of(v)) else 0.0, "string": lambda v, *a: text_of(v), "tojson": lambda v, *a: compact(v),
    "replace": _replaced, "batch": _batch, "reverse": lambda v, *a: v[::-1],
    "dictsort": lambda v, case=False, *a: [[k, v[k]] for k in sorted(v, key=None if case is True else lambda k: k.lower())], "items": lambda v, *a: [[k, v[k]] for k in sorted(v)],
}
METHODS: dict[str, Callable] = {
    "upper": lambda s: _bytewise(str.upper)(s), "lower": lambda s: _bytewise(str.lower)(s), "strip": lambda s, c=BLANKS: s.strip(c), "lstrip": lambda s, c=BLANKS: s.lstrip(c), "rstrip": lambda s, c=BLANKS: s.rstrip(c),
    "split": _split, "replace": _replaced, "startswith": lambda s, p: s.startswith(p), "endswith": lambda s, p: s.endswith(p),
}
DICT_METHODS: dict[str, Callable] = {
    "items": lambda d: [[k, d[k]] for k in sorted(d)], "keys": lambda d: sorted(d), "values": lambda d: [d[k] for k in sorted(d)], "get": lambda d, k, e=None: d.get(k, e),
}


def value_of(node: Node | None, r: Run):
    return UNDEFINED if node is None else _KINDS[node[0]](r, *node[1:])


def _choose(r: Run, value: Node, when: Node, other: Node | None):
    return value_of(value if truth(value_of(when, r)) else other, r)


def _and(r: Run, a: Node, b: Node):
    v = value_of(a, r)
    return value_of(b, r) if truth(v) else v


def _or(r: Run, a: Node, b: Node):
    v = value_of(a, r)
    return v if truth(v) else value_of(b, r)


def _slice(r: Run, a: Node, *parts: Node | None):
    v = value_of(a, r)
    return v[slice(*(None if p is None else value_of(p, r) for p in parts))] if isinstance(v, list) else UNDEFINED


def _method(r: Run, a: Node, key: str, args: list[Node], named: dict):
    v = value_of(a, r)
    known = METHODS if isinstance(v, str) else DICT_METHODS if isinstance(v, dict) else {}
    if key not in known:
        raise TemplateError(f"no method {key}")
    return known[key](v, *(value_of(x, r) for x in args))


def _filter(r: Run, a: Node, name: str, args: list[Node], named: dict[str, Node]):
    v, given = value_of(a, r), [value_of(x, r) for x in args]
    if name == "map":
        if "attribute" in named:
            key = value_of(named["attribute"], r)
            return [_attribute(x, key) for x in v]
        f = FILTERS.get(given[0], lambda x: x)
        return [f(x) for x in v]
    if name == "selectattr":
        if len(given) < 3:
            return [x for x in v if truth(_attribute(x, given[0]))]
        return [x for x in v if _same(_attribute(x, given[0]), given[2]) == (given[1] != "ne")]
    return FILTERS[name](v, *given) if name in FILTERS else v


def _call(r: Run, name: str, args: list[Node], named: dict[str, Node]):
    values, keys = [value_of(x, r) for x in args], {k: value_of(x, r) for k, x in named.items()}
    if name == "raise_exception":
        raise TemplateError(text_of(values[0]) if values else "")
    if name in ("namespace", "dict"):
        return dict(keys)
    if name == "range":
        if len(values) > 2 and not values[2]:
            raise TemplateError("range needs a step")
        return list(range(*values))
    if name not in r.macros:
        raise TemplateError(f"unknown function {name}")
    if r.depth >= DEPTH:
        raise TemplateError("macro recursion too deep")
    parameters, body = r.macros[name]
    scope = {}
    for i, (parameter, default) in enumerate(parameters):
        scope[parameter] = values[i] if i < len(values) else keys[parameter] if parameter in keys else value_of(default, r)
    r.depth += 1
    r.scopes.append(scope)
    try:
        return _text(body, r)
    finally:
        r.scopes.pop()
        r.depth -= 1


_KINDS: dict[str, Callable] = {
    "const": lambda r, v: v, "name": lambda r, n: r.get(n), "attr": lambda r, a, n: _attribute(value_of(a, r), n), "item": lambda r, a, k: _attribute(value_of(a, r), value_of(k, r)),
    "slice": _slice, "call": _call, "method": _method, "filter": _filter, "test": lambda r, a, n, negated: TESTS[n](value_of(a, r)) != negated, "not": lambda r, a: not truth(value_of(a, r)),
    "neg": lambda r, a: -value_of(a, r), "and": _and, "or": _or, "op": lambda r, sign, a, b: _binary(sign, value_of(a, r), value_of(b, r)), "in": lambda r, a, b, negated: _binary("in", value_of(a, r), value_of(b, r)) != negated,
    "choose": _choose, "list": lambda r, items: [value_of(x, r) for x in items], "dict": lambda r, pairs: {text_of(value_of(k, r)): value_of(v, r) for k, v in pairs},
}


def _text(body: list[Node], r: Run) -> str:
    out: list[str] = []
    _run(body, r, out)
    return "".join(out)


def _run(body: list[Node], r: Run, out: list[str]) -> None:
    for node in body:
        kind = node[0]
        if kind == "text":
            out.append(node[1])
        elif kind == "out":
            out.append(text_of(value_of(node[1], r)))
        elif kind == "if":
            chosen = next((branch for when, branch in node[1] if when is None or truth(value_of(when, r))), [])
            _run(chosen, r, out)
        elif kind == "for":
            _loop(r, out, node[1], value_of(node[2], r), node[3])
        elif kind == "macro":
            r.macros[node[1]] = node[2:]
        else:
            _assign(r, node[1], node[2], value_of(node[3], r) if kind == "set" else _text(node[3], r))


def _assign(r: Run, name: str, attribute: str, value) -> None:
    if not attribute:
        r.scopes[-1][name] = value
        return
    target = r.get(name)
    if not isinstance(target, dict):
        raise TemplateError(f"{name} has no attributes to set")
    target[attribute] = value


def _loop(r: Run, out: list, names: list[str], values, body: list[Node]) -> None:
    values = sorted(values) if isinstance(values, dict) else values if isinstance(values, list) else []
    n = len(values)
    r.scopes.append({})  # lasts over all turns
    try:
        for i, v in enumerate(values):
            scope = r.scopes[-1]
            if len(names) == 1:
                scope[names[0]] = v
            else:
                for k, name in enumerate(names):
                    scope[name] = v[k] if isinstance(v, list) and k < len(v) else UNDEFINED
            scope["loop"] = {"index": i + 1, "index0": i, "first": i == 0, "last": i == n - 1, "length": n, "revindex": n - i, "revindex0": n - i - 1}
            if i:
                scope["loop"]["previtem"] = values[i - 1]
            if i < n - 1:
                scope["loop"]["nextitem"] = values[i + 1]
            _run(body, r, out)
    finally:
        r.scopes.pop()


class Template:
    """A parsed template."""

    def __init__(self, source: str):
        self.source, self.body = source, parse(source)

    def render(self, messages: list, add_generation_prompt: bool = True, bos: str = "", eos: str = "", args: dict | None = None) -> str:
        if args is not None and not isinstance(args, dict):
            raise TemplateError("template arguments must be a JSON object")
        for name in args or {}:
            if name in RESERVED:
                raise TemplateError(f"argument {name} is reserved")
        values = {**(args or {}), "messages": messages, "add_generation_prompt": add_generation_prompt, "bos_token": bos, "eos_token": eos}
        try:
            return _text(self.body, Run(values, {}))
        except TemplateError:
            raise
        except (TypeError, ValueError, KeyError, IndexError, AttributeError, RecursionError) as e:
            raise TemplateError(f"Template error: {e}") from e


def apply_chat(df: DataFrame, template: str, messages: str = "messages", out: str = "prompt", add_generation_prompt: bool = True, bos: str = "", eos: str = "", args: dict | None = None) -> DataFrame:
    """df with the rendered text of a column of messages (JSON text of an array)."""
    from .frames import _added_column

    def make():
        compiled = Template(template)
        return lambda m: compiled.render(json.loads(m), add_generation_prompt, bos, eos, args)

    return _added_column(df, out, "string", pa.string(), [messages], make)
