"""Chat templates as Column expressions: a template's tree is evaluated in part, when the plan is made, and what is left of it is
built-in functions over the messages, in the JVM.

What the template alone decides (constants, dictionaries, macros, loops over lists that it writes itself, tests of a column's
type) is done at once. What depends on the messages becomes an expression: a `for` over them is a transform() whose pieces are joined;
one that carries names from turn to turn is an aggregate() whose accumulator is a struct of the text and these names; an `if` is a
CASE, and so are the values of names that its branches set. Macros are put in where they are called.

Messages may be a column of arrays of structs (of any fields), of VARIANT, or of JSON text, which is parsed to VARIANT; a struct's
types are known when the plan is made, a VARIANT's are looked up row by row, and so are those of a name that gets values of
different types. A struct's field that is null counts as undefined and as none. What can't be expressed raises Uncompilable when
the plan is made: recursion that depends on the messages, dictionaries with computed keys, sums of two values whose types only
the row knows. Null messages give null, no messages the template's text around them.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..operators import chat
from ..operators.template_syntax import Node, TemplateError, parse

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
STRING, LONG, DOUBLE, BOOL, ANY = T.StringType(), T.LongType(), T.DoubleType(), T.BooleanType(), T.VariantType()
#: Rounds in which the types of carried names must settle.
SETTLE = 6


class Uncompilable(TemplateError):
    """The template does what expressions can't."""


@dataclass(frozen=True)
class Const:
    """A value that is known when the plan is made."""

    value: object


@dataclass(frozen=True)
class Dyn:
    """A column of a type; null is undefined."""

    type: T.DataType
    column: Column


@dataclass(eq=False)
class Items:
    """A list of known length."""

    items: list


@dataclass(eq=False)
class Fields:
    """A dictionary or namespace with known keys."""

    fields: dict = field(default_factory=dict)


Value = Const | Dyn | Items | Fields
UNDEFINED = Const(chat.UNDEFINED)


def _lit(value) -> Dyn:
    """A constant as a column."""
    kind = BOOL if isinstance(value, bool) else LONG if isinstance(value, int) else DOUBLE if isinstance(value, float) else STRING if isinstance(value, str) else None
    if kind is None:
        raise Uncompilable(f"{value!r} can't be a column")
    return Dyn(kind, F.lit(value).cast(kind))


def _void(v: Value) -> bool:
    """None or undefined, which have no type."""
    return isinstance(v, Const) and (v.value is None or v.value is chat.UNDEFINED)


def _plain(v: Value) -> Value:
    """Lists and dictionaries of constants are constants."""
    if isinstance(v, Items) and all(isinstance(_plain(x), Const) for x in v.items):
        return Const([_plain(x).value for x in v.items])
    if isinstance(v, Fields) and all(isinstance(_plain(x), Const) for x in v.fields.values()):
        return Const({k: _plain(x).value for k, x in v.fields.items()})
    return v


def _opened(v: Value) -> Value:
    """A constant list or dictionary as one of values."""
    if isinstance(v, Const) and isinstance(v.value, list):
        return Items([Const(x) for x in v.value])
    if isinstance(v, Const) and isinstance(v.value, dict):
        return Fields({k: Const(x) for k, x in v.value.items()})
    return v


def _column(v: Value) -> Dyn:
    v = _plain(v)
    if isinstance(v, Dyn):
        return v
    if isinstance(v, Const) and not isinstance(v.value, (list, dict)):
        return _lit(v.value)
    if isinstance(v, (Items, Const)):
        items = [_column(x) for x in _opened(v).items] if isinstance(_opened(v), Items) else []
        kind = items[0].type if items else STRING
        if isinstance(_opened(v), Items) and all(x.type == kind for x in items):
            return Dyn(T.ArrayType(kind), F.array(*(x.column for x in items)).cast(T.ArrayType(kind)))
    raise Uncompilable("a list or dictionary of values of different types")


# what VARIANT values are: their type is looked up row by row
def _is(c: Column, *names: str) -> Column:
    return F.coalesce(F.schema_of_variant(c).rlike(rf"\A(?:{'|'.join(names)})(?![A-Z])"), F.lit(False))


_NUMBERS = ("BIGINT", "DOUBLE", "DECIMAL", "FLOAT", "INT", "SMALLINT", "TINYINT")


def _get(c: Column, kind: str) -> Column:
    return F.try_variant_get(c, "$", kind)


def text(v: Value) -> Column:
    """As it is printed; never null."""
    v = _plain(v)
    if isinstance(v, Const):
        return F.lit(chat.text_of(v.value))
    if isinstance(v, (Items, Fields)):
        return json_of(v)
    c = v.column
    if v.type == STRING:
        shown = c
    elif v.type == BOOL:
        shown = F.when(c, "True").when(~c, "False")
    elif v.type == DOUBLE:
        shown = _six_digits(c)
    elif v.type == ANY:
        fraction = _get(c, "double")
        shown = F.when(_is(c, "STRING"), _get(c, "string")).when(_is(c, "BOOLEAN"), F.initcap(_get(c, "string"))).when(F.is_variant_null(c), "").when(_is(c, "DOUBLE", "DECIMAL", "FLOAT"), _six_digits(fraction)).otherwise(F.to_json(c))
    elif isinstance(v.type, (T.ArrayType, T.StructType, T.MapType)):
        shown = F.when(c.isNotNull(), json_of(v))
    else:
        shown = c.cast("string")
    return F.coalesce(shown, F.lit(""))


def _six_digits(c: Column) -> Column:
    """A number with six significant digits, as C's %g prints it."""
    small = (F.abs(c) >= 1e-4) & (F.abs(c) < 999999.5)
    point = F.format_string("%.6g", c)
    plain = F.when(point.contains("."), F.regexp_replace(point, r"\.?0+\z", "")).otherwise(point)
    return F.when(c == 0, "0").when(small, plain).when(c.isNotNull(), F.regexp_replace(F.format_string("%.5e", c), r"\.?0+(?=e)", ""))


def json_of(v: Value) -> Column:
    """Compact JSON with sorted keys."""
    v = _plain(v)
    if isinstance(v, Const):
        return F.lit(chat.compact(v.value))
    if isinstance(v, Items):
        return F.concat(F.lit("["), F.concat_ws(",", *(json_of(x) for x in v.items)), F.lit("]"))
    if isinstance(v, Fields):
        pairs = [F.concat(F.lit(json.dumps(k, ensure_ascii=False) + ":"), json_of(x)) for k, x in sorted(v.fields.items())]
        return F.concat(F.lit("{"), F.concat_ws(",", *pairs), F.lit("}"))
    if isinstance(v.type, T.ArrayType):
        return F.concat(F.lit("["), F.array_join(F.transform(v.column, lambda x: json_of(Dyn(v.type.elementType, x))), ","), F.lit("]"))
    if isinstance(v.type, T.StructType):
        pairs = [F.when(v.column[f.name].isNotNull(), F.concat(F.lit(json.dumps(f.name, ensure_ascii=False) + ":"), json_of(Dyn(f.dataType, v.column[f.name])))) for f in sorted(v.type.fields, key=lambda f: f.name)]
        return F.coalesce(F.when(v.column.isNotNull(), F.concat(F.lit("{"), F.concat_ws(",", *pairs), F.lit("}"))), F.lit("null"))
    if v.type == STRING:  # as an element, which to_json takes alone
        quoted = F.to_json(F.array(v.column))
        return F.when(v.column.isNull(), "null").otherwise(F.substring(quoted, F.lit(2), F.length(quoted) - 2))
    if isinstance(v.type, (T.MapType, T.VariantType)):
        return F.coalesce(F.to_json(v.column), F.lit("null"))
    return F.coalesce(F.lower(v.column.cast("string")), F.lit("null"))


def truth(v: Value) -> bool | Column:
    """A constant where it is known, else a column that is never null."""
    v = _plain(v)
    if isinstance(v, Const):
        return chat.truth(v.value)
    if isinstance(v, Items):
        return bool(v.items)
    if isinstance(v, Fields):
        return bool(v.fields)
    c = v.column
    if v.type == BOOL:
        found = c
    elif v.type == STRING:
        found = c != ""
    elif isinstance(v.type, (T.ArrayType, T.MapType)):
        found = F.size(c) > 0
    elif isinstance(v.type, T.StructType):
        found = c.isNotNull()
    elif v.type == ANY:
        shown = F.to_json(c)
        found = F.when(_is(c, *_NUMBERS), _get(c, "double") != 0).otherwise(~shown.isin("null", "false", '""', "[]", "{}"))
    else:
        found = c != 0
    return F.coalesce(found, F.lit(False))


def choose(cases: list[tuple[bool | Column, Value]], other: Value) -> Value:
    """The value of the first case that holds."""
    kept: list[tuple[Column, Value]] = []
    for when, value in cases:
        if when is True:
            other = value
            break
        if when is not False:
            kept.append((when, value))
    values = [v for _, v in kept] + [other]
    if not kept or all(v is other for v in values):
        return other
    plain = [_plain(v) for v in values]
    if all(isinstance(v, Const) for v in plain) and all(type(v.value) is type(plain[0].value) and v.value == plain[0].value for v in plain):
        return plain[0]
    opened = [_opened(v) for v in values]
    if all(isinstance(v, Fields) for v in opened):
        keys = {k: None for v in opened for k in v.fields}
        return Fields({k: choose([(w, v.fields.get(k, UNDEFINED)) for (w, _), v in zip(kept, opened)], opened[-1].fields.get(k, UNDEFINED)) for k in keys})
    known = [None if _void(v) else _column(v) for v in plain]
    kind = _common([v.type for v in known if v is not None])
    if kind is None:
        return UNDEFINED
    columns = [_nothing(p, kind) if v is None else _as(v, kind) for p, v in zip(plain, known)]
    out = F.when(kept[0][0], columns[0])
    for (when, _), c in zip(kept[1:], columns[1:]):
        out = out.when(when, c)
    return Dyn(kind, out.otherwise(columns[-1]))


def _common(kinds: list[T.DataType]) -> T.DataType | None:
    if not kinds:
        return None
    if all(k == kinds[0] for k in kinds):
        return kinds[0]
    if all(k in (LONG, DOUBLE) for k in kinds):
        return DOUBLE
    return ANY  # told row by row


def _nothing(v: Const, kind: T.DataType) -> Column:
    """None or undefined as a column; only VARIANT tells them apart."""
    return F.parse_json(F.lit("null")) if kind == ANY and v.value is None else F.lit(None).cast(kind)


def _as(v: Dyn, kind: T.DataType) -> Column:
    if v.type == kind:
        return v.column
    return F.to_variant_object(v.column) if kind == ANY and isinstance(v.type, (T.ArrayType, T.StructType, T.MapType)) else v.column.cast(kind)


def attribute(v: Value, key: Value) -> Value:
    """An entry of a dictionary, or an element of a list."""
    v = _opened(v)
    if isinstance(v, Fields):
        if isinstance(key, Const):
            return v.fields.get(key.value, UNDEFINED) if isinstance(key.value, str) else UNDEFINED
        return choose([(same(key, Const(k)), x) for k, x in v.fields.items()], UNDEFINED)
    if isinstance(v, Items):
        if isinstance(key, Const):
            return v.items[key.value] if isinstance(key.value, int) and -len(v.items) <= key.value < len(v.items) else UNDEFINED
        return attribute(_column(v), key)
    if isinstance(v, Const):
        return UNDEFINED
    if isinstance(v.type, T.StructType):
        if not isinstance(key, Const):
            return choose([(same(key, Const(f.name)), attribute(v, Const(f.name))) for f in v.type.fields], UNDEFINED)
        found = next((f for f in v.type.fields if f.name == key.value), None)
        return UNDEFINED if found is None else _typed(found.dataType, v.column[found.name])
    if isinstance(v.type, T.MapType):
        return _typed(v.type.valueType, F.try_element_at(v.column, _column(key).column))
    if isinstance(v.type, T.ArrayType):
        at = _column(key)
        if at.type != LONG:
            return UNDEFINED
        c = at.column.cast("int")
        return _typed(v.type.elementType, F.try_element_at(v.column, F.when(c < 0, c).otherwise(c + 1)))
    if v.type == ANY and isinstance(key, Const):
        if isinstance(key.value, str):
            mark = "'" if "'" not in key.value else '"'
            if mark in key.value or not key.value:
                raise Uncompilable(f"a key with marks of both kinds, or of nothing: {key.value}")
            return Dyn(ANY, F.when(_is(v.column, "OBJECT"), F.try_variant_get(v.column, f"$[{mark}{key.value}{mark}]", "variant")))
        if isinstance(key.value, int):
            return attribute(_listed(v), key)
    if v.type == ANY:
        raise Uncompilable("an entry of a value of unknown type by a key that is only known with the row")
    return UNDEFINED


def _typed(kind: T.DataType, c: Column) -> Dyn:
    """Columns of Spark's other types as one of the types of this module."""
    if isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType)):
        return Dyn(LONG, c.cast(LONG))
    if isinstance(kind, (T.FloatType, T.DecimalType)):
        return Dyn(DOUBLE, c.cast(DOUBLE))
    if kind in (STRING, LONG, DOUBLE, BOOL, ANY) or isinstance(kind, (T.ArrayType, T.StructType, T.MapType)):
        return Dyn(kind, c)
    return Dyn(STRING, c.cast(STRING))


def _looped(v: Dyn) -> Dyn:
    """What a loop goes over: elements of a list, sorted keys of an object."""
    if v.type != ANY:
        return _listed(v)
    keys = F.array_sort(F.map_keys(F.try_variant_get(v.column, "$", "map<string,variant>")))
    return Dyn(T.ArrayType(ANY), F.when(_is(v.column, "OBJECT"), F.transform(keys, lambda k: k.cast(ANY))).otherwise(_listed(v).column))


def _listed(v: Dyn) -> Dyn:
    """Elements, or sorted keys of what is an object by its type; null of what is no list."""
    if isinstance(v.type, T.ArrayType):
        return v
    if isinstance(v.type, T.MapType):
        return Dyn(T.ArrayType(STRING), F.array_sort(F.map_keys(v.column)))
    if v.type == ANY:
        return Dyn(T.ArrayType(ANY), F.when(_is(v.column, "ARRAY"), F.try_variant_get(v.column, "$", "array<variant>")))
    if isinstance(v.type, T.StructType):
        return Dyn(T.ArrayType(STRING), F.array_compact(F.array(*(F.when(v.column[f.name].isNotNull(), f.name) for f in sorted(v.type.fields, key=lambda f: f.name)))))
    return Dyn(T.ArrayType(STRING), F.lit(None).cast("array<string>"))


def _sign(x: bool | Column) -> Column:
    return F.lit(x) if isinstance(x, bool) else x


def _not(x: bool | Column) -> bool | Column:
    return not x if isinstance(x, bool) else ~x


def _known(x: bool | Column) -> Value:
    return Const(x) if isinstance(x, bool) else Dyn(BOOL, x)


def same(a: Value, b: Value) -> bool | Column:
    a, b = _plain(a), _plain(b)
    if isinstance(a, Const) and isinstance(b, Const):
        return chat._same(a.value, b.value)
    if isinstance(a, Const):
        a, b = b, a
    if _void(b):
        if not isinstance(a, Dyn):
            return False
        return F.coalesce(F.is_variant_null(a.column), F.lit(False)) if a.type == ANY and b.value is None else a.column.isNull()
    if isinstance(a, (Items, Fields)) or isinstance(b, (Items, Fields)) or isinstance(b, Const) and isinstance(b.value, (list, dict)):
        return json_of(a) == json_of(b)
    b = _column(b)
    if a.type == b.type and a.type != ANY and not isinstance(a.type, (T.MapType, T.ArrayType, T.StructType)):
        return F.coalesce(a.column == b.column, F.lit(False))
    if {a.type, b.type} == {LONG, DOUBLE}:
        return F.coalesce(a.column.cast("double") == b.column.cast("double"), F.lit(False))
    if ANY in (a.type, b.type):
        a, b = (a, b) if a.type == ANY else (b, a)
        if b.type == STRING:
            return F.coalesce(_is(a.column, "STRING") & (_get(a.column, "string") == b.column), F.lit(False))
        if b.type in (LONG, DOUBLE):
            return F.coalesce(_is(a.column, *_NUMBERS) & (_get(a.column, "double") == b.column.cast("double")), F.lit(False))
        if b.type == BOOL:
            return F.coalesce(_is(a.column, "BOOLEAN") & (_get(a.column, "boolean") == b.column), F.lit(False))
        return F.coalesce(json_of(a) == json_of(b), F.lit(False))
    return F.coalesce(json_of(a) == json_of(b), F.lit(False)) if type(a.type) is type(b.type) else False


def _number(v: Value) -> Dyn | None:
    v = _column(v)
    return v if v.type in (LONG, DOUBLE) else Dyn(DOUBLE, F.when(_is(v.column, *_NUMBERS), _get(v.column, "double"))) if v.type == ANY else None


def _string(v: Value) -> Dyn | None:
    """A string; null where a VARIANT holds none."""
    v = _column(v)
    return v if v.type == STRING else Dyn(STRING, F.when(_is(v.column, "STRING"), _get(v.column, "string"))) if v.type == ANY else None


def operate(sign: str, a: Value, b: Value) -> Value:
    a, b = _plain(a), _plain(b)
    if isinstance(a, Const) and isinstance(b, Const):
        return Const(chat._binary(sign, a.value, b.value))
    if sign in ("==", "!="):
        found = same(a, b)
        return _known(found if sign == "==" else _not(found))
    if sign == "~":
        return Dyn(STRING, F.concat(text(a), text(b)))
    numeric = lambda v: isinstance(v, Const) and isinstance(v.value, (int, float)) and not isinstance(v.value, bool) or isinstance(v, Dyn) and v.type in (LONG, DOUBLE)
    if sign == "+" and not (numeric(a) and numeric(b)):
        lists = [isinstance(v, Items) or isinstance(v, Const) and isinstance(v.value, list) or isinstance(v, Dyn) and isinstance(v.type, T.ArrayType) for v in (a, b)]
        if all(lists):
            x, y = _opened(a), _opened(b)
            if isinstance(x, Items) and isinstance(y, Items):
                return Items(x.items + y.items)
            x, y = _column(a), _column(b)
            return Dyn(_common([x.type, y.type]), F.concat(x.column, y.column))
        if all(isinstance(v, Dyn) and v.type == ANY or numeric(v) for v in (a, b)):
            raise Uncompilable("a sum of values of unknown type")
        return Dyn(STRING, F.concat(text(a), text(b)))
    if sign in ("<", ">", "<=", ">="):
        compared = [{"<": x < y, ">": x > y, "<=": x <= y, ">=": x >= y}[sign] for x, y in ((_string(a), _string(b)), (_number(a), _number(b))) if x is not None and y is not None for x, y in ((x.column, y.column),)]
        return Dyn(BOOL, F.coalesce(*compared, F.lit(False))) if compared else Const(False)
    x, y = _number(a), _number(b)
    if x is None or y is None:
        raise Uncompilable(f"{sign} needs numbers")
    kind = LONG if x.type == y.type == LONG and sign not in ("/", "**") else DOUBLE
    p, q = x.column.cast(kind), y.column.cast(kind)
    if sign in ("+", "-", "*"):
        return Dyn(kind, {"+": p + q, "-": p - q, "*": p * q}[sign])
    if sign == "**":
        return Dyn(DOUBLE, F.pow(p, q))
    divided = {"/": lambda: p / q, "//": lambda: (x.column.cast("double") / y.column.cast("double")).cast(LONG), "%": lambda: p % q}[sign]()
    return Dyn(LONG if sign == "//" else kind, F.when(q != 0, divided).otherwise(F.raise_error(F.lit("division by zero")).cast(LONG if sign == "//" else kind)))


def contains(needle: Value, hay: Value) -> bool | Column:
    needle, hay = _plain(needle), _plain(hay)
    if isinstance(needle, Const) and isinstance(hay, Const):
        return chat._binary("in", needle.value, hay.value)
    opened = _opened(hay)
    if isinstance(opened, (Items, Fields)):
        found: bool | Column = False
        for x in opened.items if isinstance(opened, Items) else map(Const, opened.fields):
            one = same(needle, x)
            if one is True:
                return True
            found = found if one is False else one if found is False else found | one
        return found
    part = None if isinstance(needle, (Items, Fields)) or isinstance(needle, Const) and not isinstance(needle.value, str) else _string(needle)
    within = lambda c: F.lit(False) if part is None else F.contains(c, part.column)
    if isinstance(hay, Const):
        return F.coalesce(within(F.lit(hay.value)), F.lit(False)) if isinstance(hay.value, str) else False
    if hay.type == STRING:
        return F.coalesce(within(hay.column), F.lit(False))
    if hay.type == ANY:
        inside = F.exists(_listed(hay).column, lambda x: _sign(same(needle, Dyn(ANY, x))))
        keyed = isinstance(needle, Const) and isinstance(needle.value, str)
        return F.coalesce(F.when(_is(hay.column, "STRING"), within(_get(hay.column, "string"))).when(_is(hay.column, "OBJECT"), attribute(hay, needle).column.isNotNull() if keyed else F.lit(False)).otherwise(inside), F.lit(False))
    items = _listed(hay)
    return F.coalesce(F.exists(items.column, lambda x: _sign(same(needle, _typed(items.type.elementType, x)))), F.lit(False))


def tested(name: str, v: Value) -> bool | Column:
    v = _plain(v)
    if isinstance(v, Const):
        return chat.TESTS[name](v.value)
    if isinstance(v, (Items, Fields)):
        return chat.TESTS[name]([] if isinstance(v, Items) else {})
    c, some = v.column, v.column.isNotNull()
    if name in ("defined", "undefined"):
        return some if name == "defined" else ~some
    if name in ("callable", "eq", "ne", "equalto"):
        return False
    if v.type == ANY:
        of = {"none": ("VOID",), "boolean": ("BOOLEAN",), "string": ("STRING",), "number": _NUMBERS, "integer": ("BIGINT", "INT", "SMALLINT", "TINYINT"), "float": ("DOUBLE", "DECIMAL", "FLOAT"), "mapping": ("OBJECT",), "iterable": ("ARRAY", "OBJECT", "STRING"), "sequence": ("ARRAY", "STRING")}
        if name in of:
            return _is(c, *of[name])
        if name in ("true", "false"):
            return F.coalesce(_is(c, "BOOLEAN") & (_get(c, "boolean") == (name == "true")), F.lit(False))
        return F.coalesce(_is(c, "BIGINT") & (F.pmod(_get(c, "long"), F.lit(2)) == int(name == "odd")), F.lit(False))
    if name == "none":
        return ~some
    if name in ("true", "false"):
        return F.coalesce(c == (name == "true"), F.lit(False)) if v.type == BOOL else False
    if name in ("even", "odd"):
        return F.coalesce(F.pmod(c, F.lit(2)) == int(name == "odd"), F.lit(False)) if v.type == LONG else False
    kinds = {"boolean": v.type == BOOL, "string": v.type == STRING, "number": v.type in (LONG, DOUBLE), "integer": v.type == LONG, "float": v.type == DOUBLE, "mapping": isinstance(v.type, (T.StructType, T.MapType)),
             "iterable": v.type == STRING or isinstance(v.type, (T.ArrayType, T.StructType, T.MapType)), "sequence": v.type == STRING or isinstance(v.type, T.ArrayType)}
    return some if kinds[name] else False


# filters and methods of what isn't a constant
def _ascii(v: Value, old: str, new: str) -> Dyn:
    return Dyn(STRING, F.translate(text(v), old, new))


def _title(v: Value) -> Dyn:
    capital = F.transform(F.regexp_extract_all(_ascii(v, UPPER, LOWER).column, F.lit("[a-z]+|[^a-z]+"), F.lit(0)), lambda w: F.concat(F.translate(F.substring(w, 1, 1), LOWER, UPPER), F.substring(w, 2, 1 << 30)))
    return Dyn(STRING, F.array_join(capital, ""))


def _sized(v: Value) -> Dyn:
    v = _column(v)
    if v.type == STRING:
        n = F.octet_length(v.column)
    elif v.type == ANY:
        n = F.when(_is(v.column, "STRING"), F.octet_length(_get(v.column, "string"))).when(_is(v.column, "OBJECT"), F.size(F.try_variant_get(v.column, "$", "map<string,variant>"))).otherwise(F.size(_listed(v).column))
    elif isinstance(v.type, (T.ArrayType, T.MapType, T.StructType)):
        n = F.size(_listed(v).column)
    else:
        return _lit(0)
    return Dyn(LONG, F.coalesce(F.when(n >= 0, n), F.lit(0)).cast(LONG))


def _list_of(v: Value) -> Dyn:
    v = _column(v)
    return _listed(v) if v.type == ANY or isinstance(v.type, T.ArrayType) else Dyn(T.ArrayType(STRING), F.lit(None).cast("array<string>"))


def _mapped(v: Value, f: Callable[[Value], Value]) -> Value:
    opened = _opened(v)
    if isinstance(opened, Items):
        return Items([f(x) for x in opened.items])
    items = _list_of(v)
    kinds: list[T.DataType] = []

    def one(x: Column) -> Column:
        found = _column(f(_typed(items.type.elementType, x)))
        kinds.append(found.type)
        return found.column

    made = F.transform(items.column, one)
    return Dyn(T.ArrayType(kinds[0]), made)


def _joined(v: Value, sep: Value = Const(""), *_: Value) -> Dyn:
    opened = _opened(v)
    if isinstance(opened, Items):
        parts = [p for x in opened.items for p in (text(sep), text(x))][1:]
        return Dyn(STRING, F.concat(*parts) if parts else F.lit(""))
    items = _list_of(v)
    found = F.transform(items.column, lambda x: text(_typed(items.type.elementType, x)))
    if isinstance(sep, Const):
        out = F.array_join(found, chat.text_of(sep.value))
    else:
        out = F.array_join(F.transform(found, lambda x, i: F.when(i == 0, x).otherwise(F.concat(text(sep), x))), "")
    return Dyn(STRING, F.coalesce(out, text(v) if _column(v).type in (STRING, ANY) else F.lit("")))


def _replaced(v: Value, old: Value, new: Value, *_: Value) -> Dyn:
    return Dyn(STRING, F.when(text(old) != "", F.replace(text(v), text(old), text(new))).otherwise(F.raise_error(F.lit("replace needs something to replace")).cast("string")))


def _pairs(v: Value, folded: bool = False) -> Value:
    opened = _opened(v)
    if isinstance(opened, Fields):
        order = sorted(opened.fields, key=(lambda k: (k.lower(), k)) if folded else None)
        return Items([Items([Const(k), opened.fields[k]]) for k in order])
    v = _column(v)
    if isinstance(v.type, T.StructType):
        return _pairs(Fields({f.name: attribute(v, Const(f.name)) for f in v.type.fields}), folded)
    entries = v.column if isinstance(v.type, T.MapType) else F.try_variant_get(v.column, "$", "map<string,variant>")
    value = v.type.valueType if isinstance(v.type, T.MapType) else ANY
    order = lambda k: F.struct((F.translate(k, UPPER, LOWER) if folded else k).alias("order"), k.alias("key"))
    keys = F.array_sort(F.transform(F.map_keys(entries), order))
    pairs = F.transform(keys, lambda k: F.struct(k["key"].alias("key"), F.try_element_at(entries, k["key"]).alias("value")))
    return Dyn(T.ArrayType(T.StructType([T.StructField("key", STRING), T.StructField("value", value)])), pairs)


def _split(v: Value, sep: Value = Const(" "), *_: Value) -> Dyn:
    if not isinstance(sep, Const) or not isinstance(sep.value, str) or not sep.value:
        raise Uncompilable("split needs a constant separator")
    return Dyn(T.ArrayType(STRING), F.split(text(v), r"\Q" + sep.value.replace(r"\E", r"\E\\E\Q") + r"\E", -1))


def _trimmed(f: Callable[[Column, Column], Column]) -> Callable[..., Dyn]:
    return lambda v, chars=Const(chat.BLANKS), *_: Dyn(STRING, f(text(v), text(chars)))


def _as_number(kind: T.DataType) -> Callable[..., Dyn]:
    def convert(v: Value, *_: Value) -> Dyn:
        shown = text(v)
        return Dyn(kind, F.when(shown.rlike(r"\A-?[0-9]+(\.[0-9]+)?\z"), shown.cast("double").cast(kind)).otherwise(F.lit(0).cast(kind)))

    return convert


def _part(v: Value, at: int) -> Value:
    opened = _opened(v)
    return attribute(opened if isinstance(opened, Items) else _list_of(v), Const(at))


def _default(v: Value, other: Value = Const(""), *_: Value) -> Value:
    v = _plain(v)
    if isinstance(v, Const):
        return other if _void(v) else v
    if not isinstance(v, Dyn):
        return v
    gone = v.column.isNull() | F.is_variant_null(v.column) if v.type == ANY else v.column.isNull()
    return choose([(gone, other)], v)


def _batched(v: Value, n: Value, *_: Value) -> Value:
    if not isinstance(n, Const) or not isinstance(n.value, int) or n.value <= 0:
        raise Uncompilable("batch needs a constant positive size")
    items = _list_of(v)
    starts = F.when(F.size(items.column) > 0, F.sequence(F.lit(1), F.size(items.column), F.lit(n.value))).otherwise(F.array().cast("array<int>"))
    return Dyn(T.ArrayType(items.type), F.transform(starts, lambda s: F.slice(items.column, s, n.value)))


FILTERS: dict[str, Callable[..., Value]] = {
    "trim": lambda v, *a: Dyn(STRING, F.btrim(text(v), F.lit(chat.BLANKS))), "length": lambda v, *a: _sized(v), "count": lambda v, *a: _sized(v), "default": _default, "d": _default,
    "first": lambda v, *a: _part(v, 0), "last": lambda v, *a: _part(v, -1), "upper": lambda v, *a: _ascii(v, LOWER, UPPER), "lower": lambda v, *a: _ascii(v, UPPER, LOWER), "title": lambda v, *a: _title(v),
    "join": _joined, "list": lambda v, *a: _list_of(v) if not isinstance(v, Dyn) or v.type == ANY or isinstance(v.type, T.ArrayType) else _listed(v), "int": _as_number(LONG), "float": _as_number(DOUBLE),
    "string": lambda v, *a: Dyn(STRING, text(v)), "tojson": lambda v, *a: Dyn(STRING, json_of(v)), "replace": _replaced, "batch": _batched,
    "reverse": lambda v, *a: Items(_opened(v).items[::-1]) if isinstance(_opened(v), Items) else Dyn(_list_of(v).type, F.reverse(_list_of(v).column)),
    "dictsort": lambda v, case=Const(False), *a: _pairs(v, truth(case) is not True), "items": lambda v, *a: _pairs(v),
}
METHODS: dict[str, Callable[..., Value]] = {
    "upper": lambda v: _ascii(v, LOWER, UPPER), "lower": lambda v: _ascii(v, UPPER, LOWER), "strip": _trimmed(F.btrim), "lstrip": _trimmed(F.ltrim), "rstrip": _trimmed(F.rtrim), "split": _split, "replace": _replaced,
    "startswith": lambda v, p: Dyn(BOOL, F.startswith(text(v), text(p))), "endswith": lambda v, p: Dyn(BOOL, F.endswith(text(v), text(p))),
}
DICT_METHODS: dict[str, Callable[..., Value]] = {
    "items": _pairs, "keys": lambda v: Items([Const(k) for k in sorted(_opened(v).fields)]) if isinstance(_opened(v), Fields) else _looped(_column(v)),
    "values": lambda v: _mapped(_pairs(v), lambda p: attribute(p, Const(1)) if isinstance(p, Items) else attribute(p, Const("value"))), "get": lambda v, k, e=Const(None): _default(attribute(v, k), e),
}


class _Scopes:
    """Names and macros; copied before each branch."""

    def __init__(self, scopes: list[dict[str, Value]], macros: dict):
        self.scopes, self.macros, self.depth = scopes, macros, 0

    def get(self, name: str) -> Value:
        return next((s[name] for s in reversed(self.scopes) if name in s), UNDEFINED)

    def copy(self) -> _Scopes:
        made: dict[int, Fields] = {}

        def twin(v: Value) -> Value:  # names that share a namespace go on sharing it
            if isinstance(v, Fields):
                if id(v) not in made:
                    made[id(v)] = Fields({k: twin(x) for k, x in v.fields.items()})
                return made[id(v)]
            return v

        new = _Scopes([{n: twin(v) for n, v in s.items()} for s in self.scopes], dict(self.macros))
        new.depth = self.depth
        return new

    def become(self, other: _Scopes) -> None:
        self.scopes, self.macros = other.scopes, other.macros

    def assign(self, name: str, attribute_: str, value: Value) -> None:
        if not attribute_:
            self.scopes[-1][name] = value
            return
        target = _opened(self.get(name))
        if not isinstance(target, Fields):
            raise Uncompilable(f"{name} has no attributes to set")
        if target is not self.get(name):  # a constant one: every name of it
            for s in self.scopes:
                if name in s:
                    s[name] = target
        target.fields[attribute_] = value


def _walk(node, macros: dict, seen: frozenset = frozenset()):
    """All tuples within a node, and within the macros that it calls."""
    if isinstance(node, tuple):
        yield node
        if len(node) == 4 and node[0] == "call" and node[1] in macros and node[1] not in seen:
            yield from _walk(list(macros[node[1]][1]), macros, seen | {node[1]})
    for part in node.values() if isinstance(node, dict) else node if isinstance(node, (tuple, list)) else ():
        yield from _walk(part, macros, seen)


def _mentions(node, name: str, macros: dict) -> bool:
    return any(n == ("name", name) for n in _walk(node, macros))


def _set_before(body: list[Node], name: str, macros: dict) -> str:
    """How a name that the body sets is first met in a turn: "set", "read" or "maybe" set (in some branches only)."""
    state = "none"
    for node in body:
        kind = node[0]
        if kind in ("set", "capture") and node[1:3] == (name, ""):
            return "read" if _mentions(node[3], name, macros) else "set"
        if kind == "if":
            if any(when is not None and _mentions(when, name, macros) for when, _ in node[1]):
                return "read"
            ways = [_set_before(branch, name, macros) for _, branch in node[1]] + ([] if node[1][-1][0] is None else ["none"])
            if "read" in ways:
                return "read"
            if all(w == "set" for w in ways):
                return "set"
            if state == "maybe" or any(w != "none" for w in ways):
                state = "maybe"
        elif _mentions(node, name, macros):
            return "read"
    return state


def _carried(body: list[Node], macros: dict) -> list[tuple[str, str]]:
    """(name, attribute) of what a turn leaves to the next one: attributes, and names that may be read before they are set."""
    own: dict[tuple[str, str], None] = {}

    def look(nodes: list[Node]) -> None:
        for node in nodes:
            if node[0] in ("set", "capture") and not node[2]:
                own[node[1], ""] = None
            if node[0] == "if":  # loops within have names of their own
                for _, branch in node[1]:
                    look(branch)
            if node[0] == "capture":
                look(node[3])

    look(body)
    found = {(n, ""): None for n, _ in own if _set_before(body, n, macros) == "read" or _set_before(body, n, macros) == "maybe" and _mentions(body, n, macros)}
    return list(found | {(n[1], n[2]): None for n in _walk(body, macros) if n[0] in ("set", "capture") and len(n) == 4 and n[2]})


def _loop_parts(node) -> set[str]:
    """The attributes of `loop` that are used; "" if it is used as a whole."""
    if isinstance(node, (tuple, list)):
        if len(node) > 2 and node[0] == "attr" and node[1] == ("name", "loop"):
            return {node[2]}
        if len(node) > 2 and node[0] == "item" and node[1] == ("name", "loop") and node[2][0] == "const":
            return {node[2][1]}
        if len(node) == 2 and node[0] == "name" and node[1] == "loop":
            return {""}
        return set().union(*(_loop_parts(x) for x in node)) if node else set()
    return set().union(*(_loop_parts(x) for x in node.values())) if isinstance(node, dict) and node else set()


class Compiler:
    def __init__(self, names: dict[str, Value]):
        self.s = _Scopes([names], {})

    # expressions
    def value(self, node: Node | None) -> Value:
        return UNDEFINED if node is None else getattr(self, "_" + node[0])(*node[1:])

    def _const(self, v) -> Value:
        return Const(v)

    def _name(self, n: str) -> Value:
        return self.s.get(n)

    def _attr(self, a: Node, n: str) -> Value:
        return attribute(self.value(a), Const(n))

    def _item(self, a: Node, k: Node) -> Value:
        return attribute(self.value(a), _plain(self.value(k)))

    def _slice(self, a: Node, start: Node | None, stop: Node | None, step: Node | None) -> Value:
        v, bounds = _opened(self.value(a)), [None if x is None else _plain(self.value(x)) for x in (start, stop, step)]
        if isinstance(v, Items) and all(b is None or isinstance(b, Const) for b in bounds):
            return Items(v.items[slice(*(None if b is None else b.value for b in bounds))])
        if isinstance(v, Items):
            v = _column(v)
        if not isinstance(v, Dyn) or not (v.type == ANY or isinstance(v.type, T.ArrayType)):
            return UNDEFINED
        v = _listed(v)
        by = 1 if bounds[2] is None else bounds[2].value if isinstance(bounds[2], Const) else None
        if not isinstance(by, int) or not by:
            raise Uncompilable("a slice needs a constant step")
        n = F.size(v.column)
        at = [None if b is None else _column(b).column.cast("int") for b in bounds[:2]]
        low, high = (0, n) if by > 0 else (-1, n - 1)
        clamp = lambda c: F.greatest(F.lit(low), F.least(n if by > 0 else n - 1, F.when(c < 0, c + n).otherwise(c)))
        first = (F.lit(0) if by > 0 else n - 1) if at[0] is None else clamp(at[0])
        last = (n if by > 0 else F.lit(-1)) if at[1] is None else clamp(at[1])
        if by == 1:
            return Dyn(v.type, F.slice(v.column, first + 1, F.greatest(F.lit(0), last - first)))
        if by == -1 and at == [None, None]:
            return Dyn(v.type, F.reverse(v.column))
        kept = F.filter(v.column, lambda x, i: ((i >= first) & (i < last) & ((i - first) % by == 0)) if by > 0 else ((i <= first) & (i > last) & ((first - i) % -by == 0)))
        return Dyn(v.type, kept if by > 0 else F.reverse(kept))

    def _call(self, name: str, args: list[Node], named: dict[str, Node]) -> Value:
        values, keys = [_plain(self.value(x)) for x in args], {k: self.value(x) for k, x in named.items()}
        if name == "raise_exception":
            return Dyn(STRING, F.raise_error(text(values[0]) if values else F.lit("")).cast("string"))
        if name in ("namespace", "dict"):
            return Fields(keys)
        if name == "range":
            if all(isinstance(v, Const) for v in values):
                if len(values) > 2 and not values[2].value:
                    raise TemplateError("range needs a step")
                return Items([Const(i) for i in range(*(v.value for v in values))])
            if len(values) > 2:
                raise Uncompilable("range with a step needs constants")
            first, end = ([F.lit(0)] + [_column(v).column for v in values])[-2:]
            return Dyn(T.ArrayType(LONG), F.when(end > first, F.sequence(first.cast(LONG), (end - 1).cast(LONG))).otherwise(F.array().cast("array<bigint>")))
        if name not in self.s.macros:
            raise TemplateError(f"unknown function {name}")
        if self.s.depth >= chat.DEPTH:
            raise Uncompilable("macro recursion too deep, or its end depends on the messages")
        parameters, body = self.s.macros[name]
        scope: dict[str, Value] = {}
        for i, (parameter, default) in enumerate(parameters):
            scope[parameter] = values[i] if i < len(values) else keys[parameter] if parameter in keys else self.value(default)
        self.s.scopes.append(scope)
        self.s.depth += 1
        try:
            return self.text(body)
        finally:
            self.s.depth -= 1
            self.s.scopes.pop()

    def _method(self, a: Node, key: str, args: list[Node], named: dict) -> Value:
        v, values = _plain(self.value(a)), [_plain(self.value(x)) for x in args]
        strings = isinstance(v, Const) and isinstance(v.value, str) or isinstance(v, Dyn) and v.type == STRING
        if isinstance(v, Const) and all(isinstance(x, Const) for x in values):
            known = chat.METHODS if strings else chat.DICT_METHODS if isinstance(v.value, dict) else {}
            if key in known:
                return Const(known[key](v.value, *(x.value for x in values)))
        known = METHODS if strings else DICT_METHODS if isinstance(_opened(v), Fields) or isinstance(v, Dyn) and isinstance(v.type, (T.StructType, T.MapType)) else {}
        if isinstance(v, Dyn) and v.type == ANY:  # told by the method
            if key in METHODS:
                checked = F.when(_is(v.column, "STRING"), _get(v.column, "string")).otherwise(F.raise_error(F.lit(f"no method {key}")).cast("string"))
                return METHODS[key](Dyn(STRING, checked), *values)
            known = DICT_METHODS
        if key not in known:
            raise TemplateError(f"no method {key}")
        return known[key](v, *values)

    def _filter(self, a: Node, name: str, args: list[Node], named: dict[str, Node]) -> Value:
        v, given = _plain(self.value(a)), [_plain(self.value(x)) for x in args]
        if name == "map":
            if "attribute" in named:
                key = _plain(self.value(named["attribute"]))
                return _mapped(v, lambda x: attribute(x, key))
            which = given[0].value if isinstance(given[0], Const) else None
            return _mapped(v, lambda x: self.filtered(x, which, [])) if which in FILTERS else v
        if name == "selectattr":
            wanted = [lambda x: truth(attribute(x, given[0]))] if len(given) < 3 else [lambda x: same(attribute(x, given[0]), given[2]) if given[1] != Const("ne") else _not(same(attribute(x, given[0]), given[2]))]
            opened = _opened(v)
            if isinstance(opened, Items):
                found = [(x, wanted[0](x)) for x in opened.items]
                if all(isinstance(w, bool) for _, w in found):
                    return Items([x for x, w in found if w])
                raise Uncompilable("selectattr over a written list of values that aren't known")
            items = _list_of(v)
            return Dyn(items.type, F.filter(items.column, lambda x: _sign(wanted[0](_typed(items.type.elementType, x)))))
        return self.filtered(v, name, given)

    def filtered(self, v: Value, name: str, given: list[Value]) -> Value:
        if name not in FILTERS:
            return v  # names that the dialect doesn't know pass values through
        if isinstance(v, Const) and all(isinstance(x, Const) for x in given):
            return Const(chat.FILTERS[name](v.value, *(x.value for x in given)))
        return FILTERS[name](v, *given)

    def _test(self, a: Node, name: str, negated: bool) -> Value:
        found = tested(name, self.value(a))
        return _known(_not(found) if negated else found)

    def _not(self, a: Node) -> Value:
        return _known(_not(truth(self.value(a))))

    def _neg(self, a: Node) -> Value:
        v = _plain(self.value(a))
        if isinstance(v, Const):
            return Const(-v.value)
        n = _number(v)
        if n is None:
            raise Uncompilable("- needs a number")
        return Dyn(n.type, -n.column)

    def _and(self, a: Node, b: Node) -> Value:
        v = self.value(a)
        holds = truth(v)
        return v if holds is False else choose([(holds, self.value(b))], v)

    def _or(self, a: Node, b: Node) -> Value:
        v = self.value(a)
        holds = truth(v)
        return v if holds is True else choose([(holds, v)], self.value(b))

    def _op(self, sign: str, a: Node, b: Node) -> Value:
        return operate(sign, self.value(a), self.value(b))

    def _in(self, a: Node, b: Node, negated: bool) -> Value:
        found = contains(self.value(a), self.value(b))
        return _known(_not(found) if negated else found)

    def _choose(self, value: Node, when: Node, other: Node | None) -> Value:
        holds = truth(self.value(when))
        if isinstance(holds, bool):
            return self.value(value if holds else other)
        return choose([(holds, self.value(value))], self.value(other))

    def _list(self, items: list[Node]) -> Value:
        return Items([self.value(x) for x in items])

    def _dict(self, pairs: list[tuple[Node, Node]]) -> Value:
        out: dict[str, Value] = {}
        for k, v in pairs:
            key = _plain(self.value(k))
            if not isinstance(key, Const):
                raise Uncompilable("a dictionary needs constant keys")
            out[chat.text_of(key.value)] = self.value(v)
        return Fields(out)

    # statements
    def text(self, body: list[Node]) -> Value:
        """What a body prints: a constant if it is known."""
        parts: list[Value] = []
        for node in body:
            parts += self.statement(node)
        merged: list[Value] = []
        for p in parts:  # constants that follow each other are one
            if merged and isinstance(p, Const) and isinstance(merged[-1], Const):
                merged[-1] = Const(merged[-1].value + p.value)
            elif p != Const(""):
                merged.append(p)
        if not merged:
            return Const("")
        return merged[0] if len(merged) == 1 else Dyn(STRING, F.concat(*(text(p) for p in merged)))

    def statement(self, node: Node) -> list[Value]:
        kind = node[0]
        if kind == "text":
            return [Const(node[1])]
        if kind == "out":
            v = _plain(self.value(node[1]))
            return [Const(chat.text_of(v.value)) if isinstance(v, Const) else Dyn(STRING, text(v))]
        if kind == "macro":
            self.s.macros[node[1]] = node[2:]
            return []
        if kind in ("set", "capture"):
            self.s.assign(node[1], node[2], self.value(node[3]) if kind == "set" else self.text(node[3]))
            return []
        if kind == "if":
            return [self.branches(node[1])]
        return self.loop(*node[1:])

    def branches(self, branches: list[tuple[Node | None, list[Node]]]) -> Value:
        """The text of the first branch that holds; names become what it leaves."""
        before, cases, ends = self.s, [], []
        for when, body in [*branches, (None, [])]:
            holds = True if when is None else truth(self.value(when))
            if holds is False:
                continue
            self.s = before.copy()
            cases.append((holds, self.text(body)))
            ends.append(self.s)
            self.s = before
            if holds is True:
                break
        if len(cases) == 1:
            before.become(ends[0])
            return cases[0][1]
        merged = ends[-1].copy()
        for level, scope in enumerate(merged.scopes):
            for name in {n: None for e in ends for n in e.scopes[level]}:
                values = [e.scopes[level].get(name, UNDEFINED) for e in ends]
                if not (isinstance(values[0], (Dyn, Const)) and all(v is values[0] for v in values)):
                    scope[name] = choose(list(zip([c for c, _ in cases[:-1]], values)), values[-1])
        merged.macros = {k: v for e in ends for k, v in e.macros.items()}
        before.become(merged)
        return choose(cases[:-1], cases[-1][1])

    def loop(self, names: list[str], source: Node, body: list[Node]) -> list[Value]:
        v = _opened(self.value(source))
        if isinstance(v, Fields):
            v = Items([Const(k) for k in sorted(v.fields)])
        if isinstance(v, Const):
            return []  # texts, numbers and what is undefined have no turns
        if isinstance(v, Items):
            return self.unrolled(names, v.items, body)
        items = _looped(v)
        used = _loop_parts(body)
        carried = [(n, a) for n, a in _carried(body, self.s.macros) if not a or isinstance(_opened(self.s.get(n)), Fields)]
        return self.carried(names, items, body, used, carried) if carried else self.mapped(names, items, body, used)

    def bind(self, names: list[str], item: Value, loop: dict[str, Value]) -> None:
        scope = self.s.scopes[-1]
        if len(names) == 1:
            scope[names[0]] = item
        else:
            pair = isinstance(item, Dyn) and isinstance(item.type, T.StructType) and [f.name for f in item.type.fields] == ["key", "value"]  # of items
            for k, name in enumerate(names):
                scope[name] = attribute(item, Const(["key", "value"][k])) if pair and k < 2 else attribute(item, Const(k))
        scope["loop"] = Fields(loop)

    def unrolled(self, names: list[str], items: list[Value], body: list[Node]) -> list[Value]:
        out: list[Value] = []
        n = len(items)
        self.s.scopes.append({})
        try:
            for i, item in enumerate(items):
                loop = {"index": i + 1, "index0": i, "first": i == 0, "last": i == n - 1, "length": n, "revindex": n - i, "revindex0": n - i - 1}
                around = {k: items[j] for k, j in (("previtem", i - 1), ("nextitem", i + 1)) if 0 <= j < n}
                self.bind(names, item, {k: Const(x) for k, x in loop.items()} | around)
                out.append(self.text(body))
        finally:
            self.s.scopes.pop()
        return out

    def turns(self, items: Dyn, used: set[str]) -> tuple[Column, Callable[[Column], tuple[Value, dict[str, Value]]]]:
        """The elements with what `loop` needs beside each, and how to read one of them."""
        kind, whole = items.type.elementType, "" in used
        rows = F.transform(items.column, lambda x, i: F.struct(x.alias("x"), i.alias("i")))
        beside: list[tuple[str, Column]] = []
        if whole or used & {"last", "length", "revindex", "revindex0"}:  # once for all elements
            beside.append(("n", F.array_repeat(F.size(items.column), F.size(items.column))))
        if whole or "previtem" in used:
            beside.append(("before", F.concat(F.array(F.lit(None).cast(kind)), F.slice(items.column, 1, F.greatest(F.size(items.column) - 1, F.lit(0))))))
        if whole or "nextitem" in used:
            beside.append(("after", F.concat(F.slice(items.column, 2, F.greatest(F.size(items.column) - 1, F.lit(0))), F.array(F.lit(None).cast(kind)))))
        held = ["x", "i"]

        def with_one_more(rows: Column, column: Column, held: list[str], name: str) -> Column:
            return F.zip_with(rows, column, lambda r, c: F.when(r.isNotNull(), F.struct(*(r[h].alias(h) for h in held), c.alias(name))))

        for name, column in beside:
            rows = with_one_more(rows, column, held, name)
            held = [*held, name]
        if beside:  # an empty list has a neighbour beside it, but no turn
            rows = F.filter(rows, lambda r: r.isNotNull())

        def read(r: Column) -> tuple[Value, dict[str, Value]]:
            i = r["i"]
            loop: dict[str, Value] = {"index": Dyn(LONG, (i + 1).cast(LONG)), "index0": Dyn(LONG, i.cast(LONG)), "first": Dyn(BOOL, i == 0)}
            if "n" in held:
                n = r["n"]
                loop |= {"last": Dyn(BOOL, i == n - 1), "length": Dyn(LONG, n.cast(LONG)), "revindex": Dyn(LONG, (n - i).cast(LONG)), "revindex0": Dyn(LONG, (n - i - 1).cast(LONG))}
            loop |= {k: _typed(kind, r[c]) for k, c in (("previtem", "before"), ("nextitem", "after")) if c in held}
            return _typed(kind, r["x"]), loop

        return rows, read

    def mapped(self, names: list[str], items: Dyn, body: list[Node], used: set[str]) -> list[Value]:
        """Turns that don't depend on each other."""
        outside = self.s
        if not used:
            rows, read = items.column, lambda x: (_typed(items.type.elementType, x), {})
        else:
            rows, read = self.turns(items, used)

        def turn(r: Column) -> Column:
            self.s = outside.copy()
            self.s.scopes.append({})
            self.bind(names, *read(r))
            out = text(self.text(body))
            self.s = outside
            return out

        return [Dyn(STRING, F.coalesce(F.array_join(F.transform(rows, turn), ""), F.lit("")))]

    def carried(self, names: list[str], items: Dyn, body: list[Node], used: set[str], keys: list[tuple[str, str]]) -> list[Value]:
        """Turns that see what earlier ones have set: the accumulator has the text and a field for each of the names."""
        outside = self.s
        rows, read = self.turns(items, used)

        def of(scopes: _Scopes, name: str, attribute_: str) -> Value:
            if not attribute_:
                return scopes.scopes[-1].get(name, UNDEFINED)
            target = _opened(scopes.get(name))
            return target.fields.get(attribute_, UNDEFINED) if isinstance(target, Fields) else UNDEFINED

        def begin() -> _Scopes:
            s = outside.copy()
            s.scopes.append({})
            return s

        # a name that isn't set before the loop begins as undefined, seen through to that of an outer scope
        first = begin()
        start = [of(first, n, a) if a else first.get(n) for n, a in keys]
        kinds = [None if _void(v) else _column(v).type for v in start]
        for _ in range(SETTLE):
            seen: list[list[T.DataType | None]] = []

            def merge(acc: Column, r: Column) -> Column:
                self.s = begin()
                for k, ((n, a), kind) in enumerate(zip(keys, kinds)):
                    self.s.assign(n, a, UNDEFINED if kind is None else Dyn(kind, acc[f"v{k}"]))
                self.bind(names, *read(r))
                out = self.text(body)
                after = [_plain(of(self.s, n, a)) for n, a in keys]
                self.s = outside
                known = [None if _void(v) else _column(v) for v in after]
                seen.append([_common([x for x in (kind, v and v.type) if x is not None]) for kind, v in zip(kinds, known)])
                fields = [(_nothing(p, kind) if v is None else _as(v, kind)).alias(f"v{k}") for k, (kind, v, p) in enumerate(zip(seen[-1], known, after)) if kind is not None]
                return F.struct(F.concat(acc["out"], text(out)).alias("out"), *fields)

            at_first = F.struct(F.lit("").alias("out"), *((_nothing(v, kind) if _void(v) else _as(_column(v), kind)).alias(f"v{k}") for k, (kind, v) in enumerate(zip(kinds, start)) if kind is not None))
            total = F.coalesce(F.aggregate(rows, at_first, merge), at_first)
            if seen[-1] == kinds:
                break
            kinds = seen[-1]
        else:
            raise Uncompilable("the types of a loop's names don't settle")
        for k, ((n, a), kind) in enumerate(zip(keys, kinds)):
            if a and kind is not None:  # a namespace outlives the loop
                outside.assign(n, a, Dyn(kind, total[f"v{k}"]))
        return [Dyn(STRING, total["out"])]


def render(template: str, messages: Column, kind: T.DataType, add_generation_prompt: bool | Column = True, bos: str = "", eos: str = "", args: dict | None = None) -> Column:
    """The text of messages, a column of the given type."""
    if args is not None and not isinstance(args, dict):
        raise TemplateError("template arguments must be a JSON object")
    for name in args or {}:
        if name in chat.RESERVED:
            raise TemplateError(f"argument {name} is reserved")
    generation = Const(add_generation_prompt) if isinstance(add_generation_prompt, bool) else Dyn(BOOL, add_generation_prompt)
    names: dict[str, Value] = {k: Const(v) for k, v in (args or {}).items()}
    names |= {"messages": _typed(kind, messages), "add_generation_prompt": generation, "bos_token": Const(bos), "eos_token": Const(eos)}
    compiler = Compiler(names)
    return F.when(messages.isNotNull(), text(compiler.text(parse(template))))


def apply_chat(df: DataFrame, template: str, messages: str = "messages", out: str = "prompt", add_generation_prompt: bool | Column = True, bos: str = "", eos: str = "", args: dict | None = None) -> DataFrame:
    """df with the rendered text of a column of messages: arrays of structs, VARIANT or JSON text. A column named out is replaced."""
    kind = df.schema[messages].dataType
    df = df.drop(*[c for c in (out,) if c != messages])
    column = F.col(messages)
    if kind == STRING:
        # parsed once, whatever the number of places that read it
        held = df.withColumn("__messages", F.parse_json(column))
        return held.withColumn(out, render(template, F.col("__messages"), ANY, add_generation_prompt, bos, eos, args)).drop("__messages")
    return df.withColumn(out, render(template, column, kind, add_generation_prompt, bos, eos, args))
