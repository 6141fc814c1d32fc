"""Templates and expressions over a row's fields, compiled to Columns.

Expressions use a part of Python's grammar: names, numbers, texts, arithmetic, comparisons,
``and or not``, conditionals, subscripts by constants, and the calls listed in ``CALLS`` and
``METHODS``. Anything else is an error when the expression is compiled; nothing is ever
evaluated as code.
"""

from __future__ import annotations

import ast
import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.functions.text import strip, truthy


class ExpressionError(ValueError):
    """The expression is outside the grammar or names an unknown field."""


CALLS: dict[str, Callable[..., Column]] = {
    "len": lambda c: F.length(c), "str": lambda c: c.cast("string"), "int": lambda c: c.cast("long"), "float": lambda c: c.cast("double"),
    "abs": F.abs, "round": lambda c, n=None: F.bround(c, 0 if n is None else n), "min": F.least, "max": F.greatest,
}
METHODS: dict[str, Callable[..., Column]] = {
    "lower": F.lower, "upper": F.upper, "strip": strip, "startswith": lambda c, p: c.startswith(p), "endswith": lambda c, p: c.endswith(p),
    "replace": lambda c, a, b: F.replace(c, a, b),
}
RESULTS = {"len": T.LongType(), "str": T.StringType(), "int": T.LongType(), "float": T.DoubleType(), "lower": T.StringType(), "upper": T.StringType(), "strip": T.StringType(), "replace": T.StringType(), "startswith": T.BooleanType(), "endswith": T.BooleanType()}
COMPARE = {ast.Eq: "__eq__", ast.NotEq: "__ne__", ast.Lt: "__lt__", ast.LtE: "__le__", ast.Gt: "__gt__", ast.GtE: "__ge__"}


class Compiler:
    def __init__(self, schema: T.StructType) -> None:
        self.kinds = {f.name: f.dataType for f in schema.fields}

    def compile(self, text: str) -> tuple[Column, T.DataType]:
        try:
            tree = ast.parse(text.strip(), mode="eval").body
        except SyntaxError as e:
            raise ExpressionError(f"{text}: {e.msg}") from e
        return self.visit(tree)

    def visit(self, x: ast.AST) -> tuple[Column, T.DataType]:
        method = getattr(self, f"on_{type(x).__name__}", None)
        if method is None:
            raise ExpressionError(f"{type(x).__name__} is not allowed")
        return method(x)

    def on_Name(self, x: ast.Name) -> tuple[Column, T.DataType]:
        if x.id not in self.kinds:
            raise ExpressionError(f"name '{x.id}' is not defined")
        return F.col(f"`{x.id}`"), self.kinds[x.id]

    def on_Constant(self, x: ast.Constant) -> tuple[Column, T.DataType]:
        kind = {str: T.StringType(), bool: T.BooleanType(), int: T.LongType(), float: T.DoubleType(), type(None): T.NullType()}.get(type(x.value))
        if kind is None:
            raise ExpressionError(f"{x.value!r} is not allowed")
        return F.lit(x.value), kind

    def on_UnaryOp(self, x: ast.UnaryOp) -> tuple[Column, T.DataType]:
        c, kind = self.visit(x.operand)
        if isinstance(x.op, ast.Not):
            return ~truthy(c, kind), T.BooleanType()
        if isinstance(x.op, ast.USub):
            return -c, kind
        raise ExpressionError(f"{type(x.op).__name__} is not allowed")

    def on_BinOp(self, x: ast.BinOp) -> tuple[Column, T.DataType]:
        (a, ka), (b, kb) = self.visit(x.left), self.visit(x.right)
        number = T.DoubleType() if isinstance(ka, T.FractionalType) or isinstance(kb, T.FractionalType) else T.LongType()
        if isinstance(x.op, ast.Add):
            return (F.concat(a, b), T.StringType()) if isinstance(ka, T.StringType) else (a + b, number)
        if isinstance(x.op, ast.Sub):
            return a - b, number
        if isinstance(x.op, ast.Mult):
            return a * b, number
        if isinstance(x.op, ast.Div):
            return a.cast("double") / b, T.DoubleType()
        if isinstance(x.op, ast.FloorDiv):
            return F.floor(a.cast("double") / b).cast(number), number
        if isinstance(x.op, ast.Mod):
            return F.pmod(a, b), number
        if isinstance(x.op, ast.Pow):
            return F.pow(a, b).cast(number), number
        raise ExpressionError(f"{type(x.op).__name__} is not allowed")

    def on_Compare(self, x: ast.Compare) -> tuple[Column, T.DataType]:
        out, (left, _) = None, self.visit(x.left)
        for op, right in zip(x.ops, x.comparators, strict=True):
            r, kind = self.visit(right)
            if type(op) in COMPARE:
                one = getattr(left, COMPARE[type(op)])(r)
            elif isinstance(op, (ast.In, ast.NotIn)):
                one = F.array_contains(r, left) if isinstance(kind, T.ArrayType) else F.contains(r, left)
                one = ~one if isinstance(op, ast.NotIn) else one
            else:
                raise ExpressionError(f"{type(op).__name__} is not allowed")
            out, left = one if out is None else out & one, r
        return out, T.BooleanType()

    def on_BoolOp(self, x: ast.BoolOp) -> tuple[Column, T.DataType]:
        out, kind = self.visit(x.values[0])
        for v in x.values[1:]:
            r, k = self.visit(v)
            yes = truthy(out, kind)
            out, kind = (F.when(yes, r).otherwise(out) if isinstance(x.op, ast.And) else F.when(yes, out).otherwise(r)), k
        return out, kind

    def on_IfExp(self, x: ast.IfExp) -> tuple[Column, T.DataType]:
        (test, kt), (a, ka), (b, _) = self.visit(x.test), self.visit(x.body), self.visit(x.orelse)
        return F.when(truthy(test, kt), a).otherwise(b), ka

    def on_Subscript(self, x: ast.Subscript) -> tuple[Column, T.DataType]:
        c, kind = self.visit(x.value)
        if not isinstance(x.slice, ast.Constant):
            raise ExpressionError("only constant subscripts are allowed")
        key = x.slice.value
        if isinstance(kind, T.StructType):
            return c[key], kind[key].dataType
        if isinstance(kind, T.MapType):
            return F.element_at(c, key), kind.valueType
        if isinstance(kind, T.ArrayType):
            return F.element_at(c, key + 1 if key >= 0 else key), kind.elementType
        return F.substring(c, key + 1 if key >= 0 else key, 1), T.StringType()

    def on_Call(self, x: ast.Call) -> tuple[Column, T.DataType]:
        args = [self.visit(a) for a in x.args]
        if isinstance(x.func, ast.Name) and x.func.id in CALLS:
            name = x.func.id
            if name == "len" and isinstance(args[0][1], (T.ArrayType, T.MapType)):
                return F.size(args[0][0]), T.LongType()
            values = [a.value if name == "round" and i and isinstance(a, ast.Constant) else args[i][0] for i, a in enumerate(x.args)]
            return CALLS[name](*values), RESULTS.get(name, args[0][1])
        if isinstance(x.func, ast.Attribute) and x.func.attr in METHODS:
            return METHODS[x.func.attr](self.visit(x.func.value)[0], *(a for a, _ in args)), RESULTS[x.func.attr]
        raise ExpressionError("this call is not allowed")


def expression(df: DataFrame, text: str) -> Column:
    return Compiler(df.schema).compile(text)[0]


def parts(template: str) -> list[tuple[bool, str]]:
    """(is an expression, text) of a ``{expr}`` template; ``\\{`` and ``\\}`` are braces; an unclosed brace is text."""
    out, text, i = [], "", 0
    while i < len(template):
        if template[i : i + 2] in (r"\{", r"\}"):
            text, i = text + template[i + 1], i + 2
        elif template[i] == "{" and (end := template.find("}", i)) > 0:
            out += [(False, text), (True, template[i + 1 : end])]
            text, i = "", end + 1
        else:
            text, i = text + template[i], i + 1
    return [*out, (False, text)]


def render(df: DataFrame, template: str) -> Column:
    """A ``{expr}`` template; an expression that can't be compiled becomes an error text, a null value the text None."""
    made = []
    for is_expr, text in parts(template):
        if not is_expr:
            made.append(F.lit(text))
            continue
        try:
            c, kind = Compiler(df.schema).compile(text)
        except ExpressionError as e:
            made.append(F.lit(f"Error in expression: {text} - {e}"))
            continue
        shown = F.when(c, "True").otherwise("False") if isinstance(kind, T.BooleanType) else c.cast("string")
        made.append(F.coalesce(F.when(c.isNull(), "None").otherwise(shown), F.lit("None")))
    return F.concat(*made)


SLOT = re.compile(r"__([A-Za-zÀ-ÖØ-öø-ÿ_-]+)__")


def fill_slots(df: DataFrame, template: str) -> Column:
    """``__field__`` slots replaced in turn; an absent or null field gives ``unknown``."""
    out = F.lit(template)
    for name in dict.fromkeys(SLOT.findall(template)):
        value = F.coalesce(F.col(f"`{name}`").cast("string"), F.lit("unknown")) if name in df.columns else F.lit("unknown")
        out = F.replace(out, F.lit(f"__{name}__"), value)
    return out


def fill_texts(template: str, *texts: Column) -> Column:
    """``__text_1__`` and so on replaced one after the other; each must be in the template."""
    out = F.lit(template)
    for i, t in enumerate(texts, 1):
        if f"__text_{i}__" not in template:
            raise ValueError(f"the template lacks __text_{i}__")
        out = F.replace(out, F.lit(f"__text_{i}__"), t)
    return out
