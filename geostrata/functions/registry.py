"""A registry of SQL functions by signature, and the decorator that adds functions of one's own.

    @st_function("ST_Twice(double, bigint = 2) -> double")
    def st_twice(x, n):            # Columns in, a Column out
        return x * n

A signature names argument types and, for trailing optional arguments, default literals. An argument marked
``strict`` (the rule) makes the result NULL where it is NULL; ``type?`` lets the function see the NULL. Functions
become temporary SQL functions: types coerce, names are case-insensitive, optional arguments may be left out. Several
signatures under one name are overloads by number of arguments; overloads by types alone are refused."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

TYPES = {
    "geometry": "BINARY", "binary": "BINARY", "double": "DOUBLE", "float64": "DOUBLE", "bigint": "BIGINT", "int64": "BIGINT", "uint64": "BIGINT", "int": "INT", "int32": "INT", "string": "STRING", "utf8": "STRING",
    "boolean": "BOOLEAN", "bool": "BOOLEAN", "date": "DATE", "timestamp": "TIMESTAMP", "json": "STRING", "box2d": "STRUCT<xmin: DOUBLE, ymin: DOUBLE, xmax: DOUBLE, ymax: DOUBLE>",
}
_SIGNATURE = re.compile(r"^\s*(\w+)\s*\((.*)\)\s*->\s*(.+?)\s*$", re.S)


class SignatureError(ValueError):
    pass


@dataclass(frozen=True)
class Argument:
    type: str
    default: str | None = None
    sees_null: bool = False


@dataclass(frozen=True)
class Signature:
    name: str
    arguments: tuple[Argument, ...]
    result: str


def sql_type(text: str) -> str:
    text = text.strip()
    low = text.lower()
    if low in TYPES:
        return TYPES[low]
    if m := re.fullmatch(r"list\s*<(.+)>", low):
        return f"ARRAY<{sql_type(m[1])}>"
    if re.fullmatch(r"[\w\s<>:,()]+", text):
        return text.upper()
    raise SignatureError(f"no such type: {text}")


def _split(text: str) -> list[str]:
    out, depth, at = [], 0, 0
    for i, c in enumerate(text):
        depth += (c in "<(") - (c in ">)")
        if c == "," and not depth:
            out.append(text[at:i])
            at = i + 1
    return [x for x in [*out, text[at:]] if x.strip()]


def parse(text: str) -> Signature:
    m = _SIGNATURE.match(text)
    if not m:
        raise SignatureError(f"not a signature: {text}")
    arguments = []
    for part in _split(m[2]):
        kind, _, default = part.partition("=")
        kind, sees = kind.strip(), kind.strip().endswith("?")
        arguments.append(Argument(sql_type(kind.rstrip("?")), default.strip() or None, sees or bool(default.strip())))
    seen = False
    for a in arguments:
        if seen and a.default is None:
            raise SignatureError(f"{m[1]}: an argument without default follows one with a default")
        seen = seen or a.default is not None
    return Signature(m[1], tuple(arguments), sql_type(m[3]))


@dataclass
class Function:
    """body: SQL text over the arguments a, b, c ..., or a function of Columns."""

    signature: Signature
    body: str | Callable[..., Column]
    doc: str = ""


@dataclass
class Registry:
    functions: dict[str, list[Function]] = field(default_factory=dict)

    def add(self, text: str, body: str | Callable[..., Column], doc: str = "") -> Function:
        fn = Function(parse(text), body, doc)
        own = self.functions.setdefault(fn.signature.name.lower(), [])
        if own and own[0].signature.result != fn.signature.result:
            raise SignatureError(f"{fn.signature.name}: overloads must have one result type")
        same = [o for o in own if len(o.signature.arguments) == len(fn.signature.arguments)]
        if any([a.type for a in o.signature.arguments] != [a.type for a in fn.signature.arguments] for o in same):
            raise SignatureError(f"{fn.signature.name}: overloads differ in the number of arguments, not in types alone: SQL functions coerce their arguments")
        own[:] = [o for o in own if o not in same] + [fn]  # a function of the same types is replaced
        return fn

    def function(self, *texts: str) -> Callable:
        """Decorator: register a function of Columns under one signature, or under several as overloads."""

        def wrap(f: Callable[..., Column]) -> Callable[..., Column]:
            for text in texts:
                self.add(text, f, f.__doc__ or "")
            return f

        return wrap

    def register(self, spark: SparkSession) -> None:
        for own in self.functions.values():
            create(spark, own)


_NAMES = "abcdefghijklmnop"


def _column_sql(spark: SparkSession, fn: Function, names: list[str]) -> str:
    """SQL text of a function of Columns, through the analysis of a projection of its arguments."""
    fields = ", ".join(f"{n} {a.type}" for n, a in zip(names, fn.signature.arguments, strict=False))
    frame = spark.createDataFrame([], fields) if fields else spark.range(0)
    column = fn.body(*(F.col(n) for n in names[: len(fn.signature.arguments)]))
    plan = frame.select(column.alias("r"))._jdf.queryExecution().analyzed()
    return plan.expressions().apply(0).child().sql()


def _body(spark: SparkSession, fn: Function, names: list[str]) -> str:
    if isinstance(fn.body, str):
        return f"CAST({fn.body} AS {fn.signature.result})"
    text = _column_sql(spark, fn, names)
    strict = [n for n, a in zip(names, fn.signature.arguments, strict=False) if not a.sees_null]
    if strict:
        text = f"CASE WHEN {' OR '.join(f'{n} IS NULL' for n in strict)} THEN NULL ELSE {text} END"
    return f"CAST({text} AS {fn.signature.result})"


def _free(spark: SparkSession, name: str) -> None:
    """Take a built-in function of this name out of the session's registry, as SQL alone cannot replace it."""
    registry = spark._jsparkSession.sessionState().functionRegistry()
    registry.dropFunction(spark._jvm.org.apache.spark.sql.catalyst.FunctionIdentifier(name.lower()))


def create(spark: SparkSession, own: list[Function]) -> None:
    """One temporary function for all overloads of a name: the longest signature, shorter ones where trailing
    arguments are missing."""
    own = sorted(own, key=lambda f: len(f.signature.arguments))
    full = own[-1]
    names = list(_NAMES[: len(full.signature.arguments)])
    least = len(own[0].signature.arguments)
    parameters = []
    for i, (n, a) in enumerate(zip(names, full.signature.arguments, strict=True)):
        default = a.default if a.default is not None else "NULL" if i >= least and len(own) > 1 else None
        parameters.append(f"{n} {a.type}" + (f" DEFAULT {default}" if default is not None else ""))
    body = _body(spark, full, names)
    for fn in reversed(own[:-1]):
        body = f"CASE WHEN {names[len(fn.signature.arguments)]} IS NULL THEN {_body(spark, fn, names)} ELSE {body} END"
    _free(spark, full.signature.name)
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {full.signature.name}({', '.join(parameters)}) RETURNS {full.signature.result} RETURN {body}")


#: Functions that users add with ``st_function``.
USER = Registry()
st_function = USER.function
