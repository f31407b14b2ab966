"""Python-style row conditions compiled to Catalyst columns.

A condition is cut into tokens, parsed by Python's precedence into its syntax nodes and
compiled by static types (int, float, str, bool, list), so that comparisons, floor
division, remainders, powers and truth values follow Python and never Spark's implicit
casts.  ``&&``, ``||`` and ``!`` stand for and, or and not; in strings, backslashes
before other characters than n, t, quotes and backslashes stay, as patterns need them.
"""

from __future__ import annotations

import ast
import itertools
import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from contactweave.functions.fields import LINE, named, raw_field
from contactweave.functions.floats import float_text
from contactweave.model import PairsError, Unsupported

#: Columns that are numbers unless the caller says otherwise.
INT_COLUMNS = ("pos1", "pos2", "mapq1", "mapq2")
_CASTS = {"int": "bigint", "float": "double", "str": "string"}


_TOKEN = re.compile(
    r"""\s*(?:(?P<number>(?:[0-9][0-9_]*\.?[0-9_]*|\.[0-9][0-9_]*)(?:[eE][+-]?[0-9]+)?)|(?P<name>[A-Za-z_][A-Za-z0-9_]*)"""
    r"""|(?P<string>"(?:[^"\\]|\\.)*"|'(?:[^'\\]|\\.)*')|(?P<op>\*\*|//|[=!<>]=|&&|\|\||[-+*/%<>!()\[\],]))""",
    re.S,
)
_ESCAPED = {"n": "\n", "t": "\t", "\\": "\\", "'": "'", '"': '"'}
_WORDS = {"&&": "and", "||": "or", "!": "not"}
_COMPARE = {"==": ast.Eq, "!=": ast.NotEq, "<": ast.Lt, "<=": ast.LtE, ">": ast.Gt, ">=": ast.GtE}
_LEVELS = ({"+": ast.Add, "-": ast.Sub}, {"*": ast.Mult, "/": ast.Div, "//": ast.FloorDiv, "%": ast.Mod})


def tokens(text: str) -> list[tuple[str, object]]:
    """(kind, value) of a condition's tokens: number, name, string, op and end."""
    out, at = [], 0
    text = text.rstrip()
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m:
            what = "unterminated string" if text[at:].lstrip()[0] in "'\"" else "unexpected character"
            raise PairsError(f"bad condition: {what} at {text[at:].lstrip()[:10]!r}")
        kind, raw, at = m.lastgroup, m[m.lastgroup], m.end()
        if kind == "number":
            digits = raw.replace("_", "")
            try:
                out.append((kind, float(digits) if re.search(r"[.eE]", digits) else int(digits)))
            except ValueError as e:
                raise PairsError(f"bad number {raw!r}") from e
        elif kind == "string":
            out.append((kind, re.sub(r"\\(.)", lambda m: _ESCAPED.get(m[1], m[0]), raw[1:-1], flags=re.S)))
        else:
            word = _WORDS.get(raw, raw)
            out.append(("op" if word in ("and", "or", "not", "in") else kind, word))
    return [*out, ("end", "the end")]


class Parser:
    """Syntax nodes of a condition, loosest operators first."""

    def __init__(self, text: str):
        self.tokens, self.at = tokens(text), 0

    def next(self, *ops: str) -> str | None:
        """The next token if it is one of these operators, passed over."""
        kind, value = self.tokens[self.at]
        if kind != "op" or value not in ops:
            return None
        self.at += 1
        return value

    def need(self, op: str) -> None:
        if not self.next(op):
            raise PairsError(f"bad condition: {op!r} expected at {self.tokens[self.at][1]!r}")

    def whole(self) -> ast.expr:
        out = self.either()
        if self.tokens[self.at][0] != "end":
            raise PairsError(f"bad condition: {self.tokens[self.at][1]!r} is left over")
        return out

    def joined(self, word: str, op: ast.boolop, part) -> ast.expr:
        values = [part()]
        while self.next(word):
            values.append(part())
        return ast.BoolOp(op, values) if len(values) > 1 else values[0]

    def either(self) -> ast.expr:
        return self.joined("or", ast.Or(), lambda: self.joined("and", ast.And(), self.negated))

    def negated(self) -> ast.expr:
        return ast.UnaryOp(ast.Not(), self.negated()) if self.next("not") else self.compared()

    def compared(self) -> ast.expr:
        left, ops, others = self.chain(0), [], []
        while True:
            if op := self.next(*_COMPARE):
                ops.append(_COMPARE[op]())
            elif self.next("in"):
                ops.append(ast.In())
            elif self.tokens[self.at] == ("op", "not") and self.tokens[self.at + 1] == ("op", "in"):
                self.at += 2
                ops.append(ast.NotIn())
            else:
                return ast.Compare(left, ops, others) if ops else left
            others.append(self.chain(0))

    def chain(self, level: int) -> ast.expr:
        if level == len(_LEVELS):
            return self.signed()
        out = self.chain(level + 1)
        while op := self.next(*_LEVELS[level]):
            out = ast.BinOp(out, _LEVELS[level][op](), self.chain(level + 1))
        return out

    def signed(self) -> ast.expr:
        if op := self.next("+", "-"):
            return ast.UnaryOp(ast.UAdd() if op == "+" else ast.USub(), self.signed())
        base = self.atom()
        return ast.BinOp(base, ast.Pow(), self.signed()) if self.next("**") else base

    def listed(self, end: str) -> list[ast.expr]:
        out: list[ast.expr] = []
        while not self.next(end):
            out.append(self.either())
            if not self.next(","):
                self.need(end)
                break
        return out

    def atom(self) -> ast.expr:
        kind, value = self.tokens[self.at]
        if self.next("("):
            out = self.either()
            self.need(")")
            return out
        if self.next("["):
            return ast.List(self.listed("]"))
        if kind not in ("number", "string", "name"):
            raise PairsError(f"bad condition: unexpected {value!r}")
        self.at += 1
        if kind != "name" or value in ("True", "False"):
            return ast.Constant(value == "True" if kind == "name" else value)
        if self.next("("):
            return ast.Call(ast.Name(value), self.listed(")"), [])
        if value == "COLS":
            self.need("[")
            place = self.either()
            self.need("]")
            return ast.Subscript(ast.Name(value), place)
        return ast.Name(value)


@dataclass
class Typed:
    """A compiled part: its type, its column, and its value if it is a literal.  Where a
    row decides the type, it is ``mixed`` and the value lists (guard, part): the first
    part whose guard holds is meant, and the last one where none does.  A part of type
    ``error`` has a message for a value."""

    kind: str
    column: Column | None
    value: object = None


def alternatives(t: Typed) -> list[tuple[Column, Typed]]:
    return t.value if t.kind == "mixed" else [(F.lit(True), t)]


def chosen(parts: list[tuple[Column, Column]]) -> Column:
    """The column of the first guard that holds."""
    *first, (_, out) = parts
    for guard, column in reversed(first):
        out = F.when(guard, column).otherwise(out)
    return out


def united(parts: list[tuple[Column, Typed]]) -> Typed:
    """One part for alternatives; a plain one if they are of one type."""
    kinds = {t.kind for _, t in parts} - {"error"}
    if not kinds:
        raise PairsError(parts[0][1].value)
    if len(kinds) > 1 or "list" in kinds:
        return Typed("mixed", None, parts) if len(parts) > 1 else parts[0][1]
    kind = kinds.pop()
    column = lambda t: F.raise_error(F.lit(t.value)).cast(_CASTS.get(kind, "boolean")) if t.kind == "error" else t.column
    return Typed(kind, chosen([(g, column(t)) for g, t in parts]), parts[0][1].value if len(parts) == 1 else None)


def spread(work: Callable[..., Typed], *parts: Typed) -> Typed:
    """``work`` over parts, once for every choice of the mixed ones' alternatives; what is
    an error for some choice only is raised by the rows that make it."""
    if not any(p.kind == "mixed" for p in parts):
        return work(*parts)
    out = []
    for choice in itertools.product(*map(alternatives, parts)):
        guard = F.lit(True)
        for g, _ in choice:
            guard = guard & F.coalesce(g, F.lit(False))
        errors = [t for _, t in choice if t.kind == "error"]
        try:
            made = errors[0] if errors else work(*(t for _, t in choice))
        except Unsupported:
            raise
        except PairsError as e:
            made = Typed("error", None, str(e))
        out += [(guard & F.coalesce(g, F.lit(False)), t) for g, t in alternatives(made)]
    return united(out)


def _number(t: Typed) -> Column:
    return t.column.cast("bigint") if t.kind == "bool" else t.column


def exact_power(x: Column, n: Column) -> Column:
    """x ** n of integers; an error where it overflows or n is negative."""
    few = F.when(F.abs(x) <= 1, F.when(n == 0, n).otherwise(2 - n % 2)).otherwise(F.least(n, F.lit(64).cast("bigint")))
    few = F.when(n < 0, F.raise_error(F.lit("a column's negative power"))).otherwise(few)
    factors = F.when(few > 0, F.sequence(F.lit(1).cast("bigint"), few)).otherwise(F.array().cast("array<bigint>"))
    return F.aggregate(factors, F.lit(1).cast("bigint"), lambda product, _: product * x)


def truth(t: Typed) -> Column:
    if t.kind == "mixed":
        return spread(lambda x: Typed("bool", truth(x)), t).column
    if t.kind == "bool":
        return t.column
    if t.kind == "str":
        return t.column != ""
    if t.kind == "list":
        return F.lit(bool(t.value))
    return t.column != 0


def compare(op: ast.cmpop, a: Typed, b: Typed) -> Column:
    if "mixed" in (a.kind, b.kind):
        return spread(lambda x, y: Typed("bool", compare(op, x, y)), a, b).column
    if "list" in (a.kind, b.kind):
        raise Unsupported("comparison of lists")
    if (a.kind == "str") != (b.kind == "str"):
        if isinstance(op, (ast.Eq, ast.NotEq)):
            return F.lit(isinstance(op, ast.NotEq))
        raise PairsError("a string and a number can't be ordered; give the column a type")
    if a.kind == "str":
        x, y = a.column, b.column
    else:
        x, y = _number(a), _number(b)
        if "float" in (a.kind, b.kind):
            x, y = x.cast("double"), y.cast("double")
    out = {ast.Eq: x == y, ast.NotEq: x != y, ast.Lt: x < y, ast.LtE: x <= y, ast.Gt: x > y, ast.GtE: x >= y}[type(op)]
    if "float" in (a.kind, b.kind):
        nan = F.isnan(x) | F.isnan(y)
        out = F.when(nan, F.lit(isinstance(op, ast.NotEq))).otherwise(out)
    return out


def member(a: Typed, b: Typed) -> Column:
    if "mixed" in (a.kind, b.kind):
        return spread(lambda x, y: Typed("bool", member(x, y)), a, b).column
    if b.kind == "list":
        out = F.lit(False)
        for item in b.value:
            out = out | compare(ast.Eq(), a, item)
        return out
    if a.kind == b.kind == "str":
        return F.contains(b.column, a.column)
    raise PairsError("'in' needs a list or two strings")


def arithmetic(op: ast.operator, a: Typed, b: Typed) -> Typed:
    if "mixed" in (a.kind, b.kind):
        return spread(lambda x, y: arithmetic(op, x, y), a, b)
    if a.kind == b.kind == "str" and isinstance(op, ast.Add):
        return Typed("str", F.concat(a.column, b.column))
    if "str" in (a.kind, b.kind) or "list" in (a.kind, b.kind):
        raise PairsError("arithmetic needs numbers")
    x, y = _number(a), _number(b)
    whole = "float" not in (a.kind, b.kind)
    kind = "int" if whole else "float"
    if not whole:
        x, y = x.cast("double"), y.cast("double")
    zero = lambda out: F.when(y == 0, F.raise_error(F.lit("division by zero"))).otherwise(out)
    if isinstance(op, ast.Add):
        return Typed(kind, x + y)
    if isinstance(op, ast.Sub):
        return Typed(kind, x - y)
    if isinstance(op, ast.Mult):
        return Typed(kind, x * y)
    if isinstance(op, ast.Div):
        return Typed("float", zero(x.cast("double") / y.cast("double")))
    if isinstance(op, ast.Mod):
        r = x % y
        return Typed(kind, zero(F.when((r != 0) & ((r < 0) != (y < 0)), r + y).otherwise(r)))
    if isinstance(op, ast.FloorDiv):
        if not whole:
            return Typed("float", zero(F.floor(x / y).cast("double")))
        q, r = F.call_function("div", x, y), x % y
        return Typed("int", zero(F.when((r != 0) & ((r < 0) != (y < 0)), q - 1).otherwise(q)))
    if isinstance(op, ast.Pow):
        if not whole or (b.value is not None and b.value < 0):
            return Typed("float", F.pow(x.cast("double"), y.cast("double")))
        if b.value is None:
            # The exponent's sign decides the type.
            return united([(y >= 0, Typed("int", exact_power(x, y))), (F.lit(True), Typed("float", F.pow(x.cast("double"), y.cast("double"))))])
        if a.value is None:
            return Typed("int", exact_power(x, y))
        # Powers past 64 bits need no working out to be errors.
        value = int(a.value) ** int(b.value) if abs(a.value) <= 1 or b.value < 64 else 1 << 64
        if not -(1 << 63) <= value < 1 << 63:
            raise PairsError("integer overflow")
        return Typed("int", F.lit(value).cast("bigint"), value)
    raise Unsupported(f"operator {type(op).__name__}")


def glob_pattern(glob: str) -> str:
    """``*`` and ``?`` as in file names, brackets as in regular expressions."""
    return "".join({"*": ".*", "?": "."}.get(c, c if c in "[]" else re.escape(c)) for c in glob)


def _literal(t: Typed, what: str) -> str:
    if t.kind != "str" or t.value is None:
        raise PairsError(f"{what} must be a literal string")
    return t.value


class Compiler(ast.NodeVisitor):
    def __init__(self, columns: list[str], types: dict[str, str], lined: bool = False):
        self.columns, self.types, self.lined = columns, types, lined

    def column(self, name: str) -> Typed:
        if name not in self.columns:
            raise PairsError(f"unknown column {name!r}; there are {', '.join(self.columns)}")
        kind = self.types.get(name, "int" if name in INT_COLUMNS else "str")
        if kind not in _CASTS:
            raise PairsError(f"unknown type {kind!r}")
        if kind == "str" and self.lined:
            return Typed(kind, raw_field(self.columns.index(name)))
        return Typed(kind, F.col(f"`{name}`").cast(_CASTS[kind]))

    def generic_visit(self, node):
        raise Unsupported(f"{type(node).__name__} in a condition")

    def visit_Expression(self, node):
        return self.visit(node.body)

    def visit_Constant(self, node):
        for t, kind in ((bool, "bool"), (int, "int"), (float, "float"), (str, "str")):
            if isinstance(node.value, t):
                if kind == "int" and not -(1 << 63) <= node.value < 1 << 63:
                    raise PairsError("integer out of range")
                return Typed(kind, F.lit(node.value).cast("bigint") if kind == "int" else F.lit(node.value), node.value)
        raise Unsupported(f"literal {node.value!r}")

    def visit_Name(self, node):
        return self.column(node.id)

    def visit_List(self, node):
        return Typed("list", None, [self.visit(x) for x in node.elts])

    visit_Tuple = visit_List

    def visit_Subscript(self, node):
        if isinstance(node.value, ast.Name) and node.value.id == "COLS" and isinstance(node.slice, ast.Constant):
            at = node.slice.value
            if not isinstance(at, int) or not 0 <= at < len(self.columns):
                raise PairsError(f"COLS has {len(self.columns)} columns")
            return self.column(self.columns[at])
        raise Unsupported("only COLS[i] can be indexed")

    def visit_BoolOp(self, node):
        parts = [self.visit(x) for x in node.values]
        both = isinstance(node.op, ast.And)
        if all(p.kind == "bool" for p in parts):
            out = parts[0].column
            for p in parts[1:]:
                out = out & p.column if both else out | p.column
            return Typed("bool", out)
        # The value is the first part that settles it, or the last one.
        out = alternatives(parts[-1])
        for p in reversed(parts[:-1]):
            settles = ~truth(p) if both else truth(p)
            out = [(settles & g, t) for g, t in alternatives(p)] + out
        return united(out)

    def visit_UnaryOp(self, node):
        if isinstance(node.op, ast.Not):
            return Typed("bool", ~truth(self.visit(node.operand)))
        return spread(lambda t: self.signed(node.op, t), self.visit(node.operand))

    def signed(self, op: ast.unaryop, t: Typed) -> Typed:
        if t.kind in ("str", "list"):
            raise PairsError("a string has no sign")
        kind = "float" if t.kind == "float" else "int"
        if isinstance(op, ast.UAdd):
            return Typed(kind, _number(t), t.value)
        return Typed(kind, -_number(t), None if t.value is None else -t.value)

    def visit_BinOp(self, node):
        return arithmetic(node.op, self.visit(node.left), self.visit(node.right))

    def visit_Compare(self, node):
        left, out = self.visit(node.left), F.lit(True)
        for op, right in zip(node.ops, map(self.visit, node.comparators)):
            if isinstance(op, (ast.In, ast.NotIn)):
                one = member(left, right)
                one = ~one if isinstance(op, ast.NotIn) else one
            else:
                one = compare(op, left, right)
            out, left = out & one, right
        return Typed("bool", out)

    def visit_Call(self, node):
        if not isinstance(node.func, ast.Name) or node.keywords:
            raise Unsupported("only plain functions can be called")
        name, args = node.func.id, [self.visit(a) for a in node.args]
        arity = {"abs": 1, "int": 1, "float": 1, "str": 1, "len": 1, "csv_match": 2, "wildcard_match": 2, "regex_match": 2}
        if name not in (*arity, "min", "max"):
            raise PairsError(f"unknown function {name!r}")
        if not args or arity.get(name, len(args)) != len(args):
            raise PairsError(f"{name} takes {arity.get(name, 'one or more')} argument(s)")
        return spread(lambda *parts: self.call(name, list(parts)), *args)

    def call(self, name: str, args: list[Typed]) -> Typed:
        first = args[0]
        if name == "abs":
            if first.kind in ("str", "list"):
                raise PairsError("abs needs a number")
            return Typed("float" if first.kind == "float" else "int", F.abs(_number(first)))
        if name == "len":
            if first.kind not in ("list", "str"):
                raise PairsError("len needs a string or a list")
            return Typed("int", F.lit(len(first.value)).cast("bigint") if first.kind == "list" else F.octet_length(first.column).cast("bigint"))
        if name in ("int", "float"):
            kind = _CASTS[name]
            if first.kind != "str":
                return Typed(name, (F.when(first.column < 0, F.ceil(first.column)).otherwise(F.floor(first.column)) if name == "int" and first.kind == "float" else first.column).cast(kind))
            pattern = r"\A[+-]?[0-9]+\z" if name == "int" else r"(?i)\A[+-]?(?:[0-9]+\.?[0-9]*(?:e[+-]?[0-9]+)?|\.[0-9]+(?:e[+-]?[0-9]+)?|inf|infinity|nan)\z"
            bad = F.raise_error(F.concat(F.lit(f"not a {name}: "), first.column))
            return Typed(name, F.when(first.column.rlike(pattern), first.column).otherwise(bad).cast(kind))
        if name == "str":
            if first.kind == "float":
                return Typed("str", float_text(first.column))
            return Typed("str", F.initcap(first.column.cast("string")) if first.kind == "bool" else first.column.cast("string"))
        if name in ("min", "max"):
            if len({a.kind == "str" for a in args}) > 1:
                raise PairsError(f"{name} of strings and numbers")
            best = first
            for a in args[1:]:
                kind = "str" if a.kind == "str" else "float" if "float" in (a.kind, best.kind) else "int"
                cast = _CASTS[kind]
                better = compare(ast.Lt() if name == "min" else ast.Gt(), a, best)
                best = Typed(kind, F.when(better, a.column.cast(cast)).otherwise(best.column.cast(cast)))
            return best
        text = first.column if first.kind == "str" else first.column.cast("string")
        pattern = _literal(args[1], f"the second argument of {name}")
        if name == "csv_match":
            return Typed("bool", text.isin(pattern.split(",")))
        if name == "wildcard_match":
            return Typed("bool", text.rlike(rf"(?s)\A{glob_pattern(pattern)}\z"))
        if re.search(r"\(\?[=!<]|\\[1-9]", pattern):
            raise Unsupported("look-around and back-references")
        return Typed("bool", text.rlike(rf"(?Ud)\A(?:{pattern})\z"))


def compile_condition(condition: str, df: DataFrame, types: dict[str, str] | None = None) -> Column:
    """The condition as a boolean column over ``df``."""
    return truth(Compiler(named(df), types or {}, LINE in df.columns).visit(Parser(condition).whole()))
