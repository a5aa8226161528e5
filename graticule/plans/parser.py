"""Text to syntax trees: a tokenizer by one pattern and precedence climbing."""

from __future__ import annotations

import math
import re
from dataclasses import replace

try:  # knows the Unicode classes that the language's dialect has
    import regex as dialect
except ImportError:
    import re as dialect

from . import registry as R
from .ast import Aggregate, Binary, Call, Expr, Matcher, Matching, Matrix, Number, Paren, Selector, String, Subquery, Unary
from .units import DURATION, parse_duration


class ParseError(ValueError):
    """The text is no query."""


class UnsupportedError(ParseError):
    """A query that the language knows and this engine does not."""


_TOKEN = re.compile(
    rf"""
    (?P<space>[\s]+|\#[^\n]*)
  | (?P<string>"(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)*'|`[^`]*`)
  | (?P<duration>(?=\d+(?:ms|[smhdwy])){DURATION}(?![\w.]))
  | (?P<number>0[xX][0-9a-fA-F]+|(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?(?![\w]))
  | (?P<name>[a-zA-Z_][a-zA-Z0-9_:]*)
  | (?P<op></|>/|==|!=|<=|>=|=~|!~|[-+*/%^<>=(){{}}\[\],:@])
    """,
    re.X,
)
_ESCAPE = re.compile(r"\\(x[0-9a-fA-F]{2}|u[0-9a-fA-F]{4}|U[0-9a-fA-F]{8}|[0-7]{3}|.)", re.S)
_PLAIN = {"n": "\n", "t": "\t", "r": "\r", "a": "\a", "b": "\b", "f": "\f", "v": "\v", "\\": "\\", '"': '"', "'": "'"}
#: Binding strength; ``^`` binds to the right.
_POWER = {"or": 1, "and": 2, "unless": 2, **dict.fromkeys([*R.COMPARISON, *R.TRIMS], 3), "+": 4, "-": 4, "*": 5, "/": 5, "%": 5, "atan2": 5, "^": 7}
_UNARY_POWER = 6


def unquote(text: str) -> str:
    if text[0] == "`":
        return text[1:-1]

    def one(m: re.Match) -> str:
        c = m[1]
        if c[0] in "xuU" and len(c) > 1:
            return chr(int(c[1:], 16))
        if len(c) == 3:
            return chr(int(c, 8))
        if c not in _PLAIN:
            raise ParseError(f"invalid escape sequence \\{c}")
        return _PLAIN[c]

    return _ESCAPE.sub(one, text[1:-1])


class _Parser:
    def __init__(self, text: str):
        self.text, self.tokens, at = text, [], 0
        while at < len(text):
            m = _TOKEN.match(text, at)
            if not m:
                raise ParseError(f"unexpected character {text[at]!r} at position {at}")
            if m.lastgroup != "space":
                self.tokens.append((m.lastgroup, m[0], at))
            at = m.end()
        self.tokens.append(("end", "", at))
        self.i = 0

    # -- tokens

    @property
    def kind(self) -> str:
        return self.tokens[self.i][0]

    @property
    def value(self) -> str:
        return self.tokens[self.i][1]

    def next(self) -> str:
        self.i += 1
        return self.tokens[self.i - 1][1]

    def is_(self, *values: str) -> bool:
        return self.kind in ("op", "name") and self.value in values

    def word(self, *values: str) -> bool:
        return self.kind == "name" and self.value.lower() in values

    def accept(self, value: str) -> bool:
        if self.is_(value):
            self.i += 1
            return True
        return False

    def expect(self, value: str) -> None:
        if not self.accept(value):
            self.fail(f"expected {value!r}")

    def fail(self, why: str):
        kind, value, at = self.tokens[self.i]
        raise ParseError(f"{why}, found {value!r} at position {at}" if kind != "end" else f"{why}, found the end of the query")

    # -- expressions

    def expression(self, least: int = 0) -> Expr:
        left = self.unary()
        while True:
            op = self.value.lower() if self.kind == "name" else self.value
            power = _POWER.get(op) if self.kind in ("op", "name") else None
            if power is None or power < least:
                return left
            self.next()
            bool_ = False
            if self.word("bool"):
                if op not in R.COMPARISON:
                    self.fail("bool modifier can only be used on comparison operators")
                self.next()
                bool_ = True
            matching = self.matching(op)
            right = self.expression(power if op == "^" else power + 1)
            left = Binary(op, left, right, matching, bool_)

    def unary(self) -> Expr:
        if self.is_("+", "-"):
            op = self.next()
            inner = self.expression(_UNARY_POWER)
            if isinstance(inner, Number) and op == "-":
                return Number(-inner.value)
            return inner if isinstance(inner, Number) else Unary(op, inner)
        return self.postfix(self.primary())

    def matching(self, op: str) -> Matching:
        m = Matching()
        if self.word("on", "ignoring"):
            on = self.next().lower() == "on"
            m = Matching(on, self.names())
            if self.word("group_left", "group_right"):
                side = self.next().lower().removeprefix("group_")
                if op in R.SETS:
                    self.fail(f"no grouping allowed for {op!r} operation")
                include = self.names() if self.is_("(") else ()
                if on and set(include) & set(m.labels):
                    self.fail("a label must not occur in ON and GROUP clause at once")
                m = Matching(on, m.labels, side, include)
        return m

    def names(self) -> tuple[str, ...]:
        self.expect("(")
        out = []
        while not self.is_(")"):
            if self.kind == "string":
                out.append(unquote(self.next()))
            elif self.kind == "name":
                out.append(self.next())
            else:
                self.fail("expected a label name")
            if not self.accept(","):
                break
        self.expect(")")
        return tuple(out)

    def primary(self) -> Expr:
        if self.kind == "number":
            return Number(_number(self.next()))
        if self.kind == "duration":
            return Number(parse_duration(self.next()) / 1000)
        if self.kind == "string":
            return String(unquote(self.next()))
        if self.accept("("):
            inner = self.expression()
            self.expect(")")
            return Paren(inner)
        if self.is_("{"):
            return self.selector(None)
        if self.kind != "name":
            self.fail("expected an expression")
        low = self.value.lower()
        after = self.tokens[self.i + 1][1] if self.i + 1 < len(self.tokens) else ""
        if low in ("inf", "nan") and after != "(":
            self.next()
            return Number(math.inf if low == "inf" else math.nan)
        if (low in R.AGGREGATIONS or low in R.UNSUPPORTED_AGGREGATIONS) and (after == "(" or after.lower() in ("by", "without")):
            return self.aggregate(low)
        if after == "(":
            return self.call()
        return self.selector(self.next())

    def aggregate(self, op: str) -> Expr:
        self.next()
        if op in R.UNSUPPORTED_AGGREGATIONS:
            raise UnsupportedError(f"unsupported PromQL aggregation {op!r}")
        grouping, without = self.grouping()
        self.expect("(")
        args = [] if self.is_(")") else [self.expression()]
        while self.accept(","):
            args.append(self.expression())
        self.expect(")")
        if not grouping and not without and self.word("by", "without"):
            grouping, without = self.grouping()
        want = 2 if op in R.WITH_PARAMETER else 1
        if len(args) != want:
            raise ParseError(f"wrong number of arguments for aggregate expression {op!r}: expected {want}, got {len(args)}")
        return Aggregate(op, args[-1], args[0] if want == 2 else None, grouping, without)

    def grouping(self) -> tuple[tuple[str, ...], bool]:
        if self.word("by", "without"):
            without = self.next().lower() == "without"
            return self.names(), without
        return (), False

    def call(self) -> Expr:
        name = self.next()
        if name in R.UNSUPPORTED_FUNCTIONS:
            raise UnsupportedError(f"unsupported PromQL function {name!r}")
        if name not in R.FUNCTIONS:
            raise ParseError(f"unknown function with name {name!r}")
        self.expect("(")
        args = [] if self.is_(")") else [self.expression()]
        while self.accept(","):
            args.append(self.expression())
        self.expect(")")
        return Call(name, tuple(args))

    def selector(self, name: str | None) -> Expr:
        matchers = [Matcher("__name__", "=", name)] if name is not None else []
        if self.accept("{"):
            while not self.is_("}"):
                if self.kind == "string":
                    label = unquote(self.next())
                    if self.is_(",", "}"):
                        matchers.append(Matcher("__name__", "=", label))
                        self.accept(",")
                        continue
                elif self.kind == "name":
                    label = self.next()
                else:
                    self.fail("expected a label name")
                op = self.value
                if op not in ("=", "!=", "=~", "!~"):
                    self.fail("expected a label matching operator")
                self.next()
                if self.kind != "string":
                    self.fail("expected a quoted label value")
                value = unquote(self.next())
                if op in ("=~", "!~"):
                    check_regex(value)
                if name is not None and label == "__name__":
                    raise ParseError(f"metric name must not be set twice: {name!r} or {value!r}")
                matchers.append(Matcher(label, op, value))
                if not self.accept(","):
                    break
            self.expect("}")
        if not any(not matches_empty(m) for m in matchers):
            raise ParseError("vector selector must contain at least one non-empty matcher")
        return Selector(tuple(matchers))

    def postfix(self, expr: Expr) -> Expr:
        while True:
            if self.accept("["):
                span = self.duration()
                if self.accept(":"):
                    step = 0 if self.is_("]") else self.duration()
                    self.expect("]")
                    expr = Subquery(expr, span, step)
                else:
                    self.expect("]")
                    if not isinstance(expr, Selector):
                        raise ParseError("ranges only allowed for vector selectors")
                    if expr.offset or expr.at is not None:
                        raise ParseError("no offset or @ modifiers allowed before range")
                    expr = Matrix(expr, span)
            elif self.word("offset"):
                self.next()
                sign = -1 if self.accept("-") else 1
                expr = self.modified(expr, offset=sign * self.duration())
            elif self.accept("@"):
                if self.word("start", "end"):
                    at: int | str = self.next().lower()
                    self.expect("(")
                    self.expect(")")
                else:
                    sign = -1 if self.accept("-") else (self.accept("+") and 1 or 1)
                    if self.kind != "number":
                        self.fail("expected a timestamp")
                    at = math.floor(sign * _number(self.next()) * 1000 + 0.5)
                expr = self.modified(expr, at=at)
            else:
                return expr

    def duration(self) -> int:
        if self.kind == "duration":
            return parse_duration(self.next())
        if self.kind == "number":
            return round(_number(self.next()) * 1000)
        self.fail("expected a duration")

    def modified(self, expr: Expr, **change) -> Expr:
        target = expr.selector if isinstance(expr, Matrix) else expr
        if not isinstance(target, Selector | Subquery):
            raise ParseError("offset and @ modifiers must follow a selector or a subquery")
        for k in change:
            if getattr(target, k) not in (0, None):
                raise ParseError(f"{k} may not be set multiple times")
        target = replace(target, **change)
        return Matrix(target, expr.range) if isinstance(expr, Matrix) else target


def _number(text: str) -> float:
    return float(int(text, 16)) if text[:2].lower() == "0x" else float(text)


def check_regex(pattern: str) -> None:
    """Rejects what the language's linear-time dialect has not: back-references and look-around."""
    if re.search(r"\(\?(?:[=!]|<[=!]|>)|(?<!\\)(?:\\\\)*\\[1-9]", pattern):
        raise ParseError(f"unsupported regular expression {pattern!r}")
    try:
        dialect.compile(pattern)
    except (re.error, dialect.error) as e:
        raise ParseError(f"error parsing regexp: {e}") from None


def java_pattern(pattern: str) -> str:
    """A pattern as Java reads it: groups are named without P and underscores."""
    return re.sub(r"(?<!\\)((?:\\\\)*)\(\?P?<([A-Za-z_]\w*)>", lambda m: f"{m[1]}(?<{java_group(m[2])}>", pattern)


def java_group(name: str) -> str:
    return "g" + name.replace("_", "U") if "_" in name else name


def matches(m: Matcher, value: str) -> bool:
    if m.op in ("=", "!="):
        return (m.value == value) == (m.op == "=")
    return bool(dialect.fullmatch(f"(?s:{m.value})", value)) == (m.op == "=~")


def matches_empty(m: Matcher) -> bool:
    return matches(m, "")


def type_of(e: Expr) -> str:
    if isinstance(e, Number):
        return R.SCALAR
    if isinstance(e, String):
        return R.STRING
    if isinstance(e, Matrix | Subquery):
        return R.MATRIX
    if isinstance(e, Paren | Unary):
        return type_of(e.expr)
    if isinstance(e, Binary):
        return R.SCALAR if type_of(e.left) == type_of(e.right) == R.SCALAR else R.VECTOR
    if isinstance(e, Call):
        return R.FUNCTIONS[e.name].result
    return R.VECTOR


def _need(e: Expr, kind: str, where: str) -> None:
    if type_of(e) != kind:
        raise ParseError(f"expected type {kind} in {where}, got {type_of(e)}")


def check(e: Expr) -> None:
    """Raises where an operand has a type that its operator does not take."""
    if isinstance(e, Paren):
        check(e.expr)
    elif isinstance(e, Unary):
        check(e.expr)
        if type_of(e.expr) not in (R.SCALAR, R.VECTOR):
            raise ParseError(f"unary expression only allowed on expressions of type scalar or instant vector, got {type_of(e.expr)}")
    elif isinstance(e, Subquery):
        check(e.expr)
        _need(e.expr, R.VECTOR, "subquery") if type_of(e.expr) != R.SCALAR else None
        if e.range <= 0:
            raise ParseError("duration must be greater than 0")
    elif isinstance(e, Matrix):
        if e.range <= 0:
            raise ParseError("duration must be greater than 0")
    elif isinstance(e, Aggregate):
        check(e.expr)
        _need(e.expr, R.VECTOR, "aggregation expression")
        if e.param is not None:
            check(e.param)
            _need(e.param, R.WITH_PARAMETER[e.op], "aggregation parameter")
    elif isinstance(e, Call):
        f = R.FUNCTIONS[e.name]
        least, most = len(f.args) - f.optional, None if f.repeat else len(f.args)
        if len(e.args) < least or (most is not None and len(e.args) > most):
            raise ParseError(f"expected {least} argument(s) in call to {e.name!r}, got {len(e.args)}")
        for i, a in enumerate(e.args):
            check(a)
            _need(a, f.args[min(i, len(f.args) - 1)], f"call to function {e.name!r}")
    elif isinstance(e, Binary):
        check(e.left)
        check(e.right)
        for side in (e.left, e.right):
            if type_of(side) not in (R.SCALAR, R.VECTOR):
                raise ParseError("binary expression must contain only scalar and instant vector types")
        scalars = [type_of(x) == R.SCALAR for x in (e.left, e.right)]
        if all(scalars) and e.op in R.COMPARISON and not e.bool_:
            raise ParseError("comparisons between scalars must use BOOL modifier")
        if any(scalars):
            if e.op in R.SETS:
                raise ParseError(f"set operator {e.op!r} not allowed in binary scalar expression")
            if e.matching.labels or e.matching.on or e.matching.group:
                raise ParseError("vector matching only allowed between instant vectors")


def parse(text: str) -> Expr:
    """A checked tree, or ``ParseError``."""
    p = _Parser(text)
    expr = p.expression()
    if p.kind != "end":
        p.fail("unexpected input")
    check(expr)
    return expr


def parse_selector(text: str) -> Selector:
    """A bare selector, as metadata requests take it."""
    expr = parse(text)
    while isinstance(expr, Paren):
        expr = expr.expr
    if not isinstance(expr, Selector):
        raise ParseError(f"not a series selector: {text!r}")
    return expr
