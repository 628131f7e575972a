"""Exact arithmetic on short answers: a recursive-descent reader with rationals, and a canonical form.

The canonical form flattens sums and products, folds subtraction and division
into them, and sorts the parts; it doesn't distribute or simplify.  Nothing is
ever evaluated by the interpreter.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from fractions import Fraction

_TOKEN = re.compile(r"\s*(?:(\d+)|(.))", re.S)


class NotArithmetic(ValueError):
    """The text isn't a fully bracketed use of + - * / on whole numbers."""


@dataclass(frozen=True)
class Term:
    """A number, or a sum or product with its plain parts and its inverse parts."""

    kind: str
    plain: tuple
    inverse: tuple = ()

    def text(self) -> str:
        if self.kind == "number":
            return str(self.plain[0])
        mark, back, empty = ("+", "-", "0") if self.kind == "sum" else ("*", "/", "1")
        out = mark.join(t.text() for t in self.plain) or empty
        if self.kind == "sum":
            out += "".join(back + t.text() for t in self.inverse)
        elif self.inverse:
            below = mark.join(t.text() for t in self.inverse)
            out += back + (f"({below})" if len(self.inverse) > 1 else below)
        return f"({out})"

    def joined(self, other: Term, kind: str, inverted: bool) -> Term:
        a, b = (t if t.kind == kind else Term(kind, (t,)) for t in (self, other))
        swap = (b.inverse, b.plain) if inverted else (b.plain, b.inverse)
        plain, inverse = (tuple(sorted(x + y, key=Term.text)) for x, y in ((a.plain, swap[0]), (a.inverse, swap[1])))
        return plain[0] if len(plain) == 1 and not inverse else Term(kind, plain, inverse)


class _Reader:
    def __init__(self, text: str):
        self.tokens = [(int(n) if n else None, c) for n, c in _TOKEN.findall(text.strip()) if n or c.strip()]
        if re.search(r"(?<!\d)0\d", text):
            raise NotArithmetic("a number with a leading zero")
        if re.search(r"\d\s+\d", text):
            raise NotArithmetic("two numbers in a row")
        self.at, self.used = 0, []

    def peek(self) -> str | None:
        return self.tokens[self.at][1] if self.at < len(self.tokens) and self.tokens[self.at][0] is None else None

    def level(self, marks: str, kind: str, below) -> tuple[Fraction, Term]:
        value, term = below()
        while (mark := self.peek()) is not None and mark in marks:
            self.at += 1
            right, other = below()
            if mark == "/" and right == 0:
                raise NotArithmetic("division by zero")
            value = {"+": value.__add__, "-": value.__sub__, "*": value.__mul__, "/": value.__truediv__}[mark](right)
            term = term.joined(other, kind, mark in "-/")
        return value, term

    def total(self) -> tuple[Fraction, Term]:
        return self.level("+-", "sum", self.product)

    def product(self) -> tuple[Fraction, Term]:
        return self.level("*/", "product", self.atom)

    def atom(self) -> tuple[Fraction, Term]:
        if self.at >= len(self.tokens):
            raise NotArithmetic("the text ends early")
        number, mark = self.tokens[self.at]
        self.at += 1
        if number is not None:
            self.used.append(number)
            return Fraction(number), Term("number", (number,))
        if mark != "(":
            raise NotArithmetic(f"unexpected {mark!r}")
        out = self.total()
        if self.peek() != ")":
            raise NotArithmetic("a bracket isn't closed")
        self.at += 1
        return out


def read(text: str) -> tuple[Fraction, list[int], str]:
    """Value, numbers used, and canonical form."""
    reader = _Reader(text)
    value, term = reader.total()
    if reader.at != len(reader.tokens):
        raise NotArithmetic("text is left over")
    return value, reader.used, term.text()


def canonical(text: str | None, numbers: list[int] | None, target: int = 24) -> str | None:
    """The canonical form of an expression that uses exactly the numbers and hits the target, else null."""
    try:
        value, used, form = read(text or "")
    except (NotArithmetic, RecursionError):
        return None
    return form if value == target and sorted(used) == sorted(numbers or []) else None
