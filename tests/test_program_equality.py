"""Equality of programs against quotients of polynomials that are multiplied out."""

from __future__ import annotations

import random
import time
from fractions import Fraction

import pytest

from tallyquill.operators import programs


class Quotient:
    """A quotient of polynomials with exact coefficients; monomials are sorted tuples of symbols."""

    def __init__(self, num: dict, den: dict) -> None:
        self.num, self.den = num, den

    @staticmethod
    def symbol(name) -> Quotient:
        return Quotient({(name,): Fraction(1)}, {(): Fraction(1)})

    @staticmethod
    def _times(a: dict, b: dict) -> dict:
        out: dict = {}
        for x, p in a.items():
            for y, q in b.items():
                k = tuple(sorted((*x, *y), key=repr))
                out[k] = out.get(k, 0) + p * q
        return {k: v for k, v in out.items() if v}

    @staticmethod
    def _plus(a: dict, b: dict, sign: int) -> dict:
        out = dict(a)
        for k, v in b.items():
            out[k] = out.get(k, 0) + sign * v
        return {k: v for k, v in out.items() if v}

    def combine(self, other: Quotient, op: str) -> Quotient:
        t = self._times
        if op == "multiply":
            return Quotient(t(self.num, other.num), t(self.den, other.den))
        if op == "divide":
            if not other.num:
                raise ZeroDivisionError
            return Quotient(t(self.num, other.den), t(self.den, other.num))
        return Quotient(self._plus(t(self.num, other.den), t(other.num, self.den), 1 if op == "add" else -1), t(self.den, other.den))

    def same(self, other: Quotient) -> bool:
        return self._times(self.num, other.den) == self._times(other.num, self.den)

    def key(self):
        return tuple(sorted(self.num.items(), key=repr)), tuple(sorted(self.den.items(), key=repr))


def exactly_equal(gold, pred):
    """Both last steps multiplied out; operands and references are taken to be in order."""

    def value(steps, i):
        op, a, b = steps[i]
        x, y = (value(steps, int(s[1:])) if s[0] == "#" else Quotient.symbol(s) for s in (a, b))
        return x.combine(y, op) if op in ("add", "subtract", "multiply", "divide") else Quotient.symbol((op, a, b))

    try:
        return value(gold, len(gold) - 1).same(value(pred, len(pred) - 1))
    except ZeroDivisionError:
        return False


def tokens(steps):
    return [t for op, a, b in steps for t in (op + "(", a, b, ")")] + ["EOF"]


def random_steps(rng, n, operands):
    out = []
    for i in range(n):
        op = rng.choice(["add", "subtract", "multiply", "divide", "add", "multiply", "exp", "greater"])
        known = operands + ([f"#{j}" for j in range(i)] * 3 if op not in ("exp", "greater") else [])
        out.append((op, rng.choice(known), rng.choice(known)))
    return out


def other_way(rng, steps):
    """The same expression: sums and products swapped, a - b as a + (0 - b) where it can be, or one step changed."""
    out = [(op, b, a) if op in ("add", "multiply") and rng.random() < 0.5 else (op, a, b) for op, a, b in steps]
    if rng.random() < 0.4:
        i = rng.randrange(len(out))
        out[i] = (rng.choice(["add", "subtract", "multiply", "divide"]), *out[i][1:])
    return out


def test_P4_agrees_with_multiplying_out():
    rng = random.Random(8)
    seen = {True: 0, False: 0}
    for _ in range(3000):
        operands = ["1", "2", "x", "y"][: rng.randint(1, 4)]
        gold = random_steps(rng, rng.randint(1, 5), operands)
        pred = other_way(rng, gold) if rng.random() < 0.7 else random_steps(rng, rng.randint(1, 4), operands)
        if any(x[0] != "#" and x not in {y for s in gold for y in s[1:]} for s in pred for x in s[1:]):
            continue
        want = exactly_equal(gold, pred)
        assert programs.programs_equal(tokens(gold), tokens(pred)) == want, (gold, pred)
        seen[want] += 1
    assert min(seen.values()) > 300


@pytest.mark.parametrize("n", [60, 400, 1500])
def test_P4_takes_time_by_steps(n):
    """Squaring doubles the degree at each step; the sum of two equal ones is twice one, the product isn't."""
    square = [("add", "a", "b")] + [("multiply", f"#{i}", f"#{i}") for i in range(n)]
    swapped = [("add", "b", "a"), *square[1:]]
    less = [*square[:-1], ("multiply", f"#{n - 1}", f"#{n - 2}")]
    programs.programs_equal(tokens(square), tokens(square))  # the prime is chosen once
    began = time.time()
    assert programs.programs_equal(tokens(square), tokens(swapped)) and not programs.programs_equal(tokens(square), tokens(less))
    assert time.time() - began < (1 if n == 60 else 20)


def test_P4_multiples_of_a_prime_are_not_nothing():
    """2^127 - 1 times a isn't a - a, though it is modulo that prime."""
    twice = [("subtract", "a", "a"), ("add", "a", "a")] + [("add", f"#{i}", f"#{i}") for i in range(1, 127)] + [("subtract", "#127", "a")]
    assert not programs.programs_equal(tokens(twice[:1]), tokens(twice)) and programs.programs_equal(tokens(twice), tokens(twice))


def test_P4_programs_without_meaning():
    assert not programs.programs_equal(tokens([("subtract", "a", "a"), ("divide", "a", "#0")]), tokens([("subtract", "a", "a"), ("divide", "a", "#0")]))
    assert not programs.programs_equal(tokens([("add", "a", "#0")]), tokens([("add", "a", "a")])) and not programs.programs_equal(tokens([("add", "#x", "a")]), tokens([("add", "a", "a")]))
    deep = [("add", "a", "b")] + [("add", f"#{i}", "a") for i in range(3000)]
    assert programs.programs_equal(tokens(deep), tokens(deep))
    power = [("add", "a", "b"), ("exp", "#0", "a")]
    assert programs.programs_equal(tokens(power), tokens([("add", "b", "a"), ("exp", "#0", "a")])) and not programs.programs_equal(tokens(power), tokens([("add", "a", "a"), ("exp", "#0", "a")]))
