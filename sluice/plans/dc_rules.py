"""Denial constraints: NOT (p1 AND ... AND pn) over ordered pairs (s, t), s not t."""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

_OPS = {"=": "=", "==": "=", "<>": "<>", "!=": "<>", ">": ">", "<": "<", ">=": ">=", "<=": "<="}
_NAMES = {"EQUAL": "=", "LESS": "<", "LESS_EQUAL": "<=", "GREATER": ">", "GREATER_EQUAL": ">=", "UNEQUAL": "<>"}
INVERSE = {"=": "<>", "<>": "=", ">": "<=", "<=": ">", "<": ">=", ">=": "<"}
SWAP = {"=": "=", "<>": "<>", ">": "<", "<": ">", ">=": "<=", "<=": ">="}


def compare(op: str, a: Column, b: Column) -> Column:
    return {"=": a == b, "<>": a != b, ">": a > b, "<": a < b, ">=": a >= b, "<=": a <= b}[op]


@dataclass(frozen=True)
class Predicate:
    """s.left op t.right; or op a number where ``constant`` is set. ``plus`` widens by ratio and shift."""

    left: str
    op: str
    right: str = ""
    constant: float | None = None

    @property
    def same(self) -> bool:
        return self.constant is None and self.left == self.right

    @property
    def key(self) -> bool:
        return self.op == "=" and self.constant is None

    def swapped(self) -> "Predicate":
        return Predicate(self.right, SWAP[self.op], self.left)

    def inverted(self) -> "Predicate":
        return Predicate(self.left, INVERSE[self.op], self.right, self.constant)

    def column(self, s: str = "s", t: str = "t") -> Column:
        """Typed comparison; a null on either side makes it not hold."""
        other = F.lit(self.constant) if self.constant is not None else F.col(f"{t}.{self.right}")
        return compare(self.op, F.col(f"{s}.{self.left}"), other)


@dataclass(frozen=True)
class Rule:
    predicates: tuple[Predicate, ...]
    name: str = "dc"

    @property
    def keys(self) -> list[Predicate]:
        return [p for p in self.predicates if p.key]

    @property
    def order(self) -> list[Predicate]:
        return [p for p in self.predicates if p.op not in ("=", "<>") and p.constant is None]

    @property
    def rest(self) -> list[Predicate]:
        """Other conjuncts, the most selective kinds first."""
        return sorted((p for p in self.predicates if not p.key), key=lambda p: (p.constant is None, p.op == "<>"))

    @property
    def signature(self) -> tuple[tuple[str, str], ...]:
        return tuple(sorted((p.left, p.right) for p in self.keys))

    @property
    def symmetric(self) -> bool:
        """(s, t) violates iff (t, s) does."""
        return all(p.same and p.op in ("=", "<>") for p in self.predicates)

    def mode(self, name: str) -> "Rule":
        """``violation`` as written, ``inverted_inequalities`` or ``inverted_all``: rules that state the normal case."""
        if name == "violation":
            return self
        flip = {"inverted_inequalities": lambda p: p.op != "=", "inverted_all": lambda p: True}[name]
        return Rule(tuple(p.inverted() if flip(p) else p for p in self.predicates), self.name)

    def decomposed(self) -> list["Rule"]:
        """Without ``<>``: each is a ``>`` and a ``<`` branch."""
        for i, p in enumerate(self.predicates):
            if p.op == "<>":
                made = [Rule(self.predicates[:i] + (Predicate(p.left, op, p.right, p.constant),) + self.predicates[i + 1 :], self.name) for op in (">", "<")]
                return [r for m in made for r in m.decomposed()]
        return [self]

    def column(self) -> Column:
        return reduce(lambda a, b: a & b, (p.column() for p in self.predicates), F.lit(True))


def rule(text: str, name: str = "dc") -> Rule:
    """``a = a, price > price, tax < 5``: one predicate per comma or line; malformed parts are a ValueError."""
    out = []
    for part in text.replace("\n", ",").split(","):
        if not part.strip():
            continue
        bits = part.split()
        if len(bits) != 3 or bits[1] not in _OPS:
            raise ValueError(f"no predicate: {part!r}")
        try:
            out.append(Predicate(bits[0], _OPS[bits[1]], "", float(bits[2])))
        except ValueError:
            out.append(Predicate(bits[0], _OPS[bits[1]], bits[2]))
    return Rule(tuple(out), name)


def parse_text(lines: str) -> tuple[Rule, list[str]]:
    """One predicate per line; returns the rule and the lines that were discarded."""
    good, bad = [], []
    for line in lines.splitlines():
        try:
            good += rule(line).predicates
        except ValueError:
            bad.append(line)
    return Rule(tuple(good)), bad


def parse_index_json(text: str, columns: list[str]) -> list[Rule]:
    """Constraints by column index: lists of {colIdx1, colIdx2, op}."""
    data = json.loads(text)
    rules = data["constraints"] if isinstance(data, dict) else data
    return [Rule(tuple(Predicate(columns[p["colIdx1"]], _NAMES.get(p["op"], _OPS.get(p["op"], p["op"])), columns[p["colIdx2"]]) for p in r), f"dc{i}") for i, r in enumerate(rules)]


def parse_side_json(rules: list[dict]) -> list[Rule]:
    """Named predicates whose sides end in _s and _t, or a number on the right."""
    strip = lambda c: c[:-2] if c.endswith(("_s", "_t")) else c
    out = []
    for r in rules:
        preds = []
        for p in r["predicates"]:
            op, right = _NAMES.get(p["operator"], p["operator"]), p["right"]
            number = isinstance(right, (int, float))
            preds.append(Predicate(strip(p["left"]), op, "" if number else strip(right), float(right) if number else None))
        out.append(Rule(tuple(preds), r.get("id", "dc")))
    return out


@dataclass
class Group:
    signature: tuple
    rules: list[Rule] = field(default_factory=list)
    dims: list[str] = field(default_factory=list)


def group_rules(rules: list[Rule], k_max: int = 5) -> list[Group]:
    """Greedy: rules of one equality signature share a group up to ``k_max`` ordered columns."""
    out: list[Group] = []
    for r in rules:
        cols = sorted({p.left for p in r.order} | {p.right for p in r.order})
        for g in out:
            union = sorted(set(g.dims) | set(cols))
            if g.signature == r.signature and len(union) <= k_max:
                g.rules.append(r)
                g.dims = union
                break
        else:
            out.append(Group(r.signature, [r], cols))
    return out
