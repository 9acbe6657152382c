"""Secret scans with one combined deterministic automaton.

The rules' expressions are parsed to one Thompson automaton, made deterministic by subset construction over byte
classes and minimised (Moore's partition refinement) into a transition array. A batch's texts are laid end to end and
read once for all rules: the bytes are cut into equal lanes that step together through the transition array; a lane
whose guessed start state proves wrong is read again only until its states agree. An accepting state names the rules
of which a match ends at that byte.

Where a rule ends first, its backward automaton finds the match's leftmost start and its forward automaton the longest
end; the next match of that rule starts no earlier than there. That is the leftmost-longest, non-overlapping reading of
each rule, for rules of which no match that starts earlier ends first later (true of all rules here, tested at random
against a backtracking engine). Too short matches are dropped after they have consumed their text.

Edge cases: null texts are read as empty; positions are code points of the whole text, ends exclusive; rows are
independent, so repeated rows and ties need no rule.
"""

from __future__ import annotations

from collections import defaultdict
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import small_batches, table


@dataclass(frozen=True)
class Rule:
    """A kind of secret. tail: bytes its value (from the byte at which a match can first end) must have; least: the match."""

    kind: str
    pattern: str
    least: int = 0
    tail: int = 0
    base: bool = True


VALUE = "A-Za-z0-9+/_.=-"
RULES = (
    Rule("assign", r"(password|passwd|secret|token|api_?key)i[\"']?\x20*[:=]\x20*[\"']?[" + VALUE + "]+", tail=6),
    Rule("access", r"AKIA[A-Z0-9]+", least=20),
    Rule("hex", r"[0-9a-f]+", least=24),
    # kinds that the automaton adds
    Rule("temporary_access", r"ASIA[A-Z0-9]+", least=20, base=False),
    Rule("forge_token", r"gh(p|o|u|s|r)_[A-Za-z0-9]+", least=40, base=False),
    Rule("web_token", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", least=40, base=False),
    Rule("private_key", r"-----BEGIN( [A-Z]+)* PRIVATE KEY-----", base=False),
)


class _Parser:
    """Expressions of literals, classes, groups, | ? * + and a group suffix i (ASCII letters in either case)."""

    def __init__(self, pattern: str) -> None:
        self.s, self.i = pattern, 0

    def parse(self):
        out = self.alternatives()
        if self.i != len(self.s):
            raise ValueError(f"stray {self.s[self.i]!r} in {self.s!r}")
        return out

    def peek(self) -> str:
        return self.s[self.i] if self.i < len(self.s) else ""

    def alternatives(self):
        branches = [self.sequence()]
        while self.peek() == "|":
            self.i += 1
            branches.append(self.sequence())
        return ("or", branches) if len(branches) > 1 else branches[0]

    def sequence(self):
        parts = []
        while self.peek() not in ("", "|", ")"):
            atom = self.atom()
            while self.peek() and self.peek() in "?*+":
                atom = (self.peek(), atom)
                self.i += 1
            parts.append(atom)
        return ("and", parts)

    def char(self) -> int:
        c = self.s[self.i]
        self.i += 1
        if c != "\\":
            return ord(c)
        c = self.s[self.i]
        self.i += 1
        if c == "x":
            self.i += 2
            return int(self.s[self.i - 2 : self.i], 16)
        return ord(c)

    def atom(self):
        if self.peek() == "(":
            self.i += 1
            inner = self.alternatives()
            if self.peek() != ")":
                raise ValueError("missing )")
            self.i += 1
            if self.peek() == "i":
                self.i += 1
                inner = _either_case(inner)
            return inner
        if self.peek() == "[":
            self.i += 1
            found: set[int] = set()
            while self.peek() != "]":
                a = self.char()
                if self.peek() == "-" and self.s[self.i + 1] != "]":
                    self.i += 1
                    found.update(range(a, self.char() + 1))
                else:
                    found.add(a)
            self.i += 1
            return ("set", frozenset(found))
        return ("set", frozenset([self.char()]))


def _either_case(node):
    kind, arg = node
    if kind == "set":
        return kind, frozenset(x for b in arg for x in (ord(chr(b).lower()), ord(chr(b).upper())))
    return kind, [_either_case(x) for x in arg] if kind in ("or", "and") else _either_case(arg)


def _backward(node):
    kind, arg = node
    if kind == "set":
        return node
    return kind, [_backward(x) for x in (reversed(arg) if kind == "and" else arg)] if kind in ("or", "and") else _backward(arg)


class _Nfa:
    def __init__(self) -> None:
        self.free: list[list[int]] = []
        self.moves: list[list[tuple[frozenset, int]]] = []

    def state(self) -> int:
        self.free.append([])
        self.moves.append([])
        return len(self.free) - 1

    def add(self, node, a: int) -> int:
        """From state a on; returns the end state."""
        kind, arg = node
        if kind == "set":
            b = self.state()
            self.moves[a].append((arg, b))
            return b
        if kind == "and":
            for x in arg:
                a = self.add(x, a)
            return a
        end = self.state()
        if kind == "or":
            for x in arg:
                begin = self.state()
                self.free[a].append(begin)
                self.free[self.add(x, begin)].append(end)
            return end
        begin = self.state()
        self.free[a].append(begin)
        stop = self.add(arg, begin)
        self.free[stop].append(end)
        if kind in "?*":
            self.free[a].append(end)
        if kind in "*+":
            self.free[stop].append(begin)
        return end


class Dfa:
    """Minimal automaton; step[state, class of byte]; accepts: bit mask of the patterns that end in the state."""

    def __init__(self, nodes: list, anywhere: bool) -> None:
        """anywhere: a match may start at any byte."""
        nfa = _Nfa()
        root = nfa.state()
        ends = {}
        for n, node in enumerate(nodes):
            begin = nfa.state()
            nfa.free[root].append(begin)
            ends[nfa.add(node, begin)] = n
        sets = {s for m in nfa.moves for s, _ in m}
        of: dict[tuple, int] = {}
        self.classes = np.array([of.setdefault(tuple(b in s for s in sets), len(of)) for b in range(256)], np.uint8)
        member = {c: int(np.flatnonzero(self.classes == c)[0]) for c in range(len(of))}

        def closure(states) -> frozenset:
            seen, todo = set(states), list(states)
            while todo:
                for t in nfa.free[todo.pop()]:
                    if t not in seen:
                        seen.add(t)
                        todo.append(t)
            return frozenset(seen)

        start = closure([root])
        number, rows, todo = {start: 0}, [], [start]
        while todo:
            own = todo.pop(0)
            row = []
            for c in range(len(of)):
                to = closure({t for s in own for on, t in nfa.moves[s] if member[c] in on} | ({root} if anywhere else set()))
                if to not in number:
                    number[to] = len(number)
                    todo.append(to)
                row.append(number[to])
            rows.append(row)
        step = np.array(rows, np.int32)
        mask = np.array([sum(1 << n for s, n in ends.items() if s in own) for own in number], np.int64)
        part = np.unique(mask, return_inverse=True)[1]
        while True:  # refine until states of a part move alike
            new = np.unique(np.c_[part, part[step]], axis=0, return_inverse=True)[1].ravel()
            if new.max() == part.max():
                break
            part = new
        first = np.unique(part, return_index=True)[1]
        self.step, self.accepts, self.start = part[step[first]].astype(np.int32), mask[first], int(part[0])
        none = [s for s in range(len(first)) if (self.step[s] == s).all() and not self.accepts[s]]
        self.dead = none[0] if none and not anywhere else -1

    def scan(self, data: np.ndarray, resets: np.ndarray, lanes: int = 4096) -> np.ndarray:
        """State after each byte; before the bytes at ``resets`` the automaton starts anew."""
        n, width = len(data), len(self.step[0])
        per = max(64, -(-n // lanes))
        lanes = -(-n // per)
        # One row more for each class: what the byte does to a fresh automaton.
        cls = self.classes[data].astype(np.int16)
        cls[resets[resets < n]] += width
        step = np.c_[self.step, np.broadcast_to(self.step[self.start], self.step.shape)].astype(np.int16).ravel()
        wide = 2 * width
        cells = np.zeros(lanes * per, np.int16)
        cells[:n] = cls
        cells = np.ascontiguousarray(cells.reshape(lanes, per).T)
        states = np.empty((per, lanes), np.int16)
        now = np.full(lanes, self.start, np.int32)
        for j in range(per):
            now = step[now * wide + cells[j]]
            states[j] = now
            now = now.astype(np.int32)
        guess = self.start
        for lane in range(1, lanes):  # mend lanes that began in another state than assumed
            s = int(states[per - 1, lane - 1])
            if s != guess:
                for j in range(per):
                    s = int(step[s * wide + int(cells[j, lane])])
                    if s == states[j, lane]:
                        break
                    states[j, lane] = s
        return states.T.ravel()[:n]

    def longest(self, data: bytes, at: int, stop: int, back: bool = False) -> tuple[int, int]:
        """Positions at which the first and the last match from ``at`` end (backward: begin); -1 where there is none."""
        s, first, last = self.start, -1, -1
        for i in range(at - 1, stop - 1, -1) if back else range(at, stop):
            s = self.step[s, self.classes[data[i]]]
            if s == self.dead:
                break
            if self.accepts[s]:
                last = i if back else i + 1
                first = last if first < 0 else first
        return first, last


class Scanner:
    """All rules in one automaton, and each rule's own automata for a match's start and end."""

    def __init__(self, rules: tuple[Rule, ...] = RULES) -> None:
        self.rules = rules
        nodes = [_Parser(r.pattern).parse() for r in rules]
        self.run_least = [self._run_least(r) for r in rules]
        self.all = Dfa(nodes, True)
        self.forward = [Dfa([n], False) for n in nodes]
        self.back = [Dfa([_backward(n)], False) for n in nodes]

    def spans(self, texts: list[bytes]) -> list[list[tuple[int, int, int]]]:
        """(start, rule, end) in bytes of each text's matches, in that order."""
        found: list[list[tuple[int, int, int]]] = [[] for _ in texts]
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        ends = np.cumsum(sizes)
        if not len(ends) or not ends[-1]:
            return found
        whole = b"".join(texts)
        data = np.frombuffer(whole, np.uint8)
        begins = ends - sizes
        states = self.all.scan(data, np.unique(begins[sizes > 0]))
        for r, rule in enumerate(self.rules):
            hit = (self.all.accepts >> r & 1).astype(bool)[states]
            edges = np.flatnonzero(np.diff(np.r_[False, hit, False].astype(np.int8)))
            first, past = edges[::2], edges[1::2]
            # A match that is long enough has a run of so many successive ends; shorter runs are left out at once.
            docs = np.searchsorted(ends, first, side="right")
            keep = (past - first >= self.run_least[r]) | (past > ends[docs])
            first, past, docs = first[keep], past[keep], docs[keep]
            free: dict[int, int] = defaultdict(lambda: -1)
            for a, z, d in zip(first.tolist(), past.tolist(), docs.tolist()):
                while a < z:
                    begin, stop = int(begins[d]), int(ends[d])
                    if a >= stop:
                        d += 1
                        while int(ends[d]) <= a:
                            d += 1
                        continue
                    floor = max(begin, free[d])
                    if a < floor:
                        a = floor
                        continue
                    _, start = self.back[r].longest(whole, a + 1, floor, True)
                    if start < 0:
                        a += 1
                        continue
                    head, end = self.forward[r].longest(whole, start, stop)
                    free[d] = end
                    if end - start >= rule.least and (not rule.tail or end - head + 1 >= rule.tail):
                        found[d].append((start - begin, r, end - begin))
                    a = end
        for own in found:
            own.sort()
        return found

    @staticmethod
    def _run_least(rule: Rule) -> int:
        """Least number of successive ends in a match of ``least`` bytes, where the pattern is a fixed head and one class repeated."""
        head = rule.pattern.find("[")
        if rule.tail or not rule.least or head < 0:
            return 1
        simple = rule.pattern.count("[") == 1 and rule.pattern.endswith("]+") and not set(rule.pattern[:head]) & set("(|?*+\\")
        return rule.least - head if simple else 1


def _points(text: bytes, spans: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """The spans in code points."""
    data = np.frombuffer(text, np.uint8)
    before = np.r_[0, np.cumsum((data & 0xC0) != 0x80)]
    return [(int(before[a]), r, int(before[z])) for a, r, z in spans]


_scanners: dict[tuple, Scanner] = {}
#: Bytes of text that are scanned together.
CHUNK = 8_000_000


def scanner_of(rules: tuple[Rule, ...]) -> Scanner:
    """The automata of these rules, made once in each worker."""
    if rules not in _scanners:
        _scanners[rules] = Scanner(rules)
    return _scanners[rules]


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(doc_id, spans array of (kind, start, end, base)) of every row, by start, then by rule as listed."""

    def run(batches):
        own = scanner_of(rules)
        for b in batches:
            rows, held, size = [], [], 0
            texts = b.column("text")
            for i in range(len(texts)):
                held.append((texts[i].as_py() or "").encode("utf-8", "surrogatepass"))
                size += len(held[-1])
                if size > CHUNK or i == len(texts) - 1:
                    for text, spans in zip(held, own.spans(held)):
                        rows.append([{"kind": rules[r].kind, "start": a, "end": z, "base": rules[r].base} for a, r, z in _points(text, spans)] if spans else [])
                    held, size = [], 0
            kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_())]))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(rows, kind)], ["doc_id", "spans"])

    src = small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return src.mapInArrow(run, "doc_id long, spans array<struct<kind:string,start:long,end:long,base:boolean>>")


def op1_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's secrets: counts of the base kinds, a digest of their spans, and all spans."""
    found = scan(table(spark, sf_dir, "documents"))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    text = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    return found.select(
        "doc_id", count("assign").alias("n_assign"), count("access").alias("n_access"), count("hex").alias("n_hex"),
        F.sha2(text(F.filter("spans", lambda s: s["base"])), 256).alias("base_sha256"), text(F.col("spans")).alias("spans"),
    )
