"""Secret scans with one combined deterministic automaton.

The expressions of all rules are compiled into one automaton by subset construction, minimised, and laid out as one
transition array over byte classes. A scan reads every byte of a text once for all rules and notes where rules accept.
Only for rules that accepted anywhere, the rule's own minimal automaton then fixes leftmost, longest, non-overlapping
matches, as the rule's expression defines them; matches that are too short are dropped after they took their bytes.
"""

from __future__ import annotations

from collections import defaultdict
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame

from skywharf.llm.rows import text_batches
from skywharf.llm.words import bounded


@dataclass(frozen=True)
class Rule:
    """``head`` and ``run`` together define the matches; ``least`` bytes of the run, or of the match without a head, are needed.

    ``gate`` is what the combined automaton looks for: any match that is kept contains a match of it. By default that
    is the match up to the first byte of its final run, so that open runs of many rules do not multiply the states.
    """

    kind: str
    run: str
    least: int
    head: str = ""
    gate: str | None = None


#: The kinds that are always reported, in the order in which they are listed.
BASE = (
    Rule("assign", r"[A-Za-z0-9+/_.=-]+", 12, head=r"(?i:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?"),
    Rule("access", r"AKIA[A-Z0-9]+", 18),
    Rule("hex", r"[0-9a-f]+", 16, gate=r"[0-9a-f]{16}"),
)
#: Public formats of issued credentials.
ISSUED = (
    Rule("session", r"ASIA[A-Z0-9]+", 18),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]+", 40),
    Rule("gitlab", r"glpat-[A-Za-z0-9_-]+", 26),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]+", 20),
    Rule("google", r"AIza[A-Za-z0-9_-]+", 39),
    Rule("stripe", r"[rs]k_live_[A-Za-z0-9]+", 28),
    Rule("npm", r"npm_[A-Za-z0-9]+", 40),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 40, gate=r"\.eyJ"),
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 1, gate="PRIVATE KEY-----"),
    Rule("bearer", r"[A-Za-z0-9._~+/=-]+", 20, head=r"(?i:authorization: bearer )"),
    Rule("login", r"(https?|ftp|ssh|git|postgres|postgresql|mysql|mongodb|redis|amqp)://[A-Za-z0-9._-]+:[A-Za-z0-9._!$&*+-]+@", 10, gate=r"://[A-Za-z0-9._-]+:[A-Za-z0-9._!$&*+-]"),
)
RULES = BASE + ISSUED


class Expression:
    """Non-deterministic automaton of one expression: literals, classes, groups, ``| ? * + {n}`` and ``(?i:...)``."""

    def __init__(self, text: str):
        self.text, self.at, self.fold = text, 0, False
        self.empty: list[list[int]] = []
        self.moves: list[tuple[frozenset[int], int] | None] = []
        self.start, self.accept = self._either()

    def _state(self) -> int:
        self.empty.append([])
        self.moves.append(None)
        return len(self.empty) - 1

    def _peek(self) -> str:
        return self.text[self.at : self.at + 1]

    def _either(self):
        branches = [self._sequence()]
        while self._peek() == "|":
            self.at += 1
            branches.append(self._sequence())
        if len(branches) == 1:
            return branches[0]
        first, last = self._state(), self._state()
        for a, b in branches:
            self.empty[first].append(a)
            self.empty[b].append(last)
        return first, last

    def _sequence(self):
        first = last = self._state()
        while self._peek() not in ("", "|", ")"):
            a, b = self._repeated()
            self.empty[last].append(a)
            last = b
        return first, last

    def _repeated(self):
        begin, states = self.at, len(self.empty)
        a, b = self._atom()
        sign = self._peek()
        if sign == "{":
            stop = self.text.index("}", self.at)
            count, after = int(self.text[self.at + 1 : stop]), stop + 1
            for _ in range(count - 1):
                self.at = begin
                c, d = self._atom()
                self.empty[b].append(c)
                b = d
            self.at = after
        elif sign and sign in "?*+":
            self.at += 1
            first, last = self._state(), self._state()
            self.empty[first].append(a)
            self.empty[b].append(last)
            if sign != "+":
                self.empty[first].append(last)
            if sign != "?":
                self.empty[b].append(a)
            a, b = first, last
        assert len(self.empty) > states
        return a, b

    def _atom(self):
        sign = self._peek()
        self.at += 1
        if sign == "(":
            outer = self.fold
            if self.text.startswith("?i:", self.at):
                self.at, self.fold = self.at + 3, True
            part = self._either()
            self.at, self.fold = self.at + 1, outer
            return part
        if sign == "[":
            stop = self.at
            while self.text[stop] != "]":
                stop += 1 + (self.text[stop] == "\\")
            found, self.at = byte_class(self.text[self.at : stop]), stop + 1
        elif sign == "\\":
            found = {int(self.text[self.at + 1 : self.at + 3], 16) if self._peek() == "x" else ord(self._peek())}
            self.at += 3 if self._peek() == "x" else 1
        else:
            found = {ord(sign)}
        if self.fold:
            found = {x for c in found for x in (ord(chr(c).lower()), ord(chr(c).upper()))}
        a, b = self._state(), self._state()
        self.moves[a] = (frozenset(found), b)
        return a, b


def byte_class(text: str) -> set[int]:
    """Bytes of the inside of a character class."""
    found: set[int] = set()
    signs = []
    at = 0
    while at < len(text):
        if text[at] == "\\":
            size = 4 if text[at + 1] == "x" else 2
            signs.append((int(text[at + 2 : at + 4], 16) if size == 4 else ord(text[at + 1]), True))
            at += size
        else:
            signs.append((ord(text[at]), False))
            at += 1
    k = 0
    while k < len(signs):
        if 0 < k + 1 < len(signs) - 1 and signs[k + 1] == (ord("-"), False):
            found.update(range(signs[k][0], signs[k + 2][0] + 1))
            k += 3
        else:
            found.add(signs[k][0])
            k += 1
    return found


@dataclass
class Automaton:
    """``moves[state + class of byte]`` is the next state (a multiple of ``width``); 0 is dead, ``start`` begins.

    States from ``accepting`` on accept; ``marks[state]`` are the numbers of the expressions accepted there.
    """

    classes: bytes
    width: int
    moves: list[int]
    start: int
    accepting: int
    marks: dict[int, tuple[int, ...]]


def compile_rules(patterns: list[str], anywhere: bool) -> Automaton:
    """Minimal automaton of all patterns; with ``anywhere`` a match may begin at every byte."""
    nets = [Expression(p) for p in patterns]
    base, total = [], 0
    for net in nets:
        base.append(total)
        total += len(net.empty)
    empty = [[base[i] + t for t in net.empty[s]] for i, net in enumerate(nets) for s in range(len(net.empty))]
    moves = [(m[0], base[i] + m[1]) if (m := net.moves[s]) else None for i, net in enumerate(nets) for s in range(len(net.empty))]
    ends = {base[i] + net.accept: i for i, net in enumerate(nets)}

    # Bytes that no expression tells apart form one class.
    sets = {m[0] for m in moves if m}
    shape = [tuple(b in s for s in sets) for b in range(256)]
    number = {x: k for k, x in enumerate(dict.fromkeys(shape))}
    sample = [shape.index(x) for x in number]

    def closed(states):
        seen, todo = set(states), list(states)
        while todo:
            for t in empty[todo.pop()]:
                if t not in seen:
                    seen.add(t)
                    todo.append(t)
        return frozenset(s for s in seen if moves[s] or s in ends)

    first = closed([base[i] + net.start for i, net in enumerate(nets)])
    ids = {frozenset(): 0, first: 1}
    table, order = [[0] * len(sample)], [frozenset(), first]
    k = 1
    while k < len(order):
        row = []
        for byte in sample:
            reached = {moves[s][1] for s in order[k] if moves[s] and byte in moves[s][0]}
            target = closed(reached) | (first if anywhere else frozenset())
            if target not in ids:
                ids[target] = len(order)
                order.append(target)
            row.append(ids[target])
        table.append(row)
        k += 1
    marks = [tuple(sorted({ends[s] for s in subset if s in ends})) for subset in order]

    # Moore's refinement: states stay together while they accept alike and move to states that are together.
    group = {m: k for k, m in enumerate(dict.fromkeys(marks))}
    part = [group[m] for m in marks]
    while True:
        keys = [(part[s], *(part[t] for t in table[s])) for s in range(len(table))]
        fresh = {x: k for k, x in enumerate(dict.fromkeys(keys))}
        following = [fresh[x] for x in keys]
        if len(fresh) == len(set(part)):
            break
        part = following
    chosen: dict[int, int] = {}
    for s, p in enumerate(part):
        chosen.setdefault(p, s)
    dead = part[0]
    ranked = sorted(chosen, key=lambda p: (p != dead, bool(marks[chosen[p]]), chosen[p]))
    width = len(sample)
    place = {p: k * width for k, p in enumerate(ranked)}
    flat = [place[part[t]] for p in ranked for t in table[chosen[p]]]
    accepting = next((place[p] for p in ranked if marks[chosen[p]]), len(flat))
    return Automaton(bytes(number[x] for x in shape), width, flat, place[part[1]], accepting, {place[p]: marks[chosen[p]] for p in ranked if marks[chosen[p]]})


def longest(net: Automaton, symbols: bytes, begin: int) -> int:
    """End of the longest match that begins at ``begin``; 0 if none."""
    moves, first, state, end = net.moves, net.accepting, net.start, 0
    for at in range(begin, len(symbols)):
        state = moves[state + symbols[at]]
        if not state:
            break
        if state >= first:
            end = at + 1
    return end


class Scanner:
    """Automata of a rule list, and the spans they give."""

    def __init__(self, rules: tuple[Rule, ...] = RULES):
        self.rules = rules
        self.combined = compile_rules([r.gate or (r.head + r.run).removesuffix("+") for r in rules], anywhere=True)
        self.single = [compile_rules([r.head + r.run], anywhere=False) for r in rules]
        self.heads = [compile_rules([r.head], anywhere=False) if r.head else None for r in rules]

    def accepted(self, data: bytes) -> dict[int, int]:
        """Rules that accept anywhere, with the place after the last byte of their last acceptance. One pass."""
        net = self.combined
        moves, state, first = net.moves, net.start, net.accepting
        last: dict[int, int] = {}
        for at, symbol in enumerate(data.translate(net.classes)):
            state = moves[state + symbol]
            if state >= first:
                last[state] = at
        out: dict[int, int] = {}
        for state, at in last.items():
            for rule in net.marks[state]:
                out[rule] = max(out.get(rule, 0), at + 1)
        return out

    def matches(self, rule: int, data: bytes, stop: int):
        """Leftmost longest matches of a rule, without overlaps, that begin before ``stop``."""
        net = self.single[rule]
        symbols = data.translate(net.classes)
        opens = {s for s in range(net.width) if net.moves[net.start + s]}
        begin = 0
        while begin < stop:
            end = longest(net, symbols, begin) if symbols[begin] in opens else 0
            if end:
                yield begin, end
            begin = end or begin + 1

    def spans(self, text: str | None) -> list[tuple[str, int, int]]:
        """(kind, start, end) in code points by start, then by the order of the rules."""
        if not text:
            return []
        data = text.encode("utf-8", "surrogatepass")
        found = []
        for rule, stop in self.accepted(data).items():
            head = self.heads[rule]
            for begin, end in self.matches(rule, data, stop):
                run = longest(head, data[begin:end].translate(head.classes), 0) + begin if head else begin
                if end - run >= self.rules[rule].least:
                    found.append((begin, rule, end))
        found.sort()
        if len(data) == len(text):
            return [(self.rules[rule].kind, begin, end) for begin, rule, end in found]
        places, counted, at = {}, 0, 0
        for place in sorted({p for begin, _, end in found for p in (begin, end)}):
            counted += len(data[at:place].decode("utf-8", "surrogatepass"))
            places[place], at = counted, place
        return [(self.rules[rule].kind, places[begin], places[end]) for begin, rule, end in found]


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """doc_id and spans (kind, start, end; code points, end exclusive) of every row of ``docs`` (doc_id, text).

    Null and empty texts have no spans. Spans of different kinds may overlap; those of one kind do not. Repeated rows
    are scanned one by one, other columns are ignored, an empty table gives an empty result. The automata depend on
    the rules alone and are compiled once on the driver.
    """
    text_batches(docs.sparkSession)
    scanner = docs.sparkSession.sparkContext.broadcast(Scanner(rules))
    kind = docs.schema["doc_id"].dataType.simpleString()
    spans = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches):
        own = scanner.value
        for batch in bounded(batches, "text"):
            found = [[dict(zip(("kind", "start", "end"), s)) for s in own.spans(t)] for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found, spans)], ["doc_id", "spans"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, spans array<struct<kind: string, start: long, end: long>>")
