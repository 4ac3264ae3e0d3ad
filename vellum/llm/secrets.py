"""Secret scans with one combined automaton (operator 7).

All rules' regular expressions become one nondeterministic automaton, then by
subset construction one deterministic automaton over bytes (bytes that no rule
tells apart share a column), minimised by partition refinement.  A text is read
once, byte by byte, for all rules: the state says which rules match up to here.
Only where a rule's match ends are its bounds resolved, by the rule's own
reversed automaton (leftmost start that doesn't overlap the match before) and
its anchored automaton (longest end).  Matches are leftmost and do not overlap
within a rule.

Rules are pairs of a name and a pattern of literals, classes, groups,
alternatives and repeats, over ASCII bytes; ``(?i:...)`` ignores case.
``MIN_VALUE`` drops matches of a rule whose value, the run of ``VALUE`` bytes
at the end, is too short, ``MIN_LENGTH`` matches that are too short as a whole,
after the match has consumed its text.

Defined results: a null or empty text has no spans; rows that repeat give
repeated results; other columns are ignored; empty tables give no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache
from re import _constants as sre
from re import _parser as sre_parser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vellum.llm.common import byte_values, slices

VALUE = rb"A-Za-z0-9+/_.=-"

#: fixed values: the rules every scan has, in the order in which they are listed
BASE_RULES = (
    ("assign", r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]+"""),
    ("access", r"AKIA[A-Z0-9]+"),
    ("hex", r"[0-9a-f]{24,}"),
)
MIN_VALUE = {"assign": 6}
#: lengths are checked on the match: counted repeats of several rules would multiply the automaton's states
MIN_LENGTH = {"access": 20, "git_token": 34, "chat_token": 15, "web_token": 30}
#: rules beside them
MORE_RULES = (
    ("git_token", r"gh[opsu]_[A-Za-z0-9]+"),
    ("chat_token", r"xox[abps]-[A-Za-z0-9-]+"),
    ("web_token", r"eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+"),
    ("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
)
_CONTINUES = bytes(range(0x80, 0xC0))


class _Nfa:
    """States with edges on byte sets and empty edges."""

    def __init__(self) -> None:
        self.empty: list[list[int]] = []
        self.edges: list[list[tuple[frozenset, int]]] = []

    def state(self) -> int:
        self.empty.append([])
        self.edges.append([])
        return len(self.empty) - 1

    def sequence(self, items, at: int, fold: bool, back: bool) -> int:
        for op, arg in reversed(list(items)) if back else items:
            at = self.item(op, arg, at, fold, back)
        return at

    def item(self, op, arg, at: int, fold: bool, back: bool) -> int:
        """Adds one parsed item behind state ``at``; the state behind it."""
        if op is sre.SUBPATTERN:
            return self.sequence(arg[3], at, fold or bool(arg[1] & sre.SRE_FLAG_IGNORECASE), back)
        if op is sre.BRANCH:
            end = self.state()
            for way in arg[1]:
                self.empty[self.sequence(way, at, fold, back)].append(end)
            return end
        if op is sre.MAX_REPEAT:
            least, most, items = arg
            for _ in range(least):
                at = self.sequence(items, at, fold, back)
            if most is sre.MAXREPEAT:
                loop = self.state()
                self.empty[at].append(loop)
                self.empty[self.sequence(items, loop, fold, back)].append(loop)
                return loop
            end = self.state()
            for _ in range(most - least):
                self.empty[at].append(end)
                at = self.sequence(items, at, fold, back)
            self.empty[at].append(end)
            return end
        if op is sre.LITERAL:
            chosen = {arg}
        elif op is sre.IN:
            chosen = set()
            for kind, what in arg:
                chosen |= {what} if kind is sre.LITERAL else set(range(what[0], what[1] + 1))
        else:
            raise ValueError(f"not supported in a rule: {op}")
        if fold:
            chosen |= {ord(f(chr(c))) for c in chosen for f in (str.upper, str.lower)}
        end = self.state()
        self.edges[at].append((frozenset(chosen), end))
        return end

    def closed(self, states) -> frozenset:
        todo, seen = list(states), set(states)
        while todo:
            for s in self.empty[todo.pop()]:
                if s not in seen:
                    seen.add(s)
                    todo.append(s)
        return frozenset(seen)


class Automaton:
    """A minimal deterministic automaton: ``table[state, byte]`` and, per state, the bits of the rules it accepts.

    ``anywhere``: matches may start at any byte; else only at the first.
    ``back``: reads texts from their end.  State 0 is the start.
    """

    def __init__(self, patterns: list[str], anywhere: bool, back: bool = False):
        nfa = _Nfa()
        start = nfa.state()
        accept = {nfa.sequence(sre_parser.parse(p), start, False, back): 1 << i for i, p in enumerate(patterns)}
        sets = {s for edges in nfa.edges for s, _ in edges}
        kinds: dict[tuple, int] = {}
        column = np.array([kinds.setdefault(tuple(c in s for s in sets), len(kinds)) for c in range(256)])
        sample = [int(np.argmax(column == k)) for k in range(len(kinds))]
        first = nfa.closed({start})
        number, todo, rows, masks = {first: 0}, [first], [], []
        for states in todo:
            row = []
            for c in sample:
                ahead = {end for s in states for chosen, end in nfa.edges[s] if c in chosen} | ({start} if anywhere else set())
                then = nfa.closed(ahead)
                if then not in number:
                    number[then] = len(number)
                    todo.append(then)
                row.append(number[then])
            rows.append(row)
            masks.append(sum({accept.get(s, 0) for s in states}))
        table, mask = np.array(rows), np.array(masks)
        block = np.unique(mask, return_inverse=True)[1].ravel()
        while True:  # split blocks until their states agree on all successors' blocks
            finer = np.unique(np.column_stack([block, block[table]]), axis=0, return_inverse=True)[1].ravel()
            if finer.max() == block.max():
                break
            block = finer
        swap = np.arange(block.max() + 1)
        swap[[0, block[0]]] = swap[[block[0], 0]]
        block = swap[block]
        of = np.unique(block, return_index=True)[1]
        self.table, self.mask = block[table][of][:, column], mask[of]
        self.dead = (self.table == np.arange(len(of))[:, None]).all(axis=1) & (self.mask == 0)

    def linked(self) -> list:
        """The start state as a list: the next state's list for each byte, then its rules."""
        rows = [[None] * 257 for _ in self.mask]
        for row, ahead, mask in zip(rows, self.table.tolist(), self.mask.tolist(), strict=True):
            row[:256] = [rows[s] for s in ahead]
            row[256] = mask
        return rows[0]


class Scanner:
    """The automata of a set of rules, and their matches in a text."""

    def __init__(self, rules: tuple[tuple[str, str], ...]):
        self.names = [n for n, _ in rules]
        self.all = Automaton([p for _, p in rules], anywhere=True)
        self.own = [(Automaton([p], False, back=True), Automaton([p], False)) for _, p in rules]
        self.start: list | None = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"start": None}  # the linked lists are made anew where they are used

    @staticmethod
    def _furthest(automaton: Automaton, text: bytes, at: int, step: int, stop: int) -> int | None:
        """The last place, from ``at`` on in steps of 1 or -1, where the automaton accepts."""
        table, mask, dead, state, found = automaton.table, automaton.mask, automaton.dead, 0, None
        while at != stop and not dead[state]:
            state = table[state, text[at if step > 0 else at - 1]]
            at += step
            if mask[state]:
                found = at
        return found

    def spans(self, text: bytes) -> list[tuple[int, int, int]]:
        """``(begin, end, rule)`` in bytes, by begin, then rule."""
        if self.start is None:
            self.start = self.all.linked()
        state, end_of, found = self.start, [0] * len(self.names), []
        for i, c in enumerate(text):
            state = state[c]
            if state[256]:
                for r, (back, ahead) in enumerate(self.own):
                    if state[256] >> r & 1 and i + 1 > end_of[r]:
                        begin = self._furthest(back, text, i + 1, -1, end_of[r])
                        if begin is not None:
                            end_of[r] = self._furthest(ahead, text, begin, 1, len(text))
                            found.append((begin, end_of[r], r))
        return sorted((x for x in found if self._long_enough(text, *x)), key=lambda x: (x[0], x[2]))

    def _long_enough(self, text: bytes, begin: int, end: int, rule: int) -> bool:
        least = MIN_VALUE.get(self.names[rule], 0)
        if end - begin < MIN_LENGTH.get(self.names[rule], 0):
            return False
        return not least or len(_value(text[begin:end])) >= least


@cache
def _value_pattern():
    import re

    return re.compile(rb"[:=]\x20*[\"']?([" + VALUE + rb"]+)\Z")


def _value(match: bytes) -> bytes:
    """What an assignment assigns: all after its first ``:`` or ``=``, spaces and quote."""
    return _value_pattern().search(match)[1]


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
         rules: tuple[tuple[str, str], ...] = BASE_RULES + MORE_RULES) -> DataFrame:
    """``doc_id, spans``: per document its ``(kind, begin, end)`` in code points, end exclusive, by begin, then rule."""
    given = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("__text"))
    sent = docs.sparkSession.sparkContext.broadcast(Scanner(rules))
    span = T.StructType().add("kind", T.StringType()).add("begin", T.LongType()).add("end", T.LongType())
    schema = T.StructType([given.schema["doc_id"], T.StructField("spans", T.ArrayType(span))])
    fields = pa.list_(pa.struct([("kind", pa.string()), ("begin", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = sent.value
        for b in slices(batches):
            out = []
            for text in byte_values(b.column(1)):
                found = scanner.spans(text)
                points = lambda at, text=text: len(text[:at].translate(None, _CONTINUES))
                out.append([{"kind": scanner.names[r], "begin": points(i), "end": points(j)} for i, j, r in found])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, fields)], names=["doc_id", "spans"])

    return given.mapInArrow(run, schema)
