"""Re-Pair grammars over symbol strings and min-plus transfer matrices with audit ropes."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import cmp_to_key, lru_cache

# A row's symbol is a letter for its role initial and fault: ok, truncated, or to be deleted.
ROLES = "suax"
OK, TRUNCATED, DELETED = 0, 1, 2
SYMBOLS = {(role, fault): chr(ord("A") + 3 * i + fault) for i, role in enumerate(ROLES) for fault in (OK, TRUNCATED, DELETED)}
# Rules are named by characters from here on.
FIRST_RULE = 0xE000
# States of the repaired roles so far: nothing, a system turn, ends with a user turn, ends with an assistant turn.
START, SYSTEM, USER, ASSISTANT = range(4)
ACCEPTED = (START, ASSISTANT)
NEXT = {START: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
REROLE, DELETE, INSERT, LEFT_TRUNCATED = 3, 4, 3, 3
LEGAL = frozenset(["su", "ua", "au"])

# An audit is a string or, once long, a rope (left, right) that shares its halves.
Rope = str | tuple
FLAT = 64
# Costs and audits by state before and after; missing where there is no way.
Matrix = dict[tuple[int, int], tuple[int, Rope, int]]


def leaves(rope: Rope) -> Iterator[str]:
    """The strings of a rope from left to right."""
    stack = [rope]
    while stack:
        top = stack.pop()
        if isinstance(top, str):
            yield top
        else:
            stack += [top[1], top[0]]


def compared(a: Rope, b: Rope) -> int:
    """-1, 0 or 1 as ``a`` sorts before, with or after ``b``; shared left halves are not read."""
    while isinstance(a, tuple) and isinstance(b, tuple) and a[0] is b[0]:
        a, b = a[1], b[1]
    if a is b:
        return 0
    first, second = leaves(a), leaves(b)
    x = y = ""
    while True:
        x, y = x or next(first, ""), y or next(second, "")
        if not x or not y:
            return (x > y) - (x < y)
        size = min(len(x), len(y))
        if x[:size] != y[:size]:
            return 1 if x[:size] > y[:size] else -1
        x, y = x[size:], y[size:]


def insertions() -> Matrix:
    """Ways between states by inserted turns alone, at most two."""
    found: Matrix = {}
    for state in range(4):
        at = state
        for n in range(3):
            found.setdefault((state, at), (INSERT * n, "I" * n, n))
            at = NEXT[at]
    return found


def product(a: Matrix, b: Matrix) -> Matrix:
    """Cheapest ways through both, of equal ones the ASCII-least audit.

    All ways of one entry consume the same rows and end with one, so of two equally cheap
    audits neither continues the other, and the least of joined audits joins the least ones.
    """
    out: Matrix = {}
    for (p, r), (first, left, n) in a.items():
        for q in range(4):
            way = b.get((r, q))
            if way is None:
                continue
            cost, known = first + way[0], out.get((p, q))
            if known is not None and cost > known[0]:
                continue
            size = n + way[2]
            flat = size <= FLAT and isinstance(left, str) and isinstance(way[1], str)
            joined: Rope = left + way[1] if flat else left if not way[2] else way[1] if not n else (left, way[1])
            if known is None or cost < known[0] or compared(joined, known[1]) < 0:
                out[p, q] = cost, joined, size
    return out


def terminal(role: str, fault: int) -> Matrix:
    """Inserted turns, then one row: kept where its role fits, given the role that fits, or deleted."""
    step: Matrix = {}
    for state in range(4):
        step[state, state] = DELETE, "D", 1
        if fault == DELETED:
            continue
        left = LEFT_TRUNCATED if fault == TRUNCATED else 0
        step[state, NEXT[state]] = REROLE + left, "R", 1
        if role == {USER: "u", ASSISTANT: "a"}[NEXT[state]]:
            step[state, NEXT[state]] = left, "K", 1
        elif role == "s" and state == START:
            step[START, SYSTEM] = left, "K", 1
    return product(insertions(), step)


TERMINALS = {symbol: terminal(*key) for key, symbol in SYMBOLS.items()}


@lru_cache(maxsize=4)
def matrices(rules: tuple[str, ...]) -> dict[str, Matrix]:
    """One matrix per symbol, those of the rules bottom-up from the pairs they stand for."""
    found = dict(TERMINALS)
    for i, pair in enumerate(rules):
        found[chr(FIRST_RULE + i)] = product(found[pair[0]], found[pair[1]])
    return found


def compressed(symbols: str, rules: tuple[str, ...]) -> str:
    """The string with every rule's pair replaced by its name, in the order of the rules."""
    for i, pair in enumerate(rules):
        if len(symbols) < 2:
            break
        symbols = symbols.replace(pair, chr(FIRST_RULE + i))
    return symbols


def pair_counts(symbols: str) -> Counter[str]:
    """Adjacent pairs; a run of one symbol holds every second of its pairs."""
    counts: Counter[str] = Counter()
    last = -1
    for i in range(len(symbols) - 1):
        if symbols[i] == symbols[i + 1] and last == i - 1 and symbols[i - 1] == symbols[i]:
            last = -1
            continue
        counts[symbols[i : i + 2]] += 1
        last = i
    return counts


@lru_cache(maxsize=20_000)
def _short(symbols: str, rules: tuple[str, ...]) -> Matrix:
    return _evaluated(symbols, rules)


def _evaluated(symbols: str, rules: tuple[str, ...]) -> Matrix:
    known = matrices(rules)
    level = [known[s] for s in compressed(symbols, rules)]
    while len(level) > 1:
        level = [product(*level[i : i + 2]) if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
    return level[0]


def evaluated(symbols: str, rules: tuple[str, ...]) -> Matrix:
    """The matrix of a whole string; those of short strings are remembered per worker."""
    return _short(symbols, rules) if len(symbols) <= FLAT else _evaluated(symbols, rules)


def costs_and_ranks(found: Matrix) -> tuple[list[int | None], list[int]]:
    """Costs by state before and after, and the places of their audits in ASCII order among those from one state."""
    costs: list[int | None] = [None] * 16
    ranks = [0] * 16
    for p in range(4):
        ends = [q for q in range(4) if (p, q) in found]
        ends.sort(key=cmp_to_key(lambda x, y: compared(found[p, x][1], found[p, y][1])))
        for rank, q in enumerate(ends):
            costs[4 * p + q], ranks[4 * p + q] = found[p, q][0], rank
    return costs, ranks


def ending(state: int) -> tuple[int, str]:
    """Cheapest inserted turns from a state to an accepted one."""
    ways = [(cost, audit) for (p, q), (cost, audit, _) in insertions().items() if p == state and q in ACCEPTED]
    return min(ways)


def best_path(chunks: list[tuple[list[int | None], list[int]]]) -> tuple[list[int], int]:
    """States after each of a conversation's strings on the cheapest way, and its cost; of equal ways the one with the ASCII-least audit.

    Audits of one string from one state never continue each other, so where two ways part
    for the first time the ranks there decide.
    """
    rest = [ending(state)[0] for state in range(4)]
    steps: list[list[int]] = []
    for costs, ranks in reversed(chunks):
        step, now = [0] * 4, [0] * 4
        for p in range(4):
            now[p], _, step[p] = min((costs[4 * p + q] + rest[q], ranks[4 * p + q], q) for q in range(4) if costs[4 * p + q] is not None)
        steps.append(step)
        rest = now
    states, at = [], START
    for step in reversed(steps):
        at = step[at]
        states.append(at)
    return states, rest[START]


class Repairer:
    """Applies an audit to a conversation's rows, one after another."""

    def __init__(self) -> None:
        self.state, self.edits, self.at = START, "", 0

    def _turn(self, role: str, text: str) -> str:
        return f"{role}:{text}"

    def _expected(self) -> str:
        self.state = NEXT[self.state]
        return {USER: "user", ASSISTANT: "assistant"}[self.state]

    def load(self, edits: str) -> Iterator[str]:
        """Takes the next edits; what is left of the former are inserted turns."""
        yield from self.inserted()
        self.edits, self.at = edits, 0

    def inserted(self) -> Iterator[str]:
        while self.at < len(self.edits) and self.edits[self.at] == "I":
            self.at += 1
            yield self._turn(self._expected(), "")

    def row(self, role: str, text: str) -> Iterator[str]:
        """The repaired turns that the next row makes."""
        yield from self.inserted()
        edit = self.edits[self.at]
        self.at += 1
        if edit == "K":
            self.state = SYSTEM if role.startswith("s") else NEXT[self.state]
            yield self._turn(role, text)
        elif edit == "R":
            yield self._turn(self._expected(), text)
