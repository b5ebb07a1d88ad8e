"""Cheapest edits of a sequence of turns by tables over blocks of turns (the method of the Four Russians).

A turn is one of ten symbols: gone (it must be deleted), a role in four kinds times complete or cut off, or
nothing. The wanted roles are ``(s?(ua)+)?``, an automaton of four states. The costs of all that follows,
from each state, form a vector; less its minimum it is one of a few dozen vectors. For every such vector
and every block of four symbols a table holds the vector in front of the block and the state that each
state leads to, so a sequence is read four turns at a time, from its end. For the edits themselves the
vectors inside a block are made again from its right end, and the letter that sorts first is taken among
the cheapest ones.
"""

from __future__ import annotations

from functools import cache

import numpy as np

#: Costs: a deletion, a change of role, an insertion, a kept turn that is cut off.
DELETE, REROLE, INSERT, CUT = 3, 2, 2, 1
#: States: nothing yet, after system, after user, after assistant. An insertion or change of role leads on
#: to the user, after the user to the assistant.
ONWARD = (2, 2, 3, 2)
#: The state after keeping a turn, by kind of role (system, user, assistant, other); None is forbidden.
KEEP = ((1, None, None, None), (2, 2, None, 2), (None, None, 3, None), (None,) * 4)
#: Costs behind the last turn: the user still needs an answer, the system both.
END = (0, 4, 2, 0)

GONE, NOTHING, SYMBOLS, BLOCK = 0, 9, 10, 4


def symbol(kind: int, cut: bool) -> int:
    """The symbol of a turn that may stay: kind of role (0 to 3) and whether it is cut off."""
    return 1 + 2 * kind + cut


def in_front(after: tuple, sign: int) -> tuple:
    """Costs in front of a turn from the costs behind it; insertions may come first."""
    if sign == NOTHING:
        return after
    best = [DELETE + c for c in after]
    if sign != GONE:
        kind, cut = divmod(sign - 1, 2)
        for q in range(4):
            stay = [CUT * cut + after[KEEP[kind][q]]] if KEEP[kind][q] is not None else []
            best[q] = min(best[q], REROLE + CUT * cut + after[ONWARD[q]], *stay)
    once = [min(best[q], INSERT + best[ONWARD[q]]) for q in range(4)]
    return tuple(min(once[q], INSERT + once[ONWARD[q]]) for q in range(4))


def edits(after: tuple, sign: int, state: int) -> tuple[str, int]:
    """The edits up to and with a turn that sort first among the cheapest, and the state they lead to."""
    if sign == NOTHING:
        return "", state
    here, letters = in_front(after, sign), ""
    kind, cut = divmod(sign - 1, 2)
    while True:
        left = here[state]
        if left == DELETE + after[state]:
            return letters + "D", state
        if left == INSERT + here[ONWARD[state]]:
            letters, state = letters + "I", ONWARD[state]
            continue
        kept = KEEP[kind][state]
        if kept is not None and left == CUT * cut + after[kept]:
            return letters + "K", kept
        return letters + "R", ONWARD[state]


def _level(vector: tuple) -> tuple:
    return tuple(c - min(vector) for c in vector)


class Tables:
    """All vectors that can occur, and for (vector behind, block) the vector in front and the states."""

    def __init__(self) -> None:
        self.vectors, self.number = [END], {END: 0}
        one, at = [], 0
        while at < len(self.vectors):
            row = []
            for sign in range(SYMBOLS):
                vector = _level(in_front(self.vectors[at], sign))
                if vector not in self.number:
                    self.number[vector] = len(self.vectors)
                    self.vectors.append(vector)
                row.append(self.number[vector])
            one.append(row)
            at += 1
        self.one = np.array(one)
        self.steps = [[[edits(v, sign, q) for q in range(4)] for sign in range(SYMBOLS)] for v in self.vectors]
        leads = np.array([[[s[1] for s in by] for by in rows] for rows in self.steps])
        n, codes = len(self.vectors), np.arange(SYMBOLS ** BLOCK)
        vector = np.repeat(np.arange(n)[:, None], len(codes), axis=1)
        behind = []
        for place in range(BLOCK):  # from the right end of the block
            sign = codes // SYMBOLS ** place % SYMBOLS
            behind.append((vector, sign))
            vector = self.one[vector, sign]
        state = np.broadcast_to(np.arange(4), (n, len(codes), 4))
        for before, sign in reversed(behind):
            state = leads[before[..., None], sign[None, :, None], state]
        self.front, self.state = vector.astype(np.uint8), state.astype(np.uint8)
        self.front_rows = self.front.tolist()
        self.expanded: dict[tuple, tuple[str, int]] = {}

    def expand(self, vector: int, code: int, state: int) -> tuple[str, int]:
        """The edits of one block and the state behind it, with ``vector`` behind the block."""
        found = self.expanded.get((vector, code, state))
        if found is None:
            signs, behind = [], [vector]
            for _ in range(BLOCK):
                code, sign = divmod(code, SYMBOLS)
                signs.append(sign)
                behind.append(int(self.one[behind[-1], sign]))
            letters, now = [], state
            for sign, after in zip(reversed(signs), reversed(behind[:-1])):
                text, now = self.steps[after][sign][now]
                letters.append(text)
            found = "".join(letters), now
            self.expanded[(vector, sum(s * SYMBOLS ** i for i, s in enumerate(signs)), state)] = found
        return found


@cache
def tables() -> Tables:
    """The tables of this process: (vectors) x 10^4 entries."""
    return Tables()


def blocks(signs: bytes) -> list[int]:
    """Codes of the blocks of a sequence; the first block is filled with nothing on its left."""
    padded = np.frombuffer(bytes([NOTHING]) * (-len(signs) % BLOCK) + signs, np.uint8).astype(np.int64)
    return (padded.reshape(-1, BLOCK) @ (SYMBOLS ** np.arange(BLOCK)[::-1])).tolist()


def summary(signs: bytes) -> tuple[bytes, bytes]:
    """What a piece of a sequence does, for every vector behind it: the vector in front, and the state
    behind it for each of the four states in front."""
    t = tables()
    codes, vector = blocks(signs), np.arange(len(t.vectors))
    behind = []
    for code in reversed(codes):
        behind.append(vector)
        vector = t.front[vector, code]
    state = np.broadcast_to(np.arange(4), (len(t.vectors), 4))
    for code, after in zip(codes, reversed(behind)):
        state = t.state[after[:, None], code, state]
    return vector.astype(np.uint8).tobytes(), state.astype(np.uint8).tobytes()


def trace(signs: bytes, behind: int = 0, state: int = 0, last: bool = True) -> tuple[str, int]:
    """The edits of a piece and the state behind it; the last piece also gets what is missing at the end.

    ``behind`` is the vector behind the piece, ``state`` the one in front of it.
    """
    t = tables()
    codes, vectors = blocks(signs), []
    for code in reversed(codes):
        vectors.append(behind)
        behind = t.front_rows[behind][code]
    letters = []
    for code, vector in zip(codes, reversed(vectors)):
        text, state = t.expand(vector, code, state)
        letters.append(text)
    while last and END[state]:
        letters.append("I")
        state = ONWARD[state]
    return "".join(letters), state
