"""Branch-and-bound search for the cheapest edits of a sequence of conversation rows.

A row is one letter: its role's initial (``s``, ``u``, ``a``, or ``o`` for any other), in upper case when the row
is truncated, or ``x`` when it must be deleted. Edits are Keep (0), Rerole to user or assistant (2), Delete (3)
and Insert of a user or assistant row (2); a truncated row that stays adds 1. The roles that come out must read
``(s?(ua)+)?``. Of the cheapest edit sequences the one whose initials are least in ASCII order is wanted.

States of what has come out: ``START`` nothing, ``LED`` a system row, ``ASKED`` a user row last, ``ANSWERED`` an
assistant row last. State and edits determine every role, so the initials say everything.

The search is depth first with an explicit stack. A node is (rows read, state); the suffix lower bound of a node
counts the edits that the rest needs, taken backwards row by row with at most one insert before each, so it is
tight and long parts need no second descent. A branch is cut when its cost and bound reach past the incumbent
(cost, initials), when they meet it with initials that are not smaller, or when the node's dominance table holds a
prefix that is no worse. Two prefixes of one node and cost are never the beginning of each other
(the longer would have inserts more), so comparing prefixes decides for every completion. When the stack is empty
the incumbent is proved.
"""

from __future__ import annotations

from functools import lru_cache

START, LED, ASKED, ANSWERED = range(4)
STATES = 4
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1

_FAR = 1 << 60
#: The state after a user or assistant row, and the initial of the role that comes next.
_NEXT = {START: ASKED, LED: ASKED, ASKED: ANSWERED, ANSWERED: ASKED}
_ROLE = {START: "u", LED: "u", ASKED: "a", ANSWERED: "u"}


def row_edits(row: str, state: int) -> list[tuple[int, str, int]]:
    """(cost, initial, state after) of the edits that consume a row."""
    if row == "x":
        return [(DELETE, "D", state)]
    stay = TRUNCATED if row.isupper() else 0
    role = row.lower()
    edits = [(DELETE, "D", state), (REROLE + stay, "R", _NEXT[state])]
    if role == _ROLE[state]:
        edits.append((KEEP + stay, "K", _NEXT[state]))
    elif role == "s" and state == START:
        edits.append((KEEP + stay, "K", LED))
    return edits


def suffix_bounds(rows: str, ends: tuple[int, ...]) -> list[list[int]]:
    """Lower bounds of the cost from every node to the end of the rows in one of the states ``ends``."""
    last = [0 if state in ends else _FAR for state in range(STATES)]
    for _ in range(2):  # after two inserts all states that inserts reach have been seen
        last = [min(last[state], INSERT + last[_NEXT[state]]) for state in range(STATES)]
    bounds = [last]
    for row in reversed(rows):
        after = bounds[-1]
        own = [min(cost + after[to] for cost, _, to in row_edits(row, state)) for state in range(STATES)]
        # A second insert leads to a state in which no edit is cheaper than in the first one.
        bounds.append([min(own[state], INSERT + own[_NEXT[state]]) for state in range(STATES)])
    return bounds[::-1]


def search(rows: str, begin: int, ends: tuple[int, ...]) -> tuple[int, str] | None:
    """(cost, initials) of the best edits from state ``begin`` to one of ``ends``; None where there are none."""
    bounds, n = suffix_bounds(rows, ends), len(rows)
    best = (_FAR, "")
    dominance: dict[tuple[int, int], tuple[int, str]] = {}
    stack = [(0, "", 0, begin)]
    while stack:
        cost, audit, k, state = stack.pop()
        least = cost + bounds[k][state]
        if least >= _FAR or least > best[0] or least == best[0] and audit > best[1][: len(audit)]:
            continue
        known = dominance.get((k, state))
        if known is not None and known <= (cost, audit):
            continue
        dominance[k, state] = (cost, audit)
        if k == n and state in ends:
            best = min(best, (cost, audit))
        moves = [(INSERT, "I", k, _NEXT[state])]
        if k < n:
            moves += [(paid, name, k + 1, after) for paid, name, after in row_edits(rows[k], state)]
        # The most promising child is popped first: the smallest bound, then the smallest initial.
        moves.sort(key=lambda m: (m[0] + bounds[m[2]][m[3]], m[1]), reverse=True)
        for paid, name, place, after in moves:
            stack.append((cost + paid, audit + name, place, after))
    return None if best[0] == _FAR else best


@lru_cache(maxsize=1 << 16)
def repaired(rows: str) -> tuple[int, str]:
    """(cost, initials) of the best edits of a whole conversation; many share their letters."""
    return search(rows, START, (START, ANSWERED))


def transfers(rows: str) -> list[tuple[int, int, int, str]]:
    """(state before, state after, cost, initials) of the best edits of a part of a conversation."""
    # Nothing that has come out is taken back: START and LED are only reached from themselves or what is before.
    ways = [(b, e) for b in range(STATES) for e in range(STATES) if e >= ASKED or b <= e]
    found = [(begin, end, search(rows, begin, (end,))) for begin, end in ways]
    return [(begin, end, *best) for begin, end, best in found if best is not None]


def outputs(audit: str, roles: list[str], texts: list[str], state: int = START) -> tuple[list[str], int]:
    """The repaired ``role:text`` rows that initials give, and the state after them."""
    out, row = [], 0
    for edit in audit:
        if edit == "D":
            row += 1
            continue
        role = {"u": "user", "a": "assistant"}[_ROLE[state]]
        if edit == "I":
            out.append(f"{role}:")
        else:
            kept = edit == "K"
            out.append(f"{roles[row] if kept else role}:{texts[row]}")
            if kept and state == START and roles[row][:1] == "s":
                state = LED
                row += 1
                continue
            row += 1
        state = _NEXT[state]
    return out, state
