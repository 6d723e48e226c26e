"""Plain versions of operators, to compare with."""

import bisect
import re

KINDS = ("email", "ip", "card", "phone")
PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def brute_spans(text):
    def fine(kind, found):
        digits = re.sub("[^0-9]", "", found)
        if kind == "ip":
            return all(int(x) <= 255 for x in found.split("."))
        if kind == "card":
            total = sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(digits[::-1]))
            return 13 <= len(digits) <= 19 and total % 10 == 0
        return kind == "email" or 9 <= len(digits) <= 15
    return [(k, *m.span()) for k in KINDS for m in re.finditer(PATTERNS[k], text) if fine(k, m.group())]


def sets_of(text):
    words = (text or "").encode().lower().split()
    if not words:
        return frozenset()
    return frozenset(tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4)))


def brute_components(rows, percent=85):
    rows = [(i, sets_of(t)) for i, t in rows]
    known = [(i, s) for i, s in rows if i is not None and s]
    least = {i: i for i, _ in rows}
    moved = True
    while moved:
        moved = False
        for a, s in known:
            for b, t in known:
                if 100 * len(s & t) >= percent * len(s | t) and least[b] < least[a]:
                    least[a], moved = least[b], True
    return sorted(((i, len(s), least[i] if i is not None else None, i is None or least[i] == i) for i, s in rows), key=str)


def sequential_best_fit(lengths, capacity):
    rooms, opened = [], 0
    for n in sorted(lengths, reverse=True):
        i = bisect.bisect_left(rooms, n)
        if i < len(rooms):
            room = rooms.pop(i)
        else:
            room, opened = capacity, opened + 1
        if room > n:
            bisect.insort(rooms, room - n)
    return opened
