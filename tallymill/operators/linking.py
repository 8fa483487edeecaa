"""The ordered choice of links on one page, from its points and not from their pairs."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterable
from heapq import heapify, heappop, heapreplace
from math import hypot

import numpy as np

LEAF = 8


class Places:
    """Glyphs by their place, as a k-d tree of boxes that hold a place with a glyph left.

    ``spots`` maps ``(x, y)`` to rows in order of glyph; glyphs of one place are one point
    of the tree, whose first row is the one that is left.
    """

    def __init__(self, spots: dict[tuple[float, float], list[int]]):
        self.queues = [deque(rows) for rows in spots.values()]
        self.at = list(spots)
        self.place_of = {row: k for k, rows in enumerate(spots.values()) for row in rows}
        xy = np.array(self.at, float).reshape(-1, 2)
        self.box, self.kids, self.left, self.parent, self.leaf_of = [], [], [], [], {}
        waiting = [(np.arange(len(xy)), -1)] if len(xy) else []
        while waiting:
            part, above = waiting.pop()
            node, (lo, hi) = len(self.box), (xy[part].min(axis=0), xy[part].max(axis=0))
            self.box.append((float(lo[0]), float(hi[0]), float(lo[1]), float(hi[1])))
            self.left.append(len(part))
            self.parent.append(above)
            self.kids.append([])
            if above >= 0:
                self.kids[above].append(node)
            if len(part) <= LEAF:
                self.leaf_of |= dict.fromkeys(part.tolist(), node)
            else:
                part = part[np.argsort(xy[part, int(np.argmax(hi - lo))], kind="stable")]
                waiting += [(part[: len(part) // 2], node), (part[len(part) // 2 :], node)]
        self.places = [[] for _ in self.box]
        for place, node in self.leaf_of.items():
            self.places[node].append(place)

    def _far(self, node: int, x: float, y: float) -> float:
        a, b, c, d = self.box[node]
        return hypot(max(a - x, 0.0, x - b), max(c - y, 0.0, y - d))

    def nearest(self, x: float, y: float, radius: float, names: list) -> tuple | None:
        """``(distance, glyph, row)`` of the first glyph left within the radius."""
        best, waiting = None, [(self._far(0, x, y), 0)] if self.box else []
        while waiting:
            far, node = waiting.pop()
            if far > radius:
                continue
            for place in self.places[node]:
                if queue := self.queues[place]:
                    distance = hypot(x - self.at[place][0], y - self.at[place][1])
                    if distance <= radius and (best is None or (distance, names[queue[0]]) < best[:2]):
                        best, radius = (distance, names[queue[0]], queue[0]), distance
            waiting += sorted(((self._far(k, x, y), k) for k in self.kids[node] if self.left[k]), reverse=True)
        return best

    def settle(self, row: int, dead: list[bool]) -> None:
        """Forgets the dead rows at the head of this row's place, and an emptied place."""
        place = self.place_of[row]
        queue = self.queues[place]
        if not queue:
            return
        while queue and dead[queue[0]]:
            queue.popleft()
        if not queue:
            node = self.leaf_of[place]
            while node >= 0:
                self.left[node] -= 1
                node = self.parent[node]


def choose(markers: list[tuple], glyphs: list[tuple], radius: float) -> list[tuple[int, int]]:
    """``(marker's row, glyph's row)`` of the links, by the rule of ``matching.linked``.

    ``markers`` are rows ``(marker, x, y, outcome)``; ``glyphs`` are rows ``(glyph, x, y,
    outcome, ordinal, word, start, end, whole)``, one for each outcome of the glyph. A marker
    waits with its nearest glyph left; of all that wait the first by ``(distance,
    marker, glyph)`` is taken, and one whose glyph has gone looks for its next. A glyph that
    cannot be taken once cannot be later either, so this is the order of all pairs, of which
    only those that wait are held.
    """
    names = [g[0] for g in glyphs]
    by_name, by_word, by_ordinal = {}, {}, {}
    for row, (glyph, _, _, _, ordinal, word, *_) in enumerate(glyphs):
        by_name.setdefault(glyph, []).append(row)
        by_word.setdefault(word, []).append(row)
        by_ordinal.setdefault(ordinal, []).append(row)
    held, ordinals = {}, set()  # marker: (distance, marker, glyph, its row, the marker's row)

    def blocked(row: int) -> Iterable[int]:
        """Rows that a link to this one rules out, by glyph and by word."""
        _, _, _, _, _, word, start, end, _ = glyphs[row]
        yield from by_name[names[row]]
        yield from (other for other in by_word[word] if glyphs[other][6] < end and start < glyphs[other][7])

    def greedy(whole_only: bool) -> None:
        dead = [whole_only and not g[8] for g in glyphs]
        for _, _, _, row, _ in held.values():
            for other in blocked(row):
                dead[other] = True
        if not whole_only:
            for row, g in enumerate(glyphs):
                dead[row] = dead[row] or not g[8] and g[4] in ordinals
        spots = {}
        for row in sorted((r for r in range(len(glyphs)) if not dead[r]), key=names.__getitem__):
            spots.setdefault(glyphs[row][3], {}).setdefault(glyphs[row][1:3], []).append(row)
        trees = {outcome: Places(at) for outcome, at in spots.items()}

        def first(m: int) -> tuple | None:
            marker, x, y, outcome = markers[m]
            met = trees[outcome].nearest(x, y, radius, names) if outcome in trees else None
            return met and (met[0], marker, met[1], met[2], m)

        waiting = [w for m in range(len(markers)) if markers[m][0] not in held and (w := first(m))]
        heapify(waiting)
        while waiting:
            _, marker, _, row, m = waiting[0]
            if marker in held:
                heappop(waiting)
            elif dead[row]:
                if again := first(m):
                    heapreplace(waiting, again)
                else:
                    heappop(waiting)
            else:
                held[marker] = heappop(waiting)
                ordinals.add(glyphs[row][4])
                gone = list(blocked(row))
                if not whole_only:
                    gone += [other for other in by_ordinal[glyphs[row][4]] if not glyphs[other][8]]
                for other in gone:
                    if not dead[other]:
                        dead[other] = True
                        trees[glyphs[other][3]].settle(other, dead)

    greedy(True)
    kept = set()
    for link in sorted(held.values()):
        if glyphs[link[3]][4] in kept:
            del held[link[1]]
        kept.add(glyphs[link[3]][4])
    greedy(False)
    times = {}
    for link in held.values():
        times.setdefault(glyphs[link[3]][4], []).append(link)
    return [(links[0][4], links[0][3]) for links in times.values() if len(links) == 1]
