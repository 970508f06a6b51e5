"""Suffix automata over word sequences and matching statistics against them."""

from __future__ import annotations


class SuffixAutomaton:
    """The suffix automaton of one or more word sequences; a match never runs across two."""

    def __init__(self):
        self.length = [0]
        self.link = [-1]
        self.next: list[dict] = [{}]

    def add(self, words) -> SuffixAutomaton:
        length, link, follow = self.length, self.link, self.next
        last = 0
        for w in words:
            known = follow[last].get(w)
            if known is not None:
                # the sequence so far is there already (from an earlier sequence)
                last = known if length[known] == length[last] + 1 else self._split(last, known, w)
                continue
            state = len(length)
            length.append(length[last] + 1)
            follow.append({})
            link.append(0)
            p = last
            while p >= 0 and w not in follow[p]:
                follow[p][w] = state
                p = link[p]
            if p >= 0:
                q = follow[p][w]
                link[state] = q if length[q] == length[p] + 1 else self._split(p, q, w)
            last = state
        return self

    def _split(self, p: int, q: int, w) -> int:
        """A copy of q for the shorter strings that end at p + w."""
        copy = len(self.length)
        self.length.append(self.length[p] + 1)
        self.link.append(self.link[q])
        self.next.append(dict(self.next[q]))
        self.link[q] = copy
        while p >= 0 and self.next[p].get(w) == q:
            self.next[p][w] = copy
            p = self.link[p]
        return copy

    def matches(self, words) -> list[int]:
        """For each position: length of the longest suffix ending there that the automaton has."""
        length, link, follow = self.length, self.link, self.next
        state = size = 0
        out = []
        for w in words:
            while state and w not in follow[state]:
                state = link[state]
                size = length[state]
            state = follow[state].get(w, 0)
            size = size + 1 if state else 0
            out.append(size)
        return out


def long_spans(matches: list[int], least: int) -> list[tuple[int, int]]:
    """Maximal [from, to) spans covered by matches of at least least items."""
    spans: list[tuple[int, int]] = []
    for end, size in enumerate(matches, 1):
        if size >= least:
            if spans and spans[-1][1] >= end - size:
                spans[-1] = (min(spans[-1][0], end - size), end)
            else:
                spans.append((end - size, end))
    return spans
