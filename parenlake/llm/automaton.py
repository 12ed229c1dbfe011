"""Minimal acyclic automata that number their words.

Built from sorted words one after the other: the part of the last word that the
next one doesn't share is final, and each of its states is replaced by an equal
one met before. A state knows how many words lead on from it, and an edge how
many words come before those it leads to, so a path's sum is its word's number
in sorted order (a minimal perfect hash), and no word is stored.
"""

from __future__ import annotations


class Automaton:
    """``words``: sorted, distinct. State numbers are positions in ``edges``;
    ``edges[s]`` maps a character to (state, words before it)."""

    def __init__(self, words: list[str]) -> None:
        self.edges: list[dict[str, tuple[int, int]]] = []
        self.final: list[bool] = []
        self.size: list[int] = []
        self._register: dict[tuple, int] = {}
        # The states along the last word, not yet minimal: finality and edges.
        path: list[list] = [[False, []]]
        last = ""
        for word in words:
            same, most = 0, min(len(word), len(last))
            while same < most and word[same] == last[same]:
                same += 1
            self._close(path, last, same)
            path += [[False, []] for _ in range(len(word) - same)]
            path[-1][0] = True
            last = word
        self._close(path, last, 0)
        self.start = self._state(path[0])
        del self._register

    def _close(self, path: list[list], last: str, keep: int) -> None:
        """Make the states beyond ``keep`` characters of the last word final."""
        while len(path) - 1 > keep:
            state = self._state(path.pop())
            path[-1][1].append((last[len(path) - 1], state))

    def _state(self, made: list) -> int:
        key = (made[0], tuple(made[1]))
        found = self._register.get(key)
        if found is None:
            found = self._register[key] = len(self.edges)
            before, edges = int(made[0]), {}
            for letter, to in made[1]:
                edges[letter] = (to, before)
                before += self.size[to]
            self.edges.append(edges)
            self.final.append(made[0])
            self.size.append(before)
        return found

    def __len__(self) -> int:
        return self.size[self.start]

    def walk(self, text: str, state: int, number: int = 0) -> tuple[int, int] | None:
        """State and number after ``text``; None where no word goes on."""
        edges = self.edges
        for letter in text:
            step = edges[state].get(letter)
            if step is None:
                return None
            state = step[0]
            number += step[1]
        return state, number

    def number(self, word: str) -> int | None:
        """The word's place among the sorted words; None if it isn't one."""
        end = self.walk(word, self.start)
        return end[1] if end and self.final[end[0]] else None

    def shorter_or_equal(self, word: str, exact: int) -> set[int]:
        """Numbers of the words that agree with the first ``exact`` characters
        and differ from the rest by one character replaced or left out."""
        found: set[int] = set()
        at = self.walk(word[:exact], self.start)
        edges, final, walk = self.edges, self.final, self.walk
        for i in range(exact, len(word)):
            if at is None:
                break
            state, number = at
            rest, own = word[i + 1 :], word[i]
            end = walk(rest, state, number)
            if end and final[end[0]]:
                found.add(end[1])
            for letter, (to, before) in edges[state].items():
                if letter != own:
                    end = walk(rest, to, number + before)
                    if end and final[end[0]]:
                        found.add(end[1])
            step = edges[state].get(own)
            at = (step[0], number + step[1]) if step else None
        return found
