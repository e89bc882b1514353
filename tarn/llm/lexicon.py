"""A lexicon trie intersected with Levenshtein automata, made deterministic as words arrive."""

from __future__ import annotations

EXACT, FUZZY, STEM = 1, 2, 3


class Matcher:
    """Finds the words of a lexicon, also misspelled by one edit, and words that begin with a stem.

    A state is the set of (trie node, edits spent) that a prefix can reach; states
    and their moves are built on first use and kept, so a word costs one dictionary
    step for each character until no entry is in reach.

    ``words``: entries; those of ``fuzzy_from`` characters or more also match at one
    edit (a changed, missing, extra character). ``stems`` match as exact prefixes.
    """

    def __init__(self, words: list[str], stems: list[str], fuzzy_from: int = 5, most_states: int = 15_000):
        self.children: list[dict[str, int]] = [{}]
        self.word = [False]
        self.stem = [False]
        self.reach = [0]  # longest entry below, for the edit budget
        self.fuzzy_from, self.most_states = fuzzy_from, most_states
        for entry, flags in [*((w, self.word) for w in words), *((s, self.stem) for s in stems)]:
            node, path = 0, [0]
            for ch in entry:
                nxt = self.children[node].get(ch)
                if nxt is None:
                    nxt = len(self.children)
                    self.children[node][ch] = nxt
                    self.children.append({})
                    self.word.append(False)
                    self.stem.append(False)
                    self.reach.append(0)
                node = nxt
                path.append(node)
            flags[node] = True
            if flags is self.word:
                for p in path:
                    self.reach[p] = max(self.reach[p], len(entry))
        self.depth = [0] * len(self.children)
        for node in range(len(self.children)):
            for child in self.children[node].values():
                self.depth[child] = self.depth[node] + 1
        self._reset()

    def _reset(self) -> None:
        self.sets: list[frozenset] = [frozenset()]
        self.ids: dict[frozenset, int] = {frozenset(): 0}
        self.moves: list[dict[str, int]] = [{}]
        self.accept = [0]
        self.start = self._state(self._close({(0, 0)}))

    def _close(self, states: set) -> frozenset:
        """Adds what a missing character reaches; drops spent edits that no long enough entry allows."""
        out = set(states)
        for node, e in states:
            if e == 0:
                out.update((c, 1) for c in self.children[node].values())
        return frozenset((n, e) for n, e in out if e == 0 or self.reach[n] >= self.fuzzy_from)

    def _state(self, s: frozenset) -> int:
        i = self.ids.get(s)
        if i is None:
            i = len(self.sets)
            self.ids[s] = i
            self.sets.append(s)
            self.moves.append({})
            if any(e == 0 and self.stem[n] for n, e in s):
                a = STEM
            elif any(e == 0 and self.word[n] for n, e in s):
                a = EXACT
            elif any(e == 1 and self.word[n] and self.depth[n] >= self.fuzzy_from for n, e in s):
                a = FUZZY
            else:
                a = 0
            self.accept.append(a)
        return i

    def _move(self, state: int, ch: str) -> int:
        out = set()
        for node, e in self.sets[state]:
            child = self.children[node].get(ch)
            if child is not None:
                out.add((child, e))
            if e == 0:
                out.add((node, 1))
                out.update((c, 1) for c in self.children[node].values())
        nxt = self._state(self._close(out))
        self.moves[state][ch] = nxt
        return nxt

    def match(self, word: str) -> int:
        """EXACT, FUZZY, STEM or 0."""
        if len(self.sets) > self.most_states:
            self._reset()
        state, moves, accept = self.start, self.moves, self.accept
        for ch in word:
            nxt = moves[state].get(ch)
            if nxt is None:
                nxt = self._move(state, ch)
            if nxt == 0:
                return 0
            if accept[nxt] == STEM:
                return STEM
            state = nxt
        return accept[state]
