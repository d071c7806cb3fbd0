"""A deterministic transducer that counts byte-pair tokens, compiled from a tokenizer's merges.

It reads the bytes of a piece (a match of the byte-level splitting pattern) and resets where the
next piece begins.  After a prefix w of a piece, what decides the rest is, for every end of w that
may still grow into a longer token, the last token of what stands before that end.  A state is the
list of these (place in the trie of tokens, last token, tokens counted there less tokens of w).
Both are bounded by the vocabulary, so there are finitely many states.

A step on a byte ends the prefix with the one token that fits: tokens side by side are an encoding
exactly if no merge crosses the seam before the merges within them are done.  The transition carries
the number of tokens that it adds, which is negative where a byte lets tokens merge.

States and transitions are built when they are first met, as a table of all would have some 10^7
entries of which a corpus meets few.
"""

from __future__ import annotations

import json
import re

import numpy as np

from marginalia.llm.spans import cut_rule, load

LETTER, NUMBER, OTHER, BLANK, SPACE = range(5)
#: States above which the tables are built anew (of 1.5 KB each); bytes that are run side by side.
STATES, BLOCK = 120_000, 1 << 20
_ENDINGS = re.compile(r"'(?:s|t|re|ve|m|ll|d)")


def byte_alphabet() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable bytes stand
    for themselves, the others are put above them in order."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class Classes:
    """Class of each character in the splitting pattern, asked of the tokenizer when first met."""

    def __init__(self, tokenizer):
        self.split, self.known = tokenizer.pre_tokenizer.pre_tokenize_str, np.full(0x110000, 255, np.uint8)

    def __call__(self, codes: np.ndarray) -> np.ndarray:
        found = self.known[codes]
        if (found == 255).any():
            for c in np.unique(codes[found == 255]).tolist():
                self.known[c] = self.ask(chr(c))
            found = self.known[codes]
        return found

    def ask(self, c: str) -> int:
        if c == " ":
            return BLANK
        for kind, other in ((LETTER, "a"), (NUMBER, "1"), (OTHER, "!")):
            if len(self.split(other + c)) == 1:
                return kind
        return SPACE


def piece_starts(text: str, codes: np.ndarray, kind: np.ndarray) -> np.ndarray:
    """Where matches of the byte-level splitting pattern begin, one flag for each character."""
    blank = kind >= BLANK
    start = np.ones(len(codes), bool)
    before, after = kind[:-1], blank[1:]
    # a run of one class goes on; a single blank leads the run that follows it
    start[1:] = np.where(blank[1:], ~blank[:-1], (before != kind[1:]) & (before != BLANK))
    # of a run of white space before other characters, the last one is parted from the rest
    start[:-1] |= blank[:-1] & ~after
    if "'" in text:
        for found in _ENDINGS.finditer(text):
            a, b = found.span()
            if start[a]:
                start[a + 1 : b] = False
                if b < len(start):
                    start[b] = True
    return start


class Transducer:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.tokenizer = load(path)
        added = sorted((t["content"] for t in spec.get("added_tokens") or []), key=len, reverse=True)
        self.added = re.compile("|".join(map(re.escape, added))) if added else None
        self.rule, model = cut_rule(path), spec["model"]
        self.able = self.rule == "led" and self.read(model)
        if self.able:
            self.classes = Classes(self.tokenizer)
            self.clear()

    def read(self, model: dict) -> bool:
        """Ranks, spines and the trie of the vocabulary; False if tokens have several merges."""
        alphabet = byte_alphabet()
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        made = {a + b: (a, b) for a, b in pairs}
        singles = set(alphabet)
        if len(made) != len(pairs) or model.get("ignore_merges") or model.get("continuing_subword_prefix") or model.get("end_of_word_suffix") or not singles <= set(model["vocab"]):
            return False
        names = [*alphabet, *(a + b for a, b in pairs)]
        number = {t: i for i, t in enumerate(names)}
        if any(a not in number or b not in number or max(number[a], number[b]) >= number[a + b] for a, b in pairs):
            return False
        self.ranks = {(number[a], number[b]): i for i, (a, b) in enumerate(pairs)}
        self.parts = [None] * len(alphabet) + [(number[a], number[b]) for a, b in pairs]
        self.born = [-1] * len(alphabet) + list(range(len(pairs)))
        self.children: list[dict[int, int]] = [{}]
        self.token = [-1]
        for name, i in number.items():
            node = 0
            for c in name:
                at = self.children[node]
                if alphabet[c] not in at:
                    at[alphabet[c]] = len(self.children)
                    self.children.append({})
                    self.token.append(-1)
                node = at[alphabet[c]]
            self.token[node] = i
        self.seams: dict[tuple[int, int], bool] = {}
        return True

    def spine(self, token: int, side: int) -> list[int]:
        """The tokens that hold the first (side 0) or last (1) byte of a token, as they arise."""
        out = [token]
        while self.parts[out[-1]]:
            out.append(self.parts[out[-1]][side])
        return out[::-1]

    def fits(self, left: int, right: int) -> bool:
        """Whether the encoding of two tokens' bytes is the two tokens."""
        found = self.seams.get((left, right))
        if found is None:
            x, y = self.spine(left, 1), self.spine(right, 0)
            i = j = 0
            never = len(self.ranks)
            while True:
                next_x = self.born[x[i + 1]] if i + 1 < len(x) else never
                next_y = self.born[y[j + 1]] if j + 1 < len(y) else never
                across = self.ranks.get((x[i], y[j]), never)
                # of equal ranks the leftmost goes first
                if across < next_x and across <= next_y and across < never:
                    found = False
                    break
                if next_x == next_y == never:
                    found = True
                    break
                if next_x <= next_y:
                    i += 1
                else:
                    j += 1
            self.seams[left, right] = found
        return found

    def clear(self) -> None:
        self.states, self.numbers = [((0, -1, 0),)], {((0, -1, 0),): 0}
        self.next, self.adds = np.full((1 << 12, 256), -1, np.int32), np.zeros((1 << 12, 256), np.int16)
        self.seams.clear()

    def step(self, state: int, byte: int) -> None:
        """Build the transition of a state on a byte."""
        grown = [(child, last, tokens) for node, last, tokens in self.states[state] if (child := self.children[node].get(byte)) is not None]
        end, adds = next((t, tokens + 1) for node, last, tokens in grown if (t := self.token[node]) >= 0 and (last < 0 or self.fits(last, t)))
        after = (*((node, last, tokens - adds) for node, last, tokens in grown if self.children[node]), (0, end, 0))
        number = self.numbers.get(after)
        if number is None:
            number = self.numbers[after] = len(self.states)
            self.states.append(after)
            if number >= len(self.next):
                self.next = np.concatenate([self.next, np.full_like(self.next, -1)])
                self.adds = np.concatenate([self.adds, np.zeros_like(self.adds)])
        self.next[state, byte], self.adds[state, byte] = number, adds

    def compact(self, state: np.ndarray) -> np.ndarray:
        """Drop all states but these; what they are called then."""
        held, at = np.unique(state, return_inverse=True)
        kept = [self.states[i] for i in held.tolist()]
        self.clear()
        for k in kept:
            if k not in self.numbers:
                self.numbers[k] = len(self.states)
                self.states.append(k)
        while len(self.states) > len(self.next):
            self.next, self.adds = np.concatenate([self.next, np.full_like(self.next, -1)]), np.concatenate([self.adds, np.zeros_like(self.adds)])
        return np.asarray([self.numbers[k] for k in kept], np.int64)[at]

    def through(self, heads, state: int) -> tuple[int, int]:
        """Tokens added and the state reached on runs of bytes (bytes, tokens and last state from the
        first state).  A run is followed until it comes to where it would be from the first state."""
        total = 0
        for data, tokens, last in heads:
            other = 0
            for b in data:
                if state == other:
                    break
                if self.next[state, b] < 0:
                    self.step(state, b)
                if self.next[other, b] < 0:
                    self.step(other, b)
                total += int(self.adds[state, b])
                tokens -= int(self.adds[other, b])
                state, other = int(self.next[state, b]), int(self.next[other, b])
            if state == other:
                total, state = total + tokens, last
        return total, state

    def lanes(self, data: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Tokens and last states of many runs from the first state, a byte of each at a time."""
        order = np.argsort(-size, kind="stable")
        at, left = start[order], size[order]
        state, total = np.zeros(len(order), np.int64), np.zeros(len(order), np.int64)
        live = np.searchsorted(-left, -np.arange(1, int(left[0]) + 1 if len(left) else 1), "right")
        for k, n in enumerate(live.tolist()):
            if len(self.states) > STATES:
                state = self.compact(state)
            s, b = state[:n], data[at[:n] + k]
            to = self.next[s, b]
            if (to < 0).any():
                for code in np.unique(s[to < 0] << 8 | b[to < 0]).tolist():
                    self.step(code >> 8, code & 255)
                to = self.next[s, b]
            total[:n] += self.adds[s, b]
            state[:n] = to
        back = np.empty(len(order), np.int64)
        back[order] = np.arange(len(order))
        return total[back], state[back]
