"""A byte-pair encoder as a deterministic automaton.

Its arcs are labelled with tokens, so a walk spells a text and its labels are the encoding. The automaton starts with one
state and the single bytes. Each merge (u, v), in order of rank, puts a gadget into it: where an arc u is followed by an
arc v, an arc uv is added beside them and v is no longer allowed after u; the state behind the new arc copies the one
behind v. Unrolled for a state t and a label w, the gadgets give the rule in ``allowed``: the later made of both says from
which earlier pair the arc came, so each step goes one merge down.

A text is read byte by byte over two tables. ``moves`` holds the transition of each suffix state (the longest end of what
was read that starts a token) by each byte; ``arcs`` says which token may follow which. Of the tokens that end at a byte,
exactly one may follow the last token of what lies before it, so the last token of every prefix is known once its byte
is read and nothing is ever taken back. Both tables are filled on first use, since most pairs of tokens never meet.
"""

from __future__ import annotations

import array
import base64
import re
from collections.abc import Iterable

import regex

START = -1
#: Above every rank: all merges hold.
FINAL = 1 << 60
#: Kept arcs of the table; beyond that it is emptied, so memory has a bound.
ARCS = 1_000_000
#: The published pattern for texts of ASCII only, where its classes are ranges; alternatives are ordered by frequency,
#: which changes nothing, as no two of the first four match at one place.
ASCII = r" ?[A-Za-z]++|'(?:s|t|re|ve|m|ll|d)| ?[0-9]++| ?[^\t-\r A-Za-z0-9]++|[\t-\r ]+(?![^\t-\r ])|[\t-\r ]+"


def split_pattern() -> str:
    """The pattern that splits text before the merges, as published with the rank files."""
    import public_tokenizers

    return public_tokenizers.PATTERN


def read_ranks(path: str) -> dict[bytes, int]:
    """A rank file: each line has a token in base64 and its rank."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class Automaton:
    """Encoder and decoder for a rank file's vocabulary."""

    def __init__(self, ranks: dict[bytes, int], pattern: str | None = None, keep: int = 200_000):
        self.ranks = ranks
        self.tokens = {r: t for t, r in ranks.items()}
        self.next: list[dict[int, int]] = [{}]  # suffix states: the tokens' prefixes, 0 is empty
        self.above: list[tuple[int, int]] = [(0, 0)]  # the state one byte shorter, and that byte
        self.own: dict[int, int] = {}  # the token that a state spells
        for token, rank in ranks.items():
            at = 0
            for x in token:
                to = self.next[at].get(x)
                if to is None:
                    to = self.next[at][x] = len(self.next)
                    self.next.append({})
                    self.above.append((at, x))
                at = to
            self.own[at] = rank
        self.moves: dict[int, int] = {}
        self.shorter: dict[int, int] = {}
        self.ends: dict[int, tuple[tuple[int, int], ...]] = {}
        self.parts: dict[int, tuple[int, int] | None] = {}
        self.rank_of_pair: dict[tuple[int, int], int] | None = None
        self.arcs: dict[tuple[int, int], bool] = {}
        pattern = pattern or split_pattern()
        self.general = regex.compile(pattern).findall
        self.ascii = re.compile(ASCII).findall if pattern == split_pattern() else self.general
        self.words = _Words(self, keep)

    def compile(self) -> Automaton:
        """Find the two tokens of every merge: the split whose halves' own encodings are single tokens and whose pair is
        allowed when the merge comes. Needed once before encoding."""
        if self.rank_of_pair is not None:
            return self
        self.rank_of_pair = {}
        ranks = self.ranks
        for token, rank in sorted(self.ranks.items(), key=lambda x: x[1]):
            self.parts[rank] = None
            if len(token) == 1:
                continue
            # Before this merge the token's bytes are spelt by two arcs: of its splits into tokens, the one that is allowed.
            for i in range(1, len(token)):
                u, v = ranks.get(token[:i], rank), ranks.get(token[i:], rank)
                if u < rank and v < rank and self._spelt(u) and self._spelt(v) and self.allowed(u, v, rank):
                    self.parts[rank] = (u, v)
                    self.rank_of_pair[u, v] = rank
                    break
        self.arcs.clear()
        return self

    def _spelt(self, rank: int) -> bool:
        """Whether merges make the token at all."""
        return self.parts[rank] is not None or len(self.tokens[rank]) == 1

    def allowed(self, t: int, w: int, before: int) -> bool:
        """Whether state t (the last token) has an arc w in the automaton of the merges with ranks under ``before``."""
        pair, parts = self.rank_of_pair, self.parts
        while True:
            if pair.get((t, w), before) < before:
                return False
            if t == w and parts[t] is None:
                return True
            if w >= t and parts[w] is not None:
                u, v = parts[w]
                if t == w:
                    # The state behind the new arc copies the one behind v as it was when the merge came.
                    before, t, w = w, v, u
                    if t == w:
                        return True
                elif t == u and u == v:
                    return False  # equal pairs merge from the left: a lone u is never followed by uu
                else:
                    before, w = w, u
            elif parts[t] is not None and t > w:
                before, t = t, parts[t][1]
            else:
                return True

    def _move(self, state: int, byte: int) -> int:
        """The suffix state after one more byte."""
        key = state << 8 | byte
        to = self.moves.get(key)
        if to is None:
            to = self.next[state].get(byte)
            if to is None:
                to = self._move(self._shorter(state), byte) if state else 0
            self.moves[key] = to
        return to

    def _shorter(self, state: int) -> int:
        """The state of the longest proper end of what a state spells."""
        to = self.shorter.get(state)
        if to is None:
            up, byte = self.above[state]
            to = self.shorter[state] = self._move(self._shorter(up), byte) if up else 0
        return to

    def _ends(self, state: int) -> tuple[tuple[int, int], ...]:
        """(rank, length) of the tokens that end where a state does, the longest first."""
        out = self.ends.get(state)
        if out is None:
            own = self.own.get(state)
            out = ((own, len(self.tokens[own])),) if own is not None and self._spelt(own) else ()
            out = self.ends[state] = out + (self._ends(self._shorter(state)) if state else ())
        return out

    def _walk(self, word: bytes, before: int) -> list[int]:
        """The labels of the walk that spells ``word`` with tokens of ranks under ``before``."""
        final, arcs, moves, ends = before >= FINAL, self.arcs, self.moves, self.ends
        last = [START] * (len(word) + 1)  # the last token of each prefix
        state = i = 0
        for byte in word:
            i += 1
            to = moves.get(state << 8 | byte)
            state = self._move(state, byte) if to is None else to
            found = ends.get(state)
            for w, n in self._ends(state) if found is None else found:
                if w >= before:
                    continue
                t = last[i - n]
                if t != START:
                    if final:
                        ok = arcs.get((t, w))
                        if ok is None:
                            ok = arcs[t, w] = self.allowed(t, w, before)
                    else:
                        ok = self.allowed(t, w, before)
                    if not ok:
                        continue
                elif i != n:
                    continue
                last[i] = w
                break
            else:
                raise ValueError(f"no walk spells {word[:i]!r}")
        out = []
        while i:
            out.append(last[i])
            i -= len(self.tokens[last[i]])
        return out[::-1]

    def encode_word(self, word: bytes) -> list[int]:
        """The ids of one pre-split word."""
        own = self.ranks.get(word)
        if own is not None and (len(word) == 1 or self.parts[own] is not None):
            return [own]
        return self._walk(word, FINAL)

    def split(self, text: str) -> list[str]:
        """The words of a text, with the white space and punctuation between them."""
        return self.ascii(text) if text.isascii() else self.general(text)

    def encode_bytes(self, text: str) -> bytes:
        """The ids of a text as consecutive little-endian 32-bit integers."""
        return b"".join(map(self.words.__getitem__, self.split(text)))

    def encode(self, text: str | None) -> list[int]:
        """The ids of a text; none for an empty or null text."""
        return list(memoryview(self.encode_bytes(text)).cast("i")) if text else []

    def decode(self, ids: Iterable[int]) -> str:
        """The text whose walk has these labels; bytes that are no UTF-8 become replacement characters."""
        return b"".join(self.tokens[i] for i in ids).decode("utf-8", "replace")


class _Words(dict):
    """Encoded words by their text; emptied when ``keep`` words are held, so memory has a bound."""

    def __init__(self, automaton: Automaton, keep: int):
        self.automaton, self.keep = automaton, keep

    def __missing__(self, word: str) -> bytes:
        value = array.array("i", self.automaton.encode_word(word.encode("utf-8", "surrogatepass"))).tobytes()
        if len(self) >= self.keep:
            self.clear()
        if len(self.automaton.arcs) >= ARCS:
            self.automaton.arcs.clear()
        if len(word) <= 64:
            self[word] = value
        return value


_LOADED: dict[str, Automaton] = {}


def load(path: str) -> Automaton:
    """The compiled automaton of a rank file, made once a Python worker."""
    if path not in _LOADED:
        _LOADED[path] = Automaton(read_ranks(path)).compile()
    return _LOADED[path]
