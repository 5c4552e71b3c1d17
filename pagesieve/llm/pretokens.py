"""Word boundaries of the byte-level BPE pattern, found by class arrays and an associative scan.

The pattern is that of the rank files:
's|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+

No regular expression runs here. Every code point becomes a symbol, which holds what the pattern looks ahead for;
an automaton of eight states reads the symbols. A run of symbols is a function from
states to states, and such functions compose associatively: blocks of symbols are reduced to their functions
side by side, the functions are combined by a prefix scan, and each block then gets
its first state. A code point starts a match if the state before it and its symbol say so.
"""

from __future__ import annotations

import functools
import sys
import unicodedata

import numpy as np

# The code points with the property White_Space.
_WHITE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]

_OTHER, _LETTER, _NUMBER, _WHITE_SPACE = range(4)

# Symbols; a symbol plus FIRST is the same at the start of a text.
L, N, O, SHORT, LONG, JOIN, LAST, WHITE, FIRST = range(9)
# SHORT, LONG: an apostrophe with one of the one-letter and two-letter endings behind it.
# JOIN, LAST: a space, another white space, directly before something else. WHITE: any other white space.

# States: what the match so far can take up.
_FRESH, _L, _N, _O, _JOIN, _WHITE_RUN, _ONE_MORE, _TWO_MORE = range(8)
STATES = 8
BLOCK = 64


@functools.cache
def classes() -> np.ndarray:
    """The class of each code point: letter, number, white space or other."""
    kinds = "".join(unicodedata.category(chr(c))[0] for c in range(sys.maxunicode + 1))
    major = np.frombuffer(kinds.encode("ascii"), dtype=np.uint8)
    out = np.full(len(major), _OTHER, dtype=np.uint8)
    out[major == ord("L")] = _LETTER
    out[major == ord("N")] = _NUMBER
    out[_WHITE] = _WHITE_SPACE
    return out


@functools.cache
def automaton() -> tuple[np.ndarray, np.ndarray]:
    """Next state and whether a match starts, by symbol (with its first-of-text twin) and state."""
    to = np.zeros((2 * FIRST, STATES), dtype=np.uint8)
    starts = np.zeros((2 * FIRST, STATES), dtype=bool)
    runs = {L: _L, N: _N, O: _O}
    for state in range(STATES):
        for symbol in range(FIRST):
            if state in (_ONE_MORE, _TWO_MORE):
                to[symbol, state], begins = (_FRESH if state == _ONE_MORE else _ONE_MORE), False
            elif symbol in runs:
                to[symbol, state], begins = runs[symbol], state not in (runs[symbol], _JOIN)
            elif symbol in (SHORT, LONG):
                inside = state in (_O, _JOIN)
                to[symbol, state] = _O if inside else (_ONE_MORE if symbol == SHORT else _TWO_MORE)
                begins = not inside
            elif symbol in (JOIN, LAST):
                to[symbol, state], begins = (_JOIN if symbol == JOIN else _WHITE_RUN), True
            else:
                to[symbol, state], begins = _WHITE_RUN, state != _WHITE_RUN
            starts[symbol, state] = begins
    # The start of a text forgets what came before.
    to[FIRST:] = to[:FIRST, _FRESH : _FRESH + 1]
    starts[FIRST:] = starts[:FIRST, _FRESH : _FRESH + 1]
    return to, starts


def symbols(points: np.ndarray, firsts: np.ndarray) -> np.ndarray:
    """The symbol of each code point; `firsts` are the places where texts begin."""
    n = len(points)
    kind = classes()[points]
    last = np.zeros(n + 3, dtype=bool)  # last[i]: no code point i of the same text
    last[n:] = True
    last[firsts] = True
    ahead = np.concatenate([points, np.zeros(3, dtype=points.dtype)])
    out = np.take(np.array([O, L, N, WHITE], dtype=np.uint8), kind)
    white = kind == _WHITE_SPACE
    before_other = white.copy()
    before_other[:-1] &= ~white[1:] & ~last[1:n]
    before_other[-1:] = False
    out[before_other] = LAST
    out[before_other & (points == 0x20)] = JOIN
    at = np.flatnonzero(points == ord("'"))
    if len(at):
        one, two = ahead[at + 1], ahead[at + 2]
        here = ~last[at + 1]
        both = here & ~last[at + 2]
        short = here & np.isin(one, [ord(c) for c in "stmd"])
        long_ = both & (((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l")))
        out[at[short]] = SHORT
        out[at[long_]] = LONG
    out[firsts[firsts < n]] += FIRST
    return out


def states_before(symbol: np.ndarray) -> np.ndarray:
    """The automaton's state before each symbol, by a blocked associative scan."""
    to, _ = automaton()
    flat = to.ravel()
    n = len(symbol)
    blocks = -(-n // BLOCK)
    padded = np.zeros(blocks * BLOCK, dtype=np.uint8)
    padded[:n] = symbol
    columns = np.ascontiguousarray(padded.reshape(blocks, BLOCK).T)
    # The function of each block: where each of the states leads.
    function = np.broadcast_to(np.arange(STATES, dtype=np.uint8), (blocks, STATES)).copy()
    for column in columns:
        np.take(flat, (column * np.uint8(STATES))[:, None] + function, out=function)
    # Prefix scan: after a step of width w a function spans up to 2 w blocks.
    width = 1
    while width < blocks:
        joined = np.take_along_axis(function[width:], function[:-width], axis=1)
        function = np.concatenate([function[:width], joined])
        width *= 2
    state = np.zeros(blocks, dtype=np.uint8)
    state[1:] = function[:-1, _FRESH]
    out = np.empty((BLOCK, blocks), dtype=np.uint8)
    for k, column in enumerate(columns):
        out[k] = state
        state = np.take(flat, column * np.uint8(STATES) + state)
    return out.T.ravel()[:n]


def match_starts(points: np.ndarray, firsts: np.ndarray) -> np.ndarray:
    """Where the matches of the pattern begin, as places in `points`."""
    if not len(points):
        return np.zeros(0, dtype=np.int64)
    symbol = symbols(points, firsts)
    _, starts = automaton()
    return np.flatnonzero(starts.ravel()[symbol * np.uint8(STATES) + states_before(symbol)])
