"""A minimal acyclic transducer: words to lists of ids, as flat arrays that can be memory-mapped."""

from __future__ import annotations

import json
import mmap
import tempfile
from collections.abc import Iterable

import numpy as np


class _State:
    __slots__ = ("arcs", "final", "number")

    def __init__(self) -> None:
        self.arcs: dict[int, _State] = {}
        self.final = False
        self.number = -1

    def key(self) -> tuple:
        return (self.final, *((b, s.number) for b, s in self.arcs.items()))


def _minimal(words: list[bytes]) -> list[_State]:
    """States of the smallest automaton for sorted, distinct words, each after all that it leads to; the start is last."""
    register: dict[tuple, _State] = {}
    states: list[_State] = []
    start, path = _State(), []  # path: (state, byte, next) of the last word

    def settle(depth: int) -> None:
        """Replace what lies below ``depth`` on the path by equal states that are there already."""
        while len(path) > depth:
            parent, byte, state = path.pop()
            if (known := register.get(key := state.key())) is None:
                state.number = len(states)
                states.append(state)
                register[key] = known = state
            parent.arcs[byte] = known

    last = b""
    for word in words:
        same = next((i for i, (a, b) in enumerate(zip(word, last, strict=False)) if a != b), min(len(word), len(last)))
        settle(same)
        state = path[-1][2] if path else start
        for byte in word[same:]:
            state.arcs[byte] = after = _State()
            path.append((state, byte, after))
            state = after
        state.final = True
        last = word
    settle(0)
    start.number = len(states)
    states.append(start)
    return states


class Lexicon:
    """Words with their ids. Outputs of the arcs add up to a word's number, which leads to its ids."""

    NAMES = ("arcs", "targets", "outputs", "final", "offsets", "ids")

    def __init__(self, arrays: dict[str, np.ndarray]) -> None:
        self.__dict__.update(arrays)

    @classmethod
    def compile(cls, entries: Iterable[tuple[bytes, list[int]]]) -> Lexicon:
        ids = dict(entries)
        words = sorted(w for w in ids if w)
        states = _minimal(words)
        below = np.zeros(len(states), dtype=np.int64)  # words from each state on
        arcs, targets, outputs = [], [], []
        for state in states:
            passed = int(state.final)
            for byte, after in sorted(state.arcs.items()):
                arcs.append(state.number << 8 | byte)
                targets.append(after.number)
                outputs.append(passed)
                passed += int(below[after.number])
            below[state.number] = passed
        lists = [ids[w] for w in words]
        return cls(
            {
                "arcs": np.array(arcs, dtype=np.int64),
                "targets": np.array(targets, dtype=np.int32),
                "outputs": np.array(outputs, dtype=np.int32),
                "final": np.array([s.final for s in states], dtype=np.bool_),
                "offsets": np.cumsum([0, *map(len, lists)], dtype=np.int32),
                "ids": np.array([i for x in lists for i in x], dtype=np.uint32),
            }
        )

    def dump(self) -> bytes:
        arrays = [np.ascontiguousarray(getattr(self, n)) for n in self.NAMES]
        head = json.dumps([[n, a.dtype.str, len(a)] for n, a in zip(self.NAMES, arrays, strict=True)]).encode()
        out = bytearray(len(head).to_bytes(8, "little") + head)
        for a in arrays:
            out += b"\0" * (-len(out) % 8) + a.tobytes()
        return bytes(out)

    @classmethod
    def mapped(cls, data: bytes) -> Lexicon:
        """The lexicon in a memory-mapped file that goes with the process."""
        with tempfile.TemporaryFile() as file:
            file.write(data)
            file.flush()
            view = mmap.mmap(file.fileno(), 0, access=mmap.ACCESS_READ)
        size = int.from_bytes(view[:8], "little")
        at, arrays = 8 + size, {}
        for name, kind, n in json.loads(view[8 : 8 + size]):
            at += -at % 8
            arrays[name] = np.frombuffer(view, dtype=kind, count=n, offset=at)
            at += arrays[name].nbytes
        return cls(arrays)

    def numbers(self, words: list[bytes]) -> np.ndarray:
        """Number of each word, -1 where it isn't in the lexicon. All words are walked side by side."""
        lengths = np.array([len(w) for w in words], dtype=np.int64)
        found = np.full(len(words), -1, dtype=np.int64)
        if not len(self.arcs) or not len(words):
            return found
        data = np.frombuffer(b"".join(words), dtype=np.uint8)
        starts = np.cumsum(lengths) - lengths
        live = np.flatnonzero(lengths > 0)
        state, total = np.full(len(live), len(self.final) - 1, dtype=np.int64), np.zeros(len(live), dtype=np.int64)
        step = 0
        while len(live):
            key = state << 8 | data[starts[live] + step]
            at = np.searchsorted(self.arcs, key)
            at[at == len(self.arcs)] = 0
            ok = self.arcs[at] == key
            live, at = live[ok], at[ok]
            state, total = self.targets[at].astype(np.int64), total[ok] + self.outputs[at]
            step += 1
            done = lengths[live] == step
            ends = done & self.final[state]
            found[live[ends]] = total[ends]
            live, state, total = live[~done], state[~done], total[~done]
        return found

    def ids_of(self, number: int) -> np.ndarray:
        return self.ids[self.offsets[number] : self.offsets[number + 1]]
