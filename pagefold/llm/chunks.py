"""Encoding texts by chunks that repeat.

A space followed by anything but white space always begins a match of the pattern, and what lies on either side of it
is matched alike with or without the other side. So a text can be cut there, and the ids of a chunk be remembered
within a worker. The memory is bounded and only saves time: it never changes the ids.
"""

import re
from collections.abc import Callable

import regex

#: A space that does not begin a match by itself: such texts are cut at every match instead.
AWKWARD = re.compile(r" (?:\s|\Z)")
LONG = 64
STOPS = ".,"


class Memory:
    """Ids of the chunks used lately, about twice room of them: older ones go when room are full."""

    def __init__(self, room: int):
        self.room = room
        self.now: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.stops: dict[str, bytes] = {}

    def hold(self, wanted: set[str], encode: Callable[[list[str]], list[bytes]], lead: str) -> dict[str, bytes]:
        """The ids of all wanted chunks."""
        if len(self.now) > self.room:
            self.old, self.now = self.now, {}
        now, old = self.now, self.old
        # a word and a stop are two matches: the word alone is remembered
        ended = [c for c in wanted if c[-1:] in STOPS and c[:-1].isalpha()]
        wanted.difference_update(ended)
        wanted.update([c[:-1] for c in ended])
        out, new = {}, []
        for c in wanted:
            i = now.get(c)
            if i is None:
                i = old.get(c)
                if i is None:
                    new.append(c)
                    continue
                now[c] = i
            out[c] = i
        if new:
            ids = dict(zip(new, encode([lead + c for c in new]), strict=True))
            out.update(ids)
            now.update((c, i) for c, i in ids.items() if len(c) <= LONG)
        if ended:
            if not self.stops:
                self.stops.update(zip(STOPS, encode(list(STOPS)), strict=True))
            stops = self.stops
            for c in ended:
                out[c] = out[c[:-1]] + stops[c[-1]]
        return out


def cut(text: str, matches: Callable[[str], list[str]]) -> tuple[list[str], list[str]]:
    """The chunks of a text: as they are, and then those that follow a space."""
    if AWKWARD.search(text):
        return matches(text), []
    head, _, rest = text.partition(" ")
    return [head] if head else [], rest.split(" ") if rest else []


class Chunks:
    def __init__(self, encode: Callable[[list[str]], list[bytes]], pattern: str, room: int = 300_000):
        """encode: the ids of each of some chunks, as bytes."""
        self.encode = encode
        self.matches = regex.compile(pattern).findall
        self.bare, self.spaced = Memory(room), Memory(room)  # chunks as they are, and after a space

    def ids(self, texts: list[str]) -> list[bytes]:
        parts = [cut(t, self.matches) for t in texts]
        bare, spaced = set(), set()
        for a, b in parts:
            bare.update(a)
            spaced.update(b)
        one, two = self.bare.hold(bare, self.encode, "").__getitem__, self.spaced.hold(spaced, self.encode, " ").__getitem__
        return [b"".join(map(one, a)) + b"".join(map(two, b)) for a, b in parts]


def in_steps(texts: list[str], characters: int = 2_000_000):
    """Lists of texts of about so many characters."""
    step, n = [], 0
    for t in texts:
        step.append(t)
        n += len(t)
        if n >= characters:
            yield step
            step, n = [], 0
    if step:
        yield step


def slices(batches, rows: int = 1000):
    """Batches of fewer rows, so that less of a large batch is held as Python objects."""
    for b in batches:
        for a in range(0, b.num_rows, rows):
            yield b.slice(a, rows)
