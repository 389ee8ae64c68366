"""Structural index of JSON texts, built with array operations over a whole batch at once.

The texts of a batch lie end to end in one byte buffer. Bitmaps of quotes (those not escaped),
brackets and delimiters are made for the buffer; quote parity says what stands inside strings; prefix
sums of +1 and -1 give the nesting depth. Sorting the structural characters by depth puts each
container's own characters side by side, from which the spans of its members are read off. Only the
strings that are asked for are ever decoded.
"""

from __future__ import annotations

import json
import re
from dataclasses import dataclass

import numpy as np

_OPEN, _CLOSE, _COMMA, _COLON = 1, 2, 3, 4
_KIND = np.zeros(256, np.int8)
for _c, _k in ((b"{", _OPEN), (b"[", _OPEN), (b"}", _CLOSE), (b"]", _CLOSE), (b",", _COMMA), (b":", _COLON)):
    _KIND[_c[0]] = _k
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0D]] = True
_QUOTE, _BACKSLASH, _BRACE, _SQUARE = ord('"'), ord("\\"), ord("{"), ord("[")
_ESCAPED = np.zeros(256, bool)
_ESCAPED[list(b'"\\/bfnrtu')] = True
_HEX = np.zeros(256, bool)
_HEX[list(b"0123456789abcdefABCDEF")] = True

# numbers by a table of states and classes of bytes: 0, other digits, minus, plus, point, exponent, else
_CLASS = np.full(256, 6, np.int8)
for _i, _bytes in enumerate((b"0", b"123456789", b"-", b"+", b".", b"eE")):
    _CLASS[list(_bytes)] = _i
_START, _MINUS, _ZERO, _WHOLE, _POINT, _PART, _EXP, _SIGN, _POWER, _NO = range(10)
_NEXT = np.full((10, 7), _NO, np.int8)
for _from, _steps in {
    _START: {0: _ZERO, 1: _WHOLE, 2: _MINUS},
    _MINUS: {0: _ZERO, 1: _WHOLE},
    _ZERO: {4: _POINT, 5: _EXP},
    _WHOLE: {0: _WHOLE, 1: _WHOLE, 4: _POINT, 5: _EXP},
    _POINT: {0: _PART, 1: _PART},
    _PART: {0: _PART, 1: _PART, 5: _EXP},
    _EXP: {0: _POWER, 1: _POWER, 2: _SIGN, 3: _SIGN},
    _SIGN: {0: _POWER, 1: _POWER},
    _POWER: {0: _POWER, 1: _POWER},
}.items():
    for _class, _to in _steps.items():
        _NEXT[_from, _class] = _to
_ENDS = np.isin(np.arange(10), (_ZERO, _WHOLE, _PART, _POWER))
_LONG = re.compile(rb"-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][-+]?[0-9]+)?")


@dataclass
class Index:
    """Members of all containers of a batch; arrays run parallel, ordered by container.

    A member is one element of an array or one field of an object. ``child`` is the container that its
    value opens, or -1. ``key_from`` is -1 for elements of arrays.
    """

    buffer: np.ndarray
    data: bytes
    bad: np.ndarray  # by record: the text is no well-formed object or array
    root: np.ndarray  # by record: the container it opens with, or -1
    owner: np.ndarray  # by member: container
    place: np.ndarray  # by member: place in its container, from 0
    key_from: np.ndarray
    key_to: np.ndarray
    value_from: np.ndarray
    value_to: np.ndarray
    child: np.ndarray
    is_array: np.ndarray  # by container
    first: np.ndarray  # by container: its first member
    count: np.ndarray  # by container

    def text(self, start: int, end: int) -> str | None:
        """A value as it stands: strings decoded, null as None, anything else as its text."""
        if self.buffer[start] == _QUOTE:
            raw = self.data[start + 1 : end - 1]
            if b"\\" in raw:
                try:
                    return json.loads(self.data[start:end], strict=False)
                except ValueError:
                    pass
            return raw.decode("utf-8", "replace")
        raw = self.data[start:end]
        return None if raw == b"null" else raw.decode("utf-8", "replace")

    def texts(self, members: np.ndarray) -> list[str | None]:
        """Values of members; None for member -1."""
        starts, ends = self.value_from[members], self.value_to[members]
        return [None if m < 0 else self.text(s, e) for m, s, e in zip(members.tolist(), starts.tolist(), ends.tolist(), strict=True)]

    def keys(self, members: np.ndarray) -> list[str]:
        return [self.text(s, e) or "" for s, e in zip(self.key_from[members].tolist(), self.key_to[members].tolist(), strict=True)]

    def find(self, containers: np.ndarray, key: str) -> np.ndarray:
        """For each container, its member of that key (the last one, where a key is repeated) or -1."""
        out = np.full(len(containers), -1, np.int64)
        if not len(containers) or not len(self.owner):
            return out
        wanted = np.frombuffer(json.dumps(key, ensure_ascii=False).encode(), np.uint8)
        size = self.key_to - self.key_from
        near = np.flatnonzero((self.key_from >= 0) & (size == len(wanted)))
        if len(near):
            near = near[(self.buffer[self.key_from[near][:, None] + np.arange(len(wanted))] == wanted).all(1)]
        if self._escaped_keys is not None and len(self._escaped_keys):
            hit = [m for m, k in zip(self._escaped_keys.tolist(), self.keys(self._escaped_keys), strict=True) if k == key]
            near = np.union1d(near, np.array(hit, np.int64))
        by_container = np.full(len(self.first), -1, np.int64)
        np.maximum.at(by_container, self.owner[near], near)
        known = containers >= 0
        out[known] = by_container[containers[known]]
        return out

    _escaped_keys: np.ndarray | None = None

    def spread(self, members: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Elements of the arrays that members hold; a value that is no array stands for itself.

        Returns, for each element: which of ``members`` it comes from, its place, and the member that
        holds it. Absent values and nulls in place of an array give nothing.
        """
        source = np.flatnonzero(members >= 0)
        held = members[source]
        keep = ~self._is_null(held)
        source, held = source[keep], held[keep]
        child = self.child[held]
        array = (child >= 0) & self.is_array[np.maximum(child, 0)]
        n = np.where(array, self.count[np.maximum(child, 0)], 1) if len(held) else np.zeros(0, np.int64)
        which = np.repeat(np.arange(len(held)), n)
        place = np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n)
        element = np.where(array[which], self.first[np.maximum(child[which], 0)] + place, held[which])
        return source[which], place, element

    def members_of(self, members: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Fields of the objects that members hold: which of ``members``, and the field."""
        source = np.flatnonzero(members >= 0)
        child = self.child[members[source]]
        keep = (child >= 0) & ~self.is_array[np.maximum(child, 0)]
        source, child = source[keep], child[keep]
        n = self.count[child] if len(child) else np.zeros(0, np.int64)
        which = np.repeat(np.arange(len(child)), n)
        place = np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n)
        return source[which], self.first[child[which]] + place

    def last_of_key(self, members: np.ndarray) -> np.ndarray:
        """Which of some fields are the last of their key in their object."""
        seen: dict[tuple[int, str], int] = {}
        for i, (owner, key) in enumerate(zip(self.owner[members].tolist(), self.keys(members), strict=True)):
            seen[owner, key] = i
        return np.array(sorted(seen.values()), np.int64)

    def object_in(self, members: np.ndarray) -> np.ndarray:
        """The object that each member holds, or -1."""
        child = np.where(members >= 0, self.child[members], -1)
        return np.where((child >= 0) & ~self.is_array[np.maximum(child, 0)], child, -1) if len(self.is_array) else child

    def is_text(self, members: np.ndarray) -> np.ndarray:
        return (members >= 0) & (self.buffer[np.minimum(self.value_from[members], len(self.buffer) - 1)] == _QUOTE)

    def _is_null(self, members: np.ndarray) -> np.ndarray:
        start = self.value_from[members]
        return (self.value_to[members] - start == 4) & (self.buffer[np.minimum(start, len(self.buffer) - 1)] == ord("n"))


def _after_odd_backslashes(buffer: np.ndarray) -> np.ndarray:
    """Places of characters that follow an odd run of backslashes."""
    at = np.flatnonzero(buffer == _BACKSLASH)
    if not len(at):
        return at
    ends = np.flatnonzero(np.append(np.diff(at) != 1, True))
    sizes = np.diff(np.append(-1, ends))
    return at[ends[sizes % 2 == 1]] + 1


def _plain_values(buffer: np.ndarray, data: bytes, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Whether each span is a number, true, false or null, and nothing else."""
    size = end - start
    good = np.zeros(len(start), bool)
    for word in (b"null", b"true", b"false"):
        at = np.flatnonzero(size == len(word))
        good[at] |= (buffer[start[at][:, None] + np.arange(len(word))] == np.frombuffer(word, np.uint8)).all(1)
    left = np.flatnonzero(~good)
    state = np.zeros(len(left), np.int8)
    for i in range(min(int(size[left].max(initial=0)), 64)):  # all spans at once, byte by byte
        on = np.flatnonzero(size[left] > i)
        state[on] = _NEXT[state[on], _CLASS[buffer[start[left[on]] + i]]]
    good[left] = _ENDS[state]
    for i in left[size[left] > 64].tolist():
        good[i] = _LONG.fullmatch(data, start[i], end[i]) is not None
    return good


def _build(texts: list[bytes], skip: np.ndarray) -> tuple[Index | None, np.ndarray]:
    """The index over the texts not skipped, and which texts turn out malformed."""
    sizes = np.array([0 if s else len(t) for t, s in zip(texts, skip.tolist(), strict=True)], np.int64)
    ends = np.cumsum(sizes + 1)  # a line break parts the texts
    data = b"\n".join(b"" if s else t for t, s in zip(texts, skip.tolist(), strict=True)) + b"\n"
    buffer = np.frombuffer(data, np.uint8)
    record_of = lambda at: np.searchsorted(ends, at, side="right")
    wrong = skip.copy()

    quotes = np.flatnonzero(buffer == _QUOTE)
    escaped = _after_odd_backslashes(buffer)
    if len(escaped):
        quotes = quotes[~np.isin(quotes, escaped, assume_unique=True)]
    wrong |= np.bincount(record_of(quotes), minlength=len(texts)) % 2 == 1
    if len(escaped):  # what a backslash begins must be an escape
        after = buffer[np.minimum(escaped, len(buffer) - 1)]
        points = np.flatnonzero(after == ord("u"))
        valid = _ESCAPED[after]
        valid[points] = _HEX[buffer[np.minimum(escaped[points][:, None] + np.arange(1, 5), len(buffer) - 1)]].all(1)
        wrong[record_of(escaped[~valid] - 1)] = True
    if (wrong & ~skip).any():
        return None, wrong
    control = np.flatnonzero(buffer < 0x20)  # within a string, one must be written as an escape
    wrong[record_of(control[np.searchsorted(quotes, control) % 2 == 1])] = True

    marks = np.flatnonzero(_KIND[buffer])
    marks = marks[np.searchsorted(quotes, marks) % 2 == 0]
    kind = _KIND[buffer[marks]]
    step = np.where(kind == _OPEN, 1, np.where(kind == _CLOSE, -1, 0))
    record = record_of(marks)
    # a text's depth must come back to 0 at its end, and never fall below 0 or leave 0 twice
    net = np.bincount(record, step, minlength=len(texts))
    depth = np.cumsum(step) - (np.cumsum(net) - net).astype(np.int64)[record]
    wrong |= net != 0
    opens = np.bincount(record[(kind == _OPEN) & (depth == 1)], minlength=len(texts))
    wrong |= opens != 1
    wrong[record[(depth < 0) | ((depth == 0) & (kind != _CLOSE))]] = True
    if (wrong & ~skip).any():
        return None, wrong

    level = depth + (kind == _CLOSE)
    order = np.argsort(level, kind="stable")
    at, kind, record, level = marks[order], kind[order], record[order], level[order]
    owner = np.cumsum(kind == _OPEN) - 1
    opened = np.flatnonzero(kind == _OPEN)
    closed = np.flatnonzero(kind == _CLOSE)
    container_at = at[opened]
    wrong[record[opened[buffer[at[closed]] != buffer[container_at] + 2]]] = True
    is_array = buffer[container_at] == _SQUARE

    filled = np.flatnonzero(~_SPACE[buffer])
    # nothing but blanks stands before a text's root or after it
    roots = np.flatnonzero(level[opened] == 1)
    starts = ends - sizes - 1
    of_root = record[opened[roots]]
    wrong[of_root[filled[np.searchsorted(filled, starts[of_root])] != container_at[roots]]] = True
    wrong[of_root[filled[np.searchsorted(filled, ends[of_root]) - 1] != at[closed[roots]]]] = True
    after = lambda p: filled[np.minimum(np.searchsorted(filled, p), max(len(filled) - 1, 0))]
    before = lambda p: filled[np.maximum(np.searchsorted(filled, p) - 1, 0)] + 1

    edge = np.flatnonzero(kind != _COLON)
    begins = edge[kind[edge] != _CLOSE]  # a member begins after an opening bracket or a comma
    finishes = edge[np.searchsorted(edge, begins) + 1]
    colons = np.cumsum(kind == _COLON)
    n_colons = colons[finishes] - colons[begins]
    lone = (kind[begins] == _OPEN) & (kind[finishes] == _CLOSE) & (after(at[begins] + 1) == at[finishes])
    begins, finishes, n_colons = begins[~lone], finishes[~lone], n_colons[~lone]
    owners = owner[begins]
    in_array = is_array[owners]
    wrong[record[begins[n_colons != np.where(in_array, 0, 1)]]] = True
    colon = np.where(in_array, begins, np.minimum(begins + 1, len(kind) - 1))
    key_from = np.where(in_array, -1, after(at[begins] + 1))
    key_to = np.where(in_array, -1, before(at[colon]))
    value_from, value_to = after(at[colon] + 1), before(at[finishes])
    wrong[record[begins[value_to <= value_from]]] = True
    # strings must close where their span ends, and keys be strings
    def pair(p: np.ndarray) -> np.ndarray:
        """Where the string that begins at p ends, or -1."""
        i = np.minimum(np.searchsorted(quotes, p), len(quotes) - 2)
        return np.where((quotes[i] == p) & (i % 2 == 0), quotes[i + 1], -1)

    if len(quotes):
        wrong[record[begins[~in_array & (pair(key_from) != key_to - 1)]]] = True
        strings = buffer[np.minimum(value_from, len(buffer) - 1)] == _QUOTE
        wrong[record[begins[strings & (pair(value_from) != value_to - 1)]]] = True
    else:
        wrong[record[begins[~in_array]]] = True
        strings = np.zeros(len(begins), bool)

    child = np.full(len(begins), -1, np.int64)
    brackets = np.isin(buffer[np.minimum(value_from, len(buffer) - 1)], (_BRACE, _SQUARE))
    by_place = np.argsort(container_at)
    if len(container_at):
        found = by_place[np.minimum(np.searchsorted(container_at[by_place], value_from), len(by_place) - 1)]
        child = np.where(brackets & (container_at[found] == value_from), found, -1)
        wrong[record[begins[(child >= 0) & (at[closed][child] != value_to - 1)]]] = True
    plain = ~strings & (child < 0)
    judged = np.flatnonzero(plain & (value_to > value_from))
    wrong[record[begins[judged[~_plain_values(buffer, data, value_from[judged], value_to[judged])]]]] = True
    if (wrong & ~skip).any():
        return None, wrong

    count = np.bincount(owners, minlength=len(container_at)).astype(np.int64)
    first = np.cumsum(count) - count
    order = np.argsort(owners, kind="stable")
    owners, key_from, key_to, value_from, value_to, child = (x[order] for x in (owners, key_from, key_to, value_from, value_to, child))
    place = np.arange(len(owners)) - first[owners] if len(owners) else owners
    root = np.full(len(texts), -1, np.int64)
    top = np.flatnonzero(level[opened] == 1)
    root[record_of(container_at[top])] = top
    slashes = np.flatnonzero(buffer == _BACKSLASH)
    escaped = np.flatnonzero((key_from >= 0) & (np.searchsorted(slashes, key_from) != np.searchsorted(slashes, key_to)))
    return Index(buffer, data, wrong, root, owners, place, key_from, key_to, value_from, value_to, child, is_array, first, count, escaped), wrong


def index(texts: list[bytes | None]) -> Index:
    """The index of a batch. Malformed texts are flagged in ``bad`` and have no members."""
    filled = [t if t is not None else b"" for t in texts]
    skip = np.array([not t.strip() for t in filled], bool)
    while True:  # each pass that fails sets the malformed texts aside; no text is set aside twice
        built, wrong = _build(filled, skip)
        if built is not None:
            built.bad = wrong
            return built
        skip = wrong
