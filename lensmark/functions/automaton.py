"""Many phrases in many texts at once: an Aho-Corasick automaton over bytes, stepped over Arrow buffers.

All texts of a batch are cut into pieces of PIECE bytes, each lengthened by the longest phrase less one, and all pieces take a step together: one
look-up a byte in a table of states, however many phrases there are. A text of any length is as many pieces as it needs. What is
found in two pieces is the same place of the text, and only a phrase's first place counts.
"""

from __future__ import annotations

from collections import deque

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

PIECE = 512
#: Bytes of texts that are stepped over at once; a single longer text is a pass of its own.
AT_ONCE = 1 << 22


class Automaton:
    """phrases: distinct ones of a byte at least. State 0 is the start; table has 256 next states a state."""

    def __init__(self, phrases: list[str]):
        encoded = [p.encode() for p in phrases]
        if not all(encoded) or len(set(encoded)) < len(encoded):
            raise ValueError("phrases are distinct and not empty")
        children, ends = [{}], [[]]
        for i, phrase in enumerate(encoded):
            at = 0
            for byte in phrase:
                if byte not in children[at]:
                    children[at][byte] = len(children)
                    children.append({})
                    ends.append([])
                at = children[at][byte]
            ends[at].append(i)
        table = np.zeros((len(children), 256), np.int32)
        fall, queue = [0] * len(children), deque([0])
        while queue:  # by depth: where a state falls back to is complete before it
            at = queue.popleft()
            if at:
                table[at] = table[fall[at]]
                ends[at] = ends[at] + ends[fall[at]]
            for byte, to in children[at].items():
                fall[to] = int(table[at, byte]) if at else 0
                queue.append(to)
            for byte, to in children[at].items():
                table[at, byte] = to
        self.longest = max(map(len, encoded), default=1)
        self.sizes = np.array([len(p) for p in encoded], np.int64)
        # The states that end a phrase come last, so that one comparison tells them.
        order = np.argsort([bool(e) for e in ends], kind="stable")
        place = np.empty(len(order), np.int32)
        place[order] = np.arange(len(order))
        self.plain = len(order) - sum(map(bool, ends))
        kind = np.uint16 if len(order) < 1 << 16 else np.int32
        self.table = place[table[order]].astype(kind).ravel()
        self.start = kind(place[0])
        own = [ends[i] for i in order[self.plain :]]
        self.cut = np.concatenate(([0], np.cumsum([len(e) for e in own]))).astype(np.int64)
        self.phrase = np.array([i for e in own for i in e], np.int64)

    def first(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """text, phrase, byte in the text of the first place of each phrase in each text, by text and phrase. offsets: n + 1 of the texts in data."""
        sizes = np.diff(offsets)
        count = -(-sizes // PIECE)
        text = np.repeat(np.arange(len(sizes)), count)
        start = offsets[:-1][text] + (np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count)) * PIECE
        size = np.minimum(offsets[1:][text] - start, PIECE + self.longest - 1)
        order = np.argsort(-size, kind="stable")
        text, start, size = text[order], start[order], size[order]
        live = np.searchsorted(-size, -np.arange(1, (size[0] if len(size) else 0) + 1), "right")
        state = np.full(len(text), self.start, np.int64)
        found_piece, found_state, found_end = [], [], []
        for step, n in enumerate(live):
            now = self.table[(state[:n] << 8) | data[start[:n] + step]]
            state[:n] = now
            if len(hit := np.flatnonzero(now >= self.plain)):
                found_piece.append(hit)
                found_state.append(now[hit])
                found_end.append(start[hit] + step + 1)
        if not found_piece:
            none = np.empty(0, np.int64)
            return none, none, none
        piece, at, end = np.concatenate(found_piece), np.concatenate(found_state).astype(np.int64) - self.plain, np.concatenate(found_end)
        n = self.cut[at + 1] - self.cut[at]
        index = np.repeat(self.cut[at] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        phrase, text, end = self.phrase[index], np.repeat(text[piece], n), np.repeat(end, n)
        begin = end - self.sizes[phrase]
        order = np.lexsort((begin, phrase, text))
        text, phrase, begin = text[order], phrase[order], begin[order]
        new = np.ones(len(text), bool)
        new[1:] = (text[1:] != text[:-1]) | (phrase[1:] != phrase[:-1])
        return text[new], phrase[new], (begin - offsets[text])[new]


_PLACE = pa.list_(pa.struct([("phrase", pa.int32()), ("at", pa.int32())]))
#: The Spark type of what places() makes of a text.
PLACES = "array<struct<phrase:int,at:int>>"


def places(automaton: Automaton, texts: pa.Array) -> pa.Array:
    """Each text's phrases, by number, with the character (from 1) where each is first; null texts have none."""
    column = pc.fill_null(texts.cast(pa.large_string()), "")
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    texts_, phrases, ats, row = [], [], [], 0
    while row < len(column):
        end = min(max(int(np.searchsorted(offsets, offsets[row] + AT_ONCE, "right")) - 1, row + 1), len(column))
        own = data[offsets[row] : offsets[end]]
        cut = offsets[row : end + 1] - offsets[row]
        text, phrase, at = automaton.first(own, cut)
        characters = np.concatenate(([0], np.cumsum((own & 0xC0) != 0x80)))
        begin = cut[text]
        texts_.append(text + row)
        phrases.append(phrase)
        ats.append(characters[begin + at] - characters[begin] + 1)
        row = end
    text = np.concatenate([np.empty(0, np.int64), *texts_])
    lists = np.searchsorted(text, np.arange(len(column) + 1)).astype(np.int32)
    values = pa.StructArray.from_arrays([pa.array(np.concatenate([np.empty(0, np.int64), *phrases]).astype(np.int32)), pa.array(np.concatenate([np.empty(0, np.int64), *ats]).astype(np.int32))], fields=list(_PLACE.value_type))
    return pa.ListArray.from_arrays(pa.array(lists), values)
