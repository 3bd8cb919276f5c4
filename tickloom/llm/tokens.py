"""Token ids of whole texts, from the tokenizers library, with every piece of text asked for once.

The usual vocabulary file splits texts into pieces (runs of letters, single digits, runs of
signs) that are encoded one by one. A worker finds the pieces of a stretch of texts in
numpy, looks all of them up in a table of the pieces it has met, and asks the library for
the distinct new ones only. Words for which the pieces might depend on each other go to
the library whole, and so do the texts of any file with other rules.
"""

from __future__ import annotations

import json
from functools import cache

import numpy as np
import pyarrow as pa

from .text import U, lowered, short_keys

#: Pieces that a worker remembers (about 30 bytes each) before it starts afresh.
REMEMBERED = 1 << 19
#: Pieces that the library is asked for at once: it holds some kilobytes for each while it works.
ASKED = 2_000
#: Bytes of text taken at once.
CHUNK = 1 << 18
#: Longest word, in bytes, that is remembered by its spelling instead of by its first and last 8 bytes.
LONGEST = 64

#: The rules under which a text's ids are the ids of its pieces.
RULES = {
    "normalizer": {
        "type": "Sequence",
        "normalizers": [
            {"type": "NFC"},
            {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "},
            {"type": "Lowercase"},
        ],
    },
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {
                "type": "Split",
                "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"},
                "behavior": "Removed",
                "invert": True,
            },
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
}

_SPACE, _LETTER, _DIGIT, _SIGN, _ODD = range(5)
_K1, _K2, _K3 = U(0x9E3779B97F4A7C15), U(0xC2B2AE3D27D4EB4F), U(0xD6E8FEB86659FD93)


@cache
def _classes() -> np.ndarray:
    """What a byte is by itself. 0xC3 opens the Latin letters that have a simple lower case;
    control bytes, other bytes beyond ASCII and the apostrophe, which joins letters after it, are odd."""
    table = np.full(256, _ODD, np.uint8)
    table[33:127] = _SIGN
    table[[*range(65, 91), *range(97, 123), 0xC3]] = _LETTER
    table[48:58] = _DIGIT
    table[39] = _ODD
    table[[32, *range(9, 14)]] = _SPACE
    return table


class Table:
    """Ids of known pieces. Entry 0 stands for "not there"."""

    def __init__(self, most: int):
        self.most = most
        self.clear()

    def clear(self) -> None:
        self.bits = max(10, (2 * self.most - 1).bit_length())
        self.slots = np.zeros(1 << self.bits, np.int32)
        self.head, self.tail = np.zeros(self.most + 1, U), np.zeros(self.most + 1, U)
        self.length = np.zeros(self.most + 1, np.uint8)
        self.start, self.count = np.zeros(self.most + 1, np.int64), np.zeros(self.most + 1, np.int32)
        self.pool = np.zeros(4 * self.most, np.int32)
        self.entries, self.used = 1, 0
        self.loose: dict[bytes, int] = {}

    def fits(self, new: int) -> bool:
        return self.entries + new <= self.most

    def grow(self, new: int) -> None:
        """Start afresh with room for so many entries."""
        self.most = new
        self.clear()

    def _slot(self, head, tail, length) -> np.ndarray:
        h = head * _K1 + tail * _K2 + length
        h ^= h >> U(32)
        h *= _K3
        return (h >> U(64 - self.bits)).astype(np.int64)

    def find(self, head: np.ndarray, tail: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Entries of pieces of up to 16 bytes, which first and last eight bytes and length tell apart."""
        slot = self._slot(head, tail, length)
        entry = self.slots[slot]
        wrong = (self.head[entry] != head) | (self.tail[entry] != tail) | (self.length[entry] != length)
        at = np.flatnonzero(wrong & (entry > 0))
        while len(at):  # another piece lies in the slot: go on to the next
            slot[at] = (slot[at] + 1) & (len(self.slots) - 1)
            entry[at] = found = self.slots[slot[at]]
            same = (self.head[found] == head[at]) & (self.tail[found] == tail[at]) & (self.length[found] == length[at])
            at = at[(found > 0) & ~same]
        return entry

    def add(self, ids: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """New entries whose ids follow each other in ``ids``."""
        n, total = len(counts), len(ids)
        if self.used + total > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros(max(len(self.pool), total), np.int32)])
        new = np.arange(self.entries, self.entries + n)
        self.pool[self.used : self.used + total] = ids
        self.start[new] = self.used + np.cumsum(counts) - counts
        self.count[new] = counts
        self.entries += n
        self.used += total
        return new

    def place(self, new: np.ndarray, head: np.ndarray, tail: np.ndarray, length: np.ndarray) -> None:
        self.head[new], self.tail[new], self.length[new] = head, tail, length
        slot = self._slot(head, tail, length)
        while len(new):
            free = self.slots[slot] == 0
            self.slots[slot[free]] = new[free]
            left = self.slots[slot] != new
            new, slot = new[left], (slot[left] + 1) & (len(self.slots) - 1)

    def gather(self, entry: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the entries one after the other, and how many end before each."""
        counts = self.count[entry]
        ends = np.zeros(len(entry) + 1, np.int64)
        np.cumsum(counts, out=ends[1:])
        at = np.repeat(self.start[entry] - ends[:-1], counts)
        at += np.arange(ends[-1])
        return self.pool[at], ends


class Encoder:
    """Ids of texts given as UTF-8 bytes."""

    def __init__(self, vocabulary: str, remembered: int = REMEMBERED):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(vocabulary)
        with open(vocabulary, encoding="utf-8") as file:
            told = json.load(file)
        self.by_pieces = (
            all(told.get(k) == v for k, v in RULES.items())
            and told.get("post_processor") is None
            and told["model"].get("type") == "BPE"
            and all(t["content"].startswith("<|") and not t["normalized"] for t in told["added_tokens"])
            and not any(t["lstrip"] or t["rstrip"] for t in told["added_tokens"])
        )
        self.table = Table(remembered) if self.by_pieces else None

    def rows(self, data: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all rows, one after the other, and their number per row.

        Row i is ``data[edges[i]:edges[i + 1]]``; edges start at 0.
        """
        if not self.by_pieces:
            raw = data.tobytes()
            texts = [raw[a:b].decode() for a, b in zip(edges[:-1].tolist(), edges[1:].tolist())]
            found = [self.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
            return np.array([i for ids in found for i in ids], np.int32), np.array([len(x) for x in found], np.int64)
        parts, before = [], np.zeros(len(edges), np.int64)
        at, done = 0, 0
        while at < len(data):
            to = self._border(data, edges, at)
            first, last = np.searchsorted(edges, [at, to], "right")
            own = edges[first:last] - at  # edges beyond the first byte, up to the last
            ids, told = self._chunk(data[at:to], own)
            before[first:last] = done + told
            parts.append(ids)
            done += len(ids)
            at = to
        return np.concatenate([np.zeros(0, np.int32), *parts]), np.diff(before)

    def __call__(self, text: bytes) -> bytes:
        ids, _ = self.rows(np.frombuffer(text, np.uint8), np.array([0, len(text)]))
        return ids.astype("<i4").tobytes()

    @staticmethod
    def _border(data: np.ndarray, edges: np.ndarray, at: int) -> int:
        """The first end of a row or blank at least a chunk further on."""
        to = at + CHUNK
        if to >= len(data):
            return len(data)
        row_end = int(edges[np.searchsorted(edges, to)])
        while to < row_end:
            blank = np.flatnonzero(_classes()[data[to : min(to + 4096, row_end)]] == _SPACE)
            if len(blank):
                return to + int(blank[0])
            to += 4096
        return row_end

    def _chunk(self, data: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of a chunk, and how many lie before each of the edges."""
        n = len(data)
        kind = _classes()[data]
        low = np.zeros(n + 8, np.uint8)
        low[:n] = lowered()[data]
        lead = np.flatnonzero(data[:-1] == 0xC3) if n else np.zeros(0, np.int64)
        if len(lead):
            second = data[lead + 1]
            latin = lead[(second != 0x97) & (second != 0xB7)] + 1
            kind[latin] = _LETTER
            low[latin[data[latin] < 0x9F]] += 0x20
        blank_before = np.empty(n, bool)
        blank_before[:1] = True
        np.equal(kind[:-1], _SPACE, out=blank_before[1:])
        blank_before[edges[edges < n]] = True
        inside = kind != _SPACE
        opens = np.empty(n, bool)
        opens[:1] = True
        np.not_equal(kind[1:], kind[:-1], out=opens[1:])
        opens |= blank_before
        opens |= kind == _DIGIT
        opens &= inside
        begin = np.flatnonzero(opens)
        closes = inside.copy()
        closes[:-1] &= opens[1:] | ~inside[1:]
        closes[edges[edges > 0] - 1] |= inside[edges[edges > 0] - 1]
        end = np.flatnonzero(closes) + 1

        strange = np.flatnonzero(kind == _ODD)
        marks = np.flatnonzero((data[:-1] == 60) & (data[1:] == 124)) if n else strange
        whole = np.zeros(len(begin), bool)
        if len(strange) or len(marks):
            word_begin = np.flatnonzero(inside & blank_before)
            last = inside.copy()
            last[:-1] &= blank_before[1:]
            last[:-1] |= inside[:-1] & ~inside[1:]
            word_end = np.flatnonzero(last) + 1
            odd = np.unique(np.searchsorted(word_begin, np.concatenate([strange, marks]), "right") - 1)
            odd_begin, odd_end = word_begin[odd], word_end[odd]
            k = np.searchsorted(odd_begin, begin, "right") - 1
            stay = (k < 0) | (begin >= odd_end[k])
            order = np.argsort(np.concatenate([begin[stay], odd_begin]), kind="stable")
            begin = np.concatenate([begin[stay], odd_begin])[order]
            end = np.concatenate([end[stay], odd_end])[order]
            whole = np.concatenate([np.zeros(int(stay.sum()), bool), np.ones(len(odd), bool)])[order]
        ids, ends = self.table.gather(self._entries(data, low, begin, end, whole))
        return ids, ends[np.searchsorted(begin, edges)]

    def _entries(self, data, low, begin, end, whole, room: int = 0) -> np.ndarray:
        """The table's entry of each piece; new ones are asked from the library and added.

        Where they do not fit the table starts afresh, and if one chunk alone has more
        pieces than are remembered, with ``room`` for all of them.
        """
        table = self.table
        short = ~whole & (end - begin <= 16)
        b, e = begin[short], end[short]
        head, tail, n = short_keys(low, b, e)
        entry = np.zeros(len(begin), np.int32)
        found = table.find(head, tail, n)
        miss = np.flatnonzero(found == 0)
        order = miss[np.lexsort((n[miss], tail[miss], head[miss]))]
        new = np.ones(len(order), bool)
        for x in (n, tail, head):
            x = x[order]
            new[1:] &= x[1:] == x[:-1]
        new[1:] = ~new[1:]
        fresh = order[new]

        rest = np.flatnonzero(~short)
        odd = whole[rest].tolist()
        spelled = [(data if w else low)[x:y].tobytes() for x, y, w in zip(begin[rest].tolist(), end[rest].tolist(), odd)]
        unknown = {s: w for s, w in zip(spelled, odd) if s not in table.loose}

        if not table.fits(len(fresh) + len(unknown)):
            if room:
                table.grow(room)
            else:
                table.clear()
            return self._entries(data, low, begin, end, whole, len(begin) + 1)
        if len(fresh):
            raw = low.tobytes()
            made = table.add(*self._pieces([raw[x:y] for x, y in zip(b[fresh].tolist(), e[fresh].tolist())]))
            table.place(made, head[fresh], tail[fresh], n[fresh])
            found[order] = made[np.cumsum(new) - 1]
        entry[short] = found
        if len(rest):
            known = table.loose
            passing = {}
            for kind, ask in ((False, self._pieces), (True, self._words)):
                chosen = [s for s, w in unknown.items() if w == kind]
                if chosen:
                    for s, k in zip(chosen, table.add(*ask(chosen)).tolist()):
                        (known if len(s) <= LONGEST else passing)[s] = k
            entry[rest] = [known[s] if s in known else passing[s] for s in spelled]
        return entry

    def _words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        found = [self.tokenizer.encode(w.decode(), add_special_tokens=False).ids for w in words]
        return np.array([i for ids in found for i in ids], np.int32), np.array([len(x) for x in found], np.int32)

    def _pieces(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Blanks keep pieces apart, so a call encodes many; the library tells which piece an id is of."""
        parts = []
        for at in range(0, len(pieces), ASKED):
            some = pieces[at : at + ASKED]
            told = self.tokenizer.encode(b" ".join(some).decode(), add_special_tokens=False)
            counts = np.bincount(np.array(told.word_ids, np.int64), minlength=len(some))
            parts.append((np.array(told.ids, np.int32), counts) if len(counts) == len(some) else self._words(some))
        ids, counts = (np.concatenate(x) for x in zip(*parts))
        return ids, counts.astype(np.int32)

    def closed(self, data: np.ndarray, edges: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
        """As :meth:`rows`, with the id ``end`` after each row."""
        ids, counts = self.rows(data, edges)
        out = np.full(len(ids) + len(counts), end, np.int32)
        at = np.repeat(np.arange(len(counts)), counts)
        at += np.arange(len(ids))
        out[at] = ids
        return out, counts + 1


@cache
def encoder(vocabulary: str) -> Encoder:
    """One encoder for a worker process; it outlives the task."""
    return Encoder(vocabulary)


def id_lists(ids: np.ndarray, counts: np.ndarray) -> pa.ListArray:
    """Lists of ``counts`` ids each."""
    edges = np.zeros(len(counts) + 1, np.int32)
    np.cumsum(counts, out=edges[1:])
    return pa.ListArray.from_arrays(edges, pa.array(np.ascontiguousarray(ids, np.int32), pa.int32()))


@cache
def sentence_ends(vocabulary: str) -> np.ndarray:
    """Which ids close a sentence: tokens that end a word with a full stop or the like."""
    with open(vocabulary, encoding="utf-8") as file:
        known = json.load(file)["model"]["vocab"]
    out = np.zeros(max(1 << 17, max(known.values(), default=0) + 1), bool)
    for token, number in known.items():
        out[number] = token.removesuffix("</w>")[-1:] in (".", "!", "?")
    return out
