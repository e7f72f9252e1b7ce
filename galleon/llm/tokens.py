"""Token ids of whole texts by the tokenizers library, through a bounded memo of text units.

A text is cut only where the tokenizer's own pre-tokenizer always cuts (between a letter and what follows it that is
no letter, and before white space), so the ids of the units, put together, are the ids of the text. Units are cut and
told apart for many texts at once, in numpy and Arrow; only the different units of such a part are looked up, and the
library encodes those that the memo doesn't hold. New units that are single words go to the library together, as one
text, and are told apart again by the tokens that end a word or begin with its space.

Texts with characters beyond Latin-1 are cut at ASCII white space only, and texts that hold a special token's string
go to the library whole. Long texts are taken in pieces of about PART bytes, cut before white space.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from galleon.llm.base import LOWER

#: Units that stay in the memo: when a part begins with more, the less used half goes.
MEMO = 250_000
#: Bytes of text that are cut into units at once.
PART = 1 << 21
#: Words that go to the library in one text.
TOGETHER = 50

GAP = np.zeros(256, bool)
GAP[[9, 10, 11, 12, 13, 32]] = True
ASCII_LETTER = np.zeros(256, bool)
ASCII_LETTER[65:91] = ASCII_LETTER[97:123] = True
#: Second bytes of the Latin-1 letters after C2 and C3, and of the capitals after C3.
AFTER_C2 = np.zeros(256, bool)
AFTER_C2[[0xAA, 0xB5, 0xBA]] = True
AFTER_C3 = np.zeros(256, bool)
AFTER_C3[0x80:0xC0] = True
AFTER_C3[[0x97, 0xB7]] = False
CAPITAL = np.zeros(256, bool)
CAPITAL[0x80:0x9F] = True
CAPITAL[0x97] = False
CUT = re.compile(rb"(?<![\t-\r ])[\t-\r ]")


def give_back() -> None:
    """Hands memory that is free inside the process back to the machine, where the C library can."""
    import ctypes

    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


class Encoder:
    """words=True: the tokenizer lower-cases and drops white space; otherwise white space and case belong to the ids.

    Ids are 16-bit numbers if all of them fit, or else 32-bit ones.
    """

    def __init__(self, path: str, words: bool) -> None:
        os.environ["TOKENIZERS_PARALLELISM"], os.environ["RAYON_NUM_THREADS"] = "false", "1"
        from tokenizers import Tokenizer, normalizers

        self.library = Tokenizer.from_file(path)
        # for words that the normalizer would leave as they are
        self.bare = Tokenizer.from_file(path) if words else self.library
        if words:
            self.bare.normalizer = normalizers.Sequence([])
        give_back()  # reading the file takes several times what the tokenizer keeps
        self.special = [t.content.encode() for t in self.library.get_added_tokens_decoder().values()]
        self.words, size = words, self.library.get_vocab_size(with_added_tokens=True)
        self.kind = np.dtype("<u2" if size <= 1 << 16 else "<u4") if words else np.dtype("<u4")
        # tokens at the edge of a word: its last one, or the one with the space before it
        self.edge = np.zeros(size + 1, bool)
        self.edge[[i for t, i in self.library.get_vocab(with_added_tokens=False).items() if (t.endswith("</w>") if words else t.startswith("Ġ"))]] = True
        self.slots: dict[bytes, int] = {}
        self.begin, self.size, self.uses = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)
        self.flat = np.zeros(0, self.kind)

    def learn(self, units: list[bytes]) -> None:
        """Takes units into the memo; words of plain letters go to the library together."""
        text = [u.decode("utf-8", "replace") for u in units]
        if self.words:
            single = [i for i, u in enumerate(text) if u.isalpha() and u.islower() and (u.isascii() or max(u) <= "ÿ")]
        else:
            single = [i for i, u in enumerate(text) if u[0] == " " and u[1:].isalpha()]
        groups = [single[lo : lo + TOGETHER] for lo in range(0, len(single), TOGETHER)]
        gap, known, flat, sizes = " " if self.words else "", [], [], []
        for group, e in zip(groups, self.bare.encode_batch_fast([gap.join([text[i] for i in g]) for g in groups], add_special_tokens=False), strict=True):
            ids = np.array(e.ids, self.kind)
            edge = np.flatnonzero(self.edge[ids])
            if len(edge) == len(group):  # or else a word falls apart for the library: one by one
                known += group
                flat.append(ids)
                sizes.append(np.diff(edge, prepend=-1) if self.words else np.diff(edge, append=len(ids)))
        rest = sorted(set(range(len(units))).difference(known))
        for i, e in zip(rest, self.library.encode_batch_fast([text[i] for i in rest], add_special_tokens=False), strict=True):
            known.append(i)
            flat.append(np.array(e.ids, self.kind))
            sizes.append([len(e.ids)])
        size, flat = np.concatenate(sizes).astype(np.int64), np.concatenate(flat)
        self.slots.update(zip([units[i] for i in known], range(len(self.size), len(self.size) + len(known)), strict=True))
        self.begin = np.concatenate((self.begin, len(self.flat) + np.cumsum(size) - size))
        self.size = np.concatenate((self.size, size))
        self.uses = np.concatenate((self.uses, np.zeros(len(known), np.int32)))
        self.flat = np.concatenate((self.flat, flat))

    def forget(self) -> None:
        """Leaves the more used half of the memo, with half of the uses counted."""
        keep = np.zeros(len(self.uses), bool)
        keep[np.argsort(-self.uses, kind="stable")[: MEMO // 2]] = True
        self.slots = {u: k for k, u in enumerate(u for u, old in self.slots.items() if keep[old])}
        self.flat = self.flat[np.repeat(keep, self.size)]
        self.size, self.uses = self.size[keep], self.uses[keep] >> 1
        self.begin = np.cumsum(self.size) - self.size
        give_back()

    def units(self, data: bytes, first: np.ndarray) -> tuple[pa.Array, np.ndarray]:
        """The units of texts that stand in data one after the other, as an Arrow array, and where each begins.

        first: the texts' starts. Units of words leave white space out.
        """
        b = np.frombuffer(data, np.uint8)
        wide = np.zeros(len(b), bool)  # bytes of texts with characters beyond Latin-1
        ends = np.append(first[1:], len(b))
        for k in np.unique(np.searchsorted(first, np.flatnonzero(b > 0xC3), side="right") - 1).tolist():
            wide[first[k] : ends[k]] = True
        letter = ASCII_LETTER[b]
        lead = np.flatnonzero((b == 0xC2) | (b == 0xC3))
        lead = lead[~wide[lead]]
        if len(lead):
            after = b[lead + 1]
            letter[lead] = letter[lead + 1] = np.where(b[lead] == 0xC3, AFTER_C3[after], AFTER_C2[after])
        if self.words:
            low = np.frombuffer(data.translate(LOWER), np.uint8).copy()
            up = lead[(b[lead] == 0xC3) & CAPITAL[b[lead + 1]]] + 1 if len(lead) else lead
            low[up] += 0x20
            b = np.where(wide, b, low)
        gap = GAP[b]
        fresh = np.empty(len(b), bool)  # after white space, or at a text's start
        fresh[0], fresh[1:] = True, gap[:-1]
        fresh[first] = True
        run = ~gap & fresh
        # what isn't a letter ends the letters at the beginning of a run of no white space
        other = np.flatnonzero(~(letter | gap | wide))
        number = np.cumsum(run, dtype=np.int32)[other]
        other = other[np.diff(number, prepend=-1) != 0]
        if self.words:
            start = run
        else:
            start = gap.copy()
            start[1:] &= ~gap[:-1]
            start[first] = True
        start[other[~run[other]]] = True
        at = np.flatnonzero(start)
        if self.words:
            place, b = np.cumsum(~gap, dtype=np.int32)[at] - 1, b[~gap]
        else:
            place = at
        offsets = np.append(place, len(b)).astype(np.int32)
        return pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(b))]), at

    def part(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all these texts in order, and how many each has."""
        size = np.fromiter(map(len, texts), np.int64, len(texts))
        count = np.zeros(len(texts), np.int64)
        full = np.flatnonzero(size)
        if not len(full):
            return np.zeros(0, self.kind), count
        if len(self.slots) > MEMO:
            self.forget()
        first = (np.cumsum(size) - size)[full]
        found, at = self.units(b"".join(texts), first)
        told = found.dictionary_encode()
        keys = told.dictionary.to_numpy(zero_copy_only=False).tolist()
        slots = list(map(self.slots.get, keys))
        if None in slots:
            self.learn([u for u, s in zip(keys, slots, strict=True) if s is None])
            slots = list(map(self.slots.get, keys))
        slots = np.array(slots, np.int64)
        self.uses[slots] += 1
        slots = slots[np.asarray(told.indices)]
        n = self.size[slots]
        to = np.cumsum(n)
        ids = self.flat[np.arange(to[-1] if len(to) else 0) + np.repeat(self.begin[slots] - (to - n), n)]
        count[full] = np.bincount(np.searchsorted(first, at, side="right") - 1, weights=n, minlength=len(full)).astype(np.int64)
        return ids, count

    def encode(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one after the other, and how many ids each text has."""
        count, out = np.zeros(len(texts), np.int64), []
        held: list[tuple[int, bytes]] = []
        room = PART

        def close() -> None:
            nonlocal held, room
            ids, n = self.part([t for _, t in held])
            np.add.at(count, [i for i, _ in held], n)
            out.append(ids)
            held, room = [], PART

        for i, text in enumerate(texts):
            if any(s in text for s in self.special):
                close()
                out.append(np.array(self.library.encode(text.decode("utf-8", "replace"), add_special_tokens=False).ids, self.kind))
                count[i] = len(out[-1])
                continue
            for piece in pieces(text):
                held.append((i, piece))
                room -= len(piece)
                if room < 0:
                    close()
        close()
        return np.concatenate(out), count


def pieces(text: bytes) -> Iterator[bytes]:
    """The text in pieces of PART bytes and as much as it takes to the next white space."""
    lo = 0
    while len(text) - lo > PART and (m := CUT.search(text, lo + PART)):
        yield text[lo : m.start()]
        lo = m.start()
    yield text[lo:] if lo else text


_made: dict[tuple, Encoder] = {}


def encoder(path: str, words: bool) -> Encoder:
    """One encoder for each Python worker: its memo outlives a task."""
    if (path, words) not in _made:
        _made[path, words] = Encoder(path, words)
    return _made[path, words]


def vocabulary(name: str) -> str:
    """The place of a public tokenizer's file; the same on every machine."""
    import public_tokenizers

    return public_tokenizers.path(name)
