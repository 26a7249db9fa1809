"""Encoding with a public byte-level BPE tokenizer at the speed of a lookup.

Byte-level pre-tokenisation cuts a text into pieces that are encoded one by one, and some of its cuts can be
seen without running it: before a space that has no white space beside it, since a space goes to the word after
it; behind a letter that no letter follows; around a single line break. The ids of a text are the ids of such
pieces, one after another. Words repeat, so each worker keeps what it has encoded, in two levels: the parts
between spaces, and the words and signs they are made of; only new words reach the tokenizer. Without spans, one level
will do: all cuts are made at once by classes of bytes, and words of up to 15 bytes are looked up all at once, by their
bytes and length as two integers in an array; equal integers are equal words.

Each level keeps two generations of about ``KEPT`` entries (some 200 bytes each; ``KEPT_PIECES`` of half as many bytes
where one level does): a full one becomes the old
one, and what is used again moves on. Memory is bounded, and ids do not depend on it. When a task ends, each
level's old generation goes, and all of it when no other task has come for ``IDLE_SECONDS``: idle workers live on beside
the tasks of later stages, which need the memory.

Tokenizers that are not byte-level BPE without a normaliser cut texts in other places: they encode whole texts.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator
from contextlib import contextmanager
from functools import lru_cache
from itertools import chain, repeat
from threading import Lock, Timer

import numpy as np

KEPT = 600_000
KEPT_PIECES = 1_000_000
# Places for short pieces: well over KEPT_PIECES and RUN together.
SLOT_BITS = 21
# Pieces that are looked up at once.
RUN = 1 << 18
SHORT_BYTES = 15
# Tasks of one stage follow one another faster.
IDLE_SECONDS = 2.0

_SIDE_BY_SIDE = re.compile(r"\s\s")
_SAFE_SPACE = re.compile(r"(?<=\S) (?=\S)")
_LETTER, _SEEN = "A-Za-zÀ-ÖØ-öø-ÿ", "!-~À-ÖØ-öø-ÿ"
_FINE = re.compile(
    rf"(?<=[{_LETTER}])(?=[\n -@\[-`{{-~])|(?<=[{_SEEN}])(?=\n)|(?<=[{_SEEN}]\n)(?=[{_SEEN}])"
)


_IS_LETTER, _MAY_FOLLOW, _IS_SEEN, _IS_LINE, _IS_SPACE, _ENDS, _BEGINS = (1 << i for i in range(7))


def _byte_classes() -> np.ndarray:
    """Bits by byte, for the cuts of ``_FINE`` between ASCII signs and for those of ``_SAFE_SPACE``.

    No white space ends or begins with a byte of the last two classes in UTF-8. Where that says too little about other signs,
    a cut is left undone, which changes no id.
    """
    classes = np.full(256, _ENDS | _BEGINS, np.uint8)
    for byte in range(0x21, 0x7F):
        classes[byte] |= _IS_SEEN | (_IS_LETTER if chr(byte).isalpha() else _MAY_FOLLOW)
    classes[0x20] |= _IS_SPACE | _MAY_FOLLOW
    classes[0x0A] |= _IS_LINE | _MAY_FOLLOW
    for char in (chr(code) for code in range(0x3001) if chr(code).isspace()):
        classes[char.encode()[-1]] &= 0xFF ^ _ENDS
        classes[char.encode()[0]] &= 0xFF ^ _BEGINS
    return classes


_CLASSES = _byte_classes()


def _cut_places(data: np.ndarray) -> np.ndarray:
    """Places in a text, from 1 on, before which it may be cut."""
    classes = np.concatenate([np.zeros(1, np.uint8), _CLASSES[data], np.zeros(1, np.uint8)])
    older, before, here, after = classes[:-3], classes[1:-2], classes[2:-1], classes[3:]
    cut = (before & _IS_LETTER != 0) & (here & _MAY_FOLLOW != 0)
    cut |= (before & _IS_SEEN != 0) & (here & _IS_LINE != 0)
    cut |= (older & _IS_SEEN != 0) & (before & _IS_LINE != 0) & (here & _IS_SEEN != 0)
    cut |= (before & _ENDS != 0) & (here & _IS_SPACE != 0) & (after & _BEGINS != 0)
    return np.flatnonzero(cut) + 1


class _Ids:
    """Ids, and spans if asked for, by place."""

    def __init__(self, offsets: bool):
        self.size = 0
        self.starts, self.lengths, self.chars = (np.zeros(4096, np.int64) for _ in range(3))
        self.ids = np.zeros(16384, np.uint32)
        self.spans = np.zeros((16384, 2), np.int32) if offsets else None

    def append(self, count: int, ids, lengths, chars, spans) -> None:
        stop, end = count + len(lengths), self.size + len(ids)
        for name in ("starts", "lengths", "chars"):
            setattr(self, name, _room(getattr(self, name), stop))
        self.ids = _room(self.ids, end)
        self.starts[count:stop] = self.size + np.cumsum(lengths) - lengths
        self.lengths[count:stop] = lengths
        self.chars[count:stop] = chars
        self.ids[self.size : end] = ids
        if self.spans is not None:
            self.spans = _room(self.spans, end)
            self.spans[self.size : end] = spans
        self.size = end

    def joined(self, places: np.ndarray, cuts: np.ndarray):
        """Groups places[cuts[i]:cuts[i + 1]] as one text each: ids, ids and characters per group, spans."""
        lengths, chars = self.lengths[places], self.chars[places]
        before = np.append(0, np.cumsum(lengths))
        at = np.repeat(self.starts[places] - before[:-1], lengths) + np.arange(before[-1])
        char_before = np.append(0, np.cumsum(chars))
        spans = None
        if self.spans is not None:
            piece_start = char_before[:-1] - np.repeat(char_before[cuts[:-1]], np.diff(cuts))
            spans = self.spans[at] + np.repeat(piece_start, lengths)[:, None]
        return self.ids[at], np.diff(before[cuts]), np.diff(char_before[cuts]), spans


class _Kept(_Ids):
    """Ids by piece."""

    def __init__(self, offsets: bool):
        super().__init__(offsets)
        self.place: dict[str, int] = {}

    def add(self, keys: list[str], ids, lengths, chars, spans) -> None:
        count = len(self.place)
        self.append(count, ids, lengths, chars, spans)
        self.place.update(zip(keys, range(count, count + len(keys))))


_MASKS = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)
_SPREAD = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(29), np.uint64(64 - SLOT_BITS)


def _short_keys(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first 8 bytes of spans of at most ``SHORT_BYTES``, and the rest with the size on top; the data ends with 16 more bytes."""
    eights = np.ndarray(len(data) - 7, "<u8", data, strides=(1,))
    low = eights[starts] & _MASKS[np.minimum(sizes, 8)]
    high = eights[starts + 8] & _MASKS[np.maximum(sizes - 8, 0)]
    return low, high | sizes.astype(np.uint64) << np.uint64(56)


class _KeptPieces(_Ids):
    """Ids by piece, as bytes: short pieces in an open table, longer ones by name."""

    def __init__(self):
        super().__init__(False)
        self.count = 0
        self.named: dict[bytes, int] = {}
        # A key's size is never 0, so neither is its high half: that marks a free slot.
        self.low, self.high = (np.zeros(1 << SLOT_BITS, np.uint64) for _ in range(2))
        self.at = np.zeros(1 << SLOT_BITS, np.int32)

    @property
    def place(self) -> range:
        return range(self.count)

    @staticmethod
    def _slots(low: np.ndarray, high: np.ndarray) -> np.ndarray:
        one, other, shift, rest = _SPREAD
        value = (low * one + high) * other
        value ^= value >> shift
        value *= one
        return (value >> rest).astype(np.int64)

    def find(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Places of short pieces; -1 for those that are not there."""
        places = np.full(len(low), -1, np.int64)
        slots, open_ = self._slots(low, high), np.arange(len(low))
        while len(open_):
            held = self.high[slots]
            same = (held == high[open_]) & (self.low[slots] == low[open_])
            places[open_[same]] = self.at[slots[same]]
            on = np.flatnonzero(~same & (held != 0))
            slots, open_ = (slots[on] + 1) & (len(self.at) - 1), open_[on]
        return places

    def find_named(self, names: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.named.get, names, repeat(-1)), np.int64, len(names))

    def add_pieces(self, short, low, high, names: list[bytes], ids, lengths, chars) -> None:
        """New pieces, each once: ``short`` tells which go by ``low`` and ``high``; the others by their names."""
        base = self.count
        self.append(base, ids, lengths, chars, None)
        self.count += len(names)
        for i in np.flatnonzero(~short).tolist():
            self.named[names[i]] = base + i
        open_ = np.flatnonzero(short)
        slots = self._slots(low[open_], high[open_])
        while len(open_):
            free = self.high[slots] == 0
            self.at[slots[free]] = base + open_[free]
            # Of those that meet in a free slot, one stays.
            stays = free & (self.at[slots] == base + open_)
            self.low[slots[stays]], self.high[slots[stays]] = low[open_[stays]], high[open_[stays]]
            slots, open_ = (slots[~stays] + 1) & (len(self.at) - 1), open_[~stays]


def _room(array: np.ndarray, size: int) -> np.ndarray:
    if size <= len(array):
        return array
    grown = np.zeros((max(size, 2 * len(array)), *array.shape[1:]), array.dtype)
    grown[: len(array)] = array
    return grown


def cuts_are_safe(tokenizer) -> bool:
    """Whether the ids of a text are those of its pieces: byte-level BPE that adds, drops and merges nothing between them."""
    parts = json.loads(tokenizer.to_str())
    cut, model = parts.get("pre_tokenizer") or {}, parts["model"]
    return (
        parts.get("normalizer") is None
        and cut.get("type") == "ByteLevel"
        and cut.get("use_regex", True)
        and not cut.get("add_prefix_space")
        and model.get("type") == "BPE"
        and not model.get("dropout")
        and not model.get("continuing_subword_prefix")
        and not model.get("end_of_word_suffix")
        and not any(token["normalized"] or token["lstrip"] or token["rstrip"] for token in parts.get("added_tokens", ()))
        and not any(" " in token["content"] for token in parts.get("added_tokens", ()))
    )


class PieceEncoder:
    """Encodes batches of texts; ``offsets=True`` also gives each token's span of characters."""

    def __init__(self, path: str, offsets: bool = False):
        # Spark runs a worker per core already.
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(path)
        self._offsets = offsets
        self._special = [token.content for token in self._tokenizer.get_added_tokens_decoder().values()]
        self._piecewise = cuts_are_safe(self._tokenizer)
        self._plain = False
        self._levels = [[self._empty(), self._empty()] for _ in range(2 if offsets else 1)]

    def _empty(self) -> _Kept | _KeptPieces:
        return _Kept(True) if self._offsets else _KeptPieces()

    def release(self, everything: bool = True) -> None:
        """Forget what was encoded, or just the old generations."""
        self._levels = [[self._empty() if everything else young, self._empty()] for young, _ in self._levels]

    def _places(self, level: int, keys: list[str]) -> tuple[_Kept, np.ndarray]:
        """The level's young generation, holding all the keys, and their places."""
        young, old = self._levels[level]
        if len(young.place) > KEPT:
            young, old = self._levels[level] = [_Kept(self._offsets), young]
        places = np.fromiter(map(young.place.get, keys, repeat(-1)), np.int64, len(keys))
        missing = np.flatnonzero(places < 0).tolist()
        if missing:
            wanted = list(dict.fromkeys([keys[i] for i in missing]))
            there = np.fromiter(map(old.place.get, wanted, repeat(-1)), np.int64, len(wanted))
            again = np.flatnonzero(there >= 0)
            if len(again):
                found = there[again]
                young.add([wanted[i] for i in again.tolist()], *self._flat(old, found))
            new = [wanted[i] for i in np.flatnonzero(there < 0).tolist()]
            if new:
                young.add(new, *(self._from_words(new) if level == 0 else self._from_tokenizer(new)))
            place = young.place
            places[missing] = [place[keys[i]] for i in missing]
        return young, places

    def _words(self, part: str) -> list[str]:
        """Cut further, but never through a string that the tokenizer knows as a whole."""
        if not self._plain and any(name in part for name in self._special):
            return [part]
        return _FINE.split(part)

    @staticmethod
    def _flat(kept: _Kept, places: np.ndarray):
        return kept.joined(places, np.arange(len(places) + 1))

    def _from_words(self, parts: list[str]):
        """Parts without the space before them, from the level below."""
        words: list[str] = []
        cuts = [0]
        for part in parts:
            words += self._words(" " + part)
            cuts.append(len(words))
        kept, places = self._places(1, words)
        return kept.joined(places, np.array(cuts))

    def _from_tokenizer(self, words: list[str]):
        # Without spans, the faster call that does not track them will do.
        encode = self._tokenizer.encode_batch if self._offsets else self._tokenizer.encode_batch_fast
        encoded = encode(words, add_special_tokens=False)
        ids = [encoding.ids for encoding in encoded]
        lengths = np.fromiter(map(len, ids), np.int64, len(ids))
        flat = np.fromiter(chain.from_iterable(ids), np.uint32, int(lengths.sum()))
        chars = np.fromiter(map(len, words), np.int64, len(words))
        spans = None
        if self._offsets:
            spans = np.array([span for one in encoded for span in one.offsets], np.int32).reshape(-1, 2)
        return flat, lengths, chars, spans

    def _piece_ids(self, raw: bytes, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the pieces raw[starts[i]:ends[i]], and how many each has."""
        young, old = self._levels[0]
        if young.count > KEPT_PIECES:
            young, old = self._levels[0] = [_KeptPieces(), young]

        def placed(kept: _KeptPieces, short: np.ndarray, low: np.ndarray, high: np.ndarray, names: list[bytes]) -> np.ndarray:
            places = np.empty(len(short), np.int64)
            places[short] = kept.find(low[short], high[short])
            places[~short] = kept.find_named(names)
            return places

        sizes = ends - starts
        short = sizes <= SHORT_BYTES
        low, high = _short_keys(data, starts, np.minimum(sizes, SHORT_BYTES))
        long_names = [raw[a:b] for a, b in zip(starts[~short].tolist(), ends[~short].tolist())]
        places = placed(young, short, low, high, long_names)
        missing = np.flatnonzero(places < 0)
        if len(missing):
            first = {raw[a:b]: i for i, a, b in zip(missing.tolist(), starts[missing].tolist(), ends[missing].tolist())}
            wanted, names = np.fromiter(first.values(), np.int64, len(first)), list(first)
            there = placed(old, short[wanted], low[wanted], high[wanted], [names[i] for i in np.flatnonzero(~short[wanted]).tolist()])
            for known in (True, False):
                some = np.flatnonzero((there >= 0) == known)
                if len(some):
                    chosen, at = [names[i] for i in some.tolist()], wanted[some]
                    if known:
                        ids, lengths, chars, _ = self._flat(old, there[some])
                    else:
                        ids, lengths, chars, _ = self._from_tokenizer([name.decode() for name in chosen])
                    young.add_pieces(short[at], low[at], high[at], chosen, ids, lengths, chars)
            places = placed(young, short, low, high, long_names)
        ids, lengths, _, _ = self._flat(young, places)
        return ids, lengths

    def _encode_plain(self, texts: list[str], special: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts; those with a string that the tokenizer knows as a whole are not cut."""
        if not special.any():
            return self._encode_bytes([text.encode() for text in texts])
        whole = [text for text, one in zip(texts, special) if one]
        ids, lengths, _, _ = self._from_tokenizer(whole)
        rest_ids, rest = self._encode_bytes([text.encode() for text, one in zip(texts, special) if not one])
        counts = np.zeros(len(texts), np.int64)
        counts[special], counts[~special] = lengths, rest
        out = np.empty(len(ids) + len(rest_ids), np.uint32)
        of_whole = np.repeat(special, counts)
        out[of_whole], out[~of_whole] = ids, rest_ids
        return out, counts

    def _encode_bytes(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and the number of ids of each text; no text has a string that the tokenizer knows as a whole."""
        bounds = np.cumsum([0, *map(len, texts)])
        raw = b"".join([*texts, bytes(16)])
        data = np.frombuffer(raw, np.uint8)
        cuts = _cut_places(data[: bounds[-1]])
        # What may be cut is not decided by signs of the next text.
        firsts = bounds[:-1][np.diff(bounds) > 0]
        edges = np.concatenate([firsts, firsts - 1, firsts + 1])
        at = np.searchsorted(cuts, edges)
        inside = at < len(cuts)
        cuts = np.delete(cuts, at[inside][cuts[at[inside]] == edges[inside]])
        starts = np.insert(cuts, np.searchsorted(cuts, firsts), firsts)
        ends = np.append(starts[1:], bounds[-1])
        found = [
            self._piece_ids(raw, data, starts[i : i + RUN], ends[i : i + RUN]) for i in range(0, len(starts), RUN)
        ]
        lengths = np.concatenate([np.zeros(0, np.int64), *[n for _, n in found]])
        before = np.append(0, np.cumsum(lengths))
        counts = np.diff(before[np.searchsorted(starts, bounds)])
        return np.concatenate([np.zeros(0, np.uint32), *[ids for ids, _ in found]]), counts

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray | None]:
        """All ids in one array, the number of ids of each text, and the spans of the ids if kept."""
        if not self._piecewise:
            ids, counts, _, spans = self._from_tokenizer(texts)
            return ids, counts, spans
        special = np.array([any(name in text for name in self._special) for text in texts], bool)
        if not self._offsets:
            return *self._encode_plain(texts, special), None
        self._plain = not special.any()
        heads: list[str] = []
        rest: list[str] = []
        cuts = [0]
        for text in texts:
            parts = _SAFE_SPACE.split(text) if _SIDE_BY_SIDE.search(text) else text.split(" ")
            heads.append(parts[0])
            rest += parts[1:]
            cuts.append(len(rest))
        fine = [self._words(head) for head in heads]
        words, word_places = self._places(1, [word for split in fine for word in split])
        head = words.joined(word_places, np.cumsum([0, *map(len, fine)]))
        kept, places = self._places(0, rest)
        tail = kept.joined(places, np.array(cuts))
        # Each text is its head followed by its tail.
        counts = head[1] + tail[1]
        order = np.argsort(
            np.concatenate([np.repeat(2 * np.arange(len(texts)), head[1]), np.repeat(2 * np.arange(len(texts)) + 1, tail[1])]),
            kind="stable",
        )
        spans = None
        if self._offsets:
            spans = np.concatenate([head[3], tail[3] + np.repeat(head[2], tail[1])[:, None]])[order]
        return np.concatenate([head[0], tail[0]])[order], counts, spans


@lru_cache(maxsize=2)
def _loaded(path: str, offsets: bool) -> PieceEncoder:
    """The worker's encoder; a worker serves many tasks, which all use the vocabulary it has read."""
    return PieceEncoder(path, offsets)


_turn = Lock()
_turns: dict[PieceEncoder, int] = {}


def _release_if_idle(loaded: PieceEncoder, turn: int) -> None:
    with _turn:
        if _turns[loaded] == turn:
            loaded.release()


@contextmanager
def encoder(path: str, offsets: bool = False) -> Iterator[PieceEncoder]:
    """The worker's encoder for the length of a task."""
    with _turn:
        loaded = _loaded(path, offsets)
        turn = _turns[loaded] = _turns.get(loaded, 0) + 1
    try:
        yield loaded
    finally:
        loaded.release(everything=False)
        later = Timer(IDLE_SECONDS, _release_if_idle, (loaded, turn))
        later.daemon = True
        later.start()


def text_groups(texts: list[str | None], limit: int = 1 << 20):
    """(first row, texts) of at most about ``limit`` characters, or one longer text. NULL is empty."""
    group: list[str] = []
    size = first = 0
    for i, text in enumerate(texts):
        text = text or ""
        if group and size + len(text) > limit:
            yield first, group
            group, size, first = [], 0, i
        group.append(text)
        size += len(text)
    if group:
        yield first, group
