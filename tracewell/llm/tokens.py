"""Byte-level BPE ids through the ``tokenizers`` library, with a bounded memo of text chunks.

The library encodes a text piece by piece: its pre-tokenizer never lets a piece
run across a single space that stands between two non-space characters.  So a
text may be cut in front of each such space, every distinct chunk encoded once
and the ids joined; the result is that of encoding the whole text.  Texts in
which a space touches other white space, and texts that name a special token,
go to the library whole.  A batch of texts is cut, its chunks are numbered and
their ids are gathered by array operations; only distinct chunks are looked up.
Chunks not seen before go through the library's own vocabulary and merges, many
at once, as a call of the library for each costs several times as much; the tests
hold the ids against the library's.
"""

from __future__ import annotations

import json
import os
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex

#: Fixed value: how a byte-level pre-tokenizer splits a text into pieces.
PIECE = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
#: Chunks remembered by a worker; beyond it those unused for longest are forgotten (speed only).
MEMO_CHUNKS = 300_000
DEFAULT_VOCABULARY = "byte_bpe_50k.json"


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(DEFAULT_VOCABULARY)


def _cuttable(chunk: str) -> bool:
    """Whether spaces on both sides of a chunk are single."""
    return bool(chunk) and not chunk[0].isspace() and not chunk[-1].isspace()


def _byte_alphabet() -> str:
    """The printable character that a byte-level vocabulary uses for each byte."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = iter(range(256, 512))
    return "".join(chr(b if b in plain else next(other)) for b in range(256))


class Merges:
    """The merges of a byte-level vocabulary, applied to many pieces at once."""

    #: A rank above all others, and pieces merged at a time.
    NONE, SLICE = np.int32(1 << 30), 8192

    def __init__(self, library):
        model = json.loads(library.to_str())["model"]
        vocabulary = model["vocab"]
        self._n = max(vocabulary.values()) + 1
        self._byte = np.array([vocabulary[c] for c in _byte_alphabet()], dtype=np.int32)
        pairs = [tuple(m) if not isinstance(m, str) else tuple(m.split(" ")) for m in model["merges"]]
        keys = np.array([vocabulary[x] * self._n + vocabulary[y] for x, y in pairs], dtype=np.int64)
        order = np.argsort(keys)
        self._order, self._keys = order.astype(np.int32), keys[order]
        self._merged = np.array([vocabulary[x + y] for x, y in pairs], dtype=np.int32)
        self._bytes = self._ranks(np.repeat(self._byte, 256), np.tile(self._byte, 256))

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left.astype(np.int64) * self._n + right
        at = np.minimum(np.searchsorted(self._keys, key), len(self._keys) - 1)
        return np.where(self._keys[at] == key, self._order[at], self.NONE)

    def apply(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all pieces, one after another; how many each has)."""
        parts = [self._apply(pieces[i : i + self.SLICE]) for i in range(0, len(pieces), self.SLICE)]
        return (np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])) if parts else (np.empty(0, "<u4"), np.empty(0, np.int64))

    def _apply(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """In every round each piece merges its pair of least rank wherever it stands, from the left; a merge only makes pairs of higher rank."""
        raw = [p.encode() for p in pieces]
        data, sizes = np.frombuffer(b"".join(raw), np.uint8).astype(np.int64), np.fromiter(map(len, raw), np.int64, len(raw))
        of, symbols = np.repeat(np.arange(len(pieces), dtype=np.int32), sizes), self._byte[data]
        rank = np.full(len(data), self.NONE)  # of each symbol with the next
        rank[:-1] = np.where(of[:-1] == of[1:], self._bytes[data[:-1] * 256 + data[1:]], self.NONE)
        ended_of, ended = [], []
        while len(symbols):
            least = np.minimum.reduceat(rank, np.cumsum(sizes) - sizes)
            live = least < self.NONE
            least = np.repeat(least, sizes)
            hit = np.flatnonzero((rank == least) & (rank < self.NONE))
            if (np.diff(hit) == 1).any():  # a run of one symbol: every second pair
                first = np.append(True, np.diff(hit) != 1)
                hit = hit[(hit - hit[np.maximum.accumulate(np.where(first, np.arange(len(hit)), 0))]) % 2 == 0]
            symbols[hit] = self._merged[rank[hit]]
            keep = np.ones(len(symbols), bool)
            if not live.all():
                done = least == self.NONE
                ended_of.append(of[done])
                ended.append(symbols[done])
                keep[done] = False
            keep[hit + 1] = False
            to = np.cumsum(keep)[hit] - 1  # where the merged symbols stand now
            sizes = (sizes - np.bincount(np.cumsum(np.append(0, of[1:] != of[:-1]))[hit], minlength=len(sizes)))[live]
            of, symbols, rank = of[keep], symbols[keep], rank[keep]
            for at in (to, to[to > 0] - 1):
                after = np.minimum(at + 1, len(of) - 1)
                rank[at] = np.where((of[at] == of[after]) & (at < after), self._ranks(symbols[at], symbols[after]), self.NONE)
        of, ids = np.concatenate(ended_of), np.concatenate(ended)
        return ids[np.argsort(of, kind="stable")].astype("<u4"), np.bincount(of, minlength=len(pieces))


class ByteBpe:
    """Encodes texts to the ids that the library gives, special tokens not added."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self._library = Tokenizer.from_file(path)
        self._merges = Merges(self._library)
        self._special = [t.content for t in self._library.get_added_tokens_decoder().values()]
        # Ids of distinct chunks, each in front of which a space stood, as one growing array; entry 0 stands for what can't be cut.
        self._place: dict[str, int] = {}
        self._ids, self._starts, self._sizes, self._used = np.empty(0, "<u4"), np.zeros(1, np.int64), np.zeros(1, np.int64), np.zeros(1, np.int64)
        self._turn = 0

    def _fresh(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of chunks after their spaces, one after another; how many each has)."""
        pieces, per, odd = [], [], {}
        for i, chunk in enumerate(chunks):
            if chunk.isascii() or max(chunk) <= "\u00ff":
                if chunk.isalpha():
                    pieces.append(" " + chunk)
                    per.append(1)
                else:
                    own = PIECE.findall(" " + chunk)
                    pieces += own
                    per.append(len(own))
            else:  # leave other alphabets' classes to the library
                odd[i] = self._listed(" " + chunk)
                per.append(0)
        ids, sizes = self._merges.apply(pieces)
        counts = np.bincount(np.repeat(np.arange(len(chunks)), per), sizes, len(chunks)).astype(np.int64)
        if odd:
            places = np.repeat((np.cumsum(counts))[list(odd)], [len(x) for x in odd.values()])
            ids = np.insert(ids, places, np.fromiter(chain.from_iterable(odd.values()), "<u4", len(places)))
            counts[list(odd)] = [len(x) for x in odd.values()]
        return ids, counts

    def _forget(self) -> None:
        """Keeps the half of the chunks that was used last."""
        keep = self._used > np.median(self._used)
        keep[0] = True
        starts, sizes = self._starts[keep], self._sizes[keep]
        total = np.cumsum(sizes)
        self._ids = self._ids[np.repeat(starts - (total - sizes), sizes) + np.arange(total[-1])]
        to = (np.cumsum(keep) - 1).tolist()
        kept = keep.tolist()
        self._place = {c: to[i] for c, i in self._place.items() if kept[i]}
        self._starts, self._sizes, self._used = total - sizes, sizes, self._used[keep]

    def _places(self, chunks: list[str]) -> np.ndarray:
        """The entry of each chunk; entries hold until the next call."""
        if len(self._place) > MEMO_CHUNKS:
            self._forget()
        self._turn += 1
        out = np.fromiter(map(self._place.get, chunks, repeat(-1)), np.int64, len(chunks))
        if len(new := np.flatnonzero(out < 0)):
            cut = np.fromiter((_cuttable(chunks[i]) for i in new.tolist()), bool, len(new))
            out[new[~cut]], new = 0, new[cut]
            own = [chunks[i] for i in new.tolist()]
            out[new] = len(self._sizes) + np.arange(len(new))
            self._place.update(zip(own, out[new].tolist(), strict=True))
            ids, sizes = self._fresh(own)
            self._starts = np.concatenate([self._starts, len(self._ids) + np.cumsum(sizes) - sizes])
            self._sizes = np.concatenate([self._sizes, sizes])
            self._ids = np.concatenate([self._ids, ids])
            self._used = np.concatenate([self._used, np.zeros(len(own), np.int64)])
        self._used[out] = self._turn
        return out

    def _listed(self, text: str) -> list[int]:
        return self._library.encode(text, add_special_tokens=False).ids

    def whole(self, text: str) -> bytes:
        """The library's own answer for the whole text."""
        return np.array(self._listed(text), dtype="<u4").tobytes()

    def encode(self, text: str | None) -> bytes:
        """Null and empty texts have no ids."""
        return self.encode_all(pa.array([text], pa.string()))[0].astype("<u4").tobytes()

    def encode_all(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, one after another; how many each text has)."""
        texts = texts.fill_null("")
        lists = pc.split_pattern(texts, " ")
        offsets = np.asarray(lists.offsets)[lists.offset : lists.offset + len(lists) + 1].astype(np.int64)
        flat = lists.values.slice(offsets[0], offsets[-1] - offsets[0])
        offsets = offsets - offsets[0]
        heads, per = offsets[:-1], np.diff(offsets)
        numbered = flat.dictionary_encode()
        codes, words = numbered.indices.to_numpy().astype(np.int64), numbered.dictionary.to_numpy(zero_copy_only=False).tolist()
        place = self._places(words)[codes]
        unread = place == 0
        unread[heads] = False
        whole = np.zeros(len(texts), bool)
        if unread.any():
            whole[np.repeat(np.arange(len(texts)), per)[unread]] = True
        for special in self._special:
            whole |= pc.match_substring(texts, special).to_numpy(zero_copy_only=False)
        found = []  # ids of the first chunk of each text, or of a text that goes to the library whole
        for i, chunk in enumerate(flat.take(pa.array(heads)).to_pylist()):
            whole[i] |= not _cuttable(chunk)
            found.append(self._listed(texts[i].as_py() if whole[i] else chunk))
        starts, lengths = self._starts[place], self._sizes[place]
        if whole.any():
            lengths[np.repeat(whole, per)] = 0
        sizes = np.array([len(x) for x in found], dtype=np.int64)
        starts[heads], lengths[heads] = len(self._ids) + np.cumsum(sizes) - sizes, sizes
        ids = np.concatenate([self._ids, np.fromiter(chain.from_iterable(found), "<u4", sizes.sum())])
        total = np.cumsum(lengths)
        at = np.repeat(starts - (total - lengths), lengths)
        at += np.arange(len(at))
        return ids[at], np.add.reduceat(lengths, heads) if len(heads) else np.empty(0, np.int64)

    def encode_ended(self, texts: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """The same with ``end_id`` after each text."""
        ids, counts = self.encode_all(texts)
        return np.insert(ids, np.cumsum(counts), end_id), counts + 1


_ENCODERS: dict[str, ByteBpe] = {}


def encoder(path: str) -> ByteBpe:
    """One encoder for each vocabulary and worker."""
    if path not in _ENCODERS:
        _ENCODERS[path] = ByteBpe(path)
    return _ENCODERS[path]
