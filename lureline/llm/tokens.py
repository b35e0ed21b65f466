"""Token ids of whole texts, by the tokenizers library, with a bounded memory of pieces already encoded."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import os
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Pieces kept in each of two generations, and the longest piece kept: about 60 MB in each Python worker.
KEPT, LONGEST = 130_000, 64
#: Pieces given to the library at once.
_AT_ONCE = 4000
#: A blank and letters: byte-level BPE never cuts these before its merges.
_ONE = re.compile(r" [A-Za-zÀ-ÖØ-öø-ÿ]+")
_LETTER, _SOLID = np.zeros(256, bool), np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True
_SOLID[0x21:0x7F] = True


def _signs() -> dict[int, str]:
    """Byte-level BPE's sign for each byte: printable ones of Latin-1 stand for themselves, the others follow from U+0100 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(others)}


#: For str.translate, of UTF-8 read as Latin-1.
_SIGNS = _signs()


def cuts(buf: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Where the pieces of texts begin, as byte offsets into their joined UTF-8, with the end of all.

    Byte-level BPE always begins a new pre-token at a text's start, at a single blank or line end between two signs that are not white
    space (after such a line end too), and where other signs follow a letter. So the ids of a text are those of its pieces, one after the
    other. Only ASCII signs and letters of U+00C0 to U+00FF are looked at; beside others nothing is cut.
    """
    n = len(buf)
    if not n:
        return np.zeros(1, np.int32)
    before, after = np.zeros(n, bool), np.zeros(n, bool)
    letter = _LETTER[buf]
    accented = np.zeros(n, bool)  # the second byte of a letter of U+00C0 to U+00FF
    accented[1:] = (buf[:-1] == 0xC3) & (buf[1:] != 0x97) & (buf[1:] != 0xB7)
    letter |= accented
    solid = _SOLID[buf]
    before[1:] = (solid | accented)[:-1]
    after[:-1] = (solid | (buf == 0xC3))[1:]
    blank = ((buf == 32) | (buf == 10)) & before & after
    blank[ends[ends > 0] - 1] = False  # the last sign of a text; what follows is another text's
    cut = blank.copy()
    cut[1:] |= letter[:-1] & solid[1:] & ~letter[1:]
    cut[1:] |= blank[:-1] & (buf[:-1] == 10)
    cut[0] = True
    cut[ends[ends < n]] = True
    return np.r_[np.flatnonzero(cut), n].astype(np.int32)


class Encoder:
    """flat(texts), encode(texts): the ids that the library gives for whole texts.

    For byte-level BPE, ids of pieces are remembered; other tokenizers encode whole texts. With plain_specials the strings of special
    tokens are ordinary text.
    """

    def __init__(self, path: str, plain_specials: bool = False) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs a task for each core
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = plain_specials
        self.by_pieces = "ByteLevel(add_prefix_space=False" in str(self.tokenizer.pre_tokenizer) and self.tokenizer.normalizer is None
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values() if not (plain_specials and t.special)]
        if self.by_pieces:  # for pieces that are one pre-token already, each with a blank in front
            self.single = Tokenizer(self.tokenizer.model)  # the same model, not another copy of it
            self.single.pre_tokenizer = pre_tokenizers.Split(_SIGNS[32], "merged_with_next")  # given the signs of bytes, see _pieces
            vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
            self.opens = np.zeros(max(vocabulary.values()) + 1, bool)
            self.opens[[i for t, i in vocabulary.items() if t[0] == "\u0120"]] = True  # the blank in byte-level BPE
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def _plain(self, texts: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _pieces(self, pieces: list[str]) -> dict[str, bytes]:
        """Ids of different pieces, many at once: a token that opens with a blank opens the next word, else the library says which piece it is from."""
        ones = [p for p in pieces if _ONE.fullmatch(p)]
        others = list(set(pieces).difference(ones))
        out: dict[str, bytes] = {}

        def cut_up(run: list[str], raw: bytes, edges: np.ndarray) -> None:
            edges = (4 * edges).tolist()
            out.update(zip(run, (raw[a:b] for a, b in zip(edges[:-1], edges[1:], strict=True)), strict=True))

        for i in range(0, len(ones), _AT_ONCE):
            run = ones[i : i + _AT_ONCE]
            signs = "".join(run).encode().decode("latin-1").translate(_SIGNS)
            ids = np.array(self.single.encode_batch_fast([signs], add_special_tokens=False)[0].ids, "<u4")
            cut_up(run, ids.tobytes(), np.r_[np.flatnonzero(self.opens[ids]), len(ids)])
        for i in range(0, len(others), _AT_ONCE):
            run = others[i : i + _AT_ONCE]
            found = self.tokenizer.encode_batch([run], is_pretokenized=True, add_special_tokens=False)[0]
            cut_up(run, np.array(found.ids, "<u4").tobytes(), np.searchsorted(np.array(found.word_ids, np.int64), np.arange(len(run) + 1)))
        return out

    def _known(self, pieces: list[str]) -> list[bytes]:
        """The ids of different pieces, remembered or new."""
        found = list(map(self.young.get, pieces))
        gone = [p for p, ids in zip(pieces, found, strict=True) if ids is None]
        if not gone:
            return found
        older = list(map(self.old.get, gone))
        fetched = dict(zip(gone, older, strict=True))
        fetched.update(self._pieces([p for p, ids in zip(gone, older, strict=True) if ids is None]))
        later = iter(fetched.values())  # in the order of gone
        out = [next(later) if ids is None else ids for ids in found]
        if len(self.young) + len(fetched) > KEPT:
            self.old, self.young = self.young, {}
        self.young.update(fetched if max(map(len, gone)) <= LONGEST else {p: ids for p, ids in fetched.items() if len(p) <= LONGEST})
        return out

    def flat(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one after the other (unsigned 32-bit), and where each text's ids end."""
        if not self.by_pieces or any(a in t for a in self.added for t in texts):
            own = self._plain(texts)
            return np.frombuffer(b"".join(own), "<u4"), np.cumsum(np.fromiter((len(o) // 4 for o in own), np.int64, len(own)))
        held = pa.array(texts, pa.string())
        if not len(texts) or held.buffers()[2] is None:
            return np.zeros(0, "<u4"), np.zeros(len(texts), np.int64)
        ends = np.frombuffer(held.buffers()[1], np.int32)[1 : len(texts) + 1]
        at = cuts(np.frombuffer(held.buffers()[2], np.uint8)[: ends[-1]], ends)
        named = pa.StringArray.from_buffers(len(at) - 1, pa.py_buffer(at), held.buffers()[2]).dictionary_encode()
        known = self._known(named.dictionary.to_numpy(zero_copy_only=False).tolist())  # to_pylist takes several times as long
        which = named.indices.to_numpy()
        size = np.fromiter(map(len, known), np.int64, len(known)) // 4
        start, n = np.cumsum(size) - size, size[which]
        upto = np.cumsum(n)
        ids = np.frombuffer(b"".join(known), "<u4")[np.repeat(start[which] - (upto - n), n) + np.arange(int(upto[-1]) if len(upto) else 0)]
        return ids, np.r_[0, upto][np.searchsorted(at, ends)]

    def encode(self, texts: list[str]) -> list[bytes]:
        """For each text its ids as little-endian unsigned 32-bit integers."""
        ids, ends = self.flat(texts)
        raw, ends = ids.tobytes(), (4 * ends).tolist()
        return [raw[a:b] for a, b in zip([0, *ends], ends, strict=False)]


@lru_cache(maxsize=1)
def encoder(path: str, plain_specials: bool = False) -> Encoder:
    """One encoder in each Python worker: that of the tokenizer file used last."""
    released()
    return Encoder(path, plain_specials)


def batches(rows: list, size, limit: int = 2_000_000):
    """Runs of rows of about limit characters."""
    run, held = [], 0
    for r in rows:
        run.append(r)
        held += size(r)
        if held >= limit:
            yield run
            run, held = [], 0
    if run:
        yield run


def slices(parts: Iterator[pa.RecordBatch], text: str = "text", limit: int = 1_000_000) -> Iterator[pa.RecordBatch]:
    """Record batches cut to about `limit` bytes of text (or binary), so that only that much becomes Python objects at a time.

    At the end what the worker no longer needs goes back to the system, since idle workers live on beside those of later stages.
    """
    for part in parts:
        upto = np.cumsum(pc.fill_null(pc.binary_length(part[text]), 0).to_numpy())
        at = 0
        while at < part.num_rows:
            to = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + limit, "right")))
            yield part.slice(at, to - at)
            at = to
    released()


def runs(parts: Iterator[pa.RecordBatch], text: str = "text", limit: int = 1_000_000) -> Iterator[list[tuple]]:
    """The rows of `slices` as tuples."""
    for part in slices(parts, text, limit):
        yield list(zip(*(c.to_pylist() for c in part.columns), strict=True))


def forgotten() -> None:
    """Drop the encoder that an earlier stage left in this worker, for stages that encode nothing."""
    encoder.cache_clear()
    released()


def released() -> None:
    """Give memory that is no longer used back to the system."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # another C library
        ctypes.CDLL("libc.so.6").malloc_trim(0)
