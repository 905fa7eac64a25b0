"""Token ids of whole Arrow text columns, exactly as the tokenizers library gives them.

Calling the library on running text costs about a second a megabyte. Both
vocabularies split text before merging, so pieces cut at positions where that
split always breaks can be encoded apart and joined again. A column is cut
into such pieces with numpy, equal pieces are encoded once, and each worker
process keeps the ids of pieces it has seen: an open-addressing table in numpy
arrays, in two generations of bounded size. Pieces are found by a 64-bit hash
and compared byte by byte before kept ids are used.
"""

from __future__ import annotations

import os
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa

from crewlens.llm.bytescan import blocks, span_hashes, text_buffer

#: pieces of one generation of a worker's table; a full generation becomes the old one, whose pieces move
#: over when they are met again and are forgotten otherwise (memory only, no effect on ids)
MEMO_PIECES = 700_000

_OTHER, _SPACE, _LETTER, _DIGIT, _SIGN = range(5)
_KIND = np.zeros(256, np.uint8)
_KIND[[0x20, *range(0x09, 0x0E)]] = _SPACE
for _b in range(0x21, 0x7F):
    _c = chr(_b)
    _KIND[_b] = _LETTER if _c.isalpha() else _DIGIT if _c.isdigit() else _SIGN
_KIND[ord("'")] = _OTHER  # contractions join letters to it


#: the last letter of Latin-1, whose lower case is one letter, and of Cyrillic
_LAST_PLAIN, _LAST_STABLE = "\u00ff", "\u04ff"


def _byte_letters() -> dict[int, int]:
    """How byte-level vocabularies write bytes: printable ones as themselves, the rest as letters from U+0100 on, in order."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = [b for b in range(256) if b not in shown]
    return {b: 0x100 + i for i, b in enumerate(rest)}


_BYTE_LETTERS = _byte_letters()


@dataclass(frozen=True)
class Vocabulary:
    """A tokenizer file and how its pre-split treats white space.

    ``spaced``: a word keeps the space before it (byte-level style); otherwise
    white space is dropped and a word's last token ends with ``word_end``.
    ``folded``: the vocabulary lower-cases.
    """

    file: str
    spaced: bool
    folded: bool = False
    word_end: str = ""


WORD_BPE = Vocabulary("word_bpe_49k.json", spaced=False, folded=True, word_end="</w>")
BYTE_BPE = Vocabulary("byte_bpe_50k.json", spaced=True)


def vocabulary_path(name: str) -> str:
    """Where the installed public vocabularies keep ``name``."""
    import public_tokenizers

    return public_tokenizers.path(name)


class Growing:
    """A numpy array that rows are appended to."""

    def __init__(self, kind):
        self.data, self.n = np.zeros(1 << 12, kind), 0

    def add(self, rows: np.ndarray) -> None:
        need = self.n + len(rows)
        if need > len(self.data):
            grown = np.zeros(max(need, len(self.data) * 3 // 2), self.data.dtype)
            grown[: self.n] = self.data[: self.n]
            self.data = grown
        self.data[self.n : need] = rows
        self.n = need


def ranges(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """first[0], first[0] + 1, ... (count[0] of them), then those of first[1] and so on."""
    return np.repeat(first - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))


class Pieces:
    """Pieces with their ids: hash -> place by linear probing, bytes and ids one after another."""

    def __init__(self, limit: int):
        self.limit = limit
        size = 1 << (2 * limit - 1).bit_length()
        self.keys, self.places, self.mask = np.zeros(size, np.uint64), np.full(size, -1, np.int32), np.uint64(size - 1)
        self.ids, self.id_first, self.id_count = Growing(np.int32), Growing(np.int32), Growing(np.int32)
        self.raw, self.raw_first, self.raw_count = Growing(np.uint8), Growing(np.int32), Growing(np.int32)

    def __len__(self) -> int:
        return self.id_first.n

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """Place of each hash, -1 where there is none."""
        out = np.full(len(hashes), -1, np.int32)
        open_, at = np.arange(len(hashes)), hashes & self.mask
        while len(open_):
            place = self.places[at]
            same = (self.keys[at] == hashes[open_]) & (place >= 0)
            out[open_[same]] = place[same]
            go = (place >= 0) & ~same
            open_, at = open_[go], (at[go] + np.uint64(1)) & self.mask
        return out

    def same(self, places: np.ndarray, buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Whether the pieces at ``places`` are the given spans of ``buf``, byte by byte."""
        count = self.raw_count.data[places].astype(np.int64)
        equal = count == ends - starts
        at = np.flatnonzero(equal & (count > 0))
        ours = self.raw.data[ranges(self.raw_first.data[places[at]].astype(np.int64), count[at])]
        theirs = buf[ranges(starts[at], count[at])]
        if len(at):
            equal[at] = np.logical_and.reduceat(ours == theirs, np.cumsum(count[at]) - count[at])
        return equal

    def add(self, hashes: np.ndarray, raw: np.ndarray, raw_count: np.ndarray, ids: np.ndarray, id_count: np.ndarray) -> np.ndarray:
        """Keep new pieces (of distinct hashes that are not in); returns their places."""
        places = np.arange(len(self), len(self) + len(hashes), dtype=np.int32)
        open_, at = np.arange(len(hashes)), hashes & self.mask
        while len(open_):
            free = np.flatnonzero(self.places[at] < 0)
            _, first = np.unique(at[free], return_index=True)  # one piece takes a free cell
            won = free[first]
            self.keys[at[won]], self.places[at[won]] = hashes[open_[won]], places[open_[won]]
            go = np.ones(len(open_), bool)
            go[won] = False
            open_, at = open_[go], (at[go] + np.uint64(1)) & self.mask
        for first, count, flat, n, rows in (
            (self.raw_first, self.raw_count, self.raw, raw_count, raw), (self.id_first, self.id_count, self.ids, id_count, ids),
        ):
            first.add(flat.n + np.cumsum(n) - n)
            count.add(n)
            flat.add(rows)
        return places

    def take(self, places: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(raw, raw counts, ids, id counts) of the pieces at ``places``."""
        rc, ic = self.raw_count.data[places].astype(np.int64), self.id_count.data[places].astype(np.int64)
        raw = self.raw.data[ranges(self.raw_first.data[places].astype(np.int64), rc)]
        return raw, rc, self.ids.data[ranges(self.id_first.data[places].astype(np.int64), ic)], ic


class Encoder:
    """Encodes Arrow text columns; one per worker process and vocabulary."""

    def __init__(self, vocab: Vocabulary, path: str | None = None, memo_pieces: int | None = None):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
        from tokenizers import Tokenizer, pre_tokenizers

        self.vocab = vocab
        self.full = Tokenizer.from_file(path or vocabulary_path(vocab.file))
        self.full.encode_special_tokens = True  # their strings in a text are ordinary text
        self.plain = Tokenizer(self.full.model)  # for pieces whose normal form and split are known
        self.plain.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        n = self.full.get_vocab_size(with_added_tokens=True)
        self.width = np.array(
            [len((self.full.id_to_token(i) or "").removesuffix(vocab.word_end)) for i in range(n)], np.int64
        )
        self.memo_pieces = memo_pieces or MEMO_PIECES
        self.young, self.old = Pieces(self.memo_pieces), Pieces(1)

    def _pieces(self, buf: np.ndarray, doc_starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        kind = _KIND[buf]
        n = len(buf)
        cut = np.zeros(n + 1, bool)
        cut[0] = True
        before, here = kind[:-1], kind[1:]
        # letters, digits and signs never share a token
        apart = (before != here) & (before >= _LETTER) & (here >= _LETTER)
        if self.vocab.spaced:
            # a space or line feed between two visible bytes starts a piece; one
            # side must be plain ASCII, as other bytes may be white space too
            lone = np.zeros(n, bool)
            if n > 2:
                mid = (buf[1:-1] == 0x20) | (buf[1:-1] == 0x0A)
                left, right = kind[:-2], kind[2:]
                lone[1:-1] = mid & (left != _SPACE) & (right != _SPACE) & ((left >= _LETTER) | (right >= _LETTER))
            cut[1:n] = apart
            cut[:n] |= lone
        else:
            cut[1:n] = apart | ((before == _SPACE) != (here == _SPACE))
        inner = doc_starts[(doc_starts >= 0) & (doc_starts < n)]
        cut[inner] = True
        starts = np.flatnonzero(cut[:n])
        ends = np.append(starts[1:], n)
        if not self.vocab.spaced:
            solid = kind[starts] != _SPACE
            starts, ends = starts[solid], ends[solid]
        return starts, ends

    def _encode_new(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of distinct pieces, flat, and how many each has."""
        text = [p.decode("utf-8") for p in pieces]
        simple = np.zeros(len(text), bool)
        mark = " " if self.vocab.spaced else ""
        mapped, last = [], _LAST_PLAIN if self.vocab.folded else _LAST_STABLE
        for i, t in enumerate(text):
            core = t.removeprefix(mark)
            # a run of letters is one word to the pre-split, whatever Unicode version it knows
            if core.isalpha() and max(core) <= last:
                simple[i] = True
                if self.vocab.folded:
                    core = core.lower()
                if not core.isascii():
                    core = core.encode("utf-8").decode("latin-1").translate(_BYTE_LETTERS)
                mapped.append(("Ġ" if t[:1] == mark else "") + core)
        counts = np.zeros(len(text), np.int64)
        rest = [t for t, s in zip(text, simple) if not s]
        odd = [e.ids for e in self.full.encode_batch_fast(rest, add_special_tokens=False)] if rest else []
        counts[~simple] = [len(x) for x in odd]
        even = np.zeros(0, np.int32)
        if mapped:
            even = np.array(self.plain.encode_batch_fast([" ".join(mapped)], add_special_tokens=False)[0].ids, np.int32)
            stop = np.cumsum([len(m) for m in mapped])
            upto = np.searchsorted(np.cumsum(self.width[even]), stop, "left") + 1
            counts[simple] = np.diff(upto, prepend=0)
        flat = np.zeros(int(counts.sum()), np.int32)
        at = np.repeat(simple, counts)
        flat[at] = even
        if odd:
            flat[~at] = np.fromiter((i for x in odd for i in x), np.int32, int((~at).sum()))
        return flat, counts

    def _block(self, part: np.ndarray, doc_starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, token count of each piece, start of each piece) of one block."""
        starts, ends = self._pieces(part, doc_starts)
        if not len(starts):
            return np.zeros(0, np.int32), np.zeros(0, np.int64), starts
        uniq, where, inverse = np.unique(span_hashes(part, starts, ends), return_index=True, return_inverse=True)
        s, e = starts[where], ends[where]
        if len(self.young) + len(uniq) > self.young.limit:
            # a block's own pieces always fit
            self.old, self.young = self.young, Pieces(max(self.memo_pieces, 2 * len(uniq)))
        place = self.young.find(uniq)
        lost = np.flatnonzero(place < 0)
        moved = self.old.find(uniq[lost])
        back = lost[moved >= 0]
        moved = moved[moved >= 0]
        known = self.old.same(moved, part, s[back], e[back])
        back, moved = back[known], moved[known]
        place[back] = self.young.add(uniq[back], *self.old.take(moved))
        held = np.flatnonzero(place >= 0)
        held = held[~np.isin(held, back)]
        clash = held[~self.young.same(place[held], part, s[held], e[held])]  # another piece has this hash
        new = np.flatnonzero(place < 0)
        raw = part.tobytes()
        if len(new):
            flat, counts = self._encode_new([raw[a:z] for a, z in zip(s[new].tolist(), e[new].tolist())])
            place[new] = self.young.add(uniq[new], part[ranges(s[new], e[new] - s[new])], e[new] - s[new], flat, counts)
        piece_of = self.young.id_first.data[place].astype(np.int64)
        count_of = self.young.id_count.data[place].astype(np.int64)
        ids = self.young.ids.data
        if len(clash):
            flat, counts = self._encode_new([raw[a:z] for a, z in zip(s[clash].tolist(), e[clash].tolist())])
            piece_of[clash] = self.young.ids.n + np.cumsum(counts) - counts
            count_of[clash] = counts
            ids = np.concatenate([ids[: self.young.ids.n], flat])
        counts = count_of[inverse]
        return ids[ranges(piece_of[inverse], counts)], counts, starts

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids, lengths): token ids of all rows one after another, and each row's number of ids."""
        buf, offs = text_buffer(column)
        lengths = np.zeros(len(offs) - 1, np.int64)
        out = []
        for a, z in blocks(buf, offs):
            lo, hi = np.searchsorted(offs, a, "left"), np.searchsorted(offs, z, "left")
            ids, counts, starts = self._block(buf[a:z], offs[lo:hi] - a)
            out.append(ids)
            if len(starts):
                row = np.searchsorted(offs, starts + a, "right") - 1
                lengths += np.bincount(row, weights=counts, minlength=len(lengths)).astype(np.int64)[: len(lengths)]
        return (np.concatenate(out) if out else np.zeros(0, np.int32)), lengths


@lru_cache(maxsize=4)
def encoder(vocab: Vocabulary, path: str | None = None, memo_pieces: int | None = None) -> Encoder:
    """This process's encoder for a vocabulary, with room for so many pieces a generation."""
    return Encoder(vocab, path, memo_pieces)


def with_end(ids: np.ndarray, lengths: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """The same rows with ``end_id`` appended to each."""
    out = np.full(len(ids) + len(lengths), end_id, np.int32)
    keep = np.ones(len(out), bool)
    keep[np.cumsum(lengths + 1) - 1] = False
    out[keep] = ids
    return out, lengths + 1
