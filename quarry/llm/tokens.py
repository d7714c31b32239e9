"""Exact, cached tokenisation of whole texts for the two tokenizers-library vocabularies.

A slice of texts is cut at blanks into chunks whose tokens do not depend on their neighbours, and the distinct chunks of
the slice into the library's pre-tokens, both by Arrow's kernels; the distinct pre-tokens' ids come from a bounded
worker cache, and only those that it does not hold are encoded by the library's model. Arrays then carry ids from
pre-tokens to chunks to texts. Chunks with letters beyond Latin-1 are cut by the library; texts for which the cut at blanks
would not be exact (special strings, runs of white space) go through the library's own full encode.
"""

from __future__ import annotations

import os
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: Entries of a cache generation; two generations are held, so memory is bounded.
CACHE_ENTRIES = 250_000
_LIVE: dict = {}
_CLEAR: dict = {}
_OWNER: list = [None]


def caches(owner: str, clear) -> None:
    """Register how to drop what an operator keeps in a worker between tasks."""
    _CLEAR[owner] = clear


def claim(owner: str) -> None:
    """Called where an operator starts work in a worker: a worker serves stages of several operators one after another, and
    only one operator's caches stay in its memory."""
    if _OWNER[0] != owner:
        for other, clear in _CLEAR.items():
            if other != owner:
                clear()
        _OWNER[0] = owner


class Generations(dict):
    """A dict that computes missing values, keeps the two latest generations and drops older ones.
    Keys longer than 200 characters are computed but not kept."""

    def __init__(self, compute, entries: int = CACHE_ENTRIES):
        super().__init__()
        self.compute, self.entries, self.old = compute, entries, {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.compute(key)
        if len(key) <= 200:
            if len(self) >= self.entries:
                self.old = dict(self)
                self.clear()
            self[key] = value
        return value


def _byte_letters() -> dict[int, str]:
    """The printable letter that byte-level vocabularies use for each byte: printable Latin-1 bytes
    stand for themselves, the others for the code points from 256 on, in order."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


#: Bytes of text that are cut at once (a longer text is a slice of its own), and chunks whose ids are gathered at once.
SLICE, GATHER = 8 << 20, 1 << 20
#: Latin-1 letters beyond ASCII. Texts of these, ASCII and the usual white space need no normalisation, lower-case letter
#: by letter, and are cut the same by Arrow's and the library's expressions; anything else is left to the library.
LATIN = "À-ÖØ-öø-ÿ"
#: White space as Python and the library have it; of it, separators on which they disagree.
SPACE = "\t-\r\x1c-\x20\u0085   -     　"
SEPARATORS = "\x1c-\x1f"
#: Put between chunks and pieces; texts that hold it are left to the library.
MARK = "\x1f"
BYTE_LETTERS = _byte_letters()
#: From a character to the letters of its UTF-8 bytes.
LETTERS = {c: "".join(BYTE_LETTERS[b] for b in chr(c).encode()) for c in range(256) if c < 33 or c > 126}


def _sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sums of the runs of values between offsets."""
    upto = np.concatenate([[0], np.cumsum(values)])
    return upto[offsets[1:]] - upto[offsets[:-1]]


def _joined(found: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(b"".join(found), "<u4"), np.fromiter(map(len, found), np.int64, len(found)) // 4


def _gathered(flat: np.ndarray, size: np.ndarray, which: np.ndarray) -> np.ndarray:
    """The runs of flat (of the given sizes) with the numbers which, one after another."""
    start, out = np.cumsum(size) - size, []
    for at in range(0, len(which), GATHER):
        run = which[at : at + GATHER]
        n = size[run]
        place = np.repeat(start[run] - (np.cumsum(n) - n), n)
        place += np.arange(len(place))
        out.append(flat[place])
    return out[0] if len(out) == 1 else np.concatenate(out) if out else flat[:0]


class Cut:
    """A slice of texts, cut: rows are runs of chunks (chunk, row_ends), plain chunks runs of pieces (piece, piece_ends)."""

    def __init__(self, enc: Encoder, texts: pa.Array):
        unsafe = pc.match_substring_regex(texts, enc.unsafe)
        rows = np.flatnonzero(unsafe)
        self.whole = texts.take(pa.array(rows)).to_pylist()
        parts = enc.chunked(pc.if_else(unsafe, "x", texts) if len(rows) else texts)
        coded = parts.values.dictionary_encode()
        self.row_ends = parts.offsets.to_numpy()
        odd = pc.match_substring_regex(coded.dictionary, enc.odd)
        self.odd = coded.dictionary.filter(odd).to_pylist()
        is_odd = odd.to_numpy(zero_copy_only=False)
        kinds = len(is_odd)
        place = np.empty(kinds, np.int64)  # plain chunks, then odd ones, then whole texts
        place[~is_odd] = np.arange(kinds - len(self.odd))
        place[is_odd] = np.arange(kinds - len(self.odd), kinds)
        self.chunk = place[coded.indices.to_numpy()]
        self.chunk[self.row_ends[rows]] = kinds + np.arange(len(rows))  # "x" is one chunk
        pieces = pc.split_pattern(pc.replace_substring_regex(enc.ready(coded.dictionary.filter(pc.invert(odd))), enc.pieced, rf"\0{MARK}"), MARK)
        coded = pieces.values.dictionary_encode()
        self.piece, self.piece_ends, self.keys = coded.indices.to_numpy(), pieces.offsets.to_numpy(), coded.dictionary.to_pylist()


class Encoder:
    """Token ids or token counts of texts."""

    #: Of a text: cut elsewhere than at blanks; of a chunk: not cut by `pieced`; the pieces of other chunks.
    unsafe: str
    odd: str
    pieced: str

    def __init__(self, path: str, known: dict[str, int] | None = None):
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.model = self.tok.model
        self.pieces = Generations(lambda p: self._tokens(p.translate(LETTERS)) if p else b"")
        self.chunks = Generations(self._odd)
        self.known = known or {}
        special = [re.escape(t.content) for t in self.tok.get_added_tokens_decoder().values()]
        self.unsafe = "|".join([self.unsafe, *special])

    def _tokens(self, letters: str) -> bytes:
        return array("I", [t.id for t in self.model.tokenize(letters)]).tobytes()

    def _library(self, text: str) -> bytes:
        return array("I", self.tok.encode(text, add_special_tokens=False).ids).tobytes()

    def _odd(self, chunk: str) -> bytes:
        if self.tok.normalizer is not None:
            chunk = self.tok.normalizer.normalize_str(chunk)
        return b"".join(self._tokens(p) for p, _ in self.tok.pre_tokenizer.pre_tokenize_str(chunk))

    def chunked(self, texts: pa.Array) -> pa.Array:
        raise NotImplementedError

    def ready(self, chunks: pa.Array) -> pa.Array:
        return chunks

    def cuts(self, texts: pa.Array) -> Iterator[Cut]:
        """The texts (null: empty), cut, in slices of at most SLICE bytes or one text."""
        texts = pc.fill_null(texts.combine_chunks() if isinstance(texts, pa.ChunkedArray) else texts, "")
        ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < len(texts):
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + SLICE, "right")))
            part = texts.slice(at, to - at)
            # marks may double a text, and offsets of the common type have 31 bits
            yield Cut(self, part.cast(pa.large_string()) if part.nbytes > 1 << 28 else part)
            at = to

    def encoded(self, texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For each slice of the texts: their ids, one text after another, and the number of ids of each text."""
        for cut in self.cuts(texts):
            flat, size = _joined(list(map(self.pieces.__getitem__, cut.keys)))
            rest, rest_size = _joined([*map(self.chunks.__getitem__, cut.odd), *map(self._library, cut.whole)])
            flat = np.concatenate([_gathered(flat, size, cut.piece), rest])
            size = np.concatenate([_sums(size[cut.piece], cut.piece_ends), rest_size])
            yield _gathered(flat, size, cut.chunk), _sums(size[cut.chunk], cut.row_ends)

    def counted(self, texts: pa.Array) -> np.ndarray:
        """The number of ids of each text: lengths of pre-tokens from the known table, others from the cache."""
        out = [np.zeros(0, np.int64)]
        known, pieces = self.known.get, self.pieces
        for cut in self.cuts(texts):
            size = np.array([known(k) or len(pieces[k]) // 4 for k in cut.keys], np.int64)
            rest = np.array([len(x) // 4 for x in (*map(self.chunks.__getitem__, cut.odd), *map(self._library, cut.whole))], np.int64)
            size = np.concatenate([_sums(size[cut.piece], cut.piece_ends), rest])
            out.append(_sums(size[cut.chunk], cut.row_ends))
        return np.concatenate(out)


class ByteLevel(Encoder):
    """Byte-level pieces that carry their leading blank, as chunks do; only a text's start may have none."""

    unsafe = f" [{SPACE}]|[{SPACE}] |[{SEPARATORS}]"
    odd = f"[^\t\n\r\x20-\x7e{LATIN}]|[\t\n\r][\t\n\r]"
    pieced = rf"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z{LATIN}]+| ?[0-9]+| ?[^\sA-Za-z0-9{LATIN}]+|\s"

    def chunked(self, texts):
        return pc.split_pattern(pc.replace_substring(texts, " ", MARK + " "), MARK)


class WordEnds(Encoder):
    """Lower-cased word pieces with an end mark; white space only separates."""

    unsafe = f"[{SEPARATORS}]"
    odd = f"[^\x21-\x7e{LATIN}]"
    pieced = rf"'s|'t|'re|'ve|'m|'ll|'d|[a-z{LATIN}]+|[0-9]|[^\sa-z0-9{LATIN}]+"

    def chunked(self, texts):
        return pc.utf8_split_whitespace(texts)

    def ready(self, chunks):
        return pc.utf8_lower(chunks)


def encoder(path: str, known: dict[str, int] | None = None, stamp: str = "") -> Encoder:
    """This worker's encoder of the vocabulary; it and its caches live as long as the worker. stamp
    tells tables of known chunk lengths apart: another stamp starts anew."""
    claim("tokens")
    made = _LIVE.get(path)
    if made is None or (stamp and made[0] != stamp):
        import json

        with open(path, encoding="utf-8") as f:
            kind = WordEnds if json.load(f)["model"].get("end_of_word_suffix") else ByteLevel
        made = _LIVE[path] = (stamp, kind(path, known))
    return made[1]


def _clear_words() -> None:
    word_hash.clear()
    word_hash.old = {}


#: 64-bit hashes of words (bytes), kept by the worker.
word_hash = Generations(xxhash.xxh3_64_intdigest)
caches("tokens", _LIVE.clear)
caches("words", _clear_words)
