"""Token ids of whole texts with a public byte-level BPE, remembered by piece of its pre-tokenizer.

The pre-tokenizer's pattern tells letters, numbers, white space and other characters apart, so numpy finds where its pieces begin in the
bytes of a whole batch. Arrow dictionary-encodes the pieces; only different ones are looked up, those never seen before are merged by the
tokenizer's model, and numpy gathers the ids. Texts with characters that engines may class differently, or with special tokens, fall
into chunks at single spaces between other characters, which no token crosses; odd chunks are left to the tokenizer itself.
"""

from __future__ import annotations

import json
import os
import re
import unicodedata
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Pieces and chunks that a worker remembers before it starts anew; bounds its memory at about 270 MB, buffers included.
MAX_CHUNKS = 500_000

_CUT = re.compile(r"(?<=\S) (?=\S)")
#: The byte-level pre-tokenizer's pattern: a fixed value. _pieces() cuts as it does.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Zero, and characters on whose being white space regular expression libraries differ.
_ODD_SPACE = "\x00\x1c\x1d\x1e\x1f\x85\u180e\u200b\ufeff"


def _alphabet() -> np.ndarray:
    """The byte-level alphabet, a fixed value: printable bytes of Latin-1 stand for themselves, the others in turn for U+0100 and up."""
    out = np.arange(256, dtype="<u4")
    others = [*range(0x21), *range(0x7F, 0xA1), 0xAD]
    out[others] = 0x100 + np.arange(len(others))
    return out


_ALPHABET = _alphabet()


#: Kinds of characters, as the pattern tells them apart.
_OTHER, _LETTER, _NUMBER, _SPACE, _UNSURE = range(5)


@lru_cache(maxsize=1)
def _kinds() -> np.ndarray:
    """The kind of every code point.

    Engines differ by the version of Unicode that they know. A character that Unicode 3.2 had, as a letter, number, space or other just as
    today, is the same to all of them; any other counts as unsure. Strings with one are left to the tokenizer itself, as a whole.
    """
    def kind(c: str) -> str:
        return c[0] if c[0] in "LN" or c == "Zs" else "C" if c == "Cn" else "other"

    by_name = {"L": _LETTER, "N": _NUMBER, "Z": _SPACE, "other": _OTHER}
    old, new = unicodedata.ucd_3_2_0.category, unicodedata.category
    out = np.full(0x110000, _UNSURE, dtype=np.uint8)
    for i in range(0x110000):
        now = kind(new(c := chr(i)))
        if i < 0x80 or now != "C" and kind(old(c)) == now:
            out[i] = _SPACE if c.isspace() else by_name[now]
    out[[ord(c) for c in _ODD_SPACE]] = _UNSURE
    return out


@lru_cache(maxsize=1)
def _unsure() -> str:
    """A regular expression for characters that the tokenizer's engine and others may take for different kinds."""
    bad = np.flatnonzero(_kinds() == _UNSURE)
    bad = bad[(bad < 0xD800) | (bad >= 0xE000)]
    return "[" + "".join(f"\\U{r[0]:08x}-\\U{r[-1]:08x}" for r in np.split(bad, np.flatnonzero(np.diff(bad) > 1) + 1)) + "]"


def _pieces(data: np.ndarray, heads: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the pattern's pieces begin in the UTF-8 bytes of texts that begin at heads, and the bytes of unsure characters."""
    kinds, n = _kinds(), len(data)
    kind = kinds[data]
    lead = np.flatnonzero(data >= 0xC0)
    if len(lead):
        first = data[lead].astype(np.int32)
        size = 2 + (first >= 0xE0) + (first >= 0xF0)
        point = first & (0x7F >> size)
        for k in (1, 2, 3):
            more = size > k
            point[more] = point[more] << 6 | data[lead[more] + k] & 0x3F
        kind[lead] = of_point = kinds[point]
        for k in (1, 2, 3):
            kind[lead[size > k] + k] = of_point[size > k]
    is_head = np.zeros(n + 3, dtype=bool)
    is_head[heads] = True
    begins = is_head.copy()
    begins[1:n] |= kind[1:] != kind[:-1]
    # the last of several white characters stands alone, or with what follows if it is a space
    space = kind == _SPACE
    after = np.flatnonzero(space[:-1] & ~space[1:]) + 1
    after = after[~is_head[after]]
    last = after - 1
    for _ in range(3):
        last = last - (data[last] & 0xC0 == 0x80)
    begins[last] = True
    begins[after[data[after - 1] == 0x20]] = False
    # 's and the like, where a piece begins with the apostrophe
    at = np.flatnonzero(data[:-1] == 0x27)
    at = at[begins[at] & ~is_head[at + 1]]
    one, two = data[at + 1], data[np.minimum(at + 2, n - 1)] * (at + 2 < n)
    short = np.isin(one, np.frombuffer(b"stmd", dtype=np.uint8))
    long = ~is_head[at + 2] & (((one == 0x72) | (one == 0x76)) & (two == 0x65) | (one == 0x6C) & (two == 0x6C))
    begins[at[short | long] + 1] = False
    begins[np.concatenate([at[short] + 2, at[long] + 3])] = True
    return np.flatnonzero(begins[:n]), np.flatnonzero(kind == _UNSURE)


def vocabulary_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _strings(texts: pa.Array) -> list[str]:
    return texts.to_numpy(zero_copy_only=False).tolist()  # much faster than to_pylist()


class ChunkEncoder:
    """Encodes texts to uint32 arrays. Made once per Python worker and vocabulary file."""

    _made: dict[str, "ChunkEncoder"] = {}

    @classmethod
    def of(cls, path: str) -> "ChunkEncoder":
        if path not in cls._made:
            cls._made[path] = cls(path)
        return cls._made[path]

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import regex
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        made = json.loads(self.tokenizer.to_str())
        kind = made["pre_tokenizer"] or {}
        if made["normalizer"] or kind.get("type") != "ByteLevel" or kind.get("add_prefix_space") or not kind.get("use_regex", True) or made["model"]["type"] != "BPE":
            raise ValueError(f"{path} is no plain byte-level BPE")
        #: The model alone: it gets words in the byte-level alphabet.
        self.model = Tokenizer(self.tokenizer.model)
        self.pieces = regex.compile(PATTERN).findall
        special = self.tokenizer.get_added_tokens_decoder()
        self.special = [t.content for t in special.values()]
        self.alone = re.compile("|".join([_unsure(), *map(re.escape, self.special)])).search
        strings = [self.tokenizer.id_to_token(i) or "" for i in range(self.tokenizer.get_vocab_size())]
        #: Bytes of the text that each id stands for: one character of a byte-level token is one byte.
        self.n_bytes = np.array([len(s.encode() if i in special else s) for i, s in enumerate(strings)], dtype=np.int64)
        #: Ids after which a sentence ends: a stop mark or a line end (the byte-level alphabet writes \n as Ċ).
        self.ends_sentence = np.array([s.endswith((".", "!", "?", "Ċ")) for s in strings], dtype=bool)
        self._forget()

    def _forget(self) -> None:
        """Start anew. A known string has a row; row r holds the ids from stops[r] to stops[r + 1]."""
        self.memo: dict[str, int] = {}
        self.ids, self.stops, self.n_ids = np.zeros(1 << 16, dtype=np.uint32), np.zeros(1 << 14, dtype=np.int64), 0

    def rest(self) -> None:
        """Let go of what was learned: Spark keeps idle workers, and they would hold it beside those of other stages."""
        self._forget()
        pa.default_memory_pool().release_unused()

    def _ids(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype=np.uint32)

    def _remember(self, strings: list[str], ids: np.ndarray, stops: np.ndarray) -> None:
        """Give each string a row: its ids end at its stop."""
        first = len(self.memo)
        if self.n_ids + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros(max(len(self.ids), len(ids)), dtype=np.uint32)])
        if first + len(strings) + 1 > len(self.stops):
            self.stops = np.concatenate([self.stops, np.zeros(max(len(self.stops), len(strings)), dtype=np.int64)])
        self.ids[self.n_ids : self.n_ids + len(ids)] = ids
        self.stops[first + 1 : first + 1 + len(strings)] = stops + self.n_ids
        self.n_ids += len(ids)
        self.memo.update(zip(strings, range(first, first + len(strings))))

    def _gather(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all rows, one behind the other, and where each row's stop."""
        starts = self.stops[rows]
        sizes = self.stops[rows + 1] - starts
        stops = np.cumsum(sizes)
        return self.ids[np.repeat(starts - stops + sizes, sizes) + np.arange(stops[-1] if len(stops) else 0)], stops

    def _merge(self, words: list[str]) -> None:
        """Remember words that the pattern leaves whole; the ids of all are shared out by their lengths in bytes."""
        for at in range(0, len(words), 20_000):
            part = words[at : at + 20_000]
            letters = _ALPHABET[np.frombuffer("\0".join(part).encode(), dtype=np.uint8)]
            spelled = letters.tobytes().decode("utf-32-le").split(chr(_ALPHABET[0]))
            ids = np.array(self.model.encode_batch_fast([spelled], add_special_tokens=False, is_pretokenized=True)[0].ids, dtype=np.uint32)
            ends = np.cumsum(np.fromiter(map(len, spelled), dtype=np.int64, count=len(spelled)))
            self._remember(part, ids, np.searchsorted(np.cumsum(self.n_bytes[ids]), ends, side="left") + 1)

    def _learn(self, strings: list[str]) -> None:
        """Remember strings that aren't known: chunks with their space, or beginnings of texts."""
        words, joined, cut = [], [], []
        for s in strings:
            if s.isascii() and s[s[:1] == " " :].isalpha():
                words.append(s)
            elif not s or self.alone(s):
                ids = self._ids(s)
                self._remember([s], ids, np.array([len(ids)]))
            elif s[s[:1] == " " :].isalpha():
                words.append(s)
            elif s[0] == " " and " " not in s[1:]:
                joined.append(s)
            else:
                cut.append(s)
        # each of the joined strings begins with the only space in it, so a piece that begins with one begins a string
        pieces = self.pieces("".join(joined))
        bounds = [i for i, p in enumerate(pieces) if p[0] == " "]
        for s in cut:
            bounds.append(len(pieces))
            pieces += self.pieces(s)
        self._merge(list(dict.fromkeys(p for p in [*words, *pieces] if p not in self.memo)))
        several = joined + cut
        if several:
            ids, stops = self._gather(np.fromiter(map(self.memo.get, pieces), dtype=np.int64, count=len(pieces)))
            last = np.array([*bounds[1:], len(pieces)]) - 1
            stops = stops[last]
            new = np.array([s not in self.memo for s in several])  # a string may be one piece
            sizes = np.diff(stops, prepend=0)
            self._remember([s for s, n in zip(several, new.tolist()) if n], ids[np.repeat(new, sizes)], np.cumsum(sizes[new]))

    def _rows(self, strings: list[str]) -> np.ndarray:
        """The row of each string, -1 for those that end in white space: what follows them counts, so they are never remembered."""
        get = self.memo.get
        rows = list(map(get, strings))
        if None in rows:
            unseen = dict.fromkeys(s for s, r in zip(strings, rows) if r is None)
            self._learn([s for s in unseen if not s[-1:].isspace()])
            rows = [get(s, -1) for s in strings]
        return np.array(rows, dtype=np.int64)

    def _odd(self, text: str) -> np.ndarray:
        """Ids of a text in chunks: one that holds unsure characters or a special token."""
        first, *chunks = _CUT.split(text)
        strings = [first, *[" " + c for c in chunks]]
        rows = self._rows(strings)
        if rows[-1] >= 0:
            return self._gather(rows)[0]
        return np.concatenate([self._gather(rows[:-1])[0], self._ids(strings[-1])])  # white space ends the text

    def encode_each(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of chunks that are cut already, each a text of its own: all of them, one behind the other, and where each one's stop."""
        rows = self._rows(chunks)
        odd = np.flatnonzero(rows < 0).tolist()
        if not odd:
            return self._gather(rows)
        rows[odd] = 0
        ids, stops = self._gather(rows)
        each = [ids[a:b] for a, b in zip([0, *stops.tolist()], stops.tolist())]
        for i in odd:
            each[i] = self._ids(chunks[i])
        return np.concatenate(each), np.cumsum([len(x) for x in each])

    def encode(self, texts: pa.Array | list[str | None]) -> list[np.ndarray]:
        """Ids of each text; null is empty."""
        if not len(texts):
            return []
        if len(self.memo) > MAX_CHUNKS:
            self._forget()
        texts = pc.fill_null(texts.cast(pa.string()) if isinstance(texts, pa.Array) else pa.array(texts, pa.string()), "")
        _, offsets, buffer = texts.buffers()
        offsets = np.frombuffer(offsets, dtype=np.int32)[texts.offset : texts.offset + len(texts) + 1]
        data = np.frombuffer(buffer or b"", dtype=np.uint8)[offsets[0] : offsets[-1]]
        heads, ends = (offsets[:-1] - offsets[0]).astype(np.int64), (offsets[1:] - offsets[0]).astype(np.int64)
        begins, unsure = _pieces(data, heads[heads < len(data)])
        odd = np.zeros(len(texts), dtype=bool)
        odd[np.searchsorted(ends, unsure, side="right")] = True
        for t in self.special:
            odd |= pc.match_substring(texts, t).to_numpy(zero_copy_only=False)
        bounds = np.append(begins, len(data)).astype(np.int32)
        pieces = pa.StringArray.from_buffers(len(begins), pa.py_buffer(bounds), pa.py_buffer(data))
        kept = ~odd[np.searchsorted(ends, begins, side="right")]
        if odd.any():  # their pieces may be no pieces, so nothing is learned from them
            pieces = pieces.filter(pa.array(kept))
        pieces = pieces.dictionary_encode()
        strings = _strings(pieces.dictionary)
        self._merge([s for s in strings if s not in self.memo])
        rows = np.fromiter(map(self.memo.get, strings), dtype=np.int64, count=len(strings))
        ids, stops = self._gather(rows[pieces.indices.to_numpy()])
        n_pieces = np.append(0, np.cumsum(kept))[np.searchsorted(begins, ends)]
        ends = np.append(0, stops)[n_pieces].tolist()
        out = [ids[a:b] for a, b in zip([0, *ends], ends)]
        for i in np.flatnonzero(odd).tolist():
            out[i] = self._odd(texts[i].as_py())
        return out


def batches(texts: pa.Array, most_bytes: int = 2_000_000):
    """Index ranges of texts of about most_bytes bytes, one text at least."""
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).tolist()
    start = size = 0
    for i, n in enumerate(sizes):
        if size and size + n > most_bytes:
            yield start, i
            start, size = i, 0
        size += n
    if start < len(sizes):
        yield start, len(sizes)
