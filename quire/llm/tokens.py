"""Batch encoding with the tokenizers library inside Arrow functions.

A text is cut at boundaries that no token can cross (before or at white space),
the different pieces of a batch are encoded once, and the pieces' ids are put
together again by array operations. That gives what the library gives for the
whole text, for less work, and a very long text is never encoded in one call.
Batches are cut by bytes, not rows.
"""

from __future__ import annotations

import json
import os
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text handled at once; pieces and pre-tokens remembered from batch to batch, and the characters of the longest.
BATCH_BYTES = 8 << 20
MEMORY_PIECES = 300_000
MEMORY_TOKENS = 200_000
MEMORY_CHARS = 64
#: Longer pieces are cut between a mark and a letter of scripts that write without blanks.
LONG_CHARS = 1 << 14
_MARKED = re.compile("(?<=[\u3001\u3002\uff01\uff0c\uff1a\uff1b\uff1f])(?=[\u3041-\u3096\u30a1-\u30fa\u4e00-\u9fff\uac00-\ud7a3])")

#: Unicode White_Space, as the pre-tokenizers' \s has it.
_SPACE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_LED = re.compile(f"[{_SPACE}]*[^{_SPACE}]+|[{_SPACE}]+")
_NEAR = r"[\t-\r \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
#: A space beside other white space: where cutting at single spaces isn't safe.
_UNEVEN = f"{_NEAR} | {_NEAR}"


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@lru_cache(maxsize=4)
def load_tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


#: Letters and numbers among the first 256 code points.
_L, _N = "A-Za-zªµºÀ-ÖØ-öø-ÿ", "0-9²³¹¼½¾"
#: Characters whose handling no normal form or Unicode version changes.
_PLAIN = re.compile(r"[\n !-~¡-¬®-ÿ]+")
#: Pre-tokens of the two kinds of tokenizer, for texts of such characters.
_LED_TOKENS = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{_L}]+| ?[{_N}]+| ?[^\s{_L}{_N}]+|\s+(?!\S)|\s+")
_WORD_TOKENS = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{_L}]+|[{_N}]|[^\s{_L}{_N}]+")
#: The word tokenizer's pattern as its file has it.
_WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def byte_characters() -> dict[int, str]:
    """The character that stands for each byte: its own where that prints, else the next from 256 on."""
    printing = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in printing]
    return {b: chr(b) for b in printing} | {b: chr(256 + i) for i, b in enumerate(rest)}


class _Merged(dict):
    """The library's merges of a pre-token, remembered up to a bound."""

    def __init__(self, model, lengths_only: bool):
        self.model, self.lengths_only, self.letters = model, lengths_only, byte_characters()

    def __missing__(self, token: str):
        found = self.model.tokenize(token if token.isascii() and token.isalnum() else "".join([self.letters[b] for b in token.encode()]))
        value = len(found) if self.lengths_only else array("I", [t.id for t in found]).tobytes()
        if len(token) <= MEMORY_CHARS and len(self) < MEMORY_TOKENS:
            self[token] = value
        return value


class PieceEncoder:
    """Ids of pieces, remembering the first short ones met, up to a bound.

    A piece of plain characters is cut to pre-tokens here, and the library's model
    merges each different one once; any other piece, and any piece of a tokenizer
    that isn't one of the two known kinds, is encoded by the library whole.
    """

    def __init__(self, path: str, lengths_only: bool = False):
        tokenizer = load_tokenizer(path)
        self.encode = tokenizer.encode_batch_fast
        self.lengths_only = lengths_only
        self.known: dict = {}
        self.merged = _Merged(tokenizer.model, lengths_only)
        self.cut, self.lower = self._kind(json.loads(tokenizer.to_str()))
        self.special = re.compile("|".join(re.escape(t.content) for t in tokenizer.get_added_tokens_decoder().values()) or r"(?!)")

    @staticmethod
    def _kind(definition: dict):
        """(pattern of pre-tokens, whether they are lower-cased), or none for an unknown kind."""
        before, normal, model = definition["pre_tokenizer"] or {}, definition["normalizer"] or {}, definition["model"]
        if model["type"] != "BPE" or model.get("dropout") or any(t["normalized"] for t in definition["added_tokens"]):
            return None, False
        if before.get("type") == "ByteLevel" and before["use_regex"] and not before["add_prefix_space"] and not normal:
            return _LED_TOKENS.findall, False
        steps = [x["type"] for x in normal.get("normalizers", [])]
        parts = before.get("pretokenizers", [{}])
        if steps == ["NFC", "Replace", "Lowercase"] and parts[0].get("pattern") == {"Regex": _WORD_PATTERN} and parts[0]["invert"] and len(parts) == 2 and parts[1]["type"] == "ByteLevel":
            return _WORD_TOKENS.findall, True
        return None, False

    def _plain(self, piece: str):
        """A piece's value from its pre-tokens' values; None where the library has to encode it whole."""
        if self.cut is None:
            return None
        # a word of ASCII letters, a blank before it or not, is one pre-token of either kind
        if piece.isascii() and (piece[1:] if piece[0] == " " else piece).isalpha():
            return self.merged[piece.lower() if self.lower else piece]
        if not _PLAIN.fullmatch(piece) or self.special.search(piece):
            return None
        values = [self.merged[t] for t in self.cut(piece.lower() if self.lower else piece)]
        return sum(values) if self.lengths_only else b"".join(values)

    def __call__(self, pieces: list[str]) -> list:
        """For each piece its number of tokens, or its ids as uint32 bytes."""
        known, found, whole = self.known, {}, []
        for piece in pieces:
            if piece not in known:
                value = self._plain(piece) if piece else (0 if self.lengths_only else b"")
                if value is None:
                    whole.append(piece)
                else:
                    found[piece] = value
        # a mark and a letter are never in one pre-token, so a long piece can be cut between them
        parts = [_MARKED.split(piece) if len(piece) > LONG_CHARS else [piece] for piece in whole]
        flat = [part for some in parts for part in some]
        values: list = []
        for start in range(0, len(flat), 1024):
            encoded = self.encode(flat[start : start + 1024], add_special_tokens=False)
            values += [len(e) for e in encoded] if self.lengths_only else [array("I", e.ids).tobytes() for e in encoded]
        at = 0
        for piece, some in zip(whole, parts, strict=True):
            own = values[at : at + len(some)]
            found[piece], at = sum(own) if self.lengths_only else b"".join(own), at + len(some)
        out = [known[p] if p in known else found[p] for p in pieces]
        room = MEMORY_PIECES - len(known)
        if room > 0:
            known.update(islice(((p, v) for p, v in found.items() if len(p) <= MEMORY_CHARS), room))
        return out


@lru_cache(maxsize=2)
def shared_encoder(path: str, lengths_only: bool = False) -> PieceEncoder:
    """The worker's encoder of a tokenizer: tasks that it runs one after the other share what is remembered."""
    return PieceEncoder(path, lengths_only)


def forget() -> None:
    """Let go of the worker's encoders; for tasks that need its memory for something else."""
    shared_encoder.cache_clear()


def byte_batches(batch: pa.RecordBatch, text_index: int, most: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of about ``most`` bytes of text, of one row at least."""
    if not batch.num_rows:
        return
    sizes = pc.fill_null(pc.binary_length(batch.column(text_index)), 0).to_numpy(zero_copy_only=False)
    part = np.cumsum(sizes) // most
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1), batch.num_rows]
    for a, b in zip(cuts, cuts[1:], strict=False):
        yield batch.slice(a, b - a)


def _ranges(offsets: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Sums of values[offsets[i]:offsets[i+1]]."""
    run = np.concatenate([[0], np.cumsum(values)])
    return run[offsets[1:]] - run[offsets[:-1]]


def _words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """Offsets of each text's pieces, each piece's code, and the different pieces."""
    lists = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
    offsets = lists.offsets.to_numpy().astype(np.int64)
    coded = lists.flatten().dictionary_encode()
    return offsets - offsets[0], coded.indices.to_numpy().astype(np.int64), coded.dictionary.to_pylist()


def encode_words(texts: pa.Array, encoder: PieceEncoder) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, ids) of the texts under a tokenizer that drops white space.

    For such a tokenizer (white space is removed before the merges) every run of
    white space is a boundary, so pieces are the runs between.
    """
    offsets, codes, pieces = _words(texts)
    ids = encoder(pieces)
    if not len(codes):
        return np.zeros(len(texts) + 1, np.int64), np.zeros(0, "<u4")
    lengths = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
    begins = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    each = lengths[codes]
    ends = np.cumsum(each)
    flat = np.frombuffer(b"".join(ids), "<u4")
    at = np.repeat(begins[codes] - (ends - each), each) + np.arange(int(ends[-1]))
    return np.concatenate([[0], ends])[offsets], flat[at]


def count_led(texts: pa.Array, encoder: PieceEncoder) -> np.ndarray:
    """Token counts under a byte-level tokenizer whose tokens may begin with a space.

    Its pre-tokens never run from another character into white space, so a text
    can be cut before any white space that follows something else. Texts with
    only single inner spaces, nearly all, are cut at spaces by Arrow; others by a
    pattern.
    """
    texts = pc.fill_null(texts, "")
    uneven = pc.match_substring_regex(texts, _UNEVEN).to_numpy(zero_copy_only=False)
    counts = np.zeros(len(texts), np.int64)
    rows = np.flatnonzero(~uneven)
    if len(rows):
        lists = pc.split_pattern(texts.take(pa.array(rows)), " ")
        offsets = lists.offsets.to_numpy().astype(np.int64)
        offsets -= offsets[0]
        coded = lists.flatten().dictionary_encode()
        codes = coded.indices.to_numpy()
        pieces = coded.dictionary.to_pylist()
        led = np.array(encoder([" " + p for p in pieces]), np.int64)
        first_codes = codes[offsets[:-1]]
        used = np.unique(first_codes)
        first = dict(zip(used.tolist(), encoder([pieces[i] for i in used]), strict=True))
        begin = np.array([first[c] for c in first_codes.tolist()], np.int64)
        counts[rows] = _ranges(offsets, led[codes]) - led[first_codes] + begin
    for row in np.flatnonzero(uneven).tolist():
        counts[row] = sum(encoder(_LED.findall(texts[row].as_py())))
    return counts
