"""Token ids and counts of public tokenizers, by their pieces.

The library splits a text into pieces and merges inside each piece only, so a piece has the same ids wherever it
stands. Texts of plain Latin characters are split here and looked up in a bounded table of pieces; any other text,
and any text that may hold a special token's string, goes to the library whole.
"""

from __future__ import annotations

import json
import os
import re
import unicodedata
from array import array

import numpy as np

#: Pieces that a worker remembers, at most; the table is emptied when full.
PIECES = 250_000
_PLAIN = re.compile("[\t\n\r -~À-ÖØ-öø-ÿ]*")


class _Pieces(dict):
    """A table that computes what it lacks and never outgrows PIECES."""

    def __init__(self, make):
        super().__init__()
        self.make = make

    def __missing__(self, piece: str):
        if len(self) >= PIECES:
            self.clear()
        got = self[piece] = self.make(piece)
        return got


def plain(text: str) -> bool:
    return "<|" not in text and _PLAIN.fullmatch(text) is not None


class ByteBpe:
    """The ids of a byte-level vocabulary as little-endian unsigned 32-bit numbers."""

    SPLIT = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+")

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import tiktoken
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            vocabulary = json.load(f)["model"]["vocab"]
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        byte_of = {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in set(shown))}
        ranks = {bytes(byte_of[c] for c in token): k for token, k in vocabulary.items() if all(c in byte_of for c in token) and token != "<|endoftext|>"}
        self.core = tiktoken.Encoding("pieces", pat_str=r"(?s:.+)", mergeable_ranks=ranks, special_tokens={})
        self.pieces = _Pieces(lambda p: array("I", self.core._encode_single_piece(p.encode())).tobytes())

    def ids(self, text: str) -> bytes:
        if plain(text):
            return b"".join(map(self.pieces.__getitem__, self.SPLIT.findall(text)))
        return array("I", self.library.encode(text, add_special_tokens=False).ids).tobytes()


#: Fixed value: what the vocabulary's split and its normaliser take as white space.
_WHITE = "\t\n\v\f\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_RUN = re.compile(f"[^{_WHITE}]+")


class WordBpe:
    """Token counts of a lower-casing vocabulary with word ends, at every prefix of a text.

    White space parts a text into runs, and a run into pieces, none of which the library's merges cross. `table` stores
    the exact count at the end of every piece; `inside` continues it into a piece by dynamic programming over its
    prefixes: the last token of a prefix is the one token that ends there and stands well beside the last token of the
    prefix before it, so each prefix takes one step from an earlier one and nothing is encoded again. Runs that Unicode
    composes, lower-cases to another length or does not print, or that may hold the string of a special token, are pieces
    of their own, whose prefixes go to the library.
    """

    SPLIT = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_]+|\d|(?:[^\s\w]|_)+")

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import regex
        import tiktoken
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        self.any_split = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|" + rf"[^{_WHITE}\p{{L}}\p{{N}}]+")
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        byte_of = {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in set(shown))}

        def raw(token: str) -> bytes:  # the word end as byte 255, which no UTF-8 text has
            end = token.endswith("</w>")
            return bytes(byte_of[c] for c in token[: len(token) - 4 * end]) + b"\xff" * end

        ranks = {bytes([b, 255]): b for b in range(255)} | {bytes([b]): 300 + b for b in range(256)}
        for k, m in enumerate(model["merges"]):
            a, b = m.split(" ") if isinstance(m, str) else m
            ranks.setdefault(raw(a) + raw(b), 1000 + k)
        self.core = tiktoken.Encoding("pieces", pat_str=r"(?s:.+)", mergeable_ranks=ranks, special_tokens={})
        self.ranks = ranks
        self.pieces = _Pieces(lambda p: len(self.core._encode_single_piece(p.encode() + b"\xff")))
        self.whole = _Pieces(self._library_count)
        self.beside = _Pieces(lambda pair: self.core._encode_single_piece(pair[0] + pair[1]) == [ranks[t] for t in pair if t])
        # lengths of the tokens that end in two given bytes, longest first
        ends: dict[bytes, set[int]] = {}
        for t in ranks:
            ends.setdefault(t[-2:], set()).add(len(t))
        self.lengths = {k: sorted(v, reverse=True) for k, v in ends.items()}

    def _library_count(self, text: str) -> int:
        return len(self.library.encode(text, add_special_tokens=False).ids)

    def _cells(self, text: str, places: bool = True) -> tuple[list[int], list[str], list[bool]]:
        """(starts, pieces, whether a piece goes to the library) of a text; starts only if asked for."""
        if plain(text):
            low = text.lower()
            if not places:
                found = self.SPLIT.findall(low)
                return [], found, []
            ms = list(self.SPLIT.finditer(low))
            return [m.start() for m in ms], [m.group() for m in ms], [False] * len(ms)
        starts, pieces, odd = [], [], []
        for run in _RUN.finditer(text):
            own = run.group()
            low = "".join(map(str.lower, own))
            if "<|" in own or len(low) != len(own) or not own.isprintable() or not unicodedata.is_normalized("NFC", own):
                starts.append(run.start())
                pieces.append(own)
                odd.append(True)
                continue
            for m in self.any_split.finditer(low):
                starts.append(run.start() + m.start())
                pieces.append(m.group())
                odd.append(False)
        return starts, pieces, odd

    def table(self, text: str, places: bool = True) -> tuple[list[int], list[str], list[bool], np.ndarray]:
        """(starts, pieces, odd, counts): counts[k] is the exact count of the prefix that ends with the k-th piece."""
        starts, pieces, odd = self._cells(text, places)
        if any(odd):
            own = [self.whole[p] if o else self.pieces[p] for p, o in zip(pieces, odd, strict=True)]
        else:
            own = list(map(self.pieces.__getitem__, pieces))
        return starts, pieces, odd, np.cumsum(np.array(own, np.int64))

    def count(self, text: str) -> int:
        counts = self.table(text, places=False)[3]
        return int(counts[-1]) if len(counts) else 0

    def inside(self, piece: str, odd: bool = False) -> list[int]:
        """Counts of the prefixes of 1, 2, ... characters of a piece."""
        if odd:
            return [self._library_count(piece[:k]) for k in range(1, len(piece) + 1)]
        if piece[0] == "'" and len(piece) > 1 and piece[1].isalpha():  # a cut contraction falls into its parts
            return [sum(self.pieces[p] for p in self.any_split.findall(piece[:k])) for k in range(1, len(piece) + 1)]
        data, out = piece.encode(), []
        at_end = {at for at, b in enumerate(data, 1) if at == len(data) or data[at] & 0xC0 != 0x80}
        last, count = [b""], [0]
        for at in range(1, len(data) + 1):
            t, n = self._step(data, at, last, count, b"")
            last.append(t)
            count.append(n)
            if at in at_end:
                out.append(self._step(data, at, last, count, b"\xff")[1])
        return out

    def _step(self, data: bytes, at: int, last: list[bytes], count: list[int], mark: bytes) -> tuple[bytes, int]:
        """(last token, count) of the first `at` bytes, with the word end if mark is that, from earlier prefixes."""
        extra = len(mark)
        for n in self.lengths.get((data[max(at - 2, 0) : at] + mark)[-2:], (1 + extra,)):
            n -= extra
            if 0 < n <= at:
                t = data[at - n : at] + mark
                if t in self.ranks and self.beside[last[at - n], t]:
                    return t, count[at - n] + 1
        t = data[at - 1 : at] + mark
        return t, count[at - 1] + 1

    def every_prefix(self, text: str) -> list[int]:
        """The count of tokens of text[:k] for k = 0 .. len(text), as the library would count that prefix alone."""
        starts, pieces, odd, counts = self.table(text)
        out, total = [0], 0
        for start, piece, o, c in zip(starts, pieces, odd, counts.tolist(), strict=True):
            out += [total] * (start + 1 - len(out))
            out += [total + n for n in self.inside(piece, o)]
            total = c
        return out + [total] * (len(text) + 1 - len(out))

    def longest_prefix(self, text: str, budget: int) -> int:
        """The most characters k such that text[:k] has at most `budget` tokens.

        Counts at the ends of pieces never fall, so the answer lies in the last piece before which the budget holds.
        """
        starts, pieces, odd, counts = self.table(text)
        if not len(counts) or counts[-1] <= budget:
            return len(text)
        before = np.concatenate(([0], counts[:-1]))
        k = int(np.searchsorted(before, budget, side="right")) - 1
        within = [j for j, n in enumerate(self.inside(pieces[k], odd[k]), 1) if before[k] + n <= budget]
        return starts[k] + max(within, default=0)
