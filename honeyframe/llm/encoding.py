"""Exact token ids of whole texts at the speed of a table.

A byte-level vocabulary splits a text before every single space that stands between two characters that are not white
space, whatever stands around it. The pieces between such spaces therefore encode alike wherever they occur: each
distinct piece is encoded once per worker process and then looked up. A text with white space beside a space, or with
the string of an added token, goes whole to the library that the vocabulary file belongs to.

The table's pieces are merged by tiktoken from the ranks in the same file, which takes a fifth of the CPU time of the
tokenizers library on rare words; ``engine="library"`` leaves all to the library. The tests hold both equal.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator

import numpy as np

from honeyframe.llm.common import kept

#: Distinct pieces that one worker process keeps (about 150 bytes each); a fuller table is emptied and starts anew.
MOST_PIECES = 600_000
#: Texts encoded at once: about so many characters.
BATCH_CHARS = 4_000_000
#: Fixed value: how byte-level vocabularies of this kind split a text before merging.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: The white space characters beside space, tab, line feed and carriage return.
_RARE_SPACES = "".join(map(chr, (11, 12, 28, 29, 30, 31, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))

_open: dict[tuple[str, str], Encoder] = kept({})


def _runs(text: str) -> bool:
    """Whether some space stands beside white space, or at an end of the text."""
    if "  " in text or text[:1] == " " or text[-1:] == " " or "\0" in text:
        return True
    plain = text.replace("\n", "\r").replace("\t", "\r")
    if " \r" in plain or "\r " in plain:
        return True
    return any(c in plain for c in (_RARE_SPACES[:6] if plain.isascii() else _RARE_SPACES))


def _ranks(path: str) -> dict[bytes, int] | None:
    """The vocabulary as merge ranks, if its ids follow the order of its merges."""
    with open(path, encoding="utf-8") as f:
        model = json.load(f)["model"]
    if model.get("type") != "BPE" or model.get("ignore_merges") or model.get("byte_fallback"):
        return None
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    byte_of = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}
    vocabulary = model["vocab"]
    for i, pair in enumerate(model["merges"]):
        a, b = pair.split(" ") if isinstance(pair, str) else pair
        if vocabulary.get(a + b) != 256 + i:
            return None
    return {bytes(byte_of[c] for c in token): i for token, i in vocabulary.items() if i < 256 + len(model["merges"])}


class _Rows(dict):
    """The row of each piece; a piece that is new gets the next one."""

    def __init__(self) -> None:
        self.new: list[str] = []

    def __missing__(self, piece: str) -> int:
        row = self[piece] = len(self)
        self.new.append(piece)
        return row


class Encoder:
    """Ids as the library of a vocabulary file gives them, without begin, end or added special tokens."""

    def __init__(self, path: str, engine: str = "table"):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self._sentences, self._merger = path.endswith(".model"), None
        self._clear()
        if self._sentences:
            import sentencepiece

            self._library = sentencepiece.SentencePieceProcessor(model_file=path)
            return
        from tokenizers import Tokenizer

        self._library = Tokenizer.from_file(path)
        self._added = tuple(t.content for t in self._library.get_added_tokens_decoder().values())
        splitter = self._library.pre_tokenizer
        plain = type(splitter).__name__ == "ByteLevel" and not splitter.add_prefix_space and splitter.use_regex and self._library.normalizer is None
        if engine == "table" and plain and (ranks := _ranks(path)):
            import tiktoken

            self._merger = tiktoken.Encoding("own", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})
            self._spaced = np.zeros(max(ranks.values()) + 1, bool)
            self._spaced[[i for token, i in ranks.items() if token.startswith(b" ")]] = True

    def _clear(self) -> None:
        self._rows, self._ids = _Rows(), np.zeros(1 << 20, "<u4")
        self._starts, self._used = np.zeros(1, np.int64), 0

    def _whole(self, texts: list[str]) -> list[np.ndarray]:
        if self._sentences:
            return [np.asarray(x, "<u4") for x in self._library.encode(texts, num_threads=1)]
        return [np.asarray(x.ids, "<u4") for x in self._library.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self) -> None:
        """Encode new pieces as texts of many: a token begins with a space just where a piece begins. A head, which no space precedes, is marked by a zero character."""
        new, self._rows.new = self._rows.new, []
        found: list[np.ndarray] = []
        ends: list[np.ndarray] = []
        for start in range(0, len(new), 8192):
            part = new[start : start + 8192]
            heads = [x[0] == "\0" for x in part] if any(x[:1] == "\0" for x in part) else None
            ids = np.asarray(self._merger.encode_ordinary(" " + " ".join(x.lstrip("\0") for x in part) if heads is None else ""), "<u4")
            at = np.flatnonzero(self._spaced[ids])
            if heads is None and len(at) == len(part) and at[0] == 0:
                found.append(ids)
                ends.append(np.diff(at, append=len(ids)))
                continue
            for x in part:
                ids = np.asarray(self._merger.encode_ordinary(x[1:] if x[:1] == "\0" else " " + x), "<u4")
                found.append(ids)
                ends.append(np.array([len(ids)]))
        if not found:
            return
        ids, sizes = np.concatenate(found), np.concatenate(ends)
        while self._used + len(ids) > len(self._ids):
            self._ids = np.concatenate([self._ids, np.zeros_like(self._ids)])
        self._ids[self._used : self._used + len(ids)] = ids
        self._starts = np.concatenate([self._starts, self._used + np.cumsum(sizes)])
        self._used += len(ids)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one after the other, and each text's number of ids."""
        if self._merger is None:
            out = self._whole(texts)
            return (np.concatenate(out) if out else np.zeros(0, "<u4")), np.array([len(x) for x in out], np.int64)
        if len(self._rows) > MOST_PIECES:
            self._clear()
        whole = [i for i, x in enumerate(texts) if x and (any(a in x for a in self._added) or _runs(x))]
        apart = set(whole)
        pieces: list[str] = []
        heads: list[str] = []
        counts = np.zeros(len(texts), np.int64)
        for i, x in enumerate(texts):
            if x and i not in apart:
                cut = x.split(" ")
                heads.append("\0" + cut[0])
                cut[0] = heads[-1]
                counts[i] = len(cut)
                pieces += cut
        known = len(self._rows)
        for x in heads:  # heads first, so that the other new pieces can be encoded together
            self._rows[x]
        self._learn()
        rows = np.fromiter(map(self._rows.__getitem__, pieces), np.int64, len(pieces))
        self._learn()
        assert len(self._starts) == len(self._rows) + 1 >= known
        starts, sizes = self._starts[rows], self._starts[rows + 1] - self._starts[rows]
        after = np.cumsum(sizes)
        total = int(after[-1]) if len(after) else 0
        ids = self._ids[np.arange(total) + np.repeat(starts - (after - sizes), sizes)]
        edges = np.concatenate([[0], after])[np.concatenate([[0], np.cumsum(counts)])]
        lengths = np.diff(edges)
        if whole:
            own = dict(zip(whole, self._whole([texts[i] for i in whole]), strict=True))
            ids = np.concatenate([own[i] if i in own else ids[edges[i] : edges[i + 1]] for i in range(len(texts))])
            lengths[whole] = [len(own[i]) for i in whole]
        return ids, lengths


def encoder(path: str, engine: str = "table") -> Encoder:
    """One encoder for each vocabulary file and worker process."""
    if (path, engine) not in _open:
        _open[path, engine] = Encoder(path, engine)
    return _open[path, engine]


def encode_all(path: str, texts: list[str | None], engine: str = "table") -> Iterator[tuple[slice, np.ndarray, np.ndarray]]:
    """Slices of the texts, of about BATCH_CHARS characters, with their ids and each text's number of ids; null is empty."""
    tool, start, size = encoder(path, engine), 0, 0
    for i, text in enumerate(texts):
        size += len(text or "")
        if size >= BATCH_CHARS or i + 1 == len(texts):
            yield slice(start, i + 1), *tool.encode([x or "" for x in texts[start : i + 1]])
            start, size = i + 1, 0


def vocabulary(name: str) -> str:
    """The place of a public vocabulary file; workers resolve names on their own machine."""
    import public_tokenizers

    return name if os.path.sep in name else public_tokenizers.path(name)
