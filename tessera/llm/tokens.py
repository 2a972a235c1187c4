"""Exact token ids of whole texts by the tokenizers library, with each distinct word encoded once.

A byte-pair encoder treats the pieces of its pre-tokenizer independently, and no
piece spans white space but for one leading blank.  So a text's ids are the
ids of its words in order, and words repeat.  Texts with characters on
which Python and the library might split or fold differently, and those with the vocabulary's
control strings, go whole through the library.  Ids are those of its plain call, ``add_special_tokens=False`` and nothing else.
"""

from __future__ import annotations

import os
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from tokenizers import Tokenizer

#: Distinct words that a worker remembers, by kind (some 200 bytes each); beyond it starts afresh.
WORDS = {"word": 700_000, "byte": 1_300_000}
#: Words longer than this are encoded but not remembered.
LONG = 64
#: Words handed to the library in one text.
_TOGETHER = 500

_MARKS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"  # neither letters nor digits: at a word's end, one piece
_ODD = re.compile("[\x1c-\x1fɐ-\U0010ffff]")
#: With none of these in a text, each blank or line end stands alone and a plain split finds the chunks.
_UNEASY = ("  ", "\n\n", " \n", "\n ", "\t", "\r", "\x0b", "\x0c", "\x85", "\xa0", "\x00")
#: White space of other kinds; without it words are what stands between blanks and line ends.
_SPACES = ("\t", "\r", "\x0b", "\x0c", "\x85", "\xa0")
_CHUNK = re.compile(r" ?\S+|\s+(?!\S)|\s+")
_WORD_PIECES = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")

_OPEN: dict[tuple[str, str], "Encoder"] = {}


def chunks(text: str) -> list[str]:
    """Words with the blank before them, and white space of other kinds by itself."""
    return _CHUNK.findall(text)


def pieces(word: str) -> int:
    """How many pieces the word kind's pre-tokenizer makes of a word that is no run of letters."""
    core = word.rstrip(_MARKS)
    return 2 if core.isalpha() else len(_WORD_PIECES.findall(word.lower()))


class Encoder:
    """kind ``word``: lower-cased words without white space; kind ``byte``: byte level, lossless."""

    def __init__(self, path: str, kind: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)
        # texts with one of the vocabulary's added strings go through the library, which takes these out before all else
        self.added = [a.content for a in self.tokenizer.get_added_tokens_decoder().values()]
        vocabulary = self.tokenizer.get_vocab()
        self.kind = kind
        self.words: dict[str, bytes] = {"": b""}  # what stands between two marks may be nothing
        # a token that ends a piece (word kind) or begins one (byte kind: those with a leading blank)
        self.edge = np.zeros(1 + max(vocabulary.values()), bool)
        self.edge[[i for t, i in vocabulary.items() if (t.endswith("</w>") if kind == "word" else t.startswith("\u0120"))]] = True

    @classmethod
    def open(cls, path: str, kind: str) -> "Encoder":
        if (path, kind) not in _OPEN:
            _OPEN[path, kind] = cls(path, kind)
        return _OPEN[path, kind]

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _learn(self, new: list[str]) -> dict[str, bytes]:
        """Encodes new words, many in one text: their bounds can be told from the edge tokens."""
        found: dict[str, bytes] = {}
        word = self.kind == "word"
        joined = new if word else [p for p in new if p[0] == " " and not p.isspace()]
        rest = [] if word else [p for p in new if p[0] != " " or p.isspace()]
        groups = [joined[i : i + _TOGETHER] for i in range(0, len(joined), _TOGETHER)]
        texts = [(" " if word else "").join(g) for g in groups]

        def put(group: list[str], ids: np.ndarray, cut: np.ndarray) -> None:
            raw, at = ids.astype("<u4").tobytes(), (cut * 4).tolist()
            found.update(zip(group, [raw[i:j] for i, j in zip(at, at[1:])]))

        for group, got in zip(groups, self.tokenizer.encode_batch_fast(texts, add_special_tokens=False) if texts else ()):
            ids = np.array(got.ids, np.int64)
            at = np.flatnonzero(self.edge[ids])
            last = np.cumsum([1 if w.isalpha() else pieces(w) for w in group]) if word else np.arange(1, len(group) + 1)
            if len(at) != last[-1]:
                rest += group
            else:
                put(group, ids, np.concatenate(([0], at[last - 1] + 1)) if word else np.concatenate((at, [len(ids)])))
        if rest:
            got = self.tokenizer.encode(rest, is_pretokenized=True, add_special_tokens=False)
            put(rest, np.array(got.ids, np.int64), np.searchsorted(np.array(got.word_ids), np.arange(len(rest) + 1)))
        return found

    def _lines(self, text: str) -> str | None:
        """A text with a mark between its words, if a plain split finds them; None if not."""
        if self.kind == "word":
            return None if any(x in text for x in _SPACES) else text.replace("\n", " ")
        return None if any(x in text for x in _UNEASY) else text.replace("\n", "\x00\n\x00").replace(" ", "\x00 ")

    def _known(self, words: list[str]) -> list[bytes]:
        """The ids of distinct words; those that are new are encoded together."""
        parts = list(map(self.words.get, words))
        if None in parts:
            missing = [k for k, x in enumerate(parts) if x is None]
            new = [words[k] for k in missing]
            found = self._learn(new)
            for k, w in zip(missing, new):
                parts[k] = found[w]
            self.words.update((w, found[w]) for w in new if len(w) <= LONG)
        return parts

    def _together(self, lines: list[str]) -> list[bytes]:
        """The ids of texts whose words are marked off: the distinct words of all are looked up once, and the ids gathered."""
        split = pc.split_pattern(pa.array(lines, pa.large_string()), " " if self.kind == "word" else "\x00")
        words = split.flatten().dictionary_encode()
        parts = self._known(words.dictionary.to_numpy(zero_copy_only=False).tolist())
        ids = np.frombuffer(b"".join(parts), "<u4")
        size = np.fromiter(map(len, parts), np.int64, len(parts)) // 4
        first = np.cumsum(size) - size
        at = words.indices.to_numpy()
        n = size[at]
        upto = np.concatenate(([0], np.cumsum(n)))
        raw = ids[np.arange(upto[-1]) + np.repeat(first[at] - upto[:-1], n)]
        edge = upto[split.offsets.to_numpy()].tolist()
        return [raw[i:j].tobytes() for i, j in zip(edge, edge[1:])]

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Each text's ids as little-endian unsigned 32-bit integers; a null text has none."""
        out: list[bytes] = [b""] * len(texts)
        if len(self.words) > WORDS[self.kind]:
            self.words = {"": b""}
        rows, lines = [], []
        for i, t in enumerate(texts):
            if not t:
                continue
            if _ODD.search(t) or any(a in t for a in self.added):
                out[i] = self.whole(t)
            elif (line := self._lines(t)) is not None:
                rows.append(i)
                lines.append(line)
            else:
                words = t.split() if self.kind == "word" else chunks(t)
                distinct = list(dict.fromkeys(words))
                found = dict(zip(distinct, self._known(distinct)))
                out[i] = b"".join([found[w] for w in words])
        if rows:
            for i, ids in zip(rows, self._together(lines)):
                out[i] = ids
        return out
