"""Token ids of a byte-level BPE vocabulary, by the tokenizers library, once per distinct piece of text.

A byte-level pre-tokenizer never puts a space inside a token that starts with something else, and never joins a letter with
ASCII punctuation other than the apostrophe. So a text may be cut before each space that stands alone between two other characters,
and a word from the punctuation that ends it, without changing its ids; each distinct piece is encoded once and then looked up. New
pieces are encoded many to a string, and told apart by the bytes that each id stands for. The end of a line that stands alone between two
other characters is a token of its own, so what is left and right of it are two pieces.
"""

from __future__ import annotations

import os
import re
from array import array
from collections.abc import Iterable, Iterator
from itertools import islice

from matchloom.llm.common import kept

PUNCTUATION = "".join(c for c in map(chr, range(33, 127)) if not c.isalnum() and c != "'")
#: Entries that a worker keeps of pieces, and of what ends them. Beyond it the third of the pieces that was met first stays, among which the frequent ones are.
KEPT_PIECES, KEPT_ENDS = 1_380_000, 200_000

#: New pieces of one string, which costs less than as many strings.
JOINED = 500
_OTHER_SPACE, _ALONE = re.compile(r"[^\S \n]"), re.compile(r"(?<=\S) (?=\S)")
_OTHER_ASCII = "\t\v\f\r\x1c\x1d\x1e\x1f"
#: Several lines, each with a word in it, and no other space.
_LINES = re.compile(r"\S+(?:\n\S+)+")

_encoders: dict[str, Encoder] = kept({})


def _words(text: str) -> list[str]:
    """Cut at each space that stands alone between two other characters."""
    if "  " in text or " \n" in text or "\n " in text or text[:1] == " " or text[-1:] == " " or (any(x in text for x in _OTHER_ASCII) if text.isascii() else _OTHER_SPACE.search(text)):
        return _ALONE.split(text)
    return text.split(" ")


class Encoder:
    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab()
        self.lengths = array("I", bytes(4 * (max(vocabulary.values()) + 1)))
        for token, i in vocabulary.items():
            self.lengths[i] = len(token)  # in the byte alphabet, one character a byte
        self.pieces: dict[str, bytes] = {}  # words that follow a space, and what is left of them without their ends
        self.lines: dict[str, bytes] = {}  # the same of parts of words of several lines, each under itself and the space or end of a line before it
        self.ends: dict[str, bytes] = {}
        self.made: list[str] = []  # words in pieces that are made of others and hardly come again; they go with the next texts, as they would take much of the room

    @classmethod
    def of(cls, path: str) -> Encoder:
        """One for each worker process and vocabulary."""
        return _encoders.get(path) or _encoders.setdefault(path, cls(path))

    def _encode_new(self, new: set[str]) -> list[str]:
        """new: words that follow a space, without it. Returns those that need not stay: of several lines, or made of a piece that is new itself."""
        broken = {word: word.split("\n") for word in new if "\n" in word and _LINES.fullmatch(word)}
        made = self._encode_pieces(new.difference(broken), self.pieces, " ")
        if broken:
            pieces, lines = self.pieces, self.lines
            for before, some in ((" ", {x[0] for x in broken.values()}.difference(pieces)), ("\n", {y for x in broken.values() for y in x[1:]})):
                some = {x for x in some if before + x not in lines}
                found = {x: pieces[x] for y in some if (x := y.rstrip(PUNCTUATION)) in pieces} if before == " " else {}
                self._encode_pieces(some, found, before)
                lines.update((before + x, found[x]) for x in some)
            for word, (first, *rest) in broken.items():
                pieces[word] = (pieces.get(first) or lines[" " + first]) + b"".join([lines["\n" + x] for x in rest])
        return made + list(broken)

    def _encode_pieces(self, new: set[str], pieces: dict[str, bytes], before: str) -> list[str]:
        """new: words that follow a space or the end of a line (before), without it. Returns those that are made of a piece that is new itself."""
        ends, ended, made = self.ends, [], []
        need = set(filter(str.isalpha, new))
        for word in new - need:
            core = word.rstrip(PUNCTUATION)
            if core == word or not core.isalpha():
                need.add(word)
                continue
            ended.append((word, core))
            if core not in pieces:
                need.add(core)
                made.append(word)
        need = list(need)
        pieces.update(zip(need, self._encode_joined(need, before)))
        for word, core in ended:
            rest = word[len(core) :]
            if rest not in ends:
                ends[rest] = self._encode([rest])[0]
            pieces[word] = pieces[core] + ends[rest]
        return made

    def _encode_joined(self, texts: list[str], before: str) -> list[bytes]:
        """Of texts with a space or the end of a line before each, none of which holds two next to each other."""
        import numpy as np

        out: list[bytes] = []
        lengths = np.frombuffer(self.lengths, np.uint32)
        groups = [texts[i : i + JOINED] for i in range(0, len(texts), JOINED)]
        for at in range(0, len(groups), 100):
            some = groups[at : at + 100]
            for group, found in zip(some, self.tokenizer.encode_batch_fast([before + before.join(g) for g in some], add_special_tokens=False)):
                ids = np.array(found.ids, "<u4")
                ends = np.cumsum(lengths[ids])
                want = np.cumsum(np.fromiter(map(len, map(str.encode, group)), np.int64, len(group)) + 1)
                cut = np.searchsorted(ends, want)
                if len(ids) == 0 or cut[-1] >= len(ids) or (ends[cut] != want).any():  # a piece that isn't one here: each by itself
                    out += self._encode([before + x for x in group])
                    continue
                data, stops = ids.tobytes(), (4 * (cut + 1)).tolist()
                out += [data[a:b] for a, b in zip([0, *stops], stops)]
        return out

    def _encode(self, texts: list[str]) -> list[bytes]:
        out: list[bytes] = []
        for i in range(0, len(texts), 20_000):
            out += [array("I", x.ids).tobytes() for x in self.tokenizer.encode_batch_fast(texts[i : i + 20_000], add_special_tokens=False)]
        return out

    def encode(self, texts: Iterable[str | None], batch: int = 256) -> Iterator[bytes]:
        """Little-endian unsigned 32-bit ids of each text; null is empty."""
        texts = iter(texts)
        while some := list(islice(texts, batch)):
            if len(self.pieces) + len(self.lines) > KEPT_PIECES:
                self.pieces = dict(islice(self.pieces.items(), KEPT_PIECES // 3))
                self.lines.clear()
            if len(self.ends) > KEPT_ENDS:
                self.ends.clear()
            for word in self.made:
                self.pieces.pop(word, None)
            words = [_words(text or "") for text in some]
            firsts = self._encode([x.pop(0) for x in words])  # what stands before the first space has none itself
            self.made = self._encode_new(set().union(*words).difference(self.pieces))
            find = self.pieces.__getitem__
            for first, ws in zip(firsts, words):
                yield first + b"".join(map(find, ws))
