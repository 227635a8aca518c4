"""Token ids of whole texts with a public tokenizer file, memoised by white-space chunk.

Every tokenizer file used here drops or isolates white space before it merges, so a text's
ids are those of its chunks between spaces and line ends, one after another. Each worker
keeps a bounded memo of chunks' ids; a chunk that it lacks goes through the library.
`whole_text=True` skips the memo for tokenizers without that property.
"""

from __future__ import annotations

import os
import re
from array import array

import numpy as np

from .common import held

#: Bytes that a worker's memo holds about, and the longest chunk that it keeps.
MEMO_BYTES, LONGEST = 160 << 20, 64
# The printable characters that byte-level tokenizers write for the 256 bytes.
_SHOWN = [*range(33, 127), *range(161, 173), *range(174, 256)]
_BYTES = {b: chr(b) for b in _SHOWN} | {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in _SHOWN)}
#: Words of ASCII and Latin-1 letters (already composed, lowered one to one), with up to four marks behind them.
_WORD = re.compile("([A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+)([-!\"#$%&()*+,./:;=?@^_~]{0,4})").fullmatch


class _Marks(dict):
    """Ids of runs of marks, each encoded once while there are at most 20,000."""

    def __init__(self, tokenizer):
        self.tokenizer = tokenizer
        self[""] = b""

    def __missing__(self, run):
        if len(self) > 20_000:
            self.clear()
            self[""] = b""
        self[run] = out = np.array(self.tokenizer.encode(run, add_special_tokens=False).ids, "<u4").tobytes()
        return out


class Encoder:
    def __init__(self, path: str, whole_text: bool = False):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.memo, self.whole_text = Tokenizer.from_file(path), _Memo(self.chunk), whole_text
        self.model = self.tokenizer.model
        self.marks = _Marks(self.tokenizer)
        # The short way for such words needs a tokenizer that lowers them and merges their bytes.
        probe = ["Abcde", "zebra", "In.", "QUARTZ!", "\u00c9cole", "gr\u00fc\u00dfe,", "end.###", "a-=&"]
        self.short_way = all(self._short(w) == self.tokenizer.encode(w, add_special_tokens=False).ids for w in probe)
        self.special = [x.content.lower() for x in self.tokenizer.get_added_tokens_decoder().values()]

    def _lowered(self, t: str) -> str:
        """t in lower case where the tokenizer would lower it letter by letter anyway, so that its chunks are fewer."""
        try:
            t.encode("latin-1")
        except UnicodeEncodeError:
            return t
        low = t.lower()
        return t if any(x in low for x in self.special) else low

    def _short(self, w: str) -> list[int]:
        core, mark = _WORD(w).groups()
        return np.frombuffer(self._core(core.lower()) + self.marks[mark], "<u4").tolist()

    def _core(self, w: str) -> bytes:
        """Ids of a lowered word of Latin-1 letters, by merges alone."""
        if not w.isascii():
            w = "".join(map(_BYTES.__getitem__, w.encode()))
        return array("I", [x.id for x in self.model.tokenize(w)]).tobytes()

    def chunk(self, w: str) -> bytes:
        """Ids of a chunk between spaces."""
        if self.short_way and (m := _WORD(w)):
            core, mark = m.groups()
            if mark or not core.islower():
                return self.memo[core.lower()] + self.marks[mark]
            return self._core(core)
        return np.array(self.tokenizer.encode(w, add_special_tokens=False).ids, "<u4").tobytes()

    def ids(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text, without special tokens of its own."""
        if self.whole_text:
            return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        get = self.memo.__getitem__
        if self.short_way:
            texts = map(self._lowered, texts)
        return [b"".join(map(get, t.replace("\n", " ").split(" "))) for t in texts]


class _Memo(dict):
    """Chunks' ids. Past half of MEMO_BYTES they become the old generation; what is met again moves on."""

    def __init__(self, chunk):
        self.chunk, self.old, self.size = chunk, {}, 0
        self[""] = b""

    def __missing__(self, w):
        if (got := self.old.get(w)) is None:
            got = self.chunk(w)
        if len(w) <= LONGEST:
            self.size += 2 * len(w) + len(got) + 150  # about what an entry takes
            if self.size > MEMO_BYTES // 2:
                self.old, self.size = self.copy(), 0
                self.clear()
                self[""] = b""
            self[w] = got
        return got


def encoder(path: str, whole_text: bool = False) -> Encoder:
    """One encoder per worker process."""
    return held(("encoder", path, whole_text), lambda: Encoder(path, whole_text))


def batches(texts, size: int = 1 << 20):
    """Index ranges of about `size` characters each, whatever the longest text."""
    lo, n = 0, 0
    for i, t in enumerate(texts):
        if n and n + len(t) > size:
            yield lo, i
            lo, n = i, 0
        n += len(t)
    if lo < len(texts):
        yield lo, len(texts)
