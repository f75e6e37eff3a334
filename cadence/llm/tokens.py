"""Token ids of whole texts by a public tokenizer, each distinct word encoded once.

The tokenizer's pattern never matches across a single space that stands between
two characters that are no white space: that space always opens the next match. So a text may be cut before each such space, and
the ids of the whole text are those of its parts end to end. Parts repeat, so
each part is encoded once per worker and kept (``KEEP`` parts at most, then the
table starts anew). New parts of a batch of texts are encoded together, as one
text, and told apart by the tokens that open with a space. Texts with other
runs of white space at such a cut, or with the string of a token that the
tokenizer's file adds, are encoded whole.

``encoder`` gives the library's own ids: the string of a special token in a
text becomes that token.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

import numpy as np

#: Parts kept by a worker.
KEEP = 1_000_000
#: A space next to other white space: no place to cut, so the whole text goes to the tokenizer.
_NOT_PLAIN = re.compile(r" (?:\s|(?<=\s\s))")


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class Encoder:
    """Ids as little-endian unsigned 32-bit bytes."""

    def __init__(self, path: str, *, special_as_text: bool = True):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.tok.encode_special_tokens = special_as_text  # are their strings in a text ordinary text?
        self.added = [x.content for x in self.tok.get_added_tokens_decoder().values()]
        opens = np.zeros(max(self.tok.get_vocab().values()) + 1, bool)
        for piece, i in self.tok.get_vocab().items():
            opens[i] = piece.startswith("Ġ")  # how the byte-level alphabet writes a space
        self.opens = opens
        self.inner: dict[str, bytes] = {}  # by the part without its leading space
        self.head: dict[str, bytes] = {}  # parts that open a text

    def forget(self) -> None:
        """Give back the tables of parts."""
        self.inner, self.head = {}, {}

    def _ids(self, texts: Sequence[str]) -> list[np.ndarray]:
        return [np.array(e.ids, "<u4") for e in self.tok.encode_batch_fast(list(texts), add_special_tokens=False)]

    def _learn(self, parts: list[str]) -> None:
        """Encode parts that follow a space, many as one text."""
        for i in range(0, len(parts), 5000):
            some = parts[i : i + 5000]
            ids = self._ids([" " + " ".join(some)])[0]
            at = np.flatnonzero(self.opens[ids])
            if len(at) == len(some):
                for word, a, b in zip(some, at.tolist(), [*at[1:].tolist(), len(ids)], strict=True):
                    self.inner[word] = ids[a:b].tobytes()
            else:  # a part holds a token that opens with a space elsewhere
                for word, one in zip(some, self._ids([" " + x for x in some]), strict=True):
                    self.inner[word] = one.tobytes()

    def encode(self, texts: Sequence[str], keep: int = KEEP) -> list[bytes]:
        """Ids of each text; the table of parts starts anew when it has more than ``keep``."""
        if len(self.inner) > keep:
            self.forget()
        cut: list[list[str] | None] = []
        new: dict[str, None] = {}
        heads: dict[str, None] = {}
        whole = []
        inner = self.inner
        for i, t in enumerate(texts):
            if _NOT_PLAIN.search(t) or t.startswith(" ") or t.endswith(" ") or any(x in t for x in self.added):
                cut.append(None)
                whole.append(i)
                continue
            parts = t.split(" ")
            cut.append(parts)
            if parts[0] not in self.head:
                heads[parts[0]] = None
            for p in set(parts[1:]).difference(inner):
                new[p] = None
        if new:
            self._learn(list(new))
        if heads:
            for h, ids in zip(heads, self._ids(list(heads)), strict=True):
                self.head[h] = ids.tobytes()
        rest = dict(zip(whole, self._ids([texts[i] for i in whole]), strict=True)) if whole else {}
        get = inner.__getitem__
        return [
            rest[i].tobytes() if parts is None else self.head[parts[0]] + b"".join(map(get, parts[1:]))
            for i, parts in enumerate(cut)
        ]


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """This worker's encoder for a tokenizer file, with the ids that the library gives unless told otherwise."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path, special_as_text=False)
    return _ENCODERS[path]
