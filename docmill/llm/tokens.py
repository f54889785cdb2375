"""Token ids of the public byte-level vocabulary, at the speed that whole corpora need."""

from __future__ import annotations

import json

import numpy as np
import tiktoken
from tokenizers import Tokenizer

#: Fixed value: the pattern by which byte-level BPE splits text before its merges.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def _byte_of() -> dict[str, int]:
    """Byte-level vocabularies write printable bytes as themselves and the others as U+0100 onwards."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class ByteLevelTokenizer:
    """Ids of a byte-level BPE file as `tokenizers` gives them with add_special_tokens=False.

    Strings of special tokens inside a text get the special ids; with plain_specials they are ordinary text. The file's
    merges are in id order, so the ids follow from its vocabulary used as ranks. tiktoken does that about five times
    faster than `tokenizers`; what it can't split (texts whose runs exhaust its stack) goes to `tokenizers`, as do all
    texts if a special token takes in spaces beside it or stands for whole words only.
    """

    def __init__(self, path: str, plain_specials: bool = False):
        with open(path, encoding="utf-8") as f:
            model = json.load(f)
        added = {t["content"] for t in model["added_tokens"]}
        self.plain_specials = plain_specials
        self.simple = plain_specials or not any(t.get("lstrip") or t.get("rstrip") or t.get("single_word") for t in model["added_tokens"])
        byte = _byte_of()
        self.bytes = {i: bytes(byte[c] for c in t) for t, i in model["model"]["vocab"].items() if t not in added}
        specials = {} if plain_specials else {t["content"]: t["id"] for t in model["added_tokens"]}
        self.fast = tiktoken.Encoding("byte_level", pat_str=SPLIT, mergeable_ranks={b: i for i, b in self.bytes.items()}, special_tokens=specials)
        self.bytes |= {i: c.encode() for c, i in specials.items()}
        self.path, self.slow = path, None

    def __call__(self, text: str) -> np.ndarray:
        try:
            if self.simple:
                return self.fast.encode_to_numpy(text, allowed_special="all")
        except (ValueError, UnicodeError):
            pass
        if self.slow is None:
            self.slow = Tokenizer.from_file(self.path)
            self.slow.encode_special_tokens = self.plain_specials
        return np.array(self.slow.encode(text.encode("utf-8", "replace").decode(), add_special_tokens=False).ids, np.uint32)

    def ends_sentence(self) -> np.ndarray:
        """By id: whether a sentence may end after this token."""
        out = np.zeros(max(self.bytes) + 1, bool)
        for i, b in self.bytes.items():
            out[i] = b.rstrip(b" ")[-1:] in (b".", b"!", b"?", b"\n") or b"\n" in b
        return out
