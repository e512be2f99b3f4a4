"""Token ids of whole texts with a public tokenizer file, as packed little-endian integers.

Texts are cut into pieces that the tokenizer's own rules never join (white space and the word after
it), and the ids of a piece are looked up or computed once and kept in a bounded cache. Where a
tokenizer keeps runs of letters apart from other characters, a word of Latin letters is also cut off
from the comma or full stop behind it, so that it is known with and without. The few texts with white
space outside ASCII are encoded whole. Strings of special tokens are ordinary text.
"""

from __future__ import annotations

import functools
import json
import os
import re

import numpy as np

from emberlog.llm.common import WORD

# White space in front of a word, and the word; or white space at the end.
PIECE = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")
# The same, with words of letters cut off in front of common marks.
_LETTERS = r"[A-Za-z\u00C0-\u00D6\u00D8-\u00F6\u00F8-\u00FF]+(?=[,.;:!?\x20\x09-\x0D]|\Z)"
FINE_WORD = re.compile(rf"{_LETTERS}|[^\x20\x09-\x0D]+")
FINE_PIECE = re.compile(rf"[\x20\x09-\x0D]*(?:{_LETTERS}|[^\x20\x09-\x0D]+)|[\x20\x09-\x0D]+")
# Fixed value: the end of the split patterns that part runs of letters from numbers and from all other marks.
APART = r"[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
# White space that the tokenizers know besides the six ASCII characters above, and separators near it.
UNUSUAL = re.compile(r"[\x1c-\x1f\x85\xa0\u1680\u180e\u2000-\u200f\u2028-\u202f\u205f-\u2064\u3000\ufeff]")
# The cache starts anew, keeping what is used again, after so many characters.
CACHE_CHARS = 5_000_000


def public_tokenizer(name: str) -> str:
    """The path of a public tokenizer file on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


class Encoder:
    """Encodes texts to bytes of ids; ``skips_space`` tokenizers give white space no ids of its own."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 65_536 else "<u4")
        self.skips_space = not self.tokenizer.encode(" \n ", add_special_tokens=False).ids
        if self._parts_letters():
            self.pieces = FINE_WORD if self.skips_space else FINE_PIECE
        else:
            self.pieces = WORD if self.skips_space else PIECE
        alike = self._whole(["AZ", "az"])
        self.folds_case = alike[0] == alike[1]
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.chars = 0

    def _parts_letters(self) -> bool:
        """Whether the tokenizer's file says that it parts runs of letters from the marks behind them."""
        rules = json.loads(self.tokenizer.to_str())["pre_tokenizer"] or {}
        for rule in rules.get("pretokenizers", [rules]):
            if rule.get("type") == "ByteLevel" and rule.get("use_regex"):
                return True
            pattern = (rule.get("pattern") or {}).get("Regex", "") if rule.get("type") == "Split" else ""
            if pattern.endswith(APART) and rule.get("behavior") == "Removed" and rule.get("invert"):
                return True
        return False

    def _whole(self, texts: list[str]) -> list[bytes]:
        encoded = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(x.ids, dtype=self.dtype).tobytes() for x in encoded]

    def _learn(self, pieces: list[str]) -> None:
        """Puts the ids of the pieces into the young cache."""
        if self.chars > CACHE_CHARS:
            self.old, self.young, self.chars = self.young, {}, 0
        missing = []
        for x in set(pieces).difference(self.young):
            self.chars += len(x)
            if (known := self.old.get(x)) is None:
                missing.append(x)
            else:
                self.young[x] = known
        if missing:
            self.young.update(zip(missing, self._whole(missing), strict=True))

    def encode(self, text: str) -> bytes:
        """The ids of a text, packed."""
        if UNUSUAL.search(text):
            return self._whole([text])[0]
        if self.folds_case:  # ASCII letters only: other letters are folded by the tokenizer
            text = text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")
        pieces = self.pieces.findall(text)
        parts = []
        # Slices bound what one very long text puts into the cache.
        for i in range(0, len(pieces), 50_000):
            part = pieces[i : i + 50_000]
            try:
                parts.append(b"".join(map(self.young.__getitem__, part)))
            except KeyError:
                self._learn(part)
                parts.append(b"".join(map(self.young.__getitem__, part)))
        return b"".join(parts)


@functools.lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One encoder for each worker process and file."""
    return Encoder(path)
