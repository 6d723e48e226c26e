"""Byte-level BPE ids of whole texts, as the tokenizers library gives them.

Two engines share the work, by text. The ranks file holds the same vocabulary
as the tokenizer file; its faster engine serves texts of code points up to
U+024F, where the two split words alike (tested code point by code point). Any
other text goes to the tokenizers library itself.

With ``added`` every text that holds an added token of the tokenizer file (a
special token among them) goes to the library as loaded, which gives the
token's own id. Without it such strings are ordinary text.
"""

from __future__ import annotations

import array
import base64
import json
import re
from functools import cached_property

from .common import per_worker

#: Word splitting of byte-level BPE (a fixed value of the vocabulary).
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class Encoder:
    def __init__(self, json_path: str, ranks_path: str | None, added: bool = False):
        self.json_path = json_path
        self.added = added
        self.tokens: list[str] = []
        self.fast = None
        if ranks_path:
            import tiktoken

            with open(ranks_path, "rb") as file:
                ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in file if line.strip())}
            self.fast = tiktoken.Encoding("ranks", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})
            self.beyond = re.compile("[^\x00-ɏ]")
            if added:
                with open(json_path, encoding="utf-8") as file:
                    self.tokens = [t["content"] for t in json.load(file).get("added_tokens") or ()]

    @cached_property
    def library(self):
        """Loaded only by workers that meet a text for it (about 40 MB)."""
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(self.json_path)
        tokenizer.encode_special_tokens = not self.added
        return tokenizer

    def __call__(self, text: str) -> array.array:
        """Ids as unsigned 32-bit integers."""
        if self.fast is not None and not self.beyond.search(text) and not any(t in text for t in self.tokens):
            return array.array("I", self.fast.encode_ordinary(text))
        return array.array("I", self.library.encode(text, add_special_tokens=False).ids)


def encoder(json_path: str, ranks_path: str | None, added: bool = False) -> Encoder:
    return per_worker(("bpe", json_path, ranks_path, added), lambda: Encoder(json_path, ranks_path, added))
