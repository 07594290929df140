"""A byte-level BPE tokenizer read from a tokenizers file, for fast encoding.

The file's vocabulary and merges become ranked byte strings for the tiktoken
library, which gives the tokenizers library's ids several times faster. That
holds where ids rise in order of the merges and texts are only split by the
byte-level pattern; both are checked on load. The strings of special tokens in
a text are ordinary text.
"""

from __future__ import annotations

import json
from functools import lru_cache

import numpy as np

# Fixed value of the format: how a byte-level tokenizer cuts a text before merging.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_of_character() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for.

    Visible Latin-1 characters stand for themselves, the other bytes are numbered from U+0100 on."""
    visible = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = sorted(set(range(256)).difference(visible))
    return {chr(b): b for b in visible} | {chr(0x100 + i): b for i, b in enumerate(hidden)}


class ByteTokenizer:
    def __init__(self, path: str):
        import tiktoken

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, cut = spec["model"], spec["pre_tokenizer"] or {}
        byte_level = model["type"] == "BPE" and cut.get("type") == "ByteLevel" and cut.get("use_regex", True)
        if not byte_level or cut["add_prefix_space"] or spec["normalizer"]:
            raise ValueError("only byte-level BPE without a normaliser is known")
        of = byte_of_character()
        special = {t["content"] for t in spec["added_tokens"]}
        ranks = {bytes(of[c] for c in t): i for t, i in model["vocab"].items() if t not in special}
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        made = [model["vocab"][a + b] for a, b in merges]
        if any(x >= y for x, y in zip(made, made[1:])) or b"" in ranks:
            raise ValueError("ids must rise in order of the merges")
        self.encoding = tiktoken.Encoding(path, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.tokens = [b""] * (max(ranks.values()) + 1)
        for t, i in ranks.items():
            self.tokens[i] = t
        self.lengths = np.array([len(t) for t in self.tokens], np.int64)

    def encode(self, text: str) -> np.ndarray:
        """The ids as 32-bit numbers."""
        return self.encoding.encode_to_numpy(text, allowed_special=set(), disallowed_special=())


@lru_cache(maxsize=4)
def load(path: str) -> ByteTokenizer:
    return ByteTokenizer(path)
