"""Ids of a public byte-level BPE tokenizer, with a bounded memo of the ids of space-separated chunks.

The tokenizer's pattern never joins characters over a single space: a space before a word belongs to the word. A text
without runs of white space around a space is therefore the concatenation of its chunks' ids, and most chunks recur.
Unseen chunks are encoded together; texts with other runs or special tokens are encoded whole.
"""

from __future__ import annotations

import base64
import json
import os
import re
from functools import cached_property, lru_cache

import tiktoken
from tokenizers import Tokenizer

#: Runs in which a space does not simply lead a word.
_RUN = re.compile(r"\s \s|\s \Z")
#: Chunks kept in a worker's memo before it starts anew.
MEMO = 200_000
#: The pre-token pattern that byte-level BPE vocabularies of this family share (fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def default_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Encoder:
    """``ids(text)`` equals ``Tokenizer.encode(text, add_special_tokens=False).ids``; null is the empty text.

    ``path`` is the tokenizer's json. Where the same vocabulary lies beside it as ranks, with the suffix ``.tiktoken``, and
    the tokenizer is a plain byte-level one without normalizer, most texts are encoded from chunks; otherwise each whole.
    """

    def __init__(self, path: str):
        self.path = path
        with open(path, encoding="utf-8") as text:
            made = json.load(text)
        ranks_path = path.removesuffix(".json") + ".tiktoken"
        before = made.get("pre_tokenizer") or {}
        plain = before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space") and not made.get("normalizer")
        self.special = tuple(t["content"] for t in made.get("added_tokens") or ())
        self.chunked = bool(plain and os.path.exists(ranks_path))
        self.memo: dict[str, tuple[int, ...]] = {}
        if self.chunked:
            with open(ranks_path, "rb") as lines:
                ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
            self.plain = tiktoken.Encoding("plain", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
            (self.newline,) = self.plain("\n")

    @cached_property
    def tokenizer(self) -> Tokenizer:
        """Loaded for the first text that is encoded whole."""
        tokenizer = Tokenizer.from_file(self.path)
        tokenizer.no_truncation()
        tokenizer.no_padding()
        return tokenizer

    def whole(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def _learn(self, chunks: list[str]) -> None:
        memo = self.memo
        missing = {c for c in chunks if c not in memo}
        if len(memo) + len(missing) > MEMO:
            memo.clear()
            missing = set(chunks)
        together = [c for c in missing if c and c.isprintable()]
        for c in missing.difference(together):
            memo[c] = tuple(self.plain(" " + c))
        at, ids = 0, self.plain("\n".join([" " + c for c in together]))
        for c in together:
            try:
                end = ids.index(self.newline, at)
            except ValueError:
                end = len(ids)
            memo[c] = tuple(ids[at:end])
            at = end + 1

    def parts(self, text: str | None) -> list[tuple[int, ...] | list[int]]:
        """Consecutive runs of ids that make up the text's ids."""
        if not text:
            return []
        if not self.chunked or any(s in text for s in self.special) or _RUN.search(text):
            return [self.whole(text)]
        first, *chunks = text.split(" ")
        memo = self.memo
        try:
            out = [memo[c] for c in chunks]
        except KeyError:
            self._learn(chunks)
            out = [memo[c] for c in chunks]
        return [self.plain(first), *out]

    def ids(self, text: str | None) -> list[int]:
        out: list[int] = []
        for part in self.parts(text):
            out += part
        return out

    def count(self, text: str | None) -> int:
        return sum(map(len, self.parts(text)))


@lru_cache(1)
def encoder(path: str) -> Encoder:
    """One encoder for each worker process and path."""
    return Encoder(path)
