"""Splitting texts into pre-tokens as a byte-level BPE tokenizer of the tokenizers library does."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass

import regex

# The split pattern of the vocabulary, see public_tokenizers.PATTERN.
PATTERN = (
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
)
# Code points whose classes are the same in both libraries. Texts with other ones, such as
# letters of a newer Unicode version, are split by the tokenizers library itself.
COMMON = r"[^\x00-ԯ‐-‧‰-⁞ぁ-ゖァ-ヺ一-龥가-힣]"


@dataclass(frozen=True)
class Vocabulary:
    """A tokenizer file's text and its parts; small, fixed data that is broadcast."""

    text: str
    special: tuple[tuple[str, int], ...]  # added tokens, found in texts before the split

    @classmethod
    def load(cls, path: str) -> Vocabulary:
        with open(path, encoding="utf-8") as file:
            text = file.read()
        parts = json.loads(text)
        split = parts["pre_tokenizer"]
        if split["type"] != "ByteLevel" or split["add_prefix_space"] or not split.get("use_regex", True):
            raise ValueError("a byte-level vocabulary without prefix space is needed")
        if parts["normalizer"] or parts["model"]["type"] != "BPE":
            raise ValueError("a BPE vocabulary without normalizer is needed")
        plain = all(
            not t["single_word"] and not t["lstrip"] and not t["rstrip"] for t in parts["added_tokens"]
        )
        if not plain:
            raise ValueError("added tokens that take blanks along are not known here")
        return cls(text, tuple((t["content"], t["id"]) for t in parts["added_tokens"]))

    def tokenizer(self):
        from tokenizers import Tokenizer

        made = Tokenizer.from_str(self.text)
        made.no_truncation()
        made.no_padding()
        return made

    def specials(self) -> dict[str, int]:
        return dict(self.special)

    def splitter(self) -> Callable[[str], list[str]]:
        """A function from text to its pieces: added tokens and pre-tokens, in order."""
        pattern, uncommon = regex.compile(PATTERN), regex.compile(COMMON)
        specials = self.specials()
        own = self.tokenizer().pre_tokenizer
        marks = "|".join(regex.escape(s) for s in sorted(specials, key=len, reverse=True))
        at_marks = regex.compile(f"({marks})") if marks else None

        def ordinary(text: str) -> list[str]:
            if uncommon.search(text):
                return [text[a:b] for _, (a, b) in own.pre_tokenize_str(text)]
            return pattern.findall(text)

        def split(text: str) -> list[str]:
            if at_marks is None or not any(s in text for s in specials):
                return ordinary(text)
            out: list[str] = []
            for part in at_marks.split(text):
                out += [part] if part in specials else ordinary(part)
            return out

        return split
