"""Tokens of texts, for search."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

import regex
from pyspark.sql import Column
from pyspark.sql import functions as F

#: The English stop words.
ENGLISH = "a an and are as at be but by for if in into is it no not of on or such that the their then there these they this to was will with".split()
#: No token is longer, whatever the options say.
CEILING = 255


@dataclass(frozen=True)
class Tokenizer:
    """Lower case, split at what is neither letter nor digit, least length, cut to the greatest length, stop words.

    A ``custom`` function from a string to tokens replaces all of that; it can't be given together with other options.
    """

    lowercase: bool = True
    min_length: int = 2
    max_length: int = 64
    stop_words: Sequence[str] | str = "none"
    custom: Callable[[str], list[str]] | None = None

    def __post_init__(self) -> None:
        if self.custom and (self.lowercase, self.min_length, self.max_length, self.stop_words) != (True, 2, 64, "none"):
            raise ValueError("a custom tokenizer takes no other options")
        if not 0 < self.min_length <= self.max_length <= CEILING:
            raise ValueError(f"token lengths go from 1 to {CEILING}")

    @property
    def stops(self) -> list[str]:
        if isinstance(self.stop_words, str):
            return {"none": [], "english": ENGLISH}[self.stop_words]
        return [w.lower() if self.lowercase else w for w in self.stop_words]

    def raw_words(self, text: Column) -> Column:
        """What lies between separators, before lengths and stop words; see ``passes`` and ``cut``."""
        return F.split(F.lower(text) if self.lowercase else text, r"[^\p{L}\p{N}]+")

    def cut(self, word: Column) -> Column:
        return F.substring(word, 1, self.max_length)

    def passes(self, word: Column) -> Column:
        long = F.length(word) >= self.min_length
        return long & ~self.cut(word).isin(self.stops) if self.stops else long

    def column(self, text: Column) -> Column:
        """The tokens in order, repeated ones too; null for a null text."""
        if self.custom:
            return F.udf(lambda t, f=self.custom: None if t is None else [x[:CEILING] for x in f(t) if isinstance(x, str) and x], "array<string>", useArrow=True)(text)
        return F.transform(F.filter(self.raw_words(text), self.passes), self.cut)

    def terms(self, text: str) -> list[str]:
        """The different tokens of a query."""
        if self.custom:
            return list(dict.fromkeys(x[:CEILING] for x in self.custom(text) if isinstance(x, str) and x))
        words = regex.split(r"[^\p{L}\p{N}]+", text.lower() if self.lowercase else text)
        return list(dict.fromkeys(w[: self.max_length] for w in words if len(w) >= self.min_length and w[: self.max_length] not in self.stops))
