"""Parameters of the operators."""

from __future__ import annotations

from dataclasses import dataclass
from enum import Enum

from lexarium.functions.text import PUNCTUATION


class TextSplit(Enum):
    """How a text block is cut into the documents of a corpus of its own."""

    SENTENCES = "sentences"
    PARAGRAPHS = "paragraphs"
    PHRASES = "phrases"


class TfIdfInput(Enum):
    """UNPROCESSED: every row is a document to clean. PROCESSED: every row is a document of words apart by blanks.

    TEXT_BLOCK: every row is a corpus of its own, cut by a TextSplit.
    """

    UNPROCESSED = "unprocessed"
    PROCESSED = "processed"
    TEXT_BLOCK = "text_block"


@dataclass(frozen=True)
class TokenizerParams:
    """Stop words are matched against the lower-cased token; punctuation None is the default table."""

    stop_words: tuple[str, ...] = ()
    punctuation: tuple[str, ...] | None = None

    def __post_init__(self):
        object.__setattr__(self, "stop_words", tuple(self.stop_words))
        object.__setattr__(self, "punctuation", PUNCTUATION if self.punctuation is None else tuple(self.punctuation))


def _at_least_one(n: int | None, what: str) -> None:
    if n is not None and n < 1:
        raise ValueError(f"{what} must be 1 or more")


@dataclass(frozen=True)
class TfIdfParams(TokenizerParams):
    kind: TfIdfInput = TfIdfInput.UNPROCESSED
    split: TextSplit = TextSplit.SENTENCES


@dataclass(frozen=True)
class RakeParams(TokenizerParams):
    phrase_length: int | None = None

    def __post_init__(self):
        super().__post_init__()
        _at_least_one(self.phrase_length, "phrase_length")


@dataclass(frozen=True)
class TextRankParams(TokenizerParams):
    """max_iterations bounds the steps on request; a document that needs more is reported as not converged."""

    window_size: int = 2
    damping: float = 0.85
    tolerance: float = 0.00005
    phrase_length: int | None = None
    max_iterations: int | None = None

    def __post_init__(self):
        super().__post_init__()
        if self.max_iterations is None and not (0 <= self.damping < 1 and self.tolerance > 0):
            raise ValueError("a damping outside 0 to 1, or a tolerance of 0, needs max_iterations")
        _at_least_one(self.phrase_length, "phrase_length")


@dataclass(frozen=True)
class YakeParams(TokenizerParams):
    threshold: float = 0.85
    ngram: int = 3
    window_size: int = 2

    def __post_init__(self):
        super().__post_init__()
        _at_least_one(self.ngram, "ngram")


__all__ = ["RakeParams", "TextRankParams", "TextSplit", "TfIdfInput", "TfIdfParams", "TokenizerParams", "YakeParams"]
