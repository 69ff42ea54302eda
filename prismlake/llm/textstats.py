"""Rule statistics of one text; a small helper that runs inside Arrow-batched UDFs."""

from __future__ import annotations

from collections import Counter

import numpy as np

SYMBOLS = "#*$%&|<>"
_UPPER = bytes(range(65, 91))
_LOWER = bytes(range(97, 123))
_DIGIT = bytes(range(48, 58))
_MARKS = b"!?"
_STOPS = b".,;:"
WINDOW = 5

BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
EXTRA = ("n_lines", "n_upper", "n_letters", "n_digits", "n_marks", "n_stops", "n_distinct")
NAMES = BASE + EXTRA


def repeated_words(words: list) -> int:
    """Words that lie in a WINDOW-word window found twice or more in the text."""
    grams = list(zip(*(words[i:] for i in range(WINDOW)), strict=False))
    if len(grams) == len(set(grams)):
        return 0
    seen = Counter(grams)
    covered = bytearray(len(words))
    for i, g in enumerate(grams):
        if seen[g] > 1:
            covered[i : i + WINDOW] = b"\1" * WINDOW
    return sum(covered)


def statistics(text: str | None) -> tuple[int, ...]:
    """The counts named in NAMES; a null text counts as empty."""
    text = text or ""
    raw = text.encode()
    words = raw.split()
    lines = [x for x in raw.split(b"\n") if x.strip()]
    size = len(raw)
    without = lambda drop: size - len(raw.translate(None, drop))
    upper = without(_UPPER)
    return (
        len(words),
        len(text) - without(b" \t\n\x0b\x0c\r"),
        without(SYMBOLS.encode()),
        len(lines) - len(set(lines)),
        repeated_words(words),
        len(lines),
        upper,
        upper + without(_LOWER),
        without(_DIGIT),
        without(_MARKS),
        without(_STOPS),
        len(set(words)),
    )


def ratios(s: np.ndarray) -> np.ndarray:
    """Length-shrunk ratios, one row per text: short texts are drawn towards the common values."""
    f = dict(zip(NAMES, s.astype(float).T, strict=True))
    w = f["n_words"]
    chars = f["word_chars"]
    return np.column_stack(
        [
            f["n_symbols"] / (w + 20),
            f["n_upper"] / (f["n_letters"] + 60),
            f["n_dup_lines"] / (f["n_lines"] + 4),
            f["n_repeat_words"] / (w + 20),
            f["n_digits"] / (chars + 100),
            f["n_marks"] / (w + 20),
            f["n_stops"] / (w + 20),
            (chars + 100) / (w + 20),
        ]
    )


RATIO_NAMES = ("symbols", "upper", "dup_lines", "repeats", "digits", "marks", "stops", "word_length")
