"""Statistics of one whole text, for the quality classifier and the quality rules.

All counts are over the UTF-8 bytes with C-speed primitives or numpy; nothing is cut off.
A null text counts as empty.
"""

from __future__ import annotations

import numpy as np

from .common import BLANKS

_LETTERS_UP = bytes(range(65, 91))
_LETTERS_LOW = bytes(range(97, 123))
_DIGITS = b"0123456789"
_SYMBOLS = b"#*$%&|<>"
_ENDS = b".!?"
_PUNCT = b",;:.!?'\"()-"
_DROP = {k: bytes(v) for k, v in {"blank": BLANKS, "up": _LETTERS_UP, "low": _LETTERS_LOW, "digit": _DIGITS, "sym": _SYMBOLS, "punct": _PUNCT, "bang": b"!", "pipe": b"|", "end": b"."}.items()}

#: Frequent function words of English, French, German and Spanish.
FUNCTION_WORDS = frozenset(
    "the of and to in is that it for on as with be by are this or an at from "
    "le la les de des du et en un une que qui dans est pour par sur au il elle pas "
    "der die das und zu den mit von ist nicht ein eine auf sich des im dem es "
    "el los las del y se su por con para una lo al como más".encode().split()
)

#: Names of ``stats``' values, in order.
NAMES = ("n_bytes", "n_chars", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_distinct", "n_function", "n_up", "n_low", "n_digits", "n_punct", "n_bang", "n_pipe", "n_dots", "max_line", "n_long_words", "n_capital", "n_line_ends", "top_count")


def repeat_words(ids: np.ndarray, width: int = 5) -> int:
    """Words inside a window of ``width`` words that is found twice or more, the first included.

    Windows get exact ranks by doubling (pairs, then pairs of pairs), so no hash can collide.
    """
    n = len(ids) - width + 1
    if n < 2:
        return 0
    rank, have = ids.astype(np.int64), 1
    while have < width:
        step = min(have, width - have)
        a, b = rank[: len(rank) - step], rank[step:]
        _, rank = np.unique(a * (int(b.max()) + 1) + b, return_inverse=True)
        have += step
    again = np.bincount(rank)[rank] > 1
    if not again.any():
        return 0
    edge = np.zeros(len(ids) + 1, np.int32)
    edge[:n] += again
    edge[width:] -= again  # n + width == len(edge)
    return int((np.cumsum(edge[:-1]) > 0).sum())


def stats(text: str | None) -> list[int]:
    """The counts of NAMES."""
    text = text or ""
    raw = text.encode("utf-8", "surrogatepass")
    size = len(raw)
    gone = {k: size - len(raw.translate(None, v)) for k, v in _DROP.items()}
    words = raw.split()
    index: dict[bytes, int] = {}
    put = index.setdefault
    ids = np.array([put(w, len(index)) for w in words], np.int64)
    lines = raw.split(b"\n")
    full = [x for x in lines if x.strip()]
    counts = np.bincount(ids) if len(ids) else np.zeros(1, np.int64)
    fn = sum(int(counts[index[w]]) for w in FUNCTION_WORDS & index.keys())
    cap = sum(int(counts[i]) for w, i in index.items() if 65 <= w[0] <= 90)
    long_words = sum(int(counts[i]) for w, i in index.items() if len(w) > 20)
    ends = sum(x.rstrip()[-1:] in b".!?" for x in full)
    return [
        size, len(text), len(words), len(text) - gone["blank"], gone["sym"], len(full) - len(set(full)),
        repeat_words(ids), len(full), len(index), fn, gone["up"], gone["low"], gone["digit"], gone["punct"],
        gone["bang"], gone["pipe"], gone["end"], max(map(len, lines)), long_words, cap, ends, int(counts.max()),
    ]


def stats_table(texts: list[str | None]) -> np.ndarray:
    """One row of ``stats`` for each text (float64)."""
    return np.array([stats(t) for t in texts], np.float64).reshape(len(texts), len(NAMES))


def features(table: np.ndarray) -> np.ndarray:
    """Ratios that do not depend on the text's length, beside its logarithms. Finite for empty texts."""
    c = dict(zip(NAMES, table.T, strict=True))
    words, size, lines = np.maximum(c["n_words"], 1), np.maximum(c["n_bytes"], 1), np.maximum(c["n_lines"], 1)
    letters = np.maximum(c["n_up"] + c["n_low"], 1)
    return np.column_stack([
        np.log1p(c["n_words"]), np.log1p(c["n_lines"]), c["word_chars"] / words, c["n_symbols"] / words,
        c["n_dup_lines"] / lines, c["n_repeat_words"] / words, c["n_distinct"] / words, c["n_function"] / words,
        c["n_up"] / letters, c["n_digits"] / size, c["n_punct"] / words, c["n_bang"] / words, c["n_pipe"] / words,
        c["n_dots"] / words, c["n_words"] / lines, np.log1p(c["max_line"]), c["n_long_words"] / words,
        c["n_capital"] / words, c["n_line_ends"] / lines, c["top_count"] / words,
    ])


FEATURES = ("log_words", "log_lines", "word_len", "symbols", "dup_lines", "repeats", "distinct", "function_words", "upper", "digits", "punct", "bangs", "pipes", "dots", "words_per_line", "log_longest_line", "long_words", "capitals", "line_ends", "top_word")
