"""The counts of one essay, for a whole Arrow batch of texts at a time.

The same rules, words and tags as the expressions of ``functions.text`` (which
the annotation queries return); every distinct token is tagged once per Python
worker and counted with its repeats.  Letters are those of Python's Unicode
tables; the JVM's know fewer of the most recently assigned characters.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

from scorewright.functions import fixed
from scorewright.functions import text as T

#: What ``count`` returns, in order: the squares of the word counts, then every predictor but the similarity.
NAMES = ["squares", *(p for p in fixed.PREDICTORS if p != "similarity")]
TYPE = "struct<" + ", ".join(f"{n}: bigint" for n in NAMES) + ">"
DOT_TYPE = TYPE[:-1] + ", dot: bigint>"
#: Characters of the texts whose tokens are held together.
BLOCK = 1_000_000
#: Tagged tokens that a worker keeps, at most, of at most so many characters.
MEMO, LONGEST = 300_000, 40

#: No letter is beyond.
LAST = 0x40000

_ASTRAL = re.compile("[\U00010000-\U0010ffff]").search
# letters and numbers are what Python calls alphanumeric; white space is ASCII's, as in the JVM's regexes
_WORDS, _TOKENS = re.compile(r"\w+").findall, re.compile(r"\w+|[^ \t\n\x0b\f\r\w]").findall
_NUMBER = re.compile(fixed.NUMBER_PATTERN).fullmatch
_TAGS = [tag for _, tag in fixed.POS_FEATURES]
_OTHER = len(_TAGS)
_CLOSED = {w: tag for tag, words in reversed(fixed.POS_WORDS) for w in words}
_SUFFIXES = [(tag, tuple(ends)) for tag, ends in fixed.POS_SUFFIXES]
_STOP = frozenset(fixed.STOP_WORDS)
#: Literals of which every match of a rule holds one.
_LITERALS = T.RULE_LITERALS | {"SPACE_BEFORE_PUNCT": [" " + c for c in ",.;:!?"], "MISSING_SPACE_AFTER_COMMA": [","]}


@lru_cache(maxsize=None)
def _class(start: str, end: int) -> str:
    """The characters below ``end`` whose category starts with ``start``, as the inside of a regex class."""
    if end == 0x80:
        return {"Lu": "A-Z", "Ll": "a-z", "L": "A-Za-z"}[start]
    runs: list[list[int]] = []
    for c in range(min(end, LAST)):
        if unicodedata.category(chr(c)).startswith(start):
            if runs and runs[-1][1] == c - 1:
                runs[-1][1] = c
            else:
                runs.append([c, c])
    return "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in runs)


@lru_cache(maxsize=None)
def _patterns(end: int):
    """Grammar rules and entities, for texts of characters below ``end``."""
    upper, lower, letter = (_class(c, end) for c in ("Lu", "Ll", "L"))
    rules = []
    for name, pattern, new in fixed.GRAMMAR_RULES:
        for java, own in ((r"\p{Lu}", f"[{upper}]"), (r"[^\p{L}]", f"[^{letter}]"), (r"\p{L}", f"[{letter}]")):
            pattern = pattern.replace(java, own)
        rules.append((re.compile(pattern), re.sub(r"\$(\d)", r"\\\1", new), _LITERALS.get(name, [""])))
    # a mark or a run of capitalised words; the class in front lets the search skip other characters
    entity = re.compile(rf"[@{upper}](?:(?<=@)[A-Z]+[0-9]*|(?<!@)[{lower}]+(?:[ \t]+[{upper}][{lower}]+)+)")
    return rules, entity


def _is_word(token: str) -> bool:
    return len(token) > 1 or token.isalnum() or token == "_"


def tag(token: str) -> str:
    """The tag of one token, as ``functions.text.pos_tag``."""
    first = token[0]
    if "0" <= first <= "9" and _NUMBER(token):
        return "NUM"
    low = token.lower()
    if low in _CLOSED:
        return _CLOSED[low]
    if not _is_word(token):
        return "PUNCT"
    if first != first.lower():
        return "PROPN"
    if first != first.upper():
        for name, ends in _SUFFIXES:
            if token.endswith(ends):
                return name
        return "NOUN"
    return "X"


class _Known(dict):
    """token -> (number of its tag and whether it is no stop word, the lower-cased word or "" for a mark); emptied when full."""

    def __missing__(self, token: str) -> tuple[int, str]:
        name = tag(token)
        code = 2 * (_TAGS.index(name) if name in _TAGS else _OTHER) + (token not in _STOP)
        got = code, token.lower() if _is_word(token) else ""
        if len(self) >= MEMO:
            self.clear()
        if len(token) <= LONGEST:
            self[token] = got
        return got


_KNOWN = _Known()


def _end(text: str) -> int:
    """A bound on the characters of a text: classes of few characters are faster."""
    return 0x80 if text.isascii() else 0x110000 if _ASTRAL(text) else 0x10000


def corrected(text: str) -> tuple[int, str]:
    """Matches of the grammar rules in ``text``, and the text after replacing them rule by rule."""
    total, out = 0, text
    for pattern, new, literals in _patterns(_end(text))[0]:
        if out is text:
            if any(x in text for x in literals):
                changed, n = pattern.subn(new, text)
                total, out = total + n, changed if n else text
        else:
            if any(x in text for x in literals):
                total += len(pattern.findall(text))
            if any(x in out for x in literals):
                out = pattern.sub(new, out)
    return total, out


def _count_some(texts: list[str], refs: list[dict[str, int]]) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of ``NAMES`` for some texts, a row each, and the dot products of their word counts with ``refs``.

    Tokens are numbered once for all texts; what is counted per text are pairs of numbers."""
    flat, sizes, own, odd, width = [], [], [], {}, 2 * _OTHER + 2
    for i, text in enumerate(texts):
        corrections, t = corrected(text)
        tokens = _TOKENS(t)
        flat += tokens
        sizes.append(len(tokens))
        # corrections change no word but "teh"; two letters are lower-cased by what stands around them or into two words
        if "teh" in text or "\u03a3" in text or "\u0130" in text:
            odd[i] = Counter(_WORDS(text.lower()))
        marks = [t.count(mark) for _, mark in fixed.PLACEHOLDERS] if "@" in t else [0] * len(fixed.PLACEHOLDERS)
        own.append((corrections, t.count("\n") + 1, len(_patterns(_end(t))[1].findall(t)), t.count(","), t.count("?"),
                    t.count("!"), t.count('"') + t.count("'"), *marks))
    n, named = len(texts), pa.array(flat, pa.string()).dictionary_encode()
    lows: dict[str, int] = {"": 0}
    known = [_KNOWN[token] for token in named.dictionary.to_pylist()]
    code = np.array([c for c, _ in known], np.int64)
    low = np.array([lows.setdefault(w, len(lows)) for _, w in known], np.int64)
    text, token = np.repeat(np.arange(n), sizes), named.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    pair, times = np.unique(text * len(known) + token, return_counts=True)
    text, token = np.divmod(pair, max(len(known), 1))
    by_code = _sums(text * width + code[token], times, n * width).reshape(n, width)
    unique = np.bincount(text, minlength=n)
    # words: tokens that differ by case are one, marks (0) are none
    is_word = low[token] > 0
    pair, at = np.unique(text[is_word] * len(lows) + low[token[is_word]], return_inverse=True)
    times = _sums(at, times[is_word], len(pair))
    text, word = np.divmod(pair, len(lows))
    squares = _sums(text, times * times, n)
    # few reference essays: each is looked up once for all words of these texts
    dots = np.zeros(n, np.int64)
    for ref in {id(r): r for r in refs if r}.values():
        with_it = np.array([r is ref for r in refs])[text]
        weight = np.zeros(len(lows), np.int64)
        for w in lows.keys() & ref.keys():
            weight[lows[w]] = ref[w]
        dots += _sums(text[with_it], times[with_it] * weight[word[with_it]], n)
    for i, words in odd.items():
        squares[i] = sum(k * k for k in words.values())
        dots[i] = sum(k * refs[i].get(w, 0) for w, k in words.items())
    own = np.array(own, np.int64).reshape(n, -1)
    tagged = by_code[:, 0::2] + by_code[:, 1::2]
    return np.column_stack([squares, own[:, 0], by_code.sum(1), unique, by_code[:, 1::2].sum(1), own[:, 1:], tagged[:, :_OTHER]]), dots


def _sums(at: np.ndarray, what: np.ndarray, size: int) -> np.ndarray:
    """Sums of the whole numbers ``what`` by ``at`` (exact: as doubles they stay far below 2^53)."""
    return np.bincount(at, what, size).astype(np.int64)


def _blocks(texts: list[str]) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about ``BLOCK`` characters."""
    lo, held = 0, 0
    for i, text in enumerate(texts):
        held += len(text)
        if held >= BLOCK or i + 1 == len(texts):
            yield lo, i + 1
            lo, held = i + 1, 0


def _structs(texts: pa.Array, refs: list[dict[str, int]] | None) -> pa.Array:
    there = np.flatnonzero(texts.is_valid().to_numpy(zero_copy_only=False))
    names = NAMES + ["dot"] * (refs is not None)
    rows, mask = np.zeros((len(texts), len(names)), np.int64), np.ones(len(texts), bool)
    mask[there] = False
    some = texts.drop_null().to_pylist()
    given = [{}] * len(some) if refs is None else [refs[i] for i in there]
    for lo, hi in _blocks(some):
        counts, dots = _count_some(some[lo:hi], given[lo:hi])
        rows[there[lo:hi], :len(NAMES)] = counts
        if refs is not None:
            rows[there[lo:hi], -1] = dots
    return pa.StructArray.from_arrays([pa.array(rows[:, i], pa.int64(), mask=mask) for i in range(len(names))], names=names)


def count_batch(texts: pa.Array) -> pa.Array:
    """``NAMES`` of every text; a null text has nulls."""
    return _structs(texts, None)


def counter(references: dict[str, dict[str, int]]) -> Callable[[pa.Array, pa.Array], pa.Array]:
    """``count_batch`` that also gives ``dot``: the product with the word counts of the reference of the text's topic."""
    def count_batch(texts: pa.Array, topics: pa.Array) -> pa.Array:
        none: dict[str, int] = {}
        return _structs(texts, [references.get(t, none) for t in topics.to_pylist()])
    return count_batch
