"""Statistics of texts in NumPy: every character of a block of texts is classified once, all counts are sums over its classes."""

from __future__ import annotations

import hashlib
import re
import unicodedata
from functools import cache

import numpy as np

STATISTICS = [
    "word_count", "mean_word_length", "symbol_ratio", "digit_ratio", "punctuated_lines", "common_words", "line_count", "line_length",
    "listed_share", "gapped_share", "single_share", "numeric_share", "capital_share", "plain_share", "broken_share", "vowel_ratio", "longest_word",
]

#: Characters that are worked on at a time (a longer text is a block of its own).
BLOCK = 200_000

_WORD = re.compile(r"\w")

# Classes of characters, as bits.
LETTER, UPPER, DIGIT, BLANK, BREAK, VOWEL, SYMBOL = 1, 2, 4, 8, 16, 32, 64
SENTENCE_END, CLOSER, INNER, ODD, JOINED, RULE, BRACE, BULLET = 1, 2, 4, 8, 16, 32, 64, 128


def _kind(c: str) -> int:
    k = unicodedata.category(c)
    if k[0] in "LM":
        return LETTER | (UPPER if k == "Lu" else 0)
    return DIGIT if k[0] == "N" else BLANK if k[0] == "Z" or c.isspace() else SYMBOL


@cache
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For every code point of the basic plane its class, its punctuation class and its lower case."""
    n = 1 << 16
    kind, mark, lower = np.array([_kind(chr(i)) for i in range(n)], np.uint8), np.zeros(n, np.uint8), np.arange(n, dtype=np.uint32)
    for i in np.flatnonzero(kind & UPPER):
        low = chr(i).lower()
        lower[i] = ord(low) if len(low) == 1 else i
    for c in "\n\r\v\f\x85\u2028\u2029":
        kind[ord(c)] = BLANK | BREAK
    for c in "aeiouyäöüàâéèêëîïôùûœøåæ":
        for x in (c, c.upper()):
            kind[ord(x)] |= VOWEL
    for bit, chars in ((SENTENCE_END, ".!?:…"), (CLOSER, "'\"”’»)]–—"), (INNER, "'’-"), (ODD, "<>{}|\\^~$&#%*@=+"), (JOINED, "<>{}|\\^~$&#%*@=+!?;,[]/()\"_"), (RULE, "-=_~+"), (BRACE, "<>{}"), (BULLET, "-*•·–—>")):
        for c in chars:
            mark[ord(c)] |= bit
    return kind, mark, lower


def _classes(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    kinds, marks, lowers = _tables()
    basic = np.minimum(codes, 0xFFFF).astype(np.uint16)
    kind, mark, lower = kinds[basic], marks[basic], lowers[basic]
    far = np.flatnonzero(codes > 0xFFFF)
    if len(far):
        chars, which = np.unique(codes[far], return_inverse=True)
        kind[far], lower[far] = np.array([_kind(chr(c)) for c in chars], np.uint8)[which], codes[far]
    return kind, mark, lower


def content_hash(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


@cache
def _powers(length: int) -> np.ndarray:
    return np.random.default_rng(20).integers(1, 2**63, size=length, dtype=np.uint64) | np.uint64(1)


class CommonWords:
    """A set of words of two letters and more (single letters are marks of lists, too), looked up by hashes of blocks of words."""

    def __init__(self, words: list[str]):
        plain = sorted({w.lower() for w in words if w and len(w) > 1})
        self.longest = max(map(len, plain), default=0)
        codes = [np.frombuffer(w.encode("utf-32-le"), np.uint32) for w in plain]
        with np.errstate(over="ignore"):
            self.hashes = np.sort(np.array([(c * _powers(self.longest)[: len(c)]).sum(dtype=np.uint64) for c in codes], dtype=np.uint64))

    def among(self, codes: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Which of the words at start to end (in lower-case ``codes``) are in the set."""
        out = np.zeros(len(start), bool)
        short = np.flatnonzero(end - start <= self.longest)
        if not len(short) or not len(self.hashes):
            return out
        length = (end - start)[short]
        first = np.concatenate([[0], np.cumsum(length)[:-1]])
        place = np.arange(length.sum()) - np.repeat(first, length)
        with np.errstate(over="ignore"):
            h = np.add.reduceat(codes[np.repeat(start[short], length) + place] * _powers(self.longest)[place], first)
        at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
        out[short] = self.hashes[at] == h
        return out


def _runs(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begin and end of the runs of true values."""
    edge = np.diff(mask.astype(np.int8), prepend=0, append=0)
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def _block(texts: list[str], common: CommonWords) -> np.ndarray:
    """The statistics of texts that have a visible character each, a row for each text."""
    # Every text ends in a line break of its own, so neither words nor lines run on into the next text.
    codes = np.frombuffer("".join(t + "\n" for t in texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    ends = np.cumsum([len(t) + 1 for t in texts])
    (kind, mark, lower), n, most = _classes(codes), len(texts), len(codes) - 1
    letter, digit, blank = (kind & LETTER) > 0, (kind & DIGIT) > 0, (kind & BLANK) > 0

    def owners(place: np.ndarray) -> np.ndarray:
        return np.searchsorted(ends, place, side="right")

    def add(values: np.ndarray, owner: np.ndarray) -> np.ndarray:
        return np.bincount(owner, weights=values, minlength=n)

    def within(mask: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """How many characters of ``mask`` (few of all) are in each of the ranges, which rise and do not meet."""
        at = np.flatnonzero(mask)
        k = np.searchsorted(begin, at, side="right") - 1
        return np.bincount(k[(k >= 0) & (at < end[np.maximum(k, 0)])], minlength=len(begin))

    starts = np.concatenate([[0], ends[:-1]])
    # Words.
    w0, w1 = _runs(~blank)
    l0, l1 = _runs(letter)
    owner, of_letters = owners(w0), owners(l0)
    words = np.bincount(owner, minlength=n).astype(float)
    per = np.maximum(words, 1)
    length = w1 - w0
    solid, letters = np.maximum(add(length, owner), 1), np.maximum(add(l1 - l0, of_letters), 1)
    digits = within(digit, w0, w1)
    f, e = np.searchsorted(l0, w0), np.searchsorted(l1, w1, side="right") - 1
    has_letter = f <= e
    first, last = (np.where(has_letter, x[np.clip(k, 0, max(len(x) - 1, 0))] + d, w0) if len(x) else w0 for x, k, d in ((l0, f, 0), (l1, e, -1)))
    capital = has_letter & ((kind[first] & UPPER) > 0)
    # Between its first and its last letter a plain word has letters, apostrophes and hyphens only, around them no digits or signs.
    odd = (mark & ODD) > 0
    strange = within(~letter & ~blank & ((mark & INNER) == 0), first, np.maximum(last, first)) + digits + within(odd, w0, w1)
    joint = np.flatnonzero((mark & JOINED) > 0)
    a, z = np.maximum(joint - 1, 0), np.minimum(joint + 1, most)
    broken = joint[odd[joint] | ((letter[a] | digit[a]) & letter[z])]
    # Lines that are not blank; a text's own end is a break.
    end = np.flatnonzero((kind & BREAK) > 0)
    begin = np.concatenate([[0], end[:-1] + 1])
    k = np.searchsorted(w0, begin)
    full = (k < len(w0)) & (w0[np.minimum(k, len(w0) - 1)] < end)
    begin, end, head = begin[full], end[full], w0[k[full]]
    of, size = owners(begin), end - begin
    lines = np.bincount(of, minlength=n).astype(float)
    text = np.maximum(add(size, of), 1)
    last_seen = w1[np.searchsorted(w1, end, side="right") - 1] - 1
    tail = last_seen
    while (move := ((mark[tail] & CLOSER) > 0) & (tail > head)).any():
        tail = tail - move
    punctuated = (mark[tail] & SENTENCE_END) > 0
    order = np.lexsort((size, of))
    middle = size[order][(np.concatenate([[0], np.cumsum(lines)[:-1]]) + lines // 2).astype(int)]
    # Lines that begin like items of a list.
    step = lambda p, k: np.minimum(p + k, most)
    is_one = lambda p, chars: np.isin(codes[p], [ord(c) for c in chars])
    h = np.where(codes[head] == ord("("), step(head, 1), head)
    figures, romans = np.zeros(len(h), int), np.zeros(len(h), int)
    for k in range(5):
        figures += (figures == k) & digit[step(h, k)]
        romans += (romans == k) & is_one(step(head, k), "IVX")
    p = step(h, figures)
    numbered = (figures > 0) & (figures < 5) & blank[np.where(is_one(p, ".):"), step(p, 1), p)]
    lettered = letter[h] & is_one(step(h, 1), ".)") & blank[step(h, 2)]
    roman = (romans > 0) & is_one(step(head, romans), ".") & blank[step(head, romans + 1)]
    listed = (((mark[head] & BULLET) > 0) & blank[step(head, 1)]) | numbered | lettered | roman
    # Lines that are parted like rows of a table.
    space, rule = codes == 32, (mark & RULE) > 0
    gap = np.flatnonzero(space[2:] & space[1:-1] & space[:-2]) + 2
    line = np.searchsorted(begin, gap, side="right") - 1
    parted = np.zeros(len(begin), bool)
    parted[line[(line >= 0) & (gap > head[np.maximum(line, 0)]) & (gap < last_seen[np.maximum(line, 0)])]] = True
    comma = np.flatnonzero(codes == ord(","))
    comma = comma[digit[np.maximum(comma - 1, 0)] & (digit[step(comma, 1)] | (space[step(comma, 1)] & digit[step(comma, 2)]))]
    series = np.zeros(len(codes), bool)
    series[comma] = True
    dot = codes == ord(".")
    once = codes == 9
    once[3:] |= dot[3:] & dot[2:-1] & dot[1:-2] & dot[:-3]
    once[2:] |= rule[2:] & rule[1:-1] & rule[:-2]
    gapped = parted | (within(once, begin, end) > 0)
    for mask in (codes == ord("|"), codes == ord(";"), series, (mark & BRACE) > 0):
        gapped |= within(mask, begin, end) > 1
    return np.stack([
        words, solid / per, np.bincount(owners(np.flatnonzero((kind & SYMBOL) > 0)), minlength=n) / solid, add(digits, owner) / solid, add(punctuated, of) / np.maximum(lines, 1),
        add(common.among(lower, l0, l1), of_letters) / per, lines, middle, add(size * listed, of) / text, add(size * gapped, of) / text,
        add(length == 1, owner) / per, add(digits > 0, owner) / per, add(capital, owner) / per, add(has_letter & (strange == 0), owner) / per, np.bincount(owners(broken), minlength=n) / per,
        np.add.reduceat((kind & VOWEL) > 0, starts, dtype=np.int64) / letters, np.maximum.reduceat(length, np.searchsorted(owner, np.arange(n))),
    ], axis=1).astype(float)


def visible(text: str | None) -> bool:
    """Whether a text has a character that is neither white space nor a control or format character."""
    return bool(text) and (_WORD.search(text) is not None or any(unicodedata.category(c)[0] not in "ZC" for c in text))


def statistics(texts: list[str | None], common: CommonWords) -> np.ndarray:
    """A row of ``STATISTICS`` for each text, NaN for a null, empty or blank one."""
    kinds = _tables()[0]
    out = np.full((len(texts), len(STATISTICS)), np.nan)
    block: list[int] = []
    size = 0

    def flush() -> None:
        nonlocal block, size
        if block:
            out[block] = _block([clean[i] for i in block], common)
        block, size = [], 0

    clean = [t.replace("\xad", "") if t else t for t in texts]
    for i, t in enumerate(clean):
        if not visible(t):
            continue
        if size + len(t) > BLOCK:
            flush()
        block.append(i)
        size += len(t) + 1
    flush()
    return out
