"""What the lines of texts are made of: links, markup, tags, code and plain words, for whole Arrow columns at once.

Words are those of the wide alphabet. Two words are neighbours if one follows the other on a line. What stands between them
is hard if it ties them as code or data does (brackets, operators, an unspaced colon or a dot between letters), else soft:
blanks, commas, quotes, dashes, and separators with blanks around them.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa

from millrace.llm.words import Words, words_of


def _table(characters: bytes) -> np.ndarray:
    table = np.zeros(256, bool)
    table[list(characters)] = True
    return table


_BLANK = _table(b" \t\r\n\f\v")
_HARD = _table(b"(){}[]=<>+&%^~\\@")
_DIGIT = _table(b"0123456789")
_WORD = _table(b"0123456789_ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz" + bytes(range(0x80, 0x100)))
_CUTS = _table(b" \t\r\n\f\v\"'<>()[]{}`,|;")
_QUOTES = _table(b"\"'`")


def _hashes(*words: str) -> np.ndarray:
    return np.sort(words_of(pa.array([w.encode() for w in words], pa.binary()), wide=True).hashes)


#: Labels of product tags, and words that begin a line of an import list.
_LABELS = _hashes("tag", "tags", "keyword", "keywords")
_IMPORTS = _hashes("import", "include", "require", "use", "using", "from", "package")
_WWW = _hashes("www")


class Lines(NamedTuple):
    """line: the line of each word, numbered over all texts; text: of each line. Per word: link, markup, number (begins with a digit).

    pairs: the first of every two neighbours that are plain (neither link nor markup), whether they are tied hard, and whether
    more than blanks parts them. Per line: links, tags, keyed (has a quoted key), imports.
    """

    words: Words
    line: np.ndarray
    text: np.ndarray
    link: np.ndarray
    markup: np.ndarray
    number: np.ndarray
    pairs: np.ndarray
    hard: np.ndarray
    parted: np.ndarray
    links: np.ndarray
    tags: np.ndarray
    keyed: np.ndarray
    imports: np.ndarray


def _count(flags: np.ndarray) -> np.ndarray:
    """How many flags are set before each place, and behind the last."""
    out = np.zeros(len(flags) + 1, np.int32 if len(flags) < 2**31 else np.int64)
    np.cumsum(flags, out=out[1:], dtype=out.dtype)
    return out


def line_of(w: Words) -> np.ndarray:
    """The line of each word, numbered from 0 over all texts; lines without a word have no number."""
    breaks = _count((w.raw == 10) | (w.raw == 13))[w.starts]
    fresh = np.ones(len(w.starts), bool)
    fresh[1:] = (breaks[1:] != breaks[:-1]) | (w.text[1:] != w.text[:-1])
    return np.cumsum(fresh) - 1


def neighbours(line: np.ndarray) -> np.ndarray:
    """The first of every two words that follow each other on a line."""
    return np.flatnonzero(line[1:] == line[:-1])


def _isin(hashes: np.ndarray, known: np.ndarray) -> np.ndarray:
    at = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
    return known[at] == hashes


def _links(w: Words, line: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word stands in a link, word begins a link, word stands before a link's scheme).

    A link is a piece without blanks, quotes and brackets that has a scheme, or begins with two slashes and a host, or, if
    it doesn't stand alone in quotes, as the name of a package does, with a host and a path.
    """
    raw, starts, ends, n = w.raw, w.starts, w.ends, len(w.starts)
    cuts = _count(_CUTS[raw])
    piece = cuts[starts]
    first = np.ones(n, bool)
    first[1:] = (piece[1:] != piece[:-1]) | (line[1:] != line[:-1])
    begin = np.flatnonzero(first)
    number = np.cumsum(first) - 1
    same = np.zeros(n, bool)
    same[:-1] = ~first[1:]
    padded = np.concatenate([raw, np.zeros(4, np.uint8)])
    a, b, c = padded[ends], padded[ends + 1], padded[ends + 2]
    gap = np.zeros(n, np.int64)
    gap[:-1] = starts[1:] - ends[:-1]
    scheme = same & (gap == 3) & (a == 0x3A) & (b == 0x2F) & (c == 0x2F)
    joint = same & (gap == 1) & ((a == 0x2E) | (a == 0x2D))
    dot = joint & (a == 0x2E)
    # of each piece the first gap that isn't inside its host, and whether there is a dot before it
    place = np.where(joint, n, np.arange(n))
    stop = np.minimum.reduceat(place, begin)
    dots = _count(dot)
    host = dots[stop] > dots[begin]
    host &= ~_DIGIT[raw[starts[stop]]] & (ends[stop] - starts[stop] >= 2)
    path = same[stop] & (a[stop] == 0x2F) & (gap[stop] == 1)
    front = np.concatenate([np.zeros(2, np.uint8), raw])
    before, before2 = front[starts[begin] + 1], front[starts[begin]]
    edge = w.bounds[w.text[begin]]
    inner = starts[begin] > edge
    slashes = inner & (before == 0x2F) & (before2 == 0x2F)
    last = np.append(begin[1:], n) - 1
    opens = ~inner | _CUTS[before]
    alone = inner & _QUOTES[before] & _QUOTES[a[last]]
    schemes = _count(scheme)
    upto = np.append(begin[1:], n)
    has_scheme = schemes[upto] > schemes[begin]
    is_link = has_scheme | host & (slashes | opens & (path & ~alone | _isin(w.hashes[begin], _WWW)))
    link = is_link[number]
    # "url=http://...": words before the scheme's own
    ahead = link & has_scheme[number] & (schemes[np.arange(n)] == schemes[begin][number]) & ~scheme
    return link & ~ahead, first & link, ahead


def _markup(w: Words) -> np.ndarray:
    """Whether words stand in a tag of markup: from ``<`` and a letter, slash or exclamation mark to ``>`` on the same line."""
    raw = w.raw
    out = np.zeros(len(w.starts), bool)
    left, right = np.flatnonzero(raw == 0x3C), np.flatnonzero((raw == 0x3E) | (raw == 10))
    if not len(left) or not len(right):
        return out
    after = np.append(raw, 0)[left + 1]
    opens = (after == 0x2F) | (after == 0x21) | (_WORD[after] & ~_DIGIT[after])
    at = np.searchsorted(right, left)
    close = right[np.minimum(at, len(right) - 1)]
    upto = np.append(left[1:], len(raw))
    ok = opens & (at < len(right)) & (close < upto) & (raw[close] == 0x3E)
    # tags don't overlap: a word is inside if the last one that opens before it closes behind it
    left, close = left[ok], close[ok]
    if not len(left):
        return out
    at = np.searchsorted(left, w.starts) - 1
    return (at >= 0) & (close[np.maximum(at, 0)] > w.starts)


def _hard(w: Words) -> np.ndarray:
    """Whether each byte ties the words beside it."""
    raw, out = np.concatenate([[np.uint8(32)], w.raw, [np.uint8(32)]]), _HARD[w.raw]
    letter = _WORD & ~_DIGIT
    at = np.flatnonzero(w.raw == 0x3A)
    spaced = lambda x: _BLANK[x] | (x == 0x3A)
    out[at] = ~(spaced(raw[at]) & spaced(raw[at + 2]))
    at = np.flatnonzero(w.raw == 0x2E)
    out[at] = letter[raw[at]] & letter[raw[at + 2]]
    return out


def lines_of(column: pa.Array) -> Lines:
    w = words_of(column, wide=True)
    n = len(w.starts)
    if not n:
        none, no = np.zeros(0, np.int64), np.zeros(0, bool)
        return Lines(w, none, none, no, no, no, none, no, no, none, no, no, no)
    raw = w.raw
    line = line_of(w)
    begin = np.flatnonzero(np.append(True, line[1:] != line[:-1]))
    count = len(begin)
    link, first, ahead = _links(w, line)
    markup = (_markup(w) | ahead) & ~link
    padded, front = np.append(raw, np.zeros(3, np.uint8)), np.concatenate([np.zeros(2, np.uint8), raw])
    # "[/url]" behind a link's text
    markup |= (front[w.starts + 1] == 0x2F) & (front[w.starts] == 0x5B) & (padded[w.ends] == 0x5D)
    number = _DIGIT[raw[w.starts]]
    at = neighbours(line)
    plain = ~(link | markup)
    at = at[plain[at] & plain[at + 1]]
    ties = _count(_hard(w))
    hard = ties[w.starts[at + 1]] > ties[w.ends[at]]
    marks = _count(~_BLANK[raw])
    parted = marks[w.starts[at + 1]] > marks[w.ends[at]]
    hashed = plain & (front[w.starts + 1] == 0x23)
    label = _isin(w.hashes, _LABELS)
    colon = (padded[w.ends] == 0x3A) | _BLANK[padded[w.ends]] & (padded[w.ends + 1] == 0x3A)
    lead = np.flatnonzero(plain)
    own = line[lead]
    lead = lead[np.append(True, own[1:] != own[:-1])] if len(lead) else lead
    tags = 2 * np.bincount(line, hashed, count) > np.bincount(line, plain, count)
    tags[line[lead[label[lead] & colon[lead]]]] = True
    tags[line[markup & label & _QUOTES[front[w.starts + 1]] & _QUOTES[padded[w.ends]]]] = True
    imports = np.zeros(count, bool)
    imports[line[lead[_isin(w.hashes[lead], _IMPORTS)]]] = True
    keys = _count(_QUOTES[raw] & (np.append(raw[1:], np.uint8(0)) == 0x3A))
    until = np.append(w.starts[begin[1:]], len(raw))
    keyed = keys[until] > keys[w.starts[begin]]
    return Lines(w, line, w.text[begin], link, markup, number, at, hard, parted, np.bincount(line, first, count).astype(np.int64), tags, keyed, imports)
