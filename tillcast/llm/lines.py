"""Counts per line and per document, taken over whole runs of documents at once."""

from __future__ import annotations

import numpy as np

from .common import SPACE, mixed, span_hashes, word_hashes

SYMBOLS = b"#*$%&|<>"
FEATURES = ["bias", "letters", "upper", "digits", "symbols", "exclaims", "bars", "stops", "ends with a stop",
            "log words", "few words", "mean word length", "same word again", "copy of an earlier line", "foreign bytes"]


def byte_class(chars: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[np.frombuffer(chars, np.uint8)] = True
    return out


UPPER = byte_class(bytes(range(65, 91)))
LETTER = UPPER | byte_class(bytes(range(97, 123))) | byte_class(bytes(range(128, 256)))
STOPS = byte_class(b".?!")


def counts_between(mask: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """True bytes of each span [start, end)."""
    sums = np.zeros(len(mask) + 1, np.int64)
    np.cumsum(mask, out=sums[1:])
    return sums[ends] - sums[starts]


def line_spans(data: np.ndarray, ends: np.ndarray):
    """\\n-split lines of each document (an empty one has one empty line):
    (document, start, end) per line, in order."""
    breaks = np.flatnonzero(data == 10)
    # a document's end sorts before a line break at the same byte, which belongs to the next document
    at = np.concatenate([ends * 2, breaks * 2 + 1])
    at.sort()
    stop, is_break = at >> 1, (at & 1).astype(bool)
    start = np.zeros(len(stop), np.int64)
    start[1:] = stop[:-1] + is_break[:-1]
    doc = np.zeros(len(stop), np.int64)
    doc[1:] = np.cumsum(~is_break[:-1])
    return doc, start, stop


def repeated_words(words: np.ndarray, doc: np.ndarray, n_docs: int, window: int = 8) -> np.ndarray:
    """Per document: its words that lie in a window of words found twice or more in it, by 64-bit hashes."""
    if len(words) < window:
        return np.zeros(n_docs, np.int64)
    n = len(words) - window + 1
    sums = np.zeros(n, np.uint64)
    for k in range(window):
        sums += words[k:k + n] * np.uint64(2 * k + 0x9E3779B97F4A7C15)
    at = np.flatnonzero(doc[:n] == doc[window - 1:])
    keys = mixed(mixed(sums[at]) + doc[at].astype(np.uint64) * np.uint64(0xD1342543DE82EF95))
    order = np.argsort(keys)
    same = keys[order][1:] == keys[order][:-1]
    twice = np.zeros(len(at), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    covered = np.zeros(len(words) + 1, np.int64)
    np.add.at(covered, at[twice], 1)
    np.add.at(covered, at[twice] + window, -1)
    return np.bincount(doc[np.cumsum(covered[:-1]) > 0], minlength=n_docs)


def measure(data: np.ndarray, ends: np.ndarray) -> dict:
    """Counts of each document and line of a run of documents (see common.chunks)."""
    n = len(ends)
    starts = np.append(0, ends[:-1])
    words, wdoc, wstart, wlen = word_hashes(data, ends)
    doc, a, b = line_spans(data, ends)
    size = b - a
    share = np.maximum(size, 1)
    wline = np.searchsorted(a, wstart, "right") - 1
    per_line = np.bincount(wline, minlength=len(a))
    again = np.zeros(len(words), bool)
    again[1:] = (words[1:] == words[:-1]) & (wline[1:] == wline[:-1])
    # equal lines of a document have equal (document, bytes)
    full = size > 0
    begin = np.cumsum(size[full]) - size[full]
    line_key = mixed(span_hashes(data[data != 10], begin, size[full]) + doc[full].astype(np.uint64) * np.uint64(0xD1342543DE82EF95))
    copy = np.zeros(len(a), bool)
    _, first = np.unique(line_key, return_index=True)
    later = np.ones(len(line_key), bool)
    later[first] = False
    copy[np.flatnonzero(full)[later]] = True
    copy &= per_line > 0
    letters, upper = counts_between(LETTER[data], a, b), counts_between(UPPER[data], a, b)
    symbols = byte_class(SYMBOLS)[data]
    last = np.where(size > 0, data[np.maximum(b - 1, 0)], 32) if len(data) else np.full(len(a), 32)
    x = np.stack([np.ones(len(a)), letters / share, upper / np.maximum(letters, 1),
                  counts_between(byte_class(b"0123456789")[data], a, b) / share, counts_between(symbols, a, b) / share,
                  counts_between(data == 33, a, b) / share, counts_between(data == 124, a, b) / share,
                  counts_between(STOPS[data], a, b) / share, STOPS[last], np.log1p(per_line), per_line < 5,
                  np.bincount(wline, wlen, minlength=len(a)) / np.maximum(per_line, 1),
                  np.bincount(wline, again, minlength=len(a)) / np.maximum(per_line, 1), copy,
                  counts_between(data > 127, a, b) / share], axis=1)
    space = SPACE[data]
    return {"n_words": np.bincount(wdoc, minlength=n), "word_chars": counts_between(~space & ((data & 0xC0) != 0x80), starts, ends),
            "n_symbols": counts_between(symbols, starts, ends), "n_dup_lines": np.bincount(doc[copy], minlength=n),
            "n_repeat_words": repeated_words(words, wdoc, n), "line_doc": doc, "line_words": per_line, "x": x,
            "words": words, "word_doc": wdoc}
