"""Plain Python versions of the operators' contracts, for small inputs."""

import hashlib
import re

WORD = re.compile("[^\x20\x09-\x0d]+")


def removed_bytes(rows, window=50):
    """{doc_id: (n_bytes, n_removed, n_spans, sha256)} of op6's contract; ids are unique."""
    first = {}
    texts = {d: (t or "").encode() for d, t in rows}
    for d in sorted(texts):
        b = texts[d]
        for i in range(len(b) - window + 1):
            first.setdefault(b[i : i + window], d)
    out = {}
    for d, b in texts.items():
        gone = bytearray(len(b))
        for i in range(len(b) - window + 1):
            if first[b[i : i + window]] < d:
                gone[i : i + window] = b"\x01" * window
        spans = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        kept = bytes(x for x, g in zip(b, gone) if not g)
        out[d] = (len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest())
    return out


def removed_words(rows, window=20):
    """{doc_id: (n_words, n_removed, sha256)} of op9's contract; ids are unique."""
    first = {}
    texts = {d: WORD.findall(t or "") for d, t in rows}
    for d in sorted(texts):
        w = texts[d]
        for i in range(len(w) - window + 1):
            first.setdefault(tuple(w[i : i + window]), (d, i))
    out = {}
    for d, w in texts.items():
        gone = bytearray(len(w))
        for i in range(len(w) - window + 1):
            if first[tuple(w[i : i + window])] < (d, i):
                gone[i : i + window] = b"\x01" * window
        kept = " ".join(x for x, g in zip(w, gone) if not g)
        out[d] = (len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest())
    return out
