"""Brute-force versions that several tests use."""

import hashlib

from glossweave.llm.decontaminate import words


def leaks(docs, items, window=10):
    """What op9 returns per document, by looking for every window everywhere."""
    windows = {}
    for item, text in items:
        w = words((text or "").encode())
        for i in range(max(1, len(w) - window + 1) if w else 0):
            windows.setdefault(tuple(w[i : i + window]), set()).add(item)
    sizes = {len(w) for w in windows}
    out = {}
    for doc, text in docs:
        w = words((text or "").encode())
        hit, found = set(), set()
        for k in sizes:
            for i in range(len(w) - k + 1):
                if got := windows.get(tuple(w[i : i + k])):
                    hit.update(range(i, i + k))
                    found |= got
        names = ",".join(sorted(map(str, found)))
        out[doc] = (len(w), len(hit), len(found), hashlib.sha256(names.encode()).hexdigest(), bool(hit))
    return out
