"""Plain versions that several tests use."""

import re


def plain_sets(texts, n, percent):
    """The smallest doc_id of each component of similar texts, by comparing all pairs."""
    sets = {}
    for doc, text in texts.items():
        words = [w for w in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if w]
        sets[doc] = frozenset(tuple(words[k : k + n]) for k in range(len(words) - n + 1)) if len(words) >= n else frozenset([tuple(words)] if words else [])
    top = {doc: doc for doc in sets}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for a in sets:
        for b in sets:
            same = len(sets[a] & sets[b])
            if a < b and sets[a] and sets[b] and 100 * same >= percent * (len(sets[a]) + len(sets[b]) - same):
                low, high = sorted((find(a), find(b)))
                top[high] = low
    return {doc for doc in sets if find(doc) == doc}
