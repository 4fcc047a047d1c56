"""Plain Python versions of what the operators compute, for small inputs."""

import math
import re
import zlib
from collections import Counter, defaultdict


WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def line_dedup(documents):
    """Text left and lines removed of each (key, text): every run of two elements or more that stood before, at all lengths.

    Elements are filled lines and whole stretches of blank lines.
    """
    first, gone = {}, defaultdict(set)
    for key, text in sorted(documents):
        lines, elements = (text or "").split("\n"), []
        for i, line in enumerate(lines):
            if elements and not WORD.search(line) and not WORD.search(lines[i - 1]):
                elements[-1][1] = i + 1
            else:
                elements.append([i, i + 1])
        for i in range(len(elements)):
            for j in range(i + 1, len(elements)):
                begin, end = elements[i][0], elements[j][1]
                body = tuple("\n".join(lines[a:b]) for a, b in elements[i : j + 1])
                doc, stop = first.setdefault(body, (key, end))
                if doc != key or begin >= stop:  # neither the first nor overlapping it
                    gone[key] |= set(range(begin, end))
    out = {}
    for key, text in documents:
        kept = text if not gone[key] else "\n".join(line for i, line in enumerate(text.split("\n")) if i not in gone[key])
        out[key] = (kept, len(gone[key]))
    return out


def shingles(text, width=5):
    words = WORD.findall(lower(text))
    if len(words) < width:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + width]) for i in range(len(words) - width + 1)}


def near_duplicates(documents):
    """Number of shingles and component of each (key, text)."""
    sets = {key: shingles(text) for key, text in documents}
    root = {key: key for key in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    holders = defaultdict(list)
    for key, own in sets.items():
        for one in own:
            holders[one].append(key)
    common = Counter()
    for keys in holders.values():
        common.update((a, b) for i, a in enumerate(keys) for b in keys[i + 1 :])
    for (a, b), n in common.items():
        if 100 * n >= 75 * (len(sets[a]) + len(sets[b]) - n):
            low, high = sorted((find(a), find(b)))
            root[high] = low
    return {key: (len(sets[key]), find(key)) for key in sets}


def targets(sizes, weights=(1, 2, 3), most=3):
    """Target of each source by sharing again and again until none is above its limit."""
    order = sorted((s for s in sizes if s is not None)) + [s for s in sizes if s is None]
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    total, full = sum(sizes.values()), set()
    while True:
        rest = total - sum(most * sizes[s] for s in full)
        share = sum(weight[s] for s in order if s not in full)
        found = {s: most * sizes[s] if s in full else rest * weight[s] / share for s in order}
        over = {s for s in order if s not in full and found[s] >= most * sizes[s]}
        if not over:
            return found
        full |= over


def repetition(text, symbols="#*$%&|<>", at_least=10):
    words = WORD.findall(text or "")
    n = len(words)

    def covered(size):
        seen = Counter(tuple(words[i : i + size]) for i in range(n - size + 1))
        return len({j for i in range(n - size + 1) if seen[tuple(words[i : i + size])] > 1 for j in range(i, i + size)})

    longest = 0
    for size in range(1, n):
        if len({tuple(words[i : i + size]) for i in range(n - size + 1)}) == n - size + 1:
            break
        longest = size
    lines = [line for line in (text or "").split("\n") if WORD.search(line)]
    return (n, sum(map(len, words)), sum(c in symbols for c in text or ""), len(lines) - len(set(lines)), covered(3), covered(at_least), longest)


def segment(text, vocabulary, byte_score):
    """Greatest total score over all segmentations into pieces and bytes."""
    data = text.encode()
    piece = {vocabulary.surfaces[i]: vocabulary.scores[i] for i in vocabulary.matched}
    longest = max(map(len, piece))
    best = [0.0] + [-math.inf] * len(data)
    for end in range(1, len(data) + 1):
        best[end] = best[end - 1] + byte_score
        for size in range(1, min(longest, end) + 1):
            if (score := piece.get(data[end - size : end])) is not None:
                best[end] = max(best[end], best[end - size] + score)
    return best[-1]


def language_model(documents, strength, add=0.1):
    words = {key: WORD.findall(lower(text)) + [None] for key, text in documents}
    learned = [w for key, w in words.items() if zlib.crc32(str(key).encode()) % 10]
    one = Counter(x for w in learned for x in w)
    two = Counter(p for w in learned for p in zip(["<s>"] + w[:-1], w))
    n, starts = sum(one.values()), len(learned)
    total = n + add * (len(one) + 1)
    out = {}
    for key, own in words.items():
        base = sum(math.log10((one[x] + add) / total) for x in own)
        score = sum(
            math.log10((two[h, x] + strength * (one[x] + add) / total) / ((starts if h == "<s>" else one[h]) + strength))
            for h, x in zip(["<s>"] + own[:-1], own)
        )
        out[key] = (len(own), sum(one[x] > 0 for x in own), n, base, score)
    return out


def third_order_scores(documents, strength, triple_strength, add=0.1):
    """Score of each (key, text) with two words of context."""
    words = {key: WORD.findall(lower(text)) + [None] for key, text in documents}
    learned = [w for key, w in words.items() if zlib.crc32(str(key).encode()) % 10]
    one = Counter(x for w in learned for x in w)
    two = Counter(p for w in learned for p in zip(["<s>"] + w[:-1], w))
    three = Counter(t for w in learned for t in zip(["<s>"] + w[:-2], w[:-1], w[1:]))
    total, starts = sum(one.values()) + add * (len(one) + 1), len(learned)

    def second(h, x):
        return (two[h, x] + strength * (one[x] + add) / total) / ((starts if h == "<s>" else one[h]) + strength)

    out = {}
    for key, own in words.items():
        out[key] = math.log10(second("<s>", own[0]))
        for g, h, x in zip(["<s>"] + own[:-2], own[:-1], own[1:]):
            out[key] += math.log10((three[g, h, x] + triple_strength * second(h, x)) / (two[g, h] + triple_strength))
    return out
