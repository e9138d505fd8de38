"""Plain versions of the operators, and documents with every odd case."""

import math
import random
import re
from collections import Counter

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def odd_documents():
    """(doc_id, text): null, empty, blank, one word, long, copies, near copies, shared passages, repeated lines, emoji, controls."""
    rng = random.Random(5)
    vocabulary = ["".join(rng.choice("abcdefghijklmnopé") for _ in range(rng.randint(1, 9))) for _ in range(800)]
    say = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    base, passage = say(120), say(70)
    near = base.split()
    near[60] = "changed"
    texts = [None, "", " \n\t", "one", "one", "One", "a b", base, base, " ".join(near), base.upper() + " end", passage, f"{say(30)} {passage}\n{say(30)}", f"{passage} {passage}", f"{say(5)}\x0b{passage}",
             "line here\n" * 40, "x y \U0001f600 ▁ <|endoftext|> \x00 \x1f z", say(9000), "tail", *[say(rng.randint(1, 90)) for _ in range(25)]]
    return list(enumerate(texts))


def components(pairs, ids):
    parent = {i: i for i in ids}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = sorted((root(a), root(b)))
        parent[b] = a
    return {i: root(i) for i in ids}


def shingles(text, width):
    words = (text or "").encode().lower().split()
    if len(words) < width:
        return {tuple(words)} if words else set()
    return set(zip(*(words[i:] for i in range(width))))


def near_groups(docs, width, percent):
    sets = {i: shingles(t, width) for i, t in docs}
    ids = sorted(sets)
    links = [(a, b) for a in ids for b in ids if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    return {i: len(s) for i, s in sets.items()}, components(links, ids)


def kept_words(docs, window):
    words = {i: WORD.findall(t or "") for i, t in docs}
    low = {}
    for i, w in words.items():
        for k in range(len(w) - window + 1):
            x = tuple(w[k : k + window])
            low[x] = min(i, low.get(x, i))
    out = {}
    for i, w in words.items():
        gone = set()
        for k in range(len(w) - window + 1):
            if low[tuple(w[k : k + window])] < i:
                gone.update(range(k, k + window))
        out[i] = ([x for k, x in enumerate(w) if k not in gone], len(gone))
    return out


def quality_base(text):
    t = text or ""
    words = WORD.findall(t)
    seen, dup = set(), 0
    for line in t.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    windows = Counter(zip(words, words[1:], words[2:]))
    covered = {j for k in range(len(words) - 2) if windows[tuple(words[k : k + 3])] > 1 for j in (k, k + 1, k + 2)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(covered)


def secret_spans(text):
    t = text or ""
    assign = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
    found = [(m.start(), 0, m.end(), "assign") for m in assign.finditer(t) if len(m[2]) >= 6]
    found += [(m.start(), 1, m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
    found += [(m.start(), 2, m.end(), "hex") for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24]
    return [(k, a, b) for a, _, b, k in sorted(found)]


def top(vectors, queries, k):
    ints = {i: [math.floor(256 * x) for x in v] for i, v in vectors if v is not None and all(x is not None and math.isfinite(x) for x in v)}
    out = []
    for q in queries:
        if q in ints:
            scored = sorted(((-sum(a * b for a, b in zip(ints[q], v)), i) for i, v in ints.items() if i != q))[:k]
            out += [(q, n, i, -s) for n, (s, i) in enumerate(scored, 1)]
    return out


def phrase_places(text, phrases):
    lower = (text or "").translate({65 + i: 97 + i for i in range(26)})
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)
    return len(words), sorted((k, label) for p, label in phrases.items() for k in range(len(words)) if words[k : k + len(p.split())] == p.split())
