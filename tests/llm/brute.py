"""Plain Python versions of what the operators compute."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")

#: Rows that every operator has to take: nulls, empty and long texts, ties, repeats.
EDGES = [
    (1, "one two three four five six seven eight nine ten", "en", "a", 49),
    (2, "one two three four five six seven eight nine ten", "en", "a", 49),
    (2, "one two three four five six seven eight nine ten", "en", "a", 49),
    (3, "  one two\tthree four five six seven eight nine\n ten", "en", None, 50),
    (4, None, None, None, None),
    (5, "", "en", "b", 0),
    (6, " \t\n", "en", "b", 3),
    (None, "Licensed under the Apache License; CC-BY 4.0\nSPDX-License-Identifier: MIT OR (GPL-2.0-only AND BSD-3-Clause)", "en", "b", 7),
    (None, None, "en", "c", None),
    (8, "word " * 30000, "en", "c", 150000),
    (9, "mail bob.7@mail1.example.com ip 10.0.0.255 and 10.0.0.256 card 4111 1111 1111 1111 tel +1 (269) 555-3296.", "en", "c", 99),
    (10, "é" * 5000 + " ünï 中文 " * 50, "fr", "é", 5450),
    (11, "x" * 20000, "en", "b", 20000),
    (12, "MIT License gnu general public license gnu general public license", "en", "b", 5),
] + [(100 + i, f"a b c d e f g h i j k l m n o p q r s t u v w x y z {i // 2}", "en", "a", 60) for i in range(8)]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that the operators use inside.
CLASHES = ("row_", "key", "path", "shard", "slot", "size", "bucket", "words", "id_", "text_hash",
           "digest", "score", "recorded", "row_key", "block", "pass", "group_key")


def words(text):
    return WORD.findall(text or "")


def shingle_set(text, width=5):
    w = words(text)
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1)))


def near_classes(rows, least=0.8):
    """{row index: (class, links, text links)} by comparing all pairs of sets."""
    sets = defaultdict(list)
    for k, (_, text) in enumerate(rows):
        if s := shingle_set(text):
            sets[s].append(k)
    keys = list(sets)
    postings = defaultdict(list)
    for i, s in enumerate(keys):
        for t in s:
            postings[t].append(i)
    parent, links = list(range(len(keys))), defaultdict(set)

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, s in enumerate(keys):
        shared = Counter(j for t in s for j in postings[t] if j > i)
        for j, n in shared.items():
            if n >= least * (len(s) + len(keys[j]) - n):
                links[i].add(j)
                links[j].add(i)
                parent[max(find(i), find(j))] = min(find(i), find(j))
    members = defaultdict(list)
    for i in range(len(keys)):
        members[find(i)] += sets[keys[i]]
    out = {}
    for k, (doc_id, text) in enumerate(rows):
        if not shingle_set(text):
            out[k] = (doc_id, 0, 0)
    for i, s in enumerate(keys):
        ids = [rows[k][0] for k in members[find(i)] if rows[k][0] is not None]
        for k in sets[s]:
            n = len(sets[s]) - 1 + sum(len(sets[keys[j]]) for j in links[i])
            out[k] = (min(ids) if ids else None, n, len(links[i]))
    return out


def repeated_words(text, width=8):
    w = words(text)
    at = defaultdict(list)
    for i in range(len(w) - width + 1):
        at[tuple(w[i : i + width])].append(i)
    covered = {j for places in at.values() if len(places) > 1 for i in places for j in range(i, i + width)}
    return len(covered)


def plain_counts(text):
    text = text or ""
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    return (len(words(text)), sum(map(len, words(text))), sum(c in "#*$%&|<>" for c in text), dup,
            repeated_words(text))


def targets(sizes, weights=(3, 1, 2), share=1.5, limit=2):
    """{source: target}: shares by weight, the excess of full sources dealt out again."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    full, total = set(), share * sum(sizes.values())
    while True:
        open_ = [s for s in order if s not in full]
        rest = total - sum(limit * sizes[s] for s in full)
        level = rest / sum(weight[s] for s in open_) if open_ else 0
        over = {s for s in open_ if weight[s] * level > limit * sizes[s]}
        if not over:
            return {s: limit * sizes[s] if s in full else weight[s] * level for s in order}
        full |= over


BASE_PATTERNS = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}


def personal(text):
    text, out = text or "", []
    for kind, pattern in BASE_PATTERNS.items():
        for m in pattern.finditer(text):
            digits = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and any(int(p) > 255 for p in m[0].split(".")):
                continue
            if kind == "card":
                double = [int(c) * (1 + k % 2) for k, c in enumerate(reversed(digits))]
                if not 16 <= len(digits) <= 19 or sum(d - 9 * (d > 9) for d in double) % 10:
                    continue
            if kind == "phone" and not 8 <= len(digits) <= 15:
                continue
            out.append((kind, m.start(), m.end()))
    return out


def normal_digest(text):
    return hashlib.sha256(re.sub(r"[\x20\x09-\x0D]", "", text or "").encode()).hexdigest()


def crc(data):
    return zlib.crc32(data) & 0xFFFFFFFF
