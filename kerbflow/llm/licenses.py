"""License scan: notice phrases and identifier tags, and the expressions behind tags."""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The base phrases and their labels.
BASE = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}
#: Further notice phrases.
NOTICES = {
    "gnu lesser general public license": "lgpl",
    "gnu affero general public license": "agpl",
    "mozilla public license": "mpl",
    "eclipse public license": "epl",
    "bsd license": "bsd",
    "bsd 2 clause": "bsd",
    "bsd 3 clause": "bsd",
    "isc license": "isc",
    "boost software license": "bsl",
    "creative commons attribution": "cc-by",
    "creative commons zero": "cc0",
    "cc0 1 0": "cc0",
    "the unlicense": "unlicense",
}
#: Tags in front of a license expression, in lower case.
TAGS = ("spdx-license-identifier:", "license-expression:", "license:", "licence:")
#: Families of identifiers: label and whether it is permissive. An identifier belongs to
#: a family if it is its name, or its name, a hyphen and something more.
FAMILIES = {
    "mit": ("mit", True), "x11": ("mit", True), "apache": ("apache", True), "bsd": ("bsd", True),
    "0bsd": ("bsd", True), "isc": ("isc", True), "zlib": ("zlib", True), "bsl": ("bsl", True),
    "unlicense": ("unlicense", True), "cc0": ("cc0", True), "cc-by": ("cc-by", True),
    "python": ("python", True), "artistic": ("artistic", True), "gpl": ("gpl", False),
    "lgpl": ("lgpl", False), "agpl": ("agpl", False), "mpl": ("mpl", False),
    "epl": ("epl", False), "cddl": ("cddl", False), "eupl": ("eupl", False),
}
RESTRICTED = re.compile(r"-(nc|nd|sa)\b")
BINDS = {"or": 1, "and": 2, "with": 3}
TOKEN = re.compile(r"[a-z0-9.+-]+|[()]|\S")
NOT_IN_WORDS = bytes(b for b in range(128) if not (48 <= b <= 57 or 97 <= b <= 122))
BLANKED = bytes(32 if b in NOT_IN_WORDS else b for b in range(256))
SCANNED = ("doc_id long, n_words long, n_base long, first_word long, last_word long, "
           "base_labels string, labels string, score double, n_tags long, permissive boolean")


def automaton(keys) -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for key in keys:
        found.add_word(key, key)
    found.make_automaton()
    return found


def family(identifier: str) -> tuple[str, bool] | None:
    """Label of an identifier, and whether it is permissive; None if unknown."""
    name = identifier.rstrip("+")
    parts = name.split("-")
    for n in range(len(parts), 0, -1):
        if hit := FAMILIES.get("-".join(parts[:n])):
            return hit[0], hit[1] and not RESTRICTED.search(name)
    return None


def evaluate(expression: str) -> tuple[set[str], bool] | None:
    """Labels in the longest well-formed head of an expression, and whether it can be
    met by permissive licenses alone; None if there is no such head.

    Shunting-yard: operands go to the output, operators wait on a stack until one that
    binds less follows (WITH before AND before OR). An exception after WITH keeps the
    license's label; it makes a copyleft license no stricter and no permissive one.
    """
    output: list[tuple[set[str], bool]] = []
    stack: list[str] = []
    best, operand = None, True

    def reduce_top(out: list, op: str) -> None:
        right, left = out.pop(), out.pop()
        value = {"or": left[1] or right[1], "and": left[1] and right[1], "with": left[1]}[op]
        out.append((left[0] | right[0], value))

    for token in (m.group() for m in TOKEN.finditer(expression.lower())):
        if operand:
            if token == "(":
                stack.append(token)
                continue
            if stack and stack[-1] == "with":
                if token in BINDS or not re.fullmatch(r"[a-z0-9.+-]+", token):
                    break
                output.append((set(), True))
            elif known := family(token) or family(token.rstrip(".")):
                output.append(({known[0]}, known[1]))
            else:
                break
            operand = False
        elif token in BINDS:
            while stack and stack[-1] != "(" and BINDS[stack[-1]] >= BINDS[token]:
                reduce_top(output, stack.pop())
            stack.append(token)
            operand = True
        elif token == ")" and "(" in stack:
            while (top := stack.pop()) != "(":
                reduce_top(output, top)
        else:
            break
        if not operand and "(" not in stack:
            best = _value(output, stack, reduce_top)
    return best


def _value(output, stack, reduce_top) -> tuple[set[str], bool]:
    out = list(output)
    for op in reversed(stack):
        reduce_top(out, op)
    return out[-1]


class Scanner:
    def __init__(self):
        self.notices = automaton(f" {p} " for p in {**BASE, **NOTICES})
        self.tags = automaton(TAGS)
        self.labels = {f" {p} ": label for p, label in {**BASE, **NOTICES}.items()}
        self.base = {f" {p} " for p in BASE}

    def scan(self, text: str) -> tuple:
        raw = text.encode("utf-8", "surrogatepass").lower()  # bytes: A to Z only
        words = raw.translate(BLANKED).split()
        line = (b" " + b" ".join(words) + b" ").decode("latin-1")
        n_base, at, word, first, last = 0, 0, 0, None, None
        base: set[str] = set()
        notices: set[str] = set()
        starts = sorted((end - len(key) + 1, key) for end, key in self.notices.iter(line))
        for start, key in starts:
            word += line.count(" ", at, start)
            at = start
            if key in self.base:
                n_base += 1
                first, last = word if first is None else first, word
                base.add(self.labels[key])
            else:
                notices.add(self.labels[key])
        tagged, permissive = self.expressions(raw)
        miss = (0.2 if base else 1.0) * (0.4 if notices else 1.0) * (0.05 if tagged else 1.0)
        labels = base | notices | {x for found in tagged for x in found}
        if not tagged and labels:
            permissive = all(FAMILIES.get(x, ("", False))[1] for x in labels)
        return (len(words), n_base, first, last, ",".join(sorted(base)), ",".join(sorted(labels)),
                1.0 - miss, len(tagged), permissive if labels else None)

    def expressions(self, raw: bytes) -> tuple[list[set[str]], bool]:
        """Labels of each tag that is followed by an expression; whether permissive
        licenses meet them all.

        An expression ends with its line, and at the colon of the next tag at the latest
        (no expression goes on behind one), so every byte is looked at for one tag only.
        """
        found, permissive = [], True
        ends = [end for end, _ in self.tags.iter(raw.decode("latin-1"))]
        for end, limit in zip(ends, [*ends[1:], len(raw)]):
            stop = raw.find(b"\n", end, limit)
            rest = raw[end + 1 : stop if stop >= 0 else limit + 1].decode("utf-8", "replace")
            if value := evaluate(rest):
                found.append(value[0])
                permissive = permissive and value[1]
        return found, permissive


def scan(docs: DataFrame) -> DataFrame:
    """Licenses named in each whole text.

    Words are runs of ASCII letters and digits and of other characters, A-Z lowered.
    ``n_base`` counts every place of a base phrase, ``first_word`` and ``last_word``
    are the smallest and largest of them. ``labels`` adds further notice phrases and
    the licenses of expressions behind identifier tags; ``permissive`` says whether
    permissive licenses alone meet all of them (null without labels). ``score`` is one
    minus the product of what each kind of evidence leaves open.

    A null text is empty (no words, score 0); a null doc_id stays null; repeated rows
    give repeated rows; other columns are not read; no rows give no rows. One pass
    without a shuffle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner()
        names = [x.split()[0] for x in SCANNED.split(", ")]
        types = [pa.int64()] * 5 + [pa.string()] * 2 + [pa.float64(), pa.int64(), pa.bool_()]
        for batch in batches:
            rows = [scanner.scan(x.as_py() or "") for x in batch.column(1)]
            columns = list(zip(*rows)) if rows else [()] * 9
            yield pa.RecordBatch.from_arrays(
                [batch.column(0)] + [pa.array(c, t) for c, t in zip(columns, types[1:])], names=names
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, SCANNED)
