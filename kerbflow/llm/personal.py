"""Personal data: base patterns, and a semi-Markov conditional random field over spans."""

from __future__ import annotations

import bisect
import hashlib
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone", "secret")
OUTSIDE = len(KINDS)
#: Most tokens of an entity: four numbers and three dots between them.
LONGEST = 7
WEIGHTS = 1 << 14
FOUND = ("doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, "
         "spans string, n_added long")

# The base patterns. A run that failed at its start fails further inside
# too, so runs are tried at their start only and never given back: linear in the text.
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_NOT_LOCAL = re.compile(r"[^A-Za-z0-9._%+-]")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_SECRET = re.compile(
    r"(?:password|passwd|secret|token|api_?key)\s?[=:]\s?\"?[A-Za-z0-9_/+-]{12,}+\"?|\bAKIA[0-9A-Z]{16}\b",
    re.IGNORECASE,
)
_TOKEN = re.compile(r"\S+")
_DATA = re.compile(r"[0-9@=]")
#: An ``at`` in letters, by itself or in brackets, and the dotted name after it.
_AT = re.compile(r"at(?:[)\]}]|(?=\s))\s*+[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", re.IGNORECASE)
_KEYWORD = re.compile(r"(?:password|passwd|secret|token|api_?key)\s?[=:]\s?\S*|AKIA[0-9A-Z]{16}", re.IGNORECASE)
_REST = re.compile(r"\S*")


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches of a local part, ``@`` and a dotted domain."""
    found, done = [], 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > done and _NOT_LOCAL.match(text, start - 1) is None:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            found.append((start, m.end()))
            done = m.end()
        at = text.find("@", max(at + 1, done))
    return found


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if k % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the base patterns, by kind and start."""
    out = [(0, a, b) for a, b in emails(text)] if "@" in text else []
    if _DIGIT.search(text) is None:
        return out
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            out.append((1, m.start(), m.end()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 16:
            digits = m[0].replace(" ", "").replace("-", "")
            if 16 <= len(digits) <= 19 and luhn(digits):
                out.append((2, m.start(), m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 8 <= sum(c.isdigit() and c.isascii() for c in m[0]) <= 15:
                out.append((3, m.start(), m.end()))
    return out


@dataclass(frozen=True)
class Region:
    """Neighbouring tokens of which the outer ones look like data; ``data``: which do."""

    starts: list[int]
    ends: list[int]
    before: str
    data: list[bool]


def _token_start(text: str, a: int) -> int:
    while a and not text[a - 1].isspace():
        a -= 1
    return a


def spelled_out(text: str) -> list[tuple[int, int]]:
    """Whole tokens of what may be data without a digit, an ``@`` or an equals sign: a
    name, ``at`` in letters and a dotted name, or a secret behind its keyword."""
    out = []
    m = _AT.search(text)
    while m:
        a, at = m.start(), m.start() + 2
        if a and text[a - 1] in "([{":
            a -= 1
        elif text[at] in ")]}" or not a or not text[a - 1].isspace():
            m = _AT.search(text, at)
            continue
        while a and text[a - 1].isspace():
            a -= 1
        out.append((_token_start(text, a), _REST.match(text, m.end()).end()))
        m = _AT.search(text, out[-1][1])
    m = _KEYWORD.search(text)
    while m:
        out.append((_token_start(text, m.start()), _REST.match(text, m.end()).end()))
        m = _KEYWORD.search(text, out[-1][1])
    return out


def data_tokens(text: str) -> list[tuple[int, int]]:
    """Tokens with a digit, an ``@`` or an equals sign, and runs of ``spelled_out`` tokens;
    those that overlap are one."""
    found = spelled_out(text)
    hit = _DATA.search(text)
    while hit:
        b = _REST.match(text, hit.start()).end()
        found.append((_token_start(text, hit.start()), b))
        hit = _DATA.search(text, b)
    out: list[tuple[int, int]] = []
    for a, b in sorted(found):
        if out and a < out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def regions(text: str, reach: int = 2) -> list[Region]:
    """Chains of data tokens at most ``reach`` other tokens apart, with as many tokens
    around. No entity reaches from one region into another, so each is decoded by itself."""
    out: list[Region] = []
    seeds = data_tokens(text)
    k = 0
    while k < len(seeds):
        last = k
        while last + 1 < len(seeds) and _near(text, seeds[last][1], seeds[last + 1][0], reach):
            last += 1
        a, b = seeds[k][0], seeds[last][1]
        chain, k = seeds[k : last + 1], last + 1
        head = max(0, a - 24 * (reach + 1))
        lead = [m.span() for m in _TOKEN.finditer(text, head, a)]
        before = text[slice(*lead[-reach - 1])].lower() if len(lead) > reach else ""
        tail = [m.span() for m in _TOKEN.finditer(text, b, b + 24 * reach)][:reach]
        spans = lead[-reach:] + [m.span() for m in _TOKEN.finditer(text, a, b)] + tail
        if out:
            spans = [x for x in spans if x[0] >= out[-1].ends[-1]]
        tops = [x[1] for x in chain]
        data = []
        for x in spans:
            at = bisect.bisect_right(tops, x[0])
            data.append(at < len(chain) and chain[at][0] < x[1])
        out.append(Region([x[0] for x in spans], [x[1] for x in spans], before, data))
    return out


def _near(text: str, a: int, b: int, reach: int) -> bool:
    return b - a <= 24 * reach and len(text[a:b].split()) <= reach


def trimmed(text: str, a: int, b: int) -> tuple[int, int]:
    """Without punctuation around; a plus or bracket may begin a number."""
    while b > a and text[b - 1] in ".,;:!?'\")]}>":
        b -= 1
    while a < b and text[a] in "'\"[{<,;:":
        a += 1
    return a, b


def _bucket(name: str) -> int:
    return zlib.crc32(name.encode("utf-8", "surrogatepass")) % WEIGHTS


def span_features(text: str, region: Region, i: int, j: int) -> list[int]:
    """Whole-span features of the tokens i to j - 1, hashed."""
    a, b = trimmed(text, region.starts[i], region.ends[j - 1])
    span = text[a:b]
    digits = "".join(c for c in span if c.isascii() and c.isdigit())
    letters = sum(c.isalpha() for c in span)
    shape = re.sub(r"(.)\1+", r"\1", "".join(
        "9" if c.isdigit() else "a" if c.isalpha() else c for c in span[:48]))
    form = re.sub(r"[^\W_]+", "w", span[:96])
    before = text[region.starts[i - 1] : region.ends[i - 1]].lower() if i else region.before
    groups = re.findall(r"[0-9]+", span)
    names = [
        "tokens%d" % (j - i), "digits%d" % min(len(digits), 24), "shape" + shape,
        "letters%d" % min(letters, 12), "groups%d" % min(len(groups), 6), "before" + before,
        "ats%d" % min(span.count("@"), 2), "dots%d" % min(span.count("."), 4),
        "luhn%d" % (16 <= len(digits) <= 19 and luhn(digits)),
        "octets%d" % (len(groups) == 4 and all(len(g) < 4 and int(g) < 256 for g in groups)),
        "plus%d" % span.startswith("+"), "brackets%d" % ("(" in span),
        "assigned%d" % bool(re.search(r"[=:]", span)), "mixed%d" % (letters > 2 and len(digits) > 2),
        "sizes" + ",".join(str(len(g)) for g in groups[:6]),
        "words" + " ".join(t for t in span.lower().split() if t.isalpha())[:24],
        "phone%d" % (8 <= len(digits) <= 15 and not letters), "form" + form,
        "keyword%d" % bool(_KEYWORD.match(span)), "keyed%d" % bool(_SECRET.fullmatch(span)),
    ]
    return [_bucket(n) for n in names] + [_bucket("bias")]


def candidates(text: str, region: Region) -> dict[tuple[int, int], np.ndarray]:
    """Features of each segment that may be an entity: bounded, and with data in it."""
    n = len(region.starts)
    out = {}
    for i in range(n):
        for j in range(i + 1, min(n, i + LONGEST) + 1):
            if any(region.data[i:j]):
                out[i, j] = np.array(span_features(text, region, i, j))
    return out


@dataclass(frozen=True)
class Field:
    """Weights by feature and kind; a token outside scores 0. ``follow``: of a kind
    after another (outside included)."""

    weights: np.ndarray
    follow: np.ndarray


def decode(text: str, region: Region, field: Field) -> list[tuple[int, int, int]]:
    """The best segmentation of a region: entities of at most LONGEST tokens and single
    tokens outside, boundaries and kinds chosen together."""
    n, k = len(region.starts), len(KINDS)
    scores = {ij: field.weights[f].sum(axis=0) for ij, f in candidates(text, region).items()}
    best = np.full((n + 1, k + 1), -np.inf)
    best[0, OUTSIDE] = 0.0
    back: dict[tuple[int, int], tuple[int, int]] = {}
    for j in range(1, n + 1):
        step = best[j - 1] + field.follow[:, OUTSIDE]
        p = int(step.argmax())
        best[j, OUTSIDE], back[j, OUTSIDE] = step[p], (j - 1, p)
        for i in range(max(0, j - LONGEST), j):
            if (s := scores.get((i, j))) is None:
                continue
            step = best[i][:, None] + field.follow[:, :k]
            p = step.argmax(axis=0)
            value = step[p, np.arange(k)] + s
            for y in np.flatnonzero(value > best[j, :k]):
                best[j, y], back[j, y] = value[y], (i, int(p[y]))
    out, j, y = [], n, int(best[n].argmax())
    while j > 0:
        i, p = back[j, y]
        if y != OUTSIDE:
            out.append((y, *trimmed(text, region.starts[i], region.ends[j - 1])))
        j, y = i, p
    return out[::-1]


def _gradient(example, field: Field, grad_w: np.ndarray, grad_f: np.ndarray) -> float:
    """Adds the gradient of the log-likelihood of one region; returns the latter."""
    n, cells, gold = example
    k = len(KINDS)
    scores = {ij: field.weights[f].sum(axis=0) for ij, f in cells.items()}
    fwd, bwd = np.full((n + 1, k + 1), -np.inf), np.full((n + 1, k + 1), -np.inf)
    fwd[0, OUTSIDE] = 0.0
    bwd[n] = 0.0

    def total(x: np.ndarray) -> np.ndarray:
        top = x.max(axis=0)
        safe = np.where(np.isfinite(top), top, 0)
        with np.errstate(divide="ignore"):
            return np.log(np.exp(x - safe).sum(axis=0)) + safe

    arcs = {(i, i + 1, None) for i in range(n)} | {(i, j, 1) for i, j in cells}
    into: dict[int, list] = {}
    for i, j, e in arcs:
        into.setdefault(j, []).append((i, e))
    for j in range(1, n + 1):
        for i, e in into[j]:
            step = total(fwd[i][:, None] + field.follow)
            if e is None:
                fwd[j, OUTSIDE] = np.logaddexp(fwd[j, OUTSIDE], step[OUTSIDE])
            else:
                fwd[j, :k] = np.logaddexp(fwd[j, :k], step[:k] + scores[i, j])
    z = total(fwd[n])
    for i in range(n - 1, -1, -1):
        for a, j, e in arcs:
            if a != i:
                continue
            if e is None:
                value = field.follow[:, OUTSIDE] + bwd[j, OUTSIDE]
                mass = np.exp(fwd[i] + value - z)
                grad_f[:, OUTSIDE] -= mass
            else:
                inner = scores[i, j] + bwd[j, :k]
                cell = field.follow[:, :k] + inner
                mass = np.exp(fwd[i][:, None] + cell - z)
                grad_f[:, :k] -= mass
                np.add.at(grad_w, cells[i, j], -mass.sum(axis=0))
                value = total(cell.T)
            bwd[i] = np.logaddexp(bwd[i], value)
    before, at, score = OUTSIDE, 0, 0.0
    for i, j, y in gold:
        score += field.follow[before, y] + (0 if y == OUTSIDE else scores[i, j][y])
        grad_f[before, y] += 1
        if y != OUTSIDE:
            grad_w[cells[i, j], y] += 1
        before, at = y, j
    return score - float(z)


def gold_segments(text: str, region: Region, spans) -> list[tuple[int, int, int]] | None:
    """The spans as segments of whole tokens; None where one doesn't fit."""
    out, at = [], 0
    inside = sorted(s for s in ((a, b, y) for y, a, b in spans)
                    if s[0] >= region.starts[0] and s[1] <= region.ends[-1])
    for a, b, y in inside:
        i = next((k for k in range(at, len(region.ends)) if region.ends[k] > a), None)
        if i is None:
            return None
        j = next((k + 1 for k in range(i, len(region.ends)) if region.ends[k] >= b), len(region.ends))
        if j - i > LONGEST or trimmed(text, region.starts[i], region.ends[j - 1]) != (a, b):
            return None
        out += [(k, k + 1, OUTSIDE) for k in range(at, i)] + [(i, j, y)]
        at = j
    return out + [(k, k + 1, OUTSIDE) for k in range(at, len(region.ends))]


def respelled(kind: int, span: str, turn: int) -> str | None:
    """The same datum in a form that no base pattern matches, a secret behind another
    keyword."""
    digits = "".join(c for c in span if c.isdigit())
    if kind == 0:
        name, _, host = span.partition("@")
        return (f"{name} (at) {host}", f"{name} @ {host}", f"{name} [at] {host}", f"{name} at {host}")[turn % 4]
    if kind == 1:
        return (span.replace(".", " . "), span.replace(".", "[.]"), span.replace(".", "(.)"))[turn % 3]
    if kind == 2 and len(digits) == 16:
        sep = ("  ", ".", "/")[turn % 3]
        return sep.join(digits[i : i + 4] for i in range(0, 16, 4))
    if kind == 3 and len(digits) >= 10:
        d = digits[-10:]
        return (f"({d[:3]}) {d[3:6]}-{d[6:]}", f"{d[:3]}-{d[3:6]}-{d[6:]}", f"{d[:3]}.{d[3:6]}.{d[6:]}")[turn % 3]
    if kind == 4 and (cut := re.search(r"[=:]", span)):
        value = span[cut.end() :].strip(' "')
        return (f"api_key={value.upper()}", f"secret: {value}", f"passwd={value}", f"TOKEN={value}",
                f"apikey: {value.upper()}", f"password = {value}")[turn % 6]
    return None


def harmless(span: str, turn: int) -> str | None:
    """Numbers that are no personal data, from the digits of one: a version, a date, a
    time, a price, an assignment."""
    d = "".join(c for c in span if c.isdigit())
    if len(d) < 8:
        return None
    return (f"{d[0]}.{d[1]}.{d[2]}", f"{d[:2]}.{d[2]}.{d[4:8]}", f"{d[:2]}:{d[2:4]}", f"{d[:3]},{d[3:6]}.{d[6:8]}",
            f"x={d[:2]}", f"{d[:4]}-{d[4:6]}-{d[6:8]}", f"{d[0]}.{d[1:3]}")[turn % 7]


def variants(kind: int, span: str) -> list[str]:
    """A datum as it is, and an address also with fewer digits or another local part:
    those of one table look more alike than those elsewhere."""
    out = [span]
    if kind == 0:
        name, _, host = span.partition("@")
        bare = _DIGIT.sub("", name).strip("._-") or "a"
        out += [f"{bare}@{_DIGIT.sub('', host)}", f"{bare}.b@{host}", f"{bare}_{len(span)}@{host}"]
    return [x for x in dict.fromkeys(out) if kind == 4 or base_spans(x) == [(kind, 0, len(x))]]


def examples_of(text: str, turn: int) -> list[tuple]:
    """Training regions of a text: as it stands, and with one datum respelled or replaced
    by a harmless number."""
    base = base_spans(text)
    taken = [(a, b) for _, a, b in base]
    gold = base + [(4, *trimmed(text, *m.span())) for m in _SECRET.finditer(text)
                   if all(m.end() <= a or m.start() >= b for a, b in taken)]
    texts = [(text, gold)]
    for kind, a, b in gold:
        for form in variants(kind, text[a:b]):
            if not (new := respelled(kind, form, turn)):
                continue
            shift = len(new) - (b - a)
            moved = [(y, s + shift * (s >= b), e + shift * (s >= b)) for y, s, e in gold if (s, e) != (a, b)]
            texts.append((text[:a] + new + text[b:], moved + [(kind, a, a + len(new))]))
            turn += 1
        if kind in (1, 2, 3) and (new := harmless(text[a:b], turn)):
            shift = len(new) - (b - a)
            texts.append((text[:a] + new + text[b:], [
                (y, s + shift * (s >= b), e + shift * (s >= b)) for y, s, e in gold if (s, e) != (a, b)]))
    out = []
    for body, spans in texts:
        for region in regions(body):
            if len(region.starts) > 24:
                continue
            segments = gold_segments(body, region, spans)
            cells = candidates(body, region)
            if segments is not None and all((i, j) in cells for i, j, y in segments if y != OUTSIDE):
                out.append((len(region.starts), cells, segments))
    return out


def sample(docs: DataFrame, most: int) -> DataFrame:
    """The ``most`` texts with the smallest hash, each once however often it occurs, of
    those that hold data-like characters and have fewer than 20,000 characters."""
    holds = F.col("text").rlike(r"@[A-Za-z0-9-]+\.|\+[0-9]|[0-9]{12}|[0-9]\.[0-9]+\.[0-9]+\.[0-9]|token|password|AKIA")
    few = docs.select("text", F.xxhash64("text").alias("h")).filter(
        F.col("text").isNotNull() & (F.char_length("text") < 20_000))
    first = few.filter(holds).select("h").distinct().orderBy("h").limit(most)
    texts = few.join(F.broadcast(first), "h", "left_semi").filter(holds).distinct()  # ``most`` hashes
    return texts.orderBy("h", "text").limit(most).select("text")


def fit(docs: DataFrame, most: int = 400, epochs: int = 6, rate: float = 0.25, seed: int = 3) -> Field:
    """Learn from the base patterns of at most ``most`` documents that hold data-like
    characters, those with the smallest hash of their text: their own spans and the
    same data in other spellings. Texts of 20,000 characters or more are not learned
    from, and equal texts count as one. Without such documents all weights are 0 and
    nothing is added to the base patterns.
    """
    chosen = sample(docs, most)
    examples: list[tuple] = []
    for turn, row in enumerate(chosen.toLocalIterator()):  # at most ``most`` short texts
        examples += examples_of(row["text"], turn)
    rng = np.random.default_rng(seed)
    k = len(KINDS)
    field = Field(np.zeros((WEIGHTS, k)), np.zeros((k + 1, k + 1)))
    sums = (np.full((WEIGHTS, k), 1e-3), np.full((k + 1, k + 1), 1e-3))
    for _ in range(epochs):
        order = rng.permutation(len(examples))
        for at in range(0, len(order), 16):
            grad_w, grad_f = np.zeros((WEIGHTS, k)), np.zeros((k + 1, k + 1))
            for e in order[at : at + 16]:
                _gradient(examples[e], field, grad_w, grad_f)
            for value, grad, squares in ((field.weights, grad_w, sums[0]), (field.follow, grad_f, sums[1])):
                grad -= 1e-3 * value
                squares += grad * grad
                value += rate * grad / np.sqrt(squares)
    return field


def added_spans(text: str, base: list[tuple[int, int, int]], field: Field) -> list[tuple[int, int, int]]:
    """Decoded entities that overlap no base span, each once."""
    taken = sorted((a, b) for _, a, b in base)
    starts = [a for a, _ in taken]
    out = set()
    for region in regions(text):
        for y, a, b in decode(text, region, field):
            k = int(np.searchsorted(starts, b)) if taken else 0
            if a < b and not any(e > a for _, e in taken[:k]):
                out.add((y, a, b))
    return sorted(out)


def listed(spans) -> str:
    return ",".join(f"{KINDS[y]}:{a}:{b}" for y, a, b in sorted(spans))


def find(docs: DataFrame, field: Field) -> DataFrame:
    """Personal data of each whole text: counts and digest of the base spans, and all
    spans (code points, end exclusive) by kind and start.

    A null text is empty; a null doc_id stays null; repeated rows give repeated rows;
    a decoded span gives way to any base span that it overlaps; other columns are not
    read; no rows give no rows. One pass without a shuffle.
    """
    model = docs.sparkSession.sparkContext.broadcast(field)  # WEIGHTS x kinds numbers

    def row(text: str) -> tuple:
        base = sorted(base_spans(text))
        more = added_spans(text, base, model.value)
        counts = [sum(y == k for y, _, _ in base) for k in range(4)]
        return (*counts, hashlib.sha256(listed(base).encode()).hexdigest(), listed(base + more), len(more))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.int64()]
        names = [x.split()[0] for x in FOUND.split(", ")]
        for batch in batches:
            rows = [row(x.as_py() or "") for x in batch.column(1)]
            columns = list(zip(*rows)) if rows else [()] * 7
            yield pa.RecordBatch.from_arrays(
                [batch.column(0)] + [pa.array(c, t) for c, t in zip(columns, types)], names=names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, FOUND)
