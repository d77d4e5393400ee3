"""Personal data: a semi-Markov conditional random field over whole candidate spans, beside fixed base patterns.

Base spans are the leftmost matches of one pattern for each kind; a match that fails its check is dropped. They always
stay. The field looks at islands: digit groups with at most three separators between them, or what stands around
an @ or a bracketed "at". An island is a sequence of atoms (digit groups; name and domain labels); a segmentation
deals its atoms out to spans of at most `LONGEST` atoms and single atoms outside. A span has features as a
whole: its digits and groups, separators, prefix, check digit, what stands beside it and which word introduces it. A
score for each pair of neighbouring spans joins them. Dynamic programming over (atom, kind of the last
segment) finds the best segmentation, which fixes boundaries and kinds together; between islands nothing is a
candidate, so islands are decided apart.

Training maximises the likelihood of segmentations with the gradient from forward and backward sums over all of them. It
learns from the islands of at most `sample` documents (those with the smallest hash of their id among those with a
digit or @, one row of an id; see fit for the bounds of each): base spans are the truth where they do not
contradict each other, islands without them are outside. Each also gives variants: two data side by side, a wrong
check digit, a number too large, a phone number without its plus behind a word for phones, a bracketed "at". So the
field finds what the patterns cannot: a phone number and a card in a row, a written-out address.

Spans of the field are added where they touch no base span. A null text is empty, an empty text has no spans; repeated rows
and equal ids are judged each on their own; texts are read whole, offsets count code points. Without any base
span in the sample the field adds nothing. An empty table gives an empty table; only id and text are read.
"""

from __future__ import annotations

import random
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from phantomlake.llm.common import id_text

KINDS = ("email", "ip", "card", "phone")
EMAIL, IP, CARD, PHONE = range(4)
OUT, LONGEST = 4, 8  # the label outside; atoms of the longest span
FOUND = "doc_id long, spans array<struct<kind string, start long, end long, base boolean>>"
_SPAN = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_())])
_FOUND = pa.schema([("doc_id", pa.int64()), ("spans", pa.list_(_SPAN))])

# ---- base patterns

_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
#: A match can only begin where its digits begin, since whatever follows them decides.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_NAME = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
#: Texts without any of these have neither base spans nor islands.
_ANY = re.compile(r"[0-9@]|[\[({] ?(?:at|AT) ?[\])}]")


def digits_of(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        x = int(c) * (1 + k % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def _small(number: str) -> bool:
    """At most 255, with any number of zeros in front."""
    number = number.lstrip("0")
    return len(number) <= 3 and int(number or 0) <= 255


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """The name is all that may stand in one before the @, but not before the end of the last match."""
    after, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > after and text[start - 1] in _NAME:
            start -= 1
        m = _DOMAIN.match(text, at) if start < at else None
        if m:
            yield start, m.end()
            after = m.end()
        at = text.find("@", max(at + 1, after))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end), sorted."""
    spans = [(a, EMAIL, z) for a, z in _emails(text)]
    spans += [(m.start(), IP, m.end()) for m in _IP.finditer(text) if all(_small(x) for x in m.group().split("."))]
    for m in _CARD.finditer(text):
        digits = digits_of(m.group()) if len(m.group()) < 40 else ""
        if 14 <= len(digits) <= 19 and luhn(digits):
            spans.append((m.start(), CARD, m.end()))
    spans += [(m.start(), PHONE, m.end()) for m in _PHONE.finditer(text) if 10 <= len(digits_of(m.group())) <= 15]
    return sorted(spans)


# ---- islands and their candidate spans

_GROUPS = re.compile(r"(?:\+ ?\(?|\(\+?)?(?<![0-9A-Za-z_@.])[0-9]++(?![A-Za-z_@])(?:[ ().\-/]{1,3}\+?\(?[0-9]++(?![A-Za-z_@]))*")
_GROUP = re.compile(r"(?:\+ ?\(?|\(\+?)?[0-9]+")
_AT = re.compile(r" ?[\[({] ?(?:at|AT) ?[\])}] ?")
_DOT = re.compile(r"\.| ?[\[({] ?(?:dot|DOT) ?[\])}] ?")
_LABEL = re.compile(r"[A-Za-z0-9-]+")
_WORD_BEFORE = re.compile(r"([^\W\d_]+)[^\w\n]{0,4}$")
#: Words that introduce personal data, in four languages.
CUES = {
    "tel": PHONE, "phone": PHONE, "telephone": PHONE, "mobile": PHONE, "call": PHONE, "fax": PHONE, "téléphone": PHONE, "portable": PHONE, "telefon": PHONE, "handy": PHONE, "teléfono": PHONE, "móvil": PHONE,
    "card": CARD, "visa": CARD, "mastercard": CARD, "carte": CARD, "karte": CARD, "kreditkarte": CARD, "tarjeta": CARD,
    "ip": IP, "host": IP, "server": IP, "address": IP, "adresse": IP, "dirección": IP,
}


@dataclass
class Island:
    """Atoms (start, end) and candidate spans (first atom, last atom, features); one letter says what it is made of."""

    made_of: str
    atoms: list[tuple[int, int]]
    spans: list[tuple[int, int, tuple[str, ...]]] = field(default_factory=list)

    @property
    def signature(self) -> tuple:
        return self.made_of, len(self.atoms), tuple(self.spans)

    def kinds(self) -> tuple[int, ...]:
        return (EMAIL,) if self.made_of == "@" else (IP, CARD, PHONE)


def _bucket(n: int) -> str:
    return str(n) if n < 20 else "20+"


def _number_features(text: str, atoms: list[tuple[int, int]], i: int, j: int, cue: int | None) -> tuple[str, ...]:
    a, z = atoms[i][0], atoms[j][1]
    whole = text[a:z]
    digits, groups = digits_of(whole), [digits_of(text[x:y]) for x, y in atoms[i : j + 1]]
    between = {c for k in range(i, j) for c in text[atoms[k][1] : atoms[k + 1][0]]}
    dots, n = between == {"."}, len(digits)
    out = [f"n{_bucket(n)}", f"g{_bucket(len(groups))}", "sep" + "".join(sorted(between & set(" .-/"))), "plus" if "+" in whole[:2] else "noplus"]
    if whole.startswith("00"):
        out.append("zeros")
    if dots and len(groups) == 4:
        out.append("quad" if all(map(_small, groups)) else "badquad")
    if 14 <= n <= 19:
        out.append("luhn" if luhn(digits) else "noluhn")
    if len(groups) == 1 or all(len(g) == 4 for g in groups[:-1]):
        out.append("fours")
    if "+" in whole[2:]:
        out.append("plus inside")
    if (i and text[atoms[i - 1][1] : a] in (" ", ".", "-")) or (j + 1 < len(atoms) and text[z : atoms[j + 1][0]] in (" ", ".", "-")):
        out.append("goes on")
    if (i and text[atoms[i - 1][1] : a] in (".", "-")) or (j + 1 < len(atoms) and text[z : atoms[j + 1][0]] in (".", "-")):
        out.append("goes on closely")
    if cue is not None and i == 0:
        out.append(f"cue {KINDS[cue]}")
        if 8 <= n <= 15:
            out.append(f"cue {KINDS[cue]} and length")
    return tuple(out)


def _email_features(text: str, atoms: list[tuple[int, int]], j: int, spelled: bool) -> tuple[str, ...]:
    last, following = text[atoms[j][0] : atoms[j][1]], text[atoms[j][1] : atoms[j][1] + 1]
    out = ["name", f"labels{min(4, j)}", "spelled" if spelled else "sign", "letters" if last.isalpha() else "no letters", f"last{min(7, len(last))}"]
    if j + 1 < len(atoms):
        out.append("label follows")
    if following.isalnum():
        out.append("cut")
    return tuple(out)


def islands(text: str) -> Iterator[Island]:
    """All islands of a text."""
    for m in _GROUPS.finditer(text):
        atoms = [x.span() for x in _GROUP.finditer(text, m.start(), m.end())]
        before = _WORD_BEFORE.search(text, max(0, m.start() - 40), m.start())
        cue = CUES.get(before.group(1).lower()) if before else None
        island = Island("#", atoms)
        for i in range(len(atoms)):
            n = 0
            for j in range(i, min(len(atoms), i + LONGEST)):
                n += atoms[j][1] - atoms[j][0]
                if n > 40:
                    break
                if n >= 4:
                    island.spans.append((i, j, _number_features(text, atoms, i, j, cue)))
        if island.spans:
            yield island
    signs = [(m.start(), m.end(), True) for m in _AT.finditer(text)]
    at = text.find("@")
    while at >= 0:
        signs.append((at, at + 1, False))
        at = text.find("@", at + 1)
    for a, z, spelled in sorted(signs):
        start = a
        while start and text[start - 1] in _NAME and a - start < 100:
            start -= 1
        label = _LABEL.match(text, z)
        atoms = [(start, a)]
        while label and len(atoms) < LONGEST:
            atoms.append(label.span())
            dot = _DOT.match(text, label.end())
            label = _LABEL.match(text, dot.end()) if dot else None
        if start < a and len(atoms) > 2:
            yield Island("@", atoms, [(0, j, _email_features(text, atoms, j, spelled)) for j in range(2, len(atoms))])


# ---- the field


@dataclass
class SpanField:
    """weights: (kind, feature) -> score; pairs: score of a kind after another one in the same island."""

    weights: dict[tuple[int, str], float]
    pairs: np.ndarray
    known: dict = field(default_factory=dict, repr=False)

    def scores(self, island: Island) -> list[tuple[int, int, int, float]]:
        """(first atom, last atom, kind, score) of every candidate."""
        w = self.weights
        return [(i, j, y, sum(w.get((y, f), 0.0) for f in features)) for i, j, features in island.spans for y in island.kinds()]

    def best(self, island: Island) -> list[tuple[int, int, int]]:
        """(first atom, last atom, kind) of the spans of the best segmentation."""
        key = island.signature
        if key not in self.known:
            if len(self.known) > 50_000:
                self.known.clear()
            self.known[key] = self._decoded(island)
        return self.known[key]

    def _decoded(self, island: Island) -> list[tuple[int, int, int]]:
        n = len(island.atoms)
        ends = [[] for _ in range(n)]
        for i, j, y, s in self.scores(island):
            ends[j].append((i, y, s))
        value = np.full((n + 1, 5), -np.inf)
        value[0, OUT] = 0.0
        back = {}
        for j in range(n):
            before = int(value[j].argmax())
            value[j + 1, OUT], back[j + 1, OUT] = value[j, before], (j, before)
            for i, y, s in ends[j]:
                ways = value[i] + self.pairs[:, y]
                before = int(ways.argmax())
                if ways[before] + s > value[j + 1, y]:
                    value[j + 1, y], back[j + 1, y] = ways[before] + s, (i, before)
        at, y, spans = n, int(value[n].argmax()), []
        while at:
            i, before = back[at, y]
            if y != OUT:
                spans.append((i, at - 1, y))
            at, y = i, before
        return spans[::-1]


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    top = np.where(np.isinf(top), 0.0, top)
    with np.errstate(divide="ignore"):
        return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis=axis))


def log_total(scores: np.ndarray, pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Log of the sum over all segmentations, the probability of each candidate, the expected number of each pair.

    scores: (islands, first atom, atoms less one, kind) of islands with equally many atoms, -inf where there is no candidate.
    """
    many, n, longest, _ = scores.shape
    left, right = np.full((many, n + 1, 5), -np.inf), np.full((many, n + 1, 5), -np.inf)
    left[:, 0, OUT], right[:, n] = 0.0, 0.0
    into = np.full((many, n, 4), -np.inf)  # all that leads to a span of each kind that begins here
    for i in range(n):
        into[:, i] = _log_sum(left[:, i, :, None] + pairs, 1)
        left[:, i + 1, OUT] = np.logaddexp(left[:, i + 1, OUT], _log_sum(left[:, i], 1))
        for k in range(min(longest, n - i)):
            at = left[:, i + k + 1, :4]
            np.logaddexp(at, into[:, i] + scores[:, i, k], out=at)
    for i in range(n - 1, -1, -1):
        reach = min(longest, n - i)
        onward = _log_sum(scores[:, i, :reach] + right[:, i + 1 : i + 1 + reach, :4], 1)  # by the kind that begins here
        right[:, i] = np.logaddexp(right[:, i + 1, OUT, None], _log_sum(pairs + onward[:, None], 2))
    total = _log_sum(left[:, n], 1)
    chance, expected = np.zeros_like(scores), np.zeros((many, 5, 4))
    for i in range(n):
        reach = min(longest, n - i)
        chance[:, i, :reach] = np.exp(into[:, i, None] + scores[:, i, :reach] + right[:, i + 1 : i + 1 + reach, :4] - total[:, None, None])
        share = np.exp(left[:, i, :, None] + pairs - np.where(np.isinf(into[:, i]), 0.0, into[:, i])[:, None])
        expected += share * chance[:, i].sum(axis=1)[:, None]
    return total, chance, expected


@dataclass
class _Batch:
    """Different islands of equally many atoms: which features each candidate has, the truth, weights and pairs seen."""

    shape: tuple[int, int, int, int]
    cells: np.ndarray
    features: np.ndarray
    truth: np.ndarray
    weights: np.ndarray
    seen: np.ndarray


def _batches(counts: Counter, index: dict[tuple[int, str], int]) -> list[_Batch]:
    by_atoms = {}
    for (signature, truth), times in counts.items():
        by_atoms.setdefault(signature[1], []).append((signature, truth, times))
    out = []
    for n, members in sorted(by_atoms.items()):
        shape = (len(members), n, min(n, LONGEST), 4)
        cells, features, truth, seen = [], [], np.zeros(shape), np.zeros((len(members), 5, 4))
        for b, ((made_of, _, spans), true, _) in enumerate(members):
            for i, j, names in spans:
                for y in Island(made_of, []).kinds():
                    cell = int(np.ravel_multi_index((b, i, j - i, y), shape))
                    cells += [cell] * len(names)
                    features += [index.setdefault((y, f), len(index)) for f in names]
            last, place = OUT, 0
            for i, j, y in true:
                truth[b, i, j - i, y] = 1
                seen[b, last if i == place else OUT, y] += 1
                last, place = y, j + 1
        out.append(_Batch(shape, np.array(cells), np.array(features), truth, np.sqrt([t for *_, t in members]), seen))
    return out


def trained(examples: list[tuple[Island, list[tuple[int, int, int]]]], rounds: int = 120, rate: float = 0.15, ridge: float = 0.02, most_atoms: int = 40) -> SpanField:
    """The field fitted by Adam on islands of at most `most_atoms` atoms with their true spans (first atom, last atom, kind)."""
    counts = Counter((island.signature, tuple(truth)) for island, truth in examples if len(island.atoms) <= most_atoms)
    if not any(truth for _, truth in counts):
        return SpanField({}, np.full((5, 4), -1.0))
    index: dict[tuple[int, str], int] = {}
    batches = _batches(counts, index)
    size, weight = len(index), sum(b.weights.sum() for b in batches)
    params, m, v = np.zeros(size + 20), np.zeros(size + 20), np.zeros(size + 20)
    for k in range(1, rounds + 1):
        pairs, grad = params[size:].reshape(5, 4), np.zeros(size + 20)
        for b in batches:
            total = int(np.prod(b.shape))
            scores = np.full(total, -np.inf)
            scores[b.cells] = np.bincount(b.cells, params[b.features], total)[b.cells]
            _, chance, expected = log_total(scores.reshape(b.shape), pairs)
            missed = ((b.truth - chance) * b.weights[:, None, None, None]).ravel()
            grad[:size] += np.bincount(b.features, missed[b.cells], size)
            grad[size:] += ((b.seen - expected) * b.weights[:, None, None]).sum(axis=0).ravel()
        grad = grad / weight - ridge / weight * params
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        params = params + rate * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.999**k)) + 1e-8)
    return SpanField({x: float(params[k]) for x, k in index.items()}, params[size:].reshape(5, 4).copy())


def _truth(island: Island, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]] | None:
    """Base spans as spans of the island's atoms; None where they contradict each other or the atoms."""
    first, last = island.atoms[0][0], island.atoms[-1][1]
    starts, ends = {a: k for k, (a, _) in enumerate(island.atoms)}, {z: k for k, (_, z) in enumerate(island.atoms)}
    found = []
    for a, y, z in base:
        if a < last and first < z:
            if a not in starts or z not in ends or y not in island.kinds():
                return None
            found.append((starts[a], ends[z], y))
    if any(x[1] >= y[0] for x, y in zip(found, found[1:], strict=False)):
        return None
    return found


def _labelled(text: str, spans: list[tuple[int, int, int]]) -> list[tuple[Island, list[tuple[int, int, int]]]]:
    found = [(island, _truth(island, spans)) for island in islands(text)]
    return [(island, truth) for island, truth in found if truth is not None]


def variants(kind: int, datum: str, other: tuple[int, str], rng: random.Random) -> Iterator[tuple[str, list[tuple[int, int, int]]]]:
    """(text, its true spans) made from one datum: what the patterns miss, and what must not be found."""
    cue = lambda y: rng.choice([w for w, k in CUES.items() if k == y])
    if kind != EMAIL and other[0] != EMAIL and not (kind == other[0] == IP):
        for gap in (" ", ", ")[: 1 + (rng.random() < 0.3)]:
            start = 2 + len(datum) + len(gap)
            yield f"a {datum}{gap}{other[1]} b", [(2, kind, 2 + len(datum)), (start, other[0], start + len(other[1]))]
    if kind == PHONE:
        bare = datum.replace("+", "")
        word = cue(PHONE)
        yield f"{word}: {bare} b", [(len(word) + 2, PHONE, len(word) + 2 + len(bare))]
        yield f"a {bare} b", []
        yield f"{word} {''.join(rng.choice('0123456789') for _ in range(rng.randint(3, 6)))} b", []
    elif kind == CARD:
        k = max(i for i, c in enumerate(datum) if c.isdigit())
        yield f"a {datum[:k]}{(int(datum[k]) + 1 + rng.randrange(8)) % 10}{datum[k + 1 :]} b", []
    elif kind == IP:
        head, rest = datum.split(".", 1)
        yield f"a {int(head) % 100 + 300}.{rest} b", []
        yield f"a {head}.{rest}.{rng.randrange(99)} b", []
    else:
        name, domain = datum.split("@", 1)
        for at, dot in ((" [at] ", "."), ("(at)", "."), (" (at) ", " (dot) ")):
            text = f"{name}{at}{domain.replace('.', dot)}"
            yield f"a {text} b", [(2, EMAIL, 2 + len(text))]


def examples_of(texts: list[str], most: int = 20) -> list[tuple[Island, list[tuple[int, int, int]]]]:
    """Islands with true spans from texts, and their variants."""
    rng, out, data = random.Random(11), [], []
    for text in texts:
        base = base_spans(text)
        found = _labelled(text, base)
        at = rng.randrange(max(1, len(found) - most + 1))
        out += found[at : at + most]
        data += [(y, text[a:z]) for a, y, z in base[:most] if z - a < 60]
    for kind, datum in data[:4000]:
        for text, spans in variants(kind, datum, rng.choice(data), rng):
            out += _labelled(text, spans)
    return out


def fit(docs: DataFrame, sample: int = 2000, most: int = 20, line_chars: int = 2000, id_col: str = "doc_id", text_col: str = "text") -> SpanField:
    """Learns from at most `sample` documents with a digit or an @: of each at most 3 * `most` lines of at most `line_chars` characters that have one."""
    spark = docs.sparkSession
    rows = id_text(docs, id_col, text_col).filter(F.col("text").rlike("[0-9@]") & F.col("doc_id").isNotNull())
    ids = rows.select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample).toPandas()
    chosen = rows.join(F.broadcast(spark.createDataFrame(ids, "doc_id long")), "doc_id").groupBy("doc_id").agg(F.min(F.struct(F.xxhash64("text"), "text")).alias("m"))

    def lines(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            texts = [[x for x in t.split("\n") if len(x) <= line_chars and _ANY.search(x)][: 3 * most] for t in part.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(["\n".join(x) for x in texts], pa.string())], names=["doc_id", "text"])

    found = chosen.select("doc_id", F.col("m.text").alias("text")).mapInArrow(lines, "doc_id long, text string").toArrow().sort_by("doc_id")
    return trained(examples_of(found.column("text").to_pylist(), most))


def spans_of(text: str, model: SpanField) -> list[tuple[int, int, int, bool]]:
    """(start, kind, end, base) of all spans of a text, sorted."""
    if not _ANY.search(text):
        return []
    base = base_spans(text)
    spans = [(*x, True) for x in base]
    if model.weights:
        starts, ends = [], []  # what base spans cover, as intervals apart from each other
        for a, _, z in base:
            if ends and a < ends[-1]:
                ends[-1] = max(ends[-1], z)
            else:
                starts.append(a)
                ends.append(z)
        found = sorted((island.atoms[i][0], y, island.atoms[j][1]) for island in islands(text) for i, j, y in model.best(island))
        after = 0
        for a, y, z in found:
            k = bisect_left(starts, z)  # the last interval that begins before the span's end
            if a >= after and (not k or ends[k - 1] <= a):
                spans.append((a, y, z, False))
                after = z
    return sorted(spans)


def find_pii(docs: DataFrame, model: SpanField, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and the spans (kind, start, end, base) of every document, ordered by start and kind."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            out = [[{"kind": KINDS[y], "start": a, "end": z, "base": b} for a, y, z, b in spans_of(text, model)] for text in part.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(out, pa.list_(_SPAN))], schema=_FOUND)

    return id_text(docs, id_col, text_col).mapInArrow(run, FOUND)


def redacted(docs: DataFrame, model: SpanField, text_col: str = "text") -> DataFrame:
    """The documents with every span replaced by its kind in brackets; overlapping spans become one."""

    def clean(text: str | None) -> str | None:
        if text is None:
            return None
        out, at = [], 0
        for a, y, z, _ in spans_of(text, model):
            if a >= at:
                out += [text[at:a], f"[{KINDS[y]}]"]
            at = max(at, z)
        return "".join(out) + text[at:]

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            k = part.schema.get_field_index(text_col)
            yield part.set_column(k, part.schema.field(k), pa.array([clean(t) for t in part.column(k).to_pylist()], part.schema.field(k).type))

    id_text(docs, docs.columns[0], text_col)  # lowers the size of batches
    return docs.mapInArrow(run, docs.schema)


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def pii_report(docs: DataFrame, model: SpanField) -> DataFrame:
    """Counts of base spans by kind, the digest of their list, and the list of all spans."""
    base = F.filter("spans", lambda x: x["base"])
    kinds = F.transform(base, lambda x: x["kind"])
    counts = [(F.size(kinds) - F.size(F.array_remove(kinds, k))).cast("long").alias(f"n_{k}") for k in KINDS]
    return find_pii(docs, model).select("doc_id", *counts, F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))
