"""Operator 7, secret scan with formats inferred from labelled credentials.

Three base patterns find labelled credentials; fixed public formats add specimens drawn from a
seeded rule. For each kind of credential the strings form a prefix tree whose states are merged
when their outcomes are statistically alike (the ALERGIA test, by Hoeffding bounds), which gives a
probabilistic automaton. Every other run of credential characters, and every part of a run beside
a base span, is searched if it has ``LEAST`` characters, as labelled values have at least. A span
may begin where the part begins, behind a separator or where a public format's literal stands, and
end where the part ends, before a separator or before such a literal, there in a final state only. Its score is the best
log-likelihood of an automaton less that of the background, a character bigram model of all
occurrences of runs of ``CANDIDATE_LEAST`` characters or more that touch no base span (but for
those that a public format's automaton finds as much likelier than characters at even chances, and
in a second count those that an automaton explains better than the first).
A dynamic program adds the disjoint spans whose scores have the largest sum, each less ``OPENING``
nats, if they reach ``THRESHOLD`` nats; in what these leave, those whose scores above the threshold
have the largest sum. Its time is linear in the part. Base spans always stay, and added ones never
overlap any. Parts whose bound (the sum of the
largest gains that any path of an automaton could make at their pairs of characters) is below the
threshold hold no such span, so only the others are walked.

Automata are learned from at most ``TRAIN`` distinct labelled values of a kind, those least by a
hash, of at most ``TRAIN_LENGTH`` characters each (documented bounds of the labelled sample). The
background is counted over all texts. Every whole text is scanned, and runs of any length.

Nulls: a null text counts as empty and has no spans. A null doc_id stays. Repeated rows get the same
result each. Other columns are not read, whatever their names. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import math
import random
import re
from bisect import bisect_left
from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from tessera.llm._shared import column, first_rows, table, written

#: Base patterns by kind, in the order that breaks ties. Shorter matches are dropped.
BASE = {
    "assign": (re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII), 2, 8),
    "access": (re.compile(r"AKIA[A-Z0-9]+"), 0, 16),
    "hex": (re.compile(r"[0-9a-f]+"), 0, 32),
}
# the same spans as the base pattern and its length: a run is tried from its first character only
_HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{32,}")
_HINTS = ("password", "passwd", "secret", "token", "apikey", "api_key")
SEPARATORS = frozenset("+/_.=-")
LEAST, CANDIDATE_LEAST = 8, 16
_RUN = re.compile(r"[A-Za-z0-9+/_.=-]{%d,}" % LEAST)
CANDIDATE = re.compile(r"[A-Za-z0-9+/_.=-]{%d,}" % CANDIDATE_LEAST)
_UPPER, _LOWER, _DIGIT = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789"
#: Public credential formats as (literal or alphabet, length) parts; length 0: literal.
FORMATS = {
    "github": (("ghp_", 0), (_UPPER + _LOWER + _DIGIT, 36)),
    "gitlab": (("glpat-", 0), (_UPPER + _LOWER + _DIGIT + "_-", 20)),
    "google": (("AIza", 0), (_UPPER + _LOWER + _DIGIT + "_-", 35)),
    "stripe": (("sk_live_", 0), (_UPPER + _LOWER + _DIGIT, 24)),
    "slack": (("xoxb-", 0), (_DIGIT, 12), ("-", 0), (_DIGIT, 12), ("-", 0), (_UPPER + _LOWER + _DIGIT, 24)),
    "npm": (("npm_", 0), (_UPPER + _LOWER + _DIGIT, 36)),
    "jwt": (("eyJ", 0), (_UPPER + _LOWER + _DIGIT + "_-", 33), (".eyJ", 0), (_UPPER + _LOWER + _DIGIT + "_-", 60), (".", 0), (_UPPER + _LOWER + _DIGIT + "_-", 43)),
}
_LITERALS = tuple(parts[0][0] for parts in FORMATS.values())
TRAIN, TRAIN_LENGTH, SPECIMENS, SEED = 400, 512, 300, 7
#: Distinct candidates that a task holds before it adds up their pairs of characters.
HELD = 50_000
MERGE_CONFIDENCE = 0.01
THRESHOLD = 20.0
#: What a span costs where spans compete for a place, in nats: as if one boundary in some thousands began a credential.
OPENING = 8.0
END = ""
#: The candidates' characters; with the end, or the start, one more.
CHARACTERS = _UPPER + _LOWER + _DIGIT + "+/_.=-"
START, ALPHABET = "^", len(CHARACTERS) + 1
_CODES = np.full(256, ALPHABET - 1, dtype=np.int64)
_CODES[list(CHARACTERS.encode())] = np.arange(ALPHABET - 1)


def base_spans(text: str) -> list[tuple[int, int, int, str]]:
    """(start, end, number of the kind, value) of base matches, in no order."""
    found = []
    lower = text.lower()
    if any(h in lower for h in _HINTS):
        pattern, group, least = BASE["assign"]
        found += [(m.start(), m.end(), 0, m[group]) for m in pattern.finditer(text) if len(m[group]) >= least]
    if "AKIA" in text:
        pattern, _, least = BASE["access"]
        found += [(m.start(), m.end(), 1, m[0]) for m in pattern.finditer(text) if len(m[0]) >= least]
    found += [(m.start(), m.end(), 2, m[0]) for m in _HEX.finditer(text)]
    return found


def specimens(kind: str) -> list[str]:
    """Strings of a public format, from a seeded rule."""
    rng = random.Random(f"{SEED}:{kind}")
    return ["".join(part if not n else "".join(rng.choices(part, k=n)) for part, n in FORMATS[kind]) for _ in range(SPECIMENS)]


class Automaton:
    """A deterministic probabilistic automaton by merging states of the prefix tree of strings."""

    def __init__(self, strings: list[str]):
        arcs: list[dict[str, int]] = [{}]  # of each state: the state by character
        counts: list[Counter[str]] = [Counter()]  # of each state: how often a character, or the end, followed
        for s in sorted(strings):
            at = 0
            for c in s:
                counts[at][c] += 1
                if c not in arcs[at]:
                    arcs[at][c] = len(arcs)
                    arcs.append({})
                    counts.append(Counter())
                at = arcs[at][c]
            counts[at][END] += 1
        self._arcs, self._counts = arcs, counts
        bound = math.sqrt(0.5 * math.log(2 / MERGE_CONFIDENCE))
        red, blue = [0], [t for _, t in sorted(arcs[0].items())]
        parent = {t: (0, c) for c, t in arcs[0].items()}
        while blue:
            state = max(blue, key=lambda t: sum(counts[t].values()))  # of a state met rarely too little is known yet
            for other in red[:0:-1]:  # what a string begins with is not what it goes on with: nothing merges with the root
                if self._alike(other, state, bound):
                    source, c = parent[state]
                    arcs[source][c] = other
                    self._fold(other, state)
                    break
            else:
                red.append(state)
            blue, parent, kept = [], {}, set(red)
            for r in red:
                for c, t in sorted(arcs[r].items()):
                    if t not in kept and t not in parent:
                        parent[t] = (r, c)
                        blue.append(t)
        self.states = len(red)
        number = {s: i for i, s in enumerate(red)}
        self.arc = [{c: number[t] for c, t in arcs[s].items()} for s in red]
        totals = [sum(counts[s].values()) for s in red]
        self.log = [{c: math.log(n / t) for c, n in counts[s].items() if n} for s, t in zip(red, totals, strict=True)]
        self.other = [math.log(0.5 / (t + 1)) for t in totals]  # a character not seen from a state that was left for it elsewhere
        del self._arcs, self._counts

    def _alike(self, a: int, b: int, bound: float) -> bool:
        arcs, counts = self._arcs, self._counts
        stack = [(a, b)]
        while stack:
            x, y = stack.pop()
            n, m = sum(counts[x].values()), sum(counts[y].values())
            if not n or not m:
                continue
            limit = bound * (1 / math.sqrt(n) + 1 / math.sqrt(m))
            if limit < 1 and any(abs(counts[x][c] / n - counts[y][c] / m) > limit for c in counts[x].keys() | counts[y].keys()):
                return False
            stack += [(arcs[x][c], t) for c, t in arcs[y].items() if c in arcs[x] and arcs[x][c] != t]
        return True

    def _fold(self, a: int, b: int) -> None:
        """Add the tree below b to a; b's tree is still a tree, so this ends."""
        arcs, counts = self._arcs, self._counts
        stack = [(a, b)]
        while stack:
            x, y = stack.pop()
            counts[x].update(counts[y])
            for c, t in arcs[y].items():
                if c in arcs[x]:
                    stack.append((arcs[x][c], t))
                else:
                    arcs[x][c] = t

    def score(self, s: str) -> float | None:
        """The log-likelihood of a string; None if a character leads nowhere."""
        at, total = 0, 0.0
        for c in s:
            nxt = self.arc[at].get(c)
            if nxt is None:
                return None
            total += self.log[at].get(c, self.other[at])
            at = nxt
        return total + self.log[at].get(END, self.other[at])


class Model:
    """Automata by kind of credential, and the background: a character bigram model with add-half smoothing, from counts of pairs."""

    def __init__(self, labelled: dict[str, list[str]], pairs: dict[tuple[str, str], int]):
        self.automata = {kind: Automaton(strings) for kind, strings in sorted(labelled.items()) if strings}
        totals: Counter[str] = Counter()
        for (a, _), n in pairs.items():
            totals[a] += n
        self.log = {p: math.log((n + 0.5) / (totals[p[0]] + 0.5 * ALPHABET)) for p, n in pairs.items()}
        self.unseen = {a: math.log(0.5 / (n + 0.5 * ALPHABET)) for a, n in totals.items()}
        self.gains = [self._gains(a) for a in self.automata.values()]

    def _gains(self, automaton: Automaton) -> tuple[np.ndarray, float]:
        """The most that any path gains over the background at a pair of characters (never: minus infinity), and at both its ends."""
        gain = np.full((ALPHABET, ALPHABET), -np.inf)
        code = {c: i for i, c in enumerate(CHARACTERS)}
        first = max((automaton.log[0].get(c, automaton.other[0]) - self.pair(START, c) for c in automaton.arc[0]), default=0.0)
        last = 0.0
        for arcs in automaton.arc:
            for a, state in arcs.items():
                log, other = automaton.log[state], automaton.other[state]
                last = max(last, log.get(END, other) - self.pair(a, END))
                for b in automaton.arc[state]:
                    gain[code[a], code[b]] = max(gain[code[a], code[b]], log.get(b, other) - self.pair(a, b))
        return gain.ravel(), first + last

    def promising(self, values: list[str], least: float = THRESHOLD) -> list[str]:
        """Those of the values whose bound reaches the threshold; the others hold no span of such a score."""
        if not values:
            return []
        raw = np.frombuffer("".join(values).encode("ascii"), dtype=np.uint8)
        at = _CODES[raw]
        starts = np.cumsum([0, *map(len, values[:-1])])
        pair = np.concatenate([[0], at[:-1] * ALPHABET + at[1:]])
        owner = np.zeros(len(raw), dtype=np.int64)
        owner[starts[1:]] = 1
        owner = np.cumsum(owner)
        good = np.zeros(len(values), dtype=bool)
        for gain, ends in self.gains:
            g = gain[pair]
            broken = np.isneginf(g)
            broken[starts] = True  # a path goes on between these
            cut = np.flatnonzero(broken)
            g[broken] = 0
            sums = np.add.reduceat(np.maximum(g, 0), cut)
            good[owner[cut[sums + ends >= least]]] = True
        return [values[i] for i in np.flatnonzero(good)]

    def pair(self, a: str, b: str) -> float:
        p = a, b
        return self.log[p] if p in self.log else self.unseen.get(a, -math.log(ALPHABET))

    def background(self, s: str) -> float:
        return sum(map(self.pair, [START, *s], [*s, END]))

    def likelihood(self, s: str) -> tuple[float, str] | None:
        """How much likelier than the background a whole string is for the likeliest automaton, and its kind; None if it fits none."""
        scores = [(x, kind) for kind, a in self.automata.items() if (x := a.score(s)) is not None]
        return (max(scores)[0] - self.background(s), max(scores)[1]) if scores else None

    def chosen(self, s: str, lo: int, hi: int, cost: float) -> list[tuple[int, int, str, float]]:
        """(start, end, kind, score) of the disjoint spans of s[lo:hi] whose scores, less a cost for each, have the largest sum.

        One pass from left to right over all automata at once. Spans that come to one state at one place have the same future, so
        only that goes on whose score and the best sum before its start are the most together.
        """
        first, last = s[lo:hi], range(lo + 1, hi)
        starts = [True, *(s[i - 1] in SEPARATORS or s.startswith(_LITERALS, i) for i in last)]
        ends = [*(s[i] in SEPARATORS or (s[i - 1] not in SEPARATORS and s.startswith(_LITERALS, i)) for i in last), True]
        inner = [0.0, *(self.pair(s[i - 1], s[i]) for i in last)]
        automata = [(kind, a.arc, a.log, a.other) for kind, a in self.automata.items()]
        active: list[dict[int, tuple[float, int, float]]] = [{} for _ in automata]  # by state: sum up to here, negative start, own score
        sums, taken = [0.0], [None]  # of each place: the best sum before it, and the span that ends there in it, if any
        for at, c in enumerate(first):
            top, span = sums[at], None
            for n, (kind, arcs, logs, other) in enumerate(automata):
                if not (active[n] or starts[at]):
                    continue
                now: dict[int, tuple[float, int, float]] = {}
                for state, (total, begin, own) in active[n].items():
                    nxt = arcs[state].get(c)
                    if nxt is not None:
                        gain = logs[state].get(c, other[state]) - inner[at]
                        new = total + gain, begin, own + gain
                        if nxt not in now or new > now[nxt]:
                            now[nxt] = new
                if starts[at] and (nxt := arcs[0].get(c)) is not None:
                    gain = logs[0].get(c, other[0]) - self.pair(START, c)
                    new = sums[at] + gain - cost, -at, gain
                    if nxt not in now or new > now[nxt]:
                        now[nxt] = new
                active[n] = now
                if ends[at]:
                    for state, (total, begin, own) in now.items():
                        if END in logs[state]:
                            gain = logs[state][END] - self.pair(c, END)
                            if total + gain > top:
                                top, span = total + gain, (-begin, at + 1, kind, own + gain)
            sums.append(top)
            taken.append(span)
        found, at = [], hi - lo
        while at:
            if span := taken[at]:
                found.append((lo + span[0], lo + span[1], *span[2:]))
                at = span[0]
            else:
                at -= 1
        return found[::-1]

    def spans(self, s: str) -> list[tuple[int, int, str, float]]:
        """(start, end, kind, score) of all spans found in a run or a part of one, by start.

        The best set at a cost of ``OPENING`` each, but for those below the threshold; then, in each part that this leaves, the
        best set at a cost of the threshold, which is empty only where no span reaches it.
        """
        found = [x for x in self.chosen(s, 0, len(s), OPENING) if x[3] >= THRESHOLD]
        edges = [0, *(i for x in found for i in x[:2]), len(s)]
        for lo, hi in zip(edges[::2], edges[1::2], strict=True):
            if hi - lo >= LEAST:
                found += self.chosen(s, lo, hi, THRESHOLD)
        if not found and (whole := self.likelihood(s)) and whole[0] >= THRESHOLD:
            found.append((0, len(s), whole[1], whole[0]))  # the whole run may also end in a state that is not final
        return sorted(found)


def parts_beside(text: str, spans: list[tuple]) -> Iterator[tuple[int, int]]:
    """(start, end) of the parts of runs outside the spans, which are sorted by start."""
    if not spans:
        yield from (m.span() for m in _RUN.finditer(text))
        return
    ends = list(accumulate((x[1] for x in spans), max))
    starts = [x[0] for x in spans]
    for m in _RUN.finditer(text):
        lo, hi = m.span()
        k = bisect_left(starts, lo + 1)
        if k:
            lo = max(lo, ends[k - 1])
        while lo < hi and k < len(starts) and starts[k] < hi:
            if starts[k] - lo >= LEAST:
                yield lo, starts[k]
            lo = max(lo, ends[k])
            k += 1
        if hi - lo >= LEAST:
            yield lo, hi


def untouched(text: str, spans: list[tuple]) -> Iterator[re.Match]:
    """Candidates of the text that touch none of the spans, which are sorted by start."""
    if not spans:
        yield from CANDIDATE.finditer(text)
        return
    ends = list(accumulate((x[1] for x in spans), max))  # the furthest end so far
    starts = [x[0] for x in spans]
    for m in CANDIDATE.finditer(text):
        before = bisect_left(starts, m.end())
        if not before or ends[before - 1] <= m.start():
            yield m


def public_format(value: str, automata: list[Automaton]) -> bool:
    """Whether an automaton of a public format finds a value far likelier than characters at even chances."""
    if not value.startswith(_LITERALS):
        return False
    return any((x := a.score(value)) is not None and x + (len(value) + 1) * math.log(ALPHABET) >= THRESHOLD for a in automata)


def _harvest(documents: DataFrame, text_col: str) -> DataFrame:
    """``(kind, value, n)``: base matches, those least by a hash in each task, and all other candidates as kind '-', each task's added up."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        least: dict[str, dict[str, int]] = defaultdict(dict)
        names, held = list(BASE), Counter()

        def add(kind: str, value: str) -> None:
            if len(value) <= TRAIN_LENGTH:
                least[kind].setdefault(value, _hash(value))
                if len(least[kind]) > 4 * TRAIN:
                    least[kind] = dict(sorted(least[kind].items(), key=lambda x: x[1])[:TRAIN])

        def out(rows: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*rows, strict=True)) or [(), (), ()]
            return pa.RecordBatch.from_arrays([pa.array(c, type=k) for c, k in zip(columns, (pa.string(), pa.string(), pa.int64()), strict=True)], names=["kind", "value", "n"])

        for batch in batches:
            for text in batch.column(0).to_pylist():
                text = text or ""
                spans = sorted(base_spans(text))
                for _, _, kind, value in spans:
                    add(names[kind], value)
                held.update(m[0] for m in untouched(text, spans))
            if len(held) > HELD:
                yield out([("-", v, n) for v, n in held.items()])
                held.clear()
        yield out([("-", v, n) for v, n in held.items()])
        yield out([(k, v, 1) for k, found in least.items() for v in sorted(found, key=found.get)[:TRAIN]])

    return documents.select(column(text_col)).mapInArrow(run, "kind string, value string, n long")


def pairs_of(values: list[str], times: list[int]) -> np.ndarray:
    """How often each pair of characters follow one another, start and end included, in values that occur so many times."""
    total = np.zeros(ALPHABET * ALPHABET, dtype=np.int64)
    if values:
        each = _CODES[np.frombuffer("".join(f"{v}{START}" for v in values).encode(), dtype=np.uint8)]  # the start's code is also the end's
        weights = np.repeat(times, [len(v) + 1 for v in values])
        total += np.bincount(np.concatenate([[ALPHABET - 1], each[:-1]]) * ALPHABET + each, weights, len(total)).astype(np.int64)
    return total


def named(pairs: np.ndarray) -> dict[tuple[str, str], int]:
    return {((CHARACTERS + START)[i // ALPHABET], [*CHARACTERS, END][i % ALPHABET]): int(pairs[i]) for i in np.flatnonzero(pairs)}


def _background(candidates: DataFrame, model: Model | None) -> dict[tuple[str, str], int]:
    """Pairs of characters of ``(value, n)`` rows but those of a public format, or that an automaton of the model explains better than its background."""
    shared = candidates.sparkSession.sparkContext.broadcast((model, [Automaton(specimens(kind)) for kind in FORMATS]))  # bounded automata

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, formats = shared.value
        total = np.zeros(ALPHABET * ALPHABET, dtype=np.int64)
        for batch in batches:
            rows = [(v, n) for v, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) if not public_format(v, formats)]
            if model:
                better = {v for v in model.promising([v for v, _ in rows], 0.0) if (x := model.likelihood(v)) and x[0] > 0}
                rows = [(v, n) for v, n in rows if v not in better]
            total += pairs_of([v for v, _ in rows], [n for _, n in rows])
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["pair", "n"])

    found = np.zeros(ALPHABET * ALPHABET, dtype=np.int64)
    for r in candidates.mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).collect():  # a row per pair of characters at most
        found[r.pair] = r.n
    return named(found)


def _hash(value: str) -> int:
    return int.from_bytes(hashlib.blake2b(value.encode(), digest_size=7).digest())


def fit(documents: DataFrame, text_col: str = "text") -> Model:
    """Automata of the base kinds' values (a bounded sample) and of the public formats, and the background of all candidates."""
    found = written(_harvest(documents, text_col), "credentials")
    labelled: dict[str, list[str]] = {kind: specimens(kind) for kind in FORMATS}
    order = F.conv(F.substring(F.md5("value"), 1, 13), 16, 10).cast("long")
    for kind in BASE:
        of_kind = found.filter(F.col("kind") == kind).select("value").distinct()
        labelled[kind] = [r.value for r in first_rows(of_kind, [order, "value"], F.shiftright(order, 36), TRAIN).collect()]
    candidates = found.filter("kind = '-'").select("value", "n")
    return Model(labelled, _background(candidates, Model(labelled, _background(candidates, None))))


def scan(documents: DataFrame, model: Model | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, n_assign, n_access, n_hex, base_sha256, spans, scores)`` of every row.

    spans: kind:start:end, comma-joined. scores: of each span the best automaton's log-likelihood less the background's,
    to three digits; ``-`` for a base span that fits no automaton.
    """
    shared = documents.sparkSession.sparkContext.broadcast(model or fit(documents, text_col))  # bounded automata

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, names = shared.value, list(BASE)
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            bases = [sorted(base_spans(t), key=lambda x: (x[0], x[2])) for t in texts]
            parts = [[(at, text[at:end]) for at, end in parts_beside(text, base)] for text, base in zip(texts, bases, strict=True)]
            found = {v: model.spans(v) for v in model.promising(list({v for each in parts for _, v in each}))}
            rows = []
            for base, each in zip(bases, parts, strict=True):
                spans = [(a, k, f"{names[k]}:{a}:{b}", hit and hit[0]) for a, b, k, value in base for hit in [model.likelihood(value)]]
                spans += [(at + a, len(names), f"{kind}:{at + a}:{at + b}", x) for at, v in each if v in found for a, b, kind, x in found[v]]
                spans.sort(key=lambda x: x[:3])
                counts = Counter(k for _, _, k, _ in base)
                digest = hashlib.sha256(",".join(f"{names[k]}:{a}:{b}" for a, b, k, _ in base).encode()).hexdigest()
                rows.append((counts[0], counts[1], counts[2], digest, ",".join(x[2] for x in spans), ",".join("-" if x[3] is None else f"{x[3]:.3f}" for x in spans)))
            columns = list(zip(*rows, strict=True)) or [()] * 6
            kinds = [pa.int64()] * 3 + [pa.string()] * 3
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, type=k) for c, k in zip(columns, kinds, strict=True)]], names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "scores"])

    read = documents.select(column(id_col).cast("long").alias("doc_id"), column(text_col).alias("text"))
    return read.mapInArrow(run, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, scores string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))
