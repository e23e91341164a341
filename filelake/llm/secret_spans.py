"""Secrets found by patterns and by a character convolutional network over every other candidate.

A candidate is a token of 16 or more of ``[A-Za-z0-9+/_.=-]`` with a digit and a letter, or one of ``LISTED`` forms. The
network reads the candidate and ``CONTEXT`` code points on either side as character classes: an embedding, one layer of
convolutions of width five, maximum over places (inside the candidate and around it apart), and a logistic output, all
in numpy. It is trained on labelled findings: positive are what the base patterns find in all documents
and keys of public formats put into their usual assignments, and passwords in connection strings; negative are all other candidates, and ids, paths,
versions and words of the same shape. No finding is left out, and long ones count piece by piece. Three quarters are
trained on: they are dealt by a hash to chunks of some ``CHUNK``, and in each round every chunk, with the made-up
examples beside it, moves a copy of the network by one pass; the copies' weights and moments are averaged. The last
quarter is held out and counted by score: scores are calibrated by Platt scaling on these counts, where made-up examples
keep the share they have beside ``EXAMPLES`` found ones of their class. The decision threshold is the smallest one from
0.5 on that lets no held-out negative pass by a margin; where ``RECALL`` of the held-out positives needs a lower one,
that one is taken instead, be it below 0.5.

Base spans always stay. A candidate that overlaps one is settled by it. Defined cases: a null text is empty; without
candidates there are no spans; equal findings are separate spans; repeated rows are answered each; equal findings in
equal contexts train once; with no labelled findings the made-up ones train alone; extra columns are not read. Positions are code points.
"""

from __future__ import annotations

import hashlib
import random
import re
import string
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from itertools import accumulate, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from filelake.llm import common, wordhash

KINDS = ("assign", "access", "hex", "model")

# The base patterns and the least length of what they must find.
ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
NAMES = ("password", "passwd", "secret", "token", "api_key", "apikey")

# Public key formats that are candidates whatever their letters, and what one of them has in it.
LISTED = re.compile(r"(?:ghp_|gho_|glpat-|xox[bp]-|sk_live_|sk-)[A-Za-z0-9_-]{16,}|eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{8,}")
LISTED_SIGNS = ("ghp_", "gho_", "glpat-", "xoxb-", "xoxp-", "sk_live_", "sk-", "eyJ")
TOKEN = re.compile(r"[A-Za-z0-9+/_.=-]{16,}")
_KEY = re.compile(rf"(?<![A-Za-z0-9])(?:{LISTED.pattern})")
# What stands before a password in a connection string; an @ stands after it.
LOGIN = re.compile(r"://[^\s/:@]*:$")

CHUNK = 6000  # found examples, about, that one copy of the network is trained on in a round
ROUNDS = 12
EXAMPLES = 4000  # found examples of a class from which on made-up ones weigh more in the calibration
CONTEXT = 24
INSIDE = 64  # code points of a candidate that one look sees; longer ones are looked at piece by piece
FILTERS, DEEP, WIDTH = 16, 8, 5
LOOKS = 4096  # inputs of the network held at once
RECALL = 0.95
MARGIN = 0.5  # in log-odds above every held-out negative
STEPS, FARTHEST = 256, 64  # raw scores are counted in steps of 1 / STEPS; those beyond FARTHEST count as it


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base findings; leftmost and non-overlapping per kind."""
    out: list[tuple[int, int, int]] = []
    lowered = text.lower()  # other letters may become a-z too; the pattern decides
    if any(n in lowered for n in NAMES):
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= 20]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def candidates(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """(start, end) of tokens that may be secrets and touch no base finding."""
    found = [m.span() for m in TOKEN.finditer(text) if re.search("[0-9]", m[0]) and re.search("[A-Za-z]", m[0])]
    if any(sign in text for sign in LISTED_SIGNS):
        found += [m.span() for m in LISTED.finditer(text)]
    starts, ends = [s for s, _, _ in base], list(accumulate((e for _, _, e in base), max))
    out: list[tuple[int, int]] = []
    for a, b in sorted(set(found)):
        before = bisect_left(starts, b)  # base findings that start before the token ends
        if (not before or ends[before - 1] <= a) and (not out or out[-1][1] <= a):
            out.append((a, b))
    return out


# Character classes: 64 common signs by themselves, other letters, other digits, the rest, and padding 0.
_CODES = np.full(128, 3, np.int64)
for _k, _c in enumerate(string.digits + string.ascii_letters + "+/_.=-\"':;,()<>[]{} \n#@"):
    _CODES[ord(_c)] = 4 + _k
N_CODES = 4 + len(string.digits + string.ascii_letters + "+/_.=-\"':;,()<>[]{} \n#@")


def _codes(text: str, size: int) -> list[int]:
    raw = np.array([ord(c) for c in text], np.int64)
    codes = np.where(raw < 128, _CODES[np.minimum(raw, 127)], 1)
    return [0] * (size - len(codes)) + codes.tolist()


def look(text: str, start: int, end: int) -> list[np.ndarray]:
    """The network's inputs for a candidate: left context, one piece of it, right context."""
    left = _codes(text[max(0, start - CONTEXT) : start], CONTEXT)
    right = _codes(text[end : end + CONTEXT][::-1], CONTEXT)[::-1]
    return [np.array(left + _codes(text[a:b][::-1], INSIDE)[::-1] + right) for a, b in pieces(start, end)]


def pieces(start: int, end: int) -> Iterator[tuple[int, int]]:
    """(start, end) of the pieces of a candidate; the last of several is as long as the others and overlaps."""
    for a in range(start, end, INSIDE):
        yield (a, min(a + INSIDE, end)) if end - start <= INSIDE else (min(a, end - INSIDE), min(a + INSIDE, end))


LEARNED = ("embed", "filters", "bias", "out")


class Network:
    """Embedding, convolution, maximum inside and outside the candidate, logistic output."""

    def __init__(self, seed: int = 3):
        rng = np.random.default_rng(seed)
        self.embed = rng.normal(0, 0.3, (N_CODES, DEEP))
        self.filters = rng.normal(0, 0.3, (WIDTH * DEEP, FILTERS))
        self.bias = np.zeros(FILTERS)
        self.out = rng.normal(0, 0.3, 2 * FILTERS + 1)
        self.mean, self.square = ({n: np.zeros_like(getattr(self, n)) for n in LEARNED} for _ in range(2))
        self.step = 0.0
        self.platt = np.array([1.0, 0.0])
        self.threshold = 0.5
        inside = np.zeros(2 * CONTEXT + INSIDE - WIDTH + 1, bool)
        inside[CONTEXT : CONTEXT + INSIDE - WIDTH + 1] = True
        self.parts = (np.flatnonzero(inside), np.flatnonzero(~inside))

    def _forward(self, x: np.ndarray):
        e = self.embed[x]
        view = np.lib.stride_tricks.sliding_window_view(e, WIDTH, axis=1).transpose(0, 1, 3, 2).reshape(len(x), -1, WIDTH * DEEP)
        a = np.maximum(view @ self.filters + self.bias, 0)
        places = [p[a[:, p].argmax(axis=1)] for p in self.parts]
        rows = np.arange(len(x))[:, None]
        h = np.concatenate([a[rows, at, np.arange(FILTERS)] for at in places] + [np.ones((len(x), 1))], axis=1)
        return view, places, h, h @ self.out

    def raw(self, x: np.ndarray) -> np.ndarray:
        return np.concatenate([self._forward(x[k : k + 256])[3] for k in range(0, len(x), 256)]) if len(x) else np.empty(0)

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.platt[0] * self.raw(x) + self.platt[1])))

    def _held(self) -> list[np.ndarray]:
        return [getattr(self, n) for n in LEARNED] + [part[n] for part in (self.mean, self.square) for n in LEARNED]

    def state(self) -> np.ndarray:
        """All that ``fit`` changes as one row of numbers: the weights, Adam's moments and its step."""
        return np.concatenate([a.ravel() for a in self._held()] + [np.array([self.step])])

    def restore(self, state: np.ndarray) -> None:
        at = 0
        for a in self._held():
            a[...] = state[at : at + a.size].reshape(a.shape)
            at += a.size
        self.step = float(state[-1])

    def fit(self, x: np.ndarray, y: np.ndarray, rounds: int = ROUNDS, rate: float = 0.01, seed: int = 5) -> None:
        """Adam on the logistic loss, classes weighted alike. It goes on from the moments and the step of earlier calls."""
        rng = np.random.default_rng(seed)
        weight = np.where(y == 1, 0.5 / max(y.mean(), 1e-9), 0.5 / max(1 - y.mean(), 1e-9))
        for _ in range(rounds):
            for part in np.array_split(rng.permutation(len(x)), max(1, len(x) // 64)):
                view, places, h, z = self._forward(x[part])
                d = (1 / (1 + np.exp(-z)) - y[part]) * weight[part] / len(part)
                g = {n: np.zeros_like(getattr(self, n)) for n in LEARNED}
                g["out"] = h.T @ d
                rows = np.arange(len(part))
                for side, at in enumerate(places):
                    for f in range(FILTERS):
                        alive = h[:, side * FILTERS + f] > 0
                        if not alive.any():
                            continue
                        up = d[alive] * self.out[side * FILTERS + f]
                        where = at[alive, f]
                        seen = view[rows[alive], where]
                        g["filters"][:, f] += seen.T @ up
                        g["bias"][f] += up.sum()
                        back = (up[:, None] * self.filters[:, f]).reshape(-1, WIDTH, DEEP)
                        np.add.at(g["embed"], x[part][rows[alive][:, None], where[:, None] + np.arange(WIDTH)], back)
                self.step += 1
                m, v = self.mean, self.square
                for n in LEARNED:
                    m[n] = 0.9 * m[n] + 0.1 * g[n]
                    v[n] = 0.999 * v[n] + 0.001 * g[n] ** 2
                    setattr(self, n, getattr(self, n) - rate * (m[n] / (1 - 0.9**self.step)) / (np.sqrt(v[n] / (1 - 0.999**self.step)) + 1e-8))

    def steps(self, x: np.ndarray) -> np.ndarray:
        """Raw scores, rounded down to whole steps."""
        return np.floor(np.clip(self.raw(x), -FARTHEST, FARTHEST) * STEPS).astype(np.int64)

    def calibrate(self, x: np.ndarray, y: np.ndarray) -> None:
        """Platt scaling and the decision threshold on held-out examples."""
        self.settle(self.steps(x), y, np.ones(len(y)))

    def settle(self, at: np.ndarray, y: np.ndarray, n: np.ndarray) -> None:
        """The same on counts: ``n`` held-out examples of class ``y`` have the score ``at``, in steps."""
        order = np.lexsort((y, at))
        z, y, n = at[order] / STEPS, y[order], n[order]
        a, b = 1.0, 0.0
        target = np.where(y == 1, (n[y == 1].sum() + 1) / (n[y == 1].sum() + 2), 1 / (n[y == 0].sum() + 2))
        share = n / n.sum()
        for _ in range(300):
            p = 1 / (1 + np.exp(-(a * z + b)))
            a, b = a - 0.05 * (share * (p - target) * z).sum(), b - 0.05 * (share * (p - target)).sum()
        self.platt = np.array([max(a, 1e-3), b])
        odds = self.platt[0] * z + self.platt[1]
        clear = odds[y == 0].max(initial=-9.0) + MARGIN
        lost = np.cumsum(n[y == 1]) - n[y == 1]  # positives below each
        reached = odds[y == 1][lost <= (1 - RECALL) * n[y == 1].sum()].max(initial=-np.inf) if (y == 1).any() else clear
        self.threshold = float(1 / (1 + np.exp(-min(reached, max(0.0, clear)))))


def made_up(rng: random.Random) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """(positive, negative) examples: keys of public formats in assignments; ids, paths, versions and words."""
    def pick(alphabet: str, n: int) -> str:
        return "".join(rng.choice(alphabet) for _ in range(n))

    alnum, yes, no = string.ascii_letters + string.digits, [], []
    words = lambda n: " ".join(pick(string.ascii_lowercase, rng.randint(2, 9)) for _ in range(n))
    for _ in range(1200):
        key = rng.choice([
            lambda: rng.choice(("ghp_", "gho_")) + pick(alnum, 36), lambda: "glpat-" + pick(alnum, 20),
            lambda: "xoxb-" + pick(string.digits, 12) + "-" + pick(alnum, 24), lambda: "sk_live_" + pick(alnum, 24),
            lambda: "eyJ" + pick(alnum, 20) + "." + pick(alnum, 40) + "." + pick(alnum, 30), lambda: pick(alnum + "+/", 40),
        ])()
        before = words(3) + " " + rng.choice(("auth", "key", "credentials", "bearer", "private_key", "access_key", "client_key")) + rng.choice((" = ", ": ", "=", ' = "', " "))
        yes.append((before + key + rng.choice(('"', "", "\n", " ")) + " " + words(3), len(before), len(before) + len(key)))
        plain = rng.choice([
            lambda: "/".join(pick(string.ascii_lowercase, rng.randint(3, 9)) for _ in range(4)) + pick(string.digits, 2),
            lambda: pick(string.ascii_lowercase, 12) + pick(string.digits, 5), lambda: "-".join(pick("0123456789abcdef", n) for n in (8, 4, 4, 4, 12)),
            lambda: pick(string.ascii_lowercase, 8) + "-" + ".".join(pick(string.digits, 2) for _ in range(4)) + ".tar.gz",
            lambda: pick(string.ascii_lowercase, rng.randint(9, 15)) + "." + pick(string.digits, 2) + "@" + pick(string.ascii_lowercase, 5) + ".com",
            lambda: pick(string.ascii_lowercase, rng.randint(3, 7)) + "." + pick(string.digits, 2) + "." + pick(string.ascii_lowercase, 7) + ".com",
            lambda: "20" + pick("012", 2) + "-0" + pick("123456789", 1) + "-1" + pick(string.digits, 1) + "T" + pick(string.digits, 6) + "Z",
            lambda: pick("=-_", 12) + pick(string.ascii_lowercase, 5) + pick(string.digits, 1),
        ])()
        plain, _, after = plain.partition("@")
        before = words(rng.randint(2, 5)) + rng.choice((" ", ", ", " (", "\n", ": ", "### ", "&&& "))
        after = (after and "@" + after) + rng.choice((" ", ".", ", ", "\n", "###")) + words(3)
        no.append((before + plain + after, len(before), len(before) + len(plain)))
    return yes, no


def connections(rng: random.Random) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """(positive, negative) examples: passwords in connection strings; users there, addresses of pages and files."""
    def pick(alphabet: str, n: int) -> str:
        return "".join(rng.choice(alphabet) for _ in range(n))

    low, alnum, yes, no = string.ascii_lowercase, string.ascii_letters + string.digits, [], []
    words = lambda n: " ".join(pick(low, rng.randint(2, 9)) for _ in range(n))
    host = lambda: pick(low, rng.randint(2, 8)) + rng.choice((".com/", ":5432/", "/", ".org:")) + pick(low, 4) + " "
    for _ in range(400):
        before = words(2) + " " + pick(low, rng.randint(3, 8)) + "://" + pick(low, rng.randint(3, 9)) + ":"
        key = rng.choice((
            lambda: pick(string.ascii_letters, rng.randint(8, 12)) + pick(string.digits, rng.randint(8, 10)),
            lambda: "".join(pick(low, rng.randint(4, 7)).title() for _ in range(2)) + pick(string.digits, rng.randint(6, 12)),
            lambda: pick(alnum, rng.randint(15, 39)) + pick(string.digits, 1) + pick(string.ascii_letters, 1),
        ))()
        yes.append((before + key + "@" + host() + words(3), len(before), len(before) + len(key)))
        before = words(2) + " " + rng.choice(("http:", "https:", "ftp:", pick(low, rng.randint(3, 8)) + ":"))
        plain = "//" + rng.choice(("", "www.")) + pick(low, rng.randint(5, 9)) + pick(string.digits, rng.randint(0, 2))
        plain += rng.choice((".com", ".org", ".example.com")) + "/" + pick(low, rng.randint(3, 9))
        plain += rng.choice(("/", "-", "_", "")) + pick(string.digits, rng.randint(1, 4)) + rng.choice(("", ".html", ".tar.gz", "/x"))
        after = rng.choice((" ", ".", ", ", "\n"))
        if rng.random() < 0.2:
            plain, after = "//" + pick(low, rng.randint(12, 16)) + pick(string.digits, 2), rng.choice(("@", ":" + pick(alnum, 6) + "@")) + host()
        no.append((before + plain + after + words(3), len(before), len(before) + len(plain)))
    return yes, no


def train(docs: DataFrame, seed: int = 11) -> Network:
    """The network from the findings of all documents and made-up ones. The driver gets sums of states and counts of scores."""
    context = docs.sparkSession.sparkContext
    yes, no = (a + b for a, b in zip(made_up(random.Random(seed)), connections(random.Random(seed))))
    x = np.array([look(t, a, b)[0] for t, a, b in yes + no], np.uint8)
    y = np.array([1.0] * len(yes) + [0.0] * len(no))
    held = np.array([int(hashlib.sha256(t.encode()).hexdigest(), 16) % 4 == 0 for t, _, _ in yes + no])
    # Examples are cut where the texts lie; only the short contexts move. Equal ones, as of repeated rows, count once.
    texts = docs.select("text").where(F.length("text") > 0)
    found = texts.mapInArrow(_examples, "text string, start int, end int, yes int").distinct()
    found = common.stage(found.mapInArrow(_coded, "codes binary, yes int"), "findings")
    last = F.pmod(F.xxhash64("codes"), F.lit(4)) == 0
    chunks = max(1, -(-found.where(~last).count() // CHUNK))
    # Dealt once; the rounds read the chunks where they lie.
    dealt = found.where(~last).withColumn("chunk", F.pmod(F.xxhash64("codes", "yes", F.lit("chunk")), F.lit(chunks)))
    dealt = dealt.repartition("chunk").persist()
    network, made = Network(), context.broadcast((x[~held], y[~held]))
    for k in range(ROUNDS):
        moved = dealt.groupBy("chunk").applyInArrow(_moved(network.state(), made, k), STATE).mapInArrow(_summed, STATE).collect()
        if moved:
            network.restore(sum(np.frombuffer(r.state) for r in moved) / sum(r.n for r in moved))
        else:
            network.fit(x[~held], y[~held], rounds=1, seed=k)
    dealt.unpersist()
    scores = found.where(last).mapInArrow(_scored(context.broadcast(network)), "at long, yes int").groupBy("at", "yes").count()
    real = [(r["at"], r["yes"], r["count"]) for r in scores.collect()]
    total = Counter()
    for _, label, n in real:
        total[label] += n
    beside = [max(1.0, 4 * total[label] / EXAMPLES) for label in (0, 1)]  # a quarter of all is held out
    counts = real + [(at, int(label), beside[int(label)]) for at, label in zip(network.steps(x[held]).tolist(), y[held].tolist())]
    network.settle(*(np.array(c, t) for c, t in zip(zip(*counts), (np.int64, np.int64, float))))
    return network


STATE = "state binary, n long"


def _sights(codes: pa.Array | pa.ChunkedArray) -> np.ndarray:
    return np.frombuffer(b"".join(codes.to_pylist()), np.uint8).reshape(-1, 2 * CONTEXT + INSIDE)


def _moved(state: np.ndarray, made, k: int):
    """One pass of a copy of the network over a chunk and the made-up examples: its state, times the chunk's examples."""

    def run(chunk: pa.Table) -> pa.Table:
        chunk = chunk.sort_by([("codes", "ascending"), ("yes", "ascending")])
        network, n = Network(), chunk.num_rows
        network.restore(state)
        x, y = made.value
        network.fit(np.concatenate([x, _sights(chunk["codes"])]), np.concatenate([y, chunk["yes"].to_numpy()]), rounds=1, seed=k)
        return pa.table({"state": [(n * network.state()).tobytes()], "n": [n]})

    return run


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The sum of a task's states, so the driver gets one of each task."""
    state, n = 0.0, 0
    for batch in batches:
        for r in batch.to_pylist():
            state, n = state + np.frombuffer(r["state"]), n + r["n"]
    if n:
        yield pa.RecordBatch.from_pydict({"state": [state.tobytes()], "n": [n]})


def _coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Examples as the network's inputs, a byte for each code."""
    for batch in batches:
        columns = batch.to_pydict()
        codes = [look(*e)[0].astype(np.uint8).tobytes() for e in zip(columns["text"], columns["start"], columns["end"])]
        yield pa.RecordBatch.from_arrays([pa.array(codes, pa.binary()), batch["yes"]], ["codes", "yes"])


def _scored(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(shared.value.steps(_sights(batch["codes"]))), batch["yes"]], ["at", "yes"])

    return run


def _unlabelled(text: str, a: int, b: int) -> bool:
    """Whether a candidate without a base finding looks like a secret all the same, so it is no negative example."""
    if _KEY.search(text[a:b]):
        return True
    return text[b : b + 1] == "@" and LOGIN.search(text[max(0, a - CONTEXT) : a]) is not None


def _labelled(text: str) -> Iterator[tuple[str, int, int, int]]:
    base = base_spans(text)
    # What an assignment gives is its second group.
    spans = [(*(ASSIGN.match(text, a).span(2) if kind == 0 else (a, b)), 1) for a, kind, b in base]
    others = ((a, b, 0) for a, b in candidates(text, base) if not _unlabelled(text, a, b))
    for a, b, label in (*spans, *others):
        left, right = text[max(0, a - CONTEXT) : a], text[b : b + CONTEXT]
        for at, to in pieces(a, b):
            yield left + text[at:to] + right, len(left), len(left) + to - at, label


def _examples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Labelled findings with their context only: base findings are positive, the other candidates negative, if nothing
    speaks for them. A long finding is as many examples as the network takes looks at it."""
    for batch in batches:
        for _, texts in wordhash.slices(batch.column(0)):
            found = (e for text in texts.to_pylist() for e in _labelled(text))
            while rows := list(islice(found, LOOKS)):
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.string(), *[pa.int32()] * 3))],
                                                 ["text", "start", "end", "yes"])


SCHEMA = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"


def sure_spans(network: Network, texts: list[str], bases: list[list[tuple[int, int, int]]]) -> list[set[tuple[int, int, int]]]:
    """Per text the candidates that the network is sure of; it is given ``LOOKS`` inputs at a time, however many there are."""
    sure: list[set[tuple[int, int, int]]] = [set() for _ in texts]
    inputs = ((x, row, a, b) for row, (text, base) in enumerate(zip(texts, bases)) for a, b in candidates(text, base) for x in look(text, a, b))
    while part := list(islice(inputs, LOOKS)):
        hits = network.score(np.array([p[0] for p in part])) >= network.threshold
        for (_, row, a, b), hit in zip(part, hits.tolist()):
            if hit:
                sure[row].add((a, 3, b))
    return sure


def _joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def _find(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        network = shared.value
        for batch in batches:
            for at, texts in wordhash.slices(batch.column(1)):
                texts = texts.to_pylist()
                bases = [base_spans(t) for t in texts]
                spans = [sorted({*b, *sure}) for b, sure in zip(bases, sure_spans(network, texts, bases))]
                yield pa.RecordBatch.from_pydict({
                    "doc_id": batch.column(0).slice(at, len(texts)),
                    **{f"n_{kind}": pa.array([sum(k == of for _, k, _ in b) for b in bases], pa.int64()) for of, kind in enumerate(KINDS[:3])},
                    "base_sha256": [hashlib.sha256(_joined(b).encode()).hexdigest() for b in bases],
                    "spans": [_joined(s) for s in spans],
                })

    return run


def find(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, counts of base findings, their digest, and all spans as kind:start:end by start."""
    network = docs.sparkSession.sparkContext.broadcast(train(docs))
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_find(network), SCHEMA)
