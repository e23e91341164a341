"""Spelling variants, ranked search and repeated passages against plain versions."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from filelake.llm import ranking, repeats, variants
from filelake.llm.queries import QUERIES

ASCII_LOWER = {x: x + 32 for x in range(65, 91)}


def table(spark, rows, key="doc_id"):
    return spark.createDataFrame(rows, f"{key} long, text string")


# 11 --------------------------------------------------------------------------------------------------------------

def one_edit(a: str, b: str) -> bool:
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    k = next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    return a[k + (len(a) == len(b)):] == b[k + 1:]


def plain_variants(rows):
    counts = Counter()
    for d, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(ASCII_LOWER)
            if len(run) < 7:
                continue
            h = zlib.crc32(f"{'' if d is None else d}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    counts = {w: n for w, n in counts.items() if n >= 2 and len(w) >= 7}
    by_less = defaultdict(set)
    for w in counts:
        for k in range(len(w)):
            by_less[w[:k] + w[k + 1 :]].add(w)
        by_less[w].add(w)
    near = {w: set() for w in counts}
    for same in by_less.values():
        for a in same:
            near[a] |= {b for b in same if a != b and one_edit(a, b)}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda x: (-counts[x], x), default=None)
        form[w] = best if best and counts[best] >= 10 * counts[w] else None

    def root(w):
        while form[w]:
            w = form[w]
        return w

    return {(w, form[w], root(w), n, len(near[w]), counts[form[w]] if form[w] else None) for w, n in counts.items()}


def rows_of(df):
    return [tuple(r[c] for c in ("word", "form", "root", "n", "n_near", "form_n")) for r in df.collect()]


def test_variants(spark, corpus, rows):
    out = rows_of(QUERIES["op11_prefix_suffix_variants"](spark, corpus))
    assert len(out) == len(set(out)) and set(out) == plain_variants(rows)


@pytest.mark.parametrize("block", [8, 4096])
def test_variants_in_one_and_many_blocks(spark, monkeypatch, block):
    """Groups cut into block pairs, long and accented words, chains of forms."""
    monkeypatch.setattr(variants, "BLOCK", block)
    rng = random.Random(3)
    bases = ["prefixes" + "".join(rng.choice("abcé") for _ in range(rng.randint(0, 4))) for _ in range(150)]
    bases += ["".join(rng.choice("xyÿ") for _ in range(7)) for _ in range(200)] + ["q" * 700, "q" * 701, "q" * 699 + "r"]
    words = [w for w in bases for _ in range(rng.choice([1, 2, 3, 30]))] + ["startlings"] * 3 + ["startling"] * 40 + ["startlin"] * 900
    rng.shuffle(words)
    rows = [(k, " ".join(words[k * 40 : k * 40 + 40])) for k in range(-(-len(words) // 40))] + [(None, "Startling prefixes"), (7, None)]
    out = rows_of(variants.variants(table(spark, rows)))
    assert len(out) == len(set(out)) and set(out) == plain_variants(rows)
    assert {r[0]: r[2] for r in out}["startlings"] == "startlin"


# 12 --------------------------------------------------------------------------------------------------------------

def plain_ranks(docs, items, k=50):
    found = lambda text: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(ASCII_LOWER))
    terms = [(d, Counter(found(t))) for d, t in docs]
    terms = [(d, c) for d, c in terms if c]
    n, length, df = len(terms), sum(sum(c.values()) for _, c in terms), Counter(t for _, c in terms for t in c)
    out = Counter()
    for item, text in items:
        scores = []
        for d, c in terms:
            m = 50 + (50 * sum(c.values()) * n) // length
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 20 * m))
                        for t in set(found(text)) if t in c)
            if score:
                scores.append((-score, d is not None, d or 0, d))
        for rank, (score, _, _, d) in enumerate(sorted(scores)[:k]):
            out[(item, rank + 1, d, -score)] += 1
    return out


def ranks(df):
    return Counter((r.item_id, r["rank"], r.doc_id, r.score) for r in df.collect())


def test_ranks(spark, corpus, rows):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{corpus}/benchmark.parquet").collect()]
    assert ranks(QUERIES["op12_hybrid_ranked_search"](spark, corpus)) == plain_ranks(rows, items)


@pytest.mark.parametrize("block, stretch, short, at_once", [(1 << 9, 4, 4, 5), (1 << 14, 16, 10**9, 1 << 20), (1 << 20, 8, 1, 40)])
def test_ranks_in_blocks_with_ties(spark, monkeypatch, block, stretch, short, at_once):
    for name, value in (("BLOCK_BYTES", block), ("STRETCH", stretch), ("SHORT", short), ("TERMS_AT_ONCE", at_once)):
        monkeypatch.setattr(ranking, name, value)
    rng = random.Random(5)
    vocabulary = [f"w{int(rng.paretovariate(0.7))}" for _ in range(3000)]
    docs = [(rng.randint(0, 300), " ".join(rng.choices(vocabulary, k=rng.randint(0, 25)))) for _ in range(400)] + [(None, "w1 w2"), (None, "W1 w2")]
    items = [(k, " ".join(rng.choices(vocabulary, k=rng.randint(1, 12)))) for k in range(25)] + [(3, "w1 w1 w2"), (None, "w1")]
    index = ranking.build_index(table(spark, docs).repartition(3))
    assert ranks(ranking.search(index, table(spark, items, "item_id"), 7)) == plain_ranks(docs, items, 7)


def test_hybrid_skips(monkeypatch):
    """Stretches whose bounds stay below the k-th best are not summed."""
    docs, gains = np.arange(1000), np.ones(1000, np.int64)
    gains[:10] = 100
    tops = gains.reshape(-1, 10).max(axis=1)
    best = ranking.Best(5)
    seen = []
    add = best.add
    monkeypatch.setattr(best, "add", lambda s, i: (seen.append(len(s)), add(s, i)))
    ranking.hybrid([(docs, gains, tops)], docs, best, 10)
    assert seen == [10] and best.ids.tolist() == [0, 1, 2, 3, 4]


# 13 --------------------------------------------------------------------------------------------------------------

def plain_repeats(rows, depth=13):
    words = [(d, re.findall(r"[^\x20\x09-\x0D]+", text or "")) for d, text in rows]
    least = {}
    for d, w in words:
        for p in range(len(w) - depth + 1):
            if d is not None:
                g = tuple(w[p : p + depth])
                least[g] = min(d, least.get(g, d))
    out = Counter()
    for d, w in words:
        gone = set()
        for p in range(len(w) - depth + 1):
            if d is not None and least[tuple(w[p : p + depth])] < d:
                gone |= set(range(p, p + depth))
        out[(d, len(w), len(gone), hashlib.sha256(" ".join(x for k, x in enumerate(w) if k not in gone).encode()).hexdigest())] += 1
    return out


def test_repeats(spark, corpus, rows):
    out = QUERIES["op13_suffix_tree_repeats"](spark, corpus)
    assert Counter(tuple(r) for r in out.select("doc_id", "n_words", "n_removed", "kept_sha256").collect()) == plain_repeats(rows)


@pytest.mark.parametrize("piece, groups", [(1 << 10, 4), (1 << 12, 1 << 20), (1 << 22, 4)])
def test_repeats_in_pieces_and_groups(spark, monkeypatch, piece, groups):
    """Passages, copies, copies of copies and texts of one word over and over, in small pieces and with long prefixes."""
    monkeypatch.setattr(repeats, "PIECE_BYTES", piece)
    monkeypatch.setattr(repeats, "GROUPS", groups)
    rng = random.Random(11)
    passages = [" ".join(rng.choices("a b c d é 漢  x".split(" "), k=rng.randint(10, 60))) for _ in range(12)]
    rows = []
    for _ in range(250):
        d = rng.choice([None, *range(200)])
        parts = [rng.choice(passages) if rng.random() < 0.5 else " ".join(rng.choices("p q r s t u v w y z".split(), k=rng.randint(0, 20))) for _ in range(4)]
        rows.append((d, rng.choice([" ", "\n", "  \t"]).join(parts)))
    rows += [(rng.randint(0, 400), rng.choice(rows)[1]) for _ in range(60)]
    rows += [(500, "go " * 40), (501, "go " * 30), (502, "go go"), (499, " ".join(["go"] * 12)), (503, None), (504, "")]
    out = repeats.without_repeats(table(spark, rows).repartition(5))
    got = Counter((r.doc_id, r.n_words, r.n_removed, hashlib.sha256(r.kept.encode()).hexdigest()) for r in out.collect())
    assert got == plain_repeats(rows)


def test_deep_nodes():
    symbols = np.array([[1, 2, 3], [1, 2, 4], [1, 2, 3], [1, 2, 3]], np.uint16)
    order, new = repeats.deep_nodes(symbols, np.array([7, 8, 7, 9], np.uint64), 3)
    assert symbols[order].tolist() == [[1, 2, 3]] * 3 + [[1, 2, 4]] and new.tolist() == [True, False, True, True]
