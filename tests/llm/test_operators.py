"""Each operator's query against a plain version over whole texts, and on an empty table."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from filelake.llm import encoding, imatch, jaccard, licenses, packing, personal_data, quality, secret_spans, simple8b, transducer
from filelake.llm.queries import QUERIES

SPACE = "\x20\x09-\x0d"


def by_id(df):
    out = defaultdict(list)
    for r in df.collect():
        out[r.doc_id].append(r)
    return out


def check(df, rows, answer):
    """Every row of the table is answered, equal rows alike."""
    got = by_id(df)
    want = Counter(d for d, _ in rows)
    assert {d: len(x) for d, x in got.items()} == dict(want)
    for d, text in rows:
        for r in got[d]:
            answer(text, r)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_empty_tables(spark, empty, name):
    assert QUERIES[name](spark, empty).count() == 0


# 1 ---------------------------------------------------------------------------------------------------------------

def test_fingerprints_against_edits(spark, corpus, rows):
    order = sorted(rows)
    got = by_id(QUERIES["op1_imatch_fingerprints"](spark, corpus))
    assert sum(map(len, got.values())) == len(rows)
    prints = {}
    for k, (d, text) in enumerate(order):
        following = order[(k + 1) % len(order)][1]
        n = len(text) // 4
        want = hashlib.sha256((text[: len(text) - n] + following[:n]).encode()).hexdigest()
        assert want in {r.edited_sha256 for r in got[d]}
        assert {r.n_chars for r in got[d]} == {len(text)}
        assert len({r.fingerprint for r in got[d]}) == 1
        assert prints.setdefault(text, got[d][0].fingerprint) == got[d][0].fingerprint
    all_of = [r for x in got.values() for r in x]
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in all_of)
    assert np.mean([r.near_edited for r in all_of]) > 0.4 > 0.15 > np.mean([r.near_next for r in all_of if r.doc_id < 200])


def test_lexicon_band_and_likeness(spark):
    docs = spark.createDataFrame([(k, f"the common{k % 2} pair{k // 2} lone{k}") for k in range(64)], "doc_id long, text string")
    lexicon = imatch.build_lexicon(docs, 0.2, 0.9)
    inside = lambda w: bool(lexicon.member(__import__("filelake.llm.wordhash", fromlist=["x"]).words(pa.array([w]))[0])[0])
    assert not inside("the") and inside("pair7") and inside("PAIR7") and not inside("lone7")
    a, b = imatch.fingerprints(pa.array(["u v w x y z a b c d e f", ""]), lexicon)
    assert imatch.likeness(a, a) == 1.0 and imatch.likeness(a, b) == 0.0


def test_lexicon_holds_its_terms_and_few_others(spark):
    """Every term of the band by plain counting is in; the filter grows with them and lets hardly any other pass."""
    from filelake.llm import wordhash

    texts = [" ".join(f"w{(k * 97 + i) % 40_000}" for i in range(260)) + f" the lone{k}" for k in range(400)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    lexicon = imatch.build_lexicon(docs, 0.2, 0.95)
    df = Counter(w for t in texts for w in set(t.split()))
    band = {w for w, n in df.items() if 0.2 <= np.log(400 / n) / np.log(400) <= 0.95}
    inside = lexicon.member(wordhash.words(pa.array([" ".join(sorted(band))]))[0])
    assert inside.all() and len(band) > 20_000 and len(lexicon.table) * 256 >= 16 * len(band)
    others = [*(w for w in df if w not in band), *(f"x{k}" for k in range(50_000))]
    assert lexicon.member(wordhash.words(pa.array([" ".join(others)]))[0]).mean() < 0.005


def plain_fingerprint(text, band):
    """Level and codes by the method's description, term by term."""
    from filelake.llm import wordhash

    def h(x):
        return int(wordhash.mix(np.array([x & (2**64 - 1)], np.uint64))[0])

    words = sorted({w.translate({c: c + 32 for c in range(65, 91)}) for w in re.findall(f"[^{SPACE}]+", text)})
    terms = [w for w in words if w in band]
    terms = words if len(terms) < imatch.FEWEST else terms
    level = max(0, int(np.ceil(np.log2(max(len(terms), 1) / 2) / 2)))
    numbers = [int(wordhash.words(pa.array([w]))[0][0]) for w in terms]
    out = []
    for depth in (level, level + 1):
        for r in range(1, imatch.REPEATS + 1):
            chosen = [n for n in (h(x ^ h(r << 32)) for x in numbers) if n >> (64 - 2 * depth) == 0 or depth == 0]
            code = sum(map(h, chosen)) % 2**64
            out.append(0 if code == 0 else 1 + h(code) % 65535)
    return f"{level:x}:" + "".join(f"{c:04x}" for c in out)


def test_fingerprints_equal_the_plain_method(spark):
    rng = np.random.default_rng(3)
    texts = [" ".join(f"W{w}" for w in rng.zipf(1.3, int(n)) % 5000) for n in rng.integers(0, 400, 60)] + ["", "one", " \t ", "a b c d e f g h i"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    lexicon = imatch.build_lexicon(docs)
    df = Counter(w for t in texts for w in set(t.lower().split()))
    band = {w for w, n in df.items() if 0.2 <= np.log(len(texts) / n) / np.log(len(texts)) <= 0.95}
    from filelake.llm import wordhash

    leaked = {w for w in df if w not in band and lexicon.member(wordhash.words(pa.array([w]))[0])[0]}
    got = imatch.fingerprints(pa.array(texts), lexicon)
    assert got == [plain_fingerprint(t, band | leaked) for t in texts] and len(leaked) <= 0.01 * len(df) + 3


# 2 ---------------------------------------------------------------------------------------------------------------

def plain_quality(x):
    w = re.findall(f"[^{SPACE}]+", x)
    win = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    n = Counter(win)
    covered = {p for i, v in enumerate(win) if n[v] > 1 for p in range(i, i + 5)}
    lines = [z for z in x.split("\n") if re.search(f"[^{SPACE}]", z)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", x)), len(lines) - len(set(lines)), len(covered)


def test_quality(spark, corpus, rows):
    def answer(text, r):
        base = plain_quality(text)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == base
        assert r.base_failed == (base[0] < 10 or 100 * base[4] > 20 * base[0])
        assert not (r.base_failed and r.kept)

    check(QUERIES["op2_decision_list"](spark, corpus), rows, answer)


def test_quality_on_labelled_documents(spark):
    """Four hundred labels: enough for rules to be grown and pruned on."""
    folder = "/root/testdata/sf0.01"
    kept = {r.doc_id for r in QUERIES["op2_decision_list"](spark, folder).where("kept").collect()}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    good = [d in kept for d, q in labels.items() if q == 1]
    bad = [d in kept for d, q in labels.items() if q == 0]
    assert np.mean(good) > 0.9 and np.mean(bad) < 0.2


def test_decision_list_learns_a_conjunction(spark):
    r = random.Random(4)
    rows = [(k, *(r.random() for _ in quality.FEATURES), 100, 0) for k in range(900)]
    stats = spark.createDataFrame(rows, "doc_id long, " + ", ".join(f"{f} double" for f in quality.FEATURES) + ", n_words long, n_repeat_words long")
    labels = stats.selectExpr("doc_id", "cast(not (symbols_per_word > 0.5 and upper_share > 0.6) as int) as quality")
    rules = quality.learn(stats, labels)
    marked = stats.join(labels, "doc_id").select("quality", quality.verdict(rules).alias("kept")).collect()
    assert np.mean([x.kept == (x.quality == 1) for x in marked]) > 0.95
    assert quality.learn(stats, labels.where("quality = 1")) == []


# 3 and 8 -----------------------------------------------------------------------------------------------------------

@pytest.fixture(scope="module")
def ids(rows):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(encoding.default_tokenizer())
    tokenizer.encode_special_tokens = True
    return {t: np.array([*tokenizer.encode(t, add_special_tokens=False).ids, 2], "<u4") for _, t in rows}


@pytest.mark.parametrize("high", [2, 17, 50_257, 1 << 32, 1 << 63])
def test_simple8b_round_trip(high):
    rng = np.random.default_rng(high % 97)
    for n in (0, 1, 5, 121, 3000):
        x = rng.integers(0, high, n).astype(np.uint64)
        x[rng.random(n) < 0.3] = 0
        words = simple8b.encode(x)
        assert (simple8b.decode(words, n) == x).all() and len(words) <= max(1, 2 * n)


def test_token_files(spark, corpus, rows, ids):
    at = 0
    got = by_id(QUERIES["op3_simple8b_files"](spark, corpus))
    assert sum(map(len, got.values())) == len(rows)
    for d, text in sorted(rows):
        own = ids[text]
        assert (at, len(own), zlib.crc32(own)) in {(r.start, r.n_tokens, r.ids_crc32) for r in got[d]}
        at += len(own)


def test_packing(spark, corpus, rows, ids):
    out = QUERIES["op8_best_fit_packing"](spark, corpus).collect()
    texts = dict(rows)
    sequences, lengths = defaultdict(list), Counter()
    for r in out:
        own = ids[texts[r.doc_id]]
        assert zlib.crc32(own[r.start : r.start + r.length]) == r.ids_crc32
        assert r.length == 1024 or r.piece == 0
        sequences[r.sequence_id].append((r.offset, r.length))
        lengths[r.doc_id] += r.length
    assert lengths == {d: len(ids[t]) * n for (d, t), n in Counter(rows).items()}
    for s in sequences.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at
            at += length
        assert at <= 1024
    assert len(sequences) <= 1 + 1.02 * sum(lengths.values()) / 1024


def plain_best_fit(lengths, capacity):
    """How full each bin is after best fit decreasing, piece by piece."""
    left: list[int] = []
    for n in sorted(lengths, reverse=True):
        fits = [(x, k) for k, x in enumerate(left) if x >= n]
        if not fits:
            left.append(capacity)
            fits = [(capacity, len(left) - 1)]
        left[min(fits)[1]] -= n
    return sorted(left)


def test_packing_makes_the_sequences_of_one_best_fit(spark, corpus):
    out = QUERIES["op8_best_fit_packing"](spark, corpus).select("sequence_id", "length").collect()
    used = Counter()
    for r in out:
        used[r.sequence_id] += r.length
    assert sorted(1024 - n for n in used.values()) == plain_best_fit([r.length for r in out], 1024)


def test_repeated_rows_have_ranks_of_their_own(spark):
    docs = spark.range(200).selectExpr("7L as doc_id", "'one text for all' as text")
    made = packing.pieces(docs, encoding.default_tokenizer())
    assert made.count() == 200 and made.select("task_", "length", "rank_").distinct().count() == 200


@pytest.mark.parametrize("seed", range(6))
def test_best_fit_takes_the_tightest_bin(seed):
    r = random.Random(seed)
    lengths = [min(100, 1 + int(r.expovariate(1 / (5 + 12 * seed)))) for _ in range(700)] + [33] * 90
    counts = Counter(lengths)
    bins: dict[int, list] = defaultdict(list)
    runs = packing.best_fit_runs(counts, 100)
    for at, (length, rank, each, first, offset) in enumerate(runs.tolist()):
        to = runs[at + 1, 1] if at + 1 < len(runs) and runs[at + 1, 0] == length else counts[length]
        for k in range(int(to) - rank):
            bins[first + k // each].append((offset + k % each * length, length))
    assert Counter(n for b in bins.values() for _, n in b) == counts
    for b in bins.values():
        ends = [x + n for x, n in sorted(b)]
        assert [x for x, _ in sorted(b)] == [0, *ends[:-1]] and ends[-1] <= 100
    assert sorted(100 - sum(n for _, n in b) for b in bins.values()) == plain_best_fit(lengths, 100)


# 4 ---------------------------------------------------------------------------------------------------------------

def plain_personal(x):
    out = [(0, *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", x)]
    out += [(1, *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", x) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", x):
        g = re.sub("[^0-9]", "", m[0])
        if 16 <= len(g) <= 19 and sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(g[::-1])) % 10 == 0:
            out.append((2, *m.span()))
    out += [(3, *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", x) if 8 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return sorted(out)


def test_personal_data(spark, corpus, rows):
    def answer(text, r):
        base = plain_personal(text)
        digest = ",".join(f"{personal_data.KINDS[k]}:{a}:{b}" for k, a, b in base)
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(k == at for k, *_ in base) for at in range(4))
        assert r.base_sha256 == hashlib.sha256(digest.encode()).hexdigest()
        spans = r.spans.split(",") if r.spans else []
        assert {*digest.split(",")} - {""} <= {*spans}
        order = [(personal_data.KINDS.index(k), int(a)) for k, a, _ in (s.split(":") for s in spans)]
        assert order == sorted(order)
        if not re.search("[0-9@]", text):
            assert not spans

    df = QUERIES["op4_weak_supervision_pii"](spark, corpus)
    check(df, rows, answer)
    more = df.where("doc_id = 1014").first().spans.split(",")
    assert "email:0:25" in more


def test_masking(spark, corpus, rows):
    docs = spark.read.parquet(f"{corpus}/documents.parquet")
    out = personal_data.mask(docs)
    assert out.columns == docs.columns
    for r in out.collect():
        assert r.text is None or (not plain_personal(r.text) and r.n_chars == len(r.text))
    before = Counter(t for _, t in rows if not re.search("[0-9@]", t))
    after = Counter(r.text or "" for r in out.collect())
    assert all(after[t] >= n for t, n in before.items())


def test_cards_in_groups_of_any_size(spark):
    texts = ["card 411 111 111 111 111 1 end", "4-1-1-1-1-1-1-1-1-1-1-1-1-1-1-1", "41 11-11 11 11 11-11 11", "411 111 111 111 111 2"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in personal_data.find(docs).collect():
        base = plain_personal(texts[r.doc_id])
        digest = ",".join(f"{personal_data.KINDS[k]}:{a}:{b}" for k, a, b in base)
        assert r.n_card == len(base) == (r.doc_id < 3) and r.base_sha256 == hashlib.sha256(digest.encode()).hexdigest()
        assert {*digest.split(",")} - {""} <= {*r.spans.split(",")}
    masked = {r.doc_id: r.text for r in personal_data.mask(docs).collect()}
    assert masked == {0: "card [CARD] end", 1: "[CARD]", 2: "[CARD]", 3: texts[3]}


def test_reliabilities_recover_labelers():
    r = random.Random(5)
    patterns = Counter()
    for _ in range(4000):
        truth = r.random() < 0.6
        votes = tuple((int(truth) if r.random() < good else int(not truth)) if r.random() < 0.8 else 2 for good in (0.95, 0.9, 0.8, 0.85, 0.7, 0.9))
        patterns[votes] += 1
    models = personal_data.reliabilities([(0, v, (0,) * personal_data.N_FEATURES, n) for v, n in patterns.items()])
    prior, yes, no = models[0]
    assert abs(prior - 0.6) < 0.06 and abs(yes[0][1] / (yes[0][0] + yes[0][1]) - 0.95) < 0.04 and yes[4][1] < yes[0][1]


# 5 ---------------------------------------------------------------------------------------------------------------

def plain_secrets(x):
    either = lambda w: "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in w)
    names = "|".join([either("password"), either("passwd"), either("secret"), either("token"), either("api") + "_?" + either("key")])
    out = [(m.start(), 0, m.end()) for m in re.finditer(f"({names})" + "[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", x) if len(m[2]) >= 6]
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", x) if len(m[0]) >= 20]
    return sorted(out + [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", x) if len(m[0]) >= 24])


@pytest.fixture(scope="module")
def network(spark, corpus):
    return secret_spans.train(spark.read.parquet(f"{corpus}/documents.parquet"))


def test_loose_spans_beside_base_spans(spark):
    """The kept spans are those of the plain rule (no overlap with any base span), for arrays of any shape."""
    r = random.Random(8)
    rows = []
    for n in (0, 1, 2, 5, 40, 300):
        spans = [(r.randint(0, 3), a, a + r.randint(1, 9), r.random() < 0.4) for a in (r.randint(0, 6 * n) for _ in range(n))]
        rows.append(([(k, a, b, "x" * (b - a), "", base, not base or r.random() < 0.5) for k, a, b, base in spans],))
    schema = "cs array<struct<kind:int,start:int,end:int,match:string,before:string,base:boolean,loose:boolean>>"
    weights = {k: [10.0] + [0.0] * personal_data.N_FEATURES for k in range(4)}
    got = spark.createDataFrame(rows, schema).select("cs", personal_data.spans(F.col("cs"), weights).alias("s")).collect()
    assert len(got) == len(rows)
    for cs, s in got:
        base = [c for c in cs if c.base]
        assert [tuple(c) for c in s] == sorted(
            tuple(c) for c in cs if c.base or not any(b.start < c.end and c.start < b.end for b in base))


def test_secrets(spark, corpus, rows):
    def answer(text, r):
        base = plain_secrets(text)
        digest = ",".join(f"{secret_spans.KINDS[k]}:{a}:{b}" for a, k, b in base)
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(k == at for _, k, _ in base) for at in range(3))
        assert r.base_sha256 == hashlib.sha256(digest.encode()).hexdigest()
        assert {*digest.split(",")} - {""} <= {*r.spans.split(",")}

    check(QUERIES["op5_secret_network"](spark, corpus), rows, answer)


def test_network_on_held_out_examples(network):
    yes, no = secret_spans.made_up(random.Random(1234))
    hit = [network.score(np.array([secret_spans.look(*e)[0] for e in part])) >= network.threshold for part in (yes, no)]
    assert hit[0].mean() > 0.95 and hit[1].mean() < 0.01


def test_passwords_in_connection_strings(spark):
    keys = ["LongPassw0rd12345678", "xK3vQ9pLm2Zt7RbW4nYs", "Winter2024Harbour8812"]
    texts = [f"the service reads postgres://loader:{k}@db.example.com/main at start" for k in keys]
    texts += [f"write to {a} about it" for a in ("margaret.holloway.77@example.com", "jonathan.winter.12@mail.example.org", "k@archive-node07.example.com")]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.spans for r in secret_spans.find(docs).collect()}
    for k, key in enumerate(keys):
        at = texts[k].index(key)
        assert got[k] == f"model:{at}:{at + len(key)}"
    assert [got[k] for k in (3, 4, 5)] == [""] * 3


def test_threshold_is_bound_by_recall(monkeypatch):
    net = secret_spans.Network()
    r = np.random.default_rng(3)
    y = np.array([0.0] * 4000 + [1.0] * 400)  # few positives that negatives surround
    z = np.where(y == 1, r.normal(1, 1, len(y)), r.normal(0, 1, len(y)))
    monkeypatch.setattr(net, "raw", lambda x: z)
    net.calibrate(z, y)
    assert (net.score(z) >= net.threshold)[y == 1].mean() >= secret_spans.RECALL and net.threshold < 0.5


def test_keys_are_no_negative_examples():
    text = "see ghp_abcdefghij0123456789ABCDEFGHIJ012345 and path/of/things/risk-file-number-12 here"
    out = next(secret_spans._examples(iter([pa.RecordBatch.from_pydict({"text": [text]})])))
    seen = [(x["text"][x["start"] : x["end"]], x["yes"]) for x in out.to_pylist()]
    assert seen == [("path/of/things/risk-file-number-12", 0)]


def test_secrets_of_a_text_with_very_many_tokens(monkeypatch):
    r = random.Random(3)
    words = ["".join(r.choices("abcdefgh0123456789XYZ", k=r.randint(3, 30))) for _ in range(3000)]
    texts = [" ".join(words[:2500]) + " token=abcdef123456", "", " ".join(words[2500:]), "deadbeef" * 4 + "0" * 9]
    bases = [secret_spans.base_spans(t) for t in texts]
    net = secret_spans.Network()
    whole = secret_spans.sure_spans(net, texts, bases)
    monkeypatch.setattr(secret_spans, "LOOKS", 7)
    held = []
    score = net.score
    monkeypatch.setattr(net, "score", lambda x: held.append(len(x)) or score(x))
    assert secret_spans.sure_spans(net, texts, bases) == whole and max(held) == 7
    for text, base in zip(texts, bases):
        for a, b in secret_spans.candidates(text, base):
            assert not any(s < b and a < e for s, _, e in base)


def test_network_gradient():
    net = secret_spans.Network()
    x = np.array([secret_spans.look(*e)[0] for e in sum(secret_spans.made_up(random.Random(7)), [])[::40]])
    y = np.array([1.0] * (len(x) // 2) + [0.0] * (len(x) - len(x) // 2))
    loss = lambda: float(np.mean(np.log1p(np.exp(-(2 * y - 1) * net.raw(x)))))
    before = loss()
    net.fit(x, y, rounds=20)
    assert loss() < 0.3 * before


@pytest.fixture(scope="module")
def findings(spark):
    """5000 documents with a finding each: secrets by the base patterns, and tokens that are none."""
    r = random.Random(12)
    pick = lambda alphabet, n: "".join(r.choice(alphabet) for _ in range(n))
    texts = [f"note {pick('ghijkl', 6)} " + (f"token = {pick('ABCDEFGHxyz0123456789', 24)}" if k % 2 else f"build-{pick('rstuv', 8)}-{pick('0123456789', 5)}") + " end"
             for k in range(5000)]
    texts = [*texts, None, "", texts[0]]
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), texts


def test_every_finding_of_all_documents_trains(spark, findings):
    """The network is that of a plain training on the findings of all documents, none of them left out."""
    docs, texts = findings
    found = set()
    for text in filter(None, texts):
        base = plain_secrets(text)
        for m in re.finditer(r"(?<=token = )[A-Z0-9a-z]{24}|build-[a-z]+-[0-9]+", text):
            found.add((text, m.start(), m.end(), int(bool(base))))
    assert len(found) == 5000
    coded = sorted((secret_spans.look(t, a, b)[0].astype(np.uint8).tobytes(), k) for t, a, b, k in found)
    frame = spark.createDataFrame([(bytearray(c), k) for c, k in coded], "codes binary, yes int")
    sides = {bytes(r.codes): r.last for r in frame.select("codes", (F.pmod(F.xxhash64("codes"), F.lit(4)) == 0).alias("last")).collect()}
    yes, no = (a + b for a, b in zip(secret_spans.made_up(random.Random(11)), secret_spans.connections(random.Random(11))))
    x, y = [np.array([secret_spans.look(*e)[0] for e in yes + no])], [np.array([1.0] * len(yes) + [0.0] * len(no))]
    last = np.array([int(hashlib.sha256(t.encode()).hexdigest(), 16) % 4 == 0 for t, _, _ in yes + no])
    fit_x = np.concatenate([x[0][~last], [list(c) for c, _ in coded if not sides[c]]])
    fit_y = np.concatenate([y[0][~last], [k for c, k in coded if not sides[c]]])
    plain = secret_spans.Network()
    for k in range(secret_spans.ROUNDS):
        plain.fit(fit_x, fit_y, rounds=1, seed=k)
    plain.calibrate(np.concatenate([x[0][last], [list(c) for c, _ in coded if sides[c]]]), np.concatenate([y[0][last], [k for c, k in coded if sides[c]]]))
    got = secret_spans.train(docs)
    for name in secret_spans.LEARNED:
        assert np.allclose(getattr(got, name), getattr(plain, name), atol=1e-6)
    assert np.allclose(got.platt, plain.platt, atol=1e-4) and abs(got.threshold - plain.threshold) < 1e-4


def test_network_of_many_chunks(findings, monkeypatch):
    monkeypatch.setattr(secret_spans, "CHUNK", 400)
    net = secret_spans.train(findings[0])
    for examples in (secret_spans.made_up(random.Random(77)), secret_spans.connections(random.Random(77))):
        hit = [net.score(np.array([secret_spans.look(*e)[0] for e in part])) >= net.threshold for part in examples]
        assert hit[0].mean() > 0.95 and hit[1].mean() < 0.01


def test_examples_of_long_findings_are_whole(monkeypatch):
    r = random.Random(5)
    token = "".join(r.choice("rstuvw-/0123456789") for _ in range(200)) + "a1"
    text = "see " + token + " or " + "deadbeef" * 20 + " end"
    monkeypatch.setattr(secret_spans, "LOOKS", 3)
    batches = list(secret_spans._examples(iter([pa.RecordBatch.from_pydict({"text": [text]})])))
    assert max(b.num_rows for b in batches) == 3
    got = [(tuple(secret_spans.look(e["text"], e["start"], e["end"])[0]), e["yes"]) for b in batches for e in b.to_pylist()]
    spans = ((4, 4 + len(token), 0), (text.index("dead"), text.index(" end"), 1))
    assert sorted(got) == sorted((tuple(x), k) for a, b, k in spans for x in secret_spans.look(text, a, b))


def test_counts_settle_as_examples_do():
    r = np.random.default_rng(4)
    y = np.array([0.0] * 300 + [1.0] * 200)
    at = np.where(y == 1, r.integers(-5, 40, len(y)), r.integers(-40, 10, len(y))) * 16
    one, other = secret_spans.Network(), secret_spans.Network()
    one.settle(at, y, np.ones(len(y)))
    cells = sorted(set(zip(at.tolist(), y.tolist())))
    other.settle(*map(np.array, zip(*cells)), np.array([float(((at == a) & (y == k)).sum()) for a, k in cells]))
    assert np.allclose(one.platt, other.platt) and abs(one.threshold - other.threshold) < 1e-9


# 6 ---------------------------------------------------------------------------------------------------------------

def test_url_filter_has_no_misses_and_join_is_exact(spark):
    from pyspark.sql import functions as F

    from filelake.llm import url_list

    listed = spark.range(3000).select(F.concat(F.lit("h"), F.col("id") * 2).alias("key"))
    listed = listed.unionByName(listed.limit(5)).unionByName(spark.createDataFrame([(None,)], "key string"))
    pages = spark.range(8000).select(F.when(F.col("id") % 3 == 0, "h2").otherwise(F.concat(F.lit("h"), "id")).alias("canonical"), F.lit(1).alias("key"))
    pages = pages.unionByName(spark.createDataFrame([(None, 1), ("", 1)], "canonical string, key int"))
    out = url_list.is_listed(pages, listed)
    want = Counter((c, c is not None and c != "" and int(c[1:]) % 2 == 0 and int(c[1:]) < 6000) for (c,) in pages.select("canonical").collect())
    assert Counter((r.canonical, r.listed) for r in out.collect()) == want


def test_url_parts(spark, tmp_path):
    from compare import duck_rows, spark_rows

    from filelake.llm.queries import ORACLES
    import duckdb

    urls = [None, "", "nothing", "http://", "http://A.ORG", "http://a.org/", "HTTP://X.Example.ORG:80/es/?a#b", "x://example.org/en/12?q", "://com/fr/a",
            "http://www.spam-x.net/p/", "http://spam-x.net/p.html?x", "http://notcom/fr/", "http://b.com#/fr/", "a://b://c/d", "http://www.SPAM-x.net/p", "http://Ü.com/de/"]
    pages = spark.createDataFrame([(k, u, "h", "x") for k, u in enumerate(urls + urls[:3])], "page_id long, url string, host string, key string")
    pages.write.parquet(f"{tmp_path}/pages.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM read_parquet('{tmp_path}/pages.parquet/*.parquet')")
    columns, got = spark_rows(QUERIES["op6_url_bloom"](spark, str(tmp_path)))
    assert (columns, got) == duck_rows(con, ORACLES["op6_url_bloom"])[:2]


# 7 ---------------------------------------------------------------------------------------------------------------

def test_transducer_equals_the_library(spark, corpus, rows):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=transducer.default_model())

    def answer(text, r):
        ids = library.encode(text)
        assert (r.n_pieces, r.ids_crc32) == (len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        back = library.decode(ids)
        assert r.decoded_sha256 == hashlib.sha256(back.encode()).hexdigest() and r.round_trip == (back == text)

    check(QUERIES["op7_sentencepiece_transducer"](spark, corpus), rows, answer)


def test_transducer_on_random_texts():
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=transducer.default_model())
    machine = transducer.Transducer(transducer.default_model())
    r = random.Random(8)
    pieces = list(machine.ids)
    signs = "abcdefgh tion the in er   \n\té漢字▁<s>0123.,'\"-()ABC𝒳"
    texts = ["".join(r.choice(signs) for _ in range(r.randint(1, 60))) for _ in range(800)]
    texts += [r.choice(["", " "]).join(r.choice(pieces) for _ in range(r.randint(1, 12))) for _ in range(1500)]
    texts += [" " * k + "x" for k in range(20)] + ["a" * 300]
    ids, offsets = machine.encode_texts(pa.array(texts))
    for k, text in enumerate(texts):
        assert ids[offsets[k] : offsets[k + 1]].tolist() == library.encode(text), text
    with pytest.raises(ValueError):
        machine.decode(np.array([10**6]), np.array([0, 1]))
    assert machine.decode(np.array([machine.byte_ids[0xFF]]), np.array([0, 1])) == [library.decode([machine.byte_ids[0xFF]])]


# 9 ---------------------------------------------------------------------------------------------------------------

def test_licenses(spark, corpus, rows):
    def answer(text, r):
        lowered = "".join(c.lower() if c.isascii() else c for c in text)
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)
        places = [(k, label) for p, label in licenses.BASE.items() for k in range(len(w)) if w[k : k + len(p.split())] == p.split()]
        assert (r.n_words, r.n_base) == (len(w), len(places))
        assert (r.first_word, r.last_word) == (min((k for k, _ in places), default=None), max((k for k, _ in places), default=None))
        assert r.base_labels == ",".join(sorted({label for _, label in places}))
        assert {*r.base_labels.split(",")} <= {*r.labels.split(","), ""} and 0 <= r.score <= 1

    check(QUERIES["op9_license_templates"](spark, corpus), rows, answer)


MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation
files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge,
publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so,
subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial
portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED
TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT
HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR
IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
BSD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following
conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following
disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following
disclaimer in the documentation and/or other materials provided with the distribution. {third} THIS SOFTWARE IS PROVIDED BY {who} ``AS
IS'' AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A
PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL {who} BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR
CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR
BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE
OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""


def test_whole_licenses_only():
    from pathlib import Path

    scanner = licenses.Scanner(licenses.BASE, licenses.TEMPLATES)
    labels = lambda text: {label for *_, label in scanner.scan(text.lower().encode())[1]}
    third = "3. Neither the name of the University nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
    bsd = [BSD.format(third=t, who="THE REGENTS AND CONTRIBUTORS") for t in ("", third)]
    assert labels("x " + MIT + " y") == {"mit"} and all(labels(t) == {"bsd"} for t in bsd)
    assert not labels(MIT.replace("THE SOFTWARE IS PROVIDED", "The Software shall be used for Good, not Evil. THE SOFTWARE IS PROVIDED"))
    assert not labels(MIT.replace("all copies or substantial", "some copies or substantial")) and not labels(MIT[: MIT.index(", and to permit")])
    assert not labels(bsd[1].replace("specific prior", "any prior")) and not labels(bsd[0].replace("are disclaimed", "are given").replace("ARE DISCLAIMED", "ARE GIVEN"))
    folder = Path(licenses.__file__).parent / "license_texts"
    for name, label in [("Apache-2.0", "apache-2"), ("GPL-1", "gpl-1"), ("GPL-2", "gpl-2"), ("GPL-3", "gpl-3"), ("LGPL-2", "lgpl-2"),
                        ("LGPL-2.1", "lgpl-2.1"), ("LGPL-3", "lgpl-3"), ("MPL-1.1", "mpl-1.1"), ("MPL-2.0", "mpl-2")]:
        words = licenses.WORD.findall((folder / f"{name}.txt").read_text().lower().encode())
        own = [a for at, a in scanner.automata if at == label and len(a.on_word) > 900]
        assert any(a.accepts(words) for a in own), name
        at = words.index(b"warranty", len(words) // 3) if b"warranty" in words[len(words) // 3 :] else len(words) // 2
        assert not any(a.find(words[:at] + [b"altered"] + words[at + 1 :]) for a in own), name


def test_template_marks():
    a = licenses.Automaton("licensed under <<beginOptional>>the <<beginOptional>>good<<endOptional>> old<<endOptional>> <<any:1,2>> terms")
    yes = ["licensed under x terms", "licensed under the old x y terms", "licensed under the good old x terms", "licensed under terms terms"]
    no = ["licensed under terms", "licensed under the good x y terms", "licensed under x y z terms", "licensed x terms", "licensed under x"]
    for text, good in [(t, True) for t in yes] + [(t, False) for t in no]:
        assert a.accepts(text.encode().split()) == good, text
    assert a.find(b"so licensed under x terms and licensed under y z terms".split()) == [(1, 5), (6, 11)]
    for bad in ("<<beginOptional>>x", "<<beginOptional>>x<<endOptional>>"):
        with pytest.raises(ValueError):
            licenses.Automaton(bad)


# 10 --------------------------------------------------------------------------------------------------------------

def plain_groups(rows):
    sets = {}
    for d, text in rows:
        w = re.findall(f"[^{SPACE}]+", "".join(c.lower() if c.isascii() else c for c in text))
        sets[d] = frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])
    up = {d: d for d in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    order = sorted(sets)
    for i, a in enumerate(order):
        for b in order[:i]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = root(a), root(b)
                up[max(x, y)] = min(x, y)
    return {d: (len(s), root(d)) for d, s in sets.items()}


def test_jaccard_groups(spark, corpus, rows):
    want = plain_groups(rows)
    for d, got in by_id(QUERIES["op10_jaccard_divideskip"](spark, corpus)).items():
        assert {(r.n_shingles, r.component_id) for r in got} == {want[d]}


def near_texts(n, seed=6):
    """Copies of a few texts with some words changed, so that similarities lie around the threshold."""
    r = random.Random(seed)
    bases = [[f"w{r.randint(0, 10**6)}" for _ in range(r.randint(30, 90))] for _ in range(4)]
    out = []
    for k in range(n):
        words = list(r.choice(bases))
        for _ in range(r.randint(0, 4)):
            words[r.randrange(len(words))] = f"v{k}{r.randint(0, 9)}"
        out.append((k, " ".join(words[: r.randint(len(words) - 4, len(words))])))
    return out


@pytest.mark.parametrize("block", [1 << 19, 600])
def test_jaccard_near_copies_in_one_and_many_blocks(spark, monkeypatch, block):
    monkeypatch.setattr(jaccard, "BLOCK", block)
    rows = near_texts(160)
    docs = spark.createDataFrame([*rows, (None, rows[0][1]), (None, "alone in the dark of night")], "doc_id long, text string")
    want = plain_groups(rows)
    got = jaccard.similar_groups(docs).collect()
    assert len(got) == 162
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got if r.doc_id is not None} == want
    assert sorted((r.component_id is None, r.component_id or 0) for r in got if r.doc_id is None)[0][1] == want[0][1]


@pytest.mark.parametrize("percent", [50, 80, 100])
def test_search_alone(percent):
    r = random.Random(percent)
    sets = [np.array(sorted(r.sample(range(40), r.randint(1, 25))), np.uint64) for _ in range(60)]
    sets = [s for k, s in enumerate(sets) if not any(np.array_equal(s, t) for t in sets[:k])]
    keys = [r.randint(-(10**9), 10**9) for _ in sets]
    edges = jaccard.search(keys, sets, [0] * len(sets), percent, False)
    from filelake.llm.components import Forest

    want, got = Forest(), Forest()
    for u, v in edges:
        got.join(u, v)
    for i, a in enumerate(sets):
        for j in range(i):
            both = len(np.intersect1d(a, sets[j]))
            if 100 * both >= percent * (len(a) + len(sets[j]) - both):
                want.join(keys[i], keys[j])
    assert [got.root(k) for k in keys] == [want.root(k) for k in keys]


def test_search_of_linked_near_copies_is_not_quadratic_in_python():
    import time

    r = np.random.default_rng(4)
    base = r.integers(0, 1 << 60, 100).astype(np.uint64)
    sets = []
    for _ in range(1200):
        own = base.copy()
        own[r.integers(0, 100, 5)] = r.integers(0, 1 << 60, 5)
        sets.append(np.unique(own))
    start = time.perf_counter()
    edges = jaccard.search(list(range(1200)), sets, [0] * 1200, 80, False)
    assert time.perf_counter() - start < 2 and {v for _, v in edges} == {0} and len(edges) == 1199


def test_answers_count_pieces_and_windows_of_one_piece_drop_out(spark):
    text = " ".join(f"w{k}" for k in range(30))
    rows = [(k, text + f" x{k}") for k in range(40)] + [(50 + k, " ".join(f"u{k}_{j}" for j in range(30))) for k in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    got = {r.doc_id: r.component_id for r in jaccard.similar_groups(docs).collect()}
    assert got == {d: 0 if d < 50 else d for d, _ in rows}
