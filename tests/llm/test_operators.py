"""The training-data operators against brute-force versions, and their edge cases."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from assayer.llm import (
    bpe, exact_dedup, mixing, near_dedup, ngrams, pii, quality, secret_scan, substring_dedup, topk, toxicity,
)
from assayer.llm.queries import tokenizer_path
from assayer.operators.components import components

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}


def texts(documents):
    return {r["doc_id"]: r["text"] or "" for r in documents.collect()}


def clashing(df):
    """More columns, with names that the operators use inside."""
    return df.withColumns({c: F.lit("x") for c in ("_text", "_salt", "_digest", "rank", "score", "size", "_row", "x", "v")})


# ---- op1 ----

def library(rows):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path())
    t.no_truncation(), t.no_padding()
    out = {}
    for i, text in rows.items():
        ids = t.encode(text, add_special_tokens=False).ids
        out[i] = (len(ids), hashlib.sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest(), sha(t.decode(ids, skip_special_tokens=False)))
    return out


def test_bpe_equals_the_library(documents):
    got = {i: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for i, r in by_id(bpe.token_digests(clashing(documents), tokenizer_path())).items()}
    assert got == library(texts(documents))


def test_bpe_on_random_strings(spark):
    random.seed(1)
    pieces = [" ", "  ", "\n", "\n\n", "\t", "'", "'s", "'ll", "a", "Zq", "é", "ß", "×", "!", "...", "12", " ", "\x1c", "　", "漢字", "<|endoftext|>", "😀", "́", "$", "x"]
    rows = {i: "".join(random.choice(pieces) for _ in range(random.randrange(30))) for i in range(3000)}
    df = spark.createDataFrame(list(rows.items()), "doc_id bigint, text string")
    got = {i: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for i, r in by_id(bpe.token_digests(df, tokenizer_path())).items()}
    assert got == library(rows)


def test_bpe_decode_gives_the_text_back(documents):
    both = bpe.decode(bpe.encode(documents, tokenizer_path(), keep=["doc_id", "text"]), tokenizer_path())
    assert both.where("coalesce(text, '') <> decoded").isEmpty()


def test_bpe_memory_of_fragments_is_bounded():
    encoder = bpe.Encoder(open(tokenizer_path()).read(), remembered=1200)
    unbounded = bpe.Encoder(open(tokenizer_path()).read())
    for text in ["one two three four five six seven one two", "漢字かな" * 2000, "so so it is"] * 2:
        data = np.frombuffer(text.encode(), dtype=np.uint8)
        offsets = np.array([0, len(data)])
        assert encoder.encode(data, offsets) == unbounded.encode(data, offsets)
        assert len(encoder.known) <= 4 and encoder.size <= 1200 and max(map(len, unbounded.known)) <= bpe.LONGEST_REMEMBERED


# ---- op2 ----

def brute_targets(sizes):
    ordered = sorted(sizes, key=lambda s: (s is None, s or ""))
    weights = {s: (3, 1, 2)[i % 3] for i, s in enumerate(ordered)}
    total, capped = 1.5 * sum(sizes.values()), set()
    while True:
        left = [s for s in ordered if s not in capped]
        level = (total - sum(2 * sizes[s] for s in capped)) / max(sum(weights[s] for s in left), 1)
        above = {s for s in left if level * weights[s] >= 2 * sizes[s]}
        if not above:
            return {s: 2 * sizes[s] if s in capped else level * weights[s] for s in ordered}
        capped |= above


def test_mix_meets_its_targets(documents):
    rows = {r["doc_id"]: r for r in documents.collect()}
    got = by_id(mixing.mix(clashing(documents), block=8))
    assert got.keys() == rows.keys()
    sizes, taken, largest = defaultdict(int), defaultdict(int), defaultdict(int)
    for i, r in rows.items():
        n = len(WORD.findall(r["text"] or ""))
        assert got[i].size == n and 0 <= got[i].taken <= 2 * n and got[i].taken == n * got[i].copies
        sizes[r["source"]] += n
        taken[r["source"]] += got[i].taken
        largest[r["source"]] = max(largest[r["source"]], n)
    targets = brute_targets(sizes)
    for i, r in rows.items():
        s = r["source"]
        assert got[i].source_size == sizes[s] and got[i].target == pytest.approx(targets[s])
    for s in sizes:
        assert abs(taken[s] - targets[s]) <= largest[s] / 2 + 1e-6
    again = by_id(mixing.mix(documents.repartition(7), block=8))
    assert {i: r.taken for i, r in again.items()} == {i: r.taken for i, r in got.items()}


def test_mix_of_repeats_and_take(spark, documents):
    df = documents.limit(40)
    twice = df.unionByName(df)
    assert mixing.mix(twice).count() == 80
    mixed = mixing.take(df)
    assert mixed.columns == df.columns
    n = mixing.mix(df).agg(F.sum("copies")).first()[0]
    assert mixed.count() == n


@pytest.mark.parametrize("kind", ["one source, equal sizes", "shares that add up", "equal rows", "two of four words"])
def test_mix_of_ties(spark, kind):
    """Exchanges may make both documents whole at once."""
    rows = {
        "one source, equal sizes": [(i, "a b c d", "s") for i in range(300)],
        "shares that add up": [(i, "w " * (i % 5 + 1), "abc"[i % 3]) for i in range(90)],
        "equal rows": [(7, "a b", None)] * 40,
        "two of four words": [(1, "a b c d", "s"), (2, "e f g h", "s")],
    }[kind]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    sizes, taken = defaultdict(int), defaultdict(int)
    for i, text, source in rows:
        sizes[source] += len(text.split())
    targets = brute_targets(sizes)
    got = mixing.mix(df, block=8).join(df.dropDuplicates(["doc_id"]).select("doc_id", "source"), "doc_id").collect()
    assert len(got) == len(rows) and all(0 <= r.taken <= 2 * r.size for r in got)
    for r in got:
        taken[r.source] += r.taken
    assert all(abs(taken[s] - targets[s]) <= 2.5 + 1e-6 for s in sizes)
    assert mixing.take(df).count() == sum(r.copies for r in got)


# ---- op3 ----

def brute_spans(text):
    spans = []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        spans.append((m.start(), 0, "email", m.end()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(p) <= 255 for p in m[0].split(".")):
            spans.append((m.start(), 1, "ip", m.end()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = re.sub("[^0-9]", "", m[0])
        total = sum(int(d) if i % 2 == 0 else sum(divmod(2 * int(d), 10)) for i, d in enumerate(reversed(digits)))
        if 14 <= len(digits) <= 19 and total % 10 == 0:
            spans.append((m.start(), 2, "card", m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 10 <= len(re.sub("[^0-9]", "", m[0])) <= 15:
            spans.append((m.start(), 3, "phone", m.end()))
    return sorted(spans)


def check_spans(df, rows):
    got = by_id(pii.summary(df))
    assert got.keys() == rows.keys()
    for i, text in rows.items():
        want = brute_spans(text)
        written = ",".join(f"{k}:{s}:{e}" for s, _, k, e in want)
        assert got[i].base_sha256 == sha(written), (text[:200], written, got[i])
        assert (got[i].n_email, got[i].n_ip, got[i].n_card, got[i].n_phone) == tuple(
            sum(s[2] == k for s in want) for k in ("email", "ip", "card", "phone"))
        assert set(filter(None, written.split(","))) <= set(got[i].spans.split(","))


def test_personal_data_base_spans(documents):
    check_spans(clashing(documents), texts(documents))


def test_personal_data_on_random_strings(spark):
    random.seed(2)
    pieces = ["1", "23", "255", "999", "4111111111111111", "0", ".", ".", "-", " ", "@", "a", "b.c", "+", "+1", "(", ")", "é", "😀", "\n", "x@y.z", "%", "5555-2748", "00"]
    rows = {i: "".join(random.choice(pieces) for _ in range(random.randrange(40))) for i in range(3000)}
    check_spans(spark.createDataFrame(list(rows.items()), "doc_id bigint, text string"), rows)


def test_personal_data_of_very_long_texts(spark):
    check_spans(spark.createDataFrame([(1, "1.2" * 900 + " a@b.c" * 400)], "doc_id bigint, text string"), {1: "1.2" * 900 + " a@b.c" * 400})
    # the plain patterns would try these runs from each of their positions
    rows = {1: "a" * 300_000, 2: "1" * 300_000, 3: "x@y" + ".z" * 50_000, 4: "+1" + "(" * 100_000, 5: "@" * 100_000}
    got = by_id(pii.summary(spark.createDataFrame(list(rows.items()), "doc_id bigint, text string")))
    assert [got[i].spans for i in sorted(rows)] == ["", "", "email:0:100003", "", ""]


def test_looser_spans_follow_their_votes(spark):
    rows = [(i, f"contact phone 555-123-{4000 + i} or mail joe{i}@mail.example.com now") for i in range(60)]
    rows += [(100 + i, f"order total page figure/555-123-{4000 + i}/ version") for i in range(60)]
    got = by_id(pii.summary(spark.createDataFrame(rows, "doc_id bigint, text string")))
    assert all("phone:14:26" in got[i].spans for i in range(60))
    assert all(got[100 + i].spans == "" for i in range(60))


# ---- op4, op7 ----

def checked_scores(df, rows):
    got = by_id(df)
    assert got.keys() == rows.keys()
    for i, r in got.items():
        assert r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) and 0 <= r.score <= 1
    return got


def accuracy(got, labels, label):
    pairs = [(r["doc_id"], r[label]) for r in labels.collect() if zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0]
    return sum(got[i].predicted == y for i, y in pairs) / len(pairs)


def test_quality(spark, documents, labels):
    got = checked_scores(quality.score(clashing(documents), labels), texts(documents))
    assert all(r.predicted == int(r.score >= 0.3) for r in got.values())
    big = spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    assert accuracy(by_id(quality.score(*big)), big[1], "quality") > 0.95
    kept = quality.keep_good(documents, labels)
    assert kept.columns == documents.columns
    assert {r["doc_id"] for r in kept.collect()} == {i for i, r in got.items() if r.predicted}


def test_toxicity(spark, documents, labels):
    got = checked_scores(toxicity.score(clashing(documents), labels), texts(documents))
    assert all(r.predicted == int(r.score >= 0.5) for r in got.values())
    big = spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    assert accuracy(by_id(toxicity.score(*big)), big[1], "toxic") > 0.93


def test_scores_without_labels_or_rows(documents, no_documents, labels, no_labels):
    assert {r.score for r in by_id(quality.score(documents, no_labels)).values()} == {0.5}
    assert checked_scores(toxicity.score(documents, no_labels), texts(documents))
    assert quality.score(no_documents, labels).isEmpty() and toxicity.score(no_documents, labels).isEmpty()


def test_isotonic_scores_never_fall():
    random.seed(3)
    n = np.array([random.randrange(5) for _ in range(50)], dtype=float)
    good = np.array([random.randint(0, int(k)) for k in n], dtype=float)
    x, y = quality.pooled(np.linspace(0, 1, 51), n, good)
    assert (np.diff(x) >= 0).all() and (np.diff(y) >= 0).all()
    assert sum(good) == pytest.approx(sum(np.interp((i + 0.5) / 50, x, y) * n[i] for i in range(50)), rel=0.05)


def test_the_grammar_scores_clauses():
    g = toxicity.Grammar({"brabbel*": 2.0})
    total = lambda text: sum(s for _, _, s, _ in g.clauses(text))
    assert total("you are an idiot.") > total("an idiot.") > total("not an idiot.") > 0
    assert total("an idiot.") > total("he reported an idiot.") * 0.99 > total("said, not an idiot.")
    assert total("they will kill you.") > total("to kill time.") > 0
    assert total("Ein brabbelnder satz.".lower()) > 0 and total("brabbel idiotype nothing.") == 0
    assert [(s, e) for s, e, _, _ in g.clauses("fine. you idiot! fine")] == [(5, 16)]


# ---- op5 ----

def test_topk_against_brute_force(spark):
    random.seed(5)
    rows = [(i, [float(random.randint(-3, 3)) / 8 for _ in range(6)]) for i in range(300)]
    rows += [(300, None), (301, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (350, [float("nan")] * 6), (400, [float("inf")] * 6), (None, [1.0] * 6), (450, [1e30] * 6)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>").withColumn("label", F.lit(1))
    whole = {i: [int(np.floor(256 * float(np.float32(x)))) for x in v] for i, v in rows[:300]} | {450: [2**63 - 1] * 6}  # 64 bits
    want = []
    for q in (i for i in whole if i % 50 == 0):
        scores = sorted(((-max(min(sum(a * b for a, b in zip(whole[q], whole[c])), topk.LONG), -topk.LONG)), c) for c in whole if c != q)
        want += [(q, n + 1, c, -s) for n, (s, c) in enumerate(scores[:5])]
    got = [(r.query_id, r.rank, r.vec_id, r.score) for r in topk.search(df).collect()]
    assert sorted(got) == sorted(want)


def test_topk_is_the_same_over_several_tiles(spark, monkeypatch):
    df = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    one = {tuple(r) for r in topk.search(df).collect()}
    for name, value in (("QUERY_BLOCK", 3), ("SHARD", 10), ("FAN_IN", 4)):
        monkeypatch.setattr(topk, name, value)
    assert {tuple(r) for r in topk.search(df).collect()} == one
    assert topk.search(df.limit(0)).isEmpty()


# ---- op6 ----

def brute_removal(rows, window=13):
    first = {}
    words = {i: WORD.findall(t) for i, t in rows.items()}
    for i in sorted(rows):
        for s in range(len(words[i]) - window + 1):
            first.setdefault(tuple(words[i][s : s + window]), i)
    out = {}
    for i, w in words.items():
        gone = set()
        for s in range(len(w) - window + 1):
            if first[tuple(w[s : s + window])] < i:
                gone.update(range(s, s + window))
        kept = " ".join(x for n, x in enumerate(w) if n not in gone)
        out[i] = (len(w), len(gone), sha(kept))
    return out


def removal(df):
    return {i: (r.n_words, r.n_removed, r.kept_sha256) for i, r in by_id(substring_dedup.removal_digests(df)).items()}


def test_substring_dedup_on_documents(documents):
    assert removal(clashing(documents)) == brute_removal(texts(documents))


@pytest.mark.parametrize("slice_bytes", [200, 8 << 20])
def test_substring_dedup_on_random_texts(spark, monkeypatch, slice_bytes):
    random.seed(6)
    monkeypatch.setattr(substring_dedup, "SLICE_BYTES", slice_bytes)
    monkeypatch.setattr(substring_dedup, "SHARD_BYTES", 4000)
    passages = [[random.choice("abcdefgh") + str(random.randrange(9)) for _ in range(random.randrange(8, 40))] for _ in range(30)]
    rows = {}
    for i in range(200):
        rows[i] = " ".join(w for _ in range(random.randrange(5)) for w in random.choice(passages)[random.randrange(6) :])
    df = spark.createDataFrame(list(rows.items()), "doc_id bigint, text string").repartition(3)
    assert removal(df) == brute_removal(rows)


# ---- op8 ----

def test_secret_scan(spark):
    random.seed(8)
    key = lambda n=40: "".join(random.choice("0123456789abcdef") for _ in range(n))
    rows = [(i, f'some words token = "{key()}" more words', f"src/{i}.py") for i in range(60)]
    rows += [(100 + i, f"card {random.randrange(10**15, 10**16)} and commit {key()} of the build", f"src/{i}.txt") for i in range(60)]
    rows += [(200, None, None), (201, "", "x"), (202, f'example password = "{"changeme" * 2}1"', "test/readme")]
    got = secret_scan.scan(clashing(spark.createDataFrame(rows, "doc_id bigint, text string, source string"))).collect()
    sure = {(r.doc_id, r.is_secret) for r in got}
    assert all((i, 1) in sure for i in range(60)) and not any((100 + i, 1) in sure for i in range(60)) and (202, 1) not in sure
    m = next(r for r in got if r.doc_id == 0)
    assert hashlib.sha256(rows[0][1][m.start : m.end].encode()).hexdigest() == m.value_sha256
    given = spark.createDataFrame([(r.doc_id, r.start, r.end, int(r.doc_id < 60)) for r in got], "doc_id bigint, start bigint, end bigint, label int")
    learnt = secret_scan.scan(spark.createDataFrame(rows, "doc_id bigint, text string, source string"), given).collect()
    assert all(r.is_secret == int(r.doc_id < 60) for r in learnt)


def test_secret_dictionary_counts_all_documents(spark):
    random.seed(80)
    word = lambda: "".join(random.choice("bcdfghjklm") + random.choice("aeiou") for _ in range(4))
    common = sorted({word() for _ in range(6000)})
    rows = [(i, " ".join(common[(i * 40 + k) % len(common)] for k in range(40)) if i % 500 else "zwinqua throxel") for i in range(5000)]
    rows += [(5000, 'password = "zwinquathroxel42"'), (5001, 'token = "q7zwxpk9vbnrt5hgfd3"')]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    words = secret_scan.dictionary_of(df)
    assert len(common) > 5000 and set(words) == {*common, "zwinqua", "throxel"} and len(words) == len(set(words))
    scored = {r.doc_id: r for r in secret_scan.scan(df.withColumn("source", F.lit("src"))).collect()}
    assert scored[5000].is_secret == 0 and scored[5001].is_secret == 1
    few = secret_scan.dictionary_of(df.where("doc_id >= 5000"))
    assert set(few) == {"password", "token"}


def test_secret_scan_of_long_values(spark):
    random.seed(81)
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
    long = lambda n, more="": "".join(random.choice(letters + "0123456789" + more) for _ in range(n))
    values = [
        ("assigned", long(1600, "+/")), ("known", f"eyJ{long(40)}.{long(3000, '_-')}.{long(683, '_-')}"), ("run", long(1600, "+/")),
        ("run", "".join(random.choice(letters) for _ in range(100)) + "7" + long(20)), ("known", f"eyJ{long(30)}.{long(60)}.{long(43)}"),
        ("assigned", long(512)), ("assigned", long(513)), ("run", long(513)), ("run", long(200_000)),
    ]
    rows = [(i, f"before it PRIVATE_KEY={v} and behind" if kind == "assigned" else f"before it {v} and behind", "src") for i, (kind, v) in enumerate(values)]
    got = secret_scan.scan(spark.createDataFrame(rows, "doc_id bigint, text string, source string")).collect()
    assert sorted((r.doc_id, r.kind, r.value_sha256) for r in got) == [(i, kind, sha(v)) for i, (kind, v) in enumerate(values)]
    assert all(rows[r.doc_id][1][r.start : r.end] == values[r.doc_id][1] for r in got)


# ---- op9 ----

def shingles(text, n=5):
    w = WORD.findall(text)
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} or ({tuple(w)} if w else set())


def brute_classes(rows, similarity=0.8):
    sets = {i: shingles(t) for i, t in rows.items()}
    root = {i: i for i in rows}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    holders = defaultdict(set)
    for i, s in sets.items():
        for x in s:
            holders[x].add(i)
    for i, s in sets.items():
        for j in {j for x in s for j in holders[x] if j < i}:
            common = len(s & sets[j])
            if common >= similarity * (len(s) + len(sets[j]) - common) - 1e-9:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: find(i) for i in rows}


def test_near_dedup_on_documents(documents):
    got = {i: r.class_id for i, r in by_id(near_dedup.classes(clashing(documents))).items()}
    assert got == brute_classes(texts(documents))


def test_near_dedup_of_chains_and_a_large_group(spark):
    random.seed(9)
    base = [f"w{i}" for i in range(120)]
    rows = {}
    for i in range(150):  # copies of one text, each with changes of its own, many of them not similar to each other
        w = list(base)
        for _ in range(random.randrange(3)):
            w[random.randrange(120)] = f"x{random.randrange(10**6)}"
        rows[i] = " ".join(w)
    chain = [f"c{i}" for i in range(200)]
    for i in range(40):  # each like its neighbours, the ends unlike
        rows[1000 + i] = " ".join(chain[i * 4 : i * 4 + 100])
    rows |= {2000: "short text", 2001: "short text", 2002: "", 2003: " ", 2004: None}
    df = spark.createDataFrame(list(rows.items()), "doc_id bigint, text string")
    got = {i: r.class_id for i, r in by_id(near_dedup.classes(df)).items()}
    assert got == brute_classes({i: t or "" for i, t in rows.items()})
    kept = near_dedup.drop_near_copies(df)
    assert {r["doc_id"] for r in kept.collect()} == {i for i, c in got.items() if i == c}


def test_darts_estimate_weighted_similarity():
    random.seed(10)
    common, k = [f"w{i} " for i in range(400)], 2000
    a = "".join(common[:300]) + "again again again again again again again again"
    b = "".join(common[100:400]) + "again again again again again again"
    words = ngrams.Words([a, b])
    for weighted in (False, True):
        cell, owner = near_dedup.cells(*near_dedup.shingle_sets(words), weighted)
        s = near_dedup.dart_signatures(cell, owner, 2, k)
        left, right = set(cell[owner == 0].tolist()), set(cell[owner == 1].tolist())
        assert abs((s[0] == s[1]).mean() - len(left & right) / len(left | right)) < 0.04


def test_components_of_long_chains(spark):
    n = 400  # two ascending chains joined at their far ends
    edges = [(i, i + 1) for i in range(n)] + [(1000 + i, 1001 + i) for i in range(n)] + [(n, 1000 + n), (5000, 5001)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert set(got.values()) == {0, 5000} and len(got) == 2 * n + 4


@pytest.mark.parametrize("similarity", [0.5, 0.8])
def test_similar_sets_meet_at_a_rare_cell(similarity):
    """Every similar pair shares a row of `rare_prefixes` in the roles that its sizes give; pairs of a template alone do not."""
    rng = np.random.default_rng(4)
    base = np.unique(rng.integers(0, 2**60, 60, dtype=np.uint64))
    sets = [base[:k] for k in (1, 2, 5, 40, 60)]
    for _ in range(150):
        kept = base[rng.random(len(base)) < rng.uniform(0.6, 1)]
        sets.append(np.unique(np.concatenate([kept, rng.integers(0, 2**60, rng.integers(0, 25), dtype=np.uint64)])))
    sets = [s for s in sets if len(s)]
    for common in (np.zeros(0, dtype=np.uint64), base, base[::2]):
        offered, asked = [], []
        for s in sets:
            token, band, place = near_dedup.rare_prefixes(s, common, similarity)
            rows = list(zip(token.tolist(), band.tolist(), place.tolist()))
            offered.append({(t, b): p for t, b, p in rows if p >= 0})
            asked.append({(t, b): -1 - p for t, b, p in rows if p < 0})
        for i, a in enumerate(sets):
            for j, b in enumerate(sets):
                shared = len(np.intersect1d(a, b))
                if i != j and len(a) <= len(b) and shared >= similarity * (len(a) + len(b) - shared) - 1e-9:
                    least = near_dedup.least_overlap(len(a), len(b), similarity)
                    assert any(offered[i][k] <= len(a) - least and asked[j][k] <= len(b) - least for k in offered[i].keys() & asked[j].keys())
    # 12 cells of its own of 100 each: similarity 0.786, no pair at all
    template = np.arange(88, dtype=np.uint64)
    crowd = [np.concatenate([template, np.uint64(1000 + 100 * i) + np.arange(12, dtype=np.uint64)]) for i in range(40)]
    keys = [{(t, b) for t, b, p in zip(*near_dedup.rare_prefixes(c, template, 0.8)) if p >= 0} for c in crowd]
    assert len(set().union(*keys)) == sum(map(len, keys))


@pytest.mark.parametrize("own", [10, 14, 15])
def test_near_dedup_of_a_crowd_around_a_template(spark, own, monkeypatch):
    """Texts that share a template at a similarity just below, at or above the threshold, and copies of some of them."""
    monkeypatch.setattr(near_dedup, "HUBS", (1,))
    template = " ".join(f"t{i}" for i in range(104 - own))
    rows = {i: template + " " + " ".join(f"w{i}x{j}" for j in range(own)) for i in range(150)}
    rows |= {1000 + i: rows[i].replace(f"w{i}x0", "changed") for i in range(0, 150, 10)}
    df = spark.createDataFrame(list(rows.items()), "doc_id bigint, text string")
    got = {r.doc_id: r.class_id for r in near_dedup.classes(df).collect()}
    assert got == brute_classes(rows)


# ---- op10 ----

def test_exact_dedup(spark, documents):
    rows = texts(documents)
    fold = lambda t: "".join(c.lower() if "A" <= c <= "Z" else c for c in t)
    members = defaultdict(list)
    for i, t in rows.items():
        members[fold(t)].append(i)
    got = by_id(exact_dedup.copy_groups(clashing(documents)))
    for i, t in rows.items():
        same = members[fold(t)]
        assert (got[i].keep_id, got[i].group_size, got[i].kept, got[i].text_sha256) == (max(same), len(same), i == max(same), sha(fold(t)))
    kept = exact_dedup.drop_copies(documents)
    assert kept.columns == documents.columns
    assert {r["doc_id"] for r in kept.collect()} == {i for i, r in got.items() if r.kept}


def test_exact_dedup_of_repeated_rows(spark):
    df = spark.createDataFrame([(1, "A"), (1, "a"), (1, "b"), (None, "c"), (None, "C"), (2, "É"), (3, "é")], "doc_id bigint, text string")
    got = exact_dedup.copy_groups(df).collect()
    assert len(got) == 7 and sum(r.kept for r in got) == 5
    assert exact_dedup.drop_copies(df).count() == 5


# ---- all ----

def test_empty_tables(no_documents, spark):
    none = no_documents
    for df in (
        bpe.token_digests(none, tokenizer_path()), mixing.mix(none), mixing.take(none), pii.summary(none), substring_dedup.removal_digests(none),
        secret_scan.scan(none), near_dedup.classes(none), near_dedup.drop_near_copies(none), exact_dedup.copy_groups(none), exact_dedup.drop_copies(none),
    ):
        assert df.isEmpty()


def test_null_numbers(spark):
    df = spark.createDataFrame([(None, "some text of a row without number"), (None, None), (1, "x")], "doc_id bigint, text string").withColumn("source", F.lit(None).cast("string"))
    assert bpe.token_digests(df, tokenizer_path()).count() == 3
    assert mixing.mix(df).count() == 3 and pii.summary(df).count() == 3
    assert substring_dedup.removal_digests(df).count() == 3 and near_dedup.classes(df).count() == 3
    assert exact_dedup.copy_groups(df).count() == 3


# ---- rows of one number ----

def test_near_copies_of_rows_with_one_number(spark):
    body = lambda name, n=60, change=0: " ".join(f"{name}{i}" for i in range(n - change)) + "".join(f" {name}z{i}" for i in range(change))
    rows = [
        (1, body("a")), (1, body("b")), (1, body("c")), (5, body("a", change=1)), (6, body("b", change=1)), (7, body("c", change=1)),
        (0, body("d")), (3, body("d", change=1)), (3, body("e")), (9, body("f")), (9, body("f", change=1)), (8, ""), (8, body("a")),
        (None, body("a")), (None, None),
    ]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    for parts in (1, 5):
        got = near_dedup.classes(df.repartition(parts))
        assert sorted(got.collect(), key=str) == sorted(
            [(1, 1), (1, 1), (1, 1), (5, 1), (6, 1), (7, 1), (0, 0), (3, 0), (3, 3), (9, 9), (9, 9), (8, 8), (8, 1), (None, None), (None, None)], key=str)
        kept = [tuple(r) for r in near_dedup.drop_near_copies(df.repartition(parts)).collect()]
        assert len([t for i, t in kept if i == 9]) == 1
        assert sorted((r for r in kept if r[0] != 9), key=str) == sorted([*rows[:3], rows[6], rows[8], rows[11], *rows[13:]], key=str)


def test_good_rows_stay_beside_rejected_rows_of_their_number(spark, documents, labels):
    scores = by_id(quality.score(documents, labels))
    bodies = texts(documents)
    bad = next(i for i, r in sorted(scores.items()) if r.predicted == 0 and bodies[i])
    good = next(i for i, r in sorted(scores.items()) if r.predicted == 1)
    both = documents.unionByName(documents.where(f"doc_id = {good}").withColumn("doc_id", F.lit(bad).cast("long")))
    again = quality._scored(both, labels, "quality", "text", "doc_id", quality.FEATURES, quality.RIDGE, quality.THRESHOLD, keyed=True)
    assert sorted(r.predicted for r in again.where(f"doc_id = {bad}").collect()) == [0, 1]
    kept = quality.keep_good(both, labels).where(f"doc_id = {bad}").collect()
    assert [r.text for r in kept] == [bodies[good]]


def test_take_of_rows_with_one_number_and_without(spark):
    rows = [(7, f"one two three four{i}", "s") for i in range(6)] + [(None, f"five six seven{i}" + " x" * (i % 2), "s") for i in range(6)]
    rows += [(100 + i, f"some words {i}", "t") for i in range(6)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    for data in (df, clashing(df.repartition(4))):
        taken, mixed = mixing.take(data), mixing.mix(df)
        assert taken.columns == data.columns
        assert taken.count() == mixed.agg(F.sum("copies")).first()[0] > 0
        copies = defaultdict(list)
        for r in mixed.collect():
            copies[r.doc_id, r.size].append(r.copies)
        seen = defaultdict(int)
        for r in taken.collect():
            seen[r.doc_id, r.text] += 1
        got = defaultdict(list)
        for i, text, _ in rows:
            got[i, len(text.split())].append(seen[i, text])
        assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in copies.items()}


INTERNAL = ["_text", "_salt", "_digest", "_check", "_keep", "_null", "_repeat", "_rejected", "_rejected_key", "_other", "_other_key", "_key",
            "_mix_id", "_mix_number", "_mix_copies", "_mix_row", "_mix_copy", "_row", "c0", "c1", "C7", "score", "predicted", "digest", "a b.c"]


def test_stages_keep_every_column_of_the_user(documents, labels):
    """Names that operators use inside are columns like others: rows come out with the values they came in with."""
    docs = documents.limit(60).select("*", *[F.concat(F.lit(f"{c} of "), F.col("doc_id")).alias(c) for c in INTERNAL])
    given = {r["doc_id"]: tuple(r) for r in docs.collect()}
    for stage in (exact_dedup.drop_copies, lambda d: quality.keep_good(d, labels), near_dedup.drop_near_copies, mixing.take):
        got = stage(docs)
        assert got.columns == docs.columns
        rows = got.collect()
        assert rows and all(tuple(r) == given[r["doc_id"]] for r in rows)
