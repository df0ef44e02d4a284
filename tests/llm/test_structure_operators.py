"""Whitening, conversation repair and packing against brute-force versions, and their edge cases."""

import hashlib
import itertools
import re
import struct
import zlib
from collections import defaultdict
from decimal import Decimal

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from test_operators import clashing, sha

from assayer.llm import conversations, packing, queries, whitening
from assayer.llm.queries import WORD_TOKENIZER, tokenizer_path

WHITE = " \t\n\x0b\f\r"
SF = "/root/testdata/sf0.001"


# ---- op11 ----

def brute_whitening(rows, k):
    """Per (vec_id, component): deviation, whitened up to sign, explained; from the covariance itself."""
    width = max(len(v) for _, v in rows)
    x = np.array([[int(np.floor(64 * float(c))) + 1_000_000 for c in v] + [1_000_000] * (width - len(v)) for _, v in rows], dtype=object)
    n, total = len(x), x.sum(axis=0)
    deviation = [int(((n * r - total) ** 2).sum()) for r in x]
    centred = np.array([[float(Decimal(int(n * c - s)) / n) for c, s in zip(r, total)] for r in x])
    e, p = np.linalg.eigh(centred.T @ centred / n)
    e, p = e[::-1][:k], p[:, ::-1][:, :k]
    return deviation, centred @ p / np.sqrt(np.where(e > 1e-9, e, np.nan)), e / np.trace(centred.T @ centred / n)


def check_whitening(df, rows, k, at_most=1e-7):
    got = defaultdict(list)
    for r in df.collect():
        got[r.component].append(r)
    deviation, white, explained = brute_whitening(rows, k)
    assert set(got) == set(range(1, min(k, white.shape[1]) + 1))
    for c, found in got.items():
        found = {r.vec_id: r for r in found}
        assert [found[i].deviation for i, _ in rows] == deviation and {r.n for r in found.values()} == {len(rows)}
        assert all(abs(r.explained - explained[c - 1]) < 1e-9 for r in found.values())
        ours, theirs = np.array([found[i].whitened for i, _ in rows], dtype=float), white[:, c - 1]
        if np.isnan(theirs).any():
            assert np.isnan(ours).all()
            continue
        ours *= np.sign(ours @ theirs)
        assert np.abs(ours - theirs).max() < at_most
    assert max(r.identity_error for found in got.values() for r in found) < 1e-9


def test_whitening_equals_the_covariance(spark):
    vectors = spark.read.parquet(f"{SF}/embeddings.parquet")
    rows = [(r.vec_id, r.embedding) for r in vectors.collect()]
    names = ("x", "rows", "key", "value", "n", "component", "_x")
    check_whitening(whitening.whiten(vectors.withColumns({c: F.lit("y") for c in names})), rows, 32)


@pytest.mark.parametrize("kind", ["few", "equal", "one", "low rank", "twice", "short", "constant", "same spread"])
def test_whitening_of_degenerate_vectors(spark, kind):
    rng = np.random.default_rng(5)
    made = {
        "few": rng.normal(size=(4, 9)), "equal": np.full((7, 3), 0.25), "one": rng.normal(size=(1, 3)),
        "low rank": rng.integers(-3, 4, (60, 2)) @ rng.integers(-3, 4, (2, 8)), "twice": np.repeat(rng.normal(size=(20, 4)), 3, axis=0),
        "constant": np.column_stack([rng.normal(size=40), np.ones(40), rng.normal(size=40)]),
        "same spread": np.array([[a, b, c] for a in (-1, 1) for b in (-1, 1) for c in (-1, 1)]) * 1.0,
    }
    vectors = [v.astype(float).tolist() for v in made[kind]] if kind != "short" else [[1.0], [0.5, 2.0], [], [3.0, -1.0, 0.25], [0.0, 0.0, 5.0]]
    rows = list(enumerate(vectors))
    df = whitening.whiten(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>"), components=8)
    if kind == "same spread":
        # any basis of the space will do
        y = np.array([[r.whitened for r in g] for _, g in itertools.groupby(sorted(df.collect(), key=lambda r: (r.vec_id, r.component)), key=lambda r: r.vec_id)])
        assert np.abs(y.T @ y / 8 - np.eye(3)).max() < 1e-9
        return
    if kind in ("equal", "one"):
        got = df.collect()
        assert len(got) == 3 * len(rows) and all(r.deviation == 0 and r.whitened is None and r.explained == 0 for r in got)
        return
    check_whitening(df, rows, 8)


def test_whitening_leaves_out_and_saturates(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 2.0]), (2, [nan, 1.0]), (3, [inf, 1.0]), (4, None), (5, [None, 1.0]), (None, [0.5, -3.0]), (1, [4.0, 1.0])]
    got = whitening.whiten(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")).collect()
    assert sorted((r.vec_id is None, r.vec_id or 0, r.component) for r in got) == [(False, 1, 1)] * 2 + [(False, 1, 2)] * 2 + [(True, 0, 1), (True, 0, 2)]
    far = spark.createDataFrame([(1, [1e300, 1.0]), (2, [-1e300, 0.0]), (3, [0.0, 0.0])], "vec_id bigint, embedding array<double>")
    assert all(r.deviation > 2**63 for r in whitening.whiten(far).where("vec_id < 3").collect())
    assert all(r.deviation is None for r in whitening.whiten(far, exact_type="bigint").where("vec_id < 3").collect())
    empty = spark.createDataFrame([], "vec_id bigint, embedding array<float>")
    assert whitening.whiten(empty).isEmpty() and whitening.whiten(spark.createDataFrame([(1, [])], "vec_id bigint, embedding array<float>")).isEmpty()


def test_lanczos_may_end_early(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(300, 40)) * np.array([30, 20, 10] + [0.05] * 37)
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    check_whitening(whitening.whiten(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>"), components=2), rows, 2)


# ---- op12 ----

def brute_damage(rows):
    out, ids = [], set()
    for conv_id, turn, role, text in rows:
        ids.add(conv_id)
        h = zlib.crc32(f"{' ' if conv_id is None else conv_id}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if h == 1 else re.sub("[.!?]", "", text) if h == 2 else text
        out += [] if h == 0 else [(conv_id, turn, "user" if h == 4 else role, text)] * (2 if h == 3 else 1)
    return ids, out


def brute_repair(turns):
    """turns: (turn, role, text) in order. By dynamic programming over (turn, initials so far), costs and audits compared."""
    faults, seen = [], set()
    for _, role, text in turns:
        body = text.strip(WHITE)
        faults.append("blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else "")
        seen.add((role, text))
    letters = {"": ("s", "u"), "s": ("u",), "u": ("a",), "a": ("u",)}
    best = {(len(turns), s): (0, "", ()) for s in ("", "a")}

    def offer(i, s, *found):
        if (i, s) not in best or found[:2] < best[i, s][:2]:
            best[i, s] = found

    for i in range(len(turns), -1, -1):
        if i < len(turns):
            (_, role, text), fault = turns[i], faults[i]
            extra = 3 if fault == "truncated" else 0
            for s in letters:
                options = [(4, "D", s, ())]
                if fault not in ("blank", "duplicate"):
                    if role[:1] in letters[s] or not role:
                        options.append((extra, "K", role[:1] or s, (f"{role}:{text}",)))
                    options += [(3 + extra, "R", r[0], (f"{r}:{text}",)) for r in ("user", "assistant") if r[0] in letters[s]]
                for cost, letter, to, line in options:
                    if (i + 1, to) in best:
                        c, a, lines = best[i + 1, to]
                        offer(i, s, cost + c, letter + a, line + lines)
        for _ in range(4):
            for s in letters:
                for r in ("user", "assistant"):
                    if r[0] in letters[s] and (i, r[0]) in best:
                        c, a, lines = best[i, r[0]]
                        offer(i, s, 3 + c, "I" + a, (f"{r}:",) + lines)
    cost, audit, lines = best[0, ""]
    known = [t for t, _, _ in turns if t is not None]
    illegal = sum((a[1][:1] + b[1][:1]) not in ("su", "ua", "au") for a, b in zip(turns, turns[1:]))
    return (max(known) - min(known) + 1 - len(set(known)) if known else 0, faults.count("blank"), faults.count("duplicate"),
            faults.count("truncated"), illegal, cost, audit, "\n".join(lines))


def brute_conversations(rows, damage=True):
    ids, rows = brute_damage(rows) if damage else ({r[0] for r in rows}, [(c, t, r or " ", " " if x is None else x) for c, t, r, x in rows])
    groups = defaultdict(list)
    for conv_id, turn, role, text in rows:
        digest = hashlib.sha256(f"{role}\0{text}".encode()).digest()[:16]
        groups[conv_id].append(((turn is not None, turn or 0), role, digest, (turn, role, text)))
    return {i: brute_repair([g[-1] for g in sorted(groups[i], key=lambda g: g[:3])]) for i in ids}


def check_conversations(df, want):
    got = {r.conv_id: (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, r.repaired_sha256) for r in df.collect()}
    assert got == {i: (*w[:-1], sha(w[-1])) for i, w in want.items()}


def test_conversations_equal_brute_force(spark):
    given = spark.read.parquet(f"{SF}/conversations.parquet")
    rows = [tuple(r) for r in given.select("conv_id", "turn", "role", "text").collect()]
    check_conversations(queries.op12_conversations(spark, SF), brute_conversations(rows))


CONV = "conv_id bigint, turn bigint, role string, text string"


def random_turns(seed):
    rng = np.random.default_rng(seed)
    roles, texts = ["user", "assistant", "system", "tool", None, "ünknown"], ["Hi.", "Yes!", "No", None, "", " \n", "Why?", "A ", "So. \t"]
    return [(int(rng.integers(0, 60)) if rng.random() < 0.95 else None, int(rng.integers(0, 9)) if rng.random() < 0.9 else None,
             roles[rng.choice(6, p=[0.35, 0.35, 0.1, 0.1, 0.05, 0.05])], texts[rng.integers(0, 9)]) for _ in range(700)]


def test_conversations_of_any_shape(spark):
    for seed in range(2):
        rows = random_turns(seed)
        df = clashing(spark.createDataFrame(rows, CONV)).withColumns({c: F.lit(1) for c in ("gone", "fault", "content", "again", "key", "_copy")})
        check_conversations(conversations.summary(conversations.damaged(df), gone=F.col("gone")), brute_conversations(rows))
        check_conversations(conversations.summary(df), brute_conversations(rows, damage=False))


def test_repaired_turns(spark):
    rows = random_turns(7)
    repaired = defaultdict(list)
    for r in sorted(conversations.repair(spark.createDataFrame(rows, CONV)).collect(), key=lambda r: (r.conv_id is None, r.conv_id or 0, r.position)):
        assert r.position == len(repaired[r.conv_id])
        repaired[r.conv_id].append(f"{r.role}:{r.text}")
    want = brute_conversations(rows, damage=False)
    assert {i: "\n".join(repaired[i]) for i in want} == {i: w[-1] for i, w in want.items()}
    assert all(re.fullmatch("(s?(ua)+)?", "".join(line[0] for line in lines)) for lines in repaired.values())


def test_search_costs_grow_with_the_turns():
    n = 20_000
    for initials in (["u"] * n, ["s"] * n, ["a", "u"] * (n // 2), ["u", "a", "s"] * (n // 3)):
        cost, audit = conversations.cheapest_edits(bytes(len(initials)), initials)
        assert len(audit) >= len(initials) and cost > 0
    assert conversations.cheapest_edits(b"", []) == (0, b"")


def test_conversations_of_nothing(spark):
    none = spark.createDataFrame([], CONV)
    assert conversations.summary(none).isEmpty() and conversations.repair(none).isEmpty()
    gone = spark.createDataFrame([(1, None, None, None)], CONV)
    (row,) = conversations.summary(gone, gone=F.lit(True)).collect()
    assert tuple(row) == (1, 0, 0, 0, 0, 0, 0, "", sha(""))
    long = "x " * 200_000 + "."
    (row,) = conversations.summary(spark.createDataFrame([(1, 1, "user", long), (1, 2, "assistant", long), (1, 2, "assistant", long)], CONV)).collect()
    assert (row.audit, row.duplicate, row.repaired_sha256) == ("KKD", 1, sha(f"user:{long}\nassistant:{long}"))


# ---- op13 ----

def ids_of(texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path(WORD_TOKENIZER))
    t.no_truncation(), t.no_padding()
    return {i: t.encode(text or "", add_special_tokens=False).ids + [1] for i, text in texts.items()}


def check_packing(df, ids, capacity):
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in df.collect():
        pieces[r.doc_id].append(r)
        sequences[r.sequence_id].append(r)
    assert pieces.keys() == ids.keys()
    for i, parts in pieces.items():
        at = 0
        for r in sorted(parts, key=lambda r: r.start):
            body = ids[i][r.start : r.start + r.length]
            assert r.start == at and r.length > 0 and r.doc_tokens == len(ids[i])
            assert r.ids_crc32 == zlib.crc32(struct.pack(f"<{len(body)}I", *body))
            at += r.length
        assert at == len(ids[i])
    padding = 0
    for parts in sequences.values():
        at = 0
        for r in sorted(parts, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= capacity
        padding += 0 if at & (at - 1) == 0 else capacity - at
    return padding


def test_packing_keeps_every_id(spark, documents):
    texts = {r["doc_id"]: r["text"] for r in documents.collect()}
    df = packing.pack(clashing(documents).withColumns({c: F.lit(1) for c in ("n", "crcs", "ids", "at", "room", "length", "_aside", "class")}),
                      tokenizer_path(WORD_TOKENIZER))
    padding = check_packing(df, ids_of(texts), 2048)
    assert padding < 0.01 * sum(map(len, ids_of(texts).values()))


@pytest.mark.parametrize("spare", [1, 4, 10**9])
def test_packing_into_short_sequences(spark, spare):
    words = ["ab", "Cde's", "f1g", "<|endoftext|>", "ünï", "漢字", "é"]
    rng = np.random.default_rng(3)
    texts = {i: " ".join(rng.choice(words, rng.integers(0, 40))) if i % 9 else None for i in range(300)}
    df = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")
    padding = check_packing(packing.pack(df, tokenizer_path(WORD_TOKENIZER), capacity=64, classes=16, spare=spare), ids_of(texts), 64)
    assert padding < (1 if spare < 10 else 0.08) * sum(map(len, ids_of(texts).values())) and (spare > 4 or padding == 0)


def test_packing_of_equal_and_missing_rows(spark):
    path = tokenizer_path(WORD_TOKENIZER)
    assert packing.pack(spark.createDataFrame([], "doc_id bigint, text string"), path).isEmpty()
    rows = [(1, "one two three")] * 50 + [(None, None)] * 50
    got = packing.pack(spark.createDataFrame(rows, "doc_id bigint, text string"), path, capacity=16).groupBy("doc_id").agg(
        F.sum("length").alias("ids"), F.max("doc_tokens").alias("n")).collect()
    assert {(r.doc_id, r.ids, r.n) for r in got} == {(1, 200, 4), (None, 50, 1)}


def test_words_are_encoded_as_the_library_does():
    path = tokenizer_path(WORD_TOKENIZER)
    encoder = packing.WordEncoder(open(path).read(), remembered=3000)
    words = ["a", "Àx", "it's", "1234", "ẞİ", "x y", " z", "Σας", "!?.", "<|startoftext|>q", "\x1c\x85",
             "The", "the,", "THE.", "<|ENDOFTEXT|>", "a'LL", "x,'s", "can't.", "q<|", "e\u0301,", "a<\u0338b", "don't<|endoftext|>", "I'", "-a-b-", "_"]
    texts = {i: " ".join(np.random.default_rng(i).choice(words, 50)) for i in range(40)} | {99: "q" * 400 + "\n\t" + "w " * 700_000}
    for limited in (encoder, packing.WordEncoder(open(path).read())):
        for _ in range(2):
            found, bounds = limited.encode(pa.array(list(texts.values())))
            assert [found[a:b].tolist() for a, b in zip(bounds, bounds[1:])] == [ids[:-1] for ids in ids_of(texts).values()]
        assert max(map(len, limited.known)) <= packing.LONGEST_REMEMBERED
    size = encoder.size
    whole = pa.array(list(texts.values()))
    for at in range(0, len(texts), 7):  # slices of a longer array
        found, bounds = encoder.encode(whole.slice(at, 7))
        assert [found[a:b].tolist() for a, b in zip(bounds, bounds[1:])] == [ids[:-1] for ids in ids_of(dict(list(texts.items())[at : at + 7])).values()]
    encoder.encode(pa.array(["words that are new to it"]))
    assert encoder.size == size  # it is full
    found, bounds = encoder.encode(pa.array([None, "", " \n "], pa.string()))
    assert not len(found) and bounds.tolist() == [0, 0, 0, 0]
    assert encoder.encode(pa.array([], pa.string()))[1].tolist() == [0]


def knapsack(sizes, values, capacity):
    best = [0.0] * (capacity + 1)
    for room in range(1, capacity + 1):
        best[room] = max([best[room - 1]] + [best[room - s] + v for s, v in zip(sizes, values) if s <= room])
    return best[capacity]


def test_pricing_and_plan():
    rng = np.random.default_rng(1)
    for _ in range(30):
        sizes = np.sort(rng.choice(np.arange(1, 60), 8, replace=False))
        values = rng.random(8)
        worth, pattern = packing.best_pattern(sizes, values, 60)
        assert pattern @ sizes <= 60 and worth == pytest.approx(values @ pattern) == pytest.approx(knapsack(sizes, values, 60))
        demand = rng.integers(1, 400, 8)
        plan = packing.packing_plan(sizes, demand, 60)
        assert (sum(p * t for p, t in plan) >= demand).all() and all(p @ sizes <= 60 for p, _ in plan)
        basis, used = packing.patterns_by_columns(sizes, demand, 60)
        assert sum(t for _, t in plan) <= used.sum() + len(sizes) + 1


def test_classes_lose_least():
    lengths, counts = np.array([3, 5, 6, 9, 10, 14]), np.array([7, 1, 9, 2, 2, 8])
    for most in range(1, 7):
        ends = packing.length_classes(lengths, counts, most)
        loss = min(
            sum((min(e for e in (*some, 14) if e >= x) - x) * c for x, c in zip(lengths.tolist(), counts.tolist()))
            for some in itertools.combinations(lengths[:-1].tolist(), most - 1))
        assert ends[-1] == 14 and len(ends) <= most
        assert sum((int(ends[np.searchsorted(ends, x)]) - x) * c for x, c in zip(lengths.tolist(), counts.tolist())) == loss
