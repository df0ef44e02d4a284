"""Links that are found without naming a column: other spellings of a name, references inside texts."""

import random
import re

from pyspark.sql import functions as F

from assayer.operators import discovery, profile


def counted(tables):
    values = profile.value_counts(tables, nulls=True)
    return values.where("value is not null"), profile.value_profile(values)


WORDS = ["Harbor", "Crystal", "Maple", "Granite", "Silver", "Falcon", "Orchid", "Summit", "Cobalt", "Willow", "Ember", "Quartz"]


def companies():
    return [f"{a} {b}" for a in WORDS for b in ("Foods", "Optics", "Freight", "Mining")]


def test_five_spellings_of_one_name_are_found(frame):
    """Four systems spell the companies in their own way, one of them with a slip; an unrelated table has other names."""
    names = companies()
    slip = lambda n: n[:6] + n[7:]
    tables = {
        "crm": frame("account string, city string", [(n, random.Random(n).choice(["Turin", "Lagos", "Quito"])) for n in names]),
        "erp": frame("vendor string", [(f"{n.upper()}, INC.",) for n in names]),
        "bank": frame("payee string", [(f"{n} Ltd",) for n in names[:30]]),
        "web": frame("referrer string", [(slip(n),) for n in names]),
        "exact": frame("name string", [(n,) for n in names[:40]]),
        "other": frame("label string", [(f"item {i} of zone {i * 7}",) for i in range(200)]),
    }
    values, _ = counted(tables)
    found = {(r.from_table, r.to_table): r.share for r in discovery.fuzzy_links(values).collect()}
    spelled = {"crm", "erp", "bank", "web", "exact"}
    assert {t for pair in found for t in pair} == spelled
    linked = {frozenset(pair) for pair in found}
    assert all(frozenset((a, b)) in linked for a in spelled for b in spelled if a < b and {a, b} != {"crm", "exact"})
    assert found[("bank", "erp")] == 1.0


def test_close_names_equal_brute_force(frame):
    rng = random.Random(4)
    alphabet = "ABC"
    columns = {t: sorted({"NAME" + "".join(rng.choice(alphabet) for _ in range(4)) for _ in range(25)}) for t in ("p", "q", "r")}
    names = frame("table_name string, column_name string, block string, canonical string", [(t, "c", "NAME", n) for t, ns in columns.items() for n in ns])
    pairs = frame("from_table_name string, from_column_name string, to_table_name string, to_column_name string", [("p", "c", "q", "c"), ("q", "c", "p", "c"), ("p", "c", "r", "c")])

    def near(a, b):
        return a == b or (len(a) == len(b) and sum(x != y for x, y in zip(a, b)) == 1)

    got = {(r.from_table_name, r.to_table_name): (r.n_matched, r.n_names) for r in discovery.close_names(names, pairs).collect()}
    for a, b in (("p", "q"), ("q", "p"), ("p", "r")):
        assert got[a, b] == (sum(any(near(x, y) for y in columns[b]) for x in columns[a]), len(columns[a]))
    assert set(got) == {("p", "q"), ("q", "p"), ("p", "r")}


def test_references_inside_texts(frame):
    invoices = [f"INV-{2020 + i % 4}-{i:04d}" for i in range(60)]
    tables = {
        "invoices": frame("invoice_no string, customer_no int", [(n, 500 + i) for i, n in enumerate(invoices)]),
        "bank": frame("description string, amount double", [(f"SEPA {n} thank you" if i % 10 else "fee", 1.5) for i, n in enumerate(invoices[:50])]),
        "people": frame("full_name string", [(f"Customer#{500 + i:09d}",) for i in range(58)] + [(None,)]),
        "notes": frame("body string", [(f"call at {i % 24}:00, room {i}",) for i in range(60)]),
    }
    values, profiles = counted(tables)
    got = {(r.from_table, r.shape, r.to_table, r.to_column): (r.n_references, r.n_linked) for r in discovery.reference_links(tables, values, profiles).collect()}
    # every reference of the bank is an invoice; customers' numbers are named by their label; hours and rooms are not
    assert got == {("bank", "A-9-9", "invoices", "invoice_no"): (45, 45), ("people", "A#9", "invoices", "customer_no"): (58, 58)}


def test_references_of_long_texts_and_nothing(frame):
    long = "word " * 5000 + "REF-77 " + "REF-77"
    found = discovery.references({"t": frame("a string, b int", [(long, 1), (None, 2), ("", 3)])})
    assert sorted((r.shape, r.reference, r.is_number, r.n, r.label) for r in found.collect()) == [("A-9", "77", True, 1, "ref"), ("A-9", "REF-77", False, 1, "ref")]
    tables = {"t": frame("a string, b int", [])}
    values, profiles = counted(tables)
    assert discovery.reference_links(tables, values, profiles).isEmpty() and discovery.fuzzy_links(values).isEmpty()


def test_close_names_are_not_broadcast(frame, capsys):
    """Their keys are many times larger than the files that tell Spark what a table weighs, and would all meet in the driver."""
    names = frame("table_name string, column_name string, block string, canonical string", [(t, "c", "NAME", f"NAME{i:03d}") for t in "pq" for i in range(0, 300, 7)])
    pairs = frame("from_table_name string, from_column_name string, to_table_name string, to_column_name string", [("p", "c", "q", "c")])
    sent = []

    def watched(df):
        df.explain()
        plan = capsys.readouterr().out
        sent.extend(line for line in plan.split("\n") if "BroadcastHashJoin" in line and ("canonical" in line or "key#" in line))
        return kept(df)

    kept, discovery.cut = discovery.cut, watched
    try:
        found = watched(discovery.close_names(names, pairs))
    finally:
        discovery.cut = kept
    assert [(r.n_matched, r.n_names) for r in found.collect()] == [(43, 43)]
    assert not [line for line in sent if "block" in line]


def spelled_apart(seed=3):
    """Twelve names with a slip in common, the other names of both tables long and without any piece in common."""
    rng = random.Random(seed)
    word = lambda n: "".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZ") for _ in range(n))
    common = [word(9) for _ in range(12)]
    slip = lambda n: n[:6] + ("Z" if n[6] != "Z" else "Y") + n[7:]
    return common + [word(110) for _ in range(10)], [slip(n) for n in common] + [word(110) for _ in range(9)]


def test_names_among_unlike_others_are_found(frame):
    """What most of the names are made of does not decide: each is looked at."""
    ours, theirs = spelled_apart()
    values, _ = counted({"p": frame("name string", [(n,) for n in ours]), "q": frame("label string", [(n,) for n in theirs])})
    got = [(r.from_table, r.to_table, r.n_names, r.n_matched) for r in discovery.fuzzy_links(values).collect()]
    assert got == [("q", "p", 21, 12)]


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, before = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(before[j] + 1, row[-1] + 1, before[j - 1] + (x != y)))
    return row[-1]


def test_fuzzy_links_equal_all_pairs(frame):
    """Names of all lengths, with accents and surrogate pairs, in more columns than a word has bits; in blocks of their own and shared ones."""
    rng = random.Random(8)
    alphabet = "AB1é𝒜"
    columns = {f"t{i}": sorted({rng.choice(["NAME", "NAMES", "OTHE", f"BL{'CDE'[i % 3]}K"]) + "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 5)))
                                for _ in range(rng.randint(1, 12))}) for i in range(70)}
    columns["few"] = ["IBM", "7"]
    values = frame("table_name string, column_name string, normalized_type string, value string", [(t, "c", "string", v) for t, vs in columns.items() for v in vs])
    block = lambda v: "".join(c for c in v.upper() if "A" <= c <= "Z")[:4]
    names = {t: {(block(v), v.upper()) for v in vs if len(block(v)) == 4} for t, vs in columns.items()}
    for d in (0, 1, 2):
        close = {x: {y for y in set().union(*names.values()) if x[0] == y[0] and distance(x[1], y[1]) <= d} for x in set().union(*names.values())}
        expected = {}
        for a in columns:
            for b in columns:
                matched = sum(bool(close[x] & names[b]) for x in names[a])
                if a != b and matched and round(matched / len(names[a]), 6) >= 0.6 and not set(columns[a]) <= set(columns[b]):
                    expected.setdefault(frozenset((a, b)), []).append((-round(matched / len(names[a]), 6), a, b, len(names[a]), matched))
        got = {(r.from_table, r.to_table, r.n_names, r.n_matched) for r in discovery.fuzzy_links(values, minimum=0.6, max_distance=d).collect()}
        assert got == {min(found)[1:] for found in expected.values()} and (d == 0 or got)


def test_only_numbers_are_sorted_by_label(frame, capsys):
    """A token is one reference; what it is not counted for again is neither sorted nor shuffled again."""
    texts = ["INV-7 x INV-07", "AB-7", "ab-7 7", "x", None, "", "INV-7", "a1b", "C#007 C#7 D#7"]
    found = discovery.references({"t": frame("a string, b int", [(t, 1) for t in texts])})
    expected = {}
    for text in texts:
        for token in set(re.findall(discovery.TOKEN, text or "")):
            if re.search("[0-9]", token):
                shape = re.sub("[0-9]+", "9", re.sub("[A-Za-z]+", "A", token))
                number = re.search("([0-9]+)$", token)
                for reference, is_number in [(token, False), *([(str(int(number[1])), True)] if number else [])]:
                    expected.setdefault((shape, reference, is_number), []).append(re.match("[A-Za-z]*", token)[0].lower())
    got = {(r.shape, r.reference, r.is_number): (r.n, r.label, r.last_label) for r in found.collect()}
    assert got == {k: (len(v), min(v), max(v)) for k, v in expected.items()}
    found.explain()
    sorts = [line for line in capsys.readouterr().out.split("\n") if " Sort [" in line or "+- Sort [" in line]
    assert sorts and all("Sort [_groupingexpression#" in line for line in sorts)  # by a hash
