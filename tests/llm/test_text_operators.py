"""Near duplicates, decontamination, tokens, rules and personal data against brute force."""

import collections
import hashlib
import random
import re
import time
import zlib

import numpy as np
import pytest

from foliospark.llm import decontaminate, neardup, pii, rules, tokens
from foliospark.llm.queries import vocabulary

FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, label string, sig string, words string, node string"


def frame(spark, rows):
    """Documents with extra columns whose names operators use inside."""
    return spark.createDataFrame([(i, t, "x", "y", "z", "w") for i, t in rows], SCHEMA)


def words(n, rng):
    return [rng.choice("abcdefgh") * rng.randint(1, 3) + str(rng.randint(0, 400)) for _ in range(n)]


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(4)
    rows = []
    base = words(60, rng)
    for k in range(40):  # near copies at many distances, copies of copies too
        own = list(base)
        for _ in range(k % 9):
            own[rng.randrange(len(own))] = f"new{rng.randint(0, 5)}"
        rows.append(" ".join(own))
        if k % 5 == 0:
            rows.append(" ".join(own[: len(own) - k // 2]))
    rows += [" ".join(base)] * 12 + [" ".join(words(rng.randint(1, 80), rng)) for _ in range(60)]
    rows += [None, "", "  \n\t", "one", "One", "one two three four", "ONE two three four", "a " * 300, "A b " * 40, "é ß " * 30]
    rows.append(" ".join(words(30_000, rng)))
    return [(i * 3 + 1, t) for i, t in enumerate(rows)]


def shingle_sets(rows):
    out = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(FOLD))
        out[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    return out


def component_ids(sets, percent):
    up = {i: i for i in sets}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    ids = sorted(i for i in sets if sets[i])
    for n, i in enumerate(ids):
        for j in ids[:n]:
            both = len(sets[i] & sets[j])
            if 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                a, b = sorted((root(i), root(j)))
                up[b] = a
    return {i: root(i) for i in sets}


def test_near_duplicates_match_all_pairs(spark, texts):
    sets = shingle_sets(texts)
    want = component_ids(sets, 85)
    got = {r.doc_id: r for r in neardup.near_duplicates(frame(spark, texts)).collect()}
    assert {i: (r.n_shingles, r.component_id, r.kept) for i, r in got.items()} == {i: (len(s), want[i], want[i] == i) for i, s in sets.items()}


def near_copies(rng):
    """Texts at all distances from a middle: the words replaced, cut, added, or only a passage shared."""
    out = []
    base = words(150, rng)
    for _ in range(260):
        own = list(base)
        for _ in range(int(rng.random() ** 2 * 30)):
            own[rng.randrange(len(own))] = f"r{rng.randrange(10**6)}"
        out.append(own)
    absent = words(120, rng)  # no text is this one, and all lack another part of it
    for _ in range(200):
        own = list(absent)
        for _ in range(rng.randint(3, 9)):
            own[rng.randrange(len(own))] = rng.choice(["x", "y", f"q{rng.randrange(9)}"])
        out.append(own)
    out += [base[: 150 - k] for k in range(0, 110, 2)] + [base + [f"t{j}" for j in range(k)] for k in range(1, 60)]
    out += [absent[:60] + words(rng.randint(2, 60), rng) for _ in range(120)]
    return [(i, " ".join(w)) for i, w in enumerate(out)]


def test_groups_of_near_copies_match_all_pairs(spark):
    rows = near_copies(random.Random(11))
    sets = shingle_sets(rows)
    for percent in (85, 80):
        want = component_ids(sets, percent)
        got = {r.doc_id: r.component_id for r in neardup.near_duplicates(frame(spark, rows), percent=percent).collect()}
        assert got == want


def test_linked_sets_share_a_prefix():
    rng = random.Random(2)
    for _ in range(4000):
        percent = rng.choice([80, 85, 90])
        p = set(rng.sample(range(90), rng.randint(3, 60)))
        x = {v for v in p if rng.random() < 0.8} | set(rng.sample(range(90), rng.randint(1, 6)))
        y = {v for v in x if rng.random() < 0.97} | set(rng.sample(range(90), rng.randint(0, 2)))
        if 100 * len(x & y) < percent * len(x | y) or 100 * len(y & p) >= percent * len(y | p):
            continue
        order = rng.sample(range(90), 90)
        a, b = ([v for v in order if v in s ^ p] for s in (x, y))
        near, _ = neardup.prefix_lengths(len(a), len(x), len(p), percent)
        _, far = neardup.prefix_lengths(len(b), len(y), len(p), percent)
        if len(x) == len(y) == len(x & y):
            continue  # equal sets have equal differences
        assert len(x ^ p) == 0 or set(a[:near]) & set(b[:far])


def test_near_duplicates_edges(spark):
    assert neardup.near_duplicates(frame(spark, [])).count() == 0
    rows = [(7, "a b c d e f"), (7, "a b c d e f"), (None, "a b c d e f"), (9, "A B C d e f"), (None, None)]
    got = sorted(((r.doc_id or 0, r.component_id, r.kept) for r in neardup.near_duplicates(frame(spark, rows)).collect()), key=str)
    assert got == sorted([(7, 7, True), (7, 7, True), (0, None, True), (9, 7, False), (0, None, True)], key=str)


def test_pruning_bound_is_the_posterior(spark):
    least = neardup.least_matches(85, 20, 140, 1e-6)
    rng = np.random.default_rng(0)
    for n, m in zip(range(20, 141, 20), least, strict=True):
        draws = rng.beta(m + 1 + 2, n - m + 1 - 2 if n - m > 2 else 1, 200_000)
        assert (draws >= 0.85).mean() > 0 or m < n
    assert list(least) == sorted(least)


def test_contamination_matches_brute_force(spark):
    rng = random.Random(1)
    items = [(1, " ".join(words(25, rng))), (2, "Only four words here"), (2, "only four words here"), (3, None), (4, ""), (None, "no id at all"), (10, " ".join(words(10, rng)))]
    item_words = {i: (t or "").split() for i, t in items}
    docs = [(k, " ".join(words(30, rng) + item_words[1][3:16] + words(5, rng))) for k in range(5)]
    docs += [(20, " ".join(item_words[1][:9])), (21, "x ONLY-four, words; here only four words here"), (22, None), (23, ""), (None, items[-1][1]), (24, "no id at all"), (24, "no id at all")]
    docs.append((30, " ".join(words(20_000, rng) + item_words[10])))
    pattern = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    find = lambda t: re.findall(pattern, (t or "").translate(FOLD))
    windows = collections.defaultdict(set)
    for i, t in items:
        w = find(t)
        for k in range(max(0, len(w) - 10) + 1 if w else 0):
            windows[tuple(w[k : k + 10])].add(i)
    want = []
    for i, t in docs:
        w = find(t)
        hit, found = set(), set()
        for size in {len(x) for x in windows}:
            for k in range(len(w) - size + 1):
                if tuple(w[k : k + size]) in windows:
                    hit |= set(range(k, k + size))
                    found |= windows[tuple(w[k : k + size])]
        names = sorted(str(x) for x in found if x is not None)
        want.append((i, len(w), len(hit), len(names), hashlib.sha256(",".join(names).encode()).hexdigest(), bool(hit)))
    bench = spark.createDataFrame([(i, t, 0) for i, t in items], "item_id long, text string, phrase int")
    for block in (1 << 18, 20):
        got = decontaminate.contamination(frame(spark, docs), bench, block_words=block).collect()
        assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert decontaminate.contamination(frame(spark, []), bench).count() == 0
    assert {r.contaminated for r in decontaminate.contamination(frame(spark, docs), bench.limit(0)).collect()} == {False}


def test_proximity_stays_inside_documents(spark):
    docs = frame(spark, [(1, "a b x c d"), (2, "c d"), (3, "a b"), (4, "a b c d")])
    index = decontaminate.build_index(docs)
    phrase = decontaminate.item_windows(spark.createDataFrame([(1, "a b c d")], "item_id long, text string"))
    exact = decontaminate.phrase_matches(index, phrase.select("phrase", "terms"))
    near = decontaminate.phrase_matches(index, phrase.select("phrase", "terms"), slop=1)
    assert [r.doc_id for r in exact.collect()] == [4]
    assert sorted({r.doc_id for r in near.collect()}) == [1, 4]


def test_tokens_round_trip(spark, texts):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(vocabulary())
    rows = texts + [(2, "<|endoftext|> a<|startoftext|>b"), (5, "Straße  x\x1cy é İ it's 'll"), (5, "b"), (None, "null id")]
    got = tokens.read_tokens(tokens.write_tokens(frame(spark, rows), vocabulary(), length=64)).collect()
    at, want = 0, []
    for i, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        ids = [*plain.encode(t or "", add_special_tokens=False).ids, 1]
        want.append((i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert tokens.read_tokens(tokens.write_tokens(frame(spark, []), vocabulary())).count() == 0


def test_sequences_are_equal_length_views(spark):
    manifest = tokens.write_tokens(frame(spark, [(1, "one two three"), (2, "four")]), vocabulary(), length=4)
    total = 0
    for row in manifest.collect():
        shard = tokens.Shard(row.sequences, row.documents)
        for i in range(-(-row.n_tokens // 4)):
            ids, mask = shard.sequence(i)
            assert len(ids) == len(mask) == 4 and not ids.flags.owndata
            total += int(mask.sum())
        shard.close()
    assert total == sum(r.n_tokens for r in manifest.collect())


def test_quality_report_matches_brute_force(spark, texts):
    rows = texts + [(2, "x y\nx y\n\n \nx y\nz"), (5, "a b c d e f a b c d e f g"), (8, "# $ % & | < > * ** word" * 3)]
    want = {}
    for i, t in rows:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        seen = collections.Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4))
        hit = {p for k in range(len(w) - 4) if seen[tuple(w[k : k + 5])] > 1 for p in range(k, k + 5)}
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        failed = len(w) < 10 or 100 * len(hit) > 20 * len(w)
        want[i] = (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(hit), failed)
    got = {r.doc_id: r for r in rules.quality_report(frame(spark, rows)).collect()}
    assert {i: tuple(r)[1:7] for i, r in got.items()} == want
    assert not any(r.kept and r.base_failed for r in got.values())
    assert rules.quality_report(frame(spark, [])).count() == 0


def test_order_of_rules_does_not_change_verdicts(spark, texts):
    docs = frame(spark, texts)
    every = rules.base_rules() + rules.method_rules()
    verdicts = [{(r.doc_id, r.kept) for r in docs.withColumn("w", rules.words_of(rules.F.coalesce("text", rules.F.lit("")))).select("doc_id", rules.cascade(order, rules.F.coalesce("text", rules.F.lit("")), rules.F.col("w")).alias("kept")).collect()} for order in (every, every[::-1])]
    assert verdicts[0] == verdicts[1] == {(r.doc_id, r.kept) for r in rules.apply_rules(docs).collect()}


BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def passes(kind, match):
    digits = re.sub("[^0-9]", "", match)
    if kind == "ip":
        return all(int(p) <= 255 for p in match.split("."))
    if kind == "card":
        total = sum(int(c) if k % 2 == 0 else sum(divmod(2 * int(c), 10)) for k, c in enumerate(reversed(digits)))
        return 16 <= len(digits) <= 19 and total % 10 == 0
    return 8 <= len(digits) <= 15 if kind == "phone" else True


def base_spans(text):
    return [f"{k}:{m.start()}:{m.end()}" for k in BASE for m in re.finditer(BASE[k], text or "") if passes(k, m[0])]


def test_base_spans_match_brute_force(spark):
    rng = random.Random(9)
    pieces = ["a.b@c.de", "x@y", "é@b.c", "a@b.c_d@e.f", "1.2.3.4", "1.2.3.4.5.6.7.8.9", "300.1.1.1", "0255.001.2.3", "4111 1111 1111 1111", "4111-1111-1111-1111", "41111111111111112222222", "+1 (017) 555-7713", "+12", "++49 30 1234567.", "12 ", "7", "- ", " ", "\n", "x", "@", ".", "𝒳 ", "(487) 555-7209"]
    rows = [(k, "".join(rng.choice(pieces) for _ in range(rng.randint(0, 30)))) for k in range(400)]
    rows += [(1000, None), (1001, ""), (1002, "a" * 60_000), (1003, "1 " * 30_000), (1004, "+1" * 5_000), (None, "a@b.c")]
    got = pii.personal_data(frame(spark, rows)).collect()
    want = {i: base_spans(t) for i, t in rows}
    for r in got:
        spans = want[r.doc_id]
        assert r.base_sha256 == hashlib.sha256(",".join(spans).encode()).hexdigest(), r.doc_id
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(s.startswith(k) for s in spans) for k in BASE]
        assert set(spans) <= set(r.spans.split(",")) | ({""} if not spans else set())
    assert len(got) == len(rows)
    assert pii.personal_data(frame(spark, [])).count() == 0


def test_labelers_earn_their_weight():
    table = []
    for real, n in ((1, 900), (0, 100)):
        for p in (-1, 1):
            for f in (-1, 1):
                share = (0.95 if (p == 1) == real else 0.05) * (0.9 if (f == 1) == real else 0.1)
                table.append({"kind": 0, "pattern": p, "form": f, "gazetteer": 0, "around": 1, "long": 0, "n": round(n * share) + 1})
    real, chance = pii.reliabilities(table)
    assert chance[0, "pattern", 1][1] > 0.85 and chance[0, "pattern", 1][0] < 0.3
    weight = pii.span_classifier(table, real)
    assert weight["pattern"] > 0 and weight["form"] > 0


def test_many_spans_take_linear_time(spark):
    text = "a@b.c " * 100_000
    began = time.perf_counter()
    row = pii.personal_data(frame(spark, [(1, text)])).first()
    assert row.n_email == 100_000 and row.spans.startswith("email:0:5,email:6:11,") and row.spans.endswith("email:599994:599999")
    assert time.perf_counter() - began < 60


def test_keyed_secrets_are_added(spark):
    rng = random.Random(4)
    key = lambda: "".join(rng.choice("0123456789abcdef") for _ in range(40))
    told = {k: key() for k in range(40)}
    rows = [(k, f'prose before token = "{v}" and prose behind, ratio = 0.5') for k, v in told.items()]
    rows += [(100 + k, f"key: aaaaaaaaaaaaaaaaaaaaaaaa{'a' * k}, see chapter: introductionsandconclusions") for k in range(40)]
    rows += [(200, "password=hunter2hunter2hunter2"), (201, "no secret here"), (202, None)]
    got = {r.doc_id: r for r in pii.personal_data(frame(spark, rows)).collect()}
    for k, v in told.items():
        at = rows[k][1].index(v)
        assert got[k].spans == f"secret:{at}:{at + 40}" and got[k].n_added == 1
        assert got[k].base_sha256 == hashlib.sha256(b"").hexdigest()
    assert not any("secret" in got[100 + k].spans for k in range(40)) and got[201].spans == got[202].spans == ""


def test_rules_keep_their_order(spark, texts):
    """A rule that costs far more for as many rejections comes later, run for run."""
    slow = rules.Rule("slow", lambda text, words: rules.F.length(rules.F.array_join(rules.F.transform(rules.F.sequence(rules.F.lit(1), rules.F.lit(800)), lambda i: rules.F.sha2(text, 256)), "")) < 0)
    quick = rules.Rule("quick", lambda text, words: rules.F.length(text) < 0)
    many = rules.Rule("many", lambda text, words: rules.F.length(text) >= 0)
    for _ in range(3):
        order = rules.measured_order(frame(spark, texts), [slow, quick, many])
        assert [r.name for r in order][0] == "many" and order[-1].name == "slow"
