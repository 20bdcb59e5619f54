"""Spelling variants, conversation repair and packing against brute force and in odd cases."""

import hashlib
import itertools
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from foliospark.llm import packing, repair, spelling
from foliospark.llm.queries import vocabulary

LETTERS = "abcdefghijklmnopqrstuvwxyz" + "".join(map(chr, range(0xC0, 0x100)))


# --- spelling -------------------------------------------------------------------------------


def near(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    if len(a) > len(b):
        a, b = b, a
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def variants(counts, ratio=5):
    out = {}
    for w, n in counts.items():
        others = sorted((-m, o) for o, m in counts.items() if near(w, o))
        best = others[0] if others and -others[0][0] >= ratio * n else None
        out[w] = (best and best[1], n, len(others), best and -best[0])
    rows = set()
    for w, (form, n, k, m) in out.items():
        root = w
        while out[root][0]:
            root = out[root][0]
        rows.add((w, form, root, n, k, m))
    return rows


def test_spelling_variants_match_brute_force(spark):
    rng = random.Random(3)
    counts = {}
    for _ in range(60):
        base = "".join(rng.choice("aabcé") for _ in range(rng.randint(6, 8)))
        counts.setdefault(base, rng.choice([5, 40, 250, 3000]))
        for _ in range(8):
            at, c = rng.randrange(len(base)), rng.choice("aabcéÿ")
            new = rng.choice([base[:at] + c + base[at + 1 :], base[:at] + c + base[at:], base[:at] + base[at + 1 :]])
            counts.setdefault(new, rng.choice([1, 5, 8, 40, 250]))
    counts |= {"aaaaaa": 9, "aaaaaaa": 50, "aaaaaaaa": 400}
    # a key with the whole alphabet in it
    counts |= {f"stem{c}stem": 5 + i for i, c in enumerate(LETTERS)} | {"stemstem": 1000}
    got = spelling.spelling_variants(spark.createDataFrame(list(counts.items()), "word string, n long"))
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    assert {tuple(r) for r in got.collect()} == variants(counts)


def test_lexicon_counts_whole_texts_and_slips(spark):
    rng = random.Random(8)
    words = ["".join(rng.choice("abcdé") for _ in range(rng.randint(4, 9))) for _ in range(40)]
    rows = [(i, " ".join(rng.choice(words).title() for _ in range(400)), "x", 1) for i in range(30)]
    rows += [(None, "Wörterbuch× Wörterbuch÷ wörterbuch_WÖRTERBUCH Ünique0ünique", "x", 1), (7, None, "x", 1), (8, "", "x", 1)]
    rows += [rows[0]] * 2 + [(99, "longtext " * 50_000, "x", 1)]
    expected: Counter = Counter()
    for doc, text, *_ in rows:
        run = ""
        for c in (text or "") + " ":
            if c in LETTERS or c in LETTERS[:26].upper():
                run += c.lower() if c < "\x80" else c
                continue
            if run:
                h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
                if h % 199 == 0:
                    at = h % len(run)
                    run = run[:at] + run[at + 1 :]
                expected[run] += 1
            run = ""
    docs = spark.createDataFrame(rows, "doc_id long, text string, word string, n long").repartition(5)
    got = dict(spelling.lexicon(docs, slip=199).collect())
    assert got == {w: n for w, n in expected.items() if len(w) >= 6 and n >= 5}
    plain = dict(spelling.lexicon(docs, least=1).collect())
    assert plain["longtext"] == 50_000 and plain["ünique"] == 1


def test_spelling_of_an_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert spelling.spelling_variants(spelling.lexicon(docs)).collect() == []


# --- repair ---------------------------------------------------------------------------------


def pattern(initials):
    rest = initials[1:] if initials[:1] == "s" else initials
    return initials == "" or (rest != "" and rest == "ua" * (len(rest) // 2))


def cheapest(rows):
    """(cost, audit, repaired) by trying every edit; rows are (role, text, fault)."""
    best = None
    options = [[(3, "I", "user", ""), (3, "I", "assistant", "")], []]
    for gaps in itertools.product(range(3), repeat=len(rows) + 1):
        if sum(gaps) > 3:
            continue
        per_row = []
        for i, (role, text, fault) in enumerate(rows):
            per_row += [options[0]] * gaps[i]
            edits = [(4, "D", None, None)]
            if fault not in ("blank", "duplicate"):
                extra = 3 if fault == "truncated" else 0
                edits += [(extra, "K", role, text), (3 + extra, "R", "user", text), (3 + extra, "R", "assistant", text)]
            per_row.append(edits)
        per_row += [options[0]] * gaps[-1]
        for pick in itertools.product(*per_row):
            kept = [p for p in pick if p[1] != "D"]
            if pattern("".join(p[2][:1] or "-" for p in kept)):
                key = (sum(p[0] for p in pick), "".join(p[1] for p in pick), "\n".join(f"{p[2]}:{p[3]}" for p in kept))
                best = key if best is None else min(best, key)
    return best


def faults(rows):
    seen, out = set(), []
    for role, text in rows:
        solid = text.strip(" \t\n\x0b\x0c\r")
        if not solid:
            kind = "blank"
        elif (role, text) in seen:
            kind = "duplicate"
        else:
            kind = "sound" if solid[-1] in ".!?" else "truncated"
        seen.add((role, text))
        out.append((role, text, kind))
    return out


@pytest.mark.parametrize("held", [repair.HELD_BYTES, 1])
def test_repair_matches_brute_force(spark, held):
    """Also with every row spilled (held = 1)."""
    rng = random.Random(5)
    talks = []
    for _ in range(60):
        size = rng.randint(0, 4)
        talk = [(rng.choice(["user", "assistant", "system", "tool"]), rng.choice(["a.", "b.", "c", " ", "d!"])) for _ in range(size)]
        talks.append(talk)
    talks += [[("system", "x."), ("user", "y."), ("assistant", "z.")], [("", "x.")], [("user", "q?\t\n")] * 3]
    rows = [(c, t, role, text, True, "k") for c, talk in enumerate(talks) for t, (role, text) in enumerate(talk)]
    rows += [(c, None, None, None, False, "k") for c in range(len(talks))]
    rng.shuffle(rows)
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, present boolean, conv string")
    got = {r.conv_id: r for r in repair.repair_report(frame, held).collect()}
    assert set(got) == set(range(len(talks)))
    turns = {}
    for r in repair.repaired_turns(frame, held).orderBy("conv_id", "position").collect():
        turns.setdefault(r.conv_id, []).append(f"{r.role}:{r.text}")
    for c, talk in enumerate(talks):
        judged = faults(talk)
        cost, audit, repaired = cheapest(judged)
        r = got[c]
        assert (r.cost, r.audit) == (cost, audit), (talk, r)
        assert r.repaired_sha256 == hashlib.sha256(repaired.encode()).hexdigest()
        assert "\n".join(turns.get(c, [])) == repaired
        assert [r.blank, r.duplicate, r.truncated] == [sum(k == f for *_, k in judged) for f in ("blank", "duplicate", "truncated")]
        pairs = itertools.pairwise(role[:1] for role, _ in talk)
        assert r.illegal == sum(x + y not in ("su", "ua", "au") for x, y in pairs)


def test_repair_of_nulls_gaps_and_a_giant(spark):
    giant = [(1, t, "user" if t % 2 == 0 else "assistant", f"turn {t}.") for t in range(0, 400_000, 2)]
    odd = [(2, None, "user", "first."), (2, 1 << 62, "user", "last."), (2, (1 << 62) - 4, "assistant", None), (None, 3, None, "x.")]
    schema = "conv_id long, turn long, role string, text string"
    frame = spark.createDataFrame(giant + odd, schema)
    got = {r.conv_id: r for r in repair.repair_report(frame, 1 << 20).collect()}
    # only user rows: each but the last keeps its place beside an inserted answer, or takes the answer's role
    assert got[1].gaps == 199_999 and got[1].illegal == 199_999 and got[1].truncated == 0
    assert got[1].cost == 3 * 100_000 and len(got[1].audit) == 200_000 and set(got[1].audit) == {"K", "R"}
    assert got[2].gaps == 5 - 2 and got[2].blank == 1 and got[2].illegal == 0
    assert (got[None].illegal, got[None].gaps) == (0, 0) and got[None].audit == "D"
    assert repair.repair_report(spark.createDataFrame([], schema)).collect() == []


def test_damage_by_hash(spark):
    rows = [(c, t, "assistant", f"Is it {t}? Yes!") for c in range(30) for t in range(8)] + [(None, None, None, None)]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    want = []
    for c, t, role, text in rows:
        kind = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        role, text = role or " ", " " if text is None else text
        if kind == 0:
            want.append((c, t, None, "", False))
            continue
        text = {1: "", 2: text.replace("?", "").replace("!", "")}.get(kind, text)
        want += [(c, t, "user" if kind == 4 else role, text, True)] * (2 if kind == 3 else 1)
    got = [tuple(r) for r in repair.damaged(frame).collect()]
    assert Counter(got) == Counter(want)


# --- packing --------------------------------------------------------------------------------


def one_by_one(lengths, capacity):
    """Rests of the bins after best-fit decreasing, one piece at a time."""
    rests = []
    for n in sorted(lengths, reverse=True):
        fitting = [r for r in rests if r >= n]
        if fitting:
            rests.remove(min(fitting))
            rests.append(min(fitting) - n)
        else:
            rests.append(capacity - n)
    return sorted(rests)


@pytest.mark.parametrize("capacity", [1, 7, 64, 100])
def test_plan_is_best_fit_decreasing(capacity):
    rng = random.Random(capacity)
    for _ in range(40):
        lengths = [rng.randint(1, capacity) for _ in range(rng.randint(1, 120))]
        counts = Counter(lengths)
        used, placed = Counter(), {n: 0 for n in counts}
        spans = {}
        for length, lo, hi, first, each, base in packing.best_fit(list(counts.items()), capacity):
            assert lo == placed[length] and hi > lo
            placed[length] = hi
            for k in range(hi - lo):
                bin_, at = first + k // each, base + k % each * length
                spans.setdefault(bin_, []).append((at, at + length))
                used[bin_] += length
        assert placed == dict(counts)
        for own in spans.values():  # without gaps from 0
            own.sort()
            assert own[0][0] == 0 and all(a[1] == b[0] for a, b in itertools.pairwise(own)) and own[-1][1] <= capacity
        assert sorted(capacity - u for u in used.values()) == one_by_one(lengths, capacity)


def test_packed_holds_every_token_once(spark):
    from tokenizers import Tokenizer

    rng = random.Random(2)
    texts = ["".join(rng.choice("abc de") for _ in range(rng.randint(0, 400))) for _ in range(150)]
    rows = [(i, t, "x") for i, t in enumerate(texts)] + [(900, None, "x"), (901, "", "x"), (None, "no id", "x"), (3, texts[3], "x")]
    rows += [(902, "long word " * 4000, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, length string").repartition(4)
    got = packing.packed(docs, vocabulary(), capacity=128)
    assert got.columns == ["doc_id", "piece", "start", "length", "sequence_id", "offset", "ids"]
    pieces = got.collect()
    encoder = Tokenizer.from_file(vocabulary())
    whole = Counter()
    for i, t, _ in rows:
        ids = [*encoder.encode(t or "", add_special_tokens=False).ids, 1]
        for piece, start in enumerate(range(0, len(ids), 128)):
            whole[i, piece, start, tuple(ids[start : start + 128])] += 1
    assert Counter((p.doc_id, p.piece, p.start, tuple(np.frombuffer(p.ids, "<u4").tolist())) for p in pieces) == whole
    rests = one_by_one([p.length for p in pieces], 128)
    assert len({p.sequence_id for p in pieces}) == len(rests)
    sequences = {r.sequence_id: r.ids for r in packing.sequence_rows(got).collect()}
    assert sorted(128 - len(s) // 4 for s in sequences.values()) == rests
    for p in pieces:
        assert sequences[p.sequence_id][4 * p.offset : 4 * (p.offset + p.length)] == p.ids
    assert packing.packed(docs.limit(0), vocabulary()).collect() == []
