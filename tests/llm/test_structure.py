"""Conversation repair, Merkle manifest and decontamination against brute force, with the odd cases."""

import collections
import hashlib
import heapq
import itertools
import random
import re
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quaymark.llm import decontamination, dialogue_repair, merkle

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")

# conversation repair


def brute_damage(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        k = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if k == 1:
            text = ""
        if k == 2:
            text = re.sub("[.!?]", "", text)
        out += [(conv, turn, "user" if k == 4 else role, text)] * (0 if k == 0 else 2 if k == 3 else 1)
    return out


def cheapest(turns):
    """The least (cost, audit) by a search over prefixes of edits, and what it makes; turns are (role, text, fault)."""
    heap, done = [(0, "", 0, "", ())], set()
    while heap:
        cost, audit, at, roles, out = heapq.heappop(heap)
        if at == len(turns) and re.fullmatch("(s?(ua)+)?", roles):
            return cost, audit, list(out)
        if (at, roles) in done or not re.fullmatch("(s?(ua)*u?)?", roles):
            continue
        done.add((at, roles))
        for r in ("user", "assistant"):
            heapq.heappush(heap, (cost + 5, audit + "I", at, roles + r[0], (*out, (r, ""))))
        if at < len(turns):
            role, text, fault = turns[at]
            heapq.heappush(heap, (cost + 2, audit + "D", at + 1, roles, out))
            if fault not in ("blank", "duplicate"):
                late = 5 * (fault == "truncated")
                if role[:1] in ("s", "u", "a"):
                    heapq.heappush(heap, (cost + late, audit + "K", at + 1, roles + role[0], (*out, (role, text))))
                for r in ("user", "assistant"):
                    heapq.heappush(heap, (cost + late + 1, audit + "R", at + 1, roles + r[0], (*out, (r, text))))
    raise AssertionError("no repair")


def brute_repair(rows):
    by, out = collections.defaultdict(list), {}
    for conv, turn, role, text in brute_damage(rows):
        by[conv].append((turn is not None, turn or 0, role, text))
    for conv in {r[0] for r in rows}:
        turns, seen = sorted(by[conv]), set()
        faults = []
        for _, _, role, text in turns:
            end = re.sub(r"[\x20\x09-\x0D]+\Z", "", text)[-1:]
            faults.append("blank" if not end else "duplicate" if (role, text) in seen else "" if end in ".!?" else "truncated")
            seen.add((role, text))
        known = [t for has, t, _, _ in turns if has]
        letters = [r[:1] for _, _, r, _ in turns]
        cost, audit, made = cheapest([(r, t, f) for (_, _, r, t), f in zip(turns, faults, strict=True)])
        out[conv] = (max(known) - min(known) + 1 - len(set(known)) if known else 0, *[faults.count(f) for f in ("blank", "duplicate", "truncated")],
                     sum(a + b not in ("su", "ua", "au") for a, b in itertools.pairwise(letters)), cost, audit, hashlib.sha256("\n".join(f"{r}:{t}" for r, t in made).encode()).hexdigest())
    return out


CONV = "conv_id long, turn long, role string, text string, seen string, cost int"


def conversations(seed):
    rng = random.Random(seed)
    rows = []
    for conv in [*range(120), None]:
        turns = rng.sample(range(40), rng.randrange(1, 8)) + rng.choice([[], [None], [3, 3]])
        for turn in turns:
            rows.append((conv, turn, rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None]), rng.choice(["Yes.", "Yes.", "no", "Why?  \n", " \t", None, f"word {turn} of {conv}!"])))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_repair_equals_search(spark, seed):
    rows = conversations(seed)
    df = spark.createDataFrame([(*r, "clash", 7) for r in rows], CONV).repartition(5)
    got = dialogue_repair.repair(dialogue_repair.damage(df), df).collect()
    assert {r["conv_id"]: tuple(r)[1:] for r in got} == brute_repair(rows) and len(got) == len({r[0] for r in rows})


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text("suaxSUAXbd", max_size=8), min_size=1, max_size=6))
def test_shared_suffixes(signs):
    automaton, roles = dialogue_repair.Suffixes(), {"s": "system", "u": "user", "a": "assistant", "x": "tool"}
    for each in sorted(signs, key=lambda x: x[::-1]) + signs:  # in the order of the automaton, then in any
        turns = [(roles.get(c.lower(), "user"), "t", {"b": "blank", "d": "duplicate"}.get(c, "truncated" if c.isupper() else "")) for c in each]
        assert automaton.solve(each[::-1]) == cheapest(turns)[:2]


def test_repaired_turns(spark, data):
    rows = spark.read.parquet(f"{data}/conversations.parquet")
    turns, audits = dialogue_repair.audit(dialogue_repair.damage(rows), rows)
    by = collections.defaultdict(list)
    for r in dialogue_repair.repaired_turns(turns, audits).orderBy("conv_id", "position").collect():
        by[r["conv_id"]].append(r)
    for r in dialogue_repair.digests(turns, audits).collect():
        made = by[r["conv_id"]]
        assert re.fullmatch("(s?(ua)+)?", "".join(x["role"][0] for x in made)) and [x["edit"] for x in made] == [e for e in r["audit"] if e != "D"]
        assert r["repaired_sha256"] == hashlib.sha256("\n".join(f"{x['role']}:{x['text']}" for x in made).encode()).hexdigest()


def test_repair_of_long_and_no_conversations(spark):
    rows = [(1, k, "user" if k % 2 == 0 else "assistant", f"{k}.") for k in range(3001)]
    df = spark.createDataFrame([(*r, "", 0) for r in rows], CONV)
    got = dialogue_repair.repair(df).collect()
    assert [(r["cost"], r["audit"]) for r in got] == [(2, "K" * 3000 + "D")]
    assert dialogue_repair.repair(df.where("false")).count() == 0
    gone = dialogue_repair.repair(df.where("false"), df).collect()
    assert [tuple(r) for r in gone] == [(1, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]


# Merkle manifest


def digest(s):
    return hashlib.sha256(s.encode()).hexdigest()


def tree(level):
    levels = [level]
    while len(levels[-1]) > 1:
        levels.append([digest("".join(levels[-1][k : k + 8])) for k in range(0, len(levels[-1]), 8)])
    return levels


def siblings(levels, k):
    for level in levels[:-1]:
        b = k // 8 * 8
        yield "".join(level[b:k]), "".join(level[k + 1 : b + 8])
        k //= 8


def brute_manifest(rows):
    def leaf(r, text):
        return digest("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (r[0], r[3], r[2], r[4], text)))

    by = collections.defaultdict(list)
    for r in rows:
        by[r[2]].append(r)
    order = sorted(by, key=lambda g: (g is not None, (g or "").encode()))
    for g in order:
        by[g].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r, r[1])))
    trees = [tree([leaf(r, r[1]) for r in by[g]]) for g in order]
    top = tree([t[-1][0] for t in trees])
    out = []
    for j, g in enumerate(order):
        for k, r in enumerate(by[g]):
            path = [*siblings(trees[j], k), *siblings(top, j)]
            altered = r[0] is not None and r[1] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0
            x = leaf(r, r[1].translate(LOW) if altered else r[1])
            for a, b in path:
                x = digest(a + x + b)
            out.append((r[0], trees[j][0][k], trees[j][-1][0], top[-1][0], digest("".join(a + b for a, b in path)), x, x == top[-1][0]))
    return collections.Counter(out)


DOCS = "doc_id long, text string, lang string, source string, n_chars long, tree string, rank int, path string"


def manifest_of(df):
    found = merkle.verify(merkle.build(merkle.document_leaves(df)))
    return found.select("key", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


@pytest.mark.parametrize("sizes", [{"en": 1}, {"en": 8, None: 1, "": 9}, {"en": 1300, "de": 65, None: 513, "Zz": 512, "é": 2} | {f"l{k}": 1 for k in range(70)}])
def test_manifest_equals_brute_force(spark, sizes):
    rng = random.Random(5)
    rows = [(rng.choice([rng.randrange(10**6), rng.randrange(40), None]), rng.choice(["Aé b", "abc", "", None, f"Text {rng.random()}"]), g, rng.choice(["s", None]), rng.choice([1, None])) for g, n in sizes.items() for _ in range(n)]
    rows += rows[:3]
    df = spark.createDataFrame([(*r, "x", 1, "y") for r in rows], DOCS).repartition(4)
    assert collections.Counter(map(tuple, manifest_of(df).collect())) == brute_manifest(rows)


def test_manifest_proofs_and_nothing(spark):
    df = spark.createDataFrame([(k, f"t{k}", "en" if k % 3 else "fr", None, k, "", 0, "") for k in range(100)], DOCS)
    made = merkle.build(merkle.document_leaves(df))
    for r in merkle.verify(made, proofs=True).collect():
        path = [(p["before"], p["after"]) for p in r["proof"]]
        assert merkle.fold(r["leaf"], path) == r["root"] and digest("".join(a + b for a, b in path)) == r["proof_sha256"]
    assert manifest_of(df.where("false")).count() == 0
    for cells in made.trees[:1]:  # intervals of the nodes: nested, without gaps
        for r in cells.collect():
            assert [m["rank"] for m in r["nodes"]] == list(range(r["lo"], r["hi"])) and r["lo"] == r["cell"] * merkle.CELL


# decontamination

WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def brute_hits(docs, items, size=10):
    def split(t):
        return WORDS.findall((t or "").translate(LOW))

    held = collections.defaultdict(set)
    for item, text in items:
        w = split(text)
        n = min(size, len(w))
        for k in range(len(w) - n + 1 if n else 0):
            held[tuple(w[k : k + n])].add(item)
    out = []
    for doc, text in docs:
        w, hit, found = split(text), set(), set()
        for n in {len(x) for x in held}:
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) in held:
                    hit.update(range(k, k + n))
                    found |= held[tuple(w[k : k + n])]
        ids = sorted(str(x) for x in found if x is not None)
        out.append((doc, len(w), len(hit), len(ids), hashlib.sha256(",".join(ids).encode()).hexdigest(), bool(hit)))
    return collections.Counter(out)


def hits_of(spark, docs, items, size=10):
    d = spark.createDataFrame([(*r, 1, "x") for r in docs], "doc_id long, text string, row int, window string").repartition(3)
    b = spark.createDataFrame([(*r, 1, "x") for r in items], "item_id long, text string, key int, n string")
    return collections.Counter(map(tuple, decontamination.assess(d, b, size).collect()))


@pytest.mark.parametrize("seed", range(4))
def test_decontamination_equals_brute_force(spark, seed):
    rng = random.Random(seed)
    vocabulary = ["A", "b", "c", "É", "7", "x-y", "ü_", " q"]
    items = [(rng.choice([1, 2, 3, None, 10, 11]), " ".join(rng.choices(vocabulary, k=rng.choice([3, 4, 5, 6, 8, 10, 12, 15, 30])))) for _ in range(12)] + [(5, None), (6, ""), (7, " .,- "), (8, items_of(rng))]
    docs = [(rng.choice([1, 2, 3, 4, None]), " ".join(rng.choices(vocabulary, k=rng.randrange(0, 60))) + "." + (rng.choice(items)[1] or "") * 2 + " zz") for _ in range(60)]
    docs += [(9, None), (9, ""), (9, None), (11, "a " * 9000), *docs[:4]]
    assert hits_of(spark, docs, items) == brute_hits(docs, items)
    assert hits_of(spark, docs, items, 7) == brute_hits(docs, items, 7)


def items_of(rng):
    return " ".join(f"w{rng.randrange(5)}" for _ in range(12))


def test_decontamination_of_nothing(spark):
    docs = [(1, "one two three"), (2, None)]
    assert hits_of(spark, docs, []) == brute_hits(docs, [])
    assert not hits_of(spark, [], [(1, "one two")])


def test_bitmap_too_small_changes_nothing(spark, monkeypatch):
    """Whatever passes the bitmap by chance is dropped by the join."""
    rng = random.Random(3)
    items = [(k, " ".join(f"w{rng.randrange(30)}" for _ in range(14))) for k in range(8)]
    docs = [(k, " ".join(f"w{rng.randrange(30)}" for _ in range(40)) + " " + items[k % 8][1][5:]) for k in range(40)]
    monkeypatch.setattr(decontamination, "in_bitmap", lambda bits, h: h == h)
    assert hits_of(spark, docs, items) == brute_hits(docs, items)
