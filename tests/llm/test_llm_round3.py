"""SimHash by vantage-point trees, conversation repair, fill-in-middle assembly."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from commentmill.llm import ann_tree, bloom_dedup, fim_assembly, survivor_repair, tensor_minhash, vantage_simhash


# --- vantage-point trees -----------------------------------------------------------------


def plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(fps, radius=3):
    root = list(range(len(fps)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= radius:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(fps))]


def test_fingerprints_equal_the_definition():
    draw = random.Random(3)
    texts = [None, "", " \t\n", "One", "one TWO", "ÄB äb c d", "a\x0bb\x0cc\rd e", "x " * 20_000]
    texts += [" ".join(draw.choice("abcdefgh") for _ in range(draw.randint(1, 80))) for _ in range(40)]
    for t in texts:
        assert vantage_simhash.fingerprint(t) % 2**64 == plain_fingerprint(t)


def crowd(seed, n, centres):
    """Fingerprints around some centres, chains of near ones among them."""
    draw = random.Random(seed)
    found = set()
    for _ in range(centres):
        x = draw.getrandbits(64)
        for _ in range(n // centres):
            found.add(x)
            for b in draw.sample(range(64), draw.choice([0, 1, 2, 3, 3, 4])):
                x ^= 1 << b
            x = x if draw.random() < 0.9 else draw.getrandbits(64)
    return sorted(found)


@pytest.mark.parametrize("shard,leaf", [(16_384, 128), (40, 8), (7, 2)])
def test_links_connect_what_all_pairs_connect(spark, monkeypatch, shard, leaf):
    monkeypatch.setattr(vantage_simhash, "SHARD", shard)
    monkeypatch.setattr(vantage_simhash, "LEAF", leaf)
    fps = crowd(shard, 600, 12) + crowd(1, 40, 40)
    want = plain_components(fps)
    df = spark.createDataFrame([(f if f < 2**63 else f - 2**64,) for f in fps], "fp bigint").repartition(4)
    found = vantage_simhash.links(df).collect()
    place = {f: i for i, f in enumerate(fps)}
    ends = [(place[r["a"] % 2**64], place[r["b"] % 2**64]) for r in found]
    assert all((fps[a] ^ fps[b]).bit_count() <= 3 for a, b in ends)
    root = list(range(len(fps)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in ends:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    assert [find(i) for i in range(len(fps))] == want


def test_a_crowd_gives_fewer_links_than_pairs():
    draw = random.Random(5)
    points = {sum(1 << b for b in draw.sample(range(24), draw.randint(0, 3))) for _ in range(2_000)}
    points = np.array(sorted(points), np.uint64)
    shard = vantage_simhash.Shard(points, 3)
    assert len(shard.join()) == len(points) - 1
    assert len(set(shard.label)) == 1
    assert len(shard.join(np.array([1 << 60, 3 << 60, 63 << 40], np.uint64))) == 2


def test_simhash_components_of_rows(spark):
    base = " ".join(f"w{i}" for i in range(400))
    rows = [("b", base), ("a", base.upper()), (None, base), ("c", base + " tail"), ("e", None), ("d", " "),
            ("f", "other words"), ("f", "other words"), ("g", "lone words here")]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id string, text string, fp int, least string")
    got = vantage_simhash.near_duplicates(df).collect()
    assert len(got) == len(rows)
    fps = {r: plain_fingerprint(r[1]) for r in rows}
    names = [r for r in rows if r[0] is not None]
    for r in rows:
        near = [x for x in names if (fps[x] ^ fps[r]).bit_count() <= 3]
        line = {(g["fingerprint"], g["component_id"]) for g in got if g["doc_id"] == r[0]}
        assert (f"{fps[r]:016x}", min(x[0] for x in near)) in line
    assert vantage_simhash.near_duplicates(df.limit(0)).collect() == []


# --- conversation repair -----------------------------------------------------------------


def plain_faults(rows):
    """(turn, role, text) by turn -> fault of each."""
    seen, out = set(), []
    for _, role, text in rows:
        words = text.strip(" \t\n\x0b\x0c\r")
        out.append("blank" if not words else "duplicate" if (role, text) in seen else
                   "truncated" if words[-1] not in ".!?" else None)
        seen.add((role, text))
    return out


def plain_repair(rows):
    """(cost, audit, turns) by keeping whole ways: cost and edits per state, all inserts tried."""
    step = {"": {"s": "s", "u": "u"}, "s": {"u": "u"}, "u": {"a": "a"}, "a": {"u": "u"}}
    name = {"u": "user", "a": "assistant"}
    ways = {"": (0, "", ())}

    def put(to, way, into):
        if to not in into or way[:2] < into[to][:2]:
            into[to] = way

    def with_inserts(ways):
        out = dict(ways)
        for _ in range(4):
            for state, (cost, edits, turns) in list(out.items()):
                for r in "ua":
                    if r in step[state]:
                        put(step[state][r], (cost + 2, edits + "I", (*turns, f"{name[r]}:")), out)
        return out

    for (_, role, text), fault in zip(rows, plain_faults(rows), strict=True):
        new, late = {}, int(fault == "truncated")
        for state, (cost, edits, turns) in with_inserts(ways).items():
            put(state, (cost + 3, edits + "D", turns), new)
            if fault in ("blank", "duplicate"):
                continue
            if role[:1] in step[state]:
                put(step[state][role[:1]], (cost + late, edits + "K", (*turns, f"{role}:{text}")), new)
            for r in "ua":
                if r in step[state]:
                    put(step[state][r], (cost + 2 + late, edits + "R", (*turns, f"{name[r]}:{text}")), new)
        ways = new
    return min(way for state, way in with_inserts(ways).items() if state in ("", "a"))


def random_conversations(seed, n, longest):
    draw = random.Random(seed)
    rows = []
    for c in range(n):
        turn = 0
        for _ in range(draw.randint(1, longest)):
            turn += draw.choice([0, 1, 1, 1, 2])
            rows.append((c, draw.choice([turn, turn, turn, None]), draw.choice(["user", "assistant", "system", "tool", "user"]),
                         draw.choice(["Hi.", "Why?", "So on", " ", "", "a b!  ", f"t{draw.randint(0, 50)}."])))
    return rows


def test_repair_equals_whole_ways(spark):
    rows = random_conversations(1, 120, 14) + [(c + 1000, *r[1:]) for r in random_conversations(2, 3, 300) for c in [r[0]]]
    rows += [(5000, i, "user", "Same words.") for i in range(400)] + [(5001, 1, "user", "x" * 300_000)]
    df = spark.createDataFrame([(*r, "other") for r in rows],
                               "conv_id bigint, turn bigint, role string, text string, said string").repartition(5)
    edits = survivor_repair.repair(df)
    got = {r["conv_id"]: r for r in survivor_repair.audit(edits, df.select("conv_id")).collect()}
    assert len(got) == len({r[0] for r in rows})
    for conv, line in got.items():
        mine = sorted((r[1:] for r in rows if r[0] == conv), key=lambda r: (r[0] is not None, r[0] or 0, *r[1:]))
        cost, audit, turns = plain_repair(mine)
        faults = plain_faults(mine)
        initials = [r[1][:1] for r in mine]
        turns_there = {r[0] for r in mine if r[0] is not None}
        assert (line["cost"], line["audit"]) == (cost, audit), conv
        assert line["repaired_sha256"] == hashlib.sha256("\n".join(turns).encode()).hexdigest()
        assert [line[f] for f in ("blank", "duplicate", "truncated")] == [
            faults.count(f) for f in ("blank", "duplicate", "truncated")]
        assert line["illegal"] == sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False))
        assert line["gaps"] == (max(turns_there) - min(turns_there) + 1 - len(turns_there) if turns_there else 0)


def test_repair_of_nulls_and_missing_conversations(spark):
    schema = "conv_id bigint, turn bigint, role string, text string"
    df = spark.createDataFrame([(None, None, None, None), (None, 2, "user", "Hi."), (None, None, "assistant", None),
                                (1, 1, "", "Hi.")], schema)
    every = spark.createDataFrame([(None,), (1,), (2,)], "conv_id bigint")
    got = {r["conv_id"]: r for r in survivor_repair.audit(survivor_repair.repair(df), every).collect()}
    assert (got[None]["audit"], got[None]["blank"], got[None]["cost"]) == ("DDKI", 2, 8)
    # an empty role is no user's: deleting it is cheaper than another role and an answer
    assert (got[1]["audit"], got[1]["cost"]) == ("D", 3)
    assert (got[2]["audit"], got[2]["cost"], got[2]["repaired_sha256"]) == ("", 0, hashlib.sha256(b"").hexdigest())
    assert survivor_repair.repair(df.limit(0)).count() == 0


def test_undecided_edits_stay_few():
    decoder, out = survivor_repair.Decoder(), []
    for i in range(20_000):
        role = ("user", "assistant")[i % 2]
        out += decoder.push((i, role, "Hi.", None, False), role[0], False, False)
    cost, rest = decoder.finish()
    assert cost == 0 and len(out) + len(rest) == 20_000 and decoder.most_held < 40


def test_damage_follows_the_number_of_each_row(spark):
    rows = [(c, t, "assistant", "Well. Yes!") for c in range(20) for t in range(20)] + [(None, None, None, None)]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    want = []
    for c, t, role, text in rows:
        c0, t0, role, text = (" " if v is None else v for v in (c, t, role, text))
        kind = zlib.crc32(f"{c0}:{t0}".encode()) % 20
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        want += [(c, t, "user" if kind == 4 else role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    assert sorted(map(tuple, survivor_repair.damaged(df).collect()), key=str) == sorted(want, key=str)


# --- fill in the middle ------------------------------------------------------------------


def plain_fim(doc_id, text):
    text = text or ""
    lines = re.findall(r"[^\n]*\n|[^\n]+", text)
    sha = hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, _, h4 = (int(sha[i:i + 8], 16) for i in (0, 8, 16, 24))
    n = len(lines)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = "".join(lines[:a]), "".join(lines[a:b]), "".join(lines[b:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")):
        form, out, chars = "plain", text, (None, None)
    elif h4 % 100 < 50:
        form, out, chars = "spm", f"<S>{s}<P>{p}<M>{m}", (len(p), len(m))
    else:
        form, out, chars = "psm", f"<P>{p}<S>{s}<M>{m}", (len(p), len(m))
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    return (doc_id, n, form, *chars, sha(out), sha(text)), out


def fim_rows():
    draw = random.Random(4)
    rows = [(None, "a\nb"), (1, None), (2, ""), (3, "\n"), (4, "no break"), (5, "a<P>b\nc"), (6, "<\nP>\n<S"),
            (7, "é\n漢字\n\n\n😀"), (8, "x" * 200_000 + "\n" + "y\n" * 90_000), (8, "other"), (9, "same\ntext"), (9, "same\ntext")]
    rows += [(i, "".join(draw.choice(["ab", "\n", "ü ", "<", "M>"]) for _ in range(draw.randint(0, 60)))) for i in range(20, 80)]
    return rows


def test_fim_equals_the_definition(spark):
    rows = fim_rows()
    df = spark.createDataFrame([(*r, "k") for r in rows], "doc_id bigint, text string, key string").repartition(3)
    got = sorted((tuple(r) for r in fim_assembly.fill_in_middle(df).collect()), key=repr)
    assert got == sorted((plain_fim(*r)[0] for r in rows), key=repr)
    assert fim_assembly.fill_in_middle(df.limit(0)).collect() == []


def test_fim_outputs_in_pieces(spark):
    rows = [(f"id{i}", t) for i, (_, t) in enumerate(fim_rows())]
    got = {}
    pieces = fim_assembly.outputs(spark.createDataFrame(rows, "doc_id string, text string")).collect()
    for r in sorted(pieces, key=lambda r: (bytes(r["key"]), r["at"])):
        assert len(r["piece"].encode()) <= fim_assembly.PIECE
        name = got.setdefault(bytes(r["key"]), [r["doc_id"], ""])
        name[1] += r["piece"]
    assert sorted(map(tuple, got.values())) == sorted((i, plain_fim(i, t)[1]) for i, t in rows)


def test_plain_share_is_a_parameter(spark):
    df = spark.range(40).select(F.col("id").alias("doc_id"), F.lit("a\nb\nc").alias("text"))
    forms = {r["form"] for r in fim_assembly.fill_in_middle(df, rate=0).collect()}
    assert forms == {"plain"}


# --- near and exact duplicates: repeated ids, crowded buckets ------------------------------


def test_an_id_with_two_texts_loses_neither(spark):
    a, b = (" ".join(f"{x}{i}" for i in range(30)) for x in "ab")
    schema = "doc_id bigint, text string, __sha int, s string"
    rows = [(7, a), (7, b), (9, b), (3, a), (None, a), (None, a), (5, None), (5, None)]
    df = spark.createDataFrame([(*r, 1, "") for r in rows], schema)
    left = sorted(((r["doc_id"], r["text"]) for r in tensor_minhash.drop_near_duplicates(df).collect()), key=str)
    assert left == sorted([(3, a), (7, b), (None, a), (None, a), (5, None), (5, None)], key=str)


def test_rows_repeated_whole_stay_once(spark):
    text = " ".join(f"w{i}" for i in range(30))
    rows = [(3, text), (3, text), (3, text.upper()), (7, text), (8, "one line"), (8, "one line")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    near = [r["doc_id"] for r in tensor_minhash.drop_near_duplicates(df).collect()]
    assert sorted(near) == [3, 8]
    exact = [r["doc_id"] for r in bloom_dedup.drop_duplicates(df).collect()]
    assert sorted(exact) == [7, 8]


def test_near_duplicates_of_text_ids(spark):
    text = " ".join(f"w{i}" for i in range(30))
    df = spark.createDataFrame([("b", text), ("a", text + " x"), ("c", "else")], "doc_id string, text string")
    got = {r["doc_id"]: (r["component_id"], r["kept"]) for r in tensor_minhash.near_duplicates(df).collect()}
    assert got == {"a": ("a", True), "b": ("a", False), "c": ("c", True)}


@pytest.mark.parametrize("bucket,block", [(16, 256), (2, 5)])
def test_links_hidden_in_crowds_are_found(spark, monkeypatch, bucket, block):
    from test_llm_corpus import family_rows, plain_near

    monkeypatch.setattr(tensor_minhash, "SMALL_BUCKET", bucket)
    monkeypatch.setattr(tensor_minhash, "BLOCK_SETS", block)
    draw = random.Random(bucket)
    rows = family_rows(9)
    base = [f"v{i}" for i in range(100)]
    for i in range(60):  # members that are near some others only
        t = list(base)
        for j in range(i % 12, 100, 12 if i % 3 else 30):
            t[j] = f"z{i % 20}-{j}"
        rows.append((1_000 + i, " ".join(t + [f"u{draw.randint(0, 9)}"])))
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in tensor_minhash.near_duplicates(df, width=4).collect()}
    assert got == plain_near(rows, 4)


def test_shared_shingles_are_counted_in_parts(monkeypatch):
    monkeypatch.setattr(tensor_minhash, "BLOCK_SHINGLES", 7)
    draw = np.random.Generator(np.random.PCG64(1))
    left, right = ([np.unique(draw.integers(0, 60, draw.integers(1, 40))) for _ in range(n)] for n in (9, 5))
    want = [[len(np.intersect1d(a, b)) for b in right] for a in left]
    assert tensor_minhash._shared(left, right).tolist() == want
    assert tensor_minhash._shared([np.array([1])], [np.array([2])]).tolist() == [[0]]


# --- neighbours: ties ----------------------------------------------------------------------


def product(a, b):
    total = 0.0
    for x, y in zip(a, b, strict=True):  # in order, as sum() compensates
        total += x * y
    return total


def plain_neighbours(rows, queries, k):
    out = []
    for q in queries:
        scores = sorted((-product(rows[q], v), i) for i, v in rows.items() if i != q)
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scores[:k])]
    return out


def test_small_integer_vectors_tie_by_id():
    draw = np.random.Generator(np.random.PCG64(2))
    points, ids = draw.integers(-1, 2, (400, 4)).astype(float), draw.permutation(400)
    asks = draw.integers(-1, 2, (30, 4)).astype(float)
    got = ann_tree._top(asks, np.arange(30), points, ids, 21)
    for q in range(30):
        want = sorted((-float(p @ asks[q]), int(i)) for p, i in zip(points, ids, strict=True))[:21]
        mine = got[got["q"] == q]
        assert [(-s, i) for s, i in zip(mine["score"], mine["rep"], strict=True)] == want


def test_search_over_tied_vectors_equals_brute_force(spark):
    draw = np.random.Generator(np.random.PCG64(3))
    rows = {i: draw.integers(-1, 2, 3).astype(float).tolist() for i in range(700)}
    rows |= {1000 + i: draw.normal(size=3).tolist() for i in range(300)}
    rows = {i: v for i, v in rows.items() if any(v)}
    df = spark.createDataFrame(list(rows.items()), "vec_id bigint, embedding array<double>").repartition(3)
    got = sorted(map(tuple, ann_tree.search(df, F.col("vec_id") % 20 == 0, k=20, target=1.0).collect()))
    assert got == plain_neighbours(rows, sorted(i for i in rows if i % 20 == 0), 20)
