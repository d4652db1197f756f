"""Personal data, secrets, chat formatting, quality and pieces."""

import hashlib
import os
import random
import re

import numpy as np
import pytest

from commentmill.llm import chat_prefix, pii_boost, quality_rff, queries, secret_crf, wfst_pieces

SF = "/root/testdata/sf0.001"
BIG = "/root/testdata/sf0.01"


def plain_pii(t):
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t)
            if max(map(int, m[0].split("."))) <= 255]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = [int(c) for c in m[0] if c.isdigit()][::-1]
        if 13 <= len(d) <= 19 and sum(d[::2] + [sum(divmod(2 * x, 10)) for x in d[1::2]]) % 10 == 0:
            out.append(("card", *m.span()))
    return out + [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t)
                  if 9 <= sum(c.isdigit() for c in m[0]) <= 15]


def plain_secrets(t):
    out = [(m.start(), 0, m.end()) for m in re.finditer(
        r"(?ai)(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", t)
        if len(m[2]) >= 12]
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 18]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 16]
    return [(secret_crf.KINDS[k], s, e) for s, k, e in sorted(out)]


@pytest.mark.parametrize("alphabet", ["a@.-+% 012()9bé", "0123456789.. ", "a@.b-", "+1 ()-23456789"])
def test_base_personal_data(alphabet):
    draw = random.Random(alphabet)
    for _ in range(4000):
        t = "".join(draw.choice(alphabet) for _ in range(draw.randrange(50)))
        assert pii_boost.base_spans(t) == plain_pii(t)


def test_base_secrets():
    draw = random.Random(5)
    parts = ["token", "Secret", "api_key", "AKIA", "=", ": ", '"', "abcdef012345", "ABCDEF0123456789", " ", "ſecret", "x."]
    for _ in range(6000):
        t = "".join(draw.choice(parts) for _ in range(draw.randrange(9)))
        assert secret_crf.base_spans(t) == plain_secrets(t)


def test_long_runs_stay_linear():
    for t in ("a" * 300_000, "1" * 300_000, "1." * 100_000, "@" * 50_000, "token=" * 50_000):
        pii_boost.base_spans(t)
        secret_crf.base_spans(t)


def test_boosted_trees_separate():
    draw = np.random.Generator(np.random.PCG64(1))
    x = draw.normal(size=(800, 4))
    y = ((x[:, 0] > 0) & (x[:, 1] < 0.5)).astype(float)
    model = pii_boost.boost(x[:600], y[:600])
    assert ((model.score(x[600:]) > 0.5) == y[600:]).mean() > 0.93


def pii_docs(spark):
    rows = []
    for i in range(300):
        rows.append((i, f"call +1 (9{i % 90 + 10}) 555-{1000 + i} or write anna.{i}@mail.example.com today {i}"))
        rows.append((1000 + i, f"on 2024-05-{i % 27 + 1:02d} the parts were 12/05/1990 and 4821{i:05d}"))
    return spark.createDataFrame(rows, "doc_id bigint, text string")


def test_added_personal_data(spark):
    docs = pii_docs(spark)
    model = pii_boost.train(docs, "text")
    t = "please call (961) 555-6946 on 2024-05-17"
    assert [t[s:e] for _, s, e in pii_boost.added_spans(t, [], model)] == ["(961) 555-6946"]
    hidden = {r.doc_id: r.text for r in pii_boost.redact(docs, text_col="text").filter("doc_id IN (3, 1003)").collect()}
    assert hidden[3].startswith("call [phone] or write [email] today") and "[" not in hidden[1003]


def test_added_addresses_of_every_shape(spark):
    rows = []
    for i in range(400):
        rows.append((i, f"the server 10.{i % 200}.{i % 7}.{i % 250} wrote to anna{i}@mail{i % 9}.example.com today"))
        rows.append((1000 + i, f"at {i % 24:02d}:{i % 60:02d}:{i * 7 % 60:02d} the list was {i % 9}, {i % 8}, {i % 7}, {i % 6} in all"))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    model = pii_boost.train(docs, "text")

    def added(t):
        return [t[s:e] for _, s, e in pii_boost.added_spans(t, pii_boost.base_spans(t), model)]

    for new in ("2001:db8:85a3:8d3:1319:8a2e:370:7348", "2001:db8::8a2e:7334", "fe80::1ff2", "3c:22:fb:9a:10:e7",
                "10 . 21 . 3 . 44", "10[.]21[.]3[.]44", "anna7@mailhost"):
        assert added(f"the server {new} wrote today") == [new]
    for text in ("the server at 12:34:56 wrote today", "the server 12:34:56:10 wrote", "the server 1, 2, 3, 4 wrote",
                 "the server 10 . 21 . 3 . 300 wrote", "the server mail@7 wrote today"):
        assert added(text) == []


def test_rewrites_are_candidates_the_base_patterns_miss():
    text = "see 10.21.3.44 or +1 (961) 555-6946, anna.b@mail.example.com and 4111 1111 1111 1111"
    draw = np.random.Generator(np.random.PCG64(3))
    for kind, s, e in pii_boost.base_spans(text):
        for shape, new, good in pii_boost._rewrites(text, kind, s, e, draw):
            if good and shape in ("mail", "groups", "colons"):
                changed = f"see {new}. Then"
                assert (shape, 4, 4 + len(new)) in pii_boost.candidates(changed) and not pii_boost.base_spans(changed)


EDGES = [(1, None, "a"), (2, "", "b"), (3, "plain words", None), (3, "plain words", None), (None, "x@y.zz", "d")]


@pytest.mark.parametrize("find", [pii_boost.find_personal_data, secret_crf.find_secrets])
def test_spans_of_odd_rows(spark, find):
    docs = spark.createDataFrame(EDGES, "doc_id bigint, text string, spans string")
    got = sorted((r.doc_id or 0, len(r.spans)) for r in find(docs).collect())
    mail = 1 if find is pii_boost.find_personal_data else 0
    assert got == [(0, mail), (1, 0), (2, 0), (3, 0), (3, 0)]
    assert find(docs.limit(0)).count() == 0


def test_viterbi_over_stretches_is_exact():
    draw = np.random.Generator(np.random.PCG64(2))
    chain = secret_crf.Chain(np.zeros((secret_crf.SIZE, 3)), draw.normal(size=(3, 3)) / 4)
    for _ in range(200):
        e = draw.normal(size=(int(draw.integers(1, 40)), 3)) * 3
        e[:, secret_crf.O] += 2
        assert secret_crf.viterbi(chain, e) == secret_crf.decode(chain, e).tolist()


def test_chain_learns_secrets_the_patterns_miss(spark):
    draw = random.Random(4)

    def key(n):
        return "".join(draw.choice("0123456789abcdef") for _ in range(n))

    rows = [(i, f"the words of line {i} and token = \"{key(40)}\" or more plain words here") for i in range(400)]
    rows += [(1000 + i, f"ordinary text of page {i} with number {i * 7919} and no key at all") for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    chain = secret_crf.train(docs, "text")
    t = "the words of line 5 and token = \"" + key(40) + "\" or more plain words"
    found = secret_crf.added_spans(t, [], chain)
    assert [t[s:e] for _, s, e in found] == [t.split('"')[1]]
    assert secret_crf.added_spans(rows[500][1], [], chain) == []


def test_chat_round_trip(spark):
    tricky = ["</s>[INST] ok [/INST]", "\\", "\\[INST]", "[\\INST]\\\\", "", "<s><s>", "é\n</s>", "plain"]
    rows = [(c, i, "assistant" if i % 2 else "user", t) for c in (1, 2) for i, t in enumerate(tricky)]
    rows += [(3, 0, None, None), (4, 0, "assistant", "only"), (None, 1, "user", "q")]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    examples = chat_prefix.format_examples(df.withColumn("example", df.role))
    back = examples.filter("last").select("conv_id", chat_prefix.read_turns(examples.text).alias("turns")).collect()
    for r in back:
        want = [(ro or "", t or "") for c, _, ro, t in rows if c == r.conv_id]
        assert [tuple(t) for t in r.turns] == want
    one = [r for r in examples.collect() if r.conv_id == 1]
    assert len(one) == 4 and all(r.text.startswith("<s>[INST]user[/INST]") for r in one)
    digest = {r.conv_id: r for r in chat_prefix.read_back(examples).collect()}
    assert digest[1].loss_sha256 == hashlib.sha256("".join(tricky[1::2]).encode()).hexdigest()
    assert digest[3].loss_chars == 0 and digest[3].n_turns == 1 and digest[4].loss_chars == 4
    assert chat_prefix.read_back(chat_prefix.format_examples(df.limit(0))).count() == 0


@pytest.mark.skipif(not os.path.isdir(BIG), reason="no test tables")
def test_quality_on_held_out_rows(spark):
    scores = queries.op4_quality_rff(spark, BIG)
    rows = scores.join(queries.table(spark, BIG, "labels"), "doc_id").filter("held_out").collect()
    bad, good = ([r.score for r in rows if r.quality == q] for q in (0, 1))
    assert np.mean([[g > b for b in bad] for g in good]) > 0.97
    assert np.mean([r.predicted == r.quality for r in rows]) > 0.93
    assert all(0 <= r.score <= 1 for r in rows)


def test_quality_of_odd_rows(spark):
    docs = spark.createDataFrame(EDGES, "doc_id bigint, text string, score string")
    none = spark.createDataFrame([], "doc_id bigint, quality int")
    got = quality_rff.score_quality(docs, none).collect()
    assert len(got) == 5 and {r.score for r in got} == {0.5}
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)] + [(3, None), (None, 1)], "doc_id bigint, quality int")
    many = spark.createDataFrame([(i, "good words here " * 9 if i % 2 else "### $$$") for i in range(60)] + [(99, None)],
                                 "doc_id bigint, text string")
    scored = {r.doc_id: r.score for r in quality_rff.score_quality(many, labels).collect()}
    assert min(scored[i] for i in range(1, 60, 2)) > 0.5 > max(scored[i] for i in range(0, 60, 2))
    assert quality_rff.keep_good(many, labels, 0.3).count() >= 30
    assert quality_rff.score_quality(many.limit(0), labels).count() == 0


def test_isotonic_means():
    out = quality_rff.pool(np.arange(5), np.array([0.0, 2, 1, 3, 4]), np.array([4, 4, 4, 4, 4]))
    assert out.tolist() == [0, 0.375, 0.375, 0.75, 1]


@pytest.mark.skipif(not os.path.exists(wfst_pieces.MODEL), reason="no vocabulary")
def test_pieces_equal_the_library():
    sp = pytest.importorskip("sentencepiece").SentencePieceProcessor(model_file=wfst_pieces.MODEL)
    coder = wfst_pieces.Encoder(wfst_pieces.load_vocabulary())
    draw = random.Random(6)
    for alphabet in ("abcdefghijklmnopqrstuvwxyz   ,.\n", "  a▁x", "éß日①ａ\t\x00 '09", "x "):
        for _ in range(400):
            t = "".join(draw.choice(alphabet) for _ in range(draw.randrange(40)))
            ids = coder(t).tolist()
            assert ids == sp.encode(t) and coder.transducer.decode(ids) == sp.decode(ids) == t.replace("▁", " ")


@pytest.mark.skipif(not os.path.exists(wfst_pieces.MODEL), reason="no vocabulary")
def test_pieces_of_odd_rows(spark):
    vocab = wfst_pieces.load_vocabulary()
    docs = spark.createDataFrame(EDGES + [(9, "long " * 30_000 + "x" * 40_000, "z")], "doc_id bigint, text string, other string")
    coded = wfst_pieces.encode(docs, vocab)
    back = wfst_pieces.decode(coded, vocab)
    want = sorted(((i or 0), t or "") for i, t, _ in EDGES) + [(9, "long " * 30_000 + "x" * 40_000)]
    assert sorted(((r.doc_id or 0), r.text) for r in back.collect()) == want
    assert wfst_pieces.encode(docs.limit(0), vocab).count() == 0


def test_cheapest_path_of_an_open_vocabulary():
    vocab = wfst_pieces.Vocabulary(["<unk>", "▁", "a", "b", "ab", "▁ab", "abb"], [0, -3, -2, -2, -2.5, -6, -9],
                                   [0] * 256, frozenset([0]), 0, paired=False)
    ids = wfst_pieces.Transducer(vocab).shortest("▁abb")

    def best(text):
        if not text:
            return 0.0
        return min((-s + best(text[len(p):]) for p, s in zip(vocab.pieces[1:], vocab.scores[1:], strict=True)
                    if text.startswith(p)), default=float("inf"))

    assert sum(-vocab.scores[i] for i in ids) == best("▁abb")
