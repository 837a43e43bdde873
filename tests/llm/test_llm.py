"""The text-preparation operators against brute force, exact round trips and held-out accuracy, and on odd input."""

import collections
import hashlib
import random
import struct
import zlib

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from cellweave import storage
from cellweave.llm import chat_format, components, embedding_dedup, language_id, line_dedup, media, mixing, ngram_join, packing, quality, toxicity
from cellweave.llm.queries import QUERIES, tokenizer_path
from cellweave.storage import Scratch

DOCS = "doc_id long, text string, lang string, source string, n_chars long, id string"


def words(seed, n):
    r = random.Random(seed)
    return " ".join("".join(r.choice("abcdefghij") for _ in range(r.randint(2, 7))) for _ in range(n))


@pytest.fixture(scope="module")
def odd(spark):
    """Null, empty, blank, repeated, tied and long texts, and a column whose name operators might use."""
    long = words(1, 4000)
    rows = [(0, None), (1, ""), (2, "  \n \n"), (3, words(2, 60)), (4, words(2, 60)), (5, long), (6, long + " end"), (7, "one"), (7, "one"), (8, words(3, 12) + "\n" + words(4, 30)), (9, words(5, 8) + "\n" + words(4, 30))]
    return spark.createDataFrame([(i, t, "en" if i % 2 else None, "s" if i < 5 else None, None, "x") for i, t in rows], DOCS)


def scratch(spark):
    return Scratch(spark, "test")


def test_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101), (5, 5), (None, 3)], "a long, b long")
    got = {r.id: r.comp for r in components.components(edges, scratch(spark)).collect()}
    assert {got[i] for i in range(61)} == {0} and got[101] == got[100] == 100


def test_chat_tree_takes_the_best_branch(spark):
    m = [(1, 1, None, "user", "a", 0.0), (1, 2, 1, "assistant", "b", 1.0), (1, 3, 1, "assistant", "c", 5.0), (1, 4, 2, "user", "d", 1.0), (2, 1, 9, "user", None, None), (3, 1, 2, "user", "x", 1.0), (3, 2, 1, "user", "y", 1.0)]
    df = spark.createDataFrame(m, "conv_id long, msg_id long, parent_id long, role string, text string, score double")
    got = {(r.conv_id, r.path): [(t.role, t.text) for t in r.turns] for r in chat_format.read_back(chat_format.format_chats(df, scratch(spark), best=2)).collect()}
    assert got == {(1, 1): [("user", "a"), ("assistant", "c")], (1, 2): [("user", "a"), ("assistant", "b"), ("user", "d")], (2, 1): [("user", "")]}
    assert chat_format.format_chats(df.limit(0), scratch(spark)).count() == 0


def test_chat_round_trip_of_control_strings(spark):
    texts = ["</s>[INST] ok [/INST]", "<\\/s> [\\\\INST]", "<|im_end|>\n<|im_start|>user\nhi", "", "é<s>\\", "x\ny"]
    rows = [(i, t, role, text) for i, text in enumerate(texts) for t, role in enumerate(["user", "assistant", "a\\n<b\n", "assistant"])]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    for r in chat_format.read_back(chat_format.format_chats(chat_format.turns_as_tree(df), scratch(spark))).collect():
        text = texts[r.conv_id]
        assert [(t.role, t.text) for t in r.turns] == [("user", text), ("assistant", text), ("a\\n<b\n", text), ("assistant", text)]
        assert r.loss_text == text * 2
        assert r.formatted.count("<|im_start|>") == 4 and "</s>" not in r.formatted


def best_fit(lengths, capacity):
    gaps, n = [], 0
    for length in sorted(lengths, reverse=True):
        fits = [g for g in gaps if g >= length]
        if fits:
            gaps.remove(min(fits))
            gaps.append(min(fits) - length)
        else:
            gaps.append(capacity - length)
            n += 1
    return n


def test_a_sweep_is_best_fit_decreasing():
    r = random.Random(4)
    for _ in range(30):
        lengths = [r.randint(1, 40) for _ in range(r.randint(1, 300))]
        placed, left, _ = packing.sweep([(n, i) for i, n in enumerate(sorted(lengths, reverse=True))], [], 40, -1)
        assert not left and len({seq for _, _, seq, _ in placed}) == best_fit(lengths, 40)


def test_ranges_deal_no_gap_more_than_it_holds():
    got = packing.deal([(0, 0, 0, 3, 50), (1, 2, 30, 1, 20), (2, 9, 7, 0, 0)])
    assert got == [(1, 0, 2, 0, 1, 1), (2, 0, 2, 1, 0, 2), (2, 2, 9, 0, 0, 7)]


def test_packing_in_many_ranges_and_rounds(spark):
    """Ranges of 40 rows: every piece has one place, no sequence overflows, and hardly more sequences than sequential best fit."""
    r = random.Random(9)
    docs = spark.createDataFrame([(None if i % 50 == 0 else (1 << 60) + i, " ".join(["a"] * (5 if i % 3 == 0 else r.randint(0, 150)))) for i in range(600)], "doc_id long, text string")
    got = packing.pack(docs, scratch(spark), tokenizer_path(), 64, 40).collect()
    n_tokens = [len(x.text.split()) + 1 for x in docs.collect()]
    want = [p for n in n_tokens for p in [64] * (n // 64) + [n % 64] * (n % 64 > 0)]
    assert sorted(p.length for p in got) == sorted(want)
    assert {p.doc_id for p in got} == {x.doc_id for x in docs.collect()}
    seq = collections.defaultdict(list)
    for p in got:
        seq[p.sequence_id].append((p.offset, p.length))
    for places in seq.values():
        ends = [0]
        for offset, length in sorted(places):
            assert offset == ends[-1]
            ends.append(offset + length)
        assert ends[-1] <= 64
    assert len(seq) <= 1.02 * best_fit(want, 64) + 1


def test_packing_places_every_piece(spark, odd):
    got = packing.pack(odd, scratch(spark), tokenizer_path(), 64).collect()
    seq = collections.defaultdict(list)
    for p in got:
        seq[p.sequence_id].append((p.offset, p.length))
    for places in seq.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 64
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path())
    for row in odd.where("doc_id in (0, 1, 3, 5)").collect():
        ids = t.encode(row.text or "", add_special_tokens=False).ids + [0]
        mine = sorted((p for p in got if p.doc_id == row.doc_id), key=lambda p: p.piece)
        assert [p.ids_crc32 for p in mine] == [zlib.crc32(struct.pack(f"<{len(x)}I", *x)) for x in (ids[i : i + 64] for i in range(0, len(ids), 64))]
    assert packing.pack(odd.limit(0), scratch(spark), tokenizer_path()).count() == 0


def test_word_tokens_equal_whole_texts():
    from tokenizers import Tokenizer

    t, mine = Tokenizer.from_file(tokenizer_path()), packing.WordTokens(tokenizer_path())
    for text in ["It's a TEST, don't... x9y İΣς straße  two\tthree　four", "<|endoftext|>a", "é ́x .,. a.b, 漢字、かな", "ﬁn 1,234.5"]:
        assert np.frombuffer(mine.encode(text), "<u4").tolist() == t.encode(text, add_special_tokens=False).ids


def test_line_dedup_against_brute_force(spark, odd):
    base = [words(i, 40) for i in range(6)]
    near = [b.rsplit(" ", 1)[0] + " changed" for b in base]
    docs = [(i, "\n".join([base[i % 6], near[(i + 1) % 6], words(100 + i, 30), ""])) for i in range(8)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r.doc_id: (r.text, r.line_dedup) for r in line_dedup.line_dedup(df, scratch(spark)).collect()}
    seen = []
    sets = lambda s: {s[k : k + 9] for k in range(max(1, len(s) - 8))}
    for i, text in docs:
        kept = []
        for line in text.split("\n"):
            dup = line and any(len(sets(line) & s) / len(sets(line) | s) >= 0.8 for s in seen)
            if line:
                seen.append(sets(line))
            if not dup:
                kept.append(line)
        assert got[i][0] == "\n".join(kept)
    done = {r.doc_id: r.text for r in line_dedup.line_dedup(odd, scratch(spark)).collect()}
    assert done[0] is None and done[2] == "  \n \n" and done[4] == "" and done[9] == words(5, 8)
    assert set(odd.columns) <= set(line_dedup.line_dedup(odd, scratch(spark)).columns)
    assert line_dedup.line_dedup(odd.limit(0), scratch(spark)).count() == 0


def test_ngram_join_against_brute_force(spark, odd):
    r = random.Random(9)
    docs = []
    for g in range(12):
        base = words(g, 80).split()
        for _ in range(12):
            w = list(base)
            for _ in range(r.randint(0, 3)):
                w[r.randrange(len(w))] = "x" + str(r.randint(0, 99))
            docs.append(" ".join(w))
    docs += [docs[0], docs[0], "", "a b", "a b"]
    df = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    got = {x.doc_id: x for x in ngram_join.ngram_join(df, scratch(spark)).collect()}

    def sets(t):
        w = t.split()
        return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()

    s = [sets(t) for t in docs]
    for i in range(len(docs)):
        n = sum(j != i and bool(s[i]) and len(s[i] & s[j]) >= 0.8 * len(s[i] | s[j]) - 1e-9 for j in range(len(docs)))
        assert got[i].n_links == n
        assert got[i].class_id == docs.index(docs[i])
    kept = ngram_join.one_per_group(odd, scratch(spark))
    assert kept.columns == odd.columns and {r.doc_id for r in kept.collect()} == {0, 2, 3, 5, 7, 8, 9}
    assert ngram_join.ngram_join(odd.limit(0), scratch(spark)).count() == 0


def test_line_dedup_in_large_buckets(spark, monkeypatch):
    """Near copies of one line that share a bucket, cut into several tiles: the components of brute force."""
    monkeypatch.setattr(line_dedup, "SLAB", 8)
    monkeypatch.setattr(components, "SWEEPS", 0)
    r, base = random.Random(6), words(12, 60).split()
    docs = [(i, " ".join(w if r.random() > 0.02 else f"w{r.randrange(9)}" for w in base)) for i in range(40)]
    got = line_dedup.line_groups(spark.createDataFrame(docs, "doc_id long, text string"), scratch(spark)).collect()
    sets = [{t[k : k + 9] for k in range(len(t) - 8)} for _, t in docs]
    near = [[j for j in range(40) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])] for i in range(40)]
    group = list(range(40))
    while (new := [min(group[j] for j in near[i]) for i in range(40)]) != group:
        group = new
    sizes = collections.Counter(group[i] for i, (_, t) in enumerate(docs) if t not in [u for _, u in docs[:i]])
    assert collections.Counter(x.keep_doc for x in got) == {k: n for k, n in sizes.items() if n > 1}


def test_line_dedup_recall(spark):
    """Lines of few words (a label and a long run, one space in CJK text, a URL) are found as ordinary ones are; near is what brute force says."""
    r = random.Random(8)
    run = lambda n, of="abcdefghijklmnopqrstuvwxyz0123456789": "".join(r.choice(of) for _ in range(n))
    cjk = "".join(map(chr, range(0x4E00, 0x5E00)))

    def pair(kind):
        if kind == "label":
            tail = run(150)
            return f"{run(5)} {tail}", f"{run(5)} {tail}"
        if kind == "cjk":
            a, b = run(75, cjk), run(75, cjk)
            return f"{a} {b}", f"{run(5, cjk)}{a[5:]} {b}"
        if kind == "url":
            tail = f"{run(12)}.org/{run(60)}?k={run(60)}"
            return f"see{run(2)} https://{tail}", f"see{run(2)} https://{tail}"
        line = [run(r.randint(4, 9)) for _ in range(16)]
        at = r.randrange(16)
        return " ".join(line), " ".join([*line[:at], "#" + line[at][1:], *line[at + 1 :]])

    sets = lambda s: {s[k : k + 9] for k in range(len(s) - 8)}
    pairs = [(kind, *pair(kind)) for kind in ("label", "cjk", "url", "prose") for _ in range(250)]
    pairs = [p for p in pairs if len(sets(p[1]) & sets(p[2])) >= 0.8 * len(sets(p[1]) | sets(p[2]))]
    docs = spark.createDataFrame([(2 * i + k, t) for i, p in enumerate(pairs) for k, t in enumerate(p[1:])], "doc_id long, text string")
    kept = {x.doc_id: x.text for x in line_dedup.line_dedup(docs, scratch(spark)).collect()}
    assert all(kept[2 * i] == p[1] for i, p in enumerate(pairs))
    of = collections.Counter(p[0] for p in pairs)
    found = collections.Counter(p[0] for i, p in enumerate(pairs) if kept[2 * i + 1] == "")
    recall = {k: found[k] / n for k, n in of.items()}
    assert min(of.values()) > 150 and min(recall.values()) >= 0.985, recall


def test_ngram_join_in_large_buckets(spark, monkeypatch):
    """A group of copies of one text in which many words are changed, cut into several tiles: every link, compared with brute force."""
    monkeypatch.setattr(ngram_join, "SLAB", 20)
    monkeypatch.setattr(components, "SWEEPS", 0)
    r = random.Random(5)
    base = words(11, 150).split()
    docs = []
    for i in range(110):
        mine = list(base)
        for _ in range(r.randint(1, 4)):
            mine[r.randrange(150)] = f"w{r.random()}"
        docs.append((i, " ".join(mine)))
    got = {x.doc_id: x for x in ngram_join.ngram_join(spark.createDataFrame(docs, "doc_id long, text string"), scratch(spark)).collect()}
    sets = [set(zip(*[t.split()[k:] for k in range(5)], strict=False)) for _, t in docs]
    near = [[j for j in range(110) if j != i and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])] for i in range(110)]
    group = list(range(110))
    while (new := [min([group[i], *[group[j] for j in near[i]]]) for i in range(110)]) != group:
        group = new
    assert [got[i].group_id for i in range(110)] == group
    assert [got[i].n_links for i in range(110)] == [len(x) for x in near]


def test_null_and_repeated_ids_are_rows_of_their_own(spark):
    """Rows under one id or none, with different texts: nothing unique goes, and copies among them do."""
    a, b, c, d = (words(300 + i, 40) for i in range(4))
    rows = [(None, a), (None, b), (None, a + " end"), (5, c), (5, d), (6, d)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    kept = collections.Counter((x.doc_id, x.text) for x in ngram_join.one_per_group(df, scratch(spark)).collect())
    one = {(None, a), (None, a + " end")} & set(kept)
    assert len(one) == 1 and kept == collections.Counter([*one, (None, b), (5, c), (5, d)])
    u = [words(400 + i, 30) for i in range(7)]
    rows = [(None, f"{u[0]}\n{u[1]}\n{c}"), (None, f"{u[2]}\n{u[3]}\n{u[4]}"), (3, f"{u[5]}\n{c}"), (4, u[6]), (4, u[5])]
    done = line_dedup.line_dedup(spark.createDataFrame(rows, "doc_id long, text string"), scratch(spark)).collect()
    want = [(None, f"{u[0]}\n{u[1]}"), (None, f"{u[2]}\n{u[3]}\n{u[4]}"), (3, f"{u[5]}\n{c}"), (4, u[6]), (4, "")]
    assert collections.Counter((x.doc_id, x.text) for x in done) == collections.Counter(want)


@pytest.mark.parametrize("blocks", [1, 2])
def test_block_pairs_are_counted_in_bounded_tiles(monkeypatch, blocks):
    """A block of any size: no array of pairs beyond ``BLOCK`` by ``BLOCK``, and the links of brute force."""
    r, base, n = random.Random(3), words(23, 120).split(), 300
    texts = [" ".join(w if r.random() > 0.015 else f"w{r.random()}" for w in base) for _ in range(n)]
    sets = [ngram_join.grams(t) for t in texts]
    block, copies = np.arange(n) % blocks, np.arange(n) % 3 + 1
    pdf = pd.DataFrame({"id": np.arange(n)[::-1], "copies": copies, "comp": 0, "block": block, "bi": 0, "bj": blocks - 1, "sig": [ngram_join.minhash(g).tobytes() for g in sets], "grams": [g.tobytes() for g in sets]})
    most, prune = [], ngram_join.prune
    monkeypatch.setattr(ngram_join, "prune", lambda a, b, least: most.append(len(a)) or prune(a, b, least))
    got = ngram_join._count_block(pdf, 0.8, ngram_join.least_matches()).set_index("id")["links"]
    want = [sum(int(copies[j]) for j in range(n) if j != i and (blocks == 1 or block[i] != block[j]) and ngram_join.jaccard(sets[i], sets[j]) >= 0.8) for i in range(n)]
    assert [got[n - 1 - i] for i in range(n)] == want and 0 < sum(want) < n * n
    assert max(most) <= ngram_join.BLOCK**2


def test_blocks_do_not_grow_with_the_component(spark):
    m = [2, 128, 129, 2048, 20_000, 200_000, 5_000_000]
    got = [x[0] for x in spark.createDataFrame([(x,) for x in m], "m long").select(ngram_join._blocks(F.col("m"), F.lit(0))).collect()]
    assert got[:4] == [1, 1, 2, 16] and all(x / n <= ngram_join.MOST for x, n in zip(m, got, strict=True))


def test_forest_unites_what_is_linked():
    """Links across components inside a tile and between two tiles; a pair that shares an earlier band belongs to that band's bucket."""
    texts = [words(21, 120), words(21, 120) + " x y", words(22, 120), words(22, 120) + " z"]
    grams = [ngram_join.grams(t).tobytes() for t in texts]
    sig = np.stack([ngram_join.minhash(np.frombuffer(g, np.uint64)) for g in grams])
    sig[:, :4] = 7  # one bucket holds all
    ids = np.arange(4)
    least = ngram_join.least_matches()
    assert ngram_join._forest(ids, ids, sig, grams, 0, 0.8, least) == [(0, 1), (2, 3)]
    assert ngram_join._forest(ids, ids, sig, grams, 2, 0.8, least) == []
    assert ngram_join._forest(ids[[0, 2, 1, 3]], ids[[0, 2, 1, 3]], sig[[0, 2, 1, 3]], [grams[x] for x in (0, 2, 1, 3)], 2, 0.8, least) == [(0, 1), (2, 3)]
    assert ngram_join._forest(ids, np.zeros(4, int), sig, grams, 0, 0.8, least) == []
    sig[:, :4] = [[7] * 4, [7] * 4, [8] * 4, [8] * 4]
    sig[:, 4:8] = 7
    assert ngram_join._forest(ids, ids, sig, grams, 0, 0.8, least) == []


def test_mixing_targets_and_quotas(spark, odd):
    docs = [(i, f"s{i % 5}", " ".join(["w"] * (1 + i % 37 * (9 if i % 5 == 0 else 1)))) for i in range(600)]
    df = spark.createDataFrame(docs, "doc_id long, source string, text string")
    got = mixing.mix(df, scratch(spark), block=4, shard_docs=40).collect()
    taken, target = collections.Counter(), {}
    for r in got:
        assert 0 <= r.taken <= 3 * r.size
        taken[r.source] += r.taken
        target[r.source] = r.target
        assert r.target <= 3 * r.source_size + 1e-6
    assert sum(target.values()) == pytest.approx(sum(r.size for r in got))
    for s, t in target.items():
        assert taken[s] == pytest.approx(t, rel=0.02, abs=8)
    again = {r.doc_id: r.taken for r in mixing.mix(df.repartition(7), scratch(spark), block=4, shard_docs=40).collect()}
    assert again == {r.doc_id: r.taken for r in got}
    assert mixing.mix(odd, scratch(spark)).count() == odd.count()
    mixed = mixing.apply_mix(df, scratch(spark), block=4, shard_docs=40)
    assert mixed.select(F.sum(mixing.size_of())).first()[0] == sum(taken.values())
    assert mixing.mix(odd.limit(0), scratch(spark)).count() == 0


def test_sainte_lague(spark):
    p = spark.createDataFrame([("a", 53.0), ("b", 24.0), ("c", 23.0)], "k string, v double").withColumns({"g": F.lit(1), "s": F.lit(7)})
    assert {r.k: r.quota for r in mixing.sainte_lague(p, ["g"], ["k"], "v", "s").collect()} == {"a": 3, "b": 2, "c": 2}


@pytest.mark.parametrize("seed", range(4))
def test_sainte_lague_against_brute_force(spark, seed):
    r = random.Random(seed)
    groups = {g: ([r.choice([0, 1, 5, 5, 1000, 10**9]) if seed % 2 else r.randint(0, 50) for _ in range(r.choice([1, 2, 30, 90]))], r.randint(0, 4000)) for g in range(6)}
    rows = [(g, k, v, s) for g, (votes, s) in groups.items() for k, v in enumerate(votes)]
    got = {(q.g, q.k): q.quota for q in mixing.sainte_lague(spark.createDataFrame(rows, "g long, k long, v long, s long"), ["g"], ["k"], "v", "s").collect()}
    for g, (votes, s) in groups.items():
        want = [0] * len(votes)
        for _ in range(s if any(votes) else 0):
            want[min((k for k in range(len(votes)) if votes[k]), key=lambda k: (-votes[k] / (2 * want[k] + 1), k))] += 1
        assert [got[g, k] for k in range(len(votes))] == want


def test_two_thousand_parties_fill_every_seat(spark):
    p = spark.range(2000).select(F.lit(1).alias("g"), F.col("id").alias("k"), (F.col("id") % 97 + 1).alias("v"), F.lit(70_001).alias("s"))
    assert mixing.sainte_lague(p, ["g"], ["k"], "v", "s").agg(F.sum("quota")).first()[0] == 70_001


def test_embeddings_against_brute_force(spark):
    r = np.random.default_rng(3)
    base = r.normal(size=(40, 16))
    x = np.vstack([base, base[:20] + r.normal(size=(20, 16)) * 0.07, base[:5] * 3]).astype(np.float32)
    rows = [(i, [float(v) for v in row]) for i, row in enumerate(x)] + [(900, None), (901, [0.0] * 16), (902, [float("nan")] + [1.0] * 15), (903, [None] + [1.0] * 15), (904, []), (905, [1.0, 2.0])]
    got = {q.vec_id: q for q in embedding_dedup.embedding_dedup(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), scratch(spark), block=16).collect()}
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1)[:, None]
    links = ((u @ u.T) >= 0.95).sum(axis=1) - 1
    assert [got[i].n_links for i in range(len(x))] == links.tolist() and links.sum() > 20
    assert all(got[i].n_links == 0 and got[i].kept for i in range(900, 906))
    assert all(got[40 + i].component_id == i for i in range(20) if (u[i] @ u[40 + i]) >= 0.95)


def test_copies_of_vectors_and_odd_rows(spark, monkeypatch):
    """Copies count among the links by broadcast and by shuffle; huge, tiny and repeated rows; an empty table."""
    r = np.random.default_rng(4)
    base = r.normal(size=(6, 8))
    near = base[0] + r.normal(size=8) * 0.02
    x = [base[0]] * 30 + [near] * 3 + [base[1]] * 2 + list(base[2:]) + [base[2] * 1e200, base[3] * 1e-200]
    ids = [None if i == 1 else 7 if i in (5, 6) else i for i in range(len(x))]
    rows = [(i, [float(v) for v in row]) for i, row in zip(ids, x, strict=True)] + [(800, None), (801, [0.0] * 8)]
    u = np.array([v / np.abs(v).max() for v in x])
    u /= np.linalg.norm(u, axis=1)[:, None]
    meets = (u @ u.T) >= 0.95
    want = collections.Counter()
    for i in range(len(x)):
        low = min(k for j, k in enumerate(ids) if meets[i, j] and k is not None)
        want[ids[i], int(meets[i].sum()) - 1, low, ids[i] == low] += 1
    want.update([(800, 0, 800, True), (801, 0, 801, True)])
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    for common in (10, 5000):
        monkeypatch.setattr(embedding_dedup, "COMMON", common)
        assert collections.Counter(tuple(q) for q in embedding_dedup.embedding_dedup(df, scratch(spark), block=4).collect()) == want
    assert embedding_dedup.embedding_dedup(df.limit(0), scratch(spark)).count() == 0


def test_quantisation_bound_holds():
    r = np.random.default_rng(5)
    x = r.normal(size=(200, 32))
    x /= np.linalg.norm(x, axis=1)[:, None]
    q, s, e = embedding_dedup.quantise(x)
    low = (q.astype(float) @ q.T.astype(float)) * s[:, None] * s[None, :]
    assert (np.abs(low - x @ x.T) <= e[:, None] + (1 + e[:, None]) * e[None, :]).all()


def test_ogg_round_trip_and_damage(spark, odd):
    for n in (0, 1, 64, 255 * 16, 4096, 65025, 200_000):
        payload = random.Random(n).randbytes(n)
        data = media.mux(payload)
        streams = media.demux(data)
        assert b"".join(streams[media.SAMPLES].packets[1:]) == payload and all(s.ended for s in streams.values())
        assert streams[media.SAMPLES].granules[-1] == n
        broken = bytearray(data)
        broken[len(data) // 2] ^= 1
        with pytest.raises(ValueError):
            media.demux(bytes(broken))
    for r in media.digest(media.media_columns(odd)).collect():
        if r.doc_id in (0, 1):
            assert (r.n_bytes, r.payload_bytes, r.payload_sha256) == (0, 64, hashlib.sha256(bytes(64)).hexdigest())
    assert media.digest(media.media_columns(odd.limit(0))).count() == 0


def test_page_crc_is_the_oggs():
    crc = 0
    data = b"OggS some page bytes"
    for b in data:
        crc ^= b << 24
        for _ in range(8):
            crc = ((crc << 1) ^ 0x04C11DB7 if crc >> 31 else crc << 1) & 0xFFFFFFFF
    assert media.page_crc(data) == crc


def test_classifiers_held_out(spark):
    r = random.Random(6)
    docs, labels = [], []
    for i in range(900):
        bad = r.random() < 0.2
        text = words(i, 40)
        toxic = r.random() < 0.3
        if toxic:
            text += " " + r.choice(["grobian", "grobians", "lout"])
        docs.append((i, text.upper().replace(" ", "!! ") if bad else text.capitalize() + ".", None, None, None, "x"))
        if i % 3:
            labels.append((i, int(not bad), int(toxic)))
    d, y = spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    truth = {i: (q, t) for i, q, t in labels}
    for got, k in ((toxicity.toxicity(d, y), 1), (quality.quality(d, y), 0)):
        held = [x for x in got.collect() if x.held_out and x.doc_id in truth]
        assert np.mean([x.predicted == truth[x.doc_id][k] for x in held]) > 0.9
    none = y.limit(0)
    assert toxicity.toxicity(d, none).count() == quality.quality(d, none).count() == 900


def test_language_id(spark, odd):
    r = random.Random(8)
    rows = [(i, " ".join("".join(r.choice("aeio" if i % 2 else "krtz") for _ in range(5)) for _ in range(30)), "a" if i % 2 else "k", None, None, "x") for i in range(200)]
    got = language_id.language_id(spark.createDataFrame(rows + [(500, None, "a", None, None, "x"), (501, "12 !", "k", None, None, "x")], DOCS)).collect()
    by = {x.doc_id: x for x in got}
    assert all(by[i].lang_pred == rows[i][2] for i in range(200)) and by[500].lang_pred == by[501].lang_pred == "und"
    assert {x.lang_pred for x in language_id.language_id(odd.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def test_pipeline_stages_follow_each_other(spark):
    import corpus_pipeline

    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    out = Scratch(spark, "stages")
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        before, names = docs.count(), docs.columns
        docs = out.write(stage(spark, docs, d))
        if i < 4:
            assert docs.columns == names and 0 < docs.count() <= 3 * before
    assert {"sequence_id", "offset"} <= set(docs.columns)
    assert corpus_pipeline.run(spark, d).count() == docs.count()


def test_all_ten_are_registered():
    assert [n.split("_")[0] for n in QUERIES] == [f"op{i}" for i in range(1, 11)]


def test_large_ids_stay_beside_nulls(spark):
    """Ids that a double cannot hold, with a null among them, come out as they went in."""
    ids = [(1 << 60) + 1, (1 << 60) + 3, None, -(1 << 62) - 1]
    docs = spark.createDataFrame([(i, words(k, 20), "a") for k, i in enumerate(ids)], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, k % 2, k % 2) for k, i in enumerate(ids)], "doc_id long, quality int, toxic int")
    got = [media.digest(media.media_columns(docs)), toxicity.toxicity(docs, labels), quality.quality(docs, labels), language_id.language_id(docs), ngram_join.ngram_join(docs, scratch(spark))]
    for rows in got:
        assert collections.Counter(r.doc_id for r in rows.collect()) == collections.Counter(ids)


def test_hot_buckets_are_dealt_in_parts(spark, monkeypatch):
    """A bucket of a third of all rows: its members' heads and predecessors still join it into one, in parts of bounded size."""
    monkeypatch.setattr(components, "DRAWN", 1)
    monkeypatch.setattr(components, "HOT", 50)
    monkeypatch.setattr(components, "PART", 40)
    rows = spark.range(600)
    members = lambda r: r.select(F.when(F.col("id") < 200, 7).otherwise(F.col("id") % 301 + 1000).alias("key"), "id")
    got = components.share(members, rows, scratch(spark)).collect()
    hot = [r for r in got if r.key == 7]
    assert {r.id for r in hot} | {0} == set(range(200)) and {(r.head, r.parts) for r in hot} == {(0, 5)}
    assert {r.parts for r in got if r.key != 7} == {1}
    pairs = {(r.head, r.id) for r in got if r.key != 7 and r.prev is not None}
    assert pairs == {(a, b) for a in range(200, 600) for b in range(a + 1, 600) if a % 301 == b % 301}


def _files(spark):
    """Shuffle files and written tables on this machine."""
    import pathlib

    local = pathlib.Path(spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()[0])
    return {p for p in local.rglob("shuffle_*.data")}


def test_scratch_writes_leave_no_shuffle_files(spark):
    """The shuffles of a written table go with the write, and the session's setting stays as it was."""
    before, s = _files(spark), scratch(spark)
    was = spark.conf.get(storage.FREE, None)
    got = s.write(spark.range(2000).repartition(3).groupBy((F.col("id") % 7).alias("k")).count())
    assert got.count() == 7 and spark.conf.get(storage.FREE, None) == was
    left = {p for p in _files(spark) - before}
    assert len(left) <= 4  # those of got.count() itself
    s.close()
    assert s not in storage.OPEN


def test_line_dedup_frees_its_tables_and_compares_in_rounds(spark, monkeypatch):
    """Large buckets compared in many rounds give the same groups as in one, and only what the result reads stays written."""
    import pathlib

    rnd = random.Random(12)
    base = "".join(rnd.choice("abcdefghij ") for _ in range(120))
    docs = [(i, "\n".join(base[: (k := rnd.randint(0, 118))] + rnd.choice("XYZW") + base[k + 1 :] + f" {rnd.randint(0, 30)}" for _ in range(2))) for i in range(40)]
    df = spark.createDataFrame(docs, "doc_id long, text string")

    def groups(s):
        out = collections.defaultdict(set)
        for r in line_dedup.line_groups(df, s).collect():
            out[r.comp].add((r.h1, r.h2))
        return sorted(map(sorted, out.values()))

    monkeypatch.setattr(line_dedup, "SLAB", 8)
    monkeypatch.setattr(components, "SWEEPS", 0)
    first = scratch(spark)
    once = groups(first)
    monkeypatch.setattr(line_dedup, "ROUND", 3_000_000)
    second = scratch(spark)
    assert groups(second) == once and len(once) >= 1
    names = {p.name.rsplit("-", 1)[0] for p in pathlib.Path(second.root.removeprefix("file://")).iterdir()}
    assert names <= {"rows", "own", "near"}


def test_unrelated_lines_of_a_large_bucket_are_not_compared_in_slabs(spark, monkeypatch):
    """One bucket of 300 unrelated lines and 20 pairs of near ones: the pairs are found as by brute force, and no line goes to slabs."""
    pairs = [words(s, 30) for s in range(500, 520)]
    docs = [words(s, 20 + s % 30) for s in range(300)] + pairs + [p + " xy" for p in pairs]
    monkeypatch.setattr(line_dedup, "_keys", lambda: F.array(F.lit(1).cast("long")))
    monkeypatch.setattr(components, "SWEEPS", 0)
    slabs, pair_slabs = [], line_dedup.slab_pairs
    monkeypatch.setattr(line_dedup, "slab_pairs", lambda t: slabs.append(t.count()) or pair_slabs(t))
    got = line_dedup.line_groups(spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string"), scratch(spark)).collect()
    assert sorted((r.keep_doc) for r in got) == sorted(2 * list(range(300, 320)))
    assert sum(slabs) == 0


def test_line_texts_are_read_without_shuffling_the_rest(spark, monkeypatch):
    """Wanted lines come back whole where the bit map is full, coarse or has many rows, and texts beyond them are not shuffled."""
    texts = [(i, "\n".join(f" Line {i} {j}" for j in range(i % 7))) for i in range(300)] + [(300, None), (301, "")]
    docs = spark.createDataFrame(texts, "__row long, text string")
    places = [(10 * i + j, i, j) for i in range(0, 300, 9) for j in range(i % 7)]
    wanted = scratch(spark).write(spark.createDataFrame(places, "id long, __row long, pos int"))
    monkeypatch.setattr(components, "SMALL_BYTES", 0)
    for bits, chunk in ((16, 1024), (16, 1), (1, 1)):
        monkeypatch.setattr(line_dedup, "PLACE_BITS", bits)
        monkeypatch.setattr(line_dedup, "CHUNK", chunk)
        got = line_dedup._texts(docs, wanted)
        assert {(r.id, bytes(r.coded).decode("UTF-16BE")) for r in got.collect()} == {(k, f"line {i} {j}") for k, i, j in places}
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert all("text#" not in line for line in plan.split("\n") if "Join" in line) and plan.index("Join") < plan.index("Generate") < plan.index("text#")
    assert line_dedup._texts(docs, wanted.limit(0)).count() == 0


def test_splitting_a_large_bucket_makes_no_row_for_a_hash_that_many_share(spark, monkeypatch):
    """One bucket of several groups of near copies, each larger than ``MIDDLE``: a written row a membership at most, and the components of brute force."""
    r, base = random.Random(21), words(22, 60).split()
    docs = [" ".join(w if r.random() > 0.03 else f"w{r.randrange(9)}" for w in base) for _ in range(60)]
    monkeypatch.setattr(line_dedup, "_keys", lambda: F.array(F.lit(1).cast("long")))
    monkeypatch.setattr(line_dedup, "MIDDLE", 8)
    monkeypatch.setattr(line_dedup, "SLAB", 8)
    monkeypatch.setattr(components, "SWEEPS", 0)
    counts, write = {}, Scratch.write

    def counted(self, df, name="t"):
        back = write(self, df, name)
        counts[name] = max(counts.get(name, 0), back.count())
        return back

    monkeypatch.setattr(Scratch, "write", counted)
    got = line_dedup.line_groups(spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string"), scratch(spark)).collect()
    sets = [{t[k : k + 9] for k in range(len(t) - 8)} for t in docs]
    group = list(range(60))
    while (new := [min(group[j] for j in range(60) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])) for i in range(60)]) != group:
        group = new
    sizes = collections.Counter(group[docs.index(t)] for t in set(docs))
    assert collections.Counter(x.keep_doc for x in got) == {k: n for k, n in sizes.items() if n > 1}
    assert counts["held"] > line_dedup.MIDDLE and max(counts["rare"], counts.get("inner", 0)) <= counts["held"]


def test_words_are_encoded_as_the_whole_tokenizer_does(monkeypatch):
    """Latin letters, marks, apostrophes and what only looks like them; words of Latin letters and trailing marks never need the whole tokenizer."""
    from tokenizers import Tokenizer

    whole, enc = Tokenizer.from_file(tokenizer_path()), packing.WordTokens(tokenizer_path())
    latin = [chr(c) for c in range(0xC0, 0x100) if c not in (0xD7, 0xF7)]
    fast = [*latin, *(f"a{c}b{c.lower()}" for c in latin), "Été", "Straße", "naïveté,", "word.%%%", "end###", "über...", "ok?!", "A-", *(f"w{m}" for m in packing.MARKS)]
    odd = ["don't", "it's.", "x'", "l'été", "'s", "..", ".", "a.b", "a1.", "3.", "ét", "é.", "Σίσυφος", "ΣΑΣ", "İx", "ﬁn", "ªº", "µ", "×", "÷.", "ab×", "日本。", " x", "x .", "x .", "ẞ", "w…", "", "­", "é́", "ÿŸ"]
    for text in [*fast, *odd, " ".join(fast + odd), "\n".join(odd)]:
        ids = whole.encode(text, add_special_tokens=False).ids
        assert enc.encode(text) == struct.pack(f"<{len(ids)}I", *ids), text
    alone = packing.WordTokens(tokenizer_path())
    alone[""] = b""
    for m in {w[len(w.rstrip(packing.MARKS)) :] for w in fast}:
        alone[m] = enc[m]
    alone.whole = None
    assert [alone[w] for w in fast] == [enc[w] for w in fast]


def test_a_row_signs_several_shingles(spark, monkeypatch):
    """Rows of several shingles give the minima that one row a shingle gives, for any length of a line, and are fewer."""
    texts = [(i, "\n".join([words(i, 3 + i), words(i, 9)[: 9 + i], " \t" + words(7, 12) + "\r"])) for i in range(12)] + [(12, None)]
    docs = spark.createDataFrame(texts, "__row long, text string")
    got = {tuple(r) for r in line_dedup.signed(docs).collect()}
    plan = line_dedup.signed(docs)._jdf.queryExecution().optimizedPlan().toString()
    assert f"Some({2 * line_dedup.STRIDE})" in plan and line_dedup.STRIDE > 1
    monkeypatch.setattr(line_dedup, "STRIDE", 1)
    assert {tuple(r) for r in line_dedup.signed(docs).collect()} == got and len(got) > 20


def test_marks_leave_out_only_pairs_that_are_not_near(spark):
    """Near pairs, with repeated shingles and long lines too, pass by their marks; lines of a similarity of 0.65 or less do not."""
    r, base = random.Random(31), words(32, 60)
    lines = [base[:k] + "#" + base[k + 1 :] for k in (3, 90, 200)] + ["ab" * n for n in (10, 60, 300)] + ["=" * n for n in (9, 80)]
    lines += [words(33, 900), words(33, 900) + " xyz"] + [" ".join(w if r.random() > p else f"w{r.randrange(99)}" for w in base.split()) for p in (0.01, 0.03, 0.1, 0.2) for _ in range(4)]
    sets = [{t[k : k + 9] for k in range(len(t) - 8)} for t in lines]
    marks = line_dedup._marks(spark.createDataFrame(list(enumerate(lines)), "id long, t string").select("id", F.encode("t", "UTF-16BE").alias("coded")))
    pairs = marks.alias("a").join(marks.alias("b"), F.expr("a.id < b.id")).where(line_dedup._may("a.{}", "b.{}", 0.8))
    passed = {tuple(x) for x in pairs.select("a.id", "b.id").collect()}
    like = {(i, j): len(sets[i] & sets[j]) / len(sets[i] | sets[j]) for j in range(len(lines)) for i in range(j)}
    near = {p for p, s in like.items() if s >= 0.8}
    assert len(near) > 8 and near <= passed
    assert not [p for p in passed if like[p] <= 0.65 and {3, 4, 5, 6, 7, 8, 9}.isdisjoint(p)]


def test_sets_are_made_only_for_pairs_whose_marks_allow_it(spark, monkeypatch):
    """One bucket of lines that are alike but not near: no pair of them is compared by its sets."""
    base = words(41, 40).split()
    docs = [" ".join(w if k % 7 else f"x{i}y{k}" for k, w in enumerate(base)) for i in range(24)] + [words(42, 40), words(42, 40) + " zz"]
    sets = [{t[k : k + 9] for k in range(len(t) - 8)} for t in docs]
    assert 0.25 < len(sets[0] & sets[1]) / len(sets[0] | sets[1]) < 0.7
    monkeypatch.setattr(line_dedup, "_keys", lambda: F.array(F.lit(1).cast("long")))
    made, write = [], Scratch.write

    def counted(self, df, name="t"):
        back = write(self, df, name)
        made.extend([back.count()] if name == "pairs" else [])
        return back

    monkeypatch.setattr(Scratch, "write", counted)
    got = line_dedup.line_groups(spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string"), scratch(spark)).collect()
    assert [x.keep_doc for x in got] == [24, 24] and made and sum(made) <= 1


def test_texts_are_read_only_for_lines_that_are_alike(spark, monkeypatch):
    """One bucket of unrelated lines and a near pair: the texts of the pair are read, no others, and the pair is found."""
    docs = [words(s, 40) for s in range(600, 624)] + [words(630, 40), words(630, 40) + " zz"]
    monkeypatch.setattr(line_dedup, "_keys", lambda: F.array(F.lit(1).cast("long")))
    counts, write = collections.Counter(), Scratch.write

    def counted(self, df, name="t"):
        back = write(self, df, name)
        counts[name] += back.count()
        return back

    monkeypatch.setattr(Scratch, "write", counted)
    got = line_dedup.line_groups(spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string"), scratch(spark)).collect()
    assert [x.keep_doc for x in got] == [24, 24] and counts["lines"] == 2


def test_pairs_that_differ_in_one_stretch_are_near_without_sets(spark):
    """What the lengths of common ends prove is near by brute force, with repeated shingles too, and a changed word is proved."""
    r, base = random.Random(51), words(43, 60)
    lines = [base, base[:90] + "#" + base[91:], base[:90] + "changed words" + base[99:], base + " end", "start " + base, base[:40] + base, base[::-1]]
    lines += ["ab" * n for n in (10, 11, 60, 61)] + ["=" * n for n in (9, 10, 80)] + ["ab" * 40 + base[:9] + "ab" * 40, "ab" * 40 + base[:30] + "ab" * 40]
    lines += [base[:k] + words(r.randrange(99), 9)[: r.randint(1, 60)] + base[k + r.randint(0, 50) :] for k in (0, 8, 9, 30, 100, 200) for _ in range(3)]
    sets = [{t[k : k + 9] for k in range(len(t) - 8)} for t in lines]
    pairs = [(i, j, lines[i].encode("UTF-16BE"), lines[j].encode("UTF-16BE"), len(sets[i]), len(sets[j])) for j in range(len(lines)) for i in range(len(lines)) if i != j]
    df = spark.createDataFrame(pairs, "a int, b int, l_a binary, l_b binary, low_a int, low_b int")
    proved = {(x.a, x.b) for x in df.where(F.expr(line_dedup._sure("l_a", "l_b", "low_a", "low_b", 0.8))).select("a", "b").collect()}
    assert all(len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) for i, j in proved)
    assert {(0, 1), (1, 0), (0, 2), (0, 3), (3, 0), (0, 4), (4, 0)} <= proved


def test_buckets_of_one_id_are_left_out_of_shared_ones(spark, monkeypatch):
    """Ids that are alone go; the others keep their neighbours and heads, where a bucket is dealt out in parts too."""
    rows = [(i, [1000 + i, i // 2] if i < 100 else [7777] if i < 180 else [5000 + i]) for i in range(200)]
    members = lambda t: t.select(F.explode("keys").alias("key"), "id")
    df = scratch(spark).write(spark.createDataFrame(rows, "id long, keys array<long>"))
    want = {(k, i) for i, keys in rows for k in keys if k < 1000 or k == 7777}
    monkeypatch.setattr(components, "DRAWN", 4)
    for hot in (10**6, 5):
        monkeypatch.setattr(components, "HOT", hot)
        monkeypatch.setattr(components, "PART", 32)
        got = components.share(members, df, scratch(spark)).collect()
        assert {(x.key, x.id) for x in got} == want and len(got) == len(want)
        assert all(x["head"] == (100 if x.key == 7777 else 2 * x.key) for x in got)
        assert {x.parts > 1 for x in got if x.key == 7777} == {hot == 5}
