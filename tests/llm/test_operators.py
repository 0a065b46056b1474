"""The ten corpus operators on small tables: brute force, round trips and odd inputs."""

from __future__ import annotations

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from orbweave.llm import chat, decontam, encoder, fingerprint, idstore, jaccard, langid, packing, queries, secrets, tokencount, toxicity
from orbweave.llm import kernels as K

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, spans string"
WORDS = re.compile(r"[a-z0-9_\u0080-\U0010ffff]+")


def docs(spark, rows):
    """Documents with columns whose names clash with results."""
    full = [(i, t, *(rest or ("en",)), "src", None if t is None else len(t), 0.5, "x") for i, t, *rest in rows]
    return spark.createDataFrame(full, DOCS)


def prose(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}" + rng.choice(["", "", "", ".", ","]) for _ in range(n))


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{SF}/documents.parquet'")
    want = con.execute(queries.oracle_sql()[name]).df()
    got = queries.queries()[name](spark, SF).toPandas()
    assert sorted(got.columns) == sorted(want.columns) and len(got)
    order = sorted(got.columns)
    got, want = (x[order].sort_values("doc_id").reset_index(drop=True) for x in (got, want))
    pd.testing.assert_frame_equal(got, want, check_dtype=False, rtol=1e-9)


# --- kernels

TEXT = st.text(st.sampled_from(list("ab AB.,'’é\n\t  <|>0　日\x1cß")), max_size=60)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.none(), TEXT), min_size=1, max_size=6))
def test_words_are_the_runs_of_word_characters(texts):
    p = K.words(pa.array(texts, pa.string()))
    for i, t in enumerate(texts):
        assert [p.string(k) for k in range(p.first[i], p.first[i + 1])] == WORDS.findall(pa.compute.utf8_lower(t).as_py() if t else "")


def test_equal_strings_have_equal_hashes_wherever_they_are():
    p = K.words(pa.array(["xyz abc", "abc", "pad " * 5000 + "abc abd"]))
    by = collections.defaultdict(set)
    for i in range(len(p)):
        by[p.string(i)].add(int(p.hash[i]))
    assert all(len(v) == 1 for v in by.values()) and len({*map(tuple, by.values())}) == len(by)


@pytest.mark.parametrize("n", range(1, 7))
def test_shingles_of_few_words(n):
    for counts in [(k,) for k in range(7)] + [(0, 2), (2, 1), (3, 0, 1), (1, 6, 2)]:
        texts = [" ".join(f"t{i}w{j}" for j in range(k)) for i, k in enumerate(counts)]
        h, doc = K.shingles(K.words(pa.array(texts, pa.string())), n)
        assert doc.tolist() == [i for i, k in enumerate(counts) for _ in range(max(1, k - n + 1) if k else 0)]
        assert len(set(h.tolist())) == len(h)
        for i, t in enumerate(texts):  # a text's shingles don't depend on what else is in the batch
            assert h[doc == i].tolist() == K.shingles(K.words(pa.array([t])), n)[0].tolist()


def test_a_piece_longer_than_a_block():
    long = "a" * (K.BLOCK + 100)
    p = K.words(pa.array([long, "b", long]))
    assert p.hash[0] == p.hash[2] != p.hash[1]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_units_encode_as_the_library_does(name):
    tk, enc = encoder.tokenizer(encoder.vocabulary(name)), encoder.Encoder(encoder.vocabulary(name))

    @settings(max_examples=80, deadline=None)
    @given(st.lists(st.one_of(st.none(), TEXT, st.text(max_size=20)), min_size=1, max_size=5))
    def same(texts):
        ids, off = enc.encode(pa.array(texts, pa.string()))
        for i, t in enumerate(texts):
            assert ids[off[i] : off[i + 1]].tolist() == tk.encode(t or "", add_special_tokens=False).ids

    same()


# --- 1 chat


def turns_of(windows):
    out = collections.defaultdict(list)
    for w in sorted(windows, key=lambda w: (w["conv_id"] is not None, w["conv_id"], w["window"])):
        out[w["conv_id"]] += chat.parse(w["formatted"][w["fresh_from"] :])
    return out


def test_chat_windows_keep_every_turn_once(spark):
    rng = random.Random(1)
    rows = []
    for c in range(12):
        system = c % 3 == 0
        for t in range(rng.randrange(1, 30)):
            role = "system" if system and not t else ("user", "assistant")[t % 2]
            rows.append((c, t, role, prose(rng, rng.randrange(0, 120)), 7))
    rows += [(99, 0, "user", None, 1), (99, 0, "assistant", "tie", 1), (99, 0, "assistant", "tie", 1), (99, None, None, "first", 1), (None, 1, "user", "lone", 1), (98, 0, "role\nwith <|im_end|> \\", "a\\<|b\\l<|im_start|>", 1), (97, 0, "assistant", "x y " * 5000, 1)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, window int")
    made = chat.windows(df, budget=300, history=90).collect()
    want = collections.defaultdict(list)
    for c, t, role, text, _ in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")):
        want[c].append((role or "", text or ""))
    assert turns_of(made) == want
    tk = encoder.tokenizer(encoder.vocabulary("byte_bpe_50k.json"))
    losses = collections.defaultdict(str)
    for w in sorted(made, key=lambda w: w["window"]):
        assert w["n_tokens"] == len(tk.encode(w["formatted"], add_special_tokens=False).ids)
        assert w["n_tokens"] <= 300 or w["n_new"] - (w["window"] == 0 and want[w["conv_id"]][0][0] == "system") == 1
        losses[w["conv_id"]] += "".join(chat.unescape(w["formatted"][s["start"] : s["end"]]) for s in w["loss"])
        if w["conv_id"] is not None and w["conv_id"] % 3 == 0 and w["conv_id"] < 12:
            assert chat.parse(w["formatted"])[0][0] == "system"
    for c, said in want.items():
        assert losses[c] == "".join(t for r, t in said if r == "assistant")
    assert any(w["n_history"] for w in made)
    told = {r["conv_id"]: r for r in chat.digests(chat.windows(df, budget=300, history=90)).collect()}
    assert {c: r["n_turns"] for c, r in told.items()} == {c: len(v) for c, v in want.items()}
    assert told[0]["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in want[0]).encode()).hexdigest()
    assert chat.digests(chat.windows(df.limit(0))).collect() == []


def test_windows_of_short_turns_and_control_strings_stay_within_the_budget(spark):
    rows = [(0, t, ("user", "assistant")[t % 2], "ok") for t in range(3000)] + [(1, t, "a role\n<|x|>", "<|im_end|>\\ <| \n\n" * (t % 9)) for t in range(400)]
    tk = encoder.tokenizer(encoder.vocabulary("byte_bpe_50k.json"))
    made = chat.windows(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    real = [len(tk.encode(w["formatted"], add_special_tokens=False).ids) for w in made]
    assert [w["n_tokens"] for w in made] == real and max(real) <= chat.BUDGET and max(real) > chat.BUDGET - 40


@settings(max_examples=100, deadline=None)
@given(st.text(st.sampled_from(list("<|\\l\nab>"))), st.text(st.sampled_from(list("<|\\l\nab>"))))
def test_escapes_are_reversible(role, text):
    formatted = f"<|im_start|>{chat.escape_role(role)}\n{chat.escape(text)}<|im_end|>\n"
    assert chat.parse(formatted * 2) == [(role, text)] * 2


# --- 2 decontamination


def test_leaks_are_found_and_clean_documents_left(spark):
    rng = random.Random(2)
    items = [(k, " ".join(f"q{rng.randrange(3000)}" for _ in range(rng.randrange(12, 50))) + ".") for k in range(25)]
    rows, want = [], set()
    for d in range(120):
        text = prose(rng, rng.randrange(20, 300))
        if d % 6 == 0:
            k = d % 25
            leak = items[k][1].split()
            if d % 12 == 0:  # a paraphrase: every sixth word another, two swapped
                leak = [f"z{d}" if i % 6 == 5 else w for i, w in enumerate(leak)]
            at = rng.randrange(len(text))
            text = text[:at] + "\n" + " ".join(leak).upper() + " " + text[at:]
            want.add((d, k))
        rows.append((d, text))
    rows += [(500, None), (501, ""), (502, "!!"), (0, rows[0][1]), (None, items[3][1])]
    df, bench = docs(spark, rows), spark.createDataFrame([*items, (90, None), (91, ""), (92, "w1 w2"), (3, items[3][1])], "item_id long, text string")
    found = decontam.leaks(df, bench).collect()
    assert {(r["doc_id"], r["item_id"]) for r in found} == want | {(None, 3)}
    assert sum(r["doc_id"] == 0 for r in found) == 2
    kept = decontam.remove(df, bench)
    assert kept.columns == df.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted({d for d, *_ in rows if d is not None} - {d for d, _ in want})
    assert decontam.leaks(df.limit(0), bench).count() == decontam.leaks(df, bench.limit(0)).count() == 0


def brute_leak(item, answer, h):
    """Whether some passage of h, half as long again as the item, holds enough of it in order."""
    n = len(item)
    for at in range(max(1, len(h) - n // 2)):
        region = h[at : at + n + n // 2]
        share = decontam.lcs(item, region) / n
        if share >= decontam.VERBATIM or (share >= decontam.PARAPHRASE and (not len(answer) or np.isin(answer, region).mean() >= decontam.ANSWER)):
            return True
    return False


def test_latent_search_finds_paraphrases_as_brute_force_does(spark, monkeypatch):
    rng = random.Random(22)
    common = [f"c{k}" for k in range(60)]
    word = lambda: rng.choice(common) if rng.random() < 0.4 else f"w{rng.randrange(4000)}"
    items = [(k, " ".join(word() for _ in range(rng.randrange(10, 70))) + ". " + " ".join(word() for _ in range(4)) + ".") for k in range(40)]
    rows = []
    for d in range(160):
        text = [word() for _ in range(rng.randrange(10, 200))]
        if d < 120:
            said = [w if rng.random() > (0.1, 0.2, 0.3)[d % 3] else word() for w in items[d % 40][1].split()]
            x = rng.randrange(len(said) - 1)
            said[x], said[x + 1] = said[x + 1], said[x]
            at = rng.randrange(len(text))
            text[at:at] = said
        rows.append((d, " ".join(text)))
    rows.append((900, " ".join(word() for _ in range(3000)) + " " + items[7][1] + " " + " ".join(word() for _ in range(40))))
    df, bench = docs(spark, rows), spark.createDataFrame(items, "item_id long, text string")
    own = K.words(pa.array([t for _, t in items])), K.words(pa.array([decontam._last_sentence(t) for _, t in items]))
    p = K.words(pa.array([t for _, t in rows]))
    want = set()
    for d, _ in rows:
        i = rows.index((d, _))
        for k in range(40):
            h = [x.hash[x.first[k] : x.first[k + 1]] for x in own]
            if (d < 120 and d % 40 == k or d == 900 and k == 7 or d >= 150) and brute_leak(*h, p.hash[p.first[i] : p.first[i + 1]]):
                want.add((d, k))
    found = {(r["doc_id"], r["item_id"]) for r in decontam.leaks(df, bench).collect()}
    assert len(want) > 80 and len(found & want) >= 0.9 * len(want) and (900, 7) in found
    assert all(k == (d % 40 if d < 120 else 7) and (d < 120 or d == 900) for d, k in found)
    # very long texts are read in segments
    search = next(decontam.searches(df, bench))
    whole = {x[:2] for x in decontam.find(p, search)}
    monkeypatch.setattr(decontam, "SEGMENT", 256)
    parts = {x[:2] for x in decontam.find(p, search)}
    assert parts == whole and len(decontam._segments(p, 64)[0]) > len(rows) + 5
    # blocks of items change nothing but the sums' rounding, and candidates come from the latent space alone
    monkeypatch.setattr(decontam, "ITEMS", 7)
    words = decontam.latent_words(df, decontam._items(bench))
    monkeypatch.setattr(decontam, "latent_words", lambda *a, **k: words)
    many = spark.createDataFrame([*items, *[(k, items[0][1]) for k in range(100, 130)]], "item_id long, text string")
    parts = {(r["doc_id"], r["item_id"]) for r in decontam.leaks(df, many).collect()}
    monkeypatch.setattr(decontam, "ITEMS", 1000)
    assert parts == {(r["doc_id"], r["item_id"]) for r in decontam.leaks(df, many).collect()}
    assert {d for d, k in parts if k == 0} == {d for d, k in parts if k == 129}
    monkeypatch.setattr(decontam, "latent_words", lambda *a, **k: words.value * 0)
    assert decontam.leaks(df, bench).count() == 0


def test_lcs_of_bits_equals_the_table():
    rng = random.Random(3)
    for _ in range(200):
        a, b = ([rng.randrange(4) for _ in range(rng.randrange(0, 20))] for _ in range(2))
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
        assert decontam.lcs(np.array(a), np.array(b)) == table[-1][-1]


# --- 3 token counts


def greedy(pieces, data):
    n = at = 0
    while at < len(data):
        at += max((k for k in range(1, len(data) - at + 1) if data[at : at + k] in pieces), default=1)
        n += 1
    return n


@settings(max_examples=300, deadline=None)
@given(st.sets(st.binary(min_size=1, max_size=4).map(lambda b: bytes(x % 3 for x in b)), max_size=12), st.binary(max_size=24).map(lambda b: bytes(x % 3 for x in b)), st.booleans())
def test_automaton_counts_greedy_pieces(pieces, data, singles):
    pieces = pieces | ({b"\0", b"\1", b"\2"} if singles else set())
    assert tokencount.Automaton(sorted(pieces)).count(data) == greedy(pieces, data)


def test_token_counts(spark):
    rows = [(1, "Hello there, wörld."), (2, None), (3, ""), (4, "ab" * 5000), (1, "Hello there, wörld."), (None, "x y")]
    pieces = set(tokencount.load(encoder.vocabulary("byte_bpe_50k.tiktoken")))
    got = tokencount.count_tokens(docs(spark, rows)).collect()
    for d, t in rows:
        p, _ = K.units(K.Texts(pa.array([t], pa.string())))
        want = sum(greedy(pieces, p.texts.bytes_at(p.start[i], p.end[i])) for i in range(len(p))) if t != rows[3][1] else None
        mine = [r for r in got if r["doc_id"] == d]
        assert mine and all(want is None or r["n_tokens"] == want for r in mine)
    assert len(got) == len(rows)
    assert tokencount.count_tokens(docs(spark, []), None).collect() == []


# --- 4 Jaccard join


def brute_classes(texts):
    sets = {}
    for d, t in texts.items():
        w = WORDS.findall((t or "").lower())
        sets[d] = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
    label = {d: d for d in texts}
    for a in texts:
        for b in texts:
            if a < b and sets[a] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) and label[a] != label[b]:
                lo, hi = sorted((label[a], label[b]))
                label = {d: lo if x == hi else x for d, x in label.items()}
    return label


def test_jaccard_join_equals_brute_force(spark):
    rng = random.Random(4)
    texts, n = {}, 0
    shared = prose(rng, 40, 10_000)
    for g in range(25):
        base = prose(rng, rng.randrange(6, 150), 10_000).split()
        for _ in range(rng.choice([1, 1, 2, 3, 8])):
            w = list(base)
            for _ in range(rng.choice([0, 0, 1, 2])):
                w[rng.randrange(len(w))] = f"edit{rng.randrange(10**6)}"
            texts[n] = " ".join(w) + (" " + shared if g % 5 == 0 else "")
            n += 1
    texts |= {900: None, 901: "", 902: "?!", 903: "?!", 904: "one two", 905: "One, two!", 906: "x " * 30_000}
    rows = [*texts.items(), (0, texts[0]), (None, "one two")]
    got = {r["doc_id"]: r for r in jaccard.join(docs(spark, rows)).collect()}
    assert {d: r["class_id"] for d, r in got.items()} == brute_classes(texts)
    assert got[0]["n_copies"] >= 2 and got[900]["n_links"] == 0 and got[904]["n_copies"] == 2
    kept = jaccard.stage(spark, docs(spark, rows), "")
    assert kept.columns == docs(spark, []).columns
    assert sorted(r["doc_id"] for r in kept.where("doc_id is not null").collect()) == sorted(set(brute_classes(texts).values()))
    assert kept.where("doc_id is null").count() == 1
    assert jaccard.join(docs(spark, [])).collect() == []


def test_crowded_prefixes_are_lengthened_without_losing_links(spark, monkeypatch):
    """Pages that are mostly one boilerplate, and hot keys and hubs met by broadcast."""
    rng = random.Random(24)
    plate, texts = prose(rng, 60, 10_000), {}
    for g in range(60):
        own = prose(rng, 24, 10_000).split()
        for k in range(1 + 4 * (g % 6 == 0)):
            w = plate.split() + own
            if k:
                w[rng.randrange(60, 84)] = f"edit{g}x{k}"
            texts[len(texts)] = " ".join(w)
    want = brute_classes(texts)
    df = docs(spark, texts.items())
    lengthened = []
    monkeypatch.setattr(jaccard, "more_trees", lambda *a: lengthened.append(1) or 18)
    for crowd, hot, few in ((1 << 24, 1000, 100_000), (40, 3, 1)):
        monkeypatch.setattr(jaccard, "CROWD", crowd)
        monkeypatch.setattr(jaccard, "HOT_ROWS", hot)
        monkeypatch.setattr(jaccard, "HOT_SHARE", 10**6)
        monkeypatch.setattr(jaccard, "FEW_EDGES", few)
        got = jaccard.join(df).collect()
        assert {r["doc_id"]: r["class_id"] for r in got} == want
        assert bool(lengthened) == (crowd == 40)
    assert len(set(want.values())) > 30


def test_neighbours_over_the_edges_of_partitions(spark):
    rows = [(k, 0, c) for k in range(40) for c in (2 * k, 2 * k + 1)] + [(99, r, 1000 + r) for r in range(300)]
    got = {tuple(r) for r in jaccard._neighbours(spark.createDataFrame(rows, "key long, rest long, cid long").repartition(7)).collect()}
    assert got == {(2 * k, 2 * k + 1) for k in range(40)} | {(1000 + r, 1001 + r) for r in range(299)}


def test_different_texts_of_one_id_are_searched_and_kept_each(spark):
    rng = random.Random(25)
    a, b, c = (prose(rng, 60, 10_000) for _ in range(3))
    rows = [(1, a), (1, b), (1, b), (2, b + " more"), (3, a + " else"), (4, c), (5, None), (5, None), (6, c), (None, c)]
    got = {r["doc_id"]: r for r in jaccard.join(docs(spark, rows)).collect()}
    assert {d: r["class_id"] for d, r in got.items()} == {1: 1, 2: 1, 3: 1, 4: 4, 5: 5, 6: 4}
    assert got[1]["n_links"] == 2 and got[2]["n_links"] == 1
    kept = jaccard.stage(spark, docs(spark, rows), "")
    assert sorted(((r["doc_id"], r["text"]) for r in kept.collect()), key=repr) == sorted([(1, a), (1, b), (4, c), (5, None), (None, c)], key=repr)


def test_a_large_group_of_near_copies_is_one_class(spark):
    rng = random.Random(5)
    base = prose(rng, 120, 10_000).split()
    texts = {}
    for d in range(300):
        w = list(base)
        w[rng.randrange(len(w))] = f"edit{d}"
        texts[d] = " ".join(w)
    assert {r["class_id"] for r in jaccard.join(docs(spark, texts.items())).collect()} == {0}


def test_n_links_counts_every_similar_text(spark):
    rng = random.Random(12)
    texts = {}
    for size, words, edits in ((400, 100, 1), (40, 90, 2), (5, 60, 1), (2, 60, 1), (1, 60, 0)):
        base = prose(rng, words, 10_000).split()
        for _ in range(size):
            w = list(base)
            for _ in range(edits):
                w[rng.randrange(words)] = f"edit{rng.randrange(10**9)}"
            texts[len(texts)] = " ".join(w)
    got = {r["doc_id"]: r["n_links"] for r in jaccard.join(docs(spark, [*texts.items(), (9000, texts[0])])).collect()}
    sets = {d: {tuple(w[i : i + 5]) for i in range(len(w) - 4)} for d, t in texts.items() for w in [WORDS.findall(t)]}
    want = {a: sum(a != b and len(x & y) >= 0.8 * len(x | y) for b, y in sets.items()) for a, x in sets.items()}
    assert got == want | {9000: want[0]} and max(want.values()) > 300


def test_overlaps_are_the_sizes_of_intersections():
    rng = np.random.default_rng(13)
    for most in (30, 3000):
        x, y = ([np.unique(rng.integers(0, most, rng.integers(1, 60)).astype(np.uint64)) for _ in range(n)] for n in (150, 70))
        assert (jaccard.overlaps(x, y) == [[len(np.intersect1d(a, b)) for b in y] for a in x]).all()


def test_depth_reaches_the_recall():
    d = jaccard.depth()
    assert 1 - (1 - 0.8**d) ** jaccard.TREES >= jaccard.RECALL > 1 - (1 - 0.8 ** (d + 1)) ** jaccard.TREES


# --- 5 fingerprints


def test_fingerprints_are_homomorphic(spark):
    rows = [(1, "a b c d e\nf g", "f g\na b c d e"), (2, "p\nq", "q\np"), (3, "", ""), (4, "x\nx", "x")]
    df = spark.createDataFrame(rows, "doc_id long, a string, b string")
    va, vb = (F.expr(fingerprint.vector(c)).alias("v" + c) for c in "ab")
    both = df.select("doc_id", "a", "b", va, vb).select("*", F.expr(fingerprint.vector("concat(a, '\\n', b)")).alias("whole"))
    out = both.select("doc_id", F.expr("va = vb").alias("same"), F.expr(f"whole = {fingerprint.add('va', 'vb')}").alias("sum"), F.expr(f"vb = {fingerprint.subtract('whole', 'va')}").alias("rest"), F.expr(fingerprint.likeness("va", "vb")).alias("near")).orderBy("doc_id").collect()
    assert [r["same"] for r in out] == [True, True, True, False]
    assert all(r["sum"] and r["rest"] for r in out) and out[0]["near"] == out[2]["near"] == 1


def test_ranges_of_many_cuts(spark):
    cuts = sorted(random.Random(23).sample(range(-(10**6), 10**6), 5000))
    own, is_cut = fingerprint._range_of("id", cuts)
    for r in spark.createDataFrame([(c + d,) for c in cuts[::97] for d in (-1, 0, 1)] + [(-(10**7),), (10**7,)], "id long").select("id", own.alias("n"), is_cut.alias("c")).collect():
        assert r["n"] == int(np.searchsorted(cuts, r["id"])) and r["c"] == (r["id"] in cuts)


def test_very_long_texts_keep_apart(spark):
    """More runs than twenty bits count."""
    n = (1 << 20) + 12_000
    df = spark.range(1).select(F.expr(f"repeat('alpha\\n', {n})").alias("a"), F.expr(f"repeat('omega\\n', {n})").alias("b"))
    r = df.select(*[F.expr(fingerprint.vector(c)).alias(c) for c in "ab"]).select(F.expr(fingerprint.likeness("a", "b")).alias("ab"), F.expr("a.n").alias("n")).first()
    assert r["ab"] < 0.5 and r["n"] == n


def test_next_rows_and_edits(spark, tmp_path):
    rng = random.Random(6)
    rows = [(d * 3, prose(rng, rng.randrange(0, 60))) for d in range(300)] + [(1000, None), (1001, ""), (1002, "é" * 9), (None, "last of all"), (6, "again"), (6, "again")]
    old = fingerprint.RANGE_ROWS
    fingerprint.RANGE_ROWS = 7
    try:
        docs(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
        got = fingerprint.op5_fingerprint(spark, str(tmp_path)).collect()
        pairs = fingerprint.with_next(docs(spark, rows)).select("doc_id", "text", "next_text").collect()
        one = fingerprint.with_next(docs(spark, [(5, "only")])).select("next_text").collect()
        assert fingerprint.with_next(docs(spark, [])).count() == 0
    finally:
        fingerprint.RANGE_ROWS = old
    assert [r["next_text"] for r in one] == ["only"] and len(got) == len(pairs) == len(rows)
    ids = sorted((r[0] for r in rows if r[0] is not None), reverse=True) + [None]
    text = {d: t or "" for d, t in rows}
    following = {d: text[ids[(i + 1) % len(ids)]] for i, d in enumerate(ids)}
    for r in pairs:
        if r["doc_id"] != 6:
            assert r["next_text"] == following[r["doc_id"]]
    for r in got:
        if r["doc_id"] != 6 and ids.count(r["doc_id"]) == 1:
            t, nxt = text[r["doc_id"]], following[r["doc_id"]]
            k = len(t) // 3
            assert r["n_chars"] == len(t) and r["edited_sha256"] == hashlib.sha256((t[: len(t) - k] + nxt[:k]).encode()).hexdigest()
            assert 0 <= r["near_next"] <= 1 and 0 <= r["near_edited"] <= 1
    long = [r for r in got if r["n_chars"] > 120]
    assert np.mean([r["near_edited"] for r in long]) > 0.5 > 0.3 > np.mean([r["near_next"] for r in long])


# --- 6 language


def test_viterbi_equals_brute_force():
    rng = np.random.default_rng(7)
    for _ in range(40):
        n, labels, switch = int(rng.integers(1, 6)), 3, 1.0
        s = rng.normal(size=(n, labels)).astype(np.float32) * 2
        paths = np.stack(np.meshgrid(*[range(labels)] * n, indexing="ij"), -1).reshape(-1, n)
        value = [sum(s[i, p[i]] for i in range(n)) - switch * sum(p[i] != p[i - 1] for i in range(1, n)) for p in paths]
        got = langid.viterbi(np.concatenate([s, s[:1]]), np.array([0, n, n, n + 1]), switch)
        assert abs(value[int(np.flatnonzero((paths == got[:n]).all(1))[0])] - max(value)) < 1e-4 and got[n] == s[0].argmax()


def test_languages_and_mixed_spans(spark):
    rng = random.Random(8)
    syllables = {"aa": "ka ti no re", "bb": "zu mo wib rax", "gr": "αλ βε γω δι", "ru": "жа ми ко ту"}
    word = lambda lang: "".join(rng.choice(syllables[lang].split()) for _ in range(3))
    said = lambda lang, n: " ".join(word(lang) for _ in range(n))
    rows = [(k, said(lang, 30), lang) for k, lang in enumerate(list(syllables) * 25)]
    model = langid.fit(docs(spark, rows + [(998, "junk", None), (None, None, "aa")]))
    assert model.languages == sorted(syllables)
    mixed = said("aa", 12) + ", " + said("ru", 20)
    ask = [(200, said("bb", 9)), (201, mixed), (202, None), (203, ""), (204, "123 !!"), (205, said("gr", 3000)), (206, "\U0001d400\U00020000"), (207, "\u00d7 \u2014"), (200, said("bb", 4)), (None, said("ru", 5))]
    got = langid.predict(docs(spark, ask), model).collect()
    by = {r["doc_id"]: r for r in got}
    assert len(got) == len(ask) and all(r["lang_pred"] == "bb" for r in got if r["doc_id"] == 200)
    assert [by[k]["lang_pred"] for k in (201, 202, 203, 204, 205, None)] == ["ru", "und", "und", "und", "gr", "ru"]
    assert [(s["lang"], mixed[s["start"] : s["end"]]) for s in by[201]["spans"]] == [("aa", mixed.split(",")[0]), ("ru", mixed.split(", ")[1])]
    assert by[206]["lang_pred"] == "aa" and by[206]["score"] == 0.25 and by[207]["lang_pred"] == "und"
    assert by[202]["score"] == 0 and 0.5 < by[201]["score"] < 1
    none = langid.predict(docs(spark, ask), langid.fit(docs(spark, []))).collect()
    assert {r["lang_pred"] for r in none} == {"und"}
    assert langid.predict(docs(spark, []), model).collect() == []


def test_more_languages_than_a_byte_counts(spark):
    rng = random.Random(18)
    stems = [f"{a}{b}" for a in "bcdfghjklmnpqrst" for b in "bcdfghjklmnpqrstvw"][:270]
    said = lambda s, n: " ".join(s + rng.choice("aeiou") + s + rng.choice("aeiou") for _ in range(n))
    rows = [(k, said(s, 20), f"lang{k:03}") for k, s in enumerate(stems) for _ in range(1 + (k == 5))]
    model = langid.fit(docs(spark, rows))
    assert len(model.languages) == 270
    got = {r["doc_id"]: r["lang_pred"] for r in langid.predict(docs(spark, [(k, said(s, 8)) for k, s in enumerate(stems)]), model).collect()}
    assert np.mean([got[k] == f"lang{k:03}" for k in got]) > 0.98


# --- 7 packing


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 16), max_size=120), st.integers(1, 6))
def test_best_fit_takes_the_fullest_open_bin(lengths, most):
    fit, free, made = packing.BestFit(16, most), {}, 0
    for n in lengths:
        b, at = fit.add(n)
        room = sorted((f, k) for k, f in free.items() if f >= n)
        if room:
            assert free[b] == room[0][0]
        else:
            if len(free) >= most:
                del free[next(k for k, f in free.items() if f == min(free.values()) and k not in {x for s in fit.bins.values() for x in s})]
            assert b == made
            free[b], made = 16, made + 1
        assert at == 16 - free[b]
        free[b] -= n
        if not free[b]:
            del free[b]


def test_a_share_is_packed_online_within_the_bound(spark):
    """Arrival is in order of a hash, not of length; the bound closes bins; the bins are those of a plain best fit."""
    rng = random.Random(19)
    df = docs(spark, [(d, prose(rng, rng.randrange(1, 60))) for d in range(600)])
    made = packing.pack(df, size=64, open_bins=5).where("length < 64")
    rows = made.withColumn("o", F.xxhash64("doc_id", "piece", "ids_crc32")).orderBy("o").collect()
    free, closed, bins = {}, 0, {}
    for r in rows:
        fits = sorted((f, b) for b, f in free.items() if f >= r["length"])
        b = bins.setdefault(r["sequence_id"], len(bins))
        if fits:
            assert free[b] == fits[0][0]
        else:
            assert b not in free
            if len(free) == 5:  # the fullest closes; of equally full ones the last used
                least = min(free.values())
                gone = next(x for x in reversed(free) if free[x] == least)
                del free[gone]
                closed += 1
            free[b] = 64
        assert r["offset"] == 64 - free[b]
        left = free.pop(b) - r["length"]
        if left:
            free[b] = left
    assert closed > 20


def test_packing_places_every_token(spark):
    rng = random.Random(9)
    rows = [(d, prose(rng, rng.randrange(0, 200))) for d in range(60)] + [(100, None), (101, ""), (102, "long " * 3000), (5, "again"), (5, "again"), (None, "no id")]
    made = packing.pack(docs(spark, rows), size=64, open_bins=4).collect()
    tk = encoder.tokenizer(encoder.vocabulary("byte_bpe_50k.json"))
    for d, t in rows:
        if d == 5:
            continue
        ids = np.array([*tk.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        mine = sorted((r for r in made if r["doc_id"] == d), key=lambda r: r["piece"])
        assert [r["piece"] for r in mine] == list(range(len(mine))) and sum(r["length"] for r in mine) == len(ids)
        assert all(r["length"] == 64 for r in mine[1:])
        for r in mine:
            assert r["ids_crc32"] == zlib.crc32(ids[r["start"] : r["start"] + r["length"]].tobytes())
    by = collections.defaultdict(list)
    for r in made:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    for spans in by.values():
        at = 0
        for o, n in sorted(spans):
            assert o == at
            at += n
        assert at <= 64
    assert len(by) <= 1.25 * sum(r["length"] for r in made) / 64 + 2
    assert packing.pack(docs(spark, [])).collect() == []


# --- 8 secrets


def test_secret_scan(spark):
    rng = random.Random(10)
    hexes = lambda n: "".join(rng.choice("0123456789abcdef") for _ in range(n))
    keys = lambda n: "".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789") for _ in range(n))
    rows = []
    for d in range(400):
        extra = [f'token = "{hexes(40)}"', f"password={hexes(18)}", f"AKIA{keys(16)}", f"call 555-{rng.randrange(10**7):07d}-12", f"2024-01-{d % 28 + 1:02d}T10:00:00.000", "x"][d % 6]
        rows.append((d, prose(rng, 30) + f" {extra} " + prose(rng, 10)))
    bare = hexes(30)
    odd = [(900, None), (901, ""), (902, 'éé SECRET : "abcdefgh" passwd=short API_KEY=AKIA0123456789ABCD'), (903, "g" * 50_000 + hexes(32)), (904, f"the key is {bare} ok"), (905, "AKIA" + "A" * 11), (902, "token:12345678"), (906, "ſecret=abcdefgh1")]
    net = secrets.fit(docs(spark, rows))
    got = secrets.scan(docs(spark, rows + odd), net).collect()
    assert len(got) == len(rows) + len(odd)
    texts = collections.defaultdict(list)
    for d, t in rows + odd:
        texts[d].append([(k, s, e) for k, s, e in brute_secrets(t or "")])
    for r in got:
        base = [(s["kind"], s["start"], s["end"]) for s in r["spans"] if s["kind"] != "model"]
        assert base in texts[r["doc_id"]]
    added = {r["doc_id"]: [s for s in r["spans"] if s["kind"] == "model"] for r in got}
    assert sum(map(len, added.values())) < 12
    clean = secrets.redact(docs(spark, rows + odd), net)
    for r in clean.collect():
        assert not brute_secrets(r["text"] or "") and (r["text"] is None or r["n_chars"] == len(r["text"]))
    assert clean.columns == docs(spark, []).columns
    assert secrets.scan(docs(spark, []), secrets.fit(docs(spark, []))).collect() == []


def test_the_network_reads_whole_candidates():
    rng = np.random.default_rng(14)
    net = secrets.Network.new(rng)
    # a filter that answers to "zqzqz" alone, wherever it is
    net.conv[:], net.bias[:], net.out[:] = 0, -4.5, 0
    for k, c in enumerate("zqzqz"):
        net.conv[k * secrets.CHANNELS + secrets._SYMBOL[ord(c)], 0] = 1
    net.out[0], net.scale, net.shift, net.threshold = 20, 1.0, -5.0, 0.5
    texts = ["see " + "dir/" * 50 + "zqzqz9 end", "see " + "dir/" * 50 + "plain9 end", "a " + "x" * 70 + "1 then zqzqz", "noDigitsHere-zqzqz", None, "é " + "yo" * 200 + "zqzqz"]
    got = {d: [t[:3] for t in s] for d, s in secrets.find(K.Texts(pa.array([t or "" for t in texts])), net)}
    assert got == {0: [("model", 4, 210)], 2: [("model", 2, 73)], 3: [("model", 0, 18)], 5: [("model", 2, 407)]}
    # the looked-up scores are the network's
    net = secrets.Network.new(rng)
    t = K.Texts(pa.array(["p 2024-01-03T10:00 " + "Ab9/" * 12 + " é ok, more text behind it to fill the window"]))
    s, e, d = secrets._candidates(t)
    code = secrets._codes(t, s, s, e, d)
    assert np.allclose(net.logits(code), net.forward(net._columns(secrets.picture(code)))[0], atol=1e-4)


def test_secrets_beyond_the_base_rules_are_found(spark):
    """Values that no rule knows, planted in prose; of the training windows nobody says that they are secrets."""
    rng = random.Random(20)
    pick = lambda chars, n: "".join(rng.choice(chars) for _ in range(n))
    hexes, mixed = "0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    plain = [lambda: f"2024-0{rng.randrange(1, 10)}-1{rng.randrange(10)}T10:00:00.000", lambda: f"555-{rng.randrange(10**7):07d}-12", lambda: "/".join(pick("abcdeo", 5) for _ in range(4)) + ".html", lambda: pick("aeioulrstn", 14), lambda: f"{pick('aeilnrst', 8)}.{pick('aeilnrst', 6)}.com", lambda: "-".join(pick("0123456789", 4) for _ in range(4))]
    base = [lambda: f'token = "{pick(hexes, 40)}"', lambda: f"api_key: {pick(mixed, 24)}", lambda: f"password={pick(mixed, 16)}", lambda: f"AKIA{pick(mixed[:26], 16)}", lambda: pick(hexes, 36)]
    beyond = [lambda: pick(hexes, 28), lambda: pick(mixed, 30), lambda: pick(mixed, 22)]
    rows, planted, harmless = [], {}, {}
    for d in range(3000):
        kind = (base, plain, plain, beyond)[d % 4 if d % 80 == 3 or d % 4 != 3 else 1]
        value = rng.choice(kind)()
        text = prose(rng, 20) + " "
        if kind is beyond:
            planted[d] = (len(text), len(text) + len(value))
        if kind is plain:
            harmless[d] = value
        rows.append((d, text + value + " " + prose(rng, 10)))
    df = docs(spark, rows)
    got = {r["doc_id"]: r["spans"] for r in secrets.scan(df, secrets.fit(df)).collect()}
    hit = [any(s["kind"] == "model" and (s["start"], s["end"]) == planted[d] for s in got[d]) for d in planted]
    wrong = [d for d in harmless if any(s["kind"] == "model" for s in got[d])]
    assert len(planted) > 30 and np.mean(hit) >= 0.9
    assert len(wrong) <= 0.02 * len(harmless), [harmless[d] for d in wrong[:9]]


def test_the_network_learns_from_all_windows(spark, monkeypatch):
    """More windows than any sample had: each is kept once, several shares learn from all, and what they find is calibrated to all."""
    rng = random.Random(21)
    pick = lambda chars, n: "".join(rng.choice(chars) for _ in range(n))
    plain = [lambda: pick("aeioulrstn", 14), lambda: f"{pick('aeilnrst', 8)}.{pick('aeilnrst', 6)}.com", lambda: f"555-{rng.randrange(10**7):07d}-12"]
    texts = [f"{prose(rng, 8)} {pick('0123456789abcdef', 36) if d % 16 == 0 else rng.choice(plain)()} {prose(rng, 8)}" for d in range(9000)]
    df = docs(spark, list(enumerate(texts + texts[:50])))
    t = K.Texts(pa.array(texts))
    start, end, doc = secrets._candidates(t)
    place, which = secrets._slides(t, start, end, doc)
    code = secrets._codes(t, place, start[which], end[which], doc[which])
    secret = [bool(brute_secrets(texts[doc[w]])) for w in which]
    want = collections.Counter({(int(y), c.astype("<i2").tobytes()) for c, y in zip(code, secret)})
    packed = [r.asDict() for r in secrets.windows(df).collect()]
    got = collections.Counter((r["label"], c.tobytes()) for r in packed for c in secrets._unpacked([r]))
    assert got == want and len(want) > 8000
    monkeypatch.setattr(secrets, "SHARE", 1 << 10)
    net = secrets.fit(df)
    score = net.scores(code)
    assert abs(score.sum() - sum(secret)) < 0.1 * sum(secret)
    found = np.array(score >= net.threshold)
    assert found[np.array(secret)].mean() >= 0.95 and found[~np.array(secret)].mean() <= 0.01
    monkeypatch.setattr(secrets, "FEW", 1 << 20)  # a rare label in all shares
    other = secrets.fit(df)
    assert (other.scores(code) >= other.threshold)[np.array(secret)].mean() >= 0.95


def test_a_text_of_many_candidates_is_scanned_in_proportion():
    net = secrets.Network.new(np.random.default_rng(3))
    net.threshold = 2.0
    text = " ".join(f"é value{k:08}xyz token=abcdefgh{k}" for k in range(40_000))
    import time

    t = time.time()
    (_, spans), *_ = secrets.find(K.Texts(pa.array([text])), net)
    assert len(spans) == 40_000 and time.time() - t < 20
    assert spans[-1][1:3] == (text.rindex("token"), len(text))


def brute_secrets(text):
    kinds = [("assign", r"""(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']? *[:=] *["']?([A-Za-z0-9+/_.=-]+)""", 1, 8), ("access", "AKIA[A-Z0-9]+", 0, 16), ("hex", "[0-9a-f]+", 0, 32)]
    found = [(k, *m.span()) for k, p, g, n in kinds for m in re.finditer(p, text) if len(m[g]) >= n]
    return sorted(found, key=lambda s: (s[1], [k for k, *_ in kinds].index(s[0])))


# --- 9 token ids


def test_id_store_round_trip(spark, tmp_path, monkeypatch):
    rng = random.Random(11)
    rows = [(d, prose(rng, rng.randrange(0, 80))) for d in range(90, 0, -1)] + [(200, None), (201, ""), (202, "Long. " * 4000), (7, "again"), (7, "again"), (None, "no id")]
    path = encoder.vocabulary("word_bpe_49k.json")
    tk = encoder.tokenizer(path)
    df, out = docs(spark, rows), f"{tmp_path}/store"
    dictionary = idstore.train(df, path)
    monkeypatch.setattr(idstore, "FILE_IDS", 600)  # several files of a part
    idstore.write(df, out, path, dictionary)
    files = spark.read.parquet(f"{out}/files").orderBy("part", "seq").collect()
    assert len(files) > 12 and all(a["high"] <= b["low"] for a, b in zip(files, files[1:]))
    assert len({r["part"] for r in files}) < len(files)
    got = idstore.read(spark, out).orderBy("start").collect()
    ids = lambda t: [*tk.encode(t or "", add_special_tokens=False).ids, 2]
    assert [r["doc_id"] for r in got] == sorted((d for d, _ in rows), key=lambda d: -1 if d is None else d)
    at = 0
    for r in got:
        assert r["start"] == at
        at += r["n_tokens"]
        assert (r["n_tokens"], r["ids_crc32"]) in {(len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for d, t in rows if d == r["doc_id"] for x in [ids(t)]}
    assert idstore.lookup(spark, out, 201) == [[2]] and len(idstore.lookup(spark, out, 7)) == 3
    assert idstore.lookup(spark, out, None) == [ids("no id")] and idstore.lookup(spark, out, 555) == []
    assert idstore.lookup(spark, out, 202) == [ids("Long. " * 4000)]
    idstore.write(df.limit(0), f"{tmp_path}/none", path, b"")
    assert idstore.read(spark, f"{tmp_path}/none").collect() == []


# --- 10 toxicity


def brute_segments(score):
    """All maximal scoring subsequences by their recursive definition."""
    best, where = 0, None
    for i in range(len(score)):
        total = 0
        for j in range(i, len(score)):
            total += score[j]
            if total > best + 1e-9 or (where and abs(total - best) < 1e-9 and j - i < where[1] - where[0]):
                best, where = total, (i, j)
    if not where:
        return []
    i, j = where
    return brute_segments(score[:i]) + [(i, j)] + [(a + j + 1, b + j + 1) for a, b in brute_segments(score[j + 1 :])]


def test_segments_are_the_maximal_ones():
    rng = random.Random(12)
    for _ in range(300):
        n = rng.randrange(0, 30)
        weight = [rng.choice([0, 0, 0, 1.3, 2.1, 3.7]) + rng.random() / 100 for _ in range(n)]
        weight = [w if w > 0.5 else 0 for w in weight]
        penalty = 0.7310001
        got = toxicity.segments(np.flatnonzero(weight), np.array([w for w in weight if w]), penalty)
        assert [(a, b) for a, b, _ in got] == brute_segments([w if w else -penalty for w in weight])


def test_toxicity_learns_and_scores(spark):
    rng = random.Random(13)
    bad = ["vile", "scumbag", "wretch"]
    rows, labels = [], []
    for d in range(500):
        toxic = d % 5 == 0
        w = prose(rng, rng.randrange(20, 100)).split()
        for _ in range(3 * toxic):
            w.insert(rng.randrange(len(w)), rng.choice(bad) + rng.choice(["", "s", "ly"]))
        rows.append((d, " ".join(w)))
        if d < 400:
            labels.append((d, 1, int(toxic), "x"))
    labels += [(3, 0, None, "x"), (9999, 1, 1, "x"), (None, 1, 1, "x"), (5, 1, 1, "again")]
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int, text string")
    model = toxicity.fit(docs(spark, rows), marks)
    odd = [(600, None), (601, ""), (602, "Wretch! you VILE thing"), (603, "fine words " * 9000), (None, "vile wretch scumbag")]
    got = toxicity.score(docs(spark, rows + odd + rows[:1]), model).collect()
    assert len(got) == len(rows) + len(odd) + 1
    told = {r["doc_id"]: r for r in got}
    right = [(told[d]["score"] >= 0.5) == (d % 5 == 0) for d in range(400, 500)]
    assert np.mean(right) > 0.95
    assert told[602]["score"] > 0.5 > told[600]["score"] == told[601]["score"] and told[603]["score"] < 0.5 < told[None]["score"]
    spans = [odd[2][1][s["start"] : s["end"]] for s in told[602]["passages"]]
    assert spans and spans[0].startswith("Wretch")
    none = toxicity.fit(docs(spark, rows), marks.limit(0))
    assert max(r["score"] for r in toxicity.score(docs(spark, odd), none).collect()) < 1e-6
    assert toxicity.score(docs(spark, []), model).collect() == []


def test_confirmation_by_numbers_of_words_equals_that_by_hashes(monkeypatch):
    import pyarrow as pa

    from orbweave.llm import decontam as D
    from orbweave.llm import kernels as K

    rng = np.random.default_rng(12)
    word = lambda n: " ".join(f"w{k}" for k in rng.integers(0, 90, n))
    items = [(k, word(20)) for k in range(12)]
    texts = pa.array([f"{word(30)} {items[k % 12][1]} {word(30)}" if k % 2 else word(90) for k in range(40)])
    source = rng.normal(size=(D.TERMS, D.RANK)).astype(np.float16)
    told = []
    for most in (D.NUMBERED, 0):
        monkeypatch.setattr(D, "NUMBERED", most)
        s = D.index(items, source)
        told.append(list(D.find(K.words(texts), s)))
        assert (s.holds is None) == (most == 0)
    assert told[0] == told[1] and len({(d, k) for d, k, *_ in told[0]}) >= 20


def test_the_latent_space_is_fitted_on_passages_of_all_documents(spark, monkeypatch):
    from pyspark.sql import functions as F

    rng = random.Random(9)
    order = [r["id"] for r in spark.range(2400).orderBy(F.xxhash64("id"), "id").collect()]
    together = [f"rare{k}" for k in range(24)]
    # the last documents by hash of id are the only ones with these words, and have them together
    rows = [(d, prose(rng, 40) + (" " + " ".join(rng.sample(together, 24)) if n >= 2000 else "")) for n, d in enumerate(order)]
    rows += [(None, "alone"), (7, None), (8, "")]
    items = spark.createDataFrame([(1, "alone with rare0 and some more words")], "key long, text string")
    words = decontam._single(decontam.latent_words(docs(spark, rows), items))
    of = decontam._unit(words[decontam._terms(K.words(pa.array([" ".join(together)])).hash)])
    assert np.median(of @ of.T) > 0.8  # a word may share its hash with another
    # sums are of all passages, once each, and don't depend on how the texts are dealt
    df = docs(spark, rows).select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    (sums, count, n), again = decontam.passage_sums(df), decontam.passage_sums(df.repartition(7))
    terms = [set(decontam._terms(K.words(pa.array([t or ""])).hash[k : k + decontam.PASSAGE]).tolist()) for _, t in rows for k in range(0, len((t or "").split()), decontam.PASSAGE)]
    assert n == again[2] == len(terms) and (sums == again[0]).all() and (count == again[1]).all()
    assert count.sum() == sum(map(len, terms)) and all(count[t] >= 400 for t in decontam._terms(K.words(pa.array([" ".join(together)])).hash))
    monkeypatch.setattr(decontam, "WEIGHT", 1 << 26)  # sums that 16 bits don't hold
    assert np.abs(decontam.passage_sums(df)[0]).max() > 1 << 16


def test_the_driver_gets_words_vectors_but_no_sums(spark, monkeypatch):
    rng = random.Random(8)
    df = docs(spark, [(d, " ".join(f"w{rng.randrange(700)}" for _ in range(80))) for d in range(300)])
    items = spark.createDataFrame([(1, "w1 w2 w3 w4 w5 w6")], "key long, text string")
    sums, count, n = decontam.passage_sums(df.select("doc_id", "text").unionByName(items.withColumnRenamed("key", "doc_id")))
    idf = (np.log((n + 1) / (count + 1)) + 0.05).astype(np.float32)
    sums = np.array(sums) * (idf[:, None] / decontam.WEIGHT)
    want = decontam.subspace(sums[:, : decontam.RANGE].T, sums[:, decontam.RANGE :].T, decontam.RANK) * idf[:, None]
    told = []

    def counted(get):
        def run(self):
            for r in get(self):
                told.append(sum(len(x) for x in r if isinstance(x, bytes | bytearray)))
                yield r

        return run

    whole = type(df).collect
    monkeypatch.setattr(type(df), "toLocalIterator", counted(type(df).toLocalIterator))
    monkeypatch.setattr(type(df), "collect", lambda self: list(counted(whole)(self)))
    got = decontam.latent_words(df, items).value
    assert 2 * got.size <= sum(told) < 5 << 20  # the sums are 32 MB
    assert got.dtype == np.float16 and np.allclose(got, want * (256 / np.abs(want).max()), atol=0.2)
    none = decontam.latent_words(df.where("false"), items.withColumn("text", F.lit("")))
    assert none.value.shape == got.shape and not none.value.any()


def test_a_task_gives_its_freed_memory_back(spark, monkeypatch):
    from orbweave.llm import runtime

    class Frame:
        sparkSession = spark

        def mapInArrow(self, fn, schema):
            return list(fn(iter([1, 2])))

    told = []
    monkeypatch.setattr(runtime, "release", lambda: told.append(len(told)))
    assert runtime.map_arrow(Frame(), lambda batches: (told.append(-b) or b for b in batches), "x long") == [1, 2] and told == [-1, -2, 2]
    monkeypatch.undo()
    runtime.release()


def test_settling_gives_the_drivers_freed_memory_back(spark, monkeypatch):
    from orbweave.llm import runtime

    own, told = runtime.release_driver, []
    monkeypatch.setattr(runtime, "release_driver", lambda s: told.append(own(s)))
    assert runtime.settle(spark.range(9).repartition(2)).count() == 9
    assert len(told) == 1 and (not told[0] or "rim" in told[0])  # a JVM without the command says nothing
