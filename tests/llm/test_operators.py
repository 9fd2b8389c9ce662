"""The training-data operators against plain Python, on small tables with nulls, empty and
long texts, ties, repeated rows, empty tables and extra columns."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from retenta.llm import ann, automata, bpe, exact_dedup, license_scan, lm_scoring, mixing, quality, secret_scan, sharding, simhash

PATH = public_tokenizers.path("byte_bpe_50k.json")
WORD = r"[^\x20\x09-\x0D]+"
LOWER = {i: i + 32 for i in range(65, 91)}


def texts():
    rng = random.Random(5)
    words = ["the", "of", "Anea", "thion", "é", "ÉTÉ", "x" * 30, "l'eau", "12,5", "token", "漢字"]
    base = [" ".join(rng.choices(words, k=rng.randint(1, 60))) for _ in range(60)]
    near = [base[0] + " the", base[1].replace(" ", "\n", 1), "  " + base[2], base[3] + "\t"]
    return [None, "", " \t\n", *base, *base[:9], *[base[5]] * 25, *near, "word " * 3000, "a" * 5000, "à  b  <|endoftext|> c"]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, ["en", "fr", None][i % 3], [None, "b", "a", "a"][i % 4], "extra", i) for i, t in enumerate(texts())]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, digest string, target int").repartition(3)


@pytest.fixture(scope="module")
def plain(docs):
    return {r["doc_id"]: r for r in docs.collect()}


def test_bpe_equals_the_library(docs, plain):
    t = Tokenizer.from_file(PATH)
    rows = bpe.decode(bpe.encode(docs, PATH, ["doc_id"]), PATH, ["doc_id", "ids"]).collect()
    assert len(rows) == len(plain)
    for r in rows:
        ids = t.encode(plain[r["doc_id"]]["text"] or "", add_special_tokens=False).ids
        assert np.frombuffer(bytes(r["ids"]), "<u4").tolist() == ids
        assert r["decoded"] == t.decode(ids, skip_special_tokens=False)
    assert bpe.encode(docs.limit(0), PATH, ["doc_id"]).count() == 0


def test_bpe_on_odd_strings():
    t, v, rng = Tokenizer.from_file(PATH), bpe.Vocabulary(open(PATH, "rb").read()), random.Random(2)
    letters = ["a", "'s", " ", "  ", "\n", "\x1c", " ", "é", "à", "😀", "''", "1", "!", "<|endoftext|>", "́", "the", "q" * 420]
    found = ["".join(rng.choices(letters, k=rng.randint(0, 12))) for _ in range(2000)]
    for x, ids in zip(found, v.encode_batch(found)):
        assert np.frombuffer(ids, "<u4").tolist() == t.encode(x, add_special_tokens=False).ids
        assert v.decode(ids) == x


def normal(text):
    return re.sub(r"[\x20\x09-\x0D]+", " ", text or "")


def test_exact_dedup_in_batches(spark, docs, plain):
    index = exact_dedup.DigestIndex(spark, buckets=4)
    first = index.add(docs.filter("doc_id < 70")).collect()
    groups = defaultdict(list)
    for i in plain:
        groups[normal(plain[i]["text"])].append(i)
    for r in first:
        mates = [i for i in groups[normal(plain[r["doc_id"]]["text"])] if i < 70]
        assert (r["keep_id"], r["group_size"], r["kept"]) == (min(mates), len(mates), min(mates) == r["doc_id"])
        assert bytes(r["digest"]) == hashlib.sha256(normal(plain[r["doc_id"]]["text"]).encode()).digest()
    second = index.add(docs.filter("doc_id >= 70")).collect()
    for r in second:
        mates = groups[normal(plain[r["doc_id"]]["text"])]
        assert r["keep_id"] == min(mates) and r["kept"] == (min(mates) == r["doc_id"])
    assert index.read().count() == len(groups)
    assert index.add(docs.limit(0)).count() == 0


def test_exact_dedup_goes_on_in_another_session(spark, docs, plain):
    """A catalog that never saw the index: it is found in the folder, whole."""
    name = f"index_{random.Random().getrandbits(60):x}"
    first = exact_dedup.DigestIndex(spark, name)
    kept = {r["doc_id"] for r in first.add(docs.filter("doc_id < 70")).filter("kept").collect()}
    first.forget()
    assert not spark.catalog.tableExists(name)
    second = exact_dedup.DigestIndex(spark, name)
    assert second.exists() and second.read().count() == len(kept)
    again = second.add(docs.filter("doc_id < 70")).collect()
    assert not any(r["kept"] for r in again) and {r["keep_id"] for r in again} == kept
    rest = second.add(docs.filter("doc_id >= 70"), batches=3).collect()
    groups = {normal(r["text"]) for r in plain.values()}
    assert second.read().count() == len(groups) and len(rest) == sum(i >= 70 for i in plain)
    plan = second.read().groupBy("digest").count()._jdf.queryExecution().executedPlan().toString()
    assert "Bucketed: true" in plan
    second.forget()


def test_exact_dedup_of_text_ids(spark):
    rows = spark.createDataFrame([("b", "x y", 1), ("a", "x  y", 2), (None, "x y", 3), ("a", "x  y", 4), ("c", "z", 5)], "doc_id string, text string, n int")
    decisions = exact_dedup.DigestIndex(spark).add(rows, batches=2)
    assert {(r["doc_id"], r["keep_id"], r["group_size"]) for r in decisions.collect()} == {("b", "a", 4), ("a", "a", 4), (None, "a", 4), ("c", "c", 1)}
    kept = exact_dedup.kept_rows(rows, decisions).collect()
    assert sorted(r["doc_id"] for r in kept) == ["a", "c"]
    assert exact_dedup.kept_rows(rows.repartition(3), decisions).exceptAll(exact_dedup.kept_rows(rows.repartition(2), decisions)).isEmpty()


def test_simhash_of_text_ids(spark):
    rows = spark.createDataFrame([("b", "one two three"), ("a", "one two three"), (None, "one two three"), ("c", "")], "doc_id string, text string")
    grouped = simhash.group(rows)
    assert {(r["doc_id"], r["component_id"]) for r in grouped.collect()} == {("b", "a"), ("a", "a"), (None, "a"), ("c", "c")}
    assert sorted(r["doc_id"] for r in simhash.kept_rows(rows, grouped).collect()) == ["a", "c"]


def test_mixed_rows_lie_shard_by_shard(docs):
    draws = {r["doc_id"]: r["draws"] for r in mixing.mix(docs).collect()}
    path = [(d["shard"], d["place"]) for r in mixing.mixed_rows(docs).collect() for d in [draws[r["doc_id"]]] if len(d) == 1 for d in d]
    assert path == sorted(path) and len({s for s, _ in path}) > 1


def test_exact_dedup_keeps_one_of_repeated_rows(spark):
    rows = spark.createDataFrame([(1, "a b"), (1, "a  b"), (None, "a b"), (None, "c"), (2, None), (3, "")], "doc_id long, text string")
    decisions = exact_dedup.DigestIndex(spark).add(rows)
    assert decisions.filter("kept").count() == 3
    kept = exact_dedup.kept_rows(rows, decisions)
    assert kept.columns == rows.columns and sorted((r["doc_id"] or 0) for r in kept.collect()) == [0, 1, 2]


@pytest.mark.parametrize("shards", [4, 24, 200])
def test_sharding_is_gapless_and_even(docs, plain, shards):
    rows = sharding.shard(docs, shards).collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(plain)
    sizes = Counter(r["shard"] for r in rows)
    counts = [sizes.get(k, 0) for k in range(shards)]
    assert max(counts) - min(counts) <= 1
    for k in sizes:
        assert sorted(r["slot"] for r in rows if r["shard"] == k) == list(range(sizes[k]))
    for r in rows:
        body = (plain[r["doc_id"]]["text"] or "").encode()
        assert (r["size"], r["text_crc32"]) == (len(body) + 8, zlib.crc32(body))
    if shards == 4:  # pairs and triples stay together
        where = defaultdict(set)
        for r in rows:
            where[plain[r["doc_id"]]["text"] or ""].add(r["shard"])
        assert sum(len(x) > 1 for x in where.values()) <= 1


def test_sharding_of_all_equal_and_of_no_rows(spark):
    rows = spark.createDataFrame([(i, "same") for i in range(100)], "doc_id long, text string")
    assert set(Counter(r["shard"] for r in sharding.shard(rows, 7).collect()).values()) == {14, 15}
    assert sharding.shard(rows.limit(0), 7).count() == 0


def test_sharding_moves_where_all_rows_are_linked(spark):
    rows = [(i, f"pair {i // 2}" if i < 1200 else f"five {i // 5}") for i in range(2400)]
    out = sharding.shard(spark.createDataFrame(rows, "doc_id long, text string"), 8).collect()
    assert set(Counter(r["shard"] for r in out).values()) == {300}
    where = defaultdict(set)
    for r in out:
        where[rows[r["doc_id"]][1]].add(r["shard"])
    assert sum(len(x) > 1 for x in where.values()) <= 0.1 * len(where)


def test_sharding_admits_what_fits():
    assert sharding._admitted([(0, 1, 5), (1, 0, 5)], [0, 0]) == [0, 1]
    assert sharding._admitted([(0, 1, 5), (1, 2, 5), (2, 0, 5)], [0, 0, 0]) == [0, 1, 2]
    assert sharding._admitted([(0, 1, 6), (1, 0, 5)], [0, 0]) == []
    assert sharding._admitted([(0, 1, 1), (0, 1, 5), (1, 0, 5)], [0, 0]) == [1, 2]


def test_simhash_equals_brute_force(docs, plain):
    def fingerprint(text):
        words = re.findall(WORD, (text or "").translate(LOWER))
        parts = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
        hashes = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
        return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))

    fps = {i: fingerprint(r["text"]) for i, r in plain.items()}
    root = {i: i for i in fps}
    for _ in fps:
        for a in fps:
            root[a] = min([root[b] for b in fps if bin(fps[a] ^ fps[b]).count("1") <= 2])
    rows = simhash.group(docs).collect()
    assert {r["doc_id"]: (r["fp"] % (1 << 64), r["component_id"]) for r in rows} == {i: (fps[i], root[i]) for i in fps}
    assert all(r["kept"] == (r["component_id"] == r["doc_id"]) for r in rows)
    assert simhash.group(docs.limit(0)).count() == 0


def test_simhash_cuts_large_buckets(spark, monkeypatch):
    rng = random.Random(3)
    base = [rng.getrandbits(64) for _ in range(12)]
    fps = sorted({b ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for b in base for _ in range(40)})
    near = np.concatenate(list(simhash.within(np.array(fps, "<u8"), 2)))
    lanes = np.unpackbits(near.view(np.uint8), axis=1, bitorder="little")[:, : len(fps)]
    assert all(bool(lanes[i, j]) == (bin(a ^ b).count("1") <= 2) for i, a in enumerate(fps) for j, b in enumerate(fps))
    monkeypatch.setattr(simhash, "BUCKET", 5)
    classes = spark.createDataFrame([(x - (1 << 64) if x >> 63 else x,) for x in fps], "fp long")
    from retenta.llm.components import components

    got = {r["node"] % (1 << 64): r["root"] % (1 << 64) for r in components(simhash.links(classes)).collect()}
    root = {a: a for a in fps}
    for _ in range(8):
        for a in fps:
            root[a] = min(root[b] for b in fps if bin(a ^ b).count("1") <= 2)
    parts = lambda m: sorted(sorted(k for k in m if m[k] == r) for r in set(m.values()))
    assert parts(got) == [p for p in parts(root) if len(p) > 1]


def test_mixing_reaches_its_targets(docs, plain):
    first = {r["id"]: r for r in mixing.mix_sizes(docs).collect()}
    again = {r["id"]: r for r in mixing.mix_sizes(docs).collect()}
    assert first == again and set(first) == set(plain)
    size = {i: len(re.findall(WORD, r["text"] or "")) for i, r in plain.items()}
    by = defaultdict(int)
    for i, r in plain.items():
        by[r["source"]] += size[i]
    order = sorted(by, key=lambda s: (s is None, s or ""))
    weight, target, left = {s: 1 + k % 3 for k, s in enumerate(order)}, {}, float(sum(by.values()))
    while open_ := [s for s in order if s not in target]:
        share = left / sum(weight[s] for s in open_)
        above = [s for s in open_ if share * weight[s] > 3 * by[s]]
        for s in above or open_:
            target[s] = 3.0 * by[s] if above else share * weight[s]
            left -= target[s]
    for i, r in first.items():
        s = plain[i]["source"]
        assert (r["size"], r["source_size"]) == (size[i], by[s]) and math.isclose(r["target"], target[s])
        assert len(r["draws"]) <= 3 and all(0 <= d["shard"] < mixing.SHARDS for d in r["draws"])
    for s in order:
        taken = sum(size[i] * len(first[i]["draws"]) for i in first if plain[i]["source"] == s)
        largest = max(size[i] for i in first if plain[i]["source"] == s)
        assert abs(taken - target[s]) <= largest
    rows = mixing.mixed_rows(docs)
    assert rows.columns == docs.columns and rows.count() == sum(len(r["draws"]) for r in first.values())


def test_mixing_stops_at_three_times_a_source(spark):
    rows = spark.createDataFrame([(i, "w " * (900 if i < 10 else 1), "a" if i < 10 else "b") for i in range(40)], "doc_id long, text string, source string")
    out = mixing.mix_sizes(rows).collect()
    assert all(len(r["draws"]) == 3 and r["target"] == 90 for r in out if r["size"] == 1)
    assert mixing.mix_sizes(rows.limit(0)).count() == 0


def test_splitting_tree_sums_to_its_quotas():
    quotas = np.array([5, 0, 131, 17])
    leaves = [mixing.split_quotas(quotas, 11, k, 3) for k in range(11)]
    assert np.sum(leaves, axis=0).tolist() == quotas.tolist()
    assert max(x.sum() for x in leaves) - min(x.sum() for x in leaves) <= 2


def test_lm_scores_equal_brute_force(docs, plain):
    toks = {i: [*re.findall(WORD, (r["text"] or "").translate(LOWER)), None] for i, r in plain.items()}
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in toks}
    c, b, starts = Counter(), Counter(), 0
    for i, w in toks.items():
        if not held[i]:
            starts += 1
            c.update(w)
            b.update(zip(["^", *w], w))
    n, v, a = sum(c.values()), len(c), lm_scoring.A
    rows = lm_scoring.score(docs, ~lm_scoring.held_out(), slice_bytes=4000).collect()
    assert len(rows) == len(toks)
    for r in rows:
        w = toks[r["doc_id"]]
        p = [(c[x] + 1) / (n + v + 1) for x in w]
        score = sum(math.log10((b[y, x] + a * q) / ((starts if y == "^" else c[y]) + a)) for y, x, q in zip(["^", *w], w, p))
        assert (r["train"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (not held[r["doc_id"]], len(w), sum(c[x] > 0 for x in w), n)
        assert math.isclose(r["base_score"], sum(map(math.log10, p)), rel_tol=1e-9) and math.isclose(r["score"], score, rel_tol=1e-9)
    assert lm_scoring.score(docs.limit(0), F.lit(True)).count() == 0


def test_kneser_ney_sums_to_one_and_classifies(spark):
    rng = random.Random(4)
    prose = lambda k: " ".join(rng.choices(["the", "thea", "onan", "ering", "of", "tion"], k=k))
    junk = lambda k: " ".join(rng.choices(["$$%", "QXZ!!", "#|#"], k=k))
    rows = [(i, junk(30) if i % 10 == 9 else prose(60), "en" if i % 2 else "fr", i) for i in range(300)] + [(300, None, "en", 0), (301, "", None, 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, limit int")
    labels = spark.createDataFrame([(i, 0 if i % 10 == 9 else 1, 0) for i in range(0, 300, 1)] + [(None, 1, 0)], "doc_id long, quality int, toxic int")
    out = quality.classify(docs, labels).collect()
    assert len(out) == len(rows)
    rejected = {r["doc_id"] for r in out if r["rejected"]}
    assert rejected >= {i for i in range(300) if i % 10 == 9} and len(rejected) <= 33
    assert all(r["perplexity"] is None for r in out if r["doc_id"] >= 300)
    assert not any(r["rejected"] for r in quality.classify(docs, labels.limit(0)).collect())
    from retenta.llm import kneser_ney as kn

    model = {r["gram"]: r for r in kn.train(spark.createDataFrame([("abab abc",), ("abd",)], "text string"), 3).collect()}
    number = lambda s: sum((x + 1) << 9 * (len(s) - 1 - i) for i, x in enumerate(s))

    def p(context, x):
        gram, k = (number(context) << 9 | x + 1), len(context) + 1
        if (found := model.get(gram | k << 60)) and found["log_p"] is not None:
            return 10 ** found["log_p"]
        if k == 1:
            weight = model[0]["log_gamma"]
            return 10**weight / 257
        at = model.get(number(context) | (k - 1) << 60)
        return (10 ** at["log_gamma"] if at and at["log_gamma"] is not None else 1.0) * p(context[1:], x)

    for context in (b"ab", b"ba", b"zz"):
        assert math.isclose(sum(p(context, x) for x in range(256)) + p(context, -1 + 256), 1.0, abs_tol=0.02)


def test_quality_limit_is_not_set_by_one_tiny_trusted_text(spark):
    rng = random.Random(6)
    prose = lambda k: " ".join(rng.choices(["the", "thea", "onan", "ering", "of", "tion"], k=k))
    held = [i for i in range(1600) if zlib.crc32(str(i).encode()) % 5 == 0]
    tiny, junk = held[1], "#|#QXZ!!" * 12
    lang = lambda i: "de" if i % 16 == tiny % 16 else "en"
    rows = [(i, "~$" if i == tiny else prose(60), lang(i)) for i in range(1600)] + [(1600, junk, "de"), (1601, junk, "en"), (1602, prose(60), "xx"), (1603, junk, "xx")]
    assert sum(lang(i) == "de" for i in held) < 200 <= sum(lang(i) == "en" for i in held)
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, 1, 0) for i in range(1600)], "doc_id long, quality int, toxic int")
    out = {r["doc_id"]: r for r in quality.classify(docs, labels).collect()}
    assert all(out[i]["rejected"] for i in (tiny, 1600, 1601, 1603)) and not out[1602]["rejected"]
    assert out[1600]["limit"] == out[1603]["limit"]
    assert sum(r["rejected"] for r in out.values()) < 30


def test_nearest_neighbours(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(1500, 16))
    rows = [(i, v.tolist(), 0) for i, v in enumerate(x)] + [(1500, None, 0), (1501, [0.0] * 16, 0), (1502, [math.nan] * 16, 0), (1503, [1.0, None] * 8, 0), (1504, [1.0], 0), (20, x[20].tolist(), 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    found = defaultdict(list)
    for r in ann.search(df, F.col("id") % 20 == 0).collect():
        found[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    assert set(found) == {i for i in range(0, 1500, 20)}
    hits = 0
    for q, got in found.items():
        got.sort()
        assert [g[0] for g in got] == list(range(1, 21)) and q not in {g[1] for g in got}
        assert all(math.isclose(s, float(x[i] @ x[q]), abs_tol=1e-12) for _, i, s in got)
        scores = x @ x[q]
        scores[q] = -np.inf
        hits += len(set(np.argsort(-scores)[:20]) & {g[1] for g in got})
    assert hits >= 0.9 * 20 * len(found)
    few = ann.search(df.filter("vec_id < 5"), F.col("id") == 0).collect()
    assert sorted(r["vec_id"] for r in few) == [1, 2, 3, 4]
    assert ann.search(df.limit(0), F.col("id") == 0).count() == 0


def test_secrets(spark):
    key, hexa = "AKIA" + "Z9" * 8, "0123456789abcdef" * 2
    body = f'say Token = "{hexa}" and é {key}; secret=token:abc password:x12 {hexa}0'
    rows = spark.createDataFrame([(1, body), (2, None), (3, ""), (4, "clean prose of the thion"), (1, body)], "doc_id long, text string")
    out = {r["doc_id"]: r["spans"] for r in secret_scan.scan(rows, ["doc_id"]).collect()}
    want = sorted([(m.start(), 0, m.end()) for m in secret_scan.ASSIGN.finditer(body) if len(m[2]) >= 6] + [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", body)] + [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", body) if len(m[0]) >= 24])
    assert [(s["start"], secret_scan.KINDS.index(s["kind"]), s["stop"]) for s in out[1]] == want
    assert out[2] == out[3] == out[4] == []
    assert secret_scan.scan(rows.limit(0), ["doc_id"]).count() == 0


@pytest.mark.parametrize("bare", [40, 400])
def test_bare_credentials_are_found_at_any_share(spark, bare):
    rng = random.Random(8)
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    fresh = lambda: "ghp_" + "".join(rng.choices(letters, k=36))
    rows = [f'token = "{fresh()}" end' for _ in range(150)] + ["x " + "".join(rng.choices("0123456789abcdef", k=32)) for _ in range(250)]
    rows += [f"see {fresh()} here" for _ in range(bare)]
    rows += [f"ordinary-section-{k}-of-chapter and 2024-01-02T10:11:{k:03}Z 48687010557{k:05} {k} {k * k}" for k in range(400)]
    docs = spark.createDataFrame([(i, x) for i, x in enumerate(rows)], "doc_id long, text string")
    out = {r["doc_id"]: [s["kind"] for s in r["spans"]] for r in secret_scan.scan(docs, ["doc_id"]).collect()}
    assert sum(out[i] == ["format"] for i in range(400, 400 + bare)) >= 0.7 * bare
    assert not any(out[i] for i in range(400 + bare, len(rows)))


def test_inferred_automaton():
    rng = random.Random(1)
    a = automata.Automaton(["KEY" + "".join(rng.choices("0123456789", k=12)) for _ in range(300)])
    assert a.score("KEY" + "123456789012") > -4.5 and a.score("XEY123456789012") is None and a.score("KEYabc") is None
    assert len(a.steps) < 60


def test_licences(spark):
    rows = spark.createDataFrame(
        [(1, "Prose.\nReleased under the MIT Licence\nMore."), (2, "  licensed under the APACHE license -- version 2.0!\n"), (3, None), (4, "the MIT license is fine"), (5, "Copyright (c) 2020 Me\n" + license_scan.KNOWN[4][1])],
        "doc_id long, text string",
    )
    out = {r["doc_id"]: (r["whole_license"], r["licenses"], r["n_lines"]) for r in license_scan.scan(rows, license_scan.known_digests(spark), ["doc_id"]).collect()}
    assert out == {1: (None, ["MIT"], 1), 2: ("Apache-2.0", ["Apache-2.0"], 1), 3: (None, [], 0), 4: (None, [], 0), 5: ("MIT", ["MIT"], 1)}


def test_licences_of_usual_files(spark):
    full = lambda name: (license_scan.LICENSES / f"{name}.txt").read_text(encoding="utf-8")
    apache = full("Apache-2.0")
    bodies = [
        ("MIT", "MIT License\n\nCopyright (c) 2021 Foo Inc. and others\n\n" + license_scan.KNOWN[4][1]),
        ("GPL-3.0", full("GPL-3.0")),
        ("MPL-2.0", full("MPL-2.0")),
        ("BSD-3-Clause", "Copyright 2020 Me\nAll rights reserved.\n\n" + full("BSD-3-Clause").partition("\n\n")[2]),
        ("Apache-2.0", apache.replace("Copyright [yyyy] [name of copyright owner]", "Copyright 2020 Me")),
        ("Apache-2.0", "Copyright 2024 X. Licensed under the Apache License, Version 2.0."),
        *[(x, f"// SPDX-License-Identifier: {x}") for x in ("GPL-3.0-or-later", "BSD-2-Clause", "MPL-2.0", "CC-BY-4.0", "AGPL-3.0-only")],
    ]
    docs = spark.createDataFrame([(i, x) for i, (_, x) in enumerate(bodies)], "doc_id long, text string")
    out = {r["doc_id"]: r["whole_license"] for r in license_scan.scan(docs, license_scan.known_digests(spark), ["doc_id"]).collect()}
    assert [out[i] for i in range(len(bodies))] == [name for name, _ in bodies]


def test_licence_forms():
    form = license_scan.canonical
    assert form("") == ("", [""]) and license_scan.digest("") is None
    assert form("A sub\nlicence_B") == ("a sublicense b", ["a sub", "license b"])  # a spelling may run over lines in the whole only
    assert form("x\n\u00a9 Me 2020\nAll rights reserved. \ny") == ("x y", ["x", "", "", "y"])
    assert form("2020 (c) me") == ("2020 c me", ["2020 c me"])  # a year before the mark only
    long = "(c) " * 100_000
    assert form(long)[0] == ("c " * 100_000).strip()


def test_licences_of_repeated_rows_and_no_rows(spark):
    rows = spark.createDataFrame([(1, "SPDX-License-Identifier: MIT", 7)] * 300 + [(None, None, 1)], "doc_id long, text string, license int")
    out = [tuple(r) for r in license_scan.scan(rows, license_scan.known_digests(spark), ["doc_id", "license"]).collect()]
    assert sorted(out, key=str) == sorted([(1, 7, "MIT", ["MIT"], 1)] * 300 + [(None, 1, None, [], 0)], key=str)
    assert license_scan.scan(rows.limit(0), license_scan.known_digests(spark), ["doc_id"]).count() == 0


def test_bpe_round_trip_equals_encode_and_decode(docs):
    whole = {r["doc_id"]: (r["ids"], r["decoded"]) for r in bpe.round_trip(docs, PATH, ["doc_id"]).collect()}
    apart = bpe.decode(bpe.encode(docs, PATH, ["doc_id"]), PATH, ["doc_id", "ids"]).collect()
    assert whole == {r["doc_id"]: (r["ids"], r["decoded"]) for r in apart}
    assert bpe.round_trip(docs.limit(0), PATH, ["doc_id"]).count() == 0


def test_pipeline_stages(spark, docs, tmp_path):
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(3, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    now = spark.read.parquet(f"{tmp_path}/documents.parquet")
    assert [k.split()[0] for k, _ in corpus_pipeline.STAGES] == ["quality", "exact", "SimHash", "mixing", "BPE"]
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, now, str(tmp_path))
        if i < 4:
            assert out.columns == docs.columns
            out.write.parquet(f"{tmp_path}/{i}")
            now = spark.read.parquet(f"{tmp_path}/{i}")
    assert out.count() == now.count() and out.filter("NOT round_trip").count() == 0


def test_bpe_of_a_long_text_without_spaces():
    t, v, rng = Tokenizer.from_file(PATH), bpe.Vocabulary(open(PATH, "rb").read()), random.Random(8)
    text = "".join(rng.choices("abcdefghij,éà9", k=5_000_000))
    assert np.frombuffer(v.encode_batch([text])[0], "<u4").tolist() == t.encode(text, add_special_tokens=False).ids
    assert all(len(x) < bpe.UNCOMMON for x in v.known.young)  # it isn't remembered
    one = "x" * 300_000
    assert np.frombuffer(v.encode_batch([one])[0], "<u4").tolist() == t.encode(one, add_special_tokens=False).ids


def test_bpe_with_little_memory():
    t, v, rng = Tokenizer.from_file(PATH), bpe.Vocabulary(open(PATH, "rb").read()), random.Random(3)
    v.known = bpe.Remembered(3000)
    words = [rng.choice(["", "é", "à", "x\n", "<|endoftext|>"]) + "".join(rng.choices("abcdeé'1\t ", k=rng.randint(1, 9))) for _ in range(300)]
    for _ in range(60):
        batch = [" ".join(rng.choices(words, k=20)) for _ in range(5)]
        for x, ids in zip(batch, v.encode_batch(batch)):
            assert np.frombuffer(ids, "<u4").tolist() == t.encode(x, add_special_tokens=False).ids
        assert v.known.held <= 3000 and v.known.held == sum(len(x) + len(y) + bpe.ENTRY for x, y in v.known.young.items() if x not in v.special)


def test_word_hashes_tell_words_apart():
    from retenta.llm import slices

    rng = random.Random(7)
    morse = ["a"]
    for _ in range(10):
        morse = [morse[0] + morse[0].translate(str.maketrans("ab", "ba"))]
    words = [morse[0], morse[0].translate(str.maketrans("ab", "ba")), morse[0][:64], morse[0][:64].translate(str.maketrans("ab", "ba")), "a", "a\0", "aa", "\0a"]
    words += ["".join(rng.choices("abcé", k=rng.randint(1, 90))) for _ in range(3000)] + ["x" * n for n in range(1, 200)]
    words += [w.upper() for w in words[:50]] + ["y" * 600_000, "y" * 599_999]
    texts = [" ".join(words[i : i + 40]).encode() for i in range(0, len(words), 40)]
    flat = np.frombuffer(b"".join(texts), np.uint8)
    hashes, where = slices.word_hashes(flat, np.cumsum([0, *map(len, texts)]))
    assert where.tolist() == [i // 40 for i in range(len(words))]
    by = defaultdict(set)
    for w, h in zip(words, hashes.tolist()):
        by[h].add(w.translate(LOWER))
    assert all(len(x) == 1 for x in by.values()) and len(by) == len({w.translate(LOWER) for w in words})


def test_lm_scoring_of_other_ids(spark):
    from decimal import Decimal

    for kind, ids in (("decimal(20,0)", [Decimal(1), Decimal(2), None]), ("string", ["a", "b", None]), ("double", [0.5, 1.5, None])):
        rows = spark.createDataFrame([(i, "one two", "x") for i in ids], f"doc_id {kind}, text string, train string")
        out = lm_scoring.score(rows, F.lit(True))
        assert {r["doc_id"] for r in out.collect()} == set(ids) and out.schema["doc_id"].dataType == rows.schema["doc_id"].dataType


def test_kept_columns_of_the_operators_own_names(spark):
    text = "Released under the MIT License.\npassword = hunter2hunter2"
    rows = spark.createDataFrame([(1, text, "a", "b", "c")], "doc_id long, text string, found string, spans string, licenses string")
    secret = secret_scan.scan(rows, ["doc_id", "found", "spans"]).first()
    assert secret["found"] == "a" and [x["kind"] for x in secret["spans"]] == ["assign"]
    licence = license_scan.scan(rows, license_scan.known_digests(spark), ["doc_id", "licenses", "found"]).first()
    assert licence["found"] == "a" and licence["licenses"] == ["MIT"]


def test_licences_are_read_from_a_zip(tmp_path):
    import os
    import subprocess
    import sys
    import zipfile

    root = os.path.dirname(os.path.dirname(os.path.abspath(license_scan.__file__)))
    with zipfile.ZipFile(tmp_path / "retenta.zip", "w") as z:
        for folder, _, names in os.walk(root):
            for name in names:
                if not name.endswith(".pyc"):
                    z.write(os.path.join(folder, name), os.path.join("retenta", os.path.relpath(os.path.join(folder, name), root)))
    code = "from retenta.llm import license_scan as x; from retenta.operators import trees; print(len(x.known_texts()), len(trees.stored().trees), x.__file__)"
    said = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=os.environ | {"PYTHONPATH": str(tmp_path / "retenta.zip")}, capture_output=True, text=True, timeout=120)
    assert said.returncode == 0, said.stderr
    assert int(said.stdout.split()[0]) == len(license_scan.known_texts()) and "retenta.zip" in said.stdout
