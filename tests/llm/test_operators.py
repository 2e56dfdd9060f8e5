"""Each operator against brute force, an exact round trip or a known answer, on small rows with the defined odd cases."""

import collections
import functools
import hashlib
import math
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.llm import chat, decontamination, embedding_dedup, lm_scoring, mixing, ngram_join, quality, sharding, subword, substring_dedup, token_counts

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def words(rng, n, vocabulary=60):
    return [f"w{rng.randrange(vocabulary)}" for _ in range(n)]


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(5)
    passage = " ".join(words(rng, 60, 1000))
    out = [None, "", " \n\t ", "a", "a b c d", "a b c d", "A b C d"]
    out += [" ".join(words(rng, rng.randrange(1, 120), 4000)) for _ in range(40)]
    out += [" ".join(words(rng, 30, 999)) + "  " + passage + "\n" + " ".join(words(rng, 30, 999)) for _ in range(6)]
    base = words(rng, 200, 5000)
    for _ in range(30):  # near copies
        near = list(base)
        near[rng.randrange(200)] = "changed"
        out.append(" ".join(near))
    out += ["x " * 5000, "long " + "y" * 20_000, "ünïcode space über alles\x0bvertical", out[10], out[10]]
    out.append(" ".join(words(rng, 20_000, 9000)))
    return out


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(i, t, "en", ["s", None, "t"][i % 3] if i % 2 else "hot", None if t is None else len(t)) for i, t in enumerate(texts)]
    rows += [(None, "no id here", None, None, 1), (3, "a", "en", "s", 1)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def byte_words(t):
    return (t or "").encode().split()


def test_substring_dedup(docs, empty):
    got = sorted((str(r.doc_id), r.n_words, r.n_removed, r.kept_sha256) for r in substring_dedup.repeat_digests(docs).collect())
    rows = [(r.doc_id, byte_words(r.text)) for r in docs.collect()]
    seen = collections.Counter(tuple(w[j : j + 35]) for _, w in rows for j in range(len(w) - 34))
    expected = []
    for i, w in rows:
        keep = [True] * len(w)
        for j in range(len(w) - 34):
            if seen[tuple(w[j : j + 35])] > 1:
                keep[j : j + 35] = [False] * 35
        kept = [x for x, k in zip(w, keep, strict=True) if k]
        expected.append((str(i), len(w), len(w) - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest()))
    assert got == sorted(expected)
    assert sum(x[2] for x in got) > 300
    assert substring_dedup.repeat_digests(empty).collect() == []
    clean = substring_dedup.remove_repeats(docs.withColumn("spans", docs.lang).withColumn("n_removed", docs.lang))
    assert clean.columns == [*docs.columns, "spans", "n_removed"] and clean.count() == docs.count()


def _components(rows, sets):
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
                parent[max(find(a), find(b))] = min(find(a), find(b))
    return [find(x) for x in range(len(rows))]


@pytest.mark.parametrize("small", [24, 3])
def test_ngram_join(docs, empty, small):
    rows = docs.collect()
    sets = []
    for r in rows:
        w = byte_words((r.text or "").encode().lower().decode() if r.text else "")
        sets.append({tuple(w[j : j + 5]) for j in range(len(w) - 4)} if len(w) > 4 else {tuple(w)} if w else set())
    roots = _components(rows, sets)
    low = {}
    for r, root in zip(rows, roots, strict=True):
        if r.doc_id is not None:
            low[root] = min(low.get(root, r.doc_id), r.doc_id)
    expected = sorted((str(r.doc_id), len(s), str(low.get(root))) for r, s, root in zip(rows, sets, roots, strict=True))
    got = sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in ngram_join.near_duplicates(docs, small=small).collect())
    assert got == expected
    assert ngram_join.near_duplicates(empty).collect() == []
    kept = ngram_join.keep_one(docs)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {int(x[0]) for x in expected if x[0] == x[2] and x[0] != "None"} | {None}


def test_components(spark):
    from lodestone.llm import common

    rng = random.Random(6)
    edges = [(f"n{i:04}", f"n{i + 1:04}") for i in range(40)] + [("hub", f"n{rng.randrange(3000):04}") for _ in range(700)] + [(f"n{rng.randrange(3000):04}", f"n{rng.randrange(3000):04}") for _ in range(500)] + [("x", "x"), ("é", "z")]
    parent = {v: v for e in edges for v in e}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        parent[max(find(a), find(b))] = min(find(a), find(b))
    expected = {v: find(v) for v in parent if find(v) != v}
    table = spark.createDataFrame(edges, "src string, dst string").repartition(3)
    for alone in (common.ALONE, 0):  # by one task, and by rounds over many
        assert {r.node: r.component for r in common.components(table, alone=alone).collect()} == expected
        assert common.components(table.limit(0), alone=alone).collect() == []


def test_ngram_join_gives_no_pairs_of_long_lists(spark, monkeypatch):
    """Texts that share much, but too little to link, and a few that do link: every table has about as many rows as the lists have entries, not pairs."""
    rng = random.Random(8)
    common, rows = words(rng, 330, 10**6), []
    for i in range(160):
        at = rng.randrange(300)
        rows.append(common[:at] + ["odd", str(i)] + common[at + 2 :] + words(rng, 50, 10**6))
    rows += [[*rows[k][:-2], "near", str(k)] for k in range(0, 160, 9)]
    sets = [{tuple(r[k : k + 5]) for k in range(len(r) - 4)} for r in rows]
    roots = _components(rows, sets)
    assert 100 < len(set(roots)) < len(rows)
    made, write = [], ngram_join.written
    monkeypatch.setattr(ngram_join, "written", lambda df: made.append(write(df)) or made[-1])
    monkeypatch.setattr(ngram_join, "dropped", lambda df: None)
    docs = spark.createDataFrame([(i, " ".join(r)) for i, r in enumerate(rows)], "doc_id long, text string").repartition(3)
    got = {r.doc_id: r.component_id for r in ngram_join.near_duplicates(docs).collect()}
    assert got == dict(enumerate(roots))
    entries = next(t.count() for t in made if t.columns == ["list", "ka", "xa"])
    assert entries > 2000
    assert max(t.count() for t in made if "kb" in t.columns and "list" not in t.columns) < 20 * len(rows)
    blocks = [t.count() for t in made if t.columns == ["list", "x", "y", "ka"]]
    assert blocks and 0 < blocks[0] < entries


@pytest.mark.parametrize("block", [4, 512])
def test_ngram_join_grid(spark, monkeypatch, block):
    """Links that only blocks of long lists find, in grids of any fineness."""
    monkeypatch.setattr(ngram_join, "BLOCK", block)
    rng, rows = random.Random(9), []
    for _ in range(4):
        base = words(rng, 120, 10**6)
        for _ in range(12):
            k = rng.randrange(120)
            base = [*base[:k], "x" + str(rng.randrange(10**6)), *base[k + 1 :]]
            rows.append(base)
    sets = [{tuple(r[k : k + 5]) for k in range(len(r) - 4)} for r in rows]
    docs = spark.createDataFrame([(i, " ".join(r)) for i, r in enumerate(rows)], "doc_id long, text string").repartition(3)
    got = {r.doc_id: r.component_id for r in ngram_join.near_duplicates(docs, small=1).collect()}
    assert got == dict(enumerate(_components(rows, sets)))


def test_keep_one_judges_rows(spark):
    rng = random.Random(8)
    text = lambda n: " ".join(words(rng, n, 5000))
    base, other, third = text(100), text(100), text(80)
    near = base + " end"
    rows = [(3, base), (7, near), (7, other), (9, third), (9, third), (None, third), (None, None), (11, ""), (12, "a b c"), (13, "A b C"), (14, other + " more")]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], SCHEMA).withColumns({"_key": F.lit("x"), "n_shingles": F.lit(0), "component_id": F.lit("kept")})
    got = ngram_join.keep_one(docs)
    assert got.columns == docs.columns
    kept = sorted(((str(r.doc_id), r.text) for r in got.collect()), key=str)
    # the near copy of id 3 goes, the other text of its id stays; of equal rows one stays; a row without id gives way
    assert kept == sorted([("3", base), ("7", other), ("9", third), ("None", None), ("11", ""), ("12", "a b c")], key=str)
    assert ngram_join.keep_one(docs.limit(0)).collect() == []


def test_occurrences_are_counted(spark):
    """Pairs that share few shingles of their short lists are told apart by the count, with the same result as all pairs in turn."""
    rng = random.Random(3)
    common = [" ".join(words(rng, 6, 50)) for _ in range(30)]
    rows = []
    for i in range(160):
        w = words(rng, rng.randrange(8, 60), 3000)
        for _ in range(rng.randrange(4)):
            w += rng.choice(common).split()
        rows.append(w)
        if i % 4 == 0:
            rows.append([*w[: len(w) - 1], "x"])
    docs = spark.createDataFrame([(i, " ".join(w), "en", "s", 1) for i, w in enumerate(rows)], SCHEMA)
    sets = [{tuple(w[j : j + 5]) for j in range(len(w) - 4)} for w in rows]
    roots = _components(rows, sets)
    for small in (24, 2):
        got = {r.doc_id: r.component_id for r in ngram_join.near_duplicates(docs, small=small).collect()}
        assert got == dict(enumerate(roots))
    sizes, pairs = np.array([10, 10, 10]), ngram_join._Occurrences(np.array([10, 10, 10]), (75, 100))
    for i, j in (([0, 1], [1, 2]), ([1], [0]), ([2], [2])):
        pairs.add(np.array(i), np.array(j))
    ids, n = pairs.all()
    assert len(sizes) == 3 and [(x >> 32, x & 0xFFFFFFFF, c) for x, c in zip(ids.tolist(), n.tolist(), strict=True)] == [(0, 1, 2), (1, 2, 1)]


def test_decontamination(spark, docs, empty, texts):
    items = [(1, " ".join(texts[12].split()[:14]).upper() if len(texts[12].split()) >= 14 else texts[12]), (2, "a b c"), (10, None), (3, ""), (4, " ".join(texts[-1].split()[500:530])), (4, "b c d"), (None, " ".join(texts[-1].split()[900:915]))]
    table = spark.createDataFrame(items, "item_id long, text string")
    pattern = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    split = lambda t: pattern.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in (t or "")))
    grams = {}
    for i, t in items:
        w = split(t)
        for j in range(max(1, len(w) - 9)) if w else ():
            grams.setdefault(tuple(w[j : j + 10]), set()).add(i)
    expected = []
    for r in docs.collect():
        w = split(r.text)
        hit, found = [0] * len(w), set()
        for size in {len(g) for g in grams}:
            for j in range(len(w) - size + 1):
                if (owner := grams.get(tuple(w[j : j + size]))) is not None:
                    found |= owner - {None}
                    hit[j : j + size] = [1] * size
        expected.append((str(r.doc_id), len(w), sum(hit), len(found), hashlib.sha256(",".join(sorted(map(str, found))).encode()).hexdigest(), sum(hit) > 0))
    for block, one_pass in ((4_000_000, 64_000_000), (10, 1000), (10, 40)):
        got = sorted((str(r[0]), *r[1:]) for r in decontamination.contamination_digests(docs, table, block_bytes=block, pass_bytes=one_pass).collect())
        assert got == sorted(expected)
    named = table.withColumn("item_id", F.concat(F.lit("item-"), "item_id"))
    got = {(str(r.doc_id), r.n_hit): r["items"] for r in decontamination.contamination(docs, named).withColumn("n_hit", F.expr("aggregate(hits, 0, (a, x) -> a + x.e - x.s)")).collect()}
    assert {k[0]: len(v) for k, v in got.items()} == {x[0]: x[3] for x in expected} and {i for v in got.values() for i in v} <= {"item-1", "item-2", "item-4"}
    assert sum(x[2] for x in expected) > 30
    cut = decontamination.without_hits(docs.withColumn("hits", docs.lang), table)
    assert cut.columns == [*docs.columns, "hits"]
    cut = cut.drop("hits")
    assert not any(r.contaminated for r in decontamination.contamination_digests(spark.createDataFrame(cut.where("doc_id <> 4").collect(), SCHEMA), table.where("item_id = 4 and length(text) > 30")).collect())
    assert decontamination.contamination_digests(empty, table).collect() == []
    assert all(r.n_hit == 0 for r in decontamination.contamination_digests(docs, table.limit(0)).collect())


@pytest.mark.parametrize("seed", range(4))
def test_fm_index(seed):
    rng = np.random.default_rng(seed)
    text = np.append(rng.integers(1, 4, 300), 4)
    text[rng.integers(0, 300, 20)] = 4
    index = decontamination.FMIndex(text, 4)
    for pattern in ([1, 2], [3], [2, 2, 1], [1, 1, 1, 1]):
        lo, hi = index.search(np.array([pattern + [0] * (4 - len(pattern))]))
        at = sorted(index.locate(np.arange(lo[0], hi[0])).tolist())
        assert at == [i for i in range(len(text)) if text[i : i + len(pattern)].tolist() == pattern]


def test_token_counts(docs, empty, texts):
    public = pytest.importorskip("public_tokenizers")
    sentencepiece = pytest.importorskip("sentencepiece")
    path = public.path("piece_bpe_32k.model")
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    got = token_counts.count_tokens(docs.withColumn("n_tokens", docs.lang), path).collect()
    for r in got:
        n = len(sp.encode(r.text or ""))
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len((r.text or "").encode()), n, n > 4096)
    assert token_counts.count_tokens(empty, path).collect() == []
    counter = token_counts.Counter32(open(path, "rb").read())
    assert counter.splits
    rng = random.Random(1)
    for _ in range(300):
        t = "".join(rng.choice(["a", "the", " ", "  ", "\n", "▁", "</s>", "é", "\r", "\t", "🙂", "١", "<0x0A>", "\x00", "."]) for _ in range(rng.randrange(12)))
        assert counter.count(t) == len(sp.encode(t)), repr(t)


def test_sharding(docs, empty):
    rows = sharding.shard_digests(docs).collect()
    n = docs.count()
    sizes = collections.Counter(r.shard for r in rows)
    assert len(rows) == n and set(sizes) == set(range(24)) and max(sizes.values()) - min(sizes.values()) <= 1
    for k in sizes:
        assert sorted(r.slot for r in rows if r.shard == k) == list(range(sizes[k]))
    assert sorted((str(r.doc_id), r.size) for r in rows) == sorted((str(r.doc_id), len((r.text or "").encode()) + 8) for r in docs.collect())
    hot = collections.Counter(r.shard for r in rows if r.source == "hot")
    assert all(abs(hot.get(k, 0) - sum(hot.values()) / 24) <= 2 for k in range(24))
    # the order and cut of plain code over the same hashes
    slim = docs.select("doc_id", "source", (F.coalesce(F.octet_length("text"), F.lit(0)) + 8).cast("long").alias("size"), F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("crc"))
    key = F.when(F.col("source").isNull(), "n").otherwise(F.concat(F.lit("s"), "source"))
    plain = slim.select("doc_id", "crc", key.alias("key"), F.shiftrightunsigned(F.xxhash64("doc_id", "size", "crc", F.lit(7)), 1).alias("h"), F.xxhash64(key, F.lit(7)).alias("s")).collect()
    ranked = []
    for k in {r.key for r in plain}:
        mine = sorted((r for r in plain if r.key == k), key=lambda r: r.h)
        ranked += [(Fraction(2 * i + 1, 2 * len(mine)), r.s, r.key, i, r.doc_id, r.crc) for i, r in enumerate(mine)]
    expected = set()
    for at, r in enumerate(sorted(ranked, key=lambda x: x[:4])):
        shard = ((at + 1) * 24 - 1) // n
        expected.add((r[4], r[5], shard, at - shard * n // 24))
    assert {(r.doc_id, r.text_crc32, r.shard, r.slot) for r in rows} == expected
    again = {(r.doc_id, r.text_crc32, r.shard, r.slot) for r in sharding.shard_digests(docs.repartition(5)).collect()}
    assert again == expected  # no two rows are equal here, so the order of input rows changes nothing
    assert sharding.shard_digests(empty).collect() == []
    odd = docs.withColumns({"_sh_key": F.lit(1), "_sh_rank": F.lit("x"), "_c0": F.lit("y"), "shard": F.lit("old")})
    kept = sharding.interleaved(odd, 5)
    assert kept.columns == [*docs.columns, "_sh_key", "_sh_rank", "_c0", "shard", "slot"]
    assert collections.Counter((r._sh_key, r._sh_rank, r._c0) for r in kept.collect()) == {(1, "x", "y"): n}
    # rows without id and equal rows have places of their own
    same = spark_rows(docs, [(None, "t", "en", "one", 1)] * 40 + [(5, "t", "en", "one", 1)] * 60)
    places = sorted((r.shard, r.slot) for r in sharding.interleaved(same, 7).collect())
    assert len(set(places)) == 100 and collections.Counter(s for s, _ in places).most_common()[0][1] == 15


def spark_rows(docs, rows):
    return docs.sparkSession.createDataFrame(rows, SCHEMA)


def test_chat(spark):
    rows = [(1, 0, "user", "hi <s> [INST] \\s"), (1, 1, "assistant", "a\nb"), (1, 1, "assistant", "a\nb"), (1, 2, "tool\nx", None), (2, 0, "assistant", "</s>"), (None, 0, "user", "x"), (3, None, None, "")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r.conv_id: r for r in chat.chat_digests(turns).collect()}
    said = {c: "" for c in got}
    loss = {c: "" for c in got}
    for c, _, role, text in [*rows, (-1, 0, "user", "</s>[INST] ok [/INST]"), (-1, 1, "assistant", "</s>[INST] ok [/INST]")]:
        said[c] += f"{role or ''}\n{text or ''}\n"
        loss[c] += (text or "") if role == "assistant" else ""
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    for c, r in got.items():
        assert (r.turns_sha256, r.loss_chars, r.loss_sha256) == (sha(said[c]), len(loss[c]), sha(loss[c])), c
    assert got[1].n_turns == 4
    assert {r.conv_id for r in chat.chat_digests(turns.limit(0)).collect()} == {-1}


def test_reply_trees(spark):
    schema = "conv_id long, node long, parent long, role string, text string, score double"
    nodes = spark.createDataFrame([(1, 1, None, "user", "q", 0.0), (1, 2, 1, "assistant", "low", 1.0), (1, 3, 1, "assistant", "high", 2.0), (1, 4, 3, "user", "more", 0.0), (2, 9, 7, "user", "orphan", None)] + [(5, i, i - 1 or None, "user", str(i), 0.0) for i in range(1, 38)], schema)
    best = {r.conv_id: r for r in chat.formatted(nodes).collect()}
    assert "high" in best[1].text and "low" not in best[1].text and best[1].n_turns == 3
    assert best[2].n_turns == 1 and best[5].n_turns == 37
    back = chat.formatted(nodes).where("conv_id = 5").select(chat.read_back(chat.F.col("text")).alias("t")).first().t
    assert [t["text"] for t in back] == [str(i) for i in range(1, 38)]
    assert chat.formatted(nodes, best=None).where("conv_id = 1").count() == 2


def test_reply_trees_with_cycles_and_repeats(spark):
    schema = "conv_id long, node long, parent long, role string, text string, score double"
    rows = [(1, 5, 3, "user", "e", 0.0), (1, 3, 4, "user", "c", 0.0), (1, 4, 5, "user", "d", 0.0), (1, 9, 4, "assistant", "leaf", 1.0), (1, 10, 9, "user", "z", 0.0)]  # 3 -> 4 -> 5 -> 3, a branch at 4
    rows += [(2, 1, 1, "user", "own parent", 0.0), (3, 1, None, "user", "root", 0.0), (3, None, 1, "user", "no node", 0.0)]
    rows += [(4, 1, None, "user", "q", 0.0), *[(4, 2, 1, "assistant", "twice", 0.0)] * 5, (4, 2, None, "assistant", "twice", 0.0), (4, 3, 2, "user", "x" * 50_000, 0.0)] + [(None, 1, 2, "user", "p", None), (None, 2, 1, "user", "q", None)]
    nodes = spark.createDataFrame(rows, schema).withColumns({"c": F.lit(1), "leaf": F.lit("x"), "at": F.lit(2)})
    out = {(r.conv_id, r.leaf): r for r in chat.formatted(nodes, best=None).withColumn("t", chat.read_back(F.col("text"))).collect()}
    said = {k: [t["text"] for t in r.t] for k, r in out.items()}
    assert said[(1, 10)] == ["c", "e", "d", "leaf", "z"] and said[(2, 1)] == ["own parent"] and said[(3, 1)] == ["root"]
    assert said[(4, 3)] == ["twice", "x" * 50_000] and said[(4, 1)] == ["q"]  # of the repeats of node 2 the one without a parent counts
    assert said[(None, 2)] == ["p", "q"] and len(out) == 6
    assert chat.formatted(nodes.limit(0)).collect() == []


def test_lm_scoring(docs, empty):
    got = sorted(lm_scoring.score(docs.withColumns({"score": F.lit(1), "part": F.lit("x"), "kind": F.lit(2)})).collect(), key=lambda r: (str(r.doc_id), r.n_tokens))
    rows = sorted(((r.doc_id, (r.text or "").encode().lower().split()) for r in docs.collect()), key=lambda x: (str(x[0]), len(x[1])))
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 5 == 1
    counts = collections.Counter()
    for i, w in rows:
        if not held(i):
            counts.update([*w, None])
    n, v = sum(counts.values()), len(counts)
    for r, (i, w) in zip(got, rows, strict=True):
        t = [*w, None]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held(i), len(t), sum(counts[x] > 0 for x in t), n)
        assert r.base_score == pytest.approx(sum(math.log10((counts[x] + 0.5) / (n + 0.5 * (v + 1))) for x in t), rel=1e-9)
        assert -1e9 < r.score < 0
        coded = sum(len(x) + 1 for x in w) + 1
        assert r.bits_per_byte == pytest.approx(-r.score * math.log2(10) / coded)
    assert lm_scoring.score(empty).collect() == []
    few = lm_scoring.score(docs, frequent_words=2, max_contexts=50).collect()
    assert sorted((str(r.doc_id), r.n_known) for r in few) == sorted((str(r.doc_id), r.n_known) for r in got)


@pytest.mark.parametrize("text", [b"abracadabra abracadabra", "\u00fcber \u00e9t\u00e9 \U0001f642 \u00fc \u00e9t\u00e9".encode(), bytes(range(250, 256)) * 3 + b"\x00\x80\xff"])
def test_scores_are_those_of_a_plain_context_tree(text):
    """A tree of dictionaries, weighted by recursion over all depths, gives the same probability of every byte in every context."""
    depth = 3
    padded = b"\n" * depth + text
    seen = [(padded[i - depth : i], padded[i]) for i in range(depth, len(padded))]
    pairs = collections.Counter(((d + 1) << 56) | int.from_bytes(c[depth - d :] + bytes([x]), "big") for c, x in seen for d in range(depth + 1))
    keys = np.array(sorted(pairs), np.uint64)
    nodes, p = lm_scoring.build_tree(keys, np.array([pairs[int(x)] for x in keys]), depth)

    def counts(tail, prefix):  # zeros and ones behind contexts that end in `tail`, after the bits `prefix` of the byte
        bits = [f"{x:08b}" for c, x in seen if c.endswith(tail)]
        nexts = [b[len(prefix)] for b in bits if b.startswith(prefix)]
        return nexts.count("0"), nexts.count("1")

    def log_kt(a, b):
        return math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - math.log(math.pi)

    @functools.cache
    def weighted(tail, prefix):
        own = log_kt(*counts(tail, prefix))
        return own if len(tail) == depth else np.logaddexp(own, below(tail, prefix)) - math.log(2)

    def below(tail, prefix):
        return sum(weighted(t, prefix) for t in {c[depth - len(tail) - 1 :] for c, _ in seen if c.endswith(tail)} if sum(counts(t, prefix)))

    def of_one(context, prefix, d=0):
        tail = context[depth - d :]
        zero, one = counts(tail, prefix)
        own = (one + 0.5) / (zero + one + 1)
        if d == depth or not sum(counts(context[depth - d - 1 :], prefix)):
            return own
        stop = 1 / (1 + math.exp(min(700, below(tail, prefix) - log_kt(zero, one))))
        return stop * own + (1 - stop) * of_one(context, prefix, d + 1)

    for context in {c for c, _ in seen[::3]} | {b"abr", b"\n\n\n", b"zza", "a\u00e9".encode(), b"\x00\xff\x80"}:
        want = np.array([int.from_bytes(context + bytes([x]), "big") for x in range(256)], np.uint64)
        got = lm_scoring.byte_scores(nodes, p, want, depth)
        assert (10**got).sum() == pytest.approx(1, abs=1e-9)
        for x in {*text, 0, 127, 128, 255}:
            plain = 0.0
            for j, bit in enumerate(f"{x:08b}"):
                prefix = f"{x:08b}"[:j]
                one = of_one(context, prefix) if sum(counts(b"", prefix)) else 0.5
                plain += math.log10(one if bit == "1" else 1 - one)
            assert got[x] == pytest.approx(plain, abs=1e-6)


def test_a_bit_seen_very_often_leaves_room_for_the_other():
    pairs = np.array([(1 << 56) | 0xE1], np.uint64)
    nodes, p = lm_scoring.build_tree(pairs, np.array([10**9]), 0)
    assert -80 < lm_scoring.byte_scores(nodes, p, np.array([0x1E], np.uint64), 0)[0] < -9


def test_lm_scores_use_every_context(docs, empty):
    """Scores are those of the whole tree of all training rows, in one piece, whatever the bound of a group."""
    depth = 5
    byte_text = lambda t: b"\n" * depth + b"".join(w + b" " for w in (t or "").encode().lower().split()) + b"\n"
    rows = [("" if r.doc_id is None else str(r.doc_id), byte_text(r.text)) for r in docs.collect()]
    pairs = collections.Counter()
    for i, t in rows:
        if zlib.crc32(i.encode()) % 5 != 1:
            pairs.update(((d + 1) << 56) | int.from_bytes(t[j - d : j + 1], "big") for j in range(depth, len(t)) for d in range(depth + 1))
    keys = np.array(sorted(pairs), np.uint64)
    nodes, p = lm_scoring.build_tree(keys, np.array([pairs[int(x)] for x in keys]), depth)
    expected = []
    for i, t in rows:
        want = np.array([int.from_bytes(t[j - depth : j + 1], "big") for j in range(depth, len(t))], np.uint64)
        expected.append((i, lm_scoring.byte_scores(nodes, p, want, depth).sum()))
    for bound in (50, 1 << 20):
        got = sorted(("" if r.doc_id is None else str(r.doc_id), r.score) for r in lm_scoring.score(docs, max_contexts=bound).collect())
        assert [i for i, _ in got] == [i for i, _ in sorted(expected)]
        assert [x for _, x in got] == pytest.approx([x for _, x in sorted(expected)], rel=1e-6)


def test_embeddings(spark):
    rng = np.random.default_rng(3)
    rows, centres = [], rng.normal(size=(12, 8))
    for i in range(400):
        v = centres[i % 12] + rng.normal(size=8) * 0.05 * (i % 5)
        rows.append((i, v.astype(np.float32).tolist(), int(i % 3)))
    rows += [(400 + i, rows[7][1], 1) for i in range(30)] + [(500, None, 1), (501, [0.0] * 8, 1), (502, [1.0, None] + [0.0] * 6, 1), (503, [float("nan")] * 8, 1), (504, [float("inf")] * 8, 1), (505, [], 1), (506, rows[0][1], None), (507, rows[7][1][:4], 1), (7, rows[7][1], 1)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(3)
    good = [(i, np.array(v, float), l) for i, v, l in rows if v and l is not None and None not in v and np.isfinite(v).all() and np.any(v)]
    links, parent = collections.Counter(), {k: k for k in range(len(good))}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(good)):
        for b in range(a):
            (_, x, l), (_, y, m) = good[a], good[b]
            if l == m and len(x) == len(y) and x @ y / math.sqrt(x @ x) / math.sqrt(y @ y) >= 0.98:
                links[a] += 1
                links[b] += 1
                parent[find(a)] = find(b)
    low = {}
    for k, (i, _, _) in enumerate(good):
        low[find(k)] = min(low.get(find(k), i), i)
    expected = sorted([(i, links[k], low[find(k)], i == low[find(k)]) for k, (i, _, _) in enumerate(good)] + [(i, 0, i, True) for i in (500, 501, 502, 503, 504, 505, 506)])
    for block, per_cell in ((8192, 256), (8, 4)):
        got = sorted(tuple(r) for r in embedding_dedup.linked(table, block=block, per_cell=per_cell).collect())
        assert got == expected
    some = {r.vec_id: r.n_links for r in embedding_dedup.linked(table.where("vec_id < 400"), per_cell=4, recall=0.9).collect()}
    exact = {r.vec_id: r.n_links for r in embedding_dedup.linked(table.where("vec_id < 400"), per_cell=4).collect()}
    assert all(some[i] <= exact[i] for i in exact) and sum(some.values()) >= 0.9 * sum(exact.values())
    odd = table.select(F.col("vec_id").alias("node"), F.col("embedding").alias("v"), F.col("label").alias("l"), F.lit(1).alias("links"))
    assert sorted(tuple(r) for r in embedding_dedup.linked(odd, id_col="node", vector="v", label="l").collect()) == expected
    assert sum(x[1] for x in expected) > 1000
    assert embedding_dedup.linked(table.limit(0)).collect() == []


def _labelled(spark):
    rng = random.Random(2)
    rows, labels = [], []
    for i in range(300):
        bad = i % 4 == 0
        w = words(rng, rng.randrange(5, 60))
        toxic = i % 10 == 5
        w = [*w, *["vile"] * (len(w) // 2 if toxic else 0)]
        rows.append((i, " ".join(x.upper() + "!!" if bad else x for x in w), "en", "s", 1))
        if i % 2 == 0 or i % 5 == 0:
            labels.append((i, 0 if bad else 1, int(toxic)))
    rows += [(1000, None, "en", "s", 0), (1001, "", "en", "s", 0), (None, "w1 w2", None, None, 5), (0, rows[0][1], "en", "s", 1)]
    return spark.createDataFrame(rows, SCHEMA), spark.createDataFrame([*labels, (0, 0, 0), (None, 1, 0), (2, None, None)], "doc_id long, quality int, toxic int")


def test_quality(spark, empty):
    docs, labels = _labelled(spark)
    rows = quality.quality_scores(docs.withColumn("score", docs.lang), labels).collect()
    assert len(rows) == docs.count() and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in rows)
    held = [r for r in rows if r.held_out and r.doc_id is not None and r.doc_id < 300]
    assert len(held) > 40
    assert sum(r.predicted == int(r.doc_id % 4 != 0) for r in held) / len(held) > 0.95
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows if r.doc_id is not None)
    # labels of the held-out fold change nothing
    flipped = labels.withColumn("quality", F.when(quality.held_out(), 1 - labels.quality).otherwise(labels.quality))
    assert {(r.doc_id, r.score) for r in quality.quality_scores(docs, flipped).collect()} == {(r.doc_id, r.score) for r in rows}
    assert quality.quality_scores(empty, labels).collect() == []
    assert all(r.score == 0.5 and not r.trained for r in quality.quality_scores(docs, labels.limit(0)).collect())
    assert all(r.trained for r in rows)
    # other labels than 0 and 1 count as none
    more = labels.unionByName(spark.createDataFrame([(3, 2, 0), (4, -1, 0)], labels.schema))
    assert {(r.doc_id, r.score) for r in quality.quality_scores(docs, more.where("doc_id not in (3, 4)")).collect()} == {(r.doc_id, r.score) for r in quality.quality_scores(docs, labels.where("doc_id not in (3, 4)")).collect()}
    assert not any(r.trained for r in quality.quality_scores(docs, labels.withColumn("quality", F.lit(2))).collect())
    # a very long text beside short ones
    long = docs.limit(2).unionByName(docs.limit(1).withColumn("text", F.expr("repeat('W1!! w2 ', 400000)")))
    assert len(quality.quality_scores(long, labels).collect()) == 3


def test_mixing(spark, empty):
    docs, labels = _labelled(spark)
    targets = {"good": 0.8, "low": 0.15, "toxic": 0.05}
    odd = docs.withColumns({"_mx": F.lit(1), "rate": F.lit("x"), "n": F.lit("kept")})
    rows = mixing.mixed(odd, labels, targets).collect()
    assert len(rows) == docs.count() and all(r.rate >= 0 and r.copies >= 0 and r.n == "kept" for r in rows)
    shares = lambda rows, times: (t := np.sum([np.array(r.posterior) * times(r) * r.n_words for r in rows], 0)) / t.sum()
    assert np.abs(shares(rows, lambda r: r.rate) - np.array([0.8, 0.15, 0.05])).max() < 0.01
    assert np.abs(shares(rows, lambda r: r.copies) - np.array([0.8, 0.15, 0.05])).max() < 0.05  # whole copies
    assert all(abs(r.copies - r.rate) < 1 for r in rows)
    bare = mixing.mixed(odd, labels, targets, keep_text=False)
    assert "text" not in bare.columns and sorted((str(r.doc_id), r.copies) for r in bare.collect()) == sorted((str(r.doc_id), r.copies) for r in rows)
    assert mixing.mixed(empty, labels, targets).collect() == []
    assert mixing.mixed(docs, labels.limit(0), targets).count() == docs.count()
    broken = labels.withColumn("quality", F.lit(7)).withColumn("toxic", F.lit(9))
    assert {tuple(r.posterior) for r in mixing.mixed(docs, broken, targets).collect()} == {(1 / 3, 1 / 3, 1 / 3)}
    long = docs.limit(3).unionByName(docs.limit(1).withColumn("text", F.expr("repeat('a long text ', 300000)")))
    assert max(r.n_words for r in mixing.mixed(long, labels, targets).collect()) == 900_000


def test_thinning_keeps_domains_to_their_share(spark):
    docs, labels = _labelled(spark)
    targets = {"good": 0.9, "low": 0.05, "toxic": 0.05}
    rows = mixing.mixed(docs, labels, targets, thin=True).collect()
    total = np.sum([np.array(r.posterior) * r.rate * r.n_words for r in rows], 0)
    before = np.sum([np.array(r.posterior) * r.n_words for r in rows], 0)
    assert all(0 <= r.rate <= 1 and r.copies in (0, 1) for r in rows)
    assert before[1] / before[0] > 0.06 and before[2] / before[0] > 0.06
    assert total[1] / total[0] == pytest.approx(0.05 / 0.9, rel=0.1) and total[2] / total[0] == pytest.approx(0.05 / 0.9, rel=0.1)
    kept = np.sum([np.array(r.posterior) * r.copies * r.n_words for r in rows], 0)
    assert kept[0] > 0.99 * before[0] and kept[1] / kept[0] < 0.1 and kept[2] / kept[0] < 0.11  # of 75 and 30 documents
    loose = mixing.mixed(docs, labels, {"good": 0.4, "low": 0.3, "toxic": 0.3}, thin=True).collect()
    assert all(r.rate == 1 and r.copies == 1 for r in loose)  # nothing is over its share


def test_fit_matches_a_plain_solver(spark):
    """Dykstra's alternating projections onto the two sets of constraints find the nearest rates too, slowly."""
    rng = np.random.default_rng(1)
    p, n = rng.dirichlet([2, 1, 1], 60), rng.integers(1, 50, 60)
    table = spark.createDataFrame([(int(a), b.tolist()) for a, b in zip(n, p, strict=True)], "n long, p array<double>")
    w = np.array([0.75, 0.2, 0.05])
    u, target, got = mixing.fit_rates(table, w, tolerance=1e-6)
    r = mixing.rates_of(p, u)
    assert (r >= 0).all() and (r == 0).any() and np.allclose((r * n) @ p, got) and np.allclose(got, target, rtol=1e-4)
    a, x, lift = p.T * n, np.ones(60), np.zeros(60)
    step = (p @ np.linalg.inv(a @ p)).T
    for _ in range(20_000):
        y = x + (target - a @ x) @ step
        x, lift = np.maximum(0, y + lift), np.minimum(0, y + lift)
    assert np.allclose(x, r, rtol=1e-3, atol=1e-3)


@pytest.mark.parametrize("alpha", [(0.926, 0.069, 0.005), (30, 0.6, 0.1)])
def test_fit_reaches_the_target_of_a_rare_domain(spark, alpha):
    rng = np.random.default_rng(3)
    p, n = 0.7 * rng.dirichlet(alpha, 20_000) + 0.3 * np.array(alpha) / sum(alpha), rng.integers(1, 400, 20_000)
    table = spark.createDataFrame([(int(a), b.tolist()) for a, b in zip(n, p, strict=True)], "n long, p array<double>")
    w = np.array([0.92, 0.05, 0.03])
    u, target, got = mixing.fit_rates(table, w)
    r = mixing.rates_of(p, u)
    assert (r >= 0).all() and np.allclose((r * n) @ p, got)
    assert np.abs(got - target).sum() <= 2e-3 * target.sum() and np.abs(got / got.sum() - w).max() < 2e-3


def test_fit_tells_of_targets_out_of_reach(spark):
    p = np.array([[0.9, 0.08, 0.02], [0.8, 0.19, 0.01]] * 50)
    table = spark.createDataFrame([(10, b.tolist()) for b in p], "n long, p array<double>")
    with pytest.warns(RuntimeWarning, match="no rates reach"):
        u, target, got = mixing.fit_rates(table, np.array([0.3, 0.1, 0.6]))
    r = mixing.rates_of(p, u)
    assert (r >= 0).all() and np.allclose((10 * r) @ p, got)


def test_labelled_sample_is_bounded_and_passes_over_long_rows(spark):
    rows = [(i, "word " * (40_000 if i % 7 == 0 else 20), "en", "s", 1) for i in range(200)]
    docs = spark.createDataFrame(rows, SCHEMA)
    labels = spark.createDataFrame([(i, int(i % 20 == 1)) for i in range(200)] + [(5, 4), (6, -1), (None, 1)], "doc_id long, label int")
    texts, y = subword.labelled_sample(docs, labels, 1000, max_bytes=100_000, least=5, classes=2)
    assert len(texts) == len(y) == 171 and set(y) == {0, 1} and max(map(len, texts.to_pylist())) == 100
    texts, y = subword.labelled_sample(docs, labels, 20, max_bytes=100_000, least=5, classes=2)
    assert 20 <= len(y) <= 25 and (y == 1).sum() >= 5
    assert len(subword.labelled_sample(docs.limit(0), labels, 20)[1]) == 0


def test_subword_features():
    import pyarrow as pa

    model = subword.train(pa.chunked_array([pa.array(["good text"] * 30 + ["BAD!! TEXT!!"] * 30)]), np.array([1] * 30 + [0] * 30), 2)
    p = model.probabilities(pa.chunked_array([pa.array(["good words", "BAD!! WORDS!!", None, ""])]))
    assert p[0, 1] > 0.6 > 0.4 > p[1, 1] and p[2, 1] == p[3, 1]


def test_training_holds_little_beside_its_texts(monkeypatch):
    """Temporary arrays follow blocks, not the sample; the model doesn't depend on them."""
    import tracemalloc

    import pyarrow as pa

    rng = random.Random(12)
    texts = pa.chunked_array([pa.array([" ".join(words(rng, 400, 5_000)) for _ in range(3_000)])])
    labels = np.array([rng.randrange(2) for _ in range(3_000)])
    tracemalloc.start()
    model = subword.train(texts, labels, 2, epochs=1)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 10 * texts.nbytes
    monkeypatch.setattr(subword, "BLOCK", 5_000), monkeypatch.setattr(subword, "WORDS", 77), monkeypatch.setattr(subword, "TOKENS", 300)
    other = subword.train(texts, labels, 2, epochs=1)
    assert np.array_equal(model.table, other.table) and np.array_equal(model.bias, other.bias)


def test_training_matches_a_plain_trainer():
    """Loops over documents, dictionaries of features and whole numbers give the same model."""
    import pyarrow as pa

    texts = ["good words here", "BAD!! one", "good good", "", "BAD words!! é", "x", "more good text here", "BAD"]
    labels = np.array([1, 0, 1, 1, 0, 0, 1, 0])
    settings = {"dims": 3, "epochs": 3, "rate": 0.5, "batch": 3, "seed": 4}
    model = subword.train(pa.chunked_array([pa.array(texts)]), labels, 2, **settings)
    mask = (1 << 64) - 1

    def mixed_bits(x):
        x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & mask
        x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) & mask
        return x ^ (x >> 31)

    def features(text):
        raw = np.frombuffer(text.encode(), np.uint8)
        found = subword.Words(raw, np.array([0, len(raw)]))
        out = collections.Counter()
        for h, s, e in zip(found.hashes.tolist(), found.starts.tolist(), found.ends.tolist(), strict=True):
            out[h % subword.BUCKETS] += 1
            word = b" " + text.encode()[s:e] + b" "
            for n in (2, 3, 4):
                for i in range(len(word) - n + 1):
                    g = n
                    for c in word[i : i + n]:
                        g = (g * 0x100000001B3 + c) & mask
                    out[mixed_bits(g) % subword.BUCKETS] += 1
        return out

    rng, dims = np.random.default_rng(settings["seed"]), settings["dims"]
    docs = [features(t) for t in texts]
    table = rng.uniform(-1 / dims, 1 / dims, (subword.BUCKETS, dims))
    weight, bias = np.zeros((dims, 2)), np.log(np.bincount(labels) + 1.0)
    bias -= bias.mean()
    g_table, g_weight, g_bias = collections.defaultdict(lambda: 1e-6), np.full((dims, 2), 1e-6), np.full(2, 1e-6)
    mean_of = lambda f: sum((n * table[i] for i, n in f.items()), np.zeros(dims)) / max(1, sum(f.values()))
    for epoch in range(settings["epochs"]):
        step, order = settings["rate"] * (1 - epoch / settings["epochs"]), rng.permutation(len(texts))
        for lo in range(0, len(texts), settings["batch"]):
            batch = order[lo : lo + settings["batch"]]
            grad, d_weight, d_bias = collections.defaultdict(lambda: np.zeros(dims)), np.zeros((dims, 2)), np.zeros(2)
            for d in batch:
                mean = mean_of(docs[d])
                z = mean @ weight + bias
                p = np.exp(z - z.max()) / np.exp(z - z.max()).sum()
                p[labels[d]] -= 1
                d_weight += np.outer(mean, p) / len(batch)
                d_bias += p / len(batch)
                for i, n in docs[d].items():
                    grad[i] += n / sum(docs[d].values()) * (p @ weight.T) / len(batch)
            g_weight += d_weight**2
            g_bias += d_bias**2
            weight -= step * d_weight / np.sqrt(g_weight)
            bias -= 0.1 * step * d_bias / np.sqrt(g_bias)
            for i, g in grad.items():
                g_table[i] += (g**2).mean()
                table[i] -= step * g / np.sqrt(g_table[i])
    got = model.probabilities(pa.chunked_array([pa.array([*texts, "good BAD"])]))
    for d, f in enumerate([*docs, features("good BAD")]):
        z = mean_of(f) @ weight + bias
        assert got[d] == pytest.approx(np.exp(z - z.max()) / np.exp(z - z.max()).sum(), abs=2e-3)
    assert np.ptp(got[:, 1]) > 0.2
