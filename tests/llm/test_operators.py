"""The training-data operators against brute force, on a table with every kind of awkward row."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
import xxhash

from veriplex.llm import automaton, exact, mixing, packing, rules, simhash, suffixes, token_store, topk, warc, windows
from veriplex.llm.common import attach, components, shared_dir
from veriplex.llm.queries import ORACLE_SQL, QUERIES

WORDS = [w + e for w in "the of and tion ouher reand thly ening erst nther oble haing whed stnd".split() for e in ("", "ed", "ly", "s")]
SPACE = re.compile(r"[\x20\x09-\x0D]+")


def prose(seed, n):
    draw = random.Random(seed)
    return " ".join(draw.choice(WORDS) + (f"{draw.randrange(10**6)}" if draw.random() < 0.5 else "") for _ in range(n))


def documents():
    passage = prose("passage", 70)
    long = prose("long", 6000)
    rows = [(i, prose(i, 20 + i * 7 % 120), f"s{i % 4}") for i in range(60)]
    rows += [(100 + i, prose(i, 20 + i * 7 % 120), "hot") for i in range(0, 30, 2)]  # copies
    rows += [(200 + i, prose(i, 20 + i * 7 % 120).replace(" ", "\n ", 3), "hot") for i in range(0, 30, 3)]  # copies but for white space
    rows += [(300 + i, f"{prose(900 + i, 15)} {passage} {prose(800 + i, 12)}", "hot") for i in range(20)]
    rows += [(400, None, "s1"), (401, "", None), (402, " \t\n", "s2"), (403, "one", None), (404, "two words", "s1"), (405, "ß é 中文 \x1c \xa0  end ", "s1"), (None, "no id at all", "s1"),
             (None, prose(4, 48), "s2"), (406, long, "s3"), (407, long + " tail", "s3"), (5, prose(5, 55), "s1"), (5, prose(5, 55), "s1"), (408, passage.upper(), "Z"), (409, "a" * 30000, "Z")]
    return rows


@pytest.fixture(scope="module")
def sf(tmp_path_factory):
    at = tmp_path_factory.mktemp("sf")
    rows = documents()
    n = len(rows)
    pq.write_table(pa.table({"doc_id": pa.array([r[0] for r in rows], pa.int64()), "text": [r[1] for r in rows], "lang": ["en"] * n, "source": [r[2] for r in rows], "n_chars": pa.array([len(r[1] or "") for r in rows], pa.int64()),
                             "keep_id": ["x"] * n, "digest": [1] * n, "component_id": [2.5] * n, "key": [None] * n, "size": ["big"] * n, "bucket": [0] * n}), at / "documents.parquet")
    draw = np.random.default_rng(1)
    vectors = [list(map(float, draw.normal(0, 0.2, 8))) for _ in range(300)]
    vectors[7], vectors[8], vectors[9], vectors[10] = None, [0.1] * 7 + [None], [float("nan")] * 8, [float("inf")] * 8
    for i in range(100, 150):
        vectors[i] = vectors[99]
    vectors[20], vectors[21] = [0.5, 0.5], [0.25, 0.5]
    pq.write_table(pa.table({"vec_id": pa.array([None if i == 3 else i for i in range(300)], pa.int64()), "embedding": pa.array(vectors, pa.list_(pa.float32())), "label": [0] * 300, "score": [1] * 300}), at / "embeddings.parquet")
    html = [f"<p>{prose(i % 7, 40)}</p>" for i in range(40)] + ["short"] * 5 + [None, "", "é" * 60, "é" * 60]
    ids = list(range(len(html)))
    ids[11] = 4
    pq.write_table(pa.table({"page_id": pa.array(ids, pa.int64()), "url": [None if i == 2 else f"http://h/{i}\r\nX: y" for i in range(len(html))], "html": html, "digest": [0] * len(html)}), at / "pages.parquet")
    pq.write_table(pa.table({"doc_id": pa.array([*range(0, 60), None, 999, 3], pa.int64()), "quality": pa.array([*(i % 2 for i in range(60)), 1, 0, None], pa.int32()), "toxic": [0] * 63}), at / "labels.parquet")
    return str(at)


@pytest.fixture(scope="module")
def empty(tmp_path_factory, sf):
    at = tmp_path_factory.mktemp("empty")
    for t in ("documents", "embeddings", "pages", "labels"):
        pq.write_table(pq.read_table(f"{sf}/{t}.parquet").slice(0, 0), at / f"{t}.parquet")
    return str(at)


def run(spark, name, sf):
    return [r.asDict() for r in QUERIES[name](spark, sf).collect()]


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_empty_tables(spark, empty, name):
    assert run(spark, name, empty) == []


def test_op1_round_trip(spark, sf):
    rows = pq.read_table(f"{sf}/pages.parquet").to_pylist()
    got = run(spark, "op1_warc_bundles", sf)
    assert len(got) == len(rows)
    first, seen = {}, Counter()
    for r in rows:
        if len((r["html"] or "").encode()) >= 100:
            first[r["html"]] = min(first.get(r["html"], 10**9), r["page_id"])
    want = Counter()
    for r in rows:
        data = (r["html"] or "").encode()
        leader = first.get(r["html"]) if len(data) >= 100 else None
        again = leader is not None and (leader != r["page_id"] or seen[leader] > 0)
        if leader == r["page_id"]:
            seen[leader] += 1
        want[r["page_id"], len(data), hashlib.sha256(data).hexdigest(), "revisit" if again else "response", leader if again else None] += 1
    assert Counter((g["page_id"], g["payload_bytes"], g["payload_digest"], g["record_type"], g["refers_to"]) for g in got) == want


def test_op1_frames_and_seek_table(spark, sf):
    index = warc.write_archives(spark.read.parquet(f"{sf}/pages.parquet"), frame=2000)
    rows = index.collect()
    assert max(r.frame for r in rows) > 0
    for name in {r.file for r in rows}:
        with open(name.removeprefix("file://"), "rb") as f:
            assert {(r.frame_at, r.frame_bytes, r.frame_size) for r in rows if r.file == name} == set(warc.read_seek_table(f))
    one = warc.read_archives(index.where("record_id = 20")).collect()
    assert len(one) == 1 and "page:20" not in one[0].url and bytes(one[0].payload or b"x")


def test_op2_ids_and_random_access(spark, sf):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(token_store.vocabulary())
    library.encode_special_tokens = True
    rows = sorted(pq.read_table(f"{sf}/documents.parquet").to_pylist(), key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, r["text"] or ""))
    at, want = 0, []
    for r in rows:
        ids = np.array([*library.encode(r["text"] or "", add_special_tokens=False).ids, 0], "<u4")
        want.append((r["doc_id"], at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    assert sorted((g["doc_id"] is not None, g["doc_id"] or 0, g["start"], g["n_tokens"], g["ids_crc32"]) for g in run(spark, "op2_token_store", sf)) == sorted((w[0] is not None, w[0] or 0, *w[1:]) for w in want)
    index = token_store.write_tokens(spark.read.parquet(f"{sf}/documents.parquet"), length=16)
    part = index.where("doc_id = 406").first()
    view = token_store.View(part.file)
    whole = view.ids(part.at, part.n_tokens)
    ids, mask = view.sequence(part.at // 16 + 1)
    assert np.asarray(mask).all() and mask.buffers()[1].address and (ids == whole[16 - part.at % 16:32 - part.at % 16]).all() and whole[-1] == 0


def test_op2_pieces_equal_whole_texts():
    encode = token_store.Encoder(token_store.vocabulary(), 2)
    draw = random.Random(1)
    texts = ["".join(draw.choice("ab  \n\t.,'sé1中²ª’\ue000\r\x0b\x1c\xa0") for _ in range(draw.randint(0, 30))) for _ in range(4000)]
    ids, ends = encode.many(pa.array(texts))
    for text, lo, hi in zip(texts, [0, *ends.tolist()], ends.tolist(), strict=False):
        assert ids[lo:hi].tolist() == [*encode.library.encode(text, add_special_tokens=False).ids, 0]
    again = encode.many(pa.array(texts[::-1] * 2))[0]
    assert again.tolist() == [x for t in texts[::-1] for x in encode(t).tolist()] * 2


def test_op2_memo_keeps_a_bound(monkeypatch):
    monkeypatch.setattr(token_store, "MEMO", 5)
    encode = token_store.Encoder(token_store.vocabulary(), 2)
    texts = [prose(i, 60) for i in range(40)]
    for _ in range(2):
        ids, ends = encode.many(pa.array(texts))
        assert ids.tolist() == [x for t in texts for x in [*encode.library.encode(t, add_special_tokens=False).ids, 0]]
    assert len(encode.pieces.slots) <= 5 and len(encode.parts.slots) <= 5


def test_op3_learns_and_compiles(spark, sf):
    got = run(spark, "op3_quality_classifier", sf)
    assert len(got) == len(documents()) and all(0 <= g["score"] <= 1 and g["predicted"] == int(g["score"] >= 0.3) for g in got)
    assert all(g["held_out"] == (g["doc_id"] is not None and zlib.crc32(str(g["doc_id"]).encode()) % 5 == 0) for g in got)
    draw = np.random.default_rng(2)
    x = draw.random((1500, 5))
    y = ((x[:, 0] > 0.4) & (x[:, 3] <= 0.7)).astype(float)
    model = rules.fit_rules(x[:1000], y[:1000])
    df = spark.createDataFrame(x[1000:].tolist(), ["a", "b", "c", "d", "e"])
    score = np.array([r.s for r in df.select(rules.compile_rules(model, [df[c] for c in "abcde"]).alias("s")).collect()])
    assert ((score >= 0.5) == y[1000:]).mean() > 0.97
    margin = model[0] + sum(w * rules.holds([r], x[1000:])[:, 0] for w, r in model[1])
    assert np.allclose(score, 1 / (1 + np.exp(-margin)))
    assert rules.fit_rules(x, np.ones(1500))[1] == [] and rules.fit_rules(x[:0], y[:0]) == (0.0, [])


def test_op3_ignores_held_out_labels(spark, sf):
    x, y = rules.sample_of(spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet"))
    ids = [i for i in range(60) if zlib.crc32(str(i).encode()) % 5]
    assert len(y) >= len(ids) and len(y) <= len(ids) + 4


def brute_top_k(rows, every, k, scale=256):
    """Results as a multiset; every row (id, vector) whose id ``every`` divides is a query of its own."""
    rows = [(i, [int(np.floor(np.float64(x) * scale)) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    want = Counter()
    for q, a in rows:
        if q % every == 0:
            best = sorted((-sum(x * y for x, y in zip(a, b, strict=True)), c) for c, b in rows if c != q and len(b) == len(a))[:k]
            want.update((q, i + 1, c, -s) for i, (s, c) in enumerate(best))
    return want


def test_op4_against_brute_force(spark, sf):
    rows = [(r["vec_id"], r["embedding"]) for r in pq.read_table(f"{sf}/embeddings.parquet").to_pylist()]
    assert Counter((g["query_id"], g["rank"], g["vec_id"], g["score"]) for g in run(spark, "op4_exact_top_k", sf)) == brute_top_k(rows, 50, 5)


@pytest.mark.parametrize("blocks", [(4096, 256), (7, 3)])
def test_op4_repeats_ties_and_long_vectors(spark, monkeypatch, blocks):
    monkeypatch.setattr(topk, "CANDIDATES", blocks[0])
    monkeypatch.setattr(topk, "QUERIES", blocks[1])
    monkeypatch.setattr(topk, "GROUP", blocks[1])
    draw = np.random.default_rng(4)
    rows = [(i, draw.normal(0, 1, 20).tolist()) for i in range(120)]
    rows += [(50, rows[50][1]), (50, draw.normal(0, 1, 20).tolist()), (7, rows[7][1])]  # repeated queries, the same and another vector; a repeated candidate
    rows += [(200 + i, rows[3][1]) for i in range(12)]  # ties at every place
    rows += [(300, []), (301, []), (350, []), (400, [0.0] * 20), (450, None), (500, [None] * 20), (None, rows[0][1])]
    rows += [(600, [3e6, 1.0, -2e5]), (601, [1.5, 3e6, 7e6]), (602, [2.5, 3e6, 7e6 + 1 / 128]), (603, [1e6, 1e6, 1.0]), (650, [2e6 + 1 / 256, 3e6 + 1 / 256, 1.0])]  # beyond what doubles add up exactly
    df = topk.quantised(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), "vec_id", "embedding")
    got = topk.top_k(df, df.where("id % 50 = 0"), 5).collect()
    assert Counter((g.query_id, g.rank, g.vec_id, g.score) for g in got) == brute_top_k(rows, 50, 5)
    with pytest.raises(Exception, match="64 bits|OverflowError"):
        far = topk.quantised(spark.createDataFrame([(0, [1e30]), (1, [1.0])], "vec_id long, embedding array<double>"), "vec_id", "embedding")
        topk.top_k(far, far, 1).collect()


def test_op4_copies_and_many_partitions(spark, monkeypatch):
    """Neither copies nor partitions multiply what is paired: k + 1 rows a vector, k results a query and part, PARTS parts and the first file."""
    staged: dict[str, list] = {}
    monkeypatch.setattr(topk, "stage", lambda df, name, f=topk.stage: staged.setdefault(name, []).append(f(df, name)) or staged[name][-1])
    monkeypatch.setattr(topk, "PARTS", 4, raising=False)
    draw = np.random.default_rng(5)
    some = draw.normal(0, 1, (70, 9)).tolist()
    rows = [(i, some[i % 10] if i < 400 else some[10 + i % 60]) for i in range(460)] + [(0, some[0]), (3, some[3])]
    usual = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for n, own in ((40, rows), (usual, []), (usual, rows[:1]), (usual, rows[49:52])):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            staged.clear()
            df = topk.quantised(spark.createDataFrame(own, "vec_id long, embedding array<double>"), "vec_id", "embedding")
            got = topk.top_k(df, df.where("id % 50 = 0"), 5).collect()
            assert Counter((g.query_id, g.rank, g.vec_id, g.score) for g in got) == brute_top_k(own, 50, 5)
            if own is rows:
                assert staged["vectors"][0].count() <= 10 * 6 + 60 + 2
                assert sum(x.count() for x in staged["found"]) <= 11 * 5 * 5
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", usual)


def naive_pack(pieces, capacity):
    bins, out = [], []
    for n, source, cluster in pieces:
        fits = [(left, i) for i, (left, s, c) in enumerate(bins) if left >= n and source not in s and cluster not in c]
        i = min(fits)[1] if fits else len(bins)
        if not fits:
            bins.append((capacity, frozenset(), frozenset()))
        left, s, c = bins[i]
        bins[i] = (left - n, s | {source}, c | {cluster})
        out.append(i)
    return out


def test_op5_successor_search():
    draw = random.Random(2)
    for _ in range(40):
        capacity = draw.choice([10, 64, 100])
        pieces = sorted(((draw.randint(1, capacity), draw.choice("aaaaabcdefgh"), draw.choice([0, 0, 0, draw.randint(1, 99)])) for _ in range(draw.randint(0, 300))), key=lambda p: -p[0])
        assert packing.pack(pieces, capacity) == naive_pack(pieces, capacity)


def test_op5_bins(spark, sf):
    rows, got = documents(), run(spark, "op5_best_fit_packing", sf)
    words = Counter()
    for doc_id, text, _ in rows:
        words[doc_id] += len((text or "").encode().split())
    total = Counter()
    for g in got:
        total[g["doc_id"]] += g["n_words"]
    assert total == words and {g["doc_id"] for g in got} == {r[0] for r in rows}
    source = {r[0]: r[2] for r in rows if r[0] is not None}
    bins = {}
    for g in got:
        if g["bin"] is not None:
            bins.setdefault((g["shard"], g["bin"]), []).append(g)
    for own in bins.values():
        assert sum(g["n_words"] for g in own) <= packing.CAPACITY
        named = [source[g["doc_id"]] for g in own if g["doc_id"] is not None]
        assert len(named) == len(set(named))


def test_op5_against_naive_packing(spark, sf):
    rows = [(d, s, len((t or "").encode().split()), SPACE.sub("", t or "")) for d, t, s in documents()]
    rows.sort(key=lambda r: (r[0] is not None, r[0] or 0))
    capacity, want = packing.CAPACITY, []
    for d, _, n, _ in rows:
        want += [((d, i, capacity),) for i in range(n // capacity)]
    rest = sorted((r for r in rows if r[2] % capacity), key=lambda r: -(r[2] % capacity))
    bins = {}
    for (d, _, n, _), b in zip(rest, naive_pack([(n % capacity, s, c) for _, s, n, c in rest], capacity), strict=True):
        bins.setdefault(b, []).append((d, n // capacity, n % capacity))
    plain = lambda own: tuple(sorted(own, key=lambda x: (x[0] is not None, x[0] or 0, *x[1:])))
    want = Counter([*map(plain, want), *map(plain, bins.values())])
    got = {}
    for g in run(spark, "op5_best_fit_packing", sf):
        if g["bin"] is not None:
            got.setdefault((g["shard"], g["bin"]), []).append((g["doc_id"], g["piece"], g["n_words"]))
    assert len({shard for shard, _ in got}) == 1 and Counter(map(plain, got.values())) == want


def slow_print(text, n=3):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    found = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not found:
        return 0
    hashes = [xxhash.xxh64(" ".join(found[i:i + n]).encode(), seed=42).intdigest() for i in range(max(1, len(found) - n + 1))]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def classes(prints, radius=3):
    ids = sorted(prints)
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(ids):
        for b in ids[i + 1:]:
            if (prints[a] ^ prints[b]).bit_count() <= radius:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: find(i) for i in ids}


def test_op6_against_brute_force(spark, sf):
    got = run(spark, "op6_simhash_near_dedup", sf)
    prints = {r[0] if r[0] is not None else 10**9 + i: slow_print(r[1] or "") for i, r in enumerate(documents())}
    want = classes(prints)
    assert len(got) == len(documents())
    for g in got:
        if g["doc_id"] is not None:
            assert int(g["fingerprint"], 16) == prints[g["doc_id"]] and g["component_id"] == want[g["doc_id"]]


def test_op6_links_in_dense_buckets(spark, monkeypatch):
    draw = random.Random(3)
    center = draw.getrandbits(64)
    prints = {center}
    while len(prints) < 150:
        prints.add(center ^ sum(1 << b for b in draw.sample(range(64), draw.randint(1, 5))))
    prints |= {draw.getrandbits(64) for _ in range(100)}
    monkeypatch.setattr(simhash, "BUCKET", 8)
    df = spark.createDataFrame([(simhash._signed(p),) for p in prints], "fp long")
    got = {r.node & 2**64 - 1: r.component & 2**64 - 1 for r in components(simhash.near_links(df)).collect()}
    want = classes({p: p for p in prints})
    groups = {}
    for p in prints:
        groups.setdefault(got.get(p, p), set()).add(p)
    whole = {}
    for p in prints:
        whole.setdefault(want[p], set()).add(p)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, whole.values()))


def shingled(text, n=5):
    found = text.lower().split()
    return {tuple(found[i:i + n]) for i in range(max(1, len(found) - n + 1))}


def test_op6_similar_documents(spark):
    draw = random.Random(8)
    rows, expect = [], []
    for i in range(80):
        base = prose(5000 + i, 220).split(" ")
        rows.append((i, " ".join(base)))
        copy = list(base)
        for at in draw.sample(range(len(copy)), 1 + i % 4):
            copy[at] = f"changed{i}x{at}"
        rows.append((1000 + i, "  ".join(copy).upper() if i % 2 else " ".join(copy)))
        a, b = shingled(rows[-2][1]), shingled(rows[-1][1])
        if len(a & b) / len(a | b) >= 0.8:
            expect.append(i)
    rows += [(3000 + i, None if i else "") for i in range(3)] + [(None, "alone without an id")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in simhash.similar_documents(df).collect() if r.doc_id is not None}
    assert len(expect) > 60 and sum(got[1000 + i] == i for i in expect) >= 0.97 * len(expect)
    assert all(got[i] == i for i in range(80)) and {got[3000 + i] for i in range(3)} == {3000}
    left = simhash.simhash_dedup(df.withColumn("component_id", df.text))
    assert left.columns == ["doc_id", "text", "component_id"] and left.count() <= 80 + 20 + 2


def altered(words, draw, n, tag):
    """A copy with n words changed, none within a shingle of another."""
    out = list(words)
    for i in draw.sample(range(1, len(words) // 10 - 1), n):
        out[10 * i] = f"{tag}x{i}"
    return out


def similarity(a, b):
    a, b = shingled(a), shingled(b)
    return len(a & b) / len(a | b)


def test_op6_similar_on_both_sides_of_the_limit(spark):
    draw = random.Random(12)
    rows, far = [], 0
    for i in range(60):
        base = prose(7000 + i, 450).split(" ")
        rows.append((i, " ".join(base)))
        for j, n in enumerate((6, 9, 11, 13)):  # similarities of 0.87, 0.82, 0.78, 0.75
            rows.append((1000 * (j + 1) + i, " ".join(altered(base, draw, n, f"c{i}v{j}"))))
    template = prose("template", 900).split(" ")  # one group, whose members are not similar to each other
    rows += [(9000 + i, " ".join(altered(template, draw, 15, f"t{i}"))) for i in range(40)]
    # Two that are not similar, and a third between that is similar to both
    left = prose("left", 450).split(" ")
    middle = altered(left, draw, 7, "m")
    right = list(middle)
    for i in range(3, 450, 64):
        right[i + 4] = f"r{i}"
    rows += [(9500, " ".join(left)), (9501, " ".join(right)), (9502, " ".join(middle))]
    assert similarity(rows[-3][1], rows[-2][1]) < 0.8 <= min(similarity(rows[-1][1], rows[-2][1]), similarity(rows[-1][1], rows[-3][1]))
    sets = {i: shingled(t) for i, t in rows}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in sorted(sets):
        for b in sorted(sets):
            if a < b:
                common = len(sets[a] & sets[b])
                far += 0.7 * len(sets[a] | sets[b]) <= common < 0.8 * len(sets[a] | sets[b])
                if 5 * common >= 4 * len(sets[a] | sets[b]):
                    x, y = sorted((find(a), find(b)))
                    root[y] = x
    want = {i: find(i) for i in sets}
    got = {r.doc_id: r.component_id for r in simhash.similar_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert far > 200 and got == want
    assert len(set(want.values())) == 60 * 3 + 40 + 1


def test_op6_similar_texts_of_one_fingerprint(spark):
    def of(text):
        return simhash.sketch(simhash.shingle_hashes(text, 5), simhash.BANDS, simhash.BAND_ROWS)

    # Two texts of one fingerprint, one word apart, and copies that are similar to one of the two only
    rows, want = [], {}
    for i in range(200):
        one = prose(8000 + i, 600).split(" ")
        other = altered(one, random.Random(i), 1, f"o{i}")
        if of(" ".join(one))[0] == of(" ".join(other))[0]:
            for j, (a, b) in enumerate(((one, other), (other, one))):
                new = f"n{i}x{j}"
                at = next(k for k in range(600) if one[k] != other[k])
                places = [k for k in range(5, 590, 10) if abs(k - at) > 12][:13]
                copy = [f"{new}x{k}" if k in places else w for k, w in enumerate(a)]
                while similarity(" ".join(copy), " ".join(b)) >= 0.8:
                    k = next(k for k in range(len(copy) - 1, 0, -1) if copy[k] == a[k] and k > places[-1])
                    copy[k] = f"{new}x{k}"
                assert similarity(" ".join(copy), " ".join(a)) >= 0.8 > similarity(" ".join(copy), " ".join(b))
                rows.append((10 * i + 2 + j, " ".join(copy)))
            rows += [(10 * i, " ".join(one)), (10 * i + 1, " ".join(other))]
            want |= {10 * i + k: 10 * i for k in range(4)}
            if len(rows) == 12:
                break
    assert len(rows) == 12
    got = {r.doc_id: r.component_id for r in simhash.similar_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == want


def test_op6_reached_spans_classes():
    draw = random.Random(9)
    center = draw.getrandbits(64)
    prints = sorted({center ^ sum(1 << b for b in draw.sample(range(64), draw.randint(1, 9))) for _ in range(120)} | {draw.getrandbits(64) for _ in range(40)})
    a, b = simhash.reached(np.array(prints, np.uint64), 6)
    root = simhash._forest(a, b, len(prints))
    want = classes({i: p for i, p in enumerate(prints)}, 6)
    assert root.tolist() == [want[i] for i in range(len(prints))] and len(a) == len(prints) - len(set(want.values()))


def expected_groups(rows):
    groups = {}
    for i, (doc_id, text, _) in enumerate(rows):
        groups.setdefault(SPACE.sub("", text or ""), []).append((-len(text or ""), doc_id is None, doc_id or 0, i))
    return groups


@pytest.mark.parametrize("digest", ["sha256", "crc32"])
def test_op7_groups(spark, sf, digest, monkeypatch):
    rows = documents()
    df = spark.read.parquet(f"{sf}/documents.parquet")
    got = exact.exact_groups(df.select("doc_id", "text"), digest).collect()
    want = Counter()
    for own in expected_groups(rows).values():
        leader = min(own)
        for _, none, doc_id, _ in own:
            want[None if none else doc_id, None if leader[1] else leader[2], len(own)] += 1
    assert Counter((r.doc_id, r.keep_id, r.group_size) for r in got) == want


def test_op7_equal_digests_of_different_bytes(spark):
    # Two strings of one CRC-32.
    a, b = "plumless", "buckeroo"
    assert zlib.crc32(a.encode()) == zlib.crc32(b.encode())
    df = spark.createDataFrame([(1, a), (2, b), (3, a + " "), (4, "else")], "doc_id long, text string")
    got = {r.doc_id: (r.keep_id, r.group_size) for r in exact.exact_groups(df, "crc32").collect()}
    assert got == {1: (3, 2), 2: (2, 1), 3: (3, 2), 4: (4, 1)}


def test_op7_filter_keeps_one_of_each(spark, sf):
    df = spark.read.parquet(f"{sf}/documents.parquet")
    out = exact.exact_dedup(df)
    assert out.columns == df.columns
    left = [SPACE.sub("", r.text or "") for r in out.collect()]
    assert len(left) == len(set(left)) and set(left) == set(expected_groups(documents()))
    assert exact.exact_dedup(df.union(df)).count() == len(left)


def repeats(rows, units, size):
    last = 10**12
    first = {}
    for doc_id, text, _ in rows:
        u = units(text)
        for i in range(len(u) - size + 1):
            k = tuple(u[i:i + size])
            first[k] = min(first.get(k, last), last if doc_id is None else doc_id)
    out = Counter()
    for doc_id, text, _ in rows:
        u = units(text)
        gone = [False] * len(u)
        for i in range(len(u) - size + 1):
            if first[tuple(u[i:i + size])] < (last if doc_id is None else doc_id):
                gone[i:i + size] = [True] * size
        kept = [x for x, g in zip(u, gone, strict=True) if not g]
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        joined = b" ".join(kept) if units is word_units else bytes(kept)
        out[doc_id, len(u), sum(gone), spans, hashlib.sha256(joined).hexdigest()] += 1
    return out


def word_units(text):
    return (text or "").encode().split()


def byte_units(text):
    return (text or "").encode()


def test_op8_against_brute_force(spark, sf):
    want = Counter()
    for (doc_id, n, gone, _, digest), k in repeats(documents(), word_units, 50).items():
        want[doc_id, n, gone, digest] += k
    assert Counter((g["doc_id"], g["n_words"], g["n_removed"], g["kept_sha256"]) for g in run(spark, "op8_substring_dedup", sf)) == want
    texts = automaton.substring_dedup(spark.read.parquet(f"{sf}/documents.parquet"), text=True).where("doc_id = 301").first()
    assert texts.removed and prose(901, 15) in texts.text


def test_op9_against_brute_force(spark, sf):
    got = run(spark, "op9_suffix_array_dedup", sf)
    assert Counter((g["doc_id"], g["n_bytes"], g["n_removed"], g["n_spans"], g["kept_sha256"]) for g in got) == repeats(documents(), byte_units, 50)


def test_windows_of_hot_anchors(spark, sf):
    df = spark.read.parquet(f"{sf}/documents.parquet")
    for hot in (0, 2, 6):
        got = suffixes.suffix_dedup(df, hot=hot).collect()
        assert Counter((g.doc_id, g.n_bytes, g.n_removed, g.n_spans, g.kept_sha256) for g in got) == repeats(documents(), byte_units, 50)
        want = repeats(documents(), word_units, 50)
        got = automaton.substring_dedup(df, hot=hot).collect()
        assert Counter((g.doc_id, g.n_words, g.n_removed, g.kept_sha256) for g in got) == Counter((d, n, x, h) for (d, n, x, _, h), k in want.items() for _ in range(k))


@pytest.mark.parametrize("words", [False, True])
def test_hot_anchors_stage_less_than_the_text(spark, tmp_path, words):
    from pathlib import Path

    passage = " ".join(prose(i, 40) for i in range(1000, 1012))
    rows = [(i, f"{passage[:3000 + i]} end{i}") for i in range(150)]
    root = Path(shared_dir(spark).removeprefix("file://"), "veriplex")
    before = set(root.glob("*"))
    dedup, units = (automaton.substring_dedup, word_units) if words else (suffixes.suffix_dedup, byte_units)
    got = dedup(spark.createDataFrame(rows, "doc_id long, text string"), hot=2).collect()
    want = repeats([(i, text, None) for i, text in rows], units, 50)
    assert Counter((g.doc_id, g.n_words if words else g.n_bytes, g.n_removed, g.kept_sha256) for g in got) == Counter({(d, n, x, h): k for (d, n, x, _, h), k in want.items()})
    staged = sum(f.stat().st_size for at in set(root.glob("*")) - before if not at.name.startswith("kept") for f in at.rglob("*.parquet"))
    assert staged < sum(len(text) for _, text in rows)


@pytest.mark.parametrize("words", [False, True])
def test_hot_stretches_are_joined_once_a_pack(spark, monkeypatch, words):
    passage = " ".join(prose(i, 40) for i in range(1000, 1012))
    rows = [(i, f"{passage[:3000 + i]} end{i}") for i in range(150)]
    joined, attach = [], windows.attach
    monkeypatch.setattr(windows, "attach", lambda rows, *a: (attach(rows, *a), joined.append(rows.count()))[0])
    dedup, units = (automaton.substring_dedup, word_units) if words else (suffixes.suffix_dedup, byte_units)
    monkeypatch.setattr(windows, "SLOT", 50)
    got = dedup(spark.createDataFrame(rows, "doc_id long, text string"), hot=2).collect()
    want = repeats([(i, text, None) for i, text in rows], units, 50)
    assert Counter((g.doc_id, g.n_words if words else g.n_bytes, g.n_removed, g.kept_sha256) for g in got) == Counter({(d, n, x, h): k for (d, n, x, _, h), k in want.items()})
    stretches = sum(len(windows.Texts([text.encode()], words).stretches(50, automaton.GRAM if words else suffixes.GRAM)["hash"]) for _, text in rows)
    assert 0 < sum(joined) < stretches / 3


def test_packs_of_many_buckets_stay_small(spark):
    rows = spark.createDataFrame([(i, prose(i, 150)) for i in range(600)], "doc_id long, text string")
    batch = pa.Table.from_pandas(windows.keyed(rows).toPandas(), preserve_index=False).combine_chunks().to_batches()
    few, many = (sum(len(p) for b in windows._anchors(False, 50, 20, n, 512)(iter(batch)) for p in b.column("packed").to_pylist()) for n in (10, 200))
    assert many < 1.35 * few
    assert {r.key for r in windows.keyed(rows).collect()} == {0} and len({r.key for r in windows.keyed(rows.union(rows.limit(1).selectExpr("doc_id", "'' AS text"))).collect()}) == 601


def test_levels_hold_some_anchors_at_a_time(monkeypatch):
    draw = random.Random(7)
    texts = [bytes(draw.choice((2 * a, 2 * a + 1)) for _ in range(draw.randint(8, 14))) for a in range(20) for _ in range(6)]
    lengths, anchors = np.array([len(t) for t in texts]), np.repeat(np.arange(20), 6)
    ids, data = np.array([draw.randint(0, 9) for _ in texts]), np.frombuffer(b"".join(texts), np.uint8)
    most, add = [], suffixes.Levels.add
    monkeypatch.setattr(suffixes.Levels, "add", lambda self, *a: (out := add(self, *a), most.append(sum(len(x[0]) for x in self.levels)))[0])
    got = suffixes.first_by_levels(data, lengths, lengths - 5, ids, anchors, 6, batch=20)
    assert got.tolist() == [min(int(d) for y, d, b in zip(texts, ids, anchors, strict=True) if a == b and x[i:i + 6] in y) for x, a in zip(texts, anchors, strict=True) for i in range(len(x) - 5)]
    assert max(most) <= suffixes.MOST * 20 + 6 * 15


def test_indexes_of_stretches():
    draw = random.Random(5)
    for _ in range(80):
        texts = [bytes(draw.choice(b"ab") for _ in range(draw.randint(6, 14))) for _ in range(draw.randint(1, 8))]
        ids, size = np.array([draw.randint(0, 5) for _ in texts]), 6
        lengths = np.array([len(t) for t in texts])
        want = [min(int(d) for y, d in zip(texts, ids, strict=True) if x[i:i + size] in y) for x in texts for i in range(len(x) - size + 1)]
        data = np.frombuffer(b"".join(texts), np.uint8)
        assert suffixes.first_by_levels(data, lengths, lengths - size + 1, ids, None, size, batch=20).tolist() == want
        spaced = [b" ".join(bytes([c]) for c in t) for t in texts]
        data = np.frombuffer(b"".join(spaced), np.uint8)
        for shard in (1000, 15, 4):
            assert automaton.first_by_automata(data, np.array([len(t) for t in spaced]), lengths - size + 1, ids, np.zeros(len(texts), int), size, shard).tolist() == want


def test_stretches_cover_every_window_once():
    draw = random.Random(6)
    texts = [bytes(draw.choice(b"abc") for _ in range(draw.randint(0, 400))) for _ in range(30)]
    found = windows.Texts(texts, False).stretches(50, 20)
    starts = [s for a, b in zip(found["first"].tolist(), found["last"].tolist(), strict=True) for s in range(a, b + 1)]
    base = np.cumsum([0] + [len(t) for t in texts])
    assert starts == [base[d] + i for d, t in enumerate(texts) for i in range(len(t) - 49)]


@pytest.mark.parametrize("words", [False, True])
def test_stretches_of_texts_longer_than_a_place(words, monkeypatch):
    passage, sep = prose("far", 40), b" " if words else b""
    texts = [prose(i, n).encode() + sep + passage.encode() + sep + prose(i + 50, 300).encode() for i, n in enumerate((3, 900, 1500))] + [b"aa " * 700, b""]
    window, gram = (30, 5) if words else (50, 20)
    want = windows.Texts(texts, words).stretches(window, gram)
    monkeypatch.setattr(windows, "_PLACE", np.uint64((1 << 7) - 1))
    got = windows.Texts(texts, words).stretches(window, gram)
    assert all(np.array_equal(got[k], want[k]) for k in ("hash", "doc", "first", "last"))
    units = windows.Texts(texts, words).units
    at = np.arange(len(units) - gram + 1)
    hashes = windows.range_hashes(units, at, at + gram) >> np.uint64(24)
    for h, a, b in zip(got["hash"], got["first"], got["last"], strict=True):
        assert all(h >> np.uint64(24) == hashes[s:s + window - gram + 1].min() for s in range(a, b + 1))


def test_op10_meets_targets_and_repeats(spark, sf):
    got = run(spark, "op10_source_mixing", sf)
    assert sorted(map(str, got)) == sorted(map(str, run(spark, "op10_source_mixing", sf)))
    rows = documents()
    sizes = Counter()
    for _, text, source in rows:
        sizes[source] += len(word_units(text))
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    want = dict(zip(order, mixing.targets([sizes[s] for s in order]), strict=True))
    assert abs(sum(want.values()) - 1.5 * sum(sizes.values())) < 1e-6 and all(want[s] <= 2 * sizes[s] + 1e-9 for s in want)
    assert Counter(round(g["target"], 6) for g in got) == Counter(round(want[r[2]], 6) for r in rows)
    assert all(0 <= g["taken"] <= 2 * g["size"] for g in got)
    for goal in set(want.values()):
        if list(want.values()).count(goal) == 1:
            assert abs(sum(g["taken"] for g in got if abs(g["target"] - goal) < 1e-9) - goal) <= 1


def test_op10_slot_by_slot(spark, sf, monkeypatch):
    monkeypatch.setattr(mixing, "CHUNK", 7)
    df = spark.read.parquet(f"{sf}/documents.parquet")
    rows = mixing.placed(df.select("doc_id", "source", "text"))
    slots, sources = mixing.mix_slots(rows, block=64, shard=16)
    names = {r.source_no: r.source for r in sources.collect()}
    words = {}  # per source: the number of the row that each of its words is of
    placed = [r.asDict() for r in rows.collect()]
    for i, r in enumerate(placed):
        words.setdefault(r["source"], {}).update({r["start"] + j: i for j in range(r["size"])})
    assert all(sorted(w) == list(range(len(w))) for w in words.values())  # no gap, no overlap
    taken = Counter()
    for s in slots.collect():
        own = words[names[s.source_no]]
        taken.update(own[s.block * 64 + j] for j in range(s.words))
    want = Counter((r["doc_id"], r["source"], r["start"], taken[i]) for i, r in enumerate(placed) if taken[i])
    got = mixing.pieces(rows, slots, sources, 64).groupBy("doc_id", "source_no", "start").agg({"n": "sum"}).collect()
    assert Counter((g.doc_id, names[g.source_no], g.start, g["sum(n)"]) for g in got) == want
    goals = {r.source: r.target for r in sources.collect()}
    total = Counter()
    for i, n in taken.items():
        total[placed[i]["source"]] += n
    assert all(abs(total[s] - goals[s]) <= 1 for s in goals)


def test_op10_parts():
    for size in (1, 2, 3, 17, 1000):
        assert sorted(mixing.permuted(np.arange(size), size, 99).tolist()) == list(range(size))
    for size, goal, block in ((10, 15.2, 4), (10, 20, 4), (7, 3.4, 7), (100, 199.6, 8), (5, 0, 2), (2048 * 3, 9000, 2048), (6145, 12000, 2048)):
        slots, last = mixing.quota(size, goal, block, 5)
        blocks = -(-size // block)
        n = np.arange(slots)
        at = mixing.permuted(n % blocks, blocks, 5)
        words = [last if i == slots - 1 else min(block, size - b * block) for i, b in enumerate(at.tolist())]
        assert sum(words) == round(goal) and (not slots or 0 < last <= min(block, size - at[-1] * block))
    counts = mixing.shard_counts([1000, 10, 0, 505], 64, 1)
    assert counts.sum(axis=0).tolist() == [1000, 10, 0, 505] and (counts.sum(axis=1)[:-1] == 64).all()


def test_op10_mixed_documents(spark, sf):
    df = spark.read.parquet(f"{sf}/documents.parquet")
    out = mixing.mix_documents(df)
    assert out.columns == df.columns
    words = sum(len(word_units(r.text)) for r in out.collect())
    assert abs(words - 1.5 * sum(len(word_units(t)) for _, t, _ in documents())) <= 6


def test_attach_spreads_hot_keys(spark):
    rows = spark.createDataFrame([("hot" if i % 3 == 0 else f"k{i % 50}" if i % 3 == 1 else None, i) for i in range(900)], "k string, i long")
    groups = rows.where("k is not null").groupBy("k").count().withColumnRenamed("count", "n")
    got = attach(rows, groups, "k", "n", rows["i"]).collect()
    assert len(got) == 900 and {r.n for r in got if r.k == "hot"} == {300} and {r.n for r in got if r.k is None} == {None}


def test_sql_is_of_registered_queries():
    assert set(ORACLE_SQL) <= set(QUERIES) and [n for n in range(1, 11) if not any(q.startswith(f"op{n}_") for q in QUERIES)] == []
