import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from lexarium.llm import exact_cqf as cqf
from lexarium.llm.common import _is_scan, least_rows
from lexarium.llm.common import numbered as numbered_rows
from lexarium.llm import near_copies
from lexarium.llm import simhash_grid as grid


def test_filters_merge_without_loss():
    r = np.random.default_rng(1)
    runs = [r.integers(0, 1 << 54, 400, dtype=np.uint64) for _ in range(5)]
    runs = [np.concatenate((x, runs[0][:50], runs[0][:3], x[:7])) for x in runs]
    made = [cqf.CountingQuotientFilter.of(x, 6, 48) for x in runs]
    assert cqf.CountingQuotientFilter.merged([made[0]], 48).to_bytes() == made[0].to_bytes()
    merged = cqf.CountingQuotientFilter.from_bytes(cqf.CountingQuotientFilter.merged([cqf.CountingQuotientFilter.from_bytes(m.to_bytes()) for m in made], 48).to_bytes())
    q, rem, n = merged.entries()
    found = dict(zip((q.astype(np.uint64) << np.uint64(48) | rem).tolist(), n.tolist()))
    assert found == dict(Counter(x for run in runs for x in run.tolist()))
    assert list(found) == sorted(found)


def test_repeated_fingerprints(spark):
    fps = [1, -1, -1, 5, 5, 5, 2**62, -(2**63), -(2**63)]
    df = spark.createDataFrame([(x,) for x in fps], "fp long").repartition(4)
    assert {r["fp"]: r["n"] for r in cqf.repeated_fingerprints(df).collect()} == {-1: 2, 5: 3, -(2**63): 2}


def brute_exact(rows):
    classes = defaultdict(list)
    for k, (doc, text) in enumerate(rows):
        classes[re.sub(r"[\x20\x09-\x0D]", "", text or "")].append((-len(text or ""), doc is None, doc or 0, k))
    out = {}
    for plain, members in classes.items():
        keep = min(members)[2] if not min(members)[1] else None
        out[hashlib.sha256(plain.encode()).hexdigest()] = (keep, len(members), Counter(None if m[1] else m[2] for m in members))
    return out


def check_exact(df, rows):
    found = defaultdict(list)
    for r in cqf.exact_duplicates(df).collect():
        found[r["text_sha256"]].append(r)
    expected = brute_exact(rows)
    assert found.keys() == expected.keys()
    for sha, (keep, size, members) in expected.items():
        assert {r["keep_id"] for r in found[sha]} == {keep} and {r["group_size"] for r in found[sha]} == {size}
        assert Counter(r["doc_id"] for r in found[sha]) == members
        assert [r["doc_id"] for r in found[sha] if r["kept"]] == [keep]


def test_exact_duplicates(numbered, texts):
    check_exact(numbered, list(enumerate(texts)))


def test_exact_awkward(awkward, empty):
    check_exact(awkward, [(r["doc_id"], r["text"]) for r in awkward.collect()])
    assert cqf.exact_duplicates(empty).count() == 0
    left = cqf.drop_exact_duplicates(awkward)
    assert left.columns == awkward.columns
    assert sorted((r["doc_id"] for r in left.collect()), key=str) == [2, 5, 7, 8, None]
    assert cqf.drop_exact_duplicates(empty).count() == 0


def test_exact_decides_by_row(spark, tmp_path):
    """Rows that share a doc_id, or have none, are decided on by their own text."""
    for rows in ([(1, "aaa"), (5, "aaa"), (5, "unique other text")], [(5, "aaa"), (5, "aaa"), (5, "unique other text")], [(None, "aaa b"), (None, "aaab"), (3, "aaab"), (None, "unique other text")]):
        df = spark.createDataFrame([(d, t, k) for k, (d, t) in enumerate(rows)], "doc_id long, text string, row long").repartition(3)
        path = str(tmp_path / f"t{len(list(tmp_path.iterdir()))}")
        df.write.parquet(path)
        for table in (df, spark.read.parquet(path), spark.read.parquet(path).filter("row >= 0")):
            left = cqf.drop_exact_duplicates(table).collect()
            assert len(left) == 2 and left[0].__fields__ == ["doc_id", "text", "row"]
            assert "unique other text" in {r["text"] for r in left}


def test_rows_are_named_by_their_files(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(100).repartition(3).write.parquet(path)
    df = spark.read.parquet(path)
    assert _is_scan(df) and _is_scan(df.filter("id > 3").select("id"))
    assert not any(map(_is_scan, (df.union(df), df.repartition(2), spark.range(3), df.join(df, "id"), df.selectExpr("explode(array(1, 1)) as x", "id"), df.selectExpr("id as _metadata"))))
    named, row = numbered_rows(df, "t")
    assert named.select(row).distinct().count() == 100 and named.join(named.filter("id < 10").select(row), row, "left_anti").count() == 90


def test_near_decides_by_row(spark):
    near = " ".join(f"w{k}" for k in range(400))
    rows = [(5, near + " one"), (5, near + " two"), (5, "something else entirely that stands here once"), (None, near), (None, "and one more that is like nothing else")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    for drop in (grid.drop_near_duplicates, near_copies.drop_near_copies):
        left = [(r["doc_id"], r["text"]) for r in drop(df).collect()]
        assert len(left) == 3 and set(rows[2:3] + rows[4:]) <= set(left) and (None, near) not in left


def test_least_rows(spark):
    """With and without the bound on the hash: the rows that a whole sort gives."""
    order = F.xxhash64("id")
    for total, n in ((0, 5), (3, 5), (10, 1), (5000, 100), (20000, 10), (20000, 0)):
        df = spark.range(total).repartition(3)
        assert [r["id"] for r in least_rows(df, n, order, "id").collect()] == [r["id"] for r in df.orderBy(order, "id").limit(n).collect()]


def test_sizes_follow_the_rows():
    assert cqf.sizes(0, 1) == (4, 16) and cqf.sizes(4 * 10**10, 10**5)[0] == 17
    assert all(4 <= b <= 24 and 16 <= q < 64 for n in (1, 10**3, 10**6, 10**9, 10**12) for b, q in [cqf.sizes(n, 1 + n // 10**6)])


def test_groups_follow_the_rows():
    found = [grid.groups_for(10**k) for k in range(0, 13, 2)]
    assert found == sorted(found) and found[0] == 5 and found[-1] > 6


def test_more_groups_find_the_same_links(spark):
    for groups in (6, 8):
        check_links(spark, random_fingerprints(200, 5), groups=groups)


def brute_fingerprint(text):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or "")) if w]
    if not words:
        return 0
    shingles = [" ".join(words[k : k + 3]) for k in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_fingerprint(texts, spark):
    for text in [*texts[:30], None, "", " ", "ONE", "one Two", "É É É é"]:
        assert grid.fingerprint(text) == brute_fingerprint(text)
    one = spark.createDataFrame([("a b c",)], "t string").select(F.xxhash64("t").alias("h")).first()["h"]
    assert one % (1 << 64) == grid.fingerprint("A b C")


def brute_components(fps):
    u = np.unique(fps)
    near = np.bitwise_count(u[:, None] ^ u[None, :]) <= 3
    label = np.arange(len(u))
    while True:
        new = np.array([label[near[k]].min() for k in range(len(u))])
        if (new == label).all():
            return {int(x): int(l) for x, l in zip(u, label)}
        label = new


def random_fingerprints(n, seed, centres=12):
    r = np.random.default_rng(seed)
    base = r.integers(0, 1 << 64, centres, dtype=np.uint64)
    out = []
    for k in range(n):
        x = int(base[k % centres])
        for _ in range(int(r.integers(0, 7))):
            x ^= 1 << int(r.integers(0, 64))
        out.append(x)
    return np.unique(np.array(out, np.uint64))


def test_bound_is_below_distance():
    r = np.random.default_rng(2)
    a = r.integers(0, 1 << 64, 2000, dtype=np.uint64)
    b = a ^ (np.uint64(1) << r.integers(0, 64, 2000).astype(np.uint64)) ^ (np.uint64(1) << r.integers(0, 64, 2000).astype(np.uint64))
    ua, ub = grid.unary_counts_of(a), grid.unary_counts_of(b)
    assert (np.bitwise_count(ua ^ ub) <= np.bitwise_count(a ^ b)).all()
    masks = np.array([m % (1 << 64) for m in grid.grid_masks()], np.uint64)
    assert len(masks) == 10 and (((ua[:, None] ^ ub[:, None]) & masks) == 0).any(axis=1).all()


def check_links(spark, fps, **how):
    df = spark.createDataFrame([(int(x),) for x in fps.view(np.int64)], "fp long").repartition(3)
    edges = grid.links(df, **how)
    pairs = [(r["a"], r["b"]) for r in edges.collect()]
    assert all(bin((a ^ b) % (1 << 64)).count("1") <= 3 for a, b in pairs)
    roots = {r["node"] % (1 << 64): r["root"] % (1 << 64) for r in grid.components(edges).collect()}
    expected, groups = brute_components(fps), {}
    for x, label in expected.items():
        groups.setdefault(label, set()).add(roots.get(x, x))
    assert all(len(g) == 1 for g in groups.values()) and len(set().union(*groups.values())) == len(groups)


def test_components_with_hubs(spark):
    """Stars, chains and cycles, with hubs broadcast and without: the smallest node that is reachable."""
    r = random.Random(5)
    edges = [(0, k) for k in range(1, 200)] + [(k, 999) for k in range(300, 500)] + [(k, k + 1) for k in range(1000, 1040)] + [(199, 300)]
    edges += [(min(a, b), max(a, b)) for a, b in ((r.randrange(2000, 2300), r.randrange(2000, 2300)) for _ in range(250)) if a != b]
    low = {n: n for e in edges for n in e}
    changed = True
    while changed:
        changed = False
        for a, b in edges:
            m = min(low[a], low[b])
            changed |= low[a] != m or low[b] != m
            low[a] = low[b] = m
    df = spark.createDataFrame(edges, "a long, b long").repartition(3)
    for hub in (5, 512):
        found = {x["node"]: x["root"] for x in grid.components(df, hub=hub).collect()}
        assert {n: found.get(n, n) for n in low} == low


def test_links_and_components(spark):
    check_links(spark, random_fingerprints(400, 3))


def test_cells_in_blocks(spark):
    """A cell limit of a few rows sends every cell through the pairs of blocks."""
    check_links(spark, random_fingerprints(250, 4, centres=2), cell_rows=8)


def test_blocks_are_linear_in_a_dense_cell(spark):
    """A cell whose members all link to its pivots is dealt once, and nobody is left for the second pass; strangers meet every block."""
    members = spark.range(1000).selectExpr("id as key", "7L as cell", "1000L as n")
    first = grid.in_blocks(members, "key", 128)
    assert first.count() < 2 * 1000 and first.groupBy("cell").count().agg({"count": "max"}).first()[0] < 128
    one = spark.range(1000).selectExpr("id as node", "0L as root")
    assert grid.rest_in_blocks(members, one, "key", 128).count() == 0
    two = spark.range(1000).selectExpr("id as node", "if(id < 10, 1L, 0L) as root")
    rest = grid.rest_in_blocks(members, two, "key", 128)
    seen = {}
    for r in rest.collect():
        seen.setdefault(r["cell"], set()).add(r["key"])
    assert rest.count() < 1200 and all(any({a, b} <= cell for cell in seen.values()) for a in range(10) for b in range(1000))


def test_near_duplicates(numbered, texts):
    fps = np.array([brute_fingerprint(t) for t in texts], np.uint64)
    label = brute_components(fps)
    low = {}
    for k, x in enumerate(fps.tolist()):
        low[label[x]] = min(low.get(label[x], k), k)
    for r in grid.near_duplicates(numbered).collect():
        assert r["fp"] % (1 << 64) == fps[r["doc_id"]] and r["component_id"] == low[label[int(fps[r["doc_id"]])]]


def test_near_awkward(awkward, empty):
    found = grid.near_duplicates(awkward).collect()
    assert len(found) == awkward.count()
    blank = {r["doc_id"]: r["component_id"] for r in found if r["fp"] == 0}
    assert blank == {3: 3, 4: 3, 5: 3, None: 3}
    assert grid.near_duplicates(empty).count() == 0
    left = grid.drop_near_duplicates(awkward)
    assert left.columns == awkward.columns and {1, 3, 7, 8} <= {r["doc_id"] for r in left.collect()}


def brute_shingles(text):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or "")) if w]
    return {" ".join(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()


def brute_near(texts):
    """The component of each text under Jaccard similarity 0.8 of five-word shingles."""
    sets = [brute_shingles(t) for t in texts]
    label = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                old, new = max(label[i], label[j]), min(label[i], label[j])
                label = [new if x == old else x for x in label]
    return label


def edited(n=60, seed=6):
    """Texts and copies with some words changed, near and beyond similarity 0.8."""
    r = np.random.default_rng(seed)
    words = [f"w{k}" for k in range(500)]
    out = []
    for k in range(n):
        own = [words[i] for i in r.integers(0, 500, int(r.integers(60, 200)))]
        out.append(" ".join(own))
        for _ in range(k % 4):
            copy = list(own)
            for at in r.integers(0, len(copy), int(r.integers(1, 6))):
                copy[at] = "changed"
            out.append(" ".join(copy))
    return [*out, "one", "ONE", "one two", "", None, " "]


def test_pipeline_drops_near_copies_at_four_fifths(spark):
    texts = edited()
    label = brute_near(texts)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    found = {r["doc_id"]: r["component_id"] for r in near_copies.near_copies(df).collect()}
    assert [found[k] for k in range(len(texts))] == label
    left = corpus_pipeline.near_dedup(spark, df, "")
    assert sorted(r["doc_id"] for r in left.collect()) == sorted(set(label)) and len(set(label)) < len(texts) - 20


def pairs_at_four_fifths(n=1500, seed=7):
    """Pairs of sets at a similarity of just 0.8."""
    r = np.random.default_rng(seed)
    for k in range(n):
        size = (1, 2, 5, 20)[k % 4]
        common = r.integers(0, 1 << 63, 8 * size, np.uint64)
        yield tuple(np.unique(np.append(common, r.integers(0, 1 << 63, size, np.uint64))) for _ in range(2))


def test_simhash_grid_meets_pairs_at_four_fifths():
    """Fingerprints of WORDS words: pairs at 0.8 share a cell and are candidates there; unlike sets are none."""
    for drawn in (4, 6):
        laid = near_copies.grids(drawn)
        lone = []
        for one, other in pairs_at_four_fifths():
            fps = np.stack([near_copies.fingerprint(one), near_copies.fingerprint(other)])
            own = near_copies.cells(fps, laid)
            assert (own[0] == own[1]).any()
            assert len(near_copies.candidate_forest(np.arange(2), fps[:, : near_copies.COMPARED])[0]) == 1
            lone.append(fps[0, : near_copies.COMPARED])
        assert not len(near_copies.candidate_forest(np.arange(len(lone)), np.stack(lone))[0])
    counts = np.array([[bin(int(fps[0][s // 32]) >> 2 * (s % 32) & 3).count("1") for s in segments] for segments in laid.tolist()])
    assert (own[0] == (counts * 3 ** np.arange(drawn)).sum(axis=1) + np.arange(len(laid)) * 3**drawn).all()
    assert near_copies.grids_for(4) < near_copies.grids_for(5) and near_copies.drawn_for(10**5) < near_copies.drawn_for(10**8)


def plain_candidates(fps):
    """The component of each fingerprint, over all pairs that are near in the compared words."""
    label = np.arange(len(fps))
    near = lambda words, most: np.bitwise_count(fps[:, None, :words] ^ fps[None, :, :words]).sum(axis=2, dtype=int) <= most
    linked = near(near_copies.COMPARED, near_copies.DISTANCE) & near(1, near_copies.FIRST_DISTANCE)
    for _ in label:
        label = np.array([label[linked[k]].min() for k in range(len(fps))])
    return label


def test_candidates_come_from_the_simhash_grid(spark):
    """The clusters are those of all near fingerprints, with cells in blocks and without; few shingles are met exactly."""
    r = np.random.default_rng(8)
    sets = []
    for k in range(40):
        own = r.integers(0, 1 << 63, int(r.integers(20, 80)), np.uint64)
        sets += [np.unique(np.append(own[j:], r.integers(0, 1 << 63, j, np.uint64))) for j in range(k % 4 + 1)]
    sets += [sets[0][:n] for n in (3, 4, 5, 6)]
    fps = np.stack([near_copies.fingerprint(x) for x in sets])
    rows = [(k, x.tobytes(), [v - (v >> 63 << 64) for v in near_copies.without_one(s)]) for k, (x, s) in enumerate(zip(fps, sets))]
    df = spark.createDataFrame(rows, "key long, fp binary, few array<long>").repartition(3)
    label = plain_candidates(fps)
    for n in (len(sets) - 3, len(sets) - 2, len(sets) - 1):  # each holds the one before it
        label = np.where((label == label[n]) | (label == label[n - 1]), min(label[n], label[n - 1]), label)
    for grid_rows in (1 << 15, 16):
        roots = {x["node"]: x["root"] for x in grid.components(near_copies.candidates(df, grid_rows=grid_rows)).collect()}
        assert [roots.get(k, k) for k in range(len(sets))] == label.tolist()


def test_texts_of_few_words(spark):
    """One shingle more or less at 0.8, of as few shingles as can be."""
    r = random.Random(4)
    texts = []
    for k in range(60):
        own = [f"x{r.randrange(10**9)}" for _ in range(8 + k % 5)]
        texts += [" ".join(own), " ".join([*own, "more"])]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    found = {x["doc_id"]: x["component_id"] for x in near_copies.near_copies(df).collect()}
    assert [found[k] for k in range(len(texts))] == brute_near(texts)


def test_near_copies_in_blocks(spark):
    """A cell limit of a few rows sends large cells through the pairs of blocks."""
    base = [f"w{k}" for k in range(150)]
    texts = [" ".join([*base[:k], "other", *base[k + 1 :]]) for k in range(5, 145, 7)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r["component_id"] for r in near_copies.near_copies(df, cell_rows=4).collect()} == {0}


def test_near_copies_awkward(spark, awkward, empty):
    found = near_copies.near_copies(awkward).collect()
    assert len(found) == awkward.count()
    assert {r["doc_id"]: r["component_id"] for r in found if r["doc_id"] in (1, 2, 3, 4, 5)} == {1: 1, 2: 1, 3: 3, 4: 3, 5: 3}
    left = near_copies.drop_near_copies(awkward)
    assert left.columns == awkward.columns and {1, 3, 7, 8, None} == {r["doc_id"] for r in left.collect()}
    assert near_copies.drop_near_copies(empty).count() == 0
    twice = spark.createDataFrame([(1, "a b c d e f g"), (2, "A b c d e f g"), (2, "something else that stands here once")], "doc_id long, text string")
    assert sorted(r["text"] for r in near_copies.drop_near_copies(twice).collect()) == ["a b c d e f g", "something else that stands here once"]
