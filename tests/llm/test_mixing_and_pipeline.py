import hashlib
import re

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lexarium.llm import curriculum
from lexarium.llm import queries as llm


def filled(sizes, weights, total, passes):
    """Share by weight, stop at the caps, share the excess again."""
    caps, out, live = [passes * s for s in sizes], [0.0] * len(sizes), set(range(len(sizes)))
    rest = total
    while rest > 1e-9 and live:
        w = sum(weights[k] for k in live)
        give = {k: rest * weights[k] / w for k in live}
        rest = 0.0
        for k, x in give.items():
            out[k] += x
            if out[k] >= caps[k]:
                rest += out[k] - caps[k]
                out[k] = caps[k]
                live.discard(k)
    return out


def sourced(spark, counts):
    rows = [(f"{s}{k}", s, k) for s, n in counts.items() for k in range(n)]
    return spark.createDataFrame([(i, "w " * (1 + 7 * k % 23), s) for i, (_, s, k) in enumerate(rows)], "doc_id long, text string, source string")


@pytest.mark.parametrize("counts", [{"a": 300, "b": 20, "c": 50}, {"a": 5, "b": 400}, {"a": 3, "b": 2, "c": 2, "d": 200}, {"z": 10}])
def test_targets(spark, counts):
    found = curriculum.mix(sourced(spark, counts)).join(sourced(spark, counts).select("doc_id", "source"), "doc_id")
    per = {r["source"]: r for r in found.groupBy("source").agg(F.max("source_size").alias("size"), F.max("target").alias("target"), F.sum("taken").alias("taken"), F.max(F.col("taken") - 2 * F.col("size")).alias("over")).collect()}
    names = sorted(per)
    expected = filled([per[n]["size"] for n in names], [(3, 1, 2)[k % 3] for k in range(len(names))], 1.5 * sum(per[n]["size"] for n in names), 2)
    for name, target in zip(names, expected):
        assert per[name]["target"] == pytest.approx(target) and abs(per[name]["taken"] - target) <= 23 and per[name]["over"] <= 0


def test_running_sums_do_not_depend_on_buckets(spark):
    docs = sourced(spark, {"a": 100, "b": 30})
    few, many = ({r["doc_id"]: r["start"] for r in curriculum.taken(docs, buckets=b).collect()} for b in (1, 4096))
    assert few == many


def test_positions_follow_the_schedule(spark):
    docs = sourced(spark, {"a": 200, "b": 100, "c": 100})
    plan = curriculum.schedule(docs).collect()
    assert all(0 <= r["position"] <= 1 for r in plan) and max(r["copy"] for r in plan) == 1
    early = lambda s: sum(r["size"] for r in plan if r["source"] == s and r["position"] < 0.5) / sum(r["size"] for r in plan if r["source"] == s)
    # the density 1 + s(2t - 1) has (1 - s / 2) / 2 of its mass before one half
    assert early("a") == pytest.approx(0.625, abs=0.03) and early("b") == pytest.approx(0.375, abs=0.03) and early("c") == pytest.approx(0.5, abs=0.03)
    assert [r["position"] for r in plan] == sorted(r["position"] for r in plan)
    assert plan == curriculum.schedule(docs).collect()


def test_mix_awkward(awkward, empty):
    rows = curriculum.mix(awkward).collect()
    assert len(rows) == awkward.count()
    assert sorted(r["size"] for r in rows if r["doc_id"] in (3, 4, 5)) == [0, 0, 0]
    assert curriculum.mix(empty).count() == 0 and curriculum.schedule(empty).count() == 0
    mixed = curriculum.mixed_documents(awkward)
    assert mixed.columns == awkward.columns
    text = "a text without a number to it"
    assert mixed.filter(F.col("text") == text).count() == next(len(r["positions"]) for r in rows if r["doc_id"] is None and r["size"] == 7) > 0


def test_mix_takes_each_row_as_often_as_scheduled(spark):
    """Repeated and null doc_ids: rows are scheduled one by one."""
    docs = spark.createDataFrame([(k % 3 or None, f"{k} " * (1 + k % 5), "ab"[k % 2], k) for k in range(60)], "doc_id long, text string, source string, row_number long").repartition(4)
    rows = curriculum.mix(docs).collect()
    mixed = curriculum.mixed_documents(docs).collect()
    assert len(mixed) == sum(len(r["positions"]) for r in rows)
    assert sum(len(r["text"].split()) for r in mixed) == sum(r["taken"] for r in rows)
    per = {}
    for r in mixed:
        per[r["row_number"]] = per.get(r["row_number"], 0) + 1
    assert len(per) == 60 and max(per.values()) == 2
    first = [r["positions"][0] for r in rows if r["positions"]]
    assert first == sorted(first) and all(0 <= p <= 1 for r in rows for p in r["positions"])


def test_no_words_at_all(spark):
    docs = spark.createDataFrame([(1, "", "a"), (2, None, None)], "doc_id long, text string, source string")
    assert [(r["size"], r["target"], r["taken"]) for r in curriculum.mix(docs).collect()] == [(0, 0.0, 0)] * 2


@pytest.fixture(scope="module")
def small(spark, tmp_path_factory):
    """A folder of tables with toxic documents, exact and near copies."""
    folder = str(tmp_path_factory.mktemp("sf"))
    import random

    r = random.Random(9)
    words = ["".join(r.choice("abcdeilmnorstu") for _ in range(r.randint(2, 8))) for _ in range(800)]
    rows = []
    for k in range(300):
        own = [r.choice(words) for _ in range(r.randint(120, 220))]
        if k % 6 == 0:
            own[r.randrange(len(own))] = r.choice(("idiotic", "moronic"))
        rows.append((k, " ".join(own), "en", f"s{k % 4}", 0))
    clean = [x for x in rows if x[0] % 6]
    rows += [(1000 + k, clean[k][1].replace(" ", "  ", 3), "en", "s0", 0) for k in range(20)]
    long = " ".join(r.choice(words) for _ in range(3000)).split(" ")
    for k in range(3):
        changed = list(long)
        changed[5 + k] = "altered"
        rows.append((2000 + k, " ".join(changed), "en", "s1", 0))
    rows.append((3000, None, None, None, None))
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(k, 1, int(k % 6 == 0)) for k in range(300)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return folder


def plain_exact(rows):
    best = {}
    for r in rows:
        key = re.sub(r"[\x20\x09-\x0D]", "", r["text"] or "")
        rank = (-len(r["text"] or ""), r["doc_id"])
        best[key] = min(best.get(key, rank), rank)
    return sorted(doc_id for _, doc_id in best.values())


def plain_near(rows):
    sets = {}
    for r in rows:
        words = (r["text"] or "").lower().split()
        sets[r["doc_id"]] = {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()
    ids = sorted(sets)
    low = {d: d for d in ids}
    for i, a in enumerate(ids):
        for b in ids[:i]:
            if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                old, new = max(low[a], low[b]), min(low[a], low[b])
                low = {d: new if x == old else x for d, x in low.items()}
    return sorted(set(low.values()))


def plain_mix(rows):
    """The doc_ids in training order: demand is followed word by word along each source's integrated schedule, inverted by bisection."""
    names = sorted({r["source"] for r in rows}, key=lambda s: (s is None, s))
    size = {r["doc_id"]: len((r["text"] or "").split()) for r in rows}
    totals = [sum(size[r["doc_id"]] for r in rows if r["source"] == n) for n in names]
    targets = filled(totals, [(3, 1, 2)[k % 3] for k in range(len(names))], 1.5 * sum(totals), 2)
    out = []
    for k, name in enumerate(names):
        slope = (-0.5, 0.5, 0.0)[k % 3]
        own = sorted((r["doc_id"] for r in rows if r["source"] == name), key=lambda d: int(hashlib.md5(f"17:{d}".encode()).hexdigest()[:12], 16))
        at = 0
        for copy in range(2):
            for d in own:
                middle = at + size[d] / 2
                if middle < targets[k]:
                    low, high = 0.0, 1.0
                    for _ in range(60):
                        t = (low + high) / 2
                        low, high = (t, high) if (1 - slope) * t + slope * t * t < middle / targets[k] else (low, t)
                    out.append((low, d))
                at += size[d]
    return [d for _, d in sorted(out)]


def test_pipeline(spark, small):
    """Every stage against a plain version of it, on what its predecessor kept."""
    docs = spark.read.parquet(f"{small}/documents.parquet")
    columns, rows = docs.columns, docs.collect()
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "exact dedup", "simhash near-dedup", "mixing", "byte-level bpe"]
    toxic = {k for k in range(0, 300, 6)}
    plain = {"toxicity": lambda rows: sorted(r["doc_id"] for r in rows if r["doc_id"] not in toxic), "exact dedup": plain_exact, "simhash near-dedup": plain_near, "mixing": plain_mix}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        made = stage(spark, docs, small)
        found, expected = [r["doc_id"] for r in made.collect()], plain[name](rows)
        docs = corpus_pipeline.written(made, "test")
        assert docs.columns == columns
        kept = docs.collect()
        assert (found if name == "mixing" else sorted(found)) == expected, name
        assert len(set(found)) < len(rows) or name == "mixing"
        rows = kept
    last = corpus_pipeline.STAGES[-1][1](spark, docs, small).collect()
    library = llm.encoder()([r["text"] for r in rows])
    assert sorted((r["doc_id"], r["ids"]) for r in last) == sorted((r["doc_id"], bytearray(ids)) for r, ids in zip(rows, library))
    assert sorted(r["ids_sha256"] for r in corpus_pipeline.run(spark, small).collect()) == sorted(r["ids_sha256"] for r in last)


def test_pipeline_with_awkward_rows(spark, awkward, labels, tmp_path):
    """Null and repeated doc_ids, null and blank texts: no text without a copy is lost on the way."""
    awkward.drop("n_chars").write.parquet(str(tmp_path / "documents.parquet"))
    labels.limit(0).write.parquet(str(tmp_path / "labels.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for _, stage in corpus_pipeline.STAGES[:3]:
        docs = corpus_pipeline.written(stage(spark, docs, str(tmp_path)), "test")
    kept = {re.sub(r"\s", "", r["text"] or "") for r in docs.collect()}
    assert kept == {re.sub(r"\s", "", r["text"] or "") for r in awkward.collect()} and docs.count() == len(kept)
    assert corpus_pipeline.run(spark, str(tmp_path)).count() > 0


def test_queries_have_the_contract_columns(spark, small):
    expected = {
        "op2": "doc_id n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed kept",
        "op3": "doc_id keep_id group_size kept text_sha256",
        "op5": "doc_id n_tokens ids_sha256 decoded_sha256",
        "op7": "doc_id n_words n_base first_word last_word base_labels labels score",
        "op8": "doc_id fingerprint component_id",
        "op9": "doc_id size source_size target taken first_position last_position",
        "op10": "doc_id held_out score predicted",
    }
    for name, query in llm.queries().items():
        if (names := expected.get(name.partition("_")[0])) is not None:
            df = query(spark, small)
            assert set(names.split()) <= set(df.columns)
            if name.startswith("op8"):
                assert all(re.fullmatch("[0-9a-f]{16}", r["fingerprint"]) for r in df.collect())
