"""Learned models by held-out accuracy; joins and searches against brute force."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sluicebox.llm import ann, common, gam, jaccard, mtree, ppm
from sluicebox.llm import queries as q
from sluicebox.llm.common import Scratch, durable


def brute_components(docs: list[tuple[int | None, str | None]], words: int = 5, num: int = 80, den: int = 100) -> dict:
    import re

    low = str.maketrans({chr(i): chr(i + 32) for i in range(65, 91)})
    sets = []
    for _, text in docs:
        w = re.findall(r"[^\x20\x09-\x0d]+", (text or "").translate(low))
        sets.append({tuple(w[k : k + words]) for k in range(max(1, len(w) - words + 1))} if w else set())
    up = list(range(len(docs)))

    def root(i: int) -> int:
        while up[i] != i:
            i = up[i]
        return i

    for a in range(len(docs)):
        for b in range(a):
            x, y = sets[a], sets[b]
            if x and y and den * len(x & y) >= num * len(x | y):
                up[root(a)] = root(b)
    least: dict[int, int] = {}
    for i, (doc, _) in enumerate(docs):
        least[root(i)] = min(least.get(root(i), doc), doc)
    return {doc: (len(sets[i]), least[root(i)]) for i, (doc, _) in enumerate(docs)}


def near_copies(seed: int, families: int, members: int, length: int, edits: int) -> list[tuple[int, str]]:
    rnd = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    docs, n = [], 0
    for _ in range(families):
        base = [rnd.choice(vocabulary) for _ in range(rnd.randrange(1, length))]
        for _ in range(rnd.randrange(1, members)):
            own = list(base)
            for _ in range(rnd.randrange(0, edits)):
                own[rnd.randrange(len(own))] = rnd.choice(vocabulary).upper()
            docs.append((n * 7 % 1009, " ".join(own) + rnd.choice(["", "\n", "  "])))
            n += 1
    return docs


@pytest.mark.parametrize(("seed", "families", "members", "length", "edits"), [(1, 25, 6, 60, 4), (2, 2, 120, 90, 6)])
def test_components_are_those_of_all_pairs(spark, seed, families, members, length, edits):
    docs = [*near_copies(seed, families, members, length, edits), (2000, None), (2001, " \n"), (2002, "one two"), (2003, "ONE two"), (2004, "two one")]
    got = jaccard.JaccardJoin().components(spark.createDataFrame(docs, "doc_id long, text string"))
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got.collect()} == brute_components(docs)


def outlier(words: int, every: int, n: int, first: int) -> list[tuple[int, str]]:
    """Near copies of one text, and one that shares its beginning only."""
    base = [f"v{i}" for i in range(words)]
    return [(first + k, " ".join([*base[: k % every + 3], f"x{k}", *base[k % every + 4 :]])) for k in range(n)] + [(first + n, " ".join(base[: words // 2] + [f"z{i}" for i in range(words)]))]


@pytest.mark.parametrize("limits", [{"SMALL": 2, "FAMILY": 5}, {"SMALL": 2, "SPREAD": 1, "HOT": 1, "HOT_TIMES": 0}, {"SMALL": 3, "HOT": 3, "HOT_TIMES": 0, "SENT_ROWS": 0, "FILTER_TIMES": 1 << 40}, {"LONG": 40, "LONG_WORDS": 7, "SMALL": 2, "FAMILY": 1}])
def test_limits_change_no_links(spark, monkeypatch, limits):
    docs = [*near_copies(7, 6, 20, 50, 4), *outlier(60, 50, 40, 3000), *outlier(30, 20, 9, 4000), (5000, None), (5001, "a"), (5002, "A \t")]
    for name, value in limits.items():
        monkeypatch.setattr(jaccard, name, value)
    rows = spark.createDataFrame([(d, t, "x", 1) for d, t in docs], "doc_id long, text string, cls string, n long").repartition(5)
    got = jaccard.JaccardJoin().components(rows)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got.collect()} == brute_components(docs)


def test_one_that_differs_costs_as_many_comparisons_as_there_are_others(spark):
    """Members of one component aren't compared with each other, nor sent to more than one task."""
    join, n = jaccard.JaccardJoin(), 500
    members = spark.range(n).select(F.lit(1).cast("long").alias("token"), F.lit(0).cast("long").alias("hub"), F.col("id").alias("cls"), F.lit(100 << 24).cast("long").alias("size"), F.when(F.col("id") == 7, 7).otherwise(0).cast("long").alias("comp"))
    classes = spark.range(n).select(F.col("id").alias("cls"), F.lit(bytes(64)).alias("sketch"))
    dealt = join.by_hub(members, classes, Scratch()).groupBy("rest").count().collect()
    assert {r["rest"]: r["count"] for r in dealt} == {True: 6, False: n}  # six blocks meet the one


def test_groups_pass_by_in_batches_of_any_size(spark):
    rng = np.random.default_rng(6)
    token = np.sort(np.repeat(np.arange(60), rng.integers(1, 30, 60)))
    rows = [(int(t), i, 100 << 24) for i, t in enumerate(token)]
    found = []
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        for size in ("1", "3", "1000"):
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
            got = jaccard.JaccardJoin().candidates(spark.createDataFrame(rows, "token long, cls long, size long")).collect()
            found.append((sorted({(r["a"], r["b"]) for r in got if r["token"] is None}), sorted((r["token"], r["a"]) for r in got if r["token"] is not None)))
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    held = {t: [i for i, x in enumerate(token) if x == t] for t in set(token.tolist())}
    assert found[0] == found[1] == found[2]
    assert found[0][0] == sorted((a, b) for g in held.values() if len(g) <= jaccard.SMALL for a in g for b in g if a < b)
    assert found[0][1] == sorted((t, i) for t, g in held.items() if len(g) > jaccard.SMALL for i in g)


def test_long_texts_have_the_same_sets(monkeypatch):
    rnd = random.Random(2)
    texts = ["".join(rnd.choice(["Ab", "cd ", "é", "\t", "x\n", "yz "]) for _ in range(n)) for n in (0, 3, 40, 900, 2500)]
    want = [s.tolist() for s in jaccard.sets(texts)]
    monkeypatch.setattr(jaccard, "LONG", 100)
    monkeypatch.setattr(jaccard, "LONG_WORDS", 13)
    assert [s.tolist() for s in jaccard.sets(texts)] == want


def test_join_of_nothing_and_repeats(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert jaccard.JaccardJoin().components(empty).count() == 0
    twice = spark.createDataFrame([(5, "a b c d e f"), (5, "a b c d e f"), (None, "a b c d e f")], "doc_id long, text string")
    assert [r["component_id"] for r in jaccard.JaccardJoin().components(twice).collect()] == [5, 5, 5]


@pytest.mark.parametrize("n", [1, 2, 3, 4, 5, 6])
def test_join_of_one_short_text(spark, n):
    text = " ".join("abcdef"[:n])
    one = spark.createDataFrame([(8, text)], "doc_id long, text string")
    assert [tuple(r) for r in jaccard.JaccardJoin().components(one).select("doc_id", "n_shingles", "component_id").collect()] == [(8, max(1, n - 4), 8)]
    # The same sets as among other texts.
    assert jaccard.sets([text])[0].tolist() == jaccard.sets(["x y z u v w", text])[1].tolist()


def test_overlap_bound_never_falls_short():
    rng = np.random.default_rng(5)
    for n in (1, 10, 300, 5000, 40000):
        a = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2))
        b = np.unique(np.concatenate([a[: max(1, len(a) // 2)], rng.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)]))
        assert jaccard.overlap_bound(jaccard.sketch(a), jaccard.sketch(b)) >= len(np.intersect1d(a, b))
    crowded = np.arange(1000, dtype=np.uint64)  # all in one range
    assert jaccard.overlap_bound(jaccard.sketch(crowded), jaccard.sketch(crowded)) >= 1000


def test_digests_tell_sets_apart():
    own = np.arange(1, 50, dtype=np.uint64)
    assert len({jaccard.digests(own[:n]) for n in range(50)}) == 50
    assert jaccard.digests(own)[0] != jaccard.digests(own)[1]


def test_chains_connect(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(0, 40)] + [(100, 101), (7, 7)], "a long, b long")
    got = {r["id"]: r["comp"] for r in jaccard.connected(edges, Scratch()).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100}


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>")


def embeddings(n: int, seed: int) -> list[tuple[int, list | None]]:
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 12)).astype("f4")
    x[n // 2 : n // 2 + n // 5] = x[0]  # many alike
    rows: list = [(i, v.tolist()) for i, v in enumerate(x)]
    return [*rows, (n, None), (n + 1, [math.nan] * 12), (n + 2, [1.0, None] + [0.0] * 10), (n + 3, [1.0, 2.0]), (n + 4, [math.inf] * 12), (n + 5, [0.0] * 12)]


def exact(rows, queries, k):
    """(rank, vec_id, score) by query, of all pairs."""
    ids = np.array([i for i, v in rows if v and len(v) == 12 and None not in v and all(map(math.isfinite, v))])
    vec = dict(rows)
    x = np.floor(256 * np.array([vec[i] for i in ids.tolist()], "f4").astype(float))
    out = {}
    for at, i in enumerate(ids.tolist()):
        if queries(i):
            s = x @ x[at]
            s[at] = -np.inf
            out[i] = [(r + 1, int(ids[b]), int(s[b])) for r, b in enumerate(np.lexsort((ids, -s))[: min(k, len(ids) - 1)])]
    return out


@pytest.mark.parametrize(("n", "limits"), [(1500, {}), (1500, {"BLOCK": 4, "GROUPS": 3, "NODE": 4}), (40, {"MAX_CENTRES": 3})])
def test_exact_search_is_brute_force(spark, monkeypatch, n, limits):
    for name, value in limits.items():
        monkeypatch.setattr(mtree, name, value)
    monkeypatch.setattr(mtree.vectors, "PAGE_ROWS", 64)
    rows = embeddings(n, 1)
    got: dict[int, list] = {}
    for r in mtree.top_k(vectors(spark, rows).withColumn("cell", F.lit("x")).withColumn("vec", F.lit(1)).repartition(3), "vec_id % 50 = 0", 5).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    assert {i: sorted(x) for i, x in got.items()} == exact(rows, lambda i: i % 50 == 0, 5)


def test_rows_of_the_search_grow_with_queries(spark, monkeypatch):
    """Not with queries times pages."""
    rows = embeddings(1200, 3)
    seen = []
    best = mtree.vectors.best
    monkeypatch.setattr(mtree.vectors, "best", lambda found, k: (seen.append(found.count()), best(found, k))[1])
    monkeypatch.setattr(mtree, "GROUPS", 2)
    assert mtree.top_k(vectors(spark, rows), "vec_id % 50 = 0", 5).count() == 24 * 5
    assert seen[0] <= 24 * 5 * 2


def test_tree_avoids_distances_where_data_is_clustered():
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(20, 16)) * 500
    x = np.floor(np.concatenate([c + rng.normal(size=(100, 16)) * 10 for c in centres]))
    x[50:80] = x[50]  # alike: their distances are 0 but for rounding
    longest = float((x * x).sum(1).max())
    tree = mtree.MTree(np.arange(len(x)), x, longest)
    asked = np.arange(0, len(x), 40)
    best, best_id, reach = np.full((len(asked), 5), -np.inf), np.full((len(asked), 5), 1 << 62), np.full(len(asked), np.inf)
    assert tree.search(asked, x[asked], best, best_id, reach) < 0.7 * len(asked) * len(x)
    for k, i in enumerate(asked):
        s = x @ x[i]
        s[i] = -np.inf
        top = np.lexsort((np.arange(len(x)), -s))[:5]
        assert best[k].tolist() == s[top].tolist()
        assert best_id[k].tolist() == top.tolist()


@pytest.mark.parametrize("scale", [1.0, 1 << 12, 1 << 22])
def test_ties_are_found_at_any_scale(spark, scale):
    """Rounded distances of equal and of long vectors prune nothing that ties."""
    rng = np.random.default_rng(9)
    base = rng.normal(size=(6, 12))
    rows = [(i, base[i % 6].tolist()) for i in range(240)]
    x = np.floor(scale * np.array([v for _, v in rows]))
    got = mtree.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), "vec_id % 40 = 0", 7, scale).toPandas()
    for i in range(0, 240, 40):
        s = x @ x[i]
        s[i] = -np.inf
        own = got[got["query_id"] == i].sort_values("rank")
        assert own["vec_id"].tolist() == np.lexsort((np.arange(240), -s))[:7].tolist()
    with pytest.raises(ValueError, match="exact"):
        mtree.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), None, 1, 2.0**30)


def test_repeated_ids_count_once_with_their_least_vector(spark):
    rows = vectors(spark, [(0, [1.0, 0.0]), (1, [0.5, 9.0]), (1, [0.5, 0.5]), (1, [0.75, 0.0]), (2, [0.25, 1.0])]).repartition(4)
    assert [(r["rank"], r["vec_id"], r["score"]) for r in mtree.top_k(rows, "vec_id = 0", 5, 4.0).orderBy("rank").collect()] == [(1, 1, 8), (2, 2, 4)]
    assert [(r["rank"], r["vec_id"], r["score"]) for r in ann.nearest(rows, "vec_id = 0").orderBy("rank").collect()] == [(1, 1, 0.5), (2, 2, 0.25)]
    assert mtree.top_k(rows.filter("vec_id > 9"), None).count() == ann.nearest(rows.filter("vec_id > 9"), None).count() == 0


def test_searches_of_little(spark):
    none = vectors(spark, [(0, None)])
    assert mtree.top_k(none, None).count() == 0
    assert ann.nearest(none, None).count() == 0
    few = vectors(spark, [(0, [1.0, 0.0]), (1, [0.5, 0.5]), (1, [0.5, 0.5]), (2, [0.0, 1.0])])
    assert [(r["rank"], r["vec_id"]) for r in mtree.top_k(few, "vec_id = 0").orderBy("rank").collect()] == [(1, 1), (2, 2)]
    assert [(r["rank"], r["vec_id"], r["score"]) for r in ann.nearest(few, "vec_id = 0").orderBy("rank").collect()] == [(1, 1, 0.5), (2, 2, 0.0)]


@pytest.mark.parametrize("sample_rows", [ann.SAMPLE_ROWS, 12])
def test_answers_have_k_rows(spark, sample_rows):
    x = np.random.default_rng(4).normal(size=(2000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = ann.nearest(rows, "vec_id % 20 = 0", k=20, sample_rows=sample_rows, recall=0.97 if sample_rows > 20 else 0.0).toPandas()
    assert got.groupby("query_id").size().to_dict() == dict.fromkeys(range(0, 2000, 20), 20)
    assert np.allclose(got["score"], (x[got["query_id"]] * x[got["vec_id"]]).sum(1), atol=1e-12)
    assert not (got["query_id"] == got["vec_id"]).any()
    assert not got.duplicated(["query_id", "vec_id"]).any()


def test_answers_have_k_rows_however_few_lists_are_searched(spark, monkeypatch):
    monkeypatch.setattr(ann, "k_means", lambda x, k: x[: min(4, len(x))])
    monkeypatch.setattr(ann, "probes_needed", lambda *_: 1)
    x = np.repeat(np.eye(4), 12, 0) + np.random.default_rng(5).normal(size=(48, 4)) / 50
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = ann.nearest(rows, None, k=20, sample_rows=15).toPandas()
    assert got.groupby("query_id").size().to_dict() == dict.fromkeys(range(48), 20)
    assert ann.nearest(rows, None, k=60, sample_rows=15).count() == 48 * 47


@pytest.mark.parametrize("norm", [0.01, 1, 10, 20, 1000])
def test_copies_are_found_at_any_length_of_vector(norm):
    turn = ann.rotation(64)
    for seed in range(10):
        v = np.random.default_rng(seed).normal(size=(1, 64))
        v *= norm / np.linalg.norm(v)
        copies = np.repeat(v, 300, 0)
        turned = (copies @ turn).astype(np.float32)
        prefix = np.stack([(turned[:, : b + ann.BLOCK] ** 2).sum(1) for b in range(0, 64, ann.BLOCK)], 1)
        reach = np.einsum("ij,ij->i", v, v)
        assert ann.scan(np.array([-1]), v, (v @ turn).astype(np.float32), np.arange(300), copies, turned, prefix, reach, 20)[1].tolist() == list(range(20))


def test_recall_against_brute_force(spark, data):
    rows = q.table(spark, data, "embeddings").toPandas()
    x, ids = np.array(rows["embedding"].tolist(), float), rows["vec_id"].to_numpy()
    got = q.op9_nearest(spark, data).toPandas()
    hit = total = 0
    for i in ids[ids % 20 == 0]:
        s = x @ x[ids == i][0]
        s[ids == i] = -np.inf
        best = ids[np.lexsort((ids, -s))[:20]]
        own = got[got["query_id"] == i].sort_values("rank")
        assert np.allclose(own["score"], [s[ids == v][0] for v in own["vec_id"]], atol=1e-12)
        hit += len(set(best) & set(own["vec_id"]))
        total += len(best)
    assert hit >= 0.9 * total


def test_language_by_held_out_documents(spark, data):
    got = q.op2_language_id(spark, data).toPandas().merge(q.table(spark, data, "documents").select("doc_id", "lang").toPandas(), on="doc_id")
    held = got[got["held_out"]]
    assert len(held) > 20
    assert (held["lang"] == held["lang_pred"]).mean() >= 0.95
    assert got["score"].between(0, 1).all()


def test_code_lengths_are_those_of_plain_matching():
    """Table lookups against a direct restatement of partial matching with exclusion."""
    import collections

    learn = [b"abracadabra abracadabra", b"banana bandana"]
    counts: list = []
    for text in learn:
        data = ppm.PAD + text
        own: dict = collections.defaultdict(collections.Counter)
        for i in range(3, len(data)):
            for order in range(4):
                own[data[i - order : i]][data[i]] += 1
        counts.append(own)

    def bits(own, context, byte):
        total, excluded = 0.0, set()
        for order in (3, 2, 1, 0):
            seen = {b: n for b, n in own.get(context[3 - order :], {}).items() if b not in excluded}
            if not seen:
                continue
            n, d = sum(seen.values()), len(seen)
            if byte in seen:
                return total + math.log2((n + d) / seen[byte])
            total += math.log2((n + d) / d)
            excluded |= set(seen)
        return total + math.log2(256 - len(excluded))

    import pandas as pd

    grams = pd.DataFrame([(lang, (c[0] << 24 | c[1] << 16 | c[2] << 8 | b), n) for lang, own in zip("xy", counts, strict=True) for c, row in own.items() if len(c) == 3 for b, n in row.items()], columns=["lang", "gram", "n"])
    model = ppm.model_of(grams)
    for text in ("abra", "bandana!", "zzz", "a", "cadabrand ban", "é", "bz az\x00"):
        data = ppm.PAD + text.encode()
        want = [sum(bits(own, data[i - 3 : i], data[i]) for i in range(3, len(data))) for own in counts]
        assert np.allclose(ppm.code_lengths([text], model)[:, 0], want, rtol=1e-5)


def plain_bits(own: dict, data: bytes) -> float:
    """A restatement of partial matching on a dictionary of contexts to counts."""
    total = 0.0
    for i in range(3, len(data)):
        excluded: set[int] = set()
        for order in (3, 2, 1, 0):
            seen = {b: n for b, n in own.get(data[i - order : i], {}).items() if b not in excluded}
            n, d = sum(seen.values()), len(seen)
            if data[i] in seen:
                total += math.log2((n + d) / seen[data[i]])
                break
            total += math.log2((n + d) / d) if d else 0
            excluded |= set(seen)
        else:
            total += math.log2(256 - len(excluded))
    return total


def test_language_query_is_plain_partial_matching(spark, data):
    """The whole query against a restatement: which rows are learned from, every context, every prediction."""
    import collections
    import zlib

    docs = [(r["doc_id"], r["text"], r["lang"]) for r in q.table(spark, data, "documents").collect()]
    trees: dict = collections.defaultdict(lambda: collections.defaultdict(collections.Counter))
    for doc_id, text, lang in docs:
        if text is not None and lang is not None and zlib.crc32(str(doc_id).encode()) % 4 != 2:
            stream = ppm.PAD + text.encode()
            for i in range(3, len(stream)):
                for order in range(4):
                    trees[lang][stream[i - order : i]][stream[i]] += 1
    assert max(len([c for c in tree if len(c) == 3]) for tree in trees.values()) > 1000
    model = ppm.fit(q.table(spark, data, "documents"), use=q.crc_mod(q.F.col("doc_id"), 4) != 2)
    rows = {r["doc_id"]: r for r in q.op2_language_id(spark, data).collect()}
    assert set(rows) == {d for d, _, _ in docs}
    for doc_id, text, _ in docs:
        assert rows[doc_id]["held_out"] == (zlib.crc32(str(doc_id).encode()) % 4 == 2)
        part = (text or "")[:400]
        want = [plain_bits(trees[lang], ppm.PAD + part.encode()) for lang in sorted(trees)]
        assert np.allclose(ppm.code_lengths([part], model)[:, 0], want, rtol=1e-4)
        if text and len(text) <= 400:
            assert rows[doc_id]["lang_pred"] in ("und", sorted(trees)[int(np.argmin(want))])


def test_many_scripts_keep_all_their_contexts(spark):
    """No language loses contexts to another, however many there are; too many are an error."""
    rnd = random.Random(3)
    letters = [chr(c) for c in range(0x400, 0xC00) if chr(c).isalpha()]
    alphabets = {f"l{k:02}": letters[30 * k : 30 * k + 30] for k in range(24)}
    word = lambda a: "".join(rnd.choice(a) for _ in range(rnd.randrange(2, 8)))
    docs = [(i, " ".join(word(a) for _ in range(300 if lang != "l07" else 20)), lang) for i, (lang, a) in enumerate(list(alphabets.items()) * 3)]
    frame = spark.createDataFrame(docs, "doc_id long, text string, lang string")
    model = ppm.fit(frame)
    assert model.bits.shape[1] == len({t for _, text, _ in docs for s in [ppm.PAD + text.encode()] for t in (s[i - 3 : i + 1] for i in range(3, len(s)))})
    asked = spark.createDataFrame([(100 + i, " ".join(word(a) for _ in range(3)), lang, "x") for i, (lang, a) in enumerate(alphabets.items())], "doc_id long, text string, lang string, score string")
    assert all(r["lang"] == r["lang_pred"] for r in ppm.identify(asked, model).collect())
    assert ppm.identify(asked.filter("doc_id < 0"), model).count() == 0
    dirty = spark.range(600).selectExpr("id as doc_id", "'a b' as text", "cast(id as string) as lang")
    with pytest.raises(ValueError, match="values of the language"):
        ppm.fit(dirty)


def test_language_of_a_very_long_text(monkeypatch):
    counts = __import__("pandas").DataFrame([("x", 0x0A0A0A61, 1), ("x", 0x0A0A6162, 5), ("y", 0x0A0A0A62, 1)], columns=["lang", "gram", "n"])
    model = ppm.model_of(counts)
    one, many = ppm.code_lengths(["ab" * 50], model)[:, 0], ppm.code_lengths(["ab" * 1_000_000, "", "a"], model)
    assert many[:, 1].tolist() == [0, 0]
    assert np.allclose(many[:, 0], one * 20_000, rtol=0.02)
    whole = ppm.code_lengths(["ab a" * 30, "é", ""], model)
    monkeypatch.setattr(common, "LONG", 7)
    monkeypatch.setattr(common, "NARROW_SLICE", 7)
    assert np.allclose(ppm.code_lengths(["ab a" * 30, "é", ""], model), whole)


def test_language_of_odd_texts(spark):
    docs = spark.createDataFrame([(i, "the cat sat on the mat", "en") for i in range(5)] + [(9, "der hund und die katze", "de"), (10, None, "en"), (11, "123 !", None), (12, "", "de")], "doc_id long, text string, lang string")
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in ppm.identify(docs, ppm.fit(docs), keep=["doc_id"]).collect()}
    assert got[10] == got[11] == got[12] == ("und", 0.0)
    assert got[9][0] == "de"
    assert got[1][0] == "en"
    nothing = ppm.fit(docs.filter("lang is null"))
    assert {r["lang_pred"] for r in ppm.identify(docs, nothing).collect()} == {"und"}


def test_quality_by_held_out_labels(spark, data):
    got = q.op7_quality(spark, data).toPandas().merge(q.table(spark, data, "labels").toPandas(), on="doc_id")
    rest = got[got["held_out"]]
    good, bad = rest[rest["quality"] == 1]["score"].to_numpy(), rest[rest["quality"] == 0]["score"].to_numpy()
    if len(bad):
        assert (good[:, None] > bad[None]).mean() >= 0.9
    assert ((got["score"] >= 0.3).astype(int) == got["predicted"]).all()


def plain_features(text: str) -> list[float]:
    """A restatement of the classifier's features, one text at a time."""
    import collections

    data, words, lines = text.encode(), text.split(), text.split("\n")
    n, pairs = max(len(words), 1), list(zip(words, words[1:], strict=False))
    if not data:
        return [0.0] * len(gam.FEATURES)
    odd = [b for b in range(33, 127) if not chr(b).isalnum() and chr(b) not in ".,;:'\"?-()"]
    count = lambda some, part=data: sum(b in some for b in part)
    upper, lower, beyond = set(range(65, 91)), set(range(97, 123)), set(range(128, 256))
    letters = max(count(upper) + count(lower) + count(beyond) / 2, 1)
    most = lambda items: max(collections.Counter(items).values(), default=0)
    windows = [data[k : k + gam.WINDOW] for k in range(0, len(data), gam.WINDOW)]
    worst = lambda some: max(count(some, w) / len(w) if len(w) >= gam.WINDOW / 4 else 0 for w in windows)
    value = {
        "log_bytes": math.log1p(len(data)), "upper_share": count(upper) / letters, "digit_share": count(set(range(48, 58))) / len(data), "symbol_share": count(set(odd)) / len(data), "space_share": data.count(b" ") / len(data), "line_share": data.count(b"\n") / len(data),
        "word_length": len(data) / n, "distinct_words": len(set(words)) / n, "top_word": most(words) / n, "repeated_words": sum(a == b for a, b in pairs) / n, "bang_share": data.count(b"!") / len(data), "pipe_share": data.count(b"|") / len(data), "beyond_ascii": count(beyond) / len(data),
        "distinct_lines": len(set(lines)) / len(lines), "window_upper": worst(upper), "window_symbols": worst(set(odd)), "window_letters": letters / len(data), "symbols_per_word": count(set(odd)) / n, "top_pair": most(pairs) / n,
    }
    return [value[f] for f in gam.FEATURES]


def test_quality_query_is_its_model_on_plain_features(spark, data):
    """The whole query restated: which rows are learned from, the features of whole texts, a sum of table entries for each score."""
    import zlib

    held = lambda doc_id: zlib.crc32(str(doc_id).encode()) % 5 == 0
    docs = {r["doc_id"]: r["text"] or "" for r in q.table(spark, data, "documents").collect()}
    labels = {r["doc_id"]: r["quality"] for r in q.table(spark, data, "labels").collect() if r["quality"] in (0, 1)}
    rows = {i: plain_features(t) for i, t in docs.items()}
    used = sorted(i for i in labels if i in docs and not held(i))
    model = gam.train(np.array([rows[i] for i in used]), np.array([labels[i] for i in used], float))
    got = {r["doc_id"]: r for r in q.op7_quality(spark, data).collect()}
    assert set(got) == set(docs)
    for i, own in rows.items():
        total = model.intercept
        bins = [int(np.searchsorted(edges, x, "right")) for edges, x in zip(model.edges, own, strict=True)]
        total += sum(model.tables[k][b] for k, b in enumerate(bins)) + sum(table[bins[a], bins[b]] for (a, b), table in zip(model.pairs, model.pair_tables, strict=True))
        score = 1 / (1 + math.exp(-total))
        assert abs(got[i]["score"] - score) < 1e-6, i
        assert got[i]["predicted"] == int(got[i]["score"] >= 0.3)
        assert got[i]["held_out"] == held(i)


def test_learning_from_repeated_ids_is_bounded_and_fixed(spark):
    text = "some plain words of a text that may be good "
    docs = [(i, text * (1 + i % 3) if i % 2 else "BAD! " * (9 + i % 4)) for i in range(60)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, quality int")
    more = [(4, f"other text number {k}") for k in range(50)] + [(4, None)]
    frame = lambda rows: spark.createDataFrame(rows, "doc_id long, text string")
    models = [gam.fit(frame(rows), labels) for rows in (docs + more, (docs + more)[::-1])]
    assert all(a.tolist() == b.tolist() for a, b in zip(models[0].edges, models[1].edges, strict=True))
    assert models[0].tables.tolist() == models[1].tables.tolist()
    scored = gam.score(frame(docs + more).withColumn("score", F.lit("x")), models[0])
    assert scored.count() == 111
    assert gam.score(frame(docs).filter("doc_id > 99"), models[0]).count() == 0


def test_additive_model_learns_an_interaction():
    rng = np.random.default_rng(0)
    x = rng.uniform(-1, 1, size=(3000, 4))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0)).astype(float)
    model = gam.train(x[:2000], y[:2000], rounds=20, pair_rounds=40, pairs=2)
    assert (0, 1) in [tuple(sorted(p)) for p in model.pairs]
    assert ((model.score(x[2000:]) > 0.5) == y[2000:]).mean() > 0.9


def test_classifier_of_odd_texts(spark):
    docs = spark.createDataFrame([(1, "fine words here"), (2, None), (3, ""), (4, "x" * 50000)], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (1, 0), (7, 0)], "doc_id long, quality int")
    got = gam.score(docs, gam.fit(docs, labels)).collect()
    assert len(got) == 4
    assert all(0 <= r["score"] <= 1 for r in got)
    assert gam.features([]).shape == (0, len(gam.FEATURES))


def test_word_pairs_count_in_texts_of_any_length():
    column = gam.FEATURES.index("top_pair")
    texts = [" ".join(["buy", "now"] * n) for n in (100, 199, 200, 2000)] + ["a b " * 300 + " ".join(map(str, range(600)))]
    for text, value in zip(texts, gam.features(texts)[:, column], strict=True):
        words = text.split()
        pairs = list(zip(words, words[1:], strict=False))
        assert value == max(map(pairs.count, set(pairs))) / len(words)


def test_pipeline_stages(spark, data):
    import corpus_pipeline as p

    docs = q.table(spark, data, "documents")
    columns = docs.columns
    sizes = [docs.count()]
    for name, stage in p.STAGES[:-1]:
        docs = durable(stage(spark, docs, data))
        assert docs.columns == columns, name
        sizes.append(docs.count())
    assert sizes[0] > sizes[1] >= sizes[2] > sizes[3] == sizes[4] > 0
    rows = p.STAGES[-1][1](spark, docs, data).toPandas()
    assert set(rows["doc_id"]) == {r["doc_id"] for r in docs.select("doc_id").collect()}
    assert rows.groupby("sequence_id")["length"].sum().max() <= 1024


@pytest.mark.parametrize("name", sorted(q.oracle_sql()))
def test_same_as_sql(name, spark, data, duck):
    got, want = q.queries()[name](spark, data), duck.sql(q.oracle_sql()[name])
    order = sorted(got.columns)
    assert order == sorted(want.columns)
    rows = lambda columns, found: sorted(tuple(r[columns.index(c)] for c in order) for r in found)
    assert rows(got.columns, got.collect()) == rows(want.columns, want.fetchall())


def test_repeated_ids_with_other_texts_stay(spark):
    import corpus_pipeline as p

    a, b, c = ("".join(f"{x}{i} " for i in range(40)) for x in "abc")
    rows = [(3, a), (5, a), (5, b), (5, b), (7, b), (6, c), (6, c + "end"), (6, "one two"), (8, ""), (8, " "), (8, c), (9, None), (None, a), (None, a)]
    left = p.duplicates(spark, spark.createDataFrame(rows, "doc_id long, text string").repartition(4), "").collect()
    got = sorted(((r["doc_id"] or 0, r["text"]) for r in left), key=str)
    # Of near copies under one id, and of blank texts under one id, either may be the one with the smaller hash.
    near = [x for x in got if x in ((6, c), (6, c + "end"))]
    blank = [x for x in got if x in ((8, ""), (8, " "))]
    assert len(near) == len(blank) == 1
    assert got == sorted([(3, a), (5, b), *near, (6, "one two"), *blank, (9, None), (0, a), (0, a)], key=str)
    again = p.duplicates(spark, spark.createDataFrame(rows[::-1], "doc_id long, text string").repartition(3), "").collect()
    assert sorted(((r["doc_id"] or 0, r["text"]) for r in again), key=str) == got


def test_pipeline_is_its_stages(spark, data):
    import corpus_pipeline as p

    docs = q.table(spark, data, "documents")
    for _, stage in p.STAGES:
        docs = durable(stage(spark, docs, data))
    key = ["doc_id", "piece", "start", "length", "ids_crc32"]
    assert sorted(map(tuple, p.run(spark, data).select(*key).collect())) == sorted(map(tuple, docs.select(*key).collect()))


def test_pipeline_of_odd_rows(spark, data, tmp_path):
    """Null and blank texts, ids that are missing or repeat, missing languages, a very long text: each stage has a result for them."""
    import corpus_pipeline as p

    docs = q.table(spark, data, "documents")
    kinds = dict(docs.dtypes)
    good = max((r for r in docs.filter("lang = 'en'").collect()), key=lambda r: len(set(r["text"].split())) if 900 < len(r["text"]) < 3000 else 0)
    long = " ".join(good["text"] for _ in range(900))
    odd = [(90_001, None, "en"), (90_002, "", "en"), (90_003, " \n", None), (None, good["text"], "en"), (90_004, long, None), (90_005, good["text"] + " one more", None), (90_005, "!" * 5000, "en"), (90_005, good["text"] + " one more", None)]
    rows = [tuple({"doc_id": i, "text": t, "lang": lang, "source": None, "n_chars": len(t or "")}[c] for c in docs.columns) for i, t, lang in odd]
    frame = docs.unionByName(spark.createDataFrame(rows, ", ".join(f"{c} {kinds[c]}" for c in docs.columns)))
    frame.write.parquet(f"{tmp_path}/documents.parquet")
    q.table(spark, data, "labels").write.parquet(f"{tmp_path}/labels.parquet")
    out = p.run(spark, str(tmp_path)).toPandas()
    ends = (out["offset"] + out["length"]).groupby(out["sequence_id"]).max()
    assert (ends == out.groupby("sequence_id")["length"].sum()).all()
    assert ends.max() <= 1024
    kept = set(out["doc_id"].dropna().astype(int))
    assert not kept & {90_001, 90_002, 90_003}  # without a letter no language
    assert len(kept & {r["doc_id"] for r in docs.collect()}) > 20


def test_pipeline_of_an_empty_table(spark, data, tmp_path):
    import corpus_pipeline as p

    q.table(spark, data, "documents").filter("doc_id < 0").write.parquet(f"{tmp_path}/documents.parquet")
    q.table(spark, data, "labels").write.parquet(f"{tmp_path}/labels.parquet")
    assert p.run(spark, str(tmp_path)).count() == 0


def test_stages_keep_odd_columns(spark, data):
    import corpus_pipeline as p

    docs = q.table(spark, data, "documents").selectExpr("*", "doc_id as score", "lang as lang_pred", "'m' as masked", "text as `__text`")
    for _, stage in p.STAGES[:-1]:
        docs = durable(stage(spark, docs, data))
    assert docs.columns[-4:] == ["score", "lang_pred", "masked", "__text"]
    assert docs.count() > 0
