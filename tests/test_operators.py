"""Operators on small tables: nulls, ties, empty tables, and what must fail."""

from __future__ import annotations

import hashlib
import math

import pytest
from pyspark.sql import functions as F

from sluicebox.operators import dedup, distill, evaluation, freeze, overlap, runs, sampling, tokens, verify
from sluicebox.sources import settings, tables
from sluicebox.streaming import resume


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def test_stratified_take_is_the_largest_remainder(spark):
    rows = [(i, "ab"[i % 3 == 0], None if i % 5 == 0 else "s") for i in range(53)]
    got = sampling.stratified_take(frame(spark, rows, "id long, a string, b string"), "id", ["a", "b"], 11, 3, "x").orderBy("order_hash").collect()
    groups: dict[str, list[int]] = {}
    for i, a, b in rows:
        groups.setdefault(str((a, b)), []).append(i)
    share = {k: len(v) * 11 / len(rows) for k, v in groups.items()}
    quota = {k: math.floor(v) for k, v in share.items()}
    for k in sorted(groups, key=lambda k: (-(share[k] - quota[k]), k))[: 11 - sum(quota.values())]:
        quota[k] += 1
    order = lambda ids, salt: sorted(ids, key=lambda i: hashlib.sha256(f"3:{salt}:{i}".encode()).digest())
    want = order([i for k, v in groups.items() for i in order(v, f"x:{k}")[: quota[k]]], "x")
    assert [r["id"] for r in got] == want


def test_positions_on_empty_and_tied(spark):
    assert sampling.positions(frame(spark, [], "a long"), ["a"]).count() == 0
    got = sampling.positions(frame(spark, [(1, "x"), (1, "y"), (0, "z")], "a long, b string"), ["a", "b"]).orderBy("ord").collect()
    assert [(r["b"], r["ord"]) for r in got] == [("z", 0), ("x", 1), ("y", 2)]


@pytest.mark.parametrize(("parts", "adaptive"), [(4, "true"), (200, "false")])
def test_positions_are_distinct_when_written(spark, tmp_path, parts, adaptive):
    """Places and counts must come from one run of the range sort: seen in written rows only, and not in small tables."""
    n = 1_000_000
    keep = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    try:
        ids = spark.range(0, n, 1, 7).withColumn("len", F.pmod(F.xxhash64("id"), F.lit(900)))
        made = {
            "one key": sampling.positions(ids, [sampling.hash_order(1, "x", F.col("id")).alias("h")]).select("ord"),
            "two keys": sampling.positions(ids, [(F.col("id") % 3 == 0).alias("a"), F.col("id")]).select("ord"),
            "buckets": tokens.length_buckets(ids, "len", "id", 32).select(F.col("bucket").alias("ord")),
        }
        for name, rows in made.items():
            rows.write.parquet(str(tmp_path / name))
            ords = spark.read.parquet(str(tmp_path / name)).groupBy("ord").count()
            got = ords.agg(F.count(F.lit(1)), F.min("ord"), F.max("ord"), F.min("count"), F.max("count")).first()
            assert tuple(got) == ((n // 32, 0, n // 32 - 1, 32, 32) if name == "buckets" else (n, 0, n - 1, 1, 1)), name
        by_length = tokens.length_buckets(ids, "len", "id", 32).groupBy("bucket").agg(F.min("len").alias("a"), F.max("len").alias("b")).orderBy("bucket").toPandas()
        assert (by_length["b"][:-1].to_numpy() <= by_length["a"][1:].to_numpy()).all()
    finally:
        for k, v in keep.items():
            spark.conf.set(k, v)


def test_samples_by_bucket_and_ids(spark):
    rows = frame(spark, [(i, "ab"[i % 2], "xyz"[i % 3]) for i in range(60)] + [(60, None, "x")], "id long, a string, b string")
    order = lambda a, b: sorted((i for i in range(60) if "ab"[i % 2] == a and "xyz"[i % 3] == b), key=lambda i: hashlib.sha256(f"5:{a}:{b}:{i}".encode()).digest())
    got = sampling.take_per_bucket(rows, ["a", "b"], {("b", "z"): 3, ("a", "x"): 99, ("a", "q"): 2}, "id", 5).collect()
    assert sorted((r["bucket_order"], r["id"]) for r in got) == sorted([(0, i) for i in order("b", "z")[:3]] + [(1, i) for i in order("a", "x")])
    ids = [tuple(r) for r in sampling.stratified_sample_ids(rows, "id", ["a", "b"], 12, 5).orderBy("ord").collect()]
    assert [i for i, _ in ids] == list(range(12))
    assert [x for _, x in ids] == sorted({x for _, x in ids})
    assert sampling.stratified_sample_ids(rows, "id", ["a"], 1000, 5).count() == 61
    assert sampling.smallest_by_hash(rows.withColumn("h", F.sha2(F.col("id").cast("string"), 256)), "a", "h", frame(spark, [("a", 0)], "a string, quota long")).count() == 0


def test_halves_of_pairs_are_swapped(spark):
    rows = frame(spark, [(i, "p" if i < 9 else "q") for i in range(14)], "id long, pair string")
    got = {r["id"]: r["swapped"] for r in evaluation.blind_order(rows, "pair", "id", 3).collect()}
    for pair, ids in (("p", range(9)), ("q", range(9, 14))):
        first = sorted(ids, key=lambda i: hashlib.sha256(f"3:{pair}:{i}".encode()).digest())[: len(ids) // 2]
        assert {i for i in ids if got[i]} == set(first)


def test_curriculum_needs_exact_counts(spark):
    rows = frame(spark, [("easy",), ("easy",), ("hard",)], "s string")
    assert sampling.curriculum(rows, "s", {"easy": 2, "hard": 1}).count() == 3
    with pytest.raises(ValueError, match="stages"):
        sampling.curriculum(rows, "s", {"easy": 3})


def test_splits_cover_and_do_not_leak(spark):
    rows = frame(spark, [(i, "ab"[i % 2]) for i in range(200)], "id long, s string")
    got = sampling.build_splits(rows, "id", ["s"], 1, grpo_train=20, grpo_validation=4).cache()
    by = {s: {r["id"] for r in got.filter(F.col("split") == s).collect()} for s in ("sft_train", "sft_dev", "grpo_train", "grpo_validation")}
    assert len(by["sft_dev"]) == 10
    assert by["sft_train"] | by["sft_dev"] == set(range(200))
    assert not by["sft_train"] & by["sft_dev"]
    assert by["grpo_train"] < by["sft_train"]
    assert by["grpo_validation"] < by["sft_dev"]


def test_latest_and_islands(spark):
    rows = frame(spark, [(1, 1, "a"), (1, 3, "c"), (1, 2, None), (None, 5, "n")], "k long, o long, v string")
    assert {tuple(r) for r in dedup.latest(rows, "k", "o").collect()} == {(1, 3, "c"), (None, 5, "n")}
    flags = frame(spark, [(i, f) for i, f in enumerate([True, True, False, True, True, True])], "o long, f boolean")
    assert [r["streak"] for r in dedup.islands(flags, "o", F.col("f"), []).orderBy("o").collect()] == [1, 2, 0, 1, 2, 3]


def test_label_mask_and_padding(spark):
    rows = frame(spark, [([1, 2], [1, 2, 3]), ([1, 2], [1, 3, 3]), ([1], [1]), (None, [1])], "p array<int>, f array<int>")
    got = [r[0] for r in rows.select(tokens.label_mask(F.col("p"), F.col("f"))).collect()]
    assert got == [[-100, -100, 3], None, None, None]
    padded = tokens.pad_batch(frame(spark, [("a", [1] * 9), ("a", [2]), ("b", [3])], "g string, ids array<int>"), "ids", "g", 0).collect()
    assert sorted(len(r["padded"]) for r in padded) == [8, 16, 16]
    trimmed = frame(spark, [([1, 9, 2],), ([1, 0, 2, 0, 0],), ([0],), ([],)], "ids array<int>").select(tokens.trim_at_end(F.col("ids"), 9, 0)).collect()
    assert [r[0] for r in trimmed] == [[1], [1, 0, 2], [], []]


def test_pairwise_refuses_an_unknown_winner(spark):
    rows = frame(spark, [("p", "a", "b", "c")], "pair string, left string, right string, winner_model string")
    with pytest.raises(Exception, match="unknown winner"):
        evaluation.pairwise(rows).collect()


def test_fatal_rows_raise(spark):
    rows = frame(spark, [("x", "syntax_error"), ("y", None)], "id string, fatal_reason string")
    with pytest.raises(ValueError, match="syntax_error"):
        freeze.raise_if_fatal(rows, "id")
    assert freeze.raise_if_fatal(rows.filter("id = 'y'"), "id").count() == 1


def test_reward_weights_are_checked():
    with pytest.raises(ValueError, match="weights"):
        verify.combined_reward(F.lit(1.0), F.lit(1.0), F.lit(1.0), code_weight=0.9)


def test_each_program_runs_once(spark, tmp_path):
    log = tmp_path / "runs"
    code = f"open({str(log)!r}, 'a').write('x')\nprint(1)"
    rows = frame(spark, [(i, code, '[{"input": "", "output": "1"}]', "standard_input", None) for i in range(20)], "id long, code string, cases string, io_mode string, fn_name string")
    got = verify.verify(rows).cache()
    assert got.filter("pass_rate = 1.0").count() == 20
    assert log.read_text() == "x"


def test_verifier_keeps_state_between_calls_and_stops_at_time():
    counter = "n = 0\ndef f():\n    global n\n    n += 1\n    return n"
    assert verify.verify_code(counter, [{"input_args": [], "expected_output": 1}, {"input_args": [], "expected_output": 2}], fn_name="f").pass_rate == 1.0
    assert verify.verify_code("while 1: pass", [{"input": "", "output": ""}], timeout=1.0).error == "timeout after 1.0s"
    assert verify.verify_code("x", []).unsupported
    assert verify.verify_code("raise SystemExit", [{"input": "", "output": ""}]).error == "no harness output"
    assert verify.verify_code("print(' a')", [{"input": "", "output": "a"}]).pass_rate == 0.0
    assert verify.verify_code("def f(:", [{"input_args": [], "expected_output": 1}], fn_name="f").error.startswith("exec SyntaxError")


def test_sources(spark, tmp_path):
    good, bad = tmp_path / "good.jsonl", tmp_path / "bad.jsonl"
    good.write_text('{"id": "a", "n": 1}\n\n{"id": "b", "n": 2}\n')
    bad.write_text('{"id": "a", "n": 1}\n{"id": "b", "n"')
    schema = "id string, n long"
    assert tables.json_lines(spark, str(good), schema).count() == 2
    assert tables.json_lines(spark, str(bad), schema, strict=False).collect()[0]["id"] == "a"
    with pytest.raises(Exception):  # noqa: B017
        tables.json_lines(spark, str(bad), schema).collect()
    with pytest.raises(FileNotFoundError):
        tables.json_lines(spark, str(tmp_path / "none"), schema)
    assert tables.json_lines(spark, str(tmp_path / "none"), schema, strict=False).count() == 0
    with pytest.raises(ValueError, match="duplicate"):
        tables.canonical(frame(spark, [("a",), ("a",)], "id string"))
    ids = tmp_path / "ids.json"
    tables.write_json({"schema_version": 1, "ids": ["b", "a"]}, str(ids))
    assert [tuple(r) for r in tables.read_ids(spark, str(ids)).collect()] == [(0, "b"), (1, "a")]
    tables.write_json(["c"], str(ids))
    assert [r["id"] for r in tables.read_ids(spark, str(ids)).collect()] == ["c"]


def test_splits_of_files(spark, tmp_path):
    assert tables.split_name(" Validation ") == "test"
    with pytest.raises(ValueError, match="unknown split"):
        tables.split_name("other")
    with pytest.raises(FileNotFoundError):
        tables.parquet_split(spark, str(tmp_path), "train")
    for name in ("train", "test"):
        spark.range(3).coalesce(1).toPandas().to_parquet(tmp_path / f"{name}-0.parquet")
    assert tables.parquet_split(spark, str(tmp_path), "dev").count() == 3


def test_frozen_tables_and_tasks(spark, tmp_path):
    rows = frame(spark, [(1, "a"), (2, "b")], "k long, v string")
    tables.write_exactly_once(rows, str(tmp_path / "t"))
    tables.write_exactly_once(rows, str(tmp_path / "t"))
    with pytest.raises(ValueError, match="differs"):
        tables.write_exactly_once(rows.filter("k = 1"), str(tmp_path / "t"))
    got = tables.inspect_tasks(frame(spark, [("t1", "p"), ("t2", None)], "task_id string, prompt string"), ("task_id", "prompt", "contract"))
    assert got["rows"] == 2
    assert got["offenders"] == [("t1", ["contract"]), ("t2", ["prompt", "contract"])]
    with pytest.raises(ValueError, match="other variants"):
        tables.generations(frame(spark, [("p", "x", "text")], "problem_id string, variant string, text string"), "y")


def test_seeds_and_manifest(spark, tmp_path):
    (tmp_path / "array.json").write_text('[{"train_ID": 1, "category": null}, {"train_ID": 2, "category": "DP"}]')
    assert {(r["train_ID"], r["category"]) for r in tables.seeds(spark, str(tmp_path)).collect()} == {(1, "array"), (2, "dp")}
    row = freeze.manifest(spark.read.format("binaryFile").load(str(tmp_path / "array.json"))).first()
    assert row["sha256"] == hashlib.sha256((tmp_path / "array.json").read_bytes()).hexdigest()


def test_resume_does_nothing_twice(spark, tmp_path):
    source, target = str(tmp_path / "in"), str(tmp_path / "out")
    step = lambda rows: rows
    for rows in ([(1, "a"), (1, "a"), (2, "b")], [(2, "c"), (3, "d")]):
        frame(spark, rows, "k long, v string").write.mode("append").json(source)
        resume.resume(spark, source, "k long, v string", target, str(tmp_path / "c"), "k", step).awaitTermination()
    assert sorted(tuple(r) for r in spark.read.parquet(target).collect()) == [(1, "a"), (2, "b"), (3, "d")]


def test_containers_are_pinned_and_bounded():
    with pytest.raises(ValueError, match="pinned"):
        verify.container("python:3.11")
    line = verify.container("python@sha256:" + "a" * 64)("/tmp/x")
    assert {"--network=none", "--read-only", "--cap-drop=ALL", "--volume=/tmp/x:/job:ro"} <= set(line)


def test_killed_programs_count_as_timed_out():
    killed = lambda folder: ["python3", "-c", "raise SystemExit(137)"]  # noqa: E731, ARG005
    assert verify.verify_code("x", [{"input": "", "output": ""}], command=killed).error.startswith("timeout")


def test_reports_and_fingerprints(spark, tmp_path):
    text = tables.markdown(frame(spark, [("a|b", 1), (None, 2)], "k string, n long"), "T")
    assert text.splitlines() == ["# T", "", "| k | n |", "|-|-|", "| a\\|b | 1 |", "|  | 2 |"]
    with pytest.raises(ValueError, match="report"):
        tables.markdown(spark.range(5), "T", 3)
    (tmp_path / "f").write_bytes(b"x")
    assert tables.fingerprint(spark, [str(tmp_path / "f")]) == hashlib.sha256(hashlib.sha256(b"x").hexdigest().encode()).hexdigest()


def test_contained_texts(spark, monkeypatch):
    docs = frame(spark, [(1, "a big cat sat"), (2, "cat"), (3, None), (4, ""), (5, "x cat cat big")], "doc_id long, text string")
    items = frame(spark, [(10, "cat"), (11, "big cat"), (12, ""), (13, None), (14, "cat"), (15, "dog")], "item_id long, text string")
    want = {(d, i) for d, t in [(1, "a big cat sat"), (2, "cat"), (4, ""), (5, "x cat cat big")] for i, x in [(10, "cat"), (11, "big cat"), (12, ""), (14, "cat"), (15, "dog")] if x in t}
    found = lambda: sorted(map(tuple, overlap.contained(docs, "doc_id", "text", items, "item_id", "text").collect()))
    assert found() == sorted(want)
    monkeypatch.setattr(overlap, "BLOCK_BYTES", 3)
    assert found() == sorted(want)
    assert overlap.contained(docs, "doc_id", "text", items.filter("item_id = 13"), "item_id", "text").count() == 0
    monkeypatch.setattr(overlap, "BLOCKS", 1)
    with pytest.raises(ValueError, match="bytes of items"):
        found()


def test_candidates_are_verified_in_waves(spark, tmp_path):
    log = tmp_path / "runs"
    code = lambda name, value: f"open({str(log)!r}, 'a').write('{name} ')\nprint({value})"
    rows = [(1, 0, code("a0", 0)), (1, 1, code("a1", 1)), (1, 2, code("a2", 1)), (2, 0, code("b0", 1)), (2, 1, code("b1", 1)), *((3, k, code(f"c{k}", 0)) for k in range(5))]
    ranked = frame(spark, [(*r, '[{"input": "", "output": "1"}]', "standard_input", None) for r in rows], "id long, rank int, code string, cases string, io_mode string, fn_name string")
    got = dedup.first_passing(verify.verify_in_waves(ranked, "id"), "id", "rank", "pass_rate")
    assert sorted(map(tuple, got.collect())) == [(1, 1, 2), (2, 0, 1), (3, None, 5)]
    assert sorted(log.read_text().split()) == ["a0", "a1", "b0", "c0", "c1", "c2", "c3", "c4"]
    assert verify.verify_in_waves(ranked.filter("id > 9"), "id").count() == 0


def test_two_ways_of_distillation(spark):
    """What a reference may become, what is kept from earlier rejections, and what isn't run."""
    q, cases = "```", '[{"input": "", "output": "1"}]'
    problems = frame(spark, [(i, r, cases, "standard_input", None, f) for i, (r, f) in enumerate([("print(1)", False), ("print(1)", True), (None, False), ("print(1)", False), ("print(", False), ("print(1)", False)])], "id long, reference string, cases string, io_mode string, fn_name string, force boolean")
    first = frame(spark, [(0, f"x\n{q}python\nprint(1)\n{q}"), (1, "never read"), (3, f"{q}python\nprint(1)\n{q}"), (5, f"{q}python\nprint(2)\n{q}")], "id long, text string")
    second = frame(spark, [(i, f"why\n{q}python\nother\n{q}\n{q}json\n[]\n{q}") for i in (1, 3, 4, 5)], "id long, text string")
    earlier = frame(spark, [(3, "timeout", 0.0, None, None)], "id long, failure_type string, pass_rate double, error string, first_failure string")
    got = {r["id"]: r for r in distill.process(problems, first, second, earlier).collect()}
    assert [got[i]["saved"] for i in range(6)] == [True, True, False, True, False, True]
    assert [got[i]["label_strategy"] for i in range(6)] == ["pedagogical_rewrite", "reference_locked", None, "reference_locked", None, "reference_locked"]
    assert got[2]["failure_type"] == "no_verified_reference"
    assert got[4]["failure_type"] == "recovery_syntax_error"
    assert got[3]["initial_failure"]["failure_type"] == "timeout"  # an earlier rejection goes the second way
    assert got[1]["initial_failure"] is None
    assert got[5]["initial_failure"]["failure_type"] == "wrong_answer"
    assert got[1]["content"].startswith("why")
    assert "other" not in got[1]["content"]
    assert got[1]["content"].endswith(f"print(1)\n{q}")
    assert got[1]["comments_only"] is True
    idle = distill.process(problems, first, second, how=distill.Runs(run=False)).filter("id = 5").first()
    assert (idle["saved"], idle["pass_rate"], idle["label_strategy"]) == (True, 0.0, "pedagogical_rewrite")


def test_runs_must_agree(spark, tmp_path):
    for name, value in (("selection.json", {"problem_ids": ["b", "a"]}), ("manifest.json", {"seed": 1, "k": [2]})):
        tables.write_json(value, str(tmp_path / name))
    ids, manifest = runs.load_frozen(spark, str(tmp_path), {"seed": 1, "k": [2]})
    assert [tuple(r) for r in ids.orderBy("ord").collect()] == [(0, "b"), (1, "a")]
    assert manifest["seed"] == 1
    with pytest.raises(ValueError, match="seed"):
        runs.load_frozen(spark, str(tmp_path), {"seed": 2, "k": [2]})
    with pytest.raises(FileNotFoundError):
        runs.load_frozen(spark, str(tmp_path / "none"), {})
    made = frame(spark, [("a",), ("b",)], "problem_id string")
    assert runs.replay(spark, str(tmp_path), made, count=2)[0].count() == 2
    with pytest.raises(ValueError, match="missing"):
        runs.replay(spark, str(tmp_path), made.filter("problem_id = 'a'"))
    with pytest.raises(ValueError, match="not 515"):
        runs.replay(spark, str(tmp_path), made, count=515)
    with pytest.raises(ValueError, match=r"\['c'\]"):
        runs.source_subset(made, frame(spark, [("a",), ("c",)], "problem_id string"), "problem_id")


def test_keyed_lines_and_imports(spark, tmp_path):
    path = tmp_path / "k.jsonl"
    path.write_text('{"problem_id": "a", "n": 1}\n\n{"problem_id": "b", "n": 2}\n{"problem_id": "a", "n": 3}\n')
    schema = "problem_id string, n long"
    assert sorted(map(tuple, tables.keyed_lines(spark, str(path), schema).collect())) == [("a", 3), ("b", 2)]
    with pytest.raises(ValueError, match="duplicate"):
        tables.keyed_lines(spark, str(path), schema, repeated="error")
    assert tables.keyed_lines(spark, str(tmp_path / "none"), schema).count() == 0
    path.write_text('{"n": 1}\n')
    with pytest.raises(Exception, match="without problem_id"):
        tables.keyed_lines(spark, str(path), schema).collect()
    rows = frame(spark, [("a", " x ", None, "p1"), ("b", "y", "v", "")], "id string, answer string, variant string, protocol_name string")
    answers, protocols = tables.imported_generations(rows, "v")
    assert sorted(map(tuple, answers.collect())) == [("a", "x"), ("b", "y")]
    assert [r[0] for r in protocols.collect()] == ["p1"]
    with pytest.raises(ValueError, match="1 rows of other"):
        tables.imported_generations(rows, "w")


def test_ids_of_any_number_are_lines(spark, tmp_path, monkeypatch):
    ids = frame(spark, [("a", 0, "x"), ("a", 1, "y"), ("b", 0, "z")], "split string, ord long, id string")
    monkeypatch.setattr(tables, "ID_FILE_ROWS", 1)
    with pytest.raises(ValueError, match="id_lines"):
        tables.id_file(ids, 1, "p")
    tables.id_lines(ids.filter("split = 'a'"), 1, "p").select("value").write.text(str(tmp_path / "a"))
    assert sorted(map(tuple, tables.read_id_lines(spark, str(tmp_path / "a")).collect())) == [(0, "x"), (1, "y")]
    tables.id_lines(ids.filter("split = 'a'"), 1, "p").filter("ord <> 1").select("value").write.text(str(tmp_path / "b"))
    with pytest.raises(ValueError, match="1 ids where 2"):
        tables.read_id_lines(spark, str(tmp_path / "b"))


def test_prompts_name_what_they_lack(spark):
    assert spark.range(1).select(distill.render("a {{x}} {y}!", y=F.lit(None).cast("string"))).first()[0] == "a {x} !"
    for template, parts in (("{a}", {}), ("a", {"b": F.lit(1)}), ("{a:>3}", {"a": F.lit(1)})):
        with pytest.raises(ValueError, match="template"):
            distill.render(template, **parts)


def test_settings_have_a_known_form(tmp_path, monkeypatch):
    tables.write_json({"schema_version": "v2", "stage": "sft"}, str(tmp_path / "a.json"))
    assert settings.for_stage(settings.load(str(tmp_path / "a.json")), "sft", "v2")["stage"] == "sft"
    with pytest.raises(ValueError, match="stage"):
        settings.for_stage({"schema_version": "v2", "stage": "x"}, "sft", "v2")
    good = dict.fromkeys(settings.JUDGED, 1) | {"criteria": {f"c{k}": {"weight": 0.2} for k in range(5)}, "generation_config": {"max_new_tokens": 5, "batch_size": 1}}
    assert settings.for_judges(good) is good
    for change, said in (({"criteria": {"a": {"weight": 1}}}, "1 criteria"), ({"generation_config": {"max_new_tokens": 5, "batch_size": 0}}, "batch_size"), ({"generation_config": {"do_sample": True, "max_new_tokens": 5, "batch_size": 1}}, "temperature")):
        with pytest.raises(ValueError, match=said):
            settings.for_judges(good | change)
    monkeypatch.setenv("SLUICEBOX_TEST_B", "x")
    assert settings.first_set(["SLUICEBOX_TEST_A", "SLUICEBOX_TEST_B"]) == "x"
    assert settings.first_set("SLUICEBOX_TEST_A") is None
    assert [settings.mirrored("https://a/b", m) for m in (" ", "https://m/")] == ["https://a/b", "https://m/https://a/b"]


def test_retries_wait_longer_and_stop_at_what_is_fatal():
    waited, calls = [], []

    def step():
        calls.append(1)
        if len(calls) < 3:
            raise OSError("busy")
        return "done"

    assert settings.retried(step, 4, lambda e: False, waited.append) == "done"
    assert waited == [1.0, 2.0]
    calls.clear()
    with pytest.raises(OSError, match="busy"):
        settings.retried(step, 4, lambda e: True, waited.append)
    assert len(calls) == 1


def test_command_line_lists_queries(capsys):
    from sluicebox.__main__ import main

    assert main([]) == 0
    assert "stable_order" in capsys.readouterr().out
    assert main(["no such query", "x"]) == 2
