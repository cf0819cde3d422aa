"""Frozen evaluation runs: what must agree before a run goes on, what is complete, and what a container's report shows."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import id_list, unique
from .evaluation import incomplete

#: The files of a run, the key of its ids, and the limits that a container must show.
SELECTION, MANIFEST, SELECTED = "selection.json", "manifest.json", "problem_ids"
MEMORY, PROCESSES, CPUS, USER = 256 << 20, 64, 1_000_000_000, "65534:65534"


def _file(spark: SparkSession, path: str) -> str:
    from ..sources.tables import exists

    if not exists(spark, path):
        raise FileNotFoundError(path)
    return spark.read.text(path, wholetext=True).first()["value"]


def load_frozen(spark: SparkSession, folder: str, expected: dict) -> tuple[DataFrame, dict]:
    """(ord and id of a run's selection, its manifest). The manifest must be what the present settings give; else a run can't go on."""
    manifest = json.loads(_file(spark, f"{folder}/{MANIFEST}"))
    if manifest != expected:
        names = sorted(k for k in {*manifest, *expected} if manifest.get(k, manifest) != expected.get(k, expected))
        raise ValueError(f"the run was frozen with other settings: {names}")
    return selection(spark, folder), manifest


def replay(spark: SparkSession, folder: str, generated: DataFrame, key: str = "problem_id", count: int | None = None) -> tuple[DataFrame, dict]:
    """As `load_frozen` for verification alone: settings may differ, but the selection holds each id once (and `count` of them, if given), and
    the generations are exactly for those."""
    manifest, ids = json.loads(_file(spark, f"{folder}/{MANIFEST}")), unique(selection(spark, folder), "id")
    n = ids.count()
    if count is not None and n != count:
        raise ValueError(f"{n} selected ids, not {count}")
    wrong = incomplete(generated.select(F.col(key).alias("id")), ids, "id").orderBy("status", "id").limit(10).collect()
    if wrong:
        raise ValueError(f"generations don't match the selection: {[(r['status'], r['id']) for r in wrong]}")
    return ids, manifest


def selection(spark: SparkSession, folder: str) -> DataFrame:
    _file(spark, f"{folder}/{SELECTION}")
    rows = spark.read.text(f"{folder}/{SELECTION}", wholetext=True).select(id_list(F.get_json_object("value", f"$.{SELECTED}")).alias("ids"))
    return rows.select(F.posexplode("ids").alias("ord", "id"))


def source_subset(source: DataFrame, selected: DataFrame, key: str) -> DataFrame:
    """The source's rows of the selected keys; an error names the first selected keys that the source hasn't got."""
    missing = selected.select(key).distinct().join(source.select(key), key, "left_anti").orderBy(key).limit(5).collect()
    if missing:
        raise ValueError(f"the source misses selected {key}: {[r[0] for r in missing]}")
    return source.join(selected.select(key).distinct(), key, "left_semi")


def variant_status(selected: DataFrame, generated: DataFrame, verified: DataFrame, variants: list[str], key: str = "problem_id") -> DataFrame:
    """variant, selected, generated, verified (of the selected keys, each once) and status: complete, generated (not all verified) or partial."""
    asked = selected.select(key).distinct()
    all_ = asked.select(key, F.explode(F.array(*map(F.lit, variants))).alias("variant"))
    there = lambda rows, name: rows.select(key, "variant").distinct().withColumn(name, F.lit(True))
    rows = all_.join(there(generated, "g"), [key, "variant"], "left").join(there(verified, "v"), [key, "variant"], "left")
    counts = rows.groupBy("variant").agg(F.count(F.lit(1)).alias("selected"), F.count("g").alias("generated"), F.count_if(F.col("g") & F.col("v")).alias("verified"))
    status = F.when(F.col("verified") == F.col("selected"), "complete").when(F.col("generated") == F.col("selected"), "generated").otherwise("partial")
    return counts.withColumn("status", status)


def container_checks(report: Column) -> Column:
    """Map of check to boolean from a container's inspection (JSON text): whether it runs under the limits that the verifier asks for.

    What the report doesn't say counts as not so.
    """
    at = lambda path: F.get_json_object(report, f"$.{path}")
    listed = lambda path: F.from_json(at(path), "array<string>")
    mounts = F.from_json(at("Mounts"), "array<struct<Destination:string,RW:boolean>>")
    checks = {
        "network_none": at("HostConfig.NetworkMode") == "none",
        "read_only_root": at("HostConfig.ReadonlyRootfs") == "true",
        "cap_drop_all": F.array_contains(listed("HostConfig.CapDrop"), "ALL"),
        "no_new_privileges": F.exists(listed("HostConfig.SecurityOpt"), lambda x: F.startswith(x, F.lit("no-new-privileges"))),
        "pids_limit": at("HostConfig.PidsLimit").try_cast("long") == PROCESSES,
        "memory": at("HostConfig.Memory").try_cast("long") == MEMORY,
        "no_swap": at("HostConfig.MemorySwap").try_cast("long") == MEMORY,
        "one_cpu": at("HostConfig.NanoCpus").try_cast("long") == CPUS,
        "other_user": at("Config.User") == USER,
        "tmpfs_restricted": F.contains(F.get_json_object(report, "$.HostConfig.Tmpfs['/tmp']"), F.lit("noexec")),
        "one_read_only_mount": (F.size(mounts) == 1) & ~F.try_element_at(mounts, F.lit(1))["RW"],
        "digest_pinned": F.regexp_like(at("Config.Image"), F.lit("@sha256:[0-9a-f]{64}$")),
    }
    return F.create_map(*(x for name, ok in checks.items() for x in (F.lit(name), F.coalesce(ok, F.lit(False)))))


def contract_report(reports: DataFrame, key: str, report: str) -> DataFrame:
    """key, check, ok: a row for each check, and one named all_passed."""
    checks = reports.select(key, container_checks(F.col(report)).alias("checks"))
    checks = checks.withColumn("checks", F.map_concat("checks", F.create_map(F.lit("all_passed"), F.forall(F.map_values("checks"), lambda x: x))))
    return checks.select(key, F.explode("checks").alias("check", "ok"))
