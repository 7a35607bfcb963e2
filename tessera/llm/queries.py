"""The queries of this subpackage and their SQL, for the driver's registry."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .adaptive_rules import FACTS, judged, rules_sql
from .brown import score_documents
from .cotraining import score_quality
from .decontaminate import contaminated_pairs, contaminated_sql
from .filter_audit import audit_sql, filter_interactions
from .licence_scan import scan_licences, scan_sql
from .near_dup import near_duplicate_classes
from .neighbours import nearest
from .packing import pack_documents
from .periodic_runs import periodic_runs, run_report, with_repeated_tails
from .sharding import shard_documents
from .store import load
from .substring_dedup import dedup_report, dedup_sql
from .toxicity import score_toxicity


def op1_toxicity_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_toxicity(load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels"))


def op2_ring_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(load(spark, sf_dir, "documents"))


def op3_swap_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(load(spark, sf_dir, "documents"))


def op4_cotraining_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_quality(load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels"))


def op5_licence_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licences(load(spark, sf_dir, "documents"))


def op6_countmin_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_report(load(spark, sf_dir, "documents"))


def op7_brown_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(load(spark, sf_dir, "documents"))


def op8_bagminhash_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicate_classes(load(spark, sf_dir, "documents")).select("doc_id", "class_id")


def op9_template_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated_pairs(load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark")).drop("version")


def op10_collision_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(load(spark, sf_dir, "embeddings"))


def op11_adaptive_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(load(spark, sf_dir, "documents")).select("doc_id", *FACTS, "base_failed", "kept")


def op12_main_lorentz_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_report(periodic_runs(with_repeated_tails(load(spark, sf_dir, "documents"))))


def op13_multilinear_shapley(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_interactions(load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_toxicity_chain, op2_ring_shards, op3_swap_packing, op4_cotraining_quality, op5_licence_digests, op6_countmin_substrings, op7_brown_scores, op8_bagminhash_near_duplicates, op9_template_decontamination, op10_collision_neighbours, op11_adaptive_quality_rules, op12_main_lorentz_runs, op13_multilinear_shapley)}


def oracle_sql() -> dict[str, str]:
    return {"op5_licence_digests": scan_sql(), "op6_countmin_substrings": dedup_sql(), "op9_template_decontamination": contaminated_sql(), "op11_adaptive_quality_rules": rules_sql(), "op13_multilinear_shapley": audit_sql()}
