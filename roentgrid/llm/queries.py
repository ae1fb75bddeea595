"""The registered queries of this package, one for each operator, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import (
    bestfit, divergence, license_scan, mixing, multi_index, packing, periods, phrases, pii, pu_quality, rank_profiles, simhash, toxicity,
)
from .oracles import ORACLES as ORACLES

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def query(name: str):
    def wrap(fn):
        QUERIES[name] = fn
        return fn

    return wrap


@query("op1_context_patterns")
def op1(spark, folder):
    return pii.report(pii.detect(table(spark, folder, "documents")))


@query("op2_lexicon_automata")
def op2(spark, folder):
    docs = table(spark, folder, "documents")
    return toxicity.score(docs, toxicity.learn(docs, table(spark, folder, "labels")))


@query("op3_context_mixing")
def op3(spark, folder):
    return mixing.score(table(spark, folder, "documents"))


@query("op4_multi_index")
def op4(spark, folder):
    vectors = table(spark, folder, "embeddings")
    return multi_index.search(vectors, vectors.where("vec_id % 20 = 0"))


@query("op5_phrase_index")
def op5(spark, folder):
    return phrases.report(phrases.contamination(table(spark, folder, "documents"), table(spark, folder, "benchmark")))


@query("op6_bk_tree")
def op6(spark, folder):
    return simhash.components(simhash.fingerprints(table(spark, folder, "documents"))).select("doc_id", "fingerprint", "component_id")


@query("op7_notice_classifier")
def op7(spark, folder):
    docs = table(spark, folder, "documents")
    return license_scan.licenses(docs, license_scan.learn(docs))


@query("op8_pu_quality")
def op8(spark, folder):
    docs = table(spark, folder, "documents")
    return pu_quality.score(docs, pu_quality.learn(docs, table(spark, folder, "labels")))


@query("op9_concat_and_cut")
def op9(spark, folder):
    return packing.piece_digests(packing.concat_and_cut(table(spark, folder, "documents")))


@query("op10_best_fit")
def op10(spark, folder):
    return bestfit.best_fit_matrices(table(spark, folder, "documents"))


@query("op11_minimizer_runs")
def op11(spark, folder):
    return periods.report(periods.runs(periods.planted(table(spark, folder, "documents"))))


@query("op12_divergence_cube")
def op12(spark, folder):
    return divergence.audit(table(spark, folder, "documents"))


@query("op13_rank_profiles")
def op13(spark, folder):
    docs = table(spark, folder, "documents")
    return rank_profiles.predict(docs, rank_profiles.learn(docs))
