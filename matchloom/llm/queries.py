"""Queries of the llm problems."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from matchloom.llm.bpe import encode_texts
from matchloom.llm.fixtures import match_fixtures
from matchloom.llm.identities import link_variants
from matchloom.llm.leaks import find_leaks, leak_report
from matchloom.llm.moderation import find_harmful, harmful_rates, score_documents
from matchloom.sources import read_table


def p1_confidence(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs of match ids that are one fixture, each with its confidence."""
    return match_fixtures(read_table(spark, folder, "matches"), read_table(spark, folder, "entities"))


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs of match ids that are one fixture."""
    return p1_confidence(spark, folder).select("match_id_a", "match_id_b")


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs of entities, line-up players and team texts that mean the same."""
    return link_variants(read_table(spark, folder, "entities"), read_table(spark, folder, "football_lineups"))


def p7_ids(spark: SparkSession, folder: str) -> DataFrame:
    """Every document's ids by byte_bpe_50k."""
    return encode_texts(read_table(spark, folder, "documents"))


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    """Documents that hold passages of evaluation items."""
    return find_leaks(read_table(spark, folder, "documents"), read_table(spark, folder, "eval_items"))


def p8_overlap(spark: SparkSession, folder: str) -> DataFrame:
    """The found pairs with the parts of passage and question and whether the answer is held too."""
    return leak_report(read_table(spark, folder, "documents"), read_table(spark, folder, "eval_items"))


def _remarks(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    return read_table(spark, folder, "documents"), read_table(spark, folder, "moderation_examples")


def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    """Documents with at least one abusive, hateful or sexual remark."""
    return find_harmful(*_remarks(spark, folder))


def p9_scores(spark: SparkSession, folder: str) -> DataFrame:
    """The score of every document."""
    return score_documents(*_remarks(spark, folder))


def p9_rates(spark: SparkSession, folder: str) -> DataFrame:
    """The rate of found documents per source."""
    return harmful_rates(*_remarks(spark, folder))


QUERIES = {"p1_found": p1_found, "p1_confidence": p1_confidence, "p6_found": p6_found, "p7_ids": p7_ids, "p8_found": p8_found, "p8_overlap": p8_overlap, "p9_found": p9_found, "p9_scores": p9_scores, "p9_rates": p9_rates}
ORACLES: dict[str, str] = {}
