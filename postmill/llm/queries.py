"""Queries of the llm operators on the test tables: each takes (spark, sf_dir)."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from postmill.functions.session import spill, table
from postmill.llm.langid import page_languages
from postmill.llm.mixing import mix
from postmill.llm.neardup import expanded, near_duplicates
from postmill.llm.packing import fill_containers, report
from postmill.llm.pages import page_lines, read_pages
from postmill.llm.places import map_places
from postmill.llm.quality import text_quality
from postmill.llm.residue import find_residue
from postmill.llm.tokens import sized


def with_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "jobs").where(F.col("description_text").isNotNull() & (F.col("description_text") != ""))


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = page_lines(with_text(spark, sf_dir), wanted=("furniture",))
    kept = lines.join(p6_found(spark, sf_dir), "dedupe_key", "left_anti")
    return kept.select("dedupe_key", F.explode("furniture").alias("line_no"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    jobs = with_text(spark, sf_dir)
    found = page_languages(jobs)
    wrong = F.col("lang").isNotNull() & ~F.col("declared").eqNullSafe(F.col("lang"))
    title = F.col("lang").isNotNull() & F.col("title_lang").isNotNull() & (F.col("title_lang") != F.col("lang"))

    def case(part: str, no: Column, lang: Column) -> Column:
        return F.struct(F.lit(part).alias("part"), no.cast("int").alias("line_no"), lang.alias("lang"))

    main = F.col("lang")
    lines = F.transform(
        F.filter("segments", lambda s: (s["pieces"] >= 4) & (s["lang"] != main)), lambda s: case("line", s["line_no"], s["lang"])
    )
    cases = F.concat(
        F.array_compact(F.array(F.when(wrong, case("record", F.lit(0), main)), F.when(title, case("title", F.lit(0), F.col("title_lang"))))), lines
    )
    # Few records have cases, so those are what goes into the join.
    found = found.select("dedupe_key", F.explode(cases).alias("c")).select("dedupe_key", "c.part", "c.line_no", "c.lang")
    return found.join(p6_found(spark, sf_dir), "dedupe_key", "left_anti")


def bodies(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Batches of pages as batches of their titles and body lines."""
    for pdf in read_pages((x.rename(columns={"title": "name"}) for x in it), ("joined",)):
        yield pdf.rename(columns={"joined": "t"})


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    members, links = near_duplicates(with_text(spark, sf_dir), key="dedupe_key", text="description_text", width=3, threshold=0.6, also=("title",), prepare=bodies)
    kept = members.join(p6_found(spark, sf_dir), "dedupe_key", "left_anti")
    return expanded(kept, links, key="dedupe_key")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    jobs = table(spark, sf_dir, "jobs").select(F.lit("jobs").alias("tbl"), F.col("dedupe_key").alias("rec_key"), F.col("location").alias("value"))
    path = table(spark, sf_dir, "path_feed").select(
        F.lit("path_feed").alias("tbl"), F.col("row_id").cast("string").alias("rec_key"), F.col("locationsText").alias("value")
    )
    found = map_places(jobs.unionByName(path), table(spark, sf_dir, "places"), keys=("tbl", "rec_key"))
    return found.select("tbl", "rec_key", "place_id").distinct()


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_residue(table(spark, sf_dir, "jobs")).select("dedupe_key")


CAPACITY = 4096


def p8_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_containers(sized(table(spark, sf_dir, "documents")), CAPACITY)


def p8_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(p8_containers(spark, sf_dir), CAPACITY)


def mixed(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    docs = spill(sized(table(spark, sf_dir, "documents"), keep=("doc_id", "source")))
    return mix(docs, table(spark, sf_dir, "mix_targets"))


def p9_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixed(spark, sf_dir)[0]


def p9_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixed(spark, sf_dir)[1]


def p10_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text_quality(table(spark, sf_dir, "documents"))


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p10_stats(spark, sf_dir).where(F.col("kind").isin("list", "table", "junk")).select("doc_id", "kind")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "p1_found": p1_found,
    "p2_found": p2_found,
    "p3_found": p3_found,
    "p6_found": p6_found,
    "p7_found": p7_found,
    "p8_containers": p8_containers,
    "p8_report": p8_report,
    "p9_selection": p9_selection,
    "p9_shares": p9_shares,
    "p10_stats": p10_stats,
    "p10_found": p10_found,
}
SQL: dict[str, str] = {}
