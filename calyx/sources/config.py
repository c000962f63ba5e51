"""Rules, jobs and boxes from YAML and JSON as DataFrames, and hooks for what this library does not do itself."""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RULE_SCHEMA = "ord int, name string, keyword string, page int, sheet string, cell string, extract string"


def rule_table(spark: SparkSession, text: str) -> DataFrame:
    """The rules of a YAML text in order; an entry's own values win over the defaults. A rule file is small."""
    import yaml

    data = yaml.safe_load(text) or {}
    defaults = data.get("defaults") or {}
    rows = []
    for i, rule in enumerate(data.get("rules") or []):
        search, excel = rule.get("search") or {}, {**defaults, **(rule.get("excel") or {})}
        rows.append((i, rule.get("name"), search.get("keyword"), search.get("page"), excel.get("sheet"), excel.get("cell"), excel.get("extract")))
    return spark.createDataFrame(rows, RULE_SCHEMA)


def job_table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("root string, folders array<string>, label string").json(path, multiLine=True)


def box_table(spark: SparkSession, text: str) -> DataFrame:
    """Boxes by page from either form: a list per page, or an object with the page's size and rotation. Pages count from 1."""
    rows = []
    for page, value in json.loads(text).items():
        meta = value if isinstance(value, dict) else {"boxes": value}
        for x0, top, x1, bottom in meta.get("boxes") or []:
            rows.append((int(page), float(x0), float(top), float(x1), float(bottom), int(meta.get("rotation") or 0), meta.get("width"), meta.get("height")))
    return spark.createDataFrame(rows, "page int, x0 double, top double, x1 double, bottom double, rotation int, page_w double, page_h double")


def parsed_arp(lines: DataFrame, line: str) -> DataFrame:
    """``ip, mac`` from lines of an address table."""
    return lines.select(
        F.regexp_extract(line, r"(\d{1,3}(?:\.\d{1,3}){3})", 1).alias("ip"),
        F.lower(F.translate(F.regexp_extract(line, r"((?:[0-9A-Fa-f]{2}[:-]){5}[0-9A-Fa-f]{2})", 1), "-", ":")).alias("mac"),
    ).where("ip <> '' and mac <> ''")


def parsed_connections(lines: DataFrame, line: str) -> DataFrame:
    """``remote, state`` from lines of a connection list."""
    parts = F.filter(F.split(F.trim(line), r"\s+"), lambda p: p != "")
    return lines.where(F.lower(F.trim(line)).startswith("tcp")).select(F.regexp_replace(F.get(parts, F.lit(2)), r":\d+$", "").alias("remote"), F.get(parts, F.lit(3)).alias("state"))


def with_fallback_text(pages: DataFrame, text: str, recognise: Callable[[pd.Series], pd.Series], content: str, least: int = 50) -> DataFrame:
    """Pages whose text is shorter than ``least`` get theirs from a recogniser; others never reach it.

    The recogniser (OCR) is injected; none is bundled.
    """
    short = F.length(F.trim(F.coalesce(text, F.lit("")))) < least
    fine = pages.where(~short).withColumn("origin", F.lit("text"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch.assign(**{text: recognise(batch[content]), "origin": "recognised"})

    poor = pages.where(short)
    return fine.unionByName(poor.mapInPandas(run, fine.schema))


class ServiceError(Exception):
    """A failed call of a service, with its status."""

    def __init__(self, status: int, text: str = ""):
        super().__init__(f"{status} {text}".strip())
        self.status = status


def passing(error: Exception) -> bool:
    """Whether a call that failed so may work later: too many requests, or the server's fault."""
    status = getattr(error, "status", None)
    return isinstance(error, (ConnectionError, TimeoutError)) or status == 429 or (isinstance(status, int) and 500 <= status < 600)


def extracted(
    texts: DataFrame, key: str, text: str, make_client: Callable[[], Callable[[str], str]], retries: int = 3, wait: float = 1.0
) -> DataFrame:
    """``key, answer, error, calls`` of a model asked about each text, one client per partition.

    A call is tried again, at most ``retries`` times more and after ``wait``, twice and four
    times that many seconds, where the failure may pass; others are reported at once.
    """
    kind = texts.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        client = make_client()
        for batch in batches:
            rows = []
            for k, t in zip(batch[key], batch[text]):
                answer, error, calls = None, None, 0
                while True:
                    calls += 1
                    try:
                        answer, error = client(t), None
                        break
                    except Exception as e:
                        error = f"{type(e).__name__}: {e}"
                        if calls > retries or not passing(e):
                            break
                        time.sleep(wait * 2 ** (calls - 1))
                rows.append((k, answer, error, calls))
            yield pd.DataFrame(rows, columns=[key, "answer", "error", "calls"])

    return texts.select(key, text).mapInPandas(run, f"{key} {kind}, answer string, error string, calls int")


BLUEPRINT = "ord int, chapter string, title string, slot int, rule string, phrases array<string>, tie string"


def blueprint_table(spark: SparkSession, text: str) -> DataFrame:
    """The chapters and slots of a YAML blueprint in order: one row per slot and matching rule.

    A slot names its rules (title_all, title_any, text_all, content_any) with their
    phrases, and how ties are broken (``first`` if it does not say). A blueprint is small.
    """
    import yaml

    rows = []
    for chapter in (yaml.safe_load(text) or {}).get("chapters") or []:
        for n, slot in enumerate(chapter.get("slots") or [], 1):
            for rule, phrases in (slot.get("match") or {}).items():
                rows.append((len(rows), str(chapter.get("id")), chapter.get("title"), slot.get("slot", n), rule, list(phrases), slot.get("tie", "first")))
    return spark.createDataFrame(rows, BLUEPRINT)
