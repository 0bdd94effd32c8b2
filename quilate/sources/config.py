"""Catalogue and scraper configuration from YAML, rates from JSON, jobs as a table."""

from __future__ import annotations

from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quilate.schemas import CATALOG


def read_yaml(path: str):
    import yaml

    if not Path(path).exists():
        raise FileNotFoundError(path)
    return yaml.safe_load(Path(path).read_text(encoding="utf-8"))


def catalog_rows(data) -> list[tuple]:
    """Rows of the catalogue in file order; errors for a missing list, a missing or a repeated sku."""
    if not isinstance(data, dict) or "canonical_products" not in data:
        raise KeyError("canonical_products")
    entries = data["canonical_products"]
    if not isinstance(entries, list):
        raise TypeError("canonical_products must be a list")
    seen, rows = set(), []
    for pos, e in enumerate(entries, 1):
        if not e.get("sku"):
            raise ValueError(f"entry {pos} has no sku")
        if e["sku"] in seen:
            raise ValueError(f"repeated sku: {e['sku']}")
        seen.add(e["sku"])
        rows.append((pos, e["sku"], e.get("brand_family"), e.get("category"), e.get("release_year"), e.get("notes")))
    return rows


def load_catalog(spark: SparkSession, path: str) -> DataFrame:
    return spark.createDataFrame(catalog_rows(read_yaml(path)), CATALOG)


@dataclass(frozen=True)
class Job:
    source: str
    name: str
    urls: tuple[str, ...]
    request_delay: float
    timeout: float
    max_pages: int


def _positive(value, name: str):
    if value is not None and not value > 0:
        raise ValueError(f"{name} must be positive")
    return value


def load_jobs(data: dict) -> list[Job]:
    """Jobs of the enabled sources; a job's settings go before its source's defaults and the global ones."""
    common = data.get("global", {})
    jobs = []
    for source, spec in data.items():
        if source == "global" or not spec.get("enabled", True):
            continue
        base = spec.get("defaults", {})
        pick = lambda job, key, last, base=base: next(v for v in (_positive(job.get(key), key), _positive(base.get(key), key), _positive(common.get(key), key), last) if v is not None)
        for job in spec.get("jobs", []):
            if not job.get("urls"):
                raise ValueError(f"{source}: a job has no urls")
            jobs.append(Job(source, job["name"], tuple(job["urls"]), pick(job, "request_delay", 1.0), pick(job, "timeout", 10), pick(job, "max_pages_per_url", 20)))
    return jobs


def job_table(spark: SparkSession, jobs: list[Job]) -> DataFrame:
    """One row per job and address."""
    rows = [(j.source, j.name, list(j.urls), float(j.request_delay), float(j.timeout), j.max_pages) for j in jobs]
    df = spark.createDataFrame(rows, "source string, job string, urls array<string>, request_delay double, timeout double, max_pages int")
    return df.select("source", "job", F.explode("urls").alias("base_url"), "request_delay", "timeout", "max_pages")


def rate_from_json(body: Column) -> Column:
    """Pesos per dollar of a rates document; NULL if it is missing or unreadable."""
    return F.get_json_object(body, "$.usd.uyu").try_cast("double")


#: Address of the rates document of a day, and how long to wait for it. Fixed values.
RATES_ADDRESS, RATES_TIMEOUT = "https://cdn.jsdelivr.net/npm/@fawazahmed0/currency-api@{date}/v1/currencies/usd.json", 10


def rates_of_weeks(spark: SparkSession, weeks: list[str], address: str = RATES_ADDRESS) -> DataFrame:
    """(``week_start``, ``usd_uyu_rate``) of each week's document, one request a week; NULL where it is missing or unreadable.

    The source of ``pages.PageSource`` has to be registered. A week asked for twice is fetched once.
    """
    wanted = sorted(set(weeks))
    if not wanted:
        return spark.createDataFrame([], "week_start string, usd_uyu_rate double")
    urls = spark.createDataFrame([(w, address.format(date=w)) for w in wanted], "week_start string, url string")
    pages = spark.read.format("pages").option("urls", ",".join(address.format(date=w) for w in wanted)).option("timeout", str(RATES_TIMEOUT)).load()
    rate = F.when(F.col("status") == 200, rate_from_json(F.col("html")))
    return urls.join(pages, "url", "left").select("week_start", rate.alias("usd_uyu_rate"))
