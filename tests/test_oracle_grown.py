"""Queries against their SQL on tables with what only larger ones hold: repeated urls, far keys."""

import shutil
from pathlib import Path

import duckdb
import pytest
from compare import connect, difference
from conftest import SF_SMALL

import __spark_entry__ as entry


def grown(tmp_path, table: str, sql: str) -> str:
    """The smallest tables, with ``table`` as ``sql`` over the supplied one makes it."""
    for file in Path(SF_SMALL).glob("*.parquet"):
        shutil.copyfile(file, tmp_path / file.name)
    source = f"'{SF_SMALL}/{table}.parquet'"
    duckdb.sql(f"COPY ({sql.format(source)}) TO '{tmp_path}/{table}.parquet' (FORMAT parquet)")
    return str(tmp_path)


def check(spark, sf: str, name: str):
    assert difference(entry.queries()[name](spark, sf), connect(sf), entry.oracle_sql()[name]) is None


REPEATED_URLS = "SELECT * FROM {0} UNION ALL SELECT * REPLACE (page_id + 1000000 AS page_id) FROM {0} WHERE page_id % 3 = 0"


@pytest.mark.parametrize("name", ["discovery_report", "discovery_text"])
def test_pages_that_share_a_url_stay_apart(spark, tmp_path, name):
    check(spark, grown(tmp_path, "pages", REPEATED_URLS), name)


# Days of these ids reach back over year 0 (739,000), past 10,000 years (3,660,000) and the last instant of a timestamp.
FAR_EVENTS = """SELECT * REPLACE (CASE WHEN event_id < 600 THEN 738000 + event_id * 10 WHEN event_id < 800 THEN event_id * 9000
  ELSE 106000000 + event_id * 1000 END AS event_id) FROM {0}"""


def test_durations_before_year_zero(spark, tmp_path):
    sf = grown(tmp_path, "events", FAR_EVENTS)
    check(spark, sf, "durations")
    got = {r.event_id: r.since for r in entry.queries()["durations"](spark, sf).where("event_type = 'signup'").collect()}
    assert any(v is None for v in got.values()) and any((v or "").startswith("-0") for v in got.values())
    assert all(v is not None for k, v in got.items() if k < 100_000_000)
