"""Registered queries against their oracle SQL.

The default run takes the queries that finish quickly; ORACLE_ALL=1 takes all.
"""

import os

import pytest

from pagesieve.plans.catalogue import ORACLES, QUERIES
from tests.compare import check, duck

FOLDER = os.environ.get("ORACLE_DIR", "/root/testdata/sf0.001")
QUICK = ("url_", "ledger_", "health_", "event_", "analysis_", "quality_", "preview_", "redact_", "model_", "page_", "stream_")
# One query of every other prefix.
ONE_EACH = (
    "dom_select_siblings", "record_bad_container", "content_markdown_catalog", "profile_headings", "link_decision_counts",
    "scope_full_site", "pattern_prefix_glob", "frontier_preview_rows", "variant_merge", "control_groups", "sink_markdown_choice",
)
NAMES = [n for n in QUERIES if os.environ.get("ORACLE_ALL") or n.startswith(QUICK) or n in ONE_EACH]


def test_the_chosen_ones_exist():
    assert set(ONE_EACH) <= set(QUERIES)


@pytest.fixture(scope="module")
def con():
    return duck(FOLDER)


@pytest.mark.parametrize("name", NAMES)
def test_matches_oracle(spark, con, name):
    assert check(spark, name, QUERIES, ORACLES, FOLDER, con) is None


def test_every_oracle_belongs_to_a_query():
    assert set(ORACLES) <= set(QUERIES)
