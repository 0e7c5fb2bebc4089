"""The fixture queries reproduce the facts SURVEY §7.3 states for sf0.01."""

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as E

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def q():
    return E.queries()


def test_hour_matrix_red_counts(spark, q):
    r = q["hour_matrix"](spark, SF).agg(F.sum("red_cells"), F.count_if("is_abnormal"), F.count("*")).collect()[0]
    assert list(r) == [16, 14, 90]


def test_customer_and_order_facts(spark, q):
    assert q["missing_related"](spark, SF).count() == 203
    af = q["age_flag"](spark, SF).agg(F.count_if(F.col("age_days").isNull()), F.count_if(F.col("age_days") > 1000)).collect()[0]
    assert list(af) == [203, 470]
    lr = q["long_running"](spark, SF).agg(F.count("*"), F.count_if("is_abnormal")).collect()[0]
    assert list(lr) == [4237, 1193]
    ew = q["expiry_window"](spark, SF).agg(F.count("*"), F.count_if("is_abnormal")).collect()[0]
    assert list(ew) == [725, 190]
    bf = dict((r.kind, r["count"]) for r in q["backup_freshness"](spark, SF).groupBy("kind").count().collect())
    assert bf["history"] == 569


def test_event_and_conversation_facts(spark, q):
    rf = q["recent_failures"](spark, SF)
    assert rf.select("user_id").distinct().count() == 141
    sg = q["sequence_gap"](spark, SF).agg(F.count_if(F.col("gap") == 1), F.count_if(F.col("applied").isNull())).collect()[0]
    assert list(sg) == [44, 2]


def test_redundant_index_counts_the_survey_pairs(spark, q):
    # the linear per-index output carries the pair count: sum(n_covering) = number of (A, B) prefix pairs
    assert q["redundant_index"](spark, SF).agg(F.sum("n_covering")).collect()[0][0] == 24183
