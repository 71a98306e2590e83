"""Ranks inside ranges of values: they do not hang on how rows are dealt to partitions."""

from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from shadespark import queries
from shadespark.sources import tables

LARGE = "/root/testdata/sf0.1"


@pytest.fixture
def dealt_anew(spark, monkeypatch):
    """Tables that queries store are in other partitions each time they are read, as rows on a cluster may come in any order."""
    write = tables.stored

    def deal(frames):
        for f in frames:
            yield f.assign(_p=np.random.default_rng().integers(64, size=len(f)))

    def stored(df, name):
        got = write(df, name)
        return got.mapInPandas(deal, got.withColumn("_p", F.lit(0).cast("long")).schema).repartition(8, "_p").drop("_p")

    monkeypatch.setattr(tables, "stored", stored)
    spark.conf.set("spark.sql.exchange.reuse", "false")
    yield
    spark.conf.unset("spark.sql.exchange.reuse")


@pytest.mark.parametrize("name", ["chk2_constraints", "set1_concat", "win3_weak_labels"])
def test_ranks_do_not_hang_on_how_rows_are_dealt(spark, dealt_anew, name):
    con = duckdb.connect()
    con.sql(f"create view part as select * from '{LARGE}/part.parquet'")
    rel = con.sql(queries.oracle_sql()[name])
    got = queries.queries()[name](spark, LARGE).select(*rel.columns).collect()
    assert Counter(map(tuple, got)) == Counter(rel.fetchall())
