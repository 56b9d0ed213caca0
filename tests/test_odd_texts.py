"""Queries over documents of odd texts against their SQL."""

import os

import duckdb
import pytest

from tessera.plans import catalog
from tests.helpers import same

ODD = ["", " ", "\t", " \n \n", "\x0c", "\t\n a", "a b c d e f\n  lead", "trail \t\nx", "a < b c d e\nf", "NOTE this is\nmore x y z", "WEBVTT x y z", "<b>STYLE</b> a b", " NOTE b c", "b c d <i e\nf>", "x\r\ny z\ra", "a <b> c d", "a<>b c", "00:00:01.000 --> 00:00:02.000 a b", "\xa0", "a  b  c  d  e"]


@pytest.fixture(scope="module")
def odd(sf_dir, tmp_path_factory):
    d = tmp_path_factory.mktemp("odd")
    c = duckdb.connect()
    for name in os.listdir(sf_dir):
        if name != "documents.parquet":
            (d / name).symlink_to(f"{sf_dir}/{name}")
    c.execute(f"CREATE TABLE t AS SELECT * FROM '{sf_dir}/documents.parquet' LIMIT 20")
    c.executemany("INSERT INTO t VALUES (?, ?, 'en', 'src1', 1)", [[1000 + i, x] for i, x in enumerate([*ODD, None])])
    c.execute(f"COPY t TO '{d}/documents.parquet'")
    c.execute("DROP TABLE t")
    c.execute(f"CREATE VIEW documents AS SELECT * FROM '{d}/documents.parquet'")
    return str(d), c


@pytest.mark.parametrize("name", ["index_build", "bm25_fielded", "vtt_to_text"])
def test_odd_texts(spark, odd, name):
    path, duck = odd
    assert same(catalog.QUERIES[name](spark, path), duck, catalog.ORACLES[name])
