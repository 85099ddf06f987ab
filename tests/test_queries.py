"""Every query with SQL against DuckDB on the smallest tables; the others for their invariants."""

import math
from pathlib import Path

import duckdb
import pytest

from blockloom import queries as core

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for table in ("embeddings", "lineitem"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    return con


def canon(frame):
    def cell(v):
        if v is None or v != v:
            return "null"
        return f"{float(v) + 0.0:.6g}" if not isinstance(v, str) else v

    return sorted(tuple(cell(v) for v in row) for row in frame[sorted(frame.columns)].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(core.ORACLE_SQL))
def test_matches_sql(spark, duck, name):
    got, want = core.QUERIES[name](spark, SF).toPandas(), duck.execute(core.ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert canon(got) == canon(want)


def test_coder_rates(spark):
    n = core._coded(spark, SF).count()
    bits = core.QUERIES["huffman_rate"](spark, SF).first().bits
    counts = [r["n"] for r in core._coded(spark, SF).groupBy("label").count().withColumnRenamed("count", "n").collect()]
    entropy = -sum(c / n * math.log2(c / n) for c in counts)
    assert entropy * n - 1 <= bits < (entropy + 1.05) * n
    assert 0 < core.QUERIES["context_coder_bits"](spark, SF).first().bits <= bits * 1.1
    assert 0 < core.QUERIES["mask_coder_bits"](spark, SF).first().bits < 1.3 * 500 * 64


def test_pca_keeps_energy(spark):
    import numpy as np

    rows = core.pca_fit(spark, SF).orderBy("component").collect()
    kernel = np.array([r.kernel for r in rows])
    assert np.allclose(kernel @ kernel.T, np.eye(4), atol=1e-9)
    assert [r.variance for r in rows] == sorted((r.variance for r in rows), reverse=True)


def test_similarity_and_bd(spark):
    assert core.structural_similarity(spark, SF).where("ssim > 1.000001 or ssim < 0.5").count() == 0
    by = {r.model: r for r in core.QUERIES["bd_rate"](spark, SF).collect()}
    assert abs(by["main"].bd_rate) < 1e-6 and abs(by["main"].bd_psnr) < 1e-9
