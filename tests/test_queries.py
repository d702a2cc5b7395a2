"""Queries against their SQL on the smallest tables, and the entry module's contract."""

import pytest

import __spark_entry__ as entry
from tests.oracle import assert_same, connect
from thicket.plans import catalogue


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


@pytest.mark.parametrize("name", sorted(catalogue.SQL))
def test_query_matches_sql(spark, sf, con, name):
    assert_same(spark, con, sf, catalogue.QUERIES[name], catalogue.SQL[name])


def test_entry(spark):
    row = entry.entry(spark).first()
    assert row["n"] == 500 and row["ari"] is not None


def test_sql_is_of_queries():
    queries, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(queries) and set(catalogue.QUERIES) <= set(queries)


@pytest.mark.parametrize("name", ["forest_supervised", "forest_unsup", "mixture_post", "simulate"])
def test_kernels_repeat(spark, sf, name):
    one, other = (sorted(map(repr, catalogue.QUERIES[name](spark, sf).collect())) for _ in range(2))
    assert one == other and one


def test_forest_queries_take_all_samples(spark, sf):
    n = spark.read.parquet(f"{sf}/embeddings.parquet").count()
    for name in ("enhanced_forest_prox", "merged_leaves"):
        got = catalogue.QUERIES[name](spark, sf)
        column = next(c for c in ("i", "sample_idx") if c in got.columns)
        assert got.select(column).distinct().count() == n, name


@pytest.mark.parametrize("name", ["adaptive_filter", "ensemble_importance"])
def test_forests_are_given_all_samples(spark, sf, name, monkeypatch):
    n, seen, grow = spark.read.parquet(f"{sf}/embeddings.parquet").count(), [], catalogue.two_blocks
    monkeypatch.setattr(catalogue, "two_blocks", lambda *args: seen.append(grow(*args)) or seen[-1])
    assert catalogue.QUERIES[name](spark, sf).count() > 0
    assert [len(x) for x in seen[0]] == [n] * 3


def test_tsne_places_all_samples(spark, sf):
    got = catalogue.QUERIES["tsne"](spark, sf).toPandas()
    assert len(got) == spark.read.parquet(f"{sf}/embeddings.parquet").count() and got.notna().all(axis=None)


def test_cluster_imd_fits_the_whole_response(spark, sf, monkeypatch):
    seen, fit = [], catalogue.forest.fit
    monkeypatch.setattr(catalogue.forest, "fit", lambda spark, x, y, control: seen.append((x, y)) or fit(spark, x, y, control))
    assert catalogue.QUERIES["cluster_imd"](spark, sf).count() > 0
    assert seen[0][0].shape[1] == seen[0][1].shape[1] == 32


@pytest.mark.parametrize("name", ["spectral_labels", "pam_labels", "stability", "tsne", "ao_fusion", "reconstruct_spectral"])
def test_queries_without_sql_take_all_dims(spark, sf, name, monkeypatch):
    class Taken(Exception):
        pass

    def weights(m):
        raise Taken(m.agg({"tree": "max"}).first()[0], m.select("tree").distinct().count())

    monkeypatch.setattr(catalogue.leaves, "forest_weights", weights)
    with pytest.raises(Taken) as e:
        catalogue.QUERIES[name](spark, sf)
    assert e.value.args == ((63, 64) if name not in ("ao_fusion", "reconstruct_spectral") else (62, 32))
