"""Every registered query against its SQL twin on the smallest tables."""

import glob
import os

import pytest

FOLDER = "/root/testdata/sf0.001"
duckdb = pytest.importorskip("duckdb")
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test data")

import __spark_entry__ as entry  # noqa: E402


def norm(pdf):
    pdf = pdf[sorted(pdf.columns)]
    one = lambda v: None if v is None or v != v else round(float(v), 5) + 0.0 if isinstance(v, float) else str(v)
    return sorted((tuple(map(one, r)) for r in pdf.astype(object).itertuples(index=False)), key=str)


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for p in glob.glob(f"{FOLDER}/*.parquet"):
        c.execute(f"create view {os.path.basename(p)[:-8]} as select * from read_parquet('{p}')")
    return c


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0


#: One query a family of operators; all of them with LEXICUBE_TESTS=all (about ten minutes).
SOME = ["tfidf_topk", "cube_score_a", "soft_assign", "knn_emb", "density_peak", "hier_paths", "avg_precision", "mmr_summary", "lexrank_scores", "skipped_fragments", "annotated_edges", "p2_found", "p2_recovered"]
CORE = [n for n in entry.oracle_sql() if not (n[0] == "p" and n[1].isdigit() and n[1] != "2")]


@pytest.mark.parametrize("name", sorted(CORE) if os.environ.get("LEXICUBE_TESTS") == "all" else SOME)
def test_against_sql(spark, duck, name):
    got = norm(entry.queries()[name](spark, FOLDER).toPandas())
    assert got == norm(duck.execute(entry.oracle_sql()[name]).fetchdf())


def test_names_agree():
    assert set(entry.oracle_sql()) <= set(entry.queries())
