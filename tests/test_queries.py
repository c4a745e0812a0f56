import subprocess
import sys
from pathlib import Path

import oracle
import pytest
from pyspark.sql import functions as F

from tidemark.plans import corpora
from tidemark.plans import queries as core

REPO = Path(__file__).resolve().parent.parent
pytestmark = pytest.mark.skipif(not oracle.DATA.exists(), reason="no test tables here")


@pytest.fixture(scope="module")
def duck():
    return oracle.connection()


@pytest.mark.parametrize("name", sorted(core.SQL))
def test_same_as_sql(spark, duck, name):
    oracle.compare(spark, core.QUERIES[name], core.SQL[name], duck)


@pytest.mark.parametrize("name", sorted(corpora.QUERIES))
def test_corpora_same_as_sql(spark, duck, name):
    oracle.compare(spark, core.QUERIES[name], core.session_sql()[name], duck)


@pytest.mark.parametrize("name", sorted(set(core.QUERIES) - set(core.SQL) - set(corpora.QUERIES)))
def test_runs(spark, name):
    df = core.QUERIES[name](spark, str(oracle.DATA))
    assert len(df.columns) == len(set(df.columns)) and df.count() >= 0


def test_bigrams_with_many_stop_words(spark, tmp_path):
    for name in ("docs_topics", "candidates"):
        (tmp_path / f"{name}.parquet").symlink_to(oracle.DATA / f"{name}.parquet")
    stops = spark.read.parquet(str(oracle.DATA / "stop_words.parquet")).select("word")
    stops.union(spark.range(60_000).selectExpr("concat('zz', id)")).write.parquet(str(tmp_path / "stop_words.parquet"))
    rows = lambda d: sorted(map(str, core.QUERIES["topic_bigrams"](spark, str(d)).withColumns({c: F.round(c, 9) for c in ("tf", "weight")}).collect()))
    want = rows(oracle.DATA)
    assert want and rows(tmp_path) == want


def test_contract(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_core_stands_alone():
    """Nothing outside the text subpackage imports it, and the entry works without it."""
    for path in [*REPO.glob("tidemark/**/*.py"), *REPO.glob("tests/*.py")]:
        if "llm" not in path.relative_to(REPO).parts:
            assert "tidemark." + "llm" not in path.read_text(encoding="utf-8"), path
    code = "import sys; sys.modules['tidemark.' + 'llm'] = None; import __spark_entry__ as e; q = e.queries(); assert 'p4_found' in q and 'p1_found' not in q"
    subprocess.run([sys.executable, "-c", code], cwd=REPO, check=True)
