import __spark_entry__ as E
from strata.operators import sampling as S
from strata import catalog as C


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.count() > 0
    assert set(df.columns) == {"doc_id", "idx", "tf", "idf", "tfidf"}


def test_every_oracle_has_a_query():
    assert set(E.oracle_sql()) <= set(E.queries())


def test_fold_and_split_partition_rows(spark, sf):
    p = C.points(spark, sf).select("id")
    n = p.count()
    parts = S.split_by_id(p, [0.7, 0.3], "id")
    assert sum(x.count() for x in parts) == n
    folds = S.k_fold(p, 3, seed=1, id_col="id")
    assert all(tr.count() + va.count() == n for tr, va in folds)
    assert sum(va.count() for _, va in folds) == n
