import pytest

from tessera.session import local_session


@pytest.fixture(scope="session")
def spark():
    session = local_session(4, 4, "4g")
    yield session
    session.stop()


@pytest.fixture
def rows():
    """Sorted rows of a DataFrame as tuples."""

    def of(df, *columns):
        got = df.select(*columns) if columns else df
        return sorted((tuple(r) for r in got.collect()), key=lambda r: tuple((v is not None, str(type(v)), v) if not isinstance(v, list) else (True, "", tuple(v)) for v in r))

    return of


@pytest.fixture(scope="session")
def matches_sql(spark):
    """Whether a query's rows are those of its SQL in DuckDB, doubles to nine digits."""
    import duckdb

    folder = "/root/testdata/sf0.001"
    tables = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
    db = duckdb.connect()
    for t in tables:
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")

    def plain(value):
        return float(f"{value:.9g}") if isinstance(value, float) else value

    def of(query, sql):
        df = query(spark, folder)
        names = sorted(df.columns)
        quoted = ", ".join(f'"{n}"' for n in names)
        want = db.execute(f"SELECT {quoted} FROM ({sql})").fetchall()
        got = [tuple(r) for r in df.select(*names).collect()]
        return sorted(map(repr, (tuple(map(plain, r)) for r in got))) == sorted(map(repr, (tuple(map(plain, r)) for r in want)))

    return of
