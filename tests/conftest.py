import pytest

from ledgerlake.session import build_session


@pytest.fixture(scope="session")
def spark():
    session = build_session("tests", "local[8]", spark__driver__memory="8g", spark__sql__shuffle__partitions="4")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def rows():
    def collect(df, *columns):
        chosen = df.select(*columns) if columns else df
        return sorted((tuple(r) for r in chosen.collect()), key=repr)

    return collect
