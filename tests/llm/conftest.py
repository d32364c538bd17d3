import pytest


@pytest.fixture(scope="session")
def sf_dir():
    return "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def llm():
    from layerstack.llm.queries import QUERIES

    return QUERIES
