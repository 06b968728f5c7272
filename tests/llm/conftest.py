"""Each test draws its rows from a seed of its own, so that it has the same ones whatever ran before it."""

import zlib

import pytest

from tests.llm import test_operators


@pytest.fixture(autouse=True)
def own_seed(request):
    test_operators.R.seed(zlib.crc32(request.node.nodeid.split("/")[-1].encode()))
