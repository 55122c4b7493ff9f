import random

import pytest


@pytest.fixture
def rng(request):
    return random.Random(request.node.name)
