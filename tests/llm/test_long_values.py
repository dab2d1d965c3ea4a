"""Values without quotes of any length."""

from __future__ import annotations

import random
import time

import pytest

from inkstone.llm import secrets


@pytest.mark.parametrize("n", [1_000, 1_024, 1_025, 5_000, 300_000])
def test_long_values_are_found(n):
    value = "".join(random.Random(n).choices("abcdefghjkmnpqrstuvwxyz23456789", k=n))
    text = f"db_password = {value}\nother = {value}\n"
    assert ("pair", 14, 14 + n) in secrets.scan(text)


def test_long_values_weigh_as_by_the_rule():
    text = "token=x1" + "password=ab3-" * 400 + "Q"
    found = secrets._long_weights(text, secrets.assignments(text))
    assert len(found) > 100
    for (start, end), (weight, digit) in found.items():
        assert abs(weight - secrets.literal_weight(text[start:end])) < 1e-9 and digit


@pytest.mark.parametrize("unit", ["password=", "token=a1", "a=", "secret:b2="])
def test_a_megabyte_of_nested_assignments(unit):
    began = time.time()
    secrets.scan(unit * (1_000_000 // len(unit)))
    assert time.time() - began < 60
