"""Values in a credential context that are plainly no secrets, and secrets beside them."""

import pytest

from matquarry.llm import secretscan


@pytest.mark.parametrize(
    "text",
    [
        "Authorization: https://example.com/docs/index.html", "tokens: 1,234,567,890", "authorization: 2023-11-23T10:11:12Z", "pwd: read_from_vault()", "credential: os.environ['DB']",
        "pwd: 2023-11-23T10:11:12.5+01:00",
    ],
)
def test_plain_values_are_no_guesses(text):
    assert not [s for s in secretscan.spans(text, secretscan.guess_cost(secretscan.dictionary()), 10.0) if s[0] == 3]


@pytest.mark.parametrize("text", ["password = os.environ['DB_PASSWORD']", "password=get_password_from_vault()", "token: Zk9(x)7!qLw3vB"])
def test_guesses_do_not_overlap_base_spans(text):
    found = secretscan.spans(text, secretscan.guess_cost(secretscan.dictionary()), 10.0)
    base = [s for s in found if s[0] < 3]
    assert not [g for g in found if g[0] == 3 and any(a < g[2] and g[1] < b for _, a, b, _ in base)]


@pytest.mark.parametrize("text", ["pwd: x9$Kq!7zR#2vLw", "Authorization: Bearer q8Zr2LkP0vXwT5nB", "pwd: postgres://bob:x9Kq7zR2vLw@db.example.com/main"])
def test_real_ones_are_still_found(text):
    assert [s for s in secretscan.spans(text, secretscan.guess_cost(secretscan.dictionary()), 10.0) if s[0] == 3]
