"""Neither the shape of a bare value nor letters before a name hide a dear value."""

import random

import pytest

from confluo.llm import secret_guess

_HEX = "9f8e7d6c5b4a39281706f5e4d3c2b1a0"


def _secrets(text):
    return [text[a:b] for a, b, _, _, secret in secret_guess.findings(text) if secret]


@pytest.mark.parametrize("text, value", [("password=qzkxvbwplmtrghdnfj", "qzkxvbwplmtrghdnfj"), ("API_KEY=QXZJVKWPLMTRGHDN now", "QXZJVKWPLMTRGHDN"), ("token: zebraumbrellaquartzvioletmap", "zebraumbrellaquartzvioletmap")])
def test_bare_letters(text, value):
    assert _secrets(text) == [value]


@pytest.mark.parametrize("name", ["clientSecret: ", "dbPassword=", "userPassword = ", "githubToken=", "PGPASSWORD=", "dbpass=", "oauth: ", "DB_PASSWORD=", "my.password="])
@pytest.mark.parametrize("quote", ['"', ""])
def test_letters_before_the_name(name, quote):
    assert _secrets(f"x {name}{quote}{_HEX}{quote} y") == [_HEX]


def test_random_letters_are_found():
    rng = random.Random(3)
    values = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=16)) for _ in range(500)]
    assert sum(_secrets(f"password={v}") == [v] for v in values) >= 480


@pytest.mark.parametrize("text", ["the secret: nothing happened", "secret: straightforward", "Password: Benutzerverwaltung!", "token: configuración.", "auth: développement", "password: wachtwoordbeheer", "compass: q8#Zk2!vXw9Lm", "bypass: x9Kq#2Lm7Zw"])
def test_prose_stays(text):
    assert _secrets(text) == []


def test_redaction(spark):
    docs = spark.createDataFrame([(1, "PGPASSWORD=qzkxvbwplmtrghdnfj psql"), (2, f'clientSecret: "{_HEX}"')], "doc_id long, text string")
    assert {r.doc_id: r.text for r in secret_guess.redact_secrets(docs).collect()} == {1: "PGPASSWORD=[SECRET] psql", 2: 'clientSecret: "[SECRET]"'}
