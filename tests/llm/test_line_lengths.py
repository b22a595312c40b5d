"""Line rules on lines of a megabyte, and the menu expression against the SQL's."""

import re

import pytest
from pyspark.sql import functions as F

from confluo.llm import line_rules

N = 1 << 20
LONG = {
    "menu": ("home " * (N // 5), "navigation"), "menu_joined": ("home" * (N // 4), "navigation"), "bars": ("a | " * (N // 4), "navigation"), "marks": ("a!! " * (N // 4), "punctuation"),
    "one_word": ("x" * N, "punctuation"), "blanks": ("a" + " " * N + "b", "punctuation"), "dots": ("." * N, None), "quotes": ("a." + "'" * N + "x", "punctuation"), "almost_menu": ("home " * (N // 5) + "zebra", "repetition"),
}


@pytest.mark.parametrize("name", LONG)
def test_a_line_of_a_megabyte(spark, name):
    line, rule = LONG[name]
    got = line_rules.clean_lines(spark.createDataFrame([(1, line)], "doc_id long, text string")).first()
    broke = [r for r in line_rules.RULES if got[f"n_{r}"]]
    assert broke == ([rule] if rule else []) and got.n_lines == 1 and (got.text == "") == bool(rule)


@pytest.mark.parametrize("line", ["Home", "about us", "about", "About | us", "previous/prev", "log in, sign up", "sign", "homeabout us", "skip to content > read more", "menu - menu", "", "contact contacto", "Startseite · Impressum", "- home"])
def test_menu_expressions_agree(spark, line):
    """The possessive form takes the same lines as the plain one, which backtracks."""
    want = re.search(line_rules._MENU_SQL.replace(r"\z", r"\Z"), line) is not None
    assert spark.createDataFrame([(line,)], "x string").select(F.col("x").rlike(line_rules._MENU)).first()[0] == want


def test_no_menu_word_hides_a_longer_one():
    words = line_rules._MENU_WORDS.split("|")
    assert not [(a, b) for i, a in enumerate(words) for b in words[i + 1 :] if b.startswith(a)]


def test_lines_keep_their_digits(spark):
    text = "\n".join(f"{k} lines are counted here, {k}." for k in range(12))
    assert line_rules.clean_lines(spark.createDataFrame([(1, text)], "doc_id long, text string")).first().text == text
