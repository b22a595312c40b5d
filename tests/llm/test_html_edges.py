"""Text of pages with missing end tags, and of very long ones."""

import time

import pytest

from confluo.llm.host_suffix import extract


@pytest.mark.parametrize("page, text", [
    ("<html><head><title>T</title><body><p>Hello world this is text</p></body></html>", "Hello world this is text"),
    ("<p>a</p><svg><path/><p>Hello world</p>", "a\nHello world"),
    ("<head><title>T<body><p>kept</p>", "kept"),
    ("<head><script>var a = '<p>no</p>';</script><meta name=x></head>yes", "yes"),
    ("<p>a<noscript>b<p>c", "a\nb\nc"),
    ("x<noscript><p>Enable it</p></noscript>y<template><p>z</p></template>", "x\ny"),
    ("<select><option>1</option><div>after</div>", "after"),
    ("<p>a</p><!-- never closed <p>b</p>", "a"),
    ("<svg><text>drawn</text></svg>told", "told"),
    ("<TITLE>t</TITLE ><P>up</P>", "up"),
    ("<script src=x", ""),
])
def test_missing_ends(page, text):
    assert extract(page) == text


@pytest.mark.parametrize("piece", ["<title>", "<svg>", "<template>", "<noscript>", "<script>", "<!--", "<head ", "<b ", "</title ", "<", "&", "<select><p>", " \n ", "<title><p>"])
def test_time_is_linear(piece):
    page = piece * 100_000
    began = time.perf_counter()
    extract(page)
    assert time.perf_counter() - began < 3
