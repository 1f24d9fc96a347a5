"""Markup of real pages that training pages do not have."""

import time

import pytest

from tidelog.llm import extract
from tidelog.llm.blocks import leaf_blocks


def texts(page):
    return [b.text for b in leaf_blocks(page, labelled=False)]


def test_data_label_of_a_page_is_not_a_training_label(spark):
    page = '<article><p>Some text.</p><table><tr><td data-label="Price">text</td></tr></table></article>'
    assert texts(page) == ["Some text.", "text"]
    frame = spark.createDataFrame([(1, "u", page)], "page_id bigint, url string, html string")
    assert extract.extract(frame).count() == 1


@pytest.mark.parametrize("name", ["object", "svg", "math", "noscript", "iframe", "template"])
def test_elements_left_open_do_not_take_the_page(name):
    assert texts(f"<p>one</p><{name} a=b><p>two</p>") == ["one", "two"]
    assert len(texts(f"<{name}>" * 20_000 + "<p>two</p>")) == 1


def test_fallback_text_stays():
    page = "<article><p>Let <math><mi>x</mi></math> be.</p><object><p>A picture.</p></object><noscript>Shown.</noscript></article>"
    assert texts(page) == ["Let x be.", "A picture.", "Shown."]
    assert texts("<p>one</p><script>two") == texts("<p>one</p><style>two") == ["one"]


@pytest.mark.parametrize("page", ["<div>a" * 160_000, "".join(f"<x{k}>a</y{k}><div>" for k in range(40_000)),
                                  "<p><object>" + "<b><div>a</div>" * 60_000, "<li><b>a" * 100_000],
                         ids=["blocks", "names", "inline", "items"])
def test_a_megabyte_of_nesting_takes_seconds(page):
    blocks = leaf_blocks(page, labelled=False)
    begin = time.process_time()
    assert len(extract.features(blocks)) == len(blocks) > 30_000
    leaf_blocks(page, labelled=False)
    assert time.process_time() - begin < 20


def test_features_come_from_all_elements_around():
    page = '<main><div class="post"><own-name id="nav"><ul><li>one</ul></own-name><p>two</div><p>three</main>'
    one, two, three = extract.features(leaf_blocks(page, labelled=False))
    assert {"in main", "in div", "in ul", "in li", "parent li", "role nav", "role content"} <= set(one)
    assert "in own-name" not in one and "role nav" not in two and "parent p" in two and "in p" in two
    assert "role content" in two and "in div" not in three and "in main" in three
