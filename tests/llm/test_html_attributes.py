"""Only an attribute named hidden hides an element."""

import pytest

from quernstone.llm import html


@pytest.mark.parametrize("attributes", ['style="overflow: hidden"', 'title="the hidden cost"', 'data-x="hidden"', "data-x='hidden'", "data-x=hidden", 'data-hidden', 'aria-hidden="false"', 'title="a > b hidden c"', 'title = " hidden "', 'href="/a/hidden"', "data-x=a/hidden"])
def test_shown(attributes):
    assert [b.text for b in html.leaf_blocks(f"<article {attributes}><p>Some text.</p></article>")] == ["Some text."]


@pytest.mark.parametrize("attributes", ["hidden", "HIDDEN", 'hidden=""', "hidden='hidden'", "hidden = until-found", 'class="x"hidden', 'title="a hidden b" hidden', 'class="x" hidden/'])
def test_hidden(attributes):
    assert html.leaf_blocks(f"<div {attributes}><p>Some text.</p></div>") == []


def test_names():
    (b,) = html.leaf_blocks("""<div title="class=no id=no" class="Post main-Body"id=x9 role='main' data-id="no"><p>Some text.</p></div>""")
    assert set(b.path) == {"<div", ".post", ".main", ".body", ".x", "<p", "in<p"}
